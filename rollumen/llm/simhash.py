"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints that are equal become one row first. The 64 bits are then dealt into m parts, correlated bits together;
parts get thresholds t_i that sum to limit - m + 1, so two fingerprints within the limit differ by at most t_i bits in
some part i (-1: the part is not probed). A dynamic program picks the thresholds, and the number of parts, by the
candidates they are expected to give: bits are taken as independent within a part, and the estimate of equal parts is
replaced by the exact number of collisions, from counts over all fingerprints. Each fingerprint is filed under its own
value of a part and probes the values within t_i bits. A bucket is searched breadth first: what a pivot links is not
compared again, so a bucket gives fewer links than it has members and a dense group costs about one pass. Buckets above
BLOCK members are cut into blocks, and pairs of blocks meet, so no task holds an unbounded group.

Nulls: a null text is the empty one, whose fingerprint is 0 and links like any other. Rows with a null id get a
fingerprint and the component of their fingerprint's class. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollumen.llm.common import cut, most_frequent, stored, text_bytes
from rollumen.llm.components import connected_components

LIMIT, WORDS, BLOCK, CHUNK = 4, 4, 4096, 1 << 16
PARTS = (2, 3, 4, 5)
#: Near-duplicates: buckets of over CROWD members are first compared with PIVOTS of their members.
CROWD, PIVOTS = 16, 3
#: Shingles that come last in the prefix filter's order: at most so many, by counts over one of SOME documents.
COMMON, SOME = 200_000, 16
#: Longs in the shortest sketch.
SKETCH = 32
#: Rows of a block where sketches are compared in place; partners of a set that one task compares it with; bits of the table of
#: ids whose shingles are wanted.
NEAR_BLOCK, PARTNERS, SLOT_BITS = 1024, 512, 26
#: Rounds of pivots, at most; pairs left for each row of a crowded key at which the rounds end, and the share of them that a
#: round has to take away for another one to follow; keys of a document that are listed.
TURNS, FEW, WORTH, LISTED = 5, 4, 0.2, 256


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of a whole text; memory is bounded by CHUNK shingles at a time."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxh64_intdigest(b" ".join(tokens), 42)
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(size)
    starts, ends = (ends - size)[: len(tokens) - words + 1], ends[words - 1 :] - 1
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), CHUNK):
        pairs = zip(starts[k : k + CHUNK].tolist(), ends[k : k + CHUNK].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    on = counts * 2 > len(starts)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(x, words) for x in text_bytes(b.column(1))], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(scan, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j set: a 64 x 64 matrix, whatever the input."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = np.ascontiguousarray(b.column(0).to_numpy()).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        cells = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(cells)], names=["k", "v"])

    got = fps.select("fp").mapInArrow(scan, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    cells = np.zeros(4097)
    for r in got:
        cells[r["k"]] = r["v"]
    return int(cells[4096]), cells[:4096].reshape(64, 64)


def deal_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of bits, of sizes that differ by one at most; each takes the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, parts = set(range(64)), []
    for k in range(m):
        room = (64 - sum(map(len, parts))) // (m - k)
        own = [max(left, key=lambda b: (corr[b, list(left)].sum(), -b))]
        left.discard(own[0])
        while len(own) < room:
            best = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            left.discard(best)
        parts.append(sorted(own))
    return parts


def expected(n: int, both: np.ndarray, part: list[int], most: int) -> list[float]:
    """Expected pairs that differ by at most t bits in a part, t from 0 to most."""
    p = np.diag(both)[part] / max(n, 1)
    dist = np.array([1.0])
    for x in 2 * p * (1 - p):
        dist = np.convolve(dist, [1 - x, x])
    return [float(n) * n / 2 * dist[: t + 1].sum() for t in range(most + 1)]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one for each part, with the given sum and the least cost. costs[i][t] for t >= 0."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, len(own)):
                at = (c + (own[t] if t >= 0 else 0.0), [*ts, t])
                if s + t not in nxt or at < nxt[s + t]:
                    nxt[s + t] = at
        best = nxt
    return best[total]


def gather(part: list[int]):
    """The bits of a part of column fp, as one long."""
    out = F.lit(0).cast("long")
    for k, b in enumerate(part):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def plan_parts(fps: DataFrame, limit: int = LIMIT) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds with the least expected number of candidates and probes."""
    n, both = bit_counts(fps)
    options = {m: deal_bits(n, both, m) for m in PARTS if m <= limit + 1}
    same = {}
    if n:
        # exact collisions of every part considered, from one pass of counts
        keyed = fps.select(
            F.explode(F.array(*[F.struct(F.lit(f"{m}.{i}").alias("k"), gather(p).alias("v")) for m, ps in options.items() for i, p in enumerate(ps)])).alias("x")
        )
        pairs = keyed.groupBy("x.k", "x.v").count().groupBy("k").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("c"))
        same = {r["k"]: r["c"] for r in pairs.collect()}
    best = None
    for m, parts in options.items():
        costs = []
        for i, part in enumerate(parts):
            own = expected(n, both, part, limit - m + 1 if limit - m + 1 > 0 else 0)
            exact = float(same.get(f"{m}.{i}", 0))
            probes = np.cumsum([len(list(combinations(range(len(part)), t))) if t <= 2 else 1e6 for t in range(len(own))])
            # a probe row costs about as much as eight comparisons
            costs.append([max(c, exact) - own[0] + exact + 8.0 * max(n, 1) * float(probes[t]) for t, c in enumerate(own)])
        got = allocate(costs, limit - m + 1)
        if best is None or got[0] < best[0]:
            best = (got[0], parts, got[1])
    return best[1], best[2]


def search(x: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """Links (positions) that span the groups of x under distances up to limit: breadth first over those not yet
    reached, so a dense group costs about one pass."""
    a: list[int] = []
    b: list[int] = []
    rest = np.arange(len(x))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            near = np.bitwise_count(x[rest] ^ x[u]) <= limit
            if near.any():
                got = rest[near].tolist()
                rest = rest[~near]
                a += [u] * len(got)
                b += got
                queue += got
    return a, b


def bucket_links(limit: int):
    """For rows (key, fp) sorted by key: the spanning links of every bucket. A bucket may span batches."""

    def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(edges, len(key)))
        u = fp.view(np.uint64)
        small = np.repeat(size <= 16, size)
        a, b = [], []
        for k in range(1, 16):  # small buckets: all of them at once, one shift after the other
            if len(key) <= k or not (size[size <= 16] > k).any():
                break
            hit = np.flatnonzero((key[k:] == key[:-k]) & small[k:] & (np.bitwise_count(u[k:] ^ u[:-k]) <= limit))
            a.append(fp[hit])
            b.append(fp[hit + k])
        for s, n in zip(edges[size > 16].tolist(), size[size > 16].tolist()):
            own = fp[s : s + n]
            i, j = search(own.view(np.uint64), limit)
            a.append(own[i])
            b.append(own[j])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        fps: list[np.ndarray] = []

        def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = links(key, fp)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["fa", "fb"])

        for batch in batches:
            key, fp = (np.array(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in (0, 1))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1])) if (np.diff(key) >= 0).all() else int(np.flatnonzero(key != key[-1])[-1] + 1)
            if keys and (last or key[0] != keys[0][0]):
                done = key[:last]
                yield out(np.concatenate([*keys, done]), np.concatenate([*fps, fp[:last]]))
                keys, fps = [key[last:]], [fp[last:]]
            elif keys:
                keys.append(key)
                fps.append(fp)
            else:
                if last:
                    yield out(key[:last], fp[:last])
                keys, fps = [key[last:]], [fp[last:]]
        if keys:
            yield out(np.concatenate(keys), np.concatenate(fps))

    return scan


def near_links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (fa, fb) between distinct fingerprints: they span every group that distances up to the limit link."""
    parts, thresholds = plan_parts(fps, limit)
    held = fps.select("fp", *[gather(part).alias(f"v{i}") for i, part in enumerate(parts)])

    def probed(i: int, part: list[int], t: int):
        masks = F.array(*[F.lit(sum(1 << k for k in c)).cast("long") for d in range(t + 1) for c in combinations(range(len(part)), d)])
        return F.transform(masks, lambda x: F.struct(F.lit(i).alias("i"), F.col(f"v{i}").bitwiseXOR(x).alias("v")))

    probes = F.concat(*[probed(i, part, t) for i, (part, t) in enumerate(zip(parts, thresholds)) if t >= 0])
    filed = held.select("fp", F.explode(probes).alias("x")).select("fp", F.col("x.i").alias("i"), F.col("x.v").alias("v"))
    blocks = filed.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    placed = (
        filed.join(blocks.withColumn("k", F.ceil(F.col("n") / BLOCK).cast("int")), ["i", "v"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select(F.xxhash64("i", "v", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    )
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(bucket_links(limit), "fa long, fb long").distinct()


def simhash_groups(docs: DataFrame, limit: int = LIMIT, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    own = cut(fingerprints(docs, words))
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    links = near_links(fps, limit)
    comps = connected_components(links.select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    of = fps.join(comps, fps["fp"] == comps["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    named = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = of.join(named, "root").select("fp", "component_id")
    return own.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


class Codes(dict):
    """The XXH64 of words; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 200_000:
            self.clear()
        got = self[word] = xxh64_intdigest(word)
        return got


def shingle_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each shingle of `size` words, given the words' codes; fewer words are one shingle, none too."""
    n = min(size, len(codes))
    h = np.full(max(1, len(codes) - size + 1), n, np.uint64)
    for k in range(n):
        h = (h ^ codes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def codes_of(text: bytes, known: Codes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), "<u8", len(words))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), CHUNK):
        counts += np.unpackbits(h[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of shingles that are frequent in one of SOME documents. They only put shingles in
    order: whatever the order, a prefix filter finds the same pairs, and it proposes fewer others with common ones last."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codes()
        for b in batches:
            sets = [np.unique(shingle_hashes(codes_of(t, known), size)) for t in text_bytes(b.column(0))]
            key, n = np.unique(np.concatenate([np.zeros(0, "<u8"), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view("<i8")), pa.array(n)], names=["key", "count"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SOME)) == 0).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = some.mapInArrow(scan, "key long, count long").groupBy("key").agg(F.sum("count").alias("count")).filter("count > 2")
    got = most_frequent(cut(counts), "count", COMMON).toArrow()
    key = got.column("key").to_numpy().astype("<i8").view("<u8")
    at = np.argsort(key)
    return key[at], got.column("count").to_numpy()[at]


def sketch(s: np.ndarray) -> np.ndarray:
    """For each of a power of two of hash values, as bits of longs, whether an odd number of the shingles has it. Two texts' bits
    differ in no more places than their sets do. There are more values than shingles, so long texts are told apart too."""
    values = 64 * SKETCH << max(0, (len(s) // (48 * SKETCH)).bit_length())
    return np.packbits(np.bincount((s & np.uint64(values - 1)).astype(np.intp), minlength=values) & 1, bitorder="little").view("<u8")


def folded(bits: np.ndarray, longs: int) -> np.ndarray:
    """A sketch of fewer values: those that agree modulo the fewer are one."""
    return bits if len(bits) == longs else np.bitwise_xor.reduce(bits.reshape(-1, longs))


def profiles(docs: DataFrame, words: int, size: int, least: float) -> DataFrame:
    """One row per document from one pass over its text: doc_id, fp (the SimHash of its shingles of `words` words), and of
    its different shingles of `size` words: n, how many; bits, for each of 64 * SKETCH hash values, as longs, whether an odd
    number of them has it (two texts' bits differ in no more places than their sets do); keys, the first
    n - ceil(least * n) + 1 in one order for all texts (two texts with `least` in common have one of these in common)."""
    common = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, size))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = common.value
        known = Codes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                fps, many, odd, keys = [], [], [], []
                for text in text_bytes(b.column(1)):
                    codes = codes_of(text, known)
                    fps.append(majority(shingle_hashes(codes, words)) if len(codes) else 0)
                    s = np.unique(shingle_hashes(codes, size))
                    many.append(len(s))
                    odd.append(sketch(s).view("<i8"))
                    if len(frequent):
                        place = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        s = s[np.argsort(np.where(frequent[place] == s, counts[place], 0), kind="stable")]
                    keys.append(s[: len(s) - math.ceil(least * len(s) - 1e-9) + 1].view("<i8"))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.array(fps, "<u8").view("<i8")), pa.array(many, pa.int32()), pa.array(odd, longs), pa.array(keys, longs)],
                    names=["doc_id", "fp", "n", "bits", "keys"],
                )

    kept = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return kept.mapInArrow(scan, "doc_id long, fp long, n int, bits array<long>, keys array<long>")


def filed_under(prof: DataFrame) -> DataFrame:
    """(key, doc_id) for the keys that another document has too."""
    n = int(prof.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = prof.select(F.explode("keys").alias("key"), "doc_id").repartition(n, "key").sortWithinPartitions("key")
    return filed.mapInArrow(shared_keys, "key long, doc_id long")


def shared_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, doc_id) sorted by key: those whose key another row has."""
    held = None  # the last row seen, and whether it has been told apart from the row before it

    def out(key: np.ndarray, own: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(own[some])], names=["key", "doc_id"])

    for b in batches:
        key, own = (np.array(b.column(c).to_numpy(), np.int64) for c in (0, 1))
        if not len(key):
            continue
        before = False
        if held is not None:
            key, own, before = np.append(held[0], key), np.append(held[1], own), held[2]
        same = key[1:] == key[:-1]
        some = np.append(before, same) | np.append(same, False)
        held = key[-1], own[-1], bool(some[-1])
        yield out(key[:-1], own[:-1], some[:-1])
    if held is not None:
        yield out(np.array([held[0]]), np.array([held[1]]), np.array([held[2]]))


def may_share(n_a, n_b, apart, least: float):
    """Whether sets of n_a and n_b members, `apart` places of their sketches differing, can share `least` of all:
    |A ^ B| <= (|A| + |B|) * (1 - least) / (1 + least), and the smaller is `least` of the larger."""
    return (apart <= (n_a + n_b) * ((1 - least) / (1 + least)) + 1e-6), (n_a >= least * n_b - 1e-6), (n_b >= least * n_a - 1e-6)


def member_bits(ids: DataFrame) -> np.ndarray:
    """The slots of ids, as a table of 2**SLOT_BITS bits whatever their number: 8 MB at most go to the driver."""
    slot = slot_of("doc_id") + 1  # the functions count from 1
    made = ids.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m"))
    table = np.zeros((1 << SLOT_BITS) // 8, np.uint8)
    for r in made.toLocalIterator():
        table[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return table


def slot_of(col: str):
    return F.pmod(F.xxhash64(col), F.lit(1 << SLOT_BITS))


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, s): the different hashes of a text's shingles, as array<long>, for the ids and few others: no text moves."""
    table = docs.sparkSession.sparkContext.broadcast(member_bits(ids))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codes()
        for b in batches:
            slot = b.column(1).to_numpy()
            some = pa.array((table.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).cast(pa.bool_())
            own = b.filter(some)
            out = [np.unique(shingle_hashes(codes_of(text, known), size)).view("<i8") for text in text_bytes(own.column(2))]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "s"])

    kept = docs.select("doc_id", slot_of("doc_id").alias("slot"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return kept.mapInArrow(scan, "doc_id long, s array<long>")


def compared(least: float):
    """For rows (a, part, b, s) sorted by a, part and b, the first of each (a, part) being a's own set (b is null):
    the pairs (a, b) that share `least` of their sets. One set is held at a time."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.int64)
        for batch in batches:
            a, b = [], []
            sets = batch.column(3)
            for k, (x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                s = sets[k].values.to_numpy()
                if y is None:
                    own = s
                    continue
                shared = len(np.intersect1d(own, s, assume_unique=True))
                if shared >= least * (len(own) + len(s) - shared) - 1e-9:
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return scan


def alike(pairs: DataFrame, docs: DataFrame, prof: DataFrame, size: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts share `least` of their `size`-word shingles. Sets of which the sketches
    show that they differ by too much aren't made. A set goes to its pairs' tasks once for each partner it isn't the hub of."""
    one, two = (prof.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
    sized = (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-6)
    both = pairs.join(one, "a").join(two.select("b", "nb", "bitsb"), "b").filter(sized).select("a", "b", "na", "nb", "bitsa", "bitsb")
    pairs = cut(both.mapInArrow(possible(least), "a long, b long"))
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    sets = cut(shingle_sets(docs, ends, size))
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("k"))
    part = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part")
    own = hubs.join(sets, hubs["a"] == sets["doc_id"]).select("a", part, F.lit(None).cast("long").alias("b"), "s")
    placed = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("part"), "b")
    others = placed.join(sets, placed["b"] == sets["doc_id"]).select("a", "part", "b", "s")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(others).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return cut(dealt.mapInArrow(compared(least), "a long, b long"))


def possible(least: float):
    """Of rows (a, b, n of both, sketches of both): the pairs that can share `least`."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                x, y = x.values.to_numpy().view("<u8"), y.values.to_numpy().view("<u8")
                longs = min(len(x), len(y))
                keep.append(all(may_share(m, n, int(np.bitwise_count(folded(x, longs) ^ folded(y, longs)).sum()), least)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return scan


def block_pairs(least: float):
    """For rows (block, doc_id, component, n, bits, key, keys) sorted by block: the pairs (a, b) of one block and different
    components that their sketches leave possible; a pair with several keys in common in the first of them only, unless one
    has too many keys to list. A block has at most twice NEAR_BLOCK rows."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            ids, comp, n, bits, key = (np.concatenate(c) for c in zip(*(h[:5] for h in held)))
            keys = [k for h in held for k in h[5]]
            found: list[tuple[int, int]] = []
            for i in range(len(ids) - 1):
                apart = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(1, dtype=np.int64)
                x, y, z = may_share(n[i], n[i + 1 :], apart, least)
                near = np.flatnonzero(x & y & z & (comp[i + 1 :] != comp[i])) + i + 1
                for j in near.tolist():
                    one, two = keys[i], keys[j]
                    if ids[i] != ids[j] and (not len(one) or not len(two) or np.intersect1d(one, two, assume_unique=True)[0] == key[i]):
                        found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
            a, b = zip(*set(found)) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array([int(x) for x in a], pa.int64()), pa.array([int(x) for x in b], pa.int64())], names=["a", "b"])

        last = None
        for batch in batches:
            key, ids, comp, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            if not len(key):
                continue
            own, lists = batch.column(5).to_numpy(), batch.column(6)
            bits = np.stack([folded(x.values.to_numpy().view("<u8"), SKETCH) for x in batch.column(4)])
            edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if held and key[x] != last:
                    yield out()
                    held = []
                last = key[x]
                held.append([ids[x:y], comp[x:y], n[x:y].astype(np.int64), bits[x:y], own[x:y], [k.values.to_numpy() for k in lists[x:y]]])
        if held:
            yield out()

    return scan


def labelled(ids: DataFrame, links: DataFrame) -> DataFrame:
    """ids (doc_id), links (a, b) -> doc_id, component_id: the smallest doc_id linked."""
    comps = connected_components(links)
    return ids.join(comps, ids["doc_id"] == comps["node"], "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component_id")
    )


def apart_pairs(rows: DataFrame, prof: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of rows (key, doc_id, component) with one key and different components. In keys of up to CROWD rows
    all such pairs; in others those that the sketches leave possible, by comparing blocks of BLOCK rows in place."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    few = rows.join(sizes.filter(F.col("m") <= CROWD).select("key"), "key")
    one, two = (few.select("key", F.col("doc_id").alias(x), F.col("component_id").alias(f"c{x}")) for x in "ab")
    pairs = one.join(two, "key").filter("a < b and ca <> cb").select("a", "b")
    k = F.ceil(F.col("m") / NEAR_BLOCK).cast("int")
    many = rows.join(sizes.filter(F.col("m") > CROWD).select("key", k.alias("k")), "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))
    placed = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "doc_id", "component_id", "key"
    )
    # the keys of a document, to tell in which of them a pair is made; none if they are too many
    lists = many.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.sort_array(F.collect_list("key")).alias("keys"))
    lists = lists.select("doc_id", F.when(F.col("c") <= LISTED, F.col("keys")).otherwise(F.array().cast("array<long>")).alias("keys"))
    signs = prof.select("doc_id", "n", "bits").join(lists, "doc_id")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.join(signs, "doc_id").select("block", "doc_id", "component_id", "n", "bits", "key", "keys").repartition(n, "block").sortWithinPartitions("block")
    return pairs.unionByName(dealt.mapInArrow(block_pairs(least), "a long, b long")).distinct()


def stars(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b), in every key of over CROWD rows (key, doc_id, component_id), of PIVOTS << turn of its documents with all
    others of another component. A document's hash is the same in all keys, so a group has few pivots in all its keys."""
    who = F.struct("doc_id", "component_id")
    pivots = [F.min(F.struct(F.xxhash64("doc_id", F.lit(turn), F.lit(k)).alias("h"), who.alias("w")))["w"] for k in range(PIVOTS << turn)]
    crowds = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.array_distinct(F.array(*pivots)).alias("pivots")).filter(F.col("m") > CROWD)
    pairs = rows.join(crowds, "key").select("doc_id", "component_id", F.explode("pivots").alias("p")).filter("component_id <> p.component_id")
    return pairs.select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b")).distinct()


def all_links(filed: DataFrame, links: DataFrame, prof: DataFrame, least: float, verify) -> DataFrame:
    """Links (a, b) whose components are those of all pairs that verify() keeps, of the links given and of the rows of
    filed (key, doc_id) with a key in common. First the links, and in crowded keys the pairs of some pivots with the others.
    While the pairs that are left between components of crowded keys are many more than rows, and get fewer, twice as many
    pivots follow, so that a large group whose members are barely alike is one component before its pairs are made; then every pair that is
    still apart."""
    plain = filed.withColumn("component_id", F.col("doc_id"))
    first = stars(plain, 0).unionByName(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    links, before = verify(first.distinct()), None
    for turn in range(1, TURNS + 1):
        named = filed.join(cut(labelled(prof.select("doc_id"), links)), "doc_id")
        parts = named.groupBy("key", "component_id").agg(F.count(F.lit(1)).alias("c"))
        sizes = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("own")).filter("parts > 1")
        rows = cut(named.join(sizes.select("key", "m", "own"), "key").select("key", "doc_id", "component_id", "m", "own"))
        # each row carries its key's share of the pairs between components
        apart = F.when(F.col("m") > CROWD, (F.col("m") * F.col("m") - F.col("own")) / F.col("m") / 2).otherwise(0.0)
        left = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(apart).alias("pairs")).first()
        rows = rows.select("key", "doc_id", "component_id")
        now = left["pairs"] or 0.0
        if turn == TURNS or now <= FEW * max(left["rows"], 1) or before is not None and now > (1 - WORTH) * before:
            return links.unionByName(verify(apart_pairs(rows, prof, least)))
        links, before = links.unionByName(verify(stars(rows, turn))), now
    return links


def near_duplicates(docs: DataFrame, limit: int = 7, words: int = 2, size: int = 5, least: float = 0.8) -> DataFrame:
    """docs (doc_id unique, text) -> doc_id, component_id: fingerprints of `words`-word shingles within `limit` bits
    propose links, and only those stay whose texts share `least` of their `size`-word shingles (Jaccard). They save
    comparisons in dense groups; a prefix filter then proposes all pairs that can share so much, and those are compared
    that are still apart. So every pair with `least` in common is in one component."""
    prof = stored(profiles(docs, words, size, least), "profiles")
    own = prof.select("doc_id", "fp")
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = near_links(fps.select("fp"), limit)
    far = links.join(fps.select(F.col("fp").alias("fa"), F.col("rep").alias("a")), "fa").join(
        fps.select(F.col("fp").alias("fb"), F.col("rep").alias("b")), "fb"
    )
    same = own.join(fps, "fp").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    def verify(pairs: DataFrame) -> DataFrame:
        return alike(pairs, docs, prof, size, least)

    found = all_links(cut(filed_under(prof)), far.select("a", "b").unionByName(same), prof, least, verify)
    return labelled(own.select("doc_id"), found)
