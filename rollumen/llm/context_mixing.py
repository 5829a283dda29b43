"""Language-model scoring by online logistic context mixing.

Texts are bytes (A-Z in lower case) and an end mark, byte 255, which UTF-8 never has. A byte is coded as its bits in a
Huffman code of the training bytes, so the product of the bits' probabilities is a distribution over texts. Five
predictors count the bits seen in hashed contexts: the last one, two, three and four bytes, and the current word's
bytes so far, each with the node of the code. Their log-odds are combined by weights from a set that a gate picks by how
much the longer contexts have been seen. A task goes through its texts block by block: it counts a block, and then
predicts some of a block's bits, with the bits' own counts taken out, and moves the weights before it goes on
to the next ones. An adaptive map refines each probability, by the depth of the node and the gate, from what followed
such predictions. Tasks' counters and maps are summed, and their weights averaged by what they saw; scoring uses the sums
over all tasks.

Two scans learn (tokens and bytes; contexts, weights and maps) and one scores. All cover every training text. What goes to the driver and out again has a fixed size: SLOTS counters, the maps, and HEAVY frequent tokens; other tokens are
looked up by a join. Equal contexts of a block are computed once, and equal tokens of a lot of texts are looked up once. A token is
named by its 64-bit XXH64.

Nulls: a null text is the empty one (an end alone); a null id hashes as the empty text. Repeated rows count as often
as they come, and equal texts have equal scores. Texts of any length are read whole, in pieces of PIECE bytes. An empty
table gives no rows, and without training texts the score is that of untrained counters. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollumen.llm.common import crc32_text, cut, most_frequent, text_bytes

END, BEFORE, PIECE, BLOCK, PART = 255, 64, 1 << 20, 3 << 20, 3 << 18
#: log2 of the counters of each predictor; segments of counters that travel together; frequent tokens that are sent.
BITS = (16, 18, 20, 21, 23)
SEGMENT, HEAVY, MERGE = 16, 200_000, 64
#: bytes of texts whose words are looked up together; different words that a task holds; moves of the weights for a bit.
WORDS, HELD, TURNS = 1 << 21, 500_000, 16
BASES = np.cumsum([0, *(1 << b for b in BITS)])
SLOTS = int(BASES[-1])
PRIOR = 0.04
MIX, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
GATES, BUCKETS, DEPTHS, STEPS = 8 * 5, 33, 12, 32
INPUTS, LAST = len(BITS) + 1, len(BITS) - 1
MAP = DEPTHS * GATES * BUCKETS
CELLS = GATES * INPUTS + GATES + 2 * MAP

_WORDLIKE = np.array([48 <= c <= 57 or 97 <= c <= 122 or 128 <= c < 255 for c in range(256)])
_LOG = np.log(np.arange(1 << 16) + PRIOR).astype(np.float32)
_POWERS: list[np.ndarray] = []


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """depth[256], node[256, most], bit[256, most] of a Huffman code for all bytes; ties go to the smaller byte."""
    heap = [(int(c) + 1, k, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    new = 256
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y] = (new, 0), (new, 1)
        heapq.heappush(heap, (a + b, new, new))
        new += 1
    paths = []
    for c in range(256):
        path, at = [], c
        while at in up:
            at, bit = up[at]
            path.append((new - 1 - at, bit))  # the root is node 0
        paths.append(path[::-1])
    depth = np.array([len(p) for p in paths])
    node, bit = np.zeros((256, depth.max()), np.uint32), np.zeros((256, depth.max()), np.int8)
    for c, p in enumerate(paths):
        node[c, : len(p)], bit[c, : len(p)] = [x for x, _ in p], [b for _, b in p]
    return depth, node, bit


def powers(n: int) -> list[np.ndarray]:
    """Powers of MIX and of its inverse, for hashes of words at any place of a block."""
    if not _POWERS or len(_POWERS[0]) < n:
        back = np.uint64(pow(int(MIX), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.full(n, x, np.uint64), dtype=np.uint64) for x in (MIX, back)]
    return _POWERS


def pieces(texts: Iterable[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """(number of the text, bytes before, bytes to code): long texts in pieces, the last with the end mark."""
    for k, text in enumerate(texts):
        text = text.lower() + bytes([END])
        for a in range(0, len(text), PIECE):
            yield k, text[max(0, a - BEFORE) : a], text[a : a + PIECE]


def blocks(texts: Iterable[bytes]) -> Iterator[list[tuple[int, bytes, bytes]]]:
    return filled(pieces(texts), BLOCK)


def filled(some: Iterable[tuple[int, bytes, bytes]], most: int) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Runs of pieces, each as soon as it has that many bytes."""
    own, size = [], 0
    for p in some:
        own.append(p)
        size += len(p[1]) + len(p[2]) + 8
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


class Contexts:
    """A block's distinct (contexts, byte): code[u] is the byte, n[u] how often it stands there, base[-1][u] the word's
    context. Contexts of bytes alone are far fewer: low[u] is the one of u, low_code its byte, base[k] the contexts of the
    other predictors by low, low_n how often. A block is taken in parts of about PART bytes, each of which stays in the
    processor's caches; what is distinct in them is merged. parts: for each, the u of what is distinct in it, which of
    those each coded byte is, and the lengths of the pieces."""

    def __init__(self, block: list[tuple[int, bytes, bytes]], inverse: bool) -> None:
        found = [self.part(own, inverse) for own in filled(block, PART)]
        key, code, x, word, many = (np.concatenate([f[k] for f in found]) for k in range(5))
        first, of, _ = distinct(key, True)
        self.n = np.bincount(of, many, len(first)).astype(np.int64)
        ends = np.cumsum([len(f[0]) for f in found])
        self.parts = [(of[e - len(f[0]) : e], f[5], f[6]) for e, f in zip(ends, found)] if inverse else []
        self.code, x, word = code[first], x[first], word[first]
        kept, self.low, _ = distinct(((x << np.uint64(8)) + self.code + np.uint64(1)) * ODD, True)
        self.low_n = np.bincount(self.low, self.n, len(kept)).astype(np.int64)
        self.low_code, x = self.code[kept], x[kept]
        hashed = [((x >> np.uint64(8 * (3 - k))) + np.uint64(k)) * ODD for k in (1, 2, 3)] + [word * ODD]
        self.base = [(x >> np.uint64(24)).astype(np.uint32), *((h >> np.uint64(32)).astype(np.uint32) for h in hashed)]

    @staticmethod
    def part(block: list[tuple[int, bytes, bytes]], inverse: bool) -> tuple:
        """Of what is distinct: key, byte, the last four bytes before it, the word's hash, how often; which of these each
        coded byte is; the lengths of the pieces."""
        buf = np.frombuffer(b"".join(x for _, before, data in block for x in (b"\0" * 8, before, data)), np.uint8)
        lengths = np.array([len(data) for _, _, data in block])
        lead = np.array([8 + len(before) for _, before, _ in block])
        ends = np.cumsum(lead + lengths)
        coded = np.zeros(len(buf), bool)
        for a, b in zip((ends - lengths).tolist(), ends.tolist()):
            coded[a:b] = True
        coded, n = coded[8:], len(buf)
        byte = buf[8:]
        # the last four bytes before each place, the latest one highest
        last4 = np.ndarray((n - 8,), "<u4", buf, 4, (1,)).astype(np.uint64)
        ahead, back = powers(n)
        run = (buf + np.uint64(1)) * ahead[:n]
        np.cumsum(run, out=run)
        stop = np.where(_WORDLIKE[buf], 0, np.arange(n, dtype=np.int32))
        np.maximum.accumulate(stop, out=stop)
        stop = stop[7 : n - 1]
        word = run[7 : n - 1] - run[stop]
        word *= back[stop]
        key = word * MIX
        key += last4
        key *= ODD
        key ^= key >> np.uint64(29)
        key += byte
        key *= MIX
        key = key[coded]
        first, of, many = distinct(key, inverse)
        at = np.flatnonzero(coded)[first]
        return key[first], byte[at], last4[at], word[at], many, of, lengths

    def sums(self, value: np.ndarray) -> np.ndarray:
        """The sum over each piece's bytes of values by u."""
        return np.concatenate([np.add.reduceat(value.take(u).take(of), np.append(0, np.cumsum(lengths)[:-1])) for u, of, lengths in self.parts])

    def slots(self, k: int, which: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Predictor k's counters for contexts at nodes of the code."""
        base = self.base[k].take(which)
        if k == 0:
            return (base << np.uint32(8) | node).astype(np.intp)
        h = base + node * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x9E3779B1)
        return (h >> np.uint32(32 - BITS[k])).astype(np.intp) + int(BASES[k])


def distinct(key: np.ndarray, inverse: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Place of one of each key, of which each place is, how often. By hashing, as a sort costs several times as much."""
    of, kept = pd.factorize(key)
    first = np.empty(len(kept), np.int32)
    first[of] = np.arange(len(of), dtype=np.int32)
    return first, of.astype(np.int32) if inverse else None, np.bincount(of, minlength=len(kept))


def levels(n: np.ndarray, most: int) -> np.ndarray:
    """0, 1, 2, 3 to 4, 5 to 8 and so on, up to most - 1."""
    return np.minimum(np.ceil(np.log2(np.maximum(n, 0.5))).astype(np.int64) + 1, most - 1)


_LEVEL8, _LEVEL5 = (levels(np.arange(1 << 12), m) for m in (8, 5))


def bit_rounds(c: Contexts, code: tuple, see) -> Iterator[tuple]:
    """For each depth: (which contexts, bits, inputs, gate). see(k, slots, bits) gives predictor k's log-odds and, for the
    two longest contexts, their part of the gate: how much they have been seen."""
    depth, node, bit = code
    deep, low_deep = depth[c.code], depth[c.low_code]
    place = np.zeros(len(c.low_code), np.int32)
    for d in range(int(deep.max(initial=0))):
        low = np.flatnonzero(low_deep > d)
        own = c.low_code[low]
        b, at = bit[own, d], node[own, d]
        odds = []
        for k in range(LAST):
            x, level = see(k, c.slots(k, low, at), b)
            odds.append(x)
        place[low] = np.arange(len(low), dtype=np.int32)
        which = np.flatnonzero(deep > d)
        of = place.take(c.low.take(which))
        b = b.take(of)
        x = np.empty((INPUTS, len(which)), np.float32)
        for k in range(LAST):
            odds[k].take(of, out=x[k], mode="clip")
        x[LAST], more = see(LAST, c.slots(LAST, which, at.take(of)), b)
        x[-1] = 0.3
        yield d, which, b, x, (level.take(of) + more).astype(np.int32)


def part_of_gate(k: int, n: np.ndarray) -> np.ndarray | None:
    """Of counts up to 4095."""
    return _LEVEL5.take(n) if k == LAST - 1 else _LEVEL8.take(n) * 5 if k == LAST else None


def counted(flat: np.ndarray):
    """see() over 2 * SLOTS counters, zeros before ones, with one of the coded bit taken out."""
    pairs = flat.view("<i8")

    def see(k: int, slot: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        v = pairs.take(slot, mode="clip")
        ones = np.minimum(v >> 32, 65535)
        zeros = np.minimum(v & 0xFFFFFFFF, 65535)
        ones -= b
        zeros -= 1 - b
        np.maximum(ones, 0, out=ones)
        np.maximum(zeros, 0, out=zeros)
        odds = _LOG.take(ones, mode="clip") - _LOG.take(zeros, mode="clip")
        return odds, part_of_gate(k, np.minimum(ones + zeros, 4095)) if k >= LAST - 1 else None

    return see


def tabled(counters: np.ndarray):
    """see() over SLOTS counters that don't change, with ones in the upper 16 bits: their log-odds and gates are worked out once."""
    odds, first = np.empty(SLOTS, np.float32), int(BASES[LAST - 1])
    gates = np.empty(SLOTS - first, np.int8)
    for a in range(0, SLOTS, 1 << 20):
        v = counters[a : a + (1 << 20)]
        odds[a : a + len(v)] = _LOG.take(v >> np.uint32(16)) - _LOG.take(v & np.uint32(0xFFFF))
    for k in (LAST - 1, LAST):
        v = counters[BASES[k] : BASES[k + 1]]
        gates[BASES[k] - first : BASES[k + 1] - first] = part_of_gate(k, np.minimum((v >> np.uint32(16)) + (v & np.uint32(0xFFFF)), 4095))

    def see(k: int, slot: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        return odds.take(slot, mode="clip"), gates.take(slot - first, mode="clip") if k >= LAST - 1 else None

    return see


def mixed(x: np.ndarray, gate: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-odds: each column of inputs by its gate's weights. w: GATES x INPUTS."""
    z = x[0] * w[:, 0].take(gate)
    for k in range(1, INPUTS):
        z += x[k] * w[:, k].take(gate)
    return z


def refine(z: np.ndarray, maps: np.ndarray, d: int, gate: np.ndarray) -> np.ndarray:
    """The mean of the mixed probability and what the adaptive map makes of it."""
    p = 1 / (1 + np.exp(-z))
    t = np.clip((z + 8) * 2, 0, BUCKETS - 1.001)
    k = t.astype(np.int64)
    f = t - k.astype(np.float32)
    row = (min(d, DEPTHS - 1) * GATES + gate) * BUCKETS + k
    low = maps.take(row)
    return (p + low + f * (maps.take(row + 1) - low)) / 2


class Model:
    def __init__(self, histogram: np.ndarray, counters: np.ndarray, weights: np.ndarray, maps: np.ndarray) -> None:
        self.code, self.see = huffman(histogram), tabled(counters)
        self.weights = weights.astype(np.float32)
        # the logarithm of what the map makes of each log-odds, in steps; of either bit, so that both add up to 1
        z, gates = (np.arange(16 * STEPS) + 0.5) / STEPS - 8, np.arange(GATES)
        p = np.stack([refine(np.tile(z, GATES), maps, d, np.repeat(gates, len(z))) for d in range(DEPTHS)])
        p = np.clip(p.ravel(), 1e-5, 1 - 1e-5)
        self.logs = np.stack([np.log1p(-p), np.log(p)], 1).astype(np.float32).ravel()

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text; equal texts are scored once."""
        first: dict[bytes, int] = {}
        of = [first.setdefault(t, len(first)) for t in texts]
        out = np.zeros(len(first))
        for block in blocks(first):
            c = Contexts(block, True)
            log = np.zeros(len(c.code))
            for d, which, b, x, gate in bit_rounds(c, self.code, self.see):
                z = mixed(x, gate, self.weights)
                z += 8
                z *= STEPS
                at = np.clip(z, 0, 16 * STEPS - 1, out=z).astype(np.int32)
                at += ((min(d, DEPTHS - 1) * GATES + gate) * (16 * STEPS)).astype(np.int32)
                at *= 2
                at += b
                log[which] += self.logs.take(at)
            np.add.at(out, [k for k, _, _ in block], c.sums(log) / np.log(10))
            del c  # not beside the next one
        return out[of]


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def train_part(docs: DataFrame) -> DataFrame:
    return texts_of(docs.filter(crc32_text() % 5 != 1)).select("text")


def lots(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The texts in lower case and in order, about WORDS bytes at a time."""
    own, size = [], 0
    for text in texts:
        own.append(text.lower())
        size += len(text) + 1
        if size >= WORDS:
            yield own
            own, size = [], 0
    if own:
        yield own


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the different words, which of them each word is, how many words each text has."""
    from xxhash import xxh64_intdigest

    words, per = [], []
    for text in texts:
        own = text.split()
        words += own
        per.append(len(own))
    of, names = pd.factorize(np.fromiter(map(xxh64_intdigest, words), "<u8", len(words)).view("<i8"))
    return names, of, np.array(per)


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its numbers."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def word_counts(some: Iterable[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names of words and how often they occur; a name comes again when more than HELD different ones have been."""
    held, size = [], 0
    for texts in some:
        names, of, _ = words_of(texts)
        held.append((names, np.bincount(of, minlength=len(names))))
        size += len(names)
        if size > 2 * HELD:
            held = [added(*map(np.concatenate, zip(*held)))]
            size = len(held[0][0])
            if size > HELD:
                yield held.pop()
                size = 0
    if held:
        yield added(*map(np.concatenate, zip(*held)))


def gather_tokens(train: DataFrame) -> DataFrame:
    """(kind, key, n): 0 for tokens by hash, 1 for bytes by value, 2 for texts."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram, texts = np.zeros(256, np.int64), np.zeros(1, np.int64)

        def watched() -> Iterator[list[bytes]]:
            for b in batches:
                for lot in lots(text_bytes(b.column(0))):
                    histogram[:] += np.bincount(np.frombuffer(b"".join(lot), np.uint8), minlength=256)
                    texts[:] += len(lot)
                    yield lot

        def row(keys: np.ndarray, n: np.ndarray, kind: int = 0) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])

        for keys, n in word_counts(watched()):
            yield row(keys, n)
        histogram[END] += texts[0]
        yield row(np.arange(256), histogram, 1)
        yield row(np.zeros(1, np.int64), texts, 2)

    return train.mapInArrow(scan, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _pack(own: np.ndarray) -> bytes:
    import zstandard

    at = np.flatnonzero(own.any(1))
    return zstandard.compress(np.uint32(len(at)).tobytes() + at.astype("<u2").tobytes() + own[at].astype("<u4").T.tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.frombuffer(raw, "<u2", n, 4).astype(np.int64), np.frombuffer(raw, "<u4", 2 * n, 4 + 2 * n).reshape(2, n).T


class Learner:
    """One task's counters, weights and maps."""

    def __init__(self, code: tuple) -> None:
        self.code = code
        self.flat = np.zeros(2 * SLOTS, np.int32)
        self.w, self.g2 = np.full((GATES, INPUTS), 0.3), np.full((GATES, INPUTS), 1e-4)
        self.seen, self.ones, self.total = np.zeros(GATES), np.zeros(MAP), np.zeros(MAP)
        self.counted: list[Contexts] = []

    def count(self, block: list[tuple[int, bytes, bytes]]) -> None:
        depth, node, bit = self.code
        c = Contexts(block, False)
        for codes, n, predictors in ((c.low_code, c.low_n, range(LAST)), (c.code, c.n, [LAST])):
            deep, many = depth[codes], n.astype(np.int32)
            for d in range(int(deep.max(initial=0))):
                which = np.flatnonzero(deep > d)
                own = codes[which]
                side, at, times = bit[own, d].astype(np.intp), node[own, d], many[which]
                for k in predictors:
                    np.add.at(self.flat, c.slots(k, which, at) * 2 + side, times)
        self.counted.append(c)

    def learn(self) -> None:
        """From the blocks counted since the last call."""
        held, self.counted = self.counted, []
        for c in held:
            for d, which, b, x, gate in bit_rounds(c, self.code, counted(self.flat)):
                n = c.n[which].astype(np.int32)
                # contexts come in the order of their first places: each turn has some of all, frequent ones and others
                turns = max(1, min(TURNS, len(which) >> 13))
                for a in range(turns):  # predict, then move the weights
                    xs, gs, ns = x[:, a::turns], gate[a::turns], n[a::turns]
                    p = 1 / (1 + np.exp(-mixed(xs, gs, self.w.astype(np.float32))))
                    miss = (b[a::turns] - p) * ns
                    many = np.bincount(gs, ns, GATES)
                    grad = np.stack([np.bincount(gs, miss * xs[k], GATES) for k in range(INPUTS)], 1) / np.maximum(many, 1)[:, None]
                    self.g2 += grad * grad
                    self.w += 0.05 * grad / np.sqrt(self.g2) * np.minimum(1, many / 1000)[:, None]
                    self.seen += many
                z = np.clip((mixed(x, gate, self.w.astype(np.float32)) + 8) * 2, 0, BUCKETS - 1)
                row = (min(d, DEPTHS - 1) * GATES + gate) * BUCKETS + np.rint(z).astype(np.int64)
                self.total += np.bincount(row, n, MAP)
                self.ones += np.bincount(row, n * b, MAP)

    def cells(self) -> np.ndarray:
        """All but the counters, as numbers that add up over tasks."""
        return np.concatenate([(self.w * self.seen[:, None]).ravel(), self.seen, self.ones, self.total])


def learn_contexts(train: DataFrame, code: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SLOTS counters (ones above zeros), weights and maps over all training texts. Segments of the tasks' counters are
    merged, MERGE tasks at a time, round after round; their other numbers are summed."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Learner(code)
        for b in batches:
            for block in blocks(text_bytes(b.column(0))):
                own.count(block)
                own.learn()
        part, pairs = TaskContext.get().partitionId(), own.flat.reshape(-1, 2)

        def row(segment: int, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["segment", "part", "data"])

        for s in range(-(-SLOTS >> SEGMENT)):
            if (some := pairs[s << SEGMENT : (s + 1) << SEGMENT]).any():
                yield row(s, _pack(some))
        yield row(-1, own.cells().tobytes())

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["segment"].iloc[0] < 0:
            cells = np.sum([np.frombuffer(x) for x in rows["data"]], 0)
            return pd.DataFrame({"segment": rows["segment"][:1], "part": rows["part"][:1] // MERGE, "data": [cells.tobytes()]})
        total = np.zeros((1 << SEGMENT, 2), np.int64)
        for data in rows["data"]:
            at, n = _unpack(data)
            total[at] += n
        return pd.DataFrame({"segment": rows["segment"][:1], "part": rows["part"][:1] // MERGE, "data": [_pack(np.minimum(total, 2**32 - 1))]})

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        out = merge(rows)
        if out["segment"].iloc[0] < 0:
            return out
        at, n = _unpack(out["data"].iloc[0])
        whole = np.zeros((1 << SEGMENT, 2), np.float64)
        whole[at] = n
        # counters of 16 bits: large ones keep their ratio, and what has been seen stays above 0
        small = np.minimum(1, 65535 / np.maximum(whole.max(1, keepdims=True), 1))
        out["data"] = [np.where(whole > 0, np.maximum(np.floor(whole * small), 1), 0).astype("<u2").tobytes()]
        return out

    schema = "segment int, part int, data binary"
    runs, n = train.mapInArrow(scan, schema), max(1, train.rdd.getNumPartitions())
    while n > MERGE:
        runs = runs.groupBy("segment", F.floor(F.col("part") / MERGE).alias("g")).applyInPandas(merge, schema)
        n = -(-n // MERGE)
    packed, cells = np.zeros(-(-SLOTS >> SEGMENT) << SEGMENT, np.uint32), np.zeros(CELLS)
    for r in runs.groupBy("segment").applyInPandas(last, schema).toLocalIterator():
        if r["segment"] < 0:
            cells = np.frombuffer(r["data"])
        else:
            pair = np.frombuffer(r["data"], "<u2").reshape(-1, 2)
            packed[r["segment"] << SEGMENT : (r["segment"] + 1) << SEGMENT] = pair[:, 0] | pair[:, 1].astype(np.uint32) << np.uint32(16)
    weighted, seen, ones, total = np.split(cells, np.cumsum([GATES * INPUTS, GATES, MAP]))
    seen = seen[:, None]
    w = np.where(seen > 0, weighted.reshape(GATES, INPUTS) / np.maximum(seen, 1), 0.3)
    return packed[:SLOTS], w, (ones + 20 * fresh_maps()) / (total + 20)


def fresh_maps() -> np.ndarray:
    return np.tile(1 / (1 + np.exp(-(np.arange(BUCKETS) / 2 - 8))), DEPTHS * GATES)


def mixing_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    train = train_part(docs)
    tokens = cut(gather_tokens(train))
    histogram, n_texts = np.zeros(256, np.int64), 0
    for r in tokens.filter("kind > 0").collect():
        if r["kind"] == 1:
            histogram[r["key"]] = r["n"]
        else:
            n_texts = r["n"]
    words = tokens.filter("kind = 0")
    sums = words.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
    n, v = (sums["n"] or 0) + n_texts, sums["v"] + (n_texts > 0)
    low = float(np.log10(n + 0.5 * (v + 1)))
    heavy = np.array(most_frequent(words, "n", HEAVY).select("key", "n").collect(), np.int64).reshape(-1, 2)
    heavy = heavy[np.argsort(heavy[:, 0])]
    code = huffman(histogram)
    counters, weights, maps = learn_contexts(train, code)
    shared = spark.sparkContext.broadcast(counters)
    del counters
    # no logarithm behind the last one, where a search for other names may end
    frequent = spark.sparkContext.broadcast((heavy[:, 0], np.append(np.log10(heavy[:, 1] + 0.5), np.nan)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = float(np.log10(n_texts + 0.5))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (known, logs) = Model(histogram, shared.value, weights, maps), frequent.value
        padded = np.append(known, 0)

        def based(lot: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """For each text: words, frequent ones, their logarithms' sum; the names of all others."""
            names, of, per = words_of(lot)
            at = np.searchsorted(known, names)
            at[padded.take(at) != names] = len(known)
            log = logs.take(at).take(of)
            odd, own = np.isnan(log), np.repeat(np.arange(len(lot)), per)
            log[odd] = 0
            return per, per - np.bincount(own[odd], minlength=len(lot)), np.bincount(own, log, len(lot)), names.take(of[odd])

        for b in batches:
            texts = list(text_bytes(b.column(2)))
            empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            many, common, base, rare = (np.concatenate(x) for x in zip(empty, *map(based, lots(texts))))
            rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many - common)), pa.int32()), pa.array(rare))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(many + 1), pa.array(common + (n_texts > 0)), pa.array(base + end), rare, pa.array(model.scores(texts))],
                names=["row", "doc_id", "n_tokens", "common", "base", "rare", "score"],
            )

    rows = texts_of(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scored = cut(rows.mapInArrow(scan, f"row long, doc_id {kind}, n_tokens long, common long, base double, rare array<long>, score double"))
    odd = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("m"))
    found = odd.join(words.select("key", "n"), "key", "left").groupBy("row").agg(
        F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("also"),
    )
    return scored.join(found, "row", "left").select(
        "doc_id",
        (crc32_text() % 5 == 1).alias("held_out"),
        "n_tokens",
        (F.col("common") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(low)).alias("base_score"),
        "score",
    )
