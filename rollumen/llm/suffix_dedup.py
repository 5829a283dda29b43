"""Exact repeats of 400 bytes, by column-wise construction of a transform over many strings.

Every window of WIDTH bytes has an anchor: its leftmost GRAM of the lowest hash. Equal windows have equal anchors at
equal places, so a run of windows with one anchor (a segment, of 2 * WIDTH - GRAM bytes at most) needs only be compared
with the segments of equal anchors, aligned at them. Anchors that occur once in the collection are dropped by their
hash before any text moves. Texts that are equal are one text, and segments that are equal one segment, before they meet.

The segments of a task are then inserted together, one symbol of each in a round, from the last column to the first.
A round takes the order of the suffixes that start in the column after it, sorts it stably by the new symbols (which are
the transform's column), and carries the lengths of common prefixes of neighbours over: 1 + the least length between
two suffixes of one symbol, 0 at a change of symbol. The segments come from a table in the shared folder, sorted by key, in
lots of about TOGETHER; a task holds one lot's columns, an order, the lengths and the repeats. Only suffixes of one
column are merged: by the alignment no others can be equal for WIDTH bytes, and a full merge of all rounds would rewrite
the whole transform in each.

An anchor of over CROWD different segments is no group for one task: its windows are named by 128-bit hashes and counted.

Beside the 400 bytes, passages of over 50 words are told: windows of WORDS words that another text has too are found by the
same anchors, over words, and by the windows' names. They are only counted (n_passage_words); nothing is removed for them.

Nulls: a null text is the empty one, without repeats. A null id stays null. Texts of any length are read whole. Rows of
equal text (ties and repeated rows, too) have equal results; from WIDTH bytes up all of such a text is removed. An empty
table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollumen.llm.common import cut, stored, text_bytes

WIDTH, GRAM, CROWD, TOGETHER = 400, 32, 20_000, 50_000
#: Words of a passage, and of its anchors.
WORDS, WORD_GRAM = 51, 8
#: log2 of the places that windows of words are cut at, and of the bytes that are worked on at once.
SPAN_BITS, ROOM_BITS = 20, 16
SPACE = re.compile(rb"[\x20\x09-\x0D]")
_INWORD = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of MIX and of its inverse, n of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        back = np.uint64(pow(int(MIX), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.full(max(n, 2 << ROOM_BITS), x, np.uint64), dtype=np.uint64) for x in (MIX, back)]
    return _POWERS


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram that starts at each place."""
    n = len(buf)
    ahead, back = powers(n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(ahead[:n] * (buf + np.uint64(1)), dtype=np.uint64, out=run[1:])
    h = (run[gram:] - run[:-gram]) * back[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h * MIX


def anchors(buf: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: the place of its anchor; and the hash of the gram at each place."""
    h = gram_hashes(buf, gram)
    low = np.uint64((1 << SPAN_BITS) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    have, need = 1, width - gram + 1
    while have * 2 <= need:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if need > have:
        m = np.minimum(m[: len(m) - (need - have)], m[need - have :])
    return (m & low).astype(np.int64), h


def spans(texts: list[bytes], width: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lots of (text, where it starts there, bytes) of up to 2**ROOM_BITS bytes; pieces of a long text overlap so that
    each window lies in one of them."""
    room, own, size = 1 << ROOM_BITS, [], 0
    for k, text in enumerate(texts):
        a = 0
        while len(text) - a >= width:
            part = text[a : a + room]
            if size + len(part) > room and own:
                yield own
                own, size = [], 0
            own.append((k, a, part))
            size += len(part)
            if a + len(part) >= len(text):
                break
            a += room - width + 1
    if own:
        yield own


def segments_of(texts: list[bytes], width: int, gram: int) -> list[np.ndarray]:
    """text, anchor hash, first window, number of windows, anchor's distance from the first window: by segment."""
    out = []
    for lot in spans(texts, width):
        buf = np.frombuffer(b"".join(part for _, _, part in lot), np.uint8)
        size = np.array([len(part) for _, _, part in lot])
        starts = np.cumsum(size) - size
        p, h = anchors(buf, width, gram)
        mark = np.zeros(len(buf) + 1, np.int8)
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + size - width + 1, -1)
        at = np.flatnonzero(np.cumsum(mark, dtype=np.int8)[: len(p)])
        p = p[at]
        first = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(p) != 0)))
        n = np.diff(np.append(first, len(at)))
        piece = np.searchsorted(starts, at[first], side="right") - 1
        where = np.array([a for _, a, _ in lot])[piece] + at[first] - starts[piece]
        out.append(np.stack([np.array([k for k, _, _ in lot])[piece], h[p[first]].view(np.int64), where, n, p[first] - at[first]]))
    return list(np.concatenate(out, 1)) if out else [np.zeros(0, np.int64)] * 5


def word_lots(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Lots of (text, bytes) of about 2**ROOM_BITS bytes; long texts are cut at white space."""
    room, own, size = 1 << ROOM_BITS, [], 0
    for k, text in enumerate(texts):
        a = 0
        while a < len(text):
            b = len(text)
            if b - a > room:
                space = SPACE.search(text, a + room)
                b = space.start() if space else b
            own.append((k, text[a:b]))
            size += b - a
            a = b
            if size >= room:
                yield own
                own, size = [], 0
    if own:
        yield own


def word_codes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text a 64-bit code of each of its words."""
    codes, many = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for lot in word_lots(texts):
        buf = np.frombuffer(b" ".join([b"", *(x for _, x in lot), b""]), np.uint8)
        inside = np.diff(np.concatenate([[0], _INWORD[buf], [0]]).astype(np.int8))
        first, last = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
        ahead, back = powers(len(buf))
        run = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(ahead[: len(buf)] * (buf + np.uint64(1)), dtype=np.uint64, out=run[1:])
        h = (run[last] - run[first]) * back[first]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        codes.append(h ^ h >> np.uint64(29))
        ends = np.cumsum([1 + len(x) for _, x in lot])
        np.add.at(many, [k for k, _ in lot], np.diff(np.searchsorted(first, ends), prepend=0))
    return np.split(np.concatenate(codes), np.cumsum(many)[:-1]) if texts else []


def named_windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit name of each run of `size` codes."""
    h = np.zeros(max(0, len(codes) - size + 1), np.uint64)
    for k in range(size if len(h) else 0):
        h = (h ^ codes[k : k + len(h)]) * MIX
        h ^= h >> np.uint64(32)
    return h


def word_segments(codes: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each run of windows of `words` words with one anchor."""
    if len(codes) < words:
        return (np.zeros(0, np.int64),) * 3
    h = named_windows(codes, gram)
    place = np.uint64((1 << SPAN_BITS) - 1)
    out = []
    for a in range(0, len(codes) - words + 1, 1 << (SPAN_BITS - 1)):
        own = h[a : a + (1 << (SPAN_BITS - 1)) + words - gram]
        m = (own & ~place) | np.arange(len(own), dtype=np.uint64)
        have, need = 1, words - gram + 1
        while have * 2 <= need:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if need > have:
            m = np.minimum(m[: len(m) - (need - have)], m[need - have :])
        p = (m & place).astype(np.int64)
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        out.append((own[p[first]].view(np.int64), first + a, np.diff(np.append(first, len(p)))))
    return tuple(np.concatenate(c) for c in zip(*out))


def scan_texts(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """doc_id, uid (the text's name), n_bytes, sha, n_words, its segments of windows of bytes: seg
    array<struct<h, a, n, d>>, and of windows of words: wseg array<struct<h, a, n>>."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                texts = list(text_bytes(b.column(1)))
                codes = word_codes(texts)
                runs = [word_segments(c, WORDS, WORD_GRAM) for c in codes]
                ends = pa.array(np.cumsum([0, *(len(h) for h, _, _ in runs)]), pa.int32())
                cells = [np.concatenate([np.zeros(0, np.int64), *c]).astype(t) for c, t in zip(zip(*runs), (np.int64, np.int32, np.int32))]
                wseg = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c) for c in cells], names=["h", "a", "n"]))
                n_words = pa.array([len(c) for c in codes], pa.int64())
                sha = [hashlib.sha256(t).hexdigest() for t in texts]
                owner, *cells = segments_of(texts, width, gram)
                order = np.argsort(owner, kind="stable")
                offsets = pa.array(np.searchsorted(owner[order], np.arange(len(texts) + 1)), pa.int32())
                seg = pa.StructArray.from_arrays([pa.array(c[order].astype(t)) for c, t in zip(cells, (np.int64, np.int64, np.int32, np.int32))], names=["h", "a", "n", "d"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([s[:32] for s in sha]), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), n_words, pa.ListArray.from_arrays(offsets, seg), wseg],
                    names=["doc_id", "uid", "n_bytes", "sha", "n_words", "seg", "wseg"],
                )

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    segments = "seg array<struct<h: long, a: long, n: int, d: int>>, wseg array<struct<h: long, a: int, n: int>>"
    return rows.mapInArrow(scan, f"doc_id {kind}, uid string, n_bytes long, sha string, n_words long, {segments}")


def cut_segments(with_text: DataFrame, width: int) -> DataFrame:
    """(uid, text, seg) -> a row for each segment: key, name, uid, a, n, d, data. Equal names: equal bytes and place."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                b = whole.slice(k, 200)
                rows: list[list] = [[], [], [], [], [], [], []]
                for uid, text, seg in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist()):
                    for s in seg:
                        data = text[s["a"] : s["a"] + s["n"] - 1 + width]
                        name = xxh3_128_digest(data, s["d"])
                        for cell, v in zip(rows, (s["h"], name, uid, s["a"], s["n"], s["d"], data)):
                            cell.append(v)
                kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["key", "name", "uid", "a", "n", "d", "data"])

    return with_text.select("uid", "text", "seg").mapInArrow(scan, "key long, name binary, uid string, a long, n int, d int, data binary")


def counted_windows(crowded: DataFrame, width: int) -> DataFrame:
    """Different segments (key, name, d, data) -> name, ranges: their windows that another one has at the same distance from the
    anchor, by counts of the windows' names; a window of many segments is one row of each task before it moves."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                b = whole.slice(k, 200)
                rows: list[list] = [[], [], []]
                for key, name, d, data in zip(*(b.column(c).to_pylist() for c in range(4))):
                    for at in range(len(data) - width + 1):
                        for cell, v in zip(rows, (xxh3_128_digest(data[at : at + width], (key & (2**32 - 1)) << 16 | d - at + width), name, at)):
                            cell.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.binary(), pa.binary(), pa.int32()))], names=["window", "name", "at"])

    windows = crowded.select("key", "name", "d", "data").mapInArrow(scan, "window binary, name binary, at int")
    common = cut(windows.groupBy("window").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("window"))
    return windows.join(common, "window").select("name", F.array(F.col("at"), F.col("at") + 1).alias("ranges"))


def repeats(segments: list[tuple[int, bytes]], width: int) -> np.ndarray:
    """For segments (distance of the anchor, bytes): which windows (columns from the anchor's farthest) equal a window
    of another segment at the same distance. Rows: columns of windows."""
    m = len(segments)
    far = max(d for d, _ in segments)
    start = np.array([far - d for d, _ in segments])
    stop = start + np.array([len(x) for _, x in segments])
    wide, windows = int(stop.max()), int((stop - width).max()) + 1
    by_column = np.empty((wide, m), np.uint8)
    for k in range(0, m, 4096):
        part = np.zeros((min(4096, m - k), wide), np.uint8)
        for j, (_, x) in enumerate(segments[k : k + 4096]):
            part[j, start[k + j] : stop[k + j]] = np.frombuffer(x, np.uint8)
        by_column[:, k : k + 4096] = part.T
    hits = np.zeros((windows, m), bool)
    enter = np.argsort(-stop, kind="stable")
    ends = -stop[enter]
    order, common, inside = np.zeros(0, np.int64), np.zeros(0, np.int32), 0
    for c in range(wide - 1, -1, -1):
        now = int(np.searchsorted(ends, -c - 1, side="right"))  # those whose last symbol is this one come in
        if now > inside:
            order = np.concatenate([order, enter[inside:now]])
            common = np.concatenate([common, np.zeros(now - inside, np.int32)])
            inside = now
        symbol = by_column[c][order].astype(np.int16)
        symbol[start[order] > c] = 256  # those that have begun go out
        new = np.argsort(symbol, kind="stable")
        sorted_symbol = symbol[new]
        new = new[: np.searchsorted(sorted_symbol, 256)]
        sorted_symbol = sorted_symbol[: len(new)]
        fresh = np.zeros(len(new), np.int32)
        if len(new) > 1:
            same = np.flatnonzero(sorted_symbol[1:] == sorted_symbol[:-1]) + 1
            a, b = new[same - 1] + 1, new[same]  # the least of common[a..b]
            near = a == b
            fresh[same[near]] = common[b[near]] + 1
            pairs = np.stack([a[~near], b[~near] + 1], 1).ravel()
            if len(pairs):
                fresh[same[~near]] = np.minimum.reduceat(np.append(common, 0), pairs)[::2] + 1
        order, common = order[new], np.minimum(fresh, width)
        if c < windows:
            full = common >= width
            hits[c, order] = full | np.append(full[1:], False)
    return hits


def find_repeats(segments: DataFrame, width: int) -> DataFrame:
    """segments (key, name, d, data), one row for each name -> name, ranges array<int> (first, past the last window,
    first, ...), of windows that another segment has too. All of a key are in one task; keys are done TOGETHER."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, bytes]] = []

        def done(rows: list[tuple[int, bytes, int, bytes]]) -> pa.RecordBatch:
            hits = repeats([(d, x) for _, _, d, x in rows], width)
            far = max(d for _, _, d, _ in rows)
            names, ranges = [], []
            for j in np.flatnonzero(hits.any(0)).tolist():
                _, name, d, x = rows[j]
                own = hits[far - d : far - d + len(x) - width + 1, j]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                names.append(name)
                ranges.append(edges.astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ranges, pa.list_(pa.int32()))], names=["name", "ranges"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(4))):
                if len(held) >= TOGETHER and row[0] != held[-1][0]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = segments.select("key", "name", "d", "data").repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(scan, "name binary, ranges array<int>")


def whole_texts(docs: DataFrame) -> DataFrame:
    """(uid, text): each text once; copies within a task are one before they move."""
    plain = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.withColumn("uid", F.substring(F.sha2("text", 256), 1, 32)).groupBy("uid").agg(F.first("text").alias("text"))


def repeated_windows(docs: DataFrame, scanned: DataFrame, width: int = WIDTH) -> DataFrame:
    """(uid, ranges): windows of each text, as array<array<long>> of (first, past the last), that start elsewhere too."""
    texts = scanned.groupBy("uid").agg(F.first("seg").alias("seg"), F.first("n_bytes").alias("n_bytes"))
    rows = texts.filter(F.col("n_bytes") >= width).select("uid", F.explode("seg").alias("s"))
    # a table of its own: the join then reads two plain exchanges, so that a hot anchor's side can be split
    often = cut(rows.groupBy(F.col("s.h").alias("h")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"))
    kept = rows.withColumn("h", F.col("s.h")).join(often, "h").groupBy("uid").agg(F.collect_list("s").alias("seg"))
    segments = stored(cut_segments(whole_texts(docs).join(kept, "uid"), width), "segments")
    # how many different segments there are to a key, and how often each occurs, without their bytes
    names = cut(segments.groupBy("key", "name").agg(F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")))
    keys = names.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    copied = names.filter("copies > 1").select("name", F.array(F.lit(0), F.col("n")).alias("ranges"))
    once = ["key", "name"]
    calm = segments.join(keys.filter(F.col("m") <= CROWD), "key", "left_semi").dropDuplicates(once)
    crowded = segments.join(keys.filter(F.col("m") > CROWD), "key", "left_semi").dropDuplicates(once)
    hits = find_repeats(calm, width).unionByName(copied).unionByName(counted_windows(crowded, width))
    return (
        segments.select("name", "uid", "a")
        .join(hits, "name")
        .select("uid", F.transform("ranges", lambda x: x.cast("long") + F.col("a")).alias("ranges"))
        .groupBy("uid")
        .agg(F.collect_list("ranges").alias("ranges"))
    )


def passage_words(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(uid, n_passage_words): words of a text that lie in windows of WORDS words which another text has too."""
    texts = scanned.groupBy("uid").agg(F.first("wseg").alias("wseg"))
    rows = texts.select("uid", F.explode("wseg").alias("s"))
    often = cut(rows.groupBy(F.col("s.h").alias("h")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"))
    kept = rows.withColumn("h", F.col("s.h")).join(often, "h").groupBy("uid").agg(F.collect_list("s").alias("wseg"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                codes = word_codes(list(text_bytes(b.column(1))))
                names, uids, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for uid, own, seg in zip(b.column(0).to_pylist(), codes, b.column(2)):
                    first, n = seg.values.field("a").to_numpy().astype(np.int64), seg.values.field("n").to_numpy()
                    at = np.unique(np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
                    names.append(named_windows(own, WORDS)[at].view(np.int64))
                    places.append(at)
                    uids.append(np.full(len(at), uid, np.int64))
                name, uid, at = np.concatenate(names), np.concatenate(uids), np.concatenate(places)
                # a name that two texts of this batch have is known to be shared: it goes on as one row, its places apart from it
                order = np.lexsort((uid, name))
                name, uid, at = name[order], uid[order], at[order]
                new = np.append(True, name[1:] != name[:-1]) if len(name) else np.zeros(0, bool)
                edges = np.flatnonzero(new)
                size = np.diff(np.append(edges, len(name)))
                mixed = uid[edges] != uid[edges + size - 1]
                shared = np.repeat(mixed, size)
                kind = np.concatenate([np.where(shared, 2, 0), np.ones(int(mixed.sum()), np.int64)])
                cells = (np.append(np.where(shared, uid ^ at, name), name[edges[mixed]]), np.append(uid, uid[edges[mixed]]), np.append(at, at[edges[mixed]]), kind)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int32(), pa.int8()))], names=["name", "uid", "at", "kind"])

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows (name, uid, at, kind) sorted by name: those of kind 2, and those of kind 0 whose name has a row of kind 1 or
        another uid. What is carried on is the last name's rows while they are of one uid; then a row of kind 1 stands for them."""
        left = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int8)]

        def told(cells: list[np.ndarray]) -> np.ndarray:
            """Whether each row's name is shared."""
            name, uid, _, kind = cells
            first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            many = np.maximum.reduceat(kind, first) == 1
            many |= np.minimum.reduceat(uid, first) != np.maximum.reduceat(uid, first)
            return np.repeat(many, np.diff(np.append(first, len(name))))

        for b in batches:
            cells = [c.to_numpy() for c in b.columns]
            known = cells[3] == 2
            rest = [np.concatenate([x, c[~known]]) for x, c in zip(left, cells)]
            out = [[cells[1][known], cells[2][known]]]
            if len(rest[0]):
                mixed = told(rest)
                found = mixed & (rest[3] == 0)
                out.append([rest[1][found], rest[2][found]])
                last = rest[0] == rest[0][-1]
                if mixed[-1]:
                    left = [c[-1:].copy() for c in rest]
                    left[3][:] = 1
                else:
                    left = [c[last] for c in rest]
            us, ats = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(us), pa.array(ats)], names=["text", "at"])

    id_of = F.xxhash64("uid").alias("text")
    cutout = whole_texts(docs).join(kept, "uid").select(id_of, "text", "wseg").toDF("uid", "text", "wseg")
    named = cutout.mapInArrow(scan, "name long, uid long, at int, kind byte")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = named.repartition(n, "name").sortWithinPartitions("name").mapInArrow(shared, "text long, at int")
    places = found.groupBy("text").agg(F.sort_array(F.collect_set("at")).alias("at"))
    # each window adds the words that the one before it doesn't have
    gaps = F.zip_with("at", F.slice(F.col("at"), 2, F.size("at")), lambda x, y: F.least(F.coalesce(y - x, F.lit(WORDS)), F.lit(WORDS)))
    words = F.aggregate(gaps, F.lit(0).cast("long"), lambda x, y: x + y)
    return cut(places.select("text", words.alias("n_passage_words")))


def union_spans(ranges: list[list[int]], width: int) -> np.ndarray:
    """Maximal runs (first, past the last) of the bytes that the windows cover."""
    r = np.concatenate([np.array(x, np.int64).reshape(-1, 2) for x in ranges])
    r = r[np.argsort(r[:, 0], kind="stable")]
    first, last = r[:, 0], np.maximum.accumulate(r[:, 1] + width - 1)
    new = np.append(True, first[1:] > last[:-1])
    return np.stack([first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(last) - 1)]], 1)


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, for every row."""
    scanned = stored(scan_texts(docs, width, gram), "scanned")
    copies = scanned.groupBy("uid").agg(F.count(F.lit(1)).alias("copies"))
    passages = passage_words(docs, scanned)
    windows = repeated_windows(docs, scanned, width)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, runs, sha = [], [], []
            for text, ranges in zip(text_bytes(b.column(1)), b.column(2)):
                s = union_spans(ranges.as_py(), width)
                removed.append(int((s[:, 1] - s[:, 0]).sum()))
                runs.append(len(s))
                kept, at = hashlib.sha256(), 0
                for x, y in s.tolist():
                    kept.update(text[at:x])
                    at = y
                kept.update(text[at:])
                sha.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha)], names=["uid", "removed", "spans", "rest"])

    # a text that has copies goes as a whole, so only texts without any are read again
    alone = copies.filter("copies = 1").select("uid")
    again = whole_texts(docs).join(windows.join(alone, "uid", "left_semi"), "uid").select("uid", "text", "ranges")
    done = again.mapInArrow(scan, "uid string, removed long, spans long, rest string")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    return (
        scanned.drop("seg", "wseg")
        .join(copies, "uid")
        .join(done, "uid", "left")
        .withColumn("text", F.xxhash64("uid"))
        .join(passages, "text", "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("rest", "sha")).alias("kept_sha256"),
            F.when((F.col("copies") > 1) & (F.col("n_words") >= WORDS), F.col("n_words")).otherwise(F.coalesce("n_passage_words", F.lit(0))).cast("long").alias("n_passage_words"),
        )
    )
