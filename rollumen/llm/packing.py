"""Mixture-controlled packing of documents into training sequences.

Every source is a queue of its documents' tokens, in the order of doc_id. A window (one sequence) grants source s its
share of the window; s serves a block of QUANTUM tokens once its deficit, the grants less what it has served, covers
it. That is deficit round-robin with deficits carried from window to window. As grants are a fixed number for each
round, the round in which block k is served is known in closed form, ceil((k * QUANTUM + its length) / (share *
window)), so rounds need not be played one after the other: blocks are sorted by round and source, and running sums
carry the position across partitions. Sources that run dry leave their share to the others. Default shares are those
of the corpus, so that all queues last to the end; `mixture` sets others (missing sources: the corpus share).

Sequences are filled to the last token: only the final one can be short, and documents are cut freely to that end.

Nulls: a null text is empty (one end token); a null source is a source of its own; null ids sort first. Repeated rows
are packed as often as they come. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollumen.llm import symbols
from rollumen.llm.common import Generations, prefix_sums, small, stored

LENGTH, QUANTUM, END, KEPT, TOGETHER = 4096, 512, 2, 100_000, 2 << 20

_LOADED: dict[str, Words] = {}


class Words:
    """Ids of whole texts by a tokenizer file, as little-endian unsigned integers of 16 bits if the vocabulary allows, else
    of 32. Words of other characters than symbols.Coder knows go to the tokenizer itself, and are kept in two
    generations of up to KEPT words each; results don't depend on what is kept."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.kind = "<u2" if self.own.get_vocab_size() < (1 << 16) - 2 else "<u4"
        self.coder = symbols.Coder.of_file(path)
        self.kept = Generations(KEPT, lambda word: self.plain([word])[0])

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for k in range(0, len(texts), 5000):
            out += [np.array(e.ids, self.kind) for e in self.own.encode_batch_fast(texts[k : k + 5000], add_special_tokens=False)]
        return out

    def words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word; those not held yet are encoded together."""
        new = [w for w in set(words) if w not in self.kept and w not in self.kept.old]
        found = dict(zip(new, self.plain(new)))
        out = [found[w] if w in found else self.kept[w] for w in words]
        for w, ids in found.items():
            self.kept.put(w, ids)
        return out

    def encode_all(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, `end` after each, and where each text begins (and the last one ends)."""
        if self.coder is None:
            own = [np.append(x, np.array(end, self.kind)) for x in self.plain(texts)]
            return np.concatenate(own), np.cumsum([0, *map(len, own)])
        parts, owner = symbols.parts(texts, TOGETHER // 2)
        ids, stops, at, odd = self.coder.encode(parts)
        ids = ids.astype(self.kind)
        sizes = np.ones(len(ids), np.int64)
        if odd:
            known = self.words(odd)
            sizes[at] = list(map(len, known))
        last = np.append(owner[1:] != owner[:-1], True)
        ids[stops[last]] = end
        sizes[stops[~last]] = 0
        out = np.repeat(ids, sizes)
        ends = np.cumsum(sizes)
        if odd:
            mark = np.zeros(len(ids), bool)
            mark[at] = True
            out[np.repeat(mark, sizes)] = np.concatenate(known)
        return out, np.append(0, ends[stops[last]])


def tokenizer(path: str) -> Words:
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def lots(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about TOGETHER bytes in a column of texts or bytes; a longer value is a slice of its own."""
    sizes = np.array(pc.binary_length(batch.column(column)).fill_null(0))
    at = 0
    for lot in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // TOGETHER)) + 1):
        if len(lot):
            yield batch.slice(at, len(lot))
            at += len(lot)


def tokenised(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(row, doc_id, source, n, ids): ids hold every token and the end; row names the input row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for b in batches:
            for part in lots(b, 3):
                ids, edges = own.encode_all(part.column(3).to_pylist(), end)
                at = pa.py_buffer((edges * ids.itemsize).astype(np.int64))
                data = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, at, pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.diff(edges)), data], names=["row", "doc_id", "source", "n", "ids"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(scan, f"row long, doc_id {kind}, source string, n long, ids binary")


def schedule(counts: DataFrame, length: int = LENGTH, quantum: int = QUANTUM, mixture: dict[str, float] | None = None) -> DataFrame:
    """counts (row, doc_id, source, n) -> pieces (row, start, length, sequence_id, offset)."""
    totals = counts.groupBy("source").agg(F.sum("n").alias("total"))
    whole = totals.agg(F.sum("total")).first()[0] or 1
    share = F.col("total") / F.lit(float(whole))
    if mixture:
        given = F.create_map(*[x for k, v in mixture.items() for x in (F.lit(k), F.lit(float(v)))])
        share = F.coalesce(F.try_element_at(given, F.col("source")), share)
    # queues in the order of source: where each begins
    queues = prefix_sums(totals.withColumn("share", share), ["source"], "total", "base")
    placed = prefix_sums(counts.select("row", "doc_id", "source", "n"), ["source", "doc_id", "row"], "n", "at")
    queues = small(queues.select(F.col("source").alias("_queue"), "total", "share", "base"))
    same = placed["source"].eqNullSafe(F.col("_queue"))
    cut = (
        placed.join(queues, same)
        .select("row", "source", "n", (F.col("at") - F.col("base")).alias("q"), "total", "share")
        .withColumn("k", F.explode(F.sequence(F.floor(F.col("q") / quantum), F.floor((F.col("q") + F.col("n") - 1) / quantum))))
        .withColumn("from", F.greatest("q", F.col("k") * quantum))
        .withColumn("to", F.least(F.col("q") + F.col("n"), (F.col("k") + 1) * quantum))
        .withColumn("round", F.ceil(F.least((F.col("k") + 1) * quantum, "total") / (F.col("share") * length)))
        .select("row", "source", "round", "from", (F.col("from") - F.col("q")).alias("begin"), (F.col("to") - F.col("from")).alias("size"))
    )
    laid = prefix_sums(cut, ["round", "source", "from"], "size", "g")
    first, last = F.floor(F.col("g") / length), F.floor((F.col("g") + F.col("size") - 1) / length)
    windows = laid.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    a = F.greatest("g", F.col("sequence_id") * length)
    b = F.least(F.col("g") + F.col("size"), (F.col("sequence_id") + 1) * length)
    return windows.select(
        "row",
        (F.col("begin") + a - F.col("g")).alias("start"),
        (b - a).alias("length"),
        F.col("sequence_id").cast("long").alias("sequence_id"),
        (a - F.col("sequence_id") * length).alias("offset"),
    )


def pack(docs: DataFrame, path: str, length: int = LENGTH, quantum: int = QUANTUM, mixture: dict[str, float] | None = None, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = stored(tokenised(docs, path, end), "tokens")
    pieces = schedule(tokens.select("row", "doc_id", "source", "n"), length, quantum, mixture)
    own = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("p"))
    both = tokens.join(own, "row").select("doc_id", "source", "n", "ids", "p.start", "p.length", "p.sequence_id", "p.offset")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in lots(whole, 3):
                crc, where = [], []
                for i, (n, ids, starts, sizes) in enumerate(zip(b.column(2).to_pylist(), b.column(3), b.column(4), b.column(5))):
                    data = ids.as_buffer()
                    wide = memoryview(np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4").tobytes())
                    at, many = starts.values.to_numpy(), sizes.values.to_numpy()
                    crc += [zlib.crc32(wide[4 * s : 4 * (s + m)]) for s, m in zip(at.tolist(), many.tolist())]
                    where.append(np.full(len(at), i))
                where = pa.array(np.concatenate(where))
                flat = [b.column(c).flatten() for c in (4, 5, 6, 7)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(where), flat[0], flat[1], pa.array(crc, pa.int64()), b.column(2).take(where), flat[2], flat[3], b.column(1).take(where)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
                )

    return both.mapInArrow(scan, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
