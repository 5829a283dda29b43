"""Audit of how far the sources of each language lie apart, by the share that they give each term.

Terms are runs of letters and of characters beyond ASCII, A-Z in lower case. A language keeps the terms that are in at least LEAST of its
documents. A group (lang, source) with N occurrences of kept terms gives a term that it has count times p = 1 + floor(1e9 * (count + 5) /
(N + 5 V)), V the number of kept terms; the divergence of two groups is the sum of |p - q| over all of them.

The pairs of a language's groups are a square that is tiled by blocks of about BLOCK groups on either side. A group's counts are packed
into vectors, one for each chunk of about CHUNK kept terms, and copied to every tile of its block's row and column. A task has the
vectors of its tile sorted by chunk and holds one chunk at a time, adding to the tile's sums; the chunks of a large vocabulary are
dealt to several tasks, SLICE at a time, whose sums are added up. Terms that neither block has in a chunk are added in closed form.
All sums are of whole numbers. A group of N + 5 V of 9e15 or more would overflow and is an error.

Nulls in text, lang and source count as ''. Empty texts, and groups without a kept term, count as groups with N = 0; with no kept term in
a language its divergences are 0. A text is cut into terms in pieces of some megabytes; its set of terms is held until it is counted. Repeated
rows count as often as they are there. Ties rank by item, bytewise. Only text, lang and source are read, whatever else there is. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollumen.llm.common import small, stored, text_bytes

LEAST, TOP = 30, 50
BLOCK, CHUNK, SLICE = 64, 2048, 16
#: A task's counters are given out when they have so many entries, or have seen so many bytes.
ENTRIES, BYTES, PIECE = 300_000, 128 << 20, 4 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end
    yield text[at:].translate(_FOLD).split()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), summed as far as memory goes."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    entries = seen = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            for words in ([*n][i : i + 50_000] for i in range(0, len(n), 50_000)):
                terms = pa.array(words, pa.binary()).cast(pa.string())
                k = len(words)
                sums = [pa.array([c[w] for w in words], pa.int64()) for c in (n, docs)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([source] * k), terms, *sums], schema=_COUNTS)

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2))):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for terms in term_lists(text):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            entries, seen = entries + len(n) - before, seen + len(text)
            if entries > ENTRIES or seen > BYTES:
                yield from given()
                held.clear()
                entries = seen = 0
    yield from given()


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(1e9 * (count + 5) / total) by long division in base 1000, exact in 64 bits."""
    left, out = count.astype(np.int64) + 5, np.zeros(len(count), np.int64)
    for _ in range(3):
        left = left * 1000
        digit = left // total
        out, left = out * 1000 + digit, left - digit * total
    return out + 1


class _Tile:
    """The sums of one tile and slice, chunk by chunk."""

    def __init__(self, key: tuple) -> None:
        self.key, self.heads, self.chunk, self.rows, self.sums = key, [], None, [], None

    def head(self, block: int, place: int, source: str, total: int, kept: int) -> None:
        self.heads.append((block, place, source, total, kept))

    def begin(self) -> None:
        _, lo, hi, part = self.key
        self.at = {h[:2]: i for i, h in enumerate(self.heads)}
        self.totals = [h[3] for h in self.heads]
        zero = np.zeros(1, np.int64)
        self.base = np.array([share(zero, t)[0] if t else 0 for t in self.totals], np.int64)
        self.a = [i for i, h in enumerate(self.heads) if h[0] == lo]
        self.b = [i for i, h in enumerate(self.heads) if h[0] == hi]
        kept = self.heads[0][4] if part == 0 and self.heads else 0
        self.sums = kept * np.abs(self.base[self.a][:, None] - self.base[self.b][None, :])

    def add(self, chunk: int, block: int, place: int, ids: np.ndarray, counts: np.ndarray) -> None:
        if self.sums is None:
            self.begin()
        if chunk != self.chunk:
            self.flush()
            self.chunk = chunk
        self.rows.append((self.at[block, place], ids, counts))

    def flush(self) -> None:
        if not self.rows:
            return
        there = np.unique(np.concatenate([r[1] for r in self.rows]))
        p = np.repeat(self.base[:, None], len(there), axis=1)
        for i, ids, counts in self.rows:
            p[i, np.searchsorted(there, ids)] = share(counts, self.totals[i])
        right, base = p[self.b], self.base[self.b]
        for k, i in enumerate(self.a):
            self.sums[k] += np.abs(right - p[i]).sum(axis=1) - len(there) * np.abs(base - self.base[i])
        self.rows = []

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.sums is None:
            self.begin()
        self.flush()
        lang, lo, hi, _ = self.key
        names = [h[2] for h in self.heads]
        for k, i in enumerate(self.a):
            others = [(m, j) for m, j in enumerate(self.b) if j != i]
            if not others:
                continue
            item, value = [names[j] for _, j in others], [int(self.sums[k, m]) for m, _ in others]
            mine = [names[i]] * len(others)
            sides = [(mine, item)] if lo == hi else [(mine, item), (item, mine)]
            for x, y in sides:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x)), pa.array(x), pa.array(y), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])


def tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, slice and chunk (heads, of chunk -1, come first) -> sums of pairs, for each slice."""
    tile = None
    for b in batches:
        lang, lo, hi, part, chunk, block, place, source, total, kept = (b.column(i).to_pylist() for i in range(10))
        ids, counts = b.column(10), b.column(11)
        starts = ids.offsets.to_numpy()
        flat_ids, flat_counts = ids.values.to_numpy(), counts.values.to_numpy()
        for i in range(b.num_rows):
            key = (lang[i], lo[i], hi[i], part[i])
            if tile is None or tile.key != key:
                if tile is not None:
                    yield from tile.result()
                tile = _Tile(key)
            if chunk[i] < 0:
                tile.head(block[i], place[i], source[i], total[i], kept[i])
            else:
                tile.add(chunk[i], block[i], place[i], flat_ids[starts[i] : starts[i + 1]], flat_counts[starts[i] : starts[i + 1]])
    if tile is not None:
        yield from tile.result()


def _p(count: str, total: str):
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 5 as decimal(19,0))) div cast({total} as decimal(20,0))")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its divergence from each other source of its language (part `pair`), and the
    terms to which it gives more than its language does (part `term`, at most `top`)."""
    empty = F.lit("")
    own = docs.select(F.coalesce(F.col("lang").cast("string"), empty).alias("lang"), F.coalesce(F.col("source").cast("string"), empty).alias("source"), "text")
    partial = own.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    counts = stored(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")

    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs")
    kept = stored(kept, "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all_n").alias("lang_n"))
    langs = langs.withColumn("chunks", F.ceil(F.col("kept") / CHUNK).cast("int")).withColumn("lang_total", F.col("lang_n") + 5 * F.col("kept"))
    placed = kept.join(small(langs), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("id", (F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).cast("int"))
    rows = stored(counts.drop("docs").join(placed.select("lang", "term", "all_n", "lang_total", "chunk", "id"), ["lang", "term"]), "kept-counts")

    sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = own.select("lang", "source").distinct()
    many = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(small(many), "lang").join(small(langs.select("lang", "kept", "chunks")), "lang", "left")
    groups = groups.na.fill(0, ["group_n", "kept", "chunks"]).withColumn("total", F.col("group_n") + 5 * F.col("kept"))
    groups = groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    groups = groups.withColumn("place", (F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1).cast("int"))
    groups = stored(groups, "groups")
    if groups.filter(F.col("total") >= 9_000_000_000_000_000).limit(1).count():
        raise OverflowError("a group has too many terms for exact sums in 64 bits")
    near = small(groups.select("lang", "source", "block", "place", "blocks", "total"))

    # packed vectors, and a head for each group in each slice; both go to all tiles of their block's row and column
    chunked = rows.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("id", "n")).alias("x"))
    vectors = chunked.join(near, ["lang", "source"]).select(
        "lang", "blocks", (F.col("chunk") / SLICE).cast("int").alias("slice"), "chunk", "block", "place", F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("kept"), F.col("x.id").alias("ids"), F.col("x.n").alias("counts"),
    )
    slices = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("chunks") / SLICE) - 1, F.lit(0)).cast("int"))
    heads = groups.select(
        "lang", "blocks", F.explode(slices).alias("slice"), F.lit(-1).alias("chunk"), "block", "place", "source", "total", "kept",
        F.expr("cast(array() as array<int>)").alias("ids"), F.expr("cast(array() as array<bigint>)").alias("counts"),
    )
    copies = vectors.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = copies.select(
        "lang", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "slice", "chunk", "block", "place", "source", "total", "kept", "ids", "counts"
    )
    keys = ["lang", "lo", "hi", "slice"]
    sums = tiles.repartition(*keys).sortWithinPartitions(*keys, "chunk").mapInArrow(tile_sums, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    gained = rows.join(near.select("lang", "source", "total"), ["lang", "source"]).filter(F.col("n") > 0)
    gained = gained.select("lang", "source", F.col("term").alias("item"), (_p("n", "total") - _p("all_n", "lang_total")).alias("value")).filter(F.col("value") > 0)
    terms = gained.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


#: The same in DuckDB.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tok AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS all_n FROM tok GROUP BY ALL HAVING count(DISTINCT row) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(all_n) AS n FROM kept GROUP BY lang),
own AS (SELECT c.* FROM cnt c JOIN kept USING (lang, term)),
groups AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM own GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 5)) // (g.n + 5 * g.v) AS p,
    1 + (1000000000::HUGEINT * (k.all_n + 5)) // (l.n + 5 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(d.f), 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) d
  ON d.lang = a.lang AND d.source = a.source AND d.item = b.source GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
