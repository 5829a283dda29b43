"""Merkle manifest of a dataset: a digest for each row, a tree for each source, one root, and a path from every row to it.

Leaves of a source ascend by doc_id; every ARITY consecutive nodes become one until one is left, the source's subroot.
Subroots in the order of their sources make a tree in the same way, which gives the root.

Nodes are worked on in supersteps over an RDD. A vertex is a block of up to ARITY**SPAN nodes of one level of one tree. Upwards
a block hashes its runs, level by level, to one digest and sends it to its parent block, which hashes and forwards as soon as the
superstep has brought it its children. Downwards a block tells each child the path above it (what stands left and right of it in
each run), until the leaves' blocks hold whole paths and fold them. Up to ARITY**SPAN messages meet in a block, whatever the size of
a source. The driver gets one record for each range of sorted leaves and nothing for single rows.

Nulls: a null field is `-`. Rows with a null source are a source of their own, before all others; rows with a null doc_id come first
in their source and are never tampered with by the query. Rows of one doc_id are ordered by their digest, and equal rows are leaves
of their own that only differ in their paths. Empty texts are `0:`. Texts of any length are hashed where they are read and never moved.
Columns but doc_id, source, lang, n_chars and text are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollumen.llm.common import cut, stored

ARITY, SPAN = 3, 5
WIDTH = ARITY**SPAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of subroots; trees of sources are numbered from 0.
TOP = -1
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(**changed: Column) -> Column:
    """sha256 of a row's fields: each `-` if null, else its UTF-8 length, `:` and the value. A field can be given in another form."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def levels_of(nodes: list[str], last: bool) -> list[list[str]]:
    """The levels of a block from its nodes upwards: SPAN levels, or, in a tree's last block, until one node is left."""
    out = [nodes]
    while len(out[-1]) > 1 if last else len(out) <= SPAN:
        row = out[-1]
        out.append([digest("".join(row[i : i + ARITY])) for i in range(0, len(row), ARITY)])
    return out


def path_in(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands left and right of node `at` and of its ancestors in their runs."""
    path = []
    for row in levels[:-1]:
        first = at - at % ARITY
        path.append(("".join(row[first:at]), "".join(row[at + 1 : first + ARITY])))
        at //= ARITY
    return path


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


class _Block:
    """The nodes of a block, in order, whether blocks follow it, and whether it is all of its tree's level. Rows go with the leaves' blocks only."""

    __slots__ = ("nodes", "more", "last", "rows")

    def __init__(self, pieces) -> None:
        pieces = sorted(pieces, key=lambda p: p[0])
        first = pieces[0][0] < WIDTH
        self.nodes = [x for p in pieces for x in p[1]]
        self.more = pieces[-1][2]
        self.last = first and not self.more
        self.rows = [x for p in pieces for x in p[3]]

    def __reduce__(self):
        return _restored, (self.nodes, self.more, self.last, self.rows)


def _restored(nodes, more, last, rows) -> _Block:
    block = object.__new__(_Block)
    block.nodes, block.more, block.last, block.rows = nodes, more, last, rows
    return block


def _where(key: tuple[int, int]) -> int:
    return (key[0] * 1_000_003 + key[1]) & 0x7FFFFFFF


def _gathered(pieces: RDD, parts: int) -> RDD:
    """Deliver messages to their blocks: (tree, block) -> _Block."""
    return pieces.groupByKey(parts, _where).mapValues(_Block).persist(StorageLevel.DISK_ONLY)


def _raise_block(item):
    """A block's message to its parent: ((tree, parent), (place, [digest], whether more blocks follow, []))."""
    (tree, block), b = item
    return (tree, block // WIDTH), (block, levels_of(b.nodes, False)[-1], b.more, [])


def _runs(sums: list[tuple]) -> tuple[dict[int, tuple], int]:
    """From (range, first source, last source, rows of the last, sources) in order: for each range the number of its first source, rows of that
    source in earlier ranges, and the first source of the next range; and the number of all sources."""
    out, tree, before, previous = {}, -1, 0, None
    for k, (part, first, last, rows_last, sources) in enumerate(sums):
        joined = previous == first
        tree += 0 if joined else 1
        start = before if joined else 0
        following = sums[k + 1][1] if k + 1 < len(sums) else None
        out[part] = (tree, start, following)
        before = rows_last + (start if sources == 1 else 0)
        tree, previous = tree + sources - 1, last
    return out, tree + 1


def _source_key(source: str | None) -> bytes:
    return b"-" if source is None else hashlib.sha256(source.encode()).digest()


def _summary(part: int, rows: Iterator) -> Iterator[tuple]:
    first, source, of, count = None, None, 0, 0
    for r in rows:
        if of == 0 or r.source != source:
            first = _source_key(r.source) if of == 0 else first
            source, of, count = r.source, of + 1, 0
        count += 1
    if of:
        yield part, first, _source_key(source), count, of


def _pieces(part: int, rows: Iterator, runs: dict[int, tuple]) -> Iterator[tuple]:
    """Leaves as messages to their blocks, a run of one block at a time."""
    if part not in runs:
        return
    tree, at, following = runs[part]
    source, piece, seen = None, None, False
    for r in rows:
        if seen and r.source != source:
            yield (tree, piece[0] // WIDTH), (piece[0], piece[1], False, piece[2])
            tree, at, piece = tree + 1, 0, None
        elif piece is not None and at % WIDTH == 0:
            yield (tree, piece[0] // WIDTH), (piece[0], piece[1], True, piece[2])
            piece = None
        seen, source = True, r.source
        if piece is None:
            piece = (at, [], [])
        piece[1].append(r.leaf.hex())
        piece[2].append((r.doc_id, None if r.checked is None else r.checked.hex()))
        at += 1
    yield (tree, piece[0] // WIDTH), (piece[0], piece[1], following == _source_key(source), piece[2])


def _down(item) -> Iterator[tuple]:
    """A block's messages to its children's blocks: ((tree, child), (path above, subroot, root))."""
    (tree, block), (b, (path, subroot, root)) = item
    levels = levels_of(b.nodes, b.last)
    for k in range(len(b.nodes)):
        yield (tree, block * WIDTH + k), (path_in(levels, k) + path, subroot, root)


def _rows_of(item, paths: bool) -> Iterator[tuple]:
    _, (b, (above, subroot, root)) = item
    levels = levels_of(b.nodes, b.last)
    for k, (doc_id, checked) in enumerate(b.rows):
        path = path_in(levels, k) + above
        folded = fold(checked or b.nodes[k], path)
        row = (doc_id, b.nodes[k], subroot, root, digest("".join(left + right for left, right in path)), folded, folded == root)
        yield (*row, path) if paths else row


def proofs(leaves: DataFrame, paths: bool = False) -> DataFrame:
    """From (doc_id, source, leaf, checked), digests in hexadecimal: doc_id, leaf, subroot, root, proof_sha256 (of the path's digests), folded_root (the root
    that `checked` and the path give; a null `checked` stands for leaf) and verified (that it is the root); with `paths` also path,
    an array of (left_side, right_side) from the leaf's run to the root's."""
    spark = leaves.sparkSession
    schema = SCHEMA + (", path array<struct<left_side:string,right_side:string>>" if paths else "")
    keys = ["source", "doc_id", "leaf", "checked", "row"]
    narrow = leaves.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.unhex("leaf").alias("leaf"), F.unhex("checked").alias("checked"))
    narrow = stored(narrow.withColumn("row", F.monotonically_increasing_id()), "leaves")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = cut(narrow.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("row")).rdd
    runs, trees = _runs(sorted(held.mapPartitionsWithIndex(_summary).collect()))
    if not trees:
        return spark.createDataFrame([], schema)
    total = held.count()

    def parts(level: int) -> int:
        return min(n, total // WIDTH ** (level + 1) + 1)

    # upwards: blocks of level k send to those of level k + 1; what is left of a tree is its subroot
    levels = [_gathered(held.mapPartitionsWithIndex(lambda part, rows: _pieces(part, rows, runs)), max(parts(0), min(n, trees)))]
    while WIDTH ** len(levels) < total:
        levels.append(_gathered(levels[-1].filter(lambda x: not x[1].last).map(_raise_block), parts(len(levels))))

    def subroots(level: int, blocks: RDD) -> RDD:
        return blocks.filter(lambda x: x[1].last).map(
            lambda x: ((TOP, x[0][0] // WIDTH), (x[0][0], [levels_of(x[1].nodes, True)[-1][0]], (x[0][0] // WIDTH + 1) * WIDTH < trees, [level]))
        )

    top = [_gathered(spark.sparkContext.union([subroots(k, blocks) for k, blocks in enumerate(levels)]), min(n, trees // WIDTH + 1))]
    while WIDTH ** len(top) < trees:
        top.append(_gathered(top[-1].map(_raise_block), 1 + trees // WIDTH ** (len(top) + 1)))

    # downwards: first to the subroots, each of which goes to the level where its tree ended, then to the leaves
    messages = top[-1].mapValues(lambda b: ([], None, levels_of(b.nodes, True)[-1][0]))
    for blocks in reversed(top[1:]):
        messages = blocks.join(messages, blocks.getNumPartitions()).flatMap(_down)

    def to_sources(item):
        (_, block), (b, (path, _, root)) = item
        inside = levels_of(b.nodes, b.last)
        for k, level in enumerate(b.rows):
            yield level, ((block * WIDTH + k, 0), (path_in(inside, k) + path, b.nodes[k], root))

    ended = _joined(top[0], messages).flatMap(to_sources).persist(StorageLevel.DISK_ONLY)
    messages = None
    for k in reversed(range(len(levels))):
        own = ended.filter(lambda x, k=k: x[0] == k).map(lambda x: x[1])
        messages = own if messages is None else messages.union(own)
        held_here = _joined(levels[k], messages)
        messages = held_here.flatMap(_down) if k else held_here.flatMap(lambda x: _rows_of(x, paths))
    return spark.createDataFrame(messages, schema, verifySchema=False)


def _joined(blocks: RDD, messages: RDD) -> RDD:
    """Blocks with the message that each gets; only messages move, as blocks lie where their key is dealt to."""
    return blocks.cogroup(messages.partitionBy(blocks.getNumPartitions(), _where)).flatMapValues(lambda x: [(b, m) for b in x[0] for m in x[1]])


def manifest(docs: DataFrame) -> DataFrame:
    """Leaves, roots and paths of a table as it stands."""
    return proofs(docs.select("doc_id", "source", leaf_digest().alias("leaf"), F.lit(None).cast("string").alias("checked")), paths=True)


def verified(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, verified) of rows that are given again, by the paths of a manifest, without the other rows. Of several rows with one
    doc_id a row is verified if it fits any of their paths."""
    own = docs.select("doc_id", leaf_digest().alias("given"))
    folded = F.aggregate("path", F.col("given"), lambda acc, s: F.sha2(F.concat(s["left_side"], acc, s["right_side"]), 256))
    fits = F.coalesce(F.max(folded == F.col("root")), F.lit(False))
    rows = own.withColumn("at", F.monotonically_increasing_id())
    return rows.join(held.select("doc_id", "path", "root"), "doc_id", "left").groupBy("at", "doc_id").agg(fits.alias("verified")).drop("at")


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The contract's rows: paths of the table as it is, folded with texts that have lost their line feeds where 2 divides the
    crc32 of doc_id in decimals."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(hit & F.col("text").contains("\n"), leaf_digest(text=F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    return proofs(docs.select("doc_id", "source", leaf_digest().alias("leaf"), changed.alias("checked")))


#: The same in DuckDB, by recursion over levels, for unique ids.
ORACLE = r"""
WITH RECURSIVE enc AS (
  SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN doc_id IS NOT NULL AND list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1),
      lambda k: ascii(substr(doc_id::VARCHAR, k::INTEGER, 1))::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: z::UBIGINT)),
      lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS given
  FROM documents),
dig AS (SELECT doc_id, source, sha256(pre || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf, sha256(pre || coalesce(strlen(given)::VARCHAR || ':' || given, '-')) AS checked
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
    || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS pre FROM enc)),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM dig),
up AS (SELECT tree, 0 AS level, i, leaf AS node, n FROM leaves UNION ALL
  SELECT tree, level + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (max(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY tree, level, i // 3),
sub AS (SELECT tree, level, node AS subroot, count(*) OVER () AS trees FROM up WHERE n = 1),
over AS (SELECT 0 AS level, tree AS i, subroot AS node, trees AS n FROM sub UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (max(n) + 2) // 3 FROM over WHERE n > 1 GROUP BY level, i // 3),
root AS (SELECT node AS root FROM over WHERE n = 1),
runs AS (SELECT tree, level, i // 3 AS run, list(node ORDER BY i) AS nodes FROM up WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT -1, level, i // 3, list(node ORDER BY i) FROM over WHERE n > 1 GROUP BY ALL),
walk AS (SELECT doc_id, leaf, tree AS own, tree, 0 AS level, i, checked AS acc, '' AS proof FROM leaves UNION ALL
  SELECT w.doc_id, w.leaf, w.own, w.tree, w.level + 1, w.i // 3,
    sha256(array_to_string(list_transform(r.nodes, lambda x, k: CASE WHEN k = w.i % 3 + 1 THEN w.acc ELSE x END), '')),
    w.proof || array_to_string(list_transform(r.nodes, lambda x, k: CASE WHEN k = w.i % 3 + 1 THEN '' ELSE x END), '')
  FROM walk w JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.run = w.i // 3),
mid AS (SELECT w.doc_id, w.leaf, s.subroot, w.own, w.acc, w.proof FROM walk w JOIN sub s ON s.tree = w.own AND s.level = w.level),
climb AS (SELECT doc_id, leaf, subroot, 0 AS level, own AS i, acc, proof FROM mid UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.i // 3,
    sha256(array_to_string(list_transform(r.nodes, lambda x, k: CASE WHEN k = w.i % 3 + 1 THEN w.acc ELSE x END), '')),
    w.proof || array_to_string(list_transform(r.nodes, lambda x, k: CASE WHEN k = w.i % 3 + 1 THEN '' ELSE x END), '')
  FROM climb w JOIN runs r ON r.tree = -1 AND r.level = w.level AND r.run = w.i // 3)
SELECT c.doc_id, c.leaf, c.subroot, r.root, sha256(c.proof) AS proof_sha256, c.acc AS folded_root, c.acc = r.root AS verified
FROM climb c, root r WHERE c.level = (SELECT max(level) FROM over)
"""
