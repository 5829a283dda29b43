"""Exact top-k inner-product search with one KD-tree per shard.

Space is cut into at most CELLS cells by median splits of a bounded sample (SAMPLE rows; every row is then indexed). A cell's
rows are dealt by hash into shards of about SHARD rows, so that a cell of many equal vectors is many shards. A shard's
tree splits at the median of the widest axis; every node has the tight box of its rows. A box bounds a query's score by
the sum over axes of the larger of query * low and query * high. The traversal takes the node of the highest bound first
and stops when that is below the kth score so far.

Cells have tight boxes of all their rows, too. In the first round each query goes to the cell of its highest bound; in the
second one, with the kth score found there, to those other cells whose boxes can hold a better one, where it prunes from
the start. A task holds one shard, builds its tree once and answers the queries as they stream by. To the driver go the
sample and one box for each cell.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id or whose vector
has another length than the query's. Equal scores rank by smaller id. Repeated rows are rows of their own: only a
query's own row is not its candidate. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollumen.llm.common import cut

SHARD, LEAF, SCALE = 4096, 128, 256
SAMPLE, CELLS, TOGETHER = 32_768, 256, 256


class Tree:
    """Nodes in arrays: lo, hi (boxes), left, right (children; -1 for a leaf), start, stop (rows of x)."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, own: np.ndarray, leaf: int = LEAF) -> None:
        order = np.lexsort((own, ids))
        lo, hi, left, right, span = [], [], [], [], []

        def grow(rows: np.ndarray, start: int) -> int:
            k = len(lo)
            part = x[rows]
            lo.append(part.min(0))
            hi.append(part.max(0))
            left.append(-1)
            right.append(-1)
            span.append((start, start + len(rows)))
            axis = int((hi[k] - lo[k]).argmax())
            if len(rows) > leaf and hi[k][axis] > lo[k][axis]:
                half = len(rows) // 2
                at = np.argpartition(part[:, axis], half)
                left[k] = grow(np.sort(rows[at[:half]]), start)
                right[k] = grow(np.sort(rows[at[half:]]), start + half)
            else:
                laid.append(rows)
            return k

        laid: list[np.ndarray] = []
        x, ids, own = x[order], ids[order], own[order]
        grow(np.arange(len(x)), 0)
        rows = np.concatenate(laid)
        self.ids, self.own, self.left, self.right, self.span = ids[rows], own[rows], left, right, span
        self.most = max(int(np.abs(x).max()), 1)
        # rows, lowest and highest components: as whole numbers, and as floating-point ones for sums that stay exact
        whole = x[rows], np.array(lo), np.array(hi)
        self.by_kind = {"i": whole, "f": tuple(a.astype(float) for a in whole)}

    def fitting(self, q: np.ndarray) -> np.ndarray:
        """Whole-number queries, as floating-point ones if all sums stay exact."""
        return q.astype(float) if len(q) and int(np.abs(q).max()) * self.most * q.shape[1] < 1 << 53 else q

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The highest score that each query can have in each node."""
        _, lo, hi = self.by_kind[q.dtype.kind]
        return np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T

    def top(self, q: np.ndarray, bound: np.ndarray, own: int, k: int, floor: float) -> list[tuple[float, int]]:
        """Up to k of (score, id) that aren't below floor, the best first."""
        best: list[tuple[float, int]] = []
        x = self.by_kind[q.dtype.kind][0]
        frontier = [(-bound[0], 0)]
        while frontier:
            b, node = heappop(frontier)
            if -b < floor:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bound[child] >= floor:
                        heappush(frontier, (-bound[child], child))
                continue
            s, t = self.span[node]
            score = x[s:t] @ q
            near = np.flatnonzero((score >= floor) & (self.own[s:t] != own))
            if len(near):
                best += zip((-score[near]).tolist(), self.ids[s:t][near].tolist())
                best.sort()
                del best[k:]
                if len(best) == k:
                    floor = max(floor, -best[-1][0])
        return [(-s, i) for s, i in best]


def vectors(column: pa.Array, size: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(), np.int64).reshape(-1, size)


def median_splits(x: np.ndarray, cells: int) -> list[tuple[int, int, int, float]]:
    """Nodes (left, right, axis, cut); a negative child is cell -1 - child. Empty: one cell."""
    nodes: list[tuple[int, int, int, float]] = []
    made = 0

    def grow(rows: np.ndarray, most: int) -> int:
        nonlocal made
        part = x[rows]
        axis = int((part.max(0) - part.min(0)).argmax()) if len(rows) else 0
        cut_at = float(np.median(part[:, axis])) if len(rows) else 0.0
        if len(rows) and cut_at == part[:, axis].min() < part[:, axis].max():  # over half of the rows are the lowest
            cut_at = float(part[part[:, axis] > cut_at, axis].min())
        low = part[:, axis] < cut_at if len(rows) else np.zeros(0, bool)
        if most < 2 or not low.any() or low.all():
            made += 1
            return -made
        at = len(nodes)
        nodes.append((0, 0, axis, cut_at))
        nodes[at] = (grow(rows[low], most // 2), grow(rows[~low], most - most // 2), axis, cut_at)
        return at

    grow(np.arange(len(x)), cells)
    return nodes


def cell_of(nodes: list[tuple[int, int, int, float]], x: np.ndarray) -> np.ndarray:
    """Each row's cell; an axis that a vector doesn't have counts as below the cut."""
    out = np.zeros(len(x), np.int32)
    queue = [(0, np.arange(len(x)))] if nodes else []
    while queue:
        k, rows = queue.pop()
        left, right, axis, cut_at = nodes[k]
        high = x[rows, axis] >= cut_at if axis < x.shape[1] else np.zeros(len(rows), bool)
        for child, own in ((left, rows[~high]), (right, rows[high])):
            if child < 0:
                out[own] = -1 - child
            else:
                queue.append((child, own))
    return out


def celled(held: DataFrame, nodes: list[tuple[int, int, int, float]]) -> DataFrame:
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(2).value_lengths().to_numpy()
            cell = np.zeros(len(size), np.int32)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                cell[at] = cell_of(nodes, vectors(b.column(2).take(pa.array(at)), int(n)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size, pa.int32()), pa.array(cell)], names=[*b.schema.names, "size", "cell"])

    return held.mapInArrow(scan, "own long, vec_id long, v array<long>, size int, cell int")


def boxes_of(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length of vectors: cells, rows, lowest and highest components (tight)."""
    schema = "size int, cell int, n long, lo array<long>, hi array<long>"

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}
        for b in batches:
            size, cell = b.column(3).to_numpy(), b.column(4).to_numpy()
            for n, c in set(zip(size.tolist(), cell.tolist())):
                x = vectors(b.column(2).filter(pa.array((size == n) & (cell == c))), n)
                m, lo, hi = seen.get((n, c), (0, x[0], x[0]))
                seen[n, c] = [m + len(x), np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0))]
        cols = [[n for n, _ in seen], [c for _, c in seen], *zip(*seen.values())] if seen else [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["size", "cell", "n", "lo", "hi"])

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        lo, hi = np.min(f["lo"].tolist(), 0), np.max(f["hi"].tolist(), 0)
        return pd.DataFrame({"size": f["size"][:1], "cell": f["cell"][:1], "n": [int(f["n"].sum())], "lo": [lo], "hi": [hi]})

    got = rows.filter("size > 0").mapInArrow(scan, schema).groupBy("size", "cell").applyInPandas(merge, schema).toPandas().sort_values(["size", "cell"])
    return {int(n): (f["cell"].to_numpy(), f["n"].to_numpy(), np.array(f["lo"].tolist(), float), np.array(f["hi"].tolist(), float)) for n, f in got.groupby("size")}


def sent(queries: DataFrame, boxes: dict, shard: int, home: bool) -> DataFrame:
    """Queries (own, vec_id, v, size, cell, floor), once for each shard that they have to search: at home those of the cell
    of the highest bound; then those of all other cells with a bound not below the floor."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, which, cell, part = b.column(3).to_numpy(), [], [], []
            for n in np.unique(size).tolist():
                cells, rows, lo, hi = boxes[n]
                at = np.flatnonzero(size == n)
                q = vectors(b.column(2).take(pa.array(at)), n).astype(float)
                bound = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
                best = bound.argmax(1)
                if home:
                    chosen = np.zeros(bound.shape, bool)
                    chosen[np.arange(len(at)), best] = True
                else:
                    floor = b.column(5).take(pa.array(at)).fill_null(-np.inf).to_numpy()
                    # bounds are sums of large products: a little room for their rounding
                    room = 1e-12 * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T)  # for the rounding of large sums
                    chosen = bound + room >= floor[:, None]
                    chosen[np.arange(len(at)), best] = False
                i, c = np.nonzero(chosen)
                many = -(-rows[c] // shard)
                which.append(np.repeat(at[i], many))
                cell.append(np.repeat(cells[c], many))
                part.append(np.concatenate([np.zeros(0, np.int64), *(np.arange(m) for m in many)]))
            which = pa.array(np.concatenate([np.zeros(0, np.int64), *which]).astype(np.int64))
            own = [b.column(k).take(which) for k in (0, 1, 2, 3, 5)]
            placed = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32)) for x in (cell, part)]
            yield pa.RecordBatch.from_arrays([*own[:4], *placed, own[4]], names=["own", "vec_id", "v", "size", "cell", "part", "floor"])

    return queries.mapInArrow(scan, "own long, vec_id long, v array<long>, size int, cell int, part int, floor double")


def search(k: int, leaf: int):
    """For rows (size, cell, part, asks, own, vec_id, v, floor) sorted by the first four: a shard's rows, then its queries."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, tree = None, [], None

        def answered(b: pa.RecordBatch, n: int) -> pa.RecordBatch:
            out: list[tuple[int, int, int, int]] = []
            q = tree.fitting(vectors(b.column(6), n))
            floors = b.column(7).fill_null(-np.inf).to_numpy()
            for a in range(0, len(q), TOGETHER):
                bound = tree.bounds(q[a : a + TOGETHER])
                for j, (i, own, floor) in enumerate(zip(b.column(5)[a : a + TOGETHER].to_pylist(), b.column(4)[a : a + TOGETHER].to_pylist(), floors[a : a + TOGETHER])):
                    out += [(own, i, c, int(s)) for s, c in tree.top(q[a + j], bound[j], own, k, floor)]
            cols = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["own", "query_id", "vec_id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).cast(pa.int32()).to_numpy() for c in range(4)], 1)
            edges = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))), len(keys))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own, n = b.slice(x, y - x), int(keys[x, 0])
                if tuple(keys[x, :3]) != name:
                    name, held, tree = tuple(keys[x, :3]), [], None
                if not keys[x, 3]:
                    held.append(own)
                elif held:
                    if tree is None:
                        v = np.concatenate([vectors(h.column(6), n) for h in held])
                        ids, rows = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in (5, 4))
                        tree = Tree(v, ids, rows, leaf)
                    yield answered(own, n)

    return scan


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(own, vec_id, v): components floor(scale * x), as long."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.select(
        F.monotonically_increasing_id().alias("own"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("v"),
    ).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return own.filter(fine).select("own", "vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def top_k(rows: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE, shard: int = SHARD, leaf: int = LEAF, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by `every`, the k best other rows."""
    held = cut(whole_vectors(rows, scale))
    total = held.count()
    some = held.filter(F.pmod(F.xxhash64("own"), F.lit(max(total, 1))) < SAMPLE).limit(2 * SAMPLE).select("v").toPandas()["v"]
    size = max(map(len, some), default=0)
    x = np.array([v for v in some if len(v) == size] or np.zeros((0, 1)), float)
    placed = cut(celled(held, median_splits(x, min(cells, -(-total // shard))) if size else []))
    boxes = boxes_of(placed)
    many = F.create_map(*[F.lit(v) for n, (c, m, _, _) in boxes.items() for i, j in zip(c, m) for v in (f"{n} {i}", int(-(-j // shard)))]) if boxes else F.create_map(F.lit(""), F.lit(1))
    name = F.concat_ws(" ", "size", "cell")
    base = placed.filter("size > 0").select(
        "size", "cell", F.pmod(F.xxhash64("own"), F.element_at(many, name)).cast("int").alias("part"), F.lit(0).alias("asks"), "own", "vec_id", "v", F.lit(None).cast("double").alias("floor")
    )
    asked = placed.filter((F.col("size") > 0) & (F.col("vec_id") % every == 0))
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["size", "cell", "part"]

    def look(queries: DataFrame) -> DataFrame:
        both = base.unionByName(queries.withColumn("asks", F.lit(1)))
        dealt = both.repartition(n_parts, *keys).sortWithinPartitions(*keys, "asks").select(*keys, "asks", "own", "vec_id", "v", "floor")
        return dealt.mapInArrow(search(k, leaf), "own long, query_id long, vec_id long, score long")

    w = Window.partitionBy("own", "query_id").orderBy(F.desc("score"), "vec_id")
    first = cut(look(sent(asked.withColumn("floor", F.lit(None).cast("double")), boxes, shard, True)))
    floors = first.withColumn("r", F.row_number().over(w)).filter(F.col("r") == k).select("own", F.col("score").cast("double").alias("floor"))
    both = first.unionByName(look(sent(asked.join(floors, "own", "left").select(*asked.columns, "floor"), boxes, shard, False)))
    return both.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
