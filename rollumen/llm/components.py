"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollumen.llm.common import cut


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour of a node to the node's smallest neighbour. large: only neighbours above the node;
    else only those below, and the node itself. A star's centre is aggregated before the exchange, and the join
    back has one row for each node on one side, so a hot centre can be split."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.join(low, "a")
    if large:
        out = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) of long ids -> (node, component), for the nodes that have links; component: the smallest node.

    Null ends and loops are dropped. Each round is written to the shared checkpoint folder."""
    edges = cut(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    sign = None
    while True:
        edges = cut(_step(_step(edges, True), False))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == sign or not now[0]:
            break
        sign = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
