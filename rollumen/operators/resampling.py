"""Sampling with replacement in proportion to weights: draws fall on a line on which every row has a stretch as long as its weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollumen.plans.order import carried, running_sum


def whole_weights(weight: Column, scale: float = 1e8) -> Column:
    """Weights as whole numbers of 1/scale, at least one, so that sums are exact in any order; their total must stay below 2^63."""
    return F.greatest(F.round(weight * scale).cast("long"), F.lit(1))


def draw(number: Column, seed: int) -> Column:
    """60 bits for each draw, by MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed).cast("string"), number.cast("string"))), 1, 15), 16, 10).cast("long")


def resampled(rows: DataFrame, key: str, weight: str, seed: int, count: int | None = None) -> DataFrame:
    """(draw, key): `count` draws (as many as rows, if not given) with replacement, each a row in proportion to its whole weight. Draws and the
    beginnings of the rows' stretches are ranged by their place, and each draw takes the beginning before it: no pair of a draw and another row is made.
    Rows of weight 0 or null are never drawn; without a weight above 0 there are no draws."""
    own = rows.select(key, F.col(weight).cast("long").alias("w")).filter("w > 0")
    line = running_sum(own, [key], "w", "upto").select(key, (F.col("upto") - F.col("w")).alias("place"), "upto")
    total, n = line.agg(F.max("upto"), F.count(F.lit(1))).first()
    if not total:
        return rows.sparkSession.createDataFrame([], f"draw long, {key} {rows.schema[key].dataType.simpleString()}")
    n = rows.count() if count is None else count
    draws = rows.sparkSession.range(n).select((draw(F.col("id"), seed) % F.lit(total)).alias("place"), F.col("id").alias("draw"))
    starts = line.select("place", F.lit(None).cast("long").alias("draw"), F.col(key).alias("row"))
    both = starts.unionByName(draws.withColumn("row", F.lit(None).cast(rows.schema[key].dataType)))
    found = carried(both.withColumn("late", F.col("draw").isNotNull()), ["place", "late", "draw"], "row", "row")
    return found.filter("late").select("draw", F.col("row").alias(key))
