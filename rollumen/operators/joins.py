"""Join-shaped and window-shaped operators: resume logs, fallback lookups, group references, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollumen.functions.text import empty_or_error
from rollumen.plans.order import running_sum


def compacted(log: DataFrame, answer: str = "model_answer") -> DataFrame:
    """The best record of each sample_uid: no error before error, then the latest (seq). Order: first_seq."""
    w = Window.partitionBy("sample_uid")
    best = F.row_number().over(w.orderBy(empty_or_error(F.col(answer)), F.desc("seq")))
    return log.withColumn("first_seq", F.min("seq").over(w)).withColumn("_k", best).filter("_k = 1").drop("_k")


def remaining(items: DataFrame, log: DataFrame, answer: str = "model_answer") -> DataFrame:
    """Items without a good record."""
    done = log.filter(~empty_or_error(F.col(answer))).select("sample_uid").distinct()
    return items.join(done, "sample_uid", "left_anti")


def last_by(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """The value of the last row of each key."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(out))


def with_category(rows: DataFrame, known: DataFrame) -> DataFrame:
    """category: a row's own, else by its first image, else by query and response, else `unknown`; blanks don't count and
    later duplicates in known (image, query, response, category, seq) win."""
    filled = known.filter(F.length(F.trim("category")) > 0)
    by_image = last_by(filled.filter("image is not null"), ["image"], "seq", "category", "_c1")
    by_text = last_by(filled, ["query", "response"], "seq", "category", "_c2")
    own = F.when(F.length(F.trim("category")) > 0, F.col("category"))
    joined = rows.join(by_image, "image", "left").join(by_text, ["query", "response"], "left")
    return joined.withColumn("category", F.coalesce(own, "_c1", "_c2", F.lit("unknown"))).drop("_c1", "_c2")


def first_success(rows: DataFrame, threshold: float, exclude_self: bool = True) -> DataFrame:
    """Adds other_row: the lowest row_id of the group with a score of at least the threshold, a row itself excluded on
    request. The two lowest are enough, so nothing is joined."""
    good = F.when(F.col("score") >= threshold, F.col("row_id"))
    w = Window.partitionBy("uid")
    lowest = F.min(good).over(w)
    df = rows.withColumn("_a", lowest)
    if not exclude_self:
        return df.withColumnRenamed("_a", "other_row")
    second = F.min(F.when((F.col("score") >= threshold) & (F.col("row_id") != F.col("_a")), F.col("row_id"))).over(w)
    return df.withColumn("_b", second).withColumn("other_row", F.when(F.col("_a") == F.col("row_id"), F.col("_b")).otherwise(F.col("_a"))).drop("_a", "_b")


def islands(df: DataFrame, key: str, order: str, within: str | None = None, out: str = "island") -> DataFrame:
    """Adds island: 0, 1, ... for runs of rows with one key, in order; a key that comes back starts a new one. Without
    `within`, order must be a row number without gaps: the row before is found by an equi-join, and running sums are
    carried across ranges, so no task holds all rows."""
    if within is None:
        before = df.select((F.col(order) + 1).alias(order), F.col(key).alias("_k"), F.lit(True).alias("_has"))
        new = F.when(F.col("_has") & ~F.col(key).eqNullSafe(F.col("_k")), 1).otherwise(0).cast("long")
        return running_sum(df.join(before, order, "left").withColumn("_new", new), [order], "_new", out).drop("_k", "_has", "_new")
    w = Window.partitionBy(within).orderBy(order)
    new = F.when((F.row_number().over(w) > 1) & ~F.col(key).eqNullSafe(F.lag(key).over(w)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def run_counter(df: DataFrame, key: str, order: str, within: str) -> DataFrame:
    """Adds run_pos: the place of a row in its run of equal keys."""
    marked = islands(df, key, order, within, "_i")
    return marked.withColumn("run_pos", F.row_number().over(Window.partitionBy(within, "_i").orderBy(order)) - 1).drop("_i")


def first_eos_mask(tokens: DataFrame, is_eos: Column) -> DataFrame:
    """Adds eos_mask: 1 up to and including a row's first end."""
    w = Window.partitionBy("row_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("eos_mask", (F.coalesce(F.sum(is_eos.cast("int")).over(w), F.lit(0)) == 0).cast("int"))


def position_ids(tokens: DataFrame, mask: str = "mask") -> DataFrame:
    w = Window.partitionBy("row_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("position_id", F.greatest(F.sum(mask).over(w) - 1, F.lit(0)))


def zig_zag(df: DataFrame, order: list[Column], within: str) -> DataFrame:
    """Adds place: of rows ranked by order, even ranks ascending, then odd ranks descending."""
    w = Window.partitionBy(within)
    rank = F.row_number().over(w.orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(w)
    df = df.withColumn("_r", rank).withColumn("_n", n)
    return df.withColumn("place", F.when(F.col("_r") % 2 == 0, F.col("_r") / 2).otherwise(F.col("_n") - 1 - (F.col("_r") - 1) / 2).cast("long")).drop("_r", "_n")


def newest(df: DataFrame, keep: int, by: str = "step", within: str | None = None) -> DataFrame:
    """The rows of the newest `keep`, of each group if there are groups."""
    if within is None:
        return df.orderBy(F.desc(by)).limit(keep)
    w = Window.partitionBy(within).orderBy(F.desc(by))
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= keep).drop("_k")


def lagged_batches(df: DataFrame, batch: str = "batch", within: str = "stream") -> DataFrame:
    """Adds previous: the batch before, for a pipeline that works one step behind."""
    return df.withColumn("previous", F.lag(batch).over(Window.partitionBy(within).orderBy(batch)))
