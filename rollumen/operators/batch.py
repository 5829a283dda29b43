"""Batch algebra on tables with an explicit row_id, 0 to N - 1. Row order is that of row_id; results number rows anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollumen.plans.order import numbered


def columns(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """keep and row_id; None keeps all. A missing column is an error."""
    return df if keep is None else df.select("row_id", *[c for c in keep if c != "row_id"])


def pop(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(popped columns, the rest), both with row_id."""
    return columns(df, names), df.drop(*[c for c in names if c != "row_id"])


def renamed(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} columns for {len(new)} names")
    if missing := set(old) - set(df.columns):
        raise KeyError(f"no columns {', '.join(sorted(missing))}")
    return df.withColumnsRenamed(dict(zip(old, new)))


def _place(row, length: int, start, stop, step: int):
    """Python's rule for the rows of a slice: (chosen, place in the result)."""
    a, b, s = slice(start, stop, step).indices(length)
    n = len(range(a, b, s))
    place = (row - a) / s
    return (F.pmod(row - a, F.lit(abs(s))) == 0) & (place >= 0) & (place < n), place.cast("long")


def sliced(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, length: int | None = None) -> DataFrame:
    """Rows of a slice, numbered anew; negative bounds and steps as in Python. length: N, counted if not given."""
    chosen, place = _place(F.col("row_id"), df.count() if length is None else length, start, stop, step)
    return df.filter(chosen).withColumn("row_id", place)


def gathered(df: DataFrame, index: DataFrame) -> DataFrame:
    """index (pos, row_id): rows in the order of pos, as often as named."""
    return df.join(index, "row_id").withColumn("row_id", F.col("pos")).drop("pos")


def where(df: DataFrame, condition) -> DataFrame:
    """Rows of a boolean mask, numbered anew by a running count over ranges of row_id."""
    from rollumen.plans.order import numbered

    return numbered(df.filter(condition), ["row_id"], "row_id")


def inverse(index: DataFrame) -> DataFrame:
    """The inverse of a permutation (pos, row_id)."""
    return index.select(F.col("row_id").alias("pos"), F.col("pos").alias("row_id"))


def repeated(df: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """a a b b, or a b a b; adds copy."""
    many = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        return many.withColumn("row_id", F.col("row_id") * times + F.col("copy"))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return many.crossJoin(F.broadcast(n)).withColumn("row_id", F.col("copy") * F.col("_n") + F.col("row_id")).drop("_n")


def sample_repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column says; 0 drops it. Adds copy; order is (row_id, copy)."""
    return df.filter(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(times) - 1)))


def unfolded(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Arrays of the keys are cut into n equal parts, one to a row; other columns repeat."""
    part = lambda c: F.slice(c, F.col("chunk") * (F.size(c) / n).cast("int") + 1, (F.size(c) / n).cast("int"))
    many = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return many.withColumns({c: part(F.col(c)) for c in keys}).withColumn("row_id", F.col("row_id") * n + F.col("chunk"))


def folded(df: DataFrame, size: int, values: list[str]) -> DataFrame:
    """`size` neighbouring rows become one with arrays."""
    rows = df.groupBy(F.floor(F.col("row_id") / size).alias("row_id")).agg(F.array_sort(F.collect_list(F.struct("row_id", *values))).alias("x"))
    return rows.select("row_id", *[F.col(f"x.{c}").alias(c) for c in values])


def chunks(df: DataFrame, k: int, length: int, uneven: str = "error") -> DataFrame:
    """Adds chunk, k equal parts; an uneven split is an error, or, with uneven="rest", what is over makes further chunks of that size;
    fewer rows than k are an error then too."""
    if uneven not in ("error", "rest"):
        raise ValueError(f"uneven is error or rest, not {uneven}")
    if length % k and (uneven == "error" or length < k):
        raise ValueError(f"{length} rows don't split into {k} equal chunks")
    return df.withColumn("chunk", F.floor(F.col("row_id") / max(1, length // k)))


def split(df: DataFrame, size: int) -> DataFrame:
    """Adds chunk; the last can be short."""
    return df.withColumn("chunk", F.floor(F.col("row_id") / size))


def padded(df: DataFrame, divisor: int, length: int) -> DataFrame:
    """Rows repeated from the head, over and over, until the count divides; adds is_pad."""
    pad = -length % divisor
    own = df.withColumn("is_pad", F.lit(False))
    if not pad or not length:
        return own
    rounds = -(-pad // length)
    extra = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("row_id", F.col("_k") * length + F.col("row_id"))
    extra = extra.filter(F.col("row_id") < pad).withColumn("row_id", F.col("row_id") + length).drop("_k").withColumn("is_pad", F.lit(True))
    return own.unionByName(extra)


def padded_by_edge(df: DataFrame, pad: int, length: int, first: bool = True) -> DataFrame:
    """pad copies of the first row, or of the last one."""
    edge = df.filter(F.col("row_id") == (0 if first else length - 1)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(pad - 1)))) if pad else None
    own = df.withColumn("is_pad", F.lit(False))
    return own if edge is None else own.unionByName(edge.withColumn("row_id", F.col("_k") + length).drop("_k").withColumn("is_pad", F.lit(True)))


def unpadded(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_pad")).drop("is_pad")


def concatenated(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Tables and their lengths, one after the other."""
    out, at = None, 0
    for df, n in parts:
        moved = df.withColumn("row_id", F.col("row_id") + at)
        out, at = moved if out is None else out.unionByName(moved), at + n
    return out


def zipped(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns side by side, by row_id. Columns of both must be equal (nulls and NaN equal themselves), else an error."""
    both = [c for c in a.columns if c in b.columns and c != "row_id"]
    other = b.withColumnsRenamed({c: f"_r_{c}" for c in both})
    out = a.join(other, "row_id", "full")
    for c in both:
        out = out.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(a.schema[c].dataType)))
    return out.drop(*[f"_r_{c}" for c in both])


def mini_batches(df: DataFrame, size: int, length: int, epochs: int = 1, seed: int | None = None) -> DataFrame:
    """Adds epoch, batch and position; a seed deals rows in the order of a hash of seed, epoch and row."""
    if length % size:
        raise ValueError(f"{length} rows don't divide into batches of {size}")
    many = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        place = F.col("row_id")
    else:
        dealt = many.withColumn("_h", F.xxhash64(F.lit(seed), "epoch", "row_id"))
        many = numbered(dealt, ["epoch", "_h", "row_id"], "_n").drop("_h")
        place = F.col("_n") - F.col("epoch") * length  # every epoch has all rows
    many = many.withColumn("_p", place).drop("_n")
    return many.withColumn("batch", F.floor(F.col("_p") / size)).withColumn("position", F.col("_p") % size).drop("_p")


def sampled(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """The first n rows, or the n of the lowest seeded hash."""
    order = [F.col("row_id")] if seed is None else [F.xxhash64(F.lit(seed), "row_id"), F.col("row_id")]
    return df.orderBy(*order).limit(n)


def exact_split(df: DataFrame, n: int, length: int) -> DataFrame:
    if not isinstance(n, int) or n < 1 or length % n:
        raise ValueError(f"{length} rows don't split exactly into {n}")
    return df.withColumn("split", F.floor(F.col("row_id") / (length // n)))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows by row_id whose values differ, nulls and NaN being equal to themselves."""
    cols = [c for c in a.columns if c != "row_id"]
    other = b.select("row_id", *[F.col(c).alias(f"_r_{c}") for c in cols], F.lit(True).alias("_there"))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return a.withColumn("_here", F.lit(True)).join(other, "row_id", "full").filter(F.col("_here").isNull() | F.col("_there").isNull() | ~same).select("row_id")


def assigned(df: DataFrame, name: str, value) -> DataFrame:
    """A column of one value for all rows."""
    return df.withColumn(name, F.lit(value))


def assigned_each(df: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """A column of one value for each row, from values (row_id, name)."""
    return df.join(values.select("row_id", name), "row_id")


def lists_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of each key as one row of lists, one for each column, all in the same order."""
    rest = [c for c in df.columns if c not in (key, order)]
    got = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("_x"))
    return got.select(key, *[F.col(f"_x.{c}").alias(c) for c in (order, *rest)])


def auto_padded(df: DataFrame, divisor: int, length: int, enabled: bool) -> DataFrame:
    """padded() where the switch is on; else the rows as they are, none of them padding."""
    return padded(df, divisor, length) if enabled else df.withColumn("is_pad", F.lit(False))


def varied_groups(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Rows of the groups in which the metric takes more than one value."""
    some = df.groupBy(group).agg(F.min(metric).alias("_a"), F.max(metric).alias("_b")).filter("_a <> _b").select(group)
    return df.join(some, group, "left_semi")


def replica_batches(df: DataFrame, key: str, replicas: int, size: int, length: int, seed: int | None = None, epoch: int = 0) -> DataFrame:
    """Adds replica, batch and position: rows in the order of key, or of the MD5 of seed, epoch and key, are dealt round by
    round to the replicas; batches that not every replica can fill are dropped."""
    own = df if seed is None else df.withColumn("_h", F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.lit(epoch).cast("string"), F.col(key).cast("string"))))
    out = numbered(own, ([] if seed is None else ["_h"]) + [key], "_n").filter(F.col("_n") < length - length % (replicas * size))
    place = F.floor(F.col("_n") / replicas)
    return out.withColumn("replica", F.col("_n") % replicas).withColumn("batch", F.floor(place / size)).withColumn("position", place % size).drop("_n", "_h")


def traced(df: DataFrame, step: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each step, by the MD5 of seed and key."""
    h = F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col(key).cast("string")))
    w = Window.partitionBy(step).orderBy("_h", key)
    return df.withColumn("_h", h).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_h", "_k")


def shared_prefixes(df: DataFrame, group: str, order: str, prefix: str, suffix: str) -> DataFrame:
    """Adds offset and position: where a row's suffix begins in its group's packed sequence, the shared prefix first, and the
    position it restarts at, the prefix's length."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.col(prefix) + F.coalesce(F.sum(suffix).over(w), F.lit(0))).withColumn("position", F.col(prefix))
