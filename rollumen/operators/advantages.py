"""Advantage estimators over (trajectory x token) tables.

tokens: row_id, uid (group), t, mask, reward, and for some value, logp_old, sum_pi_sq, is_weight. Outcome estimators
work on scored rows (row_id, uid, score, length) and add `advantage`; on_tokens() spreads it over valid tokens. A group
is the rows of one uid; statistics of groups are windows, so nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollumen.plans.scan import keyed_scan
from rollumen.operators.masked import masked_whiten

Estimator = Callable[..., DataFrame]
_ESTIMATORS: dict[str, Estimator] = {}


def register(name: str) -> Callable[[Estimator], Estimator]:
    """Names an estimator. A second, different one of a name is an error."""

    def add(f: Estimator) -> Estimator:
        if _ESTIMATORS.setdefault(name, f) is not f:
            raise ValueError(f"another estimator is registered as {name}")
        return f

    return add


def estimator(name: str) -> Estimator:
    if name not in _ESTIMATORS:
        raise ValueError(f"no estimator {name}; there are {', '.join(sorted(_ESTIMATORS))}")
    return _ESTIMATORS[name]


def names() -> list[str]:
    return sorted(_ESTIMATORS)


def scored(tokens: DataFrame) -> DataFrame:
    """(row_id, uid, score, length): sum of rewards and number of valid tokens."""
    return tokens.groupBy("row_id", "uid").agg(F.sum("reward").alias("score"), F.sum("mask").alias("length"))


def on_tokens(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    return tokens.join(rows.select("row_id", F.col("advantage").alias("_a")), "row_id").withColumn("advantage", F.col("_a") * F.col("mask")).drop("_a")


def _group(c: Column) -> Column:
    return c.over(Window.partitionBy("uid"))


def _n() -> Column:
    return F.count(F.lit(1))


@register("grpo")
def grpo(rows: DataFrame, epsilon: float = 1e-6, by_std: bool = True) -> DataFrame:
    """(s - mean) / (sample std + epsilon); a group of one has mean 0 and std 1."""
    one = _group(_n()) == 1
    mean = F.when(one, 0.0).otherwise(_group(F.avg("score")))
    std = F.when(one, 1.0).otherwise(_group(F.stddev_samp("score")))
    centred = F.col("score") - mean
    return rows.withColumn("advantage", centred / (std + epsilon) if by_std else centred)


@register("grpo_vectorized")
def grpo_vectorized(rows: DataFrame, epsilon: float = 1e-6, by_std: bool = True) -> DataFrame:
    """As grpo, but the variance has a floor of epsilon instead of an addend to the std."""
    n, s1, s2 = _group(_n()), _group(F.sum("score")), _group(F.sum(F.col("score") ** 2))
    var = (s2 - s1 * s1 / n) / F.greatest(n - 1, F.lit(1))
    std = F.when(n == 1, 1.0).otherwise(F.sqrt(F.greatest(var, F.lit(epsilon))))
    centred = F.col("score") - F.when(n == 1, 0.0).otherwise(s1 / n)
    return rows.withColumn("advantage", centred / (std + epsilon) if by_std else centred)


@register("grpo_passk")
def grpo_passk(rows: DataFrame, epsilon: float = 1e-6, by_std: bool = True) -> DataFrame:
    """Only the best row of a group (the lowest row_id among equals) gets best - second best; a group of one is an error."""
    w = Window.partitionBy("uid").orderBy(F.desc("score"), "row_id")
    first, second = (F.nth_value("score", k).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for k in (1, 2))
    n = _group(_n())
    gap = first - second
    if by_std:
        gap = gap / (_group(F.stddev_samp("score")) + epsilon)
    small = F.raise_error(F.lit("pass@k needs groups of two rows at least")).cast("double")
    return rows.withColumn("advantage", F.when(n < 2, small).when(F.row_number().over(w) == 1, gap).otherwise(0.0))


@register("rloo")
def rloo(rows: DataFrame) -> DataFrame:
    """s minus the mean of the others; a group of one keeps its score."""
    n = _group(_n())
    return rows.withColumn("advantage", F.when(n > 1, (F.col("score") - _group(F.avg("score"))) * n / F.nullif(n - 1, F.lit(0))).otherwise(F.col("score")))


@register("rloo_vectorized")
def rloo_vectorized(rows: DataFrame) -> DataFrame:
    """As rloo, but a group of one gets 0."""
    n = _group(_n())
    return rows.withColumn("advantage", F.when(n > 1, (n * F.col("score") - _group(F.sum("score"))) / F.greatest(n - 1, F.lit(1))).otherwise(0.0))


@register("opo")
def opo(rows: DataFrame) -> DataFrame:
    """s minus the length-weighted mean of the group; 0 for the baseline of a group of one."""
    base = _group(F.sum(F.col("length") * F.col("score"))) / F.nullif(_group(F.sum("length")).cast("double"), F.lit(0.0))
    return rows.withColumn("advantage", F.col("score") - F.when(_group(_n()) == 1, 0.0).otherwise(base))


@register("gpg")
def gpg(rows: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """alpha (s - mean) / f_norm with alpha = rows / rows of a score other than 0, over the whole batch."""
    counts = rows.agg(_n().alias("_n"), F.count_if(F.col("score") != 0).alias("_k"))
    mean = F.when(_group(_n()) == 1, 0.0).otherwise(_group(F.avg("score")))
    alpha = F.col("_n") / F.greatest("_k", F.lit(1))
    return rows.withColumn("_c", F.col("score") - mean).crossJoin(F.broadcast(counts)).withColumn("advantage", alpha * F.col("_c") / f_norm).drop("_c", "_n", "_k")


@register("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(tokens: DataFrame) -> DataFrame:
    """s - group mean on every token, whitened over the batch's valid tokens, times the mask."""
    rows = scored(tokens).withColumn("advantage", F.col("score") - F.when(_group(_n()) == 1, 0.0).otherwise(_group(F.avg("score"))))
    spread = tokens.join(rows.select("row_id", F.col("advantage").alias("_raw")), "row_id")
    return masked_whiten(spread, "_raw", "_white").withColumn("advantage", F.col("_white") * F.col("mask")).drop("_raw", "_white")


@register("gae")
def gae(tokens: DataFrame, gamma: float = 1.0, lam: float = 0.95, whiten: bool = True) -> DataFrame:
    """Generalised advantages from the last token of a row to the first; a masked token carries the next value and advantage on.
    Adds returns (advantage + value) and advantage (whitened over the batch's valid tokens)."""

    def step(s: tuple, mask, reward: float, value: float) -> tuple:
        if not mask > 0:
            return s, s[1]
        a = reward + gamma * s[0] - value + gamma * lam * s[1]
        return (value, a), a

    flat = keyed_scan(tokens, ["row_id"], [F.desc("t")], ["mask", "reward", "value"], lambda: (0.0, 0.0), step, "_a double").withColumn("returns", F.col("_a") + F.col("value"))
    return (masked_whiten(flat, "_a", "advantage") if whiten else flat.withColumn("advantage", F.col("_a"))).drop("_a")


@register("reinforce_plus_plus")
def reinforce_plus_plus(tokens: DataFrame, gamma: float = 1.0, whiten: bool = True) -> DataFrame:
    """Discounted reward to go, cut after a masked token; whitened, times the mask."""

    def step(run: float, mask, reward: float) -> tuple:
        r = reward + gamma * run
        return r * mask, r

    flat = keyed_scan(tokens, ["row_id"], [F.desc("t")], ["mask", "reward"], lambda: 0.0, step, "returns double")
    white = masked_whiten(flat, "returns", "_w") if whiten else flat.withColumn("_w", F.col("returns"))
    return white.withColumn("advantage", F.col("_w") * F.col("mask")).drop("_w")


def reward_to_go(tokens: DataFrame, out: str = "returns") -> DataFrame:
    w = Window.partitionBy("row_id").orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    return tokens.withColumn(out, F.sum(F.col("reward") * F.col("mask")).over(w))


@register("remax")
def remax(tokens: DataFrame, baselines: DataFrame) -> DataFrame:
    """Reward to go less the prompt's baseline on valid tokens. baselines: uid, baseline."""
    return reward_to_go(tokens).join(baselines, "uid").withColumn("advantage", F.col("returns") - F.col("baseline") * F.col("mask")).drop("baseline")


def _path_variance(tokens: DataFrame) -> DataFrame:
    """Adds w_sum, the running sum over valid tokens of 1 - 2 pi + sum of pi squared (times the squared IS weight)."""
    w = 1 - 2 * F.exp("logp_old") + F.col("sum_pi_sq")
    if "is_weight" in tokens.columns:
        w = w * F.col("is_weight") ** 2
    run = Window.partitionBy("row_id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.withColumn("w_sum", F.sum(w * F.col("mask")).over(run))


def _zero_tail(df: DataFrame, place: str) -> Column:
    """True where a group's only longest row goes on beyond the second longest."""
    lengths = df.groupBy("uid", "row_id").agg(F.sum("mask").alias("_len"))
    w = Window.partitionBy("uid").orderBy(F.desc("_len"), "row_id")
    second = F.nth_value("_len", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = lengths.withColumn("_second", second).withColumn("_only", (F.row_number().over(w) == 1) & (F.col("_len") > F.col("_second")))
    return df.join(marked.filter("_only").select("row_id", "_second"), "row_id", "left").withColumn("_tail", F.coalesce(F.col(place) >= F.col("_second"), F.lit(False))).drop("_second")


@register("optimal_token_baseline")
def optimal_token_baseline(tokens: DataFrame, zero_tail: bool = False) -> DataFrame:
    """Reward to go less sum(G W) / (sum(W) + 1e-8) over the group's valid tokens of the same position; groups of one
    row have baseline 0."""
    df = _path_variance(reward_to_go(tokens))
    at = Window.partitionBy("uid", "t")
    base = F.sum(F.col("returns") * F.col("w_sum") * F.col("mask")).over(at) / (F.sum(F.col("w_sum") * F.col("mask")).over(at) + 1e-8)
    size = df.groupBy("uid").agg(F.count_distinct("row_id").alias("_rows"))
    df = df.withColumn("_base", base).join(size, "uid")
    df = df.withColumn("_base", F.when(F.col("_rows") == 1, 0.0).otherwise(F.col("_base")))
    if zero_tail:
        df = _zero_tail(df, "t")
        df = df.withColumn("_base", F.when(F.col("_tail"), 0.0).otherwise(F.col("_base"))).drop("_tail")
    return df.withColumn("advantage", (F.col("returns") - F.col("_base")) * F.col("mask")).drop("_base", "_rows", "w_sum")


@register("tir_optimal_token_baseline")
def tir_optimal_token_baseline(tokens: DataFrame, zero_tail: bool = True) -> DataFrame:
    """As optimal_token_baseline, aligned by the k-th valid token; rows without any don't count for their group."""
    df = _path_variance(reward_to_go(tokens))
    order = Window.partitionBy("row_id", "mask").orderBy("t")
    valid = df.filter("mask > 0").withColumn("_k", F.row_number().over(order) - 1)
    at = Window.partitionBy("uid", "_k")
    base = F.sum(F.col("returns") * F.col("w_sum")).over(at) / (F.sum("w_sum").over(at) + 1e-8)
    size = valid.groupBy("uid").agg(F.count_distinct("row_id").alias("_rows"))
    valid = valid.withColumn("_base", base).join(size, "uid")
    valid = valid.withColumn("_base", F.when(F.col("_rows") == 1, 0.0).otherwise(F.col("_base")))
    if zero_tail:
        valid = _zero_tail(valid, "_k")
        valid = valid.withColumn("_base", F.when(F.col("_tail"), 0.0).otherwise(F.col("_base"))).drop("_tail")
    done = valid.select(*df.columns, (F.col("returns") - F.col("_base")).alias("advantage"))
    masked = df.filter("mask = 0").withColumn("advantage", F.lit(0.0))
    return done.unionByName(masked).drop("w_sum")


def reweights(rows: DataFrame, method: str = "pow", power: float = 2.0) -> DataFrame:
    """Adds weight for preference-filtered resampling: |s|^power, extremes only, or the best against the rest."""
    s = F.col("score")
    if method == "pow":
        return rows.withColumn("weight", F.abs(s) ** power + 1e-8)
    ends = rows.agg(F.max("score").alias("_hi"), F.min("score").alias("_lo"))
    both = rows.crossJoin(F.broadcast(ends))
    if method == "max_min":
        w = F.when((s == F.col("_hi")) | (s == F.col("_lo")), 1.0).otherwise(0.0)
    elif method == "max_random":
        w = F.when(s == F.col("_hi"), 0.4).otherwise(0.1)
    else:
        raise ValueError(f"no reweighting method {method}")
    return both.withColumn("weight", w + 1e-8).drop("_hi", "_lo")
