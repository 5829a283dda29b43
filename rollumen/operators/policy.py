"""KL penalties, importance weights and rejection masks: token, sequence and batch level."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from rollumen.operators.masked import clip, masked_mean, masked_sum

SAFE = 20.0
TOKEN_MODES = ("token_k1", "token_k2", "token_k3")
MODES = TOKEN_MODES + tuple(f"seq_{a}_{k}" for a in ("sum", "mean") for k in ("k1", "k2", "k3")) + ("seq_max_k2", "seq_max_k3")


def kl_penalty(logp: Column, ref: Column, mode: str) -> Column:
    """A trailing + has the same value; `full` isn't an estimator of single tokens."""
    d = logp - ref
    mode = mode.removesuffix("+")
    if mode in ("kl", "k1"):
        return d
    if mode == "abs":
        return F.abs(d)
    if mode in ("mse", "k2"):
        return 0.5 * d * d
    if mode in ("low_var_kl", "k3"):
        x = clip(-d, -20.0, 20.0)
        return clip(F.exp(x) - x - 1, -10.0, 10.0)
    raise NotImplementedError(mode)


def apply_kl_penalty(tokens: DataFrame, beta: float, mode: str = "kl") -> tuple[DataFrame, DataFrame]:
    """tokens with reward less beta * kl * mask, and one row with current_kl, the mean over rows of masked means."""
    kl = kl_penalty(F.col("logp_old"), F.col("logp_ref"), mode) * F.col("mask")
    out = tokens.withColumn("_kl", kl).withColumn("reward", F.col("reward") - beta * F.col("_kl"))
    per_row = out.groupBy("row_id").agg(masked_mean("_kl").alias("kl"))
    return out.drop("_kl"), per_row.agg(F.avg("kl").alias("current_kl"))


def adaptive_beta(steps: Column, start: float, target: float, horizon: int) -> Column:
    """steps: array<struct<kl, n>> in order -> array of the coefficient after each step."""
    init = F.struct(F.lit(float(start)).alias("b"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        b = s["b"] * (1 + clip(x["kl"] / target - 1, -0.2, 0.2) * x["n"] / horizon)
        return F.struct(b.alias("b"), F.concat(s["out"], F.array(b)).alias("out"))

    return F.aggregate(steps, init, step, lambda s: s["out"])


def kl_rewards(tokens: DataFrame, ratio: float) -> DataFrame:
    return tokens.withColumn("reward", F.col("reward") - (F.col("logp_old") - F.col("logp_ref")) * ratio)


def _own() -> WindowSpec:
    return Window.partitionBy("row_id")


def _row(c: Column) -> Column:
    return c.over(_own())


def log_ratio(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("log_ratio", F.col("logp_old") - F.col("logp_rollout"))


def importance_weights(tokens: DataFrame, level: str = "token", threshold: float = 2.0, normalise: bool = False) -> DataFrame:
    """Adds raw_weight (before the upper bound) and is_weight, from log_ratio and mask."""
    m = F.col("mask")
    x = F.col("log_ratio") if level == "token" else masked_sum("log_ratio", window=_own())
    out = tokens.withColumn("raw_weight", F.exp(clip(x, -SAFE, SAFE)) * m).withColumn("is_weight", F.least("raw_weight", F.lit(threshold)))
    if not normalise:
        return out
    if level == "token":
        mean = out.agg(masked_mean("is_weight").alias("_mean"))
    else:
        rows = out.groupBy("row_id").agg(masked_mean("is_weight").alias("w"), F.sum("mask").alias("n")).filter("n > 0")
        mean = rows.agg(F.avg("w").alias("_mean"))
    by = F.when(F.col("_mean") > 1e-8, F.col("_mean")).otherwise(1.0)
    return out.crossJoin(F.broadcast(mean)).withColumn("is_weight", F.col("is_weight") / by).drop("_mean")


def importance_metrics(weighted: DataFrame, threshold: float = 2.0) -> DataFrame:
    """One row of token-level metrics of raw_weight: mean, extremes, shares beyond the bounds, std and effective sample
    size of the bounded weights, and statistics of the rows' mean weights."""
    low = 1 / threshold
    w, m = F.col("raw_weight"), F.col("mask")
    bounded = clip(w, low, threshold)
    token = weighted.agg(
        masked_mean(w).alias("mean"),
        F.max(F.when(m > 0, w)).alias("max"),
        F.min(F.when(m > 0, w)).alias("min"),
        masked_mean((w > threshold).cast("double")).alias("fraction_high"),
        masked_mean((w < low).cast("double")).alias("fraction_low"),
        masked_mean(bounded).alias("_m1"),
        masked_mean(bounded * bounded).alias("_m2"),
        F.sum(m).alias("_n"),
    ).select(
        "mean", "max", "min", "fraction_high", "fraction_low",
        F.when(F.col("_n") > 1, F.sqrt(F.greatest(F.col("_m2") - F.col("_m1") ** 2, F.lit(0.0)))).otherwise(0.0).alias("std"),
        ((F.col("_m1") + 1e-8) ** 2 / F.col("_m2")).alias("eff_sample_size"),
    )
    rows = weighted.groupBy("row_id").agg(masked_mean(w).alias("s"))
    seq = rows.agg(
        F.avg("s").alias("seq_mean"),
        F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("seq_std"),
        F.max("s").alias("seq_max"),
        F.min("s").alias("seq_min"),
        F.max(F.abs(F.col("s") - 1)).alias("seq_max_deviation"),
        F.avg((F.col("s") > threshold).cast("double")).alias("seq_fraction_high"),
        F.avg((F.col("s") < low).cast("double")).alias("seq_fraction_low"),
    )
    return token.crossJoin(F.broadcast(seq))  # one row each


def parse_thresholds(modes: list[str], spec: str | float | list) -> dict[str, tuple[float | None, float]]:
    """(lower, upper) for each mode; one value for all, or one each. k1 takes `low_high`, or a single bound whose
    reciprocal is the lower one; other modes have an upper bound only."""
    given = [str(x).strip() for x in (spec if isinstance(spec, (list, tuple)) else str(spec).split(","))]
    given = [x for x in given if x]
    if len(given) not in (1, len(modes)):
        raise ValueError(f"{len(given)} thresholds for {len(modes)} modes")
    out: dict[str, tuple[float | None, float]] = {}
    for mode, text in zip(modes, given * len(modes) if len(given) == 1 else given):
        parts = [float(x) for x in text.split("_")]
        if any(x <= 0 for x in parts):
            raise ValueError(f"threshold of {mode} must be positive: {text}")
        if mode.endswith("k1"):
            out[mode] = (parts[0], parts[1]) if len(parts) > 1 else (1 / parts[0], parts[0])
        else:
            if len(parts) > 1:
                raise ValueError(f"{mode} takes an upper bound only: {text}")
            out[mode] = (None, parts[0])
    return out


def rejection(tokens: DataFrame, modes: str | list[str], spec) -> DataFrame:
    """Adds keep_<mode> for each mode and kept_mask, the mask times all of them. Needs log_ratio and mask."""
    wanted = list(dict.fromkeys(x.strip() for x in (modes.split(",") if isinstance(modes, str) else modes) if x.strip()))
    if unknown := set(wanted) - set(MODES):
        raise ValueError(f"no rejection mode {', '.join(sorted(unknown))}")
    bounds = parse_thresholds(wanted, spec)
    x = clip("log_ratio", -SAFE, SAFE)
    kinds = {"k1": -x, "k2": 0.5 * x * x, "k3": F.exp(x) - 1 - x}
    out, keep = tokens, F.lit(True)
    for mode in wanted:
        level, _, kind = mode.rpartition("_")
        v, valid = kinds[kind], F.col("mask") > 0
        stat = {
            "token": lambda v=v: v,
            "seq_sum": lambda v=v: masked_sum(v, window=_own()),
            "seq_mean": lambda v=v: masked_sum(v, window=_own()) / (_row(F.sum("mask")) + 1e-8),
            "seq_max": lambda v=v, valid=valid: F.coalesce(_row(F.max(F.when(valid, v))), F.lit(0.0)),
        }[level]()
        low, high = bounds[mode]
        own = (stat >= math.log(low)) & (stat <= math.log(high)) if kind == "k1" else stat <= high
        out = out.withColumn(f"keep_{mode}", own)
        keep = keep & F.col(f"keep_{mode}")
    return out.withColumn("kept_mask", F.when(keep, F.col("mask")).otherwise(0))


def rejection_metrics(kept: DataFrame, mode: str | None = None) -> DataFrame:
    """One row: share of valid tokens masked out, and share of rows (with valid tokens, for one mode) that lost any."""
    gone = (~F.col(f"keep_{mode}") if mode else (F.col("kept_mask") == 0)) & (F.col("mask") > 0)
    rows = kept.groupBy("row_id").agg(F.sum("mask").alias("n"), F.count_if(gone).alias("k"))
    if mode:
        seq = F.coalesce(F.avg(F.when(F.col("n") > 0, (F.col("k") > 0).cast("double"))), F.lit(0.0))
    else:
        seq = F.avg((F.col("k") > 0).cast("double"))
    return rows.agg((F.sum("k") / (F.sum("n") + 1e-8)).alias("masked_fraction"), seq.alias("seq_masked_fraction"))


def offpolicy_metrics(tokens: DataFrame) -> DataFrame:
    """One row: perplexities of both policies, KL estimates, differences of log-perplexity, and chi-squared terms."""
    old, roll = F.col("logp_old"), F.col("logp_rollout")
    d = old - roll
    rows = tokens.groupBy("row_id").agg(
        masked_mean(old).alias("a"), masked_mean(roll).alias("b"), masked_sum(d).alias("s"),
        masked_sum(-d).alias("kl"), masked_sum(F.exp(d) - d - 1).alias("k3"),
        masked_sum(F.exp(2 * clip(d, -SAFE, SAFE))).alias("r2"), F.sum("mask").alias("n"),
    )
    total = F.sum("n") + 1e-8
    gap = F.col("b") - F.col("a")
    return rows.agg(
        F.avg(F.exp(-F.col("a"))).alias("training_ppl"),
        F.avg(-F.col("a")).alias("training_log_ppl"),
        F.avg(F.exp(-F.col("b"))).alias("rollout_ppl"),
        F.avg(-F.col("b")).alias("rollout_log_ppl"),
        (F.sum("kl") / total).alias("kl"),
        (F.sum("k3") / total).alias("k3_kl"),
        F.avg(gap).alias("log_ppl_diff"),
        F.avg(F.abs(gap)).alias("log_ppl_abs_diff"),
        F.max(gap).alias("log_ppl_diff_max"),
        F.min(gap).alias("log_ppl_diff_min"),
        F.avg(F.exp(gap)).alias("ppl_ratio"),
        (F.sum("r2") / total - 1).alias("chi2_token"),
        (F.avg(F.exp(2 * clip("s", -SAFE, SAFE))) - 1).alias("chi2_seq"),
    )


def bypass(tokens: DataFrame) -> DataFrame:
    """The rollout's log-probabilities stand in for the old ones."""
    return tokens.withColumn("logp_old", F.col("logp_rollout"))


def reuse_rollout_logprobs(columns: list[str], epochs: int, mini_batch: int, batch: int) -> bool:
    """True if the rollout's log-probabilities can be the old ones: present, one epoch, one update a batch."""
    return "logp_rollout" in columns and epochs == 1 and mini_batch == batch


def rollout_correction(tokens: DataFrame, level: str | None = "token", threshold: float = 2.0, normalise: bool = False, modes: str | list[str] | None = None, spec=None) -> DataFrame:
    """Weights and rejection together: raw_weight and is_weight (1 without a level), kept_mask (the mask without modes).
    No valid token at all is an error."""
    if not tokens.filter("mask > 0").limit(1).count():
        raise ValueError("no valid token")
    own = log_ratio(tokens)
    out = importance_weights(own, level, threshold, normalise) if level else own.withColumn("raw_weight", F.lit(1.0)).withColumn("is_weight", F.lit(1.0))
    return rejection(out, modes, spec) if modes else out.withColumn("kept_mask", F.col("mask"))


def rejection_statistics(tokens: DataFrame, mode: str, spec) -> DataFrame:
    """One row of metrics of a mode's statistic, from log_ratio and mask: mean, extremes and shares beyond the bounds (of rows
    for sequence modes, else of tokens), std of the bounded statistic, and the same of the rows' values; seq_fraction_low is null where a mode has no lower bound."""
    low, high = parse_thresholds([mode], spec)[mode]
    level, _, kind = mode.rpartition("_")
    low, high = (math.log(low), math.log(high)) if kind == "k1" else (None, high)
    x, m = clip("log_ratio", -SAFE, SAFE), F.col("mask")
    v = {"k1": -x, "k2": 0.5 * x * x, "k3": F.exp(x) - 1 - x}[kind]
    rows = tokens.withColumn("_v", v).groupBy("row_id").agg(
        F.sum(F.col("_v") * m).alias("s"), F.sum("mask").alias("n"), F.max(F.when(m > 0, F.col("_v"))).alias("most"), F.min(F.when(m > 0, F.col("_v"))).alias("least"),
        F.sum(clip("_v", 0.0 if low is None else low, high) * m).alias("c1"), F.sum(clip("_v", 0.0 if low is None else low, high) ** 2 * m).alias("c2"),
        F.sum((F.col("_v") > high).cast("double") * m).alias("over"), F.sum((F.col("_v") < (low or 0.0)).cast("double") * m).alias("under"),
    )
    mean = F.col("s") / (F.col("n") + 1e-8)
    value = {"token": mean, "seq_mean": mean, "seq_sum": F.col("s"), "seq_max": F.coalesce("most", F.lit(0.0))}[level]
    rows = rows.withColumn("q", value).withColumn("c", clip("q", 0.0 if low is None else low, high))
    sequence = level != "token"
    total, some = F.sum("n") + 1e-8, F.col("n") > 0
    q = F.when(some, F.col("q"))
    share = lambda c: F.avg(F.when(some, c.cast("double")))
    high_rows, low_rows = share(F.col("q") > high), F.lit(0.0) if low is None else share(F.col("q") < low)
    c1, c2 = ((F.sum(F.col("c") * F.col("n")) / total), (F.sum(F.col("c") ** 2 * F.col("n")) / total)) if sequence else (F.sum("c1") / total, F.sum("c2") / total)
    return rows.agg(
        ((F.sum(F.col("q") * F.col("n")) if sequence else F.sum("s")) / total).alias("mean"),
        (F.max(q) if sequence else F.max("most")).alias("max"),
        (F.min(q) if sequence else F.min("least")).alias("min"),
        (high_rows if sequence else F.sum("over") / total).alias("fraction_high"),
        (low_rows if sequence else F.lit(0.0) if low is None else F.sum("under") / total).alias("fraction_low"),
        F.when(F.sum("n") > 1, F.sqrt(F.greatest(c2 - c1**2, F.lit(0.0)))).otherwise(0.0).alias("std"),
        F.avg(q).alias("seq_mean"),
        F.coalesce(F.stddev_samp(q), F.lit(0.0)).alias("seq_std"),
        F.max(q).alias("seq_max"),
        F.min(q).alias("seq_min"),
        F.max(F.abs(q)).alias("seq_max_deviation"),
        high_rows.alias("seq_fraction_high"),
        (F.lit(None).cast("double") if low is None else low_rows).alias("seq_fraction_low"),
    )


def forbidden_positions(tokens: DataFrame, token: str, ids: list[int]) -> DataFrame:
    """(row_id, positions) of rows with a valid token of the given ids."""
    hit = tokens.filter((F.col("mask") > 0) & F.col(token).isin(list(ids)))
    return hit.groupBy("row_id").agg(F.array_sort(F.collect_list("t")).alias("positions"))


def without_forbidden(tokens: DataFrame, token: str, ids: list[int]) -> DataFrame:
    """The tokens; a row that reaches a valid one of the given ids is an error that names it."""
    where = F.concat(F.lit("forbidden token in row "), F.col("row_id").cast("string"), F.lit(" at "), F.col("t").cast("string"))
    bad = (F.col("mask") > 0) & F.col(token).isin(list(ids))
    return tokens.withColumn(token, F.when(bad, F.raise_error(where).cast(tokens.schema[token].dataType)).otherwise(F.col(token)))
