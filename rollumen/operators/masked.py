"""Masked reductions, and array functions on logits. NaN outside the mask never reaches a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def masked_sum(value, mask="mask", window: WindowSpec | None = None) -> Column:
    """Aggregate (or window aggregate): sum of value * mask where mask > 0."""
    total = F.sum(F.when(_col(mask) > 0, _col(value) * _col(mask)))
    return F.coalesce(total if window is None else total.over(window), F.lit(0.0))


def masked_mean(value, mask="mask") -> Column:
    """Aggregate: masked sum over (mask sum + 1e-8)."""
    return masked_sum(value, mask) / (F.sum(_col(mask)) + 1e-8)


def masked_moments(df: DataFrame, value, mask="mask") -> DataFrame:
    """One row: n, mean, var (unbiased, around the masked mean). var is null for fewer than two valid rows."""
    v, m = _col(value), _col(mask)
    # the first moment is needed by the second, so two passes of partial aggregates; each ends in one row
    mean = df.agg(masked_mean(v, m).alias("mean"), F.sum(m).alias("n"))
    return (
        df.select(F.when(m > 0, v).alias("_v"), m.alias("_m"))
        .crossJoin(F.broadcast(mean))  # one row
        .agg(
            F.max("n").alias("n"),
            F.max("mean").alias("mean"),
            masked_mean((F.col("_v") - F.col("mean")) ** 2, "_m").alias("v0"),
        )
        .select("n", "mean", F.when(F.col("n") > 1, F.col("v0") * F.col("n") / (F.col("n") - 1)).alias("var"))
    )


def masked_whiten(df: DataFrame, value: str, out: str, mask: str = "mask", shift_mean: bool = True) -> DataFrame:
    """df with out = (value - mean) * rsqrt(var + 1e-8) on every row, masked ones too. An error below two valid rows."""
    stats = masked_moments(df, value, mask).select(F.col("mean").alias("_mean"), F.coalesce("var", F.raise_error(F.lit("whitening needs two valid tokens")).cast("double")).alias("_var"))
    white = (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)
    back = F.lit(0.0) if shift_mean else F.col("_mean")
    return df.crossJoin(F.broadcast(stats)).withColumn(out, white + back).drop("_mean", "_var")


def clip(value, low, high) -> Column:
    """Elementwise bounds; a null bound doesn't count."""
    out = _col(value)
    if high is not None:
        out = F.least(out, F.lit(high) if isinstance(high, (int, float)) else high)
    if low is not None:
        out = F.greatest(out, F.lit(low) if isinstance(low, (int, float)) else low)
    return out


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def once(value: Column, use) -> Column:
    """use(value), with value computed once: what stands in a lambda is computed again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def logsumexp(a: Column) -> Column:
    """Of an array of double, shifted by its largest element."""
    return once(F.array_max(a), lambda top: top + F.ln(array_sum(F.transform(a, lambda x: F.exp(x - top)))))


def entropy_from_logits(logits: Column) -> Column:
    return once(logsumexp(logits), lambda lse: lse - array_sum(F.transform(logits, lambda x: F.exp(x - lse) * x)))


def logprob_of(logits: Column, label: Column) -> Column:
    """Log-probability of the 0-based label."""
    return F.get(logits, label) - logsumexp(logits)


def sum_pi_squared(logits: Column) -> Column:
    return F.exp(logsumexp(F.transform(logits, lambda x: x * 2)) - logsumexp(logits) * 2)


def scaled(logits: Column, temperature: float) -> Column:
    return logits if temperature == 1 else F.transform(logits, lambda x: x / temperature)


def add_tail(topk_logp: Column) -> Column:
    """Top-k log-probabilities and the log of what is left of 1."""
    lse = F.least(logsumexp(topk_logp), F.lit(-1e-7))
    return F.concat(topk_logp, F.array(F.ln(-F.expm1(lse))))


def renormalised(topk_logp: Column) -> Column:
    return once(logsumexp(topk_logp), lambda lse: F.transform(topk_logp, lambda x: x - lse))


def kl_divergence(p_log: Column, q_log: Column) -> Column:
    """sum p (log p - log q) of two arrays."""
    return array_sum(F.zip_with(p_log, q_log, lambda p, q: F.exp(p) * (p - q)))


def distillation_divergence(student: Column, teacher: Column, alpha: float, tail: bool = True) -> Column:
    """alpha 0: KL(teacher || student); 1: KL(student || teacher); between: the weighted sum of both against the mixture
    of (1 - alpha) student and alpha teacher."""
    s, t = (add_tail(student), add_tail(teacher)) if tail else (renormalised(student), renormalised(teacher))
    if alpha == 0:
        return kl_divergence(t, s)
    if alpha == 1:
        return kl_divergence(s, t)
    mix = F.zip_with(s, t, lambda x, y: F.ln((1 - alpha) * F.exp(x) + alpha * F.exp(y)))
    return alpha * kl_divergence(t, mix) + (1 - alpha) * kl_divergence(s, mix)
