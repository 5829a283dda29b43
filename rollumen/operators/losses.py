"""Loss reducers and policy losses over token tables (row_id, t, mask, logp_old, logp_new, advantage)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollumen.operators import policy
from rollumen.operators.masked import clip, masked_mean, masked_sum
from rollumen.plans.order import numbered

AGGREGATIONS = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")
_LOSSES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def add(f):
        _LOSSES[name] = f
        return f

    return add


def policy_loss(name: str) -> Callable[..., DataFrame]:
    if name not in _LOSSES:
        raise ValueError(f"no policy loss {name}; there are {', '.join(sorted(_LOSSES))}")
    return _LOSSES[name]


def names() -> list[str]:
    return sorted(_LOSSES)


def agg_loss(tokens: DataFrame, loss: str = "loss", mode: str = "token-mean", width: int | None = None, scale: float = 1.0) -> DataFrame:
    """One row with `loss`. width: the padded length that seq-mean-token-sum-norm divides by; scale: data-parallel size."""
    rows = tokens.groupBy("row_id").agg(masked_sum(loss).alias("s"), F.sum("mask").alias("n"))
    some = F.col("n") > 0
    if mode == "token-mean":
        out = F.sum("s") / F.nullif(F.sum("n").cast("double"), F.lit(0.0)) * scale
    elif mode == "seq-mean-token-sum":
        out = F.avg(F.when(some, F.col("s"))) * scale
    elif mode == "seq-mean-token-mean":
        out = F.avg(F.when(some, F.col("s") / (F.col("n") + 1e-8))) * scale
    elif mode == "seq-mean-token-sum-norm":
        if width is None:
            raise ValueError("seq-mean-token-sum-norm needs the padded width")
        out = F.sum("s") / width
    else:
        raise ValueError(f"no aggregation {mode}")
    return rows.agg(out.alias("loss"))


def _weighted(loss: Column, tokens: DataFrame) -> Column:
    return loss * F.col("is_weight") if "is_weight" in tokens.columns else loss


def _adv() -> Column:
    return F.col("advantage")


def _diff() -> Column:
    """Log of the probability ratio."""
    return F.col("logp_new") - F.col("logp_old")


def _share(c: Column) -> Column:
    return masked_mean(c.cast("double"))


def _with_metrics(tokens: DataFrame, mode: str, width: int | None, **metrics: Column) -> DataFrame:
    """One row: the reduced loss and metrics, from one aggregation by row and one of the rows."""
    sums = {k: masked_sum(v.cast("double")).alias(k) for k, v in metrics.items()}
    rows = tokens.groupBy("row_id").agg(masked_sum("loss").alias("s"), F.sum("mask").alias("n"), *sums.values())
    some, total = F.col("n") > 0, F.sum("n") + 1e-8
    out = {
        "token-mean": F.sum("s") / F.nullif(F.sum("n").cast("double"), F.lit(0.0)),
        "seq-mean-token-sum": F.avg(F.when(some, F.col("s"))),
        "seq-mean-token-mean": F.avg(F.when(some, F.col("s") / (F.col("n") + 1e-8))),
        "seq-mean-token-sum-norm": F.sum("s") / F.lit(width),
    }[mode]
    return rows.agg(out.alias("loss"), *[(F.sum(k) / total).alias(k) for k in metrics])


@register("vanilla")
def vanilla(tokens: DataFrame, low: float = 0.2, high: float = 0.2, c: float = 3.0, mode: str = "token-mean", width: int | None = None) -> DataFrame:
    """PPO with a clipped ratio, and a bound c for negative advantages."""
    if c <= 1:
        raise ValueError("the bound for negative advantages must be above 1")
    d = clip(_diff(), -20.0, 20.0)
    r = F.exp(d)
    l1, l2, l3 = -_adv() * r, -_adv() * clip(r, 1 - low, 1 + high), -_adv() * c
    worst = F.greatest(l1, l2)
    df = tokens.withColumn("loss", _weighted(F.when(_adv() < 0, F.least(l3, worst)).otherwise(worst), tokens))
    return _with_metrics(df, mode, width, clipfrac=l2 > l1, ppo_kl=-d, clipfrac_lower=(worst > l3) & (_adv() < 0))


@register("gspo")
def gspo(tokens: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """The ratio is that of the row's mean difference; always the mean of rows' means."""
    w = Window.partitionBy("row_id")
    mean = masked_sum(_diff(), window=w) / F.greatest(F.sum("mask").over(w), F.lit(1))
    r = F.exp(F.least(mean, F.lit(10.0)))
    df = tokens.withColumn("_r", r)
    l1, l2 = -_adv() * F.col("_r"), -_adv() * clip(F.col("_r"), 1 - low, 1 + high)
    df = df.withColumn("loss", _weighted(F.greatest(l1, l2), tokens))
    return _with_metrics(df, "seq-mean-token-mean", None, clipfrac=l2 > l1, ppo_kl=-_diff())


@register("sapo")
def sapo(tokens: DataFrame, tau_pos: float = 1.0, tau_neg: float = 1.05) -> DataFrame:
    """A sigmoid gate of the ratio in place of clipping; its slope depends on the sign of the advantage."""
    d = clip(_diff(), -20.0, 20.0)
    tau = F.when(_adv() > 0, tau_pos).otherwise(tau_neg)
    gate = 1 / (1 + F.exp(-tau * (F.exp(d) - 1))) * (4 / tau)
    df = tokens.withColumn("loss", _weighted(-gate * _adv(), tokens))
    return _with_metrics(df, "seq-mean-token-mean", None, ppo_kl=-d)


@register("gpg")
def gpg(tokens: DataFrame, mode: str = "token-mean", width: int | None = None) -> DataFrame:
    return _with_metrics(tokens.withColumn("loss", _weighted(-F.col("logp_new") * _adv(), tokens)), mode, width)


@register("cispo")
def cispo(tokens: DataFrame, low: float = 0.2, high: float = 0.2, mode: str = "token-mean", width: int | None = None) -> DataFrame:
    d = clip(_diff(), -20.0, 20.0)
    r = F.exp(d)
    bounded = clip(r, 1 - low, 1 + high)
    df = tokens.withColumn("loss", _weighted(-bounded * _adv() * F.col("logp_new"), tokens))
    return _with_metrics(df, mode, width, clipfrac=r != bounded, ppo_kl=-d)


@register("geo_mean")
def geo_mean(tokens: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """The geometric mean of a row's clipped ratios times its mean advantage; plain mean over rows."""
    sign = F.signum(_adv())
    bounded = clip(_diff(), -low, high)
    least = sign * F.least(sign * _diff(), sign * bounded)
    df = tokens.withColumn("_least", least)
    rows = df.groupBy("row_id").agg(
        masked_sum("_least").alias("d"), masked_sum("advantage").alias("a"), F.sum("mask").alias("n"),
        masked_sum(((_diff() != bounded) & (_adv() > 0)).cast("double")).alias("c1"), masked_sum(((_diff() != bounded) & (_adv() < 0)).cast("double")).alias("c2"), masked_sum(-_diff()).alias("k"),
    )
    n = F.col("n") + 1e-8
    total = F.sum("n") + 1e-8
    return rows.agg(
        F.avg(-F.col("a") / n * F.exp(F.col("d") / n)).alias("loss"), (F.sum("c1") / total).alias("clipfrac"),
        (F.sum("c2") / total).alias("clipfrac_lower"), (F.sum("k") / total).alias("ppo_kl"),
    )


def _covariance(tokens: DataFrame) -> DataFrame:
    """Adds cov, the product of the centred advantage and log-probability; means over valid tokens."""
    means = tokens.agg(masked_mean("advantage").alias("_ma"), masked_mean("logp_new").alias("_ml"), F.sum("mask").alias("_n"))
    return tokens.crossJoin(F.broadcast(means)).withColumn("cov", (_adv() - F.col("_ma")) * (F.col("logp_new") - F.col("_ml"))).drop("_ma", "_ml")


def top_tokens(tokens: DataFrame, order: list[Column], share: float, total: DataFrame) -> DataFrame:
    """(row_id, t) of the first max(1, int(share * n)) of the tokens, n of all their valid ones. They are numbered over ranges,
    as their number grows with the data."""
    keys = {f"_o{k}": c for k, c in enumerate(order)}
    ranked = numbered(tokens.select(*[c.alias(k) for k, c in keys.items()], "row_id", "t"), [*keys, "row_id", "t"], "_k")
    return ranked.crossJoin(F.broadcast(total)).filter(F.col("_k") < F.greatest(F.floor(F.col("_n") * share), F.lit(1))).select("row_id", "t")


def valid_tokens(tokens: DataFrame) -> DataFrame:
    """One row: _n."""
    return tokens.agg(F.coalesce(F.sum("mask"), F.lit(0)).alias("_n"))


@register("kl_cov")
def kl_cov(tokens: DataFrame, share: float = 0.0002, coef: float = 1.0, mode: str = "token-mean", width: int | None = None) -> DataFrame:
    """The tokens of the largest covariance (ties: lowest row, then position) pay coef * |difference| on top."""
    df = _covariance(tokens)
    best = top_tokens(df.filter("mask > 0"), [-F.round("cov", 9)], share, valid_tokens(tokens)).withColumn("_top", F.lit(True))
    df = df.join(best, ["row_id", "t"], "left")
    loss = -_adv() * F.exp(_diff()) + F.when(F.col("_top"), coef * F.abs(_diff())).otherwise(0.0)
    return _with_metrics(df.withColumn("loss", _weighted(loss, tokens)), mode, width, ppo_kl=F.abs(_diff()))


@register("clip_cov")
def clip_cov(tokens: DataFrame, share: float = 0.0002, lower: float = 1.0, upper: float = 5.0, low: float = 0.2, high: float = 0.2, seed: int = 42, mode: str = "token-mean", width: int | None = None) -> DataFrame:
    """Tokens with a covariance between the bounds that aren't clipped anyway are dropped from the loss, as many as the
    share allows, in the order of the MD5 of seed, row and position."""
    df = _covariance(tokens)
    r = F.exp(_diff())
    l1, l2 = -_adv() * r, -_adv() * clip(r, 1 - low, 1 + high)
    near = df.filter((F.col("mask") > 0) & (F.col("cov") > lower) & (F.col("cov") < upper) & ~(l2 > l1))
    draw = F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col("row_id").cast("string"), F.col("t").cast("string")))
    gone = top_tokens(near, [draw], share, valid_tokens(tokens)).withColumn("_gone", F.lit(True))
    df = df.join(gone, ["row_id", "t"], "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    loss = F.when(F.col("_gone"), 0.0).otherwise(F.greatest(l1, l2))
    return _with_metrics(df.withColumn("loss", _weighted(loss, tokens)), mode, width, clipfrac=F.col("_gone"), ppo_kl=-_diff())


@register("reinforce")
def reinforce(tokens: DataFrame, mode: str = "token-mean", width: int | None = None) -> DataFrame:
    """-log-probability times advantage, with importance weights if there are any."""
    df = tokens.withColumn("loss", _weighted(-F.col("logp_new") * _adv(), tokens))
    return _with_metrics(df, mode, width, ppo_kl=-_diff())


@register("bypass_mode")
def bypass_mode(
    tokens: DataFrame, loss_type: str = "ppo_clip", level: str | None = None, threshold: float = 2.0, normalise: bool = False, modes: str | list[str] | None = None, spec=None,
    mode: str = "token-mean", width: int | None = None, **clipping: float,
) -> DataFrame:
    """The policy against the rollout itself, whose log-probabilities are logp_old: rejection by their ratio to logp_new takes tokens out of the mask, then
    `ppo_clip` (the ratio is the weight, so there is no other) or `reinforce` (with importance weights of `level`, if given). Settings are those of
    policy.rollout_correction()."""
    if loss_type not in ("ppo_clip", "reinforce"):
        raise ValueError(f"no bypass loss {loss_type}; there are ppo_clip and reinforce")
    own = tokens.drop("is_weight", "raw_weight", "kept_mask").withColumn("_old", F.col("logp_old"))
    against = own.withColumn("logp_rollout", F.col("_old")).withColumn("logp_old", F.col("logp_new"))
    held = policy.rollout_correction(against, level, threshold, normalise, modes, spec).withColumn("logp_old", F.col("_old")).withColumn("mask", F.col("kept_mask"))
    if loss_type == "ppo_clip":
        return vanilla(held.drop("is_weight"), mode=mode, width=width, **clipping)
    return reinforce(held if level else held.drop("is_weight"), mode=mode, width=width)


def value_loss(tokens: DataFrame, pred: str, bound: float = 0.5, mode: str = "token-mean", width: int | None = None) -> DataFrame:
    """Half the larger of the squared errors of a prediction and of one held near the old value. Needs value, returns."""
    p = F.col(pred)
    near = clip(p, F.col("value") - bound, F.col("value") + bound)
    e1, e2 = (p - F.col("returns")) ** 2, (near - F.col("returns")) ** 2
    return _with_metrics(tokens.withColumn("loss", 0.5 * F.greatest(e1, e2)), mode, width, clipfrac=e2 > e1)


def actor_step(
    tokens: DataFrame, name: str = "vanilla", mode: str = "token-mean", width: int | None = None, entropy: str | None = None, entropy_coef: float = 0.0,
    ref: str | None = None, kl_mode: str = "k3", kl_coef: float = 0.0, ranks: int = 1, **options,
) -> DataFrame:
    """What an actor's update minimises, in one row: loss = the policy's loss - entropy_coef * entropy + kl_coef * divergence from the reference; with its parts
    (pg_loss, entropy_loss, kl_loss; null where they aren't asked for) and the policy loss's own metrics. entropy and ref name columns of entropies and of the
    reference's log-probabilities. Each part is reduced by `mode` and multiplied by `ranks`, as the ranks' gradients are averaged."""
    reduced = {"mode": mode, "width": width} if name not in ("gspo", "sapo") else {}
    out = policy_loss(name)(tokens, **reduced, **options).withColumn("pg_loss", F.col("loss") * ranks)
    none = F.lit(None).cast("double")
    extra = {"entropy_loss": entropy and F.col(entropy), "kl_loss": ref and policy.kl_penalty(F.col("logp_new"), F.col(ref), kl_mode)}
    for column, value in extra.items():
        if value is None:
            out = out.withColumn(column, none)
        else:
            part = agg_loss(tokens.withColumn("_part", value), "_part", mode, width).select((F.col("loss") * ranks).alias(column))
            out = out.crossJoin(F.broadcast(part))  # one row each
    total = F.col("pg_loss") - F.coalesce(F.col("entropy_loss"), F.lit(0.0)) * entropy_coef + F.coalesce(F.col("kl_loss"), F.lit(0.0)) * kl_coef
    return out.withColumn("loss", total)


def critic_step(tokens: DataFrame, pred: str, bound: float = 0.5, mode: str = "token-mean", width: int | None = None) -> DataFrame:
    """What a critic's update minimises, in one row: loss, clipfrac, and vpred_mean over valid tokens."""
    mean = tokens.agg(masked_mean(pred).alias("vpred_mean"))
    return value_loss(tokens, pred, bound, mode, width).crossJoin(F.broadcast(mean))  # one row each


def sft_loss(tokens: DataFrame, micro_batches: int = 1) -> DataFrame:
    """Token cross-entropy against the next token's mask: the loss at t counts if t + 1 is to be learnt."""
    w = Window.partitionBy("row_id").orderBy("t")
    df = tokens.withColumn("_m", F.lead("mask").over(w)).filter("_m is not null")
    rows = df.groupBy("row_id").agg(masked_sum(-F.col("logp_new"), "_m").alias("s"), F.sum("_m").alias("n"))
    return rows.agg((F.sum("s") / (F.sum("n") + 1e-8) / micro_batches).alias("loss"))


def mixed_loss(tokens: DataFrame, distill: str = "distill_loss", flag: str = "distill_mask") -> DataFrame:
    """Rows with a flag over 0.5 count with their distillation loss, others with `loss`; each kind has its own mean."""
    on = F.col(flag) > 0.5
    return tokens.agg(
        (
            F.coalesce(masked_sum(F.when(on, F.col(distill))) / F.nullif(F.sum(F.when(on, F.col("mask"))).cast("double"), F.lit(0.0)), F.lit(0.0))
            + F.coalesce(masked_sum(F.when(~on, F.col("loss"))) / F.nullif(F.sum(F.when(~on, F.col("mask"))).cast("double"), F.lit(0.0)), F.lit(0.0))
        ).alias("loss")
    )


def entropy_loss(tokens: DataFrame, entropy: str = "entropy", mode: str = "token-mean", width: int | None = None) -> DataFrame:
    """One row with `loss`: the tokens' entropies, aggregated as any loss."""
    return agg_loss(tokens, entropy, mode, width)
