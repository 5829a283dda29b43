"""Metrics, batch algebra, joins and windows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollumen.operators import batch as b
from rollumen.operators import joins as j
from rollumen.operators import masked
from rollumen.operators import metrics as m
from rollumen.plans.domain import ROWS, TOK0, scores_of, table, token_lines
from rollumen.queries.policy import r4, rounded

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# metrics -------------------------------------------------------------------------------------------------------------

_JUDGED = "j AS (SELECT d.doc_id, d.lang, d.source, CASE WHEN l.quality = 1 THEN ' Yes' ELSE 'no' END AS judge, CASE WHEN l.toxic = 1 THEN 'yes' ELSE 'no' END AS gold FROM documents d JOIN labels l USING (doc_id))"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    lab = table(spark, sf_dir, "labels")
    return docs.join(lab, "doc_id").select(
        "doc_id", "lang", "source", F.when(F.col("quality") == 1, " Yes").otherwise("no").alias("judge"), F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("gold")
    )


@query(
    "benchmark_accuracy",
    f"""WITH {_JUDGED} SELECT lang AS category, CAST(sum(CASE WHEN lower(trim(judge)) = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total,
      round(avg(CASE WHEN lower(trim(judge)) = 'yes' THEN 1.0 ELSE 0 END), 4) + 0.0 AS accuracy FROM j GROUP BY GROUPING SETS ((lang), ())""",
)
def benchmark_accuracy(spark, sf_dir):
    return rounded(m.accuracy(judged(spark, sf_dir), "lang"), "category", "correct", "total")


@query(
    "two_part_accuracy",
    f"""WITH {_JUDGED} SELECT round((coalesce(avg(CASE WHEN lang = 'en' THEN CASE WHEN lower(trim(judge)) = 'yes' THEN 1.0 ELSE 0 END END), 0)
      + coalesce(avg(CASE WHEN lang = 'fr' THEN CASE WHEN lower(trim(judge)) = 'yes' THEN 1.0 ELSE 0 END END), 0)) / 2, 4) + 0.0 AS accuracy FROM j""",
)
def two_part(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "2D").when(F.col("lang") == "fr", "3D")
    return rounded(m.two_part_accuracy(judged(spark, sf_dir).withColumn("type", kind)))


@query(
    "binary_metrics",
    f"""WITH {_JUDGED}, c AS (SELECT gold, lower(trim(judge)) = 'yes' AS ok FROM j),
    n AS (SELECT count(*) FILTER (WHERE gold = 'yes' AND ok) AS tp, count(*) FILTER (WHERE gold = 'no' AND NOT ok) AS fp, count(*) FILTER (WHERE gold = 'yes' AND NOT ok) AS fn, count(*) AS al,
      avg(CASE WHEN gold = 'yes' THEN 1.0 ELSE 0 END) AS yr FROM c)
    SELECT tp, fp, fn, al - tp - fp - fn AS tn, round((al - fp - fn) / al, 4) + 0.0 AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) + 0.0 AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) + 0.0 AS recall,
      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) + 0.0 AS f1, round(yr, 4) + 0.0 AS yes_ratio FROM n""",
)
def binary(spark, sf_dir):
    rows = judged(spark, sf_dir).select("gold", m.is_correct(F.col("judge")).alias("correct"))
    return rounded(m.binary_metrics(rows), "tp", "fp", "fn", "tn")


@query(
    "data_metrics",
    f"""WITH {ROWS} SELECT round(avg(CASE WHEN length > 0 THEN score END), 4) + 0.0 AS score_mean, round(max(CASE WHEN length > 0 THEN score END), 4) + 0.0 AS score_max, round(min(CASE WHEN length > 0 THEN score END), 4) + 0.0 AS score_min,
      round(avg(CASE WHEN length > 0 THEN score / 2 END), 4) + 0.0 AS reward_mean, round(max(CASE WHEN length > 0 THEN score / 2 END), 4) + 0.0 AS reward_max, round(min(CASE WHEN length > 0 THEN score / 2 END), 4) + 0.0 AS reward_min,
      round(avg(length), 4) + 0.0 AS length_mean, CAST(max(length) AS DOUBLE) AS length_max, CAST(min(length) AS DOUBLE) AS length_min, round(avg(CASE WHEN length = 6 THEN 1.0 ELSE 0 END), 4) + 0.0 AS length_clip_ratio,
      round(avg(CASE WHEN length > 0 THEN length END), 4) + 0.0 AS live_length_mean, round(avg(CASE WHEN length = 0 THEN 1.0 ELSE 0 END), 4) + 0.0 AS aborted_ratio, round(avg(uid % 100), 4) + 0.0 AS prompt_length_mean FROM sc""",
)
def data_metrics(spark, sf_dir):
    rows = scores_of(spark, sf_dir).select("score", (F.col("score") / 2).alias("reward"), "length", (F.col("uid") % 100).alias("prompt_length"))
    return rounded(m.data_metrics(rows, 6))


@query(
    "critic_metrics",
    f"""WITH {TOK0} SELECT round(avg(reward - 0.5) FILTER (WHERE mask > 0), 4) + 0.0 AS advantage_mean, round(avg(value) FILTER (WHERE mask > 0), 4) + 0.0 AS value_mean,
      round(1 - var_samp(reward - value) FILTER (WHERE mask > 0) / (var_samp(reward) FILTER (WHERE mask > 0) + 1e-5), 4) + 0.0 AS vf_explained_var FROM tok0""",
)
def critic(spark, sf_dir):
    tok = token_lines(spark, sf_dir).withColumn("advantage", F.col("reward") - 0.5).withColumn("returns", F.col("reward"))
    rows = tok.groupBy("row_id").agg(F.sum("reward").alias("score"), F.sum("reward").alias("reward"), F.sum("mask").alias("length"), F.lit(1).alias("prompt_length"))
    return rounded(m.data_metrics(rows, 6, tok).select("advantage_mean", "value_mean", "vf_explained_var"))


@query(
    "variance_proxy",
    f"""WITH {TOK0}, r AS (SELECT sum((reward - 0.5) * mask) / (sum(mask) + 1e-8) AS a, sum((1 - 2 * exp(logp_old) + sum_pi_sq) * mask) AS w FROM tok0 GROUP BY row_id),
    g AS (SELECT avg(a * a * greatest(w, 0)) AS p, avg(a * a) AS ea, avg(w) AS ew, count(*) AS n FROM r)
    SELECT round(0.01, 4) + 0.0 AS signal, round(p, 4) + 0.0 AS total_power, round(greatest((p - 0.01) / (n - 1), 0), 4) + 0.0 AS pure_noise, round(ea, 4) + 0.0 AS expected_a_squared, round(ew, 4) + 0.0 AS expected_w FROM g""",
)
def variance_proxy(spark, sf_dir):
    return rounded(m.variance_proxy(token_lines(spark, sf_dir).withColumn("advantage", F.col("reward") - 0.5), 0.1))


_VAL = "v AS (SELECT o_orderpriority AS data_source, o_custkey AS uid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, floor(o_totalprice / 1000) AS value, o_orderstatus AS pred FROM orders)"


def validation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(F.col("o_orderpriority").alias("data_source"), F.col("o_custkey").alias("uid"), pos.alias("pos"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("value"), F.col("o_orderstatus").alias("pred"))


@query(
    "validation_mean_std",
    f"""WITH {_VAL}, p AS (SELECT data_source, uid, avg(value) AS a, stddev_pop(value) AS s, count(*) AS n FROM v GROUP BY data_source, uid)
    SELECT data_source, 'mean@' || n AS metric, round(avg(a), 4) + 0.0 AS value FROM p GROUP BY data_source, n UNION ALL SELECT data_source, 'std@' || n, round(avg(s), 4) + 0.0 FROM p WHERE n > 1 GROUP BY data_source, n""",
)
def validation_mean_std(spark, sf_dir):
    return rounded(m.mean_std_at_n(validation_rows(spark, sf_dir)), "data_source", "metric")


@query("validation_bootstrap")
def validation_bootstrap(spark, sf_dir):
    """Resampling with numpy's generator; tests hold it against a loop."""
    return rounded(m.validation_metrics(validation_rows(spark, sf_dir)), "data_source", "metric")


@query(
    "validation_best_at_k",
    f"""WITH {_VAL}, r AS (SELECT data_source, uid, value, row_number() OVER (PARTITION BY data_source, uid ORDER BY value, pos) AS i, count(*) OVER (PARTITION BY data_source, uid) AS n FROM v)
    SELECT data_source, uid, round(sum(value * (pow(i / n, 4) - pow((i - 1) / n, 4))), 4) + 0.0 AS best, round(sum(value * (pow((n - i + 1) / n, 4) - pow((n - i) / n, 4))), 4) + 0.0 AS worst FROM r GROUP BY data_source, uid""",
)
def best_at_k(spark, sf_dir):
    return rounded(m.best_at_k(validation_rows(spark, sf_dir), 4), "data_source", "uid")


@query(
    "majority_vote",
    f"""WITH {_VAL}, c AS (SELECT uid, pred, count(*) AS n, min(pos) AS p, arg_min(value, pos) AS value FROM v GROUP BY uid, pred), k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, p) AS k FROM c)
    SELECT uid, pred, value FROM k WHERE k = 1""",
)
def majority_vote(spark, sf_dir):
    return m.majority_vote(validation_rows(spark, sf_dir))


_METRIC = "me AS (SELECT CAST(event_id AS BIGINT) AS step, CASE event_type WHEN 'click' THEN 'actor/loss_max' WHEN 'view' THEN 'timing_s/min' WHEN 'error' THEN 'minmax_diff' WHEN 'signup' THEN 'critic/score/mean' ELSE 'lr' END AS name, value FROM events)"


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    name = F.when(t == "click", "actor/loss_max").when(t == "view", "timing_s/min").when(t == "error", "minmax_diff").when(t == "signup", "critic/score/mean").otherwise("lr")
    return e.select(F.col("event_id").alias("step"), name.alias("name"), "value")


@query(
    "metric_reduce_by_name",
    f"WITH {_METRIC} SELECT name, round(CASE WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) ELSE avg(value) END, 4) + 0.0 AS value FROM me GROUP BY name",
)
def reduce_by_name(spark, sf_dir):
    return rounded(m.reduce_by_name(metric_rows(spark, sf_dir)), "name")


@query(
    "metric_reduce_by_type",
    f"WITH {_METRIC} SELECT name, round(CASE name WHEN 'lr' THEN sum(value) WHEN 'minmax_diff' THEN min(value) WHEN 'actor/loss_max' THEN max(value) ELSE avg(value) END, 4) + 0.0 AS value FROM me GROUP BY name",
)
def reduce_by_type(spark, sf_dir):
    n = F.col("name")
    kind = F.when(n == "lr", "SUM").when(n == "minmax_diff", "MIN").when(n == "actor/loss_max", "MAX").otherwise("MEAN")
    return rounded(m.reduce_by_type(metric_rows(spark, sf_dir).withColumn("agg", kind)), "name")


@query(
    "metric_windowed",
    f"""WITH {_METRIC} SELECT CAST(floor(step / 100) AS BIGINT) AS "window", name, round(CASE WHEN name LIKE 'timing_s/%' THEN sum(value) WHEN name LIKE '%mean%' OR name LIKE '%avg%' THEN avg(value) WHEN name LIKE '%max%' THEN max(value) ELSE arg_max(value, step) END, 4) + 0.0 AS value
    FROM me GROUP BY floor(step / 100), name""",
)
def metric_windowed(spark, sf_dir):
    return rounded(m.windowed(metric_rows(spark, sf_dir), 100), "window", "name")


_SAMPLES = "sa AS (SELECT user_id, value AS seconds, CAST(floor(event_id / 100) AS BIGINT) AS version_end, CAST(floor(event_id / 100) AS BIGINT) - CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS version_start FROM events)"


def samples(spark, sf_dir):
    v = F.floor(F.col("event_id") / 100)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("seconds"), v.alias("version_end"), (v - F.when(F.col("event_type") == "error", 2).otherwise(0)).alias("version_start"))


@query(
    "assembly_stats",
    f"""WITH {_SAMPLES} SELECT round(avg(seconds), 4) + 0.0 AS avg, round(max(seconds), 4) + 0.0 AS max, round(min(seconds), 4) + 0.0 AS min, round(quantile_cont(seconds, 0.5), 4) + 0.0 AS tp50, round(quantile_cont(seconds, 0.95), 4) + 0.0 AS tp95,
      round(quantile_cont(seconds, 0.99), 4) + 0.0 AS tp99, count(*) FILTER (WHERE version_end > version_start) AS partial, round(avg(CASE WHEN version_end > version_start THEN 1.0 ELSE 0 END), 4) + 0.0 AS partial_ratio,
      max(version_end - version_start) AS max_span, count(DISTINCT version_end) AS versions FROM sa""",
)
def assembly_stats(spark, sf_dir):
    return rounded(m.assembly_stats(samples(spark, sf_dir)), "partial", "max_span", "versions")


@query("staleness", f"WITH {_SAMPLES} SELECT user_id, count(*) FILTER (WHERE version_end - version_start >= 1) AS stale FROM sa GROUP BY user_id")
def staleness(spark, sf_dir):
    return m.stale(samples(spark, sf_dir), F.col("version_end")).groupBy("user_id").agg(F.count_if("is_stale").alias("stale"))


@query("tail_share", f"WITH {_SAMPLES}, q AS (SELECT quantile_cont(seconds, 0.9) AS q FROM sa) SELECT round(avg(CASE WHEN seconds > q THEN 1.0 ELSE 0 END), 4) + 0.0 AS share FROM sa, q")
def tail_share(spark, sf_dir):
    return rounded(m.tail_share(samples(spark, sf_dir), "seconds", 10.0))


@query(
    "prob_diff_stats",
    f"""WITH {TOK0}, p AS (SELECT exp(logp_old) AS p, exp(logp_rollout) AS q FROM tok0 WHERE mask > 0)
    SELECT round(max(abs(p - q)), 4) + 0.0 AS max, round(avg(abs(p - q)), 4) + 0.0 AS mean, round(stddev_samp(abs(p - q)), 4) + 0.0 AS std, round(corr(p, q), 4) + 0.0 AS pearson FROM p""",
)
def prob_diff(spark, sf_dir):
    return rounded(m.masked_pair_stats(token_lines(spark, sf_dir), "logp_old", "logp_rollout"))


@query(
    "distillation_stats",
    """WITH r AS (SELECT o_custkey AS uid, o_totalprice AS score, o_orderstatus FROM orders)
    SELECT round((SELECT avg(w) FROM (SELECT max(CASE WHEN score >= 200000 THEN 1.0 ELSE 0 END) AS w FROM r GROUP BY uid)), 4) + 0.0 AS success_group_fraction, round(avg(CASE WHEN score >= 200000 THEN 1.0 ELSE 0 END), 4) + 0.0 AS success_sample_fraction,
      round(avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0 END), 4) + 0.0 AS feedback_available_fraction, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 4) + 0.0 AS feedback_used_fraction FROM r""",
)
def distillation_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("uid"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") != "P").alias("has_feedback"), (F.col("o_orderstatus") == "F").alias("used"))
    return rounded(m.distillation_stats(rows, 200000.0))


@query(
    "metric_core_names",
    """SELECT DISTINCT CASE WHEN event_type = 'click' AND user_id % 3 <> 2 THEN 'val-core/' ELSE 'val-aux/' END || CASE WHEN event_type = 'click' THEN 'acc' ELSE 'reward' END || '/' || CASE user_id % 3 WHEN 0 THEN 'mean@8' WHEN 1 THEN 'best@8/mean' ELSE 'std@8' END AS name FROM events""",
)
def core_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    var = F.when(F.col("event_type") == "click", "acc").otherwise("reward")
    k = F.col("user_id") % 3
    metric = F.when(k == 0, "mean@8").when(k == 1, "best@8/mean").otherwise("std@8")
    return e.select(m.core_name(var, metric, F.lit(8), F.lit(8), F.lit(True)).alias("name")).distinct()


# arrays of logits ----------------------------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_LSE = "(list_max({0}) + ln(list_sum(list_transform({0}, lambda x: exp(x - list_max({0}))))))"


def logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query(
    "logits_functions",
    f"""WITH {_E}, l AS (SELECT *, {_LSE.format("v")} AS lse FROM e)
    SELECT vec_id, round(lse, 4) + 0.0 AS lse, round(lse - list_sum(list_transform(v, lambda x: exp(x - lse) * x)), 4) + 0.0 AS entropy, round(v[label + 1] - lse, 4) + 0.0 AS logprob,
      round(list_sum(list_transform(v, lambda x: exp(2 * x - 2 * lse))), 4) + 0.0 AS pi_squared FROM l""",
)
def logits_functions(spark, sf_dir):
    v = F.col("v")
    return rounded(
        logits(spark, sf_dir).select("vec_id", masked.logsumexp(v).alias("lse"), masked.entropy_from_logits(v).alias("entropy"), masked.logprob_of(v, F.col("label")).alias("logprob"), masked.sum_pi_squared(v).alias("pi_squared")), "vec_id"
    )


def _distill(alpha: float, tail: bool) -> str:
    base = f"{_E}, n AS (SELECT vec_id, list_transform(v[1:8], lambda x: x - {_LSE.format('v')}) AS s, list_transform(v[9:16], lambda x: x - {_LSE.format('v')}) AS t FROM e)"
    if tail:
        f = "list_append({0}, ln(1 - exp(least(" + _LSE.format("{0}") + ", -1e-7))))"
        base += f", p AS (SELECT vec_id, {f.format('s')} AS s, {f.format('t')} AS t FROM n)"
    else:
        base += f", p AS (SELECT vec_id, list_transform(s, lambda x: x - {_LSE.format('s')}) AS s, list_transform(t, lambda x: x - {_LSE.format('t')}) AS t FROM n)"
    kl = "list_sum(list_transform(list_zip({0}, {1}), lambda z: exp(z[1]) * (z[1] - z[2])))"
    if alpha == 0:
        out = kl.format("t", "s")
    elif alpha == 1:
        out = kl.format("s", "t")
    else:
        base += f", m AS (SELECT *, list_transform(list_zip(s, t), lambda z: ln({1 - alpha} * exp(z[1]) + {alpha} * exp(z[2]))) AS mix FROM p)"
        return f"WITH {base} SELECT vec_id, round({alpha} * {kl.format('t', 'mix')} + {1 - alpha} * {kl.format('s', 'mix')}, 4) + 0.0 AS divergence FROM m"
    return f"WITH {base} SELECT vec_id, round({out}, 4) + 0.0 AS divergence FROM p"


for _alpha, _name in ((0.0, "forward"), (1.0, "reverse"), (0.5, "jsd")):
    for _tail in (True, False):

        @query(f"distillation_{_name}_{'tail' if _tail else 'renormalised'}", _distill(_alpha, _tail))
        def _run(spark, sf_dir, alpha=_alpha, tail=_tail):
            v = F.col("v")
            # the normaliser is computed once for both halves
            n = logits(spark, sf_dir).withColumn("lse", masked.logsumexp(v))
            part = lambda a: F.transform(F.slice(v, a, 8), lambda x: x - F.col("lse"))
            return rounded(n.select("vec_id", masked.distillation_divergence(part(1), part(9), alpha, tail).alias("divergence")), "vec_id")


@query(
    "array_shapes",
    """WITH e AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: CAST(floor(x * 100) AS BIGINT)) AS v FROM embeddings)
    SELECT vec_id, array_to_string(list_concat(v, [0, 0]), ',') AS right_pad, array_to_string(list_concat([0, 0], v), ',') AS left_pad, array_to_string(v[1:3], ',') AS head, array_to_string(v[-3:], ',') AS tail, array_to_string(list_concat(v[1:1], v[-2:]), ',') AS middle FROM e""",
)
def array_shapes(spark, sf_dir):
    from rollumen.functions import arrays as a

    v = F.transform(F.slice("embedding", 1, 5), lambda x: F.floor(x.cast("double") * 100))
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    text = lambda x: F.array_join(F.transform(x, lambda y: y.cast("string")), ",")
    c = F.col("v")
    return e.select("vec_id", text(a.pad(c, 7)).alias("right_pad"), text(a.pad(c, 7, left=True)).alias("left_pad"), text(a.truncate(c, 3, "right")).alias("head"), text(a.truncate(c, 3, "left")).alias("tail"), text(a.truncate(c, 3, "middle")).alias("middle"))


# batch algebra -------------------------------------------------------------------------------------------------------

_ROWNUM = "b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey AS k, o_orderstatus AS s FROM orders)"


def batch_rows(spark, sf_dir):
    from rollumen.plans.order import numbered

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return numbered(o, ["k"], "row_id").select("row_id", "k", "s")


def batch(name: str, sql: str):
    def add(f):
        @query(f"batch_{name}", f"WITH {_ROWNUM} {sql}")
        def run(spark, sf_dir):
            rows = batch_rows(spark, sf_dir)
            return f(rows)

        return f

    return add


batch("slice", "SELECT CAST((row_id - 10) / 3 AS BIGINT) AS row_id, k, s FROM b WHERE row_id >= 10 AND (row_id - 10) % 3 = 0 AND row_id < (SELECT count(*) FROM orders) - 5")(lambda d: b.sliced(d, 10, -5, 3))
batch("slice_reversed", "SELECT (SELECT count(*) FROM orders) - 1 - row_id AS row_id, k, s FROM b")(lambda d: b.sliced(d, None, None, -1))
batch("where", "SELECT row_number() OVER (ORDER BY k) - 1 AS row_id, k, s FROM b WHERE s = 'F'")(lambda d: b.where(d, "s = 'F'").select("row_id", "k", "s"))
batch("repeat_interleaved", "SELECT row_id * 3 + copy AS row_id, k, copy FROM b, (SELECT unnest([0, 1, 2]) AS copy) c")(lambda d: b.repeated(d, 3).select("row_id", "k", "copy"))
batch("repeat_tiled", "SELECT copy * (SELECT count(*) FROM orders) + row_id AS row_id, k, copy FROM b, (SELECT unnest([0, 1]) AS copy) c")(lambda d: b.repeated(d, 2, False).select("row_id", "k", "copy"))
batch("sample_repeat", "SELECT row_id, k, copy FROM b, (SELECT unnest([0, 1, 2]) AS copy) c WHERE copy < k % 4")(lambda d: b.sample_repeated(d.withColumn("n", (F.col("k") % 4).cast("int")), "n").select("row_id", "k", "copy"))
batch("fold", "SELECT CAST(floor(row_id / 5) AS BIGINT) AS row_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY b.row_id) AS ks FROM b GROUP BY floor(row_id / 5)")(
    lambda d: b.folded(d, 5, ["k"]).select("row_id", F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("ks"))
)
batch("split", "SELECT row_id, CAST(floor(row_id / 64) AS BIGINT) AS chunk FROM b")(lambda d: b.split(d, 64).select("row_id", "chunk"))
batch("pad_to_divisor", "SELECT row_id, k, false AS is_pad FROM b UNION ALL SELECT row_id + (SELECT count(*) FROM orders), k, true FROM b WHERE row_id < (7 - (SELECT count(*) FROM orders) % 7) % 7")(
    lambda d: b.padded(d, 7, d.count()).select("row_id", "k", "is_pad")
)
batch("unpad", "SELECT row_id, k FROM b")(lambda d: b.unpadded(b.padded(d, 7, d.count())).select("row_id", "k"))
batch("reorder", "SELECT (row_id * 7 + 3) % (SELECT count(*) FROM orders) AS row_id, k FROM b WHERE (SELECT count(*) FROM orders) % 7 <> 0")(
    lambda d: b.gathered(d, d.select(((F.col("row_id") * 7 + 3) % d.count()).alias("pos"), "row_id")).select("row_id", "k")
)
batch("inverse", "SELECT row_id AS pos, (row_id * 7 + 3) % (SELECT count(*) FROM orders) AS row_id FROM b")(lambda d: b.inverse(d.select(((F.col("row_id") * 7 + 3) % d.count()).alias("pos"), "row_id")))
batch("zip", "SELECT row_id, k, s, k % 10 AS m FROM b")(lambda d: b.zipped(d, d.select("row_id", "s", (F.col("k") % 10).alias("m"))).select("row_id", "k", "s", "m"))
batch("concat", "SELECT row_id, k FROM b UNION ALL SELECT row_id + (SELECT count(*) FROM orders), -k FROM b")(lambda d: b.concatenated([(d.select("row_id", "k"), n := d.count()), (d.select("row_id", (-F.col("k")).alias("k")), n)]))
batch("mini_batches", "SELECT epoch, row_id, CAST(floor(row_id / 50) AS BIGINT) AS batch, row_id % 50 AS position FROM b, (SELECT unnest([0, 1]) AS epoch) e WHERE row_id < (SELECT count(*) - count(*) % 50 FROM orders)")(
    lambda d: b.mini_batches(d.filter(F.col("row_id") < (n := d.count() // 50 * 50)), 50, n, 2).select("epoch", "row_id", "batch", "position")
)
batch("differences", "SELECT row_id FROM b WHERE k % 9 = 0")(lambda d: b.differences(d, d.withColumn("s", F.when(F.col("k") % 9 == 0, "x").otherwise(F.col("s")))))
batch("merge", "SELECT row_id, k, NULL::VARCHAR AS t FROM b UNION ALL SELECT row_id, NULL, s FROM b")(
    lambda d: b.merged([d.select("row_id", "k"), d.select("row_id", F.col("s").alias("t"))])
)

# joins and windows ---------------------------------------------------------------------------------------------------

_LOG = "lg AS (SELECT CAST(user_id AS VARCHAR) AS sample_uid, event_id AS seq, CASE event_type WHEN 'error' THEN '[API_ERROR] x' WHEN 'view' THEN ' ' ELSE event_type END AS model_answer FROM events)"


def log(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sample_uid"), F.col("event_id").alias("seq"), F.when(t == "error", "[API_ERROR] x").when(t == "view", " ").otherwise(t).alias("model_answer"))


@query(
    "log_compacted",
    f"""WITH {_LOG}, k AS (SELECT *, min(seq) OVER (PARTITION BY sample_uid) AS first_seq, row_number() OVER (PARTITION BY sample_uid ORDER BY CASE WHEN trim(model_answer) = '' OR model_answer LIKE '[API_ERROR]%' THEN 1 ELSE 0 END, seq DESC) AS k FROM lg)
    SELECT sample_uid, seq, model_answer, first_seq FROM k WHERE k = 1""",
)
def log_compacted(spark, sf_dir):
    return j.compacted(log(spark, sf_dir))


@query(
    "log_remaining",
    f"""WITH {_LOG} SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS sample_uid FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT sample_uid FROM lg WHERE trim(model_answer) <> '' AND NOT model_answer LIKE '[API_ERROR]%')""",
)
def log_remaining(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sample_uid"))
    return j.remaining(items, log(spark, sf_dir))


@query(
    "category_fallback",
    """WITH known AS (SELECT source AS image, lang AS query, CAST(n_chars % 50 AS VARCHAR) AS response, CASE WHEN doc_id % 3 = 0 THEN 'c' || (doc_id % 7) ELSE ' ' END AS category, doc_id AS seq FROM documents),
    f AS (SELECT * FROM known WHERE trim(category) <> ''), i AS (SELECT image, arg_max(category, seq) AS c1 FROM f GROUP BY image), t AS (SELECT query, response, arg_max(category, seq) AS c2 FROM f GROUP BY query, response),
    r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS image, lang AS query, CAST(n_chars % 50 AS VARCHAR) AS response, CASE WHEN doc_id % 5 = 0 THEN 'own' ELSE '' END AS category FROM documents)
    SELECT doc_id, coalesce(nullif(trim(category), ''), c1, c2, 'unknown') AS category FROM r LEFT JOIN i USING (image) LEFT JOIN t USING (query, response)""",
)
def category_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents").drop("text")
    response = (F.col("n_chars") % 50).cast("string")
    known = d.select(F.col("source").alias("image"), F.col("lang").alias("query"), response.alias("response"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("c"), F.col("doc_id") % 7)).otherwise(" ").alias("category"), F.col("doc_id").alias("seq"))
    rows = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("image"), F.col("lang").alias("query"), response.alias("response"), F.when(F.col("doc_id") % 5 == 0, "own").otherwise("").alias("category"))
    return j.with_category(rows, known).select("doc_id", "category")


@query(
    "first_success",
    """WITH r AS (SELECT o_orderkey AS row_id, o_custkey AS uid, o_totalprice AS score FROM orders)
    SELECT a.row_id, (SELECT min(b.row_id) FROM r b WHERE b.uid = a.uid AND b.score >= 250000 AND b.row_id <> a.row_id) AS other_row FROM r a""",
)
def first_success(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("uid"), F.col("o_totalprice").alias("score"))
    return j.first_success(rows, 250000.0).select("row_id", "other_row")


_ISL = "x AS (SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@query("islands_within", f"WITH {_ISL} SELECT conv_id, turn, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS island FROM x")
def islands_within(spark, sf_dir):
    return j.islands(table(spark, sf_dir, "conversations"), "role", "turn", "conv_id").select("conv_id", "turn", "island")


@query(
    "islands_global",
    f"""WITH {_ROWNUM}, x AS (SELECT row_id, CASE WHEN row_id > 0 AND s <> lag(s) OVER (ORDER BY row_id) THEN 1 ELSE 0 END AS n FROM b) SELECT row_id, CAST(sum(n) OVER (ORDER BY row_id) AS BIGINT) AS island FROM x""",
)
def islands_global(spark, sf_dir):
    return j.islands(batch_rows(spark, sf_dir), "s", "row_id").select("row_id", "island")


@query("run_counter", f"WITH {_ISL}, y AS (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM x) SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, i ORDER BY turn) - 1 AS INTEGER) AS run_pos FROM y")
def run_counter(spark, sf_dir):
    return j.run_counter(table(spark, sf_dir, "conversations"), "role", "turn", "conv_id").select("conv_id", "turn", "run_pos")


@query(
    "first_eos_mask",
    f"WITH {TOK0} SELECT row_id, t, CASE WHEN coalesce(sum(CASE WHEN value > 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS eos_mask FROM tok0",
)
def first_eos(spark, sf_dir):
    return j.first_eos_mask(token_lines(spark, sf_dir), F.col("value") > 0.9).select("row_id", "t", "eos_mask")


@query("position_ids", f"WITH {TOK0} SELECT row_id, t, CAST(greatest(sum(mask) OVER (PARTITION BY row_id ORDER BY t) - 1, 0) AS BIGINT) AS position_id FROM tok0")
def position_ids(spark, sf_dir):
    return j.position_ids(token_lines(spark, sf_dir)).select("row_id", "t", "position_id")


@query(
    "zig_zag",
    """WITH r AS (SELECT o_custkey AS uid, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT uid, k, CAST(CASE WHEN r % 2 = 0 THEN r / 2 ELSE n - 1 - (r - 1) / 2 END AS BIGINT) AS place FROM r""",
)
def zig_zag(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("k"), "o_totalprice")
    return j.zig_zag(o, [F.col("o_totalprice"), F.col("k")], "uid").select("uid", "k", "place")


@query("newest_per_group", "WITH r AS (SELECT o_custkey AS uid, o_orderkey AS step, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) SELECT uid, step FROM r WHERE k <= 2")
def newest_per_group(spark, sf_dir):
    return j.newest(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("step")), 2, within="uid")


@query("token_reward_stats", f"WITH {TOK0} SELECT row_id, round(sum(reward * mask), 4) + 0.0 AS total, round(sum(reward * mask) / (sum(mask) + 1e-8), 4) + 0.0 AS mean FROM tok0 GROUP BY row_id")
def token_reward_stats(spark, sf_dir):
    return rounded(token_lines(spark, sf_dir).groupBy("row_id").agg(masked.masked_sum("reward").alias("total"), masked.masked_mean("reward").alias("mean")), "row_id")


@query("clip_values", f"WITH {TOK0} SELECT row_id, t, round(greatest(least(logp_new, logp_old), -0.6), 4) + 0.0 AS clipped FROM tok0")
def clip_values(spark, sf_dir):
    return token_lines(spark, sf_dir).select("row_id", "t", r4(masked.clip("logp_new", -0.6, F.col("logp_old"))).alias("clipped"))
