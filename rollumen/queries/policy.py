"""Advantages, KL, importance sampling, rejection and losses, over trajectories derived from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollumen.operators import advantages as adv
from rollumen.operators import losses, policy
from rollumen.operators.masked import masked_moments
from rollumen.plans.domain import ROWS, TOK, TOK0, token_lines, tokens

QUERIES, ORACLE_SQL = {}, {}


def r4(c):
    """Rounded to four places, with no negative zero."""
    return F.round(c, 4) + 0.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[r4(F.col(c)).alias(c) for c in df.columns if c not in keys])


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adv.scored(tokens(spark, sf_dir))


def outcome(name: str, sql: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scores(spark, sf_dir)
        if name == "grpo_passk":  # groups of one row are an error
            rows = rows.join(rows.groupBy("uid").count().filter("count > 1").select("uid"), "uid", "left_semi")
        # first to nine places: a value half-way between two fourth places then is so in both engines
        return rounded(adv.estimator(name)(rows, **options).select("row_id", F.round("advantage", 9).alias("advantage")), "row_id")

    query(f"adv_{name}" + "".join(f"_{k}" for k in options), f"WITH {ROWS} SELECT row_id, round(round({sql}, 9), 4) + 0.0 AS advantage FROM sc")(run)


_G = "OVER (PARTITION BY uid)"
outcome("grpo", f"CASE WHEN count(*) {_G} = 1 THEN score / (1 + 1e-6) ELSE (score - avg(score) {_G}) / (stddev_samp(score) {_G} + 1e-6) END")
outcome("grpo", f"CASE WHEN count(*) {_G} = 1 THEN score ELSE score - avg(score) {_G} END", by_std=False)
outcome("grpo_vectorized", f"CASE WHEN count(*) {_G} = 1 THEN score / (1 + 1e-6) ELSE (score - avg(score) {_G}) / (sqrt(greatest(var_samp(score) {_G}, 1e-6)) + 1e-6) END")
outcome("rloo", f"CASE WHEN count(*) {_G} = 1 THEN score ELSE score - (sum(score) {_G} - score) / nullif(count(*) {_G} - 1, 0) END")
outcome("rloo_vectorized", f"CASE WHEN count(*) {_G} = 1 THEN 0 ELSE score - (sum(score) {_G} - score) / nullif(count(*) {_G} - 1, 0) END")
outcome("opo", f"score - CASE WHEN count(*) {_G} = 1 THEN 0 ELSE sum(length * score) {_G} / nullif(sum(length) {_G}, 0) END")
outcome("gpg", f"(count(*) OVER ()) / greatest(count(*) FILTER (WHERE score <> 0) OVER (), 1) * (score - CASE WHEN count(*) {_G} = 1 THEN 0 ELSE avg(score) {_G} END)")


@query(
    "adv_grpo_passk",
    f"""WITH {ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, row_id) AS k, count(*) {_G} AS n,
      stddev_samp(score) {_G} AS sd FROM sc), two AS (SELECT uid, max(CASE WHEN k = 1 THEN score END) - max(CASE WHEN k = 2 THEN score END) AS gap FROM r GROUP BY uid)
    SELECT row_id, CASE WHEN k = 1 THEN round(gap / (sd + 1e-6), 4) ELSE 0 END + 0.0 AS advantage FROM r JOIN two USING (uid) WHERE n > 1""",
)
def adv_passk(spark, sf_dir):
    rows = scores(spark, sf_dir)
    many = rows.groupBy("uid").count().filter("count > 1").select("uid")
    return rounded(adv.grpo_passk(rows.join(many, "uid", "left_semi")).select("row_id", "advantage"), "row_id")


_WHITE = """m AS (SELECT sum(CASE WHEN mask > 0 THEN x END) / (sum(mask) + 1e-8) AS mu, sum(mask) AS n FROM v),
 s AS (SELECT mu, sum(CASE WHEN mask > 0 THEN (x - mu) * (x - mu) END) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS va FROM v, m GROUP BY mu)"""


@query(
    "adv_reinforce_plus_plus_baseline",
    f"""WITH {ROWS}, b AS (SELECT row_id, score - CASE WHEN count(*) {_G} = 1 THEN 0 ELSE avg(score) {_G} END AS x FROM sc),
    v AS (SELECT tok.row_id, t, mask, x FROM tok JOIN b USING (row_id)), {_WHITE}
    SELECT row_id, t, round((x - mu) / sqrt(va + 1e-8) * mask, 4) + 0.0 AS advantage FROM v, s""",
)
def adv_rpp_baseline(spark, sf_dir):
    return rounded(adv.reinforce_plus_plus_baseline(tokens(spark, sf_dir)).select("row_id", "t", "advantage"), "row_id", "t")


@query(
    "adv_reinforce_plus_plus",
    f"""WITH RECURSIVE {TOK0}, b AS (SELECT row_id, t, mask, reward, max(t) OVER (PARTITION BY row_id) AS last FROM tok0),
    f AS (SELECT row_id, t, mask, CAST(reward AS DOUBLE) AS x FROM b WHERE t = last
      UNION ALL SELECT b.row_id, b.t, b.mask, b.reward + 0.9 * f.x * f.mask FROM f JOIN b ON b.row_id = f.row_id AND b.t = f.t - 1),
    v AS (SELECT * FROM f), {_WHITE}
    SELECT row_id, t, round(x, 4) + 0.0 AS returns, round((x - mu) / sqrt(va + 1e-8) * mask, 4) + 0.0 AS advantage FROM v, s""",
)
def adv_rpp(spark, sf_dir):
    return rounded(adv.reinforce_plus_plus(token_lines(spark, sf_dir), 0.9).select("row_id", "t", "returns", "advantage"), "row_id", "t")


@query(
    "adv_gae",
    f"""WITH RECURSIVE {TOK0}, b AS (SELECT row_id, t, mask, reward, value, max(t) OVER (PARTITION BY row_id) AS last FROM tok0),
    f AS (SELECT row_id, t, mask, value, CASE WHEN mask > 0 THEN value ELSE 0 END AS nv, CASE WHEN mask > 0 THEN reward - value ELSE 0 END AS x FROM b WHERE t = last
      UNION ALL SELECT b.row_id, b.t, b.mask, b.value, CASE WHEN b.mask > 0 THEN b.value ELSE f.nv END,
        CASE WHEN b.mask > 0 THEN b.reward + 0.99 * f.nv - b.value + 0.99 * 0.95 * f.x ELSE f.x END
      FROM f JOIN b ON b.row_id = f.row_id AND b.t = f.t - 1),
    v AS (SELECT * FROM f), {_WHITE}
    SELECT row_id, t, round(x + value, 4) + 0.0 AS returns, round((x - mu) / sqrt(va + 1e-8), 4) + 0.0 AS advantage FROM v, s""",
)
def adv_gae(spark, sf_dir):
    return rounded(adv.gae(token_lines(spark, sf_dir), 0.99, 0.95).select("row_id", "t", "returns", "advantage"), "row_id", "t")


_GO = "sum(reward * mask) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(
    "adv_remax",
    f"""WITH {ROWS}, base AS (SELECT uid, min(score) AS baseline FROM sc GROUP BY uid)
    SELECT row_id, t, round({_GO}, 4) + 0.0 AS returns, round({_GO} - baseline * mask, 4) + 0.0 AS advantage FROM tok JOIN base USING (uid)""",
)
def adv_remax(spark, sf_dir):
    tok = tokens(spark, sf_dir)
    base = adv.scored(tok).groupBy("uid").agg(F.min("score").alias("baseline"))
    return rounded(adv.remax(tok, base).select("row_id", "t", "returns", "advantage"), "row_id", "t")


_PATH = f"""p AS (SELECT *, {_GO} AS g, sum((1 - 2 * exp(logp_old) + sum_pi_sq) * mask) OVER (PARTITION BY row_id ORDER BY t) AS w FROM tok),
 n AS (SELECT uid, count(DISTINCT row_id) AS rows_ FROM tok GROUP BY uid),
 len AS (SELECT row_id, uid, length AS ln, row_number() OVER (PARTITION BY uid ORDER BY length DESC, row_id) AS k FROM sc),
 tail AS (SELECT a.row_id, b.ln AS second FROM len a JOIN len b ON a.uid = b.uid AND a.k = 1 AND b.k = 2 AND a.ln > b.ln)"""


@query(
    "adv_optimal_token_baseline",
    f"""WITH {ROWS}, {_PATH}, b AS (SELECT uid, t, sum(g * w * mask) / (sum(w * mask) + 1e-8) AS base FROM p GROUP BY uid, t)
    SELECT p.row_id, p.t, round((g - CASE WHEN rows_ = 1 OR p.t >= second THEN 0 ELSE base END) * mask, 4) + 0.0 AS advantage
    FROM p JOIN b ON b.uid = p.uid AND b.t = p.t JOIN n ON n.uid = p.uid LEFT JOIN tail ON tail.row_id = p.row_id""",
)
def adv_otb(spark, sf_dir):
    return rounded(adv.optimal_token_baseline(tokens(spark, sf_dir), zero_tail=True).select("row_id", "t", "advantage"), "row_id", "t")


@query(
    "adv_tir_optimal_token_baseline",
    f"""WITH {ROWS}, {_PATH}, q AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY t) - 1 AS k FROM p WHERE mask > 0),
    n2 AS (SELECT uid, count(DISTINCT row_id) AS rows_ FROM q GROUP BY uid),
    len2 AS (SELECT row_id, uid, count(*) AS ln, row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, row_id) AS j FROM q GROUP BY row_id, uid),
    tail2 AS (SELECT a.row_id, b.ln AS second FROM len2 a JOIN len2 b ON a.uid = b.uid AND a.j = 1 AND b.j = 2 AND a.ln > b.ln),
    b AS (SELECT uid, k, sum(g * w) / (sum(w) + 1e-8) AS base FROM q GROUP BY uid, k)
    SELECT q.row_id, q.t, round(g - CASE WHEN n2.rows_ = 1 OR q.k >= second THEN 0 ELSE base END, 4) + 0.0 AS advantage
    FROM q JOIN b ON b.uid = q.uid AND b.k = q.k JOIN n2 ON n2.uid = q.uid LEFT JOIN tail2 ON tail2.row_id = q.row_id
    UNION ALL SELECT row_id, t, 0.0 FROM p WHERE mask = 0""",
)
def adv_tir(spark, sf_dir):
    return rounded(adv.tir_optimal_token_baseline(tokens(spark, sf_dir)).select("row_id", "t", "advantage"), "row_id", "t")


@query(
    "adv_pf_ppo_weights",
    f"""WITH {ROWS} SELECT row_id, round(score * score + 1e-8, 4) + 0.0 AS w_pow,
    CASE WHEN score = max(score) OVER () OR score = min(score) OVER () THEN 1 ELSE 0 END + 1e-8 AS w_ends,
    CASE WHEN score = max(score) OVER () THEN 0.4 ELSE 0.1 END + 1e-8 AS w_best FROM sc""",
)
def adv_pf_ppo(spark, sf_dir):
    # sums of doubles may differ in the last place from run to run; equality with an extreme must not
    rows = scores(spark, sf_dir)
    a = adv.reweights(rows, "pow", 2.0).withColumnRenamed("weight", "w_pow")
    b = adv.reweights(a, "max_min").withColumnRenamed("weight", "w_ends")
    c = adv.reweights(b, "max_random").withColumnRenamed("weight", "w_best")
    return c.select("row_id", r4(F.col("w_pow")).alias("w_pow"), "w_ends", "w_best")


KINDS = ("k1", "abs", "k2", "k3")
_D = "(logp_old - logp_ref)"
_KL = {"k1": _D, "abs": f"abs({_D})", "k2": f"0.5 * {_D} * {_D}", "k3": f"exp(-{_D}) + {_D} - 1"}


@query("kl_penalty", f"WITH {TOK0} SELECT row_id, t, " + ", ".join(f"round({_KL[k]}, 4) + 0.0 AS {k}" for k in KINDS) + " FROM tok0")
def kl_penalty(spark, sf_dir):
    tok = token_lines(spark, sf_dir)
    return rounded(tok.select("row_id", "t", *[policy.kl_penalty(F.col("logp_old"), F.col("logp_ref"), k).alias(k) for k in KINDS]), "row_id", "t")


@query(
    "kl_reward_penalty",
    f"""WITH {TOK0} SELECT row_id, t, round(reward - 0.1 * {_D} * mask, 4) + 0.0 AS reward FROM tok0""",
)
def kl_reward(spark, sf_dir):
    return rounded(policy.apply_kl_penalty(token_lines(spark, sf_dir), 0.1)[0].select("row_id", "t", "reward"), "row_id", "t")


@query(
    "kl_current",
    f"""WITH {TOK0}, r AS (SELECT row_id, sum({_D} * mask * mask) / (sum(mask) + 1e-8) AS kl FROM tok0 GROUP BY row_id) SELECT round(avg(kl), 4) + 0.0 AS current_kl FROM r""",
)
def kl_current(spark, sf_dir):
    return rounded(policy.apply_kl_penalty(token_lines(spark, sf_dir), 0.1)[1])


@query("kl_rewards", f"WITH {TOK0} SELECT row_id, t, round(reward - {_D} * 0.5, 4) + 0.0 AS reward FROM tok0")
def kl_rewards(spark, sf_dir):
    return rounded(policy.kl_rewards(token_lines(spark, sf_dir), 0.5).select("row_id", "t", "reward"), "row_id", "t")


@query(
    "kl_adaptive_controller",
    """WITH RECURSIVE s AS (SELECT user_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS k FROM events),
    f AS (SELECT user_id, k, 0.2 * (1 + greatest(least(value / 50 - 1, 0.2), -0.2) * 10 / 1000) AS b FROM s WHERE k = 1
      UNION ALL SELECT s.user_id, s.k, f.b * (1 + greatest(least(s.value / 50 - 1, 0.2), -0.2) * 10 / 1000) FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)
    SELECT user_id, k, round(b, 6) AS beta FROM f""",
)
def kl_controller(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seq = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("value").alias("kl"), F.lit(10).alias("n")))).alias("s"))
    return seq.select("user_id", F.posexplode(policy.adaptive_beta(F.col("s"), 0.2, 50.0, 1000)).alias("k", "beta")).select("user_id", (F.col("k") + 1).alias("k"), F.round("beta", 6).alias("beta"))


_LR = f"{TOK0}, lr AS (SELECT *, logp_old - logp_rollout AS x FROM tok0)"


def weights(level: str, normalise: bool):
    seq = "sum(x * mask) OVER (PARTITION BY row_id)"
    raw = f"exp(greatest(least({'x' if level == 'token' else seq}, 20), -20)) * mask"
    sql = f"WITH {_LR}, w AS (SELECT row_id, t, mask, {raw} AS raw_weight, least({raw}, 2.0) AS w FROM lr)"
    if not normalise:
        sql += " SELECT row_id, t, round(raw_weight, 4) + 0.0 AS raw_weight, round(w, 4) + 0.0 AS is_weight FROM w"
    elif level == "token":
        sql += ", m AS (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS mu FROM w) SELECT row_id, t, round(raw_weight, 4) + 0.0 AS raw_weight, round(w / mu, 4) + 0.0 AS is_weight FROM w, m"
    else:
        sql += """, q AS (SELECT row_id, sum(w * mask) / (sum(mask) + 1e-8) AS s FROM w GROUP BY row_id HAVING sum(mask) > 0), m AS (SELECT avg(s) AS mu FROM q)
        SELECT row_id, t, round(raw_weight, 4) + 0.0 AS raw_weight, round(w / mu, 4) + 0.0 AS is_weight FROM w, m"""

    @query(f"is_weights_{level}" + "_normalised" * normalise, sql)
    def run(spark, sf_dir):
        w = policy.importance_weights(policy.log_ratio(token_lines(spark, sf_dir)), level, 2.0, normalise)
        return rounded(w.select("row_id", "t", "raw_weight", "is_weight"), "row_id", "t")


for _level in ("token", "sequence"):
    for _n in (False, True):
        weights(_level, _n)

_MM = "sum({0} * mask) / (sum(mask) + 1e-8)"


@query(
    "is_metrics",
    f"""WITH {_LR}, w AS (SELECT row_id, mask, exp(x) * mask AS w, greatest(least(exp(x) * mask, 2.0), 0.5) AS c FROM lr),
    a AS (SELECT {_MM.format("w")} AS mean, max(CASE WHEN mask > 0 THEN w END) AS max, min(CASE WHEN mask > 0 THEN w END) AS min,
      sum(CASE WHEN w > 2.0 THEN mask ELSE 0 END) / (sum(mask) + 1e-8) AS fraction_high, sum(CASE WHEN w < 0.5 THEN mask ELSE 0 END) / (sum(mask) + 1e-8) AS fraction_low,
      {_MM.format("c")} AS m1, {_MM.format("c * c")} AS m2 FROM w),
    s AS (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS s FROM w GROUP BY row_id),
    b AS (SELECT avg(s) AS seq_mean, stddev_samp(s) AS seq_std, max(s) AS seq_max, min(s) AS seq_min, max(abs(s - 1)) AS seq_max_deviation,
      avg(CASE WHEN s > 2.0 THEN 1.0 ELSE 0 END) AS seq_fraction_high, avg(CASE WHEN s < 0.5 THEN 1.0 ELSE 0 END) AS seq_fraction_low FROM s)
    SELECT round(mean, 4) + 0.0 AS mean, round(max, 4) + 0.0 AS max, round(min, 4) + 0.0 AS min, round(fraction_high, 4) + 0.0 AS fraction_high, round(fraction_low, 4) + 0.0 AS fraction_low,
      round(sqrt(greatest(m2 - m1 * m1, 0)), 4) + 0.0 AS std, round((m1 + 1e-8) * (m1 + 1e-8) / m2, 4) + 0.0 AS eff_sample_size, round(seq_mean, 4) + 0.0 AS seq_mean, round(seq_std, 4) + 0.0 AS seq_std,
      round(seq_max, 4) + 0.0 AS seq_max, round(seq_min, 4) + 0.0 AS seq_min, round(seq_max_deviation, 4) + 0.0 AS seq_max_deviation,
      round(seq_fraction_high, 4) + 0.0 AS seq_fraction_high, round(seq_fraction_low, 4) + 0.0 AS seq_fraction_low FROM a, b""",
)
def is_metrics(spark, sf_dir):
    return rounded(policy.importance_metrics(policy.importance_weights(policy.log_ratio(token_lines(spark, sf_dir)))))


_THRESHOLDS = {m: ("0.8_1.25" if m.endswith("k1") else "0.02") for m in policy.MODES}
_STAT = {"k1": "-x", "k2": "0.5 * x * x", "k3": "exp(x) - 1 - x"}


def _kept(mode: str) -> str:
    level, _, k = mode.rpartition("_")
    v = _STAT[k]
    over = "OVER (PARTITION BY row_id)"
    s = {
        "token": f"({v})",
        "seq_sum": f"(sum(({v}) * mask) {over})",
        "seq_mean": f"(sum(({v}) * mask) {over} / (sum(mask) {over} + 1e-8))",
        "seq_max": f"coalesce(max(CASE WHEN mask > 0 THEN {v} END) {over}, 0)",
    }[level]
    # away from the last places of the sums
    return f"({s} >= ln(0.8) AND {s} <= ln(1.25))" if k == "k1" else f"({s} <= 0.02)"


@query(
    "rejection_modes",
    f"WITH {_LR}, k AS (SELECT row_id, mask, " + ", ".join(f"{_kept(m)} AS {m}" for m in policy.MODES) + " FROM lr) SELECT "
    + ", ".join(f"CAST(sum(CASE WHEN {m} THEN mask ELSE 0 END) AS BIGINT) AS {m}" for m in policy.MODES)
    + f", CAST(sum(CASE WHEN {' AND '.join(policy.MODES)} THEN mask ELSE 0 END) AS BIGINT) AS all_modes FROM k",
)
def rejection_modes(spark, sf_dir):
    kept = policy.rejection(policy.log_ratio(token_lines(spark, sf_dir)), list(policy.MODES), list(_THRESHOLDS.values()))
    return kept.agg(*[F.sum(F.when(F.col(f"keep_{m}"), F.col("mask")).otherwise(0)).alias(m) for m in policy.MODES], F.sum("kept_mask").alias("all_modes"))


@query(
    "rejection_mask_seq_mean_k1",
    f"WITH {_LR} SELECT row_id, t, CASE WHEN {_kept('seq_mean_k1')} THEN mask ELSE 0 END AS kept_mask FROM lr",
)
def rejection_mask(spark, sf_dir):
    return policy.rejection(policy.log_ratio(token_lines(spark, sf_dir)), "seq_mean_k1", "0.8_1.25").select("row_id", "t", "kept_mask")


@query(
    "rejection_metrics",
    f"""WITH {_LR}, k AS (SELECT row_id, mask, {_kept("token_k2")} AS keep FROM lr), r AS (SELECT row_id, sum(mask) AS n, sum(CASE WHEN NOT keep THEN mask ELSE 0 END) AS gone FROM k GROUP BY row_id)
    SELECT round(sum(gone) / (sum(n) + 1e-8), 4) + 0.0 AS masked_fraction, round(avg(CASE WHEN n > 0 THEN CASE WHEN gone > 0 THEN 1.0 ELSE 0 END END), 4) + 0.0 AS seq_masked_fraction FROM r""",
)
def rejection_metrics(spark, sf_dir):
    return rounded(policy.rejection_metrics(policy.rejection(policy.log_ratio(token_lines(spark, sf_dir)), "token_k2", "0.02"), "token_k2"))


@query(
    "offpolicy_metrics",
    f"""WITH {_LR}, r AS (SELECT row_id, sum(logp_old * mask) / (sum(mask) + 1e-8) AS a, sum(logp_rollout * mask) / (sum(mask) + 1e-8) AS b, sum(x * mask) AS s,
      sum(-x * mask) AS kl, sum((exp(x) - x - 1) * mask) AS k3, sum(exp(2 * x) * mask) AS r2, sum(mask) AS n FROM lr GROUP BY row_id)
    SELECT round(avg(exp(-a)), 4) + 0.0 AS training_ppl, round(avg(-a), 4) + 0.0 AS training_log_ppl, round(avg(exp(-b)), 4) + 0.0 AS rollout_ppl, round(avg(-b), 4) + 0.0 AS rollout_log_ppl,
      round(sum(kl) / (sum(n) + 1e-8), 4) + 0.0 AS kl, round(sum(k3) / (sum(n) + 1e-8), 4) + 0.0 AS k3_kl, round(avg(b - a), 4) + 0.0 AS log_ppl_diff, round(avg(abs(b - a)), 4) + 0.0 AS log_ppl_abs_diff,
      round(max(b - a), 4) + 0.0 AS log_ppl_diff_max, round(min(b - a), 4) + 0.0 AS log_ppl_diff_min, round(avg(exp(b - a)), 4) + 0.0 AS ppl_ratio,
      round(sum(r2) / (sum(n) + 1e-8) - 1, 4) + 0.0 AS chi2_token, round(avg(exp(2 * greatest(least(s, 20), -20))) - 1, 4) + 0.0 AS chi2_seq FROM r""",
)
def offpolicy(spark, sf_dir):
    return rounded(policy.offpolicy_metrics(token_lines(spark, sf_dir)))


@query(
    "masked_moments",
    f"""WITH {TOK0}, m AS (SELECT sum(reward * mask) / (sum(mask) + 1e-8) AS mu, sum(mask) AS n FROM tok0)
    SELECT CAST(max(n) AS BIGINT) AS n, round(max(mu), 4) + 0.0 AS mean, round(sum((reward - mu) * (reward - mu) * mask) / (max(n) + 1e-8) * max(n) / (max(n) - 1), 4) + 0.0 AS var FROM tok0, m""",
)
def moments(spark, sf_dir):
    return rounded(masked_moments(token_lines(spark, sf_dir), "reward"), "n")


def with_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-token advantage of either sign that needs no group."""
    return token_lines(spark, sf_dir).withColumn("advantage", F.col("reward") - 0.5)


_ADV = f"{TOK0}, a AS (SELECT *, reward - 0.5 AS adv, logp_new - logp_old AS d, exp(logp_new - logp_old) AS r FROM tok0)"


def loss_sql(body: str, mode: str, metrics: dict[str, str]) -> str:
    agg = {
        "token-mean": "sum(s) / nullif(sum(n), 0)",
        "seq-mean-token-sum": "avg(CASE WHEN n > 0 THEN s END)",
        "seq-mean-token-mean": "avg(CASE WHEN n > 0 THEN s / (n + 1e-8) END)",
        "seq-mean-token-sum-norm": "sum(s) / 64",
    }[mode]
    inner = "".join(f", sum(CASE WHEN mask > 0 THEN CAST(({v}) AS DOUBLE) END) AS {k}" for k, v in metrics.items())
    outer = "".join(f", round(coalesce(sum({k}), 0) / (sum(n) + 1e-8), 4) + 0.0 AS {k}" for k in metrics)
    return f"WITH {_ADV}, l AS ({body}), g AS (SELECT row_id, coalesce(sum(loss * mask), 0) AS s, sum(mask) AS n{inner} FROM l GROUP BY row_id) SELECT round({agg}, 4) + 0.0 AS loss{outer} FROM g"


_CLIP = "greatest(least(r, 1.2), 0.8)"
_VANILLA = f"""SELECT *, greatest(-adv * r, -adv * {_CLIP}) AS worst, CASE WHEN adv < 0 THEN least(-adv * 3.0, greatest(-adv * r, -adv * {_CLIP}))
 ELSE greatest(-adv * r, -adv * {_CLIP}) END AS loss FROM a"""
_VM = {"clipfrac": f"-adv * {_CLIP} > -adv * r", "ppo_kl": "-d", "clipfrac_lower": "worst > -adv * 3.0 AND adv < 0"}

for _mode in losses.AGGREGATIONS:

    @query(f"loss_vanilla_{_mode.replace('-', '_')}", loss_sql(_VANILLA, _mode, _VM))
    def _vanilla(spark, sf_dir, mode=_mode):
        return rounded(losses.vanilla(with_advantage(spark, sf_dir), mode=mode, width=64))

    @query(f"agg_loss_{_mode.replace('-', '_')}", loss_sql("SELECT *, reward AS loss FROM a", _mode, {}))
    def _agg(spark, sf_dir, mode=_mode):
        return rounded(losses.agg_loss(token_lines(spark, sf_dir), "reward", mode, 64))


def loss(name: str, body: str, mode: str, metrics: dict[str, str], **options):
    @query(f"loss_{name}", loss_sql(body, mode, metrics))
    def run(spark, sf_dir):
        return rounded(losses.policy_loss(name)(with_advantage(spark, sf_dir), **options))


_SR = "exp(least(sum(d * mask) OVER (PARTITION BY row_id) / greatest(sum(mask) OVER (PARTITION BY row_id), 1), 10))"
loss(
    "gspo", f"SELECT *, greatest(-adv * q, -adv * greatest(least(q, 1.2), 0.8)) AS loss FROM (SELECT *, {_SR} AS q FROM a)", "seq-mean-token-mean",
    {"clipfrac": "-adv * greatest(least(q, 1.2), 0.8) > -adv * q", "ppo_kl": "-d"},
)
loss("sapo", "SELECT *, -adv * (4 / tau) / (1 + exp(-tau * (r - 1))) AS loss FROM (SELECT *, CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END AS tau FROM a)", "seq-mean-token-mean", {"ppo_kl": "-d"})
loss("gpg", "SELECT *, -logp_new * adv AS loss FROM a", "token-mean", {})
loss("reinforce", "SELECT *, -logp_new * adv AS loss FROM a", "token-mean", {"ppo_kl": "-d"})
loss("cispo", f"SELECT *, -{_CLIP} * adv * logp_new AS loss FROM a", "token-mean", {"clipfrac": f"r <> {_CLIP}", "ppo_kl": "-d"})


@query(
    "loss_geo_mean",
    f"""WITH {_ADV}, b AS (SELECT *, greatest(least(d, 0.2), -0.2) AS c, sign(adv) AS sg FROM a),
    g AS (SELECT row_id, sum(sg * least(sg * d, sg * c) * mask) AS e, sum(adv * mask) AS av, sum(mask) AS n, sum(CASE WHEN d <> c AND adv > 0 THEN mask ELSE 0 END) AS c1,
      sum(CASE WHEN d <> c AND adv < 0 THEN mask ELSE 0 END) AS c2, sum(-d * mask) AS k FROM b GROUP BY row_id)
    SELECT round(avg(-av / (n + 1e-8) * exp(e / (n + 1e-8))), 4) + 0.0 AS loss, round(sum(c1) / (sum(n) + 1e-8), 4) + 0.0 AS clipfrac,
      round(sum(c2) / (sum(n) + 1e-8), 4) + 0.0 AS clipfrac_lower, round(sum(k) / (sum(n) + 1e-8), 4) + 0.0 AS ppo_kl FROM g""",
)
def loss_geo(spark, sf_dir):
    return rounded(losses.geo_mean(with_advantage(spark, sf_dir)))


@query(
    "loss_kl_cov",
    f"""WITH {_ADV}, mu AS (SELECT sum(adv * mask) / (sum(mask) + 1e-8) AS ma, sum(logp_new * mask) / (sum(mask) + 1e-8) AS ml, sum(mask) AS n FROM a),
    c AS (SELECT a.*, n, row_number() OVER (PARTITION BY mask ORDER BY round((adv - ma) * (logp_new - ml), 9) DESC, row_id, t) AS k FROM a, mu),
    l AS (SELECT row_id, mask, -adv * r + CASE WHEN mask > 0 AND k <= greatest(1, floor(n * 0.01)) THEN abs(d) ELSE 0 END AS loss, abs(d) AS ad FROM c)
    SELECT round(sum(loss * mask) / sum(mask), 4) + 0.0 AS loss, round(sum(ad * mask) / (sum(mask) + 1e-8), 4) + 0.0 AS ppo_kl FROM l""",
)
def loss_kl_cov(spark, sf_dir):
    return rounded(losses.kl_cov(with_advantage(spark, sf_dir), share=0.01))


@query(
    "loss_clip_cov",
    f"""WITH {_ADV}, mu AS (SELECT sum(adv * mask) / (sum(mask) + 1e-8) AS ma, sum(logp_new * mask) / (sum(mask) + 1e-8) AS ml, sum(mask) AS n FROM a),
    c AS (SELECT a.*, n, (adv - ma) * (logp_new - ml) AS cov, -adv * r AS l1, -adv * greatest(least(r, 1.2), 0.8) AS l2 FROM a, mu),
    g AS (SELECT *, mask > 0 AND cov > 0.01 AND cov < 5 AND NOT (l2 > l1) AS near FROM c),
    k AS (SELECT *, near AND row_number() OVER (PARTITION BY near ORDER BY md5('42-' || CAST(row_id AS VARCHAR) || '-' || CAST(t AS VARCHAR)), row_id, t) <= greatest(1, floor(n * 0.001)) AS gone FROM g)
    SELECT round(sum(CASE WHEN gone THEN 0 ELSE greatest(l1, l2) END * mask) / sum(mask), 4) + 0.0 AS loss, round(sum(CASE WHEN gone THEN mask ELSE 0 END) / (sum(mask) + 1e-8), 4) + 0.0 AS clipfrac,
      round(sum(-d * mask) / (sum(mask) + 1e-8), 4) + 0.0 AS ppo_kl FROM k""",
)
def loss_clip_cov(spark, sf_dir):
    return rounded(losses.clip_cov(with_advantage(spark, sf_dir), share=0.001, lower=0.01))


@query(
    "loss_value",
    loss_sql("SELECT *, 0.5 * greatest((p - g) * (p - g), (q - g) * (q - g)) AS loss FROM (SELECT *, logp_new + 1 AS p, reward AS g, greatest(least(logp_new + 1, value + 0.2), value - 0.2) AS q FROM a)",
             "token-mean", {"clipfrac": "(q - g) * (q - g) > (p - g) * (p - g)"}),
)
def loss_value(spark, sf_dir):
    tok = token_lines(spark, sf_dir).withColumn("returns", F.col("reward")).withColumn("pred", F.col("logp_new") + 1)
    return rounded(losses.value_loss(tok, "pred", 0.2))


@query(
    "loss_sft",
    f"""WITH {TOK0}, n AS (SELECT row_id, logp_new, lead(mask) OVER (PARTITION BY row_id ORDER BY t) AS m FROM tok0)
    SELECT round(sum(-logp_new * m) / (sum(m) + 1e-8) / 4, 4) + 0.0 AS loss FROM n WHERE m IS NOT NULL""",
)
def loss_sft(spark, sf_dir):
    return rounded(losses.sft_loss(token_lines(spark, sf_dir), 4))


@query(
    "loss_mixed",
    f"""WITH {TOK0}, x AS (SELECT mask, reward AS loss, value AS dl, row_id % 3 = 0 AS on_ FROM tok0)
    SELECT round(sum(CASE WHEN on_ THEN dl * mask END) / sum(CASE WHEN on_ THEN mask END) + sum(CASE WHEN NOT on_ THEN loss * mask END) / sum(CASE WHEN NOT on_ THEN mask END), 4) + 0.0 AS loss FROM x""",
)
def loss_mixed(spark, sf_dir):
    tok = token_lines(spark, sf_dir).select("mask", F.col("reward").alias("loss"), F.col("value").alias("distill_loss"), (F.col("row_id") % 3 == 0).cast("double").alias("distill_mask"))
    return rounded(losses.mixed_loss(tok))
