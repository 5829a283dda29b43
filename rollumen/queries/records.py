"""Correction of rollouts, guards, samplers, code feedback, the rule judge, reward managers, and files written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollumen import registry
from rollumen.functions import feedback as fb
from rollumen.functions import latex
from rollumen.operators import batch as b
from rollumen.operators import losses, metrics, partition, policy
from rollumen.plans.domain import TOK0, table, token_lines
from rollumen.plans.lineage import checkpoint_root
from rollumen.queries.policy import _ADV, _LR, _STAT, _THRESHOLDS, _VANILLA, _VM, _kept, loss_sql, r4, rounded, with_advantage
from rollumen.queries.tables import _ROWNUM, batch_rows
from rollumen.sources import readers, sinks

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# correction ----------------------------------------------------------------------------------------------------------


@query(
    "rollout_correction",
    f"""WITH {_LR}, k AS (SELECT row_id, mask, least(exp(x) * mask, 2.0) AS w, CASE WHEN {_kept("seq_mean_k1")} THEN mask ELSE 0 END AS kept FROM lr)
    SELECT row_id, round(sum(w * kept), 4) + 0.0 AS weight, CAST(sum(kept) AS BIGINT) AS kept FROM k GROUP BY row_id""",
)
def rollout_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = policy.rollout_correction(token_lines(spark, sf_dir), "token", 2.0, modes="seq_mean_k1", spec="0.8_1.25")
    return own.groupBy("row_id").agg(r4(F.sum(F.col("is_weight") * F.col("kept_mask"))).alias("weight"), F.sum("kept_mask").alias("kept"))


_GEO = "-sx / (n + 1e-8) >= ln(0.999) AND -sx / (n + 1e-8) <= ln(1.001)"
_K3 = "s3 / (n + 1e-8) <= 0.01"
#: For each preset the weight before its bound (null: none) and what stays; in bypass mode the ratios are 1.
_SHOWN = {"decoupled_token_is": ("exp(x)", "TRUE"), "decoupled_seq_is_rs": ("exp(sx)", "abs(sx) <= ln(2.0)"), "decoupled_geo_rs_seq_tis": ("exp(sx)", _GEO), "decoupled_k3_rs_token_tis": ("exp(x)", _K3), "bypass_pg_geo_rs_seq_tis": ("1.0", "TRUE"), "disabled": (None, "TRUE"),
    "decoupled_seq_is": ("exp(sx)", "TRUE"), "decoupled_geo_rs": (None, _GEO), "bypass_ppo_clip": (None, "TRUE"), "bypass_ppo_clip_geo_rs": (None, "TRUE"), "bypass_ppo_clip_k3_rs": (None, "TRUE"),
    "bypass_pg_is": ("1.0", "TRUE"), "bypass_pg_geo_rs": (None, "TRUE"), "decoupled_geo_rs_token_tis": ("exp(x)", _GEO), "bypass_pg_geo_rs_token_tis": ("1.0", "TRUE"), "decoupled_k3_rs": (None, _K3),
    "decoupled_k3_rs_seq_tis": ("exp(sx)", _K3),
}


@query(
    "correction_presets",
    f"WITH {_LR}, w AS (SELECT *, sum(x * mask) OVER (PARTITION BY row_id) AS sx, sum(mask) OVER (PARTITION BY row_id) AS n, sum((exp(x) - 1 - x) * mask) OVER (PARTITION BY row_id) AS s3 FROM lr) "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS preset, round(sum({'1.0' if raw is None else f'least({raw} * mask, 2.0)'} * CASE WHEN {keep} THEN mask ELSE 0 END), 3) + 0.0 AS weight, CAST(sum(CASE WHEN {keep} THEN mask ELSE 0 END) AS BIGINT) AS kept FROM w"
        for k, (raw, keep) in _SHOWN.items()
    ),
)
def correction_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in _SHOWN:
        own = registry.PRESETS[name].apply(token_lines(spark, sf_dir))
        part = own.agg((F.round(F.sum(F.col("is_weight") * F.col("kept_mask")), 3) + 0.0).alias("weight"), F.sum("kept_mask").alias("kept")).select(F.lit(name).alias("preset"), "weight", "kept")
        out = part if out is None else out.unionByName(part)
    return out


def _statistics_sql(mode: str) -> str:
    level, _, kind = mode.rpartition("_")
    k1, sequence = kind == "k1", level != "token"
    low, high = ("ln(0.8)", "ln(1.25)") if k1 else ("0.0", "0.02")
    value = {"token": "s / (n + 1e-8)", "seq_mean": "s / (n + 1e-8)", "seq_sum": "s", "seq_max": "coalesce(most, 0)"}[level]
    clipped = lambda c: f"greatest(least({c}, {high}), {low})"
    token = f"FROM (SELECT row_id, mask, {_STAT[kind]} AS v FROM lr)"
    rows = f"""r AS (SELECT *, {value} AS q FROM (SELECT row_id, sum(v * mask) AS s, sum(mask) AS n, max(CASE WHEN mask > 0 THEN v END) AS most, min(CASE WHEN mask > 0 THEN v END) AS least_v,
      sum({clipped("v")} * mask) AS c1, sum({clipped("v")} * {clipped("v")} * mask) AS c2, sum(CASE WHEN v > {high} THEN mask ELSE 0 END) AS o, sum(CASE WHEN v < {low} THEN mask ELSE 0 END) AS u {token} GROUP BY row_id))"""
    over = f"avg(CASE WHEN n > 0 THEN CASE WHEN q > {high} THEN 1.0 ELSE 0 END END)"
    under = f"avg(CASE WHEN n > 0 THEN CASE WHEN q < {low} THEN 1.0 ELSE 0 END END)" if k1 else "0.0"
    a, c = (f"sum({clipped('q')} * n)", f"sum({clipped('q')} * {clipped('q')} * n)") if sequence else ("sum(c1)", "sum(c2)")
    t, some = "(sum(n) + 1e-8)", "CASE WHEN n > 0 THEN q END"
    cells = {
        "mean": f"{'sum(q * n)' if sequence else 'sum(s)'} / {t}", "max": f"max({some})" if sequence else "max(most)", "min": f"min({some})" if sequence else "min(least_v)",
        "fraction_high": over if sequence else f"sum(o) / {t}", "fraction_low": under if sequence or not k1 else f"sum(u) / {t}", "std": f"sqrt(greatest({c} / {t} - ({a} / {t}) * ({a} / {t}), 0))",
        "seq_mean": f"avg({some})", "seq_std": f"coalesce(stddev_samp({some}), 0)", "seq_max": f"max({some})", "seq_min": f"min({some})", "seq_max_deviation": f"max(abs({some}))", "seq_fraction_high": over, "seq_fraction_low": under if k1 else "CAST(NULL AS DOUBLE)",
    }
    return f"WITH {_LR}, {rows} SELECT " + ", ".join(f"round({v}, 4) + 0.0 AS {k}" for k, v in cells.items()) + " FROM r"


def _statistics(mode: str) -> None:
    @query(f"rejection_statistics_{mode}", _statistics_sql(mode))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(policy.rejection_statistics(policy.log_ratio(token_lines(spark, sf_dir)), mode, _THRESHOLDS[mode]))


for _mode in policy.MODES:
    _statistics(_mode)


_BYPASSED = "SELECT *, d AS x FROM a"
_KEPT_ROWS = f"SELECT * REPLACE (CASE WHEN {_kept('seq_mean_k1')} THEN mask ELSE 0 END AS mask), least(exp(x) * mask, 2.0) AS w FROM ({_BYPASSED})"


@query("loss_bypass_ppo_clip", loss_sql(_VANILLA.replace("FROM a", f"FROM ({_KEPT_ROWS})"), "token-mean", _VM))
def loss_bypass_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(losses.policy_loss("bypass_mode")(with_advantage(spark, sf_dir), modes="seq_mean_k1", spec="0.8_1.25"))


@query("loss_bypass_reinforce", loss_sql(f"SELECT *, -logp_new * adv * w AS loss FROM ({_KEPT_ROWS})", "token-mean", {"ppo_kl": "-d"}))
def loss_bypass_reinforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(losses.policy_loss("bypass_mode")(with_advantage(spark, sf_dir), "reinforce", "token", modes="seq_mean_k1", spec="0.8_1.25"))


_K = "greatest(least(exp(k) - k - 1, 10), -10)"


@query(
    "actor_step",
    f"""WITH {_ADV}, l AS ({_VANILLA}), m AS (SELECT *, {_K} AS kl FROM (SELECT *, greatest(least(logp_ref - logp_new, 20), -20) AS k FROM l)),
    s AS (SELECT sum(loss * mask) / sum(mask) * 2 AS pg, sum(value * mask) / sum(mask) * 2 AS e, sum(kl * mask) / sum(mask) * 2 AS kl, sum(CASE WHEN mask > 0 THEN -d END) / (sum(mask) + 1e-8) AS pk FROM m)
    SELECT round(pg - 0.01 * e + 0.1 * kl, 4) + 0.0 AS loss, round(pg, 4) + 0.0 AS pg_loss, round(e, 4) + 0.0 AS entropy_loss, round(kl, 4) + 0.0 AS kl_loss, round(pk, 4) + 0.0 AS ppo_kl FROM s""",
)
def actor_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On two ranks; the values stand in for entropies."""
    own = losses.actor_step(with_advantage(spark, sf_dir), entropy="value", entropy_coef=0.01, ref="logp_ref", kl_coef=0.1, ranks=2)
    return rounded(own.select("loss", "pg_loss", "entropy_loss", "kl_loss", "ppo_kl"))


@query(
    "critic_step",
    f"""WITH {TOK0}, v AS (SELECT mask, sum_pi_sq AS p, (sum_pi_sq - reward) * (sum_pi_sq - reward) AS a, value, reward FROM tok0),
    w AS (SELECT *, greatest(least(p, value + 0.2), value - 0.2) AS c FROM v), x AS (SELECT *, (c - reward) * (c - reward) AS b FROM w)
    SELECT round(sum(0.5 * greatest(a, b) * mask) / sum(mask), 4) + 0.0 AS loss, round(sum(CASE WHEN b > a THEN mask ELSE 0 END) / (sum(mask) + 1e-8), 4) + 0.0 AS clipfrac, round(sum(p * mask) / (sum(mask) + 1e-8), 4) + 0.0 AS vpred_mean FROM x""",
)
def critic_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = token_lines(spark, sf_dir).withColumn("returns", F.col("reward"))
    return rounded(losses.critic_step(lines, "sum_pi_sq", 0.2))


@query("loss_entropy", f"WITH {TOK0} SELECT round(sum(value * mask) / sum(mask), 4) + 0.0 AS loss FROM tok0")
def loss_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(losses.entropy_loss(token_lines(spark, sf_dir), "value"))


@query(
    "guard_forbidden",
    f"""WITH {TOK0}, k AS (SELECT row_id, t, mask, CAST(round(value * 50) AS BIGINT) AS token FROM tok0)
    SELECT row_id, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS positions FROM k WHERE mask > 0 AND token IN (7, 13) GROUP BY row_id""",
)
def guard_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = token_lines(spark, sf_dir).withColumn("token", F.round(F.col("value") * 50).cast("long"))
    got = policy.forbidden_positions(own, "token", [7, 13])
    return got.select("row_id", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query(
    "generation_performance",
    """WITH g AS (SELECT l_orderkey AS row_id, sum(l_quantity) AS seconds, count(*) AS tokens FROM lineitem GROUP BY l_orderkey)
    SELECT round(min(seconds), 4) AS min, round(max(seconds), 4) AS max, round(avg(seconds), 4) AS mean, (SELECT row_id FROM g ORDER BY seconds DESC, row_id LIMIT 1) AS slowest_row_id,
      (SELECT tokens FROM g ORDER BY seconds DESC, row_id LIMIT 1) AS slowest_tokens FROM g""",
)
def generation_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.sum("l_quantity").alias("seconds"), F.count(F.lit(1)).alias("tokens"))
    got = metrics.generation_performance(rows, "seconds", "row_id", "tokens")
    return got.select(*[F.round(c, 4).alias(c) for c in ("min", "max", "mean")], "slowest_row_id", "slowest_tokens")


@query("timing_per_token", "SELECT event_type AS name, round(sum(value), 4) AS seconds, round(sum(value) * 1000 / CASE WHEN event_type = 'gen' THEN 100 ELSE 400 END, 4) AS per_token_ms FROM (SELECT CASE event_type WHEN 'view' THEN 'gen' ELSE event_type END AS event_type, value FROM events) GROUP BY event_type")
def timing_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "view", "gen").otherwise(F.col("event_type"))
    sums = table(spark, sf_dir, "events").groupBy(name.alias("name")).agg(F.sum("value").alias("seconds"))
    return metrics.timing_metrics(sums, 100, 400).select("name", F.round("seconds", 4).alias("seconds"), F.round("per_token_ms", 4).alias("per_token_ms"))


@query("throughput", "SELECT o_orderkey AS row_id, round(o_orderkey / (o_totalprice * 4), 9) AS rate FROM orders WHERE o_totalprice > 0")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 0")
    return o.select(F.col("o_orderkey").alias("row_id"), F.round(metrics.throughput(F.col("o_orderkey"), F.col("o_totalprice"), F.lit(4)), 9).alias("rate"))


# batches and samplers ------------------------------------------------------------------------------------------------


def batch(name: str, sql: str):
    def add(f):
        @query(f"batch_{name}", f"WITH {_ROWNUM} {sql}")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(batch_rows(spark, sf_dir))

        return f

    return add


_N = "(SELECT count(*) FROM orders)"
batch("assigned", "SELECT row_id, k, 7 AS c, k % 3 AS e FROM b")(lambda d: b.assigned_each(b.assigned(d.select("row_id", "k"), "c", 7), d.select("row_id", (F.col("k") % 3).alias("e")), "e"))
batch("lists", "SELECT s, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) AS rows, string_agg(CAST(k AS VARCHAR), ',' ORDER BY row_id) AS ks FROM (SELECT k % 97 AS s, row_id, k FROM b) GROUP BY s")(
    lambda d: b.lists_of(d.select((F.col("k") % 97).alias("s"), "row_id", "k"), "s", "row_id").select("s", F.concat_ws(",", F.col("row_id").cast("array<string>")).alias("rows"), F.concat_ws(",", F.col("k").cast("array<string>")).alias("ks"))
)
batch("auto_padded", f"SELECT 'off' AS switch, row_id, FALSE AS is_pad FROM b UNION ALL SELECT 'on', row_id, FALSE FROM b UNION ALL SELECT 'on', r + {_N}, TRUE FROM (SELECT unnest(generate_series(0, 6)) AS r) WHERE r < (7 - {_N} % 7) % 7")(
    lambda d: b.auto_padded(d, 7, d.count(), False).select(F.lit("off").alias("switch"), "row_id", "is_pad").unionByName(b.auto_padded(d, 7, d.count(), True).select(F.lit("on").alias("switch"), "row_id", "is_pad"))
)
batch("varied_groups", "SELECT row_id FROM b WHERE k % 50 IN (SELECT k % 50 FROM b GROUP BY k % 50 HAVING min(s) <> max(s))")(lambda d: b.varied_groups(d.withColumn("g", F.col("k") % 50), "g", "s").select("row_id"))
batch("edge_padded", f"SELECT row_id, k, FALSE AS is_pad FROM b UNION ALL SELECT {_N} + r, (SELECT max(k) FROM b), TRUE FROM (SELECT unnest([0, 1, 2]) AS r)")(lambda d: b.padded_by_edge(d, 3, d.count(), False).select("row_id", "k", "is_pad"))
batch("exact_split", f"SELECT row_id, CAST(floor(row_id / (({_N} - {_N} % 4) / 4)) AS BIGINT) AS split FROM b WHERE row_id < {_N} - {_N} % 4")(
    lambda d: b.exact_split(d.filter(F.col("row_id") < (n := d.count() // 4 * 4)), 4, n).select("row_id", "split")
)
batch("replica_batches", f"SELECT row_id, CAST(n % 4 AS BIGINT) AS replica, CAST(floor(n // 4 / 8) AS BIGINT) AS batch, CAST(n // 4 % 8 AS BIGINT) AS position FROM (SELECT row_id, row_number() OVER (ORDER BY md5('3-1-' || CAST(row_id AS VARCHAR)), row_id) - 1 AS n FROM b) WHERE n < {_N} - {_N} % 32")(
    lambda d: b.replica_batches(d, "row_id", 4, 8, d.count(), 3, 1).select("row_id", "replica", "batch", "position")
)
batch("traced", "SELECT step, row_id FROM (SELECT k % 31 AS step, row_id, row_number() OVER (PARTITION BY k % 31 ORDER BY md5('5-' || CAST(row_id AS VARCHAR)), row_id) AS n FROM b) WHERE n <= 3")(
    lambda d: b.traced(d.withColumn("step", F.col("k") % 31), "step", "row_id", 3, 5).select("step", "row_id")
)
batch("shared_prefixes", "SELECT row_id, CAST(p + coalesce(sum(n) OVER (PARTITION BY p ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", p AS position FROM (SELECT row_id, k % 97 AS p, k % 13 + 1 AS n FROM b)")(
    lambda d: b.shared_prefixes(d.select("row_id", (F.col("k") % 97).alias("p"), (F.col("k") % 13 + 1).alias("n")), "p", "row_id", "p", "n").select("row_id", "offset", "position")
)


@query("balance_stats", "SELECT batch, least, most, round((SELECT avg(x) FROM (SELECT unnest([least, most]) AS x)), 4) AS mean FROM (SELECT c_nationkey AS batch, min(s) AS least, max(s) AS most FROM (SELECT c_nationkey, c_custkey % 2 AS part, sum(c_custkey) AS s FROM customer GROUP BY 1, 2) GROUP BY 1)")
def balance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("batch"), F.col("c_custkey").alias("length"), (F.col("c_custkey") % 2).alias("part"))
    return partition.balance_stats(parts, "batch", "length").select("batch", "least", "most", F.round("mean", 4).alias("mean"))


# code, feedback and judges -------------------------------------------------------------------------------------------

_CODE = "concat('so ```python\n', repeat('x', CAST(doc_id % 7 AS INT)), '\n``` or ```\n', repeat('y', CAST(doc_id % 5 AS INT)), '\n``` and ```sql\n', lang)"


@query("longest_code_block", rf"SELECT doc_id, CASE WHEN length(blocks[1]) >= length(blocks[2]) THEN blocks[1] ELSE blocks[2] END AS code FROM (SELECT doc_id, regexp_extract_all({_CODE}, '```[A-Za-z0-9_+-]*\n([^`]*)```', 1) AS blocks FROM documents)")
def longest_code_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fb.longest_code_block(F.expr(_CODE.replace("\n", "\\n"))).alias("code"))


def recorded_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, tests): recorded runs of each order's tests, in order."""
    line = table(spark, sf_dir, "lineitem")
    say = F.concat(F.lit("case "), F.repeat(F.lit("z"), (F.col("l_partkey") % 9).cast("int")), F.col("l_linenumber").cast("string"))
    rows = line.select(F.col("l_orderkey").alias("row_id"), F.struct(F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("m"), say.alias("input"), (F.col("l_returnflag") != "R").alias("passed")).alias("x"))
    return rows.groupBy("row_id").agg(F.array_sort(F.collect_list("x")).alias("tests"))


_TESTS = """t AS (SELECT l_orderkey AS row_id, l_linenumber AS i, l_partkey AS k, l_suppkey AS m, concat('case ', repeat('z', CAST(l_partkey % 9 AS INT)), CAST(l_linenumber AS VARCHAR)) AS input, l_returnflag <> 'R' AS passed FROM lineitem),
  f AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY length(input), i, k, m) AS n FROM t WHERE NOT passed)"""


@query("failing_tests", f"WITH {_TESTS} SELECT row_id, string_agg(input, '|' ORDER BY n) AS inputs FROM f WHERE n <= 2 GROUP BY row_id")
def failing_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = recorded_tests(spark, sf_dir).select("row_id", fb.first_failures(F.col("tests")).alias("x")).filter(F.size("x") > 0)
    return got.select("row_id", F.array_join(F.transform("x", lambda t: t["input"]), "|").alias("inputs"))


@query(
    "test_feedback",
    f"""WITH {_TESTS}, w AS (SELECT row_id, string_agg('Wrong answer for input ' || input || '.', chr(10) ORDER BY n) AS says FROM f WHERE n <= 2 GROUP BY row_id), r AS (SELECT DISTINCT l_orderkey AS row_id FROM lineitem)
    SELECT row_id, CASE WHEN row_id % 5 = 0 THEN 'The code raised an error: ' || substring('boom ' || repeat('e', 400), 1, 250) WHEN row_id % 7 = 0 THEN 'The code ran out of time.' WHEN row_id % 11 = 0 THEN 'The response has no complete code block.' ELSE coalesce(says, '') END AS says
    FROM r LEFT JOIN w USING (row_id)""",
)
def test_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.col("row_id")
    error = F.when(row % 5 == 0, F.concat(F.lit("boom "), F.repeat(F.lit("e"), F.lit(400)))).otherwise("")
    return recorded_tests(spark, sf_dir).select("row_id", fb.test_feedback(error, row % 7 == 0, row % 11 != 0, F.col("tests")).alias("says"))


@query("feedback_by_source", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END WHEN 1 THEN CASE WHEN doc_id % 6 = doc_id % 5 THEN 1.0 ELSE 0.0 END WHEN 2 THEN CASE WHEN doc_id % 4 = doc_id % 3 THEN 1.0 ELSE 0.0 END ELSE CASE WHEN doc_id % 4 = doc_id % 2 THEN 1.0 ELSE 0.0 END END AS score FROM documents")
def feedback_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    letter = lambda n: F.char(65 + i % n)
    source = F.when(i % 4 == 0, "livecodebench").when(i % 4 == 1, "math500").when(i % 4 == 2, "gpqa").otherwise("sciknoweval")
    solution = F.when(i % 4 == 1, F.concat(F.lit("so \\boxed{"), (i % 6).cast("string"), F.lit("}"))).when(i % 4 == 2, F.concat(F.lit("I say "), letter(4), F.lit("."))).otherwise(F.concat(F.lit("<answer>"), letter(4), F.lit("</answer>")))
    gold = F.when(i % 4 == 1, (i % 5).cast("string")).when(i % 4 == 2, letter(3)).otherwise(letter(2))
    statuses = F.array(F.lit(1), F.when(i % 3 == 0, 1).otherwise(0))
    return table(spark, sf_dir, "documents").select("doc_id", fb.feedback_by_source(source, solution, gold, statuses, F.lit(False)).alias("score"))


@query(
    "feedback_tool_use",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END ELSE CASE WHEN event_id % 3 = user_id % 3 THEN 1.0 ELSE 0.0 END END AS score FROM events""",
)
def feedback_tool_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers of two sources: clicks use a tool, right for even users; others are sums."""
    tool, e = F.col("event_type") == "click", table(spark, sf_dir, "events")
    says = F.concat(F.lit("Action: look\nAction Input: "), "props")
    solution = F.when(tool, says).otherwise(F.concat(F.lit("\\boxed{"), (F.col("event_id") % 3).cast("string"), F.lit("}")))
    actions = F.array(F.when(F.col("user_id") % 2 == 0, "look").otherwise("buy"))
    score = fb.feedback_by_source(F.when(tool, "tooluse").otherwise("math500"), solution, (F.col("user_id") % 3).cast("string"), F.array(F.lit(1)), F.lit(False), actions, F.from_json("props", "map<string,string>"))
    return e.select("event_id", score.alias("score"))


@query("reward_manager_prime_unknown", "SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 3 = 1 THEN 1.0 ELSE 0.0 END AS total FROM events")
def prime_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only clicks have a source that can be scored; others count 0."""
    source = F.when(F.col("event_type") == "click", "openai/gsm8k").otherwise(F.col("event_type"))
    tok = registry.get_reward_manager("prime")(source, F.concat(F.lit("#### "), (F.col("event_id") % 3).cast("string")), F.lit("1"), F.lit(4), 5)
    return table(spark, sf_dir, "events").select("event_id", F.aggregate(tok, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("grade_code_sources", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN round((1 + CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0 END) / 2, 4) ELSE CASE WHEN doc_id % 5 = doc_id % 3 THEN 1.0 ELSE 0.0 END END AS score FROM documents")
def grade_code_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollumen.functions.graders import score_by_source

    i = F.col("doc_id")
    statuses = F.array(F.lit(1), F.when(i % 3 == 0, 1).otherwise(0))
    score = score_by_source(F.when(i % 2 == 0, "codeforces").otherwise("openai/gsm8k"), F.concat(F.lit("#### "), (i % 5).cast("string")), (i % 3).cast("string"), None, statuses)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 4).alias("score"))


@query(
    "judge_cascade",
    """WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'pope_exact' ELSE 'llm' END WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'mmvp_option' ELSE 'llm' END
      WHEN 2 THEN CASE WHEN doc_id % 5 = doc_id % 7 THEN 'mathruler' ELSE 'llm' END ELSE CASE WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN 'first letter' ELSE 'llm' END END AS judge_source FROM documents)
    SELECT doc_id, CASE WHEN judge_source = 'llm' THEN 'No' ELSE 'Yes' END AS judge, judge_source FROM r""",
)
def judge_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "pope").when(i % 4 == 1, "mmvp").when(i % 4 == 2, "free").otherwise("mcq")
    answer = (
        F.when(i % 4 == 0, F.when(i % 3 == 0, "<answer>Yes, it is</answer>").otherwise("<answer>No.</answer>")).when(i % 4 == 1, F.when(i % 3 == 0, "<answer>(A) the left</answer>").otherwise("<answer>(b)</answer>"))
        .when(i % 4 == 2, F.concat(F.lit("<answer>\\frac{"), (i % 5).cast("string"), F.lit("}{8}</answer>"))).otherwise(F.when(i % 3 == 0, "<answer>(C) a cat</answer>").otherwise("<answer>(D) a dog</answer>"))
    )
    gold = F.when(i % 4 == 0, " YES ").when(i % 4 == 1, "(a)").when(i % 4 == 2, F.concat((i % 7).cast("string"), F.lit("/8"))).otherwise("C. cat")
    return table(spark, sf_dir, "documents").select("doc_id", fb.judged(kind, answer, gold, F.lit("No")).alias("x")).select("doc_id", "x.judge", "x.judge_source")


_PAIRS = (
    ("50\\%", "50", True), ("50%", "50", False), ("\\frac12", "\\frac{1}{2}", True), (".5", "0.5", True), ("x=3", "3", True), ("\\sqrt2", "\\sqrt{2}", True), ("3/4", "\\frac{3}{4}", True), ("0.5", "\\frac{1}{2}", True),
    ("\\left(1,2\\right)", "(1,2)", True), ("12\\text{ cm}", "12", True), ("A", "a", False), ("1 2", "12", True), ("7", "8", False), ("\\tfrac{3}{5}", "\\frac{3}{5}", True), ("$5$", "5", False),
)


@query(
    "latex_pairs",
    f"SELECT doc_id, pair, same FROM (SELECT doc_id, doc_id % {len(_PAIRS)} AS pair FROM documents) JOIN (VALUES " + ", ".join(f"({k}, {str(same).upper()})" for k, (_, _, same) in enumerate(_PAIRS)) + ") v(pair, same) USING (pair)",
)
def latex_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with one of the fixed pairs of answers, and what the normalisation must say of them."""
    pairs = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y, _ in _PAIRS])
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % len(_PAIRS)).alias("pair"))
    two = docs.withColumn("two", F.get(pairs, F.col("pair").cast("int")))
    return two.select("doc_id", "pair", latex.equivalent(F.col("two.x"), F.col("two.y")).alias("same"))


def _manager(name: str, sql: str, **options) -> None:
    @query(f"reward_manager_{name}", f"SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 0.0 ELSE {sql} END AS total FROM documents")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        more = {k: f() for k, f in options.items()}
        sol = F.concat(F.lit("#### "), (F.col("doc_id") % 7).cast("string"))
        tok = registry.get_reward_manager(name)(F.lit("openai/gsm8k"), sol, F.lit("1"), F.col("doc_id") % 10, 10, **more)
        return table(spark, sf_dir, "documents").select("doc_id", F.aggregate(tok, F.lit(0.0), lambda a, x: a + x).alias("total"))


for _name in ("naive", "batch", "prime"):
    _manager(_name, "CASE WHEN doc_id % 7 = 1 THEN 1.0 ELSE 0.0 END")
_manager("rate_limited", "CASE WHEN doc_id % 7 = 1 AND doc_id % 4 > 0 THEN 1.0 ELSE 0.0 END", allowed=lambda: F.col("doc_id") % 4 > 0)


# files ---------------------------------------------------------------------------------------------------------------


def folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/files-{uuid.uuid4().hex}"


_ORDERS = "SELECT o_orderkey, o_orderpriority, o_custkey FROM orders"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")


_FORM = "o_orderkey long, o_orderpriority string, o_custkey long"


@query("scan_csv", f"SELECT o_orderkey, o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey FROM ({_ORDERS})")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    orders(spark, sf_dir).withColumn("o_orderpriority", F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.csv_with_header(spark, path, "o_orderkey")


@query("scan_jsonl", f"{_ORDERS} UNION ALL {_ORDERS}")
def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    orders(spark, sf_dir).write.json(f"{path}/a.jsonl")
    orders(spark, sf_dir).write.parquet(f"{path}/b.parquet")
    return readers.scan(spark, [f"{path}/a.jsonl", f"{path}/b.parquet"], _FORM)


@query("scan_json_array", _ORDERS)
def scan_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    sinks.json_array_files(orders(spark, sf_dir).repartition(4), path)
    return readers.json_array(spark, path, _FORM)


@query("scan_tolerant", f"SELECT o_orderkey, o_orderpriority, o_custkey, 2 AS n_bad FROM ({_ORDERS})")
def scan_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    broken = spark.createDataFrame([('{"o_orderkey": ',), ("not json",), (" ",)], "value string")
    orders(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).unionByName(broken).write.text(path)
    good, bad = readers.tolerant_jsonl(spark, path, _FORM)
    return good.crossJoin(F.broadcast(bad.select(F.col("n_bad").cast("int").alias("n_bad"))))


@query("cached_replay", f"SELECT o_orderkey, o_orderpriority, o_custkey, 1 AS made FROM ({_ORDERS})")
def cached_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, made = folder(spark), []

    def make() -> DataFrame:
        made.append(1)
        return orders(spark, sf_dir)

    readers.cached_replay(spark, path, "n", make)
    return readers.cached_replay(spark, path, "n", make).withColumn("made", F.lit(len(made)))


@query("sink_swapped", f"SELECT o_orderkey, o_orderpriority, o_custkey FROM ({_ORDERS}) WHERE o_orderkey % 2 = 0")
def sink_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    sinks.swap_in(orders(spark, sf_dir), path)
    sinks.swap_in(spark.read.parquet(path).filter("o_orderkey % 2 = 0"), path)
    return spark.read.parquet(path)


@query("sink_generations", f"SELECT o_orderkey, o_orderpriority, o_custkey, step FROM ({_ORDERS}), (SELECT unnest([1, 2]) AS step) s")
def sink_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    for step in (1, 2):
        sinks.dump_generations(orders(spark, sf_dir), path, step)
    return spark.read.schema(f"{_FORM}, step int").json(path)


@query("sink_appended", f"{_ORDERS} UNION ALL {_ORDERS}")
def sink_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    for _ in range(2):
        sinks.append_jsonl(orders(spark, sf_dir), path)
    return spark.read.schema(_FORM).json(path)
