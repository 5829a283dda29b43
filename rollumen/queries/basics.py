"""Batch columns, chunks and edges, registries and settings, messages and outputs, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollumen import registry
from rollumen.functions import chat, text
from rollumen.operators import advantages, batch, losses, masked, policy
from rollumen.plans.domain import ROWS, TOK0, scores_of, table, token_lines
from rollumen.queries.policy import r4
from rollumen.queries.tables import _ROWNUM, batch_rows
from rollumen.sources import readers, sinks
from rollumen.streaming import queue

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# columns -------------------------------------------------------------------------------------------------------------


@query("batch_columns", f"WITH {_ROWNUM} SELECT row_id, s AS status, k AS key FROM b")
def batch_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column popped, another one selected, both under new names, and put side by side again."""
    popped, rest = batch.pop(batch_rows(spark, sf_dir), ["s"])
    both = batch.zipped(batch.columns(rest, ["k"]), popped)
    return batch.renamed(both, ["s", "k"], ["status", "key"]).select("row_id", "status", "key")


@query("batch_unfolded", "SELECT vec_id * 4 + c AS row_id, round(list_sum(CAST(embedding[CAST(c * 16 + 1 AS INTEGER):CAST(c * 16 + 16 AS INTEGER)] AS DOUBLE[])), 4) + 0.0 AS total, label FROM embeddings, range(4) t(c)")
def batch_unfolded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    return batch.unfolded(rows, 4, ["v"]).select("row_id", r4(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"), "label")


@query("batch_chunks", "SELECT vec_id // (n // 5) AS chunk, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings, (SELECT count(*) AS n FROM embeddings) GROUP BY 1")
def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"))
    return batch.chunks(rows, 5, rows.count(), "rest").groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


@query("batch_first_padded", f"WITH {_ROWNUM} SELECT row_id, k, false AS is_pad FROM b UNION ALL SELECT n + i, (SELECT k FROM b WHERE row_id = 0), true FROM (SELECT count(*) AS n FROM b), range(3) r(i)")
def batch_first_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch_rows(spark, sf_dir).select("row_id", "k")
    return batch.padded_by_edge(rows, 3, rows.count(), first=True).select("row_id", "k", "is_pad")


@query("logits_scaled", "WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / 0.7) AS v FROM embeddings) SELECT vec_id, round(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 4) + 0.0 AS lse FROM e")
def logits_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", masked.scaled(v, 0.7).alias("v")).select("vec_id", r4(masked.logsumexp(F.col("v"))).alias("lse"))


# settings and registries ---------------------------------------------------------------------------------------------


@query(
    "threshold_pairs",
    """WITH t AS (SELECT event_id, 1 + event_id % 4 AS x FROM events) SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1.0 / x WHEN 1 THEN x / 10.0 END::DOUBLE AS low, CASE event_id % 3 WHEN 0 THEN x WHEN 1 THEN x ELSE x * 0.5 END::DOUBLE AS high FROM t""",
)
def threshold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of twelve settings, each read once, for the events that use them: a bound with its reciprocal, a pair, an upper bound only."""
    read = []
    for i in range(12):
        x = 1 + i % 4
        mode, spec = (("seq_sum_k1", f"{x}"), ("token_k1", f"{x / 10}_{x}"), ("seq_max_k2", f"{x * 0.5}"))[i % 3]
        low, high = policy.parse_thresholds([mode], spec)[mode]
        read.append((i, low, high))
    bounds = F.broadcast(spark.createDataFrame(read, "i long, low double, high double"))  # twelve rows
    return table(spark, sf_dir, "events").join(bounds, F.col("event_id") % 12 == F.col("i")).select("event_id", "low", "high")


@query("bypass_ratios", f"WITH {TOK0} SELECT row_id, t, logp_rollout AS logp_old, round(exp(logp_new - logp_rollout), 4) + 0.0 AS ratio FROM tok0")
def bypass_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In bypass mode the rollout's log-probabilities are the old ones, also where they are reused."""
    lines = token_lines(spark, sf_dir)
    own = policy.bypass(lines) if policy.reuse_rollout_logprobs(lines.columns, 1, 64, 64) else lines
    return own.select("row_id", "t", "logp_old", r4(F.exp(F.col("logp_new") - F.col("logp_old"))).alias("ratio"))


@query(
    "registry_estimators",
    f"""WITH {ROWS}, g AS (SELECT *, count(*) OVER w AS c, avg(score) OVER w AS m, stddev_samp(score) OVER w AS d FROM sc WINDOW w AS (PARTITION BY uid))
    SELECT row_id, round(CASE WHEN c > 1 THEN (score - m) / (d + 1e-6) ELSE score / (1 + 1e-6) END, 3) + 0.0 AS grpo, round(CASE WHEN c > 1 THEN (score - m) * c / (c - 1) ELSE score END, 3) + 0.0 AS rloo FROM g""",
)
def registry_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimators by their names."""
    rows = scores_of(spark, sf_dir)
    for name in ("grpo", "rloo"):
        rows = advantages.estimator(name)(rows).withColumn(name, F.round("advantage", 3) + 0.0).drop("advantage")
    return rows.select("row_id", "grpo", "rloo")


@query("registry_losses", "SELECT unnest(['clip_cov', 'gpg', 'vanilla']) AS name, true AS known, count(*) AS lines FROM lineitem GROUP BY 1, 2")
def registry_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses by their names, with the size of the table that they'd reduce."""
    known = losses.names()
    own = token_lines(spark, sf_dir).agg(F.count(F.lit(1)).alias("lines"))
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(n in known and callable(losses.policy_loss(n))).alias("known")) for n in ("clip_cov", "gpg", "vanilla")])
    return own.select(F.explode(names).alias("x"), "lines").select("x.name", "x.known", "lines")


@query("loaded_function", "SELECT doc_id, n_chars * 24576 + n_chars * n_chars AS cost FROM documents")
def loaded_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function found by its dotted name."""
    cost = registry.load("rollumen.functions.arrays", "workload")
    return table(spark, sf_dir, "documents").select("doc_id", cost(F.col("n_chars")).alias("cost"))


@query("config_flattened", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'actor/lr' WHEN 1 THEN 'actor/layers/list_len' WHEN 2 THEN 'actor/layers/1' ELSE 'seed' END AS name, CASE event_id % 4 WHEN 0 THEN '0.1' WHEN 1 THEN '2' WHEN 2 THEN 'b' ELSE '7' END AS value FROM events")
def config_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the flattened setting that they name."""
    flat = sinks.flattened({"actor": {"lr": 0.1, "layers": ["a", "b"]}, "seed": 7})
    settings = F.broadcast(spark.createDataFrame([(k, str(v)) for k, v in flat.items()], "name string, value string"))  # five rows
    asked = F.element_at(F.array(*map(F.lit, ("actor/lr", "actor/layers/list_len", "actor/layers/1", "seed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", asked.alias("name")).join(settings, "name")


@query("benchmark_splits", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'adversarial' WHEN 2 THEN 'popular' ELSE 'random' END AS split FROM documents")
def benchmark_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the split that their benchmark is read from."""
    names = F.create_map(*[F.lit(x) for pair in readers.SPLITS.items() for x in pair])
    benchmark = F.element_at(F.array(*map(F.lit, ("pope", "pope_adv", "pope_pop", "pope_random"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(names, benchmark).alias("split"))


# messages and outputs ------------------------------------------------------------------------------------------------


@query("message_text", "SELECT conv_id, turn, sha256(CASE WHEN turn % 2 = 0 THEN '<image>' ELSE '' END || coalesce(text, '') || CASE WHEN turn % 3 = 0 THEN '<video>' ELSE '' END) AS said FROM conversations")
def message_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda kind, said: F.struct(F.lit(kind).alias("type"), said.alias("text"))
    none = F.lit(None).cast("string")
    parts = F.array(F.when(F.col("turn") % 2 == 0, part("image", none)), part("text", F.col("text")), F.when(F.col("turn") % 3 == 0, part("video", none)))
    said = chat.parts_to_text(F.filter(parts, lambda p: p.isNotNull()))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(said, 256).alias("said"))


@query("stdout_equal", "SELECT doc_id, doc_id % 3 <> 1 AS same FROM documents WHERE text IS NOT NULL")
def stdout_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's text as a program's output, with blanks around it, and with another last word."""
    printed = F.concat(F.lit(" \n"), "text", F.when(F.col("doc_id") % 3 == 1, " other").otherwise("\n\n"))
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.same_stdout(printed, F.col("text")).alias("same"))


@query(
    "version_staleness",
    """SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'view') + count(*) FILTER (WHERE event_type = 'error') + least(count(*) FILTER (WHERE event_type = 'click'), 4) AS BIGINT) AS stale FROM events GROUP BY user_id""",
)
def version_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts against the limit when the parameters are updated: active and cancelled samples, and those in a queue of 4."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(queue.staleness_counter(n("view"), n("error"), F.least(n("click"), F.lit(4))).alias("stale"))
