"""Streams that stop and go on, queues, samples across versions and growing tables, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollumen.plans.domain import table
from rollumen.streaming import samples
from rollumen.streaming.appended import AppendLog, generating
from rollumen.streaming.ordered import ordered_fold, ticks
from rollumen.streaming.resume import Run, keyed_state, opened, staged, work_folder

QUERIES, ORACLE_SQL = {}, {}
#: Events may come so late; the driver's span 30 days, which are staged in PARTS.
LATE, PARTS = "16 days", 4
#: Rows of a state, about.
BUCKET = 2_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "stream_resumed",
    "SELECT user_id, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents, max(event_id) AS last FROM events GROUP BY user_id, event_type",
)
def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of a stream that dies twice, before and after writing a batch, and is resumed from its folder."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    folder = work_folder(spark, "resumed")
    source = staged(events, "event_id", PARTS, f"{folder}/in")
    sums = source.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.max("event_id").alias("last"))
    opened(spark, f"{folder}/runs", "disable").advance(sums, "update", before=1)
    first = opened(spark, f"{folder}/runs", "auto")
    first.advance(sums, "update", after=2)
    last = opened(spark, f"{folder}/runs", "resume_path", first.folder)
    if not last.advance(sums, "update"):
        raise RuntimeError("the stream has not come to its end")
    rows = last.rows(sums.schema)
    return rows.groupBy("user_id", "event_type").agg(F.max_by(F.struct("n", "cents", "last"), "batch").alias("x")).select("user_id", "event_type", "x.*")


@query(
    "stream_appended",
    """WITH RECURSIVE g AS (SELECT o_orderkey AS id, 0 AS round, CAST(floor(o_totalprice) AS BIGINT) AS cost FROM orders UNION ALL
    SELECT id, round + 1, cost // 2 FROM g WHERE cost >= 100000) SELECT id, round, cost FROM g""",
)
def stream_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A growing table: orders are appended in two segments, the second after the first has been read, and each round of rows that cost 100,000 or
    more is appended again at half the cost, until none is left. Every row is read once."""
    orders = table(spark, sf_dir, "orders")
    base = orders.select(F.col("o_orderkey").alias("id"), F.lit(0).alias("round"), F.floor("o_totalprice").cast("long").alias("cost"))
    folder = work_folder(spark, "appended")
    log, run = AppendLog(spark, f"{folder}/table"), Run(spark, f"{folder}/run")
    early = F.col("id") % 2 == 0
    log.append(base.filter(early))

    def generate(rows: DataFrame, number: int) -> DataFrame:
        new = rows.filter("cost >= 100000").select("id", (F.col("round") + 1).alias("round"), F.floor(F.col("cost") / 2).cast("long").alias("cost"))
        return new.unionAll(base.filter(~early)) if number == 0 else new

    generating(log, run, base.schema, generate, 64)
    return run.rows(base.schema).select("id", "round", "cost")


def _folded(spark: SparkSession, rows: DataFrame, at: str, order: str, fold, out: str, name: str) -> DataFrame:
    """ordered_fold() over a bounded table, staged in the order of time."""
    rows = rows.withColumn(at, F.col(at).cast("timestamp"))
    folder = work_folder(spark, name)
    tick = ticks(rows, at, LATE)
    source = staged(rows.unionByName(tick), at, PARTS, f"{folder}/in")
    with keyed_state(spark):
        stream = ordered_fold(source, "user_id", at, LATE, [order], fold, out, 1 + rows.count() // BUCKET)
        run = Run(spark, f"{folder}/run")
        run.advance(stream)
        tick.write.parquet(f"{folder}/in/part={PARTS}")  # the first tick moves the watermark for the batch of the second
        run.advance(stream)
    return run.rows(stream.schema).drop("batch")


OPERATION = "CASE WHEN event_type = 'view' THEN 'get' WHEN event_type = 'purchase' THEN 'put_validate' WHEN event_type = 'signup' THEN 'get_validate' WHEN event_type = 'error' AND event_id % 20 = 0 THEN 'shutdown' ELSE 'put' END"


@query(
    "stream_two_queues",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id AS id, {OPERATION} AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT user_id, 0::BIGINT AS k, []::BIGINT[] AS q, []::BIGINT[] AS v, []::BIGINT[] AS w, true AS open, 0::BIGINT AS dropped,
        []::STRUCT(consumer BIGINT, item BIGINT, mark VARCHAR, size INTEGER, dropped BIGINT)[] AS o FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL SELECT f.user_id, e.k,
        CASE WHEN op = 'put' AND len(w) = 0 THEN list_append(CASE WHEN len(q) >= 3 THEN q[2:] ELSE q END, id) WHEN op = 'get' THEN q[2:] ELSE q END,
        CASE WHEN op = 'put_validate' THEN list_append(v, id) WHEN op = 'get_validate' THEN v[2:] ELSE v END,
        CASE WHEN op = 'put' THEN w[2:] WHEN op = 'get' AND len(q) = 0 AND open THEN list_append(w, id) WHEN op = 'shutdown' THEN [] ELSE w END,
        open AND op <> 'shutdown', f.dropped + CASE WHEN op = 'put' AND len(w) = 0 AND len(q) >= 3 THEN 1 ELSE 0 END,
        CASE WHEN op = 'put' AND len(w) > 0 THEN [{{'consumer': w[1], 'item': id, 'mark': 'item', 'size': 0, 'dropped': f.dropped}}]
          WHEN op = 'get' AND len(q) > 0 THEN [{{'consumer': id, 'item': q[1], 'mark': 'item', 'size': CAST(len(q) - 1 AS INTEGER), 'dropped': f.dropped}}]
          WHEN op = 'get' AND NOT open THEN [{{'consumer': id, 'item': CAST(NULL AS BIGINT), 'mark': 'end', 'size': 0, 'dropped': f.dropped}}]
          WHEN op = 'get_validate' THEN [{{'consumer': id, 'item': v[1], 'mark': CASE WHEN len(v) > 0 THEN 'validate' ELSE 'none' END, 'size': CAST(greatest(len(v) - 1, 0) AS INTEGER), 'dropped': f.dropped}}]
          WHEN op = 'shutdown' THEN list_transform(w, lambda x: {{'consumer': x, 'item': CAST(NULL AS BIGINT), 'mark': 'end', 'size': 0, 'dropped': f.dropped}})
          ELSE [] END
      FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, x.consumer AS consumer, x.item AS item, x.mark AS mark, x.size AS size, x.dropped AS dropped FROM (SELECT user_id, unnest(o) AS x FROM f)""",
)
def stream_two_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as operations on a queue of 3 samples and its validation queue."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("id"), F.expr(OPERATION).alias("op"))
    fold, out = samples.two_queues(3)
    return _folded(spark, rows, "ts", "id", fold, out, "two-queues")


@query(
    "stream_partial_rollouts",
    """WITH RECURSIVE e AS (SELECT user_id, event_id // 100 AS version, event_type <> 'purchase' AS cancelled, list_transform(range(1 + event_id % 7), lambda j: event_id * 10 + j) AS t,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT user_id, k, 0 AS attempt, t AS tokens, [0] AS starts, [version] AS versions, NOT cancelled OR len(t) >= 24 AS done FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.k, CASE WHEN done THEN attempt + 1 ELSE attempt END, CASE WHEN done THEN t ELSE list_concat(tokens, t) END,
        CASE WHEN done THEN [0] ELSE list_append(starts, CAST(len(tokens) AS INTEGER)) END, CASE WHEN done THEN [e.version] ELSE list_append(versions, e.version) END,
        NOT cancelled OR CASE WHEN done THEN len(t) ELSE len(tokens) + len(t) END >= 24 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, attempt, array_to_string(tokens[:24], ',') AS tokens, array_to_string(starts, ',') AS starts, array_to_string(versions, ',') AS versions,
      versions[1] AS start_version, versions[-1] AS end_version, len(versions) > 1 AS is_partial FROM f WHERE done""",
)
def stream_partial_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as segments of samples of at most 24 tokens; all but purchases were cancelled by an update."""
    tokens = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 7).cast("int")), lambda j: F.col("event_id") * 10 + j)
    rows = table(spark, sf_dir, "events").select(
        "user_id", "ts", F.col("event_id").alias("id"), F.floor(F.col("event_id") / 100).alias("version"), tokens.alias("tokens"), (F.col("event_type") != "purchase").alias("cancelled")
    )
    fold, out = samples.resumed_rollouts(24)
    done = _folded(spark, rows, "ts", "id", fold, out, "rollouts")
    joined = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("tokens", "starts", "versions")]
    return done.select("user_id", "attempt", *joined, "start_version", "end_version", "is_partial")
