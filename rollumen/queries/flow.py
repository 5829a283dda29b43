"""Chat, partitioning, streaming, sources and sinks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollumen import registry
from rollumen.functions import arrays, chat
from rollumen.operators import partition
from rollumen.plans.domain import table
from rollumen.queries.policy import r4, rounded
from rollumen.sources import readers, sinks
from rollumen.streaming import queue
from rollumen.streaming.replay import finished, stream_of

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# chat ----------------------------------------------------------------------------------------------------------------


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation(table(spark, sf_dir, "conversations"))


@query(
    "chat_rendered",
    """SELECT conv_id, sha256(string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10)) AS rendered FROM conversations GROUP BY conv_id""",
)
def chat_rendered(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", F.sha2(chat.rendered(F.col("messages"), True), 256).alias("rendered"))


@query(
    "chat_loss_segments",
    """SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) + 11 ELSE 0 END) AS BIGINT) AS learnt, CAST(sum(length(role) + 13 + CASE WHEN role = 'assistant' THEN 0 ELSE length(text) + 11 END) AS BIGINT) AS other FROM conversations GROUP BY conv_id""",
)
def loss_segments(spark, sf_dir):
    seg = conversations(spark, sf_dir).select("conv_id", F.explode(chat.loss_segments(F.col("messages"))).alias("s"))
    n = F.length("s.text").cast("long")
    return seg.groupBy("conv_id").agg(F.sum(F.when(F.col("s.learn") == 1, n).otherwise(0)).alias("learnt"), F.sum(F.when(F.col("s.learn") == 0, n).otherwise(0)).alias("other"))


@query(
    "chat_last_assistant",
    """SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS answer FROM conversations GROUP BY conv_id""",
)
def last_assistant(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", chat.last_assistant(F.col("messages")).alias("answer"))


@query(
    "chat_turn_states",
    """SELECT conv_id, 'pending,' || string_agg(CASE role WHEN 'assistant' THEN 'generating' WHEN 'user' THEN 'interacting' ELSE 'pending' END, ',' ORDER BY turn) || ',terminated' AS states FROM conversations GROUP BY conv_id""",
)
def turn_states(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", F.array_join(chat.turn_states(F.transform("messages", lambda m: m["role"])), ",").alias("states"))


@query(
    "chat_response_masks",
    """SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS n, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS valid FROM conversations GROUP BY conv_id""",
)
def response_masks(spark, sf_dir):
    c = conversations(spark, sf_dir)
    m = chat.response_masks(F.transform("messages", lambda x: F.length(x["content"])), F.transform("messages", lambda x: x["role"]))
    return c.select("conv_id", m.alias("m")).select("conv_id", F.size("m").cast("long").alias("n"), F.aggregate("m", F.lit(0), lambda a, x: a + x).cast("long").alias("valid"))


@query(
    "chat_tool_calls",
    """SELECT event_id, 'so  then' AS content, CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_type END AS name, CASE WHEN user_id % 3 = 0 THEN NULL ELSE props END AS arguments FROM events""",
)
def tool_calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.when(F.col("user_id") % 3 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}")))
    text = F.concat(F.lit("so <tool_call>"), body, F.lit("</tool_call> then"))
    got = e.select("event_id", "props", chat.tool_calls(text).alias("x"))
    call = F.try_element_at("x.calls", F.lit(1))
    # the parser keeps arguments as JSON text; spacing is that of its writer
    same = F.to_json(F.from_json("props", "map<string,int>")) == F.to_json(F.from_json(call["arguments"], "map<string,int>"))
    return got.select("event_id", F.col("x.content").alias("content"), call["name"].alias("name"), F.when(same, F.col("props")).alias("arguments"))


@query(
    "chat_segments",
    """SELECT doc_id, lang || '|<image>|' || source || '|<video>' AS segments FROM documents""",
)
def segments(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.concat("lang", F.lit("<image>"), "source", F.lit("<video>"))
    return d.select("doc_id", F.array_join(chat.checked_segments(text, F.lit(1), F.lit(1)), "|").alias("segments"))


@query("chat_teacher_images", "SELECT doc_id, lang || '<image:a> and <image:b>' || source AS text FROM documents")
def teacher_images(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", chat.with_teacher_images(F.concat("lang", F.lit("<image> and <image>"), "source"), F.array(F.lit("a"), F.lit("b"))).alias("text"))


@query(
    "chat_teacher_prompt",
    """SELECT doc_id, lang || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Correct solution:' || chr(10) || chr(10) || source ELSE chr(10) || chr(10) || 'Feedback on an earlier attempt:' || chr(10) || chr(10) || 'wrong' END AS prompt FROM documents""",
)
def teacher_prompt(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", chat.teacher_prompt(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit("wrong")).alias("prompt"))


@query(
    "chat_teacher_sequence",
    """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '7,8,9,1,2' ELSE '7,8,9,1,2' END AS ids, CASE WHEN user_id % 2 = 0 THEN '0,1,1,1,0' ELSE '1,1,1,1,0' END AS mask, 3 AS start, CASE WHEN user_id % 2 = 0 THEN '0,0,1,2,3' ELSE '0,1,2,3,4' END AS positions FROM events""",
)
def teacher_sequence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ints = lambda *v: F.array(*[F.lit(x) for x in v])
    mask = F.when(F.col("user_id") % 2 == 0, ints(0, 1, 1)).otherwise(ints(1, 1, 1))
    x = e.select("event_id", chat.teacher_sequence(ints(7, 8, 9), ints(1, 2), mask, ints(1, 0)).alias("x"))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return x.select("event_id", text("x.ids").alias("ids"), text("x.mask").alias("mask"), F.col("x.start").alias("start"), text("x.positions").alias("positions"))


# partitioning --------------------------------------------------------------------------------------------------------


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("k"), (F.floor(F.col("o_totalprice") / 1000) + 1).alias("n"), F.col("o_orderstatus").alias("s"))


def _greedy(more: str) -> str:
    """Sums of three parts, step by step; a batch of fewer rows has fewer parts."""
    return f"""WITH RECURSIVE o AS (SELECT o_custkey AS batch, o_orderkey AS k, CAST(floor(o_totalprice / 1000) AS BIGINT) + 1 AS n FROM orders),
    e AS (SELECT batch, k, 24576 * n + n * n AS size, row_number() OVER (PARTITION BY batch ORDER BY k) AS i, count(*) OVER (PARTITION BY batch) AS c, sum(24576 * n + n * n) OVER (PARTITION BY batch) AS total FROM o),
    f AS (SELECT batch, 0::BIGINT AS k, 0::BIGINT AS i, 0 AS part, 0::HUGEINT AS x, CASE WHEN c > 1 THEN 0 ELSE 10**30 END::HUGEINT AS y, CASE WHEN c > 2 THEN 0 ELSE 10**30 END::HUGEINT AS z FROM e WHERE i = 1 UNION ALL
      SELECT batch, k, i, p, CASE WHEN p = 0 THEN x + size + more ELSE x END, CASE WHEN p = 1 THEN y + size + more ELSE y END, CASE WHEN p = 2 THEN z + size + more ELSE z END
      FROM (SELECT e.*, f.x, f.y, f.z, CASE WHEN f.x <= f.y AND f.x <= f.z THEN 0 WHEN f.y <= f.z THEN 1 ELSE 2 END AS p, {more} AS more FROM f JOIN e ON e.batch = f.batch AND e.i = f.i + 1))
    SELECT batch, k, part FROM f WHERE i > 0"""


_PARTITIONS = {"greedy": _greedy("0"), "greedy_equal": _greedy("CASE WHEN c % least(c, 3) = 0 THEN total + 1 ELSE 0 END")}

for _method in partition.METHODS:

    @query(f"partition_{_method}", _PARTITIONS.get(_method))
    def _partition(spark, sf_dir, method=_method):
        """A sequential algorithm inside each batch; where SQL can't say it, tests hold it against invariants and small cases."""
        return partition.partitioned(batches(spark, sf_dir), "batch", "k", "n", method, 3, 2000, "s", small="fit")


@query(
    "partition_cover",
    """SELECT o_custkey AS batch, count(*) AS n, least(count(*), 3) AS parts FROM orders GROUP BY o_custkey""",
)
def partition_cover(spark, sf_dir):
    """Every row is in one part and no part is empty."""
    parts = partition.partitioned(batches(spark, sf_dir), "batch", "k", "n", "differencing", 3, small="fit")
    return parts.groupBy("batch").agg(F.count_distinct("k").alias("n"), F.count_distinct("part").alias("parts"))


@query("workload_cost", "SELECT doc_id, 24576 * n_chars + n_chars * n_chars AS cost, CAST(ceil(n_chars / 512) AS BIGINT) AS blocks, CAST(ceil(n_chars / 512) * 512 AS BIGINT) AS rounded FROM documents")
def workload_cost(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", arrays.workload(n).alias("cost"), arrays.ceil_div(n, F.lit(512)).alias("blocks"), arrays.rounded_up(n, F.lit(512)).alias("rounded"))


@query(
    "clamped_boxes",
    """WITH b AS (SELECT p_partkey, greatest(p_size - 30.0, 0) AS x1, 0.0 AS y1, least(p_size * 3.0, 100.0) AS x2, least(p_retailprice, 50.0) AS y2 FROM part)
    SELECT p_partkey, CASE WHEN x2 > x1 AND y2 > y1 AND greatest(x2 - x1, y2 - y1) <= 100 * least(x2 - x1, y2 - y1) THEN round((x2 - x1) * (y2 - y1), 4) + 0.0 END AS area FROM b""",
)
def clamped_boxes(spark, sf_dir):
    box = arrays.clamped_box(F.col("p_size") - 30.0, F.lit(-5.0), F.col("p_size") * 3.0, F.col("p_retailprice"), F.lit(100), F.lit(50))
    b = table(spark, sf_dir, "part").select("p_partkey", box.alias("b"))
    return b.select("p_partkey", r4((F.col("b.x2") - F.col("b.x1")) * (F.col("b.y2") - F.col("b.y1"))).alias("area"))


# streaming -----------------------------------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_of(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)


@query(
    "stream_bounded_queue",
    """WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(n) AS produced, greatest(max(n) - 5, 0) AS dropped, least(max(n), 5) AS size, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS items FROM e WHERE k <= 5 GROUP BY event_type""",
)
def stream_bounded_queue(spark, sf_dir):
    out = finished(queue.bounded_queue(event_stream(spark, sf_dir).select("event_type", "event_id"), "event_type", "event_id", 5), "update")
    last = F.max(F.struct("batch", "produced", "dropped", "size", "items"))
    return out.groupBy("event_type").agg(last.alias("x")).select("event_type", "x.produced", "x.dropped", "x.size", "x.items")


@query(
    "stream_counted_batches",
    """WITH e AS (SELECT event_type, event_id, CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 50) AS BIGINT) AS batch FROM events)
    SELECT event_type, batch, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS items FROM e GROUP BY event_type, batch HAVING count(*) = 50""",
)
def stream_counted_batches(spark, sf_dir):
    s = queue.counted_batches(event_stream(spark, sf_dir).select("event_type", "event_id"), "event_type", "event_id", 50)
    # `batch` is the operator's own column here; the micro-batch of the stream isn't needed
    return finished(s.withColumnRenamed("batch", "number")).select("event_type", F.col("number").alias("batch"), "items")


@query("stream_expanded", "SELECT event_id, sample FROM events, (SELECT unnest([0, 1, 2]) AS sample) s")
def stream_expanded(spark, sf_dir):
    return finished(queue.expanded(event_stream(spark, sf_dir).select("event_id"), 3)).select("event_id", "sample")


@query(
    "stream_metric_windows",
    """SELECT CAST(floor(event_id / 100) AS BIGINT) AS w, event_type, round(avg(value), 4) + 0.0 AS mean, round(max(value), 4) + 0.0 AS max, count(*) AS n FROM events GROUP BY floor(event_id / 100), event_type""",
)
def stream_metric_windows(spark, sf_dir):
    s = event_stream(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 100).alias("w"), "event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n"))
    out = finished(s, "update")
    last = out.groupBy("w", "event_type").agg(F.max_by(F.struct("mean", "max", "n"), "batch").alias("x")).select("w", "event_type", "x.*")
    return rounded(last, "w", "event_type", "n")


@query(
    "stream_event_time",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
)
def stream_event_time(spark, sf_dir):
    """Hourly windows behind a watermark: an addition to the version lag that samples carry. In update mode the last state
    of each window counts."""
    s = event_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "3650 days")
    out = finished(s.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n"), "update")
    return out.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("queue_state", """SELECT user_id, count(*) AS produced, greatest(count(*) - 3, 0) AS dropped, least(count(*), 3) AS size, array_to_string(list(event_id ORDER BY event_id)[-3:], ',') AS items FROM events GROUP BY user_id""")
def queue_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(queue.queue_state(F.array_sort(F.collect_list("event_id")), 3).alias("q"))
    return e.select("user_id", F.col("q.produced").cast("long").alias("produced"), F.col("q.dropped").cast("long").alias("dropped"), F.col("q.size").cast("long").alias("size"), F.array_join(F.transform("q.items", lambda x: x.cast("string")), ",").alias("items"))


@query(
    "back_pressure",
    """SELECT event_id, (event_id % 7 >= 5 OR user_id % 40 >= 36) AS pause FROM events""",
)
def back_pressure(spark, sf_dir):
    limit = queue.capacity_limit(8, 0.5, 3)
    return table(spark, sf_dir, "events").select("event_id", queue.should_pause(F.col("event_id") % 7, 5, F.col("user_id") % 40, limit).alias("pause"))


@query(
    "rate_limiter",
    """WITH RECURSIVE e AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS k, CAST(event_id AS DOUBLE) AS tm, 3.0 + event_id % 5 AS cost FROM events),
    f AS (SELECT user_id, k, tm + greatest((cost - 6.0) / 0.5, 0) AS let, 6.0 + greatest((cost - 6.0) / 0.5, 0) * 0.5 - cost AS level FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.k, greatest(e.tm, f.let) + greatest((e.cost - least(6.0, f.level + (greatest(e.tm, f.let) - f.let) * 0.5)) / 0.5, 0),
        least(6.0, f.level + (greatest(e.tm, f.let) - f.let) * 0.5) + greatest((e.cost - least(6.0, f.level + (greatest(e.tm, f.let) - f.let) * 0.5)) / 0.5, 0) * 0.5 - e.cost
      FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, k, round(let, 4) + 0.0 AS let_through FROM f""",
)
def rate_limiter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").cast("double").alias("at"), (3.0 + F.col("event_id") % 5).alias("cost"))
    out = queue.let_through(e, "user_id", "at", "cost", 0.5, 6.0, ["event_id"])
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return out.select("user_id", k.alias("k"), r4(F.col("let_through")).alias("let_through"))


@query(
    "least_loaded_routing",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(event_id AS DOUBLE) AS tm, value AS lasts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    f AS (SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS event_id, 0 AS server, []::DOUBLE[] AS a, []::DOUBLE[] AS b, []::DOUBLE[] AS c FROM (SELECT DISTINCT user_id FROM events) UNION ALL
      SELECT user_id, k, event_id, pick, CASE WHEN pick = 0 THEN list_append(a, tm + lasts) ELSE a END, CASE WHEN pick = 1 THEN list_append(b, tm + lasts) ELSE b END, CASE WHEN pick = 2 THEN list_append(c, tm + lasts) ELSE c END
      FROM (SELECT *, CASE WHEN len(a) <= len(b) AND len(a) <= len(c) THEN 0 WHEN len(b) <= len(c) THEN 1 ELSE 2 END AS pick FROM (SELECT e.*, list_filter(f.a, lambda x: x > e.tm) AS a,
        list_filter(f.b, lambda x: x > e.tm) AS b, list_filter(f.c, lambda x: x > e.tm) AS c FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)))
    SELECT user_id, CAST(k - 1 AS INTEGER) AS k, server FROM f WHERE k > 0""",
)
def least_loaded(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").cast("double").alias("at"), F.col("value").alias("seconds"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return queue.routed(e, "user_id", "at", "seconds", 3, ["event_id"]).select("user_id", k.alias("k"), "server")


@query("retry_backoff", "SELECT event_id, least(pow(2.0, event_id % 8), 30.0) AS seconds FROM events")
def retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", queue.backoff(F.col("event_id") % 8).alias("seconds"))


@query("partial_rollouts", "SELECT user_id AS sample_id, CAST(min(floor(event_id / 100)) AS BIGINT) AS start_version, CAST(max(floor(event_id / 100)) AS BIGINT) AS end_version, max(floor(event_id / 100)) > min(floor(event_id / 100)) AS is_partial FROM events GROUP BY user_id")
def partial_rollouts(spark, sf_dir):
    seg = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), F.floor(F.col("event_id") / 100).alias("version"), F.lit(False).alias("cancelled"))
    return queue.partial_rollouts(seg)


@query("one_step_behind", "SELECT user_id, batch, lag(batch) OVER (PARTITION BY user_id ORDER BY batch) AS previous FROM (SELECT DISTINCT user_id, CAST(floor(event_id / 100) AS BIGINT) AS batch FROM events)")
def one_step_behind(spark, sf_dir):
    from rollumen.operators.joins import lagged_batches

    b = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 100).alias("batch")).distinct()
    return lagged_batches(b, "batch", "user_id").select("user_id", "batch", "previous")


# sources, sinks, registries ------------------------------------------------------------------------------------------


@query("scan_union", "SELECT r_name AS name FROM region UNION ALL SELECT r_name FROM region")
def scan_union(spark, sf_dir):
    return readers.scan(spark, [f"{sf_dir}/region.parquet"] * 2).select(F.col("r_name").alias("name"))


@query("scan_pruned_nested", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def scan_nested(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("props"))
    return e.select("event_id", readers.nested(e, "props", ["k"]).alias("k"))


@query("filter_within_length", "SELECT doc_id FROM documents WHERE doc_id % 9 <> 0 AND n_chars <= 2000")
def filter_within_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return readers.within_length(d, F.when(F.col("doc_id") % 9 != 0, F.col("n_chars")), 2000).select("doc_id")


@query("filter_teacher_image", "SELECT doc_id, doc_id % 3 = 0 AS has FROM documents")
def filter_teacher_image(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", readers.with_teacher_image(F.array(F.lit(""), F.when(F.col("doc_id") % 3 == 0, F.col("source")))).alias("has"))


@query("sink_responses", "SELECT o_custkey AS row_id, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS responses FROM orders GROUP BY o_custkey")
def sink_responses(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row_id"), F.col("o_orderkey").alias("sample"), F.col("o_orderstatus").alias("response"))
    return sinks.responses(o).select("row_id", F.array_join("responses", ",").alias("responses"))


@query(
    "sink_console_lines",
    """SELECT user_id AS step, 'step:' || user_id || ' - ' || string_agg(event_type || ':' || format('{:.3f}', v), ' - ' ORDER BY event_type) AS line FROM (SELECT user_id, event_type, floor(max(value)) AS v FROM events GROUP BY user_id, event_type) GROUP BY user_id""",
)
def console_lines(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("step"), F.col("event_type").alias("name")).agg(F.floor(F.max("value")).cast("double").alias("value"))
    return sinks.console_lines(m)


@query("sink_metric_lines", """SELECT user_id AS step, count(DISTINCT event_type) AS n FROM events GROUP BY user_id""")
def metric_lines(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("step"), F.col("event_type").alias("name")).agg(F.max("value").alias("value"))
    return sinks.metric_lines(m).select("step", F.size(F.json_object_keys(F.get_json_object("line", "$.data"))).cast("long").alias("n"))


@query("sink_valid_logprobs", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag <> 'R'")
def valid_logprobs(spark, sf_dir):
    from rollumen.plans.domain import token_lines

    return sinks.valid_logprobs(token_lines(spark, sf_dir), "logp_old").agg(F.count(F.lit(1)).alias("n"))


@query("seeded_sample", "SELECT doc_id, CAST(doc_id AS VARCHAR) AS input FROM documents ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), input LIMIT 20")
def seeded_sample(spark, sf_dir):
    return sinks.sample_table(table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("input")), 20)


@query(
    "reward_placement",
    """SELECT event_id, i, CASE WHEN i = user_id % 6 - 1 THEN value ELSE 0 END AS reward FROM events, (SELECT unnest([0, 1, 2, 3, 4]) AS i) x""",
)
def reward_placement(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.posexplode(registry.placed(F.col("value"), F.col("user_id") % 6, 5)).alias("i", "reward"))


@query(
    "reward_manager_dapo",
    """SELECT doc_id, round(CASE WHEN doc_id % 10 = 0 THEN 0.0 ELSE (CASE WHEN doc_id % 7 = 1 THEN 1.0 ELSE 0.0 END) + least(-(doc_id % 10 - (8 - 4)) / 4 * 0.5, 0) END, 4) + 0.0 AS total FROM documents""",
)
def reward_manager_dapo(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sol = F.concat(F.lit("#### "), (F.col("doc_id") % 7).cast("string"))
    tok = registry.get_reward_manager("dapo")(F.lit("openai/gsm8k"), sol, F.lit("1"), F.col("doc_id") % 10, 10, 8, 4, 0.5)
    return d.select("doc_id", r4(F.aggregate(tok, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(
    "flagship_report",
    """WITH j AS (SELECT d.lang, CASE WHEN l.quality = 1 THEN 1.0 ELSE 0 END AS ok FROM documents d JOIN labels l USING (doc_id))
    SELECT lang, count(*) AS total, round(avg(ok), 4) + 0.0 AS accuracy FROM j GROUP BY GROUPING SETS ((lang), ())""",
)
def flagship_report(spark, sf_dir):
    """Accuracy of judged answers by language, and over all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    ok = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("quality") == 1).cast("double").alias("ok"))
    return ok.rollup("lang").agg(F.count(F.lit(1)).alias("total"), r4(F.avg("ok")).alias("accuracy"))


@query(
    "rank_within_batch",
    "SELECT o_custkey AS uid, o_orderkey AS k, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS part FROM orders",
)
def rank_within_batch(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("k"), F.ntile(4).over(w).alias("part"))
