"""Agent loops, resampling, token masks, packed prefixes and bounded calls over the driver's tables."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollumen.functions import arrays, chat, graders, symbolic, token_masks
from rollumen.operators import advantages, agents, inflight, padding, partition, prefixes, resampling
from rollumen.plans.domain import ORDER, ROWS, scores_of, table, trajectories
from rollumen.queries.policy import r4

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# agent loops ---------------------------------------------------------------------------------------------------------

_TURNS = r"""t AS (SELECT conv_id, turn, role, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS INTEGER) AS n, CASE WHEN role = 'assistant' THEN length(text) % 3 ELSE 0 END AS calls,
      length(text) % 5 = 0 AS stop FROM conversations),
    f AS (SELECT conv_id, min(turn) AS first FROM t WHERE role = 'assistant' GROUP BY conv_id),
    r AS (SELECT conv_id, turn, n, calls, stop, CASE WHEN role = 'user' AND lag(calls, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) > 0 THEN 'tool' ELSE role END AS role FROM t),
    k AS (SELECT r.*, row_number() OVER (PARTITION BY r.conv_id ORDER BY turn) AS k FROM r JOIN f ON f.conv_id = r.conv_id AND r.turn >= f.first),
    s AS (SELECT conv_id, 0::BIGINT AS k, 0::BIGINT AS turn, 'generating' AS state, 'generating' AS next, 0 AS mask, 0 AS start, 0 AS upto, 0 AS a, 0 AS u FROM f UNION ALL
      SELECT conv_id, k, turn, state, CASE WHEN NOT ok THEN 'terminated' WHEN state = 'generating' THEN CASE WHEN upto + n >= 120 OR a + 1 >= 3 OR u >= 4 THEN 'terminated' WHEN calls > 0 THEN 'tools' ELSE 'interacting' END
          WHEN state = 'tools' THEN 'generating' ELSE CASE WHEN stop THEN 'terminated' ELSE 'generating' END END,
        CASE WHEN ok AND state = 'generating' THEN 1 ELSE 0 END, upto, upto + CASE WHEN ok THEN n ELSE 0 END, a + CASE WHEN ok AND state = 'generating' THEN 1 ELSE 0 END, u + CASE WHEN ok AND state <> 'generating' THEN 1 ELSE 0 END
      FROM (SELECT k.*, s.next AS state, s.upto, s.a, s.u, CASE s.next WHEN 'generating' THEN k.role = 'assistant' WHEN 'tools' THEN k.role = 'tool' AND s.upto + n < 120 WHEN 'interacting' THEN k.role = 'user' ELSE false END AS ok
        FROM s JOIN k ON k.conv_id = s.conv_id AND k.k = s.k + 1))"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turns, loop): what follows the prompt; texts of 3n+1 and 3n+2 characters call tools, whose answers come from the next user's turn."""
    c = table(spark, sf_dir, "conversations")
    n = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    t = c.select("conv_id", "turn", "role", n.alias("tokens"), F.when(F.col("role") == "assistant", F.length("text") % 3).otherwise(0).alias("calls"), (F.length("text") % 5 == 0).alias("stop"))
    w = Window.partitionBy("conv_id")
    called = F.lag("calls", 1, 0).over(w.orderBy("turn")) > 0
    t = t.withColumn("first", F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(w)).withColumn("role", F.when((F.col("role") == "user") & called, "tool").otherwise(F.col("role")))
    after = t.filter("turn >= first").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "tokens", "calls", "stop"))).alias("turns"))
    return after.withColumn("loop", agents.agent_turns(F.col("turns"), 120, 3, 4, interaction=True))


@query(
    "agent_turns",
    f"WITH RECURSIVE {_TURNS} SELECT conv_id, turn, state, next, mask, start, greatest(least(upto, 120) - start, 0) AS kept, a AS assistants, u AS users FROM s WHERE k > 0",
)
def agent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _turns(spark, sf_dir).select("conv_id", F.explode(F.arrays_zip("turns", "loop")).alias("x"))
    return both.select("conv_id", "x.turns.turn", "x.loop.*")


@query(
    "agent_responses",
    f"""WITH RECURSIVE {_TURNS} SELECT conv_id, CAST(sum(greatest(least(upto, 120) - start, 0)) AS INTEGER) AS length, CAST(sum(mask * greatest(least(upto, 120) - start, 0)) AS INTEGER) AS learnt,
    max(a) + max(u) + 1 AS num_turns, arg_max(next, k) AS final FROM s WHERE k > 0 GROUP BY conv_id""",
)
def agent_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _turns(spark, sf_dir).withColumn("mask", agents.response_mask(F.col("loop")))
    learnt = F.aggregate("mask", F.lit(0), lambda a, x: a + x)
    return one.select("conv_id", F.size("mask").alias("length"), learnt.alias("learnt"), agents.num_turns(F.col("loop")).alias("num_turns"), F.element_at("loop", -1)["next"].alias("final"))


# symbolic answers ----------------------------------------------------------------------------------------------------

_A, _B = "(n_chars % 997 + 2)", "(doc_id % 5)"
#: Kinds of answers, by doc_id: expressions of a (from a document's length), b = doc_id % 5 and c, and when the two are equal.
_ANSWERS = (
    ("'(x+' || a || ')^2'", "'x^2+' || 2 * a || 'x+' || (a * a + b)", "b = 0"),
    ("'\\sqrt{' || 2 * a * a || '}'", "(a + b) || '\\sqrt{2}'", "b = 0"),
    ("'\\frac{x^2-' || a * a || '}{x-' || a || '}'", "'x+' || (a + b)", "b = 0"),
    ("'\\begin{pmatrix}' || a || '&x\\\\y&' || b || '\\end{pmatrix}'", "'[[' || a || ',x],[y,' || b % 3 || ']]'", "b < 3"),
    ("'(' || a || ',\\infty)'", "CASE WHEN b < 2 THEN '(' ELSE '[' END || a || ', \\infty)'", "b < 2"),
    ("a || '\\text{ cm}'", "(a + b % 2) || ''", "b % 2 = 0"),
    ("'2x=' || 2 * a", "'x=' || (a + b % 3)", "b % 3 = 0"),
    ("'\\frac{' || a || '}{' || (a + 1) || '}'", "'\\dfrac{' || 3 * a || '}{' || (3 * a + 3 - b) || '}'", "b = 0"),
    ("'y^{' || (b + 2) || '}\\cdot ' || a || 'y'", "a || 'y^3'", "b = 0"),
    ("'x=' || a", "a || '+' || b", "b = 0"),
    ("'\\frac{' || a || '}{\\sqrt{' || a || '}}'", "'\\sqrt{' || (a + b) || '}'", "b = 0"),
)
_KINDS = len(_ANSWERS)


def _answers(which: int) -> str:
    cases = " ".join(f"WHEN {k} THEN {pair[which]}" for k, pair in enumerate(_ANSWERS))
    return f"CASE doc_id % {_KINDS} {cases} END"


@query("symbolic_answers", f"SELECT doc_id, {_answers(2)} AS same FROM (SELECT doc_id, {_A} AS a, {_B} AS b FROM documents)")
def symbolic_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about each document's length, written in two ways."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_A).alias("a"), F.expr(_B).alias("b"))
    x, y = (F.expr(_answers(k).replace("\\", "\\\\")) for k in (0, 1))
    return docs.select("doc_id", symbolic.same_answer(x, y).alias("same"))


# resampling ----------------------------------------------------------------------------------------------------------


def _drawn(weight: str) -> str:
    return f"""WITH {ROWS}, w AS (SELECT row_id, greatest(CAST(round(({weight}) * 1e8) AS BIGINT), 1) AS w FROM (SELECT row_id, round(score, 6) AS score FROM sc)),
    c AS (SELECT row_id, sum(w) OVER (ORDER BY row_id) - w AS place FROM w), n AS (SELECT count(*) AS n, sum(w) AS total FROM w),
    d AS (SELECT i AS draw, CAST(CAST('0x' || substr(md5('7-' || i), 1, 15) AS BIGINT) % total AS BIGINT) AS place FROM n, range(n.n) r(i))
    SELECT draw, row_id FROM d ASOF JOIN c ON d.place >= c.place"""


def _resampled(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    rows = scores_of(spark, sf_dir).select("row_id", F.round("score", 6).alias("score"))
    weights = advantages.reweights(rows, method).select("row_id", resampling.whole_weights(F.col("weight")).alias("w"))
    return resampling.resampled(weights, "row_id", "w", seed=7)


@query("adv_pf_ppo_resampled", _drawn("score * score + 1e-8"))
def pf_ppo_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resampled(spark, sf_dir, "pow")


@query("adv_pf_ppo_resampled_extremes", _drawn("CASE WHEN score = max(score) OVER () OR score = min(score) OVER () THEN 1 ELSE 0 END + 1e-8"))
def pf_ppo_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resampled(spark, sf_dir, "max_min")


# token masks ---------------------------------------------------------------------------------------------------------

_TOKENS = r"""p AS (SELECT conv_id, turn, role, len(regexp_extract_all('<|im_start|>' || role || chr(10), '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) AS head,
    len(regexp_extract_all(coalesce(text, '') || '<|im_end|>' || chr(10), '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) AS body FROM conversations)"""


@query(
    "token_loss_masks",
    f"""WITH {_TOKENS}, o AS (SELECT *, sum(head + body) OVER (PARTITION BY conv_id ORDER BY turn) - body AS pos FROM p)
    SELECT conv_id, CAST(sum(head + body) AS BIGINT) AS n_tokens, coalesce(CAST(sum(CASE WHEN role = 'assistant' THEN body END) AS BIGINT), 0) AS learnt,
      coalesce(CAST(sum(CASE WHEN role = 'assistant' THEN body * pos + body * (body - 1) // 2 END) AS BIGINT), 0) AS places FROM o GROUP BY conv_id""",
)
def token_loss_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """learnt: the mask's sum; places: the sum of the places of its ones."""
    c = chat.conversation(table(spark, sf_dir, "conversations")).select("conv_id", "messages")
    m = token_masks.token_masks(c, "conv_id", "messages").select("conv_id", "n_tokens", F.posexplode_outer("mask").alias("k", "x"))
    one = F.col("x").cast("long")
    return m.groupBy("conv_id").agg(F.first("n_tokens").alias("n_tokens"), F.coalesce(F.sum(one), F.lit(0)).alias("learnt"), F.coalesce(F.sum(one * F.col("k")), F.lit(0)).alias("places"))


@query(
    "token_loss_masks_cut",
    f"""WITH {_TOKENS}, o AS (SELECT *, sum(head + body) OVER (PARTITION BY conv_id ORDER BY turn) - body AS pos FROM p), n AS (SELECT conv_id, sum(head + body) AS n FROM p GROUP BY conv_id),
    s AS (SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN greatest(0, least(pos + body, 200) - least(pos, 200)) END) AS r,
        sum(CASE WHEN role = 'assistant' THEN greatest(0, pos + body - greatest(pos, n - 200)) END) AS l FROM o JOIN n USING (conv_id) GROUP BY conv_id)
    SELECT conv_id, CAST(coalesce(r, 0) AS BIGINT) AS right_learnt, CAST(coalesce(l, 0) AS BIGINT) AS left_learnt FROM s""",
)
def token_loss_masks_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is learnt of the first and of the last 200 tokens."""
    c = chat.conversation(table(spark, sf_dir, "conversations")).select("conv_id", "messages")
    learnt = lambda side: token_masks.token_masks(c, "conv_id", "messages", max_length=200, truncation=side).select(
        "conv_id", F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias(f"{side}_learnt")
    )
    return learnt("right").join(learnt("left"), "conv_id")


# packed prefixes -----------------------------------------------------------------------------------------------------


def _prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer: a prompt of 1 to 8 tokens from the customer's key, a response from the order's lines."""
    tokens = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.array_sort(F.collect_list("l_partkey")).alias("response"))
    prompt = F.transform(F.sequence(F.lit(0), (F.col("uid") % 8).cast("int")), lambda i: F.col("uid") * 10 + i)
    return trajectories(spark, sf_dir).select("uid", "row_id", prompt.alias("prompt")).join(tokens, "row_id", "left")


_PROMPTED = """r AS (SELECT o_custkey AS uid, o_orderkey AS row_id, 1 + o_custkey % 8 AS p, list(l_partkey ORDER BY l_partkey) FILTER (WHERE l_partkey IS NOT NULL) AS response
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


@query(
    "prefix_round_trip",
    f"""WITH {_PROMPTED} SELECT uid, row_id, array_to_string(list_transform(range(p), lambda i: uid * 10 + i), ',') AS prompt, coalesce(array_to_string(response, ','), '') AS response,
    coalesce(array_to_string(list_transform(range(len(response)), lambda i: p + i), ','), '') AS positions FROM r""",
)
def prefix_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed behind shared prompts and unpacked: the rows that went in."""
    lots = prefixes.packed_groups(_prompted(spark, sf_dir), "uid", "row_id", "prompt", "response")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return prefixes.unpacked(lots, "uid").select("uid", F.col("row").alias("row_id"), text("prompt"), text("response"), text("positions"))


@query(
    "prefix_visibility",
    f"""WITH {_PROMPTED} SELECT uid, CAST(max(p) + sum(coalesce(len(response), 0)) AS BIGINT) AS tokens,
    CAST(max(p) * (max(p) + 1) // 2 + sum(p * coalesce(len(response), 0) + coalesce(len(response) * (len(response) + 1) // 2, 0)) AS BIGINT) AS seen FROM r GROUP BY uid""",
)
def prefix_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each customer's packed row, and how many tokens they see in all."""
    lots = prefixes.packed_groups(_prompted(spark, sf_dir), "uid", "row_id", "prompt", "response", most=1 << 20)
    see = F.aggregate(prefixes.visible(F.col("prefix"), F.col("spans")), F.lit(0).cast("long"), lambda a, x: a + x["upto"] + x["end"] - x["begin"])
    return lots.select("uid", F.size("tokens").cast("long").alias("tokens"), see.alias("seen"))


# bounded calls -------------------------------------------------------------------------------------------------------


def judged(row: dict) -> int:
    """A stand-in for a model server: the length of a text's whole words; every 13th document fails for good, every 5th at first."""
    doc_id = row["doc_id"]
    if doc_id % 13 == 0:
        raise ValueError("no answer")
    if doc_id % 5 == 0 and zlib.crc32(str(doc_id).encode()) not in _SEEN:
        _SEEN.add(zlib.crc32(str(doc_id).encode()))
        raise TimeoutError("busy")
    _SEEN.discard(zlib.crc32(str(doc_id).encode()))
    return len(row["text"] or "")


_SEEN: set[int] = set()


@query(
    "calls_in_flight",
    """SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN length(coalesce(text, '')) END AS answer, CASE WHEN doc_id % 13 = 0 THEN 3 WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS attempts,
    CASE WHEN doc_id % 13 = 0 THEN 'ValueError: no answer' END AS error, true AS bounded, true AS in_order FROM documents""",
)
def calls_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents judged with at most 8 calls out in each task; in_order: that a task's rows came out as they went in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n", F.monotonically_increasing_id())
    out = inflight.bounded_map(docs, judged, "answer long", in_flight=8, attempts=3, wait=0.001).withColumn("m", F.monotonically_increasing_id())
    return out.select("doc_id", "answer", "attempts", "error", (F.col("in_flight") <= 8).alias("bounded"), (F.col("n") == F.col("m")).alias("in_order"))


# padding -------------------------------------------------------------------------------------------------------------


def _padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the part keys of their lines and a mask of those that weren't returned."""
    line = F.struct(*ORDER, F.col("l_partkey").alias("id"), (F.col("l_returnflag") != "R").cast("int").alias("on"))
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.array_sort(F.collect_list(line)).alias("x"))
    return x.select("row_id", F.col("x.id").alias("ids"), F.col("x.on").alias("mask"))


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


_PADDED = f"p AS (SELECT l_orderkey AS row_id, list(l_partkey ORDER BY {', '.join(ORDER)}) AS ids, list(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END ORDER BY {', '.join(ORDER)}) AS mask FROM lineitem GROUP BY l_orderkey)"


@query(
    "unpadded_rows",
    f"""WITH {_PADDED} SELECT row_id, array_to_string(list_transform(list_filter(list_zip(ids, mask), lambda z: z[2] > 0), lambda z: z[1]), ',') AS ids, CAST(list_sum(mask) AS BIGINT) AS length,
    CAST(sum(list_sum(mask)) OVER (ORDER BY row_id) - list_sum(mask) AS BIGINT) AS start FROM p""",
)
def unpadded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return padding.unpadded(_padded(spark, sf_dir), "row_id", "mask", "ids").select("row_id", _joined("ids"), "length", "start")


@query("repadded_rows", f"WITH {_PADDED} SELECT row_id, array_to_string(list_transform(list_zip(ids, mask), lambda z: z[1] * z[2]), ',') AS ids FROM p")
def repadded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    jagged = padding.unpadded(_padded(spark, sf_dir), "row_id", "mask", "ids")
    return padding.repadded(jagged, "ids", "mask").select("row_id", _joined("ids"))


_LOGITS = """l AS (SELECT vec_id, list_transform(range(4), lambda i: CAST(embedding[CAST(i * 16 + 1 AS INTEGER):CAST(i * 16 + 16 AS INTEGER)] AS DOUBLE[])) AS v, list_transform(range(4), lambda i: (vec_id + 3 * i) % 16) AS ids FROM embeddings),
    s AS (SELECT vec_id, list_transform(range(3), lambda i: v[CAST(i + 1 AS INTEGER)][CAST(ids[CAST(i + 2 AS INTEGER)] + 1 AS INTEGER)] - ln(list_sum(list_transform(v[CAST(i + 1 AS INTEGER)], lambda x: exp(x))))) AS p FROM l)"""


@query("logprobs_of_responses", f"WITH {_LOGITS} SELECT vec_id, round(p[2], 4) + 0.0 AS second, round(p[3], 4) + 0.0 AS third, round(list_sum(p), 4) + 0.0 AS every FROM s")
def logprobs_of_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tokens of 16 logits each from a vector: the response's last two, and all that have logits before them."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    steps = F.sequence(F.lit(0), F.lit(3))
    e = e.select("vec_id", F.transform(steps, lambda i: F.slice("v", i * 16 + 1, F.lit(16))).alias("logits"), F.transform(steps, lambda i: (F.col("vec_id") + 3 * i) % 16).alias("ids"))
    r = e.select("vec_id", padding.response_logprobs(F.col("logits"), F.col("ids"), 2).alias("r"), padding.next_logprobs(F.col("logits"), F.col("ids")).alias("n"))
    return r.select("vec_id", r4(F.get("r", F.lit(0))).alias("second"), r4(F.get("r", F.lit(1))).alias("third"), r4(F.aggregate("n", F.lit(0.0), lambda a, x: a + x)).alias("every"))


@query(
    "zoom_boxes",
    """WITH a AS (SELECT p_partkey, greatest(p_size * 3.0 - 20, 0.0)::DOUBLE AS x1, greatest(p_size * 2.0 - 30, 0.0)::DOUBLE AS y1, least(p_size * 3.0 - 20 + p_partkey % 60, 160.0)::DOUBLE AS x2, least(p_size * 2.0 - 30 + p_partkey % 43, 90.0)::DOUBLE AS y2 FROM part),
    b AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM a WHERE x2 > x1 AND y2 > y1 AND greatest(x2 - x1, y2 - y1) <= 100 * least(x2 - x1, y2 - y1)),
    c AS (SELECT *, w * (28.0::DOUBLE / least(w, h)) AS rw, h * (28.0::DOUBLE / least(w, h)) AS rh FROM b), d AS (SELECT *, least(rw, 160.0::DOUBLE) AS sw, CASE WHEN rw > 160 THEN rh * (160.0::DOUBLE / rw) ELSE rh END AS sh FROM c),
    e AS (SELECT *, CASE WHEN sh > 90 THEN sw * (90.0::DOUBLE / sh) ELSE sw END AS tw, least(sh, 90.0::DOUBLE) AS th FROM d),
    f AS (SELECT *, least(greatest((x1 + x2) / 2 - tw / 2, 0), 160 - tw) AS l, least(greatest((y1 + y2) / 2 - th / 2, 0), 90 - th) AS t FROM e),
    g AS (SELECT p_partkey, CASE WHEN least(w, h) < 28 THEN floor(l) ELSE x1 END AS x1, CASE WHEN least(w, h) < 28 THEN floor(t) ELSE y1 END AS y1, CASE WHEN least(w, h) < 28 THEN ceil(l + tw) ELSE x2 END AS x2,
      CASE WHEN least(w, h) < 28 THEN ceil(t + th) ELSE y2 END AS y2 FROM f)
    SELECT p_partkey, x1, y1, x2, y2 FROM part LEFT JOIN (SELECT * FROM g WHERE floor(x2) - floor(x1) >= 28 AND floor(y2) - floor(y1) >= 28 AND greatest(x2 - x1, y2 - y1) <= 100 * least(x2 - x1, y2 - y1)) USING (p_partkey)""",
)
def zoom_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from sizes and keys of parts, in an image of 160 by 90."""
    size, key = F.col("p_size").cast("double"), F.col("p_partkey")
    x, y = size * 3 - 20, size * 2 - 30
    box = arrays.zoom_box(x, y, x + key % 60, y + key % 43, F.lit(160), F.lit(90))
    return table(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.*")


# balance -------------------------------------------------------------------------------------------------------------

_BATCHED = "o AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 48 AS batch, o_orderkey AS k, CAST(floor(o_totalprice / 1000) AS BIGINT) + 1 AS n, o_custkey FROM orders), w AS (SELECT * FROM o WHERE batch IN (SELECT batch FROM o GROUP BY batch HAVING count(*) = 48))"


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in whole batches of 48, in the order of their keys."""
    from rollumen.plans.order import numbered

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.floor(F.col("o_totalprice") / 1000) + 1).alias("n"), "o_custkey")
    rows = numbered(o, ["k"], "row").withColumn("batch", F.floor(F.col("row") / 48))
    return rows.join(rows.groupBy("batch").count().filter("count = 48").select("batch"), "batch", "left_semi")


def _balance(name: str, sql: str, **options) -> None:
    @query(name, f"WITH {_BATCHED} {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Properties of each batch's new order, for 4 ranks of 12 rows: every place is taken once, and, where a rank's work is above a rank's share of all, by less than the
        heaviest row's (the ranks of the first and the second half have rows of their own mini-batches only, if those are kept)."""
        rows = _batched(spark, sf_dir)
        placed = partition.balanced_batches(rows, "batch", "k", "n", 4, **options).join(rows.select("k", "n", "row"), "k")
        cost = 24576 * F.col("n") + F.col("n") * F.col("n")
        half = F.floor((F.col("row") % 48) / 24)
        ranks = placed.withColumn("rank", F.floor(F.col("place") / 12)).groupBy("batch", "rank").agg(F.sum(cost).alias("s"), F.max(cost).alias("m"), F.count(F.lit(1)).alias("c"), F.sum(half).alias("late"))
        kept = F.lit(True) if "minibatch" not in options else F.min(F.col("late") == 6)
        fair = F.max("s") - F.sum("s") / 4 <= F.max("m")
        places = placed.groupBy("batch").agg(F.count_distinct("place").alias("places"), F.max("place").alias("last"))
        return ranks.groupBy("batch").agg(F.min("c").alias("least"), fair.alias("fair"), kept.alias("kept")).join(places, "batch")


_balance("batch_balanced", "SELECT batch, 12 AS least, true AS fair, true AS kept, 48 AS places, 47 AS last FROM w GROUP BY batch")
_balance("batch_balanced_minibatches", "SELECT batch, 12 AS least, true AS fair, true AS kept, 48 AS places, 47 AS last FROM w GROUP BY batch", minibatch=24)


# marks in answers ----------------------------------------------------------------------------------------------------

_MARKS = (
    ("a || '\\%'", "c || ''"), ("'(' || a || ',100]'", "'(' || c || ', 100]'"), ("'\\begin{pmatrix}' || a || '\\\\2\\end{pmatrix}'", "'\\begin{pmatrix}' || c || '\\\\2\\end{pmatrix}'"),
    ("'\\frac{' || a || '}{7}'", "'\\dfrac{' || c || '}{7}'"), ("'x=' || a", "c || ''"), ("'\\sqrt{' || a || '}'", "'\\sqrt{' || c || '}'"),
)


@query(
    "grade_math_marks",
    "SELECT doc_id, s AS math, s AS prime, s AS geo3k, s AS feedback FROM (SELECT doc_id, CASE WHEN doc_id // 6 % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS s FROM documents)",
)
def grade_math_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cents, intervals, matrices, fractions, assignments and roots about each document's length, by all graders of mathematics."""
    number = table(spark, sf_dir, "documents").select("doc_id", F.expr("n_chars % 50 + 1").alias("a"), F.expr("n_chars % 50 + 1 + doc_id div 6 % 3").alias("c"))
    side = lambda k: F.expr("CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {m[k]}" for i, m in enumerate(_MARKS)).replace("\\", "\\\\") + " END")
    rows = number.select("doc_id", F.concat(F.lit("<think>so</think> it is \\boxed{"), side(0), F.lit("}")).alias("sol"), side(1).alias("gold"))
    sol, gold = F.col("sol"), F.col("gold")
    near = F.when(graders.geo3k(sol, gold)["score"] > 0.5, 1.0).otherwise(0.0)
    return rows.select(
        "doc_id", graders.math(sol, gold)["score"].cast("double").alias("math"), graders.prime(sol, gold)["score"].cast("double").alias("prime"), near.alias("geo3k"),
        graders.feedback_math(sol, gold, F.lit(False))["score"].cast("double").alias("feedback"),
    )


# templates -----------------------------------------------------------------------------------------------------------


def _templated(name: str, before: str, head: str, tail: str, generate: str) -> None:
    said = f"string_agg({head} || coalesce(text, '') || {tail}, '' ORDER BY turn)"

    @query(f"chat_template_{name}", f"SELECT conv_id, sha256({before} || {said} || {generate}) AS whole, sha256({said}) AS continued FROM conversations GROUP BY conv_id")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = chat.conversation(table(spark, sf_dir, "conversations"))
        m = F.col("messages")
        return c.select("conv_id", F.sha2(chat.applied(m, name, generate=True), 256).alias("whole"), F.sha2(chat.applied(m, name, continued=True), 256).alias("continued"))


_IM = ("'<|im_start|>' || role || chr(10)", "'<|im_end|>' || chr(10)", "'<|im_start|>assistant' || chr(10)")
_templated("chatml", "''", *_IM)
_templated("chatml_assistant", "CASE WHEN arg_min(role, turn) = 'system' THEN '' ELSE '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) END", *_IM)
_templated("header", "'<|begin_of_text|>'", "'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)", "'<|eot_id|>'", "'<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)")
_templated("turns", "'<bos>'", "'<start_of_turn>' || role || chr(10)", "'<end_of_turn>' || chr(10)", "'<start_of_turn>assistant' || chr(10)")
