"""Extraction, normalisation and graders. Answers are made from documents: the tables hold no answer texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollumen.functions import graders as g
from rollumen.functions import latex
from rollumen.functions import text as t
from rollumen.queries.policy import r4  # noqa: F401  the same rounding everywhere

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Solutions and golds by doc_id, as SQL that both engines read.
SOLUTION = r"""CASE doc_id % 8
 WHEN 0 THEN concat('<think>so</think> <answer>(', chr(CAST(65 + doc_id % 6 AS INT)), ') it is</answer>')
 WHEN 1 THEN concat('Hence Answer: ', chr(CAST(65 + doc_id % 5 AS INT)), '. That is all')
 WHEN 2 THEN concat('#### 1,', CAST(doc_id % 900 + 100 AS VARCHAR(20)), ' then #### ', CAST(doc_id % 7 AS VARCHAR(20)))
 WHEN 3 THEN concat('  **Answer: ', CASE WHEN doc_id % 3 = 0 THEN 'Yes' ELSE 'no' END, '** ')
 WHEN 4 THEN concat('<answer>The ', lang, ', cat!</answer> <answer> a ', lang, ' </answer>')
 WHEN 5 THEN concat('we get $x = ', CAST(doc_id % 11 AS VARCHAR(20)), '$. Answer: ', CAST(doc_id % 11 AS VARCHAR(20)), ' dollars')
 WHEN 6 THEN concat('(', CASE WHEN doc_id % 4 = 2 THEN 'a' ELSE 'B' END, ') or b, the answer is (', chr(CAST(65 + doc_id % 10 AS INT)), ')')
 ELSE lang END"""
GOLD = r"""CASE doc_id % 8
 WHEN 0 THEN concat('(', chr(CAST(65 + doc_id % 4 AS INT)), ') it is') WHEN 1 THEN chr(CAST(65 + doc_id % 3 AS INT)) WHEN 2 THEN CAST(doc_id % 5 AS VARCHAR(20))
 WHEN 3 THEN 'yes' WHEN 4 THEN lang WHEN 5 THEN CAST(doc_id % 9 AS VARCHAR(20)) WHEN 6 THEN chr(CAST(65 + doc_id % 10 AS INT)) ELSE 'en' END"""
BASE = f"s AS (SELECT doc_id, lang, source, {SOLUTION} AS sol, {GOLD} AS gold FROM documents)"


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "lang", "source", F.expr(SOLUTION).alias("sol"), F.expr(GOLD).alias("gold"))


def simple(name: str, spark_col, sql: str):
    @query(name, f"WITH {BASE} SELECT doc_id, {sql} AS out FROM s")
    def run(spark, sf_dir):
        return solutions(spark, sf_dir).select("doc_id", spark_col().alias("out"))


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return _STRIP.format(x)


_JUDGE = (
    "CASE WHEN instr(sol, '<answer>') > 0 AND instr(sol, '</answer>') > 0 THEN "
    + strip("substr(sol, instr(sol, '<answer>') + 8, instr(sol, '</answer>') - instr(sol, '<answer>') - 8)")
    + " WHEN instr(sol, 'Answer:') > 0 THEN " + strip("substr(sol, instr(sol, 'Answer:'))") + " ELSE " + strip("sol") + " END"
)
_GRADER = _JUDGE.replace("instr(sol, 'Answer:'))", "instr(sol, 'Answer:') + 7)")
_FIRST = r"coalesce(nullif(regexp_extract({0}, '\(([A-Z])\)', 1), ''), nullif(regexp_extract({0}, '([A-Z])[.)\s]', 1), ''), nullif(regexp_extract({0}, '([A-Z])', 1), ''), '')"
_MCQ = "coalesce(nullif(regexp_extract({0}, '^[ (\\[]*([A-F])$', 1), ''), nullif(regexp_extract({0}, '^[ (\\[]*([A-F])[.)\\]]', 1), ''), nullif(regexp_extract({0}, '^[ (\\[]*([A-F])[:\\-]\\s+', 1), ''), '')"
_QA = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_EM = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_NUM = r"TRY_CAST(nullif(replace(regexp_extract({0}, '-?\d+(?:,\d{{3}})*(?:\.\d+)?', 0), ',', ''), '') AS DECIMAL(38,18))"

simple("text_strip", lambda: t.strip("sol"), strip("sol"))
simple("text_judge_answer", lambda: t.judge_answer("sol"), _JUDGE)
simple("text_grader_answer", lambda: t.grader_answer("sol"), _GRADER)
simple("text_first_option", lambda: t.first_option(F.col("sol")), _FIRST.format("sol"))
simple("text_mcq_option", lambda: t.mcq_option("gold"), _MCQ.format(strip("gold")))
simple("text_first_letter_match", lambda: t.first_letter_match(F.col("gold"), F.col("sol")), f"({_MCQ.format(strip('gold'))}) <> '' AND ({_FIRST.format('sol')}) <> '' AND ({_MCQ.format(strip('gold'))}) = ({_FIRST.format('sol')})")
simple("text_without_think", lambda: t.without_think("sol"), r"regexp_replace(sol, '(?s)<think>.*?</think>\s*', '', 'g')")
simple("text_after_last_think", lambda: t.after_last_think("sol"), "string_split(sol, '</think>')[-1]")
simple("text_qa_normalized", lambda: t.qa_normalized("sol"), _QA.format("sol"))
simple("text_em_normalized", lambda: t.em_normalized("sol"), _EM.format("sol"))
simple("text_first_number", lambda: t.first_number("sol").cast("double"), f"CAST({_NUM.format('sol')} AS DOUBLE)")
simple(
    "text_a_or_b", lambda: t.a_or_b("sol"),
    r"coalesce('(' || coalesce(nullif(regexp_extract(lower(" + strip("sol") + r"), '\(([ab])\)', 1), ''), nullif(regexp_extract(lower(" + strip("sol") + r"), '\b([ab])\b', 1), '')) || ')', '')",
)
simple("text_with_suffix", lambda: t.with_suffix("sol", " it is</answer>"), "CASE WHEN ends_with(sol, ' it is</answer>') THEN sol ELSE sol || ' it is</answer>' END")
simple("text_clean_question", lambda: t.clean_question(F.concat(F.lit("<image> "), "sol", F.lit("\n\nSay why.")), "Say why."), strip("sol"))
simple("text_empty_or_error", lambda: t.empty_or_error(F.when(F.col("doc_id") % 8 < 6, F.col("sol")).otherwise(F.concat(F.lit(" [API_ERROR] "), "sol"))), "doc_id % 8 >= 6")
simple("text_judge_prompt", lambda: F.sha2(t.judge_prompt("lang", "gold", "sol"), 256),
       r"sha256('Your task is to judge whether the response expresses the same meaning as the answer of a question.' || chr(10) || 'The question is: ' || lang || chr(10) || 'The answer is: ' || gold || chr(10) || 'The response is: ' || sol || chr(10) || 'Please check and compare them and then judge. If the response is correct, your output should be Yes. Otherwise, your output should be No. Directly give me your output.')")
simple("text_metric_key", lambda: t.metric_key(F.concat("lang", F.lit("//acc@"), "source", F.lit(" (x)"))), r"regexp_replace(regexp_replace(replace(lang || '//acc@' || source || ' (x)', '@', '_at_'), '/+', '/', 'g'), '[^A-Za-z0-9_./\- ]', '_', 'g')")
simple("text_option_lines", lambda: t.option_lines(F.array("lang", F.lit(" "), "source")), "'(A) ' || lang || chr(10) || '(C) ' || source")
simple("text_passages", lambda: t.passages(F.array(F.concat("lang", F.lit("\nbody "), "source"))), "'Doc 1 (Title: ' || lang || ')' || chr(10) || 'body ' || source || chr(10)")
simple(
    "text_sample_uid", lambda: t.sample_uid(F.lit("zoom"), {"index": F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")), "id": F.when(F.col("doc_id") % 3 == 0, F.col("lang"))}, F.col("sol")),
    "CASE WHEN doc_id % 2 = 0 THEN 'zoom:index:' || doc_id WHEN doc_id % 3 = 0 THEN 'zoom:id:' || lang ELSE 'sha1:' || sha1(sol) END",
)


@query(
    "text_yes_no",
    f"""WITH {BASE}, a AS (SELECT doc_id, sol, {strip("regexp_replace(sol, '^\\*+', '')")} AS t0 FROM s),
    b AS (SELECT doc_id, sol, CASE WHEN lower(t0) LIKE 'answer%' THEN {strip("regexp_replace(regexp_replace(CASE WHEN instr(t0, 'answer') > 0 THEN substr(t0, instr(t0, 'answer') + 6) ELSE t0 END, '^:+', ''), '^\\*+', '')")} ELSE t0 END AS t FROM a),
    c AS (SELECT doc_id, sol, t, lower(regexp_replace(regexp_split_to_array({strip("regexp_replace(regexp_replace(t, '\\.+$', ''), '\\*+$', '')")}, '\\s+')[-1], '^\\*+|\\*+$', '', 'g')) AS last FROM b)
    SELECT doc_id, CASE WHEN lower(t) LIKE 'yes%' THEN 'yes' WHEN lower(t) LIKE 'no%' THEN 'no' WHEN last IN ('yes', 'no') THEN last ELSE {strip("sol")} END AS out FROM c""",
)
def yes_no(spark, sf_dir):
    return solutions(spark, sf_dir).select("doc_id", t.yes_no("sol").alias("out"))


def graded(name: str, column, sql: str):
    """column gives a struct; the query has its score and pred."""

    @query(f"grade_{name}", f"WITH {BASE} {sql}")
    def run(spark, sf_dir):
        out = solutions(spark, sf_dir).select("doc_id", column().alias("r"))
        return out.select("doc_id", F.col("r.score").alias("score"), F.col("r.pred").alias("pred"))


_SOL, _GOLD = F.col, F.col
graded("gsm8k", lambda: g.gsm8k(F.col("sol"), F.col("gold")),
       r", a AS (SELECT doc_id, gold, replace(replace(list_extract(regexp_extract_all(sol, '#### (-?[0-9.,]+)', 1), -1), ',', ''), '$', '') AS pred FROM s) SELECT doc_id, CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END::DOUBLE AS score, pred FROM a")
graded("gsm8k_flexible", lambda: g.gsm8k(F.col("sol"), F.col("gold"), "flexible", 0.1),
       r", a AS (SELECT doc_id, gold, regexp_extract_all(sol, '(-?[0-9.,]+)', 1) AS f FROM s), b AS (SELECT doc_id, gold, coalesce(list_extract(list_filter(f, lambda x: x NOT IN ('', '.')), -1), list_extract(f, 1)) AS pred FROM a) SELECT doc_id, CASE WHEN pred IS NULL THEN 0 WHEN pred = gold THEN 1.0 ELSE 0.1 END::DOUBLE AS score, pred FROM b")
_TAG = r"a AS (SELECT doc_id, gold, sol, regexp_replace(list_extract(regexp_extract_all(sol, '(?s)<answer>(.*?)</answer>', 1), -1), '^\s+|\s+$', '', 'g') AS pred FROM s)"
graded("qa_em", lambda: g.qa_em(F.col("sol"), F.array("gold")), f", {_TAG} SELECT doc_id, CASE WHEN {_QA.format('pred')} = {_QA.format('gold')} THEN 1.0 ELSE 0.0 END::DOUBLE AS score, pred FROM a")
graded("qa_sub_em", lambda: g.qa_sub_em(F.col("sol"), F.array("gold")), f", {_TAG} SELECT doc_id, CASE WHEN contains({_QA.format('pred')}, {_QA.format('gold')}) THEN 1.0 ELSE 0.0 END::DOUBLE AS score, pred FROM a")
graded("mcq", lambda: g.mcq(F.col("sol"), F.col("gold")), r", a AS (SELECT doc_id, gold, regexp_replace(string_split(string_split(sol, '<answer>')[-1], '</answer>')[1], '^\s+|\s+$', '', 'g') AS pred FROM s) SELECT doc_id, (pred = gold)::INT::DOUBLE AS score, pred FROM a")
graded("gpqa", lambda: g.gpqa(F.col("sol"), F.col("gold")),
       r", a AS (SELECT doc_id, gold, coalesce(list_extract(regexp_extract_all(upper(sol), '\b(A|B|C|D)\b', 1), -1), regexp_replace(regexp_replace(regexp_replace(regexp_replace(sol, '^\s+|\s+$', '', 'g'), '^\.+|\.+$', '', 'g'), '\.+$', ''), '/+$', '')) AS pred FROM s) SELECT doc_id, (pred = gold)::INT::DOUBLE AS score, pred FROM a")
graded("mmlu_pro", lambda: g.mmlu_pro(F.col("sol"), F.col("gold")),
       r", a AS (SELECT doc_id, gold, coalesce(nullif(regexp_extract(sol, '(?i)answer is \(?([A-J])\)?', 1), ''), nullif(regexp_extract(sol, '(?i)Answer:\s*([A-J])', 1), ''), list_extract(regexp_extract_all(sol, '\b([A-J])\b', 1), -1), '') AS pred FROM s) SELECT doc_id, (pred = gold)::INT::DOUBLE AS score, pred FROM a")
graded("zoom_mcq", lambda: g.zoom(F.col("sol"), F.col("gold"), F.lit("MCQ ")),
       f", a AS (SELECT doc_id, gold, {_GRADER} AS x FROM s), b AS (SELECT *, {_FIRST.format('x')} AS l, {_MCQ.format(strip('gold'))} AS m FROM a) SELECT doc_id, (l <> '' AND m <> '' AND l = m)::INT::DOUBLE AS score, CASE WHEN l <> '' THEN l ELSE x END AS pred FROM b")
graded("zoom_open", lambda: g.zoom(F.col("sol"), F.col("gold"), F.lit(None)),
       f", a AS (SELECT doc_id, gold, {_GRADER} AS pred FROM s), b AS (SELECT *, {_NUM.format('pred')} AS p, {_NUM.format('gold')} AS q FROM a) SELECT doc_id, (CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN p = q ELSE {_EM.format('pred')} = {_EM.format('gold')} END)::INT::DOUBLE AS score, pred FROM b")


def _dapo_sql(x: str) -> str:
    q = lambda v: "'" + v.replace("'", "''") + "'"
    s = f"string_split({x}, '=')[-1]"
    for a, b in g.DAPO_SUBSTITUTIONS:
        s = f"replace({s}, {q(a)}, {q(b)})"
    for a in g.DAPO_REMOVED:
        s = f"replace({s}, {q(a)}, '')"
    s = rf"regexp_replace({s}, '(.*?)\$(.*?)\$(.*)', '$\2$', 'g')"
    for w in ("text", "textbf", "overline"):
        s = rf"regexp_replace({s}, '\\{w}\{{(.*?)\}}', '\1', 'g')"
    s = rf"regexp_replace({s}, '\\boxed\{{(.*)\}}', '\1', 'g')"
    s = rf"regexp_replace(regexp_replace({s}, '(frac)([^{{])(.)', 'frac{{\2}}{{\3}}', 'g'), '(sqrt)([^{{])', 'sqrt{{\2}}', 'g')"
    return f"replace({s}, '$', '')"


graded("dapo", lambda: g.dapo(F.col("sol"), F.col("gold")),
       rf", a AS (SELECT doc_id, coalesce(list_extract(regexp_extract_all(sol, '(?i)Answer\s*:\s*([^\n]+)', 1), -1), '[INVALID]') AS x, gold FROM s), b AS (SELECT doc_id, {_dapo_sql('x')} AS p, {_dapo_sql('gold')} AS q FROM a), c AS (SELECT doc_id, "
       + ", ".join(rf"regexp_replace(CASE WHEN regexp_full_match(replace({v}, ',', ''), '\d+') THEN replace({v}, ',', '') ELSE {v} END, '^\s+|\s+$', '', 'g') AS {v}" for v in ("p", "q"))
       + " FROM b) SELECT doc_id, CASE WHEN p = q THEN 1.0 ELSE -1.0 END::DOUBLE AS score, p AS pred FROM c")

#: Boxed answers, some nested, some broken.
BOXED = r"""CASE doc_id % 5 WHEN 0 THEN concat('so \boxed{', CAST(doc_id % 7 AS VARCHAR(20)), '}') WHEN 1 THEN concat('first \boxed{1} then $\boxed{\frac{', CAST(doc_id % 4 AS VARCHAR(20)), '}{2}}$ done')
 WHEN 2 THEN concat('open \boxed{', lang) WHEN 3 THEN concat('$\boxed ', CAST(doc_id % 3 AS VARCHAR(20)), '$ end') ELSE concat('\fbox{', lang, '}') END"""
_BOX_SQL = r"""CASE doc_id % 5 WHEN 0 THEN '\boxed{' || CAST(doc_id % 7 AS VARCHAR) || '}' WHEN 1 THEN '\boxed{\frac{' || CAST(doc_id % 4 AS VARCHAR) || '}{2}}'
 WHEN 2 THEN NULL WHEN 3 THEN '\boxed ' || CAST(doc_id % 3 AS VARCHAR) ELSE '\fbox{' || lang || '}' END"""


def boxed(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "lang", F.expr(BOXED.replace("\\", "\\\\")).alias("sol"))


@query("text_last_boxed", f"SELECT doc_id, {_BOX_SQL} AS out FROM documents")
def last_boxed(spark, sf_dir):
    return boxed(spark, sf_dir).select("doc_id", t.last_boxed("sol").alias("out"))


@query(
    "text_unboxed",
    r"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CAST(doc_id % 7 AS VARCHAR) WHEN 1 THEN '\frac{' || CAST(doc_id % 4 AS VARCHAR) || '}{2}' WHEN 3 THEN CAST(doc_id % 3 AS VARCHAR) END AS out FROM documents""",
)
def unboxed(spark, sf_dir):
    return boxed(spark, sf_dir).select("doc_id", t.unboxed(t.last_boxed("sol")).alias("out"))


@query(
    "grade_math",
    r"""SELECT doc_id, (CASE doc_id % 5 WHEN 0 THEN doc_id % 7 = 1 WHEN 3 THEN doc_id % 3 = 1 ELSE false END)::INT::DOUBLE AS score FROM documents""",
)
def grade_math(spark, sf_dir):
    return boxed(spark, sf_dir).select("doc_id", g.math(F.col("sol"), F.lit("1"))["score"].alias("score"))


@query(
    "grade_prime",
    r"""SELECT doc_id, (CASE doc_id % 5 WHEN 0 THEN doc_id % 7 = 1 WHEN 1 THEN doc_id % 4 = 2 WHEN 3 THEN doc_id % 3 = 1 ELSE false END)::INT::DOUBLE AS score FROM documents""",
)
def grade_prime(spark, sf_dir):
    return boxed(spark, sf_dir).select("doc_id", g.prime(F.col("sol"), F.lit("1"))["score"].alias("score"))


@query(
    "grade_geo3k",
    r"""SELECT doc_id, round(0.9 * (CASE doc_id % 5 WHEN 0 THEN doc_id % 7 = 1 WHEN 1 THEN doc_id % 4 = 2 WHEN 3 THEN doc_id % 3 = 1 ELSE false END)::INT::DOUBLE
      + CASE WHEN doc_id % 5 IN (0, 1) THEN 0.1 ELSE 0 END, 4) + 0.0 AS score FROM documents""",
)
def grade_geo3k(spark, sf_dir):
    thought = boxed(spark, sf_dir).withColumn("sol", F.concat(F.lit("<think>hm</think> "), "sol"))
    return thought.select("doc_id", r4(g.geo3k(F.col("sol"), F.lit("1"))["score"]).alias("score"))


@query(
    "grade_feedback_math",
    r"""SELECT doc_id, (CASE doc_id % 5 WHEN 0 THEN doc_id % 7 = 1 WHEN 1 THEN doc_id % 4 = 2 WHEN 3 THEN doc_id % 3 = 1 ELSE false END)::INT::DOUBLE AS acc,
      CASE WHEN doc_id % 5 IN (2, 4) THEN 1 ELSE 0 END AS incorrect_format FROM documents""",
)
def grade_feedback_math(spark, sf_dir):
    r = boxed(spark, sf_dir).select("doc_id", g.feedback_math(F.col("sol"), F.lit("1"), F.lit(False)).alias("r"))
    return r.select("doc_id", "r.acc", "r.incorrect_format")


@query(
    "grade_tool_use",
    """SELECT event_id, (event_type = 'click')::INT::DOUBLE AS score, event_type AS pred FROM events""",
)
def grade_tool_use(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sol = F.concat(F.lit("Action: "), "event_type", F.lit('\nAction Input: {"k": "old"}\nAction Input: {broken}\nAction Input: '), "props")
    gold = F.from_json("props", "map<string,string>")
    return e.select("event_id", g.tool_use(sol, F.array(F.lit("click")), gold).alias("r")).select("event_id", "r.score", "r.pred")


@query(
    "grade_code_results",
    """WITH s AS (SELECT user_id, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 1 WHEN 'purchase' THEN 0 WHEN 'signup' THEN -2 ELSE -4 END AS INTEGER) AS st,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    f AS (SELECT user_id, k, CASE WHEN min(CASE WHEN st = -4 THEN k END) OVER (PARTITION BY user_id) <= k THEN -4 ELSE st END AS st FROM s)
    SELECT user_id, bool_and(st = 1)::INT::DOUBLE AS score, round(sum(CASE WHEN k <= 10 AND st = 1 THEN 1.0 ELSE 0 END) / sum(CASE WHEN k <= 10 THEN 1 ELSE 0 END), 4) + 0.0 AS continuous FROM f GROUP BY user_id""",
)
def grade_code(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    status = F.when(F.col("event_type").isin("click", "view"), 1).when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", -2).otherwise(-4)
    runs = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", status.cast("int").alias("s")))).alias("r")).select("user_id", F.col("r.s").alias("s"))
    return runs.select("user_id", g.code_score(F.col("s")).alias("score"), r4(g.code_score(F.col("s"), True)).alias("continuous"))


@query(
    "grade_by_source",
    f"""WITH {BASE} SELECT doc_id, CASE doc_id % 8 WHEN 2 THEN (doc_id % 7 = doc_id % 5)::INT::DOUBLE WHEN 4 THEN 1.0 WHEN 5 THEN CASE WHEN doc_id % 11 = doc_id % 9 THEN 1.0 ELSE -1.0 END ELSE 0.0 END AS score FROM s""",
)
def by_source(spark, sf_dir):
    src = F.when(F.col("doc_id") % 8 == 4, "searchR1_nq").when(F.col("doc_id") % 8 == 5, "aime2024").otherwise("openai/gsm8k")
    return solutions(spark, sf_dir).select("doc_id", g.score_by_source(src, F.col("sol"), F.col("gold")).alias("score"))


@query(
    "dataset_accuracy",
    f"""WITH {BASE}, r AS (SELECT doc_id, source, avg(x) AS m FROM (SELECT doc_id, source, CASE WHEN list_extract(regexp_extract_all(sol, '#### (-?[0-9.,]+)', 1), -1) = gold THEN 1.0 ELSE 0.0 END AS x FROM s
      UNION ALL SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN 1.0 ELSE 0.0 END FROM s) GROUP BY doc_id, source)
    SELECT 'test_score/' || source AS name, round(avg(m), 4) + 0.0 AS value FROM r GROUP BY source""",
)
def dataset_accuracy(spark, sf_dir):
    from rollumen.operators.metrics import dataset_accuracy as by_dataset

    rows = solutions(spark, sf_dir).withColumn("gold2", F.col("gold"))
    second = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("#### "), F.regexp_replace("gold", r"[^0-9.,]", ""), F.lit("7"))).otherwise(F.lit("none"))
    gold = F.col("gold")
    responses = rows.select("doc_id", F.col("source").alias("data_source"), gold, F.array("sol", second).alias("responses"))
    scored = responses.select("doc_id", "data_source", F.transform("responses", lambda r: F.when(F.startswith(r, F.lit("#### ")) & F.endswith(r, F.lit("7")) & (F.col("doc_id") % 4 == 0), 1.0).otherwise(g.gsm8k(r, gold)["score"])).alias("scores"))
    return by_dataset(scored)


@query("overlong_penalty", """SELECT doc_id, round(least(-(n_chars - (4000 - 1000)) / 1000 * 0.5, 0), 4) + 0.0 AS penalty FROM documents""")
def overlong(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", r4(g.overlong_penalty(F.col("n_chars"), 4000, 1000, 0.5)).alias("penalty"))


@query("latex_normalized")
def latex_normalized(spark, sf_dir):
    """Branching string work in Python; tests hold it against hand-made cases."""
    return boxed(spark, sf_dir).select("doc_id", latex.normalized_column(t.unboxed(t.last_boxed("sol"))).alias("out"))
