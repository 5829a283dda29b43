"""Benchmark records from raw tables, which the driver's tables stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollumen.functions import benchmarks as bm
from rollumen.plans.domain import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


#: White space around texts, in SQL.
_T = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_D = f"d AS (SELECT doc_id, {_T.format('coalesce(text, chr(32))')} AS q, lang, source FROM documents)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions with blanks around them, and their text as an image's bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" \n"), F.coalesce("text", F.lit("")), F.lit("\t")).alias("q"), "lang", "source", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))


def _shown(records: DataFrame, *more: str) -> DataFrame:
    """Records with their image's path, sizes of bytes, and the query's digest."""
    return records.select(F.array_join("images", ",").alias("images"), F.sha2("query", 256).alias("query"), "response", *more)


@query(
    "bench_vstar",
    f"""WITH {_D} SELECT 'VStar_images/' || doc_id || '.jpg' AS images, sha256(q || CASE WHEN ends_with(q, 'Answer with the option''s letter from the given choices directly.') THEN '' ELSE chr(10) || 'Answer with the option''s letter from the given choices directly.' END) AS query,
    upper(lang) AS response, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE source END AS category, CAST(strlen(coalesce(text, '')) AS INTEGER) AS bytes FROM d JOIN documents USING (doc_id, lang, source)""",
)
def bench_vstar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    key = F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("doc_id").cast("string"))
    raw = d.select(F.struct(F.col("data").alias("bytes")).alias("image"), F.col("q").alias("text"), F.col("lang").alias("label"), key.alias("question_id"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("category"), F.col("doc_id").alias("row"))
    return _shown(bm.records(raw, "vstar"), "category", F.octet_length("image_bytes").alias("bytes"))


@query(
    "bench_hrbench",
    f"""WITH {_D} SELECT 'HRBench_images/' || format('{{:05d}}', doc_id) || '.jpg' AS images, sha256(q || CASE WHEN doc_id % 4 = 3 THEN '' ELSE ' Select from the following choices.' || chr(10) || '(A) ' || source ||
      CASE WHEN doc_id % 2 = 0 THEN chr(10) || '(C) ' || lang ELSE '' END END) AS query, lang AS response, doc_id AS question_id, source AS category FROM d""",
)
def bench_hrbench(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    raw = _documents(spark, sf_dir).select(
        i.alias("index"), F.col("q").alias("question"), F.col("lang").alias("answer"), F.when(i % 4 != 3, F.concat(F.lit(" "), "source")).alias("A"), F.lit("  ").alias("B"),
        F.when(i % 2 == 0, F.col("lang")).alias("C"), F.lit(None).cast("string").alias("D"), F.col("source").alias("category"), F.base64("data").alias("image"),
    )
    return _shown(bm.records(raw, "hrbench-8k"), "question_id", "category")


for _language, _name in (("en", "mme-realworld"), ("cn", "mme-realworld-cn")):

    @query(
        f"bench_{_name.replace('-', '_')}",
        f"""WITH {_D} SELECT 'MME_RealWorld_Full_images/' || format('{{:06d}}', doc_id) || '.jpg' AS images, sha256(q || '{bm.LISTED[_language][0].strip(chr(10))}' || chr(10) || '(A) ' || lang || chr(10) || '(B) ' || source ||
          '{bm.LISTED[_language][1]}') AS query, lang AS response, doc_id AS index FROM d""",
    )
    def _mme(spark: SparkSession, sf_dir: str, name=_name) -> DataFrame:
        options = F.array(F.concat(F.lit(" (A) "), "lang"), F.lit(""), F.concat(F.lit("(B) "), "source", F.lit("\n")))
        raw = _documents(spark, sf_dir).select(F.base64("data").alias("bytes"), F.col("doc_id").alias("index"), F.col("q").alias("question"), options.alias("multi-choice options"), F.col("lang").alias("answer"))
        return _shown(bm.records(raw, name), "index")


@query(
    "bench_mmstar",
    f"""WITH {_D} SELECT 'MMStar_images/' || format('{{:05d}}', doc_id) || '.jpg' AS images, sha256(q) AS query, upper(lang) AS response, doc_id AS index, source AS category, 'unknown' AS l2_category FROM d""",
)
def bench_mmstar(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _documents(spark, sf_dir).select(F.col("doc_id").alias("index"), F.col("q").alias("question"), F.col("lang").alias("answer"), F.col("source").alias("category"), F.lit(None).cast("string").alias("l2_category"), F.col("data").alias("image"))
    return _shown(bm.records(raw, "mmstar"), "index", "category", "l2_category")


@query(
    "bench_pope",
    f"""WITH {_D} SELECT 'POPE_images/popular_' || format('{{:05d}}', doc_id) || '_' || CASE WHEN doc_id % 2 = 0 THEN source ELSE 'r' || doc_id END || '.jpg' AS images,
    sha256(q || chr(10) || 'Answer the question using a single word or phrase.') AS query, lang AS response, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'q' || doc_id END AS question_id FROM d""",
)
def bench_pope(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    raw = _documents(spark, sf_dir).select(
        i.alias("row"), F.concat(F.lit("r"), i.cast("string")).alias("id"), F.when(i % 3 != 0, F.concat(F.lit("q"), i.cast("string"))).alias("question_id"), F.col("q").alias("question"),
        F.upper("lang").alias("answer"), F.lit("").alias("category"), F.when(i % 2 == 0, F.col("source")).alias("image_source"), F.col("data").alias("image"),
    )
    return _shown(bm.records(raw, "pope_pop"), "question_id")


@query("bench_cv_bench", "SELECT 'CVBench_images/' || format('{:05d}', p_partkey) || '.jpg' AS images, sha256(p_name) AS query, p_brand AS response, p_type AS type, '' AS task FROM part")
def bench_cv_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    raw = p.select(F.col("p_partkey").alias("idx"), F.col("p_type").alias("type"), F.lit(None).cast("string").alias("task"), F.struct(F.encode("p_name", "utf-8").alias("bytes")).alias("image"), F.col("p_name").alias("prompt"), F.col("p_brand").alias("answer"), F.lit("x").alias("source"))
    return _shown(bm.records(raw, "cv-bench"), "type", "task")


@query("bench_mmvp", "SELECT 'MMVP Images/' || p_partkey || '.jpg' AS images, sha256(p_name || ' (a) ' || p_brand || ' (b) ' || p_type) AS query, p_brand AS response, p_partkey AS index FROM part")
def bench_mmvp(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    raw = p.select(F.col("p_partkey").cast("string").alias("Index"), F.concat(F.lit(" "), "p_name").alias("Question"), F.concat(F.lit("(a) "), "p_brand", F.lit(" (b) "), "p_type", F.lit(" ")).alias("Options"), F.col("p_brand").alias("Correct Answer"))
    there = p.select(F.concat(F.lit("MMVP Images/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"))
    return _shown(bm.mmvp(raw, images=there), "index")


@query(
    "bench_zoombench",
    f"""WITH {_D} SELECT 'ZoomBench_images/' || CASE WHEN doc_id % 4 = 0 THEN doc_id + 1000000 ELSE doc_id END || '.jpg' AS images, sha256(q) AS query, lang AS response,
    CASE WHEN doc_id % 2 = 0 THEN 'ZoomBench_crop_images/' || CASE WHEN doc_id % 4 = 0 THEN doc_id + 1000000 ELSE doc_id END || '.jpg' ELSE '' END AS crop_images FROM d""",
)
def bench_zoombench(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    crop = F.struct(F.when(i % 2 == 0, F.col("data")).alias("bytes"))
    raw = _documents(spark, sf_dir).select(F.when(i % 4 != 0, i.cast("string")).alias("id"), (i + 1_000_000).alias("row"), F.col("q").alias("query"), F.col("lang").alias("response"), F.struct(F.col("data").alias("bytes")).alias("image"), crop.alias("crop_image"))
    return _shown(bm.records(raw, "zoombench"), F.array_join("crop_images", ",").alias("crop_images"))
