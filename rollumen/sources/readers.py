"""Sources: multi-file scans by suffix, benchmark files, tolerant logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Benchmark splits.
SPLITS = {"pope": "test", "pope_adv": "adversarial", "pope_pop": "popular", "pope_random": "random"}


def scan(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet and JSON files by suffix, one after the other; another suffix is an error. JSON needs a schema."""
    out = None
    for path in paths:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        if path.endswith(".parquet"):
            part = reader.parquet(path)
        elif path.endswith((".json", ".jsonl")):
            if schema is None:
                raise ValueError("JSON is read with a declared schema")
            part = reader.json(path, mode="FAILFAST")
        else:
            raise ValueError(f"no reader for {path}")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


def nested(df: DataFrame, column: str, keys: list[str]) -> Column:
    """A field deep in structs."""
    out = df[column]
    for k in keys:
        out = out.getField(k)
    return out


def csv_with_header(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """All columns as trimmed strings; the index as a long."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True)
    out = raw.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return out.withColumn(index, F.col(f"`{index}`").cast("long")) if index else out


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, one row with n_bad): blank and broken lines are skipped and counted."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = lines.select(F.from_json("value", f"struct<{schema}, _corrupt_record: string>", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("x"))
    good = parsed.filter("x._corrupt_record is null").select("x.*").drop("_corrupt_record")
    return good, parsed.agg(F.count_if(F.col("x._corrupt_record").isNotNull()).alias("n_bad"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON list."""
    return spark.read.schema(schema).json(path, multiLine=True)


def binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, base64) of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.base64("content").alias("base64"))


def data_uri(kind: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def within_length(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows up to the length; an unknown length counts as too long."""
    return df.filter(F.coalesce(length, F.lit(most + 1)) <= most)


def with_teacher_image(images: Column) -> Column:
    """True if any element is a non-blank string."""
    return F.coalesce(F.exists(images, lambda x: F.length(x) > 0), F.lit(False))


def cached_replay(spark: SparkSession, root: str, key: str, make) -> DataFrame:
    """The table under root/key, made and written the first time."""
    path = f"{root}/{key}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        make().write.parquet(path)
    return spark.read.parquet(path)
