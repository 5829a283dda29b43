"""Sinks: tables, JSON lines, metric logs, console lines."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollumen.functions.text import metric_key


def responses(samples: DataFrame, key: str = "row_id", order: str = "sample") -> DataFrame:
    """n samples for each prompt as one list, in order."""
    got = samples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "response"))).alias("x"))
    return got.select(key, F.col("x.response").alias("responses"))


def swap_in(df: DataFrame, path: str) -> None:
    """Written beside the target, which is put aside and deleted only when the new table is in its place: a half-written
    table is never seen. Between the two renames there is no table at that path; a reader that begins then fails and has to try again."""
    spark: SparkSession = df.sparkSession
    part = f"{path}.new"
    df.write.mode("overwrite").parquet(part)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path)
    aside, fs = jvm.org.apache.hadoop.fs.Path(f"{path}.old"), new.getFileSystem(conf)
    fs.delete(aside, True)
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"{path} could not be put aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"{part} could not be put in place")
    fs.delete(aside, True)


def dump_generations(df: DataFrame, path: str, step: int) -> None:
    df.withColumn("step", F.lit(step)).write.mode("append").partitionBy("step").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def metric_lines(metrics: DataFrame) -> DataFrame:
    """(step, name, value) -> one JSON line for each step: step and data, names made fit for back ends."""
    rows = metrics.groupBy("step").agg(F.array_sort(F.collect_list(F.struct(metric_key("name").alias("k"), "value"))).alias("x"))
    return rows.select("step", F.to_json(F.struct("step", F.map_from_entries("x").alias("data"))).alias("line"))


def console_lines(metrics: DataFrame) -> DataFrame:
    """step:N - k:v - ..., in the order of names."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda x: F.concat(x["name"], F.lit(":"), F.format_string("%.3f", x["value"]))), " - ")
    return metrics.filter(F.col("value").isNotNull()).groupBy("step").agg(F.concat(F.lit("step:"), F.first("step").cast("string"), F.lit(" - "), text).alias("line"))


def valid_logprobs(tokens: DataFrame, *cols: str) -> DataFrame:
    return tokens.filter("mask > 0").select("row_id", "t", *cols)


def sample_table(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k rows in the order of the MD5 of seed and input: the same for every run and partitioning."""
    return rows.orderBy(F.md5(F.concat_ws("-", F.lit(seed).cast("string"), "input")), "input").limit(k)


def flattened(config: Mapping, prefix: str = "") -> dict[str, object]:
    """a/b/c keys of nested settings; a list gives its length and its elements by number."""
    out: dict[str, object] = {}
    for k, v in config.items():
        name = f"{prefix}{k}"
        if isinstance(v, (list, tuple)):
            v = {"list_len": len(v)} | dict(enumerate(v))
        if isinstance(v, Mapping):
            out |= flattened(v, f"{name}/")
        else:
            out[name] = v
    return out


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of JSON objects as the lines of one JSON list."""
    some = False
    for b in batches:
        lines = [f"{',' if some or k else '['}{x}" for k, x in enumerate(b.column(0).to_pylist())]
        some = some or bool(lines)
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["]" if some else "[]"])], ["value"])


def json_array_files(df: DataFrame, path: str) -> None:
    """Files that are one JSON list each, of a partition's rows as they come; no list is held anywhere. Repartition for smaller files."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(_bracketed, "value string").write.text(path)


def joined_json(df: DataFrame, key: Column) -> DataFrame:
    """One JSON array for each key, which should have few rows; json_array_files() writes whole tables."""
    return df.groupBy(key.alias("key")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("json"))
