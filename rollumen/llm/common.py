"""Small helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: White space of the contracts, as a Java, RE2 and Python character class.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a temporary one stands in if all tasks run in
    this process's JVM (tests); on a cluster that is an error, as executors don't share such folders."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="rollumen-")
        sc.setCheckpointDir(named)
    return str(named)


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs meanwhile go when it ends, not when the driver's heap is next collected. Only for what is
    written to the shared folder: nothing reads its shuffles again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows go to the shared checkpoint folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    with own_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, which is made under the setting


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut(), for wide rows: a compressed Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with own_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(column: str):
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(df: DataFrame, base: str) -> str:
    """A column name like `base` that df doesn't have."""
    have = {c.lower() for c in df.columns}
    return next(x for x in (base, *(f"{base}{k}" for k in range(len(have) + 1))) if x.lower() not in have)


def crc32_text(col: str = "doc_id"):
    """crc32 of the column as text; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """Whole texts as UTF-8 bytes, one after the other; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for x in column.cast(kind) if not pa.types.is_binary(column.type) else column:
        yield x.as_py() or b""


def prefix_sums(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Running sum of `value` before each row, in the order of `keys`, without one task for all rows: sort by
    range, sum each range, add the sums of earlier ranges (one number for each partition goes to the driver). The
    ranges are read again as they were written, so nothing is dealt a second time."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    held = cut(ranged.withColumn("_part", F.spark_partition_id()))
    sums = {r["_part"]: r["s"] or 0 for r in held.groupBy("_part").agg(F.sum(value).alias("s")).collect()}
    before, total = {}, 0
    for part in sorted(sums):
        before[part] = total
        total += sums[part]

    names = [*held.columns[:-1], out]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, int] = {}
        for b in batches:
            part = b.column(b.num_columns - 1).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else []
            for x, y in zip(edges, edges[1:]):
                own = b.slice(int(x), int(y - x))
                v = own.column(value).fill_null(0).to_numpy()
                first = done.get(int(part[x]), before[int(part[x])])
                run = np.cumsum(v)
                done[int(part[x])] = first + int(run[-1])
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(first + run - v)], names=names)

    return held.mapInArrow(scan, StructType([*held.schema.fields[:-1], StructField(out, LongType())]))


def small(df: DataFrame, bound: int = 20_000) -> DataFrame:
    """df to be joined as a broadcast if it has at most `bound` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def most_frequent(df: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of the largest counts `n`, at most `most` of them: those from the lowest power of two that leaves so few.
    One number for each power goes to the driver, so what is collected of the result has a fixed bound."""
    level = F.floor(F.log2(F.col(n).cast("double"))).cast("int")
    rows, least = 0, 62
    for r in df.filter(F.col(n) > 0).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("level")).collect():
        rows += r["rows"]
        if rows > most:
            break
        least = r["level"]
    return df.filter(F.col(n) >= 2**least)


@contextmanager
def no_collection() -> Iterator[None]:
    """Without the collector of cycles: it would walk stores of millions of words, and none of them is in a cycle."""
    import gc

    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Generations(dict):
    """A store of up to 2 * size entries: when the young generation is full it becomes the old one, and what is asked for
    again moves back. Results never depend on what is held. compute(key) makes a value; keys longer than `longest` are not
    held, which bounds the bytes of the store."""

    def __init__(self, size: int, compute, longest: int = 64) -> None:
        super().__init__()
        self.size, self.compute, self.longest, self.old = size, compute, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        got = self.old.get(key)
        return self.put(key, self.compute(key) if got is None else got)

    def put(self, key, value):
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
