"""Running a streaming query over files that are there, to its end, and reading its result as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollumen.plans.lineage import checkpoint_root


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file; wherever the session's file systems reach."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def finished(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Every row that the query emits, with the micro-batch it came from; written to the shared folder by foreachBatch.
    A batch that is run again after a failure overwrites what it wrote before."""
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.option("basePath", f"{root}/out").schema(stream.schema.add("batch", "long") if "batch" not in stream.columns else stream.schema).parquet(f"{root}/out")


def fan_out(sinks: list[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """One foreachBatch function for several sinks; the batch is computed once."""

    def put(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, number)
        finally:
            held.unpersist()

    return put
