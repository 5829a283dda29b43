"""Streaming queries that stop and go on: offsets, state and output of a run lie in one folder of the shared file system.

A batch's rows are written under its number, so a batch that is run again replaces what it wrote, and only committed batches are read:
every row counts once, wherever the run was ended."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollumen.plans.lineage import checkpoint_root

_ENDED = "this run was told to end here"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and several states of one key need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds, on any file system of the session; none where there is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


class Run:
    """One run's folder: `state` (offsets, commits, state stores) and `out`."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def advance(self, stream: DataFrame, mode: str = "append", before: int | None = None, after: int | None = None) -> bool:
        """Run what the source has; True when that is done. `before` and `after` end the run like a crash, before or after it has written
        that batch (the batch isn't committed then), and give False."""

        def put(batch: DataFrame, number: int) -> None:
            if before is not None and number >= before:
                raise RuntimeError(_ENDED)
            batch.write.mode("overwrite").parquet(f"{self.folder}/out/batch={number}")
            if after is not None and number >= after:
                raise RuntimeError(_ENDED)

        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True)
        query = writer.foreachBatch(put).start()
        try:
            query.awaitTermination()
        except StreamingQueryException as e:
            if _ENDED not in str(e):
                raise
            return False
        return True

    def committed(self) -> int:
        """The last batch that is done; -1 if none is."""
        return max((int(n) for n in listed(self.spark, f"{self.folder}/state/commits") if n.isdigit()), default=-1)

    def rows(self, schema: StructType) -> DataFrame:
        """Rows of the committed batches, with the number of their batch."""
        out = f"{self.folder}/out"
        if not listed(self.spark, out):
            return self.spark.createDataFrame([], StructType([*schema.fields]).add("batch", "long"))
        held = self.spark.read.option("basePath", out).schema(StructType([*schema.fields]).add("batch", "long")).parquet(out)
        return held.filter(F.col("batch") <= self.committed())


def opened(spark: SparkSession, root: str, mode: str = "auto", path: str | None = None) -> Run:
    """The run to go on with. `disable`: a new one; `auto`: the newest of root, or a new one where there is none; `resume_path`: the one at `path`."""
    if mode == "resume_path":
        if not path or not re.search(r"run_\d+/?$", path):
            raise ValueError("resume_path needs the folder of a run, run_<number>")
        if not listed(spark, f"{path}/state"):
            raise ValueError(f"no run to resume at {path}")
        return Run(spark, path.rstrip("/"))
    if mode not in ("auto", "disable"):
        raise ValueError(f"unknown resume mode: {mode}")
    runs = [int(n[4:]) for n in listed(spark, root) if re.fullmatch(r"run_\d+", n)]
    number = max(runs) if runs and mode == "auto" else max(runs, default=-1) + 1
    return Run(spark, f"{root}/run_{number:06d}")


def step_of(trainer_steps: int, required: int, sync_steps: int) -> int:
    """The first sample's step after the trainer's checkpoint of that step."""
    return trainer_steps * required * sync_steps + 1


def staged(df: DataFrame, key: str, parts: int, folder: str) -> DataFrame:
    """df as a stream of about `parts` batches in the order of the number or time `key`, from files in folder; what is written later is read later."""
    spark = df.sparkSession
    order = F.col(key).cast("double")
    edges = sorted(set(df.select(order.alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.001)))
    bounds = [None, *edges, None]
    files = []
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        mine = df.filter((order >= low if low is not None else F.lit(True)) & (order < high if high is not None else F.lit(True)))
        mine.write.parquet(f"{folder}/part={k}")
        files.append(sum(n.endswith(".parquet") for n in listed(spark, f"{folder}/part={k}")))
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(files)).option("recursiveFileLookup", "true")
    return reader.parquet(folder)
