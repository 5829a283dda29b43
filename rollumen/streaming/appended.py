"""A table that grows while it is read: segments of rows, appended by Spark, and a streaming source with an offset for each segment.

A segment is a folder of Parquet files and an entry in the log, which is written last and under its final name only, so a segment is there whole or
not at all. The source reads files by pyarrow, which knows local, HDFS, S3 and GCS paths."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from rollumen.streaming.resume import Run, listed

FORMAT = "rollumen_appended"


class AppendLog:
    """Segments 0, 1, 2, ... under a folder; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def count(self) -> int:
        return sum(n.endswith(".json") for n in listed(self.spark, f"{self.folder}/log"))

    def append(self, rows: DataFrame) -> int:
        """Add rows as the next segment; its number."""
        number = self.count()
        data = f"{self.folder}/data/{number:08d}"
        rows.write.mode("overwrite").parquet(data)  # of an append that died before its entry was written
        files = [f"{data}/{n}" for n in listed(self.spark, data) if n.endswith(".parquet")]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        system = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        draft, final = path(f"{self.folder}/log/.{number:08d}"), path(f"{self.folder}/log/{number:08d}.json")
        stream = system.create(draft, True)
        stream.write(bytearray(json.dumps({"files": files}).encode()))
        stream.close()
        if not system.rename(draft, final):
            raise OSError(f"segment {number} could not be added")
        return number

    def stream(self, schema: StructType) -> DataFrame:
        self.spark.dataSource.register(AppendedSource)
        return self.spark.readStream.format(FORMAT).schema(schema).option("path", self.folder).load()


def _located(path: str):
    """The file system of a path of Spark's, and the path there."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class _File(InputPartition):
    def __init__(self, file: str) -> None:
        self.file = file


class AppendedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        raise ValueError("give the schema of the appended rows")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options["path"], schema)


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, schema: StructType) -> None:
        self.folder, self.names = folder, schema.names

    def initialOffset(self) -> dict:
        return {"segments": 0}

    def latestOffset(self) -> dict:
        system, path = _located(f"{self.folder}/log")
        found = system.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True))
        return {"segments": sum(f.base_name.endswith(".json") for f in found)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, path = _located(f"{self.folder}/log")
        files = []
        for k in range(start["segments"], end["segments"]):
            with system.open_input_stream(f"{path}/{k:08d}.json") as f:
                files += json.loads(f.read())["files"]
        return [_File(f) for f in files]

    def read(self, partition: _File) -> Iterator:
        system, path = _located(partition.file)
        with system.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=self.names):
                yield batch.select(self.names)

    def commit(self, end: dict) -> None:
        pass


def generating(log: AppendLog, run: Run, schema: StructType, generate: Callable[[DataFrame, int], DataFrame | None], rounds: int) -> None:
    """Read what is there; after each round `generate` makes new rows of that round's (None, or no rows: it ends), which are appended and read in the
    next, up to `rounds` times. What a run had read before stays read."""
    for k in range(rounds):
        seen = run.committed()
        run.advance(log.stream(schema))
        new = generate(run.rows(schema).filter(f"batch > {seen}").drop("batch"), k)
        if new is None or new.isEmpty():
            return
        log.append(new)
