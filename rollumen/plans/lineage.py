"""Cutting lineage by the checkpoint folder that the session names."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a temporary one stands in if all tasks run in this
    process's JVM (tests); on a cluster that is an error, as executors don't share such folders."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="rollumen-")
        sc.setCheckpointDir(named)
    return str(named)


def fixed(df: DataFrame) -> DataFrame:
    """df as written to the checkpoint folder: the same rows in the same partitions for every later use."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
