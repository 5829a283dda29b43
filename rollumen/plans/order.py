"""Row numbers, running sums and last values in a global order, without one task for all rows.

Rows are ranged by the keys and written to the shared folder; one value for each range goes to the driver; a scan of the ranges as they were
written adds the column. Rows move once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from rollumen.plans.lineage import fixed

#: From a range's first value and its rows: the new column, and what the next rows of the range begin with.
Step = Callable[[object, pa.RecordBatch], tuple[pa.Array, object]]


def _ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return fixed(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))


def _scanned(held: DataFrame, first: dict[int, object], step: Step, out: str, kind: DataType) -> DataFrame:
    """held, in the order in which it was written, with the column that step makes; it replaces one of the same name."""
    names = [c for c in held.columns if c != "_part"]
    at = names.index(out) if out in names else len(names)
    after = [*names[:at], out, *names[at + 1 :]]
    fields = [StructField(out, kind) if c == out else held.schema[c] for c in after]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, object] = {}
        for b in batches:
            part = b.column(b.schema.get_field_index("_part")).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else []
            for x, y in zip(cuts, cuts[1:]):
                own, p = b.slice(x, y - x), int(part[x])
                column, done[p] = step(done[p] if p in done else first.get(p), own)
                yield pa.RecordBatch.from_arrays([column if c == out else own.column(c) for c in after], names=after)

    return held.mapInArrow(scan, StructType(fields))


def _before(sums: dict[int, object], zero) -> dict[int, object]:
    out, total = {}, zero
    for part in sorted(sums):
        out[part] = total
        total = total + sums[part]
    return out


def numbered(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Adds (or replaces) out: 0, 1, 2, ... in the order of keys, which must be unique."""
    held = _ranged(df, keys)
    first = _before({r["_part"]: r["n"] for r in held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}, 0)

    def step(at: int, rows: pa.RecordBatch) -> tuple[pa.Array, int]:
        return pa.array(np.arange(at, at + rows.num_rows), pa.int64()), at + rows.num_rows

    return _scanned(held, first, step, out, LongType())


def running_sum(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value (nulls count as 0) up to and including each row, in the order of keys."""
    held = _ranged(df, keys)
    total = held.groupBy("_part").agg(F.sum(value).alias("s"))
    kind = total.schema["s"].dataType
    sums = {r["_part"]: r["s"] or 0 for r in total.collect()}
    dtype = np.int64 if isinstance(kind, LongType) else np.float64

    def step(at, rows: pa.RecordBatch):
        own = np.cumsum(rows.column(value).fill_null(0).to_numpy(zero_copy_only=False).astype(dtype)) + at
        return pa.array(own), own[-1]

    return _scanned(held, _before(sums, dtype(0)), step, out, kind)


def carried(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds out: the last value that isn't null up to and including each row, in the order of keys."""
    held = _ranged(df, keys)
    order = F.struct(*keys)
    last = held.filter(F.col(value).isNotNull()).groupBy("_part").agg(F.max_by(value, order).alias("v"))
    known = {r["_part"]: r["v"] for r in last.collect()}
    first, seen = {}, None
    for part in range(max(known, default=-1) + 2):
        first[part] = seen
        seen = known.get(part, seen)
    tail = len(first)

    def step(at, rows: pa.RecordBatch):
        column = pc.fill_null_forward(rows.column(value))
        if at is not None:
            column = column.fill_null(pa.scalar(at, column.type))
        return column, column[-1].as_py()

    class _Carried(dict):
        def get(self, part, default=None):
            return self[part] if part < tail else seen

    return _scanned(held, _Carried(first), step, out, held.schema[value].dataType)
