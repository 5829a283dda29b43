"""A map by calls that wait (a model server, a judge): some of a task's rows are out at a time, and results come in order."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


class _Gauge:
    """How many calls run, and the most that ever did."""

    def __init__(self) -> None:
        self.lock, self.now, self.most = Lock(), 0, 0

    def __enter__(self) -> None:
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)

    def __exit__(self, *_) -> None:
        with self.lock:
            self.now -= 1


def bounded_map(
    df: DataFrame, call: Callable[[dict], object], result: str, in_flight: int = 8, attempts: int = 3, wait: float = 0.05, longest: float = 30.0, raise_errors: bool = False
) -> DataFrame:
    """df with `result` (a field in DDL, whose value call gives from a row as a dict), attempts, error and in_flight (the most calls of the task at once, so far).

    In each task at most `in_flight` rows are out; a row is taken when there is room, and results are given out in the order of the rows, so what waits
    for a slow row is bounded too. A call that raises is made again, after twice the wait each time, up to `attempts` times; then the result is
    null and error says why, or the job fails if raise_errors. Calls should be idempotent: a lost executor's rows are called again."""
    if in_flight < 1 or attempts < 1:
        raise ValueError("in_flight and attempts are at least 1")
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"{result}, attempts int, error string, in_flight int").fields])
    names, made = df.columns, schema.names[len(df.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gauge = _Gauge()

        def tried(row: dict) -> tuple[object, int, str | None]:
            pause = wait
            for k in range(1, attempts + 1):
                try:
                    with gauge:
                        return call(row), k, None
                except Exception as e:
                    if k == attempts:
                        if raise_errors:
                            raise
                        return None, k, f"{type(e).__name__}: {e}"
                time.sleep(min(pause, longest))
                pause *= 2

        kinds = None
        with ThreadPoolExecutor(in_flight) as pool:
            out: deque = deque()
            for b in batches:
                kinds = kinds or b.schema
                done: list[tuple] = []
                for row in b.to_pylist():
                    if len(out) == in_flight:
                        done.append(out.popleft().result())
                    out.append(pool.submit(tried, row))
                while out:  # a batch is given out whole
                    done.append(out.popleft().result())
                values = [pa.array([d[0] for d in done], _kind(schema[made].dataType)), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns, *values, pa.array([gauge.most] * len(done), pa.int32())], [*names, made, "attempts", "error", "in_flight"])

    return df.mapInArrow(run, schema)


def _kind(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
