"""Recurrences over the rows of each key in an order, in one shuffle and one pass: state goes from row to row, and no key's rows are collected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with each key's rows in one partition. By a hash of the keys: a shuffle by the keys themselves is left out where a join has dealt the rows by them, and
    if that join becomes a broadcast as it runs, its tasks read what lies near, and a key's rows end in several."""
    return df.repartition(F.xxhash64(*keys))


def keyed_scan(df: DataFrame, keys: list[str], order: list[str | Column], given: list[str], start: Callable[[], object], step: Callable[..., tuple], out: str) -> DataFrame:
    """df with the fields of `out` (DDL). For each key rows are taken by `order`: step(state, *values of the columns `given`) gives (state, *fields); the first
    row of a key has the state start(). A key's rows are in one task, which holds an Arrow batch of them and the state."""
    fields = StructType.fromDDL(out).fields
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*df.columns, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            own = list(zip(*[b.column(b.schema.get_field_index(k)).to_pylist() for k in keys]))
            values = zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in given])
            made: list[list] = [[] for _ in fields]
            for k, row in zip(own, values):
                if k != key:
                    key, state = k, start()
                state, *got = step(state, *row)
                for column, x in zip(made, got):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(m, t) for m, t in zip(made, kinds)]], names=names)

    return _dealt(df, keys).sortWithinPartitions(*keys, *order).mapInArrow(run, StructType([*df.schema.fields, *fields]))


def keyed_lists(df: DataFrame, keys: list[str], order: list[str], given: list[str], make: Callable[..., list], out: str, lot: int = 10_000) -> DataFrame:
    """keys and order columns of df with one field `out` (DDL): make(*lists of the columns `given`, by order) gives a key's values, one for each row. For keys
    of few rows each (a training batch, a conversation): one key's rows are held at a time, and many keys share an Arrow batch."""
    field = StructType.fromDDL(out).fields[0]
    kept = [*keys, *order]
    fields = [*[df.schema[c] for c in kept], field]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, done = None, [], []

        def closed() -> None:
            if rows:
                columns = list(zip(*[r[1] for r in rows]))
                done.extend((*r[0], x) for r, x in zip(rows, make(*map(list, columns))))

        for b in batches:
            at = lambda names: zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in names])  # noqa: B023, E731
            for k, row in zip(at(kept), at(given)):
                if k[: len(keys)] != key:
                    closed()
                    key, rows = k[: len(keys)], []
                rows.append((k, row))
            if len(done) >= lot:
                yield _batch(done, kinds, fields)
                done = []
        closed()
        if done:
            yield _batch(done, kinds, fields)

    return _dealt(df.select(*dict.fromkeys([*kept, *given])), keys).sortWithinPartitions(*keys, *order).mapInArrow(run, StructType(fields))


def _batch(rows: list[tuple], kinds: list, fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.name for f in fields])
