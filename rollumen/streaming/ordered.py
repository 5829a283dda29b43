"""Folds over each key's rows in the order of event time, however the rows arrive: rows wait in the state until the watermark has
passed them, and an event-time timer lets them through. The result doesn't depend on where micro-batches end."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

#: A fold takes a key's state (JSON types; at first None) and a row, and gives the next state and rows of output.
Fold = Callable[[object, dict], tuple[object, list[tuple]]]

#: The column of a row's time inside the state.
MICROS = "at_micros"


def _plain(frame: pd.DataFrame) -> list[list]:
    """Rows of JSON types."""
    columns = []
    for c in frame.columns:
        values = frame[c].tolist()
        columns.append([x.tolist() if hasattr(x, "tolist") else None if x is None or x is pd.NaT or x != x else x for x in values])
    return [list(r) for r in zip(*columns)]


class _Ordered(StatefulProcessor):
    """State of one key, or of a bucket of keys, whose rows wait in one list and whose folds go on side by side."""

    def __init__(self, key: str, order: list[str], fields: list[str], fold: Fold, columns: list[str], buckets: bool) -> None:
        self.key, self.order, self.fields, self.fold, self.columns, self.buckets = key, order, fields, fold, columns, buckets

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "json string")

    def _load(self) -> dict:
        got = self.held.get()
        return json.loads(got[0]) if got is not None else {"states": {}, "rows": [], "timer": None}

    def _save(self, held: dict) -> None:
        """Keep the state, with one timer for the earliest row that waits."""
        due = held["rows"][0][0] // 1000 + 1 if held["rows"] else None
        if due != held["timer"]:
            if held["timer"] is not None:
                self.handle.deleteTimer(held["timer"])
            if due is not None:
                self.handle.registerTimer(due)
            held["timer"] = due
        self.held.update((json.dumps(held),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._load()
        for frame in rows:
            held["rows"] += _plain(frame[[MICROS, *self.fields, *([self.key] if self.buckets else [])]])
        held["rows"].sort(key=lambda r: (r[0], *(r[1 + self.fields.index(o)] for o in self.order)))
        self._save(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, out = self._load(), []
        held["timer"] = None  # the one that has fired
        passed = timerValues.getCurrentWatermarkInMs()
        n = next((k for k, r in enumerate(held["rows"]) if r[0] // 1000 >= passed), len(held["rows"]))
        for r in held["rows"][:n]:
            own = r[-1] if self.buckets else key[0]
            name = json.dumps(r[-1]) if self.buckets else ""
            held["states"][name], got = self.fold(held["states"].get(name), dict(zip(self.fields, r[1:])))
            out += [(own, *g) for g in got]
        held["rows"] = held["rows"][n:]
        self._save(held)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def ordered_fold(stream: DataFrame, key: str, at: str, late: str, order: list[str], fold: Fold, out: str, buckets: int | None = None) -> DataFrame:
    """stream folded by key in the order of the timestamp `at`, then of `order`; rows may come up to `late` behind the latest one. `out`: the fields of
    fold's rows, which come after the key. Rows without a key or a time are left out. A row is let through when a later one has moved the watermark past it; ticks() adds a last one. With
    `buckets` the keys (of JSON types) are dealt to so many states, each of which should get some thousand rows: a state costs several calls in each batch, whatever it holds."""
    fields = [c for c in stream.columns if c not in (key, at)]
    kind = stream.schema[key].dataType.simpleString()
    schema = StructType.fromDDL(f"{key} {kind}, {out}")
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).withColumn(MICROS, F.unix_micros(at))
    # one condition that reads the time, so that it isn't moved before the watermark, which ticks move
    rows = rows.filter(F.when(F.col(at).isNotNull(), F.col(key).isNotNull()).otherwise(False))
    group = key
    if buckets is not None:
        group = "bucket_of_keys"
        rows = rows.withColumn(group, F.pmod(F.xxhash64(key), F.lit(buckets)))
    return rows.groupBy(group).transformWithStateInPandas(_Ordered(key, order, fields, fold, schema.names, buckets is not None), schema, "Append", "EventTime")


def ticks(rows: DataFrame, at: str, late: str) -> DataFrame:
    """One row after all others that only moves the watermark: no key, and a time twice `late` after the last."""
    last = rows.agg((F.max(at) + F.expr(f"2 * interval {late}")).alias(at))
    return last.select(*[F.col(c) if c == at else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
