"""Streams that stop and go on, folds in event time, growing tables: small cases by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollumen.streaming import samples
from rollumen.streaming.appended import AppendLog, generating
from rollumen.streaming.ordered import ordered_fold, ticks
from rollumen.streaming.resume import Run, keyed_state, opened, staged, step_of


def folded(fold, rows):
    state, out = None, []
    for r in rows:
        state, got = fold(state, r)
        out += got
    return state, out


def test_two_queues_by_hand():
    fold, _ = samples.two_queues(2)
    ops = ["get", "put", "put", "put", "put", "get", "get_validate", "put_validate", "get_validate", "get", "get", "get", "shutdown", "get", "put", "get"]
    state, out = folded(fold, [{"op": o, "id": k} for k, o in enumerate(ops)])
    assert out == [
        (0, 1, "item", 0, 0), (5, 3, "item", 1, 1), (6, None, "none", 0, 1), (8, 7, "validate", 0, 1), (9, 4, "item", 0, 1),
        (10, None, "end", 0, 1), (11, None, "end", 0, 1), (13, None, "end", 0, 1), (15, 14, "item", 0, 1),
    ]
    assert state["queue"] == state["waiting"] == state["side"] == [] and not state["open"]
    with pytest.raises(ValueError):
        fold(None, {"op": "peek", "id": 1})


def test_resumed_rollouts_by_hand():
    fold, _ = samples.resumed_rollouts(5)
    rows = [(1, [1, 2], True), (2, [], True), (2, [3], False), (3, [1, 2, 3, 4, 5, 6], True), (4, [9], True)]
    state, out = folded(fold, [{"version": v, "tokens": t, "cancelled": c} for v, t, c in rows])
    assert out == [(0, [1, 2, 3], [0, 2, 2], [1, 2, 2], 1, 2, True), (1, [1, 2, 3, 4, 5], [0], [3], 3, 3, False)]
    assert state["attempt"] == 2 and state["tokens"] == [9]


def test_a_run_dies_and_goes_on(spark, tmp_path):
    df = spark.range(40).withColumn("k", F.col("id") % 3)
    stream = staged(df, "id", 4, f"{tmp_path}/in").groupBy("k").count()
    root = f"{tmp_path}/runs"
    one = opened(spark, root, "auto")
    assert one.committed() == -1 and one.rows(stream.schema).count() == 0
    assert not one.advance(stream, "update", before=1)
    assert one.committed() == 0
    assert not opened(spark, root).advance(stream, "update", after=1)
    assert one.committed() == 0 and one.rows(stream.schema).select("batch").distinct().count() == 1  # written, not committed
    assert opened(spark, root, "resume_path", one.folder).advance(stream, "update")
    last = one.rows(stream.schema).groupBy("k").agg(F.max_by("count", "batch").alias("n"))
    assert {r.k: r.n for r in last.collect()} == {0: 14, 1: 13, 2: 13}
    assert opened(spark, root, "disable").folder != one.folder
    for mode, path in (("resume_path", None), ("resume_path", f"{tmp_path}/run_7"), ("later", None)):
        with pytest.raises(ValueError):
            opened(spark, root, mode, path)
    assert step_of(3, 8, 2) == 49


def test_rows_are_folded_in_the_order_of_time(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", at(9), 1), ("b", at(1), 2), ("a", at(3), 3), (None, at(2), 4), ("a", None, 5), ("b", at(1), 1), ("a", at(5), 6)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long")
    df.filter("id < 4").write.parquet(f"{tmp_path}/in/part=0")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    def fold(state, row):
        seen = [*(state or []), row["id"]]
        return seen, [(",".join(map(str, seen)),)]

    with keyed_state(spark):
        out = ordered_fold(stream, "k", "ts", "1 minute", ["id"], fold, "seen string")
        run = Run(spark, f"{tmp_path}/run")
        for k, more in enumerate((df.filter("id >= 4"), ticks(df, "ts", "1 minute"), ticks(df, "ts", "1 minute"))):
            run.advance(out)
            more.write.parquet(f"{tmp_path}/in/part={k + 1}")
        run.advance(out)
    got = run.rows(out.schema)
    assert sorted((r.k, r.seen) for r in got.collect()) == [("a", "3"), ("a", "3,6"), ("a", "3,6,1"), ("b", "1"), ("b", "1,2")]


def test_appended_rows_are_read_once(spark, tmp_path):
    log, run = AppendLog(spark, f"{tmp_path}/t"), Run(spark, f"{tmp_path}/run")
    rows = lambda a, b: spark.range(a, b).select("id", F.col("id").cast("string").alias("s"))
    schema = rows(0, 1).schema
    log.append(rows(0, 10))
    log.append(rows(10, 10))  # an empty segment
    run.advance(log.stream(schema))
    rows(90, 99).write.parquet(f"{tmp_path}/t/data/00000002")  # of an append that died: no entry in the log
    run.advance(log.stream(schema))
    assert log.append(rows(10, 15)) == 2
    run.advance(log.stream(schema), before=1)
    log.append(rows(15, 20))
    assert run.advance(log.stream(schema)) and run.advance(log.stream(schema))
    assert sorted(r.id for r in run.rows(schema).collect()) == list(range(20))


def test_generating_ends_by_itself(spark, tmp_path):
    log, run = AppendLog(spark, f"{tmp_path}/t"), Run(spark, f"{tmp_path}/run")
    log.append(spark.range(8, 10))
    generating(log, run, spark.range(1).schema, lambda rows, k: rows.filter("id > 1").select(F.floor(F.col("id") / 2).alias("id")), 50)
    assert sorted(r.id for r in run.rows(spark.range(1).schema).collect()) == [1, 1, 2, 2, 4, 4, 8, 9]


def test_keys_of_a_bucket_are_folded_by_themselves(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(k % 5, at((k * 7) % 60), k) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, id long")
    df.filter("id % 2 = 0").write.parquet(f"{tmp_path}/in/part=0")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    def fold(state, row):
        seen = [*(state or []), row["id"]]
        return seen, [(",".join(map(str, seen)),)]

    with keyed_state(spark):
        out = ordered_fold(stream, "k", "ts", "5 minutes", ["id"], fold, "seen string", buckets=2)
        run = Run(spark, f"{tmp_path}/run")
        for k, more in enumerate((df.filter("id % 2 = 1"), ticks(df, "ts", "5 minutes"), ticks(df, "ts", "5 minutes"))):
            run.advance(out)
            more.write.parquet(f"{tmp_path}/in/part={k + 1}")
        run.advance(out)
    want = []
    for key in range(5):
        own = [str(r[2]) for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))]
        want += [(key, ",".join(own[: n + 1])) for n in range(len(own))]
    assert sorted((r.k, r.seen) for r in run.rows(out.schema).collect()) == sorted(want)
