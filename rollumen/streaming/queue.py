"""Streaming sample flow: bounded queue, count-triggered batches, limits and routing.

Stateful operators keep their state in Structured Streaming's state store (applyInPandasWithState), by key; pure folds
over ordered events are native expressions, so that they work on batches and inside foreachBatch alike."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollumen.plans.scan import keyed_scan


def expanded(prompts: DataFrame, n: int) -> DataFrame:
    """Each prompt as n samples; works on batches and streams."""
    return prompts.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def bounded_queue(stream: DataFrame, key: str, item: str, capacity: int) -> DataFrame:
    """(key, produced, dropped, size, items) after each micro-batch: a queue that drops its oldest item when full."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        produced, dropped, held = state.get if state.exists else (0, 0, "")
        items = [int(x) for x in held.split(",") if x]
        new = [int(x) for f in frames for x in f[item]]
        items += sorted(new)
        over = max(0, len(items) - capacity)
        items = items[over:]
        produced, dropped = produced + len(new), dropped + over
        state.update((produced, dropped, ",".join(map(str, items))))
        yield pd.DataFrame({key: [k[0]], "produced": [produced], "dropped": [dropped], "size": [len(items)], "items": [",".join(map(str, items))]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, produced long, dropped long, size long, items string", "produced long, dropped long, items string", "update", "NoTimeout"
    )


def counted_batches(stream: DataFrame, key: str, item: str, size: int) -> DataFrame:
    """(key, batch, items) whenever `size` items have come; what is short at the end is never emitted."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, held = state.get if state.exists else (0, "")
        items = [int(x) for x in held.split(",") if x] + sorted(int(x) for f in frames for x in f[item])
        whole = len(items) // size
        out = [(k[0], done + i, ",".join(map(str, items[i * size : (i + 1) * size]))) for i in range(whole)]
        state.update((done + whole, ",".join(map(str, items[whole * size :]))))
        yield pd.DataFrame(out, columns=[key, "batch", "items"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, batch long, items string", "done long, items string", "append", "NoTimeout")


def queue_state(arrivals: Column, capacity: int) -> Column:
    """The queue after all of an ordered array: struct<produced, dropped, size, items>."""
    n = F.size(arrivals)
    over = F.greatest(n - capacity, F.lit(0))
    kept = F.slice(arrivals, over + 1, F.greatest(n - over, F.lit(0)))
    return F.struct(n.alias("produced"), over.alias("dropped"), F.size(kept).alias("size"), kept.alias("items"))


def capacity_limit(required: int, threshold: float, sync_steps: int) -> int:
    """Samples that may be out between two updates of the parameters."""
    return int(required * (1 + threshold) * sync_steps)


def should_pause(queued: Column, capacity: int, staleness: Column, limit: int) -> Column:
    return (queued >= capacity) | (staleness >= limit)


def let_through(events: DataFrame, key: str, at: str, cost: str, rate: float, burst: float, order: list[str], out: str = "let_through") -> DataFrame:
    """Adds when each event is let through: a bucket of `burst` for each key, full at its first event, that fills by `rate` a second; an event waits until
    its cost is there, in turn. at: seconds. Events of a key are taken by at, then by order."""

    def step(s: tuple | None, when: float, price: float) -> tuple:
        level, now = (burst, when) if s is None else s
        here = max(when, now)
        level = min(burst, level + (here - now) * rate)
        wait = max((price - level) / rate, 0.0)
        return (level + wait * rate - price, here + wait), here + wait

    return keyed_scan(events, [key], [at, *order], [at, cost], lambda: None, step, f"{out} double")


def routed(requests: DataFrame, key: str, at: str, seconds: str, servers: int, order: list[str], out: str = "server") -> DataFrame:
    """Adds the server that each request goes to: the one with the fewest unfinished, the first of equals. Requests of a key are taken by at, then
    by order; a server's requests run at once, so it is free of one at its own end."""

    def step(s: list[list[float]], when: float, lasts: float) -> tuple:
        for ends in s:
            while ends and ends[0] <= when:
                heappop(ends)
        pick = min(range(servers), key=lambda j: (len(s[j]), j))
        heappush(s[pick], when + lasts)
        return s, pick

    return keyed_scan(requests, [key], [at, *order], [at, seconds], lambda: [[] for _ in range(servers)], step, f"{out} int")


def token_bucket(events: Column, rate: float, burst: float) -> Column:
    """As let_through(), for short arrays (its fold copies what it has so far at each step). events: ordered array<struct<at (seconds), cost>> -> array of when each is let through: a bucket of `burst` that
    fills by `rate` a second; an event waits until its cost is there, in turn."""
    init = F.struct(F.lit(float(burst)).alias("level"), F.lit(0.0).alias("now"), F.lit(True).alias("first"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(s: Column, e: Column) -> Column:
        at = F.when(s["first"], e["at"]).otherwise(F.greatest(e["at"], s["now"]))
        level = F.when(s["first"], F.lit(float(burst))).otherwise(F.least(F.lit(float(burst)), s["level"] + (at - s["now"]) * rate))
        wait = F.greatest((e["cost"] - level) / rate, F.lit(0.0))
        return F.struct((level + wait * rate - e["cost"]).alias("level"), (at + wait).alias("now"), F.lit(False).alias("first"), F.concat(s["out"], F.array(at + wait)).alias("out"))

    return F.aggregate(events, init, step, lambda s: s["out"])


def least_loaded(durations: Column, servers: int) -> Column:
    """As routed(), for short arrays. Ordered array of (at, seconds) -> the server that each goes to: the one with the fewest unfinished, the first of
    equals."""
    init = F.struct(F.expr("cast(array() as array<struct<server: int, done: double>>)").alias("open"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(s: Column, e: Column) -> Column:
        alive = F.filter(s["open"], lambda o: o["done"] > e["at"])
        loads = F.transform(F.sequence(F.lit(0), F.lit(servers - 1)), lambda j: F.struct(F.size(F.filter(alive, lambda o: o["server"] == j)).alias("n"), j.alias("j")))
        pick = F.array_min(loads)["j"].cast("int")
        return F.struct(F.concat(alive, F.array(F.struct(pick.alias("server"), (e["at"] + e["seconds"]).cast("double").alias("done")))).alias("open"), F.concat(s["out"], F.array(pick)).alias("out"))

    return F.aggregate(durations, init, step, lambda s: s["out"])


def backoff(attempt: Column, base: float = 2.0, most: float = 30.0) -> Column:
    """Seconds before another attempt."""
    return F.least(F.lit(base) ** attempt, F.lit(most))


def partial_rollouts(segments: DataFrame) -> DataFrame:
    """segments (sample_id, version, cancelled) -> (sample_id, start_version, end_version, is_partial): a sample that was
    cancelled goes on under later versions."""
    return segments.groupBy("sample_id").agg(
        F.min("version").alias("start_version"), F.max("version").alias("end_version"), (F.max("version") > F.min("version")).alias("is_partial")
    )


def staleness_counter(active: Column, cancelled: Column, queued: Column) -> Column:
    """What counts against the limit right after the parameters were updated."""
    return active + cancelled + queued
