"""Keyed state: out-of-order rows, batches, idle keys and restarts against the same fold over sorted rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge.shared import shared_folder
from tallyforge.streaming import jobs, states

START = datetime(2024, 5, 1)
SCHEMA = "source long, ts timestamp, id long, empty boolean, kind string, value long"


def story(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        at = START + timedelta(minutes=rng.randrange(60 * 24 * 6), milliseconds=rng.randrange(1000))
        rows.append((rng.randrange(6), at, i, rng.random() < 0.6, rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randrange(100)])))
    rows += [(9, START, 1000 + i, True, "a", i) for i in range(7)]
    return rows


def by_hand(rows, fold, idle):
    out, memory = [], {}
    for source, ts, i, empty, kind, value in sorted(rows, key=lambda r: (r[1], r[2])):
        ms = int((ts - datetime(1970, 1, 1)) / timedelta(milliseconds=1))
        known = memory.get(source)
        if known is not None and ms - known["at"] >= idle * 3_600_000:
            known = None
        known, events = fold(known, {"ts": ms, "id": i, "empty": empty, "kind": kind, "value": value})
        known["at"] = ms
        memory[source] = known
        out += [(source, *e.values()) for e in events]
    return sorted(out, key=str)


def streamed(spark, rows, fold, schema, idle, parts):
    path = shared_folder(spark, "state")
    jobs.arrivals(spark.createDataFrame(rows, SCHEMA), "ts", "source", f"{path}/in", chunks=parts, ids=("id",))
    out = states.in_order(jobs.read_parquet_stream(spark, f"{path}/in"), "source", ["empty", "kind", "value"], schema, fold, [], f"{idle} hours")
    return sorted((tuple(r) for r in jobs.drain(out, path).collect()), key=str)


@pytest.mark.parametrize(("idle", "parts"), [(1000, 3), (5, 4)])
def test_folds_in_order_of_time(spark, idle, parts):
    rows = story(idle)
    got = streamed(spark, rows, states.silent(), "ts long, id long, first_ts long", idle, parts)
    assert got == by_hand(rows, states.silent(), idle) and len(got) > 20
    tick = states.change_tick(["a", "b"])
    got = streamed(spark, rows, tick, "ts long, id long, a long, b long", idle, 2)
    assert got == by_hand(rows, tick, idle)


def test_silent_tells_once_for_each_stretch():
    fold, memory, told = states.silent(3), None, []
    for i, empty in enumerate([True, True, False, True, True, True, True, False, True]):
        memory, events = fold(memory, {"ts": i, "id": i, "empty": empty})
        told += [(e["ts"], e["first_ts"]) for e in events]
    assert told == [(5, 3)]


def test_state_is_freed_and_a_restart_goes_on(spark):
    path = shared_folder(spark, "state")
    folder = f"{path}/in"

    def add(*rows):
        spark.createDataFrame([(s, START + timedelta(hours=h), i, True, None, None) for s, h, i in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = states.in_order(jobs.read_parquet_stream(spark, folder), "source", ["empty"], "ts long, id long, first_ts long", states.silent(3), [], "10 hours", "1 hour")
        query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return [r.id for r in spark.read.parquet(f"{path}/out").collect()], query.lastProgress

    add((1, 0, 1), (1, 1, 2), (2, 0, 3))
    assert run()[0] == []
    # the third empty run in a row comes after a restart, and before rows that came earlier by time
    add((1, 2, 4), (2, 1, 5), (2, 0.5, 6))
    add((3, 6, 7))
    assert sorted(run()[0]) == [4, 5]
    add((4, 1000, 8))
    add((4, 1001, 9))
    told, progress = run()
    assert sorted(told) == [4, 5]
    # only what waits for the watermark and the last key's memory is left
    assert sum(o.numRowsTotal for o in progress.stateOperators) < 10
    gone = spark.read.format("statestore").option("stateVarName", "memory").load(f"{path}/checkpoint")
    assert {r.key.source for r in gone.collect()} <= {4}


def test_windows_are_written_when_they_are_over(spark):
    rows = story(5)
    path = shared_folder(spark, "state")
    jobs.arrivals(spark.createDataFrame(rows, SCHEMA), "ts", "source", f"{path}/in", ids=("id",))
    found = jobs.drain(jobs.windowed(jobs.read_parquet_stream(spark, f"{path}/in"), "ts", ["source"], "value", "1 day"), path)
    want = spark.createDataFrame(rows, SCHEMA).groupBy(F.window("ts", "1 day"), "source").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    key = lambda r: (r.window.start, r.source, r.n, r.total)
    assert sorted(map(key, found.collect())) == sorted(map(key, want.collect()))


def test_a_key_is_folded_once_a_batch_and_never_as_a_frame():
    """Several timers of a key that are due together read its state once; events are rows with the key's name."""
    from types import SimpleNamespace

    calls = []

    class Kept:
        def __init__(self, rows):
            self.rows = rows

        def get(self):
            calls.append("get")
            return iter(self.rows)

        def clear(self):
            self.rows = []

    class Memory(Kept):
        def get(self):
            return None

    job = states.InOrder(states.silent(1), "source", ["empty"], 10)
    job.init(SimpleNamespace(getListState=lambda *_: Kept([('{"ts": 3, "id": 2, "empty": true}',), ('{"ts": 1, "id": 1, "empty": true}',)]), getValueState=lambda *_: Memory([]), registerTimer=lambda _: None))
    at = lambda now: SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
    rows = [r for _ in range(3) for r in job.handleExpiredTimer((5,), at(100), None)]
    assert [r.asDict() for r in rows] == [{"source": 5, "ts": 1, "id": 1, "first_ts": 1}] and calls == ["get"]
    assert list(job.handleExpiredTimer((5,), at(200), None)) == [] and calls == ["get", "get"]
