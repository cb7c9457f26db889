"""Keyed state over a stream, in order of event time whatever the order of arrival, that is freed when a key is idle.

Rows wait in their key's state until the watermark passes them. A timer then folds those that are due, in order of time and id, into the key's
memory, which gives events. A key without rows for a while of event time forgets its memory, so that state is bounded by
the keys that are alive. The result is that of the same fold over sorted rows in a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: (memory or None, row as a dict) -> (memory, events as dicts). Rows have ts (milliseconds) and id besides the columns asked for.
Fold = Callable[[dict | None, dict], tuple[dict, list[dict]]]


class InOrder(StatefulProcessor):
    """Buffers rows until they are due, then folds them; see the module."""

    def __init__(self, fold: Fold, key: str, columns: list[str], idle_ms: int):
        self.fold, self.key, self.columns, self.idle_ms = fold, key, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.now, self.done = handle, None, set()
        self.waiting = handle.getListState("waiting", "row string")
        self.memory = handle.getValueState("memory", "memory string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = [{"ts": r["at"], "id": r["id"], **{c: r[c] for c in self.columns}} for r in rows]
        if found:
            self.waiting.appendList([(json.dumps(r),) for r in found])
            self.handle.registerTimer(max(r["ts"] for r in found) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        if now != self.now:
            self.now, self.done = now, set()
        # a key's first timer of a batch folds all that is due, so that its others find nothing to do
        if key in self.done:
            return
        self.done.add(key)
        waiting = [json.loads(row[0]) for row in self.waiting.get()]
        due = sorted((r for r in waiting if r["ts"] < now), key=lambda r: (r["ts"], r["id"]))
        memory = self.memory.get()
        memory = json.loads(memory[0]) if memory is not None else None
        out = []
        for row in due:
            if memory is not None and row["ts"] - memory["at"] >= self.idle_ms:
                memory = None
            memory, events = self.fold(memory, row)
            memory["at"] = row["ts"]
            out += events
        later = [(json.dumps(r),) for r in waiting if r["ts"] >= now]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if memory is not None and memory["at"] + self.idle_ms <= now:
            self.memory.clear()
        elif memory is not None and due:
            self.memory.update((json.dumps(memory),))
            self.handle.registerTimer(memory["at"] + self.idle_ms)
        yield from (Row(**{self.key: key[0]}, **event) for event in out)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, columns: list[str], schema: str, fold: Fold, times: list[str], idle: str = "7 days", late: str = "1 day") -> DataFrame:
    """Events of a fold over each key's rows, which have ts and id; ``schema`` is that of the events, after the key.

    The fold has times in milliseconds; ``times`` names the columns of events that become timestamps. Rows later than ``late`` behind the newest are left out. Times are kept to the millisecond.
    """
    spark: SparkSession = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(key, "ts", F.unix_millis("ts").alias("at"), "id", *columns)
    kind = dict(timed.dtypes)[key]
    # keys have few rows each: as rows, not as a frame for each of them
    found = timed.groupBy(key).transformWithState(InOrder(fold, key, columns, idle_ms), f"{key} {kind}, {schema}", "Append", "eventTime")
    return found.withColumns({t: F.timestamp_millis(t) for t in times})


def silent(least: int = 3) -> Fold:
    """An event when a source has been empty ``least`` times in a row, once for each stretch."""

    def fold(memory: dict | None, row: dict) -> tuple[dict, list[dict]]:
        run = memory or {"n": 0, "first": 0}
        if not row["empty"]:
            return {"n": 0, "first": 0}, []
        first = run["first"] if run["n"] else row["ts"]
        n = run["n"] + 1
        return {"n": n, "first": first}, [{"ts": row["ts"], "id": row["id"], "first_ts": first}] if n == least else []

    return fold


def change_tick(kinds: list[str]) -> Fold:
    """An event whenever the newest time of a kind moves on, with the newest times of all."""

    def fold(memory: dict | None, row: dict) -> tuple[dict, list[dict]]:
        known = {k: (memory or {}).get(k) for k in kinds}
        if row["kind"] not in kinds or row["value"] is None or (known[row["kind"]] is not None and row["value"] <= known[row["kind"]]):
            return known, []
        known[row["kind"]] = row["value"]
        return known, [{"ts": row["ts"], "id": row["id"], **known}]

    return fold
