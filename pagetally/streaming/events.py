"""Event streams: batch forms for replay, and Structured Streaming forms of the same rules."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds between two progress events of a key, and a lease's life; tries after a failure, and the wait.
PROGRESS_SECONDS = 0.3
LEASE_SECONDS = 45
RETRIES = 2
RETRY_SECONDS = 0.5
Out = TypeVar("Out")


def _paced(seconds: int):
    """Rows sorted by key and time, streamed past one time a key: the last that was let through."""
    step = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, held = None, 0, None  # held: the key's latest event, if it was not let through
        for b in batches:
            users, ids = [], []
            for user, t, event in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None and user != key:
                    users.append(key)
                    ids.append(held)
                if user != key or t - last >= step:
                    key, last, held = user, t, None
                    users.append(user)
                    ids.append(event)
                else:
                    held = event
            yield pa.RecordBatch.from_arrays([pa.array(users, pa.int64()), pa.array(ids, pa.int64())], names=["user_id", "event_id"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([held], pa.int64())], names=["user_id", "event_id"])

    return run


def x05_rate_limit(s, seconds: int = 12 * 3600) -> DataFrame:
    """Events at least so long after the last one emitted for their key; a key's last one always. However many events a
    key has, a task holds one time and one event of it."""
    rows = s["events"].select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id").filter("user_id is not null")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInArrow(_paced(seconds), "user_id bigint, event_id bigint")


PACED = "user_id bigint, event_id bigint"


class Pacer(StatefulProcessor):
    """One time a key as state: that of the last event let through. Events wait until the watermark has passed them, so
    they are taken in order however they come; an event marked final is let through always."""

    def __init__(self, seconds: float):
        self.step = round(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = lambda *names: T.StructType([T.StructField(n, T.BooleanType() if n == "final" else T.LongType()) for n in names])
        self.handle, self.last, self.waiting = handle, handle.getValueState("last", kind("t")), handle.getListState("waiting", kind("t", "event_id", "final"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(t), int(i), bool(f)) for frame in rows for t, i, f in frame[["t", "event_id", "final"]].itertuples(index=False)]
        self.waiting.appendList(held)
        for ms in {t // 1000 + 1 for t, _, _ in held}:
            self.handle.registerTimer(ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, waiting = timerValues.getCurrentWatermarkInMs() * 1000, sorted({tuple(e) for e in self.waiting.get()})
        due, rest = [e for e in waiting if e[0] < now], [e for e in waiting if e[0] >= now]
        if not due:
            return
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for t, event, final in due:
            paced = last is None or t - last >= self.step
            if paced or final:
                out.append(event)
            last = t if paced else last
        self.last.update((last,))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame({"user_id": [int(key[0])] * len(out), "event_id": out})

    def close(self) -> None:
        pass


def paced_stream(events: DataFrame, seconds: float = PROGRESS_SECONDS, late: str = "1 minute") -> DataFrame:
    """Streaming `x05_rate_limit` of user_id, t (microseconds), event_id, final. It needs RocksDB's state store."""
    timed = events.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", late)
    return timed.groupBy("user_id").transformWithStateInPandas(Pacer(seconds), PACED, "Append", "EventTime")


def deduplicated(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Streaming: the first event of each key while the watermark keeps it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def lease_windows(stream: DataFrame, key: str, ts: str = "ts", seconds: int = LEASE_SECONDS, late: str = "5 minutes") -> DataFrame:
    """Streaming: leases as session windows; a lease ends when no heartbeat came for its life."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, f"{seconds} seconds").alias("lease"), key).agg(F.count("*").alias("beats"))


def retried(task: Callable[[], Out], times: int = RETRIES, wait: float = RETRY_SECONDS) -> Out:
    """A task's result, tried again after failures; the last failure is raised. (Tasks on executors: spark.task.maxFailures.)"""
    for left in range(times, -1, -1):
        try:
            return task()
        except Exception:
            if not left:
                raise
            time.sleep(wait)
    raise AssertionError


class Busy(RuntimeError):
    """Another batch runs."""


class BatchSlot:
    """At most one batch at a time, as a group of Spark jobs that can be cancelled."""

    def __init__(self, spark: SparkSession):
        self.spark, self.running, self._lock = spark, None, threading.Lock()

    @contextmanager
    def run(self, name: str):
        with self._lock:
            if self.running is not None:
                raise Busy(self.running)
            self.running = name
        try:
            self.spark.addTag(name)
            yield name
        finally:
            self.spark.removeTag(name)
            self.running = None

    def cancel(self) -> None:
        """Jobs of the running batch end; streaming queries are stopped by their own `stop`."""
        if self.running is not None:
            self.spark.interruptTag(self.running)


OPERATORS: dict[str, Callable] = {"x05_rate_limit": x05_rate_limit}
SQL: dict[str, str] = {
    # one step after the other
    "x05_rate_limit": """
        SELECT user_id, event_id FROM (WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM {events}),
          r AS (SELECT user_id, t, event_id, n, c, t AS last, true AS kept FROM e WHERE n = 1
            UNION ALL SELECT e.user_id, e.t, e.event_id, e.n, e.c, CASE WHEN e.t - r.last >= 43200000000 THEN e.t ELSE r.last END, e.t - r.last >= 43200000000 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
          SELECT * FROM r) AS x WHERE kept OR n = c""",
}
