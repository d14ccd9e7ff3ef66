"""Keyed state in streams: processing stages of papers, and usage by model, as stateful processors.

The state lives in Spark's state store (RocksDB, in the checkpoint), so a micro-batch reads and
writes only the keys that it meets, a restart goes on where the last batch ended, and a lost executor
is replayed from the store's change log.  Each key emits one row in a batch that touches it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

STAGES = "paper string, stage string, attempts long, updated_at long, event_id long, n_events long, reason string"
USAGE = "model string, calls long, tokens long, repeated long"


@contextmanager
def rocks(spark: SparkSession):
    """The session with the state store that keyed state needs; the former setting comes back."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)


class StageProcessor(StatefulProcessor):
    """The newest stage of a paper by (ts, event_id) and the attempts so far, whatever order events come in.

    With ``limit`` (milliseconds of event time) a paper whose newest stage is processing fails as
    stalled once the watermark is that far behind it, unless another event comes first.
    """

    def __init__(self, limit: int | None = None):
        self.limit = limit

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "stage string, attempts long, ts long, event_id long, n_events long")

    def _row(self, key, state: tuple, reason: str | None) -> pd.DataFrame:
        stage, attempts, ts, event_id, n = state
        return pd.DataFrame({"paper": [key[0]], "stage": [stage], "attempts": [attempts], "updated_at": [ts], "event_id": [event_id], "n_events": [n], "reason": [reason]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stage, attempts, ts, event_id, n = self.now.get() if self.now.exists() else (None, 0, -(2**62), -(2**62), 0)
        for frame in rows:
            attempts += int((frame["stage"] == "processing").sum())
            n += len(frame)
            last = frame.sort_values(["us", "event_id"], kind="stable").iloc[-1]
            if (last["us"], last["event_id"]) >= (ts, event_id):
                stage, ts, event_id = last["stage"], int(last["us"]), int(last["event_id"])
        state = (stage, attempts, ts, event_id, n)
        self.now.update(state)
        if self.limit is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if stage == "processing":
                self.handle.registerTimer(ts // 1000 + self.limit)
        yield self._row(key, state, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stage, attempts, ts, event_id, n = self.now.get()
        if stage == "processing":
            state = ("failed", attempts, ts, event_id, n)
            self.now.update(state)
            yield self._row(key, state, "stalled")

    def close(self) -> None:
        pass


def stages(events: DataFrame, limit: int | None = None, late: str = "10 minutes") -> DataFrame:
    """Stream of ``STAGES`` rows from events (paper, stage, ts, event_id); the row of most events is a paper's present one."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if limit is not None:
        timed = timed.withWatermark("ts", late)
    rows = timed.select(F.col("paper").cast("string").alias("paper"), "stage", "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"))
    return rows.groupBy("paper").transformWithStateInPandas(StageProcessor(limit), STAGES, "Append", "None" if limit is None else "EventTime")


class UsageProcessor(StatefulProcessor):
    """Calls and tokens of a model, each call once: a call is remembered for ``keep`` milliseconds of event time."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "calls long, tokens long, repeated long")
        self.seen = handle.getMapState("seen", "call string", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls, tokens, repeated = self.totals.get() if self.totals.exists() else (0, 0, 0)
        first = None
        for frame in rows:
            for call, used, ms in zip(frame["call"], frame["tokens"], frame["ms"], strict=True):
                if self.seen.containsKey((call,)):
                    repeated += 1
                    continue
                self.seen.updateValue((call,), (int(ms),))
                first = int(ms) if first is None else min(first, int(ms))
                calls, tokens = calls + 1, tokens + int(used)
        self.totals.update((calls, tokens, repeated))
        if first is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(first + self.keep)
        yield pd.DataFrame({"model": [key[0]], "calls": [calls], "tokens": [tokens], "repeated": [repeated]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = expiredTimerInfo.getExpiryTimeInMs() - self.keep
        known = [(call[0], ms[0]) for call, ms in self.seen.iterator()]
        for call, ms in known:
            if ms <= old:
                self.seen.removeKey((call,))
        if left := [ms for _, ms in known if ms > old]:
            self.handle.registerTimer(min(left) + self.keep)
        yield from ()

    def close(self) -> None:
        pass


def usage(log: DataFrame, keep: int = 24 * 3600 * 1000, late: str = "10 minutes") -> DataFrame:
    """Stream of running ``USAGE`` totals from an append-only log (model, call, tokens, ts) that may repeat calls; null tokens are none."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select(F.col("model").cast("string").alias("model"), F.col("call").cast("string").alias("call"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("model").transformWithStateInPandas(UsageProcessor(keep), USAGE, "Append", "EventTime")


def run_to_end(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append what a stream emits to Parquet files until its present input is read."""
    with rocks(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()


def present(spark: SparkSession, target: str, schema: str, key: str, progress: str) -> DataFrame:
    """The row of each key that has come farthest."""
    rows = spark.read.schema(schema).parquet(target)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(progress, *(["reason"] if "reason" in rest else []))).alias("v")).select(key, "v.*")
