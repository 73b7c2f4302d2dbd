"""Alarms over streams whose rows come in any order: rows wait in state until the watermark has passed them, timers release them in order of time, and idle series leave the state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State with timers needs the RocksDB store; a stream takes the setting when it starts, so it is put back after that."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before is not None else spark.conf.unset(_PROVIDER)


class _Alarm(StatefulProcessor):
    def __init__(self, key: str, tie: str, threshold: float, k: int, idle_us: int) -> None:
        self.key, self.tie, self.threshold, self.k, self.idle_us = key, tie, threshold, k, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"us long, tie {self.tie}, v double")
        self.progress = handle.getValueState("progress", "seen long, run long, done boolean, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        self.waiting.appendList([(int(t), tie, float(v)) for t, tie, v in zip(batch["us"], batch["tie"], batch["v"], strict=True)])
        self._wake(int(batch["us"].min()))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        seen, run, done, last = self.progress.get() if self.progress.exists() else (0, 0, False, None)
        out = []
        for us, _, v in due:
            if last is not None and us - last > self.idle_us:
                seen, run, done = 0, 0, False
            seen, run, last = seen + 1, run + 1 if v > self.threshold else 0, us
            if run >= self.k and not done:
                done = True
                out.append((key[0], seen, us))
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        elif rows:
            self.waiting.clear()
        if not later and last is not None and now - last > self.idle_us:
            self.progress.clear()
        elif last is not None:
            if due:
                self.progress.update((seen, run, done, last))
            if not later:
                self._wake(last + self.idle_us + 1)
        yield pd.DataFrame(out, columns=[self.key, "fire", "us"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))


def ordered_alarms(stream: DataFrame, key: str, time: str, tie: str, value: str, threshold: float, k: int, late: str, idle: float) -> DataFrame:
    """key, fire (place in the series from 1) and at of the first run of k values above the threshold, whatever the order the rows come in.

    A row waits until a batch whose watermark, `late` behind the latest time of the batches before, has passed it; rows of such times in later batches are dropped by the stream, and so are those without time. Then rows count in order of time
    and tie, so the alarms are those of the same rules over a table. A series silent for more than `idle` seconds starts anew: places count from 1 and it may fire again; its state is dropped by a timer.
    A row without value breaks a run, like any that isn't above. State holds the rows of the last `late` and four numbers a series. Start the stream within rocksdb(spark).
    """
    kinds = dict(stream.dtypes)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    rows = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late).filter(F.col("_time").isNotNull())
    rows = rows.select(F.col(key).alias("_key"), "_time", us.alias("us"), F.col(tie).alias("tie"), F.coalesce(F.col(value).cast("double"), F.lit(float("-inf"))).alias("v"))
    processor = _Alarm(key, kinds[tie], threshold, k, int(idle * 1_000_000))
    fired = rows.groupBy("_key").transformWithStateInPandas(processor, f"{key} {kinds[key]}, fire long, us long", "append", "EventTime")
    return fired.select(key, "fire", F.timestamp_micros("us").cast(kinds[time]).alias("at"))
