"""Alarm rules over streams. The stateful alarm keeps its run length and place per series, so a stream fires where the batch rule does."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_alarms(stream: DataFrame, key: str, time: str, tie: str, value: str, threshold: float, k: int) -> DataFrame:
    """key, fire (place from 1) and at (time) once the first run of k values above the threshold is complete.

    stream: rows that come in order of time across micro-batches, as sensors send them; within a batch any order. Late rows need a watermark and a sort before.
    """

    def alarm(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, run, done = state.get if state.exists else (0, 0, False)
        out = []
        rows = pd.concat(list(frames)).sort_values([time, tie])
        for t, v in zip(rows[time], rows[value], strict=True):
            seen, run = seen + 1, run + 1 if v > threshold else 0
            if run >= k and not done:
                done = True
                out.append((group[0], seen, t))
        state.update((seen, run, done))
        yield pd.DataFrame(out, columns=[key, "fire", "at"])

    kinds: dict[str, Any] = dict(stream.dtypes)
    grouped = stream.select(key, time, tie, value).groupBy(key)
    return grouped.applyInPandasWithState(alarm, f"{key} {kinds[key]}, fire long, at {kinds[time]}", "seen long, run long, done boolean", "append", GroupStateTimeout.NoTimeout)


def window_counts(rows: DataFrame, time: str, width: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    """Counts and sums of tumbling windows, of a table or of a stream (with a watermark of `late`)."""
    rows = rows.withWatermark(time, late) if late else rows
    return rows.groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(rows: DataFrame, time: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """Sessions ended by a gap, of a table or of a stream."""
    rows = rows.withWatermark(time, late) if late else rows
    return rows.groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("session_window.start").alias("start"), "n")


def completed(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of aggregates over all that is there now, and gives their state at its end. Each batch writes a table of its own, so a repeated batch does no harm."""
    done: list[str] = []

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows-{number}")
        done.append(f"{folder}/rows-{number}")

    stream.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(done[-1]) if done else rows
