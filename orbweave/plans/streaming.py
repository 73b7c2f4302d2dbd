"""Queries over streams; each stream reads what is there and ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query, table
from ..operators.lineage import shared_folder
from ..streaming import alarms, timers
from .common import SERIES


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(f"SELECT u AS user_id, min(CASE WHEN h = 3 THEN i END) AS fire FROM (SELECT u, i, sum(CASE WHEN v > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS h FROM {SERIES}) GROUP BY u HAVING fire IS NOT NULL")
def stream_k_run_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful alarm over a stream of events, against the batch rule."""
    out = _folder(spark)
    fired = alarms.first_alarms(_events(spark, sf_dir), "user_id", "ts", "event_id", "value", 60.0, 3)
    fired.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(fired.schema).parquet(f"{out}/rows").select("user_id", "fire")


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over a stream of events."""
    rows = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return alarms.completed(alarms.window_counts(rows, "ts", "6 hours", ["event_type"], "value"), _folder(spark)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, sum(CASE WHEN ts - p < INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions over a stream of events."""
    rows = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return alarms.completed(alarms.sessions(rows, "ts", "6 hours", ["user_id"]), _folder(spark)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 3 DAY THEN 0 ELSE 1 END AS new FROM events WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 2 DAY WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e), h AS (SELECT *, row_number() OVER x AS i, sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) OVER (x ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS above FROM s WINDOW x AS (PARTITION BY user_id, session ORDER BY ts, event_id))
SELECT user_id, min(i) AS fire, arg_min(ts, i) AS at FROM h WHERE above = 3 GROUP BY user_id, session""")
def stream_alarm_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms of a stream whose rows may come two days late, of all that the watermark has passed at its end; series silent for three days start anew."""
    out = _folder(spark)
    fired = timers.ordered_alarms(_events(spark, sf_dir), "user_id", "ts", "event_id", "value", 60.0, 3, "2 days", 3 * 86400.0)
    with timers.rocksdb(spark):
        started = fired.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        started.awaitTermination()
    return spark.read.schema(fired.schema).parquet(f"{out}/rows").select("user_id", "fire", "at")
