"""Stand-ins for the relations of the operators, out of the tables: series of events, points on a plane, cells of a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..catalog import table

#: Series of events in SQL: u (series), i (epoch from 1), t (days), v (value).
SERIES = "(SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, (epoch_us(ts) - 1704067200000000) / 86400e6 AS t, value AS v, event_id FROM events)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 86400e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.row_number().over(w).cast("long").alias("i"), t.alias("t"), F.col("value").alias("v"), "event_id")


def points_sql(name: str, key: str) -> str:
    return f"(SELECT {key} AS k, ({key} * 37 % 1000)::DOUBLE AS x, ({key} * 91 % 1009)::DOUBLE AS y, * FROM {name})"


def points(spark: SparkSession, sf_dir: str, name: str, key: str, *keep: str) -> DataFrame:
    k = F.col(key)
    return table(spark, sf_dir, name).select(k.alias("k"), (k * 37 % 1000).cast("double").alias("x"), (k * 91 % 1009).cast("double").alias("y"), *keep)


#: Cells of a grid in SQL: r, c, v (mean quantity), w (mean discount).
GRID = "(SELECT l_partkey % 64 AS r, l_suppkey % 64 AS c, avg(l_quantity) AS v, avg(l_discount) AS w, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 64).alias("r"), (F.col("l_suppkey") % 64).alias("c"))
    return rows.agg(F.avg("l_quantity").alias("v"), F.avg("l_discount").alias("w"), F.count(F.lit(1)).alias("n"))
