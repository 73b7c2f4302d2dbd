"""Runs of a condition along a series: persistence, first alarms and islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .series import upto


def held(flag: Column, by: Sequence[str], i: str, k: int) -> Column:
    """Whether the last k rows all meet the condition; nulls don't."""
    w = upto(by, i, k)
    return F.sum(F.when(flag, 1).otherwise(0)).over(w) == k


def first_fire(rows: DataFrame, by: Sequence[str], i: str, flag: Column, k: int, into: str = "fire") -> DataFrame:
    """One row per series: the place that completes the first run of k; null if none does."""
    return rows.withColumn("_h", held(flag, by, i, k)).groupBy(*by).agg(F.min(F.when(F.col("_h"), F.col(i))).alias(into))


def islands(rows: DataFrame, by: Sequence[str], i: str, flag: Column) -> DataFrame:
    """Runs of the condition: start, stop (places) and length."""
    on = rows.filter(flag).withColumn("_g", F.col(i) - F.row_number().over(Window.partitionBy(*by).orderBy(i)))
    return on.groupBy(*by, "_g").agg(F.min(i).alias("start"), F.max(i).alias("stop"), F.count(F.lit(1)).alias("length")).drop("_g")


def persist_max(rows: DataFrame, by: Sequence[str], i: str, v: str, k: int) -> DataFrame:
    """The largest value that k rows in a row reach; frames with a null don't count; the plain maximum of series shorter than k."""
    w = upto(by, i, k)
    low = F.when(F.count(v).over(w) == k, F.min(v).over(w))
    return rows.withColumn("_low", low).groupBy(*by).agg(F.when(F.count(F.lit(1)) < k, F.max(v)).otherwise(F.max("_low")).alias("persist"))


def records(rows: DataFrame, by: Sequence[str], i: str, v: str) -> DataFrame:
    """The last row of each series that exceeds all before it."""
    before = Window.partitionBy(*by).orderBy(i).rowsBetween(Window.unboundedPreceding, -1)
    top = rows.withColumn("_m", F.max(v).over(before)).filter(F.col("_m").isNull() | (F.col(v) > F.col("_m")))
    return top.groupBy(*by).agg(F.max(i).alias("record"))
