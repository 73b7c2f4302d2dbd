"""Grades of two sensors over points: what neighbours and the other sensor bear out. Points have k, x, y and g (0 normal, 1 watch, 2 danger)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import grades as G
from . import tiles


def fused(one: DataFrame, two: DataFrame, near: float, reach: float, least: int = 2) -> DataFrame:
    """Per point of the first sensor: final grade, hotspot (at least `least` elevated ones within near, itself among them), rescue (an elevated one of the other sensor within reach), void (the other sees nothing there), agreement.

    An elevated grade stands if either holds, and is then the worse of both sensors; else it is 0.
    """
    whole = lambda c: F.col(c).cast("long").alias(c)
    up = tiles.within(one, one, near, {"near": F.count_if(F.col("g") > 0)})
    around = tiles.at_place(one.select("k", "x", "y"), up, ("x", "y")).groupBy("k").agg(F.sum("near").alias("near")).select("k", whole("near"))
    seen = tiles.within(one, two, reach, {"n_ps": F.count(F.lit(1))}, {"ps": F.max("g")})
    other = tiles.at_place(one.select("k", "x", "y"), seen, ("x", "y")).groupBy("k").agg(F.max("ps").alias("ps"), F.sum("n_ps").alias("n_ps")).select("k", F.col("ps").cast(two.schema["g"].dataType).alias("ps"), whole("n_ps"))
    both = one.join(around, "k").join(other, "k", "left").select("k", "g", "near", F.coalesce("ps", F.lit(0)).alias("ps"), F.coalesce("n_ps", F.lit(0)).alias("n_ps"))
    hotspot, rescue = (F.col("g") > 0) & (F.col("near") >= least), (F.col("g") > 0) & (F.col("ps") > 0)
    agreement = F.when(F.col("n_ps") == 0, F.lit("③")).when((F.col("g") > 0) == (F.col("ps") > 0), F.lit("①")).otherwise(F.lit("②"))
    return both.select("k", F.when(hotspot | rescue, G.worst("g", "ps")).otherwise(0).alias("final"), hotspot.alias("hotspot"), rescue.alias("rescue"), (F.col("n_ps") == 0).alias("void"), agreement.alias("agreement"))


def accepted(points: DataFrame, near: float) -> DataFrame:
    """Per point whether its grade is accepted by itself (standalone), with another elevated one within near (neighbour), or with three of which one is danger, unless it is itself (cluster)."""
    seen = tiles.within(points, points, near, {"near": F.count_if(F.col("g") > 0), "near2": F.count_if(F.col("g") == 2)})
    every = tiles.at_place(points.select("k", "g", "x", "y"), seen, ("x", "y")).groupBy("k", "g").agg(F.sum("near").alias("_near"), F.sum("near2").alias("_near2"))
    # What rows of the same key (a point itself) add to that is taken off again.
    twin = points.select("k", F.col("g").alias("_g"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    own = points.select("k", "g", "x", "y").join(twin, "k").filter(dx * dx + dy * dy <= near * near).groupBy("k", "g").agg(F.count_if(F.col("_g") > 0).alias("_own"), F.count_if(F.col("_g") == 2).alias("_own2"))
    around = every.join(own, every["k"].eqNullSafe(own["k"]) & every["g"].eqNullSafe(own["g"]), "left").select(
        every["k"], every["g"], (F.col("_near") - F.coalesce("_own", F.lit(0))).cast("long").alias("near"), (F.col("_near2") - F.coalesce("_own2", F.lit(0))).cast("long").alias("near2"))
    up = F.col("g") > 0
    return around.select("k", up.alias("standalone"), (up & (F.col("near") >= 1)).alias("neighbour"), (up & (F.col("near") >= 3) & ((F.col("g") == 2) | (F.col("near2") >= 1))).alias("cluster"))
