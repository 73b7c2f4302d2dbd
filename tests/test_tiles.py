"""Points met tile by tile, against all pairs; crowds, ties, equal places and missing coordinates."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import cluster as C, fusion, joins as J, tiles as L


def spots(spark, n, seed, wide=100.0, whole=False, more=()):
    random = np.random.default_rng(seed)
    xy = random.uniform(-wide, wide, (n, 2)) if not whole else random.integers(-wide, wide, (n, 2)).astype(float)
    rows = [(k, float(x), float(y), int(random.integers(0, 3))) for k, (x, y) in enumerate(xy)] + list(more)
    return rows, spark.createDataFrame(rows, "k long, x double, y double, g int")


ODD = ((900, None, 1.0, 1), (901, float("nan"), 1.0, 2), (902, -0.0, 0.0, 2), (903, 0.0, 0.0, 1), (904, None, None, 0))


def real(rows):
    return [r for r in rows if r[1] is not None and r[2] is not None and not math.isnan(r[1])]


def inside(a, b, radius):
    return (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= radius * radius


@pytest.mark.parametrize("whole", [False, True])
def test_nearest_is_that_of_all_pairs(spark, whole):
    left, a = spots(spark, 300, 1, whole=whole, more=ODD)
    right, b = spots(spark, 80, 2, whole=whole, more=ODD)
    found = {r.k: (r._near, r.dist, r.g) for r in J.nearest(a.select("k", "x", "y"), b, "k", "k", 7.0, ["g"]).collect()}
    for p in left:
        want = min(((math.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2), q[0], q[3]) for q in real(right)), default=None) if real([p]) else None
        assert found[p[0]] == ((want[1], want[0], want[2]) if want else (None, None, None))


def test_of_points_as_near_the_smaller_key_is_nearest(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0)], "k long, x double, y double")
    right = spark.createDataFrame([(9, 1.0, 7.0), (5, -7.0, 1.0), (3, 5.0, 5.0), (4, -5.0, 5.0), (8, 90.0, 0.0)], "k long, x double, y double")
    assert J.nearest(left, right, "k", "k", 64.0).first()._near == 3


def test_nearest_in_a_crowd_makes_no_pairs(spark):
    crowd = spark.range(40_000).select(F.col("id").alias("k"), F.lit(5.0).alias("x"), F.lit(7.0).alias("y"))
    began = time.time()
    found = J.nearest(crowd, crowd, "k", "k", 64.0).groupBy("_near", "dist").count().collect()
    assert [(r._near, r.dist, r["count"]) for r in found] == [(0, 0.0, 40_000)] and time.time() - began < 40


def test_radius_sums_and_tops_are_those_of_all_pairs(spark):
    for whole in (False, True):
        left, a = spots(spark, 300, 3, whole=whole, more=ODD)
        right, b = spots(spark, 300, 4, whole=whole, more=ODD)
        found = {(r.x, r.y): (r.n, r.s, r.top) for r in L.within(a, b, 15.0, {"n": F.count(F.lit(1)), "s": F.sum("g")}, {"top": F.max("g")}).collect()}
        near = {(p[1], p[2]): [q[3] for q in real(right) if inside(p, q, 15.0)] for p in real(left)}
        assert found == {at: (len(g), sum(g), max(g)) for at, g in near.items() if g}


def test_radius_sums_of_a_crowd_make_no_pairs(spark):
    crowd = spark.range(40_000).select((F.col("id") % 4).cast("double").alias("x"), F.lit(7.0).alias("y"))
    began = time.time()
    assert {r.n for r in L.within(crowd, crowd, 25.0, {"n": F.count(F.lit(1))}).collect()} == {40_000.0} and time.time() - began < 40


def test_accepted_and_fused_are_those_of_all_pairs(spark):
    rows, a = spots(spark, 300, 5, whole=True, more=ODD[2:4])
    other, b = spots(spark, 40, 6, whole=True)
    accepted = {r.k: (r.standalone, r.neighbour, r.cluster) for r in fusion.accepted(a, 12.0).collect()}
    fused = {r.k: (r.final, r.hotspot, r.rescue, r.void) for r in fusion.fused(a, b, 12.0, 20.0).collect()}
    for p in rows:
        near = [q[3] for q in rows if q[0] != p[0] and inside(p, q, 12.0)]
        seen = [q[3] for q in other if inside(p, q, 20.0)]
        up, many = p[3] > 0, sum(g > 0 for g in near)
        assert accepted[p[0]] == (up, up and many >= 1, up and many >= 3 and (p[3] == 2 or 2 in near))
        hot, rescue = up and many + 1 >= 2, up and max(seen, default=0) > 0
        assert fused[p[0]] == (max(p[3], *seen, 0) if hot or rescue else 0, hot, rescue, not seen)


def test_acceptance_in_a_crowd_makes_no_pairs(spark):
    crowd = spark.range(40_000).select(F.col("id").alias("k"), F.lit(5.0).alias("x"), F.lit(7.0).alias("y"), F.lit(1).alias("g"))
    began = time.time()
    assert fusion.accepted(crowd, 30.0).filter("neighbour AND NOT cluster").count() == 40_000 and time.time() - began < 40


def clusters(rows, eps, least):
    near = {p[0]: [q[0] for q in rows if inside(p, q, eps)] for p in rows}
    core, label = {k for k, v in near.items() if len(v) >= least}, {}
    for k in sorted(core):
        todo = [k] if k not in label else []
        while todo:
            n = todo.pop()
            if n not in label:
                label[n] = k
                todo += [m for m in near[n] if m in core]
    return {k: label.get(k, min((label[m] for m in near[k] if m in core), default=None)) for k in near}


@pytest.mark.parametrize("whole", [False, True])
def test_clusters_are_those_of_all_pairs(spark, whole):
    for seed, eps, least in ((7, 7.0, 3), (8, 12.0, 6)):
        rows, a = spots(spark, 300, seed, whole=whole, more=ODD)
        want = clusters(real(rows), eps, least)
        assert {r.k: r.cluster for r in C.dbscan(a, "k", eps, least).collect()} == {r[0]: want.get(r[0]) for r in rows}


def test_a_crowd_is_one_cluster_without_pairs(spark):
    crowd = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") % 5).cast("double").alias("x"), F.lit(7.0).alias("y"))
    began = time.time()
    assert [(r.cluster, r["count"]) for r in C.dbscan(crowd, "k", 20.0, 3).groupBy("cluster").count().collect()] == [(0, 40_000)] and time.time() - began < 60


def test_first_polygon_is_that_of_all_pairs(spark):
    rows, a = spots(spark, 300, 9, more=ODD)
    random = np.random.default_rng(10)
    rings = [(n, [(float(x), float(y)) for x, y in random.uniform(-40, 40, (5, 2)) + random.uniform(-80, 80, (1, 2))]) for n in range(60)]
    b = spark.createDataFrame(rings, "p long, ring array<struct<x: double, y: double>>")
    pairs = a.select("k", "x", "y").crossJoin(b).filter(J.inside(F.col("ring"), F.col("x"), F.col("y"))).filter("x = x").groupBy("k").agg(F.min("p").alias("p"))
    want = {r.k: r.p for r in pairs.collect()}
    assert {r.k: r.p for r in J.polygon_first(a, b, "k", "ring", "p", ["p"], 25.0).collect()} == {r[0]: want.get(r[0]) for r in rows}


def test_a_crowd_under_many_polygons_makes_no_pairs(spark):
    crowd = spark.range(40_000).select(F.col("id").alias("k"), F.lit(5.0).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    rings = spark.range(10_000).select(F.col("id").alias("p"), F.array(at(-9.0, -9.0), at(9.0, -9.0), at(9.0, 9.0), at(-9.0, 9.0)).alias("ring"))
    began = time.time()
    assert J.polygon_first(crowd, rings, "k", "ring", "p", ["p"], 50.0).filter("p = 0").count() == 40_000 and time.time() - began < 40


def test_neighbours_around_a_walk_in_a_crowd(spark):
    steps = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"))
    holes = spark.range(40_000).select(F.col("id").alias("h"), (F.col("id") % 2 * 40).cast("double").alias("x"), F.lit(0.0).alias("y"))
    began = time.time()
    found = J.nearest(steps, holes, "k", "h", 50.0).groupBy("x", "_near", "dist").count().collect()
    assert {(r.x, r._near, r.dist) for r in found} == {(0.0, 0, 0.0), (1.0, 0, 1.0), (2.0, 0, 2.0)} and time.time() - began < 40


def test_reach_and_distance_from_events_in_a_crowd(spark):
    crowd = spark.range(40_000).select(F.col("id").alias("k"), F.when(F.col("id") % 1000 == 0, 31.0).otherwise(1.0).alias("x"), F.lit(0.0).alias("y"))
    events = spark.range(40_000).select(F.col("id").alias("k"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    began = time.time()
    assert J.nearest(crowd, events, "k", "k", 32.0, reach=30.0).filter("dist IS NULL AND _near IS NULL").count() == 40
    assert {r.k % 1000 for r in J.away_from(crowd, events, "k", 30.0, 100, 7).collect()} == {0} and time.time() - began < 60
