"""Answers known by construction, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions import grades as G, scalar as S
from orbweave.operators import cluster as C, inversion as I, joins as J, raster as X, rules as U, runs as R, series as T, shapes as P, stats as A
from orbweave.sources import readers, writers
from orbweave.streaming import alarms


def line(spark, f, n=48, step=1 / 12, u="a"):
    return spark.createDataFrame([(u, k + 1, k * step, float(f(k * step))) for k in range(n)], "u string, i long, t double, v double")


def only(df):
    (row,) = df.collect()
    return row


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# series


def test_straight_line_has_its_velocity_and_no_trend(spark):
    rows = line(spark, lambda t: -6 * t)
    trend = only(T.two_segment(rows, ["u"], "i", "t", "v"))
    assert math.isclose(trend.early, 6) and math.isclose(trend.late, 6) and abs(trend.delta) < 1e-9
    assert only(T.inflection(rows, ["u"], "i", "t", "v")).v1 == pytest.approx(6)
    assert value(spark, G.velocity_grade(F.lit(6.0))) == 1
    net = only(T.robust_net(rows, ["u"], "i", "t", "v", 2.0))
    assert net.risk == pytest.approx(6 * (2.0 - 2 / 12), abs=0.6)


def test_broken_line(spark):
    rows = line(spark, lambda t: -2 * t if t < 2 else -4 - 10 * (t - 2))
    assert only(T.two_segment(rows, ["u"], "i", "t", "v")).delta == pytest.approx(8, abs=0.5)


def test_failure_time_is_recovered(spark):
    rows = line(spark, lambda t: 50 * math.log(1 - t / 5.0), n=50)
    found = only(T.inverse_velocity(rows, ["u"], "i", "t", "v", per_year=365.25))
    assert found.tf == pytest.approx(5.0, abs=0.1) and found.r2 > 0.98 and found.lead > 0


def test_whole_jumps_are_removed_and_others_kept(spark):
    jump = lambda size: line(spark, lambda t: -t + 0.3 * math.sin(9 * t) + (size if abs(t - 15 / 12) < 1e-9 else 0), n=30)
    big = T.unwrapped(jump(27.73), ["u"], "i", "v").filter("i = 16").first()
    assert big.fixed == pytest.approx(big.v - 27.73)
    small = T.unwrapped(jump(10.0), ["u"], "i", "v").filter("i = 16").first()
    assert small.fixed == small.v


def test_no_feature_looks_ahead(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([("a", k + 1, float(k), float(x)) for k, x in enumerate(rng.standard_normal(40))], "u string, i long, t double, v double")
    walk = lambda df: {r.i: r[4:] for r in T.derived(T.walk_forward(df, ["u"], "i", "t", "v", 10.0), ["u"], "i", "cum").orderBy("i").collect()}
    whole, cut = walk(rows), walk(rows.filter("i <= 25"))
    assert all(whole[i] == cut[i] for i in cut)


def test_edges_of_smoothing(spark):
    rows = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate([9, 1, 2, 3, 20], 1)], "u string, i long, v double")
    assert [r.s for r in T.smoothed(rows, ["u"], "i", "v").orderBy("i").collect()] == [2, 2.5, 3, 2.5, 3]
    assert [r.s for r in T.smoothed_replicated(rows, ["u"], "i", "v").orderBy("i").collect()] == [9, 3, 3, 3, 20]


def test_filling_by_place(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 2.0), ("a", 3, None), ("a", 4, 6.0), ("a", 5, None), ("b", 1, 5.0), ("b", 2, None)], "u string, i long, v double")
    assert [r.s for r in T.index_filled(rows, ["u"], "i", "v").orderBy("u", "i").collect()] == [2, 2, 4, 6, 6, 0, 0]


def test_seasonal_fit(spark):
    rows = line(spark, lambda t: 1 + 2 * t + 3 * math.cos(2 * math.pi * t) + 0.5 * math.sin(4 * math.pi * t))
    found = only(T.seasonal(rows, ["u"], "t", "v"))
    assert [round(x, 6) for x in found[1:]] == [1, 2, 3, 0.5]


def test_quadratic(spark):
    assert only(T.quadratic(line(spark, lambda t: 3 * t * t - t + 7), ["u"], "t", "v")).acceleration == pytest.approx(3)


def test_trends_by_each_method(spark):
    values = {"bent": [0.0] * 10 + [-3.0 * k for k in range(1, 11)], "flat": [0.0] * 20, "short": [0.0, -9.0, -20.0], "curve": [-0.2 * k * k + 0.01 * (-1) ** k for k in range(20)]}
    rows = spark.createDataFrame([(u, k + 1, float(k), v) for u, vs in values.items() for k, v in enumerate(vs)], "u string, i long, t double, v double")
    for method in T.TRENDS:
        found = {r.u: (r.grade, r.late) for r in T.trend_grades(rows, ["u"], "i", "t", "v", method, watch=1.0, danger=2.5, curve_min=0.3).collect()}
        assert found["flat"] == (0, 0) and found["short"] == (0, 0) and found["curve"][0] == 2 and found["bent"][0] >= (method != "quadratic") and found["curve"][1] > 4
    with pytest.raises(ValueError):
        T.trend_grades(rows, ["u"], "i", "t", "v", "other")


def test_twelve_features_are_those_of_each_prefix(spark):
    rng = np.random.default_rng(31)
    t = np.cumsum(rng.uniform(0.05, 0.3, 30))
    v = -np.cumsum(rng.uniform(-0.5, 2.0, 30)) - t**2
    alpha = 1.5
    rows = spark.createDataFrame([("a", k + 1, float(t[k]), float(v[k]), alpha) for k in range(30)], "u string, i long, t double, v double, alpha double")
    found = {r.i: r for r in T.walk_forward_bank(rows, ["u"], "i", "t", "v", "alpha").collect()}
    assert sorted(found) == list(range(8, 31))
    fall = lambda a, b: -np.polyfit(t[a:b], v[a:b], 1)[0]
    for n, r in found.items():
        now, since = t[n - 1], lambda span, n=n: int(np.searchsorted(t, t[n - 1] - span - 1e-12))
        want = {"cum1": v[since(1)] - v[n - 1], "cum2": v[since(2)] - v[n - 1], "cumF": v[0] - v[n - 1], "vel": fall(0, n), "dv": fall(n // 2, n) - fall(0, n // 2)}
        want |= {f"{c}a": want[c] / alpha for c in ("cum1", "cum2", "cumF", "vel")} | {"vtr": fall(since(1), n) if n - since(1) >= 4 else None}
        slopes = [(np.mean(t[e - 6 : e]), np.polyfit(t[e - 6 : e], v[e - 6 : e], 1)[0]) for e in range(6, n + 1)]
        last = [(c, -1 / s) for c, s in slopes if s < 0][-8:]
        if len(last) >= 3:
            a, b = np.polyfit(*zip(*last, strict=True), 1)
            want |= {"ivfrac": float(a < 0), "ivimm": -(-b / a - now) if a < 0 and -b / a > now else None}
        for c, x in want.items():
            assert (r[c] is None and x is None) or r[c] == pytest.approx(x, rel=1e-6, abs=1e-8), (n, c)
    both = T.buffer_bank(T.walk_forward_bank(rows.unionByName(rows.withColumn("u", F.lit("b")).withColumn("v", F.col("v") * 2)), ["u"], "i", "t", "v", "alpha").withColumn("w", F.lit(1)), ["w"], "i")
    assert {r.i: r.cumF for r in both.collect()} == pytest.approx({n: 2 * r.cumF for n, r in found.items()})


def test_masked_regression_and_consensus(spark):
    rng = np.random.default_rng(17)
    x, y, q = rng.uniform(0, 5, 200), rng.uniform(-3, 3, 200), rng.random(200)
    z = 4 + 2 * x - y + 0.5 * x * y + np.where(q < 0.4, 50, 0) + rng.normal(0, 0.1, 200)
    rows = spark.createDataFrame([("g", float(a), float(b), float(a * b), float(c), float(w)) for a, b, c, w in zip(x, y, z, q, strict=True)], "g string, x double, y double, xy double, z double, q double").repartition(3)
    found = only(I.masked_regression(rows, ["g"], "z", ["x", "y", "xy"], "q", 0.4))
    m = q >= 0.4
    assert found.n == m.sum() and np.allclose(found.coefficients, np.linalg.lstsq(np.column_stack([np.ones(200), x, y, x * y])[m], z[m], rcond=None)[0])
    points = [("a", k, float(k), 3.0 * k - 7) for k in range(40)] + [("a", 40 + k, float(k), float(rng.uniform(-200, 200))) for k in range(15)] + [("b", 0, 1.0, 1.0), ("b", 1, 1.0, 2.0)]
    line_ = spark.createDataFrame(points, "u string, k long, x double, y double")
    got = only(I.ransac_line(line_.repartition(5), ["u"], "k", "x", "y", 30, 0.5))
    assert (got.u, got.n) == ("a", 55) and got.inliers >= 40 and got.slope == pytest.approx(3, abs=0.01) and got.intercept == pytest.approx(-7, abs=0.2)
    again = only(I.ransac_line(line_.repartition(2), ["u"], "k", "x", "y", 30, 0.5))
    assert again.inliers == got.inliers and again.slope == pytest.approx(got.slope)


def test_huber_lines_and_greedy_matches(spark):
    data = [("a", float(k), 2.0 * k + 1 + (80.0 if k in (3, 17) else 0.01 * (-1) ** k)) for k in range(30)]
    found = only(I.robust_line(spark.createDataFrame(data, "u string, x double, y double"), ["u"], "x", "y"))
    assert found.slope == pytest.approx(2, abs=0.01) and found.intercept == pytest.approx(1, abs=0.1)
    pairs = [("i", 1, 7, 0.9, 0.6), ("i", 1, 8, 0.9, 0.8), ("i", 2, 8, 0.7, 0.9), ("i", 2, 7, 0.7, 0.55), ("i", 3, 7, 0.5, 0.7), ("i", 4, 9, 0.4, 0.3), ("j", 1, 7, 0.1, 0.5)]
    rows = spark.createDataFrame(pairs, "image string, pred long, ref long, score double, iou double")
    assert sorted((r.image, r.pred, r.ref) for r in P.greedy_matches(rows, ["image"], "score", "iou", 0.5).collect()) == [("i", 1, 8), ("i", 2, 7), ("j", 1, 7)]


def test_fuzzy_members_lie_on_both_sides(spark):
    values = [1.0] * 40 + [9.0] * 40 + [5.0] * 5 + [4.9, 0.0, 10.0]
    rows = spark.createDataFrame([("b", k, v) for k, v in enumerate(values)], "b string, k long, v double")
    threshold = only(X.otsu(rows, ["b"], "v")).threshold
    low, high = np.mean([v for v in values if v < threshold]), np.mean([v for v in values if v >= threshold])
    want = [1 - math.exp(-((v - (low + high) / 2) ** 2) / (2 * ((high - low) / 2) ** 2)) >= 0.9 for v in values]
    assert [r.member for r in X.fuzzy_otsu(rows, ["b"], "v").orderBy("k").collect()] == want
    wide = {r.v: r.member for r in X.fuzzy_otsu(rows.unionByName(spark.createDataFrame([("b", 99, -30.0)], "b string, k long, v double")), ["b"], "v").collect()}
    assert wide[-30.0] and not wide[5.0]


def test_class_baselines(spark):
    rows = spark.createDataFrame([("c", 1, 5.0), ("c", 1, 3.0), ("c", 2, 9.0), ("d", 1, 1.0)], "cell string, cls int, v double")
    assert sorted((r.cell, r.v, r.dry, r.n, r.rise) for r in X.class_baseline(rows, ["cell"], "cls", "v").collect()) == [("c", 3.0, 3.0, 2, 0.0), ("c", 5.0, 3.0, 2, 2.0), ("c", 9.0, 9.0, 1, 0.0), ("d", 1.0, 1.0, 1, 0.0)]


def test_exponential_means_skip_nulls(spark):
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate([1.0, None, 3.0, 5.0])], "u string, i long, v double")
    assert only(T.ewm(rows, ["u"], "i", "v", 0.5)).ewm == pytest.approx((5 + 3 * 0.5 + 1 * 0.125) / 1.625)


def test_greedy_passes_are_not_gap_sessions(spark):
    rows = spark.createDataFrame([("a", float(t)) for t in (0, 200, 400, 800)], "u string, t double")
    assert [r.t for r in T.greedy_passes(rows, ["u"], "t", 300.0).orderBy("t").collect()] == [0, 400, 800]


# runs


@pytest.mark.parametrize(("k", "fire"), [(2, 3), (3, 7), (4, None)])
def test_run_fires_where_it_completes(spark, k, fire):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([0, 1, 1, 0, 1, 1, 1], 1)], "u string, i long, v int")
    assert only(R.first_fire(rows, ["u"], "i", F.col("v") == 1, k)).fire == fire


def test_persistence(spark):
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate([5.0, None, 4.0, 6.0, 7.0, 1.0], 1)] + [("b", 1, 3.0)], "u string, i long, v double")
    found = {r.u: r.persist for r in R.persist_max(rows, ["u"], "i", "v", 3).collect()}
    assert found == {"a": 4.0, "b": 3.0}


def test_stream_fires_as_the_batch_rule(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(u), int(k), float(k), float(x)) for u in range(8) for k, x in enumerate(rng.random(30))]
    df = spark.createDataFrame(rows, "u long, e long, ts double, v double")
    for k in range(3):  # three micro-batches
        df.filter(f"e div 10 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fired = alarms.first_alarms(stream, "u", "ts", "e", "v", 0.5, 3)
    fired.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    found = {r.u: r.fire for r in spark.read.schema(fired.schema).parquet(str(tmp_path / "out")).collect()}
    batch = R.first_fire(df.withColumn("i", F.col("e") + 1), ["u"], "i", F.col("v") > 0.5, 3).filter("fire is not null")
    assert found == {r.u: r.fire for r in batch.collect()}


# joins


def test_boundaries_of_strata(spark):
    depths = spark.createDataFrame([(k, "h", d) for k, d in enumerate([0.0, 4.9, 5.0, 10.0, 11.0])], "k int, hole string, d double")
    strata = spark.createDataFrame([("h", 0.0, 5.0, "one"), ("h", 5.0, 10.0, "two")], "hole string, top double, bottom double, name string")
    found = J.interval_first(depths, strata, ["hole"], "d", "top", "bottom", "top", ["name"])
    assert [r.name for r in found.orderBy("k").collect()] == ["one", "one", "two", "two", None]


def test_pairs_across_cell_borders_and_nearest_of_all(spark):
    rng = np.random.default_rng(3)
    a = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-50, 50, (60, 2)))], "k int, x double, y double")
    b = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-300, 50, (20, 2)))], "k int, x double, y double")
    pa, pb = np.array([r[1:] for r in a.collect()]), np.array([r[1:] for r in b.collect()])
    d = np.hypot(*(pa[:, None] - pb[None]).transpose(2, 0, 1))
    assert J.radius_pairs(a, b, 30.0).count() == (d <= 30).sum()
    near = {r.k: (r._near, r.dist) for r in J.nearest(a, b, "k", "k", 1.0).collect()}
    assert all(near[k][0] == d[k].argmin() and math.isclose(near[k][1], d[k].min()) for k in range(60))
    reach = {r.k: r._near for r in J.nearest(a, b, "k", "k", 1.0, reach=10.0).collect()}
    assert all((reach[k] is None) == (d[k].min() > 10) for k in range(60))
    assert J.nearest(a, b.limit(0), "k", "k", 1.0).filter("_near is not null").count() == 0


def test_asof_sides(spark):
    left = spark.createDataFrame([("a", t) for t in (0.0, 5.0, 7.4, 20.0, None)], "u string, t double")
    right = spark.createDataFrame([("a", 1.0, 10), ("a", 5.0, 50), ("a", 10.0, 100)], "u string, s double, w int")
    found = {r.t: r.w for r in J.asof_nearest(left, right, ["u"], "t", "s", ["w"], 3.0).collect()}
    assert found == {0.0: 10, 5.0: 50, 7.4: 50, 20.0: None, None: None}
    later = {r.t: r.next for r in J.asof_forward(left, right, ["u"], "t", "s").collect()}
    assert later[0.0] == 1.0 and later[5.0] == 10.0 and later[20.0] is None
    between = {r.t: r.w for r in J.interpolated(left, right.withColumn("w", F.col("w").cast("double")), ["u"], "t", "s", "w", 2.5).collect()}
    assert between[5.0] == 50 and between[7.4] == pytest.approx(74) and between[0.0] == 10 and between[20.0] is None


def test_first_polygon(spark):
    square = lambda p, x: (p, [(x, 0.0), (x + 10, 0.0), (x + 10, 10.0), (x, 10.0)])
    shapes = spark.createDataFrame([square(2, 0.0), square(1, 5.0)], "p int, ring array<struct<x:double,y:double>>")
    at = spark.createDataFrame([(1, 1.0, 1.0), (2, 7.0, 1.0), (3, 14.0, 9.0), (4, 40.0, 1.0)], "k int, x double, y double")
    found = J.polygon_first(at, shapes, "k", "ring", "p", ["p"], 4.0)
    assert [r.p for r in found.orderBy("k").collect()] == [2, 1, 1, None]


RING = "array<struct<x:double,y:double>>"


def square(x, y, a, b):
    return [(float(x), float(y)), (float(x + a), float(y)), (float(x + a), float(y + b)), (float(x), float(y + b))]


def test_polygons_that_overlap_have_no_distance(spark):
    shapes = {"base": square(0, 0, 10, 10), "inside": square(4, 4, 2, 2), "crossing": square(8, 8, 10, 10), "cross": square(-5, 4, 20, 2), "touching": square(10, 2, 3, 3), "corner": square(13, 14, 2, 2), "same": square(0, 0, 10, 10)}
    rows = spark.createDataFrame(list(shapes.items()), f"k string, ring {RING}")
    found = {(r.k, r.other_k): r.d for r in P.distances(rows, rows, "k", "k", "ring", 8.0, 5.0).collect()}
    assert {k: found["base", k] for k in shapes if k != "base"} == {"inside": 0, "crossing": 0, "cross": 0, "touching": 0, "same": 0, "corner": 5}
    merged = {r.k: r.whole for r in P.merged(rows.withColumn("o", F.lit(1)), "k", "o", "ring", 0.5, 5.0).collect()}
    assert set(merged.values()) == {"base"} and P.merged(rows.withColumn("o", F.col("k")), "k", "o", "ring", 0.5, 5.0).select("whole").distinct().count() == len(shapes)


def test_rasters_and_rectangles_of_shapes(spark):
    rows = spark.createDataFrame([(1, [(0.0, 0.0), (6.0, 0.0), (0.0, 6.0)])], f"k long, ring {RING}")
    inside = {(r.r, r.c) for r in P.rasterized(rows, "k", "ring", 0.0, 1.0).collect()}
    assert inside == {(r, c) for r in range(6) for c in range(6) if r + c + 1 <= 6}
    assert {(r.r, r.c) for r in P.rasterized(rows, "k", "ring", 0.6, 1.0, closed=False).collect()} == {(r, c) for r in range(-1, 7) for c in range(-1, 7) if (-1 <= r <= 0 and -0.6 <= c + 0.5 <= 6.6 and abs(r + 0.5) <= 0.6 and 0 <= c + 0.5 <= 6) or abs(r + c + 1 - 6) / math.sqrt(2) <= 0.6 and r >= 0 and c >= 0} | {(r, c) for r in (-1, 0) for c in (-1, 6) if math.hypot(c + 0.5 - (0 if c < 0 else 6), r + 0.5) <= 0.6}
    turned = [(x * math.cos(0.3) - y * math.sin(0.3), x * math.sin(0.3) + y * math.cos(0.3)) for x, y in [(0, 0), (8, 0), (8, 3), (4, 3), (0, 3)]]
    box = only(spark.createDataFrame([(turned,)], f"ring {RING}").select(P.rotated_box(F.col("ring")).alias("b"))).b
    assert (box.long, box.short, box.angle) == (pytest.approx(8), pytest.approx(3), pytest.approx(0.3))


def test_clipped_areas_and_attribution(spark):
    pairs = [(square(0, 0, 10, 10), square(5, 5, 10, 10), 25.0), (square(0, 0, 10, 10), square(2, 2, 3, 3), 9.0), (square(0, 0, 2, 2), square(5, 5, 1, 1), 0.0), ([(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)], square(0, 0, 2, 2)[::-1], 4.0), ([(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (3.0, 1.0), (0.0, 6.0)], square(0, 0, 6, 1), 6.0)]
    rows = spark.createDataFrame(pairs, f"a {RING}, b {RING}, want double")
    assert all(r.found == pytest.approx(r.want) for r in rows.select("want", P.area(P.clipped(F.col("a"), F.col("b"))).alias("found")).collect())
    buildings = spark.createDataFrame([(1, square(3, 3, 4, 4)), (2, square(90, 90, 4, 4)), (3, square(8, 1, 4, 4))], f"k long, ring {RING}")
    parcels = spark.createDataFrame([(10 * x + y, square(5 * x, 5 * y, 5, 5)) for x in range(3) for y in range(3)], f"p long, ring {RING}")
    assert sorted((r.k, r.p, r.share) for r in P.attributed(buildings, parcels, "k", "p", "ring", 7.0).collect() if r.p is not None) == [(1, 0, pytest.approx(0.25)), (3, 10, pytest.approx(0.5))]
    assert P.attributed(buildings, parcels, "k", "p", "ring", 7.0).filter("k = 2").first().p is None


# statistics


def test_auc_and_midrank(spark):
    rows = spark.createDataFrame([("g", 3, True), ("g", 2, True), ("g", 2, True), ("g", 2, False), ("g", 1, False)], "g string, s int, p boolean")
    assert only(A.auc(rows, ["g"], "s", "p")).auc == pytest.approx(5 / 6)
    background = spark.createDataFrame([("g", v) for v in (1, 2, 2, 3)], "g string, s int")
    assert only(A.midrank_share(spark.createDataFrame([("g", 2)], "g string, s int"), background, ["g"], "s")).share == 0.5


def test_concordance_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    data = [(f"g{g}", float(x), float(y)) for g in range(4) for x, y in zip(rng.integers(0, 12, 5 + 20 * g), rng.integers(0, 8, 5 + 20 * g), strict=True)] + [("one", 1.0, 1.0), ("g1", None, 2.0)]
    found = {r.g: r for r in A.kendall(spark.createDataFrame(data, "g string, x double, y double").repartition(3), ["g"], "x", "y").collect()}
    for g in ("g0", "g1", "g2", "g3"):
        own = [(x, y) for k, x, y in data if k == g and x is not None]
        signs = [(np.sign(b[0] - a[0]), np.sign(b[1] - a[1])) for k, a in enumerate(own) for b in own[k + 1 :]]
        s = sum(p * q for p, q in signs)
        assert (found[g].n, found[g].s) == (len(own), s) and found[g].tau == pytest.approx(s / len(signs))
        assert found[g].tau_b == pytest.approx(s / math.sqrt(sum(p != 0 for p, _ in signs) * sum(q != 0 for _, q in signs)))
    assert found["one"].s == 0 and found["one"].tau is None


def test_mann_kendall_with_equal_values(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9]
    found = only(A.mann_kendall(spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(values)], "u string, i long, v double"), ["u"], "i", "v"))
    s = sum(np.sign(b - a) for k, a in enumerate(values) for b in values[k + 1 :])
    tied = [values.count(v) for v in set(values)]
    var = (15 * 14 * 35 - sum(m * (m - 1) * (2 * m + 5) for m in tied)) / 18
    z = (s - np.sign(s)) / math.sqrt(var)
    assert (found.s, found.variance, found.z) == (s, pytest.approx(var), pytest.approx(z)) and found.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)


def test_plane_and_trend_statistics(spark):
    rows = spark.createDataFrame([("g", float(x), float(y), 2.0 * x - 3.0 * y + 1) for x in range(4) for y in range(5)], "g string, x double, y double, z double")
    assert [round(v, 9) for v in only(A.plane(rows, ["g"], "x", "y", "z"))[1:]] == [2, -3, 1]
    up = line(spark, lambda t: 5 * t, n=10)
    assert only(A.theil_sen(up, ["u"], "t", "v")).slope == pytest.approx(5)
    assert only(A.mann_kendall(up, ["u"], "i", "v")).s == 45


def test_trimming(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(10)] + [("b", 1.0), ("b", 5.0)], "g string, v double")
    assert {r.g: r.v for r in A.trimmed_mean(rows, ["g"], "v").collect()} == {"a": 3.5, "b": 3.0}


# grades


@pytest.mark.parametrize(("measured", "level"), [(129.0, "이상없음"), (130.0, "주의"), (184.0, "주의"), (185.0, "경고")])
def test_ledger(spark, measured, level):
    assert value(spark, G.ledger_level(F.lit(100.0), F.lit(measured))) == level


@pytest.mark.parametrize(("distance", "level"), [(9.9, "경고"), (10.0, "주의"), (11.2, "주의"), (11.3, "이상없음")])
def test_separation_with_unknown_floors(spark, distance, level):
    assert value(spark, G.separation_level(F.lit(distance), F.lit(None).cast("int"))) == level


def test_a_lower_alpha_never_lowers_a_grade(spark):
    rows = spark.range(400).select((F.col("id") / 8).alias("v"))
    worse = rows.filter(G.velocity_grade(F.col("v"), 0.6) < G.velocity_grade(F.col("v"), 1.0))
    assert worse.count() == 0
    assert value(spark, G.velocity_grade(F.lit(None).cast("double"))) == 0


# clusters and rasters


def test_two_blobs_and_strays(spark):
    blob = [(k, 10.0 * (k % 3), 10.0 * (k // 3)) for k in range(5)] + [(10 + k, 1000 + 10.0 * k, 0.0) for k in range(5)]
    rows = spark.createDataFrame([*blob, (90, 500.0, 500.0), (91, -900.0, 0.0), (92, 0.0, 900.0)], "k long, x double, y double")
    found = {r.k: r.cluster for r in C.dbscan(rows, "k", 100.0, 5).collect()}
    assert {found[k] for k in range(5)} == {0} and {found[k] for k in range(10, 15)} == {10} and {found[k] for k in (90, 91, 92)} == {None}


def test_components_of_cells(spark):
    cells = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (2, 3), (9, 9)], "r long, c long")
    assert {r["size"] for r in C.cell_components(cells, 100).collect()} == {4, 1}
    assert sorted(r["size"] for r in C.cell_components(cells, 100, diagonal=False).collect()) == [1, 1, 1, 2, 2]
    assert C.cell_components(cells, 100, True, 2).count() == 4


def test_otsu_between_two_modes(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(-22, 1, 100), rng.normal(-8, 1, 100)])
    cells = spark.createDataFrame([("a", k // 20, k % 20, float(x)) for k, x in enumerate(v)], "g string, r long, c long, v double")
    assert -20 < only(X.otsu(cells, ["g"], "v")).threshold < -10
    assert only(X.edge_otsu(cells, ["g"], "v", -15.0)).threshold < -8
    flat = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 1.0)], "g string, r long, c long, v double")
    assert only(X.otsu(flat, ["g"], "v")).threshold is None


def test_change_codes(spark):
    before = spark.createDataFrame([(0, 0, True), (0, 1, False), (0, 2, True)], "r long, c long, m boolean")
    after = spark.createDataFrame([(0, 0, True), (0, 1, True), (0, 3, True)], "r long, c long, m boolean")
    assert {(r.c, r.code) for r in X.change_codes(before, after, "m").collect()} == {(0, 0), (1, 1), (2, 2), (3, 1)}


# rules


def test_rules_fire_and_score(spark):
    rows = [("A1", "A", 6.0, k, float(k), "f", float(v)) for k, v in enumerate([0, 0, 5, 5, 5, 5], 1)] + [("B1", "B", None, k, float(k), "f", float(v)) for k, v in enumerate([5, 0, 5, 0, 5, 0], 1)]
    features = spark.createDataFrame(rows, "unit string, kind string, t_acc double, i long, t double, feature string, value double")
    rules = spark.createDataFrame([("one", 1, "f", 4.0), ("two", 2, "f", 4.0)], "rule string, k int, feature string, threshold double")
    found = {r.rule: (r.det, r.med, r.bg) for r in U.scores(U.fires(features, rules)).collect()}
    assert found == {"one": (1.0, 3.0, 1.0), "two": (1.0, 2.0, 0.0)}
    assert {r.rule: r.j for r in U.scores(U.fires(features, rules)).collect()} == pytest.approx({"one": 3 / 365.25 + 2, "two": 2 / 365.25})
    assert [r.rule for r in U.pareto(U.scores(U.fires(features, rules))).collect()] == ["two"]  # shorter lead, less background


def test_pareto_prefers_short_leads(spark):
    rng = np.random.default_rng(4)
    rows = [(f"r{k}", float(d), float(m), float(b)) for k, (d, m, b) in enumerate(zip(rng.integers(0, 6, 80) / 5, rng.integers(1, 9, 80) * 30.0, rng.integers(0, 6, 80) / 5, strict=True))]
    rows += [("long", 1.0, 900.0, 0.0), ("short", 1.0, 30.0, 0.0), ("same", 1.0, 30.0, 0.0), ("never", 0.0, None, 0.0)]
    found = {r.rule for r in U.pareto(spark.createDataFrame(rows, "rule string, det double, med double, bg double")).collect()}
    beats = lambda o, r: o[1] >= r[1] and o[2] <= r[2] and o[3] <= r[3] and o[1:] != r[1:]
    known = [r for r in rows if r[2] is not None]
    assert found == {r[0] for r in known if not any(beats(o, r) for o in known)} and {"short", "same"} <= found and "long" not in found


def brute_rule(units, conditions, k):
    """det, med, bg and j of one rule over units: name -> (kind, t_acc, {feature: values by epoch}); times are epochs."""
    leads, fired, n = [], 0, {"A": 0, "B": 0}
    for kind, t_acc, values in units.values():
        n[kind] += 1
        ok = [all(v is not None and v == v and v >= x for v, x in zip(row, [x for _, x in conditions], strict=True)) for row in zip(*[values[f] for f, _ in conditions], strict=True)]
        fire = next((i + 1 for i in range(len(ok)) if i + 1 >= k and all(ok[i + 1 - k : i + 1])), None)
        if fire is not None and kind == "B":
            fired += 1
        if fire is not None and kind == "A" and fire <= t_acc:
            leads.append(t_acc - fire)
    med = float(np.median(leads)) if leads else None
    bg = fired / max(1, n["B"])
    return len(leads) / max(1, n["A"]), med, bg, (99 if med is None else med / 365.25) + 2 * bg


def test_staged_search_is_that_of_every_rule(spark):
    rng = np.random.default_rng(12)
    names, ks, floor = ["f", "g", "h"], (1, 2, 3), 0.6
    units = {f"u{n}": (("A", 18) if n < 6 else ("B", None)) + ({f: [None if rng.random() < 0.05 else float(x) for x in rng.integers(0, 9, 18) + (2 * (n < 6) * (np.arange(18) > 9))] for f in names},) for n in range(14)}
    rows = [(u, kind, None if t is None else float(t), i, float(i), f, v) for u, (kind, t, values) in units.items() for f in names for i, v in enumerate(values[f], 1)]
    features = spark.createDataFrame(rows, "unit string, kind string, t_acc double, i long, t double, feature string, value double")
    grid = {f: [3.0, 5.0, 7.0] for f in names}
    table = spark.createDataFrame([(f, x) for f, xs in grid.items() for x in xs], "feature string, threshold double")
    tried = {((f, x),): None for f in names for x in grid[f]}
    key = lambda item: (round(item[1][3], 9), len(item[0][0]), item[0])
    scored = {(c, k): brute_rule(units, c, k) for c in tried for k in ks}
    ranked = sorted((round(v[3], 9) if v[0] >= floor else 999, c[0][0]) for (c, _), v in scored.items())[:8]
    top = sorted(dict.fromkeys(f for _, f in ranked))
    scored |= {(((a, x), (b, y)), k): brute_rule(units, ((a, x), (b, y)), k) for a in top for b in top if a < b for x in grid[a] for y in grid[b] for k in ks}
    best = min(((c, v) for c, v in scored.items() if v[0] >= floor), key=key)
    if len(best[0][0]) == 2:
        base = best[0][0]
        scored |= {((*base, (f, x)), k): brute_rule(units, (*base, (f, x)), k) for f in names if f not in [b[0] for b in base] for x in grid[f] for k in ks}
    want = {c: v for c, v in scored.items() if v[0] >= floor}
    found = U.searched(features, table, table, ks, floor)
    got = {(tuple((c.feature, c.threshold) for c in r.conditions), r.k): (r.det, r.med, r.bg, r.j) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want) and len(want) > 20
    first = U.best_of(found).first()
    assert (tuple((c.feature, c.threshold) for c in first.conditions), first.k) == min(want.items(), key=key)[0]


def test_a_gap_ends_a_run_and_gates_keep_all_rules(spark, monkeypatch):
    rows = [("A1", "A", 9.0, k, float(k), "f", 5.0) for k in (1, 3, 4, 6, 7, 8)] + [("B1", "B", None, k, float(k), "f", float("nan")) for k in range(1, 9)]
    features = spark.createDataFrame(rows, "unit string, kind string, t_acc double, i long, t double, feature string, value double")
    rules = spark.createDataFrame([(f"r{k}", k, "f", 4.0) for k in (1, 2, 3, 4)], "rule string, k int, feature string, threshold double")
    assert {(r.rule, r.unit): r.fire for r in U.fires(features, rules).collect() if r.unit == "A1"} == {("r1", "A1"): 1, ("r2", "A1"): 4, ("r3", "A1"): 8, ("r4", "A1"): None}
    monkeypatch.setattr(U, "TOGETHER", 2)
    found = {(r.rule, r.unit): r.fire for r in U.gated(features, rules.filter("k = 2"), rules).collect()}
    assert found == {("r1", "A1"): 4, ("r2", "A1"): 7, ("r3", "A1"): 8, ("r4", "A1"): None} | {(f"r{k}", "B1"): None for k in (1, 2, 3, 4)}


def test_first_fire_rules_are_greedy_covers(spark):
    rng = np.random.default_rng(21)
    names = ["f", "g", "h"]
    units = {f"u{n}": {f: [None if rng.random() < 0.1 else float(x) for x in rng.integers(0, 6, 9)] for f in names} for n in range(12)}
    features = spark.createDataFrame([(u, i, f, v) for u, fs in units.items() for f in names for i, v in enumerate(fs[f])], "unit string, i long, feature string, value double")
    targets = {u: 8 if n else 0 for n, u in enumerate(units)}
    found = {}
    for r in U.first_fire_rules(features, spark.createDataFrame(list(targets.items()), "unit string, i long")).orderBy("unit", "step").collect():
        found.setdefault(r.unit, []).append((r.feature, r.threshold, r.left))
    for u, fs in units.items():
        j, rule = targets[u], []
        usable = [f for f in names if fs[f][j] is not None]
        left = set(range(j))
        if usable and not left:
            rule.append((usable[0], fs[usable[0]][j], 0))
        kills = {f: {i for i in left if fs[f][i] is None or fs[f][i] < fs[f][j]} for f in usable}
        while left and len(rule) < 3 and usable and max(len(kills[f] & left) for f in usable):
            f = min(usable, key=lambda f: (-len(kills[f] & left), f))
            left = left - kills[f]
            rule.append((f, fs[f][j], len(left)))
        assert found.get(u, []) == rule


def test_region_rules_and_knees(spark):
    rows = [("north", "early", "A", 100.0, 10.0), ("north", "late", "A", 100.0, 90.0), ("north", "early", "B", None, None), ("north", "late", "B", None, 5.0), ("south", "late", "A", 100.0, None), ("south", "early", "A", 100.0, 50.0)]
    fired = spark.createDataFrame(rows, "region string, rule string, kind string, t_acc double, fire double")
    found = {r.region: (r.rule, r.score) for r in U.best_by(fired, "region").collect()}
    assert found == {"north": ("early", pytest.approx(90 / 180)), "south": ("early", pytest.approx(50 / 180))}  # late: 10 / 180 + 100 / 30


def test_leave_one_out_refits_the_rule(spark):
    rng = np.random.default_rng(23)
    rows = []
    for r in range(8):
        rows += [(f"r{r}", f"a{n}", "A", 100.0, None if rng.random() < 0.25 else float(rng.integers(1, 120))) for n in range(7)] + [(f"r{r}", f"b{n}", "B", None, None if rng.random() < 0.6 else 5.0) for n in range(6)]
    found = {r.unit: (r.rule, r.fire, r.lead) for r in U.leave_one_out_rules(spark.createDataFrame(rows, "rule string, unit string, kind string, t_acc double, fire double"), 0.6).collect()}
    for n in range(7):
        best = None
        for r in range(8):
            leads = [100 - x[4] for x in rows if x[0] == f"r{r}" and x[2] == "A" and x[1] != f"a{n}" and x[4] is not None and x[4] <= 100]
            bg = np.mean([x[4] is not None for x in rows if x[0] == f"r{r}" and x[2] == "B"])
            if len(leads) / 6 >= 0.6:
                best = min(best or (99, ""), (round(np.median(leads) / 365.25 + 2 * bg, 9), f"r{r}"))
        own = next((x[4] for x in rows if best and x[0] == best[1] and x[1] == f"a{n}"), None)
        assert found[f"a{n}"] == ((best[1], own, 100 - own if own is not None and own <= 100 else None) if best else (None, None, None))


# scalar functions, readers and writers


def test_text_and_numbers(spark):
    assert value(spark, S.lot_number(F.lit("서울 역삼동 12-3번지"))) == "12-3"
    assert value(spark, S.lot_number(F.lit("서울 역삼동 12번지"))) == "12-0"
    assert value(spark, S.tolerant_number(F.lit("1,234.5 m"))) == 1234.5 and value(spark, S.tolerant_number(F.lit("n/a"))) is None
    assert value(spark, S.code_prefix(F.lit("sm： silty sand"))) == "SM"
    assert value(spark, S.nan_to_null(F.lit(float("nan")))) is None
    assert value(spark, S.soft_clip(F.lit(-20.0), 0.0, 100.0, 20.0)) == 0.0 and value(spark, S.soft_clip(F.lit(-20.1), 0.0, 100.0, 20.0)) is None


def test_legacy_encodings_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("이름,값\r서울,1\r부산,2\r".encode("cp949"))
    encoding = readers.encoding_of(spark, str(tmp_path / "a.csv"))
    assert encoding == "cp949"
    found = readers.csv(spark, str(tmp_path / "a.csv"), "`이름` string, `값` int", encoding, line_sep="\r").collect()
    assert [tuple(r) for r in found] == [("서울", 1), ("부산", 2)]


def test_features_and_grids(spark, tmp_path):
    shape = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]},"properties":{"name":"a","n":1}}]}'
    (tmp_path / "a.geojson").write_text(shape)
    row = only(readers.geojson(spark, str(tmp_path / "a.geojson")).select("kind", "props", S.polygon_area(readers.ring_of(F.col("coordinates"))).alias("area")))
    assert row.kind == "Polygon" and row.props == {"name": "a", "n": "1"} and row.area == 2.0
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n1 2\n-9999 4\n")
    assert [r.v for r in readers.ascii_grid(spark, str(tmp_path / "g.asc")).orderBy("r", "c").collect()] == [1, 2, None, 4]


def test_csv_out_and_in(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "k int, v double")
    writers.csv(df, str(tmp_path / "o"), 3)
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("part*"))
    assert "1,0.500" in text
    assert readers.csv(spark, str(tmp_path / "o"), "k int, v double").filter("k = 1").first().v == 0.5
