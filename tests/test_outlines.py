"""Outlines of cells, chains of bands and tails of t and F against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orbweave.functions import scalar as S
from orbweave.operators import outlines as O, raster as X, stats as A


def rings_of(spark, cells):
    out = {}
    for r in O.rings(spark.createDataFrame(cells, "area string, r long, c long"), "area").orderBy("area", "ring", "seq").collect():
        out.setdefault((r.area, r.ring, r.hole, r.ring_area), []).append((r.x, r.y))
    return out


def signed(points):
    return sum(a * d - c * b for (a, b), (c, d) in zip(points, points[1:] + points[:1], strict=True)) / 2


def test_shell_and_holes_in_order(spark):
    ring = [("a", r, c) for r in range(4) for c in range(5) if (r, c) not in {(1, 1), (2, 3)}] + [("a", 0, 0)]
    found = rings_of(spark, [*ring, ("b", 7, 9)])
    assert {k: len(v) for k, v in found.items()} == {("a", 1, False, 20.0): 4, ("a", 2, True, 1.0): 4, ("a", 3, True, 1.0): 4, ("b", 1, False, 1.0): 4}
    assert all((signed(v) < 0) == k[2] and abs(signed(v)) == k[3] for k, v in found.items())
    assert set(found["b", 1, False, 1.0]) == {(9, 7), (10, 7), (10, 8), (9, 8)}


def test_pocket_closed_by_a_corner_is_a_hole(spark):
    found = rings_of(spark, [("a", r, c) for r in range(3) for c in range(3) if (r, c) not in {(1, 1), (2, 2)}])
    assert sorted((k[2], k[3]) for k in found) == [(False, 8.0), (True, 1.0)]


def test_rings_hold_all_cells(spark):
    rng = random.Random(3)
    cells = [(str(k % 3), r, c) for k in range(3) for r in range(14) for c in range(14) if rng.random() < 0.6]
    for area in ("0", "1", "2"):
        own = {(r, c) for a, r, c in cells if a == area}
        found = rings_of(spark, [(a, r, c) for a, r, c in cells if a == area])
        assert sum(signed(v) for v in found.values()) == len(own)

        def inside(r, c, points):
            crossed = False
            for (x, y), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
                crossed ^= x == x2 and min(y, y2) < r + 0.5 < max(y, y2) and x > c + 0.5
            return crossed

        got = {(r, c) for r in range(14) for c in range(14) if sum(inside(r, c, v) for v in found.values()) % 2}
        assert got == own


def test_closed_rings_in_map_units(spark):
    corners = O.rings(spark.createDataFrame([("a", 0, 0), ("a", 0, 1)], "area string, r long, c long"), "area")
    (row,) = O.polygons(corners, "area", size=30.0, x0=100.0, y0=10.0).collect()
    (ring,) = row.rings
    assert ring[0] == ring[-1] and {(p.x, p.y) for p in ring} == {(100.0, 10.0), (160.0, 10.0), (160.0, 40.0), (100.0, 40.0)}
    assert O.rings(spark.createDataFrame([], "area string, r long, c long"), "area").count() == 0


def test_chain_is_bridged_from_the_last_trusted_band(spark):
    rng, bands, pairs, want = random.Random(5), [], [], set()
    for scene in range(12):
        shift = {(i, j): rng.choice([None, 50.0, float("nan"), *[rng.uniform(-3, 3) for _ in range(4)]]) for i in range(7) for j in range(i + 1, 7)}
        bands += [(scene, i) for i in range(7)]
        pairs += [(scene, i, j, d, -1.0) for (i, j), d in shift.items() if d is not None or rng.random() < 0.5]
        last, at = 0, (0.0, 0.0)
        want.add((scene, 0, 0.0, 0.0, True))
        for band in range(1, 7):
            d = shift[last, band]
            matched = d is not None and abs(d) <= 10
            if matched:
                last, at = band, (at[0] + d, at[1] - 1.0)
            want.add((scene, band, round(at[0], 9), round(at[1], 9), matched))
    got = X.bridged(spark.createDataFrame(bands, "s long, i long"), spark.createDataFrame(pairs, "s long, i long, j long, dy double, dx double"), ["s"], ["dy", "dx"], 10.0)
    assert {(r.s, r.i, round(r.dy, 9), round(r.dx, 9), r.trusted) for r in got.collect()} == want


#: Two-sided p and upper tails in closed form: t with 1 and 2 degrees of freedom, F with 2 above.
@pytest.mark.parametrize("x", [0.0, 0.3, 1.0, 2.5, 12.0, 400.0])
def test_tails_in_closed_form(spark, x):
    t, two = F.lit(x), F.lit(2.0)
    row = spark.range(1).select(S.student_p(t, F.lit(1.0)).alias("one"), S.student_p(t, two).alias("two"), S.f_tail(t, two, F.lit(7.0)).alias("f")).first()
    assert math.isclose(row.one, 1 - 2 * math.atan(x) / math.pi, abs_tol=1e-10)
    assert math.isclose(row.two, 1 - x / math.sqrt(2 + x * x), abs_tol=1e-10)
    assert math.isclose(row.f, (1 + 2 * x / 7) ** -3.5, abs_tol=1e-10)


@pytest.mark.parametrize("df", [3.7, 30.0, 1000.0, 100000.0])
def test_tails_by_integration(spark, df):
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi * df)
    f = lambda u: front * (1 + u * u / df) ** (-(df + 1) / 2)
    h = 2.2 / 2000
    area = sum((1 if k in (0, 2000) else 4 if k % 2 else 2) * f(k * h) for k in range(2001)) * h / 3
    assert math.isclose(spark.range(1).select(S.student_p(F.lit(-2.2), F.lit(df))).first()[0], 1 - 2 * area, abs_tol=1e-9)


def test_trend_of_exact_lines(spark):
    rows = [("up", k, 2.0 * k) for k in range(6)] + [("flat", k, 1.0) for k in range(6)] + [("two", k, float(k)) for k in range(2)] + [("still", 1, float(k)) for k in range(5)]
    got = {r.u: r for r in spark.createDataFrame(rows, "u string, x long, y double").groupBy("u").agg(*A.trend_test(F.col("y"), F.col("x"))).collect()}
    assert got["up"].p == 0 and got["up"].slope == 2 and got["flat"].p == 1 and got["two"].p is None and got["still"].p is None
