"""Cells of polygons and values of other grids against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orbweave.operators import grids as Y

RINGS = "array<array<struct<x double, y double>>>"


def star(rng, x, y, r, n):
    return [(x + rng.uniform(0.3, 1) * r * math.cos(k * 2 * math.pi / n), y + rng.uniform(0.3, 1) * r * math.sin(k * 2 * math.pi / n)) for k in range(n)]


def odd(x, y, rings):
    inside = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y):
                inside ^= x < ax + (y - ay) * (bx - ax) / (by - ay)
    return inside


@pytest.mark.parametrize(("levels", "seed"), [(0, 1), (2, 2), (4, 3), (5, 4)])
def test_cells_are_those_of_centres_inside(spark, levels, seed):
    rng = random.Random(seed)
    shapes = {k: [star(rng, rng.uniform(-20, 60), rng.uniform(-20, 60), 30, rng.randint(3, 14)) for _ in range(rng.randint(1, 3))] for k in range(5)}
    shapes[5] = [[(0.0, 0.0), (80.0, 0.0), (80.0, 80.0), (0.0, 80.0)], [(20.0, 20.0), (50.0, 20.0), (50.0, 50.0)]]
    rows = spark.createDataFrame([*shapes.items(), (8, None), (9, [])], f"k long, rings {RINGS}")
    grid = Y.Grid(1.7, -3.0, 2.0)
    cells = [(r, c, float(r * 100 + c)) for r in range(-30, 60) for c in range(-30, 60) if (r + c) % 7]
    want = {(k, r, c, v) for k, s in shapes.items() for r, c, v in cells if odd(-3 + (c + 0.5) * 1.7, 2 + (r + 0.5) * 1.7, s)}
    got = Y.cells_within(spark.createDataFrame(cells, "r long, c long, v double"), rows, "k", "rings", grid, levels).select("k", "r", "c", "v").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_inside_blocks_stay_whole(spark):
    box = spark.createDataFrame([(1, [[(-1.0, -1.0), (257.0, -1.0), (257.0, 257.0), (-1.0, 257.0)]])], f"k long, rings {RINGS}")
    sizes = {r.level: r["count"] for r in Y.cover(box, "k", "rings", Y.Grid(1.0), 5).groupBy("level").count().collect()}
    assert sizes[5] == 64 and sum(n * 4**level for level, n in sizes.items()) == 258 * 258
    assert Y.cover(box.limit(0), "k", "rings", Y.Grid(1.0)).count() == 0


def plain(cells, source, target, kind):
    """Sums over all pairs of cells."""
    sums = {}
    for r, c, v in cells:
        if v is None or math.isnan(v):
            continue
        for tr in range(-40, 60):
            for tc in range(-40, 60):
                w = 1.0
                for n, m, origin, other in ((c, tc, source.x0, target.x0), (r, tr, source.y0, target.y0)):
                    low, at = origin + n * source.size, other + m * target.size
                    if kind == "area":
                        w *= max(0.0, min(low + source.size, at + target.size) - max(low, at))
                    else:
                        w *= max(0.0, 1 - abs(at + target.size / 2 - low - source.size / 2) / source.size)
                if w > (1e-9 * min(source.size, target.size) ** 2 if kind == "area" else 1e-12):
                    a, b = sums.get((tr, tc), (0.0, 0.0))
                    sums[tr, tc] = a + w, b + w * v
    return {k: (b / a, a / target.size**2 if kind == "area" else a) for k, (a, b) in sums.items()}


@pytest.mark.parametrize("target", [Y.Grid(2.7, 0.4, -1.3), Y.Grid(0.6, -0.2, 0.1), Y.Grid(1.5, 3.0, 3.0), Y.Grid(3.0, -6.0, 0.0)])
def test_other_grids(spark, target):
    rng, source = random.Random(7), Y.Grid(1.5, -2.0, 1.0)
    cells = [(r, c, rng.choice([None, float("nan"), rng.uniform(0, 9), rng.uniform(0, 9)])) for r in range(6) for c in range(-2, 5)]
    rows = spark.createDataFrame(cells, "r long, c long, v double")
    for kind, found in (("area", Y.averaged(rows, "v", source, target)), ("hat", Y.interpolated(rows, "v", source, target))):
        got, want = {(r[0], r[1]): r[2:] for r in found.collect()}, plain(cells, source, target, kind)
        assert got.keys() == want.keys() and all(math.isclose(a, b, abs_tol=1e-9) for k in want for a, b in zip(got[k], want[k], strict=True))


def test_a_grid_onto_itself(spark):
    rows = spark.createDataFrame([("a", 0, 0, 3.0), ("a", 0, 1, 4.0), ("b", 0, 0, 5.0)], "s string, r long, c long, v double")
    for found in (Y.averaged(rows, "v", Y.Grid(2.0), Y.Grid(2.0), ["s"]), Y.interpolated(rows, "v", Y.Grid(2.0), Y.Grid(2.0), ["s"])):
        assert {tuple(r)[:4] for r in found.collect()} == {("a", 0, 0, 3.0), ("a", 0, 1, 4.0), ("b", 0, 0, 5.0)}
    assert Y.averaged(rows.filter(F.lit(False)), "v", Y.Grid(2.0), Y.Grid(1.0)).count() == 0
