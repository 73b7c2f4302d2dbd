"""Lines over cells, and the test against random ones, in plain Python."""

import hashlib
import math
import random
import statistics

import pytest

from orbweave.operators import transects as L
from orbweave.operators.grids import Grid

GRID = Grid(2.0, -10.0, 4.0)


def table(seed, density):
    rng = random.Random(seed)
    return {(r, c): (rng.choice([None, float("nan"), *[rng.uniform(0, 9)] * 8]), rng.choice([None, rng.uniform(0, 9), 3.0])) for r in range(-4, 24) for c in range(-4, 24) if rng.random() < density}


def plain(cells, line, step, least):
    x0, y0, x1, y1 = line
    long = math.hypot(x1 - x0, y1 - y0)
    got = ([], [])
    for n in range(math.floor(long / step + 1e-9) + 1):
        s = n * step / long if long else 0.0
        at = math.floor((y0 + (y1 - y0) * s - GRID.y0) / GRID.size), math.floor((x0 + (x1 - x0) * s - GRID.x0) / GRID.size)
        for values, v in zip(got, cells.get(at, (None, None)), strict=True):
            if v is not None and not math.isnan(v):
                values.append(v)
    return [statistics.median(v) if len(v) >= least else None for v in got]


def number(seed, k, t, n):
    return int(hashlib.md5(f"{seed}:{k}:{t}:{n}".encode()).hexdigest()[:12], 16) / 16**12


def frame(spark, cells):
    return spark.createDataFrame([(r, c, *v) for (r, c), v in cells.items()], "r long, c long, v double, w double")


def same(a, b):
    return a is b is None or (a is not None and b is not None and math.isclose(a, b, abs_tol=1e-9))


@pytest.mark.parametrize("density", [0.35, 0.9])
def test_random_lines_and_their_test(spark, density):
    cells, n, rounds = table(1, density), 12, 4
    anchors = [("a", 5.3, 20.1), ("b", 20.7, 31.9), ("far", 900.0, 5.0), ("none", None, 3.0)]
    want = {}
    for k, x, y in anchors[:3]:
        for t in range(1, n * rounds + 1):
            d, a, b = 15 * math.sqrt(number(9, k, t, 1)), 2 * math.pi * number(9, k, t, 2), math.pi * number(9, k, t, 3)
            x0, y0 = x + d * math.cos(a), y + d * math.sin(a)
            m = plain(cells, (x0, y0, x0 + 11 * math.cos(b), y0 + 11 * math.sin(b)), 0.9, 6)
            if m[0] is not None and sum(key[0] == k for key in want) < n:
                want[k, t] = m
    rows = spark.createDataFrame(anchors, "k string, x double, y double")
    lines = L.random_lines(rows, frame(spark, cells), "k", ["v", "w"], GRID, n, 15.0, 11.0, 0.9, 9, 6, rounds)
    got = {(r.k, r.t): (r.v, r.w) for r in lines.collect()}
    assert got.keys() == want.keys() and all(same(a, b) for k in want for a, b in zip(got[k], want[k], strict=True))
    again = L.random_lines(rows.repartition(7), frame(spark, cells).repartition(3), "k", ["v", "w"], GRID, n, 15.0, 11.0, 0.9, 9, 6, rounds)
    assert {(r.k, r.t): (r.v, r.w) for r in again.collect()} == got

    observed = spark.createDataFrame([("a", 4.0, 3.5), ("b", 4.4, None), ("far", 1.0, 1.0)], "k string, v double, w double")
    tested = {r.k: r for r in L.against(observed, lines, "k", ["v", "w"]).collect()}
    assert tested["far"].v_n == 0 and tested["far"].v_rank is None and tested["b"].w_rank is None
    for k, column, seen in (("a", 0, 4.0), ("a", 1, 3.5), ("b", 0, 4.4)):
        null = [m[column] for key, m in want.items() if key[0] == k and m[column] is not None]
        name = "vw"[column]
        assert tested[k][f"{name}_n"] == len(null) and same(tested[k][f"{name}_rank"], 100 * sum(v < seen for v in null) / len(null))
        assert same(tested[k][f"{name}_z"], (seen - statistics.mean(null)) / (statistics.stdev(null) + 1e-9))


def test_medians_of_given_lines(spark):
    cells = table(2, 0.8)
    lines = [(1, -8.0, 6.0, 30.0, 44.0), (2, 3.0, 9.0, 3.0, 9.0), (3, 500.0, 0.0, 510.0, 0.0), (4, 30.0, 30.0, -5.0, 8.0)]
    got = {r.k: (r.v, r.w) for r in L.medians(spark.createDataFrame(lines, "k long, x0 double, y0 double, x1 double, y1 double"), frame(spark, cells), ["k"], ["v", "w"], GRID, 1.3, 4).collect()}
    assert len(got) == 4 and all(same(a, b) for k, *line in lines for a, b in zip(got[k], plain(cells, line, 1.3, 4), strict=True))
