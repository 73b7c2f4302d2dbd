"""Whole answers where groups are large, against direct ones."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import grids as Y, inversion as I, series as T, shapes as P


def network(spark, pairs):
    rows = I.network_offsets(spark.createDataFrame(pairs, "g long, a long, b long, d double"), ["g"], "a", "b", "d").collect()
    return {r.node: r.offset for r in rows}


@pytest.mark.parametrize("extra", [0, 5, 400])
def test_network_is_that_of_dense_least_squares(spark, extra):
    random = np.random.default_rng(extra)
    pairs = [(1, int(n), int(n) + 1, float(random.normal())) for n in range(150) if n != 70]  # two parts
    pairs += [(1, *sorted(int(x) for x in random.integers(71, 151, 2)), float(random.normal())) for _ in range(extra)]
    nodes = sorted({x for p in pairs for x in p[1:3]})
    m = np.zeros((len(pairs) + 1, len(nodes)))
    for k, (_, a, b, _) in enumerate(pairs):
        m[k, nodes.index(b)] += 1
        m[k, nodes.index(a)] -= 1
    m[-1] = 1
    want = np.linalg.lstsq(m, np.array([*(p[3] for p in pairs), 0.0]), rcond=None)[0]
    found = network(spark, pairs)
    assert [found[n] for n in nodes] == pytest.approx(want.tolist(), abs=1e-8)


def test_network_of_a_long_chain_takes_no_square_of_its_nodes(spark):
    chain = spark.range(60_000).select(F.lit(1).cast("long").alias("g"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("d"))
    ends = I.network_offsets(chain, ["g"], "a", "b", "d").filter("node IN (0, 60000)").orderBy("node").collect()  # a dense matrix would be 29 GB
    assert [r.offset for r in ends] == pytest.approx([-30_000.0, 30_000.0])


def shapes(spark, n, seed):
    random, rows = np.random.default_rng(seed), []
    for k in range(n):
        x, y = (float(v) for v in random.integers(0, 300, 2))
        w, h = (float(v) for v in random.integers(1, 90, 2))
        rows.append((k, k % 2, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)] if k % 4 else [(x, y), (x + w, y), (x, y + h)]))
    return rows, spark.createDataFrame(rows, "k long, owner long, ring array<struct<x: double, y: double>>")


def test_polygons_within_reach_are_there_once_whatever_the_cells(spark):
    rows, df = shapes(spark, 60, 1)
    found = P.distances(df, df, "k", "k", "ring", 25.0, 30.0).collect()
    wide = P.distances(df, df, "k", "k", "ring", 25.0, 10_000.0).collect()
    every = df.select(F.col("k").alias("a"), F.col("ring").alias("p")).crossJoin(df.select(F.col("k").alias("b"), F.col("ring").alias("q"))).filter("a <> b")
    want = {(r.a, r.b): r.d for r in every.select("a", "b", P.ring_distance(F.col("p"), F.col("q")).alias("d")).filter("d <= 25").collect()}
    assert len(found) == len(wide) == len(want) and {(r.k, r.other_k): r.d for r in found} == pytest.approx(want) and {(r.k, r.other_k): r.d for r in wide} == pytest.approx(want)
    label = {k: k for k, _, _ in rows}
    for _ in rows:
        for (a, b), d in want.items():
            if d <= 12 and a % 2 == b % 2:
                label[a] = label[b] = min(label[a], label[b])
    assert {r.k: r.whole for r in P.merged(df, "k", "owner", "ring", 12.0, 30.0).collect()} == label


def test_buildings_of_one_spot_pair_without_their_rings(spark):
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    crowd = spark.range(2500).select(F.col("id").alias("k"), F.array(at(0.0, 0.0), at(9.0, 0.0), at(9.0, 9.0), at(0.0, 9.0)).alias("ring"))
    began = time.time()
    assert P.distances(crowd, crowd, "k", "k", "ring", 40.0, 60.0).filter("d = 0").count() == 2500 * 2499 and time.time() - began < 40


def test_zone_sums_are_those_of_the_cells_within(spark):
    random = np.random.default_rng(3)
    cells = spark.createDataFrame([(int(r), int(c), None if (r + c) % 7 == 0 else float(random.normal())) for r in range(-30, 60) for c in range(-30, 60) if random.random() < 0.8], "r long, c long, v double")
    polygons = [(n % 25, [[(float(x), float(y)) for x, y in random.uniform(-50, 80, (6, 2))], [(float(x), float(y)) for x, y in random.integers(-50, 80, (4, 2))]]) for n in range(30)]
    df = spark.createDataFrame([*polygons, (99, []), (98, None)], "k long, rings array<array<struct<x: double, y: double>>>")
    of = Y.Grid(1.5, 0.25, -0.5)
    want = {r.k: (r.n, r.s, r.lo, r.hi) for r in Y.cells_within(cells, df, "k", "rings", of, 3).groupBy("k").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    found = {r.k: (r.v_n, r.v_sum, r.v_low, r.v_high) for r in Y.zone_sums(cells, df, "k", "rings", of, ["v"]).collect()}
    assert len(want) > 20 and found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_many_wide_zones_make_no_row_for_each_cell(spark):
    cells = spark.range(400 * 400).select((F.col("id") % 400).alias("r"), F.floor(F.col("id") / 400).alias("c"), F.lit(1.0).alias("v"))
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    zones = spark.range(2000).select(F.col("id").alias("k"), F.array(F.array(at(-1.0, -1.0), at(401.0, -1.0), at(401.0, 401.0), at(-1.0, 401.0))).alias("rings"))
    began = time.time()
    assert Y.zone_sums(cells, zones, "k", "rings", Y.Grid(1.0), ["v"]).filter("v_n = 160000 AND v_sum = 160000").count() == 2000 and time.time() - began < 60


def test_slopes_of_epochs_at_one_time_are_not_a_number(spark):
    rows = spark.createDataFrame([("a", k, 1.0 if k < 5 else float(k), float(k)) for k in range(8)], "u string, i long, t double, v double")
    found = [(r.vel, r.vtr, r.dv) for r in T.walk_forward(rows, ["u"], "i", "t", "v", 10.0).orderBy("i").collect()]
    assert [r[1] is None for r in found] == [True] * 3 + [False] * 5 and all(np.isnan(r[1]) for r in found[3:5]) and all(np.isnan(x) for x in found[4]) and found[7][1] < 0


def test_trials_of_lines_neither_repeat_rows_nor_are_sent_out(spark):
    rows = spark.range(400).select((F.col("id") % 2).alias("u"), "id", F.col("id").cast("double").alias("t"), F.when(F.col("id") % 5 == 0, 900.0).otherwise(F.col("id") * 2.0 + 1).alias("v"))
    found = I.ransac_line(rows, ["u"], "id", "t", "v", 20, 3.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Broadcast" not in plan
    assert [(r.n, r.inliers, round(r.slope, 6), round(r.intercept, 6)) for r in found.collect()] == [(200, 160, 2.0, 1.0)] * 2
