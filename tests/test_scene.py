"""A scene's shared inversion and regressions of large offsets against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import inversion as I

SCHEMA = "k long, x double, y double, i double, j double, v double, c double"


def scene(seed, side=6, epochs=7):
    rng = np.random.default_rng(seed)
    times = np.cumsum(rng.uniform(0.02, 0.1, epochs))
    pairs = [(i, j) for i in range(epochs) for j in range(i + 1, min(epochs, i + 4))]
    y, x = np.divmod(np.arange(side * side), side)
    u, c = rng.normal(0, 0.4, (len(pairs), side * side)), rng.uniform(0.2, 1, (len(pairs), side * side))
    u[:, 3] += rng.normal(0, 9, len(pairs))  # a pixel that fits nothing
    for n, (i, j) in enumerate(pairs):
        u[n] += (j - i) * (0.3 * x - 0.2 * y + 1)
    rows = [(int(k), float(x[k]), float(y[k]), float(times[i]), float(times[j]), float(u[n, k]), float(c[n, k])) for n, (i, j) in enumerate(pairs) for k in range(side * side)]
    return rows, times, pairs, x, y, u, c


def plain(times, pairs, x, y, u, c, least, fit, reference):
    """Inversion, planes and slopes of pixels that have all pairs, in loops over dense arrays."""
    b = np.zeros((len(pairs), len(times)))
    for n, (i, j) in enumerate(pairs):
        b[n, [i, j]] = -1, 1
    w = np.diag(c.mean(axis=1))
    d = u - u[:, [reference]]
    phi = np.vstack([np.zeros(d.shape[1]), *[np.linalg.lstsq(w @ b[:, 1:], w @ d, rcond=None)[0]]])
    close = np.abs(np.exp(1j * (d - b @ phi)).mean(axis=0))
    good = (c.mean(axis=0) >= least) & (close >= fit)
    a = np.column_stack([np.ones(len(x)), x, y])
    for k in range(1, len(times)):
        phi[k] -= a @ np.linalg.lstsq(a[good], phi[k, good], rcond=None)[0]
    phi -= phi[:, [reference]]
    return phi, close, good, np.polyfit(times, phi, 1)[0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scene_as_dense_arrays(spark, seed):
    rows, times, pairs, x, y, u, c = scene(seed)
    phi, close, good, slope = plain(times, pairs, x, y, u, c, 0.5, 0.6, int(np.argmax(c.mean(axis=0))))
    got = {r.k: r for r in I.shared_baseline(spark.createDataFrame(rows, SCHEMA).repartition(5), "k", "x", "y", "i", "j", "v", "c", 0.5, 0.6, scale=-2.0).collect()}
    assert len(got) == len(x) and 0 < good.sum() < len(x) and not good[3]
    for k, r in got.items():
        assert [s.t for s in r.series] == times.tolist() and r.good == good[k] and np.isclose(r.fit, close[k], atol=1e-9)
        assert np.allclose([s.v for s in r.series], -2 * phi[:, k], atol=1e-8) and np.isclose(r.velocity, -2 * slope[k], atol=1e-7)


def test_pixels_that_lack_pairs(spark):
    rows, times, pairs, x, y, u, c = scene(4)
    order = {(float(times[i]), float(times[j])): n for n, (i, j) in enumerate(pairs)}
    short = {5: {0, 1, 4}, 7: {2, 9}, 9: {n for n, (i, j) in enumerate(pairs) if 6 in (i, j)}}
    left = [r for r in rows if order[r[3], r[4]] not in short.get(r[0], ())]
    broken = [(*r[:5], None, r[6]) if r[0] == 11 and order[r[3], r[4]] == 0 else r for r in left] + [r for r in left if r[0] == 20]
    got = {r.k: r for r in I.shared_baseline(spark.createDataFrame(broken, SCHEMA), "k", "x", "y", "i", "j", "v", "c", 0.0, 2.0).collect()}
    reference = max(set(range(36)) - {5, 7, 9, 11}, key=lambda k: c[:, k].mean())
    weights = np.zeros(len(pairs))
    for n in range(len(pairs)):
        weights[n] = np.mean([r[6] for r in broken if order[r[3], r[4]] == n and r[5] is not None])
    b = np.zeros((len(pairs), len(times)))
    for n, (i, j) in enumerate(pairs):
        b[n, [i, j]] = -1, 1
    for k, gone in {**short, 11: {0}, 20: set()}.items():
        have = [n for n in range(len(pairs)) if n not in gone]
        if k == 9:
            assert got[k].series is None and got[k].fit is None and got[k].velocity is None and not got[k].good
            continue
        w = np.diag(weights[have])
        want = np.linalg.lstsq(w @ b[have][:, 1:], w @ (u[have, k] - u[have, reference]), rcond=None)[0]
        assert np.allclose([s.v for s in got[k].series], [0, *want], atol=1e-8)  # no good pixels, so no planes
    assert all(s.v == 0 for s in got[reference].series)


def test_empty_scene_and_wide_network(spark):
    none = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, None, 0.5)], SCHEMA)
    assert I.shared_baseline(none, "k", "x", "y", "i", "j", "v", "c").collect() == []
    with pytest.raises(ValueError, match="more than 2 pairs"):
        I.shared_baseline(spark.createDataFrame(scene(5)[0], SCHEMA), "k", "x", "y", "i", "j", "v", "c", most=2)


def test_large_offsets_cost_no_digits(spark):
    rows = spark.range(200).select(F.lit("a").alias("g"), (F.lit(1.7e9) + F.col("id")).alias("t"), (F.lit(4.1e6) + F.col("id") * 7 % 50).alias("n"), F.lit(1.0).alias("q"))
    rows = rows.withColumn("z", (F.col("t") - 1.7e9) * 2 - (F.col("n") - 4.1e6) * 3)
    (row,) = I.masked_regression(rows, ["g"], "z", ["t", "n"], "q", 0.5).collect()
    assert np.allclose(row.coefficients[1:], [2, -3], rtol=1e-9)
