"""Decompositions against a plain numpy version that follows the published algorithm step by step."""

import math

import numpy as np
import pytest

from orbweave.operators import decomposition as D


def line_at(ys, ws, at, q):
    """Local line at place `at` through ys at 0 .. n - 1 (nan: no value)."""
    n, m = len(ys), min(q, len(ys))
    left = max(0, min(at + 1 - (q + 1) // 2, n - m))
    h = max(at - left, left + m - 1 - at) + ((q - n) // 2 if n < q else 0)
    w = np.zeros(n)
    for j in range(left, left + m):
        r = abs(j - at)
        if not np.isnan(ys[j]) and r <= 0.999 * h:
            w[j] = ws[j] * (1 if r <= 0.001 * h else (1 - (r / h) ** 3) ** 3)
    w /= w.sum()
    places = np.arange(n)
    mean = (w * places).sum()
    c = (w * (places - mean) ** 2).sum()
    if math.sqrt(c) > 0.001 * (n - 1):
        w = w * (1 + (at - mean) / c * (places - mean))
    return np.nansum(w * ys)


def plain(y, period, seasonal, trend, low, inner, outer):
    n, t, w = len(y), np.zeros(len(y)), np.ones(len(y))
    for round_ in range(outer + 1):
        for _ in range(inner):
            d, c = y - t, np.empty(n + 2 * period)
            for phase in range(period):
                own, ws = d[phase::period], w[phase::period]
                for j in range(-1, len(own) + 1):
                    c[period + phase + j * period] = line_at(own, ws, j, seasonal)
            mean = lambda x, k: np.convolve(x, np.ones(k) / k, "valid")
            a = mean(mean(mean(c, period), period), 3)
            s = c[period : period + n] - np.array([line_at(a, np.ones(n), j, low) for j in range(n)])
            t = np.array([line_at(y - s, w, j, trend) for j in range(n)])
        if round_ < outer:
            r = np.abs(y - s - t)
            h = 6 * np.nanmedian(r)
            w = np.where(r <= 0.001 * h, 1, np.where(r <= 0.999 * h, (1 - (r / h) ** 2) ** 2, 0))
            w[np.isnan(y)] = 1
    return s, t


@pytest.mark.parametrize(("period", "n", "outer", "gaps"), [(6, 40, 0, False), (5, 31, 2, False), (4, 29, 1, True)])
def test_as_plain_numpy(spark, period, n, outer, gaps):
    rng = np.random.default_rng(period)
    want, rows = {}, []
    for u in ("a", "b"):
        y = 0.3 * np.arange(n) + 5 * np.sin(2 * np.pi * np.arange(n) / period) + rng.normal(0, 0.5, n)
        y[n // 2] += 30
        if gaps:
            y[[3, 11, 12]] = np.nan
        want[u] = plain(y, period, 7, D._odd(1.5 * period / (1 - 1.5 / 7)), D._odd(period + 1), 2, outer)
        rows += [(u, k, None if np.isnan(x) else float(x)) for k, x in enumerate(y)]
    rows += [("short", k, 1.0) for k in range(2 * period - 1)]
    got = D.stl(spark.createDataFrame(rows, "u string, k long, v double"), ["u"], "k", "v", period, outer=outer).toPandas()
    assert set(got.u) == {"a", "b"} and len(got) == 2 * n
    for u, (s, t) in want.items():
        own = got[got.u == u].sort_values("k")
        assert np.allclose(own.seasonal, s, atol=1e-8) and np.allclose(own.trend, t, atol=1e-8)
    if outer:
        assert got[got.k == n // 2].weight.max() < 0.01  # the outlier doesn't count


def test_regular_places(spark):
    rows = [("a", 0.0, 0.0), ("a", 2.5, 5.0), ("a", 2.5, 5.0), ("a", 4.0, 2.0), ("b", 1.0, 7.0), ("c", 0.0, 1.0), ("c", 0.9, 2.0), ("c", None, 3.0)]
    got = D.regular(spark.createDataFrame(rows, "u string, t double, v double"), ["u"], "t", "v", 1.0).collect()
    assert sorted((r.u, r.k, round(r.v, 9)) for r in got) == [("a", 0, 0.0), ("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, 4.0), ("a", 4, 2.0), ("b", 0, 7.0), ("c", 0, 1.0)]
