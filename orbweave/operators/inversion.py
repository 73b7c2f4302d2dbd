"""Least squares per group in vectorised functions: what sums alone don't solve."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .lineage import kept
from .stats import plane


def _schema(df: DataFrame, by: Sequence[str], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"{k} {kinds[k]}" for k in by), more])


def small_baseline(pairs: DataFrame, by: Sequence[str], i: str, j: str, value: str) -> DataFrame:
    """Epoch values (by..., epoch, v; the first epoch is 0) whose differences j - i fit the pairs best, and coherence, the mean cosine of the residuals."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        epochs = np.unique(np.concatenate([group[i], group[j]]))
        a = np.zeros((len(group), len(epochs)))
        rows = np.arange(len(group))
        a[rows, np.searchsorted(epochs, group[j])] += 1
        a[rows, np.searchsorted(epochs, group[i])] -= 1
        y = group[value].to_numpy(dtype=float)
        v = np.concatenate([[0.0], np.linalg.lstsq(a[:, 1:], y, rcond=None)[0]])
        return pd.DataFrame({**{k: group[k].iloc[0] for k in by}, "epoch": epochs, "v": v, "coherence": np.abs(np.exp(1j * (y - a @ v)).mean())})

    return pairs.select(*by, i, j, value).groupBy(*by).applyInPandas(solve, _schema(pairs, by, "epoch long, v double, coherence double"))


def robust_line(rows: DataFrame, by: Sequence[str], x: str, y: str, k: float = 1.345, rounds: int = 30) -> DataFrame:
    """slope and intercept with Huber weights, residuals scaled by their median deviation."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        a = np.column_stack([group[x], np.ones(len(group))]).astype(float)
        b, w = group[y].to_numpy(dtype=float), np.ones(len(group))
        c = np.zeros(2)
        for _ in range(rounds):
            root = np.sqrt(w)[:, None]
            now = np.linalg.lstsq(a * root, b * root[:, 0], rcond=None)[0]
            r = np.abs(b - a @ now)
            scale = max(1.4826 * np.median(r), 1e-12)
            w = np.minimum(1.0, k * scale / np.maximum(r, 1e-12))
            if np.allclose(now, c, atol=1e-10):
                break
            c = now
        return pd.DataFrame({**{g: [group[g].iloc[0]] for g in by}, "slope": [c[0]], "intercept": [c[1]]})

    return rows.select(*by, x, y).groupBy(*by).applyInPandas(fit, _schema(rows, by, "slope double, intercept double"))


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in an order in which each follows its parent, the parent (-1: a root), the edge to it (-1) and the root of each node."""
    ends, others = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(ends, kind="stable")
    starts = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    to, edge = others[order].tolist(), np.tile(np.arange(len(a)), 2)[order].tolist()
    parent, by, root, walk = [-1] * n, [-1] * n, [-1] * n, []
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first] = first
        at = len(walk)
        walk.append(first)
        while at < len(walk):
            u = walk[at]
            at += 1
            for k in range(starts[u], starts[u + 1]):
                if root[to[k]] < 0:
                    root[to[k]], parent[to[k]], by[to[k]] = first, u, edge[k]
                    walk.append(to[k])
    return np.array(walk), np.array(parent), np.array(by), np.array(root)


def _levelled(n: int, a: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares v with v[b] - v[a] = y, of mean zero in each linked part. Memory is that of nodes and pairs: what a spanning tree says, made better by conjugate gradients."""
    a, b, y = (c[a != b] for c in (a, b, y))
    walk, parent, by, root = _spanning(n, a, b)
    steps, up, v = walk.tolist(), parent.tolist(), [0.0] * n
    rise = np.where(by >= 0, np.where(b[by] == np.arange(n), y[by], -y[by]) if len(y) else 0.0, 0.0).tolist()
    for u in steps:
        if up[u] >= 0:
            v[u] = v[up[u]] + rise[u]
    sizes = np.bincount(root, minlength=n)
    centred = lambda x: x - (np.bincount(root, weights=x, minlength=n) / np.maximum(sizes, 1))[root]
    back = lambda e: np.bincount(b, weights=e, minlength=n) - np.bincount(a, weights=e, minlength=n)
    v = centred(np.array(v))
    extra = len(y) - int((parent >= 0).sum())
    if not extra:
        return v
    degree = np.maximum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), 1)

    def near(r: np.ndarray) -> np.ndarray:
        if extra > 100:
            return centred(r / degree)
        flow, z = r.tolist(), [0.0] * n
        for u in reversed(steps):
            if up[u] >= 0:
                flow[up[u]] += flow[u]
        for u in steps:
            if up[u] >= 0:
                z[u] = z[up[u]] + flow[u]
        return centred(np.array(z))

    r = back(y - (v[b] - v[a]))
    most = 1e-13 * max(np.abs(y).max(), 1e-300) * np.sqrt(n)
    z = near(r)
    p, rz = z, r @ z
    for _ in range(10 * n):
        if np.sqrt(r @ r) <= most or rz <= 0:
            break
        q = back(p[b] - p[a])
        step = rz / (p @ q)
        v, r = v + step * p, r - step * q
        z = near(r)
        rz, old = r @ z, rz
        p = z + rz / old * p
    return centred(v)


def network_offsets(pairs: DataFrame, by: Sequence[str], a: str, b: str, value: str) -> DataFrame:
    """Offsets (by..., node, offset) of scenes out of differences b - a, of sum zero per network and per linked part of it. A network must fit a task by its nodes and pairs, not by their product."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        nodes, ends = np.unique(np.concatenate([group[a], group[b]]), return_inverse=True)
        v = _levelled(len(nodes), ends[: len(group)], ends[len(group) :], group[value].to_numpy(dtype=float))
        return pd.DataFrame({**{k: group[k].iloc[0] for k in by}, "node": nodes, "offset": v})

    return pairs.select(*by, a, b, value).groupBy(*by).applyInPandas(solve, _schema(pairs, by, "node long, offset double"))


def block_shift(pairs: DataFrame, by: Sequence[str], reach: int) -> DataFrame:
    """pairs: by..., r, c, a, b (two images of a block). The shift of b against a (dr, dc) of the largest normalised correlation, and that correlation."""

    def search(group: pd.DataFrame) -> pd.DataFrame:
        r, c = group["r"] - group["r"].min(), group["c"] - group["c"].min()
        shape = (int(r.max()) + 1, int(c.max()) + 1)
        one, two = np.full(shape, np.nan), np.full(shape, np.nan)
        one[r, c], two[r, c] = group["a"], group["b"]
        best = (-2.0, 0, 0)
        for dr in range(-reach, reach + 1):
            for dc in range(-reach, reach + 1):
                p = one[max(0, -dr) : shape[0] - max(0, dr), max(0, -dc) : shape[1] - max(0, dc)]
                q = two[max(0, dr) : shape[0] - max(0, -dr), max(0, dc) : shape[1] - max(0, -dc)]
                fine = np.isfinite(p) & np.isfinite(q)
                if fine.sum() > max(2, len(group) // 4):
                    u, v = p[fine] - p[fine].mean(), q[fine] - q[fine].mean()
                    size = np.sqrt((u * u).sum() * (v * v).sum())
                    if size > 0:
                        best = max(best, (float((u * v).sum() / size), -dr, -dc))
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in by}, "dr": [-best[1]], "dc": [-best[2]], "ncc": [best[0]]})

    return pairs.select(*by, "r", "c", "a", "b").groupBy(*by).applyInPandas(search, _schema(pairs, by, "dr long, dc long, ncc double"))


def masked_regression(rows: DataFrame, by: Sequence[str], y: str, terms: Sequence[str], quality: str, least: float) -> DataFrame:
    """by..., coefficients (of the constant and each term) and n: least squares over the rows of a quality of at least `least` without nulls in y or a term.

    Spark adds up means and centred products, so large offsets (years, northings) cost no digits; only one small system per group is solved in a task. Terms that can't be told apart share their weight, a constant one has none.
    """
    term = [F.col(c).cast("double") for c in terms]
    pairs = [(a, b) for a in range(len(terms)) for b in range(a, len(terms))]
    known = rows.filter(F.col(quality) >= least)
    for c in (y, *terms):
        known = known.filter(F.col(c).isNotNull())
    empty = F.array().cast("array<double>")
    sums = known.groupBy(*by).agg(
        F.concat(empty, *[F.array(F.covar_pop(term[a], term[b])) for a, b in pairs]).alias("_xx"), F.concat(empty, *[F.array(F.covar_pop(t, F.col(y))) for t in term]).alias("_xy"),
        F.array(F.avg(y), *[F.avg(t) for t in term]).alias("_m"), F.count(F.lit(1)).alias("n"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for xx, xy, means in zip(batch["_xx"], batch["_xy"], batch["_m"], strict=True):
                m = np.zeros((len(terms), len(terms)))
                for (a, b), x in zip(pairs, xx, strict=True):
                    m[a, b] = m[b, a] = x
                scale = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1))
                slopes = np.linalg.lstsq(m / np.outer(scale, scale), np.asarray(xy) / scale, rcond=None)[0] / scale
                out.append([float(means[0] - slopes @ np.asarray(means[1:])), *slopes.tolist()])
            yield batch.drop(columns=["_xx", "_xy", "_m"]).assign(coefficients=out)

    return sums.mapInPandas(solve, _schema(rows, by, "n long, coefficients array<double>")).select(*by, "coefficients", "n")


def ransac_line(rows: DataFrame, by: Sequence[str], key: str, x: str, y: str, trials: int = 50, within: float = 2.0, seed: int = 42) -> DataFrame:
    """by..., slope, intercept, inliers, n: the line through two seeded points that most points lie near (the first of several such trials), fitted anew to those.

    Points of a trial are those of the smallest hashes of seed, trial and key, so any partitioning gives the same. Trials of equal x are left out; groups without any are too.
    Trials are columns of a group's aggregates: rows aren't repeated for them, and tables are merged by group, so none is gathered by the driver to be sent out.
    """
    points = rows.select(*by, F.col(key).cast("string").alias("_id"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    every = range(trials)
    order = lambda t: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(t + 1)), F.col("_id")).cast("binary")).alias("h"), F.col("_id").alias("k"), F.col("_x").alias("x"), F.col("_y").alias("y"))
    told = lambda of: points.join(of.hint("merge"), list(by))
    first = points.groupBy(*by).agg(F.array(*[F.min(order(t)) for t in every]).alias("_p"))
    second = told(first).groupBy(*by).agg(F.first("_p").alias("_p"), F.array(*[F.min(F.when(order(t) > F.col("_p")[t], order(t))) for t in every]).alias("_q"))

    def line(p: Column, q: Column) -> Column:
        slope = F.try_divide(q["y"] - p["y"], q["x"] - p["x"])
        return F.struct(slope.alias("a"), (p["y"] - slope * p["x"]).alias("b"))

    lines = second.select(*by, F.zip_with("_p", "_q", line).alias("_s"))
    off = lambda t: F.abs(F.col("_y") - F.col("_s")[t]["a"] * F.col("_x") - F.col("_s")[t]["b"])
    counts = told(lines).groupBy(*by).agg(F.first("_s").alias("_s"), F.array(*[F.count_if(off(t) <= within) for t in every]).alias("_c"))
    ranked = F.transform("_s", lambda s, t: F.struct((-F.get("_c", t)).alias("n"), t.alias("t"), s["a"].alias("_a"), s["b"].alias("_b")))
    best = counts.select(*by, F.array_min(F.filter(ranked, lambda s: s["_a"].isNotNull())).alias("_l")).filter("_l IS NOT NULL").hint("merge")
    return rows.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).join(best, list(by)).withColumn("_near", F.abs(F.col("_y") - F.col("_l._a") * F.col("_x") - F.col("_l._b")) <= within).groupBy(*by).agg(
        F.regr_slope(F.when(F.col("_near"), F.col("_y")), F.when(F.col("_near"), F.col("_x"))).alias("slope"), F.regr_intercept(F.when(F.col("_near"), F.col("_y")), F.when(F.col("_near"), F.col("_x"))).alias("intercept"),
        F.count_if("_near").alias("inliers"), F.count(F.lit(1)).alias("n"),
    )


def _linking(b: np.ndarray, w: np.ndarray) -> np.ndarray | None:
    """Weighted pseudo-inverse of a network of pairs; None if the pairs don't link all epochs."""
    if len(b) == 0 or np.linalg.matrix_rank(b) < b.shape[1]:
        return None
    return np.linalg.pinv(w[:, None] * b) * w


def shared_baseline(
    pairs: DataFrame, key: str, x: str, y: str, i: str, j: str, value: str, coherence: str, least_coherence: float = 0.3, least_fit: float = 0.7, scale: float = 1.0, most: int = 20_000
) -> DataFrame:
    """key, x, y, mean_coherence, fit, good, series and velocity of each pixel, out of pairs of epochs of a whole scene that share one network.

    pairs: a row per pixel and pair with the times i < j, the difference j - i and its coherence. Differences are taken against the reference pixel (of those with the most pairs the
    one of the highest mean coherence, then the smallest key). Pairs weigh as their mean coherence over the scene; the network's weighted pseudo-inverse is worked out once, from at most `most` pairs
    (more are an error), and applied to blocks of pixels as one array product. Pixels that lack pairs are solved by the pairs they have, those of one pattern together.
    fit is the absolute mean of exp(i residual) over a pixel's pairs; good pixels reach both limits. From each epoch the plane through the good pixels is taken away, so that the reference pixel stays
    zero; where good pixels lie on one line, or are none, nothing is. series: array of struct<t, v>, v times `scale`; velocity: its least squares slope.
    Pixels whose pairs don't link all epochs of the scene have null fit, series and velocity. Rows with a null or NaN are left out, repeated pairs of a pixel averaged.
    """
    spark = pairs.sparkSession
    kind = dict(pairs.dtypes)[key]
    double = [F.col(c).cast("double").alias(to) for c, to in ((x, "_x"), (y, "_y"), (i, "_i"), (j, "_j"), (value, "_v"), (coherence, "_c"))]
    rows = pairs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), *double)
    for c in ("_x", "_y", "_i", "_j", "_v", "_c"):
        rows = rows.filter(F.col(c).isNotNull() & ~F.isnan(c))
    network = rows.groupBy("_i", "_j").agg(F.avg("_c").alias("_w")).orderBy("_i", "_j").limit(most + 1).collect()
    if len(network) > most:
        raise ValueError(f"a network of more than {most} pairs")
    if not network:
        return spark.createDataFrame([], f"{key} {kind}, {x} double, {y} double, mean_coherence double, fit double, good boolean, series array<struct<t: double, v: double>>, velocity double")
    times = sorted({t for p in network for t in (p._i, p._j)})
    place = {t: n for n, t in enumerate(times)}
    b = np.zeros((len(network), len(times)))
    for n, p in enumerate(network):
        b[n, place[p._j]] += 1
        b[n, place[p._i]] -= 1
    b, w = b[:, 1:], np.clip([p._w for p in network], 1e-3, None)
    numbers = spark.createDataFrame([(p._i, p._j, n) for n, p in enumerate(network)], "_i double, _j double, _p int")
    rows = rows.join(F.broadcast(numbers), ["_i", "_j"])
    best = rows.groupBy("_k").agg(F.size(F.collect_set("_p")).alias("_n"), F.avg("_c").alias("_c"), F.min("_x").alias("_x"), F.min("_y").alias("_y"))
    (reference,) = best.orderBy(F.desc("_n"), F.desc(F.round("_c", 9)), "_k").limit(1).collect()
    zero = np.full(len(network), np.nan)
    for r in rows.filter(F.col("_k") == F.lit(reference._k)).groupBy("_p").agg(F.avg("_v").alias("_v")).collect():
        zero[r._p] = r._v
    inverse = _linking(b, w) if np.isfinite(zero).all() else None

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            u = np.full((len(batch), len(zero)), np.nan)
            for n, (p, v) in enumerate(zip(batch["_p"], batch["_v"], strict=True)):
                count = np.bincount(p, minlength=len(zero))
                u[n, count > 0] = np.bincount(p, weights=v, minlength=len(zero))[count > 0] / count[count > 0]
            u -= zero
            known = np.isfinite(u)
            phi, fit = np.full((len(batch), len(times)), np.nan), np.full(len(batch), np.nan)
            patterns, of = np.unique(known, axis=0, return_inverse=True)
            for n, pattern in enumerate(patterns):
                solve = inverse if pattern.all() and inverse is not None else _linking(b[pattern], w[pattern])
                if solve is not None:
                    mine = np.flatnonzero(of.ravel() == n)
                    own = u[np.ix_(mine, np.flatnonzero(pattern))]
                    phi[mine, 0], phi[mine, 1:] = 0.0, own @ solve.T
                    fit[mine] = np.abs(np.exp(1j * (own - phi[mine, 1:] @ b[pattern].T)).mean(axis=1))
            linked = np.isfinite(fit)
            yield batch.drop(columns=["_p", "_v"]).assign(_fit=np.where(linked, fit, None), _phi=[p.tolist() if ok else None for p, ok in zip(phi, linked, strict=True)])

    pixels = rows.groupBy("_k").agg(F.min("_x").alias("_x"), F.min("_y").alias("_y"), F.avg("_c").alias("_c"), F.collect_list("_p").alias("_p"), F.collect_list("_v").alias("_v"))
    solved = kept(pixels.mapInPandas(invert, f"_k {kind}, _x double, _y double, _c double, _fit double, _phi array<double>"))
    solved = solved.withColumn("_good", (F.col("_c") >= least_coherence) & F.coalesce(F.col("_fit") >= least_fit, F.lit(False)))
    planes = plane(solved.filter("_good").select("_x", "_y", F.posexplode("_phi").alias("_e", "_z")), ["_e"], "_x", "_y", "_z").collect()
    tilt = np.zeros((len(times), 2))
    for p in planes:
        tilt[p._e] = (p.plane_x or 0.0, p.plane_y or 0.0)
    dx, dy = F.col("_x") - reference._x, F.col("_y") - reference._y
    at = lambda k, n: F.lit(tilt[:, n].tolist())[k]
    levelled = F.transform("_phi", lambda v, k: F.struct(F.lit(times)[k].alias("t"), ((v - at(k, 0) * dx - at(k, 1) * dy) * scale).alias("v")))
    off = np.array(times) - np.mean(times)
    share = (off / max((off * off).sum(), 1e-300)).tolist()
    velocity = F.aggregate(F.transform("_series", lambda s, k: s["v"] * F.lit(share)[k]), F.lit(0.0), lambda acc, v: acc + v)
    return solved.withColumn("_series", levelled).select(F.col("_k").alias(key), F.col("_x").alias(x), F.col("_y").alias(y), F.col("_c").alias("mean_coherence"), F.col("_fit").alias("fit"), F.col("_good").alias("good"), F.col("_series").alias("series"), velocity.alias("velocity"))
