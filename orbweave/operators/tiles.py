"""Points that meet points tile by tile in arrays, one row per distinct place: no pair of points ever becomes a row.

Equal places are one (with sums, tops or a first key of their rows), so work follows the distinct places of an area and not the
rows on them. A task sorts its tiles and holds the right places of one tile and its neighbours, and a bounded block of left ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Distances worked out at once, and left places held at once.
_BLOCK, _HELD = 1 << 18, 1 << 16

Arrays = dict[str, np.ndarray]
AROUND = tuple((dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1))


def _tiles(batches: Iterator[pa.RecordBatch], right: Sequence[str], left: Sequence[str]) -> Iterator[tuple[Arrays, Arrays]]:
    """Right and left places of each tile, out of rows sorted by tile, right ones first; left ones in blocks."""
    at, rights, lefts, held = None, [], [], 0

    def joined(parts: list[Arrays], columns: Sequence[str]) -> Arrays:
        return {c: np.concatenate([p[c] for p in parts]) for c in columns}

    for batch in batches:
        if batch.num_rows == 0:
            continue
        a = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        cx, cy, side = a["_cx"], a["_cy"], a["_side"]
        cuts = np.flatnonzero((cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1]) | (side[1:] != side[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cx)], strict=True):
            tile = (cx[lo], cy[lo])
            if tile != at or held > _HELD:
                if rights and lefts:
                    yield joined(rights, right), joined(lefts, left)
                lefts, held = [], 0
                if tile != at:
                    at, rights = tile, []
            if side[lo] == 0:
                rights.append({c: a[c][lo:hi] for c in right})
            elif rights:
                lefts.append({c: a[c][lo:hi] for c in left})
                held += hi - lo
    if rights and lefts:
        yield joined(rights, right), joined(lefts, left)


def _blocks(left: Arrays, right: Arrays, radius: float) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Blocks of left places with the stretch of right ones within the radius along x (both in order of x), and their squared distances."""
    lx, rx = left["x"], right["x"]
    slack = radius + 1e-9 * (radius + max(np.abs(lx).max(), np.abs(rx).max())) if np.isfinite(radius) else np.inf
    step, n = max(1, _BLOCK // len(rx)), 0
    while n < len(lx):
        rows = slice(n, min(n + step, len(lx)))
        lo, hi = np.searchsorted(rx, lx[rows][0] - slack, "left"), np.searchsorted(rx, lx[rows][-1] + slack, "right")
        n = rows.stop
        if hi > lo:
            dx, dy = lx[rows, None] - rx[None, lo:hi], left["y"][rows, None] - right["y"][None, lo:hi]
            dx *= dx
            dy *= dy
            dx += dy
            yield rows, slice(lo, hi), dx


def _in_order(a: Arrays) -> Arrays:
    order = np.argsort(a["x"], kind="stable")
    return {n: c[order] for n, c in a.items()}


def _meet(left: DataFrame, right: DataFrame, size: float, order: Sequence[str], around: Sequence[tuple[int, int]] = AROUND) -> DataFrame:
    """Both sides (x, y and columns) in one table by tile: left places in their own, right ones in those around. Columns of one side are null on the other."""
    cx, cy = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    real = "abs(x) < double('infinity') AND abs(y) < double('infinity')"
    a = left.filter(real).select(F.lit(1).alias("_side"), cx.alias("_cx"), cy.alias("_cy"), *left.columns)
    spread = F.array(*[F.struct((cx + dx).alias("_cx"), (cy + dy).alias("_cy")) for dx, dy in around])
    b = right.filter(real).select(F.lit(0).alias("_side"), F.inline(spread), *right.columns)
    return a.unionByName(b, allowMissingColumns=True).repartition("_cx", "_cy").sortWithinPartitions("_cx", "_cy", "_side", *order)


def places(rows: DataFrame, xy: Sequence[str], **columns: Column) -> DataFrame:
    """x, y and aggregates of the rows of each distinct place."""
    at = [F.col(c).cast("double").alias(n) for c, n in zip(xy, ("x", "y"), strict=True)]
    return rows.groupBy(*at).agg(*[c.alias(n) for n, c in columns.items()]) if columns else rows.select(*at).distinct()


def at_place(rows: DataFrame, found: DataFrame, xy: Sequence[str], how: str = "inner") -> DataFrame:
    """rows with what found (x, y and other columns) tells of their place."""
    named = found.withColumnsRenamed({"x": "_px", "y": "_py"})
    return rows.join(named, (F.col(xy[0]).cast("double") == F.col("_px")) & (F.col(xy[1]).cast("double") == F.col("_py")), how).drop("_px", "_py")


def within(left: DataFrame, right: DataFrame, radius: float, sums: Mapping[str, Column], tops: Mapping[str, Column] | None = None, xy: Sequence[str] = ("x", "y"), other: Sequence[str] = ("x", "y")) -> DataFrame:
    """x, y and the sums and tops (aggregates of right rows, as numbers) over all right rows within the radius, for each distinct place of left that has any."""
    tops = tops or {}
    names, highs, columns = list(sums), list(tops), [*sums, *tops]
    told = {**{n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in sums.items()}, **{n: F.coalesce(c.cast("double"), F.lit(float("-inf"))) for n, c in tops.items()}}
    met = _meet(places(left, xy), places(right, other, **told), radius, [])
    squared = radius * radius

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for right_, left_ in _tiles(batches, ["x", "y", *columns], ["x", "y"]):
            r, l = _in_order(right_), _in_order(left_)
            weights = np.column_stack([r["x"], *[r[n] for n in names]])[:, 1:]
            finite = bool(np.isfinite(weights).all())
            any_, added = np.zeros(len(l["x"]), dtype=bool), np.zeros((len(l["x"]), len(names)))
            top = {n: np.full(len(l["x"]), -np.inf) for n in highs}
            for rows, those, d in _blocks(l, r, radius):
                near = d <= squared
                any_[rows] = near.any(axis=1)
                if finite:
                    added[rows] = near.astype(np.float64) @ weights[those]
                else:
                    for k in range(len(names)):
                        added[rows, k] = np.where(near, weights[None, those, k], 0.0).sum(axis=1)
                for n in highs:
                    top[n][rows] = np.where(near, r[n][None, those], -np.inf).max(axis=1)
            out = [l["x"][any_], l["y"][any_], *added[any_].T, *[top[n][any_] for n in highs]]
            lost = [None] * (2 + len(names)) + [np.isneginf(c) for c in out[2 + len(names) :]]
            yield pa.RecordBatch.from_arrays([pa.array(c, mask=m) for c, m in zip(out, lost, strict=True)], names=["x", "y", *columns])

    return met.mapInArrow(tell, ", ".join(f"{c} double" for c in ["x", "y", *columns]))


def nearest(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """left and right: distinct places x, y; right in order of `key`. x, y, d, nx, ny: the nearest right place (the smallest key of several as near), if it is within `size`."""
    met = _meet(left, right, size, ["key"]).drop("key")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for right_, left_ in _tiles(batches, ["x", "y"], ["x", "y"]):
            right_["key"] = np.arange(len(right_["x"]))
            r, l = _in_order(right_), _in_order(left_)
            best, of = np.full(len(l["x"]), np.inf), np.zeros(len(l["x"]), dtype=int)
            for rows, those, d in _blocks(l, r, size):
                np.sqrt(d, out=d)
                low = d.min(axis=1)
                # Of those as near the first by key: places are in order of x here.
                k = np.where(d == low[:, None], r["key"][None, those], len(r["x"])).min(axis=1)
                best[rows], of[rows] = low, k
            fine = best <= size
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (l["x"][fine], l["y"][fine], best[fine], right_["x"][of[fine]], right_["y"][of[fine]])], names=["x", "y", "d", "nx", "ny"])

    return met.mapInArrow(tell, "x double, y double, d double, nx double, ny double")


def touching(cells: DataFrame, radius: float) -> DataFrame:
    """a, b: ids of cells of which some places are within the radius of each other. cells: places x, y and the id of the cell of width radius / 1.5 that holds them."""
    ahead = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    met = _meet(cells, cells, radius / 1.5, ["id"], ahead)
    squared, kind = radius * radius, to_arrow_type(cells.schema["id"].dataType)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, l in _tiles(batches, ["x", "y", "id"], ["x", "y", "id"]):
            starts = [0, *(np.flatnonzero(r["id"][1:] != r["id"][:-1]) + 1).tolist(), len(r["id"])]
            own, found = _in_order({c: l[c] for c in ("x", "y")}), []
            for lo, hi in zip(starts, starts[1:], strict=False):
                cell = _in_order({c: r[c][lo:hi] for c in ("x", "y")})
                if any((d <= squared).any() for _, _, d in _blocks(own, cell, radius)):
                    found.append(lo)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([l["id"][0]] * len(found), kind), pa.array(r["id"][found], kind)], names=["a", "b"])

    of = cells.schema["id"].dataType.simpleString()
    return met.mapInArrow(tell, f"a {of}, b {of}").distinct()


def first_ring(points: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """x, y, id: the first ring (by order) that holds each distinct place. points: x, y; rings: id (a long), order, rx and ry (corners). Rings go to the cells of their boxes; a place that is settled is tested no more."""
    low, high = (lambda v, f=f: F.floor(f(v) / cell) for f in (F.array_min, F.array_max))
    real = "abs(x) < double('infinity') AND abs(y) < double('infinity')"
    empty = F.lit(None).cast("array<double>")
    cover = rings.select("*", F.explode(F.sequence(low("rx"), high("rx"))).alias("_cx")).select("*", F.explode(F.sequence(low("ry"), high("ry"))).alias("_cy"))
    b = cover.select(F.lit(0).alias("_side"), "_cx", "_cy", "id", "order", "rx", "ry", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    a = points.filter(real).select(F.lit(1).alias("_side"), F.floor(F.col("x") / cell).alias("_cx"), F.floor(F.col("y") / cell).alias("_cy"), F.lit(-1).cast("long").alias("id"), F.lit(None).cast(rings.schema["order"].dataType).alias("order"), empty.alias("rx"), empty.alias("ry"), "x", "y")
    met = a.unionByName(b).repartition("_cx", "_cy").sortWithinPartitions("_cx", "_cy", "_side", "order").drop("order")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, l in _tiles(batches, ["id", "rx", "ry"], ["x", "y"]):
            x, y, of = l["x"], l["y"], np.full(len(l["x"]), -1, dtype=np.int64)
            left = np.arange(len(x))
            for id_, ax, ay in zip(r["id"], r["rx"], r["ry"], strict=True):
                box = np.flatnonzero((x[left] >= ax.min()) & (x[left] <= ax.max()) & (y[left] >= ay.min()) & (y[left] <= ay.max()))
                if not len(box):
                    continue
                px, py = x[left[box]], y[left[box]]
                odd = np.zeros(len(box), dtype=bool)
                for x0, y0, x1, y1 in zip(ax, ay, np.roll(ax, -1), np.roll(ay, -1), strict=True):
                    if y0 != y1:
                        odd ^= ((y0 > py) != (y1 > py)) & (px < x0 + (py - y0) * (x1 - x0) / (y1 - y0))
                if odd.any():
                    of[left[box[odd]]] = id_
                    left = np.delete(left, box[odd])
                    if not len(left):
                        break
            some = of >= 0
            yield pa.RecordBatch.from_arrays([pa.array(x[some]), pa.array(y[some]), pa.array(of[some])], names=["x", "y", "id"])

    return met.mapInArrow(tell, "x double, y double, id long")
