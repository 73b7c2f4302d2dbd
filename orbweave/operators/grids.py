"""Cells of polygons by hierarchical covers, and values carried from one grid to another."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .lineage import kept
from .shapes import edges
from .tiles import _tiles


class Grid(NamedTuple):
    """Square cells: cell (r, c) reaches from (x0 + c * size, y0 + r * size) to the next."""

    size: float
    x0: float = 0.0
    y0: float = 0.0


def _touches(s: Column, x: Column, y: Column, side: float) -> Column:
    """Whether a segment meets the closed box of that side from (x, y): their shadows on both axes and across the segment overlap."""
    dx, dy, half = s["bx"] - s["ax"], s["by"] - s["ay"], side / 2
    across = dx * (y + half - s["ay"]) - dy * (x + half - s["ax"])
    reach = lambda a, b, low: (F.greatest(a, b) >= low) & (F.least(a, b) <= low + side)
    return reach(s["ax"], s["bx"], x) & reach(s["ay"], s["by"], y) & (F.abs(across) <= half * (F.abs(dx) + F.abs(dy)))


def _crosses(s: Column, x: Column, y: Column) -> Column:
    """1 if the ray from (x, y) to the right crosses the segment."""
    apart = (s["ay"] > y) != (s["by"] > y)
    return F.when(apart & (x < s["ax"] + (y - s["ay"]) * F.try_divide(s["bx"] - s["ax"], s["by"] - s["ay"])), 1).otherwise(0)


def _settled(rows: DataFrame, key: str, level: int) -> DataFrame:
    """Blocks of a level that are inside become done, those outside go, those on the outline (or cells) are cut in four (or tested by their centre)."""
    side = float(2**level)
    x, y = F.col("c") * side, F.col("r") * side
    right = F.filter("_e", lambda s: (F.greatest(s["ay"], s["by"]) >= y) & (F.least(s["ay"], s["by"]) <= y + side) & (F.greatest(s["ax"], s["bx"]) >= x))
    rows = rows.withColumn("_e", F.when(~F.col("_done"), right).otherwise(F.col("_e")))
    odd = F.aggregate("_e", F.lit(0), lambda n, s: n + _crosses(s, x + side / 2, y + side / 2)) % 2 == 1
    cut = F.exists("_e", lambda s: _touches(s, x, y, side)) if level else F.lit(False)
    rows = rows.withColumn("_cut", ~F.col("_done") & cut).filter(F.col("_done") | F.col("_cut") | odd)
    block = lambda down, r, c, e: F.struct(down.alias("level"), r.alias("r"), c.alias("c"), e.alias("_e"))
    four = F.array(*[block(F.lit(level - 1), F.col("r") * 2 + i, F.col("c") * 2 + j, F.col("_e")) for i in (0, 1) for j in (0, 1)])
    own = F.array(block(F.col("level"), F.col("r"), F.col("c"), F.slice("_e", 1, 0)))
    return rows.select(key, (~F.col("_cut")).alias("_done"), F.inline(F.when(F.col("_cut"), four).otherwise(own)))


def cover(polygons: DataFrame, key: str, rings: str, grid: Grid, levels: int = 5) -> DataFrame:
    """key, level, r, c: disjoint blocks of 2 ** level cells a side that hold just the cells whose centres are in each polygon.

    rings: array of open rings, shells and holes alike (a point is inside if it is within an odd number of them). Blocks of the top level are cut in four where the outline
    runs through them, and carry the edges on that can still matter below; blocks off the outline are settled by one point. Polygons that are null, or without rings, have none.
    """
    unit = lambda v, origin: (v - origin) / grid.size
    outline = F.transform(F.flatten(F.transform(F.col(rings), edges)), lambda s: F.struct(
        unit(s["a"]["x"], grid.x0).alias("ax"), unit(s["a"]["y"], grid.y0).alias("ay"), unit(s["b"]["x"], grid.x0).alias("bx"), unit(s["b"]["y"], grid.y0).alias("by")))
    tiles = lambda v: F.sequence(F.floor(F.array_min(F.transform("_e", lambda s: s[v])) / 2**levels), F.floor(F.array_max(F.transform("_e", lambda s: s[v])) / 2**levels))
    rows = polygons.select(key, outline.alias("_e")).filter(F.size("_e") > 0)
    rows = rows.select(key, "_e", tiles("ay").alias("_r"), F.explode(tiles("ax")).alias("c")).select(key, "_e", F.explode("_r").alias("r"), "c")
    rows = rows.select(key, F.lit(levels).alias("level"), "r", "c", "_e", F.lit(False).alias("_done"))
    for level in range(levels, -1, -1):
        rows = _settled(rows, key, level)
    return rows.select(key, "level", "r", "c")


def cells_within(cells: DataFrame, polygons: DataFrame, key: str, rings: str, grid: Grid, levels: int = 5) -> DataFrame:
    """key and the columns of cells (r, c, ...) for each cell whose centre is in a polygon; one row per polygon where they overlap.

    Whole blocks meet their cells by block; only blocks along outlines are unpacked to cells. Repeated keys are distinct polygons of one zone, whose cells count once each.
    """
    columns = [F.col(f"_v.{c}").alias(c) for c in cells.columns]
    blocks = kept(cover(polygons, key, rings, grid, levels).select(F.col(key).alias("_key"), "level", "r", "c"))
    values = cells.select("r", "c", F.struct(*cells.columns).alias("_v"))
    tiled = values.select(F.floor(F.col("r") / 2**levels).alias("r"), F.floor(F.col("c") / 2**levels).alias("c"), "_v")
    whole = tiled.join(blocks.filter(F.col("level") == levels).select("_key", "r", "c"), ["r", "c"])
    side = F.pow(F.lit(2), F.col("level")).cast("long")
    along = lambda v: F.sequence(F.col(v) * side, (F.col(v) + 1) * side - 1)
    parts = blocks.filter(F.col("level") < levels).select("_key", F.explode(along("r")).alias("r"), along("c").alias("_c")).select("_key", "r", F.explode("_c").alias("c"))
    return whole.unionByName(values.join(parts, ["r", "c"])).select(F.col("_key").alias(key), *columns)


def _spans(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """key, _cx (row), lo, hi: runs of cells whose centres are within, out of each polygon's edges in units of cells."""
    for batch in batches:
        keys, sides = batch.column(0), [batch.column(k) for k in range(1, 5)]
        parts: list[tuple[np.ndarray, ...]] = []
        for n in range(batch.num_rows):
            ax, ay, bx, by = (np.asarray(c[n].values) for c in sides)
            fine = ay != by
            ax, ay, bx, by = ax[fine], ay[fine], bx[fine], by[fine]
            if not len(ax):
                continue
            slope = (bx - ax) / (by - ay)
            first, last = int(np.floor(min(ay.min(), by.min()))), int(np.ceil(max(ay.max(), by.max())))
            step = max(1, (1 << 20) // len(ax))
            for low in range(first, last + 1, step):
                r = np.arange(low, min(low + step, last + 1))
                y = r[:, None] + 0.5
                x = np.sort(np.where((ay > y) != (by > y), ax + (y - ay) * slope, np.inf), axis=1)
                x = x[:, : x.shape[1] // 2 * 2]
                row, of = np.nonzero(np.isfinite(x[:, 0::2]))
                lo, hi = np.ceil(x[row, 2 * of] - 0.5).astype(np.int64), np.ceil(x[row, 2 * of + 1] - 0.5).astype(np.int64) - 1
                some = lo <= hi
                parts.append((np.full(int(some.sum()), n), r[row[some]], lo[some], hi[some]))
            if sum(len(p[0]) for p in parts[-64:]) > 1 << 16 or len(parts) > 1024:
                yield _told(keys, parts, kind)
                parts = []
        if parts:
            yield _told(keys, parts, kind)


def _told(keys: pa.Array, parts: list[tuple[np.ndarray, ...]], kind: pa.DataType) -> pa.RecordBatch:
    of, r, lo, hi = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([keys.take(pa.array(of)).cast(kind), pa.array(r.astype(np.int64)), pa.array(lo), pa.array(hi)], names=["_key", "_cx", "lo", "hi"])


def zone_sums(cells: DataFrame, polygons: DataFrame, key: str, rings: str, grid: Grid, values: Sequence[str]) -> DataFrame:
    """key and, for each value v, v_n, v_sum, v_low and v_high of the cells (r, c, values as numbers) whose centres are in each polygon, as cells_within() finds them; without a row per polygon and cell.

    A polygon is runs of cells of a row; a row's runs meet its cells in one task, which adds up each run. Polygons without cells have no row.
    """
    unit = lambda v, origin: (v - origin) / grid.size
    outline = F.flatten(F.transform(F.col(rings), edges))
    side = lambda e, v, origin: F.transform("_e", lambda s: unit(s[e][v], origin).cast("double")).alias(e + v)
    sides = [side(e, v, origin) for e in "ab" for v, origin in (("x", grid.x0), ("y", grid.y0))]
    of = polygons.select(F.col(key).alias("_key"), outline.alias("_e")).filter(F.size("_e") > 0).select("_key", *sides)
    of = of.filter(F.forall("ax", lambda x: x.isNotNull()) & F.forall("ay", lambda y: y.isNotNull()))
    field = polygons.schema[key].dataType
    kind, name = to_arrow_type(field), field.simpleString()  # keys are numbers or texts
    runs = of.repartition(of.sparkSession.sparkContext.defaultParallelism * 2).mapInArrow(lambda batches: _spans(batches, kind), f"_key {name}, _cx long, lo long, hi long")
    number = {f"_v{n}": F.col(v).cast("double") for n, v in enumerate(values)}
    right = cells.filter("r IS NOT NULL AND c IS NOT NULL").select(
        F.lit(0).alias("_side"), F.col("r").cast("long").alias("_cx"), F.lit(0).cast("long").alias("_cy"), F.col("c").cast("long").alias("lo"), F.col("c").cast("long").alias("hi"), F.lit(0).cast(field).alias("_key"),
        *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in number.items()], *[c.isNotNull().cast("double").alias(f"{n}n") for n, c in number.items()])
    columns = [f"{n}{e}" for n in number for e in ("", "n")]
    left = runs.select(F.lit(1).alias("_side"), "_cx", F.lit(0).cast("long").alias("_cy"), "lo", "hi", "_key", *[F.lit(0.0).alias(c) for c in columns])
    met = right.select(*left.columns).unionByName(left).repartition("_cx").sortWithinPartitions("_cx", "_side", "lo")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, l in _tiles(batches, ["lo", *columns], ["lo", "hi", "_key"]):
            a, b = np.searchsorted(r["lo"], l["lo"], "left"), np.searchsorted(r["lo"], l["hi"], "right")
            some = np.flatnonzero(b > a)
            if not len(some):
                continue
            cuts = np.column_stack([a[some], b[some]]).ravel()
            total = lambda f, x, rest: f.reduceat(np.append(x, rest), cuts)[::2]
            out = [pa.array(l["_key"][some], kind, from_pandas=True)]
            for n in number_names:
                there = r[f"{n}n"] > 0
                out += [pa.array(total(np.add, r[f"{n}n"], 0.0)), pa.array(total(np.add, np.where(there, r[n], 0.0), 0.0)), pa.array(total(np.minimum, np.where(there, r[n], np.inf), np.inf)), pa.array(total(np.maximum, np.where(there, r[n], -np.inf), -np.inf))]
            yield pa.RecordBatch.from_arrays(out, names=names)

    number_names = list(number)
    names = ["_key", *[f"{n}_{e}" for n in number for e in ("n", "sum", "low", "high")]]
    sums = met.mapInArrow(add, f"_key {name}, " + ", ".join(f"{c} double" for c in names[1:]))
    return sums.groupBy(F.col("_key").alias(key)).agg(*[c for n, v in zip(number, values, strict=True) for c in (
        F.sum(f"{n}_n").cast("long").alias(f"{v}_n"), F.when(F.sum(f"{n}_n") > 0, F.sum(f"{n}_sum")).alias(f"{v}_sum"),
        F.when(F.sum(f"{n}_n") > 0, F.min(f"{n}_low")).alias(f"{v}_low"), F.when(F.sum(f"{n}_n") > 0, F.max(f"{n}_high")).alias(f"{v}_high"))])


def _reached(low: Column, high: Column, origin: float, size: float) -> Column:
    """Numbers of the cells from low to high."""
    return F.sequence(F.floor((low - origin) / size), F.ceil((high - origin) / size) - 1)


def averaged(cells: DataFrame, v: str, source: Grid, target: Grid, by: Sequence[str] = ()) -> DataFrame:
    """by..., r, c, v, covered: cells of another grid, of any size and origin, with the mean of v weighted by the area that cells share, and the part of the target cell that valid cells cover.

    Cells without v, or NaN, count for nothing, as do slivers of rounding (shares of a thousand millionth); a target cell without valid ones has no row. One aggregation: each source cell tells the target cells under it.
    """
    x, y = source.x0 + F.col("c") * source.size, source.y0 + F.col("r") * source.size
    valid = cells.filter(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))).select(*by, F.col(v).cast("double").alias("_v"), x.alias("_x"), y.alias("_y"))
    under = valid.withColumn("c", F.explode(_reached(F.col("_x"), F.col("_x") + source.size, target.x0, target.size))).withColumn("r", F.explode(_reached(F.col("_y"), F.col("_y") + source.size, target.y0, target.size)))
    shared = lambda low, n, origin: F.least(low + source.size, origin + (n + 1) * target.size) - F.greatest(low, origin + n * target.size)
    weighed = under.withColumn("_w", shared(F.col("_x"), F.col("c"), target.x0) * shared(F.col("_y"), F.col("r"), target.y0)).filter(F.col("_w") > 1e-9 * min(source.size, target.size) ** 2)
    return weighed.groupBy(*by, "r", "c").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias(v), (F.sum("_w") / target.size**2).alias("covered"))


def interpolated(cells: DataFrame, v: str, source: Grid, target: Grid, by: Sequence[str] = ()) -> DataFrame:
    """by..., r, c, v, weight: bilinear values at the centres of another grid's cells. Of the four source cells round a centre those without v, or NaN, are left out and the others' weights, whose sum is `weight`, made up to one.

    A centre no valid source cell's weight reaches has no row. Each source cell tells the centres less than a cell away, so it is one aggregation without a join.
    """
    x, y = source.x0 + (F.col("c") + 0.5) * source.size, source.y0 + (F.col("r") + 0.5) * source.size
    valid = cells.filter(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))).select(*by, F.col(v).cast("double").alias("_v"), x.alias("_x"), y.alias("_y"))
    around = lambda at, origin: _reached(at - source.size - target.size / 2, at + source.size + target.size / 2, origin, target.size)
    near = valid.withColumn("c", F.explode(around(F.col("_x"), target.x0))).withColumn("r", F.explode(around(F.col("_y"), target.y0)))
    hat = lambda at, n, origin: F.greatest(F.lit(0.0), 1 - F.abs(origin + (n + 0.5) * target.size - at) / source.size)
    weighed = near.withColumn("_w", hat(F.col("_x"), F.col("c"), target.x0) * hat(F.col("_y"), F.col("r"), target.y0)).filter("_w > 1e-12")
    return weighed.groupBy(*by, "r", "c").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias(v), F.sum("_w").alias("weight"))
