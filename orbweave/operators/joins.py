"""Spatial, temporal and interval joins as equi-joins on buckets, so that every one of them shuffles by key.

No join here builds a cross product: a predicate of distance or range becomes an equality of cells, and the exact
predicate filters what the cells bring together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import tiles
from .lineage import kept


def interval_first(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, start: str, end: str, order: str, into: Sequence[str]) -> DataFrame:
    """left with the columns `into` of the first right row (by `order`) whose [start, end) holds value; without one, whose [start, end] does; else null.

    The intervals of a key (strata of a borehole) travel as one array in their order, so left rows are neither multiplied nor told apart by ids.
    """
    item = F.struct(F.col(order).alias("_o"), F.col(start).alias("_s"), F.col(end).alias("_e"), *[F.col(c).alias(f"_{c}") for c in into])
    lists = right.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_i"))
    v = F.col(value)
    first = F.get(F.filter("_i", lambda x: (v >= x["_s"]) & (v < x["_e"])), F.lit(0))
    closed = F.get(F.filter("_i", lambda x: (v >= x["_s"]) & (v <= x["_e"])), F.lit(0))
    found = left.join(lists, list(keys), "left").withColumn("_b", F.coalesce(first, closed))
    return found.select(*left.columns, *[F.col(f"_b._{c}").alias(c) for c in into])


def _merged(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, other_at: str, values: Sequence[str]) -> DataFrame:
    """Both sides in one table: rows of left keep their columns in _l, rows of right theirs in _r."""
    a = left.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(at).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"))
    b = right.filter(F.col(other_at).isNotNull()).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(other_at).alias("_t"), F.lit(None).alias("_l"), F.struct(F.col(other_at).alias("_at"), *values).alias("_r"))
    return a.unionByName(b)


def _sides(merged: DataFrame, by: Sequence[str]) -> tuple[Window, Window]:
    keys = [f"_k{i}" for i in range(len(by))]
    before = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return before, after


def brackets(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, other_at: str, values: Sequence[str]) -> DataFrame:
    """left with _before and _after: the right rows nearest in time at or before, and at or after, as structs of _at and values. One shuffle by `by`."""
    merged = _merged(left, right, by, at, other_at, values)
    before, after = _sides(merged, by)
    both = merged.withColumn("_before", F.last("_r", ignorenulls=True).over(before)).withColumn("_after", F.first("_r", ignorenulls=True).over(after))
    known = F.col("_t").isNotNull()
    return both.filter(F.col("_l").isNotNull()).select("_l.*", F.when(known, F.col("_before")).alias("_before"), F.when(known, F.col("_after")).alias("_after"))


def asof_nearest(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, other_at: str, values: Sequence[str], tolerance: float) -> DataFrame:
    """The right row nearest in time on either side, the earlier of two as near; beyond the tolerance, and for null times, null. Times are numbers."""
    both = brackets(left, right, by, at, other_at, values)
    back, ahead = F.col(at) - F.col("_before._at"), F.col("_after._at") - F.col(at)
    best = F.when(F.col("_after").isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    best = F.when(F.abs(best["_at"] - F.col(at)) <= tolerance, best)
    return both.select(*left.columns, best["_at"].alias(f"{other_at}_near"), *[best[v].alias(v) for v in values])


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, other_at: str, values: Sequence[str]) -> DataFrame:
    """The last right row at or before."""
    both = brackets(left, right, by, at, other_at, values)
    return both.select(*left.columns, F.col("_before._at").alias(f"{other_at}_before"), *[F.col(f"_before.{v}").alias(v) for v in values])


def asof_forward(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, other_at: str) -> DataFrame:
    """left with `next`: the first right time strictly after."""
    merged = _merged(left, right, by, at, other_at, [])
    keys = [f"_k{i}" for i in range(len(by))]
    # Rows of left sort after rows of right at the same time, so what follows is strictly later.
    after = Window.partitionBy(*keys).orderBy("_t", F.col("_l").isNotNull().cast("int")).rowsBetween(1, Window.unboundedFollowing)
    found = merged.withColumn("next", F.first("_r", ignorenulls=True).over(after)["_at"])
    return found.filter(F.col("_l").isNotNull()).select("_l.*", "next")


def interpolated(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, other_at: str, value: str, gap: float) -> DataFrame:
    """Linear between neighbours at most 2 * gap apart; at the ends the nearest value up to gap away; else null."""
    both = brackets(left, right, by, at, other_at, [value])
    t, t0, t1 = F.col(at), F.col("_before._at"), F.col("_after._at")
    v0, v1 = F.col(f"_before.{value}"), F.col(f"_after.{value}")
    line = F.when(t1 == t0, v0).when(t1 - t0 <= 2 * gap, v0 + (v1 - v0) * (t - t0) / F.when(t1 != t0, t1 - t0))
    out = F.when(t0.isNotNull() & t1.isNotNull(), line).when(t0.isNotNull() & (t - t0 <= gap), v0).when(t1.isNotNull() & (t1 - t <= gap), v1)
    return both.select(*left.columns, out.alias(value))


def interpolated_two_sided(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, other_at: str, value: str, both_within: float, one_within: float) -> DataFrame:
    """Linear if both neighbours are within the wider bound, else the nearest of those within the narrower, else null."""
    both = brackets(left, right, by, at, other_at, [value])
    t, t0, t1 = F.col(at), F.col("_before._at"), F.col("_after._at")
    v0, v1 = F.col(f"_before.{value}"), F.col(f"_after.{value}")
    line = F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * (t - t0) / F.when(t1 != t0, t1 - t0))
    near0, near1 = F.coalesce(t - t0 <= one_within, F.lit(False)), F.coalesce(t1 - t <= one_within, F.lit(False))
    hold = F.when(near0 & (~near1 | (t - t0 <= t1 - t)), v0).when(near1, v1)
    out = F.when((t - t0 <= both_within) & (t1 - t <= both_within), line).otherwise(hold)
    return both.select(*left.columns, out.alias(value))


def cells(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor(x / size), F.floor(y / size)


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, xy: tuple[str, str] = ("x", "y"), other: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Pairs within the radius, as structs l and r, and their distance d. Right points go to the nine cells around theirs, left points to their own."""
    cx, cy = cells(F.col(xy[0]), F.col(xy[1]), radius)
    a = left.select(cx.alias("_cx"), cy.alias("_cy"), F.struct(*left.columns).alias("l"))
    ox, oy = cells(F.col(other[0]), F.col(other[1]), radius)
    around = F.array(*[F.struct((ox + dx).alias("_cx"), (oy + dy).alias("_cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    b = right.select(F.struct(*right.columns).alias("r"), F.inline(around))
    d = F.hypot(F.col(f"l.{xy[0]}") - F.col(f"r.{other[0]}"), F.col(f"l.{xy[1]}") - F.col(f"r.{other[1]}"))
    return a.join(b, ["_cx", "_cy"]).select("l", "r", d.alias("d")).filter(F.col("d") <= radius)


def nearest(left: DataFrame, right: DataFrame, key: str, other_key: str, cell: float, into: Sequence[str] = (), reach: float = float("inf"), xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """left with _near (other_key), dist and `into` of the nearest right point; the smaller key of two as near; null beyond reach or without points.

    Equal places count once. Searches cells of doubling size, at first of `cell` or of some sixteen right places if that is less: a point found
    within one cell's width is nearest for certain, and only places without one go on to the next size. The rounds are as many as the emptiest neighbourhood needs.
    """
    real = "x IS NOT NULL AND y IS NOT NULL AND abs(x) < double('infinity') AND abs(y) < double('infinity')"
    item = F.struct(F.col(other_key).alias("_near"), *[F.col(c).alias(f"_i{c}") for c in into])
    holes = kept(tiles.places(right, xy, key=F.min(other_key), _b=F.min_by(item, other_key)).filter(real))
    open_ = kept(tiles.places(left, xy).filter(real))
    told = [f(c).alias(f"{f.__name__}{c}") for c in ("x", "y") for f in (F.min, F.max)]
    span, wide = holes.agg(F.count(F.lit(1)).alias("n"), *told).first(), open_.agg(*told).first()
    ends = [(min(a, b), max(c, d)) for a, b, c, d in ((span[f"min{c}"], wide[f"min{c}"], span[f"max{c}"], wide[f"max{c}"]) for c in ("x", "y")) if a is not None and b is not None]
    extent = max((hi - lo for lo, hi in ends), default=0.0)
    done: DataFrame | None = None
    size = cell
    if ends:
        sides = [span[f"max{c}"] - span[f"min{c}"] for c in ("x", "y")]
        fair = max(math.sqrt(16 * sides[0] * sides[1] / span.n), 16 * max(sides) / span.n)
        size = min(cell, fair) if 0 < fair < math.inf else cell
    while ends:
        found = kept(tiles.nearest(open_, holes.select("x", "y", "key"), size))
        done = found if done is None else done.unionByName(found)
        open_ = kept(open_.join(found.select("x", "y"), ["x", "y"], "left_anti"))
        if size >= min(reach, extent * 1.5) or open_.isEmpty():
            break
        size *= 2
    best = ["_near", *[f"_i{c}" for c in into]]
    if done is None:
        return left.select(*left.columns, F.lit(None).cast(right.schema[other_key].dataType).alias("_near"), F.lit(None).cast("double").alias("dist"), *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in into])
    told_ = done.filter(F.col("d") <= reach).join(holes.select(F.col("x").alias("nx"), F.col("y").alias("ny"), "_b"), ["nx", "ny"]).select("x", "y", F.col("d").alias("dist"), *[F.col(f"_b.{c}").alias(c) for c in best])
    return tiles.at_place(left, told_, xy, "left").select(*left.columns, "_near", "dist", *[F.col(f"_i{c}").alias(c) for c in into])


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: x, y in an open ring, an array of struct<x, y>. Lower and left edges belong to the polygon."""
    n = F.size(ring)
    following = F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, F.lit(1), F.lit(1)))
    edges = F.zip_with(ring, following, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.when(b["y"] != a["y"], b["y"] - a["y"])))
    return F.aggregate(edges, F.lit(0), lambda acc, hit: acc + F.when(hit, 1).otherwise(0)) % 2 == 1


def polygon_first(points: DataFrame, polygons: DataFrame, key: str, ring: str, order: str, into: Sequence[str], cell: float, xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """points with the columns of the first polygon (by `order`) that holds them; null without one. Polygons go to the cells of their bounding boxes."""
    corner = lambda c: F.transform(ring, lambda p: p[c].cast("double"))
    shapes = kept(polygons.filter((F.size(ring) > 0) & F.col(order).isNotNull()).select(F.monotonically_increasing_id().alias("id"), F.col(order).alias("order"), corner("x").alias("rx"), corner("y").alias("ry"), F.struct(*into).alias("_b")))
    found = tiles.first_ring(tiles.places(points, xy), shapes.drop("_b"), cell).join(shapes.select("id", "_b"), "id").select("x", "y", "_b")
    return tiles.at_place(points, found, xy, "left").select(*points.columns, *[F.col(f"_b.{c}").alias(c) for c in into])


def pairs_within(rows: DataFrame, by: Sequence[str], at: str, days: float, index: str, ahead: int) -> DataFrame:
    """Pairs (i before j) of one group at most `days` apart and at most `ahead` places ahead, or adjacent. i and j are structs of the columns.

    Places ahead are joined by the index itself: a row offers itself to the next `ahead` indices.
    """
    a = rows.select(*by, F.struct(*rows.columns).alias("i"), F.explode(F.sequence(F.col(index) + 1, F.col(index) + ahead)).alias("_to"))
    b = rows.select(*by, F.struct(*rows.columns).alias("j"), F.col(index).alias("_to"))
    apart = F.col(f"j.{at}") - F.col(f"i.{at}")
    return a.join(b, [*by, "_to"]).filter((apart <= days) | (F.col(f"j.{index}") == F.col(f"i.{index}") + 1)).select("i", "j")


def validity(events: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: float, into: Sequence[str]) -> DataFrame:
    """events with the range that covers them (start <= at < end): ranges go to every bucket of `width` they touch, as one array a bucket; the first by start, then by the columns, of several."""
    item = F.struct(F.col(start).alias("_s"), *[F.col(c).alias(f"_{c}") for c in into], F.col(end).alias("_e"))
    spread = ranges.select(item.alias("_x"), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("_b"))
    lists = spread.groupBy("_b").agg(F.array_sort(F.collect_list("_x")).alias("_i"))
    t = F.col(at)
    found = events.withColumn("_b", F.floor(t / width)).join(lists, "_b", "left").withColumn("_x", F.get(F.filter("_i", lambda x: (x["_s"] <= t) & (t < x["_e"])), F.lit(0)))
    return found.select(*events.columns, *[F.col(f"_x._{c}").alias(c) for c in into])


def bilinear(points: DataFrame, grid: DataFrame, key: str, value: str, xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """points with the bilinear value of grid (row, col, value), cell centres at whole coordinates; null unless all four corners are there."""
    x, y = F.col(xy[0]), F.col(xy[1])
    corners = F.array(*[F.struct((F.floor(y) + dy).alias("row"), (F.floor(x) + dx).alias("col"), ((1 - F.abs(F.floor(x) + dx - x)) * (1 - F.abs(F.floor(y) + dy - y))).alias("w")) for dx in (0, 1) for dy in (0, 1)])
    four = points.select(key, F.inline(corners)).join(grid.select("row", "col", value), ["row", "col"])
    sums = four.groupBy(key).agg(F.sum(F.col("w") * F.col(value)).alias(value), F.count(value).alias("_n"))
    return points.join(sums, key, "left").select(*points.columns, F.when(F.col("_n") == 4, F.col(value)).alias(value))


def cell_means(points: DataFrame, size: float, value: str, least: int = 1, xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """cx, cy, n and the mean of value per cell of at least `least` points."""
    cx, cy = cells(F.col(xy[0]), F.col(xy[1]), size)
    return points.groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count(value).alias("n"), F.avg(value).alias(value)).filter(F.col("n") >= least)


def away_from(points: DataFrame, events: DataFrame, key: str, radius: float, n: int, seed: int) -> DataFrame:
    """At most n points, chosen by a seeded hash, with no event within the radius."""
    near = tiles.at_place(points, tiles.within(points, events, radius, {}), ("x", "y")).select(key).distinct()
    free = points.join(near, key, "left_anti")
    return free.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def fallback(rows: DataFrame, code: str, levels: Sequence[tuple[DataFrame, str]], into: str) -> DataFrame:
    """`into` from the first dictionary (table of key and `into`, and how to shorten the code) that knows the code."""
    out, found = rows, []
    for k, (names, expression) in enumerate(levels):
        out = out.withColumn(f"_c{k}", F.expr(expression)).join(names.select(F.col("key").alias(f"_c{k}"), F.col(into).alias(f"_v{k}")), f"_c{k}", "left")
        found.append(F.col(f"_v{k}"))
    return out.select(*rows.columns, F.coalesce(*found).alias(into))
