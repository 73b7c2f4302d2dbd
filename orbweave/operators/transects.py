"""Values along lines over cells, and the test of a line against lines placed at random about the same point.

Placements come from hashes of seed, key and number, so reruns and lost executors repeat them; rounds go on only with the points that still lack valid lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import uniform
from .grids import Grid
from .lineage import kept


def medians(lines: DataFrame, cells: DataFrame, by: Sequence[str], values: Sequence[str], grid: Grid, step: float, least: int = 8) -> DataFrame:
    """by... and the median of each value along each line (x0, y0, x1, y1), sampled every step from its start; null with fewer than `least` samples that have the value.

    Null and NaN are no values; a line without any cell is there with nulls. by tells lines apart.
    """
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(length / step + 1e-9)), lambda n: F.coalesce(F.try_divide(n * step, length), F.lit(0.0)))
    sampled = lines.withColumn("_at", F.explode(places)).withColumns({"_x": F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("_at"), "_y": F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("_at")})
    sampled = sampled.select(*by, F.floor((F.col("_y") - grid.y0) / grid.size).alias("r"), F.floor((F.col("_x") - grid.x0) / grid.size).alias("c"))
    number = lambda v: F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double"))
    joined = sampled.join(cells.select("r", "c", *[number(v).alias(v) for v in values]), ["r", "c"])
    found = joined.groupBy(*by).agg(*[F.when(F.count(v) >= least, F.percentile(v, 0.5)).alias(v) for v in values])
    return lines.select(*by).join(found, list(by), "left")


def placed(anchors: DataFrame, key: str, first: int, last: int, radius: float, length: float, seed: int) -> DataFrame:
    """key, t, x0, y0, x1, y1: lines number first to last about each anchor (key, x, y), starting evenly spread over the disc, in any direction of the half circle."""
    tries = anchors.select(key, "x", "y", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("t"))
    number = lambda n: uniform(seed, F.col(key), F.col("t"), F.lit(n))
    tries = tries.withColumns({"_d": radius * F.sqrt(number(1)), "_a": 2 * F.pi() * number(2), "_b": F.pi() * number(3)})
    tries = tries.select(key, "t", "_b", (F.col("x") + F.col("_d") * F.cos("_a")).alias("x0"), (F.col("y") + F.col("_d") * F.sin("_a")).alias("y0"))
    return tries.select(key, "t", "x0", "y0", (F.col("x0") + length * F.cos("_b")).alias("x1"), (F.col("y0") + length * F.sin("_b")).alias("y1"))


def random_lines(anchors: DataFrame, cells: DataFrame, key: str, values: Sequence[str], grid: Grid, n: int, radius: float, length: float, step: float, seed: int, least: int = 8, rounds: int = 8) -> DataFrame:
    """key, t and the medians of the first n lines about each anchor (key, x, y; keys are unique) that have the first of the values; fewer where n * rounds placements don't give n.

    Cells out of every anchor's reach are put aside once. A round places n lines about each anchor that still lacks some.
    """
    reach = radius + length + grid.size
    tile = lambda v: F.floor(v / reach)
    around = F.array(*[F.struct((tile(F.col("y")) + i).alias("_r"), (tile(F.col("x")) + j).alias("_c")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    tiles = anchors.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.inline(around)).distinct()
    centre = lambda v, origin: origin + (F.col(v) + 0.5) * grid.size
    near = kept(cells.select("r", "c", *values, tile(centre("r", grid.y0)).alias("_r"), tile(centre("c", grid.x0)).alias("_c")).join(tiles, ["_r", "_c"], "left_semi").select("r", "c", *values))
    found, lacking = None, anchors.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    for k in range(rounds):
        lines = placed(lacking, key, k * n + 1, (k + 1) * n, radius, length, seed)
        valid = kept(medians(lines, near, [key, "t"], values, grid, step, least).filter(F.col(values[0]).isNotNull()))
        found = valid if found is None else found.unionByName(valid)
        lacking = kept(lacking.join(found.groupBy(key).count().filter(F.col("count") >= n), key, "left_anti"))
        if lacking.isEmpty():
            break
    order = F.row_number().over(Window.partitionBy(key).orderBy("t"))
    return found.withColumn("_n", order).filter(F.col("_n") <= n).drop("_n")


def against(observed: DataFrame, lines: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """observed (key and values) with, for each value v, v_n lines that have it, their mean v_mean, v_rank (the percentage of them below the observed) and v_z (the observed in their standard deviations from the mean)."""

    def stats(v: str) -> list[Column]:
        seen = F.first(f"_{v}")
        return [F.count(v).alias(f"{v}_n"), F.avg(v).alias(f"{v}_mean"), (100 * F.avg((F.col(v) < F.col(f"_{v}")).cast("double"))).alias(f"{v}_rank"), F.try_divide(seen - F.avg(v), F.stddev_samp(v) + 1e-9).alias(f"{v}_z")]

    both = lines.join(observed.select(key, *[F.col(v).alias(f"_{v}") for v in values]), key)
    tested = both.groupBy(key).agg(*[c for v in values for c in stats(v)])
    counts = {f"{v}_n": F.coalesce(f"{v}_n", F.lit(0)) for v in values}
    return observed.select(key, *values).join(tested, key, "left").withColumns(counts)
