"""Connected components and density clusters over points and cells, as joins repeated until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import tiles
from .joins import radius_pairs
from .lineage import kept


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: id; edges: a, b in one direction or both. id and component, the smallest id that reaches it.

    Every round hangs the larger neighbours of a node on its smallest, then the smaller ones, until edges are stars: few rounds even for long chains.
    """
    links = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = kept(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        links = kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("u").alias("id"), F.col("v").alias("_root"))
    return nodes.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("_root", "id").alias("component"))


def dbscan(points: DataFrame, key: str, eps: float, least: int, xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """key and cluster: the smallest core key of the cluster; a border point joins the lowest cluster in reach; noise is null. A point counts itself.

    Core points of one cell narrower than eps are one cluster, so components are of cells, and pairs of points are never kept: a crowd costs no more than its distinct places.
    """
    rows = points.select(key, *xy)
    placed = kept(tiles.places(rows, xy, n=F.count(F.lit(1)), low=F.min(key)))
    counts = tiles.within(placed, placed, eps, {"n": F.sum("n")}).select("x", "y", (F.col("n") >= least).alias("_core"))
    told = kept(placed.select("x", "y", "low").join(counts, ["x", "y"]))
    inner, side = told.filter("_core"), eps / 1.5
    cell = [F.floor(F.col("x") / side).alias("_gx"), F.floor(F.col("y") / side).alias("_gy")]
    ids = inner.groupBy(*cell).agg(F.min("low").alias("id"))
    core = kept(inner.select("x", "y", *cell).join(ids, ["_gx", "_gy"]).select("x", "y", "id"))
    labels = kept(components(core.select("id"), tiles.touching(core, eps)))
    cored = core.join(labels, "id").select("x", "y", "component")
    outer = told.filter(~F.col("_core")).select("x", "y")
    border = radius_pairs(outer, cored, eps).groupBy(F.col("l.x").alias("x"), F.col("l.y").alias("y")).agg(F.min("r.component").alias("component"))
    return tiles.at_place(rows, cored.unionByName(border), xy, "left").select(key, F.col("component").alias("cluster"))


def cell_components(cells: DataFrame, height: int, diagonal: bool = True, least: int = 1) -> DataFrame:
    """r, c, component (r * height + c of its first cell) and size, of 8- or 4-connected cells; components under `least` cells are dropped. height: columns of the grid."""
    ids = kept(cells.select("r", "c", (F.col("r") * height + F.col("c")).cast("long").alias("id")))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    around = F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in steps])
    edges = ids.select(F.col("id").alias("a"), F.inline(around)).join(ids.select("r", "c", F.col("id").alias("b")), ["r", "c"]).select("a", "b")
    found = components(ids, edges)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    return ids.join(found, "id").join(sizes, "component").select("r", "c", "component", "size")


def cluster_summary(points: DataFrame, least: int) -> DataFrame:
    """points: cluster, grade (0-2), x, y, score. Per cluster with at least `least` elevated points: how many, how many of danger, the centre, the worst score and the alarm."""
    rows = points.filter(F.col("cluster").isNotNull() & (F.col("grade") > 0))
    out = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade") == 2).alias("n_danger"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.max("score").alias("score"))
    return out.filter(F.col("n") >= least).withColumn("alarm", F.when(F.col("score") >= 3, F.lit("red")).when(F.col("score") >= 2, F.lit("orange")).otherwise(F.lit("yellow")))


def keep_last(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and new in one, of rows of one key the last: new over old, then by an explicit `seq`."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc("seq"))
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_new")
