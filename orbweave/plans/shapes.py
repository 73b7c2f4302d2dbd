"""Queries of polygons and of least squares per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..catalog import query, table
from ..operators import inversion as I, joins as J, outlines as O, shapes as S
from .common import GRID, SERIES, grid, points, series

#: Axis-parallel buildings in SQL: k, x0, y0, x1, y1, owner.
_BOXES = "(SELECT s_suppkey AS k, (s_suppkey * 53 % 997)::DOUBLE AS x0, (s_suppkey * 29 % 1009)::DOUBLE AS y0, s_suppkey * 53 % 997 + 20.0::DOUBLE + s_suppkey % 30 AS x1, s_suppkey * 29 % 1009 + 15.0::DOUBLE + s_suppkey % 20 AS y1, s_suppkey % 2 AS owner FROM supplier)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x0, y0 = (k * 53 % 997).cast("double"), (k * 29 % 1009).cast("double")
    x1, y1 = x0 + 20.0 + k % 30, y0 + 15.0 + k % 20
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return table(spark, sf_dir, "supplier").select(k.alias("k"), F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1)).alias("ring"), (k % 2).alias("owner"))


_GAP = "sqrt(pow(greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)), 2) + pow(greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)), 2))"
_APART = f"(SELECT a.k AS k, b.k AS other_k, a.owner AS oa, b.owner AS ob, {_GAP} AS d FROM {_BOXES} a JOIN {_BOXES} b ON a.k <> b.k)"


@query(f"SELECT k, other_k, round(d, 6) AS d FROM {_APART} WHERE d <= 40")
def polygon_distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of buildings within the search radius; 0 where they overlap."""
    rows = _boxes(spark, sf_dir)
    return S.distances(rows, rows, "k", "k", "ring", 40.0, 60.0).select("k", "other_k", F.round("d", 6).alias("d"))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT k AS a, other_k AS b FROM {_APART} WHERE d <= 12 AND oa = ob), r(k, s) AS (SELECT k, k FROM {_BOXES} UNION SELECT e.b, r.s FROM r JOIN e ON e.a = r.k) SELECT k, min(s) AS whole FROM r GROUP BY k""")
def merge_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings of one owner that overlap or stand close, in chains."""
    return S.merged(_boxes(spark, sf_dir), "k", "owner", "ring", 12.0, 60.0)


_WALK = f"""(WITH c AS (SELECT k, unnest([0, 1, 2, 3]) AS e, unnest([x0, x1, x1, x0]) AS ax, unnest([y0, y0, y1, y1]) AS ay, unnest([x1, x1, x0, x0]) AS bx, unnest([y0, y1, y1, y0]) AS ty FROM {_BOXES}),
s AS (SELECT k, e * 6 + j AS step, ax + (bx - ax) * (j / 6.0::DOUBLE) AS x, ay + (ty - ay) * (j / 6.0::DOUBLE) AS y FROM c, range(0, 6) g(j)),
n AS (SELECT s.k, s.step, arg_min(p.k, row(sqrt(pow(p.px - s.x, 2) + pow(p.py - s.y, 2)), p.k)) AS near, min(sqrt(pow(p.px - s.x, 2) + pow(p.py - s.y, 2))) AS d FROM s, (SELECT c_custkey AS k, (c_custkey * 37 % 1000)::DOUBLE AS px, (c_custkey * 91 % 1009)::DOUBLE AS py FROM customer) p GROUP BY 1, 2) SELECT * FROM n)"""


@query(f"""WITH a AS (SELECT *, CASE WHEN near = coalesce(lag(near) OVER (PARTITION BY k ORDER BY step), last_value(near) OVER (PARTITION BY k ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) THEN 0 ELSE 1 END AS c FROM {_WALK}),
b AS (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY step) AS g0, sum(c) OVER (PARTITION BY k) AS n FROM a), g AS (SELECT *, CASE WHEN g0 = 0 THEN n ELSE g0 END AS g FROM b)
SELECT k, first(near) AS near, coalesce(min(CASE WHEN c = 1 THEN step END), min(step)) AS start, count(*) AS length, round(min(d), 6) AS d FROM g GROUP BY k, g""")
def boundary_walk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which neighbour each side of a building faces, as runs around it."""
    steps = S.boundary_samples(_boxes(spark, sf_dir), "k", "ring", 6).withColumn("id", F.concat_ws(":", "k", "step"))
    others = points(spark, sf_dir, "customer", "c_custkey")
    near = J.nearest(steps, others, "id", "k", 50.0).select("k", "step", F.col("_near").alias("near"), F.col("dist").alias("d"))
    return S.circular_runs(near, "k", "step", "near").withColumn("d", F.round("d", 6))



@query()
def greedy_iou_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions matched to references per image (a day of shipping at a supplier), by falling score."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") * 10_000 + F.datediff("l_shipdate", F.lit("1990-01-01"))).alias("image"), F.col("l_partkey").alias("pred"), F.col("l_linenumber").alias("ref"))
    pairs = rows.agg(F.max("l_extendedprice").alias("score"), F.max(F.col("l_discount") * 10).alias("iou"))
    return S.greedy_matches(pairs, ["image"], "score", "iou", 0.5)


@query(f"SELECT u, i AS epoch, round(v - first_value(v) OVER (PARTITION BY u ORDER BY i), 5) AS v FROM {SERIES}")
def small_baseline_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs out of consistent differences of pairs: the differences from the first epoch."""
    rows = series(spark, sf_dir).select("u", "i", "t", "v")
    pairs = J.pairs_within(rows, ["u"], "t", 1.5, "i", 3).select("i.u", F.col("i.i").alias("a"), F.col("j.i").alias("b"), (F.col("j.v") - F.col("i.v")).alias("dv"))
    return I.small_baseline(pairs, ["u"], "a", "b", "dv").select("u", "epoch", F.round("v", 5).alias("v"))


@query(f"SELECT u % 10 AS g, u AS node, round(m - avg(m) OVER (PARTITION BY u % 10), 5) AS offset FROM (SELECT u, avg(v) AS m FROM {SERIES} GROUP BY u) QUALIFY count(*) OVER (PARTITION BY u % 10) > 1")
def network_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene offsets out of the differences of neighbouring scenes."""
    means = series(spark, sf_dir).groupBy("u").agg(F.avg("v").alias("m")).withColumn("g", F.col("u") % 10)
    w = Window.partitionBy("g").orderBy("u")
    pairs = means.select("g", F.lag("u").over(w).alias("a"), F.col("u").alias("b"), (F.col("m") - F.lag("m").over(w)).alias("d")).filter("a is not null")
    return I.network_offsets(pairs, ["g"], "a", "b", "d").select("g", "node", F.round("offset", 5).alias("offset"))


@query()
def huber_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.robust_line(series(spark, sf_dir), ["u"], "t", "v")
    return out.select("u", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(f"SELECT DISTINCT (a.r // 16) * 4 + a.c // 16 AS block, 1::BIGINT AS dr, 2::BIGINT AS dc FROM {GRID} a JOIN {GRID} b ON a.r = b.r + 1 AND a.c = b.c + 2")
def block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image against itself moved by one row and two columns, block by block."""
    cells = grid(spark, sf_dir).select("r", "c", F.col("v").alias("a"))
    moved = cells.select((F.col("r") + 1).alias("r"), (F.col("c") + 2).alias("c"), F.col("a").alias("b"))
    block: Column = F.floor(F.col("r") / 16) * 4 + F.floor(F.col("c") / 16)
    return I.block_shift(cells.join(moved, ["r", "c"]).withColumn("block", block), ["block"], 3).select("block", "dr", "dc")


@query(f"""WITH s AS (SELECT r // 16 AS slice, c AS x, r % 16 AS y, v FROM {GRID} WHERE w >= 0.05)
SELECT slice, count(*) AS n, round((covar_pop(v, x) * var_pop(y) - covar_pop(v, y) * covar_pop(x, y)) / (var_pop(x) * var_pop(y) - pow(covar_pop(x, y), 2)), 6) AS along, round((covar_pop(v, y) * var_pop(x) - covar_pop(v, x) * covar_pop(x, y)) / (var_pop(x) * var_pop(y) - pow(covar_pop(x, y), 2)), 6) AS across FROM s GROUP BY slice""")
def masked_stack_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ramp of each slice of a stack, out of its cells of good coherence alone."""
    cells = grid(spark, sf_dir).select(F.floor(F.col("r") / 16).alias("slice"), F.col("c").alias("x"), (F.col("r") % 16).alias("y"), "v", "w")
    found = I.masked_regression(cells, ["slice"], "v", ["x", "y"], "w", 0.05)
    return found.select("slice", "n", F.round(F.col("coefficients")[1], 6).alias("along"), F.round(F.col("coefficients")[2], 6).alias("across"))


@query(f"""WITH p AS MATERIALIZED (SELECT u, event_id::VARCHAR AS id, t AS x, v AS y, k, md5('42:' || k::VARCHAR || ':' || event_id::VARCHAR) AS h FROM {SERIES}, range(1, 21) g(k)),
o AS (SELECT *, row_number() OVER (PARTITION BY u, k ORDER BY h, id) AS n FROM p), l AS (SELECT a.u, a.k, (b.y - a.y) / (b.x - a.x) AS m, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS c FROM o a JOIN o b ON a.u = b.u AND a.k = b.k AND a.n = 1 AND b.n = 2 WHERE a.x <> b.x),
s AS (SELECT l.u, l.k, m, c, count(*) FILTER (abs(y - m * x - c) <= 30) AS n FROM p JOIN l ON p.u = l.u AND p.k = l.k GROUP BY ALL), best AS (SELECT u, arg_min(m, row(-n, k)) AS m, arg_min(c, row(-n, k)) AS c FROM s GROUP BY u)
SELECT e.u, count(*) AS n, count(*) FILTER (abs(v - m * t - c) <= 30) AS inliers, round(regr_slope(v, t) FILTER (abs(v - m * t - c) <= 30), 5) AS slope, round(regr_intercept(v, t) FILTER (abs(v - m * t - c) <= 30), 4) AS intercept FROM {SERIES} e JOIN best USING (u) GROUP BY e.u""")
def seeded_consensus_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each series that most of its points agree on."""
    out = I.ransac_line(series(spark, sf_dir), ["u"], "event_id", "t", "v", 20, 30.0)
    return out.select("u", "n", "inliers", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(f"""WITH g AS (SELECT k, r, c, (c + 0.5) * 10 AS x, (r + 0.5) * 10 AS y, x0, y0, x1, y1 FROM {_BOXES}, LATERAL (SELECT unnest(range(floor((x0 - 12) / 10)::BIGINT, floor((x1 + 12) / 10)::BIGINT + 1)) AS c), LATERAL (SELECT unnest(range(floor((y0 - 12) / 10)::BIGINT, floor((y1 + 12) / 10)::BIGINT + 1)) AS r)),
d AS (SELECT k, r, c, sqrt(pow(greatest(0, x0 - x, x - x1), 2) + pow(greatest(0, y0 - y, y - y1), 2)) AS d FROM g) SELECT k, r, c, round(d, 6) AS d FROM d WHERE d <= 12""")
def rasterized_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in and around the buildings."""
    return S.rasterized(_boxes(spark, sf_dir), "k", "ring", 12.0, 10.0).withColumn("d", F.round("d", 6))


@query("""SELECT s_suppkey AS k, round(greatest(20.0 + s_suppkey % 30, 15.0 + s_suppkey % 20) * 2, 6)::DOUBLE AS long, round(least(20.0 + s_suppkey % 30, 15.0 + s_suppkey % 20) * 2, 6)::DOUBLE AS short FROM supplier""")
def rotated_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest rectangle around each building, after all of them were turned and doubled."""
    a = 2 * F.cos(F.col("k") % 7 / F.lit(5.0)), 2 * F.sin(F.col("k") % 7 / F.lit(5.0))
    turned = _boxes(spark, sf_dir).withColumn("a", a[0]).withColumn("b", a[1]).withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] * F.col("a") - p["y"] * F.col("b")).alias("x"), (p["x"] * F.col("b") + p["y"] * F.col("a")).alias("y"))))
    return turned.withColumn("_b", S.rotated_box(F.col("ring"))).select("k", F.round("_b.long", 6).alias("long"), F.round("_b.short", 6).alias("short"))


@query("""
WITH cells AS (SELECT DISTINCT l_partkey // 16 AS area, l_partkey AS r, floor(l_quantity / 2)::BIGINT AS c FROM lineitem),
v AS (SELECT area, r + dy AS y, c + dx AS x, count(*) AS n, sum(q) AS q FROM cells, (VALUES (0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8)) AS d(dy, dx, q) GROUP BY 1, 2, 3),
k AS (SELECT area, count(*) FILTER (n = 1) AS one, count(*) FILTER (n = 3) AS three, count(*) FILTER (q IN (6, 9)) AS cross_ FROM v GROUP BY 1)
SELECT area, n::DOUBLE AS cells, (one + three + 2 * cross_)::BIGINT AS corners, ((one - three - 2 * cross_) // 4)::BIGINT AS shells_less_holes FROM k JOIN (SELECT area, count(*) AS n FROM cells GROUP BY 1) USING (area)""")
def cell_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of cells to rings of corners. The area within the ordered corners, less holes, is the number of cells; corners and rings are those that the cells round each corner tell."""
    cells = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_partkey") / 16).alias("area"), F.col("l_partkey").alias("r"), F.floor(F.col("l_quantity") / 2).alias("c"))
    ring = Window.partitionBy("area", "ring").orderBy("seq")
    around = O.rings(cells, "area").withColumns({"_x": F.coalesce(F.lead("x").over(ring), F.first("x").over(ring)), "_y": F.coalesce(F.lead("y").over(ring), F.first("y").over(ring))})
    return around.groupBy("area").agg(
        (F.sum(F.col("x") * F.col("_y") - F.col("_x") * F.col("y")) / 2).alias("cells"), F.count(F.lit(1)).alias("corners"),
        F.sum(F.when(F.col("seq") == 0, F.when(F.col("hole"), -1).otherwise(1)).otherwise(0)).alias("shells_less_holes"))


#: Yearly means of parts in SQL (p, x, y, e, v), and the pairs of years at most three apart with a coherence.
_SCENE = "(SELECT l_partkey AS p, (l_partkey * 37 % 1000)::DOUBLE AS x, (l_partkey * 91 % 1009)::DOUBLE AS y, year(l_shipdate) AS e, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4)"
_SCENE_PAIRS = f"(SELECT a.p, a.x, a.y, a.e AS i, b.e AS j, ((a.p * 31 + a.e * 7 + b.e * 3) % 50 + 50) / 100.0::DOUBLE AS c FROM {_SCENE} a JOIN {_SCENE} b ON a.p = b.p AND b.e > a.e AND b.e <= a.e + 3)"


@query(f"""WITH s AS MATERIALIZED {_SCENE}, m AS (SELECT p, avg(c) AS c, count(*) AS n FROM {_SCENE_PAIRS} GROUP BY p), whole AS (SELECT p FROM s GROUP BY p HAVING count(*) = (SELECT count(DISTINCT e) FROM s)),
ref AS (SELECT p AS rp FROM m ORDER BY n DESC, round(c, 9) DESC, p LIMIT 1), rs AS (SELECT s.e, s.v - first_value(s.v) OVER (ORDER BY s.e) AS v, x AS rx, y AS ry FROM s JOIN ref ON s.p = rp),
f AS (SELECT s.p, x, y, rx, ry, s.e, s.v - first_value(s.v) OVER (PARTITION BY s.p ORDER BY s.e) - rs.v AS phi, c FROM s JOIN whole USING (p) JOIN m USING (p) JOIN rs ON rs.e = s.e),
k AS (SELECT e, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(phi, x) AS xz, covar_pop(phi, y) AS yz FROM f WHERE c >= 0.7003 GROUP BY e),
d AS (SELECT f.*, phi - (xz * yy - yz * xy) / (xx * yy - xy * xy) * (x - rx) - (yz * xx - xz * xy) / (xx * yy - xy * xy) * (y - ry) AS v FROM f JOIN k ON k.e = f.e),
o AS (SELECT p, regr_slope(v, e) AS velocity, arg_max(v, e) AS last FROM d GROUP BY p)
SELECT p, round(c, 6) AS coherence, CASE WHEN o.p IS NOT NULL THEN 1.0::DOUBLE END AS fit, coalesce(c >= 0.7003 AND o.p IS NOT NULL, false) AS good, round(velocity, 5) AS velocity, round(last, 4) AS last FROM m LEFT JOIN o USING (p)""")
def scene_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series and velocities of a scene's pixels (parts) out of one network of pairs (of years), levelled by the planes of its good pixels; pixels whose pairs don't link all epochs keep nulls."""
    p, e = F.col("l_partkey").alias("p"), F.year("l_shipdate").alias("e")
    means = table(spark, sf_dir, "lineitem").groupBy(p, e).agg(F.avg("l_quantity").alias("v"))
    later = means.select("p", F.col("e").alias("j"), F.col("v").alias("w"), F.explode(F.array(*[F.col("e") - k for k in (1, 2, 3)])).alias("i"))
    pairs = means.withColumnRenamed("e", "i").join(later, ["p", "i"]).select(
        "p", (F.col("p") * 37 % 1000).alias("x"), (F.col("p") * 91 % 1009).alias("y"), "i", "j", (F.col("w") - F.col("v")).alias("d"), (((F.col("p") * 31 + F.col("i") * 7 + F.col("j") * 3) % 50 + 50) / 100.0).alias("c"))
    found = I.shared_baseline(pairs, "p", "x", "y", "i", "j", "d", "c", 0.7003, 0.7)
    return found.select("p", F.round("mean_coherence", 6).alias("coherence"), F.round("fit", 6).alias("fit"), "good", F.round("velocity", 5).alias("velocity"), F.round(F.element_at("series", -1)["v"], 4).alias("last"))
