"""Queries of polygons over cells, and of one grid's values on another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query, table
from ..operators import grids as Y, transects as L
from ..operators.lineage import kept
from .common import GRID, grid

#: Cells of parts and orders in SQL: r, c, v; and diamonds with a hole about each supplier: k, x, y and half diagonals (odd across, even along, so that no centre is on an edge).
_CELLS = "(SELECT l_orderkey % 997 AS r, (l_partkey * 37 + l_suppkey) % 1009 AS c, avg(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)"
_DIAMONDS = "(SELECT s_suppkey AS k, s_suppkey * 53 % 997 AS x, s_suppkey * 29 % 1009 AS y, 61 + 2 * (s_suppkey % 25) AS a, 50 + 2 * (s_suppkey % 20) AS b, 11 + 2 * (s_suppkey % 5) AS ha, 6 + 2 * (s_suppkey % 4) AS hb FROM supplier)"
_IN = "abs(2 * c + 1 - 2 * x) * {b} + abs(2 * r + 1 - 2 * y) * {a} < 2 * {a} * {b}"


@query(f"""SELECT k, count(v) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(CASE WHEN v >= 30 THEN 1.0 WHEN v < 30 THEN 0.0 END), 6) AS above
FROM {_DIAMONDS} LEFT JOIN {_CELLS} ON c BETWEEN x - a AND x + a AND r BETWEEN y - b AND y + b AND {_IN.format(a="a", b="b")} AND NOT ({_IN.format(a="ha", b="hb")}) GROUP BY k""")
def polygon_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the cells whose centres are in each polygon with a hole; polygons without cells stay."""
    k = F.col("s_suppkey")
    x, y = k * 53 % 997, k * 29 % 1009
    at = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    ring = lambda a, b: F.array(at(a, F.lit(0)), at(F.lit(0), b), at(-a, F.lit(0)), at(F.lit(0), -b))
    zones = table(spark, sf_dir, "supplier").select(k.alias("k"), F.array(ring(61 + 2 * (k % 25), 50 + 2 * (k % 20)), ring(11 + 2 * (k % 5), 6 + 2 * (k % 4))).alias("rings"))
    cells = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 997).alias("r"), ((F.col("l_partkey") * 37 + F.col("l_suppkey")) % 1009).alias("c")).agg(F.avg("l_quantity").alias("v"))
    sums = Y.zone_sums(cells.withColumn("above", (F.col("v") >= 30).cast("double")), zones, "k", "rings", Y.Grid(1.0), ["v", "above"])
    mean = lambda v: F.round(F.try_divide(F.col(f"{v}_sum"), F.col(f"{v}_n")), 6)
    stats = sums.select("k", F.col("v_n").alias("n"), mean("v").alias("mean"), F.round("v_low", 6).alias("low"), F.round("v_high", 6).alias("high"), mean("above").alias("above"))
    return zones.select("k").join(stats, "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))


#: Pairs of cells of a grid of size 8 from (0, 0) and a grid of size 5 from (3, -2), in SQL: r, c, v and the part that they share.
_OVERLAP = f"""(SELECT tr AS r, tc AS c, v, (least(g.c * 8 + 8, tc * 5 + 8) - greatest(g.c * 8, tc * 5 + 3)) * (least(g.r * 8 + 8, tr * 5 + 3) - greatest(g.r * 8, tr * 5 - 2)) AS w
FROM (SELECT * FROM {GRID} WHERE (r + c) % 5 <> 0) g, range(-1, 103) x(tc), range(0, 104) y(tr) WHERE tc * 5 + 8 > g.c * 8 AND tc * 5 + 3 < g.c * 8 + 8 AND tr * 5 + 3 > g.r * 8 AND tr * 5 - 2 < g.r * 8 + 8)"""


@query(f"SELECT r, c, round(sum(v * w) / sum(w), 6) AS v, round(sum(w) / 25.0::DOUBLE, 6) AS covered FROM {_OVERLAP} GROUP BY r, c")
def resample_area_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of another size and origin, by the area that they share with valid ones."""
    found = Y.averaged(grid(spark, sf_dir).filter("(r + c) % 5 <> 0"), "v", Y.Grid(8.0), Y.Grid(5.0, 3.0, -2.0))
    return found.select("r", "c", F.round("v", 6).alias("v"), F.round("covered", 6).alias("covered"))


_HATS = f"""(SELECT tr AS r, tc AS c, v, (1 - abs(tc * 5 + 5.5 - g.c * 8 - 4)::DOUBLE / 8) * (1 - abs(tr * 5 + 0.5 - g.r * 8 - 4)::DOUBLE / 8) AS w
FROM (SELECT * FROM {GRID} WHERE (r + c) % 5 <> 0) g, range(-4, 106) x(tc), range(-4, 106) y(tr) WHERE abs(tc * 5 + 5.5 - g.c * 8 - 4) < 8 AND abs(tr * 5 + 0.5 - g.r * 8 - 4) < 8)"""


@query(f"SELECT r, c, round(sum(v * w) / sum(w), 6) AS v, round(sum(w), 6) AS weight FROM {_HATS} GROUP BY r, c")
def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear values at another grid's centres; corners that are missing leave their weight to the others."""
    found = Y.interpolated(grid(spark, sf_dir).filter("(r + c) % 5 <> 0"), "v", Y.Grid(8.0), Y.Grid(5.0, 3.0, -2.0))
    return found.select("r", "c", F.round("v", 6).alias("v"), F.round("weight", 6).alias("weight"))


_TRIES = "(SELECT k, t, x0, y0, x0 + 12 * cos(pi() * u3) AS x1, y0 + 12 * sin(pi() * u3) AS y1 FROM (SELECT *, x + 20 * sqrt(u1) * cos(2 * pi() * u2) AS x0, y + 20 * sqrt(u1) * sin(2 * pi() * u2) AS y0 FROM (SELECT k, t, x, y, {}) z) z)".format(
    ", ".join(f"('0x' || substr(md5('11:' || k || ':' || t || ':{n}'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u{n}" for n in (1, 2, 3)) + " FROM (SELECT s_suppkey AS k, s_suppkey * 53 % 64 AS x, s_suppkey * 29 % 64 AS y FROM supplier) s, range(1, 161) g(t)"
)
_ALONG = "(SELECT k, t, floor(y0 + (y1 - y0) * (n / long)) AS r, floor(x0 + (x1 - x0) * (n / long)) AS c FROM (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS long FROM {}) l, range(0, 13) g(n) WHERE n <= floor(long + 1e-9))"


@query(f"""WITH g AS MATERIALIZED (SELECT r, c, v, w FROM {GRID} WHERE (r + c) % 4 <> 0), lines AS (SELECT k, t, x0, y0, x1, y1 FROM {_TRIES} UNION ALL SELECT s_suppkey, 0, (s_suppkey * 53 % 64)::DOUBLE, (s_suppkey * 29 % 64)::DOUBLE, s_suppkey * 53 % 64 + 12.0::DOUBLE, (s_suppkey * 29 % 64)::DOUBLE FROM supplier),
m AS MATERIALIZED (SELECT a.k, a.t, CASE WHEN count(v) >= 8 THEN median(v) END AS v, CASE WHEN count(w) >= 8 THEN median(w) END AS w FROM {_ALONG.format("lines")} a JOIN g ON a.r = g.r AND a.c = g.c GROUP BY 1, 2),
o AS (SELECT s_suppkey AS k, v, w FROM supplier LEFT JOIN m ON m.k = s_suppkey AND m.t = 0), f AS (SELECT * FROM m WHERE t > 0 AND v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY t) <= 20)
SELECT o.k, round(first(o.v), 6) AS v, round(first(o.w), 6) AS w, count(f.v) AS v_n, round(avg(f.v), 6) AS v_mean, round(100 * avg((f.v < o.v)::INT), 6) AS v_rank, round((first(o.v) - avg(f.v)) / (stddev_samp(f.v) + 1e-9), 4) AS v_z,
count(f.w) AS w_n, round(avg(f.w), 6) AS w_mean, round(100 * avg((f.w < o.w)::INT), 6) AS w_rank, round((first(o.w) - avg(f.w)) / (stddev_samp(f.w) + 1e-9), 4) AS w_z FROM o LEFT JOIN f USING (k) GROUP BY o.k""")
def random_transects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median along a line at each supplier, of an event's cells and of a placebo's, against lines placed at random within reach."""
    k = F.col("s_suppkey")
    anchors = table(spark, sf_dir, "supplier").select(k.alias("k"), (k * 53 % 64).cast("double").alias("x"), (k * 29 % 64).cast("double").alias("y"))
    cells = kept(grid(spark, sf_dir).filter("(r + c) % 4 <> 0").select("r", "c", "v", "w"))  # once, as means that are added up anew may tie otherwise
    own = anchors.select("k", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 12).alias("x1"), F.col("y").alias("y1"))
    observed = L.medians(own, cells, ["k"], ["v", "w"], Y.Grid(1.0), 1.0)
    lines = L.random_lines(anchors, cells, "k", ["v", "w"], Y.Grid(1.0), 20, 20.0, 12.0, 1.0, 11)
    tested = L.against(observed, lines, "k", ["v", "w"])
    return tested.select("k", *[c if c.endswith("_n") else F.round(c, 4 if c.endswith("_z") else 6).alias(c) for c in tested.columns[1:]])
