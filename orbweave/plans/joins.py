"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query, table
from ..operators import joins as J, tiles
from .common import GRID, SERIES, grid, points, points_sql, series

_STRATA = "(SELECT s, g.k AS layer, g.k * 5.0::DOUBLE AS top, (g.k + 1) * 5.0::DOUBLE AS bottom FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem) , range(0, 10) g(k) WHERE (s + g.k) % 4 <> 0)"


@query(f"""
SELECT l_orderkey, l_linenumber, (SELECT layer FROM (SELECT layer, l_quantity = bottom AS closed, top FROM {_STRATA} z WHERE z.s = l_suppkey AND l_quantity >= top AND l_quantity <= bottom) ORDER BY closed, top LIMIT 1) AS layer FROM lineitem""")
def interval_join_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths to strata [top, bottom), an unmatched depth to the stratum that ends there."""
    tests = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s"), "l_quantity")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))
    strata = tests.select("s").distinct().select("s", k.alias("layer")).filter((F.col("s") + F.col("layer")) % 4 != 0).select("s", "layer", (F.col("layer") * 5.0).alias("top"), ((F.col("layer") + 1) * 5.0).alias("bottom"))
    return J.interval_first(tests, strata, ["s"], "l_quantity", "top", "bottom", "top", ["layer"]).select("l_orderkey", "l_linenumber", "layer")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.05)""")
def key_intersection_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the keys that three tables share."""
    lines = table(spark, sf_dir, "lineitem")
    keys = table(spark, sf_dir, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("l_suppkey")).intersect(lines.filter("l_quantity > 45").select("l_suppkey")).intersect(lines.filter("l_discount > 0.05").select("l_suppkey"))
    return lines.join(keys, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def anti_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def equi_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers, nations = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    return orders.join(customers, orders.o_custkey == customers.c_custkey, "left").join(nations, customers.c_nationkey == nations.n_nationkey, "left").select("o_orderkey", "c_mktsegment", "n_name")


@query("""SELECT a.o_orderkey, a.o_totalprice AS price_op, b.o_totalprice AS price_demo FROM orders a JOIN (SELECT *, (o_totalprice / 1000)::BIGINT AS k FROM orders WHERE o_orderkey % 2 = 0) b ON (a.o_totalprice / 1000)::BIGINT = b.k AND a.o_custkey = b.o_custkey WHERE a.o_orderkey % 2 = 1""".replace("(o_totalprice / 1000)::BIGINT", "floor(o_totalprice / 1000)").replace("(a.o_totalprice / 1000)::BIGINT", "floor(a.o_totalprice / 1000)"))
def rounded_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs compared on a rounded key."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.floor(F.col("o_totalprice") / 1000).alias("k"))
    a, b = rows.filter("o_orderkey % 2 = 1").withColumnRenamed("o_totalprice", "price_op"), rows.filter("o_orderkey % 2 = 0").select("o_custkey", "k", F.col("o_totalprice").alias("price_demo"))
    return a.join(b, ["o_custkey", "k"]).select("o_orderkey", "price_op", "price_demo")


_NEAR = f"""SELECT a.k, arg_min(b.k, row(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.k)) AS near, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS dist FROM {points_sql('customer', 'c_custkey')} a, {points_sql('supplier', 's_suppkey')} b GROUP BY a.k"""


@query(f"SELECT k, near, round(dist, 6) AS dist FROM ({_NEAR})")
def knn1_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest borehole of each point."""
    out = J.nearest(points(spark, sf_dir, "customer", "c_custkey"), points(spark, sf_dir, "supplier", "s_suppkey"), "k", "k", 64.0)
    return out.select("k", F.col("_near").alias("near"), F.round("dist", 6).alias("dist"))


@query(f"""SELECT k, CASE WHEN dist <= 30 THEN 'borehole' ELSE 'geology' END AS route, CASE WHEN dist <= 30 THEN [0.6, 0.8, 1.0][(near % 3 + 1)::INT]::DOUBLE ELSE 1.0 END AS alpha FROM ({_NEAR})""")
def knn_gap_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest borehole's grade up to a gap, geology beyond it; unknown grades count as 1."""
    alpha = F.element_at(F.array(F.lit(0.6), F.lit(0.8), F.lit(1.0)), (F.col("k") % 3 + 1).cast("int"))
    holes = points(spark, sf_dir, "supplier", "s_suppkey").withColumn("alpha", alpha)
    out = J.nearest(points(spark, sf_dir, "customer", "c_custkey"), holes, "k", "k", 32.0, ["alpha"], reach=30.0)
    return out.select("k", F.when(F.col("dist").isNotNull(), F.lit("borehole")).otherwise(F.lit("geology")).alias("route"), F.coalesce("alpha", F.lit(1.0)).alias("alpha"))


@query(f"""SELECT a.k, count(*) AS n FROM {points_sql('customer', 'c_custkey')} a, {points_sql('customer', 'c_custkey')} b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 625 GROUP BY a.k""")
def radius_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours within the radius, the point itself included."""
    rows = points(spark, sf_dir, "customer", "c_custkey")
    near = tiles.within(rows, rows, 25.0, {"n": F.count(F.lit(1))})
    return tiles.at_place(rows, near, ("x", "y")).groupBy("k").agg(F.sum("n").cast("long").alias("n"))


@query(f"""SELECT a.k, max(b.c_acctbal) AS top, round(avg(b.c_acctbal), 6) AS mean FROM {points_sql('supplier', 's_suppkey')} a, {points_sql('customer', 'c_custkey')} b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600 GROUP BY a.k HAVING count(*) >= 3""")
def radius_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, others = points(spark, sf_dir, "supplier", "s_suppkey"), points(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    near = tiles.within(rows, others, 40.0, {"n": F.count(F.lit(1)), "valued": F.count("c_acctbal"), "total": F.sum("c_acctbal")}, {"top": F.max("c_acctbal")})
    told = tiles.at_place(rows, near, ("x", "y")).groupBy("k").agg(F.max("top").alias("top"), F.round(F.try_divide(F.sum("total"), F.sum("valued")), 6).alias("mean"), F.sum("n").alias("n"))
    return told.filter("n >= 3").drop("n")


@query(f"""SELECT k FROM {points_sql('customer', 'c_custkey')} a WHERE NOT EXISTS (SELECT 1 FROM {points_sql('supplier', 's_suppkey')} b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600) ORDER BY md5('7:' || k::VARCHAR), k LIMIT 100""")
def background_anti_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred seeded background points away from every event: the sample is the feature."""
    return J.away_from(points(spark, sf_dir, "customer", "c_custkey"), points(spark, sf_dir, "supplier", "s_suppkey"), "k", 40.0, 100, 7).select("k")


_DIAMONDS = "(SELECT s_suppkey AS p, (s_suppkey * 53 % 1000)::DOUBLE AS cx, (s_suppkey * 29 % 1009)::DOUBLE AS cy, 20 + s_suppkey % 40 + 0.5 AS h FROM supplier)"


@query(f"""SELECT a.k, (SELECT min(p) FROM {_DIAMONDS} d WHERE abs(a.x - d.cx) + abs(a.y - d.cy) < d.h) AS p FROM {points_sql('customer', 'c_custkey')} a""")
def pip_join_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first polygon that holds each point."""
    k = F.col("s_suppkey")
    cx, cy, h = (k * 53 % 1000).cast("double"), (k * 29 % 1009).cast("double"), 20 + k % 40 + F.lit(0.5)
    corners = ((h, F.lit(0.0)), (F.lit(0.0), h), (-h, F.lit(0.0)), (F.lit(0.0), -h))
    ring = F.array(*[F.struct((cx + dx).alias("x"), (cy + dy).alias("y")) for dx, dy in corners])
    shapes = table(spark, sf_dir, "supplier").select(k.alias("p"), ring.alias("ring"))
    return J.polygon_first(points(spark, sf_dir, "customer", "c_custkey"), shapes, "k", "ring", "p", ["p"], 50.0).select("k", "p")


@query(f"""SELECT a.cx, a.cy, a.n AS n_left, b.n AS n_right FROM (SELECT floor(x / 100)::BIGINT AS cx, floor(y / 100)::BIGINT AS cy, count(*) AS n FROM {points_sql('customer', 'c_custkey')} GROUP BY 1, 2) a JOIN (SELECT floor(x / 100)::BIGINT AS cx, floor(y / 100)::BIGINT AS cy, count(*) AS n FROM {points_sql('supplier', 's_suppkey')} GROUP BY 1, 2) b ON a.cx = b.cx AND a.cy = b.cy""")
def cell_equi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counts(name: str, key: str, n: str) -> DataFrame:
        cx, cy = J.cells(F.col("x"), F.col("y"), 100.0)
        return points(spark, sf_dir, name, key).groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count(F.lit(1)).alias(n))

    return counts("customer", "c_custkey", "n_left").join(counts("supplier", "s_suppkey", "n_right"), ["cx", "cy"])


@query(f"""SELECT a.cx, a.cy, round(a.v, 6) AS v_left, round(b.v, 6) AS v_right FROM (SELECT floor(x / 150)::BIGINT AS cx, floor(y / 150)::BIGINT AS cy, avg(c_acctbal) AS v FROM {points_sql('customer', 'c_custkey')} GROUP BY 1, 2 HAVING count(*) >= 5) a JOIN (SELECT floor(x / 150)::BIGINT AS cx, floor(y / 150)::BIGINT AS cy, avg(s_acctbal) AS v FROM {points_sql('supplier', 's_suppkey')} GROUP BY 1, 2) b ON a.cx = b.cx AND a.cy = b.cy""")
def grid_mean_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = J.cell_means(points(spark, sf_dir, "customer", "c_custkey", F.col("c_acctbal").alias("v")), 150.0, "v", 5)
    b = J.cell_means(points(spark, sf_dir, "supplier", "s_suppkey", F.col("s_acctbal").alias("v")), 150.0, "v")
    return a.select("cx", "cy", F.round("v", 6).alias("v_left")).join(b.select("cx", "cy", F.round("v", 6).alias("v_right")), ["cx", "cy"])


_PROBES = f"(SELECT u, i, t, v FROM {SERIES} WHERE i % 2 = 0)"
_REFS = f"(SELECT u, t AS s, v AS w FROM {SERIES} WHERE i % 2 = 1)"


def _probes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every row of a series is a probe or a reference."""
    rows = series(spark, sf_dir)
    return rows.filter("i % 2 = 0").select("u", "i", "t", "v"), rows.filter("i % 2 = 1").select("u", F.col("t").alias("s"), F.col("v").alias("w"))


@query(f"""
SELECT p.u, p.i, b.w FROM {_PROBES} p LEFT JOIN LATERAL (SELECT w FROM {_REFS} r WHERE r.u = p.u AND abs(r.s - p.t) <= 0.25 ORDER BY abs(r.s - p.t), r.s LIMIT 1) b ON true""")
def asof_nearest_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _probes(spark, sf_dir)
    return J.asof_nearest(left, right, ["u"], "t", "s", ["w"], 0.25).select("u", "i", "w")


@query(f"""SELECT p.u, p.i, (SELECT max(w) FROM (SELECT w, s FROM {_REFS} r WHERE r.u = p.u AND r.s <= p.t ORDER BY s DESC LIMIT 1)) AS w FROM {_PROBES} p""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _probes(spark, sf_dir)
    return J.asof_backward(left, right, ["u"], "t", "s", ["w"]).select("u", "i", "w")


@query(f"""SELECT p.u, count(*) AS probes, round(quantile_cont(wait, 0.5), 6) AS p50, round(quantile_cont(wait, 0.9), 6) AS p90, round(avg(CASE WHEN wait <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS within FROM (SELECT p.u, (SELECT min(s) FROM {_REFS} r WHERE r.u = p.u AND r.s > p.t) - p.t AS wait FROM (SELECT u, h / 2.0::DOUBLE AS t FROM (SELECT DISTINCT u FROM {_REFS}), range(0, (SELECT floor(2 * max(s))::BIGINT + 1 FROM {_REFS})) g(h)) p) p GROUP BY p.u""")
def asof_forward_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting times of regular probes for the next pass."""
    _, right = _probes(spark, sf_dir)
    last = int(2 * (right.agg(F.max("s")).first()[0] or 0.0))
    probes = right.select("u").distinct().select("u", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("h")).select("u", (F.col("h") / F.lit(2.0)).alias("t"))
    waits = J.asof_forward(probes, right, ["u"], "t", "s").withColumn("wait", F.col("next") - F.col("t"))
    return waits.groupBy("u").agg(
        F.count(F.lit(1)).alias("probes"), F.round(F.percentile("wait", 0.5), 6).alias("p50"), F.round(F.percentile("wait", 0.9), 6).alias("p90"),
        F.round(F.avg(F.when(F.col("wait") <= 0.5, 1.0).otherwise(0.0)), 6).alias("within"),
    )


_BRACKET = f"""SELECT p.u, p.i, p.t, (SELECT max(s) FROM {_REFS} r WHERE r.u = p.u AND s <= p.t) AS t0, (SELECT min(s) FROM {_REFS} r WHERE r.u = p.u AND s >= p.t) AS t1 FROM {_PROBES} p"""
_VALUES = f"SELECT b.*, x.w AS v0, y.w AS v1 FROM ({_BRACKET}) b LEFT JOIN {_REFS} x ON x.u = b.u AND x.s = b.t0 LEFT JOIN {_REFS} y ON y.u = b.u AND y.s = b.t1"


@query(f"""SELECT u, i, round(CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN CASE WHEN t1 = t0 THEN v0 WHEN t1 - t0 <= 1.0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END WHEN t0 IS NOT NULL AND t - t0 <= 0.5 THEN v0 WHEN t1 IS NOT NULL AND t1 - t <= 0.5 THEN v1 END, 6) AS w FROM ({_VALUES})""")
def interp_gap_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _probes(spark, sf_dir)
    return J.interpolated(left, right, ["u"], "t", "s", "w", 0.5).select("u", "i", F.round("w", 6).alias("w"))


@query(f"""SELECT u, i, round(CASE WHEN t - t0 <= 0.6 AND t1 - t <= 0.6 THEN CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END WHEN t - t0 <= 0.2 AND (t1 IS NULL OR t1 - t > 0.2 OR t - t0 <= t1 - t) THEN v0 WHEN t1 - t <= 0.2 THEN v1 END, 6) AS w FROM ({_VALUES})""")
def interp_asymmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _probes(spark, sf_dir)
    return J.interpolated_two_sided(left, right, ["u"], "t", "s", "w", 0.6, 0.2).select("u", "i", F.round("w", 6).alias("w"))


@query(f"""SELECT e.event_id, (SELECT min(o) FROM (SELECT DISTINCT (u % 40) AS o, (u % 40) * 0.75::DOUBLE AS lo, (u % 40) * 0.75::DOUBLE + 0.7 AS hi FROM {SERIES}) r WHERE lo <= e.t AND e.t < hi) AS orbit FROM {SERIES} e""")
def validity_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orbit file that covers each acquisition."""
    rows = series(spark, sf_dir)
    o = F.col("u") % 40
    files = rows.select(o.alias("orbit"), (o * 0.75).alias("lo"), (o * 0.75 + 0.7).alias("hi")).distinct()
    return J.validity(rows, files, "t", "lo", "hi", 1.0, ["orbit"]).select("event_id", "orbit")


@query(f"""SELECT a.u, a.i, b.i AS j, round(b.t - a.t, 6) AS dt FROM {SERIES} a JOIN {SERIES} b ON a.u = b.u AND b.i > a.i AND b.i <= a.i + 4 AND (b.t - a.t <= 1.2 OR b.i = a.i + 1)""")
def pairs_within_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network of pairs close in time."""
    pairs = J.pairs_within(series(spark, sf_dir).select("u", "i", "t"), ["u"], "t", 1.2, "i", 4)
    return pairs.select("i.u", "i.i", F.col("j.i").alias("j"), F.round(F.col("j.t") - F.col("i.t"), 6).alias("dt"))


@query(f"""
WITH g AS {GRID}, p AS (SELECT c_custkey AS k, (c_custkey * 37 % 631) / 10.0::DOUBLE AS x, (c_custkey * 91 % 629) / 10.0::DOUBLE AS y FROM customer),
f AS (SELECT p.k, sum((1 - abs(g.c - p.x)) * (1 - abs(g.r - p.y)) * g.v) AS s, count(*) AS n FROM p JOIN (SELECT * FROM range(0, 2) a(dx), range(0, 2) b(dy)) ON true JOIN g ON g.c = floor(p.x) + dx AND g.r = floor(p.y) + dy GROUP BY p.k)
SELECT p.k, CASE WHEN n = 4 THEN round(s, 6) END AS v FROM p LEFT JOIN f USING (k)""")
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    at = table(spark, sf_dir, "customer").select(k.alias("k"), (k * 37 % 631 / F.lit(10.0)).alias("x"), (k * 91 % 629 / F.lit(10.0)).alias("y"))
    return J.bilinear(at, grid(spark, sf_dir).select(F.col("r").alias("row"), F.col("c").alias("col"), "v"), "k", "v").select("k", F.round("v", 6).alias("v"))


@query("""SELECT p_partkey, coalesce(a.name, b.name) AS name FROM part LEFT JOIN (SELECT p_brand AS key, 'five ' || p_brand AS name FROM part WHERE p_size < 10 GROUP BY p_brand) a ON a.key = p_brand || '' AND p_partkey % 2 = 0 LEFT JOIN (SELECT left(p_brand, 7) AS key, 'four ' || left(p_brand, 7) AS name FROM part GROUP BY 1) b ON b.key = left(p_brand, 7)""")
def dict_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes looked up at the finer level, else at the coarser."""
    part = table(spark, sf_dir, "part")
    fine = part.filter("p_size < 10").select(F.col("p_brand").alias("key")).distinct().withColumn("name", F.concat(F.lit("five "), "key"))
    coarse = part.select(F.substring("p_brand", 1, 7).alias("key")).distinct().withColumn("name", F.concat(F.lit("four "), "key"))
    levels = [(fine, "case when p_partkey % 2 = 0 then p_brand end"), (coarse, "substring(p_brand, 1, 7)")]
    return J.fallback(part.select("p_partkey", "p_brand"), "p_brand", levels, "name").select("p_partkey", "name")
