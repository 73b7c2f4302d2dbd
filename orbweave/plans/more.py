"""Further queries: addresses, ground grades, fusion of sensors, floods, profiles and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..catalog import query, table
from ..functions import grades as G, scalar as S
from ..operators import cluster as C, fusion, joins as J, raster as R, rules as U, series as T
from .common import GRID, SERIES, grid, points, points_sql, series
from .raster import _otsu_sql
from .rules import _F, _features, _fires, _scores


@query("""SELECT c_custkey, f.p_brand AS product FROM customer JOIN (SELECT p_partkey % 97 AS b, p_partkey % 11 AS s, min(p_brand) AS p_brand FROM part GROUP BY 1, 2) f ON f.b = c_custkey % 97 AND f.s = CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 11 END""")
def regex_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of both sides to a lot key, then an equi-join."""
    k, p = F.col("c_custkey"), F.col("p_partkey")
    address = F.concat(F.lit("서울시 역삼동"), (k % 97).cast("string"), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), (k % 11).cast("string"))), F.lit("번지 2층"))
    register = F.concat(F.lit("역삼동 "), (p % 97).cast("string"), F.lit("-"), (p % 11).cast("string"))
    left = table(spark, sf_dir, "customer").select("c_custkey", S.lot_number(address).alias("lot"))
    right = table(spark, sf_dir, "part").select(S.lot_number(register).alias("lot"), "p_brand").groupBy("lot").agg(F.min("p_brand").alias("product"))
    return left.join(right, "lot").select("c_custkey", "product")


@query("""SELECT c_custkey, array_to_string(list_filter([c_mktsegment || ' ' || c_name, CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_mktsegment], lambda x: x IS NOT NULL), '|') AS candidates FROM customer""")
def address_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries for a geocoder from the fullest to the barest."""
    tried = F.array(F.concat_ws(" ", "c_mktsegment", "c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_distinct(F.filter(tried, lambda x: x.isNotNull())), "|").alias("candidates"))


@query("""WITH h AS (SELECT s_nationkey AS road, s_suppkey AS number, (s_suppkey * 37 % 1000)::DOUBLE AS x FROM supplier), q AS (SELECT c_custkey AS k, c_nationkey AS road, c_custkey % 100 AS number FROM customer)
SELECT k, round(CASE WHEN a.number = b.number THEN a.x ELSE a.x + (b.x - a.x) * (q.number - a.number) / (b.number - a.number) END, 6) AS x FROM q JOIN h a ON a.road = q.road AND a.number = (SELECT max(number) FROM h WHERE h.road = q.road AND h.number <= q.number) JOIN h b ON b.road = q.road AND b.number = (SELECT min(number) FROM h WHERE h.road = q.road AND h.number >= q.number)""")
def geocode_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """House numbers between two that are known on the road."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("road"), F.col("s_suppkey").cast("double").alias("number"), (F.col("s_suppkey") * 37 % 1000).cast("double").alias("x"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("road"), (F.col("c_custkey") % 100).cast("double").alias("q"))
    found = J.interpolated(asked, known, ["road"], "q", "number", "x", 1e9)
    both = J.brackets(asked, known, ["road"], "q", "number", ["x"]).filter(F.col("_before").isNotNull() & F.col("_after").isNotNull()).select("k")
    return found.join(both, "k", "left_semi").select("k", F.round("x", 6).alias("x"))


@query("""WITH l AS (SELECT l_suppkey AS hole, l_partkey % 20 AS layer, min(CASE WHEN l_discount > 0 THEN least(l_quantity * 30 / (l_discount * 1000), 50) END) AS n, arg_min(l_returnflag, row(l_orderkey, l_linenumber, l_returnflag)) AS soil FROM lineitem GROUP BY 1, 2),
b AS (SELECT hole, count(*) FILTER (soil = 'R' AND n < 4) AS soft, min(n) AS low FROM l GROUP BY 1) SELECT hole, soft, round(low, 6) AS low, CASE WHEN soft >= 1 THEN '연약' WHEN low <= 10 THEN '주의' ELSE '양호' END AS grade, (CASE WHEN soft >= 1 THEN 0.6 WHEN low <= 10 THEN 0.8 ELSE 1.0 END)::DOUBLE AS alpha FROM b""")
def ground_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blow counts to layers to boreholes to a grade and its alpha."""
    n = S.capped_ratio(F.col("l_quantity"), F.col("l_discount") * 1000, 30, 50)
    layers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("hole"), (F.col("l_partkey") % 20).alias("layer")).agg(F.min(n).alias("n"), F.min_by("l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_returnflag")).alias("soil"))
    holes = layers.groupBy("hole").agg(F.count_if((F.col("soil") == "R") & (F.col("n") < 4)).alias("soft"), F.min("n").alias("low"))
    kind = F.when(F.col("soft") >= 1, 0).when(F.col("low") <= 10, 1).otherwise(2)
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), kind + 1)
    return holes.select("hole", "soft", F.round("low", 6).alias("low"), pick(("연약", "주의", "양호")).alias("grade"), pick((0.6, 0.8, 1.0)).alias("alpha"))


_SB = f"(SELECT *, CASE WHEN c_acctbal > 8000 THEN 2 WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS g FROM {points_sql('customer', 'c_custkey')})"
_PS = f"(SELECT *, CASE WHEN s_acctbal > 8000 THEN 2 WHEN s_acctbal > 4000 THEN 1 ELSE 0 END AS g FROM {points_sql('supplier', 's_suppkey')})"


@query(f"""WITH n AS (SELECT a.k, count(*) FILTER (b.g > 0) AS near FROM {_SB} a JOIN {_SB} b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900 GROUP BY a.k), p AS (SELECT a.k, max(b.g) AS ps, count(*) AS n_ps FROM {_SB} a JOIN {_PS} b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2500 GROUP BY a.k),
f AS (SELECT s.k, s.g, s.g > 0 AND near >= 2 AS hotspot, s.g > 0 AND coalesce(ps, 0) > 0 AS rescue, coalesce(n_ps, 0) AS n_ps, coalesce(ps, 0) AS ps FROM {_SB} s JOIN n USING (k) LEFT JOIN p USING (k))
SELECT k, CASE WHEN hotspot OR rescue THEN greatest(g, ps) ELSE 0 END AS final, hotspot, rescue, n_ps = 0 AS void, CASE WHEN n_ps = 0 THEN '③' WHEN (g > 0) = (ps > 0) THEN '①' ELSE '②' END AS agreement FROM f""")
def sensor_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grade of one sensor stands if neighbours or the other sensor bear it out; where the other sees nothing is told."""
    grade = lambda c, high, low: F.when(F.col(c) > high, 2).when(F.col(c) > low, 1).otherwise(0)
    one = points(spark, sf_dir, "customer", "c_custkey", "c_acctbal").withColumn("g", grade("c_acctbal", 8000, 5000))
    two = points(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").withColumn("g", grade("s_acctbal", 8000, 4000))
    return fusion.fused(one, two, 30.0, 50.0)


@query(f"""WITH RECURSIVE g AS MATERIALIZED (SELECT r, c, r * 64 + c AS id FROM {GRID} WHERE w * 200 - v <= -15), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.id <> b.id),
r(k, s) AS (SELECT id, id FROM g UNION SELECT e.b, r.s FROM r JOIN e ON e.a = r.k), l AS (SELECT k, min(s) AS component FROM r GROUP BY k) SELECT count(*) AS cells, count(DISTINCT component) AS floods FROM l WHERE component IN (SELECT component FROM l GROUP BY 1 HAVING count(*) >= 5)""")
def flood_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backscatter that fell far, in components of at least five cells."""
    wet = grid(spark, sf_dir).filter(R.dropped(F.col("v"), F.col("w") * 200, -15.0))
    return C.cell_components(wet, 64, True, 5).agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("component").alias("floods"))


@query(f"SELECT r, c, CASE WHEN c > 2 AND n > 3 THEN v / 50 - w * 5 >= 0.1 END AS burned FROM {GRID}")
def burn_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select("r", "c", R.burned(F.col("v") / 50, F.col("w") * 5, F.col("c") > 2, F.col("n") > 3).alias("burned"))


@query(f"SELECT count(*) AS cells, round(avg(a.v), 6) AS a, round(avg(b.w), 6) AS b FROM (SELECT * FROM {GRID} WHERE v > 20) a JOIN (SELECT * FROM {GRID} WHERE w > 0.045) b USING (r, c)")
def valid_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    both = R.valid_intersection(cells.filter("v > 20").select("r", "c", "v"), cells.filter("w > 0.045").select("r", "c", F.col("w").alias("v")), "v")
    return both.agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("a"), 6).alias("a"), F.round(F.avg("b"), 6).alias("b"))


@query(f"""SELECT s.k, round(median(g.v), 6) AS v, count(*) AS n FROM (SELECT k, k * 1.5::DOUBLE AS x, 10 + k * 0.75::DOUBLE AS y FROM range(0, 40) t(k)) s JOIN {GRID} g ON sqrt(pow(g.c - s.x, 2) + pow(g.r - s.y, 2)) <= 3 GROUP BY s.k""")
def line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians around stations along a track."""
    stations = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("x"), (10 + F.col("id") * 0.75).alias("y"))
    cells = grid(spark, sf_dir).select(F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), "v")
    return R.profile(stations, cells, "k", "v", 3.0).select("k", F.round("v", 6).alias("v"), "n")


@query("""SELECT s_suppkey AS k, (floor((x + s_suppkey % 30 + 20) / 25) - floor(x / 25) + 1)::BIGINT * (floor((y + s_suppkey % 20 + 15) / 25) - floor(y / 25) + 1)::BIGINT AS tiles FROM (SELECT s_suppkey, (s_suppkey * 53 % 997)::DOUBLE AS x, (s_suppkey * 29 % 1009)::DOUBLE AS y FROM supplier)""")
def tile_cover_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k * 53 % 997).cast("double"), (k * 29 % 1009).cast("double")
    boxes = table(spark, sf_dir, "supplier").select(k.alias("k"), x.alias("x0"), y.alias("y0"), (x + k % 30 + 20).alias("x1"), (y + k % 20 + 15).alias("y1"))
    return R.tile_cover(boxes, "k", 25.0)


@query("""
WITH RECURSIVE o AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, o_totalprice / 10000 AS y, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 100) / 10 END AS x FROM orders),
bands AS (SELECT k, n // 8 AS scene, n % 8 AS i, y, x FROM o),
hops AS (SELECT a.k, a.scene, a.i, b.i AS j, b.y - a.y AS dy, b.x - a.x AS dx FROM bands a JOIN bands b ON b.k = a.k AND b.scene = a.scene AND b.i > a.i AND abs(b.y - a.y) <= 8 AND abs(b.x - a.x) <= 8 QUALIFY row_number() OVER (PARTITION BY a.k, a.scene, a.i ORDER BY b.i) = 1),
path AS (SELECT k, scene, i, 0.0::DOUBLE AS dy, 0.0::DOUBLE AS dx FROM bands WHERE i = 0 UNION ALL SELECT h.k, h.scene, h.j, p.dy + h.dy, p.dx + h.dx FROM path p JOIN hops h ON h.k = p.k AND h.scene = p.scene AND h.i = p.i)
SELECT b.k, b.scene, b.i, round(last_value(p.dy IGNORE NULLS) OVER w, 6) AS dy, round(last_value(p.dx IGNORE NULLS) OVER w, 6) AS dx, p.k IS NOT NULL AS trusted
FROM bands b LEFT JOIN path p ON p.k = b.k AND p.scene = b.scene AND p.i = b.i WINDOW w AS (PARTITION BY b.k, b.scene ORDER BY b.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def shift_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of eight bands; what can't be matched (a gap, or a shift too large) is bridged from the last trusted band."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    x = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 100 / 10)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), n.cast("long").alias("n"), (F.col("o_totalprice") / 10000).alias("y"), x.alias("x"))
    bands = rows.select("k", F.floor(F.col("n") / 8).alias("scene"), (F.col("n") % 8).alias("i"), "y", "x")
    later = Window.partitionBy("k", "scene").orderBy("i").rowsBetween(1, 7)
    ahead = bands.withColumn("_b", F.collect_list(F.struct("i", "y", "x")).over(later)).withColumn("_b", F.explode("_b"))
    pairs = ahead.select("k", "scene", "i", F.col("_b.i").alias("j"), (F.col("_b.y") - F.col("y")).alias("dy"), (F.col("_b.x") - F.col("x")).alias("dx"))
    return R.bridged(bands, pairs, ["k", "scene"], ["dy", "dx"], 8.0).select("k", "scene", "i", F.round("dy", 6).alias("dy"), F.round("dx", 6).alias("dx"), "trusted")


@query(f"""WITH m AS (SELECT u, i, median(v) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM {SERIES}) SELECT u, i, round(avg(m) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS s FROM m""")
def smooth_median_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rolling median, then a rolling mean, both cut at the ends."""
    once = T.smoothed(series(spark, sf_dir), ["u"], "i", "v", 2, "m")
    return once.select("u", "i", F.round(F.avg("m").over(Window.partitionBy("u").orderBy("i").rowsBetween(-1, 1)), 6).alias("s"))


@query(f"""WITH w AS (SELECT u, i, t, CASE WHEN count(v) OVER w >= 8 THEN regr_slope(v, t) OVER w END AS s FROM {SERIES} WINDOW w AS (PARTITION BY u ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)), j AS (SELECT u, i, abs(s - lag(s, 8) OVER (PARTITION BY u ORDER BY i)) AS jump FROM w)
SELECT u, i, round(jump, 5) AS jump FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(jump, 9) DESC, i) AS k FROM j WHERE jump IS NOT NULL) WHERE k <= 3""")
def inflection_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest changes of window velocity of each series: a report."""
    return T.largest_jumps(series(spark, sf_dir), ["u"], "i", "t", "v").select("u", "i", F.round("jump", 5).alias("jump"))


_ORDER = "(SELECT l_suppkey AS s, l_quantity AS q, l_extendedprice AS d, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_extendedprice) AS i FROM lineitem)"


@query(f"""SELECT a.s, round(sum(sign(b.q - a.q) * sign(b.d - a.d))::DOUBLE / count(*), 6) AS tau FROM {_ORDER} a JOIN {_ORDER} b ON a.s = b.s AND b.i > a.i GROUP BY a.s""")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concordance of all pairs, counted without making them."""
    from ..operators import stats

    return stats.kendall(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").select(F.col("l_suppkey").alias("s"), F.round("tau", 6).alias("tau"))


_SINGLES = f"(SELECT feature || '|' || q || '|1' AS rule, 1 AS k, feature, threshold FROM (SELECT feature, unnest(quantile_cont(value, [0.5, 0.8, 0.9, 0.95])) AS threshold, unnest([50, 80, 90, 95]) AS q FROM {_F} WHERE kind = 'B' GROUP BY feature))"


@query(f"""WITH s AS (SELECT r.feature, r.threshold, det, med FROM {_scores(_fires(_SINGLES))} JOIN {_SINGLES} r USING (rule)), f AS (SELECT floor, feature, threshold, det, med, row_number() OVER (PARTITION BY floor ORDER BY round(med, 9), round(det, 9) DESC, feature, threshold) AS k FROM s, (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS floor) WHERE det >= floor)
SELECT floor, feature, round(threshold, 6) AS threshold, round(det, 6) AS det, round(med, 6) AS med FROM f WHERE k = 1""")
def search_by_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each detection floor the rule of the shortest median lead."""
    features = _features(spark, sf_dir)
    rules = U.singles(U.threshold_grid(features, [0.5, 0.8, 0.9, 0.95]), [1])
    best = U.shortest_by_floor(U.scores(U.fires(features, rules)).join(rules, "rule"), [0.3, 0.5, 0.7, 0.9], ["feature", "threshold"])
    return best.select("floor", "feature", F.round("threshold", 6).alias("threshold"), F.round("det", 6).alias("det"), F.round("med", 6).alias("med"))


@query(f"""WITH b AS (SELECT u, max(v) > 200 AS s1, sum(CASE WHEN v > 80 THEN 1 ELSE 0 END) >= 15 AS s2 FROM {SERIES} WHERE u % 7 <> 0 GROUP BY u) SELECT count(*) AS n, round(avg(s1::INT), 6) AS stage1, round(avg((s1 AND s2)::INT), 6) AS both FROM b""")
def operational_false_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background series that pass both stages."""
    units = series(spark, sf_dir).filter("u % 7 <> 0").groupBy("u").agg((F.max("v") > 200).alias("s1"), (F.count_if(F.col("v") > 80) >= 15).alias("s2"))
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return units.agg(F.count(F.lit(1)).alias("n"), rate(F.col("s1")).alias("stage1"), rate(F.col("s1") & F.col("s2")).alias("both"))


@query(f"""SELECT nation, count(*) AS roads, round(sum(c_acctbal), 2) AS people FROM (SELECT DISTINCT c.k, c.c_nationkey AS nation, c.c_acctbal FROM {points_sql('customer', 'c_custkey')} c JOIN {points_sql('supplier', 's_suppkey')} s ON (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) <= 900) GROUP BY 1""")
def exposure_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies in a buffered hazard, summed by district."""
    hit = J.radius_pairs(points(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal"), points(spark, sf_dir, "supplier", "s_suppkey"), 30.0).select("l.*").distinct()
    return hit.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("roads"), F.round(F.sum("c_acctbal"), 2).alias("people"))


_HALVES = f"(SELECT *, r // 32 AS b FROM {GRID})"


@query(f"""WITH m AS (SELECT b, avg(v) FILTER (v < threshold) AS lo, avg(v) FILTER (v >= threshold) AS hi FROM {_HALVES} JOIN {_otsu_sql(_HALVES)} USING (b) GROUP BY b)
SELECT b, count(*) FILTER (1 - exp(-pow(v - (lo + hi) / 2, 2) / (2 * pow((hi - lo) / 2, 2))) >= 0.9) AS members, count(*) AS cells FROM {_HALVES} JOIN m USING (b) GROUP BY b""")
def fuzzy_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells far from the middle of the two classes, on either side."""
    cells = grid(spark, sf_dir).withColumn("b", F.floor(F.col("r") / 32))
    return R.fuzzy_otsu(cells, ["b"], "v").groupBy("b").agg(F.count_if("member").alias("members"), F.count(F.lit(1)).alias("cells"))


@query(f"SELECT r, c, round(g.v, 6) AS v FROM (SELECT floor(y / 20 + 0.5)::BIGINT AS r, floor(x / 20 + 0.5)::BIGINT AS c, k FROM {points_sql('customer', 'c_custkey')}) p JOIN {GRID} g USING (r, c)")
def nearest_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the nearest nodes of a grid of twenty metres."""
    return R.nearest_nodes(points(spark, sf_dir, "customer", "c_custkey"), grid(spark, sf_dir), "v", 20.0).select("r", "c", F.round("v", 6).alias("v"))


@query("""SELECT event_type, CASE WHEN contains(event_type, 'pur') THEN '하수관' WHEN contains(event_type, 'cli') THEN '굴착' WHEN contains(event_type, 'err') THEN '다짐불량' ELSE '기타' END AS cause, count(*) AS n FROM events GROUP BY 1, 2""")
def cause_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to classes of causes, the first keyword that occurs."""
    cause = S.keyword_class(F.col("event_type"), (("하수관", ("pur",)), ("굴착", ("cli",)), ("다짐불량", ("err",))), "기타")
    return table(spark, sf_dir, "events").groupBy("event_type", cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT zone, count(*) FILTER (d >= 0.3) AS high, count(*) FILTER (d >= 0.15 AND d < 0.3) AS risk, round(count(*) FILTER (d >= 0.15) * 0.0009::DOUBLE, 6) AS km2 FROM (SELECT (r // 16) * 4 + c // 16 AS zone, v / 50 - w * 5 AS d FROM {GRID}) GROUP BY zone")
def damage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of lost coherence by zone, and their area of 30 m cells."""
    cells = grid(spark, sf_dir).select((F.floor(F.col("r") / 16) * 4 + F.floor(F.col("c") / 16)).alias("zone"), (F.col("v") / 50 - F.col("w") * 5).alias("d"))
    return R.damage_areas(cells, ["zone"], "d").withColumn("km2", F.round("km2", 6))


_ACCEPT = f"(SELECT a.k, first(a.g) AS g, count(*) FILTER (b.g > 0 AND b.k <> a.k) AS near, count(*) FILTER (b.g = 2 AND b.k <> a.k) AS near2 FROM {_SB} a JOIN {_SB} b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900 GROUP BY a.k)"


@query(f"SELECT k, g > 0 AS standalone, g > 0 AND near >= 1 AS neighbour, g > 0 AND near >= 3 AND (g = 2 OR near2 >= 1) AS cluster FROM {_ACCEPT}")
def acceptance_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three strategies for when one sensor's grade stands by itself."""
    g = F.when(F.col("c_acctbal") > 8000, 2).when(F.col("c_acctbal") > 5000, 1).otherwise(0)
    rows = points(spark, sf_dir, "customer", "c_custkey", "c_acctbal").withColumn("g", g)
    return fusion.accepted(rows, 30.0)


@query(f"""WITH n AS (SELECT a.r, a.c, a.v, a.n, (SELECT v FROM {GRID} b WHERE b.r = a.r - 1 AND b.c = a.c) AS n1, (SELECT v FROM {GRID} b WHERE b.r = a.r + 1 AND b.c = a.c) AS n2, (SELECT v FROM {GRID} b WHERE b.r = a.r AND b.c = a.c - 1) AS w1, (SELECT v FROM {GRID} b WHERE b.r = a.r AND b.c = a.c + 1) AS w2 FROM {GRID} a),
s AS (SELECT *, degrees(atan(sqrt(pow(coalesce((n2 - n1) / 60, (n2 - v) / 30, (v - n1) / 30, 0), 2) + pow(coalesce((w2 - w1) / 60, (w2 - v) / 30, (v - w1) / 30, 0), 2)))) AS slope FROM n)
SELECT r // 16 AS b, count(*) FILTER (v < 25 AND slope < 5 AND n > 2) AS water, round(count(*) FILTER (v < 25 AND slope < 5 AND n > 2) * 0.0009::DOUBLE, 6) AS km2 FROM s GROUP BY 1""")
def water_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark, flat cells of land or sea with enough looks, and their area."""
    wet = R.water(grid(spark, sf_dir), "v", "n", 30.0, 25.0)
    return wet.groupBy(F.floor(F.col("r") / 16).alias("b")).agg(F.count_if("water").alias("water"), F.round(F.count_if("water") * 0.0009, 6).alias("km2"))


@query("""SELECT s_suppkey AS k, (20.0 + s_suppkey % 30) * (15.0 + s_suppkey % 20)::DOUBLE AS area, (20.0 + s_suppkey % 30)::DOUBLE AS width, (15.0 + s_suppkey % 20)::DOUBLE AS height, round(sqrt(pow(20.0 + s_suppkey % 30, 2) + pow(15.0 + s_suppkey % 20, 2)), 6) AS diagonal FROM supplier""")
def polygon_extent_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import shapes
    from .shapes import _boxes

    x0, y0, x1, y1 = shapes.box(F.col("ring"))
    rows = _boxes(spark, sf_dir).select("k", S.polygon_area(F.col("ring")).alias("area"), (x1 - x0).alias("width"), (y1 - y0).alias("height"))
    return rows.withColumn("diagonal", F.round(F.hypot("width", "height"), 6))


#: Parcels: rectangles of 25 by 40 over the ground, number 1000 * column + row.
_PARCELS = "(SELECT i * 1000 + j AS parcel, i * 25.0::DOUBLE AS x0, j * 40.0::DOUBLE AS y0 FROM range(0, 43) a(i), range(0, 28) b(j))"


@query(f"""WITH b AS (SELECT s_suppkey AS k, (s_suppkey * 53 % 997)::DOUBLE AS x0, (s_suppkey * 29 % 1009)::DOUBLE AS y0, 20.0::DOUBLE + s_suppkey % 30 AS w, 15.0::DOUBLE + s_suppkey % 20 AS h FROM supplier),
o AS (SELECT k, parcel, greatest(0, least(b.x0 + w, p.x0 + 25) - greatest(b.x0, p.x0)) * greatest(0, least(b.y0 + h, p.y0 + 40) - greatest(b.y0, p.y0)) / (w * h) AS s FROM b, {_PARCELS} p)
SELECT k, CASE WHEN k % 3 = 0 THEN k ELSE arg_min(parcel, row(-round(s, 9), parcel)) END AS parcel, CASE WHEN k % 3 = 0 THEN 'register' ELSE 'overlap' END AS how, CASE WHEN k % 3 <> 0 THEN round(max(s), 6) END AS share FROM o GROUP BY k""")
def parcel_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A building's parcel from the register, else the one that covers most of its footprint."""
    from ..operators import shapes
    from .shapes import _boxes

    buildings = _boxes(spark, sf_dir)
    x, y = F.col("i") * 25.0, F.col("j") * 40.0
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    cells = spark.range(43 * 28).select(F.expr("id div 28").alias("i"), (F.col("id") % 28).alias("j"))
    parcels = cells.select((F.col("i") * 1000 + F.col("j")).alias("parcel"), F.array(at(x, y), at(x + 25.0, y), at(x + 25.0, y + 40.0), at(x, y + 40.0)).alias("ring"))
    both = shapes.attributed(buildings, parcels, "k", "parcel", "ring", 50.0).join(buildings.filter("k % 3 = 0").select("k", F.col("k").alias("_r")), "k", "left")
    return both.select("k", F.coalesce("_r", "parcel").alias("parcel"), F.when(F.col("_r").isNotNull(), F.lit("register")).otherwise(F.lit("overlap")).alias("how"), F.when(F.col("_r").isNull(), F.round("share", 6)).alias("share"))
