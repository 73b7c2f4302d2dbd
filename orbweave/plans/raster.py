"""Queries of rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query, table
from ..operators import raster as R
from .common import GRID, grid, points, points_sql


def _otsu_sql(cells: str, by: str = "b", v: str = "v", bins: int = 256) -> str:
    return f"""(WITH z AS (SELECT {by}, min({v}) AS lo, max({v}) AS hi FROM {cells} GROUP BY {by}), h AS (SELECT {by}, lo, hi, least({bins - 1}, floor(({v} - lo) / nullif((hi - lo) / {bins}, 0)))::BIGINT AS k, count(*) AS n FROM {cells} JOIN z USING ({by}) WHERE {v} IS NOT NULL GROUP BY ALL),
x AS (SELECT *, lo + (k + 0.5) * ((hi - lo) / {bins}) AS x FROM h WHERE k IS NOT NULL), s AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY k)::DOUBLE AS w, sum(n * x) OVER (PARTITION BY {by} ORDER BY k) AS m, sum(n) OVER (PARTITION BY {by})::DOUBLE AS aw, sum(n * x) OVER (PARTITION BY {by}) AS am FROM x)
SELECT {by}, arg_max(x, row(round(w / aw * ((aw - w) / aw) * pow(m / w - (am - m) / nullif(aw - w, 0), 2), 9), -k)) FILTER (aw > w) AS threshold FROM s GROUP BY {by})"""


_BANDED = f"(SELECT *, r // 16 AS b FROM {GRID})"


@query(f"SELECT b, round(threshold, 4) AS threshold FROM {_otsu_sql(_BANDED)}")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.otsu(grid(spark, sf_dir).withColumn("b", F.floor(F.col("r") / 16)), ["b"], "v").select("b", F.round("threshold", 4).alias("threshold"))


_RING = f"(SELECT x.* FROM {_BANDED} x WHERE EXISTS (SELECT 1 FROM {_BANDED} y WHERE y.b = x.b AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1 AND y.v < 24) AND EXISTS (SELECT 1 FROM {_BANDED} y WHERE y.b = x.b AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1 AND y.v >= 24))"


@query(f"SELECT o.b, round(CASE WHEN n >= 10 THEN e.threshold ELSE o.threshold END, 4) AS threshold, coalesce(n, 0) AS band FROM {_otsu_sql(_BANDED)} o LEFT JOIN {_otsu_sql(_RING)} e USING (b) LEFT JOIN (SELECT b, count(*) AS n FROM {_RING} GROUP BY b) USING (b)")
def edge_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.edge_otsu(grid(spark, sf_dir).withColumn("b", F.floor(F.col("r") / 16)), ["b"], "v", 24.0).select("b", F.round("threshold", 4).alias("threshold"), "band")


_TILED = f"(SELECT g.*, 0 AS z FROM {GRID} g JOIN (SELECT r // 8 AS tr, c // 8 AS tc, var_pop(v) AS s FROM {GRID} GROUP BY 1, 2) t ON g.r // 8 = tr AND g.c // 8 = tc WHERE s >= (SELECT quantile_cont(s, 0.75) FROM (SELECT var_pop(v) AS s FROM {GRID} GROUP BY r // 8, c // 8)))"


@query(f"SELECT round(threshold, 4) AS threshold FROM {_otsu_sql(_TILED, 'z')}")
def bmax_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tile_otsu(grid(spark, sf_dir), "v", 8).select(F.round("threshold", 4).alias("threshold"))


@query(f"SELECT code, count(*) AS cells, count(*) * 0.01::DOUBLE AS km2 FROM (SELECT CASE WHEN NOT coalesce(a.m, false) AND coalesce(b.m, false) THEN 1 WHEN coalesce(a.m, false) AND NOT coalesce(b.m, false) THEN 2 ELSE 0 END AS code FROM (SELECT r, c, v < 22 AS m FROM {GRID} WHERE c < 60) a FULL JOIN (SELECT r, c, w < 0.045 AS m FROM {GRID} WHERE c > 3) b USING (r, c)) GROUP BY code")
def change_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    before, after = cells.filter("c < 60").withColumn("m", F.col("v") < 22), cells.filter("c > 3").withColumn("m", F.col("w") < 0.045)
    return R.change_codes(before, after, "m").groupBy("code").agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * 0.01).alias("km2"))


@query(f"SELECT r, c, round(CASE WHEN abs(v + p) > 1e-9 AND (v - p) / (v + p) BETWEEN -1 AND 0 THEN (v - p) / (v + p) END, 6) AS ndfi, round((abs(p) - abs(v)) / (abs(p) + abs(v) + 1e-9), 6) AS ndfvi FROM (SELECT r, c, v, w * 500 AS p FROM {GRID})")
def ndfi_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir).withColumn("p", F.col("w") * 500)
    return cells.select("r", "c", F.round(R.ndfi(F.col("v"), F.col("p")), 6).alias("ndfi"), F.round(R.ndfvi(F.col("v"), F.col("p")), 6).alias("ndfvi"))


@query(f"SELECT zone, count(v) AS n, round(avg(v), 6) AS mean, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share FROM (SELECT (r // 8) * 8 + c // 8 AS zone, v - 25 AS v FROM {GRID} WHERE (r + c) % 3 <> 0) GROUP BY zone")
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    zones = cells.filter("(r + c) % 3 <> 0").select("r", "c", (F.floor(F.col("r") / 8) * 8 + F.floor(F.col("c") / 8)).alias("zone"))
    return R.zonal(cells.select("r", "c", (F.col("v") - 25).alias("v")), zones, "zone", "v").select("zone", "n", F.round("mean", 6).alias("mean"), F.round("share", 6).alias("share"))


@query(f"SELECT r // 4 AS r, c // 4 AS c, round(sqrt(pow(sum(ar * br + ai * bi), 2) + pow(sum(ai * br - ar * bi), 2)) / sqrt(sum(ar * ar + ai * ai) * sum(br * br + bi * bi)), 6) AS coherence FROM (SELECT r, c, v * cos(w * 60) AS ar, v * sin(w * 60) AS ai, v * cos(v) AS br, v * sin(v) AS bi FROM {GRID}) GROUP BY 1, 2")
def multilook_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, w = F.col("v"), F.col("w") * 60
    pair = grid(spark, sf_dir).select("r", "c", (v * F.cos(w)).alias("ar"), (v * F.sin(w)).alias("ai"), (v * F.cos(v)).alias("br"), (v * F.sin(v)).alias("bi"))
    return R.multilook(pair, 4).select("r", "c", F.round("coherence", 6).alias("coherence"))


@query(f"""SELECT r, c, round(CASE WHEN abs(det) >= 0.3 THEN (v * u2 - w * 100 * u1) / det END, 6) AS east, round(CASE WHEN abs(det) >= 0.3 THEN (e1 * w * 100 - e2 * v) / det END, 6) AS up
FROM (SELECT *, e1 * u2 - e2 * u1 AS det FROM (SELECT r, c, v, w, -sin(radians(30 + r % 15)) * cos(radians(-12)) AS e1, cos(radians(30 + r % 15)) AS u1, -sin(radians(30 + c % 15)) * cos(radians(192)) AS e2, cos(radians(30 + c % 15)) AS u2 FROM {GRID}))""")
def asc_dsc_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    e1, _, u1 = R.los_vector(30 + F.col("r") % 15, F.lit(-12.0))
    e2, _, u2 = R.los_vector(30 + F.col("c") % 15, F.lit(192.0))
    east, up = R.decompose(F.col("v"), F.col("w") * 100, e1, u1, e2, u2)
    return grid(spark, sf_dir).select("r", "c", F.round(east, 6).alias("east"), F.round(up, 6).alias("up"))


@query(f"""WITH n AS (SELECT a.r, a.c, a.v, (SELECT v FROM {GRID} b WHERE b.r = a.r - 1 AND b.c = a.c) AS n1, (SELECT v FROM {GRID} b WHERE b.r = a.r + 1 AND b.c = a.c) AS n2, (SELECT v FROM {GRID} b WHERE b.r = a.r AND b.c = a.c - 1) AS w1, (SELECT v FROM {GRID} b WHERE b.r = a.r AND b.c = a.c + 1) AS w2 FROM {GRID} a)
SELECT r, c, round(degrees(atan(sqrt(pow(coalesce((n2 - n1) / 60, (n2 - v) / 30, (v - n1) / 30, 0), 2) + pow(coalesce((w2 - w1) / 60, (w2 - v) / 30, (v - w1) / 30, 0), 2)))), 5) AS slope FROM n""")
def terrain_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.slope_degrees(grid(spark, sf_dir), "v", 30.0).select("r", "c", F.round("slope", 5).alias("slope"))


@query(f"SELECT r // 4 AS r, c // 4 AS c, round(avg(v), 6) AS v, count(v) AS n FROM {GRID} GROUP BY 1, 2")
def resample_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resampled(grid(spark, sf_dir), "v", 4).select("r", "c", F.round("v", 6).alias("v"), "n")


@query(f"SELECT floor(y / 100)::BIGINT AS r, floor(x / 100)::BIGINT AS c, round(sum(c_acctbal), 2) AS v FROM {points_sql('customer', 'c_custkey')} GROUP BY 1, 2")
def scatter_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scatter(points(spark, sf_dir, "customer", "c_custkey", F.col("c_acctbal").alias("v")), 100.0, "v").select("r", "c", F.round("v", 2).alias("v"))


@query(f"SELECT g.r, g.c, round(min(sqrt(pow((g.c + 0.5) * 10 - x, 2) + pow((g.r + 0.5) * 10 - y, 2))), 6) AS d FROM (SELECT r, c FROM range(-4, 106) a(r), range(-4, 106) b(c)) g, {points_sql('supplier', 's_suppkey')} p WHERE sqrt(pow((g.c + 0.5) * 10 - x, 2) + pow((g.r + 0.5) * 10 - y, 2)) <= 30 GROUP BY 1, 2")
def rasterize_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.buffered(points(spark, sf_dir, "supplier", "s_suppkey"), 30.0, 10.0).select("r", "c", F.round("d", 6).alias("d"))


@query(f"SELECT k FROM (SELECT k, row_number() OVER (PARTITION BY floor(x / 125), floor(y / 126.125) ORDER BY c_acctbal DESC, k) AS n FROM {points_sql('customer', 'c_custkey')}) WHERE n <= 5".replace("126.125", "125"))
def gcp_grid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five control points a cell: the limit is the feature."""
    return R.grid_limited(points(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), 125.0, 5, "c_acctbal").select("k")


_LUT = "(SELECT m / 100.0::DOUBLE AS moisture, 10 + m * 0.6::DOUBLE + s * 1.5::DOUBLE AS model FROM range(1, 50) a(m), range(0, 5) b(s))"


@query(f"SELECT r * 64 + c AS id, round(avg(moisture), 6) AS moisture, count(moisture) AS solutions FROM {GRID} LEFT JOIN {_LUT} ON abs(model - v) <= 0.3017 GROUP BY r, c")
def lut_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moistures of every roughness whose model meets the measurement, averaged."""
    m, s = spark.range(1, 50).withColumnRenamed("id", "m"), F.explode(F.sequence(F.lit(0), F.lit(4)))
    lut = m.select("m", s.alias("s")).select((F.col("m") / 100).alias("moisture"), (10 + F.col("m") * 0.6 + F.col("s") * 1.5).alias("model"))
    cells = grid(spark, sf_dir).select((F.col("r") * 64 + F.col("c")).alias("id"), "v")
    return R.lut_inverse(cells, lut, "id", "v", 0.3017, 0.5).select("id", F.round("moisture", 6).alias("moisture"), "solutions")


@query("""SELECT l_suppkey AS s, band, round(sum(weight * l_extendedprice) / sum(weight), 4) AS value FROM lineitem JOIN (SELECT band, l_quantity, 1.0 / (1 + abs(l_quantity - band * 12)) AS weight FROM (SELECT unnest([1, 2, 3, 4]) AS band), (SELECT DISTINCT l_quantity FROM lineitem) WHERE abs(l_quantity - band * 12) <= 8) USING (l_quantity) GROUP BY 1, 2""")
def band_integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral samples weighted by the response of four bands."""
    samples = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("wavelength"), F.col("l_extendedprice").alias("value"))
    waves = samples.select("wavelength").distinct().withColumn("band", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])))
    response = waves.withColumn("off", F.abs(F.col("wavelength") - F.col("band") * 12)).filter("off <= 8").select("band", "wavelength", (1 / (1 + F.col("off"))).alias("weight"))
    return R.band_mean(samples, response, ["s"]).select("s", "band", F.round("value", 4).alias("value"))


@query(f"SELECT r, c, round((v - d) * g - s, 6) AS v FROM {GRID} JOIN (SELECT c, min(v) AS d, 1 + c / 100.0::DOUBLE AS g, c % 3 AS s FROM {GRID} GROUP BY c) USING (c)")
def column_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    columns = cells.groupBy("c").agg(F.min("v").alias("dark")).select("c", "dark", (1 + F.col("c") / 100).alias("gain"), (F.col("c") % 3).alias("shift"))
    return R.calibrated(cells, columns, "v").select("r", "c", F.round("v", 6).alias("v"))


@query(f"SELECT r, c, round(CASE WHEN v > 0 THEN 10 * log10(v) END, 6) AS db, round(v / cos(radians(30 + c % 15)), 6) AS vertical, round(-55.465763 / (4 * pi()) * w, 8) AS mm, round(1 + 2 * v + 0.5 * w + 3 * v * w, 3) AS poly FROM {GRID}")
def cell_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, w = F.col("v"), F.col("w")
    return grid(spark, sf_dir).select(
        "r", "c", F.round(R.decibel(v), 6).alias("db"), F.round(R.los_to_vertical(v, 30 + F.col("c") % 15), 6).alias("vertical"), F.round(R.phase_to_mm(w), 8).alias("mm"), F.round(R.polynomial2(v, w, ((1.0, 0.5), (2.0, 3.0))), 3).alias("poly")
    )


@query("""SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice / 1000 - min(l_extendedprice / 1000) OVER w, 6) AS rise, count(*) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_partkey % 64, floor(l_discount * 50 + 1e-9))""")
def class_conditional_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of each cell against its driest state in the same class of cover."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_partkey") % 64).alias("cell"), F.floor(F.col("l_discount") * 50 + 1e-9).alias("cover"), (F.col("l_extendedprice") / 1000).alias("v"))
    return R.class_baseline(rows, ["cell"], "cover", "v").select("l_orderkey", "l_linenumber", "l_quantity", F.round("rise", 6).alias("rise"), "n")
