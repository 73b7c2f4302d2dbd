"""Queries of aggregates and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query, table
from ..operators import stats as A
from .common import GRID, SERIES, grid, series


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


@query("""
WITH layers AS (SELECT l_suppkey, l_partkey % 10 AS layer, min(l_quantity) AS low, max(l_quantity) AS high, median(l_quantity) AS mid, arg_min(l_returnflag, row(l_shipdate, l_orderkey, l_linenumber, l_returnflag)) AS kind FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, count(*) AS layers, min(low) AS lowest, sum(CASE WHEN kind = 'R' THEN 1 ELSE 0 END)::BIGINT AS soft, round(avg(mid), 6) AS mid, min(kind) AS kind FROM layers GROUP BY 1""")
def group_first_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers, then boreholes; `first` follows an explicit order."""
    layers = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 10).alias("layer")).agg(
        F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.median("l_quantity").alias("mid"), F.min_by("l_returnflag", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag")).alias("kind")
    )
    return layers.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("layers"), F.min("low").alias("lowest"), F.count_if(F.col("kind") == "R").alias("soft"), F.round(F.avg("mid"), 6).alias("mid"), F.min("kind").alias("kind"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P, count(*) AS total FROM orders GROUP BY 1""")
def crosstab_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return counts.withColumn("total", F.col("F") + F.col("O") + F.col("P"))


@query("SELECT year(l_shipdate) AS year, " + ", ".join(f"round(sum(l_extendedprice) FILTER (WHERE month(l_shipdate) = {m}), 2) AS m{m}" for m in range(1, 13)) + " FROM lineitem GROUP BY 1")
def pivot_year_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), "l_extendedprice")
    wide = rows.groupBy("year").pivot("month", list(range(1, 13))).agg(F.sum("l_extendedprice"))
    return wide.select("year", *[F.round(f"{m}", 2).alias(f"m{m}") for m in range(1, 13)])


_MONTHLY = "(SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, o_custkey % 50 AS route, avg(o_totalprice) AS sic, sum(o_totalprice) AS gfw FROM orders GROUP BY 1, 2, 3)"


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), (F.col("o_custkey") % 50).alias("route")).agg(F.avg("o_totalprice").alias("sic"), F.sum("o_totalprice").alias("gfw"))


@query(f"SELECT route, year, min(CASE WHEN sic < 200000 THEN month END) AS open_start, max(CASE WHEN sic < 200000 THEN month END) AS open_end, count(CASE WHEN sic < 200000 THEN 1 END) AS open_duration, round(sum(CASE WHEN sic < 200000 THEN gfw END), 2) AS gfw_total FROM {_MONTHLY} GROUP BY 1, 2")
def open_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_open = F.col("sic") < 200_000
    return _monthly(spark, sf_dir).groupBy("route", "year").agg(
        F.min(F.when(is_open, F.col("month"))).alias("open_start"), F.max(F.when(is_open, F.col("month"))).alias("open_end"), F.count(F.when(is_open, 1)).alias("open_duration"), F.round(F.sum(F.when(is_open, F.col("gfw"))), 2).alias("gfw_total")
    )


@query("""SELECT l_suppkey, min(q) AS mode FROM (SELECT l_suppkey, l_quantity AS q, rank() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1 GROUP BY 1""")
def mode_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.mode("l_quantity", deterministic=True).alias("mode"))


@query("""SELECT source, array_to_string(list_sort(list(DISTINCT lang)), '+') AS langs, count(DISTINCT text) AS texts FROM documents GROUP BY 1""")
def sorted_distinct_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), "+").alias("langs"), F.countDistinct("text").alias("texts"))


@query("""SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10""")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


@query("""SELECT n, round(avg(CASE WHEN area < 400000 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS parcels FROM (SELECT c_nationkey AS n, o_custkey, sum(o_totalprice) AS area FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1""")
def share_below_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per parcel, then the share of small ones per district."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    parcels = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("area")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return parcels.groupBy(F.col("c_nationkey").alias("n")).agg(F.round(F.avg(F.when(F.col("area") < 400_000, 1.0).otherwise(0.0)), 6).alias("share"), F.count(F.lit(1)).alias("parcels"))


@query(f"SELECT r, c, round(v, 6) AS v, n FROM {GRID} WHERE n >= 10")
def grid_mean_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).filter("n >= 10").select("r", "c", _r("v"), "n")


@query("""SELECT l_partkey % 64 AS r, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 5) AS variance, round(median(l_quantity), 6) AS mid FROM lineitem GROUP BY 1""")
def grid_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 64).alias("r")).agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.var_pop("l_quantity"), 5).alias("variance"), F.round(F.median("l_quantity"), 6).alias("mid"))


@query(f"""SELECT u, round(max(v), 6) AS v_max, round(quantile_cont(v, 0.9), 6) AS v_p90, round(list_avg(list_slice(list_sort(list(v), 'DESC'), 1, 3)), 6) AS v_top3, round(median(v), 6) AS v_median, round(avg(CASE WHEN v >= 100 THEN 1.0 ELSE 0.0 END), 6) AS v_share FROM {SERIES} GROUP BY u""")
def feature_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.bank(series(spark, sf_dir), ["u"], "v", 100.0).drop("n")
    return out.select("u", *[_r(c) for c in out.columns[1:]])


@query("""WITH k AS (SELECT l_suppkey AS s, l_extendedprice AS v, count(*) OVER (PARTITION BY l_suppkey) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS k FROM lineitem) SELECT s, round(avg(v), 4) AS v, first(n) AS n FROM k WHERE n < 5 OR (k >= floor(n * 0.2) AND k < n - floor(n * 0.4)) GROUP BY s""")
def trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("v"))
    return A.trimmed_mean(rows, ["s"], "v").select("s", _r("v", 4), "n")


@query("""WITH m AS (SELECT l_suppkey AS s, median(l_extendedprice) AS centre FROM lineitem GROUP BY 1) SELECT s, round(centre, 4) AS centre, round(1.4826 * median(abs(l_extendedprice - centre)), 4) AS sigma FROM lineitem JOIN m ON s = l_suppkey GROUP BY 1, 2""")
def robust_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("v"))
    return A.robust_sigma(rows, ["s"], "v").select("s", _r("centre", 4), _r("sigma", 4))


def _clipped(k: int) -> str:
    if not k:
        return f"SELECT u, avg(v) AS m, stddev_pop(v) AS s, count(v) AS n FROM {SERIES} GROUP BY u"
    return f"SELECT x.u, avg(x.v) AS m, stddev_pop(x.v) AS s, count(x.v) AS n FROM {SERIES} x JOIN ({_clipped(k - 1)}) p ON p.u = x.u AND abs(x.v - p.m) <= 2 * p.s GROUP BY x.u"


@query(f"SELECT u, round(m, 6) AS v, n FROM ({_clipped(3)})")
def sigma_clipped_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.clipped_mean(series(spark, sf_dir), ["u"], "v", 2.0, 3).select("u", _r("v"), "n")


@query(f"""SELECT u, round(regr_slope(v, t), 6) AS slope, round(regr_intercept(v, t), 5) AS intercept, round(regr_r2(v, t), 6) AS r2 FROM {SERIES} GROUP BY u""")
def ols_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).groupBy("u").agg(F.round(A.slope(F.col("v"), F.col("t")), 6).alias("slope"), F.round(F.regr_intercept("v", "t"), 5).alias("intercept"), F.round(F.regr_r2("v", "t"), 6).alias("r2"))


@query(f"SELECT a.u, round(median((b.v - a.v) / (b.t - a.t)), 6) AS slope, count(*) AS pairs FROM {SERIES} a JOIN {SERIES} b ON a.u = b.u AND b.t > a.t GROUP BY a.u")
def theil_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.theil_sen(series(spark, sf_dir), ["u"], "t", "v").select("u", _r("slope"), "pairs")


@query(f"""WITH v AS (SELECT u, sum(n) AS n, (sum(n) * (sum(n) - 1) * (2 * sum(n) + 5) - sum(n * (n - 1) * (2 * n + 5))) / 18.0 AS var FROM (SELECT u, v, count(*) AS n FROM {SERIES} GROUP BY u, v) GROUP BY u)
SELECT u, n::BIGINT AS n, s, round(var, 6)::DOUBLE AS variance, round((s - sign(s)) / sqrt(var), 6) AS z FROM (SELECT a.u, sum(sign(b.v - a.v))::BIGINT AS s FROM {SERIES} a JOIN {SERIES} b ON a.u = b.u AND b.i > a.i GROUP BY a.u) JOIN v USING (u)""")
def mann_kendall_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mann_kendall(series(spark, sf_dir), ["u"], "i", "v").filter("n > 1").select("u", "n", "s", _r("variance"), _r("z"))


@query("""WITH r AS (SELECT l_suppkey AS s, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / 2.0::DOUBLE AS b, l_quantity AS q, l_discount AS d FROM lineitem) SELECT s, round(corr(a, b), 6) AS spearman, round(corr(q, d), 6) AS pearson FROM r GROUP BY s""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), "l_quantity", "l_discount")
    ranked = A.average_ranks(A.average_ranks(rows, ["s"], "l_quantity", "a"), ["s"], "l_discount", "b")
    return ranked.groupBy("s").agg(F.round(F.corr("a", "b"), 6).alias("spearman"), F.round(F.corr("l_quantity", "l_discount"), 6).alias("pearson"))


@query(f"""SELECT u, round(ma - mb, 6) AS difference, round((ma - mb) / sqrt(va + vb), 6) AS t, round(pow(va + vb, 2) / (va * va / (na - 1) + vb * vb / (nb - 1)), 5) AS df FROM (SELECT u, avg(v) FILTER (t >= 15) AS ma, avg(v) FILTER (t < 15) AS mb, var_samp(v) FILTER (t >= 15) / count(*) FILTER (t >= 15) AS va, var_samp(v) FILTER (t < 15) / count(*) FILTER (t < 15) AS vb, count(*) FILTER (t >= 15) AS na, count(*) FILTER (t < 15) AS nb FROM {SERIES} GROUP BY u)""")
def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series(spark, sf_dir).groupBy("u").agg(*A.welch(F.col("v"), F.col("t") >= 15))
    return out.select("u", _r("difference"), _r("t"), _r("df", 5))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(d), 6) AS bias, round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(stddev_pop(d), 6) AS ubrmse, round(pow(corr(e, q), 2), 6) AS r2, round(regr_slope(e, q), 6) AS slope FROM (SELECT l_returnflag, l_extendedprice / 1000 AS e, l_quantity AS q, l_extendedprice / 1000 - l_quantity AS d FROM lineitem) GROUP BY 1""")
def paired_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*A.paired(F.col("l_extendedprice") / 1000, F.col("l_quantity")))
    return out.select("l_returnflag", "n", *[_r(c) for c in out.columns[2:]])


_SCORES = "(SELECT lang AS g, n_chars // 50 AS s, quality = 1 AS p FROM labels JOIN documents USING (doc_id))"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select(F.col("lang").alias("g"), F.floor(F.col("n_chars") / 50).alias("s"), (F.col("quality") == 1).alias("p"))


@query(f"SELECT a.g, count(DISTINCT CASE WHEN a.p THEN a.id END) AS positives, count(DISTINCT CASE WHEN NOT b.p THEN b.id END) AS negatives, round(avg(CASE WHEN a.p AND NOT b.p THEN CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END END), 9) AS auc FROM (SELECT row_number() OVER () AS id, * FROM {_SCORES}) a JOIN (SELECT row_number() OVER () AS id, * FROM {_SCORES}) b ON a.g = b.g GROUP BY a.g")
def auc_rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.auc(_scores(spark, sf_dir), ["g"], "s", "p").select("g", "positives", "negatives", _r("auc", 9))


@query(f"""WITH c AS (SELECT g, s, count(*) FILTER (p) AS np, count(*) FILTER (NOT p) AS nn FROM {_SCORES} GROUP BY 1, 2),
r AS (SELECT *, (sum(np) OVER (PARTITION BY g ORDER BY s DESC))::DOUBLE / nullif(sum(np) OVER (PARTITION BY g), 0)::DOUBLE AS tpr, (sum(nn) OVER (PARTITION BY g ORDER BY s DESC))::DOUBLE / nullif(sum(nn) OVER (PARTITION BY g), 0)::DOUBLE AS fpr FROM c)
SELECT g, arg_max(s, row(round(tpr - fpr, 12), -s))::BIGINT AS youden, round(max(tpr - fpr), 9) AS j, min(CASE WHEN np > 0 THEN s END)::BIGINT AS conservative, min(CASE WHEN fpr <= 0.05 THEN s END)::BIGINT AS precise FROM r GROUP BY g""")
def youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.thresholds(_scores(spark, sf_dir), ["g"], "s", "p").select("g", "youden", _r("j", 9), "conservative", "precise")


@query(f"WITH x AS (SELECT u % 10 AS g, event_id, floor(v / 5)::BIGINT AS s, u % 7 = 0 AS a FROM {SERIES}) SELECT event_id, round((SELECT (count(*) FILTER (b.s < x.s) + count(*) FILTER (b.s <= x.s)) / (2.0 * count(*)) FROM x b WHERE b.g = x.g AND NOT b.a), 9)::DOUBLE AS share FROM x WHERE a")
def midrank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select((F.col("u") % 10).alias("g"), "event_id", F.floor(F.col("v") / 5).alias("s"), (F.col("u") % 7 == 0).alias("a"))
    return A.midrank_share(rows.filter("a").drop("a"), rows.filter("not a").drop("a"), ["g"], "s").select("event_id", _r("share", 9))


@query("""WITH a AS (SELECT floor(l_quantity / 10) AS q, floor(l_discount * 50) AS d, count(*) FILTER (l_returnflag = 'R') AS nt, count(*) FILTER (l_returnflag <> 'R') AS nc, median(l_extendedprice) FILTER (l_returnflag = 'R') AS mt, median(l_extendedprice) FILTER (l_returnflag <> 'R') AS mc FROM lineitem GROUP BY 1, 2 HAVING nt >= 30 AND nc >= 30) SELECT count(*) AS strata, sum(nt)::BIGINT AS treated, round(sum((mt - mc) * nt) / sum(nt), 4) AS difference FROM a""")
def matched_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_quantity") / 10).alias("q"), F.floor(F.col("l_discount") * 50).alias("d"), (F.col("l_returnflag") == "R").alias("hit"), "l_extendedprice")
    return A.matched_difference(rows, ["q", "d"], "hit", "l_extendedprice", 30).select("strata", "treated", _r("difference", 4))


@query("""WITH b AS (SELECT l_returnflag AS g, floor(l_discount / 0.02) AS b, count(*) AS n, quantile_cont(l_extendedprice, 0.99) AS y FROM (SELECT *, l_discount + 0.005 AS x FROM lineitem) GROUP BY 1, 2 HAVING n >= 50) SELECT g, round(regr_slope(y, (b + 0.5) * 0.02), 3) AS slope, round(regr_intercept(y, (b + 0.5) * 0.02), 3) AS intercept, count(*) AS bins FROM b GROUP BY g""".replace("floor(l_discount / 0.02)", "floor((l_discount + 0.005) / 0.02)"))
def envelope_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_discount") + 0.005).alias("x"), F.col("l_extendedprice").alias("y"))
    return A.envelope(rows, ["g"], "x", "y", 0.02, 0.99, 50).select("g", _r("slope", 3), _r("intercept", 3), "bins")


@query(f"""WITH g AS (SELECT r // 16 AS k, r, c, v FROM {GRID}), m AS (SELECT k, avg(c) AS x, avg(r) AS y, avg(v) AS z, covar_pop(c, c) AS xx, covar_pop(r, r) AS yy, covar_pop(c, r) AS xy, covar_pop(c, v) AS xz, covar_pop(r, v) AS yz FROM g GROUP BY k),
p AS (SELECT k, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b, x, y, z FROM m) SELECT r, c, round(v - a * c - b * r - (z - a * x - b * y), 6) AS rest FROM g JOIN p USING (k)""")
def plane_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid(spark, sf_dir).withColumn("k", F.floor(F.col("r") / 16))
    return A.without_plane(rows, ["k"], "c", "r", "v").select("r", "c", _r("rest"))


@query("""SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1, round(tp / nullif(tp + fp + fn, 0)::DOUBLE, 6) AS iou FROM (SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 500) AS tp, count(*) FILTER (quality = 0 AND n_chars > 500) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 500) AS fn FROM labels JOIN documents USING (doc_id) GROUP BY lang)""")
def confusion_prf_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    out = rows.groupBy("lang").agg(*A.confusion(F.col("quality") == 1, F.col("n_chars") > 500))
    return out.select("lang", "tp", "fp", "fn", *[_r(c) for c in out.columns[4:]])


@query("""SELECT c_custkey, ntile(3) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS tercile FROM customer""")
def tercile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return A.terciles(rows, ["c_mktsegment"], "c_acctbal", "c_custkey").select("c_custkey", "tercile")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def grade_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query(f"""SELECT u % 5 AS area, count(*) AS n, round(median(v), 6) AS mid, round(quantile_cont(v, 0.02), 6) AS p2, round(quantile_cont(v, 0.98), 6) AS p98, round(stddev_pop(v), 6) AS sd, round(avg(CASE WHEN v > 100 THEN 1.0 ELSE 0.0 END), 6) AS above FROM {SERIES} GROUP BY 1""")
def masked_area_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).groupBy((F.col("u") % 5).alias("area")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.median("v"), 6).alias("mid"), F.round(F.percentile("v", 0.02), 6).alias("p2"), F.round(F.percentile("v", 0.98), 6).alias("p98"), F.round(F.stddev_pop("v"), 6).alias("sd"), F.round(F.avg(F.when(F.col("v") > 100, 1.0).otherwise(0.0)), 6).alias("above")
    )


@query(f"""WITH o AS (SELECT u % 4 AS g, avg(v) AS m FROM {SERIES} WHERE u % 20 < 4 GROUP BY 1), n AS (SELECT u % 4 AS g, u, avg(v) AS m FROM {SERIES} WHERE u % 20 >= 4 GROUP BY 1, 2)
SELECT g, round(avg(CASE WHEN n.m < o.m THEN 1.0 ELSE 0.0 END), 6) AS share, round((first(o.m) - avg(n.m)) / stddev_samp(n.m), 6) AS z, count(*) AS n FROM n JOIN o USING (g) GROUP BY g""")
def null_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observed mean against those of placebo series: its percentile and z."""
    rows = series(spark, sf_dir).withColumn("g", F.col("u") % 4)
    seen = rows.filter("u % 20 < 4").groupBy("g").agg(F.avg("v").alias("seen"))
    placebo = rows.filter("u % 20 >= 4").groupBy("g", "u").agg(F.avg("v").alias("m")).join(seen, "g")
    return placebo.groupBy("g").agg(F.round(F.avg(F.when(F.col("m") < F.col("seen"), 1.0).otherwise(0.0)), 6).alias("share"), F.round((F.first("seen") - F.avg("m")) / F.stddev_samp("m"), 6).alias("z"), F.count(F.lit(1)).alias("n"))


_TREND = "(SELECT route, year, count(CASE WHEN sic < 200000 THEN 1 END) AS d FROM " + _MONTHLY + " GROUP BY 1, 2)"


@query(f"SELECT route, round(regr_slope(d, year), 6) AS slope, round(regr_intercept(d, year), 3) AS intercept, round(regr_r2(d, year), 6) AS r2, count(*) AS years FROM {_TREND} GROUP BY route")
def season_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = _monthly(spark, sf_dir).groupBy("route", "year").agg(F.count(F.when(F.col("sic") < 200_000, 1)).alias("d"))
    return years.groupBy("route").agg(F.round(F.regr_slope("d", "year"), 6).alias("slope"), F.round(F.regr_intercept("d", "year"), 3).alias("intercept"), F.round(F.regr_r2("d", "year"), 6).alias("r2"), F.count(F.lit(1)).alias("years"))


def _p_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t: one less twice the density's integral from 0 to |t|, by Simpson's rule."""
    density = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi() * {df}) * pow(1 + pow(abs({t}) * k / 2000.0, 2) / {df}, -({df} + 1) / 2.0)"
    return f"(1 - 2 * abs({t}) / 6000.0 * list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * {density})))"


@query(f"""
WITH s AS (SELECT o_custkey AS k, count(*) AS n, regr_slope(o_totalprice, d) AS slope, regr_sxx(o_totalprice, d) AS sxx, regr_sxy(o_totalprice, d) AS sxy, regr_syy(o_totalprice, d) AS syy FROM (SELECT o_custkey, o_totalprice, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS d FROM orders) GROUP BY 1),
t AS (SELECT k, n, slope, sxy * sxy / (sxx * syy) AS r2, sign(slope) * sqrt(slope * sxy * (n - 2) / (syy - slope * sxy)) AS t FROM s WHERE n > 4 AND sxx > 0)
SELECT k, n, round(slope, 4) AS slope, round(r2, 6) AS r2, round(t, 5) AS t, round({_p_sql('t', '(n - 2)')}, 7) AS p, p < 0.05 AS significant FROM (SELECT *, {_p_sql('t', '(n - 2)')} AS p FROM t)""")
def trend_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear trend of each series with the p of its slope."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("y"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("d"))
    out = rows.groupBy("k").agg(*A.trend_test(F.col("y"), F.col("d"))).filter((F.col("n") > 4) & F.col("t").isNotNull())
    return out.select("k", "n", _r("slope", 4), _r("r2"), _r("t", 5), _r("p", 7), (F.col("p") < 0.05).alias("significant"))


@query(f"""
WITH g AS (SELECT u, avg(v) FILTER (t >= 15) - avg(v) FILTER (t < 15) AS difference, var_samp(v) FILTER (t >= 15) / count(*) FILTER (t >= 15) AS va, var_samp(v) FILTER (t < 15) / count(*) FILTER (t < 15) AS vb, count(*) FILTER (t >= 15) AS na, count(*) FILTER (t < 15) AS nb FROM {SERIES} GROUP BY u),
w AS (SELECT u, difference, difference / sqrt(va + vb) AS t, pow(va + vb, 2) / (va * va / (na - 1) + vb * vb / (nb - 1)) AS df FROM g WHERE na > 1 AND nb > 1)
SELECT u, round(difference, 6) AS difference, round(df, 5) AS df, round({_p_sql('t', 'df')}, 7) AS p FROM w""")
def welch_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch's test of the values before and after an event, with its p."""
    out = series(spark, sf_dir).groupBy("u").agg(*A.welch_p(F.col("v"), F.col("t") >= 15), F.count_if(F.col("t") >= 15).alias("na"), F.count_if(F.col("t") < 15).alias("nb"))
    return out.filter("na > 1 AND nb > 1").select("u", _r("difference"), _r("df", 5), _r("p", 7))
