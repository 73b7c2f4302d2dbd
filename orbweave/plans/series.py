"""Queries of time series and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..catalog import query, table
from ..functions import grades as G
from ..operators import decomposition as D, runs as R, series as T
from .common import SERIES, series

_U = ["u"]


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("""SELECT p_partkey, d::DATE AS date, disp FROM (SELECT p_partkey, unnest(['2024-01-01', '2024-01-13', '2024-01-25']) AS d, unnest([p_retailprice, p_retailprice - p_size, CASE WHEN p_size > 5 THEN p_retailprice * 0.5 END]) AS disp FROM part) WHERE disp IS NOT NULL""")
def wide_to_long_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("D20240101"), (F.col("p_retailprice") - F.col("p_size")).alias("D20240113"), F.when(F.col("p_size") > 5, F.col("p_retailprice") * 0.5).alias("D20240125"))
    return T.unpivot_epochs(wide, ["p_partkey"]).filter(F.col("disp").isNotNull())


_NET = f"""(WITH a AS (SELECT *, t >= max(t) OVER (PARTITION BY u) - 10 AS inside FROM {SERIES}), b AS (SELECT *, count(*) FILTER (inside) OVER (PARTITION BY u) AS n FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY i) AS up, row_number() OVER (PARTITION BY u ORDER BY i DESC) AS down FROM b WHERE inside OR n < 6) SELECT u, median(v) FILTER (up <= 3) - median(v) FILTER (down <= 3) AS risk FROM c GROUP BY u)"""


@query(f"SELECT u, round(risk, 6) AS risk FROM {_NET}")
def robust_net_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.robust_net(series(spark, sf_dir), _U, "i", "t", "v", 10.0), 6, "risk")


_SMOOTH = f"(SELECT *, count(*) OVER (PARTITION BY u) AS n, median(v) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM {SERIES})"


def _slopes_sql(k: int, col: str = "s") -> str:
    parts = ", ".join(f"coalesce(-regr_slope(CASE WHEN p = {j} THEN {col} END, CASE WHEN p = {j} THEN t END), 0) AS v{j}" for j in range(k))
    return f"(SELECT u, {parts} FROM (SELECT *, least({k - 1}, (i - 1) // (n // {k})) AS p FROM {_SMOOTH}) GROUP BY u)"


@query(f"SELECT u, round(v0, 6) AS early, round(v1, 6) AS late, round(v1 - v0, 6) AS delta FROM {_slopes_sql(2)}")
def two_segment_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.two_segment(T.smoothed(series(spark, sf_dir), _U, "i", "v"), _U, "i", "t", "s"), 6, "early", "late", "delta")


@query(f"SELECT u, round(v0, 6) AS v0, round(v1, 6) AS v1, round(v2, 6) AS v2, v0 <= v1 AND v1 <= v2 AS rising FROM {_slopes_sql(3)}")
def inflection_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.inflection(T.smoothed(series(spark, sf_dir), _U, "i", "v"), _U, "i", "t", "s"), 6, "v0", "v1", "v2")


_WIN = f"(SELECT *, CASE WHEN count(v) OVER w >= 8 THEN regr_slope(v, t) OVER w END AS slope, CASE WHEN count(v) OVER w >= 8 THEN avg(t) OVER w END AS tc FROM {SERIES} WINDOW w AS (PARTITION BY u ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"


@query(f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY u) AS n FROM {_WIN} WHERE slope IS NOT NULL) SELECT u, round(median(-slope) FILTER (k < n // 2), 6) AS early, round(median(-slope) FILTER (k >= n - n // 3), 6) AS late FROM k GROUP BY u")
def slide_window_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.slide_windows(series(spark, sf_dir), _U, "i", "t", "v"), 6, "early", "late")


_CREEP = f"(SELECT u, i, t, 1000 * ln(1 - t / (40 + u % 20)) + (v - 100) / 1000 AS v FROM {SERIES})"


@query(f"""WITH w AS (SELECT *, CASE WHEN count(v) OVER w >= 6 THEN regr_slope(v, t) OVER w END AS slope, CASE WHEN count(v) OVER w >= 6 THEN avg(t) OVER w END AS tc FROM {_CREEP} WINDOW w AS (PARTITION BY u ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY i DESC) AS k FROM w WHERE slope < 0), f AS (SELECT u, count(*) AS n, regr_slope(-1 / slope, tc) AS a, regr_intercept(-1 / slope, tc) AS b, regr_r2(-1 / slope, tc) AS r2, max(tc) AS e FROM k WHERE k <= 8 GROUP BY u HAVING n >= 3)
SELECT u, n, round(r2, 3) AS r2, CASE WHEN a < 0 AND -b / a - e BETWEEN 0 AND 3650 THEN round(-b / a, 2) END AS tf FROM f""")
def inverse_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    creep = series(spark, sf_dir).withColumn("v", 1000 * F.log(1 - F.col("t") / (40 + F.col("u") % 20)) + (F.col("v") - 100) / 1000)
    return T.inverse_velocity(creep, _U, "i", "t", "v").select("u", "n", F.round("r2", 3).alias("r2"), F.round("tf", 2).alias("tf"))


@query(f"SELECT event_id, round(CASE WHEN count(v) OVER w >= 4 THEN regr_slope(v, t) OVER w END, 5) AS trailing FROM {SERIES} WINDOW w AS (PARTITION BY u ORDER BY t RANGE BETWEEN 7 PRECEDING AND CURRENT ROW)")
def trailing_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.trailing_velocity(series(spark, sf_dir), _U, "t", "v", 7.0), 5, "trailing").select("event_id", "trailing")


_WALK = f"""(SELECT u, i, t, event_id, first_value(v) OVER p - v AS "cumF", first_value(v) OVER w - v AS cum, CASE WHEN count(v) OVER w >= 4 THEN -(regr_slope(v, t) OVER w) END AS vel, CASE WHEN count(v) OVER p >= 4 THEN -(regr_slope(v, t) OVER p) END AS vtr FROM {SERIES}
WINDOW w AS (PARTITION BY u ORDER BY t RANGE BETWEEN 10 PRECEDING AND CURRENT ROW), p AS (PARTITION BY u ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"""SELECT event_id, round("cumF", 6) AS "cumF", round(cum, 6) AS cum, round(vel, 5) AS vel, round(vtr, 5) AS vtr, round(vel - vtr, 5) AS dv FROM {_WALK}""")
def walk_forward_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.walk_forward(series(spark, sf_dir), _U, "i", "t", "v", 10.0)
    return _round(_round(out, 6, "cumF", "cum"), 5, "vel", "vtr", "dv").select("event_id", "cumF", "cum", "vel", "vtr", "dv")


@query(f"""SELECT event_id, round(v - lag(v) OVER w, 6) AS d1, round(v - lag(v, 3) OVER w, 6) AS d3, round(v - lag(v, 6) OVER w, 6) AS d6, CASE WHEN i > 3 THEN round((v - avg(v) OVER a) / nullif(stddev_pop(v) OVER a, 0), 5) END AS z3, CASE WHEN i > 6 THEN round((v - avg(v) OVER b) / nullif(stddev_pop(v) OVER b, 0), 5) END AS z6
FROM {SERIES} WINDOW w AS (PARTITION BY u ORDER BY i), a AS (PARTITION BY u ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY u ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def derive_d_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.derived(series(spark, sf_dir), _U, "i", "v")
    return _round(_round(out, 6, "d1", "d3", "d6"), 5, "z3", "z6").select("event_id", "d1", "d3", "d6", "z3", "z6")


def _fires_sql(k: int) -> str:
    return f"SELECT u, min(CASE WHEN h = {k} THEN i END) AS fire FROM (SELECT u, i, sum(CASE WHEN v > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS h FROM {SERIES}) GROUP BY u"


@query(f"SELECT a.u, a.fire AS k2, b.fire AS k4 FROM ({_fires_sql(2)}) a JOIN ({_fires_sql(4)}) b USING (u)")
def k_consecutive_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, flag = series(spark, sf_dir), F.col("v") > 60
    both = rows.withColumn("k2", R.held(flag, _U, "i", 2)).withColumn("k4", R.held(flag, _U, "i", 4))
    return both.groupBy("u").agg(*[F.min(F.when(F.col(k), F.col("i"))).alias(k) for k in ("k2", "k4")])


@query(f"SELECT u, round(CASE WHEN count(*) < 4 THEN max(v) ELSE max(low) END, 6) AS persist FROM (SELECT u, v, CASE WHEN count(x) OVER w = 4 THEN min(x) OVER w END AS low FROM (SELECT u, i, v, CASE WHEN i % 11 <> 0 THEN v END AS x FROM {SERIES}) WINDOW w AS (PARTITION BY u ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) GROUP BY u")
def persist_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).withColumn("x", F.when(F.col("i") % 11 != 0, F.col("v")))
    return _round(R.persist_max(rows, _U, "i", "x", 4), 6, "persist")


@query(f"SELECT u, max(i) AS record FROM (SELECT u, i, v, max(v) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {SERIES}) WHERE m IS NULL OR v > m GROUP BY u")
def running_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.records(series(spark, sf_dir), _U, "i", "v")


_PAD = ", ".join(f"coalesce(lag(v, {k}) OVER w, first_value(v) OVER e)" if k > 0 else "v" if not k else f"coalesce(lead(v, {-k}) OVER w, last_value(v) OVER e)" for k in range(2, -3, -1))


@query(f"""WITH s AS (SELECT *, list_sort([{_PAD}])[3] AS s FROM {SERIES} WINDOW w AS (PARTITION BY u ORDER BY i), e AS (PARTITION BY u ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m AS (SELECT u, median(abs(v - s)) AS mad FROM s GROUP BY u), n AS (SELECT *, v - s AS r, round_even((v - s) / 27.73, 0) AS n FROM s JOIN m USING (u))
SELECT event_id, round(CASE WHEN abs(n) BETWEEN 1 AND 3 AND abs(r - n * 27.73) <= 5 AND abs(r) > 4 * mad THEN v - n * 27.73 ELSE v END, 6) AS fixed FROM n""")
def unwrap_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.unwrapped(series(spark, sf_dir), _U, "i", "v"), 6, "fixed").select("event_id", "fixed")


@query(f"SELECT event_id, round(v - median(v) OVER (PARTITION BY i), 6) AS rest FROM {SERIES}")
def common_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.common_mode(series(spark, sf_dir), ["i"], "v"), 6, "rest").select("event_id", "rest")


@query(f"SELECT event_id, round(v - m, 6) AS rest FROM {SERIES} JOIN (SELECT i, avg(v) AS m FROM {SERIES} WHERE u % 10 = 0 GROUP BY i) USING (i)")
def rereference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.rereferenced(series(spark, sf_dir), ["i"], F.col("u") % 10 == 0, "v"), 6, "rest").select("event_id", "rest")


@query(f"SELECT event_id, round(CASE WHEN count(v) OVER w = 14 THEN avg(v) OVER w END, 6) AS mean FROM {SERIES} WINDOW w AS (PARTITION BY u ORDER BY i ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING)")
def centered_mean_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.centred_mean(series(spark, sf_dir), _U, "i", "v"), 6, "mean").select("event_id", "mean")


@query(f"SELECT u, round(sum(v * pow(0.8, n - i)) / sum(pow(0.8, n - i)), 6) AS ewm FROM (SELECT *, count(*) OVER (PARTITION BY u) AS n FROM {SERIES}) GROUP BY u")
def ewm_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.ewm(series(spark, sf_dir), _U, "i", "v", 0.2), 6, "ewm")


@query("""WITH m AS (SELECT o_custkey % 50 AS w, date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
d AS (SELECT w, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM m GROUP BY w), j AS (SELECT d.w, d.month, m.v, row_number() OVER (PARTITION BY d.w ORDER BY d.month) AS i FROM d LEFT JOIN m ON m.w = d.w AND m.month = d.month),
b AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY w ORDER BY i) AS a, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY w ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM j),
f AS (SELECT b.w, b.month, b.i, coalesce(b.v, x.v + (y.v - x.v) * (b.i - x.i) / (y.i - x.i)::DOUBLE) AS v FROM b LEFT JOIN j x ON x.w = b.w AND x.i = b.a LEFT JOIN j y ON y.w = b.w AND y.i = b.b)
SELECT w, month, round(v, 6) AS v, round(v - lag(v) OVER (PARTITION BY w ORDER BY month), 6) AS change FROM f""")
def monthly_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("w"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("v"))
    return _round(T.monthly(rows, ["w"], "date", "v"), 6, "v", "change").select("w", "month", "v", "change")


@query(f"""WITH RECURSIVE s AS (SELECT u, i, v - 90 AS d FROM {SERIES}), r AS (SELECT u, 0::BIGINT AS i, 50.0::DOUBLE AS m FROM s WHERE i = 1 UNION ALL SELECT s.u, s.i, greatest(0, least(100, r.m + s.d)) FROM r JOIN s ON s.u = r.u AND s.i = r.i + 1) SELECT u, round(arg_max(m, i), 6) AS level FROM r GROUP BY u""")
def recursive_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.clipped_walk(series(spark, sf_dir).withColumn("v", F.col("v") - 90), _U, "i", "v", 50.0, 0.0, 100.0), 6, "level")


@query()
def seasonal_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).withColumn("t", F.col("t") / 10)
    return _round(T.seasonal(rows, _U, "t", "v"), 4, "offset", "rate", "annual", "semiannual")


@query(f"""WITH RECURSIVE r AS (SELECT u, min(t) AS t FROM {SERIES} GROUP BY u UNION ALL SELECT r.u, (SELECT min(s.t) FROM {SERIES} s WHERE s.u = r.u AND s.t - r.t >= 1.5) FROM r WHERE r.t IS NOT NULL) SELECT u, round(t, 6) AS t FROM r WHERE t IS NOT NULL""")
def greedy_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.greedy_passes(series(spark, sf_dir), _U, "t", 1.5), 6, "t")


@query(f"SELECT u, min(i) AS start, max(i) AS stop, count(*) AS length FROM (SELECT u, i, i - row_number() OVER (PARTITION BY u ORDER BY i) AS g FROM {SERIES} WHERE v > 60) GROUP BY u, g")
def month_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.islands(series(spark, sf_dir), _U, "i", F.col("v") > 60)


@query(f"""SELECT u, round(regr_slope(CASE WHEN t BETWEEN 5 AND 20 THEN v END, CASE WHEN t BETWEEN 5 AND 20 THEN t END), 5) AS rate, round(arg_min(v, row(abs(t - 20), t)) - arg_min(v, row(abs(t - 5), t)), 6) AS delta FROM {SERIES} GROUP BY u""")
def window_rate_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_round(T.window_rate(series(spark, sf_dir), _U, "t", "v", 5.0, 20.0), 5, "rate"), 6, "delta")


@query(f"""WITH c AS (SELECT u, avg(t) AS m, avg(v) AS y, count(*) AS n FROM {SERIES} GROUP BY u), s AS (SELECT u, first(n) AS n, sum(pow(t - m, 2)) AS s2, sum(pow(t - m, 3)) AS s3, sum(pow(t - m, 4)) AS s4, sum((t - m) * (v - y)) AS xy, sum(pow(t - m, 2) * (v - y)) AS xxy, sum(pow(v - y, 2)) AS yy FROM {SERIES} JOIN c USING (u) GROUP BY u),
a AS (SELECT *, s4 - s3 * s3 / s2 - s2 * s2 / n AS q, (xxy - xy * s3 / s2) / (s4 - s3 * s3 / s2 - s2 * s2 / n) AS a FROM s) SELECT u, round(a, 5) AS acceleration, round(a / sqrt((yy - xy * xy / s2 - a * a * q) / (n - 3) / q), 4) AS t FROM a WHERE n > 3""")
def quadratic_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.quadratic(series(spark, sf_dir), _U, "t", "v").select("u", F.round("acceleration", 5).alias("acceleration"), F.round("t", 4).alias("t"))


@query(f"""WITH s AS (SELECT u, i, CASE WHEN i % 4 IN (1, 2) THEN v END AS v FROM {SERIES}), b AS (SELECT u, i, v, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY u ORDER BY i) AS a, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM s)
SELECT b.u, b.i, round(coalesce(b.v, x.v + (y.v - x.v) * (b.i - x.i) / nullif(y.i - x.i, 0)::DOUBLE, x.v, y.v), 6) AS s FROM b LEFT JOIN s x ON x.u = b.u AND x.i = b.a LEFT JOIN s y ON y.u = b.u AND y.i = b.b""")
def index_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("u", "i", F.when((F.col("i") % 4).isin(1, 2), F.col("v")).alias("v"))
    return _round(T.index_filled(rows, _U, "i", "v"), 6, "s").select("u", "i", "s")


@query(f"SELECT u, round(median(g), 6) AS typical, round(max(g), 6) AS longest FROM (SELECT u, t - lag(t) OVER (PARTITION BY u ORDER BY i) AS g FROM {SERIES}) GROUP BY u")
def gap_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = series(spark, sf_dir).withColumn("g", F.col("t") - F.lag("t").over(Window.partitionBy("u").orderBy("i")))
    return gaps.groupBy("u").agg(F.round(F.median("g"), 6).alias("typical"), F.round(F.max("g"), 6).alias("longest"))


@query(f"SELECT event_id, round(100 * (v - lo) / nullif(hi - lo, 0), 5) AS wet, round(v - min(v) OVER (PARTITION BY u, i % 3), 6) AS above FROM {SERIES} JOIN (SELECT u, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM {SERIES} GROUP BY u) USING (u)")
def change_index_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent between dry and wet references, and the distance from a class's own minimum."""
    rows = series(spark, sf_dir)
    ends = rows.groupBy("u").agg(F.percentile("v", 0.1).alias("lo"), F.percentile("v", 0.9).alias("hi"))
    both = rows.join(ends, "u").withColumn("k", F.col("i") % 3)
    return both.select("event_id", F.round(F.try_divide(100 * (F.col("v") - F.col("lo")), F.col("hi") - F.col("lo")), 5).alias("wet"), F.round(F.col("v") - F.min("v").over(Window.partitionBy("u", "k")), 6).alias("above"))


@query(f"""WITH g AS (SELECT u, CASE WHEN risk >= 100 THEN 2 WHEN risk >= 30 THEN 1 ELSE 0 END AS gc, CASE WHEN v1 >= 10 THEN 2 WHEN v1 >= 5 THEN 1 ELSE 0 END AS gv, CASE WHEN v1 - v0 >= 6 AND v1 >= 3 THEN 2 WHEN v1 - v0 >= 3 AND v1 >= 3 THEN 1 ELSE 0 END AS gt FROM {_NET} JOIN {_slopes_sql(2)} USING (u)),
b AS (SELECT *, greatest(gv, gc, gt) AS grade FROM g), n AS (SELECT *, CASE WHEN grade = 0 THEN '-' ELSE array_to_string(list_filter([CASE WHEN gv = grade THEN 'velocity' END, CASE WHEN gc = grade THEN 'cumulative' END, CASE WHEN gt = grade THEN 'trend' END], lambda x: x IS NOT NULL), '+') END AS basis FROM b)
SELECT ['정상', '주의', '위험'][grade + 1] AS label, basis, count(*) AS n FROM n GROUP BY 1, 2""")
def grade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net movement, velocity and trend of each series to one grade with its basis, counted."""
    rows = series(spark, sf_dir)
    trend = T.two_segment(T.smoothed(rows, _U, "i", "v"), _U, "i", "t", "s")
    both = T.robust_net(rows, _U, "i", "t", "v", 10.0).join(trend, "u")
    late, delta = F.col("late"), F.col("delta")
    gv, gc = G.ladder(late, ((5.0, 1), (10.0, 2))), G.ladder(F.col("risk"), ((30.0, 1), (100.0, 2)))
    gt = F.when(late >= 3, G.ladder(delta, ((3.0, 1), (6.0, 2)))).otherwise(F.lit(0))
    graded = both.select(gv.alias("gv"), gc.alias("gc"), gt.alias("gt"))
    named = (("velocity", F.col("gv")), ("cumulative", F.col("gc")), ("trend", F.col("gt")))
    return graded.select(G.label(G.worst("gv", "gc", "gt")).alias("label"), G.basis(named).alias("basis")).groupBy("label", "basis").agg(F.count(F.lit(1)).alias("n"))


_GRADE = "CASE WHEN late >= 0 THEN CASE WHEN late - early >= 4 THEN 2 WHEN late - early >= 1 THEN 1 ELSE 0 END ELSE 0 END"
_SHORT = f"(SELECT u FROM {SERIES} GROUP BY u HAVING count(*) < 40)"


@query(f"""WITH two AS (SELECT 'two_segment' AS method, u, v0 AS early, v1 AS late, {_GRADE.replace('late', 'v1').replace('early', 'v0')} AS grade FROM {_slopes_sql(2)}),
three AS (SELECT 'inflection' AS method, u, v0 AS early, v2 AS late, CASE WHEN v0 <= v1 AND v1 <= v2 THEN {_GRADE.replace('late', 'v2').replace('early', 'v0')} ELSE 0 END AS grade FROM {_slopes_sql(3)})
SELECT method, u, CASE WHEN u IN {_SHORT} THEN 0 ELSE grade END AS grade, CASE WHEN u IN {_SHORT} THEN 0 ELSE round(late, 6) END AS late, CASE WHEN u IN {_SHORT} THEN 0 ELSE round(early, 6) END AS early FROM (FROM two UNION ALL FROM three)""")
def trend_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend grades by method; series of fewer than forty rows are normal."""
    rows, out = series(spark, sf_dir), None
    for method in ("two_segment", "inflection"):
        one = T.trend_grades(rows, _U, "i", "t", "v", method, 40, watch=1.0, danger=4.0).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return _round(out, 6, "late", "early").select("method", "u", "grade", "late", "early")


@query()
def walk_forward_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve features of every epoch of buffers of ten series each."""
    rows = series(spark, sf_dir).withColumn("alpha", 1 + (F.col("u") % 3) / 2)
    return T.buffer_bank(T.walk_forward_bank(rows, _U, "i", "t", "v", "alpha", 5.0).withColumn("buffer", F.floor(F.col("u") / 10)), ["buffer"], "i")


@query()
def season_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend, weekly season and rest of daily series, outliers weighed down in a robust round."""
    daily = D.regular(series(spark, sf_dir), _U, "t", "v", 1.0)
    return _round(D.stl(daily, _U, "k", "v", 7, outer=1), 6, "v", "seasonal", "trend", "rest", "weight")
