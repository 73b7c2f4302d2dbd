"""Queries of alarm rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..catalog import query
from ..operators import rules as R, runs, stats
from .common import SERIES, series

#: Units of events: every seventh is an accident at day 25, the others background; features are the value, its mean of three and its rise over three.
_F = f"""(SELECT u AS unit, CASE WHEN u % 7 = 0 THEN 'A' ELSE 'B' END AS kind, CASE WHEN u % 7 = 0 THEN 25.0::DOUBLE END AS t_acc, i, t, feature, value FROM (
SELECT u, i, t, 'v' AS feature, v AS value FROM {SERIES} UNION ALL SELECT u, i, t, 'mean' AS feature, avg(v) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value FROM {SERIES}
UNION ALL SELECT u, i, t, 'rise' AS feature, v - lag(v, 3) OVER (PARTITION BY u ORDER BY i) AS value FROM {SERIES}) WHERE value IS NOT NULL AND (u % 7 <> 0 OR t <= 25))"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("u").orderBy("i")
    rows = series(spark, sf_dir).withColumn("mean", F.avg("v").over(w.rowsBetween(-2, 0))).withColumn("rise", F.col("v") - F.lag("v", 3).over(w))
    accident = F.col("u") % 7 == 0
    long = rows.unpivot(["u", "i", "t"], ["v", "mean", "rise"], "feature", "value").filter(F.col("value").isNotNull() & (~accident | (F.col("t") <= 25)))
    return long.select(F.col("u").alias("unit"), F.when(accident, F.lit("A")).otherwise(F.lit("B")).alias("kind"), F.when(accident, F.lit(25.0)).alias("t_acc"), "i", "t", "feature", "value")


_MENU = [("steady", 3, "v", 40.0), ("steady", 3, "mean", 50.0), ("jump", 1, "rise", 150.0), ("high", 2, "mean", 90.0), ("both", 1, "v", 120.0), ("both", 1, "rise", 60.0)]
_MENU_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{r}', {k}, '{f}', {x}::DOUBLE)" for r, k, f, x in _MENU) + ") m(rule, k, feature, threshold))"


def _menu(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_MENU, "rule string, k int, feature string, threshold double")


def _fires(rules: str, features: str = _F) -> str:
    return f"""(WITH need AS (SELECT rule, count(*) AS need, first(k) AS k FROM {rules} GROUP BY rule), met AS (SELECT r.rule, unit, kind, t_acc, i, t, count(*) FILTER (value >= threshold) AS met FROM {features} f JOIN {rules} r ON r.feature = f.feature GROUP BY ALL),
h AS (SELECT m.*, met = need AS hit, k, row_number() OVER (PARTITION BY m.rule, unit ORDER BY i) AS n FROM met m JOIN need USING (rule)), r AS (SELECT *, n - coalesce(max(CASE WHEN NOT hit THEN n END) OVER (PARTITION BY rule, unit ORDER BY i), 0) >= k AS run FROM h)
SELECT rule, unit, kind, t_acc, min(CASE WHEN run THEN t END) AS fire FROM r GROUP BY ALL)"""


def _scores(fired: str) -> str:
    return f"""(SELECT rule, avg(CASE WHEN kind = 'A' THEN CASE WHEN fire <= t_acc THEN 1.0 ELSE 0.0 END END)::DOUBLE AS det, median(CASE WHEN kind = 'A' AND fire <= t_acc THEN t_acc - fire END) AS med, avg(CASE WHEN kind = 'B' THEN CASE WHEN fire IS NOT NULL THEN 1.0 ELSE 0.0 END END)::DOUBLE AS bg,
coalesce(median(CASE WHEN kind = 'A' AND fire <= t_acc THEN t_acc - fire END) / 365.25, 99) + 2 * avg(CASE WHEN kind = 'B' THEN CASE WHEN fire IS NOT NULL THEN 1.0 ELSE 0.0 END END)::DOUBLE AS j FROM {fired} GROUP BY rule)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("det", "med", "bg", "j") if c in df.columns})


_ROUND = "round(det, 6) AS det, round(med, 6) AS med, round(bg, 6) AS bg, round(j, 6) AS j"


@query(f"SELECT rule, {_ROUND} FROM {_scores(_fires(_MENU_SQL))}")
def rule_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A menu of rules: detection, lead and background."""
    return _rounded(R.scores(R.fires(_features(spark, sf_dir), _menu(spark))))


_SHARES = (0.5, 0.8, 0.9, 0.95)
_GRID_SQL = f"(SELECT DISTINCT feature, threshold FROM (SELECT feature, unnest(quantile_cont(value, [0.5, 0.8, 0.9, 0.95])) AS threshold FROM {_F} WHERE kind = 'B' GROUP BY feature))"


@query(f"SELECT feature, round(threshold, 6) AS threshold FROM {_GRID_SQL}")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.threshold_grid(_features(spark, sf_dir), list(_SHARES)).select("feature", F.round("threshold", 6).alias("threshold"))


_SINGLE_SQL = f"(SELECT feature || '|' || q || '|' || k AS rule, k, feature, threshold FROM (SELECT feature, unnest(quantile_cont(value, [0.5, 0.8, 0.9, 0.95])) AS threshold, unnest([50, 80, 90, 95]) AS q FROM {_F} WHERE kind = 'B' GROUP BY feature), (SELECT unnest([1, 2, 3]) AS k))"


@query(f"WITH s AS (SELECT r.feature, r.threshold, r.k, {_ROUND} FROM {_scores(_fires(_SINGLE_SQL))} JOIN {_SINGLE_SQL} r USING (rule)) SELECT feature, round(threshold, 6) AS threshold, k, det, med, bg, j FROM s")
def rule_search_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature, threshold of the grid and run length on its own."""
    features = _features(spark, sf_dir)
    grid = R.threshold_grid(features, list(_SHARES)).select(F.col("feature").alias("combo"), F.lit(1).alias("slot"), "feature", "threshold")
    scored = R.grid_scores(features, grid, [1, 2, 3]).select("*", F.inline("conditions"))
    return _rounded(scored).select("feature", F.round("threshold", 6).alias("threshold"), "k", "det", "med", "bg", "j")


def _stage(name: str, rules: str, width: int) -> str:
    """A stage of the search in SQL: rules has k and f1, x1 up to f3, x3."""
    parts = " UNION ALL ".join(f"SELECT rule, k, f{n} AS feature, x{n} AS threshold FROM {name}_r" for n in range(1, width + 1))
    return f"""{name}_r AS MATERIALIZED (SELECT row_number() OVER () AS rule, * FROM ({rules})), {name}_c AS MATERIALIZED ({parts}),
{name} AS MATERIALIZED (SELECT {width} AS n, k, f1, x1, f2, x2, f3, x3, det, med, bg, j FROM {_scores(_fires(f"{name}_c", "feats"))} s JOIN {name}_r USING (rule))"""


_KS = "(SELECT unnest([1, 2, 3, 4]) AS k)"
_NO = "NULL::VARCHAR AS f{0}, NULL::DOUBLE AS x{0}"
_BEST = "ORDER BY round(j, 9), n, f1, x1, f2, x2, f3, x3, k"


@query(f"""WITH feats AS MATERIALIZED (SELECT * FROM {_F}), g AS MATERIALIZED (SELECT DISTINCT feature, threshold FROM (SELECT feature, unnest(quantile_cont(value, [0.5, 0.8, 0.9, 0.95])) AS threshold FROM feats WHERE kind = 'B' GROUP BY feature)),
{_stage("one", f"SELECT k, feature AS f1, threshold AS x1, {_NO.format(2)}, {_NO.format(3)} FROM g, {_KS}", 1)},
top AS (SELECT DISTINCT f1 AS f FROM (SELECT f1 FROM one ORDER BY CASE WHEN det >= 0.7 THEN round(j, 9) ELSE 999 END, f1 LIMIT 8)),
{_stage("two", f"SELECT k, a.feature AS f1, a.threshold AS x1, b.feature AS f2, b.threshold AS x2, {_NO.format(3)} FROM g a, g b, {_KS} WHERE a.feature < b.feature AND a.feature IN (FROM top) AND b.feature IN (FROM top)", 2)},
base AS MATERIALIZED (SELECT * FROM (SELECT * FROM (FROM one UNION ALL FROM two) WHERE det >= 0.7 {_BEST} LIMIT 1) WHERE n = 2),
{_stage("three", f"SELECT kk.k, f1, x1, f2, x2, feature AS f3, threshold AS x3 FROM (SELECT f1, x1, f2, x2 FROM base), g, {_KS} kk WHERE feature NOT IN (f1, f2)", 3)}
SELECT k, f1, round(x1, 6) AS x1, f2, round(x2, 6) AS x2, f3, round(x3, 6) AS x3, {_ROUND} FROM (SELECT * FROM (FROM one UNION ALL FROM two UNION ALL FROM three) WHERE det >= 0.7 {_BEST} LIMIT 10)""")
def rule_search_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged search for short leads and little background: single conditions, pairs of the best features, a third condition. The ten best rules."""
    features = _features(spark, sf_dir)
    grid = R.threshold_grid(features, list(_SHARES))
    found = R.best_of(R.searched(features, grid, grid), 10)
    part = lambda n, name: F.get("conditions", F.lit(n - 1))[name]
    each = [c for n in (1, 2, 3) for c in (part(n, "feature").alias(f"f{n}"), F.round(part(n, "threshold"), 6).alias(f"x{n}"))]
    return _rounded(found).select("k", *each, "det", "med", "bg", "j")


@query(f"""WITH s AS (SELECT rule, round(det, 9) AS det, round(med, 9) AS med, round(bg, 9) AS bg FROM {_scores(_fires(_MENU_SQL))} WHERE med IS NOT NULL)
SELECT rule, round(det, 6) AS det, round(med, 6) AS med, round(bg, 6) AS bg FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.det >= a.det AND b.med <= a.med AND b.bg <= a.bg AND (b.det > a.det OR b.med < a.med OR b.bg < a.bg))""")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.pareto(R.scores(R.fires(_features(spark, sf_dir), _menu(spark)))))


_GATE_SQL = "(SELECT 'gate' AS rule, 1 AS k, 'mean' AS feature, 70.0::DOUBLE AS threshold)"
_LATER = f"(SELECT f.* FROM {_F} f JOIN {_fires(_GATE_SQL)} g USING (unit) WHERE f.t >= g.fire)"


@query(f"SELECT m.rule, w.unit, round(p.fire, 6) AS fire FROM (SELECT DISTINCT unit FROM {_F}) w CROSS JOIN (SELECT DISTINCT rule FROM {_MENU_SQL}) m LEFT JOIN {_fires(_MENU_SQL, _LATER)} p ON p.rule = m.rule AND p.unit = w.unit")
def gate_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-stage alarms on epochs after a first-stage gate."""
    gate = spark.createDataFrame([("gate", 1, "mean", 70.0)], "rule string, k int, feature string, threshold double")
    return R.gated(_features(spark, sf_dir), gate, _menu(spark)).select("rule", "unit", F.round("fire", 6).alias("fire"))


_TOP = f"(SELECT feature, unit, kind, floor(max(value) / 10)::BIGINT AS score FROM {_F} GROUP BY ALL)"


@query(f"""WITH s AS {_TOP}, th AS (SELECT DISTINCT feature, score AS th FROM s), f AS (SELECT a.feature, a.unit, a.score, th, round((SELECT count(*) FROM s x WHERE x.feature = a.feature AND x.kind = 'A' AND x.unit <> a.unit AND x.score >= th)::DOUBLE / (SELECT count(*) FROM s x WHERE x.feature = a.feature AND x.kind = 'A' AND x.unit <> a.unit)
 - (SELECT count(*) FROM s x WHERE x.feature = a.feature AND x.kind = 'B' AND x.score >= th)::DOUBLE / (SELECT count(*) FROM s x WHERE x.feature = a.feature AND x.kind = 'B'), 9) AS j FROM s a JOIN th USING (feature) WHERE a.kind = 'A')
SELECT feature, unit, score, arg_max(th, row(j, -th)) AS threshold, score >= arg_max(th, row(j, -th)) AS fired FROM f GROUP BY feature, unit, score""")
def loao_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds chosen without the accident they are then applied to."""
    scores = _features(spark, sf_dir).groupBy("feature", "unit", "kind").agg(F.floor(F.max("value") / 10).alias("score"))
    return R.leave_one_out(scores, ["feature"]).select("feature", "unit", "score", "threshold", "fired")


@query(f"""SELECT scale, round(avg(CASE WHEN u % 7 = 0 THEN CASE WHEN v >= greatest(60, scale * 120) THEN 1.0 ELSE 0.0 END END), 6)::DOUBLE AS recall, round(avg(CASE WHEN u % 7 <> 0 THEN CASE WHEN v >= greatest(60, scale * 120) THEN 1.0 ELSE 0.0 END END), 6)::DOUBLE AS false_rate FROM {SERIES}, (SELECT unnest([1.0, 0.9, 0.8, 0.7, 0.6])::DOUBLE AS scale) GROUP BY scale""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).withColumn("p", F.col("u") % 7 == 0)
    return R.sweep(rows, [1.0, 0.9, 0.8, 0.7, 0.6], 120.0, 60.0, "v", "p").select("scale", F.round("recall", 6).alias("recall"), F.round("false_rate", 6).alias("false_rate"))


@query(f"""SELECT u, max(CASE WHEN ok = 1 THEN i END) AS lead FROM (SELECT u, i, min(CASE WHEN v > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY i) AS ok FROM {SERIES}) GROUP BY u""")
def alarm_lead_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).withColumn("hit", F.col("v") > 30)
    return R.lead_scan(rows, ["u"], "i", "hit")


def _persisted(k: int) -> str:
    return f"SELECT feature, {k} AS k, unit, kind, CASE WHEN count(*) < {k} THEN max(value) ELSE max(low) END AS s FROM (SELECT *, CASE WHEN count(value) OVER w = {k} THEN min(value) OVER w END AS low FROM {_F} WINDOW w AS (PARTITION BY feature, unit ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)) GROUP BY ALL"


@query(f"""WITH s AS ({" UNION ALL ".join(_persisted(k) for k in (1, 2, 3))}), r AS (SELECT feature, k, kind, rank() OVER (PARTITION BY feature, k ORDER BY s) + (count(*) OVER (PARTITION BY feature, k, s) - 1) / 2.0::DOUBLE AS r FROM s WHERE s IS NOT NULL)
SELECT feature, k, round((sum(CASE WHEN kind = 'A' THEN r END) - count(*) FILTER (kind = 'A') * (count(*) FILTER (kind = 'A') + 1) / 2.0::DOUBLE) / (count(*) FILTER (kind = 'A') * count(*) FILTER (kind = 'B')), 9) AS auc FROM r GROUP BY 1, 2""")
def operating_auc_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each feature tells accidents from background when it must persist for k epochs."""
    features = _features(spark, sf_dir)
    found = None
    for k in (1, 2, 3):
        one = runs.persist_max(features, ["feature", "unit", "kind"], "i", "value", k).withColumn("k", F.lit(k))
        found = one if found is None else found.unionByName(one)
    scored = found.filter(F.col("persist").isNotNull()).withColumn("p", F.col("kind") == "A")
    return stats.auc(scored, ["feature", "k"], "persist", "p").select("feature", "k", F.round("auc", 9).alias("auc"))


@query(f"""WITH f AS ({_fires(_MENU_SQL)}), s AS (SELECT unit % 3 AS region, rule, avg(CASE WHEN kind = 'A' THEN CASE WHEN fire <= t_acc THEN 1.0 ELSE 0.0 END END)::DOUBLE AS det, median(CASE WHEN kind = 'A' AND fire <= t_acc THEN t_acc - fire END) AS med, coalesce(avg(CASE WHEN kind = 'B' THEN CASE WHEN fire IS NOT NULL THEN 1.0 ELSE 0.0 END END)::DOUBLE, 0) AS bg FROM f GROUP BY 1, 2),
k AS (SELECT *, coalesce(med / 180, 99) + bg * 100 / 30 + (1 - det) * 10 AS score FROM s WHERE det IS NOT NULL)
SELECT region, rule, round(det, 6) AS det, round(bg, 6) AS bg, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round(det, 9) DESC, round(score, 9), rule) AS k FROM k) WHERE k = 1""")
def region_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each region the rule that detects most, and of those the one at the knee of lead and background."""
    fired = R.fires(_features(spark, sf_dir), _menu(spark)).withColumn("region", F.col("unit") % 3)
    return R.best_by(fired, "region").select("region", "rule", *[F.round(c, 6).alias(c) for c in ("det", "bg", "score")])


_COMBINED = f"(SELECT a.feature AS a, b.feature AS b, c.comb, a.unit, a.kind, a.i, CASE c.comb WHEN 'min' THEN least(a.value, b.value) WHEN 'max' THEN greatest(a.value, b.value) ELSE (a.value + b.value) / 2 END AS value FROM {_F} a JOIN {_F} b ON a.unit = b.unit AND a.i = b.i AND a.feature < b.feature, (SELECT unnest(['min', 'mean', 'max']) AS comb) c)"


def _pair_persisted(k: int) -> str:
    return f"SELECT a, b, comb, {k} AS k, unit, kind, CASE WHEN count(*) < {k} THEN max(value) ELSE max(low) END AS s FROM (SELECT *, CASE WHEN count(value) OVER w = {k} THEN min(value) OVER w END AS low FROM c WINDOW w AS (PARTITION BY a, b, comb, unit ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)) GROUP BY ALL"


@query(f"""WITH c AS MATERIALIZED (SELECT * FROM {_COMBINED}), s AS ({" UNION ALL ".join(_pair_persisted(k) for k in (1, 2, 3))}), r AS (SELECT a, b, comb, k, kind, rank() OVER (PARTITION BY a, b, comb, k ORDER BY s) + (count(*) OVER (PARTITION BY a, b, comb, k, s) - 1) / 2.0::DOUBLE AS r FROM s WHERE s IS NOT NULL)
SELECT a, b, comb, k, round((sum(CASE WHEN kind = 'A' THEN r END) - count(*) FILTER (kind = 'A') * (count(*) FILTER (kind = 'A') + 1) / 2.0::DOUBLE) / (count(*) FILTER (kind = 'A') * count(*) FILTER (kind = 'B')), 9) AS auc FROM r GROUP BY 1, 2, 3, 4""")
def operating_auc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well two features together, by the smaller, the mean or the larger, tell accidents from background when they must persist for k epochs."""
    both, found = R.combined(_features(spark, sf_dir)), None
    for k in (1, 2, 3):
        one = runs.persist_max(both, ["a", "b", "comb", "unit", "kind"], "i", "value", k).withColumn("k", F.lit(k))
        found = one if found is None else found.unionByName(one)
    scored = found.filter(F.col("persist").isNotNull()).withColumn("p", F.col("kind") == "A")
    return stats.auc(scored, ["a", "b", "comb", "k"], "persist", "p").select("a", "b", "comb", "k", F.round("auc", 9).alias("auc"))


@query()
def first_fire_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each accident the conditions that fire at its last epoch and never before."""
    features = _features(spark, sf_dir).filter("kind = 'A'")
    return R.first_fire_rules(features, features.groupBy("unit").agg(F.max("i").alias("i")))


@query(f"""WITH c AS (SELECT DISTINCT u FROM {SERIES} WHERE u % 7 <> 0 ORDER BY md5('3:' || u::VARCHAR), u LIMIT 40) SELECT CASE WHEN u % 7 = 0 THEN 'event' ELSE 'control' END AS arm, count(*) AS n, round(median(m), 6) AS mid, round(quantile_cont(m, 0.9), 6) AS p90 FROM (SELECT u, max(v) AS m FROM {SERIES} WHERE u % 7 = 0 OR u IN (SELECT u FROM c) GROUP BY u) GROUP BY 1""")
def control_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty seeded control series beside the events: the sample is the feature."""
    rows = series(spark, sf_dir)
    chosen = rows.filter("u % 7 <> 0").select("u").distinct().orderBy(F.md5(F.concat(F.lit("3:"), F.col("u").cast("string")).cast("binary")), "u").limit(40)
    both = rows.filter("u % 7 = 0").unionByName(rows.join(chosen, "u", "left_semi").select(*rows.columns))
    units = both.groupBy("u").agg(F.max("v").alias("m")).withColumn("arm", F.when(F.col("u") % 7 == 0, F.lit("event")).otherwise(F.lit("control")))
    return units.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("m"), 6).alias("mid"), F.round(F.percentile("m", 0.9), 6).alias("p90"))


@query(f"""WITH f AS MATERIALIZED (SELECT * FROM {_fires(_SINGLE_SQL)}), b AS (SELECT rule, avg(CASE WHEN fire IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS bg FROM f WHERE kind = 'B' GROUP BY rule),
a AS MATERIALIZED (SELECT rule, unit, fire, CASE WHEN fire <= t_acc THEN t_acc - fire END AS lead FROM f WHERE kind = 'A'),
s AS (SELECT x.unit, x.rule, x.fire, x.lead, count(o.lead)::DOUBLE / count(*) AS det, coalesce(median(o.lead) / 365.25, 99) + 2 * any_value(b.bg) AS j FROM a x JOIN a o ON o.rule = x.rule AND o.unit <> x.unit JOIN b ON b.rule = x.rule GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round(j, 9), rule) AS k FROM s WHERE det >= 0.7)
SELECT u.unit, k.rule IS NOT NULL AS chosen, round(k.fire, 6) AS fire, round(k.lead, 6) AS lead FROM (SELECT DISTINCT unit FROM a) u LEFT JOIN k ON k.unit = u.unit AND k.k = 1""")
def loao_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each accident the rule found without it, and its lead there."""
    features = _features(spark, sf_dir)
    shares = spark.createDataFrame([(q, int(round(100 * q))) for q in _SHARES], "share double, q int")
    cuts = features.filter("kind = 'B'").groupBy("feature").agg(F.percentile("value", F.array(*[F.lit(x) for x in _SHARES])).alias("c")).select("feature", F.posexplode("c").alias("p", "threshold"))
    named = cuts.join(shares.withColumn("p", F.array_position(F.array(*[F.lit(x) for x in _SHARES]), F.col("share")).cast("int") - 1), "p")
    rules = named.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(F.concat_ws("|", "feature", F.col("q").cast("string"), F.col("k").cast("string")).alias("rule"), "k", "feature", "threshold")
    out = R.leave_one_out_rules(R.fires(features, rules), 0.7)
    return out.select("unit", F.col("rule").isNotNull().alias("chosen"), F.round("fire", 6).alias("fire"), F.round("lead", 6).alias("lead"))
