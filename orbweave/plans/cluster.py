"""Queries of clusters, components and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query, table
from ..operators import cluster as C
from .common import GRID, grid, points, points_sql


def _dbscan_sql(squared: int) -> str:
    pairs = f"SELECT a.k AS a, b.k AS b FROM {points_sql('customer', 'c_custkey')} a, {points_sql('customer', 'c_custkey')} b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {squared}"
    core = "(SELECT k FROM core)"
    return f"""WITH RECURSIVE p AS MATERIALIZED ({pairs}), core AS MATERIALIZED (SELECT a AS k FROM p GROUP BY a HAVING count(*) >= 3), e AS MATERIALIZED (SELECT a, b FROM p WHERE a IN {core} AND b IN {core}),
r(k, s) AS (SELECT k, k FROM core UNION SELECT e.b, r.s FROM r JOIN e ON e.a = r.k), l AS (SELECT k, min(s) AS c FROM r GROUP BY k),
z AS (SELECT k, x, y, c_acctbal, coalesce((SELECT c FROM l WHERE l.k = z.k), (SELECT min(c) FROM p JOIN l ON l.k = p.b WHERE p.a = z.k)) AS cluster FROM {points_sql('customer', 'c_custkey')} z)"""


@query(f"{_dbscan_sql(400)} SELECT k, cluster FROM z")
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dbscan(points(spark, sf_dir, "customer", "c_custkey"), "k", 20.0, 3)


@query(f"""{_dbscan_sql(625)}, g AS (SELECT *, CASE WHEN c_acctbal > 8000 THEN 2 WHEN c_acctbal > 3000 THEN 1 ELSE 0 END AS grade FROM z WHERE cluster IS NOT NULL)
SELECT cluster, count(*) AS n, count(*) FILTER (grade = 2) AS n_danger, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, max(grade + CASE WHEN c_acctbal > 9500 THEN 1 ELSE 0 END) AS score,
CASE WHEN max(grade + CASE WHEN c_acctbal > 9500 THEN 1 ELSE 0 END) >= 3 THEN 'red' WHEN max(grade + CASE WHEN c_acctbal > 9500 THEN 1 ELSE 0 END) >= 2 THEN 'orange' ELSE 'yellow' END AS alarm FROM g WHERE grade > 0 GROUP BY cluster HAVING count(*) >= 3""")
def cluster_alarm_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of elevated points and their alarm."""
    rows = points(spark, sf_dir, "customer", "c_custkey", "c_acctbal").withColumn("grade", F.when(F.col("c_acctbal") > 8000, 2).when(F.col("c_acctbal") > 3000, 1).otherwise(0))
    clusters = C.dbscan(rows, "k", 25.0, 3)
    found = C.cluster_summary(rows.join(clusters, "k").withColumn("score", F.col("grade") + F.when(F.col("c_acctbal") > 9500, 1).otherwise(0)), 3)
    return found.withColumns({c: F.round(c, 6) for c in ("cx", "cy")})


@query(f"""WITH RECURSIVE g AS MATERIALIZED (SELECT r, c, r * 64 + c AS id FROM {GRID} WHERE v > 27), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.id <> b.id),
r(k, s) AS (SELECT id, id FROM g UNION SELECT e.b, r.s FROM r JOIN e ON e.a = r.k), l AS (SELECT k, min(s) AS component FROM r GROUP BY k) SELECT r, c, component, size FROM g JOIN l ON l.k = g.id JOIN (SELECT component, count(*) AS size FROM l GROUP BY 1 HAVING count(*) >= 3) USING (component)""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cell_components(grid(spark, sf_dir).filter("v > 27"), 64, True, 3)


@query(f"""WITH RECURSIVE g AS MATERIALIZED (SELECT r, c, r * 64 + c AS id FROM {GRID} WHERE v > 26), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
r(k, s) AS (SELECT id, id FROM g UNION SELECT e.b, r.s FROM r JOIN e ON e.a = r.k), l AS (SELECT k, min(s) AS component FROM r GROUP BY k) SELECT component, count(*) AS size, count(*) * 900.0::DOUBLE AS area FROM l GROUP BY 1""")
def component_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-connected components dissolved to areas of 30 m cells."""
    found = C.cell_components(grid(spark, sf_dir).filter("v > 26"), 64, False)
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("size"), (F.count(F.lit(1)) * 900.0).alias("area"))


@query("""SELECT c_custkey, amount FROM (SELECT c_custkey, amount, row_number() OVER (PARTITION BY c_custkey ORDER BY new DESC, seq DESC) AS k FROM (SELECT c_custkey, c_acctbal AS amount, 0::BIGINT AS seq, 0 AS new FROM customer UNION ALL SELECT o_custkey, o_totalprice, o_orderkey, 1 FROM orders)) WHERE k = 1""")
def keep_last_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("amount"), F.lit(0).cast("long").alias("seq"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("seq"))
    return C.keep_last(old, new, ["c_custkey"]).select("c_custkey", "amount")


@query("""SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 5000 INTERSECT SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < -900""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    rich = suppliers.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return rich.intersect(table(spark, sf_dir, "customer").select("c_nationkey")).exceptAll(suppliers.filter("s_acctbal < -900").select("s_nationkey").distinct())


@query("""SELECT p_brand, arg_max(p_partkey, row(p_retailprice, -p_partkey)) AS dearest, arg_min(p_partkey, row(p_retailprice, p_partkey)) AS cheapest FROM part GROUP BY 1""")
def arg_min_max_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("dearest"), F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest"))
