"""Queries of readers and writers; files they need are written to the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query, table
from ..functions import scalar as S
from ..operators.lineage import shared_folder
from ..sources import readers, writers


@query("""SELECT day, event_id FROM (SELECT ts::DATE AS day, event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END DESC, event_id) AS k FROM events) WHERE k = 1""")
def best_file_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the files of a day, the one of the best kind."""
    score = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", "event_type")
    return readers.best_per(rows, ["day"], score, "event_id").select("day", "event_id")


@query("""SELECT p_partkey, CASE WHEN p_size <> 7 THEN round(p_size * 0.01 - 3, 6) END AS v FROM part""")
def scaled_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed values with scale, offset and fill."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(readers.decoded(F.col("p_size"), 0.01, -3.0, 7), 6).alias("v"))


@query("""SELECT layer, payload, inherited FROM (SELECT coalesce(a.k, b.k) AS layer, coalesce(a.p, b.p) AS payload, a.p IS NULL AS inherited FROM (SELECT n_name AS k, n_regionkey::VARCHAR AS p FROM nation WHERE n_nationkey % 2 = 0) a FULL JOIN (SELECT n_name AS k, n_nationkey::VARCHAR AS p FROM nation WHERE n_nationkey % 3 = 0 AND n_regionkey <> 2) b ON a.k = b.k)""")
def layer_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers that a run didn't make come from the previous one, if of the same version."""
    nations = table(spark, sf_dir, "nation")
    new = nations.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("layer"), F.lit("2").alias("version"), F.col("n_regionkey").cast("string").alias("payload"))
    old = nations.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("layer"), F.when(F.col("n_regionkey") != 2, F.lit("2")).otherwise(F.lit("1")).alias("version"), F.col("n_nationkey").cast("string").alias("payload"))
    return writers.inherited(new, old, "2")


@query("""SELECT s_suppkey, s_suppkey * 37 % 1000 / 10.0::DOUBLE AS x, s_nationkey::VARCHAR AS nation FROM supplier""")
def geojson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to features and back."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 1000 / F.lit(10.0)).alias("x"), (F.col("s_suppkey") * 91 % 1000 / F.lit(10.0)).alias("y"), F.col("s_nationkey").alias("nation"))
    back = F.from_json("feature", "geometry struct<type:string,coordinates:array<double>>, properties map<string,string>")
    out = writers.features(rows, "x", "y", ["s_suppkey", "nation"]).select(back.alias("f"))
    return out.select(F.col("f.properties")["s_suppkey"].cast("long").alias("s_suppkey"), F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.properties")["nation"].alias("nation"))


@query("""SELECT o_orderkey, o_orderstatus AS status, round(o_totalprice, 1)::DOUBLE AS price, NULL::VARCHAR AS site FROM orders""")
def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields out of header lines."""
    line = F.concat(F.lit("# status="), "o_orderstatus", F.lit("; price: "), F.round("o_totalprice", 1).cast("decimal(20,1)").cast("string"))
    found = readers.key_values(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")), "line", {"status": r"status=(\w+)", "price": r"price: ([0-9.]+)", "site": r"site: (\w+)"})
    return found.withColumn("price", F.col("price").cast("double"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'LIMIT ' || page_id END AS error FROM pages""")
def service_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XML error where JSON was expected."""
    body = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("<OpenAPI><errMsg>LIMIT "), F.col("page_id").cast("string"), F.lit("</errMsg></OpenAPI>"))).otherwise(F.lit('{"items": []}'))
    return table(spark, sf_dir, "pages").select("page_id", readers.error_message(body).alias("error"))


@query("""SELECT c_custkey::VARCHAR AS code, c_name AS name, NULL::VARCHAR AS depth FROM customer""")
def alias_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical names from whichever of several columns a table has."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("시추공코드"), F.col("c_name").alias("프로젝트명"))
    return S.alias_select(rows, {"code": ("공번", "시추공코드"), "name": ("프로젝트명",), "depth": ("심도",)})


@query("""SELECT url, page_id FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS url, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1) ORDER BY page_id) AS k FROM pages) WHERE k = 1""")
def distinct_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("url"))
    return readers.best_per(rows, ["url"], F.lit(0), "page_id").select("url", "page_id")


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV with two digits and read again by its schema."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    writers.csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path, 2)
    return readers.csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def summary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary written as lines of JSON and read again."""
    path = f"{shared_folder(spark)}/summary-{uuid.uuid4().hex}"
    writers.summary(table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")), path)
    return spark.read.schema("segment string, n long, total double").json(path)
