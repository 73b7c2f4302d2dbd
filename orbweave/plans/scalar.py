"""Projections, predicates, text, dates, geometry and grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..catalog import query, table
from ..functions import grades as G, scalar as S


@query("""SELECT (DATE '2024-01-01' + to_months(k::INT))::DATE AS month, extract(day FROM last_day((DATE '2024-01-01' + to_months(k::INT))::DATE))::INT AS days FROM range(0, 36) r(k)""")
def calendar_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2026-12-01").cast("date"), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(span).alias("month")).select("month", F.dayofmonth(F.last_day("month")).alias("days"))


@query("""
SELECT event_id, 'S' || (user_id % 3 + 1) AS satellite, upper(left(event_type, 2)) AS mode, strftime(ts, '%Y%m%d') AS day,
       strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time, round((epoch_us(ts) - 1705276800000000) / 3600e6, 6) AS hours_from_event FROM events""")
def catalog_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene names to satellite, mode, day, local time and hours from an event."""
    name = F.concat_ws("_", F.concat(F.lit("S"), F.col("user_id") % 3 + 1), F.upper(F.substring("event_type", 1, 2)), F.date_format("ts", "yyyyMMdd"))
    parts = F.split("scene", "_")
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", "ts", name.alias("scene")).select(
        "event_id", parts[0].alias("satellite"), parts[1].alias("mode"), parts[2].alias("day"),
        F.date_format(F.from_utc_timestamp(at, "Asia/Tokyo"), "yyyy-MM-dd HH:mm:ss").alias("local_time"),
        F.round((F.unix_micros(at) - 1_705_276_800_000_000) / 3600e6, 6).alias("hours_from_event"),
    )


@query("""SELECT event_id, value FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'""")
def asof_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id", "value")


@query("""SELECT c_custkey, c_custkey * 37 % 1000 AS x, c_custkey * 91 % 1000 AS y FROM customer WHERE c_custkey * 37 % 1000 BETWEEN 100 AND 400 AND c_custkey * 91 % 1000 BETWEEN 200 AND 700""")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("c_custkey") * 37 % 1000, F.col("c_custkey") * 91 % 1000
    return table(spark, sf_dir, "customer").select("c_custkey", x.alias("x"), y.alias("y")).filter(F.col("x").between(100, 400) & F.col("y").between(200, 700))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 0 AND l_discount > 0 THEN round(least(l_quantity * 30 / (l_discount * 1000), 50), 6) END AS blows FROM lineitem""")
def spt_ratio_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.capped_ratio(F.col("l_quantity"), F.col("l_discount") * 1000, 30, 50)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(n, 6).alias("blows"))


@query("""SELECT p_partkey, CASE WHEN contains(p_type, 'BRASS') OR contains(p_type, 'TIN') THEN 'soft' WHEN contains(p_type, 'COPPER') OR contains(p_type, 'NICKEL') THEN 'watch' WHEN contains(p_type, 'STEEL') THEN 'good' ELSE 'unclassified' END AS class, contains(p_type, 'POLISHED') AS flag FROM part""")
def keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = (("soft", ("BRASS", "TIN")), ("watch", ("COPPER", "NICKEL")), ("good", ("STEEL",)))
    return table(spark, sf_dir, "part").select("p_partkey", S.keyword_class(F.col("p_type"), classes, "unclassified").alias("class"), F.contains("p_type", F.lit("POLISHED")).alias("flag"))


@query("""SELECT event_id, CASE WHEN v BETWEEN 0 AND 100 THEN v WHEN v >= -20 AND v < 0 THEN 0 WHEN v > 100 AND v <= 120 THEN 100 END AS clipped, CASE WHEN v BETWEEN 0 AND 100 THEN v END AS inside FROM (SELECT event_id, round(value - 50, 6) AS v FROM events)""")
def soft_clip_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") - 50, 6).alias("v"))
    return rows.select("event_id", S.soft_clip(F.col("v"), 0.0, 100.0, 20.0).alias("clipped"), S.in_domain(F.col("v"), 0, 100).alias("inside"))


@query("""SELECT source, count(*) AS n, avg(CASE WHEN coalesce(trim(CASE WHEN doc_id % 7 = 0 THEN '  ' WHEN doc_id % 5 = 0 THEN NULL ELSE lang END), '') = '' THEN 1.0 ELSE 0.0 END) AS missing FROM documents GROUP BY source""")
def blank_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.when(F.col("doc_id") % 7 == 0, F.lit("  ")).when(F.col("doc_id") % 5 != 0, F.col("lang"))
    return table(spark, sf_dir, "documents").select("source", lang.alias("lang")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(S.blank(F.col("lang")).cast("double")).alias("missing"))


@query("""SELECT event_id, CASE WHEN value < 1 THEN NULL ELSE value END AS v, CASE WHEN coalesce(CASE WHEN value < 1 THEN NULL ELSE value END, 0) < 10 THEN true ELSE false END AS open FROM events""")
def null_as_zero_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.nan_to_null(F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("value")))
    return table(spark, sf_dir, "events").select("event_id", v.alias("v"), (F.coalesce(v, F.lit(0.0)) < 10).alias("open"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders""")
def sentinel_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("o_custkey") % 10 == 0, F.lit(-9999.0)).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.sentinel_to_null(raw, -9999.0).alias("price"))


@query("""SELECT c_custkey, (c_custkey % 97)::VARCHAR || '-' || CASE WHEN c_custkey % 3 = 0 THEN '0' ELSE (c_custkey % 11)::VARCHAR END AS lot FROM customer""")
def parse_jibun(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    address = F.concat(F.lit("서울 역삼동 "), (k % 97).cast("string"), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), (k % 11).cast("string"))), F.lit("번지"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.lot_number(address).alias("lot"))


@query("""SELECT p_partkey, regexp_replace(p_name, '\\s+', '', 'g') AS norm, p_brand AS stripped FROM part""".replace("\\\\", "\\"))
def suffix_strip_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat("p_brand", F.lit(" 외 "), F.col("p_size").cast("string"), F.lit(" 종"))
    return table(spark, sf_dir, "part").select("p_partkey", S.strip_spaces(F.col("p_name")).alias("norm"), S.strip_others(named).alias("stripped"))


@query("""SELECT regexp_replace(c_name, '[0-9]', '#', 'g') AS pattern, count(*) AS n FROM customer GROUP BY 1""")
def pattern_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(S.digit_pattern(F.col("c_name")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, upper(split_part(p_type, ' ', 1)) AS code FROM part""")
def code_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.code_prefix(F.concat(F.lower(F.regexp_extract("p_type", r"^(\S+)", 1)), F.lit("："), F.col("p_type"))).alias("code"))


@query("""SELECT event_id, props ->> 'k' AS k, json_array_length(json_keys(props)) AS n FROM events""")
def json_attr_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", attrs["k"].alias("k"), F.size(attrs).cast("long").alias("n"))


@query("""SELECT e.event_id, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][((floor((az + 22.5) / 45) % 8) + 1)::INT] AS sector FROM (SELECT event_id, round(value, 2) % 360 AS az FROM events) e""")
def dir8_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.sector(F.round("value", 2) % 360).alias("sector"))


@query("""
SELECT o_orderkey, round(year(d) + (dayofyear(d) - 1) / 365.25, 9) AS y365, round(year(d) + (dayofyear(d) - 1)::DOUBLE / dayofyear(make_date(year(d), 12, 31)), 9) AS yleap
FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def decimal_year_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(S.decimal_year_365(d), 9).alias("y365"), F.round(S.decimal_year_leap(d), 9).alias("yleap"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('hour', ts) WHEN event_id % 3 = 1 THEN date_trunc('day', ts) END AS parsed FROM events""")
def stamp_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyyMMddHH")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyyMMdd")).otherwise(F.lit("n/a"))
    return table(spark, sf_dir, "events").select("event_id", S.parse_stamp(raw).cast("timestamp_ntz").alias("parsed"))


@query("""SELECT c_custkey, round(c_acctbal, 2) AS amount, coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_mktsegment END), ''), c_name) AS name FROM customer""")
def tolerant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of text with units, and the first filled of alternative fields."""
    text = F.concat(F.format_number("c_acctbal", 2), F.lit(" 원"))
    first = F.when(F.col("c_custkey") % 2 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(S.tolerant_number(text), 2).alias("amount"), S.first_filled(first, F.col("c_name")).alias("name"))


@query("""WITH p AS (SELECT s_suppkey, 33 + (s_suppkey * 37 % 1000) / 200.0::DOUBLE AS lat, 125 + (s_suppkey * 91 % 1000) / 200.0::DOUBLE AS lon FROM supplier),
d AS (SELECT s_suppkey, 2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(lat - 37.5) / 2), 2) + cos(radians(37.5)) * cos(radians(lat)) * pow(sin(radians(lon - 127) / 2), 2)))) AS d,
atan2(sin(radians(lon - 127)) * cos(radians(lat)), cos(radians(37.5)) * sin(radians(lat)) - sin(radians(37.5)) * cos(radians(lat)) * cos(radians(lon - 127))) - radians(349.0) AS turn FROM p)
SELECT s_suppkey, round(d * cos(turn), 3) AS along, round(d * sin(turn), 3) AS across FROM d""")
def along_across_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far points lie along and across a satellite's track."""
    k = F.col("s_suppkey")
    lat, lon = 33 + (k * 37 % 1000) / F.lit(200.0), 125 + (k * 91 % 1000) / F.lit(200.0)
    along, across = S.along_across(F.lit(37.5), F.lit(127.0), lat, lon, 349.0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(along, 3).alias("along"), F.round(across, 3).alias("across"))


@query("""
SELECT a.s_suppkey, round(2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(lat - 37.5) / 2), 2) + cos(radians(37.5)) * cos(radians(lat)) * pow(sin(radians(lon - 127) / 2), 2)))), 3) AS metres
FROM (SELECT s_suppkey, 33 + (s_suppkey * 37 % 1000) / 200.0::DOUBLE AS lat, 125 + (s_suppkey * 91 % 1000) / 200.0::DOUBLE AS lon FROM supplier) a""")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    lat, lon = 33 + (k * 37 % 1000) / F.lit(200.0), 125 + (k * 91 % 1000) / F.lit(200.0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(S.haversine_m(F.lit(37.5), F.lit(127.0), lat, lon), 3).alias("metres"))


@query("""
WITH p AS (SELECT s_suppkey, 33 + (s_suppkey * 37 % 1000) / 200.0::DOUBLE + 0.0001 AS lat, 125 + (s_suppkey * 91 % 1000) / 200.0::DOUBLE + 0.0001 AS lon FROM supplier),
t AS (SELECT s_suppkey, floor((lon + 180) / 360 * 4096)::BIGINT AS x, floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 4096)::BIGINT AS y FROM p)
SELECT s_suppkey, x, y, list_aggregate(list_transform(range(11, -1, -1), lambda k: ((x >> k) & 1) + 2 * ((y >> k) & 1)), 'string_agg', '') AS quadkey FROM t""")
def quadkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = S.tile_xy(33 + (k * 37 % 1000) / F.lit(200.0) + 0.0001, 125 + (k * 91 % 1000) / F.lit(200.0) + 0.0001, 12)
    return table(spark, sf_dir, "supplier").select("s_suppkey", x.alias("x"), y.alias("y")).withColumn("quadkey", S.quadkey(F.col("x"), F.col("y"), 12))


@query("""SELECT s_suppkey, ((s_suppkey % 9 + 1) * (s_suppkey % 7 + 2) / 2.0 + (s_suppkey % 9 + 1) * (s_suppkey % 5 + 1))::DOUBLE AS area FROM supplier""")
def polygon_area_shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle with a gable."""
    k = F.col("s_suppkey")
    w, top, h = (k % 9 + 1).cast("double"), (k % 7 + 2).cast("double"), (k % 5 + 1).cast("double")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(at(F.lit(0.0), F.lit(0.0)), at(w, F.lit(0.0)), at(w, h), at(w / 2, h + top), at(F.lit(0.0), h))
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.polygon_area(ring).alias("area"))


@query("""SELECT s_suppkey, round(33 + (s_suppkey * 37 % 1000) / 200.0::DOUBLE, 6) AS lat, round(125 + (s_suppkey * 91 % 1000) / 200.0::DOUBLE, 6) AS lon, round((s_suppkey % 50)::DOUBLE, 2) AS height FROM supplier""")
def ecef_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y, z = S.to_ecef(33 + (k * 37 % 1000) / F.lit(200.0), 125 + (k * 91 % 1000) / F.lit(200.0), (k % 50).cast("double"))
    lat, lon, height = S.to_geodetic(x, y, z)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), F.round(height, 2).alias("height"))


@query("""SELECT s_suppkey, chr(65 + (row_number() OVER (ORDER BY s_suppkey * 91 % 1000 DESC, s_suppkey * 37 % 1000, s_suppkey) - 1)::INT % 26) || '동' AS name FROM supplier WHERE s_nationkey = 1""")
def spatial_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters from north to south, then west to east, within one site."""
    k = F.col("s_suppkey")
    w = Window.partitionBy("s_nationkey").orderBy((k * 91 % 1000).desc(), k * 37 % 1000, k)
    rows = table(spark, sf_dir, "supplier").filter("s_nationkey = 1").withColumn("i", F.row_number().over(w) - 1)
    return rows.select("s_suppkey", S.letter_name(F.col("i") % 26).alias("name"))


_RISK = "SELECT event_id, value / 12 AS v, value / 18 AS c, ([0.6, 0.8, 1.0])[(user_id % 3 + 1)::INT]::DOUBLE AS alpha, event_id % 11 - 5 AS velocity FROM events"
_GRADE_V = "CASE WHEN v >= 10 * alpha THEN 2 WHEN v >= 5 * alpha THEN 1 ELSE 0 END"
_GRADE_C = "CASE WHEN c >= 20 * alpha THEN 2 WHEN c >= 15 * alpha THEN 1 ELSE 0 END"


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    alpha = F.element_at(F.array(F.lit(0.6), F.lit(0.8), F.lit(1.0)), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", (F.col("value") / 12).alias("v"), (F.col("value") / 18).alias("c"), alpha.alias("alpha"), (F.col("event_id") % 11 - 5).alias("velocity"))


@query(f"SELECT event_id, {_GRADE_V} AS grade, CASE WHEN velocity >= 0 THEN 0 ELSE {_GRADE_V} END AS gated FROM ({_RISK})")
def grade_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.velocity_grade(F.col("v"), F.col("alpha"))
    return _risks(spark, sf_dir).select("event_id", g.alias("grade"), G.subsidence_gate(F.col("velocity"), g).alias("gated"))


@query(f"SELECT event_id, {_GRADE_C} AS grade FROM ({_RISK})")
def grade_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risks(spark, sf_dir).select("event_id", G.cumulative_grade(F.col("c"), F.col("alpha")).alias("grade"))


@query(f"""
SELECT event_id, greatest(gv, gc) AS grade, ['정상', '주의', '위험'][greatest(gv, gc) + 1] AS label,
       CASE WHEN greatest(gv, gc) = 0 THEN '-' WHEN gv = gc THEN 'velocity+cumulative' WHEN gv > gc THEN 'velocity' ELSE 'cumulative' END AS basis
FROM (SELECT event_id, {_GRADE_V} AS gv, {_GRADE_C} AS gc FROM ({_RISK}))""")
def combine_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _risks(spark, sf_dir).select("event_id", G.velocity_grade(F.col("v"), F.col("alpha")).alias("gv"), G.cumulative_grade(F.col("c"), F.col("alpha")).alias("gc"))
    grade = G.worst(F.col("gv"), F.col("gc"))
    return rows.select("event_id", grade.alias("grade"), G.label(grade).alias("label"), G.basis((("velocity", F.col("gv")), ("cumulative", F.col("gc")))).alias("basis"))


@query("""
SELECT p_partkey, CASE WHEN d < lim THEN '경고' WHEN d < lim + 1.3 THEN '주의' ELSE '이상없음' END AS level, CASE WHEN d < 3 THEN '경고' WHEN d < 5 THEN '주의' ELSE '이상없음' END AS lot_line
FROM (SELECT p_partkey, round(p_retailprice % 15, 1) AS d, CASE WHEN p_size % 4 <> 0 AND p_size % 5 < 3 THEN 6 ELSE 10 END AS lim FROM part)""")
def separation_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, floors = F.round(F.col("p_retailprice") % 15, 1), F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 5)
    return table(spark, sf_dir, "part").select("p_partkey", G.separation_verdict(d, floors)["level"].alias("level"), G.lot_line_level(d).alias("lot_line"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN '확인 필요' WHEN m - 100 >= 30 AND m >= 110.00000000000001 AND m - 100 >= 85 THEN '경고' WHEN m - 100 >= 30 AND m >= 110.00000000000001 THEN '주의' ELSE '이상없음' END AS level
FROM (SELECT *, round(100 + p_retailprice % 120, 1) AS m FROM part)""")
def ledger_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = F.when(F.col("p_size") % 6 != 0, F.lit(100.0))
    return table(spark, sf_dir, "part").select("p_partkey", G.ledger_level(ledger, F.round(100 + F.col("p_retailprice") % 120, 1)).alias("level"))


@query("""
SELECT p_partkey, level, row_number() OVER (PARTITION BY p_brand ORDER BY CASE level WHEN '경고' THEN 1 WHEN '주의' THEN 2 ELSE 3 END, p_size, d, p_partkey) AS place
FROM (SELECT *, CASE WHEN d < 6 THEN '경고' WHEN d < 15 THEN '주의' ELSE '이상없음' END AS level FROM (SELECT *, round(p_retailprice % 25, 1) AS d FROM part))""")
def yard_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, then class, then distance."""
    rows = table(spark, sf_dir, "part").withColumn("d", F.round(F.col("p_retailprice") % 25, 1)).withColumn("level", G.yard_level(F.col("d")))
    w = Window.partitionBy("p_brand").orderBy(G.level_rank(F.col("level")), "p_size", "d", "p_partkey")
    return rows.select("p_partkey", "level", F.row_number().over(w).alias("place"))


@query("""
SELECT p_brand, level, count(*) AS n, min(min(CASE level WHEN '경고' THEN 1 WHEN '주의' THEN 2 WHEN '이상없음' THEN 3 WHEN '확인 필요' THEN 4 ELSE 5 END)) OVER (PARTITION BY p_brand) AS worst
FROM (SELECT p_brand, CASE WHEN s IS NULL THEN '판정 불가' WHEN s <= 0.10 THEN '경고' WHEN s <= 0.25 THEN '주의' ELSE '이상없음' END AS level FROM (SELECT p_brand, CASE WHEN p_size % 9 <> 0 THEN p_size / 50.0::DOUBLE END AS s FROM part)) GROUP BY p_brand, level""")
def level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = G.share_rank(F.when(F.col("p_size") % 9 != 0, F.col("p_size") / F.lit(50.0)))
    counts = table(spark, sf_dir, "part").select("p_brand", level.alias("level")).groupBy("p_brand", "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("worst", F.min(G.level_rank(F.col("level"))).over(Window.partitionBy("p_brand")))


@query("""
SELECT p_partkey, CASE WHEN r IS NULL THEN '판정 불가' WHEN r > 1 THEN '경고' WHEN r >= 0.8 THEN '주의' ELSE '이상없음' END AS wind
FROM (SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN round(p_retailprice % 100 / 80, 4) END AS r FROM part)""")
def wind_code_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.when(F.col("p_size") % 10 != 0, F.round(F.col("p_retailprice") % 100 / 80, 4))
    return table(spark, sf_dir, "part").select("p_partkey", G.wind_level(ratio).alias("wind"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'no-data' WHEN c_custkey % 7 < 3 THEN 'limit' WHEN c_acctbal > 5000 THEN 'TP' ELSE 'miss' END AS verdict FROM customer""")
def accident_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", G.accident_verdict(k % 4 != 0, k % 7, F.col("c_acctbal") > 5000).alias("verdict"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN pre >= 0.3 THEN CASE WHEN pre - co >= 0.6 THEN 3 WHEN pre - co >= 0.4 THEN 2 WHEN pre - co >= 0.2 THEN 1 ELSE 0 END END AS class
FROM (SELECT *, l_quantity / 50 AS pre, l_discount * 5 AS co FROM lineitem)""")
def coherence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.coherence_class(F.col("l_quantity") / 50, F.col("l_discount") * 5).alias("class"))
