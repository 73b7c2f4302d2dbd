"""Mixing sources to target weights by capped water-filling.

Every source has a weight; the sources share the words of the whole corpus by weight, no source more than max_epochs
times its own words. What a capped source leaves is shared again by weight among the rest until no target is above its
cap. A source is then taken in whole repetitions plus a fraction of one: documents in a seeded order of their ids, up to
the word that fills the target, so that the last of them may be taken in part.

Defined results: a null text has size 0; a source of size 0 has target 0; null is a source of its own, last in order;
an empty table gives an empty result; repeated rows are documents of their own. The seeded order is a hash of id and text, so
reruns agree at any partitioning. Rows equal in both are one place of that order, whatever their number; where the target cuts such a
place, its rows are numbered, the first of them are taken whole and one in part. Which of equal rows these are is left open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import WORD, settled, table, word_count

#: Bits of the seeded order that each search for the cut looks at; LEVELS searches leave 2 ** -24 of a source in the cell of the cut.
BITS, LEVELS = 12, 2
#: Sources up to which the table of cuts goes to every task; beyond, rows are shuffled by source and cell.
FEW = 20_000


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """docs with _size (words) and _u (place in the seeded order, 48 bits)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))
    u = F.conv(F.substring(key, 1, 12), 16, 10).cast("long")
    return docs.withColumn("_size", word_count("text")).withColumn("_u", u)


def targets(sizes: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """sizes: source, source_size. Adds target; one row per source, which is all that a single task ever orders."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = settled(ranked.select("source", "source_size", w.alias("w"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap")))
    total, level, before = float(ranked.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        full = F.col("w") * F.lit(level) > F.col("cap")
        row = ranked.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open"), F.count_if(full).alias("n")).first()
        if row["n"] == before or not row["open"]:
            break
        before, level = (row["n"] if level else -1), (total - row["held"]) / row["open"]
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(level)).alias("target"))


def plan(light: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """light: doc_id, source, _size, _u. Per source its size and target, whole repetitions, words of a further one (extra), the place at which these end (at: _u, doc_id, _size) and what is left for that place."""
    sizes = light.groupBy("source").agg(F.sum("_size").alias("source_size"))
    words = F.round("target").cast("long")
    cut = targets(sizes, weights, max_epochs).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long").alias("whole"),
        F.when(F.col("source_size") > 0, words % F.when(F.col("source_size") > 0, F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("extra"),
        F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("before"),
    )
    few = cut.count() <= FEW
    sent = lambda df: F.broadcast(df) if few else df
    for k in range(1, LEVELS + 1):
        cell = F.shiftright(F.col("_u"), 48 - BITS * k)
        rows = light.withColumnRenamed("source", "_source").withColumn("_cell", cell)
        inside = rows.join(sent(cut), F.col("_source").eqNullSafe(F.col("source")) & (F.shiftright(F.col("_cell"), BITS) == F.col("cell")))
        w = Window.partitionBy("source").orderBy("_cell")
        steps = inside.groupBy("source", "source_size", "target", "whole", "extra", "before", "_cell").agg(F.sum("_size").alias("s")).withColumn("upto", F.col("before") + F.sum("s").over(w))
        at = steps.filter("upto >= extra and upto - s < extra").select("source", F.col("_cell").alias("at"), (F.col("upto") - F.col("s")).alias("had"))
        found = cut.join(at.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
        cut = settled(found.select("source", "source_size", "target", "whole", "extra", F.coalesce("at", F.lit(-1).cast("long")).alias("cell"), F.coalesce("had", F.lit(0).cast("long")).alias("before")))
    # Equal rows count as one, so a cell of repeated rows is small as well.
    rows = light.withColumnRenamed("source", "_of").join(sent(cut), F.col("_of").eqNullSafe(F.col("source")) & (F.shiftright(F.col("_u"), 48 - BITS * LEVELS) == F.col("cell")))
    place = F.struct("_u", "doc_id", "_size").alias("at")
    places = rows.groupBy("_of", "extra", "before", place).agg(F.sum("_size").alias("s"))
    upto = F.col("before") + F.sum("s").over(Window.partitionBy("_of").orderBy("at"))
    ends = places.withColumn("upto", upto).filter("upto >= extra and upto - s < extra").select("_of", "at", (F.col("extra") - F.col("upto") + F.col("s")).alias("left"))
    return settled(cut.join(ends, F.col("source").eqNullSafe(F.col("_of")), "left").select("source", "source_size", "target", "whole", "extra", "at", "left"))


def applied(rows: DataFrame, cut: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns keep of rows (with _size, _u, doc_id, source), source_size, target, and what the mix takes of each: _whole repetitions and _more words of a further one."""
    few = cut.count() <= FEW
    sources = cut.select(F.col("source").alias("_source"), "source_size", "target", F.col("whole").alias("_whole"), F.col("extra").alias("_extra"), F.col("at").alias("_at"), F.col("left").alias("_left"))
    out = rows.withColumn("_place", F.struct("_u", "doc_id", "_size")).join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("_source")))
    ends = F.coalesce(F.col("_place") == F.col("_at"), F.lit(False))  # structs: nulls inside are equal
    told = [*keep, "_size", "source_size", "target", "_whole"]
    plain = out.filter(~ends).select(*told, F.when((F.col("_extra") > 0) & (F.col("_place") < F.col("_at")), F.col("_size")).otherwise(F.lit(0)).cast("long").alias("_more"))
    # Rows of the place at which a source ends are numbered: by task, then by row.
    cutting = settled(out.filter(ends).select(*told, "_source", "_left", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_k")))
    counts = cutting.groupBy("_source", "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_source").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_source").alias("_of"), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = cutting.join(starts, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_p") == F.col("_q"))).withColumn("_row_at", F.col("_start") + F.row_number().over(Window.partitionBy("_source", "_p").orderBy("_k")) - 1)
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), F.col("_left") - F.col("_row_at") * F.col("_size")))
    return plain.unionByName(numbered.select(*told, part.alias("_more")))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken, and repetitions (whole ones) and part (words of a further one)."""
    light = settled(sized(docs.select("doc_id", "source", "text"), seed).drop("text"))
    return applied(light, plan(light, weights, max_epochs), ["doc_id"]).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_whole") * F.col("_size") + F.col("_more")).alias("taken"),
        F.col("_whole").alias("repetitions"), F.col("_more").alias("part"),
    )


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """The documents of the mix: each as often as it is taken, a part as its first words joined by spaces. A document of no words comes with each whole repetition of its source. Columns as in docs; n_chars, where there, follows the text."""
    light = settled(sized(docs.select("doc_id", "source", "text"), seed).drop("text"))
    rows = docs.select("doc_id", "source", "text", F.struct("*").alias("_row"))
    marked = applied(sized(rows, seed), plan(light, weights, max_epochs), ["_row"])
    times = F.col("_whole") + F.when((F.col("_more") > 0) & (F.col("_more") >= F.col("_size")), 1).otherwise(0)
    words = F.array_join(F.slice(F.regexp_extract_all("_row.text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("_more").cast("int")), " ")
    part = (F.col("_more") > 0) & (F.col("_more") < F.col("_size"))
    taken = F.concat(F.array_repeat(F.lit(False), times.cast("int")), F.when(part, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    each = marked.select("_row", F.when(part, words).alias("_words"), F.explode(taken).alias("_cut"))
    changed = F.col("_row").withField("text", F.col("_words"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("_words").cast(docs.schema["n_chars"].dataType))
    return each.select(F.when(F.col("_cut"), changed).otherwise(F.col("_row")).alias("_row")).select("_row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS u
  FROM documents
), s AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY source),
r AS (SELECT source, n, 3.0 * n AS cap, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(n) OVER () AS total
  FROM r
), lam AS (SELECT arg_min((total - held) / free, cap / w) FILTER (WHERE (total - held) / free * w <= cap) AS v FROM o),
t AS (SELECT source, n::BIGINT AS source_size, least(cap, w * coalesce(v, 'inf'::DOUBLE)) AS target FROM r, lam),
c AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS repetitions,
         CASE WHEN source_size > 0 THEN round(target)::BIGINT % source_size ELSE 0 END AS extra,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, repetitions::BIGINT AS repetitions,
       greatest(0, least(size, extra - had))::BIGINT AS part,
       (repetitions * size + greatest(0, least(size, extra - had)))::BIGINT AS taken
FROM c
"""
