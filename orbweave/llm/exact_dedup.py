"""Exact deduplication: group by a 128-bit content hash, keep the smallest id, compare texts inside groups.

Null texts count as empty. Runs of ASCII white space compare as one space. The grouping key is
the hash together with the text itself, so equality of bytes decides, and copies collapse before the shuffle: a group
that holds a third of all rows sends one row from each task. Rows then find their group by the hash alone, except for
hashes that more than one text shares; those rows are matched on the text as well.

Repeated rows of one doc_id and text are the same document: each gets the same result row. Null ids are never the
smallest unless a group has no other; then keep_id is null and those rows stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACE, settled, table


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _classes(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("h", "n").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_classes(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: doc_id, h, keep_id, group_size, kept, text_sha256.

    hashed: the 128-bit hash of a normalised text; a weaker one only makes more rows take the path that compares texts.
    """
    keyed = docs.select("doc_id", normalised(F.col("text")).alias("n")).select("doc_id", hashed(F.col("n")).alias("h"), "n")
    classes = settled(_classes(keyed).select("h", "keep_id", "group_size", F.sha2(F.col("n").cast("binary"), 256).alias("text_sha256")))
    shared = classes.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("h")
    rows = keyed.select("doc_id", "h")
    if shared.isEmpty():
        found = rows.join(classes, "h")
    else:
        shared = settled(shared)
        mixed = keyed.join(shared, "h", "left_semi")
        by_text = _classes(mixed).withColumn("text_sha256", F.sha2(F.col("n").cast("binary"), 256))
        exact = mixed.join(by_text, ["h", "n"]).drop("n")
        found = rows.join(shared, "h", "left_anti").join(classes, "h").unionByName(exact)
    return found.select("doc_id", "h", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of docs that stay, all their columns; of repeated rows of one id and text, the one of the smallest hash of all its columns."""
    rows = settled(exact_classes(docs, hashed).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")))
    keep = rows.distinct()
    marked = docs.select(F.col("doc_id").alias("_doc"), F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("_own"), F.struct("*").alias("_row"))
    joined = marked.join(keep, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")), "left_semi")
    if rows.count() > keep.count():  # one more shuffle, only where rows are repeated
        joined = joined.groupBy("_doc", "_own").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return joined.select("_row.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents")).drop("h")


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
