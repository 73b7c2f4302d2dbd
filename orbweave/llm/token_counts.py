"""Exact token counts: a histogram of encoded lengths whose suffix sums answer every context limit.

The result has a row for each encoded length L that occurs: the documents of that length, those at least and at most
as long, their tokens, and truncated_tokens: what is left of the corpus if every document is cut after L tokens. Between two
lengths that occur, truncated totals are linear, so the rows answer every limit (truncated_total), every quantile (quantile)
and every total exactly. Null and empty texts have length 0; an empty table gives no rows; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import lean, settled, table
from .tokens import default_path, id_batches

#: Lengths of one range; ranges are summed among each other, in one task (as many rows as the longest text has thousands of tokens), and lengths within their range.
RANGE = 1024


def encoded_lengths(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens and how many documents have it, summed over each task's batches."""
    import pyarrow as pa

    def count(batches: Iterator) -> Iterator:
        sums: dict[int, int] = {}
        for _, ids in id_batches(batches, path):
            for x in ids:
                sums[len(x) // 4] = sums.get(len(x) // 4, 0) + 1
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["n_tokens", "docs"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(count), "n_tokens long, docs long")


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    path = path or default_path()
    counts = settled(encoded_lengths(docs, path).groupBy("n_tokens").agg(F.sum("docs").alias("docs")))
    cells = counts.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("r", F.expr(f"n_tokens div {RANGE}"))
    below = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = cells.groupBy("r").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).select(
        "r", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_below") for c in "dt"], *[F.sum(c).over(every).alias(f"{c}_all") for c in "dt"]
    )
    own = Window.partitionBy("r").orderBy("n_tokens")
    sums = cells.join(ranges, "r").select(
        "n_tokens", "docs", "tokens", "d_all", "t_all",
        (F.col("d_below") + F.sum("docs").over(own)).alias("docs_at_most"), (F.col("t_below") + F.sum("tokens").over(own)).alias("tokens_at_most"),
    )
    longer = F.col("d_all") - F.col("docs_at_most")
    return sums.select(
        "n_tokens", "docs", "tokens", "docs_at_most", "tokens_at_most",
        (longer + F.col("docs")).alias("docs_at_least"), (F.col("t_all") - F.col("tokens_at_most") + F.col("tokens")).alias("tokens_at_least"),
        (F.col("tokens_at_most") + F.col("n_tokens") * longer).alias("truncated_tokens"),
        (F.col("docs_at_most") / F.col("d_all")).alias("share_at_most"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut after limit tokens."""
    row = histogram.agg(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("docs"))).first()
    return int(row[0] or 0)


def quantile(histogram: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of the documents doesn't exceed."""
    return histogram.filter(F.col("share_at_most") >= share).agg(F.min("n_tokens")).first()[0]


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(table(spark, sf_dir, "documents"))


