"""From raw documents to packed sequences: language, exact copies, near copies, mixture, packing.

Each stage works on all that the one before kept, written as Parquet in the folder that driver and executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orbweave.llm.common import shared_dir, table
from orbweave.llm.exact_dedup import drop_exact_copies
from orbweave.llm.language import keep_identified
from orbweave.llm.mixing import mixed
from orbweave.llm.packing import pack
from orbweave.llm.simhash import drop_near_copies

#: Words that a worker remembers while it packs.
WORDS = 200_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the network finds no language (no letters, or none that has half of the probability) go."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of one text, the one of the smallest id stays."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash over five words, similarity 0.8 confirmed), the document of the smallest id stays."""
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them; the one that a source's target cuts comes with its first words, joined by single spaces."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence. Workers remember fewer words than by themselves: their executors still hold the memory of the stages before."""
    return pack(docs, ids=False, words=WORDS)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("packing", packing)]

#: The network, the fingerprints' hash and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
