"""Rows computed once between the rounds of an iteration, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode (tests) a temporary folder where it is unset, on a cluster that is an error."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="orbweave-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read again: rounds don't pile up lineage, nor what the optimizer knows of their rows, and lost executors don't repeat them."""
    folder = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
