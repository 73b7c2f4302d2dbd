"""What the training-data operators share: tables, checkpoints, word patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space as the contracts define it; everything else is part of a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode (tests) where it is unset."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="orbweave-"))
    return context.getCheckpointDir()


def mounted(spark: SparkSession, folder: str | None, name: str) -> str:
    """A new folder for files that tasks write by themselves, in folder or the shared one: a path that every executor mounts."""
    folder = folder or shared_dir(spark)
    scheme, _, rest = folder.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"{folder} can't be written or memory-mapped as files: name a folder that all executors mount")
    return f"{'/' + rest.lstrip('/') if scheme else folder}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder: later steps survive lost executors and don't repeat it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As settled, but as a Parquet table. A checkpoint hands on what the optimizer knows of its rows, which grows with every round of an iteration; a table begins anew."""
    folder = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task, which gives freed memory back to the system when it ends: workers live on, idle or serving other operators."""

    def run(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return run


_remembered: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """What a worker keeps for later tasks of one operator. Workers serve all operators in turn, so a task of another one drops it first."""
    for other in [x for x in _remembered if x != owner]:
        del _remembered[other]
    return _remembered.setdefault(owner, {})


def word_count(text: str | Column) -> Column:
    """Words of a text as a long; null text has none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def crc_mod(doc_id: str | Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
