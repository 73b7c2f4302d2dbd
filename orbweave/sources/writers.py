"""Writers; numbers are formatted and rows shaped by expressions before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """UTF-8 with header, doubles with a fixed number of digits."""
    fixed = {c: F.format_string(f"%.{digits}f", c) for c, kind in df.dtypes if kind in ("double", "float")}
    df.withColumns(fixed).write.option("header", True).csv(path)


def features(df: DataFrame, x: str, y: str, props: Sequence[str]) -> DataFrame:
    """One GeoJSON feature per row, as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*props).alias("properties"))).alias("feature"))


def geojson_lines(df: DataFrame, path: str, x: str, y: str, props: Sequence[str]) -> None:
    features(df, x, y, props).write.text(path)


def summary(df: DataFrame, path: str) -> None:
    df.write.json(path)


def inherited(new: DataFrame, old: DataFrame, version: str) -> DataFrame:
    """Layers (layer, version, payload) of a new run, and those of the old run that the new one lacks, if their version is the given one."""
    a, b = new.select("layer", F.col("payload").alias("_new")), old.filter(F.col("version") == version).select("layer", F.col("payload").alias("_old"))
    both = a.join(b, "layer", "full")
    return both.select("layer", F.coalesce("_new", "_old").alias("payload"), F.col("_new").isNull().alias("inherited"))


