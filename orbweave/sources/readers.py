"""Readers of the formats that the operators' inputs come in; schemas are given, never inferred from the data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Encodings that Spark reads without further settings.
PLAIN = ("utf-8", "utf-16", "us-ascii", "iso-8859-1")


def csv(spark: SparkSession, path: str, schema: str, encoding: str = "utf-8", line_sep: str | None = None, header: bool = True) -> DataFrame:
    """Delimited text with a header, in any encoding of the JVM; all columns of the schema by name, unparsable values null."""
    if encoding.lower() not in PLAIN:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.schema(schema).option("header", header).option("encoding", encoding).option("enforceSchema", False).option("mode", "PERMISSIVE")
    return (reader.option("lineSep", line_sep) if line_sep else reader).csv(path)


def encoding_of(spark: SparkSession, path: str, candidates: Sequence[str] = ("utf-8", "cp949", "euc-kr"), look: int = 65_536) -> str:
    """The first encoding that decodes the first bytes of the first file; a character cut off at the end is forgiven."""
    import codecs

    row = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, look).alias("b")).first()
    for name in candidates:
        try:
            codecs.getincrementaldecoder(name)().decode(bytes(row["b"]) if row else b"")
            return name
        except UnicodeDecodeError:
            continue
    raise ValueError(f"none of {', '.join(candidates)} decodes {path}")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of FeatureCollections: kind, coordinates (JSON), props (map of JSON strings)."""
    kind = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path)
    return rows.select(F.inline("features")).select(F.col("geometry.type").alias("kind"), F.col("geometry.coordinates").alias("coordinates"), F.col("properties").alias("props"))


def ring_of(coordinates: Column) -> Column:
    """The outer ring of a polygon's coordinates (JSON), open, as array<struct<x, y>>."""
    points = F.transform(F.from_json(coordinates, "array<array<array<double>>>")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return F.slice(points, F.lit(1), F.size(points) - 1)


def ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells (file, r, c, v) of Esri ASCII grids; the nodata value is null. A file must fit a task."""

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, text in zip(frame["path"], frame["value"], strict=True):
                head, rows = {}, []
                for line in text.splitlines():
                    words = line.split()
                    if len(words) == 2 and words[0][0].isalpha():
                        head[words[0].lower()] = float(words[1])
                    elif words:
                        rows.append([float(w) for w in words])
                for r, row in enumerate(rows):
                    v = pd.Series(row)
                    yield pd.DataFrame({"file": name, "r": r, "c": range(len(row)), "v": v.where(v != head.get("nodata_value", -9999.0))})

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(cells, "file string, r long, c long, v double")


def decoded(c: Column, scale: float, offset: float, fill: float) -> Column:
    """Packed values to numbers; the fill value is null."""
    return F.when(c != fill, c * scale + offset)


def best_per(rows: DataFrame, by: Sequence[str], score: Column, tie: str) -> DataFrame:
    """The row of the highest score of each group, ties by the smallest `tie`."""
    w = Window.partitionBy(*by).orderBy(score.desc(), tie)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def key_values(lines: DataFrame, line: str, fields: dict[str, str]) -> DataFrame:
    """Fields of text lines by patterns with one group; null where a line lacks one."""
    return lines.select(*[c for c in lines.columns if c != line], *[F.nullif(F.regexp_extract(line, p, 1), F.lit("")).alias(k) for k, p in fields.items()])


def error_message(c: Column) -> Column:
    """The message of a service's XML error in place of JSON; null for JSON."""
    return F.when(F.ltrim(c).startswith("<"), F.nullif(F.regexp_extract(c, r"<(?:returnAuthMsg|errMsg|message)>([^<]*)<", 1), F.lit("")))
