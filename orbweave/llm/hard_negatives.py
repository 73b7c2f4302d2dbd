"""Hard negatives by a block matrix product in two dimensions of blocks, with the inner dimension dealt out as well (SUMMA).

Rows and anchors are cut into panels of at most ROWS rows and ANCHORS anchors, each panel into chunks of DEPTH components. A task multiplies the
panels of one chunk into a partial tile of int64 scores; partial tiles of one place are shuffled together and added; what is reduced
is the whole tile: first to the best `positives` rows of an anchor's own label, then, their scores known, to the best `negatives` rows of
other labels in the window of each positive. The second product is the only one over all pairs (anchors are the query set); the first one
only joins panels of the same bucket of labels. Tiles travel in the narrowest integers that hold them.

Panels hold labels of one bucket. They are cut from sorted rows as these stream by, so a label that a third of all rows has makes more panels, not larger ones,
and repeated rows likewise. The grid of the product follows the number of panels: panels are sent to the cells of a grid, a few panels on each side of a cell.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; vectors of different length are compared as if zeros followed the
shorter one (an empty one scores zero); repeated rows count as often as they occur, and a repeated anchor gives its rows as often; rows that share an anchor's id
are not its positives; scores that leave 64 bits wrap around; fewer than three in a window give fewer rows, none give none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table, written

#: Rows and anchors of a panel, components of a chunk.
ROWS, ANCHORS, DEPTH = 2048, 256, 32
#: Buckets of labels; rows of a bucket that one task cuts into panels, in panels; panels of a cell's side.
BUCKETS, CUT, SIDE = 64, 8, 4
#: Components of a panel; long vectors make panels of fewer rows.
CELLS = 1 << 22
_PANEL = "panel long, bucket int, only int, k int, width int, cells binary, ids binary, labels binary"
_NARROW = (np.int8, np.int16, np.int32)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them; one byte in front tells which."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next((t for t in _NARROW if np.iinfo(t).min <= low and high <= np.iinfo(t).max), np.int64)
    return bytes([np.dtype(kind).itemsize]) + np.ascontiguousarray(x, dtype=kind).tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    """The same as int64, in rows of `width`."""
    kind = np.dtype(f"<i{raw[0]}")
    return np.frombuffer(raw, dtype=kind, offset=1).reshape(-1, width).astype(np.int64) if width else np.zeros((0, 0), dtype=np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, by floating point where that is exact."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(1, a.shape[1]) < 2.0**53:
        return (x @ y.T).astype(np.int64)
    return a @ b.T


def usable(vectors: DataFrame, moved: Column) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that take part. moved: the label they get."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("int").alias("label"), F.transform(v, lambda x: F.floor(x * 256).cast("long")).alias("v"))


def panels(rows: DataFrame, size: int, depth: int = DEPTH) -> DataFrame:
    """Rows of one bucket of labels, at most `size` to a panel, a row per panel and chunk; ids and labels come with chunk 0. only: the label, if there is one."""
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int"))
    counts = {r["bucket"]: r["count"] for r in keyed.groupBy("bucket").count().collect()}  # at most BUCKETS rows
    cuts = {k: -(-n // (size * CUT)) for k, n in counts.items()}
    if not cuts:
        return rows.sparkSession.createDataFrame([], _PANEL)
    salts = F.create_map(*[F.lit(x) for item in cuts.items() for x in item])
    dealt = keyed.withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.element_at(salts, F.col("bucket"))))
    ordered = dealt.repartition(sum(cuts.values()), "bucket", "salt").sortWithinPartitions("bucket", "salt", "vec_id", "label", "v").select("bucket", "vec_id", "label", "v")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number, bucket, held, longest = TaskContext.get().partitionId() << 32, None, [], 0

        def chunks() -> Iterator[dict]:
            nonlocal number
            ids, labels = np.array([x[0] for x in held], dtype=np.int64), np.array([x[1] for x in held], dtype=np.int32)
            cells = np.zeros((len(held), longest), dtype=np.int64)
            for at, (_, _, v) in enumerate(held):
                cells[at, : len(v)] = v
            for k in range(max(1, -(-longest // depth))):
                part = cells[:, k * depth : (k + 1) * depth]
                if k == 0 or part.any():
                    same = int(labels[0]) if (labels == labels[0]).all() else None
                    yield {"panel": number, "bucket": bucket, "only": same, "k": k, "width": part.shape[1], "cells": packed(part), "ids": ids.tobytes() if k == 0 else None, "labels": labels.tobytes() if k == 0 else None}
            number += 1

        schema = pa.schema([("panel", pa.int64()), ("bucket", pa.int32()), ("only", pa.int32()), ("k", pa.int32()), ("width", pa.int32()), ("cells", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary())])
        for batch in batches:
            for b, vec_id, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False), strict=True):
                if held and (b != bucket or len(held) == size or max(longest, len(v)) * (len(held) + 1) > CELLS):
                    yield pa.RecordBatch.from_pylist(list(chunks()), schema=schema)
                    held, longest = [], 0
                bucket, longest = b, max(longest, len(v))
                held.append((vec_id, label, v))
        if held:
            yield pa.RecordBatch.from_pylist(list(chunks()), schema=schema)

    return written(ordered.mapInArrow(cut, _PANEL))


def tiles(anchors: DataFrame, rows: DataFrame, same: bool, windows: DataFrame | None = None) -> DataFrame:
    """Partial tiles of each pair of panels (of one bucket, or of any that don't hold one and the same label alone) and chunk, on a grid that follows their number."""
    up, across = (max(1, -(-x.filter("k = 0").count() // SIDE)) for x in (anchors, rows))
    cell = lambda n: F.pmod(F.xxhash64("panel"), F.lit(n)).cast("int")
    a = anchors.select(*[F.col(x).alias(f"a_{x}") for x in ("panel", "bucket", "only", "width", "cells", "ids", "labels")], "k", cell(up).alias("_up"))
    r = rows.select("panel", "bucket", "only", "width", "cells", "ids", "labels", "k", cell(across).alias("_across"), F.explode(F.sequence(F.lit(0), F.lit(up - 1))).alias("_up"))
    if windows is not None:
        a = a.join(windows, (F.col("a_panel") == F.col("w_panel")) & (F.col("k") == 0), "left").drop("w_panel")
    else:
        a = a.withColumn("windows", F.lit(None).cast("binary"))
    a = a.withColumn("_across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    keys = ["k", "_up", "_across"]
    if same:
        a, keys = a.withColumnRenamed("a_bucket", "bucket"), [*keys, "bucket"]
    joined = a.join(r, keys)
    if not same:
        joined = joined.filter(~F.coalesce(F.col("a_only") == F.col("only"), F.lit(False)))
    names = ("a_panel", "panel", "k", "a_width", "width", "a_cells", "cells", "a_ids", "a_labels", "ids", "labels", "windows")

    def multiply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                x = {name: batch.column(j)[at].as_py() for j, name in enumerate(names)}
                a, b = unpacked(x["a_cells"], x["a_width"]), unpacked(x["cells"], x["width"])
                common = min(a.shape[1], b.shape[1])
                if common or x["k"] == 0:
                    tile = product(a[:, :common], b[:, :common]) if common else np.zeros((len(x["a_ids"]) // 8, len(x["ids"]) // 8), dtype=np.int64)
                    out = {"a_panel": x["a_panel"], "panel": x["panel"], "k": x["k"], "tile": packed(tile)} | {n: x[n] for n in ("a_ids", "a_labels", "ids", "labels", "windows")}
                    yield pa.RecordBatch.from_arrays([pa.array([out[n]], t) for n, t in kinds], names=[n for n, _ in kinds])

    import pyarrow as pa

    kinds = [("a_panel", pa.int64()), ("panel", pa.int64()), ("k", pa.int32()), ("tile", pa.binary()), *[(n, pa.binary()) for n in ("a_ids", "a_labels", "ids", "labels", "windows")]]
    return joined.select(*names).mapInArrow(multiply, "a_panel long, panel long, k int, tile binary, a_ids binary, a_labels binary, ids binary, labels binary, windows binary")


def added(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes | None]:
    """The sum of one place's partial tiles, with ids and labels of its anchors and rows, and the windows."""
    first = part[part["k"] == 0].iloc[0]
    a_ids, ids = np.frombuffer(first["a_ids"], np.int64), np.frombuffer(first["ids"], np.int64)
    whole = np.zeros((len(a_ids), len(ids)), dtype=np.int64)
    for raw in part["tile"]:
        whole += unpacked(raw, len(ids))
    return whole, a_ids, np.frombuffer(first["a_labels"], np.int32), ids, np.frombuffer(first["labels"], np.int32), first["windows"]


def best(scores: np.ndarray, fine: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the n largest scores of each row among the fine ones, the first columns of equal ones; by row, then score downwards."""
    if fine.shape[1] > n:
        floor = np.iinfo(np.int64).min
        held = np.where(fine, scores, floor)
        fine = fine & (held >= np.partition(held, fine.shape[1] - n, axis=1)[:, fine.shape[1] - n][:, None])
    r, c = np.nonzero(fine)
    s = scores[r, c]
    order = np.lexsort((c, ~s, r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < n
    return r[keep], c[keep]


def _ranked(found: DataFrame, keys: list[str], score: str, tie: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, size: int = ROWS, few: int = ANCHORS, depth: int = DEPTH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows and anchors: vec_id, label, v (from usable()).

    An anchor's positives are its best rows of the same label, negatives the best of other labels with low * positive <= 100 * negative <= high * positive.
    """
    r, a = panels(rows, size, depth), panels(anchors, few, depth)

    def to_positives(part: pd.DataFrame) -> pd.DataFrame:
        s, a_ids, a_labels, ids, labels, _ = added(part)
        q, c = best(s, (a_labels[:, None] == labels[None, :]) & (a_ids[:, None] != ids[None, :]), positives)
        return pd.DataFrame({"a_panel": part["a_panel"].iloc[0], "at": q.astype(np.int32), "anchor_id": a_ids[q], "positive_id": ids[c], "positive_score": s[q, c]})

    found = tiles(a, r, same=True).groupBy("a_panel", "panel").applyInPandas(to_positives, "a_panel long, at int, anchor_id long, positive_id long, positive_score long")
    chosen = written(_ranked(found, ["a_panel", "at"], "positive_score", "positive_id", positives).withColumnRenamed("rank", "nth"))

    # A panel has few anchors with few positives each: its windows are one small binary.
    def window(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "nth"])
        return pd.DataFrame({"w_panel": [part["a_panel"].iloc[0]], "windows": [part[["at", "nth", "positive_score"]].to_numpy(np.int64).tobytes()]})

    windows = chosen.groupBy("a_panel").applyInPandas(window, "w_panel long, windows binary")

    def to_negatives(part: pd.DataFrame) -> pd.DataFrame:
        s, a_ids, a_labels, ids, labels, raw = added(part)
        out = []
        if raw is not None:
            other = a_labels[:, None] != labels[None, :]
            at, nth, score = np.frombuffer(raw, np.int64).reshape(-1, 3).T
            for n in np.unique(nth):
                mine = nth == n
                own = score[mine].tolist()
                least = np.array([-(-low * x // 100) for x in own], dtype=np.int64)
                most = np.array([high * x // 100 for x in own], dtype=np.int64)
                of = s[at[mine]]
                q, c = best(of, other[at[mine]] & (of >= least[:, None]) & (of <= most[:, None]), negatives)
                out.append(pd.DataFrame({"a_panel": part["a_panel"].iloc[0], "at": at[mine][q].astype(np.int32), "nth": np.int32(n), "negative_id": ids[c], "negative_score": of[q, c]}))
        return pd.concat(out) if out else pd.DataFrame({"a_panel": [], "at": [], "nth": [], "negative_id": [], "negative_score": []}).astype({"a_panel": "int64", "at": "int32", "nth": "int32", "negative_id": "int64", "negative_score": "int64"})

    near = tiles(a, r, same=False, windows=windows).groupBy("a_panel", "panel").applyInPandas(to_negatives, "a_panel long, at int, nth int, negative_id long, negative_score long")
    near = _ranked(near, ["a_panel", "at", "nth"], "negative_score", "negative_id", negatives)
    return chosen.join(near, ["a_panel", "at", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = usable(table(spark, sf_dir, "embeddings"), moved)
    return mine(rows, rows.filter(F.col("vec_id") % 50 == 0))


OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM r a JOIN r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""
