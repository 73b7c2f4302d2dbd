"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is centred, scaled to length one, rotated by a seeded orthogonal matrix and kept as the signs of its
coordinates, packed to bits, with its distance from the centre and the inner product of the vector with its own code.
From these the inner product of two directions is estimated without bias, with an error that is below
`certainty` * sqrt((1 - c * c) / (c * c)) / sqrt(dimension - 1) with high probability. A search keeps, for each query, the candidates whose smallest possible
distance isn't above the k-th smallest largest-possible or exact distance so far, and measures those exactly.

The index holds every vector. Queries come in blocks of at most BLOCK, the only thing that is broadcast; each task scans its vectors once a block
and returns its k nearest of each query, and a window over the tasks' rows ends the block. A block's neighbours are kept in the shared folder and its
broadcast is given up before the next one is sent, so driver and executors hold one block at a time. Nothing is left out for size.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another than the most common length (the longer of two as common); rows that share an id are never neighbours of each other;
a repeated query row searches once; different vectors of one id search each, so their ids have as many neighbours of each rank;
other ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import settled, shared_dir, table

#: Queries of a block; products of candidates and queries that a task holds at once.
BLOCK, PRODUCTS = 16_384, 1 << 21


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles), of one length."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (common["n"] if common else 0))


def rotation(dimension: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def coded(v: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, distances from the centre, inner products of directions with their codes."""
    apart = v - centre
    norm = np.sqrt((apart * apart).sum(axis=1))
    turned = (apart / np.where(norm > 0, norm, 1)[:, None]) @ turn
    return np.packbits(turned > 0, axis=1), norm, np.abs(turned).sum(axis=1) / np.sqrt(v.shape[1])


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def index(vectors: DataFrame, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """The index over every usable vector (vec_id, v, code, norm, own) and its centre, the mean vector."""
    import pyarrow as pa

    rows = usable(vectors)

    def sums(batches: Iterator) -> Iterator:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                part = _matrix(batch.column(0)).sum(axis=0)
                total, n = part if total is None else total + part, n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total), pa.array([n] * len(total), pa.int64())], ["at", "total", "n"])

    means = rows.select("v").mapInArrow(sums, "at int, total double, n long").groupBy("at").agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("at").collect()
    centre = np.array([r["mean"] for r in means])
    turn = rotation(max(1, len(centre)), seed)

    def code(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                bits, norm, own = coded(_matrix(batch.column(1)), centre, turn)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(norm), pa.array(own)], ["vec_id", "v", "code", "norm", "own"])

    return settled(rows.mapInArrow(code, "vec_id long, v array<double>, code binary, norm double, own double")), centre


class Nearest:
    """The k nearest of each query among the vectors seen so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, certainty: float):
        self.ids, self.queries, self.k, self.certainty = ids, queries, k, certainty
        apart = queries - centre
        self.norm = np.sqrt((apart * apart).sum(axis=1))
        self.turned = ((apart / np.where(self.norm > 0, self.norm, 1)[:, None]) @ turn).astype(np.float32)
        self.score = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, v: np.ndarray, code: np.ndarray, norm: np.ndarray, own: np.ndarray) -> None:
        step = max(self.k, PRODUCTS // len(self.ids))
        for at in range(0, len(ids), step):
            self._see(*[x[at : at + step] for x in (ids, v, code, norm, own)])

    def _see(self, ids: np.ndarray, v: np.ndarray, code: np.ndarray, norm: np.ndarray, own: np.ndarray) -> None:
        d = v.shape[1]
        signs = np.unpackbits(code, axis=1, count=d).astype(np.float32) * 2 - 1
        own = np.maximum(own, 1e-9)
        inner = (self.turned @ signs.T) / np.sqrt(d) / own
        slack = self.certainty * np.sqrt(np.maximum(0, 1 - own * own)) / own / np.sqrt(max(1, d - 1)) + 1e-6
        both = self.norm[:, None] ** 2 + norm[None, :] ** 2
        cross = 2 * self.norm[:, None] * norm[None, :]
        least = both - cross * np.minimum(1, inner + slack)
        most = both - cross * np.maximum(-1, inner - slack)
        self_at = self.ids[:, None] == ids[None, :]
        most[self_at] = np.inf
        limit = self.score[:, -1] ** 2
        if len(ids) >= self.k:
            limit = np.minimum(limit, np.partition(most, self.k - 1, axis=1)[:, self.k - 1])
        q, c = np.nonzero((least <= (limit * (1 + 1e-9) + 1e-12)[:, None]) & ~self_at)
        for at in range(0, len(q), 100_000):
            self._measure(q[at : at + 100_000], c[at : at + 100_000], ids, v)

    def _measure(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        apart = v[c] - self.queries[q]
        score = np.sqrt((apart * apart).sum(axis=1))
        mine = np.unique(q)
        q = np.concatenate([q, np.repeat(mine, self.k)])
        score = np.concatenate([score, self.score[mine].ravel()])
        found = np.concatenate([ids[c], self.found[mine].ravel()])
        order = np.lexsort((found, score, q))
        q, score, found = q[order], score[order], found[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.score[q[keep], place[keep]], self.found[q[keep], place[keep]] = score[keep], found[keep]


def search(indexed: DataFrame, queries: DataFrame, centre: np.ndarray, k: int = 10, certainty: float = 1.9, seed: int = 42) -> DataFrame:
    """The k nearest of each query: query_id, rank, vec_id, score. queries: rows of the index, of which repeated ones search once; indexed, centre and seed as from index()."""
    import pyarrow as pa

    spark = indexed.sparkSession
    queries = settled(queries.select("vec_id", "v").distinct())
    blocks = max(1, -(-queries.count() * 5 // (4 * BLOCK)))  # hashed blocks differ a little in size
    turn = rotation(max(1, len(centre)), seed)
    # Queries of one id are in one block, where their place tells them apart.
    w = Window.partitionBy("query_id", "at").orderBy("score", "vec_id")
    folder = f"{shared_dir(spark)}/neighbours-{uuid.uuid4().hex}"
    schema = "query_id long, rank int, vec_id long, score double"
    spark.createDataFrame([], schema).write.parquet(folder)
    for block in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], dtype=np.int64), np.array([r["v"] for r in rows], dtype=np.float64)))

        def nearest(batches: Iterator, sent=sent) -> Iterator:
            seen = Nearest(*sent.value, centre, turn, k, certainty)
            for batch in batches:
                if batch.num_rows:
                    ids, v, code, norm, own = batch.columns
                    bits = np.frombuffer(b"".join(code.to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
                    seen.see(ids.to_numpy(), _matrix(v), bits, norm.to_numpy(), own.to_numpy())
            q, at = np.nonzero(np.isfinite(seen.score))
            yield pa.RecordBatch.from_arrays([pa.array(seen.ids[q]), pa.array(q, pa.int32()), pa.array(seen.found[q, at]), pa.array(seen.score[q, at])], ["query_id", "at", "vec_id", "score"])

        found = indexed.select("vec_id", "v", "code", "norm", "own").mapInArrow(nearest, "query_id long, at int, vec_id long, score double")
        found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(folder)
        sent.destroy()  # the block's rows are written: nothing computes them again
    return spark.read.schema(schema).parquet(folder)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, centre = index(table(spark, sf_dir, "embeddings"))
    return search(indexed, indexed.filter(F.col("vec_id") % 100 == 0), centre)
