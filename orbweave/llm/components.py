"""Connected components of an edge table by alternating stars.

Each round hangs the larger neighbours of a node on its smallest one, then its smaller ones; edges become stars in a number of rounds
that grows with the logarithm of the longest chain. Every round is a join and an aggregation over the edges alone, and is
kept in the shared folder. The minima are kept before they are joined, so that a node with very many edges can be split.
A bounded number of edges may be joined in one task instead, as so many rounds of small jobs cost more than they share out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import lean, written


class Groups:
    """Smallest-label components of positions, joined link by link in bulk."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label[:] = up


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _alone(batches: Iterator) -> Iterator:
    """The stars of all edges of a task."""
    import pyarrow as pa

    held = [np.stack([x.to_numpy() for x in batch.columns]) for batch in batches]
    if held:
        nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        at, groups = at.reshape(2, -1), Groups(len(nodes))
        groups.join(*at)
        own = np.flatnonzero(groups.label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[groups.label[own]])], ["node", "root"])


def stars(edges: DataFrame, alone: int = 0) -> DataFrame:
    """edges: u, v (long). One row (node, root) per node that isn't its component's smallest; root is the smallest. Up to `alone` edges, a table then, are joined in one task."""
    if alone and edges.count() <= alone:
        return written(edges.select("u", "v").coalesce(1).mapInArrow(lean(_alone), "node long, root long"))
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = _signature(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
