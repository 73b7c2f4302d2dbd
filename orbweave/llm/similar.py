"""Sets of word shingles, their fingerprints, and the exact Jaccard similarity of named pairs of sets.

Shingles are of lower-cased words and stand for themselves as 64-bit hashes, and sets as a hash of these; null and empty texts have the
empty set; fewer words than a shingle form one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import lean, remembered, written

#: Documents that are sent to all executors at most when sets are read again.
SENT = 200_000
#: Classes of shingles whose parities are compared.
PARITIES = 1024
#: Hubs of a shingle at most, in each round that holds texts against hubs (the next comes only if one has halved the comparisons), and comparisons for each row beyond which there are such rounds.
HUBS, CROWDED = (4, 16), 16


def shingles(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """The set of a text's shingles: sorted hashes."""
    import xxhash

    own = text.lower().split()  # bytes: ASCII letters and white space only
    if not own:
        return np.zeros(0, dtype="<u8")
    words = min(words, len(own))
    line = memoryview(b" ".join(own))
    ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, n = xxhash.xxh64_intdigest, len(own) - words + 1
    return np.unique(np.fromiter((digest(line[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), dtype="<u8", count=n))


def _key(own: np.ndarray) -> int:
    """A signed long that stands for a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).view(np.int64))


def majorities(own: np.ndarray, prints: int) -> list[int]:
    """As many independent fingerprints of a set: a bit is set if it is in over half of the hashes; further ones mix the hashes anew. Signed."""
    out = []
    for m in range(prints):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(own), 50_000):
            h = own[at : at + 50_000]
            if m:  # steps of the generator splitmix64
                h = h + np.uint64(m * 0x9E3779B97F4A7C15 % (1 << 64))
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h = h ^ (h >> np.uint64(31))
            ones += np.unpackbits(np.ascontiguousarray(h).view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0]))
    return out


def printed(docs: DataFrame, words: int, prints: int, seed: int) -> DataFrame:
    """doc_id, key and n (of the set of shingles) and its fingerprints fps."""
    import pyarrow as pa

    def each(batches: Iterator) -> Iterator:
        remembered("shingles")
        for batch in batches:
            keys, sizes, fps = [], [], []
            for x in batch.column(1):
                own = shingles(x.as_py() or b"", words, seed)
                keys.append(_key(own))
                sizes.append(len(own))
                fps.append(majorities(own, prints))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "key", "n", "fps"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(each), f"doc_id {kind}, key long, n long, fps array<long>")


def sets(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """key and own (the sorted hashes as binary) of each document."""
    import pyarrow as pa

    def each(batches: Iterator) -> Iterator:
        for batch in batches:
            found = [shingles(x or b"", words, seed) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "own"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(lean(each), "key long, own binary")


def again(keys: DataFrame, own: DataFrame, docs: DataFrame, words: int, seed: int) -> DataFrame:
    """key and own (as sets gives them) of the distinct keys. own: doc_id and key of all documents."""
    keys = written(keys)
    sent = keys.count() <= SENT
    few = F.broadcast(keys) if sent else keys
    # One document stands for a set; its text is read again, as sets of all documents would take more room than the texts.
    ids = own.join(few, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("_id")).select("_id").distinct()
    ids = F.broadcast(ids) if sent else written(ids)
    texts = docs.select(F.col("doc_id").alias("_doc"), "text").join(ids, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi")
    return written(sets(texts, words, seed).join(few, "key", "left_semi").dropDuplicates(["key"]))


def bounds(share: tuple[int, int], most: int, steps: int = 6) -> np.ndarray:
    """The least size of each class of sizes up to `most`; similar sets are at most about `steps` classes apart."""
    out, ratio = [1], (share[1] / share[0]) ** (1 / steps)
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out)


def reached(n: int, least: np.ndarray, share: tuple[int, int]) -> list[tuple[int, int]]:
    """(class, k) for a set of n shingles: a similar set of that class holds one of its first k shingles, in any order common to both, and this one likewise."""
    over, both = share[0], share[0] + share[1]
    low, high = -(-n * share[0] // share[1]), n * share[1] // share[0]
    first, last = (int(np.searchsorted(least, x, side="right")) - 1 for x in (low, high))
    out = [(d, n + 1 - -(-over * (n + max(low, int(least[d]))) // both)) for d in range(first, last + 1)]
    return [(d, k) for d, k in out if k > 0]


def sharing(texts: DataFrame, share: tuple[int, int], joined: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs (a, b) of keys, a < b, of the same `reach` and another `of` that hold a shingle in common among their rarest: all such pairs with at least this Jaccard similarity, and few others.

    joined tells for some of the pairs what they join: the root of each node that isn't its group's smallest, all groups so far being told. With it, a crowd is first held against hubs, a few texts of each shingle, which takes a bounded
    number of comparisons a row; what that joins needs no further pairs, and the pairs returned are those between texts that are apart then.

    texts: key, own (the set), reach, of. Of two sets whose similarity is that of share, at least t shingles are in both, t following from their sizes; so, with the shingles of both in one order, the first of these
    is among the first n - t + 1 of either. The order is by rareness, so what only one text of a reach holds is passed over, and a crowd about one passage shares nothing where each has too much of its own. Sizes go by narrow classes,
    so that t is nearly exact. A shingle that many hold pairs only the texts that are not of its largest group, with those of other groups. A pair is given up if too few shingles are left from the common one on, or if the
    parities of the shingles in PARITIES classes differ in more classes than the sets may in shingles.
    """
    import pyarrow as pa

    def each(batches: Iterator) -> Iterator:
        for batch in batches:
            for key, own, reach in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                h = np.frombuffer(own, dtype="<i8")
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), x), pa.int64()) for x in (key, reach, len(h))] + [pa.array(h)], ["key", "reach", "n", "h"])

    def parities(batches: Iterator) -> Iterator:
        for batch in batches:
            bits = [np.packbits(np.bincount((np.frombuffer(x, dtype="<u8") >> np.uint64(20)).astype(np.int64) % PARITIES, minlength=PARITIES) % 2 == 1).view("<i8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], ["key", "bits"])

    def dealt(batches: Iterator) -> Iterator:
        for batch in batches:
            rows: list[tuple] = []
            for key, reach, n, own in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                least = bounds(share, 2 * n)
                mine = int(np.searchsorted(least, n, side="right")) - 1
                alone = n - len(own)
                for d, k in reached(n, least, share):
                    rows += [(key, reach, n, n - alone - i, x, min(mine, d), max(mine, d), (mine > d) - (mine < d)) for i, x in enumerate(own[: max(0, k - alone)])]
            for at in range(0, len(rows), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[at : at + (1 << 16)], strict=True)], names)

    names = ["key", "reach", "n", "left", "h", "low", "high", "side"]
    tokens = written(texts.select("key", "own", "reach").mapInArrow(lean(each), "key long, reach long, n long, h long"))
    held = tokens.groupBy("reach", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    ranked = tokens.join(held, ["reach", "h"]).groupBy("key", "reach", "n").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("s"))
    rows = written(ranked.select("key", "reach", "n", F.col("s.h").alias("own")).mapInArrow(lean(dealt), ", ".join(f"{x} long" for x in names)))
    groups = written(texts.select("key", "of"))
    bucket, row = ["reach", "h", "low", "high"], ["key", "of", "n", "left", "bits"]
    bits = written(texts.select("key", "own").mapInArrow(lean(parities), "key long, bits array<long>"))
    sizes = F.col("a_n") + F.col("b_n")
    common = F.ceil(share[0] * sizes / (share[0] + share[1]))
    apart = sum((F.bit_count(F.col("a_bits")[k].bitwiseXOR(F.col("b_bits")[k])) for k in range(PARITIES // 64)), F.lit(0))
    fine = (F.col("a_of") != F.col("b_of")) & (F.least("a_left", "b_left") >= common) & (apart <= sizes - 2 * common)

    def sided(held: DataFrame, x: str, sign: int) -> DataFrame:
        return held.select(*bucket, (F.col("side") * sign).alias("side"), "top", *[F.col(c).alias(f"{x}_{c}") for c in row])

    def named(one: DataFrame, two: DataFrame) -> DataFrame:
        pairs = one.drop("top").join(two.drop("top"), [*bucket, "side"]).filter(fine).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
        return written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    before = float("inf")
    for turn in range(len(HUBS) + 1):
        own = rows.join(groups, "key")
        counts = own.groupBy(*bucket, "of").agg(F.count(F.lit(1)).alias("n")).groupBy(*bucket).agg(F.max(F.struct("n", "of")).alias("top"), F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"))
        large = written(counts.filter("groups > 1").select(*bucket, F.col("top.of").alias("top"), "n", (F.col("n") - F.col("top.n")).alias("others")))
        several = written(own.join(large.select(*bucket, "top"), bucket).join(bits, "key"))
        held, compared = large.agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("others"))).first()
        if joined is None or turn == len(HUBS) or not held or compared <= CROWDED * held or compared > before / 2:
            break
        before = compared
        mixed = F.xxhash64("key", F.lit(turn))
        first = F.struct((F.col("of") != F.col("top")).alias("_far"), mixed.alias("_mixed"), *row)
        hubs = written(several.groupBy(*bucket, "side", "top", F.pmod(mixed, F.lit(HUBS[turn])).alias("_hub")).agg(F.min(first).alias("hub")).select(*bucket, "side", "top", *[F.col(f"hub.{c}").alias(c) for c in row]))
        roots = joined(named(sided(several, "a", 1), sided(hubs, "b", -1)))
        groups = written(groups.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "of").alias("of")))
        rows = several.select(*names)  # one group alone stays so
    return named(sided(several, "a", 1).filter("a_of <> top"), sided(several, "b", -1))


def confirmed(pairs: DataFrame, own: DataFrame, docs: DataFrame, words: int, seed: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of keys, a table that is read twice, whose sets have at least this Jaccard similarity, a fraction. own: doc_id and key of all documents."""
    import pyarrow as pa

    over, under = share

    def similar(batches: Iterator) -> Iterator:
        for batch in batches:
            fine = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(left.as_py(), dtype="<u8"), np.frombuffer(right.as_py(), dtype="<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(under * both >= over * (len(x) + len(y) - both))
            keep = pa.array(fine, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    whole = again(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), own, docs, words, seed)
    sides = pairs.join(whole.select(F.col("key").alias("a"), F.col("own").alias("_a")), "a").join(whole.select(F.col("key").alias("b"), F.col("own").alias("_b")), "b")
    return written(sides.select("a", "b", "_a", "_b").mapInArrow(lean(similar), "a long, b long"))
