"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: a bit is the majority of that bit in the hashes of a text's word shingles. Two fingerprints link if they differ
in at most `errors` bits; components of links are the groups.

The join walks pairs of trie nodes from the root, adds up the bits in which their paths differ and drops a pair once it has more
than it may. To have little left near the root, where every path exists, there are errors + 1 tries, each over the bits rotated
to begin with another block. Differing bits dealt to errors + 1 blocks in a circle always leave a block from which on the first l blocks
hold at most l - 1 of them, for every l; so each link is found in one of the tries although its walk allows no
difference in the first block, one in the first two, and so on. The first block is the key by which Spark deals out the walk.
Nodes with more than LEAF fingerprints are split into subtries, and pairs of subtries walked in tasks of their own, so no
key gathers an unbounded number of fingerprints. Equal fingerprints count once, whatever the number of copies.

Defined results: null and empty texts have fingerprint zero and link like others; fewer words than a shingle form one; an empty table gives no
rows; repeated rows give repeated rows. A null doc_id is never the smallest unless a group has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import lean, table, written
from .components import Groups, stars
from .similar import again, confirmed, printed, sharing

#: Fingerprints of a subtrie at most, and bits by which a larger one is split.
LEAF, STEP = 16_384, 3
#: Pairs of fingerprints compared at once in a task, pairs of nodes in a portion, and fingerprints of nodes that are compared outright.
SLICE, WAITING, FEW = 1 << 20, 1 << 17, 8
HASHES = 50_000
#: Pairs for each group beyond which not all are tried at once, and rounds in which they are not.
MANY, ROUNDS = 4, 2
#: Edges between texts that one task joins at most.
ALONE = 1 << 18


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    import xxhash

    own = text.lower().split()  # bytes: ASCII letters and white space only
    if not own:
        return 0
    if len(own) < words:
        own = [b" ".join(own)]
        words = 1
    line = memoryview(b" ".join(own))
    sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(own) - words + 1], ends[words - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), HASHES):
        part = starts[at : at + HASHES].tolist(), ends[at : at + HASHES].tolist()
        h = np.fromiter((digest(line[s:e], seed) for s, e in zip(*part, strict=True)), dtype="<u8", count=len(part[0]))
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    import pyarrow as pa

    def each(batches: Iterator) -> Iterator:
        for batch in batches:
            fps = np.array([fingerprint(x or b"", words, seed) for x in batch.column(1).to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(each), f"doc_id {kind}, fp long")


def blocks(errors: int) -> list[int]:
    """Bits of each block."""
    return [64 // (errors + 1) + (k < 64 % (errors + 1)) for k in range(errors + 1)]


def budgets(errors: int) -> np.ndarray:
    """[rotation, depth]: differing bits that a path of this many bits may have."""
    sizes = blocks(errors)
    return np.array([[0] + [k for k, n in enumerate(sizes[r:] + sizes[:r]) for _ in range(n)] for r in range(errors + 1)])


def near(values: np.ndarray, items: np.ndarray, rotation: np.ndarray, errors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """values: rotated fingerprints, sorted within each item; items: where each begins, and the end. Yields all linked pairs of positions i < j, some at a time.

    Pairs of nodes wait on a stack in portions of at most WAITING, deepest first, so memory is bounded.
    """
    allowed, none, ones, few = budgets(errors), np.zeros(0, dtype=np.int64), {}, np.arange(FEW)

    def small(la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray) -> Iterator:
        """Pairs between ranges of at most FEW fingerprints."""
        for at in range(0, len(la), SLICE // (FEW * FEW)):
            part = slice(at, at + SLICE // (FEW * FEW))
            i, j = la[part, None] + few, lb[part, None] + few
            own, other = i < ha[part, None], j < hb[part, None]
            close = np.bitwise_count(values[np.minimum(i, len(values) - 1)][:, :, None] ^ values[np.minimum(j, len(values) - 1)][:, None, :]) <= errors
            close &= own[:, :, None] & other[:, None, :] & (i[:, :, None] < j[:, None, :])
            k, x, y = np.nonzero(close)
            if len(k):
                yield i[k, x], j[k, y]

    def large(la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray) -> Iterator:
        """Pairs between ranges of any size, one range after the other: only equal values are left together at the leaves."""
        for a, b, c, d in zip(la.tolist(), ha.tolist(), lb.tolist(), hb.tolist(), strict=True):
            for i in range(a, b):
                for at in range(max(c, i + 1), d, SLICE):
                    j = np.arange(at, min(d, at + SLICE))
                    j = j[np.bitwise_count(values[j] ^ values[i]) <= errors]
                    if len(j):
                        yield np.full(len(j), i), j

    lo, hi = items[:-1], items[1:]
    stack = [(0, lo, hi, none, none, none, none, none)]
    while stack:
        depth, lo, hi, la, ha, lb, hb, wrong = stack.pop()
        done = hi - lo <= FEW
        yield from small(lo[done], hi[done], lo[done], hi[done])
        lo, hi = lo[~done], hi[~done]
        done = (ha - la <= FEW) & (hb - lb <= FEW)
        yield from small(la[done], ha[done], lb[done], hb[done])
        la, ha, lb, hb, wrong = (x[~done] for x in (la, ha, lb, hb, wrong))
        if not len(lo) and not len(la):
            continue
        if depth == 64:
            yield from large(lo, hi, lo, hi)
            yield from large(la, ha, lb, hb)
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int32)])
        one = ones[depth]
        middle = hi - (one[hi] - one[lo])
        ma, mb = ha - (one[ha] - one[la]), hb - (one[hb] - one[lb])
        new = [
            np.concatenate(x) for x in zip(
                (lo, middle, middle, hi, np.ones(len(lo), dtype=np.int64)), (la, ma, lb, mb, wrong), (ma, ha, mb, hb, wrong), (la, ma, mb, hb, wrong + 1), (ma, ha, lb, mb, wrong + 1), strict=True
            )
        ]
        la, ha, lb, hb, wrong = new
        live = (ha > la) & (hb > lb)
        live[live] = wrong[live] <= allowed[rotation[la[live]], depth + 1]
        pairs = [x[live] for x in new]
        lo, hi = np.concatenate([lo, middle]), np.concatenate([middle, hi])
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        for at in range(0, max(1, len(pairs[0])), WAITING):
            stack.append((depth + 1, *((lo, hi) if not at else (none, none)), *[x[at : at + WAITING] for x in pairs]))


def walk(values: np.ndarray, items: np.ndarray, rotation: np.ndarray, errors: int) -> np.ndarray:
    """As near, but returns for each position that of a linked one, or its own: stars that connect just what links connect."""
    groups = Groups(len(values))
    for i, j in near(values, items, rotation, errors):
        groups.join(i, j)
    return groups.label


def _rotated(fp: F.Column, bits: int) -> F.Column:
    return fp if not bits else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def _prefix(value: F.Column, bits: int) -> F.Column:
    return value.bitwiseAND(F.lit(-(1 << (64 - bits))))


def walks(distinct: DataFrame, errors: int) -> DataFrame:
    """distinct: fp, and m where there are several fingerprints, and further columns. Rows (rot, a, b, r, further): the rotated fingerprints of each walk, which is a pair of subtries a and b of one rotation (or one twice). rot counts the rotations of all fingerprints."""
    sizes = blocks(errors)
    number = F.col("m") * (errors + 1) if "m" in distinct.columns else F.lit(0)
    more = [c for c in distinct.columns if c not in ("m", "fp")]
    turns = F.array(*[F.struct((number + k).cast("int").alias("rot"), _rotated(F.col("fp"), sum(sizes[:k])).alias("r")) for k in range(errors + 1)])
    depth = sizes[-1]  # the shortest first block
    rows = distinct.select(F.inline(turns), *more).withColumn("node", _prefix(F.col("r"), depth))
    hot = written(rows.groupBy("rot", "node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LEAF).select("rot", "node"))
    if hot.isEmpty():
        return rows.select("rot", F.col("node").alias("a"), F.col("node").alias("b"), "r", *more)
    plain = rows.join(hot, ["rot", "node"], "left_anti").select("rot", F.col("node").alias("a"), F.col("node").alias("b"), "r", *more)
    split = written(rows.join(hot, ["rot", "node"], "left_semi").withColumn("depth", F.lit(depth)))
    pairs = hot.select("rot", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(depth).alias("da"), F.lit(depth).alias("db"))
    budget = F.array(*[F.array(*map(F.lit, x)) for x in budgets(errors).tolist()])
    while not hot.isEmpty():
        deeper = min(depth + STEP, 64)
        hot = hot.withColumn("hot", F.lit(True))
        moved = F.when(F.col("hot"), _prefix(F.col("r"), deeper)).otherwise(F.col("node"))
        split = split.join(hot, ["rot", "node"], "left").select("rot", "r", *more, F.col("node").alias("up"), moved.alias("node"), F.when(F.col("hot"), deeper).otherwise(F.col("depth")).alias("depth"))
        split = written(split)
        below = written(split.filter("node <> up or depth = %d" % deeper).groupBy("rot", "up", "node").agg(F.count(F.lit(1)).alias("n")))
        for side in "ab":
            child = below.select("rot", F.col("up").alias(side), F.col("node").alias(f"_{side}"))
            pairs = pairs.join(child, ["rot", side], "left")
        pairs = pairs.select("rot", "a", "b", *[F.coalesce(f"_{x}", x).alias(f"n{x}") for x in "ab"], *[F.when(F.col(f"_{x}").isNull(), F.col(f"d{x}")).otherwise(deeper).alias(f"d{x}") for x in "ab"])
        common = F.least("da", "db")
        wrong = F.bit_count(F.call_function("shiftrightunsigned", F.col("na").bitwiseXOR(F.col("nb")), (64 - common).cast("int")))
        allowed = F.element_at(F.element_at(budget, F.col("rot") % (errors + 1) + 1), common.cast("int") + 1)
        pairs = pairs.filter((F.col("a") != F.col("b")) | (F.col("na") <= F.col("nb"))).filter(wrong <= allowed)
        pairs = written(pairs.select("rot", F.col("na").alias("a"), F.col("nb").alias("b"), "da", "db"))
        split = split.select("rot", "r", *more, "node", "depth")
        depth = deeper
        hot = written(below.filter(F.col("n") > LEAF).select("rot", "node")) if depth < 64 else hot.limit(0)
    members = pairs.select("rot", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
    return plain.unionByName(split.select("rot", "node", "r", *more).join(members, ["rot", "node"]).select("rot", "a", "b", "r", *more))


def walked(distinct: DataFrame, errors: int, stars_only: bool = True) -> DataFrame:
    """distinct: fp, each once (per m, where there are several fingerprints). Edges m, u, v between fingerprints: those that connect just what links connect, or
    all links between fingerprints that differ in column `of`."""
    import pyarrow as pa

    sizes = blocks(errors)
    back = np.cumsum([0, *sizes[:-1]]).astype("<u8")

    def found(rows: np.ndarray) -> Iterator:
        r = rows[:, 3].astype("<u8")
        first = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]))
        order = np.lexsort((r, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))))
        rows, r = rows[order], r[order]
        items, rot = np.append(first, len(rows)), rows[:, 0] % (errors + 1)
        turn = back[rot]
        fp = np.where(turn > 0, (r >> turn) | (r << (np.uint64(64) - turn) % np.uint64(64)), r).view("<i8")
        if stars_only:
            label = walk(r, items, rot, errors)
            own = np.flatnonzero(label != np.arange(len(label)))
            links = [(own, label[own])] if len(own) else []
        else:
            links = ((i[apart], j[apart]) for i, j in near(r, items, rot, errors) if (apart := rows[i, 4] != rows[j, 4]).any())
        for i, j in links:
            yield pa.RecordBatch.from_arrays([pa.array(rows[i, 0] // (errors + 1)).cast(pa.int32()), pa.array(fp[i]), pa.array(fp[j])], ["m", "u", "v"])

    def each(batches: Iterator) -> Iterator:
        held: list[np.ndarray] = []
        count = 0
        for batch in batches:
            held.append(np.stack([x.to_numpy().astype(np.int64) for x in batch.columns], axis=1))
            count += batch.num_rows
            if count >= 4 * LEAF:
                rows = np.concatenate(held)
                changes = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
                if len(changes):
                    yield from found(rows[: changes[-1] + 1])
                    rows = rows[changes[-1] + 1 :]
                held, count = [rows], len(rows)
        if count:
            yield from found(np.concatenate(held))

    dealt = walks(distinct, errors).select(F.col("rot").cast("long").alias("rot"), "a", "b", "r", *([] if stars_only else ["of"]))
    return dealt.repartition("rot", "a", "b").sortWithinPartitions("rot", "a", "b").mapInArrow(lean(each), "m int, u long, v long")


def linked(distinct: DataFrame, errors: int) -> DataFrame:
    """distinct: fp, each once. Edges u, v that connect just the fingerprints that links connect."""
    return walked(distinct, errors).select("u", "v")


def near_duplicates(docs: DataFrame, words: int = 4, errors: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id."""
    own = written(fingerprints(docs, words, seed))
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = stars(linked(distinct.select("fp"), errors))
    of = written(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = written(of.groupBy("root").agg(F.min("least").alias("component_id")))
    labels = written(of.join(smallest, "root").select("fp", "component_id"))
    return own.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar_groups(docs: DataFrame, words: int = 5, errors: int = 10, prints: int = 3, share: tuple[int, int] = (4, 5), seed: int = 42) -> DataFrame:
    """doc_id, key (of its set of shingles) and component_id, the smallest doc_id of its group.

    Two texts link if the Jaccard similarity of their whole sets of shingles is at least share (a fraction) and one of their `prints` independent fingerprints differs in at most
    `errors` bits. The walks name the pairs; sets are compared exactly. First each text is held against a few centres of its stars, which joins large groups with few comparisons, then groups that are apart against
    all such centres; shared rare shingles give all other pairs of the groups that are still apart. Texts with the same set are one text throughout. Null and empty texts have the empty set and form a group.
    """
    read = written(printed(docs, words, prints, seed))
    own = read.select("doc_id", "key")
    texts = written(read.filter("n > 0").dropDuplicates(["key"]).select("key", "n", "fps"))
    each = texts.select("key", F.posexplode("fps").alias("m", "fp"))
    distinct = written(each.groupBy("m", "fp").agg(F.min("key").alias("least"), F.max("key").alias("most")))
    edges = written(walked(distinct.select("m", "fp"), errors))
    centre = distinct.select("m", F.col("fp").alias("v"), F.col("least").alias("a"))
    apart = edges.join(centre, ["m", "v"]).join(each.select("m", F.col("fp").alias("u"), F.col("key").alias("b")), ["m", "u"]).select("a", "b")
    equal = each.join(distinct.filter("least <> most").select("m", "fp", F.col("least").alias("a")), ["m", "fp"]).filter("key <> a").select("a", F.col("key").alias("b"))
    met = written(apart.unionByName(equal).filter("a <> b").distinct())
    reach = stars(met.select(F.col("a").alias("u"), F.col("b").alias("v")), ALONE)

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs that may be similar by their sizes and fingerprints."""
        one, two = (texts.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("fps").alias(f"f{x}")) for x in "ab")
        bits = F.exists(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= errors), lambda x: x)
        return pairs.join(one, "a").join(two, "b").filter((share[1] * F.least("na", "nb") >= share[0] * F.greatest("na", "nb")) & bits).select("a", "b")

    def by_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs whose groups are apart, with the groups' roots."""
        for x in "ab":
            pairs = pairs.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"_{x}")), x, "left").withColumn(f"r{x}", F.coalesce(f"_{x}", x)).drop(f"_{x}")
        return pairs.filter("ra <> rb")

    spark = docs.sparkSession
    left, links, roots = written(close(met).withColumn("ra", F.col("a")).withColumn("rb", F.col("b"))), spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, root long")

    def joined(pairs: DataFrame) -> DataFrame:
        """Adds those of the pairs that link; the roots of all links so far."""
        nonlocal links
        links = links.unionByName(confirmed(pairs, own, docs, words, seed, share))
        return stars(links.select(F.col("a").alias("u"), F.col("b").alias("v")), ALONE)

    for power in range(ROUNDS + 1):
        row = left.agg(F.count(F.lit(1)), F.count_distinct("rb")).first()
        if not row[0]:
            break
        tried = left.select("a", "b")
        if power < ROUNDS and row[0] > MANY * row[1]:  # large groups: one pair of each group in the first round, at most eight in the next
            tried = written(left.groupBy("rb", F.pmod(F.xxhash64("a"), F.lit(8**power))).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"))
        roots = joined(tried)
        if row[0] <= MANY * row[1]:
            break
        left = written(by_roots(left.select("a", "b").join(tried, ["a", "b"], "left_anti"), roots))
    label = reach.join(roots.withColumnRenamed("root", "of"), "node", "left").select(F.col("node").alias("key"), F.col("root").alias("reach"), F.coalesce("of", "node").alias("of"))
    tops = reach.select(F.col("root").alias("key")).distinct().join(roots.select(F.col("node").alias("key"), F.col("root").alias("of")), "key", "left").select("key", F.col("key").alias("reach"), F.coalesce("of", "key").alias("of"))
    label = written(label.unionByName(tops))
    several = label.groupBy("reach").agg(F.min("of").alias("x"), F.max("of").alias("y")).filter("x <> y").select("reach")
    still = written(label.join(several, "reach", "left_semi").select("key", "reach", "of"))
    if not still.isEmpty():
        known = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

        def unknown(pairs: DataFrame) -> DataFrame:
            return written(close(pairs.join(known, ["a", "b"], "left_anti")))

        texts_still = again(still.select("key"), own, docs, words, seed).join(still, "key")
        roots = joined(unknown(sharing(texts_still, share, lambda pairs: joined(unknown(pairs)))))
    least = own.groupBy("key").agg(F.min("doc_id").alias("_least"))
    named = written(least.join(roots, F.col("key") == F.col("node"), "left").select("key", "_least", F.coalesce("root", "key").alias("root")))
    smallest = written(named.groupBy("root").agg(F.min("_least").alias("component_id")))
    return own.join(written(named.join(smallest, "root").select("key", "component_id")), "key").select("doc_id", "key", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, errors: int = 10, prints: int = 3, share: tuple[int, int] = (4, 5), seed: int = 42) -> DataFrame:
    """The document of the smallest id of each group of similar_groups, all columns. doc_id tells documents apart."""
    keep = similar_groups(docs, words, errors, prints, share, seed).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.col("doc_id").alias("_doc"), F.struct("*").alias("_row"))
    return rows.join(keep, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("_row.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
