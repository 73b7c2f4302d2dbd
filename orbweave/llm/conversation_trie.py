"""Prefix trie of conversations by chained digests.

Turns are hashed where they are read. Each rebuilt conversation is a chain: the digest of its first d turns is the SHA-256 of the digest of the
first d - 1 and the hash of the d-th, so conversations share a digest exactly where they share the turns. Every prefix becomes a row, rows
are grouped by (depth, digest) into nodes, and each node is sent to its ancestors, which add up what lies below them.

A node goes to its ancestors in one block of BLOCK depths only. What a block has added up stands in its top node; tops go to the
tops above them in the same way, block over block, and their sums go down once. So a conversation of n turns makes some BLOCK * n rows instead
of n * n / 2, and no array holds more than BLOCK digests.

Conversations stream through tasks sorted by their turns: a task holds the first few turns of one base conversation and the digests of one block,
however long a conversation is. A chain can't be cut, so the turns of one conversation pass through one task, as some sixty bytes each. The ids
that end in a node are joined in order in pieces of CHUNK by tasks that split nodes by ranges of ids; only the pieces meet, in order, where the hash is made.

Defined results: null roles and texts are empty; turns of one number come in the order of their hashes; repeated rows are turns of their own; rows
without a conv_id take no part; conv_id - conv_id % 5 and % follow the sign of conv_id, as in SQL; an empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, written

#: Depths of a block, and ids of a piece.
BLOCK, CHUNK = 32, 4096
ROOT = hashlib.sha256(b"").digest()
_PREFIX = "conv_id long, depth long, digest binary, parent binary, size long, leaf boolean, up array<array<binary>>"


def turn_hash(role: Column, text: Column) -> Column:
    """32 bytes of a turn; the length of the role comes first, so that role and text can't be confused."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


class Chain:
    """One conversation's prefixes in order. up[k] of a node, where its depth divides by block ** k, are the nodes of depths that do above it in their block, from the top."""

    def __init__(self, block: int = BLOCK):
        self.block, self.depth, self.digest = block, 0, ROOT
        self.above: list[list[bytes]] = []

    def add(self, turn: bytes) -> tuple[int, bytes, bytes, list[list[bytes]]]:
        parent, up, step, k = self.digest, [], 1, 0
        self.digest = hashlib.sha256(parent + turn).digest()
        self.depth += 1
        while self.depth % step == 0:
            if k == len(self.above):
                self.above.append([ROOT])
            up.append(list(self.above[k]))
            if self.depth % (step * self.block) == 0:
                self.above[k] = [self.digest]
            else:
                self.above[k].append(self.digest)
            step, k = step * self.block, k + 1
        return self.depth, self.digest, parent, up


def chained(rows: Iterator[tuple], block: int = BLOCK, lent: int = 8) -> Iterator[tuple]:
    """Prefix rows of rebuilt conversations. rows: (base, conv_id, h, turn hash, bytes of text), by base, the base conversation first, then by conversation and turn."""
    base = conv = None
    first: list[tuple[bytes, int]] = []
    chain, held, seen = Chain(block), None, 0

    def begin(conv: int, h: int) -> Iterator[tuple]:
        nonlocal chain, held, seen
        chain, held, seen = Chain(block), (conv, 0, ROOT, None, 0, True, []), 0
        if conv != base:
            for turn, size in first[:h]:
                yield from grow(conv, turn, size)

    def grow(conv: int, turn: bytes, size: int) -> Iterator[tuple]:
        nonlocal held
        yield (*held[:5], False, held[6])
        depth, digest, parent, up = chain.add(turn)
        held = (conv, depth, digest, parent, size, True, up)

    for of, c, h, turn, size in rows:
        if of != base:
            base, first = of, []
        if c != conv:
            if held is not None:
                yield held
            conv = c
            yield from begin(c, h)
        seen += 1
        if c == base:
            if len(first) < lent:
                first.append((turn, size))
            yield from grow(c, turn, size)  # its own first turns, then its own others
        elif seen > h:
            yield from grow(c, turn, size)
    if held is not None:
        yield held


def prefixes(conversations: DataFrame, family: int = 5, lent: int = 8, block: int = BLOCK) -> DataFrame:
    """A row per rebuilt conversation and prefix, the empty one included; leaf: the conversation ends there."""
    c = F.col("conv_id").cast("long")
    turns = conversations.filter("conv_id IS NOT NULL").select(
        (c - c % family).alias("base"), c.alias("conv_id"), (F.crc32(c.cast("string").cast("binary")) % (lent + 1)).cast("int").alias("h"), F.col("turn").alias("turn"),
        turn_hash(F.col("role"), F.col("text")).alias("hash"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
    )
    ordered = turns.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "hash").drop("turn")

    def stream(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("size", pa.int64()), ("leaf", pa.bool_()), ("up", pa.list_(pa.list_(pa.binary())))])
        held = []
        for row in chained((row for batch in batches for row in zip(*[column.to_pylist() for column in batch.columns], strict=True)), block, lent):
            held.append(row)
            if len(held) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held, strict=True), out, strict=True)], schema=out)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held, strict=True), out, strict=True)], schema=out)

    return ordered.mapInArrow(stream, _PREFIX)


def ends(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """digest and ends_sha256 of the nodes in which conversations end. rows: prefix rows."""

    def joined(batches: Iterator) -> Iterator:
        """Decimal ids of one node, joined in order, in pieces that know their first id."""
        import pyarrow as pa

        node, ids = None, []

        def piece() -> tuple[bytes, int, bytes]:
            return node, ids[0], ",".join(map(str, ids)).encode()

        for batch in batches:
            pieces = []
            for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (digest != node or len(ids) == chunk):
                    pieces.append(piece())
                    ids = []
                node = digest
                ids.append(conv)
            if pieces:
                yield pa.RecordBatch.from_pylist([{"digest": d, "first": f, "piece": p} for d, f, p in pieces])
        if ids:
            yield pa.RecordBatch.from_pylist([dict(zip(("digest", "first", "piece"), piece(), strict=True))])

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        node, state = None, None
        for batch in batches:
            done = []
            for digest, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest != node:
                    if state is not None:
                        done.append({"digest": node, "ends_sha256": state.hexdigest()})
                    node, state = digest, hashlib.sha256(part)
                else:
                    state.update(b",")
                    state.update(part)
            if done:
                yield pa.RecordBatch.from_pylist(done)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"digest": node, "ends_sha256": state.hexdigest()}])

    last = rows.filter("leaf").select("digest", "conv_id")
    pieces = last.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(joined, "digest binary, first long, piece binary")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "piece").mapInArrow(hashed, "digest binary, ends_sha256 string")


def _sums(nodes: DataFrame, block: int, k: int = 0) -> DataFrame:
    """digest, leaves, saved of whole subtrees. nodes: depth in steps of block ** k, digest, up, leaves, saved (their own)."""
    deep = F.col("depth") % block == 0
    # Tops of the blocks below hand their sums on later, as a whole.
    sent = nodes.filter(~deep).select(F.explode(F.element_at("up", k + 1)).alias("digest"), "leaves", "saved")
    near = nodes.select("digest", "leaves", "saved").unionByName(sent).groupBy("digest").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    tops = nodes.filter(deep & (F.col("depth") > 0)).limit(1)
    if tops.isEmpty():
        return near
    near = written(near)
    above = nodes.filter(deep).select((F.col("depth") / block).cast("long").alias("depth"), "digest", "up")
    whole = written(_sums(above.join(near, "digest"), block, k + 1))
    handed = above.filter("depth > 0").join(whole, "digest").select(F.explode(F.element_at("up", k + 1)).alias("digest"), "leaves", "saved")
    rest = near.join(above.select("digest"), "digest", "left_anti")
    below = handed.join(above.select("digest"), "digest", "left_anti")
    return rest.unionByName(below).groupBy("digest").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).unionByName(whole)


def trie(conversations: DataFrame, family: int = 5, lent: int = 8, block: int = BLOCK) -> DataFrame:
    """One row per node: digest, parent, depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    family, lent: the first h < lent + 1 turns of a conversation are those of the first of its family of ids.
    """
    rows = written(prefixes(conversations, family, lent, block))
    grouped = rows.groupBy("depth", "digest").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), F.min("leaf").alias("leaf"), F.first("parent").alias("parent"), F.first("up").alias("up")
    )
    nodes = written(grouped)
    own = nodes.select("depth", "digest", "up", F.col("leaf").cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    none = lambda *names: [F.lit(None).cast("long").alias(x) for x in names]
    parts = [
        nodes.select("digest", "depth", "conv_id", "n_convs", "parent", *none("children", "leaves", "saved"), F.lit(None).cast("string").alias("ends")),
        _sums(own, block).select("digest", *none("depth", "conv_id", "n_convs"), F.lit(None).cast("binary").alias("parent"), *none("children"), "leaves", "saved", F.lit(None).cast("string").alias("ends")),
        nodes.filter("depth > 0").select(F.col("parent").alias("digest"), *none("depth", "conv_id", "n_convs"), F.lit(None).cast("binary").alias("parent"), F.lit(1).cast("long").alias("children"), *none("leaves", "saved"), F.lit(None).cast("string").alias("ends")),
        ends(rows).select("digest", *none("depth", "conv_id", "n_convs"), F.lit(None).cast("binary").alias("parent"), *none("children", "leaves", "saved"), F.col("ends_sha256").alias("ends")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    found = whole.groupBy("digest").agg(
        *[F.max(x).alias(x) for x in ("depth", "conv_id", "n_convs")], F.max("parent").alias("parent"), F.coalesce(F.sum("children"), F.lit(0)).alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.coalesce(F.max("ends"), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    # Many children of one parent: adaptive execution splits them, the parent's row goes to each part.
    parents = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return found.join(parents, "parent", "left")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_STEP = "CAST(xor(x >> 1, CASE WHEN (x & 1) = 1 THEN 3988292384 ELSE 0 END) AS BIGINT)"

OP12_SQL = f"""
WITH crc AS (
  SELECT c, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(k AS BIGINT) for k in range(8)]), lambda x, k: {_STEP}))) AS crc
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)),
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS hash, strlen(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
built AS (
  SELECT crc.c, k, hash, size FROM crc JOIN turns t ON t.c = crc.c - crc.c % 5 AND k <= crc % 9
  UNION ALL SELECT crc.c, k + 1000000000, hash, size FROM crc JOIN turns t ON t.c = crc.c AND k > crc % 9),
lists AS (SELECT crc.c, list(hash ORDER BY k) FILTER (hash IS NOT NULL) AS path, list(size ORDER BY k) FILTER (size IS NOT NULL) AS sizes FROM crc LEFT JOIN built USING (c) GROUP BY 1),
prefixes AS (
  SELECT c, d, CASE WHEN d > 0 THEN md5(array_to_string(path[1:d], '')) ELSE '' END AS node, CASE WHEN d > 1 THEN md5(array_to_string(path[1:d - 1], '')) WHEN d = 1 THEN '' END AS up,
         CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, coalesce(len(path), 0) AS n
  FROM lists, unnest(range(0, coalesce(len(path), 0) + 1)) AS r(d)),
nodes AS (
  SELECT d, node, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size, max(n) = d AS leaf,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends
  FROM prefixes GROUP BY 1, 2),
above AS (
  SELECT DISTINCT p.node, p.d, a.node AS top, a.d AS depth FROM prefixes p JOIN nodes m ON m.node = p.node AND m.d = p.d AND m.conv_id = p.c JOIN prefixes a ON a.c = p.c AND a.d <= p.d),
sums AS (
  SELECT top, depth, sum(CAST(leaf AS BIGINT)) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM above a JOIN nodes n ON n.node = a.node AND n.d = a.d GROUP BY 1, 2),
children AS (SELECT up, d - 1 AS depth, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s ON s.top = n.node AND s.depth = n.d LEFT JOIN nodes p ON p.node = n.up AND p.d = n.d - 1 LEFT JOIN children k ON k.up = n.node AND k.depth = n.d
"""
