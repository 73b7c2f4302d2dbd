"""Packed token matrices: best-fit-decreasing packing with a segment tree over the room that is left.

Each task reads its documents once and packs a window of tokens at a time. Documents longer than a sequence are cut into
full sequences and a rest, without loss. Rests, longest first, go to the open sequence with the least room that holds them; the
segment tree over room sizes finds it in logarithmic time. Rows are sequences: a padded row of ids, the cumulative segment
lengths (attention stays inside a segment), a bit per position where positions start at 0 again, and whose tokens they are.
Files are written by the same tasks, a block of rows at a time, so a task holds a window of tokens and a block.

Null and empty texts have no tokens and are in no sequence, unless a closing id is asked for; repeated rows are packed each; an
empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType

from .common import lean, mounted, table
from .tokens import default_path, id_batches

#: Tokens and documents of a window (the latter bound it where texts are empty or nearly so), and rows of a file.
WINDOW, DOCUMENTS, ROWS = 1 << 22, 1 << 18, 4096


class RoomTree:
    """Open sequences by the room they have left; finds the smallest room of at least n."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = np.zeros(2 * self.leaves, dtype=np.int64).tolist()
        self.open: dict[int, list[int]] = {}

    def _change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, sequence: int, room: int) -> None:
        if room:
            self.open.setdefault(room, []).append(sequence)
            self._change(room, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """A sequence with the least room of at least n, and that room; it is taken out."""
        at = n + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up to a left child whose neighbour has some
                at >>= 1
            if at <= 1:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._change(room, -1)
        return self.open[room].pop(), room


def best_fit(lengths: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length), best fit in descending order."""
    out: list[list[tuple[int, int, int]]] = []
    rests = []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= length:
            out.append([(doc, start, length)])
            start += length
        if n > start:
            rests.append((n - start, doc, start))
    tree = RoomTree(length)
    for n, doc, start in sorted(rests, key=lambda x: (-x[0], x[1])):
        found = tree.take(n)
        if found is None:
            out.append([])
            found = len(out) - 1, length
        at, room = found
        out[at].append((doc, start, n))
        tree.add(at, room - n)
    return out


def _packer(kind: DataType, path: str, length: int, closing: int | None, padding: int, window: int, documents: int) -> Callable[[Iterator], Iterator]:
    """What a task does: from batches of (doc_id, text as binary) to batches of sequences."""
    import pyarrow as pa

    end = b"" if closing is None else np.array([closing], dtype="<u4").tobytes()

    def packed(batches: Iterator) -> Iterator:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        context = TaskContext.get()
        following, held, names, ids = (context.partitionId() if context else 0) << 40, 0, [], []

        def rows(sequences: list[list[tuple[int, int, int]]]) -> Iterator:
            for at in range(0, len(sequences), 256):
                part = sequences[at : at + 256]
                matrix = np.full((len(part), length), padding, dtype="<u2")
                resets = np.zeros((len(part), length), dtype=bool)
                sums = []
                for k, pieces in enumerate(part):
                    cu = [0]
                    for doc, start, n in pieces:
                        matrix[k, cu[-1] : cu[-1] + n] = ids[doc][start : start + n]
                        resets[k, cu[-1]] = True
                        cu.append(cu[-1] + n)
                    sums.append(cu)
                columns = [
                    pa.array(range(following + at, following + at + len(part)), pa.int64()), pa.array([x.tobytes() for x in matrix], pa.binary()),
                    pa.array([cu[-1] for cu in sums], pa.int32()), pa.array(sums, pa.list_(pa.int32())),
                    pa.array([x.tobytes() for x in np.packbits(resets, axis=1)], pa.binary()),
                    pa.array([[names[d] for d, _, _ in x] for x in part], pa.list_(to_arrow_type(kind))), pa.array([[s for _, s, _ in x] for x in part], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["sequence_id", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "starts"])

        def flush() -> Iterator:
            nonlocal following, held, names, ids
            sequences = best_fit([len(x) for x in ids], length)
            yield from rows(sequences)
            following, held, names, ids = following + len(sequences), 0, [], []

        for some, encoded in id_batches(batches, path):
            for name, x in zip(some, encoded, strict=True):
                own = np.frombuffer(x + end, dtype="<u4")
                if len(own) and own.max() > 65_535:
                    raise ValueError("ids above 65,535 don't fit the matrices")
                names.append(name)
                ids.append(own.astype("<u2"))
                held += len(own)
                if held >= window or len(names) >= documents:
                    yield from flush()
        if names:
            yield from flush()

    return packed


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def token_matrices(docs: DataFrame, path: str | None = None, length: int = 2048, closing: int | None = 49407, padding: int = 49407, window: int = WINDOW, documents: int = DOCUMENTS) -> DataFrame:
    """sequence_id, ids (length little-endian unsigned 16-bit ids, padded), n_tokens, cu_seqlens, position_resets (packed bits, most significant first), doc_ids and starts of the segments. Ids must be below 65,536."""
    kind = docs.schema["doc_id"].dataType
    schema = f"sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets binary, doc_ids array<{kind.simpleString()}>, starts array<long>"
    return _texts(docs).mapInArrow(lean(_packer(kind, path or default_path(), length, closing, padding, window, documents)), schema)


def token_files(docs: DataFrame, folder: str | None = None, path: str | None = None, length: int = 2048, closing: int | None = 49407, padding: int = 49407, window: int = WINDOW, rows: int = ROWS, documents: int = DOCUMENTS) -> DataFrame:
    """Writes the sequences of token_matrices and returns a row for each: file, row (in it), sequence_id, n_tokens, ids_crc32 (of the padded row), cu_seqlens, doc_ids, starts.

    folder must be mounted by all executors (by default a new one in spark.checkpoint.dir). A file name stands for <name>.ids.npy (matrix), <name>.resets.npy (packed bits), <name>.cu_seqlens.npy (of all rows after one
    another) and <name>.rows.npy (how many of those each row has), for at most `rows` rows. Files appear whole or not at all, and a repeated task writes the same, so none is lost or doubled. Nothing is written before the result is asked for.
    """
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType
    packed = _packer(kind, path or default_path(), length, closing, padding, window, documents)
    into = mounted(docs.sparkSession, folder, "matrices")

    def save(name: str, parts: dict[str, np.ndarray]) -> None:
        os.makedirs(into, exist_ok=True)
        for end, x in parts.items():
            with open(f"{into}/{name}.{end}.npy.{uuid.uuid4().hex}", "wb") as f:
                np.save(f, x)
            os.replace(f.name, f"{into}/{name}.{end}.npy")

    def write(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part, block, held, count = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator:
            nonlocal block, held, count
            own = pa.Table.from_batches(held)
            name, ids = f"{part:06d}-{block:06d}", own.column("ids").to_pylist()
            cu = own.column("cu_seqlens").combine_chunks()
            save(name, {
                "ids": np.frombuffer(b"".join(ids), dtype="<u2").reshape(count, length), "resets": np.frombuffer(b"".join(own.column("position_resets").to_pylist()), dtype=np.uint8).reshape(count, -1),
                "cu_seqlens": cu.flatten().to_numpy().astype("<i4"), "rows": cu.value_lengths().to_numpy().astype("<i4"),
            })
            told = own.drop_columns(["ids", "position_resets"])
            for column, x in (("ids_crc32", pa.array([zlib.crc32(x) for x in ids], pa.int64())), ("row", pa.array(range(count), pa.int32())), ("file", pa.array([name] * count))):
                told = told.append_column(column, x)
            block, held, count = block + 1, [], 0
            yield from told.select(["file", "row", "sequence_id", "n_tokens", "ids_crc32", "cu_seqlens", "doc_ids", "starts"]).to_batches()

        for batch in packed(batches):
            while batch.num_rows:
                some = batch.slice(0, rows - count)
                held.append(some)
                count, batch = count + some.num_rows, batch.slice(some.num_rows)
                if count == rows:
                    yield from flush()
        if count:
            yield from flush()

    schema = f"file string, row int, sequence_id long, n_tokens int, ids_crc32 long, cu_seqlens array<int>, doc_ids array<{kind.simpleString()}>, starts array<long>"
    return _texts(docs).mapInArrow(lean(write), schema).withColumn("file", F.concat(F.lit(into + "/"), "file"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
