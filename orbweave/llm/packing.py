"""Cost-balanced packing of documents into sequences.

Attention over a piece of n tokens costs LINEAR * n + QUADRATIC * n * n. Each task reads its part of the documents once
and packs a window of at most WINDOW tokens (and the document that passes it) and DOCUMENTS documents at a time, so memory is bounded and nothing
is shuffled. Texts of more than a sequence are cut into full sequences and a rest; then pieces, longest first, go to the sequence of
lowest cost that still holds them whole. A piece that none holds is cut at the largest room left. The sequences of a window
are as many full ones as its tokens fill, and what is over is dealt to sequences of powers of two, so no sequence is padded.

Null texts are empty and consist of the closing id alone; repeated rows are packed each; an empty table gives no rows.
Sequence ids are unique but leave gaps: partition and place in it. The same input splits give the same result, so a lost task is repeated alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import lean, table
from .tokens import default_path, id_batches

LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Tokens of a window, and documents, which bound it where texts are empty or nearly so.
WINDOW, DOCUMENTS = 1 << 22, 1 << 18


def rooms(tokens: int, length: int) -> np.ndarray:
    """Full sequences and powers of two that hold just these tokens."""
    full, rest = divmod(tokens, length)
    return np.array([length] * full + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1], dtype=np.int64)


def balanced(lengths: np.ndarray, length: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every token is in one piece and every sequence is full."""
    size = rooms(int(lengths.sum()), length)
    room, cost = size.copy(), np.zeros(len(size))
    out: list[tuple[int, int, int, int, int]] = []
    waiting = []
    following = 0

    def put(doc: int, start: int, n: int, at: int) -> None:
        out.append((doc, start, n, at, int(size[at] - room[at])))
        room[at] -= n
        cost[at] = cost[at] + linear * n + quadratic * n * n if room[at] else np.inf

    for doc, n in enumerate(lengths.tolist()):
        start = 0
        while n - start >= length:
            put(doc, start, length, following)
            following, start = following + 1, start + length
        if n > start:
            waiting.append((n - start, doc, start))
    waiting.sort(key=lambda x: (-x[0], x[1]))
    for n, doc, start in waiting:
        while n:
            fits = np.where(room >= n, cost, np.inf)
            at = int(fits.argmin())
            took = n
            if not np.isfinite(fits[at]):
                at = int(room.argmax())
                took = min(n, int(room[at]))
            put(doc, start, took, at)
            start, n = start + took, n - took
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = 4096, closing: int = 2, window: int = WINDOW, ids: bool = True, documents: int = DOCUMENTS, words: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (little-endian unsigned 32-bit). words: how many a worker remembers (None: as many as tokens does)."""
    import pyarrow as pa

    path = path or default_path()
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if ids else "")
    names_of = [x.split()[0] for x in schema.split(", ")]
    end = np.array([closing], dtype="<u4").tobytes()

    def packed(batches: Iterator) -> Iterator:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        context = TaskContext.get()
        following, held, names, texts = (context.partitionId() if context else 0) << 40, 0, [], []

        def flush() -> Iterator:
            nonlocal following, held, names, texts
            placed = balanced(np.array([len(x) // 4 for x in texts], dtype=np.int64), length)
            placed.sort(key=lambda x: (x[3], x[4]))
            for at in range(0, len(placed), 2000):
                part = placed[at : at + 2000]
                own = [texts[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in part]
                columns = [pa.array([names[d] for d, *_ in part], to_arrow_type(kind)), *[pa.array(x, pa.int64()) for x in (
                    [s for _, s, *_ in part], [n for _, _, n, *_ in part], [zlib.crc32(x) for x in own], [len(texts[d]) // 4 for d, *_ in part],
                    [following + q for *_, q, _ in part], [o for *_, o in part],
                )], *([pa.array(own, pa.binary())] if ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names_of)
            following, held, names, texts = following + max((x[3] for x in placed), default=-1) + 1, 0, [], []

        for some, encoded in id_batches(batches, path, most=words):
            for name, x in zip(some, encoded, strict=True):
                names.append(name)
                texts.append(x + end)
                held += len(x) // 4 + 1
                if held >= window or len(names) >= documents:
                    yield from flush()
        if names:
            yield from flush()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(packed), schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), ids=False)
