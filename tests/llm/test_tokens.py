import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import packing as P, token_counts as C, token_output as O, tokens as T

from .data import docs, nothing, rows


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(T.default_path())
    return [np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids, dtype="<u4") for r in rows()]


def test_word_by_word_is_as_the_tokenizer():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(T.default_path()), T.WordTokenizer(T.default_path())
    rng = random.Random(1)
    parts = ["Hello", "world.", "don't", "İstanbul", "éa", "  ", "\n", "\t", "…", "a.b,c", "12.5%", "ÀÉ!", "<|endoftext|>", "x<|", "日本語", "한국", " ", "ﬁne", "A.", "9,", "q?!", "é%%%", "the***", "a_", "()", "—", "x<|endoftext|>.", "e\u0301.", "½!", "it'", "😀", "\x1c", "'s", "re'LL"]
    for _ in range(300):
        text = rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encoded(T.folded(text.encode()).split()), dtype="<u4").tolist() == want, repr(text)


def test_a_full_table_is_emptied(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 50)
    own, whole = T.WordTokenizer(T.default_path()), T.WordTokenizer(T.default_path())
    for k in range(20):
        words = [f"word{chr(97 + j)}{chr(97 + k)}".encode() for j in range(20)] + [b"the", b"and."]
        assert own.encoded(words) == whole.encoded(words)


def test_a_smaller_table_stays_small_and_packs_alike(spark, ids):
    """As in the pipeline, where workers that remembered a million words took too much of an executor's memory."""
    import pyarrow as pa

    import corpus_pipeline

    assert corpus_pipeline.WORDS <= T.REMEMBERED // 4
    # More new words in one go than the table has room for, then many texts.
    texts = [" ".join(f"x{k}y{j}." for j in range(3000)).encode() for k in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["doc_id", "text"])
    whole = T.WordTokenizer(T.default_path())
    for names, some in T.id_batches(iter([batch]), T.default_path(), some=1, most=1000):
        assert some == [whole.encoded(texts[k].split()) for k in names]
        assert len(T.tokenizer(T.default_path(), 1000).known) <= 3000  # the table and a block's words, stems and marks
    assert Counter(P.pack(docs(spark), ids=False, words=50).collect()) == Counter(P.pack(docs(spark), ids=False).collect())


def test_histogram_answers_every_limit(spark, ids):
    histogram = C.length_histogram(docs(spark))
    lengths = np.array([len(x) for x in ids])
    for r in histogram.collect():
        at = lengths >= r.n_tokens
        assert (r.docs, r.docs_at_least, r.tokens_at_least) == ((lengths == r.n_tokens).sum(), at.sum(), lengths[at].sum())
        assert r.truncated_tokens == np.minimum(lengths, r.n_tokens).sum()
    for limit in (0, 1, 7, 100, 10**6):
        assert C.truncated_total(histogram, limit) == np.minimum(lengths, limit).sum()
    assert C.quantile(histogram, 0.5) == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert C.length_histogram(nothing(spark)).count() == 0


def test_balanced_places_every_token_and_fills_every_sequence():
    rng = random.Random(2)
    for _ in range(200):
        length = rng.choice([8, 16, 64])
        lengths = np.array([rng.randint(0, 3 * length) for _ in range(rng.randint(0, 50))], dtype=np.int64)
        placed = P.balanced(lengths, length)
        whole = [0] * len(lengths)
        for doc, start, n, _, _ in sorted(placed):
            assert start == whole[doc] and n > 0
            whole[doc] += n
        assert whole == lengths.tolist()
        fill = {}
        for _, _, n, at, offset in sorted(placed, key=lambda x: (x[3], x[4])):
            assert offset == fill.get(at, 0)
            fill[at] = offset + n
        assert all(n == length or n & (n - 1) == 0 for n in fill.values())


@pytest.mark.parametrize("seed", range(6))
def test_balanced_takes_the_cheapest_sequence_with_room(seed):
    """Against a plain search over all sequences for every piece."""
    rng = random.Random(seed)
    length, lengths = 64, [rng.randint(1, 200 if seed % 2 else 40) for _ in range(60)]
    size = P.rooms(sum(lengths), length).tolist()
    room, cost, want, waiting, full = list(size), [0.0] * len(size), [], [], 0
    for doc, n in enumerate(lengths):
        whole = n // length
        for k in range(whole):
            want.append((doc, k * length, length, full, 0))
            room[full] = 0
            full += 1
        if n % length:
            waiting.append((n % length, doc, whole * length))
    for n, doc, start in sorted(waiting, key=lambda x: (-x[0], x[1])):
        while n:
            fits = [(cost[q], q) for q in range(len(size)) if room[q] >= n]
            at = min(fits)[1] if fits else max(range(len(size)), key=lambda q: (room[q], -q))
            took = min(n, room[at])
            want.append((doc, start, took, at, size[at] - room[at]))
            room[at], cost[at] = room[at] - took, cost[at] + P.LINEAR * took + P.QUADRATIC * took * took
            start, n = start + took, n - took
    assert P.balanced(np.array(lengths), length) == want and not any(room)


def test_balanced_evens_out_costs():
    placed = P.balanced(np.array([100] * 2 + [10] * 60, dtype=np.int64), 200)
    cost = {}
    for _, _, n, at, _ in placed:
        cost[at] = cost.get(at, 0) + n + n * n / 4096
    assert max(cost.values()) / min(cost.values()) < 1.2


@pytest.mark.parametrize("window", [1 << 22, 500])
def test_pack_round_trip(spark, ids, window):
    found = P.pack(docs(spark), length=256, window=window).toPandas()
    want = sorted(np.append(x, 2).astype("<u4").tobytes() for x in ids)
    assert (found.ids.map(zlib.crc32) == found.ids_crc32).all()
    assert (found.ids.map(len) == 4 * found.length).all()
    parts = found[found.doc_id == 8].sort_values("start")
    assert b"".join(parts.ids) == np.append(ids[8], 2).astype("<u4").tobytes()
    whole = found[found.length == found.doc_tokens]
    assert set(whole.ids) <= set(want)
    assert found.length.sum() == sum(len(x) + 1 for x in ids)
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.cumsum([0, *own.length[:-1]]).tolist()
        assert own.length.sum() == 256 or own.length.sum().bit_count() == 1
    assert P.pack(nothing(spark)).count() == 0


@pytest.mark.parametrize("count", [1000, 600_000])
def test_pack_of_empty_texts(spark, count):
    """Windows end by documents where texts hold next to nothing."""
    empty = spark.range(0, count, 1, 1).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    found = P.pack(empty, ids=False) if count > 10_000 else P.pack(empty, ids=False, length=64, documents=300)
    size = 4096 if count > 10_000 else 64
    assert found.agg(F.count(F.lit(1)), F.count_distinct("doc_id"), F.sum("length")).first()[:] == (count, count, count)
    sums = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("offset").alias("end"), F.count_distinct("offset").alias("offsets")).collect()
    assert all(r.n == r.end + 1 == r.offsets and (r.n == size or r.n.bit_count() == 1) for r in sums)
    rows = O.token_matrices(empty, length=size, **({} if count > 10_000 else {"documents": 300}))
    assert rows.agg(F.sum("n_tokens"), F.sum(F.size("doc_ids"))).first()[:] == (count, count)


def test_best_fit_is_best_fit():
    rng = random.Random(4)
    for _ in range(200):
        length = rng.choice([8, 16, 64])
        lengths = [rng.randint(0, 3 * length) for _ in range(rng.randint(0, 60))]
        room, full, rests = [], 0, []
        for n in lengths:
            full += n // length
            if n % length:
                rests.append(n % length)
        for n in sorted(rests, reverse=True):
            fits = [k for k in range(len(room)) if room[k] >= n]
            if fits:
                room[min(fits, key=lambda k: room[k])] -= n
            else:
                room.append(length - n)
        found = O.best_fit(lengths, length)
        assert sorted(length - sum(n for *_, n in s) for s in found) == sorted([0] * full + room)


@pytest.mark.parametrize("window", [1 << 22, 700])
def test_matrices_round_trip(spark, ids, window):
    found = O.token_matrices(docs(spark), length=128, window=window).toPandas()
    got = {}
    for r in found.itertuples():
        row, cu = np.frombuffer(r.ids, dtype="<u2"), list(r.cu_seqlens)
        assert len(row) == 128 and cu[0] == 0 and cu[-1] == r.n_tokens and (row[r.n_tokens :] == 49407).all()
        assert np.flatnonzero(np.unpackbits(np.frombuffer(r.position_resets, dtype=np.uint8))).tolist() == cu[:-1]
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            got.setdefault(doc, []).append((start, row[cu[k] : cu[k + 1]]))
    assert sum(len(x) for parts in got.values() for _, x in parts) == sum(len(x) + 1 for x in ids)
    for k in (7, 8, 12, 20):
        parts = [x for _, x in sorted(got[k], key=lambda p: p[0])]
        assert np.array_equal(np.concatenate(parts), np.append(ids[k], 49407))
    assert O.token_matrices(nothing(spark)).count() == 0


@pytest.mark.parametrize("rows", [5, 4096])
def test_matrix_files(spark, tmp_path, rows):
    matrices = {r.sequence_id: r for r in O.token_matrices(docs(spark), length=128).collect()}
    files = O.token_files(docs(spark), str(tmp_path), length=128, rows=rows)
    told = files.collect()
    assert sorted(r.sequence_id for r in told) == sorted(matrices) and max(r.row for r in told) < rows
    for r in told:
        want = matrices[r.sequence_id]
        ids, resets, cu, many = (np.load(f"{r.file}.{x}.npy") for x in ("ids", "resets", "cu_seqlens", "rows"))
        start = int(many[: r.row].sum())
        assert ids[r.row].tobytes() == bytes(want.ids) and zlib.crc32(bytes(want.ids)) == r.ids_crc32 and resets[r.row].tobytes() == bytes(want.position_resets)
        assert cu[start : start + many[r.row]].tolist() == list(want.cu_seqlens) == list(r.cu_seqlens) and (r.doc_ids, r.starts, r.n_tokens) == (want.doc_ids, want.starts, want.n_tokens)
    once = sorted(x.name for x in next(tmp_path.iterdir()).iterdir())
    assert sorted(map(str, files.collect())) == sorted(map(str, told)) and sorted(x.name for x in next(tmp_path.iterdir()).iterdir()) == once  # written again alike
    assert len(once) == 4 * len({r.file for r in told}) and O.token_files(nothing(spark), str(tmp_path)).count() == 0
