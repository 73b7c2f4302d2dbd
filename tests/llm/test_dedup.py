import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orbweave.llm import exact_dedup as E, simhash as S
from orbweave.llm.components import stars

from .data import docs, nothing, rows


def groups(labels):
    out = {}
    for k, x in enumerate(labels):
        out.setdefault(x, []).append(k)
    return sorted(map(tuple, out.values()))


def brute_components(fps, errors):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= errors
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def flipped(rng, bases, each, bits):
    out = []
    for b in rng.integers(0, 2**64, size=bases, dtype=np.uint64):
        for _ in range(each):
            x = int(b)
            for bit in rng.integers(0, 64, size=rng.integers(0, bits)):
                x ^= 1 << int(bit)
            out.append(x)
    return np.unique(np.array(out, dtype=np.uint64))


def fingerprint(text, words=4):
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    shingles = [b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))]
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


@pytest.mark.parametrize("hashed", [E.content_hash, lambda c: F.substring(F.md5(c.cast("binary")), 1, 1).cast("binary")])
def test_exact_classes(spark, hashed):
    found = E.exact_classes(docs(spark), hashed).toPandas()
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows()]
    want = {}
    for r, t in zip(rows(), norm, strict=True):
        ids = [x[0] for x, y in zip(rows(), norm, strict=True) if y == t]
        known = [i for i in ids if i is not None]
        want.setdefault((r[0], hashlib.sha256(t.encode()).hexdigest()), []).append((min(known) if known else None, len(ids)))
    assert len(found) == len(rows())
    for r in found.itertuples():
        key = (None if r.doc_id != r.doc_id else int(r.doc_id), r.text_sha256)
        keep, size = want[key][0]
        assert (None if r.keep_id != r.keep_id else int(r.keep_id)) == keep and r.group_size == size and r.kept == (key[0] == keep)


def test_exact_stage_keeps_one_row_and_all_columns(spark):
    source = docs(spark)
    kept = E.drop_exact_copies(source)
    assert kept.columns == source.columns
    texts = [re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows()})


def test_exact_of_nothing(spark):
    assert E.exact_classes(nothing(spark)).count() == 0
    assert E.drop_exact_copies(nothing(spark)).count() == 0


def test_fingerprints(spark):
    found = S.fingerprints(docs(spark)).collect()
    assert [int(np.int64(r.fp).view(np.uint64)) for r in found] == [fingerprint(r[1]) for r in rows()]


@pytest.mark.parametrize("errors", [0, 1, 3, 4, 6])
def test_every_link_is_in_some_rotation(errors):
    fps = flipped(np.random.default_rng(errors), 4, 60, 9)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sizes = S.blocks(errors)
    for r in range(errors + 1):
        b = sum(sizes[:r])
        turned = fps if not b else (fps << np.uint64(b)) | (fps >> np.uint64(64 - b))
        order = np.argsort(turned)
        for k, label in enumerate(S.walk(turned[order], np.array([0, len(fps)]), np.full(len(fps), r), errors)):
            a, c = find(order[k]), find(order[label])
            parent[max(a, c)] = min(a, c)
    assert [find(k) for k in range(len(fps))] == brute_components(fps, errors)


@pytest.mark.parametrize("leaf", [1024, 16])
def test_linked_with_and_without_split_subtries(spark, leaf, monkeypatch):
    monkeypatch.setattr(S, "LEAF", leaf)
    fps = flipped(np.random.default_rng(leaf), 3, 80, 8)
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in fps], "fp long")
    root = {r.node: r.root for r in stars(S.linked(df, 4)).collect()}
    labels = [root.get(int(x.view(np.int64)), int(x.view(np.int64))) for x in fps]
    assert groups(labels) == groups(brute_components(fps, 4))


def test_near_duplicates(spark):
    found = S.near_duplicates(docs(spark)).collect()
    fps = np.array([fingerprint(r[1]) for r in rows()], dtype=np.uint64)
    labels = brute_components(fps, 4)
    least = {}
    for r, label in zip(rows(), labels, strict=True):
        if r[0] is not None:
            least[label] = min(least.get(label, r[0]), r[0])
    want = sorted((str(r[0]), f"{int(f):016x}", least.get(label)) for r, f, label in zip(rows(), fps, labels, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == want


def test_near_of_nothing(spark):
    assert S.near_duplicates(nothing(spark)).count() == 0


def test_stars_of_a_long_chain(spark):
    ids = list(range(200))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "u long, v long")
    assert {(r.node, r.root) for r in stars(edges).collect()} == {(k, 0) for k in range(1, 200)}
