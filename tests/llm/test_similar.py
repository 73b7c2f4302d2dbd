import random

import numpy as np
import pytest

from orbweave.llm import similar as J, simhash as S
from orbweave.llm.components import stars
from orbweave.llm.simhash import fingerprint

from .data import docs, nothing, rows


def shingles(text):
    own = (text or "").encode().lower().split()
    return {b" ".join(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def brute(data, errors=10, prints=3):
    """The smallest id of each row's group."""
    own, label = [shingles(x[1]) for x in data], list(range(len(data)))
    fps = [np.array(J.majorities(J.shingles((x[1] or "").encode()), prints)) for x in data]
    for j in range(len(data)):
        for i in range(j):
            near = (np.bitwise_count((fps[i] ^ fps[j]).view(np.uint64)) <= errors).any()
            if own[i] == own[j] or near and 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for x, k in zip(data, label, strict=True):
        if x[0] is not None:
            least[k] = min(least.get(k, x[0]), x[0])
    return [least.get(k) for k in label]


def invented(seed=4):
    """Groups of edited texts, chains of edits, and texts about a common passage."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out, passage = [], text(40)
    for n in (6, 12, 40, 200):
        base = text(n)
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                own[rng.randrange(n)] = "edited"
            out.append(own)
        for k in range(10):  # each step alike, the ends not
            base = base[max(1, n // 20) :] + text(max(1, n // 20))
            out.append(base)
    out += [passage + text(rng.randint(1, 60)) for _ in range(60)]
    return [(k, " ".join(x)) for k, x in enumerate(out)]


def groups(spark, data, **parameters):
    found = S.similar_groups(spark.createDataFrame([x[:2] for x in data], "doc_id long, text string").repartition(3), **parameters).collect()
    return sorted((str(r.doc_id), str(r.component_id)) for r in found)


@pytest.mark.parametrize("errors, prints, leaf, many", [(6, 2, 16, 1)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, errors, prints, leaf, many):
    monkeypatch.setattr(S, "LEAF", leaf)
    monkeypatch.setattr(S, "MANY", many)
    data = invented() + [(1000 + x[0] if x[0] is not None else None, x[1]) for x in rows()]
    want = brute(data, errors, prints)
    assert groups(spark, data, errors=errors, prints=prints) == sorted((str(x[0]), str(k)) for x, k in zip(data, want, strict=True))
    assert len(set(want)) < len(data) - 40


def test_wide_budget_finds_nearly_all_similar_pairs():
    rng = random.Random(11)
    found = pairs = 0
    for _ in range(400):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(base)
        for _ in range(rng.randint(1, 4)):
            other[rng.randrange(200)] = "edited"
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        if 5 * len(a & b) >= 4 * len(a | b):
            pairs += 1
            x, y = (np.array(J.majorities(J.shingles(" ".join(t).encode()), 3)) for t in (base, other))
            found += (np.bitwise_count((x ^ y).view(np.uint64)) <= 10).any()
    assert pairs > 300 and found / pairs > 0.97


def test_further_fingerprints_are_majorities_too():
    own = J.shingles(b"one two three four five six seven eight")
    first, second = J.majorities(own, 2)
    assert first != second and np.int64(first).view(np.uint64) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in own) > len(own))


@pytest.mark.parametrize("errors", [3, 10])
def test_all_pairs_within_the_budget(errors):
    rng = np.random.default_rng(errors)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (errors // 2 + 1, 12)).astype(np.uint64), axis=0) for _ in range(20)]))
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= errors}
    found, sizes = set(), S.blocks(errors)
    for r in range(errors + 1):
        b = np.uint64(sum(sizes[:r]))
        turned = (values << b) | (values >> (np.uint64(64) - b)) if b else values
        order = np.argsort(turned)
        for i, j in S.near(turned[order], np.array([0, len(values)]), np.full(len(values), r), errors):
            found |= {(min(x, y), max(x, y)) for x, y in zip(order[i].tolist(), order[j].tolist(), strict=True)}
    assert found == want and len(want) > 200


def test_pipeline_drops_near_copies_that_differ_in_more_than_four_bits(spark):
    import corpus_pipeline

    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    near = [*base[:60], "edited", *base[61:]]  # 111 of 121 shingles
    assert 5 * len(shingles(" ".join(base)) & shingles(" ".join(near))) >= 4 * len(shingles(" ".join(base)) | shingles(" ".join(near)))
    assert (fingerprint(" ".join(base).encode()) ^ fingerprint(" ".join(near).encode())).bit_count() > 4
    df = spark.createDataFrame([(7, " ".join(base)), (9, " ".join(near)), (11, "another text")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()) == [7, 11]


def test_stage_keeps_columns(spark):
    kept = S.drop_near_copies(docs(spark))
    assert kept.columns == docs(spark).columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {k for k in brute(rows()) if k is not None}
    assert S.drop_near_copies(nothing(spark)).count() == 0


def test_rarest_shingles_name_all_similar_pairs_and_few_of_a_crowd(spark):
    rng = random.Random(21)
    out = [x[1] for x in invented(9)]
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    crowd = []  # texts about one passage, each with too much of its own
    for k in range(300):
        own = list(base)
        for i in range(5):
            own[rng.randrange(30 * i, 30 * i + 30)] = f"own{k}.{i}"
        crowd.append(" ".join(own))
    sets_ = {J._key(x): x for x in (J.shingles(t.encode()) for t in out + crowd)}
    rows_ = [(key, bytearray(x.tobytes()), 7, key) for key, x in sets_.items()]
    found = {(r.a, r.b) for r in J.sharing(spark.createDataFrame(rows_, "key long, own binary, reach long, of long").repartition(3), (4, 5)).collect()}
    keys, want, similar = sorted(sets_), set(), lambda x, y, both: 5 * both >= 4 * (len(x) + len(y) - both)
    for j, b in enumerate(keys):
        want |= {(a, b) for a in keys[:j] if similar(sets_[a], sets_[b], len(np.intersect1d(sets_[a], sets_[b], assume_unique=True)))}
    assert want <= found and len(want) > 50
    of_crowd = {J._key(J.shingles(t.encode())) for t in crowd}
    assert sum(a in of_crowd and b in of_crowd for a, b in found - want) < 3000  # of 44,850


def test_a_crowd_is_not_paired_with_itself(spark, monkeypatch):
    named, real = [], S.confirmed

    def counted(pairs, *more):
        named.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(S, "confirmed", counted)
    rng = random.Random(22)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    data = []
    for k in range(240):  # each shares with each nearly what it must
        own = list(base)
        for i in range(4):
            own[rng.randrange(75 * i, 75 * i + 70)] = f"own{k}.{i}"
        data.append((k, " ".join(own)))
    assert groups(spark, data) == sorted((str(x[0]), str(k)) for x, k in zip(data, brute(data), strict=True))
    assert named[-1] < 3000, named


def test_a_crowd_of_near_copies_is_held_against_hubs(spark):
    rng = random.Random(23)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = set()
    while len(texts) < 500:  # about half of all pairs are similar
        own = list(base)
        for i in rng.sample(range(12), rng.randint(1, 3)):
            own[12 * i + 4 + rng.randrange(2)] = f"edited{rng.randrange(3)}"
        texts.add(" ".join(own))
    sets_ = {J._key(x): x for x in (J.shingles(t.encode()) for t in sorted(texts))}
    keys, both = sorted(sets_), lambda a, b: len(np.intersect1d(sets_[a], sets_[b], assume_unique=True))
    similar = lambda a, b: 5 * (k := both(a, b)) >= 4 * (len(sets_[a]) + len(sets_[b]) - k)
    named, links = [], []

    def joined(pairs):
        found = [(r.a, r.b) for r in pairs.collect()]
        named.append(len(found))
        links.extend(p for p in found if similar(*p))
        return stars(spark.createDataFrame(links, "u long, v long"))

    def roots(links):
        label = {k: k for k in keys}
        for a, b in links:
            x, y = sorted((label[a], label[b]))
            label |= {k: x for k, v in label.items() if v == y}
        return label

    rows_ = spark.createDataFrame([(key, bytearray(x.tobytes()), 7, key) for key, x in sets_.items()], "key long, own binary, reach long, of long").repartition(3)
    whole = [(r.a, r.b) for r in J.sharing(rows_, (4, 5)).collect()]
    joined(J.sharing(rows_, (4, 5), joined))
    assert roots(links) == roots(p for p in whole if similar(*p)) and len(set(roots(links).values())) < 20
    assert len(named) > 1 and 4 * sum(named) < len(whole) > 20_000, (named, len(whole))


@pytest.mark.parametrize("edges", [[], [(k, k + 1) for k in range(200)], [(9, 2), (2, 9), (4, 4), (-5, 9), (7, 8), (-(2**63), 2**63 - 1)]])
def test_stars_in_one_task_are_the_same(spark, edges):
    random.Random(5).shuffle(edges)
    table = spark.createDataFrame(edges, "u long, v long").repartition(3)
    one, many = (sorted(tuple(r) for r in stars(table, alone).collect()) for alone in (1000, 0))
    assert one == many and len(one) == len({x for e in edges for x in e if e[0] != e[1]}) - len({b for _, b in one})
