"""Hard negatives against all pairs in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, panel string, k int, cells string"


def brute(rows, positives=5, negatives=3):
    own = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label, *_ in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    inner = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for i, label, a in own:
        if i % 50:
            continue
        scored = [(-inner(a, v), j, other) for j, other, v in own]
        for s, p, _ in sorted(x for x in scored if x[2] == label and x[1] != i)[:positives]:
            fine = sorted(x for x in scored if x[2] != label and 50 * -s <= -100 * x[0] <= 95 * -s)[:negatives]
            out += [(i, p, r + 1, n, -s, -m) for r, (m, n, _) in enumerate(fine)]
    return sorted(out)


def vectors(seed, n=400, d=7, labels=3):
    rng = random.Random(seed)
    centre = {k: [rng.gauss(0, 1) for _ in range(d)] for k in range(labels)}
    rows = []
    for i in range(n):
        label = 0 if i % 3 == 0 else rng.randrange(labels)
        v = [float(np.float32(x + rng.gauss(0, 0.8))) for x in centre[label]]
        if i % 17 == 0:
            v = v[: rng.randrange(d)]
        rows.append((i, v, label, "x", 1, "c"))
    rows += [rows[10], rows[10], rows[50], rows[60]]  # repeated rows, an anchor among them
    rows += [(None, rows[1][1], 0, "", 0, ""), (900, None, 1, "", 0, ""), (950, [1.0, None], 1, "", 0, ""), (1000, [float("nan")], 1, "", 0, ""), (1050, [float("inf")] * 7, 1, "", 0, ""), (1100, rows[2][1], None, "", 0, "")]
    rows += [(1150, [], 0, "", 0, ""), (1200, [0.0] * d, 1, "", 0, ""), (1201, rows[3][1] * 3, 2, "", 0, "")]
    rng.shuffle(rows)
    return rows


def found(spark, rows, **sizes):
    own = H.usable(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("label"))
    return sorted(tuple(r) for r in H.mine(own, own.filter(F.col("vec_id") % 50 == 0), **sizes).collect())


@pytest.mark.parametrize("sizes", [{}, {"size": 20, "few": 3, "depth": 2}, {"size": 7, "few": 100, "depth": 5}])
def test_as_all_pairs(spark, sizes):
    rows = vectors(len(sizes))
    want = brute(rows)
    assert len(want) > 30 and found(spark, rows, **sizes) == want


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 1.0], 0, "", 0, "") for i in range(40, 60)] + [(i, [0.7, 0.7], 1, "", 0, "") for i in range(100, 149)]
    got = found(spark, rows, size=4, few=2, depth=1)
    assert [r[1] for r in got if r[2] == 1] == [40, 41, 42, 43, 44] and {r[3] for r in got} == {100, 101, 102} and got == brute(rows)


def test_large_components_stay_exact():
    a = np.array([[1 << 31, -(1 << 30)]], dtype=np.int64)
    assert H.product(a, a)[0, 0] == (1 << 62) + (1 << 60) and (H.unpacked(H.packed(a), 2) == a).all()


def test_one_label_or_nothing(spark):
    assert found(spark, [(50 * i, [1.0], 3, "", 0, "") for i in range(9)]) == []
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0], 3, "", 0, "")]) == []


def test_a_label_of_most_rows_is_cut_into_panels(spark):
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("vec_id"), F.lit(0).alias("label"), F.array(F.lit(5).cast("long")).alias("v"))
    made = H.panels(rows, 100).select("panel", F.length("ids").alias("n")).collect()
    assert sum(r.n for r in made) == 40_000 and max(r.n for r in made) <= 800
