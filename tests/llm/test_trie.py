"""The trie of conversations against plain Python, over whole lists of turns."""

import hashlib
import math
import random
import zlib

import pytest

from orbweave.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string, digest string, depth long, up string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, family=5, lent=8):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    key = lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).digest())
    own = {c: [x[1:] for x in sorted(turns, key=key)] for c, turns in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (lent + 1)
        built = own.get(c - int(math.fmod(c, family)), [])[:h] + turns[h:]
        for d in range(len(built) + 1):
            nodes.setdefault(tuple(built[:d]), []).append((c, d == len(built)))
    out = []
    for node, members in nodes.items():
        below = [x for x in nodes if x[: len(node)] == node]
        childless = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(nodes[x]) - 1) * (len(x[-1][1].encode()) if x else 0) for x in below)
        done = ",".join(str(c) for c, end in sorted(members) if end)
        parent = min(c for c, _ in nodes[node[:-1]]) if node else None
        children = sum(len(x) == len(node) + 1 for x in below)
        out.append((min(c for c, _ in members), len(node), parent, len(members), children, len(childless), saved, hashlib.sha256(done.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, n), 1 << 40]:
        if c % 7 == 3:
            continue  # absent ones, base conversations among them
        for turn in range(rng.randint(1, longest)):
            rows.append((c, rng.choice((turn, turn, None)), rng.choice(("user", "assistant", None, "")), rng.choice(("a", "b", "é ü", "", None, "x" * 5000)) if rng.random() < 0.8 else f"t{rng.random()}", "x", 7, None))
    rows += [rows[3], rows[3], (None, 1, "user", "no id", "x", 7, None)]
    rng.shuffle(rows)
    return rows


def found(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


@pytest.mark.parametrize("block", [2, 3, 32])
def test_every_node_as_plain_python_has_it(spark, block):
    rows = conversations(block)
    assert found(C.trie(spark.createDataFrame(rows, SCHEMA).repartition(5), block=block)) == brute(rows)


def test_long_conversations_in_small_blocks(spark):
    rows = [(c, t, "user", f"w{t if t < 40 else c * 100 + t}", "", 0, "") for c in range(0, 30, 5) for t in range(70 + c)]
    assert found(C.trie(spark.createDataFrame(rows, SCHEMA), block=4)) == brute(rows)


def test_many_that_end_in_one_node_are_joined_in_pieces(spark):
    rows = [(5 * c, 0, "user", "same", "", 0, "") for c in range(3000)]
    got = C.ends(C.prefixes(spark.createDataFrame(rows, SCHEMA)), chunk=7).collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(str(5 * c) for c in range(3000)).encode()).hexdigest()]


def test_conversations_without_turns_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "only", "", 0, "") for c in range(1, 200) if c % 5]  # no base conversation: the first turns are lost
    got = found(C.trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)


def test_nothing(spark):
    assert C.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.trie(spark.createDataFrame([(None, 1, "user", "a", "", 0, "")], SCHEMA)).count() == 0
