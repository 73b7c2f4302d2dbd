"""Interpolated modified Kneser-Ney trigram model, counted by Spark and memory-mapped by the workers that score.

Counting takes two passes. The first gives every word a number: its place among all words in the order of their 64-bit hashes. The second counts
triples of numbers, each a context (the two words before) and a word. Tasks count blocks of tokens and send each shard its sorted contexts, words and counts in packed form (differences, byte planes); a shard
sums what all tasks sent and writes sorted arrays into the shared folder: contexts, where their words begin, words and counts. Two smaller exchanges count what the lower orders need: for each pair how many
different words precede it, for each word how many pairs end in it. Shards are chosen by hash and their
number follows the input, so neither a frequent word nor a larger corpus makes one of them large. Scoring maps the arrays, at most MAPS at a time, and searches the sorted keys of a
block at a time.

Words are runs without ASCII white space, ASCII letters in lower case; every text ends with an end token and begins after two begin marks, which are never predicted. Null texts are empty: the end token alone.
Words whose 64-bit hashes are equal count as one word. Repeated rows count and are scored each. Without training tokens both scores are 0. The arrays need a folder that all executors mount, by default spark.checkpoint.dir.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_mod, lean, mounted, remembered, table

#: Tokens of a block, and bytes of training text per shard.
BLOCK, SHARD = 1 << 22, 1 << 24
#: Tokens that are scored together: their contexts are held for all orders.
SCORED = 1 << 19
#: Words of a range in the last exchange, and parts that are summed at once there.
RANGE, PARTS = 1 << 16, 64
#: Arrays that a worker maps at a time, and words after a context from which on their sums are stored.
MAPS, LONG = 4096, 64
END = b""


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def blocks(batches: Iterator, limit: int = BLOCK) -> Iterator[tuple[list, list[bytes], np.ndarray, np.ndarray]]:
    """From (doc_id, text as binary): ids of documents, distinct words, all tokens by place among them, where each document begins."""
    names, numbers, parts, held = [], _Numbers(), [], 0
    for batch in batches:
        texts = batch.column(1)
        for k, name in enumerate(batch.column(0).to_pylist()):
            own = (texts[k].as_py() or b"").lower().split()
            parts.append(np.fromiter(map(numbers.__getitem__, chain(own, (END,))), dtype=np.int32, count=len(own) + 1))
            names.append(name)
            held += len(own) + 1
            if held >= limit:
                yield names, list(numbers), np.concatenate(parts), np.cumsum([0] + [len(x) for x in parts[:-1]])
                names, numbers, parts, held = [], _Numbers(), [], 0
    if names:
        yield names, list(numbers), np.concatenate(parts), np.cumsum([0] + [len(x) for x in parts[:-1]])


def hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), dtype="<u8", count=len(words))


def packed(keys: np.ndarray, *values: np.ndarray) -> list[bytes]:
    """Sorted keys as differences, and counts, each in byte planes and compressed: Spark's own compression has no code for skewed bytes."""
    from zstandard import ZstdCompressor

    out, squeeze = [np.diff(keys, prepend=keys.dtype.type(0)), *values], ZstdCompressor(level=1)
    return [squeeze.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()) for x in out]


def unpacked(raw: bytes, dtype: str) -> np.ndarray:
    from zstandard import ZstdDecompressor

    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(width, -1).T).view(dtype).ravel()


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct sorted keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return [keys[first], *[np.add.reduceat(v[order], first) if len(keys) else v for v in values]]


def _keys(column) -> np.ndarray:
    return np.concatenate([np.cumsum(unpacked(x, "<u8"), dtype="<u8") for x in column.to_pylist()])


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """A file appears whole or not at all, so a repeated task does no harm."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{folder}/{name}.npy")


def mixed(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a key: high bits of a multiplicative hash."""
    if shards == 1:
        return np.zeros(len(keys), dtype=np.int64)
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64)


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each shard that occurs, in their order."""
    least = np.min_scalar_type(int(shard.max(initial=0)))  # two bytes or one are sorted by radix
    order = np.argsort(shard.astype(least), kind="stable")
    if len(order):
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for places in np.split(order, cuts):
            yield int(shard[places[0]]), places


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of things counted once to four times; middle values where these can't tell."""
    if min(n[:3]) <= 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [float(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05)) for k in (1, 2, 3)]


def counted(context: np.ndarray, now: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) in sorted order and how often each occurs."""
    if not len(now):
        return context, now, np.zeros(0, dtype=np.int64) if times is None else times
    # Contexts are sorted first; a context's place among the distinct ones and a word fit one key, so words are sorted within contexts by whole numbers.
    order = np.argsort(context, kind="quicksort" if times is None else "stable")  # what tasks sent is sorted in runs
    context = context[order]
    keys = np.zeros(len(context), dtype="<u8")
    np.cumsum(context[1:] != context[:-1], out=keys[1:])
    keys = (keys << np.uint64(32)) | now[order]
    if times is None:
        keys.sort()
    else:
        within = np.argsort(keys, kind="stable")
        keys, times = keys[within], times[order[within]]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.diff(np.append(first, len(keys))) if times is None else np.add.reduceat(times, first)
    return context[first], (keys[first] & np.uint64(0xFFFFFFFF)).astype(now.dtype), n


#: Counts from here on are stored apart, so that the others take a byte.
MUCH = 255
#: Contexts whose words' places are told from one place.
STRETCH = 64


def stretched(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising places as those of every STRETCH-th and how far each lies from that of its stretch, in the least type that holds these."""
    bases = places[::STRETCH]
    rest = places - np.repeat(bases, STRETCH)[: len(places)]
    return bases.astype("<i8"), rest.astype(np.min_scalar_type(int(rest.max(initial=0))))


def kinds(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[group, 4]: sum of the counts, and how many are one, two and more."""
    if not len(starts):
        return np.zeros((0, 4), dtype=np.int64)
    return np.stack([np.add.reduceat(x, starts) for x in (counts.astype(np.int64), *[(np.minimum(counts, 3) == k).astype(np.int64) for k in (1, 2, 3)])], axis=1)


def bisected(array: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Where each want stands between lo and hi of a sorted stretch of array; -1 if it doesn't."""
    end, live = hi, np.flatnonzero(lo < hi)
    lo, hi = lo.copy(), hi.copy()
    while len(live):
        middle = (lo[live] + hi[live]) >> 1
        less = array[middle] < want[live]
        lo[live[less]], hi[live[~less]] = middle[less] + 1, middle[~less]
        live = live[lo[live] < hi[live]]
    there = lo < end
    there[there] = array[lo[there]] == want[there]
    return np.where(there, lo, -1)


class Model:
    """What the driver knows of a model; workers map the arrays in its folder."""

    def __init__(self, folder: str, shards: int, width: int = RANGE):
        self.folder, self.shards, self.width = folder, shards, width
        self.starts: list[int] = []
        self.tokens = self.words = self.types = 0
        self.triple_discounts = self.pair_discounts = self.word_discounts = [0.5, 1.0, 1.5]
        self.floor = 1.0
        self.maps, self.long = MAPS, LONG

    def mapped(self, name: str) -> np.ndarray:
        key, maps = f"{self.folder}/{name}", remembered("language_model").setdefault("maps", OrderedDict())
        if key not in maps:
            maps[key] = np.load(f"{key}.npy", mmap_mode="r").view(np.ndarray)  # a memmap would check each result of an index
            while len(maps) > self.maps:
                maps.popitem(last=False)
        maps.move_to_end(key)
        return maps[key]

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each word; unknown: -1 and 0."""
        own = hashes(words)
        number, count = np.full(len(own), -1, dtype=np.int64), np.zeros(len(own), dtype=np.int64)
        shard = (own >> np.uint64(65 - self.shards.bit_length())).astype(np.int64) if self.shards > 1 else np.zeros(len(own), dtype=np.int64)
        for s, places in by_shard(shard):
            if self.starts[s + 1] == self.starts[s]:
                continue
            keys = self.mapped(f"words-{s}")
            places = places[np.argsort(own[places])]
            at = np.minimum(np.searchsorted(keys, own[places]), len(keys) - 1)
            known = keys[at] == own[places]
            number[places[known]] = at[known] + self.starts[s]
            count[places[known]] = self.mapped(f"counts-{s}")[at[known]]
        return number, count

    def times(self, order: str, s: int, at: np.ndarray) -> np.ndarray:
        """Counts at places of a shard."""
        out = self.mapped(f"{order}-times-{s}")[at].astype(np.int64)
        much = np.flatnonzero(out == MUCH)
        if len(much):
            out[much] = self.mapped(f"{order}-most-{s}")[np.searchsorted(self.mapped(f"{order}-much-{s}"), at[much])]
        return out

    def before(self, number: np.ndarray) -> np.ndarray:
        """How many pairs end in each word (-1: none)."""
        out = np.zeros(len(number), dtype=np.int64)
        known = np.flatnonzero(number >= 0)
        for r, places in by_shard(number[known] // self.width):
            if os.path.exists(f"{self.folder}/before-{r}.npy"):
                out[known[places]] = self.mapped(f"before-{r}")[number[known[places]] % self.width]
        return out

    def explained(self, order: str, contexts: np.ndarray, of: np.ndarray, now: np.ndarray, lower: np.ndarray, weights: list[float]) -> np.ndarray:
        """The probability at one order (pairs or triples) of the words now (-1: unknown) after contexts[of], given those of the order below. contexts: distinct and sorted."""
        lo, hi = np.zeros(len(contexts), dtype=np.int64), np.zeros(len(contexts), dtype=np.int64)
        sums = np.zeros((len(contexts), 4), dtype=np.int64)
        shards = mixed(contexts, self.shards)
        for s, places in by_shard(shards):
            if not os.path.exists(f"{self.folder}/{order}-heads-{s}.npy"):
                continue
            heads, bases, begins = (self.mapped(f"{order}-{x}-{s}") for x in ("heads", "bases", "begins"))
            own = contexts[places].astype(heads.dtype)  # another type would have all heads converted
            at = np.minimum(np.searchsorted(heads, own), len(heads) - 1)
            known = heads[at] == own
            at, places = at[known], places[known]
            lo[places], hi[places] = (bases[x // STRETCH] + begins[x] for x in (at, at + 1))
            large = hi[places] - lo[places] >= self.long
            sums[places[large]] = self.mapped(f"{order}-sums-{s}")[np.searchsorted(self.mapped(f"{order}-long-{s}"), at[large])]
            few = places[~large]
            if len(few):
                n = hi[few] - lo[few]
                starts = np.cumsum(n) - n
                sums[few] = kinds(self.times(order, s, np.repeat(lo[few] - starts, n) + np.arange(int(n.sum()))), starts)
        p, some = lower.copy(), np.flatnonzero(sums[of, 0] > 0)
        rest = (sums[:, 1:] @ np.array(weights)) / np.maximum(sums[:, 0], 1)
        p[some] *= rest[of[some]]
        seen = some[now[some] >= 0]
        keys, back = np.unique((of[seen].astype("<u8") << np.uint64(32)) | now[seen].astype("<u8"), return_inverse=True)
        which, want = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        count = np.zeros(len(keys), dtype=np.int64)
        for s, places in by_shard(shards[which]):
            at = bisected(self.mapped(f"{order}-words-{s}"), lo[which[places]], hi[which[places]], want[places])
            count[places[at >= 0]] = self.times(order, s, at[at >= 0])
        more = np.where(count > 0, count - np.array([0.0, *weights])[np.minimum(count, 3)], 0) / np.maximum(sums[which, 0], 1)
        p[seen] += more[back]
        return p

    def log10(self, words: list[bytes], tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: log10 probability by the model, by the base, and whether training has it."""
        number, count = self.numbers(words)
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))
        single = np.full(len(words), self.floor)
        if self.types:
            seen = self.before(number)
            single += np.where(seen > 0, seen - np.array([0.0, *self.word_discounts])[np.minimum(seen, 3)], 0) / self.types
        now, p = number[tokens], single[tokens]
        one = contexts(now, begins, self.words)
        two = contexts(one, begins, self.words)
        for order, weights, at, key in (("pairs", self.pair_discounts, one >= 0, one), ("triples", self.triple_discounts, (one >= 0) & (two >= 0), (two << 32) | one)):
            some = np.flatnonzero(at)
            found, of = np.unique(key[some].astype("<u8"), return_inverse=True)
            p[some] = self.explained(order, found, of, now[some], p[some], weights)
        return np.log10(p), base[tokens], count[tokens] > 0


def contexts(numbers: np.ndarray, begins: np.ndarray, begin: int) -> np.ndarray:
    """The number before each; at the begin of a document the number `begin`."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[begins] = begin
    return before


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def train(docs: DataFrame, folder: str | None = None, shard: int = SHARD, block: int = BLOCK, width: int = RANGE) -> Model:
    """docs: doc_id, text. The number of words of each shard and three rows of totals reach the driver."""
    import pyarrow as pa

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = Model(mounted(docs.sparkSession, folder, "lm"), 1 << int(size // shard).bit_length(), width)
    shards, path = model.shards, model.folder

    def words(batches: Iterator) -> Iterator:
        for _, own, tokens, _ in blocks(batches, block):
            keys, counts = hashes(own), np.bincount(tokens, minlength=len(own)).astype("<u4")
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            shard = (keys >> np.uint64(65 - shards.bit_length())).astype(np.int64) if shards > 1 else np.zeros(len(keys), dtype=np.int64)
            rows = [(s, *packed(keys[at], counts[at])) for s, at in by_shard(shard)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)]], ["shard", "keys", "counts"])

    def merge_words(group: pa.Table) -> pa.Table:
        s = group.column("shard")[0].as_py()
        counts = np.concatenate([unpacked(x, "<u4") for x in group.column("counts").to_pylist()]).astype("<i8")
        keys, counts = summed(_keys(group.column("keys")), counts)
        _save(path, f"words-{s}", keys)
        _save(path, f"counts-{s}", counts.astype("<u4") if counts.max(initial=0) < 1 << 32 else counts)
        return pa.table({"shard": pa.array([s], pa.int32()), "n": [len(keys)], "tokens": [int(counts.sum())]})

    found = _texts(docs).mapInArrow(lean(words), "shard int, keys binary, counts binary").groupBy("shard").applyInArrow(merge_words, "shard int, n long, tokens long").collect()
    sizes = {r["shard"]: r["n"] for r in found}
    model.starts = np.concatenate([[0], np.cumsum([sizes.get(s, 0) for s in range(shards)])]).tolist()
    model.words, model.tokens = model.starts[-1], sum(r["tokens"] for r in found)
    if not model.tokens:
        return model

    def triples(batches: Iterator) -> Iterator:
        for _, own, tokens, begins in blocks(batches, block):
            now = model.numbers(own)[0][tokens]
            one = contexts(now, begins, model.words)
            context, now, times = counted(((contexts(one, begins, model.words) << 32) | one).astype("<u8"), now.astype("<u4"))
            rows = [(s, *packed(context[at], now[at], times[at].astype("<u4"))) for s, at in by_shard(mixed(context, shards))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)]], ["shard", "keys", "now", "counts"])

    def save_order(order: str, s: int, context: np.ndarray, now: np.ndarray, times: np.ndarray) -> None:
        """The sorted arrays of a shard: contexts, where each one's words begin, the words, their counts, and sums of the contexts of many words."""
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        begins = np.append(starts, len(context))
        large = np.flatnonzero(np.diff(begins) >= model.long)
        sums, much = kinds(times, starts)[large], np.flatnonzero(times >= MUCH)
        bases, places = stretched(begins)
        heads = context[starts].astype("<u4" if order == "pairs" else "<u8")  # the number of a word, or of two
        for name, x in (("heads", heads), ("bases", bases), ("begins", places), ("words", now.astype("<u4")), ("times", np.minimum(times, MUCH).astype("u1")), ("much", much), ("most", times[much]), ("long", large.astype("<u4")), ("sums", sums)):
            _save(path, f"{order}-{name}-{s}", x)

    def table_of(rows: list[tuple]) -> pa.Table:
        """Rows of what, to (a shard or range), part, keys, counts, once: how many are counted one to four times."""
        kinds_ = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds_)], names=["what", "to", "part", "keys", "counts", "once"])

    def once_of(counts: np.ndarray) -> list[int]:
        return [int((counts == k).sum()) for k in (1, 2, 3, 4)]

    def counts_in(group: pa.Table) -> np.ndarray:
        return np.concatenate([unpacked(x, "<u4") for x in group.column("counts").to_pylist()]).astype("<i8")

    def merge_triples(group: pa.Table) -> pa.Table:
        s = group.column("shard")[0].as_py()
        context, now, times = counted(_keys(group.column("keys")), np.concatenate([unpacked(x, "<u4") for x in group.column("now").to_pylist()]), counts_in(group))
        save_order("triples", s, context, now, times)
        pairs, before = np.unique((context << np.uint64(32)) | now, return_counts=True)  # the word before last falls out of the key
        rows = [("pairs", to, s, *packed(pairs[at], before[at].astype("<u4")), None) for to, at in by_shard(mixed(pairs >> np.uint64(32), shards))]
        return table_of([*rows, ("once", -1, s, None, None, once_of(times))])

    def merge_pairs(group: pa.Table) -> pa.Table:
        what, s = group.column("what")[0].as_py(), group.column("to")[0].as_py()
        if what == "once":
            return table_of([("triples", -1, 0, None, None, np.sum(group.column("once").to_pylist(), axis=0).tolist())])
        keys, before = summed(_keys(group.column("keys")), counts_in(group))
        context, now = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        save_order("pairs", s, context, now, before)
        words, types = np.unique(now, return_counts=True)
        rows = [("words", r, s, *packed(words[at], types[at].astype("<u4")), None) for r, at in by_shard((words // np.uint64(width)).astype(np.int64))]
        return table_of([*rows, ("pairs", -1, s, None, None, once_of(before))])

    def add(group: pa.Table) -> pa.Table:
        """One row for several parts."""
        what, to, part = (group.column(c)[0].as_py() for c in ("what", "to", "part"))
        if to < 0:
            return table_of([(what, to, part // PARTS, None, None, np.sum(group.column("once").to_pylist(), axis=0).tolist())])
        keys, counts = summed(_keys(group.column("keys")), counts_in(group))
        return table_of([(what, to, part // PARTS, *packed(keys, counts.astype("<u4")), None)])

    def finish(group: pa.Table) -> pa.Table:
        what, r = group.column("what")[0].as_py(), group.column("to")[0].as_py()
        if r < 0:
            return pa.table({"what": [what], "types": pa.array([0], pa.int64()), "once": pa.array([np.sum(group.column("once").to_pylist(), axis=0).tolist()], pa.list_(pa.int64()))})
        words, before = summed(_keys(group.column("keys")), counts_in(group))
        out = np.zeros(width, dtype="<u4")
        out[(words % np.uint64(width)).astype(np.int64)] = before
        _save(path, f"before-{r}", out)
        return pa.table({"what": [what], "types": pa.array([int(before.sum())], pa.int64()), "once": pa.array([once_of(before)], pa.list_(pa.int64()))})

    schema = "what string, to long, part long, keys binary, counts binary, once array<long>"
    counts = _texts(docs).mapInArrow(lean(triples), "shard int, keys binary, now binary, counts binary").groupBy("shard").applyInArrow(merge_triples, schema)
    lower = counts.groupBy("what", "to").applyInArrow(merge_pairs, schema)
    parts = shards
    while parts > PARTS:
        lower = lower.groupBy("what", "to", F.floor(F.col("part") / PARTS).alias("_p")).applyInArrow(add, schema)
        parts = -(-parts // PARTS)
    told = lower.groupBy("what", "to").applyInArrow(finish, "what string, types long, once array<long>").groupBy("what")
    rows = {r["what"]: r for r in told.agg(F.sum("types").alias("types"), *[F.sum(F.col("once")[k]).alias(f"n{k}") for k in range(4)]).collect()}
    once = {what: [r[f"n{k}"] for k in range(4)] for what, r in rows.items()}
    model.types = rows["words"]["types"]
    model.triple_discounts, model.pair_discounts, model.word_discounts = (discounts(once[x]) for x in ("triples", "pairs", "words"))
    few = once["words"]
    model.floor = float(np.dot(model.word_discounts, [few[0], few[1], model.words - few[0] - few[1]])) / model.types / (model.words + 1)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10 probabilities of the text)."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType

    def score(batches: Iterator) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_type

        for names, words, tokens, begins in blocks(batches, SCORED):
            own, base, known = model.log10(words, tokens, begins)
            lengths = np.diff(np.append(begins, len(tokens)))
            yield pa.RecordBatch.from_arrays([
                pa.array(names, to_arrow_type(kind)), pa.array(lengths.astype(np.int64)), pa.array(np.add.reduceat(known.astype(np.int64), begins)),
                pa.array(np.add.reduceat(base, begins)), pa.array(np.add.reduceat(own, begins)),
            ], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return _texts(docs).mapInArrow(lean(score), f"doc_id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(crc_mod("doc_id", 5) != 1))
    return scored(docs, model).select(
        "doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        (F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).alias("perplexity"),
    )
