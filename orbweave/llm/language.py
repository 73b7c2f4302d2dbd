"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in segments of SEGMENT bytes, all of it. In each segment one network runs forward and one backward; from both states
every position gets a probability of each language, and a document's probabilities are the means over its positions. The
network is trained in numpy on the driver by backpropagation through time, on a bounded sample: at most about
`per_language` documents of each of the at most `languages` most frequent languages, chosen by a hash of doc_id and text, and `segments` evenly spread segments of each. Predicting uses the text alone.

Defined results: null texts, texts without a letter, and all texts where nothing could be learned are `und` with score 0; repeated rows are predicted
alike; an empty table gives no rows. Documents without a language are predicted but not learned from.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import crc_mod, lean, remembered, table

SEGMENT, HIDDEN = 64, 8
#: Segments that are run side by side.
SIDE = 1024
#: Languages that are learned at most, the most frequent ones: the layer over the states has a row for each.
LANGUAGES = 1000
_LETTER = re.compile(rb"[A-Za-z]")


def segments_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segments of all texts, padded with zeros, and how many each text has."""
    counts = np.array([-(-len(x) // SEGMENT) for x in texts], dtype=np.int64)
    raw = b"".join([x.ljust(n * SEGMENT, b"\0") for x, n in zip(texts, counts.tolist(), strict=True)])
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, SEGMENT), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Gru:
    """One direction. Arrays are [feature, segment]; gates in the order update, reset, candidate."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.hidden = hidden
        self.inputs = (rng.standard_normal((3 * hidden, 256)) * 0.3).astype(np.float32)
        self.states = (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """x: [time, segment] bytes. The states after each time, and what backward needs."""
        k, h = self.hidden, np.zeros((self.hidden, x.shape[1]), dtype=np.float32)
        out, kept = np.empty((len(x), k, x.shape[1]), dtype=np.float32), []
        for t in range(len(x)):
            g, u = np.take(self.inputs, x[t], axis=1), self.states @ h
            z, r = _sigmoid(g[:k] + u[:k]), _sigmoid(g[k : 2 * k] + u[k : 2 * k])
            n = np.tanh(g[2 * k :] + r * u[2 * k :])
            kept.append((h, z, r, n, u[2 * k :]))
            h = out[t] = n + z * (h - n)
        return out, kept

    def backward(self, x: np.ndarray, kept: list, d: np.ndarray) -> list[np.ndarray]:
        """d: gradients of the states, [time, feature, segment]. Gradients of inputs and states."""
        k, carry, into = self.hidden, 0, np.empty((len(x), 3 * self.hidden, x.shape[1]), dtype=np.float32)
        states = np.zeros_like(self.states)
        for t in reversed(range(len(x))):
            h, z, r, n, un = kept[t]
            dh = d[t] + carry
            dn = dh * (1 - z) * (1 - n * n)
            dz, dr = dh * (h - n) * z * (1 - z), dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r])
            into[t] = np.concatenate([dz, dr, dn])
            states += du @ h.T
            carry = dh * z + self.states.T @ du
        cell = x[:, None, :] + 256 * np.arange(3 * k)[None, :, None]
        return [np.bincount(cell.ravel(), into.ravel(), 256 * 3 * k).reshape(3 * k, 256).astype(np.float32), states]

    def run(self, x: np.ndarray, out: np.ndarray) -> None:
        """forward for predictions alone: out[t] is the state after time t."""
        k, m = self.hidden, x.shape[1]
        scale = np.ones((3 * k, 1), dtype=np.float32)
        scale[: 2 * k] = 0.5  # a sigmoid is a scaled hyperbolic tangent of half its argument
        inputs, states = self.inputs * scale, self.states * scale
        g, u, w = (np.empty((3 * k, m), dtype=np.float32) for _ in range(3))
        h = np.zeros((k, m), dtype=np.float32)
        zr, n, gn, un = g[: 2 * k], w[2 * k :], g[2 * k :], u[2 * k :]
        for t in range(len(x)):
            np.take(inputs, x[t], axis=1, out=g, mode="clip")
            np.matmul(states, h, out=u)
            zr += u[: 2 * k]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            un *= zr[k:]
            un += gn
            np.tanh(un, out=n)
            h -= n
            h *= zr[:k]
            h += n
            out[t] = h


class Network:
    """Two directions and a linear layer over both states of a position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ways = Gru(rng, hidden), Gru(rng, hidden)
        self.weights = (rng.standard_normal((len(languages), 2 * hidden)) * 0.3).astype(np.float32)
        self.bias = np.zeros((len(languages), 1), dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.ways[0].inputs, self.ways[0].states, self.ways[1].inputs, self.ways[1].states, self.weights, self.bias]

    def loss(self, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over the positions of segments x [time, segment] that aren't padding, and its gradients."""
        (f, kf), (b, kb) = self.ways[0].forward(x), self.ways[1].forward(x[::-1])
        both = np.concatenate([f, b[::-1]], axis=1)
        p = np.einsum("lh,ths->tls", self.weights, both) + self.bias
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        real = (x > 0).astype(np.float32)
        share = real / max(1.0, real.sum())
        value = -(np.log(np.maximum(p[:, label, np.arange(x.shape[1])], 1e-12)) * share).sum()
        p[:, label, np.arange(x.shape[1])] -= 1
        p *= share[:, None, :]
        d = np.einsum("lh,tls->ths", self.weights, p)
        k = self.ways[0].hidden
        grads = self.ways[0].backward(x, kf, d[:, :k]) + self.ways[1].backward(x[::-1], kb, d[::-1, k:])
        return float(value), [*grads, np.einsum("tls,ths->lh", p, both), p.sum(axis=(0, 2))[:, None]]

    def train(self, segments: np.ndarray, labels: np.ndarray, steps: int = 400, batch: int = 128, rate: float = 0.02, seed: int = 7) -> None:
        """Adam over seeded batches in which languages are equally frequent."""
        rng, own = np.random.default_rng(seed), self.parameters()
        first, second = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own]
        of = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(x, -(-batch // len(of))) for x in of])
            _, grads = self.loss(np.ascontiguousarray(segments[pick].T), labels[pick])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for p, g, a, b in zip(own, grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / (size + 1e-12))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)

    def positions(self, segments: np.ndarray) -> np.ndarray:
        """Probabilities [time, language, segment] of every position of segments [segment, time]."""
        x = np.ascontiguousarray(segments.T)
        k, m = self.ways[0].hidden, x.shape[1]
        f, b = np.empty((len(x), k, m), dtype=np.float32), np.empty((len(x), k, m), dtype=np.float32)
        self.ways[0].run(x, f)
        self.ways[1].run(x[::-1], b)
        p = np.matmul(self.weights[:, :k], f)
        p += np.matmul(self.weights[:, k:], b[::-1])
        p += self.bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities [text, language] over the positions of each text."""
        segments, counts = segments_of(texts)
        sums = np.empty((len(segments), len(self.languages)))
        for at in range(0, len(segments), SIDE):
            part = segments[at : at + SIDE]
            real = (part > 0).astype(np.float32).T
            sums[at : at + SIDE] = np.einsum("tls,ts->sl", self.positions(part), real)
        out = np.zeros((len(texts), len(self.languages)))
        some = counts > 0
        if some.any():
            starts = (np.cumsum(counts) - counts)[some]
            out[some] = np.add.reduceat(sums, starts, axis=0)
            out[some] /= np.maximum(out[some].sum(axis=1, keepdims=True), 1e-12)
        return out


def lettered(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def sample(labelled: DataFrame, per_language: int, segments: int, seed: int, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, segments and their labels, from about per_language documents of each language at most. Copies of one id and text are one document, so neither shared ids nor repeated rows change the bound."""
    marked = labelled.withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")))
    sizes = marked.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("_h", 0.02).alias("d")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return [], np.zeros((0, SEGMENT), dtype=np.uint8), np.zeros(0, dtype=np.int64)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / max(1, r["d"])))])
    chosen = marked.filter(F.pmod("_h", F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003).groupBy("lang", "_h").agg(F.first("text").alias("text"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and lettered(text):
                    rows, _ = segments_of([text])
                    some = rows[np.unique(np.linspace(0, len(rows) - 1, segments).round().astype(int))]
                    langs += [lang] * len(some)
                    parts += [x.tobytes() for x in some]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])

    rows = sorted((r["lang"], bytes(r["part"])) for r in chosen.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(cut, "lang string, part binary").collect())
    names = sorted({x for x, _ in rows})
    return names, np.frombuffer(b"".join(x for _, x in rows), dtype=np.uint8).reshape(-1, SEGMENT), np.array([names.index(x) for x, _ in rows], dtype=np.int64)


def learn(labelled: DataFrame, per_language: int = 300, segments: int = 8, seed: int = 7, steps: int = 400, languages: int = LANGUAGES) -> Network:
    """A network from rows of doc_id, text and lang (null ones are left out), for the `languages` most frequent ones at most."""
    names, rows, labels = sample(labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"), per_language, segments, seed, languages)
    network = Network(names, seed=seed)
    if len(names) > 1:
        network.train(rows, labels, steps=steps, seed=seed)
    return network


def predicted(text: Column, network: Network) -> Column:
    """struct<lang, score> of a text."""

    @F.pandas_udf("lang string, score double")
    def predict(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        remembered("language")
        yield from lean(told)(series)

    def told(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in series:
            langs, scores, texts = [], [], [x or b"" for x in column]
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and held < 1 << 22:
                    held += len(texts[to])
                    to += 1
                part = texts[at:to]
                if network.languages:
                    p = network.documents(part)
                    fine = [lettered(x) for x in part]
                    langs += [network.languages[k] if ok else "und" for k, ok in zip(p.argmax(axis=1).tolist(), fine, strict=True)]
                    scores += [min(1.0, s) if ok else 0.0 for s, ok in zip(p.max(axis=1).tolist(), fine, strict=True)]
                else:
                    langs, scores = langs + ["und"] * len(part), scores + [0.0] * len(part)
                at = to
            yield pd.DataFrame({"lang": langs, "score": scores})

    return predict(text.cast("binary"))


def identify(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from documents that aren't held out."""
    network = learn(docs.filter(crc_mod("doc_id", modulus) != held))
    return docs.select("doc_id", (crc_mod("doc_id", modulus) == held).alias("held_out"), predicted(F.col("text"), network).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )


def keep_identified(docs: DataFrame, languages: Collection[str] | None = None, least: float = 0.5, modulus: int = 4, held: int = 2) -> DataFrame:
    """The documents whose predicted language is among languages (None: any learned one) with a score of at least `least`.

    By default a document stays if the network gives one language at least as much as all others together. Texts that are null or have no letter go. Where no
    language could be learned, there is nothing to reject by: all other documents stay, unless languages are asked for.
    """
    network = learn(docs.filter(crc_mod("doc_id", modulus) != held))
    if not network.languages:

        @F.pandas_udf("boolean")
        def fine(column: pd.Series) -> pd.Series:
            return pd.Series([lettered(x or b"") for x in column], dtype=bool)

        return docs.filter(fine(F.col("text").cast("binary")) if languages is None else F.lit(False))
    wanted = sorted(set(network.languages) if languages is None else set(languages) - {"und"})
    rows = docs.select(F.struct("*").alias("_row"), predicted(F.col("text"), network).alias("_p"))
    return rows.filter(F.col("_p.lang").isin(wanted) & (F.col("_p.score") >= least)).select("_row.*")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
