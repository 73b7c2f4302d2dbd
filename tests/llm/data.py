"""Documents with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, n long, fp long, target double, _row string, _id long, ids binary, seq long"


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", "   \t\n", "a", "Token", "é ü ñ", "12 34 !!", "x" * 30_000, sentence(20_000)]
    base = sentence(300)
    texts += [base, base.replace(" ", "  "), base.upper(), base + " end", sentence(3), sentence(4), " nbsp space", "😀 smile 😀"]
    texts += [sentence(rng.randint(1, 120)) for _ in range(30)]
    out = []
    for k, text in enumerate(texts):
        lang = ("en", "de", None)[k % 3]
        source = ("s1", "s2", None, "hot", "hot")[k % 5]
        out.append((k, text, lang, source, None if text is None else len(text), "h", k, 1, 2.0, "r", k, b"i", k))
    out += [out[9], out[9], out[0]]  # repeated rows
    out += [(None, "no id", "en", "s1", 5, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return out


def docs(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
