"""Token ids by a public tokenizer, fast enough for whole corpora.

Tokenizers that drop white space and never join characters across it give a text the ids of its words, one after the
other. Words repeat, so each worker keeps the ids of the words it has met, in a table of bounded size; only unknown
words reach the tokenizer.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from struct import pack

import numpy as np

from .common import remembered

#: Words that a worker remembers; beyond them it keeps those of few ids (in bytes), which are the frequent ones.
REMEMBERED, FEW = 1_000_000, 8
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def folded(text: bytes) -> bytes:
    """ASCII letters in lower case, as the tokenizer would, unless a special token may be in the text."""
    return text if b"<|" in text else text.lower()


def _ends_word(stem: bytes) -> bool:
    """Whether the last character is a letter or an ASCII digit."""
    return stem[-1:].isalnum() if stem[-1] < 128 else stem[-4:].decode("utf-8", "ignore")[-1:].isalpha()


class WordTokenizer:
    """Little-endian unsigned 32-bit ids of texts given as UTF-8."""

    def __init__(self, path: str, most: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.known = most or REMEMBERED, dict[bytes, bytes]()
        self.ending = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ending[[k for x, k in self.tokenizer.get_vocab().items() if x.endswith("</w>")]] = True

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known = {w: ids for w, ids in self.known.items() if len(ids) <= FEW}
            if len(self.known) > self.most // 2:
                self.known.clear()
            new = words.difference(self.known)
        # Marks after a letter or digit are a token run of their own, so words with and without them are encoded once.
        marked = {w: stem for w in new if len(stem := w.rstrip(MARKS)) < len(w) and stem and b"<|" not in w and _ends_word(stem)}
        marks = {w[len(stem) :] for w, stem in marked.items()}
        plain = new.difference(marked).union(marked.values(), marks).difference(self.known)
        texts = {w: w.decode("utf-8", "replace") for w in plain}
        letters = [w for w, x in texts.items() if x.isalpha()]
        for at in range(0, len(letters), 2000):
            self._learn_letters(letters[at : at + 2000], texts)
        others = [w for w in plain if w not in self.known]
        for w, ids in zip(others, self._ids([texts[w] for w in others]), strict=True):
            self.known[w] = pack(f"<{len(ids)}I", *ids)
        for w, stem in marked.items():
            self.known[w] = self.known[stem] + self.known[w[len(stem) :]]

    def _ids(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), 5000):
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 5000], add_special_tokens=False))

    def _learn_letters(self, words: list[bytes], texts: dict[bytes, str]) -> None:
        """Words of letters alone have one id that ends a word, so many are encoded as one text and told apart after."""
        (ids,) = self._ids([" ".join([texts[w] for w in words])])
        whole = np.array(ids, dtype="<u4")
        ends = 4 * (np.flatnonzero(self.ending[whole]) + 1)
        if len(ends) == len(words):
            line, start = whole.tobytes(), 0
            for w, end in zip(words, ends.tolist(), strict=True):
                self.known[w] = line[start:end]
                start = end

    def encoded(self, words: list[bytes]) -> bytes:
        """The ids of a text's words, learned in blocks so that no text needs more than the table."""
        out, some = [], max(1, min(100_000, self.most // 2))
        for at in range(0, len(words), some):
            block = words[at : at + some] if at or len(words) > some else words
            try:
                out.append(b"".join(map(self.known.__getitem__, block)))
            except KeyError:
                self.learn(set(block))
                out.append(b"".join(map(self.known.__getitem__, block)))
        return out[0] if len(out) == 1 else b"".join(out)


def tokenizer(path: str, most: int | None = None) -> WordTokenizer:
    """One per worker, path and size of its table, kept for its later tasks; one of another size goes first."""
    made = remembered("tokens")
    if path not in made or made[path].most != (most or REMEMBERED):
        made.pop(path, None)
        made[path] = WordTokenizer(path, most)
    return made[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def id_batches(batches: Iterator, path: str, some: int = 512, most: int | None = None) -> Iterator[tuple[list, list[bytes]]]:
    """From Arrow batches of (doc_id, text as binary): ids of documents and their token ids, some documents at a time, by a worker that remembers `most` words (and those of a block)."""
    known = tokenizer(path, most)
    for batch in batches:
        for at in range(0, batch.num_rows, some):
            part = batch.slice(at, some)
            texts = [folded(x or b"").split() for x in part.column(1).to_pylist()]
            if sum(map(len, texts)) < known.most:
                known.learn(set().union(*texts))
            yield part.column(0).to_pylist(), [known.encoded(x) for x in texts]
