"""Quality classifier: hashed word n-grams, FTRL logistic regression, sparse dot products."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from . import ftrl
from ._text import Cached, mix, pieces, seeds

SETTINGS = ftrl.Settings(bits=20, alpha=2.0, l1=0.02, l2=0.05, epochs=3, sample=12_000)
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]")


class NGrams:
    """Words, marks and their bigrams, weighted by the logarithm of their counts, of length 1.

    A token like the one before it is read as a token of its own kind, so
    repetition shows whatever the word; so is the case of a word's letters.
    """

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.of = Cached(xxhash.xxh64_intdigest)
        self.one, self.two, self.same, self.loud = seeds(4, "quality")

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for part in pieces(text):
            tokens = TOKEN.findall(part.lower())
            found.append(np.fromiter(map(self.of.__getitem__, tokens), np.uint64, len(tokens)))
        t = np.concatenate(found)
        if len(t) > 1:
            t[1:][t[1:] == t[:-1]] = self.same
        capitals = sum(text.count(bytes([c])) for c in range(65, 91))
        h = mix(np.concatenate([t * self.one, t[:-1] * self.two + t[1:], np.full(int(4 * capitals > len(text)), self.loud, np.uint64)]))
        at, n = np.unique(h >> self.shift, return_counts=True)
        value = 1 + np.log(n)
        return at.astype(np.int64), (value / max(1e-9, np.sqrt(value @ value))).astype(np.float32)


@lru_cache(2)
def _ngrams(bits: int) -> NGrams:
    return NGrams(bits)


def features(bits: int) -> ftrl.Features:
    return lambda text: _ngrams(bits)(text)


def classify_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, settings: ftrl.Settings = SETTINGS) -> DataFrame:
    """doc_id, score (the probability of label 1) and predicted of every row of ``docs``.

    ``labels`` has doc_id and quality, of rows to learn from only. Null and empty
    texts are scored by the bias; null ids and repeated rows are scored as others;
    an empty table gives no rows; other columns are ignored.
    """
    f = features(settings.bits)
    return ftrl.score(docs, ftrl.fit(docs, labels, "quality", f, settings), f, threshold)
