"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from . import ftrl
from ._text import ALNUM, WordHasher, mix, seeds

SETTINGS = ftrl.Settings(bits=20, alpha=2.0, l1=8.0, l2=0.01, epochs=5, sample=24_000)


class SkipGrams:
    """The distinct words, bigrams and pairs with one word between, each of value 1."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.words = WordHasher(ALNUM)
        self.one, self.two, self.skip = seeds(3, "toxicity")

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        w = self.words(text)
        h = mix(np.concatenate([w * self.one, w[:-1] * self.two + w[1:], w[:-2] * self.skip + w[2:]]))
        at = np.unique(h >> self.shift)
        return at.astype(np.int64), np.ones(len(at), np.float32)


@lru_cache(2)
def _grams(bits: int) -> SkipGrams:
    return SkipGrams(bits)


def features(bits: int) -> ftrl.Features:
    return lambda text: _grams(bits)(text)


def classify_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, settings: ftrl.Settings = SETTINGS) -> DataFrame:
    """doc_id, score (the probability of label 1) and predicted of every row of ``docs``.

    ``labels`` has doc_id and toxic, of rows to learn from only. Null and empty
    texts are scored by the bias; null ids and repeated rows are scored as others;
    an empty table gives no rows; other columns are ignored.
    """
    f = features(settings.bits)
    return ftrl.score(docs, ftrl.fit(docs, labels, "toxic", f, settings), f, threshold)
