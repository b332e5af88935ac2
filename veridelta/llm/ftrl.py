"""Follow-the-regularised-leader logistic regression over hashed features.

The model has at most ``2**bits`` weights, of which L1 leaves few; those are
broadcast, 8 bytes each. Training streams over a bounded sample of labelled rows
in one task; scoring streams over all rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import column

#: A function from the bytes of a text to distinct feature numbers below 2**bits and their values.
Features = Callable[[bytes], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Settings:
    """Parameters of training. ``sample`` bounds the labelled rows that are learnt from, ``sample_bytes`` their texts."""

    bits: int = 20
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    epochs: int = 3
    sample: int = 20_000
    sample_bytes: int = 256 << 20


class Ftrl:
    """FTRL-proximal: per-coordinate rates, weights that L1 leaves at exactly zero."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.z = np.zeros((1 << settings.bits) + 1)
        self.n = np.zeros((1 << settings.bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.s.l1, 0.0, (np.sign(z) * self.s.l1 - z) / ((self.s.beta + np.sqrt(n)) / self.s.alpha + self.s.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def with_bias(at: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return np.append(at, 1 << bits), np.append(value, 1.0)


def fit(docs: DataFrame, labels: DataFrame, label: str, features: Features, settings: Settings) -> np.ndarray:
    """The weights, the last one the bias, learnt from labelled ``docs``.

    Of ``labels`` (doc_id and a 0/1 column) those ``settings.sample`` are learnt
    from whose hash of the id is least, and of their texts, in that order, those
    up to the first that passes ``settings.sample_bytes`` in all. Null ids and
    labels, and ids with labels of both kinds, are passed over; of documents that
    repeat an id one is learnt from, that with the least hash of its text. The
    rows go to one task, in order of the hash, since the order of updates is part
    of the method; the bounds of the sample bound that task. Without labelled
    rows all weights are 0, so all scores are 0.5.
    """
    order = F.xxhash64("doc_id")
    agreed = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most")
    chosen = agreed.orderBy(order, "doc_id").limit(settings.sample)
    # At most settings.sample rows of two numbers are broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    text = F.coalesce("text", F.lit(""))
    one = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by(text, F.struct(F.xxhash64(text), text)).alias("text"))
    rows = one.repartition(1).sortWithinPartitions(order, "doc_id").select("text", "label")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, left = [], settings.sample_bytes
        for b in batches:
            for text, y in zip(column(b, "text"), b.column(1).to_pylist(), strict=True):
                left -= len(text)
                if left < 0:
                    break
                at, value = with_bias(*features(text), settings.bits)
                seen.append((at.astype(np.uint32), value.astype(np.float32), y))
        model = Ftrl(settings)
        for _ in range(settings.epochs):
            for at, value, y in seen:
                model.learn(at, value, y)
        w = model.weights(slice(None)).astype(np.float32)
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([kept.astype("<i4").tobytes()], pa.binary()), pa.array([w[kept].astype("<f4").tobytes()], pa.binary())], ["at", "w"])

    weights = np.zeros((1 << settings.bits) + 1, np.float32)
    for r in rows.mapInArrow(train, "at binary, w binary").collect():  # one row of at most 8 bytes a weight
        weights[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["w"], "<f4")
    return weights


def score(docs: DataFrame, weights: np.ndarray, features: Features, threshold: float) -> DataFrame:
    """doc_id, score and predicted of every row; needs no shuffle. Null texts count as empty."""
    bits = (len(weights) - 1).bit_length() - 1
    some = np.flatnonzero(weights).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((len(weights), some, weights[some]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, some, values = shared.value
        w = np.zeros(size, np.float32)
        w[some] = values
        for b in batches:
            out = []
            for text in column(b, "text"):
                at, value = features(text)
                out.append(float(w[at] @ value) + float(w[1 << bits]))
            p = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, predicted int")
