"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Tables
from ._text import ALNUM, WordHasher, column, mix, seeds

#: Of the words under a mask those at a 1 are hashed and those at a 0 ignored.
MASKS = ("110101", "11001011", "1010011001")
#: Items of fewer than ``LIGHT_WORDS`` words have masks of less weight too. Of items of 5 to 11 words
#: with four words in five kept one of them always hits; of longer ones with three in five nearly always.
LIGHT, LIGHT_WORDS = ("111", "1101"), 24
#: Items of fewer words have a mask of all their words, so they are found as they are.
LEAST_WORDS = 5
#: Items of fewer words are held from ``window_similarity`` on.
SHORT_WORDS = 12
_LONGEST = max(map(len, MASKS))


def masks_of(n: int) -> tuple[str, ...]:
    """The masks under which an item of ``n`` words is indexed."""
    if n < LEAST_WORDS:
        return ("1" * n,)
    return LIGHT + MASKS if n < LIGHT_WORDS else MASKS


def _masks(sizes: Iterable[int]) -> list[str]:
    """The masks that items of these numbers of words need."""
    return sorted({m for n in sizes if n for m in masks_of(n)})
SCHEMA = "doc_id bigint, item_id bigint, doc_start bigint, item_words bigint, matched bigint, similarity double"


def _seeded(words: np.ndarray, mask: str, factors: np.ndarray) -> np.ndarray:
    """The hash under ``mask`` at each place where it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            h += words[i : i + n] * factors[i]
    return mix(h)


class Index:
    """Seed hashes of a block of test items, and the search of documents for them."""

    def __init__(self, items: list[tuple[int, str]], min_similarity: float, window: int, window_similarity: float, slip: int):
        hasher = WordHasher(ALNUM)
        self.min_similarity, self.window, self.window_similarity, self.slip = min_similarity, window, window_similarity, slip
        self.items = [(i, w) for i, text in items if len(w := hasher((text or "").encode()))]
        self.need = [(max(min_similarity, window_similarity) if len(w) < SHORT_WORDS else min_similarity) * len(w) - 1e-9 for _, w in self.items]
        self.masks = _masks(len(w) for _, w in self.items)
        self.factors = [seeds(_LONGEST, f"mask {m}") for m in self.masks]
        self.tables = []
        for mask, factors in zip(self.masks, self.factors, strict=True):
            at = [(h, k, p) for k, (_, w) in enumerate(self.items) if mask in masks_of(len(w)) for p, h in enumerate(_seeded(w, mask, factors))]
            hashes = np.array([a[0] for a in at], np.uint64)
            order = np.argsort(hashes, kind="stable")
            present = np.zeros(1 << 16, bool)
            present[hashes >> np.uint64(48)] = True
            self.tables.append((hashes[order], np.array([a[1] for a in at], np.int64)[order], np.array([a[2] for a in at], np.int64)[order], present))

    def hits(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """The diagonals, sorted, on which seeds of each item meet the document's."""
        found: list[np.ndarray] = []
        for mask, factors, (hashes, item, place, present) in zip(self.masks, self.factors, self.tables, strict=True):
            h = _seeded(words, mask, factors)
            maybe = np.flatnonzero(present[h >> np.uint64(48)])
            first = np.searchsorted(hashes, h[maybe], "left")
            count = np.searchsorted(hashes, h[maybe], "right") - first
            maybe, first, count = maybe[count > 0], first[count > 0], count[count > 0]
            # Words that repeat in both meet very often: so many hits at a time.
            for part in np.split(np.arange(len(maybe)), np.flatnonzero(np.diff(np.cumsum(count) // MOST_HITS)) + 1):
                if len(part):
                    n = count[part]
                    x = np.repeat(first[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    found.append(np.unique(np.stack([item[x], np.repeat(maybe[part], n) - place[x]]), axis=1))
        if not found:
            return {}
        k, d = np.unique(np.concatenate(found, axis=1), axis=1)
        edges = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
        return {int(k[a]): d[a:b] for a, b in zip(edges, edges[1:], strict=False)}

    def search(self, words: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """Of each item found: its number, the first word in the document, its words, those matched, their share."""
        out = []
        for k, diagonals in self.hits(words).items():
            item, best = self.items[k][1], None
            step = max(1, MOST_CELLS // len(item))
            for a in range(0, len(diagonals), step):
                # With the diagonals around, which bridge words put in or left out.
                b = min(len(diagonals), a + step)
                lo, hi = np.searchsorted(diagonals, diagonals[a] - self.slip), np.searchsorted(diagonals, diagonals[b - 1] + self.slip, "right")
                m = self._laid(words, item, diagonals[lo:hi])[a - lo : b - lo]
                got = m.sum(axis=1)
                held = got >= self.need[k]
                if len(item) > self.window:
                    sums = np.cumsum(np.pad(m, ((0, 0), (1, 0))), axis=1)
                    held |= (sums[:, self.window :] - sums[:, : -self.window]).max(axis=1) >= self.window_similarity * self.window - 1e-9
                if held.any():
                    at = np.flatnonzero(held)
                    start = np.maximum(diagonals[a + at], 0)
                    x = np.lexsort((start, -got[at]))[0]
                    found = (int(got[at[x]]), -int(start[x]))
                    best = found if best is None else max(best, found)
            if best is not None:
                out.append((k, -best[1], len(item), best[0], round(best[0] / len(item), 6)))
        return out

    def _laid(self, words: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
        """Of each diagonal which words of the item equal the document's, or do in runs of four on a diagonal at most ``slip`` away."""
        at = diagonals[:, None] + np.arange(len(item))[None, :]
        own = (at >= 0) & (at < len(words)) & (words[np.clip(at, 0, len(words) - 1)] == item[None, :])
        if len(diagonals) < 2 or len(item) < 4:
            return own
        four = own[:, :-3] & own[:, 1:-2] & own[:, 2:-1] & own[:, 3:]
        runs = np.zeros_like(own)
        for shift in range(4):
            runs[:, shift : shift + four.shape[1]] |= four
        out = own.copy()
        for by in [s for s in range(-self.slip, self.slip + 1) if s]:
            near = np.minimum(np.searchsorted(diagonals, diagonals + by), len(diagonals) - 1)
            there = diagonals[near] == diagonals + by
            out[there] |= runs[near[there]]
        return out


#: Hits and words compared that are held at a time.
MOST_HITS, MOST_CELLS = 1 << 20, 1 << 20


def _hashes(texts: DataFrame, masks: list[str] | None = None, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(key, hash) of the distinct seed hashes of texts (key, text), under ``masks`` or else those of items of their length; with ``keep``, those of which it holds."""

    factors = {m: seeds(_LONGEST, f"mask {m}") for m in _masks(range(LIGHT_WORDS + 1))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ALNUM)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), column(b), strict=True):
                words = hasher(text)
                h = np.unique(np.concatenate([words[:0], *(_seeded(words, m, factors[m]) for m in (masks_of(len(words)) if masks is None else masks) if m)]))
                h = h if keep is None else h[keep(h)]
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.int64()), pa.array(h.view(np.int64))], ["key", "hash"])

    return texts.select("key", "text").mapInArrow(run, "key bigint, hash bigint")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of words of texts, those from ``LIGHT_WORDS`` on as one."""
    for b in batches:
        n = {min(LIGHT_WORDS, len(text.translate(ALNUM).split())) for text in column(b)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(n), pa.int32())], ["n"])


def _meeting(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of both that share a seed hash with one of the other: a join of hashes, for more items than a broadcast holds.

    Texts are known by a hash of theirs. A filter of fixed size keeps most hashes
    of documents, which are none of an item, out of the shuffle.
    """
    tables = Tables(docs.sparkSession)
    key = F.xxhash64("text")
    masks = _masks(r[0] for r in items.select("text").mapInArrow(_sizes, "n int").distinct().collect())
    own = tables.save(_hashes(items.select(key.alias("key"), "text").distinct()))
    bits = np.zeros(1 << 23, np.uint8)
    block = F.expr("cast(shiftrightunsigned(hash, 51) as int)")
    for r in own.select(block.alias("b"), F.expr("cast(shiftrightunsigned(hash, 38) & 8191 as int)").alias("at")).distinct().groupBy("b").agg(F.collect_set("at").alias("at")).toLocalIterator():
        at = (r["b"] << 13) + np.array(r["at"])
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def maybe(h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(38)).astype(np.int64)
        return (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    theirs = _hashes(docs.select(key.alias("key"), "text"), masks, maybe)
    met = tables.save(theirs.withColumnRenamed("key", "doc").distinct().join(own.withColumnRenamed("key", "item"), "hash").select("doc", "item").distinct())
    both = lambda rows, name: rows.where("text IS NOT NULL").withColumn("_met", key).join(met.select(F.col(name).alias("_met")).distinct(), "_met", "left_semi").drop("_met")
    return both(docs.select("doc_id", "text"), "doc"), both(items, "item")


def _indexes(docs: DataFrame, benchmark: DataFrame, block_bytes: int, **how) -> Iterator[tuple]:
    """Broadcast indexes of blocks of items, each of about ``block_bytes`` of text at most, and whether only documents that meet an item are left to search."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = lambda rows: rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    total = size(items)
    if total > block_bytes:
        docs, items = _meeting(docs, items)
        tables = Tables(docs.sparkSession)
        docs, items = tables.save(docs), tables.save(items)
        total = size(items)
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield docs, benchmark.sparkSession.sparkContext.broadcast(Index(sorted(((r[0], r[1]) for r in part.collect()), key=str), **how))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, min_similarity: float = 0.6, window: int = 20, window_similarity: float = 0.8, slip: int = 3, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document and test item that it holds: doc_id, item_id, doc_start, item_words, matched, similarity.

    Words are runs of letters and digits, ASCII letters in lower case. An item is
    held if at least ``min_similarity`` of its words stand in the document in
    their order and distance, or ``window_similarity`` of some ``window`` of its
    words in a row, a part of a long item. An item of fewer than ``SHORT_WORDS``
    words is held from ``window_similarity`` on, since a few common words in
    place mean little; one of fewer than ``LEAST_WORDS`` if all of it is there.
    Words that differ are ignored by the masks; words put in or left out are
    bridged where both parts were hit, at most ``slip`` words apart.

    The index of the items is broadcast, and documents aren't shuffled. Where
    the items are of more than ``block_bytes`` of text, the seed hashes of both
    sides are joined first; items and documents that meet are verified in blocks
    of about that size, so what is broadcast is bounded however many there are. Null texts and items without a
    word are never held; null ids stay null; repeated rows are found each; an
    empty table on either side gives no rows; other columns are ignored.
    """
    found = []
    for part, shared in _indexes(docs, benchmark, block_bytes, min_similarity=min_similarity, window=window, window_similarity=window_similarity, slip=slip):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, hasher = shared.value, WordHasher(ALNUM)
            for b in batches:
                rows = [(i, index.items[k][0], *x) for i, text in zip(b.column(0).to_pylist(), column(b), strict=True) if text for k, *x in index.search(hasher(text))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.float64()], strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        found.append(part.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, min_similarity: float = 0.6, window: int = 20, window_similarity: float = 0.8, slip: int = 3, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of ``benchmark``; where one block of items suffices, without a shuffle.

    Else the texts that hold one, known by their SHA-256, are found first.
    """
    indexes = list(_indexes(docs, benchmark, block_bytes, min_similarity=min_similarity, window=window, window_similarity=window_similarity, slip=slip))
    if not indexes:
        return docs

    def held(index: Index, hasher: WordHasher, text: bytes) -> bool:
        return bool(text and index.search(hasher(text)))

    if len(indexes) == 1 and indexes[0][0] is docs:
        shared = indexes[0][1]

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, hasher = shared.value, WordHasher(ALNUM)
            for b in batches:
                yield b.filter(pa.array([not held(index, hasher, text) for text in column(b)], pa.bool_()))

        return docs.mapInArrow(clean, T.StructType(docs.schema.fields))
    gone = None
    for part, shared in indexes:

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, hasher = shared.value, WordHasher(ALNUM)
            for b in batches:
                yield b.select(["sha"]).filter(pa.array([held(index, hasher, text) for text in column(b)], pa.bool_()))

        found = part.select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text").mapInArrow(find, "sha string")
        gone = found if gone is None else gone.unionByName(found)
    # The columns of ``docs`` are one struct, so no name of theirs meets one of this function.
    rows = docs.select(F.struct("*").alias("row"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    return rows.join(gone.distinct(), "sha", "left_anti").select("row.*")
