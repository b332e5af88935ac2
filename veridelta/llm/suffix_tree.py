"""Language-model scoring with a probabilistic suffix tree.

Tokens are words between ASCII white space, ASCII letters in lower case, and an
end after the last; 64-bit hashes stand for them and for sequences of them.
Texts are tokenised into a table of hashes that all passes of training read and
that is deleted before texts are scored. Counts of single tokens cover the whole
training corpus. Sequences of up to ``depth + 1``
tokens are kept from ``least_count`` on, whatever the size of the corpus, and a
context is one if what follows it diverges from what follows its suffix. Counts
and weights stay distributed, dealt by hash, and are joined; what is broadcast
has a fixed size: frequent tokens, frequent weights, and filters.

What is shuffled of a sequence are the numbers of its tokens: a frequent token's
rank, of others a place in a list sent along, byte by byte and compressed.

A score is a sum of weights: with P(x|c) = left(c) * P(x|suffix of c) where x
wasn't counted after c, log P is the root's, plus log left of each context, plus
for each sequence counted by how much it differs from that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Tables
from ._text import WordHasher, groups

#: Hash of the end; no word holds white space.
END = xxhash.xxh64_intdigest(b"\n")
#: Counts are added up in memory and passed on at this many entries.
FLUSH = 1 << 19
#: Tokens a partition of the counts is made for, and how many partitions there are at most; counting holds a shard of one at a time.
PER_PARTITION, MOST_PARTITIONS, PER_SHARD = 1 << 22, 20_000, 1 << 20
#: Frequent tokens and weights that are broadcast: at most 2 MB and 16 MB of hashes.
VOCABULARY, CACHE = 1 << 17, 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_EMPTY = np.empty(0, np.uint64)
#: Made once a worker, since each holds tables of its own.
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys of sequences from those of the sequences without their last and without their first token."""
    return first * _A + second * _B


def _packed(x: np.ndarray) -> bytes:
    """Numbers as bytes: first bytes first, then second ones, ..., compressed."""
    x = np.ascontiguousarray(x)
    return _ZIP.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b"")


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(_UNZIP.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of the hash, so sorted keys are sorted by part, and a part of many is one of few."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _edges(parts: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each part that sorted ``parts`` hold, with where."""
    if len(parts):
        at = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for a, b in zip(at, at[1:], strict=False):
            yield int(parts[a]), slice(a, b)


def _hash_of(label: np.ndarray) -> np.ndarray:
    """Spark's hash of an int, by which it deals rows to partitions."""
    rot = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    k = rot(label.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = rot(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def _labels(parts: int) -> np.ndarray:
    """A number for each of ``parts`` partitions that Spark deals to it, so that none gets two and none none."""
    out, start = np.full(parts, -1, np.int64), 0
    while (out < 0).any():
        n = np.arange(start, start + 4 * parts, dtype=np.int64)
        to = _hash_of(n).astype(np.int64) % parts
        for p, k in zip(to[::-1], n[::-1], strict=True):
            if out[p] < 0 or out[p] >= start:
                out[p] = k
        start += 4 * parts
    return out


def _batch(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


TOKENS = "name bigint, size bigint, ids binary, lengths binary, learn binary, tokens binary, words binary"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """ids, numbers of tokens and the hashes of all tokens of texts (doc_id, text), in groups."""
    hasher = WordHasher()
    for b in batches:
        end = 0
        for texts in groups(b):
            start, end = end, end + len(texts)
            tokens = [np.append(hasher(t), np.uint64(END)) for t in texts]
            yield b.column(0).slice(start, len(texts)), np.array([len(t) for t in tokens]), np.concatenate(tokens)


TOKENS = "size bigint, tokens binary, words binary"


def tokenise(docs: DataFrame) -> DataFrame:
    """Texts (doc_id, text) in groups: how many tokens, and their hashes, as places in a list of those of the group."""
    kinds = {"size": pa.int64(), "tokens": pa.binary(), "words": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, tokens in _texts(batches):
            words, at = np.unique(tokens, return_inverse=True)
            yield _batch(kinds, [(len(tokens), _packed(at.astype("<u4")), _packed(words.astype("<u8")))])

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS)


def _nullable(ids: pa.Array) -> bytes:
    """Nullable 64-bit integers as bytes."""
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, pa.schema([("ids", pa.int64())])) as w:
            w.write_batch(pa.RecordBatch.from_arrays([ids], ["ids"]))
        return out.getvalue().to_pybytes()


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The tokens of each group."""
    for tokens, words in _rows(batches):
        yield _unpacked(words, "<u8")[_unpacked(tokens, "<u4")]


@dataclass(frozen=True)
class Deal:
    """How hashes are dealt: partitions, the shards of them that counting holds one by one, and the partitions' labels."""

    partitions: int
    shards: int
    labels: np.ndarray

    @classmethod
    def of(cls, tokens: int, partitions: int | None = None) -> Deal:
        """Of so many tokens: sized by them, not by a setting, so a task's share stays as it is when they grow."""
        p = partitions or min(MOST_PARTITIONS, max(8, -(-tokens // PER_PARTITION)))
        return cls(p, p * max(1, -(-tokens // (p * PER_SHARD))), _labels(p))

    def place(self, shard: int) -> int:
        return int(self.labels[shard * self.partitions // self.shards])

    def sent(self, rows: DataFrame) -> DataFrame:
        """Rows (place, shard, ...) in their partitions, a shard after the other."""
        return rows.repartition(self.partitions, "place").sortWithinPartitions("shard")


def _added(keys: list[np.ndarray], counts: list[np.ndarray], *more: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys with the sums of their counts, and of other columns the value that comes with them."""
    k, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return k, np.bincount(at, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64), *(np.concatenate(m)[first] for m in more)


class _Adder:
    """Sums of counts by key, with columns that follow from the key."""

    def __init__(self, columns: int):
        self.columns = columns
        self.clear()

    def clear(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = self.solid = 0

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.size += len(columns[0])

    def full(self, most: int) -> bool:
        """Whether, after equal keys are added up, ``most`` keys or more are held."""
        if self.size < max(most, self.solid + most // 2):
            return False
        self.held = [self.sum()]
        self.size = self.solid = len(self.held[0][0])
        return self.size >= most * 3 // 4

    def sum(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return _EMPTY, np.empty(0, np.int64), *([_EMPTY] * (self.columns - 2))
        return _added(*(list(c) for c in zip(*self.held, strict=True)))

    def take(self) -> tuple[np.ndarray, ...]:
        out = self.sum()
        self.clear()
        return out


_COUNTED = {"place": pa.int32(), "shard": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
COUNTED = "place int, shard bigint, keys binary, counts binary"


def count_tokens(tokens: DataFrame, deal: Deal) -> DataFrame:
    """Counts of single tokens, a row a shard: its sorted keys and their counts."""

    def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s, at in _edges(_part(keys, deal.shards)):
            yield _batch(_COUNTED, [(deal.place(s), s, _packed(keys[at].astype("<u8")), _packed(counts[at].astype("<i8")))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder = _Adder(2)
        for t in _training(batches):
            adder.add(*np.unique(t, return_counts=True))
            if adder.full(FLUSH):
                yield from rows(*adder.take())
        yield from rows(*adder.take())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder, held = _Adder(2), None
        for _, shard, k, c in _rows(batches):
            if shard != held:
                yield from rows(*adder.take())
                held = shard
            adder.add(_unpacked(k, "<u8"), _unpacked(c, "<i8"))
            adder.full(FLUSH // 4)
        yield from rows(*adder.take())

    return deal.sent(tokens.select("tokens", "words").mapInArrow(count, COUNTED)).mapInArrow(merge, COUNTED)


def _cut(sizes: dict[int, int], most: int) -> int:
    """The least class from which on there are at most ``most``, of numbers by class."""
    total = 0
    for c in sorted(sizes, reverse=True):
        total += sizes[c]
        if total > most:
            return c + 1
    return 0


def _class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(n) * 8).astype(np.int64)


class Slots:
    """A table of at most one key a slot, found by one look; of keys with the same slot the first given has it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 2):
        self.width = max(4, int(room * len(keys) - 1).bit_length())
        self.keys, self.values = np.zeros(1 << self.width, np.uint64), np.zeros(1 << self.width, values.dtype)
        slots, first = np.unique(keys >> np.uint64(64 - self.width), return_index=True)
        self.keys[slots], self.values[slots] = keys[first], values[first]
        self.held = np.zeros(len(keys), bool)
        self.held[first] = True

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each key whether it is held, and its value, 0 if not. The key 0 is never held."""
        at = keys >> np.uint64(64 - self.width)
        hit = (self.keys[at] == keys) & (keys != 0)
        return hit, np.where(hit, self.values[at], 0)


class Vocabulary:
    """Frequent tokens, most frequent first, and their counts."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.lexsort((tokens, -counts))
        self.tokens, self.counts = tokens[order], counts[order]
        self.rank = Slots(self.tokens, np.arange(1, len(tokens) + 1, dtype=np.int32), 4)
        self.rank.held = None

    def encode(self, t: np.ndarray) -> np.ndarray:
        """The rank of each token, -1 of others."""
        return self.rank(t)[1].astype(np.int32) - 1

    def pack(self, t: np.ndarray, ranks: np.ndarray, at: np.ndarray, n: int) -> tuple[bytes, bytes]:
        """The sequences of ``n`` tokens at places ``at`` of ``t``: numbers of tokens, and a list of those that aren't frequent."""
        where = at[None, :] + np.arange(n)[:, None]
        code, rare = ranks[where], _EMPTY
        other = code < 0
        if other.any():
            rare, number = np.unique(t[where[other]], return_inverse=True)
            code[other] = len(self.tokens) + number
        return _packed(code.reshape(-1).astype("<u4")), _packed(rare.astype("<u8"))

    def unpack(self, codes: bytes, rare: bytes, n: int) -> np.ndarray:
        """Hashes of sequences, a row a place in them."""
        code, known = _unpacked(codes, "<u4").reshape(n, -1), len(self.tokens)
        out = self.tokens[np.minimum(code, known - 1)] if known else np.zeros(code.shape, np.uint64)
        other = code >= known
        if other.any():
            out[other] = _unpacked(rare, "<u8")[code[other] - known]
        return out


def _keys(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences, a row a place: their keys, and those without the last and without the first token."""
    while len(tokens) > 2:
        tokens = _joined(tokens[:-1], tokens[1:])
    return _joined(tokens[0], tokens[1]), tokens[0], tokens[1]


def vocabulary(singles: DataFrame, most: int = VOCABULARY) -> Vocabulary:
    """The ``most`` most frequent tokens or, where counts tie, somewhat fewer."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c,) in _rows(batches):
            k, n = np.unique(_class(_unpacked(c, "<i8")), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["class", "n"])

    sizes = singles.select("counts").mapInArrow(classes, "class bigint, n bigint").groupBy("class").agg(F.sum("n").alias("n"))
    cut = _cut({r["class"]: r["n"] for r in sizes.collect()}, most)  # eight classes for each doubling

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c in _rows(batches):
            n = _unpacked(c, "<i8")
            some = _class(n) >= cut
            yield pa.RecordBatch.from_arrays([pa.array([x[some].tobytes()], pa.binary()) for x in (_unpacked(k, "<u8"), n)], ["keys", "counts"])

    rows = singles.select("keys", "counts").mapInArrow(pick, "keys binary, counts binary").collect()
    return Vocabulary(np.concatenate([_EMPTY, *(np.frombuffer(r["keys"], "<u8") for r in rows)]), np.concatenate([np.empty(0, "<i8"), *(np.frombuffer(r["counts"], "<i8") for r in rows)]))


@dataclass
class Filter:
    """One bit for each value of a hash's first ``width`` bits, at most 64 MB: lets others pass, drops none that it holds."""

    bits: np.ndarray
    width: int

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.width)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _filter(keys: DataFrame, parts: int, widest: int = 29) -> Filter:
    """The filter of a column ``key``; blocks of it are made where their keys are."""
    width = min(widest, max(20, int(16 * keys.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - width)
            block = (at >> np.uint64(16)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            for k, rows in _edges(block[order]):
                held.setdefault(k, np.zeros(1 << 16, bool))[(at[order[rows]] & np.uint64(0xFFFF)).astype(np.int64)] = True
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    bits = np.zeros(1 << (width - 3), np.uint8)
    blocks = keys.select("key", F.expr(f"shiftrightunsigned(key, {64 - width + 16})").alias("block")).repartition(min(parts, 1 << (width - 16)), "block").select("key")
    # The blocks make up the filter: 64 MB at most reach the driver.
    for r in blocks.mapInArrow(run, "block bigint, bits binary").collect():
        bits[r["block"] << 13 : (r["block"] + 1) << 13] |= np.frombuffer(r["bits"], np.uint8)
    return Filter(bits, width)


_SEQUENCES = {"place": pa.int32(), "shard": pa.int64(), "codes": pa.binary(), "rare": pa.binary(), "counts": pa.binary()}


def count_sequences(tokens: DataFrame, level: int, held: Filter, words: Vocabulary, least: int, deal: Deal) -> DataFrame:
    """key, context, parent and n of the sequences of ``level + 1`` tokens counted ``least`` times or more.

    The context is the key without the last token, the parent that without the
    first. One whose context or parent ``held`` drops can't be counted so often.
    """
    shared = tokens.sparkSession.sparkContext.broadcast((held, words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, words = shared.value
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            # Of equal sequences the first place stands for all, in the tokens of all groups held.
            t = np.concatenate([f[0] for f in found])
            starts = np.cumsum([0, *(len(f[0]) for f in found[:-1])])
            k, first, n = np.unique(np.concatenate([f[1] for f in found]), return_index=True, return_counts=True)
            at = np.concatenate([f[2] + s for f, s in zip(found, starts, strict=True)])[first]
            ranks = words.encode(t)
            for s, some in _edges(_part(k, deal.shards)):
                yield _batch(_SEQUENCES, [(deal.place(s), s, *words.pack(t, ranks, at[some], level + 1), _packed(n[some].astype("<u4")))])

        for t in _training(batches):
            keys = t
            for _ in range(level - 1):
                keys = _joined(keys[:-1], keys[1:])
            # The context must hold no end, else it crosses texts.
            ends = np.concatenate([[0], np.cumsum(t == np.uint64(END))])
            inner = ends[level : len(t)] == ends[: len(t) - level]
            ok = test(keys)
            at = np.flatnonzero(ok[:-1] & ok[1:] & inner)
            found.append((t, _joined(keys[at], keys[at + 1]), at))
            size += len(t)
            if size >= FLUSH:
                yield from rows()
                found, size = [], 0
        if found:
            yield from rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, adder, held = shared.value[1], _Adder(4), None

        def kept() -> Iterator[pa.RecordBatch]:
            k, n, contexts, parents = adder.take()
            some = n >= least
            columns = [x[some] for x in (k, contexts, parents, n)]
            for i in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)].view(np.int64)) for x in columns], ["key", "context", "parent", "n"])

        for _, shard, codes, rare, c in _rows(batches):
            if shard != held:
                yield from kept()
                held = shard
            k, context, parent = _keys(words.unpack(codes, rare, level + 1))
            adder.add(k, _unpacked(c, "<u4"), context, parent)
            adder.full(FLUSH // 4)
        yield from kept()

    counted = tokens.select("tokens", "words").mapInArrow(count, "place int, shard bigint, codes binary, rare binary, counts binary")
    return deal.sent(counted).mapInArrow(merge, "key bigint, context bigint, parent bigint, n bigint")


def _look_up(rows: DataFrame, table: DataFrame, on: str, cut: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``table``, whose ``often`` counts tell frequent keys, which many rows may have: those are broadcast, the rest joined by key."""
    hot, cold = F.broadcast(table.where(F.col("often") >= cut).drop("often")), table.where(F.col("often") < cut).drop("often")
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(cold, on, how))


@dataclass
class Tree:
    """What every task holds: of a fixed size, whatever the corpus."""

    words: Vocabulary
    #: Frequent weights, and the filter of all others.
    cache: Slots
    rest: Filter
    total: int
    kinds: int
    depth: int

    def p0(self, counts: np.ndarray) -> np.ndarray:
        """The root: the share of a token with such a count, half a count added to each."""
        return (counts + 0.5) / (self.total + 0.5 * (self.kinds + 1))


def grow(tokens: DataFrame, singles: DataFrame, words: Vocabulary, tables: Tables, deal: Deal, *, total: int, kinds: int, depth: int, least_share: float, least_count: int, discount: float, strictness: float) -> DataFrame:
    """The weights (key, n, w) of all sequences and contexts that the tree keeps.

    With n a context's count, the divergence sum of n(x) * ln(p(x|c) / p(x|suffix))
    has to exceed ``strictness`` * ln(total) for each next token counted, else
    the suffix serves as well.
    """
    # What makes up this share of all tokens is broadcast in joins, at most 1 / least_share rows.
    cut = max(1, int(np.ceil(least_share * total)))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c in _rows(batches):
            k, n = _unpacked(k, "<i8"), _unpacked(c, "<i8")
            some = n >= least_count
            for i in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)][some[i : i + (1 << 16)]]) for x in (k, n)], ["key", "n"])

    spark = tokens.sparkSession
    _free(spark)
    before = tables.save(singles.select("keys", "counts").mapInArrow(plain, "key bigint, n bigint").withColumn("p", (F.col("n") + 0.5) / (total + 0.5 * (kinds + 1))))
    pieces = before.limit(0).select("key", "n", F.lit(0.0).alias("w"))
    for level in range(1, depth + 1):
        found = tables.save(count_sequences(tokens, level, _filter(before, deal.partitions), words, least_count, deal))
        if found.isEmpty():
            break
        found = _look_up(found, before.select(F.col("key").alias("context"), F.col("n").alias("context_n"), F.col("n").alias("often")), "context", cut)
        found = _look_up(found, before.select(F.col("key").alias("parent"), F.col("p").alias("parent_p"), F.col("n").alias("often")), "parent", cut)
        found = tables.save(found.withColumn("own", F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("context_n")))
        gain = F.col("n") * F.log(F.greatest("own", F.lit(1e-12)) / F.col("parent_p"))
        contexts = found.groupBy("context").agg(F.sum(gain).alias("gain"), F.count(F.lit(1)).alias("kinds"), F.sum("own").alias("own"), F.first("context_n").alias("often"))
        contexts = contexts.where(F.col("gain") > strictness * F.col("kinds") * float(np.log(max(2, total))))
        contexts = tables.save(contexts.select("context", F.greatest(1 - F.col("own"), F.lit(1e-9)).alias("left"), "often"))
        found = _look_up(found, contexts, "context", cut, "left")
        found = found.withColumn("p", F.coalesce(F.col("own") + F.col("left") * F.col("parent_p"), "parent_p"))
        before = tables.save(found.select("key", "n", "p", F.log10(F.col("p") / (F.col("left") * F.col("parent_p"))).alias("gain")))
        pieces = pieces.unionByName(before.where("gain IS NOT NULL").select("key", "n", F.col("gain").alias("w")))
        pieces = pieces.unionByName(contexts.select(F.col("context").alias("key"), F.col("often").alias("n"), F.log10("left").alias("w")))
        del found, contexts
        _free(spark)
    return tables.save(pieces.groupBy("key").agg(F.max("n").alias("n"), F.sum("w").alias("w")))


def _free(spark) -> None:
    """Shuffles of jobs that are done go from the disks when the driver collects what refers to them."""
    spark.sparkContext._jvm.System.gc()


def frequent_weights(weights: DataFrame, most: int = CACHE) -> tuple[Slots, DataFrame]:
    """A cache of at most ``most`` of the most frequent weights, and the table (key, w) of those that it doesn't hold."""
    level = F.floor(F.log2("n") * 8)
    cut = _cut({r["c"]: r["n"] for r in weights.groupBy(level.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}, most)  # eight classes for each doubling
    hot = weights.where(level >= cut).orderBy(F.desc("n"), "key").select("key", "w").toArrow()
    key, w = hot.column("key").to_numpy().view(np.uint64), hot.column("w").to_numpy()
    cache = Slots(key, w)
    out, cache.held = ~cache.held, None
    left = pa.table({"key": key[out].view(np.int64), "w": w[out]})
    return cache, weights.where(level < cut).select("key", "w").unionByName(weights.sparkSession.createDataFrame(left, "key bigint, w double"))


#: Rows of the last two rounds: tables first, then what asks for them; of a group of texts its own row first, then the answers.
TABLE, WEIGHTS, QUERY, ASKED, TEXTS, ANSWER = range(6)
_PARTS = {"place": pa.int32(), "name": pa.int64(), "kind": pa.int32(), **{c: pa.binary() for c in "abcdef"}}
PARTS = "place int, name bigint, kind int, a binary, b binary, c binary, d binary, e binary, f binary"


def score_texts(
    docs: DataFrame,
    train: DataFrame | Column,
    *,
    depth: int = 4,
    least_share: float = 4e-6,
    least_count: int = 8,
    discount: float = 0.75,
    strictness: float = 0.5,
    partitions: int | None = None,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``, learnt from ``train``.

    ``train`` is a table, or a condition on the rows of ``docs``; one that is null
    is false.

    base_score is the sum of log10((c + 0.5) / (N + 0.5 * (V + 1))) over the
    tokens, with c a token's count in the texts of ``train``, N their tokens and V
    the distinct ones; score is the sum of log10 probabilities in the tree. A word
    that ``train`` doesn't hold has the share of half a count, as one of its kind.

    Counts are dealt to as many ``partitions`` as their tokens need. Frequent
    tokens and weights are looked up in broadcast caches and never shuffled;
    others go to their partition, packed. The score doesn't depend on that but
    for the order in which numbers are added. Null texts count as empty, of the
    end alone. Null ids and repeated rows are scored as others; an empty table
    gives no rows, an empty ``train`` the score of unknown tokens; columns other
    than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    learnt = tables.save(tokenise(docs.where(train) if isinstance(train, Column) else train))
    deal = Deal.of(learnt.agg(F.sum("size")).first()[0] or 0, partitions)

    singles = tables.save(count_tokens(learnt, deal))
    total, kinds = singles.select("counts").mapInArrow(_sums, "total bigint, kinds bigint").agg(F.sum("total"), F.sum("kinds")).first()
    total, kinds = total or 0, kinds or 0
    words = vocabulary(singles)
    weights = grow(learnt, singles, words, tables, deal, total=total, kinds=kinds, depth=depth, least_share=least_share, least_count=least_count, discount=discount, strictness=strictness)
    tables.drop(learnt)
    cache, rest = frequent_weights(weights)
    rest = tables.save(rest)
    shared = spark.sparkContext.broadcast(Tree(words, cache, _filter(rest, deal.partitions), total, kinds, depth))
    _free(spark)
    answers = _asked(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), shared, deal).unionByName(_kept(singles, TABLE)).unionByName(_kept(_dealt(rest, deal), WEIGHTS))
    answers = answers.repartition(deal.partitions, "place").sortWithinPartitions("kind").mapInArrow(lambda b: _looked_up(b, shared.value), PARTS)
    merged = answers.repartition(deal.partitions, "name").sortWithinPartitions("name", "kind")
    return merged.mapInArrow(lambda b: _merged(b, total), "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (c,) in _rows(batches):
        n = _unpacked(c, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())], pa.int64()), pa.array([len(n)], pa.int64())], ["total", "kinds"])


def _kept(rows: DataFrame, kind: int) -> DataFrame:
    """Rows of a table (place, shard, keys, values) among those that ask for it."""
    return rows.toDF("place", "shard", "a", "b").select("place", F.lit(0).cast("bigint").alias("name"), F.lit(kind).alias("kind"), "a", "b", *(F.lit(None).cast("binary").alias(c) for c in "cdef"))


def _dealt(weights: DataFrame, deal: Deal) -> DataFrame:
    """Weights (key, w) as packed rows of their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> Iterator[pa.RecordBatch]:
            keys, w = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(keys)
            keys, w = keys[order], w[order]
            for s, at in _edges(_part(keys, deal.shards)):
                yield _batch(_COUNTED, [(deal.place(s), s, _packed(keys[at].astype("<u8")), _packed(w[at].astype("<f8")))])

        for b in batches:
            held.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()))
            if sum(len(h[0]) for h in held) >= FLUSH:
                yield from rows()
                held = []
        if held:
            yield from rows()

    return weights.select("key", "w").mapInArrow(run, COUNTED)


def _asked(docs: DataFrame, shared, deal: Deal) -> DataFrame:
    """What each task knows of its texts, and what it asks other partitions for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        for name, (ids, lengths, t) in enumerate(_texts(batches), TaskContext.get().partitionId() << 32):
            own, docs = np.repeat(np.arange(len(lengths)), lengths), len(lengths)
            ranks = tree.words.encode(t)
            known = ranks >= 0
            sums = lambda of, values: np.bincount(of, weights=values, minlength=docs)
            root = np.zeros(len(t))
            root[known] = np.log10(tree.p0(tree.words.counts[ranks[known]]))
            base = sums(own, root)
            score, asks = base.copy(), [(QUERY, 1, np.flatnonzero(~known), t[~known])]
            keys = t
            # No context holds an end, so the texts may follow each other.
            for n in range(1, tree.depth + 2):
                if n > 1:
                    keys = _joined(keys[:-1], keys[1:])
                hit, w = tree.cache(keys)
                score += sums(own[: len(keys)], w)
                at = np.flatnonzero(~hit)
                at = at[tree.rest(keys[at])]
                asks.append((ASKED, n, at, keys[at]))
            columns = (lengths.astype("<i8"), sums(own, known).astype("<i8"), base, score)
            rows = [(int(deal.labels[name % deal.partitions]), name, TEXTS, _nullable(ids), *(c.tobytes() for c in columns), None)]
            for kind, n, at, keys in asks:
                part = _part(keys, deal.partitions)
                order = np.argsort(part, kind="stable")
                for p, some in _edges(part[order]):
                    places = at[order[some]]
                    rows.append((int(deal.labels[p]), name, kind, *tree.words.pack(t, ranks, places, n), _packed(own[places].astype("<u4")), bytes([n]), None, None))
            yield _batch(_PARTS, rows)

    return docs.mapInArrow(run, PARTS)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, -1 where it isn't."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


#: Sequences looked up at a time.
AT_ONCE = 1 << 18


def _looked_up(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """A partition's counts and weights, then the sequences that ask for them; gives sums by text."""
    held: dict[int, list] = {TABLE: [], WEIGHTS: []}
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    value: Callable[[bytes, int], np.ndarray] = lambda data, kind: _unpacked(data, "<i8" if kind == TABLE else "<f8")
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    names: dict[int, int] = {}
    asks = 0

    def answered(kind: int, place: int) -> pa.RecordBatch | None:
        keys, own = map(np.concatenate, zip(*waiting, strict=True))
        table, values = tables[TABLE if kind == QUERY else WEIGHTS]
        at = _find(table, keys)
        if kind == ASKED:
            own, at = own[at >= 0], at[at >= 0]
        got = np.where(at >= 0, values[at], 0) if len(values) else np.zeros(len(at))
        texts, where = np.unique(own, return_inverse=True)
        score = np.bincount(where, weights=np.log10(tree.p0(got)) if kind == QUERY else got)
        known = np.bincount(where, weights=at >= 0).astype("<u4")
        order = list(names)
        rows = [
            (place, order[n], ANSWER, _packed((texts[some] & 0xFFFFFFFF).astype("<u4")), score[some].astype("<f8").tobytes(), _packed(known[some]) if kind == QUERY else None, None, None, None)
            for n, some in _edges(texts >> 32)
        ]
        return _batch(_PARTS, rows) if rows else None

    last = None
    for place, name, kind, a, b, c, d, e, f in _rows(batches):
        if kind in held:
            held[kind].append((_unpacked(a, "<u8"), value(b, kind)))
            continue
        if not tables:
            for k, parts in held.items():
                keys, values = map(np.concatenate, zip(*parts, strict=True)) if parts else (_EMPTY, np.empty(0))
                order = np.argsort(keys)
                tables[k] = keys[order], values[order]
            held = {TABLE: [], WEIGHTS: []}
        if waiting and (kind != last or asks >= AT_ONCE):
            if (out := answered(last, place)) is not None:
                yield out
            waiting, names, asks = [], {}, 0
        last = kind
        if kind == TEXTS:
            yield _batch(_PARTS, [(place, name, TEXTS, a, b, c, d, e, f)])
            continue
        n = d[0]
        sequences = tree.words.unpack(a, b, n)
        waiting.append((sequences[0] if n == 1 else _keys(sequences)[0], _unpacked(c, "<u4").astype(np.int64) + (names.setdefault(name, len(names)) << 32)))
        asks += len(waiting[-1][0])
    if waiting and (out := answered(last, place)) is not None:
        yield out


def _merged(batches: Iterator[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    """The texts of each group with the sums of all partitions; rows come sorted by group, its own row first."""
    held, state = None, None

    def done() -> pa.RecordBatch:
        ids, n, known, base, score = state
        return pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in (n, known, np.full(len(n), total), base, score))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    for _, name, kind, a, b, c, d, e, _f in _rows(batches):
        if name != held:
            if state:
                yield done()
            held, state = name, None
        if kind == TEXTS:
            state = [pa.ipc.open_stream(a).read_next_batch().column(0), np.frombuffer(b, "<i8"), *(np.frombuffer(x, k).copy() for x, k in ((c, "<i8"), (d, "<f8"), (e, "<f8")))]
            continue
        texts, sums = _unpacked(a, "<u4"), np.frombuffer(b, "<f8")
        state[4][texts] += sums
        if c is not None:
            state[3][texts] += sums
            state[2][texts] += _unpacked(c, "<u4")
    if state:
        yield done()
