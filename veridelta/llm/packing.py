"""Hierarchical multi-length packing of token streams into training sequences."""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Cached, byte_characters, column, pieces

#: The pre-tokenizer's pattern, fixed by the tokenizer's file.
WORD_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, sequence_tokens bigint, tier int, step_group bigint"
)

#: Words whose ids a worker keeps.
WORDS = 400_000

#: Printable Latin-1 without the no-break space.
PLAIN = re.compile(r"[!-~\xa1-\xff]+").fullmatch


class WordIds:
    """Token ids of a text as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space before it looks for tokens, so ids of words
    between ASCII white space, cached and joined, are the ids of the text. Words
    of Latin-1 characters, where lower-casing and normal form hold no surprise,
    are cut by ``WORD_PARTS`` and their parts merged one by one; any other word,
    and one that may hold a special token, goes through the whole library.
    """

    def __init__(self, path: str, words: int = WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids = Cached(self._word, words)
        self.parts = Cached(self._part, words * 3 // 4)
        self.spelled = str.maketrans({chr(b): c for c, b in byte_characters().items()})
        self.merge = self.tokenizer.model.tokenize
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.spelled)
        return b"".join([t.id.to_bytes(4, "little") for t in self.merge(spelled)])

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isalpha() and max(text) <= "\xff":
            return self.parts[text.lower()]
        if text[:-1].isalpha() and text[-1] in ".,!?;:" and max(text) <= "\xff":
            return self.parts[text[:-1].lower()] + self.parts[text[-1]]
        if PLAIN(text) and not any(s in text for s in self.special):
            return b"".join(map(self.parts.__getitem__, WORD_PARTS.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: bytes) -> bytes:
        return b"".join(b"".join(map(self.ids.__getitem__, part.split())) for part in pieces(text))


@lru_cache(2)
def word_ids(path: str, words: int = WORDS) -> WordIds:
    """One for each worker process and file, so that its caches serve all its tasks."""
    return WordIds(path, words)


class _Piece:
    """A run of a document's ids, as a view of its bytes, so that cutting copies nothing."""

    __slots__ = ("doc_id", "doc_tokens", "ids", "start")

    def __init__(self, doc_id, start: int, ids: bytes | memoryview, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc_id, self.start, self.ids[: 4 * n], self.doc_tokens), _Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.doc_tokens)


class TierPacker:
    """Packs one stream of documents; holds at most about ``buffer`` tokens.

    Windows of ``tiers[-1]`` come straight from long documents. What remains of a
    document waits in the shortest tier that holds it. A window of a tier is
    filled with whole remainders of that tier, its gap with whole ones of shorter
    tiers, and the last gap by cutting one; so windows are full. At the end all
    that waits is packed into windows of falling powers of two.
    """

    def __init__(self, tiers: tuple[int, ...], buffer: int, group_tokens: int, base: int):
        self.tiers, self.buffer, self.group_tokens, self.base = tiers, buffer, group_tokens, base
        self.wait = {t: deque() for t in tiers}
        self.held = 0
        self.sequences = 0
        self.groups: dict[int, list[int]] = {}
        self.n_groups = 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        top, n = self.tiers[-1], len(ids) // 4
        rest = _Piece(doc_id, 0, memoryview(ids), n)
        while len(rest) >= top:
            full, rest = rest.cut(top)
            yield from self._emit([full], top)
        self._queue(rest)
        while self.held > self.buffer:
            yield from self._window(self._fullest())

    def end(self) -> Iterator[tuple]:
        while self.held:
            size = self.tiers[-1]
            while size > self.held:
                size //= 2
            yield from self._window(size)

    def _queue(self, piece: _Piece) -> None:
        if len(piece):
            piece.ids = bytes(piece.ids)  # what waits doesn't hold a whole document
            self.wait[next(t for t in self.tiers if len(piece) <= t)].append(piece)
            self.held += len(piece)

    def _fullest(self) -> int:
        sums = {t: sum(map(len, self.wait[t])) for t in self.tiers}
        best = max(self.tiers, key=lambda t: (sums[t], t))
        while best not in self.tiers or sum(s for t, s in sums.items() if t <= best) < best:
            best = next(t for t in self.tiers if t > best)
        return best

    def _window(self, size: int) -> Iterator[tuple]:
        room, taken = size, []
        for tier in reversed([t for t in self.tiers if t <= size]):
            queue, later = self.wait[tier], []
            while queue and room:
                piece = queue.popleft()
                if len(piece) <= room:
                    taken.append(piece)
                    room -= len(piece)
                else:
                    later.append(piece)
                    if len(later) >= 64:
                        break
            queue.extendleft(reversed(later))
        while room:
            # A gap is left: the shortest waiting piece that is longer than it is cut.
            piece = next(self.wait[t].popleft() for t in self.tiers if self.wait[t])
            if len(piece) > room:
                head, tail = piece.cut(room)
                self.held -= len(tail)
                self._queue(tail)
                piece = head
            taken.append(piece)
            room -= len(piece)
        self.held -= size
        yield from self._emit(taken, size)

    def _emit(self, taken: list[_Piece], size: int) -> Iterator[tuple]:
        group = self.groups.get(size)
        if group is None or group[1] + size > self.group_tokens:
            group = self.groups[size] = [self.n_groups, 0]
            self.n_groups += 1
        group[1] += size
        at, name = 0, self.base + self.sequences
        self.sequences += 1
        for p in taken:
            yield p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, name, at, size, size, self.base + group[0], p.ids
            at += len(p)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    end_id: int = 1,
    tiers: tuple[int, ...] = (256, 512, 1024, 2048),
    buffer: int = 1 << 18,
    group_tokens: int = 16 * 2048,
    with_ids: bool = True,
    cached_words: int = WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document in a sequence; needs no shuffle.

    Each input partition is packed as a stream, so memory doesn't grow with the
    data and a lost task is repeated alone. Sequences are full, their lengths
    powers of two, at most ``tiers[-1]``; ``tier`` is that length. Sequences of a
    tier are dealt to ``step_group`` until it has ``group_tokens`` tokens, so
    groups of a training step weigh the same. A worker keeps the ids of up to
    ``cached_words`` words, also while other stages run in it.

    Null texts count as empty: such a document is its end token. Null ids and
    repeated rows are packed like others. An empty table gives no rows. Columns
    other than the two named are ignored. Very long texts are cut into windows.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be rising powers of two")
    end = np.array([end_id], "<u4").tobytes()
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer, cached_words)
        packer = TierPacker(tiers, buffer, group_tokens, TaskContext.get().partitionId() << 40)
        types = [pa.int64()] * 8 + [pa.int32(), pa.int64()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(cols[:10], types, strict=True)]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in cols[10]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

        rows: list[tuple] = []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), column(b, "text"), strict=True):
                for row in packer.add(doc_id, encode(text) + end):
                    rows.append(row)
                    if len(rows) >= 2000:
                        yield batch(rows)
                        rows = []
        rows.extend(packer.end())
        if rows:
            yield batch(rows)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, schema)
