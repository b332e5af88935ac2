"""Tokenising helpers that run inside Arrow-batched workers.

Memory is bounded by design: a text is cut at white space into pieces of about
``PIECE`` bytes before it is split into Python objects, and only eight bytes a
word are kept of it; caches are emptied when they reach ``CACHE`` entries or
``CACHE_BYTES`` bytes of keys, and don't hold long keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE = 1 << 20
CACHE = 300_000
CACHE_BYTES = 16 << 20
#: Longer keys are rare, and made anew each time.
LONGEST_KEY = 1 << 10

#: Maps every ASCII byte that is no letter or digit to a space.
ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

_SPACE = b" \t\n\x0b\x0c\r"


class Cached(dict):
    """Values of ``make`` by key, a text or bytes; emptied when full, so its size is bounded."""

    def __init__(self, make: Callable, limit: int = CACHE):
        super().__init__()
        self.make, self.limit, self.bytes = make, limit, 0

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.make(key)
        self.bytes += len(key)
        if len(self) >= self.limit or self.bytes > CACHE_BYTES:
            self.clear()
            self.bytes = len(key)
        value = self[key] = self.make(key)
        return value


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 bytes stand for themselves; the others, in order, for the characters from U+0100.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def groups(batch: pa.RecordBatch, name: str = "text", most: int = PIECE) -> Iterator[list[bytes]]:
    """The UTF-8 bytes of a string column, in consecutive lists of about ``most`` bytes; null counts as empty.

    Only one list is held as Python objects at a time.
    """
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(col), 0).to_pylist()):
        if total and total + n > most:
            yield [x or b"" for x in col.slice(start, i - start).to_pylist()]
            start, total = i, 0
        total += n + 1
    if start < len(col):
        yield [x or b"" for x in col.slice(start).to_pylist()]


def column(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, one by one; null counts as empty."""
    for group in groups(batch, name):
        yield from group


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """Cut ``text`` after white space into pieces of about ``size`` bytes; a longer word stays whole."""
    at, n = 0, len(text)
    while n - at > size:
        cut = at + size
        while cut < n and text[cut] not in _SPACE:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


class WordHasher:
    """64-bit xxHash of each word of a text."""

    def __init__(self, table: bytes | None = None, lower: bool = True):
        self.table, self.lower = table, lower
        self.of = Cached(xxhash.xxh64_intdigest, 50_000)

    def __call__(self, text: bytes) -> np.ndarray:
        out = []
        for part in pieces(text if self.table is None else text.translate(self.table)):
            words = (part.lower() if self.lower else part).split()
            out.append(np.fromiter(map(self.of.__getitem__, words), np.uint64, len(words)))
        return out[0] if len(out) == 1 else np.concatenate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied in place on a fresh array."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def seeds(n: int, of: str) -> np.ndarray:
    """``n`` fixed odd 64-bit constants that depend on a name only."""
    return np.array([xxhash.xxh64_intdigest(f"{of}:{i}") | 1 for i in range(n)], np.uint64)


def shingles(words: np.ndarray, k: int, factors: np.ndarray) -> np.ndarray:
    """Distinct hashes of ``k`` consecutive words, sorted; all words as one where there are fewer; empty without words."""
    if not len(words):
        return words
    if len(words) < k:
        # Sums of arrays wrap around silently.
        return mix((words * factors[: len(words)]).sum(keepdims=True) + np.uint64(len(words)) * factors[k : k + 1])
    n = len(words) - k + 1
    h = words[:n] * factors[0]
    for i in range(1, k):
        h += words[i : i + n] * factors[i]
    return np.unique(mix(h))
