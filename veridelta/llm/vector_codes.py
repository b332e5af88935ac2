"""Product quantisation of vectors: a codebook for each part, fitted by Lloyd's rounds that skip distances by Elkan's bounds.

Each row carries, between rounds, an upper bound of the distance of every part to
its entry and a lower bound of its distance to each entry. When entries move,
bounds move with them; an entry is looked at only if its bounds don't prove that
it is strictly farther. What is looked at is compared in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Tables
from ._vectors import CHUNK, first_vectors, long_sum, packed, unpacked, whole_vectors
from .centroid_clustering import digest

RESULT = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"

#: Bounds are kept in 16 bits, in units of 1 / STEP. The greatest upper bound says nothing; lower bounds end below it.
STEP = 8
NO_BOUND = 65535
#: Far above what a square root of such numbers is off by.
_GUARD = 1e-6


def at_most(d: np.ndarray) -> np.ndarray:
    """Lower bounds, in units, of distances whose squares are given."""
    return np.clip(np.floor(STEP * np.sqrt(d.astype(np.float64)) - _GUARD), 0, NO_BOUND - 1).astype(np.int64)


def at_least(d: np.ndarray) -> np.ndarray:
    """Upper bounds, in units, of distances whose squares are given."""
    return np.minimum(np.ceil(STEP * np.sqrt(d.astype(np.float64)) + _GUARD), NO_BOUND).astype(np.int64)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every entry."""
    d = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        off = x[:, i, None] - entries[None, :, i]
        d += off * off
    return d


class Books:
    """Codebooks (parts, entries, width), how far each entry moved at last, and half the distance of each two."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        off = entries - (entries if before is None else before)
        self.moved = at_least((off * off).sum(axis=2)) if before is not None else None
        # No entry within this of the one at hand can be as near as it is.
        self.half = np.stack([at_most(squares(e, e)) // 2 for e in entries])
        own = np.arange(entries.shape[1])
        others = self.half.copy()
        others[:, own, own] = NO_BOUND - 1
        self.nearest_half = others.min(axis=2)


def assign_all(x: np.ndarray, books: Books) -> tuple[np.ndarray, ...]:
    """Entry of each part, its squared distance, and upper and lower bounds, of rows (n, parts, width)."""
    n, parts, _ = x.shape
    k = books.entries.shape[1]
    code, best, lower = np.empty((n, parts), np.uint8), np.empty((n, parts), np.int64), np.empty((n, parts, k), np.uint16)
    for p in range(parts):
        d = squares(x[:, p], books.entries[p])
        code[:, p] = d.argmin(axis=1)
        best[:, p] = d.min(axis=1)
        lower[:, p] = at_most(d)
    return code, best, at_least(best).astype(np.uint16), lower


def assign_again(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: Books) -> tuple[np.ndarray, ...]:
    """The same after a move, from the bounds before it; and how many distances were computed.

    An entry is passed over only if it is strictly farther than the one at hand:
    its lower bound, or half its distance to that one, is above the upper bound.
    """
    code, best, shifted, low = code.copy(), np.empty(code.shape, np.int64), np.empty(code.shape, np.uint16), np.empty(lower.shape, np.uint16)
    looked = 0
    for p in range(x.shape[1]):
        entries, moved = books.entries[p], books.moved[p]
        a = code[:, p].astype(np.int64)
        off = x[:, p] - entries[a]
        d = (off * off).sum(axis=1)  # the error needs it, and it makes the bound tight
        l = np.maximum(lower[:, p].astype(np.int64) - moved, 0)
        u = np.minimum(upper[:, p].astype(np.int64) + moved[a], NO_BOUND)
        open_ = np.nonzero(u >= books.nearest_half[p][a])[0]
        tight = at_least(d[open_])
        bounded = (l[open_] > tight[:, None]) | (books.half[p][a[open_]] > tight[:, None])
        bounded[np.arange(len(open_)), a[open_]] = True
        row, entry = np.nonzero(~bounded)
        row = open_[row]
        off = x[row, p] - entries[entry]
        far = (off * off).sum(axis=1)
        l[row, entry] = at_most(far)
        looked += len(row) + len(x)
        # The least (distance, entry) of what was looked at and the entry at hand.
        everything = np.full((len(open_), len(entries)), np.iinfo(np.int64).max)
        everything[np.searchsorted(open_, row), entry] = far
        everything[np.arange(len(open_)), a[open_]] = d[open_]
        l[np.arange(len(x)), a] = at_most(d)
        to = everything.argmin(axis=1)
        code[open_, p] = to
        d[open_] = everything[np.arange(len(open_)), to]
        best[:, p], shifted[:, p], low[:, p] = d, at_least(d), l
    return code, best, shifted, low, looked


def rows(packed_rows, parts: int, width: int) -> np.ndarray:
    """The parts of packed vectors, as 64-bit numbers."""
    return unpacked(packed_rows, "<i4", parts * width).astype(np.int64).reshape(-1, parts, width)


class Coder:
    """Codes of a table of vectors: each round writes codes and bounds to the shared folder and reads them from there."""

    def __init__(self, tables: Tables, parts: int, width: int):
        self.tables, self.parts, self.width = tables, parts, width

    def begin(self, vectors: DataFrame, books: Books, more: list[str]) -> DataFrame:
        """vec_id, the columns ``more``, v, code, upper, lower and error, from all distances."""
        return self._state(vectors, books, more, first=True)

    def again(self, state: DataFrame, books: Books, more: list[str]) -> DataFrame:
        """The same for moved entries, from bounds; the state before goes."""
        out = self._state(state, books, more, first=False)
        self.tables.drop(state)
        return out

    def _state(self, df: DataFrame, books: Books, more: list[str], first: bool) -> DataFrame:
        parts, width = self.parts, self.width
        sent = df.sparkSession.sparkContext.broadcast(books)
        carried = ["vec_id", *more, "v"]
        read = df.select(*carried, *([] if first else ["code", "upper", "lower"]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = sent.value
            k = books.entries.shape[1]
            for b in batches:
                for part in (b.slice(i, CHUNK) for i in range(0, b.num_rows, CHUNK)):
                    got = {c: part.column(i).to_pylist() for i, c in enumerate(part.schema.names) if c in ("v", "code", "upper", "lower")}
                    x = rows(got["v"], parts, width)
                    if first:
                        code, best, upper, lower = assign_all(x, books)
                    else:
                        code, best, upper, lower, _ = assign_again(x, unpacked(got["code"], "u1", parts), unpacked(got["upper"], "<u2", parts), unpacked(got["lower"], "<u2", parts * k).reshape(-1, parts, k), books)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[: len(carried)], packed(code), packed(upper.astype("<u2")), packed(lower.astype("<u2").reshape(len(lower), -1)), pa.array(best.sum(axis=1))],
                        [*carried, "code", "upper", "lower", "error"],
                    )

        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema[: len(carried)])
        return self.tables.save(read.mapInArrow(run, kept + ", code binary, upper binary, lower binary, error bigint"))

    def move(self, state: DataFrame, books: Books) -> Books:
        """Entries at the floored means of their parts; unused ones stay. A row per partition and entry is shuffled."""
        parts, k, width = books.entries.shape
        columns = ["n", *(f"s{i}" for i in range(width))]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
            for df in frames:
                for part in (df.iloc[i : i + CHUNK] for i in range(0, len(df), CHUNK)):
                    at = (unpacked(part["code"], "u1", parts).astype(np.int64) + np.arange(parts) * k).ravel()
                    np.add.at(total, at, rows(part["v"], parts, width).reshape(-1, width))
                    n += np.bincount(at, minlength=parts * k)
            used = np.nonzero(n)[0]
            yield pd.DataFrame({"entry": used, "n": n[used]} | {f"s{i}": total[used, i] for i in range(width)})

        each = state.select("v", "code").mapInPandas(run, "entry int, " + ", ".join(f"{c} bigint" for c in columns))
        entries = books.entries.reshape(parts * k, width).copy()
        for r in each.groupBy("entry").agg(*(F.sum(c).alias(c) for c in columns)).collect():
            entries[r.entry] = [s // r.n for s in r[2:]]
        return Books(entries.reshape(parts, k, width), books.entries)


#: Labels of which the sums are sent to all tasks; beyond, they are joined.
FEW = 100_000
_SALTS = 16


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded (vec_id, label, code, error) with label_error, the sum of errors over equal labels, nulls together."""
    tables = Tables(coded.sparkSession)
    totals = tables.save(coded.groupBy("label").agg(long_sum("error").alias("label_error")))
    totals = totals.withColumnRenamed("label", "_label")
    if totals.count() <= FEW:
        return coded.join(F.broadcast(totals), coded["label"].eqNullSafe(totals["_label"]))
    # A label may hold a third of all rows: each is dealt to some tasks.
    salted = coded.withColumn("_salt", (F.xxhash64("vec_id") % _SALTS + _SALTS) % _SALTS)
    totals = totals.withColumn("_salt_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_SALTS - 1).cast("bigint"))))
    return salted.join(totals, salted["label"].eqNullSafe(totals["_label"]) & (salted["_salt"] == totals["_salt_"]))


def encode_vectors(
    df: DataFrame,
    *,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    dims: int = 64,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Kept are vectors of ``dims`` components, none null or not finite; a component
    x counts as floor(scale * x). They are cut into ``parts`` equal parts. The
    codebook of a part starts as that part of the ``entries`` kept vectors with
    the least ids; after ``rounds`` of assigning and moving, parts are assigned
    once more. Distances are squared and exact; ties go to the lower entry.

    Codes and bounds are a table of 2 bytes per part and entry, about eight times
    the vectors before compression, written anew each round; the one before is
    deleted. What a round shuffles is a row per partition and entry.

    Null and other vectors, also those of another length than ``dims``, which
    can't be compared part by part, are left out. A null id is kept, but is never
    one of the least; equal ids are told apart by their vectors there. With fewer
    than ``entries`` kept vectors codebooks have as many entries; with none there
    are no rows. Components beyond 2^27 in size (for 64 of them) count as that
    bound, sums past 64 bits as the greatest number. Null labels count as equal.
    Other columns are ignored.
    """
    if dims % parts or entries > 256:
        raise ValueError("dims must be a multiple of parts, and entries at most 256")
    spark: SparkSession = df.sparkSession
    tables, width = Tables(spark), dims // parts
    vectors = tables.save(whole_vectors(df, id_col, vector_col, dims, scale, label=F.col(label_col)))
    start = first_vectors(vectors.where("vec_id IS NOT NULL"), entries, F.col("vec_id")) or first_vectors(vectors, entries)
    if not start:
        return spark.createDataFrame([], RESULT)
    books = Books(np.ascontiguousarray(unpacked(start, "<i4", dims).astype(np.int64).reshape(-1, parts, width).transpose(1, 0, 2)))
    coder = Coder(tables, parts, width)
    state = coder.begin(vectors, books, ["label"])
    tables.drop(vectors)
    for _ in range(rounds):
        books = coder.move(state, books)
        state = coder.again(state, books, ["label"])
    coded = with_label_error(state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books.entries)).alias("codebooks_sha256"))
