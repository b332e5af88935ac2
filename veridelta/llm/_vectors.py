"""Vectors as whole numbers, packed in bytes between Spark and NumPy."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are worked on at a time.
CHUNK = 2048


def bound(dims: int) -> int:
    """The largest component, a power of two, at which a squared distance of two vectors fits into 63 bits."""
    return 1 << ((62 - math.ceil(math.log2(dims))) // 2 - 1)


def whole(col: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have ``dims`` finite components, and their components as whole numbers.

    A component x becomes floor(scale * x); beyond ``bound(dims)`` it stays at that bound.
    """
    at = np.nonzero(pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False) == dims)[0]
    x = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dims)
    fine = np.isfinite(x).all(axis=1)
    most = bound(dims)
    with np.errstate(over="ignore"):
        return at[fine], np.clip(np.floor(x[fine] * scale), -most, most).astype("<i4")


def packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, width * len(rows) + 1, width, dtype=np.int32) if width else np.zeros(len(rows) + 1, np.int32)), pa.py_buffer(rows)])


def unpacked(values: Sequence[bytes], kind: str, width: int) -> np.ndarray:
    """Rows of ``width`` numbers from the bytes of each."""
    return np.frombuffer(b"".join(values), kind).reshape(-1, width)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int, **more: Column) -> DataFrame:
    """vec_id, the columns ``more`` and v (components as little-endian 32-bit numbers) of the rows whose vector is whole."""
    chosen = df.select(F.col(vector_col).cast("array<double>").alias("v"), F.col(id_col).cast("bigint").alias("vec_id"), *(c.alias(n) for n, c in more.items()))
    rest = chosen.schema[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, CHUNK) for i in range(0, b.num_rows, CHUNK)):
                at, x = whole(part.column(0), dims, scale)
                kept = [part.column(i).take(pa.array(at)) for i in range(1, part.num_columns)]
                yield pa.RecordBatch.from_arrays([*kept, packed(x)], [*part.schema.names[1:], "v"])

    return chosen.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["v binary"]))


def first_vectors(vectors: DataFrame, n: int, *order: Column) -> list[bytes]:
    """The bytes of the first ``n`` vectors in an order; equal ones by their bytes."""
    return [bytes(r.v) for r in vectors.select("v", *(c.alias(f"_{i}") for i, c in enumerate(order))).orderBy(*(F.col(f"_{i}").asc_nulls_last() for i in range(len(order))), "v").limit(n).collect()]


def long_sum(col: str) -> Column:
    """A sum of whole numbers, exact; the greatest 64-bit number where it doesn't fit."""
    return F.least(F.sum(F.col(col).cast("decimal(20,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint")
