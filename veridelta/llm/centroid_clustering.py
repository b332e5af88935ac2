"""Lloyd's clustering of vectors of whole numbers: exact, and the same however the rows are dealt."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Tables
from ._vectors import CHUNK, first_vectors, unpacked, whole_vectors

RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid, the smaller one of equals, and the squared distance."""
    d = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        off = x - c
        d[:, j] = np.einsum("ij,ij->i", off, off)
    at = d.argmin(axis=1)  # the first of equals
    return at, d[np.arange(len(x)), at]


def chunks(frames: Iterator[pd.DataFrame], dims: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Slices of the frames with their vectors as 64-bit numbers."""
    for df in frames:
        for i in range(0, len(df), CHUNK):
            part = df.iloc[i : i + CHUNK]
            yield part, unpacked(part["v"], "<i4", dims).astype(np.int64)


def sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n and the sums s0, s1, ... of each cluster's components: one row per partition and cluster, merged by cluster."""
    k, dims = centroids.shape
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x in chunks(frames, dims):
            at, _ = nearest(x, sent.value)
            np.add.at(total, at, x)
            n += np.bincount(at, minlength=k)
        used = np.nonzero(n)[0]
        yield pd.DataFrame({"cluster": used, "n": n[used]} | {f"s{i}": total[used, i] for i in range(dims)})

    columns = ["n", *(f"s{i}" for i in range(dims))]
    each = vectors.select("v").mapInPandas(run, "cluster int, " + ", ".join(f"{c} bigint" for c in columns))
    return each.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in columns))


def fit(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after ``rounds`` of assigning every vector and moving centroids to floored means; unused ones stay.

    The driver holds the centroids and one row of sums for each.
    """
    for _ in range(rounds):
        moved = centroids.copy()
        for r in sums(vectors, centroids).collect():
            moved[r.cluster] = [s // r.n for s in r[2:]]
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in chunks(frames, centroids.shape[1]):
            at, d = nearest(x, sent.value)
            yield pd.DataFrame({"vec_id": part["vec_id"].astype("Int64"), "cluster": at, "distance": d})

    return vectors.select("vec_id", "v").mapInPandas(run, "vec_id bigint, cluster int, distance bigint")


def digest(numbers: np.ndarray) -> str:
    """SHA-256 of whole numbers in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, numbers.ravel().tolist())).encode()).hexdigest()


def cluster_vectors(
    df: DataFrame,
    *,
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    salt: str = "2",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dims`` components, none null or not finite;
    a component x counts as floor(scale * x). The first centroids are the ``k``
    kept vectors with the least SHA-256 of ``salt:id``. Distances are squared
    and exact; ties go to the smaller cluster number.

    Vectors are packed once into a table in the shared folder, which every round
    reads; what a round shuffles is a row per partition and cluster, so a value
    that many rows share is no hot key. A lost task is repeated alone.

    Null or other vectors are left out. A null id is kept like others, but comes
    last among the first centroids; repeated ids are told apart by their vectors
    there, and each row has its own result. With fewer than ``k`` kept vectors
    there are as many clusters; with none, no rows. Components beyond 2^27 in
    size (for 64 of them) count as that bound, and a sum of distances past the
    range of 64 bits as the greatest number. Other columns are ignored.
    """
    spark: SparkSession = df.sparkSession
    tables = Tables(spark)
    vectors = tables.save(whole_vectors(df, id_col, vector_col, dims, scale))
    start = first_vectors(vectors, k, F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256))
    if not start:
        return spark.createDataFrame([], RESULT)
    centroids = fit(vectors, unpacked(start, "<i4", dims).astype(np.int64), rounds)
    found = tables.save(assign(vectors, centroids))
    tables.drop(vectors)
    # A row a cluster, at most k.
    totals = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()
    most = (1 << 63) - 1
    inertia = min(most, sum(int(r.total) for r in totals))
    each = spark.createDataFrame([(r.cluster, min(most, int(r.total)), inertia, digest(centroids[r.cluster])) for r in totals], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select(*(c.split()[0] for c in RESULT.split(", ")))
