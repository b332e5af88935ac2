"""Clusters and codes of vectors against plain loops over whole numbers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tests.compare import same
from tests.llm.test_llm import docs, none, odd, shipped  # noqa: F401
from veridelta.llm import centroid_clustering, queries, vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, cluster int"


def lloyd(rows, start, rounds):
    """Centroids and assignments of plain Lloyd over lists of whole numbers."""
    centroids = [list(c) for c in start]
    near = lambda x: min(range(len(centroids)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(x, centroids[j], strict=True)), j))
    for _ in range(rounds):
        groups = defaultdict(list)
        for x in rows:
            groups[near(x)].append(x)
        for j, g in groups.items():
            centroids[j] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    at = [near(x) for x in rows]
    return centroids, at, [sum((a - b) ** 2 for a, b in zip(x, centroids[j], strict=True)) for x, j in zip(rows, at, strict=True)]


def vectors(n, dims, seed, grid=4):
    """Coarse values, so that many distances are equal; a third are one vector."""
    rnd = random.Random(seed)
    same_one = [rnd.randrange(-grid, grid) / 16 for _ in range(dims)]
    return [(i, same_one if i % 3 == 0 else [rnd.randrange(-grid, grid) / 16 for _ in range(dims)], rnd.choice([None, 0, 0, 1, 2]), "x", 1) for i in range(n)]


ODD = [(None, [0.25] * 8, 1, "", 0), (7, None, 1, "", 0), (8, [], 1, "", 0), (9, [0.5] * 7, 1, "", 0), (10, [0.5] * 9, 1, "", 0), (11, [None, *[0.5] * 7], 1, "", 0), (12, [math.nan, *[0.5] * 7], 1, "", 0), (13, [math.inf, *[0.5] * 7], 1, "", 0), (14, [3e38, *[0.5] * 7], None, "", 0), (3, [0.125] * 8, 2, "", 0), (3, [0.125] * 8, 2, "", 0)]


def kept(rows, dims, scale=256):
    most = 1 << ((62 - math.ceil(math.log2(dims))) // 2 - 1)
    return [(i, [max(-most, min(most, math.floor(scale * x))) for x in v], label) for i, v, label, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]


@pytest.mark.parametrize("rows", [vectors(300, 8, 1), vectors(6, 8, 2), vectors(120, 8, 3) + ODD], ids=["ties", "few", "odd"])
def test_clusters_against_plain_lloyd(shipped, rows):  # noqa: F811
    df = shipped.createDataFrame(rows, SCHEMA).repartition(5)
    got = centroid_clustering.cluster_vectors(df, k=10, rounds=3, dims=8).collect()
    want = kept(shipped.createDataFrame(rows, SCHEMA).collect(), 8)  # as floats
    order = sorted(want, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centroids, at, d = lloyd([v for _, v, _ in want], [v for _, v, _ in order[:10]], 3)
    per = defaultdict(int)
    for j, x in zip(at, d, strict=True):
        per[j] += x
    clip = lambda x: min(x, (1 << 63) - 1)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    expected = [(i, j, x, clip(per[j]), clip(sum(d)), sha[j]) for (i, _, _), j, x in zip(want, at, d, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("rows", [vectors(400, 8, 4), vectors(5, 8, 5), vectors(100, 8, 6, grid=200) + ODD], ids=["ties", "few", "odd"])
@pytest.mark.parametrize("few", [100_000, 1])
def test_codes_against_plain_lloyd(shipped, monkeypatch, rows, few):  # noqa: F811
    monkeypatch.setattr(vector_codes, "FEW", few)
    df = shipped.createDataFrame(rows, SCHEMA).repartition(5)
    got = vector_codes.encode_vectors(df, parts=4, entries=16, rounds=3, dims=8).collect()
    want = kept(shipped.createDataFrame(rows, SCHEMA).collect(), 8)
    start = sorted((r for r in want if r[0] is not None), key=lambda r: (r[0], np.array(r[1], "<i4").tobytes()))[:16]
    codes, errors, books = [[] for _ in want], [0] * len(want), []
    for p in range(4):
        cut = slice(2 * p, 2 * p + 2)
        centroids, at, d = lloyd([v[cut] for _, v, _ in want], [v[cut] for _, v, _ in start], 3)
        books += [x for c in centroids for x in c]
        for n, (j, x) in enumerate(zip(at, d, strict=True)):
            codes[n].append(j)
            errors[n] += x
    by_label = defaultdict(int)
    for (_, _, label), e in zip(want, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    expected = [(i, bytes(c).hex(), e, min(by_label[label], (1 << 63) - 1), sha) for (i, _, label), c, e in zip(want, codes, errors, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("grid", [3, 40, 4000, 1 << 26])
def test_bounds_prune_and_change_nothing(grid):
    rng = np.random.default_rng(grid)
    x, before = rng.integers(-grid, grid, (3000, 2, 4)), rng.integers(-grid, grid, (2, 32, 4))
    books = vector_codes.Books(before)
    code, best, upper, lower = vector_codes.assign_all(x, books)
    for step in range(4):
        after = before + rng.integers(-max(1, grid // 50), max(2, grid // 50), before.shape)
        books, before = vector_codes.Books(after, before), after
        code, best, upper, lower, looked = vector_codes.assign_again(x, code, upper, lower, books)
        for p in range(2):
            d = ((x[:, p, None, :] - after[p][None]) ** 2).sum(axis=2)
            assert np.array_equal(code[:, p], d.argmin(axis=1)), step
            assert np.array_equal(best[:, p], d.min(axis=1))
            near = np.sqrt(d.astype(float)) * vector_codes.STEP
            assert (lower[:, p] <= near + 1e-3).all()
            assert ((upper[:, p] >= near.min(axis=1) - 1e-3) | (upper[:, p] == vector_codes.NO_BOUND)).all()
        if grid in (40, 4000):
            assert looked < 0.5 * x.shape[0] * 2 * 32  # most are passed over
    same_again = vector_codes.Books(after, after)
    assert vector_codes.assign_again(x, code, upper, lower, same_again)[0].tolist() == code.tolist()


def test_no_vectors(shipped):  # noqa: F811
    for rows in ([], [(1, None, 1, "", 0), (2, [math.nan] * 8, 1, "", 0)]):
        df = shipped.createDataFrame(rows, SCHEMA)
        assert centroid_clustering.cluster_vectors(df, dims=8).count() == 0
        assert vector_codes.encode_vectors(df, dims=8, parts=4).count() == 0
    with pytest.raises(ValueError, match="multiple"):
        vector_codes.encode_vectors(df, dims=9, parts=4)


@pytest.mark.parametrize("name", ["op12_centroid_clustering", "op13_vector_codes"])
def test_vectors_against_sql(shipped, sf, duck, name):  # noqa: F811
    same(queries.queries()[name](shipped, sf).toPandas(), duck.sql(queries.oracle_sql()[name]).df())
