"""Near-duplicate detection: a chosen-path set similarity join, then connected components.

Documents are sets of hashed word shingles. In each of some independent trees a
document walks from the root by minwise tokens: which of its ``COORDINATES``
minwise values it turns on next depends on its path so far, so documents that
walk together agree on all values chosen. Small nodes are compared exhaustively;
large ones are branched again, on four more values, and have so many children
that a pair at the threshold is expected to stay together once. Pairs that look
similar are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Tables
from ._text import WordHasher, column, groups, mix, seeds, shingles

COORDINATES = 64
_S, _A = seeds(COORDINATES, "minwise salt"), seeds(COORDINATES, "minwise factor")
_FACTORS = seeds(64, "shingle")


def minwise(h: np.ndarray) -> np.ndarray:
    """The least of each of the hash functions over a set, as 32-bit numbers."""
    out = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(h), 1 << 14):
        part = h[i : i + (1 << 14)]
        np.minimum(out, (((part[None, :] ^ _S[:, None]) * _A[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32), out=out)
    return out


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, sid (the identity of its set; null for an empty one), size and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            sid, size, sig = [], [], []
            for text in column(b, "text"):
                s = shingles(hasher(text), k, _FACTORS)
                size.append(len(s))
                sid.append(int(np.frombuffer(xxhash.xxh64_digest(s.tobytes()), "<i8")[0]) if len(s) else None)
                sig.append(minwise(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sid, pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "sid", "size", "sketch"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, sid bigint, size bigint, sketch binary")


def _step(path: np.ndarray, sketches: np.ndarray, turn: int) -> np.ndarray:
    """Paths after the turn on the coordinate that each path chooses; ``turn`` tells second choices apart."""
    at = (mix(path + np.uint64(0x51ED2701 * (turn + 1))) % np.uint64(COORDINATES)).astype(np.int64)
    value = sketches[np.arange(len(path)), at].astype(np.uint64)
    return mix(path * np.uint64(0x9FB21C651E98DF25) + (value << np.uint64(8)) + at.astype(np.uint64) + np.uint64(1))


def _sketches(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(len(col), COORDINATES)


#: Turns that a branching takes at once.
TURNS = 4


def children(t: float) -> float:
    """How many children a large node has on average, so that a pair at the threshold is expected to stay together once."""
    return t**-TURNS


def trees_needed(t: float, steps: int, levels: int, miss: float) -> int:
    """Trees that all lose a pair at the threshold with probability ``miss`` at most, if its nodes are branched on ``levels`` times.

    Though a pair is expected to stay together once, that it does so at all
    grows rarer by the level.
    """
    lost, sure, more = 0.0, int(children(t)), children(t) % 1
    for _ in range(levels):
        child = 1 - t**TURNS * (1 - lost)
        lost = child**sure * (1 - more + more * child)
    return int(np.ceil(np.log(miss) / np.log1p(-(t**steps) * (1 - lost))))


def walk(reps: DataFrame, first: int, trees: int, steps: int) -> DataFrame:
    """tree, node and sid of each set in each of the trees from ``first`` on, after its first ``steps`` turns."""
    roots = seeds(trees, "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _sketches(b.column(1))
            for t in range(first, trees):
                path = np.full(len(sig), roots[t], np.uint64)
                for _ in range(steps):
                    path = _step(path, sig, 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array(path.view(np.int64)), b.column(0)], ["tree", "node", "sid"])

    return reps.select("sid", "sketch").mapInArrow(run, "tree int, node bigint, sid bigint")


def branch(rows: DataFrame, mean: float) -> DataFrame:
    """The children of nodes, of rows (tree, node, sid, sketch): ``mean`` on average, each after ``TURNS`` turns of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, path = _sketches(b.column(3)), b.column(1).to_numpy().view(np.uint64)
            chance = (mix(path ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            for n in range(int(np.ceil(mean))):
                mask = chance < mean - n
                child, own = path[mask], sig[mask]
                for turn in range(TURNS):
                    child = _step(child, own, n if turn == 0 else 0)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(mask)), pa.array(child.view(np.int64)), b.column(2).filter(pa.array(mask))], ["tree", "node", "sid"])

    return rows.select("tree", "node", "sid", "sketch").mapInArrow(run, "tree int, node bigint, sid bigint")


def _alike(sig: np.ndarray, size: np.ndarray, least: float, ratio: float) -> Iterator[tuple[int, int]]:
    """Pairs (i < j) whose sketches agree on ``least`` or more, in falling order of agreement; seven bytes a pair are held, and eight to order them."""
    least_equal = int(np.ceil(least * COORDINATES - 1e-9))
    first, second, equal = [], [], []
    for i in range(len(sig) - 1):
        same = np.count_nonzero(sig[i + 1 :] == sig[i], axis=1)
        low, high = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
        j = np.flatnonzero((same >= least_equal) & (low >= ratio * high))
        if len(j):
            first.append(np.full(len(j), i, np.uint16))
            second.append((i + 1 + j).astype(np.uint16))
            equal.append((COORDINATES - same[j]).astype(np.uint8))
    if first:
        first, second, equal = map(np.concatenate, (first, second, equal))
        # Pairs come in order of (i, j), which a stable sort keeps among equals.
        for k in np.argsort(equal, kind="stable"):
            yield int(first[k]), int(second[k])


class _Roots:
    """Disjoint sets of components."""

    def __init__(self, names: np.ndarray):
        self.parent = {c: c for c in names.tolist()}

    def __call__(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x


def _by_node(rows: DataFrame, handle, schema: str, sets: bool = False) -> DataFrame:
    """``handle(tree, node, columns)`` of each node of rows (tree, node, sid, size, sketch, component[, set]), whose rows come in order of sid.

    Nodes are small by the time they get here, so a node's rows fit in memory.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.binary() if c.endswith(" binary") else pa.int64() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def done() -> list[tuple]:
            t = pa.Table.from_batches(held).combine_chunks().sort_by("sid")
            if t.num_rows < 2:
                return []
            columns = {c: t.column(c).to_numpy() for c in ("sid", "size", "component")} | {"sketch": _sketches(t.column("sketch"))}
            if sets:
                columns["set"] = t.column("set").combine_chunks()
            return list(handle(*key, columns))

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        found: list[tuple] = []
        for b in batches:
            if not b.num_rows:
                continue
            tree, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(node) != 0) | (np.diff(tree) != 0)) + 1), len(node)]
            for x, y in zip(edges, edges[1:], strict=False):
                now = (int(tree[x]), int(node[x]))
                if key is not None and now != key:
                    found += done()
                    held = []
                    if len(found) >= 10_000:
                        yield batch(found)
                        found = []
                key = now
                held.append(b.slice(x, y - x))
        if held:
            found += done()
        if found:
            yield batch(found)

    wanted = ["tree", "node", "sid", "size", "sketch", "component", *["set"] * sets]
    return rows.select(*wanted).repartition("tree", "node").sortWithinPartitions("tree", "node").mapInArrow(run, schema)


def compare(rows: DataFrame, least: float, ratio: float) -> DataFrame:
    """Pairs (tree, a, b) that look similar within nodes, without those whose ends others already connect."""

    def pairs(tree: int, node: int, c: dict) -> Iterator[tuple]:
        root = _Roots(c["component"])
        for i, j in _alike(c["sketch"], c["size"], least, ratio):
            a, b = root(int(c["component"][i])), root(int(c["component"][j]))
            if a != b:
                root.parent[a] = b
                yield tree, int(c["sid"][i]), int(c["sid"][j])

    return _by_node(rows, pairs, "tree int, a bigint, b bigint")


def crossing(rows: DataFrame, least: float, ratio: float) -> DataFrame:
    """The rows of nodes that look similar to one of another component."""

    def some(tree: int, node: int, c: dict) -> Iterator[tuple]:
        if (c["component"] == c["component"][0]).all():
            return
        found = set()
        for i, j in _alike(c["sketch"], c["size"], least, ratio):
            if c["component"][i] != c["component"][j]:
                found |= {i, j}
        for k in sorted(found):
            yield tree, node, int(c["sid"][k]), int(c["size"][k]), c["sketch"][k].tobytes(), int(c["component"][k])

    return _by_node(rows, some, "tree int, node bigint, sid bigint, size bigint, sketch binary, component bigint")


def linked(a: pa.BinaryScalar, b: pa.BinaryScalar, percent: int) -> bool:
    """Whether two sets, sorted, have 100 * intersection >= percent * union; read where they lie, not copied."""
    s, t = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def links(rows: DataFrame, least: float, ratio: float, percent: int) -> DataFrame:
    """Confirmed links (a, b) across components within nodes of rows with their full sets; every pair that looks similar is compared unless links found before connect it."""

    def confirmed(tree: int, node: int, c: dict) -> Iterator[tuple]:
        root = _Roots(c["component"])
        for i, j in _alike(c["sketch"], c["size"], least, ratio):
            a, b = root(int(c["component"][i])), root(int(c["component"][j]))
            if a != b and linked(c["set"][i], c["set"][j], percent):
                root.parent[a] = b
                yield int(c["sid"][i]), int(c["sid"][j])

    return _by_node(rows, confirmed, "a bigint, b bigint", sets=True)


def _to_pivots(rows: DataFrame, least: float, ratio: float, few: bool) -> DataFrame:
    """Pairs of the sets in large nodes with their node's pivot, the least sid, where they look similar."""
    # A pivot a large node: broadcast, unless there are very many, so that a node's rows stay where they are.
    pivots = rows.groupBy("tree", "node").agg(F.min(F.struct("sid", "size", "sketch")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = (_sketches(b.column(3)) == _sketches(b.column(6))).mean(axis=1)
            n, m = b.column(2).to_numpy(), b.column(5).to_numpy()
            keep = pa.array((same >= least) & (np.minimum(n, m) >= ratio * np.maximum(n, m)), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), b.column(1)], ["tree", "a", "b"]).filter(keep)

    both = rows.join(F.broadcast(pivots) if few else pivots, ["tree", "node"]).where("sid > p.sid").select("tree", "sid", "size", "sketch", F.col("p.sid").alias("p_sid"), F.col("p.size").alias("p_size"), F.col("p.sketch").alias("p_sketch"))
    return both.mapInArrow(run, "tree int, a bigint, b bigint")


def _pairs_of_parts(rows: DataFrame, limit: int) -> DataFrame:
    """Nodes of about ``limit`` sets, one for each two parts of a large node, so that any two of its sets meet in one."""
    parts = rows.groupBy("tree", "node").agg((F.count(F.lit(1)) / (limit / 2) + 1).cast("int").alias("parts"))
    own = rows.join(parts, ["tree", "node"]).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    met = own.select("tree", "node", "sid", "own", F.explode(F.expr("filter(sequence(0, parts - 1), x -> x <> own)")).alias("other"))
    return met.select("tree", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "sid")


#: Large nodes, and so their pivots of about 300 bytes, that are broadcast.
MOST_BROADCAST = 50_000
FILTER_WORDS = 1 << 17


def _filter(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of an id: 1 MB at most on the driver, whatever the number of ids. May let others pass."""
    h = F.xxhash64("id")
    bits = ids.select(F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS)).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(FILTER_WORDS, np.int64)
    for r in bits.collect():
        out[r["word"]] = r["bits"]
    return out


def _sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(sid, set) of the wanted sids: texts of documents that may be among them are read again, no others."""
    keys = reps.join(wanted, "sid", "left_semi").select("doc_id")
    bits = _filter(keys.select(F.col("doc_id").alias("id")).where("id IS NOT NULL"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    nulls = not keys.where("doc_id IS NULL").isEmpty()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hasher = shared.value, WordHasher()
        for b in batches:
            h = b.column(2).to_numpy()
            word, bit = (h >> 6) % FILTER_WORDS, (h % 64).astype(np.uint64)
            keep = ((bits[word].view(np.uint64) >> bit) & np.uint64(1)).astype(bool)
            if nulls:
                keep |= b.column(0).is_null().to_numpy(zero_copy_only=False)
            for texts in groups(b.filter(pa.array(keep))):
                found = [s.astype("<u8").tobytes() for text in texts if len(s := shingles(hasher(text), k, _FACTORS))]
                sid = [int(np.frombuffer(xxhash.xxh64_digest(s), "<i8")[0]) for s in found]
                yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(found, pa.binary())], ["sid", "set"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("hash", F.xxhash64("doc_id")).mapInArrow(run, "sid bigint, set binary")
    return rows.join(wanted, "sid", "left_semi").dropDuplicates(["sid"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(x, y, percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("sid").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("sid").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(v, c): the least vertex that each vertex of ``edges`` (a, b) reaches.

    Alternates large stars and small stars until nothing changes: a number of
    rounds that grows with the logarithm of a component's size, each a few
    joins and sums by vertex, none of which gathers a vertex's neighbours.
    """
    edges = tables.save(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = tables.save(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v AS u", "m AS v").unionByName(least.selectExpr("u", "m AS v")).where("u <> v").distinct()
        after = tables.save(small)
        tables.drop(edges, large)
        edges = after
        now = tuple(after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return edges.selectExpr("u AS v", "v AS c").unionByName(edges.selectExpr("v", "v AS c").distinct())
        before = now


def near_duplicates(docs: DataFrame, *, shingle_words: int = 5, percent: int = 85, trees: int = 10, steps: int = 3, node_limit: int = 1024, most_levels: int = 4, miss: float = 1e-4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Words lie between ASCII white space, A-Z in lower case; a set holds the
    distinct shingles, or all words as one where there are fewer. Two documents
    are linked if 100 * intersection >= percent * union; links are confirmed on
    full sets. component_id is the least doc_id that links reach. Equal sets are
    one vertex from the start, so copies cost no comparison.

    A pair at the threshold t = percent / 100 meets in a tree with probability
    t ** steps. Nodes of more than ``node_limit`` sets are branched again, at most
    ``most_levels`` times, and a pair in them stays together less often. There
    are ``trees`` trees or, if more, as many as miss such a pair with probability
    ``miss`` at most; where nodes were branched on, as many more, for the sets of
    large nodes, as that takes. Sets of large nodes are also compared with one
    pivot each. What is then still too large agrees on all values turned on, is
    cut into parts by hash, and every two parts are compared.

    Null, empty and blank texts have an empty set, no links, and themselves as
    component. A null id is linked as others, and is a component_id only where
    the component has no other; repeated rows share a component and, if its
    least id is theirs, are all kept. An empty table gives no rows; columns
    other than doc_id and text are ignored.
    """
    tables = Tables(docs.sparkSession)
    t = percent / 100
    # Four standard deviations below the threshold: of pairs at it one in 30,000 looks less alike than that.
    least = t - 4 * (t * (1 - t) / COORDINATES) ** 0.5
    sketches = tables.save(sketch(docs, shingle_words))
    reps = tables.save(sketches.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("sketch").alias("sketch")))
    nodes, pivoted, crowd, first, trees = [], [], reps, 0, max(trees, trees_needed(t, steps, 0, miss))
    while first < trees:
        level, crowded = walk(crowd, first, trees, steps), None
        for depth in range(most_levels + 1):
            level = tables.save(level)
            sizes = tables.save(level.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
            large = sizes.where(F.col("n") > node_limit).select("tree", "node")
            crowds = large.count()
            if crowds:
                # Large nodes are few, at most a row in node_limit, and known before their rows move.
                few = crowds <= MOST_BROADCAST
                large = F.broadcast(large) if few else large
                crowd_rows, level = level.join(large, ["tree", "node"], "left_semi"), level.join(large, ["tree", "node"], "left_anti")
            nodes.append(tables.save(level.join(sizes.where(F.col("n") <= node_limit).select("tree", "node"), ["tree", "node"], "left_semi")))
            if not crowds:
                depth -= 1
                break
            large = tables.save(crowd_rows.join(reps.drop("doc_id"), "sid"))
            crowded = large.select("sid") if crowded is None else crowded.unionByName(large.select("sid"))
            pivoted.append(tables.save(_to_pivots(large, least, t, few)))
            if depth < most_levels:
                level = branch(large, children(t))
            else:
                depth -= 1
                nodes.append(tables.save(_pairs_of_parts(large, node_limit)))
        # Levels are counted by the branchings; sets that no large node holds lose nothing by them.
        first, trees = trees, max(trees, trees_needed(t, steps, depth + 1, miss))
        if first < trees:
            crowd = tables.save(crowd.join(crowded.distinct(), "sid", "left_semi"))
    small = nodes[0]
    for n in nodes[1:]:
        small = small.unionByName(n)
    small = tables.save(small.join(reps.drop("doc_id"), "sid"))
    forest = compare(small.withColumn("component", F.col("sid")), least, t)
    for p in pivoted:
        forest = forest.unionByName(p)
    forest = tables.save(forest)
    alike = tables.save(forest.select(F.col("a").alias("sid")).unionByName(forest.select(F.col("b").alias("sid"))).distinct())
    sets = tables.save(_sets(docs, reps, alike, shingle_words))

    # First the pairs of the forests of all nodes; then, where sets of different components still look similar in a
    # node, every such pair, compared within the node.
    found = components(confirm(forest.select("a", "b").distinct(), sets, percent), tables)
    named = small.join(alike, "sid", "left_semi").join(found.withColumnRenamed("v", "sid"), "sid", "left").withColumn("component", F.coalesce("c", "sid"))
    rest = tables.save(crossing(named, least, t))
    if not rest.isEmpty():
        last = tables.save(links(rest.join(sets, "sid"), least, t, percent))
        if not last.isEmpty():
            found = components(_stars(found).unionByName(last), tables)

    member = reps.select("sid", "doc_id").join(found.withColumnRenamed("v", "sid"), "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    by_sid = member.join(member.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("sid", "component_id")
    out = sketches.select("doc_id", F.col("size").alias("n_shingles"), "sid").join(tables.save(by_sid), "sid", "left")
    out = out.withColumn("component_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _stars(found: DataFrame) -> DataFrame:
    return found.where("v <> c").selectExpr("v AS a", "c AS b")


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, of which one document of each group of near-duplicates stays.

    It is the one with the least doc_id; parameters are those of ``near_duplicates``.
    """
    tables = Tables(docs.sparkSession)
    gone = tables.save(near_duplicates(docs, **how).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct())
    # The columns of ``docs`` are one struct, so no name of theirs meets one of this function.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")), "left_anti").select("row.*")
