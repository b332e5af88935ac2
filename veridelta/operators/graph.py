"""Property-graph operators over nodes (id, kind, name, path, test) and edges (src, dst, kind, sites)."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from veridelta.shared import Tables

#: Calls meet what they may mean in so many parts of each name.
PARTS = 32
#: What a name means is handed to its calls in lists of so many.
LISTED = 4096
SEARCH_LIMIT, NEIGHBOR_LIMIT, DELTA_LIMIT = 30, 100, 100
NODE_KINDS = ("component", "package", "file", "function", "type", "dependency")
EDGE_KINDS = ("contains", "calls", "member_of", "implements", "imports", "depends_on", "declares")


def merge_sites(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge for each (src, kind, dst) with its first site; ``count`` only where there are several. Self-loops and edges without both ends go."""
    ids = nodes.select("id")
    ok = sites.where("src <> dst").join(ids, sites.src == ids.id, "left_semi").join(ids, sites.dst == ids.id, "left_semi")
    g = ok.groupBy("src", "kind", "dst").agg(F.min_by(F.struct("path", "line"), F.struct("seq", "path", "line")).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("src", "kind", "dst", "s.path", "s.line", F.when(F.col("n") > 1, F.col("n")).alias("count"))


def kind_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Numbers of nodes and edges by kind."""
    count = lambda df, what: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def short_name(name):
    """The last element of a dotted or slashed name, in lower case; empty where there is none."""
    low = F.lower(name)
    last = F.element_at(F.split(low, r"[./]"), -1)
    return F.when(low.rlike(r"[./]"), last).otherwise("")


def search(nodes: DataFrame, text: str, kind: str = "", limit: int = SEARCH_LIMIT) -> DataFrame:
    """The first ``limit`` matches of a text: equal names, then endings, then parts; shorter names, then ids first. With the total.

    Top-k and count are two aggregates, so no node but the matches moves.
    """
    q = text.strip().lower()
    low, path = F.lower("name"), F.lower("path")
    score = F.when((low == q) | (short_name(F.col("name")) == q), 0).when(low.endswith(q) | path.endswith(q), 1).when(low.contains(q) | path.contains(q), 2)
    hits = (nodes.where(F.col("kind") == kind) if kind else nodes).withColumn("score", score).where("score IS NOT NULL")
    top = hits.orderBy("score", F.octet_length("name"), "id").limit(limit)
    return top.crossJoin(F.broadcast(hits.agg(F.count(F.lit(1)).alias("total")))).select("id", "kind", "name", "score", "total")  # one row is broadcast


def links(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as steps (at, end, dir, kind, order); out-edges before in-edges, each in edge order."""
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("end"), F.lit("out").alias("dir"), "kind", F.struct(F.lit(0).alias("d"), "src", "kind", "dst").alias("order"))
    into = edges.select(F.col("dst").alias("at"), F.col("src").alias("end"), F.lit("in").alias("dir"), "kind", F.struct(F.lit(1).alias("d"), "src", "kind", "dst").alias("order"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def _cut(frontier: DataFrame, steps: DataFrame, left: int) -> DataFrame:
    """The nodes of a level, in its order, whose edges fit into what is left of a budget, the last of them perhaps not in full.

    Degrees are summed along the order, over at most ``left`` nodes that have
    an edge, before any of their edges is read.
    """
    degrees = frontier.select("node").join(steps.groupBy(F.col("at").alias("node")).agg(F.count(F.lit(1)).alias("_degree")), "node")
    first = frontier.join(degrees, "node").orderBy("place").limit(left)
    before = F.sum("_degree").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < left).select("node", "place")


class _Deadline:
    """Runs work that is cancelled at a time; ``over`` says whether it was."""

    def __init__(self, spark: SparkSession, seconds: float | None):
        self.context, self.over = spark.sparkContext, False
        self.end = None if seconds is None else time.monotonic() + seconds

    def run(self, work: Callable[[], DataFrame]) -> DataFrame | None:
        """What ``work`` gives, or None where the time ran out before or during it."""
        if self.end is None:
            return work()
        left = self.end - time.monotonic()
        if left <= 0:
            self.over = True
            return None
        group, before = uuid.uuid4().hex, self.context.getLocalProperty("spark.jobGroup.id")
        self.context.setJobGroup(group, "search with a deadline", interruptOnCancel=True)

        def stop() -> None:
            self.over = True
            self.context.cancelJobGroup(group)

        timer = threading.Timer(left, stop)
        timer.start()
        try:
            return work()
        except Exception:
            if not self.over:
                raise
            return None
        finally:
            timer.cancel()
            self.context.setLocalProperty("spark.jobGroup.id", before)


def neighbors(edges: DataFrame, start: str, direction: str = "both", depth: int = 2, kinds: tuple[str, ...] = (), limit: int = NEIGHBOR_LIMIT, budget: int | None = None, seconds: float | None = None, looked: Callable[[int], None] | None = None) -> DataFrame:
    """Nodes within ``depth`` steps, each once, through the edge that finds it first; the first ``limit``, the total, and whether the budget or the time ran out.

    A step's place is the list of edges that led to it, so lists compare as a
    breadth-first search visits them, without numbering a frontier. With
    ``budget``, that many edges are looked at, in that order, and what they
    reach is the (partial) result: a level is cut by its nodes' degrees before
    their edges are joined, so at most one node's more are read. With
    ``seconds``, the level at work when they are over is cancelled, and what was
    written before is the result. ``looked`` gets the number of edges joined at
    each level. Each level is written, so none is planned again.
    """
    tables = Tables(edges.sparkSession)
    steps = links(edges.where(F.col("kind").isin(*kinds)) if kinds else edges, direction)
    none = steps.limit(0).select(F.col("end").alias("node"), F.lit(0).alias("depth"), "dir", "kind", F.col("at").alias("via"), F.array("order").alias("place"))
    frontier = steps.sparkSession.createDataFrame([(start,)], "node string").select("node", F.array().cast(none.schema["place"].dataType).alias("place"))
    seen, found, used, short, deadline = frontier.select("node"), none, 0, False, _Deadline(edges.sparkSession, seconds)
    for d in range(1, depth + 1):

        def next_level(d=d, frontier=frontier, seen=seen) -> DataFrame:
            nonlocal used, short
            at = frontier
            if budget is not None:
                at = tables.save(_cut(frontier, steps, budget - used + 1))  # one edge more tells whether any is left out
            reached = at.join(steps, at.node == steps.at).select("end", "dir", "kind", F.col("node").alias("via"), F.concat("place", F.array("order")).alias("place"))
            if budget is not None:
                seen_edges = Observation()
                reached = tables.save(reached.observe(seen_edges, F.count(F.lit(1)).alias("n")))
                n = seen_edges.get["n"]
                if looked is not None:
                    looked(n)
                short = used + n > budget
                reached = reached.orderBy("place").limit(budget - used) if short else reached
                used += n
            best = reached.join(seen, reached.end == seen.node, "left_anti").groupBy("end").agg(F.min_by(F.struct("dir", "kind", "via", "place"), "place").alias("s"))
            return tables.save(best.select(F.col("end").alias("node"), F.lit(d).alias("depth"), "s.dir", "s.kind", "s.via", "s.place"))

        level = deadline.run(next_level)
        if level is None:
            break
        found, frontier = found.unionByName(level), level.select("node", "place")
        if short or level.isEmpty():
            break
        seen = seen.unionByName(level.select("node"))
    top = found.orderBy("depth", "place").limit(limit)
    out = top.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))  # one row is broadcast
    return out.select("node", "depth", "dir", "kind", "via", "total", F.lit(short).alias("truncated"), F.lit(deadline.over).alias("timed_out"))


def shortest_path(edges: DataFrame, start: str, end: str, undirected: bool = False, longest: int = 12) -> DataFrame:
    """The hops (hop, src, dst, kind) of the shortest chain that a breadth-first search finds first; no rows where there is none.

    Each level is a join and an aggregate, written to the shared folder; the
    driver sees only whether the end is reached and then the chain, of at most
    ``longest`` hops.
    """
    spark = edges.sparkSession
    steps = links(edges, "both" if undirected else "out")
    tables = Tables(spark)
    empty = spark.createDataFrame([], "hop int, src string, dst string, kind string")
    frontier = tables.save(spark.createDataFrame([(start,)], "node string").select("node", F.array().cast(f"array<{steps.schema['order'].dataType.simpleString()}>").alias("place")))
    seen = frontier.select("node")
    for _ in range(longest if start != end else 0):
        reached = frontier.join(steps, frontier.node == steps.at).select("end", F.concat("place", F.array("order")).alias("place"))
        frontier = tables.save(reached.join(seen, reached.end == seen.node, "left_anti").groupBy(F.col("end").alias("node")).agg(F.min("place").alias("place")))
        if frontier.isEmpty():
            return empty
        hit = frontier.where(F.col("node") == end)
        if not hit.isEmpty():
            hops = hit.select(F.posexplode("place").alias("hop", "e"))
            a, b = F.col("e.src"), F.col("e.dst")
            back = F.col("e.d") == 1
            return hops.select((F.col("hop") + 1).alias("hop"), F.when(back, b).otherwise(a).alias("src"), F.when(back, a).otherwise(b).alias("dst"), F.concat("e.kind", F.when(back, " (reversed)").otherwise("")).alias("kind"))
        seen = seen.unionByName(frontier.select("node"))
    return empty


def inspect(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each function: references, distinct callers, distinct callees and tests that call it."""
    tests = nodes.select(F.col("id").alias("src"), "test")
    into = calls.join(tests, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("sites").alias("references"), F.count(F.lit(1)).alias("callers"), F.count_if("test").alias("tests"))
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("callees"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.where("kind = 'function'").select("id").join(into, "id", "left").join(out, "id", "left").select("id", zero("references"), zero("callers"), zero("callees"), zero("tests"))


def delta(base: DataFrame, head: DataFrame, kinds: tuple[str, ...] = ("depends_on", "declares"), limit: int = DELTA_LIMIT) -> DataFrame:
    """Structural edges added and removed, each side's first ``limit`` by kind, then ends, with its total."""
    keys = ["src", "kind", "dst"]
    b, h = (x.where(F.col("kind").isin(*kinds)).select(*keys).distinct() for x in (base, head))
    both = h.join(b, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(h, keys, "left_anti").withColumn("change", F.lit("removed")))
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    totals = both.groupBy("change").agg(F.count(F.lit(1)).alias("total"))
    first = both.where("change = 'added'").orderBy(rank, *keys).limit(limit).unionByName(both.where("change = 'removed'").orderBy(rank, *keys).limit(limit))
    return first.join(F.broadcast(totals), "change")  # two rows are broadcast


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each component: its packages and files."""
    c = edges.where("kind = 'contains'")
    inner = c.alias("a").join(c.alias("b"), F.col("a.dst") == F.col("b.src"), "left").groupBy(F.col("a.src").alias("id")).agg(F.countDistinct("a.dst").alias("packages"), F.count("b.dst").alias("files"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return nodes.where("kind = 'component'").select("id", "name").join(inner, "id", "left").select("id", "name", zero("packages"), zero("files"))


def external_dependencies(edges: DataFrame) -> DataFrame:
    """Distinct dependencies that a node declares or uses, each once."""
    d = edges.where(F.col("dst").startswith("dependency:"))
    return d.groupBy("src").agg(F.countDistinct("dst").alias("dependencies"))


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of each end of an edge."""
    both = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def resolve(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Nodes that each text ``ref`` names: by id, else by id with a file, package or component prefix, else by name or its last element."""
    low = F.lower("name")
    keys = nodes.select("id", F.explode(F.array(F.struct(F.lit(0).alias("r"), F.col("id").alias("k")), F.struct(F.lit(9).alias("r"), low.alias("k")), F.struct(F.lit(9).alias("r"), short_name(F.col("name")).alias("k")))).alias("x")).where("x.k <> ''").select("id", "x.*").distinct()
    tries = refs.select("ref", F.explode(F.array(F.struct(F.lit(0).alias("r"), F.lit(0).alias("p"), F.col("ref").alias("k")), *(F.struct(F.lit(0).alias("r"), F.lit(i + 1).alias("p"), F.concat(F.lit(f"{p}:"), "ref").alias("k")) for i, p in enumerate(("file", "package", "component"))), F.struct(F.lit(9).alias("r"), F.lit(9).alias("p"), F.lower("ref").alias("k")))).alias("t")).select("ref", "t.*")
    hits = tries.join(keys, ["r", "k"]).select("ref", "p", "id").distinct()
    best = hits.groupBy("ref").agg(F.min("p").alias("p"))
    return hits.join(best, ["ref", "p"]).select("ref", "id")


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The deepest of ``roots`` (root) that holds each path; else its top folder; else a dot."""
    parts = F.split("path", "/")
    prefixes = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    deepest = prefixes.join(roots, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    top = F.when(F.contains("path", F.lit("/")), F.element_at(parts, 1)).otherwise(".")
    return paths.join(deepest, "path", "left").select("path", F.coalesce("root", top).alias("component"))


def call_edges(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls between known nodes with their number of sites; those with an unknown end are dropped."""
    ids = nodes.select("id")
    calls = sites.where("kind = 'calls'").join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
    return calls.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("sites"))


def call_pairs(sites: DataFrame) -> DataFrame:
    """References (src, dst, seq, call) as one row a pair: the first site, whether any is a call, how many there are."""
    return sites.groupBy("src", "dst").agg(F.min("seq").alias("first_seq"), F.bool_or("call").alias("call"), F.count(F.lit(1)).alias("sites"))


def surroundings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each file that is no test: its package and how many files share it, counted once a package."""
    c = edges.where("kind = 'contains'")
    size = c.groupBy(F.col("src").alias("package")).agg(F.countDistinct("dst").alias("n"))
    files = nodes.where("kind = 'file' AND NOT test").select("id")
    return files.join(c.select(F.col("dst").alias("id"), F.col("src").alias("package")), "id").join(size, "package").select("id", "package", (F.col("n") - 1).alias("siblings"))


def build(nodes: DataFrame, sites: DataFrame, most_nodes: int, most_edges: int) -> DataFrame:
    """A graph's rows (what, kind, src, dst), nodes before edges, each kind cut at its cap in order, with the total before the cut."""
    n = nodes.select(F.lit("node").alias("what"), "kind", F.col("id").alias("src"), F.lit("").alias("dst")).distinct()
    e = merge_sites(sites, nodes).select(F.lit("edge").alias("what"), "kind", "src", "dst")
    cut = lambda rows, most: rows.orderBy("src", "kind", "dst").limit(most).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # one row is broadcast
    return cut(n, most_nodes).unionByName(cut(e, most_edges))


def structure(edges: DataFrame) -> DataFrame:
    """Chains of containment: component, package, file."""
    c = edges.where("kind = 'contains'")
    top = c.where(F.col("src").startswith("component:")).select(F.col("src").alias("component"), F.col("dst").alias("package"))
    return top.join(c.select(F.col("src").alias("package"), F.col("dst").alias("file")), "package").select("component", "package", "file").distinct()


def adjacency(calls: DataFrame) -> DataFrame:
    """Incoming calls in one list, as a compressed index has them: position, dst and src of each, sorted by dst and src.

    Rows are dealt by ranges of that order, so the callers of a hub lie in many
    parts; positions are counted within a part and added up over parts.
    """
    ranged = calls.select("dst", "src").repartitionByRange("dst", "src").withColumn("_part", F.spark_partition_id())
    ranged = Tables(calls.sparkSession).save(ranged)  # which part a row is in stays as it is
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("dst", "src")) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_own")).alias("position"), "dst", "src")


def ranges_of(listed: DataFrame) -> DataFrame:
    """Where each callee's calls begin in the list of ``adjacency``, and how many there are."""
    return listed.groupBy("dst").agg(F.min("position").alias("start"), F.count(F.lit(1)).alias("calls"))


def references(calls: DataFrame, implementations: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Who refers to each function, static calls before those through an interface, each with the total; the first ``limit``.

    ``implementations`` (dst, via): calls of an interface's ``via`` reach ``dst`` too.
    """
    rows = calls.select("dst", "src", "sites", F.lit(0).alias("through"))
    if implementations is not None:
        reached = calls.join(implementations.select(F.col("dst").alias("_to"), F.col("via").alias("dst")), "dst").select(F.col("_to").alias("dst"), "src", "sites", F.lit(1).alias("through"))
        rows = rows.unionByName(reached)
    w = Window.partitionBy("dst")
    out = rows.withColumn("total", F.count(F.lit(1)).over(w))
    if limit is not None:
        out = out.withColumn("_n", F.row_number().over(w.orderBy("through", "src"))).where(F.col("_n") <= limit).drop("_n")
    return out


def search_lines(texts: DataFrame, needle: str, most: int | None = None) -> DataFrame:
    """Lines (doc_id, line, text) that hold a literal text; the first ``most`` by document and line. Texts without it aren't split."""
    holds = lambda c: F.contains(F.col(c), F.lit(needle))
    rows = texts.where(holds("text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).where(holds("text")).select("doc_id", (F.col("n") + 1).alias("line"), "text")
    return rows.orderBy("doc_id", "line").limit(most) if most is not None else rows


def depends_on(uses: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges between different owners (id, owner) of the two ends of uses (src, dst): pairs are made distinct before names are looked up."""
    own = owners.select("id", "owner")
    pairs = uses.select("src", "dst").distinct().join(own.toDF("src", "x"), "src").join(own.toDF("dst", "y"), "dst")
    return pairs.where("x <> y").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct()


def resolve_symbols(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The functions that each ``ref`` names, with the class of the match: id (0), slashed ending of the id (1), full name (2), bare name (3); the best class only."""
    key = lambda c, k: F.struct(F.lit(c).alias("class"), k.alias("ref"))
    tail = F.when(F.contains("id", F.lit("/")), F.regexp_replace("id", "^.*/", ""))
    keys = F.array(key(0, F.col("id")), key(1, tail), key(2, F.col("name")), key(3, F.regexp_replace("name", r"^.*\.", "")))
    keyed = nodes.where("kind = 'function'").select("id", F.explode(keys).alias("k")).select("id", "k.*")
    hits = refs.select("ref").distinct().join(keyed, "ref").groupBy("ref", "id").agg(F.min("class").alias("class"))
    best = hits.groupBy("ref").agg(F.min("class").alias("class"))
    return hits.join(best, ["ref", "class"]).select("ref", "id", "class")


def resolve_calls(calls: DataFrame, declarations: DataFrame, most: int = 3) -> DataFrame:
    """Declarations (id, name, home) that calls (caller, name, file) may mean: those of the call's own file (0) before others (1).

    A call with more than ``most`` candidates is marked unresolved.
    """
    # Candidates are counted by name and file before calls meet them, and rows that are made of a call and its candidates aren't shuffled.
    keys = ["caller", "name", "file"]
    ids = declarations.select("id", "name").distinct()
    homes = declarations.select("id", "name", F.col("home").alias("file")).distinct()
    count = lambda rows, *by: rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_".join(["", *by])))
    c = calls.select(*keys).distinct().join(count(ids, "name"), "name").join(count(homes, "name", "file"), ["name", "file"], "left")
    c = Tables(calls.sparkSession).save(c.withColumn("_part", F.pmod(F.xxhash64("caller", "file"), F.lit(PARTS)).cast("int")))

    def met(rows: DataFrame, found: DataFrame, by: list[str], which: int, n: str) -> DataFrame:
        # Lists are met, not declarations: a call is matched once a list, and its rows are made without another lookup.
        place = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
        found = found.withColumn("_list", F.floor((place - 1) / LISTED)).groupBy(*by, "_list").agg(F.collect_list(F.struct("id")).alias("_ids"))
        by, found = [*by, "_part"], found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        rows = rows.repartition(4 * PARTS, *by).join(found.repartition(4 * PARTS, *by).hint("merge"), by)
        return rows.select(*keys, F.explode("_ids").alias("_d"), F.col(n)).select(*keys, "_d.id", F.lit(which).alias("class"), (F.col(n) > most).alias("unresolved"))

    return met(c.where("_name_file IS NOT NULL"), homes, ["name", "file"], 0, "_name_file").unionByName(met(c.where("_name_file IS NULL"), ids, ["name"], 1, "_name"))


def resolve_imports(imports: DataFrame, targets: DataFrame) -> DataFrame:
    """The target (target, spec, priority) of each import (path, spec): least priority, then name; candidates of a name are reduced before the join."""
    best = targets.groupBy("spec").agg(F.min_by("target", F.struct("priority", "target")).alias("target"))
    return imports.join(best, "spec").select("path", "spec", "target")


def head_labels(runs: DataFrame) -> DataFrame:
    """The repositories, sorted, whose last run is at each commit."""
    heads = runs.groupBy("repo_key").agg(F.max_by("commit", "seq").alias("commit"))
    return heads.groupBy("commit").agg(F.array_join(F.array_sort(F.collect_set("repo_key")), ",").alias("labels"))


