"""Queries on the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridelta.operators import core, dispatch, graph, history
from veridelta.registry import query
from veridelta.shared import Tables

def written(df):
    """A carrier as the table it stands in for: searches read edges once a level, and would derive a carrier anew each time."""
    return Tables(df.sparkSession).save(df)


@query(
    "agg5_edge_dedupe",
    """WITH ok AS (SELECT * FROM edge_sites WHERE src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)), p AS (SELECT *, row_number() OVER (PARTITION BY src, kind, dst ORDER BY seq, path, line) AS n, count(*) OVER (PARTITION BY src, kind, dst) AS c FROM ok)
SELECT src, kind, dst, path, CAST(line AS BIGINT) AS line, CASE WHEN c > 1 THEN c END AS count FROM p WHERE n = 1""",
)
def _(edge_sites, nodes):
    return graph.merge_sites(edge_sites, nodes)


@query("joi9_call_edge_join", "SELECT src, dst, count(*) AS sites FROM edge_sites WHERE kind = 'calls' AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY src, dst")
def _(edge_sites, nodes):
    return graph.call_edges(edge_sites, nodes)


@query("agg34_call_pairs", "SELECT src, dst, CAST(min(seq) AS BIGINT) AS first_seq, bool_or(line > 3) AS call, count(*) AS sites FROM edge_sites WHERE kind = 'calls' GROUP BY src, dst")
def _(edge_sites):
    return graph.call_pairs(edge_sites.where("kind = 'calls'").withColumn("call", F.col("line") > 3))


@query("agg4_graph_kind_counts", "SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")
def _(nodes, edges):
    return graph.kind_counts(nodes, edges)


@query("agg6_external_dependencies", "SELECT src, count(DISTINCT dst) AS dependencies FROM edges WHERE dst LIKE 'dependency:%' GROUP BY src")
def _(edges):
    return graph.external_dependencies(edges)


SHORT = "CASE WHEN regexp_matches(name, '[./]') THEN lower(regexp_extract(name, '[^./]*$')) ELSE '' END"
SEARCH = f"""
WITH s AS (SELECT id, kind, name, CASE WHEN lower(name) = '{{q}}' OR {SHORT} = '{{q}}' THEN 0 WHEN ends_with(lower(name), '{{q}}') OR ends_with(lower(path), '{{q}}') THEN 1 WHEN contains(lower(name), '{{q}}') OR contains(lower(path), '{{q}}') THEN 2 END AS score FROM nodes)
SELECT id, kind, name, CAST(score AS BIGINT) AS score, count(*) OVER () AS total FROM s WHERE score IS NOT NULL ORDER BY score, strlen(name), id LIMIT 30"""


@query("gra2_search", SEARCH.format(q="00001"))
def _(nodes):
    return graph.search(nodes, "00001")


@query("srt7_search_ranking", SEARCH.format(q="an"))
def _(nodes):
    return graph.search(nodes, " AN ")


@query("flt14_kind_search", SEARCH.format(q="n").replace("FROM nodes)", "FROM nodes WHERE kind = 'package')"))
def _(nodes):
    return graph.search(nodes, "n", "package")


@query("gra1_view", "SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY id")
def _(edges):
    return graph.degrees(edges)


@query("gra13_adjacency", "WITH l AS (SELECT row_number() OVER (ORDER BY dst, src) - 1 AS position, dst, src FROM calls) SELECT position, dst, src, min(position) OVER (PARTITION BY dst) AS start, count(*) OVER (PARTITION BY dst) AS calls FROM l")
def _(calls):
    listed = written(graph.adjacency(calls))
    return listed.join(graph.ranges_of(listed), "dst").select("position", "dst", "src", "start", "calls")


LEVELS = """
WITH steps AS (SELECT src AS at_, dst AS to_, 'out' AS dir, kind, '0' || chr(2) || src || chr(2) || kind || chr(2) || dst AS o FROM edges UNION ALL SELECT dst, src, 'in', kind, '1' || chr(2) || src || chr(2) || kind || chr(2) || dst FROM edges),
l0 AS (SELECT '{start}' AS node, CAST([] AS VARCHAR[]) AS place),
r1 AS (SELECT to_ AS node, 1 AS depth, dir, kind, node AS via, list_append(place, o) AS place FROM l0 JOIN steps ON at_ = node WHERE to_ NOT IN (SELECT node FROM l0)),
l1 AS (SELECT * FROM r1 QUALIFY row_number() OVER (PARTITION BY node ORDER BY place) = 1),
r2 AS (SELECT to_ AS node, 2 AS depth, s.dir, s.kind, node AS via, list_append(place, o) AS place FROM l1 JOIN steps s ON at_ = node WHERE to_ NOT IN (SELECT node FROM l0 UNION ALL SELECT node FROM l1)),
l2 AS (SELECT * FROM r2 QUALIFY row_number() OVER (PARTITION BY node ORDER BY place) = 1),
f AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2)
SELECT node, CAST(depth AS BIGINT) AS depth, dir, kind, via, count(*) OVER () AS total FROM f ORDER BY depth, place LIMIT 100"""


@query("gra3_neighbors", LEVELS.format(start="component:ASIA"))
def _(edges):
    return graph.neighbors(written(edges), "component:ASIA").drop("truncated", "timed_out")


PATHS = """
WITH RECURSIVE walk AS (SELECT 'component:ASIA' AS node, CAST([] AS VARCHAR[]) AS place, 0 AS depth
  UNION ALL SELECT e.dst, list_append(place, '0' || chr(2) || e.src || chr(2) || e.kind || chr(2) || e.dst), depth + 1 FROM walk JOIN edges e ON e.src = walk.node WHERE depth < 3),
best AS (SELECT place FROM walk WHERE node = (SELECT max(dst) FROM edges WHERE kind = 'contains' AND src IN (SELECT dst FROM edges WHERE src = 'component:ASIA')) ORDER BY depth, place LIMIT 1),
h AS (SELECT unnest(place) AS e, generate_subscripts(place, 1) AS hop FROM best)
SELECT hop, string_split(e, chr(2))[2] AS src, string_split(e, chr(2))[4] AS dst, string_split(e, chr(2))[3] AS kind FROM h"""


@query("gra4_shortest_path", PATHS)
def _(edges):
    edges = written(edges)
    inside = edges.where("src = 'component:ASIA'").select(F.col("dst").alias("src"))
    end = edges.where("kind = 'contains'").join(inside, "src", "left_semi").agg(F.max("dst")).first()[0]
    return graph.shortest_path(edges, "component:ASIA", end or "")


@query("gra5_overview", "SELECT n.id, n.name, count(DISTINCT a.dst) AS packages, count(b.dst) AS files FROM nodes n LEFT JOIN edges a ON a.src = n.id AND a.kind = 'contains' LEFT JOIN edges b ON b.src = a.dst AND b.kind = 'contains' WHERE n.kind = 'component' GROUP BY ALL")
def _(nodes, edges):
    return graph.components(nodes, edges)


@query(
    "joi13_overview_joins",
    "SELECT f.id, p.src AS package, count(DISTINCT o.dst) AS siblings FROM nodes f JOIN edges p ON p.dst = f.id AND p.kind = 'contains' LEFT JOIN edges o ON o.src = p.src AND o.kind = 'contains' AND o.dst <> f.id WHERE f.kind = 'file' AND NOT f.test GROUP BY f.id, p.src",
)
def _(nodes, edges):
    return graph.surroundings(nodes, edges)


@query("gra6_graph_build", """WITH n AS (SELECT DISTINCT 'node' AS what, kind, id AS src, '' AS dst FROM nodes), e AS (SELECT DISTINCT 'edge' AS what, kind, src, dst FROM edge_sites WHERE src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))
(SELECT *, (SELECT count(*) FROM n) AS total FROM n ORDER BY src, kind, dst LIMIT 200) UNION ALL (SELECT *, (SELECT count(*) FROM e) FROM e ORDER BY src, kind, dst LIMIT 500)""")
def _(nodes, edge_sites):
    return graph.build(nodes, edge_sites, 200, 500)


@query("gra7_structure_edges", "SELECT DISTINCT a.src AS component, a.dst AS package, b.dst AS file FROM edges a JOIN edges b ON b.src = a.dst AND b.kind = 'contains' WHERE a.kind = 'contains' AND a.src LIKE 'component:%'")
def _(edges):
    return graph.structure(edges)


#: Pairs of a type's method and an interface's that may reach it, in SQL over types' and interfaces' methods.
REACHES = """need AS (SELECT interface, count(DISTINCT method) AS need FROM interface_methods GROUP BY interface), impl AS (SELECT m.type, i.interface FROM (SELECT DISTINCT type, method FROM type_methods) m JOIN (SELECT DISTINCT interface, method FROM interface_methods) i USING (method) JOIN need n ON n.interface = i.interface GROUP BY ALL HAVING count(*) = max(need)),
reaches AS (SELECT DISTINCT t.id AS dst, i.id AS via FROM type_methods t JOIN interface_methods i ON i.method = t.method JOIN impl ON impl.type = t.type AND impl.interface = i.interface WHERE t.id <> i.id)"""


def level(d):
    """One level of callers: direct ones, and those of interfaces' methods not yet followed."""
    before = f"f{d - 1}"
    gone = " UNION ALL ".join(["SELECT NULL AS im", *(f"SELECT im FROM t{k}" for k in range(1, d))])
    seen = " UNION ALL ".join(f"SELECT node FROM f{k}" for k in range(d))
    return f"""t{d} AS (SELECT via AS im, min({{'i': iface, 'v': chain}}) AS s FROM {before} JOIN reaches ON dst = node WHERE NOT EXISTS (FROM ({gone}) g WHERE g.im = via) GROUP BY via),
c{d} AS (SELECT src AS caller, dst AS callee, {d} AS depth, iface, list_prepend(src, chain) AS chain FROM (SELECT node, iface, chain FROM {before} UNION ALL SELECT im, 1, s.v FROM t{d}) JOIN calls ON dst = node),
f{d} AS (SELECT caller AS node, min({{'i': iface, 'v': chain}}).i AS iface, min({{'i': iface, 'v': chain}}).v AS chain FROM c{d} WHERE caller NOT IN ({seen}) AND caller NOT IN (SELECT id FROM tests) GROUP BY caller)"""


CALLERS = f"""WITH {REACHES}, tests AS (SELECT id FROM nodes WHERE test), f0 AS (SELECT min(id) AS node, 0 AS iface, [min(id)] AS chain FROM type_methods WHERE id IN (SELECT dst FROM reaches) OR NOT EXISTS (FROM reaches)), {level(1)}, {level(2)}, {level(3)}
SELECT caller, callee, CAST(depth AS BIGINT) AS depth, CASE iface WHEN 1 THEN 'interface' ELSE 'static' END AS through, array_to_string(chain, '>') AS via FROM (FROM c1 UNION ALL FROM c2 UNION ALL FROM c3)"""


@query("gra8_callers", CALLERS)
def _(calls, nodes, type_methods, interface_methods):
    calls = written(calls)
    reaches = written(dispatch.dispatch(type_methods, interface_methods, called(calls)))
    target = dispatch.reachable(type_methods, interface_methods).agg(F.min("dst")).first()[0] or type_methods.agg(F.min("id")).first()[0]
    return dispatch.callers(calls, nodes, target or "", reaches=reaches).withColumn("via", F.array_join("via", ">"))


def reached(n, before):
    """What a level reaches first; a node's way is that of this level."""
    return f"l{n} AS (SELECT b.id, c.src AS node, {n} AS depth, min(greatest(b.iface, c.i)) AS iface FROM {before} b JOIN e c ON c.dst = b.node JOIN d ON d.id = b.id AND d.node = c.src AND d.depth = {n} WHERE {n} = 1 OR b.node NOT IN (SELECT id FROM tests) GROUP BY ALL)"


def reach_sql(targets):
    return f"""WITH RECURSIVE {REACHES}, tests AS (SELECT id FROM nodes WHERE test), l0 AS (SELECT id, id AS node, 0 AS depth, 0 AS iface FROM nodes WHERE {targets}),
e AS (SELECT src, dst, min(i) AS i FROM (SELECT src, dst, 0 AS i FROM calls UNION ALL SELECT c.src, r.dst, 1 FROM calls c JOIN reaches r ON r.via = c.dst) GROUP BY ALL),
w AS (SELECT id, node, 0 AS depth FROM l0 UNION SELECT w.id, c.src, depth + 1 FROM w JOIN e c ON c.dst = w.node WHERE depth < 3 AND (depth = 0 OR w.node NOT IN (SELECT id FROM tests)) AND c.src <> w.id),
d AS (SELECT id, node, min(depth) AS depth FROM w GROUP BY id, node), {reached(1, "l0")}, {reached(2, "l1")}, {reached(3, "l2")},
m AS (SELECT id, node AS test, depth, iface FROM (FROM l1 UNION ALL FROM l2 UNION ALL FROM l3) WHERE node IN (SELECT id FROM tests)),
p AS (SELECT m.*, n.path, n.name, count(*) OVER (PARTITION BY m.id) AS total, row_number() OVER (PARTITION BY m.id ORDER BY depth, path, name) AS place FROM m JOIN nodes n ON n.id = m.test)
SELECT id, test, CAST(depth AS BIGINT) AS depth, CASE iface WHEN 1 THEN 'interface' ELSE 'static' END AS through, path, name, total, place FROM p WHERE place <= 20"""


FUNCTIONS, PLANNED = "kind = 'function'", "kind = 'function' AND id < 'function:Supplier#000000020'"
REACH = reach_sql(FUNCTIONS)


def called(calls):
    return calls.select(F.col("dst").alias("id")).distinct()


def reach(calls, nodes, type_methods, interface_methods, targets=FUNCTIONS, **how):
    calls = written(calls)
    found = dispatch.reaching_tests(calls, nodes, nodes.where(targets), reaches=dispatch.dispatch(type_methods, interface_methods, called(calls)), **how)
    return found.select("id", "test", "depth", "through", "path", "name", "total", "place")


@query("gra9_reaching_tests", REACH)
def _(calls, nodes, type_methods, interface_methods):
    return reach(calls, nodes, type_methods, interface_methods)


@query("srt14_reaching_order", REACH + " AND place = 1")
def _(calls, nodes, type_methods, interface_methods):
    return reach(calls, nodes, type_methods, interface_methods, limit=1)


PLANNED_REACH = reach_sql(PLANNED)


@query("gra14_planned_reach", PLANNED_REACH[: PLANNED_REACH.rindex("SELECT id, test")] + "SELECT id, count(*) AS tests, CAST(min(depth) AS BIGINT) AS nearest FROM p GROUP BY id")
def _(calls, nodes, type_methods, interface_methods):
    return reach(calls, nodes, type_methods, interface_methods, PLANNED, limit=1 << 30).groupBy("id").agg(F.count(F.lit(1)).alias("tests"), F.min("depth").alias("nearest"))


SITES = f"""WITH {REACHES}, s AS (SELECT dst, path, line, src, seq FROM edge_sites WHERE kind = 'calls' AND src NOT IN (SELECT id FROM nodes WHERE test) AND src NOT LIKE '%7' AND line <> 2),
o AS (SELECT *, row_number() OVER (PARTITION BY dst, path, line ORDER BY iface, seq, src) AS n FROM (SELECT *, 0 AS iface FROM s UNION ALL SELECT r.dst, path, line, src, seq, 1 FROM s JOIN reaches r ON r.via = s.dst)),
u AS (SELECT dst, path, CAST(line AS BIGINT) AS line, src, CASE iface WHEN 1 THEN 'interface' ELSE 'static' END AS through FROM o WHERE n = 1)"""


def unchanged(edge_sites, nodes, type_methods, interface_methods, first=None):
    """Functions whose id ends with 7 are touched; second lines are added."""
    sites = written(edge_sites.where("kind = 'calls'"))
    reaches = dispatch.dispatch(type_methods, interface_methods, called(sites))
    return dispatch.unchanged_callers(sites, nodes.where(F.col("id").endswith("7")), nodes.where("test"), reaches, sites.where("line = 2"), first)


@query("gra10_unchanged_callers", SITES + " SELECT * FROM u")
def _(edge_sites, nodes, type_methods, interface_methods):
    return unchanged(edge_sites, nodes, type_methods, interface_methods)


@query("srt15_caller_caps", SITES + ", p AS (SELECT *, count(*) OVER (PARTITION BY dst) AS total, row_number() OVER (PARTITION BY dst ORDER BY path, line, src) AS place FROM u) SELECT * FROM p WHERE place <= 10 ORDER BY dst, place LIMIT 100")
def _(edge_sites, nodes, type_methods, interface_methods):
    return dispatch.capped_callers(unchanged(edge_sites, nodes, type_methods, interface_methods, first=dispatch.CALLERS_IN_ALL))


@query("gra11_references", "WITH m AS (SELECT dst AS \"to\", min(src) AS via FROM calls GROUP BY dst), r AS (SELECT dst, src, sites, 0 AS through FROM calls UNION ALL SELECT \"to\", src, sites, 1 FROM calls JOIN m ON via = dst) SELECT dst, src, sites, CAST(through AS BIGINT) AS through, count(*) OVER (PARTITION BY dst) AS total FROM r QUALIFY row_number() OVER (PARTITION BY dst ORDER BY through, src) <= 20")
def _(calls):
    # The first caller of each function stands in for an interface method that the function implements.
    return graph.references(calls, calls.groupBy("dst").agg(F.min("src").alias("via")), 20)


@query(
    "gra12_inspect_symbol",
    "SELECT id, CAST(coalesce((SELECT sum(sites) FROM calls WHERE dst = id), 0) AS BIGINT) AS \"references\", (SELECT count(*) FROM calls WHERE dst = id) AS callers, (SELECT count(*) FROM calls WHERE src = id) AS callees, (SELECT count(*) FROM calls c JOIN nodes t ON t.id = c.src WHERE c.dst = n.id AND t.test) AS tests FROM nodes n WHERE kind = 'function'",
)
def _(calls, nodes):
    return graph.inspect(calls, nodes)


DELTA = """
WITH a AS (SELECT src, kind, dst FROM edges_head EXCEPT SELECT src, kind, dst FROM edges_base), r AS (SELECT src, kind, dst FROM edges_base EXCEPT SELECT src, kind, dst FROM edges_head),
u AS (SELECT 'added' AS change, * FROM a UNION ALL SELECT 'removed', * FROM r), p AS (SELECT *, count(*) OVER (PARTITION BY change) AS total, row_number() OVER (PARTITION BY change ORDER BY CASE kind WHEN 'depends_on' THEN 1 ELSE 2 END, src, kind, dst) AS n FROM u)
"""


@query("joi17_structural_delta", DELTA + "SELECT change, src, kind, dst, total FROM p WHERE n <= 100")
def _(edges_base, edges_head):
    return graph.delta(edges_base, edges_head).select("change", "src", "kind", "dst", "total")


@query("srt12_delta_order", DELTA + "SELECT change, src, kind, dst, total FROM p WHERE n <= 5")
def _(edges_base, edges_head):
    return graph.delta(edges_base, edges_head, limit=5).select("change", "src", "kind", "dst", "total")


@query("set4_set_difference", "SELECT change, src, kind, dst FROM (SELECT 'added' AS change, * FROM (SELECT src, kind, dst FROM edges_head EXCEPT SELECT src, kind, dst FROM edges_base) UNION ALL SELECT 'removed', * FROM (SELECT src, kind, dst FROM edges_base EXCEPT SELECT src, kind, dst FROM edges_head))")
def _(edges_base, edges_head):
    return core.difference(edges_base, edges_head, ["src", "kind", "dst"])


@query("joi12_import_edges", "SELECT DISTINCT a.n_name AS src, b.n_name AS dst FROM (SELECT DISTINCT c_nationkey AS x, s_nationkey AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey) e JOIN nation a ON a.n_nationkey = x JOIN nation b ON b.n_nationkey = y WHERE x <> y")
def _(orders, customer, lineitem, supplier, nation):
    uses = lineitem.select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct().join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src")), "l_orderkey")
    owner = lambda t, k, prefix, n: t.select(F.concat(F.lit(prefix), F.col(k).cast("string")).alias("id"), F.col(n).alias("n_nationkey")).join(nation, "n_nationkey").select("id", F.col("n_name").alias("owner"))
    return graph.depends_on(uses, owner(customer, "c_custkey", "c", "c_nationkey").unionByName(owner(supplier, "s_suppkey", "s", "s_nationkey")))


@query("joi34_graph_node_resolve", f"WITH refs AS (SELECT id AS ref FROM nodes WHERE id LIKE '%5' UNION SELECT name FROM nodes UNION SELECT {SHORT} FROM nodes WHERE kind = 'function'), hits AS (SELECT ref, 0 AS p, id FROM refs JOIN nodes ON id = ref UNION SELECT ref, 1, id FROM refs JOIN nodes ON id = 'file:' || ref UNION SELECT ref, 2, id FROM refs JOIN nodes ON id = 'package:' || ref UNION SELECT ref, 3, id FROM refs JOIN nodes ON id = 'component:' || ref UNION SELECT ref, 9, id FROM refs JOIN nodes ON lower(ref) = lower(name) OR lower(ref) = nullif({SHORT}, '')) SELECT ref, id FROM hits QUALIFY p = min(p) OVER (PARTITION BY ref)")
def _(nodes):
    refs = nodes.where(F.col("id").endswith("5")).select(F.col("id").alias("ref")).union(nodes.select("name")).union(nodes.where("kind = 'function'").select(graph.short_name(F.col("name")))).distinct()
    return graph.resolve(nodes, refs)


@query("joi11_longest_prefix", "WITH roots AS (SELECT unnest(['src', 'src/auth', 'pkg/deep', 'internal']) AS root), h AS (SELECT path, max(length(root)) AS n FROM paths JOIN roots ON starts_with(path, root || '/') OR path = root GROUP BY path) SELECT p.path, CASE WHEN n IS NOT NULL THEN left(p.path, n) WHEN contains(p.path, '/') THEN string_split(p.path, '/')[1] ELSE '.' END AS component FROM paths p LEFT JOIN h USING (path)")
def _(paths):
    roots = paths.sparkSession.createDataFrame([(r,) for r in ("src", "src/auth", "pkg/deep", "internal")], "root string")
    return graph.longest_prefix(paths, roots)


@query("joi36_implementers", "WITH m AS (SELECT DISTINCT p_brand AS type, p_size AS method FROM part), i AS (SELECT DISTINCT concat('I', CAST(p_size % 7 AS string)) AS interface, p_size AS method FROM part WHERE p_size % 2 = 0), n AS (SELECT interface, count(*) AS need FROM i GROUP BY interface) SELECT m.type, i.interface FROM m JOIN i USING (method) JOIN n ON n.interface = i.interface GROUP BY m.type, i.interface HAVING count(*) = max(need)")
def _(part):
    methods = part.select(F.col("p_brand").alias("type"), F.col("p_size").alias("method"))
    return dispatch.implementers(methods, part.where("p_size % 2 = 0").select(F.concat(F.lit("I"), (F.col("p_size") % 7).cast("string")).alias("interface"), F.col("p_size").alias("method")))


@query("gra16_literal_search", "SELECT doc_id, CAST(n AS BIGINT) AS line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE contains(text, 'License') ORDER BY doc_id, n LIMIT 100")
def _(documents):
    return graph.search_lines(documents, "License", 100)


@query("gra17_commit_graph", "WITH RECURSIVE c AS (SELECT c_custkey AS sha, unnest([c_custkey - 20, CASE WHEN c_custkey % 50 = 0 THEN c_custkey // 2 END]) AS parent FROM customer), w AS (SELECT max(c_custkey) AS sha, 0 AS depth FROM customer UNION SELECT parent, depth + 1 FROM w JOIN c USING (sha) WHERE parent IS NOT NULL) SELECT concat('k', sha) AS sha, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY sha")
def _(customer):
    k = F.col("c_custkey")
    parents = F.posexplode(F.array(k - 20, F.when(k % 50 == 0, F.floor(k / 2)))).alias("place", "parent")
    name = lambda c: F.concat(F.lit("k"), F.col(c).cast("string")).alias(c)
    commits = customer.select(k.alias("sha"), parents).where("parent IS NOT NULL").select(name("sha"), name("parent"), "place")
    return history.commit_depths(commits, f"k{customer.agg(F.max('c_custkey')).first()[0]}")


@query("joi32_symbol_resolve", "WITH refs AS (SELECT DISTINCT concat('pkg.', s_name) AS ref FROM supplier UNION SELECT s_name FROM supplier WHERE s_suppkey % 3 = 0 UNION SELECT concat('function:', s_name) FROM supplier WHERE s_suppkey % 5 = 0), h AS (SELECT ref, id, CASE WHEN id = ref THEN 0 WHEN name = ref THEN 2 ELSE 3 END AS class FROM refs JOIN nodes ON kind = 'function' AND (id = ref OR name = ref OR ends_with(name, '.' || ref))) SELECT ref, id, CAST(class AS BIGINT) AS class FROM h QUALIFY class = min(class) OVER (PARTITION BY ref)")
def _(supplier, nodes):
    name = F.col("s_name")
    refs = supplier.select(F.concat(F.lit("pkg."), name).alias("ref")).union(supplier.where("s_suppkey % 3 = 0").select(name)).union(supplier.where("s_suppkey % 5 = 0").select(F.concat(F.lit("function:"), name)))
    return graph.resolve_symbols(refs, nodes)


@query("joi33_call_resolve", "WITH c AS (SELECT l_suppkey AS caller, l_partkey % 30 AS name, l_orderkey % 8 AS file FROM lineitem), d AS (SELECT s_suppkey AS id, s_suppkey % 30 AS name, s_suppkey % 8 AS file FROM supplier), h AS (SELECT DISTINCT c.caller, c.name, c.file, d.id, CASE WHEN d.file = c.file THEN 0 ELSE 1 END AS class FROM c JOIN d ON d.name = c.name), b AS (SELECT * FROM h QUALIFY class = min(class) OVER (PARTITION BY caller, name, file)) SELECT caller, name, file, id, CAST(class AS BIGINT) AS class, count(*) OVER (PARTITION BY caller, name, file) > 3 AS unresolved FROM b")
def _(lineitem, supplier):
    calls = lineitem.selectExpr("l_suppkey AS caller", "l_partkey % 30 AS name", "l_orderkey % 8 AS file")
    return graph.resolve_calls(calls, supplier.selectExpr("s_suppkey AS id", "s_suppkey % 30 AS name", "s_suppkey % 8 AS home"))


@query("joi10_import_resolution", "WITH s AS (SELECT DISTINCT path, concat('f', CAST(length(path) * 7 % 300 AS string)) AS spec FROM paths), t AS (SELECT path AS target, regexp_extract(path, 'f[0-9]+') AS name, starts_with(path, 'src/') AS own FROM paths), h AS (SELECT s.path, spec, target, CASE WHEN own THEN 0 ELSE 1 END AS priority FROM s JOIN t ON name = spec) SELECT path, spec, arg_min(target, {'p': priority, 't': target}) AS target FROM h GROUP BY path, spec")
def _(paths):
    imports = paths.select("path", F.concat(F.lit("f"), (F.length("path") * 7 % 300).cast("string")).alias("spec"))
    targets = paths.select(F.col("path").alias("target"), F.regexp_extract("path", "f[0-9]+", 0).alias("spec"), F.when(F.col("path").startswith("src/"), 0).otherwise(1).alias("priority"))
    return graph.resolve_imports(imports, targets)


@query("joi38_head_labels", "WITH RECURSIVE h AS (SELECT repo_key, arg_max(commit, seq) AS sha FROM runs GROUP BY repo_key), c AS (SELECT concat('c', o_orderkey) AS sha, CASE WHEN o_orderkey >= 9 THEN concat('c', o_orderkey - 9) END AS parent FROM orders), w AS (SELECT sha, repo_key AS label, 0 AS distance FROM h WHERE sha IN (SELECT sha FROM c) UNION ALL SELECT parent, label, distance + 1 FROM w JOIN c USING (sha) WHERE parent IS NOT NULL), b AS (SELECT * FROM w QUALIFY distance = min(distance) OVER (PARTITION BY sha)) SELECT sha, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, CAST(distance AS BIGINT) AS distance FROM b GROUP BY sha, distance")
def _(runs, orders):
    """Orders stand in for commits: nine branches, each a line."""
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    n = F.col("o_orderkey")
    commits = orders.select(name(n).alias("sha"), F.when(n >= 9, name(n - 9)).alias("parent"))
    heads = runs.groupBy("repo_key").agg(F.max_by("commit", "seq").alias("sha"))
    return history.nearest_labels(commits, heads.select("sha", F.col("repo_key").alias("label")))
