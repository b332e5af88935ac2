"""Queries on packages, lexers, paged sources, sinks and the catalog of questions."""

from __future__ import annotations

import json
from collections import namedtuple

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from veridelta import sinks
from veridelta.functions.repair import repair_json
from veridelta.operators import documents as dc
from veridelta.operators import tools
from veridelta.registry import query
from veridelta.shared import Tables
from veridelta.sources import apis, git, lexer, packages
from veridelta.sources import lines as src
from veridelta.streaming import replay

#: Packages are made and read in so many parts.
PARTS = 128
W = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def built(df, key, make):
    """(path, content): a package of each key, made of its rows, sorted by their other columns."""
    rest = [c for c in df.columns if c != key]
    dealt = df.select(F.col(key).cast("string").alias("path"), *rest).repartition(PARTS, "path")  # rows are few bytes but much work: Spark would merge them to few tasks
    lists = dealt.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows"))
    row = namedtuple("row", rest)

    def each(batches):
        for b in batches:
            for path, rows in zip(b["path"], b["rows"], strict=True):
                held = rows.values
                yield path.as_py(), packages.zipped(make(list(map(row, *(held.field(c).to_pylist() for c in rest)))))

    return lists.mapInArrow(lambda batches: packages.handed_on(each(batches), "path string, content binary"), "path string, content binary")


def workbook(b: list) -> dict[str, str]:
    cell = lambda r: f'<c r="B{r.row}" t="str">' + (f"<f>{r.formula[1:]}</f>" if r.formula else "") + f"<v>{r.value}</v></c>"
    rows = "".join(f'<row r="{r.row}">{cell(r)}</row>' for r in b)
    return {
        "xl/workbook.xml": f'<workbook {W}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>",
    }


XL = "SELECT sheet AS path, 'S' AS sheet, concat('B', row) AS ref, value, ltrim(formula, '=') AS formula FROM cells_before"


@query("src33_spreadsheet_scan", XL, python=True)
def _(cells_before):
    return packages.read(built(cells_before.select("sheet", "row", "value", "formula"), "sheet", workbook), packages.cells, packages.CELLS).select("path", "sheet", "ref", "value", "formula")


@query("src34_sheet_scan", "SELECT sheet AS path, count(*) AS cells, count(*) FILTER (formula <> '') AS formulas FROM cells_before GROUP BY sheet", python=True)
def _(cells_before):
    c = packages.read(built(cells_before.select("sheet", "row", "value", "formula"), "sheet", workbook), packages.cells, packages.CELLS)
    return c.groupBy("path").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("formula") != "").alias("formulas"))


@query("src32_package_open", "SELECT CAST(sheet AS VARCHAR) AS path, unnest(['xl/workbook.xml', 'xl/_rels/workbook.xml.rels', 'xl/worksheets/sheet1.xml']) AS name, 'plain' AS class FROM (SELECT DISTINCT sheet FROM cells_before)", python=True)
def _(cells_before):
    return packages.read(built(cells_before.select("sheet", "row", "value", "formula"), "sheet", workbook), packages.parts, packages.PARTS).select("path", "name", "class")


def letter(b: list) -> dict[str, str]:
    return {"word/document.xml": "<document><body>" + "".join(f"<p><r><t>turn {r.turn}</t></r><r><t> by {r.role}</t></r></p><p/>" for r in b) + "</body></document>"}


@query("src35_document_scan", "SELECT CAST(conv_id AS VARCHAR) AS path, 'document' AS section, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, concat('turn ', turn, ' by ', role) AS text FROM conversations", python=True)
def _(conversations):
    return packages.read(built(conversations.select("conv_id", "turn", "role"), "conv_id", letter), packages.paragraphs, packages.PARAGRAPHS).drop("error")


def show(b: list) -> dict[str, str]:
    out = {
        "ppt/presentation.xml": f"<presentation {W}><sldIdLst>" + "".join(f'<sldId id="{256 + i}" r:id="s{i}"/>' for i in range(len(b))) + "</sldIdLst></presentation>",
        "ppt/_rels/presentation.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="s{i}" Target="slides/slide{i}.xml"/>' for i in range(len(b))) + "</Relationships>",
    }
    return out | {f"ppt/slides/slide{i}.xml": f'<sld show="{int(r.turn % 2 == 0)}"><p><t>{r.role} {r.turn}</t></p></sld>' for i, r in enumerate(b)}


@query("src36_slide_scan", "SELECT CAST(conv_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, turn % 2 <> 0 AS hidden, concat(role, ' ', turn) AS text FROM conversations", python=True)
def _(conversations):
    return packages.read(built(conversations.select("conv_id", "turn", "role"), "conv_id", show), packages.slides, packages.SLIDES).drop("error")


@query("src37_xml_tree", "SELECT CAST(n_nationkey AS VARCHAR) AS path, CAST(unnest([0, 1, 1]) AS BIGINT) AS depth, unnest(['nation', 'name', 'region']) AS tag, unnest(['', n_name, CAST(n_regionkey AS VARCHAR)]) AS text FROM nation", python=True)
def _(nation):
    xml = F.concat(F.lit("<nation><name>"), "n_name", F.lit("</name><region>"), F.col("n_regionkey").cast("string"), F.lit("</region></nation>"))
    return packages.read(nation.select(F.col("n_nationkey").cast("string").alias("path"), xml.cast("binary").alias("content")), packages.nodes, packages.NODES, package=False).drop("error")


#: A text in each language, what it declares and calls on which lines, and how many tokens and texts it has.
CODE = {
    "py": ('class C{k}(B):\n    """def no(): g()"""\n    def m(self):\n        # h()\n        return h{k}(x) + "i()"\ndef f{k}(a):\n    return a.b{k}.c(1)\n', "class C{k} 1, method C{k}.m 3, calls h{k} 5, function f{k} 6, calls a.b{k}.c 7", 35, 2),
    "ts": ("export class C{k} {\n  m(a = /g(x)/): void { this.h{k}(`t ${ u{k}(`n()`) } no()`); }\n}\ntype T{k} = string;\nconst f{k} = (x) => x / 2 / k{k}(x);\n", "class C{k} 1, method C{k}.m 2, calls this.h{k} 2, calls u{k} 2, type T{k} 4, function f{k} 5, calls k{k} 5", 48, 3),
    "rs": ("struct S{k} { x: &'static str }\nimpl S{k} {\n  fn new() -> Self { h{k}(r#\"g(\"x\")\"#) }\n}\nfn f{k}() { S{k}::new(); }\n", "type S{k} 1, method S{k}.new 3, calls h{k} 3, function f{k} 5, calls S{k}.new 5", 37, 1),
}
LANGUAGES = list(CODE)


def code(part, language):
    k = F.col("p_partkey")
    return part.where(k % len(LANGUAGES) == LANGUAGES.index(language)).select(k.cast("string").alias("id"), F.replace(F.lit(CODE[language][0]), F.lit("{k}"), k.cast("string")).alias("text"))


def coded(what):
    """SQL over the parts of each language, from a list of (what, name, line)."""
    each = [f"SELECT p_partkey AS k, unnest([{what(CODE[g])}]) AS r FROM part WHERE p_partkey % {len(CODE)} = {n}" for n, g in enumerate(LANGUAGES)]
    return " UNION ALL ".join(each)


FACTS = coded(lambda c: ", ".join("{'a': '%s', 'b': '%s', 'line': %s}" % tuple(f.rsplit(" ", 2)) for f in c[1].split(", ")))


@query("src30_lexical_parse", f"SELECT CAST(k AS VARCHAR) AS id, r.a AS a, replace(r.b, '{{k}}', CAST(k AS VARCHAR)) AS b, CAST(r.line AS BIGINT) AS line FROM ({FACTS})", python=True)
def _(part):
    py, ts, rs = (lexer.parse(code(part, g), lexer.declarations, g) for g in LANGUAGES)
    return py.unionByName(ts).unionByName(rs)


@query("src31_tokenizer", "SELECT CAST(k AS VARCHAR) AS id, CAST(r.t AS BIGINT) AS tokens, CAST(r.s AS BIGINT) AS strings FROM (" + coded(lambda c: "{'t': %d, 's': %d}" % c[2:]) + ")", python=True)
def _(part):
    py, ts, rs = (lexer.parse(code(part, g), lexer.tokens, g) for g in LANGUAGES)
    return py.unionByName(ts).unionByName(rs).groupBy("id").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("a") == "string").alias("strings"))


@query("src28_go_imports", "SELECT CAST(p_size AS VARCHAR) AS id, concat('m/', p_partkey) AS name, 'import' AS fact FROM part UNION ALL SELECT DISTINCT CAST(p_size AS VARCHAR), 'T', 'type' FROM part")
def _(part):
    g = part.groupBy(F.col("p_size").cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.concat(F.lit('\t"m/'), F.col("p_partkey").cast("string"), F.lit('"')))).alias("l"))
    t = g.select("id", F.concat(F.lit("package x\n\nimport (\n"), F.array_join("l", "\n"), F.lit('\n)\n\ntype T struct {\n}\n\nvar s = "not"\n')).alias("text"))
    return src.go_facts(t).select("id", "fact", "name")


@query("src6_blob_stream", "SELECT doc_id, sha256(text) AS oid, strlen(text) AS size FROM documents")
def _(documents):
    files = documents.select("doc_id", F.col("text").alias("content"))
    requests = files.select(F.col("doc_id").alias("place"), F.sha2("content", 256).alias("oid"))
    return git.read_in_order(git.blobs(files.select("content")), requests).select(F.col("place").alias("doc_id"), "oid", F.octet_length("content").alias("size"))


@query("src19_jest_observations", "SELECT CAST(user_id AS VARCHAR) AS id, concat('T', event_id) AS test, 'k' AS key, event_type AS value FROM events")
def _(events):
    name = F.concat(F.lit("T"), F.col("event_id").cast("string"))
    g = events.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct(name, F.create_map(F.lit("k"), F.col("event_type"))))).alias("observed"))
    return src.jest_observations(g.select("id", F.to_json(F.struct("observed")).alias("text")))


@query("src20_pytest_observations", "SELECT CAST(user_id AS VARCHAR) AS id, concat('T', event_id % 9) AS test, concat('k', event_id) AS key, event_type AS value FROM events")
def _(events):
    prop = F.concat(F.lit('<property name="observe.k'), F.col("event_id").cast("string"), F.lit('" value="'), "event_type", F.lit('"/>'))
    case = events.groupBy("user_id", (F.col("event_id") % 9).alias("k")).agg(F.array_join(F.collect_list(prop), "").alias("p"))
    row = F.concat(F.lit('<testcase name="T'), F.col("k").cast("string"), F.lit('"><properties>'), "p", F.lit("</properties></testcase>"))
    t = case.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.concat(F.lit("<testsuite>"), F.array_join(F.collect_list(row), ""), F.lit("</testsuite>")).alias("text"))
    return src.junit_observations(t)


@query("src22_fuzz_parse", "SELECT CAST(o_orderkey // 50 AS VARCHAR) AS id, row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) - 1 AS i, concat('f(', o_custkey, ')') AS call, sha256(CAST(o_orderkey AS VARCHAR)) AS sha256, o_custkey AS length FROM orders")
def _(orders):
    k = F.col("o_orderkey")
    rows = orders.withColumn("g", F.floor(k / 50)).withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("o_orderkey")) - 1)
    call = F.concat(F.lit("f("), F.col("o_custkey").cast("string"), F.lit(")"))
    record = F.to_json(F.struct("i", call.alias("call"), F.sha2(k.cast("string"), 256).alias("sha256"), F.col("o_custkey").alias("length")))
    g = rows.groupBy(F.col("g").cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct("i", call.alias("c"), record.alias("r")))).alias("l"))
    head = F.to_json(F.struct(F.size("l").alias("planned"), F.transform("l", lambda x: x["c"]).alias("calls")))
    end = F.when(F.col("id").cast("bigint") % 2 == 0, '{"state":"complete"}').otherwise('{"state":"interrupted"}')
    return src.fuzz_results(g.select("id", F.array_join(F.concat(F.array(head), F.transform("l", lambda x: x["r"]), F.array(end)), "\n").alias("text")))


LIST = "WITH p AS (SELECT CAST(n_regionkey AS BIGINT) AS source, n_nationkey // 5 AS page, n_nationkey, n_name FROM nation)"


def pages(nation, item):
    rows = nation.groupBy(F.col("n_regionkey").alias("source"), F.floor(F.col("n_nationkey") / 5).alias("page")).agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), item.alias("i")))).alias("l"))
    return rows.select("source", "page", F.transform("l", lambda x: x["i"]).alias("items"))


def server(nation, per_page=2):
    """Pages of a source, as an interface hands them out: the nations of a region (25 rows in all)."""
    held = {}
    for r in nation.orderBy("n_nationkey").limit(100).collect():
        held.setdefault(str(r.n_regionkey), []).append((r.n_nationkey, r.n_name))

    def fetch(source, cursor):
        at = int(cursor or 0)
        rows, end = held[source][at : at + per_page], at + per_page
        return rows, (str(end) if end < len(held[source]) else None)

    return held, fetch


@query("src44_repo_listing", "SELECT CAST(n_regionkey AS VARCHAR) AS source, n_name AS name FROM nation WHERE n_nationkey % 4 <> 0", python=True)
def _(nation):
    spark, (held, fetch) = nation.sparkSession, server(nation)
    apis.register_listing(spark, "repositories", "name string, archived boolean", lambda s, c: ([(n, k % 4 == 0) for k, n in fetch(s, c)[0]], fetch(s, c)[1]))
    return spark.read.format("repositories").option("sources", ",".join(held)).load().where("NOT archived").select("source", "name")


@query("src42_full_sync", "SELECT CAST(n_regionkey AS VARCHAR) AS source, concat('t', n_regionkey) AS token, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation", python=True)
def _(nation):
    spark, (held, fetch) = nation.sparkSession, server(nation)
    apis.register_listing(spark, "drive_files", "id string, name string", lambda s, c: ([(str(k), n) for k, n in fetch(s, c)[0]], fetch(s, c)[1]), lambda s: f"t{s}")
    return spark.read.format("drive_files").option("sources", ",".join(held)).load()


@query("src43_change_feed", "SELECT CAST(n_nationkey % 3 AS VARCHAR) AS key, arg_max(n_name, n_nationkey) AS value FROM nation WHERE n_regionkey = 1 GROUP BY 1 HAVING arg_max(n_nationkey % 5 <> 0, n_nationkey)", python=True)
def _(nation):
    spark, (_, fetch) = nation.sparkSession, server(nation)

    def changes(source, token):
        rows, cursor = fetch(source, token)
        return [(str(k % 3), "error" if k % 5 == 0 else "change", n, k) for k, n in rows], cursor or "9999", cursor is None

    apis.register_feed(spark, "drive_changes", "key string, kind string, value string, seq bigint", lambda s: "0", changes)
    read = spark.readStream.format("drive_changes").option("sources", "1").load()
    return replay.apply_feed(replay.appended(read).select("key", "kind", "value", "seq"))


@query("snk1_report_write", "SELECT f AS format, id, kind, severity, summary FROM signals, (VALUES ('parquet'), ('json')) t(f) WHERE severity = 'critical'")
def _(signals):
    spark = signals.sparkSession
    critical = signals.where("severity = 'critical'").select("id", "kind", "severity", "summary")
    written = sinks.write_report(critical, f"{Tables(spark).at}/report", sinks.FORMATS)
    both = [getattr(spark.read.schema(critical.schema), f)(at).withColumn("format", F.lit(f)) for f, at in zip(sinks.FORMATS, written, strict=True)]
    return both[0].unionByName(both[1])


@query("snk2_atomic_write", "SELECT kind, count(*) AS n FROM signals GROUP BY kind")
def _(signals):
    return Tables(signals.sparkSession).save(signals.groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


@query("sca43_json_repair", "SELECT CAST(p_partkey AS VARCHAR) AS id, concat('{\"a\":[', p_size, ',2],\"n\":\"', p_brand, '\"}') AS fixed FROM part", python=True)
def _(part):
    broken = F.concat(F.lit("```json\n{'n': '"), "p_brand", F.lit("', \"a\": ["), F.col("p_size").cast("string"), F.lit(", 2,]"), F.when(F.col("p_partkey") % 2 == 0, "}\n```").otherwise(""))

    @F.pandas_udf("string")
    def fix(t: pd.Series) -> pd.Series:
        return t.map(repair_json)

    return part.select(F.col("p_partkey").cast("string").alias("id"), fix(broken).alias("fixed"))


#: Edges looked at level by level in order of the chain that leads to them; the fifteenth is the last.
BUDGET = """WITH s AS (SELECT src AS at_, dst AS to_, '0' || chr(2) || src || chr(2) || kind || chr(2) || dst AS o FROM edges WHERE kind = 'contains' UNION ALL SELECT dst, src, '1' || chr(2) || src || chr(2) || kind || chr(2) || dst FROM edges WHERE kind = 'contains'),
l AS (SELECT at_, to_, [o] AS p, 1 AS d FROM s WHERE at_ = 'component:ASIA'), f AS (SELECT to_ AS node, min(p) AS p FROM l WHERE to_ <> 'component:ASIA' GROUP BY to_),
m AS (SELECT s.at_, s.to_, list_append(f.p, o) AS p, 2 AS d FROM f JOIN s ON s.at_ = f.node), k AS (SELECT *, row_number() OVER (ORDER BY d, p) AS n FROM (FROM l UNION ALL FROM m)),
r AS (SELECT to_ AS node, min(d) AS depth FROM k WHERE n <= 15 AND to_ <> 'component:ASIA' GROUP BY to_)
SELECT node, CAST(depth AS BIGINT) AS depth, count(*) OVER () AS total, (SELECT count(*) FROM k) > 15 AS truncated FROM r"""


@query("gra15_search_budget", BUDGET)
def _(edges):
    return tools.bounded_neighbors(edges.where("kind = 'contains'"), "component:ASIA", 15, 2).select("node", "depth", "total", "truncated")


#: What follows each line, so that it has more places than one: where they begin after the line, what they are, what they become.
TAIL = " && y >= 2 || ok == true + \"a < b\" // c > d"
PLACES = "(VALUES (2, 'swap_logical', '&&', '||'), (7, 'boundary', '>=', '>'), (10, 'increment_constant', '2', '(2+1)'), (12, 'swap_logical', '||', '&&'), (18, 'negate_comparison', '==', '!='), (21, 'flip_boolean', 'true', 'false')) v(o, operator, found, put)"
RANKS = "['drop_error', 'negate_condition', 'boundary', 'negate_comparison', 'swap_logical', 'increment_constant', 'flip_boolean', 'swap_arithmetic']"


@query(
    "evd11_mutation_sites",
    f"""WITH a AS (SELECT * FROM diff_lines WHERE kind = 'add'), s AS (SELECT path, line, length(content) + o AS "at", operator, found, put FROM a, {PLACES}
UNION ALL SELECT path, line, strpos(content, f), op, f, p FROM a, (VALUES ('==', '!=', 'negate_comparison'), ('<', '<=', 'boundary')) x(f, p, op) WHERE contains(content, f)
UNION ALL SELECT path, line, length(content), 'increment_constant', content[-1], concat('(', content[-1], '+1)') FROM a WHERE contains(content, '==') OR contains(content, '<')),
n AS (SELECT *, count(*) OVER (PARTITION BY path) AS total, row_number() OVER (PARTITION BY path ORDER BY line, list_position({RANKS}, operator), "at") AS place FROM s)
SELECT path, CAST(line AS BIGINT) AS line, CAST("at" AS BIGINT) AS "at", operator, found, put, total, place FROM n WHERE place <= 10""",
)
def _(diff_lines):
    return tools.mutation_sites(diff_lines.withColumn("content", F.concat("content", F.lit(TAIL))), 10)


@query("str3_sampled_eviction", "WITH k AS (SELECT user_key AS store, repo_key AS key, max(seq) AS activity FROM runs GROUP BY ALL), s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY store ORDER BY sha256(key)) <= 8) SELECT store, arg_min(key, {'a': activity, 'k': key}) AS key FROM s GROUP BY store")
def _(runs):
    return tools.evict(runs.groupBy(F.col("user_key").alias("store"), F.col("repo_key").alias("key")).agg(F.max("seq").alias("activity")))


@query("ext1_tool_catalog", "SELECT * FROM (VALUES " + ", ".join(f"('{t.name}', '{t.about}')" for t in tools.CATALOG.values()) + ") c(name, about)")
def _(region):
    return tools.catalog(region.sparkSession).select("name", "about")


@query("ext2_tool_dispatch", "SELECT id, severity FROM signals WHERE severity IN ('high', 'critical')")
def _(signals):
    return tools.call("get_findings", {"signals": signals}, minimum="high").select("id", "severity")


@query("ext3_symbol_query", "SELECT src, dst, sites FROM calls WHERE dst = (SELECT min(dst) FROM calls)")
def _(calls):
    target = calls.agg(F.min("dst")).first()[0]
    return tools.call("find_references", {"calls": calls}, target=target or "")


@query("ext4_tool_schemas", "SELECT * FROM (VALUES " + ", ".join(f"('{t.name}', '{json.dumps(t.schema(), sort_keys=True)}')" for t in tools.CATALOG.values()) + ") c(name, schema)")
def _(region):
    return tools.catalog(region.sparkSession).select("name", "schema")


@query("ext5_command_expansion", "SELECT n_name AS unit, concat('go test ./', n_name, '/... -run ', n_name) AS command FROM nation")
def _(nation):
    return tools.expand_commands(nation.select(F.col("n_name").alias("unit")), ["go", "test", "./{package}/...", "-run", "{package}"]).withColumn("command", F.array_join("command", " "))


@query("ext6_wait_state", "SELECT repo_key, commit, arg_max(status, seq) AS status, arg_max(status, seq) NOT IN ('queued', 'running') AS done FROM runs GROUP BY ALL")
def _(runs):
    # The writes of runs arrive as a stream; when it has read them, what each is waited for is read.
    rows, at = runs.select("repo_key", "commit", "seq", "status"), []

    def feed(stream, folder):
        at[:] = [folder]
        if not tools.wait_for(replay.upsert_to(stream, f"{folder}/table", f"{folder}/log", ["repo_key", "commit"], "seq"), 600):
            raise TimeoutError("the stream hasn't ended")

    replay.arrived(rows, "seq", feed)
    return tools.settled(replay.current(runs.sparkSession, f"{at[0]}/table", rows.schema))


@query("src47_issue_text", "SELECT CAST(item_id AS VARCHAR) AS id, concat('# ', CASE WHEN item_id % 3 = 0 THEN concat('K-', item_id) ELSE concat('Issue ', item_id) END, chr(10), chr(10), trim(text, chr(9) || chr(10) || chr(13) || ' ')) AS intent FROM benchmark")
def _(benchmark):
    k, id_ = F.col("item_id"), F.col("item_id").cast("string").alias("id")
    title = F.when(k % 3 != 0, F.concat(F.lit("Issue "), k.cast("string"))).otherwise(" ")
    key = F.concat(F.lit("K-"), k.cast("string"))
    jira = F.to_json(F.struct(key.alias("key"), F.struct(title.alias("summary"), F.col("text").alias("description")).alias("fields")))
    linear = F.to_json(F.struct(F.struct(F.struct(key.alias("identifier"), title.alias("title"), F.col("text").alias("description")).alias("issue")).alias("data")))
    both = lambda j, ok, tracker: src.issue_text(benchmark.where(ok).select(id_, j.alias("text")), tracker)
    return both(jira, "item_id % 2 = 0", "jira").unionByName(both(linear, "item_id % 2 <> 0", "linear"))


