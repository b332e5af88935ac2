"""Queries on line rules, paths, plans and mutation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridelta.functions import paths as p
from veridelta.operators import mutation, plan, rules, security, weakening
from veridelta.plans import samples
from veridelta.registry import query

SAMPLES = (*samples.secrets(), *samples.settings())


def quoted(s):
    return "'" + s.replace("'", "''") + "'"


def sampled(orders):
    """Files of 25 lines, each a sample; by file plain sources, tests, documentation and lock files."""
    k = F.col("o_orderkey")
    ending = F.when(F.floor(k / 25) % 7 == 1, "_test.go").when(F.floor(k / 25) % 7 == 2, ".md").when(F.floor(k / 25) % 7 == 3, ".lock").otherwise(".go")
    text = F.element_at(F.array(*map(F.lit, SAMPLES)), (k % len(SAMPLES) + 1).cast("int"))
    return orders.select(F.concat(F.lit("src/f"), F.floor(k / 25).cast("string"), ending).alias("path"), (k % 25 + 1).alias("line"), text.alias("content"))


SAMPLED = f"lines AS (SELECT concat('src/f', o_orderkey // 25, CASE o_orderkey // 25 % 7 WHEN 1 THEN '_test.go' WHEN 2 THEN '.md' WHEN 3 THEN '.lock' ELSE '.go' END) AS path, o_orderkey % 25 + 1 AS line, list_extract([{', '.join(map(quoted, SAMPLES))}], CAST(o_orderkey % {len(SAMPLES)} + 1 AS INTEGER)) AS content FROM orders)"
LINES = "lines AS (SELECT concat('doc/', CAST(doc_id AS VARCHAR)) AS path, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


def excluded(r):
    """What keeps a match of a rule from counting, in SQL over content, value and path."""
    noise = "regexp_matches(path, '(_test\\.go|\\.md)$')"
    if r.kind in ("hardcoded_secret", "credential_in_url"):
        out = f"regexp_matches(trim(v, '\"''`'), {quoted(security.PLACEHOLDER)}) OR regexp_matches(v, '[${{}}<>]')"
        if r.label == "secret-named value assigned a literal":
            out += f" OR regexp_matches(content, {quoted(security.INDIRECTION)}) OR NOT (regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[^A-Za-z_.-]')) OR regexp_matches(v, '^(/|\\./|~/)|://')"
        return out
    if r.kind == "hardcoded_email":
        return f"{noise} OR regexp_matches(v, {quoted(security.BENIGN_EMAIL)}) OR contains(content, '://' || v) OR regexp_matches(lower(v), '\\.(png|svg)$')"
    return f"{noise} OR regexp_matches(v, {quoted(security.BENIGN_IP)})" if r.kind == "hardcoded_ip" else "false"


def hits_sql(lines):
    each = " UNION ALL ".join(
        f"SELECT path, line, content, '{r.kind}' AS kind, '{r.severity}' AS severity, {i} AS rule, '{r.label}' AS label, regexp_extract(content, {quoted(r.pattern)}, {r.group}) AS v FROM lines WHERE strlen(content) <= 4096 AND NOT ends_with(path, '.lock') AND regexp_matches(content, {quoted(r.pattern)}) AND NOT ({excluded(r)})"
        for i, r in enumerate(security.RULES)
    )
    docs, test, own = "ends_with(path, '.md')", "ends_with(path, '_test.go')", "kind IN ('hardcoded_secret', 'private_key', 'credential_in_url')"
    return f"WITH {lines}, u AS ({each}), h AS (SELECT path, CAST(line AS BIGINT) AS line, content, kind, label, CAST(rule AS BIGINT) AS rule, CASE WHEN severity = 'low' OR ({docs} AND NOT {own}) THEN 'low' WHEN ({docs} OR {test}) AND severity IN ('high', 'critical') THEN 'medium' ELSE severity END AS severity FROM u)"


CAPPED = ", r AS (SELECT path, rule, min(line) AS first, count(*) AS hits FROM h GROUP BY path, rule), k AS (SELECT h.*, first, hits, row_number() OVER (PARTITION BY path, kind ORDER BY first, rule, line) AS n FROM h JOIN r USING (path, rule))"
EVIDENCE_TEXT = f"concat('{security.INTRO}', label, CASE WHEN kind IN ('hardcoded_secret', 'private_key', 'credential_in_url') THEN '{security.HIDDEN}' ELSE concat(': ', left(trim(content, ' '), 240)) END, CASE WHEN line = first AND hits > 1 THEN concat(', on ', hits, ' lines of the file') ELSE '' END)"


@query("evd13_security_signals", hits_sql(SAMPLED) + CAPPED + f" SELECT path, line, kind, severity, rule, {EVIDENCE_TEXT} AS evidence, hits FROM k WHERE n <= 3")
def _(orders):
    return security.signals(sampled(orders))


@query("agg21_capped_per_kind", hits_sql(SAMPLED) + CAPPED + " SELECT path, kind, count(*) FILTER (n <= 3) AS kept, count(*) AS total FROM k GROUP BY path, kind")
def _(orders):
    hits = security.hits(sampled(orders)).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("total"))
    return hits.select("path", "kind", F.least("total", F.lit(3)).alias("kept"), "total")


@query("sca10_security_rules", hits_sql(LINES) + " SELECT path, line, kind, rule FROM h")
def _(documents):
    return security.hits(rules.file_lines(documents)).select("path", "line", "kind", "rule")


@query("sca11_mixed_enough", "SELECT DISTINCT v, regexp_matches(v, '[A-Za-z]') AND (regexp_matches(v, '[0-9]') OR regexp_matches(v, '[^A-Za-z0-9_.-]')) AS mixed FROM (SELECT unnest(regexp_extract_all(text, '[^ \\n\\t]{6,}')) AS v FROM documents)")
def _(documents):
    v = documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n\t]{6,}"), F.lit(0))).alias("v")).distinct()
    return v.select("v", security.mixed_enough(F.col("v")).alias("mixed"))


KINDS = "SELECT path, kind, severity, regexp_matches(path, '_test\\.go$') AS test, starts_with(path, 'docs/') AS docs FROM paths, (VALUES ('hardcoded_secret', 'high'), ('debug_enabled', 'medium'), ('hardcoded_email', 'low'), ('private_key', 'critical')) k(kind, severity)"


@query("sca12_adjusted_severity", f"SELECT path, kind, CASE WHEN severity = 'low' THEN 'low' WHEN docs AND kind NOT IN ('hardcoded_secret', 'private_key') THEN 'low' WHEN (test OR docs) AND severity IN ('high', 'critical') THEN 'medium' ELSE severity END AS severity FROM ({KINDS})")
def _(paths):
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity")) for k, s in (("hardcoded_secret", "high"), ("debug_enabled", "medium"), ("hardcoded_email", "low"), ("private_key", "critical")))))
    rows = paths.select("path", kinds.alias("k")).select("path", "k.*")
    return rows.select("path", "kind", security.adjusted_severity(F.col("kind"), F.col("severity"), F.col("path").endswith("_test.go"), F.col("path").startswith("docs/")).alias("severity"))


@query("sca9_function_risk", "SELECT DISTINCT name, CASE WHEN regexp_matches(replace(name, '_', ''), '(?i)(authori[sz]|authenticat|password|login|logout|csrf|permission)') THEN 'auth' WHEN regexp_matches(replace(name, '_', ''), '(?i)(payment|refund|charge|withdraw|deposit|balance)') THEN 'money' ELSE 'none' END AS risk FROM (SELECT concat(event_type, CASE event_id % 5 WHEN 0 THEN '_Log_in' WHEN 1 THEN 'Refund' WHEN 2 THEN 'checkPermission' ELSE 'Total' END) AS name FROM events)")
def _(events):
    k = F.col("event_id") % 5
    name = F.concat("event_type", F.when(k == 0, "_Log_in").when(k == 1, "Refund").when(k == 2, "checkPermission").otherwise("Total"))
    return events.select(name.alias("name"), rules.function_risk(name).alias("risk")).distinct()


#: Lines of tests in four languages, and lines that only look like them.
EDITS = {
    "pkg/c{}_test.go": (
        "\tif sum := Add(2, 5); sum != 7 {", "\tif sum := Add(2, 5); sum < 9 {", "\tif failure != nil {", "\tif <-ready && width<<2 {", '\t\tt.Errorf("sum is %d", sum)', '\t\tt.Log("sum", sum)', "func TestAdds(t *testing.T) {", "func helper(n int) int {",
        '\tt.Skip("needs a disk")', '\t\tt.Skip("needs a disk")', "\trequire.Equal(t, 7, Add(2, 5))", "\trequire.NotNil(t, Add(2, 5))", "\treturn width", "\t} else if a.Len() == nil || b == 4 {", "\tassert.Len(t, rows, 3)",
    ),
    "web/c{}.test.ts": (
        "  expect(area(3)).toBe(9);", "  expect(area(3)).toBeGreaterThanOrEqual(1);", "  expect(area(3)).toBeTruthy();", '  it("squares", () => {', '  it.skip("squares", () => {', '  xdescribe("shapes", () => {', '  describe.only("shapes", () => {', '  fit("one", () => {',
        "  pipe.fit(rows);", "  expect(() => area()).toThrow();", "  expect(() => area()).toThrow(RangeError);", "  assert.deepEqual(rows, [1]);", "  assert(rows);", "  const rows = area(3);", "  expect(run).not.toBeNull();", '  test.todo("later");',
    ),
    "tests/test_c{}.py": (
        "def test_area():", "async def test_later(self):", "def area(n):", "    assert area(3) == 9", "    assert area(3) > 1", "    assert area(3) is not None", "    assert rows == None", "    self.assertEqual(area(3), 9)", "    self.assertTrue(area(3))",
        "    with pytest.raises(ValueError):", '@pytest.mark.skipif(old, reason="old")', "@unittest.expectedFailure", "    rows = area(3) == 9", '    self.skipTest("later")', "    assert 1 << 2 and f() -> None",
    ),
    "tests/c{}.rs": ("#[test]", "#[tokio::test]", "#[ignore]", "fn area(n: u8) -> u8 {", "    assert_eq!(area(3), 9);", "    assert!(area(3) > 1);", "    assert!(area(3).is_some());", "    assert_ne!(area(3), 0);", "    let failed = area(3).unwrap_err();", "    debug_assert!(a >= b);", "    rows.push(9);"),
    "src/c{}.go": ('\tt.Skip("no test file")', "\trequire.Equal(t, 1, 2)"),
    "tests/C{}Test.java": ("    assertEquals(9, area(3));",),
}


def edits(lineitem):
    """Changed lines of files of 40 hunks, of six kinds of files. The samples are a small fixed table."""
    k = F.col("l_orderkey")
    samples = [(i, n, len(x), path, line) for i, (path, x) in enumerate(EDITS.items()) for n, line in enumerate(x)]
    table = lineitem.sparkSession.createDataFrame(samples, "i bigint, n bigint, size bigint, form string, content string")
    sizes = F.array(*(F.lit(len(x)) for x in EDITS.values()))
    rows = lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("f"))
    i = F.floor(k / 40) % len(EDITS)
    rows = rows.withColumn("i", i).withColumn("n", F.col("p") % F.element_at(sizes, (i + 1).cast("int"))).join(F.broadcast(table), ["i", "n"])
    pos = (k % 40 * 10 + F.col("l_linenumber")).alias("pos")
    path = F.replace("form", F.lit("{}"), F.floor(k / 40).cast("string"))
    return rows.select(path.alias("path"), (k % 40).alias("hunk"), pos, F.when(F.col("f") == "A", "add").when(F.col("f") == "R", "delete").otherwise("context").alias("kind"), pos.alias("line"), "content")


def listed(values):
    return f"[{', '.join(values)}]"


EDITED = f"""e AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, min(l_returnflag) AS f FROM lineitem GROUP BY ALL),
lines AS (SELECT replace({listed(map(quoted, EDITS))}[k // 40 % {len(EDITS)} + 1], '{{}}', CAST(k // 40 AS VARCHAR)) AS path, k % 40 AS hunk, k % 40 * 10 + n AS pos, CASE f WHEN 'A' THEN 'add' WHEN 'R' THEN 'delete' ELSE 'context' END AS kind, {listed(listed(map(quoted, x)) for x in EDITS.values())}[k // 40 % {len(EDITS)} + 1] AS own, own[p % len(own) + 1] AS content FROM e)"""


def marks_sql():
    """The marks of each line: a branch for each language, over the files of tests only."""

    def flags(x):
        has = lambda p: f"regexp_matches(content, {quoted(p)})" if p else "false"
        compares = has(x.statement)
        strict = f"{has(x.strict)} OR ({compares} AND regexp_matches(regexp_replace(content, {quoted(weakening.with_nothing(x.nothing))}, '\\1 \\2', 'g'), {quoted(weakening.EQUALITY)}))"
        return ", ".join((has(x.assertion), has(x.case), has(x.skip), has(x.focus), strict, f"{has(x.loose)} OR ({compares} AND {has(weakening.ORDERING)})"))

    own = " UNION ALL ".join(f"SELECT *, {flags(x)} FROM lines WHERE regexp_extract(path, '[^.]*$') IN ({', '.join(map(quoted, x.endings))}) AND NOT starts_with(path, 'src/')" for x in weakening.LANGUAGES)
    return f"{EDITED}, m(path, hunk, pos, kind, own, content, a, c, s, o, x, y) AS ({own}), f AS (SELECT *, trim(content, chr(9) || ' ') AS t, kind = 'add' AS added FROM m WHERE kind <> 'context')"


@query("sca13_strictness", f"WITH {marks_sql()} SELECT DISTINCT regexp_extract(path, '[^.]*$') AS ending, content, CASE WHEN x AND y THEN 'both' WHEN x THEN 'strict' WHEN y THEN 'loose' ELSE 'none' END AS strictness FROM m")
def _(lineitem):
    rows = edits(lineitem).where(p.is_test(F.col("path"))).select(p.extension(F.col("path")).alias("ending"), "content", weakening.strictness(F.col("path"), F.col("content")).alias("strictness"))
    return rows.where("strictness IS NOT NULL").distinct()


@query("sca14_comparison_flags", "SELECT DISTINCT content, regexp_matches(b, '[!=]=') AS equality, regexp_matches(b, '[<>]') AS ordering FROM (SELECT content, regexp_replace(regexp_replace(content, '<<|>>|->|=>|<-', ' ', 'g'), '[!=]=\\s*(nil|null|None)\\b', ' ', 'g') AS b FROM diff_lines)")
def _(diff_lines):
    return diff_lines.select("content", rules.comparisons(F.col("content")).alias("c")).select("content", "c.*").distinct()


BR = "regexp_matches(content, '(^|[^a-z])(if|for|case|switch|while) ')"


@query("agg19_branch_growth", f"SELECT path, count(*) FILTER (kind = 'add') AS added, count(*) FILTER (kind = 'delete') AS removed FROM diff_lines WHERE {BR} GROUP BY path HAVING count(*) FILTER (kind = 'add') - count(*) FILTER (kind = 'delete') >= 2")
def _(diff_lines):
    return rules.growth(diff_lines, least=2)


UNMOVED = "WITH t AS (SELECT path, kind, line, trim(content) AS content, row_number() OVER (PARTITION BY path, kind, trim(content) ORDER BY line) - 1 AS n FROM diff_lines), u AS (SELECT * FROM t g WHERE kind = 'delete' AND NOT EXISTS (FROM t b WHERE b.kind = 'add' AND b.path = g.path AND b.content = g.content AND b.n = g.n)), v AS (SELECT * FROM t g WHERE kind = 'add' AND NOT EXISTS (FROM t b WHERE b.kind = 'delete' AND b.path = g.path AND b.content = g.content AND b.n = g.n))"


@query("win13_moved_lines", UNMOVED + " SELECT path, content, CAST(line AS BIGINT) AS line FROM u")
def _(diff_lines):
    return rules.unmoved(diff_lines).select("path", "content", "line")


BALANCED = "SELECT path, '{kind}' AS kind, 'medium' AS severity, 'old' AS side, count(*) FILTER (NOT added) AS gone, count(*) FILTER (added) AS new, arg_min(pos, pos) FILTER (NOT added) AS line, arg_min(t, pos) FILTER (NOT added) AS q FROM f WHERE {mark} GROUP BY path HAVING gone > new"
MARKED = "SELECT path, '{kind}' AS kind, '{severity}' AS severity, pos AS line, t, row_number() OVER (PARTITION BY path ORDER BY pos) AS place, count(*) OVER (PARTITION BY path) AS total FROM (SELECT g.*, row_number() OVER (PARTITION BY path, t ORDER BY pos) AS n, (SELECT count(*) FROM f d WHERE d.{mark} AND NOT d.added AND d.path = g.path AND d.t = g.t) AS back FROM f g WHERE g.{mark} AND g.added) WHERE n > back"
WEAK = f"""WITH {marks_sql()}, g AS ({BALANCED.format(kind=weakening.ASSERTION_REMOVED, mark="a")} UNION ALL {BALANCED.format(kind=weakening.CASE_REMOVED, mark="c")}),
k AS ({MARKED.format(kind=weakening.SKIP_ADDED, severity="medium", mark="s")} QUALIFY place <= 10 UNION ALL {MARKED.format(kind=weakening.FOCUS_ADDED, severity="high", mark="o")} QUALIFY place <= 5),
h AS (SELECT path, hunk, count(*) FILTER (x AND NOT added) - count(*) FILTER (x AND added) AS exact, count(*) FILTER (y AND added) - count(*) FILTER (y AND NOT added) AS loose, min(pos) FILTER (y AND added) AS line, arg_min(t, pos) FILTER (y AND added) AS now, arg_min(t, pos) FILTER (x AND NOT added) AS before FROM f GROUP BY path, hunk HAVING exact > 0 AND loose > 0),
r AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY path ORDER BY hunk) <= 10)
SELECT path, kind, severity, side, line, concat(gone, CASE kind WHEN '{weakening.CASE_REMOVED}' THEN ' test cases gone, ' ELSE ' assertions gone, ' END, new, ' new; the first gone is ', q) AS evidence FROM g
UNION ALL SELECT path, kind, severity, 'new', line, concat('new marker ', t, CASE WHEN total > place AND place = CASE severity WHEN 'high' THEN 5 ELSE 10 END THEN concat(', and ', total - place, ' more in this file') ELSE '' END) FROM k
UNION ALL SELECT path, '{weakening.RELAXED}', 'medium', 'new', line, concat('instead of ', before, ' now ', now) FROM r"""


@query("evd14_test_weakening", WEAK)
def _(lineitem):
    return weakening.signals(edits(lineitem))


@query("agg18_assertion_balance", f"WITH {marks_sql()}, g AS ({BALANCED.format(kind=weakening.ASSERTION_REMOVED, mark='a')} UNION ALL {BALANCED.format(kind=weakening.CASE_REMOVED, mark='c')}) SELECT path, kind, gone AS removed, new AS added FROM g")
def _(lineitem):
    return weakening.balance(weakening.marked(edits(lineitem))).select("path", "kind", "removed", "added")


@query("agg20_first_match", f"SELECT path, rule, CAST(min(line) AS BIGINT) AS line, array_to_string(list_sort(list(DISTINCT kind)), '+') AS sides FROM (SELECT path, line, kind, 'branch' AS rule FROM diff_lines WHERE kind <> 'context' AND {BR} UNION ALL SELECT path, line, kind, 'assert' FROM diff_lines WHERE kind <> 'context' AND regexp_matches(content, '(assert|expect)[ (]')) GROUP BY path, rule")
def _(diff_lines):
    return rules.first_match(diff_lines, {"branch": rules.BRANCH, "assert": rules.ASSERTION})


FILES = "files AS (SELECT path, CASE length(path) % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'T' ELSE 'M' END AS status, length(path) * 20 AS additions, length(path) AS deletions FROM paths)"


def files(paths):
    n = F.length("path")
    return paths.select("path", F.when(n % 5 == 0, "D").when(n % 5 == 1, "T").otherwise("M").alias("status"), (n * 20).alias("additions"), n.alias("deletions"))


MAN = ", ".join(f"'{m}'" for m in p.MANIFESTS)


@query("evd15_file_rules", f"WITH {FILES}, r AS (SELECT path, 'dependency_change' AS kind FROM files WHERE lower(regexp_extract(path, '[^/]*$')) IN ({MAN}) OR ends_with(path, '.csproj') UNION ALL SELECT path, 'migration_change' FROM files WHERE contains(lower(path), 'migration') OR ends_with(lower(path), '.sql') UNION ALL SELECT path, 'file_deleted' FROM files WHERE status = 'D' UNION ALL SELECT path, 'file_type_change' FROM files WHERE status = 'T' UNION ALL SELECT path, 'large_change' FROM files WHERE additions + deletions > 400) SELECT * FROM r")
def _(paths):
    return rules.file_signals(files(paths))


TEST = "(regexp_matches(regexp_extract(lower(path), '[^/]*$'), '(_test\\.go|_test\\.py|test\\.java)$|\\.(test|spec)\\.|^test_') OR regexp_matches('/' || lower(path), '/(tests|__tests__)/'))"
EXT = "lower(regexp_extract(path, '\\.([^./]*)$', 1))"
SRC = f"{EXT} IN ({', '.join(repr(s) for s in p.SOURCE)})"
STEM = "regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')"


NEAR = "FROM paths WHERE path NOT LIKE '%\\_test.go' ESCAPE '\\' OR path LIKE 'docs/%'"


@query("joi14_nearby_test", f"WITH {FILES.replace('FROM paths', NEAR)}, t AS (SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder, regexp_replace(regexp_replace({STEM}, '(_test|\\.test|\\.spec)$', ''), '^test_', '') AS stem FROM files WHERE {TEST}) SELECT path FROM files WHERE {SRC} AND NOT {TEST} AND status <> 'D' AND CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END NOT IN (SELECT folder FROM t) AND {STEM} NOT IN (SELECT stem FROM t)")
def _(paths):
    return rules.without_test_change(files(paths.where(~F.col("path").endswith("_test.go") | F.col("path").startswith("docs/"))))


@query("flt3_path_classes", f"SELECT path, {SRC} AS source, lower(regexp_extract(path, '[^/]*$')) IN ({MAN}) OR ends_with(path, '.csproj') AS manifest, {TEST} AS test FROM paths")
def _(paths):
    c = F.col("path")
    return paths.select("path", p.is_source(c).alias("source"), p.is_manifest(c).alias("manifest"), p.is_test(c).alias("test"))


@query("flt4_low_noise", f"SELECT path, {EXT} IN ('md', 'rst', 'txt', 'adoc', 'html') OR regexp_matches(regexp_extract(lower(path), '[^/]*$'), '^(license|notice|authors|codeowners)') OR {TEST} OR regexp_matches('/' || lower(path), '/(testdata|fixtures)/') AS low_noise FROM paths")
def _(paths):
    return paths.select("path", p.is_low_noise(F.col("path")).alias("low_noise"))


#: Patterns of the globs of the carriers, written out for the oracle.
GLOBS = {"**/auth/**": "^(.*/)?auth/.*$", "*.md": "^[^/]*\\.md$", "**/payment/*.go": "^(.*/)?payment/[^/]*\\.go$", "**/go.mod": "^(.*/)?go\\.mod$", "src/**/f?.go": "^src/(.*/)?f[^/]\\.go$"}
FIRST = "CASE " + " ".join(f"WHEN regexp_matches(path, '{r}') THEN '{g}'" for g, r in GLOBS.items()) + " END"


@query("flt1_glob_match", "SELECT path, \"glob\" FROM paths, (VALUES " + ", ".join(f"('{g}', '{r}')" for g, r in GLOBS.items()) + ") g(\"glob\", re) WHERE regexp_matches(path, re)")
def _(paths, globs):
    return p.matching(paths, globs)


@query("flt2_sensitive_path", f"SELECT path, {FIRST} AS glob FROM paths")
def _(paths):
    return paths.select("path", p.first_glob(F.col("path"), list(GLOBS)).alias("glob"))


@query("joi41_prepare_inputs", "SELECT DISTINCT path FROM paths WHERE regexp_matches(path, '^(.*/)?go\\.mod$') OR regexp_matches(path, '^(.*/)?package\\.json$')")
def _(paths):
    return plan.changed_inputs(paths, ["**/go.mod", "**/package.json"])


@query("evd17_manifest_signals", "SELECT path, 'prepare_input_changed' AS kind FROM paths WHERE regexp_matches(path, '^(.*/)?go\\.mod$')")
def _(paths):
    return plan.changed_inputs(paths, ["**/go.mod"]).withColumn("kind", F.lit("prepare_input_changed"))


KN = "WITH k(title, ord, size, re) AS (VALUES ('auth', 1, 40, '^(.*/)?auth/.*$'), ('docs', 2, 30, '^docs/.*$'), ('pay', 3, 50, '^(.*/)?payment/.*$'), ('none', 4, 5, '^nowhere/.*$'), ('deep', 5, 20, '^pkg/(.*/)?er/[^/]*$'), ('mods', 6, 8, '^(.*/)?go\\.mod$')), r AS (SELECT title, ord, size FROM k WHERE EXISTS (FROM paths WHERE regexp_matches(path, re)))"


@query("joi31_knowledge_globs", KN + " SELECT title, CAST(ord AS BIGINT) AS ord, CAST(size AS BIGINT) AS size FROM r")
def _(knowledge, paths):
    return plan.relevant(knowledge, paths)


@query("win12_budgeted_pick", KN.replace("WITH k", "WITH RECURSIVE k") + ", o AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM r), w AS (SELECT 0 AS n, '' AS title, 0 AS used, false AS taken UNION ALL SELECT o.n, o.title, CASE WHEN used + size <= 100 THEN used + size ELSE used END, used + size <= 100 FROM w JOIN o ON o.n = w.n + 1) SELECT title FROM w WHERE taken")
def _(knowledge, paths):
    return plan.within_budget(plan.relevant(knowledge, paths), 100)


DRIFT = "WITH planned AS (SELECT path FROM paths WHERE length(path) % 3 = 0 UNION SELECT path || '.new' FROM paths WHERE length(path) % 7 = 0), changed AS (SELECT path FROM paths WHERE length(path) % 2 = 0)"


@query("joi15_plan_drift", DRIFT + f", d AS (SELECT path, CASE WHEN {TEST} THEN 'unplanned_test' ELSE 'unplanned_file' END AS kind FROM changed WHERE path NOT IN (SELECT path FROM planned) UNION ALL SELECT path, 'untouched' FROM planned WHERE path NOT IN (SELECT path FROM changed) UNION ALL SELECT path, 'unannounced_critical' FROM changed WHERE {FIRST} IS NOT NULL AND path NOT IN (SELECT path FROM planned) UNION ALL SELECT path, 'unannounced_manifest' FROM changed WHERE lower(regexp_extract(path, '[^/]*$')) IN ({MAN}) AND path NOT IN (SELECT path FROM planned)) SELECT path, kind, CASE kind WHEN 'unannounced_critical' THEN 'high' WHEN 'unplanned_test' THEN 'low' WHEN 'untouched' THEN 'low' ELSE 'medium' END AS severity FROM d")
def _(paths):
    return plan.drift(*planned(paths), list(GLOBS))


def planned(paths):
    n = F.length("path")
    return paths.where(n % 3 == 0).union(paths.where(n % 7 == 0).select(F.concat("path", F.lit(".new")))).distinct(), paths.where(n % 2 == 0)


@query("agg23_drift_status", DRIFT + f", d AS (SELECT CASE WHEN {TEST} THEN 'low' ELSE 'medium' END AS s FROM changed WHERE path NOT IN (SELECT path FROM planned) UNION ALL SELECT 'low' FROM planned WHERE path NOT IN (SELECT path FROM changed) UNION ALL SELECT 'high' FROM changed WHERE {FIRST} IS NOT NULL AND path NOT IN (SELECT path FROM planned) UNION ALL SELECT 'medium' FROM changed WHERE lower(regexp_extract(path, '[^/]*$')) IN ({MAN}) AND path NOT IN (SELECT path FROM planned)) SELECT count(*) AS items, coalesce(bool_or(s <> 'low'), false) AS drifted FROM d")
def _(paths):
    return plan.drift_status(plan.drift(*planned(paths), list(GLOBS)))


@query("joi16_plan_evaluation", "SELECT s.path, count(*) AS signals, count(DISTINCT c.id) AS claims, bool_or(s.severity IN ('high', 'critical')) AS risky FROM signals s LEFT JOIN (SELECT path, line, min(id) AS id FROM claims GROUP BY path, line) c ON c.path = s.path AND c.line = s.line GROUP BY s.path")
def _(signals, claims):
    return plan.evaluate(signals, claims)


@query("agg22_plan_categories", "SELECT CASE kind WHEN 'secret' THEN 'security' WHEN 'dependency' THEN 'dependencies' WHEN 'coverage' THEN 'tests' WHEN 'test_removed' THEN 'tests' ELSE 'structure' END AS category, count(*) AS n, bool_or(severity IN ('medium', 'high', 'critical')) AS flagged FROM signals GROUP BY 1")
def _(signals):
    return plan.categories(signals)


@query("flt17_live_paths", f"WITH {FILES} SELECT DISTINCT path FROM files WHERE status <> 'D'")
def _(paths):
    return rules.live_paths(files(paths))


@query("flt15_row_budget", "WITH RECURSIVE h AS (SELECT path, (line - 1) // 2 AS hunk, count(*) AS n FROM diff_lines GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY hunk) AS k FROM h), w AS (SELECT path, 0 AS k, 0 AS used, false AS kept, -1 AS hunk, false AS stopped FROM (SELECT DISTINCT path FROM h) UNION ALL SELECT o.path, o.k, CASE WHEN stopped OR used + n > 3 THEN used ELSE used + n END, NOT (stopped OR used + n > 3), o.hunk, stopped OR used + n > 3 FROM w JOIN o ON o.path = w.path AND o.k = w.k + 1) SELECT path, CAST(hunk AS BIGINT) AS hunk FROM w WHERE kept")
def _(diff_lines):
    return plan.within_rows(diff_lines.withColumn("hunk", F.floor((F.col("line") - 1) / 2)), 3)


LOG = "WITH t AS (SELECT log_id, test, count(*) FILTER (action = 'run') AS runs, count(*) FILTER (action IN ('pass', 'fail', 'skip')) AS ends, min(pos) FILTER (action = 'run') AS first_run, min(pos) FILTER (action IN ('pass', 'fail', 'skip')) AS first_end, arg_max(action, pos) FILTER (action IN ('pass', 'fail', 'skip')) AS last, count(DISTINCT package) AS packages FROM test_log GROUP BY log_id, test)"


@query("src13_event_log_scan", LOG + " SELECT log_id, count(*) AS tests, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(ends) AS BIGINT) AS ends, bool_or(packages > 1) AS conflict FROM t GROUP BY log_id")
def _(test_log):
    return mutation.logs(test_log)


@query("src14_event_accumulate", LOG + " SELECT log_id, test, runs, ends, last, coalesce(first_run < first_end, false) AS ordered FROM t")
def _(test_log):
    return mutation.tests(test_log).select("log_id", "test", "runs", "ends", "last", F.coalesce(F.col("first_run") < F.col("first_end"), F.lit(False)).alias("ordered"))


@query("src15_named_outcome", LOG + " SELECT log_id, test, last AS action FROM t WHERE runs = 1 AND ends = 1 AND first_run < first_end AND packages = 1")
def _(test_log):
    return mutation.named_outcomes(test_log)


@query("evd2_control_validity", "SELECT id, CASE WHEN status <> 'PASS' THEN 'not_passed' WHEN exit_code <> 0 THEN 'exit_code' WHEN truncated THEN 'truncated' WHEN NOT readable THEN 'unreadable' WHEN load_failures > 0 THEN 'load_failure' WHEN passed < 1 THEN 'no_pass' WHEN failed > 0 THEN 'failed' WHEN packages > 1 THEN 'packages' ELSE '' END AS problem FROM mutant_runs")
def _(mutant_runs):
    return mutation.control(mutant_runs)


MUT = "WITH v AS (SELECT id, status AS run, CASE WHEN kind <> 'mutant' OR command <> 'cmd0' THEN 'INCONCLUSIVE' WHEN status = 'SKIPPED' THEN 'NOT_RUN' WHEN status = 'TIMEOUT' THEN 'TIMEOUT' WHEN status = 'ERROR' OR truncated OR NOT readable THEN 'INCONCLUSIVE' WHEN load_failures > 0{script} THEN 'INVALID' WHEN {packages} THEN 'INCONCLUSIVE' WHEN status = 'FAIL' AND exit_code BETWEEN 1 AND 124 AND failed > 0 THEN 'KILLED' WHEN status = 'PASS' AND exit_code = 0 AND failed = 0 AND passed > 0 THEN 'SURVIVED' ELSE 'INCONCLUSIVE' END AS status FROM mutant_runs)"
LINES_LOG, SCRIPT = MUT.format(script="", packages="packages > 1"), MUT.format(script=" AND failed = 0", packages="false")


@query("evd1_mutant_classify", LINES_LOG + " SELECT * FROM v")
def _(mutant_runs):
    return mutation.classify(mutant_runs, "cmd0")


@query("evd3_script_classify", SCRIPT + " SELECT * FROM v")
def _(mutant_runs):
    return mutation.classify(mutant_runs, "cmd0", script=True)


@query("agg9_mutant_recount", LINES_LOG + " SELECT run, count(*) FILTER (status = 'KILLED') AS killed, count(*) FILTER (status = 'SURVIVED') AS survived, count(*) FILTER (status = 'INVALID') AS invalid, count(*) FILTER (status = 'TIMEOUT') AS timeout, count(*) FILTER (status = 'INCONCLUSIVE') AS inconclusive, count(*) FILTER (status = 'NOT_RUN') AS not_run FROM v GROUP BY run")
def _(mutant_runs):
    return mutation.recount(mutation.classify(mutant_runs, "cmd0"))


@query("evd4_mutation_verify", LINES_LOG + ", s AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'KILLED' ELSE status END AS stored, status FROM v) SELECT id, CASE WHEN stored IN ('KILLED', 'SURVIVED') AND stored <> status THEN 'INCONCLUSIVE' ELSE stored END AS status FROM s")
def _(mutant_runs):
    v = mutation.classify(mutant_runs, "cmd0").withColumn("stored", F.when(F.col("id") % 6 == 0, "KILLED").otherwise(F.col("status")))
    return mutation.verified(v)


@query("joi35_base_candidate_verdict", LOG + ", n AS (SELECT log_id, test, last, packages FROM t WHERE runs >= 1) SELECT a.log_id, a.test, CASE WHEN b.last IS NULL OR b.last <> 'pass' OR a.packages > 1 OR b.packages > 1 THEN 'UNVERIFIED' WHEN a.last = 'fail' THEN 'FAILS' WHEN a.last = 'pass' THEN 'PASSES' ELSE 'UNVERIFIED' END AS verdict FROM n a LEFT JOIN n b ON b.test = a.test AND b.log_id = 'log0'")
def _(test_log):
    return mutation.verdicts(test_log, "log0")


EVIDENCE = "WITH o AS (SELECT id, any_value(kind) AS kind, any_value(replayed) AS replayed, any_value(agreeing) AS agreeing FROM test_checks GROUP BY id HAVING count(*) = 1) SELECT e.id, CASE WHEN names = 1 AND b.kind = 'base' AND c.kind = 'candidate' AND NOT c.replayed AND verdict = 'FAILS' AND NOT b.replayed THEN 'FAILS' WHEN names = 1 AND b.kind = 'base' AND c.kind = 'candidate' AND NOT c.replayed AND verdict = 'PASSES' AND (NOT b.replayed{replays}) THEN 'PASSES' ELSE '' END AS status FROM test_evidence e LEFT JOIN o b ON b.id = base_check LEFT JOIN o c ON c.id = candidate_check"


@query("evd6_base_test_verify", EVIDENCE.format(replays=""))
def _(test_evidence, test_checks):
    return mutation.evidence_status(test_evidence, test_checks, replays=False)


@query("evd7_impacted_verify", EVIDENCE.format(replays=" OR b.agreeing >= 2"))
def _(test_evidence, test_checks):
    return mutation.evidence_status(test_evidence, test_checks, replays=True)


@query("evd5_fuzz_verify", "WITH c AS (SELECT evidence_id, count(DISTINCT claim_id) AS n FROM citations GROUP BY 1), k AS (SELECT evidence_id, count(*) AS n, bool_and(status IN ('PASS', 'FAIL')) AS ok FROM checks GROUP BY 1) SELECT e.id, CASE WHEN c.n = 1 AND e.n = 1 AND e.kind = 'fuzz' AND coalesce(ok, true) AND coalesce(k.n, 0) <= 2 THEN e.verified ELSE 'UNVERIFIED' END AS status FROM (SELECT id, count(*) AS n, arg_min(kind, ord) AS kind, arg_min(verified, ord) AS verified FROM evidence GROUP BY id) e LEFT JOIN c ON c.evidence_id = e.id LEFT JOIN k ON k.evidence_id = e.id")
def _(evidence, citations, checks):
    return mutation.fuzz_status(evidence, citations, checks)


SUITE = "WITH b AS (SELECT p_partkey % 40 AS file, p_partkey // 2 AS name, min(p_size) AS digest, count(*) AS n FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL), h AS (SELECT p_partkey % 40 AS file, p_partkey // 2 AS name, min(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END) AS digest, count(*) AS n FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 40 > 3 GROUP BY ALL), p AS (SELECT b.file, b.name, CASE WHEN b.file NOT IN (SELECT file FROM h) THEN 'file_deleted' WHEN h.name IS NULL THEN 'removed' WHEN b.digest <> h.digest THEN 'modified' ELSE 'shared_code_changed' END AS reason FROM b LEFT JOIN h ON h.file = b.file AND h.name = b.name WHERE b.n = 1 AND coalesce(h.n, 1) = 1)"


@query("evd18_suite_plan", SUITE + " SELECT * FROM p WHERE file IN (SELECT DISTINCT file FROM p ORDER BY file LIMIT 20) ORDER BY file, name LIMIT 100")
def _(part):
    side = lambda ok, digest: part.where(ok).select((F.col("p_partkey") % 40).alias("file"), F.floor(F.col("p_partkey") / 2).alias("name"), digest.alias("digest"))
    return plan.suite_plan(side("p_partkey % 3 <> 0", F.col("p_size")), side("p_partkey % 4 <> 0 AND p_partkey % 40 > 3", F.when(F.col("p_partkey") % 5 == 0, 0).otherwise(F.col("p_size"))), 20, 100)


SITES = "WITH s AS (SELECT DISTINCT l_orderkey // 40 AS file, l_linenumber AS line, l_suppkey % 6 AS op FROM lineitem), d AS (SELECT *, dense_rank() OVER (PARTITION BY file ORDER BY line) AS li, row_number() OVER (PARTITION BY file, line ORDER BY op) AS depth FROM s)"


@query("win5_round_robin", SITES + " SELECT file, CAST(line AS BIGINT) AS line, op FROM d ORDER BY depth, li, file LIMIT 100")
def _(lineitem):
    return mutation.round_robin(sites(lineitem), 100)


def sites(lineitem):
    return lineitem.select(F.floor(F.col("l_orderkey") / 40).alias("file"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 6).alias("op")).distinct()


@query("win6_execution_order", SITES + " SELECT file, CAST(line AS BIGINT) AS line, op FROM s ORDER BY file, line, op LIMIT 200")
def _(lineitem):
    return mutation.execution_order(sites(lineitem), ["file", "line", "op"], 200)


M64 = "18446744073709551616"
MIX = "CAST((CAST(xor({z}, {z} >> {s}) AS UHUGEINT) * {c}) % " + M64 + " AS UBIGINT)"
SIZED_SQL = ", ".join(f"'{t}': [{', '.join(map(quoted, mutation.edges(t)))}]" for t in ("uint8", "int16", "float64", "float32"))
#: The generator's numbers, 8 n of them a parameter, and calls by place: combinations first, then random rows.
CORPUS = f"""WITH t AS (SELECT concat('fn', p_partkey) AS target, CASE p_partkey % 5 WHEN 0 THEN ['int'] WHEN 1 THEN ['int', 'bool'] WHEN 2 THEN ['uint8', 'float64'] WHEN 3 THEN ['float32', 'int16'] ELSE ['string', 'int'] END AS types FROM part),
e AS (SELECT MAP {{{{'int': ['0', '1', '-1', '2147483647', '-2147483648'], 'bool': ['false', 'true'], 'string': ['""', '"a"', '" "', '"0"', '"\\n"'], {SIZED_SQL}}}}} AS e),
c AS (SELECT target, CAST(a.i * 100 + coalesce(b.i, 0) AS BIGINT) AS o, concat_ws(', ', e[types[1]][a.i + 1], CASE WHEN len(types) > 1 THEN e[types[2]][b.i + 1] END) AS args FROM t, e, range(8) a(i), range(8) b(i) WHERE a.i < len(e[types[1]]) AND CASE WHEN len(types) > 1 THEN b.i < len(e[types[2]]) ELSE b.i = 0 END),
s AS (SELECT target, types, CAST(concat('0x', left(sha256(target), 16)) AS UBIGINT) AS seed, unnest(range(128 * len(types))) AS k FROM t),
z0 AS (SELECT *, CAST((CAST(seed AS UHUGEINT) + CAST(k + 1 AS UHUGEINT) * CAST(11400714819323198485 AS UHUGEINT)) % {M64} AS UBIGINT) AS z FROM s),
z1 AS (SELECT * REPLACE ({MIX.format(z="z", s=30, c="CAST(13787848793156543929 AS UHUGEINT)")} AS z) FROM z0), z2 AS (SELECT * REPLACE ({MIX.format(z="z", s=27, c="CAST(10723151780598845931 AS UHUGEINT)")} AS z) FROM z1), z3 AS (SELECT * REPLACE (xor(z, z >> 31) AS z) FROM z2),
r AS (SELECT target, 1000 + k // len(types) AS o, string_agg(CASE types[k % len(types) + 1] WHEN 'int' THEN CAST(CAST(z % 2001 AS BIGINT) - 1000 AS VARCHAR) WHEN 'bool' THEN CASE WHEN z % 2 = 1 THEN 'true' ELSE 'false' END WHEN 'uint8' THEN CAST(z >> 56 AS VARCHAR) WHEN 'int16' THEN CAST(CAST(z >> 48 AS BIGINT) - CASE WHEN z >> 63 = 1 THEN 65536 ELSE 0 END AS VARCHAR) WHEN 'float64' THEN concat('float64frombits(0x', lpad(lower(to_hex(z)), 16, '0'), ')') WHEN 'float32' THEN concat('float32frombits(0x', left(lpad(lower(to_hex(z)), 16, '0'), 8), ')') ELSE concat('"', left(lpad(lower(to_hex(z)), 16, '0'), 8), '"') END, ', ' ORDER BY k) AS args FROM z3 GROUP BY target, types, k // len(types)),
u AS (SELECT target, args, min(o) AS o FROM (FROM c UNION ALL FROM r) GROUP BY target, args), n AS (SELECT target, row_number() OVER (PARTITION BY target ORDER BY o) - 1 AS i, concat(target, '(', args, ')') AS call FROM u)
SELECT target, i, call FROM n WHERE i < 16"""


@query("evd12_seeded_corpus", CORPUS.replace("{{", "{").replace("}}", "}"), python=True)
def _(part):
    k = F.col("p_partkey")
    of = lambda *t: F.array(*map(F.lit, t))
    types = F.when(k % 5 == 0, of("int")).when(k % 5 == 1, of("int", "bool")).when(k % 5 == 2, of("uint8", "float64")).when(k % 5 == 3, of("float32", "int16")).otherwise(of("string", "int"))
    return mutation.corpus(part.select(F.concat(F.lit("fn"), k.cast("string")).alias("target"), types.alias("types")), 16)
