"""Sources beyond what the queries render: broken packages, loose JSON, lexers, tools."""

import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veridelta.functions import text
from veridelta.functions.repair import repair_json
from veridelta.operators import tools
from veridelta.plans import extensions, samples
from veridelta.session import ship
from veridelta import registry
from veridelta.sources import apis, git, lexer, lines, packages, paged, patches


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_broken_packages_are_one_row_with_their_error(spark):
    ship(spark)
    bomb = packages.zipped({"xl/workbook.xml": "<!DOCTYPE x [<!ENTITY a 'b'>]><workbook/>"})
    files = make(spark, [("bad", bytearray(b"nothing")), ("bomb", bytearray(bomb)), ("empty", bytearray(packages.zipped({})))], "path string, content binary")
    got = {(r.path, r.error) for r in packages.read(files, packages.cells, packages.CELLS).collect()}
    assert got == {("bad", "BadZipFile"), ("bomb", "ValueError")}


def test_shared_strings_and_formulas():
    p = packages.Package(
        packages.zipped(
            {
                "xl/workbook.xml": '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" r:id="x"/></sheets></workbook>',
                "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="x" Target="s.xml"/></Relationships>',
                "xl/sharedStrings.xml": "<sst><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>",
                "xl/s.xml": '<worksheet><c r="A1" t="s"><v>1</v></c><c r="A2"><f t="shared" si="0">B1+1</f><v>2</v></c><c r="A3"><f t="shared" si="0"/><v>#REF!</v></c><c r="A4"/></worksheet>',
            }
        )
    )
    assert list(packages.cells(p)) == [("A", "A1", "two", "", True, False), ("A", "A2", "2", "B1+1", False, False), ("A", "A3", "#REF!", "B2+1", False, False)]


@pytest.mark.parametrize(
    ("text", "want"),
    [("{'a': 1,}", {"a": 1}), ('{"a": [1, 2', {"a": [1, 2]}), ('```json\n{"a": "x"}\n```', {"a": "x"}), ('{"a": "say \\"hi\\""}', {"a": 'say "hi"'}), ('{"a": "two\nlines"}', {"a": "two\nlines"}), ('{"a":', {"a": None}), ("nonsense", None), ("", None)],
)
def test_json_repair(text, want):
    got = repair_json(text)
    assert (json.loads(got) if got is not None else None) == want


def test_tokens_skip_comments_and_keep_strings():
    got = [(k, t) for k, t, _ in lexer.tokens('x = "a // b" // c\n/* d */ y(1.5)', "ts")]
    assert got == [("word", "x"), ("mark", "="), ("string", '"a // b"'), ("word", "y"), ("mark", "("), ("number", "1.5"), ("mark", ")")]
    assert list(lexer.declarations("def f():\n  # g()\n  h()", "py")) == [("function", "f", 1), ("calls", "h", 3)]


def test_tools_refuse_what_they_do_not_know(spark):
    with pytest.raises(KeyError):
        tools.call("drop_tables", {})
    with pytest.raises(ValueError, match="takes"):
        tools.call("get_findings", {}, maximum="low")
    assert tools.expand_command(["a", "{package}/x"], "p q") == ["a", "p q/x"]


def test_listing_stops_at_a_short_page(spark):
    page = lambda *names: json.dumps([{"name": n, "archived": n.startswith("old")} for n in names])
    rows = [("s", 0, page("a", "old b")), ("s", 1, page("c")), ("s", 2, page("d", "e"))]
    assert [r.name for r in paged.listing(make(spark, rows, "source string, page int, body string"), size=2).orderBy("place").collect()] == ["a", "c"]


def test_listings_are_read_page_by_page_up_to_a_maximum(spark):
    pages = {None: ([("a",), ("b",)], "2"), "2": ([("c",), ("d",)], "3"), "3": ([], None)}
    for most, want in ((10, ["a", "b", "c", "d"]), (3, ["a", "b", "c"])):
        apis.register_listing(spark, f"things{most}", "name string", lambda s, c: pages[c], lambda s: f"{s}!", most)
        got = spark.read.format(f"things{most}").option("sources", "x,y").load().orderBy("source", "name").collect()
        assert [tuple(r) for r in got] == [(s, f"{s}!", n) for s in "xy" for n in want]
    assert spark.read.format("things10").load().count() == 0


def test_patches_of_several_files(spark):
    patch = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n a\n+b\n c\n@@ -9 +10 @@ f\n-d\n+e\n\\ No newline\ndiff --git a/y b/y\n--- a/y\n+++ b/y\n@@ -0,0 +1 @@\n+z"
    got = [(r.path, r.hunk, r.kind, r.old_line, r.new_line, r.content) for r in patches.unified_patch(make(spark, [("1", patch)], "id string, text string")).orderBy("file", "hunk", "pos").collect()]
    assert got == [("x", 1, "context", 1, 1, "a"), ("x", 1, "add", None, 2, "b"), ("x", 1, "context", 2, 3, "c"), ("x", 2, "delete", 9, None, "d"), ("x", 2, "add", None, 10, "e"), ("y", 1, "add", None, 1, "z")]


def test_lines_that_look_like_headers_stay_lines(spark):
    text = "diff --git a/q.sql b/q.sql\ndeleted file mode 100644\n--- a/q.sql\n+++ /dev/null\n@@ -1,3 +0,0 @@\n--- old comment\n-select 1\n-++ x\n"
    plain = "--- a/m\t2024-01-01\n+++ b/m\n@@ -1,2 +1,2 @@\n-- x\n+++ y\n\n--- a/n\n+++ b/n\n@@ -1 +1 @@\n-a\n+b\n-- \n2.39.0"
    rows = patches.unified_patch(make(spark, [("1", text), ("2", plain), ("3", None), ("4", "")], "id string, text string")).orderBy("id", "hunk", "pos").collect()
    assert [(r.id, r.path, r.old_line, r.new_line, r.content) for r in rows] == [
        ("1", "q.sql", 1, None, "-- old comment"), ("1", "q.sql", 2, None, "select 1"), ("1", "q.sql", 3, None, "++ x"),
        ("2", "m", 1, None, "- x"), ("2", "m", None, 1, "++ y"), ("2", "m", 2, 2, ""), ("2", "n", 1, None, "a"), ("2", "n", None, 1, "b"),
    ]


def test_a_line_that_is_none_of_a_patch_fails_the_read(spark):
    with pytest.raises(Exception, match="not a line of a patch"):
        patches.unified_patch(make(spark, [("1", "diff --git a/x b/x\n@@ -1,2 +1,2 @@\n a\nx")], "id string, text string")).collect()


def test_files_of_a_patch(spark):
    def head(path, *more, to=None):
        return [f"diff --git a/{path} b/{to or path}", *more]

    def hunk(*lines):
        cut = [len([x for x in lines if x[0] in side]) for side in ("- ", "+ ")]
        return [f"@@ -{int(cut[0] > 0)},{cut[0]} +{int(cut[1] > 0)},{cut[1]} @@", *lines]

    text = "\n".join([
        *head("doc/two words.txt", "index 12ab..34cd 100755", "--- a/doc/two words.txt", "+++ b/doc/two words.txt"), *hunk(" same", "-one", "-two", "+three", "\\ No newline at end of file"), *hunk("+four"),
        *head("run.sh", "old mode 100755", "new mode 100644"), *head("was/here.c", "similarity index 91%", "rename from was/here.c", "rename to now/there.c", to="now/there.c"), *head("pic.gif", "deleted file mode 100644", "Binary files a/pic.gif and /dev/null differ"),
        *head("ln", "deleted file mode 120000", "--- a/ln", "+++ /dev/null"), *hunk("-to/it"), *head("ln", "new file mode 100644", "--- /dev/null", "+++ b/ln"), *hunk("+kept", "+here"),
    ]) + "\n"
    got = patches.patch_files(make(spark, [("1", text)], "id string, text string"), most=3).orderBy("file").collect()
    assert [(r.file, r.path, r.old_path, r.status, r.binary, r.hunks, r.additions, r.deletions, r.over_limit) for r in got] == [
        (1, "doc/two words.txt", "", "M", False, 2, 2, 2, True), (2, "run.sh", "", "M", False, 0, 0, 0, True), (3, "now/there.c", "was/here.c", "R", False, 0, 0, 0, True), (4, "pic.gif", "", "D", True, 0, 0, 0, True), (5, "ln", "", "T", False, 2, 2, 1, True),
    ]


def test_renames_pair_files_that_share_half(spark):
    files = lambda *rows: make(spark, list(rows), "path string, content string")
    text = "\n".join(f"line {n}" for n in range(20))
    gone = files(("a", text), ("b", "other\nthing"), ("c", None))
    new = files(("x", text.replace("line 3", "line three")), ("y", text), ("z", "nothing\nalike"))
    assert [(r.old_path, r.path, r.similarity > 0.99) for r in git.renames(gone, new).collect()] == [("a", "y", True)]


def brute_renames(gone, new, least=0.5):
    """Greedy pairs of small lists of files: equal contents in order of paths, then best contents first."""
    out, gone, new = {}, dict(gone), dict(new)
    for content in set(gone.values()):
        for a, b in zip(sorted(p for p in gone if gone[p] == content), sorted(p for p in new if new[p] == content), strict=False):
            out[a] = (b, 1.0)
    olds, news = ({c: sorted(p for p in side if side[p] == c and p not in gone_) for c in side.values()} for side, gone_ in ((gone, set(out)), (new, {b for b, _ in out.values()})))

    def score(a, b):
        bag = lambda t: Counter(t.split("\n"))
        return sum(n * (len(x.encode()) + 1) for x, n in (bag(a) & bag(b)).items()) / (max(len(a.encode()), len(b.encode())) + 1)

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    scores = sorted((-score(a, b), sha(sha(a) + sha(b)), a, b) for a in olds for b in news if olds[a] and news[b] and score(a, b) >= least)
    for s, _, a, b in scores:
        while olds[a] and news[b]:
            out[olds[a].pop(0)] = (news[b].pop(0), -s)
    return {(a, b, round(s, 9)) for a, (b, s) in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_renames_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    words = ["}", "}", "return x", "", *(f"line {n}" for n in range(12))]
    text = lambda: "\n".join(rnd.choice(words) for _ in range(rnd.randrange(1, 9)))
    texts = [text() for _ in range(12)]
    gone, new = ([(f"{side}{n:02}", rnd.choice([rnd.choice(texts), text()])) for n in range(25)] for side in "ab")
    df = lambda rows: make(spark, rows, "path string, content string")
    assert {(r.old_path, r.path, round(r.similarity, 9)) for r in git.renames(df(gone), df(new)).collect()} == brute_renames(gone, new)


@pytest.mark.parametrize("n", [51, 5000])
def test_any_number_of_equal_files_is_paired(spark, n):
    side = lambda c: spark.range(n).select(F.format_string(f"{c}/%05d", "id").alias("path"), F.lit("same\ntext").alias("content"))
    got = git.renames(side("a"), side("b")).select("old_path", "path", "similarity")
    assert got.where("substr(old_path, 3) = substr(path, 3) AND similarity = 1").count() == n == got.count()


def test_half_the_bytes_are_enough_however_frequent_the_lines(spark):
    """All files share a line that is half of each; nothing else is shared."""
    common = "c" * 19
    side = lambda c: [(f"{c}{n}", common + "\n" + f"{c}{n:03}" + "u" * 15) for n in range(40)]
    got = git.renames(make(spark, side("a"), "path string, content string"), make(spark, side("b"), "path string, content string")).collect()
    assert len(got) == 40
    assert {r.similarity for r in got} == {0.5}


def test_changes_since_the_merge_base(spark):
    commits = make(spark, [("a", None), ("b", "a"), ("c", "a")], "sha string, parent string")
    body = "\n".join(f"row {n}" for n in range(9))
    rows = [("a", "keep", "k"), ("a", "was", body), ("a", "edit", "1"), ("a", "gone", "zzz"), ("c", "keep", "k"), ("c", "now", body + "\nmore"), ("c", "edit", "2"), ("c", "new", None), ("b", "other", "x")]
    got = git.changes(commits, make(spark, rows, "sha string, path string, content string"), "b", "c").collect()
    assert sorted((r.path, r.old_path, r.status) for r in got) == [("edit", "", "M"), ("gone", "", "D"), ("new", "", "A"), ("now", "was", "R")]


def fuzz(*lines_):
    return "\n".join(map(json.dumps, lines_))


H = "ab" * 32


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (fuzz({"planned": 2, "calls": ["f(1)"]}, {"state": "complete"}), "count its calls"), (fuzz({"i": 0, "call": "f(1)", "sha256": H, "length": 1}), "header out of place"),
        (fuzz({"planned": 1, "calls": ["f(1)"]}, {"i": 1, "call": "f(1)", "sha256": H, "length": 1}, {"state": "interrupted"}), "index out of order"),
        (fuzz({"planned": 1, "calls": ["f(1)"]}, {"i": 0, "call": "f(2)", "sha256": H, "length": 1}, {"state": "interrupted"}), "isn't the planned one"),
        (fuzz({"planned": 1, "calls": ["f(1)"]}, {"i": 0, "call": "f(1)", "sha256": "x", "length": 1}, {"state": "interrupted"}), "no hash"),
        (fuzz({"planned": 1, "calls": ["f(1)"]}, {"state": "complete"}), "complete without all"), (fuzz({"planned": 0, "calls": []}, {"state": "odd"}), "unknown end"),
        (fuzz({"planned": 0, "calls": []}, {"state": "complete"}, {"i": 0}), "out of place"), ("{", "FAILFAST|JSON|MALFORMED"),
    ],
)
def test_inconsistent_streams_fail(spark, text, reason):
    with pytest.raises(Exception, match=reason):
        lines.fuzz_results(make(spark, [("s", text)], "id string, text string")).collect()


def test_another_report_version_fails(spark):
    with pytest.raises(Exception, match="unknown report version"):
        lines.report(make(spark, [("1", '{"schema_version":2}')], "id string, text string")).collect()


#: Texts and what masking leaves of them.
MASKED = {k.replace("@n", n): v.replace("@n", n) for k, v in samples.MASKED.items() for n in ("7", "31")}
MASKED |= {"secret:\n" + samples.drawn(9): "[REDACTED]\n", "://0:" * 12 + "0@" + "@" * 12: "[REDACTED]", "[REDACTED]": "[REDACTED]", "": ""}


def test_masking_settles_and_keeps_lines(spark):
    df = make(spark, [*((k,) for k in MASKED), (None,)], "t string").withColumn("r", text.redact(F.col("t"))).withColumn("again", text.redact(F.col("r")))
    got = df.collect()
    assert {r.t: r.r for r in got} == MASKED | {None: None}
    assert all(r.r == r.again for r in got)


def test_reports_are_masked_before_they_are_cut(spark):
    token = "gho_" + samples.drawn(40)
    case = {"fullName": f"opens {token}", "status": "failed", "failureMessages": ["é" * 2040 + token, None, "password: " + samples.drawn(9)]}
    text = json.dumps({"testResults": [{"name": f"a {token}.ts", "assertionResults": [case]}, {"name": "b", "assertionResults": []}], "other": 1})
    row = lines.jest_report(make(spark, [("1", text)], "id string, text string")).first()
    assert (row.file, row.name) == ("a [REDACTED].ts", "opens [REDACTED]")
    assert row.message == "é" * 2040 + "[REDACTED]\n[REDACTED]"
    short = lines.jest_report(make(spark, [("1", text)], "id string, text string"), message_bytes=4085).first().message
    assert short == "é" * 2040 + "[REDA\n[REDACTED]"


@pytest.mark.parametrize(("text", "reason"), [("{}", "no test results"), (None, "no valid text"), ("[1", "MALFORMED|FAILFAST|JSON"), ('{"testResults": [', "MALFORMED|FAILFAST|JSON")])
def test_unreadable_reports_fail(spark, text, reason):
    with pytest.raises(Exception, match=reason):
        lines.jest_report(make(spark, [("1", text)], "id string, text string")).collect()


def test_search_masks_before_it_shows(spark):
    docs = make(spark, [(1, "find me\npassword=find me"), (2, "findme find_me find me!"), (3, None)], "doc_id int, text string")
    assert [(r.doc_id, r.line, r.text) for r in tools.search_snapshot(docs, "find").collect()] == [(1, 1, "find me"), (2, 1, "findme find_me find me!")]
    assert [r.doc_id for r in tools.search_snapshot(docs, "find", symbol=True).collect()] == [1, 2]
    assert [r.doc_id for r in tools.search_snapshot(docs, "find_me", symbol=True).collect()] == [2]
    assert tools.search_snapshot(docs, "find", most_bytes=10).count() == 1
    with pytest.raises(ValueError, match="256 bytes"):
        tools.search_snapshot(docs, "")


def test_mutation_sites_are_all_on_a_line(spark):
    rows = [
        ("p", 1, "add", 'for w != end && more() { // w > 2'), ("p", 2, "add", "use(kids*rows >= 7)"), ("p", 3, "add", 'return false, errors.New("no row")'), ("p", 4, "delete", "a == b"), ("p", 5, "add", "x == 1 && y == 2 && z == 3"), ("p", 6, "add", 's := "a" + b - -c'), ("p", 7, "add", None),
    ]
    got = [(r.line, r["at"], r.operator, r.found, r.put) for r in tools.mutation_sites(make(spark, rows, "path string, line int, kind string, content string")).orderBy("line", "place").collect()]
    assert [g for g in got if g[0] < 4] == [
        (1, 7, "negate_comparison", "!=", "=="), (1, 14, "swap_logical", "&&", "||"), (2, 15, "boundary", ">=", ">"), (2, 18, "increment_constant", "7", "(7+1)"), (2, 9, "swap_arithmetic", "*", "/"),
        (3, 15, "drop_error", 'errors.New("no row")', "nil"), (3, 8, "flip_boolean", "false", "true"),
    ]
    assert [g[2] for g in got if g[0] == 5] == ["negate_comparison"] * 3 + ["swap_logical"] * 2 + ["increment_constant"] * 3
    assert [g for g in got if g[0] > 5] == []


PARSED = {
    "py": (
        'class A(Base):\n    """doc def no(): pass"""\n    def m(self, x=g(1)):\n        # h()\n        return self.k(f"{x} z()")\n    async def n(self): pass\ndef f(a,\n      b):\n    class In:\n        def q(self): return 1\n    return a.b.c(d)\nx = f(1)\n',
        "class A, method A.m, calls g, calls self.k, method A.n, function f, class In, method In.q, calls a.b.c, calls f",
    ),
    "ts": (
        'export class S extends T {\n  private readonly x = 1;\n  async run(a: string, b = /re"g(x)/): Promise<void> {\n    const s = `t ${this.go(`n ${deep()}`)} not()`;\n    if (a / b > c / d) { stop(); }\n  }\n  get v() { return 1; }\n  abstract q(): void;\n}\n'
        "interface I { m(): void }\ntype U = { a: number };\nconst h = async (x) => k(x);\nconst g = function () { return 1 };\nfunction* gen() { yield z(); }\n",
        "class S, method S.run, calls this.go, calls deep, calls stop, method S.v, method S.q, type I, method I.m, type U, function h, calls k, function g, function gen, calls z",
    ),
    "rs": (
        "struct P<'a> { x: &'a str }\nimpl<'a> P<'a> { fn new(x: &'a str) -> Self { let c = '{'; helper(r#\"f(\"x\")\"#) } }\nimpl fmt::Display for P<'_> { fn fmt(&self) -> R { write!(f, \"{}\", self.x.len()) } }\ntrait Tr { fn t(&self); }\nenum E { A, B }\nfn main() { P::new(\"a\"); /* no() */ }\n",
        "type P, method P.new, calls helper, method P.fmt, calls write, calls self.x.len, type Tr, method Tr.t, type E, function main, calls P.new",
    ),
    "go": ("package x\ntype T struct { a int }\nfunc (t *T) M(a int) error { return t.f(a) }\nfunc F() { G(`raw(\"x\")`) }\n", "type T, method T.M, calls t.f, function F, calls G"),
}


@pytest.mark.parametrize("language", PARSED)
def test_declarations_and_calls(language):
    code, want = PARSED[language]
    assert ", ".join(f"{what} {name}" for what, name, _ in lexer.declarations(code, language)) == want


@pytest.mark.parametrize("language", ["ts", "py", "rs", "go", "other"])
def test_lexers_end_on_any_text(language):
    rnd = random.Random(4)
    for n in range(300):
        code = "".join(rnd.choice(["`", "${", "}", "{", "/", '"', "'", "\\", "\n", "a", "(", ")", "class ", "fn ", "/*", "*/", "#", "1.5e-3", "é", " "]) for _ in range(n % 40))
        assert all(t in code for _, t, _ in lexer.tokens(code, language))
        assert all(0 < line <= code.count("\n") + 1 for *_, line in lexer.declarations(code, language))


def test_tokens_of_templates_and_patterns():
    got = [(k, t) for k, t, _ in lexer.tokens("`a ${ {b: `c`} } d` / 2; x = /[/]`/g", "ts")]
    assert got == [("string", "`a ${"), ("mark", "{"), ("word", "b"), ("mark", ":"), ("string", "`c`"), ("mark", "}"), ("string", "} d`"), ("mark", "/"), ("number", "2"), ("mark", ";"), ("word", "x"), ("mark", "="), ("regex", "/[/]`/g")]


def test_hidden_rows_columns_and_validations(spark):
    ship(spark)
    sheet = '<worksheet><cols><col min="2" max="3" hidden="1"/><col min="5" max="5"/></cols><sheetData><row r="4" hidden="1"/><row r="5"/></sheetData><dataValidations><dataValidation sqref="A1:A9 C1" type="list"/></dataValidations></worksheet>'
    files = make(spark, [("f", bytearray(packages.zipped({"xl/workbook.xml": '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="x" state="hidden"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="x" Target="s.xml"/></Relationships>', "xl/s.xml": sheet})))], "path string, content binary")
    got = sorted((r.sheet, r.kind, r["at"]) for r in packages.read(files, packages.layout, packages.LAYOUT).collect())
    assert got == [("S", "hidden_column", "2:3"), ("S", "hidden_row", "4"), ("S", "hidden_sheet", ""), ("S", "validation", "A1:A9 C1")]


def test_shared_formulas_are_shifted(spark):
    ship(spark)
    sheet = '<worksheet><sheetData><row r="1"><c r="C1"><f t="shared" si="0"/><v>6</v></c><c r="A1"><v>3</v></c><c r="B1"><f t="shared" ref="B1:C2" si="0">A1*$A$1</f><v>9</v></c></row><row r="2"><c r="B2"><f t="shared" si="0"/></c><c r="C2"><f t="shared" si="1"/><v>1</v></c></row></sheetData></worksheet>'
    book = '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="x"/></sheets></workbook>'
    files = make(spark, [("f", bytearray(packages.zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="x" Target="s.xml"/></Relationships>', "xl/s.xml": sheet})))], "path string, content binary")
    got = {r.ref: r.formula for r in packages.read(files, packages.cells, packages.CELLS).collect()}
    assert got == {"A1": "", "B1": "A1*$A$1", "C1": "B1*$A$1", "B2": "A2*$A$1", "C2": ""}


def test_lines_of_a_patch_are_sorted_once(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n--- b\n+++ c\n@@ -9 +9 @@\n-d\n+e"
    got = patches.unified_patch(make(spark, [("1", text)], "id string, text string"))
    assert [(r.hunk, r.pos, r.kind, r.old_line, r.new_line) for r in got.orderBy("hunk", "pos").collect()] == [
        (1, 1, "context", 1, 1), (1, 2, "delete", 2, None), (1, 3, "add", None, 2), (2, 1, "delete", 9, None), (2, 2, "add", None, 9),
    ]
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


@pytest.mark.parametrize("name", ["src3_unified_patch", "win14_hunk_line_numbers", "src11_lcov"])
def test_lines_are_dealt_to_texts_once_in_many_parts(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan  # a number of parts that isn't merged to few


def test_rows_of_packages_are_handed_on_in_batches_of_bounded_size(spark, monkeypatch):
    taken = []
    batches = packages.handed_on(iter(taken.append(i) or (str(i), b"x") for i in range(25_000)), "path string, content binary")
    assert next(batches).num_rows == packages.ROWS_AT_ONCE
    assert len(taken) == packages.ROWS_AT_ONCE  # the others aren't made yet
    assert [b.num_rows for b in batches] == [10_000, 5_000]


def test_packages_are_made_in_a_number_of_parts_that_is_not_merged_to_few(spark):
    rows = spark.range(300).select(F.col("id").alias("sheet"), F.lit(1).alias("row"), F.lit("2").alias("value"), F.lit("").alias("formula"))
    made = extensions.built(rows, "sheet", extensions.workbook)
    assert made.count() == 300
    assert made.select(F.spark_partition_id()).distinct().count() > 16  # small shuffles are merged to a task a core at most


def test_parts_that_packages_share_are_parsed_once(spark):
    book = packages.zipped({"xl/workbook.xml": '<x:workbook xmlns:x="u"><x:sheets/></x:workbook>'})
    a, b = (packages.Package(book).tree("xl/workbook.xml", shared=True) for _ in range(2))
    assert a is b
    assert [e.tag for e in a.iter()] == ["workbook", "sheets"]
