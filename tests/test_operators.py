"""Cases beyond the provided tables: edges, invariants, determinism, streams."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from veridelta import sinks
from veridelta.functions import paths, text
from veridelta.operators import core, coverage, dispatch, documents, fuzz, graph, history, mutation, observe, report, security, sequences, weakening
from veridelta.plans import graphs
from veridelta.sources import lines
from veridelta.streaming import limiter, replay


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_coverage_states_add_up_and_any_executed_block_wins(spark):
    got = coverage.file_coverage(
        make(spark, [("a", 1), ("a", 2), ("a", 9), ("b", 1)], "path string, line int"), make(spark, [("a", 1, 3, 1, 0), ("a", 2, 2, 1, 5)], "file string, start_line int, end_line int, stmts int, count int")
    ).orderBy("path").collect()
    assert [tuple(r) for r in got] == [("a", 3, 1, 1, 1, 0), ("b", 1, 0, 0, 0, 1)]


def test_islands_fold_past_the_cap(spark):
    df = make(spark, [("p", n) for n in (1, 2, 4, 6, 7, 9)], "path string, line int")
    got = [tuple(r)[1:] for r in core.capped_islands(df, ["path"], 2).orderBy("start").collect()]
    assert got == [(1, 2, 0), (4, 4, 0), (6, 9, 3)]


@pytest.mark.parametrize("bucket", [1, 2, 64])
def test_range_join_does_not_depend_on_buckets(spark, bucket):
    rnd = random.Random(3)
    points = {(rnd.choice("ab"), rnd.randrange(50)) for _ in range(60)}
    ranges = [(rnd.choice("ab"), s := rnd.randrange(50), s + rnd.randrange(20), i) for i in range(40)]
    got = core.range_join(make(spark, sorted(points), "k string, at int"), make(spark, ranges, "k string, s int, e int, i int"), ["k"], "at", "s", "e", bucket)
    assert {(r.k, r.at, r.i) for r in got.collect()} == {(k, a, i) for k, a in points for q, s, e, i in ranges if k == q and s <= a <= e}


def test_long_ranges_have_two_rows(spark):
    far = 10**7
    points = make(spark, [("a", 5), ("a", far), ("a", far + 1), (None, 70), ("b", 0)], "k string, at int")
    ranges = make(spark, [("a", 1, far, 1), ("a", far + 1, far + 1, 2), (None, 64, 64 * 64, 3), (None, 70, 60, 4), ("c", 0, 9, 5), ("b", None, 3, 6)], "k string, s int, e int, i int")
    got = core.range_join(points, ranges, ["k"], "at", "s", "e")
    assert {(r.k, r.at, r.i) for r in got.collect()} == {("a", 5, 1), ("a", far, 1), ("a", far + 1, 2), (None, 70, 3)}
    assert core.range_join(points, ranges.limit(0), ["k"], "at", "s", "e").count() == 0


CASES = [
    ("equal", [("base", "v"), ("candidate", "v"), ("repeat", "v")], "EQUAL", ""),
    ("differs", [("base", "v"), ("candidate", "w"), ("repeat", "v")], "DIVERGED", ""),
    ("repeat disagrees", [("base", "v"), ("candidate", "w"), ("repeat", "x")], "UNSTABLE", "repeat_differs"),
    ("one side", [("base", "v")], "INCOMPARABLE", "one_revision"),
    ("repeat only", [("repeat", "v")], "UNSTABLE", "repeat_only"),
    ("duplicate", [("base", "v"), ("base", "v"), ("candidate", "v"), ("repeat", "v")], "INCOMPARABLE", "duplicate"),
    ("redacted", [("base", "[REDACTED]"), ("candidate", "[REDACTED]"), ("repeat", "[REDACTED]")], "INCOMPARABLE", "value_redacted"),
    ("address", [("base", "0x00000001"), ("candidate", "0x00000002"), ("repeat", "0x00000001")], "INCOMPARABLE", "build_dependent"),
    ("too long", [("base", "v" * 5000), ("candidate", "v" * 5000), ("repeat", "v" * 5000)], "INCOMPARABLE", "value_too_long"),
]


def test_observation_cases(spark):
    rows = [(s, "T", name.replace(" ", "_"), v) for name, sides, *_ in CASES for s, v in sides] + [("base", "T", "bad key", "v"), ("candidate", "T", "bad key", "v")]
    got = {r.key: (r.status, r.reason) for r in observe.compare(make(spark, rows, "side string, test string, key string, value string")).collect()}
    assert got == {name.replace(" ", "_"): (st, why) for name, _, st, why in CASES} | {"bad key": ("INCOMPARABLE", "key_invalid")}


def test_fuzz_counts_add_up(spark):
    rnd = random.Random(1)
    rows = [(s, f"t{t}", i, 6, "f()", rnd.choice("ab"), 1, "d", rnd.random() < 0.1) for s in ("base1", "cand1", "base2", "cand2") for t in range(30) for i in range(6) if rnd.random() < 0.8]
    got = fuzz.evaluate(make(spark, rows, "side string, test string, i int, planned int, call string, hash string, length int, display string, unstable boolean")).collect()
    assert len(got) == 30
    assert all(r.planned == r.compared + r.unstable + r.unconfirmed + r.not_recorded for r in got)


def test_multiset_diff_ignores_moves_and_new_functions(spark):
    schema = "key string, sig string, body string, id int"
    before = make(spark, [("k", "s", "b", 1), ("k", "s", "b", 2)], schema)
    after = make(spark, [("k", "s", "b", 9), ("k", "s", "c", 8), ("k", "t", "b", 7), ("new", "s", "b", 1)], schema)
    assert sorted((r.id, r.change) for r in fuzz.changed_functions(before, after).collect()) == [(7, "signature_changed"), (8, "body_changed")]


def test_alert_lines_go_to_the_first(spark):
    rows = [("i", "p", "new", 3, 5, True, "low", 2), ("a", "p", "new", 1, 9, False, "low", 3), ("b", "p", "new", 4, 4, False, "low", 4)]
    got = report.dedupe_lines(make(spark, rows, "id string, path string, side string, line int, end_line int, issue boolean, severity string, rank bigint"))
    assert sorted((r.id, r.line, r.end_line) for r in got.collect()) == [("a#1", 1, 2), ("a#2", 6, 9), ("i", 3, 5)]


EDGES = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("x", "y"), ("c", "a")]


def test_path_is_shortest_and_first(spark):
    edges = make(spark, [(s, d, "calls") for s, d in EDGES], "src string, dst string, kind string")
    hops = lambda *a, **k: [(r.src, r.dst, r.kind) for r in graph.shortest_path(edges, *a, **k).orderBy("hop").collect()]
    assert hops("a", "e") == [("a", "b", "calls"), ("b", "c", "calls"), ("c", "e", "calls")]
    assert hops("a", "a") == []
    assert hops("a", "y") == []
    assert hops("e", "a", undirected=True) == [("e", "c", "calls (reversed)"), ("c", "a", "calls")]


def test_neighbors_come_once_at_their_least_depth(spark):
    edges = make(spark, [(s, d, "calls") for s, d in EDGES], "src string, dst string, kind string")
    got = {r.node: (r.depth, r.dir, r.via) for r in graph.neighbors(edges, "a", "both", 3).collect()}
    assert got == {"b": (1, "out", "a"), "d": (1, "out", "a"), "c": (1, "in", "a"), "e": (2, "out", "c")}


def brute_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], last if x == y else 1 + min(d[j], d[j - 1])
    return d[-1]


def test_edit_scripts_are_shortest_and_rebuild_the_text():
    rnd = random.Random(7)
    for n in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(12))) for _ in range(2))
        edits = sequences.edit_script(a, b)
        gone, new = [i for i, _ in edits if i >= 0], [j for _, j in edits if j >= 0]
        kept = [c for i, c in enumerate(a) if i not in gone]
        assert kept == [c for j, c in enumerate(b) if j not in new], (a, b)
        assert len(gone) + len(new) == brute_distance(a, b), (a, b)
    assert sequences.edit_script("abc", "abc") == []
    assert sequences.edit_script("ax" * 5, "by" * 5, most=2) == [(i, i) for i in range(10)]
    assert sequences.gaps("qaxz", "qbyz", most=3) == ([(range(1, 3), range(1, 3))], False)
    long = [str(n) for n in range(3000)]
    assert sequences.edit_script(long, long[:50] + ["new"] + long[51:]) == [(50, 50)]
    assert len(sequences.anchors(long, long[::-1])[0]) == 1


def test_edits_apply_to_nulls_empty_and_repeated_items(spark):
    rows = [("a", ["x", "x", "y"], ["x", "y", "y", "z"]), ("b", [], ["n"]), ("c", ["n"], []), ("d", None, None), ("e", ["q"], ["q"])]
    pairs = make(spark, rows, "id string, before array<string>, after array<string>")
    got = {r.id: (r.edits, r.after) for r in sequences.apply_edits(pairs, sequences.sequence_diff(pairs)).collect()}
    assert got == {"a": (3, ["x", "y", "y", "z"]), "b": (1, ["n"]), "c": (1, []), "d": (0, []), "e": (0, ["q"])}


def test_replaced_terms():
    assert sequences.replaced_terms("pay Acme Corp now", "pay Widget Inc now") == [("Acme Corp", "Widget Inc")]
    assert sequences.replaced_terms("ask Acme or Acme", "ask Widget or Acme") == []
    assert sequences.replaced_terms("", "x") == []


@pytest.mark.parametrize(("formula", "to", "want"), [("A1+$B$2", "C5", "C5+$B$2"), ('A1&"A1"', "B2", 'B2&"A1"'), ("SUM(A1:A3)", "A2", "SUM(A2:A4)")])
def test_shift_formula(formula, to, want):
    assert documents.shift_formula(formula, "A1", to) == want


def test_shift_off_the_sheet_breaks():
    assert documents.shift_formula("A1", "B2", "A1") == "#REF!"


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/auth/**", "auth/x", True), ("**/auth/**", "a/b/auth/c/d", True), ("*.go", "a/b.go", False), ("a?.go", "ab.go", True), ("a.go", "axgo", False), ("src/**", "src/a/b", True)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.search(paths.glob_regex(glob), path)) == hit


def test_bad_globs():
    for g in ("", "/a", "a\\b"):
        with pytest.raises(ValueError, match="glob"):
            paths.glob_regex(g)


def test_truncation_keeps_characters_whole(spark):
    texts = ["", "abc", "äöü" * 5, "日本語" * 4, "😀" * 6, "a😀"]
    for limit in (3, 4, 5, 7):
        got = make(spark, [(t,) for t in texts], "t string").select("t", text.truncate_utf8(F.col("t"), limit).alias("c")).collect()
        for r in got:
            want = r.t.encode()[:limit].decode(errors="ignore")
            assert r.c == want, (r.t, limit)


def test_strict_sources_fail_and_tolerant_ones_do_not(spark):
    bad = make(spark, [("1", "mode: set\nnonsense")], "id string, text string")
    with pytest.raises(Exception, match="not a coverage block"):
        lines.block_profile(bad).collect()
    log = make(spark, [("1", 'not json\n{"Action":"attr","Test":"T","Key":"observe.k","Value":"v"}')], "id string, text string")
    assert [(r.key, r.value, r.failed) for r in lines.observations(log).collect()] == [("k", "v", False)]


def test_limiter_matches_a_walk(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(3), t) for i, t in enumerate(sorted(rnd.randrange(20000) for _ in range(200)))]
    df = make(spark, rows, "event_id bigint, user_id bigint, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    start, seen, want = None, {}, {}
    for i, u, t in rows:
        if start is None or t >= start + 600:
            start, seen = t, {}
        seen[u] = seen.get(u, 0) + 1
        want[i] = seen[u] <= 2
    assert {r.event_id: r.allowed for r in limiter.limit(df, 600, 2).collect()} == want


def test_upsert_stream_equals_batch(spark, tmp_path):
    rows = [(k, s, f"v{s}") for s, k in enumerate(itertools.islice(itertools.cycle("abc"), 20))]
    schema = "key string, seq bigint, value string"
    for n in range(4):
        make(spark, rows[n * 5 : n * 5 + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = replay.stream_files(spark, str(tmp_path / "in"), schema)
    q = replay.upsert_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["key"], "seq")
    q.awaitTermination(120)
    got = {(r.key, r.seq, r.value) for r in replay.current(spark, str(tmp_path / "out"), stream.schema).collect()}
    assert {p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("list")} == {"list2", "list3"}
    assert got == {tuple(r) for r in core.last_by(make(spark, rows, schema), ["key"], "seq").select("key", "seq", "value").collect()}


def test_corpus_depends_on_names_only(spark):
    schema = "target string, types array<string>"
    a = mutation.corpus(make(spark, [("f", ["int", "string"]), ("g", ["bool"]), ("h", [])], schema), 60)
    b = mutation.corpus(make(spark, [("h", []), ("g", ["bool"]), ("f", ["int", "string"])], schema).repartition(3), 60)
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, b.collect()))
    calls = [c for t, _, c in rows if t == "f"]
    assert len(calls) == len(set(calls)) == 60
    assert calls[:6] == ['f(0, "")', 'f(0, "a")', 'f(0, " ")', 'f(0, "0")', 'f(0, "\\n")', 'f(1, "")']
    assert [c for t, _, c in rows if t != "f"] == ["g(false)", "g(true)", "h()"]


def test_empty_tables_give_no_rows(spark):
    none = make(spark, [], "path string, line int")
    blocks = make(spark, [], "file string, start_line int, end_line int, stmts int, count int")
    assert coverage.file_coverage(none, blocks).count() == 0
    assert core.islands(none, ["path"]).count() == 0
    assert report.severity_counts(make(spark, [], "kind string, severity string"), ["kind"]).count() == 0


@pytest.mark.parametrize("few", [0, 30, 64])
@pytest.mark.parametrize("seed", range(3))
def test_owners_against_a_line_by_line_walk(spark, monkeypatch, seed, few):
    monkeypatch.setattr(core, "FEW_RANGES", few)
    rnd = random.Random(seed)
    rows = [(rnd.choice("ab"), s := rnd.randrange(60), s + rnd.randrange(25), n) for n in range([1, 7, 60][seed])]
    own = {}
    for key, s, e, rank in rows:
        for line in range(s, e + 1):
            own[key, line] = min(own.get((key, line), rank), rank)
    want = []
    for (key, line), rank in sorted(own.items()):
        if want and want[-1][0] == key and want[-1][2] == line - 1 and want[-1][3] == rank:
            want[-1][2] = line
        else:
            want.append([key, line, line, rank])
    got = core.owners(make(spark, rows, "k string, start int, end int, rank int"), ["k"])
    assert sorted(map(list, got.select("k", "start", "end", "rank").collect())) == want


def test_a_whole_file_of_many_lines_is_one_range(spark):
    rows = [("a", 1, 10**12, 2), ("a", 5 * 10**11, 5 * 10**11, 1)]
    got = core.owners(make(spark, rows, "k string, start bigint, end bigint, rank int"), ["k"]).orderBy("start").collect()
    assert [(r.start, r.end, r["rank"]) for r in got] == [(1, 5 * 10**11 - 1, 2), (5 * 10**11, 5 * 10**11, 1), (5 * 10**11 + 1, 10**12, 2)]


def hunks(path, *groups):
    """Lines of a diff: each group a hunk of lines that begin with +, - or a space."""
    rows, at = [], 0
    for n, group in enumerate(groups):
        for text in group:
            at += 1
            rows.append((path, n, at, {"+": "add", "-": "delete", " ": "context"}[text[0]], at, text[1:]))
    return rows


WEAKER = [
    ("a_test.go", [["-if n := Len(); n != 4 {", "+if n := Len(); n > 3 {"]], [("test_expectation_relaxed", 2)]),
    ("a_test.go", [["-if err == nil {", "+if Len() >= 1 {"]], []),  # nothing is no exact value
    ("a_test.go", [["-if v == w {", "+if <-c && v>>2 {"]], []),  # no orderings
    ("a_test.go", [["-require.Equal(t, 1, n)", " x", "+\trequire.Equal(t, 1, n)"]], []),
    ("a_test.go", [["-func TestOne(t *testing.T) {", "-\tt.Fatal()", "-}"]], [("test_assertion_removed", 2), ("test_case_removed", 1)]),
    ("a_test.go", [["+\tt.SkipNow()"], ["-t.SkipNow()", "+t.SkipNow()"]], [("test_skip_added", 3)]),  # two added, the first made up for
    ("w/a.spec.tsx", [["+context.only('a')", "+m.fit(1)", "+  fdescribe('b')"]], [("test_focus_added", 1), ("test_focus_added", 3)]),
    ("w/a.spec.tsx", [["-expect(f).toThrow(E)", "+expect(f).toThrow()"], ["-expect(a).toBe(1)"], ["+expect(a).toMatch(/1/)"]], [("test_expectation_relaxed", 2)]),  # only inside a hunk
    ("tests/test_a.py", [["-assert a == 1", "+assert a is not None"], ["+@pytest.mark.xfail"]], [("test_expectation_relaxed", 2), ("test_skip_added", 3)]),
    ("tests/a.rs", [["+#[ignore]", "-assert_eq!(a, 1);", "+assert!(a.is_ok());"]], [("test_expectation_relaxed", 3), ("test_skip_added", 1)]),
    ("src/a.go", [["-require.Equal(t, 1, n)"]], []),
    ("ATest.java", [["-assertEquals(1, n);"]], []),
]


def test_weaker_tests(spark):
    rows = [r for n, (path, groups, _) in enumerate(WEAKER) for r in hunks(f"c{n}/{path}", *groups)]
    got = weakening.signals(make(spark, rows, "path string, hunk int, pos int, kind string, line int, content string")).collect()
    assert sorted((r.path, r.kind, r.line) for r in got) == sorted((f"c{n}/{path}", *x) for n, (path, _, want) in enumerate(WEAKER) for x in want)
    assert {r.severity for r in got if r.kind == "test_focus_added"} == {"high"}


def test_weaker_tests_are_capped_and_quoted(spark):
    rows = hunks("a_test.go", [f"+t.Skip({n})" for n in range(13)]) + hunks("a.test.js", [f"+it.only({n})" for n in range(7)], *[["-expect(a).toBe(1)", "+expect(a).toBeFalsy()"] for _ in range(12)])
    rows += hunks("b_test.go", ["+t.Skip(" + "ü" * 300])
    got = weakening.signals(make(spark, rows, "path string, hunk int, pos int, kind string, line int, content string")).collect()
    by = {(p, k): sorted((r for r in got if (r.path, r.kind) == (p, k)), key=lambda r: r.line) for p, k in {(r.path, r.kind) for r in got}}
    assert {k: len(v) for k, v in by.items()} == {("a_test.go", "test_skip_added"): 10, ("a.test.js", "test_focus_added"): 5, ("a.test.js", "test_expectation_relaxed"): 10, ("b_test.go", "test_skip_added"): 1}
    assert by["a_test.go", "test_skip_added"][-1].evidence.endswith("3 more in this file")
    long = by["b_test.go", "test_skip_added"][0].evidence
    assert long.endswith("ü…")
    assert len(long.encode()) < 260


def walked(commits, starts):
    """Depths of a level walk."""
    parents, found, level, d = {}, {}, set(starts), 0
    for a, b in commits:
        parents.setdefault(a, set()).add(b)
    while level:
        found |= dict.fromkeys(level, d)
        level, d = {b for a in level for b in parents.get(a, ()) if b is not None} - found.keys(), d + 1
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_depths_of_random_histories(spark, seed):
    rnd = random.Random(seed)
    commits = [(f"k{n}", f"k{rnd.randrange(max(0, n - 6), n)}") for n in range(1, 60) for _ in range(rnd.choice([1, 1, 2]))] + [("k0", None), ("k9", "gone")]
    df = make(spark, commits, "sha string, parent string")
    assert {r.sha: r.depth for r in history.commit_depths(df, "k59").collect()} == walked(commits, ["k59"])
    labels = [(f"k{rnd.randrange(60)}", f"l{n}") for n in range(7)] + [("nowhere", "l9")]
    far, want = walked(commits, [a for a, _ in labels if a != "nowhere"]), {}
    for sha, d in sorted(far.items(), key=lambda x: x[1]):
        want[sha] = {b for a, b in labels if a == sha} if d == 0 else {x for a, b in commits if b == sha and far.get(a) == d - 1 for x in want[a]}
    got = history.nearest_labels(df, make(spark, labels, "sha string, label string")).collect()
    assert {r.sha: (r.labels, r.distance) for r in got} == {s: (",".join(sorted(x)), far[s]) for s, x in want.items()}


def test_a_long_line_takes_few_jobs(spark):
    n = 1 << 17
    line = spark.range(1, n).select(F.concat(F.lit("k"), "id").alias("sha"), F.concat(F.lit("k"), F.col("id") - 1).alias("parent"))
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    before = before.get() if hasattr(before, "get") else before
    got = history.commit_depths(line, f"k{n - 1}").agg(F.count(F.lit(1)), F.max("depth"), F.sum("depth")).first()
    assert tuple(got) == (n, n - 1, n * (n - 1) // 2)
    after = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    assert (after.get() if hasattr(after, "get") else after) - before < 120  # joins and writes have some jobs each; a walk has one a commit


@pytest.mark.parametrize("seed", [4, 5])
def test_depths_by_way_of_anchors(spark, monkeypatch, seed):
    monkeypatch.setattr(history, "SHORT", 8)
    monkeypatch.setattr(history, "SPARSE", 3)
    rnd = random.Random(seed)
    commits = [(f"k{n}", f"k{rnd.randrange(max(0, n - 4), n)}") for n in range(1, 150) for _ in range(rnd.choice([1, 1, 1, 2]))] + [("k0", None)]
    got = history.commit_depths(make(spark, commits, "sha string, parent string"), "k149").collect()
    assert {r.sha: r.depth for r in got} == walked(commits, ["k149"])


def test_jumps_of_a_line_are_some_four_a_commit(spark, monkeypatch):
    monkeypatch.setattr(history, "SHORT", 1 << 8)
    n = 1 << 13
    line = spark.range(1, n).select(F.concat(F.lit("k"), "id").alias("sha"), F.concat(F.lit("k"), F.col("id") - 1).alias("to"), F.lit(1).cast("bigint").alias("n"))
    lines, rows = history._Lines(line, history.Tables(spark)), 0
    while lines is not None:
        rows, lines = rows + sum(j.count() for j in lines.jumps), getattr(lines, "over", None)
    assert rows < 5 * n  # with a level of jumps over the whole line for each power they are n log n


def test_jumps_of_long_lines_are_not_sent_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(history, "SHORT", 1, raising=False)
    plans = []

    class Kept(history.Tables):
        def save(self, df):
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
            return super().save(df)

    line = spark.range(1, 200).select(F.concat(F.lit("k"), "id").alias("sha"), F.concat(F.lit("k"), F.col("id") - 1).alias("to"), F.lit(1).cast("bigint").alias("n"))
    history._Lines(line, Kept(spark))
    assert sum("Join" in p for p in plans) > 5
    assert sum("BroadcastHashJoin" in p for p in plans) <= 1  # in a line of one way


def test_ways_that_leave_first_parents_again_and_again(spark):
    commits = [(n, n - 1, 0) for n in range(1, 400)] + [(n, n - 3, 1) for n in range(7, 400, 7)]
    df = make(spark, [(f"k{a:03}", f"k{b:03}", p) for a, b, p in commits], "sha string, parent string, place int")
    assert {int(r.sha[1:]): r.depth for r in history.commit_depths(df, "k399").collect()} == walked([c[:2] for c in commits], [399])


def test_merge_bases(spark):
    df = make(spark, [("b", "a"), ("c", "b"), ("d", "b"), ("e", "c"), ("e", "d"), ("x", None)], "sha string, parent string")
    assert history.merge_base(df, "c", "d") == "b"
    assert history.merge_base(df, "e", "d") == "d"
    with pytest.raises(ValueError, match="no merge base"):
        history.merge_base(df, "x", "a")
    both = make(spark, [("c", "a"), ("c", "b"), ("d", "a"), ("d", "b")], "sha string, parent string")
    with pytest.raises(ValueError, match="several"):
        history.merge_base(both, "c", "d")


METHODS = [("T", "size", "T.size"), ("T", "get", "T.get"), ("U", "size", "U.size"), ("V", "get", "V.get"), ("V", None, "V.?")]
FACES = [("Sizer", "size", "Sizer.size"), ("Both", "size", "Both.size"), ("Both", "get", "Both.get"), ("Rare", "size", "Rare.size"), ("Rare", "none", "Rare.none")]


def faces(spark):
    return make(spark, METHODS, "type string, method string, id string"), make(spark, FACES, "interface string, method string, id string")


def test_implementers_and_dispatch(spark):
    methods, interfaces = faces(spark)
    assert {tuple(r) for r in dispatch.implementers(methods, interfaces).collect()} == {("T", "Sizer"), ("U", "Sizer"), ("T", "Both")}
    assert {tuple(r) for r in dispatch.dispatch(methods, interfaces).collect()} == {("T.size", "Sizer.size"), ("U.size", "Sizer.size"), ("T.size", "Both.size"), ("T.get", "Both.get")}


def test_a_method_of_every_type_joins_little(spark):
    """200 types and 100 interfaces share a method; each interface has one more, that two types have."""
    methods = make(spark, [(f"T{t}", m, f"T{t}.{m}") for t in range(200) for m in ("all", f"own{t // 2}")], "type string, method string, id string")
    interfaces = make(spark, [(f"I{i}", m, f"I{i}.{m}") for i in range(100) for m in ("all", f"own{i}")], "interface string, method string, id string")
    got = dispatch.implementers(methods, interfaces)
    assert got.count() == 200
    assert dispatch.dispatch(methods, interfaces).count() == 400


def test_callers_through_interfaces(spark):
    methods, interfaces = faces(spark)
    reaches = dispatch.dispatch(methods, interfaces)
    calls = make(spark, [("use", "Sizer.size"), ("main", "use"), ("near", "T.size"), ("near", "Sizer.size"), ("TestA", "near"), ("TestB", "main"), ("over", "TestA"), ("use", "Both.get")], "src string, dst string")
    nodes = make(spark, [(n, "function", n, f"{n}.go", n.startswith("Test")) for n in ("use", "main", "near", "TestA", "TestB", "over", "T.size")], "id string, kind string, name string, path string, test boolean")
    got = {(r.caller, r.callee, r.depth, r.through, ">".join(r.via)) for r in dispatch.callers(calls, nodes, "T.size", 3, reaches).collect()}
    assert got == {
        ("near", "T.size", 1, "static", "near>T.size"), ("near", "Sizer.size", 1, "interface", "near>T.size"), ("use", "Sizer.size", 1, "interface", "use>T.size"), ("main", "use", 2, "interface", "main>use>T.size"),
        ("TestA", "near", 2, "static", "TestA>near>T.size"), ("TestB", "main", 3, "interface", "TestB>main>use>T.size"),
    }
    assert {r.caller for r in dispatch.callers(calls, nodes, "T.size", 3).collect()} == {"near", "TestA"}
    tests = dispatch.reaching_tests(calls, nodes, make(spark, [("T.size",)], "id string"), reaches=reaches).collect()
    assert {(r.test, r.depth, r.through) for r in tests} == {("TestA", 2, "static"), ("TestB", 3, "interface")}


def _tests_reached(calls, tests, target, reaches, depth=3):
    """{test: (depth, interface)} by a search from one target."""
    into = {}
    for a, b in calls:
        for to, i in [(b, 0), *((d, 1) for d, v in reaches if v == b)]:
            into.setdefault(to, {}).setdefault(a, []).append(i)
    seen, level, hits = {target}, {target: 0}, {}
    for d in range(1, depth + 1):
        reached = {}
        for n, i in level.items():
            for a, how in into.get(n, {}).items():
                if a not in seen:
                    reached[a] = min(reached.get(a, 1), max(i, min(how)))
        seen |= set(reached)
        hits |= {a: (d, i) for a, i in reached.items() if a in tests}
        level = {a: i for a, i in reached.items() if a not in tests}
    return hits


@pytest.mark.parametrize(("seed", "limit"), [(0, 2), (1, 100)])
def test_searches_that_targets_share_are_those_of_each(spark, seed, limit):
    """Targets alike, targets that are tests, calls back to a target, ids that stand twice among nodes."""
    rng = random.Random(seed)
    ids = [f"n{k:02}" for k in range(24)]
    calls = sorted({(rng.choice(ids), rng.choice(ids[:6])) for _ in range(22)} | {(rng.choice(ids), rng.choice(ids)) for _ in range(10)})
    reaches = sorted({(d, v) for d in ids[8:] for v in rng.choice([["n00"], ["n00", "n03"], ["n05"], []]) if d != v})
    tests = {n for n in ids if rng.random() < 0.4}
    nodes = [(n, f"p{k % 5}", f"{n}.{c}", n in tests) for k, n in enumerate(ids) for c in range(1 + (k % 7 == 0))]
    ways = make(spark, reaches, "dst string, via string")
    got = dispatch.reaching_tests(make(spark, calls, "src string, dst string"), make(spark, nodes, "id string, path string, name string, test boolean"), make(spark, [(n,) for n in ids] + [(None,)], "id string"), limit=limit, reaches=ways)
    want = set()
    for target in ids:
        hits = _tests_reached(calls, tests, target, reaches)
        rows = sorted((hits[n][0], path, name, n, hits[n][1]) for n, path, name, _ in nodes if n in hits)
        want |= {(target, n, d, ("static", "interface")[i], path, name, len(rows), k) for k, (d, path, name, n, i) in enumerate(rows, 1) if k <= limit}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_every_function_is_asked_for_its_tests(spark):
    ids = [f"function:Supplier#{n:09}" for n in (3, 19, 20, 4711)]
    nodes = make(spark, [(n, "function", n, n, False) for n in ids] + [("function:TestA", "function", "TestA", "a_test.go", True)], "id string, kind string, name string, path string, test boolean")
    got = graphs.reach(make(spark, [("function:TestA", n) for n in ids], "src string, dst string"), nodes, make(spark, [], "type string, method string, id string"), make(spark, [], "interface string, method string, id string"))
    assert {(r.id, r.test, r.total, r.place) for r in got.collect()} == {(n, "function:TestA", 1, 1) for n in ids}


def test_sites_prefer_direct_calls_and_leave_out_added_lines(spark):
    methods, interfaces = faces(spark)
    sites = make(spark, [("f", "Sizer.size", "a.go", 1, 1), ("f", "T.size", "a.go", 1, 2), ("g", "Sizer.size", "a.go", 5, 3), ("g", "T.size", "b.go", 9, 4), ("TestA", "T.size", "c.go", 1, 5), ("T.get", "T.size", "d.go", 1, 6)], "src string, dst string, path string, line int, seq int")
    got = dispatch.unchanged_callers(sites, make(spark, [("T.get",)], "id string"), make(spark, [("TestA",)], "id string"), dispatch.dispatch(methods, interfaces), make(spark, [("b.go", 9)], "path string, line int"))
    assert {tuple(r) for r in got.where("dst = 'T.size'").collect()} == {("T.size", "a.go", 1, "f", "static"), ("T.size", "a.go", 5, "g", "interface")}
    assert got.where("dst = 'U.size'").count() == 2


def test_a_budget_bounds_the_edges_read(spark):
    """A hub of 500 neighbours stands first in a level: with 20 edges left only its own are joined."""
    edges = [("s", f"n{i:02}", "k") for i in range(30)] + [("n00", f"h{i}", "k") for i in range(500)] + [(f"n{i:02}", f"m{i}", "k") for i in range(1, 30)]
    df = make(spark, edges, "src string, dst string, kind string")
    for budget, levels in ((10, [30]), (50, [30, 500]), (29, [30]), (600, [30, 529])):
        read = []
        got = graph.neighbors(df, "s", "out", 2, budget=budget, limit=1000, looked=read.append).collect()
        assert read == levels
        assert len(got) == min(budget, 559)
        assert {r.truncated for r in got} == {budget < 559}
        assert not got[0].timed_out


def test_a_deadline_returns_what_was_written(spark):
    df = make(spark, [("s", "a", "k"), ("a", "b", "k")], "src string, dst string, kind string")
    got = graph.neighbors(df, "s", "out", 2, seconds=0.0)
    assert got.count() == 0
    assert [(r.node, r.timed_out) for r in graph.neighbors(df, "s", "out", 2, seconds=600.0).orderBy("node").collect()] == [("a", False), ("b", False)]
    late = graph._Deadline(spark, 0.5)
    slow = spark.range(1).select(F.expr("reduce(sequence(1, 3000000), 0L, (a, x) -> a + hash(x))"))
    assert late.run(lambda: [slow.collect() for _ in range(200)]) is None
    assert late.over
    assert spark.range(3).count() == 3  # later jobs run


def test_mentions_are_looked_for_by_rare_words(spark):
    """All passages begin with the words that terms begin with; ids of passages repeat, and terms have odd cases and blanks."""
    passages = [(n, f"The old plan {'Alpha' if n % 5 == 0 else 'beta'}, é{n} the") for n in range(60)] + [(0, "the old plan  alpha"), (70, None), (71, ""), (None, "the old plan alpha")]
    terms = [("the old plan alpha", 5), ("THE", -1), ("the old", 3), ("é7 the", -1), ("gone the", -1), (" ", -1), (None, -1), ("plan é7", -1), ("the old plan alpha", 10)]
    got = {tuple(r) for r in documents.mentions(make(spark, terms, "term string, source bigint"), make(spark, passages, "id bigint, text string")).collect()}
    flat = lambda t: " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())) + " "
    assert got == {(term, i) for term, source in terms if term and term.strip() for i, t in passages if i is not None and i != source and f" {term.lower()} " in flat(t)}


def test_logs_in_pieces_join_to_one(spark, tmp_path):
    """A key with nearly all results comes in many pieces, none of them large; what is written is the same text."""
    rows = [(f"s{n:05}", "hot" if n % 50 else f"k{n}", f"kind_{n % 3}", f"src/f{n % 7}.go" if n % 11 else None, n % 90, n % 90, "high", f'say "{n}"\n', None) for n in range(4000)]
    df = make(spark, rows, "id string, key string, kind string, path string, line int, end_line int, severity string, summary string, other string")
    pieces = sinks.sarif(df, ["key"], piece_bytes=4000)
    got = {r.key: json.loads(r.log) for r in sinks.joined(pieces, ["key"]).collect()}
    assert set(got) == {r[1] for r in rows}
    hot = got["hot"]["runs"][0]
    assert [x["id"] for x in hot["tool"]["driver"]["rules"]] == ["kind_0", "kind_1", "kind_2"]
    wanted = sorted((r for r in rows if r[1] == "hot"), key=lambda r: (r[2], r[3] is not None, r[3] or "", r[4], r[0]))
    assert [x["partialFingerprints"]["veridelta/v1"] for x in hot["results"]] == [r[0] for r in wanted]
    sizes = [len(r.text) for r in pieces.where("key = 'hot'").collect()]
    assert len(sizes) > 100
    assert max(sizes) < 8000
    sinks.write_pieces(pieces, ["key"], str(tmp_path / "log"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "log" / "key=hot").glob("part-*.txt")))) == got["hot"]
    assert sinks.sarif(df.limit(0), ["key"]).count() == 0


KINDS = ["int", "bool", "string", *(f"{u}int{b}" for u in ("", "u") for b in (8, 16, 32, 64)), "float32", "float64"]


@pytest.mark.parametrize("kind", [*KINDS, *(f"[]{k}" for k in KINDS), "[3]uint8", "[0]int", "...string", "...bool", "...float32"])
def test_corpora_of_all_types(kind):
    full = mutation.calls_of("f", [kind], 80)
    assert len(set(full)) == len(full)
    assert tuple(full[: len(dict.fromkeys(mutation.edges(kind)))]) == tuple(dict.fromkeys(mutation.edges(kind)))
    for n in (1, 5, 30, 79):
        assert mutation.calls_of("f", [kind], n) == full[:n]
    assert len(full) == 80 or kind in ("bool", "[0]int")  # others have enough values
    if m := re.fullmatch(r"(u?)int(\d+)", kind):
        lo, hi = (0, 2 ** int(m[2]) - 1) if m[1] else (-(2 ** (int(m[2]) - 1)), 2 ** (int(m[2]) - 1) - 1)
        assert {str(lo), str(hi)} < set(full)
        assert all(lo <= int(x) <= hi for x in full)
    if kind == "float64":
        assert full[0] == "float64frombits(0x0000000000000000)"
        assert full[1] == "float64frombits(0x8000000000000000)"
    if kind.startswith("[3]"):
        assert all(x.count(",") == 2 for x in full)


def test_inputs_of_several_lists():
    assert mutation.calls_of("f", ["[]string", "...int"], 3) == ["[]string(nil)", "[]string(nil), 0", "[]string(nil), 1, 0"]
    with pytest.raises(ValueError, match="chan"):
        mutation.calls_of("f", ["[]chan"], 3)


def test_negations_and_dates_have_the_edges_of_their_sql(spark, duck):
    from veridelta.plans import texts

    odd = ["caféno", "noé", "Kein Wort", "ſin, paſ pas", "not_ not", "NEVER nó", "", "vom é2024-01-02é"]
    rows = make(spark, [(n, t) for n, t in enumerate(odd)], "n int, t string").select("n", text.negations(F.col("t")), F.size(text.dates(F.col("t")))).collect()
    want = [duck.execute(f"SELECT len(regexp_extract_all(regexp_replace(?, '\\s+', '  ', 'g'), {texts.NEG})), len(regexp_extract_all(?, {texts.DATE}, 1))", [t, t]).fetchall()[0] for t in odd]
    assert [tuple(r)[1:] for r in sorted(rows)] == want
    assert want[0][0] == want[1][0] == 1 and want[7][1] == 1


def _graph(spark):
    rng = random.Random(5)
    types = make(spark, [(f"T{t}", f"m{m}", f"T{t}.m{m}") for t in range(12) for m in rng.sample(range(5), 3)], "type string, method string, id string")
    faces = make(spark, [(f"I{i}", f"m{m}", f"I{i}.m{m}") for i in range(6) for m in rng.sample(range(5), 1 + i % 2)] + [("I9", "m0", "T0.m0")], "interface string, method string, id string")
    ends = [r[0] for r in types.select("id").union(faces.select("id")).distinct().collect()]
    sites = [(rng.choice("fgh"), d, f"p{rng.randrange(4)}", rng.randrange(3), n) for n, d in enumerate(rng.choices(ends[: len(ends) // 2], k=60))]
    return types, faces, make(spark, sites, "src string, dst string, path string, line int, seq int")


def test_dispatch_of_called_methods_is_that_of_all(spark):
    types, faces, sites = _graph(spark)
    every = {tuple(r) for r in dispatch.dispatch(types, faces).collect()}
    called = {r.dst for r in sites.collect()}
    assert {tuple(r) for r in dispatch.dispatch(types, faces, sites.select(F.col("dst").alias("id"))).collect()} == {(d, v) for d, v in every if v in called} != every
    assert {r.dst for r in dispatch.reachable(types, faces).collect()} == {d for d, _ in every}


def test_unchanged_callers_share_sites_and_come_for_the_first_callees(spark):
    types, faces, sites = _graph(spark)
    every, none = dispatch.dispatch(types, faces), make(spark, [], "id string")
    want = {}
    for s in sites.collect():
        for dst, iface in [(s.dst, 0), *((d, 1) for d, v in every.collect() if v == s.dst)]:
            want[dst, s.path, s.line] = min(want.get((dst, s.path, s.line), (9,)), (iface, s.seq, s.src))
    want = {(*k, v[2], ("static", "interface")[v[0]]) for k, v in want.items()}
    assert {tuple(r) for r in dispatch.unchanged_callers(sites, none, none, every).collect()} == want
    first = sorted({w[0] for w in want})[:4]
    assert {tuple(r) for r in dispatch.unchanged_callers(sites, none, none, every, first=4).collect()} == {w for w in want if w[0] in first}


def test_copied_sites_are_neither_shuffled_nor_broadcast(spark):
    types, faces, sites = _graph(spark)
    none = make(spark, [], "id string")
    got = dispatch.unchanged_callers(sites, none, none, dispatch.dispatch(types, faces))
    assert not _shuffled_after_joins(got)
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def _shuffled_after_joins(df):
    """Whether an exchange stands above a join of a plan."""
    lines = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x or "Join" in x]
    return "Exchange" in lines[0] and any("Join" in x for x in lines)


def test_calls_meet_what_they_may_mean_without_a_shuffle_of_pairs(spark):
    calls = [("a", "n", "x"), ("a", "n", "x"), ("b", "n", "z"), ("b", "o", None), ("c", "none", "x")]
    have = [("1", "n", "x"), ("2", "n", "x"), ("3", "n", "y"), ("4", "n", "y"), ("5", "o", "x"), ("5", "o", "x")]
    got = graph.resolve_calls(make(spark, calls, "caller string, name string, file string"), make(spark, have, "id string, name string, home string"))
    assert not _shuffled_after_joins(got)
    want = {("a", "n", "x", "1", 0, False), ("a", "n", "x", "2", 0, False), *(("b", "n", "z", d, 1, True) for d in "1234"), ("b", "o", None, "5", 1, False)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_calls_meet_lists_of_declarations(spark, monkeypatch):
    """Joins make a row a list, lists hold so many at most, null ids stay, and no copies are broadcast."""
    monkeypatch.setattr(graph, "LISTED", 2)
    have = [(k, "n", "x") for k in (1, 2, 3, 4, 5, None)] + [(6, "n", "y")]
    got = graph.resolve_calls(make(spark, [("a", "n", "x"), ("b", "n", "z")], "caller string, name string, file string"), make(spark, have, "id int, name string, home string"))
    want = {("a", "n", "x", k, 0, True) for k in (1, 2, 3, 4, 5, None)} | {("b", "n", "z", k, 1, True) for k in (1, 2, 3, 4, 5, 6, None)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(_ids" in plan and "Broadcast" not in plan


def test_ties_of_both_kinds_and_of_repeated_ids_come_once(spark):
    rng = random.Random(3)
    pick = lambda n, ids: [(rng.randrange(ids), rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", None]), rng.choice("xy")) for _ in range(n)]
    f, c = pick(20, 14), pick(20, 14)
    schema = "id int, place int, before string, after string"
    tied = documents.tied(make(spark, f, schema), make(spark, c, schema))
    assert not _shuffled_after_joins(tied)  # pairs of ids with one row
    got = [tuple(r) for r in tied.collect()]
    want = {(x[0], y[0]) for x in f for y in c if (x[1] is not None and x[1] == y[1]) or (x[2] is not None and x[2:] == y[2:])}
    assert set(got) == want and len(got) == len(want)


def test_ties_send_no_copies_to_the_driver(spark):
    rows = spark.range(400).selectExpr("CAST(id AS int) AS id", "CAST(id % 9 AS int) AS place", "CAST(id % 5 AS string) AS before", "CAST(id % 7 AS string) AS after")
    tied = documents.tied(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))
    assert tied.count() > 0
    tied.collect()
    assert "Broadcast" not in tied._jdf.queryExecution().executedPlan().toString()


def test_priority_of_many_ranges_makes_no_pairs(spark):
    """A long range that began earlier counts, ends touch, other sides and null lines don't; equal ranges aren't paired."""
    spans = [(1, 3), (2, 2), (5, 40), (5, 6), (41, 41), (60, 50), (None, 9)]
    rows = [(p, a, b, "new" if n % 5 else "old", sev) for n, (p, (a, b), sev) in enumerate(itertools.product(["x", "y", None], spans, ["low", "high", "critical", "none"])) if (p, n % 3) != ("y", 0) and not (sev == "critical" and a != 41)]
    signals = spark.createDataFrame(rows, "path string, line int, end_line int, side string, severity string")
    at = [(p, f"f{k}", a, a + k % 3 * 4) for k, (p, a) in enumerate(itertools.product(["x", "y", "z", None], range(0, 64)))]
    targets = spark.createDataFrame(at, "path string, name string, line int, end_line int")
    rank = {"critical": 4, "high": 3, "low": 1, "none": 0}
    want = {(p, f, a): max([0, *(rank[v] for q, s, e, side, v in rows if q == p and p and s and side == "new" and s <= max(a, b) and max(s, e) >= a)]) for p, f, a, b in at}
    assert {(r.path, r.name, r.line): r.priority for r in fuzz.priority(targets, signals).collect()} == want
    many = spark.range(20000).selectExpr("concat('x', id % 1) AS path", "1 AS line", "2 AS end_line")
    got = fuzz.priority(many.selectExpr("*", "'f' AS name"), many.selectExpr("*", "'new' AS side", "'low' AS severity"))
    assert got.groupBy("priority").count().collect() == [(1, 20000)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # targets meet what was found for their ends, not signals


def test_runs_are_dealt_by_key_once(spark):
    """A shuffle of the rows and one of the tests; rows aren't multiplied to be counted distinct."""
    rows = [("t", "k", "base", "1"), ("t", "k", "candidate", "1"), ("t", "k", "repeat", "2"), ("u", "k", "base", "1"), ("v", "k", "base", "1"), ("v", "k", "candidate", None), ("w", None, "base", "1"), ("w", None, "candidate", "2"), ("x", "k", "base", "1"), ("x", "k", "base", "1")]
    seen = observe.differ(spark.createDataFrame(rows, "test string, key string, side string, value string"))
    assert {r.test: r.differs for r in seen.collect()} == {"t": False, "u": True, "v": False, "w": True, "x": True}
    calls = [("t", 0, "f(1)"), ("t", 0, "f(1)"), ("t", 1, None), ("u", 0, "f(1)"), ("u", 0, "f(2)"), ("v", 0, None)]
    same = fuzz.consistent(spark.createDataFrame(calls, "test string, i int, call string"))
    assert {r.test: r.consistent for r in same.collect()} == {"t": True, "u": False, "v": False}
    for df in (seen, same):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange hashpartitioning") == 2 and "Expand" not in plan


def test_fuzz_records_are_read_once_and_only_recorded_indices_are_made(spark):
    rec = lambda side, i, h, planned=9: (side, "t", i, planned, "f", h, 1, "d", False)
    rows = [rec(s, 0, "h") for s in ("base1", "cand1")] + [rec(s, 1, h) for s, h in (("base1", "a"), ("cand1", "b"), ("base2", "a"), ("cand2", "b"))] + [rec("base1", 2, "a"), rec("cand1", 9, "a")]
    rows += [("base1", "none", 0, 0, "f", "h", 1, "d", False)]
    records = make(spark, rows, "side string, test string, i int, planned int, call string, hash string, length int, display string, unstable boolean")
    got = fuzz.evaluate(records)
    assert [(r.test, r.planned, r.compared, r.unstable, r.unconfirmed, r.not_recorded, r.diverged, r.separating, r.outcome) for r in got.collect()] == [("t", 9, 2, 0, 0, 7, 1, 0, "diverged")]
    best = fuzz.counterexample(records)
    assert [(r.test, r.i) for r in best.collect()] == [("t", 1)]
    for df in (got, best):
        assert df._jdf.queryExecution().analyzed().toString().count("LogicalRDD") == 1


def test_edits_are_handed_on_in_bounded_batches():
    pa = pytest.importorskip("pyarrow")
    n = 2 * sequences.EDITS_AT_ONCE + 1
    rows = pa.RecordBatch.from_pydict({"id": ["a", "b"], "before": [None, ["x"]], "after": [[str(k) for k in range(n)], ["x", "y"]]}, schema=pa.schema([("id", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]))
    got = list(sequences.edit_batches(iter([rows]), None))
    assert [b.num_rows for b in got] == [sequences.EDITS_AT_ONCE] * 2 + [2]
    assert got[-1].to_pylist()[-1] == {"id": "b", "i": -1, "j": 1, "before": None, "after": "y", "shortest": True}


def test_observations_are_sorted_by_key_first(spark):
    obs = make(spark, [("base", "T", "k", "v"), ("candidate", "T", "k", "v"), ("repeat", "T", "k", "v")], "side string, test string, key string, value string")
    got = observe.compare(obs)
    assert [tuple(r)[:4] for r in got.collect()] == [("T", "k", "EQUAL", "")]
    assert "Aggregate [key#" in got._jdf.queryExecution().optimizedPlan().toString()  # few tests: sorted by test first, nearly all comparisons are of whole rows


def test_texts_that_rules_need_are_rare_in_prose(spark):
    prose = "Was it right? The night fell over A & B. They met at noon.".lower()
    assert not [n for r in security.RULES for needles, _ in r.each() for n in needles if n in prose]  # such a line is read once, for no rule
    lines = [("a", 1, "host = '10.2.3.4'"), ("a", 2, "see http://10.2.3.5/x"), ("a", 3, "me@10.2.3.6"), ("a", 4, 'GET /x?token=abcdefgh1 and "y"'), ("a", 5, "ghs_" + "a1" * 18), ("a", 6, "plain 10.2.3.7.")]
    got = {(r.line, r.kind) for r in security.hits(make(spark, lines, "path string, line int, content string")).collect()}
    assert {(1, "hardcoded_ip"), (2, "hardcoded_ip"), (3, "hardcoded_ip"), (4, "credential_in_url"), (5, "hardcoded_secret")} <= got
    assert 6 not in {n for n, _ in got}
