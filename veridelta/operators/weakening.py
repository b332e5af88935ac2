"""Edits of test files that may make them weaker, from the text of changed lines.

Nothing is parsed or run: a signal is a reason to look, not a finding. Lines come
as (path, hunk, pos, kind, line, content), ``pos`` rising within a file. A line is
classified by one expression for its language; only lines with a mark are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions import paths
from veridelta.functions import text as tx
from veridelta.shared import Tables

#: Kinds of signals, and how many of a kind a file gets.
ASSERTION_REMOVED, CASE_REMOVED, SKIP_ADDED, FOCUS_ADDED, RELAXED = "test_assertion_removed", "test_case_removed", "test_skip_added", "test_focus_added", "test_expectation_relaxed"
MOST = {SKIP_ADDED: 10, FOCUS_ADDED: 5, RELAXED: 10}

#: Marks of a line, in the order of ``Language``.
MARKS = ("assertion", "case", "skip", "focus", "strict", "loose")

_FREE = r"(^|[^\w.$])"


def called(before: str, *names: str, empty: bool | None = None) -> str:
    """A call of one of some names; ``empty``: only without arguments, or only with some."""
    return f"{before}({'|'.join(names)})\\s*\\(" + {None: "", True: r"\s*\)", False: r"\s*[^)\s]"}[empty]


def any_of(*patterns: str) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


@dataclass(frozen=True)
class Language:
    """Patterns of a language's tests, as both engines read them; an empty one matches nothing.

    ``statement`` begins a line whose comparisons are expectations too, other
    than those with ``nothing``.
    """

    endings: tuple[str, ...]
    assertion: str
    case: str
    skip: str
    focus: str
    strict: str
    loose: str
    statement: str = ""
    nothing: str = ""


#: Names by which test libraries assert, skip and focus.
GO_FAILS, GO_SKIPS, GO_LOGS = ("Error", "Errorf", "Fatal", "Fatalf", "Fail", "FailNow"), ("Skip", "Skipf", "SkipNow"), ("Log", "Logf")
GO_EXACT = ("Equal", "EqualValues", "Exactly", "JSONEq", "YAMLEq", "ErrorIs", "EqualError")
GO_LOOSE = ("NotNil", "True", "False", "NotEmpty", "Contains", "NotZero", "Error", "NoError", r"Greater\w*", r"Less\w*", "Len", "Positive", "Negative", "Subset")
JS_EXACT, JS_EXACT_ASSERTS = ("toBe", "toEqual", "toStrictEqual"), ("equal", "strictEqual", "deepEqual", "deepStrictEqual", "throws")
JS_LOOSE = ("toBeDefined", "toBeTruthy", "toBeFalsy", r"toBeGreaterThan\w*", r"toBeLessThan\w*", "toContain", "toMatch", "toHaveLength", "toHaveBeenCalled")
JS_SUITES, JS_CASES, JS_VARIANTS = ("it", "test", "describe", "context"), ("it", "test"), ("only", "skip", "todo", "concurrent", "failing")
PY_EXACT = ("assertEqual", "assertEquals", "assertIs", "assertRaises", "assertDictEqual", "assertListEqual", "assertSequenceEqual")
PY_LOOSE = ("assertTrue", "assertFalse", "assertIsNotNone", "assertIsNone", "assertIn", "assertNotIn", r"assertGreater\w*", r"assertLess\w*", "assertAlmostEqual")
PY_MARKS, PY_DECORATORS = ("skip", "skipif", "xfail"), ("skip", "skipIf", "skipUnless", "expectedFailure")
RUST_ASSERTS = ("assert", "assert_eq", "assert_ne", "debug_assert", "debug_assert_eq", "debug_assert_ne", "assert_matches")
RUST_STATES = ("is_ok", "is_err", "is_some", "is_none", "is_empty", "contains")

_either = "|".join
GO_LIBRARY = r"\b(?:assert|require)\."

LANGUAGES = (
    Language(
        ("go",),
        assertion=any_of(called(r"\bt\.", *GO_FAILS), called(GO_LIBRARY, r"[A-Z]\w*")), case=r"^\s*func\s+Test\w*\s*\(", skip=called(r"\bt\.", *GO_SKIPS), focus="",
        strict=any_of(called(GO_LIBRARY, *GO_EXACT), called(r"\bt\.", *GO_FAILS)), loose=any_of(called(GO_LIBRARY, *GO_LOOSE), called(r"\bt\.", *GO_LOGS)), statement=r"^\s*(?:\}\s*else\s+)?if\b", nothing="nil",
    ),
    Language(
        ("js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts"),
        assertion=any_of(called(r"\b", "expect"), called(_FREE, r"assert(?:\.\w+)?")), case=called(r"^\s*", rf"(?:{_either(JS_CASES)})(?:\.(?:{_either(JS_VARIANTS)}))?"),
        skip=any_of(called(_FREE, rf"(?:{_either(JS_SUITES)})\.(?:skip|todo)"), called(_FREE, *(f"x{s}" for s in JS_SUITES)), called(_FREE, r"test\.fixme")),
        focus=any_of(called(_FREE, rf"(?:{_either(JS_SUITES)})\.only"), called(_FREE, "fit", "fdescribe")),
        strict=any_of(called(r"\.", *JS_EXACT), called(r"\.", "toThrow", empty=False), called(_FREE + r"assert\.", *JS_EXACT_ASSERTS)),
        loose=any_of(called(r"\.", *JS_LOOSE), called(r"\.not\.", "toBeNull", "toBeUndefined"), called(r"\bexpect\.", "any", "anything"), called(r"\.", "toThrow", empty=True), called(_FREE + r"assert\.", "ok", "notEqual"), called(_FREE, "assert")),
    ),
    Language(
        ("py",),
        assertion=any_of(called(r"\bself\.", r"assert\w*"), r"^\s*assert\b", called(r"\bpytest\.", "raises")), case=r"^\s*(?:async\s+)?def\s+test\w*\s*\(",
        skip=any_of(rf"@pytest\.mark\.(?:{_either(PY_MARKS)})\b", rf"@unittest\.(?:{_either(PY_DECORATORS)})\b", called(r"\bpytest\.", "skip"), called(r"\bself\.", "skipTest")), focus="",
        strict=called(r"\bself\.", *PY_EXACT), loose=any_of(called(r"\bself\.", *PY_LOOSE), r"^\s*assert\b.*\bis\s+not\s+None\b"), statement=r"^\s*assert\b", nothing="None",
    ),
    Language(
        ("rs",),
        assertion=any_of(called(r"\b", *(f"{a}!" for a in RUST_ASSERTS)), called(r"\.", "expect_err", "unwrap_err")), case=r"^\s*#\[\s*(?:\w+::)*(?:test|rstest|test_case)\b", skip=r"^\s*#\[\s*ignore\b", focus="",
        strict=called(r"\b", "assert_eq!", "assert_matches!"), loose=any_of(called(r"\b", "assert_ne!"), rf"\bassert!\s*\(.*\.(?:{_either(RUST_STATES)})\s*\("), statement=r"^\s*assert\b", nothing="None",
    ),
)

#: An equality; one with a language's nothing is taken out before.
EQUALITY = r"(?:^|[^=!])[=!]="
#: An ordering that is no part of a shift, an arrow or a channel operation.
ORDERING = r"(?:^|[^-=<])<(?:[^-<]|$)|(?:^|[^-=>])>(?:[^->]|$)"


def with_nothing(nothing: str) -> str:
    """An equality with ``nothing``, after what stands before it and before what ends its name."""
    return rf"(^|[^=!])[=!]=\s*{nothing}([^\w]|$)"


def expectation(language: Language, line: Column) -> tuple[Column, Column]:
    """Whether a line expects exactly, and whether loosely."""
    strict, loose = line.rlike(language.strict), line.rlike(language.loose)
    if language.statement:
        compares = line.rlike(language.statement)
        strict |= compares & F.regexp_replace(line, with_nothing(language.nothing), "$1 $2").rlike(EQUALITY)
        loose |= compares & line.rlike(ORDERING)
    return strict, loose


def _marks(language: Language, line: Column) -> Column:
    has = lambda p: line.rlike(p) if p else F.lit(False)
    strict, loose = expectation(language, line)
    return F.struct(*(c.alias(m) for m, c in zip(MARKS, (has(language.assertion), has(language.case), has(language.skip), has(language.focus), strict, loose), strict=True)))


def marks(path: Column, line: Column) -> Column:
    """The marks of a line of a test file; null where the language has no rules."""
    ending = paths.extension(path)
    cases = [(ending.isin(*x.endings), _marks(x, line)) for x in LANGUAGES]
    return reduce(lambda out, c: out.when(*c), cases[1:], F.when(*cases[0]))


def strictness(path: Column, line: Column) -> Column:
    """strict, loose, both or none: how exactly a line of a test puts what it expects; null without rules."""
    m = marks(path, line)
    return F.when(m.isNotNull(), F.when(m["strict"] & m["loose"], "both").when(m["strict"], "strict").when(m["loose"], "loose").otherwise("none"))


def marked(lines: DataFrame) -> DataFrame:
    """The changed lines of test files that have a mark, with their marks as columns."""
    changed = lines.where(F.col("kind").isin("add", "delete") & paths.is_test(F.col("path")))
    found = changed.select("path", "hunk", "pos", F.col("kind") == "add", "line", "content", marks(F.col("path"), F.col("content")).alias("m")).toDF("path", "hunk", "pos", "added", "line", "content", "m")
    return found.select("path", "hunk", "pos", "added", "line", "content", "m.*").where(" OR ".join(MARKS))


def quoted(line: Column) -> Column:
    """A line as evidence: trimmed, at most 240 bytes and a mark that it is cut."""
    bare = F.btrim(line, F.lit(" \t\r\n\v\f"))
    return F.when(F.octet_length(bare) <= 240, bare).otherwise(F.concat(tx.truncate_utf8(bare, 240), F.lit("…")))


def balance(found: DataFrame) -> DataFrame:
    """Of each file and of assertions and cases, where more are removed than added: path, kind, removed, added and the first removed."""
    of = F.explode(F.filter(F.array(F.when(F.col("assertion"), ASSERTION_REMOVED), F.when(F.col("case"), CASE_REMOVED)), lambda k: k.isNotNull()))
    rows = found.select("path", of.alias("signal"), "added", F.struct("pos", "line", "content").alias("at"))
    g = rows.groupBy("path", "signal").agg(F.count_if(~F.col("added")).alias("removed"), F.count_if("added").alias("new"), F.min(F.when(~F.col("added"), F.col("at"))).alias("first"))
    return g.where("removed > new").select("path", F.col("signal").alias("kind"), "removed", F.col("new").alias("added"), "first.line", "first.content")


def markers(found: DataFrame) -> DataFrame:
    """Added skip and focus markers (path, signal, pos, line, content) but those that a removed line of the same text, wherever it stood, makes up for, one for one."""
    of = F.explode(F.filter(F.array(F.when(F.col("skip"), SKIP_ADDED), F.when(F.col("focus"), FOCUS_ADDED)), lambda k: k.isNotNull()))
    rows = found.select("path", of.alias("signal"), F.btrim("content", F.lit(" \t\r\n\v\f")).alias("text"), "added", "pos", "line", "content")
    keys = ["path", "signal", "text"]
    gone = rows.where("NOT added").groupBy(*keys).agg(F.count(F.lit(1)).alias("gone"))
    new = rows.where("added").withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    return new.join(gone, keys, "left").where("n > coalesce(gone, 0)").select("path", "signal", "pos", "line", "content")


def relaxed(found: DataFrame) -> DataFrame:
    """Hunks in which exact expectations are removed and looser ones added, in balance: path, hunk, the first of each."""
    at = lambda when: F.min(F.when(when, F.struct("pos", "line", "content")))
    n = lambda what, sign: F.sum(F.when(F.col(what), F.when(F.col("added"), sign).otherwise(-sign)).otherwise(0))
    g = found.where("strict OR loose").groupBy("path", "hunk").agg(n("strict", -1).alias("exact_gone"), n("loose", 1).alias("loose_new"), at(F.col("loose") & F.col("added")).alias("first"), at(F.col("strict") & ~F.col("added")).alias("before"))
    return g.where("exact_gone > 0 AND loose_new > 0").select("path", "hunk", "first", "before")


def _first(rows: DataFrame, kinds: tuple[str, ...], order: str) -> DataFrame:
    """Of each file and kind the first rows up to its cap; the cut is made before the shuffle where it can be."""
    place = F.row_number().over(Window.partitionBy("path", "signal").orderBy(order))
    parts = [rows.where(F.col("signal") == k).withColumn("place", place).where(F.col("place") <= MOST[k]) for k in kinds]
    return reduce(DataFrame.unionByName, parts)


def signals(lines: DataFrame) -> DataFrame:
    """Signals (path, kind, severity, side, line, evidence) of changed lines of test files.

    More assertions or cases removed than added in a file; skip and focus markers
    added, but those moved; exact expectations of a hunk replaced by looser ones.
    Of a kind a file has ``MOST`` at most, and the last tells how many more.
    Lines of other files, languages without rules and context give none.

    Marked lines, few of all, are written once, since all five kinds read them.
    """
    found = Tables(lines.sparkSession).save(marked(lines))
    gone = balance(found).select(
        "path", "kind", F.lit("medium").alias("severity"), F.lit("old").alias("side"), "line",
        F.concat("removed", F.when(F.col("kind") == CASE_REMOVED, F.lit(" test cases gone, ")).otherwise(F.lit(" assertions gone, ")), F.col("added").cast("string"), F.lit(" new; the first gone is "), quoted(F.col("content"))).alias("evidence"),
    )
    new = markers(found)
    totals = new.groupBy("path", "signal").agg(F.count(F.lit(1)).alias("total"))
    most = F.when(F.col("signal") == SKIP_ADDED, MOST[SKIP_ADDED]).otherwise(MOST[FOCUS_ADDED])
    more = F.when((F.col("place") == most) & (F.col("total") > most), F.concat(F.lit(", and "), (F.col("total") - most).cast("string"), F.lit(" more in this file"))).otherwise("")
    put = _first(new, (SKIP_ADDED, FOCUS_ADDED), "pos").join(totals, ["path", "signal"]).select(
        "path", F.col("signal").alias("kind"), F.when(F.col("signal") == FOCUS_ADDED, "high").otherwise("medium").alias("severity"), F.lit("new").alias("side"), "line", F.concat(F.lit("new marker "), quoted(F.col("content")), more).alias("evidence")
    )
    weaker = _first(relaxed(found).withColumn("signal", F.lit(RELAXED)), (RELAXED,), "hunk").select(
        "path", F.col("signal").alias("kind"), F.lit("medium").alias("severity"), F.lit("new").alias("side"), "first.line", F.concat(F.lit("instead of "), quoted(F.col("before.content")), F.lit(" now "), quoted(F.col("first.content"))).alias("evidence")
    )
    return gone.unionByName(put).unionByName(weaker)
