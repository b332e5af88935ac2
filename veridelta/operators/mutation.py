"""Test logs: outcomes of tests, verdicts on mutants, and what to run."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENDS = ("pass", "fail", "skip")


def tests(log: DataFrame) -> DataFrame:
    """One row for each test of a log: runs, ends, the last end, where they begin, and packages; one pass over the log."""
    run, end = F.col("action") == "run", F.col("action").isin(*ENDS)
    return log.groupBy("log_id", "test").agg(
        F.count_if(run).alias("runs"), F.count_if(end).alias("ends"), F.min(F.when(run, F.col("pos"))).alias("first_run"), F.min(F.when(end, F.col("pos"))).alias("first_end"),
        F.max_by(F.when(end, F.col("action")), F.when(end, F.col("pos"))).alias("last"), F.countDistinct("package").alias("packages"),
    )


def logs(log: DataFrame) -> DataFrame:
    """Counts of each log, and whether any test ran in several packages."""
    return tests(log).groupBy("log_id").agg(F.count(F.lit(1)).alias("tests"), F.sum("runs").alias("runs"), F.sum("ends").alias("ends"), F.bool_or(F.col("packages") > 1).alias("conflict"))


def named_outcomes(log: DataFrame) -> DataFrame:
    """The outcome of tests that ran once and then ended once, in one package."""
    ok = tests(log).where("runs = 1 AND ends = 1 AND first_run < first_end AND packages = 1")
    return ok.select("log_id", "test", F.col("last").alias("action"))


def control(runs: DataFrame) -> DataFrame:
    """Why a run can't serve as the control, or an empty text: it has to pass, whole and readable, with a test passed, none failed, in one package."""
    problem = (
        F.when(F.col("status") != "PASS", "not_passed").when(F.col("exit_code") != 0, "exit_code").when(F.col("truncated"), "truncated").when(~F.col("readable"), "unreadable")
        .when(F.col("load_failures") > 0, "load_failure").when(F.col("passed") < 1, "no_pass").when(F.col("failed") > 0, "failed").when(F.col("packages") > 1, "packages").otherwise("")
    )
    return runs.select("id", problem.alias("problem"))


def classify(runs: DataFrame, command: str, script: bool = False) -> DataFrame:
    """The status of each run of a mutant against a control that ran ``command``.

    The rules are tried in order; the first that holds decides. A log in lines
    (not ``script``) proves a build failure by itself; a script's report does so
    only where no test failed. A kill needs a failed test and an exit code from
    1 to 124, a survival a passed test, none failed and exit code 0.
    """
    kill = (F.col("status") == "FAIL") & F.col("exit_code").between(1, 124) & (F.col("failed") > 0)
    survive = (F.col("status") == "PASS") & (F.col("exit_code") == 0) & (F.col("failed") == 0) & (F.col("passed") > 0)
    broken = (F.col("load_failures") > 0) & ((F.col("failed") == 0) if script else F.lit(True))
    status = (
        F.when(F.col("kind") != "mutant", "INCONCLUSIVE").when(F.col("command") != command, "INCONCLUSIVE").when(F.col("status") == "SKIPPED", "NOT_RUN").when(F.col("status") == "TIMEOUT", "TIMEOUT")
        .when(F.col("status") == "ERROR", "INCONCLUSIVE").when(F.col("truncated") | ~F.col("readable"), "INCONCLUSIVE").when(broken, "INVALID")
        .when(F.lit(not script) & (F.col("packages") > 1), "INCONCLUSIVE").when(kill, "KILLED").when(survive, "SURVIVED").otherwise("INCONCLUSIVE")
    )
    return runs.select("id", F.col("status").alias("run"), status.alias("status"))


def evidence_status(evidence: DataFrame, checks: DataFrame, replays: bool) -> DataFrame:
    """The status that evidence of one test on two revisions keeps, or an empty text.

    Both checks have to be cited by ids that occur once, of the right kinds, the
    candidate not replayed. A failure needs a base that ran; a pass one that ran
    or, with ``replays``, one replayed from two agreeing runs.
    """
    once = checks.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("kind", "replayed", "agreeing"), "kind").alias("c")).where("n = 1").select("id", "c.*")
    side = lambda p: once.select(F.col("id").alias(f"{p}_check"), F.col("kind").alias(f"{p}_kind"), F.col("replayed").alias(f"{p}_replayed"), F.col("agreeing").alias(f"{p}_agreeing"))
    j = evidence.join(side("base"), "base_check", "left").join(side("candidate"), "candidate_check", "left")
    ok = (F.col("names") == 1) & (F.col("base_kind") == "base") & (F.col("candidate_kind") == "candidate") & ~F.col("candidate_replayed")
    ran = ~F.col("base_replayed")
    known = ran | (F.col("base_agreeing") >= 2) if replays else ran
    status = F.when(ok & (F.col("verdict") == "FAILS") & ran, "FAILS").when(ok & (F.col("verdict") == "PASSES") & known, "PASSES").otherwise("")
    return j.select("id", status.alias("status"))


def recount(verdicts: DataFrame) -> DataFrame:
    """Numbers of mutants by status, a column each."""
    names = ("KILLED", "SURVIVED", "INVALID", "TIMEOUT", "INCONCLUSIVE", "NOT_RUN")
    return verdicts.groupBy("run").agg(*(F.count_if(F.col("status") == n).alias(n.lower()) for n in names))


def verified(verdicts: DataFrame) -> DataFrame:
    """Stored verdicts that a second classification confirms; a kill or survival it doesn't confirm is inconclusive."""
    wrong = F.col("stored").isin("KILLED", "SURVIVED") & (F.col("stored") != F.col("status"))
    return verdicts.select("id", F.when(wrong, "INCONCLUSIVE").otherwise(F.col("stored")).alias("status"))


def verdicts(log: DataFrame, base: str) -> DataFrame:
    """FAILS, PASSES or UNVERIFIED of each test, given that it passed in the base log, in one package."""
    n = tests(log).where("runs >= 1").select("log_id", "test", "last", "packages")
    b = n.where(F.col("log_id") == base).select("test", F.col("last").alias("b_last"), F.col("packages").alias("b_packages"))
    bad = F.col("b_last").isNull() | (F.col("b_last") != "pass") | (F.col("packages") > 1) | (F.col("b_packages") > 1)
    return n.join(b, "test", "left").select("log_id", "test", F.when(bad, "UNVERIFIED").when(F.col("last") == "fail", "FAILS").when(F.col("last") == "pass", "PASSES").otherwise("UNVERIFIED").alias("verdict"))


def round_robin(sites: DataFrame, most: int) -> DataFrame:
    """The first ``most`` sites, dealt over lines, then files: first of each line first."""
    d = sites.withColumn("li", F.dense_rank().over(Window.partitionBy("file").orderBy("line"))).withColumn("depth", F.row_number().over(Window.partitionBy("file", "line").orderBy("op")))
    return d.orderBy("depth", "li", "file").limit(most).select("file", "line", "op")


def splitmix64(seed: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` numbers of the splitmix64 generator from each seed."""
    state = seed[:, None] + np.arange(1, n + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    z = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: The first inputs of plain types, as a call writes them.
EDGES = {"int": ("0", "1", "-1", "2147483647", "-2147483648"), "bool": ("false", "true"), "string": ('""', '"a"', '" "', '"0"', '"\\n"')}
#: Sizes of whole numbers and floats in bits, and the first floats.
_SIZED = re.compile(r"(u?int|float)(8|16|32|64)")
_FLOATS = (0.0, -0.0, 1.0, -1.0, 0.5, math.inf, -math.inf, math.nan)
#: Prefixes of lists and of rest parameters; lists of a fixed length have it between the brackets.
_MANY = re.compile(r"(\[\d*\]|\.\.\.)(.+)")
#: Random lists have fewer items than this.
_ITEMS = 9


def _bits(value: float, bits: int) -> int:
    return int.from_bytes(struct.pack(">d" if bits == 64 else ">f", value), "big")


def _float(pattern: int, bits: int) -> str:
    """A float by its bits, so that each has one way to be written."""
    return f"float{bits}frombits(0x{pattern:0{bits // 4}x})"


def _listed(form: str, kind: str, items: list[str]) -> str:
    return ", ".join(items) if form == "..." else f"{form}{kind}{{{', '.join(items)}}}"


@lru_cache(256)
def edges(kind: str) -> tuple[str, ...]:
    """The first inputs of a type, simplest first; a type that isn't known fails.

    Whole numbers have zero, one and their bounds; floats are bit patterns, both
    zeros, infinities and a NaN among them. Lists are none, empty, one item, two
    in falling order, then each other item alone; those of a fixed length are
    filled with one item; rest parameters have no item at first.
    """
    if kind in EDGES:
        return EDGES[kind]
    if m := _MANY.fullmatch(kind):
        form, own = m[1], edges(m[2])
        if form[1:-1].isdigit():
            return tuple(_listed(form, m[2], [e] * int(form[1:-1])) for e in own) if int(form[1:-1]) else (_listed(form, m[2], []),)
        few = [[], [own[0]], [own[1], own[0]], *([e] for e in own[1:])]
        return (f"{form}{m[2]}(nil)",) * (form == "[]") + tuple(_listed(form, m[2], x) for x in few)
    m = _SIZED.fullmatch(kind)
    if not m or m[1] == "float" and int(m[2]) < 32:
        raise ValueError(f"no inputs of type {kind}")
    bits = int(m[2])
    if m[1] == "float":
        return tuple(_float(_bits(v, bits), bits) for v in _FLOATS)
    if m[1] == "uint":
        return ("0", "1", str((1 << bits) - 1), str((1 << bits) - 2))
    return ("0", "1", "-1", str((1 << (bits - 1)) - 1), str(-(1 << (bits - 1))))


def _written(kind: str, z: int) -> str:
    """A number as an input of a type: ``int`` from -1000 to 1000, texts of eight hexadecimal digits, sized numbers and floats by its upper bits; of a list it seeds the length and the items."""
    if kind in EDGES:
        return str(z % 2001 - 1000) if kind == "int" else EDGES["bool"][z & 1] if kind == "bool" else f'"{z:016x}"'[:9] + '"'
    if m := _MANY.fullmatch(kind):
        fixed = m[1][1:-1]
        more = splitmix64(np.array([z], np.uint64), 1 + (int(fixed) if fixed.isdigit() else _ITEMS))[0].tolist()
        return _listed(m[1], m[2], [_written(m[2], x) for x in more[1 : 1 + (int(fixed) if fixed.isdigit() else more[0] % _ITEMS)]])
    m = _SIZED.fullmatch(kind)
    bits = int(m[2])
    z >>= 64 - bits
    return _float(z, bits) if m[1] == "float" else str(z - (1 << bits) * (m[1] == "int" and z >> (bits - 1)))


def calls_of(target: str, types: list[str], n: int) -> list[str]:
    """The first ``n`` inputs of a target, as ``corpus`` has them."""
    joined = lambda c: ", ".join(x for x in c if x)  # a rest parameter may be nothing
    calls = dict.fromkeys(joined(c) for c in itertools.islice(itertools.product(*map(edges, types)), n))
    if types and len(calls) < n:
        seed = np.frombuffer(hashlib.sha256(target.encode()).digest()[:8], ">u8").astype(np.uint64)
        z = splitmix64(seed, 8 * n * len(types))[0].tolist()
        for k in range(0, len(z), len(types)):
            calls[joined(map(_written, types, z[k : k + len(types)]))] = None
            if len(calls) == n:
                break
    return list(calls)


def corpus(targets: DataFrame, n: int) -> DataFrame:
    """``n`` distinct calls (target, i, call) of each target (target, types): combinations of edge values first, the last parameter's first, then random rows.

    Types are ``int``, ``bool``, ``string``, sized ``int8`` to ``uint64``,
    ``float32`` and ``float64``, and of each of these lists (``[]int``), lists of
    a length (``[3]int``) and rest parameters (``...int``). Random numbers follow
    from the target's name only: its SHA-256's first eight bytes seed them, a
    number a parameter; so the first calls don't depend on how many are asked
    for. A target without parameters has one call, and one whose types have few
    values as many as are met in 8 n rows; a type that isn't known fails.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(target, i, f"{target}({c})") for target, types in zip(b["target"], b["types"], strict=True) for i, c in enumerate(calls_of(target, list(types), n))]
            yield pd.DataFrame(rows, columns=["target", "i", "call"])

    return targets.select("target", "types").mapInPandas(run, "target string, i int, call string")


def execution_order(sites: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` sites in the order in which they are run."""
    return sites.select(*order).orderBy(*order).limit(most)


def fuzz_status(evidence: DataFrame, citations: DataFrame, checks: DataFrame) -> DataFrame:
    """The status that evidence of generated inputs keeps: cited by exactly one claim, its id unique, its checks complete, all of them passed or failed, none or two for a confirmation."""
    cited = citations.groupBy(F.col("evidence_id").alias("id")).agg(F.countDistinct("claim_id").alias("_cited"))
    once = evidence.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("kind", "verified"), "ord").alias("r"))
    run = checks.groupBy(F.col("evidence_id").alias("id")).agg(F.count(F.lit(1)).alias("_checks"), F.bool_and(F.col("status").isin("PASS", "FAIL")).alias("_resolved"))
    j = once.join(cited, "id", "left").join(run, "id", "left")
    ok = (F.col("_cited") == 1) & (F.col("_n") == 1) & (F.col("r.kind") == "fuzz") & F.coalesce("_resolved", F.lit(True)) & F.coalesce("_checks", F.lit(0)).isin(0, 1, 2)
    return j.select("id", F.when(ok, F.col("r.verified")).otherwise("UNVERIFIED").alias("status"))
