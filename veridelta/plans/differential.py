"""Queries on coverage, observations, generated inputs and changed functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridelta.operators import core, coverage, observe
from veridelta.operators import fuzz as fuzz_ops
from veridelta.registry import query

STATES = """
WITH hit AS (SELECT d.path, d.line, max(b.count) AS most FROM diff_lines d LEFT JOIN blocks b ON b.file = d.path AND d.line BETWEEN b.start_line AND b.end_line WHERE d.kind = 'add' GROUP BY d.path, d.line),
states AS (SELECT path, line, CASE WHEN most > 0 THEN 'executed' WHEN most IS NOT NULL THEN 'not_run' WHEN path IN (SELECT file FROM blocks) THEN 'no_block' ELSE 'not_measured' END AS state FROM hit)
"""
COUNTS = "count(*) AS added, count(*) FILTER (state = 'executed') AS executed, count(*) FILTER (state = 'not_run') AS not_run, count(*) FILTER (state = 'no_block') AS no_block, count(*) FILTER (state = 'not_measured') AS not_measured"


def added(diff_lines):
    return diff_lines.where("kind = 'add'")


@query("joi1_interval_cover", STATES + "SELECT path, CAST(line AS BIGINT) AS line, state FROM states")
def _(diff_lines, blocks):
    return coverage.line_states(added(diff_lines), blocks)


@query("joi2_coverage_analysis", STATES + f"SELECT path, {COUNTS} FROM states GROUP BY path")
def _(diff_lines, blocks):
    return coverage.file_coverage(added(diff_lines), blocks)


@query("agg7_coverage_counts", STATES + f"SELECT path, {COUNTS} FROM states GROUP BY ROLLUP (path)")
def _(diff_lines, blocks):
    return coverage.total_coverage(added(diff_lines), blocks)


@query("agg8_block_sum", "SELECT file, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, CAST(max(stmts) AS BIGINT) AS stmts, CAST(sum(count) AS BIGINT) AS count FROM blocks GROUP BY ALL")
def _(blocks):
    return coverage.merged_blocks(blocks)


WIN1 = (
    STATES
    + """, runs AS (SELECT path, min(line) AS start, max(line) AS end_, count(*) AS n FROM (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS g FROM states WHERE state = 'not_run') GROUP BY path, g),
placed AS (SELECT *, least(row_number() OVER (PARTITION BY path ORDER BY start), 3) AS place FROM runs)
SELECT path, CAST(min(start) AS BIGINT) AS start, CAST(max(end_) AS BIGINT) AS "end", CAST(CASE WHEN place = 3 THEN sum(n) ELSE 0 END AS BIGINT) AS overflow FROM placed GROUP BY path, place"""
)


@query("win1_gaps_and_islands", WIN1)
def _(diff_lines, blocks):
    return coverage.unexecuted_runs(added(diff_lines), blocks)


@query("flt10_coverage_scope", "SELECT DISTINCT path, status FROM (SELECT path, CASE WHEN length(path) % 3 = 0 THEN 'D' ELSE 'M' END AS status FROM diff_lines) WHERE status <> 'D' AND path LIKE '%.go' AND path NOT LIKE '%\\_test.go' ESCAPE '\\'")
def _(diff_lines):
    return coverage.in_scope(diff_lines.select("path", F.when(F.length("path") % 3 == 0, "D").otherwise("M").alias("status")).distinct())


OBS = """
WITH g AS (SELECT test, key, count(*) FILTER (side = 'base') AS nb, count(*) FILTER (side = 'candidate') AS nc, count(*) FILTER (side = 'repeat') AS nr,
    min(value) FILTER (side = 'base') AS base, min(value) FILTER (side = 'candidate') AS candidate, min(value) FILTER (side = 'repeat') AS rep,
    bool_or(contains(value, '[REDACTED]')) AS hidden, bool_or(strlen(value) > 4096 OR contains(value, '[oversized ')) AS long FROM obs {where} GROUP BY test, key),
r AS (SELECT *, CASE WHEN key = '' OR strlen(key) > 200 OR regexp_matches(key, '\\s') THEN 'key_invalid' WHEN contains(key, '[REDACTED]') THEN 'key_redacted' WHEN nb > 1 OR nc > 1 OR nr > 1 THEN 'duplicate'
    WHEN hidden THEN 'value_redacted' WHEN long THEN 'value_too_long' WHEN nb = 0 AND nc = 0 THEN 'repeat_only' WHEN nb = 0 OR nc = 0 THEN 'one_revision'
    WHEN base = candidate THEN CASE WHEN {repeated} AND NOT (nr = 1 AND coalesce(rep = base, false)) THEN 'repeat_differs' ELSE '' END
    WHEN regexp_matches(base || ' ' || candidate, '0x[0-9a-fA-F]{{8,}}|\\.(go|ts|tsx|js|mjs|cjs|jsx|py):[0-9]+') THEN 'build_dependent'
    WHEN NOT {repeated} THEN 'awaiting_repeat' WHEN NOT (nr = 1 AND rep = base) THEN 'repeat_differs' ELSE '' END AS reason FROM g),
compared AS (SELECT test, key, CASE WHEN reason IN ('repeat_only', 'repeat_differs') THEN 'UNSTABLE' WHEN reason <> '' THEN 'INCOMPARABLE' WHEN base = candidate THEN 'EQUAL' ELSE 'DIVERGED' END AS status, reason, base, candidate, nb > 0 AS base_recorded, nc > 0 AS candidate_recorded FROM r)
"""
THREE = OBS.format(where="", repeated="true")
TWO = OBS.format(where="WHERE side <> 'repeat'", repeated="false")


@query("joi4_observation_compare", THREE + "SELECT * FROM compared")
def _(obs):
    return observe.compare(obs)


@query("joi5_key_verdict", TWO + "SELECT * FROM compared")
def _(obs):
    return observe.compare(obs, repeated=False)


OUTCOME = """, o AS (SELECT test, count(*) AS keys, count(*) FILTER (status = 'DIVERGED') AS diverged, count(*) FILTER (status = 'EQUAL') AS equal, count(*) FILTER (status = 'UNSTABLE') AS unstable, count(*) FILTER (status = 'INCOMPARABLE') AS incomparable, count(*) FILTER (reason = 'awaiting_repeat') AS pending FROM compared GROUP BY test)
"""


@query("agg10_observation_outcome", TWO + OUTCOME + "SELECT * EXCLUDE (pending), CASE WHEN pending > 0 THEN 'NEEDS_REPEAT' WHEN diverged > 0 THEN 'DIVERGED' WHEN equal = keys THEN 'NOT_DIVERGED' ELSE 'UNVERIFIED' END AS status FROM o")
def _(obs):
    return observe.outcome(observe.compare(obs, repeated=False))


@query("agg11_observation_summary", THREE + "SELECT status, count(*) AS n FROM compared GROUP BY status")
def _(obs):
    return observe.compare(obs).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "set8_presence_difference",
    "WITH g AS (SELECT test, key, count(DISTINCT side) AS s, count(DISTINCT value) AS v, bool_or(contains(key, '[REDACTED]') OR contains(value, '[REDACTED]')) AS h FROM obs WHERE side <> 'repeat' GROUP BY test, key) SELECT test, bool_or(s < 2 OR v > 1 OR h) AS differs FROM g GROUP BY test",
)
def _(obs):
    return observe.differ(obs)


@query("flt11_value_validity", "SELECT value, CASE WHEN contains(value, '[REDACTED]') THEN 'value_redacted' WHEN strlen(value) > 4096 OR contains(value, '[oversized ') THEN 'value_too_long' ELSE '' END AS problem FROM (SELECT DISTINCT value FROM obs UNION ALL SELECT text FROM documents)")
def _(obs, documents):
    values = obs.select("value").distinct().unionAll(documents.select("text"))
    return values.select("value", observe.value_problem(F.col("value")).alias("problem"))


@query("flt12_key_validity", "SELECT DISTINCT key, CASE WHEN key = '' OR strlen(key) > 200 OR regexp_matches(key, '\\s') THEN 'key_invalid' WHEN contains(key, '[REDACTED]') THEN 'key_redacted' ELSE '' END AS problem FROM obs")
def _(obs):
    return obs.select("key", observe.key_problem(F.col("key")).alias("problem")).distinct()


@query("flt13_build_dependent", "SELECT DISTINCT value, regexp_matches(value, '0x[0-9a-fA-F]{8,}|\\.(go|ts|tsx|js|mjs|cjs|jsx|py):[0-9]+') AS build_dependent FROM obs")
def _(obs):
    return obs.select("value", observe.build_dependent(F.col("value")).alias("build_dependent")).distinct()


FUZZ = """
WITH spine AS (SELECT DISTINCT test, unnest(range(planned)) AS i FROM fuzz),
w AS (SELECT s.test, s.i, b.hash AS bh, b.length AS bl, b.unstable AS bu, b.call AS call, b.display AS bd, c.hash AS ch, c.length AS cl, c.unstable AS cu, c.display AS cd, b2.hash AS bh2, b2.length AS bl2, b2.unstable AS bu2, c2.hash AS ch2, c2.length AS cl2, c2.unstable AS cu2
    FROM spine s LEFT JOIN (FROM fuzz WHERE side = 'base1') b USING (test, i) LEFT JOIN (FROM fuzz WHERE side = 'cand1') c USING (test, i) LEFT JOIN (FROM fuzz WHERE side = 'base2') b2 USING (test, i) LEFT JOIN (FROM fuzz WHERE side = 'cand2') c2 USING (test, i)),
k AS (SELECT *, CASE WHEN bh IS NULL OR ch IS NULL THEN 'not_recorded' WHEN bu THEN 'unstable' WHEN cu THEN 'separating' WHEN bh = ch AND bl = cl THEN 'equal' WHEN bh2 IS NULL OR ch2 IS NULL THEN 'unconfirmed'
    WHEN bu2 OR cu2 OR bh2 <> bh OR bl2 <> bl OR ch2 <> ch OR cl2 <> cl THEN 'separating' ELSE 'diverged' END AS state FROM w)
"""


@query(
    "joi6_fuzz_evaluate",
    FUZZ
    + """, e AS (SELECT test, count(*) AS planned, count(*) FILTER (state IN ('equal', 'diverged')) AS compared, count(*) FILTER (state IN ('unstable', 'separating')) AS unstable, count(*) FILTER (state = 'unconfirmed') AS unconfirmed, count(*) FILTER (state = 'not_recorded') AS not_recorded, count(*) FILTER (state = 'diverged') AS diverged, count(*) FILTER (state = 'separating') AS separating FROM k GROUP BY test)
SELECT *, CASE WHEN diverged > 0 THEN 'diverged' WHEN unconfirmed = 0 AND compared > 0 AND separating = 0 AND not_recorded = 0 THEN 'not_diverged' ELSE 'inconclusive' END AS outcome FROM e""",
)
def _(fuzz):
    return fuzz_ops.evaluate(fuzz)


@query("joi7_fuzz_consistent", "SELECT test, max(n) = 1 AS consistent FROM (SELECT test, i, count(DISTINCT call) AS n FROM fuzz GROUP BY test, i) GROUP BY test")
def _(fuzz):
    return fuzz_ops.consistent(fuzz)


@query("srt10_counterexample", FUZZ + "SELECT test, i, call AS input, bd AS base, cd AS candidate FROM (SELECT *, row_number() OVER (PARTITION BY test ORDER BY bd = cd, strlen(call), i) AS n FROM k WHERE state = 'diverged') WHERE n = 1")
def _(fuzz):
    return fuzz_ops.counterexample(fuzz)


TARGETS = "SELECT concat('src/f', CAST(c_custkey % 200 AS string), '.go') AS path, concat('src', CAST(c_custkey % 20 AS string)) AS dir, c_name AS name, CAST(1 + c_custkey % 50 AS BIGINT) AS line, CAST(4 + c_custkey % 50 AS BIGINT) AS end_line, c_nationkey % 2 = 0 AS exported FROM customer"
RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
PRIORITY = f"WITH t AS ({TARGETS}), p AS (SELECT t.*, CAST(coalesce((SELECT max({RANK}) FROM signals s WHERE s.path = t.path AND s.side = 'new' AND s.line <= t.end_line AND greatest(s.line, s.end_line) >= t.line), 0) AS BIGINT) AS priority FROM t)"


def targets(customer):
    k = F.col("c_custkey")
    return customer.select(
        F.concat(F.lit("src/f"), (k % 200).cast("string"), F.lit(".go")).alias("path"), F.concat(F.lit("src"), (k % 20).cast("string")).alias("dir"), F.col("c_name").alias("name"),
        (1 + k % 50).alias("line"), (4 + k % 50).alias("end_line"), (F.col("c_nationkey") % 2 == 0).alias("exported"),
    )


@query("joi40_signal_overlap", PRIORITY + "SELECT * FROM p")
def _(customer, signals):
    return fuzz_ops.priority(targets(customer), signals)


@query(
    "srt11_fuzz_budget",
    PRIORITY
    + """, o AS (SELECT *, row_number() OVER (ORDER BY priority DESC, exported DESC, path, line, name) AS pos FROM p), d AS (SELECT dir, row_number() OVER (ORDER BY min(pos)) AS place FROM o GROUP BY dir),
m AS (SELECT o.*, place <= 5 AS chosen FROM o JOIN d USING (dir)), f AS (SELECT *, sum(CASE WHEN chosen THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS n FROM m)
SELECT dir, path, line, name, CASE WHEN NOT chosen THEN 'package_budget' WHEN n > 30 THEN 'function_budget' ELSE 'planned' END AS decision FROM f""",
)
def _(customer, signals):
    return fuzz_ops.budget(fuzz_ops.priority(targets(customer), signals), 5, 30)


MULTISET = """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY key, sig, body ORDER BY id) AS n FROM fn_head), b AS (SELECT *, row_number() OVER (PARTITION BY key, sig, body ORDER BY id) AS n FROM fn_base)
SELECT key, sig, body, id, CASE WHEN EXISTS (FROM fn_base x WHERE x.key = a.key AND x.sig = a.sig) THEN 'body_changed' ELSE 'signature_changed' END AS change
FROM a WHERE key IN (SELECT key FROM fn_base) AND NOT EXISTS (FROM b WHERE b.key = a.key AND b.sig = a.sig AND b.body = a.body AND b.n = a.n)"""


@query("joi8_function_diff", MULTISET)
def _(fn_base, fn_head):
    return fuzz_ops.changed_functions(fn_base, fn_head)


@query("set6_multiset_difference", "SELECT key, sig, body FROM fn_head EXCEPT ALL SELECT key, sig, body FROM fn_base")
def _(fn_base, fn_head):
    return core.surplus(fn_head, fn_base, ["key", "sig", "body"])


