"""Domain tables derived from the provided ones.

The provided tables hold no changes, runs or graphs, so carriers stand in for
them. Each is one SELECT that both Spark and DuckDB read the same way; names in
braces are provided tables, other names are carriers. The derived rows are not
real code review data and are not presented as such.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CARRIERS: dict[str, str] = {
    # Changed lines: a file per order, unique lines.
    "diff_lines": """
        SELECT concat(CASE l_orderkey % 5 WHEN 0 THEN 'docs/d' WHEN 1 THEN 'test/t' ELSE 'src/f' END, CAST(l_orderkey AS string), CASE l_orderkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.go' END) AS path,
               l_linenumber AS line, CASE min(l_returnflag) WHEN 'A' THEN 'add' WHEN 'R' THEN 'delete' ELSE 'context' END AS kind,
               concat(CASE CAST(floor(sum(l_quantity)) AS int) % 4 WHEN 0 THEN 'if x == ' WHEN 1 THEN 'assert y < ' WHEN 2 THEN 'for z in ' ELSE 'return ' END, CAST(CAST(floor(sum(l_quantity)) AS int) % 10 AS string)) AS content
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    # Coverage blocks: windows of lines with a count; some files have none, some blocks repeat.
    "blocks": """
        SELECT concat(CASE l_orderkey % 5 WHEN 0 THEN 'docs/d' WHEN 1 THEN 'test/t' ELSE 'src/f' END, CAST(l_orderkey AS string), CASE l_orderkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.go' END) AS file,
               l_linenumber AS start_line, l_linenumber + CAST(l_suppkey % 3 AS int) AS end_line, 1 + CAST(l_partkey % 4 AS int) AS stmts, CAST(floor(l_quantity) AS int) % 3 AS count
        FROM {lineitem} WHERE l_orderkey % 6 <> 0""",
    # Observations of three runs.
    "obs": """
        SELECT side, concat('Test', CAST(l_orderkey % 50 AS string)) AS test, concat(CASE WHEN l_orderkey % 97 = 0 THEN 'bad ' ELSE 'k' END, CAST(l_orderkey AS string), '.', CAST(l_linenumber AS string)) AS key,
               concat(CASE WHEN l_orderkey % 29 = 0 THEN 'at 0x0000abcd' WHEN l_orderkey % 31 = 0 THEN 'main.go:1' WHEN l_orderkey % 37 = 0 THEN '[REDACTED]' ELSE 'v' END,
                      CAST(CAST(floor(l_quantity) AS int) + CASE WHEN side = 'candidate' AND l_orderkey % 7 = 0 THEN 100 WHEN side = 'repeat' AND l_orderkey % 11 = 0 THEN 200 ELSE 0 END AS string)) AS value
        FROM {lineitem} CROSS JOIN (SELECT 'base' AS side UNION ALL SELECT 'candidate' UNION ALL SELECT 'repeat') s
        WHERE NOT (side = 'base' AND l_orderkey % 17 = 0) AND NOT (side = 'candidate' AND l_orderkey % 13 = 0) AND NOT (side = 'repeat' AND l_orderkey % 19 = 0)""",
    # Streams of four runs of generated inputs.
    "fuzz": """
        SELECT side, test, i, planned, call, hash, length, display, unstable FROM (
            SELECT side, concat('Fuzz', CAST(l_orderkey AS string)) AS test, l_linenumber - 1 AS i, 7 AS planned, concat('f(', repeat('1', 1 + CAST(min(l_partkey) % 5 AS int)), ')') AS call,
                   concat('h', CAST(CAST(floor(min(l_quantity)) AS int) + CASE WHEN side IN ('cand1', 'cand2') AND l_orderkey % 7 = 0 THEN 1 WHEN side = 'cand2' AND l_orderkey % 11 = 0 THEN 2 WHEN side = 'cand1' AND l_orderkey % 5 = 0 THEN 3 ELSE 0 END AS string)) AS hash,
                   CAST(min(l_suppkey) % 9 AS int) AS length,
                   concat('d', CAST(CASE WHEN side IN ('cand1', 'cand2') AND min(l_partkey) % 3 = 0 THEN 1 ELSE 0 END AS string)) AS display,
                   (min(l_suppkey) % 23 = 0 AND side = 'cand1') OR min(l_suppkey) % 41 = 0 AS unstable, l_orderkey
            FROM {lineitem} CROSS JOIN (SELECT 'base1' AS side UNION ALL SELECT 'cand1' UNION ALL SELECT 'base2' UNION ALL SELECT 'cand2') s
            GROUP BY side, l_orderkey, l_linenumber) r
        WHERE NOT (side = 'base1' AND l_orderkey % 43 = 0) AND NOT (side IN ('base2', 'cand2') AND l_orderkey % 3 = 0)""",
    # Function variants before and after.
    "fn_base": """
        SELECT concat(p_brand, '/', p_type) AS key, concat('sig', CAST(p_size % 5 AS string)) AS sig, concat('body', CAST(p_size AS string)) AS body, p_partkey AS id FROM {part} WHERE p_partkey % 11 <> 0""",
    "fn_head": """
        SELECT concat(p_brand, '/', p_type) AS key, concat('sig', CAST(CASE WHEN p_partkey % 9 = 0 THEN 9 ELSE p_size % 5 END AS string)) AS sig, concat('body', CAST(CASE WHEN p_partkey % 7 = 0 THEN p_size + 100 ELSE p_size END AS string)) AS body, p_partkey AS id FROM {part}""",
    # Signals: facts about ranges of lines of files.
    "signals": """
        SELECT concat('s', CAST(o_orderkey AS string)) AS id, CASE o_orderkey % 6 WHEN 0 THEN 'secret' WHEN 1 THEN 'test_removed' WHEN 2 THEN 'dependency' WHEN 3 THEN 'large_change' WHEN 4 THEN 'coverage' ELSE 'critical_path' END AS kind,
               concat('src/f', CAST(o_custkey % 200 AS string), '.go') AS path, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 + o_orderkey % 60 END AS int) AS line,
               CAST(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 + o_orderkey % 60 + o_custkey % 4 END AS int) AS end_line, CASE WHEN o_orderkey % 4 = 0 THEN 'old' ELSE 'new' END AS side,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'unknown' ELSE 'low' END AS severity,
               concat('found ', CAST(o_orderkey % 6 AS string)) AS summary, CAST(o_orderkey AS bigint) AS ord
        FROM {orders}""",
    # Alerts, ranked: the least rank is the first.
    "alerts": """
        SELECT id, path, side, line, end_line, kind IN ('secret') AS issue, severity, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END * CAST(100000000000 AS bigint) + ord AS rank
        FROM signals WHERE line > 0""",
    # Claims, what they cite, evidence (some ids twice) and checks.
    "claims": """
        SELECT concat('h', CAST(o_orderkey AS string)) AS id, CASE o_orderkey % 5 WHEN 0 THEN 'REPRODUCED' WHEN 1 THEN 'DIVERGED' WHEN 2 THEN 'UNVERIFIED' WHEN 3 THEN 'DISMISSED' ELSE 'NOT_REPRODUCED' END AS status,
               concat('src/f', CAST(o_custkey % 200 AS string), '.go') AS path, CAST(1 + o_orderkey % 60 AS int) AS line, CASE o_orderkey % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'medium' END AS severity,
               concat(CASE WHEN o_orderkey % 2 = 0 THEN 'Wrong  total ' ELSE 'wrong Total ' END, CAST(o_custkey % 9 AS string)) AS title, concat('agent', CAST(o_orderkey % 4 AS string)) AS agent, CAST(o_orderkey AS bigint) AS ord
        FROM {orders} WHERE o_orderkey % 8 = 0""",
    "citations": """
        SELECT concat('h', CAST(o_orderkey AS string)) AS claim_id, pos, concat('e', CAST(o_custkey + pos * 7 AS string)) AS evidence_id FROM {orders} CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2) p WHERE o_orderkey % 8 = 0 AND (o_orderkey + pos) % 4 <> 0""",
    "evidence": """
        SELECT concat('e', CAST(c_custkey - CASE WHEN c_custkey % 31 = 0 THEN 1 ELSE 0 END AS string)) AS id, CASE c_custkey % 3 WHEN 0 THEN 'base_test' WHEN 1 THEN 'observation' ELSE 'fuzz' END AS kind, CASE c_custkey % 4 WHEN 0 THEN 'REPRODUCED' WHEN 1 THEN 'DIVERGED' WHEN 2 THEN 'NOT_REPRODUCED' ELSE 'UNVERIFIED' END AS verified, c_custkey AS ord
        FROM {customer}""",
    "checks": """
        SELECT concat('k', CAST(s_suppkey AS string)) AS id, CASE s_suppkey % 3 WHEN 0 THEN 'lint' WHEN 1 THEN 'test' ELSE 'build' END AS kind, CASE s_suppkey % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'TIMEOUT' ELSE 'PASS' END AS status,
               CAST(CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 17 = 0 THEN 1 ELSE 0 END AS int) AS exit_code, concat('e', CAST(s_suppkey AS string)) AS evidence_id
        FROM {supplier}""",
    "assessments": """
        SELECT concat('s', CAST(o_orderkey - o_orderkey % 3 AS string)) AS signal_id, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE concat('title ', CAST(o_orderkey AS string)) END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'no_risk' ELSE 'risk' END AS judgment, CAST(o_orderkey AS bigint) AS ord
        FROM {orders} WHERE o_orderkey % 5 < 3""",
    # Runs of repositories, from events.
    "runs": """
        SELECT concat('u', CAST(user_id % 10 AS string)) AS user_key, concat('r', CAST(user_id AS string)) AS repo_key, concat('c', CAST(event_id % 3000 AS string)) AS commit, event_id AS seq,
               CASE WHEN event_id % 20 = 0 THEN 'plan' ELSE '' END AS variant, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' ELSE 'done' END AS status,
               ts AS queued_at, CASE WHEN event_type IN ('error', 'purchase', 'signup') AND event_id % 15 <> 0 THEN ts END AS finished_at, CAST(floor(value) AS bigint) AS size,
               CAST(event_id % 3 AS int) AS low, CAST(event_id % 4 AS int) AS medium, CAST(event_id % 5 AS int) AS high, CAST(event_id % 2 AS int) AS critical
        FROM {events}""",
    # Lines of test logs.
    "test_log": """
        SELECT concat('log', CAST(user_id AS string)) AS log_id, event_id AS pos, CASE event_type WHEN 'view' THEN 'run' WHEN 'purchase' THEN 'pass' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'skip' ELSE 'output' END AS action,
               concat('pkg', CAST(CASE WHEN event_id % 101 = 0 THEN 1 ELSE 0 END AS string)) AS package, concat('Test', CAST(event_id % 40 AS string)) AS test
        FROM {events}""",
    # Recorded runs of tests against mutants, with what their logs say.
    "mutant_runs": """
        SELECT event_id AS id, CASE WHEN event_id % 29 = 0 THEN 'control' ELSE 'mutant' END AS kind, concat('cmd', CAST(CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS string)) AS command,
               CASE event_type WHEN 'view' THEN 'PASS' WHEN 'purchase' THEN 'PASS' WHEN 'error' THEN 'FAIL' WHEN 'click' THEN 'FAIL' ELSE CASE event_id % 3 WHEN 0 THEN 'SKIPPED' WHEN 1 THEN 'TIMEOUT' ELSE 'ERROR' END END AS status,
               CAST(CASE WHEN event_type IN ('error', 'click') THEN 1 + event_id % 126 ELSE 0 END AS int) AS exit_code, event_id % 37 = 0 AS truncated, event_id % 41 <> 0 AS readable, CAST(event_id % 3 AS int) AS passed,
               CAST(CASE WHEN event_type IN ('error', 'click') THEN event_id % 4 ELSE 0 END AS int) AS failed, CAST(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS int) AS load_failures, CAST(1 + CASE WHEN event_id % 43 = 0 THEN 1 ELSE 0 END AS int) AS packages
        FROM {events}""",
    # Evidence of one test run on two revisions.
    "test_evidence": """
        SELECT event_id AS id, CAST(1 + CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS int) AS names, concat('k', CAST(event_id AS string)) AS base_check, concat('k', CAST(event_id + 451 AS string)) AS candidate_check,
               CASE event_id % 3 WHEN 0 THEN 'FAILS' WHEN 1 THEN 'PASSES' ELSE 'UNVERIFIED' END AS verdict
        FROM {events}""",
    "test_checks": """
        SELECT concat('k', CAST(event_id - CASE WHEN event_id % 37 = 0 THEN 2 ELSE 0 END AS string)) AS id, CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'candidate' END AS kind, event_id % 5 = 0 AS replayed, CAST(event_id % 3 AS int) AS agreeing FROM {events}""",
    # Votes and comments on alerts.
    "feedback": """
        SELECT event_id AS seq, concat('c', CAST(user_id % 20 AS string)) AS commit, concat('a', CAST(event_id % 30 AS string)) AS alert_id, concat('t', CAST(event_id % 7 AS string)) AS topic,
               CASE event_type WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' WHEN 'signup' THEN '' ELSE 'up' END AS vote, CASE WHEN event_id % 4 = 0 THEN concat('note ', CAST(event_id AS string)) ELSE ' ' END AS comment, concat('p', CAST(user_id AS string)) AS author, ts AS at
        FROM {events}""",
    # A property graph.
    "nodes": """
        SELECT concat('component:', r_name) AS id, 'component' AS kind, r_name AS name, '' AS path, false AS test FROM {region}
        UNION ALL SELECT concat('package:', n_name), 'package', n_name, concat('pkg/', n_name), false FROM {nation}
        UNION ALL SELECT concat('file:', c_name), 'file', c_name, concat('pkg/', CAST(c_nationkey AS string), '/', c_name, CASE WHEN c_custkey % 9 = 0 THEN '_test.go' ELSE '.go' END), c_custkey % 9 = 0 FROM {customer}
        UNION ALL SELECT concat('function:', s_name), 'function', concat('pkg.', s_name), concat('fn/', s_name, '.go'), s_suppkey % 8 = 0 FROM {supplier}
        UNION ALL SELECT concat('dependency:', CAST(p_partkey AS string)), 'dependency', p_name, '', false FROM {part} WHERE p_partkey % 20 = 0""",
    # Edge sites, with repeats, self-loops and ends that aren't nodes.
    "edge_sites": """
        SELECT concat('component:', r_name) AS src, concat('package:', n_name) AS dst, 'contains' AS kind, '' AS path, 0 AS line, CAST(n_nationkey AS bigint) AS seq FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
        UNION ALL SELECT concat('package:', n_name), concat('file:', c_name), 'contains', '', 0, c_custkey FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        UNION ALL SELECT concat('function:', a.s_name), concat('function:', b.s_name), 'calls', concat('fn/', a.s_name, '.go'), l_linenumber, l_orderkey * 10 + l_linenumber
                  FROM {lineitem} JOIN {supplier} a ON l_suppkey = a.s_suppkey JOIN {supplier} b ON l_partkey % 70 = b.s_suppkey
        UNION ALL SELECT concat('file:', c_name), concat('dependency:', CAST(c_custkey AS string)), 'imports', c_name, 1, c_custkey FROM {customer} WHERE c_custkey % 10 = 0""",
    "edges": """
        SELECT src, dst, kind, count(*) AS sites FROM edge_sites WHERE src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY src, dst, kind""",
    "calls": """SELECT src, dst, sites FROM edges WHERE kind = 'calls'""",
    # Methods of types and of interfaces; both are functions of the graph.
    "type_methods": """
        SELECT concat('T', CAST(CAST(floor(s_suppkey / 5) AS int) AS string)) AS type, concat('m', CAST(s_suppkey * 7 % 11 AS string)) AS method, concat('function:', s_name) AS id FROM {supplier} WHERE s_suppkey % 10 <> 3""",
    "interface_methods": """
        SELECT concat('I', CAST(CAST(floor(s_suppkey / 20) AS int) AS string)) AS interface, concat('m', CAST(s_suppkey * 7 % 11 AS string)) AS method, concat('function:', s_name) AS id FROM {supplier} WHERE s_suppkey % 10 = 3""",
    "edges_base": """
        SELECT DISTINCT concat('customer:', CAST(o_custkey AS string)) AS src, concat('priority:', o_orderpriority) AS dst, CASE WHEN o_custkey % 2 = 0 THEN 'depends_on' ELSE 'declares' END AS kind FROM {orders} WHERE o_orderdate < CAST('1999-01-01' AS timestamp)""",
    "edges_head": """
        SELECT DISTINCT concat('customer:', CAST(o_custkey AS string)) AS src, concat('priority:', o_orderpriority) AS dst, CASE WHEN o_custkey % 2 = 0 THEN 'depends_on' ELSE 'declares' END AS kind FROM {orders} WHERE o_orderdate >= CAST('1998-01-01' AS timestamp)""",
    # Paragraphs of two versions of documents: consecutive turns.
    "versions": """
        SELECT conv_id AS doc, turn AS version, text AS after, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {conversations}""",
    # Cells of two versions of sheets.
    "cells_before": """
        SELECT CAST(l_orderkey AS string) AS sheet, l_linenumber AS row, 'B' AS col, CAST(CAST(floor(min(l_quantity)) AS int) AS string) AS value, CASE WHEN min(l_partkey) % 3 = 0 THEN concat('=SUM(A1:A', CAST(l_linenumber + 3 AS string), ')') ELSE '' END AS formula
        FROM {lineitem} WHERE l_linenumber <> 7 GROUP BY l_orderkey, l_linenumber""",
    "cells_after": """
        SELECT CAST(l_orderkey AS string) AS sheet, l_linenumber AS row, 'B' AS col,
               CASE WHEN min(l_suppkey) % 31 = 0 THEN '#REF!' ELSE CAST(CAST(floor(min(l_quantity)) AS int) + CASE WHEN l_orderkey % 4 = 0 THEN CAST(min(l_suppkey) % 9 AS int) ELSE 0 END AS string) END AS value,
               CASE WHEN min(l_partkey) % 3 = 0 AND l_orderkey % 5 <> 0 THEN concat('=SUM(A1:A', CAST(l_linenumber + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 3 END AS string), ')') ELSE '' END AS formula
        FROM {lineitem} WHERE l_linenumber <> 1 GROUP BY l_orderkey, l_linenumber""",
    # Lines of texts.
    "paths": """
        SELECT DISTINCT path FROM (SELECT concat(CASE c_custkey % 7 WHEN 0 THEN 'src/auth/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'internal/payment/' WHEN 3 THEN '' WHEN 4 THEN 'test/' ELSE 'pkg/deep/er/' END, 'f', CAST(c_custkey AS string),
               CASE c_custkey % 8 WHEN 0 THEN '_test.go' WHEN 1 THEN '.md' WHEN 2 THEN '.PY' WHEN 3 THEN '.tsx' WHEN 4 THEN '/go.mod' WHEN 5 THEN '.rs' WHEN 6 THEN '/package.json' ELSE '.go' END) AS path FROM {customer}) p""",
}

#: Small fixed tables.
LITERALS: dict[str, str] = {
    "globs": "SELECT 1 AS ord, '**/auth/**' AS glob UNION ALL SELECT 2, '*.md' UNION ALL SELECT 3, '**/payment/*.go' UNION ALL SELECT 4, '**/go.mod' UNION ALL SELECT 5, 'src/**/f?.go'",
    "knowledge": "SELECT 'auth' AS title, 1 AS ord, 40 AS size, '**/auth/**' AS glob UNION ALL SELECT 'docs', 2, 30, 'docs/**' UNION ALL SELECT 'pay', 3, 50, '**/payment/**' UNION ALL SELECT 'none', 4, 5, 'nowhere/**' UNION ALL SELECT 'deep', 5, 20, 'pkg/**/er/*' UNION ALL SELECT 'mods', 6, 8, '**/go.mod'",
}

ALL = CARRIERS | LITERALS


def _with(names: list[str]) -> list[tuple[str, str]]:
    """The carriers and those they need, in order."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in out and name in ALL:
            for n in [n for n in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", ALL[name]) if n in ALL]:
                add(n)
            out[name] = ALL[name].strip()

    for n in names:
        add(n)
    return list(out.items())


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table or a carrier."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ctes = _with([name])
    text = "WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in ctes) + f" SELECT * FROM {name}"
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def oracle(sql: str, names: list[str]) -> str:
    """``sql`` with the carriers it reads before it."""
    ctes = ", ".join(f"{n} AS ({text})" for n, text in _with(names))
    for t in TABLES:
        ctes = ctes.replace("{" + t + "}", t)
    sql = sql.strip()
    if not ctes:
        return sql
    if sql[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {sql[15:]}"
    return f"WITH {ctes}, {sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {ctes} {sql}"
