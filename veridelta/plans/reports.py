"""Queries on signals, findings, alerts, claims and their evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridelta import sinks
from veridelta.operators import core, report
from veridelta.registry import query

CLI = "CASE lower({c}) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
HUB = "CASE lower({c}) WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
SEV = CLI.format(c="severity")
ALERT = HUB.format(c="severity")
NORMAL = "CASE WHEN severity IN ('critical', 'high', 'medium', 'low') THEN severity ELSE 'medium' END"


@query("sca1_severity_rank", f"SELECT DISTINCT severity, CAST({SEV} AS BIGINT) AS rank, {NORMAL} AS normal FROM signals")
def _(signals):
    return signals.select("severity", core.severity_rank("severity").alias("rank"), report.normal_severity("severity").alias("normal")).distinct()


@query("sca2_alert_rank", f"SELECT DISTINCT severity, CAST({ALERT} AS BIGINT) AS rank FROM signals")
def _(signals):
    return signals.select("severity", core.alert_rank("severity").alias("rank")).distinct()


@query("sca3_verdict", "SELECT code, CASE code WHEN 0 THEN 'clear' WHEN 1 THEN 'blocked' WHEN 2 THEN 'review' ELSE 'failed' END AS verdict FROM (SELECT DISTINCT CAST(l_linenumber - 1 AS BIGINT) AS code FROM lineitem)")
def _(lineitem):
    return lineitem.select((F.col("l_linenumber") - 1).alias("code")).distinct().select("code", report.verdict_name(F.col("code")).alias("verdict"))


@query("sca4_status_kind_rank", "SELECT DISTINCT kind, CAST(CASE kind WHEN 'secret' THEN 0 WHEN 'coverage' THEN 1 WHEN 'dependency' THEN 2 ELSE 3 END AS BIGINT) AS rank FROM signals")
def _(signals):
    return signals.select("kind", core.ranks("kind", ["secret", "coverage", "dependency"], 3).alias("rank")).distinct()


@query("sca5_sha256", "SELECT doc_id, sha256(text) AS hash, left(sha256(text), 16) AS prefix FROM documents")
def _(documents):
    return documents.select("doc_id", report.hash_hex(F.col("text")).alias("hash"), report.hash_hex(F.col("text"), 16).alias("prefix"))


@query("sca6_canonical_key", "SELECT id, sha256(CAST(to_json({'kind': kind, 'path': path, 'line': line, 'side': side}) AS VARCHAR)) AS key FROM signals")
def _(signals):
    return signals.select("id", report.canonical_key("kind", "path", "line", "side").alias("key"))


@query("srt3_signal_order", "SELECT id, path, CAST(line AS BIGINT) AS line, kind, left(sha256(concat_ws('|', path, CAST(line AS VARCHAR), kind, side, summary, severity)), 16) AS content_id FROM signals")
def _(signals):
    return signals.select("id", "path", "line", "kind", report.content_id("path", "line", "kind", "side", "summary", "severity").alias("content_id")).orderBy("path", "line", "kind", "id")


@query("set1_signal_union", "WITH u AS (FROM signals WHERE ord % 2 = 0 UNION ALL FROM signals WHERE ord % 3 = 0), k AS (SELECT path, CAST(line AS BIGINT) AS line, kind, side, summary, severity, left(sha256(concat_ws('|', path, CAST(line AS VARCHAR), kind, side, summary, severity)), 16) AS id FROM u) SELECT *, row_number() OVER (PARTITION BY id) - 1 AS occurrence FROM k")
def _(signals):
    return report.union_signals(signals.where("ord % 2 = 0"), signals.where("ord % 3 = 0"))


@query("set2_distinct_union", "SELECT path FROM signals UNION SELECT path FROM claims")
def _(signals, claims):
    return core.union_distinct(signals, claims, ["path"])


@query("set3_intersection", "SELECT path, line FROM (SELECT path, CAST(line AS BIGINT) AS line FROM signals INTERSECT SELECT path, CAST(line AS BIGINT) FROM claims)")
def _(signals, claims):
    return core.common(signals, claims, ["path", "line"])


LISTS = "list_sort(list_distinct(flatten(list({c}))))"
TARGETS = f"""
WITH s AS (SELECT *, greatest(line, end_line) AS e FROM signals), c AS (SELECT DISTINCT path, CASE kind WHEN 'add' THEN 'new' ELSE 'old' END AS side, line FROM d WHERE kind <> 'context'),
hit AS (SELECT c.path, c.side, c.line AS start, c.line AS stop, severity, summary, id, ord FROM c JOIN s ON s.path = c.path AND s.side = c.side AND s.line > 0 AND c.line BETWEEN s.line AND s.e),
allc AS (SELECT * FROM hit UNION ALL SELECT path, side, line, e, severity, summary, id, ord FROM s WHERE id NOT IN (SELECT id FROM hit)),
coord AS (SELECT path, side, start, arg_min(stop, ord) AS stop, greatest(arg_min(CASE WHEN {SEV} = 0 THEN 2 ELSE {SEV} END, ord), max({SEV})) AS rank, list(DISTINCT summary) AS reasons, list(DISTINCT id) AS ids FROM allc GROUP BY path, side, start),
"""
MERGED = f"""
b AS (SELECT *, max(stop) OVER (PARTITION BY path, side ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM coord),
g AS (SELECT *, sum(CASE WHEN start <= 0 OR prev IS NULL OR prev + 1 < start THEN 1 ELSE 0 END) OVER (PARTITION BY path, side ORDER BY start, stop) AS grp FROM b)
SELECT path, side, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS "end", CAST(max(rank) AS BIGINT) AS rank, array_to_string({LISTS.format(c="reasons")}, ',') AS reasons, array_to_string({LISTS.format(c="ids")}, ',') AS ids,
       CASE max(rank) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity FROM g GROUP BY path, side, grp
"""
DIFF = "WITH d AS (SELECT concat('src/f', CAST(l_orderkey % 200 AS VARCHAR), '.go') AS path, l_partkey % 70 AS line, CASE min(l_returnflag) WHEN 'A' THEN 'add' WHEN 'R' THEN 'delete' ELSE 'context' END AS kind FROM lineitem GROUP BY ALL), "


def diff(lineitem):
    rows = lineitem.select(F.concat(F.lit("src/f"), (F.col("l_orderkey") % 200).cast("string"), F.lit(".go")).alias("path"), (F.col("l_partkey") % 70).alias("line"), "l_returnflag")
    return rows.groupBy("path", "line").agg(F.min("l_returnflag").alias("f")).select("path", "line", F.when(F.col("f") == "A", "add").when(F.col("f") == "R", "delete").otherwise("context").alias("kind"))


def joined(df):
    return df.withColumn("reasons", F.array_join(F.array_sort("reasons"), ",")).withColumn("ids", F.array_join(F.array_sort("ids"), ","))


@query("joi3_range_lookup", DIFF + TARGETS.strip()[5:].rstrip().rstrip(",") + " SELECT path, side, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS \"end\", CAST(rank AS BIGINT) AS rank, array_to_string(list_sort(reasons), ',') AS reasons, array_to_string(list_sort(ids), ',') AS ids FROM coord")
def _(lineitem, signals):
    return joined(report.coordinates(diff(lineitem), signals))


def targets(lineitem, signals):
    return joined(report.review_targets(diff(lineitem), signals))


for name in ("win2_adjacent_merge", "agg13_target_merge"):
    query(name, DIFF + TARGETS.strip()[5:] + MERGED)(targets)


@query("srt4_review_target_order", DIFF + TARGETS.strip()[5:] + MERGED + " ORDER BY rank DESC, path, side, start LIMIT 50")
def _(lineitem, signals):
    return targets(lineitem, signals).orderBy(F.desc("rank"), "path", "side", "start").limit(50)


DEDUPE = """
WITH a AS (SELECT *, greatest(line, end_line) AS e FROM alerts), l AS (SELECT path, side, rank, unnest(range(line, e + 1)) AS at_ FROM a), own AS (SELECT path, side, at_, min(rank) AS rank FROM l GROUP BY ALL),
isl AS (SELECT path, side, rank, min(at_) AS s, max(at_) AS t FROM (SELECT *, at_ - row_number() OVER (PARTITION BY path, side, rank ORDER BY at_) AS g FROM own) GROUP BY path, side, rank, g),
n AS (SELECT *, count(*) OVER (PARTITION BY path, side, rank) AS c, row_number() OVER (PARTITION BY path, side, rank ORDER BY s) AS i FROM isl)
SELECT id, path, side, CAST(line AS BIGINT) AS line, CAST(e AS BIGINT) AS end_line FROM a WHERE issue UNION ALL
SELECT CASE WHEN c > 1 THEN id || '#' || i ELSE id END, n.path, n.side, n.s, n.t FROM n JOIN a USING (path, side, rank) WHERE NOT issue"""


@query("win3_interval_subtraction", DEDUPE)
def _(alerts):
    return report.dedupe_lines(alerts)


@query("win4_interval_remainder", "WITH l AS (SELECT path, unnest(range(1, 71)) AS line FROM (SELECT DISTINCT path FROM signals)), c AS (SELECT DISTINCT path, unnest(range(line, greatest(line, end_line) + 1)) AS line FROM signals WHERE line > 0), r AS (SELECT * FROM l EXCEPT SELECT * FROM c), g AS (SELECT *, line - row_number() OVER (PARTITION BY path ORDER BY line) AS g FROM r) SELECT path, min(line) AS start, max(line) AS \"end\" FROM g GROUP BY path, g")
def _(signals):
    spans = signals.select("path").distinct().select("path", F.lit(1).alias("start"), F.lit(70).alias("end"))
    return report.remainder(spans, signals.where("line > 0").select("path", F.col("line").alias("start"), F.greatest("line", "end_line").alias("end")))


COUNTS = f"count(*) FILTER ({ALERT} = 0) AS low, count(*) FILTER ({ALERT} = 1) AS medium, count(*) FILTER ({ALERT} = 2) AS high, count(*) FILTER ({ALERT} = 3) AS critical, count(*) AS total"


@query("agg1_severity_counts", f"SELECT kind, {COUNTS} FROM signals GROUP BY kind")
def _(signals):
    return report.severity_counts(signals, ["kind"])


@query("agg2_at_least", f"SELECT kind, count(*) FILTER ({ALERT} >= 1) AS at_least_medium, count(*) FILTER ({ALERT} >= 2) AS at_least_high, count(*) FILTER ({ALERT} >= 3) AS at_least_critical FROM signals GROUP BY kind")
def _(signals):
    r = core.alert_rank("severity")
    return signals.groupBy("kind").agg(*(F.count_if(r >= i).alias(f"at_least_{n}") for i, n in ((1, "medium"), (2, "high"), (3, "critical"))))


@query("agg3_report_summary", f"SELECT (SELECT count(*) FILTER (status = 'PASS' AND exit_code = 0) FROM checks) AS passed, (SELECT count(*) FILTER (NOT (status = 'PASS' AND exit_code = 0)) FROM checks) AS failed, (SELECT count(*) FILTER (status = 'UNVERIFIED') FROM claims) AS suspicions, (SELECT count(*) FROM signals WHERE {ALERT} >= 2) AS high_alerts")
def _(checks, claims, signals):
    ok = (F.col("status") == "PASS") & (F.col("exit_code") == 0)
    k = checks.agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))
    return k.crossJoin(claims.agg(F.count_if(F.col("status") == "UNVERIFIED").alias("suspicions"))).crossJoin(signals.agg(F.count_if(core.alert_rank("severity") >= 2).alias("high_alerts")))


@query("flt5_min_severity", f"SELECT kind, count(*) FILTER ({ALERT} >= 2) AS kept, count(*) FILTER ({ALERT} < 2) AS below FROM signals GROUP BY kind")
def _(signals):
    r = core.alert_rank("severity")
    return signals.groupBy("kind").agg(F.count_if(r >= 2).alias("kept"), F.count_if(r < 2).alias("below"))


@query("flt16_alert_partition", "SELECT id, set_aside AS dismissed FROM (SELECT s.id, coalesce(a.judgment = 'no_risk', false) AND severity NOT IN ('critical', 'high', 'medium', 'unknown') AS set_aside FROM signals s LEFT JOIN (SELECT signal_id, arg_min(judgment, ord) AS judgment FROM assessments WHERE trim(title) <> '' GROUP BY 1) a ON a.signal_id = s.id)")
def _(signals, assessments):
    return report.adjusted(signals, assessments).select("id", F.col("set_aside").alias("dismissed"))


FINDINGS = "WITH f AS (SELECT kind AS class, summary AS identity, path, CAST(line AS BIGINT) AS line, concat(severity, ' ', id) AS title, id, ord FROM signals)"


def findings(signals):
    return signals.select(F.col("kind").alias("class"), F.col("summary").alias("identity"), "path", "line", F.concat_ws(" ", "severity", "id").alias("title"), F.array("id").alias("ids"), "ord")


@query("agg12_finding_merge", FINDINGS + " SELECT class, identity, path, line, arg_min(title, ord) AS title, array_to_string(list_sort(list(DISTINCT id))[1:20], ',') AS ids, count(DISTINCT id) > 20 AS truncated FROM f GROUP BY class, identity, path, line")
def _(signals):
    return report.merge_findings(findings(signals)).withColumn("ids", F.array_join("ids", ","))


@query("win7_fingerprints", FINDINGS + ", n AS (SELECT *, row_number() OVER (PARTITION BY class, path, identity ORDER BY line, ord) - 1 AS k FROM f) SELECT title, left(sha256(concat_ws('|', 'finding/v1', class, path, identity, CASE WHEN k > 0 THEN '#' || k END)), 32) AS fingerprint FROM n")
def _(signals):
    return report.fingerprints(findings(signals)).select("title", "fingerprint")


@query("srt1_alert_ranking", f"SELECT id, row_number() OVER (ORDER BY {ALERT} DESC, kind, path, line, ord) AS place FROM signals ORDER BY place LIMIT 100")
def _(signals):
    top = signals.withColumn("_r", core.alert_rank("severity")).orderBy(F.desc("_r"), "kind", "path", "line", "ord").limit(100)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("_r"), "kind", "path", "line", "ord")).alias("place"))  # of 100 rows


@query("srt2_finding_ranking", f"SELECT id, row_number() OVER (ORDER BY CASE kind WHEN 'secret' THEN 0 WHEN 'coverage' THEN 1 ELSE 2 END, {SEV} DESC, path, line, summary, id) AS place FROM signals ORDER BY place LIMIT 100")
def _(signals):
    order = [core.ranks("kind", ["secret", "coverage"], 2), F.desc(core.severity_rank("severity")), F.col("path"), F.col("line"), F.col("summary"), F.col("id")]
    return signals.orderBy(*order).limit(100).select("id", F.row_number().over(Window.orderBy(*order)).alias("place"))  # of 100 rows


@query(
    "agg14_signal_grouping",
    "WITH s AS (SELECT *, concat('k', CAST(ord % 30 AS VARCHAR)) AS ck, line = 0 AND kind IN ('secret', 'test_removed', 'coverage') AS g FROM signals), gg AS (SELECT ck, severity, arg_min(id, ord) AS first, count(*) AS members, count(DISTINCT path) AS paths, min(path) AS p FROM s WHERE g GROUP BY ck, severity) SELECT id, path, severity, CAST(1 AS BIGINT) AS members FROM s WHERE NOT g UNION ALL SELECT CASE WHEN members > 1 THEN 'group:' || left(sha256(concat_ws('|', ck, severity)), 16) ELSE first END, CASE WHEN paths > 1 THEN '' ELSE p END, severity, members FROM gg",
)
def _(signals):
    return report.group_file_signals(signals.withColumn("change_key", F.concat(F.lit("k"), (F.col("ord") % 30).cast("string"))), ("secret", "test_removed", "coverage"))


@query("agg15_location_list", "SELECT summary, path, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line, ord) AS locations FROM signals GROUP BY summary, path")
def _(signals):
    return report.locations(signals)


ONCE = "once AS (SELECT id, any_value(verified) AS verified, any_value(kind) AS kind FROM evidence GROUP BY id HAVING count(*) = 1)"
SUPPORT = f"WITH {ONCE}, g AS (SELECT c.claim_id, bool_and(o.id IS NOT NULL) AS valid, bool_or(coalesce(o.verified = h.status, false)) AS supported FROM citations c JOIN claims h ON h.id = c.claim_id LEFT JOIN once o ON o.id = c.evidence_id GROUP BY c.claim_id), s AS (SELECT h.id, status, path, CAST(line AS BIGINT) AS line, severity, coalesce(valid, false) AS valid, coalesce(supported, false) AS supported FROM claims h LEFT JOIN g ON g.claim_id = h.id)"


@query("evd8_claim_support", SUPPORT + " SELECT * FROM s")
def _(claims, citations, evidence):
    return report.support(claims, citations, evidence)


@query("agg28_verdict", SUPPORT + f", f AS (SELECT *, CASE WHEN valid AND supported THEN status ELSE 'UNVERIFIED' END AS final FROM s), c AS (SELECT count(*) FILTER (final = 'REPRODUCED' AND severity IN ('high', 'critical')) AS blocking, count(*) FILTER (final IN ('UNVERIFIED', 'DIVERGED')) AS open FROM f), k AS (SELECT count(*) FILTER (status <> 'PASS' OR exit_code <> 0) AS failed, count(*) AS checks FROM checks), z AS (SELECT count(*) FILTER ({SEV} >= 3) AS risky FROM signals) SELECT *, CAST(CASE WHEN blocking > 0 THEN 1 WHEN open > 0 OR failed > 0 OR risky > 0 OR checks = 0 THEN 2 ELSE 0 END AS BIGINT) AS exit_code FROM c, k, z")
def _(claims, citations, evidence, checks, signals):
    return report.verdict(report.final_status(claims, citations, evidence), checks, signals)


@query("agg29_evidence_ledger", "SELECT id, count(*) = 1 AS usable FROM evidence GROUP BY id")
def _(evidence):
    return report.ledger(evidence)


@query("agg27_distinct_notes", "SELECT agent, array_to_string(list_sort(list(DISTINCT trim(title)) FILTER (trim(title) <> '')), '|') AS notes FROM claims GROUP BY agent")
def _(claims):
    return report.open_notes(claims)


@query("joi18_claim_evidence", "SELECT c.claim_id, string_agg(e.id || ':' || e.kind, ',' ORDER BY c.pos) AS cited FROM citations c JOIN (SELECT id, arg_min(kind, ord) AS kind FROM evidence GROUP BY id) e ON e.id = c.evidence_id GROUP BY c.claim_id")
def _(citations, evidence):
    return report.cited_evidence(citations, evidence)


@query("joi19_first_assessment", "SELECT s.id, a.title, a.judgment FROM signals s LEFT JOIN (SELECT signal_id, arg_min(title, ord) AS title, arg_min(judgment, ord) AS judgment FROM assessments WHERE trim(title) <> '' GROUP BY 1) a ON a.signal_id = s.id")
def _(signals, assessments):
    return signals.join(report.first_assessment(assessments), F.col("id") == F.col("signal_id"), "left").select("id", "title", "judgment")


@query("evd9_severity_adjust", f"WITH a AS (SELECT signal_id, arg_min(judgment, ord) AS judgment FROM assessments WHERE trim(title) <> '' GROUP BY 1), x AS (SELECT s.id, {NORMAL} AS severity, coalesce(judgment = 'no_risk', false) AS harmless FROM signals s LEFT JOIN a ON a.signal_id = s.id) SELECT id, severity, CASE WHEN harmless THEN CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' END END AS adjusted, harmless AND severity = 'low' AS set_aside FROM x")
def _(signals, assessments):
    return report.adjusted(signals, assessments)


@query("joi20_area_assignment", "WITH a AS (SELECT concat('s', CAST(c_custkey AS VARCHAR)) AS id, c_mktsegment AS area FROM customer), x AS (SELECT id || CASE WHEN ord % 4 = 0 THEN '#2' ELSE '' END AS alert FROM signals), m AS (SELECT id, min(area) AS area FROM a GROUP BY id) SELECT alert, coalesce(d.area, b.area, '') AS area FROM x LEFT JOIN m d ON d.id = alert LEFT JOIN m b ON b.id = regexp_replace(alert, '#[0-9]+$', '')")
def _(signals, customer):
    areas = customer.select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("area"))
    return report.assign_areas(signals.select(F.concat("id", F.when(F.col("ord") % 4 == 0, "#2").otherwise("")).alias("alert")), areas)


@query("joi21_target_reasons", "SELECT path, array_to_string(list_sort(list_filter(list(DISTINCT summary), lambda r: NOT list_contains(coalesce(any_value(t), []), r))), ',') AS reasons FROM signals LEFT JOIN (SELECT path, list(DISTINCT concat('found ', CAST(ord % 6 AS VARCHAR))) AS t FROM claims GROUP BY path) USING (path) GROUP BY path")
def _(signals, claims):
    shown = claims.select("path", F.concat(F.lit("found "), (F.col("ord") % 6).cast("string")).alias("reason"))
    return report.reasons_not_shown(signals.select("path", F.col("summary").alias("reason")), shown)


@query("joi22_divergence_selection", f"WITH {ONCE} SELECT o.id, count(k.id) AS checks FROM once o JOIN checks k ON k.evidence_id = o.id WHERE o.verified = 'DIVERGED' GROUP BY o.id HAVING count(k.id) >= 1 AND bool_and(k.status <> 'TIMEOUT')")
def _(evidence, checks):
    return report.diverged_evidence(evidence, checks)


@query("joi23_divergence_claims", "SELECT c.evidence_id, string_agg(DISTINCT h.id, ',' ORDER BY h.id) AS claim_ids, arg_min(h.path, h.ord) AS path FROM citations c JOIN claims h ON h.id = c.claim_id WHERE h.status = 'DIVERGED' GROUP BY c.evidence_id")
def _(citations, claims):
    return report.citing_claims(citations, claims)


MERGE = """WITH k AS (SELECT lower(path) AS path, line, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS title, agent, id, ord, status, CASE status WHEN 'UNVERIFIED' THEN 1 WHEN 'DISMISSED' THEN 2 WHEN 'NOT_REPRODUCED' THEN 3 WHEN 'DIVERGED' THEN 4 ELSE 5 END AS st FROM claims),
a AS (SELECT path, line, title, agent, min(ord) AS seen FROM k GROUP BY ALL), l AS (SELECT path, line, title, string_agg(agent, ',' ORDER BY seen) AS agents FROM a GROUP BY path, line, title)
SELECT k.path, CAST(k.line AS BIGINT) AS line, k.title, arg_min(id, ord) AS id, arg_max(status, {'a': st, 'b': -ord}) AS status, any_value(agents) AS agents FROM k JOIN l USING (path, line, title) GROUP BY k.path, k.line, k.title"""


@query("agg30_swarm_merge", MERGE)
def _(claims):
    return report.merge_claims(claims)


@query("evd10_plan_gate", f"SELECT concat_ws(';', CASE WHEN (SELECT count(*) FROM checks WHERE status <> 'PASS' OR exit_code <> 0) > 0 THEN 'checks_failed' END, CASE WHEN (SELECT count(*) FROM signals WHERE {SEV} >= 3) > 0 THEN 'risk_signals' END, CASE WHEN (SELECT count(*) FROM checks) = 0 THEN 'no_checks' END, CASE WHEN (SELECT count(*) FROM claims WHERE status = 'UNVERIFIED') > 0 THEN 'unverified' END) AS reasons")
def _(checks, signals, claims):
    return report.gate_reasons(checks, signals, claims)


SARIF = f"""WITH r AS (SELECT severity, kind, path, line, id, {{'ruleId': kind, 'level': CASE WHEN {NORMAL} IN ('critical', 'high') THEN 'error' WHEN {NORMAL} = 'medium' THEN 'warning' ELSE 'note' END, 'message': {{'text': summary}},
 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': path}}, 'region': CASE WHEN line > 0 THEN {{'startLine': line, 'endLine': greatest(line, end_line)}} END}}}}], 'partialFingerprints': {{'veridelta/v1': id}}}} AS v FROM signals)
SELECT severity, replace(CAST(to_json({{'$schema': '{sinks.SARIF_SCHEMA}', 'version': '2.1.0', 'runs': [{{'tool': {{'driver': {{'name': 'veridelta', 'rules': list_sort(list(DISTINCT {{'id': kind, 'shortDescription': {{'text': replace(kind, '_', ' ')}}}}))}}}}, 'results': list(v ORDER BY kind, path, line, id)}}]}}) AS VARCHAR), ',"region":null', '') AS log FROM r GROUP BY severity"""


@query("snk3_sarif_export", SARIF)
def _(signals):
    return sinks.joined(sinks.sarif(signals, ["severity"], piece_bytes=1 << 14), ["severity"])


MARKDOWN = f"""WITH s AS (SELECT kind, {NORMAL} AS name, {SEV} AS rank, concat('- `', path, CASE WHEN line > 0 THEN concat(':', line) ELSE '' END, '` ', summary) AS item, path, line, id FROM signals),
n AS (SELECT *, count(*) OVER (PARTITION BY kind, name) AS n, row_number() OVER (PARTITION BY kind, name ORDER BY path, line, id) AS k FROM s),
t AS (SELECT kind, max(n) AS n, CASE name WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS rank, concat('## ', upper(name[1]), name[2:], ' (', max(n), ')', chr(10), chr(10), string_agg(item, chr(10) ORDER BY path, line, id), CASE WHEN max(n) > 50 THEN concat(chr(10), '- and ', max(n) - 50, ' more') ELSE '' END) AS text FROM n WHERE k <= 50 GROUP BY kind, name)
SELECT kind, concat('# Findings', chr(10), chr(10), sum(n), ' in all', chr(10), chr(10), string_agg(text, chr(10) || chr(10) ORDER BY rank DESC), chr(10)) AS text FROM t GROUP BY kind"""


@query("snk4_markdown_render", MARKDOWN)
def _(signals):
    return sinks.markdown(signals, ["kind"])


@query("snk5_comment_prefix", f"WITH p AS (SELECT path, id, ord, summary, sum(strlen(id) + strlen(summary)) OVER w AS used, row_number() OVER w AS n, count(*) OVER (PARTITION BY path) AS c FROM signals WINDOW w AS (PARTITION BY path ORDER BY {SEV} DESC, ord)) SELECT path, coalesce(string_agg(concat('- ', id, ' ', summary), chr(10) ORDER BY n) FILTER (used <= 400 AND n <= 20), '') AS text, count(*) FILTER (used <= 400 AND n <= 20) AS shown, max(c) - count(*) FILTER (used <= 400 AND n <= 20) AS hidden FROM p GROUP BY path")
def _(signals):
    return sinks.comment(signals, ["path"])
