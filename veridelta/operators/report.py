"""Ranking, merging and verification of signals, findings, alerts and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import alert_rank, occurrence, owners, range_join, severity_rank

IDS_PER_LIST = 20


def normal_severity(c: str | Column) -> Column:
    """A known severity in lower case, anything else medium."""
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.when(low.isin("critical", "high", "medium", "low"), low).otherwise("medium")


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("medium", "low", "medium", "high", "critical"))), (rank + 1).cast("int"))


def changed_coordinates(diff: DataFrame) -> DataFrame:
    """path, side and line of added (new) and deleted (old) lines."""
    side = F.when(F.col("kind") == "add", "new").when(F.col("kind") == "delete", "old")
    return diff.select("path", side.alias("side"), "line").where("side IS NOT NULL AND line > 0").distinct()


def coordinates(diff: DataFrame, signals: DataFrame) -> DataFrame:
    """Each changed line that a signal covers, and each signal that covers none at its own range: severity rank, reasons, ids."""
    s = signals.withColumn("end_line", F.greatest("line", "end_line"))
    hit = _covered(diff, s)
    lone = s.join(hit.select("id").distinct(), "id", "left_anti").select("path", "side", F.col("line").alias("start"), F.col("end_line").alias("end"), "severity", "summary", "id", "ord")
    both = hit.select("path", "side", F.col("at").alias("start"), F.col("at").alias("end"), "severity", "summary", "id", "ord").unionByName(lone)
    first = severity_rank(normal_severity(F.min_by("severity", "ord")))
    return both.groupBy("path", "side", "start").agg(
        F.min_by("end", "ord").alias("end"), F.greatest(first, F.max(severity_rank("severity"))).alias("rank"), F.collect_set("summary").alias("reasons"), F.collect_set("id").alias("ids")
    )


def _covered(diff: DataFrame, signals: DataFrame) -> DataFrame:
    points = changed_coordinates(diff).withColumnRenamed("line", "at")
    ranges = signals.where("line > 0").select("path", "side", F.col("line").alias("_s"), F.col("end_line").alias("_e"), "severity", "summary", "id", "ord")
    return range_join(points, ranges, ["path", "side"], "at", "_s", "_e")


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges (path, side, start, end, rank, reasons, ids) of a side of a file joined where they touch or overlap; those at 0 stay apart."""
    w = Window.partitionBy("path", "side").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when((F.col("start") <= 0) | before.isNull() | (before + 1 < F.col("start")), 1).otherwise(0)
    grouped = ranges.withColumn("_new", new).withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return grouped.groupBy("path", "side", "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("rank").alias("rank"), union("reasons").alias("reasons"), union("ids").alias("ids")).drop("_group")


def review_targets(diff: DataFrame, signals: DataFrame) -> DataFrame:
    """What to look at: covered lines and lone signals, merged, with the highest severity, all reasons and ids."""
    return merge_ranges(coordinates(diff, signals)).withColumn("severity", severity_name(F.col("rank")))


def dedupe_lines(alerts: DataFrame) -> DataFrame:
    """What is left of each alert when earlier ones claim their lines: issues stay whole, others are cut to parts or go.

    A line belongs to the alert of the least rank that covers it, which the ends
    of ranges tell; no line is listed.
    """
    span = alerts.withColumn("end_line", F.greatest("line", "end_line"))
    parts = owners(span, ["path", "side"], "line", "end_line")
    n = parts.groupBy("path", "side", "rank").agg(F.count(F.lit(1)).alias("_n"))
    parts = occurrence(parts.join(n, ["path", "side", "rank"]), ["path", "side", "rank"], ["line"], "_i")
    rest = span.where("NOT issue").select("id", "path", "side", "rank").join(parts, ["path", "side", "rank"])
    name = F.when(F.col("_n") > 1, F.concat("id", F.lit("#"), (F.col("_i") + 1).cast("string"))).otherwise(F.col("id"))
    whole = span.where("issue").select("id", "path", "side", F.col("line").cast("bigint").alias("line"), F.col("end_line").cast("bigint").alias("end_line"))
    return whole.unionByName(rest.select(name.alias("id"), "path", "side", "line", "end_line"))


def remainder(spans: DataFrame, covers: DataFrame) -> DataFrame:
    """The parts of spans (path, start, end) that no cover of the path holds: those that a span owns where covers come first."""
    both = covers.select("path", "start", "end", F.lit(0).alias("rank")).unionByName(spans.select("path", "start", "end", F.lit(1).alias("rank")))
    return owners(both, ["path"]).where("rank = 1").drop("rank")


def severity_counts(alerts: DataFrame, by: list[str]) -> DataFrame:
    """low, medium, high, critical and total; what isn't known counts as low."""
    r = alert_rank("severity")
    return alerts.groupBy(*by).agg(*(F.count_if(r == i).alias(n) for i, n in enumerate(("low", "medium", "high", "critical"))), F.count(F.lit(1)).alias("total"))


def merge_findings(findings: DataFrame) -> DataFrame:
    """Findings (class, identity, path, line, title, ids, ord) of the same class, identity and place: the first's title, all ids, sorted and capped."""
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids"))))
    g = findings.groupBy("class", "identity", "path", "line").agg(F.min_by("title", "ord").alias("title"), ids.alias("_ids"))
    return g.select("class", "identity", "path", "line", "title", F.slice("_ids", 1, IDS_PER_LIST).alias("ids"), (F.size("_ids") > IDS_PER_LIST).alias("truncated"))


def fingerprints(findings: DataFrame) -> DataFrame:
    """A hash of class, path and identity, with the occurrence where they repeat; lines don't matter."""
    n = occurrence(findings, ["class", "path", "identity"], ["line", "ord"], "_n")
    key = F.concat_ws("|", F.lit("finding/v1"), "class", "path", "identity", F.when(F.col("_n") > 0, F.concat(F.lit("#"), F.col("_n").cast("string"))))
    return n.withColumn("fingerprint", F.substring(F.sha2(key, 256), 1, 32)).drop("_n")


def content_id(*columns: str) -> Column:
    """The first 16 hexadecimal digits of the hash of the columns."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256), 1, 16)


def group_file_signals(signals: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """File-scope signals of some kinds that carry the same change and severity as one group; others, and groups of one, pass through."""
    s = signals.withColumn("_groupable", (F.col("line") == 0) & F.col("kind").isin(*kinds))
    g = s.where("_groupable").groupBy("change_key", "severity").agg(F.min_by("id", "ord").alias("_first"), F.count(F.lit(1)).alias("members"), F.countDistinct("path").alias("_paths"), F.min("path").alias("_path"))
    grouped = g.select(
        F.when(F.col("members") > 1, F.concat(F.lit("group:"), content_id("change_key", "severity"))).otherwise(F.col("_first")).alias("id"), F.when(F.col("_paths") > 1, "").otherwise(F.col("_path")).alias("path"), "severity", "members"
    )
    return s.where("NOT _groupable").select("id", "path", "severity", F.lit(1).cast("bigint").alias("members")).unionByName(grouped)


def unique_ids(items: DataFrame) -> DataFrame:
    """Items whose id occurs once: one that occurs twice proves nothing."""
    once = items.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("id")
    return items.join(once, "id", "left_semi")


def support(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Of each claim: valid if it cites and all it cites resolves uniquely; supported if any evidence is verified with the claim's status."""
    e = unique_ids(evidence).select(F.col("id").alias("evidence_id"), "verified")
    c = citations.join(e, "evidence_id", "left").join(claims.select(F.col("id").alias("claim_id"), "status"), "claim_id")
    g = c.groupBy("claim_id").agg(F.bool_and(F.col("verified").isNotNull()).alias("valid"), F.bool_or(F.coalesce(F.col("verified") == F.col("status"), F.lit(False))).alias("supported"))
    no = lambda x: F.coalesce(x, F.lit(False)).alias(x)
    return claims.join(g, F.col("id") == F.col("claim_id"), "left").select("id", "status", "path", "line", "severity", no("valid"), no("supported"))


def final_status(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """The status of each claim once its evidence is checked: what isn't valid and supported is unverified."""
    s = support(claims, citations, evidence)
    return s.withColumn("final", F.when(F.col("valid") & F.col("supported"), F.col("status")).otherwise("UNVERIFIED"))


def verdict(claims: DataFrame, checks: DataFrame, signals: DataFrame) -> DataFrame:
    """One row: the exit code and why. A reproduced claim of at least high severity is 1; else anything that needs a human is 2; else 0."""
    c = claims.agg(
        F.count_if((F.col("final") == "REPRODUCED") & (severity_rank(normal_severity("severity")) >= 3)).alias("blocking"), F.count_if(F.col("final").isin("UNVERIFIED", "DIVERGED", "INTENT_TEST_FAILED")).alias("open")
    )
    k = checks.agg(F.count_if((F.col("status") != "PASS") | (F.col("exit_code") != 0)).alias("failed"), F.count(F.lit(1)).alias("checks"))
    s = signals.agg(F.count_if(severity_rank("severity") >= 3).alias("risky"))
    code = F.when(F.col("blocking") > 0, 1).when((F.col("open") > 0) | (F.col("failed") > 0) | (F.col("risky") > 0) | (F.col("checks") == 0), 2).otherwise(0)
    return c.crossJoin(k).crossJoin(s).withColumn("exit_code", code)  # one row each


def first_assessment(assessments: DataFrame) -> DataFrame:
    """The first assessment with a title of each signal."""
    return assessments.where("trim(title) <> ''").groupBy("signal_id").agg(F.min_by(F.struct("title", "judgment"), "ord").alias("a")).select("signal_id", "a.*")


def adjusted(signals: DataFrame, assessments: DataFrame) -> DataFrame:
    """Severities one level lower where the first assessment sees no risk; low and unknown ones are set aside."""
    s = signals.join(first_assessment(assessments), F.col("id") == F.col("signal_id"), "left")
    harmless, now = F.coalesce(F.col("judgment") == "no_risk", F.lit(False)), normal_severity("severity")
    lower = F.when(now == "critical", "high").when(now == "high", "medium").when(now == "medium", "low")
    return s.select("id", now.alias("severity"), F.when(harmless, lower).alias("adjusted"), (harmless & lower.isNull()).alias("set_aside"))


def merge_claims(claims: DataFrame) -> DataFrame:
    """Claims of several agents on one place and title, white space and case folded: the strongest status (the first of equals), the first id, all agents in order."""
    strength = F.array_position(F.array(*map(F.lit, ("UNVERIFIED", "DISMISSED", "NOT_REPRODUCED", "DIVERGED", "REPRODUCED"))), F.col("status"))
    key = F.lower(F.trim(F.regexp_replace("title", r"\s+", " ")))
    first = claims.groupBy(F.lower("path").alias("path"), "line", key.alias("title"), "agent").agg(F.min("ord").alias("seen"), F.max_by("status", F.struct(strength, (-F.col("ord")).alias("o"))).alias("status"), F.max(strength).alias("strength"), F.min("ord").alias("ord"), F.min_by("id", "ord").alias("id"))
    g = first.groupBy("path", "line", "title").agg(F.min_by("id", "ord").alias("id"), F.max_by("status", F.struct("strength", (-F.col("ord")).alias("o"))).alias("status"), F.array_sort(F.collect_list(F.struct("seen", "agent"))).alias("_a"))
    return g.select("path", "line", "title", "id", "status", F.array_join(F.transform("_a", lambda x: x["agent"]), ",").alias("agents"))


def verdict_name(code: Column) -> Column:
    """What an exit code says: clear, blocked, review, or failed for any other."""
    return F.when(code == 0, "clear").when(code == 1, "blocked").when(code == 2, "review").otherwise("failed")


def hash_hex(c: Column, digits: int = 64) -> Column:
    """The first hexadecimal digits of the SHA-256 of a text's UTF-8 bytes; null stays null."""
    return F.substring(F.sha2(c, 256), 1, digits)


def canonical_key(*columns: str) -> Column:
    """The hash of the columns as one JSON object, members in the order given, null ones as null; a row without any value fails."""
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.sha2(F.when(F.coalesce(*(F.col(c).cast("string") for c in columns)).isNull(), F.raise_error(F.lit("a key of nothing"))).otherwise(row), 256)


def union_signals(*sets: DataFrame) -> DataFrame:
    """Signals of several passes in canonical order, with ids from their content: equal signals have equal ids and stay apart by occurrence."""
    columns = ["path", "line", "kind", "side", "summary", "severity"]
    both = sets[0].select(*columns)
    for s in sets[1:]:
        both = both.unionByName(s.select(*columns))
    return occurrence(both.withColumn("id", content_id(*columns)), ["id"], ["path", "line"])


def locations(signals: DataFrame) -> DataFrame:
    """The lines of each (summary, path), in order, as one text."""
    g = signals.groupBy("summary", "path").agg(F.array_sort(F.collect_list(F.struct("line", "ord"))).alias("l"))
    return g.select("summary", "path", F.array_join(F.transform("l", lambda x: x["line"].cast("string")), ",").alias("locations"))


def ledger(evidence: DataFrame) -> DataFrame:
    """Each evidence id and whether it is usable: one that occurs twice isn't."""
    return evidence.groupBy("id").agg((F.count(F.lit(1)) == 1).alias("usable"))


def open_notes(claims: DataFrame) -> DataFrame:
    """The distinct titles of each agent that aren't blank, sorted."""
    return claims.where("trim(title) <> ''").groupBy("agent").agg(F.array_join(F.array_sort(F.collect_set(F.trim("title"))), "|").alias("notes"))


def cited_evidence(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """What each claim cites, as id:kind in the order cited; ids that name nothing are passed over, of repeated ones the first counts."""
    e = evidence.groupBy(F.col("id").alias("evidence_id")).agg(F.min_by("kind", "ord").alias("kind"))
    j = citations.join(e, "evidence_id").groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", "evidence_id", "kind").alias("t")))).alias("l"))
    return j.select("claim_id", F.array_join(F.transform("l", lambda x: x["t"]), ",").alias("cited"))


def assign_areas(alerts: DataFrame, areas: DataFrame) -> DataFrame:
    """The area of each alert: the first (by name) that cites its id, else the one that cites the id without its part number, else none."""
    named = areas.groupBy("id").agg(F.min("area").alias("area"))
    keyed = alerts.select("alert", F.explode(F.array_distinct(F.array(F.col("alert"), F.regexp_replace("alert", r"#[0-9]+$", "")))).alias("id"))
    own = F.struct((F.col("id") != F.col("alert")).alias("_base"), "area")
    best = keyed.join(named, "id").groupBy("alert").agg(F.min(own).alias("r"))
    return alerts.select("alert").join(best, "alert", "left").select("alert", F.coalesce("r.area", F.lit("")).alias("area"))


def reasons_not_shown(targets: DataFrame, shown: DataFrame) -> DataFrame:
    """The reasons (path, reason) of each path that ``shown`` (path, reason) doesn't hold for it, sorted; empty where all are."""
    own = targets.select("path", "reason", F.lit(1).alias("_own")).distinct()
    rest = own.join(shown.select("path", "reason").distinct(), ["path", "reason"], "left_anti").groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("reasons"))
    return targets.select("path").distinct().join(rest, "path", "left").select("path", F.coalesce("reasons", F.lit("")).alias("reasons"))


def diverged_evidence(evidence: DataFrame, checks: DataFrame) -> DataFrame:
    """Diverged evidence, unique by id, with checks of which none timed out, and their number."""
    e = unique_ids(evidence).where("verified = 'DIVERGED'").select("id")
    k = checks.select(F.col("evidence_id").alias("id"), "status")
    return e.join(k, "id").groupBy("id").agg(F.count(F.lit(1)).alias("checks"), F.bool_and(F.col("status") != "TIMEOUT").alias("_ok")).where("_ok").drop("_ok")


def citing_claims(citations: DataFrame, claims: DataFrame, status: str = "DIVERGED") -> DataFrame:
    """The claims of a status that cite each evidence, sorted, and the path of the first of them."""
    c = citations.join(claims.where(F.col("status") == status).select(F.col("id").alias("claim_id"), "path", "ord"), "claim_id")
    return c.groupBy("evidence_id").agg(F.array_join(F.array_sort(F.collect_set("claim_id")), ",").alias("claim_ids"), F.min_by("path", "ord").alias("path"))


def gate_reasons(checks: DataFrame, signals: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: why a plan can't pass, empty if nothing is in its way."""
    k = checks.agg(F.count_if((F.col("status") != "PASS") | (F.col("exit_code") != 0)).alias("f"), F.count(F.lit(1)).alias("n"))
    s = signals.agg(F.count_if(severity_rank("severity") >= 3).alias("s"))
    c = claims.agg(F.count_if(F.col("status") == "UNVERIFIED").alias("u"))
    reasons = (F.when(F.col("f") > 0, "checks_failed"), F.when(F.col("s") > 0, "risk_signals"), F.when(F.col("n") == 0, "no_checks"), F.when(F.col("u") > 0, "unverified"))
    return k.crossJoin(s).crossJoin(c).select(F.concat_ws(";", *reasons).alias("reasons"))  # one row each
