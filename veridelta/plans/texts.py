"""Queries on texts, versions of documents, cells, and the parsers of text sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from veridelta.functions import paths as fp
from veridelta.functions import text as tx
from veridelta.operators import core, history, tools
from veridelta.operators import documents as dc
from veridelta.operators import sequences as sq
from veridelta.plans import samples
from veridelta.registry import query
from veridelta.shared import Tables
from veridelta.sources import git
from veridelta.sources import lines as src
from veridelta.sources import patches

DATE = "'\\b([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{2,4})\\b'"


@query("sca20_whitespace_normalize", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def _(documents):
    return documents.select("doc_id", tx.squeeze(F.col("text")).alias("text"))


CREDENTIALS = tuple(samples.MASKED.items())
CHOSEN = "list_extract([{}], CAST(o_orderkey % {} + 1 AS INTEGER))"
SECRET = CHOSEN.format(", ".join("'" + b.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for _, b in CREDENTIALS), len(CREDENTIALS))


@query("sca7_redact", f"SELECT o_orderkey AS id, replace({SECRET}, '@n', CAST(o_orderkey AS VARCHAR)) AS text FROM orders")
def _(orders):
    texts = F.array(*(F.lit(a) for a, _ in CREDENTIALS))
    t = F.replace(F.element_at(texts, (F.col("o_orderkey") % len(CREDENTIALS) + 1).cast("int")), F.lit("@n"), F.col("o_orderkey").cast("string"))
    return orders.select(F.col("o_orderkey").alias("id"), tx.redact(t).alias("text"))


@query("sca40_error_scrub", "SELECT doc_id, left(trim(regexp_replace(regexp_replace(text, 'src[0-9]+|[0-9]{4,}', '***', 'g'), '\\s+', ' ', 'g')), 100) AS message FROM documents")
def _(documents):
    return documents.select("doc_id", F.substring(tx.squeeze(F.regexp_replace("text", "src[0-9]+|[0-9]{4,}", "***")), 1, 100).alias("message"))



@query("sca8_truncate_utf8", "WITH RECURSIVE c AS (SELECT doc_id, text, length(text) AS k FROM documents WHERE strlen(text) > 0), w AS (SELECT doc_id, text, least(k, 40) AS k FROM c UNION ALL SELECT doc_id, text, k - 1 FROM w WHERE strlen(left(text, k)) > 40) SELECT doc_id, left(text, min(k)) AS cut FROM w GROUP BY doc_id, text")
def _(documents):
    return documents.where("octet_length(text) > 0").select("doc_id", tx.truncate_utf8(F.col("text"), 40).alias("cut"))


@query("flt7_bounded_projection", "WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, length(text) AS k FROM conversations WHERE strlen(text) > 0), w AS (SELECT conv_id, turn, role, text, least(k, 20) AS k FROM c UNION ALL SELECT conv_id, turn, role, text, k - 1 FROM w WHERE strlen(left(text, k)) > 20) SELECT conv_id, turn, role, left(text, min(k)) AS text FROM w GROUP BY conv_id, turn, role, w.text")
def _(conversations):
    return conversations.where("octet_length(text) > 0").select("conv_id", "turn", "role", tx.truncate_utf8(F.col("text"), 20).alias("text"))


@query("sca15_dates", f"SELECT doc_id, array_to_string(list_sort(regexp_extract_all(text, {DATE}, 1)), ',') AS dates FROM documents")
def _(documents):
    return documents.select("doc_id", F.array_join(tx.dates(F.col("text")), ",").alias("dates"))


NUM = "WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(concat_ws(' ', text, '1,200.50 1.200,50 0,125 12,5 3.000 ' || doc_id || '.25'), '[0-9][0-9.,]*')) AS s FROM documents), n AS (SELECT s, regexp_replace(s, '^[.,]+|[.,]+$', '', 'g') AS n FROM t)"


@query("sca17_canonical_number", NUM + " SELECT s, CASE WHEN NOT regexp_matches(n, '[.,]') THEN n WHEN regexp_full_match(n, '[0-9]+[.,][0-9]{3}') AND NOT regexp_full_match(n, '0[.,].*') THEN regexp_replace(n, '[.,]', '', 'g') ELSE regexp_replace(regexp_extract(n, '^(.*)[.,]([^.,]*)$', 1), '[.,]', '', 'g') || '.' || regexp_extract(n, '^(.*)[.,]([^.,]*)$', 2) END AS number FROM n")
def _(documents):
    s = F.explode(F.regexp_extract_all(F.concat_ws(" ", "text", F.concat(F.lit("1,200.50 1.200,50 0,125 12,5 3.000 "), F.col("doc_id").cast("string"), F.lit(".25"))), F.lit("[0-9][0-9.,]*"), F.lit(0)))
    return documents.select(s.alias("s")).distinct().select("s", tx.canonical_number(F.col("s")).alias("number"))


@query("sca16_figures", "WITH t AS (SELECT concat('pay $', o_custkey, ' or ', o_orderkey % 90, ' % of ', o_orderkey, ' items') AS s, o_custkey AS a, o_orderkey % 90 AS b, o_orderkey AS c FROM orders) SELECT s, array_to_string(list_sort([CAST(a AS VARCHAR), CAST(b AS VARCHAR)]), ',') AS amounts, CAST(c AS VARCHAR) AS figures FROM t")
def _(orders):
    s = F.concat(F.lit("pay $"), F.col("o_custkey").cast("string"), F.lit(" or "), (F.col("o_orderkey") % 90).cast("string"), F.lit(" % of "), F.col("o_orderkey").cast("string"), F.lit(" items"))
    return orders.select(s.alias("s")).select("s", F.array_join(tx.amounts(F.col("s")), ",").alias("amounts"), F.array_join(tx.figures(F.col("s")), ",").alias("figures"))


NEG = "'(?i)\\b(not|never|no|without|nicht|kein|pas|jamais|sans|nunca|sin)\\b'"


@query("sca18_negation_count", f"SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(text, '\\s+', '  ', 'g'), {NEG})) AS BIGINT) AS negations FROM documents WHERE lang = 'en'")
def _(documents):
    return documents.where("lang = 'en'").select("doc_id", tx.negations(F.col("text")).alias("negations"))


PROSE = """WITH t AS (SELECT o_orderkey AS id, concat('The fee shall be $', o_custkey, ' due 2024-01-', lpad(CAST(1 + o_orderkey % 28 AS VARCHAR), 2, '0'), '.') AS before,
concat('The fee ', CASE WHEN o_orderkey % 5 = 0 THEN 'may' ELSE 'shall' END, CASE WHEN o_orderkey % 7 = 0 THEN ' not' ELSE '' END, ' be $', o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END, ' due 2024-01-', lpad(CAST(1 + (o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) % 28 AS VARCHAR), 2, '0'), '.') AS after FROM orders)
SELECT id, array_to_string(list_sort(list_filter([CASE WHEN id % 3 = 0 THEN 'amount_changed' END, CASE WHEN id % 11 = 0 THEN 'date_changed' END, CASE WHEN id % 7 = 0 THEN 'negation_changed' END, CASE WHEN id % 5 = 0 THEN 'obligation_softened' END], lambda x: x IS NOT NULL)), ',') AS rules FROM t"""


def prose(orders):
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.lit
    day = lambda d: F.lpad((1 + d % 28).cast("string"), 2, "0")
    before = F.concat(s("The fee shall be $"), c.cast("string"), s(" due 2024-01-"), day(k), s("."))
    after = F.concat(s("The fee "), F.when(k % 5 == 0, "may").otherwise("shall"), F.when(k % 7 == 0, " not").otherwise(""), s(" be $"), (c + F.when(k % 3 == 0, 1).otherwise(0)).cast("string"), s(" due 2024-01-"), day(k + F.when(k % 11 == 0, 1).otherwise(0)), s("."))
    return orders.select(k.alias("id"), before.alias("before"), after.alias("after"))


@query("sca19_text_rules", PROSE)
def _(orders):
    return prose(orders).select("id", F.array_join(tx.text_rules(F.col("before"), F.col("after")), ",").alias("rules"))


RULES = PROSE.replace("SELECT id, array_to_string(list_sort(list_filter(", "SELECT id % 50 AS doc, id, unnest(list_filter(").replace(", lambda x: x IS NOT NULL)), ',') AS rules FROM t", ", lambda x: x IS NOT NULL)) AS rule FROM t")


@query("agg24_document_severity", f"WITH f AS ({RULES}), s AS (SELECT *, CASE rule WHEN 'date_changed' THEN 1 ELSE 2 END AS r FROM f), p AS (SELECT doc, rule, max(r) AS r, count(*) AS n FROM s GROUP BY doc, rule), g AS (SELECT doc, max(r) AS r, sum(greatest(n - 40, 0)) AS o FROM p GROUP BY doc) SELECT d.doc, CASE g.r WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, CAST(coalesce(o, 0) AS BIGINT) AS overflow FROM (SELECT DISTINCT o_orderkey % 50 AS doc FROM orders) d LEFT JOIN g USING (doc)")
def _(orders):
    p = prose(orders).withColumn("doc", F.col("id") % 50)
    return dc.document_severity(p.select("doc", F.explode(tx.text_rules(F.col("before"), F.col("after"))).alias("rule")), p)


@query("sca30_whole_word", "SELECT doc_id, list_contains(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), 'the') AS named FROM documents")
def _(documents):
    return documents.select("doc_id", tx.whole_word(F.col("text"), F.lit("the")).alias("named"))


@query("sca31_word_set", "SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))) AS BIGINT) AS words FROM documents")
def _(documents):
    return documents.select("doc_id", F.size(tx.words(F.col("text"))).alias("words"))


@query("joi39_identifier_intersection", "WITH a AS (SELECT conv_id, list_distinct(regexp_extract_all(string_agg(text, ' '), '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM conversations GROUP BY conv_id), b AS (SELECT list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM documents WHERE doc_id = 1) SELECT conv_id, array_to_string(list_sort(list_intersect(a.w, b.w)), ',') AS shared FROM a, b")
def _(conversations, documents):
    one = documents.where("doc_id = 1").select(F.explode(tx.words(F.col("text"))).alias("w")).distinct()
    all_ = conversations.select("conv_id", F.explode(tx.words(F.col("text"))).alias("w")).distinct()
    hit = all_.join(one, "w").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("w")), ",").alias("shared"))
    return conversations.select("conv_id").distinct().join(hit, "conv_id", "left").select("conv_id", F.coalesce("shared", F.lit("")).alias("shared"))


@query("sca44_excerpt", "WITH t AS (SELECT doc_id, text, strpos(text, 'License') AS at_ FROM documents) SELECT doc_id, CASE WHEN at_ > 0 THEN CASE WHEN at_ > 21 THEN '…' ELSE '' END || substr(text, greatest(at_ - 20, 1), at_ + 27 - greatest(at_ - 20, 1)) || CASE WHEN at_ + 27 <= length(text) THEN '…' ELSE '' END END AS excerpt FROM t")
def _(documents):
    return documents.select("doc_id", tx.around(F.col("text"), "License").alias("excerpt"))


@query("sca21_relative_change", "SELECT DISTINCT a, b, CASE WHEN CAST(a AS DOUBLE) = 0 AND CAST(b AS DOUBLE) <> 0 THEN 1e300 WHEN CAST(a AS DOUBLE) <> 0 THEN abs(CAST(b AS DOUBLE) - CAST(a AS DOUBLE)) / abs(CAST(a AS DOUBLE)) END AS change FROM (SELECT CAST(l_linenumber - 1 AS VARCHAR) AS a, CAST(l_suppkey % 9 AS VARCHAR) AS b FROM lineitem)")
def _(lineitem):
    t = lineitem.select((F.col("l_linenumber") - 1).cast("string").alias("a"), (F.col("l_suppkey") % 9).cast("string").alias("b")).distinct()
    c = tx.relative_change(F.col("a"), F.col("b"))
    return t.select("a", "b", F.when(c == float("inf"), 1e300).otherwise(c).alias("change"))


@query("sca26_cell_reference", "SELECT DISTINCT ref, CAST(c AS BIGINT) AS col, CAST(r AS BIGINT) AS row FROM (SELECT concat(chr(CAST(65 + l_suppkey % 26 AS INT)), chr(CAST(65 + l_partkey % 26 AS INT)), l_linenumber) AS ref, (l_suppkey % 26 + 1) * 26 + l_partkey % 26 + 1 AS c, l_linenumber AS r FROM lineitem)")
def _(lineitem):
    ref = F.concat(F.chr((65 + F.col("l_suppkey") % 26)), F.chr((65 + F.col("l_partkey") % 26)), F.col("l_linenumber").cast("string"))
    return lineitem.select(ref.alias("ref")).distinct().select("ref", tx.column_number(F.col("ref")).alias("col"), tx.row_number_of(F.col("ref")).alias("row"))


@query("srt13_cell_order", "WITH c AS (SELECT DISTINCT chr(CAST(65 + l_suppkey % 26 AS INT)) || CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE '' END AS letters, l_linenumber * 5 AS r FROM lineitem) SELECT letters || CAST(r AS VARCHAR) AS ref FROM c ORDER BY r, length(letters), letters LIMIT 60")
def _(lineitem):
    ref = F.concat(F.chr((65 + F.col("l_suppkey") % 26)), F.when(F.col("l_suppkey") % 2 == 0, "A").otherwise(""), (F.col("l_linenumber") * 5).cast("string"))
    return lineitem.select(ref.alias("ref")).distinct().orderBy(tx.row_number_of(F.col("ref")), tx.column_number(F.col("ref"))).limit(60)


JOIN = "WITH j AS (SELECT coalesce(a.sheet, b.sheet) AS sheet, coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col, a.value AS va, b.value AS vb, a.formula AS fa, b.formula AS fb, a.sheet IS NOT NULL AS ina, b.sheet IS NOT NULL AS inb FROM cells_before a FULL JOIN cells_after b ON a.sheet = b.sheet AND a.row = b.row AND a.col = b.col), n AS (SELECT *, TRY_CAST(va AS DOUBLE) AS x, TRY_CAST(vb AS DOUBLE) AS y, TRY_CAST(regexp_extract(fa, ':A([0-9]+)', 1) AS INT) AS ea, TRY_CAST(regexp_extract(fb, ':A([0-9]+)', 1) AS INT) AS eb FROM j), r AS (SELECT *, CASE WHEN NOT inb THEN 'removed' WHEN NOT ina THEN 'added' WHEN fa = fb AND va = vb THEN 'same' WHEN fa = fb AND fb <> '' THEN 'recomputed' ELSE 'modified' END AS change, CASE WHEN NOT inb AND fa <> '' THEN 'formula_removed' WHEN NOT inb OR NOT ina THEN '' WHEN fa <> '' AND fb = '' THEN CASE WHEN va = vb AND va <> '' THEN 'formula_hardcoded' ELSE 'formula_overwritten' END WHEN fa = '' AND fb <> '' THEN '' WHEN fa <> fb THEN CASE WHEN eb < ea THEN 'range_reduced' ELSE 'formula_changed' END WHEN va <> vb AND fb <> '' AND starts_with(vb, '#') AND NOT starts_with(va, '#') THEN 'error_appeared' WHEN va <> vb AND fb <> '' AND ((x = 0 AND y <> 0) OR (x <> 0 AND abs(y - x) / abs(x) >= 0.1)) THEN 'result_moved' ELSE '' END AS rule FROM n)"


@query("joi24_cell_compare", JOIN + " SELECT sheet, CAST(row AS BIGINT) AS row, col, change, rule FROM r WHERE change <> 'same'")
def _(cells_before, cells_after):
    return dc.compare_cells(cells_before, cells_after)


@query("sca27_cell_rules", JOIN + " SELECT rule, count(*) AS n FROM r WHERE change <> 'same' AND rule <> '' GROUP BY rule")
def _(cells_before, cells_after):
    return dc.compare_cells(cells_before, cells_after).where("rule <> ''").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("joi25_workbook_compare", "SELECT coalesce(a.sheet, b.sheet) AS sheet, CASE WHEN b.sheet IS NULL THEN 'removed' WHEN a.sheet IS NULL THEN 'added' ELSE 'kept' END AS change FROM (SELECT DISTINCT sheet FROM cells_before) a FULL JOIN (SELECT DISTINCT sheet FROM cells_after) b ON a.sheet = b.sheet")
def _(cells_before, cells_after):
    return dc.compare_workbooks(cells_before, cells_after)


FORM = "WITH f AS (SELECT DISTINCT l_suppkey % 7 + 2 AS a, l_partkey % 7 + 2 AS b, CAST(l_linenumber AS BIGINT) AS k FROM lineitem)"


def formulas(lineitem):
    t = lineitem.select((F.col("l_suppkey") % 7 + 2).alias("a"), (F.col("l_partkey") % 7 + 2).alias("b"), F.col("l_linenumber").alias("k")).distinct()
    f = lambda c, k: F.concat(F.lit("SUM(B2:B"), F.col(c).cast("string"), F.lit(")*"), k.cast("string"))
    return t.withColumn("x", f("a", F.col("k"))).withColumn("y", f("b", F.col("k") + F.when(F.col("a") == F.col("b"), 1).otherwise(0)))


@query("sca22_formula_ranges", FORM + " SELECT a, b, k, CAST(2 AS BIGINT) AS col, CAST(2 AS BIGINT) AS top, a AS bottom FROM f")
def _(lineitem):
    return formulas(lineitem).withColumn("r", dc.areas(F.col("x"))[0]).select("a", "b", "k", F.col("r.c1").alias("col"), F.col("r.r1").alias("top"), F.col("r.r2").cast("bigint").alias("bottom"))


@query("sca23_range_shrunk", FORM + " SELECT a, b, k, b < a AS shrunk FROM f")
def _(lineitem):
    return formulas(lineitem).select("a", "b", "k", dc.shrunk(F.col("x"), F.col("y")).alias("shrunk"))


@query("sca24_constants_changed", FORM + " SELECT a, b, k, a = b AS changed FROM f")
def _(lineitem):
    return formulas(lineitem).select("a", "b", "k", dc.constants_changed(F.col("x"), F.col("y")).alias("changed"))


@query("sca28_formula_rules", FORM + " SELECT a, b, k, CASE WHEN b < a THEN 'range_reduced' WHEN a = b THEN 'constant_changed' ELSE 'formula_changed' END AS rule FROM f")
def _(lineitem):
    return formulas(lineitem).select("a", "b", "k", dc.formula_rule(F.col("x"), F.col("y")).alias("rule"))


@query("sca25_shift_formula", FORM + " SELECT a, b, k, concat('$A', CAST(a + k AS VARCHAR), '+D$', CAST(b AS VARCHAR)) AS shifted FROM f", python=True)
def _(lineitem):
    @F.pandas_udf("string")
    def shift(f: pd.Series, to: pd.Series) -> pd.Series:
        return pd.Series([dc.shift_formula(x, "B1", y) for x, y in zip(f, to, strict=True)])

    f = F.concat(F.lit("$A"), F.col("a").cast("string"), F.lit("+C$"), F.col("b").cast("string"))
    return formulas(lineitem).select("a", "b", "k", shift(f, F.concat(F.lit("C"), (F.col("k") + 1).cast("string"))).alias("shifted"))


@query("set5_multiset_equality", "SELECT a.l_orderkey AS id, list_sort(list(l_linenumber)) = list_sort(list(CAST(8 - l_linenumber AS INTEGER))) AS same FROM lineitem a GROUP BY 1")
def _(lineitem):
    return lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(core.same_multiset(F.collect_list("l_linenumber"), F.collect_list(8 - F.col("l_linenumber"))).alias("same"))


@query("set7_newly_hidden", "SELECT l_orderkey AS id, array_to_string(list_sort(list_filter(list(DISTINCT l_linenumber) FILTER (l_returnflag = 'A'), lambda x: NOT list_contains(coalesce(list(l_linenumber) FILTER (l_returnflag = 'R'), []), x))), ',') AS hidden FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'A') > 0")
def _(lineitem):
    c = lambda f: F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_linenumber")))
    g = lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(c("A").alias("cur"), c("R").alias("old")).where("size(cur) > 0")
    return g.select("id", F.array_join(core.newly(F.col("cur"), F.col("old")), ",").alias("hidden"))


@query("joi26_slide_compare", "WITH a AS (SELECT o_custkey % 100 AS doc, o_orderkey AS id, o_orderkey AS number FROM orders WHERE o_orderkey % 4 <> 0), b AS (SELECT o_custkey % 100 AS doc, o_orderkey AS id, o_orderkey + CASE WHEN o_custkey % 100 < 10 AND o_orderkey % 50 = 1 THEN 3000000 ELSE 0 END AS number FROM orders WHERE o_orderkey % 6 <> 0), j AS (SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.id, b.id) AS id, a.number AS na, b.number AS nb FROM a FULL JOIN b ON a.doc = b.doc AND a.id = b.id) SELECT doc, count(*) FILTER (na IS NULL) AS added, count(*) FILTER (nb IS NULL) AS removed, list(id ORDER BY na) FILTER (na IS NOT NULL AND nb IS NOT NULL) <> list(id ORDER BY nb) FILTER (na IS NOT NULL AND nb IS NOT NULL) AS moved FROM j GROUP BY doc")
def _(orders):
    d, k = (F.col("o_custkey") % 100).alias("doc"), F.col("o_orderkey")
    a = orders.where("o_orderkey % 4 <> 0").select(d, k.alias("id"), k.alias("number"))
    b = orders.where("o_orderkey % 6 <> 0").select(d, k.alias("id"), (k + F.when((F.col("o_custkey") % 100 < 10) & (k % 50 == 1), 3000000).otherwise(0)).alias("number"))
    return dc.sequence_moved(a, b)


@query("joi28_edit_finding_tie", "WITH f AS (SELECT o_orderkey AS id, o_custkey % 500 AS place, o_orderpriority AS before, o_orderkey % 700 AS after FROM orders WHERE o_orderkey % 5 = 0), c AS (SELECT o_orderkey AS id, o_custkey % 500 AS place, o_orderpriority AS before, o_orderkey % 700 AS after FROM orders WHERE o_orderkey % 5 = 1 AND o_orderkey % 3 = 0) SELECT DISTINCT f.id AS finding, c.id AS change FROM f JOIN c ON f.place = c.place OR (f.before = c.before AND f.after = c.after)")
def _(orders):
    t = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 500).alias("place"), F.col("o_orderpriority").alias("before"), (F.col("o_orderkey") % 700).alias("after"))
    return dc.tied(t.where("id % 5 = 0"), t.where("id % 5 = 1 AND id % 3 = 0"))


@query("joi27_text_mentions", "WITH t(term, source) AS (VALUES ('the erent', -1), ('License', -1), ('der', -1), ('and the', 1)), p AS (SELECT doc_id AS passage, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10ffff}]+'), ' ') || ' ' AS flat FROM documents) SELECT DISTINCT term, passage FROM t JOIN p ON contains(flat, ' ' || lower(term) || ' ') AND passage <> source")
def _(documents):
    terms = documents.sparkSession.createDataFrame([("the erent", -1), ("License", -1), ("der", -1), ("and the", 1)], "term string, source bigint")
    return dc.mentions(terms, documents.select(F.col("doc_id").alias("id"), "text"))


@query("win15_ordered_updates", "SELECT arg_max(topic, seq) AS title, arg_max(comment, seq) AS text, min(seq) AS first FROM feedback GROUP BY lower(topic), alert_id HAVING arg_max(vote, seq) <> 'down'")
def _(feedback):
    u = feedback.select(F.concat_ws("/", "topic", "alert_id").alias("title"), F.when(F.col("vote") == "down", "obsolete").otherwise("rule").alias("kind"), F.col("comment").alias("text"), "seq")
    return dc.ordered_updates(u).select(F.split("title", "/")[0].alias("title"), "text", "first")


@query("evd16_package_rules", "SELECT part, kind FROM (SELECT p_partkey AS part, CASE p_size % 3 WHEN 0 THEN 'macro' WHEN 1 THEN 'external_link' ELSE 'embedded_object' END AS kind FROM part WHERE p_partkey % 2 = 0) EXCEPT SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'macro' WHEN 1 THEN 'external_link' ELSE 'embedded_object' END FROM part WHERE p_partkey % 3 = 0")
def _(part):
    k = F.when(F.col("p_size") % 3 == 0, "macro").when(F.col("p_size") % 3 == 1, "external_link").otherwise("embedded_object")
    t = part.select(F.col("p_partkey").alias("part"), k.alias("kind"))
    return dc.package_findings(t.where("part % 3 = 0"), t.where("part % 2 = 0"))


@query("sca29_alert_topic", "SELECT id, CASE WHEN kind = 'coverage' THEN 'coverage' WHEN severity IN ('high', 'critical') THEN concat('risk:', kind) ELSE concat('signal:', kind) END AS topic FROM signals")
def _(signals):
    return signals.select("id", tx.alert_topic(F.col("kind"), F.col("severity")).alias("topic"))


@query("sca32_config_assignment", "SELECT DISTINCT line, regexp_extract(line, '^ARG ([A-Za-z_][A-Za-z0-9_]*)=([A-Za-z0-9_./:@+-]+)$', 1) AS name, regexp_extract(line, '^ARG ([A-Za-z_][A-Za-z0-9_]*)=([A-Za-z0-9_./:@+-]+)$', 2) AS value FROM (SELECT concat(CASE WHEN p_partkey % 4 = 0 THEN 'RUN ' ELSE 'ARG ' END, 'V', p_size % 9, '=', p_partkey % 50) AS line FROM part)")
def _(part):
    line = F.concat(F.when(F.col("p_partkey") % 4 == 0, "RUN ").otherwise("ARG "), F.lit("V"), (F.col("p_size") % 9).cast("string"), F.lit("="), (F.col("p_partkey") % 50).cast("string"))
    return part.select(line.alias("line")).distinct().select("line", tx.assignment(F.col("line")).alias("a")).select("line", "a.*")


@query("sca33_edit_hash", "SELECT path, sha256(string_agg(kind || ' ' || content, chr(10) ORDER BY line)) AS key FROM diff_lines WHERE kind <> 'context' GROUP BY path")
def _(diff_lines):
    return diff_lines.where("kind <> 'context'").groupBy("path").agg(tx.edit_key(F.collect_list(F.struct("line", "kind", "content"))).alias("key"))


@query("sca34_dependency_name", "SELECT DISTINCT p_name AS name, CASE WHEN p_size % 2 = 0 THEN regexp_replace(lower(p_name), '[-_. ]+', '-', 'g') ELSE p_name END AS normal, CAST(p_size % 2 AS BIGINT) AS ecosystem FROM part")
def _(part):
    return part.select(F.col("p_name").alias("name"), (F.col("p_size") % 2).alias("ecosystem")).distinct().select("name", tx.dependency_name(F.col("name"), F.when(F.col("ecosystem") == 0, "python").otherwise("npm")).alias("normal"), "ecosystem")


@query("sca37_language_of_path", "SELECT path, CASE lower(regexp_extract(path, '\\.([^./]*)$', 1)) WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'typescript' WHEN 'rs' THEN 'rust' ELSE '' END AS language FROM paths")
def _(paths):
    return paths.select("path", fp.language(F.col("path")).alias("language"))


@query("sca38_exported_name", "SELECT name, regexp_matches(regexp_extract(name, '[^.]*$'), '^[A-Z]') AS exported FROM nodes")
def _(nodes):
    return nodes.select("name", tx.exported(F.col("name")).alias("exported"))


@query("sca39_shortstat", "SELECT DISTINCT CAST(p_size AS BIGINT) AS files, p_partkey % 40 AS insertions, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 7 ELSE 0 END AS deletions FROM part WHERE p_partkey % 40 > 1")
def _(part):
    k, s = F.col("p_partkey"), F.lit
    line = F.concat(s(" "), F.col("p_size").cast("string"), s(" files changed, "), (k % 40).cast("string"), s(" insertions(+)"), F.when(k % 3 == 0, F.concat(s(", "), (k % 7).cast("string"), s(" deletions(-)"))).otherwise(""))
    return part.where("p_partkey % 40 > 1").select(src.shortstat(line).alias("r")).select("r.*").distinct()


@query("sca41_tokens_digest", "SELECT doc_id, sha256(array_to_string(regexp_extract_all(regexp_replace(text, '\\[[^\\]]*\\]', '', 'g'), '[^ \\n\\t\\r]+'), ' ')) AS digest FROM documents")
def _(documents):
    return documents.select("doc_id", tx.tokens_digest(F.col("text")).alias("digest"))


# Parsers: texts are rendered from rows of the tables, parsed, and held against the rows.


#: Lines of the largest tables are dealt to so many parts by their text, once: what takes the texts apart again needs no other shuffle.
PARTS = 128


def rendered(df, key, line, order, parts=None):
    """A text of each key: its lines in order; lines are dealt to ``parts`` where given."""
    df = df.select(key.cast("string").alias("id"), *order, line.alias("_t"))
    if parts:
        df = df.repartition(parts, "id")
    g = df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*order, "_t"))).alias("l"))
    return g.select("id", F.array_join(F.transform("l", lambda x: x["_t"]), "\n").alias("text"))


def s(c):
    return F.col(c).cast("string")


def hundreds(c, size=100):
    """Texts are of so many keys, however large the table."""
    return F.floor(F.col(c) / size)


@query("src10_block_profile", "SELECT CAST(l_orderkey // 100 AS VARCHAR) AS id, concat('f', l_suppkey % 5, '.go') AS file, CAST(l_linenumber AS BIGINT) AS start_line, CAST(l_linenumber + 2 AS BIGINT) AS end_line, CAST(max(l_partkey % 3) AS BIGINT) AS stmts, CAST(sum(l_suppkey % 4) AS BIGINT) AS count FROM lineitem GROUP BY ALL")
def _(lineitem):
    line = F.concat(F.lit("f"), (F.col("l_suppkey") % 5).cast("string"), F.lit(".go:"), s("l_linenumber"), F.lit(".1,"), (F.col("l_linenumber") + 2).cast("string"), F.lit(".9 "), (F.col("l_partkey") % 3).cast("string"), F.lit(" "), (F.col("l_suppkey") % 4).cast("string"))
    t = rendered(lineitem, hundreds("l_orderkey"), line, ["l_orderkey", "l_linenumber"])
    return src.block_profile(t.select("id", F.concat(F.lit("mode: count\n"), "text").alias("text")))


@query("src9_coverage_sniff", "SELECT CAST(r_regionkey AS VARCHAR) AS id, CASE r_regionkey % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'lcov' ELSE 'unknown' END AS format FROM region")
def _(region):
    k = F.col("r_regionkey") % 3
    return src.coverage_format(region.select(s("r_regionkey").alias("id"), F.when(k == 0, "\n mode: set\nx").when(k == 1, "TN:\nSF:a").otherwise("<xml>").alias("text")))


@query("src11_lcov", "SELECT CAST(l_orderkey // 100 AS VARCHAR) AS id, concat('f', l_orderkey, '.ts') AS file, CAST(l_linenumber AS BIGINT) AS line, CAST(least(sum(l_suppkey * 100000000), 1073741824) AS BIGINT) AS count FROM lineitem GROUP BY ALL")
def _(lineitem):
    line = F.concat(F.lit("SF:f"), s("l_orderkey"), F.lit(".ts\nDA:"), s("l_linenumber"), F.lit(","), (F.col("l_suppkey") * 100000000).cast("string"), F.lit("\nend_of_record"))
    return src.lcov(rendered(lineitem, hundreds("l_orderkey"), line, ["l_orderkey", "l_linenumber", "l_suppkey"], PARTS))


# A file per order, of two hunks; two in three lines look like headers once their sign is before them; every seventh file is deleted.
PATCH = "WITH u AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber > 3 AS g, CASE min(l_returnflag) WHEN 'A' THEN 'add' WHEN 'R' THEN 'delete' ELSE 'context' END AS kind FROM lineitem GROUP BY ALL)"


def patch(lineitem):
    text = hundreds("l_orderkey", 50).cast("string").alias("id")
    u = lineitem.select(text, "l_orderkey", "l_linenumber", "l_returnflag").repartition(PARTS, "id").groupBy("id", "l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    sign = F.when(F.col("f") == "A", "+").when(F.col("f") == "R", "-").otherwise(" ")
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    line = F.concat(sign, F.when(n % 3 == 0, "-- ").when(n % 3 == 1, "++ ").otherwise(""), F.lit("line "), s("l_linenumber"))
    hunks = u.groupBy("id", "l_orderkey", (n > 3).alias("g")).agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), line.alias("t")))).alias("l"), F.count_if(F.col("f") != "A").alias("o"), F.count_if(F.col("f") != "R").alias("w"))
    start = lambda a, b: F.when(F.col("g"), a).otherwise(b)
    head = F.concat(F.lit("@@ -"), start("110", "10"), F.lit(","), s("o"), F.lit(" +"), start("120", "20"), F.lit(","), s("w"), F.lit(" @@ fn\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n"))
    files = hunks.groupBy("id", "l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", head.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    name, gone = s("l_orderkey"), k % 7 == 0
    body = F.concat(F.lit("diff --git a/f"), name, F.lit(" b/f"), name, F.when(gone, "\ndeleted file mode 100644").otherwise(""), F.lit("\n--- a/f"), name, F.lit("\n+++ "), F.when(gone, "/dev/null").otherwise(F.concat(F.lit("b/f"), name)), F.lit("\n"), "t")
    return rendered(files, F.col("id"), body, ["l_orderkey"])


PARSED = PATCH + ", p AS (SELECT k, CAST(k // 50 AS VARCHAR) AS id, concat('f', k) AS path, dense_rank() OVER (PARTITION BY k // 50 ORDER BY k) AS file, dense_rank() OVER (PARTITION BY k ORDER BY g) AS hunk, row_number() OVER (PARTITION BY k, g ORDER BY n) AS pos, kind, CASE WHEN g THEN 109 ELSE 9 END + count(*) FILTER (kind <> 'add') OVER (PARTITION BY k, g ORDER BY n) AS o, CASE WHEN g THEN 119 ELSE 19 END + count(*) FILTER (kind <> 'delete') OVER (PARTITION BY k, g ORDER BY n) AS w, concat(CASE n % 3 WHEN 0 THEN '-- ' WHEN 1 THEN '++ ' ELSE '' END, 'line ', n) AS content FROM u)"


@query("src3_unified_patch", PARSED + " SELECT id, file, path, hunk, pos, kind, CASE WHEN kind <> 'add' THEN o END AS old_line, CASE WHEN kind <> 'delete' THEN w END AS new_line, content FROM p")
def _(lineitem):
    return patches.unified_patch(patch(lineitem))


@query("win14_hunk_line_numbers", PARSED + " SELECT id, file, hunk, max(CASE WHEN kind <> 'add' THEN o END) AS last_old, max(CASE WHEN kind <> 'delete' THEN w END) AS last_new FROM p GROUP BY id, file, hunk")
def _(lineitem):
    return patches.unified_patch(patch(lineitem)).groupBy("id", "file", "hunk").agg(F.max("old_line").alias("last_old"), F.max("new_line").alias("last_new"))


@query("src1_diff_scan", PARSED + " SELECT id, file, path, '' AS old_path, CASE WHEN k % 7 = 0 THEN 'D' ELSE 'M' END AS status, false AS binary, count(DISTINCT hunk) AS hunks, count(*) FILTER (kind = 'add') AS additions, count(*) FILTER (kind = 'delete') AS deletions, false AS over_limit FROM p GROUP BY ALL")
def _(lineitem):
    return patches.patch_files(patch(lineitem))


#: Documents as a tree; of those whose id three divides, paths move, of every second of these with a line more; others get a line more where they are, or go.
TREE = """WITH d AS (SELECT doc_id, concat('# ', doc_id, chr(10), coalesce(text, '')) AS t FROM documents WHERE doc_id IS NOT NULL) SELECT concat(CASE WHEN doc_id % 3 = 0 THEN 'e/' ELSE 'd/' END, doc_id) AS path, CASE WHEN doc_id % 3 = 0 THEN concat('d/', doc_id) ELSE '' END AS old_path,
CASE WHEN doc_id % 3 = 0 THEN 'R' WHEN doc_id % 7 = 1 THEN 'D' ELSE 'M' END AS status, CASE WHEN doc_id % 6 = 0 THEN (strlen(t) + 1) / (strlen(t) + 3) WHEN doc_id % 3 = 0 THEN 1.0 END AS similarity FROM d WHERE doc_id % 3 = 0 OR doc_id % 7 = 1 OR doc_id % 5 = 1"""


@query("src1_tree_changes", TREE)
def _(documents, customer):
    """Customers stand in for commits, each with the half of its number as parent: the last two meet at one of these."""
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    k = F.col("c_custkey")
    commits = Tables(documents.sparkSession).save(customer.select(name(k).alias("sha"), F.when(k > 1, name(F.floor(k / 2))).alias("parent")))
    last = customer.agg(F.max("c_custkey")).first()[0] or 1
    base, head = f"c{last}", f"c{last - 1}"
    start = history.merge_base(commits, base, head)
    n = F.col("doc_id")
    text = F.concat(F.lit("# "), n.cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))  # so that no two are equal
    docs = documents.where("doc_id IS NOT NULL")
    more = F.concat(text, F.lit("\nx"))
    before = docs.select(F.lit(start).alias("sha"), F.concat(F.lit("d/"), n.cast("string")).alias("path"), text.alias("content"))
    moved = F.concat(F.when(n % 3 == 0, "e/").otherwise("d/"), n.cast("string"))
    after = docs.where("doc_id % 3 = 0 OR doc_id % 7 <> 1").select(F.lit(head).alias("sha"), moved.alias("path"), F.when((n % 6 == 0) | ((n % 3 != 0) & (n % 5 == 1)), more).otherwise(text).alias("content"))
    return git.changes(commits, before.unionByName(after), base, head)


@query("src4_hunk_header", "SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS old_start, CAST(CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey % 9 ELSE 1 END AS BIGINT) AS old_count, CAST(l_partkey % 20 AS BIGINT) AS new_start, CAST(3 AS BIGINT) AS new_count FROM lineitem")
def _(lineitem):
    line = F.concat(F.lit("@@ -"), s("l_linenumber"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(","), (F.col("l_suppkey") % 9).cast("string"))).otherwise(""), F.lit(" +"), (F.col("l_partkey") % 20).cast("string"), F.lit(",3 @@ f()"))
    return lineitem.select(src.hunk_header(line).alias("h")).select("h.*").distinct()


@query("src2_name_status", "SELECT CAST(o_orderkey // 100 AS VARCHAR) AS id, CASE o_orderkey % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'A' WHEN 2 THEN 'D' ELSE 'M' END AS status, concat('new', o_orderkey) AS path, CASE WHEN o_orderkey % 4 = 0 THEN concat('old', o_orderkey) ELSE '' END AS old_path FROM orders")
def _(orders):
    k = F.col("o_orderkey")
    rec = F.when(k % 4 == 0, F.concat(F.lit("R090\u0000old"), s("o_orderkey"), F.lit("\u0000new"), s("o_orderkey"))).otherwise(F.concat(F.when(k % 4 == 1, "A").when(k % 4 == 2, "D").otherwise("M"), F.lit("\u0000new"), s("o_orderkey")))
    t = rendered(orders, hundreds("o_orderkey"), rec, ["o_orderkey"])
    return src.name_status(t.select("id", F.regexp_replace("text", "\n", "\u0000").alias("text")))


@query("src12_framed_payload", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 <> 0 THEN text END AS payload FROM documents")
def _(documents):
    size = F.octet_length("text") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    return src.framed(documents.select(s("doc_id").alias("id"), F.concat(size.cast("string"), F.lit(":"), "text", F.lit(";")).alias("text")))


@query("src23_go_mod", "SELECT CAST(p_size AS VARCHAR) AS id, concat('example.com/m', p_partkey) AS name FROM part")
def _(part):
    t = rendered(part, F.col("p_size"), F.concat(F.lit("\texample.com/m"), s("p_partkey"), F.lit(" v1.2.3 // indirect")), ["p_partkey"])
    return src.go_mod_requires(t.select("id", F.concat(F.lit("module x\n\nrequire (\n"), "text", F.lit("\n)\nreplace a => b v1.0.0")).alias("text")))


@query("src24_package_json", "SELECT DISTINCT CAST(p_size AS VARCHAR) AS id, concat('d', p_partkey) AS name FROM part")
def _(part):
    g = part.groupBy(s("p_size").alias("id")).agg(F.map_from_entries(F.collect_list(F.when(F.col("p_partkey") % 2 == 0, F.struct(F.concat(F.lit("d"), s("p_partkey")), F.lit("1"))))).alias("dependencies"), F.map_from_entries(F.collect_list(F.when(F.col("p_partkey") % 2 == 1, F.struct(F.concat(F.lit("d"), s("p_partkey")), F.lit("1"))))).alias("devDependencies"))
    return src.package_json_deps(g.select("id", F.to_json(F.struct("dependencies", "devDependencies")).alias("text")))


@query("src25_toml_sections", "SELECT CAST(p_size AS VARCHAR) AS id, concat('d', p_partkey) AS name FROM part")
def _(part):
    t = rendered(part, F.col("p_size"), F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("[dependencies.d"), s("p_partkey"), F.lit("]\nversion = 1\n[dependencies]"))).otherwise(F.concat(F.lit("d"), s("p_partkey"), F.lit(' = "1"'))), ["p_partkey"])
    return src.toml_keys(t.select("id", F.concat(F.lit("[package]\nname = 1\n[dependencies]\n"), "text").alias("text")), ("dependencies",))


@query("src26_pyproject", "SELECT CAST(p_size AS VARCHAR) AS id, concat('dep', p_partkey) AS name FROM part")
def _(part):
    t = rendered(part, F.col("p_size"), F.concat(F.lit('"Dep'), s("p_partkey"), F.lit('>=1",')), ["p_partkey"])
    return src.pyproject_deps(t.select("id", F.concat(F.lit('[project]\ndependencies = [\n"python",\n'), "text", F.lit("\n]\n")).alias("text")))


@query("src27_requirements", "SELECT CAST(p_size AS VARCHAR) AS id, concat('dep', p_partkey) AS name FROM part WHERE p_partkey % 5 <> 0")
def _(part):
    line = F.when(F.col("p_partkey") % 5 == 0, F.lit("-r other.txt  # no")).otherwise(F.concat(F.lit("Dep"), s("p_partkey"), F.lit("==1.0  # why")))
    return src.requirements(rendered(part, F.col("p_size"), line, ["p_partkey"]))


@query("src29_lexical_imports", "SELECT CAST(p_size AS VARCHAR) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'import' ELSE 'type' END AS fact, concat('N', p_partkey) AS name, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS line FROM part")
def _(part):
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("from N"), s("p_partkey"), F.lit(" import x"))).otherwise(F.concat(F.lit("class N"), s("p_partkey"), F.lit(":")))
    return src.lexical_facts(rendered(part, F.col("p_size"), line, ["p_partkey"]), "py")


@query("src48_knowledge_base", "SELECT CAST(p_size AS VARCHAR) AS id, concat('Title ', p_partkey) AS title, 'rule' AS kind, concat('a/', p_partkey) AS path, p_name AS text FROM part")
def _(part):
    line = F.concat(F.lit("## Title "), s("p_partkey"), F.lit("\nkind: rule\npaths: a/"), s("p_partkey"), F.lit(", b\n\n"), "p_name")
    return src.knowledge_base(rendered(part, F.col("p_size"), line, ["p_partkey"])).select("id", "title", "kind", F.col("paths")[0].alias("path"), "text")


@query("src49_acceptance_criteria", "SELECT CAST(p_size AS VARCHAR) AS id, concat('AC', row_number() OVER (PARTITION BY p_size ORDER BY p_partkey)) AS criterion, concat('must ', p_partkey, ' and more') AS text FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) <= 50")
def _(part):
    line = F.concat(F.lit("- must "), s("p_partkey"), F.lit("\n  and more\n"))
    return src.criteria(rendered(part, F.col("p_size"), line, ["p_partkey"]))


@query("src50_commit_history", "SELECT CAST(o_orderkey // 2000 AS VARCHAR) AS id, row_number() OVER w AS place, concat('s', o_orderkey) AS sha, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS parents, concat('subject ', o_custkey) AS subject, count(*) OVER (PARTITION BY o_orderkey // 2000) > 300 AS limited FROM orders WINDOW w AS (PARTITION BY o_orderkey // 2000 ORDER BY o_orderkey) QUALIFY row_number() OVER w <= 300")
def _(orders):
    line = F.concat(F.lit("s"), s("o_orderkey"), F.lit("\u001fp"), s("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, " q").otherwise(""), F.lit("\u001fsubject "), s("o_custkey"))
    return src.commit_history(rendered(orders, hundreds("o_orderkey", 2000), line, ["o_orderkey"])).withColumn("parents", F.size("parents"))


@query("src8_commit_messages", "SELECT CAST(conv_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS message FROM conversations WHERE trim(text, ' ') <> ''")
def _(conversations):
    t = rendered(conversations.withColumn("t2", F.regexp_replace("text", "\u0000", "")), F.col("conv_id"), F.concat("t2", F.lit("\u0000")), ["turn"])
    m = src.commit_messages(t.select("id", F.regexp_replace("text", "\u0000(\n|$)", "\u0000").alias("text")))
    return m.withColumn("message", F.regexp_replace("message", r"^[ \n\t\r]+|[ \n\t\r]+$", ""))


@query("src38_report_decode", "SELECT CAST(ord // 100 AS VARCHAR) AS report, CAST(2 AS BIGINT) AS exit_code, id, kind, path, CAST(line AS BIGINT) AS line, severity FROM signals")
def _(signals):
    g = signals.groupBy(hundreds("ord").cast("string").alias("report")).agg(F.collect_list(F.struct("id", "kind", "path", "line", "severity")).alias("signals"))
    t = g.select(F.col("report").alias("id"), F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(2).alias("exit_code"), F.lit("?").alias("extra"), "signals")).alias("text"))
    r = t.select(F.col("id").alias("report"), "text")
    return src.report(r.select(F.col("report").alias("id"), "text").withColumn("id", F.col("id"))).toDF("report", "exit_code", "id", "kind", "path", "line", "severity")


@query("src45_push_event", "SELECT CAST(event_id AS VARCHAR) AS id, concat('org/r', user_id) AS repository, concat('c', event_id) AS commit, event_type = 'error' AS deleted, concat('b', event_id % 7) AS branch FROM events WHERE event_id % 3 <> 0")
def _(events):
    ref = F.concat(F.when(F.col("event_id") % 3 == 0, "refs/tags/b").otherwise("refs/heads/b"), (F.col("event_id") % 7).cast("string"))
    j = F.to_json(F.struct(ref.alias("ref"), F.concat(F.lit("c"), s("event_id")).alias("after"), (F.col("event_type") == "error").alias("deleted"), F.struct(F.col("user_id").alias("id"), F.concat(F.lit("org/r"), s("user_id")).alias("full_name")).alias("repository")))
    return src.push_event(events.select(s("event_id").alias("id"), j.alias("text")))


@query("src46_push_event_gitlab", "SELECT CAST(event_id AS VARCHAR) AS id, concat('org/r', user_id) AS repository, CASE WHEN event_type <> 'error' THEN concat('c', event_id) END AS commit, event_type = 'error' AS deleted, concat('b', event_id % 7) AS branch FROM events")
def _(events):
    j = F.to_json(F.struct(F.concat(F.lit("refs/heads/b"), (F.col("event_id") % 7).cast("string")).alias("ref"), F.when(F.col("event_type") != "error", F.concat(F.lit("c"), s("event_id"))).alias("checkout_sha"), F.struct(F.col("user_id").alias("id"), F.concat(F.lit("org/r"), s("user_id")).alias("path_with_namespace")).alias("project")))
    return src.push_event(events.select(s("event_id").alias("id"), j.alias("text")), "gitlab")


MESSAGE = SECRET.replace("o_orderkey", "event_id")


@query("src16_jest_report", f"SELECT CAST(user_id AS VARCHAR) AS id, concat('f', event_id % 3) AS file, concat('t', event_id) AS name, event_type AS status, concat(replace({MESSAGE}, '@n', CAST(event_id AS VARCHAR)), chr(10), 'at line ', event_id % 9) AS message FROM events")
def _(events):
    secret = F.replace(F.element_at(F.array(*(F.lit(a) for a, _ in CREDENTIALS)), (F.col("event_id") % len(CREDENTIALS) + 1).cast("int")), F.lit("@n"), s("event_id"))
    messages = F.array(secret, F.concat(F.lit("at line "), (F.col("event_id") % 9).cast("string")))
    a = events.groupBy("user_id", (F.col("event_id") % 3).alias("k")).agg(F.collect_list(F.struct(F.concat(F.lit("t"), s("event_id")).alias("fullName"), F.col("event_type").alias("status"), messages.alias("failureMessages"))).alias("assertionResults"))
    f = a.groupBy(s("user_id").alias("id")).agg(F.collect_list(F.struct(F.concat(F.lit("f"), s("k")).alias("name"), "assertionResults")).alias("testResults"))
    return src.jest_report(f.select("id", F.to_json(F.struct("testResults")).alias("text")))


@query("src17_junit_report", "SELECT CAST(user_id AS VARCHAR) AS id, concat('c', event_id % 4) AS class, concat('t', event_id) AS name, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'passed' END AS outcome FROM events")
def _(events):
    inner = F.when(F.col("event_type") == "error", "<failure>x</failure>").when(F.col("event_type") == "view", "<skipped>s</skipped>").otherwise("<system-out>o</system-out>")
    line = F.concat(F.lit('<testcase classname="c'), (F.col("event_id") % 4).cast("string"), F.lit('" name="t'), s("event_id"), F.lit('">'), inner, F.lit("</testcase>"))
    t = rendered(events, F.col("user_id"), line, ["event_id"])
    return src.junit_report(t.select("id", F.concat(F.lit("<testsuite>"), "text", F.lit("</testsuite>")).alias("text")))


OBSJ = "SELECT CAST(user_id AS VARCHAR) AS id, concat('T', event_id % 5) AS test, concat('k', event_id) AS key, event_type AS value, false AS failed FROM events WHERE event_id % 3 <> 0"


@query("src18_go_observations", OBSJ)
def _(events):
    j = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, "output").otherwise("attr").alias("Action"), F.concat(F.lit("T"), (F.col("event_id") % 5).cast("string")).alias("Test"), F.concat(F.lit("observe.k"), s("event_id")).alias("Key"), F.col("event_type").alias("Value")))
    return src.observations(rendered(events, F.col("user_id"), j, ["event_id"]))


@query("src21_fuzz_stream", "SELECT CAST(k AS VARCHAR) AS id, n AS records, CASE WHEN k % 5 = 0 THEN 'invalid' WHEN k % 3 = 0 THEN 'interrupted' ELSE 'complete' END AS state FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def _(lineitem):
    from pyspark.sql import Window

    n = lineitem.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1)
    line = F.concat(F.lit('{"i":'), (F.col("n") + F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0)).cast("string"), F.lit(',"sha256":"h","length":1}'))
    t = rendered(n, F.col("l_orderkey"), line, ["n"])
    return src.fuzz_stream(t.select("id", F.concat("text", F.when(F.col("id").cast("bigint") % 3 != 0, '\n{"state":"complete"}').otherwise("")).alias("text")))


@query("src41_folder_listing", "SELECT p AS folder, count(*) AS files FROM (SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS p FROM paths) GROUP BY p")
def _(paths):
    return paths.groupBy(fp.folder(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("files"))


@query("src5_tree_listing", "SELECT '100644' AS mode, 'blob' AS type, sha256(html) AS oid, strlen(html) AS size, url AS path FROM pages")
def _(pages):
    return git.tree(pages.select(F.col("url").alias("path"), F.col("html").alias("content")))


@query("src7_blob_read", "SELECT sha256(text) AS oid, any_value(text) AS content, count(*) AS requests FROM documents WHERE doc_id % 2 = 0 GROUP BY 1")
def _(documents):
    blobs = git.blobs(documents.select(F.col("text").alias("content")))
    return git.read_once(blobs, documents.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("oid")))


@query("ext7_snapshot_search", "SELECT doc_id, CAST(n AS BIGINT) AS line, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE list_contains(regexp_extract_all(l, '[A-Za-z_][A-Za-z0-9_]*'), 'License') WINDOW w AS (ORDER BY doc_id, n) QUALIFY row_number() OVER w <= 100 AND sum(strlen(l)) OVER w <= 4000")
def _(documents):
    return tools.search_snapshot(documents, "License", symbol=True, most_bytes=4000)


# Sequences: a common subsequence's length row by row, in SQL.

COMMON = (
    ", dp AS (SELECT id, 0 AS i, j, 0 AS v FROM x, unnest(range(0, len(b) + 1)) AS r(j) UNION ALL SELECT id, i + 1, j, max(c) OVER (PARTITION BY id ORDER BY j) FROM "
    "(SELECT d.id, d.i, d.j, CASE WHEN j > 0 AND a[i + 1] = b[j] THEN lag(v) OVER (PARTITION BY d.id ORDER BY j) + 1 ELSE v END AS c FROM dp d JOIN x USING (id) WHERE i < len(a))), "
    "n AS (SELECT id, len(a) + len(b) - 2 * v AS edits FROM dp JOIN x USING (id) WHERE i = len(a) AND j = len(b))"
)


def turns(versions, split):
    return versions.where("before IS NOT NULL").select(F.concat_ws("/", s("doc"), s("version")).alias("id"), F.split("before", split).alias("before"), F.split("after", split).alias("after"))


@query("seq1_sequence_diff", f"WITH RECURSIVE x AS (SELECT concat(doc, '/', version) AS id, string_split(before, chr(10)) AS a, string_split(after, chr(10)) AS b FROM versions WHERE before IS NOT NULL) {COMMON} SELECT id, CAST(edits AS BIGINT) AS edits, array_to_string(b, chr(10)) AS after FROM n JOIN x USING (id)", python=True)
def _(versions):
    t = turns(versions, "\n")
    return sq.apply_edits(t, sq.sequence_diff(t)).withColumn("after", F.array_join("after", "\n"))


@query("seq2_shortest_script", f"WITH RECURSIVE x AS (SELECT concat(doc, '/', version) AS id, string_split(before, ' ') AS a, string_split(after, ' ') AS b FROM versions WHERE before IS NOT NULL) {COMMON} SELECT id, CAST(edits AS BIGINT) AS edits FROM n WHERE edits > 0", python=True)
def _(versions):
    e = sq.sequence_diff(turns(versions, " "), most=None)
    return e.groupBy("id").agg(F.sum((F.col("i") >= 0).cast("int") + (F.col("j") >= 0).cast("int")).alias("edits"))


TERMS = "SELECT CAST(p_partkey AS VARCHAR) AS id, concat('Firm ', chr(CAST(65 + p_partkey % 26 AS INT)), 'abc') AS term, CASE WHEN p_partkey % 4 <> 0 THEN concat('House ', chr(CAST(65 + p_partkey % 24 AS INT)), 'xyz') END AS replacement FROM part WHERE p_partkey % 3 <> 0"


@query("seq3_replaced_terms", TERMS, python=True)
def _(part):
    k, letter = F.col("p_partkey"), lambda n: F.char(65 + F.col("p_partkey") % n)
    firm, house = F.concat(F.lit("Firm "), letter(26), F.lit("abc")), F.concat(F.lit("House "), letter(24), F.lit("xyz"))
    text = lambda name, end: F.concat(F.lit("We pay "), name, F.lit(" for "), "p_name", F.lit(" in 2024, and of the"), end)
    # Of every fourth the article goes too, so stretches and replacements don't correspond; every third keeps its term.
    after = F.when(k % 3 == 0, text(F.concat(house, F.lit(" or "), firm), F.lit(""))).when(k % 4 == 0, F.concat(F.lit("We pay "), house, F.lit(" for "), "p_name", F.lit(" in 2024, of the")))
    return sq.term_changes(part.select(k.cast("string").alias("id"), text(firm, F.lit("")).alias("before"), F.coalesce(after, text(house, F.lit(""))).alias("after")))


WORD = PROSE[: PROSE.index("SELECT id, array_to_string")] + ", r AS (" + PROSE[PROSE.index("SELECT id, array_to_string") :] + ") SELECT CAST(id // 200 AS VARCHAR) AS id, i, i AS j, rules FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id // 200 ORDER BY id) - 1 AS BIGINT) AS i FROM r) WHERE rules <> ''"


@query("seq4_word_compare", WORD, python=True)
def _(orders):
    paragraph = lambda c: F.concat(F.lit("Section "), s("id"), F.lit(". "), c)
    text = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("id", paragraph(c).alias("t")))), lambda x: x["t"]).alias(c)
    docs = prose(orders).groupBy(F.floor(F.col("id") / 200).cast("string").alias("doc")).agg(text("before"), text("after"))
    edits = sq.sequence_diff(docs.withColumnRenamed("doc", "id"))
    return edits.select("id", "i", "j", F.array_join(tx.text_rules(F.col("before"), F.col("after")), ",").alias("rules"))
