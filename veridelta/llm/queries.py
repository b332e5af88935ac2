"""Registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.session import ship

from . import centroid_clustering, chat_format, decontamination, exact_dedup, language_id, license_scan, near_dedup, packing, quality, suffix_tree, token_counts, toxicity, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of, F.lit(0).cast("bigint"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    scored = quality.classify_quality(table(spark, sf_dir, "documents"), labels, threshold=0.3)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.classify_toxicity(table(spark, sf_dir, "documents"), labels, threshold=0.5)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=5, percent=85)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = language_id.fit_languages(docs.where(fold(F.col("doc_id"), 3) != 1))
    found = language_id.predict_language(docs, learnt)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "margin")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = suffix_tree.score_texts(docs, fold(F.col("doc_id"), 5) != 1)
    return scored.withColumn("held_out", fold(F.col("doc_id"), 5) == 1)


#: A conversation of texts that look like control strings, beside the table's.
PLANTED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(PLANTED, "conv_id bigint, turn bigint, role string, text string"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    return chat_format.read_back(chat_format.format_conversations(turns, path), path)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, salt="2")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, dims=64, scale=256)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_decontamination,
        op2_exact_dedup,
        op3_packing,
        op4_license_scan,
        op5_quality,
        op6_toxicity,
        op7_near_dedup,
        op8_language_id,
        op9_token_counts,
        op10_suffix_tree,
        op11_chat_format,
        op12_centroid_clustering,
        op13_vector_codes,
    )
    return {f.__name__: f for f in ops}


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


#: Every pair that shares a shingle, and all that each document reaches: for small tables.
OP7_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reached)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id, r.doc_id = min(reached) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op4_sql() -> str:
    """The license scan in SQL, over the same phrases and templates."""
    k, grams = license_scan.K, []
    for n, (label, text, base) in enumerate([(*p, True) for p in license_scan.PHRASES] + [(*t, False) for t in license_scan.TEMPLATES]):
        w = text.split()
        grams += [f"({n}, '{label}', {base}, {len(w)}, {i}, {', '.join(repr(x) for x in w[i : i + k])})" for i in range(len(w) - k + 1)]
    return f"""
WITH RECURSIVE grams(template, label, base, size, place, t0, t1, t2) AS (VALUES {", ".join(grams)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2),
v AS (SELECT DISTINCT doc_id, template, label, base, size, i - 1 AS at_, place, i - 1 - place AS diagonal FROM p JOIN grams ON w[i] = t0 AND w[i + 1] = t1 AND w[i + 2] = t2),
a AS (SELECT DISTINCT doc_id, template, label, base, size, diagonal FROM v),
m AS (SELECT a.doc_id, a.template, a.diagonal, v.at_, v.place FROM a JOIN v ON v.doc_id = a.doc_id AND v.template = a.template AND v.diagonal BETWEEN a.diagonal AND a.diagonal + CASE WHEN a.base OR a.size < 12 THEN 0 ELSE 4 END),
c AS (SELECT *, 1 AS n FROM m UNION SELECT m.doc_id, m.template, m.diagonal, m.at_, m.place, c.n + 1 FROM c JOIN m ON m.doc_id = c.doc_id AND m.template = c.template AND m.diagonal = c.diagonal WHERE m.at_ > c.at_ AND m.place > c.place),
f AS (SELECT a.*, n / (size - 2) AS share FROM a JOIN (SELECT doc_id, template, diagonal, max(n) AS n FROM c GROUP BY ALL) USING (doc_id, template, diagonal)),
g AS (SELECT doc_id, count(*) FILTER (base AND share = 1) AS n_base, min(diagonal) FILTER (base AND share = 1) AS first_word, max(diagonal) FILTER (base AND share = 1) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (base AND share = 1)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (share >= CASE WHEN base OR size < 12 THEN 1.0 ELSE 0.8 END)), ',') AS labels, max(share) AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN g USING (doc_id)
"""


def op11_sql() -> str:
    """Turns in order, and lengths by the rule of escaping: a character more for each backslash and each control string."""
    marks = chat_format.Template().marks()
    controls = [*marks, "<|endoftext|>"]
    longer = lambda c: f"len({c}) + len({c}) - len(replace({c}, '\\', ''))" + "".join(f" + (len({c}) - len(replace({c}, '{x}', ''))) // {len(x)}" for x in controls)
    planted = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in PLANTED)
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {planted}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({sum(map(len, marks))} + {longer("role")} + {longer("text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


_WHOLE = "SELECT *, list_transform(embedding, lambda x: CAST(least(greatest(floor(256 * CAST(x AS DOUBLE)), -134217728), 134217728) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = 64"


def op12_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds, one after another."""
    out = [
        f"w AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, v FROM ({_WHOLE}))",
        "x AS MATERIALIZED (SELECT rid, unnest(range(1, 65)) AS pos, unnest(v) AS val FROM w)",
        f"s AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS j, v FROM w QUALIFY j < {k})",
        "c0 AS MATERIALIZED (SELECT j, unnest(range(1, 65)) AS pos, unnest(v) AS val FROM s)",
    ]
    for r in range(rounds + 1):
        out.append(f"d{r} AS (SELECT rid, j, sum((x.val - c.val) * (x.val - c.val)) AS d FROM x JOIN c{r} c USING (pos) GROUP BY rid, j)")
        out.append(f"a{r} AS MATERIALIZED (SELECT rid, j, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, j) = 1)")
        if r < rounds:
            out.append(f"m{r} AS (SELECT j, pos, CAST(floor(sum(val) / count(*)) AS BIGINT) AS val FROM x JOIN a{r} USING (rid) GROUP BY j, pos)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, c.pos, coalesce(m.val, c.val) AS val FROM c{r} c LEFT JOIN m{r} m USING (j, pos))")
    return f"""WITH {", ".join(out)}, h AS (SELECT j, sha256(string_agg(val, ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN w USING (rid) JOIN h USING (j)"""


def op13_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same of each part."""
    width = 64 // parts
    out = [
        f"w AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, v FROM ({_WHOLE}))",
        f"x AS MATERIALIZED (SELECT rid, i // {width} AS p, i % {width} AS pos, val FROM (SELECT rid, unnest(range(0, 64)) AS i, unnest(v) AS val FROM w))",
        f"s AS (SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS j, rid FROM w WHERE vec_id IS NOT NULL QUALIFY j < {entries})",
        "c0 AS MATERIALIZED (SELECT p, j, pos, val FROM x JOIN s USING (rid))",
    ]
    for r in range(rounds + 1):
        out.append(f"d{r} AS (SELECT rid, p, j, sum((x.val - c.val) * (x.val - c.val)) AS d FROM x JOIN c{r} c USING (p, pos) GROUP BY rid, p, j)")
        out.append(f"a{r} AS MATERIALIZED (SELECT rid, p, j, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, j) = 1)")
        if r < rounds:
            out.append(f"m{r} AS (SELECT p, j, pos, CAST(floor(sum(val) / count(*)) AS BIGINT) AS val FROM x JOIN a{r} USING (rid, p) GROUP BY p, j, pos)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.j, c.pos, coalesce(m.val, c.val) AS val FROM c{r} c LEFT JOIN m{r} m USING (p, j, pos))")
    return f"""WITH {", ".join(out)}, e AS (SELECT rid, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(d) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(val, ',' ORDER BY p, j, pos)) FROM c{rounds}) AS codebooks_sha256
FROM e JOIN w USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op4_license_scan": op4_sql(), "op7_near_dedup": OP7_SQL, "op11_chat_format": op11_sql(), "op12_centroid_clustering": op12_sql(), "op13_vector_codes": op13_sql()}
