"""Queries on the history of runs, feedback, outcomes and event streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridelta import sinks
from veridelta.operators import core, store
from veridelta.operators import documents as dc
from veridelta.registry import query
from veridelta.shared import Tables
from veridelta.streaming import limiter, replay, state, timers

SINCE = "2024-01-20"
ACT = "greatest(queued_at, finished_at)"
LWW = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key, repo_key, commit, variant ORDER BY seq DESC) AS n FROM runs) WHERE n = 1"


@query("snk6_history_upsert", f"SELECT user_key, repo_key, commit, variant, seq, status, queued_at FROM ({LWW})")
def _(runs):
    return store.upsert(runs, ["user_key", "repo_key", "commit", "variant"]).select("user_key", "repo_key", "commit", "variant", "seq", "status", "queued_at")


RET = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_key, repo_key ORDER BY queued_at DESC, commit, variant, seq) AS place FROM runs)"


@query("snk7_upsert_and_prune", f"WITH u AS ({LWW}), r AS (SELECT *, row_number() OVER (PARTITION BY user_key, repo_key ORDER BY queued_at DESC, commit, variant, seq) AS place FROM u) SELECT user_key, repo_key, commit, variant, seq FROM r WHERE place <= 20")
def _(runs):
    return store.retained(store.upsert(runs, ["user_key", "repo_key", "commit", "variant"])).where("kept").select("user_key", "repo_key", "commit", "variant", "seq")


@query("snk8_bulk_import", "SELECT repo_key, commit, seq FROM runs WHERE seq % 3 = 0 UNION ALL SELECT repo_key, commit, seq FROM runs WHERE seq % 3 <> 0 AND (repo_key, commit) NOT IN (SELECT (repo_key, commit) FROM runs WHERE seq % 3 = 0)")
def _(runs):
    r = runs.select("repo_key", "commit", "seq")
    return store.import_new(r.where("seq % 3 = 0"), r.where("seq % 3 <> 0"), ["repo_key", "commit"])


@query("snk9_content_addressed_put", "SELECT sha256(text) AS key, min(text) AS content, left(sha256(text), 2) AS shard FROM documents GROUP BY text")
def _(documents):
    # Two puts of overlapping halves: what the first stored, the second leaves.
    at = f"{Tables(documents.sparkSession).at}/cache"
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    sinks.put_entries(texts.where("doc_id % 3 <> 0").select("content"), at)
    sinks.put_entries(texts.where("doc_id % 3 <> 1").select("content"), at)
    return sinks.read_entries(documents.sparkSession, at)


@query("snk10_graph_cache_put", "SELECT 'node' AS what, id, kind, sha256('v1|c1|most=1000') AS key FROM nodes UNION ALL SELECT 'edge', concat(src, '>', dst), kind, sha256('v1|c1|most=1000') FROM edges")
def _(nodes, edges):
    spark = nodes.sparkSession
    at = sinks.put_graph(nodes, edges, "c1", "most=1000", f"{Tables(spark).at}/graphs")
    again = sinks.put_graph(nodes.limit(0), edges.limit(0), "c1", "most=1000", at.rsplit("/", 1)[0])
    stored = lambda t, what, name: spark.read.parquet(f"{again}/{t}").select(F.lit(what).alias("what"), name.alias("id"), "kind")
    both = stored("nodes", "node", F.col("id")).unionByName(stored("edges", "edge", F.concat_ws(">", "src", "dst")))
    return both.withColumn("key", sinks.graph_key(F.lit("c1"), F.lit("most=1000")))


@query("win8_keep_newest", RET + " SELECT user_key, repo_key, seq, place, place <= 20 AS kept FROM r")
def _(runs):
    return store.retained(runs).select("user_key", "repo_key", "seq", "place", "kept")


@query("win9_keep_newest_files", RET + " SELECT user_key, repo_key, count(*) FILTER (place <= 5) AS kept, count(*) FILTER (place > 5) AS evicted FROM r GROUP BY ALL")
def _(runs):
    return store.retained(runs, 5).groupBy("user_key", "repo_key").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("evicted"))


MARK = RET + f", w AS (SELECT user_key, repo_key, max(CASE WHEN status NOT IN ('queued', 'running') THEN {ACT} END) AS through, bool_or(finished_at IS NULL) AS incomplete FROM r WHERE place > {{n}} AND variant <> 'plan' GROUP BY ALL)"


@query("agg25_retention_watermark", MARK.format(n=20) + " SELECT * FROM w")
def _(runs):
    return store.watermark(runs)


@query("agg26_retention_upsert", MARK.format(n=20) + f", w2 AS (SELECT user_key, repo_key, max(CASE WHEN status NOT IN ('queued', 'running') THEN {ACT} END) AS through, bool_or(finished_at IS NULL) AS incomplete FROM r WHERE place > 5 AND variant <> 'plan' GROUP BY ALL) SELECT user_key, repo_key, max(through) AS through, bool_or(incomplete) AS incomplete FROM (FROM w UNION ALL FROM w2) GROUP BY ALL")
def _(runs):
    return store.merge_watermarks(store.watermark(runs), store.watermark(runs, 5))


@query("sca36_window_incomplete", MARK.format(n=20) + f" SELECT user_key, repo_key, incomplete OR coalesce(through >= TIMESTAMP '{SINCE}', false) AS incomplete FROM w")
def _(runs):
    return store.watermark(runs).select("user_key", "repo_key", (F.col("incomplete") | F.coalesce(F.col("through") >= F.lit(SINCE).cast("timestamp"), F.lit(False))).alias("incomplete"))


REC = f"""WITH a AS (SELECT *, status IN ('queued', 'running') OR finished_at IS NULL AS always FROM runs), r AS (SELECT *, CASE WHEN NOT always THEN {ACT} END AS at_ FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY user_key, repo_key ORDER BY always DESC, at_ DESC NULLS LAST, commit, seq) AS place, count(*) OVER (PARTITION BY user_key, repo_key) > 30 AS incomplete FROM r WHERE always OR at_ >= TIMESTAMP '{SINCE}')"""


@query("srt6_recent", REC + " SELECT user_key, repo_key, seq, place, incomplete FROM k WHERE place <= 30")
def _(runs):
    return store.recent(runs, F.lit(SINCE).cast("timestamp"), 30).select("user_key", "repo_key", "seq", "place", "incomplete")


@query("joi37_repo_recent", REC + " SELECT r.user_key, r.repo_key, count(k.seq) AS recent, max(k.at_) AS latest FROM (SELECT DISTINCT user_key, repo_key FROM runs) r LEFT JOIN (FROM k WHERE place <= 30) k USING (user_key, repo_key) GROUP BY ALL")
def _(runs):
    return store.recent_by_repo(runs, F.lit(SINCE).cast("timestamp"), 30)


@query("srt5_history", "SELECT seq, queued_at, commit FROM runs WHERE repo_key = 'r7' ORDER BY queued_at DESC, commit, seq LIMIT 50")
def _(runs):
    return store.history(runs, "r7", 50).select("seq", "queued_at", "commit")


@query("srt16_active_analyses", "SELECT user_key, repo_key, commit, seq, queued_at FROM runs WHERE status IN ('queued', 'running') ORDER BY queued_at DESC, repo_key, seq LIMIT 100")
def _(runs):
    return store.active(runs).select("user_key", "repo_key", "commit", "seq", "queued_at")


@query("sca35_activity_timestamp", f"SELECT seq, {ACT} AS at_time FROM runs")
def _(runs):
    return runs.select("seq", store.activity_at().alias("at_time"))


@query("flt8_recent_projection", "SELECT repo_key, commit, status, queued_at FROM runs")
def _(runs):
    return store.recent_projection(runs)


@query("flt9_activity_window", f"SELECT seq FROM runs WHERE status IN ('queued', 'running') OR finished_at IS NULL OR {ACT} >= TIMESTAMP '{SINCE}'")
def _(runs):
    return store.in_window(runs, F.lit(SINCE).cast("timestamp")).select("seq")


@query("flt6_name_filter", "SELECT DISTINCT repo_key FROM runs WHERE contains(lower(repo_key), 'r1') AND critical > 0")
def _(runs):
    return store.named(runs.withColumn("risky", F.col("critical") > 0), " R1 ", "risky")


ENTRIES = "WITH e AS (SELECT user_key AS store, CAST(seq AS VARCHAR) AS key, size, queued_at AS mtime FROM runs), f AS (SELECT * FROM e WHERE mtime >= TIMESTAMP '2024-01-30' - INTERVAL 20 DAYS)"


def entries(runs):
    return runs.select(F.col("user_key").alias("store"), F.col("seq").cast("string").alias("key"), "size", F.col("queued_at").alias("mtime"))


@query("win10_size_age_eviction", ENTRIES + ", s AS (SELECT *, count(*) OVER (PARTITION BY store) AS n, sum(size) OVER (PARTITION BY store) AS b, count(*) OVER (PARTITION BY store ORDER BY mtime DESC, key ROWS UNBOUNDED PRECEDING) AS p, sum(size) OVER (PARTITION BY store ORDER BY mtime DESC, key ROWS UNBOUNDED PRECEDING) AS t FROM f) SELECT store, key, size, mtime FROM s WHERE NOT (n > 300 OR b > 20000) OR (p <= 270 AND t <= 18000)")
def _(runs):
    return store.trim(entries(runs), F.lit("2024-01-30").cast("timestamp"), 20, 300, 20000)


@query("win11_lru_ttl", ENTRIES + " SELECT store, key, size, mtime FROM f QUALIFY row_number() OVER (PARTITION BY store ORDER BY mtime DESC, key) <= 200")
def _(runs):
    return store.newest(entries(runs), F.lit("2024-01-30").cast("timestamp"), 20, 200)


VOTES = "WITH v AS (SELECT * FROM feedback WHERE vote <> '' QUALIFY row_number() OVER (PARTITION BY commit, alert_id, author ORDER BY seq DESC) = 1), t AS (SELECT topic, count(*) FILTER (vote = 'up') AS up, count(*) FILTER (vote = 'down') AS down, count(*) AS total FROM v GROUP BY topic)"


@query("agg16_latest_vote", VOTES + " SELECT * FROM t")
def _(feedback):
    return store.vote_counts(feedback)


@query("srt8_topic_ranking", VOTES + " SELECT topic, total, row_number() OVER (ORDER BY total DESC, topic) AS place FROM t ORDER BY place LIMIT 100")
def _(feedback):
    top = store.vote_counts(feedback).orderBy(F.desc("total"), "topic").limit(100)
    return top.select("topic", "total", F.row_number().over(Window.orderBy(F.desc("total"), "topic")).alias("place"))  # of 100 rows


@query("srt9_newest_comments", "SELECT topic, seq, comment FROM feedback WHERE trim(comment) <> '' QUALIFY row_number() OVER (PARTITION BY topic ORDER BY seq DESC) <= 30")
def _(feedback):
    return core.top_with_total(feedback.where("trim(comment) <> ''"), ["topic"], [F.desc("seq")], 30).select("topic", "seq", "comment")


@query("agg33_review_marks", "SELECT commit FROM feedback GROUP BY commit HAVING arg_max(vote, seq) = 'up'")
def _(feedback):
    return store.reviewed(feedback)


@query("agg31_activity_snapshot", "SELECT user_key, repo_key, queued_at, arg_max(status, seq) AS status, max(seq) AS seq, arg_max(status, seq) IN ('queued', 'running') AS pending FROM runs GROUP BY ALL")
def _(runs):
    return store.activity(runs)


@query("agg32_usage_per_day", "SELECT user_key, CAST(coalesce(sum(size) FILTER (CAST(queued_at AS DATE) = DATE '2024-01-11'), 0) AS BIGINT) AS tokens FROM runs GROUP BY user_key")
def _(runs):
    return store.usage_on(runs, "2024-01-11")


OUT = "WITH f AS (SELECT DISTINCT commit AS base, topic, alert_id AS path FROM feedback WHERE topic <> '' AND alert_id <> ''), c AS (SELECT DISTINCT commit AS base, alert_id AS path FROM feedback WHERE seq % 5 = 0)"


def found(feedback):
    return feedback.select(F.col("commit").alias("base"), "topic", F.col("alert_id").alias("path")), feedback.where("seq % 5 = 0").select(F.col("commit").alias("base"), F.col("alert_id").alias("path"))


@query("joi29_outcome_join", OUT + " SELECT topic, count(*) AS found, count(c.base) AS addressed FROM f LEFT JOIN c USING (base, path) GROUP BY topic")
def _(feedback):
    return store.outcomes(*found(feedback))


@query("agg17_outcome_accumulate", OUT + " SELECT topic, count(*) + 100 AS found, count(c.base) + 10 AS addressed FROM f LEFT JOIN c USING (base, path) WHERE f.base >= 'c15' GROUP BY topic")
def _(feedback):
    f, c = found(feedback)
    known = f.select("topic").where("topic <> ''").distinct().select("topic", F.lit(100).cast("bigint").alias("found"), F.lit(10).cast("bigint").alias("addressed"))
    return store.accumulate(known, f.where("base < 'c15'").select("base"), f, c)


@query("joi30_base_lookup", "SELECT a.seq, max(b.seq) AS base_seq FROM runs a JOIN runs b ON b.repo_key = a.repo_key AND b.commit = concat('c', CAST((a.seq + 150) % 3000 AS string)) WHERE b.seq < a.seq GROUP BY a.seq")
def _(runs):
    return store.with_base(runs.withColumn("base_commit", F.concat(F.lit("c"), ((F.col("seq") + 150) % 3000).cast("string"))), runs)


@query("sca42_badge_state", "SELECT repo_key, CASE arg_max(status, seq) WHEN 'queued' THEN 'pending' WHEN 'running' THEN 'pending' WHEN 'failed' THEN 'error' ELSE CASE WHEN arg_max(critical, seq) > 0 THEN 'blocked' WHEN arg_max(high, seq) > 0 THEN 'review' ELSE 'clear' END END AS badge FROM runs GROUP BY repo_key")
def _(runs):
    return store.badge(runs)


@query("src39_record_read", "SELECT seq, status, size FROM runs WHERE user_key = 'u3' AND repo_key = 'r3' AND variant = ''")
def _(runs):
    return store.read_record(runs, {"user_key": "u3", "repo_key": "r3", "variant": ""}).select("seq", "status", "size")


@query("src40_bounded_record_read", "SELECT seq, CASE WHEN size <= 50 THEN status END AS status, size > 50 AS oversized FROM runs WHERE repo_key = 'r5'")
def _(runs):
    return store.read_record(runs, {"repo_key": "r5"}, 50).select("seq", "status", "oversized")


# Streams: each processor runs over the events as a stream of files and is held against SQL over the same rows.


EXPIRED = "WITH a AS (SELECT user_key AS owner, seq, CAST(floor(epoch(queued_at)) AS BIGINT) AS at_, CASE WHEN status NOT IN ('queued', 'running') THEN CAST(floor(epoch(finished_at)) AS BIGINT) END AS fin FROM runs)"


@query("str5_ttl_state", EXPIRED + " SELECT owner, seq, fin + 172800 AS expired_at FROM a WHERE fin + 172800 <= (SELECT max(at_) FROM a)", python=True)
def _(runs):
    finished = F.when(~F.col("status").isin(*store.PENDING), F.unix_seconds(F.col("finished_at").cast("timestamp")))
    attempts = runs.select(F.col("user_key").alias("owner"), "seq", F.unix_seconds(F.col("queued_at").cast("timestamp")).alias("at"), finished.alias("finished"))
    return replay.replayed(attempts, "at", lambda stream: timers.expirations(stream, 48 * 3600))


@query("str7_incremental_learning", "SELECT topic, count(*) AS n, count(*) FILTER (vote = 'up') AS up FROM feedback GROUP BY topic")
def _(feedback):
    return replay.totals(feedback, "topic", {"n": F.count(F.lit(1)), "up": F.count_if(F.col("vote") == "up")})


JOBS = """WITH RECURSIVE e AS (SELECT user_key AS queue, seq, repo_key AS usr, concat(repo_key, '/', seq % 3) AS job, status NOT IN ('failed', 'done') AS submit, row_number() OVER (PARTITION BY user_key ORDER BY seq) AS n FROM runs),
w AS (SELECT queue, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, CAST([] AS VARCHAR[]) AS jobs, CAST([] AS VARCHAR[]) AS users, '' AS result FROM (SELECT DISTINCT queue FROM e)
UNION ALL SELECT queue, n, seq, CASE WHEN result = 'accepted' THEN list_append(jobs, job) WHEN NOT submit THEN list_filter(jobs, lambda x: x <> job) ELSE jobs END,
  CASE WHEN result = 'accepted' THEN list_append(users, usr) WHEN NOT submit THEN [split_part(x, '/', 1) FOR x IN jobs IF x <> job] ELSE users END, result
  FROM (SELECT e.*, jobs, users, CASE WHEN NOT submit THEN '' WHEN list_contains(jobs, job) THEN 'duplicate' WHEN len(list_filter(users, lambda x: x = usr)) >= 2 THEN 'quota' WHEN len(jobs) >= 6 THEN 'busy' ELSE 'accepted' END AS result FROM w JOIN e ON e.queue = w.queue AND e.n = w.n + 1))
SELECT queue, seq, result FROM w WHERE result <> ''"""


@query("str1_inflight_dedupe", JOBS, python=True)
def _(runs):
    kind = F.when(F.col("status").isin("failed", "done"), "end").otherwise("submit")
    events = runs.select(F.col("user_key").alias("queue"), "seq", kind.alias("kind"), F.col("repo_key").alias("user"), F.concat("repo_key", F.lit("/"), (F.col("seq") % 3).cast("string")).alias("job"))
    return replay.replayed(events, "seq", lambda stream: state.submissions(stream, 2, 6))


@query("str9_push_filter", "SELECT repo_key, commit, seq FROM runs WHERE variant = '' AND status <> 'failed' AND repo_key <> ''")
def _(runs):
    return replay.filtered(runs).select("repo_key", "commit", "seq")


@query("str11_change_feed", "SELECT key, arg_max(value, seq) AS value FROM (SELECT concat('k', CAST(user_id AS string)) AS key, event_type AS kind, CAST(event_id AS VARCHAR) AS value, event_id AS seq FROM events) GROUP BY key HAVING arg_max(kind, seq) <> 'error'")
def _(events):
    feed = events.select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq"))
    return replay.apply_feed(feed)


SCANS = """WITH RECURSIVE s AS (SELECT DISTINCT user_id % 5 AS source, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS generation, CAST(user_id AS VARCHAR) AS item FROM events),
m AS (SELECT *, (generation + source) % 3 <> 0 AS done FROM (SELECT DISTINCT source, generation FROM s)), w AS (SELECT *, lead(generation) OVER (PARTITION BY source, item ORDER BY generation) AS again FROM s)
SELECT w.source, item, min(m.generation) AS generation FROM w JOIN m ON m.source = w.source AND m.done AND m.generation > w.generation GROUP BY w.source, item, w.generation, again HAVING again IS NULL OR min(m.generation) < again"""


def scans(events):
    """A scan of each source a day; two in three are read to the end."""
    seen = events.select((F.col("user_id") % 5).alias("source"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("generation"), F.col("user_id").cast("string").alias("item"), F.lit("seen").alias("kind"))
    ends = seen.select("source", "generation").distinct()
    return seen.unionByName(ends.select("source", "generation", F.lit(None).cast("string").alias("item"), F.when((F.col("generation") + F.col("source")) % 3 != 0, "completed").otherwise("failed").alias("kind")))


@query("str12_absence_detection", SCANS, python=True)
def _(events):
    return replay.replayed(scans(events), "generation", timers.absences)


@query("str4_document_state", "SELECT user_id, event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN value > 90 THEN 'too_large' WHEN lag(event_type) OVER w IS NULL THEN 'new' WHEN lag(event_type) OVER w = event_type THEN 'clean' ELSE 'changed' END AS state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _(events):
    return replay.document_states(events)


@query("win16_version_compare", "SELECT doc, version, CASE WHEN before IS NULL THEN 'new' WHEN before = after THEN 'clean' ELSE 'changed' END AS state FROM versions")
def _(versions):
    return dc.version_states(versions)


LIMIT = """
WITH RECURSIVE e AS (SELECT event_id, user_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), w AS (SELECT min(t) AS start FROM e UNION ALL SELECT min(t) FROM w JOIN e ON t >= start + 3600 HAVING min(t) IS NOT NULL),
c AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY start, user_id ORDER BY ts, event_id) AS k FROM e ASOF JOIN w ON t >= start)
SELECT event_id, user_id, k <= 2 AS allowed FROM c"""


@query("str2_fixed_window_limiter", LIMIT, python=True)
def _(events):
    return limiter.limit(events, 3600, 2)


@query("str10_scan_loop", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(events):
    return replay.scanned(events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("str8_explanation_carry", "WITH ties AS (SELECT concat('x', seq // 5) AS explanation, alert_id AS tie FROM feedback), cur AS (SELECT DISTINCT alert_id AS tie FROM feedback WHERE alert_id NOT IN ('a4', 'a18')) SELECT explanation, bool_and(tie IN (SELECT tie FROM cur)) AS kept FROM ties GROUP BY explanation")
def _(feedback):
    ties = feedback.select(F.concat(F.lit("x"), F.floor(F.col("seq") / 5).cast("string")).alias("explanation"), F.col("alert_id").alias("tie"))
    return replay.carried(ties, feedback.where("alert_id NOT IN ('a4', 'a18')").select(F.col("alert_id").alias("tie")))


@query("str6_fan_out", "WITH s AS (SELECT user_key, seq, status, count(*) FILTER (status = 'failed') OVER (PARTITION BY user_key ORDER BY seq) AS part FROM runs) SELECT user_key, seq, row_number() OVER (PARTITION BY user_key, part ORDER BY seq) <= 3 AS delivered FROM s WHERE status <> 'failed'", python=True)
def _(runs):
    events = runs.select("user_key", "seq", F.when(F.col("status") == "failed", "read").otherwise("publish").alias("kind"))
    return replay.replayed(events, "seq", lambda stream: state.fan_out(stream, 3))


@query("snk11_event_push", "SELECT user_key, count(*) AS published, least(count(*), 32) AS delivered, greatest(count(*) - 32, 0) AS dropped FROM runs GROUP BY user_key")
def _(runs):
    return sinks.delivered(runs)
