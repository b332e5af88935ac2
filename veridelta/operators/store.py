"""History of runs: last-writer-wins, retention, recent views, caches, feedback and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import last_by

KEEP, RECENT = 20, 200
PENDING = ("queued", "running")


def activity_at(queued: str = "queued_at", finished: str = "finished_at") -> Column:
    """When a run was last active: the later of its end and its start."""
    return F.greatest(queued, finished)


def upsert(history: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last write of each key."""
    return last_by(history, keys, seq)


def import_new(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those of ``incoming`` whose key isn't stored."""
    return stored.unionByName(incoming.join(stored.select(*keys), keys, "left_anti"))


def retained(runs: DataFrame, keep: int = KEEP) -> DataFrame:
    """Each run with whether it is among the newest ``keep`` of its repository."""
    w = Window.partitionBy("user_key", "repo_key").orderBy(F.desc("queued_at"), "commit", "variant", "seq")
    return runs.withColumn("place", F.row_number().over(w)).withColumn("kept", F.col("place") <= keep)


def watermark(runs: DataFrame, keep: int = KEEP) -> DataFrame:
    """Of each repository: the latest activity evicted and whether an undated run was; plan variants never count."""
    gone = retained(runs, keep).where("NOT kept AND variant <> 'plan'")
    return gone.groupBy("user_key", "repo_key").agg(F.max(F.when(~F.col("status").isin(*PENDING), activity_at())).alias("through"), F.bool_or(F.col("finished_at").isNull()).alias("incomplete"))


def merge_watermarks(a: DataFrame, b: DataFrame) -> DataFrame:
    """The later watermark and either's gap, by repository."""
    return a.unionByName(b).groupBy("user_key", "repo_key").agg(F.max("through").alias("through"), F.bool_or("incomplete").alias("incomplete"))


def recent(runs: DataFrame, since: Column, limit: int = RECENT) -> DataFrame:
    """Runs of each repository that are pending, undated, or active since a time: those first, then the latest; the first ``limit``, and whether more were."""
    always = F.col("status").isin(*PENDING) | F.col("finished_at").isNull()
    w = Window.partitionBy("user_key", "repo_key")
    rows = runs.withColumn("at", F.when(~always, activity_at())).withColumn("_always", always).where(F.col("_always") | (F.col("at") >= since))
    order = w.orderBy(F.desc("_always"), F.desc_nulls_last("at"), "commit", "seq")
    return rows.withColumn("place", F.row_number().over(order)).withColumn("incomplete", F.count(F.lit(1)).over(w) > limit).where(F.col("place") <= limit)


def trim(entries: DataFrame, now: Column, days: int, most: int, most_bytes: int) -> DataFrame:
    """Entries (store, key, size, mtime) that stay: none older than ``days``; if a bound is passed, the newest within nine tenths of both."""
    fresh = entries.where(F.col("mtime") >= now - F.expr(f"INTERVAL {days} DAYS"))
    w = Window.partitionBy("store")
    newest = w.orderBy(F.desc("mtime"), "key").rowsBetween(Window.unboundedPreceding, 0)
    s = fresh.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_b", F.sum("size").over(w)).withColumn("_at", F.count(F.lit(1)).over(newest)).withColumn("_sum", F.sum("size").over(newest))
    over = (F.col("_n") > most) | (F.col("_b") > most_bytes)
    # Newest first the sums only rise, so what fits is what is left when the oldest go one by one.
    return s.where(~over | ((F.col("_at") <= most * 9 // 10) & (F.col("_sum") <= most_bytes * 9 // 10))).select(*entries.columns)


def newest(entries: DataFrame, now: Column, days: int, most: int) -> DataFrame:
    """The newest ``most`` entries of each store, none older than ``days``."""
    w = Window.partitionBy("store").orderBy(F.desc("mtime"), "key")
    return entries.where(F.col("mtime") >= now - F.expr(f"INTERVAL {days} DAYS")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def latest_votes(feedback: DataFrame) -> DataFrame:
    """The last vote of each author on each alert of a commit, in order of writing."""
    return last_by(feedback.where("vote <> ''"), ["commit", "alert_id", "author"], "seq")


def vote_counts(feedback: DataFrame) -> DataFrame:
    """Votes up and down by the topic of each latest vote."""
    return latest_votes(feedback).groupBy("topic").agg(F.count_if(F.col("vote") == "up").alias("up"), F.count_if(F.col("vote") == "down").alias("down"), F.count(F.lit(1)).alias("total"))


def outcomes(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Of each topic: distinct places found, and those changed in the next commit."""
    f = findings.where("topic <> '' AND path <> ''").select("base", "topic", "path").distinct()
    c = changed.select("base", "path").distinct().withColumn("_hit", F.lit(1))
    return f.join(c, ["base", "path"], "left").groupBy("topic").agg(F.count(F.lit(1)).alias("found"), F.count("_hit").alias("addressed"))


def history(runs: DataFrame, repo: str, limit: int | None = None) -> DataFrame:
    """The runs of a repository, newest first; a limit makes it a top-k, not a sort of all."""
    own = runs.where(F.col("repo_key") == repo).orderBy(F.desc("queued_at"), "commit", "seq")
    return own.limit(limit) if limit is not None else own


def active(runs: DataFrame, limit: int = 100) -> DataFrame:
    """The latest runs that are queued or running."""
    return runs.where(F.col("status").isin(*PENDING)).orderBy(F.desc("queued_at"), "repo_key", "seq").limit(limit)


def recent_projection(runs: DataFrame) -> DataFrame:
    """The columns that lists of recent runs need; others aren't read."""
    return runs.select("repo_key", "commit", "status", "queued_at")


def in_window(runs: DataFrame, since: Column) -> DataFrame:
    """Runs that are pending, undated, or active since a time."""
    return runs.where(F.col("status").isin(*PENDING) | F.col("finished_at").isNull() | (activity_at() >= since))


def named(repos: DataFrame, part: str, flag: str | None = None) -> DataFrame:
    """Distinct repositories whose key holds a text, case aside; with ``flag``, only those where that column is true."""
    hit = F.contains(F.lower("repo_key"), F.lit(part.strip().lower()))
    return repos.where(hit & F.col(flag) if flag else hit).select("repo_key").distinct()


def recent_by_repo(runs: DataFrame, since: Column, limit: int = RECENT) -> DataFrame:
    """Every repository with how many recent runs it has, at most ``limit``, and the latest activity."""
    rec = recent(runs, since, limit).groupBy("user_key", "repo_key").agg(F.count("seq").alias("recent"), F.max("at").alias("latest"))
    return runs.select("user_key", "repo_key").distinct().join(rec, ["user_key", "repo_key"], "left").select("user_key", "repo_key", F.coalesce("recent", F.lit(0)).alias("recent"), "latest")


def reviewed(marks: DataFrame, yes: str = "up") -> DataFrame:
    """Commits whose latest mark says so."""
    return marks.groupBy("commit").agg(F.max_by("vote", "seq").alias("v")).where(F.col("v") == yes).select("commit")


def activity(runs: DataFrame) -> DataFrame:
    """The state of each attempt (user, repository, time queued), last write first, pending ones before others."""
    last = last_by(runs.select("user_key", "repo_key", "queued_at", "seq", "status"), ["user_key", "repo_key", "queued_at"], "seq")
    return last.withColumn("pending", F.col("status").isin(*PENDING))


def usage_per_day(runs: DataFrame) -> DataFrame:
    """Tokens of each user and day."""
    return runs.groupBy("user_key", F.to_date("queued_at").cast("string").alias("day")).agg(F.sum("size").alias("tokens"))


def usage_on(runs: DataFrame, day: str) -> DataFrame:
    """Every user with the tokens of one day, 0 where there are none."""
    used = usage_per_day(runs).where(F.col("day") == day).select("user_key", "tokens")
    return runs.select("user_key").distinct().join(used, "user_key", "left").select("user_key", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def accumulate(totals: DataFrame, learnt: DataFrame, findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Counters (topic, found, addressed) after the bases that ``learnt`` (base) doesn't hold are added: each base counts once."""
    fresh = outcomes(findings.join(learnt.select("base").distinct(), "base", "left_anti"), changed)
    return totals.select("topic", "found", "addressed").unionByName(fresh).groupBy("topic").agg(F.sum("found").alias("found"), F.sum("addressed").alias("addressed"))


def with_base(runs: DataFrame, bases: DataFrame) -> DataFrame:
    """Of each run (seq, repo_key, base_commit) the latest earlier run stored for its base; runs without one go."""
    b = bases.select(F.col("seq").alias("base_seq"), "repo_key", F.col("commit").alias("base_commit"))
    return runs.select("seq", "repo_key", "base_commit").join(b, ["repo_key", "base_commit"]).where("base_seq < seq").groupBy("seq").agg(F.max("base_seq").alias("base_seq"))


def badge(runs: DataFrame) -> DataFrame:
    """The state that each repository's last run shows."""
    last = runs.groupBy("repo_key").agg(F.max_by(F.struct("status", "critical", "high"), "seq").alias("r"))
    state = F.when(F.col("r.status").isin(*PENDING), "pending").when(F.col("r.status") == "failed", "error").when(F.col("r.critical") > 0, "blocked").when(F.col("r.high") > 0, "review").otherwise("clear")
    return last.select("repo_key", state.alias("badge"))


def read_record(records: DataFrame, key: dict[str, str], most: int | None = None, size: str = "size", value: str = "status") -> DataFrame:
    """Records of a key; with ``most``, one over that size comes without its value, marked oversized."""
    own = records
    for c, v in key.items():
        own = own.where(F.col(c) == v)
    if most is None:
        return own
    return own.withColumn(value, F.when(F.col(size) <= most, F.col(value))).withColumn("oversized", F.col(size) > most)
