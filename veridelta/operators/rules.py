"""Line rules: moved lines, branch growth, and what they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions import paths

from .core import occurrence

BRANCH = r"(^|[^a-z])(if|for|case|switch|while) "
ASSERTION = r"(assert|expect)[ (]"
BRANCH_GROWTH = 5


def file_lines(docs: DataFrame) -> DataFrame:
    """path, line and content of every line of texts (doc_id, text)."""
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.posexplode(F.split("text", "\n")).alias("n", "content")).select("path", (F.col("n") + 1).alias("line"), "content")


def growth(diff: DataFrame, pattern: str = BRANCH, least: int = 1) -> DataFrame:
    """Files where added lines that match outnumber removed ones by at least ``least``."""
    hit = diff.where(F.col("content").rlike(pattern))
    g = hit.groupBy("path").agg(F.count_if(F.col("kind") == "add").alias("added"), F.count_if(F.col("kind") == "delete").alias("removed"))
    return g.where(F.col("added") - F.col("removed") >= least)


def unmoved(diff: DataFrame) -> DataFrame:
    """Removed lines that no equal added line of the file makes up for, one for one in order."""
    t = diff.withColumn("content", F.trim("content"))
    gone = occurrence(t.where("kind = 'delete'"), ["path", "content"], ["line"], "n")
    back = occurrence(t.where("kind = 'add'"), ["path", "content"], ["line"], "n").select("path", "content", "n")
    return gone.join(back, ["path", "content", "n"], "left_anti")


def first_match(diff: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Of each file and rule: the first changed line that matches, and whether lines were added, removed or both."""
    hits = F.filter(F.array(*(F.when(F.col("content").rlike(p), F.lit(k)) for k, p in rules.items())), lambda h: h.isNotNull())
    h = diff.where("kind <> 'context'").select("path", "line", "kind", F.explode(hits).alias("rule"))
    g = h.groupBy("path", "rule").agg(F.min("line").alias("line"), F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("sides"))
    return g


def file_signals(files: DataFrame) -> DataFrame:
    """Signals of whole files (path, status, additions, deletions): each rule is an item of one array, exploded."""
    p, low = F.col("path"), F.lower("path")
    rules = F.array(
        F.when(paths.is_manifest(p), "dependency_change"), F.when(low.contains("migration") | low.endswith(".sql"), "migration_change"),
        F.when(low.startswith(".github/workflows/") | low.contains("dockerfile") | low.endswith(".tf"), "infrastructure_change"), F.when(F.col("status") == "D", "file_deleted"),
        F.when(F.col("status") == "T", "file_type_change"), F.when(F.col("additions") + F.col("deletions") > 400, "large_change"),
    )
    return files.select("path", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("kind"))


def without_test_change(files: DataFrame) -> DataFrame:
    """Changed sources without a changed test in their folder or of their stem: two equal-key anti-joins, not one join on either."""
    p = F.col("path")
    tests = files.where(paths.is_test(p))
    stem = F.regexp_replace(paths.base_name(p), r"\.[^.]*$", "")
    src = files.where(paths.is_source(p) & ~paths.is_test(p) & (F.col("status") != "D")).select("path", paths.folder(p).alias("folder"), stem.alias("stem"))
    near = tests.select(paths.folder(p).alias("folder")).distinct()
    named = tests.select(paths.test_stem(p).alias("stem")).distinct()
    return src.join(near, "folder", "left_anti").join(named, "stem", "left_anti").select("path")


def function_risk(name: Column) -> Column:
    """auth, money or none, by the words in a function's name."""
    n = F.regexp_replace(name, "_", "")
    return F.when(n.rlike("(?i)(authori[sz]|authenticat|password|login|logout|csrf|permission)"), "auth").when(n.rlike("(?i)(payment|refund|charge|withdraw|deposit|balance)"), "money").otherwise("none")


def comparisons(line: Column) -> Column:
    """Whether a line has an equality with something but null, and whether it has an ordering; shifts and arrows aren't any."""
    bare = F.regexp_replace(F.regexp_replace(line, r"<<|>>|->|=>|<-", " "), r"[!=]=\s*(nil|null|None)\b", " ")
    return F.struct(bare.rlike("[!=]=").alias("equality"), bare.rlike("[<>]").alias("ordering"))


def live_paths(files: DataFrame) -> DataFrame:
    """Distinct paths of files that the change doesn't delete."""
    return files.where("status <> 'D'").select("path").distinct()
