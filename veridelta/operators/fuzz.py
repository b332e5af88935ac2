"""Comparison of generated-input runs, and selection of what to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import severity_rank

#: Severity ranks above none, the highest first.
RANKS = (4, 3, 2, 1)


SIDES = ("base1", "cand1", "base2", "cand2")


def _by_side(records: DataFrame, *fields: str) -> DataFrame:
    """Of each (test, i) with a record: what is planned, and each side's record of these fields or null; rows are dealt by index once."""
    rec = F.struct(*fields)
    dealt = records.select("side", "test", "i", "planned", *fields).repartition("test", "i")
    return dealt.groupBy("test", "i").agg(F.max("planned").alias("planned"), *(F.max(F.when(F.col("side") == s, rec)).alias(s) for s in SIDES))


def _state() -> Column:
    """The class of an index: not_recorded, unstable, separating, equal, unconfirmed or diverged."""
    same = lambda a, b: (F.col(f"{a}.hash") == F.col(f"{b}.hash")) & (F.col(f"{a}.length") == F.col(f"{b}.length"))
    return (
        F.when(F.col("base1").isNull() | F.col("cand1").isNull(), "not_recorded")
        .when(F.col("base1.unstable"), "unstable")
        .when(F.col("cand1.unstable"), "separating")
        .when(same("base1", "cand1"), "equal")
        .when(F.col("base2").isNull() | F.col("cand2").isNull(), "unconfirmed")
        .when(F.col("base2.unstable") | F.col("cand2.unstable") | ~same("base1", "base2") | ~same("cand1", "cand2"), "separating")
        .otherwise("diverged")
    )


def _recorded(records: DataFrame, *fields: str) -> DataFrame:
    """Planned indices with a record, and their state; those without any are never made."""
    return _by_side(records, "hash", "length", "unstable", *fields).where("i >= 0 AND i < planned").withColumn("state", _state())


def evaluate(records: DataFrame) -> DataFrame:
    """Counts and outcome of each test; planned = compared + unstable + unconfirmed + not_recorded.

    All records of a test say the same of ``planned``. What isn't recorded is
    what is left of it, so no index without a record is listed.
    """
    n = lambda *s: F.count_if(F.col("_in") & F.col("state").isin(*s))
    k = _by_side(records, "hash", "length", "unstable").withColumn("state", _state()).withColumn("_in", (F.col("i") >= 0) & (F.col("i") < F.col("planned")))
    g = k.groupBy("test").agg(
        F.max("planned").cast("bigint").alias("planned"), n("equal", "diverged").alias("compared"), n("unstable", "separating").alias("unstable"), n("unconfirmed").alias("unconfirmed"),
        n("diverged").alias("diverged"), n("separating").alias("separating"),
    ).where("planned > 0")
    g = g.withColumn("not_recorded", F.col("planned") - F.col("compared") - F.col("unstable") - F.col("unconfirmed"))
    outcome = F.when(F.col("diverged") > 0, "diverged").when((F.col("unconfirmed") == 0) & (F.col("compared") > 0) & (F.col("separating") == 0) & (F.col("not_recorded") == 0), "not_diverged").otherwise("inconclusive")
    return g.select("test", "planned", "compared", "unstable", "unconfirmed", "not_recorded", "diverged", "separating", outcome.alias("outcome"))


def counterexample(records: DataFrame) -> DataFrame:
    """The diverged input of each test that shows best: displays that differ, then the shortest call, then the least index."""
    d = _recorded(records, "call", "display").where("state = 'diverged'").withColumn("_key", F.struct((F.col("base1.display") == F.col("cand1.display")).cast("int").alias("a"), F.octet_length("base1.call").alias("b"), F.col("i").alias("c")))
    return d.groupBy("test").agg(F.min_by(F.struct("i", F.col("base1.call").alias("input"), F.col("base1.display").alias("base"), F.col("cand1.display").alias("candidate")), "_key").alias("r")).select("test", "r.*")


def consistent(records: DataFrame) -> DataFrame:
    """Whether all sides of each test describe the same input at every index; rows are dealt by index once, then counted there."""
    return records.select("test", "i", "call").repartition("test", "i").groupBy("test", "i").agg(F.countDistinct("call").alias("_calls")).groupBy("test").agg((F.max("_calls") == 1).alias("consistent"))


def priority(targets: DataFrame, signals: DataFrame) -> DataFrame:
    """The highest severity rank of the new-side signals that overlap each target (path, name, line, end_line); 0 without one.

    Two ranges overlap if, of those that begin before one ends, the furthest end
    isn't before it: a running maximum for each rank tells that without a pair.
    Ranges that begin at one line of a file count as one.
    """
    end = F.greatest("line", "end_line")
    s = signals.where("side = 'new' AND line IS NOT NULL").select("path", F.col("line").cast("bigint").alias("_at"), end.cast("bigint").alias("_e"), severity_rank("severity").alias("_rank"))
    s = s.groupBy("path", "_at").agg(*(F.max(F.when(F.col("_rank") == r, F.col("_e"))).alias(f"_e{r}") for r in RANKS))
    asked = targets.select("path", end.cast("bigint").alias("_at")).distinct().withColumn("_asked", F.lit(True))
    w = Window.partitionBy("path").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = s.unionByName(asked, allowMissingColumns=True).select("path", "_at", "_asked", *(F.max(f"_e{r}").over(w).alias(f"_e{r}") for r in RANKS)).where("_asked").drop("_asked")
    hit = F.coalesce(*(F.when(F.col(f"_e{r}") >= F.col("line"), r) for r in RANKS), F.lit(0))
    return targets.withColumn("_at", end.cast("bigint")).join(ends, ["path", "_at"], "left").select(*targets.columns, hit.alias("priority"))


def budget(targets: DataFrame, most_packages: int, most_functions: int) -> DataFrame:
    """Which targets (dir, path, line, name, exported, priority) are planned: those of the first packages in rank order, then the first functions of those.

    Packages are few and targets of them are cut to ``most_functions`` by a top-k
    each, so no global window orders all rows.
    """
    order = [F.desc("priority"), F.desc("exported"), F.asc("path"), F.asc("line"), F.asc("name")]
    key = F.struct((-F.col("priority")).alias("a"), (~F.col("exported")).alias("b"), "path", "line", "name")
    chosen = targets.groupBy("dir").agg(F.min(key).alias("_first")).orderBy("_first").limit(most_packages).select("dir", F.lit(True).alias("_chosen"))
    marked = targets.join(F.broadcast(chosen), "dir", "left")  # at most most_packages rows
    taken = marked.where("_chosen").orderBy(*order).limit(most_functions).select("path", "line", "name", F.lit(True).alias("_taken"))
    out = marked.join(F.broadcast(taken), ["path", "line", "name"], "left")  # at most most_functions rows
    return out.select("dir", "path", "line", "name", F.when(F.col("_taken"), "planned").when(F.col("_chosen"), "function_budget").otherwise("package_budget").alias("decision"))


def changed_functions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Variants (key, sig, body, id) of functions after that match none before, as multisets; a new function isn't changed."""
    w = Window.partitionBy("key", "sig", "body").orderBy("id")
    b = before.select("key", "sig", "body", F.row_number().over(w).alias("n"))
    a = after.withColumn("n", F.row_number().over(w))
    known = before.select("key").distinct()
    sigs = before.select("key", "sig").distinct().withColumn("_same", F.lit(True))
    left = a.join(b, ["key", "sig", "body", "n"], "left_anti").join(known, "key", "left_semi").join(sigs, ["key", "sig"], "left")
    return left.select("key", "sig", "body", "id", F.when(F.col("_same"), "body_changed").otherwise("signature_changed").alias("change"))
