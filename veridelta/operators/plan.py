"""Plans: drift, categories, knowledge within a budget, declared inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions import paths
from veridelta.shared import Tables


def changed_inputs(files: DataFrame, globs: list[str]) -> DataFrame:
    """Paths that any of a few declared patterns matches."""
    return files.where(paths.first_glob(F.col("path"), globs).isNotNull()).select("path").distinct()


def relevant(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries (title, ord, size, glob) whose pattern matches a changed path."""
    hit = paths.matching(files, entries).select("glob").distinct()
    return entries.join(hit, "glob", "left_semi").select("title", "ord", "size")


def within_budget(entries: DataFrame, budget: int) -> DataFrame:
    """Entries in order, each taken if it still fits; one that doesn't is passed over.

    What fits depends on all taken before, so entries are walked in order, but
    not one by one: a step takes the longest run that fits, by a running sum, and
    what can't fit any more goes. Each step but the last leaves less room, and
    only the used sum reaches the driver.
    """
    tables = Tables(entries.sparkSession)
    left, used, taken = tables.save(entries.select("ord", "title", "size")), 0, None
    while True:
        left = left.where(F.col("size") <= budget - used)
        first = left.orderBy("ord").limit(1000).withColumn("_sum", F.sum("size").over(Window.orderBy("ord")))  # of 1000 rows
        run = tables.save(first.where(F.col("_sum") <= budget - used))
        got = run.agg(F.max("ord").alias("ord"), F.sum("size").alias("size")).first()
        if got["ord"] is None:
            return run.select("title") if taken is None else taken
        used += got["size"]
        taken = run.select("title") if taken is None else taken.unionByName(run.select("title"))
        left = tables.save(left.where(F.col("ord") > got["ord"]))


def within_rows(lines: DataFrame, budget: int) -> DataFrame:
    """Hunks of each file up to the first that passes its budget of lines: from there none, so a running sum tells."""
    h = lines.groupBy("path", "hunk").agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("_sum", F.sum("n").over(Window.partitionBy("path").orderBy("hunk"))).where(F.col("_sum") <= budget).select("path", "hunk")


def drift(planned: DataFrame, changed: DataFrame, critical: list[str]) -> DataFrame:
    """Where a change departs from its plan: path, kind and severity."""
    p = F.col("path")
    outside = changed.join(planned, "path", "left_anti")
    rules = F.array(
        F.struct(F.when(paths.is_test(p), "unplanned_test").otherwise("unplanned_file").alias("kind"), F.when(paths.is_test(p), "low").otherwise("medium").alias("severity")),
        F.when(paths.first_glob(p, critical).isNotNull(), F.struct(F.lit("unannounced_critical").alias("kind"), F.lit("high").alias("severity"))),
        F.when(paths.is_manifest(p), F.struct(F.lit("unannounced_manifest").alias("kind"), F.lit("medium").alias("severity"))),
    )
    found = outside.select("path", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("path", "r.kind", "r.severity")
    return found.unionByName(planned.join(changed, "path", "left_anti").select("path", F.lit("untouched").alias("kind"), F.lit("low").alias("severity")))


def categories(signals: DataFrame) -> DataFrame:
    """Signals by category, flagged from medium severity."""
    k = F.col("kind")
    category = F.when(k == "secret", "security").when(k == "dependency", "dependencies").when(k.isin("coverage", "test_removed"), "tests").otherwise("structure")
    return signals.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("severity").isin("medium", "high", "critical")).alias("flagged"))


def evaluate(signals: DataFrame, claims: DataFrame) -> DataFrame:
    """Of each path: its signals, the claims at their lines, and whether any signal is risky."""
    c = claims.groupBy("path", "line").agg(F.min("id").alias("claim"))
    return signals.join(c, ["path", "line"], "left").groupBy("path").agg(F.count(F.lit(1)).alias("signals"), F.countDistinct("claim").alias("claims"), F.bool_or(F.col("severity").isin("high", "critical")).alias("risky"))


def drift_status(found: DataFrame) -> DataFrame:
    """One row: how many drift items there are and whether any is of at least medium severity."""
    return found.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.bool_or(F.col("severity").isin("medium", "high", "critical")), F.lit(False)).alias("drifted"))


def suite_plan(base: DataFrame, head: DataFrame, most_files: int, most_tests: int) -> DataFrame:
    """Tests (file, name, digest) of a base suite that a change may affect, and why: file_deleted, removed, modified or shared_code_changed.

    A name that a file has twice on either side is ambiguous and left out. The
    first files, then the first tests of those, are planned.
    """
    once = lambda t, d: t.groupBy("file", "name").agg(F.min("digest").alias(d), F.count(F.lit(1)).alias(f"n_{d}"))
    j = once(base, "b").join(once(head, "h"), ["file", "name"], "left").where("n_b = 1 AND coalesce(n_h, 1) = 1")
    files = head.select("file").distinct().withColumn("_there", F.lit(True))
    reason = F.when(F.col("_there").isNull(), "file_deleted").when(F.col("n_h").isNull(), "removed").when(F.col("b") != F.col("h"), "modified").otherwise("shared_code_changed")
    rows = j.join(files, "file", "left").select("file", "name", reason.alias("reason"))
    chosen = rows.select("file").distinct().orderBy("file").limit(most_files)
    return rows.join(F.broadcast(chosen), "file", "left_semi").orderBy("file", "name").limit(most_tests)  # at most most_files rows are broadcast
