"""Comparison of observations of a base, a candidate and a repeated base run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = "[REDACTED]"
OVERSIZED = "[oversized "
KEY_BYTES, VALUE_BYTES = 200, 4096


def key_problem(key: Column) -> Column:
    """Why a key can't be compared, or an empty text."""
    bad = (key == "") | (F.octet_length(key) > KEY_BYTES) | key.rlike(r"[\s\p{Cntrl}\p{Z}]")
    return F.when(bad, "key_invalid").when(F.contains(key, F.lit(MARKER)), "key_redacted").otherwise("")


def value_problem(value: Column) -> Column:
    """Why a value can't be compared, or an empty text."""
    return F.when(F.contains(value, F.lit(MARKER)), "value_redacted").when((F.octet_length(value) > VALUE_BYTES) | F.contains(value, F.lit(OVERSIZED)), "value_too_long").otherwise("")


def build_dependent(value: Column) -> Column:
    """Whether a value looks like an address or a source position, which may differ between builds."""
    return value.rlike(r"0x[0-9a-fA-F]{8,}") | value.rlike(r"\.(go|ts|tsx|js|mjs|cjs|jsx|py):[0-9]+")


def compare(obs: DataFrame, repeated: bool = True) -> DataFrame:
    """Status and reason of each (test, key) of ``obs`` (side, test, key, value); sides are base, candidate and repeat.

    One shuffle by key: the sides are columns of one aggregate, not joins. Rows
    are sorted for it, by the key first: sorts compare the first bytes of the first
    column, and tests are few.
    ``repeated``: whether a repeat ran at all; without it a difference awaits one.
    """
    rows = obs if repeated else obs.where("side <> 'repeat'")
    n = lambda s: F.count_if(F.col("side") == s)
    v = lambda s: F.min(F.when(F.col("side") == s, F.col("value")))
    g = rows.withColumn("_problem", value_problem(F.col("value"))).groupBy("key", "test").agg(
        n("base").alias("nb"), n("candidate").alias("nc"), n("repeat").alias("nr"), v("base").alias("base"), v("candidate").alias("candidate"), v("repeat").alias("_repeat"),
        F.max(F.when(F.col("_problem") == "value_redacted", 2).when(F.col("_problem") == "value_too_long", 1)).alias("_bad"),
    )
    many = (F.col("nb") > 1) | (F.col("nc") > 1) | (F.col("nr") > 1)
    agrees = (F.col("nr") == 1) & (F.col("_repeat") == F.col("base"))
    keyed = key_problem(F.col("key"))
    same = F.col("base") == F.col("candidate")
    reason = (
        F.when(keyed != "", keyed)
        .when(many, "duplicate")
        .when(F.col("_bad") == 2, "value_redacted")
        .when(F.col("_bad") == 1, "value_too_long")
        .when((F.col("nb") == 0) & (F.col("nc") == 0), "repeat_only")
        .when((F.col("nb") == 0) | (F.col("nc") == 0), "one_revision")
        .when(same & F.lit(repeated) & ~agrees, "repeat_differs")
        .when(same, "")
        .when(build_dependent(F.col("base")) | build_dependent(F.col("candidate")), "build_dependent")
        .when(F.lit(not repeated), "awaiting_repeat")
        .when(~agrees, "repeat_differs")
        .otherwise("")
    )
    status = (
        F.when(F.col("reason").isin("repeat_only", "repeat_differs"), "UNSTABLE").when(F.col("reason") != "", "INCOMPARABLE").when(same, "EQUAL").otherwise("DIVERGED")
    )
    return g.withColumn("reason", reason).withColumn("status", status).select("test", "key", "status", "reason", "base", "candidate", (F.col("nb") > 0).alias("base_recorded"), (F.col("nc") > 0).alias("candidate_recorded"))


def outcome(rows: DataFrame) -> DataFrame:
    """One row for each test: pending before diverged before all equal before undecided, with counts by status."""
    n = lambda s: F.count_if(F.col("status") == s)
    g = rows.groupBy("test").agg(F.count(F.lit(1)).alias("keys"), n("DIVERGED").alias("diverged"), n("EQUAL").alias("equal"), n("UNSTABLE").alias("unstable"), n("INCOMPARABLE").alias("incomparable"), F.count_if(F.col("reason") == "awaiting_repeat").alias("_pending"))
    status = F.when(F.col("_pending") > 0, "NEEDS_REPEAT").when(F.col("diverged") > 0, "DIVERGED").when(F.col("equal") == F.col("keys"), "NOT_DIVERGED").otherwise("UNVERIFIED")
    return g.withColumn("status", status).drop("_pending")


def differ(obs: DataFrame) -> DataFrame:
    """Whether base and candidate of each test may have recorded different things; what isn't known counts as a difference.

    Rows are dealt by key once; sides are flags, so only values are counted distinct.
    """
    on = lambda s: F.max((F.col("side") == s).cast("int"))
    g = obs.where("side IN ('base', 'candidate')").select("test", "key", "side", "value").repartition("test", "key").groupBy("test", "key").agg(
        (on("base") + on("candidate")).alias("_sides"), F.countDistinct("value").alias("_values"), F.max((F.contains("key", F.lit(MARKER)) | F.contains("value", F.lit(MARKER))).cast("int")).alias("_hidden")
    )
    return g.groupBy("test").agg(F.bool_or((F.col("_sides") < 2) | (F.col("_values") > 1) | (F.col("_hidden") == 1)).alias("differs"))
