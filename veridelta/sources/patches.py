"""Unified patches: lines of hunks, and what each file's part says of the file.

A line that begins with ``diff --git`` can't be one of a hunk, so texts are split
there first and a window covers one file's part. Hunks end where the counts in
their header are used up; what follows is read as headers again, so a removed
line ``-- x`` isn't taken for the header it looks like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lines import hunk_header

#: Fixed value: a change of more lines is over the limit.
MOST_LINES = 250_000
NOWHERE = "/dev/null"


def sections(texts: DataFrame) -> DataFrame:
    """id, file (from 1; 0 before the first header) and the part of each file."""
    starts = F.col("text").startswith("diff --git ").cast("int")
    return texts.select("id", starts.alias("_first"), F.posexplode(F.split("text", r"(?m)^(?=diff --git )")).alias("_n", "part")).select("id", (F.col("_n") + F.col("_first")).alias("file"), "part")


def _path(line: Column, prefix: str) -> Column:
    """The path of a header line: without its prefix, the time after a tab, quotes, and the side's folder."""
    p = F.regexp_replace(F.regexp_replace(line, f"^{prefix}", ""), "[\t\r].*$", "")
    p = F.regexp_replace(F.regexp_replace(p, '^"(.*)"$', "$1"), r"\\([\\\"])", "$1")
    return F.regexp_replace(p, "^[ab]/", "")


def _marked(texts: DataFrame) -> DataFrame:
    """id, file, n, line, and of lines of hunks: hunk, cur (its header), how much of both sides came before.

    What counts from a hunk's header on is a running sum over the file's part less
    that sum at the header, so every window has one order and lines are sorted once.
    """
    w = Window.partitionBy("id", "file").orderBy("n")
    raw = sections(texts).select("id", "file", F.posexplode(F.split("part", "\n")).alias("n", "line"))
    head = raw.withColumn("h", F.when(F.col("line").startswith("@@ "), hunk_header(F.col("line")))).withColumn("hunk", F.count("h").over(w)).withColumn("cur", F.last("h", ignorenulls=True).over(w))
    first = F.substring("line", 1, 1)
    inside = F.col("h").isNull() & (F.col("hunk") > 0)
    head = head.withColumn("_old", (inside & first.isin(" ", "-", "")).cast("int")).withColumn("_new", (inside & first.isin(" ", "+", "")).cast("int"))
    sums = head.withColumn("_olds", F.sum("_old").over(w)).withColumn("_news", F.sum("_new").over(w))
    here = lambda c: F.col(c) - F.coalesce(F.last(F.when(F.col("h").isNotNull(), F.col(c)), ignorenulls=True).over(w), F.lit(0))
    seen = sums.withColumn("old_seen", here("_olds") - F.col("_old")).withColumn("new_seen", here("_news") - F.col("_new")).drop("_old", "_new", "_olds", "_news")
    return seen.withColumn("body", inside & ((F.col("old_seen") < F.col("cur.old_count")) | (F.col("new_seen") < F.col("cur.new_count"))) & (first != "\\"))


def _pathed(marked: DataFrame) -> DataFrame:
    w = Window.partitionBy("id", "file").orderBy("n")
    header = ~F.col("body") & F.col("h").isNull()
    last = lambda p: F.last(F.when(header & F.col("line").startswith(p), _path(F.col("line"), p.replace("+", r"\+"))), ignorenulls=True).over(w)
    bodies = marked.withColumn("_new_path", last("+++ ")).withColumn("_old_path", last("--- ")).withColumn("_bodies", F.count_if("body").over(w))
    start = F.last(F.when(F.col("h").isNotNull(), F.col("_bodies")), ignorenulls=True).over(w)
    return bodies.withColumn("pos", F.col("_bodies") - start)


def unified_patch(texts: DataFrame) -> DataFrame:
    """Lines of hunks: id, file, path, hunk, pos, kind, old_line, new_line, content.

    Files are numbered in a text and hunks in a file, from 1. The path is the new
    one, or the old one of a deleted file. A hunk may leave out the blank of an
    empty context line; any other line in it that isn't one of a patch fails the
    read. Null and empty texts, and files without hunks, give no rows.
    """
    k = _pathed(_marked(texts)).where("body")
    first = F.substring("line", 1, 1)
    kind = F.when(first == "+", "add").when(first == "-", "delete").when(first.isin(" ", ""), "context").otherwise(F.raise_error(F.concat(F.lit("not a line of a patch: "), "line")))
    k = k.withColumn("kind", kind)
    path = F.when(F.col("_new_path") == NOWHERE, F.col("_old_path")).otherwise(F.coalesce("_new_path", "_old_path"))
    return k.select(
        "id", "file", path.alias("path"), "hunk", "pos", "kind",
        F.when(F.col("kind") != "add", F.col("cur.old_start") + F.col("old_seen")).alias("old_line"), F.when(F.col("kind") != "delete", F.col("cur.new_start") + F.col("new_seen")).alias("new_line"),
        F.substring("line", 2, 1 << 30).alias("content"),
    )


def patch_files(texts: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """A row for each file of a patch: id, file, path, old_path, status, binary, hunks, additions, deletions, over_limit.

    status is A, D, R, C, T or M. A change of a file's type comes as a deletion
    and an addition under the same header, and is one row. ``over_limit``: the
    whole change has more than ``most`` lines.
    """
    m = _marked(texts).where("file > 0")
    header, line = ~F.col("body") & F.col("h").isNull(), F.col("line")
    value = lambda p: F.first(F.when(header & line.startswith(p), _path(line, p.replace("+", r"\+"))), ignorenulls=True)
    has = lambda c: F.bool_or(header & c)
    g = m.groupBy("id", "file").agg(
        F.max(F.when(line.startswith("diff --git "), line)).alias("head"),
        value("--- ").alias("old"), value("+++ ").alias("new"), value("rename from ").alias("rename_from"), value("rename to ").alias("rename_to"), value("copy from ").alias("copy_from"), value("copy to ").alias("copy_to"),
        has(line.startswith("new file mode ")).alias("created"), has(line.startswith("deleted file mode ")).alias("deleted"),
        has(line.startswith("Binary files ") | (line == "GIT binary patch")).alias("binary"),
        F.count("h").alias("hunks"), F.count_if(F.col("body") & line.startswith("+")).alias("additions"), F.count_if(F.col("body") & line.startswith("-")).alias("deletions"), F.count_if("body").alias("lines"),
    )
    # Without path lines (mode only, binary) both names of the header are the same.
    same = F.regexp_replace(F.regexp_extract("head", r'^diff --git "?a/(.*?)"? "?b/\1"?\s*$', 1), r"\\([\\\"])", "$1")
    real = lambda c: F.when(F.col(c) != NOWHERE, F.col(c))
    path = F.coalesce(real("new"), F.col("rename_to"), F.col("copy_to"), real("old"), same)
    old = F.coalesce("rename_from", "copy_from", F.lit(""))
    status = F.when(F.col("rename_from").isNotNull(), "R").when(F.col("copy_from").isNotNull(), "C").when(F.col("created"), "A").when(F.col("deleted"), "D").otherwise("M")
    files = g.select("id", "file", "head", path.alias("path"), old.alias("old_path"), status.alias("status"), "binary", "hunks", "additions", "deletions", "lines")
    w = Window.partitionBy("id").orderBy("file")
    second = (F.lag("head").over(w) == F.col("head")) & (F.lag("status").over(w) == "D") & (F.col("status") == "A")
    paired = files.withColumn("_second", F.coalesce(second, F.lit(False))).withColumn("_file", F.sum(1 - F.col("_second").cast("int")).over(w))
    one = paired.groupBy("id", F.col("_file").alias("file")).agg(
        F.first("path").alias("path"), F.max("old_path").alias("old_path"), F.when(F.bool_or("_second"), "T").otherwise(F.first("status")).alias("status"),
        F.bool_or("binary").alias("binary"), *(F.sum(c).alias(c) for c in ("hunks", "additions", "deletions", "lines")),
    )
    return one.withColumn("over_limit", F.sum("lines").over(Window.partitionBy("id")) > most).drop("lines")
