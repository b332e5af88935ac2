"""Coverage of changed lines by executed blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import capped_islands, range_join

SOURCE = ("go", "py", "ts", "tsx", "js", "jsx", "mjs", "cjs", "rs")
RUNS_PER_FILE = 2


def in_scope(files: DataFrame, language: str = "go") -> DataFrame:
    """Changed files that a profile of ``language`` can measure: not deleted, of that language, no tests."""
    return files.where((F.col("status") != "D") & F.col("path").endswith(f".{language}") & ~F.col("path").endswith(f"_test.{language}"))


def merged_blocks(blocks: DataFrame) -> DataFrame:
    """One row for each (file, start, end); counts of repeats add up."""
    return blocks.groupBy("file", "start_line", "end_line").agg(F.max("stmts").alias("stmts"), F.sum("count").alias("count"))


def line_states(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """path, line and state of each line: executed if any block around it ran, else not_run, no_block, or not_measured in a file without blocks."""
    measured = blocks.select(F.col("file").alias("path")).distinct().withColumn("_measured", F.lit(True))
    found = range_join(lines.select("path", "line"), blocks.select(F.col("file").alias("path"), "start_line", "end_line", "count"), ["path"], "line", "start_line", "end_line")
    found = found.select("path", "line", "count").unionByName(lines.select("path", "line", F.lit(None).cast("bigint").alias("count")))  # lines of no block stay
    ran = found.groupBy("path", "line").agg(F.max("count").alias("_most"))
    state = F.when(F.col("_most") > 0, "executed").when(F.col("_most").isNotNull(), "not_run").when(F.col("_measured"), "no_block").otherwise("not_measured")
    return ran.join(measured, "path", "left").select("path", "line", state.alias("state"))


def file_coverage(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Counts of states by file; they add up to ``added``."""
    count = lambda s: F.count_if(F.col("state") == s)
    return line_states(lines, blocks).groupBy("path").agg(
        F.count(F.lit(1)).alias("added"), count("executed").alias("executed"), count("not_run").alias("not_run"), count("no_block").alias("no_block"), count("not_measured").alias("not_measured")
    )


def total_coverage(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Counts of states by file and, where path is null, of all files."""
    count = lambda s: F.count_if(F.col("state") == s)
    return line_states(lines, blocks).rollup("path").agg(
        F.count(F.lit(1)).alias("added"), count("executed").alias("executed"), count("not_run").alias("not_run"), count("no_block").alias("no_block"), count("not_measured").alias("not_measured")
    )


def unexecuted_runs(lines: DataFrame, blocks: DataFrame, cap: int = RUNS_PER_FILE) -> DataFrame:
    """Runs of unexecuted lines of each file, what is past ``cap`` folded into one."""
    return capped_islands(line_states(lines, blocks).where("state = 'not_run'"), ["path"], cap)
