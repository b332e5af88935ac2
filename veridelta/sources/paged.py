"""Paged listings and change feeds of other systems, from their pages as rows (source, page, body)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = 100


def listing(pages: DataFrame, size: int = PAGE, most: int = 1000) -> DataFrame:
    """Repositories of pages in order, up to the first page that isn't full and to ``most`` rows; archived ones are left out."""
    j = F.from_json("body", "array<struct<name string, archived boolean>>")
    p = pages.select("source", "page", j.alias("items")).withColumn("n", F.size("items"))
    w = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    read = p.withColumn("_ended", F.coalesce(F.max((F.col("n") < size).cast("int")).over(w), F.lit(0))).where("_ended = 0")
    rows = read.select("source", "page", F.posexplode("items").alias("at", "i")).where("NOT coalesce(i.archived, false)")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("page", "at"))).where(F.col("place") <= most).select("source", "place", "i.name")


def full_sync(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Files of all pages of a source and the change token taken before them, from which the feed goes on."""
    j = F.from_json("body", "array<struct<id string, name string>>")
    return pages.select("source", F.explode(j).alias("f")).select("source", "f.id", "f.name").join(tokens, "source")


def changes(pages: DataFrame) -> DataFrame:
    """The last change of each file, removed or not, in order of page and place; the token moves on only at the end of the feed."""
    j = F.from_json("body", "changes array<struct<id string, removed boolean, name string>>, next string")
    p = pages.select("source", "page", j.alias("b"))
    rows = p.select("source", "page", F.posexplode("b.changes").alias("at", "c"))
    last = rows.groupBy("source", "c.id").agg(F.max_by(F.struct("c.removed", "c.name"), F.struct("page", "at")).alias("r"))
    token = p.groupBy("source").agg(F.max_by("b.next", "page").alias("token"))
    return last.where("NOT coalesce(r.removed, false)").select("source", "id", "r.name").join(token, "source")
