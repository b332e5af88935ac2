"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed number of bytes. Distinct blocks are sorted
by (hash, bytes) and named by their place in that order; then names of adjacent
blocks are paired and distinct pairs sorted and named, again and again, until a
document has one name. Equal names mean equal bytes: hashes only shorten what is
compared and shuffled, and blocks that share one are told apart by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Tables

BLOCK = 1 << 13


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows with integer names that rise in the order of ``keys``."""
    return distinct.orderBy(*keys).withColumn("name", F.monotonically_increasing_id())


def name_documents(docs: DataFrame, tables: Tables, *, block: int = BLOCK, hash_block=F.xxhash64) -> DataFrame:
    """Distinct (doc_id, sha, bytes) of ``docs`` with the number of ``rows`` and the ``name`` of the text.

    Two texts are equal if and only if both their lengths and names are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    blocks = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
        .withColumn("bytes", F.octet_length("text"))
        .withColumn("sha", F.sha2("text", 256))
        .select(
            "doc_id",
            F.unhex("sha").alias("sha"),
            "bytes",
            "text",
            F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / block).cast("int")))).alias("at"),
        )
        .withColumn("block", F.substring("text", F.col("at") * block + 1, F.lit(block)))
        .withColumn("hash", hash_block("block"))
    )
    # Whole blocks are shuffled once, after equal ones of a task are merged; names of all but colliding blocks follow from the hash.
    distinct = blocks.select("hash", "block").distinct()
    hashes = tables.save(distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds")))
    colliding = hashes.where("kinds > 1").select("hash")
    names = _named(hashes, "hash").select("hash", F.col("name").alias("hash_name"), (F.col("kinds") > 1).alias("shared"))
    rows = blocks.select("doc_id", "sha", "bytes", "at", "hash").join(tables.save(names), "hash")
    if colliding.isEmpty():
        named = rows.select("doc_id", "sha", "bytes", "at", F.col("hash_name").alias("name"))
    else:
        told = _named(blocks.join(colliding, "hash", "left_semi").select("hash", "block").distinct(), "hash", "block")
        told = tables.save(told.select("hash", "block", F.col("name").alias("block_name")))
        apart = blocks.join(colliding, "hash", "left_semi").join(told, ["hash", "block"]).select("doc_id", "sha", "bytes", "at", (-1 - F.col("block_name")).alias("name"))
        named = rows.where("NOT shared").select("doc_id", "sha", "bytes", "at", F.col("hash_name").alias("name")).unionByName(apart)
    # Repeated rows give the same name at each place, so they are counted and named once.
    level = tables.save(named.groupBy("doc_id", "sha", "bytes", "at").agg(F.first("name").alias("name"), F.count(F.lit(1)).alias("rows")))
    done = [level.where(F.col("bytes") <= block).drop("at")]
    size, longest = block, level.agg(F.max("bytes")).first()[0] or 0
    level = level.where(F.col("bytes") > block)
    while size < longest:
        pairs = (
            level.groupBy("doc_id", "sha", "bytes", F.shiftright("at", 1).alias("at"))
            .agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"), F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("right"), F.max("rows").alias("rows"))
        )
        pairs = tables.save(pairs)
        names = _named(pairs.select("left", "right").distinct(), "left", "right")
        # A block without a neighbour has a pair of its own kind, with no right name.
        level = tables.save(
            pairs.alias("p").join(names.alias("n"), (F.col("p.left") == F.col("n.left")) & F.col("p.right").eqNullSafe(F.col("n.right"))).select("doc_id", "sha", "bytes", "at", "name", "rows")
        )
        size *= 2
        done.append(level.where(F.col("bytes") <= size).drop("at"))
        level = level.where(F.col("bytes") > size)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_duplicates(docs: DataFrame, *, block: int = BLOCK, hash_block=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. Of equal
    texts the row with the largest doc_id stays, and null only if all ids are;
    of repeated rows with that id one is kept and the others aren't. An empty
    table gives no rows; columns other than doc_id and text are ignored. Texts
    of any length are read whole. A text that is copied without end adds one row
    a task to each shuffle of names; what joins its group is split when skewed.
    """
    tables = Tables(docs.sparkSession)
    named = tables.save(name_documents(docs, tables, block=block, hash_block=hash_block))
    groups = named.groupBy("bytes", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    groups = tables.save(groups)  # apart from the join, which can then split a skewed group
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("copy")
    return (
        named.join(groups, ["bytes", "name"])
        .select("doc_id", "keep_id", "group_size", F.lower(F.hex("sha")).alias("text_sha256"), copy)
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each group of equal texts.

    The row with the largest doc_id stays. Rows that repeat its id and text are
    as good as it: of those, the one with the least hash of all columns (as
    JSON) stays. Columns may have any names but two that differ only in case.
    """
    tables = Tables(docs.sparkSession)
    found = tables.save(exact_duplicates(docs, block=block).select("doc_id", "kept", F.unhex("text_sha256").alias("sha")))
    # An id and text that are kept may also be dropped: those of repeated rows. There are none where ids are unique.
    keys = found.groupBy("doc_id", "sha").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("rows")).where("NOT kept OR rows > 1")
    keys = tables.save(keys.select(F.col("doc_id").alias("gone_id"), F.col("sha").alias("gone_sha"), F.col("kept").alias("repeated")))
    # The columns of ``docs`` are one struct, so no name of theirs meets one of this function.
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"))
    same = (F.col("id").eqNullSafe(F.col("gone_id"))) & (F.col("sha") == F.col("gone_sha"))
    kept = rows.join(keys, same, "left_anti").select("row")
    repeated = keys.where("repeated")
    if not repeated.isEmpty():
        first = rows.join(repeated, same, "left_semi").groupBy("id", "sha").agg(F.min_by("row", F.struct(F.xxhash64(F.to_json("row")), F.to_json("row"))).alias("row"))
        kept = kept.unionByName(first.select("row"))
    return kept.select("row.*")
