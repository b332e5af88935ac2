"""Trees and blobs of commits, as tables of files (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridelta.operators import history
from veridelta.shared import Tables

#: Fixed value: a larger blob isn't read.
MOST_BYTES = 1_000_000


def tree(files: DataFrame, mode: str = "100644") -> DataFrame:
    """mode, type, oid, size and path of every file; a file without content is an empty blob. Object ids are SHA-256 of the content."""
    content = F.coalesce("content", F.lit(""))
    return files.select(F.lit(mode).alias("mode"), F.lit("blob").alias("type"), F.sha2(content, 256).alias("oid"), F.octet_length(content).alias("size"), "path")


def blobs(files: DataFrame) -> DataFrame:
    """oid, size and content of distinct contents."""
    content = F.coalesce("content", F.lit(""))
    return files.select(F.sha2(content, 256).alias("oid"), F.octet_length(content).alias("size"), content.alias("content")).dropDuplicates(["oid"])


def _bounded(most: int):
    return F.when(F.col("size") <= most, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("blob too large: "), "oid")))


def read_in_order(blobs: DataFrame, requests: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Contents for requests (place, oid), one row each; an unknown oid gives none, one that is too large fails the read.

    Requests carry their place, so no global order is made.
    """
    return requests.join(blobs, "oid", "left").select("place", "oid", F.when(F.col("size").isNotNull(), _bounded(most)).alias("content"))


def read_once(blobs: DataFrame, requests: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Each requested content once, with the number of requests: repeats are added up before contents are joined."""
    n = requests.groupBy("oid").agg(F.count(F.lit(1)).alias("requests"))
    return blobs.join(n, "oid").select("oid", _bounded(most).alias("content"), "requests")


def _equal(gone: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs (old_path, path) of equal contents (oid), one for one, in order of paths."""
    place = F.row_number().over(Window.partitionBy("oid").orderBy("path")).alias("_place")
    return gone.select("oid", F.col("path").alias("old_path"), place).join(new.select("oid", "path", place), ["oid", "_place"]).select("old_path", "path")


def _weighed(files: DataFrame) -> DataFrame:
    """Lines of distinct contents (oid, content) as keys: of equal lines each occurrence is one, so a content is a set; with its bytes and those of the content."""
    content = F.col("content")
    lines = files.select("oid", F.explode(F.split("content", "\n")).alias("l"), (F.octet_length(content) + 1).alias("size"))
    each = lines.groupBy("oid", "size", F.xxhash64("l").alias("_h")).agg(F.count(F.lit(1)).alias("_n"), F.max(F.octet_length("l") + 1).alias("bytes"))
    return each.select("oid", "size", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k"), "_h", "bytes").select("oid", "size", F.xxhash64("_h", "_k").alias("key"), "bytes")


def similar(gone: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs (old, new, similarity) of distinct contents (oid, content) that share at least ``least`` of the larger one's bytes, by lines as multisets.

    An exact join by prefixes: lines are ordered by how few contents have them,
    and a content's first ones are kept, until the rest weigh less than what a
    partner would have to share. Two similar contents have one of these in
    common, however frequent their lines are; only such pairs are compared.
    """
    tables = Tables(gone.sparkSession)
    a, b = (tables.save(_weighed(x.select("oid", "content").distinct())) for x in (gone, new))
    often = a.select("key").unionAll(b.select("key")).groupBy("key").agg(F.count(F.lit(1)).alias("_often"))
    rest = F.sum("bytes").over(Window.partitionBy("oid").orderBy(F.desc("_often"), F.desc("key")))  # of this line and those behind it

    def prefix(x: DataFrame, name: str) -> DataFrame:
        return x.join(often, "key").withColumn("_rest", rest).where(F.col("_rest") >= least * F.col("size") - 1e-9).select("key", F.col("oid").alias(name), F.col("size").alias(f"{name}_size"))

    larger, smaller = F.greatest("old_size", "new_size"), F.least("old_size", "new_size")
    met = tables.save(prefix(a, "old").join(prefix(b, "new"), "key").where(smaller >= least * larger - 1e-9).select("old", "new", larger.alias("larger")).distinct())
    shared = met.join(a.select(F.col("oid").alias("old"), "key", "bytes"), "old").join(b.select(F.col("oid").alias("new"), "key"), ["new", "key"])
    return shared.groupBy("old", "new", "larger").agg(F.sum("bytes").alias("_both")).select("old", "new", (F.col("_both") / F.col("larger")).alias("similarity")).where(F.col("similarity") >= least - 1e-9)


def renames(gone: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs (old_path, path, similarity) of deleted and added files (path, content), each file once.

    Equal contents are paired first, by their ids and in order of paths; then
    those that share at least ``least`` of the larger one's bytes by lines, best
    pairs first: two contents are paired, file by file, if each is the other's
    best, again and again until none is left. Ties are settled by a hash of both,
    which leaves a part of all in each round. A null content is empty; files with nothing in common aren't paired.
    """
    tables = Tables(gone.sparkSession)

    def filed(files: DataFrame) -> DataFrame:
        content = F.coalesce("content", F.lit(""))
        return tables.save(files.select("path", content.alias("content"), F.sha2(content, 256).alias("oid")))

    olds, news = filed(gone), filed(new)
    out = tables.save(_equal(olds, news))
    same = out.withColumn("similarity", F.lit(1.0))
    olds = olds.join(out.select(F.col("old_path").alias("path")), "path", "left_anti")
    news = news.join(out.select("path"), "path", "left_anti")

    def left(files: DataFrame) -> DataFrame:
        """Files with their place among those of their content."""
        return tables.save(files.select("oid", "path", F.row_number().over(Window.partitionBy("oid").orderBy("path")).alias("place")))

    pairs = similar(olds, news, least)
    olds, news = left(olds), left(news)
    sizes = lambda x, c: x.groupBy(F.col("oid").alias(c)).agg(F.count(F.lit(1)).alias(f"{c}_n"))
    pairs = tables.save(pairs.join(sizes(olds, "old"), "old").join(sizes(news, "new"), "new"))
    # Of each content the first files are used up; ``_used`` are how many.
    pairs = pairs.select("*", F.sha2(F.concat("old", "new"), 256).alias("_tie"), F.lit(0).cast("bigint").alias("old_used"), F.lit(0).cast("bigint").alias("new_used"))
    while not pairs.isEmpty():
        order = [F.desc("similarity"), F.col("_tie")]
        best = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(*order))
        taken = pairs.withColumn("_a", best("old")).withColumn("_b", best("new")).where("_a = 1 AND _b = 1")
        taken = tables.save(taken.withColumn("n", F.least(F.col("old_n") - F.col("old_used"), F.col("new_n") - F.col("new_used"))))
        each = taken.select("old", "new", "similarity", "old_used", "new_used", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("_i"))
        files = each.join(olds.select(F.col("oid").alias("old"), F.col("path").alias("old_path"), (F.col("place")).alias("_o")), "old").where("_o = old_used + _i")
        files = files.join(news.select(F.col("oid").alias("new"), "path", F.col("place").alias("_p")), "new").where("_p = new_used + _i")
        same = same.unionByName(tables.save(files.select("old_path", "path", "similarity")))
        used = lambda c: taken.select(c, (F.col(f"{c}_used") + F.col("n")).alias(f"_{c}"))  # noqa: B023, E731
        pairs = pairs.join(used("old"), "old", "left").join(used("new"), "new", "left")
        pairs = pairs.withColumn("old_used", F.coalesce("_old", "old_used")).withColumn("new_used", F.coalesce("_new", "new_used")).drop("_old", "_new")
        pairs = tables.save(pairs.where("old_used < old_n AND new_used < new_n"))
    return same.select("old_path", "path", "similarity")


def diff_trees(base: DataFrame, head: DataFrame, least: float = 0.5) -> DataFrame:
    """What changed between two trees (path, content): path, old_path, status (A, D, M or R) and similarity, with renames told from additions and deletions.

    Contents are compared by their ids; those of equal files don't leave their row.
    """
    side = lambda x, c: x.select("path", F.coalesce("content", F.lit("")).alias(c))
    both = side(base, "_b").join(side(head, "_h"), "path", "full_outer").where("_b IS NULL OR _h IS NULL OR _b <> _h")
    both = Tables(base.sparkSession).save(both)
    moved = renames(both.where("_h IS NULL").select("path", F.col("_b").alias("content")), both.where("_b IS NULL").select("path", F.col("_h").alias("content")), least)
    rest = both.select("path", F.when(F.col("_b").isNull(), "A").when(F.col("_h").isNull(), "D").otherwise("M").alias("status"))
    for name in ("old_path", "path"):
        rest = rest.join(moved.select(F.col(name).alias("path")), "path", "left_anti")
    found = moved.select("path", "old_path", F.lit("R").alias("status"), "similarity")
    return found.unionByName(rest.select("path", F.lit("").alias("old_path"), "status", F.lit(None).cast("double").alias("similarity")))


def changes(commits: DataFrame, trees: DataFrame, base: str, head: str, least: float = 0.5) -> DataFrame:
    """The changes of ``head`` since its merge base with ``base``: of commits (sha, parent) with their trees (sha, path, content)."""
    start = history.merge_base(commits, base, head)
    at = lambda sha: trees.where(F.col("sha") == sha).select("path", "content")
    return diff_trees(at(start), at(head), least)
