"""Commit histories (sha, parent): depths, nearest labels and merge bases of long ones, without a job for each commit.

Along first parents, jumps over 1, 2, 4, ... commits are made by joining jumps
with themselves, but none passes an anchor, which one commit in 16 is by its
hash. So there are few long ones, and all together are no more than some four a
commit, however long the history. Lines of anchors are lines again, with a
sixteenth of the commits. A sweep takes the largest jumps first; another is
needed only for what other parents alone reach, so sweeps are as many as
branches merged into branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.shared import Tables

#: Steps of a way grow so many times a round.
BASE = 4
#: One commit in so many is an anchor; lines of so few commits have none.
SPARSE, SHORT = 16, 1 << 17
#: Joins between two writes.
SAVED = 3


def _nearest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sha").agg(F.min("depth").alias("depth"))


class _Lines:
    """Jumps along one way (sha, to, n) out of each commit, ``n`` steps long: tables (sha, to, n) of 1, 2, 4, ... ways that neither pass an anchor nor end at one."""

    def __init__(self, one: DataFrame, tables: Tables, tier: int = 0):
        self.tables, self.tier = tables, tier
        one = tables.save(one.select("sha", "to", "n"))
        n, self.jumps, self.over = one.count(), [], None
        jump = one
        if n > SHORT:
            self.into = tables.save(one.where(self._anchor("to")))
            jump = tables.save(one.where(~self._anchor("to")))
        while 2 ** len(self.jumps) <= n and (len(self.jumps) % SAVED or not jump.isEmpty()):
            self.jumps.append(jump)
            # Long lines are merged: their jumps are small as files only, and each would go to the driver to be broadcast.
            then = self._next(jump, "to")
            jump = tables.save(jump.join(then.hint("merge") if n > SHORT else then, "to").select("sha", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n")))
        if n > SHORT:
            ways = one.where(self._anchor("sha")).select("sha", F.col("sha").alias("_at"), F.lit(0).cast("bigint").alias("n"))
            for k in reversed(range(len(self.jumps))):
                ways = ways.join(self._next(self.jumps[k], "_at").hint("merge"), "_at", "left").select("sha", F.coalesce("_to", "_at").alias("_at"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
                if k % SAVED == 0:
                    ways = tables.save(ways)
            ways = ways.join(self._next(self.into, "_at").hint("merge"), "_at")
            self.over = _Lines(ways.select("sha", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n")), tables, tier + 1)

    def _anchor(self, c: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.tier), F.col(c)), F.lit(SPARSE)) == 0

    @staticmethod
    def _next(ways: DataFrame, at: str) -> DataFrame:
        return ways.select(F.col("sha").alias(at), F.col("to").alias("_to"), F.col("n").alias("_n"))

    def _step(self, found: DataFrame, ways: DataFrame) -> DataFrame:
        return found.join(ways, "sha").select(F.col("to").alias("sha"), (F.col("depth") + F.col("n")).alias("depth"))

    def _spread(self, found: DataFrame) -> DataFrame:
        """What comes before the next anchor, too."""
        for jump in reversed(self.jumps):
            found = self.tables.save(_nearest(found.unionByName(self._step(found, jump))))
        return found

    def cover(self, starts: DataFrame) -> DataFrame:
        """The least depth of each commit on the lines from ``starts`` (sha, depth), those themselves included."""
        found = self._spread(starts)
        if self.over is None:
            return found
        entered = self._step(found, self.into).unionByName(starts.where(self._anchor("sha")))
        beyond = self._spread(self.over.cover(self.tables.save(_nearest(entered))))
        return self.tables.save(_nearest(found.unionByName(beyond)))


def _along(ways: DataFrame, longest: int, tables: Tables) -> DataFrame:
    """Where ways (sha, to, n) end, and how far that is; an end points to itself, 0 steps away."""
    n = 1
    while n < longest:
        out = ways
        for _ in range(BASE - 1):
            step = ways.select(F.col("sha").alias("to"), F.col("to").alias("_next"), F.col("n").alias("_n"))
            out = out.join(step, "to").select("sha", F.col("_next").alias("to"), (F.col("n") + F.col("_n")).alias("n"))
        ways, n = tables.save(out), n * BASE
    return ways


def depths(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """Commits (sha, parent) reached from ``starts`` (sha) along parents, with the least number of steps.

    Sweeps find what is reached, and how far it is at most. Then every commit
    turns to its nearest child, all at once, and distances are summed anew along
    those ways, until no commit has a nearer child; that takes a few rounds even
    where shortest ways leave first parents again and again.

    A null parent is none. Which of several parents comes first makes no
    difference to the result; commits with a ``place`` are walked by their least.
    """
    tables = Tables(commits.sparkSession)
    order = "place" if "place" in commits.columns else "parent"
    edges = tables.save(commits.where("sha IS NOT NULL AND parent IS NOT NULL").groupBy("sha", "parent").agg(F.min(order).alias("_order")))
    lines = _Lines(edges.groupBy("sha").agg(F.min_by("parent", F.struct("_order", "parent")).alias("to"), F.lit(1).cast("bigint").alias("n")), tables)
    known = fresh = tables.save(starts.select("sha", F.lit(0).cast("bigint").alias("depth")).distinct())
    while True:
        came = tables.save(lines.cover(fresh))
        known = tables.save(known.unionByName(came).groupBy("sha").agg(F.min("depth").alias("depth")))
        side = came.join(edges, "sha").groupBy(F.col("parent").alias("sha")).agg((F.min("depth") + 1).alias("depth"))
        fresh = tables.save(side.join(known, "sha", "left_anti"))
        if fresh.isEmpty():
            break
    while True:
        near = edges.join(known, "sha").groupBy(F.col("parent").alias("sha")).agg(F.min(F.struct("depth", "sha")).alias("c"))
        ways = tables.save(known.join(near, "sha", "left").select("sha", F.when(F.col("depth") == 0, F.col("sha")).otherwise(F.col("c.sha")).alias("to"), F.when(F.col("depth") == 0, 0).otherwise(1).cast("bigint").alias("n"), "depth", (F.col("c.depth") + 1 < F.col("depth")).alias("_nearer")))
        longest, nearer = ways.agg(F.max("depth"), F.bool_or("_nearer")).first()
        if not nearer:
            return known
        known = _along(ways.select("sha", "to", "n"), longest, tables).select("sha", F.col("n").alias("depth"))


def commit_depths(commits: DataFrame, head: str) -> DataFrame:
    """The same from one commit, whether or not it is known."""
    return depths(commits, commits.sparkSession.createDataFrame([(head,)], "sha string"))


def nearest_labels(commits: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels (sha, label) of each commit (sha, parent): its own, else those of the nearest commits that descend from it, sorted; and how far they are.

    On shortest ways most commits have one predecessor and take its labels: such
    runs are jumped over, so rounds are as many as the ties that follow on ties.
    """
    tables = Tables(commits.sparkSession)
    labels = tables.save(labels.where("sha IS NOT NULL").select("sha", "label").distinct())
    known = commits.select("sha").union(commits.select("parent")).join(labels.select("sha"), "sha", "left_semi").distinct()
    own = tables.save(labels.join(known, "sha", "left_semi"))
    far = tables.save(depths(commits, own.select("sha").distinct()))
    into = commits.select(F.col("sha").alias("_from"), F.col("parent").alias("sha")).join(far, "sha").distinct()
    near = into.join(far.select(F.col("sha").alias("_from"), (F.col("depth") + 1).alias("depth")), ["_from", "depth"]).select("sha", "_from")
    ways = tables.save(near.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("sha"))))
    # The end of each run of single predecessors, by doubling: a commit that is labelled or where ways meet stays where it is.
    top = tables.save(far.select("sha").join(ways.where("_n = 1").select("sha", F.col("_from").alias("to")), "sha", "left").select("sha", F.coalesce("to", "sha").alias("to")))
    while True:
        next_ = top.withColumnRenamed("to", "_mid").join(top.select(F.col("sha").alias("_mid"), "to"), "_mid")
        next_ = tables.save(next_.select("sha", "to", (F.col("_mid") != F.col("to")).alias("_moved")))
        moved, top = next_.where("_moved"), next_.select("sha", "to")
        if moved.isEmpty():
            break
    # Labels of those ends, from the ends of the ways that meet there, until nothing is new.
    meets = tables.save(ways.where("_n > 1").select(F.col("sha").alias("_at"), F.col("_from").alias("sha")).join(top, "sha").select("_at", F.col("to").alias("sha")).distinct())
    have = fresh = own
    while True:
        fresh = tables.save(fresh.join(meets, "sha").select(F.col("_at").alias("sha"), "label").distinct().join(have, ["sha", "label"], "left_anti"))
        if fresh.isEmpty():
            break
        have = have.unionByName(fresh)
    named = top.join(have.withColumnRenamed("sha", "to"), "to").groupBy("sha").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    return named.join(far, "sha").select("sha", "labels", F.col("depth").alias("distance"))


def merge_base(commits: DataFrame, base: str, head: str) -> str:
    """The one best common ancestor of two commits: reached from both, and from no other such. None or several are an error."""
    tables = Tables(commits.sparkSession)
    both = tables.save(commit_depths(commits, base).select("sha").join(commit_depths(commits, head).select("sha"), "sha"))
    behind = both.join(commits, "sha").select(F.col("parent").alias("sha")).distinct()
    best = [r.sha for r in both.join(behind, "sha", "left_anti").limit(2).collect()]
    if len(best) != 1:
        raise ValueError("no merge base" if not best else "several merge bases")
    return best[0]
