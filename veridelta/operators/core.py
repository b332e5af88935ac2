"""Building blocks: islands, top-k with totals, last-writer-wins, occurrence numbers, range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.shared import Tables


def islands(df: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Runs of consecutive distinct lines: keys, start, end and the number of ``lines``."""
    w = Window.partitionBy(*keys).orderBy(line)
    marked = df.select(*keys, line).distinct().withColumn("_run", F.col(line) - F.row_number().over(w))
    return marked.groupBy(*keys, "_run").agg(F.min(line).alias("start"), F.max(line).alias("end"), F.count(F.lit(1)).alias("lines")).drop("_run")


def capped_islands(df: DataFrame, keys: list[str], cap: int, line: str = "line") -> DataFrame:
    """Runs as ``islands`` gives; those past ``cap`` folded into one, whose ``overflow`` counts their lines."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("start"))
    runs = islands(df, keys, line).withColumn("_at", F.least(at, F.lit(cap + 1)))
    return runs.groupBy(*keys, "_at").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("lines").alias("_lines")).select(
        *keys, "start", "end", F.when(F.col("_at") > cap, F.col("_lines")).otherwise(0).alias("overflow")
    )


def occurrence(df: DataFrame, keys: list[str], order: list, name: str = "occurrence") -> DataFrame:
    """Number equal keys from 0 in ``order``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def last_by(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of each key with the greatest ``seq``, as an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def top_with_total(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key, with their ``place`` and the ``total`` before the cap."""
    w = Window.partitionBy(*keys)
    return df.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= k)


#: How many times wider the blocks of a tier are than those of the tier before, and how many tiers there are.
_WIDER, _TIERS = 64, 8


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, start: str, end: str, bucket: int = 64) -> DataFrame:
    """Points with each range of equal keys (nulls are equal) that contains them.

    A range lies in one or two blocks of the first tier whose blocks aren't
    shorter than it: blocks of ``bucket`` values, of 64 times as many, and so on.
    A point asks its block of each tier that any range is in, mostly one. So the
    join has an equal key finer than ``keys``, and a range of any length has two
    rows at most; one that ends before it starts, or has no end, holds nothing.
    """
    widths = F.array(*(F.lit(bucket * _WIDER**t) for t in range(_TIERS)))
    last = F.greatest(F.col(start), F.col(end))
    tier = F.lit(_TIERS - 1)
    for t in reversed(range(_TIERS - 1)):
        tier = F.when(last - F.col(start) < bucket * _WIDER**t, t).otherwise(tier)
    block = lambda c: F.floor(c / F.element_at(widths, F.col("_tier") + 1))
    tiered = ranges.withColumn("_tier", tier)
    r = tiered.withColumn("_block", F.explode(F.array_distinct(F.array(block(F.col(start)), block(last)))))
    used = tiered.agg(F.collect_set("_tier").alias("_tiers"))  # one row, of ``_TIERS`` numbers at most
    p = points.crossJoin(F.broadcast(used)).withColumn("_tier", F.explode("_tiers")).drop("_tiers").withColumn("_block", block(F.col(point)))
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col(f"p.{c}") == F.col(f"r.{c}") for c in ("_tier", "_block")] + [F.col(f"p.{point}").between(F.col(f"r.{start}"), F.col(f"r.{end}"))]
    own = [c for c in ranges.columns if c not in keys]
    return p.alias("p").join(r.alias("r"), on).select(*(F.col(f"p.{c}").alias(c) for c in points.columns), *(F.col(f"r.{c}").alias(c) for c in own))


def ranks(column: str | Column, names: list[str], other: int) -> Column:
    """The place of a lower-case name in ``names``, or ``other``."""
    c = F.lower(F.col(column) if isinstance(column, str) else column)
    out = F.lit(other)
    for i, n in enumerate(names):
        out = F.when(c == n, i).otherwise(out)
    return out


def severity_rank(column: str | Column) -> Column:
    """critical 4, high 3, medium 2, low 1, anything else 0."""
    return ranks(column, ["", "low", "medium", "high", "critical"], 0)


def alert_rank(column: str | Column) -> Column:
    """critical 3, high 2, medium 1, anything else 0: what isn't known counts as low."""
    return ranks(column, ["low", "medium", "high", "critical"], 0)


def union_all(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of both, repeats kept."""
    return a.select(*columns).unionByName(b.select(*columns))


def union_distinct(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows of both."""
    return union_all(a, b, columns).distinct()


def common(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows that both have; nulls are equal."""
    return a.select(*columns).intersect(b.select(*columns))


def difference(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows that only one side has, ``added`` or ``removed``: one aggregate over both sides, not two joins."""
    sides = before.select(*columns, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(after.select(*columns, F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    g = sides.groupBy(*columns).agg(F.max("_b").alias("_b"), F.max("_a").alias("_a")).where("_a <> _b")
    return g.select(*columns, F.when(F.col("_a") == 1, "added").otherwise("removed").alias("change"))


def surplus(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The multiset of rows of ``a`` without that of ``b``."""
    return a.select(*columns).exceptAll(b.select(*columns))


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same items as often, in any order; null and empty ones are alike."""
    plain = lambda x: F.array_sort(F.coalesce(x, F.array().cast("array<string>")).cast("array<string>"))
    return plain(a) == plain(b)


def newly(now: Column, before: Column) -> Column:
    """What an array has that an earlier one hadn't, sorted, each once."""
    return F.array_sort(F.array_except(now, F.coalesce(before, F.slice(now, 1, 0))))


#: Ranges of a key that are compared in one array; keys with more are cut into blocks.
FEW_RANGES = 64


def _segments_of_few(r: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (keys, _i, _rank, _at, _next) between the ends of ranges (_s, _e, _rank) that any covers, of keys with few ranges: each from one array."""
    g = r.groupBy(*keys).agg(F.collect_list(F.struct("_s", "_e", "_rank")).alias("_all"))
    g = g.withColumn("_cuts", F.array_sort(F.array_distinct(F.flatten(F.transform("_all", lambda x: F.array(x["_s"], x["_e"]))))))
    least = lambda at: F.array_min(F.transform(F.filter("_all", lambda x: (x["_s"] <= at) & (x["_e"] > at)), lambda x: x["_rank"]))
    segment = lambda at, i: F.struct(i.cast("bigint").alias("_i"), least(at).alias("_rank"), at.alias("_at"), F.element_at("_cuts", i + 2).alias("_next"))
    return g.select(*keys, F.explode(F.transform(F.slice("_cuts", F.lit(1), F.size("_cuts") - 1), segment)).alias("_x")).select(*keys, "_x.*").where("_rank IS NOT NULL")


def _segments_of_many(r: DataFrame, keys: list[str]) -> DataFrame:
    """The same of keys with any number of ranges.

    The ends of all ranges cut a key's lines into segments, at most two a range.
    A range covers a run of segments, which is cut into blocks of powers of two,
    and a segment asks the blocks that hold it, so both sides of the join have a
    row for each doubling of the number of segments.
    """
    order = Window.partitionBy(*keys).orderBy("_at")
    ends = r.select(*keys, F.explode(F.array("_s", "_e")).alias("_at")).distinct()
    cuts = ends.withColumn("_i", F.row_number().over(order) - 1).withColumn("_next", F.lead("_at").over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    at = lambda c, i: cuts.select(*keys, F.col("_at").alias(c), F.col("_i").alias(i))
    placed = r.join(at("_s", "_a"), [*keys, "_s"]).join(at("_e", "_b"), [*keys, "_e"])
    # At each level the run's first block, if it is odd, and its last, if the one after it is: the others make up larger ones.
    level = placed.select(*keys, "_rank", "_a", "_b", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("_b") - F.col("_a"))).cast("int") + 1)).alias("_k"))
    size = F.expr("shiftleft(1L, _k)")
    level = level.select(*keys, "_rank", "_k", F.ceil(F.col("_a") / size).alias("_l"), F.floor(F.col("_b") / size).alias("_r")).where("_l < _r")
    odd = F.filter(F.array(F.when(F.col("_l") % 2 == 1, F.col("_l")), F.when(F.col("_r") % 2 == 1, F.col("_r") - 1)), lambda x: x.isNotNull())
    blocks = level.select(*keys, "_k", F.explode(odd).alias("_block"), "_rank").groupBy(*keys, "_k", "_block").agg(F.min("_rank").alias("_rank"))
    # A run of one block at the top of its levels is even there, and found a level up.
    asked = cuts.where("_next IS NOT NULL").select(*keys, "_at", "_next", "_i", F.explode(F.sequence(F.lit(0), F.ceil(F.log2("_n")).cast("int") + 1)).alias("_k"))
    asked = asked.withColumn("_block", F.floor(F.col("_i") / size))
    return asked.join(blocks, [*keys, "_k", "_block"]).groupBy(*keys, "_i").agg(F.min("_rank").alias("_rank"), F.first("_at").alias("_at"), F.first("_next").alias("_next")).withColumn("_i", F.col("_i").cast("bigint"))


def owners(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end", rank: str = "rank") -> DataFrame:
    """Who owns which lines where ranges overlap: of each key the stretches (start, end, rank) of which the least rank that covers them is the same.

    Lines are never listed. Keys with up to ``FEW_RANGES`` ranges are settled in
    an array each, others by blocks of segments. Rows with a null key own nothing.
    """
    r = ranges.where(F.col(end) >= F.col(start)).select(*keys, F.col(start).cast("bigint").alias("_s"), (F.col(end) + 1).cast("bigint").alias("_e"), F.col(rank).alias("_rank")).dropna(subset=keys)
    many = Tables(ranges.sparkSession).save(r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW_RANGES).select(*keys))
    if many.isEmpty():
        own = _segments_of_few(r, keys)
    else:
        own = _segments_of_few(r.join(many, keys, "left_anti"), keys).unionByName(_segments_of_many(r.join(many, keys, "left_semi"), keys))
    run = own.withColumn("_run", F.col("_i") - F.row_number().over(Window.partitionBy(*keys, "_rank").orderBy("_i")))
    merged = run.groupBy(*keys, "_rank", "_run").agg(F.min("_at").alias(start), (F.max("_next") - 1).alias(end))
    return merged.select(*keys, start, end, F.col("_rank").alias(rank))
