"""Incremental operators and their batch replays.

Each function works on a batch DataFrame; where it only filters or sums it works
on a stream unchanged. ``stream_files`` and ``upsert_to`` run them as streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from veridelta.shared import Tables

from .timers import PROVIDER


def stream_files(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def totals(rows: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Additive totals by key: on a stream, an update-mode aggregate."""
    return rows.groupBy(key).agg(*(c.alias(n) for n, c in sums.items()))


def filtered(runs: DataFrame) -> DataFrame:
    """Pushes that start an analysis: of a known repository, no plan, not failed."""
    return runs.where("variant = '' AND status <> 'failed' AND repo_key <> ''")


def apply_feed(feed: DataFrame) -> DataFrame:
    """Changes (key, kind, value, seq) in order: the last one of a key counts; an error removes it."""
    last = feed.groupBy("key").agg(F.max_by(F.struct("kind", "value"), "seq").alias("r"))
    return last.where("r.kind <> 'error'").select("key", "r.value")


def document_states(events: DataFrame) -> DataFrame:
    """The state of each version of a document: unknown, too_large, new, clean or changed against the one before."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    state = F.when(F.col("value").isNull(), "unknown").when(F.col("value") > 90, "too_large").when(before.isNull(), "new").when(before == F.col("event_type"), "clean").otherwise("changed")
    return events.select("user_id", "event_id", state.alias("state"))


def carried(ties: DataFrame, present: DataFrame) -> DataFrame:
    """Whether each explanation is kept: all that it is tied to (explanation, tie) is still ``present`` (tie)."""
    there = present.select("tie").distinct().withColumn("_in", F.lit(True))
    return ties.select("explanation", "tie").distinct().join(there, "tie", "left").groupBy("explanation").agg(F.bool_and(F.col("_in").isNotNull()).alias("kept"))


def arrived(rows: DataFrame, order: str, feed: Callable[[DataFrame, str], object], batches: int = 3) -> None:
    """Lets a table arrive in a folder, in ``batches`` ranges of a numeric column; after each, ``feed`` (stream, folder) is run to its end.

    A run that starts from the same checkpoint reads what is new as one batch,
    of as many files as were written.
    """
    spark, tables = rows.sparkSession, Tables(rows.sparkSession)
    held = tables.save(rows)
    lo, hi = held.agg(F.min(order), F.max(order)).first()
    edges = [lo + (hi - lo + 1) * k / batches for k in range(1, batches)] if lo is not None else []
    for k, (a, b) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        after = F.lit(True) if a is None else F.col(order) >= a
        before = F.lit(True) if b is None else F.col(order) < b
        part = held.where(F.coalesce(after & before, F.lit(k == 0)))
        part.write.mode("append").parquet(f"{tables.at}/in")
        feed(spark.readStream.schema(rows.schema).parquet(f"{tables.at}/in"), tables.at)
    tables.drop(held)


def replayed(rows: DataFrame, order: str, make: Callable[[DataFrame], DataFrame], batches: int = 3) -> DataFrame:
    """What a streaming operator appends while a table arrives, as a table of the shared folder."""
    spark, made = rows.sparkSession, []

    def feed(stream: DataFrame, at: str) -> None:
        out = make(stream)
        made[:] = [at, out.schema]
        out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    with _stores(spark):
        arrived(rows, order, feed, batches)
    return spark.read.schema(made[1]).parquet(f"{made[0]}/out")


@contextmanager
def _stores(spark: SparkSession) -> Iterator[None]:
    """State that operators with timers need, for streams that start meanwhile."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def appended(stream: DataFrame) -> DataFrame:
    """All that a stream appends until it has read what is there now, as a table of the shared folder."""
    spark, at = stream.sparkSession, Tables(stream.sparkSession).at
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def scanned(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Scans of a folder in which rows arrive: the last row of each key."""
    at = []

    def feed(stream: DataFrame, folder: str) -> None:
        at[:] = [folder]
        upsert_to(stream, f"{folder}/table", f"{folder}/log", keys, seq).awaitTermination()

    arrived(rows, seq, feed)
    return current(rows.sparkSession, f"{at[0]}/table", rows.schema)


#: Keys are dealt to so many folders; a batch rewrites only those that it touches.
BUCKETS = 64


def upsert_to(stream: DataFrame, path: str, checkpoint: str, keys: list[str], seq: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Last-writer-wins upserts of a stream into a Parquet table.

    Rows are dealt to buckets by the hash of their keys. A batch writes the next
    version of the buckets that it touches, from their current ones, and then a
    list of what is current; versions before the last two are deleted. A list is
    written whole before it counts, so a batch that fails is repeated without harm.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _versions(spark, path, number)
        dealt = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = [r[0] for r in dealt.select("_bucket").distinct().collect()]
        rows = dealt
        held = sorted({before[b] for b in touched if b in before})
        for v in held:
            old = spark.read.schema(dealt.schema).parquet(f"{path}/v{v}").where(F.col("_bucket").isin([b for b in touched if before.get(b) == v]))
            rows = rows.unionByName(old)
        rest = [c for c in batch.columns if c not in keys]
        best = rows.groupBy("_bucket", *keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select("_bucket", *keys, *(F.col(f"r.{c}").alias(c) for c in rest))
        best.repartition(len(touched) or 1, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/v{number}")
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/list{number}")
        dealt.unpersist()
        for v in set(before.values()) - set(now.values()):
            # The batch before may be repeated, and reads what was current then.
            if v < number - 1:
                _delete(spark, f"{path}/v{v}")
        _delete(spark, f"{path}/list{number - 2}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, number: int | None = None) -> dict[int, int]:
    """The version of each bucket that is current before batch ``number``, or now."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    done = [int(s.getPath().getName()[4:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("list") and _exists(spark, f"{path}/{s.getPath().getName()}/_SUCCESS")]
    done = [d for d in done if number is None or d < number]
    return {r.bucket: r.version for r in spark.read.parquet(f"{path}/list{max(done)}").collect()} if done else {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a table that ``upsert_to`` writes."""
    versions = _versions(spark, path)
    out = spark.createDataFrame([], schema)
    for v in sorted(set(versions.values())):
        own = spark.read.schema(T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(f"{path}/v{v}")
        out = out.unionByName(own.where(F.col("_bucket").isin([b for b in versions if versions[b] == v])).drop("_bucket"))
    return out
