"""Streams against batches over the same rows."""

import pytest
from pyspark.sql import functions as F

from veridelta.session import ship
from veridelta.streaming import replay, state, timers


@pytest.fixture(scope="module")
def events(spark, sf):
    ship(spark)
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value").orderBy("event_id").limit(600).cache()


def streamed(spark, events, tmp_path, make, name):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    for lo in range(0, 600, 200):
        events.orderBy("event_id").offset(lo).limit(200).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = make(replay.stream_files(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.table(name)


def test_document_states_on_a_stream(spark, events, tmp_path):
    got = streamed(spark, events, tmp_path, state.document_states, "states")
    want = replay.document_states(events)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_one_job_for_each_key(spark, events, tmp_path):
    got = streamed(spark, events, tmp_path, lambda s: state.first_of_each(s, ["user_id", "event_type"], "ts", "400 days"), "jobs")
    keys = [(r.user_id, r.event_type) for r in got.collect()]
    assert len(keys) == len(set(keys))
    assert set(keys) == {(r.user_id, r.event_type) for r in events.collect()}


def test_windows_close_behind_the_watermark(spark, events, tmp_path):
    got = {(r.start, r.event_type): r.n for r in streamed(spark, events, tmp_path, lambda s: state.windowed_counts(s, "ts", "event_type", "1 day", "40 days"), "windows").collect()}
    want = {(r.start, r.event_type): r.n for r in state.windowed_counts(events, "ts", "event_type", "1 day", "40 days").collect()}
    assert all(want[k] >= n for k, n in got.items())


def test_totals_and_feeds_are_the_same_in_parts(spark, events):
    feed = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq"))
    whole = {r.key: r.value for r in replay.apply_feed(feed).collect()}
    last = {}
    for r in feed.orderBy("seq").collect():
        last[r.key] = (r.kind, r.value)
    assert whole == {k: v for k, (kind, v) in last.items() if kind != "error"}


def test_silent_owners_expire(spark, events):
    """Owners a and b aren't heard of after their attempts ended; the others' events pass the time."""
    rows = [("a", 1, 100, 101), ("b", 2, 101, 101), ("b", 3, 102, None), ("c", 4, 104, 190), ("c", 5, 160, None), ("d", 6, 111, 112), ("d", 7, 161, 113), (None, 8, 162, 120)]
    df = spark.createDataFrame(rows, "owner string, seq bigint, at bigint, finished bigint")
    progress = []

    def make(stream):
        return timers.expirations(stream, 10)

    def feed(stream, at):
        q = make(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        progress.extend(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])

    with replay._stores(spark):
        replay.arrived(df, "at", feed)
    got = replay.replayed(df, "at", make)
    want = {("a", 1, 111), ("b", 2, 111), ("d", 6, 122), ("d", 7, 123), (None, 8, 130)}
    assert {tuple(r) for r in got.collect()} == want == {tuple(r) for r in timers.expirations(df, 10).collect()}
    assert progress[-1] < max(progress)  # state falls to what is still to expire


def test_attempts_of_an_owner_share_states(spark, events):
    """Nine thousand attempts of one owner, one of them twice, each with a moment of its own to expire; the last does at the very time."""
    n = 9000
    rows = [("a", k, k, k) for k in range(1, n)] + [("a", 5, 6000, 6001), ("b", 1, n + 4, None)]
    df = spark.createDataFrame(rows, "owner string, seq bigint, at bigint, finished bigint")
    progress = []

    def feed(stream, at):
        q = timers.expirations(stream, 1000).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(100)
        progress.extend(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
        found[:] = [spark.read.schema(timers.EXPIRED).parquet(f"{at}/out")]

    found = []
    with replay._stores(spark):
        replay.arrived(df, "at", feed, 1)
    want = {("a", k, k + 1000) for k in range(1, 8005) if k != 5} | {("a", 5, 7001)}
    assert {tuple(r) for r in found[0].collect()} == want == {tuple(r) for r in timers.expirations(df, 1000).collect()}
    assert 0 < max(progress) < 20  # a state and a timer a block


def test_absences_need_a_completed_scan(spark, events):
    seen = {1: "ab", 2: "a", 3: "ac", 4: "c", 5: "bc", 6: "b"}
    rows = [(7, g, i, "seen") for g, items in seen.items() for i in items] + [(7, g, None, "failed" if g in (2, 5) else "completed") for g in seen] + [(8, 1, "z", "seen"), (8, 2, None, "failed"), (7, 3, None, "seen")]
    df = spark.createDataFrame(rows, "source bigint, generation bigint, item string, kind string").repartition(3)
    want = {(7, "b", 3), (7, "a", 4), (7, "c", 6)}  # not by the scans that failed
    assert {tuple(r) for r in timers.absent(df).collect()} == want
    for batches in (1, 3):
        assert {tuple(r) for r in replay.replayed(df, "generation", timers.absences, batches).collect()} == want


def test_a_source_of_many_items_is_spread(spark, events):
    """Items that vanish in all parts, also when a batch has only a scan's end for them."""
    n = 3000
    seen = [(7, g, f"i{k}", "seen") for g in (1, 2, 3) for k in range(n) if k % g == 0]
    rows = [*seen, *((7, g, None, "completed") for g in (1, 2, 3, 4)), (9, 1, "i0", "seen"), (9, 4, None, "failed")]
    df = spark.createDataFrame(rows, "source bigint, generation bigint, item string, kind string").repartition(3)
    want = {tuple(r) for r in timers.absent(df).collect()}
    assert len(want) == n + n // 6  # those that are even but not by three go, come back and go
    got = []
    for batches in (1, 4):
        with replay._stores(spark):
            replay.arrived(df, "generation", lambda stream, at: got.append(_absent_files(stream, at)), batches)
        assert {tuple(r) for r in spark.read.schema(timers.REMOVED).parquet(got[-1][0]).collect()} == want
    assert 50 < got[1][1] < 100  # a state a part, not one an item


def _absent_files(stream, at):
    q = timers.absences(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    return f"{at}/out", max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
