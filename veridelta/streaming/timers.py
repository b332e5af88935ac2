"""Stateful streams with timers: attempts that expire by themselves, and items that a completed scan no longer holds.

Both run on Spark's ``transformWithState``. Attempts and items are dealt to parts
of an owner or source, each with a state that is read and written whole, so a hot
owner is spread and a batch costs a call for each part, not for each row. They need the RocksDB state store: set ``PROVIDER`` in the session that starts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

EXPIRED = "owner string, seq bigint, expired_at bigint"
REMOVED = "source bigint, item string, generation bigint"


#: Attempts of an owner whose numbers are the same but for so many low bits share a state.
BLOCK_BITS = 12


class _Expirations(StatefulProcessor):
    """Finished attempts of an owner in a block of numbers, and a timer for those that expire first; one that hasn't finished isn't kept."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.finished = handle.getValueState("finished", "seqs array<bigint>, untils array<bigint>, timer bigint")

    def _held(self) -> tuple[dict[int, int], int | None]:
        state = self.finished.get()
        return (dict(zip(state[0], state[1], strict=True)), state[2]) if state else ({}, None)

    def _keep(self, held: dict[int, int], timer: int | None) -> None:
        """Write what is held; ``timer`` is the one that is set."""
        # A timer goes off when time has passed it: a millisecond before, so that it does when time is there.
        first = min(held.values()) * 1000 - 1 if held else None
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if held:
            self.finished.update((list(held.keys()), list(held.values()), first))
        else:
            self.finished.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last: dict[int, tuple[int, int]] = {}
        for df in rows:
            df = df.loc[df["finished"].notna(), ["seq", "at", "finished"]]
            for seq, at, finished in zip(df["seq"].tolist(), df["at"].tolist(), df["finished"].tolist(), strict=True):
                if seq not in last or at >= last[seq][0]:
                    last[seq] = at, int(finished) + self.seconds
        if last:
            held, timer = self._held()
            held.update((seq, until) for seq, (_, until) in last.items())
            self._keep(held, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, _ = self._held()
        gone = [(seq, until) for seq, until in held.items() if until * 1000 <= now]
        for seq, _ in gone:
            del held[seq]
        self._keep(held, None)
        if gone:
            yield pd.DataFrame([(key[0], *g) for g in gone], columns=["owner", "seq", "expired_at"])

    def close(self) -> None:
        pass


def expirations(attempts: DataFrame, seconds: int) -> DataFrame:
    """When finished attempts (owner, seq, at, finished: seconds) are forgotten: ``seconds`` after they ended, whether or not their owner is heard of again.

    On a stream time is the greatest ``at`` of all owners so far, and attempts
    have timers, so the state of a silent owner goes too. An owner's attempts are
    kept in blocks by their numbers, each read and written whole and with one
    timer, so neither the state of a key nor the work of an expiry grows with
    the number of an owner's attempts. On a batch the same attempts come out.
    Those that haven't finished (null) are kept for ever and need no state; a null
    owner is an owner; repeated (owner, seq) count as the last one.
    """
    rows = attempts.select(F.col("owner").cast("string").alias("owner"), F.col("seq").cast("bigint").alias("seq"), F.col("at").cast("bigint").alias("at"), F.col("finished").cast("bigint").alias("finished"))
    if rows.isStreaming:
        timed = rows.withColumn("block", F.shiftright("seq", BLOCK_BITS)).withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", "0 seconds")
        return timed.groupBy("owner", "block").transformWithStateInPandas(_Expirations(seconds), EXPIRED, "append", "EventTime")
    done = rows.where("finished IS NOT NULL").groupBy("owner", "seq").agg((F.max_by("finished", "at") + seconds).alias("expired_at"))
    return done.crossJoin(F.broadcast(rows.agg(F.max("at").alias("_now")))).where("expired_at <= _now").drop("_now")  # one row is broadcast


#: The items of a source are dealt to so many states.
PARTS = 64


class _Absences(StatefulProcessor):
    """Of a part of a source's items the generation in which each was seen last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "items array<string>, generations array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        scans: dict[int, set] = {}
        done: set[int] = set()
        for df in rows:
            done.update(df.loc[df["kind"] == "completed", "generation"].tolist())
            for generation, part in df[df["kind"] == "seen"].groupby("generation"):
                scans.setdefault(int(generation), set()).update(part["item"].unique())
        if not scans and not done:
            return
        state = self.seen.get()
        held = dict(zip(state[0], state[1], strict=True)) if state else {}
        for generation in sorted(scans.keys() | done):
            held.update(dict.fromkeys(scans.pop(generation, ()), generation))
            if generation in done:
                gone = [item for item, last in held.items() if last < generation]
                for item in gone:
                    del held[item]
                if gone:
                    yield pd.DataFrame([(key[0], item, generation) for item in gone], columns=["source", "item", "generation"])
        if held:
            self.seen.update((list(held.keys()), list(held.values())))
        elif state:
            self.seen.clear()

    def close(self) -> None:
        pass


def absences(scans: DataFrame, parts: int = PARTS) -> DataFrame:
    """Items that are gone (source, item, generation), from scans (source, generation, item, kind) on a stream: found when a scan that was read to its end hasn't seen them.

    A scan is its ``seen`` rows and at last a row of kind ``completed``, or
    ``failed``, which removes nothing. Scans come in order from one batch of the
    stream to the next. Items are dealt to ``parts`` states of a source, which all
    hear of its scans' ends; each is read and written whole once a batch, so a task
    holds the distinct items that a batch has of one part. An item that is seen
    again later is new; null items are none. State holds the items that are there.
    """
    rows = scans.select(F.col("source").cast("bigint").alias("source"), F.col("generation").cast("bigint").alias("generation"), F.col("item").cast("string").alias("item"), "kind").where("kind <> 'seen' OR item IS NOT NULL")
    part = F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")
    dealt = rows.withColumn("part", F.explode(F.when(F.col("kind") == "seen", F.array(part)).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)))))
    return dealt.groupBy("source", "part").transformWithStateInPandas(_Absences(), REMOVED, "append", "None")


def absent(scans: DataFrame) -> DataFrame:
    """The same from all scans at once: each time that an item was seen, the next completed scan of its source, if that comes before the item is seen again."""
    order = Window.partitionBy("source").orderBy("generation")
    turns = scans.where("kind IN ('completed', 'failed')").groupBy("source", "generation").agg(F.bool_or(F.col("kind") == "completed").alias("_done"))
    times = scans.select("source", "generation").distinct().join(turns, ["source", "generation"], "left")
    after = F.min(F.when(F.col("_done"), F.col("generation"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    times = times.select("source", "generation", after.alias("_next"))
    seen = scans.where("kind = 'seen' AND item IS NOT NULL").select("source", "item", "generation").distinct()
    seen = seen.withColumn("_again", F.lead("generation").over(Window.partitionBy("source", "item").orderBy("generation")))
    gone = seen.join(times, ["source", "generation"]).where("_next IS NOT NULL AND (_again IS NULL OR _next < _again)")
    return gone.select("source", "item", F.col("_next").alias("generation"))
