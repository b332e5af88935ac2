"""Stateful streams: states of documents by version, jobs in flight, recent totals."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TOO_LARGE = 90


def document_states(events: DataFrame) -> DataFrame:
    """The state of each version of a document (user_id, event_id, event_type, value) on a stream.

    Only the last content of a document is kept between batches, so state grows
    with the number of documents and not with their versions. Versions of a
    document have to arrive in order of event_id from one batch to the next;
    within a batch they are put in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("event_id")
        out = []
        for r in rows.itertuples(index=False):
            if pd.isna(r.value):
                now = "unknown"
            elif r.value > TOO_LARGE:
                now = "too_large"
            else:
                now = "new" if last is None else "clean" if last == r.event_type else "changed"
            out.append((key[0], r.event_id, now))
            last = r.event_type
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "state"])

    grouped = events.select("user_id", "event_id", "event_type", "value").groupBy("user_id")
    return grouped.applyInPandasWithState(step, "user_id bigint, event_id bigint, state string", "last string", "append", GroupStateTimeout.NoTimeout)


def _by_key(rows: DataFrame, key: str, step, schema: str, kept: str) -> DataFrame:
    """``step`` (state or None, rows of a key in order) -> (rows out, state), on a stream or, with the same results, on a batch."""
    columns = [c.split()[0] for c in schema.split(", ")]
    if rows.isStreaming:

        def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            out, last = step(json.loads(state.get[0]) if state.exists else None, pd.concat(list(batches)))
            state.update((json.dumps(last),))
            yield pd.DataFrame(out, columns=columns)

        return rows.groupBy(key).applyInPandasWithState(run, schema, kept, "append", GroupStateTimeout.NoTimeout)
    return rows.groupBy(key).applyInPandas(lambda b: pd.DataFrame(step(None, b)[0], columns=columns), schema)


def submissions(events: DataFrame, per_user: int, most: int) -> DataFrame:
    """What becomes of each submission (queue, seq, kind, user, job), in order of seq.

    A job that is active already is a ``duplicate``; a user with ``per_user``
    active jobs is over ``quota``; a queue with ``most`` is ``busy``; else it is
    ``accepted`` and active until an event of another kind ends it. State holds
    active jobs only, so ``most`` bounds it.
    """

    def step(state: dict | None, rows: pd.DataFrame):
        active, out = dict(state or {}), []
        for queue, seq, kind, user, job in rows.sort_values("seq")[["queue", "seq", "kind", "user", "job"]].itertuples(index=False):
            if kind != "submit":
                active.pop(job, None)
                continue
            if job in active:
                result = "duplicate"
            elif sum(u == user for u in active.values()) >= per_user:
                result = "quota"
            elif len(active) >= most:
                result = "busy"
            else:
                result = "accepted"
                active[job] = user
            out.append((queue, seq, result))
        return out, active

    return _by_key(events.select("queue", "seq", "kind", "user", "job"), "queue", step, "queue string, seq bigint, result string", "active string")


def fan_out(events: DataFrame, room: int = 32) -> DataFrame:
    """Whether each published event (user_key, seq, kind) reaches its user's channel, which holds ``room`` until the user reads it (kind ``read``); what doesn't fit is dropped."""

    def step(state: int | None, rows: pd.DataFrame):
        held, out = state or 0, []
        for user, seq, kind in rows.sort_values("seq")[["user_key", "seq", "kind"]].itertuples(index=False):
            if kind == "read":
                held = 0
                continue
            out.append((user, seq, held < room))
            held = min(room, held + 1)
        return out, held

    return _by_key(events.select("user_key", "seq", "kind"), "user_key", step, "user_key string, seq bigint, delivered boolean", "held string")


def first_of_each(jobs: DataFrame, key: list[str], at: str, within: str = "48 hours") -> DataFrame:
    """Jobs in flight, one for each key: repeats within a time are dropped, and a key's state goes after it."""
    return jobs.withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and key; windows are final, and their state goes, when the watermark passes them."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
