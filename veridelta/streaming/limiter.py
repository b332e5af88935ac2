"""A limiter whose windows start at the first event after the last one ended, for all keys at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def limit(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """event_id, user_id and whether each event is allowed: the first ``most`` of a user in a window are.

    One window serves all keys, so which window an event falls in depends on all
    events before it. Only event times that can start a window matter: those are
    walked in time order in one task as (time) alone, one row a second at most,
    however many events there are; counting within windows is spread by key.
    """
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    ticks = events.select(at.alias("t")).distinct().repartition(1).sortWithinPartitions("t")

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = None
        for b in batches:
            found = []
            for t in b["t"]:
                if start is None or t >= start + seconds:
                    start = int(t)
                    found.append(start)
            yield pd.DataFrame({"start": pd.Series(found, dtype="int64")})

    windows = ticks.mapInPandas(starts, "start bigint")
    # A window spans `seconds`, so an event lies in the one whose start has its own number of seconds or that before.
    marked = windows.withColumn("slot", F.explode(F.array(F.floor(F.col("start") / seconds), F.floor(F.col("start") / seconds) + 1)))
    rows = events.select("event_id", "user_id", "ts", at.alias("t"), F.floor(at / seconds).alias("slot"))
    held = rows.join(marked, "slot").where("t >= start AND t < start + " + str(seconds))
    place = F.row_number().over(Window.partitionBy("start", "user_id").orderBy("ts", "event_id"))
    return held.select("event_id", "user_id", (place <= most).alias("allowed"))
