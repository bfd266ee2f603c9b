"""Run events as streams: cursors, idempotency, sessions, trailing counts and stateful rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 64) -> DataFrame:
    """Events of a growing Parquet folder, ts as timestamp."""
    got = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return got.withColumn("ts", F.col("ts").cast("timestamp"))


def after(events: DataFrame, cursor: int, limit: int | None = None, order: str = "event_id") -> DataFrame:
    """Events past a cursor; with a limit (of a table, not a stream) the next page in order."""
    got = events.filter(F.col(order) > cursor)
    return got if limit is None else got.orderBy(order).limit(max(1, limit))


def first_of_key(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key, as a run is made once for an idempotency key; state goes after the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def session_counts(events: DataFrame, key: str, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(key, started, ended, n) of sessions that end after a gap without events."""
    got = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return got.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def windowed(events: DataFrame, key: str, width: str = "60 seconds", slide: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, started, ended, n, total) of sliding windows."""
    got = events.withWatermark("ts", late).groupBy(key, F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "total")


def rate_limited(events: DataFrame, key: str, key_type: str = "long", *, limit: int, width: float = 60.0, late: str = "1 minute") -> DataFrame:
    """(key, event_id, accepted): the sliding log as keyed state; at most limit times are kept, refused calls are not.

    A key's state goes when the watermark has passed its last call by the width.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        calls = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        seconds = calls["ts"].astype("int64") / {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1.0}[calls["ts"].dt.unit]
        accepted = []
        for now in seconds:
            log = [t for t in log if t > now - width]
            accepted.append(len(log) < limit)
            if accepted[-1]:
                log.append(now)
        state.update((log,))
        state.setTimeoutTimestamp(max(int((seconds.max() + width) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: name[0], "event_id": calls["event_id"].to_numpy(), "accepted": accepted})

    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, f"`{key}` {key_type}, event_id long, accepted boolean", "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)
