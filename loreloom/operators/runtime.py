"""Runs, leases, limits and retention over event tables."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What an event makes of a run, and which states are final.
STATE_OF_EVENT = {"CREATED": "QUEUED", "CLAIMED": "RUNNING", "APPROVAL_REQUESTED": "WAITING_APPROVAL", "APPROVED": "QUEUED", "CANCEL_REQUESTED": "CANCEL_REQUESTED", "CANCELLED": "CANCELLED", "SUCCEEDED": "SUCCEEDED", "FAILED": "FAILED", "INTERRUPTED": "INTERRUPTED"}
FINAL = ["SUCCEEDED", "FAILED", "CANCELLED"]


def states(events: DataFrame) -> DataFrame:
    """events with the status that each leads to."""
    of = F.create_map(*(F.lit(x) for kv in STATE_OF_EVENT.items() for x in kv))
    return events.withColumn("status", of[F.col("kind")])


def run_state(events: DataFrame) -> DataFrame:
    """(run_id, status, attempts, n_events, last_event): replay of run events; a cancellation beats a later success."""
    s = states(events)
    got = s.groupBy("run_id").agg(F.max_by("status", "event_id").alias("last"), F.count_if(F.col("kind") == "CLAIMED").alias("attempts"), F.count("*").alias("n_events"), F.max("event_id").alias("last_event"), F.bool_or(F.col("kind") == "CANCELLED").alias("cancelled"))
    return got.select("run_id", F.when(F.col("cancelled"), "CANCELLED").otherwise(F.col("last")).alias("status"), "attempts", "n_events", "last_event")


def idempotent(requests: DataFrame, keys: list[str], order: str) -> DataFrame:
    """requests with run_id, the order of the first request of their key, and whether they made the run."""
    first = F.min(order).over(Window.partitionBy(*keys))
    return requests.withColumn("run_id", first).withColumn("created", F.col(order) == first)


def trailing_count(events: DataFrame, key: str, seconds: F.Column, width: int = 60) -> DataFrame:
    """events with how many of their key lie in the width seconds up to them; an event exactly width ago is out."""
    w = Window.partitionBy(key).orderBy(seconds).rangeBetween(-(width - 1), 0)
    return events.withColumn("recent", F.count("*").over(w))


def rate_limit(events: DataFrame, key: str, micros: str, order: str, *, limit: int, width: float = 60.0) -> DataFrame:
    """(key, order, accepted): a sliding log in which refused calls do not count; exactly width old is forgotten.

    Whether a call counts depends on all before it, so a key's calls are one ordered pass: rows are sorted within
    partitions and stream through, with at most limit times carried, however many calls a key has.
    """
    rows = events.select(key, micros, order).repartition(key).sortWithinPartitions(key, micros, order)

    def run(batches):
        now, log = object(), deque()
        for b in batches:
            out = []
            for k, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != now:
                    now, log = k, deque()
                while log and log[0] <= at - width * 1e6:
                    log.popleft()
                out.append(len(log) < limit)
                if out[-1]:
                    log.append(at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.bool_())], [key, order, "accepted"])

    types = dict(events.dtypes)
    return rows.mapInArrow(run, f"`{key}` {types[key]}, `{order}` {types[order]}, accepted boolean")


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, session, started, ended, n): stretches of a key's events without a longer gap."""
    w = Window.partitionBy(key).orderBy(ts)
    new = F.coalesce(F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w)) > gap_seconds * 1_000_000, F.lit(True)).cast("int")
    numbered = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def retained(files: DataFrame, newest: int, cutoff: F.Column, ts: str = "ts", name: str = "name") -> DataFrame:
    """The newest files that are not older than the cutoff. The order is found within a top-k, not a global sort."""
    return files.filter(F.col(ts) >= cutoff).orderBy(F.desc(ts), F.desc(name)).limit(newest)


def next_index(steps: DataFrame, key: str, index: str) -> DataFrame:
    """(key, next_index): one past the largest index of each key."""
    return steps.groupBy(key).agg((F.coalesce(F.max(index), F.lit(0)) + 1).alias("next_index"))
