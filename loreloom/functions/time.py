"""Time stamps and durations as they come: epoch seconds, epoch milliseconds, ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Epoch numbers from here on are milliseconds.
MILLISECONDS_FROM = 100_000_000_000


def normalized(raw: Column, zone: str = "Asia/Shanghai") -> Column:
    """struct<raw, normalized, timezone, iso8601> of a time given as text; null fields if it is none."""
    number = raw.try_cast("bigint")
    utc = F.coalesce(F.when(F.abs(number) >= MILLISECONDS_FROM, F.timestamp_millis(number)).when(number.isNotNull(), F.timestamp_seconds(number)), F.try_to_timestamp(raw))
    local = F.from_utc_timestamp(utc, zone)
    return F.struct(raw.alias("raw"), F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("normalized"), F.lit(zone).alias("timezone"), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso8601"))


def duration(raw: Column) -> Column:
    """struct<raw, normalized, unit> of a duration in seconds."""
    return F.struct(raw.alias("raw"), raw.try_cast("double").alias("normalized"), F.lit("seconds").alias("unit"))


def window_ok(start: Column, end: Column, minutes: Column) -> Column:
    """Whether a window ends after it starts and is as long as it says."""
    return (end > start) & (F.unix_seconds(end) - F.unix_seconds(start) == minutes * 60)


def expired(lease_until: Column, now: Column) -> Column:
    """Whether a lease (text) is over; one that can't be read is."""
    return F.coalesce(F.try_to_timestamp(lease_until), F.timestamp_seconds(F.lit(0))) <= now


def backoff(attempt: Column, initial: float = 1.0, most: float = 30.0) -> Column:
    """Seconds before the next try: doubled each time up to most."""
    return F.least(F.lit(initial) * F.pow(F.lit(2.0), attempt), F.lit(most))


def det_value(key: Column, value: Column) -> Column:
    """struct<type, normalized> of a scalar given as text, by its key's name: time, duration, boolean, number or string."""
    name = F.replace(F.lower(F.trim(key)), F.lit("-"), F.lit("_"))
    has = lambda *marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(name, m))
    boolean, number = F.lower(value).isin("true", "false"), value.try_cast("double")
    time = has("timestamp", "start_time", "end_time", "create_time", "update_time")
    span = has("duration", "total_time", "elapsed")
    kind = F.when(boolean, "boolean").when(time, F.when(normalized(value)["iso8601"].isNull(), "invalid_timestamp").otherwise("timestamp")).when(span, "duration").when(number.isNotNull(), "number").otherwise("string")
    said = F.when(boolean, F.lower(value)).when(time, normalized(value)["iso8601"]).when(span | number.isNotNull(), number.cast("string")).otherwise(F.trim(value))
    return F.when(value.isNotNull(), F.struct(kind.alias("type"), said.alias("normalized")))


def epoch_back(text: Column, sample: Column) -> Column:
    """A time as text turned back into epoch seconds, or milliseconds if the sample is of that size; null if it is none."""
    at = F.try_to_timestamp(F.regexp_replace(F.trim(text), r"\s+([+-]\d{2}:\d{2})$", "$1"))
    return F.when(F.abs(sample) >= MILLISECONDS_FROM, F.unix_millis(at)).otherwise(F.unix_seconds(at))
