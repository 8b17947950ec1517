"""Wall-clock expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = "interval 1 hour"


def hour_of(ts: Column) -> Column:
    """Start of the hour, kept as ``TIMESTAMP_NTZ``."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def local_time(ts_utc: Column, timezone: str) -> Column:
    """UTC instant to naive local wall clock. Both passes of an autumn hour map to one key.

    ``convert_timezone`` looks both zones up by name for every row, which takes five times as long.
    """
    return F.from_utc_timestamp(ts_utc.cast("timestamp"), timezone).cast("timestamp_ntz")


def local_hour(ts_utc: Column, timezone: str) -> Column:
    """Local hour an instant falls in."""
    return hour_of(local_time(ts_utc, timezone))


def local_hour_ceiling(local_ts: Column) -> Column:
    """First full local hour at or after a local time."""
    start = hour_of(local_ts)
    return F.when(start == local_ts, start).otherwise(start + F.expr(HOUR))


def hours_between(start: Column, end: Column) -> Column:
    """Whole hours from ``start`` to ``end``."""
    return F.timestamp_diff("HOUR", start, end)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def is_weekend(ts: Column) -> Column:
    """Saturday or Sunday (``weekday`` counts from Monday = 0)."""
    return F.weekday(ts) >= 5
