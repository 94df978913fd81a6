"""Durations and time stamps as whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"


def duration_ms(started: Column, ended: Column) -> Column:
    """Whole milliseconds from start to end, truncated; null when either is null."""
    micros = F.timestamp_diff("MICROSECOND", started, ended)
    return F.call_function("div", micros, F.lit(1000))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time stamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), ts)
