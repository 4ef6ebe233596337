"""Epoch arithmetic on unix-nanosecond timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
HOUR = 3600 * SECOND


def epoch_of(ts_ns: Column, width_ns: int) -> Column:
    """Number of the fixed-width slot that holds the instant."""
    return F.call_function("div", ts_ns, F.lit(width_ns).cast("bigint"))


def instant(ns: Column) -> Column:
    """Nanoseconds to a zone-free timestamp (microsecond resolution)."""
    return F.timestamp_micros(F.call_function("div", ns, F.lit(1000).cast("bigint"))).cast("timestamp_ntz")


def nanos(ts: Column) -> Column:
    """Timestamp column (with or without zone, session in UTC) to unix nanoseconds."""
    return F.unix_micros(ts.cast("timestamp")) * 1000
