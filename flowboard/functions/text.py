"""Display text and bands of board values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros_text(us: Column) -> Column:
    """Below a millisecond as whole microseconds, otherwise milliseconds with two decimals."""
    return F.when(us < 1000, F.concat(grouped(us, 0), F.lit(" µs"))).otherwise(
        F.concat(grouped(us / 1000, 2), F.lit(" ms"))
    )


def tps_text(tps: Column) -> Column:
    return (
        F.when(tps >= 1_000_000, F.concat(grouped(tps / 1_000_000, 2), F.lit("M")))
        .when(tps >= 1_000, F.concat(grouped(tps / 1_000, 1), F.lit("k")))
        .otherwise(grouped(tps, 0))
    )


def percent_text(share: Column) -> Column:
    return F.concat(grouped(share * 100, 2), F.lit("%"))


def grouped(x: Column, digits: int) -> Column:
    """Thousands separators and a fixed number of decimals.

    Rounds the binary value to nearest; only exact halves (odd multiples of
    2^-(digits+1)) need a nudge, because the formatter sends those to even.
    """
    x = x.cast("double")
    tie = (x * F.lit(float(2 ** (digits + 1)))) % 2 == 1
    return F.format_number(F.when(tie, x + 1e-6).otherwise(x), digits)


def score_band(score: Column) -> Column:
    return (
        F.when(score >= 80, "good").when(score >= 55, "ok").when(score >= 30, "warn").otherwise("bad")
    )


def health_band(health: Column) -> Column:
    up = F.upper(health)
    return (
        F.when(up == "READY", "good").when(up == "DEGRADED", "warn").when(up == "UNHEALTHY", "bad")
        .otherwise("muted")
    )
