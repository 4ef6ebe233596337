"""Log-linear latency histogram buckets as column expressions.

A histogram is a set of (bucket, count) rows: building one is a group-by,
merging two is a sum, and both are exact. The bucket number has a closed form,
so no UDF and no dense array is needed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Value range in microseconds and significant decimal digits."""

    lowest: int = 1
    highest: int = 10_000_000
    digits: int = 3

    @property
    def unit_bits(self) -> int:
        return int(math.floor(math.log2(max(self.lowest, 1))))

    @property
    def half_bits(self) -> int:
        digits = min(max(self.digits, 1), 5)
        return max(math.ceil(math.log2(2 * 10**digits)), 1) - 1

    @property
    def exponents(self) -> int:
        """Number of power-of-two ranges needed to reach `highest`."""
        n, top = 1, 1 << (self.half_bits + 1 + self.unit_bits)
        while top < self.highest:
            top, n = top << 1, n + 1
        return n

    @property
    def slots(self) -> int:
        return (self.exponents + 1) << self.half_bits


DEFAULT = Layout()


def _exponent(v: Column, layout: Layout) -> Column:
    """Which power-of-two range holds v: comparisons only, so it stays in generated code."""
    base = layout.half_bits + 1 + layout.unit_bits
    out = F.lit(layout.exponents).cast("int")
    for e in reversed(range(layout.exponents)):
        out = F.when(v < F.lit(1 << (base + e)), F.lit(e)).otherwise(out)
    return out


def _shr(v: Column, n: Column) -> Column:
    return F.call_function("shiftright", v, n.cast("int"))


def _shl(v: Column, n: Column) -> Column:
    return F.call_function("shiftleft", v.cast("bigint"), n.cast("int"))


def clamp(v: Column, layout: Layout = DEFAULT) -> Column:
    """Samples above the range count in the top bucket; negative ones are no sample."""
    return F.when(v >= 0, F.least(v, F.lit(layout.highest)).cast("bigint"))


def bucket_of(v: Column, layout: Layout = DEFAULT) -> Column:
    """Bucket number of a sample; NULL for a negative or missing one."""
    top = F.least(v, F.lit(layout.highest))
    e = _exponent(top, layout)
    bucket = _shl(e, F.lit(layout.half_bits)) + _shr(top, e + F.lit(layout.unit_bits))
    return F.when(v >= 0, bucket).cast("int")


def _bucket_exponent(bucket: Column, layout: Layout) -> Column:
    return F.greatest(_shr(bucket, F.lit(layout.half_bits)) - 1, F.lit(0))


def bucket_low(bucket: Column, layout: Layout = DEFAULT) -> Column:
    """Smallest value that falls into the bucket."""
    e = _bucket_exponent(bucket, layout)
    sub = bucket.cast("bigint") - _shl(e, F.lit(layout.half_bits))
    return _shl(sub, e + F.lit(layout.unit_bits))


def bucket_high(bucket: Column, layout: Layout = DEFAULT) -> Column:
    """Largest value that falls into the bucket."""
    width = _shl(F.lit(1), _bucket_exponent(bucket, layout) + F.lit(layout.unit_bits))
    return bucket_low(bucket, layout) + width - 1


def rank_of(percentile: float, total: Column) -> Column:
    """Rank whose bucket holds the percentile: share rounded to nearest, at least one."""
    share = min(max(percentile, 0.0), 100.0) / 100.0
    return F.greatest(F.floor(F.lit(share) * total + F.lit(0.5)), F.lit(1)).cast("bigint")
