"""Prefix scans over ordered groups of any size.

``Window.partitionBy(key).orderBy(pos)`` sends a whole key to one task, which a
hot key does not survive. The scans needed here (running sum, count, max, min,
last non-null) all combine associatively, so the group is cut into chunks along
its order: every (key, chunk) is scanned on its own, chunk totals are scanned
per key (one row per chunk), and the carry is joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column | None,
    specs: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add one column per spec: the scan over the rows up to here within `keys`.

    `specs` maps an output name to (kind, value), kind in sum, count, max, min,
    last. Keys and order are never NULL. `chunk` must never decrease along `order`. With ``inclusive=False``
    the row itself is left out (a lag when the kind is last). `order` must be a
    total order within a key for last and for exclusive scans to be unique. No `chunk` says that
    every key is small: each is scanned whole.
    """
    if chunk is None:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return df.select("*", *[
            _combine(kind, _fold(kind, value).over(whole), F.lit(None)).alias(name) for name, (kind, value) in specs.items()])
    base = df.withColumn(CHUNK, chunk)
    for name, (_, value) in specs.items():
        base = base.withColumn(f"__v_{name}", value)

    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    local = local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    scanned = base.select(
        *[F.col(f"`{c}`") for c in df.columns],
        CHUNK,
        *[_fold(kind, F.col(f"__v_{name}")).over(local).alias(f"__l_{name}")
          for name, (kind, _) in specs.items()],
    )

    place = F.struct(*order) if len(order) > 1 else order[0]  # read by `last` only
    totals = base.groupBy(*keys, CHUNK).agg(
        *[_total(kind, F.col(f"__v_{name}"), place).alias(f"__t_{name}")
          for name, (kind, _) in specs.items()],
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(CHUNK).alias("__k_chunk"),
        *[_fold("sum" if kind == "count" else kind, F.col(f"__t_{name}")).over(before).alias(f"__c_{name}")
          for name, (kind, _) in specs.items()],
        F.count(F.lit(1)).over(before).alias("__earlier"),
    ).filter(F.col("__earlier") > 0)  # a key's first chunk carries nothing: short keys drop out here

    # Plain equality on keys, then chunk: the join reuses the window's partitioning and sort.
    pairs = [scanned[k] == carry[f"__k_{k}"] for k in keys] + [F.col(CHUNK) == F.col("__k_chunk")]
    on = reduce(lambda a, b: a & b, pairs)
    return scanned.join(carry, on, "left").select(
        *[scanned[c] for c in df.columns],
        *[_combine(kind, F.col(f"__l_{name}"), F.col(f"__c_{name}")).alias(name)
          for name, (kind, _) in specs.items()],
    )


def _fold(kind: str, v: Column) -> Column:
    if kind == "last":
        return F.last(v, ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](v)


def _total(kind: str, v: Column, place: Column) -> Column:
    if kind == "last":
        return F.max_by(v, F.when(v.isNotNull(), place))
    return _fold(kind, v)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)

