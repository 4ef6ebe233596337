"""Aggregate over the intervals that contain a point, without a range join.

Each interval splits into aligned power-of-two blocks (at most two per size),
each point lies in exactly one block per size. Containment becomes an equi-join
on (key, size, block) against one pre-aggregated row per block, so the work is
n log n whatever the overlap, and no pair of interval and point is ever built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowboard.session import cut, discard

LOW_BITS = 6


def blocks(intervals: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Cover [lo, hi] (positions from 0) by aligned blocks: adds `level` and `block`.

    Positions count from 1 inside, so block 0 never occurs and a point needs no
    sizes beyond its own highest bit.
    """
    df = intervals.withColumn("__a", lo.cast("bigint") + 1).withColumn("__b", hi.cast("bigint") + 2)
    df = df.filter(F.col("__a") < F.col("__b"))
    pieces = F.expr(
        """
        filter(flatten(transform(sequence(0, length(bin(__b - __a)) - 1), l -> array(
          if(shiftright(__a + shiftleft(1L, l) - 1, l) < shiftright(__b, l)
             and shiftright(__a + shiftleft(1L, l) - 1, l) % 2 = 1,
             struct(l as level, shiftright(__a + shiftleft(1L, l) - 1, l) as block), null),
          if(shiftright(__a + shiftleft(1L, l) - 1, l) < shiftright(__b, l) and shiftright(__b, l) % 2 = 1,
             struct(l as level, shiftright(__b, l) - 1 as block), null)
        ))), p -> p is not null)
        """
    )
    return df.select(*intervals.columns, F.inline(pieces))


def stab(
    intervals: DataFrame, points: DataFrame, keys: Sequence[str], lo: str, hi: str, at: str,
    aggs: Mapping[str, Column], again: Mapping[str, Column], low_bits: int = LOW_BITS,
) -> DataFrame:
    """(keys, at, aggregates) for every distinct point that lies in some interval of its key.

    `aggs` reduces interval columns, `again` reduces those results further
    (max of max, min of min); both must be insensitive to repeats.
    Points meet blocks in aligned groups of 2^low_bits positions, each with one list of the fewer than 2^(low_bits+1) blocks
    in it; larger blocks are met by the groups in the same way, as points of another step. So no block is a hot join key.
    Blocks and points are written as tables (`discard` of the result deletes them), so that no plan holds the way to them twice.
    """
    keys = list(keys)
    nodes = cut(blocks(intervals, F.col(lo), F.col(hi)).groupBy(*keys, "level", "block").agg(
        *[c.alias(n) for n, c in aggs.items()]))
    step, up = max(low_bits, 1), [c.alias(n) for n, c in again.items()]
    place, group = F.col("__p"), F.shiftright("__p", step)
    top = nodes.agg(F.max("level")).first()[0]
    steps = [cut(points.select(*keys, (F.col(at).cast("bigint") + 1).alias("__p")).distinct())]
    while top is not None and len(steps) * step <= top:
        steps.append(cut(steps[-1].select(*keys, group.alias("__p")).distinct()))

    def met(pts: DataFrame, least: int, far: DataFrame | None) -> DataFrame:
        """(keys, __p, aggregates): what the blocks of sizes from 2^least hold at positions of that size, and what `far` says of larger ones."""
        here = nodes.filter(F.col("level").between(least, least + step - 1))
        inner = here.withColumn("__g", F.expr(f"shiftright(block, {least + step} - level)")).groupBy(*keys, "__g").agg(
            F.collect_list(F.struct("level", "block", F.struct(*aggs).alias("found"))).alias("__near"))
        both = pts.withColumn("__g", group).join(inner, [*keys, "__g"], "left")
        hit = F.expr(f"transform(filter(__near, b -> shiftright(__p, b.level - {least}) = b.block), b -> b.found)")
        if far is not None:
            more = far.select(*keys, place.alias("__g"), F.array(F.struct(*aggs)).alias("__far"))
            none = F.array().cast(more.schema["__far"].dataType)
            both, hit = both.join(more, [*keys, "__g"], "left"), F.concat(F.coalesce(hit, none), F.coalesce("__far", none))
        return both.select(*keys, "__p", F.inline(hit)).groupBy(*keys, "__p").agg(*up)

    far = None
    for i in range(len(steps) - 1, 0, -1):
        larger, far = far, cut(met(steps[i], i * step, far))
        for done in [steps[i]] + [larger] * (larger is not None):
            discard(done)
    return met(steps[0], 0, far).select(*keys, (place - 1).alias(at), *again)
