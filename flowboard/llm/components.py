"""Connected components of a graph given by its edges, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowboard.llm.common import cut, drop


def component_labels(edges: DataFrame) -> DataFrame:
    """(u, label): for every node with an edge, the least node of its component.

    Alternates two steps until no edge changes: every node points its larger neighbours at its
    least neighbour, then its smaller ones. Edges turn into stars around the least node of
    each component in a number of rounds that grows with the logarithm of the graph. No node's
    neighbours are ever gathered: each step is one minimum per node and one join.
    """
    spark = edges.sparkSession
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = _state(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(small)
        for old in (now, large):
            drop(spark, old)
        now, state = new, _state(new)
        if state == seen:
            break
        seen = state
    return now.groupBy("u").agg(F.min("v").alias("label")).union(now.select(F.col("v").alias("u"), F.col("v").alias("label")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
