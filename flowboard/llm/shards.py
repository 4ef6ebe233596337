"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowboard.llm.common import chunk_of, documents, offsets, order_bounds


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the key and the shard alone."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard whose -ln(draw) / weight is least: each gets its share of keys by weight.

    A key's draw for a shard never changes, so adding a shard moves to it the keys it wins and no
    others, and changing one weight moves keys only to or from that shard. A null key is the key
    'null'. Ties go to the lower shard.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    costs = [F.struct((-F.log(_draw(name, s)) / float(w)).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return (F.array_min(F.array(*costs)).getField("shard") if len(costs) > 1 else F.lit(0)).cast("int")


def assign(docs: DataFrame, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    `weights` has one entry a shard, `grown` the entries after a change. `size` is the text's UTF-8
    bytes plus 8, a null text having none. Slots number the rows of a shard from 0 without gaps in
    order of doc_id (nulls first), then checksum, then size; rows equal in all three are alike, so
    their order does not matter. The law is `key`: doc_id and the shard weights decide, so rows with one
    doc_id share a shard and equal texts need not. An empty table gives no rows. Text never moves:
    what is shuffled is a few numbers a row, in chunks of the order that no shard can outgrow.
    """
    flat = documents(docs)
    bounds = order_bounds(flat.select("doc_id"))
    rows = flat.select(
        "doc_id", (F.octet_length("text") + 8).cast("bigint").alias("size"),
        F.crc32(F.col("text").cast("binary")).cast("bigint").alias("text_crc32"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        (rendezvous(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        chunk_of(F.col("doc_id"), bounds).alias("chunk"))
    before = offsets(rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n")), ["shard"], "chunk", "n").drop("n")
    inside = Window.partitionBy("shard", "chunk").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    placed = rows.withColumn("at", F.row_number().over(inside) - 1).join(before, ["shard", "chunk"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         (F.col("before") + F.col("at")).cast("bigint").alias("slot"), "grown_shard")
