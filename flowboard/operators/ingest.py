"""Counts, rates, duplicates and gaps of the ingested stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowboard.functions.timeline import SECOND, epoch_of, instant
from flowboard.operators.scan import prefix_scan


def accept_reject(routed: DataFrame, request: str = "request_id") -> DataFrame:
    return routed.groupBy(request).agg(
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"))


def topic_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("topic").agg(F.count(F.lit(1)).alias("events"))


def rates(routed: DataFrame, ts_ns: str, width_ns: int = 60 * SECOND) -> DataFrame:
    """Accepted events per second and type, and dead letters (type NULL), over fixed windows."""
    seconds = width_ns / SECOND
    kind = F.when(F.col("reason").isNull(), F.col("type"))
    return (
        routed.groupBy(epoch_of(F.col(ts_ns), width_ns).alias("w"), kind.alias("type"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(instant(F.col("w") * width_ns).alias("window_start"), "type", "events",
                (F.col("events") / F.lit(seconds)).alias("events_per_s"))
    )


def byte_rate(bodies: DataFrame, body: str, ts_ns: str, width_ns: int = 60 * SECOND) -> DataFrame:
    return (
        bodies.groupBy(epoch_of(F.col(ts_ns), width_ns).alias("w")).agg(F.sum(F.octet_length(body)).alias("bytes"))
        .select(instant(F.col("w") * width_ns).alias("window_start"), "bytes",
                (F.col("bytes") / F.lit(width_ns / SECOND)).alias("bytes_per_s"))
    )


def first_delivery(events: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """Keep the first delivery of each event. Repeats combine before the shuffle, so hot ids stay small."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), arrival).alias("e")).select(*keys, "e.*")


def sequence_gaps(events: DataFrame, keys: Sequence[str], seq: str = "seq", chunk_rows: int = 1 << 20) -> DataFrame:
    """Holes in a per-source sequence: the number before, the number after, how many are missing."""
    seen = prefix_scan(events, keys, [F.col(seq)], epoch_of(F.col(seq), chunk_rows),
                       {"after_seq": ("max", F.col(seq))}, inclusive=False)
    missing = F.col(seq) - F.col("after_seq") - 1
    return seen.filter(missing > 0).select(*keys, "after_seq", F.col(seq).alias("next_seq"), missing.alias("missing"))
