"""Event-time windows over order outcomes.

Everything is a sum of *cells*: one row per (run, submission, slot, bucket)
with a sample count and outcome counters. Raw rows are reduced to cells once;
tumbling, sliding and rolling windows only regroup cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowboard.functions import hdr
from flowboard.functions.timeline import SECOND, epoch_of, instant
from flowboard.operators import histograms
from flowboard.operators.scan import prefix_scan

KEYS = ["run_id", "submission_id"]
WINDOW_COLUMNS = [
    "run_id", "submission_id", "window_start", "window_end", "window_kind", "transactions", "errors",
    "timeouts", "tps", "error_rate", "p50_us", "p90_us", "p99_us", "max_us", "mean_us", "sample_count",
]


def ack_outcomes(acks: DataFrame, *keep: str) -> DataFrame:
    """One outcome per ack at its receive time. A rejected ack is an error, not a transaction. `keep` names further columns."""
    rejected = ~F.col("accepted")
    return acks.select(
        *KEYS, F.col("recv_ts").alias("ts_ns"), hdr.bucket_of(F.col("ack_latency_us")).alias("bucket"),
        F.when(F.col("ack_latency_us") >= 0, 1).otherwise(0).cast("bigint").alias("n"),
        hdr.clamp(F.col("ack_latency_us")).alias("max_us"),
        (~rejected).cast("bigint").alias("transactions"), rejected.cast("bigint").alias("errors"),
        (F.col("is_timeout").cast("bigint") if "is_timeout" in acks.columns
         else F.lit(0).cast("bigint")).alias("timeouts"), *keep,
    )


def bot_metrics_outcomes(metrics: DataFrame, use_histogram: bool = False) -> DataFrame:
    """Pre-aggregated shard windows as outcomes at their end time.

    Default: only their timeouts count, the rest comes from raw acks. With
    ``use_histogram`` counters and the shipped histogram count in full.
    """
    none = F.lit(0).cast("bigint")
    counters = metrics.select(
        *KEYS, F.col("window_end_ts").alias("ts_ns"), F.lit(None).cast("int").alias("bucket"),
        none.alias("n"), F.lit(None).cast("bigint").alias("max_us"),
        (F.col("transactions") if use_histogram else none).alias("transactions"),
        (F.col("errors") if use_histogram else none).alias("errors"),
        F.col("timeouts").alias("timeouts"),
    )
    if not use_histogram:
        return counters
    samples = histograms.import_dense(metrics, KEYS + ["window_end_ts"], "hdr_buckets").select(
        *KEYS, F.col("window_end_ts").alias("ts_ns"), "bucket", "n", "max_us",
        none.alias("transactions"), none.alias("errors"), none.alias("timeouts"),
    )
    return counters.unionByName(samples)


def slot_cells(outcomes: DataFrame, slot_ns: int = SECOND) -> DataFrame:
    """Cells per slot; map-side combining keeps the shuffle at cells, not rows."""
    return regroup(outcomes.withColumn("epoch", epoch_of(F.col("ts_ns"), slot_ns)), KEYS + ["epoch"])


def regroup(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys, "bucket").agg(
        F.sum("n").alias("n"), F.max("max_us").alias("max_us"), F.sum("transactions").alias("transactions"),
        F.sum("errors").alias("errors"), F.sum("timeouts").alias("timeouts"),
    )


def slot_rollup(cells: DataFrame) -> DataFrame:
    """Counters per slot."""
    return cells.groupBy(*KEYS, "epoch").agg(
        F.sum("transactions").alias("transactions"), F.sum("errors").alias("errors"),
        F.sum("timeouts").alias("timeouts"), F.sum("n").alias("sample_count"),
        F.coalesce(F.max("max_us"), F.lit(0)).alias("max_us"),
    )


def window_rows(cells: DataFrame, kind: str, slots: int, slot_ns: int = SECOND) -> DataFrame:
    """Final window rows from cells keyed by `lo`, the first slot. TPS divides by the fixed span."""
    tx, err = F.sum("transactions"), F.sum("errors")
    seconds = slots * slot_ns / SECOND
    rows = histograms.summarise(
        cells, KEYS + ["lo"],
        extra=[tx.alias("transactions"), err.alias("errors"), F.sum("timeouts").alias("timeouts")],
    )
    total = F.col("transactions") + F.col("errors")
    return rows.select(
        *KEYS,
        instant(F.col("lo") * slot_ns).alias("window_start"),
        instant((F.col("lo") + slots) * slot_ns).alias("window_end"),
        F.lit(kind).alias("window_kind"), "transactions", "errors", "timeouts",
        (F.col("transactions") / F.lit(float(seconds))).alias("tps"),
        F.when(total > 0, F.col("errors") / total).otherwise(F.lit(0.0)).alias("error_rate"),
        "p50_us", "p90_us", "p99_us", "max_us", "mean_us", "sample_count",
    )


def tumbling(outcomes: DataFrame, slots: int = 5, slot_ns: int = SECOND) -> DataFrame:
    """Epoch-aligned, non-overlapping windows, straight from outcomes."""
    lo = epoch_of(F.col("ts_ns"), slots * slot_ns) * slots
    return window_rows(regroup(outcomes.withColumn("lo", lo), KEYS + ["lo"]), "tumbling", slots, slot_ns)


def sliding(cells: DataFrame, slots: int = 5, slot_ns: int = SECOND) -> DataFrame:
    """Every window of `slots` slots that holds data, one slot apart. Cells are replicated, not rows."""
    lo = F.explode(F.sequence(F.col("epoch") - (slots - 1), F.col("epoch")))
    return window_rows(regroup(cells.withColumn("lo", lo), KEYS + ["lo"]), "sliding", slots, slot_ns)


def latest_span(cells: DataFrame, kind: str, slots: int, slot_ns: int = SECOND) -> DataFrame:
    """The last `slots` slots up to each submission's newest slot: live sliding or rolling window."""
    heads = cells.groupBy(*KEYS).agg(F.max("epoch").alias("head"))
    inside = cells.join(heads, KEYS).filter(F.col("epoch") > F.col("head") - slots)
    return window_rows(
        regroup(inside.withColumn("lo", F.col("head") - (slots - 1)), KEYS + ["lo"]), kind, slots, slot_ns
    )


def split_late(outcomes: DataFrame, arrival: str, retention_slots: int, slot_ns: int = SECOND,
               chunk_rows: int = 1 << 20, heads: DataFrame | None = None) -> DataFrame:
    """Mark rows behind the newest slot their submission had reached on arrival.

    `arrival` is the stream position; `head` is the newest slot up to that row. `heads` gives the
    slot each submission had reached before these rows.
    """
    epoch = epoch_of(F.col("ts_ns"), slot_ns)
    chunk = epoch_of(F.col(arrival), chunk_rows)
    seen = prefix_scan(outcomes.withColumn("epoch", epoch), KEYS, [F.col(arrival)], chunk,
                       {"head": ("max", F.col("epoch"))})
    if heads is not None:
        earlier = heads.select(*KEYS, F.col("head").alias("__was"))
        seen = seen.join(earlier, KEYS, "left").withColumn("head", F.greatest("head", "__was")).drop("__was")
    return seen.withColumn("is_late", F.col("epoch") <= F.col("head") - retention_slots)


def drop_late(outcomes: DataFrame, arrival: str, retention_slots: int, slot_ns: int = SECOND) -> DataFrame:
    """Outcomes without those behind the horizon: what windows are built from."""
    return split_late(outcomes, arrival, retention_slots, slot_ns).filter(~F.col("is_late")).drop("epoch", "head", "is_late")


def rolling_stats(windows: DataFrame) -> DataFrame:
    """Whole-run view of the tumbling sequence: totals, last window, spread of TPS."""
    mean = F.avg("tps")
    sd = F.coalesce(F.stddev_samp("tps"), F.lit(0.0))
    last = lambda c: F.max_by(c, "window_start").alias({"tps": "current_tps"}.get(c, c))
    return windows.groupBy(*KEYS).agg(
        F.max("window_end").alias("updated_at"),
        F.sum("transactions").alias("total_transactions"), F.sum("errors").alias("total_errors"),
        F.max("tps").alias("peak_tps"), last("tps"), last("p50_us"), last("p90_us"), last("p99_us"),
        last("error_rate"), sd.alias("tps_stddev"),
        F.when(mean == 0, F.lit(0.0)).otherwise(sd / mean).alias("tps_cov"),
    )


def tps_stability(windows: DataFrame) -> DataFrame:
    """Variation as scoring reads it: needs two windows and a positive mean, else 0."""
    mean = F.avg("tps")
    return windows.filter(F.col("window_kind") == "tumbling").groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("windows"), mean.alias("mean_tps"),
        F.when((F.count(F.lit(1)) >= 2) & (mean > 0), F.stddev_samp("tps") / mean)
        .otherwise(F.lit(0.0)).alias("tps_cov"),
    )


def tps_moments(window: str) -> list[Column]:
    """Count, mean and summed squared deviations of the TPS of tumbling windows held in a struct column: they merge with others'."""
    tps = F.when(F.col(f"{window}.window_kind") == "tumbling", F.col(f"{window}.tps"))
    n = F.count(tps)
    return [n.alias("n"), F.coalesce(F.avg(tps), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(tps) * n, F.lit(0.0)).alias("m2")]


def latest_window(windows: DataFrame) -> DataFrame:
    """Newest window per submission, one aggregate pass."""
    rest = [c for c in windows.columns if c not in KEYS]
    return windows.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "window_start").alias("w")).select(*KEYS, "w.*")


def last_windows(windows: DataFrame, count: int = 120) -> DataFrame:
    """Last `count` tumbling windows per submission. The row-number limit is applied before the shuffle."""
    w = Window.partitionBy(*KEYS).orderBy(F.col("window_start").desc())
    return (
        windows.filter(F.col("window_kind") == "tumbling")
        .withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= count).drop("__rn")
    )
