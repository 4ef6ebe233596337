"""Load-fleet summaries: shard merge, resources, order mix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowboard.operators import histograms


def merge_shards(snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One view of concurrent shards: counters add, histograms merge exactly, wall time is the longest.

    With the window in `keys` this is the live view, without it the cumulative
    one. `shard_seconds` is the longest per-shard total, the time base that
    stays right over several windows.
    """
    keys = list(keys)
    per_shard = snapshots.groupBy(*keys, "shard_id").agg(
        F.sum("transactions").alias("transactions"), F.sum("errors").alias("errors"),
        F.sum("timeouts").alias("timeouts"), F.max("window_seconds").alias("mx"), F.sum("window_seconds").alias("sm"))
    counters = per_shard.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("shards"), F.sum("transactions").alias("transactions"),
        F.sum("errors").alias("errors"), F.sum("timeouts").alias("timeouts"),
        F.max("mx").alias("max_window_seconds"), F.max("sm").alias("shard_seconds"))
    hist = histograms.merge(histograms.import_dense(snapshots, keys, "hdr_buckets"), keys)
    out = counters.join(histograms.summarise(hist, keys), keys, "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("p50_us", "p90_us", "p99_us", "max_us", "sample_count")]
    per_s = lambda s: F.when(F.col(s) > 0, F.col("transactions") / F.col(s)).otherwise(F.lit(0.0))
    return out.select(
        *keys, "shards", "transactions", "errors", "timeouts", "max_window_seconds", "shard_seconds",
        per_s("max_window_seconds").alias("tps"), per_s("shard_seconds").alias("tps_shard_seconds"),
        *zero, F.coalesce("mean_us", F.lit(0.0)).alias("mean_us"))


def resource_summary(samples: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """Average and peak CPU, peak memory, descriptors and connections per scale; zeros without samples."""
    out = samples.groupBy("scale").agg(
        F.round(F.avg("cpu_pct"), 1).alias("cpu_avg_pct"), F.round(F.max("cpu_pct"), 1).alias("cpu_peak_pct"),
        F.max("rss_peak_kb").alias("rss_peak_kb"), F.max("fds").alias("fds_peak"), F.max("conns").alias("conns_peak"))
    if scales is not None:
        out = scales.select("scale").distinct().join(out, "scale", "left").na.fill(0)
    return out


def benchmark_summary(runs: DataFrame, resources: DataFrame) -> DataFrame:
    """Fleet totals of each scale beside its resource use, in the column order of the summary file."""
    return runs.join(resources, "scale", "left").select(
        F.col("scale").alias("scale_label"), F.col("max_window_seconds").alias("duration_s"), "transactions",
        "errors", "tps", "p50_us", "p90_us", "p99_us", "cpu_avg_pct", "cpu_peak_pct", "rss_peak_kb", "fds_peak",
        "conns_peak")


def order_mix(orders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of limit, market and cancel orders per bot or persona."""
    share = lambda kind: F.avg(F.when(F.col("kind") == kind, 1.0).otherwise(0.0)).alias(f"{kind}_share")
    return orders.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("orders"), share("limit"), share("market"), share("cancel"))


def population_share(bots: DataFrame, persona: Column) -> DataFrame:
    """Share of each persona in the population."""
    counts = bots.groupBy(persona.alias("persona")).agg(F.count(F.lit(1)).alias("bots"))
    whole = Window.partitionBy(F.lit(1))  # one row per persona, not per bot
    return counts.select("persona", "bots", (F.col("bots") / F.sum("bots").over(whole)).alias("share"))
