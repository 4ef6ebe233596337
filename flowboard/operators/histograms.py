"""Histogram tables: (keys, bucket, n) rows and what is read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowboard.functions import hdr


def build(df: DataFrame, keys: Sequence[str], value: Column, layout: hdr.Layout = hdr.DEFAULT) -> DataFrame:
    """Count samples per bucket; partial aggregation bounds what is shuffled."""
    return (
        df.select(*keys, hdr.bucket_of(value, layout).alias("bucket"), hdr.clamp(value, layout).alias("v"))
        .filter(F.col("bucket").isNotNull())
        .groupBy(*keys, "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("max_us"))
    )


def merge(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact merge to coarser keys (several slots or shards into one histogram)."""
    return hist.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.max("max_us").alias("max_us"))


def expected_interval_samples(df: DataFrame, value: str, interval: Column) -> DataFrame:
    """Back-fill samples a stall hid: v also stands for v-e, v-2e, ... down to e."""
    v, e = F.col(value), interval.cast("bigint")
    missing = F.when(
        (e > 0) & (v > e) & (v - e >= e), F.sequence(v - e, e, -e)
    ).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(value, F.explode(F.concat(F.array(v.cast("bigint")), missing)))


def build_corrected(df: DataFrame, keys: Sequence[str], value: str, interval: Column, layout: hdr.Layout = hdr.DEFAULT) -> DataFrame:
    """`build` over `expected_interval_samples`, without making the samples.

    The back-filled values v - k * e fall into each bucket a number of times that follows from its
    bounds, so a row gives at most one entry per bucket (or per sample, if those are fewer),
    however long the stall.
    """
    v, e = F.col(value).cast("bigint"), interval.cast("bigint")
    div = lambda x, y: F.call_function("div", x, y)
    last = F.when((e > 0) & (v > e), div(v, e) - 1).otherwise(F.lit(0).cast("bigint"))  # k from 1 to here
    top = hdr.bucket_of(F.lit(layout.highest), layout)
    one = F.lit(1).cast("bigint")

    def sampled(k: Column) -> Column:
        at = v - k * e
        return F.struct(hdr.bucket_of(at, layout).alias("bucket"), one.alias("n"), hdr.clamp(at, layout).alias("max_us"))

    def counted(b: Column) -> Column:
        low = hdr.bucket_low(b, layout)
        high = F.when(b == top, v).otherwise(hdr.bucket_high(b, layout))
        first = F.greatest(one, div(v - high + e - 1, e))
        until = F.least(last, div(v - low, e))
        return F.struct(b.alias("bucket"), F.greatest(until - first + 1, F.lit(0)).cast("bigint").alias("n"), hdr.clamp(v - first * e, layout).alias("max_us"))

    lowest, highest = hdr.bucket_of(v - last * e, layout), hdr.bucket_of(v - e, layout)
    filled = F.when(last < 1, F.array().cast("array<struct<bucket:int,n:bigint,max_us:bigint>>")).when(
        last <= highest - lowest + 1, F.transform(F.sequence(one, last), sampled)).otherwise(
        F.filter(F.transform(F.sequence(lowest, highest), counted), lambda c: c["n"] > 0))
    own = F.array(F.struct(hdr.bucket_of(v, layout).alias("bucket"), one.alias("n"), hdr.clamp(v, layout).alias("max_us")))
    rows = df.select(*keys, F.inline(F.concat(own, filled))).filter(F.col("bucket").isNotNull())
    return merge(rows, keys)


def quantile_columns(
    bucket: Column, cumulative: Column, total: Column, percentiles: dict[str, float],
    layout: hdr.Layout = hdr.DEFAULT,
) -> list[Column]:
    """Aggregates giving each percentile: upper end of the first bucket that reaches its rank."""
    high = hdr.bucket_high(bucket, layout)
    return [
        F.coalesce(F.min(F.when(cumulative >= hdr.rank_of(p, total), high)), F.lit(0)).cast("bigint").alias(name)
        for name, p in percentiles.items()
    ]


P50_90_99 = {"p50_us": 50.0, "p90_us": 90.0, "p99_us": 99.0}


def summarise(
    hist: DataFrame, keys: Sequence[str], percentiles: dict[str, float] | None = None,
    extra: Sequence[Column] = (), layout: hdr.Layout = hdr.DEFAULT,
) -> DataFrame:
    """Percentiles, count, max and mean per key.

    One exchange: the running count and the final group-by share the key
    partitioning. A group has at most `layout.slots` rows, whatever the data size.
    The mean is that of bucket lower ends, as after any merge.
    """
    w = Window.partitionBy(*keys)
    ordered = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counted = hist.withColumn("__cum", F.sum("n").over(ordered)).withColumn("__total", F.sum("n").over(w))
    low = hdr.bucket_low(F.col("bucket"), layout)
    samples = F.coalesce(F.sum("n"), F.lit(0))
    return counted.groupBy(*keys).agg(
        *quantile_columns(F.col("bucket"), F.col("__cum"), F.col("__total"), percentiles or P50_90_99, layout),
        F.coalesce(F.max("max_us"), F.lit(0)).cast("bigint").alias("max_us"),
        F.coalesce(F.sum(low * F.col("n")) / F.nullif(samples, F.lit(0)), F.lit(0.0)).alias("mean_us"),
        samples.cast("bigint").alias("sample_count"),
        *extra,
    )


def import_dense(df: DataFrame, keys: Sequence[str], encoded: str, layout: hdr.Layout = hdr.DEFAULT) -> DataFrame:
    """Decode base64 of a JSON count array. Bad or empty input gives no rows; surplus slots are ignored.

    The largest value known of an imported histogram is the lower end of its top bucket.
    """
    counts = F.from_json(F.unbase64(F.col(encoded)).cast("string"), "array<bigint>")
    return (
        df.select(*keys, F.posexplode(counts).alias("bucket", "n"))
        .filter((F.col("n") != 0) & (F.col("bucket") < layout.slots))
        .withColumn("max_us", hdr.bucket_low(F.col("bucket"), layout))
    )


def export_dense(hist: DataFrame, keys: Sequence[str], name: str = "hdr_buckets") -> DataFrame:
    """Dense JSON count array in base64, the wire form; at most `slots` entries per key."""
    zero = F.lit(0).cast("bigint")
    before = lambda i: F.when(i == 0, -1).otherwise(F.get("filled", i - 1)["bucket"])
    # Every entry brings the empty slots in front of it, so the work is one step per slot.
    dense = F.flatten(F.transform("filled", lambda x, i: F.concat(
        F.array_repeat(zero, (x["bucket"] - before(i) - 1).cast("int")), F.array(F.coalesce(x["n"], zero)))))
    return (
        hist.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("filled"))
        .select(*keys, F.base64(F.to_json(dense).cast("binary")).alias(name))
    )
