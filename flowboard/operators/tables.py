"""Keyed tables without a database: merge, change log, retention, board mirror."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowboard.session import mark, names_in, remove

# Keys of the stored tables.
TABLE_KEYS = {
    "window_aggregates": ["run_id", "submission_id", "window_start", "window_kind"],
    "rolling_stats": ["run_id", "submission_id"],
    "validation_results": ["run_id", "submission_id"],
    "scores": ["run_id", "submission_id"],
}
# Columns whose stored value never falls.
KEEP_MAX = {"rolling_stats": ["peak_tps"]}
BATCH = "batch_id"


def merge_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str,
                 keep_max: Sequence[str] = ()) -> DataFrame:
    """Upsert as one combining aggregate: the newest row per key wins, `keep_max` columns take the largest."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    out = both.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), version).alias("__r"), *[F.max(c).alias(f"__max_{c}") for c in keep_max])
    return out.select(*keys, *[
        F.col(f"__max_{c}").alias(c) if c in keep_max else F.col(f"__r.{c}").alias(c) for c in rest])


def write_changes(rows: DataFrame, path: str, batch_id: int) -> None:
    """Record one micro-batch of upserts. Writing the same batch again replaces it, so retries are safe."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BATCH}={batch_id}")


def read_current(spark: SparkSession, path: str, keys: Sequence[str], keep_max: Sequence[str] = ()) -> DataFrame:
    """Current row per key of a change log."""
    log = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in log.columns if c not in (*keys, BATCH)]
    out = log.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), BATCH).alias("__r"), *[F.max(c).alias(f"__max_{c}") for c in keep_max])
    return out.select(*keys, *[
        F.col(f"__max_{c}").alias(c) if c in keep_max else F.col(f"__r.{c}").alias(c) for c in rest])


class KeyedTable:
    """Current row per key: a snapshot and the changes of the batches after it.

    After `every` batches of changes a snapshot is written and named by one marker file; until the marker is there, readers use the one
    before. A read takes one snapshot and fewer than 2 x `every` changes however old the table is. Reading as of a batch and writing the
    same batch again are safe for the last batch, retried any number of times: its marker is passed over, and goes when it is written again. Folders
    below `path`: changes, snapshots, markers. Snapshots are laid out in ranges of the first key, so filters on it
    skip most of a snapshot. Rows for which `alive` does not hold leave at the next snapshot; readers filter them.
    """

    def __init__(self, path: str, keys: Sequence[str], keep_max: Sequence[str] = (), every: int = 8, alive: Column | None = None):
        self.path, self.keys, self.keep_max, self.every, self.alive = path.rstrip("/"), list(keys), list(keep_max), every, alive

    def _markers(self, spark: SparkSession) -> list[tuple[int, str]]:
        return sorted((int(batch), folder) for batch, _, folder in (n.partition("--") for n in names_in(spark, f"{self.path}/markers")) if folder)

    def sources(self, spark: SparkSession, before: int | None = None) -> tuple[str | None, list[str]]:
        """Folders that hold the state before batch `before`: the snapshot, if any, and changes in order."""
        marks = [m for m in self._markers(spark) if before is None or m[0] < before]
        last, folder = marks[-1] if marks else (-1, None)
        batches = sorted(int(n.partition("=")[2]) for n in names_in(spark, f"{self.path}/changes") if n.startswith(f"{BATCH}="))
        changed = [b for b in batches if b > last and (before is None or b < before)]
        return folder and f"{self.path}/snapshots/{folder}", [f"{self.path}/changes/{BATCH}={b}" for b in changed]

    def _log(self, spark: SparkSession, before: int | None) -> DataFrame | None:
        snapshot, changed = self.sources(spark, before)
        parts = [spark.read.parquet(snapshot)] if snapshot else []
        if changed:
            parts.append(spark.read.option("basePath", f"{self.path}/changes").parquet(*changed).withColumn(BATCH, F.col(BATCH).cast("bigint")))
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else None

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """State before batch `before` (the newest where None), or None where nothing was written. Filters on keys reach the files."""
        log = self._log(spark, before)
        return None if log is None else self._newest(log).drop(BATCH)

    def _newest(self, log: DataFrame) -> DataFrame:
        rest = [c for c in log.columns if c not in self.keys]
        out = log.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), BATCH).alias("__r"), *[F.max(c).alias(f"__max_{c}") for c in self.keep_max])
        return out.select(*self.keys, *[F.col(f"__max_{c}").alias(c) if c in self.keep_max else F.col(f"__r.{c}").alias(c) for c in rest])

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Record a batch's rows, one per key; now and then fold everything into a new snapshot."""
        spark = rows.sparkSession
        for batch, folder in self._markers(spark):
            if batch >= batch_id:  # of an attempt at this batch that is now made again
                remove(spark, f"{self.path}/markers/{batch:012d}--{folder}")
        write_changes(rows, f"{self.path}/changes", batch_id)
        if len(self.sources(spark, batch_id + 1)[1]) < self.every:
            return
        folder, state = f"{batch_id}-{uuid.uuid4().hex}", self._newest(self._log(spark, batch_id + 1))
        state = state if self.alive is None else state.where(self.alive)
        state.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/snapshots/{folder}")
        mark(spark, f"{self.path}/markers/{batch_id:012d}--{folder}")
        self._tidy(spark)

    def _tidy(self, spark: SparkSession) -> None:
        """Keep the newest two snapshots (of different batches) and the changes after the older one."""
        marks = self._markers(spark)
        batches = sorted({b for b, _ in marks})
        if len(batches) < 2:
            return
        keep, kept = batches[-2], {f for b, f in marks if b >= batches[-2]}
        for b, folder in marks:
            if b < keep:
                remove(spark, f"{self.path}/markers/{b:012d}--{folder}")
        for folder in names_in(spark, f"{self.path}/snapshots"):
            if folder not in kept:
                remove(spark, f"{self.path}/snapshots/{folder}")
        for name in names_in(spark, f"{self.path}/changes"):
            if name.startswith(f"{BATCH}=") and int(name.partition("=")[2]) <= keep:
                remove(spark, f"{self.path}/changes/{name}")


def append_samples(rows: DataFrame, path: str, ts: str = "sample_ts") -> None:
    """Append resource samples (nanosecond times, zero means now) or probe samples (timestamps) by day."""
    if dict(rows.dtypes)[ts] == "bigint":
        now = F.unix_micros(F.current_timestamp()) * 1000
        rows = rows.withColumn(ts, F.when(F.col(ts) == 0, now).otherwise(F.col(ts)))
        day = F.to_date(F.timestamp_micros(F.call_function("div", F.col(ts), F.lit(1000).cast("bigint"))))
    else:
        day = F.to_date(ts)
    rows.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def retain(rows: DataFrame, ts: str, days: int = 7) -> DataFrame:
    """Rows of the last `days` up to the newest one. The bound is one aggregate row."""
    bound = rows.agg((F.max(ts) - F.expr(f"interval {days} days")).alias("__bound"))
    return rows.join(F.broadcast(bound), F.col(ts) >= F.col("__bound")).drop("__bound")


def drop_days(spark: SparkSession, path: str, days: int = 7) -> list[str]:
    """Delete whole day folders of a sample table that lie `days` or more before its newest day; returns their names. No file is read or written."""
    from datetime import date, timedelta

    found = {n: date.fromisoformat(n.partition("=")[2]) for n in names_in(spark, path) if n.startswith("day=") and n[4:5].isdigit()}
    gone = [n for n, day in found.items() if day <= max(found.values()) - timedelta(days=days)]
    for name in gone:
        remove(spark, f"{path.rstrip('/')}/{name}")
    return gone


def dead_letters(routed: DataFrame) -> DataFrame:
    """Rejected envelopes, keyed by reason."""
    return routed.filter(F.col("reason").isNotNull())


def write_routed(routed: DataFrame, path: str, batch_id: int | None = None) -> None:
    """One folder per topic, the stand-in for topics where no broker is set."""
    target = path if batch_id is None else f"{path.rstrip('/')}/{BATCH}={batch_id}"
    routed.write.mode("overwrite").partitionBy("topic").parquet(target)


def write_board(board: DataFrame, path: str) -> None:
    """Mirror of the boards, one folder per run. Only the folders of runs in `board` are replaced."""
    board.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_board(spark: SparkSession, path: str, updated: str, now, ttl_hours: int = 24) -> DataFrame:
    """Boards rebuilt from the mirror; entries older than the time to live are gone."""
    return spark.read.parquet(path).filter(F.col(updated) >= now - F.expr(f"interval {ttl_hours} hours"))


def write_summary(summary: DataFrame, path: str, schema_version: str = "1.0") -> None:
    """Benchmark summary as CSV and as schema-versioned JSON records."""
    summary.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    summary.select(F.lit(schema_version).alias("schema_version"), F.struct(*summary.columns).alias("run")).write.mode(
        "overwrite").json(f"{path}/json")
