"""Scores, ranked boards and contestant details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowboard.functions.scoring import ScoreConfig, score_columns
from flowboard.operators import windows as W
from flowboard.operators.scan import prefix_scan

KEYS = W.KEYS


def scores(latest: DataFrame, stability: DataFrame, verdicts: DataFrame | None,
           config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Score every submission that has a window; without a verdict it counts as fully correct."""
    df = latest.join(stability.select(*KEYS, "tps_cov"), KEYS, "left")
    if verdicts is not None:
        v = verdicts.select(*KEYS, F.col("correctness_score").alias("__correct"))
        df = df.join(v, KEYS, "left")
    else:
        df = df.withColumn("__correct", F.lit(None).cast("double"))
    parts = score_columns(
        F.col("tps"), F.col("p99_us"), F.col("error_rate"), F.coalesce("__correct", F.lit(1.0)),
        F.coalesce("tps_cov", F.lit(0.0)), config)
    return df.select(
        *KEYS, F.col("window_end").alias("computed_at"), *[c.alias(n) for n, c in parts.items()],
        "tps", "p50_us", "p99_us", "error_rate")


def ranked(entries: DataFrame, name: str = "rank") -> DataFrame:
    """Position in the run: composite down, p99 up, id up.

    A count scan chunked by composite, so a run of any size ranks in parallel.
    """
    order = [F.col("composite").desc(), F.col("p99_us").asc(), F.col("submission_id").asc()]
    band = F.floor(F.col("composite") * -100)
    out = prefix_scan(entries, ["run_id"], order, band, {name: ("count", F.lit(1))})
    return out.withColumn(name, F.col(name).cast("bigint"))


# Scores kept for an entry, and the parts of a run that the rank index counts.
SCORES = ["latency_score", "throughput_score", "correctness_score", "stability_score", "composite"]
BAND = ["run_id", "band", "part"]


def live_scores(old: DataFrame, new: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Kept state after a batch, for the submissions of `new`: merged moments, last window, last verdict, scores (null without a window)."""
    held = old.select(*KEYS, *[F.col(c).alias(f"__{c}") for c in ("n", "mean", "m2", "last", "correct")])
    both = new.join(held, KEYS, "left")
    n1, n2, total = F.coalesce("__n", F.lit(0)), F.col("n"), F.coalesce("__n", F.lit(0)) + F.col("n")
    gap = F.col("mean") - F.coalesce("__mean", F.lit(0.0))
    mean = F.when(total == 0, 0.0).otherwise(F.coalesce("__mean", F.lit(0.0)) + gap * n2 / total)
    m2 = F.when(total == 0, 0.0).otherwise(F.coalesce("__m2", F.lit(0.0)) + F.col("m2") + gap * gap * n1 * n2 / total)
    later = F.col("last").isNotNull() & (F.col("__last").isNull() | (F.col("last.window_end") >= F.col("__last.window_end")))
    state = both.select(*KEYS, total.alias("n"), mean.alias("mean"), m2.alias("m2"),
                        F.when(later, F.col("last")).otherwise(F.col("__last")).alias("last"), F.coalesce("correct", "__correct").alias("correct"))
    cov = F.when((F.col("n") >= 2) & (F.col("mean") > 0), F.sqrt(F.col("m2") / (F.col("n") - 1)) / F.col("mean")).otherwise(F.lit(0.0))
    parts = score_columns(F.col("last.tps"), F.col("last.p99_us"), F.col("last.error_rate"), F.coalesce("correct", F.lit(1.0)), cov, config)
    scored = F.col("last").isNotNull()
    return state.select("*", *[F.when(scored, parts[c]).alias(c) for c in SCORES], F.col("last.window_end").alias("computed_at"),
                        *[F.col(f"last.{c}").alias(c) for c in ("tps", "p50_us", "p99_us", "error_rate")])


def _banded(entries: DataFrame) -> DataFrame:
    """Scored entries with their band (better ones first) and its part by latency, sixteen to an octave."""
    octave = F.floor(F.log2(F.greatest(F.col("p99_us"), F.lit(1)).cast("double")) * 16)
    return entries.where(F.col("composite").isNotNull()).withColumn("band", F.floor(F.col("composite") * -100 + 0.5).cast("bigint")).withColumn(
        "part", F.when(F.col("p99_us") <= 0, -1).otherwise(octave).cast("bigint"))


def index_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What entries that change take from and add to the counts of the index."""
    left = _banded(old.withColumn("p99_us", F.col("last.p99_us"))).select(*BAND, F.lit(-1).alias("n"))
    came = _banded(new).select(*BAND, F.lit(1).alias("n"))
    return left.unionByName(came).groupBy(*BAND).agg(F.sum("n").alias("n"))


def ranks_in(some: DataFrame, entries: DataFrame, index: DataFrame) -> DataFrame:
    """Rank of some of the entries, by the index: entries in better bands, then the place in the own one.

    One row a band of a run is added up in order; entries are read for the bands of `some` only, and placed there in chunks.
    """
    wanted = _banded(some.withColumn("p99_us", F.col("last.p99_us"))).select(*KEYS, "band", "part")
    bands = wanted.select(*BAND).distinct()
    upto = Window.partitionBy("run_id").orderBy("band", "part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = index.where("n > 0").withColumn("ahead", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(bands, BAND, "left_semi")
    inside = _banded(entries).join(bands, BAND, "left_semi")
    placed = prefix_scan(inside, BAND, [F.col("p99_us").asc(), F.col("submission_id").asc()], F.struct("p99_us", F.left("submission_id", F.lit(6))), {"place": ("count", F.lit(1))})
    out = placed.join(wanted.select(*KEYS), KEYS, "left_semi").join(ahead.select(*BAND, "ahead"), BAND)
    kept = [c for c in entries.columns if c not in ("n", "mean", "m2", "last", "correct")]
    return out.select(*kept, (F.col("ahead") + F.col("place")).cast("bigint").alias("rank"))


def display_name(scored: Column, earlier: Column) -> Column:
    """Name of the score, else the one known before, else the head of the id."""
    return F.coalesce(F.nullif(scored, F.lit("")), F.nullif(earlier, F.lit("")), F.left("submission_id", F.lit(8)))


def with_names(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Attach display names; the optimizer broadcasts the names while they are small."""
    n = names.select(*KEYS, F.col("display_name").alias("__name"))
    return entries.join(n, KEYS, "left").withColumn(
        "display_name", display_name(F.lit(None).cast("string"), F.col("__name"))).drop("__name")


def with_health(entries: DataFrame, samples: DataFrame, first_scored: DataFrame | None = None,
                ts: str = "sample_ts") -> DataFrame:
    """Latest non-empty health per entry, READY without one. Samples before the first score do not count."""
    s = samples.filter(F.coalesce("health", F.lit("")) != "")
    if first_scored is not None:
        f = first_scored.groupBy(*KEYS).agg(F.min("first_score_ts").alias("__first"))
        s = s.join(f, KEYS).filter(F.col(ts) > F.col("__first"))
    latest = s.groupBy(*KEYS).agg(F.max_by("health", F.struct(ts, "seq")).alias("health"))
    return entries.join(latest, KEYS, "left").withColumn("health", F.coalesce("health", F.lit("READY")))


def board_filter(board: DataFrame, min_correctness: float = 0.0, health: str = "", search: str = "",
                 limit: int = 0, trim_search: bool = False) -> DataFrame:
    """Narrow a ranked board; ranks stay those of the whole board. Zero values set no limit."""
    out = board
    if min_correctness > 0:
        out = out.filter(F.col("correctness_score") >= min_correctness)
    if health:
        out = out.filter(F.upper("health") == health.upper())
    term = (search.strip() if trim_search else search).lower()
    if term:
        found = F.contains(F.lower("display_name"), F.lit(term)) | F.contains(F.lower("submission_id"), F.lit(term))
        out = out.filter(found)
    return out.orderBy("rank").limit(limit) if limit > 0 else out


def run_summaries(entries: DataFrame, updated: str = "computed_at") -> DataFrame:
    return entries.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("contestants"), F.max(updated).alias("last_update")
    ).orderBy(F.col("last_update").desc(), "run_id")


def latest_run(entries: DataFrame, updated: str = "computed_at") -> DataFrame:
    """Entries of the run with the newest update."""
    newest = entries.agg(F.max_by("run_id", F.struct(updated, "run_id")).alias("run_id"))
    return entries.join(newest, "run_id", "left_semi")


def rank_moves(score_updates: DataFrame) -> DataFrame:
    """Board after every update of a run, with the rank each entry had at the update before.

    `score_updates` has one row per (run, submission, update_no) that scored;
    an entry keeps its last score until it scores again.
    """
    updates = score_updates.select("run_id", "update_no").distinct()
    members = score_updates.groupBy(*KEYS).agg(F.min("update_no").alias("first_update"))
    grid = members.join(updates, "run_id").filter(F.col("update_no") >= F.col("first_update")).drop("first_update")
    held = Window.partitionBy(*KEYS).orderBy("update_no").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(score_updates.select(*KEYS, "update_no", "composite", "p99_us"), KEYS + ["update_no"], "left")
    for c in ("composite", "p99_us"):
        full = full.withColumn(c, F.last(c, ignorenulls=True).over(held))
    place = Window.partitionBy("run_id", "update_no").orderBy(F.desc("composite"), "p99_us", "submission_id")
    past = Window.partitionBy(*KEYS).orderBy("update_no")
    full = full.withColumn("rank", F.row_number().over(place).cast("bigint"))
    full = full.withColumn("prev_rank", F.coalesce(F.lag("rank").over(past), F.lit(0)).cast("bigint"))
    return full.withColumn("rank_delta", rank_delta(F.col("rank"), F.col("prev_rank")))


def rank_delta(rank: Column, prev: Column) -> Column:
    return F.when(prev == 0, F.lit(0)).otherwise(prev - rank).cast("bigint")


def contestant_detail(entries: DataFrame, rolling: DataFrame, verdicts: DataFrame, windows: DataFrame,
                      history: int = 120) -> DataFrame:
    """Entry, whole-run stats, verdict and the last windows as an array in time order."""
    fields = [c for c in W.WINDOW_COLUMNS if c not in (*KEYS, "window_kind")]
    past = W.last_windows(windows, history).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("history"))
    r = rolling.select(*KEYS, F.struct(*[c for c in rolling.columns if c not in KEYS]).alias("rolling"))
    v = verdicts.select(*KEYS, F.struct(*[c for c in verdicts.columns if c not in KEYS]).alias("validation"))
    return entries.join(r, KEYS, "left").join(v, KEYS, "left").join(past, KEYS, "left")


def sparkline(series: DataFrame, keys: list[str], order: str, value: str,
              width: float = 280.0, height: float = 56.0) -> DataFrame:
    """Plot coordinates of a bounded series (the last N windows) per key."""
    w = Window.partitionBy(*keys)
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order)) - 1
    hi = F.greatest(F.max(value).over(w), F.lit(1.0))
    lo = F.least(F.min(value).over(w), F.lit(0.0))
    step = F.when(n > 1, F.lit(width) / (n - 1)).otherwise(F.lit(width))
    x = i * step
    y = F.lit(height) - (F.col(value) - lo) / (hi - lo) * F.lit(height - 4) - 2
    return series.select(*keys, order, F.col(value), F.round(x, 1).alias("x"), F.round(y, 1).alias("y"))
