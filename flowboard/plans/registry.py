"""Named queries over the driver tables: operators wired to their inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowboard.functions import hdr, text
from flowboard.functions.scoring import ScoreConfig
from flowboard.functions.timeline import HOUR, nanos
from flowboard.operators import board, fleet, histograms, ingest, lifecycle, orderbook, rules, tables, windows
from flowboard.plans import views
from flowboard.session import cut, new_path, prepare
from flowboard.sources import envelopes
from flowboard.streaming import jobs

# The tables are sparse in time: one-hour slots, six-hour windows, 60 slots of retention.
SLOT = HOUR
WIDTH = 6
RETENTION = 60
KEYS = windows.KEYS
CONFIG = ScoreConfig(worst_p99_us=1_000_000.0, target_tps=0.001)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir, **args: fn(prepare(spark), sf_dir, **args)
    return fn


# ---- ingest -------------------------------------------------------------------------------

def _routed(spark, sf):
    good, _ = envelopes.decode_bodies(views.bodies(spark, sf))
    return envelopes.route(good, ingest_ts=F.col("emit_ts"))


@query
def envelope_triage(spark, sf):
    return _routed(spark, sf).select(
        "request_id", F.col("item").cast("bigint").alias("item"), "seq", "source", "type", "reason", "topic", "key", "ingest_ts")


@query
def rejected_bodies(spark, sf):
    return envelopes.decode_bodies(views.bodies(spark, sf))[1].select("request_id", "reason")


@query
def dead_letters(spark, sf):
    return tables.dead_letters(_routed(spark, sf)).select("request_id", F.col("item").cast("bigint").alias("item"), "key", "seq")


@query
def topic_counts(spark, sf):
    return ingest.topic_counts(_routed(spark, sf))


@query
def batch_accept_reject(spark, sf):
    return ingest.accept_reject(_routed(spark, sf))


@query
def ingest_rates(spark, sf):
    return ingest.rates(_routed(spark, sf), "emit_ts", HOUR)


@query
def ingest_bytes(spark, sf):
    return ingest.byte_rate(views.bodies(spark, sf).withColumn("ns", nanos(F.col("received_at"))), "body", "ns", HOUR).select(
        "window_start", F.col("bytes").cast("bigint").alias("bytes"), F.round("bytes_per_s", 6).alias("bytes_per_s"))


@query
def key_split(spark, sf):
    run, sub = envelopes.split_key(F.col("key"))
    return _routed(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("events")).select(
        "key", run.alias("run_part"), sub.alias("submission_part"), "events")


@query
def payload_acks(spark, sf):
    return envelopes.payload_of(_routed(spark, sf).filter("reason is null"), "order_ack").select(
        *KEYS, "seq", "bot_id", "order_id", "accepted", "recv_ts", "ack_latency_us")


@query
def payload_orders(spark, sf):
    return envelopes.order_stream(_routed(spark, sf).filter("reason is null")).select(
        *KEYS, "pos", "type", "order_id", "side", "kind", "price", "quantity", "accepted", "maker_order_id",
        "fill_price", "fill_quantity", "remaining_quantity")


@query
def payload_connections(spark, sf):
    return envelopes.payload_of(_routed(spark, sf).filter("reason is null"), "connection_opened")


@query
def payload_closings(spark, sf):
    return envelopes.payload_of(_routed(spark, sf).filter("reason is null"), "connection_closed")


@query
def native_bot_metrics(spark, sf):
    env = envelopes.native_bot_metrics(views.native_metrics(spark, sf))
    return envelopes.payload_of(envelopes.route(env).filter("reason is null"), "bot_metrics").join(
        env.select("seq", "source"), "seq").select(
        *KEYS, "seq", "source", "shard_id", "transactions", "errors", "timeouts", "window_seconds", "p50_us", "p99_us",
        "window_start_ts", "window_end_ts")


@query
def native_sandbox(spark, sf):
    env = envelopes.native_sandbox(views.native_sandbox(spark, sf))
    return env.select(*KEYS, "seq", "source", "type", F.get_json_object("payload", "$.pod_name").alias("pod_name"),
                      F.get_json_object("payload", "$.memory_bytes").cast("bigint").alias("memory_bytes"),
                      F.get_json_object("payload", "$.oom_killed").cast("boolean").alias("oom_killed"))


@query
def dedupe_events(spark, sf):
    return ingest.first_delivery(_routed(spark, sf), ["run_id", "submission_id", "seq"], "item").select(
        "run_id", "submission_id", "seq", "type", "source")


@query
def seq_gaps(spark, sf):
    gaps = ingest.sequence_gaps(views.sources(spark, sf), ["run_id", "source"])
    return gaps


# ---- windows ------------------------------------------------------------------------------

def _outcomes(spark, sf):
    return windows.ack_outcomes(views.acks(spark, sf))


def _cells(spark, sf):
    return windows.slot_cells(_outcomes(spark, sf), SLOT)


def _tumbling(spark, sf):
    return windows.tumbling(_outcomes(spark, sf), WIDTH, SLOT)


def _rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 9))
    return df


@query
def ack_outcomes(spark, sf):
    return _outcomes(spark, sf).select(*KEYS, "ts_ns", "bucket", "n", "max_us", "transactions", "errors", "timeouts")


@query
def slot_rollup(spark, sf):
    return windows.slot_rollup(_cells(spark, sf))


@query
def tumbling_windows(spark, sf):
    return _rounded(_tumbling(spark, sf), "tps", "error_rate", "mean_us")


@query
def sliding_windows(spark, sf):
    return _rounded(windows.sliding(_cells(spark, sf), WIDTH, SLOT), "tps", "error_rate", "mean_us")


@query
def live_windows(spark, sf):
    return _rounded(windows.latest_span(_cells(spark, sf), "sliding", WIDTH, SLOT), "tps", "error_rate", "mean_us")


@query
def rolling_horizon(spark, sf):
    return _rounded(windows.latest_span(_cells(spark, sf), "rolling", RETENTION, SLOT), "tps", "error_rate", "mean_us")


@query
def late_dropped(spark, sf):
    late = windows.split_late(views.late_acks(spark, sf), "seq", RETENTION, SLOT)
    return late.select(*KEYS, "seq", "epoch", "head", "is_late")


@query
def windows_after_late_drop(spark, sf):
    """Tumbling windows of acks that arrive hours late, without those behind the horizon."""
    outcomes = windows.ack_outcomes(views.from_events(views.table(spark, sf, "events"), lagged=True), "seq")
    kept = windows.drop_late(outcomes, "seq", RETENTION, SLOT)
    return _rounded(windows.tumbling(kept, WIDTH, SLOT), "tps", "error_rate", "mean_us")


@query
def preaggregated_windows(spark, sf):
    """Shard snapshots in full (histogram mode) and acks in one set of windows."""
    both = _outcomes(spark, sf).unionByName(windows.bot_metrics_outcomes(views.shard_metrics(spark, sf), True))
    return _rounded(windows.tumbling(both, WIDTH, SLOT), "tps", "error_rate", "mean_us")


@query
def topped_up_windows(spark, sf):
    """Default mode: snapshots only add their timeouts."""
    both = _outcomes(spark, sf).unionByName(windows.bot_metrics_outcomes(views.shard_metrics(spark, sf)))
    return windows.tumbling(both, WIDTH, SLOT).select(
        *KEYS, "window_start", "transactions", "errors", "timeouts", "p99_us", "sample_count")


@query
def rolling_stats(spark, sf):
    return _rounded(windows.rolling_stats(_tumbling(spark, sf)), "peak_tps", "current_tps", "error_rate", "tps_stddev", "tps_cov")


@query
def tps_stability(spark, sf):
    return _rounded(windows.tps_stability(_tumbling(spark, sf)), "mean_tps", "tps_cov")


@query
def window_history(spark, sf):
    return _rounded(windows.last_windows(_tumbling(spark, sf), 20), "tps", "error_rate", "mean_us").drop("window_kind")


# ---- histograms ---------------------------------------------------------------------------

@query
def hdr_buckets(spark, sf):
    h = histograms.build(views.acks(spark, sf), KEYS, F.col("ack_latency_us"))
    b = F.col("bucket")
    return h.select(*KEYS, "bucket", hdr.bucket_low(b).alias("low_us"), hdr.bucket_high(b).alias("high_us"), "n", "max_us")


@query
def hdr_percentiles(spark, sf):
    h = histograms.build(views.acks(spark, sf), KEYS, F.col("ack_latency_us"))
    ps = {"p0_us": 0.0, "p50_us": 50.0, "p90_us": 90.0, "p99_us": 99.0, "p999_us": 99.9, "p100_us": 100.0}
    return _rounded(histograms.summarise(h, KEYS, ps), "mean_us")


@query
def hdr_merge(spark, sf):
    """Slot histograms merged to the run."""
    cells = _cells(spark, sf).filter(F.col("n") > 0).select(*KEYS, "epoch", "bucket", "n", "max_us")
    return _rounded(histograms.summarise(histograms.merge(cells, ["run_id"]), ["run_id"]), "mean_us")


@query
def hdr_coordinated_omission(spark, sf):
    filled = histograms.build_corrected(views.acks(spark, sf), KEYS, "ack_latency_us", F.lit(50_000))
    return _rounded(histograms.summarise(filled, KEYS), "mean_us")


@query
def hdr_import(spark, sf):
    snaps = views.shard_metrics(spark, sf)
    rows = histograms.import_dense(snaps, KEYS, "hdr_buckets")
    return rows.groupBy(*KEYS, "bucket").agg(F.sum("n").alias("n"), F.max("max_us").alias("max_us"))


# ---- fleet --------------------------------------------------------------------------------

@query
def shard_merge(spark, sf):
    out = fleet.merge_shards(views.shard_metrics(spark, sf), [*KEYS, "window_start_ts"])
    return _rounded(out, "tps", "tps_shard_seconds", "mean_us")


@query
def shard_merge_cumulative(spark, sf):
    return _rounded(fleet.merge_shards(views.shard_metrics(spark, sf), KEYS), "tps", "tps_shard_seconds", "mean_us")


@query
def resource_summary(spark, sf):
    return fleet.resource_summary(views.resource_samples(spark, sf))


@query
def order_mix(spark, sf):
    return _rounded(fleet.order_mix(views.bot_orders(spark, sf), ["bot_id"]), "limit_share", "market_share", "cancel_share")


@query
def persona_mix(spark, sf):
    return _rounded(fleet.order_mix(views.bot_orders(spark, sf), ["persona"]), "limit_share", "market_share", "cancel_share")


@query
def persona_share(spark, sf):
    return _rounded(fleet.population_share(views.table(spark, sf, "customer"), F.col("c_mktsegment")), "share")


# ---- order book ---------------------------------------------------------------------------

_BOOKS: dict[tuple, tuple] = {}


def _state(spark, sf):
    """Names, sizes and times of the files a book is made from."""
    jvm, found = spark.sparkContext._jvm, []
    for name in ("orders", "lineitem"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)]
    return tuple(sorted(found))


def _book(spark, sf):
    """Book, checked fills and findings; written once per session and input state, then shared."""
    key = (spark.sparkContext.applicationId, sf, _state(spark, sf))
    if key not in _BOOKS:
        book = orderbook.rebuild(views.order_events(spark, sf))
        checked = cut(rules.checked_fills(book))
        _BOOKS[key] = (book, checked, cut(rules.findings(book, checked)))
    return _BOOKS[key]


def forget_books() -> None:
    """Rebuild books on the next use."""
    _BOOKS.clear()


@query
def order_lifetimes(spark, sf):
    lives = _book(spark, sf)[0].lives
    return lives.select(*KEYS, F.col("oid").alias("order_id"), "start", "end", "side", "price", "tick", "quantity", "outcome")


@query
def fills_vs_makers(spark, sf):
    f = _book(spark, sf)[0].fills
    side = lambda c: F.when(F.col(c) == -1, "sell").when(F.col(c) == 1, "buy").alias(c)
    return f.select(*KEYS, "pos", "order_id", "maker_order_id", "maker_rests", "maker_left", "maker_start",
                    side("maker_side"), "maker_tick", side("taker_side"), "taker_limit", "taker_price", "taker_left")


@query
def phantom_makers(spark, sf):
    f = _book(spark, sf)[0].fills
    return f.filter(~F.col("maker_rests")).select(*KEYS, "pos", "order_id", "maker_order_id")


def _rule(name):
    def run(spark, sf):
        found = _book(spark, sf)[2]
        return found.filter(F.col("rule") == name).select(*KEYS, "pos", "order_id", "message")
    return run


for _short, _name in {"trade_matching": "trade_matching", "fill_quantity": "fill_quantity",
                      "price_priority": "price_time_priority", "fifo": "fifo",
                      "book_consistency": "book_consistency"}.items():
    _fn = _rule(_name)
    _fn.__name__ = f"rule_{_short}"
    query(_fn)


@query
def best_price_before_fill(spark, sf):
    return _book(spark, sf)[1].filter("maker_rests").select(
        *KEYS, "pos", "maker_tick", "best_tick", "front_id", "crossed_after")


@query
def book_depth(spark, sf):
    return orderbook.depth(_book(spark, sf)[0])


DEPTH_STEP = 1000


@query
def book_depth_at(spark, sf):
    """Price levels after each 1,000th stream position of a submission, up to the one behind its last event."""
    book = _book(spark, sf)[0]
    step = lambda c: F.floor((c + DEPTH_STEP - 1) / DEPTH_STEP)
    ends = book.log.groupBy(*KEYS).agg(step(F.min("pos")).alias("lo"), step(F.max("pos")).alias("hi"))
    return orderbook.depth_at(book, ends.select(*KEYS, F.explode(F.transform(F.sequence("lo", "hi"), lambda i: i * DEPTH_STEP)).alias("at")))


@query
def top_of_book(spark, sf):
    return orderbook.top_of_book(orderbook.depth(_book(spark, sf)[0]))


@query
def violations_by_rule(spark, sf):
    return rules.violations_by_rule(_book(spark, sf)[2])


@query
def recent_findings(spark, sf):
    return rules.recent(_book(spark, sf)[2]).select(*KEYS, "pos", "rule", "order_id", "message")


def _verdicts(spark, sf):
    book, _, found = _book(spark, sf)
    return rules.verdicts(book, found)


@query
def correctness_score(spark, sf):
    return _verdicts(spark, sf).select(
        *KEYS, "orders_checked", "trades_checked", "violations", F.round("correctness_score", 9).alias("correctness_score"))


@query
def replay_verdict(spark, sf):
    """The full verdict in its stored form."""
    v = rules.verdict_json(_verdicts(spark, sf))
    return v.select(
        *KEYS, "orders_checked", "trades_checked", "violations", "violations_by_rule",
        F.round("correctness_score", 9).alias("correctness_score"),
        F.json_array_length("recent_findings").cast("bigint").alias("findings"))


# ---- scores and boards --------------------------------------------------------------------

def _scores(spark, sf, verdicts=True):
    tumbling = _tumbling(spark, sf)
    live = windows.latest_span(_cells(spark, sf), "sliding", WIDTH, SLOT)
    v = _verdicts(spark, sf) if verdicts else None
    return board.scores(live, windows.tps_stability(tumbling), v, CONFIG)


def _board(spark, sf, verdicts=True):
    entries = board.with_names(_scores(spark, sf, verdicts), views.names(spark, sf))
    first = _tumbling(spark, sf).groupBy(*KEYS).agg((F.unix_micros(F.min("window_end").cast("timestamp")) * 1000).alias("first_score_ts"))
    entries = board.with_health(entries, views.sandbox_samples(spark, sf), first)
    return board.ranked(entries)


_SCORE_COLUMNS = [*KEYS, "latency_score", "throughput_score", "correctness_score", "stability_score", "composite"]


@query
def score_components(spark, sf):
    return _scores(spark, sf).select(*_SCORE_COLUMNS[:-1])


@query
def composite_score(spark, sf):
    return _scores(spark, sf).select(*KEYS, "composite", F.round("tps", 9).alias("tps"), "p50_us", "p99_us", "computed_at")


@query
def leaderboard(spark, sf):
    return _board(spark, sf).select("rank", "display_name", "health", *_SCORE_COLUMNS, "p99_us")


@query
def leaderboard_latency_only(spark, sf):
    """Board without verdicts: every submission counts as correct."""
    return _board(spark, sf, verdicts=False).select("rank", "display_name", "health", *_SCORE_COLUMNS, "p99_us")


@query
def leaderboard_filtered(spark, sf):
    b = board.board_filter(_board(spark, sf), min_correctness=50.0, health="ready", search="NATION")
    return b.select("rank", *KEYS, "display_name", "health", "composite")


@query
def leaderboard_top_n(spark, sf, run_id="run-0"):
    """The first five of one run; the SQL twin shows the run that stands if none is named."""
    one_run = _board(spark, sf).filter(F.col("run_id") == run_id)
    return board.board_filter(one_run, limit=5).select("rank", *KEYS, "composite")


@query
def run_summaries(spark, sf):
    return board.run_summaries(_scores(spark, sf))


@query
def latest_run_board(spark, sf):
    return board.ranked(board.latest_run(_scores(spark, sf))).select("rank", *KEYS, "composite", "p99_us")


@query
def rank_moves(spark, sf):
    """Board after every six-hour window, each window being one update."""
    w = _tumbling(spark, sf)
    parts = board.score_columns(F.col("tps"), F.col("p99_us"), F.col("error_rate"), F.lit(1.0), F.lit(0.0), CONFIG)
    ups = w.select(*KEYS, F.unix_seconds(F.col("window_start").cast("timestamp")).alias("update_no"),
                   parts["composite"].alias("composite"), "p99_us")
    return board.rank_moves(ups)


@query
def board_health(spark, sf):
    entries = _tumbling(spark, sf).select(*KEYS).distinct()
    return board.with_health(entries, views.sandbox_samples(spark, sf))


@query
def display_names(spark, sf):
    return board.with_names(_tumbling(spark, sf).select(*KEYS).distinct(), views.names(spark, sf))


@query
def contestant_detail(spark, sf):
    w = _tumbling(spark, sf)
    d = board.contestant_detail(_scores(spark, sf), windows.rolling_stats(w), _verdicts(spark, sf), w, 20)
    return d.select(
        *KEYS, "composite", F.col("rolling.total_transactions").alias("total_transactions"),
        F.col("validation.violations").alias("violations"), F.size("history").cast("bigint").alias("windows"),
        F.element_at("history", 1)["window_start"].alias("first_window"),
        F.element_at("history", -1)["p99_us"].alias("last_p99_us"))


@query
def sparkline(spark, sf):
    last = windows.last_windows(_tumbling(spark, sf), 20)
    s = board.sparkline(last.withColumn("errors_d", F.col("errors").cast("double")), KEYS, "window_start", "errors_d")
    return s.select(*KEYS, "window_start", F.col("errors_d").alias("value"), "x", "y")


@query
def metric_text(spark, sf):
    return _tumbling(spark, sf).select(
        *KEYS, "window_start", text.micros_text(F.col("p99_us")).alias("p99_text"),
        text.tps_text(F.col("p50_us").cast("double")).alias("tps_text"),
        text.percent_text(F.col("errors") / (F.col("transactions") + F.col("errors"))).alias("error_text"))


@query
def bands(spark, sf):
    b = _board(spark, sf)
    return b.select(*KEYS, text.score_band(F.col("composite")).alias("score_band"),
                    text.health_band(F.col("health")).alias("health_band"))


@query
def retention(spark, sf):
    return tables.retain(_tumbling(spark, sf), "window_start", days=7).select(*KEYS, "window_start", "transactions")


@query
def upsert_peaks(spark, sf):
    """Rolling stats of the first half merged with those of the whole: newest wins, the peak never falls."""
    w = _tumbling(spark, sf)
    old = windows.rolling_stats(w.filter(F.col("window_start") < F.lit("2024-01-16").cast("timestamp_ntz")))
    new = windows.rolling_stats(w.filter(F.col("window_start") >= F.lit("2024-01-09").cast("timestamp_ntz")))
    out = tables.merge_latest(old, new, KEYS, "updated_at", keep_max=["peak_tps"])
    return _rounded(out.select(*KEYS, "updated_at", "total_transactions", "peak_tps", "current_tps"), "peak_tps", "current_tps")


# ---- sinks, written and read back ------------------------------------------------------------

@query
def stored_windows(spark, sf):
    """Two batches of window upserts with one key in common: the later one stands."""
    path, rows = new_path(spark, "windows"), cut(_tumbling(spark, sf))
    early = rows.filter(F.col("window_start") < F.lit("2024-01-16").cast("timestamp_ntz"))
    tables.write_changes(early.withColumn("transactions", F.col("transactions") + 1), path, 0)
    tables.write_changes(rows, path, 1)
    stored = tables.read_current(spark, path, tables.TABLE_KEYS["window_aggregates"])
    return _rounded(stored.select(*windows.WINDOW_COLUMNS), "tps", "error_rate", "mean_us")


def _stored(spark, name, first, second):
    """Two batches of upserts into a keyed table that folds after each second one, read back."""
    table = tables.KeyedTable(new_path(spark, name), tables.TABLE_KEYS[name], tables.KEEP_MAX.get(name, ()), every=2)
    table.write(first, 0)
    table.write(second, 1)
    return table.read(spark)


@query
def stored_scores(spark, sf):
    """Scores of all submissions, zeroes first, replaced by the real ones: the later batch stands."""
    rows = cut(_scores(spark, sf).select(*_SCORE_COLUMNS, "computed_at", "p99_us"))
    return _stored(spark, "scores", rows.withColumn("composite", F.lit(0.0)), rows)


@query
def stored_verdicts(spark, sf):
    """Verdicts in their stored form; the second batch brings only some submissions again."""
    rows = cut(rules.verdict_json(_verdicts(spark, sf)).select(*KEYS, "orders_checked", "violations", "violations_by_rule"))
    late = F.col("submission_id") < "sub-010"
    return _stored(spark, "validation_results", rows.withColumn("violations", F.when(late, 0).otherwise(F.col("violations"))), rows.where(late))


@query
def stored_peaks(spark, sf):
    """Rolling stats written twice, the second time without the first half: the peak never falls."""
    path, rows = new_path(spark, "rolling"), _tumbling(spark, sf)
    tables.write_changes(windows.rolling_stats(rows), path, 0)
    tables.write_changes(windows.rolling_stats(rows.filter(F.col("window_start") >= F.lit("2024-01-16").cast("timestamp_ntz"))), path, 1)
    stored = tables.read_current(spark, path, tables.TABLE_KEYS["rolling_stats"], tables.KEEP_MAX["rolling_stats"])
    return _rounded(stored.select(*KEYS, "total_transactions", "peak_tps"), "peak_tps")


@query
def stored_sandbox_samples(spark, sf):
    path = new_path(spark, "samples")
    tables.append_samples(views.sandbox_samples(spark, sf), path)
    return spark.read.parquet(path).select(*KEYS, "seq", "sample_ts", "pod_name", "health", F.col("day").cast("date").alias("day"))


@query
def stored_probe_samples(spark, sf):
    path = new_path(spark, "probes")
    tables.append_samples(views.probe_samples(spark, sf), path, "time")
    return spark.read.parquet(path).select("submission_id", "pos", "healthy", "latency_ms", F.col("day").cast("date").alias("day"))


@query
def board_mirror(spark, sf):
    """The board, mirrored and rebuilt; run-0 is older than the time to live and gone."""
    path = new_path(spark, "mirror")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    age = F.when(F.col("run_id") == "run-0", F.expr("interval 25 hours")).otherwise(F.expr("interval 23 hours"))
    rows = _board(spark, sf, verdicts=False).select(*KEYS, "rank", "composite", "p99_us", (now - age).alias("updated"))
    tables.write_board(rows, path)
    return tables.read_board(spark, path, "updated", now).select(*KEYS, "rank", F.round("composite", 9).alias("composite"), "p99_us")


@query
def summary_files(spark, sf):
    """Summaries of resource samples as files, the JSON records read back."""
    path = new_path(spark, "summary")
    summary = fleet.resource_summary(views.resource_samples(spark, sf))
    tables.write_summary(summary, path)
    back = spark.read.schema(f"schema_version string, run {summary.schema.simpleString()}").json(f"{path}/json")
    return back.select("schema_version", "run.*")


# ---- lifecycle ----------------------------------------------------------------------------

@query
def submission_checks(spark, sf):
    return lifecycle.check_submissions(views.submission_requests(spark, sf)).select("request_id", "entrypoint", "error")


@query
def terminal_submissions(spark, sf):
    return views.submissions(spark, sf).select("submission_id", "status", lifecycle.is_terminal(F.col("status")).alias("terminal"))


@query
def lifecycle_state(spark, sf):
    return lifecycle.current_state(lifecycle.replay(views.lifecycle_events(spark, sf)))


@query
def lifecycle_audit(spark, sf):
    a = lifecycle.audit(lifecycle.replay(views.lifecycle_events(spark, sf)))
    return a.select("submission_id", "pos", "occurred_at", "actor", "action", "prev_state", "new_state")


@query
def lifecycle_wire(spark, sf):
    """Lifecycle events through their wire form; a fifth of them in an unsupported version."""
    ev = views.lifecycle_events(spark, sf).select(
        F.col("pos").cast("string").alias("event_id"), F.col("event").alias("type"), "submission_id",
        F.col("occurred_at").cast("timestamp").alias("occurred_at"), F.col("actor").alias("producer"),
        F.when(F.col("actor") == "svc-error", 2).otherwise(1).alias("schema_version"), F.lit("{}").alias("data"))
    return envelopes.lifecycle_decode(envelopes.lifecycle_encode(ev)).groupBy("type").agg(
        F.count(F.lit(1)).alias("events"), F.max(F.col("occurred_at").cast("timestamp_ntz")).alias("last_at"))


_LATEST = ["created_at", "endpoint_id"]


@query
def latest_deployment(spark, sf):
    return lifecycle.latest(views.deployments(spark, sf), "submission_id", ["created_at", "deployment_id"])


@query
def submission_list(spark, sf):
    """Deployed submissions, last deployed first."""
    dep = lifecycle.latest(views.deployments(spark, sf), "submission_id", ["created_at", "deployment_id"])
    listed = views.submissions(spark, sf).join(dep.select("submission_id", "created_at"), "submission_id")
    return lifecycle.newest_first(listed, "created_at", "submission_id")


@query
def active_endpoints(spark, sf):
    return lifecycle.active_endpoints(views.endpoints(spark, sf), "submission_id", _LATEST)


@query
def submission_view(spark, sf):
    ep = lifecycle.endpoint_state(views.endpoints(spark, sf), "submission_id", _LATEST)
    return lifecycle.submission_view(views.submissions(spark, sf), ep)


@query
def deployment_view(spark, sf):
    ep = lifecycle.endpoint_state(views.endpoints(spark, sf), "submission_id", _LATEST)
    dep = lifecycle.latest(views.deployments(spark, sf), "submission_id", ["created_at", "deployment_id"])
    return lifecycle.deployment_view(views.submissions(spark, sf), dep, ep)


@query
def health_classifier(spark, sf):
    out = lifecycle.classify_health(views.probe_samples(spark, sf), slo_ms=100.0)
    return out.select("submission_id", "pos", "good", "state")


@query
def probe_last_n(spark, sf):
    return lifecycle.last_samples(views.probe_samples(spark, sf), ["submission_id"], ["time", "pos"], 10)


@query
def archive_audit(spark, sf):
    return lifecycle.audit_archives(views.archive_entries(spark, sf))


@query
def artifact_digest(spark, sf):
    return lifecycle.check_artifacts(views.artifacts(spark, sf))


# ---- streams ------------------------------------------------------------------------------

def _event_stream(spark, sf):
    """The events table as a file stream."""
    return jobs.file_source(spark, f"{sf}/events*.parquet", views.table(spark, sf, "events").schema, "parquet")


def _drain(spark, run):
    """Run a job over all data at hand; returns the folder it wrote."""
    out = new_path(spark, "stream")
    run(out, new_path(spark, "progress")).awaitTermination()
    return out


def _drain_batches(spark, batches, run):
    """Run a job over micro-batches, one at a time, each with all its partitions; returns the folder it wrote."""
    path, out, progress = new_path(spark, "source"), new_path(spark, "stream"), new_path(spark, "progress")
    for batch in batches:
        batch.write.mode("append").parquet(path)
        run(jobs.file_source(spark, path, batch.schema, "parquet"), out, progress).awaitTermination()
    return out


def _order_batches(events, n):
    """Order events cut into n stretches of the stream, each with all its partitions."""
    bounds = events.agg(F.percentile_approx("pos", [i / n for i in range(1, n)])).first()[0]
    at = sum((F.col("pos") > b).cast("int") for b in bounds)
    return [events.where(at == i) for i in range(n)]


def _stream_windows(spark, sf, kind):
    """Acks that arrive hours late; each file of events is a micro-batch."""
    outcomes = windows.ack_outcomes(views.from_events(_event_stream(spark, sf), lagged=True), "seq")
    out = _drain(spark, lambda o, c: jobs.live_windows(outcomes, kind, o, c, WIDTH, SLOT, RETENTION))
    return _rounded(jobs.closed_windows(spark, out), "tps", "error_rate", "mean_us")


@query
def stream_tumbling_windows(spark, sf):
    """All windows but the one each submission is in."""
    return _stream_windows(spark, sf, "tumbling")


@query
def stream_sliding_windows(spark, sf):
    return _stream_windows(spark, sf, "sliding")


@query
def stream_routes(spark, sf):
    bodies = views.from_events_body(_event_stream(spark, sf))
    out = _drain(spark, lambda o, c: jobs.ingest(bodies, o, c))
    return spark.read.parquet(f"{out}/routed").groupBy("topic", "reason").agg(F.count(F.lit(1)).alias("events"))


_EVENT = ["event_id", "user_id", "event_type", "value"]


@query
def stream_dedupe(spark, sf):
    """Every event delivered twice, kept once."""
    twice = _event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = _drain(spark, lambda o, c: jobs.dedupe(twice, ["event_id"], o, c))
    return spark.read.parquet(out).select(*_EVENT)


@query
def stream_dedupe_late(spark, sf):
    """Four micro-batches, old events last and again in the batch after: each is kept once, none lost."""
    events = views.table(spark, sf, "events")
    turn = F.pmod(-F.col("event_id"), F.lit(4))
    twice = events.withColumn("turn", F.explode(F.array(turn, (turn + 1) % 4)))
    out = _drain_batches(spark, [twice.where(F.col("turn") == i) for i in range(4)], lambda source, o, c: jobs.dedupe(source, ["event_id"], o, c))
    return spark.read.parquet(out).select(*_EVENT)


@query
def stream_verdict(spark, sf):
    """Verdicts after three micro-batches of order events, each going on from the kept books."""
    batches = _order_batches(cut(views.order_events(spark, sf)), 3)
    out = _drain_batches(spark, batches, lambda source, o, c: jobs.verdicts(source, o, c))
    v = rules.verdict_json(jobs.current_verdicts(spark, out))
    return v.select(*KEYS, "orders_checked", "trades_checked", "violations", "violations_by_rule", F.round("correctness_score", 9).alias("correctness_score"))


# Ends of the first three of four board updates; the verdicts come with the second.
UPDATES = ["2024-01-06", "2024-01-14", "2024-01-25"]


def _live_board(spark, sf):
    """Windows in four updates, closed order books' verdicts in the second and third: the folder of the job."""
    w, v = cut(_tumbling(spark, sf)), cut(_verdicts(spark, sf).select(*KEYS, "correctness_score", "orders_checked"))
    at = sum((F.col("window_start") >= F.lit(d).cast("timestamp_ntz")).cast("int") for d in UPDATES)
    early = F.col("submission_id") < "sub-010"
    said = [v.where("false"), v.where(early), v.where(~early), v.where("false")]
    pw, pv, out, progress = (new_path(spark, n) for n in ("source", "source", "stream", "progress"))
    for i in range(len(UPDATES) + 1):
        w.where(at == i).write.mode("append").parquet(pw)
        said[i].write.mode("append").parquet(pv)
        ws, vs = (jobs.file_source(spark, p, df.schema, "parquet") for p, df in ((pw, w), (pv, v)))
        jobs.score_board(ws, vs, out, progress, CONFIG).awaitTermination()
    return out


@query
def stream_board(spark, sf):
    """Scores and ranks from streams of closed tumbling windows and of verdicts, after four updates."""
    current = jobs.current_board(spark, _live_board(spark, sf))
    return current.select(*_SCORE_COLUMNS, "rank", "prev_rank")


@query
def stream_rank_moves(spark, sf):
    """What each of the four updates moved: ranks by the index of score bands, for the entries that it changed."""
    log = _live_board(spark, sf)
    moves = spark.read.option("basePath", f"{log}/moves").parquet(f"{log}/moves")
    return moves.select(*KEYS, F.col(tables.BATCH).cast("bigint").alias("update_no"), "composite", "rank", "prev_rank", "rank_delta")
