"""Literal cases of histograms, windows, scores, ingest, lifecycle, tables and text."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from flowboard.functions import hdr, scoring, text
from flowboard.functions.timeline import SECOND
from flowboard.operators import board, fleet, histograms, ingest, intervals, lifecycle, tables, windows
from flowboard.operators.scan import prefix_scan
from flowboard.plans import registry
from flowboard.sources import envelopes


def one(df):
    return df.first()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def hist(spark, values):
    df = spark.createDataFrame([("a", v) for v in values], "k string, v bigint")
    return histograms.build(df, ["k"], F.col("v"))


def percentiles(spark, values, ps):
    names = {f"p{i}": p for i, p in enumerate(ps)}
    r = one(histograms.summarise(hist(spark, values), ["k"], names))
    return [r[f"p{i}"] for i in range(len(ps))]


# ---- histograms ----

def walk_bucket(v):
    """Bucket bounds by walking the ranges instead of the closed form."""
    width, top = 1, 2048
    while v >= top:
        width, top = width * 2, top * 2
    low = v // width * width
    return low, low + width - 1


def test_bucket_bounds_match_a_walk(spark):
    vs = sorted({1, 2047, 2048, 4095, 4096, 9_999_999, 10_000_000, *[7**i for i in range(9)], *[2**i for i in range(24)],
                 *[2**i - 1 for i in range(1, 24)]})
    df = spark.createDataFrame([(v,) for v in vs], "v bigint").withColumn("b", hdr.bucket_of(F.col("v")))
    for r in df.withColumn("lo", hdr.bucket_low(F.col("b"))).withColumn("hi", hdr.bucket_high(F.col("b"))).collect():
        assert (r.lo, r.hi) == walk_bucket(r.v)
    assert hdr.DEFAULT.slots == 15_360
    assert value(spark, hdr.bucket_of(F.lit(10_000_000).cast("bigint"))) == 14_532
    assert value(spark, hdr.bucket_of(F.lit(99_000_000).cast("bigint"))) == 14_532
    assert value(spark, hdr.bucket_of(F.lit(-1).cast("bigint"))) is None


@pytest.mark.parametrize("layout", [hdr.Layout(1, 3_600_000, 2), hdr.Layout(1000, 10**8, 3), hdr.Layout(1, 10**6, 1)])
def test_other_layouts_hold_their_precision(spark, layout):
    df = spark.range(1, 200_000, 37).withColumn("b", hdr.bucket_of(F.col("id"), layout))
    df = df.withColumn("lo", hdr.bucket_low(F.col("b"), layout)).withColumn("hi", hdr.bucket_high(F.col("b"), layout))
    slack = F.greatest(F.lit(1 << layout.unit_bits), F.col("id") / 10**layout.digits)
    bad = df.filter((F.col("lo") > F.col("id")) | (F.col("hi") < F.col("id")) | (F.col("hi") - F.col("lo") >= slack))
    assert bad.count() == 0


def test_percentiles_of_a_line(spark):
    for got, want in zip(percentiles(spark, range(1, 10_001), [50, 90, 99, 100]), [5000, 9000, 9900, 10_000]):
        assert got == pytest.approx(want, rel=0.01)


def test_tail_rank_rounds_to_nearest(spark):
    assert percentiles(spark, [1000] * 99 + [1_000_000], [99]) == [1000]


def test_merge_equals_single(spark):
    odd, even = hist(spark, range(1, 20_001, 2)), hist(spark, range(2, 20_001, 2))
    merged = histograms.merge(odd.unionByName(even), ["k"])
    whole = hist(spark, range(1, 20_001))
    assert one(histograms.summarise(merged, ["k"])) == one(histograms.summarise(whole, ["k"]))


def test_stall_raises_the_tail(spark):
    df = spark.createDataFrame([("a", 1000)] * 1000 + [("a", 100_000)], "k string, v bigint")
    fixed = histograms.expected_interval_samples(df, "v", F.lit(1000))
    assert fixed.count() == 1000 + 100
    naive, honest = (one(histograms.summarise(histograms.build(d, ["k"], F.col("v")), ["k"])).p99_us for d in (df, fixed))
    assert honest > naive


def test_dense_round_trip_and_bad_input(spark):
    h = hist(spark, [5, 5, 700, 3000, 10_000_000])
    wire = histograms.export_dense(h, ["k"])
    back = histograms.import_dense(wire, ["k"], "hdr_buckets")
    assert sorted((r.bucket, r.n) for r in back.collect()) == sorted((r.bucket, r.n) for r in h.collect())
    long = base64.b64encode(json.dumps([1] * 15_365).encode()).decode()
    bad = spark.createDataFrame([("x", "!!"), ("y", ""), ("z", base64.b64encode(b"{}").decode()), ("l", long)], "k string, w string")
    assert {r.k for r in histograms.import_dense(bad, ["k"], "w").collect()} == {"l"}
    assert histograms.import_dense(bad, ["k"], "w").count() == 15_360


# ---- windows ----

def outcomes(spark, items):
    """(epoch second, latency, accepted) acks of one submission."""
    df = spark.createDataFrame([("r", "s", t * SECOND, lat, ok) for t, lat, ok in items],
                               "run_id string, submission_id string, recv_ts bigint, ack_latency_us bigint, accepted boolean")
    return windows.ack_outcomes(df)


def test_tumbling(spark):
    items = [(500 + i % 5, 1000, True) for i in range(10)] + [(505, 1000, True)]
    r = windows.tumbling(outcomes(spark, items)).orderBy("window_start").first()
    assert (r.transactions, r.tps) == (10, 2.0)
    assert 950 <= r.p50_us <= 1050


def test_errors_are_no_transactions(spark):
    df = outcomes(spark, [(10, 100, True)] * 8 + [(10, -1, False)] * 3)
    r = one(windows.tumbling(df))
    assert (r.transactions, r.errors, r.sample_count) == (8, 3, 8)
    assert r.error_rate == pytest.approx(3 / 11)


def test_late_rows_and_horizon(spark):
    df = outcomes(spark, [(1000, 1, True), (1020, 1, True), (1005, 1, True), (1011, 1, True)])
    df = df.withColumn("seq", F.monotonically_increasing_id())
    for chunk in (1, 1 << 20):
        late = windows.split_late(df.coalesce(1), "seq", 10, chunk_rows=chunk)
        assert sorted(r.epoch for r in late.filter("is_late").collect()) == [1005]
    assert one(windows.latest_span(windows.slot_cells(df), "rolling", 10)).transactions == 2


def test_sliding_and_rolling(spark):
    cells = windows.slot_cells(outcomes(spark, [(700 + i, 10, True) for i in range(30)]))
    assert one(windows.latest_span(cells, "sliding", 5)).transactions == 5
    assert one(windows.latest_span(cells, "rolling", 60)).transactions == 30
    assert windows.sliding(cells, 5).orderBy(F.desc("transactions")).first().transactions == 5


def window_table(spark, tps):
    return spark.createDataFrame(
        [("r", "s", i, i + 1, "tumbling", int(t), 0, t, 0.0, 1, 1, 1) for i, t in enumerate(tps)],
        "run_id string, submission_id string, window_start int, window_end int, window_kind string, transactions bigint, "
        "errors bigint, tps double, error_rate double, p50_us bigint, p90_us bigint, p99_us bigint")


@pytest.mark.parametrize("tps, sd, cov", [([100.0, 200.0, 300.0], 100.0, 0.5), ([100.0] * 5, 0.0, 0.0), ([7.0], 0.0, 0.0)])
def test_stability(spark, tps, sd, cov):
    r = one(windows.rolling_stats(window_table(spark, tps)))
    assert (r.tps_stddev, r.tps_cov, r.peak_tps, r.current_tps) == (pytest.approx(sd), pytest.approx(cov), max(tps), tps[-1])
    assert one(windows.tps_stability(window_table(spark, tps))).tps_cov == pytest.approx(cov)


def test_bot_metrics_modes(spark):
    wire = base64.b64encode(b"[0,2,1]").decode()
    df = spark.createDataFrame([("r", "s", 3 * SECOND, 10, 2, 1, wire)],
                               "run_id string, submission_id string, window_end_ts bigint, transactions bigint, errors bigint, "
                               "timeouts bigint, hdr_buckets string")
    plain = one(windows.tumbling(windows.bot_metrics_outcomes(df)))
    full = one(windows.tumbling(windows.bot_metrics_outcomes(df, True)))
    assert (plain.transactions, plain.timeouts, plain.sample_count) == (0, 1, 0)
    assert (full.transactions, full.errors, full.timeouts, full.sample_count, full.max_us) == (10, 2, 1, 3, 2)


# ---- scans and intervals ----

@pytest.mark.parametrize("width", [1, 3, 1000])
def test_prefix_scan(spark, width):
    data = [(k, i, (i * 7919) % 13 if i % 3 else None) for k in "ab" for i in range(40)]
    df = spark.createDataFrame(data, "k string, i bigint, v bigint")
    specs = {kind: (kind, F.col("v")) for kind in ("sum", "count", "max", "min", "last")}
    for inclusive in (True, False):
        got = prefix_scan(df, ["k"], [F.col("i")], F.floor(F.col("i") / width), specs, inclusive).collect()
        for r in got:
            seen = [v for k, i, v in data if k == r.k and v is not None and (i < r.i or (inclusive and i == r.i))]
            want = (sum(seen), len(seen), max(seen, default=None), min(seen, default=None), seen[-1] if seen else None)
            assert (r["sum"], r["count"], r["max"], r["min"], r["last"]) == want


@pytest.mark.parametrize("low_bits", [1, 3, 6])
def test_stab_matches_brute_force(spark, low_bits):
    spans = [("a", (i * 37) % 300, (i * 37) % 300 + (i * i) % 150, i) for i in range(60)] + [("b", 0, 5000, 7)]
    points = [(k, p) for k in "ab" for p in range(0, 460, 3)]
    got = intervals.stab(
        spark.createDataFrame(spans, "k string, lo bigint, hi bigint, w bigint"),
        spark.createDataFrame(points, "k string, at bigint"), ["k"], "lo", "hi", "at",
        {"best": F.max("w")}, {"best": F.max("best")}, low_bits)
    want = {}
    for k, p in points:
        hit = [w for kk, lo, hi, w in spans if kk == k and lo <= p <= hi]
        if hit:
            want[(k, p)] = max(hit)
    assert {(r.k, r["at"]): r.best for r in got.collect()} == want


# ---- scores and boards ----

def test_score_components(spark):
    score = lambda **kw: one(spark.range(1).select(*[c.alias(n) for n, c in scoring.score_columns(
        *[F.lit(float(kw.get(k, d))) for k, d in (("tps", 0), ("p99", 100), ("err", 0), ("cor", 1), ("cov", 0))]).items()]))
    assert score(p99=100).latency_score == 100 and score(p99=50_000).latency_score == 0 and score(p99=0).latency_score == 0
    assert 0 < score(p99=2000).latency_score < 100
    assert score(tps=200_000).throughput_score == 100 and score(tps=50_000).throughput_score == 50
    assert score(cov=0.5).stability_score == 50 and score(cov=9, err=1).stability_score == 0
    wrong, right = score(tps=100_000, p99=100, cor=0), score(tps=60_000, p99=800, cor=1, cov=0.05)
    assert right.composite > wrong.composite
    assert value(spark, scoring.round2(F.lit(1.005))) == 1.0


def entries(spark, rows):
    return spark.createDataFrame(rows, "run_id string, submission_id string, composite double, p99_us bigint")


def test_rank_order_and_filter(spark):
    b = board.ranked(entries(spark, [("r", "b", 50.0, 10), ("r", "a", 50.0, 10), ("r", "c", 50.0, 5), ("r", "d", 99.99, 9),
                                     ("q", "z", 0.0, 1)]))
    ranks = {(r.run_id, r.submission_id): r["rank"] for r in b.collect()}
    assert ranks == {("r", "d"): 1, ("r", "c"): 2, ("r", "a"): 3, ("r", "b"): 4, ("q", "z"): 1}
    full = b.withColumn("display_name", F.upper("submission_id")).withColumn("health", F.lit("Ready")).withColumn(
        "correctness_score", F.when(F.col("submission_id") == "a", 10.0).otherwise(90.0))
    kept = lambda **kw: sorted(r.submission_id for r in board.board_filter(full.filter("run_id = 'r'"), **kw).collect())
    assert kept() == ["a", "b", "c", "d"]
    assert kept(min_correctness=50) == ["b", "c", "d"]
    assert kept(health="READY", search="A") == ["a"]
    assert kept(limit=2) == ["c", "d"]
    assert kept(search=" A ", trim_search=True) == ["a"] and kept(search=" A ") == []


def test_rank_moves(spark):
    ups = spark.createDataFrame([("r", "a", 1, 10.0, 1), ("r", "b", 2, 20.0, 1), ("r", "a", 3, 30.0, 1)],
                                "run_id string, submission_id string, update_no bigint, composite double, p99_us bigint")
    got = {(r.update_no, r.submission_id): (r["rank"], r.prev_rank, r.rank_delta) for r in board.rank_moves(ups).collect()}
    assert got == {(1, "a"): (1, 0, 0), (2, "b"): (1, 0, 0), (2, "a"): (2, 1, -1), (3, "a"): (1, 2, 1), (3, "b"): (2, 1, -1)}


def test_health_before_first_score_is_ignored(spark):
    e = spark.createDataFrame([("r", "a"), ("r", "b")], "run_id string, submission_id string")
    s = spark.createDataFrame([("r", "a", 5, 1, "DEGRADED"), ("r", "b", 20, 2, "UNHEALTHY"), ("r", "b", 30, 3, "")],
                              "run_id string, submission_id string, sample_ts bigint, seq bigint, health string")
    first = e.withColumn("first_score_ts", F.lit(10))
    assert {r.submission_id: r.health for r in board.with_health(e, s, first).collect()} == {"a": "READY", "b": "UNHEALTHY"}


def test_text(spark):
    cases = [(text.micros_text(F.lit(999)), "999 µs"), (text.micros_text(F.lit(1500)), "1.50 ms"),
             (text.micros_text(F.lit(1_125)), "1.13 ms"), (text.micros_text(F.lit(151_295)), "151.29 ms"),
             (text.micros_text(F.lit(2_500_000)), "2,500.00 ms"), (text.tps_text(F.lit(950.0)), "950"),
             (text.tps_text(F.lit(12.5)), "13"), (text.tps_text(F.lit(15_200.0)), "15.2k"),
             (text.tps_text(F.lit(2_000_000.0)), "2.00M"), (text.percent_text(F.lit(0.123456)), "12.35%"),
             (text.score_band(F.lit(55.0)), "ok"), (text.score_band(F.lit(29.9)), "bad"),
             (text.health_band(F.lit("degraded")), "warn"), (text.health_band(F.lit("starting")), "muted")]
    assert [value(spark, c) for c, _ in cases] == [w for _, w in cases]


# ---- ingest ----

def envelope(**kw):
    return {"run_id": "r", "submission_id": "s", "seq": 1, "emit_ts": 5, "source": "x", "type": "order_ack", "payload": {"order_id": 1}, **kw}


def test_bodies(spark):
    ok = json.dumps(envelope())
    bodies = [" \n" + ok, f"[{ok},{ok}]", "", "  ", "nope", "[" + ok, json.dumps(envelope(seq="x")), "[]", f"{ok},{ok}"]
    good, bad = envelopes.decode_bodies(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"))
    assert sorted((r.id, r.item) for r in good.collect()) == [(0, 0), (1, 0), (1, 1)]
    assert {r.id: r.reason for r in bad.collect()} == {
        2: "empty body", 3: "empty body", 4: "invalid envelope JSON", 5: "invalid JSON array of envelopes",
        6: "invalid envelope JSON", 8: "invalid envelope JSON"}


def test_reasons_topics_and_keys(spark):
    rows = [envelope(), envelope(run_id=""), envelope(submission_id="", run_id="q"), envelope(type=""), envelope(type="zap"),
            envelope(type="bot_metrics"), {k: v for k, v in envelope().items() if k != "payload"}]
    good, _ = envelopes.decode_bodies(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "id int, body string"))
    got = {r.id: (r.reason, r.topic, r.key) for r in envelopes.route(good).collect()}
    dead = lambda reason: (reason, "telemetry.deadletter", reason)
    assert got == {0: (None, "telemetry.orders", "r:s"), 1: dead("missing run_id"), 2: dead("missing submission_id"),
                   3: dead("missing type"), 4: dead('unknown event type "zap"'), 5: (None, "telemetry.bot_metrics", "r:s"),
                   6: dead("empty payload")}
    run, sub = envelopes.split_key(F.lit("a:b:c"))
    assert (value(spark, run), value(spark, sub)) == ("a", "b:c")
    run, sub = envelopes.split_key(F.lit("abc"))
    assert (value(spark, run), value(spark, sub)) == ("abc", "")


def test_gaps_duplicates_and_counts(spark):
    df = spark.createDataFrame([("r", "x", s, a) for a, s in enumerate([1, 2, 2, 5, 9])], "run string, source string, seq bigint, at int")
    got = [(r.after_seq, r.next_seq, r.missing) for r in ingest.sequence_gaps(df, ["run", "source"], chunk_rows=2).orderBy("next_seq").collect()]
    assert got == [(2, 5, 2), (5, 9, 3)]
    assert [(r.seq, r["at"]) for r in ingest.first_delivery(df, ["seq"], "at").orderBy("seq").collect()] == [(1, 0), (2, 1), (5, 3), (9, 4)]


# ---- lifecycle ----

HAPPY = ["submission.created", "upload.succeeded", "validation.started", "validation.passed", "build.started", "build.succeeded",
         "scan.started", "scan.passed", "deployment.started", "deployment.pod_ready", "health.ready"]


@pytest.mark.parametrize("chunk", [1, 4, 4096])
def test_lifecycle(spark, chunk):
    streams = {"ok": HAPPY, "bad": HAPPY[:1] + ["build.succeeded"], "dead": HAPPY[:5] + ["build.failed", "health.ready"],
               "loop": HAPPY + ["health.degraded", "health.recovered", "health.recovered", "teardown.completed", "health.ready"]}
    df = spark.createDataFrame([(k, i, e) for k, ev in streams.items() for i, e in enumerate(ev)], "submission_id string, pos bigint, event string")
    out = lifecycle.replay(df, chunk_rows=chunk)
    state = {r.submission_id: (r.status, r.accepted_events, r.rejected_events, r.terminal) for r in lifecycle.current_state(out).collect()}
    assert state == {"ok": ("READY", 11, 0, False), "bad": ("CREATED", 1, 1, False), "dead": ("BUILD_FAILED", 6, 1, True),
                     "loop": ("TERMINATED", 14, 2, True)}
    audit = lifecycle.audit(out).filter("submission_id = 'dead'").orderBy("pos").collect()
    assert [(r.prev_state, r.new_state) for r in audit][-1] == ("BUILDING", "BUILD_FAILED")


@pytest.mark.parametrize("chunk", [1, 2, 1 << 20])
def test_classifier(spark, chunk):
    seq = [1, 1, 0, 0, 1, 0, 1, 1, 0, 0]
    df = spark.createDataFrame([("s", i, bool(g), 10.0) for i, g in enumerate(seq)], "submission_id string, pos bigint, healthy boolean, latency_ms double")
    out = lifecycle.classify_health(df, slo_ms=100, unhealthy_after=2, healthy_after=2, chunk_rows=chunk).orderBy("pos").collect()
    assert [r.state[0] for r in out] == list("URRDDDDRRD")
    slow = lifecycle.classify_health(df.withColumn("latency_ms", F.lit(101.0)), slo_ms=100, unhealthy_after=2, healthy_after=2)
    assert {r.state for r in slow.collect()} == {"UNKNOWN", "DEGRADED"}


def test_paths_and_archives(spark):
    clean = lambda p: value(spark, lifecycle.clean_path(F.lit(p)))
    assert [clean(p) for p in ("a/./b//c", "a/../../b", "../x", "./", "a/..", "/../a")] == ["a/b/c", "../b", "../x", ".", ".", "/a"]
    rows = [("ok", "go", 1, "bot/go.mod", "0", "", 0o644, 5), ("ok", "go", 2, "bot/main.go", "0", "", 0o644, 6),
            ("up", "go", 1, "../go.mod", "0", "", 0o644, 5), ("link", "go", 1, "l", "2", "/etc", 0o644, 0),
            ("suid", "go", 1, "x/./y", "0", "", 0o4755, 1), ("none", "rust", 1, "go.mod", "0", "", 0o644, 1),
            ("big", "go", 1, "go.mod", "0", "", 0o644, 90), ("big", "go", 2, "z", "0", "", 0o644, 20),
            ("many", "go", 1, "go.mod", "0", "", 0o644, 1), ("many", "go", 2, "a", "5", "", 0, 0), ("many", "go", 3, "../b", "5", "", 0, 0)]
    df = spark.createDataFrame(rows, "artifact_id string, language string, pos bigint, name string, typeflag string, linkname string, mode int, size bigint")
    got = {r.artifact_id: (r.error, r.files, r.bytes) for r in lifecycle.audit_archives(df, 100, 2, chunk_rows=2).collect()}
    assert got == {"ok": (None, 2, 11), "up": ('unsafe archive path "../go.mod"', None, None),
                   "link": ('unsafe link target "/etc"', None, None), "suid": ("setuid bit is forbidden on x/y", None, None),
                   "none": ("source archive missing required rust manifest or main file", None, None),
                   "big": ("archive exceeds decompressed size cap", None, None), "many": ("archive contains too many files", None, None)}


def test_artifacts(spark):
    rows = [("a", bytearray(b"\x7fELF.."), "binary", ""), ("b", bytearray(b"#!/bin"), "binary", ""), ("c", bytearray(b"x" * 50), "source", "00")]
    df = spark.createDataFrame(rows, "artifact_id string, content binary, submission_type string, expected_sha256 string")
    assert {r.artifact_id: r.error for r in lifecycle.check_artifacts(df).collect()} == {
        "a": None, "b": "binary artifact is not an ELF executable", "c": "sha256 mismatch"}
    assert {r.error for r in lifecycle.check_artifacts(df, 5).collect()} == {"artifact exceeds max upload size"}


# ---- fleet and tables ----

def test_shard_merge(spark):
    dense = lambda n: base64.b64encode(json.dumps([0] * 200 + [n]).encode()).decode()
    df = spark.createDataFrame([("r", "s", 0, 300, 2, 0, 5.0, dense(300)), ("r", "s", 1, 700, 0, 3, 5.0, dense(700))],
                               "run_id string, submission_id string, shard_id int, transactions bigint, errors bigint, timeouts bigint, "
                               "window_seconds double, hdr_buckets string")
    r = one(fleet.merge_shards(df, ["run_id", "submission_id"]))
    assert (r.transactions, r.errors, r.timeouts, r.p50_us, r.tps) == (1000, 2, 3, 200, 200.0)


def test_change_log_and_retention(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k string, v bigint, peak double")
    tables.write_changes(rows(("a", 1, 9.0), ("b", 1, 1.0)), path, 0)
    tables.write_changes(rows(("a", 2, 3.0)), path, 1)
    tables.write_changes(rows(("a", 3, 4.0)), path, 1)  # the same batch again
    got = {r.k: (r.v, r.peak) for r in tables.read_current(spark, path, ["k"], ["peak"]).collect()}
    assert got == {"a": (3, 9.0), "b": (1, 1.0)}
    days = spark.sql("select timestamp_ntz'2024-01-01' + make_dt_interval(id) t from range(10)")
    assert tables.retain(days, "t", 7).count() == 8


def test_board_mirror_and_summary_files(spark, tmp_path):
    b = spark.sql("select 'r' run_id, 's' submission_id, timestamp'2024-01-02 00:00:00' at union all "
                  "select 'r', 't', timestamp'2024-01-01 00:00:00'")
    tables.write_board(b, str(tmp_path / "b"))
    now = F.lit("2024-01-02 06:00:00").cast("timestamp")
    assert [r.submission_id for r in tables.read_board(spark, str(tmp_path / "b"), "at", now).collect()] == ["s"]
    tables.write_summary(b.select("run_id"), str(tmp_path / "sum"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sum" / "csv")).count() == 2
    assert spark.read.json(str(tmp_path / "sum" / "json")).first().schema_version == "1.0"


def test_append_samples(spark, tmp_path):
    path = str(tmp_path / "s")
    tables.append_samples(spark.createDataFrame([("a", 0), ("b", 1_704_067_200 * SECOND)], "k string, sample_ts bigint"), path)
    got = {r.k: r for r in spark.read.parquet(path).collect()}
    assert got["a"].sample_ts > 1_704_067_200 * SECOND and str(got["b"].day) == "2024-01-01"
    tables.append_samples(spark.sql("select timestamp'2024-01-03 00:00:00' time, true healthy"), str(tmp_path / "p"), "time")
    assert str(spark.read.parquet(str(tmp_path / "p")).first().day) == "2024-01-03"


def test_lifecycle_wire_rules(spark):
    rows = [("1", "a", "s", "p", 1), ("2", "a", "s", "p", 2), ("", "a", "s", "p", 1), ("4", "a", "s", "p", 0), ("5", "", "s", "p", 1)]
    df = spark.createDataFrame(rows, "event_id string, type string, submission_id string, producer string, schema_version int")
    df = df.withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp")).withColumn("data", F.lit('{"reason":"x"}'))
    wire = envelopes.lifecycle_encode(df)
    assert wire.count() == 2
    assert [r.event_id for r in envelopes.lifecycle_decode(wire).collect()] == ["1"]
    typed = envelopes.lifecycle_payload(df.filter("event_id = '1'").withColumn("type", F.lit("teardown.requested")), "teardown.requested")
    assert typed.first().reason == "x"


def test_corrected_histogram_equals_back_filled_samples(spark):
    import random
    rng = random.Random(0)
    values = [None, -5, 0, 1, 49, 50, 51, 99, 100, 101, 10_000_000, 25_000_000] + [rng.randrange(1, 3_000_000) for _ in range(60)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "k int, v bigint")
    for e in (0, 1, 7, 50, 1000, 400_000):
        few = df.filter(F.coalesce("v", F.lit(0)) < 5000 * max(e, 20))
        want = histograms.build(histograms.expected_interval_samples(few, "v", F.lit(e)), ["k"], F.col("v"))
        got = histograms.build_corrected(few, ["k"], "v", F.lit(e))
        pick = lambda d: sorted((r.k, r.bucket, r.n, r.max_us) for r in d.collect())
        assert pick(got) == pick(want), e
    stall = spark.createDataFrame([(1, 1 << 40)], "k int, v bigint")
    total = histograms.build_corrected(stall, ["k"], "v", F.lit(1)).agg(F.sum("n")).first()[0]
    assert total == 1 << 40


def test_top_n_of_any_run(spark, sf, monkeypatch):
    boards = spark.createDataFrame([(i + 1, f"run-{r}", f"s{i}", f"c{i}", 90.0 - i) for r in range(3) for i in range(7)],
                                   "rank int, run_id string, submission_id string, contestant_id string, composite double")
    monkeypatch.setattr(registry, "KEYS", ["run_id", "submission_id", "contestant_id"])
    monkeypatch.setattr(registry, "_board", lambda spark, sf: boards)
    top = registry.QUERIES["leaderboard_top_n"]
    for run, args in (("run-0", {}), ("run-2", {"run_id": "run-2"})):
        assert [(r["run_id"], r["rank"]) for r in top(spark, sf, **args).collect()] == [(run, i) for i in range(1, 6)]
    assert top(spark, sf, run_id="none").count() == 0
