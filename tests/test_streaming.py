"""Streams against their batch twins, on driver tables and random order streams."""

import json

import pytest
from book_cases import random_stream
from book_model import Model
from pyspark.sql import functions as F

from flowboard import schemas
from flowboard.functions.timeline import HOUR
from flowboard.functions.scoring import ScoreConfig
from flowboard.operators import orderbook, rules, tables, windows
from flowboard.plans import registry, views
from flowboard.plans.registry import QUERIES
from flowboard.sources import envelopes
from flowboard.streaming import jobs


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture()
def events(spark, sf, tmp_path):
    """The events table as JSON-free parquet files in time order, three micro-batches."""
    df = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "in")
    for i in range(3):
        df.filter((F.col("event_id") >= i * 400) & (F.col("event_id") < (i + 1) * 400)).coalesce(1).write.mode(
            "append").parquet(src)
    return jobs.file_source(spark, src, df.schema, "parquet", maxFilesPerTrigger="1"), df


@pytest.mark.parametrize("kind", ["tumbling", "sliding"])
def test_windows_equal_batch_but_for_the_open_one(spark, events, tmp_path, kind):
    """Acks hours late in three micro-batches: closed windows that late rows reach are written again."""
    stream, table = events
    out = str(tmp_path / "out")
    outcomes = windows.ack_outcomes(views.from_events(stream, lagged=True), "seq")
    jobs.live_windows(outcomes, kind, out, str(tmp_path / "cp"), slots=6, slot_ns=HOUR, retention_slots=60).awaitTermination()
    got = jobs.closed_windows(spark, out)
    batch = windows.ack_outcomes(views.from_events(table, lagged=True), "seq")
    kept = windows.drop_late(batch, "seq", 60, HOUR)
    assert kept.count() < batch.count()
    want = windows.tumbling(kept, 6, HOUR) if kind == "tumbling" else windows.sliding(windows.slot_cells(kept, HOUR), 6, HOUR)
    heads = batch.groupBy("run_id", "submission_id").agg(((F.max("ts_ns") - F.max("ts_ns") % HOUR) / 1000).cast("bigint").alias("head"))
    want = want.join(heads, ["run_id", "submission_id"]).filter(F.unix_micros(F.col("window_end").cast("timestamp")) <= F.col("head"))
    assert got.count() > 100
    assert rows(got.select(windows.WINDOW_COLUMNS)) == rows(want.select(windows.WINDOW_COLUMNS))
    assert spark.read.parquet(f"{out}/windows").count() > got.count()


def test_ingest_equals_batch(spark, events, tmp_path):
    stream, table = events
    out = str(tmp_path / "out")
    jobs.ingest(views.from_events_body(stream), out, str(tmp_path / "cp")).awaitTermination()
    good, bad = envelopes.decode_bodies(views.from_events_body(table))
    got = spark.read.parquet(f"{out}/routed").groupBy("topic", "reason").count()
    assert rows(got) == rows(envelopes.route(good).groupBy("topic", "reason").count())
    assert spark.read.parquet(f"{out}/rejected").count() == bad.count()


def test_dedupe(spark, events, tmp_path):
    stream, table = events
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = str(tmp_path / "out")
    jobs.dedupe(twice, ["event_id"], out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == table.count()


def test_dedupe_keeps_first_deliveries_that_come_late(spark, tmp_path):
    """Ids at 10:00, 12:00, 12:30 and 10:30 as four micro-batches, then one of them again."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, at in ((0, "10:00"), (1, "12:00"), (2, "12:30"), (3, "10:30"), (1, "12:00")):
        spark.createDataFrame([(i, at)], "id bigint, at string").coalesce(1).write.mode("append").parquet(src)
    stream = jobs.file_source(spark, src, spark.createDataFrame([], "id bigint, at string").schema, "parquet", maxFilesPerTrigger="1")
    jobs.dedupe(stream, ["id"], out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]


def _windows(rng, batches, subs, per):
    """Per batch a list of window rows of some submissions, times rising."""
    from datetime import datetime, timedelta

    out, at = [], datetime(2024, 1, 1)
    for _ in range(batches):
        rows_ = []
        for s in rng.sample(range(subs), rng.randrange(1, subs)):
            for kind in ("tumbling",) * rng.randrange(1, per) + ("sliding",):
                at += timedelta(seconds=5)
                rows_.append(("r", f"sub-{s:03d}", at, at + timedelta(seconds=5), kind, 0, 0, 0, rng.choice([0.0, rng.uniform(1, 2e5)]), rng.choice([0.0, rng.random()]), 1, 1,
                              rng.choice([0, 90, 5000, 10**6]), 1, 1.0, 1))
        out.append(rows_)
    return out


def _running_board(batches, verdicts, config):
    """The board after each update, from all windows so far."""
    import math
    import statistics

    seen, said, boards = {}, {}, []
    for rows_, told in zip(batches, verdicts):
        for w in rows_:
            seen.setdefault(w[1], []).append(w)
        said.update(told)
        entries = []
        for sub, ws in seen.items():
            last, tps = max(ws, key=lambda w: w[3]), [w[8] for w in ws if w[4] == "tumbling"]
            cov = statistics.stdev(tps) / statistics.mean(tps) if len(tps) > 1 and statistics.mean(tps) > 0 else 0.0
            clamp = lambda x: max(0.0, min(1.0, x))
            cor, p99 = clamp(said.get(sub, 1.0)), last[12]
            x = max(config.best_p99_us, min(config.worst_p99_us, p99))
            lat = 0.0 if p99 <= 0 else 100 * clamp((math.log10(config.worst_p99_us) - math.log10(x)) / (math.log10(config.worst_p99_us) - math.log10(config.best_p99_us)))
            parts = [lat, 100 * clamp(last[8] / config.target_tps), 100 * cor, 100 * clamp(1 - clamp(cov) - clamp(last[9]))]
            total = sum(a * b for a, b in zip((0.35, 0.30, 0.25, 0.10), parts)) * (0.5 + 0.5 * cor)
            entries.append((-math.floor(total * 100 + 0.5) / 100, p99, sub))
        boards.append({e[2]: (i + 1, -e[0]) for i, e in enumerate(sorted(entries))})
    return boards


def test_score_board(spark, tmp_path):
    """Windows and verdicts over nine updates: scores and ranks of each, against a board worked out from the whole history."""
    import random

    rng, config = random.Random(3), ScoreConfig()
    batches = _windows(rng, 9, 12, 4)
    told = [{f"sub-{s:03d}": rng.choice([0.0, rng.random(), 1.0]) for s in rng.sample(range(14), rng.randrange(3))} for _ in batches]
    pw, pv, out = str(tmp_path / "w"), str(tmp_path / "v"), str(tmp_path / "out")
    ws = schemas_of_windows(spark)
    want = _running_board(batches, told, config)
    verdict = "run_id string, submission_id string, correctness_score double, orders_checked bigint"
    for i, (rows_, v) in enumerate(zip(batches, told)):
        spark.createDataFrame(rows_, ws).repartition(2).write.mode("append").parquet(pw)
        spark.createDataFrame([("r", s, c, i) for s, c in v.items()], verdict).coalesce(1).write.mode("append").parquet(pv)
        streams = [jobs.file_source(spark, p, spark.createDataFrame([], x).schema, "parquet") for p, x in ((pw, ws), (pv, verdict))]
        jobs.score_board(*streams, out, str(tmp_path / "cp"), config).awaitTermination()
    log = spark.read.option("basePath", f"{out}/moves").parquet(f"{out}/moves").collect()
    assert len({r.batch_id for r in log}) == 9 and any(r.prev_rank not in (0, r["rank"]) for r in log)
    for r in log:
        before = want[r.batch_id - 1].get(r.submission_id, (0,))[0] if r.batch_id else 0
        assert (r["rank"], r.prev_rank) == (want[r.batch_id][r.submission_id][0], before)
        assert r.composite == pytest.approx(want[r.batch_id][r.submission_id][1], abs=0.0101)
    last = jobs.current_board(spark, out).collect()
    assert {r.submission_id: (r["rank"], r.prev_rank) for r in last} == {s: (k, want[-2].get(s, (0,))[0]) for s, (k, _) in want[-1].items()}
    # What a batch reads is one snapshot and a bounded number of changes, however many updates there were.
    snapshot, changes = tables.KeyedTable(f"{out}/scores", ["run_id", "submission_id"]).sources(spark)
    assert snapshot and len(changes) < 8


def schemas_of_windows(spark):
    return ("run_id string, submission_id string, window_start timestamp_ntz, window_end timestamp_ntz, window_kind string, transactions bigint, errors bigint, "
            "timeouts bigint, tps double, error_rate double, p50_us bigint, p90_us bigint, p99_us bigint, max_us bigint, mean_us double, sample_count bigint")


def test_verdicts_over_batches(spark, tmp_path):
    """Nine micro-batches with orders that live across them, order ids beyond 2^53."""
    big = 1 << 53
    streams = {f"s{i}": random_stream(f"s{i}", 50 + i, n=150, irregular=True) for i in range(2)}
    for events in streams.values():
        for e in events:
            for name in ("order_id", "maker_order_id"):
                e[name] = e[name] if e[name] is None else big + e[name]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    cuts = [0, 40, 90, 100, 150, 200, 260, 300, 320, 10**9]
    for lo, hi in zip(cuts, cuts[1:]):
        part = [tuple(e.values()) for s in streams.values() for e in s if lo <= e["pos"] < hi]
        spark.createDataFrame(part, schemas.ORDER_EVENT).coalesce(1).write.mode("append").parquet(src)
    schema = spark.createDataFrame([], schemas.ORDER_EVENT).schema
    jobs.verdicts(jobs.file_source(spark, src, schema, "parquet", maxFilesPerTrigger="1"), out, str(tmp_path / "cp")).awaitTermination()
    got = {r.submission_id: r for r in rules.verdict_json(jobs.current_verdicts(spark, out)).collect()}
    # Only open orders are left in the book's snapshot, and every batch but the last few is folded into it.
    snapshot, changes = tables.KeyedTable(f"{out}/resting", orderbook.ORDER).sources(spark)
    assert len(changes) == 1 and spark.read.parquet(snapshot).where("r_pos is null").isEmpty()
    for sub, events in streams.items():
        want, r = Model(events), got[sub]
        assert (r.orders_checked, r.trades_checked, r.violations) == (want.orders, want.trades, len(want.findings))
        assert json.loads(r.violations_by_rule) == want.by_rule
        back = rules.verdict_from_json(spark.createDataFrame([(r.violations_by_rule, r.recent_findings)], "violations_by_rule string, recent_findings string")).first()
        assert [tuple(x) for x in back.recent_findings] == want.findings[-25:]


def test_micro_batches_keep_their_partitions(spark, sf, monkeypatch):
    """Each micro-batch of `stream_dedupe_late` is as many files as it has partitions."""
    events, made, new_path = views.table(spark, sf, "events").repartition(5), {}, registry.new_path
    monkeypatch.setattr(registry.views, "table", lambda *_: events)
    monkeypatch.setattr(registry, "new_path", lambda spark, kind: made.setdefault(kind, new_path(spark, kind)))
    got = QUERIES["stream_dedupe_late"](spark, sf)
    assert rows(got) == rows(events.select(*got.columns))
    files = spark.read.parquet(made["source"]).select(F.input_file_name().alias("f"), "turn").distinct().groupBy("turn").count().collect()
    assert {r["turn"]: r["count"] for r in files} == {i: 5 for i in range(4)}


def test_keyed_table_reads_stay_bounded_and_retries_are_safe(spark, tmp_path):
    """Many batches, some written twice or with a compaction cut short: the newest row per key, few folders read."""
    table, want, schema = tables.KeyedTable(str(tmp_path / "t"), ["k"], every=4, keep_max=["peak"]), {}, "k bigint, v bigint, peak bigint"
    peak = {}
    for batch in range(18):
        rows_ = [((batch * 7 + j) % 20, batch * 10 + j, (batch * 13 + j) % 31) for j in range(3)]
        df = spark.createDataFrame(rows_, schema).coalesce(1)
        if batch % 4 == 3:
            table.write(spark.createDataFrame([(99, 0, 99)], schema), batch)  # a first attempt that is replaced
            assert table.read(spark, batch).where("k = 99").isEmpty()
        table.write(df, batch)
        for k, v, p in rows_:
            want[k], peak[k] = v, max(p, peak.get(k, 0))
        snapshot, changes = table.sources(spark, batch + 1)
        assert len(changes) <= 4 and (snapshot is not None) == (batch >= 3)
    assert {r.k: (r.v, r.peak) for r in table.read(spark).collect()} == {k: (v, peak[k]) for k, v in want.items()}
    from flowboard.session import names_in

    assert len(names_in(spark, f"{tmp_path}/t/snapshots")) == 2 and len(names_in(spark, f"{tmp_path}/t/changes")) <= 8


def test_boards_and_retention_touch_only_their_folders(spark, tmp_path):
    """A board of one run leaves the other runs' files alone; old days go as whole folders."""
    import os

    path = str(tmp_path / "board")
    both = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, rank int")
    tables.write_board(both, path)
    times = lambda run: {f: os.stat(f"{path}/run_id={run}/{f}").st_mtime_ns for f in os.listdir(f"{path}/run_id={run}")}
    before = {run: times(run) for run in "ab"}
    tables.write_board(both.where("run_id = 'b'").withColumn("rank", F.col("rank") + 5), path)
    assert times("a") == before["a"] and times("b") != before["b"]
    assert {(r.run_id, r["rank"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 7)}

    samples = str(tmp_path / "samples")
    days = [1, 2, 8, 9]
    tables.append_samples(spark.createDataFrame([(d, f"2024-01-0{d} 12:00:00") for d in days], "v int, t string").withColumn("sample_ts", F.to_timestamp("t")), samples)
    kept = os.stat(f"{samples}/day=2024-01-08").st_mtime_ns
    assert tables.drop_days(spark, samples, 7) == ["day=2024-01-01", "day=2024-01-02"] and tables.drop_days(spark, f"{tmp_path}/none") == []
    assert os.stat(f"{samples}/day=2024-01-08").st_mtime_ns == kept
    assert sorted(r.v for r in spark.read.parquet(samples).collect()) == [8, 9]
