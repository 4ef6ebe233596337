"""Set-based book and rules against a model that derives every state anew."""

import pytest
from book_cases import Stream, literal_cases, random_stream
from book_model import Model

from flowboard import schemas, session
from flowboard.operators import intervals, orderbook, rules


def build(spark, streams, chunk_rows=1 << 20):
    rows = [tuple(e.values()) for s in streams for e in s]
    df = spark.createDataFrame(rows, schemas.ORDER_EVENT)
    return orderbook.rebuild(df, chunk_rows=chunk_rows)


def compare(spark, streams, chunk_rows):
    book = build(spark, list(streams.values()), chunk_rows)
    found = rules.findings(book)
    got = {}
    for f in found.collect():
        got.setdefault(f.submission_id, []).append((f.pos, f.check, f.rule, f.message, f.order_id))
    verdicts = {v.submission_id: v for v in rules.verdicts(book, found).collect()}
    for sub, rows in streams.items():
        want = Model(rows)
        mine = [(rule, text, oid, pos) for pos, _, rule, text, oid in sorted(got.get(sub, []))]
        assert mine == want.findings, sub
        v = verdicts[sub]
        assert (v.orders_checked, v.trades_checked, v.violations) == (want.orders, want.trades, len(want.findings))
        assert v.violations_by_rule == want.by_rule
        assert v.correctness_score == pytest.approx(want.score)
        last = [tuple(x) for x in (v.recent_findings or [])]
        assert last == want.findings[-25:]
    return book


def test_literal_cases(spark):
    cases = literal_cases()
    compare(spark, {k: rows for k, (rows, _) in cases.items()}, 1 << 20)
    for k, (rows, want) in cases.items():
        assert Model(rows).by_rule == want, k


def test_random_regular_streams(spark):
    compare(spark, {f"s{i}": random_stream(f"s{i}", i) for i in range(12)}, 1 << 20)


def test_random_irregular_streams_in_small_chunks(spark):
    book = compare(spark, {f"s{i}": random_stream(f"s{i}", 100 + i, irregular=True) for i in range(12)}, 64)
    levels = orderbook.depth(book).collect()
    for sub in {r.submission_id for r in levels}:
        want = {}
        for side, price, left, _ in Model(random_stream(sub, 100 + int(sub[1:]), irregular=True)).book(10**9).values():
            tick = Model.tick(price)
            if left > 0:
                n, q = want.get((side, tick), (0, 0))
                want[(side, tick)] = (n + 1, q + left)
        assert {(r.side, r.tick): (r.orders, r.open_quantity) for r in levels if r.submission_id == sub} == want


def test_depth_at_many_positions(spark):
    """Each position's levels against the model's book there, with reused ids and orders without quantity."""
    streams = {f"s{i}": random_stream(f"s{i}", 200 + i, n=120, irregular=True) for i in range(4)}
    book = build(spark, list(streams.values()), 64)
    marks = [("run", sub, at) for sub, rows in streams.items() for at in sorted({-5, 10**6, *[r["pos"] + d for r in rows[::9] for d in (0, 1)]})]
    run = next(iter(streams.values()))[0]["run_id"]
    asked = spark.createDataFrame([(run, s, a) for _, s, a in marks], "run_id string, submission_id string, at bigint")
    got = {}
    for r in orderbook.depth_at(book, asked.union(asked), 64).collect():
        got[r.submission_id, r["at"], r.side, r.tick] = (r.orders, r.open_quantity)
    want = {}
    for sub, rows in streams.items():
        model = Model(rows)
        for _, s, at in marks:
            if s == sub:
                for side, price, left, _ in model.book(at + 1).values():
                    if left > 0:
                        n, q = want.get((sub, at, side, Model.tick(price)), (0, 0))
                        want[sub, at, side, Model.tick(price)] = (n + 1, q + left)
    assert got == want and len({k[1] for k in got}) > 20


def test_one_hot_submission(spark):
    streams = {"hot": random_stream("hot", 7, n=4000), "cold": random_stream("cold", 8, n=60)}
    compare(spark, streams, 256)


def test_best_prices_are_looked_up_where_the_book_changes(spark, monkeypatch):
    """Two resting orders and many fills of them: as many look-ups as changes of the levels, not as fills."""
    s = Stream("many")
    s.rest(1, "buy", 100, 1000)
    s.rest(2, "buy", 101, 1000)
    for i in range(200):
        s.submit(10 + i, "sell", 0, 1, "market")
        s.fill(10 + i, 1 + i % 2, 100 + i % 2, 1, 0)
    asked, stab = [], rules.stab

    def counted(intervals, points, *args):
        asked.append(points.count())
        return stab(intervals, points, *args)

    monkeypatch.setattr(rules, "stab", counted)
    compare(spark, {"many": s.rows}, 1 << 20)
    assert 0 < sum(asked) <= 8


def test_order_with_more_rows_than_a_chunk(spark):
    """It is cut into chunks, others are scanned whole; reused ids and fills of fills on either side."""
    s = Stream("big")
    s.rest(1, "buy", 100, 60)
    for i in range(80):
        s.rest(10 + i, "sell", 100, 2)
        s.fill(10 + i, 1 if i % 3 else 9 + i, 100, 1, 1)
        if i % 20 == 19:
            s.rest(1, "buy", 100, 10)
    streams = {"big": s.rows, "other": random_stream("other", 31, n=80, irregular=True)}
    events = spark.createDataFrame([tuple(e.values()) for rows in streams.values() for e in rows], schemas.ORDER_EVENT)
    cut_up = orderbook._in_chunks(orderbook.order_log(events, 16), 16)
    assert "chunk" in cut_up.columns and cut_up.where("oid = 1 and submission_id = 'big'").select("chunk").distinct().count() > 3
    assert "chunk" not in orderbook._in_chunks(orderbook.order_log(events, 1 << 20), 1 << 20).columns
    compare(spark, streams, 16)


def test_rows_of_orders_that_never_rest_are_kept_once(spark, monkeypatch):
    """Only orders that open are gone through again; the log's other rows are neither shuffled nor written a second time."""
    s = Stream("few")
    for i in range(100):
        s.submit(1000 + i, "buy", 100, 5)
    s.rest(1, "buy", 100, 10)
    s.rest(2, "sell", 101, 10)
    s.fill(2, 1, 100, 3, 7)
    made, cut = [], orderbook.cut

    def counted(df, *by):
        out = cut(df, *by)
        made.append(out.count())
        return out

    monkeypatch.setattr(orderbook, "cut", counted)
    book = compare(spark, {"few": s.rows}, 1 << 20)
    assert book.log.count() == max(made) >= 106
    assert sorted(made)[-2] <= 10


def test_fills_of_fills_take_no_rounds(spark, monkeypatch):
    """Each fill counts for its taker only if the one before it did; the tables written do not grow with such a chain."""
    s = Stream("chain")
    s.rest(1, "buy", 100, 5)
    for i in range(2, 30):
        s.rest(i, "sell" if i % 2 == 0 else "buy", 100, 5)
        s.fill(i, i - 1, 100, 3 if i % 5 else 5, 2)
    made, cut = [], orderbook.cut

    def counted(df, *by):
        made.append(by)
        return cut(df, *by)

    monkeypatch.setattr(orderbook, "cut", counted)
    compare(spark, {"chain": s.rows}, 1 << 20)
    assert len(made) <= 7


def test_submissions_played_and_by_rounds_agree(spark):
    """One submission is larger than a chunk, others are not; ids beyond 2^53, makers and quantities that are not known, negative fills."""
    streams = {"big": random_stream("big", 41, n=300, irregular=True)}
    streams |= {f"s{i}": random_stream(f"s{i}", 50 + i, n=60, irregular=True) for i in range(6)}
    for rows in streams.values():
        for n, e in enumerate(rows):
            e["order_id"] += 1 << 60
            if e["maker_order_id"] is not None:
                e["maker_order_id"] = None if n % 37 == 0 else e["maker_order_id"] + (1 << 60)
            if n % 41 == 0 and e["quantity"] is not None:
                e["quantity"] = None
            if n % 29 == 0 and e["fill_quantity"] is not None:
                e["fill_quantity"] = -e["fill_quantity"]
    state = lambda b: sorted(tuple(map(str, r)) for part in (b.fills, b.lives.drop("price")) for r in part.collect())
    played = state(build(spark, list(streams.values())))
    assert played == state(build(spark, list(streams.values()), 100)) == state(build(spark, list(streams.values()), 16))
    assert len(played) > 200


def test_a_cut_leaves_no_shuffle_files(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    rows = spark.range(1000).repartition(4, "id")
    before = files()
    assert orderbook.cut(rows).count() == 1000 and rows.count() == 1000
    held = files()
    orderbook.cut(rows.repartition(3, "id"))
    assert files() <= held and before <= held


def test_only_fills_of_resting_makers_meet_what_is_looked_up(spark, monkeypatch):
    s = Stream("few")
    s.rest(1, "buy", 100, 10)
    for i in range(100):
        s.submit(10 + i, "sell", 0, 1, "market")
        s.fill(10 + i, 1 if i == 50 else 5000 + i, 100, 1, 0)
    book, met = build(spark, [s.rows]), []
    join = type(book.fills).join

    def counted(self, other, on=None, how=None):
        if how == "left" and isinstance(on, list) and all(isinstance(c, str) for c in on) and on[0] == "pos":
            met.append(self.count())
        return join(self, other, on, how)

    monkeypatch.setattr(type(book.fills), "join", counted)
    checked = rules.checked_fills(book)
    assert met == [1]
    assert checked.count() == 100 and checked.where("front_id = 1").count() == 1
    assert checked.where("crossed_after is null").count() == 0


def test_prices_are_looked_up_in_small_plans(spark, monkeypatch):
    """What the driver plans and compiles at once stays small: no table's plan holds the way to another one twice."""
    book, sizes = build(spark, [random_stream("s", 3, n=60)]), []

    def counted(cut):
        def run(df, *by):
            sizes.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
            return cut(df, *by)
        return run

    for module in (rules, intervals):
        monkeypatch.setattr(module, "cut", counted(session.cut), raising=False)
    assert rules.checked_fills(book).count() == book.fills.count()
    assert max(sizes) <= 10


def test_fills_checked_whole_and_in_chunks_agree(spark):
    streams = {f"s{i}": random_stream(f"s{i}", 70 + i, n=200, irregular=True) for i in range(4)}
    book = build(spark, list(streams.values()))
    state = lambda df: sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())
    assert state(rules.checked_fills(book)) == state(rules.checked_fills(book, 32)) != []


def test_parts_of_the_log_are_written_and_deleted_one_at_a_time(spark, monkeypatch):
    """Orders acked once and those acked more often are no one plan, and what the first leaves behind is gone before the second."""
    made, cut, discard = [], orderbook.cut, orderbook.discard
    monkeypatch.setattr(orderbook, "cut", lambda df, *by: made.append("cut") or cut(df, *by))
    monkeypatch.setattr(orderbook, "discard", lambda df, part="": made.append(part) or discard(df, part))
    book = build(spark, [random_stream("s", 5, n=80, irregular=True)])
    first, second = made.index("part=1"), made.index("part=2")
    assert "cut" in made[first:second] and book.log.count() > 80
