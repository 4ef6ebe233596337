"""Resting orders of a reference book, rebuilt from the reported order events.

Whether an order rests at a point depends only on the events that name it:
submits, accepted acks, cancels, fills it makes and fills it takes. So the
stream becomes a log per order, and lifetimes are prefix scans over that log.
One dependency crosses orders: a fill reduces its taker only if its maker
rested. It is resolved by playing a submission's openings, cancels and made
fills in order, in one task where they are no more than a chunk of rows. Larger
submissions go by rounds that bound what each order has used, from the fills
known to count and from all that may; a round settles every fill where both
agree and goes on with the orders that are left. The dependency points
back in time, so the first open fill is always settled and the rounds end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowboard.functions.timeline import epoch_of
from flowboard.operators.scan import prefix_scan
from flowboard.session import cut, discard

KEYS = ["run_id", "submission_id"]
# The distinct part first: sorts then compare on it and rarely reach the strings.
ORDER = ["oid"] + KEYS
SEGMENT = ORDER + ["seg"]
AT = ["pos"] + KEYS

# Kinds of log rows, in the order they apply at one stream position. PRIOR holds what was known of an order before the events at hand,
# SAID what its maker's side says of the fill that follows; neither stays in a book's log as an event of its own.
SUBMIT, ACK, CANCEL, MAKE, SAID, TAKE = range(6)
PRIOR = -1
# Submit positions of a PRIOR row: an intent that stands, and one whose open quantity a cancel has made forgotten.
_STANDS, _FORGOTTEN, _NEVER_GONE = -1, -3, -2
BUY, SELL = 1, -1


def tick_of(price: Column, tick: float = 0.01) -> Column:
    """Price in whole ticks, rounded half up."""
    size = tick if tick > 0 else 0.01
    return (price / F.lit(size) + F.lit(0.5)).cast("bigint")


@dataclass
class Book:
    """Results of the rebuild; all keyed by (run_id, submission_id)."""

    log: DataFrame  # every order event with resting state before it
    fills: DataFrame  # one row per fill, with maker and taker state before it
    lives: DataFrame  # one row per resting life of an order, (start, end]
    tick: float


def order_log(events: DataFrame, chunk_rows: int) -> DataFrame:
    """Rows per named order; each fill appears under its maker and its taker."""
    kind = lambda name: F.col("type") == name
    kinds = F.when(kind("order_filled"), F.array(F.lit(MAKE), F.lit(TAKE))).when(kind("order_submitted"), F.array(F.lit(SUBMIT)))
    kinds = kinds.when(kind("order_ack") & F.col("accepted"), F.array(F.lit(ACK))).when(kind("order_cancelled"), F.array(F.lit(CANCEL)))
    submit, make, take = (F.col("ev") == k for k in (SUBMIT, MAKE, TAKE))
    maker, taker = F.col("maker_order_id"), F.col("order_id")
    spec = {
        "oid": F.when(make, maker).otherwise(taker),
        "peer": F.when(make, taker).when(take, maker).cast("bigint"),
        "side": F.when(submit, F.when(F.col("side") == "sell", SELL).otherwise(BUY)).cast("int"),
        "limit": F.when(submit, F.col("kind") == "limit"),
        "price": F.when(submit, F.col("price")).when(make, F.col("fill_price")).cast("double"),
        "qty": F.when(submit, F.col("quantity")).when(make | take, F.col("fill_quantity")).cast("bigint"),
        "remaining": F.when(make, F.col("remaining_quantity")).cast("bigint"),
    }
    rows = events.withColumn("ev", F.explode(kinds)).select(*KEYS, "pos", "ev", *[v.alias(c) for c, v in spec.items()])
    return rows.withColumn("chunk", epoch_of(F.col("pos"), chunk_rows))


def _book_qty() -> Column:
    """What a fill takes from the order of its row, where it rests. A fill of an order against itself reduces it twice."""
    own, qty = F.col("oid") == F.col("peer"), F.col("qty")
    return F.when(F.col("ev") == MAKE, F.when(own, qty * 2).otherwise(qty)).when(F.col("ev") == TAKE, F.when(own, F.lit(0)).otherwise(qty)).cast("bigint")


# What is kept of an order between batches: its intent, the quantity taken since, and what rests of it.
STATE = ["side", "limit", "price", "qty", "said", "take_qty", "r_side", "r_price", "r_qty", "r_pos"]


def _with_prior(log: DataFrame, prior: DataFrame | None) -> DataFrame:
    """Rows of kind PRIOR, before all others of their order; they open a segment where the order rests."""
    if prior is None:
        return log
    resting = {"said": "bigint", "take_qty": "bigint", "r_side": "int", "r_price": "double", "r_qty": "bigint", "r_pos": "bigint"}
    log = log.withColumns({c: F.lit(None).cast(t) for c, t in resting.items()})
    at = {"pos": F.lit(-1).cast("bigint"), "ev": F.lit(PRIOR), "chunk": F.lit(0).cast("bigint")}
    held = prior.select(*ORDER, *STATE)
    return log.unionByName(held.select("*", *[v.alias(c) for c, v in at.items()]).select(*[
        F.col(c) if c in (*held.columns, *at) else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns]))


def _scan(df: DataFrame, keys: list[str], specs: dict) -> DataFrame:
    return prefix_scan(df, keys, [F.col("pos"), F.col("ev")], F.col("chunk") if "chunk" in df.columns else None, specs)


# Cells in which rows are counted to find large orders: a table of fixed size.
CELLS = 1 << 16


def _in_chunks(log: DataFrame, chunk_rows: int) -> DataFrame:
    """The log without `chunk` where no order has more than `chunk_rows` rows; else only such orders are cut into chunks."""
    cell = F.pmod(F.xxhash64("oid"), F.lit(CELLS))
    full = log.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk_rows).select("cell")
    full = cut(full)
    if full.isEmpty():
        return log.drop("chunk")
    large = log.withColumn("cell", cell).join(full, "cell", "left_semi").groupBy(*ORDER).agg(F.count(F.lit(1)).alias("n"))
    large = cut(large.where(F.col("n") > chunk_rows).select(*ORDER, F.lit(True).alias("__large")))
    if large.isEmpty():
        return log.drop("chunk")
    return log.join(large, ORDER, "left").withColumn("chunk", F.when(F.col("__large"), F.col("chunk")).otherwise(0)).drop("__large")


def _over(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add an aggregate over all rows of each row's order; ordered like the scans, so that it is got along with them."""
    if "chunk" not in df.columns:
        rows = Window.partitionBy(*ORDER).orderBy("pos", "ev").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumn(name, value.over(rows))
    return df.join(df.groupBy(*ORDER).agg(value.alias(name)), ORDER, "left")


def _with_intent(log: DataFrame) -> DataFrame:
    """Latest submit before each row, taken quantity so far, the ack segment of each row, and how many its order has (`part`, 2 for more).

    A segment starts at every accepted ack of a limit order; segment 0 precedes
    the first one and holds rows of an order that does not rest yet.
    """
    sub, prior = F.col("ev").isin(SUBMIT, PRIOR), F.col("ev") == PRIOR
    of_prior = lambda c: F.when(prior, F.col(c)) if c in log.columns else F.lit(None)
    took = F.coalesce(F.when(F.col("ev") == TAKE, F.col("qty")), of_prior("take_qty"), F.lit(0))
    at_submit = lambda c: F.when(sub, F.col(c))
    df = _scan(log, ORDER, {
        "i_side": ("last", at_submit("side")), "i_limit": ("last", at_submit("limit")),
        "i_price": ("last", at_submit("price")), "i_qty": ("last", at_submit("qty")),
        "i_pos": ("last", F.coalesce(F.when(F.col("ev") == SUBMIT, F.col("pos")), of_prior("said"))), "taken": ("sum", took),
    })
    opens = (F.col("ev") == ACK) & F.coalesce("i_limit", F.lit(False)) | prior & of_prior("r_pos").isNotNull()
    df = df.withColumn("opens", opens).drop("side", "limit", "said")
    df = _scan(df, ORDER, {
        "seg": ("count", F.when(F.col("opens"), 1)), "taken_at_submit": ("last", F.when(sub, F.col("taken") - took)),
    })
    df = _over(df.drop("take_qty"), F.count(F.when(F.col("opens"), 1)), "part")
    return df.withColumn("part", F.least(F.col("part"), F.lit(2)).cast("int"))


def _opening(log: DataFrame) -> DataFrame:
    """Add what an opening row brings into the book, `book_qty` and `take_qty`: they follow from the row, so no table holds them."""
    prior = F.col("ev") == PRIOR
    at = lambda c: F.col("pos" if c == "pos" else f"i_{c}")
    brings = {f"o_{c}": F.when(prior, F.col(f"r_{c}")).otherwise(at(c)) if f"r_{c}" in log.columns else at(c) for c in ("side", "price", "qty", "pos")}
    return log.withColumns(brings | {"book_qty": _book_qty(), "take_qty": F.when(F.col("ev") == TAKE, F.col("qty"))})


def _parts(log: DataFrame) -> list[int]:
    return sorted(r["part"] for r in log.select("part").distinct().collect())


def _told(df: DataFrame, marks: DataFrame) -> DataFrame:
    """Add `said`, what `marks` (ORDER, pos, said) say of the fill at each TAKE row: rows of kind SAID are laid before it, no join is made."""
    if "chunk" in df.columns:
        return df.join(marks, [*ORDER, "pos"], "left")
    said = F.col("ev") == SAID
    rows = marks.select(*ORDER, "pos", F.lit(SAID).alias("ev"), F.col("said").alias("__said"))
    both = _scan(df.unionByName(rows, allowMissingColumns=True), ORDER, {"__mark": ("last", F.when(said, F.struct("pos", "__said")))})
    at = F.col("__mark.pos") == F.col("pos")
    return both.where(~said).withColumn("said", F.when(at, F.col("__mark.__said"))).drop("__mark", "__said")


def _since_opening(df: DataFrame, sums: dict, head: dict, again: bool) -> DataFrame:
    """Add totals since the opening row of the segment and what that row brings; orders are read along, so all scans share one sort."""
    opens = F.col("opens")
    if not again:  # all segments but the first are none
        df = _scan(df, ORDER, {n: ("sum", F.when(F.col("seg") > 0, v)) for n, v in sums.items()} | {
            "__head": ("last", F.when(opens, F.struct(*[F.col(c).alias(n) for n, c in head.items()])))})
        return df.withColumns({n: F.col(f"__head.{n}") for n in head}).drop("__head")
    df = _scan(df, ORDER, {f"__{n}": ("sum", v) for n, v in sums.items()} | {
        "__head": ("last", F.when(opens, F.struct(*[F.col(c).alias(n) for n, c in head.items()])))})
    df = _scan(df, ORDER, {"__base": ("last", F.when(opens, F.struct(*[f"__{n}" for n in sums])))})
    out = {n: F.col(f"__{n}") - F.coalesce(F.col(f"__base.__{n}"), F.lit(0)) for n in sums} | {n: F.col(f"__head.{n}") for n in head}
    return df.withColumns(out).drop("__head", "__base", *[f"__{n}" for n in sums])


def _resting(log: DataFrame, again: bool) -> DataFrame:
    """Add resting state before each row: `rests`, `left` (quantity), and whether the row ends the life.

    `log` carries the validity of each fill. `again` says that its orders are
    acked more than once, so that later segments may continue an earlier life.
    """
    effective = F.when((F.col("ev") == MAKE) | F.col("valid"), F.col("book_qty")).otherwise(0)
    df = log.withColumn("cut_qty", F.coalesce(effective, F.lit(0)))
    df = _since_opening(df, {"used": F.col("cut_qty"), "cancels": (F.col("ev") == CANCEL).cast("bigint")},
                        {"cap": "o_qty", "start": "o_pos", "b_side": "o_side", "b_price": "o_price"}, again)
    df = df.withColumn("b_empty", F.col("cap") == 0).withColumn("carried", F.lit(False))
    if again:
        heads = _carry_over(df.withColumn("unsure", F.lit(False)))
        names = ["cap", "start", "b_side", "b_price", "b_empty", "carried"]
        heads = heads.select(*SEGMENT, *[F.col(c).alias(f"h_{c}") for c in names])
        df = df.join(heads, SEGMENT, "left")
        for c in names:
            df = df.withColumn(c, F.coalesce(F.col(f"h_{c}"), F.col(c))).drop(f"h_{c}")
    cancel = F.col("ev") == CANCEL
    before = F.col("used") - F.col("cut_qty")
    no_cancel = F.col("cancels") - cancel.cast("int") == 0
    rests = (F.col("seg") > 0) & no_cancel & (F.col("b_empty") | (before < F.col("cap")))
    # The opening ack itself rests only when it repeats the ack of a live order.
    rests = F.when(F.col("opens"), F.col("carried")).otherwise(rests)
    df = df.withColumn("rests", F.coalesce(rests, F.lit(False))).withColumn(
        "left", F.when(F.col("b_empty"), 0).otherwise(F.col("cap") - before))
    ends = cancel | (~F.col("b_empty") & (F.col("used") >= F.col("cap")))
    return df.withColumn("ends", F.col("rests") & ~F.col("opens") & ends)


def _carry_over(df: DataFrame) -> DataFrame:
    """Opening state of every segment of orders acked more than once, and whether all that went before it is known (`settled`).

    One pre-aggregated row per segment streams through sorted partitions; only
    the previous segment's state is held.
    """
    summary = df.filter(F.col("seg") > 0).groupBy(*SEGMENT).agg(
        F.max("cap").alias("cap"), F.max("start").alias("start"), F.max("b_side").alias("b_side"),
        F.max("b_price").alias("b_price"), F.sum("cut_qty").alias("total"),
        F.count_if(F.col("ev") == CANCEL).alias("cancelled"), F.count_if(F.col("unsure")).alias("unsure"))
    schema = summary.select(
        *SEGMENT, "cap", "start", "b_side", "b_price", F.lit(True).alias("b_empty"), F.lit(True).alias("carried"), F.lit(True).alias("settled")).schema

    def fold(batches):
        key, state, settled = None, None, True  # state: (cap, start, side, price, empty) of a live order, or None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.oid, r.run_id, r.submission_id) != key:
                    key, state, settled = (r.oid, r.run_id, r.submission_id), None, True
                carried = state is not None
                if not carried:
                    state = (r.cap, r.start, r.b_side, r.b_price, r.cap == 0)
                cap, start, side, price, empty = state
                out.append((*key, r.seg, cap, start, side, price, empty, carried, settled))
                settled = settled and r.unsure == 0
                gone = r.cancelled > 0 or (not empty and r.total >= cap)
                state = None if gone else (cap if empty else cap - r.total, start, side, price, empty)
            yield pd.DataFrame(out, columns=schema.fieldNames())

    ordered = summary.repartition(*ORDER).sortWithinPartitions(*SEGMENT)
    return ordered.mapInPandas(fold, schema)


# What a round reads of the log.
_ROUND = [*SEGMENT, "part", "pos", "ev", "peer", "book_qty", "opens", "o_qty"]


def _bounded(core: DataFrame, again: bool) -> DataFrame:
    """Add `verdict` to the fills an order makes (whether it rests, null where that hangs on fills of which nothing is known yet)
    and `waits`, whether the order has such fills."""
    make, take, cancel = (F.col("ev") == k for k in (MAKE, TAKE, CANCEL))
    qty = F.coalesce("book_qty", F.lit(0))
    sure = F.when(make | (take & F.col("valid")), qty).otherwise(0)
    may = F.when(take & F.col("valid").isNull(), qty).otherwise(0)
    df = core.withColumns({"low": sure + F.least(may, F.lit(0)), "high": sure + F.greatest(may, F.lit(0))})
    df = _since_opening(df, {"used_low": F.col("low"), "used_high": F.col("high"), "cancels": cancel.cast("bigint")}, {"cap": "o_qty"}, again)
    df = df.withColumns({"b_empty": F.col("cap") == 0, "settled": F.lit(True)})
    if again:
        # A later segment goes on from an earlier one, which must be known whole.
        rows = df.withColumns({
            "cut_qty": F.col("low"), "unsure": F.col("low") != F.col("high"), "start": F.lit(0).cast("bigint"), "b_side": F.lit(BUY), "b_price": F.lit(0.0)})
        df = df.join(_carry_over(rows).select(*SEGMENT, *[F.col(c).alias(f"h_{c}") for c in ("cap", "b_empty", "settled")]), SEGMENT, "left")
        for c in ("cap", "b_empty", "settled"):
            df = df.withColumn(c, F.coalesce(F.col(f"h_{c}"), F.col(c))).drop(f"h_{c}")
    rests = lambda c: F.coalesce((F.col("cancels") == 0) & (F.col("b_empty") | (F.col(f"used_{c}") - F.col(c) < F.col("cap"))), F.lit(False))
    verdict = F.when(make & F.col("settled"), F.when(rests("high"), True).when(~rests("low"), False))
    df = df.select(*core.columns, verdict.alias("verdict"))
    return _over(df, F.max((make & F.col("verdict").isNull()).cast("int")), "waits")


# What a submission is played from.
_PLAYED = [*KEYS, "oid", "pos", "ev", "peer", "book_qty", "opens", "o_qty"]


def _played(core: DataFrame) -> DataFrame:
    """Marks of the fills whose maker rests. Each submission is gone through in one task, which holds what rests of its orders."""
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]

    def play(batches):
        key, left = None, {}  # left: of each open order, without end for one that brought nothing, NaN where that is not known
        for batch in batches:
            out = []
            for run, sub, oid, pos, ev, peer, qty, opens, cap in zip(*(c.to_pandas(integer_object_nulls=True).tolist() for c in batch.columns)):
                if (run, sub) != key:
                    key, left = (run, sub), {}
                if opens:
                    # An ack of an order that still rests opens nothing.
                    if oid not in left or left[oid] <= 0:
                        left[oid] = float("nan") if cap is None else cap or float("inf")
                elif ev == CANCEL:
                    left.pop(oid, None)
                elif oid in left:
                    rests = left[oid] > 0
                    left[oid] -= qty or 0
                    if rests and peer is not None:
                        out.append((peer, run, sub, pos, True))
                        if peer != oid and peer in left:
                            left[peer] -= qty or 0
            columns = zip(*out) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*ORDER, "pos", "said"])

    made = core.where(F.col("ev") != TAKE).repartition(*KEYS).sortWithinPartitions(*KEYS, "pos", "ev")
    return made.select(*_PLAYED).mapInArrow(play, "oid bigint, run_id string, submission_id string, pos bigint, said boolean")


def _valid_fills(log: DataFrame, parts: list[int], chunk_rows: int) -> DataFrame:
    """Fills whose maker rests, under their taker: ORDER, pos and said."""
    # Before its first accepted ack an order does not rest, and what it takes there changes no rest of it.
    core = log.where((F.col("part") > 0) & (F.col("seg") > 0) & (F.col("opens") | F.col("ev").isin(CANCEL, MAKE, TAKE)))
    large = cut(core.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk_rows).select(*KEYS))
    whole, none = core, large.isEmpty()
    if not none:
        whole = core.join(large, KEYS, "left_anti")
    valid = cut(_played(whole))
    return valid if none else valid.unionByName(_by_rounds(log.join(large, KEYS, "left_semi"), parts))


def _by_rounds(log: DataFrame, parts: list[int]) -> DataFrame:
    """Valid fills of submissions of any size."""
    make, take = F.col("ev") == MAKE, F.col("ev") == TAKE
    told = lambda df: df.select(F.col("peer").alias("oid"), *KEYS, "pos", F.col("verdict").alias("said")).dropna(subset=ORDER)
    core = log.where((F.col("part") > 0) & (F.col("seg") > 0) & (F.col("opens") | F.col("ev").isin(CANCEL, MAKE, TAKE)))
    core = core.select(*_ROUND, *[c for c in log.columns if c == "chunk"], F.lit(None).cast("boolean").alias("valid"))
    said = told(log.where(make & (F.col("seg") == 0)).withColumn("verdict", F.lit(False)))
    rounds, old = [], None
    # `valid` of a made fill says that its verdict has been told.
    fresh = make & F.col("verdict").isNotNull() & F.col("valid").isNull()
    valid = F.when(take, F.col("valid")).otherwise(F.coalesce("valid", "verdict"))
    while True:
        judged = []
        for part in parts:
            known = _told(core.where(F.col("part") == part), said)
            known = known.withColumn("valid", F.when(take, F.coalesce("valid", "said")).otherwise(F.col("valid"))).drop("said")
            judged.append(_bounded(known, part > 1).where(fresh | (F.col("waits") > 0)))
        seen = cut(reduce(DataFrame.unionByName, judged))
        if old is not None:
            discard(old)
        said, old = cut(told(seen.where(fresh))), seen
        rounds.append(said)
        waits = seen.where("waits > 0")
        parts = _parts(waits)
        if not parts:
            discard(seen)
            break
        core = waits.withColumn("valid", valid).drop("verdict", "waits")
    valid = cut(reduce(DataFrame.unionByName, rounds).where("said"))
    for made in rounds:
        discard(made)
    return valid


def rebuild(events: DataFrame, tick: float = 0.01, chunk_rows: int = 1 << 20, prior: DataFrame | None = None) -> Book:
    """Rebuild the books of all submissions at once; `prior` says what was known of orders before these events."""
    log = _opening(cut(_with_intent(_in_chunks(_with_prior(order_log(events, chunk_rows), prior), chunk_rows)), "part"))
    # Of orders that never open (part 0) nothing rests; their rows stay as they are. Others are gone through again.
    parts = _parts(log.where("part > 0"))
    none = {"cut_qty": "bigint", "start": "bigint", "b_side": "int", "b_price": "double", "b_empty": "boolean", "left": "bigint", "gone_pos": "bigint"}
    never = log.where("part = 0").withColumns({c: F.lit(None).cast(t) for c, t in none.items()} | {c: F.lit(False) for c in ("rests", "ends")})
    whole = never.drop("part", "chunk")
    if parts:
        valid = _valid_fills(log, parts, chunk_rows)
        rested, derived = [], {"o_side", "o_price", "o_qty", "o_pos", "book_qty", "take_qty"}
        for part in parts:
            known = _told(log.where(F.col("part") == part), valid)
            known = known.withColumn("valid", (F.col("ev") == TAKE) & F.coalesce("said", F.lit(False))).drop("said")
            # A cancelled order's open quantity is forgotten until it is submitted again.
            known = _scan(_resting(known, part > 1), ORDER, {"gone_pos": ("max", F.when((F.col("ev") == CANCEL) & F.col("rests"), F.col("pos")))})
            # One part at a time: its shuffle files and its log are gone before the next one's are made.
            rested.append(cut(known.select(*[c for c in whole.columns if c not in derived])))
            discard(log, f"part={part}")
        opened = _opening(reduce(DataFrame.unionByName, rested))
        discard(valid)
        whole = whole.unionByName(opened)
    return Book(log=whole, fills=cut(_fills(whole, tick)), lives=cut(_lives(whole, tick)), tick=tick)


def _lives(log: DataFrame, tick: float) -> DataFrame:
    starts = log.filter(F.col("opens") & ~F.col("rests")).select(
        *ORDER, F.col("o_pos").alias("start"), F.when(F.col("o_side") == SELL, "sell").otherwise("buy").alias("side"),
        F.col("o_price").alias("price"), tick_of(F.col("o_price"), tick).alias("tick"), F.col("o_qty").alias("quantity"))
    ends = log.filter("ends").select(
        *ORDER, "start", F.col("pos").alias("end"),
        F.when(F.col("ev") == CANCEL, "cancelled").otherwise("filled").alias("outcome"))
    return starts.join(ends, ORDER + ["start"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("resting")))


def _fills(log: DataFrame, tick: float) -> DataFrame:
    maker = log.filter(F.col("ev") == MAKE).select(
        *KEYS, "pos", F.col("oid").alias("maker_order_id"), F.col("peer").alias("order_id"), F.col("price").alias("fill_price"),
        F.col("qty").alias("fill_quantity"), F.col("remaining").alias("reported_remaining"),
        F.col("rests").alias("maker_rests"), F.when(F.col("rests"), F.col("left")).alias("maker_left"),
        F.when(F.col("rests"), F.col("start")).alias("maker_start"), F.when(F.col("rests"), F.col("b_side")).alias("maker_side"),
        F.when(F.col("rests"), F.col("b_price")).alias("maker_price"),
        F.when(F.col("rests"), tick_of(F.col("b_price"), tick)).alias("maker_tick"))
    open_qty = F.greatest(F.lit(0), F.col("i_qty") - (F.col("taken") - F.col("take_qty") - F.col("taken_at_submit")))
    known = F.col("i_pos").isNotNull() & (F.coalesce("gone_pos", F.lit(_NEVER_GONE)) < F.col("i_pos"))
    taker = log.filter(F.col("ev") == TAKE).select(
        *KEYS, "pos", F.col("i_side").alias("taker_side"), F.col("i_limit").alias("taker_limit"),
        F.col("i_price").alias("taker_price"), F.when(known, open_qty).alias("taker_left"))
    return maker.join(taker, AT)


def states(book: Book) -> DataFrame:
    """What later events need to know of every order that the events named: ORDER and STATE, one row each."""
    opens = F.col("opens")
    stays = opens | (F.col("rests") & ~F.col("ends"))
    left = F.when(opens & ~F.col("rests"), F.col("o_qty")).when(F.col("b_empty"), 0).otherwise(F.col("left") - F.col("cut_qty"))
    after = {
        "side": F.col("i_side"), "limit": F.col("i_limit"), "price": F.col("i_price"), "qty": F.col("i_qty"), "said": F.col("i_pos"),
        "take_qty": F.when(F.col("i_pos").isNotNull(), F.col("taken") - F.col("taken_at_submit")),
        "r_side": F.when(stays, F.col("b_side")), "r_price": F.when(stays, F.col("b_price")),
        "r_qty": F.when(stays, left), "r_pos": F.when(stays, F.col("start"))}
    last = book.log.groupBy(*ORDER).agg(
        F.max_by(F.struct(*[v.alias(c) for c, v in after.items()]), F.struct("pos", "ev")).alias("s"),
        F.max(F.when((F.col("ev") == CANCEL) & F.col("rests"), F.col("pos"))).alias("gone"),
        F.coalesce(F.bool_or(opens), F.lit(False)).alias("opened"))
    said = F.col("s.said")
    forgotten = (said == _FORGOTTEN) | (F.coalesce("gone", F.lit(_NEVER_GONE)) > said)
    return last.select(*ORDER, "opened", *[
        F.when(said.isNull(), F.lit(None).cast("bigint")).when(forgotten, _FORGOTTEN).otherwise(_STANDS).cast("bigint").alias(c) if c == "said"
        else F.col(f"s.{c}").alias(c) for c in STATE])


def resting_lives(kept: DataFrame, tick: float = 0.01) -> DataFrame:
    """Kept states of resting orders as lives without an end."""
    return kept.select(
        *ORDER, F.col("r_pos").alias("start"), F.when(F.col("r_side") == SELL, "sell").otherwise("buy").alias("side"),
        F.col("r_price").alias("price"), tick_of(F.col("r_price"), tick).alias("tick"), F.col("r_qty").alias("quantity"),
        F.lit("resting").alias("outcome"))


def depth(book: Book, at: int | None = None) -> DataFrame:
    """Open quantity per price level after stream position `at` (the end when None)."""
    until = F.lit(at if at is not None else (1 << 62))
    live = book.lives.filter((F.col("start") <= until) & (F.coalesce("end", F.lit((1 << 62) + 1)) > until))
    spent = book.log.filter(F.col("rests") & ~F.col("opens") & (F.col("pos") <= until)).groupBy(*ORDER, "start").agg(
        F.sum("cut_qty").alias("spent"))
    return (
        live.filter(F.col("quantity") > 0).join(spent, ORDER + ["start"], "left")
        .groupBy(*KEYS, "side", "tick")
        .agg(F.count(F.lit(1)).alias("orders"),
             F.sum(F.col("quantity") - F.coalesce("spent", F.lit(0))).alias("open_quantity"))
    )


def depth_at(book: Book, positions: DataFrame, chunk_rows: int = 1 << 20) -> DataFrame:
    """Orders and open quantity per price level after each of many stream positions: KEYS, at, side, tick, orders, open_quantity.

    `positions` lists (KEYS, at). A sweep: every change of a level belongs to the first position at or behind it; changes are added up per level
    and position, summed along the positions, and a level's row is repeated until its next change. No life meets a
    position by a range join, and levels without orders have no row.
    """
    marks = positions.select(*KEYS, F.col("at").cast("bigint").alias("at")).distinct()
    log = book.log.where(~F.col("b_empty"))
    comes, stays = F.col("opens") & ~F.col("rests"), F.col("rests") & ~F.col("opens")
    side = lambda c: F.when(F.col(c) == SELL, "sell").otherwise("buy")
    change = F.when(comes, F.struct(side("o_side").alias("side"), tick_of(F.col("o_price"), book.tick).alias("tick"), F.lit(1).alias("orders"), F.col("o_qty").alias("qty")))
    # The last event of a life takes away all that is left of it.
    change = change.when(stays, F.struct(side("b_side").alias("side"), tick_of(F.col("b_price"), book.tick).alias("tick"), (-F.col("ends").cast("int")).alias("orders"),
                                         F.when(F.col("ends"), -F.col("left")).otherwise(-F.col("cut_qty")).alias("qty")))
    changes = log.where(comes | stays).select(*KEYS, F.col("pos").alias("at"), change.alias("c"))
    number = prefix_scan(marks, KEYS, [F.col("at")], epoch_of(F.col("at"), chunk_rows), {"i": ("count", F.lit(1))})
    both = changes.withColumn("i", F.lit(None).cast("bigint")).unionByName(number.withColumn("c", F.lit(None).cast(changes.schema["c"].dataType)))
    # Backwards, a position before the changes at it.
    dealt = prefix_scan(both, KEYS, [F.col("at") * -2 + F.col("c").isNotNull().cast("int")], -epoch_of(F.col("at"), chunk_rows), {"to": ("last", F.col("i"))})
    level = [*KEYS, "side", "tick"]
    added = dealt.where("c is not null and to is not null").select(*KEYS, "c.*", "to").groupBy(*level, "to").agg(
        F.sum("orders").alias("orders"), F.sum("qty").alias("qty"))
    along = Window.partitionBy(*level).orderBy("to")  # one row a position at most
    sums = {"orders": F.sum("orders").over(along), "open_quantity": F.sum("qty").over(along), "next": F.lead("to").over(along)}
    upto = added.select(*level, "to", *[v.alias(c) for c, v in sums.items()])
    count = number.groupBy(*KEYS).agg(F.max("i").alias("last"))
    rows = upto.where("orders > 0").join(count, KEYS).withColumn("i", F.explode(F.sequence(F.col("to"), F.coalesce(F.col("next") - 1, F.col("last")))))
    return rows.join(number, [*KEYS, "i"]).select(*KEYS, "at", "side", "tick", "orders", "open_quantity")


def top_of_book(levels: DataFrame) -> DataFrame:
    """Best bid and ask with their open quantity, and whether they cross."""
    bid, ask = F.col("side") == "buy", F.col("side") == "sell"
    out = levels.groupBy(*KEYS).agg(
        F.max(F.when(bid, F.col("tick"))).alias("best_bid"),
        F.max_by("open_quantity", F.when(bid, F.col("tick"))).alias("bid_quantity"),
        F.min(F.when(ask, F.col("tick"))).alias("best_ask"),
        F.min_by("open_quantity", F.when(ask, F.col("tick"))).alias("ask_quantity"))
    return out.withColumn("crossed", F.coalesce(F.col("best_bid") >= F.col("best_ask"), F.lit(False)))
