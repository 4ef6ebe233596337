"""Price-time-priority rules over rebuilt books, findings and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowboard import schemas
from flowboard.functions.timeline import epoch_of
from flowboard.operators.intervals import stab
from flowboard.operators.orderbook import ACK, BUY, CANCEL, SELL, Book
from flowboard.operators.scan import prefix_scan
from flowboard.session import cut, discard

KEYS = ["run_id", "submission_id"]
_END = (1 << 61) - 1


def _live(book: Book) -> DataFrame:
    """Lives that hold quantity, as position intervals [lo, hi] in which they are on the book.

    A life without an end reaches the last position of the whole input, not an
    arbitrary large one, which keeps its block cover short; one from before the events counts from their first position.
    """
    last = book.log.groupBy(*KEYS).agg((F.max("pos") + 1).alias("last"), F.min(F.when(F.col("pos") >= 0, F.col("pos"))).alias("first"))
    return book.lives.filter(F.col("quantity") > 0).join(last, KEYS).select(
        *KEYS, "oid", F.when(F.col("side") == "sell", SELL).otherwise(BUY).alias("side"), "tick", "start",
        F.greatest(F.col("start") + 1, F.col("first")).alias("lo"), F.coalesce("end", "last").alias("hi"))


def _all_small(book: Book, chunk_rows: int) -> bool:
    """Whether no submission has more lives and fills than a chunk has rows."""
    rows = book.lives.select(*KEYS).unionByName(book.fills.select(*KEYS)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("n") > chunk_rows).isEmpty()


def _fronts(live: DataFrame, chunk: Column | None) -> DataFrame:
    """Of each life the positions [lo, hi] at which it is the earliest of its level, where there are any, and the number of the
    unbroken stretch of the level (`stretch`) they lie in. One level's fronts never overlap."""
    level = KEYS + ["side", "tick"]
    ahead = prefix_scan(live.where("lo <= hi"), level, [F.col("start")], chunk, {"until": ("max", F.col("hi"))}, inclusive=False)
    front = ahead.where("until is null or hi > until").withColumn("fresh", F.coalesce(F.col("lo") > F.col("until") + 1, F.lit(True)))
    front = prefix_scan(front, level, [F.col("start")], chunk, {"stretch": ("count", F.when(F.col("fresh"), 1))})
    return front.select(*level, "oid", "start", F.greatest("lo", F.col("until") + 1).alias("lo"), "hi", "stretch")


def _best_steps(fronts: DataFrame) -> DataFrame:
    """Best price of each side as a step function: (KEYS, side, at, best) wherever a level fills or empties; null where the side does."""
    spans = cut(fronts.groupBy(*KEYS, "side", "tick", "stretch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    spans = spans.withColumn("signed", F.col("tick") * F.col("side"))
    starts, ends = spans.select(*KEYS, "side", F.col("lo").alias("at")), spans.select(*KEYS, "side", (F.col("hi") + 1).alias("at"))
    best = stab(spans, starts.unionByName(ends), KEYS + ["side"], "lo", "hi", "at", {"best": F.max("signed")}, {"best": F.max("best")})
    steps = best.unionByName(ends.withColumn("best", F.lit(None).cast("bigint"))).groupBy(*KEYS, "side", "at").agg(F.max("best").alias("best"))
    return steps.withColumn("best", F.col("best") * F.col("side"))


def checked_fills(book: Book, chunk_rows: int = 1 << 20) -> DataFrame:
    """Fills with the best price on the maker's side and the front of its level before them,
    and whether the book is crossed after them.

    Fronts and best prices change at few positions; they are laid out once and carried forward to the fills by scans.
    Each of these tables is written, so that plans stay small; submissions are cut into chunks only where one is larger than that.
    """
    small = _all_small(book, chunk_rows)
    chunk = lambda c: None if small else epoch_of(F.col(c), chunk_rows)
    fronts = cut(_fronts(_live(book), chunk("start")))
    fills = book.fills
    exhausted = F.coalesce(F.greatest(F.col("taker_left") - F.col("fill_quantity"), F.lit(0)), F.lit(0)) == 0
    rests = fills.filter("maker_rests").select(
        *KEYS, "pos", F.col("maker_side").alias("side"), F.col("maker_tick").alias("tick"), exhausted.alias("exhausted"))

    def carried(changes, points, keys, specs):
        """Points (`pos` not null) with the last change at or before them."""
        both = changes.unionByName(points, allowMissingColumns=True)
        order = F.col("at") * 2 + F.col("pos").isNotNull().cast("int")
        return prefix_scan(both, keys, [order], chunk("at"), specs).where("pos is not null")

    level = KEYS + ["side", "tick"]
    front = carried(
        fronts.select(*level, F.col("lo").alias("at"), F.struct("start", "oid", "hi").alias("f")),
        rests.select(*level, F.col("pos").alias("at"), "pos"), level, {"front": ("last", F.col("f"))})
    front = front.where("front.hi >= at").select(
        *KEYS, "pos", F.col("front.start").alias("front_start"), F.col("front.oid").alias("front_id"))

    # Before the fill, and where its taker has traded all it had, after it.
    times = F.when(F.col("exhausted"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    asked = rests.select(*KEYS, "pos", F.col("side").alias("maker_side"), F.explode(times).alias("after"))
    laid = _best_steps(fronts).select(*KEYS, "at", *[
        F.when(F.col("side") == s, F.struct("best")).alias(n) for n, s in (("b", BUY), ("s", SELL))])
    # Both sides may change at one position.
    steps = cut(laid.groupBy(*KEYS, "at").agg(F.max("b").alias("b"), F.max("s").alias("s")))
    discard(laid)
    best = carried(steps, asked.withColumn("at", F.col("pos") + F.col("after")), KEYS, {"bid": ("last", F.col("b")), "ask": ("last", F.col("s"))})
    bid, ask, after = F.col("bid.best"), F.col("ask.best"), F.col("after") == 1
    best = best.select(
        *KEYS, "pos", F.when(~after, F.when(F.col("maker_side") == BUY, bid).otherwise(ask)).alias("best_tick"),
        F.when(after, bid >= ask).alias("crossed_after"))

    # Every lookup is keyed by the fill's own position: one row per fill at most.
    looked = cut(front.unionByName(best, allowMissingColumns=True).groupBy("pos", *KEYS).agg(
        *[F.max(c).alias(c) for c in ("best_tick", "front_start", "front_id", "crossed_after")]))
    discard(fronts)
    discard(steps)
    # Nothing is looked up for fills whose maker does not rest; they stay where they are.
    out = fills.where("maker_rests").join(looked, ["pos"] + KEYS, "left").unionByName(fills.where("not maker_rests"), allowMissingColumns=True)
    return out.withColumn("crossed_after", F.coalesce("crossed_after", F.lit(False)))


def _say(pattern: str, *cols: Column) -> Column:
    return F.format_string(pattern, *cols)


def fill_findings(checked: DataFrame, tick: float) -> DataFrame:
    """One row per broken rule of each fill, numbered in checking order."""
    half = F.lit(tick / 2)
    c = F.col
    side = lambda s: F.when(s == SELL, "sell").otherwise("buy")
    limit = F.coalesce(c("taker_limit"), F.lit(False))
    expected = c("taker_left") - c("fill_quantity")
    rests = c("maker_rests")
    checks = [
        (schemas.RULE_BOOK, ~rests, _say("fill names maker %d that is not resting in the book", c("maker_order_id"))),
        (schemas.RULE_TRADE, rests & (c("taker_side") == c("maker_side")),
         _say("aggressor and maker %d are both %s", c("maker_order_id"), side(c("maker_side")))),
        (schemas.RULE_TRADE, rests & (F.abs(c("fill_price") - c("maker_price")) > half),
         _say("fill price %.4f != resting maker price %.4f", c("fill_price"), c("maker_price"))),
        (schemas.RULE_TRADE, rests & limit & (c("taker_side") == BUY) & (c("fill_price") > c("taker_price") + half),
         _say("buy filled at %.4f above its limit %.4f", c("fill_price"), c("taker_price"))),
        (schemas.RULE_TRADE, rests & limit & (c("taker_side") == SELL) & (c("fill_price") < c("taker_price") - half),
         _say("sell filled at %.4f below its limit %.4f", c("fill_price"), c("taker_price"))),
        (schemas.RULE_PRICE, rests & (c("best_tick") != c("maker_tick")),
         _say("filled maker at tick %d while a better price (tick %d) was resting", c("maker_tick"), c("best_tick"))),
        (schemas.RULE_FIFO, rests & (c("front_id") != c("maker_order_id")),
         _say("filled maker %d ahead of earlier order %d at the same price", c("maker_order_id"), c("front_id"))),
        (schemas.RULE_QUANTITY, rests & (c("fill_quantity") <= 0), F.lit("fill quantity must be positive")),
        (schemas.RULE_QUANTITY, rests & (c("fill_quantity") > 0) & (c("fill_quantity") > c("maker_left")),
         _say("fill qty %d exceeds maker remaining %d", c("fill_quantity"), c("maker_left"))),
        (schemas.RULE_QUANTITY, rests & (c("fill_quantity") > c("taker_left")),
         _say("fill qty %d exceeds aggressor remaining %d", c("fill_quantity"), c("taker_left"))),
        (schemas.RULE_QUANTITY, rests & (expected >= 0) & (c("reported_remaining") != expected),
         _say("reported remaining %d != expected %d", c("reported_remaining"), expected)),
        (schemas.RULE_BOOK, c("crossed_after"), F.lit("book left crossed after aggressor fully traded")),
    ]
    rows = F.array(*[
        F.when(cond, F.struct(F.lit(i).alias("check"), F.lit(rule).alias("rule"), text.alias("message")))
        for i, (rule, cond, text) in enumerate(checks)])
    return checked.select(*KEYS, "pos", "order_id", F.inline(F.filter(rows, lambda r: r.isNotNull())))


def order_findings(book: Book) -> DataFrame:
    """Acks of an order that already rests and cancels of one that does not."""
    twice = book.log.filter(F.col("opens") & F.col("rests") & (F.col("ev") == ACK))
    absent = book.log.filter((F.col("ev") == CANCEL) & ~F.col("rests"))
    shape = lambda df, text: df.select(
        *KEYS, "pos", F.col("oid").alias("order_id"), F.lit(0).alias("check"),
        F.lit(schemas.RULE_BOOK).alias("rule"), F.lit(text).alias("message"))
    return shape(twice, "engine accepted the same order_id twice").unionByName(
        shape(absent, "cancel for an order not resting in the book"))


def findings(book: Book, checked: DataFrame | None = None) -> DataFrame:
    checked = checked_fills(book) if checked is None else checked
    return fill_findings(checked, book.tick).unionByName(order_findings(book))


def violations_by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy(*KEYS, "rule").agg(F.count(F.lit(1)).alias("violations"))


def recent(found: DataFrame, count: int = 25) -> DataFrame:
    """Last findings per submission; the limit is applied per task before the shuffle."""
    w = Window.partitionBy(*KEYS).orderBy(F.col("pos").desc(), F.col("check").desc())
    return found.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= count).drop("__rn")


def verdicts(book: Book, found: DataFrame, count: int = 25) -> DataFrame:
    """Verdict per submission: totals, violations per rule, score, last findings in order.

    Every submission with an order event has one. Rules and findings are maps
    and arrays of bounded size.
    """
    totals = book.log.select(*KEYS, "ev", "rests").groupBy(*KEYS).agg(
        F.count_if(F.col("ev") == 3).alias("orders_checked"),
        F.count_if((F.col("ev") == 3) & F.col("rests")).alias("trades_checked"))
    rules = violations_by_rule(found).groupBy(*KEYS).agg(
        F.sum("violations").alias("violations"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "violations")))).alias("violations_by_rule"))
    last = recent(found, count).groupBy(*KEYS).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "check", "rule", "message", "order_id"))),
            lambda f: F.struct(f["rule"].alias("rule"), f["message"].alias("message"),
                               f["order_id"].alias("order_id"), f["pos"].alias("pos"))).alias("recent_findings"))
    out = totals.join(rules, KEYS, "left").join(last, KEYS, "left")
    n = F.coalesce("violations", F.lit(0))
    return out.select(
        *KEYS, "orders_checked", "trades_checked", n.alias("violations"),
        F.coalesce("violations_by_rule", F.create_map().cast("map<string,bigint>")).alias("violations_by_rule"),
        _share(n, F.col("orders_checked")).alias("correctness_score"), "recent_findings")


def added_verdicts(old: DataFrame, new: DataFrame, count: int = 25) -> DataFrame:
    """Verdicts of two stretches of a stream, the later one second, as one of both."""
    names = ["orders_checked", "trades_checked", "violations", "violations_by_rule", "recent_findings"]
    held = old.join(new.select(*KEYS), KEYS, "left_semi").select(*KEYS, *[F.col(c).alias(f"__{c}") for c in names])
    both = new.join(held, KEYS, "left")
    total = {c: F.col(c) + F.coalesce(f"__{c}", F.lit(0)) for c in names[:3]}
    no_rules, none = F.create_map().cast("map<string,bigint>"), F.array().cast(new.schema["recent_findings"].dataType)
    total["violations_by_rule"] = F.map_zip_with(
        F.coalesce("__violations_by_rule", no_rules), F.coalesce("violations_by_rule", no_rules), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    last = F.concat(F.coalesce("__recent_findings", none), F.coalesce("recent_findings", none))
    total["recent_findings"] = F.slice(last, F.greatest(F.size(last) - count + 1, F.lit(1)), count)
    out = both.select(*KEYS, *[v.alias(c) for c, v in total.items()])
    return out.withColumn("violations_by_rule", F.map_from_entries(F.array_sort(F.map_entries("violations_by_rule")))).withColumn(
        "correctness_score", _share(F.col("violations"), F.col("orders_checked"))).select(*new.columns)


def _share(violations: Column, orders: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - violations / F.greatest(orders, F.lit(1))))


def verdict_json(verdict: DataFrame) -> DataFrame:
    """Map and array columns as JSON text, the stored form."""
    return verdict.withColumn("violations_by_rule", F.to_json("violations_by_rule")).withColumn(
        "recent_findings", F.coalesce(F.to_json("recent_findings"), F.lit("[]")))


def verdict_from_json(stored: DataFrame) -> DataFrame:
    finding = "array<struct<rule:string,message:string,order_id:bigint,pos:bigint>>"
    return stored.withColumn("violations_by_rule", F.from_json("violations_by_rule", "map<string,bigint>")).withColumn(
        "recent_findings", F.from_json("recent_findings", finding))
