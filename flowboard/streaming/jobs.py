"""Structured Streaming jobs: the batch operators behind readStream and foreachBatch.

Checkpoints make delivery at-least-once; every sink is keyed by batch id and
replaces its own batch on a retry, so results are those of exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowboard.functions.scoring import ScoreConfig
from flowboard.functions.timeline import SECOND, instant
from flowboard.operators import board, orderbook, rules, tables, windows
from flowboard.session import cut, discard, names_in
from flowboard.sources import envelopes

KEYS = windows.KEYS


def kafka_source(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Topic values from the earliest offset; progress is kept in the query's checkpoint."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribe", topic).option("startingOffsets", "earliest").options(**options)
    return reader.load().select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("body"),
        F.col("timestamp").alias("received_at"), F.col("offset").alias("pos"))


def file_source(spark: SparkSession, path: str, schema, fmt: str = "json", **options: str) -> DataFrame:
    """Files in a folder as a stream, oldest first."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def start(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
          once: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Run `each` per micro-batch: all data at hand (`once`), or on an interval."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def ingest(bodies: DataFrame, out: str, checkpoint: str, **run) -> StreamingQuery:
    """Decode, check and route request bodies into one folder per topic; undecodable bodies join the dead letters."""

    def each(batch: DataFrame, batch_id: int) -> None:
        good, bad = envelopes.decode_bodies(batch)
        tables.write_routed(envelopes.route(good), f"{out}/routed", batch_id)
        tables.write_changes(bad, f"{out}/rejected", batch_id)

    return start(bodies, each, checkpoint, **run)


def dedupe(events: DataFrame, keys: list[str], out: str, checkpoint: str, **run) -> StreamingQuery:
    """First delivery of each event, however late it comes; ids are never forgotten.

    Each micro-batch keeps the events whose ids are not in the table yet. Only the id columns of
    the table are read.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        fresh, seen = batch.dropDuplicates(keys), _before(batch.sparkSession, out, batch_id)
        if seen is not None:
            fresh = fresh.join(seen.select(*keys), keys, "left_anti")
        tables.write_changes(fresh, out, batch_id)

    return start(events, each, checkpoint, **run)


def live_windows(outcomes: DataFrame, kind: str, out: str, checkpoint: str, slots: int = 5, slot_ns: int = SECOND,
                 retention_slots: int = 60, arrival: str = "seq", **run) -> StreamingQuery:
    """Tumbling or sliding windows, closed once their submission's newest slot lies beyond them.

    Rows behind the submission's horizon are dropped on arrival; rows within it also count for
    windows that have closed, which are then written again (`closed_windows` reads the latest).
    So only windows that hold the newest slot stay out. Raw rows become slot cells before anything
    else; windows regroup cells. Tables below `out`: heads, cells, windows.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _before(spark, f"{out}/heads", batch_id)
        was = None if before is None else before.groupBy(*KEYS).agg(F.max("head").alias("head"))
        marked = windows.split_late(batch, arrival, retention_slots, slot_ns, heads=was).persist()
        tables.write_changes(marked.groupBy(*KEYS).agg(F.max("head").alias("head")), f"{out}/heads", batch_id)
        tables.write_changes(windows.regroup(marked.filter(~F.col("is_late")), KEYS + ["epoch"]), f"{out}/cells", batch_id)
        marked.unpersist()
        now = spark.read.parquet(f"{out}/heads/{tables.BATCH}={batch_id}")
        now = now.join(was.withColumnRenamed("head", "was"), KEYS, "left") if was is not None else now.withColumn("was", F.lit(None).cast("bigint"))
        first = F.floor(F.col("epoch") / slots) * slots
        lo = F.array(first) if kind == "tumbling" else F.sequence(F.col("epoch") - (slots - 1), F.col("epoch"))
        # Cells of windows that were not closed before, or that this batch adds to.
        cells = _until(spark, f"{out}/cells", batch_id).join(now, KEYS).filter(
            F.col("was").isNull() | (F.col("epoch") > F.col("was") - retention_slots - slots))
        cells = cells.withColumn("lo", F.explode(lo)).filter(F.col("lo") + slots <= F.col("head"))
        due = (F.col(tables.BATCH) == batch_id) | F.col("was").isNull() | (F.col("lo") + slots > F.col("was"))
        due = cells.filter(due).select(*KEYS, "lo").distinct()
        rows = windows.window_rows(cells.join(due, KEYS + ["lo"], "left_semi"), kind, slots, slot_ns)
        tables.write_changes(rows, f"{out}/windows", batch_id)

    return start(outcomes, each, checkpoint, **run)


def closed_windows(spark: SparkSession, out: str) -> DataFrame:
    return tables.read_current(spark, f"{out}/windows", [*KEYS, "window_start", "window_kind"]).select(*windows.WINDOW_COLUMNS)


def verdicts(order_events: DataFrame, out: str, checkpoint: str, tick: float = 0.01, count: int = 25, **run) -> StreamingQuery:
    """Running verdicts, each micro-batch going on from what is kept of its orders; no earlier event is read again.

    Positions of a batch lie behind those of the batches before, as a stream's do. Kept are, in tables of current rows below `out`: `orders`
    (intent, quantity taken and what rests, of every order), `resting` (the open book) and `verdicts`. A batch reads the
    states of the orders it names, the orders that rest in the submissions it touches, and those submissions' verdicts. Its own rows
    then make a book by the set form, validity rounds within the batch included, so a hot submission is no single task.
    """
    orders = tables.KeyedTable(f"{out}/orders", orderbook.ORDER)
    resting = tables.KeyedTable(f"{out}/resting", orderbook.ORDER, alive=F.col("r_pos").isNotNull())
    kept = tables.KeyedTable(f"{out}/verdicts", KEYS)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        events = cut(batch)
        named = cut(orderbook.order_log(events, 1 << 20).select(*orderbook.ORDER).distinct())
        bounds = named.agg(F.min("oid"), F.max("oid")).first()
        if bounds[0] is None:
            return
        known, book_before, said = (t.read(spark, batch_id) for t in (orders, resting, kept))
        prior = others = None
        if known is not None:
            # The ids' range reaches the sorted files; the join does the rest.
            prior = cut(known.where(F.col("oid").between(*bounds)).join(named, orderbook.ORDER, "left_semi"))
            others = book_before.where("r_pos is not null").join(named.select(*KEYS).distinct(), KEYS, "left_semi").join(named, orderbook.ORDER, "left_anti")
        book = orderbook.rebuild(events, tick, prior=prior)
        own = book.lives
        if others is not None:
            book.lives = own.unionByName(orderbook.resting_lives(others, tick), allowMissingColumns=True)
        found = cut(rules.findings(book))
        fresh = rules.verdicts(book, found, count)
        now = fresh if said is None else rules.added_verdicts(said, fresh, count)
        kept.write(now, batch_id)
        after = cut(orderbook.states(book))
        orders.write(after.drop("opened"), batch_id)
        resting.write(after.where("opened").drop("opened"), batch_id)
        for made in (events, named, prior, book.log, book.fills, own, found, after):
            if made is not None:
                discard(made)

    return start(order_events, each, checkpoint, **run)


def current_verdicts(spark: SparkSession, out: str) -> DataFrame:
    """The newest verdict of every submission that `verdicts` has seen."""
    return tables.KeyedTable(f"{out}/verdicts", KEYS).read(spark)


def sandbox(samples: DataFrame, out: str, checkpoint: str, **run) -> StreamingQuery:
    """Append resource samples."""
    return start(samples, lambda b, i: tables.write_changes(
        b.withColumn("sampled_at", instant(F.when(F.col("sample_ts") == 0, F.unix_micros(F.current_timestamp()) * 1000)
                                           .otherwise(F.col("sample_ts")))), out, i), checkpoint, **run)


def score_board(window_stream: DataFrame, verdict_stream: DataFrame | None, out: str, checkpoint: str,
                config: ScoreConfig = ScoreConfig(), score_window: str | None = None, **run) -> StreamingQuery:
    """Live scores and ranks from two streams: closed windows and verdicts. One board update per micro-batch.

    Kept per submission (table `scores`): count, mean and squared deviations of its tumbling windows' TPS, which merge with
    those of a batch; its last window; its last verdict. A batch reads these for the submissions it names and nothing else. The last
    window is the newest of kind `score_window`, or of any kind where None; a verdict replaces an earlier one by its orders checked. Every
    delivered window counts, one written again included. A submission has no score before its first window, and counts as
    correct before its first verdict.

    Ranks come from an index (table `index`): entries per score band and latency band of a run. A batch changes the counts of the bands that its
    submissions leave and enter; a rank is what lies in the bands before, plus the place within the own band, so only
    bands of changed entries are read. Table `moves` gets a row per changed entry with its rank before (0: new). `current_board` ranks all.
    """
    scores = tables.KeyedTable(f"{out}/scores", KEYS)
    index = tables.KeyedTable(f"{out}/index", board.BAND, alive=F.col("n") > 0)
    window = ["window_start", "window_end", "tps", "p50_us", "p99_us", "error_rate"]
    tag = lambda df, kind: df.select(
        *KEYS, *[(F.struct(*df.columns) if k == kind else F.lit(None)).alias(k) for k in ("w", "v")])
    both = tag(window_stream, "w")
    if verdict_stream is not None:
        both = both.unionByName(tag(verdict_stream.select(*KEYS, "correctness_score", "orders_checked"), "v"))

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        scoring = F.col("w").isNotNull() & (F.lit(score_window is None) | (F.col("w.window_kind") == score_window))
        mine = batch.groupBy(*KEYS).agg(
            *windows.tps_moments("w"),
            F.max_by(F.struct(*[f"w.{c}" for c in window]), F.when(scoring, F.struct("w.window_end", "w.window_kind"))).alias("last"),
            *([F.max_by("v.correctness_score", F.when(F.col("v").isNotNull(), F.col("v.orders_checked"))).alias("correct")]
              if verdict_stream is not None else [F.lit(None).cast("double").alias("correct")]))
        mine = cut(mine)
        if mine.isEmpty():
            return
        before, counts = scores.read(spark, batch_id), index.read(spark, batch_id)
        old = mine.limit(0).select(*KEYS, "n", "mean", "m2", "last", "correct", *[F.lit(None).cast("double").alias(c) for c in board.SCORES]) if before is None else (
            before.join(mine.select(*KEYS), KEYS, "left_semi"))
        now = cut(board.live_scores(old, mine, config))
        changed = board.index_changes(old, now)
        total = changed if counts is None else changed.unionByName(counts.join(changed.select(*board.BAND), board.BAND, "left_semi"))
        index.write(total.groupBy(*board.BAND).agg(F.sum("n").alias("n")), batch_id)
        scores.write(now, batch_id)
        entries, bands = scores.read(spark, batch_id + 1), index.read(spark, batch_id + 1)
        moves = board.ranks_in(now, entries, bands)
        if before is None:
            moves = moves.withColumn("prev_rank", F.lit(0).cast("bigint"))
        else:
            prev = board.ranks_in(old, before, counts).select(*KEYS, F.col("rank").alias("prev_rank"))
            moves = moves.join(prev, KEYS, "left").withColumn("prev_rank", F.coalesce("prev_rank", F.lit(0)))
        moves = moves.withColumn("rank_delta", board.rank_delta(F.col("rank"), F.col("prev_rank")))
        tables.write_changes(moves, f"{out}/moves", batch_id)
        for made in (mine, now):
            discard(made)

    return start(both, each, checkpoint, **run)


def current_board(spark: SparkSession, out: str, batch_id: int | None = None) -> DataFrame:
    """The whole board after an update (the newest where None): scores, rank, and the rank at the update of the run before."""
    scores = tables.KeyedTable(f"{out}/scores", KEYS)
    written = sorted(int(n.partition("=")[2]) for n in names_in(spark, f"{out}/moves") if n.startswith(f"{tables.BATCH}="))
    batch_id = written[-1] if batch_id is None else batch_id
    moved = spark.read.parquet(f"{out}/moves/{tables.BATCH}={batch_id}").select("run_id").distinct()
    now = board.ranked(scores.read(spark, batch_id + 1).where("composite is not null"))
    before = scores.read(spark, batch_id)
    if before is None:
        return now.withColumn("prev_rank", F.lit(0).cast("bigint"))
    prev = board.ranked(before.where("composite is not null")).join(moved, "run_id", "left_semi")
    out_rows = now.join(prev.select(*KEYS, F.col("rank").alias("prev_rank")), KEYS, "left")
    return out_rows.withColumn("prev_rank", F.coalesce("prev_rank", F.lit(0)))


def _until(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).filter(F.col(tables.BATCH) <= batch_id)


def _before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        old = spark.read.option("basePath", path).parquet(path).filter(F.col(tables.BATCH) < batch_id)
    except AnalysisException:  # no board yet
        return None
    return None if old.isEmpty() else old
