"""Order-flow records read from the star-schema tables the checks run on.

Each function maps whole tables to the records an operator takes. They stand
in for the live topics and add no filter of their own.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowboard.functions.timeline import HOUR, epoch_of, nanos
from flowboard.operators import histograms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _run():
    return F.concat(F.lit("run-"), F.expr("cast((day(ts) - 1) div 10 as string)"))


def _sub():
    return F.concat(F.lit("sub-"), F.lpad((F.col("user_id") % 8).cast("string"), 3, "0"))


def from_events(events: DataFrame, lagged: bool = False) -> DataFrame:
    """Acks out of the events table; works on a stream too. Lagged ones were received `k` hours before they arrive."""
    error = F.col("event_type") == "error"
    lag = _k().cast("bigint") * HOUR if lagged else F.lit(0)
    return events.select(
        _run().alias("run_id"), _sub().alias("submission_id"), F.col("event_id").alias("seq"),
        F.col("user_id").alias("bot_id"), (nanos(F.col("ts")) - lag).alias("recv_ts"),
        F.round(F.col("value") * 1000).cast("bigint").alias("ack_latency_us"),
        (~error).alias("accepted"), (error & (_k() >= 90)).alias("is_timeout"),
    )


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers per (run, source), one per four events, so each source has gaps."""
    return table(spark, sf_dir, "events").select(
        _run().alias("run_id"),
        F.concat(F.lit("bot-fleet/shard-"), (F.col("user_id") % 4).cast("string")).alias("source"),
        F.expr("event_id div 4").alias("seq"),
    )


def late_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acks delivered out of order: event time lags arrival by `k` hours."""
    return table(spark, sf_dir, "events").select(
        _run().alias("run_id"), _sub().alias("submission_id"), F.col("event_id").alias("seq"),
        (nanos(F.col("ts")) - _k().cast("bigint") * HOUR).alias("ts_ns"),
    )


def shard_metrics(spark: SparkSession, sf_dir: str, width_ns: int = 6 * HOUR) -> DataFrame:
    """Pre-aggregated window per (run, submission, shard) with its histogram in wire form."""
    events = table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    rows = events.select(
        _run().alias("run_id"), _sub().alias("submission_id"), (F.col("event_id") % 4).alias("shard_id"),
        epoch_of(nanos(F.col("ts")), width_ns).alias("w"), F.round("value").cast("bigint").alias("us"),
        error.alias("error"), (error & (_k() >= 90)).alias("is_timeout"), F.col("ts"),
    )
    keys = ["run_id", "submission_id", "shard_id", "w"]
    counters = rows.groupBy(*keys).agg(
        F.count_if(~F.col("error")).alias("transactions"), F.count_if(F.col("error")).alias("errors"),
        F.count_if(F.col("is_timeout")).alias("timeouts"),
        (F.count(F.lit(1)) * 60).cast("double").alias("window_seconds"),
    )
    wire = histograms.export_dense(histograms.build(rows, keys, F.col("us")), keys)
    return counters.join(wire, keys, "left").select(
        "run_id", "submission_id", "shard_id", "transactions", "errors", "timeouts", "window_seconds",
        "hdr_buckets", (F.col("w") * width_ns).alias("window_start_ts"),
        ((F.col("w") + 1) * width_ns - 1).alias("window_end_ts"),
    )


def sandbox_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _k()
    return table(spark, sf_dir, "events").select(
        _run().alias("run_id"), _sub().alias("submission_id"), F.col("event_id").alias("seq"),
        nanos(F.col("ts")).alias("sample_ts"),
        F.concat(F.lit("pod-"), F.col("user_id").cast("string")).alias("pod_name"),
        (200 + 8 * k).cast("double").alias("cpu_millicores"),
        F.when(k >= 95, "UNHEALTHY").when(k >= 85, "DEGRADED").when(k < 5, "").otherwise("READY").alias("health"),
    )


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest request bodies: single envelopes, arrays, repeats, and broken ones, chosen by `k`."""
    return from_events_body(table(spark, sf_dir, "events"))


def from_events_body(events: DataFrame) -> DataFrame:
    k = _k()
    ns = nanos(F.col("ts"))
    latency = F.round(F.col("value") * 1000).cast("bigint")
    blank = lambda at, c: F.when(k == at, F.lit("")).otherwise(c)
    ack = F.to_json(F.struct(
        F.col("user_id").alias("bot_id"), F.col("event_id").alias("order_id"),
        (F.col("event_type") != "error").alias("accepted"), ns.alias("recv_ts"), latency.alias("ack_latency_us")))
    submit = F.to_json(F.struct(
        F.col("user_id").alias("bot_id"), F.col("event_id").alias("order_id"),
        F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit("limit").alias("kind"),
        F.col("value").alias("price"), (k + 1).alias("quantity"), ns.alias("send_ts"),
        F.lit(0).alias("target_order_id")))
    fill = F.to_json(F.struct(
        F.col("user_id").alias("bot_id"), F.col("event_id").alias("order_id"),
        (F.col("event_id") - 1).alias("maker_order_id"), F.col("value").alias("fill_price"),
        (k + 1).alias("fill_quantity"), F.lit(0).alias("remaining_quantity"), F.col("event_id").alias("trade_id"),
        ns.alias("recv_ts")))
    opened = F.to_json(F.struct(
        F.col("event_id").alias("connection_id"), F.col("user_id").alias("bot_id"),
        F.lit("10.0.0.1").alias("remote_addr"), ns.alias("opened_ts"), latency.alias("handshake_us")))
    cancel = F.to_json(F.struct(
        F.col("user_id").alias("bot_id"), F.col("event_id").alias("order_id"), (k + 1).alias("cancelled_quantity"),
        F.lit("user").alias("reason"), ns.alias("recv_ts")))
    closed = F.to_json(F.struct(
        F.col("event_id").alias("connection_id"), F.col("user_id").alias("bot_id"), F.lit("eof").alias("close_reason"),
        ns.alias("closed_ts"), (k * 10).alias("bytes_sent"), latency.alias("bytes_recv")))
    is_closed = (F.col("event_type") == "signup") & (k % 3 == 1)
    is_cancel = ~F.col("event_type").isin("view", "purchase", "signup") & (k % 5 == 3)
    kind = (
        F.when(F.col("event_type") == "view", "order_submitted").when(F.col("event_type") == "purchase", "order_filled")
        .when(is_closed, "connection_closed").when(F.col("event_type") == "signup", "connection_opened")
        .when(is_cancel, "order_cancelled").otherwise("order_ack")
    )
    payload = (
        F.when(F.col("event_type") == "view", submit).when(F.col("event_type") == "purchase", fill)
        .when(is_closed, closed).when(F.col("event_type") == "signup", opened).when(is_cancel, cancel).otherwise(ack)
    )
    quoted = lambda name, c: F.concat(F.lit(f'"{name}":"'), c, F.lit('",'))
    text = F.concat(
        F.lit("{"), quoted("run_id", blank(90, _run())), quoted("submission_id", blank(91, _sub())),
        F.lit('"seq":'), F.col("event_id").cast("string"), F.lit(',"emit_ts":'), ns.cast("string"), F.lit(","),
        quoted("source", F.concat(F.lit("bot-fleet/shard-"), (F.col("user_id") % 4).cast("string"))),
        F.lit('"type":"'),
        F.when(k == 92, F.lit("")).when(k == 94, F.lit("order_teleported")).otherwise(kind), F.lit('"'),
        F.when(k == 93, F.lit("")).otherwise(F.concat(F.lit(',"payload":'), payload)), F.lit("}"),
    )
    body = (
        F.when(k == 49, F.lit("not json")).when(k == 47, F.lit("  "))
        .when(k == 50, F.concat(F.lit("["), text, F.lit(","), text, F.lit("]")))
        .when(k % 2 == 1, F.concat(F.lit(" \n["), text, F.lit("]"))).otherwise(F.concat(F.lit("\t"), text))
    )
    return events.select(F.col("event_id").alias("request_id"), F.col("ts").alias("received_at"), body.alias("body"))


def native_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric records in the producer's own JSON shape, some without a source."""
    k = _k()
    record = F.to_json(F.struct(
        _run().alias("run_id"), _sub().alias("submission_id"),
        F.when(k < 50, "").otherwise("fleet-a").alias("source"), F.col("event_id").alias("seq"),
        (F.col("user_id") % 4).alias("shard_id"), F.col("user_id").alias("transactions"),
        k.cast("bigint").alias("errors"), F.lit(1).alias("timeouts"), F.lit(5.0).alias("seconds"),
        F.round("value").cast("bigint").alias("p99_us"), nanos(F.col("ts")).alias("window_end_ts")))
    return table(spark, sf_dir, "events").select(record.alias("body"))


def native_sandbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _k()
    record = F.to_json(F.struct(
        _run().alias("run_id"), _sub().alias("submission_id"),
        F.when(k < 50, "").otherwise("runner-a").alias("source"), F.col("event_id").alias("seq"),
        F.concat(F.lit("pod-"), F.col("user_id").cast("string")).alias("pod_name"),
        (F.col("user_id") * 1000).alias("memory_bytes"), F.lit("READY").alias("health"),
        (k >= 95).alias("oom_killed"), nanos(F.col("ts")).alias("sample_ts")))
    return table(spark, sf_dir, "events").select(record.alias("body"))


def _price(k):
    return F.round(100 + ((k * 7919) % 41 - 20) * 0.01, 2)


def _quantity(k):
    return 1 + (k * 31) % 50


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order book stream: each order is submitted and acked, every seventh acked twice, each line is a fill of its order, some without quantity.

    Stream position is the order key times 64 plus a small offset, so it follows from the row.
    """
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    k = F.col("k")
    null = lambda t: F.lit(None).cast(t)
    run, sub = F.lit("run-0").alias("run_id"), F.concat(
        F.lit("sub-"), F.lpad(F.expr("cast(k div 500 as string)"), 3, "0")).alias("submission_id")

    def shape(df, pos, event, order_id, **cols):
        spec = {"side": "string", "kind": "string", "price": "double", "quantity": "bigint",
                "accepted": "boolean", "maker_order_id": "bigint", "fill_price": "double",
                "fill_quantity": "bigint", "remaining_quantity": "bigint"}
        return df.select(run, sub, pos.cast("bigint").alias("pos"), F.lit(event).alias("type"),
                         order_id.alias("order_id"),
                         *[cols.get(c, null(t)).alias(c) for c, t in spec.items()])

    o = o.withColumn("k", F.col("o_orderkey"))
    submits = shape(
        o, k * 64, "order_submitted", k,
        side=F.when(F.col("o_custkey") % 2 == 0, "buy").otherwise("sell"),
        kind=F.when(F.col("o_orderpriority") == "1-URGENT", "market").otherwise("limit"),
        price=_price(k), quantity=_quantity(k))
    replies = shape(o, k * 64 + 1, "order_ack", k, accepted=F.col("o_orderstatus") != "P")
    again = shape(o.filter(k % 7 == 0), k * 64 + 2, "order_ack", k, accepted=F.col("o_orderstatus") != "P")
    cancels = shape(o.filter(F.col("o_orderpriority") == "5-LOW"), k * 64 + 62, "order_cancelled", k - 3)
    line = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    li = li.select("l_orderkey", "l_linenumber", "l_quantity", F.row_number().over(line).alias("rn"))
    li = li.withColumn("k", F.col("l_orderkey"))
    qty = F.when(F.col("l_quantity") == 50, 0).otherwise(F.col("l_quantity")).cast("bigint")
    fills = shape(
        li, k * 64 + 2 + F.col("rn"), "order_filled", k,
        maker_order_id=k - F.col("l_linenumber"), fill_price=_price(k - F.col("l_linenumber")),
        fill_quantity=qty, remaining_quantity=F.greatest(F.lit(0), _quantity(k) - qty))
    return submits.unionByName(replies).unionByName(again).unionByName(fills).unionByName(cancels)


# Lifecycle event names a submission passes through, in order, then what follows READY.
STEPS = [
    "submission.created", "upload.succeeded", "validation.started", "validation.passed", "build.started",
    "build.succeeded", "scan.started", "scan.passed", "deployment.started", "deployment.pod_ready", "health.ready",
    "health.degraded", "health.recovered", "teardown.completed",
]
FAILURES = {
    "upload.succeeded": "upload.failed", "validation.passed": "validation.failed",
    "build.succeeded": "build.failed", "scan.passed": "scan.failed",
    "deployment.pod_ready": "deployment.failed", "health.ready": "health.failed",
}


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _k()
    step = F.element_at(F.array(*[F.lit(s) for s in STEPS]), k % len(STEPS) + 1)
    twin = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])
    failed = (F.col("event_type") == "error") & (k >= 95)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u-"), (F.col("user_id") % 16).cast("string")).alias("submission_id"),
        F.col("event_id").alias("pos"), F.col("ts").alias("occurred_at"),
        F.when(failed, F.coalesce(F.try_element_at(twin, step), step)).otherwise(step).alias("event"),
        F.concat(F.lit("svc-"), F.col("event_type")).alias("actor"),
    )


def probe_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("submission_id"),
        F.col("event_id").alias("pos"), F.col("ts").alias("time"),
        (F.col("event_type") != "error").alias("healthy"), F.col("value").alias("latency_ms"),
    )


def submission_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    h = F.md5(F.col("c_name"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    return c.select(
        F.col("c_custkey").alias("request_id"),
        F.when(nation == 3, h).otherwise(uuid).alias("contestant_id"),
        F.when(segment == "MACHINERY", "cpp").when(segment == "BUILDING", "rust")
        .when(segment == "FURNITURE", "java").otherwise("go").alias("language"),
        F.when(nation == 7, "zip").when(nation % 2 == 0, "source").otherwise("binary").alias("submission_type"),
        F.when(nation == 13, "   ").when(nation == 14, F.concat(F.lit("a\n"), F.col("c_name")))
        .otherwise(F.concat(F.lit("  ./"), F.col("c_name"), F.lit(" "))).alias("entrypoint"),
        (F.floor("c_acctbal") + 1000).cast("bigint").alias("declared_port"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contestant submissions with their status."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("submission_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "READY").when(F.col("c_mktsegment") == "BUILDING", "BUILD_FAILED")
        .when(F.col("c_mktsegment") == "FURNITURE", "TERMINATED").otherwise("BUILDING").alias("status"),
    )


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("submission_id"), F.col("o_orderkey").alias("deployment_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(status == "F", "RUNNING").when(status == "O", "STARTING").otherwise("FAILED").alias("status"),
    )


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint actions: urgent orders register, low ones deregister, the others report only."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("submission_id"), F.col("o_orderkey").alias("endpoint_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderpriority") == "5-LOW", "deregister")
        .when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "register").otherwise("report").alias("action"),
        F.concat(F.lit("http://svc-"), F.col("o_orderkey").cast("string")).alias("internal_url"),
    )


def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archive per customer, one entry per order."""
    o, status, pri = table(spark, sf_dir, "orders"), F.col("o_orderstatus"), F.col("o_orderpriority")
    key = F.col("o_orderkey").cast("string")
    total = F.col("o_totalprice")
    return o.select(
        F.col("o_custkey").alias("artifact_id"),
        F.when(F.col("o_custkey") % 3 == 0, "go").when(F.col("o_custkey") % 3 == 1, "rust").otherwise("cpp").alias("language"),
        F.col("o_orderkey").alias("pos"),
        F.when(total > 499000, F.concat(F.lit("../"), key))
        .when(total < 2000, F.concat(F.lit("/abs/"), key))
        .when(pri == "1-URGENT", "bot/go.mod").when(pri == "2-HIGH", "./bot/Cargo.toml")
        .when(pri == "5-LOW", "bot/src/../main.cpp").otherwise(F.concat(F.lit("bot/src/"), key)).alias("name"),
        F.when((status == "P") & (pri == "3-MEDIUM"), "2").otherwise("0").alias("typeflag"),
        F.when((status == "P") & (pri == "3-MEDIUM") & (total > 450000), "../../etc")
        .when((status == "P") & (pri == "3-MEDIUM"), "bot/x").otherwise("").alias("linkname"),
        F.when((total > 498000) & (total <= 499000), 0o4755).otherwise(0o644).alias("mode"),
        F.floor(total * 200).cast("bigint").alias("size"),
    )


def resource_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("scale"), F.col("l_quantity").alias("cpu_pct"),
        F.col("l_extendedprice").cast("bigint").alias("rss_peak_kb"), F.col("l_suppkey").alias("fds"),
        F.col("l_linenumber").cast("bigint").alias("conns"),
    )


def bot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("bot_id"), F.col("o_orderpriority").alias("persona"),
        F.when(s == "F", "limit").when(s == "O", "market").otherwise("cancel").alias("kind"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display names of submissions, one row per run (ten days each, so a month has four)."""
    return table(spark, sf_dir, "nation").select(
        F.explode(F.array(*[F.lit(f"run-{i}") for i in range(4)])).alias("run_id"),
        F.concat(F.lit("sub-"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("submission_id"),
        F.when(F.col("n_regionkey") % 2 == 0, F.col("n_name")).otherwise("").alias("display_name"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts as uploaded bytes."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("artifact_id"), F.encode("text", "UTF-8").alias("content"),
        F.when(F.col("lang") == "en", "binary").otherwise("source").alias("submission_type"),
        F.when(F.col("doc_id") % 3 == 0, F.upper(F.sha2(F.col("text"), 256)))
        .when(F.col("doc_id") % 3 == 1, "").otherwise("00").alias("expected_sha256"),
    )
