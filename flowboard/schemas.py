"""Record contracts: event envelopes, payloads, tables, and fixed names."""

from __future__ import annotations

# Fixed values of the record contract.
ORDER_TYPES = ("order_submitted", "order_ack", "order_filled", "order_cancelled")
CONNECTION_TYPES = ("connection_opened", "connection_closed")
EVENT_TYPES = ORDER_TYPES + CONNECTION_TYPES + ("bot_metrics", "sandbox_metrics")

# Fixed topic names.
TOPIC_ORDERS = "telemetry.orders"
TOPIC_CONNECTIONS = "telemetry.connections"
TOPIC_BOT_METRICS = "telemetry.bot_metrics"
TOPIC_SANDBOX_METRICS = "telemetry.sandbox_metrics"
TOPIC_DEAD_LETTER = "telemetry.deadletter"

# Fixed rule names of the correctness verdict.
RULE_PRICE = "price_time_priority"
RULE_FIFO = "fifo"
RULE_QUANTITY = "fill_quantity"
RULE_BOOK = "book_consistency"
RULE_TRADE = "trade_matching"

ENVELOPE = (
    "run_id STRING, submission_id STRING, seq BIGINT, emit_ts BIGINT, ingest_ts BIGINT, "
    "source STRING, type STRING, payload STRING"
)

PAYLOADS = {
    "order_submitted": (
        "bot_id BIGINT, order_id BIGINT, side STRING, kind STRING, price DOUBLE, "
        "quantity BIGINT, send_ts BIGINT, target_order_id BIGINT"
    ),
    "order_ack": (
        "bot_id BIGINT, order_id BIGINT, accepted BOOLEAN, reject_reason STRING, "
        "recv_ts BIGINT, ack_latency_us BIGINT"
    ),
    "order_filled": (
        "bot_id BIGINT, order_id BIGINT, maker_order_id BIGINT, fill_price DOUBLE, "
        "fill_quantity BIGINT, remaining_quantity BIGINT, trade_id BIGINT, recv_ts BIGINT"
    ),
    "order_cancelled": (
        "bot_id BIGINT, order_id BIGINT, cancelled_quantity BIGINT, reason STRING, recv_ts BIGINT"
    ),
    "connection_opened": (
        "connection_id BIGINT, bot_id BIGINT, remote_addr STRING, opened_ts BIGINT, handshake_us BIGINT"
    ),
    "connection_closed": (
        "connection_id BIGINT, bot_id BIGINT, close_reason STRING, closed_ts BIGINT, "
        "bytes_sent BIGINT, bytes_recv BIGINT"
    ),
    "bot_metrics": (
        "shard_id BIGINT, transactions BIGINT, errors BIGINT, timeouts BIGINT, "
        "window_seconds DOUBLE, p50_us BIGINT, p90_us BIGINT, p99_us BIGINT, mean_us DOUBLE, "
        "hdr_buckets STRING, window_start_ts BIGINT, window_end_ts BIGINT"
    ),
    "sandbox_metrics": (
        "pod_name STRING, namespace STRING, cpu_millicores DOUBLE, cpu_limit_millicores DOUBLE, "
        "memory_bytes BIGINT, memory_limit_bytes BIGINT, open_fds BIGINT, "
        "active_connections BIGINT, health STRING, oom_killed BOOLEAN, restart_count BIGINT, "
        "sample_ts BIGINT"
    ),
}

# Records a producer may post in its own shape instead of an envelope.
NATIVE_BOT_METRICS = (
    "run_id STRING, submission_id STRING, source STRING, seq BIGINT, shard_id BIGINT, "
    "transactions BIGINT, errors BIGINT, timeouts BIGINT, seconds DOUBLE, p50_us BIGINT, "
    "p90_us BIGINT, p99_us BIGINT, mean_us DOUBLE, hdr_buckets STRING, "
    "window_start_ts BIGINT, window_end_ts BIGINT"
)
NATIVE_SANDBOX = (
    "run_id STRING, submission_id STRING, source STRING, seq BIGINT, pod_name STRING, "
    "namespace STRING, cpu_millicores DOUBLE, cpu_limit_millicores DOUBLE, memory_bytes BIGINT, "
    "memory_limit_bytes BIGINT, open_fds BIGINT, active_connections BIGINT, health STRING, "
    "oom_killed BOOLEAN, restart_count BIGINT, sample_ts BIGINT"
)

LIFECYCLE_EVENT = (
    "event_id STRING, type STRING, submission_id STRING, occurred_at TIMESTAMP, "
    "producer STRING, schema_version INT, data STRING"
)

# Typed lifecycle payloads.
LIFECYCLE_DATA = {
    "submission.created": "contestant_id STRING, language STRING, submission_type STRING, upload_url STRING",
    "submission.uploaded": "artifact_uri STRING, artifact_sha256 STRING, declared_port INT, entrypoint STRING",
    "validation.failed": "reason STRING",
    "build.requested": "artifact_uri STRING, language STRING",
    "build.succeeded": "image_ref STRING, image_digest STRING",
    "build.failed": "error STRING, logs_uri STRING",
    "scan.passed": "image_digest STRING, findings_summary STRING",
    "scan.failed": "findings_summary STRING",
    "deployment.requested": "image_ref STRING, cpu_cores INT, memory_mb INT, declared_port INT",
    "deployment.ready": "pod_name STRING, internal_url STRING, service_name STRING",
    "deployment.failed": "reason STRING",
    "health.ready": "internal_url STRING",
    "health.degraded": "reason STRING, last_latency_ms DOUBLE",
    "health.recovered": "internal_url STRING",
    "teardown.requested": "reason STRING",
    "teardown.completed": "reason STRING",
}

# Order-book input: one row per order event; `pos` is the event's place in its
# submission's stream (log offset or sequence number), unique per submission.
ORDER_EVENT = (
    "run_id STRING, submission_id STRING, pos BIGINT, type STRING, order_id BIGINT, "
    "side STRING, kind STRING, price DOUBLE, quantity BIGINT, accepted BOOLEAN, "
    "maker_order_id BIGINT, fill_price DOUBLE, fill_quantity BIGINT, remaining_quantity BIGINT"
)
