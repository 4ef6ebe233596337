"""Decoding, checking and routing of ingest records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowboard import schemas

_CORRUPT = "_corrupt"


def _once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add costly columns so that later filters and projections read them instead of repeating them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def decode_bodies(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Split request bodies into envelopes and rejected requests.

    A body is one envelope or a JSON array of them, leading whitespace allowed.
    One undecodable element rejects its whole body.
    """
    text = F.ltrim(F.col(body), F.lit(" \n\t\r"))
    is_array = F.startswith(text, F.lit("["))
    listed = F.when(is_array, text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    checked = f"{schemas.ENVELOPE}, {_CORRUPT} STRING"
    options = {"columnNameOfCorruptRecord": _CORRUPT}
    parts = _once(df, __text=text, __array=is_array, __items=F.from_json(listed, "array<string>"))
    parts = _once(parts, __envelopes=F.transform("__items", lambda i: F.from_json(i, checked, options)))
    broken = F.coalesce(
        F.exists("__envelopes", lambda e: e.isNull() | e[_CORRUPT].isNotNull()), F.lit(True))
    is_array = F.col("__array")
    parts = _once(parts, __reason=(
        F.when(F.length("__text") == 0, "empty body")
        .when(broken & is_array, "invalid JSON array of envelopes")
        .when(broken | (~is_array & (F.size("__items") != 1)), "invalid envelope JSON")
    ))
    fields = [f.split()[0] for f in schemas.ENVELOPE.split(", ")]
    kept = [c for c in df.columns if c != body]
    good = (
        parts.filter(F.col("__reason").isNull())
        .select(*kept, F.posexplode("__envelopes").alias("item", "e"))
        .select(*kept, "item", *[F.col(f"e.{f}").alias(f) for f in fields])
    )
    bad = parts.filter(F.col("__reason").isNotNull()).select(*kept, body, F.col("__reason").alias("reason"))
    return good, bad


def reject_reason() -> Column:
    """First failing check of an envelope, NULL when it is sound."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(blank("run_id"), "missing run_id").when(blank("submission_id"), "missing submission_id")
        .when(blank("type"), "missing type").when(blank("payload"), "empty payload")
        .when(~F.col("type").isin(*schemas.EVENT_TYPES),
              F.concat(F.lit('unknown event type "'), F.col("type"), F.lit('"')))
    )


def topic_of(event_type: Column) -> Column:
    return (
        F.when(event_type.isin(*schemas.ORDER_TYPES), schemas.TOPIC_ORDERS)
        .when(event_type.isin(*schemas.CONNECTION_TYPES), schemas.TOPIC_CONNECTIONS)
        .when(event_type == "bot_metrics", schemas.TOPIC_BOT_METRICS)
        .when(event_type == "sandbox_metrics", schemas.TOPIC_SANDBOX_METRICS)
        .otherwise(schemas.TOPIC_DEAD_LETTER)
    )


def partition_key() -> Column:
    return F.concat_ws(":", "run_id", "submission_id")


def split_key(key: Column) -> tuple[Column, Column]:
    """Run and submission of a key, split at the first colon; without one the submission is empty."""
    at = F.instr(key, ":")
    run = F.when(at > 0, F.substring(key, F.lit(1), at - 1)).otherwise(key)
    sub = F.when(at > 0, F.substring(key, at + 1, F.length(key))).otherwise("")
    return run, sub


def route(envelopes: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """Add reason, topic, key and ingest time. Rejected envelopes go to the dead-letter topic under their reason."""
    now = F.unix_micros(F.current_timestamp()) * 1000
    df = envelopes.withColumn("reason", reject_reason())
    bad = F.col("reason").isNotNull()
    return (
        df.withColumn("topic", F.when(bad, schemas.TOPIC_DEAD_LETTER).otherwise(topic_of(F.col("type"))))
        .withColumn("key", F.when(bad, F.col("reason")).otherwise(partition_key()))
        .withColumn("ingest_ts", F.when(bad, F.col("ingest_ts")).otherwise(now if ingest_ts is None else ingest_ts))
    )


def payload_of(envelopes: DataFrame, event_type: str) -> DataFrame:
    """Typed payload columns of one event type. Payloads that do not decode are skipped."""
    ddl = schemas.PAYLOADS[event_type]
    names = [f.split()[0] for f in ddl.split(", ")]
    parsed = F.from_json("payload", f"{ddl}, {_CORRUPT} STRING", {"columnNameOfCorruptRecord": _CORRUPT})
    return (
        envelopes.filter(F.col("type") == event_type).withColumn("__p", parsed)
        .filter(F.col("__p").isNotNull() & F.col(f"__p.{_CORRUPT}").isNull())
        .select("run_id", "submission_id", "seq", *[F.col(f"__p.{n}").alias(n) for n in names])
    )


def order_stream(envelopes: DataFrame, pos: str = "seq") -> DataFrame:
    """The four order event types as one typed table with a stream position, in one pass."""
    options = {"columnNameOfCorruptRecord": _CORRUPT}
    parsed = {
        f"__{kind}": F.when(F.col("type") == kind, F.from_json(
            "payload", f"{schemas.PAYLOADS[kind]}, {_CORRUPT} STRING", options))
        for kind in schemas.ORDER_TYPES
    }
    df = _once(envelopes.filter(F.col("type").isin(*schemas.ORDER_TYPES)), **parsed)
    sound = F.lit(False)
    for name in parsed:
        sound = sound | (F.col(name).isNotNull() & F.col(f"{name}.{_CORRUPT}").isNull())
    has = {kind: [f.split()[0] for f in schemas.PAYLOADS[kind].split(", ")] for kind in schemas.ORDER_TYPES}

    def field(name: str, kind: str) -> Column:
        if name in ("run_id", "submission_id", "type"):
            return F.col(name)
        if name == "pos":
            return F.col(pos).alias("pos")
        found = [F.col(f"__{t}.{name}") for t in schemas.ORDER_TYPES if name in has[t]]
        return F.coalesce(*found).cast(kind).alias(name)

    return df.filter(sound).select(*[field(*f.split()) for f in schemas.ORDER_EVENT.split(", ")])


def lifecycle_decode(df: DataFrame, body: str = "body") -> DataFrame:
    """Lifecycle envelopes of schema version 1 that name a type and a submission."""
    e = F.from_json(body, schemas.LIFECYCLE_EVENT)
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return (
        df.select(e.alias("e")).select("e.*")
        .filter((F.col("schema_version") == 1) & filled("type") & filled("submission_id"))
    )


def lifecycle_encode(events: DataFrame) -> DataFrame:
    """Wire form; a record without version, id, type, submission or producer is not encoded."""
    names = [f.split()[0] for f in schemas.LIFECYCLE_EVENT.split(", ")]
    needed = ["event_id", "type", "submission_id", "producer"]
    ok = F.coalesce(F.col("schema_version"), F.lit(0)) != 0
    for c in needed:
        ok = ok & (F.coalesce(F.col(c), F.lit("")) != "")
    return events.filter(ok).select(F.to_json(F.struct(*names)).alias("body"))


def lifecycle_payload(events: DataFrame, event_type: str) -> DataFrame:
    """Typed data of one lifecycle event type."""
    data = F.from_json("data", schemas.LIFECYCLE_DATA[event_type])
    return events.filter(F.col("type") == event_type).select(
        "event_id", "submission_id", "occurred_at", data.alias("d")).select(
        "event_id", "submission_id", "occurred_at", "d.*")


def _native(df: DataFrame, body: str, schema: str, event_type: str, default_source: str, renamed: dict[str, str]):
    r = F.from_json(body, f"{schema}, {_CORRUPT} STRING", {"columnNameOfCorruptRecord": _CORRUPT})
    names = [f.split()[0] for f in schemas.PAYLOADS[event_type].split(", ")]
    # Absent fields take the zero value of their type, as in the record contract.
    kinds = dict(f.split() for f in schemas.PAYLOADS[event_type].split(", "))
    zero = {"STRING": "", "BIGINT": 0, "DOUBLE": 0.0, "BOOLEAN": False}
    value = lambda n: F.coalesce(F.col(f"r.{renamed.get(n, n)}"), F.lit(zero[kinds[n]]).cast(kinds[n])).alias(n)
    return (
        df.select(r.alias("r")).filter(F.col("r").isNotNull() & F.col(f"r.{_CORRUPT}").isNull()).select(
            F.col("r.run_id").alias("run_id"), F.col("r.submission_id").alias("submission_id"),
            F.coalesce("r.seq", F.lit(0)).alias("seq"),
            F.lit(None).cast("bigint").alias("emit_ts"), F.lit(None).cast("bigint").alias("ingest_ts"),
            F.coalesce(F.nullif(F.col("r.source"), F.lit("")), F.lit(default_source)).alias("source"),
            F.lit(event_type).alias("type"), F.to_json(F.struct(*[value(n) for n in names])).alias("payload"),
        )
    )


def native_bot_metrics(df: DataFrame, body: str = "body") -> DataFrame:
    """Fleet metric records to envelopes."""
    return _native(df, body, schemas.NATIVE_BOT_METRICS, "bot_metrics", "bot-fleet", {"window_seconds": "seconds"})


def native_sandbox(df: DataFrame, body: str = "body") -> DataFrame:
    """Sandbox resource records to envelopes."""
    return _native(df, body, schemas.NATIVE_SANDBOX, "sandbox_metrics", "sandbox-runner", {})
