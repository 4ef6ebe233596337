"""Submission lifecycle: checks, state replay, audit, health, current views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowboard.functions.timeline import epoch_of
from flowboard.operators.scan import prefix_scan
from flowboard.session import cut

# Fixed table of legal moves: (state, event, next state). The first state is empty.
TRANSITIONS = [
    ("", "submission.created", "CREATED"),
    ("CREATED", "upload.succeeded", "UPLOADED"),
    ("CREATED", "upload.failed", "UPLOAD_FAILED"),
    ("UPLOADED", "validation.started", "VALIDATING"),
    ("VALIDATING", "validation.passed", "VALIDATED"),
    ("VALIDATING", "validation.failed", "VALIDATION_FAILED"),
    ("VALIDATED", "build.started", "BUILDING"),
    ("BUILDING", "build.succeeded", "BUILT"),
    ("BUILDING", "build.failed", "BUILD_FAILED"),
    ("BUILT", "scan.started", "SCANNING"),
    ("SCANNING", "scan.passed", "SCANNED"),
    ("SCANNING", "scan.failed", "SCAN_FAILED"),
    ("SCANNED", "deployment.started", "DEPLOYING"),
    ("DEPLOYING", "deployment.pod_ready", "HEALTH_CHECK"),
    ("DEPLOYING", "deployment.failed", "DEPLOY_FAILED"),
    ("HEALTH_CHECK", "health.ready", "READY"),
    ("HEALTH_CHECK", "health.failed", "HEALTH_FAILED"),
    ("READY", "health.degraded", "DEGRADED"),
    ("READY", "teardown.completed", "TERMINATED"),
    ("DEGRADED", "health.recovered", "READY"),
    ("DEGRADED", "teardown.completed", "TERMINATED"),
]
# Fixed states that no event leaves.
TERMINAL = (
    "TERMINATED", "UPLOAD_FAILED", "VALIDATION_FAILED", "BUILD_FAILED", "SCAN_FAILED", "DEPLOY_FAILED",
    "HEALTH_FAILED",
)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def _moves() -> Column:
    pairs = [x for s, e, n in TRANSITIONS for x in (F.lit(f"{s}|{e}"), F.lit(n))]
    return F.create_map(*pairs)


def next_state(state: Column, event: Column) -> Column:
    """State after an event, NULL when the move is illegal."""
    return F.try_element_at(_moves(), F.concat(state, F.lit("|"), event))


def replay(events: DataFrame, key: str = "submission_id", pos: str = "pos", chunk_rows: int = 4096) -> DataFrame:
    """State before and after every event, with `accepted`.

    A run of events maps each entry state to an exit state, and such maps
    compose. Chunks of the stream are reduced to their map, the maps of a key
    are scanned (one row per chunk), and each chunk is then folded from its
    known entry state. Chunks are grouped by `chunk_rows` again, so a list holds
    at most `chunk_rows` entries up to `chunk_rows`^3 positions.
    """
    states = list(dict.fromkeys(s for s, _, _ in TRANSITIONS))
    ev = events.withColumn("__c", epoch_of(F.col(pos), chunk_rows))
    rest = [c for c in events.columns if c not in (key, pos, "event")]
    chunks = ev.groupBy(key, "__c").agg(
        F.array_sort(F.collect_list(F.struct(pos, "event", *rest))).alias("__e"))

    def step(state: Column, event: Column) -> Column:
        return F.coalesce(next_state(state, event), state)

    exits = F.aggregate(
        "__e", F.array(*[F.lit(s) for s in states]),
        lambda acc, e: F.transform(acc, lambda s: step(s, e["event"])))
    maps = chunks.select(key, "__c", F.map_from_arrays(F.array(*[F.lit(s) for s in states]), exits).alias("__m"))
    # Same step once more over groups of chunks, so that a key's last list stays short.
    listed = lambda c, m: F.array_sort(F.collect_list(F.struct(F.col(c).alias("c"), F.map_entries(m).alias("m"))))
    groups = maps.withColumn("__g", epoch_of(F.col("__c"), chunk_rows)).groupBy(key, "__g").agg(
        listed("__c", "__m").alias("__list"))
    through = F.aggregate(
        "__list", F.array(*[F.lit(s) for s in states]), lambda acc, x: F.transform(acc, lambda s: _through(x, s)))
    chain = groups.select(key, "__g", F.map_from_arrays(F.array(*[F.lit(s) for s in states]), through).alias("__m"))
    chain = chain.groupBy(key).agg(listed("__g", "__m").alias("__list"))
    starts = chain.select(key, F.inline(_entries("__list", F.lit(""))).alias("__g", "__start"))
    entry = groups.join(starts, [key, "__g"]).select(
        key, F.inline(_entries("__list", F.col("__start"))).alias("__ec", "__entry"))
    joined = chunks.join(entry.withColumnRenamed("__ec", "__c"), [key, "__c"])
    out_type = "array<struct<i:int,prev:string,next:string>>"
    folded = F.aggregate(
        F.sequence(F.lit(0), F.size("__e") - 1),
        F.struct(F.col("__entry").alias("s"), F.array().cast(out_type).alias("out")),
        lambda acc, i: _advance(acc, i),
        lambda acc: acc["out"])
    rows = joined.select(key, "__e", F.explode(folded).alias("r")).select(
        key, F.col("__e")[F.col("r.i")].alias("e"), F.col("r.prev").alias("prev_state"), F.col("r.next").alias("n"))
    return rows.select(
        key, "e.*", "prev_state", F.coalesce("n", "prev_state").alias("new_state"),
        F.col("n").isNotNull().alias("accepted"))


def _through(chunk: Column, state: Column) -> Column:
    """State after a chunk, given the state before it."""
    return F.coalesce(F.try_element_at(F.map_from_entries(chunk["m"]), state), state)


def _entries(chunks: str, start: Column) -> Column:
    """Entry state of each listed chunk."""
    return F.aggregate(
        chunks, F.struct(start.alias("s"), F.array().cast("array<struct<c:bigint,s:string>>").alias("out")),
        lambda acc, x: F.struct(
            _through(x, acc["s"]).alias("s"),
            F.array_append(acc["out"], F.struct(x["c"].alias("c"), acc["s"].alias("s"))).alias("out")),
        lambda acc: acc["out"])


def _advance(acc: Column, i: Column) -> Column:
    event = F.col("__e")[i]["event"]
    nxt = next_state(acc["s"], event)
    return F.struct(
        F.coalesce(nxt, acc["s"]).alias("s"),
        F.array_append(acc["out"], F.struct(i.alias("i"), acc["s"].alias("prev"), nxt.alias("next"))).alias("out"))


def current_state(replayed: DataFrame, key: str = "submission_id", pos: str = "pos") -> DataFrame:
    """Final state and event counts per submission."""
    return replayed.groupBy(key).agg(
        F.max_by("new_state", pos).alias("status"), F.count_if(F.col("accepted")).alias("accepted_events"),
        F.count_if(~F.col("accepted")).alias("rejected_events"),
    ).withColumn("terminal", is_terminal(F.col("status")))


def audit(replayed: DataFrame) -> DataFrame:
    """One row per accepted transition; rejected ones leave no trace."""
    return replayed.filter("accepted").withColumnRenamed("event", "action").drop("accepted")


def check_submissions(requests: DataFrame) -> DataFrame:
    """First failing check per request as `error`; the entrypoint is stored trimmed."""
    uuid = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"  # fixed pattern
    space = " \t\n\r\u000b\f\u0085 "
    entry = F.trim(F.coalesce("entrypoint", F.lit("")), F.lit(space))
    quoted = lambda text, c: F.concat(F.lit(text + ' "'), F.coalesce(c, F.lit("")), F.lit('"'))
    id_ = F.coalesce("contestant_id", F.lit(""))
    error = (
        F.when(~F.rlike(id_, F.lit(uuid)), quoted("invalid uuid", id_))
        .when(~F.coalesce("language", F.lit("")).isin("cpp", "rust", "go"),
              quoted("unsupported language", F.col("language")))
        .when(~F.coalesce("submission_type", F.lit("")).isin("source", "binary"),
              quoted("unsupported submission_type", F.col("submission_type")))
        .when(entry == "", "entrypoint is required")
        .when(F.contains(entry, F.lit("\x00")) | F.contains(entry, F.lit("\n")),
              "entrypoint contains invalid control characters")
        .when(~F.coalesce("declared_port", F.lit(0)).between(1024, 65535),
              F.concat(F.lit("declared_port must be in [1024,65535], got "), F.col("declared_port").cast("string")))
    )
    return requests.withColumn("error", error).withColumn("entrypoint", entry)


def classify_health(samples: DataFrame, key: str = "submission_id", pos: str = "pos", slo_ms: float = 500.0,
                    unhealthy_after: int = 3, healthy_after: int = 2, chunk_rows: int = 1 << 20) -> DataFrame:
    """Health state after each probe: READY or DEGRADED once a streak is long enough, else as before."""
    slo_ms, unhealthy_after, healthy_after = slo_ms or 500.0, unhealthy_after or 3, healthy_after or 2
    chunk = epoch_of(F.col(pos), chunk_rows)
    good = F.col("healthy") & (F.col("latency_ms") <= slo_ms)
    df = samples.withColumn("good", good)
    df = prefix_scan(df, [key], [F.col(pos)], chunk, {
        "__bads": ("count", F.when(~F.col("good"), 1)),
        "__goods": ("count", F.when(F.col("good"), 1)),
    })
    # Length of the running streak = rows since the last row of the other kind. Rows of this kind up to
    # that one are found by scanning the count the other kind's rows saw.
    df = prefix_scan(df, [key], [F.col(pos)], chunk, {
        "__goods_at_bad": ("max", F.when(~F.col("good"), F.col("__goods"))),
        "__bads_at_good": ("max", F.when(F.col("good"), F.col("__bads"))),
    })
    good_streak = F.col("__goods") - F.coalesce("__goods_at_bad", F.lit(0))
    bad_streak = F.col("__bads") - F.coalesce("__bads_at_good", F.lit(0))
    trigger = (
        F.when(F.col("good") & (good_streak >= healthy_after), 1)
        .when(~F.col("good") & (bad_streak >= unhealthy_after), 0)
    )
    df = cut(df.withColumn("__trigger", trigger))
    df = prefix_scan(df, [key], [F.col(pos)], chunk, {"__state": ("last", F.col("__trigger"))})
    state = F.when(F.col("__state") == 1, "READY").when(F.col("__state") == 0, "DEGRADED").otherwise("UNKNOWN")
    return df.select(*samples.columns, "good", state.alias("state"))


def last_samples(samples: DataFrame, keys: Sequence[str], order: Sequence[str], count: int = 100) -> DataFrame:
    """Last `count` rows per key; the limit is applied per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return samples.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= count).drop("__rn")


def latest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Current row per key (build, deployment, endpoint): one combining aggregate, no sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def newest_first(rows: DataFrame, time: str, tie: str) -> DataFrame:
    """Listing order of submissions and audit rows: a distributed range sort."""
    return rows.orderBy(F.col(time).desc(), F.col(tie).desc())


def endpoint_state(actions: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Latest endpoint per submission with ACTIVE or INACTIVE from its last registration or deregistration."""
    now = latest(actions.filter(F.col("action").isin("register", "deregister")), key, order)
    return now.withColumn("status", F.when(F.col("action") == "register", "ACTIVE").otherwise("INACTIVE")).drop("action")


def active_endpoints(actions: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return endpoint_state(actions, key, order).filter(F.col("status") == "ACTIVE")


def submission_view(submissions: DataFrame, endpoint: DataFrame, key: str = "submission_id") -> DataFrame:
    e = endpoint.select(key, F.when(F.col("status") == "ACTIVE", F.col("internal_url")).alias("endpoint"))
    return submissions.join(e, key, "left")


def deployment_view(submissions: DataFrame, deployment: DataFrame, endpoint: DataFrame,
                    key: str = "submission_id") -> DataFrame:
    """Latest deployment or PENDING; endpoint detail only with a deployment; URL only while ACTIVE."""
    d = deployment.select(key, F.col("deployment_id"), F.col("status").alias("__d"))
    e = endpoint.select(key, F.col("endpoint_id"), F.col("status").alias("__e"), "internal_url")
    has = F.col("__d").isNotNull()
    return submissions.select(key).join(d, key, "left").join(e, key, "left").select(
        key, F.coalesce("__d", F.lit("PENDING")).alias("status"), "deployment_id",
        F.when(has, F.col("endpoint_id")).alias("endpoint_id"), F.when(has, F.col("__e")).alias("endpoint_status"),
        F.when(has & (F.col("__e") == "ACTIVE"), F.col("internal_url")).alias("endpoint"))


def clean_path(name: Column) -> Column:
    """Lexical path cleaning: drops `.` and empty parts, resolves `..` against what precedes it."""
    rooted = F.startswith(name, F.lit("/"))
    kept = F.aggregate(
        F.split(name, "/"), F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | (p == "."), acc)
        .when((p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
              F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((p == "..") & rooted, acc)
        .otherwise(F.array_append(acc, p)))
    joined = F.array_join(kept, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def unsafe_path(name: Column) -> Column:
    clean = clean_path(name)
    return (
        (F.coalesce(name, F.lit("")) == "") | F.startswith(name, F.lit("/")) | (clean == ".") | (clean == "..")
        | F.startswith(clean, F.lit("../"))
    )


# Fixed file names that mark a source tree of each language.
MANIFESTS = {
    "cpp": ("CMakeLists.txt", "Makefile", "main.cpp", "main.cc", "main.cxx"),
    "rust": ("Cargo.toml",),
    "go": ("go.mod", "main.go"),
}


def audit_archives(entries: DataFrame, max_bytes: int = 512 << 20, max_files: int = 10_000,
                   chunk_rows: int = 1 << 16) -> DataFrame:
    """Verdict per archive from its entry listing; the first failing entry decides."""
    key = "artifact_id"
    regular = F.col("typeflag") == "0"
    clean = clean_path(F.col("name"))
    df = prefix_scan(
        entries, [key], [F.col("pos")], epoch_of(F.col("pos"), chunk_rows),
        {"__files": ("count", F.lit(1)), "__bytes": ("sum", F.when(regular, F.col("size")).otherwise(0))})
    reason = (
        F.when(F.col("__files") > max_files, "archive contains too many files")
        .when(unsafe_path(F.col("name")), F.concat(F.lit('unsafe archive path "'), F.col("name"), F.lit('"')))
        .when(F.col("typeflag").isin("1", "2") & unsafe_path(F.col("linkname")),
              F.concat(F.lit('unsafe link target "'), F.col("linkname"), F.lit('"')))
        .when(F.col("mode").bitwiseAND(0o4000) != 0, F.concat(F.lit("setuid bit is forbidden on "), clean))
        .when(regular & (F.col("__bytes") > max_bytes), "archive exceeds decompressed size cap")
    )
    base = F.element_at(F.split(clean, "/"), -1)
    wanted = lambda names: base.isin(*names) | clean.isin(*names)
    marks = F.lit(False)
    for language, names in MANIFESTS.items():
        marks = marks | ((F.col("language") == language) & wanted(names))
    df = df.withColumn("__reason", reason).withColumn("__mark", regular & marks)
    out = df.groupBy(key, "language").agg(
        F.min_by("__reason", F.when(F.col("__reason").isNotNull(), F.col("pos"))).alias("__r"),
        F.bool_or("__mark").alias("__ok"), F.max("__files").alias("files"), F.max("__bytes").alias("bytes"))
    missing = F.concat(F.lit("source archive missing required "), F.col("language"), F.lit(" manifest or main file"))
    error = F.coalesce("__r", F.when(~F.col("__ok"), missing))
    return out.select(
        key, "language", error.alias("error"),
        F.when(error.isNull(), F.col("files")).alias("files"), F.when(error.isNull(), F.col("bytes")).alias("bytes"))


def check_artifacts(artifacts: DataFrame, max_bytes: int = 100 << 20) -> DataFrame:
    """Size cap, digest (compared without case) and, for binaries, the executable magic."""
    digest = F.sha2("content", 256)
    elf = F.substring("content", 1, 4) == F.lit(b"\x7fELF")
    expected = F.coalesce("expected_sha256", F.lit(""))
    error = (
        F.when(F.octet_length("content") > max_bytes, "artifact exceeds max upload size")
        .when((expected != "") & (F.lower(expected) != digest), "sha256 mismatch")
        .when((F.col("submission_type") == "binary") & ~elf, "binary artifact is not an ELF executable")
    )
    return artifacts.select(
        "artifact_id", "submission_type", digest.alias("sha256"),
        F.octet_length("content").cast("bigint").alias("size"), error.alias("error"))
