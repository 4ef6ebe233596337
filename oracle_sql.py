"""The registered queries once more, as plain SQL for the correctness check.

Written independently of the operators: direct group-bys, range joins and
recursive queries over the whole tables.
"""

from __future__ import annotations

K = "CAST(json_extract_string(props, '$.k') AS INT)"
NS = "(epoch_us(ts) * 1000)"
RUN = "('run-' || CAST((day(ts) - 1) // 10 AS VARCHAR))"
SUB = "('sub-' || lpad(CAST(user_id % 8 AS VARCHAR), 3, '0'))"
KEYS = "run_id, submission_id"
HOUR = 3600 * 10**9


def stamp(ns):
    return f"make_timestamp(CAST(({ns}) // 1000 AS BIGINT))"


def hdr(v):
    """Exponent of the bucket of v."""
    return f"CAST(greatest(floor(log2(greatest({v}, 1))) - 10, 0) AS INT)"


ACKS = f"""acks AS MATERIALIZED (SELECT *, {hdr('us')} AS e FROM (
  SELECT {RUN} AS run_id, {SUB} AS submission_id, event_id AS seq, {NS} AS recv_ts,
    CAST(round(value * 1000) AS BIGINT) AS us, event_type <> 'error' AS accepted,
    (event_type = 'error' AND {K} >= 90) AS is_timeout FROM events))"""
SAMPLES = f"""{ACKS}, cells AS (SELECT {KEYS}, recv_ts // {HOUR} AS epoch, (us >> e) << e AS low,
  ((us >> e) << e) + (1 << e) - 1 AS high, 1 AS n, us AS mx, CAST(accepted AS BIGINT) AS tx,
  CAST(NOT accepted AS BIGINT) AS err, CAST(is_timeout AS BIGINT) AS tmo FROM acks)"""


def quantiles(src, keys, pcts=None, tag=""):
    """CTEs ending in q{tag}: percentiles, max, mean and count per key of (low, high, n, mx) rows."""
    pcts = pcts or {"p50_us": 50.0, "p90_us": 90.0, "p99_us": 99.0}
    cols = ", ".join(
        f"CAST(min(high) FILTER (cum >= greatest(floor(CAST({p} AS DOUBLE) / 100 * tot + 0.5), 1)) AS BIGINT) AS {n}"
        for n, p in pcts.items())
    return f"""b{tag} AS (SELECT {keys}, low, high, CAST(sum(n) AS BIGINT) AS n, max(mx) AS mx FROM {src}
      WHERE n > 0 GROUP BY {keys}, low, high),
    c{tag} AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {keys} ORDER BY low) AS DOUBLE) AS cum,
      CAST(sum(n) OVER (PARTITION BY {keys}) AS DOUBLE) AS tot FROM b{tag}),
    q{tag} AS (SELECT {keys}, {cols}, CAST(max(mx) AS BIGINT) AS max_us,
      CAST(sum(low * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS mean_us, CAST(sum(n) AS BIGINT) AS sample_count
      FROM c{tag} GROUP BY {keys})"""


def window_sql(cte, src, kind, slots, tag="", final=True):
    """Windows from cells that carry `lo`; `src` may replicate cells."""
    rnd = (lambda x: f"round({x}, 9)") if final else (lambda x: x)
    keys = f"{KEYS}, lo"
    return f"""{cte}, {quantiles(src, keys, tag=tag)},
    t{tag} AS (SELECT {keys}, CAST(sum(tx) AS BIGINT) AS transactions, CAST(sum(err) AS BIGINT) AS errors,
      CAST(sum(tmo) AS BIGINT) AS timeouts FROM {src} GROUP BY {keys}),
    win{tag} AS (SELECT {KEYS}, lo, {stamp(f'lo * {HOUR}')} AS window_start,
      {stamp(f'(lo + {slots}) * {HOUR}')} AS window_end, '{kind}' AS window_kind, transactions, errors, timeouts,
      {rnd(f'transactions / CAST({slots * 3600} AS DOUBLE)')} AS tps,
      {rnd('CASE WHEN transactions + errors > 0 THEN CAST(errors AS DOUBLE) / (transactions + errors) ELSE 0.0 END')}
        AS error_rate, coalesce(p50_us, 0) AS p50_us, coalesce(p90_us, 0) AS p90_us, coalesce(p99_us, 0) AS p99_us,
      coalesce(max_us, 0) AS max_us, {rnd('coalesce(mean_us, 0.0)')} AS mean_us,
      coalesce(sample_count, 0) AS sample_count FROM t{tag} LEFT JOIN q{tag} USING ({keys}))"""


WIN_COLS = ("run_id, submission_id, window_start, window_end, window_kind, transactions, errors, timeouts, tps, "
            "error_rate, p50_us, p90_us, p99_us, max_us, mean_us, sample_count")
TUMBLE_CTE = f"{SAMPLES}, tc AS (SELECT *, (epoch // 6) * 6 AS lo FROM cells)"
TUMBLING = window_sql(TUMBLE_CTE, "tc", "tumbling", 6, "w", final=False)
HEAD = f"heads AS (SELECT {KEYS}, max(epoch) AS head FROM cells GROUP BY {KEYS})"


def span(kind, slots, tag="s", final=True, cte=SAMPLES):
    cte = (f"{cte}, {HEAD}, sc{tag} AS (SELECT cells.*, head - {slots - 1} AS lo FROM cells JOIN heads "
           f"USING ({KEYS}) WHERE epoch > head - {slots})")
    return window_sql(cte, f"sc{tag}", kind, slots, tag, final)


# ---- ingest ----
TYPE = ("CASE event_type WHEN 'view' THEN 'order_submitted' WHEN 'purchase' THEN 'order_filled' "
        "WHEN 'signup' THEN CASE WHEN k % 3 = 1 THEN 'connection_closed' ELSE 'connection_opened' END "
        "ELSE CASE WHEN k % 5 = 3 THEN 'order_cancelled' ELSE 'order_ack' END END")
ENVELOPES = f"""src AS (SELECT *, {K} AS k, {NS} AS ns FROM events),
  env AS MATERIALIZED (SELECT event_id AS request_id, CAST(i AS BIGINT) AS item, event_id AS seq, k, ns, user_id, value, event_type,
    CASE WHEN k = 90 THEN '' ELSE {RUN} END AS run_id, CASE WHEN k = 91 THEN '' ELSE {SUB} END AS submission_id,
    'bot-fleet/shard-' || CAST(user_id % 4 AS VARCHAR) AS source,
    CASE WHEN k = 92 THEN '' WHEN k = 94 THEN 'order_teleported' ELSE {TYPE} END AS type,
    CASE k WHEN 90 THEN 'missing run_id' WHEN 91 THEN 'missing submission_id' WHEN 92 THEN 'missing type'
      WHEN 93 THEN 'empty payload' WHEN 94 THEN 'unknown event type "order_teleported"' END AS reason
    FROM src, range(CASE WHEN k = 50 THEN 2 WHEN k IN (47, 49) THEN 0 ELSE 1 END) AS r(i)),
  routed AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'telemetry.deadletter'
      WHEN type LIKE 'order%' THEN 'telemetry.orders' ELSE 'telemetry.connections' END AS topic,
    coalesce(reason, run_id || ':' || submission_id) AS key FROM env)"""
GOOD = f"{ENVELOPES}, good AS (SELECT * FROM routed WHERE reason IS NULL)"

# ---- order book ----
PRICE = "round(100 + (({k} * 7919) % 41 - 20) * CAST(0.01 AS DOUBLE), 2)"


def price(k):
    return PRICE.format(k=k)


BOOK_BASE = f"""ord AS MATERIALIZED (SELECT o_orderkey AS k, 'sub-' || lpad(CAST(o_orderkey // 500 AS VARCHAR), 3, '0') AS sub,
    CASE WHEN o_custkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, o_orderpriority <> '1-URGENT' AS is_limit,
    {price('o_orderkey')} AS price, CAST(floor({price('o_orderkey')} / 0.01::DOUBLE + 0.5) AS BIGINT) AS tick,
    1 + (o_orderkey * 31) % 50 AS qty, o_orderstatus <> 'P' AS accepted, o_orderkey * 64 + 1 AS ack,
    o_orderpriority = '5-LOW' AS cancels FROM orders),
  cxl AS (SELECT sub, k - 3 AS k, k * 64 + 62 AS pos FROM ord WHERE cancels),
  cand AS MATERIALIZED (SELECT o.*, c.pos AS cpos FROM ord o LEFT JOIN cxl c ON c.k = o.k AND c.sub = o.sub
    WHERE is_limit AND accepted),
  fl AS MATERIALIZED (SELECT 'sub-' || lpad(CAST(l_orderkey // 500 AS VARCHAR), 3, '0') AS sub, l_orderkey AS k,
    l_orderkey - l_linenumber AS mk, CASE WHEN l_quantity = 50 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS q, l_orderkey * 64 + 2 + row_number() OVER (
      PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos
    FROM lineitem)"""


def _taken(valid, tag):
    """CTEs from the fills in `valid`: s (resting quantity used before each event of an order) and v (fills whose maker rests)."""
    taken = f"SELECT sub, k AS o, pos, q, false AS mk FROM fl JOIN (SELECT DISTINCT sub, pos FROM {valid}) USING (sub, pos)" if valid else ""
    return f"""e{tag} AS (SELECT sub, mk AS o, pos, q, true AS mk FROM fl {'UNION ALL ' + taken if valid else ''}),
    s{tag} AS (SELECT e.*, c.qty, c.cpos, sum(e.q) OVER (PARTITION BY e.sub, e.o ORDER BY e.pos) - e.q AS used
      FROM e{tag} e JOIN cand c ON c.sub = e.sub AND c.k = e.o WHERE e.pos > c.ack),
    v{tag} AS (SELECT sub, pos FROM s{tag} WHERE mk AND used < qty AND (cpos IS NULL OR pos < cpos))"""


# Rounds go on until the set of valid fills stays the same. Position -1 marks each round, so an empty set is one too.
BOOK = f"""{BOOK_BASE}, {_taken(None, '0')},
  settle(i, sub, pos) AS (SELECT 0, sub, pos FROM v0 UNION ALL SELECT 0, '', -1
    UNION ALL (WITH old AS (SELECT * FROM settle), {_taken('old', 'n')},
      changed AS (SELECT count(*) AS n FROM ((SELECT sub, pos FROM vn EXCEPT SELECT sub, pos FROM old)
        UNION ALL (SELECT sub, pos FROM old WHERE pos >= 0 EXCEPT SELECT sub, pos FROM vn))),
      turn AS (SELECT max(i) + 1 AS i FROM old)
      SELECT turn.i, n.sub, n.pos FROM (SELECT sub, pos FROM vn UNION ALL SELECT '', -1) n, turn, changed WHERE changed.n > 0)),
  settled AS MATERIALIZED (SELECT sub, pos FROM settle WHERE i = (SELECT max(i) FROM settle) AND pos >= 0),
  {_taken('settled', 'z')},
  last AS (SELECT * FROM sz),
  done AS (SELECT sub, o, min(pos) AS pos FROM last WHERE used + q >= qty GROUP BY sub, o),
  spans AS (SELECT sub, max(pos) AS last_pos FROM (SELECT sub, pos FROM fl UNION ALL SELECT sub, ack + (k % 7 = 0)::BIGINT FROM ord WHERE accepted
    UNION ALL SELECT sub, pos FROM cxl) GROUP BY sub),
  life AS MATERIALIZED (SELECT c.sub, c.k, c.ack AS start, c.side, c.price, c.tick, c.qty,
    CASE WHEN d.pos IS NULL AND c.cpos IS NULL THEN NULL ELSE least(coalesce(d.pos, c.cpos), coalesce(c.cpos, d.pos)) END AS fin,
    CASE WHEN d.pos IS NULL AND c.cpos IS NULL THEN 'resting' WHEN c.cpos IS NULL OR d.pos < c.cpos THEN 'filled'
      ELSE 'cancelled' END AS outcome FROM cand c LEFT JOIN done d ON d.sub = c.sub AND d.o = c.k),
  fills AS MATERIALIZED (SELECT f.sub, f.pos, f.k, f.mk, f.q, {price('f.mk')} AS px,
    greatest(0, t.qty - f.q) AS reported, v.pos IS NOT NULL AS rests, m.tick AS m_tick, m.price AS m_price, m.side AS m_side,
    m.start AS m_start, CAST(m.qty - l.used AS BIGINT) AS m_left, t.side AS t_side, t.is_limit AS t_limit, t.price AS t_price,
    CASE WHEN tl.outcome = 'cancelled' AND tl.fin < f.pos THEN NULL ELSE
      CAST(greatest(0, t.qty - coalesce(sum(f.q) OVER (PARTITION BY f.sub, f.k ORDER BY f.pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) END AS t_left
    FROM fl f JOIN ord t ON t.k = f.k LEFT JOIN life tl ON tl.sub = f.sub AND tl.k = f.k
    LEFT JOIN settled v ON v.sub = f.sub AND v.pos = f.pos
    LEFT JOIN life m ON m.sub = f.sub AND m.k = f.mk AND v.pos IS NOT NULL
    LEFT JOIN last l ON l.sub = f.sub AND l.pos = f.pos AND l.mk AND v.pos IS NOT NULL)"""
LIVE_AT = "l.start < {at} AND (l.fin IS NULL OR l.fin >= {at})"
CHECKED = f"""{BOOK},
  best AS (SELECT f.sub, f.pos, max(CASE WHEN l.side = 'buy' THEN l.tick ELSE -l.tick END) AS b,
      arg_min(l.k, l.start) FILTER (l.tick = f.m_tick) AS front
    FROM fills f JOIN life l ON l.sub = f.sub AND l.side = f.m_side AND {LIVE_AT.format(at='f.pos')} WHERE f.rests GROUP BY 1, 2),
  post AS (SELECT f.sub, f.pos, max(l.tick) FILTER (l.side = 'buy') AS bid, min(l.tick) FILTER (l.side = 'sell') AS ask
    FROM fills f JOIN life l ON l.sub = f.sub AND {LIVE_AT.format(at='(f.pos + 1)')}
    WHERE f.rests AND greatest(coalesce(f.t_left, 0) - f.q, 0) = 0 GROUP BY 1, 2),
  checked AS MATERIALIZED (SELECT f.*, CASE WHEN f.m_side = 'buy' THEN b ELSE -b END AS best_tick, front,
    coalesce(bid >= ask, false) AS crossed FROM fills f LEFT JOIN best USING (sub, pos) LEFT JOIN post USING (sub, pos))"""
HALF = "(0.01::DOUBLE / 2)"
FINDINGS = f"""{CHECKED},
  found AS MATERIALIZED (
    SELECT sub, pos, k, 0 AS n, 'book_consistency' AS rule,
      'fill names maker ' || mk || ' that is not resting in the book' AS msg FROM checked WHERE NOT rests
    UNION ALL SELECT sub, pos, k, 1, 'trade_matching', 'aggressor and maker ' || mk || ' are both ' || m_side
      FROM checked WHERE rests AND t_side = m_side
    UNION ALL SELECT sub, pos, k, 2, 'trade_matching',
      printf('fill price %.4f != resting maker price %.4f', px, m_price) FROM checked WHERE rests AND abs(px - m_price) > {HALF}
    UNION ALL SELECT sub, pos, k, 3, 'trade_matching', printf('buy filled at %.4f above its limit %.4f', px, t_price)
      FROM checked WHERE rests AND t_limit AND t_side = 'buy' AND px > t_price + {HALF}
    UNION ALL SELECT sub, pos, k, 4, 'trade_matching', printf('sell filled at %.4f below its limit %.4f', px, t_price)
      FROM checked WHERE rests AND t_limit AND t_side = 'sell' AND px < t_price - {HALF}
    UNION ALL SELECT sub, pos, k, 5, 'price_time_priority', 'filled maker at tick ' || m_tick ||
      ' while a better price (tick ' || best_tick || ') was resting' FROM checked WHERE rests AND best_tick <> m_tick
    UNION ALL SELECT sub, pos, k, 6, 'fifo', 'filled maker ' || mk || ' ahead of earlier order ' || front ||
      ' at the same price' FROM checked WHERE rests AND front <> mk
    UNION ALL SELECT sub, pos, k, 7, 'fill_quantity', 'fill quantity must be positive' FROM checked WHERE rests AND q <= 0
    UNION ALL SELECT sub, pos, k, 8, 'fill_quantity', 'fill qty ' || q || ' exceeds maker remaining ' || m_left
      FROM checked WHERE rests AND q > 0 AND q > m_left
    UNION ALL SELECT sub, pos, k, 9, 'fill_quantity', 'fill qty ' || q || ' exceeds aggressor remaining ' || t_left
      FROM checked WHERE rests AND q > t_left
    UNION ALL SELECT sub, pos, k, 10, 'fill_quantity', 'reported remaining ' || reported || ' != expected ' || (t_left - q)
      FROM checked WHERE rests AND t_left - q >= 0 AND reported <> t_left - q
    UNION ALL SELECT sub, pos, k, 11, 'book_consistency', 'book left crossed after aggressor fully traded'
      FROM checked WHERE rests AND crossed
    UNION ALL SELECT c.sub, c.pos, c.k, 0, 'book_consistency', 'cancel for an order not resting in the book'
      FROM cxl c LEFT JOIN life l ON l.sub = c.sub AND l.k = c.k AND l.fin = c.pos AND l.outcome = 'cancelled' WHERE l.k IS NULL
    UNION ALL SELECT sub, k * 64 + 2, k, 0, 'book_consistency', 'engine accepted the same order_id twice'
      FROM ord WHERE is_limit AND accepted AND k % 7 = 0)"""
VERDICTS = f"""{FINDINGS},
  tot AS (SELECT sub, count(*) AS orders_checked, count(*) FILTER (rests) AS trades_checked FROM fills GROUP BY sub),
  viol AS (SELECT sub, rule, count(*) AS n FROM found GROUP BY sub, rule),
  subs AS (SELECT DISTINCT sub FROM ord),
  verdict AS (SELECT 'run-0' AS run_id, sub AS submission_id, coalesce(orders_checked, 0) AS orders_checked,
    coalesce(trades_checked, 0) AS trades_checked, CAST(coalesce(v, 0) AS BIGINT) AS violations, by_rule,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - coalesce(v, 0) / greatest(coalesce(orders_checked, 0), 1)::DOUBLE)) AS correctness
    FROM subs LEFT JOIN tot USING (sub) LEFT JOIN (SELECT sub, sum(n) AS v,
      '{{' || string_agg('"' || rule || '":' || n, ',' ORDER BY rule) || '}}' AS by_rule FROM viol GROUP BY sub) USING (sub))"""
B_KEYS = "'run-0' AS run_id, sub AS submission_id"


def _rule(name):
    return f"WITH {FINDINGS} SELECT {B_KEYS}, pos, k AS order_id, msg AS message FROM found WHERE rule = '{name}'"


DEPTH = f"""{BOOK}, spent AS (SELECT sub, o, sum(q) AS spent FROM last l WHERE used < qty AND (cpos IS NULL OR pos < cpos) GROUP BY 1, 2),
  depth AS (SELECT {B_KEYS}, side, tick, count(*) AS orders, CAST(sum(qty - coalesce(spent, 0)) AS BIGINT) AS open_quantity
    FROM life LEFT JOIN spent USING (sub) WHERE fin IS NULL AND (spent.o = life.k OR spent.o IS NULL) GROUP BY 1, 2, 3, 4)"""
DEPTH = DEPTH.replace("LEFT JOIN spent USING (sub) WHERE fin IS NULL AND (spent.o = life.k OR spent.o IS NULL)",
                      "LEFT JOIN spent ON spent.sub = life.sub AND spent.o = life.k WHERE fin IS NULL").replace(
    "SELECT 'run-0' AS run_id, sub AS submission_id, side, tick, count(*) AS orders, CAST(sum(qty - coalesce(spent, 0))",
    "SELECT 'run-0' AS run_id, life.sub AS submission_id, side, tick, count(*) AS orders, CAST(sum(qty - coalesce(spent, 0))")

# ---- scores ----


def score_sql(src, correctness, cov):
    """Four components and the composite of the unrounded ones."""
    return f"""SELECT *, floor(lat * 100 + 0.5) / 100 AS latency_score, floor(thr * 100 + 0.5) / 100 AS throughput_score,
      floor(cor * 100 + 0.5) / 100 AS correctness_score, floor(stb * 100 + 0.5) / 100 AS stability_score,
      floor((0.35::DOUBLE * lat + 0.30::DOUBLE * thr + 0.25::DOUBLE * cor + 0.10::DOUBLE * stb)
        / (0.35::DOUBLE + 0.30::DOUBLE + 0.25::DOUBLE + 0.10::DOUBLE) * (0.5 + 0.5 * cor / 100) * 100 + 0.5) / 100 AS composite
    FROM (SELECT *, CASE WHEN p99_us <= 0 THEN 0.0 ELSE 100 * greatest(0.0::DOUBLE, least(1.0::DOUBLE,
        (6 - log10(greatest(100.0::DOUBLE, least(1000000.0::DOUBLE, p99_us::DOUBLE)))) / 4)) END AS lat,
      100 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, tps / 0.001::DOUBLE)) AS thr,
      100 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, {correctness})) AS cor,
      100 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, {cov})) - error_rate)) AS stb FROM {src})"""


STABILITY = f"""stab AS (SELECT {KEYS}, count(*) AS windows, avg(tps) AS mean_tps,
  CASE WHEN count(*) >= 2 AND avg(tps) > 0 THEN stddev_samp(tps) / avg(tps) ELSE 0.0 END AS tps_cov FROM winw GROUP BY {KEYS})"""


def scores(with_verdicts=True):
    cte = span("sliding", 6, "s", final=False, cte=TUMBLING)
    v = f", {VERDICTS}" if with_verdicts else ""
    join = f"LEFT JOIN verdict USING ({KEYS})" if with_verdicts else ""
    cor = "coalesce(correctness, 1.0)" if with_verdicts else "1.0::DOUBLE"
    return f"""{cte}, {STABILITY}{v}, sin AS (SELECT wins.*, tps_cov{', correctness' if with_verdicts else ''}
      FROM wins LEFT JOIN stab USING ({KEYS}) {join}), sco AS ({score_sql('sin', cor, 'coalesce(tps_cov, 0.0)')})"""


SANDBOX = f"""sbx AS (SELECT {RUN} AS run_id, {SUB} AS submission_id, {NS} AS ns, event_id AS seq,
  CASE WHEN {K} >= 95 THEN 'UNHEALTHY' WHEN {K} >= 85 THEN 'DEGRADED' WHEN {K} < 5 THEN '' ELSE 'READY' END AS health FROM events)"""
NAMES = """names AS (SELECT r AS run_id, 'sub-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS submission_id,
  CASE WHEN n_regionkey % 2 = 0 THEN n_name ELSE '' END AS nm FROM nation, unnest(['run-0', 'run-1', 'run-2', 'run-3']) AS t(r))"""


def board(with_verdicts=True):
    return f"""{scores(with_verdicts)}, {SANDBOX}, {NAMES},
      firsts AS (SELECT {KEYS}, epoch_us(min(window_end)) * 1000 AS f FROM winw GROUP BY {KEYS}),
      hl AS (SELECT {KEYS}, arg_max(health, (ns, seq)) AS health FROM sbx JOIN firsts USING ({KEYS})
        WHERE health <> '' AND ns > f GROUP BY {KEYS}),
      brd AS (SELECT sco.*, coalesce(hl.health, 'READY') AS health,
        coalesce(nullif(nm, ''), left(submission_id, 8)) AS display_name,
        row_number() OVER (PARTITION BY run_id ORDER BY composite DESC, p99_us, submission_id) AS rank
        FROM sco LEFT JOIN hl USING ({KEYS}) LEFT JOIN names USING ({KEYS}))"""


BOARD_COLS = ("rank, display_name, health, run_id, submission_id, latency_score, throughput_score, correctness_score, "
              "stability_score, composite, p99_us")
ROLLING = f"""roll AS (SELECT {KEYS}, max(window_end) AS updated_at, CAST(sum(transactions) AS BIGINT) AS total_transactions,
  CAST(sum(errors) AS BIGINT) AS total_errors, max(tps) AS peak_tps, arg_max(tps, window_start) AS current_tps,
  arg_max(p50_us, window_start) AS p50_us, arg_max(p90_us, window_start) AS p90_us, arg_max(p99_us, window_start) AS p99_us,
  arg_max(error_rate, window_start) AS error_rate, coalesce(stddev_samp(tps), 0.0) AS tps_stddev,
  CASE WHEN avg(tps) = 0 THEN 0.0 ELSE coalesce(stddev_samp(tps), 0.0) / avg(tps) END AS tps_cov FROM {{src}} GROUP BY {KEYS})"""
LAST20 = (f"l20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY window_start DESC) AS rn "
          "FROM winw) WHERE rn <= 20)")

# ---- shard snapshots ----
SNAPS = f"""sn AS MATERIALIZED (SELECT {RUN} AS run_id, {SUB} AS submission_id, event_id % 4 AS shard, {NS} // {6 * HOUR} AS w,
  CAST(round(value) AS BIGINT) AS us, event_type = 'error' AS er, (event_type = 'error' AND {K} >= 90) AS tm FROM events)"""


def shard(keys):
    return f"""WITH {SNAPS},
      raw AS (SELECT {KEYS}, w, us AS low, us AS high, 1 AS n, us AS mx FROM sn), {quantiles('raw', keys)},
      snap AS (SELECT {KEYS}, w, shard, count(*) FILTER (NOT er) AS tx, count(*) FILTER (er) AS er, count(*) FILTER (tm) AS tm,
        CAST(count(*) * 60 AS DOUBLE) AS secs FROM sn GROUP BY ALL),
      per AS (SELECT {keys}, shard, sum(tx) AS tx, sum(er) AS er, sum(tm) AS tm, max(secs) AS mxs, sum(secs) AS sms FROM snap GROUP BY ALL),
      tot AS (SELECT {keys}, count(*) AS shards, CAST(sum(tx) AS BIGINT) AS transactions, CAST(sum(er) AS BIGINT) AS errors,
        CAST(sum(tm) AS BIGINT) AS timeouts, max(mxs) AS max_window_seconds, max(sms) AS shard_seconds FROM per GROUP BY {keys})
      SELECT {KEYS}{f', w * {6 * HOUR} AS window_start_ts' if ', w' in keys else ''}, shards, transactions, errors, timeouts,
        max_window_seconds, shard_seconds, round(transactions / max_window_seconds, 9) AS tps,
        round(transactions / shard_seconds, 9) AS tps_shard_seconds, p50_us, p90_us, p99_us, max_us, sample_count,
        round(mean_us, 9) AS mean_us FROM tot JOIN q USING ({keys})"""


# ---- lifecycle ----
STEPS = ("['submission.created','upload.succeeded','validation.started','validation.passed','build.started',"
         "'build.succeeded','scan.started','scan.passed','deployment.started','deployment.pod_ready','health.ready',"
         "'health.degraded','health.recovered','teardown.completed']")
LIFE = f"""st AS (SELECT *, ({STEPS})[{K} % 14 + 1] AS step, {K} AS k FROM events),
  ev AS MATERIALIZED (SELECT 'u-' || CAST(user_id % 16 AS VARCHAR) AS submission_id, event_id AS pos, ts AS occurred_at,
    CASE WHEN event_type = 'error' AND k >= 95 THEN CASE step WHEN 'upload.succeeded' THEN 'upload.failed'
      WHEN 'validation.passed' THEN 'validation.failed' WHEN 'build.succeeded' THEN 'build.failed'
      WHEN 'scan.passed' THEN 'scan.failed' WHEN 'deployment.pod_ready' THEN 'deployment.failed'
      WHEN 'health.ready' THEN 'health.failed' ELSE step END ELSE step END AS event,
    'svc-' || event_type AS actor, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS i FROM st),
  tr(f, e, t) AS (VALUES ('', 'submission.created', 'CREATED'), ('CREATED', 'upload.succeeded', 'UPLOADED'),
    ('CREATED', 'upload.failed', 'UPLOAD_FAILED'), ('UPLOADED', 'validation.started', 'VALIDATING'),
    ('VALIDATING', 'validation.passed', 'VALIDATED'), ('VALIDATING', 'validation.failed', 'VALIDATION_FAILED'),
    ('VALIDATED', 'build.started', 'BUILDING'), ('BUILDING', 'build.succeeded', 'BUILT'), ('BUILDING', 'build.failed', 'BUILD_FAILED'),
    ('BUILT', 'scan.started', 'SCANNING'), ('SCANNING', 'scan.passed', 'SCANNED'), ('SCANNING', 'scan.failed', 'SCAN_FAILED'),
    ('SCANNED', 'deployment.started', 'DEPLOYING'), ('DEPLOYING', 'deployment.pod_ready', 'HEALTH_CHECK'),
    ('DEPLOYING', 'deployment.failed', 'DEPLOY_FAILED'), ('HEALTH_CHECK', 'health.ready', 'READY'),
    ('HEALTH_CHECK', 'health.failed', 'HEALTH_FAILED'), ('READY', 'health.degraded', 'DEGRADED'),
    ('READY', 'teardown.completed', 'TERMINATED'), ('DEGRADED', 'health.recovered', 'READY'),
    ('DEGRADED', 'teardown.completed', 'TERMINATED')),
  run AS (SELECT submission_id, CAST(0 AS BIGINT) AS i, '' AS prev, '' AS st, false AS ok FROM ev GROUP BY submission_id
    UNION ALL SELECT r.submission_id, e.i, r.st, coalesce(tr.t, r.st), tr.t IS NOT NULL
    FROM run r JOIN ev e ON e.submission_id = r.submission_id AND e.i = r.i + 1 LEFT JOIN tr ON tr.f = r.st AND tr.e = e.event)"""
TERMINAL = ("('TERMINATED', 'UPLOAD_FAILED', 'VALIDATION_FAILED', 'BUILD_FAILED', 'SCAN_FAILED', 'DEPLOY_FAILED', 'HEALTH_FAILED')")
ENDPOINT = """ep AS (SELECT o_custkey AS submission_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS endpoint_id,
    max(o_orderdate) AS created_at, 'http://svc-' || CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS VARCHAR) AS internal_url,
    CASE WHEN arg_max(o_orderpriority, (o_orderdate, o_orderkey)) = '5-LOW' THEN 'INACTIVE' ELSE 'ACTIVE' END AS status
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY o_custkey)"""
DEPLOY = """dp AS (SELECT o_custkey AS submission_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS deployment_id,
    max(o_orderdate) AS created_at, CASE arg_max(o_orderstatus, (o_orderdate, o_orderkey)) WHEN 'F' THEN 'RUNNING'
      WHEN 'O' THEN 'STARTING' ELSE 'FAILED' END AS status FROM orders GROUP BY o_custkey)"""
SUBS = """sb AS (SELECT c_custkey AS submission_id, CASE c_mktsegment WHEN 'MACHINERY' THEN 'READY' WHEN 'BUILDING' THEN 'BUILD_FAILED'
    WHEN 'FURNITURE' THEN 'TERMINATED' ELSE 'BUILDING' END AS status FROM customer)"""
MIX = """SELECT {k}, count(*) AS orders, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END), 9) AS limit_share,
  round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0 END), 9) AS market_share,
  round(avg(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1.0::DOUBLE ELSE 0 END), 9) AS cancel_share FROM orders GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    q = {}
    # ingest
    q["envelope_triage"] = (f"WITH {ENVELOPES} SELECT request_id, item, seq, source, type, reason, topic, key, "
                            "CASE WHEN reason IS NULL THEN ns END AS ingest_ts FROM routed")
    q["rejected_bodies"] = (f"SELECT event_id AS request_id, CASE {K} WHEN 47 THEN 'empty body' ELSE 'invalid envelope JSON' END "
                            f"AS reason FROM events WHERE {K} IN (47, 49)")
    q["dead_letters"] = f"WITH {ENVELOPES} SELECT request_id, item, key, seq FROM routed WHERE reason IS NOT NULL"
    q["topic_counts"] = f"WITH {ENVELOPES} SELECT topic, count(*) AS events FROM routed GROUP BY topic"
    q["batch_accept_reject"] = (f"WITH {ENVELOPES} SELECT request_id, count(*) FILTER (reason IS NULL) AS accepted, "
                                "count(*) FILTER (reason IS NOT NULL) AS rejected FROM routed GROUP BY request_id")
    q["ingest_rates"] = (f"WITH {ENVELOPES} SELECT {stamp(f'(ns // {HOUR}) * {HOUR}')} AS window_start, "
                         "CASE WHEN reason IS NULL THEN type END AS type, count(*) AS events, count(*) / 3600.0::DOUBLE AS events_per_s "
                         "FROM routed GROUP BY 1, 2")
    at = "'{\"bot_id\":' || user_id || ',\"order_id\":' || event_id"
    lat = "CAST(round(value * 1000) AS BIGINT)"
    q["ingest_bytes"] = f"""WITH src AS (SELECT *, {K} AS k, {NS} AS ns FROM events),
      pay AS (SELECT *, CASE event_type
        WHEN 'view' THEN {at} || ',"side":"' || CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END || '","kind":"limit","price":' || value
          || ',"quantity":' || (k + 1) || ',"send_ts":' || ns || ',"target_order_id":0}}'
        WHEN 'purchase' THEN {at} || ',"maker_order_id":' || (event_id - 1) || ',"fill_price":' || value || ',"fill_quantity":' || (k + 1)
          || ',"remaining_quantity":0,"trade_id":' || event_id || ',"recv_ts":' || ns || '}}'
        WHEN 'signup' THEN '{{"connection_id":' || event_id || ',"bot_id":' || user_id || CASE WHEN k % 3 = 1
          THEN ',"close_reason":"eof","closed_ts":' || ns || ',"bytes_sent":' || (k * 10) || ',"bytes_recv":' || {lat} || '}}'
          ELSE ',"remote_addr":"10.0.0.1","opened_ts":' || ns || ',"handshake_us":' || {lat} || '}}' END
        ELSE {at} || CASE WHEN k % 5 = 3 THEN ',"cancelled_quantity":' || (k + 1) || ',"reason":"user","recv_ts":' || ns || '}}' ELSE ',"accepted":' || CASE WHEN event_type <> 'error' THEN 'true' ELSE 'false' END || ',"recv_ts":' || ns
          || ',"ack_latency_us":' || {lat} || '}}' END END AS payload FROM src),
      env AS (SELECT *, '{{"run_id":"' || CASE WHEN k = 90 THEN '' ELSE {RUN} END || '","submission_id":"' || CASE WHEN k = 91 THEN ''
          ELSE {SUB} END || '","seq":' || event_id || ',"emit_ts":' || ns || ',"source":"bot-fleet/shard-' || (user_id % 4) || '","type":"'
          || CASE WHEN k = 92 THEN '' WHEN k = 94 THEN 'order_teleported' ELSE {TYPE} END || '"'
          || CASE WHEN k = 93 THEN '' ELSE ',"payload":' || payload END || '}}' AS t FROM pay),
      len AS (SELECT ns, CASE WHEN k = 49 THEN 8 WHEN k = 47 THEN 2 WHEN k = 50 THEN 2 * strlen(t) + 3 WHEN k % 2 = 1 THEN strlen(t) + 4
          ELSE strlen(t) + 1 END AS n FROM env)
      SELECT {stamp(f'(ns // {HOUR}) * {HOUR}')} AS window_start, CAST(sum(n) AS BIGINT) AS bytes, round(sum(n) / 3600.0::DOUBLE, 6) AS bytes_per_s
      FROM len GROUP BY 1"""
    q["key_split"] = (f"WITH {ENVELOPES} SELECT key, split_part(key, ':', 1) AS run_part, "
                      "CASE WHEN contains(key, ':') THEN split_part(key, ':', 2) ELSE '' END AS submission_part, count(*) AS events "
                      "FROM routed GROUP BY 1, 2, 3")
    q["payload_acks"] = (f"WITH {GOOD} SELECT {KEYS}, seq, user_id AS bot_id, seq AS order_id, event_type <> 'error' AS accepted, "
                         "ns AS recv_ts, CAST(round(value * 1000) AS BIGINT) AS ack_latency_us FROM good WHERE type = 'order_ack'")
    q["payload_orders"] = f"""WITH {GOOD} SELECT {KEYS}, seq AS pos, type, seq AS order_id,
      CASE WHEN type = 'order_submitted' THEN CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END END AS side,
      CASE WHEN type = 'order_submitted' THEN 'limit' END AS kind, CASE WHEN type = 'order_submitted' THEN value END AS price,
      CASE WHEN type = 'order_submitted' THEN CAST(k + 1 AS BIGINT) END AS quantity,
      CASE WHEN type = 'order_ack' THEN event_type <> 'error' END AS accepted,
      CASE WHEN type = 'order_filled' THEN seq - 1 END AS maker_order_id, CASE WHEN type = 'order_filled' THEN value END AS fill_price,
      CASE WHEN type = 'order_filled' THEN CAST(k + 1 AS BIGINT) END AS fill_quantity,
      CASE WHEN type = 'order_filled' THEN CAST(0 AS BIGINT) END AS remaining_quantity FROM good WHERE type LIKE 'order%'"""
    q["payload_connections"] = (f"WITH {GOOD} SELECT {KEYS}, seq, seq AS connection_id, user_id AS bot_id, '10.0.0.1' AS remote_addr, "
                                "ns AS opened_ts, CAST(round(value * 1000) AS BIGINT) AS handshake_us FROM good WHERE type = 'connection_opened'")
    q["payload_closings"] = (f"WITH {GOOD} SELECT {KEYS}, seq, seq AS connection_id, user_id AS bot_id, 'eof' AS close_reason, ns AS closed_ts, "
                             "CAST(k * 10 AS BIGINT) AS bytes_sent, CAST(round(value * 1000) AS BIGINT) AS bytes_recv FROM good WHERE type = 'connection_closed'")
    q["native_bot_metrics"] = f"""SELECT {RUN} AS run_id, {SUB} AS submission_id, event_id AS seq,
      CASE WHEN {K} < 50 THEN 'bot-fleet' ELSE 'fleet-a' END AS source, user_id % 4 AS shard_id, user_id AS transactions,
      CAST({K} AS BIGINT) AS errors, CAST(1 AS BIGINT) AS timeouts, 5.0::DOUBLE AS window_seconds, CAST(0 AS BIGINT) AS p50_us,
      CAST(round(value) AS BIGINT) AS p99_us, CAST(0 AS BIGINT) AS window_start_ts, {NS} AS window_end_ts FROM events"""
    q["native_sandbox"] = f"""SELECT {RUN} AS run_id, {SUB} AS submission_id, event_id AS seq,
      CASE WHEN {K} < 50 THEN 'sandbox-runner' ELSE 'runner-a' END AS source, 'sandbox_metrics' AS type,
      'pod-' || CAST(user_id AS VARCHAR) AS pod_name, user_id * 1000 AS memory_bytes, {K} >= 95 AS oom_killed FROM events"""
    q["dedupe_events"] = f"WITH {ENVELOPES} SELECT DISTINCT run_id, submission_id, seq, type, source FROM routed"
    q["seq_gaps"] = f"""WITH s AS (SELECT {RUN} AS run_id, 'bot-fleet/shard-' || CAST(user_id % 4 AS VARCHAR) AS source,
        event_id // 4 AS seq FROM events),
      l AS (SELECT *, lag(seq) OVER (PARTITION BY run_id, source ORDER BY seq) AS after_seq FROM s)
      SELECT run_id, source, after_seq, seq AS next_seq, seq - after_seq - 1 AS missing FROM l WHERE seq - after_seq > 1"""
    # windows
    q["ack_outcomes"] = (f"WITH {ACKS} SELECT {KEYS}, recv_ts AS ts_ns, CAST(e * 1024 + (us >> e) AS INT) AS bucket, CAST(1 AS BIGINT) AS n, "
                         "us AS max_us, CAST(accepted AS BIGINT) AS transactions, CAST(NOT accepted AS BIGINT) AS errors, "
                         "CAST(is_timeout AS BIGINT) AS timeouts FROM acks")
    q["slot_rollup"] = (f"WITH {SAMPLES} SELECT {KEYS}, epoch, CAST(sum(tx) AS BIGINT) AS transactions, CAST(sum(err) AS BIGINT) AS errors, "
                        "CAST(sum(tmo) AS BIGINT) AS timeouts, count(*) AS sample_count, max(mx) AS max_us FROM cells GROUP BY ALL")
    q["tumbling_windows"] = f"WITH {window_sql(TUMBLE_CTE, 'tc', 'tumbling', 6)} SELECT {WIN_COLS} FROM win"
    slide = f"{SAMPLES}, sl AS (SELECT cells.*, epoch - o AS lo FROM cells, range(6) AS r(o))"
    q["sliding_windows"] = f"WITH {window_sql(slide, 'sl', 'sliding', 6)} SELECT {WIN_COLS} FROM win"
    q["live_windows"] = f"WITH {span('sliding', 6)} SELECT {WIN_COLS} FROM wins"
    q["rolling_horizon"] = f"WITH {span('rolling', 60)} SELECT {WIN_COLS} FROM wins"
    q["late_dropped"] = f"""WITH l AS (SELECT {RUN} AS run_id, {SUB} AS submission_id, event_id AS seq,
        ({NS} - CAST({K} AS BIGINT) * {HOUR}) // {HOUR} AS epoch FROM events),
      h AS (SELECT *, max(epoch) OVER (PARTITION BY {KEYS} ORDER BY seq) AS head FROM l)
      SELECT {KEYS}, seq, epoch, head, epoch <= head - 60 AS is_late FROM h"""
    both = f"""{SAMPLES}, {SNAPS}, tc AS (SELECT *, (epoch // 6) * 6 AS lo FROM (SELECT * FROM cells UNION ALL
      SELECT {KEYS}, w * 6 + 5, us, us, 1, us, CAST(NOT er AS BIGINT), CAST(er AS BIGINT), CAST(tm AS BIGINT) FROM sn))"""
    q["preaggregated_windows"] = f"WITH {window_sql(both, 'tc', 'tumbling', 6)} SELECT {WIN_COLS} FROM win"
    topped = both.replace("us, us, 1, us, CAST(NOT er AS BIGINT), CAST(er AS BIGINT)", "us, us, 0, us, 0, 0")
    q["topped_up_windows"] = (f"WITH {window_sql(topped, 'tc', 'tumbling', 6)} SELECT {KEYS}, window_start, transactions, errors, "
                              "timeouts, p99_us, sample_count FROM win")
    q["rolling_stats"] = (f"WITH {TUMBLING}, {ROLLING.format(src='winw')} SELECT * REPLACE (round(peak_tps, 9) AS peak_tps, "
                          "round(current_tps, 9) AS current_tps, round(error_rate, 9) AS error_rate, round(tps_stddev, 9) AS tps_stddev, "
                          "round(tps_cov, 9) AS tps_cov) FROM roll")
    q["tps_stability"] = f"WITH {TUMBLING}, {STABILITY} SELECT * REPLACE (round(mean_tps, 9) AS mean_tps, round(tps_cov, 9) AS tps_cov) FROM stab"
    hist_cols = WIN_COLS.replace("window_kind, ", "").replace(" tps,", " round(tps, 9) AS tps,").replace(
        "error_rate,", "round(error_rate, 9) AS error_rate,").replace("mean_us,", "round(mean_us, 9) AS mean_us,")
    q["window_history"] = f"WITH {TUMBLING}, {LAST20} SELECT {hist_cols} FROM l20"
    # histograms
    q["hdr_buckets"] = (f"WITH {ACKS} SELECT {KEYS}, CAST(e * 1024 + (us >> e) AS INT) AS bucket, (us >> e) << e AS low_us, "
                        "((us >> e) << e) + (1 << e) - 1 AS high_us, count(*) AS n, max(us) AS max_us FROM acks GROUP BY ALL")
    ps = {"p0_us": 0.0, "p50_us": 50.0, "p90_us": 90.0, "p99_us": 99.0, "p999_us": 99.9, "p100_us": 100.0}
    q["hdr_percentiles"] = f"WITH {SAMPLES}, {quantiles('cells', KEYS, ps)} SELECT * REPLACE (round(mean_us, 9) AS mean_us) FROM q"
    q["hdr_merge"] = f"WITH {SAMPLES}, {quantiles('cells', 'run_id')} SELECT * REPLACE (round(mean_us, 9) AS mean_us) FROM q"
    q["hdr_coordinated_omission"] = f"""WITH {ACKS}, v AS (SELECT {KEYS}, us - i * 50000 AS us FROM acks,
        range(CASE WHEN us > 50000 THEN greatest(us // 50000, 1) ELSE 1 END) AS r(i)),
      f AS (SELECT {KEYS}, (us >> e) << e AS low, ((us >> e) << e) + (1 << e) - 1 AS high, 1 AS n, us AS mx
        FROM (SELECT *, {hdr('us')} AS e FROM v)), {quantiles('f', KEYS)} SELECT * REPLACE (round(mean_us, 9) AS mean_us) FROM q"""
    q["hdr_import"] = f"WITH {SNAPS} SELECT {KEYS}, CAST(us AS INT) AS bucket, count(*) AS n, us AS max_us FROM sn GROUP BY ALL"
    # fleet
    q["shard_merge"] = shard(f"{KEYS}, w")
    q["shard_merge_cumulative"] = shard(KEYS)
    q["resource_summary"] = """SELECT l_returnflag || l_linestatus AS scale, round(avg(l_quantity), 1) AS cpu_avg_pct,
      round(max(l_quantity), 1) AS cpu_peak_pct, CAST(floor(max(l_extendedprice)) AS BIGINT) AS rss_peak_kb, max(l_suppkey) AS fds_peak,
      CAST(max(l_linenumber) AS BIGINT) AS conns_peak FROM lineitem GROUP BY 1"""
    q["order_mix"] = MIX.format(k="o_custkey AS bot_id")
    q["persona_mix"] = MIX.format(k="o_orderpriority AS persona")
    q["persona_share"] = ("SELECT c_mktsegment AS persona, count(*) AS bots, round(count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE), 9) "
                          "AS share FROM customer GROUP BY 1")
    # order book
    q["order_lifetimes"] = (f"WITH {BOOK} SELECT {B_KEYS}, k AS order_id, start, fin AS end, side, price, tick, qty AS quantity, outcome FROM life")
    q["fills_vs_makers"] = (f"WITH {BOOK} SELECT {B_KEYS}, pos, k AS order_id, mk AS maker_order_id, rests AS maker_rests, m_left AS maker_left, "
                            "m_start AS maker_start, m_side AS maker_side, m_tick AS maker_tick, t_side AS taker_side, t_limit AS taker_limit, "
                            "t_price AS taker_price, t_left AS taker_left FROM fills")
    q["phantom_makers"] = f"WITH {BOOK} SELECT {B_KEYS}, pos, k AS order_id, mk AS maker_order_id FROM fills WHERE NOT rests"
    for short, name in {"trade_matching": "trade_matching", "fill_quantity": "fill_quantity", "price_priority": "price_time_priority",
                        "fifo": "fifo", "book_consistency": "book_consistency"}.items():
        q[f"rule_{short}"] = _rule(name)
    q["best_price_before_fill"] = (f"WITH {CHECKED} SELECT {B_KEYS}, pos, m_tick AS maker_tick, best_tick, front AS front_id, "
                                   "crossed AS crossed_after FROM checked WHERE rests")
    q["book_depth"] = f"WITH {DEPTH} SELECT * FROM depth"
    q["book_depth_at"] = f"""WITH {BOOK}, named AS (SELECT sub, pos FROM fl UNION ALL SELECT sub, ack - 1 FROM ord UNION ALL SELECT sub, ack + (k % 7 = 0)::BIGINT FROM ord WHERE accepted
        UNION ALL SELECT sub, pos FROM cxl),
      marks AS (SELECT sub, unnest(range((min(pos) + 999) // 1000, (max(pos) + 999) // 1000 + 1)) * 1000 AS at FROM named GROUP BY sub),
      alive AS MATERIALIZED (SELECT m.sub, m.at, l.k, l.side, l.tick, l.qty FROM marks m JOIN life l ON l.sub = m.sub AND l.start <= m.at AND (l.fin IS NULL OR l.fin > m.at)),
      spent AS (SELECT a.sub, a.at, a.k, sum(l.q) AS q FROM alive a JOIN last l ON l.sub = a.sub AND l.o = a.k AND l.pos <= a.at GROUP BY ALL)
      SELECT 'run-0' AS run_id, a.sub AS submission_id, a.at, side, tick, count(*) AS orders, CAST(sum(qty - coalesce(s.q, 0)) AS BIGINT) AS open_quantity
      FROM alive a LEFT JOIN spent s ON s.sub = a.sub AND s.at = a.at AND s.k = a.k GROUP BY ALL"""
    q["top_of_book"] = f"""WITH {DEPTH}, t AS (SELECT {KEYS}, max(tick) FILTER (side = 'buy') AS best_bid,
        arg_max(open_quantity, tick) FILTER (side = 'buy') AS bid_quantity, min(tick) FILTER (side = 'sell') AS best_ask,
        arg_min(open_quantity, tick) FILTER (side = 'sell') AS ask_quantity FROM depth GROUP BY {KEYS})
      SELECT *, coalesce(best_bid >= best_ask, false) AS crossed FROM t"""
    q["violations_by_rule"] = f"WITH {FINDINGS} SELECT {B_KEYS}, rule, count(*) AS violations FROM found GROUP BY sub, rule"
    q["recent_findings"] = (f"WITH {FINDINGS} SELECT {B_KEYS}, pos, rule, k AS order_id, msg AS message FROM (SELECT *, row_number() OVER "
                            "(PARTITION BY sub ORDER BY pos DESC, n DESC) AS rn FROM found) WHERE rn <= 25")
    q["correctness_score"] = (f"WITH {VERDICTS} SELECT {KEYS}, orders_checked, trades_checked, violations, round(correctness, 9) AS "
                              "correctness_score FROM verdict")
    q["replay_verdict"] = (f"WITH {VERDICTS} SELECT {KEYS}, orders_checked, trades_checked, violations, coalesce(by_rule, '{{}}') AS "
                           "violations_by_rule, round(correctness, 9) AS correctness_score, least(violations, 25) AS findings FROM verdict")
    # scores and boards
    q["score_components"] = f"WITH {scores()} SELECT {KEYS}, latency_score, throughput_score, correctness_score, stability_score FROM sco"
    q["composite_score"] = f"WITH {scores()} SELECT {KEYS}, composite, round(tps, 9) AS tps, p50_us, p99_us, window_end AS computed_at FROM sco"
    q["leaderboard"] = f"WITH {board()} SELECT {BOARD_COLS} FROM brd"
    q["leaderboard_latency_only"] = f"WITH {board(False)} SELECT {BOARD_COLS} FROM brd"
    q["leaderboard_filtered"] = (f"WITH {board()} SELECT rank, {KEYS}, display_name, health, composite FROM brd WHERE correctness_score >= 50 "
                                 "AND upper(health) = 'READY' AND (contains(lower(display_name), 'nation') OR contains(lower(submission_id), 'nation'))")
    q["leaderboard_top_n"] = f"WITH {board()} SELECT rank, {KEYS}, composite FROM brd WHERE run_id = 'run-0' ORDER BY rank LIMIT 5"
    q["run_summaries"] = (f"WITH {scores()} SELECT run_id, count(*) AS contestants, max(window_end) AS last_update FROM sco GROUP BY run_id")
    q["latest_run_board"] = (f"WITH {scores()} SELECT row_number() OVER (ORDER BY composite DESC, p99_us, submission_id) AS rank, {KEYS}, "
                             "composite, p99_us FROM sco WHERE run_id = (SELECT arg_max(run_id, (window_end, run_id)) FROM sco)")
    q["rank_moves"] = f"""WITH {TUMBLING}, ups AS (SELECT {KEYS}, CAST(lo * 3600 AS BIGINT) AS update_no, composite, p99_us FROM
        ({score_sql('winw', '1.0::DOUBLE', '0.0::DOUBLE')})),
      held AS (SELECT m.run_id, m.submission_id, u.update_no,
          last_value(s.composite IGNORE NULLS) OVER (PARTITION BY m.run_id, m.submission_id ORDER BY u.update_no) AS composite,
          last_value(s.p99_us IGNORE NULLS) OVER (PARTITION BY m.run_id, m.submission_id ORDER BY u.update_no) AS p99_us
        FROM (SELECT {KEYS}, min(update_no) AS f FROM ups GROUP BY {KEYS}) m
        JOIN (SELECT DISTINCT run_id, update_no FROM ups) u ON u.run_id = m.run_id AND u.update_no >= m.f
        LEFT JOIN ups s ON s.run_id = m.run_id AND s.submission_id = m.submission_id AND s.update_no = u.update_no),
      rk AS (SELECT *, row_number() OVER (PARTITION BY run_id, update_no ORDER BY composite DESC, p99_us, submission_id) AS rank FROM held),
      pr AS (SELECT *, coalesce(lag(rank) OVER (PARTITION BY {KEYS} ORDER BY update_no), 0) AS prev_rank FROM rk)
      SELECT *, CASE WHEN prev_rank = 0 THEN 0 ELSE prev_rank - rank END AS rank_delta FROM pr"""
    q["board_health"] = f"""WITH {SANDBOX} SELECT {KEYS}, coalesce(arg_max(health, (ns, seq)) FILTER (health <> ''), 'READY') AS health
      FROM sbx GROUP BY {KEYS}"""
    q["display_names"] = (f"WITH {ACKS}, {NAMES} SELECT {KEYS}, coalesce(nullif(nm, ''), left(submission_id, 8)) AS display_name "
                          f"FROM (SELECT DISTINCT {KEYS} FROM acks) LEFT JOIN names USING ({KEYS})")
    q["contestant_detail"] = f"""WITH {scores()}, {ROLLING.format(src='winw')}, {LAST20},
        h AS (SELECT {KEYS}, count(*) AS windows, min(window_start) AS first_window, arg_max(p99_us, window_start) AS last_p99_us
          FROM l20 GROUP BY {KEYS})
      SELECT sco.run_id, sco.submission_id, composite, total_transactions, violations, windows, first_window, last_p99_us
      FROM sco LEFT JOIN roll USING ({KEYS}) LEFT JOIN verdict USING ({KEYS}) LEFT JOIN h USING ({KEYS})"""
    q["sparkline"] = f"""WITH {TUMBLING}, {LAST20}, s AS (SELECT {KEYS}, window_start, CAST(errors AS DOUBLE) AS value,
        count(*) OVER w AS n, row_number() OVER (PARTITION BY {KEYS} ORDER BY window_start) - 1 AS i,
        greatest(max(errors) OVER w, 1) AS hi, least(min(errors) OVER w, 0) AS lo2 FROM l20 WINDOW w AS (PARTITION BY {KEYS}))
      SELECT {KEYS}, window_start, value, round(i * CASE WHEN n > 1 THEN 280.0::DOUBLE / (n - 1) ELSE 280 END, 1) AS x,
        round(56.0::DOUBLE - (value - lo2) / CAST(hi - lo2 AS DOUBLE) * 52.0::DOUBLE - 2, 1) AS y FROM s"""
    half_up = lambda x, d: f"printf('%.{d}f', {x} + CASE WHEN ({x} * {2 ** (d + 1)}) % 2 = 1 THEN 1e-6 ELSE 0 END)"
    share = "(CAST(errors AS DOUBLE) / (transactions + errors) * 100)"
    q["metric_text"] = f"""WITH {TUMBLING} SELECT {KEYS}, window_start,
      CASE WHEN p99_us < 1000 THEN p99_us || ' µs' ELSE {half_up('(p99_us / 1000.0::DOUBLE)', 2)} || ' ms' END AS p99_text,
      CASE WHEN p50_us >= 1000 THEN {half_up('(p50_us / 1000.0::DOUBLE)', 1)} || 'k' ELSE CAST(p50_us AS VARCHAR) END AS tps_text,
      {half_up(share, 2)} || '%' AS error_text FROM winw"""
    q["bands"] = f"""WITH {board()} SELECT {KEYS}, CASE WHEN composite >= 80 THEN 'good' WHEN composite >= 55 THEN 'ok'
        WHEN composite >= 30 THEN 'warn' ELSE 'bad' END AS score_band,
      CASE health WHEN 'READY' THEN 'good' WHEN 'DEGRADED' THEN 'warn' ELSE 'bad' END AS health_band FROM brd"""
    q["retention"] = (f"WITH {TUMBLING} SELECT {KEYS}, window_start, transactions FROM winw WHERE window_start >= "
                      "(SELECT max(window_start) - INTERVAL 7 DAY FROM winw)")
    q["upsert_peaks"] = f"""WITH {TUMBLING}, o AS (SELECT * FROM winw WHERE window_start < TIMESTAMP '2024-01-16'),
        n AS (SELECT * FROM winw WHERE window_start >= TIMESTAMP '2024-01-09'),
        a AS ({ROLLING.format(src='o').split('AS (', 1)[1][:-1]}), b AS ({ROLLING.format(src='n').split('AS (', 1)[1][:-1]}),
        u AS (SELECT *, 0 AS g FROM a UNION ALL SELECT *, 1 AS g FROM b)
      SELECT {KEYS}, max(updated_at) AS updated_at, arg_max(total_transactions, (updated_at, g)) AS total_transactions,
        round(max(peak_tps), 9) AS peak_tps, round(arg_max(current_tps, (updated_at, g)), 9) AS current_tps FROM u GROUP BY {KEYS}"""
    # streams
    lagged = SAMPLES.replace(f"{NS} AS recv_ts", f"{NS} - CAST({K} AS BIGINT) * {HOUR} AS recv_ts").replace(
        f"recv_ts // {HOUR} AS epoch", "epoch").replace("FROM acks)", "FROM seen WHERE epoch > head - 60)").replace(
        "), cells AS", f"), seen AS (SELECT *, recv_ts // {HOUR} AS epoch, max(recv_ts // {HOUR}) OVER (PARTITION BY {KEYS} ORDER BY seq) AS head FROM acks), cells AS")
    reached = f"reached AS (SELECT {KEYS}, max(head) AS head FROM seen GROUP BY {KEYS})"
    tumble = window_sql(f"{lagged}, {reached}, tc AS (SELECT *, (epoch // 6) * 6 AS lo FROM cells)", "tc", "tumbling", 6)
    slid = window_sql(f"{lagged}, {reached}, tc AS (SELECT cells.*, epoch - o AS lo FROM cells, range(6) AS r(o))", "tc", "sliding", 6)
    q["windows_after_late_drop"] = f"WITH {tumble} SELECT {WIN_COLS} FROM win"
    for kind, body in (("tumbling", tumble), ("sliding", slid)):
        q[f"stream_{kind}_windows"] = f"WITH {body} SELECT {WIN_COLS} FROM win JOIN reached USING ({KEYS}) WHERE lo + 6 <= head"
    q["stream_routes"] = f"WITH {ENVELOPES} SELECT topic, reason, count(*) AS events FROM routed GROUP BY topic, reason"
    q["stream_dedupe"] = "SELECT event_id, user_id, event_type, value FROM events"
    q["stream_dedupe_late"] = q["stream_dedupe"]
    q["stream_verdict"] = (f"WITH {VERDICTS} SELECT {KEYS}, orders_checked, trades_checked, violations, coalesce(by_rule, '{{}}') AS violations_by_rule, "
                           "round(correctness, 9) AS correctness_score FROM verdict")
    # The state after update u: windows up to its end, verdicts that have come.
    live = f"""{TUMBLING}, {VERDICTS}, upd(u, upto) AS (VALUES (0, TIMESTAMP '2024-01-06'), (1, TIMESTAMP '2024-01-14'),
        (2, TIMESTAMP '2024-01-25'), (3, TIMESTAMP '9999-01-01')),
      wu AS (SELECT u, winw.*, window_start >= coalesce((SELECT max(upto) FROM upd p WHERE p.u = upd.u - 1), TIMESTAMP '0001-01-01') AS came
        FROM winw JOIN upd ON window_start < upto),
      su AS (SELECT u, {KEYS}, avg(tps) AS mean_tps, bool_or(came) AS came, CASE WHEN count(*) >= 2 AND avg(tps) > 0 THEN stddev_samp(tps) / avg(tps) ELSE 0.0 END AS tps_cov
        FROM wu GROUP BY u, {KEYS}),
      lw AS (SELECT wu.* EXCLUDE (came), su.tps_cov, vd.correctness, su.came OR (vd.run_id IS NOT NULL AND vu = u) AS touched
        FROM (SELECT *, row_number() OVER (PARTITION BY u, {KEYS} ORDER BY window_start DESC) AS rn FROM wu) wu JOIN su USING (u, {KEYS})
        LEFT JOIN (SELECT {KEYS}, correctness, CASE WHEN submission_id < 'sub-010' THEN 1 ELSE 2 END AS vu FROM verdict) vd
          ON vd.run_id = wu.run_id AND vd.submission_id = wu.submission_id AND vu <= u WHERE rn = 1),
      sco AS ({score_sql('lw', 'coalesce(correctness, 1.0::DOUBLE)', 'tps_cov')}),
      rk AS (SELECT *, row_number() OVER (PARTITION BY u, run_id ORDER BY composite DESC, p99_us, submission_id) AS rank FROM sco),
      moved AS (SELECT a.*, coalesce(b.rank, 0) AS prev_rank FROM rk a LEFT JOIN rk b ON b.u = a.u - 1 AND b.run_id = a.run_id AND b.submission_id = a.submission_id)"""
    q["stream_board"] = f"""WITH {live} SELECT {KEYS}, latency_score, throughput_score, correctness_score, stability_score, composite,
        rank, CAST(CASE WHEN run_id IN (SELECT run_id FROM moved WHERE u = 3 AND touched) THEN prev_rank ELSE 0 END AS BIGINT) AS prev_rank FROM moved WHERE u = 3"""
    q["stream_rank_moves"] = f"""WITH {live} SELECT {KEYS}, CAST(u AS BIGINT) AS update_no, composite, rank, CAST(prev_rank AS BIGINT) AS prev_rank,
        CAST(CASE WHEN prev_rank = 0 THEN 0 ELSE prev_rank - rank END AS BIGINT) AS rank_delta FROM moved WHERE touched"""
    # sinks
    q["stored_windows"] = q["tumbling_windows"]
    q["stored_scores"] = f"""WITH {scores()} SELECT {KEYS}, latency_score, throughput_score, correctness_score, stability_score, composite,
        window_end AS computed_at, p99_us FROM sco"""
    q["stored_verdicts"] = (f"WITH {VERDICTS} SELECT {KEYS}, orders_checked, violations, coalesce(by_rule, '{{}}') AS violations_by_rule FROM verdict")
    q["stored_peaks"] = f"""WITH {TUMBLING}, a AS (SELECT {KEYS}, sum(transactions) AS t, max(tps) AS p FROM winw GROUP BY {KEYS}),
        b AS (SELECT {KEYS}, sum(transactions) AS t FROM winw WHERE window_start >= TIMESTAMP '2024-01-16' GROUP BY {KEYS})
      SELECT {KEYS}, CAST(coalesce(b.t, a.t) AS BIGINT) AS total_transactions, round(a.p, 9) AS peak_tps FROM a LEFT JOIN b USING ({KEYS})"""
    q["stored_sandbox_samples"] = f"""SELECT {RUN} AS run_id, {SUB} AS submission_id, event_id AS seq, {NS} AS sample_ts,
        'pod-' || CAST(user_id AS VARCHAR) AS pod_name, CASE WHEN {K} >= 95 THEN 'UNHEALTHY' WHEN {K} >= 85 THEN 'DEGRADED'
          WHEN {K} < 5 THEN '' ELSE 'READY' END AS health, CAST(ts AS DATE) AS day FROM events"""
    q["stored_probe_samples"] = ("SELECT 'u-' || CAST(user_id AS VARCHAR) AS submission_id, event_id AS pos, event_type <> 'error' AS healthy, "
                                 "value AS latency_ms, CAST(ts AS DATE) AS day FROM events")
    q["board_mirror"] = f"WITH {board(False)} SELECT {KEYS}, rank, round(composite, 9) AS composite, p99_us FROM brd WHERE run_id <> 'run-0'"
    q["summary_files"] = f"SELECT '1.0' AS schema_version, * FROM ({q['resource_summary']})"
    # lifecycle
    q["submission_checks"] = r"""WITH r AS (SELECT c_custkey AS request_id, md5(c_name) AS h, c_nationkey AS n, c_name,
        CASE c_mktsegment WHEN 'MACHINERY' THEN 'cpp' WHEN 'BUILDING' THEN 'rust' WHEN 'FURNITURE' THEN 'java' ELSE 'go' END AS lang,
        CASE WHEN c_nationkey = 7 THEN 'zip' ELSE 'ok' END AS typ, CAST(floor(c_acctbal) AS BIGINT) + 1000 AS port FROM customer),
      e AS (SELECT *, CASE WHEN n = 13 THEN '' WHEN n = 14 THEN 'a' || chr(10) || c_name ELSE './' || c_name END AS entrypoint FROM r)
      SELECT request_id, entrypoint, CASE WHEN n = 3 THEN 'invalid uuid "' || h || '"'
        WHEN lang = 'java' THEN 'unsupported language "java"' WHEN typ = 'zip' THEN 'unsupported submission_type "zip"'
        WHEN n = 13 THEN 'entrypoint is required' WHEN n = 14 THEN 'entrypoint contains invalid control characters'
        WHEN port < 1024 OR port > 65535 THEN 'declared_port must be in [1024,65535], got ' || port END AS error FROM e"""
    q["terminal_submissions"] = f"WITH {SUBS} SELECT submission_id, status, status IN {TERMINAL} AS terminal FROM sb"
    q["lifecycle_state"] = f"""WITH RECURSIVE {LIFE}, s AS (SELECT submission_id, arg_max(st, i) AS status, count(*) FILTER (ok) AS accepted_events,
        count(*) FILTER (NOT ok AND i > 0) AS rejected_events FROM run GROUP BY submission_id)
      SELECT *, status IN {TERMINAL} AS terminal FROM s"""
    q["lifecycle_audit"] = f"""WITH RECURSIVE {LIFE} SELECT r.submission_id, e.pos, e.occurred_at, e.actor, e.event AS action,
        r.prev AS prev_state, r.st AS new_state FROM run r JOIN ev e USING (submission_id, i) WHERE r.ok"""
    q["lifecycle_wire"] = f"WITH RECURSIVE {LIFE} SELECT event AS type, count(*) AS events, max(date_trunc('millisecond', occurred_at)) AS last_at FROM ev WHERE actor <> 'svc-error' GROUP BY event"
    q["submission_list"] = f"WITH {SUBS}, {DEPLOY} SELECT submission_id, sb.status, created_at FROM sb JOIN dp USING (submission_id)"
    q["latest_deployment"] = f"WITH {DEPLOY} SELECT * FROM dp"
    q["active_endpoints"] = f"WITH {ENDPOINT} SELECT * FROM ep WHERE status = 'ACTIVE'"
    q["submission_view"] = (f"WITH {SUBS}, {ENDPOINT} SELECT sb.submission_id, sb.status, CASE WHEN ep.status = 'ACTIVE' THEN internal_url END "
                            "AS endpoint FROM sb LEFT JOIN ep USING (submission_id)")
    q["deployment_view"] = f"""WITH {SUBS}, {ENDPOINT}, {DEPLOY} SELECT sb.submission_id, coalesce(dp.status, 'PENDING') AS status, deployment_id,
        CASE WHEN dp.status IS NOT NULL THEN endpoint_id END AS endpoint_id, CASE WHEN dp.status IS NOT NULL THEN ep.status END AS endpoint_status,
        CASE WHEN dp.status IS NOT NULL AND ep.status = 'ACTIVE' THEN internal_url END AS endpoint
      FROM sb LEFT JOIN dp USING (submission_id) LEFT JOIN ep USING (submission_id)"""
    q["health_classifier"] = """WITH p AS (SELECT 'u-' || CAST(user_id AS VARCHAR) AS submission_id, event_id AS pos,
        event_type <> 'error' AND value <= 100 AS good FROM events),
      r AS (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY pos) - row_number() OVER (PARTITION BY submission_id, good ORDER BY pos)
        AS isl FROM p),
      s AS (SELECT *, row_number() OVER (PARTITION BY submission_id, good, isl ORDER BY pos) AS streak FROM r)
      SELECT submission_id, pos, good, coalesce(last_value(CASE WHEN good AND streak >= 2 THEN 'READY' WHEN NOT good AND streak >= 3 THEN 'DEGRADED' END
        IGNORE NULLS) OVER (PARTITION BY submission_id ORDER BY pos), 'UNKNOWN') AS state FROM s"""
    q["probe_last_n"] = """SELECT submission_id, pos, time, healthy, latency_ms FROM (SELECT 'u-' || CAST(user_id AS VARCHAR) AS submission_id,
        event_id AS pos, ts AS time, event_type <> 'error' AS healthy, value AS latency_ms,
        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10"""
    q["archive_audit"] = """WITH e AS (SELECT o_custkey AS artifact_id, CASE o_custkey % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'rust' ELSE 'cpp' END AS language,
        o_orderkey AS pos, o_totalprice AS t, o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' AS lnk, o_orderpriority AS pri,
        CAST(floor(o_totalprice * 200) AS BIGINT) AS size FROM orders),
      n AS (SELECT *, CASE WHEN t > 499000 THEN '../' || pos WHEN t < 2000 THEN '/abs/' || pos WHEN pri = '1-URGENT' THEN 'bot/go.mod'
          WHEN pri = '2-HIGH' THEN 'bot/Cargo.toml' WHEN pri = '5-LOW' THEN 'bot/main.cpp' ELSE 'bot/src/' || pos END AS nm,
        row_number() OVER w AS files, sum(CASE WHEN lnk THEN 0 ELSE size END) OVER w AS bytes FROM e
        WINDOW w AS (PARTITION BY artifact_id ORDER BY pos)),
      r AS (SELECT *, CASE WHEN files > 10000 THEN 'archive contains too many files'
          WHEN t > 499000 OR t < 2000 THEN 'unsafe archive path "' || nm || '"'
          WHEN lnk AND t > 450000 THEN 'unsafe link target "../../etc"' WHEN t > 498000 THEN 'setuid bit is forbidden on ' || nm
          WHEN NOT lnk AND bytes > 536870912 THEN 'archive exceeds decompressed size cap' END AS reason,
        NOT lnk AND ((language = 'go' AND nm = 'bot/go.mod') OR (language = 'rust' AND nm = 'bot/Cargo.toml')
          OR (language = 'cpp' AND nm = 'bot/main.cpp')) AS mark FROM n),
      a AS (SELECT artifact_id, language, arg_min(reason, pos) FILTER (reason IS NOT NULL) AS rs, bool_or(mark) AS ok, max(files) AS files,
        CAST(max(bytes) AS BIGINT) AS bytes FROM r GROUP BY 1, 2),
      v AS (SELECT *, coalesce(rs, CASE WHEN NOT ok THEN 'source archive missing required ' || language || ' manifest or main file' END) AS error FROM a)
      SELECT artifact_id, language, error, CASE WHEN error IS NULL THEN files END AS files, CASE WHEN error IS NULL THEN bytes END AS bytes FROM v"""
    q["artifact_digest"] = """WITH d AS (SELECT doc_id AS artifact_id, CASE WHEN lang = 'en' THEN 'binary' ELSE 'source' END AS submission_type,
        sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents)
      SELECT *, CASE WHEN size > 104857600 THEN 'artifact exceeds max upload size' WHEN artifact_id % 3 = 2 THEN 'sha256 mismatch'
        WHEN submission_type = 'binary' THEN 'binary artifact is not an ELF executable' END AS error FROM d"""
    return {name: text.replace("WITH ", "WITH RECURSIVE ", 1) if "settle(i" in text else text for name, text in q.items()}
