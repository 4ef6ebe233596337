"""Operators without Python: brute force, fixed cases, and rows that are null, empty, repeated or oddly named."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from flowboard.llm import chat, lines, registry, shards, sketch, urls
from flowboard.llm.common import chunk_of, order_bounds
from flowboard.llm.sql import SQL

from llm_cases import prose

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "conversations"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want, got = con.execute(SQL[name]).df(), registry.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()), key=repr)
    assert plain(got) == plain(want)


# ---- line dedup -----------------------------------------------------------------------------

def brute_lines(docs, least):
    """Delete every line inside any run of `least` words that occurs earlier without overlap; all runs are tried."""
    kept = {}
    docs = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    runs, worded = {}, {}
    for at, (_, text) in enumerate(docs):
        worded[at] = [(i, x) for i, x in enumerate((text or "").split("\n")) if re.search(r"[^ \t\r\f]", x)]
        for a in range(len(worded[at])):
            for b in range(a, len(worded[at])):
                if sum(len(re.findall(r"[^ \t\r\f]+", x)) for _, x in worded[at][a:b + 1]) >= least:
                    runs.setdefault(tuple(x for _, x in worded[at][a:b + 1]), []).append((at, a, b))
    gone = {at: set() for at in worded}
    for places in runs.values():
        first = min(places)
        for at, a, b in places:
            if at != first[0] or a > first[2]:
                gone[at].update(i for i, _ in worded[at][a:b + 1])
    for at, (doc, text) in enumerate(docs):
        kept[doc, text] = text if not gone[at] else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[at])
    return kept


def test_lines_equal_brute_force(make):
    rng = random.Random(5)
    pool = [" ".join(f"a{i}b{j}" for j in range(rng.choice([1, 2, 5, 9]))) for i in range(12)] + ["", " \t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(14)))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, "\n".join(pool[:9])), (3, rows[3][1])]
    got = lines.dedup_lines(make(rows), 12).select("row.doc_id", "row.text", F.col("text").alias("left")).collect()
    want = brute_lines(rows, 12)
    assert len(got) == len(rows)
    for r in got:
        assert r["left"] == want[r["doc_id"], r["text"]], r
    assert sum(r["left"] != r["text"] for r in got) > 10


def test_lines_run_is_found_on_one_line_or_many_and_short_ones_stay(make):
    long, some = prose(1, 60), [prose(i, 13) for i in range(2, 7)]
    rows = [(1, f"x\n{long}\ny"), (2, long), (3, "\n".join(some)), (4, "\n".join(["head", *some, "tail"])), (5, some[0]), (6, some[0])]
    got = {r["doc_id"]: r for r in lines.dedup_lines(make(rows)).select("row.doc_id", "text", "lines_removed").collect()}
    assert got[2]["text"] == "" and got[2]["lines_removed"] == 1
    assert got[4]["text"] == "head\ntail"
    assert got[5]["text"] == got[6]["text"] == some[0]


def test_lines_empty_table_and_clashing_columns(make):
    schema = "doc_id bigint, text string, row string, runs int, t1 bigint, s int, k string, fp bigint"
    assert lines.dedup_lines(make([], schema)).count() == 0
    text = prose(3, 70)
    got = lines.dedup_lines(make([(1, text, "r", 1, 2, 3, "k", 4), (2, text, None, None, None, None, None, None)], schema)).orderBy("row.doc_id").collect()
    assert [r["text"] for r in got] == [text, ""]
    assert got[0]["row"]["row"] == "r" and got[0]["row"]["fp"] == 4


# ---- sketches --------------------------------------------------------------------------------

def test_sketches_equal_sets(make):
    rng = random.Random(2)
    rows = [(i, "\n".join(f"line {rng.randrange(400)}" for _ in range(rng.choice([0, 1, 3, 40, 300])))) for i in range(30)]
    rows += [(None, "a\nb\nc"), (50, None), (51, ""), (7, rows[7][1]), (52, "é\n" * 9 + "ü" * 31)]
    rows = [(a, b) for a, b in rows]
    got = {(r["doc_id"], r["edited_sha256"]): r for r in sketch.fingerprints(make(rows)).collect()}
    order = sorted([(a, b or "") for a, b in rows], key=lambda r: (r[0] is None, -(r[0] or 0)))
    tied = {order[i][0] for i in range(len(order)) for j in (i - 1, i, (i + 1) % len(order)) if order[j][0] == 7}
    lines_of = lambda t: {x for x in t.split("\n") if x}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    checked = 0
    for i, (doc, text) in enumerate(order):
        if doc in tied and doc != 7:
            pass
        after = order[(i + 1) % len(order)][1]
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        r = got[doc, hashlib.sha256(edited.encode()).hexdigest()]
        assert r["n_chars"] == len(text)
        assert r["near_edited"] == pytest.approx(like(lines_of(text), lines_of(edited)), abs=1e-12)
        assert r["near_next"] == pytest.approx(like(lines_of(text), lines_of(after)), abs=1e-12)
        checked += 1
    assert checked == len(rows)
    prints = {}
    for r in sketch.fingerprints(make([(1, "a\nb"), (2, "a\nb"), (3, "a\nc")])).collect():
        prints[r["doc_id"]] = r["fingerprint"]
    assert prints[1] == prints[2] != prints[3]


def test_sketch_retries_larger_until_all_is_recovered(make, spark):
    pairs = spark.createDataFrame([(1, list(range(0, 5000)), list(range(40, 5100))), (2, [], []), (3, [5], []), (4, [1, 2], [1, 2])],
                                  "id bigint, a array<bigint>, b array<bigint>")
    hashed = pairs.select("id", *[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "ab"])
    got = {r["id"]: (r["only_a"], r["only_b"]) for r in sketch.differences(hashed).collect()}
    assert got == {1: (40, 100), 2: (0, 0), 3: (1, 0), 4: (0, 0)}


def test_sketch_of_no_rows_and_of_one(make):
    assert sketch.fingerprints(make([])).count() == 0
    one = sketch.fingerprints(make([(9, "abcdef")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one["near_next"] == 1.0


def test_next_crosses_chunks(spark, make, monkeypatch):
    monkeypatch.setattr(sketch, "order_bounds", lambda ids: order_bounds(ids, "doc_id", 7))
    rows = [(i * 3, f"t{i}") for i in range(100)]
    got = {r["doc_id"]: r["next_text"] for r in sketch.with_next(make(rows)).collect()}
    assert got == {i * 3: f"t{(i - 1) % 100}" for i in range(100)}


def test_chunks_cover_the_order(make):
    ids = make([(i,) for i in range(1000)] + [(None,)] * 5, "doc_id bigint")
    bounds = order_bounds(ids, "doc_id", 3)
    assert len(bounds) > 300
    rows = ids.select("doc_id", chunk_of(F.col("doc_id"), bounds).alias("c")).collect()
    by = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["c"]) for r in rows)
    assert [c for _, c in by] == sorted(c for _, c in by) and by[-1][1] == len(bounds)
    assert all(c == sum(b <= d for b in bounds) for d, c in by if d >= 0)


# ---- sharding -----------------------------------------------------------------------------

def test_shards_law_slots_and_weights(make):
    rows = [(i, "x" * (i % 7)) for i in range(2000)] + [(None, None), (None, "é"), (5, "again"), (5, "again")]
    got = shards.assign(make(rows), [1.0] * 6, [1.0] * 7).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
        assert r["grown_shard"] in (r["shard"], 6)
    assert sum(r["grown_shard"] == 6 for r in got) > 150
    for own in by.values():
        own.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in own]
        assert ids == sorted(ids)
    e = next(r for r in got if r["size"] == 10 and r["doc_id"] is None)
    assert e["text_crc32"] == zlib.crc32("é".encode())
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    heavy = shards.assign(make(rows), [1.0, 3.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] for r in heavy}
    assert 0.7 < share[1] / len(rows) < 0.8
    assert shards.assign(make([], "doc_id bigint, text string, shard int, chunk int, slot string"), [1.0] * 3).count() == 0
    with pytest.raises(ValueError):
        shards.rendezvous(F.col("doc_id"), [1.0, 0.0])


# ---- URLs --------------------------------------------------------------------------------------

@pytest.mark.parametrize("url,host,path", [
    ("HTTP://WWW.Exämple.COM:80/a/B?x#y", "www.exämple.com:80", "/a/B"), ("x://h?q/r", "h", ""), ("a://b://c/d", "b:", "//c/d"),
    ("nothing", "", ""), (None, "", ""), ("", "", ""), ("://h#f", "h", ""), ("k\n://h/\np", "h", "/\np")])
def test_url_parts(make, url, host, path):
    row = make([(1, url)], "page_id bigint, url string").select(urls.host_of(F.col("url")).alias("h"), urls.path_of(F.col("url")).alias("p")).first()
    assert (row["h"], row["p"]) == (host, path)


def test_longest_rule_wins_and_models_decide_the_rest(make):
    rng = random.Random(1)
    word = lambda a: "".join(rng.choice(a) for _ in range(8))
    rows = [(i, f"http://{word('abc')}.good/x") for i in range(60)] + [(100 + i, f"http://{word('xyz')}.bad/x") for i in range(60)]
    rows += [(300, "http://abcabcab.neutral/x"), (301, "http://xyzzyxyz.neutral/x"), (302, None), (303, ""), (304, "http://a.b.good/x/y"), (300, "http://abcabcab.neutral/x")]
    rules = [("allow", "good/"), ("block", "bad/"), ("block", "b.good/x/")]
    got = urls.judge(make(rows, "page_id bigint, url string"), rules).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[300]["verdict"] == "allow" and by[301]["verdict"] == "block" and by[300]["rule"] is None
    assert by[304]["rule"] == "b.good/x/" and by[304]["verdict"] == "block"
    assert by[302]["host"] == by[303]["host"] == "" and by[302]["verdict"] in ("allow", "block")
    none = urls.judge(make([(1, "http://a.b/", 1, 2, "x")], "page_id bigint, url string, host int, gram int, fold string"), rules).collect()
    assert none[0]["verdict"] == "allow" and none[0]["score"] == 0
    assert urls.judge(make([], "page_id bigint, url string"), rules).count() == 0


def test_grams_equal_plain_witten_bell(make):
    import math

    texts = [("allow", "aab"), ("allow", "abab"), ("block", "bba"), (None, "abz")]
    grams = [(t and a, (urls.START * 2 + t + urls.END)[i:i + 3]) for a, t in texts for i in range(len(t) + 1)]
    table = {}
    for side, g in grams:
        row = table.setdefault(g, {"allow": 0, "block": 0})
        if side:
            row[side] += 1

    def p(side, gram):
        value = 1 / urls.ALPHABET
        for k in range(3):
            tail, ctx = gram[2 - k:], gram[2 - k:2]
            c = sum(n[side] for g, n in table.items() if g[2 - k:] == tail)
            follow = {g[2 - k:]: 0 for g in table if g[2 - k:2] == ctx}
            for g, n in table.items():
                if g[2 - k:2] == ctx:
                    follow[g[2 - k:]] += n[side]
            total, different = sum(follow.values()), sum(v > 0 for v in follow.values())
            if total:
                value = (c + different * value) / (total + different)
        return value

    rows = [(g, n["allow"], n["block"]) for g, n in table.items()]
    got = urls.gram_table(make(rows, "gram string, n_allow bigint, n_block bigint"), 2).collect()
    assert len(got) == len(table)
    for r in got:
        assert r["micro"] == pytest.approx((math.log(p("allow", r["gram"])) - math.log(p("block", r["gram"]))) * 1e6, abs=1)


# ---- chats --------------------------------------------------------------------------------------

def test_chats_round_trip(make):
    nasty = ["</s>", "\\", "\\0;", "[INST]", "[IN[INST]ST]", "\\e;", "", None, "[/ROLE]x[ROLE]", "</s", "é\n</s>\n", "[NOROLE]", "\\\\7;"]
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", None, "</s>", "[/ROLE]", ""]
    rows = [(c, t, rng.choice(roles), rng.choice(nasty)) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a")]
    schema = "conv_id bigint, turn bigint, role string, text string"
    formatted = chat.format_chats(make(rows, schema))
    got = {r["conv_id"]: r for r in formatted.withColumn("turns", chat.parse_chats(F.col("text"))).collect()}
    for c in {r[0] for r in rows}:
        want = [(role, text or "") for _, _, role, text in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == want
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["text"]
        assert sum(s["loss"] for s in got[c]["segments"]) == sum(r == "assistant" for r, _ in want)
    digests = {r["conv_id"]: r for r in chat.digest_chats(formatted).collect()}
    for c in {r[0] for r in rows}:
        own = [r for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert digests[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and digests[c]["loss_chars"] == len(said)
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        assert digests[c]["turns_sha256"] == hashlib.sha256(every.encode()).hexdigest() and digests[c]["n_turns"] == len(own)


@pytest.mark.parametrize("roles,fault", [
    ("ua", 0), ("sua", 0), ("uaua", 0), ("u", 2), ("a", 1), ("uu", 2), ("usa", 2), ("sa", 2), ("uas", 3), ("uax", 3), ("s", 2)])
def test_state_machine(make, roles, fault):
    names = {"u": "user", "a": "assistant", "s": "system", "x": None}
    rows = [(1, i, names[r], "t") for i, r in enumerate(roles)]
    assert chat.format_chats(make(rows, "conv_id bigint, turn bigint, role string, text string")).first()["order_fault"] == fault


def test_chats_empty_and_templates(make):
    schema = "conv_id bigint, turn bigint, role string, text string, row string, segments int, rows int"
    assert chat.format_chats(make([], schema)).count() == 0
    assert chat.format_chats(make([(1, 0, "user", "x", "r", 1, 2)], schema)).first()["text"] == "[INST]x</s>"
    for bad in ({"end": ""}, {"end": "[INST]"}, {"end": "a\\"}, {"end": "x[INST]"}, {"end": "]["}, {"end": "x["}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_lines_of_one_text_of_twenty_thousand_runs(make):
    """Repeated runs parted by unique lines, in one text of 80,000 lines."""
    import time

    run = "\n".join(prose(i, 20) for i in range(3))
    text = "\n".join(f"{run}\nown {i}" for i in range(20_000))
    begin = time.perf_counter()
    got = lines.dedup_lines(make([(1, text), (2, run)])).collect()
    assert time.perf_counter() - begin < 60
    by = {r.row.doc_id: r for r in got}
    assert by[1].text == run + "\n" + "\n".join(f"own {i}" for i in range(20_000)) and by[1].lines_removed == 3 * 19_999
    assert by[2].text == "" and by[2].lines_removed == 3
