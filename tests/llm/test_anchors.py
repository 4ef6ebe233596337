"""Substring dedup against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from flowboard.llm.anchors import dedup_substrings

from llm_cases import DOCS, prose

ODD = "doc_id bigint, text string, t1 bigint, number string, parcel int, kind int, words string"


def expected(rows, size=20):
    """Removed positions of each row by first holders of whole windows."""
    seen, docs = {}, sorted({r[:2] for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[2] if len(r) > 2 else 0))
    for doc in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (doc[1] or "").encode())
        for s in range(len(words) - size + 1):
            seen.setdefault(tuple(words[s:s + size]), (doc, s))
    out = {}
    for doc in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (doc[1] or "").encode())
        gone = set()
        for s in range(len(words) - size + 1):
            if seen[tuple(words[s:s + size])] != (doc, s):
                gone.update(range(s, s + size))
        out[doc] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return out


def check(make, rows, parcel=1_000_000, size=20):
    want = expected(rows, size)
    got = dedup_substrings(make(rows), size, parcel).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == sorted(((d, *want[d, t]) for d, t in rows), key=str)
    for r in got:
        assert sum(s["words"] for s in r.repeats) == r.n_removed
        assert all(a["first"] + a["words"] < b["first"] for a, b in zip(r.repeats, r.repeats[1:]))


@pytest.mark.parametrize("parcel", [60, 400, 1_000_000])
def test_repeats_of_every_length_and_alignment(make, parcel):
    rng = random.Random(parcel)
    passages = [prose(i, n).split() for i, n in enumerate([19, 20, 21, 29, 30, 45, 80])]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            words += prose(rng.randrange(10**9), rng.randrange(15)).split()
            p = rng.choice(passages)
            cut = rng.randrange(3)
            words += p[cut:len(p) - rng.randrange(3)]
        rows.append((i, " ".join(words)))
    check(make, rows, parcel)


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_other_window_sizes(make, size):
    check(make, [(i, " ".join(random.Random(i).choice("abcd") for _ in range(12))) for i in range(25)], 30, size)


def test_overlapping_repeats_in_one_text(make):
    check(make, [(1, "a " * 50), (2, "a b " * 30), (3, "a b c " * 15 + prose(1, 30))])


def test_odd_rows(make):
    long = prose(5, 40)
    rows = [(None, long), (1, long), (2, None), (3, ""), (4, " \n\t "), (5, "x y z\x1c" + long), (6, long.replace(" ", "\n")),
            (6, long.replace(" ", "\x0b")), (7, long[:50]), (1, long), (8, "\u0000 \u0085 " * 30), (9, long.upper())]
    rows[7] = (60, rows[7][1])
    rows.append((2**60 + 1, long + " last"))
    check(make, rows)
    extra = make([(d, t, 1, "n", 2, 3, "w") for d, t in rows], ODD)
    assert {(r.doc_id, r.n_removed) for r in dedup_substrings(extra).collect()} == {(r.doc_id, r.n_removed) for r in dedup_substrings(make(rows)).collect()}
    assert dedup_substrings(make([])).count() == 0
    assert dedup_substrings(make([(1, None)])).collect()[0].text == ""


def test_equal_ids_are_ordered_by_their_text_hash(make):
    a, b = prose(1, 25), prose(1, 25) + " end"
    got = dedup_substrings(make([(1, a), (1, b)])).collect()
    order = sorted(got, key=lambda r: r.t1)
    assert order[0].n_removed == 0 and order[1].n_removed == 25


def test_one_very_long_text_and_a_passage_of_all(make):
    passage = prose(3, 60)
    rows = [(i, f"{prose(i + 100, 30)} {passage} {prose(i + 5000, 10)}") for i in range(300)] + [(1000, prose(7, 300_000, 10**9) + " " + passage)]
    check(make, rows, 5000)


def test_documents_table_matches_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {(r.doc_id,): (r.n_words, r.n_removed, r.text) for r in dedup_substrings(docs).collect()}
    assert got == {(d,): v for (d, _), v in want.items()} and any(v[1] for v in got.values())
