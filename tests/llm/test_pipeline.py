"""The pipeline, stage by stage, against what each operator reports on the same rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowboard.llm import registry

from llm_cases import DOCS, prose
from test_native import brute_lines
from test_python import brute_leaks, check_pieces, counted, slow_similarity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = registry.table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_all_but_the_last_keep_the_columns(stages):
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_language_keeps_clean_documents(stages):
    before, after = stages[0]
    gone = {r["doc_id"]: r["text"] for r in before.join(after, "doc_id", "left_anti").collect()}
    assert all(len(t.split()) < 6 for t in gone.values())


def test_lines(stages):
    before, after = stages[1]
    want = {d: t for (d, _), t in brute_lines(rows(before), 50).items() if t}
    assert dict(rows(after)) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_copies(stages):
    before, after = stages[2]
    had, left = rows(before), {d for d, _ in rows(after)}
    sets = {d: counted(t) for d, t in had}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i].keys() & sets[j].keys() and len(sets[i].keys() & sets[j].keys()) > 0.6 * max(len(sets[i]), len(sets[j])) and slow_similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert left == {d for d in ids if find(d) == d}


def test_leaks(spark, stages):
    before, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in registry.table(spark, SF, "benchmark").collect()]
    known = {w for _, t in items for w in counted(t)}
    likely = [(d, t) for d, t in rows(before) if len(set(counted(t)) & known) > 3]
    found = {d for d, _ in brute_leaks(likely, items)}
    assert found and {d for d, _ in rows(after)} == {d for d, _ in rows(before)} - found


def test_packing(stages):
    before, after = stages[4]
    check_pieces(after.collect(), rows(before), 1024)


def test_run_and_odd_rows(spark, stages):
    plain = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    total = lambda pieces: {d: sum(p[2] for p in pieces if p[0] == d) for d in {p[0] for p in pieces}}
    assert total(plain(corpus_pipeline.run(spark, SF))) == total(plain(stages[-1][1]))
    text = prose(1, 80)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, text, None, None, None), (2, text, None, None, None), (3, text, "en", "s", 7)], DOCS)
    odd = odd.withColumn("row", F.lit(1)).withColumn("t1", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).count()
        stage(spark, odd.limit(0), SF).count()
    kept = corpus_pipeline.dedup_near(spark, odd, SF).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept) == [(False, 0), (True, 2)]
    assert re.fullmatch(r"w.*", kept[0]["text"] or "w")


def test_lines_that_leave_blank_lines_only(spark):
    """A repeated document of paragraphs parted by blank lines goes, whatever the blank lines hold; what had no words before stays."""
    parts = [prose(i, 60) for i in range(4)]
    docs = [(1, "\n\n".join(parts)), (2, "\n\n".join(parts[:3])), (3, "\n \t\r\n".join(parts)), (4, "\n\n"), (5, parts[0] + "\n\nmore")]
    odd = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], DOCS)
    assert sorted(rows(corpus_pipeline.dedup_lines(spark, odd, SF))) == [docs[0], docs[3], (5, "\nmore")]


def test_language_loses_no_clean_document(stages):
    before, after = stages[0]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in before.where(F.col("text").rlike(r"\p{L}")).collect())


def test_language_of_many_or_no_languages(spark):
    """Clean texts stay among sixteen languages alike in all but one word in six; without labels every row stays."""
    rng, names, docs = random.Random(2), "abcdefghijklmnop", []
    for i in range(640):
        own = [c * 2 + s for c in names[i % 16] for s in ("ka", "lo", "mi")]
        docs.append((i, " ".join(rng.choice(own if rng.random() < 1 / 6 else ["the", "rest", "is", "shared", "by", "all"]) for _ in range(1 + i % 12)), names[i % 16], "s", 0))
    odd = [(1000, "12 ...", None, "s", 0), (1001, None, None, "s", 0)]
    got = corpus_pipeline.identify_language(spark, spark.createDataFrame(docs + odd, DOCS), SF)
    assert sorted(rows(got)) == sorted((d, t) for d, t, *_ in docs)
    blank = [(d, t, None, s, n) for d, t, _, s, n in docs + odd]
    assert corpus_pipeline.identify_language(spark, spark.createDataFrame(blank, DOCS), SF).count() == len(blank)
