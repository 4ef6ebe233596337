"""Tokenizer alignment against plain Python over whole texts."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from flowboard.llm import registry
from flowboard.llm.alignment import align, aligner

from llm_cases import prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def byte_table():
    keep = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    others = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(others)}


def expected(texts):
    a, b, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_table()
    a.encode_special_tokens = True
    links, groups, sizes = [], [], []
    for text in texts:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        pa = [bytes(table[c] for c in a.id_to_token(i)) for i in ia]
        pb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if not text or b"".join(pa) != (" " + text).encode() or b"".join(pb) != (" " + text).encode():
            links.append(Counter())
            groups.append([])
            sizes.append((0, 0))
            continue
        ends = [[sum(map(len, p[:i + 1])) for i in range(len(p))] if len(p) < 500 else list(__import__("itertools").accumulate(map(len, p))) for p in (pa, pb)]
        mine, j = Counter(), 0
        for i, (x, ea) in enumerate(zip(ia, ends[0])):
            sa = ea - len(pa[i])
            while ends[1][j] <= sa:
                j += 1
            k = j
            while k < len(ib) and ends[1][k] - len(pb[k]) < ea:
                mine[x, ib[k]] += 1
                k += 1
        links.append(mine)
        common, cuts = sorted(set(ends[0]) & set(ends[1])), []
        fa, fb = 0, 0
        for e in common:
            na, nb = ends[0].index(e, fa) + 1, ends[1].index(e, fb) + 1
            cuts.append(f"{','.join(map(str, ia[fa:na]))}|{','.join(map(str, ib[fb:nb]))}")
            fa, fb = na, nb
        groups.append(cuts)
        sizes.append((len(ia), len(ib)))
    total, most = Counter(), defaultdict(int)
    for c in links:
        total.update(c)
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    return [(*s, len(g), sum(c.values()), sum(n for p, n in c.items() if total[p] == most[p[1]]), sum(n * total[p] for p, n in c.items()), ";".join(g))
            for c, g, s in zip(links, groups, sizes)]


def check(make, rows, **how):
    want = expected([t or "" for _, t in rows])
    got = align(make(rows), A, B, **how).collect()
    assert sorted(((r.doc_id, *[r[c] for c in FIGURES]) for r in got), key=str) == sorted(((d, *w) for (d, _), w in zip(rows, want)), key=str)


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "x\n y ", "\n\n", "<|endoftext|> a<|endoftext|> <s> </s><unk>", "▁a b", "a ▁ b", "naïve — “quoted”", "中文字符 かな",
       "\x1c  é", "é", "...!!! 1234567 3.14", "\t tab\ttab", "'s don't I'm", "\u0000x", "👩‍👩‍👧 ok", "<0x41> b", "a b c", "ﬁ ①", "word " * 50]


def test_odd_texts(make):
    check(make, [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, "a b"), (3, "a b"), (2**60 + 1, "a b")])


@pytest.mark.parametrize("parcel, radices", [(20, 3), (100, 64), (10**6, 1)])
def test_runs_merge_in_rounds(make, monkeypatch, parcel, radices):
    monkeypatch.setattr("flowboard.llm.alignment.FAN_IN", 3)
    check(make, [(i, prose(i, 5 + 3 * i, 200) + " the end, of it.") for i in range(40)], parcel_units=parcel, radices=radices)


def test_units_give_the_tokens_of_the_whole_text(sf, spark):
    own = aligner(A, B)
    for row in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        parts = own.align(own.units(row.text))
        a, b = Tokenizer.from_file(A).encode(" " + row.text, add_special_tokens=False).ids, own.b.encode(row.text)
        assert [sum(p[k] for p in parts) for k in (1, 2)] == [len(a), len(b)]


def test_tables(make, sf, spark):
    assert align(make([]), A, B).count() == 0
    assert align(make([(1, None), (2, "")]), A, B).where("n_links = 0 and groups = ''").count() == 2
    extra = make([(1, "a b", 5, "x", 7)], "doc_id bigint, text string, radix int, parcel string, n_a int")
    assert align(extra, A, B).first().n_a == 2
    long = "".join(chr(97 + i * 7 % 26) for i in range(60_000))
    assert align(make([(1, long)]), A, B).first().n_links >= 10_000


def test_query_over_the_whole_table(sf, spark):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = expected([r.text or "" for r in rows])
    got = {r.doc_id: r for r in registry.QUERIES["op12_tokenizer_alignment"](spark, sf).collect()}
    for row, w in zip(rows, want):
        r = got[row.doc_id]
        assert tuple(r[c] for c in FIGURES[:-1]) == w[:-1]
        assert r.groups_sha256 == (hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "")
