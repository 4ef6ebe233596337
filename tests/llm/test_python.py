"""Operators with Python in tasks, against plain Python; round trips; held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowboard.llm import huffman, language, leaks, minhash, packing, registry, words
from flowboard.llm.common import new_path
from flowboard.llm.components import component_labels
from flowboard.llm.tokens import Encoder, encoder

from llm_cases import prose

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a  b", "x\n y ", "<|endoftext|> a<|endoftext|>", "\x1c\u00a0 é", "..."]


# ---- tokens ----------------------------------------------------------------------------------

@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sabé1.\u00a0\u2028\x1c\x85"), st.characters(exclude_categories=["Cs"]))))
def test_pieces_give_the_ids_of_the_whole_text(text):
    own = encoder(PATH)
    assert own(text) == own.whole(text)


def test_other_tokenizers_are_run_whole():
    other = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.by_piece and other("A  b c") == other.whole("A  b c")


# ---- token files ------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=2, max_size=40).filter(lambda c: sum(x > 0 for x in c) > 1), st.integers(6, 12))
def test_code_is_complete_and_within_the_limit(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit)
    used = lengths > 0
    assert (used == (np.array(counts) > 0)).all() and lengths.max() <= limit
    assert sum(2.0 ** -int(x) for x in lengths[used]) == 1
    codes = {f"{c:0{n}b}" for c, n in zip(huffman.canonical(lengths)[used].tolist(), lengths[used].tolist())}
    assert len(codes) == used.sum() and not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_limited_code_is_optimal():
    """Against all limited code lengths of a small alphabet."""
    from itertools import product

    for counts in ([1, 1, 2, 3, 50], [1, 5, 5, 5, 90], [7, 7, 7, 7, 7]):
        best = min(sum(c * n for c, n in zip(counts, ns)) for ns in product(range(1, 4), repeat=5) if sum(2.0 ** -n for n in ns) <= 1)
        assert (huffman.code_lengths(np.array(counts), 3) * np.array(counts)).sum() == best
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    counts = np.maximum(1, (1e6 / np.arange(1, 5001) ** 1.2)).astype(int)
    lengths = huffman.code_lengths(counts)
    docs = [[rng.integers(0, 5000, n).astype("<u2") for n in ns] for ns in ([1], [255, 1, 256], [257, 3000, 2], [70000])]
    blocks = [huffman.encode_block([None, *range(len(d) - 1)], d, lengths, huffman.canonical(lengths)) for d in docs]
    for some in (blocks, blocks[:1], blocks[2:3]):
        for (directory, ids), d in zip(huffman.decode_blocks(some, huffman.decode_table(lengths)), [docs[blocks.index(b)] for b in some]):
            assert directory["n"].tolist() == [len(x) for x in d] and (ids == np.concatenate(d)).all()
    with pytest.raises(ValueError):
        huffman.decode_blocks([b"none" + blocks[0][4:]], huffman.decode_table(lengths))


def expected_files(rows, end):
    at, out = 0, []
    for doc, text in rows:
        ids = np.append(np.frombuffer(encoder(PATH).whole(text or "") if text else b"", dtype="<u4"), np.uint32(end))
        out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        at += len(ids)
    return out


def test_files_hold_all_ids_in_order(spark, make):
    rows = [(None, "first")] + [(i, t) for i, t in enumerate(ODD)] + [(20, prose(1, 3000)), (21, "b")]
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    path = new_path(spark, "ids")
    huffman.write_ids(make([(d, t, 1, 2) for d, t in shuffled], "doc_id bigint, text string, part int, ids int").repartition(3), path, PATH, 2)
    got = [tuple(r) for r in huffman.read_ids(spark, path).orderBy("start").collect()]
    assert got == expected_files(rows, 2)
    again = new_path(spark, "ids")
    huffman.write_ids(make([(4, "a b"), (4, "a b")]), again, PATH, 2)
    assert [r["start"] for r in huffman.read_ids(spark, again).orderBy("start").collect()] == [0, 3]
    empty = new_path(spark, "ids")
    huffman.write_ids(make([]), empty, PATH, 2)
    assert huffman.read_ids(spark, empty).count() == 0


def test_files_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in registry.table(spark, SF, "documents").collect())
    got = [tuple(r) for r in registry.QUERIES["op8_token_files"](spark, SF).orderBy("start").collect()]
    assert got == expected_files(docs, 2)


# ---- packing ------------------------------------------------------------------------------------

def check_pieces(got, rows, size):
    docs = {}
    for doc, text in rows:
        ids = np.append(np.frombuffer(encoder(PATH).whole(text) if text else b"", dtype="<u4"), np.uint32(0)).astype("<u4")
        docs.setdefault(doc, []).append(ids)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for doc, copies in docs.items():
        assert sum(r["length"] for r in by_doc[doc]) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for r in sorted(by_doc[doc], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(copies[0])
                assert r["ids_crc32"] == zlib.crc32(copies[0][at:at + r["length"]].tobytes())
                at += r["length"]
    fills = []
    for s, own in by_seq.items():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        fills.append(at)
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert max(fills) <= size and sum(f < size for f in fills) <= 1


def test_packing_keeps_every_id_once(make):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, prose(i, 3 + 17 * i % 400)) for i in range(120)] + [(None, "x"), (7, ODD[7])]
    schema = "doc_id bigint, text string, seq int, grp int, length string"
    got = packing.pack(make([(d, t, 1, 2, "x") for d, t in rows], schema).repartition(5), PATH, 256).collect()
    check_pieces(got, rows, 256)
    assert packing.pack(make([]), PATH).count() == 0


def test_packing_merges_tasks_in_rounds(make, monkeypatch):
    monkeypatch.setattr(packing, "MERGE", 3)
    rows = [(i, prose(i, 40)) for i in range(60)]
    check_pieces(packing.pack(make(rows).repartition(20), PATH, 512).collect(), rows, 512)


def test_packing_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in registry.table(spark, SF, "documents").collect()]
    check_pieces(registry.QUERIES["op10_packing"](spark, SF).collect(), rows, 1024)


def test_placement_minimises_the_sum_of_squares():
    rng = random.Random(3)
    packer = packing.Packer(10, lambda n, w: None)
    for _ in range(300):
        s = rng.randrange(1, 11)
        before = packer.levels.copy()
        packer.add([(1, 0, np.zeros(s), s)], s)
        options = []
        for h in range(0, 10):
            if h == 0 or before[h]:
                if h + s <= 10:
                    after = before.copy()
                    after[h] -= h > 0
                    after[h + s] += h + s < 10
                    options.append((after[1:10] ** 2).sum())
        assert (packer.levels[1:10] ** 2).sum() == min(options) and packer.levels[10] == 0


# ---- near-dedup ---------------------------------------------------------------------------------

def counted(text):
    w = re.findall(r"\w+", (text or "").lower())
    k = min(5, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def slow_similarity(a, b):
    sa, sb = a.total(), b.total()
    return sum(1 / sum(max(a[y] / sa / (a[x] / sa), b[y] / sb / (b[x] / sb)) for y in a | b) for x in a if x in b)


def test_exact_similarity():
    rng = random.Random(0)
    for _ in range(60):
        a = Counter({i: rng.randrange(1, 5) for i in rng.sample(range(30), rng.randrange(1, 20))})
        b = Counter({i: rng.randrange(1, 5) for i in rng.sample(range(30), rng.randrange(1, 20))})
        arrays = [np.array(x) for c in (a, b) for x in zip(*sorted(c.items()))]
        assert minhash.probability_jaccard(*arrays) == pytest.approx(slow_similarity(a, b), abs=1e-12)


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    for n, shared, heavy in ((400, 300, 1), (30, 20, 4), (3, 2, 1)):
        a = rng.integers(1, 2**62, n).astype(np.uint64)
        b = np.concatenate([a[:shared], rng.integers(1, 2**62, n - shared).astype(np.uint64)])
        wa = np.where(np.arange(n) % 3 == 0, heavy, 1)
        sizes = 4000
        same = (minhash.signature(a, wa, sizes) == minhash.signature(b, wa, sizes)).mean()
        order_a, order_b = np.argsort(a), np.argsort(b)
        true = minhash.probability_jaccard(a[order_a], wa[order_a], b[order_b], wa[order_b])
        assert abs(same - true) < 0.05
    assert len(set(minhash.signature(np.array([7], dtype=np.uint64), np.array([1])).tolist())) == 1


def near_texts():
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = prose(1000 + g, rng.choice([12, 60, 200])).split()
        for c in range(rng.choice([1, 2, 6])):
            text = base[:]
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(len(text))] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    chain = prose(5, 300).split()
    for step in range(8):  # neighbours are alike, the ends are not
        rows.append((len(rows), " ".join(chain[step * 12:step * 12 + 200])))
    return rows


def test_classes_equal_all_pairs(make):
    rows = near_texts()
    rows += [(900, rows[0][1]), (901, rows[0][1].upper() + " !"), (902, None), (903, ""), (904, "..."), (905, "one"), (906, "One."), (None, rows[5][1]), (3, rows[3][1])]
    sets = [counted(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (sets[i] and sets[j] and slow_similarity(sets[i], sets[j]) >= 0.8) or (not sets[i] and not sets[j] and (rows[i][1] or "") == (rows[j][1] or "")):
                parent[find(i)] = find(j)
    group = {}
    for i in range(len(rows)):
        group.setdefault(find(i), []).append(i)
    want = Counter()
    for own in group.values():
        ids = [rows[i][0] for i in own]
        least = None if None in ids else min(ids)
        for i in own:
            want[rows[i][0], least, len(own)] += 1
    got = minhash.near_classes(make([(d, t, "x", 1, True) for d, t in rows], "doc_id bigint, text string, sig string, u int, is_first boolean")).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == want
    assert {r["class_id"] for r in got if r["is_first"]} == {r["class_id"] for r in got}
    assert minhash.near_classes(make([])).count() == 0


def test_buckets_that_span_classes_are_compared_further(make):
    """Texts of about 0.7 similarity share buckets with their first one but belong together otherwise."""
    rng = random.Random(3)
    core = prose(77, 120).split()
    rows = []
    for g in range(6):
        own = core + prose(500 + g, 22).split()
        for c in range(4):
            text = own[:]
            text[rng.randrange(60, 140)] = f"q{g}{c}"
            rows.append((len(rows), " ".join(text)))
    sets = [counted(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if slow_similarity(sets[i], sets[j]) >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(make(rows)).collect()}
    assert pairs and all(got[i] == got[j] for i, j in pairs)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["u"]: r["label"] for r in component_labels(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in parent}


# ---- decontamination -----------------------------------------------------------------------------

def brute_leaks(docs, items, least=0.8):
    best = {}
    for doc, text in docs:
        for item, said in items:
            wi = re.findall(r"\w+", (said or "").lower())
            wd = re.findall(r"\w+", (text or "").lower())
            if not wi:
                continue
            k = min(5, len(wi))
            si = Counter(tuple(wi[i:i + k]) for i in range(len(wi) - k + 1))
            sd = [tuple(wd[i:i + k]) for i in range(len(wd) - k + 1)]
            n = si.total()
            for p in range(max(1, len(sd) - n + 1)):
                window = Counter(sd[p:p + n])
                shared = (window & si).total()
                if window:
                    best[doc, item] = max(best.get((doc, item), 0), shared / (window.total() + n - shared))
    return {k: v for k, v in best.items() if v >= least}


def test_leaks_equal_brute_force(make):
    rng = random.Random(6)
    items = [(i, prose(i, n)) for i, n in enumerate([15, 15, 20, 31, 59, 59, 130, 6, 5, 3, 1])] + [(50, None), (51, "..."), (52, prose(3, 31))]
    docs = []
    for d in range(60):
        text = prose(100 + d, rng.choice([0, 5, 40, 300])).split()
        said = items[rng.randrange(11)][1].split()
        kind = d % 5
        if kind == 1:
            said[rng.randrange(len(said))] = "changed"
        if kind == 2:
            said = said[:-1 - len(said) // 12]
        if kind == 3:
            said = [w.upper() + "," for w in said]
        at = rng.randrange(len(text) + 1)
        docs.append((d, " ".join(text[:at] + (said if kind != 4 else []) + text[at:])))
    docs += [(200, items[4][1]), (201, " ".join(items[4][1].split()[:-3])), (202, None), (203, ""), (None, items[2][1]), (200, items[4][1])]
    got = leaks.find_leaks(make([(d, t, 5, "x") for d, t in docs], "doc_id bigint, text string, item_id int, similarity string"),
                           make(items, "item_id bigint, text string")).collect()
    want = brute_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want)
    for r in got:
        assert r["similarity"] == pytest.approx(want[r["doc_id"], r["item_id"]], abs=1e-12)
        assert r["bits_apart"] <= leaks.RADIUS
    assert len(want) > 30
    assert leaks.find_leaks(make([]), make(items, "item_id bigint, text string")).count() == 0
    assert leaks.find_leaks(make(docs), make([], "item_id bigint, text string")).count() == 0


def test_leaks_beyond_the_radius(make):
    """Edits in an item's middle part, and a shingle repeated ten times that is replaced: similar enough, yet far by SimHash."""
    rng = random.Random(9)
    items, docs = [], []
    for i in range(60):
        said = prose(1000 + i, 60 if i % 2 else 50 + i % 5).split() + (["again"] * 14 + prose(4000 + i, 60).split() if i % 2 else [])
        items.append((i, " ".join(said)))
        if i % 2:
            said[64:74] = [f"new{i}x{j}" for j in range(10)]
        else:
            said[len(said) // 2] = f"new{i}"
        before = prose(2000 + i, rng.choice([0, 9, 200])).split()
        docs.append((i, " ".join(before + said[:-2 if i % 6 == 0 else None] + (prose(3000 + i, 50).split() if before else []))))
    want = brute_leaks(docs, items)
    assert len(want) == 50
    got = leaks.find_leaks(make(docs), make(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"], abs=1e-12) for r in got} == want


def test_hamming_index_misses_none():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 2**63, 64).astype(np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64)) if n else np.uint64(0) for n in list(range(24)) * 20], dtype=np.uint64)
    queries = np.concatenate([items[rng.integers(0, 64, len(flips))] ^ flips, rng.integers(0, 2**63, 2000).astype(np.uint64)])
    at, item, apart = leaks.HammingIndex(items).search(queries)
    every = np.bitwise_count(queries[:, None] ^ items[None, :])
    assert set(zip(at.tolist(), item.tolist())) == set(zip(*[x.tolist() for x in np.nonzero(every <= leaks.RADIUS)]))
    assert (every[at, item] == apart).all()


@pytest.mark.parametrize("size", [1, 2, 7, 100, 127, 128, 1000])
def test_rolling_simhash(size):
    hashes = np.random.default_rng(size).integers(0, 2**63, 1200).astype(np.uint64)
    bits = (hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    got = leaks.Totals(hashes, size).simhash(size)
    assert len(got) == 1201 - size
    totals = leaks.Totals(hashes, size)
    # Which bit a counter stands for follows from a single hash: its SimHash is itself.
    assert (totals.simhash(1) == hashes).all()
    for p in (0, 5, 1200 - size):
        want = (bits[p:p + size].sum(axis=0) > size // 2).astype(np.uint64)
        assert int(got[p]) == sum(int(b) << i for i, b in enumerate(want))


def test_passes_are_bounded(make, monkeypatch):
    monkeypatch.setattr(leaks, "PASS_ITEMS", 3)
    items = [(i, prose(i, 20)) for i in range(10)]
    docs = [(i, "x " + prose(i, 20)) for i in range(10)]
    got = leaks.find_leaks(make(docs), make(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(10)}


# ---- language ----------------------------------------------------------------------------------

def test_language_accuracy_on_held_out_rows(spark):
    docs = {r["doc_id"]: r["lang"] for r in registry.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = registry.QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in docs if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(make):
    rows = [("aa", "abra kadabra " * 5)] * 3 + [("zz", "zyx wvu zyx " * 5)] * 3 + [(None, "abc"), ("aa", None), ("aa", "123"), ("qq", "...")]
    model = language.train(make(rows, "lang string, text string"))
    assert model.languages == ["aa", "zz"]
    docs = make([(1, "Kadabra abra", "x"), (2, "wvu zyx", None), (3, None, ""), (4, "", ""), (5, "12 .", ""), (1, "Kadabra abra", "x"), (None, "a", "")],
                "doc_id bigint, text string, lang_pred string")
    got = language.predict(docs, model).select("row.doc_id", "row.lang_pred", F.col("lang_pred").alias("p"), "score").collect()
    assert [(r["doc_id"], r["p"]) for r in got][:6] == [(1, "aa"), (2, "zz"), (3, "und"), (4, "und"), (5, "und"), (1, "aa")]
    assert got[0]["lang_pred"] == "x" and got[2]["score"] == 0
    nothing = language.train(make([], "lang string, text string"))
    assert [r["lang_pred"] for r in language.predict(make([(1, "abc")]), nothing).collect()] == ["und"]
    assert language.predict(make([]), model).count() == 0


def test_copies_of_a_text_count_once(make):
    """One text copied more often than the share, first in hash order, and a language of two texts with thousands of copies."""
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(6)) for _ in range(40)]
    first = make(list(enumerate(texts))).orderBy(F.xxhash64("text")).first()["text"]
    rows = [("aa", t) for t in texts] + [("aa", first)] * 30 + [("zz", t) for t in ("zyx wvu zyx", "uvw xyz")] * 3000
    model = language.train(make(rows, "lang string, text string"), train_rows=20, landmarks=20)
    assert model.languages == ["aa", "zz"]
    assert len(model.landmarks) == len(np.unique(model.landmarks, axis=0)) == 10 + 2


def test_kernel_is_the_presence_kernel():
    a, b = language.presence("Hallo, Welt!"), language.presence("hallo... welten")
    model = language.fit([("x", a), ("y", b)])
    k = model.kernel([a, b])
    assert k[0, 1] == pytest.approx(len(np.intersect1d(a, b)) / (len(a) * len(b)) ** 0.5, abs=1e-5) and k[0, 0] == pytest.approx(1, abs=1e-5)
    assert len(language.presence("ab")) == len({" ", "a", "b", " a", "ab", "b ", " ab", "ab ", " ab "})


def test_shingles():
    assert len(words.shingles(words.word_hashes("a b c d e f"))) == 2
    assert len(words.shingles(words.word_hashes("a b"))) == 1
    assert len(words.shingles(words.word_hashes("..."))) == 0


def test_pairs_across_classes_are_few_and_hold_all_links(make):
    """A group of texts 0.6 to 0.9 alike: no link is lost, and pairs that cannot be links are hardly formed."""
    rng = random.Random(8)
    core = prose(91, 150).split()
    rows = []
    for i in range(240):
        text = core[:]
        for at in rng.sample(range(150), rng.randrange(2, 10)):
            text[at] = f"z{rng.randrange(900)}"
        rows.append((i, i % 200, " ".join(text)))
    rows += [(300, 300, "one two"), (301, 301, "one two one two one two one two")]
    sets = {u: minhash._weighted(t) for u, _, t in rows}
    links = {(a, b) for a, la, _ in rows for b, lb, _ in rows if a < b and la != lb and minhash.probability_jaccard(*sets[a], *sets[b]) >= 0.8}
    got = {(r["u"], r["v"]) for r in minhash._across(make(rows, "u bigint, label bigint, text string"), 0.8).collect()}
    every = sum(la != lb for a, la, _ in rows for b, lb, _ in rows if a < b)
    assert links and links <= got
    assert len(got) < every / 10


def test_edited_copies_are_compared_where_their_edits_agree(make):
    """Words replaced, left out or added, ends cut off, parts repeated, in copies of two texts: no link is lost, whatever the references."""
    rng = random.Random(11)
    cores = [prose(92, 130).split(), prose(93, 90).split()]
    rows = [(i, i, i, " ".join(core)) for i, core in enumerate(cores)]
    for i in range(2, 260):
        core = i % 2 if i < 240 else 0
        text = cores[core][:]
        for _ in range(rng.randrange(1, 6)):
            at, how = rng.randrange(len(text)), rng.randrange(5)
            if how < 2:
                text[at] = f"y{rng.randrange(3)}" if how else f"y{i}"
            elif how == 2:
                del text[at:at + rng.randrange(1, 4)]
            elif how == 3:
                text = text[:len(text) - rng.randrange(12)]
            else:
                text += text[at:at + rng.randrange(5, 40)] * rng.randrange(1, 3)
        rows.append((i, i % 150 if i % 3 else 0, core if i % 20 else 1 - core, " ".join(text)))
    sets = {u: minhash._weighted(t) for u, _, _, t in rows}
    every = [(a, b) for a, la, _, _ in rows for b, lb, _, _ in rows if a < b and la != lb]
    links = {(a, b) for a, b in every if minhash.probability_jaccard(*sets[a], *sets[b]) >= 0.8}
    crowd = make(rows, "u bigint, label bigint, ref bigint, text string")
    got = {(r["u"], r["v"]) for r in minhash._across(crowd, 0.8, crowd.where("u < 2").select("u", "text")).collect()}
    assert len(links) > 1000 and links <= got <= set(every)


def test_pairs_of_edited_copies_grow_with_the_copies(make, monkeypatch):
    """Copies of one text with a few words replaced, 0.6 to 0.9 like each other: pairs across classes are fewer than the copies."""
    rng = random.Random(12)
    core = prose(94, 150).split()
    rows = [(0, " ".join(core))]
    for i in range(1, 300):
        text = core[:]
        for at in rng.sample(range(150), rng.randrange(1, 8)):
            text[at] = f"x{i}at{at}"
        rows.append((i, " ".join(text)))
    sets = [minhash._weighted(t) for _, t in rows]
    formed, verified = [], minhash._verified

    def counted_pairs(pairs, *args):
        formed.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(minhash, "_verified", counted_pairs)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(make(rows)).collect()}
    linked = [(i, j) for i in range(300) for j in range(i) if minhash.probability_jaccard(*sets[i], *sets[j]) >= 0.8]
    assert all(got[i] == got[j] for i, j in linked) and 50 < len(set(got.values())) < 250
    assert len(formed) == 2 and formed[1] < 300
