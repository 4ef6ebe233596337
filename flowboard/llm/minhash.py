"""Near-dedup: ProbMinHash signatures, banding, exact verification, classes of linked documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowboard.llm.common import cut, drop, hash_pair
from flowboard.llm.components import component_labels

#: Signature length: BANDS bands of ROWS components. A pair of similarity 0.8 meets in some band with 1 - (1 - 0.8^4)^20, all but 3 in 100,000.
BANDS, ROWS = 20, 4
SIGNATURE = BANDS * ROWS
SIMILARITY = 0.8
#: Standard deviations below the threshold from which the estimate rules a pair out.
SLACK = 4.5
#: Cells that count shingles of texts in crowded buckets, to compare by rare ones first.
CELLS = 1 << 20
BLOCK = 1 << 10
#: So many times as much weight as its reference a text may have, else it is compared without one.
LONGER = 1.25


def signature(elements: np.ndarray, weights: np.ndarray, size: int = SIGNATURE) -> np.ndarray:
    """ProbMinHash of a weighted set: two agree in a component with their probability Jaccard similarity.

    Each element is a Poisson process of rate `weight`: its points arrive at exponential
    distances and fall into a random component each; a component keeps the element of its first
    point. Points are drawn in rounds for all elements at once, and an element stops at the first point beyond the
    latest of all components' first points, since no later one can matter. Draws
    depend on the element and the number of the point only.
    """
    from flowboard.llm.words import mix

    first = np.full(size, np.inf)
    owner = np.zeros(size, dtype=np.uint64)
    live, time, rate, drawn = elements, np.zeros(len(elements)), weights.astype(np.float64), 0
    while len(live):
        many = max(1, -(-2 * size // len(live))) if drawn == 0 else max(1, size // (2 * len(live)))
        count = np.arange(drawn, drawn + many, dtype=np.uint64)
        drawn += many
        bits = mix(live[:, None] + count * np.uint64(0xD1342543DE82EF95) + np.uint64(0x632BE59BD9B4E019))
        gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / rate[:, None]
        when = time[:, None] + np.cumsum(gap, axis=1)
        slot = ((mix(bits ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        time = when[:, -1]
        latest = first.max()
        when, slot, who = when.ravel(), slot.ravel(), np.repeat(live, many)
        soon = np.flatnonzero(when < latest)
        when, slot, who = when[soon], slot[soon], who[soon]
        # The least per component, without sorting; of equal points the earlier one stays.
        least = first.copy()
        np.minimum.at(least, slot, when)
        won = np.flatnonzero((when == least[slot]) & (when < first[slot]))[::-1]
        owner[slot[won]] = who[won]
        first = least
        stay = time < first.max()
        live, time, rate = live[stay], time[stay], rate[stay]
    return owner


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets (sorted distinct elements).

    The sum over shared x of 1 / sum over y of max(p(y) / p(x), q(y) / q(x)) for the weights p, q
    scaled to sum 1. The inner sum splits at the ratio p / q of x. Equal weights of
    equal sums give the plain Jaccard similarity. Two empty sets are alike.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    p, q = wa / wa.sum(), wb / wb.sum()
    ps, qs = p[ia], q[ib]
    ratio = ps / qs
    order = np.argsort(ratio)
    ps, qs, ratio = ps[order], qs[order], ratio[order]
    only_p, only_q = max(0.0, 1 - ps.sum()), max(0.0, 1 - qs.sum())
    # For x in this order: y from x on (and those of a alone) count p(y) / p(x), the others q(y) / q(x).
    p_from = np.cumsum(ps[::-1])[::-1] + only_p
    q_before = np.cumsum(qs) - qs + only_q
    return float((1 / (p_from / ps + q_before / qs)).sum())


def _weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
    from flowboard.llm.words import shingles, word_hashes

    return np.unique(shingles(word_hashes(text)), return_counts=True)


def _sketches(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, t1, t2 (hashes of the text), c1, c2 (hashes of its words), sig (null without words)."""
    t1, t2 = hash_pair(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), t1.alias("t1"), t2.alias("t2"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        from flowboard.llm.words import shingles, word_hashes

        for batch in batches:
            content, sigs = [], []
            for text, t1, t2 in zip(batch["text"], batch["t1"], batch["t2"]):
                words = word_hashes(text)
                if len(words):
                    raw = xxhash.xxh3_128_digest(words.tobytes())
                    content.append(np.frombuffer(raw, dtype="<i8"))
                    sigs.append(signature(*np.unique(shingles(words), return_counts=True)).astype(np.uint32).view(np.int32))
                else:
                    content.append(np.array([t1, t2]))
                    sigs.append(None)
            c = np.array(content, dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "t1": batch["t1"], "t2": batch["t2"], "c1": c[:, 0], "c2": c[:, 1], "sig": sigs})

    return rows.mapInPandas(run, "doc_id bigint, t1 bigint, t2 bigint, c1 bigint, c2 bigint, sig array<int>")


def _texts(members: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, text) of the nodes that share a band with another: the only texts that are ever compared."""
    named = members.select("u").distinct().join(nodes.select("u", "doc_id", "t1", "t2"), "u")
    t1, t2 = hash_pair(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("d"), t1.alias("h1"), t2.alias("h2"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # Always sort-merge, so that text moves in proportion to the input at every size.
    found = texts.hint("merge").join(named, (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("d")))
    return cut(found.select("u", "text").dropDuplicates(["u"]))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (u, v) whose texts are similar enough, as (u, v).

    Signatures of both rule out what is far below the threshold; only texts of the remaining pairs are moved.
    """
    floor = least - SLACK * (least * (1 - least) / SIGNATURE) ** 0.5
    sig = nodes.select("u", "sig")
    near = pairs.join(sig.withColumnRenamed("sig", "sig_u"), "u").join(sig.select(F.col("u").alias("v"), F.col("sig").alias("sig_v")), "v")
    agree = F.size(F.filter(F.zip_with("sig_u", "sig_v", lambda a, b: a == b), lambda x: x))
    near = cut(near.where(agree >= floor * SIGNATURE).select("u", "v"))
    of = cut(texts.join(near.select("u").union(near.select("v")).distinct(), "u", "left_semi"))
    both = near.join(of.select(F.col("u").alias("v"), F.col("text").alias("text_v")), "v").join(of.withColumnRenamed("text", "text_u"), "u")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for batch in batches:
            keep = []
            for u, a, b in zip(batch["u"], batch["text_u"], batch["text_v"]):
                if u != last:
                    last, held = u, _weighted(a)
                keep.append(probability_jaccard(*held, *_weighted(b)) >= least - 1e-12)
            yield batch.loc[keep, ["u", "v"]]

    linked = cut(both.select("u", "v", "text_u", "text_v").mapInPandas(run, "u bigint, v bigint"))
    drop(texts.sparkSession, of)
    drop(texts.sparkSession, near)
    return linked


def _across(crowd: DataFrame, least: float, texts: DataFrame | None = None) -> DataFrame:
    """(u, v), u < v: all pairs of different labels in `crowd` (u, label, text) that may reach `least`, and few others.

    Let a and b be the shares of two texts' weight on shingles the other lacks. Then their probability Jaccard is at most
    1 / (1 + a / (1 - a) + b / (1 - b)): in the sum over shared x, the inner maxima are no less than the shingles of one side
    alone plus those of the other, and what follows is concave in the shared weights. So the odds of a and b, added, are at
    most 1 / `least` - 1. Order all features of texts in one way, the same for all texts. What precedes the first shared one is not shared, and of what
    follows, one text's surplus in number is not. Pairs are joined on features where the odds of these parts allow a link. Any order
    loses nothing; rare ones first keeps the pairs few. Counts for the order are kept in CELLS cells, a table of fixed size.

    Texts with different references are joined on their shingles. Those with the same one (`ref`, the `u` of one of `texts`) are joined on what parts them from
    it: shingles they add, then shingles they leave out, then a last one that all have. A shingle added by one alone is
    missing in the other, one left out by one alone is the other's own. Two edited copies of a text share nearly all shingles, but few of
    their edits, so they meet here only where their edits agree, not because they stem from the same text.
    """
    room = 1 / least - 1 + 1e-9

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(cells, (_weighted(text)[0] % np.uint64(CELLS)).astype(np.int64), 1)
        used = np.flatnonzero(cells)
        yield pd.DataFrame({"cell": used, "n": cells[used]})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at, n in zip(batch["at"], batch["n"]):
                part = np.zeros(BLOCK, dtype="<u4")
                part[np.asarray(at, dtype=np.int64)] = np.minimum(np.asarray(n, dtype=np.int64), 0xFFFFFFFF)
                out.append(part.tobytes())
            yield pd.DataFrame({"block": batch["block"], "part": out})

    # The driver gets CELLS numbers of 4 bytes, in CELLS / BLOCK rows, whatever the size of the table.
    summed = crowd.select("text").mapInPandas(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    blocks = summed.groupBy(F.shiftright("cell", BLOCK.bit_length() - 1).alias("block")).agg(F.collect_list(F.struct((F.col("cell") % BLOCK).alias("at"), "n")).alias("cells"))
    blocks = blocks.select("block", "cells.at", "cells.n").mapInPandas(packed, "block bigint, part binary")
    cells = np.zeros(CELLS, dtype="<u4")
    for row in blocks.collect():
        cells[row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(row["part"], dtype="<u4")
    shared = crowd.sparkSession.sparkContext.broadcast(cells)

    def fronts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rarity = lambda x: shared.value[(x % np.uint64(CELLS)).astype(np.int64)].astype(np.int64)
        last, held, most = None, None, None
        for batch in batches:
            rows = []
            for u, label, ref, text, ref_text in zip(batch["u"], batch["label"], batch["ref"], batch["text"], batch["ref_text"]):
                if ref != last:
                    held, weights = _weighted(ref_text)
                    last, most = ref, LONGER * weights.sum()
                x, w = _weighted(text)
                n = w.sum()
                part = ref if n <= most else -1 - u  # what is much longer has no reference
                order = np.lexsort((x, rarity(x)))
                before = np.concatenate([[0], np.cumsum(w[order])[:-1]]) / n
                front = int(np.searchsorted(before / (1 - before), room, side="right"))
                at = np.arange(front)
                rows.append((np.full(front, -1), x[order[:front]].view(np.int64), np.full(front, part), before[:front], 0 * at, len(x) - at, 0 * at, u, label, n))
                if part != ref:
                    continue
                own = ~np.isin(x, held, assume_unique=True)
                more, less = x[own], held[~np.isin(held, x, assume_unique=True)]
                order, gone = np.lexsort((more, rarity(more))), np.lexsort((less, -rarity(less)))
                features = np.concatenate([more[order].view(np.int64), ~less[gone].view(np.int64), [0]])
                at = np.arange(len(features))
                added, left_out = np.minimum(at, len(more)), np.maximum(at - len(more), 0)
                before = np.concatenate([[0], np.cumsum(w[own][order])])[added] / n
                with np.errstate(divide="ignore"):
                    front = int(np.searchsorted(before / (1 - before) + left_out / np.maximum(most - left_out, 0), room, side="right"))
                rows.append((np.full(front, ref), features[:front], np.full(front, label), before[:front], left_out[:front], (len(more) - added)[:front],
                             (len(less) - left_out)[:front], u, label, n))
            if rows:
                sizes = [len(r[0]) for r in rows]
                out = dict(zip(("space", "x", "part", "before", "out_before", "to_come", "out_to_come"), map(np.concatenate, list(zip(*rows))[:7])))
                yield pd.DataFrame(out | {c: np.repeat([r[i] for r in rows], sizes) for i, c in ((7, "u"), (8, "label"), (9, "n"))})

    if texts is None:
        of = crowd.select("*", (-1 - F.col("u")).alias("ref"), F.lit("").alias("ref_text"))
    else:
        of = crowd.join(texts.select(F.col("u").alias("ref"), F.col("text").alias("ref_text")), "ref")
    kept = "before double, out_before int, to_come int, out_to_come int"
    front = cut(of.select("u", "label", "ref", "text", "ref_text").mapInPandas(fronts, f"space bigint, x bigint, part bigint, {kept}, u bigint, label bigint, n bigint"))
    # Parted by reference among all texts, by label among those of one reference. Of two parts at a feature, one is not its commonest there: a large part never meets itself.
    key = ["space", "x"]
    per = front.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("many")).groupBy(*key).agg(
        F.max_by("part", F.struct("many", "part")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select(*key, "most")
    met = cut(front.join(per, key))
    drop(crowd.sparkSession, front)
    less = met.where("part <> most").select(*key, *[F.col(c).alias(f"v_{c}") for c in ("part", "before", "out_before", "to_come", "out_to_come", "u", "label", "n")])

    def odds(mine: str, other: str):
        surplus = F.greatest(F.col(f"{mine}to_come") - F.col(f"{other}to_come"), F.lit(0)) + F.greatest(F.col(f"{other}out_to_come") - F.col(f"{mine}out_to_come"), F.lit(0))
        share = F.col(f"{mine}before") + (F.col(f"{other}out_before") + surplus) / F.col(f"{mine}n")
        return F.when(share < 1, share / (1 - share))  # null: nothing is shared

    both = met.join(less, key).where((F.col("part") != F.col("v_part")) & (F.col("label") != F.col("v_label")) & (odds("", "v_") + odds("v_", "") <= room))
    return both.select(F.least("u", "v_u").alias("u"), F.greatest("u", "v_u").alias("v")).distinct()


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Class of every document: doc_id, t1, t2 (hashes of its text), class_id, class_size, is_first.

    Two texts are linked if the probability Jaccard similarity of their five-word shingles,
    weighted by count, is `similarity` or more; classes are what links connect. `class_id` is the
    least doc_id of the class (nulls first), `is_first` marks its document. Texts of the same words are one node from
    the start, however many copies there are; texts without words are alike only if equal. Rows with the same doc_id and text are
    one document and get the same values. An empty table gives no rows.

    Nodes that share a band meet in a bucket. First each bucket's hub, the node that shares most
    buckets with most others, is compared with all others. Where a bucket still spans several classes, its nodes are compared
    across classes, but only those pairs that an exact bound on their rarest shingles and edits allows to be similar enough (`_across`). No pair
    within a class is formed there, no link across classes is left out, and no bucket is held in one task.
    """
    spark = docs.sparkSession
    sketched = cut(_sketches(docs))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "t1", "t2")
    nodes = sketched.groupBy("c1", "c2").agg(F.min(place).alias("at"), F.first("sig").alias("sig"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("u"), "c1", "c2", "at.doc_id", "at.t1", "at.t2", "sig"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * ROWS + 1, F.lit(ROWS))))
    members = nodes.where("sig is not null").select("u", F.explode(bands).alias("bucket"))
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(members.join(full, "bucket"))
    # A text that others were made from shares bands with more of them than they do with each other.
    rank = members.groupBy("u").agg(F.sum("n").alias("met"))
    ranked = cut(members.select("bucket", "u").join(rank, "u"))
    drop(spark, members)
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("met", (-F.col("u")).alias("u"))).alias("top")).select("bucket", "top", (-F.col("top.u")).alias("hub"))
    members = cut(ranked.join(hubs, "bucket"))
    drop(spark, ranked)
    pair = [F.least("u", "hub").alias("u"), F.greatest("u", "hub").alias("v")]
    tested = cut(members.where("u <> hub").select(*pair).distinct())
    texts = _texts(members, nodes, docs)
    links = _verified(tested, nodes, texts, similarity)
    labels = cut(component_labels(links))
    # Buckets that still span classes: their nodes are compared across classes where an exact bound allows a link.
    of = members.select("bucket", "u").join(labels, "u", "left").select("bucket", "u", F.coalesce("label", "u").alias("label"))
    mixed = of.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("bucket")
    # The hub that meets most is what an edited copy is described by.
    refs = members.groupBy("u").agg((-F.max("top").getField("u")).alias("ref"))
    crowd = cut(texts.join(of.join(mixed, "bucket", "left_semi").select("u", "label").distinct().join(refs, "u"), "u"))
    pairs = cut(_across(crowd, similarity, texts).join(tested, ["u", "v"], "left_anti"))
    linked = _verified(pairs, nodes, texts, similarity)
    if not linked.isEmpty():
        labels = cut(component_labels(links.unionByName(linked)))
    drop(spark, crowd)
    drop(spark, texts)
    named = nodes.join(labels, "u", "left").select(
        "c1", "c2", F.coalesce("label", "u").alias("label"), place.alias("node_at"))
    sizes = sketched.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"))
    classes = named.join(sizes, ["c1", "c2"]).groupBy("label").agg(F.min("node_at").alias("first"), F.sum("n").alias("class_size"))
    by_words = cut(named.select("c1", "c2", "label").join(classes, "label"))
    out = sketched.select("doc_id", "t1", "t2", "c1", "c2").join(by_words, ["c1", "c2"])
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))
    return out.select("doc_id", "t1", "t2", F.col("first.doc_id").alias("class_id"), F.col("class_size").cast("bigint").alias("class_size"), same.alias("is_first"))
