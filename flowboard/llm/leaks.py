"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowboard.llm.common import cut, hash_pair

SIMILARITY = 0.8
#: Fingerprints this many of 64 bits apart, or fewer, are compared exactly. Similarity 0.8 puts
#: them 10 apart with a deviation of 3.
RADIUS = 16
BLOCKS = 4
#: Benchmark items searched for in one pass over the documents; more items take more passes.
PASS_ITEMS, PASS_CHARS = 4096, 16_000_000
#: Window sizes grow by this factor; an item is searched by its middle part of the next smaller size.
GROWTH = 1.25
#: Pairs of a shingle's place and an item looked at together.
_PAIRS = 1 << 20
#: Words handled at once: windows of many short documents are computed together.
_AT_ONCE = 1 << 15
_ONES = np.uint64(0x0101010101010101)


def window_sizes(longest: int) -> list[int]:
    """1, 2, 3, ... growing by GROWTH, up to `longest`."""
    sizes = [1]
    while max(sizes[-1] + 1, int(sizes[-1] * GROWTH)) <= longest:
        sizes.append(max(sizes[-1] + 1, int(sizes[-1] * GROWTH)))
    return sizes


class Totals:
    """Running totals of the 64 bits of shingle hashes, from which any window's SimHash follows.

    Counters of `width` bits (8, 16 or 32) lie side by side in 64-bit words. Totals overflow into each
    other, yet the difference of two of them is exact wherever the window's own counts fit.
    """

    def __init__(self, hashes: np.ndarray, longest: int):
        self.width = 8 if longest < 128 else 16 if longest < 1 << 15 else 32
        lanes = 64 // self.width
        low = _ONES if self.width == 8 else np.uint64(sum(1 << (self.width * i) for i in range(lanes)))
        self.high = low << np.uint64(self.width - 1)
        self.low = low
        # Word k holds bit k of each group of `width` bits.
        self.words = np.zeros((self.width, len(hashes) + 1), dtype=np.uint64)
        for k in range(self.width):
            np.cumsum((hashes >> np.uint64(k)) & low, out=self.words[k, 1:])

    def simhash(self, size: int) -> np.ndarray:
        """Fingerprint of every window of `size` shingles: bits set in more than half of them."""
        n = self.words.shape[1] - size
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        # Adding this carries into the top bit of a counter if it exceeds size // 2.
        lift = self.low * np.uint64((1 << (self.width - 1)) - 1 - size // 2)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(self.width):
            got = self.words[k, size:] - self.words[k, :n]
            got += lift
            got &= self.high
            got >>= np.uint64(self.width - 1 - k)
            out |= got
        return out


class HammingIndex:
    """Up to 64 fingerprints, found again by any fingerprint within `radius`.

    The 64 bits are cut into BLOCKS blocks. Two fingerprints within the radius differ in some block b by at most
    t(b) bits where the t(b) + 1 add up to radius + 1. For each block, a table maps every value to
    the set (one bit each) of items whose value differs by no more; the union over blocks misses none.
    """

    def __init__(self, fingerprints: np.ndarray, radius: int = RADIUS):
        self.fingerprints, self.radius = fingerprints, radius
        bits, shares = 64 // BLOCKS, [(radius + 1) // BLOCKS + (b < (radius + 1) % BLOCKS) for b in range(BLOCKS)]
        every = np.arange(1 << bits, dtype=np.uint64)
        far = np.bitwise_count(every)
        self.tables = []
        for b, share in enumerate(shares):
            table, flips = np.zeros(1 << bits, dtype=np.uint64), every[far < share]
            for i, f in enumerate(fingerprints.tolist()):
                table[np.uint64((f >> (bits * b)) & ((1 << bits) - 1)) ^ flips] |= np.uint64(1 << i)
            self.tables.append(table)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, item, distance) of all pairs within the radius."""
        # Little-endian halfwords are the blocks, from the lowest bits up.
        blocks = np.ascontiguousarray(queries.astype("<u8").view("<u2").reshape(-1, BLOCKS).T).astype(np.intp)
        sets = self.tables[0].take(blocks[0])
        for table, block in zip(self.tables[1:], blocks[1:]):
            sets |= table.take(block)
        found = []
        at = np.flatnonzero(sets)
        sets, asked = sets.take(at), queries.take(at)
        while len(at):
            rest = sets & (sets - np.uint64(1))
            item = np.bitwise_count((sets ^ rest) - np.uint64(1))
            distance = np.bitwise_count(asked ^ self.fingerprints.take(item))
            hit = np.flatnonzero(distance <= self.radius)
            found.append((at[hit], item[hit].astype(np.int64), distance[hit]))
            more = np.flatnonzero(rest)
            at, sets, asked = at.take(more), rest.take(more), asked.take(more)
        if not found:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*found))


class Items:
    """One pass's benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, similarity: float = SIMILARITY):
        from flowboard.llm.words import SHINGLE, shingles, word_hashes

        self.ids, self.lists, self.counts = [], [], []
        ks = []
        for item, text in items:
            words = word_hashes(text)
            if len(words):
                self.ids.append(item)
                self.lists.append(shingles(words))
                self.counts.append(Counter(self.lists[-1].tolist()))
                ks.append(min(SHINGLE, len(words)))
        self.radius, self.by_k = radius, {}
        self.sizes = np.array([len(x) for x in self.lists], dtype=np.int64)
        #: Of each item: its shingles in order with their counts, and what its fingerprint was made of.
        self.sorted = [np.unique(x, return_counts=True) for x in self.lists]
        self.prints: dict[int, tuple[int, int, np.uint64]] = {}
        for k in set(ks):
            own = [i for i, x in enumerate(ks) if x == k]
            longest = max(len(self.lists[i]) for i in own)
            sizes = window_sizes(longest)
            classes: dict[int, list[int]] = {}
            for i in own:
                classes.setdefault(max(s for s in sizes if s <= len(self.lists[i])), []).append(i)
            index = []
            for size, members in sorted(classes.items()):
                for at in range(0, len(members), 64):
                    some = members[at:at + 64]
                    skips = [(len(self.lists[i]) - size) // 2 for i in some]
                    prints = np.array([Totals(self.lists[i][s:s + size], size).simhash(size)[0] for i, s in zip(some, skips)], dtype=np.uint64)
                    index.append((size, np.array(some), np.array(skips), HammingIndex(prints, radius)))
                    self.prints.update({i: (size, s, f) for i, s, f in zip(some, skips, prints)})
            # Low bits of all shingles in any item: an upper bound on what a window can share with one.
            known = np.zeros(1 << 20, dtype=bool)
            for i in own:
                known[(self.lists[i] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            whole = np.array([Totals(self.lists[i], len(self.lists[i])).simhash(len(self.lists[i]))[0] for i in own], dtype=np.uint64)
            self.by_k[k] = (longest, index, known, np.array(own), whole, np.array([len(self.lists[i]) for i in own]), self._rare(own, similarity))

    def _rare(self, own: list[int], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shingles without which no text is similar to an item: (shingles in order, where each one's items begin, items, low bits).

        What is similar to an item of n shingles shares `similarity` * n of them at least, by count, so it holds one of any n + 1
        less that many. Those in the fewest items are taken.
        """
        held = Counter(x for i in own for x in self.sorted[i][0].tolist())
        pairs = set()
        for i in own:
            n = len(self.lists[i])
            rarest = sorted(self.lists[i].tolist(), key=lambda x: (held[x], x))[:n - int(np.ceil(similarity * n - 1e-9)) + 1]
            pairs.update((x, i) for x in rarest)
        ordered = sorted(pairs)
        keys, begins = np.unique(np.array([x for x, _ in ordered], dtype=np.uint64), return_index=True)
        low = np.zeros(1 << 20, dtype=bool)
        low[(keys & np.uint64(len(low) - 1)).astype(np.int64)] = True
        return keys, np.append(begins, len(ordered)), np.array([i for _, i in ordered], dtype=np.int64), low


def _similarity(window: Counter, item: Counter) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    shared = sum(min(n, item[x]) for x, n in window.items() if x in item)
    return shared / (window.total() + item.total() - shared)


def _best(hashes: np.ndarray, starts: range, size: int, item: Counter) -> tuple[float, int]:
    """Most similar window of `size` shingles that begins at one of `starts`, and where it begins; the first of equals."""
    best, where = -1.0, 0
    window: Counter = Counter()
    for s in starts:
        if not window:
            window = Counter(hashes[s:s + size].tolist())
        else:
            window[int(hashes[s + size - 1])] += 1
            window[int(hashes[s - 1])] -= 1
        now = _similarity(window, item)
        if now > best:
            best, where = now, s
    return best, where


def _overlaps(hashes: np.ndarray, size: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many shingles every window of `size` shares with an item, by count.

    A place counts in the windows that hold it and fewer places of the same shingle before it than the item has.
    """
    which = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    at = np.flatnonzero(keys[which] == hashes)
    at = at[np.argsort(which[at], kind="stable")]
    which = which[at]
    back = np.arange(len(at)) - counts[which]
    full = (back >= 0) & (which[np.maximum(back, 0)] == which)
    since = np.maximum(np.where(full, at[np.maximum(back, 0)] + 1, 0), at - size + 1)
    change = np.bincount(since, minlength=len(hashes) + 1) - np.bincount(at + 1, minlength=len(hashes) + 1)
    return np.cumsum(change)[:len(hashes) - size + 1]


def _sharing(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, shared: np.ndarray, rare: tuple, items: Items, similarity: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first, last place) around shingles from `rare`, in texts that hold enough known ones there; misses none."""
    keys, starts, members, low_bits = rare
    places = np.flatnonzero(low_bits[(hashes & np.uint64(len(low_bits) - 1)).astype(np.int64)])
    which = np.minimum(np.searchsorted(keys, hashes[places]), len(keys) - 1)
    hit = keys[which] == hashes[places]
    places, which = places[hit], which[hit]
    many = starts[which + 1] - starts[which]
    for part in np.split(np.arange(len(places)), np.flatnonzero(np.diff(np.cumsum(many) // _PAIRS)) + 1):
        n_items = many[part]
        item = members[np.repeat(starts[which[part]] - np.cumsum(n_items) + n_items, n_items) + np.arange(n_items.sum())]
        at = np.repeat(places[part], n_items)
        text, n = np.searchsorted(ends, at, side="right"), items.sizes[item]
        low, high = np.maximum(at - n + 1, begins[text]), np.minimum(at + n, ends[text])
        likely = shared[high] - shared[low] >= np.ceil(similarity * n - 1e-9)
        at, text, item, n = at[likely], text[likely], item[likely], n[likely]
        order = np.lexsort((at, item, text))
        at, text, item, n = at[order], text[order], item[order], n[order]
        opens = np.ones(len(at), dtype=bool)
        opens[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(at) >= n[1:])
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(at)) - 1
        yield from zip(text[first].tolist(), item[first].tolist(), at[first].tolist(), at[last[:len(first)]].tolist())


def search_texts(words: list[np.ndarray], items: Items, similarity: float) -> list[tuple[int, int, float, int, int, int]]:
    """(text, item, similarity, first word, words, bits apart) of every leak; the best window for each text and item."""
    from flowboard.llm.words import shingles

    best: dict[tuple[int, int], tuple] = {}

    def keep(text: int, item: int, like: float, at: int, n: int, apart: int) -> None:
        if like >= similarity - 1e-12 and like > best.get((text, item), (0.0,))[0]:
            best[text, item] = (like, at, n, apart)

    for k, (longest, index, known, own, whole, lengths, rare) in items.by_k.items():
        kept = [(i, shingles(w, k)) for i, w in enumerate(words) if len(w) >= k]
        if not kept:
            continue
        # Windows that lie within one text.
        sizes = np.array([len(h) for _, h in kept])
        ends = np.cumsum(sizes)
        begins, hashes = ends - sizes, np.concatenate([h for _, h in kept])
        totals = Totals(hashes, longest)
        shared = np.concatenate([[0], np.cumsum(known[(hashes & np.uint64(len(known) - 1)).astype(np.int64)])])
        hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for size, members, skips, table in index:
            at, found, apart = table.search(totals.simhash(size))
            text = np.searchsorted(ends, at, side="right")
            item, n = members[found], np.array([len(items.lists[i]) for i in members])[found]
            first = at - skips[found]
            low, high = np.maximum(first - n // 8 - 1, begins[text]), np.minimum(first + n + n // 8 + 1, ends[text])
            likely = (at + size <= ends[text]) & (shared[np.maximum(high, low)] - shared[low] >= np.ceil(similarity * n - 1e-9))
            for t, i, f, a in zip(text[likely].tolist(), item[likely].tolist(), first[likely].tolist(), apart[likely].tolist()):
                hits.setdefault((t, i), []).append((f, a))
        for (t, i), places in hits.items():
            n = len(items.lists[i])
            last = int(ends[t]) - n
            for f, a in _clusters(places, n):
                low, high = max(f[0] - n // 8 - 1, int(begins[t])), min(f[1] + n // 8 + 1, last)
                if low <= high:
                    like, where = _best(hashes, range(low, high + 1), n, items.counts[i])
                    keep(kept[t][0], i, like, where - int(begins[t]), n + k - 1, a)
        # What lies further than the radius: every window around a shingle that no similar text is without.
        for t, i, first, last in _sharing(hashes, begins, ends, shared, rare, items, similarity):
            n, begin, end = len(items.lists[i]), int(begins[t]), int(ends[t])
            if end - begin < n:
                like, where, length = _similarity(Counter(hashes[begin:end].tolist()), items.counts[i]), begin, end - begin
                size, skip, mark = end - begin, 0, whole[np.searchsorted(own, i)]
            else:
                low = max(begin, min(first - n + 1, end - n))
                both = _overlaps(hashes[low:min(end, last + n)], n, *items.sorted[i])
                most = int(both.max())
                like, where, length = most / (2 * n - most), low + int(both.argmax()), n
                size, skip, mark = items.prints[i]
            if like >= similarity - 1e-12:
                apart = np.bitwise_count(Totals(hashes[where + skip:where + skip + size], size).simhash(size)[0] ^ mark)
                keep(kept[t][0], i, like, where - begin, length + k - 1, int(apart))
        # Texts shorter than an item, taken whole.
        for t in np.flatnonzero(sizes < lengths.max()):
            own_hashes = kept[t][1]
            near = np.flatnonzero((lengths > sizes[t]) & (sizes[t] >= similarity * lengths - 1e-9))
            if len(near):
                mark = Totals(own_hashes, len(own_hashes)).simhash(len(own_hashes))[0]
                apart = np.bitwise_count(whole[near] ^ mark)
                for j in np.flatnonzero(apart <= items.radius):
                    i = int(own[near[j]])
                    keep(kept[t][0], i, _similarity(Counter(own_hashes.tolist()), items.counts[i]), 0, len(own_hashes) + k - 1, int(apart[j]))
    return [(t, items.ids[i], *found) for (t, i), found in best.items()]


def _clusters(places: list[tuple[int, int]], gap: int) -> Iterator[tuple[tuple[int, int], int]]:
    """Join starts less than `gap` apart: ((first, last), least distance)."""
    places.sort()
    first = last = places[0][0]
    least = places[0][1]
    for f, a in places[1:]:
        if f - last > gap:
            yield (first, last), least
            first, least = f, a
        last, least = f, min(least, a)
    yield (first, last), least


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in order, a bounded list at a time; the driver never holds more than one and a partition."""
    some, chars = [], 0
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text")).where("text is not null").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        some.append((row["item_id"], row["text"]))
        chars += len(row["text"])
        if len(some) >= PASS_ITEMS or chars >= PASS_CHARS:
            yield some
            some, chars = [], 0
    if some:
        yield some


_FOUND = "doc_id bigint, t1 bigint, t2 bigint, item_id bigint, similarity double, first_word bigint, n_words bigint, bits_apart bigint"


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Benchmark items found in documents: doc_id, t1, t2 (hashes of the text), item_id, similarity, first_word, n_words, bits_apart.

    Every window of every text gets a SimHash of its five-word shingles, weighted by count; windows have an item's length, rounded down
    on a scale that grows by GROWTH, and stand for the item's middle part of that length. A multi-index of the
    items' fingerprints finds all windows within `radius` bits. Around each, windows of the
    item's full length are compared exactly (weighted Jaccard similarity of shingles); the best for each document and item is reported if
    it reaches `similarity`. A text shorter than an item is compared as a whole. SimHash misses some that reach it, so windows
    and short texts that hold one of the item's rarest shingles (as many as no similar one can be without) are compared too:
    none is missed, and `bits_apart` may exceed `radius`.

    Items of less than five words are one shingle of all their words, so only their exact words match. Items
    without words and null texts never match. Rows with the same doc_id and text give one result each. Items
    are searched for in passes of bounded size over the documents.
    """
    spark = docs.sparkSession
    t1, t2 = hash_pair(F.coalesce(F.col("text"), F.lit("")))
    flat = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = []
    for some in _passes(benchmark):
        shared = spark.sparkContext.broadcast(some)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            from flowboard.llm.words import word_hashes

            items = Items(shared.value, radius, similarity)
            for batch in batches:
                rows, names, words, held = [], [], [], 0

                def flush():
                    for t, item, *rest in search_texts(words, items, similarity):
                        rows.append((*names[t], item, *rest))

                for doc, a, b, text in zip(batch["doc_id"].astype("Int64").array, batch["t1"].tolist(), batch["t2"].tolist(), batch["text"]):
                    names.append((None if pd.isna(doc) else int(doc), a, b))
                    words.append(word_hashes(text))
                    held += len(words[-1])
                    if held >= _AT_ONCE:
                        flush()
                        names, words, held = [], [], 0
                if words:
                    flush()
                if rows:
                    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])
                    yield out.astype({"doc_id": "Int64"})

        found.append(cut(flat.mapInPandas(run, _FOUND)))
    if not found:
        return spark.createDataFrame([], _FOUND)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every
