"""Substring dedup: fixed blocks of words are anchors, every rolling window probes them, hits extend to exact repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowboard.llm.common import cut, hash_pair

#: Words of the shortest repeat.
WORDS = 20
#: Words of one parcel of documents, the unit that tasks exchange hashes for. A longer document is a parcel of its own.
PARCEL_WORDS = 1_000_000
#: Slices of the hash range for each shuffle partition.
SLICES = 2
_PARCEL = "parcel bigint, docs binary, words binary, codes binary"
_RUN = "parcel bigint, radix int, run binary"
_MASK = "parcel bigint, radix int, mask binary"


def _parcels(docs: DataFrame, parcel_words: int) -> DataFrame:
    """Documents as parcels: keys and word counts, the different words, and one code a word. Parcels carry their number."""
    t1, _ = hash_pair(F.coalesce(F.col("text"), F.lit("")))
    # Ids without nulls: pandas would make others floats.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), t1.alias("t1"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        from flowboard.llm.blobs import pack

        class Codes(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = code = len(self)
                return code

        squeeze = zstandard.ZstdCompressor(level=1).compress
        parcel, words, keys, codes, held = None, Codes(), [], [], 0

        def row() -> pd.DataFrame:
            known, ids, t1s, counts = (np.array(x, dtype=t) for x, t in zip(zip(*keys), ("u1", "i8", "i8", "i8")))
            return pd.DataFrame({"parcel": [parcel], "docs": [pack(known, ids, t1s, counts)], "words": [squeeze(b" ".join(words))],
                                 "codes": [pack(np.concatenate(codes))]})

        for batch in batches:
            for doc, known, text, t1, number in zip(batch["doc_id"], batch["known"], batch["text"], batch["t1"], batch["number"]):
                if parcel is None:
                    parcel = number
                # Bytes split at exactly the six white-space characters of ASCII.
                found = text.encode("utf-8", "surrogatepass").split()
                codes.append(np.array(list(map(words.__getitem__, found)), dtype="<u4"))
                keys.append((known, doc, t1, len(found)))
                held += len(found)
                if held >= parcel_words or len(keys) >= 100_000:
                    yield row()
                    parcel, words, keys, codes, held = None, Codes(), [], [], 0
        if keys:
            yield row()

    return rows.withColumn("number", F.monotonically_increasing_id()).mapInPandas(run, _PARCEL)


class _Parcel:
    """One parcel with its hashes: what all later steps start from, equal whenever it is read."""

    def __init__(self, docs: bytes, words: bytes, codes: bytes, size: int):
        import xxhash
        import zstandard

        from flowboard.llm.blobs import unpack

        self.known, self.ids, self.t1, self.counts = unpack(docs)
        self.words, (self.codes,), self.size = zstandard.ZstdDecompressor().decompressobj().decompress(words).split(b" "), unpack(codes), size
        self.block = (size + 1) // 2
        self.hashes = [np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], dtype=np.uint64) for seed in (0, 1)]
        self.ends = np.cumsum(self.counts)
        self.begins = self.ends - self.counts
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.start = np.arange(len(self.codes)) - self.begins[self.row]
        #: Words from each position to the end of its document.
        self.left = self.counts[self.row] - self.start

    def rolled(self, length: int, lane: int = 0) -> np.ndarray:
        """Hash of the `length` words from each position, by doubling; the last ones reach over the end and are void."""
        from flowboard.llm.words import _ODD, mix

        n = len(self.codes)
        power, size, out, have = self.hashes[lane][self.codes], 1, None, 0
        shifted = lambda a, by: np.concatenate([a[by:], np.zeros(min(by, n), dtype=np.uint64)])
        while size <= length:
            if length & size:
                out = power if out is None else mix(out * _ODD + shifted(power, have))
                have += size
            power, size = mix(power * _ODD + shifted(power, size)), 2 * size
        return out

    def probes(self, radices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of all rolling blocks by (slice, rest of the hash), that order's key, where each value begins, and which are anchors.

        Blocks lie in documents that hold a window at all; anchors are those at multiples of the block.
        """
        at = np.flatnonzero((self.left >= self.block) & (self.counts[self.row] >= self.size))
        h = self.rolled(self.block)[at]
        key = (h >> np.uint64(32)) * np.uint64(radices) >> np.uint64(32) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        from flowboard.llm.blobs import starts

        return at, key, starts(key), self.start[at] % self.block == 0

    def candidates(self, radices: int, live: dict[int, bytes]) -> np.ndarray:
        """Starts of windows that hold a rolling block which meets an anchor elsewhere."""
        at, key, begin, _ = self.probes(radices)
        spread = np.repeat(_bits(live, (key[begin] >> np.uint64(32)).astype(np.int64)), np.diff(np.append(begin, len(key))))
        hit = np.zeros(len(self.codes) + 1, dtype=np.int64)
        hit[at[spread] + 1] = 1
        hits = np.cumsum(hit)
        starts = np.flatnonzero(self.left >= self.size)
        # A window holds the blocks from its start to its start + size - block.
        return starts[hits[starts + self.size - self.block + 1] > hits[starts]]

    def extended(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those windows sorted by their 128 bits of hash, ties by row and start; and both halves of the hash."""
        a, b = (self.rolled(self.size, lane)[starts] for lane in (0, 1))
        order = np.argsort(a, kind="stable")
        if ((a[order][1:] == a[order][:-1]) & (b[order][1:] != b[order][:-1])).any():
            order = np.lexsort((starts, b, a))
        return starts[order], a[order], b[order]

    def rank(self) -> np.ndarray:
        """Order of the rows' documents; rows of one document tie."""
        return _ranks(self.known, self.ids, self.t1)


def _ranks(*keys: np.ndarray) -> np.ndarray:
    from flowboard.llm.blobs import starts

    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=np.int64)
    new[starts(*[k[order] for k in keys])] = 1
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _bits(masks: dict[int, bytes], radix: np.ndarray) -> np.ndarray:
    """The bits that slices sent back, in the order of the sorted column of their numbers."""
    from flowboard.llm.blobs import slices

    return np.concatenate([np.unpackbits(np.frombuffer(masks[r], dtype=np.uint8), count=b - a) for r, a, b in slices(radix)] or [np.zeros(0, np.uint8)]).astype(bool)


def _masks(pdf: pd.DataFrame, live: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"parcel": pdf["parcel"], "radix": pdf["radix"], "mask": [np.packbits(x).tobytes() for x in live]})


def _live(parcels: DataFrame, size: int, radices: int) -> DataFrame:
    """Masks of the block hashes that an anchor has and that occur twice or more, one bit for each different hash of a parcel."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from flowboard.llm.blobs import pack, slices

        for batch in batches:
            for number, docs, words, codes in zip(batch["parcel"], batch["docs"], batch["words"], batch["codes"]):
                _, key, begin, anchor = _Parcel(docs, words, codes, size).probes(radices)
                if not len(key):
                    continue
                flags = np.maximum.reduceat(anchor, begin) + 2 * (np.diff(np.append(begin, len(key))) > 1)
                key = key[begin]
                rest = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
                cuts = slices((key >> np.uint64(32)).astype(np.int64))
                runs = [pack(np.diff(rest[a:b], prepend=0).astype("<u4"), flags[a:b].astype("u1")) for _, a, b in cuts]
                yield pd.DataFrame({"parcel": number, "radix": [r for r, _, _ in cuts], "run": runs})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        from flowboard.llm.blobs import starts, unpack

        gaps, flags = zip(*map(unpack, pdf["run"]))
        rest, flag = np.concatenate([np.cumsum(g, dtype=np.uint64) for g in gaps]), np.concatenate(flags)
        order = np.argsort(rest, kind="stable")
        begin = starts(rest[order])
        anchor, times = np.maximum.reduceat(flag[order] & 1, begin), np.add.reduceat(1 + (flag[order] >> 1).astype(np.int64), begin)
        live = np.empty(len(rest), dtype=bool)
        live[order] = np.repeat((anchor > 0) & (times > 1), np.diff(np.append(begin, len(rest))))
        return _masks(pdf, np.split(live, np.cumsum([len(g) for g in gaps])[:-1]))

    return parcels.mapInPandas(probe, _RUN).groupBy("radix").applyInPandas(meet, _MASK)


def _held(masks: pd.DataFrame) -> dict[int, bytes]:
    return dict(zip(masks["radix"].tolist(), masks["mask"]))


def _first(parcels: DataFrame, live: DataFrame, size: int, radices: int) -> DataFrame:
    """Masks of the extended hits, one bit for each different window of a parcel: whether the parcel holds its first document."""

    def extend(parcel: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        from flowboard.llm.blobs import pack, radix_of, slices, starts

        out = []
        for number, docs, words, codes in zip(parcel["parcel"], parcel["docs"], parcel["words"], parcel["codes"]):
            own = _Parcel(docs, words, codes, size)
            at, a, b = own.extended(own.candidates(radices, _held(masks)))
            if not len(at):
                continue
            begin, rank = starts(a, b), own.rank()
            by_rank = np.argsort(rank, kind="stable")
            least = np.minimum.reduceat(rank[own.row[at]], begin)
            doc = by_rank[np.searchsorted(rank[by_rank], least)]
            a, b = a[begin], b[begin]
            for r, i, j in slices(radix_of(a, radices)):
                used, place = np.unique(doc[i:j], return_inverse=True)
                run = pack(np.diff(a[i:j], prepend=np.uint64(0)), b[i:j], place.astype("<u4"), own.known[used], own.ids[used], own.t1[used])
                out.append((number, r, run))
        return pd.DataFrame(out, columns=["parcel", "radix", "run"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        from flowboard.llm.blobs import starts, unpack

        runs = [unpack(x) for x in pdf["run"]]
        a, b = np.concatenate([np.cumsum(r[0], dtype=np.uint64) for r in runs]), np.concatenate([r[1] for r in runs])
        before = np.cumsum([0] + [len(r[3]) for r in runs])
        rank = _ranks(*[np.concatenate([r[k] for r in runs]) for k in (3, 4, 5)])[np.concatenate([r[2] + n for r, n in zip(runs, before)])]
        order = np.lexsort((b, a))
        begin = starts(a[order], b[order])
        least = np.empty(len(a), dtype=np.int64)
        least[order] = np.repeat(np.minimum.reduceat(rank[order], begin), np.diff(np.append(begin, len(a))))
        return _masks(pdf, np.split(rank == least, np.cumsum([len(r[0]) for r in runs])[:-1]))

    runs = parcels.groupBy("parcel").cogroup(live.groupBy("parcel")).applyInPandas(extend, _RUN)
    return runs.groupBy("radix").applyInPandas(meet, _MASK)


def dedup_substrings(docs: DataFrame, words: int = WORDS, parcel_words: int = PARCEL_WORDS) -> DataFrame:
    """doc_id, t1 (hash of the text), n_words, n_removed, text (kept words, one space between), repeats (first word from 0, words).

    Words are what white space of ASCII parts, compared byte for byte. A word goes where some window of `words` consecutive words
    that covers it also starts earlier: in a document before (by doc_id, nulls first, then text hash) or
    further up in the same one, overlaps included. Windows are judged on the input. `repeats` lists the maximal
    removed stretches. A null or empty text has no words and gives an empty text; documents shorter than a window lose nothing.
    Rows with the same doc_id and text are one document: a repeated row is no repetition, and all get the same result.
    An empty table gives no rows; other columns are not read.

    Blocks of half a window lie side by side in every document: the anchors. Wherever an earlier window lies, it holds a
    whole anchor, so one of the blocks that roll through an equal later window meets it. Hits are extended by the
    words before and behind the block to full windows, and adjoining ones to maximal repeats; an extension is compared with
    its first holder only, by 128 bits of hash. A passage held by a third of all documents is thus one
    entry a parcel and one bit back, never a list of pairs. A parcel of documents sends each hash once, in slices
    of the hash range, and gets bits back in the same order; slices grow in number with the
    shuffle partitions. A document is one row, so its words meet in one task.
    """
    spark = docs.sparkSession
    radices = SLICES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parcels = cut(_parcels(docs, parcel_words))
    live = cut(_live(parcels, words, radices))
    first = cut(_first(parcels, live, words, radices))
    masks = live.withColumn("kind", F.lit(0)).unionByName(first.withColumn("kind", F.lit(1)))

    def remove(parcel: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        from flowboard.llm.blobs import radix_of, starts

        out = []
        for docs_, words_, codes_ in zip(parcel["docs"], parcel["words"], parcel["codes"]):
            own = _Parcel(docs_, words_, codes_, words)
            at, a, b = own.extended(own.candidates(radices, _held(masks[masks["kind"] == 0])))
            begin, rank = starts(a, b), own.rank()
            gone = np.zeros(len(own.codes) + 1, dtype=np.int64)
            if len(at):
                here = _bits(_held(masks[masks["kind"] == 1]), radix_of(a[begin], radices))
                many = np.diff(np.append(begin, len(at)))
                row = own.row[at]
                once = np.zeros(len(at), dtype=bool)
                once[starts(a, b, row)] = True
                stays = np.repeat(here, many) & (rank[row] == np.repeat(np.minimum.reduceat(rank[row], begin), many)) & once
                late = at[~stays]
                np.add.at(gone, late, 1)
                np.add.at(gone, late + words, -1)
            gone = np.cumsum(gone)[:-1] > 0
            # Edges of removed stretches; a stretch ends with its document.
            opens = np.flatnonzero(gone & ~(np.append(False, gone[:-1]) & (own.start > 0))) if len(gone) else np.zeros(0, int)
            closes = np.flatnonzero(gone & ~(np.append(gone[1:], False) & (own.left > 1))) if len(gone) else np.zeros(0, int)
            lo, hi = np.searchsorted(opens, own.begins), np.searchsorted(opens, own.ends)
            for i, (s, e) in enumerate(zip(own.begins.tolist(), own.ends.tolist())):
                kept = b" ".join([own.words[c] for c in own.codes[s:e][~gone[s:e]].tolist()]).decode("utf-8", "surrogatepass")
                spans = [{"first": int(x - s), "words": int(y - x + 1)} for x, y in zip(opens[lo[i]:hi[i]], closes[lo[i]:hi[i]])]
                out.append((int(own.ids[i]), bool(own.known[i]), int(own.t1[i]), e - s, int(gone[s:e].sum()), kept, spans))
        return pd.DataFrame(out, columns=["doc_id", "known", "t1", "n_words", "n_removed", "text", "repeats"])

    schema = "doc_id bigint, known boolean, t1 bigint, n_words bigint, n_removed bigint, text string, repeats array<struct<first: bigint, words: bigint>>"
    rows = parcels.groupBy("parcel").cogroup(masks.groupBy("parcel")).applyInPandas(remove, schema)
    return rows.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")
