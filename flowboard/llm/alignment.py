"""Cross-tokenizer alignment: groups of tokens with common ends, links between overlapping tokens, corpus-wide pair counts."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowboard.llm.common import cut

#: Units of one parcel of documents, which writes one run a radix. A longer document is a parcel of its own.
PARCEL_UNITS = 300_000
#: Parts of side B's ids. Each holds all pairs of its ids; parcels are grouped within, so the number need not grow with the data.
RADICES = 64
#: Runs that one merge takes at about.
FAN_IN = 32
#: Units remembered per worker. It bounds memory, not what is encoded.
CACHE_UNITS = 300_000
LONGEST_CACHED = 40
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACED = re.compile(r"\A\s|\s\s|\s\Z|[^\S ]")
_TABLE = ("parcel bigint, radix int, head binary, body binary, place int, doc_id bigint, known boolean, t1 bigint, "
          "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string")


class Aligner:
    """Tokens of both sides of a text, unit by unit.

    A text with a space before it is cut where a space stands between two other characters: byte-level BPE with the usual pattern begins a
    pre-token there, and no piece of side B goes on over a space. So both sides have a token end at each cut, and a unit's
    tokens, groups and links depend on nothing else. A model of side B with pieces across spaces gets its texts whole.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        from flowboard.llm.tokens import Encoder, _byte_characters

        self.a, self.b = Encoder(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.tokenizer.encode_special_tokens, self.a.added = True, []
        byte = {c: i for i, c in enumerate(_byte_characters())}
        size = self.a.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.a.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(map(byte.__getitem__, t)) if all(c in byte for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, t))) for t in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = list(map(str, range(size))), list(map(str, range(len(pieces))))
        self.by_unit = self.a.by_piece and not any(re.search("[^▁]▁", p) for p in pieces)
        self.held: dict[str, tuple] = {}

    def units(self, text: str) -> list[str]:
        """The text's units, without the space before each."""
        if not self.by_unit:
            return [text]
        return _CUT.split(text) if _SPACED.search(text) else text.split(" ")

    def align(self, units: list[str]) -> list[tuple[str | None, int, int, int, bytes]]:
        """Of each unit: its groups (None where bytes differ), tokens of A and B, number of groups, linked (B << 32 | A) with repeats."""
        from flowboard.llm.tokens import _WORD

        held, out, by_piece, unpack = self.held, {}, self.a.by_piece, struct.unpack
        missing = [u for u in units if u not in held]
        if missing:
            word, piece, whole = self.a.units.word, self.a.piece, self.a.whole
            raw = [word(t) if by_piece and _WORD(t) else piece(t) if by_piece else whole(t) for t in map(" ".__add__, missing)]
            out = dict(zip(missing, self._align([(" " + u).encode("utf-8", "surrogatepass") for u in missing],
                                                [unpack(f"<{len(r) // 4}I", r) for r in raw], self.b.encode(missing, num_threads=1))))
            room = CACHE_UNITS - len(held)
            if room > 0:
                held.update([x for x in out.items() if len(x[0]) <= LONGEST_CACHED][:room])
        return [held.get(u) or out[u] for u in units]

    def _align(self, texts: list[bytes], a: list, b: list) -> list[tuple[str | None, int, int, int, bytes]]:
        """Texts side by side as one stretch of bytes: a link is what lies between neighbouring token ends of either side."""
        sizes = np.array(list(map(len, texts)))
        ids, ends, counts = [], [], []
        same = np.ones(len(texts), dtype=bool)
        for side, size in ((a, self.a_size), (b, self.b_size)):
            flat, n = np.fromiter(chain.from_iterable(side), dtype=np.int64), np.fromiter(map(len, side), dtype=np.int64, count=len(side))
            upto = np.append(0, np.cumsum(size[flat]))
            last = np.cumsum(n)
            same &= upto[last] - upto[last - n] == sizes
            ids.append(flat)
            ends.append(upto[1:])
            counts.append(n)
        differ = not same.all()
        if not differ:
            text = b"".join(texts)
            differ = any(b"".join(map(table.__getitem__, chain.from_iterable(side))) != text for side, table in ((a, self.a_bytes), (b, self.b_bytes)))
        if differ:
            same = [b"".join(map(self.a_bytes.__getitem__, x)) == t and b"".join(map(self.b_bytes.__getitem__, y)) == t for t, x, y in zip(texts, a, b)]
            good = iter(self._align(*[list(compress(x, same)) for x in (texts, a, b)]))
            return [next(good) if ok else (None, 0, 0, 0, b"") for ok in same]
        stretch = np.unique(np.concatenate(ends))
        i, j = (np.searchsorted(e, stretch) for e in ends)
        pairs = (ids[1][j] << 32 | ids[0][i]).astype("<u8").tobytes()
        common = np.flatnonzero((ends[0][i] == stretch) & (ends[1][j] == stretch))
        ga, gb = [0, *(i[common] + 1).tolist()], [0, *(j[common] + 1).tolist()]
        name_a, name_b = list(map(self.a_name.__getitem__, ids[0].tolist())), list(map(self.b_name.__getitem__, ids[1].tolist()))
        groups = [f"{','.join(name_a[ga[k]:ga[k + 1]])}|{','.join(name_b[gb[k]:gb[k + 1]])}" for k in range(len(common))]
        upto = np.cumsum(sizes)
        links = [0, *np.searchsorted(stretch, upto, "right").tolist()]
        of = [0, *np.searchsorted(stretch[common], upto, "right").tolist()]
        return [(";".join(groups[of[k]:of[k + 1]]), x, y, of[k + 1] - of[k], pairs[8 * links[k]:8 * links[k + 1]])
                for k, (x, y) in enumerate(zip(counts[0].tolist(), counts[1].tolist()))]


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per worker process."""
    return Aligner(a_path, b_path)


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (many[0] numbers), then the same from first[1], and so on."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - many), many)


def _runs(info: list[tuple], unit: np.ndarray, row: np.ndarray, radices: int) -> list[tuple[int, bytes, bytes]]:
    """(radix, head, body) of a parcel's links: the head lists pairs by side B and their counts, the body documents and counts of each pair."""
    from flowboard.llm.blobs import pack, slices, starts
    from flowboard.llm.words import mix

    many = np.array([len(x[4]) // 8 for x in info])
    if not len(unit) or not many.sum():
        return []
    pair, which = np.unique(np.frombuffer(b"".join([x[4] for x in info]), dtype="<u8"), return_inverse=True)
    radix = (mix(pair >> np.uint64(32)) % np.uint64(radices)).astype(np.int64)
    order = np.argsort(radix, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    pair, radix, which = pair[order], radix[order], place[which]
    # Repeats of a unit in a document count once, times their number.
    rows = int(row.max()) + 1
    both, times = np.unique(unit * rows + row, return_counts=True)
    unit, row = both // rows, both % rows
    at = _spread((np.cumsum(many) - many)[unit], many[unit])
    key = which[at] * rows + np.repeat(row, many[unit])
    order = np.argsort(key)
    key, times = key[order], np.repeat(times, many[unit])[order]
    begin = starts(key)
    key, times = key[begin], np.add.reduceat(times, begin)
    row, at = key % rows, key // rows
    begin = starts(at)
    used = at[begin]
    gap = np.diff(row, prepend=0)
    gap[begin] = row[begin]
    total, docs = np.add.reduceat(times, begin), np.diff(np.append(begin, len(at)))
    out = []
    for r, i, j in slices(radix[used]):
        s, e = begin[i], begin[j] if j < len(begin) else len(at)
        head = pack(np.diff(pair[used[i:j]], prepend=np.uint64(0)), total[i:j].astype("<i8"))
        out.append((r, head, pack(docs[i:j].astype("<u4"), gap[s:e].astype("<u4"), times[s:e].astype("<u4"))))
    return out


def _aligned(docs: DataFrame, a_path: str, b_path: str, radices: int, parcel_units: int, texts: bool) -> DataFrame:
    """Rows of two kinds: one a document (radix null), with its own counts and groups; one a parcel and radix, with its run."""
    # Ids without nulls: pandas would make others floats.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("t1"), F.monotonically_increasing_id().alias("number"))
    columns = [c.split()[0] for c in _TABLE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        own = aligner(a_path, b_path)

        class Codes(dict):
            def __missing__(self, unit: str) -> int:
                self[unit] = code = len(self)
                return code

        codes, keys, units, parcel, held = Codes(), [], [], None, 0

        def rows() -> pd.DataFrame:
            info = own.align(list(codes))
            bad = np.array([x[0] is None for x in info], dtype=bool)
            sizes = np.array([[x[1], x[2], x[3], len(x[4]) // 8] for x in info], dtype=np.int64).reshape(-1, 4)
            out = []
            for i, (key, mine) in enumerate(zip(keys, units)):
                if not len(mine) or bad[mine].any():
                    units[i] = mine[:0]
                    n, groups = [0, 0, 0, 0], ""
                else:
                    n, groups = sizes[mine].sum(axis=0).tolist(), ";".join([info[c][0] for c in mine.tolist()])
                    groups = groups if texts else hashlib.sha256(groups.encode()).hexdigest()
                out.append((parcel, None, None, None, i, *key, *n, groups))
            flat = np.concatenate(units)
            of = np.repeat(np.arange(len(units)), [len(u) for u in units])
            out += [(parcel, *r, None, 0, None, 0, 0, 0, 0, 0, None) for r in _runs(info, flat, of, radices)]
            return pd.DataFrame(out, columns=columns).astype({"radix": "Int32", "place": "Int32"})

        for batch in batches:
            for doc, known, text, t1, number in zip(batch["doc_id"], batch["known"], batch["text"], batch["t1"], batch["number"]):
                if parcel is None:
                    parcel = number
                found = own.units(text) if text else []
                keys.append((doc, known, t1))
                units.append(np.array(list(map(codes.__getitem__, found)), dtype=np.int64))
                held += len(found)
                if held >= parcel_units or len(keys) >= 50_000:
                    yield rows()
                    codes, keys, units, parcel, held = Codes(), [], [], None, 0
        if keys:
            yield rows()

    return rows.mapInPandas(run, _TABLE)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One run out of several of a radix, by a heap over their least pairs."""
    import heapq

    from flowboard.llm.blobs import pack, unpack

    streams = []
    for head in pdf["head"]:
        gaps, counts = unpack(head)
        streams.append(zip(np.cumsum(gaps, dtype=np.uint64).tolist(), counts.tolist()))
    pairs, totals, last = [], [], -1
    for pair, n in heapq.merge(*streams):
        if pair == last:
            totals[-1] += n
        else:
            pairs.append(pair)
            totals.append(n)
            last = pair
    head = pack(np.diff(np.array(pairs, dtype="<u8"), prepend=np.uint64(0)), np.array(totals, dtype="<i8"))
    return pd.DataFrame({"radix": pdf["radix"].iloc[:1], "id": pdf["grp"].iloc[:1], "head": [head]})


def _maxima(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A radix's whole counts; by side B, a stretch of one id after the other, each with its maximum."""
    from flowboard.llm.blobs import pack, starts, unpack

    for batch in batches:
        values = []
        for head in batch["head"]:
            gaps, counts = unpack(head)
            begin = starts(np.cumsum(gaps, dtype=np.uint64) >> np.uint64(32))
            best = counts == np.repeat(np.maximum.reduceat(counts, begin), np.diff(np.append(begin, len(counts))))
            values.append(pack(gaps, counts, best.astype("u1")))
        yield pd.DataFrame({"radix": batch["radix"], "id": batch["id"], "value": values})


def _looked_up(head: bytes, value: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key gaps of a run, and its pairs' counts and marks out of those of a run that holds them all."""
    from flowboard.llm.blobs import unpack

    gaps, (of, counts, best) = unpack(head)[0], unpack(value)
    at = np.searchsorted(np.cumsum(of, dtype=np.uint64), np.cumsum(gaps, dtype=np.uint64))
    return gaps, counts[at], best[at]


def _split(runs: pd.DataFrame, value: pd.DataFrame) -> pd.DataFrame:
    from flowboard.llm.blobs import pack

    values = [pack(*_looked_up(head, value["value"].iloc[0])) for head in runs["head"]]
    return pd.DataFrame({"radix": runs["radix"], "id": runs["id"], "value": values})


def _grouped(runs: DataFrame, n: int) -> tuple[DataFrame, int]:
    groups = -(-n // FAN_IN)
    return runs.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("bigint")), groups


def _counted(runs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """`runs` (radix, id, ... of n ids at most) with their group, and (radix, id, value) of each group: whole counts and best marks of its pairs.

    Runs are merged in groups, and the merged ones again, until each radix has one; then counts go back the same way, each
    run getting those of its own pairs only.
    """
    named, groups = _grouped(runs, n)
    parents = cut(named.select("radix", "grp", "head").groupBy("radix", "grp").applyInPandas(_merge, "radix int, id bigint, head binary"))
    if groups == 1:
        return named, parents.mapInPandas(_maxima, "radix int, id bigint, value binary")
    above, values = _counted(parents, groups)
    down = above.groupBy("radix", "grp").cogroup(values.groupBy("radix", "id")).applyInPandas(_split, "radix int, id bigint, value binary")
    return named, down


def align(docs: DataFrame, a_path: str, b_path: str, radices: int = RADICES, parcel_units: int = PARCEL_UNITS, texts: bool = True) -> DataFrame:
    """doc_id, t1 (hash of the text), n_a, n_b, n_groups, n_links, n_best, count_sum, groups for every document.

    Side A is a byte-level BPE of the tokenizers library over a space and the text, side B a sentencepiece model that adds the space itself;
    strings of special tokens in a text are plain text. `groups` lists, between byte offsets where tokens of both sides end, the ids of A and
    B (`a1,a2|b1;a3|b2,b3`), or with texts=False its sha256 in hex, which takes less disk. Links are the pairs of tokens whose bytes overlap. `n_best` counts those whose
    pair of ids occurs most often among all corpus links of its B id (ties all count), `count_sum` adds up their corpus counts.

    Texts that are null or empty, or whose tokens' bytes differ from the text's on either side (a B model that normalises, a
    U+2581 in the text), have no tokens: zeros and ''. Rows count as often as they occur and each gets its result. An empty table gives no rows.
    Other columns are not read. A text is aligned in units between spaces; one without spaces is one unit in one task.

    Each parcel of documents spills, for each radix of side B's ids, a compressed run of (pair, document, number) records sorted by pair. Heap merges
    of the runs' pairs, several rounds of them, give whole counts; as a radix holds whole ids of B in order, their maxima follow. Counts return
    along the same rounds, to each run those of its own pairs; there documents' sums are formed, and added up over radices.
    A pair that every document holds is one entry a run, so hot ids cost no more than others.
    """
    table = cut(_aligned(docs, a_path, b_path, radices, parcel_units, texts))
    runs = table.where("radix is not null").select("radix", F.col("parcel").alias("id"), "head", "body")
    n = table.where("radix is not null").agg(F.countDistinct("parcel")).first()[0]

    def contribute(runs: pd.DataFrame, value: pd.DataFrame) -> pd.DataFrame:
        from flowboard.llm.blobs import pack, unpack

        sums = []
        for head, body in zip(runs["head"], runs["body"]):
            _, counts, best = _looked_up(head, value["value"].iloc[0])
            many, gaps, times = unpack(body)
            first = np.cumsum(many, dtype=np.int64) - many
            upto = np.cumsum(gaps, dtype=np.int64)
            row = upto - np.repeat(upto[first] - gaps[first], many)
            times = times.astype(np.int64)
            out = np.zeros((2, row.max() + 1), dtype=np.int64)
            np.add.at(out[0], row, times * np.repeat(best, many))
            np.add.at(out[1], row, times * np.repeat(counts, many))
            used = np.flatnonzero(out[1])
            sums.append(pack(np.diff(used, prepend=0).astype("<u4"), out[0][used], out[1][used]))
        return pd.DataFrame({"parcel": runs["id"], "sums": sums})

    def finish(docs: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        from flowboard.llm.blobs import unpack

        total = np.zeros((2, int(docs["place"].max()) + 1), dtype=np.int64)
        for blob in sums["sums"]:
            gaps, best, count = unpack(blob)
            at = np.cumsum(gaps, dtype=np.int64)
            total[0][at] += best
            total[1][at] += count
        place = docs["place"].to_numpy(dtype=np.int64)
        return docs[["doc_id", "known", "t1", "n_a", "n_b", "n_groups", "n_links"]].assign(n_best=total[0][place], count_sum=total[1][place], groups=docs["groups"])

    own = table.where("radix is null").select("parcel", "place", "doc_id", "known", "t1", "n_a", "n_b", "n_groups", "n_links", "groups")
    named, values = _counted(runs, max(n, 1))
    sums = named.groupBy("radix", "grp").cogroup(values.groupBy("radix", "id")).applyInPandas(contribute, "parcel bigint, sums binary")
    schema = "doc_id bigint, known boolean, t1 bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
    rows = own.groupBy("parcel").cogroup(sums.groupBy("parcel")).applyInPandas(finish, schema)
    return rows.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")
