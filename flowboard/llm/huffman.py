"""Token-id files: canonical length-limited Huffman code, independent blocks, bit-offset checkpoints."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowboard.llm.common import cut, documents, drop

#: Longest code in bits. A code of n symbols needs at least log2(n); more bits than 25 would not fit one look-up.
MAX_BITS = 20
#: A block takes documents until it holds this many ids.
BLOCK_IDS = 1 << 16
#: Ids between two checkpoints.
STRIDE = 256
MAGIC = b"FBH1"
_HEAD = struct.Struct("<4sIIQQ")  # magic, documents, stride, ids, bits
_STORED = "part int, block int, n_ids bigint, payload binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code length of every symbol under the limit, 0 for symbols of count 0 (package-merge)."""
    counts = np.asarray(counts, dtype=np.float64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need more than {max_bits} bits")
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order]
    merged, leaf_masks = weights, [np.ones(len(weights), dtype=bool)]
    for _ in range(max_bits - 1):
        packages = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        every = np.concatenate([weights, packages])
        rank = np.argsort(every, kind="stable")
        merged = every[rank]
        leaf_masks.append(rank < len(weights))
    take, found = 2 * len(weights) - 2, np.zeros(len(weights), dtype=np.uint8)
    for leaves in reversed(leaf_masks):
        n = int(leaves[:take].sum())
        found[:n] += 1
        take = 2 * (take - n)
    lengths[order] = found
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, symbol): the lengths alone determine them."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    code, last = 0, 0
    bits = lengths[order].astype(int)
    for symbol, n in zip(order.tolist(), bits.tolist()):
        code <<= n - last
        codes[symbol], last = code, n
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> np.ndarray:
    """For every value of the longest code's bits: symbol * 32 + length of the code it begins with."""
    width = int(lengths.max())
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    table = np.zeros(1 << width, dtype=np.uint32)
    runs = np.repeat(order.astype(np.uint32) * 32 + lengths[order], 1 << (width - lengths[order].astype(np.int64)))
    table[:len(runs)] = runs
    return table


@lru_cache(maxsize=2)
def _table_of(lengths: bytes) -> np.ndarray:
    """One decoding table per worker process."""
    found = np.frombuffer(lengths, dtype=np.uint8)
    return decode_table(found) if found.any() else np.zeros(2, np.uint32)


def encode_block(doc_ids: list[int | None], docs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """One block: head, documents (id, known, ids), bit offset of every STRIDE-th id, bits."""
    ids = np.concatenate(docs)
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    begins, total = ends - n, int(ends[-1]) if len(ids) else 0
    # A code lies in the 64-bit word where it begins and maybe in the next; codes never overlap, so adding places them.
    words = np.zeros(total // 64 + 2, dtype=np.uint64)
    word, shift = begins >> 6, 64 - (begins & 63) - n
    code = codes[ids].astype(np.uint64)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    inside = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
    words[word[starts]] = np.bitwise_or.reduceat(inside, starts)
    over = np.flatnonzero(shift < 0)
    words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    directory = np.zeros(len(docs), dtype=[("id", "<i8"), ("known", "u1"), ("n", "<u4")])
    directory["id"] = [d or 0 for d in doc_ids]
    directory["known"] = [d is not None for d in doc_ids]
    directory["n"] = [len(d) for d in docs]
    return b"".join([_HEAD.pack(MAGIC, len(docs), STRIDE, len(ids), total), directory.tobytes(),
                     begins[::STRIDE].astype("<u8").tobytes(), words.astype(">u8").tobytes()])


def decode_blocks(payloads: list[bytes], table: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(directory, ids) of each block. All stretches between checkpoints of all blocks are decoded in step."""
    width = np.uint32(32 - (len(table).bit_length() - 1))
    heads, bits, lanes, counts, base = [], [], [], [], 0
    for payload in payloads:
        magic, n_docs, stride, n_ids, _ = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        directory = np.frombuffer(payload, dtype=[("id", "<i8"), ("known", "u1"), ("n", "<u4")], count=n_docs, offset=_HEAD.size)
        at = _HEAD.size + directory.nbytes
        points = np.frombuffer(payload, dtype="<u8", count=-(-n_ids // stride), offset=at).astype(np.int64)
        data = np.frombuffer(payload, dtype=np.uint8, offset=at + 8 * len(points))
        lanes.append(points + 8 * base)
        counts.append(np.minimum(stride, n_ids - stride * np.arange(len(points))))
        bits.append(data)
        base += len(data)
        heads.append((directory, stride, n_ids))
    data = np.concatenate([*bits, np.zeros(4 * STRIDE + 4, dtype=np.uint8)]).astype(np.uint32)
    view = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
    at, left = np.concatenate(lanes), np.concatenate(counts)
    # A short stretch runs on into what follows; the padding above holds the longest run, and what it reads is cut off below.
    out = np.zeros((int(left.max(initial=0)), len(at)), dtype=np.uint32)
    for step in range(len(out)):
        hit = table[view[at >> 3] << (at & 7).astype(np.uint32) >> width]
        np.right_shift(hit, np.uint32(5), out=out[step])
        at += hit & np.uint32(31)
    out, done, lane = out.T, [], 0
    for directory, stride, n_ids in heads:
        n = -(-n_ids // stride)
        done.append((directory, out[lane:lane + n].reshape(-1)[:n_ids] if out.shape[1] == stride else
                     np.concatenate([r[:c] for r, c in zip(out[lane:lane + n], np.minimum(stride, n_ids - stride * np.arange(n)))] or [np.zeros(0, np.uint32)])))
        lane += n
    return done


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, ids (compressed, with `end_id`), tie; and one row per task with the counts of all its ids, doc_id null and `counts` set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        from flowboard.llm.tokens import encoder

        encode, pack = encoder(tokenizer_path), zstandard.ZstdCompressor(level=1)
        counts = np.zeros(1 << 16, dtype=np.int64)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            packed, lists = [], []
            for text in batch["text"]:
                raw = encode(text) + end
                ids = np.frombuffer(raw, dtype="<u4")
                lists.append(ids)
                packed.append(pack.compress(ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else raw))
            if lists:
                found = np.bincount(np.concatenate(lists))
                if len(found) > len(counts):
                    counts = np.pad(counts, (0, len(found) - len(counts)))
                counts[:len(found)] += found
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "tie": batch["tie"], "n": [len(x) for x in lists], "ids": packed, "counts": None})
        yield pd.DataFrame({"doc_id": pd.array([None], dtype="Int64"), "tie": [0], "n": [0], "ids": [b""], "counts": [counts.tobytes()]})

    flat = documents(docs).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return flat.mapInPandas(run, "doc_id bigint, tie bigint, n bigint, ids binary, counts binary")


def global_counts(tokenized: DataFrame) -> np.ndarray:
    """Occurrences of every id, summed by Spark; at most one number per vocabulary entry reaches the driver."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["counts"]:
                counts = np.frombuffer(raw, dtype=np.int64)
                ids = np.flatnonzero(counts)
                yield pd.DataFrame({"id": ids, "n": counts[ids]})

    rows = tokenized.where("counts is not null").select("counts").mapInPandas(spread, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, dtype=np.int64)
    counts[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, max_bits: int = MAX_BITS) -> None:
    """Write the ids of all documents to `path`, in ascending order of doc_id (nulls first, then text hash).

    Rows (part, block, n_ids, payload) by order; `part` -1 holds the code lengths of all ids,
    one byte each, from which reader and writer derive the code. Every block can be decoded
    alone, and from every checkpoint in it. A document lies in one block. Null texts consist of the end
    id; repeated rows are written as often. Ids are made once, kept compressed, and moved once.
    """
    spark = docs.sparkSession
    made = cut(tokenize(docs, tokenizer_path, end_id))
    lengths = code_lengths(global_counts(made), max_bits)
    code = spark.createDataFrame([(-1, 0, 0, lengths.tobytes())], _STORED)
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyspark import TaskContext

        (lengths, codes), unpack, part, block = shared.value, zstandard.ZstdDecompressor(), TaskContext.get().partitionId(), 0
        names, lists, held = [], [], 0
        for batch in batches:
            rows = []
            for doc, n, packed in zip(batch["doc_id"].astype("Int64").array, batch["n"], batch["ids"]):
                raw = unpack.decompress(packed)
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4")
                names.append(None if pd.isna(doc) else int(doc))
                lists.append(ids)
                held += n
                if held >= BLOCK_IDS:
                    rows.append((part, block, held, encode_block(names, lists, lengths, codes)))
                    names, lists, held, block = [], [], 0, block + 1
            if rows:
                yield pd.DataFrame(rows, columns=["part", "block", "n_ids", "payload"])
        if lists:
            yield pd.DataFrame([(part, block, held, encode_block(names, lists, lengths, codes))], columns=["part", "block", "n_ids", "payload"])

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-made.count() // 1024)))
    rows = made.where("counts is null").select("doc_id", "tie", "n", "ids")
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    code.coalesce(1).write.parquet(path)
    ordered.select("doc_id", "n", "ids").mapInPandas(run, _STORED).write.mode("append").parquet(path)
    drop(spark, made)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Read files of `write_ids` back: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before in the order of the files. One row
    a document leaves a task; block totals are summed per part and parts over all.
    """
    from pyspark.sql import Window

    stored = spark.read.schema(_STORED).parquet(path)
    raw = stored.where("part < 0").first()["payload"]
    shared = spark.sparkContext.broadcast(np.frombuffer(bytes(raw), dtype=np.uint8))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _table_of(shared.value.tobytes())
        for batch in batches:
            for at in range(0, len(batch), 16):
                some = batch.iloc[at:at + 16]
                for part, block, (directory, ids) in zip(some["part"], some["block"], decode_blocks([bytes(p) for p in some["payload"]], table)):
                    ends = np.cumsum(directory["n"], dtype=np.int64)
                    plain = ids.astype("<u4")
                    yield pd.DataFrame({
                        "part": part, "block": block, "doc_id": pd.array(np.where(directory["known"], directory["id"], 0), dtype="Int64").copy(),
                        "known": directory["known"].astype(bool), "inside": ends - directory["n"], "n_tokens": directory["n"].astype(np.int64),
                        "ids_crc32": [zlib.crc32(plain[e - n:e]) for e, n in zip(ends.tolist(), directory["n"].tolist())]})

    docs = stored.where("part >= 0").select("part", "block", "payload").mapInPandas(
        run, "part int, block int, doc_id bigint, known boolean, inside bigint, n_tokens bigint, ids_crc32 bigint")
    blocks = stored.where("part >= 0").select("part", "block", "n_ids")
    over = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("parts_before"))
    before = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(over), F.lit(0)).alias("blocks_before")).join(parts, "part")
    return docs.join(before, ["part", "block"]).select(
        F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), (F.col("parts_before") + F.col("blocks_before") + F.col("inside")).cast("bigint").alias("start"),
        "n_tokens", "ids_crc32")
