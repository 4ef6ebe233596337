"""Packing documents into token windows: sum-of-squares placement, then cutting what is left open."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowboard.llm.common import cut, documents

WINDOW = 1024
#: Open windows a task holds before it cuts them to fill one another.
MAX_OPEN = 4096
#: Tasks whose last open windows meet in one task of the next round.
MERGE = 512
_PIECE = "grp bigint, seq bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, offset bigint, ids binary"


class Packer:
    """Online placement of pieces (doc_id, start, ids, doc_tokens) into windows of `size` ids.

    `levels[h]` counts the open windows filled to h. A piece of s ids goes to the level h, or to a
    new window, for which the sum of squared counts grows least: moving a window from h to h + s
    changes it by 2 * (levels[h + s] - levels[h]) + 2. Ties go to the fullest window. A window that is full leaves the array.
    """

    def __init__(self, size: int, emit):
        self.size, self.emit, self.n = size, emit, 0
        self.levels = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}

    def add(self, pieces: list[tuple], s: int) -> None:
        """Place pieces that stay together and hold s ids."""
        size, levels = self.size, self.levels
        if s == size:
            self.close(pieces)
            return
        cost = 2 * (levels[s + 1:] - levels[1:size - s + 1]) + 2
        cost[-1] -= 1
        cost[levels[1:size - s + 1] == 0] = np.iinfo(np.int64).max
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))
        if cost[best] <= 2 * levels[s] + 1:
            h = best + 1
            window = self.open[h].pop()
            levels[h] -= 1
        else:
            h, window = 0, []
        window.extend(pieces)
        if h + s == size:
            self.close(window)
        else:
            self.open.setdefault(h + s, []).append(window)
            levels[h + s] += 1

    def close(self, window: list[tuple]) -> None:
        self.emit(self.n, window)
        self.n += 1

    def squeeze(self) -> None:
        """Fill the fullest open windows with ids cut from the emptiest, until at most one is open."""
        windows = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open, low, high = {}, len(windows) - 1, 0
        self.levels[:] = 0
        fill = lambda w: sum(len(p[2]) for p in w)
        while high <= low:
            window, room = windows[high], self.size - fill(windows[high])
            while room and high < low:
                doc, start, ids, total = windows[low].pop()
                if len(ids) > room:
                    windows[low].append((doc, start + room, ids[room:], total))
                    ids = ids[:room]
                window.append((doc, start, ids, total))
                room -= len(ids)
                if not windows[low]:
                    low -= 1
            if room == 0:
                self.close(window)
            else:
                h = self.size - room
                self.open[h] = [window]
                self.levels[h] = 1
            high += 1


def _rows(grp: int, seq: int, window: list[tuple], keep_ids: bool) -> list[tuple]:
    out, at = [], 0
    for doc, start, ids, total in window:
        raw = ids.astype("<u4").tobytes()
        out.append((grp, seq, doc, start, len(ids), zlib.crc32(raw), total, at, raw if keep_ids else None))
        at += len(ids)
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECE.split(", ")])
    return out.astype({"doc_id": "Int64"})


def _packed(items: Iterator[tuple[list[tuple], int]], size: int, grp: int) -> Iterator[pd.DataFrame]:
    """Rows of closed windows, then of at most one open one, which alone carries its ids and has seq -1."""
    rows: list[tuple] = []
    packer = Packer(size, lambda seq, window: rows.extend(_rows(grp, seq, window, False)))
    for pieces, s in items:
        packer.add(pieces, s)
        if packer.levels.sum() > MAX_OPEN:
            packer.squeeze()
        if len(rows) >= 8192:
            yield _frame(rows)
            rows.clear()
    packer.squeeze()
    for windows in packer.open.values():
        for window in windows:
            rows.extend(_rows(grp, -1, window, True))
    if rows:
        yield _frame(rows)


def pack(docs: DataFrame, tokenizer_path: str, size: int = WINDOW, end_id: int = 0) -> DataFrame:
    """Pieces of all documents in windows of `size` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and `end_id`. Its full windows stand alone; the rest is placed by
    sum-of-squares in the task that reads it, so text is not shuffled. Windows a task leaves open
    are cut to fill one another; the one that stays open per task is packed again with those of
    MERGE other tasks, until one is left. So one sequence in all is not full. Sequences are
    numbered from 0 without gaps. Null texts are documents of the end id alone; repeated rows are
    documents of their own; an empty table gives no rows. A task holds at most MAX_OPEN windows
    besides a batch of texts.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from flowboard.llm.tokens import encoder

        encode, end = encoder(tokenizer_path), np.uint32(end_id)

        def items():
            for batch in batches:
                for doc, text in zip(batch["doc_id"].array, batch["text"]):
                    ids = np.append(np.frombuffer(encode(text), dtype="<u4"), end)
                    doc = None if pd.isna(doc) else int(doc)
                    for at in range(0, len(ids), size):
                        part = ids[at:at + size]
                        yield [(doc, at, part, len(ids))], len(part)

        yield from _packed(items(), size, TaskContext.get().partitionId())

    def again(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        def items():
            batch.sort_values(["grp", "offset"], inplace=True)
            for _, window in batch.groupby("grp", sort=True):
                pieces = [(None if pd.isna(d) else int(d), int(s), np.frombuffer(i, dtype="<u4"), int(t))
                          for d, s, i, t in zip(window["doc_id"].astype("Int64").array, window["start"], window["ids"], window["doc_tokens"])]
                yield pieces, sum(len(p[2]) for p in pieces)

        parts = list(_packed(items(), size, key[0]))
        return pd.concat(parts) if parts else _frame([])

    rounds = [cut(documents(docs).mapInPandas(first, _PIECE))]
    while (opened := rounds[-1].where("seq < 0")).select("grp").distinct().count() > 1:
        opened = opened.withColumn("to", F.floor(F.col("grp") / MERGE))
        rounds.append(cut(opened.groupBy("to").applyInPandas(again, _PIECE)))
    parts = [t.where("seq >= 0").withColumn("round", F.lit(i)) for i, t in enumerate(rounds)]
    parts.append(rounds[-1].where("seq < 0").withColumn("seq", F.lit(0).cast("bigint")).withColumn("round", F.lit(len(rounds))))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return number_sequences(every.drop("ids"))


def number_sequences(pieces: DataFrame) -> DataFrame:
    """Number (round, grp, seq) from 0 without gaps: a running sum over one row a task."""
    from pyspark.sql import Window

    tasks = pieces.groupBy("round", "grp").agg((F.max("seq") + 1).alias("n"))
    w = Window.orderBy("round", "grp").rowsBetween(Window.unboundedPreceding, -1)
    before = tasks.select("round", "grp", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return pieces.join(before, ["round", "grp"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("seq")).cast("bigint").alias("sequence_id"), "offset")
