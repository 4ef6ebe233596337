"""Language ID: blended-spectrum presence kernel, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: n-grams of 1 to LONGEST characters, hashed to 2^BITS features.
LONGEST, BITS = 4, 16
#: Bounds of the sample the model is fitted on: rows of all languages together, and landmarks among them.
TRAIN_ROWS, LANDMARKS = 2000, 160
RIDGE = 1e-3
#: Texts scored by one matrix product.
_BATCH = 256


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def presence(text: str) -> np.ndarray:
    """Sorted features present in a text: hashed n-grams, n from 1 to LONGEST, of its lower-cased letters.

    Everything between two letters is one space; a space stands at either end. None without letters.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = _letters()[codes]
    if not is_letter.any():
        return np.zeros(0, dtype=np.int64)
    codes = np.where(is_letter, codes, np.uint32(32))
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
    seen = np.zeros(1 << BITS, dtype=bool)
    grams = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, min(LONGEST, len(codes)) + 1):
        grams = (grams[:len(codes) - n + 1] + np.uint32(n)) * np.uint32(0x9E3779B1) + codes[n - 1:]
        mixed = (grams ^ grams >> np.uint32(15)) * np.uint32(0x85EBCA6B)
        seen[mixed >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    """Kernel classifier: landmarks over the features they hold, and one column of weights per language."""

    languages: list[str]
    features: np.ndarray  # feature -> column, -1 if no landmark has it
    landmarks: np.ndarray  # landmarks x columns, scaled by the root of their feature counts
    weights: np.ndarray  # landmarks x languages

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Presence kernel with every landmark: shared features over the root of both counts."""
        x = np.zeros((len(sets), self.landmarks.shape[1]), dtype=np.float32)
        for row, found in zip(x, sets):
            columns = self.features[found]
            row[columns[columns >= 0]] = 1.0 / np.sqrt(max(1, len(found)))
        return x @ self.landmarks.T

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text. The score is the share of the winner in all positive outputs, 0 for `und`."""
        sets = [presence(t) for t in texts]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, s in enumerate(sets) if len(s)]
        if known and self.languages:
            out = self.kernel([sets[i] for i in known]).astype(np.float64) @ self.weights
            best = out.argmax(axis=1)
            positive = np.maximum(out, 0)
            share = positive[np.arange(len(known)), best] / np.maximum(positive.sum(axis=1), 1e-12)
            for i, b, s in zip(known, best, share):
                names[i], scores[i] = self.languages[b], min(1.0, max(0.0, s))
        return names, scores


def fit(sample: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on (language, features): Nystroem map through evenly chosen landmarks, then ridge regression per language."""
    sample = [(lang, found) for lang, found in sample if len(found)]
    languages = sorted({lang for lang, _ in sample})
    columns = np.full(1 << BITS, -1, dtype=np.int64)
    if not sample:
        return Model([], columns, np.zeros((0, 0), dtype=np.float32), np.zeros((0, 0)))
    share = max(1, landmarks // len(languages))
    chosen = [f for lang in languages for f in [x for own, x in sample if own == lang][:share]]
    used = np.unique(np.concatenate(chosen))
    columns[used] = np.arange(len(used))
    marks = np.zeros((len(chosen), len(used)), dtype=np.float32)
    for row, found in zip(marks, chosen):
        row[columns[found]] = 1.0 / np.sqrt(len(found))
    model = Model(languages, columns, marks, np.zeros((len(chosen), len(languages))))
    # K(landmarks)^(-1/2): inner products of mapped texts approximate the kernel.
    value, vector = np.linalg.eigh(model.kernel(chosen).astype(np.float64))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6 * value.max()))) @ vector.T
    mapped = np.concatenate([model.kernel([f for _, f in sample[i:i + _BATCH]]) for i in range(0, len(sample), _BATCH)]).astype(np.float64) @ root
    target = np.array([[float(own == lang) for lang in languages] for own, _ in sample])
    # Each language weighs the same, however many rows it has.
    weight = (1 / target.sum(axis=0))[target.argmax(axis=1)] * len(sample) / len(languages)
    gram = mapped.T @ (mapped * weight[:, None]) + ridge * len(sample) * np.eye(len(chosen))
    model.weights = root @ np.linalg.solve(gram, mapped.T @ (target * weight[:, None]))
    return model


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> Model:
    """Fit on at most `train_rows` rows of (text, lang): as many of each language, in order of text hash.

    Executors read the texts; the driver gets one bit per feature, 2^BITS / 8 bytes a row. Each
    different text counts once. Rows without language or letters are passed over.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    # Copies share a hash, so they are counted once here and joined below, where few texts are left to move.
    counts = {r["lang"]: r["count"] for r in rows.select("lang", "h").distinct().groupBy("lang").count().collect()}
    if not counts:
        return fit([])
    share = max(1, train_rows // len(counts))
    least = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, (20 * share + 200) / n))) for lang, n in sorted(counts.items())])
    # Hot languages are thinned by hash before they are ranked: a few times the share is enough.
    some = rows.where(F.pmod("h", F.lit(1 << 20)) < least * (1 << 20)).distinct()
    by = Window.partitionBy("lang").orderBy("h", "text")
    some = some.withColumn("k", F.row_number().over(by)).where(F.col("k") <= share)

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = []
            for text in batch["text"]:
                seen = np.zeros(1 << BITS, dtype=bool)
                seen[presence(text)] = True
                marks.append(np.packbits(seen).tobytes())
            yield pd.DataFrame({"lang": batch["lang"], "h": batch["h"], "bits": marks})

    got = some.select("lang", "text", "h").mapInPandas(bits, "lang string, h bigint, bits binary").collect()
    got.sort(key=lambda r: (r["lang"], r["h"], bytes(r["bits"])))
    return fit([(r["lang"], np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r["bits"]), dtype=np.uint8)))) for r in got], landmarks)


def predict(docs: DataFrame, model: Model, name: str = "lang_pred", score: str = "score") -> DataFrame:
    """(row, lang_pred, score): every row in whole as a struct, with the language of its whole text.

    `und` with score 0 where the text is null or holds no letter, or where nothing was learned.
    Only the text is read, so equal texts get equal results; ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(f"{name} string, {score} double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for series in texts:
            names, scores = [], []
            for at in range(0, len(series), _BATCH):
                a, b = model.predict([t or "" for t in series.iloc[at:at + _BATCH]])
                names += a
                scores += b.tolist()
            yield pd.DataFrame({name: names, score: scores})

    return docs.select(F.struct("*").alias("row"), run(F.col("text")).alias("got")).select("row", "got.*")


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that models may learn from: those whose hash of doc_id leaves fold 1 out."""
    return docs.where(fold(F.col("doc_id")) != 1).select("text", "lang")


def fold(doc_id):
    """crc32 of the doc_id as text, modulo 3; a null doc_id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)).cast("int")
