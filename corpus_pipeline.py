"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing, over all documents.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. `run` writes
each stage's rows as Parquet to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowboard.llm import language, leaks, lines, minhash, packing
from flowboard.llm.common import cut, hash_pair, on_workers
from flowboard.llm.registry import table, tokenizer_path
from flowboard.session import prepare


def _kept(rows: DataFrame, docs: DataFrame, **replaced) -> DataFrame:
    """The columns of `docs` out of `row`, with some replaced."""
    return rows.select(*[replaced[c].alias(c) if c in replaced else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _keys() -> list:
    t1, t2 = hash_pair(F.coalesce(F.col("text"), F.lit("")))
    return [F.col("doc_id").cast("bigint").alias("k"), t1.alias("t1"), t2.alias("t2")]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or with no output above 0, which speaks against every language.

    The model is fitted on `docs` itself (its fixed bounds apply). Where no row has a language, all pass.
    """
    on_workers(spark)
    model = language.train(language.learnable(docs))
    if not model.languages:
        return docs
    rows = language.predict(docs, model)
    return _kept(rows.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") > 0)), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later repeated runs of lines; documents without a word left of such runs go. `n_chars` follows the text."""
    rows = lines.dedup_lines(docs)
    left = rows.where((F.col("lines_removed") == 0) | (F.col("text").rlike(r"[^ \t\r\f\n]")))
    replaced = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.when(F.col("lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        replaced["n_chars"] = F.coalesce(length, F.col("row.n_chars"))
    return _kept(left, docs, **replaced)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies: the one with the least doc_id, once if its row repeats."""
    on_workers(spark)
    first = minhash.near_classes(docs).where("is_first").select(F.col("doc_id").alias("k0"), F.col("t1").alias("a1"), F.col("t2").alias("a2")).distinct()
    rows = docs.select(F.struct("*").alias("row"), *_keys())
    met = rows.hint("merge").join(first, F.col("k").eqNullSafe(F.col("k0")) & (F.col("t1") == F.col("a1")) & (F.col("t2") == F.col("a2")), "left_semi")
    return _kept(met.dropDuplicates(["k", "t1", "t2"]), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    on_workers(spark)
    found = leaks.find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("k0"), F.col("t1").alias("a1"), F.col("t2").alias("a2")).distinct()
    rows = docs.select(F.struct("*").alias("row"), *_keys())
    return _kept(rows.hint("merge").join(found, F.col("k").eqNullSafe(F.col("k0")) & (F.col("t1") == F.col("a1")) & (F.col("t2") == F.col("a2")), "left_anti"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of tokens."""
    on_workers(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL has neither the tokenizer nor the trained model, so the pipeline is tested against plain Python stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(on_workers(prepare(spark)), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
