"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowboard.llm import alignment, anchors, chat, huffman, language, leaks, lines, minhash, packing, shards, sketch, urls, whitening
from flowboard.llm.common import cut, new_path, on_workers
from flowboard.llm.sql import SQL
from flowboard.session import prepare

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
SHARDS = 24
CONTROL_CHAT = (-7, ("user", "assistant"), "</s>[INST] ok [/INST]")


TOKENIZER, SECOND_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(on_workers(prepare(spark)), sf_dir)
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark, sf):
    return leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select(
        "doc_id", "item_id", "similarity", "first_word", "n_words", "bits_apart")


@query
def op2_line_dedup(spark, sf):
    return lines.dedup_lines(table(spark, sf, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "text", F.col("lines_removed").cast("bigint").alias("lines_removed"), F.col("chars_removed").cast("bigint").alias("chars_removed"))


@query
def op3_url_filter(spark, sf):
    return urls.judge(table(spark, sf, "pages"), URL_RULES)


@query
def op4_document_fingerprints(spark, sf):
    return sketch.fingerprints(table(spark, sf, "documents"))


@query
def op5_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.train(language.learnable(docs))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "row.doc_id", (language.fold(F.col("row.doc_id")) == 1).alias("held_out"), "lang_pred", "score")


@query
def op6_sharding(spark, sf):
    return shards.assign(table(spark, sf, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


@query
def op7_near_dedup(spark, sf):
    return minhash.near_classes(table(spark, sf, "documents")).select("doc_id", "class_id", "class_size", "is_first")


@query
def op8_token_files(spark, sf):
    path = new_path(spark, "token-ids")
    huffman.write_ids(table(spark, sf, "documents"), path, tokenizer_path(), end_id=2)
    return huffman.read_ids(spark, path)


@query
def op9_chat_formatting(spark, sf):
    conv_id, roles, text = CONTROL_CHAT
    planted = spark.createDataFrame([(conv_id, i, r, text) for i, r in enumerate(roles)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digest_chats(cut(chat.format_chats(rows)))


@query
def op10_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer_path())


@query
def op11_embedding_whitening(spark, sf):
    rows = whitening.whiten(table(spark, sf, "embeddings"))
    each = rows.select(F.col("row.vec_id").alias("vec_id"), "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c"))
    return each.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


@query
def op12_tokenizer_alignment(spark, sf):
    rows = alignment.align(table(spark, sf, "documents"), tokenizer_path(), tokenizer_path(SECOND_TOKENIZER), texts=False)
    return rows.drop("t1").withColumnRenamed("groups", "groups_sha256")


@query
def op13_substring_dedup(spark, sf):
    return anchors.dedup_substrings(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
