"""The operators over the synthetic tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, langid, lengths, neardup, packing, pieces, quality, sql, toxicity, warc
from .common import held_out, scratch_path, small_batches
from .common import table as _table

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return _table(spark, sf_dir, name)


PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"
BYTES = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.format_conversations(turns, public_tokenizers.path(BYTES))).drop("n_tokens", "n_loss_tokens")


#: Scores from here on are taken for label 1.
TOXIC_FROM = 0.3


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    got = docs.select("doc_id", held_out().alias("held_out"), toxicity.scored(docs, F.col("text"), learned).alias("t"))
    return got.select("doc_id", "held_out", "t.score", (F.col("t.score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(F.col(c), r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    return warc.read(spark, path).where("kind = 'record'").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = docs.select("doc_id", pieces.encoded(F.col("text"), public_tokenizers.path(PIECES)).alias("e"))
    return got.select(
        "doc_id",
        F.size("e.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("e.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("e.decoded"), 256).alias("decoded_sha256"),
        F.element_at("e.offsets", -1).cast("long").alias("source_bytes"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), 2048, 0).drop("ids")


def vocabularies() -> tuple[str, str, str]:
    return public_tokenizers.path(PIECES), public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", quality.judged(F.col("text"), *vocabularies()).alias("q")).select("doc_id", "q.*")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), 75, 5)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.samples(docs)
    return docs.select("doc_id", held_out().alias("held_out"), langid.identified(docs, F.col("text"), learned).alias("g")).select("doc_id", "held_out", "g.*")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.histogram(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES)))


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_toxicity, op3_warc, op4_sentencepiece, op5_packing, op6_quality_rules, op7_ngram_jaccard, op8_embedding_near_dedup, op9_language_id, op10_token_counts)}
SQL: dict[str, str] = {"op1_chat_formatting": sql.OP1, "op3_warc": sql.OP3, "op7_ngram_jaccard": sql.OP7, "op8_embedding_near_dedup": sql.OP8}
