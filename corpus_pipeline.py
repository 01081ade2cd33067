"""A corpus pipeline: quality rules, toxicity, one document of each near-duplicate group, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.llm import jaccard, packing, quality, toxicity
from warraq.llm.common import scratch_path, small_batches, table
from warraq.llm.queries import TOXIC_FROM, WORDS, vocabularies

#: No SQL: the quality bands, the score and the packing depend on tokenizers and a trained model.
ORACLE_SQL = None


def _kept(docs: DataFrame, condition) -> DataFrame:
    """Rows of ``docs`` under a condition that is computed once, beside columns of any name."""
    small_batches(docs.sparkSession)
    flag = "kept"
    while flag in docs.columns:
        flag += "_"
    return docs.withColumn(flag, condition).where(F.col(flag)).drop(flag)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null text goes."""
    return _kept(docs, quality.judged(F.col("text"), *vocabularies())["kept"])


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the limit; the model learns from the labelled ones of its own input."""
    learned = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, toxicity.scored(docs, F.col("text"), learned)["score"] < TOXIC_FROM)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id; of rows with an equal doc_id the smallest by text, then by the other columns; all rows without doc_id."""
    found = jaccard.near_duplicates(docs, 75, 5, count_links=False)
    stay = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(stay, docs["doc_id"].cast("bigint") == stay["doc_id"], "left_semi")
    others = ["text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
    first = named.groupBy("doc_id").agg(F.min(F.struct(*(F.col(c) for c in others))).alias("first")).select("doc_id", "first.*")
    return first.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return packing.packed(docs, public_tokenizers.path(WORDS), 2048, 0).drop("ids")


STAGES = [("quality rules", quality_rules), ("toxicity", not_toxic), ("n-gram Jaccard join", one_of_each_group), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
