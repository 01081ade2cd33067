"""Exact token counts: one histogram of encoded lengths answers every context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .pieces import TOGETHER, piece_encoder

#: Lengths that share a block of the suffix sums.
BLOCK = 4096


def encoded_length(text: Column, model_path: str) -> Column:
    """The number of ids of each whole text; null counts as the empty text, which has none."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        encoder, out = piece_encoder(model_path), []
        for at in range(0, len(texts), TOGETHER):
            out += [len(x) for x in encoder.ids([t or "" for t in texts[at : at + TOGETHER].to_pylist()])]
        return pa.array(np.array(out, np.int64))

    return count(text)


def histogram(docs: DataFrame, model_path: str) -> DataFrame:
    """(n_tokens, n_docs): one row per encoded length. Repeated rows count each; no rows give none."""
    return docs.select(encoded_length(F.col("text"), model_path).alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """For each length as a limit: documents and tokens at least so long, and what a cut at it would keep.

    Adds ``docs_from`` and ``tokens_from`` (documents of this length or more),
    ``truncated_tokens`` (total if each document is cut at ``n_tokens``),
    ``docs_within`` and ``share_within`` (documents not cut).

    The rows are distinct lengths, so at most as many as the longest document
    has tokens. Sums run within blocks of lengths; the totals of the blocks,
    one row for ``BLOCK`` lengths, are summed in a second step. The histogram
    is written first, as both steps read it.
    """
    lengths = written(lengths, "histogram")
    of = lengths.withColumn("block", (F.col("n_tokens") / BLOCK).cast("long")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    inner = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = of.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = blocks.select("block", F.coalesce(F.sum("d").over(outer), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("later_tokens"), F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"))
    sums = of.select("block", "n_tokens", "n_docs", F.sum("n_docs").over(inner).alias("d"), F.sum("tokens").over(inner).alias("t")).join(later, "block")
    from_here = sums.select("n_tokens", "n_docs", "all_docs", "all_tokens", (F.col("d") + F.col("later_docs")).alias("docs_from"), (F.col("t") + F.col("later_tokens")).alias("tokens_from"))
    within = F.col("all_docs") - F.col("docs_from") + F.col("n_docs")
    return from_here.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
        within.alias("docs_within"), (within / F.col("all_docs")).alias("share_within"),
    )


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least this share of the documents doesn't exceed; null without documents."""
    return sums.where(F.col("share_within") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens left if each document is cut at any ``limit``, a length of the histogram or not; 0 without documents."""
    whole = F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_tokens") * F.col("n_docs")))
    cut = F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs")))
    return sums.agg((F.coalesce(whole, F.lit(0)) + limit * F.coalesce(cut, F.lit(0))).alias("tokens"))
