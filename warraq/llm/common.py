"""What the operators share: tables, the shared scratch folder, components of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import BATCH_ROWS, checkpoint_root, scratch_path, small_batches, written  # noqa: F401 - the operators name them here

HELD_OUT_REMAINDER = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_engines: dict = {}


def engine(key, make):
    """What a worker needs for the operator it runs, made once. A worker that goes on to another operator drops it."""
    if key not in _engines:
        _engines.clear()
        if key is not None:
            _engines[key] = make()
    return _engines.get(key)


def held_out(doc_id="doc_id"):
    """True for the quarter of documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each larger node has one edge, to a node that has none to a smaller one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 or up = 1 and n > 1").limit(1).count()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component).

    ``edges`` has the long columns ``a`` and ``b``; the component is the
    smallest node reachable. Nodes without edges do not appear; an empty input
    gives an empty result. Alternates the large-star and small-star steps of
    Kiveris et al. (2014): every step is one aggregation of minima, which
    combines before its shuffle, and one join with those minima, so a hub of
    any degree is split by adaptive execution, and nothing reaches the driver
    but a number per round.
    """
    clean = edges.where("a is not null and b is not null and a <> b")
    now = written(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        # large star: every larger neighbour of u moves to the smallest node around u
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = written(moved.where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
