"""Joins along chains of parents."""

from __future__ import annotations

from pyspark.sql import functions as F

from warraq.operators import joins


def test_more_chains_than_a_recursive_query_may_have(spark):
    edges = spark.range(90_000).select(F.col("id").alias("child"), F.when(F.col("id") > 1, F.floor(F.col("id") / 2)).alias("parent"))
    got = joins.ancestors(spark, edges).agg(F.count("*"), F.max("hop"), F.countDistinct("child")).first()
    # a node's chain has as many members as its number has bits; 0 has one
    assert tuple(got) == (1 + sum(n.bit_length() for n in range(1, 90_000)), 16, 90_000)


def python_chains(edges, limit):
    out, up = [], [(c, c, 0, [c]) for c in {c for c, _ in edges}]
    while up:
        out += [u[:3] for u in up]
        up = [(c, p, h + 1, [*seen, p]) for c, a, h, seen in up for e, p in edges if e is not None and e == a and h < limit and p is not None and p not in seen]
    return sorted(out, key=repr)


def test_chains_with_rings_repeats_and_several_parents(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (4, 3), (5, 5), (6, 4), (6, 4), (7, None), (8, 7), (9, 99), (None, 1), (10, 9)]
    frame = spark.createDataFrame(edges, "child long, parent long")
    for limit in (64, 2, 0):
        assert sorted((tuple(r) for r in joins.ancestors(spark, frame, limit).collect()), key=repr) == python_chains(edges, limit)


def test_nearest_stated_over_many_chains(spark):
    edges = spark.range(90_000).select(F.col("id").alias("child"), F.when(F.col("id") > 1, F.floor(F.col("id") / 2)).alias("parent"))
    stated = spark.range(90_000).select(F.col("id").alias("ancestor"), F.when(F.col("id") % 1000 == 1, F.col("id")).alias("named"))
    got = {r.child: r.named for r in joins.nearest_stated(joins.ancestors(spark, edges), stated, ["named"]).where("child % 997 = 5").collect()}
    for n, named in got.items():
        while n % 1000 != 1 and n > 1:
            n //= 2
        assert named == n
    assert len(got) == 91
