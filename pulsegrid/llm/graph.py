"""Connected components as joins and aggregates, checkpointed through written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .rows import written

MAX_ROUNDS = 60


def components(edges: DataFrame, u: str = "x", v: str = "y") -> DataFrame:
    """``(node, label)`` for every node of ``edges``; the label is the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014).  Each
    step takes a minimum per node, combined on the map side, and joins it back,
    so a node with very many edges is an aggregate and a splittable join, never a
    list.  Rounds end when the edge set no longer changes, which takes a
    logarithmic number of rounds; each is a written table.
    """
    e = written(edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a <> b").distinct(), "edges")
    before = None
    if not e.take(1):
        return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    for _ in range(MAX_ROUNDS):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("label"))
            ).distinct()
        before = now
    raise RuntimeError("components did not settle")
