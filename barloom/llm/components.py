"""Connected components by alternating large-star and small-star rounds on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.work import Workspace


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (a long, b long) but the roots themselves.

    Nodes join others only by aggregates and equi-joins, so a node with very many edges is no more than a skewed key.
    Repeated edges and loops do no harm; no edges give no rows.
    """
    current = work.store(f"{name}-0", edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, step = None, 0
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b")))
        step += 1
        new = work.store(f"{name}-{step}", small.distinct())
        state = tuple(new.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        work.drop(f"{name}-{step - 1}")
        if state == before:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, current = state, new
