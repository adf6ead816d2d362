"""Connected components of an edge table by rounds of joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keep = Callable[[str, DataFrame], DataFrame]


def components(edges: DataFrame, keys: Sequence[str], a: str, b: str, keep: Keep) -> DataFrame:
    """keys, node and ``component``, the least node reachable from it, for every node that has an edge.

    Each round hands every node the least label among its own and its neighbours', then follows that label once more, so
    that chains shrink by a factor and a round is two joins.  ``keep`` writes a round's labels and reads them again: it
    cuts the lineage, which would otherwise grow with the rounds.
    """
    keys = list(keys)
    both = keep("edges", edges.select(*keys, F.col(a).alias("node"), F.col(b).alias("other")).unionByName(
        edges.select(*keys, F.col(b).alias("node"), F.col(a).alias("other"))).distinct())
    labels = keep("labels_0", both.groupBy(*keys, "node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    rounds = 0
    while True:
        rounds += 1
        near = both.join(labels.select(*keys, F.col("node").alias("other"), F.col("component").alias("_near")), [*keys, "other"]).groupBy(*keys, "node").agg(F.min("_near").alias("_near"))
        lower = labels.join(near, [*keys, "node"]).select(*keys, "node", F.col("component").alias("_old"), F.least("component", "_near").alias("_step"))
        beyond = labels.select(*keys, F.col("node").alias("_step"), F.col("component").alias("_far"))
        stepped = lower.join(beyond, [*keys, "_step"]).select(*keys, "node", "_old", F.least("_step", "_far").alias("component"))
        stored = keep(f"labels_{rounds}", stepped)
        labels = stored.drop("_old")
        if not stored.filter(F.col("_old") != F.col("component")).limit(1).count():
            return labels
