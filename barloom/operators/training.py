"""The training table: features joined with labels on keys that must be unique on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import BAR_KEY


class TrainingError(ValueError):
    """Features and labels that do not make a training table."""


def key_faults(features: DataFrame, labels: DataFrame) -> DataFrame:
    """side (features or labels), the key, its ``copies`` and the ``fault``: NULL_KEY or DUPLICATE_KEY.

    Keys are counted by an aggregate that combines before its one exchange, both sides in the same one.
    """
    sides = [df.select(F.lit(name).alias("side"), *BAR_KEY) for name, df in (("features", features), ("labels", labels))]
    counts = sides[0].unionByName(sides[1]).groupBy("side", *BAR_KEY).agg(F.count(F.lit(1)).alias("copies"))
    empty = F.lit(False)
    for c in BAR_KEY:
        empty = empty | F.col(c).isNull()
    return counts.withColumn("fault", F.when(empty, "NULL_KEY").when(F.col("copies") > 1, "DUPLICATE_KEY")).filter("fault IS NOT NULL")


def training_join(features: DataFrame, labels: DataFrame, strict: bool = True) -> DataFrame:
    """Rows whose key both sides have: the key, then the columns of features, then those of labels.

    Raises if the key is missing, if a column stands on both sides, or, when ``strict``, if a key is null or repeated on
    either side.  Otherwise rows of faulty keys are left out of the join, so that no row is multiplied; ``key_faults``
    lists them.  Empty sides give an empty table.
    """
    for name, df in (("features", features), ("labels", labels)):
        missing = [c for c in BAR_KEY if c not in df.columns]
        if missing:
            raise TrainingError(f"{name} lack {', '.join(missing)}")
    shared = sorted({c.lower() for c in features.columns} & {c.lower() for c in labels.columns} - set(BAR_KEY))
    if shared:
        raise TrainingError(f"columns on both sides: {', '.join(shared)}")
    faults = key_faults(features, labels)
    if strict:
        first = faults.limit(3).collect()
        if first:
            raise TrainingError("keys that are null or repeated: " + "; ".join(f"{r.side} {r.symbol} {r.timeframe} {r.open_time} x{r.copies}" for r in first))
        return features.join(labels, BAR_KEY)
    bad = faults.filter("fault = 'DUPLICATE_KEY'").select(*BAR_KEY).distinct()
    return features.join(bad, BAR_KEY, "left_anti").join(labels, BAR_KEY)
