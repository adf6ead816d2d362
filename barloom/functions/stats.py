"""Correlation, exact ranks over unbounded groups, and the Student-t tail."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Logarithmic value bins for ranking: 4096 per octave, so one bin spans 0.017 % of a value.
BINS_PER_OCTAVE = 4096
BIN_SHIFT = BINS_PER_OCTAVE * 1100
# A global index first counts by the bits above these: for times in milliseconds, some 50 days.
COARSE_BITS = 32


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate over rows where both are present; null when either is constant."""
    pair = x.isNotNull() & y.isNotNull()
    a, b = F.when(pair, x.cast("double")), F.when(pair, y.cast("double"))

    def spread(v: Column) -> Column:
        # Means of partial aggregates are merged with rounding, so a constant spread over several tasks may seem to vary.
        return F.stddev_pop(v) * F.when(F.min(v) == F.max(v), F.lit(0.0)).otherwise(F.lit(1.0))

    return F.try_divide(F.covar_pop(a, b), spread(a) * spread(b))


def pair_count(x: Column, y: Column) -> Column:
    return F.count(F.when(x.isNotNull() & y.isNotNull(), F.lit(1)))


def value_bin(value: Column) -> Column:
    """Order-preserving bin number; depends on the value alone, so every evaluation agrees.

    In Spark's own order: each infinity has a bin of its own, and NaN comes after all.
    """
    size = F.floor(F.log2(F.abs(value)) * BINS_PER_OCTAVE) + BIN_SHIFT
    outer = F.lit(2 * BIN_SHIFT + 1).cast("long")
    return (
        F.when(F.isnan(value), outer + 1).when(F.abs(value) == float("inf"), F.when(value > 0, outer).otherwise(-outer))
        .when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size)
    )


def by_shuffle(lookup: DataFrame) -> DataFrame:
    """A side of a join that holds a row per distinct value or bin, or about that: sorted and merged, never broadcast.

    Such a side grows with the rows that it is joined to, while its estimated size follows the files of a stage table, in
    which repeated columns shrink to next to nothing; taken at that size it would be copied whole into every task.
    """
    return lookup.hint("merge")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average rank of every distinct value within its keys.

    Columns: keys, value, ``ties`` (rows with the value), ``before`` (rows below it), ``avg_rank``.
    Equal values collapse first; distinct values are ranked inside value bins and the bins are offset
    by prefix counts, so no task holds a whole group.  The result is exact.  Numbers lead the keys of sorts and joins:
    rows are then told apart by their first eight bytes, while names that many rows share would be compared in full.
    """
    keys = list(keys)
    # -0.0 and 0.0 are one value.
    distinct = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, (F.col(value) + F.lit(0.0)).alias(value))
        .agg(F.count(F.lit(1)).alias("ties"))
        .withColumn("_bin", value_bin(F.col(value)))
    )
    order = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        distinct.groupBy(*keys, "_bin").agg(F.sum("ties").alias("_n"))
        .select(*keys, "_bin", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_bin", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = distinct.withColumn("_local", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    return local.join(by_shuffle(offsets), ["_bin", *keys]).select(
        *keys, value, "ties",
        (F.col("_offset") + F.col("_local")).alias("before"),
        (F.col("_offset") + F.col("_local") + (F.col("ties") + 1) / 2).alias("avg_rank"),
    )


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "rank_ic") -> DataFrame:
    """Pooled rank correlation per key over complete pairs, with the pair count ``pairs``.

    One method at every size: values are ranked by bins and joined back, so no task holds a group.
    """
    return rank_correlations(df, keys, {name: x}, y)


def rank_correlations(df: DataFrame, keys: Sequence[str], columns: dict[str, str], y: str) -> DataFrame:
    """Rank correlation of each column with ``y`` per key (name: column), and the row count ``pairs``.

    Rows count where ``y`` and all columns are present, so ``y`` is ranked once for all of them.
    """
    keys = list(keys)
    values = {f"_x{i}": c for i, c in enumerate(columns.values())} | {"_y": y}
    pairs = df.filter(reduce(and_, [F.col(c).isNotNull() for c in values.values()])).select(
        *keys, *[(F.col(c) + F.lit(0.0)).alias(v) for v, c in values.items()]
    )
    # Every lookup is built from the pairs themselves, so none repeats another's join.
    ranked = pairs
    for v in values:
        ranks = value_ranks(pairs, keys, v).select(*keys, v, F.col("avg_rank").alias(f"_r{v}"))
        ranked = ranked.join(by_shuffle(ranks), [v, *keys]).drop(v)
    return ranked.groupBy(*keys).agg(
        *[pearson(F.col(f"_r_x{i}"), F.col("_r_y")).alias(name) for i, name in enumerate(columns)], F.count(F.lit(1)).alias("pairs")
    )


def local_ranks(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """``df`` with the average rank of each column within small groups (name: column); null where the value is.

    For keys whose groups are bounded by construction, such as blocks of a fixed number of rows: one exchange serves all columns.
    """
    keys, out = list(keys), df
    for name, c in columns.items():
        value = F.col(c) + F.lit(0.0)
        order, ties = Window.partitionBy(*keys).orderBy(value.asc_nulls_last()), Window.partitionBy(*keys, value)
        out = out.withColumn(name, F.when(value.isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2))
    return out


def unpivoted_ranks(df: DataFrame, ids: Sequence[str], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Average rank of every column within ``keys``, as ids, keys and one rank column each: all columns in one ranking.

    ``ids`` and ``keys`` together name a row.  Cells without a value have no rank.
    """
    ids, keys = [i for i in ids if i not in keys], list(keys)
    long = df.select(*ids, *keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_column"), (F.col(c) + F.lit(0.0)).alias("_value")) for i, c in enumerate(columns)
    ])).alias("_cell")).select(*ids, *keys, "_cell.*").filter(F.col("_value").isNotNull())
    ranks = value_ranks(long, [*keys, "_column"], "_value").select(*keys, "_column", "_value", "avg_rank")
    return long.join(by_shuffle(ranks), [*keys, "_column", "_value"]).groupBy(*ids, *keys).agg(
        *[F.max(F.when(F.col("_column") == i, F.col("avg_rank"))).alias(c) for i, c in enumerate(columns)]
    )


def with_ordinal(df: DataFrame, keys: Sequence[str], value: str, time: str, tie: str, name: str) -> DataFrame:
    """Attach the ordinal rank (1..n) by value, then time, then ``tie``; rows without a value go.

    Rows of equal value are numbered time by time, each time offset by prefix counts.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).withColumn(value, F.col(value) + F.lit(0.0))
    starts = value_ranks(rows, keys, value).select(*keys, value, "before")
    earlier = Window.partitionBy(*keys, value).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    slots = (
        rows.groupBy(*keys, value, time).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .join(by_shuffle(starts), [*keys, value])
        .select(*keys, value, time, (F.col("before") + F.col("_earlier")).alias("_start"))
    )
    place = F.row_number().over(Window.partitionBy(*keys, value, time).orderBy(tie))
    return (
        rows.join(by_shuffle(slots), [*keys, value, time])
        .withColumn(name, (F.col("_start") + place).cast("long"))
        .drop("_start")
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per key, as an array ``quantiles``.

    The order statistics are read off the value ranks, so no task holds a group.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull())
    if not keys:
        return quantiles(rows.withColumn("_all", F.lit(1)), ["_all"], value, probabilities).drop("_all")
    ranks = value_ranks(rows, keys, value)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = ranks.join(sizes, keys)

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("before") <= position) & (position < F.col("before") + F.col("ties")), F.col(value)))

    parts = []
    for p in probabilities:
        place = (F.col("_n") - 1) * float(p)
        low = F.floor(place)
        parts.append((at(low), at(F.least(low + 1, F.col("_n") - 1)), F.max(place - low)))
    # Without a fraction the lower value stands alone, so that an infinity does not meet a zero weight.
    return placed.groupBy(*keys).agg(
        F.array(*[F.when((share == 0) | (lo == hi), lo).otherwise(lo + (hi - lo) * share) for lo, hi, share in parts]).alias("quantiles")
    )


def with_row_index(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Attach a 0-based index over ``(bucket, *order)`` within ``group``.

    ``bucket`` leads the order (for bars: the bar time).  Bucket sizes are counted and prefix-summed,
    rows are numbered inside their bucket only.
    """
    group = list(group)
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    # The bucket leads the sort: the rows of a group share the text of its keys.
    inside = F.row_number().over(Window.partitionBy(bucket, *group).orderBy(*order))
    return df.withColumn("_place", inside).join(starts, [bucket, *group]).select(
        *group, bucket, *[c for c in df.columns if c not in (*group, bucket)], (F.col("_start") + F.col("_place") - 1).cast("long").alias(name))


def with_global_index(df: DataFrame, buckets: Sequence[str], order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Attach a 0-based index over ``(*buckets, *order)`` to all rows; buckets are never null.

    Counts are prefix-summed level by level: first the values of the leading bucket, or for a whole number its high
    bits, whose few counts make one array; then each next bucket inside those before it.  Rows are numbered inside one
    value of all buckets only, so no window runs over the whole table.
    """
    levels, rows = [], df
    for i, b in enumerate(buckets):
        if isinstance(df.schema[b].dataType, T.IntegralType):
            rows = rows.withColumn(f"_coarse{i}", F.shiftright(F.col(b).cast("long"), COARSE_BITS))
            levels.append(f"_coarse{i}")
        levels.append(b)
    counts = rows.groupBy(*levels).agg(F.count(F.lit(1)).alias("_n"))
    top = levels[0]
    listed = counts.groupBy(top).agg(F.sum("_n").alias("n")).agg(F.sort_array(F.collect_list(F.struct(F.col(top).alias("at"), "n"))).alias("all"))
    before = lambda i: F.aggregate(F.slice("all", F.lit(1), i), F.lit(0).cast("long"), lambda total, x: total + x["n"])
    starts = counts.join(
        listed.select(F.explode(F.transform("all", lambda x, i: F.struct(x["at"].alias(top), before(i).alias("_start0")))).alias("t")).select("t.*"), top)
    for k in range(1, len(levels)):
        inside = Window.partitionBy(*levels[:k]).orderBy(levels[k]).rowsBetween(Window.unboundedPreceding, -1)
        here = counts.groupBy(*levels[:k + 1]).agg(F.sum("_n").alias("_n")).select(*levels[:k + 1], F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias(f"_start{k}"))
        starts = starts.join(here, levels[:k + 1])
    start = reduce(add, [F.col(f"_start{k}") for k in range(len(levels))])
    place = F.row_number().over(Window.partitionBy(*levels).orderBy(*order))
    return rows.withColumn("_place", place).join(starts.select(*levels, start.alias("_start")), levels).select(
        *df.columns, (F.col("_start") + F.col("_place") - 1).cast("long").alias(name))


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz), elementwise."""
    tiny = 1e-300
    gamma = np.vectorize(math.lgamma, otypes=[float])
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    front = np.where((z <= 0) | (z >= 1), 0.0, front)

    def guarded(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(z)
    d = 1 / guarded(1 - (p + q) * z / (p + 1))
    f = d.copy()
    for m in range(1, 300):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / guarded(1 + even * d), guarded(1 + even / c)
        f *= c * d
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / guarded(1 + odd * d), guarded(1 + odd / c)
        step = c * d
        f *= step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    value = front * f
    return np.where(flip, 1 - value, value)


@F.pandas_udf(T.DoubleType())
def two_sided_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a Student-t statistic; runs on aggregated rows only."""
    known = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if known.any():
        tv, dv = t[known].to_numpy(float), df[known].to_numpy(float)
        out[known] = _incomplete_beta(dv / 2, np.full_like(dv, 0.5), dv / (dv + tv * tv))
    return out.astype(object).where(known, None)


def t_p_value(t: Column, degrees: Column) -> Column:
    return two_sided_t_p(t.cast("double"), degrees.cast("double"))


def correlation_t(r: Column, n: Column) -> Column:
    """t statistic of a correlation over n pairs."""
    return F.try_divide(r * F.sqrt((n - 2).cast("double")), F.sqrt(F.greatest(1 - r * r, F.lit(0.0))))
