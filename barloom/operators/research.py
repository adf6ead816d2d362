"""Single-factor research statistics over long panels, keyed by any columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.pairwise import pair_correlations
from barloom.functions.stats import (
    correlation_t, local_ranks, pair_count, pearson, quantiles, spearman, t_p_value, unpivoted_ranks, with_ordinal,
)

# Defaults of the toolkit.
QUANTILES = 5
DECAY_HORIZONS = (1, 2, 4, 8, 12, 24)
STABILITY_BLOCK = 500
HIGH_CORRELATION = 0.9
PROFILES = {"Conservative": (0.99, 0.01), "Balanced": (0.95, 0.05), "Active": (0.90, 0.10)}
PERCENTILES = (0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99)


def information_coefficient(
    df: DataFrame, keys: Sequence[str], x: str = "factor_value", y: str = "future_return_1", method: str = "pearson",
) -> DataFrame:
    """Pooled correlation per key with its p-value; at least two pairs."""
    if method == "spearman":
        out = spearman(df, keys, x, y, "ic")
    else:
        out = df.groupBy(*keys).agg(pearson(F.col(x), F.col(y)).alias("ic"), pair_count(F.col(x), F.col(y)).alias("pairs"))
    out = out.filter("pairs >= 2")
    t = correlation_t(F.col("ic"), F.col("pairs"))
    exact = F.when(F.abs("ic") >= 1.0, F.lit(0.0))
    return out.withColumn("p_value", F.when(F.col("pairs") > 2, F.coalesce(t_p_value(t, F.col("pairs") - 2), exact)))


def quantile_analysis(
    df: DataFrame, keys: Sequence[str], x: str = "factor_value", y: str = "future_return_1", buckets: int = QUANTILES,
) -> DataFrame:
    """Return statistics per equal-frequency bucket of the pooled factor values."""
    keys = list(keys)
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = with_ordinal(pairs, keys, x, "open_time", "symbol", "_rank")
    sizes = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bucket = F.floor((F.col("_rank") - 1) * buckets / F.col("_n")) + 1
    placed = ranked.join(sizes, keys).withColumn("quantile", bucket.cast("int"))
    stats = placed.groupBy(*keys, "quantile").agg(
        F.count(F.lit(1)).alias("count"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max")
    )
    medians = quantiles(placed, [*keys, "quantile"], y, [0.5]).withColumn("median", F.col("quantiles")[0]).drop("quantiles")
    return stats.join(medians, [*keys, "quantile"])


def quantile_summary(stats: DataFrame, keys: Sequence[str], buckets: int = QUANTILES) -> DataFrame:
    """Top-minus-bottom return and whether bucket means are monotonic."""
    order = Window.partitionBy(*keys).orderBy("quantile")
    stepped = stats.withColumn("_step", F.col("mean") - F.lag("mean").over(order))
    return stepped.groupBy(*keys).agg(
        (F.max(F.when(F.col("quantile") == buckets, F.col("mean"))) - F.max(F.when(F.col("quantile") == 1, F.col("mean")))).alias("spread"),
        ((F.count_if(F.col("_step") < 0) == 0) | (F.count_if(F.col("_step") > 0) == 0)).alias("monotonic"),
    )


def decay(
    bars: DataFrame, keys: Sequence[str], x: str, horizons: Sequence[int] = DECAY_HORIZONS, price: str = "close",
) -> DataFrame:
    """Rank correlation at several forward horizons; ``bars`` is wide with the factor column ``x``."""
    order = Window.partitionBy("symbol", "timeframe", "year").orderBy("open_time")
    ahead = bars.select(
        *keys, x, price, *[F.lead(price, h).over(order).alias(f"_p{h}") for h in horizons]
    ).select(*keys, x, *[(F.try_divide(F.col(f"_p{h}"), F.col(price)) - 1).alias(str(h)) for h in horizons])
    long = ahead.unpivot([*keys, x], [str(h) for h in horizons], "horizon", "forward_return")
    long = long.withColumn("horizon", F.col("horizon").cast("int"))
    return spearman(long, [*keys, "horizon"], x, "forward_return", "ic")


def half_life(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First horizon whose absolute IC is below half that of the first horizon."""
    order = Window.partitionBy(*keys).orderBy("horizon").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first(F.abs("ic")).over(order)
    return points.withColumn("_base", base).groupBy(*keys).agg(
        F.min(F.when(F.abs("ic") < F.col("_base") / 2, F.col("horizon"))).alias("half_life")
    )


def stability(
    df: DataFrame, keys: Sequence[str], x: str = "factor_value", y: str = "future_return_1", block: int = STABILITY_BLOCK,
) -> DataFrame:
    """Rank correlation per consecutive block of rows, and its spread over full blocks.

    Blocks are cut from all rows; inside a block the correlation uses the complete pairs.  A block has ``block`` rows at
    most, so its ranks are a plain window.
    """
    from barloom.functions.stats import with_row_index

    keys = list(keys)
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    cut = with_row_index(df.select(*keys, "open_time", "symbol", x, y), keys, "open_time", ["symbol"], "_row").select(
        *keys, F.floor(F.col("_row") / block).alias("_block"), F.when(pair, F.col(x)).alias("_x"), F.when(pair, F.col(y)).alias("_y")
    )
    ranked = local_ranks(cut, [*keys, "_block"], {"_rx": "_x", "_ry": "_y"})
    ics = ranked.groupBy(*keys, "_block").agg(
        pearson(F.col("_rx"), F.col("_ry")).alias("ic"), F.count("_x").alias("_pairs"), F.count(F.lit(1)).alias("_rows")
    ).filter((F.col("_rows") == block) & (F.col("_pairs") > 0))
    out = ics.groupBy(*keys).agg(
        F.count("ic").alias("blocks"), F.avg("ic").alias("mean_ic"), F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("std_ic"),
        F.min("ic").alias("min_ic"), F.max("ic").alias("max_ic"),
    )
    score = F.least(F.greatest(1 - F.try_divide("std_ic", F.abs("mean_ic")), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("stability_score", F.coalesce(score, F.lit(0.0)))


def correlation_matrix(
    wide: DataFrame, group: str, factors: Sequence[str], method: str = "pearson", ids: Sequence[str] = ("symbol", "timeframe", "open_time"),
) -> DataFrame:
    """Correlation of every pair of factor columns on rows where all of them are present; ``ids`` name a row."""
    whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in factors])
    rows = wide.filter(whole)
    if method == "spearman":
        rows = unpivoted_ranks(rows, ids, [group], list(factors))
    pairs = pair_correlations(rows, group, list(factors), signed=True)
    names = F.array(*[F.lit(f) for f in factors])
    return pairs.select(
        group, F.element_at(names, F.col("a") + 1).alias("factor_a"), F.element_at(names, F.col("b") + 1).alias("factor_b"), "overlap", "corr"
    )


def highly_correlated(matrix: DataFrame, limit: float = HIGH_CORRELATION) -> DataFrame:
    return matrix.filter(F.abs("corr") >= limit)


def leaderboard(panel: DataFrame, horizons: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """Mean rank correlation per factor over every symbol, timeframe and horizon, best first."""
    names = [f"future_return_{h}" for h in horizons]
    keys = ["factor_name", "symbol", "timeframe"]
    long = panel.unpivot([*keys, "factor_value"], names, "horizon", "forward_return")
    runs = spearman(long, [*keys, "horizon"], "factor_value", "forward_return", "rank_ic")
    out = runs.groupBy("factor_name").agg(
        F.count("rank_ic").alias("runs"), F.count_if(F.col("rank_ic").isNull()).alias("skipped"), F.avg("rank_ic").alias("mean_rank_ic")
    )
    return out.orderBy(F.col("mean_rank_ic").desc_nulls_last(), "factor_name")


def research_summary(ics: DataFrame) -> DataFrame:
    """Means overall and per factor, symbol and timeframe, in one grouping-set aggregate."""
    return ics.groupingSets(
        [[], ["factor_name"], ["symbol"], ["timeframe"]], "factor_name", "symbol", "timeframe"
    ).agg(F.count("ic").alias("runs"), F.avg("ic").alias("mean_ic"), F.max("ic").alias("best_ic"), F.min("ic").alias("worst_ic"))


def prediction_distribution(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments, percentiles and sign shares of predictions per key."""
    p = F.col("prediction")
    stats = predictions.groupBy(*keys).agg(
        F.count(p).alias("count"), F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"),
        (F.count_if(p > 0) / F.count(p)).alias("positive_ratio"), (F.count_if(p < 0) / F.count(p)).alias("negative_ratio"),
    )
    cuts = quantiles(predictions, keys, "prediction", [0.5, *PERCENTILES])
    named = cuts.select(*keys, F.col("quantiles")[0].alias("median"), *[
        F.col("quantiles")[i + 1].alias(f"p{str(q)[2:].ljust(2, '0')}") for i, q in enumerate(PERCENTILES)
    ])
    return stats.join(named, list(keys))


def threshold_profiles(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Buy and sell thresholds per key and profile with the signal shares they would give."""
    keys = list(keys)
    names = list(PROFILES)
    wanted = [q for pair in PROFILES.values() for q in pair]
    cuts = quantiles(predictions, keys, "prediction", wanted)
    profiles = cuts.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("profile"), F.col("quantiles")[2 * i].alias("buy_threshold"), F.col("quantiles")[2 * i + 1].alias("sell_threshold"))
        for i, n in enumerate(names)
    ])).alias("p")).select(*keys, "p.*").filter("buy_threshold > sell_threshold")
    # One row per key and profile, joined by key: three rows per key.
    hits = predictions.select(*keys, "prediction").join(profiles, keys).groupBy(*keys, "profile", "buy_threshold", "sell_threshold").agg(
        F.avg((F.col("prediction") >= F.col("buy_threshold")).cast("double")).alias("expected_buy_ratio"),
        F.avg((F.col("prediction") <= F.col("sell_threshold")).cast("double")).alias("expected_sell_ratio"),
    )
    return hits.withColumn("expected_hold_ratio", 1 - F.col("expected_buy_ratio") - F.col("expected_sell_ratio"))


def calibrate(predictions: DataFrame) -> DataFrame:
    """Profiles per (symbol, timeframe) and over all predictions of a model (symbol and timeframe ``*``)."""
    keys = ["symbol", "timeframe", "model_name", "model_version"]
    everything = predictions.withColumn("symbol", F.lit("*")).withColumn("timeframe", F.lit("*"))
    return threshold_profiles(predictions, keys).unionByName(threshold_profiles(everything, keys))
