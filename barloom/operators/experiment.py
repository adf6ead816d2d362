"""Experiments: every single-factor statistic for a list of factors, over one stored table of ranks.

The rank layer holds a row per factor, bar and horizon with a value and a return: both, and their ranks within factor
and horizon.  Values of all factors and horizons are ranked in one pass, returns in another; correlations, decay and
quantiles read the layer and rank nothing again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.stats import by_shuffle, correlation_t, pearson, quantiles, t_p_value, value_ranks
from barloom.operators.research import (
    HIGH_CORRELATION, QUANTILES, STABILITY_BLOCK, correlation_matrix, half_life, quantile_summary, stability,
)

FACTOR = "factor_name"
#: Writes a table and reads it again: cuts lineage, so that what reads it does not compute it again.
Keep = Callable[[str, DataFrame], DataFrame]


class Experiment(NamedTuple):
    """Results per key and factor."""

    coefficients: DataFrame  # pairs, ic, p_value, rank_ic at the primary horizon
    decay: DataFrame  # rank IC per horizon
    half_lives: DataFrame
    quantiles: DataFrame  # return statistics per bucket of values
    spreads: DataFrame  # top minus bottom bucket, monotonic
    stability: DataFrame
    correlations: DataFrame | None  # between factors; None for a single one


def rank_layer(panel: DataFrame, keys: Sequence[str], returns: Mapping[int, str]) -> DataFrame:
    """keys, factor_name, horizon, symbol, open_time, x, y, and for both the average rank and the rows before.

    ``panel`` is long (factor_name, factor_value) with a return column per horizon.  Rows with both a value and a return
    take part; ranks are within keys, factor and horizon.
    """
    keys = list(keys)
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("y")) for h, c in returns.items()])
    rows = (panel.filter(F.col("factor_value").isNotNull())
            .select(*keys, FACTOR, "symbol", "open_time", (F.col("factor_value") + F.lit(0.0)).alias("x"), F.explode(cells).alias("cell"))
            .select(*keys, FACTOR, "symbol", "open_time", "x", "cell.horizon", (F.col("cell.y") + F.lit(0.0)).alias("y")).filter(F.col("y").isNotNull()))
    group, out = [*keys, FACTOR, "horizon"], rows
    for v in ("x", "y"):
        ranks = value_ranks(rows, group, v).select(*group, v, F.col("avg_rank").alias(f"rank_{v}"), F.col("before").alias(f"before_{v}"), F.col("ties").alias(f"ties_{v}"))
        out = out.join(by_shuffle(ranks), [*group, v])
    return out


def coefficients(layer: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation with its p-value and rank correlation per key, factor and horizon; at least two pairs."""
    out = layer.groupBy(*keys, FACTOR, "horizon").agg(
        F.count(F.lit(1)).alias("pairs"), pearson(F.col("x"), F.col("y")).alias("ic"), pearson(F.col("rank_x"), F.col("rank_y")).alias("rank_ic")
    ).filter("pairs >= 2")
    exact = F.when(F.abs("ic") >= 1.0, F.lit(0.0))
    t = correlation_t(F.col("ic"), F.col("pairs"))
    return out.withColumn("p_value", F.when(F.col("pairs") > 2, F.coalesce(t_p_value(t, F.col("pairs") - 2), exact)))


def _ordinals(layer: DataFrame, group: Sequence[str]) -> DataFrame:
    """The layer's rows with ``place`` (from 1) by value, then time, then symbol.

    Only equal values are looked at again: they are counted time by time and numbered within a time.
    """
    group = list(group)
    alone = layer.filter("ties_x = 1").withColumn("place", F.col("before_x") + 1)
    tied = layer.filter("ties_x > 1")
    earlier = Window.partitionBy(*group, "x").orderBy("open_time").rowsBetween(Window.unboundedPreceding, -1)
    starts = tied.groupBy(*group, "x", "open_time").agg(F.count(F.lit(1)).alias("_n")).select(
        *group, "x", "open_time", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy(*group, "x", "open_time").orderBy("symbol"))
    numbered = tied.join(by_shuffle(starts), [*group, "x", "open_time"]).withColumn("place", F.col("before_x") + F.col("_start") + inside).drop("_start")
    return alone.unionByName(numbered)


def quantile_statistics(layer: DataFrame, keys: Sequence[str], buckets: int = QUANTILES) -> DataFrame:
    """Return statistics per equal-frequency bucket of the values, per key, factor and horizon."""
    group = [*keys, FACTOR, "horizon"]
    sizes = layer.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    placed = _ordinals(layer, group).join(sizes, group).withColumn("quantile", (F.floor((F.col("place") - 1) * buckets / F.col("_n")) + 1).cast("int"))
    stats = placed.groupBy(*group, "quantile").agg(
        F.count(F.lit(1)).alias("count"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.min("y").alias("min"), F.max("y").alias("max")
    )
    medians = quantiles(placed, [*group, "quantile"], "y", [0.5]).select(*group, "quantile", F.col("quantiles")[0].alias("median"))
    return stats.join(medians, [*group, "quantile"])


def experiment(
    panel: DataFrame, wide: DataFrame | None, factors: Sequence[str], returns: Mapping[int, str], keep: Keep,
    keys: Sequence[str] = ("timeframe",), primary: int = 1, buckets: int = QUANTILES, block: int = STABILITY_BLOCK,
) -> Experiment:
    """All single-factor statistics of ``factors`` per key, from one rank layer.

    ``panel`` is long with a return column per horizon of ``returns``; ``wide`` has a column per factor and gives the
    correlations between factors.  The quantiles, spreads and stability are those of the primary horizon.
    """
    if not factors:
        raise ValueError("an experiment needs at least one factor")
    if primary not in returns:
        raise ValueError("the primary horizon must be one of the returns")
    keys = list(keys)
    chosen = panel.filter(F.col(FACTOR).isin(list(factors)))
    layer = keep("rank_layer", rank_layer(chosen, keys, returns))
    ics = keep("coefficients", coefficients(layer, keys))
    decay = ics.select(*keys, FACTOR, "horizon", F.col("rank_ic").alias("ic"))
    first = layer.filter(F.col("horizon") == primary)
    buckets_of = keep("quantiles", quantile_statistics(first, keys, buckets).drop("horizon"))
    correlations = None
    if len(factors) > 1 and wide is not None:
        group = F.struct(*keys)
        matrix = correlation_matrix(wide.withColumn("_group", group.cast("string")), "_group", list(factors), "spearman")
        names = wide.select(*keys).distinct().withColumn("_group", group.cast("string"))
        correlations = matrix.join(names, "_group").drop("_group")
    return Experiment(
        ics.filter(F.col("horizon") == primary).drop("horizon"), decay, half_life(decay, [*keys, FACTOR]), buckets_of,
        quantile_summary(buckets_of, [*keys, FACTOR], buckets), stability(chosen, [*keys, FACTOR], y=returns[primary], block=block), correlations,
    )


def tidy(found: Experiment, keys: Sequence[str] = ("timeframe",), limit: float = HIGH_CORRELATION) -> DataFrame:
    """All numbers of an experiment as rows: keys, factor_name, statistic, other (second factor), part (horizon or bucket), value."""
    keys = list(keys)

    def rows(df: DataFrame, names: Sequence[str], prefix: str = "", part: Column | None = None, other: Column | None = None) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(f"{prefix}{n}").alias("statistic"), F.col(n).cast("double").alias("value")) for n in names])
        return df.select(
            *keys, FACTOR, F.explode(cells).alias("cell"), (F.lit(None) if other is None else other).cast("string").alias("other"),
            (F.lit(None) if part is None else part).cast("int").alias("part"),
        ).select(*keys, FACTOR, "cell.statistic", "other", "part", "cell.value")

    parts = [
        rows(found.coefficients, ["pairs", "ic", "p_value", "rank_ic"]),
        rows(found.decay, ["ic"], "decay_", F.col("horizon")),
        rows(found.half_lives, ["half_life"]),
        rows(found.quantiles, ["count", "mean", "std", "min", "max", "median"], "quantile_", F.col("quantile")),
        rows(found.spreads, ["spread", "monotonic"]),
        rows(found.stability, ["blocks", "mean_ic", "std_ic", "min_ic", "max_ic", "stability_score"], "stability_"),
    ]
    if found.correlations is not None:
        pairs = found.correlations.withColumnRenamed("factor_a", FACTOR).withColumn("high", F.abs("corr") >= limit)
        parts.append(rows(pairs, ["corr", "high"], "pair_", other=F.col("factor_b")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rolling_windows(panel: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """Rows of every rolling test window, with its number ``window`` (from 0): bar times train + k * step and the following ``test``.

    A window is complete or left out.  Bar times are numbered per timeframe; a row goes to each of the at most
    ceil(test / step) windows that hold it.
    """
    if min(train, test, step) < 1:
        raise ValueError("train, test and step must be positive")
    times = panel.select("timeframe", "open_time").distinct()
    order, whole = Window.partitionBy("timeframe").orderBy("open_time"), Window.partitionBy("timeframe")
    at = F.row_number().over(order) - 1
    numbered = times.select("timeframe", "open_time", at.alias("_at"), F.count(F.lit(1)).over(whole).alias("_n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - train - test + 1) / step))
    last = F.least(F.floor((F.col("_at") - train) / step), F.floor((F.col("_n") - train - test) / step))
    windows = numbered.filter((F.col("_n") >= train + test) & (first <= last)).select(
        "timeframe", "open_time", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("window"))
    return panel.join(windows, ["timeframe", "open_time"])


def rolling(panel: DataFrame, target: str, train: int, test: int, step: int, keep: Keep, buckets: int = QUANTILES) -> DataFrame:
    """Per timeframe, test window and factor: pairs, ic, rank_ic and quantile spread of the window's rows alone."""
    keys = ["timeframe", "window"]
    layer = keep("rolling_layer", rank_layer(rolling_windows(panel, train, test, step), keys, {1: target}))
    spreads = quantile_summary(quantile_statistics(layer, keys, buckets), [*keys, FACTOR], buckets)
    return coefficients(layer, keys).select(*keys, FACTOR, "pairs", "ic", "rank_ic").join(spreads.select(*keys, FACTOR, "spread"), [*keys, FACTOR], "left")


def rolling_summary(windows: DataFrame) -> DataFrame:
    """Per timeframe: windows, and the means over windows of each window's mean over factors; stability 1 - std / |mean| of the IC, from 0 to 1."""
    per_window = windows.groupBy("timeframe", "window").agg(*[F.avg(c).alias(c) for c in ("ic", "rank_ic", "spread")])
    out = per_window.groupBy("timeframe").agg(
        F.count(F.lit(1)).alias("windows"), F.avg("ic").alias("mean_ic"), F.avg("rank_ic").alias("mean_rank_ic"),
        F.avg("spread").alias("mean_quantile_spread"), F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("_sd"),
    )
    score = F.when(F.col("mean_ic") == 0, F.lit(0.0)).otherwise(F.least(F.greatest(1 - F.col("_sd") / F.abs("mean_ic"), F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("stability", score).drop("_sd")


def universe_runs(panel: DataFrame, universe: DataFrame, returns: Mapping[int, str], keep: Keep) -> DataFrame:
    """One run per factor, series and horizon of ``universe`` (factor_name, symbol, timeframe), with what became of it.

    ``status`` is COMPLETED, or SKIPPED with the ``stage`` and ``reason``: compute / NO_VALUES if the factor has no value in the
    series, analyze / TOO_FEW_PAIRS with fewer than two complete pairs, analyze / CONSTANT if values or returns do not vary.
    """
    keys = ["symbol", "timeframe"]
    run = [FACTOR, *keys, "horizon"]
    wanted = universe.select(FACTOR, *keys).distinct().withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in returns])))
    values = panel.groupBy(FACTOR, *keys).agg(F.count("factor_value").alias("values"))
    ics = coefficients(keep("universe_layer", rank_layer(panel, keys, returns)), keys).select(*run, "pairs", "ic", "rank_ic")
    joined = wanted.join(values, [FACTOR, *keys], "left").join(ics, run, "left")
    stage = F.when(F.coalesce("values", F.lit(0)) == 0, "compute").when(F.col("rank_ic").isNull(), "analyze")
    reason = F.when(stage == "compute", "NO_VALUES").when(F.col("pairs").isNull(), "TOO_FEW_PAIRS").when(F.col("rank_ic").isNull(), "CONSTANT")
    return joined.select(*run, F.coalesce("pairs", F.lit(0)).alias("pairs"), "ic", "rank_ic",
                         F.when(stage.isNull(), "COMPLETED").otherwise("SKIPPED").alias("status"), stage.alias("stage"), reason.alias("reason"))


def universe_leaderboard(runs: DataFrame) -> DataFrame:
    """Per factor: completed and skipped runs by stage, mean rank IC and mean absolute one over completed runs, and its rank, best first."""
    out = runs.groupBy(FACTOR).agg(
        F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("stage") == "compute").alias("failed_compute"),
        F.count_if(F.col("stage") == "analyze").alias("failed_analyze"), F.avg("rank_ic").alias("mean_rank_ic"), F.avg(F.abs("rank_ic")).alias("mean_abs_rank_ic"),
    )
    # One row per factor of the catalog.
    place = Window.orderBy(F.col("mean_rank_ic").desc_nulls_last(), FACTOR)
    return out.withColumn("place", F.row_number().over(place))
