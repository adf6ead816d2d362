"""Cross-sectional tests of factors: IC, decay, quantile spread, monotonicity, turnover, rank IC.

The panel is shuffled once by (factor, symbol) for the next value of each symbol and once by
(factor, bar time); everything else runs on one row per (factor, bar time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.stats import pair_count, pearson, spearman, t_p_value

from .panel import IDENTITY

# Test parameters.
DECAY_HORIZONS = (1, 2, 3, 5, 10, 20)
MIN_PAIRS = 2
QUANTILES = 5
MIN_SECTION = 5
TOP_SHARE = 5

VALUE, RETURN = "factor_value", "future_return_1"


def horizons_of(panel: DataFrame) -> list[int]:
    return [h for h in DECAY_HORIZONS if f"future_return_{h}" in panel.columns]


def section_ic(panel: DataFrame) -> DataFrame:
    """Pearson IC per (factor, bar time) and horizon, over at least two pairs."""
    hs = horizons_of(panel)
    per_time = panel.groupBy(*IDENTITY, "open_time").agg(
        *[pair_count(F.col(VALUE), F.col(f"future_return_{h}")).alias(f"n_{h}") for h in hs],
        *[pearson(F.col(VALUE), F.col(f"future_return_{h}")).alias(f"_ic_{h}") for h in hs],
    )
    return per_time.select(
        *IDENTITY, "open_time",
        *[F.when(F.col(f"n_{h}") >= MIN_PAIRS, F.col(f"_ic_{h}")).alias(f"ic_{h}") for h in hs],
    )


def ic_statistics(panel: DataFrame) -> DataFrame:
    """Mean IC, its deviation, information ratio, t statistic and decay per factor."""
    hs = horizons_of(panel)
    stats = section_ic(panel).groupBy(*IDENTITY).agg(
        F.avg("ic_1").alias("information_coefficient"),
        F.stddev_samp("ic_1").alias("ic_std"),
        F.count("ic_1").alias("ic_observations"),
        *[F.avg(f"ic_{h}").alias(f"mean_ic_{h}") for h in hs],
    )
    ratio = F.try_divide("information_coefficient", "ic_std")
    defined = F.col("ic_observations") >= MIN_PAIRS
    first, last = F.col(f"mean_ic_{hs[0]}"), F.col(f"mean_ic_{hs[-1]}")
    return stats.select(
        *IDENTITY, "information_coefficient", "ic_std", "ic_observations",
        F.when(defined, ratio).alias("ic_information_ratio"),
        F.when(defined, ratio * F.sqrt(F.col("ic_observations").cast("double"))).alias("ic_t_stat"),
        (F.try_divide(last, first) if len(hs) > 1 else F.lit(None).cast("double")).alias("ic_decay"),
    )


def quantile_statistics(panel: DataFrame) -> DataFrame:
    """Mean top-minus-bottom return and share of monotonic bar times per factor."""
    # The time leads the sort, as in every window of this module over bar times: names are shared by many rows.
    section = Window.partitionBy("open_time", *IDENTITY)
    ranked = panel.filter(F.col(VALUE).isNotNull() & F.col(RETURN).isNotNull()).select(
        *IDENTITY, "open_time", RETURN,
        F.count(F.lit(1)).over(section).alias("_n"),
        F.row_number().over(section.orderBy(VALUE, "symbol")).alias("_rank"),
    )
    bucket = F.floor((F.col("_rank") - 1) * QUANTILES / F.col("_n"))
    per_time = ranked.filter(F.col("_n") >= MIN_SECTION).withColumn("_q", bucket).groupBy(*IDENTITY, "open_time").agg(
        *[F.avg(F.when(F.col("_q") == q, F.col(RETURN))).alias(f"q{q + 1}") for q in range(QUANTILES)]
    )
    steps = [(F.col(f"q{i}"), F.col(f"q{i + 1}")) for i in range(1, QUANTILES)]
    rising, falling = F.lit(True), F.lit(True)
    for a, b in steps:
        rising, falling = rising & (a <= b), falling & (a >= b)
    return per_time.groupBy(*IDENTITY).agg(
        F.avg(F.col(f"q{QUANTILES}") - F.col("q1")).alias("quantile_spread"),
        F.avg(F.when(rising | falling, 1.0).otherwise(0.0)).alias("monotonicity_score"),
    )


def turnover(panel: DataFrame) -> DataFrame:
    """Mean share of the top fifth that is replaced from one bar time to the next."""
    held = panel.filter(F.col(VALUE).isNotNull()).select(*IDENTITY, "open_time", "symbol", VALUE)
    own = Window.partitionBy(*IDENTITY, "symbol").orderBy("open_time")
    moved = held.withColumn("_next_time", F.lead("open_time").over(own)).withColumn("_next", F.lead(VALUE).over(own))
    step = Window.partitionBy("open_time", "_next_time", *IDENTITY)
    ranked = moved.filter(F.col("_next_time").isNotNull()).select(
        *IDENTITY, "open_time", "_next_time",
        F.count(F.lit(1)).over(step).alias("_common"),
        F.row_number().over(step.orderBy(F.col(VALUE).desc(), "symbol")).alias("_now"),
        F.row_number().over(step.orderBy(F.col("_next").desc(), "symbol")).alias("_then"),
    )
    top = F.greatest(F.lit(1), F.floor(F.col("_common") / TOP_SHARE))
    per_step = ranked.filter(F.col("_common") >= MIN_SECTION).groupBy(*IDENTITY, "open_time", "_next_time").agg(
        (1.0 - F.count_if((F.col("_now") <= top) & (F.col("_then") <= top)) / F.max(top)).alias("_turnover")
    )
    # A step counts when it ends at the factor's next bar time, not only at the symbols' next bar.
    times = held.groupBy(*IDENTITY, "open_time").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_next_time", F.lead("open_time").over(Window.partitionBy(*IDENTITY).orderBy("open_time"))
    ).drop("_n")
    return per_step.join(times, [*IDENTITY, "open_time", "_next_time"]).groupBy(*IDENTITY).agg(
        F.avg("_turnover").alias("turnover")
    )


def rank_ic(panel: DataFrame) -> DataFrame:
    """Spearman correlation over all rows of a factor together."""
    return spearman(panel, IDENTITY, VALUE, RETURN, "rank_information_coefficient").drop("pairs")


def coverage(panel: DataFrame) -> DataFrame:
    # Per category first: an aggregate that carries text would sort all rows.
    parts = panel.groupBy(*IDENTITY, "factor_category").agg(
        F.min("open_time").alias("_start"), F.max("open_time").alias("_end"), pair_count(F.col(VALUE), F.col(RETURN)).alias("_pairs"),
    )
    return parts.groupBy(*IDENTITY).agg(
        F.max_by("factor_category", "_end").alias("factor_category"),
        F.min("_start").alias("validation_start_time"),
        F.max("_end").alias("validation_end_time"),
        F.sum("_pairs").alias("observations"),
    )


METRICS = (
    "information_coefficient", "rank_information_coefficient", "ic_information_ratio", "ic_std", "ic_t_stat",
    "ic_p_value", "ic_decay", "quantile_spread", "monotonicity_score", "turnover",
)
GATED = METRICS[:6]


def factor_validation(panel: DataFrame) -> DataFrame:
    """One row per (factor, version, timeframe) with every test statistic and a PASS/FAIL status."""
    out = coverage(panel)
    for part in (ic_statistics(panel), quantile_statistics(panel), turnover(panel), rank_ic(panel)):
        out = out.join(part, IDENTITY, "left")
    out = out.withColumn("ic_p_value", t_p_value(F.col("ic_t_stat"), F.col("ic_observations") - 1))
    enough = F.col("observations") >= MIN_PAIRS
    return out.select(
        *IDENTITY, "factor_category", "validation_start_time", "validation_end_time",
        F.col("validation_end_time").alias("validation_time"), "observations", "ic_observations",
        *[F.when(enough, F.col(m)).alias(m) if m in GATED else F.col(m) for m in METRICS],
        F.when(enough, "PASS").otherwise("FAIL").alias("status"),
    )


REPORT_SIZE = 20
REPORT_METRICS = ("information_coefficient", "rank_information_coefficient", "ic_information_ratio", "quantile_spread")


def latest_per_factor(validation: DataFrame) -> DataFrame:
    newest = Window.partitionBy(*IDENTITY).orderBy(F.col("validation_time").desc())
    return validation.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def top_factors(validation: DataFrame, size: int = REPORT_SIZE) -> DataFrame:
    """The report's ranking: passing factors by four metrics."""
    order = [F.col(m).desc_nulls_last() for m in REPORT_METRICS] + [F.col(c) for c in IDENTITY]
    return latest_per_factor(validation).filter("status = 'PASS'").orderBy(*order).limit(size)


def metric_distribution(validation: DataFrame) -> DataFrame:
    """Count, moments, range and quartiles of every metric over the latest factor rows."""
    names = [m for m in METRICS if m in validation.columns]
    long = latest_per_factor(validation).unpivot(IDENTITY, names, "metric", "value")
    quartiles = F.percentile("value", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]))
    return long.groupBy("metric").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), quartiles.alias("_q"), F.max("value").alias("max"),
    ).select(
        "metric", "count", "mean", "std", "min", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"),
        F.col("_q")[2].alias("q75"), "max",
    )


def status_counts(validation: DataFrame) -> DataFrame:
    return latest_per_factor(validation).groupBy("timeframe", "status").agg(F.count(F.lit(1)).alias("factors"))
