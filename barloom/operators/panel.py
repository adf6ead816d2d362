"""Joins between factor panels, labels and selection decisions, and wide/long reshaping."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAR_KEY = ["symbol", "timeframe", "open_time"]
IDENTITY = ["factor_name", "factor_version", "timeframe"]


def validation_panel(factors: DataFrame, labels: DataFrame, melt: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> DataFrame:
    """Long factor rows with the forward returns of their bar.

    With ``melt``, which makes long rows that keep the named columns, ``factors`` has one row per bar.  Bars are then joined
    and dealt by their time before they become long rows, so that one row per bar is shuffled, not one per bar and factor,
    and a task that reads the panel finds whole cross-sections.
    """
    returns = [c for c in labels.columns if c.startswith("future_return_")]
    joined = factors.join(labels.select(*BAR_KEY, *returns), BAR_KEY)
    if melt is None:
        return joined
    long = melt(joined.repartition("timeframe", "open_time"), [*BAR_KEY, *returns])
    return long.select(*[c for c in long.columns if c not in returns], *returns)


def evaluation_panel(panel: DataFrame, selection: DataFrame) -> DataFrame:
    """Panel rows with the selection decision of their factor; one row per (bar, factor)."""
    decisions = selection.select(
        *IDENTITY, "selected", F.col("information_coefficient").alias("selection_ic"),
        F.col("rank_information_coefficient").alias("selection_rank_ic"),
        F.when(F.col("information_coefficient") < 0, -1).otherwise(1).cast("tinyint").alias("selected_direction"),
        F.lit("sign_of_ic").alias("orientation_policy"),
    )
    # One decision per catalog factor and timeframe; AQE broadcasts it by its measured size.
    return panel.join(decisions, IDENTITY).withColumn("selection_time", F.col("open_time"))


def long_to_wide(panel: DataFrame, names: Sequence[str], keys: Sequence[str] = tuple(BAR_KEY)) -> DataFrame:
    """Pivot to one column per named factor (first value per key)."""
    return panel.groupBy(*keys).agg(
        *[F.first(F.when(F.col("factor_name") == n, F.col("factor_value")), ignorenulls=True).alias(n) for n in names]
    )
