"""Backward as-of joins and input assembly.

The join is a union of bars and companion rows in time order followed by ``last(..., ignorenulls)``:
one shuffle on the series key whatever the number of companions, and no range join.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.clock import SECOND_MS, utc_year
from barloom.functions.series import SERIES_KEYS


@dataclass(frozen=True)
class Companion:
    """A companion series: ``values`` maps source columns to output columns."""

    name: str
    frame: DataFrame
    time: str
    values: dict[str, str]
    floor_to_second: bool = False
    per_timeframe: bool = field(default=False)


def asof_join(bars: DataFrame, companions: Sequence[Companion], by_year: bool = True) -> DataFrame:
    """Attach to every bar the latest companion row at or before its open time.

    A companion row whose *values* are null still counts as the latest row.  With ``by_year`` the
    search does not reach back over the turn of the year, like the series state of factors.
    """
    out = bars
    for per_timeframe in (False, True):
        group = [c for c in companions if c.per_timeframe == per_timeframe]
        if group:
            out = _asof_pass(out, group, per_timeframe, by_year)
    return out


def _asof_pass(bars: DataFrame, companions: Sequence[Companion], per_timeframe: bool, by_year: bool) -> DataFrame:
    keys = ["symbol"] + (["timeframe"] if per_timeframe else []) + (["year"] if by_year else [])
    names = [f"_c_{c.name}" for c in companions]
    left = bars.select(
        *[F.col(k) for k in keys],
        F.col("open_time").alias("_time"),
        F.lit(True).alias("_is_bar"),
        F.struct(*[F.col(c) for c in bars.columns]).alias("_bar"),
    )
    stacked = left
    for c, name in zip(companions, names):
        time = F.col(c.time)
        if c.floor_to_second:
            time = F.floor(time / SECOND_MS).cast("long") * SECOND_MS
        key_columns = [F.col(k) for k in keys if k != "year"] + ([utc_year(time).alias("year")] if by_year else [])
        right = c.frame.select(
            *key_columns,
            time.alias("_time"),
            F.lit(False).alias("_is_bar"),
            F.col(c.time).alias("_exact"),
            F.struct(*[F.col(a).cast("double").alias(b) for a, b in c.values.items()]).alias(name),
        )
        stacked = stacked.unionByName(right, allowMissingColumns=True)
    upto = (
        Window.partitionBy(*keys)
        # Companion rows of one floored time follow by their own time, those of one time by their values: the last counts.
        .orderBy("_time", "_is_bar", "_exact", *names)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = stacked.select(
        "_bar", "_is_bar", *[F.last(name, ignorenulls=True).over(upto).alias(name) for name in names]
    ).filter("_is_bar")
    return joined.select("_bar.*", *[f"{name}.*" for name in names])


def factor_inputs(
    bars: DataFrame, funding: DataFrame, open_interest: DataFrame, taker: DataFrame, long_short: DataFrame
) -> DataFrame:
    """Bars with every companion column the factor catalog reads; funding times lose their milliseconds."""
    return asof_join(
        bars,
        [
            Companion("funding", funding, "funding_time",
                      {"funding_rate": "funding_rate", "mark_price": "mark_price"}, floor_to_second=True),
            Companion("oi", open_interest, "timestamp", {"open_interest": "open_interest"}),
            Companion("taker", taker, "timestamp",
                      {"buy_volume": "taker_buy_volume", "sell_volume": "taker_sell_volume"}),
            Companion("ls", long_short, "timestamp", {"long_short_ratio": "long_short_ratio"}),
        ],
    )


FEATURE_COMPANIONS = ("funding_rate", "open_interest", "buy_volume", "sell_volume", "long_short_ratio")


def feature_inputs(
    bars: DataFrame, funding: DataFrame, open_interest: DataFrame, taker: DataFrame, long_short: DataFrame,
    trim: bool = True,
) -> DataFrame:
    """Bars with the companion columns model features read, from the first complete bar on."""
    joined = asof_join(
        bars,
        [
            Companion("funding", funding, "funding_time", {"funding_rate": "funding_rate"}),
            Companion("oi", open_interest, "timestamp", {"open_interest": "open_interest"}),
            Companion("taker", taker, "timestamp", {"buy_volume": "buy_volume", "sell_volume": "sell_volume"}),
            Companion("ls", long_short, "timestamp", {"long_short_ratio": "long_short_ratio"}),
        ],
    )
    return trim_leading(joined, FEATURE_COMPANIONS) if trim else joined


def complete(columns: Iterable[str]):
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull()
    return test


def trim_leading(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop the bars of each series before its first bar on which all ``columns`` are present."""
    whole = Window.partitionBy(*SERIES_KEYS).orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(complete(columns).cast("int")).over(whole)
    return df.withColumn("_seen", seen).filter("_seen = 1").drop("_seen")


def first_complete_times(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """First bar per series on which each named group of columns is complete."""
    return df.groupBy(*SERIES_KEYS).agg(
        F.min("open_time").alias("first_bar"),
        *[F.min(F.when(complete(cols), F.col("open_time"))).alias(f"first_{n}") for n, cols in groups.items()],
    )
