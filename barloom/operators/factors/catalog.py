"""The factor catalog, input alignment, and wide/long evaluation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.series import SERIES_KEYS, Series, split_series

from . import derivatives, flow, price, relative
from .model import Factor

CATALOG: dict[str, Factor] = {
    f.name: f for family in (price, flow, derivatives, relative) for f in family.FACTORS
}

BAR_INPUTS = frozenset({"open", "high", "low", "close", "trade_count"})
VOLUME_INPUTS = frozenset({"volume"})
# Companion columns by the dataset that supplies them.
COMPANIONS = {
    "open_interest": ("open_interest",),
    "taker_volume": ("taker_buy_volume", "taker_sell_volume"),
    "long_short": ("long_short_ratio",),
    "funding": ("funding_rate", "mark_price"),
}
COMPANION_OF = {column: dataset for dataset, columns in COMPANIONS.items() for column in columns}
SINGLE_CLASS = {
    "open_interest": "OI_DEPENDENT",
    "taker_volume": "TAKER_DEPENDENT",
    "long_short": "LONG_SHORT_DEPENDENT",
    "funding": "FUNDING_DEPENDENT",
}


def register(factor: Factor) -> None:
    """Add a user-defined factor to the catalog."""
    if factor.name in CATALOG:
        raise ValueError(f"factor already registered: {factor.name}")
    CATALOG[factor.name] = factor


def required_datasets(factor: Factor) -> tuple[str, ...]:
    companions = {COMPANION_OF[c] for c in factor.inputs if c in COMPANION_OF}
    return ("ohlcv", *sorted(companions))


def dependency_class(factor: Factor) -> str:
    inputs = set(factor.inputs)
    companions = {COMPANION_OF[c] for c in inputs if c in COMPANION_OF}
    unknown = inputs - BAR_INPUTS - VOLUME_INPUTS - set(COMPANION_OF)
    if len(companions) > 1 or (unknown and companions):
        return "MULTI_COMPANION_DEPENDENT"
    if unknown or not inputs:
        return "UNKNOWN"
    if companions:
        return SINGLE_CLASS[companions.pop()]
    return "OHLCV_PLUS_VOLUME" if inputs & VOLUME_INPUTS else "OHLCV_ONLY"


def executable(columns: Iterable[str], factors: Iterable[Factor] | None = None) -> list[Factor]:
    """Factors whose inputs are all present among ``columns``."""
    have = set(columns)
    return [f for f in (factors or CATALOG.values()) if have.issuperset(f.inputs)]


def metadata_frame(spark: SparkSession, factors: Iterable[Factor]) -> DataFrame:
    return spark.createDataFrame(
        [
            (f.name, f.version, f.category, f.group, f.lookback, f.prediction_horizon, f.enabled, f.status)
            for f in factors
        ],
        "factor_name string, factor_version string, factor_category string, factor_group string, "
        "lookback int, prediction_horizon int, enabled boolean, status string",
    )


def _companions_needed(factor: Factor) -> list[str]:
    """Companion columns whose first complete bar starts the factor; none if only one input is read."""
    needed = sorted(c for c in factor.inputs if c in COMPANION_OF)
    return needed if needed and len(set(factor.inputs)) > 1 else []


def _start_name(needed: Iterable[str]) -> str:
    return "_start_" + "_".join(needed)


def _present(columns: Iterable[str]) -> Column:
    test = F.lit(True)
    for column in columns:
        test = test & F.col(column).isNotNull()
    return test


def _aligned_inputs(series: Series, factor: Factor, known: Iterable[str] = ()) -> tuple[str, ...]:
    """Input names, nulled before the first bar on which every needed companion is present.

    A guarded rolling window over nulled inputs gives exactly what it gives over a frame that starts
    at that bar.  Inputs that all come from one companion column are null there already.
    """
    needed = _companions_needed(factor)
    if not needed:
        return factor.inputs
    tag, start = "_".join(needed), _start_name(needed)
    if start not in known:
        whole = Window.partitionBy(*series.keys).orderBy(series.order).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
        series.over(start, F.min(F.when(_present(needed), F.col(series.order))).over(whole), *needed)
    return tuple(
        series.let(f"{column}__{tag}", F.when(F.col(series.order) >= F.col(start), F.col(column)), column, start)
        for column in factor.inputs
    )


def factor_columns(
    series: Series, factors: Iterable[Factor], align: bool = True, known: Iterable[str] = ()
) -> dict[str, Column]:
    known = set(known)
    return {
        f.name: f.formula(series, _aligned_inputs(series, f, known) if align else f.inputs) for f in factors
    }


def factor_frame(
    df: DataFrame,
    factors: Iterable[Factor] | None = None,
    keep: Iterable[str] = ("symbol", "timeframe", "open_time"),
    carry_over: bool = False,
    align: bool = True,
) -> DataFrame:
    """Wide factor matrix: one row per bar, one column per factor, in a single shuffle.

    Factors whose inputs are missing from ``df`` are left out.  Series state restarts each calendar
    year (``df`` carries a ``year`` column) unless ``carry_over`` is set.
    """
    chosen = executable(df.columns, factors)
    if not chosen:
        raise ValueError("no factor can be computed from the given columns")
    series = Series(tuple(k for k in SERIES_KEYS if k != "year") if carry_over else SERIES_KEYS)
    values = factor_columns(series, chosen, align)
    return series.attach(df).select(*keep, *[v.cast("double").alias(n) for n, v in values.items()])


# Factors whose value depends on the whole history of a series, not on a bounded look-back.
WHOLE_HISTORY = frozenset({
    "accumulation_distribution", "on_balance_volume", "price_volume_trend", "ema_distance", "price_oscillator", "rsi",
})


def split_factor_frame(
    df: DataFrame,
    factors: Iterable[Factor] | None = None,
    keep: Iterable[str] = ("symbol", "timeframe", "open_time"),
    rows_per_part: int = 1_000_000,
) -> DataFrame:
    """The same matrix for series too long for one task, such as a year of one-second bars.

    Series are cut into parts by row index and each part carries the few rows before it that its
    windows reach back to.  Whole-history factors need running state only, which a window streams
    through, and are joined to the rest.
    """
    chosen, keep = executable(df.columns, factors), list(keep)
    bounded = [f for f in chosen if f.name not in WHOLE_HISTORY]
    rest = [f for f in chosen if f.name in WHOLE_HISTORY]
    if not bounded:
        return factor_frame(df, rest, keep)
    groups = {_start_name(n): n for n in map(_companions_needed, bounded) if n}
    frame = df
    if groups:
        starts = df.groupBy(*SERIES_KEYS).agg(
            *[F.min(F.when(_present(n), F.col("open_time"))).alias(name) for name, n in groups.items()]
        )
        frame = df.join(starts, list(SERIES_KEYS))
    # Formulas look back at most two windows of their look-back and a few bars.
    reach = 2 * max(f.lookback for f in bounded) + 10
    parts = split_series(frame, reach, max(rows_per_part, reach))
    series = Series((*SERIES_KEYS, "_part"))
    values = factor_columns(series, bounded, known=groups)
    out = series.attach(parts).filter(~F.col("_carried")).select(*keep, *[v.cast("double").alias(n) for n, v in values.items()])
    if rest:
        out = out.join(factor_frame(df, rest, keep), keep)
    return out.select(*keep, *[f.name for f in chosen])


def factor_long(wide: DataFrame, keys: Iterable[str] = ("symbol", "timeframe", "open_time")) -> DataFrame:
    """Long factor panel with catalog metadata (twelve columns)."""
    keys = list(keys)
    names = [c for c in wide.columns if c not in keys]
    unknown = [c for c in names if c not in CATALOG]
    if unknown:
        raise ValueError(f"no metadata for factor columns {unknown}")
    long = wide.unpivot(keys, names, "factor_name", "factor_value")
    # The metadata has one row per catalog factor, so broadcasting it is bounded by the catalog.
    meta = metadata_frame(wide.sparkSession, [CATALOG[n] for n in names])
    return long.join(F.broadcast(meta), "factor_name").select(
        *keys, "factor_name", "factor_version", "factor_category", "factor_group", "factor_value",
        "lookback", "prediction_horizon", "enabled", "status",
    )
