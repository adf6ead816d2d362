"""Model features: 26 window formulas, evaluated side by side with dependency and warm-up handling."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import SERIES_KEYS, Series
from barloom.operators.factors.model import simple_return, true_range


@dataclass(frozen=True)
class Feature:
    """``inputs`` are input columns or other features; ``warmup`` is the number of leading bars lost."""

    name: str
    inputs: tuple[str, ...]
    warmup: int
    rule: Callable[..., Column]
    window: int = 20

    def formula(self, s: Series) -> Column:
        return self.rule(s, self.window, *self.inputs)


def atr(s, n, high, low, close):
    return s.mean(true_range(s, high, low, close), n)


def product(s, n, x, y):
    return F.col(x) * F.col(y)


def log_return(s, n, x):
    return F.ln(F.try_divide(F.col(x), s.lag(x)))


def one_bar_return(s, n, x):
    return F.col(simple_return(s, x))


def rolling_max(s, n, x):
    return s.max(x, n)


def rolling_min(s, n, x):
    return s.min(x, n)


def rolling_mean(s, n, x):
    return s.mean(x, n)


def rolling_std(s, n, x):
    return s.std_samp(x, n)


def change(s, n, x):
    return F.col(x) - s.lag(x, n)


def growth(s, n, x):
    return F.try_divide(F.col(x), s.lag(x, n)) - 1


def zscore_or_zero(s, n, x):
    sd = s.std_samp(x, n)
    return F.when(sd == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(x) - s.mean(x, n), sd))


def zscore_or_null(s, n, x):
    return F.try_divide(F.col(x) - s.mean(x, n), s.std_samp(x, n))


def distance_from_parity(s, n, x):
    return F.try_divide(F.col(x) - 1, s.std_samp(x, n))


def share(s, n, x, other):
    return F.try_divide(F.col(x), F.col(x) + F.col(other))


def ratio(s, n, x, y):
    return F.try_divide(F.col(x), F.col(y))


def difference(s, n, x, y):
    return F.col(x) - F.col(y)


def imbalance(s, n, x, y):
    return F.try_divide(F.col(x) - F.col(y), F.col(x) + F.col(y))


CLOSE, RATE, OI, LS = ("close",), ("funding_rate",), ("open_interest",), ("long_short_ratio",)
BUY_SELL, SELL_BUY = ("buy_volume", "sell_volume"), ("sell_volume", "buy_volume")

FEATURES: dict[str, Feature] = {
    f.name: f
    for f in [
        Feature("atr", ("high", "low", "close"), 14, atr, 14),
        Feature("dollar_volume", ("close", "volume"), 0, product),
        Feature("log_returns", CLOSE, 1, log_return, 1),
        Feature("returns", CLOSE, 1, one_bar_return, 1),
        Feature("rolling_max", CLOSE, 20, rolling_max),
        Feature("rolling_mean", CLOSE, 20, rolling_mean),
        Feature("rolling_min", CLOSE, 20, rolling_min),
        Feature("rolling_std", CLOSE, 20, rolling_std),
        Feature("funding_change", RATE, 1, change, 1),
        Feature("funding_momentum", RATE, 20, change),
        Feature("funding_rolling_mean", RATE, 20, rolling_mean),
        Feature("funding_zscore", RATE, 20, zscore_or_zero),
        Feature("oi_change", OI, 1, change, 1),
        Feature("oi_momentum", OI, 20, growth),
        Feature("oi_percent_change", OI, 1, growth, 1),
        Feature("oi_rolling_mean", OI, 20, rolling_mean),
        Feature("oi_zscore", OI, 20, zscore_or_null),
        Feature("crowding_score", LS, 20, distance_from_parity),
        Feature("ratio_change", LS, 1, change, 1),
        Feature("ratio_momentum", LS, 20, change),
        Feature("ratio_zscore", LS, 20, zscore_or_null),
        Feature("buy_pressure", BUY_SELL, 0, share),
        Feature("buy_sell_ratio", BUY_SELL, 0, ratio),
        Feature("delta_volume", BUY_SELL, 0, difference),
        Feature("flow_imbalance", BUY_SELL, 0, imbalance),
        Feature("sell_pressure", SELL_BUY, 0, share),
    ]
}


def register(feature: Feature) -> None:
    if feature.name in FEATURES:
        raise ValueError(f"feature already registered: {feature.name}")
    FEATURES[feature.name] = feature


def in_dependency_order(features: Iterable[Feature], columns: Iterable[str]) -> list[list[Feature]]:
    """Group features into stages; each stage reads input columns and earlier stages only."""
    waiting = {f.name: f for f in features}
    if len(waiting) != len(list(features)):
        raise ValueError("duplicate feature names")
    ready, stages = set(columns), []
    while waiting:
        stage = [f for f in waiting.values() if ready.issuperset(f.inputs)]
        if not stage:
            missing = {c for f in waiting.values() for c in f.inputs} - ready - set(waiting)
            kind = f"missing inputs {sorted(missing)}" if missing else "a dependency cycle"
            raise ValueError(f"features {sorted(waiting)} cannot be ordered: {kind}")
        stages.append(stage)
        ready.update(f.name for f in stage)
        for f in stage:
            del waiting[f.name]
    return stages


def feature_frame(
    df: DataFrame,
    names: Iterable[str] | None = None,
    keep: Iterable[str] = ("symbol", "timeframe", "open_time"),
    trim: bool = True,
) -> DataFrame:
    """All requested features side by side, one shuffle on the series key.

    With ``trim`` the first ``max(warmup)`` bars of every series are dropped.
    """
    chosen = [FEATURES[n] for n in (names or FEATURES)]
    frame = df
    for stage in in_dependency_order(chosen, df.columns):
        series = Series(SERIES_KEYS)
        values = {f.name: f.formula(series).cast("double") for f in stage}
        before = frame.columns
        frame = series.attach(frame).select(*before, *[v.alias(n) for n, v in values.items()])
    if trim:
        warmup = max(f.warmup for f in chosen)
        series = Series(SERIES_KEYS)
        place = series.index()
        frame = series.attach(frame).filter(place > warmup)
    return frame.select(*keep, *[f.name for f in chosen])
