"""Price factors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .model import Factor, log_of, simple_return, true_range

# Parameters that define the published indicators.
CCI_SCALE = 0.015
TRADING_DAYS = 365.0
MOMENTUM_HORIZONS = (5, 10, 20, 50)
OSCILLATOR_FAST, OSCILLATOR_SLOW = 12, 26
STOCHASTIC_D_BARS = 3
BAND_WIDTH = 2.0


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def range_share(s, n, high, low, value):
    """Position of a value inside the n-bar high/low range; null when the range is empty."""
    floor = s.min(low, n)
    return F.try_divide(value - floor, s.max(high, n) - floor)


def atr_distance(s, n, high, low, close):
    return F.col(close) - s.mean(true_range(s, high, low, close), n)


def atr_percent(s, n, high, low, close):
    return F.try_divide(s.mean(true_range(s, high, low, close), n), F.col(close))


def atr_slope(s, n, high, low, close):
    tr = true_range(s, high, low, close)
    atr = s.let(f"_atr{n}_{close}", s.mean(tr, n), f"_mean{n}_{tr}", f"_full{n}_{tr}")
    return s.slope(atr, n)


def bollinger_width(s, n, close):
    return 2 * BAND_WIDTH * s.std_pop(close, n)


def bollinger_bandwidth(s, n, close):
    return F.try_divide(bollinger_width(s, n, close), s.mean(close, n))


def bollinger_position(s, n, close):
    lower = s.mean(close, n) - BAND_WIDTH * s.std_pop(close, n)
    return F.try_divide(F.col(close) - lower, bollinger_width(s, n, close))


def breakout_strength(s, n, close):
    return F.try_divide(F.col(close), s.max(close, n, end=-1)) - 1


def choppiness_index(s, n, high, low, close):
    path = s.sum(true_range(s, high, low, close), n)
    ratio = F.try_divide(path, s.max(high, n) - s.min(low, n))
    return 100.0 * F.log10(ratio) / math.log10(n)


def commodity_channel_index(s, n, high, low, close):
    tp = s.let(f"_tp_{close}", (F.col(high) + F.col(low) + F.col(close)) / 3.0, high, low, close)
    return F.try_divide(F.col(tp) - s.mean(tp, n), CCI_SCALE * s.mean_abs_deviation(tp, n))


def detrended_price_oscillator(s, n, close):
    return s.lag(close, n // 2 + 1) - s.mean(close, n)


def distance_from_high(s, n, close):
    return F.try_divide(F.col(close) - s.max(close, n), s.max(close, n))


def distance_from_low(s, n, close):
    return F.try_divide(F.col(close) - s.min(close, n), s.min(close, n))


def donchian_position(s, n, high, low, close):
    return range_share(s, n, high, low, F.col(close))


def efficiency_ratio(s, n, close):
    step = s.let(f"_absd_{close}", F.abs(F.col(close) - s.lag(close)), close, f"_lag1_{close}")
    return F.try_divide(F.abs(F.col(close) - s.lag(close, n)), s.sum(step, n))


def ema_distance(s, n, close):
    ema = s.ewm(close, span_alpha(n), n)
    return F.try_divide(F.col(close) - ema, ema)


def garman_klass_volatility(s, n, open_, high, low, close):
    term = s.let(
        f"_gk_{close}",
        0.5 * F.pow(F.ln(F.try_divide(F.col(high), F.col(low))), 2)
        - (2 * math.log(2) - 1) * F.pow(F.ln(F.try_divide(F.col(close), F.col(open_))), 2),
        open_, high, low, close,
    )
    variance = s.mean(term, n)
    return F.when(variance >= 0, F.sqrt(variance))


def historical_volatility(s, n, close):
    step = s.let(f"_lnret_{close}", F.ln(F.try_divide(F.col(close), s.lag(close))), close, f"_lag1_{close}")
    return s.std_pop(step, n) * math.sqrt(TRADING_DAYS)


def linear_regression_r2(s, n, close):
    y = log_of(s, close)
    explained = F.pow(s.slope(y, n), 2) * index_sum_squares(n)
    moved = s.max(y, n) > s.min(y, n)
    return F.when(moved, F.try_divide(explained, s.sum_squares_about_mean(y, n)))


def index_sum_squares(n: int) -> float:
    """Sum of squared deviations of n consecutive bar indices from their mean."""
    return n * (n * n - 1) / 12.0


def maximum_drawdown(s, n, close):
    return F.try_divide(s.min(close, n), s.max(close, n)) - 1


def mean_reversion_score(s, n, close):
    return -s.zscore(close, n)


def momentum(s, n, close):
    return F.try_divide(F.col(close), s.lag(close, n)) - 1


def multi_horizon_momentum(s, n, close):
    parts = [momentum(s, h, close) for h in MOMENTUM_HORIZONS]
    return sum(parts[1:], parts[0]) / len(parts)


def parkinson_volatility(s, n, high, low):
    squared = s.let(f"_lnhl2_{high}", F.pow(F.ln(F.try_divide(F.col(high), F.col(low))), 2), high, low)
    return F.sqrt(s.mean(squared, n) / (4 * math.log(2)))


def price_acceleration(s, n, close):
    older = F.try_divide(s.lag(close, n), s.lag(close, 2 * n)) - 1
    return momentum(s, n, close) - older


def price_oscillator(s, n, close):
    slow = s.ewm(close, span_alpha(OSCILLATOR_SLOW), OSCILLATOR_SLOW)
    fast = s.ewm(close, span_alpha(OSCILLATOR_FAST), OSCILLATOR_FAST)
    return 100.0 * F.try_divide(fast - slow, slow)


def price_zscore(s, n, close):
    return s.zscore(close, n)


def recovery_strength(s, n, close):
    return range_share(s, n, close, close, F.col(close))


def regression_residual(s, n, close):
    y = log_of(s, close)
    return F.col(y) - s.mean(y, n) - s.slope(y, n) * ((n - 1) / 2.0)


def regression_residual_zscore(s, n, close):
    y = log_of(s, close)
    unexplained = s.sum_squares_about_mean(y, n) - F.pow(s.slope(y, n), 2) * index_sum_squares(n)
    sigma = F.sqrt(F.greatest(unexplained, F.lit(0.0)) / (n - 1))
    moved = s.max(y, n) > s.min(y, n)
    return F.when(moved & (sigma > 0), F.try_divide(regression_residual(s, n, close), sigma)).when(
        moved.isNotNull(), F.lit(0.0)
    )


def rolling_return_mean(s, n, close):
    return s.mean(simple_return(s, close), n)


def rolling_return_median(s, n, close):
    return s.median(simple_return(s, close), n)


def rsi(s, n, close):
    s.lag(close)
    move = F.col(close) - s.lag(close)
    gain = s.let(f"_gain_{close}", F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), close, f"_lag1_{close}")
    loss = s.let(f"_loss_{close}", F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0))), close, f"_lag1_{close}")
    up, down = s.ewm(gain, 1.0 / n, n), s.ewm(loss, 1.0 / n, n)
    return strength_index(up, down)


def strength_index(up, down):
    """100 - 100/(1 + up/down); null when nothing moved, 100 when nothing fell."""
    return (
        F.when((up == 0) & (down == 0), F.lit(None))
        .when(down == 0, F.when(up.isNotNull(), F.lit(100.0)))
        .otherwise(100.0 - 100.0 / (1.0 + F.try_divide(up, down)))
    )


def sma_distance(s, n, close):
    return F.try_divide(F.col(close) - s.mean(close, n), s.mean(close, n))


def stochastic_k(s, n, high, low, close):
    return 100.0 * range_share(s, n, high, low, F.col(close))


def stochastic_d(s, n, high, low, close):
    k = s.let(
        f"_k{n}_{close}", stochastic_k(s, n, high, low, close),
        f"_min{n}_{low}", f"_full{n}_{low}", f"_max{n}_{high}", f"_full{n}_{high}",
    )
    return s.mean(k, STOCHASTIC_D_BARS)


def trend_slope(s, n, close):
    return s.slope(log_of(s, close), n)


def trend_angle(s, n, close):
    return F.degrees(F.atan(trend_slope(s, n, close)))


def trend_persistence(s, n, close):
    ret = simple_return(s, close)
    return s.mean(s.let(f"_sign{ret}", F.signum(ret), ret), n)


def ulcer_index(s, n, close):
    peak = s.max(close, n)
    squared = s.let(
        f"_dd2_{n}_{close}", F.pow(100.0 * (F.try_divide(F.col(close), peak) - 1), 2),
        close, f"_max{n}_{close}", f"_full{n}_{close}",
    )
    return F.sqrt(s.mean(squared, n))


def williams_r(s, n, high, low, close):
    top = s.max(high, n)
    return -100.0 * F.try_divide(top - F.col(close), top - s.min(low, n))


CLOSE = ("close",)
HLC = ("high", "low", "close")

FACTORS = [
    Factor(name, "price", inputs, lookback, rule)
    for name, inputs, lookback, rule in [
        ("atr_distance", HLC, 20, atr_distance),
        ("atr_percent", HLC, 20, atr_percent),
        ("atr_slope", HLC, 20, atr_slope),
        ("bollinger_bandwidth", CLOSE, 20, bollinger_bandwidth),
        ("bollinger_position", CLOSE, 20, bollinger_position),
        ("bollinger_width", CLOSE, 20, bollinger_width),
        ("breakout_strength", CLOSE, 20, breakout_strength),
        ("choppiness_index", HLC, 20, choppiness_index),
        ("commodity_channel_index", HLC, 20, commodity_channel_index),
        ("detrended_price_oscillator", CLOSE, 20, detrended_price_oscillator),
        ("distance_from_high", CLOSE, 20, distance_from_high),
        ("distance_from_low", CLOSE, 20, distance_from_low),
        ("donchian_position", HLC, 20, donchian_position),
        ("efficiency_ratio", CLOSE, 20, efficiency_ratio),
        ("ema_distance", CLOSE, 20, ema_distance),
        ("garman_klass_volatility", ("open", "high", "low", "close"), 20, garman_klass_volatility),
        ("historical_volatility", CLOSE, 20, historical_volatility),
        ("linear_regression_r2", CLOSE, 20, linear_regression_r2),
        ("maximum_drawdown", CLOSE, 20, maximum_drawdown),
        ("mean_reversion_score", CLOSE, 20, mean_reversion_score),
        ("momentum", CLOSE, 20, momentum),
        ("multi_horizon_momentum", CLOSE, 50, multi_horizon_momentum),
        ("parkinson_volatility", ("high", "low"), 20, parkinson_volatility),
        ("price_acceleration", CLOSE, 20, price_acceleration),
        ("price_oscillator", CLOSE, 26, price_oscillator),
        ("price_zscore", CLOSE, 20, price_zscore),
        ("rate_of_change", CLOSE, 12, momentum),
        ("recovery_strength", CLOSE, 20, recovery_strength),
        ("regression_residual", CLOSE, 20, regression_residual),
        ("regression_residual_zscore", CLOSE, 20, regression_residual_zscore),
        ("rolling_return_mean", CLOSE, 20, rolling_return_mean),
        ("rolling_return_median", CLOSE, 20, rolling_return_median),
        ("rsi", CLOSE, 14, rsi),
        ("sma_distance", CLOSE, 20, sma_distance),
        ("stochastic_d", HLC, 14, stochastic_d),
        ("stochastic_k", HLC, 14, stochastic_k),
        ("trend_angle", CLOSE, 20, trend_angle),
        ("trend_persistence", CLOSE, 20, trend_persistence),
        ("trend_slope", CLOSE, 20, trend_slope),
        ("ulcer_index", CLOSE, 20, ulcer_index),
        ("williams_r", HLC, 14, williams_r),
    ]
]
