"""Volume and order-flow factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .model import Factor, difference, simple_return
from .price import strength_index


def money_flow_volume(s, high, low, close, volume):
    up, down = F.col(close) - F.col(low), F.col(high) - F.col(close)
    share = F.when(F.col(high) == F.col(low), F.lit(0.0)).otherwise(
        F.try_divide(up - down, F.col(high) - F.col(low))
    )
    return s.let(f"_mfv_{close}", share * F.col(volume), high, low, close, volume)


def accumulation_distribution(s, n, high, low, close, volume):
    return s.running_sum(money_flow_volume(s, high, low, close, volume))


def chaikin_money_flow(s, n, high, low, close, volume):
    return F.try_divide(s.sum(money_flow_volume(s, high, low, close, volume), n), s.sum(volume, n))


def ease_of_movement(s, n, high, low, volume):
    middle = s.let(f"_mid_{high}", (F.col(high) + F.col(low)) / 2.0, high, low)
    spread = F.col(high) - F.col(low)
    one_bar = F.when(spread != 0, F.try_divide((F.col(middle) - s.lag(middle)) * spread, F.col(volume)))
    return s.mean(s.let(f"_emv_{high}", one_bar, high, low, volume, f"_lag1_{middle}"), n)


def money_flow_index(s, n, high, low, close, volume):
    tp = s.let(f"_tp_{close}", (F.col(high) + F.col(low) + F.col(close)) / 3.0, high, low, close)
    move = F.col(tp) - s.lag(tp)
    flow = F.col(tp) * F.col(volume)
    side = {
        "pos": F.when(move > 0, flow).when(move <= 0, F.lit(0.0)),
        "neg": F.when(move < 0, flow).when(move >= 0, F.lit(0.0)),
    }
    up, down = (
        s.sum(s.let(f"_mf{k}_{close}", e, tp, volume, f"_lag1_{tp}"), n) for k, e in side.items()
    )
    return strength_index(up, down)


def on_balance_volume(s, n, close, volume):
    signed = s.let(
        f"_obv_{close}", F.signum(F.col(close) - s.lag(close)) * F.col(volume), close, volume, f"_lag1_{close}"
    )
    return s.running_sum(signed)


def price_volume_trend(s, n, close, volume):
    ret = simple_return(s, close)
    return s.running_sum(s.let(f"_pvt_{close}", F.col(ret) * F.col(volume), ret, volume))


def over_own_mean(s, n, x):
    return F.try_divide(F.col(x), s.mean(x, n))


def rate_of_change(s, n, x):
    return F.try_divide(F.col(x), s.lag(x, n)) - 1


def slope(s, n, x):
    return s.slope(x, n)


def zscore(s, n, x):
    return s.zscore(x, n)


def change(s, n, x):
    return F.col(x) - s.lag(x, n)


def sum_ratio(s, n, x, y):
    return F.try_divide(s.sum(x, n), s.sum(y, n))


def mean_ratio(s, n, x, y):
    return F.try_divide(s.mean(x, n), s.mean(y, n))


def sum_imbalance(s, n, x, y):
    return F.try_divide(s.sum(x, n) - s.sum(y, n), s.sum(x, n) + s.sum(y, n))


def imbalance(s, n, x, y):
    return F.try_divide(F.col(x) - F.col(y), F.col(x) + F.col(y))


def micro_price_pressure(s, n, close, vwap):
    gap = s.let(f"_vgap_{close}", F.try_divide(F.col(close) - F.col(vwap), F.col(vwap)), close, vwap)
    return s.mean(gap, n)


def order_flow_momentum(s, n, buy, sell):
    return change(s, n, difference(s, buy, sell))


def signed_volume(s, n, buy, sell):
    return s.sum(difference(s, buy, sell), n)


def vwap_distance(s, n, close, vwap):
    return F.try_divide(F.col(close) - s.mean(vwap, n), s.mean(vwap, n))


def vwap_zscore(s, n, close, vwap):
    return s.zscore(difference(s, close, vwap), n)


HLCV = ("high", "low", "close", "volume")
TAKER = ("taker_buy_volume", "taker_sell_volume")

FACTORS = [
    Factor(name, "volume", inputs, lookback, rule)
    for name, inputs, lookback, rule in [
        ("accumulation_distribution", HLCV, 0, accumulation_distribution),
        ("chaikin_money_flow", HLCV, 20, chaikin_money_flow),
        ("ease_of_movement", ("high", "low", "volume"), 14, ease_of_movement),
        ("money_flow_index", HLCV, 14, money_flow_index),
        ("on_balance_volume", ("close", "volume"), 0, on_balance_volume),
        ("price_volume_trend", ("close", "volume"), 0, price_volume_trend),
        ("relative_volume", ("volume",), 20, over_own_mean),
        ("volume_rate_of_change", ("volume",), 20, rate_of_change),
        ("volume_trend", ("volume",), 20, slope),
        ("volume_zscore", ("volume",), 20, zscore),
    ]
] + [
    Factor(name, "microstructure", inputs, lookback, rule)
    for name, inputs, lookback, rule in [
        ("aggressive_buy_ratio", ("taker_buy_volume", "volume"), 20, sum_ratio),
        ("aggressive_sell_ratio", ("taker_sell_volume", "volume"), 20, sum_ratio),
        ("buy_sell_imbalance", TAKER, 0, imbalance),
        ("micro_price_pressure", ("close", "vwap"), 20, micro_price_pressure),
        ("order_flow_momentum", TAKER, 20, order_flow_momentum),
        ("signed_volume", TAKER, 20, signed_volume),
        ("trade_imbalance", ("buy_trade_count", "sell_trade_count"), 20, sum_imbalance),
        ("trade_intensity", ("trade_count",), 20, over_own_mean),
        ("vwap_distance", ("close", "vwap"), 20, vwap_distance),
        ("vwap_zscore", ("close", "vwap"), 20, vwap_zscore),
    ]
]
