"""Funding, open-interest and liquidation factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .flow import change, mean_ratio, over_own_mean, rate_of_change, slope, sum_imbalance, zscore
from .model import Factor


def relative_basis(s, mark, index):
    return s.let(f"_basis_{mark}", F.try_divide(F.col(mark) - F.col(index), F.col(index)), mark, index)


def basis(s, n, mark, index):
    return F.col(relative_basis(s, mark, index))


def basis_momentum(s, n, mark, index):
    return change(s, n, relative_basis(s, mark, index))


def basis_zscore(s, n, mark, index):
    return s.zscore(relative_basis(s, mark, index), n)


def carry(s, n, rate, mark, index):
    return s.mean(rate, n) * basis(s, n, mark, index)


def acceleration(s, n, x):
    """Change of the n-bar change."""
    pace = s.let(f"_pace{n}_{x}", change(s, n, x), x, f"_lag{n}_{x}")
    return change(s, 1, pace)


def level(s, n, x):
    return F.col(x).cast("double")


def deviation(s, n, x):
    return s.std_pop(x, n)


def mean(s, n, x):
    return s.mean(x, n)


def zscore_gap(s, n, x, y):
    return s.zscore(x, n) - s.zscore(y, n)


def over_mean_of(s, n, x, y):
    return F.try_divide(F.col(x), s.mean(y, n))


def growth_gap(s, n, x, y):
    return rate_of_change(s, n, x) - rate_of_change(s, n, y)


RATE = ("funding_rate",)
OI = ("open_interest",)
MARK_INDEX = ("mark_price", "index_price")
LIQ = ("total_liquidation_volume",)
SIDES = ("long_liquidation_volume", "short_liquidation_volume")

FACTORS = (
    [
        Factor(name, "funding", inputs, lookback, rule)
        for name, inputs, lookback, rule in [
            ("basis", MARK_INDEX, 0, basis),
            ("basis_momentum", MARK_INDEX, 20, basis_momentum),
            ("basis_zscore", MARK_INDEX, 20, basis_zscore),
            ("carry", RATE + MARK_INDEX, 20, carry),
            ("funding_acceleration", RATE, 20, acceleration),
            ("funding_rate_level", RATE, 0, level),
            ("funding_rate_momentum", RATE, 20, change),
            ("funding_rate_zscore", RATE, 20, zscore),
            ("funding_volatility", RATE, 20, deviation),
            ("premium_index_factor", ("premium_index",), 0, level),
        ]
    ]
    + [
        Factor(name, "open_interest", inputs, lookback, rule)
        for name, inputs, lookback, rule in [
            ("open_interest_acceleration", OI, 20, acceleration),
            ("open_interest_funding_divergence", OI + RATE, 20, zscore_gap),
            ("open_interest_intensity", OI + ("volume",), 20, over_mean_of),
            ("open_interest_level", OI, 0, level),
            ("open_interest_momentum", OI, 20, change),
            ("open_interest_price_divergence", OI + ("close",), 20, growth_gap),
            ("open_interest_trend", OI, 20, slope),
            ("open_interest_volatility", OI, 20, deviation),
            ("open_interest_volume_ratio", OI + ("volume",), 20, mean_ratio),
            ("open_interest_zscore", OI, 20, zscore),
        ]
    ]
    + [
        Factor(name, "liquidation", inputs, lookback, rule)
        for name, inputs, lookback, rule in [
            ("leverage_change", OI, 20, rate_of_change),
            ("leverage_pressure", LIQ + OI, 20, mean_ratio),
            ("liquidation_imbalance", SIDES, 20, sum_imbalance),
            ("liquidation_intensity", LIQ + ("volume",), 20, mean_ratio),
            ("liquidation_momentum", LIQ, 20, change),
            ("liquidation_spike", LIQ, 20, over_own_mean),
            ("liquidation_trend", LIQ, 20, slope),
            ("liquidation_zscore", LIQ, 20, zscore),
            ("long_liquidation_pressure", SIDES[:1], 20, mean),
            ("short_liquidation_pressure", SIDES[1:], 20, mean),
        ]
    ]
)
