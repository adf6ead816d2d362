"""Factors relative to a benchmark asset, and products of model features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .model import Factor, difference


def beta(s, n, asset, market):
    return F.try_divide(s.covariance(asset, market, n), F.pow(s.std_pop(market, n), 2))


def correlation(s, n, asset, market):
    return F.try_divide(s.covariance(asset, market, n), s.std_pop(asset, n) * s.std_pop(market, n))


def sum_gap(s, n, asset, market):
    return s.sum(asset, n) - s.sum(market, n)


def compound(s, n, x):
    # F.log1p is null below -1, as a total loss has no compounded return.
    return F.exp(s.sum(s.let(f"_log1p_{x}", F.log1p(x), x), n)) - 1


def strength(s, n, asset, market):
    return compound(s, n, asset) - compound(s, n, market)


def volatility_ratio(s, n, asset, market):
    return F.try_divide(s.std_pop(asset, n), s.std_pop(market, n))


def tracking_error(s, n, asset, market):
    return s.std_pop(difference(s, asset, market), n)


def product_of(sign: float):
    def rule(s, n, *inputs):
        return sign * reduce(lambda a, b: a * b, [F.col(x) for x in inputs])

    return rule


PRODUCT, NEGATIVE_PRODUCT = product_of(1.0), product_of(-1.0)

FACTORS = [
    Factor(name, "relative", ("asset_return", market), 20, rule)
    for name, market, rule in [
        ("beta_to_btc", "btc_return", beta),
        ("beta_to_eth", "eth_return", beta),
        ("correlation_btc", "btc_return", correlation),
        ("correlation_eth", "eth_return", correlation),
        ("relative_momentum_btc", "btc_return", sum_gap),
        ("relative_momentum_eth", "eth_return", sum_gap),
        ("relative_strength_btc", "btc_return", strength),
        ("relative_strength_eth", "eth_return", strength),
        ("relative_volatility", "benchmark_return", volatility_ratio),
        ("tracking_error", "benchmark_return", tracking_error),
    ]
] + [
    Factor(name, "composite", inputs, 0, rule)
    for name, inputs, rule in [
        ("breakout_confirmation", ("returns", "oi_momentum", "buy_pressure"), PRODUCT),
        ("crowding", ("crowding_score", "funding_zscore"), PRODUCT),
        ("flow_confirmation", ("returns", "flow_imbalance"), PRODUCT),
        ("funding_divergence", ("returns", "funding_zscore"), NEGATIVE_PRODUCT),
        ("leveraged_long_build_up", ("funding_zscore", "oi_momentum", "buy_pressure"), PRODUCT),
        ("leveraged_short_build_up", ("funding_zscore", "oi_momentum", "sell_pressure"), NEGATIVE_PRODUCT),
        ("long_squeeze", ("crowding_score", "returns", "sell_pressure"), NEGATIVE_PRODUCT),
        ("position_build_up", ("oi_momentum", "ratio_momentum"), PRODUCT),
        ("short_squeeze", ("crowding_score", "returns", "flow_imbalance"), NEGATIVE_PRODUCT),
        ("trend_confirmation", ("returns", "flow_imbalance", "oi_momentum"), PRODUCT),
    ]
]
