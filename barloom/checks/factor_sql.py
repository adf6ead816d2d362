"""Factor oracles: each factor as window SQL, stage by stage."""

from __future__ import annotations

import re

SERIES = "PARTITION BY symbol, timeframe, year ORDER BY open_time"


def win(agg: str, x: str, n: int, end: int = 0) -> str:
    frame = f"({SERIES} ROWS BETWEEN {n - 1 + end} PRECEDING AND {end} PRECEDING)" if end else (
        f"({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    )
    return f"(CASE WHEN count({x}) OVER {frame} = {n} THEN {agg} OVER {frame} END)"


def mean(x, n): return win(f"avg({x})", x, n)
def total(x, n): return win(f"sum({x})", x, n)
def top(x, n, end=0): return win(f"max({x})", x, n, end)
def low(x, n): return win(f"min({x})", x, n)
def sdp(x, n): return win(f"stddev_pop({x})", x, n)
def sds(x, n): return win(f"stddev_samp({x})", x, n)
def slope(x, n): return win(f"regr_slope({x}, t)", x, n)
def lag(x, n=1): return f"(lag({x}, {n}) OVER ({SERIES}))"
def div(a, b): return f"(({a}) / nullif({b}, 0))"
def cum(x): return f"(CASE WHEN {x} IS NOT NULL THEN sum({x}) OVER ({SERIES}) END)"
def z(x, n): return f"(CASE WHEN {sdp(x, n)} = 0 THEN 0.0 ELSE ({x} - {mean(x, n)}) / nullif({sdp(x, n)}, 0) END)"
def share(h, l, n): return div(f"close - {low(l, n)}", f"{top(h, n)} - {low(l, n)}")


# Columns that later stages may use, in order of dependency.
BASE = [
    ("t", f"row_number() OVER ({SERIES})"),
    ("c1", lag("close")),
    ("lnc", "ln(close)"),
    ("tp", "(high + low + close) / 3.0"),
    ("mid", "(high + low) / 2.0"),
    ("delta", "taker_buy_volume - taker_sell_volume"),
    ("gap", "close - vwap"),
    ("vgap", div("close - vwap", "vwap")),
    ("bas", div("mark_price - index_price", "index_price")),
    ("track", "asset_return - benchmark_return"),
    ("la", "ln(1 + asset_return)"),
    ("lb", "ln(1 + btc_return)"),
    ("le", "ln(1 + eth_return)"),
]
DERIVED = [
    ("ret", "close / c1 - 1"),
    ("lnret", "ln(close / c1)"),
    ("step", "abs(close - c1)"),
    ("tr", "greatest(high - low, abs(high - c1), abs(low - c1))"),
    ("sgn", "sign(close / c1 - 1)"),
    ("gain", "greatest(close - c1, 0.0) + (close - c1) * 0"),
    ("loss", "greatest(c1 - close, 0.0) + (close - c1) * 0"),
    ("gk", "0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)"),
    ("hl2", "pow(ln(high / low), 2)"),
    ("mfv", "(CASE WHEN high = low THEN 0.0 ELSE ((close - low) - (high - close)) / (high - low) END) * volume"),
    ("dmid", "mid - " + lag("mid")),
    ("dtp", "tp - " + lag("tp")),
    ("signed", "sign(close - c1) * volume"),
    ("pvt", "(close / c1 - 1) * volume"),
]

# name -> (extra stages, final expression)
FACTOR_SQL: dict[str, tuple[list[dict[str, str]], str]] = {
    "atr_distance": ([], f"close - {mean('tr', 20)}"),
    "atr_percent": ([], div(mean("tr", 20), "close")),
    "atr_slope": ([{"atr": mean("tr", 20)}], slope("atr", 20)),
    "bollinger_bandwidth": ([], div(f"4 * {sdp('close', 20)}", mean("close", 20))),
    "bollinger_position": ([], div(f"close - ({mean('close', 20)} - 2 * {sdp('close', 20)})", f"(4 * {sdp('close', 20)})")),
    "bollinger_width": ([], f"4 * {sdp('close', 20)}"),
    "breakout_strength": ([], f"close / {top('close', 20, 1)} - 1"),
    "choppiness_index": ([], f"100 * log10({div(total('tr', 20), top('high', 20) + ' - ' + low('low', 20))}) / log10(20)"),
    "commodity_channel_index": (
        [{"m": mean("tp", 20), "vals": f"list(tp) OVER ({SERIES} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"}],
        "(tp - m) / nullif(0.015 * list_avg([abs(v - m) for v in vals]), 0)",
    ),
    "detrended_price_oscillator": ([], f"{lag('close', 11)} - {mean('close', 20)}"),
    "distance_from_high": ([], f"(close - {top('close', 20)}) / {top('close', 20)}"),
    "distance_from_low": ([], f"(close - {low('close', 20)}) / {low('close', 20)}"),
    "donchian_position": ([], share("high", "low", 20)),
    "efficiency_ratio": ([], div(f"abs(close - {lag('close', 20)})", total("step", 20))),
    "garman_klass_volatility": ([{"v": mean("gk", 20)}], "CASE WHEN v >= 0 THEN sqrt(v) END"),
    "historical_volatility": ([], f"{sdp('lnret', 20)} * sqrt(365)"),
    "linear_regression_r2": ([], f"CASE WHEN {top('lnc', 20)} > {low('lnc', 20)} THEN {win('regr_r2(lnc, t)', 'lnc', 20)} END"),
    "maximum_drawdown": ([], f"{low('close', 20)} / {top('close', 20)} - 1"),
    "mean_reversion_score": ([], f"-{z('close', 20)}"),
    "momentum": ([], f"close / {lag('close', 20)} - 1"),
    "multi_horizon_momentum": ([], "(" + " + ".join(f"close / {lag('close', h)} - 1" for h in (5, 10, 20, 50)) + ") / 4"),
    "parkinson_volatility": ([], f"sqrt({mean('hl2', 20)} / (4 * ln(2)))"),
    "price_acceleration": ([], f"(close / {lag('close', 20)} - 1) - ({lag('close', 20)} / {lag('close', 40)} - 1)"),
    "price_zscore": ([], z("close", 20)),
    "rate_of_change": ([], f"close / {lag('close', 12)} - 1"),
    "recovery_strength": ([], share("close", "close", 20)),
    "regression_residual": ([], f"lnc - ({mean('lnc', 20)} + {slope('lnc', 20)} * 9.5)"),
    "regression_residual_zscore": (
        [{"b": slope("lnc", 20), "m": mean("lnc", 20), "syy": win("var_pop(lnc)", "lnc", 20) + " * 20",
          "hi": top("lnc", 20), "lo": low("lnc", 20)}],
        "CASE WHEN hi IS NULL THEN NULL WHEN hi > lo AND greatest(syy - b * b * 665, 0) > 0"
        " THEN (lnc - m - b * 9.5) / sqrt(greatest(syy - b * b * 665, 0) / 19) ELSE 0.0 END",
    ),
    "rolling_return_mean": ([], mean("ret", 20)),
    "rolling_return_median": ([], win("median(ret)", "ret", 20)),
    "sma_distance": ([], div(f"close - {mean('close', 20)}", mean("close", 20))),
    "stochastic_d": ([{"k": "100 * " + share("high", "low", 14)}], mean("k", 3)),
    "stochastic_k": ([], "100 * " + share("high", "low", 14)),
    "trend_angle": ([], f"degrees(atan({slope('lnc', 20)}))"),
    "trend_persistence": ([], mean("sgn", 20)),
    "trend_slope": ([], slope("lnc", 20)),
    "ulcer_index": ([{"dd": f"pow(100 * (close / {top('close', 20)} - 1), 2)"}], f"sqrt({mean('dd', 20)})"),
    "williams_r": ([], "-100 * " + div(f"{top('high', 14)} - close", f"{top('high', 14)} - {low('low', 14)}")),
    # volume
    "accumulation_distribution": ([], cum("mfv")),
    "chaikin_money_flow": ([], div(total("mfv", 20), total("volume", 20))),
    "ease_of_movement": (
        [{"one": "CASE WHEN volume <> 0 AND high <> low THEN dmid * (high - low) / volume END"}], mean("one", 14)),
    "money_flow_index": (
        [{"pf": "CASE WHEN dtp IS NULL THEN NULL WHEN dtp > 0 THEN tp * volume ELSE 0.0 END",
          "nf": "CASE WHEN dtp IS NULL THEN NULL WHEN dtp < 0 THEN tp * volume ELSE 0.0 END"},
         {"p": total("pf", 14), "n": total("nf", 14)}],
        "CASE WHEN p IS NULL OR n IS NULL OR (p = 0 AND n = 0) THEN NULL WHEN n = 0 THEN 100.0"
        " ELSE 100 - 100 / (1 + p / n) END",
    ),
    "on_balance_volume": ([], cum("signed")),
    "price_volume_trend": ([], cum("pvt")),
    "relative_volume": ([], div("volume", mean("volume", 20))),
    "volume_rate_of_change": ([], div("volume", lag("volume", 20)) + " - 1"),
    "volume_trend": ([], slope("volume", 20)),
    "volume_zscore": ([], z("volume", 20)),
    # microstructure
    "aggressive_buy_ratio": ([], div(total("taker_buy_volume", 20), total("volume", 20))),
    "aggressive_sell_ratio": ([], div(total("taker_sell_volume", 20), total("volume", 20))),
    "buy_sell_imbalance": ([], div("taker_buy_volume - taker_sell_volume", "taker_buy_volume + taker_sell_volume")),
    "micro_price_pressure": ([], mean("vgap", 20)),
    "order_flow_momentum": ([], f"delta - {lag('delta', 20)}"),
    "signed_volume": ([], total("delta", 20)),
    "trade_imbalance": ([], div(f"{total('buy_trade_count', 20)} - {total('sell_trade_count', 20)}",
                                f"{total('buy_trade_count', 20)} + {total('sell_trade_count', 20)}")),
    "trade_intensity": ([], div("trade_count", mean("trade_count", 20))),
    "vwap_distance": ([], div(f"close - {mean('vwap', 20)}", mean("vwap", 20))),
    "vwap_zscore": ([], z("gap", 20)),
    # funding
    "basis": ([], "bas"),
    "basis_momentum": ([], f"bas - {lag('bas', 20)}"),
    "basis_zscore": ([], z("bas", 20)),
    "carry": ([], f"{mean('funding_rate', 20)} * bas"),
    "funding_acceleration": ([{"m": f"funding_rate - {lag('funding_rate', 20)}"}], f"m - {lag('m')}"),
    "funding_rate_level": ([], "funding_rate"),
    "funding_rate_momentum": ([], f"funding_rate - {lag('funding_rate', 20)}"),
    "funding_rate_zscore": ([], z("funding_rate", 20)),
    "funding_volatility": ([], sdp("funding_rate", 20)),
    "premium_index_factor": ([], "premium_index"),
    # open interest
    "open_interest_acceleration": ([{"m": f"open_interest - {lag('open_interest', 20)}"}], f"m - {lag('m')}"),
    "open_interest_funding_divergence": ([], f"{z('open_interest', 20)} - {z('funding_rate', 20)}"),
    "open_interest_intensity": ([], div("open_interest", mean("volume", 20))),
    "open_interest_level": ([], "open_interest"),
    "open_interest_momentum": ([], f"open_interest - {lag('open_interest', 20)}"),
    "open_interest_price_divergence": ([], f"({div('open_interest', lag('open_interest', 20))} - 1) - (close / {lag('close', 20)} - 1)"),
    "open_interest_trend": ([], slope("open_interest", 20)),
    "open_interest_volatility": ([], sdp("open_interest", 20)),
    "open_interest_volume_ratio": ([], div(mean("open_interest", 20), mean("volume", 20))),
    "open_interest_zscore": ([], z("open_interest", 20)),
    # liquidation
    "leverage_change": ([], div("open_interest", lag("open_interest", 20)) + " - 1"),
    "leverage_pressure": ([], div(mean("total_liquidation_volume", 20), mean("open_interest", 20))),
    "liquidation_imbalance": ([], div(
        f"{total('long_liquidation_volume', 20)} - {total('short_liquidation_volume', 20)}",
        f"{total('long_liquidation_volume', 20)} + {total('short_liquidation_volume', 20)}")),
    "liquidation_intensity": ([], div(mean("total_liquidation_volume", 20), mean("volume", 20))),
    "liquidation_momentum": ([], f"total_liquidation_volume - {lag('total_liquidation_volume', 20)}"),
    "liquidation_spike": ([], div("total_liquidation_volume", mean("total_liquidation_volume", 20))),
    "liquidation_trend": ([], slope("total_liquidation_volume", 20)),
    "liquidation_zscore": ([], z("total_liquidation_volume", 20)),
    "long_liquidation_pressure": ([], mean("long_liquidation_volume", 20)),
    "short_liquidation_pressure": ([], mean("short_liquidation_volume", 20)),
}
for coin, code in (("btc", "lb"), ("eth", "le")):
    m = f"{coin}_return"
    cov = f"(CASE WHEN {top('asset_return', 20)} IS NOT NULL AND {top(m, 20)} IS NOT NULL THEN " \
          f"covar_pop(asset_return, {m}) OVER ({SERIES} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END)"
    FACTOR_SQL |= {
        f"beta_to_{coin}": ([], div(cov, win(f"var_pop({m})", m, 20))),
        f"correlation_{coin}": ([], div(cov, f"({sdp('asset_return', 20)} * {sdp(m, 20)})")),
        f"relative_momentum_{coin}": ([], f"{total('asset_return', 20)} - {total(m, 20)}"),
        f"relative_strength_{coin}": ([], f"(exp({total('la', 20)}) - 1) - (exp({total(code, 20)}) - 1)"),
    }
FACTOR_SQL |= {
    "relative_volatility": ([], div(sdp("asset_return", 20), sdp("benchmark_return", 20))),
    "tracking_error": ([], sdp("track", 20)),
    "breakout_confirmation": ([], "returns * oi_momentum * buy_pressure"),
    "crowding": ([], "crowding_score * funding_zscore"),
    "flow_confirmation": ([], "returns * flow_imbalance"),
    "funding_divergence": ([], "returns * -funding_zscore"),
    "leveraged_long_build_up": ([], "funding_zscore * oi_momentum * buy_pressure"),
    "leveraged_short_build_up": ([], "-funding_zscore * oi_momentum * sell_pressure"),
    "long_squeeze": ([], "crowding_score * -returns * sell_pressure"),
    "position_build_up": ([], "oi_momentum * ratio_momentum"),
    "short_squeeze": ([], "-crowding_score * returns * flow_imbalance"),
    "trend_confirmation": ([], "returns * flow_imbalance * oi_momentum"),
}


def _used(names: list[tuple[str, str]], text: str) -> list[tuple[str, str]]:
    """The columns that ``text`` needs, directly or through one another."""
    chosen: list[tuple[str, str]] = []
    for name, expr in reversed(names):
        if re.search(rf"\b{name}\b", text + " ".join(e for _, e in chosen)):
            chosen.insert(0, (name, expr))
    return chosen


def staged(source: str, stages: list[dict[str, str]], outputs: dict[str, str], keep: str) -> str:
    """SELECT with base columns, derived columns and extra stages nested below the final expressions."""
    text = " ".join([*outputs.values(), *[e for s in stages for e in s.values()]])
    derived = _used(DERIVED, text)
    base = _used(BASE, text + " ".join(e for _, e in derived))
    query = f"SELECT * FROM {source}"
    for layer in ([dict(base)] if base else []) + ([dict(derived)] if derived else []) + stages:
        query = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM ({query})"
    return f"SELECT {keep}, {', '.join(f'{e} AS {n}' for n, e in outputs.items())} FROM ({query})"


FEATURE_SQL: dict[str, str] = {
    "atr": mean("tr", 14),
    "dollar_volume": "close * volume",
    "log_returns": "lnret",
    "returns": "ret",
    "rolling_max": top("close", 20),
    "rolling_mean": mean("close", 20),
    "rolling_min": low("close", 20),
    "rolling_std": sds("close", 20),
    "funding_change": f"funding_rate - {lag('funding_rate')}",
    "funding_momentum": f"funding_rate - {lag('funding_rate', 20)}",
    "funding_rolling_mean": mean("funding_rate", 20),
    "funding_zscore": f"CASE WHEN {sds('funding_rate', 20)} = 0 THEN 0.0 ELSE {div('funding_rate - ' + mean('funding_rate', 20), sds('funding_rate', 20))} END",
    "oi_change": f"open_interest - {lag('open_interest')}",
    "oi_momentum": div("open_interest", lag("open_interest", 20)) + " - 1",
    "oi_percent_change": div("open_interest", lag("open_interest")) + " - 1",
    "oi_rolling_mean": mean("open_interest", 20),
    "oi_zscore": div("open_interest - " + mean("open_interest", 20), sds("open_interest", 20)),
    "crowding_score": div("long_short_ratio - 1", sds("long_short_ratio", 20)),
    "ratio_change": f"long_short_ratio - {lag('long_short_ratio')}",
    "ratio_momentum": f"long_short_ratio - {lag('long_short_ratio', 20)}",
    "ratio_zscore": div("long_short_ratio - " + mean("long_short_ratio", 20), sds("long_short_ratio", 20)),
    "buy_pressure": div("buy_volume", "(buy_volume + sell_volume)"),
    "buy_sell_ratio": div("buy_volume", "sell_volume"),
    "delta_volume": "buy_volume - sell_volume",
    "flow_imbalance": div("buy_volume - sell_volume", "(buy_volume + sell_volume)"),
    "sell_pressure": div("sell_volume", "(buy_volume + sell_volume)"),
}


def ewm_cte(name: str, source: str, x: str, alpha: float, first: int) -> str:
    """Recursive mean over ``source(symbol, year, t, x)``, seeded at bar ``first``."""
    return f"""{name} AS (
  SELECT symbol, year, t, {x} AS y FROM {source} WHERE t = {first}
  UNION ALL
  SELECT s.symbol, s.year, s.t, e.y * (1 - {alpha!r}) + s.{x} * {alpha!r}
  FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.year = e.year AND s.t = e.t + 1)"""
