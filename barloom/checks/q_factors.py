"""Queries for the 111 factors and 26 features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.factors import CATALOG, factor_frame
from barloom.operators.features import FEATURES, feature_frame

from . import tables
from .factor_sql import FACTOR_SQL, FEATURE_SQL, ewm_cte, staged
from .registry import add
from .sql import BARS_1D, FEATURE_INPUTS_1D, INPUTS_1D, RETURNS_1D

COMPANION_COLUMNS = {"open_interest", "taker_buy_volume", "taker_sell_volume", "long_short_ratio",
                     "funding_rate", "mark_price"}
EXTRA_COLUMNS = {"vwap", "index_price", "premium_index", "buy_trade_count", "sell_trade_count",
                 "long_liquidation_volume", "short_liquidation_volume", "total_liquidation_volume"}
KEYS = ("symbol", "open_time")


def factor_source(spark: SparkSession, sf_dir: str, inputs: set[str]) -> DataFrame:
    """The narrowest driver-table view that has the inputs."""
    if "asset_return" in inputs:
        return tables.returns_1d(spark, sf_dir)
    if inputs & COMPANION_COLUMNS:
        return tables.factor_inputs_1d(spark, sf_dir, extras=bool(inputs & EXTRA_COLUMNS))
    if inputs <= {"open", "high", "low", "close", "volume", "trade_count"}:
        return tables.bars_1d(spark, sf_dir)
    if inputs & EXTRA_COLUMNS:
        return tables.bars_1d(spark, sf_dir, extras=True)
    features = feature_frame(
        tables.feature_inputs_1d(spark, sf_dir), sorted(inputs), keep=("symbol", "timeframe", "open_time", "year"),
        trim=False,
    )
    return features


def factor_query(name: str):
    factor = CATALOG[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return factor_frame(factor_source(spark, sf_dir, set(factor.inputs)), [factor], keep=KEYS)

    return run


def factor_oracle(name: str) -> str:
    inputs = set(CATALOG[name].inputs)
    stages, final = FACTOR_SQL[name]
    if "asset_return" in inputs:
        return f"WITH {RETURNS_1D}\n{staged('inputs', stages, {name: final}, 'symbol, open_time')}"
    companions = sorted(inputs & COMPANION_COLUMNS)
    if companions:
        present = " AND ".join(f"{c} IS NOT NULL" for c in companions)
        return f"""WITH {INPUTS_1D},
started AS (SELECT *, min(CASE WHEN {present} THEN open_time END) OVER (PARTITION BY symbol, year) AS start_time FROM inputs),
aligned AS (SELECT * FROM started WHERE open_time >= start_time),
computed AS ({staged('aligned', stages, {name: final}, 'symbol, open_time')})
SELECT b.symbol, b.open_time, c.{name} FROM bars b LEFT JOIN computed c USING (symbol, open_time)"""
    if inputs <= EXTRA_COLUMNS | {"open", "high", "low", "close", "volume", "trade_count"}:
        return f"WITH {BARS_1D}\n{staged('bars', stages, {name: final}, 'symbol, open_time')}"
    features = staged("inputs", [], {c: FEATURE_SQL[c] for c in sorted(inputs)}, "symbol, timeframe, year, open_time")
    return f"WITH {FEATURE_INPUTS_1D},\nfeats AS ({features})\n{staged('feats', stages, {name: final}, 'symbol, open_time')}"


NUMBERED = BARS_1D + """,
numbered AS MATERIALIZED (
  SELECT *, greatest(close - c1, 0.0) + (close - c1) * 0 AS gain, greatest(c1 - close, 0.0) + (close - c1) * 0 AS loss
  FROM (SELECT symbol, year, open_time, close,
    row_number() OVER (PARTITION BY symbol, timeframe, year ORDER BY open_time) AS t,
    lag(close) OVER (PARTITION BY symbol, timeframe, year ORDER BY open_time) AS c1 FROM bars))"""

EWM_ORACLES = {
    "ema_distance": f"""WITH RECURSIVE {NUMBERED}, {ewm_cte('e', 'numbered', 'close', 2 / 21, 1)}
SELECT symbol, open_time, CASE WHEN t >= 20 THEN (close - y) / y END AS ema_distance
FROM numbered JOIN e USING (symbol, year, t)""",
    "price_oscillator": f"""WITH RECURSIVE {NUMBERED}, {ewm_cte('fast', 'numbered', 'close', 2 / 13, 1)},
{ewm_cte('slow', 'numbered', 'close', 2 / 27, 1)}
SELECT n.symbol, n.open_time, CASE WHEN n.t >= 26 THEN 100 * (fast.y - slow.y) / slow.y END AS price_oscillator
FROM numbered n JOIN fast USING (symbol, year, t) JOIN slow USING (symbol, year, t)""",
    "rsi": f"""WITH RECURSIVE {NUMBERED}, {ewm_cte('up', 'numbered', 'gain', 1 / 14, 2)},
{ewm_cte('down', 'numbered', 'loss', 1 / 14, 2)}
SELECT n.symbol, n.open_time, CASE WHEN n.t < 15 OR up.y + down.y = 0 THEN NULL WHEN down.y = 0 THEN 100.0
  ELSE 100 - 100 / (1 + up.y / down.y) END AS rsi
FROM numbered n LEFT JOIN up USING (symbol, year, t) LEFT JOIN down USING (symbol, year, t)""",
}

for _name in CATALOG:
    add(f"factor_{_name}", factor_query(_name), EWM_ORACLES.get(_name) or factor_oracle(_name), [_name])


def feature_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bar_only = set(FEATURES[name].inputs) <= {"high", "low", "close", "volume"}
        source = tables.bars_1d(spark, sf_dir) if bar_only else tables.feature_inputs_1d(spark, sf_dir)
        return feature_frame(source, [name], keep=KEYS)

    return run


for _name, _feature in FEATURES.items():
    _bar_only = set(_feature.inputs) <= {"high", "low", "close", "volume"}
    _with, _source = (BARS_1D, "bars") if _bar_only else (FEATURE_INPUTS_1D, "inputs")
    _body = staged(_source, [], {_name: FEATURE_SQL[_name], "place": "row_number() OVER (PARTITION BY symbol, timeframe, year ORDER BY open_time)"},
                   "symbol, open_time")
    add(
        f"feature_{_name}", feature_query(_name),
        f"WITH {_with}\nSELECT symbol, open_time, {_name} FROM ({_body}) WHERE place > {_feature.warmup}",
        [_name],
    )
