import math

import numpy as np
import pandas as pd
import pytest
from helpers import DAY, START, bars, column
from pyspark.sql import functions as F

from barloom.operators import factors
from barloom.operators.factors import CATALOG, Factor, factor_frame, factor_long
from barloom.operators.features import FEATURES, Feature, feature_frame, in_dependency_order


def test_catalog_sizes():
    assert len(CATALOG) == 111
    assert len(FEATURES) == 26
    columns = ["symbol", "timeframe", "open_time", "year", "open", "high", "low", "close", "volume", "quote_volume", "trade_count",
               "funding_rate", "mark_price", "open_interest", "taker_buy_volume", "taker_sell_volume", "long_short_ratio"]
    assert len(factors.executable(columns)) == 73


def test_momentum_needs_full_lookback(spark):
    out = factor_frame(bars(spark, [float(i + 1) for i in range(25)]), [CATALOG["momentum"]])
    values = column(out, "momentum")
    assert values[:20] == [None] * 20
    assert values[20] == pytest.approx(21 / 1 - 1)


def test_constant_series_has_zero_zscore_and_null_ratios(spark):
    frame = bars(spark, [5.0] * 45)
    out = factor_frame(frame, [CATALOG[n] for n in (
        "price_zscore", "bollinger_position", "linear_regression_r2", "regression_residual_zscore", "efficiency_ratio", "rsi", "donchian_position")])
    last = out.orderBy(F.col("open_time").desc()).first()
    assert last.price_zscore == 0.0 and last.regression_residual_zscore == 0.0
    assert last.bollinger_position is None and last.linear_regression_r2 is None
    assert last.efficiency_ratio is None and last.rsi is None and last.donchian_position is None


def test_rsi_is_100_without_losses(spark):
    out = factor_frame(bars(spark, [float(i + 1) for i in range(30)]), [CATALOG["rsi"]])
    values = column(out, "rsi")
    assert values[13] is None and values[14] == 100.0


@pytest.mark.parametrize("length", [40, 256, 257, 900])
def test_recursive_mean_matches_a_plain_loop(spark, length):
    rng = np.random.default_rng(3)
    closes = list(100 + rng.normal(size=length).cumsum())
    out = factor_frame(bars(spark, closes), [CATALOG["ema_distance"], CATALOG["rsi"], CATALOG["price_oscillator"]])
    series = pd.Series(closes)
    ema = series.ewm(span=20, adjust=False, min_periods=20).mean()
    got = pd.Series(column(out, "ema_distance"), dtype=float)
    pd.testing.assert_series_equal(got, (series - ema) / ema, check_names=False, rtol=1e-9, atol=1e-12)
    move = series.diff()
    up = move.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    down = (-move).clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    got = pd.Series(column(out, "rsi"), dtype=float)
    pd.testing.assert_series_equal(got, 100 - 100 / (1 + up / down), check_names=False, rtol=1e-9)


def test_quiet_stretch_longer_than_a_block_keeps_its_memory(spark):
    # Gains and losses decay to tiny values, but their ratio still decides the index.
    closes = [10.0, 11.0, 10.5] + [10.5] * 400
    out = factor_frame(bars(spark, closes), [CATALOG["rsi"]])
    gain = loss = None
    for a, b in zip(closes, closes[1:]):
        g, l = max(b - a, 0), max(a - b, 0)
        gain, loss = (g, l) if gain is None else (gain * 13 / 14 + g / 14, loss * 13 / 14 + l / 14)
    assert column(out, "rsi")[-1] == pytest.approx(100 - 100 / (1 + gain / loss), rel=1e-6)


def test_null_in_the_middle_blanks_the_window(spark):
    closes = [float(i) for i in range(1, 61)]
    closes[30] = None
    out = factor_frame(bars(spark, closes), [CATALOG["sma_distance"]])
    values = column(out, "sma_distance")
    assert all(v is None for v in values[30:50]) and values[50] is not None


def test_state_restarts_with_the_year(spark):
    frame = bars(spark, [float(i + 1) for i in range(60)]).withColumn("year", F.when(F.col("close") > 30, 2021).otherwise(2020))
    values = column(factor_frame(frame, [CATALOG["momentum"]]), "momentum")
    assert values[29] is not None and values[30:50] == [None] * 20 and values[50] is not None
    carried = column(factor_frame(frame, [CATALOG["momentum"]], carry_over=True), "momentum")
    assert all(v is not None for v in carried[20:])


def test_other_series_and_partitioning_do_not_change_a_series(spark):
    rng = np.random.default_rng(5)
    a = bars(spark, list(50 + rng.normal(size=80).cumsum()))
    b = bars(spark, list(90 + rng.normal(size=80).cumsum()), symbol="B")
    chosen = [CATALOG[n] for n in ("trend_slope", "commodity_channel_index", "on_balance_volume", "ema_distance", "stochastic_d")]
    alone = factor_frame(a, chosen).orderBy("open_time").collect()
    mixed = factor_frame(a.union(b).repartition(7).orderBy(F.rand(1)), chosen).filter("symbol = 'A'").orderBy("open_time").collect()
    assert alone == mixed


def test_companions_align_before_windows_start(spark):
    closes = [float(i + 1) for i in range(60)]
    frame = bars(spark, closes).withColumn("open_interest", F.when(F.col("close") > 15, F.lit(7.0)))
    out = factor_frame(frame, [CATALOG["open_interest_intensity"], CATALOG["volume_trend"]])
    values = column(out, "open_interest_intensity")
    # The volume mean starts where open interest does: 15 missing bars, then 19 of warm-up.
    assert values[33] is None and values[34] == pytest.approx(7.0 / np.mean(closes[15:35]))
    assert column(out, "volume_trend")[19] is not None


def test_split_series_give_the_same_factors(spark):
    rng = np.random.default_rng(8)
    closes = list(100 + rng.normal(size=700).cumsum())
    frame = bars(spark, closes).union(bars(spark, closes[:90], symbol="B")).filter(~F.col("open_time").between(START + 200 * DAY, START + 330 * DAY))
    day = (F.col("open_time") - START) / DAY
    frame = frame.withColumn("open_interest", F.when((day > 12) & (F.floor(day) % 150 > 3), F.col("close") * 2)).withColumn("trade_count", F.lit(3).cast("long"))
    whole = factor_frame(frame)
    split = factors.split_factor_frame(frame, rows_per_part=128)
    assert whole.columns == split.columns and len(whole.columns) > 55
    a, b = whole.orderBy("symbol", "open_time").collect(), split.orderBy("symbol", "open_time").collect()
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for c in whole.columns[3:]:
            assert (x[c] is None) == (y[c] is None), (c, x.open_time)
            assert x[c] is None or x[c] == pytest.approx(y[c], rel=1e-6, abs=1e-9), (c, x.open_time)


def test_long_panel_carries_metadata(spark):
    long = factor_long(factor_frame(bars(spark, [1.0, 2.0]), [CATALOG["momentum"], CATALOG["rsi"]]))
    assert long.columns[3:] == ["factor_name", "factor_version", "factor_category", "factor_group", "factor_value", "lookback",
                                "prediction_horizon", "enabled", "status"]
    assert {(r.factor_name, r.lookback) for r in long.collect()} == {("momentum", 20), ("rsi", 14)}


def test_dependency_classes():
    assert factors.dependency_class(CATALOG["momentum"]) == "OHLCV_ONLY"
    assert factors.dependency_class(CATALOG["volume_zscore"]) == "OHLCV_PLUS_VOLUME"
    assert factors.dependency_class(CATALOG["open_interest_level"]) == "OI_DEPENDENT"
    assert factors.dependency_class(CATALOG["open_interest_funding_divergence"]) == "MULTI_COMPANION_DEPENDENT"
    assert factors.dependency_class(CATALOG["vwap_zscore"]) == "UNKNOWN"
    assert factors.required_datasets(CATALOG["open_interest_intensity"]) == ("ohlcv", "open_interest")


def test_user_factor_runs_beside_the_built_in_ones(spark):
    mine = Factor("half_range", "custom", ("high", "low"), 3, lambda s, n, high, low: (s.max(high, n) - s.min(low, n)) / 2)
    factors.register(mine)
    try:
        with pytest.raises(ValueError):
            factors.register(mine)
        out = factor_frame(bars(spark, [1.0, 4.0, 2.0, 8.0]), [mine, CATALOG["momentum"]])
        assert column(out, "half_range") == [None, None, 1.5, 3.0]
    finally:
        del CATALOG["half_range"]


def test_feature_order_detects_cycles_and_missing_inputs():
    rule = FEATURES["returns"].rule
    a, b = Feature("a", ("b",), 0, rule), Feature("b", ("a",), 0, rule)
    with pytest.raises(ValueError, match="cycle"):
        in_dependency_order([a, b], ["close"])
    with pytest.raises(ValueError, match="missing"):
        in_dependency_order([Feature("a", ("nowhere",), 0, rule)], ["close"])
    assert [[f.name for f in s] for s in in_dependency_order([Feature("a", ("b",), 0, rule), Feature("b", ("close",), 0, rule)], ["close"])] == [["b"], ["a"]]


def test_feature_zero_variance_rules(spark):
    frame = bars(spark, [3.0] * 25).select("*", *[F.lit(2.0).alias(c) for c in ("funding_rate", "open_interest", "long_short_ratio")])
    out = feature_frame(frame, ["funding_zscore", "oi_zscore", "ratio_zscore", "rolling_std"], trim=False)
    last = out.orderBy(F.col("open_time").desc()).first()
    assert last.funding_zscore == 0.0 and last.oi_zscore is None and last.ratio_zscore is None and last.rolling_std == 0.0
    assert math.isclose(last.rolling_std, 0.0)


@pytest.mark.parametrize("alpha", [0.01, 0.3, 0.99, 1.0])
def test_ewm_keeps_all_history(spark, alpha):
    import numpy as np
    from pyspark.sql import functions as F
    from barloom.functions.series import evaluate

    values = np.random.default_rng(4).normal(100, 10, 20_000)
    values[0] = 1e9  # a first value that a truncated history would lose
    df = spark.createDataFrame(pd.DataFrame({
        "symbol": "a", "timeframe": "1m", "year": 2024, "open_time": np.arange(len(values)) * 60_000, "close": values}))
    got = evaluate(df, {"m": lambda s: s.ewm("close", alpha, 1)}, ["open_time"]).orderBy("open_time").toPandas()["m"].to_numpy()
    want, y = [], None
    for v in values:
        y = v if y is None else (1 - alpha) * y + alpha * v
        want.append(y)
    assert np.allclose(got, want, rtol=1e-9)
