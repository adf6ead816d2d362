"""Benchmark-return columns for the relative factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import SERIES_KEYS


def with_relative_returns(bars: DataFrame, btc: str, eth: str) -> DataFrame:
    """Attach asset_return, btc_return, eth_return and benchmark_return (mean over the cross-section).

    A cross-section holds one row per symbol, so its window partition is bounded by the universe.
    """
    order = Window.partitionBy(*SERIES_KEYS).orderBy("open_time")
    section = Window.partitionBy("timeframe", "open_time")
    own = bars.withColumn("asset_return", F.try_divide("close", F.lag("close").over(order)) - 1)
    return own.select(
        "*",
        F.max(F.when(F.col("symbol") == btc, F.col("asset_return"))).over(section).alias("btc_return"),
        F.max(F.when(F.col("symbol") == eth, F.col("asset_return"))).over(section).alias("eth_return"),
        F.avg("asset_return").over(section).alias("benchmark_return"),
    )
