"""Predictions to trading signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_KEY = ["symbol", "timeframe", "model_name", "model_version"]
SIGNAL_COLUMNS = ["symbol", "timeframe", "open_time", "model_name", "model_version", "signal"]


def threshold_signals(predictions: DataFrame, buy: float, sell: float) -> DataFrame:
    """BUY at or above ``buy``, SELL at or below ``sell``, HOLD between."""
    if buy <= sell:
        raise ValueError("the buy threshold must exceed the sell threshold")
    signal = F.when(F.col("prediction") >= buy, "BUY").when(F.col("prediction") <= sell, "SELL").otherwise("HOLD")
    return predictions.withColumn("signal", signal).select(*SIGNAL_COLUMNS)


def class_signals(predictions: DataFrame, positive: float = 1.0, negative: float = 0.0) -> DataFrame:
    signal = F.when(F.col("prediction") == positive, "BUY").when(F.col("prediction") == negative, "SELL").otherwise("HOLD")
    return predictions.withColumn("signal", signal).select(*SIGNAL_COLUMNS)


def adaptive_signals(predictions: DataFrame, thresholds: DataFrame, profile: str = "Balanced") -> DataFrame:
    """Thresholds looked up per series and model; predictions without one are kept with a null signal."""
    chosen = thresholds.filter(F.col("profile") == profile).select(*MODEL_KEY, "buy_threshold", "sell_threshold")
    joined = predictions.join(chosen, MODEL_KEY, "left")
    signal = (
        F.when(F.col("buy_threshold").isNull(), F.lit(None))
        .when(F.col("prediction") >= F.col("buy_threshold"), "BUY")
        .when(F.col("prediction") <= F.col("sell_threshold"), "SELL")
        .otherwise("HOLD")
    )
    return joined.withColumn("signal", signal).select(*SIGNAL_COLUMNS)
