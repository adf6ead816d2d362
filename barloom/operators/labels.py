"""Forward returns and directions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import SERIES_KEYS

# Label horizons in bars.
HORIZONS = (1, 5, 10, 20)


def forward_return(df: DataFrame, horizon: int, price: str = "close", name: str = "forward_return") -> DataFrame:
    """``price[t+h] / price[t] - 1`` per series, null where the future bar does not exist."""
    ahead = F.lead(price, horizon).over(Window.partitionBy(*SERIES_KEYS).orderBy("open_time"))
    return df.withColumn(name, F.try_divide(ahead, F.col(price)) - 1)


def label_frame(df: DataFrame, horizons: Iterable[int] = HORIZONS, trim: bool = True) -> DataFrame:
    """future_return_h and direction_h for every horizon.

    With ``trim`` the last ``max(horizons)`` bars of a series, whose labels are incomplete, go.
    """
    horizons = list(horizons)
    order = Window.partitionBy(*SERIES_KEYS).orderBy("open_time")
    columns = {h: F.lead("close", h).over(order) for h in horizons}
    out = df.select("symbol", "timeframe", "open_time", "close", *[c.alias(f"_ahead_{h}") for h, c in columns.items()])
    if trim:
        # A bar has all its labels exactly when the bar max(horizons) ahead exists.
        out = df.select(
            "symbol", "timeframe", "open_time", "close",
            F.lead("open_time", max(horizons)).over(order).alias("_last"),
            *[c.alias(f"_ahead_{h}") for h, c in columns.items()],
        ).filter(F.col("_last").isNotNull())
    returns = {h: F.try_divide(F.col(f"_ahead_{h}") - F.col("close"), F.col("close")) for h in horizons}
    return out.select(
        "symbol", "timeframe", "open_time",
        *[r.alias(f"future_return_{h}") for h, r in returns.items()],
        *[F.when(r.isNotNull(), (r > 0).cast("tinyint")).alias(f"direction_{h}") for h, r in returns.items()],
    )
