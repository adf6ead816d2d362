"""Time helpers on epoch-millisecond columns; none depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND_MS = 1_000
DAY_MS = 86_400_000
WEEK_MS = 7 * DAY_MS
# 1970-01-05 was the first Monday after the epoch; weekly bars start on Mondays.
FIRST_MONDAY_MS = 4 * DAY_MS

# The bar intervals, in ascending order.
TIMEFRAME_MS = {
    "1s": 1_000,
    "1m": 60_000,
    "5m": 300_000,
    "15m": 900_000,
    "30m": 1_800_000,
    "1h": 3_600_000,
    "4h": 14_400_000,
    "1d": 86_400_000,
    "1w": 604_800_000,
}


def timeframe_ms(timeframe: Column) -> Column:
    """Interval length of a timeframe column; null for an unknown timeframe."""
    table = F.create_map(*[F.lit(v) for pair in TIMEFRAME_MS.items() for v in pair])
    return F.try_element_at(table, timeframe).cast("long")


def epoch_ms(df: DataFrame, column: str) -> Column:
    """Epoch milliseconds of a date, timestamp or zone-less timestamp column."""
    if dict(df.dtypes)[column] == "timestamp":
        return F.unix_millis(F.col(column))
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{column}` AS TIMESTAMP_NTZ))")


def utc_date(ms: Column) -> Column:
    return F.date_from_unix_date(F.floor(ms / F.lit(DAY_MS)).cast("int"))


def utc_year(ms: Column) -> Column:
    return F.year(utc_date(ms))


def with_year(df: DataFrame, time: str = "open_time") -> DataFrame:
    """Attach the calendar year a bar belongs to; series state restarts with it."""
    return df.withColumn("year", utc_year(F.col(time)))


def aligned(ms: Column, timeframe: Column) -> Column:
    """True when a bar opens on its interval grid (weekly bars on Monday 00:00 UTC)."""
    step = timeframe_ms(timeframe)
    offset = F.when(timeframe == "1w", F.lit(FIRST_MONDAY_MS)).otherwise(F.lit(0))
    return F.pmod(ms - offset, step) == 0
