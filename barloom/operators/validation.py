"""Bar validation, ordering, de-duplication and gap detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.clock import aligned, timeframe_ms

SERIES = ("symbol", "timeframe")
PRICES = ("open", "high", "low", "close")
NUMBERS = (*PRICES, "volume", "quote_volume")

# Issue names in report order with their severity.
ISSUES = {
    "null_values": "ERROR",
    "nan_values": "ERROR",
    "ohlc_rule": "ERROR",
    "negative_volume": "ERROR",
    "misaligned_time": "ERROR",
    "duplicate_time": "ERROR",
    "missing_bars": "WARNING",
}
SAMPLE_ROWS = 5


def row_issues() -> dict[str, Column]:
    """Issues that one row shows by itself."""
    null = F.lit(False)
    nan = F.lit(False)
    for c in NUMBERS:
        null = null | F.col(c).isNull()
        nan = nan | F.isnan(F.col(c))
    bad_prices = (
        (F.least(*PRICES) <= 0)
        | (F.col("high") < F.greatest("open", "close", "low"))
        | (F.col("low") > F.least("open", "close", "high"))
    )
    return {
        "null_values": null | F.col("trade_count").isNull(),
        "nan_values": nan,
        "ohlc_rule": bad_prices,
        "negative_volume": (F.col("volume") < 0) | (F.col("quote_volume") < 0) | (F.col("trade_count") < 0),
        "misaligned_time": ~aligned(F.col("open_time"), F.col("timeframe")),
    }


def issue_report(bars: DataFrame) -> DataFrame:
    """One row per series and issue found: severity, row count and first time.

    Rows are first combined per bar time (map-side), so copies of one bar and hot series stay cheap.
    """
    flags = {n: F.coalesce(c, F.lit(False)).cast("long") for n, c in row_issues().items()}
    per_time = bars.groupBy(*SERIES, "open_time").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(n) for n, c in flags.items()]
    )
    following = F.lead("open_time").over(Window.partitionBy(*SERIES).orderBy("open_time"))
    step = timeframe_ms(F.col("timeframe"))
    per_time = per_time.withColumn("duplicate_time", F.col("n") - 1).withColumn(
        "missing_bars", F.greatest(F.floor((following - F.col("open_time")) / step).cast("long") - 1, F.lit(0))
    )
    found = per_time.groupBy(*SERIES).agg(
        *[
            F.struct(
                F.lit(issue).alias("issue"),
                F.lit(severity).alias("severity"),
                F.coalesce(F.sum(issue), F.lit(0)).cast("long").alias("count"),
                F.min(F.when(F.col(issue) > 0, F.col("open_time"))).alias("first_time"),
            ).alias(issue)
            for issue, severity in ISSUES.items()
        ]
    )
    return found.select(*SERIES, F.explode(F.array(*ISSUES)).alias("i")).select(*SERIES, "i.*").filter("count > 0")


def issue_samples(bars: DataFrame, size: int = SAMPLE_ROWS) -> DataFrame:
    """The first ``size`` rows of every row-level issue of every series."""
    flags = row_issues()
    names = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()])
    rows = bars.withColumn("issue", F.explode(F.array_compact(names)))
    rank = F.row_number().over(
        Window.partitionBy(*SERIES, "issue").orderBy("open_time", *[F.col(c) for c in NUMBERS])
    )
    return rows.withColumn("sample_no", rank).filter(F.col("sample_no") <= size)


def sort_bars(bars: DataFrame) -> DataFrame:
    """Bars in time order inside partitions that each hold whole series."""
    return bars.repartition(*SERIES).sortWithinPartitions(*SERIES, "open_time")


def first_per_time(bars: DataFrame, arrival: str) -> DataFrame:
    """The first arriving row per bar time, with the number of rows it replaced in ``removed``.

    An aggregate, not a window: copies of one key combine before the shuffle.
    """
    keys = [*SERIES, "open_time"]
    rest = F.struct(*[F.col(c) for c in bars.columns if c not in keys])
    return bars.groupBy(*keys).agg(
        F.min_by(rest, arrival).alias("_row"), (F.count(F.lit(1)) - 1).alias("removed")
    ).select(*keys, "_row.*", "removed")


def strict_time_checks(bars: DataFrame, arrival: str, as_of: int | None = None) -> DataFrame:
    """Counts of out-of-order times (in arrival order), closes at or before opens, and future bars."""
    previous = F.lag("open_time").over(Window.partitionBy(*SERIES).orderBy(arrival))
    future = F.col("open_time") > F.lit(as_of) if as_of is not None else F.lit(False)
    return bars.withColumn("_before", previous).groupBy(*SERIES).agg(
        F.count_if(F.col("open_time") <= F.col("_before")).alias("not_increasing"),
        F.count_if(F.col("close_time") <= F.col("open_time")).alias("close_before_open"),
        F.count_if(future).alias("in_future"),
    )


def strict_value_checks(bars: DataFrame) -> DataFrame:
    """Failures per price and volume rule with the first time each occurs."""
    rules = {
        "price_not_positive": F.least(*PRICES) <= 0,
        "high_too_low": F.col("high") < F.greatest("open", "close", "low"),
        "low_too_high": F.col("low") > F.least("open", "close", "high"),
        "volume_negative": F.col("volume") < 0,
        "quote_volume_negative": F.col("quote_volume") < 0,
        "trade_count_negative": F.col("trade_count") < 0,
    }
    one_row = bars.groupBy(*SERIES).agg(
        *[
            F.struct(
                F.lit(n).alias("rule"),
                F.count_if(c).alias("count"),
                F.min(F.when(c, F.col("open_time"))).alias("first_time"),
            ).alias(n)
            for n, c in rules.items()
        ]
    )
    return one_row.select(*SERIES, F.explode(F.array(*rules)).alias("r")).select(*SERIES, "r.*")


def gaps(bars: DataFrame) -> DataFrame:
    """Holes in each series: first and last missing bar time and their number."""
    step = timeframe_ms(F.col("timeframe"))
    following = F.lead("open_time").over(Window.partitionBy(*SERIES).orderBy("open_time"))
    return (
        bars.withColumn("_step", step)
        .withColumn("_next", following)
        .filter(F.col("_next") - F.col("open_time") > F.col("_step"))
        .select(
            *SERIES,
            (F.col("open_time") + F.col("_step")).alias("gap_start"),
            (F.col("_next") - F.col("_step")).alias("gap_end"),
            (F.floor((F.col("_next") - F.col("open_time")) / F.col("_step")).cast("long") - 1).alias("missing"),
            "_step",
        )
    )


def missing_bars(bars: DataFrame) -> DataFrame:
    """One row per missing bar."""
    return gaps(bars).select(
        *SERIES, F.explode(F.expr("sequence(gap_start, gap_end, _step)")).alias("open_time")
    )


def gap_summary(bars: DataFrame) -> DataFrame:
    return gaps(bars).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("gap_count"),
        F.sum("missing").alias("missing_bars"),
        F.max("missing").alias("largest_gap"),
    )


def validated_bars(bars: DataFrame, arrival: str) -> DataFrame:
    """First row per bar time, kept only when every strict value rule holds."""
    kept = first_per_time(bars, arrival).drop("removed")
    failing = F.lit(False)
    for name, test in row_issues().items():
        failing = failing | F.coalesce(test, F.lit(False))
    return kept.filter(~failing & (F.col("close_time") > F.col("open_time")))
