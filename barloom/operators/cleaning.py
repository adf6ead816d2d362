"""Cleaning: each dataset is a list of (reason, test) rules; a row leaves with the first rule it fails."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(*columns: str) -> Column:
    """Null or NaN in any of the columns."""
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    return test


def negative(*columns: str) -> Column:
    test = F.lit(False)
    for c in columns:
        test = test | (F.col(c) < 0)
    return test


def bad_time(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) <= 0)


@dataclass(frozen=True)
class CleaningRules:
    """``key`` identifies copies of one observation; bars count as copies only when wholly equal."""

    columns: tuple[str, ...]
    rules: tuple[tuple[str, Column], ...]
    key: tuple[str, ...] = ()


def bar_rules() -> CleaningRules:
    prices = ("open", "high", "low", "close")
    amounts = ("volume", "quote_volume")
    not_positive = F.lit(False)
    for p in prices:
        not_positive = not_positive | (F.col(p) <= 0)
    inconsistent = (
        (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    )
    return CleaningRules(
        ("symbol", "timeframe", "open_time", "close_time", *prices, *amounts, "trade_count"),
        (
            ("missing_value", missing(*prices, *amounts, "trade_count", "open_time", "close_time")),
            ("invalid_price", not_positive | inconsistent),
            ("negative_volume", negative(*amounts)),
            ("negative_trade_count", negative("trade_count")),
            ("invalid_time", F.col("close_time") <= F.col("open_time")),
        ),
    )


def funding_rules() -> CleaningRules:
    return CleaningRules(
        ("symbol", "funding_time", "funding_rate", "mark_price"),
        (
            ("missing_rate", missing("funding_rate")),
            ("invalid_time", bad_time("funding_time")),
            ("invalid_mark_price", F.isnan("mark_price") | negative("mark_price")),
        ),
        key=("symbol", "funding_time"),
    )


def open_interest_rules() -> CleaningRules:
    return CleaningRules(
        ("symbol", "timestamp", "open_interest"),
        (
            ("missing_value", missing("open_interest")),
            ("invalid_time", bad_time("timestamp")),
            ("negative_value", negative("open_interest")),
        ),
        key=("symbol", "timestamp"),
    )


def taker_rules() -> CleaningRules:
    return CleaningRules(
        ("symbol", "timestamp", "buy_volume", "sell_volume"),
        (
            ("missing_buy", missing("buy_volume")),
            ("missing_sell", missing("sell_volume")),
            ("invalid_time", bad_time("timestamp")),
            ("negative_buy", negative("buy_volume")),
            ("negative_sell", negative("sell_volume")),
        ),
        key=("symbol", "timestamp"),
    )


def long_short_rules() -> CleaningRules:
    values = ("long_account", "short_account", "long_short_ratio")
    return CleaningRules(
        ("symbol", "timestamp", *values),
        (
            ("missing_value", missing(*values)),
            ("invalid_time", bad_time("timestamp")),
            ("negative_value", negative(*values)),
        ),
        key=("symbol", "timestamp"),
    )


RULES = {
    "ohlcv": bar_rules,
    "funding": funding_rules,
    "open_interest": open_interest_rules,
    "taker_volume": taker_rules,
    "long_short": long_short_rules,
}


def distinct_rows(df: DataFrame, spec: CleaningRules, arrival: str | None = None) -> DataFrame:
    """One row per key (or per distinct row) with the number of ``copies`` it stands for.

    The first copy by ``arrival`` stays; without an arrival column it is the smallest by value, so the
    choice does not depend on partitioning.  The aggregate combines map-side, so copies of a hot key
    never gather in one task.
    """
    copies = F.count(F.lit(1)).alias("copies")
    if not spec.key:
        return df.groupBy(*spec.columns).agg(copies)
    rest = F.struct(*[F.col(c) for c in spec.columns if c not in spec.key])
    first = F.min_by(rest, arrival) if arrival else F.min(rest)
    merged = df.groupBy(*spec.key).agg(first.alias("_row"), copies)
    return merged.select(*spec.key, "_row.*", "copies")


def judged(df: DataFrame, dataset: str, arrival: str | None = None) -> DataFrame:
    """Distinct rows with the ``reason`` they are rejected for (null: kept)."""
    spec = RULES[dataset]()
    reason = F.lit(None).cast("string")
    for name, test in reversed(spec.rules):
        reason = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(reason)
    return distinct_rows(df, spec, arrival).withColumn("reason", reason)


def clean(df: DataFrame, dataset: str, arrival: str | None = None) -> DataFrame:
    """Distinct rows that pass every rule of the dataset."""
    kept = judged(df, dataset, arrival).filter(F.col("reason").isNull()).drop("reason", "copies")
    if dataset == "taker_volume":
        kept = kept.withColumn("buy_sell_ratio", F.try_divide("buy_volume", "sell_volume"))
    return kept


def removal_report(df: DataFrame, dataset: str) -> DataFrame:
    """Rows read, kept and removed per rule, in rule order; duplicates are the first stage."""
    names: Sequence[str] = [name for name, _ in RULES[dataset]().rules]
    rows = judged(df, dataset)
    one_row = rows.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("input_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicate"),
        *[F.count(F.when(F.col("reason") == n, 1)).alias(n) for n in names],
        F.count(F.when(F.col("reason").isNull(), 1)).alias("kept"),
    )
    stages = ["input_rows", "duplicate", *names, "kept"]
    return one_row.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(i).alias("stage_no"), F.lit(n).alias("stage"), F.col(n).alias("rows"))
                for i, n in enumerate(stages)
            ])
        ).alias("s")
    ).select("s.*")
