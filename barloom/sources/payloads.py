"""Exchange payloads (JSON text) to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Positions of the fields in a kline array.
KLINE_FIELDS = (
    ("open_time", "long"), ("open", "double"), ("high", "double"), ("low", "double"), ("close", "double"),
    ("volume", "double"), ("close_time", "long"), ("quote_volume", "double"), ("trade_count", "long"),
)


def klines(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """One bar per kline array.  ``raw`` has symbol, timeframe and a JSON array of numbers or strings."""
    fields = F.from_json(F.col(payload), "array<string>")
    parsed = raw.select("symbol", "timeframe", fields.alias("f"))
    return parsed.select(
        "symbol", "timeframe",
        *[F.col("f")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(KLINE_FIELDS)],
    )


def kline_pages(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Bars of response pages, each a JSON array of kline arrays."""
    rows = raw.select("symbol", "timeframe", F.explode(F.from_json(F.col(payload), "array<array<string>>")).alias("f"))
    return rows.select(
        "symbol", "timeframe",
        *[F.col("f")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(KLINE_FIELDS)],
    )


def _object(raw: DataFrame, payload: str, fields: str) -> DataFrame:
    return raw.select(F.from_json(F.col(payload), fields).alias("j"), *[c for c in raw.columns if c != payload])


def _number(name: str) -> Column:
    return F.col(f"j.{name}").cast("double")


def funding(raw: DataFrame, payload: str = "payload") -> DataFrame:
    df = _object(raw, payload, "symbol string, fundingTime long, fundingRate string, markPrice string")
    mark = F.when(F.trim("j.markPrice") != "", F.col("j.markPrice")).cast("double")
    return df.select(
        "j.symbol", F.col("j.fundingTime").alias("funding_time"),
        _number("fundingRate").alias("funding_rate"), mark.alias("mark_price"),
    )


def open_interest(raw: DataFrame, payload: str = "payload") -> DataFrame:
    df = _object(raw, payload, "symbol string, timestamp long, sumOpenInterest string")
    return df.select("j.symbol", "j.timestamp", _number("sumOpenInterest").alias("open_interest"))


def taker_volume(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """The ratio is computed from the volumes rather than read."""
    df = _object(raw, payload, "symbol string, timestamp long, buyVol string, sellVol string")
    out = df.select("j.symbol", "j.timestamp", _number("buyVol").alias("buy_volume"), _number("sellVol").alias("sell_volume"))
    return out.withColumn("buy_sell_ratio", F.try_divide("buy_volume", "sell_volume"))


def long_short(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Account and position ratios; ``raw`` carries the ``kind`` of ratio of every payload."""
    df = _object(raw, payload, "symbol string, timestamp long, longAccount string, shortAccount string, longShortRatio string")
    return df.select(
        "kind", "j.symbol", "j.timestamp", _number("longAccount").alias("long_account"),
        _number("shortAccount").alias("short_account"), _number("longShortRatio").alias("long_short_ratio"),
    )


CONTRACT = (
    "symbol string, status string, contractType string, quoteAsset string, baseAsset string, "
    "pricePrecision int, quantityPrecision int, "
    "filters array<struct<filterType: string, tickSize: string, minQty: string, maxQty: string, stepSize: string, notional: string>>"
)


def contracts(raw: DataFrame, payload: str = "payload", quote: str = "USDT") -> DataFrame:
    """Tradeable perpetual contracts with their price, lot and notional limits flattened."""
    df = _object(raw, payload, CONTRACT).filter(
        (F.col("j.status") == "TRADING") & (F.col("j.contractType") == "PERPETUAL") & (F.col("j.quoteAsset") == quote)
    )

    def limit(kind: str, name: str) -> Column:
        match = F.filter(F.col("j.filters"), lambda f: f["filterType"] == kind)
        return F.get(match, F.lit(0))[name].cast("double")

    return df.select(
        "j.symbol", F.col("j.baseAsset").alias("base_asset"), F.col("j.quoteAsset").alias("quote_asset"),
        F.col("j.pricePrecision").alias("price_precision"), F.col("j.quantityPrecision").alias("quantity_precision"),
        limit("PRICE_FILTER", "tickSize").alias("tick_size"),
        limit("LOT_SIZE", "minQty").alias("min_quantity"),
        limit("LOT_SIZE", "maxQty").alias("max_quantity"),
        limit("LOT_SIZE", "stepSize").alias("step_size"),
        limit("MIN_NOTIONAL", "notional").alias("min_notional"),
    )


def latest_per_symbol(dimension: DataFrame, version: str) -> DataFrame:
    """Newest contract row per symbol."""
    newest = Window.partitionBy("symbol").orderBy(F.col(version).desc())
    return dimension.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
