"""Queries for sources, cleaning, validation, verification, alignment and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.clock import utc_year
from barloom.operators import asof, cleaning, labels, training, validation, verify
from barloom.operators.factors import CATALOG, dependency_class, executable, factor_frame, required_datasets
from barloom.operators.features import FEATURES, feature_frame
from barloom.sources import payloads
from barloom.sources import tables as stored

from . import tables
from .factor_sql import FEATURE_SQL, SERIES, staged
from .registry import add
from .sql import BARS_1D, BARS_1H, COMPANIONS, DIRTY_1H, FEATURE_INPUTS_1D, INPUTS_1D

BAR_DOUBLES = ["open", "high", "low", "close", "volume", "quote_volume"]
BAR_COLUMNS = ["symbol", "timeframe", "open_time", *BAR_DOUBLES[:5], "close_time", "quote_volume", "trade_count"]
COLS = ", ".join(BAR_COLUMNS)

# -- views ------------------------------------------------------------------------------------
add("bars_1h", lambda s, d: tables.bars_1h(s, d).select(*BAR_COLUMNS), f"WITH {BARS_1H} SELECT {COLS} FROM bars", BAR_DOUBLES)
add("bars_1d", lambda s, d: tables.bars_1d(s, d).select(*BAR_COLUMNS), f"WITH {BARS_1D} SELECT {COLS} FROM bars", BAR_DOUBLES)

# -- payloads: the driver's tables serialised to exchange JSON by Spark, then parsed ---------------


def _kline_json(df):
    fields = [F.col(n).cast("string") for n, _ in payloads.KLINE_FIELDS]
    return df.select("symbol", "timeframe", F.to_json(F.array(*fields)).alias("payload"))


def _kline_pages(df):
    # One response page per symbol and day, at most 24 hourly bars.
    bars = df.withColumn("day", F.floor(F.col("open_time") / 86_400_000))
    row = F.array(*[F.col(n).cast("string") for n, _ in payloads.KLINE_FIELDS])
    return bars.groupBy("symbol", "timeframe", "day").agg(F.to_json(F.collect_list(row)).alias("payload"))


add("parse_klines", lambda s, d: payloads.klines(_kline_json(tables.bars_1d(s, d))).select(*BAR_COLUMNS),
    f"WITH {BARS_1D} SELECT {COLS} FROM bars", BAR_DOUBLES)
add("parse_kline_pages", lambda s, d: payloads.kline_pages(_kline_pages(tables.bars_1h(s, d))).select(*BAR_COLUMNS),
    f"WITH {BARS_1H} SELECT {COLS} FROM bars", BAR_DOUBLES)


def _json(**fields):
    return F.to_json(F.struct(*[F.col(c).cast(t).alias(k) for k, (c, t) in fields.items()]))


def _funding_payload(s, d):
    return payloads.funding(tables.funding_w(s, d).select(_json(
        symbol=("symbol", "string"), fundingTime=("funding_time", "long"),
        fundingRate=("funding_rate", "string"), markPrice=("mark_price", "string")).alias("payload")))


def _oi_payload(s, d):
    return payloads.open_interest(tables.oi_w(s, d).select(_json(
        symbol=("symbol", "string"), timestamp=("timestamp", "long"),
        sumOpenInterest=("open_interest", "string")).alias("payload")))


def _taker_payload(s, d):
    return payloads.taker_volume(tables.taker_w(s, d).select(_json(
        symbol=("symbol", "string"), timestamp=("timestamp", "long"),
        buyVol=("buy_volume", "string"), sellVol=("sell_volume", "string")).alias("payload")))


def _ls_payload(s, d):
    return payloads.long_short(tables.ls_w(s, d).select(F.lit("global_account").alias("kind"), _json(
        symbol=("symbol", "string"), timestamp=("timestamp", "long"), longAccount=("long_account", "string"),
        shortAccount=("short_account", "string"), longShortRatio=("long_short_ratio", "string")).alias("payload")))


W1D = BARS_1D + COMPANIONS
add("parse_funding", _funding_payload, f"WITH {W1D} SELECT * FROM funding", ["funding_rate", "mark_price"], digits=9)
add("parse_open_interest", _oi_payload, f"WITH {W1D} SELECT * FROM oi", ["open_interest"])
add("parse_taker_volume", _taker_payload,
    f"WITH {W1D} SELECT *, buy_volume / nullif(sell_volume, 0) AS buy_sell_ratio FROM taker",
    ["buy_volume", "sell_volume", "buy_sell_ratio"])
add("parse_long_short", _ls_payload, f"WITH {W1D} SELECT 'global_account' AS kind, * FROM ls",
    ["long_account", "short_account", "long_short_ratio"])


def _contracts(s, d):
    """Parts as contracts: size is the lot step, retail price the tick, type the contract status."""
    part = tables.read(s, d, "part")
    text = lambda c: F.col(c).cast("string")
    raw = part.select(F.to_json(F.struct(
        F.concat(F.lit("P"), text("p_partkey")).alias("symbol"),
        F.when(F.col("p_size") > 10, "TRADING").otherwise("BREAK").alias("status"),
        F.when(F.col("p_type") == "ECONOMY", "PERPETUAL").otherwise("CURRENT_QUARTER").alias("contractType"),
        F.lit("USDT").alias("quoteAsset"), F.col("p_brand").alias("baseAsset"),
        F.lit(2).alias("pricePrecision"), F.lit(3).alias("quantityPrecision"),
        F.array(
            F.struct(F.lit("PRICE_FILTER").alias("filterType"), text("p_retailprice").alias("tickSize"),
                     F.lit(None).cast("string").alias("minQty"), F.lit(None).cast("string").alias("maxQty"),
                     F.lit(None).cast("string").alias("stepSize"), F.lit(None).cast("string").alias("notional")),
            F.struct(F.lit("LOT_SIZE").alias("filterType"), F.lit(None).cast("string").alias("tickSize"),
                     F.lit("1").alias("minQty"), F.lit("1000").alias("maxQty"), text("p_size").alias("stepSize"),
                     F.lit(None).cast("string").alias("notional")),
        ).alias("filters"),
    )).alias("payload"))
    return payloads.contracts(raw)


add("parse_contracts", _contracts, """
SELECT 'P' || p_partkey AS symbol, p_brand AS base_asset, 'USDT' AS quote_asset, 2 AS price_precision,
  3 AS quantity_precision, p_retailprice AS tick_size, 1.0 AS min_quantity, 1000.0 AS max_quantity,
  CAST(p_size AS DOUBLE) AS step_size, CAST(NULL AS DOUBLE) AS min_notional
FROM part WHERE p_size > 10 AND p_type = 'ECONOMY'""",
    ["tick_size", "min_quantity", "max_quantity", "step_size", "min_notional"])

# -- tables ---------------------------------------------------------------------------------
add("split_by_year", lambda s, d: stored.split_by_year(tables.bars_1d(s, d).drop("year")).groupBy("year").agg(F.count(F.lit(1)).alias("rows")),
    f"WITH {BARS_1D} SELECT CAST(year AS INTEGER) AS year, count(*) AS rows FROM bars GROUP BY year")
add("latest_times", lambda s, d: stored.latest_times(tables.bars_1d(s, d)),
    f"WITH {BARS_1D} SELECT symbol, timeframe, max(open_time) AS latest_time FROM bars GROUP BY ALL")
add("partition_profile", lambda s, d: stored.partition_profile(tables.bars_1d(s, d).drop("year")), f"""
WITH {BARS_1D} SELECT symbol, timeframe, CAST(year AS INTEGER) AS year, count(*) AS rows, min(open_time) AS first_time,
  max(open_time) AS last_time FROM bars GROUP BY ALL""")

# 2001-06-01: bars before it are stored, later ones arrive; 2001-05-01 to 2001-06-01 arrive corrected.
CUT, OVERLAP = 991_353_600_000, 988_675_200_000


def _merge(s, d):
    bars = tables.bars_1d(s, d).select("symbol", "timeframe", "open_time", "close", "volume")
    old = bars.filter(F.col("open_time") < CUT)
    new = bars.filter(F.col("open_time") >= OVERLAP).withColumn("close", F.col("close") * 2)
    return stored.merge_rows(old, new, ["symbol", "timeframe", "open_time"])


add("merge_rows", _merge, f"""WITH {BARS_1D} SELECT symbol, timeframe, open_time,
  CASE WHEN open_time >= {OVERLAP} THEN close * 2 ELSE close END AS close, volume FROM bars""", ["close", "volume"])


def _requests(s, d):
    bars = tables.bars_1d(s, d)
    # One request per brand and bar count class; some end before the stored data, some ask for new symbols.
    return bars.groupBy("symbol", "timeframe").agg(
        (F.min("open_time") - 10 * 86_400_000).alias("start_time"),
        (F.max("open_time") + (F.count(F.lit(1)) % 3 - 1) * 86_400_000 * 5).alias("end_time"),
    ).withColumn("symbol", F.when(F.col("symbol") == "Brand#7", "Brand#99").otherwise(F.col("symbol")))


add("resume_windows", lambda s, d: stored.resume_windows(_requests(s, d), stored.latest_times(tables.bars_1d(s, d))), f"""
WITH {BARS_1D},
r AS (SELECT CASE WHEN symbol = 'Brand#7' THEN 'Brand#99' ELSE symbol END AS symbol, timeframe, min(open_time) - 864000000 AS s,
  max(open_time) + (count(*) % 3 - 1) * 432000000 AS e FROM bars GROUP BY bars.symbol, timeframe),
l AS (SELECT symbol, max(open_time) AS latest FROM bars GROUP BY symbol),
j AS (SELECT r.*, latest, CASE WHEN latest IS NULL THEN 'FULL' WHEN latest + 86400000 > e THEN 'SKIPPED' ELSE 'UPDATED' END AS status
  FROM r LEFT JOIN l USING (symbol))
SELECT symbol, timeframe, status,
  CASE status WHEN 'FULL' THEN s WHEN 'UPDATED' THEN greatest(s, latest + 86400000) END AS load_start,
  CASE WHEN status <> 'SKIPPED' THEN e END AS load_end FROM j""")

# Expected hourly coverage: all of January 2024.
JAN_START, JAN_END = 1_704_067_200_000, 1_706_742_000_000


def _missing_ranges(s, d):
    bars = tables.bars_1h(s, d)
    expected = bars.select("symbol", "timeframe").distinct().select(
        "symbol", "timeframe", F.lit(JAN_START).alias("first_expected"), F.lit(JAN_END).alias("last_expected"))
    return stored.missing_ranges(bars, expected)


add("missing_ranges", _missing_ranges, f"""
WITH {BARS_1H},
grid AS (SELECT symbol, unnest(range({JAN_START}, {JAN_END} + 1, 3600000)) AS t FROM (SELECT DISTINCT symbol FROM bars)),
holes AS (SELECT g.symbol, g.t, g.t // 3600000 - row_number() OVER (PARTITION BY g.symbol ORDER BY g.t) AS island
  FROM grid g ANTI JOIN bars b ON b.symbol = g.symbol AND b.open_time = g.t)
SELECT symbol, '1h' AS timeframe, min(t) AS start, max(t) AS "end", count(*) AS bars FROM holes GROUP BY symbol, island""")


def _repair(s, d):
    bars = tables.bars_1d(s, d)
    # Every brand is expected in every calendar year from 1995 to 2001.
    expected = bars.select("symbol", "timeframe").distinct().select(
        "symbol", "timeframe", F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year"),
        F.lit(300).cast("long").alias("expected_rows"))
    broken = bars.filter(F.col("high") == F.col("low") * 1.0).filter(F.col("trade_count") > 1).groupBy(
        "symbol", "timeframe", "year").agg(F.count(F.lit(1)).alias("bad_rows"))
    return stored.repair_plan(stored.partition_profile(bars.drop("year")), expected, broken)


add("repair_plan", _repair, f"""
WITH {BARS_1D},
p AS (SELECT symbol, timeframe, year, count(*) AS rows, count(*) FILTER (high = low AND trade_count > 1) AS bad_rows
  FROM bars GROUP BY ALL),
x AS (SELECT DISTINCT b.symbol, b.timeframe, y.year FROM bars b, (SELECT unnest(range(1995, 2002)) AS year) y)
SELECT symbol, timeframe, CAST(year AS INTEGER) AS year,
  CASE WHEN rows IS NULL THEN 'MISSING' WHEN bad_rows > 0 THEN 'CORRUPT' ELSE 'SHORT' END AS issue,
  coalesce(rows, 0) AS rows, CAST(300 AS BIGINT) AS expected_rows, coalesce(bad_rows, 0) AS bad_rows
FROM x LEFT JOIN p USING (symbol, timeframe, year) WHERE rows IS NULL OR bad_rows > 0 OR rows < 300""")

# -- cleaning ----------------------------------------------------------------------------------
REASON = """CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'missing_value'
  WHEN least(open, high, low, close) <= 0 OR high < greatest(open, close, low) OR low > least(open, close, high) THEN 'invalid_price'
  WHEN volume < 0 OR quote_volume < 0 THEN 'negative_volume' END"""
add("clean_ohlcv", lambda s, d: cleaning.clean(tables.dirty_1h(s, d), "ohlcv"),
    f"WITH {DIRTY_1H} SELECT DISTINCT {COLS} FROM dirty WHERE ({REASON}) IS NULL", BAR_DOUBLES)
add("clean_ohlcv_report", lambda s, d: cleaning.removal_report(tables.dirty_1h(s, d), "ohlcv"), f"""
WITH {DIRTY_1H}, rows AS (SELECT DISTINCT {COLS} FROM dirty), why AS (SELECT {REASON} AS reason FROM rows)
SELECT * FROM (
  SELECT 0 AS stage_no, 'input_rows' AS stage, (SELECT count(*) FROM dirty) AS rows
  UNION ALL SELECT 1, 'duplicate', (SELECT count(*) FROM dirty) - (SELECT count(*) FROM rows)
  UNION ALL SELECT 2, 'missing_value', (SELECT count(*) FROM why WHERE reason = 'missing_value')
  UNION ALL SELECT 3, 'invalid_price', (SELECT count(*) FROM why WHERE reason = 'invalid_price')
  UNION ALL SELECT 4, 'negative_volume', (SELECT count(*) FROM why WHERE reason = 'negative_volume')
  UNION ALL SELECT 5, 'negative_trade_count', 0
  UNION ALL SELECT 6, 'invalid_time', 0
  UNION ALL SELECT 7, 'kept', (SELECT count(*) FROM why WHERE reason IS NULL))""")


def dirtied(df, time: str, values: list[str]):
    """Companion rows with copies and corruption: every 7th week twice, every 11th null, every 13th negative."""
    week = F.floor(F.col(time) / 604_800_000)
    first = values[0]
    bad = df.withColumn(first, F.when(week % 11 != 0, F.when(week % 13 == 0, -F.abs(F.col(first)) - 1).otherwise(F.col(first))))
    copies = F.when(week % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return bad.withColumn("_copy", F.explode(copies)).drop("_copy")


def _dirty_sql(source: str, time: str, first: str, others: str, filters: str, ratio: str = "") -> str:
    return f"""
WITH {W1D},
d AS (SELECT symbol, "{time}", CASE WHEN w % 11 = 0 THEN NULL WHEN w % 13 = 0 THEN -abs({first}) - 1 ELSE {first} END AS {first}{others}
  FROM (SELECT *, "{time}" // 604800000 AS w FROM {source}))
SELECT *{ratio} FROM d WHERE {first} IS NOT NULL AND {filters}"""


add("clean_funding", lambda s, d: cleaning.clean(dirtied(tables.funding_w(s, d), "funding_time", ["funding_rate"]), "funding"),
    _dirty_sql("funding", "funding_time", "funding_rate", ", mark_price", "mark_price >= 0"), ["funding_rate", "mark_price"], digits=9)
add("clean_open_interest", lambda s, d: cleaning.clean(dirtied(tables.oi_w(s, d), "timestamp", ["open_interest"]), "open_interest"),
    _dirty_sql("oi", "timestamp", "open_interest", "", "open_interest >= 0"), ["open_interest"])
add("clean_taker_volume", lambda s, d: cleaning.clean(dirtied(tables.taker_w(s, d), "timestamp", ["buy_volume"]), "taker_volume"),
    _dirty_sql("taker", "timestamp", "buy_volume", ", sell_volume", "buy_volume >= 0 AND sell_volume >= 0",
               ", buy_volume / nullif(sell_volume, 0) AS buy_sell_ratio"),
    ["buy_volume", "sell_volume", "buy_sell_ratio"])
add("clean_long_short", lambda s, d: cleaning.clean(dirtied(tables.ls_w(s, d), "timestamp", ["long_account"]), "long_short"),
    _dirty_sql("ls", "timestamp", "long_account", ", short_account, long_short_ratio",
               "long_account >= 0 AND short_account IS NOT NULL AND long_short_ratio IS NOT NULL"),
    ["long_account", "short_account", "long_short_ratio"])

# -- validation -----------------------------------------------------------------------------------
add("validate_bars", lambda s, d: validation.issue_report(tables.dirty_1h(s, d)), f"""
WITH {DIRTY_1H},
flags AS (SELECT symbol, timeframe, open_time,
  (close IS NULL) AS f_null, coalesce(high < greatest(open, close, low) OR low > least(open, close, high), false) AS f_ohlc,
  (volume < 0) AS f_vol FROM dirty),
per AS (SELECT symbol, open_time, count(*) AS n FROM dirty GROUP BY ALL),
nxt AS (SELECT symbol, open_time, n, greatest((lead(open_time) OVER (PARTITION BY symbol ORDER BY open_time) - open_time) // 3600000 - 1, 0) AS miss FROM per)
SELECT * FROM (
  SELECT symbol, '1h' AS timeframe, 'null_values' AS issue, 'ERROR' AS severity, count(*) AS count, min(open_time) AS first_time FROM flags WHERE f_null GROUP BY symbol
  UNION ALL SELECT symbol, '1h', 'ohlc_rule', 'ERROR', count(*), min(open_time) FROM flags WHERE f_ohlc GROUP BY symbol
  UNION ALL SELECT symbol, '1h', 'negative_volume', 'ERROR', count(*), min(open_time) FROM flags WHERE f_vol GROUP BY symbol
  UNION ALL SELECT symbol, '1h', 'duplicate_time', 'ERROR', CAST(sum(n - 1) AS BIGINT), min(open_time) FROM nxt WHERE n > 1 GROUP BY symbol
  UNION ALL SELECT symbol, '1h', 'missing_bars', 'WARNING', CAST(sum(miss) AS BIGINT), min(open_time) FROM nxt WHERE miss > 0 GROUP BY symbol)""")
add("validate_bars_samples",
    lambda s, d: validation.issue_samples(tables.dirty_1h(s, d)).select("symbol", "issue", "sample_no", "open_time"), f"""
WITH {DIRTY_1H},
bad AS (SELECT symbol, 'null_values' AS issue, open_time FROM dirty WHERE close IS NULL
  UNION ALL SELECT symbol, 'ohlc_rule', open_time FROM dirty WHERE high < greatest(open, close, low) OR low > least(open, close, high)
  UNION ALL SELECT symbol, 'negative_volume', open_time FROM dirty WHERE volume < 0)
SELECT symbol, issue, CAST(row_number() OVER (PARTITION BY symbol, issue ORDER BY open_time) AS INTEGER) AS sample_no, open_time
FROM bad QUALIFY row_number() OVER (PARTITION BY symbol, issue ORDER BY open_time) <= 5""")
add("sort_bars", lambda s, d: validation.sort_bars(tables.bars_1h(s, d)).select(*BAR_COLUMNS),
    f"WITH {BARS_1H} SELECT {COLS} FROM bars", BAR_DOUBLES)


def _arrivals(s, d):
    """Events as rows of one-hour bars, arriving in event order."""
    return tables.read(s, d, "events").select(
        F.col("event_type").alias("symbol"), F.lit("1h").alias("timeframe"),
        (F.floor(tables.epoch_ms(tables.read(s, d, "events"), "ts") / 3_600_000) * 3_600_000).cast("long").alias("open_time"),
        "event_id", F.col("value").alias("close"))


add("first_per_time", lambda s, d: validation.first_per_time(_arrivals(s, d), "event_id"), """
SELECT event_type AS symbol, '1h' AS timeframe, CAST(floor(epoch_ms(ts) / 3600000) AS BIGINT) * 3600000 AS open_time,
  min(event_id) AS event_id, arg_min(value, event_id) AS close, count(*) - 1 AS removed FROM events GROUP BY ALL""", ["close"])
add("strict_time_checks",
    lambda s, d: validation.strict_time_checks(
        tables.bars_1h(s, d).withColumn("arrival", F.col("open_time") % 7_200_001), "arrival", as_of=1_705_000_000_000), f"""
WITH {BARS_1H}, x AS (SELECT *, lag(open_time) OVER (PARTITION BY symbol, timeframe ORDER BY open_time % 7200001) AS p FROM bars)
SELECT symbol, timeframe, count(*) FILTER (open_time <= p) AS not_increasing, count(*) FILTER (close_time <= open_time) AS close_before_open,
  count(*) FILTER (open_time > 1705000000000) AS in_future FROM x GROUP BY ALL""")
add("strict_value_checks", lambda s, d: validation.strict_value_checks(tables.dirty_1h(s, d)), f"""
WITH {DIRTY_1H}, r AS (
  SELECT symbol, timeframe, open_time, unnest([
    {{'rule': 'price_not_positive', 'bad': least(open, high, low, close) <= 0}},
    {{'rule': 'high_too_low', 'bad': high < greatest(open, close, low)}},
    {{'rule': 'low_too_high', 'bad': low > least(open, close, high)}},
    {{'rule': 'volume_negative', 'bad': volume < 0}},
    {{'rule': 'quote_volume_negative', 'bad': quote_volume < 0}},
    {{'rule': 'trade_count_negative', 'bad': trade_count < 0}}]) AS t FROM dirty)
SELECT symbol, timeframe, t.rule AS rule, count(*) FILTER (t.bad) AS count, min(open_time) FILTER (t.bad) AS first_time FROM r GROUP BY ALL""")
HOLES = f"""WITH {BARS_1H}, n AS (SELECT symbol, timeframe, open_time, lead(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS nx FROM bars)"""
add("missing_bars", lambda s, d: validation.missing_bars(tables.bars_1h(s, d)),
    f"{HOLES} SELECT symbol, timeframe, unnest(range(open_time + 3600000, nx, 3600000)) AS open_time FROM n WHERE nx - open_time > 3600000")
add("gap_summary", lambda s, d: validation.gap_summary(tables.bars_1h(s, d)), f"""{HOLES}
SELECT symbol, timeframe, count(*) AS gap_count, CAST(sum((nx - open_time) // 3600000 - 1) AS BIGINT) AS missing_bars,
  max((nx - open_time) // 3600000 - 1) AS largest_gap FROM n WHERE nx - open_time > 3600000 GROUP BY ALL""")
add("validated_bars",
    lambda s, d: validation.validated_bars(tables.dirty_1h(s, d).withColumn("arrival", F.col("open_time")), "arrival").select(*BAR_COLUMNS),
    f"""WITH {DIRTY_1H} SELECT DISTINCT {COLS} FROM dirty WHERE ({REASON}) IS NULL""", BAR_DOUBLES)

# -- raw and processed verification ------------------------------------------------------------------


def _verify(dataset: str, source):
    def run(s, d):
        df = source(s, d)
        return verify.verify(df, verify.catalog()[dataset])

    return run


def verify_sql(source: str, keys: str, tests: dict[str, str]) -> str:
    """Generic oracle: counts per check over ``source``."""
    parts = [f"SELECT 'rows' AS \"check\", count(*) AS failures FROM {source}",
             f"SELECT 'duplicate_rows', count(*) - (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {source})) FROM {source}"]
    parts += [f"SELECT '{n}', count(*) FROM {source} WHERE {t}" for n, t in tests.items()]
    union = " UNION ALL ".join(parts)
    return f"SELECT \"check\", failures, CASE WHEN \"check\" = 'rows' THEN failures > 0 ELSE failures = 0 END AS passed FROM ({union})"


add("verify_ohlcv", _verify("ohlcv", tables.dirty_1h), f"WITH {DIRTY_1H} " + verify_sql("dirty", "symbol, timeframe, open_time", {
    "null_rows": "close IS NULL", "nan_rows": "isnan(close) OR isnan(open)", "invalid_time_rows": "open_time <= 0",
    "price_rule_rows": "least(open, high, low, close) <= 0 OR high < greatest(open, close, low) OR low > least(open, close, high)",
    "negative_rows": "least(volume, quote_volume) < 0 OR trade_count < 0"}))
for _n, _f, _t, _first in (
    ("funding", tables.funding_w, "funding_time", "funding_rate"), ("open_interest", tables.oi_w, "timestamp", "open_interest"),
    ("taker_volume", tables.taker_w, "timestamp", "buy_volume"), ("long_short", tables.ls_w, "timestamp", "long_account"),
):
    _src = {"funding": "funding", "open_interest": "oi", "taker_volume": "taker", "long_short": "ls"}[_n]
    _cte = f"""WITH {W1D}, d AS (SELECT * EXCLUDE (w, {_first}), CASE WHEN w % 11 = 0 THEN NULL WHEN w % 13 = 0 THEN -abs({_first}) - 1 ELSE {_first} END AS {_first}
  FROM (SELECT *, "{_t}" // 604800000 AS w FROM {_src}), (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR w % 7 = 0) """
    _tests = {"null_rows": f"{_first} IS NULL" + (" OR long_short_ratio IS NULL" if _n == "long_short" else ""),
              "nan_rows": f"isnan({_first})", "invalid_time_rows": f'"{_t}" <= 0'}
    if _n != "funding":
        _tests["negative_rows"] = f"{_first} < 0"
    add(f"verify_{_n}", _verify(_n, lambda s, d, f=_f, t=_t, c=_first: dirtied(f(s, d), t, [c])),
        _cte + verify_sql("d", f'symbol, "{_t}"', _tests))

# -- alignment ---------------------------------------------------------------------------------------
COMPANION_OUT = ["funding_rate", "mark_price", "open_interest", "taker_buy_volume", "taker_sell_volume", "long_short_ratio"]
add("factor_input_assembly",
    lambda s, d: tables.assembled_factor_inputs(s, d).select("symbol", "open_time", "close", *COMPANION_OUT),
    f"WITH {INPUTS_1D} SELECT symbol, open_time, close, {', '.join(COMPANION_OUT)} FROM inputs", ["close", *COMPANION_OUT])
FEATURE_OUT = list(asof.FEATURE_COMPANIONS)
add("feature_input_assembly", lambda s, d: tables.feature_inputs_1d(s, d).select("symbol", "open_time", "close", *FEATURE_OUT),
    f"WITH {FEATURE_INPUTS_1D} SELECT symbol, open_time, close, {', '.join(FEATURE_OUT)} FROM inputs", ["close", *FEATURE_OUT])
add("asof_without_floor",
    lambda s, d: asof.asof_join(tables.bars_1d(s, d), [
        asof.Companion("funding", tables.funding_w(s, d), "funding_time", {"funding_rate": "funding_rate"})], by_year=False
    ).select("symbol", "open_time", "funding_rate"),
    f"""WITH {W1D} SELECT b.symbol, b.open_time, f.funding_rate FROM bars b ASOF LEFT JOIN funding f
  ON b.symbol = f.symbol AND b.open_time >= f.funding_time""", ["funding_rate"], digits=9)
GROUPS = {"all": COMPANION_OUT, "open_interest": ["open_interest"], "long_short": ["long_short_ratio"],
          "funding": ["funding_rate", "mark_price"]}
add("first_complete_times",
    lambda s, d: asof.first_complete_times(tables.factor_inputs_1d(s, d), GROUPS).withColumn("year", F.col("year").cast("long")),
    f"WITH {INPUTS_1D} SELECT symbol, timeframe, year, min(open_time) AS first_bar, " + ", ".join(
        f"min(open_time) FILTER ({' AND '.join(f'{c} IS NOT NULL' for c in cols)}) AS first_{n}" for n, cols in GROUPS.items())
    + " FROM inputs GROUP BY symbol, timeframe, year")


def _wide_matrix(s, d):
    """All executable factors of bars and companions side by side; counts of non-null values per factor."""
    inputs = tables.factor_inputs_1d(s, d)
    wide = factor_frame(inputs)
    names = [c for c in wide.columns if c not in ("symbol", "timeframe", "open_time")]
    counted = wide.agg(*[F.count(n).alias(n) for n in names])
    return counted.unpivot([], names, "factor_name", "non_null")


add("factor_matrix_counts", _wide_matrix)


def _catalog_rows(s, d):
    """Catalog classes joined with the number of bars on which the inputs of each factor are complete."""
    inputs = tables.factor_inputs_1d(s, d)
    ready = executable(inputs.columns)
    counts = inputs.agg(*[F.count_if(asof.complete(f.inputs)).alias(f.name) for f in ready])
    long = counts.unpivot([], [f.name for f in ready], "factor_name", "complete_bars")
    meta = s.createDataFrame([(f.name, dependency_class(f), "|".join(required_datasets(f))) for f in ready],
                             "factor_name string, dependency_class string, datasets string")
    return long.join(F.broadcast(meta), "factor_name")


add("executable_catalog", _catalog_rows)

FEATURE_NAMES = list(FEATURES)
add("feature_matrix", lambda s, d: feature_frame(tables.feature_inputs_1d(s, d)).drop("timeframe"), f"""
WITH {FEATURE_INPUTS_1D}
SELECT symbol, open_time, {', '.join(FEATURE_NAMES)} FROM ({staged('inputs', [], {**FEATURE_SQL, 'place': f'row_number() OVER ({SERIES})'}, 'symbol, open_time')})
WHERE place > 20""", FEATURE_NAMES, special={"dollar_volume": 3})

# -- labels ------------------------------------------------------------------------------------------
HS = labels.HORIZONS
LABEL_CTE = ", ".join(f"lead(close, {h}) OVER ({SERIES}) / close - 1 AS future_return_{h}" for h in HS)
LABEL_COLS = ", ".join([f"future_return_{h}" for h in HS] + [f"CAST(future_return_{h} > 0 AS TINYINT) AS direction_{h}" for h in HS])
LABELS = f"labelled AS (SELECT symbol, timeframe, open_time, {LABEL_CTE} FROM bars), labels_1d AS (SELECT symbol, timeframe, open_time, {LABEL_COLS} FROM labelled WHERE future_return_20 IS NOT NULL)"
RET = [f"future_return_{h}" for h in HS]
add("labels", lambda s, d: labels.label_frame(tables.bars_1d(s, d)), f"WITH {BARS_1D}, {LABELS} SELECT * FROM labels_1d", RET)
add("forward_return", lambda s, d: labels.forward_return(tables.bars_1d(s, d), 3, "open").select("symbol", "open_time", "forward_return"),
    f"WITH {BARS_1D} SELECT symbol, open_time, lead(open, 3) OVER ({SERIES}) / open - 1 AS forward_return FROM bars", ["forward_return"])


def _sides(s, d):
    return feature_frame(tables.bars_1d(s, d), ["returns", "rolling_mean", "atr", "dollar_volume"]), labels.label_frame(tables.bars_1d(s, d))


def _training(s, d):
    return training.training_join(*_sides(s, d))


def _damaged_sides(s, d):
    """Every 13th day's features twice, every 17th day's labels thrice, every 19th day's label times null."""
    day = F.floor(F.col("open_time") / 86_400_000)

    def copied(df, every, n):
        return df.withColumn("_copy", F.explode(F.when(day % every == 0, F.sequence(F.lit(1), F.lit(n))).otherwise(F.array(F.lit(1))))).drop("_copy")

    feats, targets = _sides(s, d)
    return copied(feats, 13, 2), copied(targets, 17, 3).withColumn("open_time", F.when(day % 19 != 0, F.col("open_time")))


_tf = {n: FEATURE_SQL[n] for n in ("returns", "rolling_mean", "atr", "dollar_volume")}
add("training_join", _training, f"""
WITH {BARS_1D}, {LABELS}, feats AS ({staged('bars', [], {**_tf, 'place': f'row_number() OVER ({SERIES})'}, 'symbol, timeframe, open_time')})
SELECT f.* EXCLUDE (place), l.* EXCLUDE (symbol, timeframe, open_time) FROM feats f JOIN labels_1d l USING (symbol, timeframe, open_time)
WHERE place > 20""", [*_tf, *RET], special={"dollar_volume": 3})
SIDES = f"""{BARS_1D}, {LABELS}, feats AS ({staged('bars', [], {**_tf, 'place': f'row_number() OVER ({SERIES})'}, 'symbol, timeframe, open_time')}),
fs AS MATERIALIZED (SELECT * EXCLUDE (place), unnest(CASE WHEN (open_time // 86400000) % 13 = 0 THEN [1, 2] ELSE [1] END) AS c FROM feats WHERE place > 20),
ls AS MATERIALIZED (SELECT * REPLACE (CASE WHEN (open_time // 86400000) % 19 <> 0 THEN open_time END AS open_time), unnest(CASE WHEN (open_time // 86400000) % 17 = 0 THEN [1, 2, 3] ELSE [1] END) AS c FROM labels_1d),
kf AS MATERIALIZED (SELECT side, symbol, timeframe, open_time, count(*) AS copies, CASE WHEN open_time IS NULL THEN 'NULL_KEY' ELSE 'DUPLICATE_KEY' END AS fault
  FROM (SELECT 'features' AS side, symbol, timeframe, open_time FROM fs UNION ALL SELECT 'labels', symbol, timeframe, open_time FROM ls) GROUP BY ALL HAVING count(*) > 1 OR open_time IS NULL)"""
add("training_key_faults", lambda s, d: training.key_faults(*_damaged_sides(s, d)), f"WITH {SIDES} SELECT * FROM kf")
add("training_join_of_unique_keys", lambda s, d: training.training_join(*_damaged_sides(s, d), strict=False), f"""WITH {SIDES}
SELECT fs.* EXCLUDE (c), ls.* EXCLUDE (symbol, timeframe, open_time, c) FROM fs JOIN ls USING (symbol, timeframe, open_time)
WHERE (symbol, timeframe, open_time) NOT IN (SELECT (symbol, timeframe, open_time) FROM kf WHERE fault = 'DUPLICATE_KEY')""", [*_tf, *RET], special={"dollar_volume": 3})
