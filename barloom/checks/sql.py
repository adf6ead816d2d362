"""DuckDB views of the driver's tables, as common table expressions."""

from __future__ import annotations

TRADES = """
trades AS MATERIALIZED (
  SELECT p.p_brand AS symbol, CAST(floor(epoch_ms(l_shipdate) / 86400000) AS BIGINT) * 86400000 AS day,
         l_extendedprice / l_quantity AS price, p.p_retailprice, l.*
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

BARS_1D = TRADES + """,
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_extendedprice, l_quantity) AS rn,
    row_number() OVER (PARTITION BY symbol, day ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC,
    l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rd FROM trades),
bars AS MATERIALIZED (
  SELECT symbol, '1d' AS timeframe, day AS open_time, day + 86399999 AS close_time,
    max(price) FILTER (rn = 1) AS open, max(price) AS high, min(price) AS low, max(price) FILTER (rd = 1) AS close,
    sum(l_quantity) AS volume, sum(l_extendedprice) AS quote_volume, count(*) AS trade_count,
    year(make_timestamp_ms(day)) AS year,
    avg(p_retailprice) AS index_price, sum(l_extendedprice) / sum(l_quantity) AS vwap,
    (avg(price) - avg(p_retailprice)) / avg(p_retailprice) AS premium_index,
    CAST(count(*) FILTER (l_linestatus = 'O') AS DOUBLE) AS buy_trade_count,
    CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) AS sell_trade_count,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'R' AND l_linestatus = 'O'), 0.0) AS long_liquidation_volume,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'R' AND l_linestatus = 'F'), 0.0) AS short_liquidation_volume,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0.0) AS total_liquidation_volume
  FROM ranked GROUP BY symbol, day)"""

BARS_1H = """
hourly AS MATERIALIZED (
  SELECT event_type AS symbol, CAST(floor(epoch_ms(ts) / 3600000) AS BIGINT) * 3600000 AS open_time, ts, value
  FROM events),
bars AS MATERIALIZED (
  SELECT symbol, '1h' AS timeframe, open_time, open_time + 3599999 AS close_time,
    arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
    CAST(count(*) AS DOUBLE) AS volume, sum(value) AS quote_volume, count(*) AS trade_count,
    year(make_timestamp_ms(open_time)) AS year
  FROM hourly GROUP BY symbol, open_time)"""

DIRTY_1H = BARS_1H + """,
dirty AS (
  SELECT symbol, timeframe, open_time, close_time, open,
    CASE WHEN (open_time // 3600000) % 89 = 0 THEN low - 1 ELSE high END AS high, low,
    CASE WHEN (open_time // 3600000) % 79 = 0 THEN NULL ELSE close END AS close,
    CASE WHEN (open_time // 3600000) % 83 = 0 THEN -1.0 ELSE volume END AS volume,
    quote_volume, trade_count, year
  FROM bars, (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR (open_time // 3600000) % 97 = 0)"""

COMPANIONS = """,
weekly AS MATERIALIZED (SELECT *, CAST(floor((day - 345600000) / 604800000) AS BIGINT) * 604800000 + 345600000 AS week FROM trades),
funding AS (SELECT symbol, week + 500 AS funding_time, avg(l_tax) - avg(l_discount) AS funding_rate,
  avg(price) AS mark_price FROM weekly GROUP BY symbol, week),
oi AS (SELECT symbol, week AS "timestamp", sum(l_quantity) AS open_interest FROM weekly GROUP BY symbol, week),
taker AS (SELECT symbol, week AS "timestamp", coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0.0) AS buy_volume,
  coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0.0) AS sell_volume FROM weekly GROUP BY symbol, week),
ls AS (SELECT symbol, "timestamp", long_account, short_account,
    CASE WHEN short_account <> 0 THEN long_account / short_account END AS long_short_ratio
  FROM (SELECT symbol, week AS "timestamp", count(*) FILTER (l_returnflag = 'A') / count(*) AS long_account,
    count(*) FILTER (l_returnflag = 'R') / count(*) AS short_account FROM weekly GROUP BY symbol, week))"""


def _asof(floor_ms: str, names: str) -> str:
    # Companion rows serve bars of their own calendar year only.
    def part(alias: str, time: str) -> str:
        return (
            f"ASOF LEFT JOIN (SELECT *, year(make_timestamp_ms({time})) AS cy, {time} AS ct FROM {alias}) {alias}"
            f" ON b.symbol = {alias}.symbol AND b.year = {alias}.cy AND b.open_time >= {alias}.ct"
        )

    joins = "\n".join([part("funding", floor_ms), part("oi", '"timestamp"'), part("taker", '"timestamp"'),
                       part("ls", '"timestamp"')])
    return f"""
  SELECT b.*, {names}
  FROM bars b
  {joins}"""


INPUTS_1D = BARS_1D + COMPANIONS + ",\ninputs AS MATERIALIZED (" + _asof(
    "funding_time // 1000 * 1000",
    "funding_rate, mark_price, open_interest, buy_volume AS taker_buy_volume, sell_volume AS taker_sell_volume,"
    " long_short_ratio",
) + ")"

FEATURE_INPUTS_1D = BARS_1D + COMPANIONS + ",\nuntrimmed AS MATERIALIZED (" + _asof(
    "funding_time", "funding_rate, open_interest, buy_volume, sell_volume, long_short_ratio"
) + """),
inputs AS MATERIALIZED (
  SELECT * EXCLUDE (seen) FROM (
    SELECT *, max(CASE WHEN funding_rate IS NOT NULL AND open_interest IS NOT NULL AND buy_volume IS NOT NULL
      AND sell_volume IS NOT NULL AND long_short_ratio IS NOT NULL THEN 1 ELSE 0 END)
      OVER (PARTITION BY symbol, timeframe, year ORDER BY open_time) AS seen FROM untrimmed) WHERE seen = 1)"""

RETURNS_1D = BARS_1D + """,
own AS MATERIALIZED (SELECT *, close / lag(close) OVER (PARTITION BY symbol, timeframe, year ORDER BY open_time) - 1 AS asset_return
  FROM bars),
market AS (SELECT open_time, max(asset_return) FILTER (symbol = 'Brand#1') AS btc_return,
  max(asset_return) FILTER (symbol = 'Brand#2') AS eth_return, avg(asset_return) AS benchmark_return
  FROM own GROUP BY open_time),
inputs AS MATERIALIZED (SELECT own.*, btc_return, eth_return, benchmark_return FROM own JOIN market USING (open_time))"""
