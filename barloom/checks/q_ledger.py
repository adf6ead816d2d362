"""Queries from predictions to performance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import ledger, performance, signals, verify
from barloom.operators.factors import CATALOG, factor_frame

from . import tables
from .factor_sql import SERIES, z
from .q_data import verify_sql
from .registry import add
from .sql import BARS_1D

PRED_SQL = f"""{BARS_1D},
predictions AS MATERIALIZED (SELECT symbol, timeframe, open_time, 'm' AS model_name, '1' AS model_version, p AS prediction
  FROM (SELECT *, {z('close', 20)} AS p FROM bars) WHERE p IS NOT NULL)"""


@tables.staged
def predictions(s, d):
    wide = factor_frame(tables.bars_1d(s, d), [CATALOG["price_zscore"]])
    return wide.filter(F.col("price_zscore").isNotNull()).select(
        "symbol", "timeframe", "open_time", F.lit("m").alias("model_name"), F.lit("1").alias("model_version"),
        F.col("price_zscore").alias("prediction"))


add("prediction_table", predictions, f"WITH {PRED_SQL} SELECT * FROM predictions", ["prediction"])
SIGNAL = "CASE WHEN prediction >= 1.0 THEN 'BUY' WHEN prediction <= -1.0 THEN 'SELL' ELSE 'HOLD' END AS signal"
PORT_SQL = f"""{PRED_SQL},
signals AS MATERIALIZED (SELECT * EXCLUDE (prediction), {SIGNAL} FROM predictions),
portfolio AS MATERIALIZED (SELECT *, 'equal_weight' AS optimizer, CASE signal WHEN 'BUY' THEN 1.0 / count(*) FILTER (signal = 'BUY') OVER g
  WHEN 'SELL' THEN -1.0 / count(*) FILTER (signal = 'SELL') OVER g ELSE 0.0 END AS target_weight FROM signals WINDOW g AS (PARTITION BY timeframe, open_time))"""


def signal_rows(s, d):
    return signals.threshold_signals(predictions(s, d), 1.0, -1.0)


def portfolio(s, d):
    return ledger.equal_weight_portfolio(signal_rows(s, d), ("timeframe", "open_time"))


add("threshold_signals", signal_rows, f"WITH {PORT_SQL} SELECT * FROM signals")
add("class_signals",
    lambda s, d: signals.class_signals(predictions(s, d).withColumn("prediction", F.signum("prediction")), 1.0, -1.0),
    f"""WITH {PRED_SQL} SELECT * EXCLUDE (prediction), CASE sign(prediction) WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'HOLD' END AS signal FROM predictions""")
add("equal_weight_portfolio", portfolio, f"WITH {PORT_SQL} SELECT * FROM portfolio", ["target_weight"])
add("equal_weight_by_series", lambda s, d: ledger.equal_weight_portfolio(signal_rows(s, d)), f"""WITH {PORT_SQL}
SELECT *, 'equal_weight' AS optimizer, CASE signal WHEN 'BUY' THEN 1.0 / count(*) FILTER (signal = 'BUY') OVER g
  WHEN 'SELL' THEN -1.0 / count(*) FILTER (signal = 'SELL') OVER g ELSE 0.0 END AS target_weight FROM signals WINDOW g AS (PARTITION BY symbol, timeframe)""",
    ["target_weight"], digits=9)
RISK_SQL = f"{PORT_SQL}, risk AS (SELECT *, 'pass_through' AS policy, target_weight AS approved_weight, 'APPROVE' AS decision, 'approved' AS reason FROM portfolio)"
add("risk_decisions", lambda s, d: ledger.risk_decisions(portfolio(s, d)), f"WITH {RISK_SQL} SELECT * FROM risk", ["target_weight", "approved_weight"])


def order_rows(s, d):
    return ledger.orders(ledger.risk_decisions(portfolio(s, d)))


ORDER_SQL = f"""{RISK_SQL}, orders_made AS (SELECT symbol, timeframe, open_time, model_name, model_version, optimizer, policy, signal,
  sha256(concat_ws('|', symbol, timeframe, open_time, model_name, model_version, optimizer, policy)) AS order_id, CAST(NULL AS VARCHAR) AS parent_order_id,
  CASE WHEN approved_weight > 0 THEN 'BUY' ELSE 'SELL' END AS side, 'MARKET' AS order_type, abs(approved_weight) AS quantity, CAST(NULL AS DOUBLE) AS limit_price,
  CAST(NULL AS DOUBLE) AS stop_price, CAST(0 AS DOUBLE) AS filled_quantity, 'PENDING' AS status, open_time AS created_at, open_time AS updated_at FROM risk WHERE approved_weight <> 0)"""
add("orders", order_rows, f"WITH {ORDER_SQL} SELECT * FROM orders_made", ["quantity", "limit_price", "stop_price", "filled_quantity"])
add("executions", lambda s, d: ledger.executions(order_rows(s, d), tables.bars_1d(s, d)), f"""WITH {ORDER_SQL}
SELECT o.symbol, o.timeframe, o.open_time, order_id, model_name, model_version, optimizer, policy, signal, side, order_type, quantity AS requested_quantity,
  quantity AS executed_quantity, limit_price AS requested_price, b.close AS executed_price, CAST(0 AS DOUBLE) AS fees, CAST(0 AS DOUBLE) AS slippage, 'FILLED' AS status,
  o.open_time AS execution_time FROM orders_made o JOIN bars b USING (symbol, timeframe, open_time)""",
    ["requested_quantity", "executed_quantity", "requested_price", "executed_price", "fees", "slippage"])
add("verify_portfolios", lambda s, d: verify.verify(portfolio(s, d), verify.catalog()["portfolios"]),
    f"WITH {PORT_SQL} " + verify_sql("portfolio", "symbol, timeframe, open_time", {
        n: "false" for n in ("null_rows", "nan_rows", "infinite_rows", "invalid_time_rows", "empty_text_rows", "unknown_signal",
                             "weight_range_rows", "weight_sign_rows")}))
add("verify_orders", lambda s, d: verify.verify(order_rows(s, d), verify.catalog()["orders"]),
    f"WITH {ORDER_SQL} " + verify_sql("orders_made", "order_id", {
        n: "false" for n in ("null_rows", "nan_rows", "infinite_rows", "invalid_time_rows", "empty_text_rows", "unknown_side",
                             "unknown_order_type", "unknown_status", "quantity_rows")}))

# -- positions: every series trades in cycles of two buys and two sells ------------------------------


def trades(s, d):
    t = F.row_number().over(Window.partitionBy("symbol", "timeframe", "year").orderBy("open_time"))
    step = (F.col("_t") % 4).cast("int")
    # Keys of the ledger are series; years are kept apart by a suffix so that no cycle crosses them.
    return tables.bars_1d(s, d).withColumn("_t", t).select(
        F.concat_ws("/", "symbol", "year").alias("symbol"), "timeframe",
        F.when(step.isin(1, 2), "BUY").otherwise("SELL").alias("side"),
        F.when(step == 1, 3.0).when(step == 2, 1.0).otherwise(2.0).alias("executed_quantity"),
        F.col("close").alias("executed_price"), F.lit(0.5).alias("fees"), F.col("open_time").alias("execution_time"),
        F.lit("m").alias("model_name"), F.lit("1").alias("model_version"), F.lit("equal_weight").alias("optimizer"), F.lit("p").alias("policy"))


add("positions", lambda s, d: ledger.positions(trades(s, d)), f"""WITH {BARS_1D},
n AS (SELECT symbol || '/' || year AS symbol, timeframe, open_time, close, row_number() OVER ({SERIES}) AS t FROM bars),
c AS (SELECT symbol, timeframe, (t - 1) // 4 AS cyc, count(*) AS k, min(open_time) AS opened_at, max(open_time) AS updated_at, arg_max(close, t) AS market_price,
  max(close) FILTER (t % 4 = 1) AS p1, max(close) FILTER (t % 4 = 2) AS p2, max(close) FILTER (t % 4 = 3) AS p3, max(close) FILTER (t % 4 = 0) AS p4 FROM n GROUP BY ALL),
v AS (SELECT *, CASE WHEN k = 1 THEN p1 ELSE (p1 * 3 + p2) / 4 END AS avgp, CASE k WHEN 1 THEN 3.0 WHEN 2 THEN 4.0 WHEN 3 THEN 2.0 ELSE 0.0 END AS quantity FROM c)
SELECT symbol, timeframe, printf('pos-%08d', row_number() OVER (ORDER BY opened_at, symbol, timeframe)) AS position_id, 'LONG' AS side,
  CASE WHEN k = 4 THEN 'CLOSED' ELSE 'OPEN' END AS status, CAST(quantity AS DOUBLE) AS quantity, avgp AS average_entry_price, market_price,
  CASE WHEN k < 3 THEN 0 WHEN k = 3 THEN (p3 - avgp) * 2 ELSE (p3 - avgp) * 2 + (p4 - avgp) * 2 END AS realized_pnl, (market_price - avgp) * quantity AS unrealized_pnl,
  k * 0.5 AS fees_paid, opened_at, updated_at, CASE WHEN k = 4 THEN updated_at END AS closed_at, 'm' AS model_name, '1' AS model_version,
  'equal_weight' AS optimizer, 'p' AS policy FROM v""",
    ["quantity", "average_entry_price", "market_price", "realized_pnl", "unrealized_pnl", "fees_paid"])

# -- snapshots: one long position per brand and year, marked at every bar ----------------------------
CASH, EXPOSURE = 1000.0, 0.6


def marks(s, d):
    year = Window.partitionBy("symbol", "timeframe", "year").orderBy("open_time")
    first = F.first("close").over(year.rowsBetween(Window.unboundedPreceding, 0))
    last = F.lead("open_time").over(year).isNull()
    return tables.bars_1d(s, d).select(
        "symbol", "timeframe", F.concat_ws("-", "symbol", "year").alias("position_id"), F.lit("LONG").alias("side"),
        F.when(last, "CLOSED").otherwise("OPEN").alias("status"), F.lit(1.0).alias("quantity"), first.alias("average_entry_price"),
        F.col("close").alias("market_price"), ((F.col("close") - first) / 10).alias("realized_pnl"),
        F.col("open_time").alias("opened_at"), F.col("open_time").alias("updated_at"), F.when(last, F.col("open_time")).alias("closed_at"))


@tables.staged
def account(s, d):
    return ledger.accounting(marks(s, d), CASH, ("symbol", "timeframe", "opened_at"))


@tables.staged
def risk(s, d):
    return ledger.portfolio_risk(account(s, d), exposure_limit=EXPOSURE)


def prices(s, d):
    return tables.bars_1d(s, d).withColumn("price", F.col("close"))


@tables.staged
def management(s, d):
    return ledger.trade_management(account(s, d), risk(s, d), prices(s, d))


@tables.staged
def pyramid(s, d):
    return ledger.pyramiding(account(s, d), marks(s, d), prices(s, d), risk(s, d), management(s, d))


@tables.staged
def exit_rows(s, d):
    return ledger.exits(account(s, d), marks(s, d), risk(s, d), management(s, d), pyramid(s, d))


@tables.staged
def backtest_rows(s, d):
    trades_done = performance.completed_trades(marks(s, d), exit_rows(s, d), account(s, d))
    return performance.backtest(account(s, d), exit_rows(s, d), trades_done)


ACC_SQL = f"""{BARS_1D},
mk AS (SELECT symbol, timeframe, symbol || '-' || year AS position_id, open_time, close, high, first_value(close) OVER ({SERIES}) AS entry,
  lead(open_time) OVER ({SERIES}) IS NULL AS is_last FROM bars),
account AS MATERIALIZED (SELECT symbol, timeframe, open_time, position_id, CASE WHEN is_last THEN 'CLOSED' ELSE 'OPEN' END AS position_status, CAST(1.0 AS DOUBLE) AS quantity,
  entry AS average_entry_price, close AS mark_price, close AS position_value, close AS market_value, CAST({CASH} AS DOUBLE) AS cash, (close - entry) / 10 AS realized_pnl,
  close - entry AS unrealized_pnl, (close - entry) / 10 + (close - entry) AS total_pnl, close AS gross_exposure, close AS net_exposure, {CASH} + close AS equity,
  ((close - entry) / 10 + (close - entry)) / ({CASH} + close) AS return_pct FROM mk)"""
ACC_DOUBLES = ["quantity", "average_entry_price", "mark_price", "position_value", "market_value", "cash", "realized_pnl", "unrealized_pnl", "total_pnl",
               "gross_exposure", "net_exposure", "equity", "return_pct"]
add("accounting", account, f"WITH {ACC_SQL} SELECT * FROM account", ACC_DOUBLES)
RISKS_SQL = f"""{ACC_SQL},
rn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS t, total_pnl <= -0.02 * equity AS loss,
  max(equity) OVER (PARTITION BY symbol ORDER BY open_time) AS peak FROM account),
rw AS (SELECT symbol, t, CASE WHEN loss THEN 'DAILY_LOSS_LIMIT' END AS halt, CASE WHEN loss THEN open_time + 86400000 END AS until FROM rn WHERE t = 1
  UNION ALL SELECT n.symbol, n.t, CASE WHEN w.until > n.open_time THEN 'COOLDOWN' WHEN n.loss THEN 'DAILY_LOSS_LIMIT' END,
    CASE WHEN w.until > n.open_time THEN w.until WHEN n.loss THEN n.open_time + 86400000 END FROM rw w JOIN rn n ON n.symbol = w.symbol AND n.t = w.t + 1),
risks AS MATERIALIZED (SELECT symbol, timeframe, open_time, position_id, equity, gross_exposure, net_exposure, realized_pnl AS daily_realized_pnl, unrealized_pnl AS daily_unrealized_pnl,
  total_pnl AS daily_total_pnl, return_pct AS daily_return_pct, (peak - equity) / peak AS daily_drawdown_pct,
  CASE WHEN halt IS NOT NULL THEN 'SHUTDOWN' WHEN gross_exposure / equity > {EXPOSURE} THEN 'WARNING' ELSE 'NORMAL' END AS portfolio_risk_state,
  halt IS NULL AND gross_exposure / equity <= {EXPOSURE} AS allow_new_entries,
  CASE WHEN halt IS NOT NULL THEN halt WHEN gross_exposure / equity > {EXPOSURE} THEN 'EXPOSURE_LIMIT' ELSE '' END AS shutdown_reason, until AS cooldown_until
  FROM rn JOIN rw USING (symbol, t))"""
RISK_DOUBLES = ["equity", "gross_exposure", "net_exposure", "daily_realized_pnl", "daily_unrealized_pnl", "daily_total_pnl", "daily_return_pct", "daily_drawdown_pct"]
add("portfolio_risk", risk, f"WITH RECURSIVE {RISKS_SQL} SELECT * FROM risks", RISK_DOUBLES)
TM_SQL = f"""{RISKS_SQL},
tr AS (SELECT a.*, r.portfolio_risk_state AS risk_state, max(mark_price) OVER p AS hi, min(mark_price) OVER p AS lo,
  mark_price - average_entry_price >= average_entry_price * 0.05 AS even, mark_price <= max(mark_price) OVER p * 0.95 AS stop
  FROM account a JOIN risks r USING (symbol, timeframe, open_time, position_id) WHERE position_status = 'OPEN' WINDOW p AS (PARTITION BY a.position_id ORDER BY a.open_time)),
tm AS MATERIALIZED (SELECT symbol, timeframe, open_time, position_id, position_status, quantity, average_entry_price AS entry_price, mark_price AS current_price, hi AS highest_price,
  lo AS lowest_price, unrealized_pnl, risk_state, CASE WHEN stop OR even THEN 'UPDATE_STOP' ELSE 'NONE' END AS management_action,
  CASE WHEN stop THEN 'TRAILING_STOP' WHEN even THEN 'BREAKEVEN' ELSE 'NONE' END AS action_reason, CASE WHEN stop THEN hi * 0.95 WHEN even THEN average_entry_price END AS stop_price,
  CAST(NULL AS DOUBLE) AS take_profit_price, hi * 0.95 AS trail_price, CASE WHEN even THEN average_entry_price END AS breakeven_price, false AS allow_pyramid,
  CAST(0 AS DOUBLE) AS exit_quantity FROM tr)"""
add("trade_management", management, f"WITH RECURSIVE {TM_SQL} SELECT * FROM tm",
    ["quantity", "entry_price", "current_price", "highest_price", "lowest_price", "unrealized_pnl", "stop_price", "take_profit_price", "trail_price",
     "breakeven_price", "exit_quantity"])
PY_SQL = f"""{TM_SQL},
pj AS MATERIALIZED (SELECT a.symbol, a.timeframe, a.open_time, a.position_id, average_entry_price AS entry_price, a.mark_price AS current_price,
  max(greatest(m.high, m.close)) OVER (PARTITION BY a.position_id ORDER BY a.open_time) AS highest_price, (a.mark_price - average_entry_price) / average_entry_price AS profit_pct,
  CASE WHEN a.position_status <> 'OPEN' THEN 'NOT_ELIGIBLE' WHEN r.portfolio_risk_state = 'SHUTDOWN' AND r.shutdown_reason <> 'COOLDOWN' THEN 'PORTFOLIO_SHUTDOWN'
    WHEN r.shutdown_reason = 'COOLDOWN' THEN 'COOLDOWN_ACTIVE' WHEN r.portfolio_risk_state = 'WARNING' THEN 'PORTFOLIO_WARNING'
    WHEN t.action_reason = 'TRAILING_STOP' THEN 'TRAILING_STOP_ACTIVE' WHEN t.action_reason = 'BREAKEVEN' THEN 'BREAKEVEN_ACTIVE' END AS barred,
  row_number() OVER (PARTITION BY a.position_id ORDER BY a.open_time) AS t
  FROM account a JOIN (SELECT symbol, open_time, high, close FROM mk) m USING (symbol, open_time) JOIN risks r USING (symbol, timeframe, open_time, position_id) LEFT JOIN tm t USING (symbol, timeframe, open_time, position_id)),
pw AS (SELECT position_id, 0 AS t, 1.0::DOUBLE AS after_size, 0 AS after_adds, NULL::VARCHAR AS why, 1.0::DOUBLE AS size_before FROM pj WHERE t = 1
  UNION ALL SELECT p.position_id, p.t, CASE WHEN q.why = 'READY_TO_ADD' THEN w.after_size * 1.5 ELSE w.after_size END,
    w.after_adds + CASE WHEN q.why = 'READY_TO_ADD' THEN 1 ELSE 0 END, q.why, w.after_size
  FROM pw w JOIN pj p ON p.position_id = w.position_id AND p.t = w.t + 1,
  LATERAL (SELECT coalesce(p.barred, CASE WHEN w.after_adds >= 3 THEN 'MAX_ADDS_REACHED' WHEN p.profit_pct + 1e-12 < (w.after_adds + 1) * 0.05 THEN 'INSUFFICIENT_PROFIT'
    ELSE 'READY_TO_ADD' END) AS why) q),
pyr AS MATERIALIZED (SELECT symbol, timeframe, open_time, position_id, position_id AS trade_id, entry_price, current_price, highest_price, profit_pct, size_before AS position_size,
  after_adds AS add_number, after_size - size_before AS additional_size, after_size AS recommended_size, why = 'READY_TO_ADD' AS allow_pyramid, why AS reason, 3 AS max_adds
  FROM pj JOIN pw USING (position_id, t))"""
add("pyramiding", pyramid, f"WITH RECURSIVE {PY_SQL} SELECT * FROM pyr",
    ["entry_price", "current_price", "highest_price", "profit_pct", "position_size", "additional_size", "recommended_size"])
EXIT_SQL = f"""{PY_SQL},
ex0 AS (SELECT a.symbol, a.timeframe, a.open_time, a.position_id, a.average_entry_price AS entry_price, t.current_price, a.quantity,
  (t.current_price - a.average_entry_price) / (a.average_entry_price * 0.05) AS risk_reward_ratio, r.portfolio_risk_state AS risk_state, t.management_action AS trade_state, y.reason AS pyramid_state,
  CASE WHEN r.portfolio_risk_state = 'SHUTDOWN' AND r.shutdown_reason <> 'COOLDOWN' THEN 'PORTFOLIO_SHUTDOWN' WHEN r.shutdown_reason = 'COOLDOWN' THEN 'COOLDOWN'
    WHEN t.action_reason = 'TRAILING_STOP' THEN 'TRAILING_STOP' WHEN t.action_reason = 'BREAKEVEN' THEN 'BREAK_EVEN'
    WHEN (t.current_price - a.average_entry_price) / (a.average_entry_price * 0.05) >= 3 THEN 'TAKE_PROFIT' ELSE 'NONE' END AS exit_reason
  FROM account a JOIN risks r USING (symbol, timeframe, open_time, position_id) JOIN tm t USING (symbol, timeframe, open_time, position_id)
  JOIN pyr y USING (symbol, timeframe, open_time, position_id)),
exits AS MATERIALIZED (SELECT *, CASE WHEN exit_reason IN ('NONE', 'COOLDOWN') THEN 'HOLD' WHEN exit_reason = 'TAKE_PROFIT' THEN 'PARTIAL_EXIT' ELSE 'FULL_EXIT' END AS exit_action,
  CASE WHEN exit_reason IN ('NONE', 'COOLDOWN') THEN 0.0 WHEN exit_reason = 'TAKE_PROFIT' THEN 0.5 ELSE 1.0 END AS recommended_percent,
  quantity * CASE WHEN exit_reason IN ('NONE', 'COOLDOWN') THEN 0.0 WHEN exit_reason = 'TAKE_PROFIT' THEN 0.5 ELSE 1.0 END AS recommended_quantity,
  CASE exit_reason WHEN 'PORTFOLIO_SHUTDOWN' THEN 1 WHEN 'COOLDOWN' THEN 2 WHEN 'TRAILING_STOP' THEN 3 WHEN 'BREAK_EVEN' THEN 4 WHEN 'TAKE_PROFIT' THEN 5 ELSE 0 END AS priority,
  open_time AS created_at FROM ex0)"""
add("exit_decisions", exit_rows, f"WITH RECURSIVE {EXIT_SQL} SELECT * FROM exits",
    ["entry_price", "current_price", "quantity", "risk_reward_ratio", "recommended_percent", "recommended_quantity"])
BT_SQL = f"""{EXIT_SQL},
done AS MATERIALIZED (SELECT symbol, timeframe, position_id, open_time AS completed_at, realized_pnl FROM account WHERE position_status = 'CLOSED'),
st AS (SELECT a.* FROM account a SEMI JOIN exits e ON e.symbol = a.symbol AND e.open_time = a.open_time),
bt0 AS (SELECT symbol, timeframe, open_time, cash, position_value, realized_pnl, unrealized_pnl, cash + unrealized_pnl AS equity FROM st),
cnt AS (SELECT b.symbol, b.open_time, count(d.position_id) AS trade_count, count(*) FILTER (d.realized_pnl > 0) AS winning_trades, count(*) FILTER (d.realized_pnl < 0) AS losing_trades,
  coalesce(sum(d.realized_pnl) FILTER (d.realized_pnl > 0), 0) AS g, coalesce(-sum(d.realized_pnl) FILTER (d.realized_pnl < 0), 0) AS l
  FROM bt0 b LEFT JOIN done d ON d.symbol = b.symbol AND d.completed_at <= b.open_time GROUP BY ALL),
bt1 AS (SELECT *, greatest(max(equity) OVER w, 0) AS peak_equity FROM bt0 JOIN cnt USING (symbol, open_time) WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
bt2 AS (SELECT *, CASE WHEN peak_equity > 0 THEN (peak_equity - equity) / peak_equity ELSE 0.0 END AS drawdown FROM bt1),
bt AS MATERIALIZED (SELECT symbol, timeframe, open_time, equity, cash, position_value, realized_pnl, unrealized_pnl, realized_pnl + unrealized_pnl AS total_pnl, peak_equity, drawdown,
  coalesce(equity / nullif(lag(equity) OVER w, 0) - 1, 0) AS daily_return, coalesce(equity / nullif(first_value(equity) OVER w, 0) - 1, 0) AS cumulative_return,
  trade_count, winning_trades, losing_trades, coalesce(winning_trades / nullif(trade_count, 0), 0) AS win_rate, g / nullif(l, 0) AS profit_factor,
  CASE WHEN lead(open_time) OVER w IS NULL THEN 'FINISHED' ELSE 'ACTIVE' END AS status, max(drawdown) OVER w AS max_drawdown FROM bt2 WINDOW w AS (PARTITION BY symbol ORDER BY open_time))"""
add("backtest", backtest_rows, f"WITH RECURSIVE {BT_SQL} SELECT * FROM bt",
    ["equity", "cash", "position_value", "realized_pnl", "unrealized_pnl", "total_pnl", "peak_equity", "drawdown", "daily_return", "cumulative_return",
     "win_rate", "profit_factor", "max_drawdown"])
add("completed_trades",
    lambda s, d: performance.completed_trades(marks(s, d), exit_rows(s, d), account(s, d)), f"""WITH RECURSIVE {EXIT_SQL}
SELECT symbol, timeframe, position_id, open_time AS completed_at, realized_pnl FROM account WHERE position_status = 'CLOSED'
UNION ALL SELECT e.symbol, e.timeframe, e.position_id, min(e.open_time), 0.0 FROM exits e WHERE exit_action = 'FULL_EXIT'
  AND position_id NOT IN (SELECT position_id FROM account WHERE position_status = 'CLOSED') GROUP BY ALL""", ["realized_pnl"])
PERF_SQL = f"""{BT_SQL},
f1 AS (SELECT *, row_number() OVER w AS rw, trade_count - coalesce(lag(trade_count) OVER w, 0) AS nw, first_value(equity) OVER w AS e0, first_value(open_time) OVER w AS t0,
  count(*) FILTER (drawdown <= 0) OVER w AS calm FROM bt WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
f2 AS (SELECT *, last_value(CASE WHEN nw > 0 THEN realized_pnl END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base,
  count(*) FILTER (drawdown > 0) OVER (PARTITION BY symbol, calm ORDER BY open_time) AS run, CASE WHEN rw > 1 THEN daily_return END AS smp FROM f1),
f3 AS (SELECT *, CASE WHEN nw > 0 THEN (realized_pnl - coalesce(base, 0)) / nw END AS ea FROM f2),
f4 AS (SELECT *, avg(smp) OVER w AS mu, stddev_samp(smp) OVER w AS sd, sqrt(avg(pow(least(smp, 0), 2)) FILTER (smp IS NOT NULL) OVER w) AS dn, max(run) OVER w AS dur, sum(nw) OVER w AS nt,
  coalesce(sum(nw) FILTER (ea > 0) OVER w, 0) AS wn, coalesce(sum(nw) FILTER (ea < 0) OVER w, 0) AS ls, coalesce(sum(ea * nw) FILTER (ea > 0) OVER w, 0) AS gp,
  coalesce(-sum(ea * nw) FILTER (ea < 0) OVER w, 0) AS gl, min(CASE WHEN nw > 0 THEN open_time END) OVER w AS ft, max(CASE WHEN nw > 0 THEN open_time END) OVER w AS lt,
  (open_time - t0) / 1000.0 AS secs FROM f3 WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
f5 AS (SELECT *, CASE WHEN e0 > 0 AND equity > 0 AND secs > 0 THEN pow(equity / e0, 31536000.0 / secs) - 1 ELSE 0.0 END AS cg, sqrt(CASE WHEN secs > 0 THEN 31536000.0 * (rw - 1) / secs ELSE 365.0 END) AS rt FROM f4),
perf AS (SELECT symbol, timeframe, open_time, CASE WHEN e0 > 0 THEN equity / e0 - 1 ELSE 0.0 END AS total_return, cg AS cagr, coalesce(sd * rt, 0) AS volatility, coalesce(dn * rt, 0) AS downside_volatility,
  max_drawdown, dur AS drawdown_duration, mu / nullif(sd, 0) * rt AS sharpe_ratio, mu / nullif(dn, 0) * rt AS sortino_ratio, cg / nullif(max_drawdown, 0) AS calmar_ratio,
  CAST(nt AS BIGINT) AS total_trades, CAST(wn AS BIGINT) AS winning_trades, CAST(ls AS BIGINT) AS losing_trades, coalesce(wn / nullif(nt, 0), 0) AS win_rate, gp / nullif(wn, 0) AS average_win, -gl / nullif(ls, 0) AS average_loss,
  gp / nullif(gl, 0) AS profit_factor, coalesce((gp - gl) / nullif(nt, 0), 0) AS expectancy, e0 AS starting_equity, equity AS ending_equity, equity - e0 AS net_profit, gp AS gross_profit, gl AS gross_loss,
  ft AS first_trade_time, lt AS last_trade_time, status FROM f5)"""
PERF_DOUBLES = ["total_return", "volatility", "downside_volatility", "max_drawdown", "sharpe_ratio", "sortino_ratio", "win_rate",
                "average_win", "average_loss", "profit_factor", "expectancy", "starting_equity", "ending_equity", "net_profit", "gross_profit", "gross_loss"]


def signed_log(df, *names):
    """Annualised growth over a few days spans many magnitudes, up to overflow; compare its signed logarithm."""
    for n in names:
        df = df.withColumn(n, F.when(F.abs(n) < float("inf"), F.signum(n) * F.ln(1 + F.abs(n))))
    return df


SL = "CASE WHEN isfinite({0}) THEN sign({0}) * ln(1 + abs({0})) END AS {0}"
add("performance", lambda s, d: signed_log(performance.performance(backtest_rows(s, d)), "cagr", "calmar_ratio"),
    f"WITH RECURSIVE {PERF_SQL} SELECT * REPLACE ({SL.format('cagr')}, {SL.format('calmar_ratio')}) FROM perf", [*PERF_DOUBLES, "cagr", "calmar_ratio"])
add("inferred_trades", lambda s, d: performance.inferred_trades(backtest_rows(s, d)),
    f"WITH RECURSIVE {PERF_SQL} SELECT symbol, timeframe, open_time AS completed_at, ea AS realized_pnl FROM f3, LATERAL (SELECT unnest(range(nw)) AS i) WHERE nw > 0",
    ["realized_pnl"])
add("analytics", lambda s, d: signed_log(performance.analytics(performance.performance(backtest_rows(s, d))), "rolling_cagr", "rolling_calmar"),
    f"""WITH RECURSIVE {PERF_SQL} SELECT symbol, timeframe, open_time, total_return AS rolling_return, volatility AS rolling_volatility, sharpe_ratio AS rolling_sharpe,
  sortino_ratio AS rolling_sortino, max_drawdown AS rolling_max_drawdown, win_rate AS rolling_win_rate, profit_factor AS rolling_profit_factor, expectancy AS rolling_expectancy,
  CASE WHEN isfinite(cagr) THEN sign(cagr) * ln(1 + abs(cagr)) END AS rolling_cagr, CASE WHEN isfinite(calmar_ratio) THEN sign(calmar_ratio) * ln(1 + abs(calmar_ratio)) END AS rolling_calmar, net_profit / nullif(max_drawdown, 0) AS rolling_recovery_factor,
  {', '.join(f'CAST(0 AS DOUBLE) AS benchmark_{b}' for b in ('return', 'alpha', 'beta', 'correlation', 'tracking_error', 'information_ratio'))}, status FROM perf""",
    ["rolling_return", "rolling_volatility", "rolling_sharpe", "rolling_sortino", "rolling_max_drawdown", "rolling_win_rate", "rolling_profit_factor", "rolling_expectancy",
     "rolling_cagr", "rolling_calmar", "rolling_recovery_factor", "benchmark_return", "benchmark_alpha", "benchmark_beta", "benchmark_correlation",
     "benchmark_tracking_error", "benchmark_information_ratio"])
