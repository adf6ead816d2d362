"""Verification queries of the stage tables: every stage's rows satisfy its rule list."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import performance, selection, verify
from barloom.operators.combination import alpha_scores
from barloom.operators.features import feature_frame
from barloom.operators.folds import purged_folds
from barloom.operators.labels import label_frame
from barloom.operators.ledger import executions, positions, risk_decisions

from . import q_folds, q_ledger, q_panel, q_research, tables
from .factor_sql import FEATURE_SQL, SERIES, staged
from .q_data import FEATURE_INPUTS_1D, FEATURE_NAMES, LABELS, RET, verify_sql
from .registry import ORACLES, add
from .sql import BARS_1D


def names(time: bool = True, finite: bool = True, filled: bool = True, members=(), rules=()) -> dict[str, str]:
    """Checks of a dataset, none of which may fail."""
    out = ["null_rows", "nan_rows"] + (["infinite_rows"] if finite else []) + (["invalid_time_rows"] if time else [])
    out += (["empty_text_rows"] if filled else []) + [f"unknown_{m}" for m in members] + list(rules)
    return {n: "false" for n in out}


def check(dataset: str, source, cte: str, table: str, keys: str, tests: dict[str, str]) -> None:
    def run(s, d):
        return verify.verify(source(s, d), verify.catalog()[dataset])

    add(f"verify_{dataset}", run, f"WITH RECURSIVE {cte} " + verify_sql(table, keys, tests))


BAR, SNAP = "symbol, timeframe, open_time", "symbol, timeframe, open_time, position_id"
L, P = q_ledger, q_panel
check("labels", lambda s, d: q_research.label_frame(tables.bars_1d(s, d)), f"{BARS_1D}, {LABELS}", "labels_1d", BAR,
      names(filled=False, rules=["direction_rows"]))
check("predictions", L.predictions, L.PRED_SQL, "predictions", BAR, names())
check("signals", L.signal_rows, L.PORT_SQL, "signals", BAR, names(members=["signal"]))
check("risk", lambda s, d: risk_decisions(L.portfolio(s, d)), L.RISK_SQL, "risk", BAR, names(members=["decision"], rules=["weight_range_rows"]))
check("executions", lambda s, d: executions(L.order_rows(s, d), tables.bars_1d(s, d)), L.ORDER_SQL, "orders_made", "order_id",
      names(members=["side"], rules=["quantity_rows", "price_rows"]))
check("accounting", L.account, L.ACC_SQL, "account", SNAP, names(members=["position_status"]))
check("portfolio_risk", L.risk, L.RISKS_SQL, "risks", SNAP, names(members=["portfolio_risk_state"], rules=["cooldown_rows", "entry_rows"]))
check("trade_management", L.management, L.TM_SQL, "tm", SNAP, names(members=["management_action", "action_reason"], rules=["price_rows"]))
check("pyramiding", L.pyramid, L.PY_SQL, "pyr", SNAP, names(rules=["negative_size_rows", "add_rows"]))
check("exit_engine", L.exit_rows, L.EXIT_SQL, "exits", SNAP, names(members=["exit_action"], rules=["percent_rows", "quantity_rows"]))
check("backtesting", L.backtest_rows, L.BT_SQL, "bt", BAR, names(members=["status"], rules=["peak_rows", "trade_rows"]))
check("performance", lambda s, d: performance.performance(L.backtest_rows(s, d)), L.PERF_SQL, "perf", BAR, names(members=["status"]))
check("analytics", lambda s, d: performance.analytics(performance.performance(L.backtest_rows(s, d))), L.PERF_SQL, "perf", BAR, names(members=["status"]))
check("factor_validation", P.validated, P.VAL, "val", "factor_name, factor_version, timeframe", names(members=["status"]))
check("factor_selection", P.selected, P.SELECT_SQL, "selection", "factor_name, factor_version, timeframe", names(time=False, rules=["rank_rows"]))
check("timeframe_analysis", lambda s, d: selection.timeframe_analysis(P.selected(s, d)).withColumn("timeframe", F.col("best_timeframe")), P.TFA_SQL,
      "analysis", "factor_name, factor_version", names(time=False, rules=["selected_rows"]))
check("combinations", P.combos, P.COMBO_SQL, "combos", "combination_id", names(time=False, rules=["size_rows"]))
check("orthogonalization", P.orthogonal, P.COMBO_SQL, "combos", "combination_id", names(time=False))
check("alpha", lambda s, d: alpha_scores(P.orthogonal(s, d), P.factor_panel(s, d)),
      P.ORTH_SQL + ", al AS (SELECT sig.* FROM sig JOIN orth USING (combination_id) WHERE selected)", "al", "combination_id, symbol, timeframe, open_time", names())
check("walk_forward", q_folds.walk, q_folds.ORDERED, "walk", "timeframe, fold", names(time=False, rules=["time_rows"]))
check("purged_cv", lambda s, d: purged_folds(q_folds.members(s, d)),
      q_folds.PURGED + ", pf AS (SELECT DISTINCT timeframe, purged_fold FROM member)", "pf", "timeframe, purged_fold", names(time=False, rules=["time_rows"]))
# Null values are allowed in the panel; NaN and infinite ones are not.
check("factors", P.factor_panel, P.PANEL_SQL, "long", "symbol, timeframe, open_time, factor_name, factor_version", names())


def _positions(s, d):
    return verify.verify(positions(L.trades(s, d)), verify.catalog()["positions"])


add("verify_positions", _positions)


# -- damaged feature and training tables ---------------------------------------------------------------
DAY = "(open_time // 86400000)"


def _broken(table):
    """Every 7th day a NaN, every 11th an infinity, every 13th the row twice, every 17th a time before the epoch."""
    day = F.floor(F.col("open_time") / 86_400_000)
    changed = table.withColumns({
        "returns": F.when(day % 7 == 0, F.lit(float("nan"))).otherwise(F.col("returns")), "atr": F.when(day % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("atr")),
        "open_time": F.when(day % 17 == 0, -F.col("open_time")).otherwise(F.col("open_time")),
        "_copy": F.explode(F.when(day % 13 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))})
    return changed.drop("_copy")


FEATS_SQL = f"""feats AS (SELECT * EXCLUDE (place) FROM ({staged('inputs', [], {**FEATURE_SQL, 'place': f'row_number() OVER ({SERIES})'}, 'symbol, timeframe, open_time')}) WHERE place > 20)"""


def broken_sql(source: str) -> str:
    return f"""{FEATS_SQL}, broken AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {DAY} % 7 = 0 THEN 'nan'::DOUBLE ELSE returns END AS returns,
  CASE WHEN {DAY} % 11 = 0 THEN '-inf'::DOUBLE ELSE atr END AS atr, CASE WHEN {DAY} % 17 = 0 THEN -open_time ELSE open_time END AS open_time),
  unnest(CASE WHEN {DAY} % 13 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM {source})"""


def any_sql(test: str, columns) -> str:
    return "(" + " OR ".join(f"coalesce({test.format(c)}, false)" for c in columns) + ")"


def broken_tests(numbers, required) -> dict[str, str]:
    return {"null_rows": any_sql("{} IS NULL", required) if required else "false", "nan_rows": any_sql("isnan({})", numbers),
            "infinite_rows": any_sql("isinf({})", numbers), "invalid_time_rows": "open_time <= 0"}


def _features(s, d):
    return feature_frame(tables.feature_inputs_1d(s, d))


def _training(s, d):
    """Features with labels; every 5th day lacks a return."""
    day = F.floor(F.col("open_time") / 86_400_000)
    labels = label_frame(tables.bars_1d(s, d)).withColumn("future_return_5", F.when(day % 5 != 0, F.col("future_return_5")))
    return _features(s, d).join(labels, ["symbol", "timeframe", "open_time"])


add("verify_features", lambda s, d: verify.verify(_broken(_features(s, d)), verify.catalog()["features"]),
    f"WITH {FEATURE_INPUTS_1D}, {broken_sql('feats')} " + verify_sql("broken", BAR, broken_tests(FEATURE_NAMES, ())))
JOINED = f"""(SELECT f.*, l.* EXCLUDE (symbol, timeframe, open_time) REPLACE (CASE WHEN (l.open_time // 86400000) % 5 <> 0 THEN l.future_return_5 END AS future_return_5)
  FROM feats f JOIN labels_1d l USING (symbol, timeframe, open_time))"""
add("verify_training", lambda s, d: verify.verify(_broken(_training(s, d)), verify.catalog()["training"]),
    f"WITH {FEATURE_INPUTS_1D}, {LABELS}, {broken_sql(JOINED)} " + verify_sql("broken", BAR, broken_tests([*FEATURE_NAMES, *RET], RET)))


# -- damaged stage tables: the first row of a table again, broken once for each check -------------------------
NAN, INFINITE = "CAST('NaN' AS DOUBLE)", "CAST('-Infinity' AS DOUBLE)"


def check_damaged(dataset: str, source, cte: str, table: str, keys: str, time: str | None = "open_time", required: str = "", numbers: str = "", filled: str = "",
                  members: dict[str, tuple[str, ...]] | None = None, rules: dict[str, tuple[str, str, str]] | None = None) -> None:
    """``rules``: name -> column, value that breaks the rule, test for broken rows.  Values are written in the SQL of both engines."""
    key, needed, double, text = ([x.strip() for x in part.split(",") if x.strip()] for part in (keys, required, numbers, filled))
    members, rules = members or {}, rules or {}
    broken = {"duplicate_rows": None, "null_rows": ([*needed, *key][0], "NULL")}
    if double:
        broken |= {"nan_rows": (double[0], NAN), "infinite_rows": (double[0], INFINITE)}
    if time:
        broken["invalid_time_rows"] = (time, "0")
    if text:
        broken["empty_text_rows"] = (text[0], "'  '")
    broken |= {f"unknown_{m}": (m, "'?'") for m in members} | {n: (column, value) for n, (column, value, _) in rules.items()}
    cases: dict[str, str] = {}
    for name, change in broken.items():
        if change is not None:
            cases[change[0]] = cases.get(change[0], "") + f" WHEN '{name}' THEN {change[1]}"

    def some(test: str, columns) -> str:
        return "(" + " OR ".join([f"coalesce({test.format(x)}, false)" for x in columns] or ["false"]) + ")"

    tests = {"null_rows": some("{} IS NULL", [*key, *needed]), "nan_rows": some("isnan(CAST({} AS DOUBLE))", double),
             "infinite_rows": some("isinf(CAST({} AS DOUBLE))", double)}
    if time:
        tests["invalid_time_rows"] = f"{time} <= 0"
    if text:
        tests["empty_text_rows"] = some("trim({}) = ''", text)
    tests |= {f"unknown_{m}": f"{m} NOT IN ({', '.join(repr(v) for v in allowed)})" for m, allowed in members.items()} | {n: test for n, (_, _, test) in rules.items()}

    def run(s, d):
        rows = source(s, d)
        types = dict(rows.dtypes)
        one = rows.orderBy(*key).limit(1).withColumn("fault", F.explode(F.array(*[F.lit(n) for n in broken])))
        hurt = one.withColumns({c: F.expr(f"CASE fault{when} ELSE {c} END").cast(types[c]) for c, when in cases.items()}).drop("fault")
        return verify.verify(rows.unionByName(hurt), verify.catalog()[dataset])

    replaced = ", ".join(f"CASE fault{when} ELSE {c} END AS {c}" for c, when in cases.items())
    hurt = f"""hurt AS MATERIALIZED (SELECT * FROM {table} UNION ALL BY NAME SELECT * EXCLUDE (fault) REPLACE ({replaced})
  FROM (SELECT *, unnest([{', '.join(repr(n) for n in broken)}]) AS fault FROM (SELECT * FROM {table} ORDER BY {keys} LIMIT 1)))"""
    add(f"verify_{dataset}_damaged", run, f"WITH RECURSIVE {cte}, {hurt} " + verify_sql("hurt", keys, tests))


def result_of(query: str) -> str:
    return f"result AS MATERIALIZED ({ORACLES[query]})"


MODEL, SNAP_TEXT, SIDES = "model_name, model_version", "symbol, timeframe, position_id", {"side": ("BUY", "SELL")}
ACTIVE, SIGNALS = {"status": ("ACTIVE", "FINISHED")}, {"signal": ("BUY", "SELL", "HOLD")}
DIRECTIONS = ", ".join(f"direction_{h}" for h in (1, 5, 10, 20))
check_damaged("labels", lambda s, d: label_frame(tables.bars_1d(s, d)), f"{BARS_1D}, {LABELS}", "labels_1d", BAR, required=", ".join(RET),
              numbers=f"{', '.join(RET)}, {DIRECTIONS}", rules={"direction_rows": ("direction_1", "2", f"greatest({DIRECTIONS}) > 1")})
check_damaged("predictions", L.predictions, L.PRED_SQL, "predictions", BAR, required=f"prediction, {MODEL}", numbers="prediction", filled=MODEL)
check_damaged("signals", L.signal_rows, L.PORT_SQL, "signals", BAR, required=f"signal, {MODEL}", filled=MODEL, members=SIGNALS)
check_damaged("portfolios", L.portfolio, L.PORT_SQL, "portfolio", BAR, required="signal, target_weight", numbers="target_weight", filled="optimizer", members=SIGNALS, rules={
    "weight_range_rows": ("target_weight", "2.0", "abs(target_weight) > 1"),
    "weight_sign_rows": ("target_weight", "CASE signal WHEN 'BUY' THEN -0.5 ELSE 0.5 END",
                         "(signal = 'BUY' AND target_weight < 0) OR (signal = 'SELL' AND target_weight > 0) OR (signal = 'HOLD' AND target_weight <> 0)")})
check_damaged("risk", lambda s, d: risk_decisions(L.portfolio(s, d)), L.RISK_SQL, "risk", BAR, required="decision, reason", numbers="target_weight, approved_weight",
              filled="decision, reason", members={"decision": ("APPROVE", "RESIZE", "REJECT")}, rules={"weight_range_rows": ("approved_weight", "-2.0", "abs(approved_weight) > 1")})
check_damaged("orders", L.order_rows, L.ORDER_SQL, "orders_made", "order_id", "created_at", "order_id, symbol, timeframe", "quantity", "order_id, symbol, timeframe",
              SIDES | {"order_type": ("MARKET", "LIMIT", "STOP", "STOP_LIMIT"),
                       "status": ("PENDING", "SUBMITTED", "PARTIALLY_FILLED", "FILLED", "CANCELLED", "REJECTED", "EXPIRED")}, {"quantity_rows": ("quantity", "0.0", "quantity <= 0")})
check_damaged("executions", lambda s, d: executions(L.order_rows(s, d), tables.bars_1d(s, d)), result_of("executions"), "result", "order_id", "execution_time",
              "order_id, symbol, timeframe", "executed_quantity, executed_price, fees, slippage", "order_id, symbol, timeframe", SIDES,
              {"quantity_rows": ("executed_quantity", "-1.0", "executed_quantity < 0"), "price_rows": ("executed_price", "-1.0", "executed_price < 0")})
check_damaged("positions", lambda s, d: positions(L.trades(s, d)), result_of("positions"), "result", "position_id", "opened_at", "symbol, timeframe",
              "quantity, average_entry_price, market_price, realized_pnl, unrealized_pnl, fees_paid", "symbol, timeframe", {"side": ("LONG",), "status": ("OPEN", "CLOSED")},
              {"closed_at_rows": ("closed_at", "CASE status WHEN 'OPEN' THEN 1 END", "(status = 'CLOSED') <> (closed_at IS NOT NULL)"), "quantity_rows": ("quantity", "-1.0", "quantity < 0")})
check_damaged("accounting", L.account, L.ACC_SQL, "account", SNAP, required=SNAP_TEXT, filled=SNAP_TEXT, members={"position_status": ("OPEN", "CLOSED")},
              numbers="quantity, average_entry_price, mark_price, cash, equity, total_pnl, return_pct, gross_exposure, net_exposure")
check_damaged("portfolio_risk", L.risk, L.RISKS_SQL, "risks", SNAP, required=SNAP_TEXT, numbers="equity, daily_return_pct, daily_drawdown_pct", filled=SNAP_TEXT,
              members={"portfolio_risk_state": ("NORMAL", "WARNING", "SHUTDOWN")}, rules={
    "cooldown_rows": ("cooldown_until", "CASE WHEN cooldown_until IS NULL THEN 1 END", "(portfolio_risk_state = 'SHUTDOWN') <> (cooldown_until IS NOT NULL)"),
    "entry_rows": ("allow_new_entries", "NOT allow_new_entries", "allow_new_entries <> (portfolio_risk_state = 'NORMAL')")})
check_damaged("trade_management", L.management, L.TM_SQL, "tm", SNAP, required=SNAP_TEXT, numbers="current_price, highest_price, lowest_price, trail_price", filled=SNAP_TEXT,
              members={"management_action": ("NONE", "UPDATE_STOP"), "action_reason": ("NONE", "TRAILING_STOP", "BREAKEVEN")},
              rules={"price_rows": ("highest_price", "current_price - 1", "highest_price < current_price OR lowest_price > current_price")})
check_damaged("pyramiding", L.pyramid, L.PY_SQL, "pyr", SNAP, required=SNAP_TEXT, numbers="position_size, additional_size, recommended_size, profit_pct", filled=SNAP_TEXT, rules={
    "negative_size_rows": ("additional_size", "-1.0", "least(position_size, additional_size, recommended_size) < 0"), "add_rows": ("add_number", "max_adds + 1", "add_number > max_adds")})
check_damaged("exit_engine", L.exit_rows, L.EXIT_SQL, "exits", SNAP, required=SNAP_TEXT, numbers="recommended_percent, recommended_quantity, risk_reward_ratio", filled=SNAP_TEXT,
              members={"exit_action": ("HOLD", "PARTIAL_EXIT", "FULL_EXIT")}, rules={
    "percent_rows": ("recommended_percent", "1.5", "recommended_percent < 0 OR recommended_percent > 1"), "quantity_rows": ("recommended_quantity", "-1.0", "recommended_quantity < 0")})
check_damaged("backtesting", L.backtest_rows, L.BT_SQL, "bt", BAR, required="symbol, timeframe", filled="symbol, timeframe", members=ACTIVE,
              numbers="cash, equity, peak_equity, drawdown, daily_return, cumulative_return, max_drawdown", rules={
    "peak_rows": ("peak_equity", "equity - 1", "peak_equity < equity"), "trade_rows": ("winning_trades", "trade_count + 1", "winning_trades + losing_trades > trade_count")})
check_damaged("performance", lambda s, d: performance.performance(L.backtest_rows(s, d)), L.PERF_SQL, "perf", BAR, required="symbol, timeframe",
              numbers="total_return, volatility, max_drawdown, expectancy", filled="symbol, timeframe", members=ACTIVE)
check_damaged("analytics", lambda s, d: performance.analytics(performance.performance(L.backtest_rows(s, d))), result_of("analytics"), "result", BAR, required="symbol, timeframe",
              numbers="rolling_return, rolling_volatility, rolling_max_drawdown", filled="symbol, timeframe", members=ACTIVE)
FACTOR = "factor_name, factor_version"
check_damaged("factor_validation", P.validated, P.VAL, "val", f"{FACTOR}, timeframe", "validation_time", "observations, status", "information_coefficient, turnover",
              f"{FACTOR}, factor_category", {"status": ("PASS", "FAIL")})
check_damaged("factor_selection", P.selected, P.SELECT_SQL, "selection", f"{FACTOR}, timeframe", None, "selection_score, selection_rank, selected", "selection_score", FACTOR,
              rules={"rank_rows": ("selection_rank", "0", "selection_rank < 1")})
check_damaged("timeframe_analysis", lambda s, d: selection.timeframe_analysis(P.selected(s, d)), P.TFA_SQL, "analysis", FACTOR, None, "best_timeframe, selected", "best_selection_score",
              "best_timeframe", rules={"selected_rows": ("selected", "NOT selected", "selected <> (status = 'PASS')")})
check_damaged("combinations", P.combos, P.COMBO_SQL, "combos", "combination_id", None, "timeframe, combination_score", "combination_score", "combination_id, timeframe",
              rules={"size_rows": ("combination_size", "combination_size + 1", "len(factor_names) <> combination_size")})
check_damaged("alpha", lambda s, d: alpha_scores(P.orthogonal(s, d), P.factor_panel(s, d)),
              P.ORTH_SQL + ", al AS (SELECT sig.* RENAME (signal AS alpha_score) FROM sig JOIN orth USING (combination_id) WHERE selected)", "al", f"combination_id, {BAR}",
              required="alpha_score", numbers="alpha_score", filled="combination_id")
check_damaged("walk_forward", q_folds.walk, q_folds.ORDERED, "walk", "timeframe, fold", None, "train_start, train_end, test_start, test_end", "train_score, test_score", "timeframe",
              rules={"time_rows": ("train_end", "test_start + 1", "train_end > test_start OR test_end < test_start")})
check_damaged("purged_cv", lambda s, d: purged_folds(q_folds.members(s, d)), result_of("purged_folds"), "result", "timeframe, purged_fold", None, "test_start_time, test_end_time",
              "train_score, test_score", "timeframe", rules={"time_rows": ("test_end_time", "test_start_time - 1", "test_end_time < test_start_time")})
check_damaged("factors", P.factor_panel, P.PANEL_SQL + ", lo AS (SELECT *, 'any' AS factor_category FROM long)", "lo", f"{BAR}, {FACTOR}", numbers="factor_value",
              filled=f"{FACTOR}, factor_category")
