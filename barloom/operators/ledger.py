"""The trade ledger: portfolio weights, risk decisions, orders, fills, positions, accounting, risk state,
trade management, pyramiding and exits.  Times are epoch milliseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ordered import fold_ordered
from barloom.functions.stats import with_global_index

SERIES = ("symbol", "timeframe")
SNAPSHOT = ["symbol", "timeframe", "open_time", "position_id"]
HOUR_MS = 3_600_000

# Risk, trade-management, pyramiding and exit parameters.
DAILY_LOSS_LIMIT = 0.02
GROSS_EXPOSURE_LIMIT = 1.0
COOLDOWN_HOURS = 24
TRAIL_PERCENT = 0.05
INITIAL_RISK_PERCENT = 0.05
MAX_ADDS = 3
ADD_FRACTION = 0.5
MIN_PROFIT_PERCENT = 0.05
PROFIT_TOLERANCE = 1e-12
TAKE_PROFIT_MULTIPLE = 3.0
PARTIAL_EXIT_PERCENT = 0.5


def equal_weight_portfolio(signals: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """1/n for each of n BUY rows and -1/n for each of n SELL rows of a rebalance group, 0 for HOLD.

    Counts come from a small aggregate joined back, so a large group is never sorted.
    """
    counts = signals.groupBy(*keys).agg(
        F.count_if(F.col("signal") == "BUY").alias("_buys"), F.count_if(F.col("signal") == "SELL").alias("_sells")
    )
    weight = (
        F.when(F.col("signal") == "BUY", F.lit(1.0) / F.col("_buys"))
        .when(F.col("signal") == "SELL", F.lit(-1.0) / F.col("_sells"))
        .otherwise(0.0)
    )
    return signals.join(counts, list(keys)).select(
        *signals.columns, F.lit("equal_weight").alias("optimizer"), weight.alias("target_weight")
    )


def risk_decisions(portfolio: DataFrame, policy: str = "pass_through") -> DataFrame:
    return portfolio.select(
        *portfolio.columns, F.lit(policy).alias("policy"), F.col("target_weight").alias("approved_weight"),
        F.lit("APPROVE").alias("decision"), F.lit("approved").alias("reason"),
    )


def orders(risk: DataFrame, as_of: int | None = None) -> DataFrame:
    """One market order per approved non-zero weight; the id is a hash of the order's key, so reruns agree."""
    keys = [*SERIES, "open_time", "model_name", "model_version", "optimizer", "policy"]
    created = F.lit(as_of).cast("long") if as_of is not None else F.col("open_time")
    return risk.filter((F.col("decision") != "REJECT") & (F.col("approved_weight") != 0)).select(
        *keys, "signal", F.sha2(F.concat_ws("|", *keys), 256).alias("order_id"), F.lit(None).cast("string").alias("parent_order_id"),
        F.when(F.col("approved_weight") > 0, "BUY").otherwise("SELL").alias("side"), F.lit("MARKET").alias("order_type"),
        F.abs("approved_weight").alias("quantity"), F.lit(None).cast("double").alias("limit_price"),
        F.lit(None).cast("double").alias("stop_price"), F.lit(0.0).alias("filled_quantity"), F.lit("PENDING").alias("status"),
        created.alias("created_at"), created.alias("updated_at"),
    )


def executions(order_rows: DataFrame, bars: DataFrame | None = None, price: str = "close") -> DataFrame:
    """Market orders filled in full, without fee or slippage, at the limit price, else at the bar's price.

    Without ``bars`` an order that carries no limit price fills at 0.0.
    """
    market = order_rows.filter(F.col("order_type") == "MARKET")
    fallback = F.lit(0.0)
    if bars is not None:
        market = market.join(bars.select(*SERIES, "open_time", F.col(price).alias("_bar_price")), [*SERIES, "open_time"], "left")
        fallback = F.coalesce("_bar_price", F.lit(0.0))
    return market.select(
        *SERIES, "open_time", "order_id", "model_name", "model_version", "optimizer", "policy", "signal", "side", "order_type",
        F.col("quantity").alias("requested_quantity"), F.col("quantity").alias("executed_quantity"),
        F.col("limit_price").alias("requested_price"), F.coalesce("limit_price", fallback).alias("executed_price"),
        F.lit(0.0).alias("fees"), F.lit(0.0).alias("slippage"), F.lit("FILLED").alias("status"),
        F.col("open_time").alias("execution_time"),
    )


def _trade_step(state, row):
    """Average-cost accounting of one trade; the state is the position after it."""
    side, quantity, price, fees, time = row
    if not quantity or quantity <= 0:
        raise ValueError("executed_quantity must be positive")
    cycle, open_quantity, average, realized, paid, opened, count = state or (0, 0.0, 0.0, 0.0, 0.0, None, 0)
    if side == "BUY":
        if open_quantity == 0.0:
            cycle, average, realized, paid, opened = cycle + 1, price, 0.0, 0.0, time
            open_quantity = quantity
        else:
            held = open_quantity + quantity
            average = (average * open_quantity + price * quantity) / held
            open_quantity = held
    elif side == "SELL":
        if open_quantity == 0.0:
            raise ValueError("a SELL cannot open a short position")
        if quantity > open_quantity:
            raise ValueError("a SELL exceeds the open position")
        realized += (price - average) * quantity
        open_quantity -= quantity
    else:
        raise ValueError(f"unsupported trade side: {side}")
    paid += fees
    state = (cycle, open_quantity, average, realized, paid, opened, count + 1)
    return state, state


def positions(trades: DataFrame) -> DataFrame:
    """Long positions from trades per series: averaged on BUY, realised on SELL, closed at exactly zero.

    Trades stream through a carried state; each position's last trade is its row.
    """
    after = fold_ordered(
        trades, SERIES, ["execution_time"], ["side", "executed_quantity", "executed_price", "fees", "execution_time"],
        _trade_step,
        "_cycle bigint, quantity double, average_entry_price double, realized_pnl double, fees_paid double, opened_at bigint, _seq bigint",
    )
    lineage = [c for c in ("model_name", "model_version", "optimizer", "policy") if c in trades.columns]
    first = F.struct(*[F.col(c) for c in lineage]) if lineage else F.lit(None)
    state = F.struct("quantity", "average_entry_price", "realized_pnl", "fees_paid", F.col("executed_price").alias("market_price"))
    out = after.groupBy(*SERIES, "_cycle", "opened_at").agg(
        F.max_by(state, "_seq").alias("_s"), F.max("execution_time").alias("updated_at"), F.min_by(first, "_seq").alias("_l")
    ).select(*SERIES, "opened_at", "updated_at", "_s.*", *([F.col("_l.*")] if lineage else []))
    closed = F.col("quantity") == 0.0
    numbered = with_global_index(out, ["opened_at"], SERIES, "_index")
    return numbered.select(
        *SERIES, F.format_string("pos-%08d", F.col("_index") + 1).alias("position_id"), F.lit("LONG").alias("side"),
        F.when(closed, "CLOSED").otherwise("OPEN").alias("status"), "quantity", "average_entry_price", "market_price",
        "realized_pnl", ((F.col("market_price") - F.col("average_entry_price")) * F.col("quantity")).alias("unrealized_pnl"),
        "fees_paid", "opened_at", "updated_at", F.when(closed, F.col("updated_at")).alias("closed_at"), *lineage,
    )


def accounting(position_rows: DataFrame, cash: float, keys: Sequence[str] = SERIES) -> DataFrame:
    """Value, profit, equity and return per position; exposures are sums over the portfolio group."""
    value = F.col("quantity") * F.col("market_price")
    totals = position_rows.groupBy(*keys).agg(F.sum(F.abs(value)).alias("gross_exposure"), F.sum(value).alias("net_exposure"))
    joined = position_rows.join(totals, list(keys))
    unrealized = (F.col("market_price") - F.col("average_entry_price")) * F.col("quantity")
    total = F.col("realized_pnl") + unrealized
    equity = F.lit(float(cash)) + value
    return joined.select(
        *SERIES, F.col("opened_at").alias("open_time"), "position_id", F.col("status").alias("position_status"), "quantity",
        "average_entry_price", F.col("market_price").alias("mark_price"), value.alias("position_value"), value.alias("market_value"),
        F.lit(float(cash)).alias("cash"), "realized_pnl", unrealized.alias("unrealized_pnl"), total.alias("total_pnl"),
        "gross_exposure", "net_exposure", equity.alias("equity"), F.coalesce(F.try_divide(total, equity), F.lit(0.0)).alias("return_pct"),
    )


def portfolio_risk(
    account: DataFrame, keys: Sequence[str] = SERIES, loss_limit: float = DAILY_LOSS_LIMIT,
    exposure_limit: float = GROSS_EXPOSURE_LIMIT, cooldown_hours: int = COOLDOWN_HOURS,
) -> DataFrame:
    """Drawdown from the running peak and the risk state, with a cooldown after a loss shutdown.

    Only rows with a loss decide when a cooldown begins, so they alone are folded in order; all others read the last cooldown
    by a running window.  Of rows at one time and position the one that begins a cooldown comes first.
    """
    pause = cooldown_hours * HOUR_MS
    running = Window.partitionBy(*keys).orderBy("open_time", "position_id", F.col("_until").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    has_equity = F.col("equity") > 0
    prepared = account.select(
        *dict.fromkeys([*keys, *SNAPSHOT]), "equity", "gross_exposure", "net_exposure", F.col("realized_pnl").alias("daily_realized_pnl"),
        F.col("unrealized_pnl").alias("daily_unrealized_pnl"), F.col("total_pnl").alias("daily_total_pnl"),
        F.coalesce(F.try_divide("total_pnl", "equity"), F.lit(0.0)).alias("daily_return_pct"),
        F.coalesce(F.when(has_equity, F.col("total_pnl") <= -loss_limit * F.col("equity")).otherwise(F.col("total_pnl") < 0), F.lit(False)).alias("_loss"),
        F.when(has_equity, F.col("gross_exposure") / F.col("equity") > exposure_limit).otherwise(F.col("gross_exposure") > 0).alias("_exposed"),
    )

    def step(until, row):
        (time,) = row
        if until is not None and time < until:
            return until, (None,)
        return time + pause, (time + pause,)

    losses = fold_ordered(prepared.filter("_loss"), keys, ["open_time", "position_id"], ["open_time"], step, "_until bigint")
    rows = losses.unionByName(prepared.filter(~F.col("_loss")).withColumn("_until", F.lit(None).cast("long")))
    peak = F.greatest(F.max("equity").over(running), F.lit(0.0))
    begun = F.last("_until", ignorenulls=True).over(running)
    walked = rows.select("*", peak.alias("_peak"), begun.alias("_begun")).withColumn(
        "_halt", F.when(F.col("_until").isNotNull(), "DAILY_LOSS_LIMIT").when(F.col("_begun") > F.col("open_time"), "COOLDOWN")
    ).withColumns({
        "daily_drawdown_pct": F.greatest(F.coalesce(F.try_divide(F.col("_peak") - F.col("equity"), F.col("_peak")), F.lit(0.0)), F.lit(0.0)),
        "cooldown_until": F.when(F.col("_halt").isNotNull(), F.col("_begun")),
    })
    reason = F.when(F.col("_halt").isNotNull(), F.col("_halt")).when(F.col("_exposed"), "EXPOSURE_LIMIT").otherwise("")
    state = F.when(F.col("_halt").isNotNull(), "SHUTDOWN").when(F.col("_exposed"), "WARNING").otherwise("NORMAL")
    return walked.select(
        *[c for c in prepared.columns if not c.startswith("_")], "daily_drawdown_pct", state.alias("portfolio_risk_state"),
        (state == "NORMAL").alias("allow_new_entries"), reason.alias("shutdown_reason"), "cooldown_until",
    )


def trade_management(
    account: DataFrame, risk: DataFrame, prices: DataFrame, trail: float = TRAIL_PERCENT, initial_risk: float = INITIAL_RISK_PERCENT
) -> DataFrame:
    """Running high and low of every open position, trailing stop and break-even decisions."""
    joined = (
        account.filter("position_status = 'OPEN'")
        .join(prices.select(*SERIES, "open_time", F.col("price").alias("current_price")), [*SERIES, "open_time"], "left")
        .join(risk.select(*SNAPSHOT, F.col("portfolio_risk_state").alias("risk_state")), SNAPSHOT, "left")
    )
    so_far = Window.partitionBy("position_id").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    tracked = joined.select(
        *SNAPSHOT, "position_status", "quantity", F.col("average_entry_price").alias("entry_price"), "current_price",
        F.max("current_price").over(so_far).alias("highest_price"), F.min("current_price").over(so_far).alias("lowest_price"),
        "unrealized_pnl", "risk_state",
    )
    trail_price = F.col("highest_price") * (1.0 - trail)
    at_stop = F.col("current_price") <= trail_price
    even = F.col("current_price") - F.col("entry_price") >= F.col("entry_price") * initial_risk
    return tracked.select(
        "*",
        F.when(at_stop | even, "UPDATE_STOP").otherwise("NONE").alias("management_action"),
        F.when(at_stop, "TRAILING_STOP").when(even, "BREAKEVEN").otherwise("NONE").alias("action_reason"),
        F.when(at_stop, trail_price).when(even, F.col("entry_price")).alias("stop_price"),
        F.lit(None).cast("double").alias("take_profit_price"), trail_price.alias("trail_price"),
        F.when(even, F.col("entry_price")).alias("breakeven_price"), F.lit(False).alias("allow_pyramid"), F.lit(0.0).alias("exit_quantity"),
    )


def missing_coverage(account: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Snapshots that a stage's companion table does not cover; the ledger needs this to be empty."""
    return account.join(other.select(*keys), list(keys), "left_anti")


def pyramiding(
    account: DataFrame, position_rows: DataFrame, prices: DataFrame, risk: DataFrame, management: DataFrame,
    max_adds: int = MAX_ADDS, add_fraction: float = ADD_FRACTION, min_profit: float = MIN_PROFIT_PERCENT,
) -> DataFrame:
    """Whether to add to each position: an eligibility ladder, then a profit step per completed add."""
    sides = position_rows.select(*SERIES, "position_id", "side").distinct()
    joined = (
        account.join(sides, [*SERIES, "position_id"], "left")
        .join(prices.select(*SERIES, "open_time", F.col("price").alias("current_price"), F.col("high").alias("_high")), [*SERIES, "open_time"], "left")
        .join(risk.select(*SNAPSHOT, "portfolio_risk_state", "shutdown_reason", "cooldown_until"), SNAPSHOT, "left")
        .join(management.select(*SNAPSHOT, "management_action", "action_reason"), SNAPSHOT, "left")
    )
    cooling = (F.col("shutdown_reason") == "COOLDOWN") & (F.col("cooldown_until").isNull() | (F.col("open_time") < F.col("cooldown_until")))
    state = F.col("portfolio_risk_state")
    barred = (
        F.when((F.col("position_status") != "OPEN") | (F.coalesce("side", F.lit("")) != "LONG"), "NOT_ELIGIBLE")
        .when((state == "SHUTDOWN") & ~cooling, "PORTFOLIO_SHUTDOWN")
        .when(cooling, "COOLDOWN_ACTIVE")
        .when(state == "WARNING", "PORTFOLIO_WARNING")
        .when(state != "NORMAL", "NOT_ELIGIBLE")
        .when(F.col("action_reason") == "TRAILING_STOP", "TRAILING_STOP_ACTIVE")
        .when(F.col("action_reason") == "BREAKEVEN", "BREAKEVEN_ACTIVE")
        .when(~F.col("management_action").isin("NONE", "HOLD"), "NOT_ELIGIBLE")
    )
    so_far = Window.partitionBy("position_id").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    entry = F.col("average_entry_price")
    prepared = joined.select(
        *SNAPSHOT, F.col("position_id").alias("trade_id"), entry.alias("entry_price"), "current_price",
        F.max(F.greatest("_high", "current_price")).over(so_far).alias("highest_price"), "quantity",
        F.coalesce(F.try_divide(F.col("current_price") - entry, entry), F.lit(0.0)).alias("profit_pct"), barred.alias("_barred"),
    )

    def step(carried, row):
        quantity, profit, why = row
        size, adds = carried if carried is not None else (quantity, 0)
        if why is None and adds >= max_adds:
            why = "MAX_ADDS_REACHED"
        if why is None and profit + PROFIT_TOLERANCE < (adds + 1) * min_profit:
            why = "INSUFFICIENT_PROFIT"
        if why is not None:
            return (size, adds), (size, adds, 0.0, size, False, why)
        extra = size * add_fraction
        return (size + extra, adds + 1), (size, adds + 1, extra, size + extra, True, "READY_TO_ADD")

    walked = fold_ordered(
        prepared, ["position_id"], ["open_time"], ["quantity", "profit_pct", "_barred"], step,
        "position_size double, add_number int, additional_size double, recommended_size double, allow_pyramid boolean, reason string",
    )
    return walked.drop("_barred", "quantity").withColumn("max_adds", F.lit(max_adds))


# Exit priorities, most urgent first; 0 when there is nothing to do.
PRIORITY = {
    "PORTFOLIO_SHUTDOWN": 1,
    "COOLDOWN": 2,
    "TRAILING_STOP": 3,
    "BREAK_EVEN": 4,
    "TAKE_PROFIT": 5,
    "ALPHA_DECAY": 6,
    "NONE": 0,
}


def exits(
    account: DataFrame, position_rows: DataFrame, risk: DataFrame, management: DataFrame, pyramid: DataFrame,
    initial_risk: float = INITIAL_RISK_PERCENT, take_profit: float = TAKE_PROFIT_MULTIPLE, partial: float = PARTIAL_EXIT_PERCENT,
) -> DataFrame:
    """One exit decision per open snapshot, by the first rule of the priority ladder that applies."""
    sides = position_rows.select(*SERIES, "position_id", "side").distinct()
    joined = (
        account.filter("position_status = 'OPEN'")
        .join(sides, [*SERIES, "position_id"], "left")
        .join(risk.select(*SNAPSHOT, F.col("portfolio_risk_state").alias("risk_state"), "shutdown_reason"), SNAPSHOT, "left")
        .join(management.select(*SNAPSHOT, "current_price", F.col("management_action").alias("trade_state"), "action_reason"), SNAPSHOT, "left")
        .join(pyramid.select(*SNAPSHOT, F.col("reason").alias("pyramid_state")), SNAPSHOT, "left")
    )
    entry = F.col("average_entry_price")
    gain = F.when(F.col("side") == "LONG", F.col("current_price") - entry).otherwise(entry - F.col("current_price"))
    ratio = F.coalesce(F.try_divide(gain, entry * initial_risk), F.lit(0.0))
    cooling = F.col("shutdown_reason") == "COOLDOWN"
    reason = (
        F.when((F.col("risk_state") == "SHUTDOWN") & ~cooling, "PORTFOLIO_SHUTDOWN")
        .when(cooling, "COOLDOWN")
        .when(F.col("action_reason") == "TRAILING_STOP", "TRAILING_STOP")
        .when(F.col("action_reason") == "BREAKEVEN", "BREAK_EVEN")
        .when(F.col("risk_reward_ratio") >= take_profit, "TAKE_PROFIT")
        .when(F.col("action_reason") == "ALPHA_DECAY", "ALPHA_DECAY")
        .otherwise("NONE")
    )
    decided = joined.withColumn("risk_reward_ratio", ratio).withColumn("exit_reason", reason)
    percent = (
        F.when(F.col("exit_reason").isin("COOLDOWN", "NONE"), 0.0).when(F.col("exit_reason") == "TAKE_PROFIT", partial).otherwise(1.0)
    )
    ladder = F.create_map(*[F.lit(v) for item in PRIORITY.items() for v in item])
    return decided.withColumn("recommended_percent", percent).select(
        *SNAPSHOT, entry.alias("entry_price"), "current_price", "quantity", "risk_reward_ratio", "risk_state", "trade_state",
        "pyramid_state",
        F.when(F.col("recommended_percent") == 0, "HOLD").when(F.col("exit_reason") == "TAKE_PROFIT", "PARTIAL_EXIT")
        .otherwise("FULL_EXIT").alias("exit_action"),
        "exit_reason", (F.col("quantity") * F.col("recommended_percent")).alias("recommended_quantity"), "recommended_percent",
        F.element_at(ladder, F.col("exit_reason")).alias("priority"), F.col("open_time").alias("created_at"),
    )
