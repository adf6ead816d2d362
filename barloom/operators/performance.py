"""Backtest ledger, expanding performance metrics and analytics, per series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("symbol", "timeframe")
DAYS_PER_YEAR = 365
YEAR_SECONDS = DAYS_PER_YEAR * 86_400.0


def _so_far():
    return Window.partitionBy(*SERIES).orderBy("open_time").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def completed_trades(position_rows: DataFrame, exit_rows: DataFrame, account: DataFrame) -> DataFrame:
    """Closed positions, and fully exited ones that are not closed with their latest realised profit."""
    closed = position_rows.filter("status = 'CLOSED'").select(
        *SERIES, "position_id", F.coalesce("closed_at", "updated_at", "opened_at").alias("completed_at"), "realized_pnl"
    )
    latest = account.groupBy(*SERIES, "position_id").agg(F.max_by("realized_pnl", "open_time").alias("realized_pnl"))
    full = (
        exit_rows.filter("exit_action = 'FULL_EXIT'")
        .groupBy(*SERIES, "position_id").agg(F.min("open_time").alias("completed_at"))
        .join(closed.select(*SERIES, "position_id"), [*SERIES, "position_id"], "left_anti")
        .join(latest, [*SERIES, "position_id"], "left")
        .withColumn("realized_pnl", F.coalesce("realized_pnl", F.lit(0.0)))
    )
    return closed.unionByName(full)


def backtest(account: DataFrame, exit_rows: DataFrame, trades: DataFrame) -> DataFrame:
    """Equity, drawdown, returns and running trade counts at every time that both tables share."""
    key = [*SERIES, "open_time"]
    shared = account.join(exit_rows.select(*key).distinct(), key, "left_semi")
    steps = shared.groupBy(*key).agg(
        F.first("cash").alias("cash"), F.sum("position_value").alias("position_value"),
        F.sum("realized_pnl").alias("realized_pnl"), F.sum("unrealized_pnl").alias("unrealized_pnl"),
    ).withColumn("equity", F.col("cash") + F.col("unrealized_pnl"))
    gain = F.greatest("realized_pnl", F.lit(0.0))
    done = trades.groupBy(*SERIES, F.col("completed_at").alias("open_time")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("realized_pnl") > 0).alias("_w"), F.count_if(F.col("realized_pnl") < 0).alias("_l"),
        F.sum(gain).alias("_gain"), F.sum(F.greatest(-F.col("realized_pnl"), F.lit(0.0))).alias("_lost"),
    )
    # Trades and steps in one time order; a trade at the time of a step counts in it.
    stacked = steps.withColumn("_step", F.lit(True)).unionByName(done.withColumn("_step", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy(*SERIES).orderBy("open_time", "_step").rowsBetween(Window.unboundedPreceding, 0)
    counted = stacked.select("*", *[
        F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(n)
        for c, n in (("_n", "trade_count"), ("_w", "winning_trades"), ("_l", "losing_trades"), ("_gain", "_gains"), ("_lost", "_losses"))
    ]).filter("_step")
    peak = F.greatest(F.max("equity").over(_so_far()), F.lit(0.0))
    by_time = Window.partitionBy(*SERIES).orderBy("open_time")
    out = counted.select(
        *key, "equity", "cash", "position_value", "realized_pnl", "unrealized_pnl",
        (F.col("realized_pnl") + F.col("unrealized_pnl")).alias("total_pnl"), peak.alias("peak_equity"),
        F.coalesce(F.try_divide(peak - F.col("equity"), peak), F.lit(0.0)).alias("drawdown"),
        F.coalesce(F.try_divide(F.col("equity"), F.lag("equity").over(by_time)) - 1, F.lit(0.0)).alias("daily_return"),
        F.coalesce(F.try_divide(F.col("equity"), F.first("equity").over(_so_far())) - 1, F.lit(0.0)).alias("cumulative_return"),
        "trade_count", "winning_trades", "losing_trades",
        F.coalesce(F.try_divide(F.col("winning_trades").cast("double"), F.col("trade_count").cast("double")), F.lit(0.0)).alias("win_rate"),
        F.try_divide("_gains", "_losses").alias("profit_factor"),
        F.when(F.lead("open_time").over(by_time).isNull(), "FINISHED").otherwise("ACTIVE").alias("status"),
    )
    return out.withColumn("max_drawdown", F.max("drawdown").over(_so_far()))


def inferred_trades(ledger: DataFrame) -> DataFrame:
    """Trades read off the running trade count: new trades share the realised profit since the last ones."""
    return _trade_steps(ledger).filter("_new > 0").select(
        *SERIES, F.col("open_time").alias("completed_at"), F.explode(F.array_repeat("_each", F.col("_new").cast("int"))).alias("realized_pnl")
    )


def _trade_steps(ledger: DataFrame) -> DataFrame:
    order = Window.partitionBy(*SERIES).orderBy("open_time")
    counted = ledger.withColumn("_new", F.col("trade_count") - F.coalesce(F.lag("trade_count").over(order), F.lit(0)))
    base = F.last(F.when(F.col("_new") > 0, F.col("realized_pnl")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, -1)
    )
    share = F.try_divide(F.col("realized_pnl") - F.coalesce(base, F.lit(0.0)), F.col("_new").cast("double"))
    return counted.withColumn("_each", F.when(F.col("_new") > 0, share))


def performance(ledger: DataFrame) -> DataFrame:
    """Every metric over the history up to each row, as expanding windows."""
    so_far = _so_far()
    order = Window.partitionBy(*SERIES).orderBy("open_time")
    new, each = F.coalesce("_new", F.lit(0)), F.col("_each")
    staged = _trade_steps(ledger).select(
        "*", F.row_number().over(order).alias("_row"), F.first("equity").over(so_far).alias("starting_equity"),
        F.first("open_time").over(so_far).alias("_start"),
        # A run of drawdown rows shares the count of rows without drawdown before it.
        F.count_if(F.col("drawdown") <= 0).over(so_far).alias("_calm"),
    )
    run = Window.partitionBy(*SERIES, "_calm").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    sample = F.when(F.col("_row") > 1, F.col("daily_return"))
    staged = staged.select(
        "*", F.count_if(F.col("drawdown") > 0).over(run).alias("_run"), F.avg(sample).over(so_far).alias("_mean"),
        F.stddev_samp(sample).over(so_far).alias("_sd"), F.sqrt(F.avg(F.pow(F.least(sample, sample * 0), 2)).over(so_far)).alias("_down"),
        F.max("drawdown").over(so_far).alias("_max_drawdown"), F.sum(new).over(so_far).alias("total_trades"),
        F.sum(F.when(each > 0, new).otherwise(0)).over(so_far).alias("_wins"), F.sum(F.when(each < 0, new).otherwise(0)).over(so_far).alias("_losses"),
        F.sum(F.when(each > 0, each * new).otherwise(0.0)).over(so_far).alias("gross_profit"),
        F.sum(F.when(each < 0, -each * new).otherwise(0.0)).over(so_far).alias("gross_loss"),
        F.min(F.when(new > 0, F.col("open_time"))).over(so_far).alias("first_trade_time"),
        F.max(F.when(new > 0, F.col("open_time"))).over(so_far).alias("last_trade_time"),
    ).withColumn("drawdown_duration", F.max("_run").over(so_far))
    seconds = (F.col("open_time") - F.col("_start")) / 1000.0
    growth = F.col("equity") / F.col("starting_equity")
    solvent = (F.col("starting_equity") > 0) & (F.col("equity") > 0) & (seconds > 0)
    cagr = F.when(solvent, F.pow(growth, F.lit(YEAR_SECONDS) / seconds) - 1).otherwise(0.0)
    per_year = F.when(seconds > 0, F.lit(YEAR_SECONDS) * (F.col("_row") - 1) / seconds).otherwise(float(DAYS_PER_YEAR))
    root = F.sqrt(per_year)
    trades = F.col("total_trades").cast("double")
    return staged.select(
        *SERIES, "open_time",
        F.when(F.col("starting_equity") > 0, growth - 1).otherwise(0.0).alias("total_return"), cagr.alias("cagr"),
        F.coalesce(F.col("_sd") * root, F.lit(0.0)).alias("volatility"), F.coalesce(F.col("_down") * root, F.lit(0.0)).alias("downside_volatility"),
        F.col("_max_drawdown").alias("max_drawdown"), "drawdown_duration",
        (F.try_divide("_mean", "_sd") * root).alias("sharpe_ratio"), (F.try_divide("_mean", "_down") * root).alias("sortino_ratio"),
        F.try_divide(cagr, F.col("_max_drawdown")).alias("calmar_ratio"), "total_trades", F.col("_wins").alias("winning_trades"),
        F.col("_losses").alias("losing_trades"), F.coalesce(F.try_divide(F.col("_wins").cast("double"), trades), F.lit(0.0)).alias("win_rate"),
        F.try_divide(F.col("gross_profit"), F.col("_wins").cast("double")).alias("average_win"),
        F.try_divide(-F.col("gross_loss"), F.col("_losses").cast("double")).alias("average_loss"),
        F.try_divide("gross_profit", "gross_loss").alias("profit_factor"),
        F.coalesce(F.try_divide(F.col("gross_profit") - F.col("gross_loss"), trades), F.lit(0.0)).alias("expectancy"),
        "starting_equity", F.col("equity").alias("ending_equity"), (F.col("equity") - F.col("starting_equity")).alias("net_profit"),
        "gross_profit", "gross_loss", "first_trade_time", "last_trade_time", "status",
    )


def analytics(metrics: DataFrame) -> DataFrame:
    """Rolling names for the metrics, the recovery factor, and the (unfilled) benchmark columns."""
    renamed = {
        "rolling_return": "total_return", "rolling_volatility": "volatility", "rolling_sharpe": "sharpe_ratio",
        "rolling_sortino": "sortino_ratio", "rolling_max_drawdown": "max_drawdown", "rolling_win_rate": "win_rate",
        "rolling_profit_factor": "profit_factor", "rolling_expectancy": "expectancy", "rolling_cagr": "cagr", "rolling_calmar": "calmar_ratio",
    }
    benchmark = ("return", "alpha", "beta", "correlation", "tracking_error", "information_ratio")
    return metrics.select(
        *SERIES, "open_time", *[F.col(c).alias(n) for n, c in renamed.items()],
        F.try_divide("net_profit", "max_drawdown").alias("rolling_recovery_factor"),
        *[F.lit(0.0).alias(f"benchmark_{b}") for b in benchmark], "status",
    )
