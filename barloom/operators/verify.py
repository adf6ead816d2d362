"""Report-only verification: one generic check runner and a rule list per dataset.

Every dataset check is one aggregate: rows are combined per key first (map-side), which yields the
duplicate count without a distinct aggregate, then folded to a single row of failure counts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAR_KEY = ("symbol", "timeframe", "open_time")


@dataclass(frozen=True)
class Checks:
    keys: tuple[str, ...]
    time: str | None = None
    required: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    finite: bool = True
    filled: tuple[str, ...] = ()
    members: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rules: dict[str, Column] = field(default_factory=dict)


def any_of(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def check_columns(c: Checks) -> dict[str, Column]:
    """Failing-row tests by check name."""
    tests = {
        "null_rows": any_of(F.col(x).isNull() for x in (*c.keys, *c.required)),
        "nan_rows": any_of(F.isnan(F.col(x)) for x in c.numbers),
    }
    if c.finite:
        tests["infinite_rows"] = any_of(F.abs(F.col(x)) == float("inf") for x in c.numbers)
    if c.time:
        tests["invalid_time_rows"] = any_of([F.col(c.time) <= 0])
    if c.filled:
        tests["empty_text_rows"] = any_of(F.trim(F.col(x)) == "" for x in c.filled)
    for column, allowed in c.members.items():
        tests[f"unknown_{column}"] = any_of([~F.col(column).isin(*allowed)])
    for name, test in c.rules.items():
        tests[name] = any_of([test])
    return tests


def verify(df: DataFrame, checks: Checks) -> DataFrame:
    """Rows (check, failures, passed) in a fixed order, starting with the row count."""
    tests = check_columns(checks)
    per_key = df.groupBy(*checks.keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(t.cast("long")).alias(n) for n, t in tests.items()]
    )
    counts = ["duplicate_rows", *tests]
    totals = per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
        *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in tests],
    )
    rows = [
        F.struct(
            F.lit(n).alias("check"),
            F.col(n).alias("failures"),
            ((F.col(n) == 0) if n != "rows" else (F.col("rows") > 0)).alias("passed"),
        )
        for n in ["rows", *counts]
    ]
    return totals.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def passed(report: DataFrame) -> DataFrame:
    return report.agg(F.bool_and("passed").alias("passed"))


def _bars() -> Checks:
    prices = ("open", "high", "low", "close")
    numbers = (*prices, "volume", "quote_volume")
    broken = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    return Checks(
        BAR_KEY, "open_time", (*numbers, "close_time", "trade_count"), numbers, finite=False,
        rules={"price_rule_rows": (F.least(*prices) <= 0) | broken,
               "negative_rows": (F.least("volume", "quote_volume") < 0) | (F.col("trade_count") < 0)},
    )


def _companion(time: str, numbers: tuple[str, ...], required: tuple[str, ...], signed: bool = False) -> Checks:
    return Checks(
        ("symbol", time), time, required, numbers, finite=False,
        rules={} if signed else {"negative_rows": F.least(*numbers, F.lit(0.0)) < 0},
    )


def _wide(numbers: tuple[str, ...], required: tuple[str, ...] = (), **more) -> Checks:
    return Checks(BAR_KEY, "open_time", required, numbers, **more)


RETURNS = tuple(f"future_return_{h}" for h in (1, 5, 10, 20))
DIRECTIONS = tuple(f"direction_{h}" for h in (1, 5, 10, 20))
MODEL = ("model_name", "model_version")
IDENTITY = ("factor_name", "factor_version", "timeframe")
SNAPSHOT = (*BAR_KEY, "position_id")


def _ledger(keys, time, numbers, filled=(), members=None, rules=None, required=()) -> Checks:
    return Checks(tuple(keys), time, (*required, *filled), tuple(numbers), True, tuple(filled), members or {}, rules or {})


def catalog() -> dict[str, Checks]:
    """Rule lists by dataset name (needs an active Spark session for its column expressions)."""
    from barloom.operators.features import FEATURES

    return {
        "ohlcv": _bars(),
        "funding": _companion("funding_time", ("funding_rate", "mark_price"), ("funding_rate",), signed=True),
        "open_interest": _companion("timestamp", ("open_interest",), ("open_interest",)),
        "taker_volume": _companion("timestamp", ("buy_volume", "sell_volume"), ("buy_volume", "sell_volume")),
        "long_short": _companion(
            "timestamp", ("long_account", "short_account", "long_short_ratio"),
            ("long_account", "short_account", "long_short_ratio")),
        "features": _wide(tuple(FEATURES)),
        "labels": _wide(RETURNS, RETURNS + DIRECTIONS,
                        rules={"direction_rows": F.greatest(*DIRECTIONS) > 1}),
        "training": _wide((*FEATURES, *RETURNS), RETURNS),
        "predictions": _wide(("prediction",), ("prediction", *MODEL), filled=MODEL),
        "signals": _wide((), ("signal", *MODEL), filled=MODEL, members={"signal": ("BUY", "SELL", "HOLD")}),
        "portfolios": _wide(
            ("target_weight",), ("signal", "target_weight"), filled=("optimizer",),
            members={"signal": ("BUY", "SELL", "HOLD")},
            rules={"weight_range_rows": F.abs("target_weight") > 1,
                   "weight_sign_rows": ((F.col("signal") == "BUY") & (F.col("target_weight") < 0))
                   | ((F.col("signal") == "SELL") & (F.col("target_weight") > 0))
                   | ((F.col("signal") == "HOLD") & (F.col("target_weight") != 0))}),
        "risk": _wide(
            ("target_weight", "approved_weight"), ("decision", "reason"), filled=("decision", "reason"),
            members={"decision": ("APPROVE", "RESIZE", "REJECT")},
            rules={"weight_range_rows": F.abs("approved_weight") > 1}),
        "orders": _ledger(
            ("order_id",), "created_at", ("quantity",), ("order_id", "symbol", "timeframe"),
            {"side": ("BUY", "SELL"), "order_type": ("MARKET", "LIMIT", "STOP", "STOP_LIMIT"),
             "status": ("PENDING", "SUBMITTED", "PARTIALLY_FILLED", "FILLED", "CANCELLED", "REJECTED", "EXPIRED")},
            {"quantity_rows": F.col("quantity") <= 0}),
        "executions": _ledger(
            ("order_id",), "execution_time", ("executed_quantity", "executed_price", "fees", "slippage"),
            ("order_id", "symbol", "timeframe"), {"side": ("BUY", "SELL")},
            {"quantity_rows": F.col("executed_quantity") < 0, "price_rows": F.col("executed_price") < 0}),
        "positions": _ledger(
            ("position_id",), "opened_at",
            ("quantity", "average_entry_price", "market_price", "realized_pnl", "unrealized_pnl", "fees_paid"),
            ("symbol", "timeframe"), {"side": ("LONG",), "status": ("OPEN", "CLOSED")},
            {"closed_at_rows": (F.col("status") == "CLOSED") != F.col("closed_at").isNotNull(),
             "quantity_rows": F.col("quantity") < 0}),
        "accounting": _ledger(
            SNAPSHOT, "open_time", ("quantity", "average_entry_price", "mark_price", "cash", "equity", "total_pnl", "return_pct",
                                    "gross_exposure", "net_exposure"), ("symbol", "timeframe", "position_id"),
            {"position_status": ("OPEN", "CLOSED")}),
        "portfolio_risk": _ledger(
            SNAPSHOT, "open_time", ("equity", "daily_return_pct", "daily_drawdown_pct"), ("symbol", "timeframe", "position_id"),
            {"portfolio_risk_state": ("NORMAL", "WARNING", "SHUTDOWN")},
            {"cooldown_rows": (F.col("portfolio_risk_state") == "SHUTDOWN") != F.col("cooldown_until").isNotNull(),
             "entry_rows": F.col("allow_new_entries") != (F.col("portfolio_risk_state") == "NORMAL")}),
        "trade_management": _ledger(
            SNAPSHOT, "open_time", ("current_price", "highest_price", "lowest_price", "trail_price"), ("symbol", "timeframe", "position_id"),
            {"management_action": ("NONE", "UPDATE_STOP"), "action_reason": ("NONE", "TRAILING_STOP", "BREAKEVEN")},
            {"price_rows": (F.col("highest_price") < F.col("current_price")) | (F.col("lowest_price") > F.col("current_price"))}),
        "pyramiding": _ledger(
            SNAPSHOT, "open_time", ("position_size", "additional_size", "recommended_size", "profit_pct"), ("symbol", "timeframe", "position_id"), {},
            {"negative_size_rows": F.least("position_size", "additional_size", "recommended_size") < 0,
             "add_rows": F.col("add_number") > F.col("max_adds")}),
        "exit_engine": _ledger(
            SNAPSHOT, "open_time", ("recommended_percent", "recommended_quantity", "risk_reward_ratio"), ("symbol", "timeframe", "position_id"),
            {"exit_action": ("HOLD", "PARTIAL_EXIT", "FULL_EXIT")},
            {"percent_rows": (F.col("recommended_percent") < 0) | (F.col("recommended_percent") > 1),
             "quantity_rows": F.col("recommended_quantity") < 0}),
        "backtesting": _ledger(
            BAR_KEY, "open_time", ("cash", "equity", "peak_equity", "drawdown", "daily_return", "cumulative_return", "max_drawdown"),
            ("symbol", "timeframe"), {"status": ("ACTIVE", "FINISHED")},
            {"peak_rows": F.col("peak_equity") < F.col("equity"), "trade_rows": F.col("winning_trades") + F.col("losing_trades") > F.col("trade_count")}),
        "performance": _ledger(
            BAR_KEY, "open_time", ("total_return", "volatility", "max_drawdown", "expectancy"), ("symbol", "timeframe"), {"status": ("ACTIVE", "FINISHED")}),
        "analytics": _ledger(
            BAR_KEY, "open_time", ("rolling_return", "rolling_volatility", "rolling_max_drawdown"), ("symbol", "timeframe"), {"status": ("ACTIVE", "FINISHED")}),
        "factor_validation": Checks(
            IDENTITY, "validation_time", ("observations", "status"), ("information_coefficient", "turnover"),
            filled=("factor_name", "factor_version", "factor_category"), members={"status": ("PASS", "FAIL")}),
        "factor_selection": Checks(
            IDENTITY, None, ("selection_score", "selection_rank", "selected"), ("selection_score",),
            filled=("factor_name", "factor_version"), rules={"rank_rows": F.col("selection_rank") < 1}),
        "timeframe_analysis": Checks(
            IDENTITY[:2], None, ("best_timeframe", "selected"), ("best_selection_score",), filled=("best_timeframe",),
            rules={"selected_rows": F.col("selected") != (F.col("status") == "PASS")}),
        "combinations": Checks(
            ("combination_id",), None, ("timeframe", "combination_score"), ("combination_score",), filled=("combination_id", "timeframe"),
            rules={"size_rows": F.size("factor_names") != F.col("combination_size")}),
        "orthogonalization": Checks(
            ("combination_id",), None, ("selected",), ("source_combination_score",), filled=("combination_id",)),
        "alpha": Checks(
            ("combination_id", *BAR_KEY), "open_time", ("alpha_score",), ("alpha_score",), filled=("combination_id",)),
        "walk_forward": Checks(
            ("timeframe", "fold"), None, ("train_start", "train_end", "test_start", "test_end"), ("train_score", "test_score"),
            filled=("timeframe",),
            rules={"time_rows": (F.col("train_end") > F.col("test_start")) | (F.col("test_end") < F.col("test_start"))}),
        "purged_cv": Checks(
            ("timeframe", "purged_fold"), None, ("test_start_time", "test_end_time"), ("train_score", "test_score"), filled=("timeframe",),
            rules={"time_rows": F.col("test_end_time") < F.col("test_start_time")}),
        "factors": Checks(
            (*BAR_KEY, "factor_name", "factor_version"), "open_time", (), ("factor_value",),
            filled=("factor_name", "factor_version", "factor_category")),
    }


def selection_rank_checks(selection: DataFrame, top_n: int) -> DataFrame:
    """Per timeframe: ranks are 1..n without holes, follow the score, and only top ranks are selected."""
    from pyspark.sql import Window

    ordered = Window.partitionBy("timeframe").orderBy("selection_rank")
    ranked = selection.filter(F.col("selection_reason") != "hard_ineligible").withColumn(
        "_before", F.lag("selection_score").over(ordered)
    )
    return ranked.groupBy("timeframe").agg(
        ((F.max("selection_rank") == F.count(F.lit(1))) & (F.min("selection_rank") == 1)).alias("ranks_dense"),
        (F.count_if(F.col("selection_score") > F.col("_before")) == 0).alias("rank_follows_score"),
        (F.count_if("selected") <= top_n).alias("survivors_within_top_n"),
    )


def same_members(derived: DataFrame, source: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Cross-check of two stages: keys of one that the other lacks."""
    keys = list(keys)
    a, b = derived.select(*keys).distinct(), source.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("missing_from", F.lit("source")).unionByName(
        b.join(a, keys, "left_anti").withColumn("missing_from", F.lit("derived"))
    )


def combination_lineage(combos: DataFrame, analysis: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Cross-check of combinations with the timeframe analysis they come from: one row per violated rule and combination.

    Rules: duplicate_id; and per member missing_factor (no such name and version), not_selected; score_mismatch if the
    combination's score is not the mean of its members' scores.
    """
    members = combos.select("combination_id", "combination_score", F.size("factor_names").alias("_size"), F.explode(F.arrays_zip("factor_names", "factor_versions")).alias("m"))
    known = analysis.groupBy(F.col("factor_name"), F.col("factor_version")).agg(
        F.max(F.col("selected").cast("int")).alias("_selected"), F.max(F.when(F.col("selected"), F.col("best_selection_score"))).alias("_score"))
    found = members.select("combination_id", "combination_score", "_size", F.col("m.factor_names").alias("factor_name"), F.col("m.factor_versions").alias("factor_version")).join(
        known, ["factor_name", "factor_version"], "left")
    rule = F.when(F.col("_selected").isNull(), "missing_factor").when(F.col("_selected") == 0, "not_selected")
    per_member = found.select("combination_id", rule.alias("rule"), F.col("factor_name").alias("detail")).filter("rule IS NOT NULL")
    mean = found.groupBy("combination_id", "combination_score", "_size").agg(F.sum("_score").alias("_sum"), F.count("_score").alias("_n"))
    scores = mean.filter((F.col("_n") == F.col("_size")) & ~F.coalesce(F.abs(F.col("_sum") / F.col("_n") - F.col("combination_score")) <= tolerance, F.lit(False)))
    twice = combos.groupBy("combination_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    nothing = F.lit(None).cast("string").alias("detail")
    return per_member.unionByName(scores.select("combination_id", F.lit("score_mismatch").alias("rule"), nothing)).unionByName(
        twice.select("combination_id", F.lit("duplicate_id").alias("rule"), nothing))


def orthogonalization_lineage(orthogonal: DataFrame, combos: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Cross-check of an orthogonalization table with its combinations and with itself: one row per violated rule and combination.

    Rules: duplicate_id; unknown_combination, missing_combination (each side lacks the other's); timeframe_mismatch,
    member_mismatch, rank_mismatch against the source; rejected_selected (a rejected row that is selected, passes or has another
    reason), accepted_not_selected; weak_rejection (a rejected row whose correlation is below the threshold or whose overlap is
    too small), missing_reference (a rejected row without an accepted reference of its timeframe).
    """
    source = combos.select("combination_id", F.col("timeframe").alias("_timeframe"), F.col("factor_names").alias("_names"), F.col("factor_versions").alias("_versions"),
                           F.col("combination_rank").alias("_rank"))
    accepted = orthogonal.filter("selected").select(F.col("combination_id").alias("redundancy_reference_combination_id"), "timeframe", F.lit(True).alias("_accepted")).distinct()
    both = orthogonal.join(source, "combination_id", "left").join(accepted, ["redundancy_reference_combination_id", "timeframe"], "left")
    rejected, known = F.col("redundancy_rejected"), F.col("_timeframe").isNotNull()
    rules = {
        "unknown_combination": ~known,
        "timeframe_mismatch": known & (F.col("_timeframe") != F.col("timeframe")),
        "member_mismatch": known & ((F.col("_names") != F.col("factor_names")) | (F.col("_versions") != F.col("factor_versions"))),
        "rank_mismatch": known & (F.col("_rank") != F.col("source_combination_rank")),
        "rejected_selected": rejected & (F.col("selected") | (F.col("status") == "PASS") | (F.col("orthogonalization_reason") != "redundant")),
        "accepted_not_selected": ~rejected & (~F.col("selected") | (F.col("status") != "PASS")),
        "weak_rejection": rejected & ~F.coalesce((F.col("correlation_score") >= F.col("correlation_threshold") - tolerance)
                                                 & (F.col("correlation_overlap") >= F.col("min_overlap_threshold")), F.lit(False)),
        "missing_reference": rejected & F.col("_accepted").isNull(),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    rows = both.select("combination_id", F.explode(broken).alias("rule")).distinct()
    twice = orthogonal.groupBy("combination_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("combination_id", F.lit("duplicate_id").alias("rule"))
    absent = combos.select("combination_id").join(orthogonal.select("combination_id"), "combination_id", "left_anti").distinct().withColumn("rule", F.lit("missing_combination"))
    return rows.unionByName(twice).unionByName(absent)
