import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import folds, ledger, ml, stability

TRADES = "symbol string, timeframe string, side string, executed_quantity double, executed_price double, fees double, execution_time long"


def test_average_cost_and_reopening(spark):
    rows = [("A", "1d", "BUY", 1.0, 10.0, 0.1, 1), ("A", "1d", "BUY", 3.0, 20.0, 0.1, 2), ("A", "1d", "SELL", 4.0, 30.0, 0.1, 3),
            ("A", "1d", "BUY", 2.0, 5.0, 0.1, 4), ("B", "1d", "BUY", 1.0, 7.0, 0.0, 2)]
    got = {r.position_id: r for r in ledger.positions(spark.createDataFrame(rows, TRADES)).collect()}
    first, second, third = got["pos-00000001"], got["pos-00000002"], got["pos-00000003"]
    assert (first.status, first.realized_pnl, first.average_entry_price, first.closed_at) == ("CLOSED", 50.0, 17.5, 3)
    assert (second.symbol, second.status) == ("B", "OPEN")
    assert (third.quantity, third.average_entry_price, third.realized_pnl, third.opened_at) == (2.0, 5.0, 0.0, 4)


@pytest.mark.parametrize("rows", [[("A", "1d", "SELL", 1.0, 1.0, 0.0, 1)], [("A", "1d", "BUY", 1.0, 1.0, 0.0, 1), ("A", "1d", "SELL", 2.0, 1.0, 0.0, 2)]])
def test_short_and_oversell_are_errors(spark, rows):
    with pytest.raises(Exception, match="SELL"):
        ledger.positions(spark.createDataFrame(rows, TRADES)).collect()


def test_risk_state_matches_a_plain_loop(spark):
    rng = random.Random(4)
    hour = 3_600_000
    rows = [("A", "1h", 1_000 + i * 9 * hour, f"p{i}", rng.uniform(50, 150), rng.uniform(0, 140), rng.uniform(-4, 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, open_time long, position_id string, equity double, gross_exposure double, total_pnl double")
    df = df.select("*", F.col("gross_exposure").alias("net_exposure"), F.col("total_pnl").alias("realized_pnl"), F.lit(0.0).alias("unrealized_pnl"))
    got = {r.position_id: (r.portfolio_risk_state, r.shutdown_reason, r.cooldown_until) for r in ledger.portfolio_risk(df.repartition(5)).collect()}
    until = None
    for _, _, time, name, equity, gross, pnl in rows:
        if until is not None and time >= until:
            until = None
        if until is not None:
            want = ("SHUTDOWN", "COOLDOWN", until)
        elif pnl <= -0.02 * equity:
            until = time + 24 * hour
            want = ("SHUTDOWN", "DAILY_LOSS_LIMIT", until)
        elif gross / equity > 1.0:
            want = ("WARNING", "EXPOSURE_LIMIT", None)
        else:
            want = ("NORMAL", "", None)
        assert got[name] == want


def rows_frame(spark, n):
    rows = [("1d", i // 3, f"s{i % 3}", "f", "1", float(i), i % 2 == 0, 0.01 * ((i * 7) % 11 - 5)) for i in range(n)]
    return spark.createDataFrame(rows, "timeframe string, selection_time long, symbol string, factor_name string, factor_version string, "
                                 "factor_value double, selected boolean, future_return_1 double")


@pytest.mark.parametrize("n,train,test,step", [(100, 20, 5, 5), (103, 20, 8, 4), (97, 12, 6, 9), (24, 20, 5, 5), (15, 20, 5, 5), (1, 20, 5, 5)])
def test_walk_forward_windows_match_a_plain_loop(spark, n, train, test, step):
    data = [r.asDict() for r in rows_frame(spark, n).collect()]
    layout = folds.Layout(train, test, step)
    got = {r.fold: r for r in folds.fold_metrics(folds.indexed(rows_frame(spark, n)), layout).collect()}
    windows, start = [], 0
    while start + train + test <= n:
        windows.append((start, start + train, start + train, start + train + test))
        start += step
    if not windows:
        windows = [(0, 1, 0, 1)] if n == 1 else [(0, n - 1, n - 1, n)] if n <= train else [(0, train, train, n)]
    assert sorted(got) == list(range(1, len(windows) + 1))
    for fold, (a, b, c, d) in enumerate(windows, start=1):
        row = got[fold]
        assert (row.train_rows, row.test_rows) == (b - a, d - c)
        assert (row.train_start, row.train_end) == (data[a]["selection_time"], data[b - 1]["selection_time"])
        assert (row.test_start, row.test_end) == (data[c]["selection_time"], data[d - 1]["selection_time"])
        assert row.selected_factors == sum(r["selected"] for r in data[a:b])
        returns = [r["future_return_1"] for r in data[c:d] if r["selected"]]
        assert row.status == ("PASS" if returns else "FAIL")
        if returns:
            assert row.mean_return == pytest.approx(sum(returns) / len(returns))


@pytest.mark.parametrize("n", [23, 4])
def test_purged_membership_matches_index_sets(spark, n):
    walk = spark.createDataFrame([("1d", i + 1, i * 10, i * 10 + 9, 0.5, 0.25 * i) for i in range(n)],
                                 "timeframe string, fold int, test_start long, test_end long, train_score double, test_score double")
    got = {(r.purged_fold, r.row_id): r.role for r in folds.purged_membership(walk, 5, 2, 3).collect()}
    start = 0
    for k in range(5):
        end = start + n // 5 + (1 if k < n % 5 else 0)
        for i in range(n):
            want = ("TEST" if start <= i < end else "PURGE" if start - 2 <= i < start or end <= i < end + 2
                    else "EMBARGO" if end + 2 <= i < end + 5 else "TRAIN")
            assert got[(k + 1, i)] == want
        start = end


def test_exit_ladder_prefers_shutdown(spark):
    account = spark.createDataFrame([("A", "1d", i, "p", "OPEN", 4.0, 100.0) for i in range(5)],
                                    "symbol string, timeframe string, open_time long, position_id string, position_status string, quantity double, average_entry_price double")
    sides = spark.createDataFrame([("A", "1d", "p", "LONG")], "symbol string, timeframe string, position_id string, side string")
    state = [("SHUTDOWN", "DAILY_LOSS_LIMIT", "TRAILING_STOP", 90.0), ("SHUTDOWN", "COOLDOWN", "TRAILING_STOP", 90.0), ("NORMAL", "", "TRAILING_STOP", 90.0),
             ("NORMAL", "", "NONE", 115.0), ("NORMAL", "", "NONE", 101.0)]
    risk = spark.createDataFrame([("A", "1d", i, "p", s, r) for i, (s, r, _, _) in enumerate(state)],
                                 "symbol string, timeframe string, open_time long, position_id string, portfolio_risk_state string, shutdown_reason string")
    tm = spark.createDataFrame([("A", "1d", i, "p", p, "NONE", a) for i, (_, _, a, p) in enumerate(state)],
                               "symbol string, timeframe string, open_time long, position_id string, current_price double, management_action string, action_reason string")
    pyr = tm.select("symbol", "timeframe", "open_time", "position_id", F.lit("x").alias("reason"))
    got = [(r.exit_action, r.exit_reason, r.recommended_quantity) for r in ledger.exits(account, sides, risk, tm, pyr).orderBy("open_time").collect()]
    assert got == [("FULL_EXIT", "PORTFOLIO_SHUTDOWN", 4.0), ("HOLD", "COOLDOWN", 0.0), ("FULL_EXIT", "TRAILING_STOP", 4.0),
                   ("PARTIAL_EXIT", "TAKE_PROFIT", 2.0), ("HOLD", "NONE", 0.0)]


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    ics = spark.createDataFrame([("f", i, 0.01 * i) for i in range(20)], "factor_name string, fold int, oos_ic double")
    runs = [stability.bootstrap_mean_ic(ics.repartition(p), ["factor_name"], 400).first() for p in (1, 6)]
    assert runs[0] == runs[1] and runs[0].low < 0.095 < runs[0].high and runs[0].replicates == 400


def test_scaler_without_spread_and_round_trip(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    fitted = ml.fit_scaler(df, ["a", "b"])
    assert [tuple(r) for r in ml.scale(df, fitted).collect()] == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]
    assert [tuple(r) for r in ml.unscale(ml.scale(df, fitted), fitted).collect()] == [tuple(r) for r in df.collect()]


def test_the_median_of_a_purged_fold_is_not_gathered_in_one_buffer(spark):
    rows = [("1d", f, True, float(i % 7), 1, r) for f, returns in enumerate([[0.4, -0.1, 0.2, 0.2, None], [0.3, 0.1], [None]]) for i, r in enumerate(returns)]
    got = folds.purged_fold_metrics(spark.createDataFrame(
        rows, "timeframe string, fold int, selected boolean, factor_value double, selected_direction int, future_return_1 double"))
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.fold: r.oos_return_median for r in got.collect()} == {0: 0.2, 1: pytest.approx(0.2), 2: None}
