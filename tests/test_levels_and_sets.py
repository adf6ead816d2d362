"""Values handed over between stored parts, rebuilt levels, factor sets, orientation by year and the sparse risk state."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.series import across_parts, total_across_parts
from barloom.operators import ledger, stability

DAY = 86_400_000
BARS = "symbol string, timeframe string, year int, open_time long, close double, volume double, open_interest double"
SELECTION = "timeframe string, factor_name string, factor_version string, eligibility_status string, selected boolean, selected_direction int, selection_ic double"
OOS = "timeframe string, symbol string, factor_name string, factor_version string, fold int, open_time long, factor_value double, future_return_1 double"
ICS = "timeframe string, factor_name string, factor_version string, fold int, raw_oos_ic double, oriented_oos_ic double"


def series(seed, symbols="AB"):
    rnd = random.Random(seed)
    rows = []
    for s in symbols:
        for year in (2000, 2001, 2003):
            for i in range(rnd.choice([1, 4, 9])):
                rows.append((s, "1d", year, (year - 1970) * 365 * DAY + i * DAY, rnd.choice([None, 10.0, 11.5, 12.0, 9.0]), float(rnd.randint(1, 9)), float(i)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_hand_over_equals_one_window_over_the_series(spark, seed):
    rows = series(seed)
    df = spark.createDataFrame(rows, BARS).repartition(4)
    back = {(r.symbol, r.open_time): r.x for r in across_parts(df, ["symbol"], "year", "close", "x").collect()}
    on = {(r.symbol, r.open_time): r.x for r in across_parts(df, ["symbol"], "year", "close", "x", ahead=True).collect()}
    total = {(r.symbol, r.open_time): r.x for r in total_across_parts(df, ["symbol"], "year", "close", "x").collect()}
    assert len(back) == len(on) == len(total) == len(rows)
    for s in "AB":
        own = sorted((r[3], r[4]) for r in rows if r[0] == s)
        run = 0.0
        for i, (time, close) in enumerate(own):
            assert back[s, time] == (own[i - 1][1] if i else None)
            assert on[s, time] == (own[i + 1][1] if i + 1 < len(own) else None)
            run += close or 0.0
            assert total[s, time] == (None if close is None else pytest.approx(run))
    assert total_across_parts(df.limit(0), ["symbol"], "year", "close", "x").count() == 0


def test_a_damaged_level_in_the_second_year_is_found(spark):
    bars = [("A", "1d", y, (y - 1970) * 365 * DAY + i * DAY, 10.0 + (i * 7 + y) % 5, 2.0 + i, 100.0 * i) for y in (2000, 2001) for i in range(6)]
    df = spark.createDataFrame(bars, BARS)
    names = [*stability.LEVELS, "future_return_1"]
    right = stability.rebuilt_levels(df)
    clean = {r.factor_name: r for r in stability.level_differences(right, df).collect()}
    assert {n: (clean[n]["values"], clean[n].wrong_rows, clean[n].null_mismatches, clean[n].first_wrong_time) for n in names} == {
        "on_balance_volume": (11, 0, 0, None), "price_volume_trend": (11, 0, 0, None), "open_interest_level": (12, 0, 0, None), "future_return_1": (11, 0, 0, None)}
    hit, gone = bars[8][3], bars[9][3]
    hurt = right.withColumns({
        "on_balance_volume": F.when(F.col("open_time") == hit, F.col("on_balance_volume") + 3).otherwise(F.col("on_balance_volume")),
        "price_volume_trend": F.when(F.col("open_time") != gone, F.col("price_volume_trend")),
        "open_interest_level": F.when(F.col("open_time") == hit, float("nan")).otherwise(F.col("open_interest_level")),
        "future_return_1": F.when(F.col("open_time") != gone, F.col("future_return_1"))})
    found = {r.factor_name: (r.wrong_rows, r.null_mismatches, r.first_wrong_time) for r in stability.level_differences(hurt, df).collect()}
    assert found == {"on_balance_volume": (1, 0, hit), "price_volume_trend": (0, 1, None), "open_interest_level": (1, 0, hit), "future_return_1": (0, 0, None)}


def sets(spark):
    old = [("1d", "a", "1", "ELIGIBLE", True, 1, 0.2), ("1d", "b", "1", "ELIGIBLE", True, -1, -0.1), ("1d", "c", "1", "ELIGIBLE", True, 1, 0.1), ("1d", "d", "1", "ELIGIBLE", False, 1, 0.0)]
    new = [("1d", "a", "1", "ELIGIBLE", False, 1, 0.3), ("1d", "c", "1", "INELIGIBLE_LOW_COVERAGE", False, 1, 0.1), ("1d", "d", "1", "ELIGIBLE", True, 1, 0.05)]
    # b covers days 0-9, a 0-4, c none, d one early and one far day in another bucket of days.
    days = {"a": range(5), "b": range(10), "d": [3, 40_000], "e": [1]}
    rows = [("1d", s, f, "1", 1, d * DAY, float(d + i), 0.1 * d + i) for f, ds in days.items() for d in ds for i, s in enumerate("xy")] + [("1d", "x", "c", "1", 1, 0, None, 0.1)]
    return spark.createDataFrame(rows, OOS), spark.createDataFrame(old, SELECTION), spark.createDataFrame(new, SELECTION)


def test_replacement_decisions_and_coverage(spark):
    oos, old, new = sets(spark)
    ics = spark.createDataFrame([("1d", "a", "1", 1, 0.4, 0.4), ("1d", "a", "1", 2, -0.2, -0.2)], ICS)
    got = {r.factor_name: r for r in stability.factor_replacement(oos, old, new, ics, ["b"]).collect()}
    assert {n: (r.in_old_selected, r.in_new_selected, r.decision, r.days_covered, r.observation_count_oos) for n, r in got.items()} == {
        "a": (True, False, "ELIGIBLE_NOT_SELECTED", 5, 10), "b": (True, False, "RETIRED_EXISTING_FACTOR", 10, 20), "c": (True, False, "INELIGIBLE_LOW_COVERAGE", 0, 0),
        "d": (False, True, "ELIGIBLE_AND_SELECTED", 2, 4), "e": (False, False, "INELIGIBLE_ZERO_OBSERVATIONS", 1, 2)}
    assert (got["a"].selection_ic, got["a"].positive_folds, got["a"].negative_folds, got["a"].fold_count) == (0.3, 1, 1, 2)
    assert got["a"].mean_fold_raw_ic == pytest.approx(0.1) and got["b"].aggregate_oriented_ic < 0 < got["a"].aggregate_oriented_ic
    assert got["c"].null_rate_oos == 1.0 and got["c"].aggregate_oriented_ic is None


def test_set_coverage_counts_days_by_bits(spark):
    oos, old, new = sets(spark)
    both = old.filter("factor_name IN ('a', 'b')")
    (row,) = stability.set_coverage(oos, both, new).collect()
    assert row.asDict() == {"timeframe": "1d", "old_factors": 2, "new_factors": 1, "old_any_days": 10, "old_every_days": 5, "new_any_days": 2, "new_every_days": 2, "shared_days": 1}
    (row,) = stability.set_coverage(oos, old, new.filter("false")).collect()
    assert (row.old_factors, row.old_every_days, row.new_factors, row.new_any_days, row.shared_days) == (3, 0, 0, 0, 0)
    assert stability.set_coverage(oos, old.filter("false"), new.filter("false")).count() == 0


def test_orientation_counts_a_factor_once_a_year(spark):
    nan = float("nan")
    rows = [("1d", 2000, "a", "1", 1, 1, 0.2, 0.4, 0.4), ("1d", 2000, "a", "1", 2, 1, 0.9, nan, nan), ("1d", 2000, "b", "1", 1, -1, -0.4, 0.1, -0.1), ("1d", 2001, "b", "1", 3, None, None, None, None)]
    df = spark.createDataFrame(rows, "timeframe string, year int, factor_name string, factor_version string, fold int, selected_direction int, selection_ic double, raw_oos_ic double, oriented_oos_ic double")
    detail = stability.orientation_detail(df)
    assert [r.oriented_selection_ic for r in detail.orderBy("year", "factor_name", "fold").collect()] == [0.2, 0.9, 0.4, None]
    first, second = stability.orientation_by_year(detail).orderBy("year").collect()
    assert (first.selected_factor_count, first.positive_direction_count, first.negative_direction_count) == (2, 1, 1)
    assert [first[c] for c in ("mean_raw_selection_ic", "mean_oriented_selection_ic", "mean_raw_oos_ic", "mean_oriented_oos_ic")] == pytest.approx([-0.1, 0.3, 0.25, 0.15])
    assert (second.selected_factor_count, second.positive_direction_count, second.mean_raw_oos_ic) == (1, 0, None)


def test_only_loss_rows_are_folded_and_states_follow_a_plain_loop(spark, monkeypatch):
    rnd, hour = random.Random(9), 3_600_000
    rows = [(s, "1h", 1_000 + i * 7 * hour, f"{s}{i}", rnd.choice([None, -5.0, 80.0, 120.0]), rnd.uniform(0, 140), rnd.choice([None, -4.0, -1.0, 0.5, 3.0]))
            for s in ("A", "B", None) for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, open_time long, position_id string, equity double, gross_exposure double, total_pnl double")
    df = df.select("*", F.col("gross_exposure").alias("net_exposure"), F.col("total_pnl").alias("realized_pnl"), F.lit(0.0).alias("unrealized_pnl"))
    folded = []
    fold = ledger.fold_ordered

    def watched(rows_, *args):
        folded.append(rows_.select("position_id").collect())
        return fold(rows_, *args)

    monkeypatch.setattr(ledger, "fold_ordered", watched)
    got = {r.position_id: r for r in ledger.portfolio_risk(df.repartition(5)).collect()}
    assert len(got) == len(rows)
    losses, state = set(), {}
    for symbol, _, time, name, equity, gross, pnl in rows:
        until, peak = state.get(symbol, (None, 0.0))
        peak = max(peak, equity or 0.0)
        positive = equity is not None and equity > 0
        loss = pnl is not None and (pnl <= -0.02 * equity if positive else pnl < 0)
        if loss:
            losses.add(name)
        if until is not None and time >= until:
            until = None
        if until is not None:
            want = ("SHUTDOWN", "COOLDOWN", until)
        elif loss:
            until = time + 24 * hour
            want = ("SHUTDOWN", "DAILY_LOSS_LIMIT", until)
        elif (gross / equity > 1.0) if positive else gross > 0:
            want = ("WARNING", "EXPOSURE_LIMIT", None)
        else:
            want = ("NORMAL", "", None)
        state[symbol] = (until, peak)
        row = got[name]
        assert (row.portfolio_risk_state, row.shutdown_reason, row.cooldown_until) == want
        drop = max((peak - equity) / peak, 0.0) if equity is not None and peak else 0.0
        assert row.daily_drawdown_pct == pytest.approx(drop)
    assert {r.position_id for r in folded[0]} == losses and len(losses) < len(rows)
