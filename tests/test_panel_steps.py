"""Panels grow with bars times factors: what is shuffled, sorted and written on the way to fold metrics stays narrow."""

import pytest
from pyspark.sql import functions as F

from barloom.checks import q_folds, q_panel
from barloom.functions import stats
from barloom.operators import factor_tests, folds
from barloom.operators.factors import factor_long
from barloom.operators.panel import validation_panel

BAR = "symbol string, timeframe string, open_time long"


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    where = f"{tmp_path_factory.mktemp('panel')}/panel"
    spark.range(400).select(
        F.concat(F.lit("S"), (F.col("id") % 5).cast("string")).alias("symbol"), F.lit("1d").alias("timeframe"), F.floor(F.col("id") / 10).alias("open_time"),
        F.when(F.col("id") % 10 < 5, "f").otherwise("g").alias("factor_name"), F.lit("1").alias("factor_version"),
        F.when(F.col("id") % 10 < 5, "old").otherwise("new").alias("factor_category"),
        F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id"), F.lit(9)) / 4.0).alias("factor_value"), F.sin("id").alias("future_return_1"),
    ).write.parquet(where)
    return spark.read.parquet(where)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_join_before_they_become_long_rows(spark):
    rows = [("A", "1d", 1, 1.0, None), ("A", "1d", 1, 1.5, 2.0), ("A", "1d", 2, 3.0, 4.0), ("B", "1d", 1, float("nan"), 5.0), (None, "1d", 1, 6.0, 7.0), ("C", "1d", 1, 8.0, 9.0)]
    wide = spark.createDataFrame(rows, f"{BAR}, momentum double, atr_percent double")
    labels = spark.createDataFrame([("A", "1d", 1, 0.1, 1), ("A", "1d", 1, 0.2, 1), ("A", "1d", 2, None, 0), ("B", "1d", 1, 0.4, 1), (None, "1d", 1, 0.5, 1)],
                                   f"{BAR}, future_return_1 double, direction_1 int")
    before = validation_panel(factor_long(wide), labels)
    after = validation_panel(wide, labels, factor_long)
    assert after.columns == before.columns and sorted(map(str, after.collect())) == sorted(map(str, before.collect()))
    steps = plan(after)
    assert steps.index("Expand") < steps.index("Exchange") < steps.index("SortMergeJoin")


def test_coverage_sorts_no_rows(panel):
    got = factor_tests.coverage(panel.filter("open_time > 3 or factor_name = 'f'"))
    assert "HashAggregate" in [line for line in plan(got).splitlines() if "Aggregate(" in line][-1]
    rows = {r.factor_name: r for r in got.collect()}
    used = panel.filter("factor_value is not null")
    assert (rows["f"].factor_category, rows["f"].validation_start_time, rows["f"].validation_end_time) == ("old", 0, 39)
    assert (rows["g"].factor_category, rows["g"].validation_start_time, rows["g"].observations) == ("new", 4, used.filter("factor_name = 'g' and open_time > 3").count())
    # The category of the last bar counts, and a bar without a time does not.
    mixed = panel.withColumn("factor_category", F.when(F.col("open_time") == 39, "last").otherwise("early")).withColumn(
        "open_time", F.when(F.col("open_time") != 38, F.col("open_time")))
    assert {r.factor_category for r in factor_tests.coverage(mixed).collect()} == {"last"}


def test_numbers_lead_the_sorts(panel):
    keys = ["factor_name", "factor_version", "timeframe"]
    assert "Sort [_bin" in plan(stats.value_ranks(panel, keys, "factor_value"))
    indexed = stats.with_row_index(panel, ["timeframe"], "open_time", ["symbol", "factor_name"])
    assert "Sort [open_time" in plan(indexed) and indexed.columns[:2] == ["timeframe", "open_time"] and indexed.columns[-1] == "row_id"
    order = sorted(panel.collect(), key=lambda r: (r.open_time, r.symbol, r.factor_name))
    assert [(r.open_time, r.symbol, r.factor_name) for r in sorted(indexed.collect(), key=lambda r: r.row_id)] == [(r.open_time, r.symbol, r.factor_name) for r in order]
    for table in (factor_tests.quantile_statistics(panel), factor_tests.turnover(panel)):
        assert "Sort [open_time" in plan(table)


def test_walk_indexes_only_what_fold_metrics_read(spark, monkeypatch, panel):
    evaluation = panel.withColumns({"selection_time": F.col("open_time"), "selected": F.col("factor_name") == "f", "selected_direction": F.lit(1)})
    monkeypatch.setattr(q_folds, "evaluated", lambda s, d: evaluation)
    rows = q_folds.fold_returns(spark, "rows made by test_walk")
    assert set(rows.columns) == {"timeframe", "selection_time", "selected", "future_return_1", "row_id"}
    full = folds.walk_forward(folds.fold_metrics(folds.indexed(evaluation)))
    got = q_folds.walk(spark, "rows made by test_walk")
    assert got.count() > 1 and sorted(map(str, got.drop("train_score", "test_score", "overfit_gap").collect())) == sorted(
        map(str, full.drop("train_score", "test_score", "overfit_gap").collect()))


def test_the_evaluation_is_no_second_copy_of_the_panel(spark, monkeypatch, panel):
    chosen = spark.createDataFrame([("f", "1", "1d", True, -0.5, 0.1)], "factor_name string, factor_version string, timeframe string, selected boolean, information_coefficient double, rank_information_coefficient double")
    monkeypatch.setattr(q_panel, "panel", lambda s, d: panel)
    monkeypatch.setattr(q_panel, "selected", lambda s, d: chosen)
    rows = q_panel.evaluated(spark, "rows made by test_evaluation")
    assert rows.inputFiles() == panel.inputFiles() and {r.selected_direction for r in rows.collect()} == {-1}
