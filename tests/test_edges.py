"""Inputs that an earlier reading of the rules got wrong."""

import pytest
from helpers import DAY, START
from pyspark.errors import AnalysisException

from barloom.functions.ordered import fold_ordered
from barloom.functions.pairwise import pair_correlations
from barloom.operators import combination, panel_checks, research, stability
from barloom.operators.asof import Companion, asof_join
from barloom.plans import stages
from barloom.sources import tables


@pytest.mark.parametrize("turned", [False, True])
def test_last_companion_of_a_second_counts(spark, turned):
    rows = [("A", 4_100, 0.1), ("A", 4_900, 0.9), ("A", 4_900, 0.2)]
    funding = spark.createDataFrame(rows[::-1] if turned else rows, "symbol string, t long, rate double").repartition(3)
    df = spark.createDataFrame([("A", "1d", 4_000, 1970), ("A", "1d", 9_000, 1970)], "symbol string, timeframe string, open_time long, year int")
    got = asof_join(df, [Companion("f", funding, "t", {"rate": "rate"}, floor_to_second=True)], by_year=False)
    assert [r.rate for r in got.orderBy("open_time").collect()] == [0.9, 0.9]


def test_blocks_are_cut_before_nulls_go(spark):
    rows = [("f", "1.0.0", "1d", "A", i, None if i in (1, 2) else float(i % 5), float(i * 3 % 7)) for i in range(25)]
    df = spark.createDataFrame(rows, "factor_name string, factor_version string, timeframe string, symbol string, open_time long, factor_value double, future_return_1 double")
    got = research.stability(df, ["factor_name"], block=10).first()
    assert got.blocks == 2


def test_classes_use_the_raw_folds_and_the_rank_ic(spark):
    rows = [("1d", "f", "1.0.0", i, v, -v, 0.2, -0.3) for i, v in enumerate((0.1, 0.2))]
    ics = spark.createDataFrame(rows, "timeframe string, factor_name string, factor_version string, fold int, oriented_oos_ic double, raw_oos_ic double,"
                                      " selection_ic double, selection_rank_ic double")
    got = stability.classified(stability.factor_stability(ics)).first()
    assert (got.orientation_class, got.in_out_class) == ("ORIENTATION_REVERSAL_CANDIDATE", "IS_NEGATIVE_OOS_NEGATIVE")


def test_findings_leave_negative_infinity_out(spark):
    inf = float("inf")
    rows = [("A", "1d", i * DAY, "f", "1.0.0", "c", v) for i, v in enumerate((1.0, inf, -inf, 2.0))]
    panel = spark.createDataFrame(rows, "symbol string, timeframe string, open_time long, factor_name string, factor_version string, factor_category string, factor_value double")
    assert {r.finding: r.rows for r in panel_checks.finding_totals(panel_checks.failure_findings(panel)).collect()} == {"POSITIVE_INFINITY": 1}


def test_the_last_arrival_of_a_load_stays(spark):
    stored = spark.createDataFrame([("a", 9, 0)], "k string, v int, n int")
    load = spark.createDataFrame([("a", 5, 1), ("a", 3, 2), ("b", 1, 1)], "k string, v int, n int")
    got = tables.merge_rows(stored, load, ["k"], arrival="n").collect()
    assert sorted((r.k, r.v) for r in got) == [("a", 3), ("b", 1)]


def test_an_unreadable_table_stops_the_load(spark, tmp_path):
    path = f"{tmp_path}/t"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "_SUCCESS").write_text("")
    df = spark.createDataFrame([("1d", 2020, 1)], "timeframe string, year int, v int")
    with pytest.raises(AnalysisException):
        tables.upsert(spark, df, path, ["v"])
    tables.upsert(spark, df, f"{tmp_path}/new", ["v"])
    tables.upsert(spark, df, f"{tmp_path}/new", ["v"])
    assert tables.read_table(spark, f"{tmp_path}/new").count() == 1
    assert not any((tmp_path / "new_staging").iterdir())


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stages.shared_folder(Session())


def test_no_combination_gives_an_empty_table(spark):
    combos = spark.createDataFrame([], "combination_id string, factor_names array<string>, factor_versions array<string>, factor_categories array<string>,"
                                       " timeframe string, combination_size int, combination_method string, stability_score double, confidence_score double,"
                                       " combination_score double, status string, combination_rank int")
    panel = spark.createDataFrame([("A", "1d", START, "f", "1.0.0", 1.0)], "symbol string, timeframe string, open_time long, factor_name string, factor_version string, factor_value double")
    assert combination.orthogonal_combinations(combos, panel).count() == 0


def test_null_and_nan_groups_are_groups(spark):
    rows = [(None, float(i), float(i * i)) for i in range(5)] + [("g", float(i), float(-i)) for i in range(5)]
    got = {r.g: r.overlap for r in pair_correlations(spark.createDataFrame(rows, "g string, x double, y double"), "g", ["x", "y"]).collect()}
    assert got == {None: 5, "g": 5}
    df = spark.createDataFrame([(float("nan"), i) for i in range(4)] + [(1.0, i) for i in range(3)], "k double, i int")
    counted = fold_ordered(df, ["k"], ["i"], ["i"], lambda state, row: ((state or 0) + 1, ((state or 0) + 1,)), "n long").collect()
    assert sorted(r.n for r in counted) == [1, 1, 2, 2, 3, 3, 4]
