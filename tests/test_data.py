import json

import pytest
from helpers import DAY, START, bars
from pyspark.sql import functions as F

from barloom.operators import asof, cleaning, validation
from barloom.plans.stages import StageStore
from barloom.sources import payloads, tables


def test_cleaning_takes_the_first_failing_rule(spark):
    rows = [
        ("A", "1d", 1, 2, 1.0, 2.0, 0.5, 1.5, 1.0, 1.0, 1), ("A", "1d", 1, 2, 1.0, 2.0, 0.5, 1.5, 1.0, 1.0, 1),
        ("A", "1d", 3, 4, None, 2.0, 0.5, 1.5, -1.0, 1.0, 1), ("A", "1d", 5, 6, 1.0, 0.4, 0.5, 1.5, -1.0, 1.0, 1),
        ("A", "1d", 7, 8, 1.0, 2.0, 0.5, float("nan"), 1.0, 1.0, 1), ("A", "1d", 9, 9, 1.0, 2.0, 0.5, 1.5, 1.0, 1.0, 1),
        ("A", "1d", 11, 12, 1.0, 2.0, 0.5, 1.5, 1.0, 1.0, -1),
    ]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, open_time long, close_time long, open double, high double, "
                               "low double, close double, volume double, quote_volume double, trade_count long")
    report = {r.stage: r.rows for r in cleaning.removal_report(df, "ohlcv").collect()}
    assert report == {"input_rows": 7, "duplicate": 1, "missing_value": 2, "invalid_price": 1, "negative_volume": 0,
                      "negative_trade_count": 1, "invalid_time": 1, "kept": 1}
    assert cleaning.clean(df, "ohlcv").count() == 1


def test_companion_copies_keep_the_first_arrival(spark):
    df = spark.createDataFrame([("A", 10, 5.0, 2), ("A", 10, 9.0, 1), ("B", 10, -1.0, 1)], "symbol string, timestamp long, open_interest double, seq int")
    assert [tuple(r) for r in cleaning.clean(df, "open_interest", arrival="seq").collect()] == [("A", 10, 9.0)]


def test_asof_matches_equal_times_and_carries_null_values(spark):
    frame = bars(spark, [1.0] * 6)
    side = spark.createDataFrame([("A", START + DAY, 1.0), ("A", START + 2 * DAY + 500, None), ("A", START + 4 * DAY + 500, 3.0)],
                                 "symbol string, timestamp long, open_interest double")
    def run(floor):
        out = asof.asof_join(frame, [asof.Companion("oi", side, "timestamp", {"open_interest": "oi"}, floor_to_second=floor)])
        return [r.oi for r in out.orderBy("open_time").collect()]
    assert run(False) == [None, 1.0, 1.0, None, None, 3.0]
    assert run(True) == [None, 1.0, None, None, 3.0, 3.0]


def test_asof_stops_at_the_turn_of_the_year(spark):
    frame = bars(spark, [1.0, 1.0], start=START - DAY).withColumn("year", F.when(F.col("open_time") < START, 2019).otherwise(2020))
    side = spark.createDataFrame([("A", START - 2 * DAY, 4.0)], "symbol string, timestamp long, v double")
    companion = asof.Companion("s", side, "timestamp", {"v": "v"})
    assert [r.v for r in asof.asof_join(frame, [companion]).orderBy("open_time").collect()] == [4.0, None]
    assert [r.v for r in asof.asof_join(frame, [companion], by_year=False).orderBy("open_time").collect()] == [4.0, 4.0]


def test_gaps(spark):
    frame = bars(spark, [1.0] * 8).filter((F.col("open_time") - START) / DAY != 3).filter(~((F.col("open_time") - START) / DAY).isin(5, 6))
    assert [(r.gap_count, r.missing_bars, r.largest_gap) for r in validation.gap_summary(frame).collect()] == [(2, 3, 2)]
    assert sorted((r.open_time - START) // DAY for r in validation.missing_bars(frame).collect()) == [3, 5, 6]


def test_missing_ranges_cover_edges_and_absent_series(spark):
    frame = bars(spark, [1.0] * 3, start=START + 2 * DAY)
    expected = spark.createDataFrame([("A", "1d", START, START + 9 * DAY), ("B", "1d", START, START + DAY)],
                                     "symbol string, timeframe string, first_expected long, last_expected long")
    got = {(r.symbol, (r.start - START) // DAY, (r.end - START) // DAY, r.bars) for r in tables.missing_ranges(frame, expected).collect()}
    assert got == {("A", 0, 1, 2), ("A", 5, 9, 5), ("B", 0, 1, 2)}


def test_weekly_bars_align_to_monday(spark):
    monday = 1_577_664_000_000 + 7 * DAY - 2 * DAY + 2 * DAY  # 2020-01-06
    frame = bars(spark, [1.0, 1.0], start=monday, step=DAY, timeframe="1w")
    frame = frame.withColumn("quote_volume", F.lit(1.0)).withColumn("trade_count", F.lit(1)).withColumn("close_time", F.col("open_time") + 1)
    report = {r.issue: r["count"] for r in validation.issue_report(frame).collect()}
    assert report.get("misaligned_time") == 1


def test_upsert_replaces_rows_and_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "bars")
    columns = ["symbol", "timeframe", "open_time", "year", "close"]
    old = bars(spark, [1.0, 2.0]).select(*columns).union(bars(spark, [5.0], start=START - DAY).withColumn("year", F.lit(2019)).select(*columns))
    tables.upsert(spark, old, path, ["symbol", "timeframe", "open_time"])
    tables.upsert(spark, bars(spark, [9.0, 7.0], start=START + DAY).select(*columns), path, ["symbol", "timeframe", "open_time"])
    got = {((r.open_time - START) // DAY): r.close for r in spark.read.parquet(path).collect()}
    assert got == {-1: 5.0, 0: 1.0, 1: 9.0, 2: 7.0}
    plan = tables.read_panel(spark, path, columns=["symbol", "close"], start=START)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(open_time" in plan and "ReadSchema: struct<symbol:string,open_time:bigint,close:double>" in plan


def test_conform_rejects_missing_columns(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    with pytest.raises(ValueError, match="b"):
        tables.conform(spark.range(1).select(F.col("id").alias("a")), schema)
    assert tables.conform(spark.range(1).select(F.lit("2").alias("b"), "id", F.lit(1).alias("a")), schema).columns == ["a", "b"]


def test_csv_export_joins_lists(spark, tmp_path):
    df = spark.createDataFrame([("y", ["a", "b"]), ("x", ["c"])], "id string, names array<string>")
    tables.export_csv(df, str(tmp_path / "out"), ["id"])
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert {(r.id, r.names) for r in got} == {("x", "c"), ("y", "a|b")}


def test_kline_payload_accepts_numbers_and_strings(spark):
    rows = [("A", "1d", json.dumps([1, "2.5", 3, "1", 2, "10", 99, "25", 7, "x"]))]
    bar = payloads.klines(spark.createDataFrame(rows, "symbol string, timeframe string, payload string")).first()
    assert (bar.open_time, bar.open, bar.close_time, bar.trade_count, bar.quote_volume) == (1, 2.5, 99, 7, 25.0)


def test_stage_table_is_built_once(spark, tmp_path):
    calls = []
    store = StageStore(spark, str(tmp_path))
    build = lambda: calls.append(1) or spark.range(3)
    assert store.table("a", build).count() == 3 and store.table("a", build).count() == 3
    assert len(calls) == 1
