"""Daily bars from small tables of their own: ties, nulls, and how tasks combine their rows."""

import datetime as dt
import random

import pytest

from barloom.checks import tables
from barloom.plans.stages import StageStore

LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, where = random.Random(5), tmp_path_factory.mktemp("bars")
    parts = [(k, "n", [None, "Brand#1", "Brand#2"][k % 3], "t", 1, 900.0 + k) for k in range(12)]
    # Few orders and line numbers, so that only the columns behind them tell the first and last trade of a day.
    lines = [(rnd.choice([None, 1, 1, 2, 3]), rnd.randrange(12), rnd.randrange(4), rnd.choice([None, 1, 2]), float(rnd.randint(1, 9)), float(rnd.randint(10, 99)),
              0.1, 0.2, rnd.choice("RAN"), rnd.choice("OF"), rnd.choice([None, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2), dt.datetime(2021, 5, 6)])) for _ in range(400)]
    lines += lines[:40]
    spark.createDataFrame(parts, PART).coalesce(1).write.parquet(f"{where}/part.parquet")
    spark.createDataFrame(lines, LINE).repartition(3).write.parquet(f"{where}/lineitem.parquet")
    return str(where), lines, {p[0]: p for p in parts}


def first_key(line):
    # Nulls first, as Spark orders a struct.
    return tuple((line[i] is not None, line[i] or 0) for i in (0, 3, 1, 2, 5, 4))


@pytest.mark.parametrize("extras", [False, True])
def test_daily_bars_equal_plain_python(spark, folder, extras):
    where, lines, parts = folder
    days = {}
    for line in lines:
        days.setdefault((parts[line[1]][2], line[10] and int(line[10].replace(tzinfo=dt.UTC).timestamp() * 1000)), []).append(line)
    got = {(r.symbol, r.open_time): r for r in tables.bars_1d(spark, where, extras=extras).collect()}
    assert set(got) == set(days) and any(k[0] is None for k in days) and any(k[1] is None for k in days)
    for key, own in days.items():
        price, bar = [x[5] / x[4] for x in own], got[key]
        ends = [x[5] / x[4] for x in (min(own, key=first_key), max(own, key=first_key))]
        assert (bar.open, bar.close, bar.high, bar.low, bar.trade_count) == (*ends, max(price), min(price), len(own))
        assert bar.volume == sum(x[4] for x in own) and bar.quote_volume == sum(x[5] for x in own)
        if extras:
            assert bar.long_liquidation_volume == sum(x[4] for x in own if x[8:10] == ("R", "O")) and bar.buy_trade_count == sum(x[9] == "O" for x in own)
            assert bar.vwap == bar.quote_volume / bar.volume and bar.total_liquidation_volume == sum(x[4] for x in own if x[8] == "R")


@pytest.mark.parametrize("extras", [False, True])
def test_only_trades_of_the_outer_orders_are_sorted(spark, folder, extras, monkeypatch):
    plans, write = [], StageStore.table

    def noted(self, name, build):
        def seen():
            df = build()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return df
        return write(self, name, seen)

    monkeypatch.setattr(StageStore, "table", noted)
    tables.forget_stages()
    tables.bars_1d(spark, folder[0], extras=extras)
    trades = [p for p in plans if "lineitem.parquet" in p]
    assert trades and all("SortAggregate" not in p or "_first" in p for p in trades)
