"""Ranks have about as many rows as the values ranked: they are joined by shuffles, however small the files of the values look."""

import pytest
from pyspark.sql import functions as F

from barloom.functions import stats
from barloom.operators import experiment


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    where = f"{tmp_path_factory.mktemp('ranks')}/panel"
    value = F.pmod(F.xxhash64("id"), F.lit(50)) / 7.0
    spark.range(600).select(
        F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("symbol"), F.lit("1d").alias("timeframe"), F.col("id").alias("open_time"), F.lit("f").alias("factor_name"),
        F.lit("1").alias("factor_version"), value.alias("factor_value"), F.sin("id").alias("future_return_1"), F.cos("id").alias("future_return_5")).write.parquet(where)
    return spark.read.parquet(where)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_rank_layer_broadcasts_no_ranks(panel):
    layer = experiment.rank_layer(panel, ["symbol", "timeframe"], {1: "future_return_1", 5: "future_return_5"})
    assert "Broadcast" not in plan(layer) and layer.count() == 1200


def test_universe_runs_keep_their_results(panel):
    returns = {1: "future_return_1", 5: "future_return_5"}
    runs = experiment.universe_runs(panel, panel.select("factor_name", "symbol", "timeframe"), returns, lambda name, df: df).collect()
    assert len(runs) == 6 and all(r.status == "COMPLETED" and r.pairs == 200 for r in runs)
    frame = panel.toPandas()
    for r in runs:
        own = frame[frame["symbol"] == r.symbol]
        assert r.rank_ic == pytest.approx(own["factor_value"].rank().corr(own[returns[r.horizon]].rank()), abs=1e-12)


def test_rank_correlations_and_ordinals_broadcast_no_ranks(panel):
    assert "Broadcast" not in plan(stats.spearman(panel, ["symbol"], "factor_value", "future_return_1"))
    assert "Broadcast" not in plan(stats.unpivoted_ranks(panel, ["open_time"], ["symbol"], ["future_return_1", "future_return_5"]))
    assert "Broadcast" not in plan(stats.with_ordinal(panel, ["timeframe"], "factor_value", "open_time", "symbol", "place"))


def test_a_constant_has_no_correlation_however_its_rows_are_dealt(spark):
    # 49 rows to a partition: the mean of 49 ones is merged as 49 * (1 / 49), which is less than one.
    rows = spark.range(0, 49 * 7 + 5, 1, 7).select(F.lit(1.0).alias("x"), F.sin("id").alias("y"), F.cos("id").alias("z"))
    for n in (1, 3, 7, 49):
        dealt = rows.repartition(n)
        got = dealt.agg(stats.pearson(F.col("x"), F.col("y")).alias("xy"), stats.pearson(F.col("y"), F.col("x")).alias("yx"), stats.pearson(F.col("y"), F.col("z")).alias("yz")).first()
        assert got.xy is None and got.yx is None and -1 < got.yz < 1
