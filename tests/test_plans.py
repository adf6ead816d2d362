import numpy as np
from pyspark.sql import functions as F

from barloom.checks import tables
from barloom.plans.research import ResearchRun, ResearchTables
from barloom.plans.stages import StageStore
from barloom.sources.tables import read_table
from barloom.streaming.ingest import load_new_bars

SF = "/root/testdata/sf0.001"


def test_research_run_reaches_alpha_and_folds(spark, tmp_path):
    raw = ResearchTables(tables.bars_1d(spark, SF), tables.funding_w(spark, SF), tables.oi_w(spark, SF), tables.taker_w(spark, SF), tables.ls_w(spark, SF))
    run = ResearchRun(StageStore(spark, str(tmp_path)), raw, ["momentum", "price_zscore", "open_interest_zscore", "relative_volume"], top_n=3, candidate_n=4)
    chosen = run.selection().filter("selected").count()
    assert 1 <= chosen <= 3
    assert run.walk_forward().count() > 0 and run.purged().count() == 5
    assert run.alpha().select("combination_id").distinct().count() == run.orthogonal().filter("selected").count()


def test_incremental_load_is_idempotent(spark, tmp_path):
    columns = ["symbol", "timeframe", "open_time", "close_time", "open", "high", "low", "close", "volume", "quote_volume", "trade_count"]
    bars = tables.bars_1h(spark, SF).select(*columns)
    cut = bars.agg(F.percentile("open_time", F.lit(0.6))).first()[0]
    incoming, table, checkpoint = (str(tmp_path / n) for n in ("incoming", "table", "checkpoint"))
    bars.filter(F.col("open_time") <= cut).write.mode("append").parquet(incoming)
    load_new_bars(spark, incoming, bars.schema, table, checkpoint)
    first = read_table(spark, table).count()
    bars.filter(F.col("open_time") > cut - 7_200_000).write.mode("append").parquet(incoming)
    for _ in range(2):
        load_new_bars(spark, incoming, bars.schema, table, checkpoint)
    stored = read_table(spark, table)
    assert 0 < first < stored.count() == bars.count()
    assert stored.select("symbol", "timeframe", "open_time").distinct().count() == bars.count()
    assert np.isclose(stored.agg(F.sum("close")).first()[0], bars.agg(F.sum("close")).first()[0])
