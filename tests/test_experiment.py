"""Experiments, rolling windows and universe runs against plain Python."""

import math
import random
from statistics import fmean, median, stdev

import pytest
from pyspark.sql import functions as F

from barloom.operators import experiment

RETURNS = {1: "future_return_1", 5: "future_return_5"}


def keep(name, df):
    return df


def ranks(x):
    order = sorted(x)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in x]


def corr(x, y):
    if len(x) < 2 or len(set(x)) < 2 or len(set(y)) < 2:
        return None
    a, b = fmean(x), fmean(y)
    return sum((p - a) * (q - b) for p, q in zip(x, y)) / math.sqrt(sum((p - a) ** 2 for p in x) * sum((q - b) ** 2 for q in y))


def rows_of(seed, times=40, symbols=3, factors=("f", "g")):
    rnd = random.Random(seed)
    return [(f"S{s}", "1d", t * 10, f, rnd.choice([None, 0.0, -0.0, 1.0, 2.5, rnd.random()]), rnd.choice([None, rnd.uniform(-1, 1), 0.5]), rnd.uniform(-1, 1))
            for t in range(times) for s in range(symbols) for f in factors]


def panel_of(spark, rows):
    return spark.createDataFrame(rows, "symbol string, timeframe string, open_time long, factor_name string, factor_value double, future_return_1 double, future_return_5 double")


def pairs(rows, factor, column):
    return sorted((r[2], r[0], r[4], r[column]) for r in rows if r[3] == factor and r[4] is not None and r[column] is not None)


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


def spread_of(found):
    placed = sorted(found, key=lambda r: (r[2], r[0], r[1]))
    buckets = {}
    for i, r in enumerate(placed):
        buckets.setdefault(i * 5 // len(placed) + 1, []).append(r[3])
    return buckets


def test_experiment_equals_plain_statistics(spark):
    rows = rows_of(1)
    panel = panel_of(spark, rows)
    wide = panel.groupBy("symbol", "timeframe", "open_time").pivot("factor_name", ["f", "g"]).agg(F.first("factor_value"))
    found = experiment.tidy(experiment.experiment(panel, wide, ["f", "g"], RETURNS, keep, block=30))
    got = {(r.factor_name, r.statistic, r.other, r.part): r.value for r in found.collect()}
    for f in "fg":
        for h, column in ((1, 5), (5, 6)):
            own = pairs(rows, f, column)
            x, y = [r[2] for r in own], [r[3] for r in own]
            assert close(got[f, "decay_ic", None, h], corr(ranks(x), ranks(y)))
            if h == 1:
                assert got[f, "pairs", None, None] == len(own) and close(got[f, "ic", None, None], corr(x, y)) and close(got[f, "rank_ic", None, None], corr(ranks(x), ranks(y)))
                buckets = spread_of(own)
                for q, values in buckets.items():
                    assert got[f, "quantile_count", None, q] == len(values) and close(got[f, "quantile_mean", None, q], fmean(values))
                    assert close(got[f, "quantile_median", None, q], median(values)) and close(got[f, "quantile_std", None, q], stdev(values))
                assert close(got[f, "spread", None, None], fmean(buckets[5]) - fmean(buckets[1]))
        every = sorted((r[2], r[0], r[4], r[5]) for r in rows if r[3] == f)
        ics = []
        for k in range(0, len(every) - len(every) % 30, 30):
            block = [r for r in every[k:k + 30] if r[2] is not None and r[3] is not None]
            ics.append(corr(ranks([r[2] for r in block]), ranks([r[3] for r in block])))
        assert got[f, "stability_blocks", None, None] == len(ics) and close(got[f, "stability_mean_ic", None, None], fmean(ics))
    cells = {}
    for r in rows:
        cells.setdefault((r[2], r[0]), {})[r[3]] = r[4]
    both = [c for c in cells.values() if None not in c.values()]
    assert close(got["f", "pair_corr", "g", None], corr(ranks([c["f"] for c in both]), ranks([c["g"] for c in both])))


def test_a_single_factor_has_no_pairs_and_bad_input_is_refused(spark):
    panel = panel_of(spark, rows_of(2, times=5, factors=("f",)))
    found = experiment.experiment(panel, None, ["f"], RETURNS, keep)
    assert found.correlations is None and experiment.tidy(found).filter("statistic = 'rank_ic'").count() == 1
    assert experiment.tidy(experiment.experiment(panel.limit(0), None, ["f"], RETURNS, keep)).count() == 0
    for bad in ({"factors": []}, {"primary": 3}):
        with pytest.raises(ValueError):
            experiment.experiment(panel, None, bad.get("factors", ["f"]), RETURNS, keep, primary=bad.get("primary", 1))


@pytest.mark.parametrize(("train", "test", "step"), [(10, 8, 3), (5, 5, 5), (30, 20, 1)])
def test_rolling_windows_overlap_and_are_complete(spark, train, test, step):
    rows = rows_of(3)
    got = {(r.window, r.factor_name): r for r in experiment.rolling(panel_of(spark, rows), "future_return_1", train, test, step, keep).collect()}
    want = {}
    for k in range(max(0, (40 - train - test) // step + 1)):
        for f in "fg":
            own = [r for r in pairs(rows, f, 5) if train + k * step <= r[0] // 10 < train + test + k * step]
            want[k, f] = own
    assert set(got) == set(want)
    for key, own in want.items():
        x, y = [r[2] for r in own], [r[3] for r in own]
        assert got[key].pairs == len(own) and close(got[key].ic, corr(x, y)) and close(got[key].rank_ic, corr(ranks(x), ranks(y)))
        buckets = spread_of(own)
        assert close(got[key].spread, fmean(buckets[5]) - fmean(buckets[1]))
    summary = experiment.rolling_summary(experiment.rolling(panel_of(spark, rows), "future_return_1", train, test, step, keep)).collect()
    windows = sorted({k for k, _ in want})
    ics = [[got[k, f].ic for f in "fg" if got[k, f].ic is not None] for k in windows]
    per_window = [fmean(x) for x in ics if x]
    assert [r.windows for r in summary] == ([len(windows)] if windows else [])
    if per_window:
        sd = stdev(per_window) if len(per_window) > 1 else 0.0
        assert close(summary[0].mean_ic, fmean(per_window)) and close(summary[0].stability, max(0.0, min(1.0, 1 - sd / abs(fmean(per_window)))))


def test_universe_lists_completed_and_skipped_runs(spark):
    rows = rows_of(4, times=12, symbols=2, factors=("f",))
    rows += [("S0", "1d", t * 10, "flat", 1.0, 0.1 * t, None) for t in range(5)] + [("S0", "1d", 0, "one", 1.0, 0.1, 0.2), ("S0", "1d", 0, "none", None, 0.1, 0.2)]
    panel = panel_of(spark, rows)
    universe = spark.createDataFrame([(f, s, "1d") for f in ("f", "flat", "one", "none", "absent") for s in ("S0", "S1")], "factor_name string, symbol string, timeframe string")
    runs = experiment.universe_runs(panel, universe, RETURNS, keep)
    got = {(r.factor_name, r.symbol, r.horizon): (r.status, r.stage, r.reason) for r in runs.collect()}
    assert len(got) == 20 and got["f", "S1", 5] == ("COMPLETED", None, None)
    assert got["flat", "S0", 1] == ("SKIPPED", "analyze", "CONSTANT") and got["flat", "S0", 5] == ("SKIPPED", "analyze", "TOO_FEW_PAIRS")
    assert got["one", "S0", 1] == ("SKIPPED", "analyze", "TOO_FEW_PAIRS") and got["one", "S1", 1] == got["none", "S0", 1] == ("SKIPPED", "compute", "NO_VALUES")
    board = {r.factor_name: r for r in experiment.universe_leaderboard(runs).collect()}
    assert board["f"].place == 1 and board["f"].completed == 4 and board["absent"].failed_compute == 4 and board["flat"].failed_analyze == 2


def test_audit_finds_one_overlap_and_one_duplicate_at_all_levels(spark):
    from barloom.operators import stability

    def row(symbol, timeframe, time, fold, partition="OOS", value=0.5):
        return (symbol, timeframe, time, "f", "1", fold, partition, True, "PASS", value)

    rows = [row(s, tf, t, 1 + t // 4) for s in ("A", "B") for tf in ("1d", "1h") for t in range(8)]
    rows.append(row("A", "1d", 2, 1))  # once more
    rows.append(row("A", "1d", 5, 1))  # the first window now ends inside the second
    rows.append(row("B", "1h", 6, 2, "TRAIN", None))  # a train row inside its fold's test window
    names = "symbol string, timeframe string, open_time long, factor_name string, factor_version string, fold int, partition string, selected boolean, status string, future_return_1 double"
    got = {(r.level, r.symbol, r.timeframe): r for r in stability.observation_audit(spark.createDataFrame(rows, names)).collect()}
    assert len(got) == 4 + 2 + 1
    for level in (("symbol", "A", "1d"), ("timeframe", None, "1d")):
        assert (got[level].duplicates, got[level].overlapping_windows, got[level].train_rows_in_test, got[level].status) == (1, 1, 0, "FAIL")
        assert got[level].error == "duplicates; overlapping_windows"
    assert got["symbol", "B", "1h"].error == got["timeframe", None, "1h"].error == "train_rows_in_test"
    assert got["symbol", "B", "1d"].status == got["symbol", "A", "1h"].status == "PASS"
    total = got["total", None, None]
    assert (total.rows, total.duplicates, total.overlapping_windows, total.train_rows_in_test, total.unique_folds, total.return_null, total.oos_rows) == (35, 1, 1, 1, 4, 1, 34)
    assert stability.observation_audit(spark.createDataFrame([], names)).count() == 0
