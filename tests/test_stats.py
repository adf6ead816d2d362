import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import stats
from barloom.functions.pairwise import greedy_decisions, pair_correlations


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    frame = pd.DataFrame({
        "k": rng.choice(["a", "b"], 500, p=[0.8, 0.2]),
        # A third of the values tie at zero; both signs and several magnitudes occur.
        "x": np.where(rng.random(500) < 0.34, 0.0, np.round(rng.normal(size=500) * 10.0 ** rng.integers(-3, 4, 500), 3)),
        "y": np.round(rng.normal(size=500), 1), "open_time": rng.integers(0, 40, 500), "symbol": rng.permutation(500).astype(str),
    })
    return frame, spark.createDataFrame(frame).repartition(5)


def test_value_ranks_match_average_ranks(data):
    frame, df = data
    got = {(r.k, r.x): r.avg_rank for r in stats.value_ranks(df, ["k"], "x").collect()}
    want = frame.assign(r=frame.groupby("k")["x"].rank())
    for row in want.itertuples():
        assert got[(row.k, row.x + 0.0)] == row.r


def test_spearman(data):
    frame, df = data
    got = {r.k: r.rank_ic for r in stats.spearman(df, ["k"], "x", "y").collect()}
    for k, part in frame.groupby("k"):
        assert got[k] == pytest.approx(part["x"].rank().corr(part["y"].rank()), abs=1e-12)


def test_ordinal_ranks(data):
    frame, df = data
    got = {r.symbol: r.place for r in stats.with_ordinal(df, ["k"], "x", "open_time", "symbol", "place").collect()}
    ordered = frame.sort_values(["k", "x", "open_time", "symbol"])
    want = dict(zip(ordered["symbol"], ordered.groupby("k").cumcount() + 1))
    assert got == want


def test_quantiles(data):
    frame, df = data
    probabilities = [0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r.quantiles for r in stats.quantiles(df, ["k"], "x", probabilities).collect()}
    for k, part in frame.groupby("k"):
        assert got[k] == pytest.approx(list(part["x"].quantile(probabilities)), abs=1e-9)
    whole = stats.quantiles(df, [], "x", probabilities).first().quantiles
    assert whole == pytest.approx(list(frame["x"].quantile(probabilities)), abs=1e-9)


def test_row_index_is_dense_and_ordered(data):
    frame, df = data
    got = {r.symbol: r.row_id for r in stats.with_row_index(df, ["k"], "open_time", ["symbol"]).collect()}
    ordered = frame.sort_values(["k", "open_time", "symbol"])
    assert got == dict(zip(ordered["symbol"], ordered.groupby("k").cumcount()))


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 9.0)], "x double, y double")
    assert df.agg(stats.pearson(F.col("x"), F.col("y"))).first()[0] is None


def test_student_t_tail(spark):
    # Textbook critical values: the two-sided tail at these statistics.
    rows = [(12.706204736, 1.0, 0.05), (2.228138852, 10.0, 0.05), (2.750, 30.0, 0.0100), (0.0, 5.0, 1.0), (1.959963985, 1e6, 0.05)]
    df = spark.createDataFrame(rows, "t double, d double, p double").withColumn("got", stats.t_p_value(F.col("t"), F.col("d")))
    for r in df.collect():
        assert r.got == pytest.approx(r.p, abs=2e-5)
    assert spark.createDataFrame([(None, 3.0)], "t double, d double").select(stats.t_p_value(F.col("t"), F.col("d"))).first()[0] is None


def test_pair_correlations_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 4)) * [1, 1000, 1e-3, 1] + [0, 1e6, 0, 5]
    base[:, 3] = 5.0
    base[rng.random((400, 4)) < 0.1] = np.nan
    base[:, 3] = 5.0
    frame = pd.DataFrame(base, columns=list("abcd")).assign(g="t")
    for parts in (1, 6):
        df = spark.createDataFrame(frame).repartition(parts)
        got = {(r.a, r.b): (r.overlap, r.abs_corr) for r in pair_correlations(df, "g", list("abcd")).collect()}
        for i in range(4):
            for j in range(i + 1, 4):
                both = np.isfinite(base[:, i]) & np.isfinite(base[:, j])
                assert got[(i, j)][0] == both.sum()
                if j == 3:
                    assert got[(i, j)][1] is None
                else:
                    assert got[(i, j)][1] == pytest.approx(abs(np.corrcoef(base[both, i], base[both, j])[0, 1]), rel=1e-9)


def test_greedy_walk_compares_with_accepted_candidates_only(spark):
    # 1 falls to 0; 2 is close to 1 only, so it stays; 3 falls to the first accepted that is close.
    pairs = spark.createDataFrame(
        [("t", 0, 1, 900, 0.95), ("t", 1, 2, 900, 0.99), ("t", 0, 3, 900, 0.91), ("t", 2, 3, 900, 0.99), ("t", 0, 4, 10, 0.99)],
        "g string, a int, b int, overlap long, abs_corr double")
    candidates = spark.createDataFrame([("t", i) for i in range(5)], "g string, position int")
    got = {r.position: (r.rejected, r.reference) for r in greedy_decisions(pairs, candidates, "g", 0.9, 500).collect()}
    assert got == {0: (False, None), 1: (True, 0), 2: (False, None), 3: (True, 0), 4: (False, None)}


@pytest.mark.parametrize("partitions", [1, 200])
def test_ranks_order_nan_infinities_and_signed_zeros(spark, partitions):
    nan, inf = float("nan"), float("inf")
    x = [0.0, -0.0, nan, inf, -inf, 1.0, 1.0, -2.5, nan, 1e-310, inf]
    y = [float(i * 7 % 11) for i in range(len(x))]
    df = spark.createDataFrame(list(zip(["k"] * len(x), x, y)), "k string, x double, y double").repartition(partitions)

    def place(v):  # Spark's order: NaN above everything, both zeros equal
        return (1, 0.0) if v != v else (0, v + 0.0)

    def ranks(values):
        return [sum(place(w) < place(v) for w in values) + (sum(place(w) == place(v) for w in values) + 1) / 2 for v in values]

    want = float(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert stats.spearman(df, ["k"], "x", "y").first().rank_ic == pytest.approx(want, abs=1e-12)
    got = stats.quantiles(df, ["k"], "x", [0.0, 0.1, 0.5, 0.8, 1.0]).first().quantiles
    ordered = sorted(x, key=place)
    assert got[0] == -inf and got[1] == -2.5 and got[2] == ordered[5] and got[3] == inf and got[4] != got[4]


def test_global_index_has_no_window_over_all_rows(spark):
    import random

    rnd = random.Random(2)
    rows = [(rnd.choice("abc"), rnd.choice(["1d", "1h"]), rnd.choice([-5, 0, 7, 1 << 33, 1 << 40, (1 << 40) + 3]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, open_time long, n long")
    for buckets, order in ((["open_time"], ["symbol", "timeframe", "n"]), (["symbol", "timeframe", "open_time"], ["n"])):
        got = stats.with_global_index(df, buckets, order)
        at = {c: i for i, c in enumerate(df.columns)}
        want = sorted(rows, key=lambda r: [r[at[c]] for c in (*buckets, *order)])
        assert [(r.symbol, r.timeframe, r.open_time, r.n) for r in sorted(got.collect(), key=lambda r: r.row_id)] == want
        assert sorted(r.row_id for r in got.collect()) == list(range(300))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not any("Window" in a and "SinglePartition" in b for a, b in zip(plan.splitlines(), plan.splitlines()[2:]))
