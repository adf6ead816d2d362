"""The checked training join, connected components and the redundancy verdict."""

import random

import pytest

from barloom.functions.graph import components
from barloom.operators import stability
from barloom.operators.training import TrainingError, key_faults, training_join

KEY = "symbol string, timeframe string, open_time long"


def keep(name, df):
    return df


def test_components_of_chains_and_random_edges(spark):
    rnd = random.Random(3)
    edges = [("1d", f"n{i:03d}", f"n{i + 1:03d}") for i in range(30)] + [("1h", f"n{rnd.randrange(40):03d}", f"n{rnd.randrange(40):03d}") for _ in range(25)] + [("1h", "x", "x")]
    parent = {}

    def root(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for tf, a, b in edges:
        first, second = sorted((root((tf, a)), root((tf, b))))
        parent[second] = first
    stored = {}

    def written(name, df):
        rows = df.collect()  # as a table read again
        stored[name] = len(rows)
        return spark.createDataFrame(rows, df.schema)

    got = {(r.timeframe, r.node): r.component for r in components(spark.createDataFrame(edges, "timeframe string, a string, b string"), ["timeframe"], "a", "b", written).collect()}
    assert got == {n: root(n)[1] for n in parent}
    assert len(stored) < 12  # rounds grow with the logarithm of a chain
    assert components(spark.createDataFrame([], "timeframe string, a string, b string"), ["timeframe"], "a", "b", keep).count() == 0


def test_training_join_proves_unique_keys(spark):
    features = spark.createDataFrame([("A", "1d", 1, 0.1), ("A", "1d", 2, 0.2), ("B", "1d", 1, 0.3)], f"{KEY}, f double")
    labels = spark.createDataFrame([("A", "1d", 1, 1.0), ("B", "1d", 1, 2.0), ("C", "1d", 1, 3.0)], f"{KEY}, y double")
    assert sorted(map(tuple, training_join(features, labels).collect())) == [("A", "1d", 1, 0.1, 1.0), ("B", "1d", 1, 0.3, 2.0)]
    twice = features.unionByName(features.filter("symbol = 'A'"))
    broken = labels.unionByName(spark.createDataFrame([("B", "1d", None, 4.0)], f"{KEY}, y double"))
    assert {(r.side, r.symbol, r.open_time, r.copies, r.fault) for r in key_faults(twice, broken).collect()} == {
        ("features", "A", 1, 2, "DUPLICATE_KEY"), ("features", "A", 2, 2, "DUPLICATE_KEY"), ("labels", "B", None, 1, "NULL_KEY")}
    for left, right in ((twice, labels), (features, broken), (features.drop("open_time"), labels), (features, labels.withColumnRenamed("y", "F"))):
        with pytest.raises(TrainingError):
            training_join(left, right)
    assert [r.symbol for r in training_join(twice, broken, strict=False).collect()] == ["B"]
    assert training_join(features.limit(0), labels.limit(0)).count() == 0


def test_redundant_train_factors_give_their_verdict(spark):
    rnd = random.Random(5)
    rows = []
    for tf in ("1d", "1h"):
        for t in range(60):
            base, other = rnd.random(), rnd.random()
            values = {"a": base, "b": base * 2 + 1, "c": base**3 if tf == "1d" else -base, "d": other, "e": other if t % 2 else None}
            for partition, selected in (("TRAIN", True), ("OOS", True), ("TRAIN", False)):
                rows += [("S", tf, t, n if selected else f"u{n}", "1", partition, selected, v if partition == "TRAIN" else rnd.random()) for n, v in values.items()]
    train = spark.createDataFrame(rows, f"{KEY}, factor_name string, factor_version string, partition string, selected boolean, factor_value double")
    groups = stability.train_redundancy(train, keep, 0.9)
    got = {}
    for r in groups.collect():
        got.setdefault((r.timeframe, r.group_name), set()).add(r.factor_name)
    assert got == {("1d", "a"): {"a", "b", "c"}, ("1d", "d"): {"d", "e"}, ("1h", "a"): {"a", "b"}, ("1h", "d"): {"d", "e"}}
    facts = spark.createDataFrame([("1d", f, "1", "MIXED", -0.1 if f < "d" else 0.2, -0.1) for f in "abcd"], "timeframe string, factor_name string, factor_version string, stability_class string, mean_oriented_ic double, selection_ic double")
    facts = facts.withColumn("selection_ic", facts.mean_oriented_ic * 0)
    ics = spark.createDataFrame([("1d", 0.1, 5, 1)], "timeframe string, oos_ic double, folds long, negative_folds long")
    assert stability.timeframe_status(facts, ics, ics, groups).first().verdict == "FACTOR_REDUNDANCY"
    assert stability.timeframe_status(facts, ics, ics).first().verdict != "FACTOR_REDUNDANCY"
