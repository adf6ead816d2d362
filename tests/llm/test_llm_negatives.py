"""Hard-negative mining against plain loops over Python integers."""

import math
import random

import numpy as np
import pytest

from barloom.llm import negatives, queries

LIMIT = 2**63


@pytest.mark.parametrize(("width", "low", "high"), [(64, -256, 256), (3, -5, 6), (64, 0, 1), (1, -1, 1), (16, -2**30, 2**30), (5, -2**60, 2**60)])
def test_packed_scores_equal_plain_products(width, low, high):
    rng = np.random.default_rng(width)
    a, r = rng.integers(low, high, (7, width)), rng.integers(low, high, (29, width))
    want = [[max(-LIMIT, min(LIMIT - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in r] for p in a]
    assert negatives.packed_scores(a, r).tolist() == want


def test_shifts_beyond_64_bits_stay_exact():
    far = np.array([[2.0**55], [2.0**55]])
    assert negatives.packed_scores(far, far[:1]).tolist() == [[LIMIT - 1], [LIMIT - 1]]
    assert negatives.packed_scores(far, np.array([[4], [5]])).tolist() == [[2**57, 5 * 2**55]] * 2


def test_selection_equals_sorting():
    rng = np.random.default_rng(3)
    for trial in range(200):
        q, n, k, b = rng.integers(1, 6), rng.integers(1, 30), rng.integers(1, 5), rng.integers(1, 4)
        unit = 2**55 if trial % 3 == 0 else 1
        scores, take = rng.integers(-5, 6, (q, n)) * unit, rng.random((q, n)) < 0.7
        low, high = rng.integers(-5, 6, (q, b)) * unit, rng.integers(-5, 6, (q, b)) * unit

        def listed(found, at):
            return [(-x, y) for x, y in zip(found.tolist(), at.tolist()) if y >= 0]

        best, below = negatives.best(scores, take, k), negatives.first_below(scores, take, low, high, k)
        for i in range(q):
            assert listed(best[0][i], best[1][i]) == sorted((-scores[i, j], j) for j in range(n) if take[i, j])[:k]
            for c in range(b):
                want = sorted((-scores[i, j], j) for j in range(n) if take[i, j] and low[i, c] <= scores[i, j] <= high[i, c])[:k]
                assert listed(below[0][i, c], below[1][i, c]) == want


def test_bands_are_exact_and_never_overflow():
    x = np.array([0, 1, -1, 99, 100, -250, 2**62, -2**62, 2**63 - 1])
    low, high = negatives.band(x)
    assert [(a, b) for a, b in zip(low.tolist(), high.tolist())] == [(-((-50 * v) // 100), (95 * v) // 100) for v in x.tolist()]


def plain(rows, n_positives=5, n_negatives=3, every=50, scale=256.0):
    """rows: (vec_id, label, values); the contract by nested loops."""
    ok = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {(i, lab, tuple(v)) for i, lab, v in ok if i % every == 0}
    found = []
    for i, lab, v in anchors:
        near = [(-max(-LIMIT, min(LIMIT - 1, sum(a * b for a, b in zip(v, w)))), j, other) for j, other, w in ok if j != i and len(w) == len(v)]
        for s, p, _ in sorted(x for x in near if x[2] == lab)[:n_positives]:
            hard = sorted(x for x in near if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s)[:n_negatives]
            found += [(i, p, rank + 1, j, -s, -t) for rank, (t, j, _) in enumerate(hard)]
    return sorted(found)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, label int, embedding array<double>, anchor string, small int")
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **more).collect())


def test_mining_equals_nested_loops(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([0, 1, 2, None]), [rnd.choice([-0.25, 0.0, 0.1, 0.25, 0.5]) for _ in range(3)]) for i in range(400)]
    rows += [(50, 1, [0.25, 0.5, 0.1]), (50, 1, [0.25, 0.5, 0.1]), (7, 2, [0.5, 0.5, 0.5]), (7, 2, [0.5, 0.5, 0.5])]  # repeated ids and rows
    rows += [(None, 1, [1.0] * 3), (100, None, [1.0] * 3), (150, 1, None), (401, 1, [None, 1.0, 1.0]), (402, 1, [math.inf, 0.0, 0.0]), (403, 2, [math.nan, 0.0, 0.0])]
    rows += [(450, 1, [0.5, 0.5]), (451, 1, [0.5, 0.4]), (452, 2, [0.4, 0.4]), (500, 1, []), (501, 1, []), (502, 2, []), (550, 9, [0.5, 0.5, 0.5])]
    want = plain(rows)
    assert want and mined(spark, rows) == want
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)  # more blocks than tasks, several merging levels
    monkeypatch.setattr(negatives, "CELL_ROWS", 10)
    assert mined(spark, rows) == want


def test_large_components_stay_exact(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.randrange(2), [rnd.choice([-1, 1]) * rnd.random() * 2.0 ** rnd.choice([3, 10, 22]) for _ in range(8)]) for i in range(0, 300, 2)]
    want = plain(rows, n_positives=2)
    assert want and mined(spark, rows, n_positives=2) == want
    far = [(0, 0, [1e18]), (1, 0, [1e18]), (2, 1, [3e17]), (3, 0, [2.0])]
    assert mined(spark, far) == plain(far)


def test_tables_without_anchors_or_rows_give_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []
    assert mined(spark, [(0, 0, [1.0]), (2, 1, [1.0])]) == []
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"), anchor_every=0)


def test_query_moves_labels_first(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(i, rnd.randrange(10), [rnd.uniform(-0.5, 0.5) for _ in range(4)]) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in rows]
    df = queries.QUERIES["op13_hard_negatives"](spark, str(tmp_path))
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in df.collect()) == plain(moved)
