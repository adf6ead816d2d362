"""Tiled pair moments, and the lineage checks of combinations."""

import numpy as np
import pytest

from barloom.functions import pairwise
from barloom.operators import combination, verify


def plain(values):
    """Correlation and overlap of all column pairs over rows where both are finite."""
    ok = np.isfinite(values)
    found = {}
    for a in range(values.shape[1]):
        for b in range(a + 1, values.shape[1]):
            rows = ok[:, a] & ok[:, b]
            x, y = values[rows, a], values[rows, b]
            if len(x):
                varies = len(x) > 1 and x.std() > 0 and y.std() > 0
                found[a, b] = (len(x), abs(np.corrcoef(x, y)[0, 1]) if varies else None)
    return found


@pytest.mark.parametrize("cells", [1 << 21, 1 << 15])
def test_more_columns_than_a_tile_in_one_strip_or_many(spark, monkeypatch, cells):
    monkeypatch.setattr(pairwise, "STRIP_CELLS", cells)
    rng = np.random.default_rng(4)
    values = rng.normal(1e3, 1, (60, 280))
    values[:, 1] = values[:, 0] * 2
    values[:, 2] = 5.0
    values[rng.random(values.shape) < 0.2] = np.nan
    values[:, 279] = np.nan
    names = [f"c{i}" for i in range(280)]
    df = spark.createDataFrame([(g, *(None if np.isnan(x) else float(x) for x in row)) for g in ("a", None) for row in values],
                               "g string, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    rows = pairwise.pair_correlations(df, "g", names).collect()
    want = plain(values)
    for g in ("a", None):
        got = {(r.a, r.b): (r.overlap, r.abs_corr) for r in rows if r.g == g}
        assert set(got) == set(want)
        for key, (n, c) in want.items():
            assert got[key][0] == n and (got[key][1] is None) == (c is None) and (c is None or abs(got[key][1] - c) < 1e-8)
    strong = pairwise.pair_correlations(df, "g", names, limit=0.5, min_overlap=30).collect()
    assert {(r.g, r.a, r.b) for r in strong} == {(g, *k) for g in ("a", None) for k, (n, c) in want.items() if c is not None and c >= 0.5 and n >= 30}


def test_hundreds_of_combinations_with_all_columns(spark):
    rng = np.random.default_rng(1)
    names = [f"f{i:02d}" for i in range(24)]
    base = rng.normal(size=(80, 24))
    base[:, 1] = base[:, 0]
    panel = spark.createDataFrame(
        [("S", tf, int(t), n, "1", "c", float(base[t, i])) for tf in ("1d", "1h") for t in range(80) for i, n in enumerate(names) if not (i == 5 and t < 40)],
        "symbol string, timeframe string, open_time long, factor_name string, factor_version string, factor_category string, factor_value double")
    analysis = spark.createDataFrame([(n, "1", "c", "1d" if i % 2 else "1h", float(i), 0.5, True) for i, n in enumerate(names)],
                                     "factor_name string, factor_version string, factor_category string, best_timeframe string, best_selection_score double, timeframe_confidence double, selected boolean")
    combos = combination.combinations(analysis).cache()
    table = combination.orthogonal_combinations(combos, panel, 0.8, 50, combination.Lineage(0, 69))
    got = {r.combination_id: r for r in table.collect()}
    assert len(table.columns) == 35 and len(got) == 276
    for tf in ("1d", "1h"):
        ordered = sorted((r for r in combos.collect() if r.timeframe == tf), key=lambda r: r.combination_rank)
        values = np.array(base[:70])
        values[:40, 5] = np.nan
        signals = np.stack([values[:, [int(n[1:]) for n in r.factor_names]].mean(axis=1) for r in ordered], axis=1)
        pairs, accepted = plain(signals), []
        for b, r in enumerate(ordered):
            hit = next((a for a in accepted if pairs.get((a, b), (0, None))[1] is not None and pairs[a, b][1] >= 0.8 and pairs[a, b][0] >= 50), None)
            own = got[r.combination_id]
            assert own.selected == (hit is None) and own.redundancy_reference_combination_id == (None if hit is None else ordered[hit].combination_id)
            if hit is None:
                accepted.append(b)
                assert own.orthogonalization_rank == len(accepted)
    assert verify.orthogonalization_lineage(table, combos).count() == 0 and verify.combination_lineage(combos, analysis).count() == 0
    unselected = analysis.replace(True, False, "selected")
    assert {r.rule for r in verify.combination_lineage(combos, unselected).collect()} == {"not_selected"}
    assert combination.orthogonal_combinations(combos.limit(0), panel).count() == 0
