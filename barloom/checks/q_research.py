"""Queries for the research toolkit, model jobs, and stability reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.clock import utc_year
from barloom.operators import folds, ml, research, stability
from barloom.operators.asof import first_complete_times
from barloom.operators.factors import CATALOG, factor_frame
from barloom.operators.features import feature_frame
from barloom.operators.labels import label_frame

from . import tables
from .factor_sql import FACTOR_SQL, FEATURE_SQL, SERIES, staged
from .q_data import GROUPS, LABELS, RET
from .q_experiment import corr_sql, keeper
from .q_factors import COMPANION_COLUMNS  # noqa: F401
from .q_folds import FF, ORDERED, PURGED, fold_rows, ic_pair_sql, purged_oos, rank_sql, walk
from .q_ledger import PRED_SQL, predictions
from .q_panel import (
    ID_SQL, PANEL_FACTORS, PANEL_SQL, P_VALUE, bars_all, evaluated, factor_panel, panel, selected,
)
from .registry import add
from .sql import BARS_1D, INPUTS_1D

ID = ["factor_name", "factor_version", "timeframe"]

# -- single-factor research --------------------------------------------------------------------------
IC0 = "SELECT {k}, count(*) AS pairs, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS ic FROM ({src}) GROUP BY {k}"
PAIRS = "factor_value IS NOT NULL AND future_return_1 IS NOT NULL"


def with_p(ic_sql: str, keys: str) -> str:
    return f"""SELECT {keys}, ic, pairs, CASE WHEN pairs > 2 THEN {P_VALUE} END AS p_value
FROM (SELECT *, CAST(pairs - 2 AS DOUBLE) AS v, ic * sqrt(pairs - 2) / sqrt(1 - ic * ic) AS t FROM ({ic_sql}))"""


SYM = "symbol, factor_name, timeframe"
add("research_ic",
    lambda s, d: research.information_coefficient(panel(s, d), ["symbol", "factor_name", "timeframe"]),
    f"WITH {PANEL_SQL} " + with_p(IC0.format(k=SYM, src=f"SELECT {SYM}, factor_value AS x, future_return_1 AS y FROM panel WHERE {PAIRS}"), SYM), ["ic", "p_value"])
add("research_rank_ic",
    lambda s, d: research.information_coefficient(panel(s, d), ["symbol", "factor_name", "timeframe"], method="spearman"),
    f"WITH {PANEL_SQL} " + with_p(IC0.format(k=SYM, src=f"SELECT {SYM}, {rank_sql(SYM, 'factor_value')} AS x, {rank_sql(SYM, 'future_return_1')} AS y FROM panel WHERE {PAIRS}"), SYM),
    ["ic", "p_value"])
QA = f"""{PANEL_SQL},
qa AS (SELECT {ID_SQL}, CAST(((row_number() OVER (PARTITION BY {ID_SQL} ORDER BY factor_value, open_time, symbol) - 1) * 5) // count(*) OVER (PARTITION BY {ID_SQL}) + 1 AS INTEGER) AS quantile,
  future_return_1 AS y FROM panel WHERE {PAIRS}),
qs AS (SELECT {ID_SQL}, quantile, count(*) AS count, avg(y) AS mean, stddev_samp(y) AS std, min(y) AS min, max(y) AS max, median(y) AS median FROM qa GROUP BY ALL)"""
add("quantile_analysis", lambda s, d: research.quantile_analysis(panel(s, d), ID), f"WITH {QA} SELECT * FROM qs", ["mean", "std", "min", "max", "median"])
add("quantile_summary", lambda s, d: research.quantile_summary(research.quantile_analysis(panel(s, d), ID), ID), f"""WITH {QA}
SELECT {ID_SQL}, max(mean) FILTER (quantile = 5) - max(mean) FILTER (quantile = 1) AS spread, coalesce(bool_and(mean >= p), true) OR coalesce(bool_and(mean <= p), true) AS monotonic
FROM (SELECT *, lag(mean) OVER (PARTITION BY {ID_SQL} ORDER BY quantile) AS p FROM qs) GROUP BY ALL""", ["spread"])


@tables.staged
def momentum_bars(s, d):
    bars = tables.bars_1d(s, d)
    wide = factor_frame(bars, [CATALOG["momentum"]])
    return bars.select("symbol", "timeframe", "open_time", "year", "close").join(wide, ["symbol", "timeframe", "open_time"])


DECAY = f"""{BARS_1D}, mo AS ({staged('bars', [], {'momentum': FACTOR_SQL['momentum'][1]}, 'symbol, timeframe, open_time, year, close')}),
ah AS (SELECT symbol, timeframe, momentum AS x, unnest([{', '.join(f"{{'horizon': {h}, 'y': lead_{h}}}" for h in research.DECAY_HORIZONS)}]) AS u
  FROM (SELECT *, {', '.join(f'lead(close, {h}) OVER ({SERIES}) / close - 1 AS lead_{h}' for h in research.DECAY_HORIZONS)} FROM mo)),
dc AS (SELECT symbol, timeframe, u.horizon AS horizon, x, u.y AS y FROM ah WHERE x IS NOT NULL AND u.y IS NOT NULL),
dec AS MATERIALIZED ({IC0.format(k='symbol, timeframe, horizon', src=f"SELECT symbol, timeframe, horizon, {rank_sql('symbol, timeframe, horizon', 'x')} AS x, {rank_sql('symbol, timeframe, horizon', 'y')} AS y FROM dc")})"""


def decayed(s, d):
    return research.decay(momentum_bars(s, d), ["symbol", "timeframe"], "momentum")


add("ic_decay", decayed, f"WITH {DECAY} SELECT * FROM dec", ["ic"])
add("ic_half_life", lambda s, d: research.half_life(decayed(s, d), ["symbol", "timeframe"]), f"""WITH {DECAY}
SELECT symbol, timeframe, min(horizon) FILTER (abs(ic) < base / 2) AS half_life FROM (SELECT *, abs(first_value(ic) OVER (PARTITION BY symbol ORDER BY horizon)) AS base FROM dec) GROUP BY ALL""")
BLK = f"{ID_SQL}, blk"
STAB = f"""{PANEL_SQL},
ab AS (SELECT {ID_SQL}, factor_value, future_return_1, (row_number() OVER (PARTITION BY {ID_SQL} ORDER BY open_time, symbol) - 1) // 500 AS blk FROM panel),
nb AS (SELECT * FROM ab JOIN (SELECT {BLK} FROM ab GROUP BY ALL HAVING count(*) = 500) USING ({BLK}) WHERE {PAIRS}),
bi AS ({IC0.format(k=BLK, src=f"SELECT {BLK}, {rank_sql(BLK, 'factor_value')} AS x, {rank_sql(BLK, 'future_return_1')} AS y FROM nb")})"""
add("ic_stability", lambda s, d: research.stability(panel(s, d), ID), f"""WITH {STAB}
SELECT {ID_SQL}, count(ic) AS blocks, avg(ic) AS mean_ic, coalesce(stddev_samp(ic), 0) AS std_ic, min(ic) AS min_ic, max(ic) AS max_ic,
  coalesce(least(greatest(1 - coalesce(stddev_samp(ic), 0) / nullif(abs(avg(ic)), 0), 0), 1), 0) AS stability_score FROM bi GROUP BY ALL""",
    ["mean_ic", "std_ic", "min_ic", "max_ic", "stability_score"])
FIVE = PANEL_FACTORS[:5]


@tables.staged
def wide_five(s, d):
    return factor_frame(bars_all(s, d), [CATALOG[n] for n in FIVE])


def _matrix_sql(method: str) -> str:
    ok = " AND ".join(f"{c} IS NOT NULL" for c in FIVE)
    cols = FIVE if method == "pearson" else [f"{rank_sql('timeframe', c)} AS {c}" for c in FIVE]
    pairs = [(a, b) for i, a in enumerate(FIVE) for b in FIVE[i + 1:]]
    union = " UNION ALL ".join(
        f"SELECT timeframe, '{a}' AS factor_a, '{b}' AS factor_b, count(*) AS overlap, covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) AS corr FROM cm GROUP BY timeframe"
        for a, b in pairs)
    return f"WITH {PANEL_SQL}, cm AS MATERIALIZED (SELECT timeframe, {', '.join(cols)} FROM wide WHERE {ok}) SELECT * FROM ({union})"


for _m in ("pearson", "spearman"):
    add(f"correlation_matrix_{_m}", lambda s, d, m=_m: research.correlation_matrix(wide_five(s, d), "timeframe", FIVE, m), _matrix_sql(_m), ["corr"])
add("highly_correlated_pairs", lambda s, d: research.highly_correlated(research.correlation_matrix(wide_five(s, d), "timeframe", FIVE), 0.6),
    _matrix_sql("pearson") + " WHERE abs(corr) >= 0.6", ["corr"])
LB = "factor_name, symbol, timeframe, h"
add("leaderboard", lambda s, d: research.leaderboard(panel(s, d)), f"""WITH {PANEL_SQL},
un AS (SELECT factor_name, symbol, timeframe, factor_value, unnest([{', '.join(f"{{'h': {h}, 'y': future_return_{h}}}" for h in (1, 5, 10, 20))}]) AS u FROM panel),
lv AS (SELECT factor_name, symbol, timeframe, u.h AS h, factor_value AS x, u.y AS y FROM un WHERE factor_value IS NOT NULL AND u.y IS NOT NULL),
lr AS ({IC0.format(k=LB, src=f"SELECT {LB}, {rank_sql(LB, 'x')} AS x, {rank_sql(LB, 'y')} AS y FROM lv")})
SELECT factor_name, count(ic) AS runs, count(*) FILTER (ic IS NULL) AS skipped, avg(ic) AS mean_rank_ic FROM lr GROUP BY factor_name""", ["mean_rank_ic"])
add("research_summary",
    lambda s, d: research.research_summary(research.information_coefficient(panel(s, d), ["symbol", "factor_name", "timeframe"])), f"""WITH {PANEL_SQL},
ri AS ({IC0.format(k=SYM, src=f"SELECT {SYM}, factor_value AS x, future_return_1 AS y FROM panel WHERE {PAIRS}")})
SELECT factor_name, symbol, timeframe, count(ic) AS runs, avg(ic) AS mean_ic, max(ic) AS best_ic, min(ic) AS worst_ic FROM ri
GROUP BY GROUPING SETS ((), (factor_name), (symbol), (timeframe))""", ["mean_ic", "best_ic", "worst_ic"])
PK = ["symbol", "timeframe"]
PNAMES = [f"p{str(q)[2:].ljust(2, '0')}" for q in research.PERCENTILES]
add("prediction_distribution", lambda s, d: research.prediction_distribution(predictions(s, d), PK), f"""WITH {PRED_SQL}
SELECT symbol, timeframe, count(*) AS count, min(prediction) AS min, max(prediction) AS max, avg(prediction) AS mean, stddev_samp(prediction) AS std, median(prediction) AS median,
  {', '.join(f'quantile_cont(prediction, {q}) AS {n}' for q, n in zip(research.PERCENTILES, PNAMES))},
  count(*) FILTER (prediction > 0) / count(*) AS positive_ratio, count(*) FILTER (prediction < 0) / count(*) AS negative_ratio FROM predictions GROUP BY ALL""",
    ["min", "max", "mean", "std", "median", *PNAMES, "positive_ratio", "negative_ratio"])
PROF = " UNION ALL ".join(f"SELECT *, '{n}' AS profile, quantile_cont(prediction, {b}) OVER g AS buy_threshold, quantile_cont(prediction, {c}) OVER g AS sell_threshold FROM pp WINDOW g AS (PARTITION BY symbol, timeframe, model_name, model_version)"
                          for n, (b, c) in research.PROFILES.items())
add("calibrated_thresholds", lambda s, d: research.calibrate(predictions(s, d)), f"""WITH {PRED_SQL},
pp AS (SELECT symbol, timeframe, model_name, model_version, prediction FROM predictions UNION ALL SELECT '*', '*', model_name, model_version, prediction FROM predictions),
pr AS ({PROF})
SELECT symbol, timeframe, model_name, model_version, profile, buy_threshold, sell_threshold, avg(CASE WHEN prediction >= buy_threshold THEN 1.0 ELSE 0.0 END) AS expected_buy_ratio,
  avg(CASE WHEN prediction <= sell_threshold THEN 1.0 ELSE 0.0 END) AS expected_sell_ratio,
  1 - avg(CASE WHEN prediction >= buy_threshold THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN prediction <= sell_threshold THEN 1.0 ELSE 0.0 END) AS expected_hold_ratio FROM pr GROUP BY ALL""",
    ["buy_threshold", "sell_threshold", "expected_buy_ratio", "expected_sell_ratio", "expected_hold_ratio"])


def _adaptive(s, d):
    from barloom.operators.signals import adaptive_signals

    return adaptive_signals(predictions(s, d), research.calibrate(predictions(s, d)))


add("adaptive_signals", _adaptive, f"""WITH {PRED_SQL}
SELECT symbol, timeframe, open_time, model_name, model_version, CASE WHEN prediction >= quantile_cont(prediction, 0.95) OVER g THEN 'BUY'
  WHEN prediction <= quantile_cont(prediction, 0.05) OVER g THEN 'SELL' ELSE 'HOLD' END AS signal FROM predictions WINDOW g AS (PARTITION BY symbol, timeframe)""")
add("rolling_research",
    lambda s, d: folds.fold_factor_metrics(folds.out_of_sample(
        folds.indexed(evaluated(s, d), by="time"), folds.Layout(252, 63, 63))).select(
        "timeframe", "fold", "factor_name", "oos_rows", "raw_oos_ic"), f"""WITH {ORDERED},
tt AS (SELECT timeframe, selection_time, row_number() OVER (PARTITION BY timeframe ORDER BY selection_time) - 1 AS ti, count(*) OVER (PARTITION BY timeframe) AS tn
  FROM (SELECT DISTINCT timeframe, selection_time FROM evaluation)),
ro AS MATERIALIZED (SELECT e.*, CAST((ti - 252) // 63 + 1 AS INTEGER) AS fold FROM evaluation e JOIN tt USING (timeframe, selection_time) WHERE ti >= 252 AND (ti - 252) // 63 <= (tn - 315) // 63),
st AS (SELECT {FF}, count(*) AS oos_rows FROM ro WHERE selected GROUP BY ALL)
SELECT timeframe, fold, factor_name, oos_rows, raw_oos_ic FROM st LEFT JOIN {ic_pair_sql(FF, 'ro')} i USING ({FF})""", ["raw_oos_ic"])

# -- training sets and models --------------------------------------------------------------------------
FEATS = ["returns", "rolling_mean", "atr", "rolling_std"]


@tables.staged
def training(s, d):
    bars = tables.bars_1d(s, d)
    return feature_frame(bars, FEATS).join(label_frame(bars), ["symbol", "timeframe", "open_time"])


TRAIN_SQL = f"""{BARS_1D}, {LABELS},
feats AS ({staged('bars', [], {**{n: FEATURE_SQL[n] for n in FEATS}, 'place': f'row_number() OVER ({SERIES})'}, 'symbol, timeframe, open_time')}),
training AS MATERIALIZED (SELECT f.* EXCLUDE (place), l.* EXCLUDE (symbol, timeframe, open_time) FROM feats f JOIN labels_1d l USING (symbol, timeframe, open_time) WHERE place > 20)"""
add("chronological_split", lambda s, d: ml.chronological_split(training(s, d)).select("symbol", "open_time", "part"), f"""WITH {TRAIN_SQL},
o AS (SELECT *, row_number() OVER (ORDER BY symbol, timeframe, open_time) - 1 AS r, count(*) OVER () AS n FROM training)
SELECT symbol, open_time, CASE WHEN r < floor(n * 0.7) THEN 'TRAIN' WHEN r < floor(n * 0.7) + floor(n * 0.15) THEN 'VALIDATION' ELSE 'TEST' END AS part FROM o""")
add("split_by_time", lambda s, d: ml.chronological_split(training(s, d), by="time").groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("open_time").alias("first")), f"""WITH {TRAIN_SQL},
o AS (SELECT *, min(r) OVER (PARTITION BY open_time) AS p, count(*) OVER () AS n FROM (SELECT *, row_number() OVER (ORDER BY open_time, symbol) - 1 AS r FROM training))
SELECT CASE WHEN p < floor(n * 0.7) THEN 'TRAIN' WHEN p < floor(n * 0.7) + floor(n * 0.15) THEN 'VALIDATION' ELSE 'TEST' END AS part, count(*) AS rows, min(open_time) AS first FROM o GROUP BY 1""")
for _k, _lo, _w in (("standard", "avg({0})", "stddev_pop({0})"), ("minmax", "min({0})", "(max({0}) - min({0}))")):
    add(f"scaler_{_k}",
        lambda s, d, k=_k: ml.scale(training(s, d).select("symbol", "open_time", *FEATS), ml.fit_scaler(training(s, d).filter(F.col("open_time") < 946684800000), FEATS), k),
        f"""WITH {TRAIN_SQL}, pm AS (SELECT {', '.join(f'{_lo.format(c)} AS {c}_l, {_w.format(c)} AS {c}_w' for c in FEATS)} FROM training WHERE open_time < 946684800000)
SELECT symbol, open_time, {', '.join(f'CASE WHEN {c}_w = 0 THEN 0.0 ELSE ({c} - {c}_l) / {c}_w END AS {c}' for c in FEATS)} FROM training, pm""", FEATS)
add("scaler_inverse",
    lambda s, d: (lambda fit: ml.unscale(ml.scale(training(s, d).select("symbol", "open_time", *FEATS), fit), fit))(ml.fit_scaler(training(s, d), FEATS)),
    f"WITH {TRAIN_SQL} SELECT symbol, open_time, {', '.join(FEATS)} FROM training", FEATS)
add("column_statistics", lambda s, d: ml.column_statistics(training(s, d), [*FEATS, *RET]), f"WITH {TRAIN_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(*) FILTER (isnan({c})) AS nans, count(*) FILTER (isinf({c})) AS infinite, min({c}) AS min, max({c}) AS max, avg({c}) AS mean, stddev_samp({c}) AS std FROM training"
    for c in [*FEATS, *RET]), ["min", "max", "mean", "std"])
add("class_shares", lambda s, d: ml.class_shares(training(s, d).withColumn("label", F.col("direction_5").cast("int")), "label"),
    f"WITH {TRAIN_SQL} SELECT CAST(direction_5 AS INTEGER) AS label, count(*) AS rows, count(*) / sum(count(*)) OVER () AS share FROM training GROUP BY 1", ["share"])
add("expanding_folds", lambda s, d: ml.expanding_folds(training(s, d), 4).groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.min("open_time").alias("first"), F.max("open_time").alias("last")), f"""WITH {TRAIN_SQL},
o AS (SELECT *, row_number() OVER (ORDER BY open_time, symbol) - 1 AS r, count(*) OVER () AS n FROM training)
SELECT CAST(CASE WHEN r < n - n // 5 * 4 THEN 0 ELSE (r - (n - n // 5 * 4)) // (n // 5) + 1 END AS INTEGER) AS block, count(*) AS rows, min(open_time) AS first, max(open_time) AS last FROM o GROUP BY 1""")
add("regression_metrics", lambda s, d: ml.regression_metrics(panel(s, d).filter("factor_value IS NOT NULL"), "future_return_1", "future_return_5", ["timeframe"]), f"""WITH {PANEL_SQL}
SELECT timeframe, avg(abs(future_return_5 - future_return_1)) AS mae, avg(pow(future_return_5 - future_return_1, 2)) AS mse, sqrt(avg(pow(future_return_5 - future_return_1, 2))) AS rmse,
  1 - avg(pow(future_return_5 - future_return_1, 2)) / var_pop(future_return_1) AS r2 FROM panel WHERE factor_value IS NOT NULL GROUP BY timeframe""", ["mae", "mse", "rmse", "r2"])
add("classification_metrics", lambda s, d: ml.classification_metrics(training(s, d), "direction_1", "direction_5"), f"""WITH {TRAIN_SQL},
c AS (SELECT k, count(*) FILTER (direction_1 = k) AS a, count(*) FILTER (direction_5 = k) AS p, count(*) FILTER (direction_1 = k AND direction_5 = k) AS h FROM training, (SELECT unnest([0, 1]) AS k) GROUP BY k)
SELECT sum(h) / sum(a) AS accuracy, avg(h / p) AS precision, avg(h / a) AS recall, avg(2 * (h / p) * (h / a) / (h / p + h / a)) AS f1 FROM c""", ["accuracy", "precision", "recall", "f1"])
add("model_predictions", lambda s, d: ml.predict(
    ml.train(training(s, d).filter(F.col("open_time") < 946684800000), FEATS, "future_return_1", maxIter=3, maxDepth=3),
    training(s, d), FEATS, "future_return_1", "gbt", "1").drop("future_return_1"))
add("model_classification", lambda s, d: ml.classification_metrics(ml.predict(
    ml.train(training(s, d).filter(F.col("open_time") < 946684800000), FEATS, "direction_1", "gbt_classifier", maxIter=3, maxDepth=3),
    training(s, d).filter(F.col("open_time") >= 946684800000), FEATS, "direction_1", "gbt", "1"), "direction_1", "prediction"))
add("model_cross_validation", lambda s, d: ml.cross_validate(training(s, d), FEATS, "future_return_1", 2, maxIter=2, maxDepth=2))
add("model_search", lambda s, d: ml.search(training(s, d), FEATS, "future_return_1", {"maxDepth": [2, 3], "maxIter": [2]}, 2))
add("model_workflow", lambda s, d: ml.workflow(training(s, d), FEATS, "future_return_1", maxIter=2, maxDepth=2))

# -- stability -------------------------------------------------------------------------------------------


@tables.staged
def purged_factor_ics(s, d):
    return folds.fold_factor_metrics(purged_oos(s, d))


@tables.staged
def purged_rows(s, d):
    return purged_oos(s, d)


def stable(s, d):
    return stability.factor_stability(purged_factor_ics(s, d))


FIC = f"""{PURGED},
fic AS MATERIALIZED (SELECT st.*, raw_oos_ic, oriented_oos_ic FROM (SELECT {FF}, count(*) AS oos_rows, max(selection_ic) AS selection_ic, max(selection_rank_ic) AS selection_rank_ic, max(selected_direction) AS selected_direction
  FROM poos WHERE selected GROUP BY ALL) st LEFT JOIN {ic_pair_sql(FF, 'poos')} i USING ({FF})),
fs0 AS (SELECT timeframe, factor_name, factor_version, count(oriented_oos_ic) AS folds, count(*) FILTER (oriented_oos_ic > 0) AS positive_folds,
  count(*) FILTER (oriented_oos_ic < 0) AS negative_folds, avg(oriented_oos_ic) AS mean_oriented_ic, avg(raw_oos_ic) AS mean_raw_ic,
  count(*) FILTER (raw_oos_ic > 0) AS positive_raw_folds, count(*) FILTER (raw_oos_ic < 0) AS negative_raw_folds, max(selection_ic) AS selection_ic, max(selection_rank_ic) AS selection_rank_ic FROM fic GROUP BY ALL),
fs AS MATERIALIZED (SELECT *, CASE WHEN folds = 0 THEN 'INSUFFICIENT_DATA' WHEN negative_folds = folds AND mean_oriented_ic < 0 THEN 'ORIENTATION_INSUFFICIENT'
  WHEN positive_folds = folds AND mean_oriented_ic > 0 THEN 'STABLE_POSITIVE' WHEN positive_folds > 0 AND negative_folds > 0 THEN 'MIXED'
  WHEN mean_oriented_ic > 0 THEN 'STABLE_POSITIVE' WHEN mean_oriented_ic < 0 THEN 'STABLE_NEGATIVE' ELSE 'MIXED' END AS stability_class FROM fs0)"""
FS_DOUBLES = ["mean_oriented_ic", "mean_raw_ic", "selection_ic", "selection_rank_ic"]
add("factor_stability", stable, f"WITH {FIC} SELECT * FROM fs", FS_DOUBLES)
add("stability_classes", lambda s, d: stability.classified(stable(s, d)), f"""WITH {FIC}
SELECT * EXCLUDE (ins), CASE WHEN positive_raw_folds + negative_raw_folds = 0 OR mean_raw_ic IS NULL THEN 'NEUTRAL' WHEN negative_raw_folds = 0 AND mean_raw_ic > 0 THEN 'STABLE_POSITIVE' WHEN positive_raw_folds = 0 AND mean_raw_ic < 0 THEN 'ORIENTATION_REVERSAL_CANDIDATE'
  WHEN positive_raw_folds > 0 AND negative_raw_folds > 0 THEN 'UNSTABLE' WHEN mean_raw_ic > 0 THEN 'STABLE_POSITIVE' WHEN mean_raw_ic < 0 THEN 'STABLE_NEGATIVE' ELSE 'NEUTRAL' END AS orientation_class,
  CASE WHEN ins > 0 AND mean_raw_ic > 0 THEN 'IS_POSITIVE_OOS_POSITIVE' WHEN ins > 0 AND mean_raw_ic < 0 THEN 'IS_POSITIVE_OOS_NEGATIVE'
    WHEN ins < 0 AND mean_raw_ic > 0 THEN 'IS_NEGATIVE_OOS_POSITIVE' WHEN ins < 0 AND mean_raw_ic < 0 THEN 'IS_NEGATIVE_OOS_NEGATIVE' ELSE 'IS_NEUTRAL_OOS' END AS in_out_class
FROM (SELECT *, coalesce(selection_rank_ic, selection_ic) AS ins FROM fs)""", FS_DOUBLES)
add("cross_timeframe_consistency", lambda s, d: stability.cross_timeframe(stable(s, d)), f"""WITH {FIC},
x AS (SELECT factor_name, factor_version, count(*) AS timeframes, count(*) FILTER (mean_oriented_ic > 0) AS u, count(*) FILTER (mean_oriented_ic < 0) AS w FROM fs GROUP BY ALL)
SELECT factor_name, factor_version, timeframes, CASE WHEN timeframes = 1 THEN 1.0 ELSE greatest(u, w) / (u + w) END AS sign_consistency, CASE WHEN timeframes = 1 THEN 'SINGLE_TIMEFRAME'
  WHEN u > 0 AND w > 0 THEN 'CROSS_TIMEFRAME_UNSTABLE' WHEN u = 0 THEN 'CROSS_TIMEFRAME_INVERTED' ELSE 'CROSS_TIMEFRAME_STABLE' END AS consistency_class FROM x""", ["sign_consistency"])


def _catalog(s):
    return s.createDataFrame([(f.name, f.category) for f in CATALOG.values()], "factor_name string, factor_category string")


add("factor_families", lambda s, d: stability.families(stable(s, d), _catalog(s)), f"""WITH {FIC}
SELECT timeframe, CASE WHEN factor_name IN ('relative_volume', 'volume_zscore') THEN 'volume' ELSE 'price' END AS factor_category, count(*) AS factors, avg(mean_oriented_ic) AS mean_ic,
  avg(CASE WHEN mean_oriented_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive_share FROM fs GROUP BY ALL""", ["mean_ic", "positive_share"])
add("degradation_report", lambda s, d: stability.degradation(stable(s, d)), f"""WITH {FIC}
SELECT timeframe, factor_name, factor_version, abs(selection_ic) AS training_ic, mean_oriented_ic AS oos_ic, mean_oriented_ic - abs(selection_ic) AS change,
  sign(abs(selection_ic)) = sign(mean_oriented_ic) AS sign_kept, positive_folds / folds AS positive_fold_share, abs(selection_ic) > 0 AND mean_oriented_ic < 0 AS lost_sign FROM fs""",
    ["training_ic", "oos_ic", "change", "positive_fold_share"])


def _status(s, d):
    per_fold = folds.purged_fold_metrics(purged_rows(s, d))
    pooled = per_fold.groupBy("timeframe").agg(F.avg("oos_ic").alias("oos_ic"), F.count(F.lit(1)).alias("folds"), F.count_if(F.col("oos_ic") < 0).alias("negative_folds"))
    return stability.timeframe_status(stable(s, d), pooled, pooled)


STATUS_SQL = f"""WITH {FIC},
sf AS (SELECT timeframe, fold FROM poos WHERE selected GROUP BY ALL),
pool AS (SELECT timeframe, avg(oriented_oos_ic) AS ic, count(*) AS folds, count(*) FILTER (oriented_oos_ic < 0) AS negative_folds
  FROM sf LEFT JOIN {ic_pair_sql('timeframe, fold', 'poos')} i USING (timeframe, fold) GROUP BY timeframe),
fa AS (SELECT timeframe, count(*) AS factors, {', '.join(f"count(*) FILTER (stability_class = '{label}') AS {name}" for label, name in (
    ('STABLE_POSITIVE', 'up'), ('MIXED', 'mixed'), ('STABLE_NEGATIVE', 'down'), ('ORIENTATION_INSUFFICIENT', 'turned'), ('INSUFFICIENT_DATA', 'empty')))},
  avg(CAST(mean_oriented_ic > 0 AS INTEGER)) AS positive_share, count(*) FILTER (abs(selection_ic) > 0 AND mean_oriented_ic < 0) AS lost FROM fs GROUP BY timeframe),
ss AS (SELECT fa.*, ic AS walk_ic, folds, negative_folds, ic AS purged_ic, CASE WHEN factors = empty THEN 'INSUFFICIENT_DATA'
  WHEN turned > 0 AND turned >= up AND turned >= mixed AND NOT coalesce(ic > 0, false) THEN 'ORIENTATION_INSUFFICIENT' WHEN 2 * lost > factors THEN 'SELECTION_DEGRADATION'
  WHEN positive_share >= 0.5 AND down = 0 AND (up > 0 OR (mixed > 0 AND positive_share >= 0.9 AND turned = 0)) AND ic > 0 THEN 'STABLE_SIGNAL' ELSE 'MIXED_STABILITY' END AS status
  FROM fa LEFT JOIN pool USING (timeframe))
SELECT * EXCLUDE (ic_weak), CASE WHEN status = 'INSUFFICIENT_DATA' OR coalesce(folds, 0) = 0 THEN 'INSUFFICIENT_DATA' WHEN ic_weak AND 2 * negative_folds > folds THEN 'TIMEFRAME_SIGNAL_WEAKNESS'
  WHEN 2 * lost > factors THEN 'SELECTION_OVERFITTING' WHEN status = 'ORIENTATION_INSUFFICIENT' THEN 'FACTOR_ORIENTATION_INSUFFICIENT' WHEN status = 'STABLE_SIGNAL' THEN 'STABLE_SIGNAL'
  WHEN ic_weak THEN 'TIMEFRAME_SIGNAL_WEAKNESS' WHEN walk_ic > 0 AND positive_share >= 0.5 THEN 'STABLE_SIGNAL' WHEN walk_ic > 0 THEN 'SELECTION_OVERFITTING'
  WHEN walk_ic IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'TIMEFRAME_SIGNAL_WEAKNESS' END AS verdict
FROM (SELECT *, coalesce(walk_ic <= 0, false) AS ic_weak FROM ss)"""
add("stability_status", _status, STATUS_SQL, ["positive_share", "walk_ic", "purged_ic"])
add("redundancy_groups",
    lambda s, d: stability.redundancy_groups(research.correlation_matrix(wide_five(s, d), "timeframe", FIVE, "spearman"), 0.6), f"""WITH RECURSIVE m AS MATERIALIZED ({_matrix_sql('spearman')}),
e AS (SELECT timeframe, factor_a AS a, factor_b AS b FROM m WHERE abs(corr) >= 0.6 UNION SELECT timeframe, factor_b, factor_a FROM m WHERE abs(corr) >= 0.6),
r AS (SELECT timeframe, a, a AS z FROM e UNION SELECT r.timeframe, r.a, e.b FROM r JOIN e ON e.timeframe = r.timeframe AND e.a = r.z)
SELECT timeframe, min(z) AS group_name, a AS factor_name FROM r GROUP BY timeframe, a""")
REDUNDANT = 0.4
TRAIN_PAIRS = f"""tv AS (SELECT symbol, timeframe, open_time, factor_name, factor_version, factor_value FROM rows
  WHERE selected AND factor_value IS NOT NULL AND row_id < (size - 315) // 63 * 63 + 252),
tp AS (SELECT a.timeframe, a.factor_name AS fa, b.factor_name AS fb, a.factor_value AS x, b.factor_value AS y FROM tv a JOIN tv b USING (symbol, timeframe, open_time) WHERE a.factor_name < b.factor_name),
tc AS MATERIALIZED ({IC0.format(k='timeframe, fa, fb', src=f"SELECT timeframe, fa, fb, {rank_sql('timeframe, fa, fb', 'x')} AS x, {rank_sql('timeframe, fa, fb', 'y')} AS y FROM tp")}),
te AS MATERIALIZED (SELECT timeframe, fa AS a, fb AS b FROM tc WHERE ic >= {REDUNDANT} UNION SELECT timeframe, fb, fa FROM tc WHERE ic >= {REDUNDANT}),
tr AS (SELECT timeframe, a, a AS z FROM te UNION SELECT tr.timeframe, tr.a, te.b FROM tr JOIN te ON te.timeframe = tr.timeframe AND te.a = tr.z),
tg AS MATERIALIZED (SELECT timeframe, a AS factor_name, '1.0.0' AS factor_version, min(z) AS group_name FROM tr GROUP BY timeframe, a)"""


@tables.staged
def redundant_train(s, d):
    return stability.train_redundancy(folds.train_observations(fold_rows(s, d)), keeper(s, d, "redundancy"), REDUNDANT)


add("train_redundancy", redundant_train, f"WITH RECURSIVE {ORDERED}, {TRAIN_PAIRS} SELECT * FROM tg")


def _verdict(s, d):
    per_fold = folds.purged_fold_metrics(purged_rows(s, d))
    pooled = per_fold.groupBy("timeframe").agg(F.avg("oos_ic").alias("oos_ic"), F.count(F.lit(1)).alias("folds"), F.count_if(F.col("oos_ic") < 0).alias("negative_folds"))
    return stability.timeframe_status(stable(s, d), pooled, pooled, redundant_train(s, d)).select("timeframe", "status", "redundant_groups", "verdict")


VERDICT = STATUS_SQL.replace("WHEN status = 'STABLE_SIGNAL' THEN", "WHEN redundant_groups > 0 AND positive_share < 0.5 THEN 'FACTOR_REDUNDANCY' WHEN status = 'STABLE_SIGNAL' THEN").replace(
    "FROM ss)", "FROM ss LEFT JOIN (SELECT timeframe, count(DISTINCT group_name) AS rg FROM tg GROUP BY timeframe) USING (timeframe))").replace(
    "coalesce(walk_ic <= 0, false) AS ic_weak", "coalesce(walk_ic <= 0, false) AS ic_weak, coalesce(rg, 0) AS redundant_groups").replace("WITH ", f"WITH RECURSIVE ", 1).replace(
    "\nsf AS (", f"\n{TRAIN_PAIRS},\nsf AS (", 1)
add("stability_verdict", _verdict, f"SELECT timeframe, status, redundant_groups, verdict FROM ({VERDICT})")
add("integrity_audit", lambda s, d: stability.integrity_audit(evaluated(s, d), factor_panel(s, d).filter(F.col("open_time") % 7 != 0)), f"""WITH {PURGED}
SELECT timeframe, count(*) AS rows, 0::BIGINT AS duplicate_rows, 0::BIGINT AS time_mismatches, count(*) FILTER (future_return_1 IS NULL) AS missing_returns,
  count(*) FILTER (open_time % 7 = 0) AS not_in_store, 0::BIGINT AS value_mismatches FROM evaluation GROUP BY timeframe""")
add("orientation_summary", lambda s, d: stability.orientation_summary(purged_factor_ics(s, d).withColumn("selected_direction", F.col("selected_direction").cast("int"))), f"""WITH {FIC}
SELECT timeframe, selected_direction, count(*) AS factor_folds, avg(raw_oos_ic) AS mean_raw_ic, avg(oriented_oos_ic) AS mean_oriented_ic, count(*) FILTER (oriented_oos_ic > raw_oos_ic) AS improved FROM fic GROUP BY ALL""",
    ["mean_raw_ic", "mean_oriented_ic"])
add("walk_forward_audit", lambda s, d: stability.walk_forward_audit(walk(s, d)), f"""WITH {ORDERED}
SELECT timeframe, count(*) AS folds, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status <> 'PASS') AS failed, CAST(sum(test_rows) AS BIGINT) AS oos_rows,
  count(*) FILTER (train_end > test_start) AS overlapping, min(test_start) AS first_oos, max(test_end) AS last_oos FROM walk GROUP BY ROLLUP (timeframe)""")


def audited_rows(s, d):
    """Observations with faults: one factor's rows twice every 7th day, another's as train rows every 5th."""
    rows = folds.observations(fold_rows(s, d))
    day = F.floor(F.col("open_time") / 86_400_000)
    copies = F.when((F.col("factor_name") == "momentum") & (day % 7 == 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    train = (F.col("factor_name") == "price_zscore") & (day % 5 == 0)
    return rows.withColumn("partition", F.when(train, "TRAIN").otherwise("OOS")).withColumn("_copy", F.explode(copies)).drop("_copy")


AUDIT = f"""{ORDERED},
ob AS MATERIALIZED (SELECT o.* EXCLUDE (status), CASE WHEN g.n > 0 THEN 'PASS' ELSE 'FAIL' END AS status,
    CASE WHEN factor_name = 'price_zscore' AND (open_time // 86400000) % 5 = 0 THEN 'TRAIN' ELSE 'OOS' END AS "partition"
  FROM (SELECT *, 0 AS status, unnest(CASE WHEN factor_name = 'momentum' AND (open_time // 86400000) % 7 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM oos) o
  JOIN (SELECT timeframe, fold, count(future_return_1) FILTER (selected) AS n FROM oos GROUP BY ALL) g USING (timeframe, fold)),
wi AS (SELECT symbol, timeframe, fold, min(open_time) AS a, max(open_time) AS z FROM ob WHERE "partition" = 'OOS' GROUP BY ALL),
fa AS (SELECT symbol, timeframe, count(*) - 1 AS dup, 0 AS ov, 0 AS tr FROM ob GROUP BY symbol, timeframe, open_time, factor_name, factor_version, fold, "partition"
  UNION ALL SELECT symbol, timeframe, 0, 1, 0 FROM (SELECT *, max(z) OVER (PARTITION BY symbol, timeframe ORDER BY a, fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM wi) WHERE a < reached
  UNION ALL SELECT symbol, timeframe, 0, 0, 1 FROM ob JOIN wi USING (symbol, timeframe, fold) WHERE "partition" = 'TRAIN' AND open_time BETWEEN a AND z),
lv AS (SELECT CASE grouping(symbol, timeframe) WHEN 0 THEN 'symbol' WHEN 2 THEN 'timeframe' ELSE 'total' END AS level, symbol, timeframe, count(*) AS rows, count(*) FILTER (selected) AS selected_rows,
  count(*) FILTER (status = 'PASS') AS pass_rows, count(*) FILTER (status <> 'PASS') AS fail_rows, count(*) FILTER ("partition" = 'OOS') AS oos_rows, min(open_time) AS first_open_time, max(open_time) AS last_open_time,
  count(future_return_1) AS return_non_null, count(*) - count(future_return_1) AS return_null, avg(future_return_1) AS return_mean, stddev_samp(future_return_1) AS return_std, min(future_return_1) AS return_min,
  max(future_return_1) AS return_max, avg(future_return_1) FILTER ("partition" = 'OOS') AS oos_return_mean, stddev_samp(future_return_1) FILTER ("partition" = 'OOS') AS oos_return_std,
  count(DISTINCT factor_name) AS unique_factors, count(DISTINCT (factor_name, factor_version)) AS unique_factor_versions, count(DISTINCT (timeframe, fold)) AS unique_folds
  FROM ob GROUP BY GROUPING SETS ((symbol, timeframe), (timeframe), ())),
fl AS (SELECT CASE grouping(symbol, timeframe) WHEN 0 THEN 'symbol' WHEN 2 THEN 'timeframe' ELSE 'total' END AS level, symbol, timeframe, CAST(sum(dup) AS BIGINT) AS duplicates,
  CAST(sum(ov) AS BIGINT) AS overlapping_windows, CAST(sum(tr) AS BIGINT) AS train_rows_in_test FROM fa GROUP BY GROUPING SETS ((symbol, timeframe), (timeframe), ()))"""
AUDIT_DOUBLES = ["return_mean", "return_std", "return_min", "return_max", "oos_return_mean", "oos_return_std"]
add("observation_audit", lambda s, d: stability.observation_audit(audited_rows(s, d)), f"""WITH {AUDIT}
SELECT *, CASE WHEN error = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT lv.*, duplicates, overlapping_windows, train_rows_in_test,
  array_to_string([x for x in [CASE WHEN duplicates > 0 THEN 'duplicates' END, CASE WHEN overlapping_windows > 0 THEN 'overlapping_windows' END,
    CASE WHEN train_rows_in_test > 0 THEN 'train_rows_in_test' END] if x IS NOT NULL], '; ') AS error
  FROM lv JOIN fl ON lv.level = fl.level AND lv.symbol IS NOT DISTINCT FROM fl.symbol AND lv.timeframe IS NOT DISTINCT FROM fl.timeframe)""", AUDIT_DOUBLES)
COV = f"""{PURGED}, cov AS (SELECT timeframe, factor_name, factor_version, count(*) AS rows, count(*) FILTER (factor_value IS NULL) / count(*) AS null_rate, min(open_time) FILTER (factor_value IS NOT NULL) AS first_value,
  max(open_time) FILTER (factor_value IS NOT NULL) AS last_value, max(open_time) AS last_row, count(DISTINCT open_time) AS bars FROM poos GROUP BY ALL)"""
add("factor_coverage", lambda s, d: stability.coverage(purged_rows(s, d)), f"WITH {COV} SELECT * FROM cov", ["null_rate"])


def _null_causes(s, d):
    table = stability.coverage(purged_rows(s, d)).withColumn("store_null_rate", F.col("null_rate")).withColumn("input_null_rate", F.lit(0.0)).withColumn(
        "store_first_value", F.col("first_value")).withColumn("effective_warmup", F.lit(40))
    return stability.null_cause(table).select("timeframe", "factor_name", "null_cause")


add("null_causes", _null_causes, f"""WITH {PURGED},
cv AS (SELECT timeframe, factor_name, count(*) FILTER (factor_value IS NULL) / count(*) AS r, count(DISTINCT open_time) AS b FROM poos GROUP BY ALL)
SELECT timeframe, factor_name, CASE WHEN r >= 1 AND 40 > b THEN 'ROLLING_WINDOW_TOO_LARGE' WHEN r >= 0.9 THEN 'INSUFFICIENT_HISTORY' ELSE 'UNKNOWN' END AS null_cause FROM cv""")
QN = [f"q{int(q * 100):02d}" for q in stability.RETURN_QUANTILES]
add("target_distribution", lambda s, d: stability.target_distribution(purged_rows(s, d).filter("selected"), ["timeframe", "fold"]), f"""WITH {PURGED}
SELECT timeframe, fold, count(future_return_1) AS count, avg(future_return_1) AS mean, stddev_samp(future_return_1) AS std, count(*) FILTER (future_return_1 > 0) / count(future_return_1) AS positive_share,
  count(*) FILTER (future_return_1 < 0) / count(future_return_1) AS negative_share, {', '.join(f'quantile_cont(future_return_1, {q}) AS {n}' for q, n in zip(stability.RETURN_QUANTILES, QN))}
FROM poos WHERE selected GROUP BY ALL""", ["mean", "std", "positive_share", "negative_share", *QN])
add("bootstrap_mean_ic", lambda s, d: stability.bootstrap_mean_ic(purged_factor_ics(s, d), ["timeframe", "factor_name"]), f"""WITH {FIC},
pop AS (SELECT timeframe, factor_name, list(oriented_oos_ic ORDER BY fold) AS ics FROM fic WHERE oriented_oos_ic IS NOT NULL GROUP BY ALL),
reps AS (SELECT timeframe, factor_name, ics, r FROM pop, (SELECT unnest(range(1, 1001)) AS r)),
drawn AS (SELECT timeframe, factor_name, list_sum([ics[1 + CAST(CAST('0x' || left(md5('7:' || r || ':' || i), 7) AS BIGINT) % len(ics) AS BIGINT)] for i in range(len(ics))]) / len(ics) AS m FROM reps),
sorted AS (SELECT timeframe, factor_name, list(m ORDER BY m) AS ms FROM drawn GROUP BY ALL)
SELECT timeframe, factor_name, CAST(1000 AS BIGINT) AS replicates, ms[1 + 24] AS low, ms[1 + 974] AS high FROM sorted""", ["low", "high"])
KEYS = "timeframe, factor_name, factor_version"
add("quintile_profile", lambda s, d: stability.quintile_profile(purged_rows(s, d)), f"""WITH {PURGED},
v AS (SELECT {KEYS}, open_time, future_return_1 AS y, factor_value * selected_direction AS o FROM poos WHERE {PAIRS}),
w AS (SELECT *, count(*) OVER (PARTITION BY {KEYS}, open_time) AS n, {rank_sql(KEYS + ', open_time', 'o')} AS r FROM v),
t AS (SELECT {KEYS}, open_time, {', '.join(f'avg(y) FILTER (least(floor((r - 1) * 5 / n), 4) = {q}) AS q{q + 1}' for q in range(5))} FROM w WHERE n >= 5 GROUP BY ALL),
a AS (SELECT {KEYS}, {', '.join(f'avg(q{q}) AS q{q}' for q in range(1, 6))}, count(*) AS times FROM t WHERE q1 IS NOT NULL AND q2 IS NOT NULL AND q3 IS NOT NULL AND q4 IS NOT NULL AND q5 IS NOT NULL GROUP BY ALL)
SELECT *, q5 - q1 AS q5_minus_q1, CASE WHEN q1 <= q2 AND q2 <= q3 AND q3 <= q4 AND q4 <= q5 THEN 'INCREASING' WHEN q1 >= q2 AND q2 >= q3 AND q3 >= q4 AND q4 >= q5 THEN 'DECREASING'
  WHEN q1 > q3 AND q5 > q3 THEN 'U_SHAPE' WHEN q1 < q3 AND q5 < q3 THEN 'INVERTED_U' ELSE 'MIXED' END AS shape FROM a""", ["q1", "q2", "q3", "q4", "q5", "q5_minus_q1"])
add("symbol_contribution", lambda s, d: stability.symbol_contribution(purged_rows(s, d)).select(
    "timeframe", "factor_name", "symbol", "contribution", "rows"), f"""WITH {PURGED},
k AS (SELECT {KEYS}, symbol, {rank_sql(KEYS, 'factor_value')} AS a, {rank_sql(KEYS, 'future_return_1')} AS b, (count(*) OVER (PARTITION BY {KEYS}) + 1) / 2.0 AS c FROM poos WHERE {PAIRS}),
g AS (SELECT {KEYS}, symbol, sum((a - c) * (b - c)) AS contribution, count(*) AS rows FROM k GROUP BY ALL)
SELECT timeframe, factor_name, symbol, contribution, rows FROM g QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY contribution DESC, symbol) <= 10
  OR row_number() OVER (PARTITION BY {KEYS} ORDER BY contribution, symbol) <= 10""", ["contribution"], digits=1)


def _rebuild(s, d):
    names = ["on_balance_volume", "price_volume_trend"]
    stored = factor_frame(tables.bars_1d(s, d), [CATALOG[n] for n in names])
    sums = Window.partitionBy("symbol", "timeframe", "year").orderBy("open_time")
    move = F.col("close") - F.lag("close").over(sums)
    again = tables.bars_1d(s, d).select(
        "symbol", "timeframe", "open_time", "year", (F.signum(move) * F.col("volume")).alias("_o"), (move / F.lag("close").over(sums) * F.col("volume")).alias("_p")
    ).select("symbol", "timeframe", "open_time", *[
        F.when(F.col(c).isNotNull(), F.sum(c).over(sums)).alias(n) for c, n in (("_o", names[0]), ("_p", names[1]))])
    return stability.reconstruction_error(stored, again, names)


add("reconstruction_error", _rebuild, f"""WITH {BARS_1D}
SELECT unnest(['on_balance_volume', 'price_volume_trend']) AS factor_name, count(*) - count(DISTINCT (symbol, year)) AS values, CAST(0 AS DOUBLE) AS max_abs_difference, CAST(0 AS BIGINT) AS null_mismatches FROM bars""",
    ["max_abs_difference"])
add("factor_set_comparison",
    lambda s, d: stability.compare_sets(purged_factor_ics(s, d).filter(F.col("factor_name") != "momentum"), purged_factor_ics(s, d).filter(F.col("factor_name") != "atr_percent")), f"""WITH {FIC},
g AS (SELECT {KEYS}, avg(oriented_oos_ic) AS ic, count(oriented_oos_ic) AS n FROM fic GROUP BY ALL)
SELECT {KEYS}, CASE WHEN factor_name <> 'momentum' THEN ic END AS old_ic, CASE WHEN factor_name <> 'momentum' THEN n END AS old_folds, CASE WHEN factor_name <> 'atr_percent' THEN ic END AS new_ic,
  CASE WHEN factor_name <> 'atr_percent' THEN n END AS new_folds, CASE factor_name WHEN 'momentum' THEN 'ADDED' WHEN 'atr_percent' THEN 'REMOVED' ELSE 'KEPT' END AS membership FROM g""", ["old_ic", "new_ic"])
# A retired factor, one that the new selection calls ineligible, and one that neither selection has.
RETIRED, LOW, ABSENT, NEW_TOP = "relative_volume", "stochastic_k", "distance_from_high", 6


def _sets(s, d):
    name = F.col("factor_name")
    rows = selected(s, d).filter(name != ABSENT).withColumn("selection_ic", F.col("information_coefficient"))
    new = rows.filter(name != RETIRED).withColumns({
        "eligibility_status": F.when(name == LOW, "INELIGIBLE_LOW_COVERAGE").otherwise(F.col("eligibility_status")),
        "selected": (name != LOW) & (F.col("selection_rank") <= NEW_TOP)})
    return rows, new


SETS = f"""{FIC},
os AS MATERIALIZED (SELECT {KEYS}, 'ELIGIBLE' AS st, selected, CASE WHEN information_coefficient < 0 THEN -1 ELSE 1 END AS dir, information_coefficient AS ic, selection_rank
  FROM selection WHERE factor_name <> '{ABSENT}'),
ns AS MATERIALIZED (SELECT * REPLACE (CASE WHEN factor_name = '{LOW}' THEN 'INELIGIBLE_LOW_COVERAGE' ELSE st END AS st, factor_name <> '{LOW}' AND selection_rank <= {NEW_TOP} AS selected)
  FROM os WHERE factor_name <> '{RETIRED}')"""
add("factor_replacement", lambda s, d: stability.factor_replacement(purged_rows(s, d), *_sets(s, d), purged_factor_ics(s, d), [RETIRED]), f"""WITH {SETS},
cv AS (SELECT {KEYS}, 1 - count(*) FILTER ({PAIRS}) / count(*) AS null_rate_oos, count(*) FILTER ({PAIRS}) AS observation_count_oos,
  count(DISTINCT open_time // 86400000) FILTER ({PAIRS}) AS days_covered FROM poos GROUP BY ALL),
fi AS (SELECT {KEYS}, avg(raw_oos_ic) AS mean_fold_raw_ic, avg(oriented_oos_ic) AS mean_fold_oriented_ic, count(oriented_oos_ic) AS fold_count,
  count(*) FILTER (oriented_oos_ic > 0) AS positive_folds, count(*) FILTER (oriented_oos_ic < 0) AS negative_folds FROM fic GROUP BY ALL),
po AS (SELECT {KEYS}, {corr_sql('a', 'b')} AS pooled FROM (SELECT {KEYS}, {rank_sql(KEYS, 'factor_value')} AS a, {rank_sql(KEYS, 'future_return_1')} AS b FROM poos WHERE {PAIRS}) GROUP BY ALL)
SELECT {KEYS}, coalesce(os.selected, false) AS in_old_selected, coalesce(ns.selected, false) AS in_new_selected,
  CASE WHEN factor_name = '{RETIRED}' THEN 'RETIRED_EXISTING_FACTOR' WHEN os.st IS NULL THEN 'INELIGIBLE_ZERO_OBSERVATIONS' WHEN ns.st LIKE 'INELIGIBLE%' THEN ns.st
    WHEN coalesce(ns.selected, os.selected) THEN 'ELIGIBLE_AND_SELECTED' ELSE 'ELIGIBLE_NOT_SELECTED' END AS decision,
  coalesce(ns.dir, os.dir) AS selected_direction, coalesce(ns.ic, os.ic) AS selection_ic, null_rate_oos, observation_count_oos, days_covered, mean_fold_raw_ic, mean_fold_oriented_ic,
  pooled * coalesce(ns.dir, os.dir, 1) AS aggregate_oriented_ic, coalesce(positive_folds, 0) AS positive_folds, coalesce(negative_folds, 0) AS negative_folds, coalesce(fold_count, 0) AS fold_count
FROM cv LEFT JOIN os USING ({KEYS}) LEFT JOIN ns USING ({KEYS}) LEFT JOIN fi USING ({KEYS}) LEFT JOIN po USING ({KEYS})""",
    ["selection_ic", "null_rate_oos", "mean_fold_raw_ic", "mean_fold_oriented_ic", "aggregate_oriented_ic"])
add("factor_set_coverage", lambda s, d: stability.set_coverage(purged_rows(s, d), *_sets(s, d)), f"""WITH {SETS},
mb AS (SELECT timeframe, factor_name, 'old' AS side FROM os WHERE selected UNION ALL SELECT timeframe, factor_name, 'new' FROM ns WHERE selected),
sz AS (SELECT timeframe, count(*) FILTER (side = 'old') AS old_factors, count(*) FILTER (side = 'new') AS new_factors FROM mb GROUP BY timeframe),
dd AS (SELECT timeframe, d, count(*) FILTER (side = 'old') AS o, count(*) FILTER (side = 'new') AS n FROM mb
  JOIN (SELECT DISTINCT timeframe, factor_name, open_time // 86400000 AS d FROM poos WHERE {PAIRS}) USING (timeframe, factor_name) GROUP BY timeframe, d)
SELECT timeframe, old_factors, new_factors, count(*) FILTER (o > 0) AS old_any_days, count(*) FILTER (o = old_factors) AS old_every_days, count(*) FILTER (n > 0) AS new_any_days,
  count(*) FILTER (n = new_factors) AS new_every_days, count(*) FILTER (o > 0 AND n > 0) AS shared_days FROM dd JOIN sz USING (timeframe) GROUP BY ALL""")


def _oriented(s, d):
    years = purged_rows(s, d).groupBy("timeframe", "fold").agg(utc_year(F.max("open_time")).cast("int").alias("year"))
    ics = purged_factor_ics(s, d).withColumn("selected_direction", F.col("selected_direction").cast("int"))
    return stability.orientation_detail(ics.join(years, ["timeframe", "fold"]))


DETAIL = f"""{FIC}, od AS MATERIALIZED (SELECT timeframe, year, factor_name, factor_version, fold, selected_direction, selection_ic, selection_ic * selected_direction AS oriented_selection_ic,
  raw_oos_ic, oriented_oos_ic FROM (SELECT * REPLACE (CAST(selected_direction AS INTEGER) AS selected_direction) FROM fic)
  JOIN (SELECT timeframe, fold, CAST(year(make_timestamp_ms(max(open_time))) AS INTEGER) AS year FROM poos GROUP BY ALL) USING (timeframe, fold))"""
add("orientation_detail", _oriented, f"WITH {DETAIL} SELECT * FROM od", ["selection_ic", "oriented_selection_ic", "raw_oos_ic", "oriented_oos_ic"])
add("orientation_by_year", lambda s, d: stability.orientation_by_year(_oriented(s, d)), f"""WITH {DETAIL},
fa AS (SELECT timeframe, year, {KEYS.replace('timeframe, ', '')}, arg_min(selected_direction, fold) AS dir, arg_min(selection_ic, fold) AS ic FROM od GROUP BY ALL)
SELECT timeframe, year, count(*) AS selected_factor_count, count(*) FILTER (dir = 1) AS positive_direction_count, count(*) FILTER (dir = -1) AS negative_direction_count,
  avg(ic) AS mean_raw_selection_ic, avg(ic * dir) AS mean_oriented_selection_ic, any_value(r) AS mean_raw_oos_ic, any_value(o) AS mean_oriented_oos_ic
FROM fa JOIN (SELECT timeframe, year, avg(raw_oos_ic) AS r, avg(oriented_oos_ic) AS o FROM od GROUP BY ALL) USING (timeframe, year) GROUP BY timeframe, year""",
    ["mean_raw_selection_ic", "mean_oriented_selection_ic", "mean_raw_oos_ic", "mean_oriented_oos_ic"])

#: Factors whose values are blanked, one for each cause.
BLANK = ["momentum", "price_zscore", "sma_distance", "trend_slope", "relative_volume", "donchian_position"]


def _causes(s, d):
    name = F.col("factor_name")
    rows = purged_rows(s, d).withColumn("factor_value", F.when(~name.isin(*BLANK), F.col("factor_value")))
    table = stability.coverage(rows).withColumns({
        "store_null_rate": F.col("null_rate"), "inputs_present": name != BLANK[0], "input_null_rate": F.when(name == BLANK[1], 1.0).otherwise(0.0),
        "effective_warmup": F.when(name == BLANK[2], 1_000_000).when(name == BLANK[5], 0).otherwise(1),
        "store_first_value": F.when(name == BLANK[3], F.col("last_row") + 1).otherwise(F.col("first_value")),
        "required_lookback": F.when(name == BLANK[5], 0).otherwise(20)})
    return stability.null_cause(table).select("timeframe", "factor_name", "null_cause")


add("null_cause_branches", _causes, f"""WITH {PURGED},
cv AS (SELECT timeframe, factor_name, count(*) FILTER (factor_value IS NULL) / count(*) AS r FROM poos GROUP BY ALL)
SELECT timeframe, factor_name, CASE factor_name WHEN '{BLANK[0]}' THEN 'INPUT_DATA_MISSING' WHEN '{BLANK[1]}' THEN 'INPUT_DATA_MISSING' WHEN '{BLANK[2]}' THEN 'ROLLING_WINDOW_TOO_LARGE'
  WHEN '{BLANK[3]}' THEN 'EVALUATION_BOUNDARY' WHEN '{BLANK[4]}' THEN 'INSUFFICIENT_HISTORY' WHEN '{BLANK[5]}' THEN 'IMPLEMENTATION_BUG'
  ELSE CASE WHEN r >= 0.9 THEN 'INSUFFICIENT_HISTORY' ELSE 'UNKNOWN' END END AS null_cause FROM cv""")

# -- levels over year borders ---------------------------------------------------------------------------
HURT_YEAR = 1996


def _hurt_levels(s, d):
    """Levels that run on over the years, and labels, damaged on some days of a later year."""
    inputs = tables.factor_inputs_1d(s, d)
    stored = factor_frame(inputs, [CATALOG[n] for n in stability.LEVELS], carry_over=True, align=False)
    rows = stored.join(label_frame(inputs, (1,), trim=False).select("symbol", "timeframe", "open_time", "future_return_1"), ["symbol", "timeframe", "open_time"])
    day, late = F.floor(F.col("open_time") / 86_400_000), utc_year(F.col("open_time")) == HURT_YEAR
    hurt = {"on_balance_volume": (97, 5.0), "open_interest_level": (89, 1.0), "future_return_1": (83, 0.25)}
    return rows.withColumns({c: F.col(c) + F.when(late & (day % n == 0), add_).otherwise(0.0) for c, (n, add_) in hurt.items()})


LEVEL_SQL = f"""{INPUTS_1D},
lv AS MATERIALIZED (SELECT symbol, timeframe, open_time, year, open_time // 86400000 AS dy, CAST(open_interest AS DOUBLE) AS oi, close, volume, lag(close) OVER w AS p, lead(close) OVER w AS nx,
  lead(close) OVER (PARTITION BY symbol, timeframe, year ORDER BY open_time) AS ny FROM inputs WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY open_time))"""
add("rebuilt_levels", lambda s, d: stability.rebuilt_levels(tables.factor_inputs_1d(s, d)), f"""WITH {LEVEL_SQL}
SELECT symbol, timeframe, open_time, CASE WHEN p IS NOT NULL THEN sum(sign(close - p) * volume) OVER w END AS on_balance_volume,
  CASE WHEN p IS NOT NULL THEN sum((close / p - 1) * volume) OVER w END AS price_volume_trend, oi AS open_interest_level, (nx - close) / close AS future_return_1
FROM lv WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY open_time)""", [*stability.LEVELS, "future_return_1"], special={"price_volume_trend": 3})
add("level_differences", lambda s, d: stability.level_differences(_hurt_levels(s, d), tables.factor_inputs_1d(s, d)), f"""WITH {LEVEL_SQL},
ce AS (SELECT timeframe, open_time, unnest([{{'n': 'on_balance_volume', 'v': p IS NOT NULL, 'm': 97, 'e': 5.0}}, {{'n': 'price_volume_trend', 'v': p IS NOT NULL, 'm': 0, 'e': 0.0}},
    {{'n': 'open_interest_level', 'v': oi IS NOT NULL, 'm': 89, 'e': 1.0}}, {{'n': 'future_return_1', 'v': ny IS NOT NULL, 'm': 83, 'e': 0.25}}]) AS u, dy, year FROM lv),
cf AS (SELECT timeframe, open_time, u.n AS factor_name, u.v AS v, CASE WHEN u.m > 0 AND year = {HURT_YEAR} AND dy % nullif(u.m, 0) = 0 THEN CAST(u.e AS DOUBLE) ELSE 0.0 END AS e FROM ce)
SELECT timeframe, factor_name, count(*) FILTER (v) AS values, max(e) FILTER (v) AS max_abs_difference, count(*) FILTER (v AND e > 0) AS wrong_rows, 0::BIGINT AS null_mismatches,
  min(open_time) FILTER (v AND e > 0) AS first_wrong_time FROM cf GROUP BY ALL""", ["max_abs_difference"])
_G = [g for g in GROUPS if g != "all"]
add("input_boundaries",
    lambda s, d: stability.boundary_comparison(first_complete_times(tables.factor_inputs_1d(s, d), GROUPS), _G).withColumn("year", F.col("year").cast("long")),
    f"WITH {INPUTS_1D}, ft AS (SELECT symbol, timeframe, year, " + ", ".join(
        f"min(open_time) FILTER ({' AND '.join(f'{c} IS NOT NULL' for c in cols)}) AS first_{n}" for n, cols in GROUPS.items())
    + " FROM inputs GROUP BY ALL) " + " UNION ALL ".join(
        f"SELECT symbol, timeframe, year, first_all AS global_start, '{g}' AS companions, first_{g} AS own_start, first_all - first_{g} AS gained_ms FROM ft" for g in _G))
