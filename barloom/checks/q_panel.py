"""Queries for the factor panel: reshaping, factor tests, selection, combination, alpha."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import combination, factor_tests, panel_checks, selection, verify
from barloom.operators.factors import CATALOG, factor_frame, factor_long
from barloom.operators.labels import label_frame
from barloom.operators.panel import IDENTITY, evaluation_panel, long_to_wide, validation_panel
from barloom.sources.tables import csv_ready, restrict_panel

from . import tables
from .factor_sql import FACTOR_SQL, SERIES, staged
from .q_data import HS, LABEL_COLS, LABEL_CTE, RET
from .registry import add
from .sql import BARS_1D, BARS_1H

PANEL_FACTORS = ["momentum", "price_zscore", "sma_distance", "trend_slope", "relative_volume", "donchian_position",
                 "rolling_return_mean", "distance_from_high", "atr_percent", "stochastic_k"]
BAR_INPUT = ["symbol", "timeframe", "open_time", "open", "high", "low", "close", "volume", "year"]
ID_SQL = "factor_name, factor_version, timeframe"


@tables.staged
def bars_all(s, d):
    """Daily and hourly bars in one frame; every operator keeps the timeframes apart by key."""
    return tables.bars_1d(s, d).select(*BAR_INPUT).unionByName(tables.bars_1h(s, d).select(*BAR_INPUT))


@tables.staged
def factor_bars(s, d):
    return factor_frame(bars_all(s, d), [CATALOG[n] for n in PANEL_FACTORS])


@tables.staged
def factor_panel(s, d):
    return factor_long(factor_bars(s, d))


@tables.staged
def panel(s, d):
    return validation_panel(factor_bars(s, d), label_frame(bars_all(s, d)), factor_long)


def _renamed(cte: str, suffix: str) -> str:
    return cte.replace("bars AS MATERIALIZED (", f"bars_{suffix} AS MATERIALIZED (")


_wide = staged("bars", [{"one": "1"}], {n: FACTOR_SQL[n][1] for n in PANEL_FACTORS}, "symbol, timeframe, open_time")
WIDE_COLS = ", ".join(PANEL_FACTORS)
PANEL_SQL = f"""{_renamed(BARS_1D, 'd')},{_renamed(BARS_1H, 'h')},
bars AS (SELECT {', '.join(BAR_INPUT)} FROM bars_d UNION ALL SELECT {', '.join(BAR_INPUT)} FROM bars_h),
wide AS ({_wide}),
long AS (SELECT symbol, timeframe, open_time, factor_name, '1.0.0' AS factor_version, factor_value
  FROM (UNPIVOT (SELECT symbol, timeframe, open_time, {', '.join(f"coalesce({c}, 'nan'::DOUBLE) AS {c}" for c in PANEL_FACTORS)} FROM wide)
    ON {WIDE_COLS} INTO NAME factor_name VALUE v), LATERAL (SELECT CASE WHEN isnan(v) THEN NULL ELSE v END AS factor_value)),
labelled AS (SELECT symbol, timeframe, open_time, {LABEL_CTE} FROM bars),
labels_all AS (SELECT symbol, timeframe, open_time, {LABEL_COLS} FROM labelled WHERE future_return_20 IS NOT NULL),
panel AS MATERIALIZED (SELECT long.*, {', '.join(RET)} FROM long JOIN labels_all USING (symbol, timeframe, open_time))"""

CATEGORY_SQL = "CASE factor_name " + " ".join(f"WHEN '{n}' THEN '{CATALOG[n].category}'" for n in PANEL_FACTORS) + " END"

add("factor_panel_long",
    lambda s, d: factor_panel(s, d).select(
        "symbol", "timeframe", "open_time", "factor_name", "factor_version", "factor_category", "factor_value", "lookback"),
    f"""WITH {PANEL_SQL} SELECT symbol, timeframe, open_time, factor_name, factor_version, {CATEGORY_SQL} AS factor_category,
  factor_value, CAST(CASE factor_name {' '.join(f"WHEN '{n}' THEN {CATALOG[n].lookback}" for n in PANEL_FACTORS)} END AS INTEGER) AS lookback
FROM long""", ["factor_value"])
add("long_to_wide",
    lambda s, d: long_to_wide(factor_panel(s, d), PANEL_FACTORS),
    f"WITH {PANEL_SQL} SELECT symbol, timeframe, open_time, {WIDE_COLS} FROM wide", PANEL_FACTORS)
add("read_panel_pushdown",
    lambda s, d: restrict_panel(factor_panel(s, d), ["momentum", "atr_percent"], ["1.0.0"], 946684800000, 978307200000,
                                ["symbol", "open_time", "factor_name", "factor_value"]),
    f"""WITH {PANEL_SQL} SELECT symbol, open_time, factor_name, factor_value FROM long
WHERE factor_name IN ('momentum', 'atr_percent') AND open_time BETWEEN 946684800000 AND 978307200000""", ["factor_value"])
add("validation_panel",
    lambda s, d: panel(s, d).groupBy(*IDENTITY).agg(
        F.count("factor_value").alias("values"), F.count(F.lit(1)).alias("rows"), F.avg("future_return_5").alias("mean_return_5")),
    f"WITH {PANEL_SQL} SELECT {ID_SQL}, count(factor_value) AS values, count(*) AS rows, avg(future_return_5) AS mean_return_5 FROM panel GROUP BY ALL",
    ["mean_return_5"])

# -- factor tests -----------------------------------------------------------------------------------


def ic_sql(h: int) -> str:
    return f"""(SELECT {ID_SQL}, open_time, corr(factor_value, future_return_{h}) AS ic FROM panel
  WHERE factor_value IS NOT NULL AND future_return_{h} IS NOT NULL GROUP BY {ID_SQL}, open_time
  HAVING count(*) >= 2 AND stddev_pop(factor_value) > 0 AND stddev_pop(future_return_{h}) > 0)"""


TEST_SQL = f"""{PANEL_SQL},
ids AS (SELECT {ID_SQL}, min(open_time) AS validation_start_time, max(open_time) AS validation_end_time,
  count(*) FILTER (factor_value IS NOT NULL AND future_return_1 IS NOT NULL) AS observations FROM panel GROUP BY {ID_SQL}),
ic1 AS (SELECT {ID_SQL}, avg(ic) AS information_coefficient, stddev_samp(ic) AS ic_std, count(*) AS ic_observations FROM {ic_sql(1)} GROUP BY {ID_SQL}),
ic20 AS (SELECT {ID_SQL}, avg(ic) AS last_ic FROM {ic_sql(20)} GROUP BY {ID_SQL}),
qrank AS (SELECT {ID_SQL}, open_time, future_return_1, count(*) OVER (PARTITION BY {ID_SQL}, open_time) AS n,
  row_number() OVER (PARTITION BY {ID_SQL}, open_time ORDER BY factor_value, symbol) AS r FROM panel
  WHERE factor_value IS NOT NULL AND future_return_1 IS NOT NULL),
qmean AS (SELECT {ID_SQL}, open_time, {', '.join(f'avg(future_return_1) FILTER (((r - 1) * 5) // n = {q}) AS q{q + 1}' for q in range(5))}
  FROM qrank WHERE n >= 5 GROUP BY {ID_SQL}, open_time),
quant AS (SELECT {ID_SQL}, avg(q5 - q1) AS quantile_spread, avg(CASE WHEN (q1 <= q2 AND q2 <= q3 AND q3 <= q4 AND q4 <= q5)
  OR (q1 >= q2 AND q2 >= q3 AND q3 >= q4 AND q4 >= q5) THEN 1.0 ELSE 0.0 END) AS monotonicity_score FROM qmean GROUP BY {ID_SQL}),
held AS (SELECT {ID_SQL}, open_time, symbol, factor_value AS v FROM panel WHERE factor_value IS NOT NULL),
steps AS (SELECT *, lead(open_time) OVER (PARTITION BY {ID_SQL} ORDER BY open_time) AS nxt FROM (SELECT DISTINCT {ID_SQL}, open_time FROM held)),
common AS (SELECT a.*, b.v AS v2 FROM held a JOIN steps USING ({ID_SQL}, open_time) JOIN held b
  ON b.factor_name = a.factor_name AND b.timeframe = a.timeframe AND b.open_time = steps.nxt AND b.symbol = a.symbol),
placed AS (SELECT *, count(*) OVER (PARTITION BY {ID_SQL}, open_time) AS n,
  row_number() OVER (PARTITION BY {ID_SQL}, open_time ORDER BY v DESC, symbol) AS r1,
  row_number() OVER (PARTITION BY {ID_SQL}, open_time ORDER BY v2 DESC, symbol) AS r2 FROM common),
turn AS (SELECT {ID_SQL}, avg(t) AS turnover FROM (
  SELECT {ID_SQL}, open_time, 1.0 - count(*) FILTER (r1 <= greatest(1, n // 5) AND r2 <= greatest(1, n // 5)) / max(greatest(1, n // 5)) AS t
  FROM placed WHERE n >= 5 GROUP BY {ID_SQL}, open_time) GROUP BY {ID_SQL}),
ranks AS (SELECT {ID_SQL}, rank() OVER (PARTITION BY {ID_SQL} ORDER BY factor_value) + (count(*) OVER (PARTITION BY {ID_SQL}, factor_value) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY {ID_SQL} ORDER BY future_return_1) + (count(*) OVER (PARTITION BY {ID_SQL}, future_return_1) - 1) / 2.0 AS ry
  FROM panel WHERE factor_value IS NOT NULL AND future_return_1 IS NOT NULL),
rankic AS (SELECT {ID_SQL}, corr(rx, ry) AS rank_information_coefficient FROM ranks GROUP BY {ID_SQL}),
validation AS MATERIALIZED (
  SELECT ids.*, {CATEGORY_SQL} AS factor_category, validation_end_time AS validation_time, information_coefficient, rank_information_coefficient,
    information_coefficient / nullif(ic_std, 0) AS ic_information_ratio, ic_std,
    information_coefficient / nullif(ic_std, 0) * sqrt(ic_observations) AS ic_t_stat, ic_observations,
    last_ic / nullif(information_coefficient, 0) AS ic_decay, quantile_spread, monotonicity_score, turnover
  FROM ids LEFT JOIN ic1 USING ({ID_SQL}) LEFT JOIN ic20 USING ({ID_SQL}) LEFT JOIN quant USING ({ID_SQL})
    LEFT JOIN turn USING ({ID_SQL}) LEFT JOIN rankic USING ({ID_SQL}))"""
# Student-t tail by Simpson's rule over the density.
P_VALUE = """(1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * abs(t) / 6000 *
  list_sum([CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(abs(t) * i / 2000, 2) / v, -(v + 1) / 2)
    for i in range(2001)]))"""
METRIC_COLS = [m for m in factor_tests.METRICS if m != "ic_p_value"]

add("factor_validation",
    lambda s, d: factor_tests.factor_validation(panel(s, d)), f"""WITH {TEST_SQL}
SELECT {ID_SQL}, factor_category, validation_start_time, validation_end_time, validation_time, observations, ic_observations,
  {', '.join(METRIC_COLS)}, {P_VALUE} AS ic_p_value, 'PASS' AS status
FROM (SELECT *, CAST(ic_observations - 1 AS DOUBLE) AS v, ic_t_stat AS t FROM validation)""", list(factor_tests.METRICS))
add("cross_sectional_ic", lambda s, d: factor_tests.ic_statistics(panel(s, d)), f"""WITH {TEST_SQL}
SELECT {ID_SQL}, information_coefficient, ic_std, ic_observations, ic_information_ratio, ic_t_stat, ic_decay FROM validation""",
    ["information_coefficient", "ic_std", "ic_information_ratio", "ic_t_stat", "ic_decay"])
add("rank_ic", lambda s, d: factor_tests.rank_ic(panel(s, d)), f"WITH {TEST_SQL} SELECT {ID_SQL}, rank_information_coefficient FROM validation",
    ["rank_information_coefficient"])
add("quantile_spread", lambda s, d: factor_tests.quantile_statistics(panel(s, d)),
    f"WITH {TEST_SQL} SELECT {ID_SQL}, quantile_spread, monotonicity_score FROM validation", ["quantile_spread", "monotonicity_score"])
add("factor_turnover", lambda s, d: factor_tests.turnover(panel(s, d)),
    f"WITH {TEST_SQL} SELECT {ID_SQL}, turnover FROM validation WHERE turnover IS NOT NULL", ["turnover"])


def hourly_validation(s, d):
    """The flagship: clean hourly bars, factors with moving-window and recursive formulas, labels, tests."""
    from barloom.functions.clock import with_year
    from barloom.operators.cleaning import clean

    bars = with_year(clean(tables.bars_1h(s, d), "ohlcv"))
    wide = factor_frame(bars, [CATALOG[n] for n in ("price_zscore", "momentum", "rsi", "rolling_return_mean")])
    return factor_tests.factor_validation(validation_panel(factor_long(wide), label_frame(bars)))


add("factor_validation_1h", hourly_validation)


@tables.staged
def validated(s, d):
    return factor_tests.factor_validation(panel(s, d))


VAL = f"""{TEST_SQL},
val AS (SELECT *, 'PASS' AS status FROM validation)"""
add("validation_top_factors",
    lambda s, d: factor_tests.top_factors(validated(s, d), 5).select(*IDENTITY, "information_coefficient"),
    f"""WITH {VAL} SELECT {ID_SQL}, information_coefficient FROM val
ORDER BY information_coefficient DESC NULLS LAST, rank_information_coefficient DESC NULLS LAST LIMIT 5""", ["information_coefficient"])
DIST_METRICS = [m for m in factor_tests.METRICS if m != "ic_p_value"]
add("validation_distribution",
    lambda s, d: factor_tests.metric_distribution(validated(s, d).drop("ic_p_value")),
    f"WITH {VAL} " + " UNION ALL ".join(f"""SELECT '{m}' AS metric, count({m}) AS count, avg({m}) AS mean, stddev_samp({m}) AS std, min({m}) AS min,
  quantile_cont({m}, 0.25) AS q25, quantile_cont({m}, 0.5) AS median, quantile_cont({m}, 0.75) AS q75, max({m}) AS max FROM val""" for m in DIST_METRICS),
    ["mean", "std", "min", "q25", "median", "q75", "max"])
add("validation_status_counts", lambda s, d: factor_tests.status_counts(validated(s, d)),
    f"WITH {VAL} SELECT timeframe, status, count(*) AS factors FROM val GROUP BY ALL")

# -- panel checks -----------------------------------------------------------------------------------
add("panel_null_classes", lambda s, d: panel_checks.null_classes(factor_panel(s, d)), f"""
WITH {PANEL_SQL}, f AS (SELECT symbol, {ID_SQL}, min(open_time) FILTER (factor_value IS NOT NULL) AS v FROM long GROUP BY ALL)
SELECT symbol, {ID_SQL}, CASE WHEN v IS NULL OR open_time < v THEN 'WARMUP' ELSE 'UNEXPECTED' END AS null_class, count(*) AS rows, min(open_time) AS first_time
FROM long JOIN f USING (symbol, {ID_SQL}) WHERE factor_value IS NULL GROUP BY ALL""")


def damaged_panel(s, d):
    """The panel with some values made infinite, NaN or subnormal by bar time."""
    day = F.floor(F.col("open_time") / 86_400_000)
    value = (
        F.when(day % 101 == 0, float("inf")).when(day % 103 == 0, float("-inf")).when(day % 107 == 0, float("nan"))
        .when(day % 109 == 0, 1e-310).when(day % 113 == 0, 1.7e308).otherwise(F.col("factor_value"))
    )
    version = F.when((F.col("factor_name") == "momentum") & (day % 2 == 0), "2.0.0").otherwise(F.col("factor_version"))
    return factor_panel(s, d).withColumn("factor_value", value).withColumn("factor_version", version)


DAMAGED = """CASE WHEN dy % 101 = 0 THEN 'POSITIVE_INFINITY' WHEN dy % 103 = 0 THEN 'NEGATIVE_INFINITY' WHEN dy % 107 = 0 THEN 'NAN'
  WHEN dy % 109 = 0 THEN 'UNDERFLOW' WHEN dy % 113 = 0 THEN 'OVERFLOW' END"""
DAMAGED_CTE = f"""damaged AS (SELECT symbol, timeframe, open_time, factor_name, factor_value, dy, {DAMAGED} AS kind,
  CASE WHEN factor_name = 'momentum' AND dy % 2 = 0 THEN '2.0.0' ELSE factor_version END AS factor_version
  FROM (SELECT *, open_time // 86400000 AS dy FROM long))"""
add("panel_invalid_numbers", lambda s, d: panel_checks.invalid_numbers(damaged_panel(s, d)), f"""WITH {PANEL_SQL}, {DAMAGED_CTE}
SELECT symbol, {ID_SQL}, kind AS invalid_class, count(*) AS rows, min(open_time) AS first_time FROM damaged WHERE kind IS NOT NULL GROUP BY ALL""")
add("panel_inconsistent_metadata", lambda s, d: panel_checks.inconsistent_metadata(damaged_panel(s, d)), f"""WITH {PANEL_SQL}, {DAMAGED_CTE}
SELECT factor_name, count(DISTINCT factor_version) AS versions, CAST(1 AS BIGINT) AS categories, count(*) AS rows FROM damaged
GROUP BY factor_name HAVING count(DISTINCT factor_version) > 1""")
add("panel_findings_totals", lambda s, d: panel_checks.finding_totals(panel_checks.failure_findings(damaged_panel(s, d))), f"""
WITH {PANEL_SQL}, {DAMAGED_CTE},
valid AS (SELECT symbol, {ID_SQL}, min(open_time) AS v FROM damaged WHERE factor_value IS NOT NULL OR kind IS NOT NULL GROUP BY ALL)
SELECT finding, count(*) AS rows, count(DISTINCT symbol) AS symbols, count(DISTINCT factor_name) AS factors FROM (
  SELECT 'UNEXPECTED' AS finding, symbol, factor_name FROM damaged JOIN valid USING (symbol, {ID_SQL})
    WHERE factor_value IS NULL AND kind IS NULL AND open_time >= v
  UNION ALL SELECT kind, symbol, factor_name FROM damaged WHERE kind = 'POSITIVE_INFINITY') GROUP BY finding""")

# -- selection --------------------------------------------------------------------------------------
TOP, CAND = 5, 8


@tables.staged
def selected(s, d):
    return selection.factor_selection(validated(s, d), TOP, CAND)


def _norm(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN 0.0 WHEN max({x}) OVER t = min({x}) OVER t THEN 1.0
      ELSE ({x} - min({x}) OVER t) / (max({x}) OVER t - min({x}) OVER t) END"""


INPUT_SQL = {"information_coefficient": "abs(information_coefficient)", "rank_information_coefficient": "abs(rank_information_coefficient)",
             "ic_information_ratio": "ic_information_ratio", "quantile_spread": "quantile_spread",
             "monotonicity": "monotonicity_score", "ic_decay": "ic_decay", "turnover": "-turnover"}
BAR_MS = "CASE timeframe WHEN '1h' THEN 3600000 ELSE 86400000 END"
SELECT_SQL = f"""{VAL},
fit AS (SELECT *, CAST((validation_end_time - validation_start_time) // ({BAR_MS}) + 1 AS BIGINT) AS available_history FROM val WHERE observations > 0),
norm AS (SELECT *, {', '.join(f'{_norm(x)} AS {n}_normalized' for n, x in INPUT_SQL.items())} FROM fit WINDOW t AS (PARTITION BY timeframe)),
score AS (SELECT *, {', '.join(f'{selection.WEIGHTS[n]} * {n}_normalized AS {n}_contribution' for n in INPUT_SQL)} FROM norm),
totals AS (SELECT *, {' + '.join(f'{n}_contribution' for n in INPUT_SQL)} AS selection_score FROM score),
picked AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY timeframe ORDER BY selection_score DESC, factor_name) AS INTEGER) AS selection_rank FROM totals),
selection AS MATERIALIZED (SELECT *, selection_rank <= {TOP} AS selected, CASE WHEN selection_rank > {CAND} THEN 'outside_candidate_n'
  WHEN selection_rank <= {TOP} THEN 'top_n' ELSE 'outside_top_n' END AS selection_reason FROM picked)"""
add("selection_eligibility",
    lambda s, d: selection.eligibility(validated(s, d), {n: CATALOG[n].lookback for n in PANEL_FACTORS}).select(
        *IDENTITY, "eligibility_status", "effective_warmup", "available_history", "warmup_sufficient"),
    f"""WITH {SELECT_SQL} SELECT {ID_SQL}, 'ELIGIBLE' AS eligibility_status, CAST(CASE factor_name
  {' '.join(f"WHEN '{n}' THEN {CATALOG[n].lookback}" for n in PANEL_FACTORS)} END AS INTEGER) AS effective_warmup, available_history, true AS warmup_sufficient FROM fit""")
_norms = [f"{n}_normalized" for n in selection.WEIGHTS]
_parts = [f"{n}_contribution" for n in selection.WEIGHTS]
add("selection_audit", lambda s, d: selection.selection_audit(selected(s, d)),
    f"WITH {SELECT_SQL} SELECT {', '.join(selection.AUDIT_COLUMNS)} FROM selection", ["selection_score", *_norms, *_parts])
add("selection_orientation",
    lambda s, d: selected(s, d).select(*IDENTITY, F.col("selected_direction").cast("int").alias("selected_direction"), "oriented_ic"),
    f"""WITH {SELECT_SQL} SELECT {ID_SQL}, CASE WHEN information_coefficient < 0 THEN -1 ELSE 1 END AS selected_direction,
  abs(information_coefficient) AS oriented_ic FROM selection""", ["oriented_ic"])
LIMIT, OVERLAP = 0.8, 500
PAIR_SQL = f"""{SELECT_SQL},
cand AS (SELECT {ID_SQL}, selection_rank FROM selection WHERE selection_rank <= {CAND}),
vals AS (SELECT c.timeframe, c.selection_rank AS r, l.symbol, l.open_time, l.factor_value AS v FROM long l JOIN cand c USING ({ID_SQL}) WHERE l.factor_value IS NOT NULL),
pairs AS MATERIALIZED (SELECT a.timeframe, CAST(a.r - 1 AS INTEGER) AS a, CAST(b.r - 1 AS INTEGER) AS b, count(*) AS overlap,
  CASE WHEN stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 THEN abs(covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v))) END AS abs_corr
  FROM vals a JOIN vals b ON a.timeframe = b.timeframe AND a.symbol = b.symbol AND a.open_time = b.open_time AND a.r < b.r GROUP BY a.timeframe, a.r, b.r)"""
add("candidate_correlations", lambda s, d: selection.candidate_correlations(selected(s, d), factor_panel(s, d), CAND),
    f"WITH {PAIR_SQL} SELECT * FROM pairs", ["abs_corr"])
# Greedy walk in SQL: state is the list of accepted ranks, one step per rank.
GREEDY_SQL = f"""{PAIR_SQL},
walk AS (
  SELECT timeframe, 0 AS pos, [0] AS accepted, NULL::INTEGER AS ref FROM (SELECT DISTINCT timeframe FROM cand)
  UNION ALL
  SELECT w.timeframe, w.pos + 1, CASE WHEN hit.ref IS NULL THEN list_append(w.accepted, w.pos + 1) ELSE w.accepted END, hit.ref
  FROM walk w, LATERAL (SELECT min(p.a) AS ref FROM pairs p WHERE p.timeframe = w.timeframe AND p.b = w.pos + 1
    AND list_contains(w.accepted, p.a) AND p.abs_corr >= {LIMIT} AND p.overlap >= {OVERLAP}) hit
  WHERE w.pos + 1 < {CAND}),
kept AS (SELECT *, sum(CASE WHEN ref IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY timeframe ORDER BY pos) AS k FROM walk)"""
add("redundancy_filter",
    lambda s, d: selection.redundancy_filter(selected(s, d), factor_panel(s, d), TOP, CAND, LIMIT, OVERLAP).select(
        *IDENTITY, "selection_rank", "selected", "selection_reason", "redundancy_rejected", "redundancy_reference_factor",
        "redundancy_correlation", "redundancy_overlap"),
    f"""WITH RECURSIVE {GREEDY_SQL}
SELECT s.factor_name, s.factor_version, s.timeframe, s.selection_rank, coalesce(k.ref IS NULL AND k.k <= {TOP}, false) AS selected,
  CASE WHEN k.pos IS NULL THEN s.selection_reason WHEN k.ref IS NOT NULL THEN 'redundant' WHEN k.k <= {TOP} THEN 'top_n' ELSE 'outside_top_n' END AS selection_reason,
  CASE WHEN k.pos IS NOT NULL THEN k.ref IS NOT NULL END AS redundancy_rejected, c.factor_name AS redundancy_reference_factor,
  p.abs_corr AS redundancy_correlation, p.overlap AS redundancy_overlap
FROM selection s LEFT JOIN kept k ON k.timeframe = s.timeframe AND k.pos = s.selection_rank - 1
LEFT JOIN cand c ON c.timeframe = s.timeframe AND c.selection_rank = k.ref + 1
LEFT JOIN pairs p ON p.timeframe = s.timeframe AND p.a = k.ref AND p.b = k.pos""", ["redundancy_correlation"])
TFA_SQL = f"""{SELECT_SQL},
tf AS (SELECT *, row_number() OVER (PARTITION BY factor_name ORDER BY selection_score DESC, timeframe) AS place FROM selection WHERE selected),
tfa0 AS (SELECT factor_name, factor_version, max(factor_category) AS factor_category, max(validation_time) FILTER (place = 1) AS analysis_time,
  max(timeframe) FILTER (place = 1) AS best_timeframe, max(selection_score) AS best_selection_score, count(*) AS n,
  CASE WHEN count(*) > 1 THEN max(selection_score) - max(selection_score) FILTER (place = 2) END AS winner_margin,
  CASE WHEN count(*) > 1 THEN max(selection_score) - min(selection_score) END AS score_gap, stddev_pop(selection_score) AS sd FROM tf GROUP BY factor_name, factor_version),
tfa AS MATERIALIZED (SELECT *, CASE WHEN n < 2 OR score_gap = 0 THEN 1.0 ELSE 1 - least(greatest(sd / score_gap, 0), 1) END AS timeframe_stability FROM tfa0),
analysis AS MATERIALIZED (SELECT factor_name, factor_version, factor_category, analysis_time, best_timeframe, best_selection_score, 1 AS timeframe_rank,
  winner_margin, score_gap, timeframe_stability, CASE WHEN n < 2 THEN 1.0 ELSE least(greatest(0.5 * least(greatest(winner_margin, 0), 1) + 0.5 * timeframe_stability, 0), 1) END
  AS timeframe_confidence, true AS selected, 'PASS' AS status FROM tfa)"""
TFA_DOUBLES = ["best_selection_score", "winner_margin", "score_gap", "timeframe_stability", "timeframe_confidence"]
add("timeframe_analysis", lambda s, d: selection.timeframe_analysis(selected(s, d)), f"WITH {TFA_SQL} SELECT * FROM analysis", TFA_DOUBLES)
COMBO_SQL = f"""{TFA_SQL},
mm AS (SELECT *, CASE WHEN max(best_selection_score) OVER () = min(best_selection_score) OVER () THEN 1.0 ELSE
  (best_selection_score - min(best_selection_score) OVER ()) / (max(best_selection_score) OVER () - min(best_selection_score) OVER ()) END AS norm FROM analysis),
combo0 AS (SELECT a.factor_name || '|' || b.factor_name AS combination_id, [a.factor_name, b.factor_name] AS factor_names,
  [a.factor_version, b.factor_version] AS factor_versions, [a.factor_category, b.factor_category] AS factor_categories,
  CASE WHEN a.best_timeframe = b.best_timeframe OR a.best_selection_score > b.best_selection_score THEN a.best_timeframe
    WHEN b.best_selection_score > a.best_selection_score THEN b.best_timeframe ELSE least(a.best_timeframe, b.best_timeframe) END AS timeframe,
  2 AS combination_size, 'equal_weight' AS combination_method, (a.timeframe_confidence + b.timeframe_confidence) / 2 AS stability_score,
  (a.timeframe_confidence + b.timeframe_confidence + a.norm + b.norm) / 4 AS confidence_score,
  (a.best_selection_score + b.best_selection_score) / 2 AS combination_score, 'PASS' AS status
  FROM mm a JOIN mm b ON a.factor_name < b.factor_name),
combos AS MATERIALIZED (SELECT *, CAST(row_number() OVER (ORDER BY combination_score DESC, combination_id) AS INTEGER) AS combination_rank FROM combo0)"""
COMBO_TEXT = "* EXCLUDE (factor_names, factor_versions, factor_categories), " + ", ".join(
    f"array_to_string({c}, '|') AS {c}" for c in ("factor_names", "factor_versions", "factor_categories"))


@tables.staged
def combos(s, d):
    return combination.combinations(selection.timeframe_analysis(selected(s, d)))


add("factor_combinations", lambda s, d: csv_ready(combos(s, d)), f"WITH {COMBO_SQL} SELECT {COMBO_TEXT} FROM combos",
    ["stability_score", "confidence_score", "combination_score"])
SIGNAL_SQL = f"""{COMBO_SQL},
mem AS (SELECT combination_id, timeframe, unnest(factor_names) AS factor_name FROM combos),
sig AS MATERIALIZED (SELECT combination_id, symbol, timeframe, open_time, avg(factor_value) AS signal FROM long JOIN mem USING (factor_name, timeframe)
  WHERE factor_value IS NOT NULL GROUP BY ALL HAVING count(*) = 2)"""
add("combination_signal", lambda s, d: combination.combined_signal(combos(s, d), factor_panel(s, d)),
    f"WITH {SIGNAL_SQL} SELECT * FROM sig", ["signal"])


@tables.staged
def orthogonal(s, d):
    return combination.orthogonal_combinations(combos(s, d), factor_panel(s, d), 0.6, 500)


ORTH_SQL = f"""{SIGNAL_SQL},
pos AS (SELECT combination_id, timeframe, CAST(row_number() OVER (PARTITION BY timeframe ORDER BY combination_rank) - 1 AS INTEGER) AS p FROM combos),
sp AS (SELECT s.*, pos.p FROM sig s JOIN pos USING (combination_id, timeframe)),
cp AS MATERIALIZED (SELECT a.timeframe, a.p AS a, b.p AS b, count(*) AS overlap, CASE WHEN stddev_pop(a.signal) > 0 AND stddev_pop(b.signal) > 0
  THEN abs(covar_pop(a.signal, b.signal) / (stddev_pop(a.signal) * stddev_pop(b.signal))) END AS abs_corr
  FROM sp a JOIN sp b ON a.timeframe = b.timeframe AND a.symbol = b.symbol AND a.open_time = b.open_time AND a.p < b.p GROUP BY a.timeframe, a.p, b.p),
cwalk AS (SELECT timeframe, 0 AS pos, [0] AS accepted, NULL::INTEGER AS ref FROM (SELECT DISTINCT timeframe FROM pos)
  UNION ALL SELECT w.timeframe, w.pos + 1, CASE WHEN hit.ref IS NULL THEN list_append(w.accepted, w.pos + 1) ELSE w.accepted END, hit.ref
  FROM cwalk w, LATERAL (SELECT min(c.a) AS ref FROM cp c WHERE c.timeframe = w.timeframe AND c.b = w.pos + 1
    AND list_contains(w.accepted, c.a) AND c.abs_corr >= 0.6 AND c.overlap >= 500) hit
  WHERE w.pos + 1 < (SELECT max(p) + 1 FROM pos WHERE pos.timeframe = w.timeframe)),
orth AS MATERIALIZED (SELECT pos.combination_id, pos.timeframe, w.ref IS NULL AS selected, r.combination_id AS redundancy_reference_combination_id, cp.abs_corr AS correlation_score,
  cp.overlap AS correlation_overlap, CAST(CASE WHEN w.ref IS NULL THEN sum(CASE WHEN w.ref IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY pos.timeframe ORDER BY pos.p) END AS INTEGER) AS orthogonalization_rank
  FROM pos JOIN cwalk w ON w.timeframe = pos.timeframe AND w.pos = pos.p LEFT JOIN pos r ON r.timeframe = pos.timeframe AND r.p = w.ref
  LEFT JOIN cp ON cp.timeframe = pos.timeframe AND cp.a = w.ref AND cp.b = w.pos)"""
add("orthogonal_combinations",
    lambda s, d: orthogonal(s, d).select("combination_id", "timeframe", "selected", "redundancy_reference_combination_id",
                                         "correlation_score", "correlation_overlap", "orthogonalization_rank"),
    f"WITH RECURSIVE {ORTH_SQL} SELECT * FROM orth", ["correlation_score"])
def orthogonal_table(s, d):
    times = factor_panel(s, d).agg(F.min("open_time"), F.max("open_time")).first()
    return combination.orthogonal_combinations(combos(s, d), factor_panel(s, d), 0.6, 500, combination.Lineage(times[0], times[1], dataset_version="test"))


add("orthogonalization_table", lambda s, d: csv_ready(orthogonal_table(s, d)), f"""WITH RECURSIVE {ORTH_SQL}
SELECT c.combination_id, {", ".join(f"array_to_string(c.{x}, '|') AS {x}" for x in ("factor_names", "factor_versions", "factor_categories"))}, c.timeframe, c.combination_size, c.combination_method,
  'correlation_filter' AS orthogonalization_method, '1.0.0' AS orthogonalization_version, CAST(NULL AS BIGINT) AS analysis_time, combination_rank AS source_combination_rank,
  combination_score AS source_combination_score, stability_score AS source_stability_score, confidence_score AS source_confidence_score, correlation_score, CAST(NULL AS DOUBLE) AS vif_score,
  correlation_score AS redundancy_score, CAST(NULL AS DOUBLE) AS orthogonality_score, CAST(NULL AS DOUBLE) AS information_retained, correlation_overlap,
  CAST(0.6 AS DOUBLE) AS correlation_threshold, CAST(500 AS BIGINT) AS min_overlap_threshold, true AS redundancy_checked, NOT o.selected AS redundancy_rejected, redundancy_reference_combination_id,
  o.selected, orthogonalization_rank, CASE WHEN o.selected THEN 'accepted' ELSE 'redundant' END AS orthogonalization_reason, '1.0.0' AS source_combination_version,
  '1.0.0' AS source_fta_version, '1.0.0' AS source_selection_version, 'test' AS dataset_version, (SELECT min(open_time) FROM long) AS validation_start_time,
  (SELECT max(open_time) FROM long) AS validation_end_time, CASE WHEN o.selected THEN 'PASS' ELSE 'FAIL' END AS status FROM combos c JOIN orth o USING (combination_id)""",
    ["source_combination_score", "source_stability_score", "source_confidence_score", "correlation_score", "redundancy_score", "correlation_threshold",
     "vif_score", "orthogonality_score", "information_retained"])


def damaged_combos(s, d):
    """Combination 1 with another score, 2 with an unknown member, 3 twice."""
    rank, score = F.col("combination_rank"), F.col("combination_score")
    changed = combos(s, d).withColumns({
        "combination_score": F.when(rank == 1, score + 1).otherwise(score),
        "factor_names": F.when(rank == 2, F.array(F.lit("ghost"), F.col("factor_names")[1])).otherwise(F.col("factor_names"))})
    return changed.withColumn("_copy", F.explode(F.when(rank == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_copy")


add("combination_lineage", lambda s, d: verify.combination_lineage(damaged_combos(s, d), selection.timeframe_analysis(selected(s, d))), f"""WITH {COMBO_SQL}
SELECT combination_id, CASE combination_rank WHEN 1 THEN 'score_mismatch' WHEN 2 THEN 'missing_factor' ELSE 'duplicate_id' END AS rule,
  CASE WHEN combination_rank = 2 THEN 'ghost' END AS detail FROM combos WHERE combination_rank <= 3""")


def damaged_orthogonal(s, d):
    """Combination 1 with another rank and once more under an unknown id, 2 twice, the last one gone, rejections without a correlation."""
    rank = F.col("source_combination_rank")
    table = orthogonal(s, d)
    last = table.agg(F.max("source_combination_rank")).first()[0]
    copies = F.when(rank == 1, F.array(F.col("combination_id"), F.lit("ghost"))).when(rank == 2, F.array(F.col("combination_id"), F.col("combination_id"))).otherwise(F.array("combination_id"))
    return table.filter(rank != last).withColumns({
        "correlation_score": F.when(F.col("redundancy_rejected"), F.lit(0.0)), "combination_id": F.explode(copies)}).withColumn(
        "source_combination_rank", F.when(rank == 1, 999).otherwise(rank))


add("orthogonalization_lineage", lambda s, d: verify.orthogonalization_lineage(damaged_orthogonal(s, d), combos(s, d)), f"""WITH RECURSIVE {ORTH_SQL},
j AS (SELECT combination_id, combination_rank, selected, max(combination_rank) OVER () AS last FROM combos JOIN orth USING (combination_id))
SELECT combination_id, 'rank_mismatch' AS rule FROM j WHERE combination_rank = 1 UNION ALL SELECT 'ghost', 'unknown_combination'
UNION ALL SELECT combination_id, 'duplicate_id' FROM j WHERE combination_rank = 2 UNION ALL SELECT combination_id, 'missing_combination' FROM j WHERE combination_rank = last
UNION ALL SELECT combination_id, 'weak_rejection' FROM j WHERE NOT selected AND combination_rank < last""")
add("alpha_scores", lambda s, d: combination.alpha_scores(orthogonal(s, d), factor_panel(s, d)),
    f"WITH RECURSIVE {ORTH_SQL} SELECT sig.combination_id, symbol, sig.timeframe, open_time, signal AS alpha_score FROM sig JOIN orth USING (combination_id) WHERE selected",
    ["alpha_score"])


def evaluated(s, d):
    """Not a stage table: a row per factor is broadcast to the panel, which costs less than a second copy of the panel."""
    return evaluation_panel(panel(s, d), selected(s, d))


EVAL_SQL = f"""{SELECT_SQL},
evaluation AS MATERIALIZED (SELECT p.*, s.selected, s.information_coefficient AS selection_ic, s.rank_information_coefficient AS selection_rank_ic, CASE WHEN s.information_coefficient < 0 THEN -1 ELSE 1 END AS selected_direction,
  p.open_time AS selection_time FROM panel p JOIN selection s USING ({ID_SQL}))"""
add("evaluation_panel",
    lambda s, d: evaluated(s, d).groupBy(*IDENTITY, "selected", F.col("selected_direction").cast("int").alias("selected_direction")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("factor_value").alias("mean_value"), F.max("selection_ic").alias("selection_ic")),
    f"WITH {EVAL_SQL} SELECT {ID_SQL}, selected, selected_direction, count(*) AS rows, avg(factor_value) AS mean_value, max(selection_ic) AS selection_ic FROM evaluation GROUP BY ALL",
    ["mean_value", "selection_ic"])
add("selection_rank_checks", lambda s, d: verify.selection_rank_checks(selected(s, d), TOP),
    f"WITH {SELECT_SQL} SELECT timeframe, true AS ranks_dense, true AS rank_follows_score, count(*) FILTER (selected) <= {TOP} AS survivors_within_top_n FROM selection GROUP BY timeframe")
add("verify_selection_vs_analysis",
    lambda s, d: verify.same_members(
        selection.timeframe_analysis(selected(s, d)), selected(s, d), ["factor_name", "factor_version"]),
    f"""WITH {SELECT_SQL} SELECT factor_name, factor_version, 'derived' AS missing_from FROM selection GROUP BY ALL HAVING NOT bool_or(selected)""")
