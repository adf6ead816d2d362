"""Queries for experiments over the rank layer: all statistics of a factor list, rolling windows, the universe run."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import experiment
from barloom.operators.factors import CATALOG, factor_frame
from barloom.operators.labels import HORIZONS

from . import tables
from .q_folds import rank_sql
from .q_panel import P_VALUE, PANEL_FACTORS, PANEL_SQL, bars_all, panel
from .registry import add

RETURNS = {h: f"future_return_{h}" for h in HORIZONS}
TRAIN, TEST, STEP = 252, 63, 42


def keeper(s, d, name: str):
    """Stage tables of one query."""
    return lambda part, df: tables.store(s, d).table(f"{name}_{part}", lambda: df)


@tables.staged
def wide_panel(s, d):
    return factor_frame(bars_all(s, d), [CATALOG[n] for n in PANEL_FACTORS])


def found(s, d):
    return experiment.tidy(experiment.experiment(panel(s, d), wide_panel(s, d), PANEL_FACTORS, RETURNS, keeper(s, d, "experiment")))


def corr_sql(a: str, b: str) -> str:
    return f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"


def layer_sql(keys: str, source: str, horizons) -> str:
    """Complete pairs with both ranks, and correlations per key, factor and horizon."""
    cells = ", ".join(f"{{'h': {h}, 'y': future_return_{h}}}" for h in horizons)
    group = f"{keys}, factor_name, h"
    return f"""cells AS (SELECT {keys}, factor_name, symbol, open_time, factor_value AS x, unnest([{cells}]) AS u FROM {source} WHERE factor_value IS NOT NULL),
layer AS MATERIALIZED (SELECT {group}, symbol, open_time, x, y, {rank_sql(group, 'x')} AS rx, {rank_sql(group, 'y')} AS ry
  FROM (SELECT * EXCLUDE (u), u.h AS h, u.y AS y FROM cells) WHERE y IS NOT NULL),
cf AS MATERIALIZED (SELECT {group}, count(*) AS pairs, {corr_sql('x', 'y')} AS ic, {corr_sql('rx', 'ry')} AS rank_ic FROM layer GROUP BY ALL HAVING count(*) >= 2),
bucketed AS (SELECT {group}, y, CAST(((row_number() OVER (PARTITION BY {group} ORDER BY x, open_time, symbol) - 1) * 5) // count(*) OVER (PARTITION BY {group}) + 1 AS INTEGER) AS q FROM layer),
qs AS MATERIALIZED (SELECT {group}, q, count(*) AS n, avg(y) AS mean, stddev_samp(y) AS std, min(y) AS low, max(y) AS high, median(y) AS mid FROM bucketed GROUP BY ALL)"""


WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in PANEL_FACTORS)
RANKED = ", ".join(f"{rank_sql('timeframe', c)} AS {c}" for c in PANEL_FACTORS)
PAIR_ROWS = " UNION ALL ".join(
    f"SELECT timeframe, '{a}' AS factor_name, '{b}' AS other, covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) AS c FROM cm GROUP BY timeframe"
    for i, a in enumerate(PANEL_FACTORS) for b in PANEL_FACTORS[i + 1:])
TF = "timeframe, factor_name"


def cells_sql(source: str, columns: dict[str, str], part: str = "NULL", other: str = "NULL") -> str:
    rows = ", ".join(f"{{'s': '{n}', 'v': CAST({c} AS DOUBLE)}}" for n, c in columns.items())
    return f"SELECT {TF}, u.s AS statistic, o AS other, p AS part, u.v AS value FROM (SELECT {TF}, CAST({other} AS VARCHAR) AS o, CAST({part} AS INTEGER) AS p, unnest([{rows}]) AS u FROM {source})"


add("research_experiment", found, f"""WITH {PANEL_SQL}, {layer_sql('timeframe', 'panel', HORIZONS)},
pv AS (SELECT {TF}, pairs, ic, rank_ic, CASE WHEN pairs > 2 THEN {P_VALUE} END AS p_value FROM (SELECT *, CAST(pairs - 2 AS DOUBLE) AS v, ic * sqrt(pairs - 2) / sqrt(1 - ic * ic) AS t FROM cf WHERE h = 1)),
hl AS (SELECT {TF}, min(h) FILTER (abs(rank_ic) < base / 2) AS half_life FROM (SELECT *, abs(first_value(rank_ic) OVER (PARTITION BY {TF} ORDER BY h)) AS base FROM cf) GROUP BY ALL),
sp AS (SELECT {TF}, max(mean) FILTER (q = 5) - max(mean) FILTER (q = 1) AS spread, coalesce(bool_and(mean >= p), true) OR coalesce(bool_and(mean <= p), true) AS monotonic
  FROM (SELECT *, lag(mean) OVER (PARTITION BY {TF} ORDER BY q) AS p FROM qs WHERE h = 1) GROUP BY ALL),
ab AS (SELECT {TF}, factor_value AS x, future_return_1 AS y, (row_number() OVER (PARTITION BY {TF} ORDER BY open_time, symbol) - 1) // 500 AS blk FROM panel),
bi AS (SELECT {TF}, blk, {corr_sql('rx', 'ry')} AS ic FROM (SELECT {TF}, blk, {rank_sql(TF + ', blk', 'x')} AS rx, {rank_sql(TF + ', blk', 'y')} AS ry
  FROM ab JOIN (SELECT {TF}, blk FROM ab GROUP BY ALL HAVING count(*) = 500) USING ({TF}, blk) WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY ALL),
st AS (SELECT {TF}, count(ic) AS blocks, avg(ic) AS mean_ic, coalesce(stddev_samp(ic), 0) AS std_ic, min(ic) AS min_ic, max(ic) AS max_ic,
  coalesce(least(greatest(1 - coalesce(stddev_samp(ic), 0) / nullif(abs(avg(ic)), 0), 0), 1), 0) AS score FROM bi GROUP BY ALL),
cm AS MATERIALIZED (SELECT timeframe, {RANKED} FROM wide WHERE {WHOLE}), pr AS ({PAIR_ROWS})
{cells_sql('pv', {n: n for n in ('pairs', 'ic', 'p_value', 'rank_ic')})}
UNION ALL {cells_sql('cf', {'decay_ic': 'rank_ic'}, 'h')}
UNION ALL {cells_sql('hl', {'half_life': 'half_life'})}
UNION ALL {cells_sql('(SELECT * FROM qs WHERE h = 1)', {'quantile_count': 'n', 'quantile_mean': 'mean', 'quantile_std': 'std', 'quantile_min': 'low', 'quantile_max': 'high', 'quantile_median': 'mid'}, 'q')}
UNION ALL {cells_sql('sp', {'spread': 'spread', 'monotonic': 'CAST(monotonic AS INTEGER)'})}
UNION ALL {cells_sql('st', {'stability_blocks': 'blocks', 'stability_mean_ic': 'mean_ic', 'stability_std_ic': 'std_ic', 'stability_min_ic': 'min_ic', 'stability_max_ic': 'max_ic', 'stability_stability_score': 'score'})}
UNION ALL {cells_sql('pr', {'pair_corr': 'c', 'pair_high': 'CAST(abs(c) >= 0.9 AS INTEGER)'}, other='other')}""", ["value"])

ROLL = f"""{PANEL_SQL},
tt AS (SELECT timeframe, open_time, row_number() OVER (PARTITION BY timeframe ORDER BY open_time) - 1 AS pos, count(*) OVER (PARTITION BY timeframe) AS n FROM (SELECT DISTINCT timeframe, open_time FROM panel)),
ww AS (SELECT timeframe, unnest(range(0, (max(n) - {TRAIN + TEST}) // {STEP} + 1)) AS k FROM tt GROUP BY timeframe HAVING max(n) >= {TRAIN + TEST}),
sl AS (SELECT p.*, CAST(ww.k AS INTEGER) AS win FROM ww JOIN tt ON tt.timeframe = ww.timeframe AND pos >= {TRAIN} + k * {STEP} AND pos < {TRAIN + TEST} + k * {STEP}
  JOIN panel p ON p.timeframe = tt.timeframe AND p.open_time = tt.open_time),
{layer_sql('timeframe, win', 'sl', (1,))},
rw AS MATERIALIZED (SELECT timeframe, win AS "window", factor_name, pairs, ic, rank_ic, spread FROM cf
  LEFT JOIN (SELECT timeframe, win, factor_name, max(mean) FILTER (q = 5) - max(mean) FILTER (q = 1) AS spread FROM qs GROUP BY ALL) USING (timeframe, win, factor_name))"""


def rolled(s, d):
    return experiment.rolling(panel(s, d), "future_return_1", TRAIN, TEST, STEP, keeper(s, d, "rolling"))


add("rolling_experiment", rolled, f"WITH {ROLL} SELECT * FROM rw", ["ic", "rank_ic", "spread"])
add("rolling_experiment_summary", lambda s, d: experiment.rolling_summary(rolled(s, d)), f"""WITH {ROLL},
pw AS (SELECT timeframe, "window", avg(ic) AS ic, avg(rank_ic) AS rank_ic, avg(spread) AS spread FROM rw GROUP BY ALL)
SELECT timeframe, count(*) AS windows, avg(ic) AS mean_ic, avg(rank_ic) AS mean_rank_ic, avg(spread) AS mean_quantile_spread,
  CASE WHEN avg(ic) = 0 THEN 0.0 ELSE least(greatest(1 - coalesce(stddev_samp(ic), 0) / abs(avg(ic)), 0), 1) END AS stability FROM pw GROUP BY timeframe""",
    ["mean_ic", "mean_rank_ic", "mean_quantile_spread", "stability"])

#: A factor without any value and one that never varies join the universe, so that skipped runs occur.
EXTRA = ("never_computed", "constant_factor")


def runs(s, d):
    rows = panel(s, d)
    flat = rows.filter(F.col("factor_name") == PANEL_FACTORS[0]).withColumns({"factor_name": F.lit(EXTRA[1]), "factor_value": F.lit(1.0)})
    universe = rows.select("factor_name", "symbol", "timeframe").unionByName(
        rows.select(F.explode(F.array(*[F.lit(n) for n in EXTRA])).alias("factor_name"), "symbol", "timeframe"))
    return experiment.universe_runs(rows.unionByName(flat), universe, RETURNS, keeper(s, d, "universe"))


RUNS = f"""{PANEL_SQL},
more AS (SELECT symbol, timeframe, open_time, factor_name, factor_value, {', '.join(RETURNS.values())} FROM panel
  UNION ALL SELECT symbol, timeframe, open_time, '{EXTRA[1]}', 1.0, {', '.join(RETURNS.values())} FROM panel WHERE factor_name = '{PANEL_FACTORS[0]}'),
{layer_sql('symbol, timeframe', 'more', HORIZONS)},
uni AS (SELECT *, unnest([{', '.join(map(str, HORIZONS))}]) AS h FROM (SELECT DISTINCT f.factor_name, symbol, timeframe FROM panel,
  (SELECT DISTINCT factor_name FROM more UNION ALL SELECT '{EXTRA[0]}') f)),
vals AS (SELECT factor_name, symbol, timeframe, count(factor_value) AS vals FROM more GROUP BY ALL),
runs AS (SELECT factor_name, symbol, timeframe, h AS horizon, coalesce(pairs, 0) AS pairs, ic, rank_ic, CASE WHEN coalesce(vals, 0) = 0 THEN 'compute' WHEN rank_ic IS NULL THEN 'analyze' END AS stage,
  CASE WHEN coalesce(vals, 0) = 0 THEN 'NO_VALUES' WHEN pairs IS NULL THEN 'TOO_FEW_PAIRS' WHEN rank_ic IS NULL THEN 'CONSTANT' END AS reason
  FROM uni LEFT JOIN vals USING (factor_name, symbol, timeframe) LEFT JOIN cf USING (factor_name, symbol, timeframe, h)),
runs2 AS MATERIALIZED (SELECT *, CASE WHEN stage IS NULL THEN 'COMPLETED' ELSE 'SKIPPED' END AS status FROM runs)"""
add("universe_runs", runs, f"WITH {RUNS} SELECT * FROM runs2", ["ic", "rank_ic"])
add("universe_leaderboard", lambda s, d: experiment.universe_leaderboard(runs(s, d)), f"""WITH {RUNS}
SELECT *, CAST(row_number() OVER (ORDER BY mean_rank_ic DESC NULLS LAST, factor_name) AS INTEGER) AS place FROM (
  SELECT factor_name, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (stage = 'compute') AS failed_compute, count(*) FILTER (stage = 'analyze') AS failed_analyze,
    avg(rank_ic) AS mean_rank_ic, avg(abs(rank_ic)) AS mean_abs_rank_ic FROM runs2 GROUP BY factor_name)""", ["mean_rank_ic", "mean_abs_rank_ic"])
