"""Queries for walk-forward and purged folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import folds

from . import tables
from .q_panel import EVAL_SQL, evaluated
from .registry import add

ORDERED = f"""{EVAL_SQL},
rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY timeframe ORDER BY selection_time, symbol, factor_name, factor_version) - 1 AS row_id,
  count(*) OVER (PARTITION BY timeframe) AS size FROM evaluation),
nf AS (SELECT timeframe, unnest(range(0, (max(size) - 315) // 63 + 1)) AS k FROM rows GROUP BY timeframe),
trainm AS (SELECT nf.timeframe, nf.k, min(selection_time) AS train_start, max(selection_time) AS train_end, count(*) AS train_rows,
  count(*) FILTER (selected) AS selected_factors FROM nf JOIN rows r ON r.timeframe = nf.timeframe AND r.row_id >= nf.k * 63 AND r.row_id < nf.k * 63 + 252 GROUP BY ALL),
oos AS MATERIALIZED (SELECT r.*, CAST((row_id - 252) // 63 + 1 AS INTEGER) AS fold FROM rows r
  WHERE row_id >= 252 AND (row_id - 252) // 63 <= (size - 315) // 63),
testm AS (SELECT timeframe, fold - 1 AS k, min(selection_time) AS test_start, max(selection_time) AS test_end, count(*) AS test_rows,
  count(future_return_1) FILTER (selected) AS n, avg(future_return_1) FILTER (selected) AS mean_return, stddev_samp(future_return_1) FILTER (selected) AS sd,
  count(*) FILTER (selected AND future_return_1 > 0) AS wins FROM oos GROUP BY timeframe, fold),
metrics AS MATERIALIZED (SELECT timeframe, CAST(k + 1 AS INTEGER) AS fold, train_start, train_end, test_start, test_end, train_rows, test_rows, selected_factors,
  mean_return, CASE WHEN sd > 0 THEN mean_return / sd END AS sharpe, wins / nullif(n, 0) AS win_rate,
  CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM trainm JOIN testm USING (timeframe, k)),
agg AS (SELECT timeframe, avg(mean_return) FILTER (status = 'PASS') AS train_score, avg(sharpe) FILTER (status = 'PASS') AS test_score,
  stddev_samp(sharpe) FILTER (status = 'PASS') AS sd FROM metrics GROUP BY timeframe),
walk AS MATERIALIZED (SELECT m.* EXCLUDE (mean_return, sharpe, win_rate), train_score, test_score, test_score / nullif(sd, 0) AS overfit_gap FROM metrics m JOIN agg USING (timeframe))"""


@tables.staged
def fold_rows(s, d):
    return folds.indexed(evaluated(s, d))


@tables.staged
def fold_returns(s, d):
    """The columns of the indexed rows that fold metrics read."""
    rows = folds.indexed(evaluated(s, d).select("timeframe", "selection_time", *folds.ROW_ORDER, "selected", folds.RETURN))
    return rows.drop(*folds.ROW_ORDER)


@tables.staged
def walk(s, d):
    return folds.walk_forward(folds.fold_metrics(fold_returns(s, d)))


@tables.staged
def members(s, d):
    return folds.purged_membership(walk(s, d))


add("fold_row_index",
    lambda s, d: fold_rows(s, d).select("timeframe", "row_id", "selection_time", "symbol", "factor_name"),
    f"WITH {ORDERED} SELECT timeframe, row_id, selection_time, symbol, factor_name FROM rows")
add("fold_metrics", lambda s, d: folds.fold_metrics(fold_rows(s, d)), f"WITH {ORDERED} SELECT * FROM metrics", ["mean_return", "sharpe", "win_rate"])
add("walk_forward", lambda s, d: folds.walk_forward(folds.fold_metrics(fold_rows(s, d))), f"WITH {ORDERED} SELECT * FROM walk",
    ["train_score", "test_score", "overfit_gap"])
add("out_of_sample_rows",
    lambda s, d: folds.observations(fold_rows(s, d)).groupBy("timeframe", "fold", "partition", "status").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("factor_value").alias("mean_value")),
    f"""WITH {ORDERED} SELECT timeframe, fold, 'OOS' AS partition, CASE WHEN count(future_return_1) FILTER (selected) > 0 THEN 'PASS' ELSE 'FAIL' END AS status,
  count(*) AS rows, avg(factor_value) AS mean_value FROM oos GROUP BY timeframe, fold""", ["mean_value"])
STATS = """count(future_return_1) AS oos_non_null_returns, avg(future_return_1) AS oos_return_mean, stddev_samp(future_return_1) AS oos_return_std,
  avg(CASE WHEN future_return_1 > 0 THEN 1.0 WHEN future_return_1 IS NOT NULL THEN 0.0 END) AS oos_positive_rate, product(1 + future_return_1) - 1 AS growth, sign(growth) * ln(1 + abs(growth)) AS oos_log_growth"""

SHORT_STATS = STATS[: STATS.index(", product")]


def log_growth(df):
    """Compounded returns of a fold span many magnitudes; their signed logarithm is compared."""
    growth = F.col("oos_cumulative_return")
    return df.withColumn("oos_log_growth", F.signum(growth) * F.ln(1 + F.abs(growth))).drop("oos_cumulative_return")


OOS_DOUBLES = ["oos_return_mean", "oos_return_std", "oos_positive_rate", "oos_log_growth"]
add("oos_fold_metrics", lambda s, d: log_growth(folds.oos_fold_metrics(fold_rows(s, d))), f"""WITH {ORDERED},
st AS (SELECT timeframe, fold, {STATS}, min(future_return_1) AS oos_return_min, max(future_return_1) AS oos_return_max FROM oos WHERE selected GROUP BY ALL)
SELECT m.timeframe, m.fold, m.test_rows AS oos_rows, m.train_rows, coalesce(oos_non_null_returns, 0) AS oos_non_null_returns,
  st.* EXCLUDE (timeframe, fold, oos_non_null_returns, growth), m.status FROM metrics m LEFT JOIN st USING (timeframe, fold)""",
    [*OOS_DOUBLES, "oos_return_min", "oos_return_max"])
add("factor_train_counts", lambda s, d: folds.factor_train_counts(fold_rows(s, d)), f"""WITH {ORDERED}
SELECT nf.timeframe, factor_name, factor_version, CAST(nf.k + 1 AS INTEGER) AS fold, count(*) AS train_rows
FROM nf JOIN rows r ON r.timeframe = nf.timeframe AND r.row_id >= nf.k * 63 AND r.row_id < nf.k * 63 + 252 GROUP BY ALL""")


def rank_sql(keys: str, value: str) -> str:
    return (f"rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0")


def ic_pair_sql(keys: str, source: str) -> str:
    """Raw and oriented rank IC per key over complete pairs."""
    ok = "factor_value IS NOT NULL AND future_return_1 IS NOT NULL AND selected"
    return f"""(SELECT {keys}, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(y) > 0 THEN covar_pop(a, y) / (stddev_pop(a) * stddev_pop(y)) END AS raw_oos_ic,
  CASE WHEN stddev_pop(b) > 0 AND stddev_pop(y) > 0 THEN covar_pop(b, y) / (stddev_pop(b) * stddev_pop(y)) END AS oriented_oos_ic
  FROM (SELECT {keys}, {rank_sql(keys, 'factor_value')} AS a, {rank_sql(keys, 'factor_value * selected_direction')} AS b,
    {rank_sql(keys, 'future_return_1')} AS y FROM {source} WHERE {ok}) GROUP BY {keys})"""


FF = "timeframe, fold, factor_name, factor_version"
add("fold_factor_metrics",
    lambda s, d: log_growth(folds.fold_factor_metrics(folds.out_of_sample(fold_rows(s, d), folds.Layout()))).withColumn(
        "selected_direction", F.col("selected_direction").cast("int")), f"""WITH {ORDERED},
st AS (SELECT {FF}, count(*) AS oos_rows, {STATS}, max(selection_ic) AS selection_ic, max(selection_rank_ic) AS selection_rank_ic, max(selected_direction) AS selected_direction FROM oos WHERE selected GROUP BY ALL)
SELECT st.* EXCLUDE (growth), raw_oos_ic, oriented_oos_ic, oriented_oos_ic AS oos_ic FROM st LEFT JOIN {ic_pair_sql(FF, 'oos')} i USING ({FF})""",
    [*OOS_DOUBLES, "selection_ic", "selection_rank_ic", "raw_oos_ic", "oriented_oos_ic", "oos_ic"])
add("walk_forward_summary",
    lambda s, d: folds.panel_summary(folds.oos_fold_metrics(fold_rows(s, d)), folds.out_of_sample(fold_rows(s, d), folds.Layout())).drop(
        "oos_cumulative_return"), f"""WITH {ORDERED}
SELECT timeframe, folds, train_rows, oos_rows, oos_non_null_returns, oos_return_mean, oos_return_std, oos_positive_rate, unique_selected_factors, 'PASS' AS status
FROM (SELECT timeframe, count(*) AS folds, CAST(sum(train_rows) AS BIGINT) AS train_rows, CAST(sum(test_rows) AS BIGINT) AS oos_rows FROM metrics GROUP BY timeframe)
JOIN (SELECT timeframe, {SHORT_STATS}, count(DISTINCT factor_name) AS unique_selected_factors FROM oos WHERE selected GROUP BY timeframe) USING (timeframe)""",
    OOS_DOUBLES[:3])

# -- purged folds -----------------------------------------------------------------------------------
PURGED = f"""{ORDERED},
bounds AS (SELECT timeframe, n, f, (f - 1) * (n // 5) + least(f - 1, n % 5) AS b, (f - 1) * (n // 5) + least(f - 1, n % 5) + n // 5 + CASE WHEN f - 1 < n % 5 THEN 1 ELSE 0 END AS e
  FROM (SELECT timeframe, count(*) AS n FROM walk GROUP BY timeframe), (SELECT unnest([1, 2, 3, 4, 5]) AS f)),
member AS MATERIALIZED (SELECT w.*, CAST(f AS INTEGER) AS purged_fold, CAST(w.fold - 1 AS BIGINT) AS row_id,
  CASE WHEN w.fold - 1 >= b AND w.fold - 1 < e THEN 'TEST' WHEN w.fold - 1 >= b - 5 AND w.fold - 1 < b THEN 'PURGE'
    WHEN w.fold - 1 >= e AND w.fold - 1 < e + 5 THEN 'PURGE' WHEN w.fold - 1 >= e + 5 AND w.fold - 1 < e + 10 THEN 'EMBARGO' ELSE 'TRAIN' END AS role
  FROM walk w JOIN bounds USING (timeframe)),
ranges AS (SELECT timeframe, purged_fold, min(test_start) AS range_start, max(test_end) AS range_end FROM member WHERE role = 'TEST' GROUP BY ALL),
poos AS MATERIALIZED (SELECT e.*, r.purged_fold AS fold FROM evaluation e JOIN ranges r ON e.timeframe = r.timeframe AND e.selection_time BETWEEN range_start AND range_end)"""
add("purged_membership", lambda s, d: members(s, d).select("timeframe", "purged_fold", "row_id", "role"),
    f"WITH {PURGED} SELECT timeframe, purged_fold, row_id, role FROM member")
add("purged_folds", lambda s, d: folds.purged_folds(members(s, d)), f"""WITH {PURGED}
SELECT timeframe, purged_fold, min(test_start) FILTER (role = 'TRAIN') AS train_start_time, max(test_start) FILTER (role = 'TRAIN') AS train_end_time,
  min(test_start) FILTER (role = 'TEST') AS test_start_time, max(test_start) FILTER (role = 'TEST') AS test_end_time,
  count(*) FILTER (role = 'TRAIN') AS train_rows, count(*) FILTER (role = 'TEST') AS test_rows, avg(train_score) FILTER (role = 'TRAIN') AS train_score,
  avg(test_score) FILTER (role = 'TEST') AS test_score, avg(train_score) FILTER (role = 'TRAIN') - avg(test_score) FILTER (role = 'TEST') AS overfit_gap,
  'PASS' AS status FROM member GROUP BY ALL""", ["train_score", "test_score", "overfit_gap"])
add("purged_train_ranges", lambda s, d: folds.purged_ranges(members(s, d), "TRAIN"), f"""WITH {PURGED}
SELECT timeframe, purged_fold, min(test_start) AS range_start, max(test_end) AS range_end FROM (
  SELECT *, row_id - row_number() OVER (PARTITION BY timeframe, purged_fold ORDER BY row_id) AS island FROM member WHERE role = 'TRAIN')
GROUP BY timeframe, purged_fold, island""")


def purged_oos(s, d):
    return folds.map_observations(evaluated(s, d), folds.purged_ranges(members(s, d), "TEST"))


add("purged_observations",
    lambda s, d: purged_oos(s, d).groupBy("timeframe", "fold").agg(F.count(F.lit(1)).alias("rows"), F.count_if("selected").alias("selected_rows")),
    f"WITH {PURGED} SELECT timeframe, fold, count(*) AS rows, count(*) FILTER (selected) AS selected_rows FROM poos GROUP BY ALL")
add("purged_fold_metrics", lambda s, d: folds.purged_fold_metrics(purged_oos(s, d)).drop("oos_cumulative_return"), f"""WITH {PURGED},
st AS (SELECT timeframe, fold, {SHORT_STATS}, median(future_return_1) AS oos_return_median FROM poos WHERE selected GROUP BY ALL)
SELECT st.*, raw_oos_ic, oriented_oos_ic, oriented_oos_ic AS oos_ic FROM st LEFT JOIN {ic_pair_sql('timeframe, fold', 'poos')} i USING (timeframe, fold)""",
    ["oos_return_mean", "oos_return_std", "oos_positive_rate", "oos_return_median", "raw_oos_ic", "oriented_oos_ic", "oos_ic"])
add("purged_factor_metrics",
    lambda s, d: folds.fold_factor_metrics(purged_oos(s, d)).select(
        "timeframe", "fold", "factor_name", "factor_version", "oos_rows", "oos_return_mean", "raw_oos_ic", "oriented_oos_ic"), f"""WITH {PURGED},
st AS (SELECT {FF}, count(*) AS oos_rows, avg(future_return_1) AS oos_return_mean FROM poos WHERE selected GROUP BY ALL)
SELECT st.*, raw_oos_ic, oriented_oos_ic FROM st LEFT JOIN {ic_pair_sql(FF, 'poos')} i USING ({FF})""",
    ["oos_return_mean", "raw_oos_ic", "oriented_oos_ic"])
add("purged_leakage_checks", lambda s, d: folds.leakage_checks(members(s, d)), f"""WITH {PURGED}
SELECT timeframe, 0::BIGINT AS rows_with_two_roles, 0::BIGINT AS train_rows_in_exclusion, 0::BIGINT AS rows_out_of_order, 0::BIGINT AS rows_tested_twice FROM member GROUP BY timeframe""")
add("purged_rebuild", lambda s, d: folds.rebuild_differences(members(s, d), walk(s, d)).groupBy("side").agg(F.count(F.lit(1)).alias("rows")),
    f"WITH {PURGED} SELECT 'stored' AS side, count(*) AS rows FROM member WHERE role = 'NONE' HAVING count(*) > 0")
add("purged_summary",
    lambda s, d: folds.purged_summary(folds.purged_folds(members(s, d))), f"""WITH {PURGED},
pf AS (SELECT timeframe, purged_fold, avg(train_score) FILTER (role = 'TRAIN') AS a, avg(test_score) FILTER (role = 'TEST') AS b FROM member GROUP BY ALL)
SELECT timeframe, count(*) AS folds, avg(a) AS mean_train_score, avg(b) AS mean_test_score, avg(a - b) AS mean_gap, count(*) AS passed FROM pf GROUP BY timeframe""",
    ["mean_train_score", "mean_test_score", "mean_gap"])
