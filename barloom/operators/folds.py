"""Rolling walk-forward folds and purged cross-validation folds over long factor panels.

Rows are ordered by (selection_time, symbol, factor) per timeframe through a two-level index.  Train
windows overlap several times, so rows are first folded into units (the common divisor of the window
sizes) and the units, not the rows, are copied to the windows that contain them.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.stats import quantiles, rank_correlations, spearman, with_row_index

# Default windows, in rows of the long panel, and purged fold sizes.
TRAIN_ROWS, TEST_ROWS, STEP_ROWS = 252, 63, 63
PURGED_FOLDS, PURGE_SIZE, EMBARGO_SIZE = 5, 5, 5

ROW_ORDER = ("symbol", "factor_name", "factor_version")
FACTOR = ("factor_name", "factor_version")
RETURN = "future_return_1"


def indexed(evaluation: DataFrame, by: str = "rows") -> DataFrame:
    """Panel rows with ``row_id`` per timeframe.

    ``by="rows"`` numbers rows, so a window may end inside one bar time; ``by="time"`` numbers bar
    times, so windows hold whole cross-sections.
    """
    if by == "rows":
        return with_row_index(evaluation, ["timeframe"], "selection_time", ROW_ORDER)
    times = evaluation.groupBy("timeframe", "selection_time").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("timeframe").orderBy("selection_time")
    numbered = times.select("timeframe", "selection_time", (F.row_number().over(order) - 1).cast("long").alias("row_id"))
    return evaluation.join(numbered, ["timeframe", "selection_time"])


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("timeframe").agg((F.max("row_id") + 1).alias("_size"))


def with_sizes(rows: DataFrame) -> DataFrame:
    # One row per timeframe, of which there are nine.
    return rows.join(F.broadcast(_sizes(rows)), "timeframe")


class Layout:
    """Window arithmetic shared by all walk-forward results; a short series gets one fallback fold."""

    def __init__(self, train: int = TRAIN_ROWS, test: int = TEST_ROWS, step: int = STEP_ROWS):
        self.train, self.test, self.step = train, test, step
        self.unit = gcd(gcd(train, test), step)

    def count(self) -> Column:
        return F.floor((F.col("_size") - self.train - self.test) / self.step) + 1

    def short(self) -> Column:
        return F.col("_size") < self.train + self.test

    def fallback_test_start(self) -> Column:
        return (
            F.when(F.col("_size") == 1, F.lit(0))
            .when(F.col("_size") <= self.train, F.col("_size") - 1)
            .otherwise(F.lit(self.train))
        )

    def _between(self, position: Column, offset: int, length: int) -> Column:
        """Folds k with k*step + offset <= position < k*step + offset + length."""
        first = F.greatest(F.lit(0), F.ceil((position - offset - length + 1) / self.step))
        last = F.least(F.floor((position - offset) / self.step), self.count() - 1)
        return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))

    def test_folds(self) -> Column:
        """Fold numbers (1-based) whose test window holds the row."""
        row = F.col("row_id")
        # A one-row series serves as its own train and test window.
        alone = F.when(row >= self.fallback_test_start(), F.array(F.lit(0).cast("long")))
        return F.transform(
            F.when(self.short(), alone).otherwise(self._between(row, self.train, self.test)), lambda k: (k + 1).cast("int")
        )

    def train_folds(self, unit_start: Column) -> Column:
        """Fold numbers whose train window holds the unit that starts at row ``unit_start``."""
        return F.transform(self._between(unit_start, 0, self.train), lambda k: (k + 1).cast("int"))

    def short_train(self) -> Column:
        row, start = F.col("row_id"), self.fallback_test_start()
        return self.short() & ((row < start) | (F.col("_size") == 1))


def train_parts(rows: DataFrame, layout: Layout, keys: tuple[str, ...], aggregates: dict[str, tuple[Column, str]]) -> DataFrame:
    """Aggregates of train windows per (timeframe, *keys, fold).

    ``aggregates`` maps a name to (unit aggregate, how units combine: sum, min or max).
    """
    sized = with_sizes(rows)
    unit = (F.floor(F.col("row_id") / layout.unit) * layout.unit).cast("long")
    units = sized.filter(~layout.short()).groupBy("timeframe", *keys, unit.alias("_unit"), "_size").agg(
        *[a.alias(n) for n, (a, _) in aggregates.items()]
    ).withColumn("fold", layout.train_folds(F.col("_unit")))
    alone = sized.filter(layout.short_train()).groupBy("timeframe", *keys).agg(
        *[a.alias(n) for n, (a, _) in aggregates.items()]
    ).withColumn("fold", F.array(F.lit(1)))
    columns = ["timeframe", *keys, *aggregates, F.explode("fold").alias("fold")]
    combine = {"sum": F.sum, "min": F.min, "max": F.max}
    return units.select(*columns).unionByName(alone.select(*columns)).groupBy("timeframe", *keys, "fold").agg(
        *[combine[how](n).alias(n) for n, (_, how) in aggregates.items()]
    )


def out_of_sample(rows: DataFrame, layout: Layout) -> DataFrame:
    """Rows of all test windows with their ``fold``."""
    return with_sizes(rows).withColumn("fold", F.explode(layout.test_folds())).drop("_size")


def fold_metrics(rows: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Per fold: window times and sizes, selected rows in train, and return metrics of the test window.

    The panel is folded once into units that make up train and test windows alike (rows themselves in a short series);
    deviations of units add up about the means of their window.
    """
    layout = layout or Layout()
    gained = F.when(F.col("selected"), F.col(RETURN))
    start = F.when(layout.short(), F.col("row_id")).otherwise((F.floor(F.col("row_id") / layout.unit) * layout.unit).cast("long"))
    units = with_sizes(rows).groupBy("timeframe", "_size", start.alias("row_id")).agg(
        F.min("selection_time").alias("start"), F.max("selection_time").alias("end"), F.count(F.lit(1)).alias("rows"),
        F.count_if("selected").alias("chosen"), F.count(gained).alias("n"), F.avg(gained).alias("mean"),
        (F.var_pop(gained) * F.count(gained)).alias("spread"), F.count_if(gained > 0).alias("wins"),
    )
    alone = F.when(layout.short_train(), F.array(F.lit(1)))
    train_folds = F.when(layout.short(), alone).otherwise(layout.train_folds(F.col("row_id")))
    train = units.withColumn("fold", F.explode(train_folds)).groupBy("timeframe", "fold").agg(
        F.min("start").alias("train_start"), F.max("end").alias("train_end"), F.sum("rows").alias("train_rows"), F.sum("chosen").alias("selected_factors"),
    )
    tests = units.withColumn("fold", F.explode(layout.test_folds()))
    n, total = F.sum("n"), F.sum(F.col("n") * F.coalesce("mean", F.lit(0.0)))
    test = tests.groupBy("timeframe", "fold").agg(
        F.min("start").alias("test_start"), F.max("end").alias("test_end"), F.sum("rows").alias("test_rows"), n.alias("_n"),
        F.try_divide(total, n).alias("mean_return"), F.sum("wins").alias("_wins"),
        F.collect_list(F.struct("n", "mean", "spread")).alias("_units"),  # as many as units fit a test window
    )
    about = F.aggregate(
        F.filter("_units", lambda u: u["n"] > 0), F.lit(0.0),
        lambda acc, u: acc + u["spread"] + u["n"] * (u["mean"] - F.col("mean_return")) * (u["mean"] - F.col("mean_return")),
    )
    deviation = F.sqrt(F.try_divide(about, F.col("_n") - 1))
    return train.join(test, ["timeframe", "fold"]).withColumn("_sd", F.when(F.col("_n") > 1, deviation)).select(
        "timeframe", "fold", "train_start", "train_end", "test_start", "test_end", "train_rows", "test_rows",
        "selected_factors", "mean_return", F.try_divide("mean_return", F.when(F.col("_sd") > 0, F.col("_sd"))).alias("sharpe"),
        F.try_divide(F.col("_wins").cast("double"), F.col("_n").cast("double")).alias("win_rate"),
        F.when(F.col("_n") > 0, "PASS").otherwise("FAIL").alias("status"),
    )


def walk_forward(metrics: DataFrame) -> DataFrame:
    """Every fold row carries the means over passing folds: train and test score, and their stability."""
    good = F.col("status") == "PASS"
    summary = metrics.groupBy("timeframe").agg(
        F.avg(F.when(good, F.col("mean_return"))).alias("train_score"),
        F.avg(F.when(good, F.col("sharpe"))).alias("test_score"),
        F.stddev_samp(F.when(good, F.col("sharpe"))).alias("_sd"),
    )
    joined = metrics.join(F.broadcast(summary), "timeframe")
    return joined.select(
        "timeframe", "fold", "train_start", "train_end", "test_start", "test_end", "train_rows", "test_rows",
        "selected_factors", "train_score", "test_score", F.try_divide("test_score", "_sd").alias("overfit_gap"), "status",
    )


def return_statistics(extra: bool = False) -> list[Column]:
    out = [
        F.count(RETURN).alias("oos_non_null_returns"), F.avg(RETURN).alias("oos_return_mean"),
        F.stddev_samp(RETURN).alias("oos_return_std"),
        F.avg(F.when(F.col(RETURN).isNotNull(), (F.col(RETURN) > 0).cast("double"))).alias("oos_positive_rate"),
        (F.product(F.col(RETURN) + 1.0) - 1.0).alias("oos_cumulative_return"),
    ]
    if extra:
        out += [F.min(RETURN).alias("oos_return_min"), F.max(RETURN).alias("oos_return_max")]
    return out


def oos_fold_metrics(rows: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Return statistics of the selected out-of-sample rows per fold."""
    layout = layout or Layout()
    oos = out_of_sample(rows, layout)
    sizes = oos.groupBy("timeframe", "fold").agg(F.count(F.lit(1)).alias("oos_rows"))
    stats = oos.filter("selected").groupBy("timeframe", "fold").agg(*return_statistics(True))
    train = train_parts(rows, layout, (), {"train_rows": (F.count(F.lit(1)), "sum")})
    out = sizes.join(train, ["timeframe", "fold"]).join(stats, ["timeframe", "fold"], "left")
    return out.withColumn("oos_non_null_returns", F.coalesce("oos_non_null_returns", F.lit(0))).withColumn(
        "status", F.when(F.col("oos_non_null_returns") > 0, "PASS").otherwise("FAIL")
    )


def observations(rows: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Out-of-sample rows tagged with fold, partition and fold status."""
    oos = out_of_sample(rows, layout or Layout())
    # A fold passes when any of its selected rows has a return.
    status = F.max(F.when(F.col("selected") & F.col(RETURN).isNotNull(), 1)).over(Window.partitionBy("timeframe", "fold"))
    return oos.withColumn("partition", F.lit("OOS")).withColumn("status", F.when(status == 1, "PASS").otherwise("FAIL"))


def train_observations(rows: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Rows that stand in at least one train window, once each, tagged TRAIN."""
    layout = layout or Layout()
    inside = F.when(layout.short(), layout.short_train()).otherwise(layout.train_folds(F.col("row_id")).isNotNull())
    return with_sizes(rows).filter(inside).drop("_size").withColumn("partition", F.lit("TRAIN"))


def factor_train_counts(rows: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Rows of each factor in each train window."""
    return train_parts(rows, layout or Layout(), FACTOR, {"train_rows": (F.count(F.lit(1)), "sum")})


def fold_factor_metrics(oos: DataFrame) -> DataFrame:
    """Per fold and factor: returns of selected rows, raw and oriented rank IC.

    A selected factor has one direction, 1 or -1, so its oriented IC is the raw one times it.
    """
    keys = ["timeframe", "fold", *FACTOR]
    chosen = oos.filter("selected")
    stats = chosen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("oos_rows"), *return_statistics(),
        F.first("selection_ic").alias("selection_ic"), F.first("selection_rank_ic").alias("selection_rank_ic"), F.first("selected_direction").alias("selected_direction"),
    )
    stats = stats.join(spearman(chosen, keys, "factor_value", RETURN, "raw_oos_ic").drop("pairs"), keys, "left")
    return stats.withColumn("oriented_oos_ic", F.col("raw_oos_ic") * F.col("selected_direction")).withColumn("oos_ic", F.col("oriented_oos_ic"))


def panel_summary(oos_folds: DataFrame, oos: DataFrame) -> DataFrame:
    """One row per timeframe: folds, rows, pooled return statistics, distinct selected factors."""
    folds = oos_folds.groupBy("timeframe").agg(
        F.count(F.lit(1)).alias("folds"), F.sum("train_rows").alias("train_rows"), F.sum("oos_rows").alias("oos_rows")
    )
    chosen = oos.filter("selected")
    pooled = chosen.groupBy("timeframe").agg(*return_statistics())
    names = chosen.groupBy("timeframe", *FACTOR).agg(F.count(F.lit(1)).alias("_n")).groupBy("timeframe").agg(
        F.count(F.lit(1)).alias("unique_selected_factors")
    )
    out = folds.join(pooled, "timeframe", "left").join(names, "timeframe", "left")
    return out.withColumn("status", F.when(F.coalesce("oos_non_null_returns", F.lit(0)) > 0, "PASS").otherwise("FAIL"))


# -- purged cross-validation ------------------------------------------------------------------------


def purged_membership(
    walk: DataFrame, n_folds: int = PURGED_FOLDS, purge: int = PURGE_SIZE, embargo: int = EMBARGO_SIZE
) -> DataFrame:
    """Role of every walk-forward row in every purged fold: TRAIN, TEST, PURGE or EMBARGO.

    Test blocks are contiguous; the first ``rows mod n_folds`` blocks are one row longer.
    """
    position = (F.col("fold") - 1).cast("long")
    sized = walk.withColumn("row_id", position)
    sized = with_sizes(sized)
    k = F.col("purged_fold") - 1
    base, rest = F.floor(F.col("_size") / n_folds), F.col("_size") % n_folds
    begin = k * base + F.least(k, rest)
    end = begin + base + F.when(k < rest, 1).otherwise(0)
    row = F.col("row_id")
    role = (
        F.when((row >= begin) & (row < end), "TEST")
        .when((row >= begin - purge) & (row < begin), "PURGE")
        .when((row >= end) & (row < end + purge), "PURGE")
        .when((row >= end + purge) & (row < end + purge + embargo), "EMBARGO")
        .otherwise("TRAIN")
    )
    # The number of purged folds is a small constant.
    spread = sized.withColumn("purged_fold", F.explode(F.array(*[F.lit(i + 1) for i in range(n_folds)])))
    return spread.withColumn("role", role).drop("_size")


def purged_folds(membership: DataFrame) -> DataFrame:
    """One row per purged fold: window times, sizes, mean scores and their gap."""
    train, test = F.col("role") == "TRAIN", F.col("role") == "TEST"
    out = membership.groupBy("timeframe", "purged_fold").agg(
        F.min(F.when(train, F.col("test_start"))).alias("train_start_time"),
        F.max(F.when(train, F.col("test_start"))).alias("train_end_time"),
        F.min(F.when(test, F.col("test_start"))).alias("test_start_time"),
        F.max(F.when(test, F.col("test_start"))).alias("test_end_time"),
        F.count_if(train).alias("train_rows"), F.count_if(test).alias("test_rows"),
        F.avg(F.when(train, F.col("train_score"))).alias("train_score"),
        F.avg(F.when(test, F.col("test_score"))).alias("test_score"),
    )
    return out.withColumn("overfit_gap", F.col("train_score") - F.col("test_score")).withColumn(
        "status", F.when((F.col("train_rows") > 0) & (F.col("test_rows") > 0), "PASS").otherwise("FAIL")
    )


def purged_summary(folds: DataFrame) -> DataFrame:
    """Per timeframe: purged folds, mean scores and gap, and folds that passed."""
    return folds.groupBy("timeframe").agg(
        F.count(F.lit(1)).alias("folds"), F.avg("train_score").alias("mean_train_score"), F.avg("test_score").alias("mean_test_score"),
        F.avg("overfit_gap").alias("mean_gap"), F.count_if(F.col("status") == "PASS").alias("passed"),
    )


def purged_ranges(membership: DataFrame, role: str) -> DataFrame:
    """Time ranges covered by the contiguous runs of a role's rows in each purged fold."""
    order = Window.partitionBy("timeframe", "purged_fold").orderBy("row_id")
    runs = membership.filter(F.col("role") == role).withColumn("_run", F.col("row_id") - F.row_number().over(order))
    return runs.groupBy("timeframe", "purged_fold", "_run").agg(
        F.min("test_start").alias("range_start"), F.max("test_end").alias("range_end")
    ).drop("_run")


def map_observations(evaluation: DataFrame, ranges: DataFrame) -> DataFrame:
    """Evaluation rows of every range that covers their time, with the purged fold.

    A timeframe has at most two ranges per purged fold, so its ranges travel as one short array.
    """
    packed = ranges.groupBy("timeframe").agg(
        F.collect_list(F.struct("purged_fold", "range_start", "range_end")).alias("_ranges")
    )
    covering = F.filter("_ranges", lambda r: (F.col("selection_time") >= r["range_start"]) & (F.col("selection_time") <= r["range_end"]))
    return evaluation.join(F.broadcast(packed), "timeframe").withColumn("_r", F.explode(covering)).select(
        *evaluation.columns, F.col("_r.purged_fold").alias("fold")
    )


def purged_fold_metrics(oos: DataFrame) -> DataFrame:
    """Per purged fold: pooled return statistics and rank ICs of the selected rows, whose direction is 1 or -1."""
    keys = ["timeframe", "fold"]
    chosen = oos.filter("selected").withColumn("_oriented", F.col("factor_value") * F.col("selected_direction"))
    median = quantiles(chosen, keys, RETURN, [0.5]).select(*keys, F.col("quantiles")[0].alias("oos_return_median"))
    ics = rank_correlations(chosen, keys, {"raw_oos_ic": "factor_value", "oriented_oos_ic": "_oriented"}, RETURN).drop("pairs")
    stats = chosen.groupBy(*keys).agg(*return_statistics()).join(median, keys, "left").join(ics, keys, "left")
    return stats.withColumn("oos_ic", F.col("oriented_oos_ic"))


def leakage_checks(membership: DataFrame, n_folds: int = PURGED_FOLDS, purge: int = PURGE_SIZE, embargo: int = EMBARGO_SIZE) -> DataFrame:
    """Per timeframe: one role per row and fold, no train row next to a test block, and the roles rebuild."""
    per_row = membership.groupBy("timeframe", "purged_fold", "row_id").agg(
        F.count_distinct("role").alias("_roles"), F.max("role").alias("role"), F.max("test_start").alias("test_start")
    )
    block = Window.partitionBy("timeframe", "purged_fold")
    first = F.min(F.when(F.col("role") == "TEST", F.col("row_id"))).over(block)
    last = F.max(F.when(F.col("role") == "TEST", F.col("row_id"))).over(block)
    near = (F.col("row_id") >= first - purge) & (F.col("row_id") <= last + purge + embargo)
    previous = F.lag("test_start").over(block.orderBy("row_id"))
    flagged = per_row.select(
        "timeframe", (F.col("_roles") > 1).alias("_mixed"), (near & (F.col("role") == "TRAIN")).alias("_leak"),
        (F.col("test_start") < previous).alias("_disorder"),
    )
    # A row is a test row in exactly one purged fold.
    tests = membership.filter("role = 'TEST'").groupBy("timeframe", "row_id").agg(F.count(F.lit(1)).alias("_n"))
    once = tests.groupBy("timeframe").agg(F.count_if(F.col("_n") != 1).alias("rows_tested_twice"))
    return flagged.groupBy("timeframe").agg(
        F.count_if("_mixed").alias("rows_with_two_roles"), F.count_if("_leak").alias("train_rows_in_exclusion"),
        F.count_if("_disorder").alias("rows_out_of_order"),
    ).join(once, "timeframe", "left")


def rebuild_differences(membership: DataFrame, walk: DataFrame, **sizes: int) -> DataFrame:
    """Membership rows that a rebuild from the walk-forward table does not give, and the reverse."""
    columns = ["timeframe", "purged_fold", "row_id", "role"]
    again = purged_membership(walk, **sizes).select(*columns)
    stored = membership.select(*columns)
    return stored.exceptAll(again).withColumn("side", F.lit("stored")).unionByName(
        again.exceptAll(stored).withColumn("side", F.lit("rebuilt"))
    )
