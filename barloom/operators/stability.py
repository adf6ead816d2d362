"""Stability and audit queries over folds, panels and factor stores."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.clock import DAY_MS
from barloom.functions.graph import Keep, components
from barloom.functions.series import across_parts, total_across_parts
from barloom.functions.stats import quantiles, spearman

from .panel import BAR_KEY

FACTOR = ["factor_name", "factor_version"]
REDUNDANCY_LIMIT = 0.90
HIGH_NULL_RATE = 0.90
# Levels that can be rebuilt from bars, and eligibility statuses that decide about a replacement.
LEVELS = ("on_balance_volume", "price_volume_trend", "open_interest_level")
INELIGIBLE = ("INELIGIBLE_ZERO_OBSERVATIONS", "INELIGIBLE_INSUFFICIENT_WARMUP", "INELIGIBLE_LOW_COVERAGE", "INELIGIBLE_COMPANION_HISTORY")
RETURN_QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def factor_stability(fold_ics: DataFrame, keys: Sequence[str] = ("timeframe", *FACTOR)) -> DataFrame:
    """Fold sign counts, mean oriented IC and stability class per factor.

    ``fold_ics`` has one row per factor and fold with ``oriented_oos_ic`` and ``selection_ic``.
    """
    ic = F.col("oriented_oos_ic")
    out = fold_ics.groupBy(*keys).agg(
        F.count(ic).alias("folds"), F.count_if(ic > 0).alias("positive_folds"), F.count_if(ic < 0).alias("negative_folds"),
        F.avg(ic).alias("mean_oriented_ic"), F.avg("raw_oos_ic").alias("mean_raw_ic"),
        F.count_if(F.col("raw_oos_ic") > 0).alias("positive_raw_folds"), F.count_if(F.col("raw_oos_ic") < 0).alias("negative_raw_folds"),
        F.max("selection_ic").alias("selection_ic"), F.max("selection_rank_ic").alias("selection_rank_ic"),
    )
    mean, folds = F.col("mean_oriented_ic"), F.col("folds")
    all_up, all_down = F.col("positive_folds") == folds, F.col("negative_folds") == folds
    mixed = (F.col("positive_folds") > 0) & (F.col("negative_folds") > 0)
    label = (
        F.when((folds == 0) | mean.isNull(), "INSUFFICIENT_DATA")
        .when(all_down & (mean < 0) & (F.abs("selection_ic") >= 0), "ORIENTATION_INSUFFICIENT")
        .when(all_up & (mean > 0), "STABLE_POSITIVE")
        .when(all_down & (mean < 0), "STABLE_NEGATIVE")
        .when(mixed, "MIXED").when(mean > 0, "STABLE_POSITIVE").when(mean < 0, "STABLE_NEGATIVE").otherwise("MIXED")
    )
    return out.withColumn("stability_class", label)


def orientation_class(mean: Column, positive: Column, negative: Column) -> Column:
    total = positive + negative
    return (
        F.when((total == 0) | mean.isNull(), "NEUTRAL")
        .when((positive == total) & (mean > 0), "STABLE_POSITIVE")
        .when((negative == total) & (mean < 0), "ORIENTATION_REVERSAL_CANDIDATE")
        .when((positive > 0) & (negative > 0), "UNSTABLE")
        .when(mean > 0, "STABLE_POSITIVE").when(mean < 0, "STABLE_NEGATIVE").otherwise("NEUTRAL")
    )


def in_out_class(inside: Column, outside: Column) -> Column:
    def side(x: Column) -> Column:
        return F.when(x > 0, "POSITIVE").when(x < 0, "NEGATIVE")

    both = F.concat(F.lit("IS_"), side(inside), F.lit("_OOS_"), side(outside))
    return F.coalesce(both, F.lit("IS_NEUTRAL_OOS"))


def classified(stability: DataFrame) -> DataFrame:
    """Orientation and in-sample/out-of-sample class, both on the raw IC of the folds.

    In sample counts the selection's rank IC, or its IC where there is none.
    """
    inside = F.coalesce("selection_rank_ic", "selection_ic")
    return stability.withColumn(
        "orientation_class", orientation_class(F.col("mean_raw_ic"), F.col("positive_raw_folds"), F.col("negative_raw_folds"))
    ).withColumn("in_out_class", in_out_class(inside, F.col("mean_raw_ic")))


def cross_timeframe(stability: DataFrame) -> DataFrame:
    """Share of timeframes that agree on the sign of a factor's mean IC."""
    ic = F.col("mean_oriented_ic")
    out = stability.filter(ic.isNotNull()).groupBy(*FACTOR).agg(
        F.count(F.lit(1)).alias("timeframes"), F.count_if(ic > 0).alias("_up"), F.count_if(ic < 0).alias("_down")
    )
    signed = F.col("_up") + F.col("_down")
    share = F.try_divide(F.greatest("_up", "_down").cast("double"), signed.cast("double"))
    label = (
        F.when(F.col("timeframes") == 1, "SINGLE_TIMEFRAME")
        .when(signed == 0, "CROSS_TIMEFRAME_UNSTABLE")
        .when((F.col("_up") > 0) & (F.col("_down") > 0), "CROSS_TIMEFRAME_UNSTABLE")
        .when(F.col("_down") == signed, "CROSS_TIMEFRAME_INVERTED")
        .otherwise("CROSS_TIMEFRAME_STABLE")
    )
    consistency = F.when(F.col("timeframes") == 1, 1.0).otherwise(F.coalesce(share, F.lit(0.0)))
    return out.select(*FACTOR, "timeframes", consistency.alias("sign_consistency"), label.alias("consistency_class"))


def families(stability: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mean IC and share of positive factors per factor category and timeframe."""
    joined = stability.join(F.broadcast(catalog), "factor_name")  # one row per catalog factor
    return joined.groupBy("timeframe", "factor_category").agg(
        F.count(F.lit(1)).alias("factors"), F.avg("mean_oriented_ic").alias("mean_ic"),
        F.avg((F.col("mean_oriented_ic") > 0).cast("double")).alias("positive_share"),
    )


def degradation(stability: DataFrame) -> DataFrame:
    """Training against out-of-sample IC per factor."""
    trained, tested = F.abs("selection_ic"), F.col("mean_oriented_ic")
    return stability.select(
        "timeframe", *FACTOR, trained.alias("training_ic"), tested.alias("oos_ic"), (tested - trained).alias("change"),
        (F.signum(trained) == F.signum(tested)).alias("sign_kept"),
        F.try_divide(F.col("positive_folds").cast("double"), F.col("folds").cast("double")).alias("positive_fold_share"),
        ((trained > 0) & (tested < 0)).alias("lost_sign"),
    )


def timeframe_status(stability: DataFrame, walk_ic: DataFrame, purged_ic: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Status and verdict per timeframe from class counts and pooled out-of-sample ICs.

    ``walk_ic`` and ``purged_ic`` have timeframe, oos_ic, folds and negative_folds; ``groups`` are those of ``train_redundancy``.  With
    groups, ``redundant_groups`` is counted, and a timeframe that has some while less than half of its factors have a
    positive IC gets the verdict FACTOR_REDUNDANCY.
    """
    count = lambda label: F.count_if(F.col("stability_class") == label)
    facts = stability.groupBy("timeframe").agg(
        F.count(F.lit(1)).alias("factors"), count("STABLE_POSITIVE").alias("up"), count("MIXED").alias("mixed"),
        count("STABLE_NEGATIVE").alias("down"), count("ORIENTATION_INSUFFICIENT").alias("turned"), count("INSUFFICIENT_DATA").alias("empty"),
        F.avg((F.col("mean_oriented_ic") > 0).cast("double")).alias("positive_share"),
        F.count_if((F.abs("selection_ic") > 0) & (F.col("mean_oriented_ic") < 0)).alias("lost"),
    )
    joined = facts.join(walk_ic.select("timeframe", F.col("oos_ic").alias("walk_ic"), "folds", "negative_folds"), "timeframe", "left").join(
        purged_ic.select("timeframe", F.col("oos_ic").alias("purged_ic")), "timeframe", "left"
    )
    redundant = F.lit(False)
    if groups is not None:
        counted = groups.groupBy("timeframe").agg(F.count_distinct("group_name").alias("redundant_groups"))
        joined = joined.join(counted, "timeframe", "left").withColumn("redundant_groups", F.coalesce("redundant_groups", F.lit(0)))
        redundant = (F.col("redundant_groups") > 0) & (F.col("positive_share") < 0.5)
    c = F.col
    not_up = lambda x: F.coalesce(c(x) <= 0, F.lit(True))
    dropped = c("lost") > c("factors") / 2
    oriented = F.when(c("purged_ic").isNotNull(), c("purged_ic") > 0).otherwise(F.coalesce(c("walk_ic") > 0, F.lit(False)))
    mostly_up = (c("positive_share") >= 0.5) & (c("down") == 0) & (
        (c("up") > c("down")) | ((c("mixed") > 0) & (c("positive_share") >= 0.9) & (c("turned") == 0))
    )
    status = (
        F.when(c("factors") == c("empty"), "INSUFFICIENT_DATA")
        .when((c("turned") > 0) & (c("turned") >= c("up")) & (c("turned") >= c("mixed")) & not_up("purged_ic") & not_up("walk_ic"), "ORIENTATION_INSUFFICIENT")
        .when(dropped, "SELECTION_DEGRADATION")
        .when(mostly_up & oriented & F.coalesce(c("walk_ic") > 0, F.lit(True)), "STABLE_SIGNAL")
        .otherwise("MIXED_STABILITY")
    )
    staged = joined.withColumn("status", status)
    weak_both = F.coalesce((c("walk_ic") <= 0) & (c("purged_ic") <= 0), F.lit(False))
    verdict = (
        F.when((c("status") == "INSUFFICIENT_DATA") | (F.coalesce("folds", F.lit(0)) <= 0), "INSUFFICIENT_DATA")
        .when(weak_both & (c("negative_folds") > c("folds") / 2), "TIMEFRAME_SIGNAL_WEAKNESS")
        .when(dropped, "SELECTION_OVERFITTING")
        .when(c("status") == "ORIENTATION_INSUFFICIENT", "FACTOR_ORIENTATION_INSUFFICIENT")
        .when(F.coalesce(redundant, F.lit(False)), "FACTOR_REDUNDANCY")
        .when(c("status") == "STABLE_SIGNAL", "STABLE_SIGNAL")
        .when(weak_both, "TIMEFRAME_SIGNAL_WEAKNESS")
        .when(c("walk_ic") > 0, F.when(c("positive_share") >= 0.5, "STABLE_SIGNAL").otherwise("SELECTION_OVERFITTING"))
        .when(c("walk_ic").isNull() & c("purged_ic").isNull(), "INSUFFICIENT_DATA")
        .otherwise("TIMEFRAME_SIGNAL_WEAKNESS")
    )
    return staged.withColumn("verdict", verdict)


def train_redundancy(train: DataFrame, keep: Keep, limit: float = REDUNDANCY_LIMIT) -> DataFrame:
    """Groups of redundant factors per timeframe: timeframe, factor_name, factor_version, group_name.

    ``train`` holds observations with ``partition`` and ``selected``; only selected TRAIN rows count.  Two factors are tied if
    the rank correlation over the bars that have both is ``limit`` or more; groups are the connected components.  A bar
    holds one row per selected factor, so its pairs are bounded by the selection.
    """
    name = F.concat("factor_name", F.lit("::"), "factor_version")
    rows = train.filter((F.col("partition") == "TRAIN") & F.col("selected") & F.col("factor_value").isNotNull()).select(
        *BAR_KEY, F.struct(name.alias("name"), F.col("factor_value").alias("value")).alias("cell"))
    bars = rows.groupBy(*BAR_KEY).agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    later = F.filter("cells", lambda c: c["name"] > F.col("a.name"))
    pairs = bars.select("timeframe", "cells", F.explode("cells").alias("a")).select("timeframe", "a", F.explode(later).alias("b")).select(
        "timeframe", F.col("a.name").alias("factor_a"), F.col("b.name").alias("factor_b"), F.col("a.value").alias("x"), F.col("b.value").alias("y"))
    strong = spearman(pairs, ["timeframe", "factor_a", "factor_b"], "x", "y", "corr").filter(F.col("corr") >= limit)
    parts = F.split("node", "::")
    return components(strong, ["timeframe"], "factor_a", "factor_b", keep).select(
        "timeframe", parts[0].alias("factor_name"), parts[1].alias("factor_version"), F.split("component", "::")[0].alias("group_name"))


def redundancy_groups(pairs: DataFrame, limit: float = REDUNDANCY_LIMIT) -> DataFrame:
    """Connected components of strongly correlated factors per timeframe.

    ``pairs`` has timeframe, factor_a, factor_b, corr.  A timeframe holds at most the square of the
    selected factor count in pairs, so the components of one timeframe are found in one task.
    """

    def components(frame: pd.DataFrame) -> pd.DataFrame:
        parent: dict[str, str] = {}

        def root(name: str) -> str:
            while parent.setdefault(name, name) != name:
                name = parent[name]
            return name

        for a, b in zip(frame["factor_a"], frame["factor_b"]):
            first, second = sorted((root(a), root(b)))
            parent[second] = first
        rows = [(frame["timeframe"].iloc[0], root(n), n) for n in parent]
        return pd.DataFrame(rows, columns=["timeframe", "group_name", "factor_name"])

    strong = pairs.filter(F.abs("corr") >= limit).select("timeframe", "factor_a", "factor_b")
    return strong.groupBy("timeframe").applyInPandas(components, "timeframe string, group_name string, factor_name string")


def integrity_audit(evaluation: DataFrame, stored: DataFrame) -> DataFrame:
    """Duplicate keys, time mismatches, missing returns, and rows that the factor store lacks or contradicts."""
    keys = [*BAR_KEY, *FACTOR]
    per_key = evaluation.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("selection_time") != F.col("open_time")).alias("_shift"),
        F.count_if(F.col("future_return_1").isNull()).alias("_blank"), F.first("factor_value").alias("_used"),
    )
    joined = per_key.join(stored.select(*keys, F.col("factor_value").alias("_stored"), F.lit(True).alias("_found")), keys, "left")
    return joined.groupBy("timeframe").agg(
        F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows"), F.sum("_shift").alias("time_mismatches"),
        F.sum("_blank").alias("missing_returns"), F.count_if(F.col("_found").isNull()).alias("not_in_store"),
        F.count_if(F.col("_found") & ~F.col("_used").eqNullSafe(F.col("_stored"))).alias("value_mismatches"),
    )


def orientation_summary(fold_ics: DataFrame) -> DataFrame:
    """Factor-folds by direction, with mean raw and oriented IC per timeframe."""
    return fold_ics.groupBy("timeframe", "selected_direction").agg(
        F.count(F.lit(1)).alias("factor_folds"), F.avg("raw_oos_ic").alias("mean_raw_ic"), F.avg("oriented_oos_ic").alias("mean_oriented_ic"),
        F.count_if(F.col("oriented_oos_ic") > F.col("raw_oos_ic")).alias("improved"),
    )


def orientation_detail(fold_ics: DataFrame) -> DataFrame:
    """Factor-folds with the selection IC in the chosen direction beside the raw one; a missing direction gives null."""
    oriented = F.col("selection_ic") * F.col("selected_direction")
    return fold_ics.select("timeframe", "year", *FACTOR, "fold", "selected_direction", "selection_ic", oriented.alias("oriented_selection_ic"),
                           F.nanvl("raw_oos_ic", F.lit(None).cast("double")).alias("raw_oos_ic"),
                           F.nanvl("oriented_oos_ic", F.lit(None).cast("double")).alias("oriented_oos_ic"))


def orientation_by_year(detail: DataFrame) -> DataFrame:
    """Selected factors by direction and mean ICs per timeframe and year, from ``orientation_detail``.

    A factor counts once, by its first fold of the year; out-of-sample ICs are means over all its folds.
    """
    keys = ["timeframe", "year"]
    first = F.min_by(F.struct("selected_direction", "selection_ic", "oriented_selection_ic"), "fold").alias("_one")
    per_factor = detail.groupBy(*keys, *FACTOR).agg(
        first, *[f(c).alias(f"_{c}_{n}") for c in ("raw_oos_ic", "oriented_oos_ic") for n, f in (("sum", F.sum), ("n", F.count))])
    direction = F.col("_one.selected_direction")
    return per_factor.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("selected_factor_count"), F.count_if(direction == 1).alias("positive_direction_count"),
        F.count_if(direction == -1).alias("negative_direction_count"), F.avg("_one.selection_ic").alias("mean_raw_selection_ic"),
        F.avg("_one.oriented_selection_ic").alias("mean_oriented_selection_ic"),
        *[F.try_divide(F.sum(f"_{c}_sum"), F.sum(f"_{c}_n").cast("double")).alias(f"mean_{c}") for c in ("raw_oos_ic", "oriented_oos_ic")],
    )


def walk_forward_audit(folds: DataFrame) -> DataFrame:
    """Fold counts and isolation checks per timeframe and in total, from one rollup."""
    return folds.rollup("timeframe").agg(
        F.count(F.lit(1)).alias("folds"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") != "PASS").alias("failed"),
        F.sum("test_rows").alias("oos_rows"), F.count_if(F.col("train_end") > F.col("test_start")).alias("overlapping"),
        F.min("test_start").alias("first_oos"), F.max("test_end").alias("last_oos"),
    )


def observation_audit(observations: DataFrame) -> DataFrame:
    """Rows, uniqueness, returns and isolation of walk-forward observations per symbol, per timeframe and in total.

    ``observations`` have symbol, timeframe, open_time, factor, fold, partition (OOS or TRAIN), selected, status and
    future_return_1.  ``level`` is symbol, timeframe or total.  Faults are found per symbol and added up: ``duplicates`` (rows
    beyond the first of a key), ``overlapping_windows`` (test windows that begin before an earlier one has ended, by one sweep
    over sorted starts with the running maximum of ends) and ``train_rows_in_test`` (train rows within their fold's test
    window).  A level without a fault passes.  An empty table gives no level.
    """
    series = ["symbol", "timeframe"]
    sets = [series, ["timeframe"], []]
    level = F.when(F.grouping_id() == 0, "symbol").when(F.grouping_id() == 2, "timeframe").otherwise("total").alias("level")
    y, oos = F.col("future_return_1"), F.col("partition") == "OOS"
    stats = observations.groupingSets(sets, *series).agg(
        level, F.count(F.lit(1)).alias("rows"), F.count_if("selected").alias("selected_rows"), F.count_if(F.col("status") == "PASS").alias("pass_rows"),
        F.count_if(F.col("status") != "PASS").alias("fail_rows"), F.count_if(oos).alias("oos_rows"), F.min("open_time").alias("first_open_time"),
        F.max("open_time").alias("last_open_time"), F.count(y).alias("return_non_null"), F.count_if(y.isNull()).alias("return_null"), F.avg(y).alias("return_mean"),
        F.stddev_samp(y).alias("return_std"), F.min(y).alias("return_min"), F.max(y).alias("return_max"),
        F.avg(F.when(oos, y)).alias("oos_return_mean"), F.stddev_samp(F.when(oos, y)).alias("oos_return_std"),
    )
    # Distinct counts run over one row per series, factor and fold.
    units = observations.select(*series, *FACTOR, "fold").distinct()
    unique = units.groupingSets(sets, *series).agg(
        level, F.count_distinct("factor_name").alias("unique_factors"), F.count_distinct(*FACTOR).alias("unique_factor_versions"),
        F.count_distinct("timeframe", "fold").alias("unique_folds"),
    )
    twice = observations.groupBy(*BAR_KEY, *FACTOR, "fold", "partition").agg((F.count(F.lit(1)) - 1).alias("duplicates")).filter("duplicates > 0")
    windows = observations.filter(oos).groupBy(*series, "fold").agg(F.min("open_time").alias("_start"), F.max("open_time").alias("_end"))
    sweep = Window.partitionBy(*series).orderBy("_start", "fold").rowsBetween(Window.unboundedPreceding, -1)
    overlaps = windows.withColumn("_reached", F.max("_end").over(sweep)).filter(F.col("_start") < F.col("_reached")).select(*series, F.lit(1).alias("overlapping_windows"))
    inside = (observations.filter(F.col("partition") == "TRAIN").join(windows, [*series, "fold"])
              .filter(F.col("open_time").between(F.col("_start"), F.col("_end"))).select(*series, F.lit(1).alias("train_rows_in_test")))
    names = ["duplicates", "overlapping_windows", "train_rows_in_test"]
    faults = twice.select(*series, "duplicates").unionByName(overlaps, allowMissingColumns=True).unionByName(inside, allowMissingColumns=True)
    summed = faults.groupingSets(sets, *series).agg(level, *[F.sum(n).alias(n) for n in names])
    # A level is a group whatever is null in it, so its parts are grouped and not joined.
    parts = stats.unionByName(unique, allowMissingColumns=True).unionByName(summed, allowMissingColumns=True)
    values = [c for c in parts.columns if c not in ("level", *series)]
    counts = ["unique_factors", "unique_factor_versions", "unique_folds", *names]
    out = parts.groupBy("level", *series).agg(*[(F.coalesce(F.max(c), F.lit(0)) if c in counts else F.max(c)).alias(c) for c in values])
    errors = F.array_compact(F.array(*[F.when(F.col(n) > 0, F.lit(n)) for n in names]))
    return out.withColumn("error", F.array_join(errors, "; ")).withColumn("status", F.when(F.col("error") == "", "PASS").otherwise("FAIL"))


def coverage(oos: DataFrame, keys: Sequence[str] = ("timeframe", *FACTOR)) -> DataFrame:
    """Null rate and value times per factor in the out-of-sample rows."""
    value = F.col("factor_value")
    return oos.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), (F.count_if(value.isNull()) / F.count(F.lit(1))).alias("null_rate"),
        F.min(F.when(value.isNotNull(), F.col("open_time"))).alias("first_value"), F.max(F.when(value.isNotNull(), F.col("open_time"))).alias("last_value"),
        F.max("open_time").alias("last_row"), F.count_distinct("open_time").alias("bars"),
    )


def null_cause(table: DataFrame) -> DataFrame:
    """Why a factor is null: needs null_rate, store_null_rate, input_null_rate, effective_warmup, bars,
    store_first_value and last_row; inputs_present (default true) and required_lookback (default 1) may be there."""
    whole = 1.0 - 1e-12
    high = F.col("null_rate") >= 0.99
    present = F.coalesce("inputs_present", F.lit(True)) if "inputs_present" in table.columns else F.lit(True)
    lookback = F.coalesce("required_lookback", F.lit(1)) if "required_lookback" in table.columns else F.lit(1)
    cause = (
        F.when(~present | ((F.col("input_null_rate") >= whole) & high), "INPUT_DATA_MISSING")
        .when((F.col("store_null_rate") >= whole) & (F.col("bars") > 0) & (F.col("effective_warmup") > F.col("bars")), "ROLLING_WINDOW_TOO_LARGE")
        .when((F.col("store_first_value") > F.col("last_row")) & high, "EVALUATION_BOUNDARY")
        .when((F.col("null_rate") >= HIGH_NULL_RATE) & (F.col("effective_warmup") > 0), "INSUFFICIENT_HISTORY")
        .when((F.col("null_rate") >= HIGH_NULL_RATE) & (lookback <= 0), "IMPLEMENTATION_BUG")
        .otherwise("UNKNOWN")
    )
    return table.withColumn("null_cause", cause)


def target_distribution(oos: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments, quantiles and sign shares of the target."""
    y = F.col("future_return_1")
    stats = oos.groupBy(*keys).agg(
        F.count(y).alias("count"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
        (F.count_if(y > 0) / F.count(y)).alias("positive_share"), (F.count_if(y < 0) / F.count(y)).alias("negative_share"),
    )
    cuts = quantiles(oos, keys, "future_return_1", RETURN_QUANTILES)
    named = cuts.select(*keys, *[F.col("quantiles")[i].alias(f"q{int(q * 100):02d}") for i, q in enumerate(RETURN_QUANTILES)])
    return stats.join(named, list(keys))


def bootstrap_mean_ic(fold_ics: DataFrame, keys: Sequence[str], replicates: int = 1000, seed: int = 7) -> DataFrame:
    """95 % interval of the mean IC: every replicate draws folds with replacement; the order statistics at both ends.

    Replicate and slot pick a fold by hash, and a draw is added in slot order, so nothing depends on partitioning.  A
    factor's fold ICs are one array, bounded by its folds.
    """
    keys = list(keys)
    ics = fold_ics.filter(F.col("oos_ic").isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("fold", "oos_ic"))).alias("_f"))

    def mean(replicate):
        def pick(i):
            word = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), replicate.cast("string"), F.lit(":"), i.cast("string")).cast("binary")), 1, 7)
            return F.get("_f", F.pmod(F.conv(word, 16, 10).cast("long"), F.size("_f")).cast("int"))["oos_ic"]

        slots = F.sequence(F.lit(0), F.size("_f") - 1)
        return F.aggregate(slots, F.lit(0.0), lambda total, i: total + pick(i)) / F.size("_f")

    means = ics.withColumn("_means", F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(replicates)), mean)))
    low, high = int(0.025 * (replicates - 1)), int(0.975 * (replicates - 1))
    return means.select(
        *keys, F.lit(replicates).cast("long").alias("replicates"), F.get("_means", F.lit(low)).alias("low"), F.get("_means", F.lit(high)).alias("high")
    )


def quintile_profile(oos: DataFrame, keys: Sequence[str] = ("timeframe", *FACTOR)) -> DataFrame:
    """Mean return per oriented-value quintile within bar times, and the shape of the profile."""
    keys = list(keys)
    section = Window.partitionBy(*keys, "open_time")
    oriented = oos.filter(F.col("factor_value").isNotNull() & F.col("future_return_1").isNotNull()).withColumn(
        "_v", F.col("factor_value") * F.col("selected_direction"))
    ranked = oriented.select(
        *keys, "open_time", "future_return_1", F.count(F.lit(1)).over(section).alias("_n"),
        (F.rank().over(section.orderBy("_v")) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, "open_time", "_v")) - 1) / 2).alias("_r"),
    ).filter("_n >= 5")
    bucket = F.least(F.floor((F.col("_r") - 1) * 5 / F.col("_n")), F.lit(4))
    per_time = ranked.withColumn("_q", bucket).groupBy(*keys, "open_time").agg(
        *[F.avg(F.when(F.col("_q") == q, F.col("future_return_1"))).alias(f"q{q + 1}") for q in range(5)]
    ).dropna()
    out = per_time.groupBy(*keys).agg(*[F.avg(f"q{q}").alias(f"q{q}") for q in range(1, 6)], F.count(F.lit(1)).alias("times"))
    q = [F.col(f"q{i}") for i in range(1, 6)]
    rising = (q[0] <= q[1]) & (q[1] <= q[2]) & (q[2] <= q[3]) & (q[3] <= q[4])
    falling = (q[0] >= q[1]) & (q[1] >= q[2]) & (q[2] >= q[3]) & (q[3] >= q[4])
    shape = (
        F.when(rising, "INCREASING").when(falling, "DECREASING")
        .when((q[0] > q[2]) & (q[4] > q[2]), "U_SHAPE").when((q[0] < q[2]) & (q[4] < q[2]), "INVERTED_U").otherwise("MIXED")
    )
    return out.select(*keys, *[f"q{i}" for i in range(1, 6)], (q[4] - q[0]).alias("q5_minus_q1"), "times", shape.alias("shape"))


def symbol_contribution(oos: DataFrame, keys: Sequence[str] = ("timeframe", *FACTOR), size: int = 10) -> DataFrame:
    """Symbols with the largest and smallest share of a factor's pooled rank covariance."""
    from barloom.functions.stats import by_shuffle, value_ranks

    keys = list(keys)
    pairs = oos.filter(F.col("factor_value").isNotNull() & F.col("future_return_1").isNotNull()).select(
        *keys, "symbol", (F.col("factor_value") + F.lit(0.0)).alias("_x"), (F.col("future_return_1") + F.lit(0.0)).alias("_y"))
    ranked = pairs
    for v, r in (("_x", "_rx"), ("_y", "_ry")):
        ranked = ranked.join(by_shuffle(value_ranks(pairs, keys, v).select(*keys, v, F.col("avg_rank").alias(r))), [*keys, v])
    sizes = pairs.groupBy(*keys).agg(((F.count(F.lit(1)) + 1) / 2).alias("_centre"))
    per_symbol = ranked.join(sizes, keys).groupBy(*keys, "symbol").agg(
        F.sum((F.col("_rx") - F.col("_centre")) * (F.col("_ry") - F.col("_centre"))).alias("contribution"), F.count(F.lit(1)).alias("rows")
    )
    top = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("contribution").desc(), "symbol"))
    bottom = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("contribution").asc(), "symbol"))
    return per_symbol.withColumn("top_rank", top).withColumn("bottom_rank", bottom).filter(
        (F.col("top_rank") <= size) | (F.col("bottom_rank") <= size)
    )


def reconstruction_error(stored: DataFrame, recomputed: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Largest difference between stored and recomputed factor columns, and rows where only one is null."""
    joined = stored.select(*BAR_KEY, *factors).join(
        recomputed.select(*BAR_KEY, *[F.col(f).alias(f"_{f}") for f in factors]), BAR_KEY, "full"
    )
    wide = joined.agg(*[
        F.struct(F.lit(f).alias("factor_name"), F.count(f).alias("values"), F.max(F.abs(F.col(f) - F.col(f"_{f}"))).alias("max_abs_difference"),
                 F.count_if(F.col(f).isNull() != F.col(f"_{f}").isNull()).alias("null_mismatches")).alias(f)
        for f in factors
    ])
    return wide.select(F.explode(F.array(*factors)).alias("s")).select("s.*")


def rebuilt_levels(bars: DataFrame, part: str = "year") -> DataFrame:
    """Cumulative levels and the next bar's return, rebuilt from bars stored in parts of a series.

    Each part needs two values of the parts before it (last close, totals) and one of the part behind (first close), so a series
    of any length is rebuilt by windows over its parts.  ``open_interest`` may be missing; its level is null then.
    """
    keys = ["symbol", "timeframe"]
    interest = F.col("open_interest") if "open_interest" in bars.columns else F.lit(None)
    rows = bars.select(*keys, part, "open_time", "close", "volume", interest.cast("double").alias("open_interest_level"))
    rows = across_parts(across_parts(rows, keys, part, "close", "_last"), keys, part, "close", "_next", ahead=True)
    move = F.col("close") - F.col("_last")
    rows = rows.withColumns({"_signed": F.signum(move) * F.col("volume"), "_moved": (F.try_divide("close", "_last") - 1) * F.col("volume")})
    for source, name in (("_signed", "on_balance_volume"), ("_moved", "price_volume_trend")):
        rows = total_across_parts(rows, keys, part, source, name)
    return rows.select(*keys, "open_time", *LEVELS, F.try_divide(F.col("_next") - F.col("close"), F.col("close")).alias("future_return_1"))


def level_differences(stored: DataFrame, bars: DataFrame, names: Sequence[str] = (*LEVELS, "future_return_1"), part: str = "year", tolerance: float = 1e-9) -> DataFrame:
    """Stored levels and labels against rebuilt ones, per timeframe and column, with the first wrong bar.

    A value is wrong if it is off by more than ``tolerance`` times the larger of one and the rebuilt value, or not finite.  Null
    on one side only is a null mismatch; a stored label may be null where the next bar lies in another part.
    """
    again = rebuilt_levels(bars, part).select(*BAR_KEY, *[F.col(n).alias(f"_{n}") for n in names])
    joined = stored.select(*BAR_KEY, *names).join(again, BAR_KEY, "full")
    cells = joined.select("timeframe", "open_time", F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("stored"), F.col(f"_{n}").alias("again")) for n in names])).alias("c")).select("timeframe", "open_time", "c.*")
    off = F.abs(F.col("stored") - F.col("again"))
    wrong = F.coalesce(~(off <= tolerance * F.greatest(F.lit(1.0), F.abs("again"))) | F.isnan(off), F.lit(False))
    mismatch = (F.col("stored").isNull() != F.col("again").isNull()) & ~((F.col("name") == "future_return_1") & F.col("stored").isNull())
    return cells.groupBy("timeframe", F.col("name").alias("factor_name")).agg(
        F.count("stored").alias("values"), F.max(off).alias("max_abs_difference"), F.count_if(wrong).alias("wrong_rows"),
        F.count_if(mismatch).alias("null_mismatches"), F.min(F.when(wrong, F.col("open_time"))).alias("first_wrong_time"))


def compare_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old against new selected factor sets: membership and mean fold IC of each factor."""
    def side(df: DataFrame, label: str) -> DataFrame:
        return df.groupBy("timeframe", *FACTOR).agg(F.avg("oriented_oos_ic").alias(f"{label}_ic"), F.count("oriented_oos_ic").alias(f"{label}_folds"))

    joined = side(old, "old").join(side(new, "new"), ["timeframe", *FACTOR], "full")
    kind = F.when(F.col("old_folds").isNull(), "ADDED").when(F.col("new_folds").isNull(), "REMOVED").otherwise("KEPT")
    return joined.withColumn("membership", kind)


def replacement_decision(status: Column, selected: Column, retired: Column) -> Column:
    """A factor's decision: retired, ineligible by status (none at all: no observations), or eligible with or without selection."""
    return (
        F.when(retired, "RETIRED_EXISTING_FACTOR").when(status.isNull() & selected.isNull(), INELIGIBLE[0]).when(status.isin(*INELIGIBLE), status)
        .when(selected, "ELIGIBLE_AND_SELECTED").otherwise("ELIGIBLE_NOT_SELECTED")
    )


def _usable() -> Column:
    return F.col("factor_value").isNotNull() & F.col("future_return_1").isNotNull()


def day_bitmaps(oos: DataFrame) -> DataFrame:
    """The days on which a factor has a value and a return, as bitmaps: one row per factor and bucket of 32,768 days."""
    day = F.floor(F.col("open_time") / DAY_MS)
    return oos.filter(_usable()).groupBy("timeframe", *FACTOR, F.bitmap_bucket_number(day).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(day)).alias("days"))


def factor_replacement(oos: DataFrame, old: DataFrame, new: DataFrame, fold_ics: DataFrame, retired: Sequence[str]) -> DataFrame:
    """Every factor of an out-of-sample table with its place in the old and the new set, decision, coverage and ICs.

    ``old`` and ``new`` are selections (timeframe, factor, eligibility_status, selected, selected_direction, selection_ic); where both
    have a factor the new one counts.  ``retired`` factors are retired whatever their status.  A factor in neither selection has no
    observations to judge.  ``fold_ics`` has raw_oos_ic and oriented_oos_ic per factor and fold.
    """
    keys = ["timeframe", *FACTOR]
    fields = ["eligibility_status", "selected", "selected_direction", "selection_ic"]
    in_old, in_new = (df.select(*keys, F.struct(*fields).alias(side)) for df, side in ((old, "_old"), (new, "_new")))
    covered = oos.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.count_if(_usable()).alias("observation_count_oos"))
    days = day_bitmaps(oos).groupBy(*keys).agg(F.sum(F.bitmap_count("days")).alias("days_covered"))
    ics = fold_ics.groupBy(*keys).agg(
        F.avg("raw_oos_ic").alias("mean_fold_raw_ic"), F.avg("oriented_oos_ic").alias("mean_fold_oriented_ic"), F.count("oriented_oos_ic").alias("fold_count"),
        F.count_if(F.col("oriented_oos_ic") > 0).alias("positive_folds"), F.count_if(F.col("oriented_oos_ic") < 0).alias("negative_folds"))
    pooled = spearman(oos.filter(_usable()), keys, "factor_value", "future_return_1", "_pooled").select(*keys, "_pooled")
    sides = covered.select(*keys).join(in_old, keys, "left").join(in_new, keys, "left").withColumn("_one", F.coalesce("_new", "_old"))
    joined = sides.join(covered, keys).join(days, keys, "left").join(ics, keys, "left").join(pooled, keys, "left")
    return joined.select(
        *keys, F.coalesce("_old.selected", F.lit(False)).alias("in_old_selected"), F.coalesce("_new.selected", F.lit(False)).alias("in_new_selected"),
        replacement_decision(F.col("_one.eligibility_status"), F.col("_one.selected"), F.col("factor_name").isin(*retired)).alias("decision"),
        F.col("_one.selected_direction").cast("int").alias("selected_direction"), F.col("_one.selection_ic").alias("selection_ic"),
        (1 - F.col("observation_count_oos") / F.col("_rows")).alias("null_rate_oos"), "observation_count_oos",
        F.coalesce("days_covered", F.lit(0)).alias("days_covered"), "mean_fold_raw_ic", "mean_fold_oriented_ic",
        (F.col("_pooled") * F.coalesce(F.col("_one.selected_direction").cast("int"), F.lit(1))).alias("aggregate_oriented_ic"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("positive_folds", "negative_folds", "fold_count")],
    )


def set_coverage(oos: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Days covered by the selected factors of two sets, per timeframe.

    ``any`` counts days with a value of at least one factor of the set, ``every`` days with values of all of them, ``shared_days``
    days that both sets cover.  Bitmaps are combined bit by bit; no day is listed.
    """
    members = old.filter("selected").select("timeframe", *FACTOR, F.lit("old").alias("side")).unionByName(
        new.filter("selected").select("timeframe", *FACTOR, F.lit("new").alias("side"))).distinct()
    sizes = members.groupBy("timeframe", "side").agg(F.count(F.lit(1)).alias("factors"))
    maps = members.join(day_bitmaps(oos), ["timeframe", *FACTOR])
    per_bucket = maps.groupBy("timeframe", "side", "bucket").agg(
        F.bitmap_or_agg("days").alias("any"), F.bitmap_and_agg("days").alias("every"), F.count(F.lit(1)).alias("_with")).join(sizes, ["timeframe", "side"])
    every = F.when(F.col("_with") == F.col("factors"), F.bitmap_count("every")).otherwise(F.lit(0).cast("long"))
    counted = per_bucket.select("timeframe", "side", "bucket", "any", F.bitmap_count("any").alias("_any"), every.alias("_every"))
    union = counted.groupBy("timeframe", "bucket").agg(F.bitmap_or_agg("any").alias("both"), *[
        F.coalesce(F.sum(F.when(F.col("side") == side, F.col(f"_{kind}"))), F.lit(0)).alias(f"{side}_{kind}_days")
        for side in ("old", "new") for kind in ("any", "every")])
    names = [f"{side}_{kind}_days" for side in ("old", "new") for kind in ("any", "every")]
    days = union.groupBy("timeframe").agg(*[F.sum(n).alias(n) for n in names], F.sum(F.bitmap_count("both")).alias("_both"))
    counts = sizes.groupBy("timeframe").agg(*[F.coalesce(F.max(F.when(F.col("side") == side, F.col("factors"))), F.lit(0)).alias(f"{side}_factors") for side in ("old", "new")])
    return counts.join(days, "timeframe", "left").select(
        "timeframe", "old_factors", "new_factors", *[F.coalesce(n, F.lit(0)).alias(n) for n in names],
        F.coalesce(F.col("old_any_days") + F.col("new_any_days") - F.col("_both"), F.lit(0)).alias("shared_days"))


def boundary_comparison(first_times: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Bars gained when a factor waits only for its own companions instead of for all of them."""
    kinds = F.array(*[F.struct(F.lit(g).alias("companions"), F.col(f"first_{g}").alias("own_start")) for g in groups])
    return first_times.select(
        "symbol", "timeframe", "year", F.col("first_all").alias("global_start"), F.explode(kinds).alias("k")
    ).select("symbol", "timeframe", "year", "global_start", "k.*", (F.col("global_start") - F.col("k.own_start")).alias("gained_ms"))
