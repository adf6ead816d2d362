"""Pairs of selected factors: scores, combined signals, redundancy, and the alpha score."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.pairwise import greedy_decisions, pair_correlations

from .panel import BAR_KEY

# Limits of the combination filter.
MAX_COMBINATION_CORRELATION = 0.9
MIN_COMBINATION_OVERLAP = 500
ID_SEPARATOR = "|"
ORTHOGONALIZATION_METHOD, ORTHOGONALIZATION_VERSION = "correlation_filter", "1.0.0"


class Lineage(NamedTuple):
    """Where an orthogonalization table comes from: the validation window and the versions of its sources."""

    validation_start_time: int | None = None
    validation_end_time: int | None = None
    source_combination_version: str = "1.0.0"
    source_fta_version: str = "1.0.0"
    source_selection_version: str = "1.0.0"
    dataset_version: str = "1.0.0"
    analysis_time: int | None = None


def combinations(analysis: DataFrame) -> DataFrame:
    """Every pair of selected factors with its timeframe, stability, confidence, score and global rank.

    All pairs of the selected factors are the result asked for; their number is bounded by the square
    of the factor catalog, never by the data.  Each factor is matched against the sorted list of
    factors after it, so the pairs come from one exploded row per factor.
    """
    best = F.col("best_selection_score")
    everything = Window.partitionBy(F.lit(1))
    low, high = F.min(best).over(everything), F.max(best).over(everything)
    norm = F.when(best.isNull(), 0.0).when(high == low, 1.0).otherwise(F.try_divide(best - low, high - low))
    member = F.struct(
        F.col("factor_name").alias("name"), F.col("factor_version").alias("version"),
        F.col("factor_category").alias("category"), F.col("best_timeframe").alias("timeframe"),
        best.alias("score"), F.col("timeframe_confidence").alias("confidence"), norm.alias("norm"),
    )
    one = Window.partitionBy("factor_name", "factor_version").orderBy(best.desc_nulls_last())
    members = (
        analysis.filter("selected").withColumn("_n", F.row_number().over(one)).filter("_n = 1")
        .select(member.alias("a"))
    )
    later = F.filter("_all", lambda m: (m["name"] > F.col("a.name")) | (
        (m["name"] == F.col("a.name")) & (m["version"] > F.col("a.version"))))
    pairs = members.withColumn("_all", F.collect_list("a").over(everything)).select("a", F.explode(later).alias("b"))
    timeframe = (
        F.when(F.col("a.timeframe") == F.col("b.timeframe"), F.col("a.timeframe"))
        .when(F.col("a.score") > F.col("b.score"), F.col("a.timeframe"))
        .when(F.col("b.score") > F.col("a.score"), F.col("b.timeframe"))
        .otherwise(F.least("a.timeframe", "b.timeframe"))
    )
    out = pairs.select(
        F.concat("a.name", F.lit(ID_SEPARATOR), "b.name").alias("combination_id"),
        F.array("a.name", "b.name").alias("factor_names"),
        F.array("a.version", "b.version").alias("factor_versions"),
        F.array("a.category", "b.category").alias("factor_categories"),
        timeframe.alias("timeframe"), F.lit(2).alias("combination_size"),
        F.lit("equal_weight").alias("combination_method"),
        ((F.col("a.confidence") + F.col("b.confidence")) / 2).alias("stability_score"),
        ((F.col("a.confidence") + F.col("b.confidence") + F.col("a.norm") + F.col("b.norm")) / 4).alias("confidence_score"),
        ((F.col("a.score") + F.col("b.score")) / 2).alias("combination_score"),
        F.lit("PASS").alias("status"),
    )
    order = everything.orderBy(F.col("combination_score").desc_nulls_last(), "combination_id")
    return out.withColumn("combination_rank", F.row_number().over(order))


def members_of(combos: DataFrame) -> DataFrame:
    return combos.select(
        "combination_id", "timeframe", "combination_size",
        F.explode(F.arrays_zip("factor_names", "factor_versions")).alias("m"),
    ).select(
        "combination_id", "timeframe", "combination_size", F.col("m.factor_names").alias("factor_name"),
        F.col("m.factor_versions").alias("factor_version"),
    )


def combined_signal(combos: DataFrame, panel: DataFrame) -> DataFrame:
    """Equal-weight mean of the members on every bar where all of them are finite."""
    finite = panel.filter(
        F.col("factor_value").isNotNull() & ~F.isnan("factor_value") & (F.abs("factor_value") != float("inf"))
    ).select(*BAR_KEY, "factor_name", "factor_version", "factor_value")
    joined = finite.join(members_of(combos), ["factor_name", "factor_version", "timeframe"])
    return joined.groupBy("combination_id", *BAR_KEY).agg(
        F.avg("factor_value").alias("signal"), F.count(F.lit(1)).alias("_n"),
        F.max("combination_size").alias("_size"),
    ).filter("_n = _size").drop("_n", "_size")


def orthogonal_combinations(
    combos: DataFrame, panel: DataFrame, max_correlation: float = MAX_COMBINATION_CORRELATION,
    min_overlap: int = MIN_COMBINATION_OVERLAP, lineage: Lineage | None = None,
) -> DataFrame:
    """Greedy filter over combined signals, with ranks of the survivors, audit columns and lineage.

    Only bars of the lineage's window (both ends included) count.  The combination list (bounded by the square of the
    catalog) is read to the driver to lay out the matrix; the signals and their pair moments are computed where the panel
    rows are, all timeframes in one pass, and only pairs at the limit or above reach the filter.  Without a combination
    the table is empty.
    """
    lineage = lineage or Lineage()
    position = F.row_number().over(
        Window.partitionBy("timeframe").orderBy("combination_rank", "combination_id")) - 1
    placed = combos.withColumn("position", position.cast("int"))
    layout = sorted(placed.select("timeframe", "position", "factor_names", "factor_versions").collect(), key=lambda r: r.position)
    factors = sorted({(n, v) for r in layout for n, v in zip(r.factor_names, r.factor_versions)})
    place = {f: i for i, f in enumerate(factors)}
    index: dict[str, list] = {}
    for r in layout:
        index.setdefault(r.timeframe, []).append([place[f] for f in zip(r.factor_names, r.factor_versions)])

    def signals(timeframe: str, values: np.ndarray) -> np.ndarray:
        return np.stack([_mean_of(values[:, own]) for own in index[timeframe]], axis=1)

    if factors:
        values = [
            F.first(F.when((F.col("factor_name") == n) & (F.col("factor_version") == v), F.col("factor_value")), ignorenulls=True).alias(f"f{i}")
            for (n, v), i in place.items()
        ]
        inside = F.lit(True)
        if lineage.validation_start_time is not None:
            inside &= F.col("open_time") >= lineage.validation_start_time
        if lineage.validation_end_time is not None:
            inside &= F.col("open_time") <= lineage.validation_end_time
        wide = panel.filter(F.col("timeframe").isin(list(index)) & inside).groupBy(*BAR_KEY).agg(*values)
        pairs = pair_correlations(wide, "timeframe", [f"f{i}" for i in place.values()], signals,
                                  widths={t: len(x) for t, x in index.items()}, limit=max_correlation, min_overlap=min_overlap)
    else:
        pairs = combos.sparkSession.createDataFrame([], "timeframe string, a int, b int, overlap long, abs_corr double")
    decisions = greedy_decisions(pairs, placed, "timeframe", max_correlation, min_overlap)
    names = placed.select("timeframe", F.col("position").alias("reference"),
                          F.col("combination_id").alias("redundancy_reference_combination_id"))
    joined = placed.join(decisions, ["timeframe", "position"]).join(names, ["timeframe", "reference"], "left")
    survivors = Window.partitionBy("timeframe").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.sum(F.when(~F.col("rejected"), 1).otherwise(0)).over(survivors)
    nothing = F.lit(None).cast("double")
    return joined.select(
        "combination_id", "factor_names", "factor_versions", "factor_categories", "timeframe", "combination_size", "combination_method",
        F.lit(ORTHOGONALIZATION_METHOD).alias("orthogonalization_method"), F.lit(ORTHOGONALIZATION_VERSION).alias("orthogonalization_version"),
        F.lit(lineage.analysis_time).cast("long").alias("analysis_time"),
        F.col("combination_rank").alias("source_combination_rank"),
        F.col("combination_score").alias("source_combination_score"),
        F.col("stability_score").alias("source_stability_score"),
        F.col("confidence_score").alias("source_confidence_score"),
        F.col("abs_corr").alias("correlation_score"), nothing.alias("vif_score"), F.col("abs_corr").alias("redundancy_score"),
        nothing.alias("orthogonality_score"), nothing.alias("information_retained"),
        F.col("overlap").alias("correlation_overlap"), F.lit(float(max_correlation)).alias("correlation_threshold"),
        F.lit(min_overlap).cast("long").alias("min_overlap_threshold"), F.lit(True).alias("redundancy_checked"),
        F.col("rejected").alias("redundancy_rejected"), "redundancy_reference_combination_id",
        (~F.col("rejected")).alias("selected"),
        F.when(~F.col("rejected"), rank).cast("int").alias("orthogonalization_rank"),
        F.when(F.col("rejected"), "redundant").otherwise("accepted").alias("orthogonalization_reason"),
        F.lit(lineage.source_combination_version).alias("source_combination_version"), F.lit(lineage.source_fta_version).alias("source_fta_version"),
        F.lit(lineage.source_selection_version).alias("source_selection_version"), F.lit(lineage.dataset_version).alias("dataset_version"),
        F.lit(lineage.validation_start_time).cast("long").alias("validation_start_time"),
        F.lit(lineage.validation_end_time).cast("long").alias("validation_end_time"),
        F.when(F.col("rejected"), "FAIL").otherwise("PASS").alias("status"),
    )


def _mean_of(members: np.ndarray) -> np.ndarray:
    """Mean of a combination's members on rows where all are finite, else NaN."""
    whole = np.isfinite(members).all(axis=1)
    return np.where(whole, np.where(np.isfinite(members), members, 0.0).mean(axis=1), np.nan)


def alpha_scores(orthogonal: DataFrame, panel: DataFrame) -> DataFrame:
    """Alpha score of every surviving combination on every bar where all its members are finite."""
    return combined_signal(orthogonal.filter("selected"), panel).withColumnRenamed("signal", "alpha_score")
