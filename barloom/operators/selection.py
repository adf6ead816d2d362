"""From factor test results to a selected, oriented, non-redundant factor set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.clock import timeframe_ms
from barloom.functions.pairwise import greedy_decisions, pair_correlations

from .panel import IDENTITY

# Score weights (they sum to one), selection sizes and redundancy limits.
WEIGHTS = {
    "information_coefficient": 0.30,
    "rank_information_coefficient": 0.20,
    "ic_information_ratio": 0.20,
    "quantile_spread": 0.10,
    "monotonicity": 0.10,
    "ic_decay": 0.05,
    "turnover": 0.05,
}
TOP_N = 20
CANDIDATE_N = 40
MAX_CORRELATION = 0.9
MIN_OVERLAP = 500
# Bars before the first value where they differ from the declared look-back.
WARMUP_BARS = {
    "atr_slope": 39,
    "breakout_strength": 21,
    "on_balance_volume": 1,
    "price_volume_trend": 1,
}
POLICY = "coverage_v1"


def score_inputs() -> dict[str, Column]:
    return {
        "information_coefficient": F.abs("information_coefficient"),
        "rank_information_coefficient": F.abs("rank_information_coefficient"),
        "ic_information_ratio": F.col("ic_information_ratio"),
        "quantile_spread": F.col("quantile_spread"),
        "monotonicity": F.col("monotonicity_score"),
        "ic_decay": F.col("ic_decay"),
        "turnover": -F.col("turnover"),
    }


def minmax(x: Column, *keys: str) -> Column:
    """Position in the range of the group; 0 for null, 1 when the range is empty."""
    group = Window.partitionBy(*keys)
    low, high = F.min(x).over(group), F.max(x).over(group)
    return F.when(x.isNull(), 0.0).when(high == low, 1.0).otherwise(F.try_divide(x - low, high - low))


def eligibility(validation: DataFrame, lookbacks: dict[str, int] | None = None) -> DataFrame:
    """Eligibility by observations and warm-up.

    ``lookbacks`` gives declared look-backs by factor name (default 0: only known warm-ups count).  When
    the table has ``total_observations``, coverage and null rate are derived from it.
    """
    known = {**(lookbacks or {}), **WARMUP_BARS}
    pairs = [F.lit(v) for item in known.items() for v in item]
    warmup = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("factor_name")), F.lit(0))
    span = F.col("validation_end_time") - F.col("validation_start_time")
    history = F.greatest(F.lit(0), F.floor(span / timeframe_ms(F.col("timeframe"))) + 1).cast("long")
    total = F.col("total_observations") if "total_observations" in validation.columns else F.lit(None).cast("long")
    status = (
        F.when(F.coalesce("observations", F.lit(0)) == 0, "INELIGIBLE_ZERO_OBSERVATIONS")
        .when(F.col("effective_warmup") > F.col("available_history"), "INELIGIBLE_INSUFFICIENT_WARMUP")
        .otherwise("ELIGIBLE")
    )
    return (
        validation.withColumn("effective_warmup", warmup)
        .withColumn("available_history", history)
        .withColumn("coverage_ratio", F.try_divide(F.col("observations").cast("double"), total.cast("double")))
        .withColumn("null_rate", 1 - F.col("coverage_ratio"))
        .withColumn("eligibility_status", status)
        .withColumn("warmup_sufficient", F.col("effective_warmup") <= F.col("available_history"))
        .withColumn("eligibility_policy", F.lit(POLICY))
    )


def scored(validation: DataFrame) -> DataFrame:
    """Min-max normalised components per timeframe, weighted contributions and their sum."""
    inputs = score_inputs()
    normalised = validation.select("*", *[minmax(x, "timeframe").alias(f"{n}_normalized") for n, x in inputs.items()])
    parts = {n: w * F.col(f"{n}_normalized") for n, w in WEIGHTS.items()}
    total = sum(list(parts.values())[1:], list(parts.values())[0])
    return normalised.select(
        "*", *[p.alias(f"{n}_contribution") for n, p in parts.items()], total.alias("selection_score")
    )


def ranked(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("timeframe").orderBy(F.col("selection_score").desc(), "factor_name", "factor_version")
    return scores.withColumn("selection_rank", F.row_number().over(order))


def oriented(selection: DataFrame) -> DataFrame:
    """Direction of the factor by the sign of its IC, and the IC in that direction."""
    direction = F.when(F.col("information_coefficient") < 0, -1).otherwise(1)
    return selection.withColumn("selected_direction", direction.cast("tinyint")).withColumn(
        "oriented_ic", F.col("information_coefficient") * direction
    )


def factor_selection(validation: DataFrame, top_n: int = TOP_N, candidate_n: int = CANDIDATE_N, check_eligibility: bool = True) -> DataFrame:
    """Score, rank and select per timeframe, without looking at factor values."""
    judged = eligibility(validation)
    fit = F.col("eligibility_status") == "ELIGIBLE" if check_eligibility else F.lit(True)
    chosen = ranked(scored(judged.filter(fit))).withColumn("selected", F.col("selection_rank") <= top_n)
    reason = (
        F.when(F.col("selection_rank") > candidate_n, "outside_candidate_n")
        .when(F.col("selected"), "top_n")
        .otherwise("outside_top_n")
    )
    chosen = chosen.withColumn("selection_reason", reason)
    barred = judged.filter(~fit).select(
        "*", F.lit(0.0).alias("selection_score"), F.lit(candidate_n + 1).alias("selection_rank"),
        F.lit(False).alias("selected"), F.lit("hard_ineligible").alias("selection_reason"),
    )
    out = chosen.unionByName(barred, allowMissingColumns=True)
    return oriented(out).withColumn("selection_time", F.col("validation_time"))


def candidate_matrix(selection: DataFrame, panel: DataFrame, candidate_n: int) -> DataFrame:
    """Bars with one column per candidate rank, ``c0`` the best; ranks bound the width, so nothing is collected."""
    ranks = selection.filter(
        (F.col("selection_rank") <= candidate_n) & (F.col("selection_reason") != "hard_ineligible")
    ).select(*IDENTITY, (F.col("selection_rank") - 1).alias("position"))
    values = panel.filter(F.col("factor_value").isNotNull()).select(*IDENTITY, "symbol", "open_time", "factor_value")
    return values.join(ranks, IDENTITY).groupBy("timeframe", "symbol", "open_time").agg(
        *[F.first(F.when(F.col("position") == i, F.col("factor_value")), ignorenulls=True).alias(f"c{i}") for i in range(candidate_n)]
    )


def candidate_correlations(selection: DataFrame, panel: DataFrame, candidate_n: int = CANDIDATE_N) -> DataFrame:
    """Absolute correlation and overlap of every pair of candidates per timeframe."""
    wide = candidate_matrix(selection, panel, candidate_n)
    return pair_correlations(wide, "timeframe", [f"c{i}" for i in range(candidate_n)])


def redundancy_filter(
    selection: DataFrame, panel: DataFrame, top_n: int = TOP_N, candidate_n: int = CANDIDATE_N,
    max_correlation: float = MAX_CORRELATION, min_overlap: int = MIN_OVERLAP,
) -> DataFrame:
    """Greedy redundancy filter over the candidates of each timeframe, with audit columns."""
    candidates = selection.filter(
        (F.col("selection_rank") <= candidate_n) & (F.col("selection_reason") != "hard_ineligible")
    ).select(*IDENTITY, (F.col("selection_rank") - 1).cast("int").alias("position"))
    decisions = greedy_decisions(
        candidate_correlations(selection, panel, candidate_n), candidates, "timeframe", max_correlation, min_overlap
    )
    names = candidates.select(
        "timeframe", F.col("position").alias("reference"), F.col("factor_name").alias("redundancy_reference_factor"),
        F.col("factor_version").alias("redundancy_reference_factor_version"),
    )
    audit = candidates.join(decisions, ["timeframe", "position"]).join(names, ["timeframe", "reference"], "left")
    survivors = Window.partitionBy("timeframe").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    kept_before = F.sum(F.when(~F.col("rejected"), 1).otherwise(0)).over(survivors)
    audit = audit.select(
        *IDENTITY, (F.col("position") + 1).alias("candidate_rank"), F.col("rejected").alias("redundancy_rejected"),
        "redundancy_reference_factor", "redundancy_reference_factor_version",
        F.col("abs_corr").alias("redundancy_correlation"), F.col("overlap").alias("redundancy_overlap"),
        (~F.col("rejected") & (kept_before <= top_n)).alias("_kept"),
    )
    reason = (
        F.when(F.col("redundancy_rejected").isNull(), F.col("selection_reason"))
        .when(F.col("redundancy_rejected"), "redundant")
        .when(F.col("_kept"), "top_n")
        .otherwise("outside_top_n")
    )
    return (
        selection.join(audit, IDENTITY, "left")
        .withColumn("selected", F.coalesce("_kept", F.lit(False)))
        .withColumn("selection_reason", reason)
        .withColumn("redundancy_checked", F.col("candidate_rank").isNotNull())
        .drop("_kept")
    )


AUDIT_COLUMNS = [
    *IDENTITY, "selection_rank", "selection_score", "selected", "selection_reason",
    *[f"{n}_normalized" for n in WEIGHTS], *[f"{n}_contribution" for n in WEIGHTS],
]


def selection_audit(selection: DataFrame) -> DataFrame:
    """Every component of every decision in one table."""
    extra = [c for c in selection.columns if c.startswith("redundancy_") or c == "candidate_rank"]
    return selection.select(*AUDIT_COLUMNS, *extra)


def timeframe_analysis(selection: DataFrame) -> DataFrame:
    """The best timeframe of every selected factor, with margin, stability and confidence."""
    factor = ["factor_name", "factor_version"]
    best_first = [F.col("selection_score").desc_nulls_last()]
    per_timeframe = Window.partitionBy(*factor, "timeframe").orderBy(*best_first, F.col("selection_time").desc_nulls_last())
    one = selection.filter("selected").withColumn("_n", F.row_number().over(per_timeframe)).filter("_n = 1")
    place = F.row_number().over(Window.partitionBy(*factor).orderBy(*best_first, "timeframe"))
    # A factor has at most one row per timeframe here.
    agg = one.withColumn("_place", place).groupBy(*factor).agg(
        *[F.max(F.when(F.col("_place") == 1, F.col(c))).alias(a) for c, a in (
            ("factor_category", "factor_category"), ("selection_time", "analysis_time"),
            ("timeframe", "best_timeframe"), ("selection_score", "best_selection_score"))],
        F.max(F.when(F.col("_place") == 2, F.col("selection_score"))).alias("_second"),
        F.count(F.lit(1)).alias("_count"), F.min("selection_score").alias("_min"),
        F.stddev_pop("selection_score").alias("_std"),
    )
    several = F.col("_count") >= 2

    def clip(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    out = agg.withColumn(
        "winner_margin", F.when(several, F.col("best_selection_score") - F.col("_second"))
    ).withColumn("score_gap", F.when(several, F.col("best_selection_score") - F.col("_min")))
    spread = F.try_divide("_std", "score_gap")
    out = out.withColumn("timeframe_stability", F.when(several & spread.isNotNull(), 1.0 - clip(spread)).otherwise(1.0))
    blended = F.when(F.col("winner_margin").isNull(), 0.5 * F.col("timeframe_stability")).otherwise(
        clip(0.5 * clip(F.col("winner_margin")) + 0.5 * F.col("timeframe_stability"))
    )
    good = F.col("best_timeframe").isNotNull() & F.col("best_selection_score").isNotNull()
    return out.select(
        *factor, "factor_category", "analysis_time", "best_timeframe", "best_selection_score",
        F.lit(1).alias("timeframe_rank"), "winner_margin", "score_gap", "timeframe_stability",
        F.when(several, blended).otherwise(1.0).alias("timeframe_confidence"),
        good.alias("selected"), F.when(good, "PASS").otherwise("FAIL").alias("status"),
    )
