"""Checks of the long factor panel: null classes, invalid numbers, inconsistent metadata, findings."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PANEL_KEY = ("timeframe", "factor_name", "factor_version")
# Factors whose formula is undefined on some valid bars.
DOMAIN_NULL_FACTORS = ("ease_of_movement", "volume_rate_of_change")


def null_classes(panel: DataFrame) -> DataFrame:
    """Nulls per series and factor: before the first valid value (WARMUP), explained by the formula's
    domain (DOMAIN), or UNEXPECTED."""
    keys = ["symbol", *PANEL_KEY]
    valid_from = panel.groupBy(*keys).agg(
        F.min(F.when(F.col("factor_value").isNotNull(), F.col("open_time"))).alias("valid_from")
    )
    nulls = panel.filter(F.col("factor_value").isNull()).select(*keys, "open_time")
    kind = (
        F.when(F.col("valid_from").isNull() | (F.col("open_time") < F.col("valid_from")), "WARMUP")
        .when(F.col("factor_name").isin(*DOMAIN_NULL_FACTORS), "DOMAIN")
        .otherwise("UNEXPECTED")
    )
    return nulls.join(valid_from, keys).groupBy(*keys, kind.alias("null_class")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("open_time").alias("first_time")
    )


def invalid_number(value):
    size = F.abs(value)
    return (
        F.when(F.isnan(value), "NAN")
        .when(value == float("inf"), "POSITIVE_INFINITY")
        .when(value == float("-inf"), "NEGATIVE_INFINITY")
        .when(size > sys.float_info.max / 2, "OVERFLOW")
        .when((size > 0) & (size < sys.float_info.min), "UNDERFLOW")
    )


def invalid_numbers(panel: DataFrame) -> DataFrame:
    kind = invalid_number(F.col("factor_value"))
    return (
        panel.withColumn("invalid_class", kind)
        .filter(F.col("invalid_class").isNotNull())
        .groupBy("symbol", *PANEL_KEY, "invalid_class")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("open_time").alias("first_time"))
    )


def inconsistent_metadata(panel: DataFrame) -> DataFrame:
    """Factors that appear with more than one version or category."""
    return (
        panel.groupBy("factor_name", "factor_version", "factor_category").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("factor_name")
        .agg(
            F.count_distinct("factor_version").alias("versions"),
            F.count_distinct("factor_category").alias("categories"),
            F.sum("rows").alias("rows"),
        )
        .filter("versions > 1 OR categories > 1")
    )


def failure_findings(panel: DataFrame) -> DataFrame:
    """Unexpected nulls and positive infinities of all partitions in one table."""
    nulls = null_classes(panel).filter("null_class = 'UNEXPECTED'").withColumnRenamed("null_class", "finding")
    numbers = (
        invalid_numbers(panel)
        .filter(F.col("invalid_class") == "POSITIVE_INFINITY")
        .withColumnRenamed("invalid_class", "finding")
    )
    return nulls.unionByName(numbers)


def finding_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("finding").agg(
        F.sum("rows").alias("rows"),
        F.count_distinct("symbol").alias("symbols"),
        F.count_distinct("factor_name").alias("factors"),
    )
