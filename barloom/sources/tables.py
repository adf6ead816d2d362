"""Parquet tables: pushed-down reads, partition replacement, merging, and coverage bookkeeping."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.clock import timeframe_ms, utc_year

PARTITIONS = ("timeframe", "year")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, in order and cast; a missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table, with ``timeframe`` as text.

    Partition type inference would read the directory ``timeframe=1d`` as the number 1.0.
    """
    inferred = spark.read.parquet(path).schema
    fixed = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "timeframe" else f for f in inferred])
    return spark.read.schema(fixed).parquet(path)


def read_panel(
    spark: SparkSession,
    path: str,
    factors: Iterable[str] | None = None,
    versions: Iterable[str] | None = None,
    start: int | None = None,
    end: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Long panel restricted by factor, version and time; all four filters reach the Parquet scan."""
    df = read_table(spark, path)
    return restrict_panel(df, factors, versions, start, end, columns)


def restrict_panel(df, factors=None, versions=None, start=None, end=None, columns=None) -> DataFrame:
    if factors is not None:
        df = df.filter(F.col("factor_name").isin(*factors))
    if versions is not None:
        df = df.filter(F.col("factor_version").isin(*versions))
    if start is not None:
        df = df.filter(F.col("open_time") >= start)
    if end is not None:
        df = df.filter(F.col("open_time") <= end)
    return df.select(*columns) if columns else df


def write_partitions(df: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS, order: Sequence[str] = ("symbol", "open_time")) -> None:
    """Replace the partitions present in ``df`` and leave the others.

    Rows are range-partitioned on partition columns, symbol and time, so a large partition is written
    by many tasks and every file covers a narrow, sorted key range.
    """
    keys = [*partitions, *[c for c in order if c in df.columns]]
    (
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .partitionBy(*partitions).parquet(path)
    )


def merge_rows(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], arrival: str | None = None) -> DataFrame:
    """Union in which an incoming row replaces the stored row of the same key.

    Of several rows of one key in a load the one with the greatest ``arrival`` stays, else the one with the greatest values.
    Newest-by-load as an aggregate rather than a window: copies of one key combine before the shuffle.
    """
    rows = stored.withColumn("_load", F.lit(0)).unionByName(incoming.withColumn("_load", F.lit(1)))
    rest = [c for c in stored.columns if c not in keys]
    newest = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct("_load", *([arrival] if arrival else []), *rest))
    return rows.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*stored.columns)


def upsert(
    spark: SparkSession, incoming: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str] = PARTITIONS, arrival: str | None = None
) -> None:
    """Merge ``incoming`` into the table at ``path``, rewriting only the partitions it touches."""
    try:
        stored = read_table(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        # No table yet.
        write_partitions(incoming, path, partitions)
        return
    touched = incoming.select(*partitions).distinct()
    # Partitions touched by one load: a handful of (timeframe, year) pairs, bounded by the calendar.
    old = stored.join(F.broadcast(touched), list(partitions), "left_semi").select(*incoming.columns)
    merged = merge_rows(old, incoming, keys, arrival)
    staging = f"{path}_staging/{uuid.uuid4().hex[:12]}"
    write_partitions(merged, staging, partitions)
    # The merge reads the partitions it replaces, so it is written aside first.
    write_partitions(read_table(spark, staging), path, partitions)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
    aside.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(aside, True)


def split_by_year(df: DataFrame, time: str = "open_time") -> DataFrame:
    return df.withColumn("year", utc_year(F.col(time)))


def latest_times(df: DataFrame, time: str = "open_time") -> DataFrame:
    return df.groupBy("symbol", "timeframe").agg(F.max(time).alias("latest_time"))


def resume_windows(requests: DataFrame, latest: DataFrame) -> DataFrame:
    """What to load per request (symbol, timeframe, start_time, end_time): everything, the rest, or nothing."""
    step = timeframe_ms(F.col("timeframe"))
    next_bar = F.col("latest_time") + step
    begin = F.when(F.col("latest_time").isNull(), F.col("start_time")).otherwise(F.greatest("start_time", next_bar))
    status = (
        F.when(F.col("latest_time").isNull(), "FULL").when(next_bar > F.col("end_time"), "SKIPPED").otherwise("UPDATED")
    )
    joined = requests.join(latest, ["symbol", "timeframe"], "left")
    return joined.select(
        "symbol", "timeframe", status.alias("status"),
        F.when(status != "SKIPPED", begin).alias("load_start"),
        F.when(status != "SKIPPED", F.col("end_time")).alias("load_end"),
    )


def partition_profile(df: DataFrame, time: str = "open_time") -> DataFrame:
    return split_by_year(df, time).groupBy("symbol", "timeframe", "year").agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )


def _islands(ranges: DataFrame, keys: Sequence[str], step: Column) -> DataFrame:
    """Merge ranges [start, end] that overlap or follow one another within a step."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = ranges.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + step), 1).otherwise(0))
    numbered = flagged.withColumn("_island", F.sum("_new").over(order))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def missing_ranges(bars: DataFrame, expected: DataFrame) -> DataFrame:
    """Uncovered ranges of bar times per series, merged.

    ``expected`` has one row per series with ``first_expected`` and ``last_expected`` bar times; a series
    without bars is missing in full.
    """
    keys = ["symbol", "timeframe"]
    step = timeframe_ms(F.col("timeframe"))
    order = Window.partitionBy(*keys).orderBy("open_time")
    inner = (
        bars.select(*keys, "open_time").withColumn("_next", F.lead("open_time").over(order))
        .filter(F.col("_next") - F.col("open_time") > step)
        .select(*keys, (F.col("open_time") + step).alias("start"), (F.col("_next") - step).alias("end"))
    )
    edges = bars.groupBy(*keys).agg(F.min("open_time").alias("_min"), F.max("open_time").alias("_max"))
    covered = expected.join(edges, keys, "left")
    sides = F.array(
        F.struct(F.col("first_expected").alias("start"),
                 F.coalesce(F.col("_min") - step, F.col("last_expected")).alias("end")),
        F.struct((F.col("_max") + step).alias("start"), F.col("last_expected").alias("end")),
    )
    outer = covered.select(*keys, F.explode(sides).alias("r")).select(*keys, "r.*").filter("start <= end")
    merged = _islands(inner.unionByName(outer), keys, step)
    return merged.withColumn("bars", (F.floor((F.col("end") - F.col("start")) / step) + 1).cast("long"))


def repair_plan(profile: DataFrame, expected_years: DataFrame, broken: DataFrame) -> DataFrame:
    """Issues per series and year: no data, fewer rows than expected, or rows that fail validation.

    ``expected_years`` has symbol, timeframe, year, expected_rows; ``broken`` has symbol, timeframe, year,
    bad_rows.
    """
    keys = ["symbol", "timeframe", "year"]
    joined = expected_years.join(profile.select(*keys, "rows"), keys, "left").join(broken, keys, "left")
    issue = (
        F.when(F.col("rows").isNull(), "MISSING")
        .when(F.coalesce("bad_rows", F.lit(0)) > 0, "CORRUPT")
        .when(F.col("rows") < F.col("expected_rows"), "SHORT")
    )
    return joined.withColumn("issue", issue).filter(F.col("issue").isNotNull()).select(
        *keys, "issue", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "expected_rows",
        F.coalesce("bad_rows", F.lit(0)).cast("long").alias("bad_rows"),
    )


def export_csv(df: DataFrame, path: str, order: Sequence[str], separator: str = "|") -> None:
    """Sorted CSV export; list columns become one text column."""
    csv_ready(df, separator).orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def csv_ready(df: DataFrame, separator: str = "|") -> DataFrame:
    return df.select(*[
        F.array_join(c, separator).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes
    ])
