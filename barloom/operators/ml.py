"""Training sets, splits, scaling, cross-validation, metrics, and MLlib model jobs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import product

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.stats import with_global_index

KEY = ["symbol", "timeframe", "open_time"]
# Metrics for which a smaller value is better.
SMALLER_IS_BETTER = ("mae", "mse", "rmse")


def training_set(df: DataFrame, symbols: Sequence[str] | None = None, timeframes: Sequence[str] | None = None, years: Sequence[int] | None = None) -> DataFrame:
    """Rows of the chosen series and years; the filters prune partitions of a partitioned table."""
    for column, values in (("symbol", symbols), ("timeframe", timeframes), ("year", years)):
        if values is not None:
            df = df.filter(F.col(column).isin(*values))
    return df


def chronological_split(df: DataFrame, train: float = 0.7, validation: float = 0.15, by: str = "rows") -> DataFrame:
    """Tag rows TRAIN, VALIDATION or TEST in order, without shuffling.

    ``by="rows"`` follows (symbol, timeframe, open_time) like a frame sorted symbol-first;
    ``by="time"`` cuts at bar times, so that no training row is later than a test row.
    """
    if by == "time":
        rows = with_global_index(df, ["open_time"], ["symbol", "timeframe"], "_row").withColumn("_all", F.lit(1))
    else:
        rows = with_global_index(df, KEY, ["open_time"], "_row").withColumn("_all", F.lit(1))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    rows = rows.join(F.broadcast(total.withColumn("_all", F.lit(1))), "_all")
    first, second = F.floor(F.col("_total") * train), F.floor(F.col("_total") * train) + F.floor(F.col("_total") * validation)
    place = F.col("_row")
    if by == "time":
        place = F.min("_row").over(Window.partitionBy("open_time"))
    part = F.when(place < first, "TRAIN").when(place < second, "VALIDATION").otherwise("TEST")
    return rows.withColumn("part", part).drop("_all", "_row", "_total")


def scaler_parameters(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, population deviation, minimum and maximum of every column, one row."""
    return train.agg(*[a(c).alias(f"{c}__{n}") for c in columns for n, a in (
        ("mean", F.avg), ("sd", F.stddev_pop), ("min", F.min), ("max", F.max))])


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float]]:
    """Fitted parameters by column: four numbers per column, read to the driver."""
    row = scaler_parameters(train, columns).first()
    return {c: {n: row[f"{c}__{n}"] for n in ("mean", "sd", "min", "max")} for c in columns}


def scale(df: DataFrame, fitted: dict[str, dict[str, float]], kind: str = "standard") -> DataFrame:
    """Scale the fitted columns; a column without spread becomes 0, nulls stay null."""
    return df.select(*[_scaled(c, fitted[c], kind).alias(c) if c in fitted else F.col(c) for c in df.columns])


def _range(p: dict[str, float], kind: str) -> tuple[float, float]:
    """Offset and width of a scaling."""
    return (p["mean"], p["sd"]) if kind == "standard" else (p["min"], p["max"] - p["min"])


def _scaled(c: str, p: dict[str, float], kind: str) -> Column:
    if kind == "identity":
        return F.col(c)
    low, width = _range(p, kind)
    return F.when(F.col(c).isNotNull(), F.lit(0.0) if width == 0 else (F.col(c) - low) / width)


def unscale(df: DataFrame, fitted: dict[str, dict[str, float]], kind: str = "standard") -> DataFrame:
    if kind == "identity":
        return df
    back = {c: F.col(c) * _range(p, kind)[1] + _range(p, kind)[0] for c, p in fitted.items()}
    return df.select(*[back[c].alias(c) if c in back else F.col(c) for c in df.columns])


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, nulls, NaN, infinities, range and moments per column, from one pass."""
    wide = df.agg(*[
        F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"),
            F.count_if(F.isnan(c)).alias("nans"), F.count_if(F.abs(c) == float("inf")).alias("infinite"),
            F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        ).alias(c)
        for c in columns
    ])
    return wide.select(F.explode(F.array(*columns)).alias("s")).select("s.*")


def class_shares(df: DataFrame, label: str) -> DataFrame:
    # One row per class reaches the window.
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(F.lit(1))))


def expanding_folds(df: DataFrame, folds: int) -> DataFrame:
    """Row blocks for expanding-window validation: block 0 only trains, block k validates fold k.

    Train rows of fold k are the rows with ``block < k``.
    """
    rows = with_global_index(df, ["open_time"], ["symbol", "timeframe"], "_row").withColumn("_all", F.lit(1))
    total = df.agg(F.count(F.lit(1)).alias("_total")).withColumn("_all", F.lit(1))
    size = F.floor(F.col("_total") / (folds + 1))
    lead_in = F.col("_total") - size * folds
    block = F.when(F.col("_row") < lead_in, 0).otherwise(F.floor((F.col("_row") - lead_in) / size) + 1)
    return rows.join(F.broadcast(total), "_all").withColumn("block", block.cast("int")).drop("_all", "_row", "_total")


def regression_metrics(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    error = F.col(prediction) - F.col(label)
    out = df.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.var_pop(label).alias("_var")
    )
    return out.select(*keys, "mae", "mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide("mse", "_var")).alias("r2"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and macro precision, recall and F1; an undefined ratio counts as zero."""
    cells = df.groupBy(F.col(label).cast("int").alias("_y"), F.col(prediction).cast("int").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("_y").alias("c"), F.col("_n").alias("actual"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(F.lit(0)).alias("hit")),
        F.struct(F.col("_p").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("_n").alias("called"), F.lit(0).cast("long").alias("hit")),
    )).alias("s")).select("s.*")
    per_class = sides.groupBy("c").agg(F.sum("actual").alias("actual"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    scored = per_class.select("*", ratio("hit", "called").alias("_precision"), ratio("hit", "actual").alias("_recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("_precision") * F.col("_recall"), F.col("_precision") + F.col("_recall")), F.lit(0.0))
    return scored.agg(
        (F.sum("hit") / F.sum("actual")).alias("accuracy"), F.avg("_precision").alias("precision"), F.avg("_recall").alias("recall"),
        F.avg(f1).alias("f1"),
    )


MODELS = {"gbt_regressor": GBTRegressor, "gbt_classifier": GBTClassifier, "random_forest_classifier": RandomForestClassifier}


def assembled(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Vector of the features; rows with a missing input cannot be used by the trees and go."""
    whole = df.dropna(subset=[*features, label]).withColumn(label, F.col(label).cast("double"))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(whole)


def train(df: DataFrame, features: Sequence[str], label: str, model: str = "gbt_regressor", **settings):
    estimator = MODELS[model](featuresCol="features", labelCol=label, seed=7, **settings)
    return estimator.fit(assembled(df, features, label))


def predict(model, df: DataFrame, features: Sequence[str], label: str, name: str, version: str) -> DataFrame:
    """Prediction table: bar key, model name and version, prediction."""
    return model.transform(assembled(df, features, label)).select(
        *KEY, F.lit(name).alias("model_name"), F.lit(version).alias("model_version"), F.col("prediction").cast("double").alias("prediction"), label
    )


def cross_validate(df: DataFrame, features: Sequence[str], label: str, folds: int, model: str = "gbt_regressor", **settings) -> DataFrame:
    """Regression metrics per fold of an expanding window; one model is fitted per fold."""
    blocks = expanding_folds(df.dropna(subset=[*features, label]), folds)
    out = None
    for k in range(1, folds + 1):
        fitted = train(blocks.filter(F.col("block") < k), features, label, model, **settings)
        scored = fitted.transform(assembled(blocks.filter(F.col("block") == k), features, label))
        row = regression_metrics(scored, label, "prediction").select(F.lit(k).alias("fold"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def grid(space: dict[str, Iterable]) -> list[dict]:
    names = list(space)
    return [dict(zip(names, values)) for values in product(*[list(space[n]) for n in names])]


def search(df: DataFrame, features: Sequence[str], label: str, space: dict[str, Iterable], folds: int, metric: str = "rmse", model: str = "gbt_regressor") -> DataFrame:
    """Mean validation metric of every parameter combination, best first."""
    out = None
    for settings in grid(space):
        score = cross_validate(df, features, label, folds, model, **settings).agg(F.avg(metric).alias(metric))
        row = score.select(F.lit(str(sorted(settings.items()))).alias("parameters"), metric)
        out = row if out is None else out.unionByName(row)
    order = F.col(metric).asc() if metric in SMALLER_IS_BETTER else F.col(metric).desc()
    return out.orderBy(order)


def workflow(df: DataFrame, features: Sequence[str], label: str, model: str = "gbt_regressor", scaler: str = "standard", **settings) -> DataFrame:
    """Split by time, scale on the training part, fit, and report metrics per part."""
    parts = chronological_split(df.dropna(subset=[*features, label]), by="time")
    scaled = scale(parts, fit_scaler(parts.filter("part = 'TRAIN'"), features), scaler)
    fitted = train(scaled.filter("part = 'TRAIN'"), features, label, model, **settings)
    return regression_metrics(fitted.transform(assembled(scaled, features, label)), label, "prediction", ["part"])
