"""Revenue forecast by a random forest on lagged days, for many series at once.

The fitted forest is published as a table of nodes. Errors and forecasts are read off it: a batch of series takes
all its steps in one pass, each prediction becoming a lag of the next.

A series has one row per day with orders: columns ``series``, ``date`` and ``revenue``. All
windows run within a series, so a task holds at most one calendar of one series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlines.functions.expressions import weekend_flag
from orderlines.functions.storage import materialize, new_path

LAGS = (1, 2, 3, 7)
WEEK = 7
MIN_ROWS = 2 * WEEK
SEED = 42
FEATURES = (
    ["day_num", "month", "is_weekend", "day_of_month"]
    + [f"lag_{k}" for k in LAGS]
    + ["rolling_mean_7", "rolling_std_7"]
    + [f"wd_{day}" for day in range(WEEK)]
)


def revenue_series(daily: DataFrame, series: str | None = None) -> DataFrame:
    """Input rows from a daily table with ``revenue`` or ``total_revenue``."""
    value = "total_revenue" if "total_revenue" in daily.columns else "revenue"
    name = F.col(series) if series else F.lit("all")
    return daily.select(
        name.cast("string").alias("series"),
        F.col("date").cast("date").alias("date"),
        F.col(value).cast("double").alias("revenue"),
    )


def _calendar_features(date: Column) -> dict[str, Column]:
    weekday = F.weekday(date)
    return {
        "month": F.month(date),
        "is_weekend": weekend_flag(weekday),
        "day_of_month": F.dayofmonth(date),
        **{f"wd_{day}": F.coalesce((weekday == day).cast("int"), F.lit(0)) for day in range(WEEK)},
    }


def lag_features(daily: DataFrame) -> DataFrame:
    """Training rows: calendar, lags, and mean and sample deviation of the seven days before.

    The first seven days of a series have no full history and are left out. ``n_days`` is the
    length of the series.
    """
    days = Window.partitionBy("series").orderBy("date")
    before = days.rowsBetween(-WEEK, -1)
    return (
        daily.withColumns(
            {
                "n_days": F.count(F.lit(1)).over(Window.partitionBy("series")),
                "day_num": F.row_number().over(days) - 1,
                **{f"lag_{k}": F.lag("revenue", k).over(days) for k in LAGS},
                "rolling_mean_7": F.avg("revenue").over(before),
                "rolling_std_7": F.coalesce(F.stddev_samp("revenue").over(before), F.lit(0.0)),
            }
        )
        .withColumns(_calendar_features(F.col("date")))
        .where(F.col("day_num") >= WEEK)
        .select("series", "date", "revenue", "n_days", *FEATURES)
    )


#: Nodes of a forest, per tree from root 0: left where the feature is at most the threshold; feature -1 at a leaf.
NODES = ["tree", "node", "feature", "threshold", "left", "right", "prediction"]


@dataclass(frozen=True)
class Forecast:
    """``nodes`` is None where no series was long enough for a forest."""

    days: DataFrame
    quality: DataFrame
    nodes: DataFrame | None = None


def scaled_series(daily: DataFrame) -> DataFrame:
    """Every series as shares of its mean day, with that mean as ``scale``."""
    scales = daily.groupBy("series").agg(F.avg("revenue").alias("mean")).select(
        "series", F.when(F.abs("mean") > 0, F.abs("mean")).otherwise(1.0).alias("scale")
    )
    return daily.join(scales, "series").withColumn("revenue", F.col("revenue") / F.col("scale"))


def forest_nodes(model: RandomForestRegressionModel) -> DataFrame:
    """The node table of a fitted forest; at most trees x 2^(depth + 1) rows."""
    spark = SparkSession.getActiveSession()
    path = new_path(spark, "forest")
    model.write().save(path)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.prediction").alias("prediction"),
    )


def _walker(nodes: pd.DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Mean prediction of all trees for the rows of a feature matrix."""
    trees, slots = int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    feature, left, right = (np.full((trees, slots), -1, np.int64) for _ in range(3))
    threshold, prediction = np.zeros((trees, slots)), np.zeros((trees, slots))
    for table, name in ((feature, "feature"), (left, "left"), (right, "right"), (prediction, "prediction")):
        table[at] = nodes[name]
    threshold[at] = nodes["threshold"].fillna(0.0)

    def predict(points: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(points)), np.zeros(len(points))
        for tree in range(trees):
            node = np.zeros(len(points), np.int64)
            while (inner := feature[tree, node] >= 0).any():
                down = points[rows, feature[tree, node]] <= threshold[tree, node]
                node = np.where(inner, np.where(down, left[tree, node], right[tree, node]), node)
            total += prediction[tree, node]
        return total / trees

    return predict


def forecast(daily: DataFrame, days: int = 14) -> Forecast:
    """Forecast every series: the forest where it has 14 days or more, else its recent mean.

    One forest learns from all series. So that large ones do not decide its splits, each series is
    divided by its mean day before, and what is predicted is multiplied by it again; trees do not
    see the scale of a single series.
    """
    history = materialize(daily, "series")
    lengths = history.groupBy("series").agg(F.count(F.lit(1)).alias("n_days"))
    short = lengths.where(F.col("n_days") < MIN_ROWS).select("series")
    simple = mean_forecast(history.join(short, "series", "left_semi"), days)

    scaled = materialize(scaled_series(history), "scaled-series")
    training = lag_features(scaled.drop("scale")).where(F.col("n_days") >= MIN_ROWS)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    # Written in order and read back, so the number of tasks follows from the size.
    ordered = materialize(
        training.repartitionByRange("series", "date").sortWithinPartitions("series", "date"),
        "training",
    )
    vectors = (
        assembler.transform(ordered)
        .select("series", "date", "revenue", "features")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    # The names of the two methods.
    method = F.lit("随机森林回归(RandomForest)")
    fallback = lengths.where(F.col("n_days") < MIN_ROWS).select(
        "series",
        F.lit(None).cast("double").alias("mape"),
        F.lit(None).cast("double").alias("residual_std"),
        F.lit("简单移动平均(数据不足)").alias("method"),
        F.lit(days).alias("forecast_days"),
        F.lit(None).cast("int").alias("n_features"),
    )
    try:
        if vectors.isEmpty():
            return Forecast(simple, fallback)
        model = RandomForestRegressor(
            labelCol="revenue",
            numTrees=100,
            maxDepth=5,
            featureSubsetStrategy="all",
            maxBins=128,
            seed=SEED,
        ).fit(vectors)
    finally:
        vectors.unpersist()
    nodes = forest_nodes(model)
    walk = _walker(nodes.toPandas())

    @F.pandas_udf("double")
    def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(walk(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    scales = scaled.select("series", "scale").distinct()
    fitted = ordered.withColumn("prediction", predict(*[F.col(c).cast("double") for c in FEATURES])).join(scales, "series")
    errors = materialize(_training_errors(fitted), "errors")
    predicted = _ahead(walk, scaled, errors, days)
    quality = errors.select(
        "series",
        F.round("mape", 2).alias("mape"),
        F.round("residual_std", 2).alias("residual_std"),
        method.alias("method"),
        F.lit(days).alias("forecast_days"),
        F.lit(len(FEATURES)).alias("n_features"),
    )
    return Forecast(predicted.unionByName(simple), quality.unionByName(fallback), nodes)


def _training_errors(fitted: DataFrame) -> DataFrame:
    revenue = F.col("revenue") * F.col("scale")
    residual = revenue - F.col("prediction") * F.col("scale")
    return fitted.groupBy("series").agg(
        (F.avg(F.abs(F.try_divide(residual, revenue + 0.01))) * 100).alias("mape"),
        F.stddev_pop(residual).alias("residual_std"),
    )


def _steps(
    walk: Callable[[np.ndarray], np.ndarray], last: np.ndarray, n_days: np.ndarray, ring: np.ndarray, days: int
) -> np.ndarray:
    """Predictions of ``days`` days for many series: rows of ``ring`` are their last seven values."""
    found = []
    for step in range(1, days + 1):
        day = last + step
        date = day.astype("datetime64[D]")
        month = date.astype("datetime64[M]")
        weekday = (day + 3) % 7
        mean = sum(ring[:, k] for k in range(WEEK)) / WEEK
        squares = sum((ring[:, k] - mean) ** 2 for k in range(WEEK))
        features = {
            "day_num": n_days - 1 + step,
            "month": month.astype(np.int64) % 12 + 1,
            "is_weekend": weekday >= 5,
            "day_of_month": (date - month.astype("datetime64[D]")).astype(np.int64) + 1,
            **{f"lag_{k}": ring[:, -k] for k in LAGS},
            "rolling_mean_7": mean,
            "rolling_std_7": np.sqrt(squares / (WEEK - 1)),
            **{f"wd_{k}": weekday == k for k in range(WEEK)},
        }
        found.append(walk(np.column_stack([features[name].astype(float) for name in FEATURES])))
        ring = np.column_stack([ring[:, 1:], found[-1]])
    return np.column_stack(found)


def _ahead(walk: Callable[[np.ndarray], np.ndarray], history: DataFrame, errors: DataFrame, days: int) -> DataFrame:
    """Predict day after day; each prediction is a lag of the next day.

    One row per series holds its last seven values; a batch of series takes all steps at once.
    """
    recent = Window.partitionBy("series").orderBy(F.desc("date"))
    state = (
        history.withColumn("_back", F.row_number().over(recent))
        .withColumn("n_days", F.count(F.lit(1)).over(Window.partitionBy("series")))
        .where(F.col("_back") <= WEEK)
        .groupBy("series")
        .agg(
            F.max("date").alias("last_date"),
            F.first("n_days").alias("n_days"),
            F.first("scale").alias("scale"),
            F.sort_array(F.collect_list(F.struct("date", "revenue")))["revenue"].alias("ring"),
        )
        .join(errors.select("series", "residual_std"), "series")
    )

    @F.pandas_udf("array<double>")
    def steps(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for last, n_days, ring in batches:
            values = np.array(ring.tolist(), dtype=float).reshape(len(ring), WEEK)
            yield pd.Series(list(_steps(walk, last.to_numpy(np.int64), n_days.to_numpy(np.int64), values, days)))

    state = state.withColumn("steps", steps(F.unix_date("last_date").cast("long"), "n_days", "ring"))
    margin = F.col("residual_std") * 1.96

    def shown(value: Column) -> Column:
        return F.round(F.greatest(value, F.lit(0.0)), 2)

    return state.select(
        "series", "last_date", "residual_std", "scale", F.posexplode("steps").alias("_step", "_share")
    ).withColumn("_value", F.col("_share") * F.col("scale")).select(
        "series",
        F.date_add("last_date", F.col("_step") + 1).alias("date"),
        shown(F.col("_value")).alias("predicted"),
        shown(F.col("_value") - margin).alias("lower_bound"),
        shown(F.col("_value") + margin).alias("upper_bound"),
    )


def mean_forecast(daily: DataFrame, days: int = 14) -> DataFrame:
    """Mean of the last seven rows of a series, with bounds of 15 percent, for every day ahead."""
    recent = Window.partitionBy("series").orderBy(F.desc("date"))
    level = (
        daily.withColumn("_back", F.row_number().over(recent))
        .where(F.col("_back") <= WEEK)
        .groupBy("series")
        .agg(F.max("date").alias("last_date"), F.avg("revenue").alias("level"))
    )
    return level.select(
        "series",
        "level",
        F.explode(
            F.sequence(F.date_add("last_date", 1), F.date_add("last_date", days))
        ).alias("date"),
    ).select(
        "series",
        "date",
        F.round("level", 2).alias("predicted"),
        F.round(F.col("level") * 0.85, 2).alias("lower_bound"),
        F.round(F.col("level") * 1.15, 2).alias("upper_bound"),
    )


def forecast_summary(predicted: DataFrame, days: int = 7) -> DataFrame:
    """Total, mean, mean bounds and direction of the first days of each forecast."""
    order = Window.partitionBy("series").orderBy("date")
    first, last = F.min_by("predicted", "date"), F.max_by("predicted", "date")
    return (
        predicted.withColumn("_day", F.row_number().over(order))
        .where(F.col("_day") <= days)
        .groupBy("series")
        .agg(
            F.sum("predicted").alias("total"),
            F.avg("predicted").alias("mean"),
            F.avg("lower_bound").alias("mean_lower"),
            F.avg("upper_bound").alias("mean_upper"),
            # The names of the directions.
            F.when(last > first * 1.05, "上升 ↗")
            .when(last < first * 0.95, "下降 ↘")
            .otherwise("平稳 →")
            .alias("trend"),
        )
    )
