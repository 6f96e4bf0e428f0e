"""Error, coverage and distribution tables over (key, actual, prediction, low, high)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from resaleworth import config
from resaleworth.functions import prices as P


def mape(actual: Column, prediction: Column) -> Column:
    """Mean absolute error as a share of the actual value (aggregate)."""
    return F.avg(P.absolute_share_error(actual, prediction))


def mape_pct(actual: Column, prediction: Column) -> Column:
    return mape(actual, prediction) * 100


def coverage(actual: Column, low: Column, high: Column) -> Column:
    """Share of rows whose actual value lies in the interval (aggregate)."""
    return F.avg(P.in_range(actual, low, high))


def coverage_pct(actual: Column, low: Column, high: Column) -> Column:
    return coverage(actual, low, high) * 100


class MapeEvaluator(Evaluator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """MAPE for cross validation; smaller is better."""

    @keyword_only
    def __init__(self, *, labelCol=None, predictionCol=None):
        super().__init__()
        self._setDefault(labelCol=config.LABEL)
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        actual, prediction = F.col(self.getLabelCol()), F.col(self.getPredictionCol())
        return dataset.agg(mape(actual, prediction)).first()[0]

    def isLargerBetter(self) -> bool:
        return False


def result_table(
    actuals: DataFrame, predictions: DataFrame, keys: Sequence[str], label: str = config.LABEL
) -> DataFrame:
    """Actual value, prediction, interval and in-range flag, matched on the row key."""
    return with_in_range(actuals.select(*keys, label).join(predictions.select(*keys, "prediction", "low", "high"), list(keys)), label)


def with_in_range(results: DataFrame, label: str = config.LABEL) -> DataFrame:
    """For predictions that carry the actual value already."""
    return results.withColumn("in_range", P.in_range(F.col(label), F.col("low"), F.col("high")))


def interval_check(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("rows"), F.avg("in_range").alias("share_in_range"))


def error_rows(results: DataFrame, label: str = config.LABEL, prediction: str = "prediction") -> DataFrame:
    """Difference, relative error in percent and its bin per row."""
    actual, guess = F.col(label), F.col(prediction)
    return results.withColumns(
        {"difference": P.difference(actual, guess), "difference_pct": P.relative_error_pct(actual, guess)}
    ).withColumn("difference_bin", P.error_bin(F.col("difference_pct")))


def complete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def whole_numbers(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every numeric column cut to its whole part, missing as 0."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return df.select(
        *[
            P.whole_or_zero(F.col(name)).alias(name) if dtype in numeric and name not in keep else F.col(name)
            for name, dtype in df.dtypes
        ]
    )


def error_breakdown(errors: DataFrame) -> DataFrame:
    """Rows, share and mean error per bin."""
    bins = errors.groupBy("difference_bin").agg(
        F.count("*").alias("rows"),
        F.avg("difference").alias("mean_difference"),
        F.avg("difference_pct").alias("mean_difference_pct"),
    )
    # At most eleven rows, so the total is a window over the bins and not a second scan.
    total = F.sum("rows").over(W.partitionBy())
    return bins.withColumn("share", F.col("rows") / total)


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """(series, bin, bin_low, bin_high, rows): equal-width bins over each column's own range.

    Bins are closed on the left, the last one on both sides. One pass finds the ranges, one counts.
    """
    ends = df.agg(*[f(F.col(name).cast("double")) for name in columns for f in (F.min, F.max)]).first()
    ranges = {name: (ends[2 * i], ends[2 * i + 1]) for i, name in enumerate(columns)}
    parts = []
    for name in columns:
        low, high = ranges[name]
        if low is None:
            continue
        width = (high - low) / bins or 1.0
        slot = F.least(F.floor((F.col(name) - low) / width), F.lit(bins - 1)).cast("int")
        parts.append(
            F.struct(
                F.lit(name).alias("series"),
                slot.alias("bin"),
                (F.lit(low) + slot * width).alias("bin_low"),
                (F.lit(low) + (slot + 1) * width).alias("bin_high"),
            )
        )
    placed = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where(F.col("bin").isNotNull())
    return placed.groupBy("series", "bin", "bin_low", "bin_high").agg(F.count("*").alias("rows"))


def density_curve(df: DataFrame, columns: Sequence[str], points: int = 200, cut: float = 3.0) -> DataFrame:
    """(series, x, density): Gaussian kernel density with Scott's bandwidth on an even grid.

    Each value meets the fixed grid inside its own row, and the sums per grid point merge map-side, so no value
    moves. The grid spans the data plus ``cut`` bandwidths.
    """
    aggregates = [f(F.col(name).cast("double")) for name in columns for f in (F.count, F.stddev_samp, F.min, F.max)]
    stats = df.agg(*aggregates).first()
    curves = []
    for i, name in enumerate(columns):
        n, spread, low, high = stats[4 * i : 4 * i + 4]
        if not n or not spread:
            continue
        h = spread * n ** (-1 / 5)
        start, step = low - cut * h, (high - low + 2 * cut * h) / (points - 1)
        curves.append((name, n, h, start, step))
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    result = None
    for name, n, h, start, step in curves:
        values = df.select(F.col(name).cast("double").alias("v"))
        x = F.lit(start) + F.col("i") * step
        kernel = F.exp(-F.pow((F.col("v") - x) / h, 2) / 2)
        curve = (
            values.where(F.col("v").isNotNull())
            .select("v", F.explode(grid).alias("i"))
            .groupBy("i")
            .agg(F.sum(kernel).alias("mass"))
            .select(
                F.lit(name).alias("series"),
                x.alias("x"),
                (F.col("mass") / (n * h * math.sqrt(2 * math.pi))).alias("density"),
            )
        )
        result = curve if result is None else result.unionByName(curve)
    return result


def error_scatter(results: DataFrame, keys: Sequence[str], label: str = config.LABEL) -> DataFrame:
    return results.select(
        *keys, F.col(label), P.relative_error_pct(F.col(label), F.col("prediction")).alias("rel_error_pct")
    )
