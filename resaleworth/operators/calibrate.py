"""Intervals that cover what they say: raw quantiles widened by what calibration rows lacked."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from resaleworth import config
from resaleworth.operators.ranking import exact_percentiles
from resaleworth.operators.sampling import hash_bucket

CALIBRATION_SEED = 23


def with_calibration(train: DataFrame, share: float, key: str = "id", seed: int = CALIBRATION_SEED) -> DataFrame:
    """``held`` marks the share of rows that the model must not see. It follows the listing, so the copies of a row stay on its side."""
    return train.withColumn("held", hash_bucket(F.col(key), seed) < round(share * 10_000))


def widening(predicted: DataFrame, coverage: float, label: str = config.LABEL) -> float:
    """By how much both ends must move out (in, if negative) so that ``coverage`` of such rows lie inside.

    A row lacks how far its label lies outside its raw quantiles, negative inside. The answer is the order statistic
    ceil((n + 1) * coverage) of that: for rows drawn alike, the widened interval of a new row holds its label with at least that
    probability, whatever the model. No row or too few for the coverage: infinite.
    """
    lack = F.greatest(F.col("q_low") - F.col(label), F.col(label) - F.col("q_high"))
    rows = predicted.select(lack.cast("double").alias("lack")).where("lack IS NOT NULL")
    n = rows.count()
    rank = math.ceil((n + 1) * coverage)
    if rank > n:
        return math.inf
    return exact_percentiles(rows, ["lack"], [(rank - 1) / (n - 1) if n > 1 else 0.0])["lack"][0]


def widened(predicted: DataFrame, by: float) -> DataFrame:
    """``q_low`` and ``q_high`` moved out by ``by``; they meet in the middle rather than cross."""
    low, high = F.col("q_low") - F.lit(by), F.col("q_high") + F.lit(by)
    middle = (F.col("q_low") + F.col("q_high")) / 2
    return predicted.withColumns({"q_low": F.least(low, middle), "q_high": F.greatest(high, middle)})
