"""One feature step for training rows and for requests."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection

from pyspark.sql import DataFrame, functions as F

from resaleworth import config
from resaleworth.functions import scalars as S
from resaleworth.operators.clean import lift_to_base_year


def derive_features(df: DataFrame, factors: DataFrame, as_of: dt.date) -> DataFrame:
    """Period, model age, list price in base-year money (log), ordinal codes."""
    dated = df.withColumns(
        {
            "bike_created_at_year": S.year_or_current(F.col("bike_created_at_year"), as_of).cast("bigint"),
            "bike_created_at_month": S.month_or_current(F.col("bike_created_at_month"), as_of).cast("bigint"),
            "bike_year": S.repaired_model_year(F.col("bike_year"), as_of).cast("bigint"),
            "msrp": S.zero_to_null(F.col("msrp")),
        }
    )
    lifted = lift_to_base_year(dated, "msrp", S.floored_model_year(F.col("bike_year")), factors)
    month = F.col("bike_created_at_month")
    return lifted.withColumns(
        {
            "msrp": S.guarded_log(F.col("msrp")),
            "bike_created_at_month_sin": S.month_sin(month),
            "bike_created_at_month_cos": S.month_cos(month),
            "bike_age": F.col("bike_created_at_year") - F.col("bike_year"),
            "mileage_code": S.mileage_ordinal(F.col("mileage_code")),
            "condition_code": S.number_or_null(F.col("condition_code")),
        }
    ).drop("bike_year")


def sentinels_to_null(df: DataFrame, keep: Collection[str] = ("id",)) -> DataFrame:
    """'None' and 0 become null in every column except keys, where 0 is a value."""
    return df.select(
        *[
            F.col(name) if name in keep else S.sentinel_to_null(F.col(name), dtype).alias(name)
            for name, dtype in df.dtypes
        ]
    )


def engineer_features(
    df: DataFrame,
    factors: DataFrame,
    as_of: dt.date,
    keys: Collection[str] = ("id",),
    zero_is_missing: bool = True,
) -> DataFrame:
    derived = derive_features(df, factors, as_of)
    return sentinels_to_null(derived, keys) if zero_is_missing else derived


def training_rows(features: DataFrame, label: str = config.LABEL) -> DataFrame:
    """Rows whose label could be expressed in base-year money."""
    return features.where(F.col(label).isNotNull())


def split_features_label(df: DataFrame, keys: list[str], label: str = config.LABEL) -> tuple[DataFrame, DataFrame]:
    """Features and label as two tables on the same keys."""
    return df.drop(label), df.select(*keys, label)
