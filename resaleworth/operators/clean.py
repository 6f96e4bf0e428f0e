"""Outlier filters, dedup and money adjustment of the sales extract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from resaleworth import config


def plausible_label(label: str = config.LABEL, bounds: config.PriceBounds = config.BOUNDS) -> Column:
    value = F.col(label)
    return (value > bounds.label_min) & (value < bounds.label_max)


def plausible_msrp(bounds: config.PriceBounds = config.BOUNDS) -> Column:
    return F.col("msrp").isNotNull() & F.col("msrp").between(bounds.msrp_min, bounds.msrp_max)


def plausible_share(label: str = config.LABEL, bounds: config.PriceBounds = config.BOUNDS) -> Column:
    return F.col(label) > F.col("msrp") * bounds.min_share_of_msrp


def plausible_sales(df: DataFrame, label: str = config.LABEL, bounds: config.PriceBounds = config.BOUNDS) -> DataFrame:
    return df.where(plausible_label(label, bounds) & plausible_msrp(bounds) & plausible_share(label, bounds))


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key.

    An aggregate and no window: rows of a hot key merge where they lie, so that one row per key and
    task moves at most. After a sort-merge join on the key it needs neither exchange nor sort.
    """
    row = F.struct(*[name for name in df.columns if name not in keys])
    last = F.max_by(row, F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*df.columns)


def lift_to_base_year(df: DataFrame, value: str, year: Column, factors: DataFrame) -> DataFrame:
    """Multiply ``value`` by the factor of its year; a year without a factor gives null.

    The factor table has one row per calendar year, hence the broadcast.
    """
    lookup = factors.select(F.col("year").alias("_year"), F.col("inflation_factor").alias("_factor"))
    return (
        df.join(F.broadcast(lookup), year == F.col("_year"), "left")
        .withColumn(value, F.col(value) * F.col("_factor"))
        .drop("_year", "_factor")
    )


def training_columns(
    categorical: Sequence[str] = config.CATEGORICAL,
    numerical: Sequence[str] = config.NUMERICAL,
    label: str = config.LABEL,
) -> list[str]:
    wanted = [*categorical, *numerical, label, *config.HELPERS]
    return [name for name in wanted if name not in ("template_id", *config.COMPUTED)]


def clean_sales(
    extract: DataFrame,
    factors: DataFrame,
    order: Sequence[str],
    key: str = "id",
    categorical: Sequence[str] = config.CATEGORICAL,
    numerical: Sequence[str] = config.NUMERICAL,
    label: str = config.LABEL,
    bounds: config.PriceBounds = config.BOUNDS,
) -> DataFrame:
    """Plausible sales, one per listing, with the label in base-year money.

    Dedup follows the filters: the last plausible booking counts, not the last one.
    """
    kept = [key, *training_columns(categorical, numerical, label)]
    plausible = plausible_sales(extract, label, bounds).select(*kept, *order)
    latest = last_per_key(plausible, [key], order).select(*kept)
    return lift_to_base_year(latest, label, F.col("bike_created_at_year"), factors).select(*kept)
