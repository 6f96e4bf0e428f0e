"""Price, interval and error expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from resaleworth import config

PRICE_CUT = 0.10
INTERVAL_SHARE = 0.05


def to_tens(value: Column) -> Column:
    """Round half-even to a multiple of ten; null for null and NaN."""
    return F.rint(F.nanvl(value, F.lit(None).cast("double")) / 10) * 10


def to_cents(value: Column) -> Column:
    """Round half-even to two digits by the exact binary value, not by its decimal text.

    The part after the point times 100 is exact for values from 16 on, so no tie is decided wrongly.
    """
    whole = F.floor(value).cast("double")
    return (whole * 100 + F.rint((value - whole) * 100)) / 100


def adjusted_price(prediction: Column) -> Column:
    return to_tens(prediction * (1 - PRICE_CUT))


def interval_low(price: Column) -> Column:
    return to_tens(price * (1 - INTERVAL_SHARE))


def interval_high(price: Column) -> Column:
    return to_tens(price * (1 + INTERVAL_SHARE))


def interval(low: Column, high: Column) -> Column:
    return F.array(low, high)


def point_price(prediction: Column) -> Column:
    return to_cents(prediction)


def point_low(price: Column, width: float = config.POINT_INTERVAL_RANGE) -> Column:
    return to_cents(price - F.lit(width / 2) * price)


def point_high(price: Column, width: float = config.POINT_INTERVAL_RANGE) -> Column:
    return to_cents(price + F.lit(width / 2) * price)


def rule_year(bike_year: Column, as_of: dt.date) -> Column:
    """Model year for the list-price rule: floored at 2020, never later than the current year."""
    floor = F.lit(config.MODEL_YEAR_FLOOR)
    return F.least(F.greatest(F.coalesce(bike_year, floor), floor), F.lit(as_of.year))


def rule_price(msrp: Column, factor: Column, ratio: float = config.RULE_RATIO) -> Column:
    return to_tens(msrp * factor * ratio * (1 - PRICE_CUT))


def takes_rule(msrp: Column, bounds: config.PriceBounds = config.BOUNDS) -> Column:
    """List prices the model has too few sales for. Never null: a missing list price takes the model."""
    extreme = ((msrp > 0) & (msrp <= bounds.msrp_min)) | (msrp >= bounds.msrp_max)
    return F.coalesce(extreme, F.lit(False))


def in_range(actual: Column, low: Column, high: Column) -> Column:
    return F.coalesce(actual.between(low, high), F.lit(False)).cast("int")


def difference(actual: Column, prediction: Column) -> Column:
    return actual - prediction


def relative_error_pct(actual: Column, prediction: Column) -> Column:
    return (actual - prediction) / F.nullif(actual, F.lit(0)) * 100


# Right-closed upper edges of the relative error and their labels.
ERROR_BINS = (
    (-100, "Overestimate <-100%"),
    (-50, "-100% to -50%"),
    (-20, "-50% to -20%"),
    (-10, "-20% to -10%"),
    (0, "-10% to 0%"),
    (10, "0% to 10%"),
    (20, "10% to 20%"),
    (50, "20% to 50%"),
    (100, "50% to 100%"),
    (None, "Underestimate >100%"),
)


def error_bin(error_pct: Column) -> Column:
    choice = F.when(error_pct.isNull(), F.lit(None).cast("string"))
    for upper, label in ERROR_BINS:
        choice = choice.otherwise(F.lit(label)) if upper is None else choice.when(error_pct <= upper, F.lit(label))
    return choice


def whole_or_zero(value: Column) -> Column:
    """Missing is 0, otherwise the number cut to its whole part."""
    return F.coalesce(value, F.lit(0)).cast("bigint")


def absolute_share_error(actual: Column, prediction: Column) -> Column:
    return F.abs(actual - prediction) / F.abs(F.nullif(actual, F.lit(0)))
