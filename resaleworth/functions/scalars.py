"""Column expressions for cleaning and features. All stay inside whole-stage code generation."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, functions as F

from resaleworth import config

# A plain decimal number; keeps "nan", "inf" and Java suffixes such as "1d" out of the cast.
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"


def complete_months(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MONTH", start, end)


def listed_long_enough(created: Column, as_of: Column, months: int = 2) -> Column:
    return complete_months(created, as_of) >= months


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start).cast("bigint")


def flag_or_zero(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(0))


def year_or_current(year: Column, as_of: dt.date) -> Column:
    return F.coalesce(year, F.lit(as_of.year))


def month_or_current(month: Column, as_of: dt.date) -> Column:
    return F.coalesce(month, F.lit(as_of.month))


def month_sin(month: Column) -> Column:
    return F.sin(F.lit(2 * math.pi) * month / 12)


def month_cos(month: Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * month / 12)


def repaired_model_year(year: Column, as_of: dt.date) -> Column:
    """Missing, ancient or future model years become the default year."""
    usable = year.between(config.MODEL_YEAR_MIN, as_of.year)
    return F.when(usable, year).otherwise(F.lit(config.MODEL_YEAR_DEFAULT))


def floored_model_year(year: Column) -> Column:
    return F.greatest(year, F.lit(config.MODEL_YEAR_FLOOR))


def zero_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0))


def guarded_log(value: Column) -> Column:
    return F.when(value > 0, F.ln(value))


def mileage_ordinal(code: Column, ordinals: Mapping[str, int] = config.MILEAGE_ORDINALS) -> Column:
    """Missing is -1; a known code its ordinal; other text its number if it is one, else null."""
    choice = F.when(code.isNull(), F.lit(float(config.MILEAGE_UNKNOWN)))
    for text, ordinal in ordinals.items():
        choice = choice.when(code == text, F.lit(float(ordinal)))
    return choice.otherwise(number_or_null(code))


def number_or_null(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))


def timestamp_or_null(text: Column) -> Column:
    return F.try_to_timestamp(text)


def sentinel_to_null(value: Column, dtype: str) -> Column:
    """The text 'None' and the number 0 mean "missing"; other types pass through."""
    if dtype == "string":
        return F.when(value != "None", value)
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return F.when(value != 0, value)
    return value


def msrp_from_text(text: Column) -> Column:
    """A list price sent as text: whole numbers count, anything else is 0."""
    whole = F.when(text.rlike(INTEGER_TEXT), F.trim(text).try_cast("bigint"))
    return F.coalesce(whole, F.lit(0)).cast("double")


def msrp_from_variant(value: Column) -> Column:
    """A list price as it came in JSON: null is 0, text by ``msrp_from_text``, numbers pass."""
    is_text = F.schema_of_variant(value) == "STRING"
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    return F.when(is_text, msrp_from_text(text)).otherwise(F.coalesce(number, F.lit(0.0)))


def value_or_default(
    value: Column | None,
    default: Any,
    dtype: str = "bigint",
    na_values: Iterable[str] = config.NA_STRINGS,
) -> Column:
    """``value`` cast to ``dtype``; the default if the column is absent, null or a "no value" text."""
    fallback = F.lit(default).cast(dtype)
    if value is None:
        return fallback
    missing = value.isNull() | value.cast("string").isin(*na_values)
    return F.when(missing, fallback).otherwise(value.try_cast(dtype))


def interleaved(left: Column, right: Column) -> Column:
    """Alternate the elements of two arrays and append what the longer one has left."""
    shared = F.least(F.size(left), F.size(right))
    pairs = F.arrays_zip(
        F.slice(left, F.lit(1), shared).alias("l"), F.slice(right, F.lit(1), shared).alias("r")
    )
    mixed = F.flatten(F.transform(pairs, lambda p: F.array(p["l"], p["r"])))
    tail_of = lambda items: F.slice(items, shared + 1, F.size(items) - shared)
    return F.concat(mixed, tail_of(left), tail_of(right))
