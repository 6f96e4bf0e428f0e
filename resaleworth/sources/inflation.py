"""Yearly inflation rates and the factor that lifts a past price to base-year money."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from resaleworth import config


def inflation_rates(spark: SparkSession, rates: Mapping[int, float] = config.INFLATION_RATES) -> DataFrame:
    """(year, inflation_rate) as a literal table, so its size is known to the planner."""
    return _literal_rows(spark, rates, "inflation_rate")


def _literal_rows(spark: SparkSession, values: Mapping[int, float], name: str) -> DataFrame:
    rows = ", ".join(f"({int(year)}, double({float(value)!r}))" for year, value in values.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(year, {name})")


def cumulative_factors(rates: DataFrame, base_year: int = config.INFLATION_BASE_YEAR) -> DataFrame:
    """(year, inflation_factor): running product of the yearly rates back from the base year, which is 1.

    One row per calendar year, so the single ordered window is over a handful of rows. A gap
    in the years is an error, since every earlier factor would be wrong.
    """
    newest_first = W.orderBy(F.desc("year"))
    past = rates.where(F.col("year") < base_year)
    step = F.lag("year", 1, base_year).over(newest_first) - F.col("year")
    product = F.product(1 + F.col("inflation_rate") / 100).over(
        newest_first.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    checked = F.when(step == 1, product).otherwise(
        F.raise_error(F.concat(F.lit("no inflation rate for the year after "), F.col("year").cast("string")))
    )
    lifted = past.select("year", checked.cast("double").alias("inflation_factor"))
    base = _literal_rows(rates.sparkSession, {base_year: 1.0}, "inflation_factor")
    return lifted.unionByName(base)


def inflation_factors(spark: SparkSession) -> DataFrame:
    return cumulative_factors(inflation_rates(spark))
