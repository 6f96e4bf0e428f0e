"""From predictions to prices: model price, list-price rule, routing."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame, functions as F

from resaleworth import config
from resaleworth.functions import prices as P
from resaleworth.operators.forest import QuantileForestModel


def rule_factors(df: DataFrame, factors: DataFrame, as_of: dt.date, bike_year: str = "bike_year") -> DataFrame:
    """Add the inflation factor of the rule's year; null where the table has no such year."""
    lookup = factors.select(F.col("year").alias("_year"), F.col("inflation_factor").alias("rule_factor"))
    year = P.rule_year(F.col(bike_year), as_of)
    return df.join(F.broadcast(lookup), year == F.col("_year"), "left").drop("_year")


def price_by_rule(
    df: DataFrame, factors: DataFrame, as_of: dt.date, ratio: float = config.RULE_RATIO
) -> DataFrame:
    """Price and interval from list price and model year alone."""
    priced = rule_factors(df, factors, as_of).withColumn(
        "price", P.rule_price(F.col("msrp"), F.col("rule_factor"), ratio)
    )
    return with_interval(priced.drop("rule_factor"))


def with_interval(df: DataFrame) -> DataFrame:
    price = F.col("price")
    return df.withColumns({"low": P.interval_low(price), "high": P.interval_high(price)})


def price_by_quantiles(predicted: DataFrame) -> DataFrame:
    """Price and interval from the median, with the raw quantiles beside them."""
    values = F.col("quantile_values")
    raw = {"q_low": F.get(values, F.lit(0)), "q_mid": F.col("prediction"), "q_high": F.get(values, F.size(values) - 1)}
    priced = predicted.withColumns(raw).withColumn("price", P.adjusted_price(F.col("prediction")))
    return with_interval(priced).drop("quantile_values")


def price_by_point(predicted: DataFrame, width: float = config.POINT_INTERVAL_RANGE) -> DataFrame:
    none = F.lit(None).cast("double")
    priced = predicted.withColumn("price", P.point_price(F.col("prediction")))
    price = F.col("price")
    return priced.withColumns(
        {"low": P.point_low(price, width), "high": P.point_high(price, width), "q_low": none, "q_mid": none, "q_high": none}
    )


def price_by_model(df: DataFrame, model: Any) -> DataFrame:
    """The interval method follows the kind of model."""
    predicted = model.transform(df)
    return price_by_quantiles(predicted) if isinstance(model, QuantileForestModel) else price_by_point(predicted)


def routed_price(msrp: str, rule_price: str, model_price: str, bounds: config.PriceBounds = config.BOUNDS):
    return F.when(P.takes_rule(F.col(msrp), bounds), F.col(rule_price)).otherwise(F.col(model_price))
