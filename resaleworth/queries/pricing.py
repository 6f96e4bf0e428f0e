"""Price rounding, list-price rule and routing queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from resaleworth.functions import prices as P
from resaleworth.operators import pricing as pr
from resaleworth.plans.scoring import in_request_order, price_rule_rows
from resaleworth.queries import frames, oracle_base as sql
from resaleworth.queries.registry import Registry
from resaleworth.session import materialise
from resaleworth.sources import requests as req
from resaleworth.sources.inflation import inflation_factors

query = Registry()

_TENS = "round_even({} / 10, 0) * 10"
_LOW = _TENS.format("price * 0.95::DOUBLE")
_HIGH = _TENS.format("price * 1.05::DOUBLE")
_CENTS = "(floor({v}) * 100 + round_even(({v} - floor({v})) * 100, 0)) / 100"
_PRICED = "SELECT *, {low} AS low, {high} AS high FROM ({rows})"


def _with_interval(rows: str) -> str:
    return _PRICED.format(low=_LOW, high=_HIGH, rows=rows)


def _stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the list price in place of a model's prediction."""
    bikes = frames.tables(spark, sf_dir).bikes
    return bikes.select("id", "msrp", F.col("year").alias("bike_year"), (F.col("msrp") * 0.5).alias("prediction"))


_MODEL_PRICE = _TENS.format("msrp * 0.5::DOUBLE * 0.9::DOUBLE")
_RULE_YEAR = "least(greatest(coalesce(b.year, 2020), 2020), 2024)"
_RULE_PRICE = _TENS.format("msrp * factor * 0.5::DOUBLE * 0.9::DOUBLE")
_IS_RULE = "(msrp > 0 AND msrp <= 250) OR msrp >= 25000"
_BOTH = (
    f"WITH {sql.LISTINGS}, {sql.RATES}, both_prices AS (SELECT b.id, b.msrp, {_MODEL_PRICE} AS model_price,"
    f" {_RULE_PRICE} AS rule_price, coalesce({_IS_RULE}, false) AS by_rule"
    f" FROM bikes b LEFT JOIN factors f ON f.year = {_RULE_YEAR})"
)


@query(f"WITH {sql.LISTINGS} {_with_interval(f'SELECT id, {_MODEL_PRICE} AS price FROM bikes')}")
def quantile_price_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = _stand_in(spark, sf_dir).select("id", P.adjusted_price(F.col("prediction")).alias("price"))
    return pr.with_interval(priced)


@query(
    f"WITH {sql.LISTINGS} SELECT id, price, {_CENTS.format(v='(price - 0.025::DOUBLE * price)')} AS low,"
    f" {_CENTS.format(v='(price + 0.025::DOUBLE * price)')} AS high"
    f" FROM (SELECT id, {_CENTS.format(v='(msrp * 0.5::DOUBLE)')} AS price FROM bikes)"
)
def point_price_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.price_by_point(_stand_in(spark, sf_dir)).select("id", "price", "low", "high")


@query(
    f"{_BOTH} {_with_interval('SELECT id, rule_price AS price FROM both_prices')}"
)
def list_price_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stand_in(spark, sf_dir).drop("prediction")
    return pr.price_by_rule(rows, inflation_factors(spark), frames.AS_OF).select("id", "price", "low", "high")


@query(
    f"{_BOTH} SELECT id, CASE WHEN by_rule THEN 'rule' ELSE 'model' END AS route,"
    " CASE WHEN by_rule THEN rule_price ELSE model_price END AS price FROM both_prices"
)
def routed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stand_in(spark, sf_dir).withColumn("model_price", P.adjusted_price(F.col("prediction")))
    both = pr.price_by_rule(rows, inflation_factors(spark), frames.AS_OF).withColumnRenamed("price", "rule_price")
    route = F.when(P.takes_rule(F.col("msrp")), "rule").otherwise("model")
    return both.select("id", route.alias("route"), pr.routed_price("msrp", "rule_price", "model_price").alias("price"))


@query(
    f"{_BOTH}, routed AS (SELECT id, CASE WHEN by_rule THEN rule_price ELSE model_price END AS price FROM both_prices)"
    f" SELECT id, price, [low, high] AS \"interval\" FROM ({_with_interval('SELECT * FROM routed')})"
)
def price_interval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and interval zipped per branch, chosen as one value, unzipped at the end."""
    rows = _stand_in(spark, sf_dir).withColumn("model_price", P.adjusted_price(F.col("prediction")))
    factored = pr.rule_factors(rows, inflation_factors(spark), frames.AS_OF)

    def pair(price):
        return F.struct(price.alias("price"), P.interval(P.interval_low(price), P.interval_high(price)).alias("interval"))

    by_rule = pair(P.rule_price(F.col("msrp"), F.col("rule_factor")))
    chosen = F.when(P.takes_rule(F.col("msrp")), by_rule).otherwise(pair(F.col("model_price")))
    return factored.select("id", chosen.alias("s")).select("id", "s.*")


_RULE_ROWS = f"SELECT id AS payload_id, CAST(0 AS BIGINT) AS request_pos, id AS bike_id, 'rule' AS route, {_RULE_PRICE} AS price"


@query(
    f"WITH {sql.LISTINGS}, {sql.RATES}, sent AS (SELECT id, year, CASE id % 10 WHEN 0 THEN floor(msrp)"
    " WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0 WHEN 3 THEN NULL ELSE msrp END AS msrp FROM bikes WHERE id % 50 NOT IN (7, 8, 9))"
    f" {_with_interval(f'{_RULE_ROWS} FROM sent b LEFT JOIN factors f ON f.year = {_RULE_YEAR} WHERE {_IS_RULE}')}"
)
def scored_rule_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that the list-price rule answers, in request order."""
    payloads = frames.request_payloads(frames.tables(spark, sf_dir).bikes)
    rows = req.conform(req.accepted(req.parse_requests(payloads)), keys=("payload_id", "request_pos"))
    by_rule = rows.where(P.takes_rule(F.col("msrp")))
    scored = price_rule_rows(by_rule, inflation_factors(spark), frames.AS_OF, ("payload_id", "request_pos"))
    return in_request_order(materialise(scored, "scored")).drop("interval", "q_low", "q_mid", "q_high")
