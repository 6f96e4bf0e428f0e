"""Scalar and price expressions on literal rows, against plain Python."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from resaleworth.functions import prices as P, scalars as S
from resaleworth.operators.pricing import price_by_rule
from resaleworth.sources.inflation import cumulative_factors, inflation_factors, inflation_rates

AS_OF = dt.date(2024, 9, 1)
FACTORS = {2024: 1.0, 2023: 1.064, 2022: 1.161888, 2021: 1.195583, 2020: 1.203952, 2019: 1.220807, 2018: 1.242782,
           2017: 1.262666, 2016: 1.265192, 2015: 1.266457, 2014: 1.271523, 2013: 1.288052, 2012: 1.321542}


def evaluate(spark, values, dtype, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [row[0] for row in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_known_factors(spark):
    got = {row["year"]: row["inflation_factor"] for row in inflation_factors(spark).collect()}
    assert got == {year: pytest.approx(value, abs=1e-6) for year, value in FACTORS.items()}


def test_gap_in_years_is_an_error(spark):
    rates = inflation_rates(spark, {2021: 2.9, 2023: 6.4})
    with pytest.raises(Exception, match="no inflation rate"):
        cumulative_factors(rates, 2024).collect()


def test_missing_base_year_is_an_error(spark):
    with pytest.raises(Exception, match="no inflation rate"):
        cumulative_factors(inflation_rates(spark, {2021: 2.9, 2022: 9.2}), 2024).collect()


def test_model_year_repair(spark):
    years = [None, 1800, 1899, 1900, 2019, 2020, 2024, 2025, 2030]
    repaired = evaluate(spark, years, "bigint", lambda v: S.repaired_model_year(v, AS_OF))
    assert repaired == [2018, 2018, 2018, 1900, 2019, 2020, 2024, 2018, 2018]


def test_mileage(spark):
    codes = [None, "None", "0km", "less_than_500", "500_3000", "3000_10000", "more_than_10000", "17", "far"]
    assert evaluate(spark, codes, "string", S.mileage_ordinal) == [-1, None, 1, 2, 3, 4, 5, 17, None]


def test_numbers_in_text(spark):
    texts = ["3", " 3.5 ", "-2e1", "nan", "inf", "1d", "n/a", "", None, ".5", "5."]
    assert evaluate(spark, texts, "string", S.number_or_null) == [3, 3.5, -20, None, None, None, None, None, None, 0.5, 5]


def test_list_price_text(spark):
    texts = ["1200", " 1200 ", "+7", "-5", "1200.5", "abc", "", None, "99999999999999999999"]
    assert evaluate(spark, texts, "string", S.msrp_from_text) == [1200, 1200, 7, -5, 0, 0, 0, 0, 0]


def test_defaults(spark):
    texts = ["5", "n/a", "NaN", "None", "", None, "7.5"]
    assert evaluate(spark, texts, "string", lambda v: S.value_or_default(v, 1)) == [5, 1, 1, 1, 1, 1, None]
    assert evaluate(spark, texts, "string", lambda v: S.value_or_default(v, "x", "string"))[:3] == ["5", "x", "x"]


@pytest.mark.parametrize("left, right", [([1, 3], [2, 4]), ([1], [2, 4, 6]), ([1, 3, 5], [2]), ([], [2]), ([1], []), ([], [])])
def test_interleave(spark, left, right):
    both = [item for pair in zip(left, right) for item in pair]
    shared = min(len(left), len(right))
    row = spark.createDataFrame([(left, right)], "l array<int>, r array<int>")
    assert row.select(S.interleaved(F.col("l"), F.col("r"))).first()[0] == both + left[shared:] + right[shared:]


def test_complete_months(spark):
    pairs = [("2024-01-31", "2024-02-29", 0), ("2024-01-31", "2024-03-31", 2), ("2024-07-02", "2024-09-01", 1)]
    rows = spark.createDataFrame(pairs, "a string, b string, n int")
    got = rows.select(S.complete_months(F.to_timestamp("a"), F.to_timestamp("b")).alias("m"), "n").collect()
    assert [row["m"] for row in got] == [row["n"] for row in got]


def test_tens_and_cents_round_like_python(spark):
    values = [104.5 * 10, 105.0, 115.0, 125.0, 1234.56, 16.005, 2675.675, 9970.675, 1e6 + 0.125, 17.375, 0.0, None]
    tens = evaluate(spark, values, "double", P.to_tens)
    cents = evaluate(spark, values, "double", P.to_cents)
    assert tens == [None if v is None else round(v / 10) * 10 for v in values]
    assert cents == [None if v is None else round(v, 2) for v in values]


def test_error_bins_are_closed_on_the_right(spark):
    labels = evaluate(spark, [-100.0, -99.9, -10.0, 0.0, 0.1, 10.0, 100.0, 100.1, None], "double", P.error_bin)
    assert labels == ["Overestimate <-100%", "-100% to -50%", "-20% to -10%", "-10% to 0%", "0% to 10%", "0% to 10%",
                      "50% to 100%", "Underestimate >100%", None]


def rule(msrp, bike_year, ratio=0.5):
    """The rule in plain Python, with the unrounded factor table."""
    if msrp is None:
        return None, None, None
    rates = {2020: 0.7, 2021: 2.9, 2022: 9.2, 2023: 6.4}
    year = 2020 if bike_year is None or bike_year < 2020 else min(bike_year, 2024)
    factor = 1.0
    for y in range(2023, year - 1, -1):
        factor *= 1 + rates[y] / 100
    price = round(msrp * factor * ratio * (1 - 0.1) / 10) * 10
    return price, round(price * (1 - 0.05) / 10) * 10, round(price * (1 + 0.05) / 10) * 10


def test_rule_and_route(spark):
    prices = [250.0, 25000.0, 249.99, 25000.01, -5.0, 0.0, None, 1200.0]
    years = [None, 1800, 2019, 2020, 2024, 2030]
    cases = [(p, y) for p in prices for y in years]
    rows = spark.createDataFrame([(i, p, y) for i, (p, y) in enumerate(cases)], "i int, msrp double, bike_year bigint")
    priced = price_by_rule(rows, inflation_factors(spark), AS_OF).withColumn("rule", P.takes_rule(F.col("msrp")))
    for row, (msrp, year) in zip(priced.orderBy("i").collect(), cases):
        assert (row["price"], row["low"], row["high"]) == rule(msrp, year)
        assert row["rule"] == (msrp is not None and (0 < msrp <= 250 or msrp >= 25000))


def test_rule_without_a_factor_gives_null(spark):
    rows = spark.createDataFrame([(1000.0, 2030)], "msrp double, bike_year bigint")
    late = price_by_rule(rows, inflation_factors(spark), dt.date(2026, 1, 1)).first()
    assert late["price"] is None and late["low"] is None
