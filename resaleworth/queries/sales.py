"""Source, join, filter and cleaning queries with their check SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from resaleworth import config
from resaleworth.operators import clean
from resaleworth.plans.extract import SALE_ORDER, aged_bookings_extract
from resaleworth.queries import frames, oracle_base as sql
from resaleworth.queries.registry import Registry
from resaleworth.sources import tables as src
from resaleworth.sources.inflation import inflation_factors

query = Registry()


def _day(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


@query(
    f"WITH {sql.LISTINGS} SELECT * REPLACE (strftime(created_at, '%Y-%m-%d') AS created_at) FROM bikes"
)
def typed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    bikes = src.typed(frames.tables(spark, sf_dir).bikes, src.BIKES)
    return bikes.withColumn("created_at", _day("created_at"))


# Names of the five tables in the check SQL.
_TABLES = {"bike_template_additional_infos": "template_infos", "bike_additional_infos": "bike_infos"}


@query(
    f"WITH {sql.LISTINGS} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{column}' AS column_name, '{kind}' AS kind, count(*) AS rows, count({column}) AS filled"
        f" FROM {_TABLES.get(name, name)}"
        for name, columns in src.SCHEMAS.items()
        for column, kind in columns.items()
    )
)
def typed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five tables under their declared types: rows and filled cells of every column, one pass over each table."""
    found = []
    for name, types in src.SCHEMAS.items():
        # The keys of the test tables are texts for bookings.
        table = src.typed(getattr(frames.tables(spark, sf_dir), name), {**types, **({"id": "string"} if name == "bookings" else {}), **({"booking_id": "string"} if name == "booking_accountings" else {})})
        counts = table.agg(F.count("*").alias("rows"), *[F.count(column).alias(column) for column in types])
        each = [F.struct(F.lit(column).alias("column_name"), F.lit(kind).alias("kind"), F.col("rows"), F.col(column).alias("filled")) for column, kind in types.items()]
        found.append(counts.select(F.lit(name).alias("table_name"), F.explode(F.array(*each)).alias("c")).select("table_name", "c.*"))
    return functools.reduce(DataFrame.unionByName, found)


@query(
    f"WITH {sql.LISTINGS} SELECT k.id AS booking_id, k.bike_id, k.status AS booking_status, b.status AS bike_status"
    " FROM bikes b JOIN bookings k ON b.id = k.bike_id WHERE b.status = 'sold'"
    " AND k.status IN ('paid_out', 'success', 'sell_link_confirm', 'capture', 'paid')"
)
def sold_and_paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames.tables(spark, sf_dir)
    bikes = t.bikes.where(F.col("status") == config.SOLD_LISTING_STATUS)
    paid = t.bookings.where(F.col("status").isin(*config.SOLD_BOOKING_STATUSES))
    joined = bikes.alias("b").join(paid.alias("k"), F.col("b.id") == F.col("k.bike_id"))
    return joined.select(
        F.col("k.id").alias("booking_id"),
        "bike_id",
        F.col("k.status").alias("booking_status"),
        F.col("b.status").alias("bike_status"),
    )


@query(
    f"WITH {sql.LISTINGS} SELECT b.id, b.brand_id, k.id AS booking_id, k.status AS booking_status"
    " FROM bikes b JOIN bookings k ON b.id = k.bike_id"
)
def listing_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames.tables(spark, sf_dir)
    joined = t.bikes.alias("b").join(t.bookings.alias("k"), F.col("b.id") == F.col("k.bike_id"))
    return joined.select(
        "b.id", "b.brand_id", F.col("k.id").alias("booking_id"), F.col("k.status").alias("booking_status")
    )


@query(
    f"WITH {sql.LISTINGS} SELECT k.id AS booking_id, k.bike_id, a.bike_price_currency"
    " FROM bookings k JOIN booking_accountings a ON k.id = a.booking_id"
)
def booking_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames.tables(spark, sf_dir)
    return t.bookings.select(F.col("id").alias("booking_id"), "bike_id").join(t.booking_accountings, "booking_id")


@query(
    f"WITH {sql.LISTINGS} SELECT b.id, b.bike_template_id, t.is_ebike, t.is_frameset"
    " FROM bikes b LEFT JOIN template_infos t ON b.bike_template_id = t.bike_template_id"
)
def listing_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames.tables(spark, sf_dir)
    return t.bikes.select("id", "bike_template_id").join(t.bike_template_additional_infos, "bike_template_id", "left")


@query(
    f"WITH {sql.LISTINGS} SELECT b.id, i.rider_height_min, i.rider_height_max"
    " FROM bikes b JOIN bike_infos i ON b.id = i.bike_id"
)
def listing_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames.tables(spark, sf_dir)
    infos = t.bike_additional_infos.withColumnRenamed("bike_id", "id")
    return t.bikes.select("id").join(infos, "id")


@query(
    f"WITH {sql.EXTRACT} SELECT * REPLACE (strftime(bike_created_at, '%Y-%m-%d') AS bike_created_at,"
    " strftime(booking_created_at, '%Y-%m-%d') AS booking_created_at) FROM extract"
)
def sales_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.extract(spark, sf_dir)
    return rows.withColumns({name: _day(name) for name in ("bike_created_at", "booking_created_at")})


@query(
    f"WITH {sql.LISTINGS} SELECT b.id, k.id AS booking_id, b.bike_template_id AS template_id,"
    " round(k.bike_price, 6) AS sales_price, b.msrp, year(b.created_at) AS bike_created_at_year,"
    " month(b.created_at) AS bike_created_at_month"
    " FROM bikes b JOIN bookings k ON b.id = k.bike_id"
    " WHERE 12 * (2024 - year(b.created_at)) + (9 - month(b.created_at))"
    " - CASE WHEN day(b.created_at) > 1 OR b.created_at - date_trunc('day', b.created_at) > INTERVAL 0 SECOND"
    " THEN 1 ELSE 0 END >= 2"
)
def aged_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aged_bookings_extract(frames.tables(spark, sf_dir), frames.AS_OF)
    return rows.withColumn("sales_price", F.round("sales_price", 6))


_FILTERED = "SELECT id, booking_id, sales_price, msrp FROM extract WHERE "


def _filtered(spark: SparkSession, sf_dir: str, condition) -> DataFrame:
    return frames.extract(spark, sf_dir).where(condition).select("id", "booking_id", "sales_price", "msrp")


@query(f"WITH {sql.EXTRACT} {_FILTERED} sales_price > 200 AND sales_price < 25000")
def label_in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, clean.plausible_label())


@query(f"WITH {sql.EXTRACT} {_FILTERED} msrp IS NOT NULL AND msrp >= 250 AND msrp <= 25000")
def msrp_in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, clean.plausible_msrp())


@query(f"WITH {sql.EXTRACT} {_FILTERED} sales_price > msrp * 0.3::DOUBLE")
def share_of_msrp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, clean.plausible_share())


@query(f"WITH {sql.EXTRACT}, {sql.PLAUSIBLE} SELECT id, booking_id, sales_price, msrp FROM plausible")
def plausible_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.plausible_sales(frames.extract(spark, sf_dir)).select("id", "booking_id", "sales_price", "msrp")


@query(f"WITH {sql.EXTRACT}, {sql.PLAUSIBLE} SELECT id, booking_id, sales_price FROM latest")
def last_sale_per_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plausible = clean.plausible_sales(frames.extract(spark, sf_dir))
    return clean.last_per_key(plausible, ["id"], SALE_ORDER).select("id", "booking_id", "sales_price")


@query(
    f"WITH {sql.LISTINGS}, {sql.RATES} SELECT f.year, round(f.factor, 9) AS inflation_factor, count(b.id) AS listings"
    " FROM factors f LEFT JOIN bikes b ON year(b.created_at) = f.year GROUP BY 1, 2"
)
def inflation_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    bikes = frames.tables(spark, sf_dir).bikes
    per_year = bikes.groupBy(F.year("created_at").alias("year")).agg(F.count("*").alias("listings"))
    # Both sides have one row per calendar year.
    return inflation_factors(spark).join(F.broadcast(per_year), "year", "left").select(
        "year",
        F.round("inflation_factor", 9).alias("inflation_factor"),
        F.coalesce("listings", F.lit(0)).alias("listings"),
    )


@query(
    f"WITH {sql.EXTRACT}, {sql.RATES} SELECT e.id, e.booking_id, e.bike_created_at_year,"
    " round(e.sales_price * f.factor, 6) AS sales_price"
    " FROM extract e LEFT JOIN factors f ON f.year = e.bike_created_at_year"
)
def price_in_base_year_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.extract(spark, sf_dir).select("id", "booking_id", "bike_created_at_year", "sales_price")
    lifted = clean.lift_to_base_year(rows, "sales_price", F.col("bike_created_at_year"), inflation_factors(spark))
    return lifted.withColumn("sales_price", F.round("sales_price", 6))


@query(
    f"WITH {sql.EXTRACT} SELECT id, "
    + ", ".join(name for name in clean.training_columns() if name != "bike_created_at")
    + ", strftime(bike_created_at, '%Y-%m-%d') AS bike_created_at FROM extract"
)
def training_column_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.extract(spark, sf_dir).select("id", *clean.training_columns())
    return rows.withColumn("bike_created_at", _day("bike_created_at"))


@query(
    f"WITH {sql.CLEAN} SELECT * EXCLUDE (template_id, booking_created_at, booking_id)"
    " REPLACE (round(sales_price, 6) AS sales_price, strftime(bike_created_at, '%Y-%m-%d') AS bike_created_at) FROM clean"
)
def clean_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.cleaned(spark, sf_dir).withColumns(
        {"sales_price": F.round("sales_price", 6), "bike_created_at": _day("bike_created_at")}
    )


@query(
    f"WITH {sql.CLEAN} SELECT brand_id, count(*) AS sales, round(avg(sales_price), 4) AS avg_price,"
    " round(min(sales_price), 4) AS min_price, round(max(sales_price), 4) AS max_price FROM clean GROUP BY brand_id"
)
def brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship report: cleaned, inflation-adjusted prices per brand."""
    return (
        frames.cleaned(spark, sf_dir)
        .groupBy("brand_id")
        .agg(
            F.count("*").alias("sales"),
            F.round(F.avg("sales_price"), 4).alias("avg_price"),
            F.round(F.min("sales_price"), 4).alias("min_price"),
            F.round(F.max("sales_price"), 4).alias("max_price"),
        )
    )
