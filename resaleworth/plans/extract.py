"""The sales extract: one row per paid booking of a sold listing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from resaleworth import config
from resaleworth.functions.scalars import days_between, flag_or_zero, listed_long_enough
from resaleworth.sources.tables import ListingTables

# Order of the bookings of one listing; the last one gives the sale.
SALE_ORDER = ("booking_created_at", "booking_id")


def sold_bikes(tables: ListingTables) -> DataFrame:
    """Sold listings with size and template details. Both joins come before the bookings fan out."""
    bikes = tables.bikes.where(F.col("status") == config.SOLD_LISTING_STATUS)
    infos = tables.bike_additional_infos.withColumnRenamed("bike_id", "info_bike_id")
    templates = tables.bike_template_additional_infos.withColumnRenamed("bike_template_id", "info_template_id")
    return (
        bikes.join(infos, F.col("id") == F.col("info_bike_id"))
        .join(templates, F.col("bike_template_id") == F.col("info_template_id"), "left")
        .drop("info_bike_id", "info_template_id", "status")
    )


def paid_bookings(tables: ListingTables) -> DataFrame:
    paid = tables.bookings.where(F.col("status").isin(*config.SOLD_BOOKING_STATUSES)).select(
        F.col("id").alias("booking_id"), F.col("bike_id"), F.col("created_at").alias("booking_created_at")
    )
    return paid.join(tables.booking_accountings, "booking_id")


def sales_extract(tables: ListingTables) -> DataFrame:
    """All columns of the training query plus the two that order the bookings of a listing.

    Bookings meet their accounting on the booking key first, so the wide listing rows move once,
    on the listing id, which is also the key of the later dedup.
    """
    joined = sold_bikes(tables).join(paid_bookings(tables), F.col("id") == F.col("bike_id"))
    created = F.col("created_at")
    return joined.select(
        "id",
        F.col("bike_template_id").alias("template_id"),
        F.col("bike_price_currency").alias("sales_price"),
        "msrp",
        created.alias("bike_created_at"),
        F.year(created).cast("bigint").alias("bike_created_at_year"),
        F.month(created).cast("bigint").alias("bike_created_at_month"),
        F.col("year").alias("bike_year"),
        days_between(F.col("booking_created_at"), created).alias("sales_duration"),
        F.col("country_id").alias("sales_country_id"),
        "bike_type_id",
        "bike_category_id",
        "mileage_code",
        "motor",
        "condition_code",
        "rider_height_min",
        "rider_height_max",
        "brake_type_code",
        "frame_material_code",
        "shifting_code",
        "bike_component_id",
        "color",
        "family_model_id",
        "family_id",
        "brand_id",
        "is_mobile",
        flag_or_zero(F.col("is_ebike")).alias("is_ebike"),
        flag_or_zero(F.col("is_frameset")).alias("is_frameset"),
        *SALE_ORDER,
    )


def aged_bookings_extract(tables: ListingTables, as_of: dt.date, months: int = 2) -> DataFrame:
    """Bookings of listings at least ``months`` complete months old, paid or not, with the price they were booked at."""
    bikes = tables.bikes.where(
        listed_long_enough(F.col("created_at"), F.lit(as_of).cast("timestamp"), months)
    ).select("id", F.col("bike_template_id").alias("template_id"), "msrp", "created_at")
    bookings = tables.bookings.select(F.col("id").alias("booking_id"), "bike_id", "bike_price")
    return bikes.join(bookings, F.col("id") == F.col("bike_id")).select(
        "id",
        "booking_id",
        "template_id",
        F.col("bike_price").alias("sales_price"),
        "msrp",
        F.year("created_at").cast("bigint").alias("bike_created_at_year"),
        F.month("created_at").cast("bigint").alias("bike_created_at_month"),
    )
