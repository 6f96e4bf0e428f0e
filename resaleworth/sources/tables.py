"""The five listing tables: read from files or a database, typed at the source."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

# Columns and types of the source tables.
BIKES = {
    "id": "bigint",
    "bike_template_id": "bigint",
    "msrp": "double",
    "created_at": "timestamp",
    "year": "bigint",
    "country_id": "bigint",
    "bike_type_id": "bigint",
    "bike_category_id": "bigint",
    "mileage_code": "string",
    "motor": "bigint",
    "condition_code": "string",
    "brake_type_code": "string",
    "frame_material_code": "string",
    "shifting_code": "string",
    "bike_component_id": "bigint",
    "color": "string",
    "family_model_id": "bigint",
    "family_id": "bigint",
    "brand_id": "bigint",
    "is_mobile": "bigint",
    "status": "string",
}
BOOKINGS = {"id": "bigint", "bike_id": "bigint", "created_at": "timestamp", "status": "string", "bike_price": "double"}
BOOKING_ACCOUNTINGS = {"booking_id": "bigint", "bike_price_currency": "double"}
TEMPLATE_INFOS = {"bike_template_id": "bigint", "is_ebike": "bigint", "is_frameset": "bigint"}
BIKE_INFOS = {"bike_id": "bigint", "rider_height_min": "double", "rider_height_max": "double"}

SCHEMAS = {
    "bikes": BIKES,
    "bookings": BOOKINGS,
    "booking_accountings": BOOKING_ACCOUNTINGS,
    "bike_template_additional_infos": TEMPLATE_INFOS,
    "bike_additional_infos": BIKE_INFOS,
}


@dataclass(frozen=True)
class ListingTables:
    bikes: DataFrame
    bookings: DataFrame
    booking_accountings: DataFrame
    bike_template_additional_infos: DataFrame
    bike_additional_infos: DataFrame


# Their bounds reach the scan only if nothing wraps them; NaN is above every upper bound and falls out there.
BOUNDED = {"msrp", "bike_price_currency"}


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Keep the declared columns with the declared types; NaN becomes null but in the bounded prices."""

    def column(name: str, dtype: str):
        value = F.col(name).cast(dtype)
        return F.nanvl(value, F.lit(None)) if dtype in ("double", "float") and name not in BOUNDED else value

    return df.select(*[column(name, dtype).alias(name) for name, dtype in types.items()])


def read_tables(spark: SparkSession, root: str) -> ListingTables:
    """One parquet folder per table below ``root``."""
    return ListingTables(
        **{name: typed(spark.read.parquet(f"{root}/{name}"), types) for name, types in SCHEMAS.items()}
    )


def read_jdbc_tables(
    spark: SparkSession,
    url: str,
    key_ranges: Mapping[str, tuple[int, int]],
    num_partitions: int = 64,
    properties: Mapping[str, str] | None = None,
    fetch_size: int = 10_000,
) -> ListingTables:
    """Parallel range reads per table; the joins run in Spark, the status filters reach the database.

    ``key_ranges`` gives the lowest and highest key per table, so that each task reads one range.
    """
    keys = {
        "bikes": "id",
        "bookings": "id",
        "booking_accountings": "booking_id",
        "bike_template_additional_infos": "bike_template_id",
        "bike_additional_infos": "bike_id",
    }
    options = {"fetchsize": str(fetch_size), **(properties or {})}
    frames = {}
    for name, types in SCHEMAS.items():
        low, high = key_ranges[name]
        raw = spark.read.jdbc(
            url,
            name,
            column=keys[name],
            lowerBound=low,
            upperBound=high,
            numPartitions=num_partitions,
            properties=options,
        )
        frames[name] = typed(raw, types)
    return ListingTables(**frames)
