"""The five listing tables as views over the order and part tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from resaleworth.sources.tables import ListingTables


def _shifted(column: str):
    return (F.col(column) + F.expr("INTERVAL 276 MONTHS")).cast("timestamp")


def _booking_key():
    return F.concat_ws(
        "-",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("bigint"),
    )


def _bikes(orders: DataFrame, customer: DataFrame, part: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    # A fifth of the template ids has no part, so the left join misses at any scale.
    last = part.agg(F.max("p_partkey")).first()[0] or 0
    template = key % max(last * 5 // 4, 1)
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("p_partkey") == template, "left")
    mileage = key % 7
    return joined.select(
        key.alias("id"),
        template.alias("bike_template_id"),
        (F.col("o_totalprice") / 18).alias("msrp"),
        _shifted("o_orderdate").alias("created_at"),
        F.when(key % 11 == 0, None)
        .when(key % 97 == 0, F.lit(1800))
        .otherwise(F.col("p_size") + 1990)
        .cast("bigint")
        .alias("year"),
        F.col("c_nationkey").cast("bigint").alias("country_id"),
        (key % 2 + 1).alias("bike_type_id"),
        F.when(key % 13 != 0, F.col("o_custkey") % 9 + 1).alias("bike_category_id"),
        F.when(mileage == 0, "0km")
        .when(mileage == 1, "less_than_500")
        .when(mileage == 2, "500_3000")
        .when(mileage == 3, "3000_10000")
        .when(mileage == 4, "more_than_10000")
        .when(mileage == 6, "None")
        .alias("mileage_code"),
        F.when(key % 17 != 0, key % 3 % 2).alias("motor"),
        F.when(key % 19 == 0, "n/a").otherwise(F.substring("o_orderpriority", 1, 1)).alias("condition_code"),
        F.when(key % 5 != 0, F.lower("p_type")).alias("brake_type_code"),
        F.when(key % 23 == 0, "None")
        .otherwise(F.split_part("p_name", F.lit(" "), F.lit(2)))
        .alias("frame_material_code"),
        F.when(key % 4 == 0, "electronic").when(key % 4 == 1, "mechanical").alias("shifting_code"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("color"),
        (key % 72).alias("bike_component_id"),
        F.col("o_custkey").alias("family_model_id"),
        (F.col("o_custkey") % 100).alias("family_id"),
        F.substring("p_brand", 7, 10).cast("bigint").alias("brand_id"),
        (key % 2).alias("is_mobile"),
        F.when(F.col("o_orderstatus") == "P", "active").otherwise("sold").alias("status"),
    )


def _bookings(lineitem: DataFrame) -> DataFrame:
    flag = F.col("l_returnflag")
    return lineitem.select(
        _booking_key().alias("id"),
        F.col("l_orderkey").alias("bike_id"),
        _shifted("l_shipdate").alias("created_at"),
        F.when(flag == "A", "paid_out").when(flag == "R", "success").when(flag == "N", "cancelled").alias("status"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 6).alias("bike_price"),
    )


def _accountings(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        _booking_key().alias("booking_id"), (F.col("l_extendedprice") / 6).alias("bike_price_currency")
    )


def _template_infos(part: DataFrame) -> DataFrame:
    size = F.col("p_size").cast("bigint")
    return part.select(
        F.col("p_partkey").alias("bike_template_id"),
        (size % 2).alias("is_ebike"),
        F.when(size % 10 == 0, F.lit(1)).when(size % 10 != 1, F.lit(0)).cast("bigint").alias("is_frameset"),
    )


def _bike_infos(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.where(key % 20 != 0).select(
        key.alias("bike_id"),
        F.when(key % 7 != 0, key % 30 + F.lit(150.0)).alias("rider_height_min"),
        F.when(key % 9 != 0, key % 30 + F.lit(170.0)).alias("rider_height_max"),
    )


def listing_tables(spark: SparkSession, sf_dir: str) -> ListingTables:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders, lineitem, part = read("orders"), read("lineitem"), read("part")
    return ListingTables(
        bikes=_bikes(orders, read("customer"), part),
        bookings=_bookings(lineitem),
        booking_accountings=_accountings(lineitem),
        bike_template_additional_infos=_template_infos(part),
        bike_additional_infos=_bike_infos(orders),
    )
