"""Feature, split and request-field queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from resaleworth import config
from resaleworth.functions import scalars as S
from resaleworth.operators import evaluate as ev, features as feat, sampling
from resaleworth.operators.clean import lift_to_base_year
from resaleworth.operators.ranking import with_row_number
from resaleworth.queries import frames, oracle_base as sql
from resaleworth.queries.registry import Registry
from resaleworth.sources import requests as req
from resaleworth.sources.inflation import inflation_factors

query = Registry()


def _bikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.tables(spark, sf_dir).bikes


_PERIOD = "CASE WHEN id % 5 <> 0 THEN year(created_at) END AS y, CASE WHEN id % 7 <> 0 THEN month(created_at) END AS m"


@query(
    f"WITH {sql.LISTINGS} SELECT id, coalesce(y, 2024) AS created_year, coalesce(m, 9) AS created_month"
    f" FROM (SELECT id, {_PERIOD} FROM bikes)"
)
def period_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    rows = _bikes(spark, sf_dir).select(
        "id",
        F.when(key % 5 != 0, F.year("created_at")).alias("y"),
        F.when(key % 7 != 0, F.month("created_at")).alias("m"),
    )
    return rows.select(
        "id",
        S.year_or_current(F.col("y"), frames.AS_OF).alias("created_year"),
        S.month_or_current(F.col("m"), frames.AS_OF).alias("created_month"),
    )


@query(
    f"WITH {sql.LISTINGS} SELECT id, round(sin(2 * pi() * month(created_at) / 12), 6) + 0.0 AS month_sin,"
    " round(cos(2 * pi() * month(created_at) / 12), 6) + 0.0 AS month_cos FROM bikes"
)
def month_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.month("created_at")
    # Adding 0 turns -0.0 into 0.0.
    return _bikes(spark, sf_dir).select(
        "id",
        (F.round(S.month_sin(month), 6) + 0.0).alias("month_sin"),
        (F.round(S.month_cos(month), 6) + 0.0).alias("month_cos"),
    )


_REPAIRED = "CASE WHEN year IS NULL OR year < 1900 OR year > 2024 THEN 2018 ELSE year END"


@query(
    f"WITH {sql.LISTINGS} SELECT id, {_REPAIRED} AS model_year, greatest({_REPAIRED}, 2020) AS price_year FROM bikes"
)
def model_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = S.repaired_model_year(F.col("year"), frames.AS_OF)
    return _bikes(spark, sf_dir).select(
        "id", repaired.alias("model_year"), S.floored_model_year(repaired).alias("price_year")
    )


@query(
    f"WITH {sql.LISTINGS}, {sql.RATES}, v AS (SELECT id, CASE WHEN id % 6 = 0 THEN 0 ELSE msrp END AS msrp,"
    f" greatest({_REPAIRED}, 2020) AS price_year FROM bikes)"
    " SELECT id, round(nullif(msrp, 0) * factor, 6) AS list_price,"
    " round(CASE WHEN nullif(msrp, 0) * factor > 0 THEN ln(nullif(msrp, 0) * factor) END, 6) AS log_list_price"
    " FROM v LEFT JOIN factors f ON f.year = v.price_year"
)
def list_price_in_base_year_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = S.floored_model_year(S.repaired_model_year(F.col("year"), frames.AS_OF))
    price = F.when(F.col("id") % 6 == 0, F.lit(0.0)).otherwise(F.col("msrp"))
    rows = _bikes(spark, sf_dir).select(
        "id", S.zero_to_null(price).alias("list_price"), year.alias("price_year")
    )
    lifted = lift_to_base_year(rows, "list_price", F.col("price_year"), inflation_factors(spark))
    return lifted.select(
        "id",
        F.round("list_price", 6).alias("list_price"),
        F.round(S.guarded_log(F.col("list_price")), 6).alias("log_list_price"),
    )


@query(f"WITH {sql.LISTINGS} SELECT id, year(created_at) - {_REPAIRED} AS bike_age FROM bikes")
def listing_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = S.repaired_model_year(F.col("year"), frames.AS_OF)
    return _bikes(spark, sf_dir).select("id", (F.year("created_at") - repaired).alias("bike_age"))


@query(
    f"WITH {sql.LISTINGS}, v AS (SELECT id, CASE WHEN id % 29 = 0 THEN '2500' WHEN id % 31 = 0 THEN 'unknown'"
    " ELSE mileage_code END AS code FROM bikes)"
    " SELECT id, CASE WHEN code IS NULL THEN -1.0::DOUBLE WHEN code = '0km' THEN 1 WHEN code = 'less_than_500' THEN 2"
    " WHEN code = '500_3000' THEN 3 WHEN code = '3000_10000' THEN 4 WHEN code = 'more_than_10000' THEN 5"
    " WHEN code = '2500' THEN 2500 END AS mileage FROM v"
)
def mileage_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    code = F.when(key % 29 == 0, "2500").when(key % 31 == 0, "unknown").otherwise(F.col("mileage_code"))
    return _bikes(spark, sf_dir).select("id", S.mileage_ordinal(code).alias("mileage"))


@query(
    f"WITH {sql.LISTINGS} SELECT id, CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 12.5::DOUBLE"
    " WHEN 3 THEN -3 ELSE TRY_CAST(condition_code AS DOUBLE) END AS condition FROM bikes"
)
def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    text = (
        F.when(key % 6 == 0, "nan")
        .when(key % 6 == 1, "7d")
        .when(key % 6 == 2, " 12.5 ")
        .when(key % 6 == 3, "-3")
        .otherwise(F.col("condition_code"))
    )
    return _bikes(spark, sf_dir).select("id", S.number_or_null(text).alias("condition"))


@query(
    f"WITH {sql.LISTINGS} SELECT id, nullif(mileage_code, 'None') AS mileage_code, nullif(frame_material_code, 'None')"
    " AS frame_material_code, nullif(motor, 0) AS motor, nullif(is_mobile, 0) AS is_mobile,"
    " nullif(family_id, 0) AS family_id, nullif(CASE WHEN id % 6 = 0 THEN 0 ELSE msrp END, 0) AS msrp FROM bikes"
)
def sentinels_as_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bikes(spark, sf_dir).select(
        "id",
        "mileage_code",
        "frame_material_code",
        "motor",
        "is_mobile",
        "family_id",
        F.when(F.col("id") % 6 == 0, F.lit(0.0)).otherwise(F.col("msrp")).alias("msrp"),
    )
    return feat.sentinels_to_null(rows)


@query(
    f"WITH {sql.LISTINGS} SELECT id, CASE WHEN id % 9 <> 0 THEN year(created_at) END AS created_year,"
    " CASE WHEN id % 9 <> 0 THEN day(created_at) END AS created_day FROM bikes"
)
def timestamps_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("id") % 9 == 0, "not a date").otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    created = S.timestamp_or_null(text)
    return _bikes(spark, sf_dir).select(
        "id", F.year(created).alias("created_year"), F.dayofmonth(created).alias("created_day")
    )


@query(
    f"WITH {sql.LISTINGS} SELECT id, CASE id % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN floor(msrp) WHEN 2 THEN 0"
    " WHEN 3 THEN 0 ELSE -5 END AS msrp FROM bikes"
)
def list_price_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, whole = F.col("id"), F.floor("msrp").cast("string")
    text = (
        F.when(key % 5 == 1, F.concat(F.lit(" "), whole))
        .when(key % 5 == 2, F.concat(whole, F.lit(".5")))
        .when(key % 5 == 3, "abc")
        .when(key % 5 == 4, "-5")
    )
    return _bikes(spark, sf_dir).select("id", S.msrp_from_text(text).alias("msrp"))


@query(
    f"WITH {sql.LISTINGS} SELECT id, CASE WHEN condition_code = 'n/a' THEN 3 ELSE CAST(condition_code AS BIGINT) END"
    " AS condition, coalesce(motor, 9) AS motor, CASE WHEN mileage_code IS NULL OR mileage_code = 'None' THEN '0km'"
    " ELSE mileage_code END AS mileage, CAST(1 AS BIGINT) AS absent FROM bikes"
)
def fields_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bikes(spark, sf_dir).select(
        "id",
        S.value_or_default(F.col("condition_code"), 3).alias("condition"),
        S.value_or_default(F.col("motor"), 9).alias("motor"),
        S.value_or_default(F.col("mileage_code"), "0km", "string").alias("mileage"),
        S.value_or_default(None, 1).alias("absent"),
    )


_LISTS = (
    "SELECT p_partkey, string_split(p_name, ' ') AS a,"
    " CASE p_partkey % 3 WHEN 0 THEN [p_type] WHEN 1 THEN [p_brand, p_type, p_brand] ELSE [p_brand, p_type] END AS b FROM part"
)


@query(
    f"WITH v AS ({_LISTS}), p AS (SELECT p_partkey, unnest(a) AS item, generate_subscripts(a, 1) AS i, 0 AS side FROM v"
    " UNION ALL SELECT p_partkey, unnest(b), generate_subscripts(b, 1), 1 FROM v)"
    " SELECT p_partkey, string_agg(item, '|' ORDER BY i, side) AS mixed FROM p GROUP BY p_partkey"
)
def interleaved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = frames.configure(spark).read.parquet(f"{sf_dir}/part.parquet")
    key, brand, kind = F.col("p_partkey"), F.col("p_brand"), F.col("p_type")
    second = (
        F.when(key % 3 == 0, F.array(kind)).when(key % 3 == 1, F.array(brand, kind, brand)).otherwise(F.array(brand, kind))
    )
    mixed = S.interleaved(F.split("p_name", " "), second)
    return part.select("p_partkey", F.array_join(mixed, "|").alias("mixed"))


@query(
    "WITH a AS (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS pos, 0 AS side FROM customer),"
    " b AS (SELECT s_suppkey AS key, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS pos, 1 AS side FROM supplier)"
    " SELECT side, key, row_number() OVER (ORDER BY pos, side) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"
)
def interleaved_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ordered tables dealt out in turn; each side is numbered in parallel."""
    read = frames.configure(spark).read.parquet
    customers = read(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
    suppliers = read(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("v"))
    sides = [
        with_row_number(side, ["v", "key"], "pos").withColumn("side", F.lit(number))
        for number, side in enumerate((customers, suppliers))
    ]
    # Both sides take turns until one ends, so the place follows from the own number.
    shorter = min(side.count() for side in sides)
    pos = F.col("pos")
    place = F.when(pos <= shorter, 2 * pos - 1 + F.col("side")).otherwise(pos + shorter)
    return sides[0].unionByName(sides[1]).select("side", "key", place.alias("place"))


_ROUNDED = (
    "round(msrp, 6) AS msrp, round(bike_created_at_month_sin, 6) + 0.0 AS bike_created_at_month_sin,"
    " round(bike_created_at_month_cos, 6) + 0.0 AS bike_created_at_month_cos, round(sales_price, 6) AS sales_price"
)


def _rounded(df: DataFrame) -> DataFrame:
    names = ("msrp", "bike_created_at_month_sin", "bike_created_at_month_cos", "sales_price")
    return df.withColumns({name: F.round(name, 6) + 0.0 for name in names if name in df.columns})


@query(f"WITH {sql.FEATURES} SELECT * EXCLUDE (bike_created_at) REPLACE ({_ROUNDED}) FROM derived")
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(frames.featured(spark, sf_dir).drop("bike_created_at"))


@query(
    f"WITH {sql.FEATURES} SELECT id, " + ", ".join(config.FEATURES) + f" FROM (SELECT * REPLACE ({_ROUNDED}) FROM derived)"
)
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without helper columns and label: the columns a model sees."""
    features, _ = feat.split_features_label(frames.featured(spark, sf_dir), ["id"])
    return _rounded(features.drop(*config.HELPERS))


@query(f"WITH {sql.FEATURES} SELECT id, round(sales_price, 6) AS sales_price FROM derived")
def label_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, label = feat.split_features_label(frames.featured(spark, sf_dir), ["id"])
    return _rounded(label)


@query(
    f"WITH {sql.LISTINGS} SELECT id, CAST(NULL AS BIGINT) AS bike_id, CAST(NULL AS VARCHAR) AS shifting_code, color,"
    " nullif(CASE WHEN id % 6 = 0 THEN 0 ELSE msrp END, 0) AS msrp, motor, CAST(NULL AS DOUBLE) AS rider_height_min FROM bikes"
)
def conformed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed columns only: missing ones as null, unknown ones dropped, a list price of 0 as missing."""
    price = F.when(F.col("id") % 6 == 0, F.lit(0.0)).otherwise(F.col("msrp"))
    ragged = _bikes(spark, sf_dir).select("id", "color", "motor", price.alias("msrp"), "status", "bike_template_id")
    wanted = ("bike_id", "shifting_code", "color", "msrp", "motor", "rider_height_min")
    return req.conform(ragged, {name: config.REQUEST_FIELDS[name] for name in wanted}, keys=("id",))


@query(
    f"WITH {sql.LISTINGS} SELECT id, motor, bike_category_id, brake_type_code, year FROM bikes WHERE motor IS NOT NULL"
    " AND bike_category_id IS NOT NULL AND brake_type_code IS NOT NULL AND year IS NOT NULL"
)
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.complete_rows(
        _bikes(spark, sf_dir).select("id", "motor", "bike_category_id", "brake_type_code", "year")
    )


@query(f"WITH {sql.FEATURES} SELECT id, split FROM split_rows")
def row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.split_rows(spark, sf_dir).select("id", "split")


@query(f"WITH {sql.FEATURES} SELECT split, count(*) AS rows FROM split_rows GROUP BY split")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.split_rows(spark, sf_dir).groupBy("split").agg(F.count("*").alias("rows"))


@query(
    f"WITH {sql.LISTINGS} SELECT id, strftime(created_at, '%Y-%m-%d') AS created FROM bikes"
    " WHERE created_at >= TIMESTAMP '2024-09-01' - INTERVAL 60 DAY"
)
def recent_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = sampling.is_recent(F.col("created_at"), frames.AS_OF)
    return _bikes(spark, sf_dir).where(recent).select("id", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query(f"WITH {sql.FEATURES} SELECT id, copy_no, round(sales_price, 6) AS sales_price FROM train_rows")
def oversampled_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(frames.train_rows(spark, sf_dir).select("id", "copy_no", "sales_price"))


@query(f"WITH {sql.FEATURES} SELECT id, copy_no, split FROM train_rows")
def shuffled_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.train_rows(spark, sf_dir).select("id", "copy_no", "split")
    return sampling.shuffled(rows, ["id", "copy_no"])


@query(
    f"WITH {sql.FEATURES} SELECT id, round(sales_price, 6) AS sales_price FROM split_rows WHERE split = 'test'"
    " AND CAST('0x' || substr(md5('7' || id::VARCHAR), 1, 8) AS BIGINT) % 10000 < 2000"
)
def test_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: a fifth of the test rows."""
    test = frames.split_rows(spark, sf_dir).where(F.col("split") == "test")
    return _rounded(sampling.hash_sample(test, "id", 0.2, seed=7).select("id", "sales_price"))


_PAYLOAD = """
SELECT id, CASE WHEN id % 50 = 7 THEN 'empty' WHEN id % 50 = 8 THEN 'empty' WHEN id % 50 = 9 THEN 'corrupt' ELSE 'ok' END AS payload_status,
  CASE id % 10 WHEN 0 THEN floor(msrp) WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0 WHEN 3 THEN NULL ELSE msrp END AS sent_msrp,
  year AS bike_year, condition_code
FROM bikes"""


@query(
    f"WITH {sql.LISTINGS}, v AS ({_PAYLOAD}) SELECT id AS payload_id, payload_status,"
    " CASE WHEN payload_status = 'ok' THEN CAST(0 AS BIGINT) END AS request_pos,"
    " CASE WHEN payload_status = 'ok' THEN id END AS bike_id, CASE WHEN payload_status = 'ok' THEN sent_msrp END AS msrp,"
    " CASE WHEN payload_status = 'ok' THEN bike_year END AS bike_year,"
    " CASE WHEN payload_status = 'ok' THEN condition_code END AS condition_code FROM v"
    " UNION ALL SELECT id, 'ok', 1, NULL, NULL, NULL, NULL FROM v WHERE payload_status = 'ok' AND id % 3 = 0"
)
def parsed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = frames.request_payloads(_bikes(spark, sf_dir))
    return req.parse_requests(payloads).select(
        "payload_id", "payload_status", "request_pos", "bike_id", "msrp", "bike_year", "condition_code"
    )
