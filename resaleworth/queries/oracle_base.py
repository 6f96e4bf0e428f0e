"""Shared WITH clauses of the check SQL."""

from __future__ import annotations

LISTINGS = """
bikes AS (
  SELECT o_orderkey AS id, o_orderkey % (SELECT max(p_partkey) * 5 // 4 FROM part) AS bike_template_id, o_totalprice / 18 AS msrp,
    o_orderdate + INTERVAL 276 MONTH AS created_at,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 1800
         ELSE CAST(1990 + p_size AS BIGINT) END AS year,
    CAST(c_nationkey AS BIGINT) AS country_id, 1 + o_orderkey % 2 AS bike_type_id,
    CASE WHEN o_orderkey % 13 <> 0 THEN 1 + o_custkey % 9 END AS bike_category_id,
    CASE o_orderkey % 7 WHEN 0 THEN '0km' WHEN 1 THEN 'less_than_500' WHEN 2 THEN '500_3000'
         WHEN 3 THEN '3000_10000' WHEN 4 THEN 'more_than_10000' WHEN 6 THEN 'None' END AS mileage_code,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 3 % 2 END AS motor,
    CASE WHEN o_orderkey % 19 = 0 THEN 'n/a' ELSE substr(o_orderpriority, 1, 1) END AS condition_code,
    CASE WHEN o_orderkey % 5 <> 0 THEN lower(p_type) END AS brake_type_code,
    CASE WHEN o_orderkey % 23 = 0 THEN 'None' ELSE split_part(p_name, ' ', 2) END AS frame_material_code,
    CASE o_orderkey % 4 WHEN 0 THEN 'electronic' WHEN 1 THEN 'mechanical' END AS shifting_code,
    o_orderkey % 72 AS bike_component_id, split_part(p_name, ' ', 1) AS color,
    o_custkey AS family_model_id, o_custkey % 100 AS family_id,
    CAST(substr(p_brand, 7) AS BIGINT) AS brand_id, o_orderkey % 2 AS is_mobile,
    CASE WHEN o_orderstatus = 'P' THEN 'active' ELSE 'sold' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON p_partkey = o_orderkey % (SELECT max(p_partkey) * 5 // 4 FROM part)
),
lines AS (
  SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CAST(round(l_extendedprice * 100) AS BIGINT)) AS line_key FROM lineitem
),
bookings AS (
  SELECT line_key AS id, l_orderkey AS bike_id, l_shipdate + INTERVAL 276 MONTH AS created_at,
    CASE l_returnflag WHEN 'A' THEN 'paid_out' WHEN 'R' THEN 'success' WHEN 'N' THEN 'cancelled' END AS status,
    l_extendedprice * (1 - l_discount) / 6 AS bike_price
  FROM lines
),
booking_accountings AS (
  SELECT line_key AS booking_id, l_extendedprice / 6 AS bike_price_currency FROM lines
),
template_infos AS (
  SELECT p_partkey AS bike_template_id, CAST(p_size AS BIGINT) % 2 AS is_ebike,
    CASE WHEN p_size % 10 = 0 THEN CAST(1 AS BIGINT) WHEN p_size % 10 = 1 THEN NULL ELSE CAST(0 AS BIGINT) END AS is_frameset
  FROM part
),
bike_infos AS (
  SELECT o_orderkey AS bike_id,
    CASE WHEN o_orderkey % 7 <> 0 THEN 150.0::DOUBLE + o_orderkey % 30 END AS rider_height_min,
    CASE WHEN o_orderkey % 9 <> 0 THEN 170.0::DOUBLE + o_orderkey % 30 END AS rider_height_max
  FROM orders WHERE o_orderkey % 20 <> 0
)"""

EXTRACT = (
    LISTINGS
    + """,
extract AS (
  SELECT b.id, b.bike_template_id AS template_id, a.bike_price_currency AS sales_price, b.msrp,
    b.created_at AS bike_created_at, year(b.created_at) AS bike_created_at_year,
    month(b.created_at) AS bike_created_at_month, b.year AS bike_year,
    datediff('day', b.created_at, k.created_at) AS sales_duration, b.country_id AS sales_country_id,
    b.bike_type_id, b.bike_category_id, b.mileage_code, b.motor, b.condition_code,
    i.rider_height_min, i.rider_height_max, b.brake_type_code, b.frame_material_code, b.shifting_code,
    b.bike_component_id, b.color, b.family_model_id, b.family_id, b.brand_id, b.is_mobile,
    coalesce(t.is_ebike, 0) AS is_ebike, coalesce(t.is_frameset, 0) AS is_frameset,
    k.created_at AS booking_created_at, k.id AS booking_id
  FROM bikes b JOIN bookings k ON b.id = k.bike_id JOIN booking_accountings a ON k.id = a.booking_id
    LEFT JOIN template_infos t ON b.bike_template_id = t.bike_template_id
    JOIN bike_infos i ON b.id = i.bike_id
  WHERE b.status = 'sold' AND k.status IN ('paid_out', 'success', 'sell_link_confirm', 'capture', 'paid')
)"""
)

RATES = """
rates(year, rate) AS (VALUES (2012, 2.6::DOUBLE), (2013, 1.3), (2014, 0.4), (2015, 0.1), (2016, 0.2), (2017, 1.6),
  (2018, 1.8), (2019, 1.4), (2020, 0.7), (2021, 2.9), (2022, 9.2), (2023, 6.4)),
factors AS (
  SELECT year, product(1 + rate / 100) OVER (ORDER BY year DESC ROWS UNBOUNDED PRECEDING) AS factor FROM rates
  UNION ALL SELECT 2024, 1.0
)"""

PLAUSIBLE = """
plausible AS (
  SELECT * FROM extract
  WHERE sales_price > 200 AND sales_price < 25000 AND msrp IS NOT NULL AND msrp >= 250 AND msrp <= 25000
    AND sales_price > msrp * 0.3::DOUBLE
),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY booking_created_at DESC, booking_id DESC) AS rn
    FROM plausible) WHERE rn = 1
)"""

CLEAN = (
    EXTRACT
    + ","
    + RATES
    + ","
    + PLAUSIBLE
    + """,
clean AS (
  SELECT latest.* REPLACE (sales_price * factor AS sales_price)
  FROM latest LEFT JOIN factors ON factors.year = latest.bike_created_at_year
)"""
)

FEATURES = (
    CLEAN
    + """,
repaired AS (
  SELECT *, CASE WHEN bike_year IS NULL OR bike_year < 1900 OR bike_year > 2024 THEN 2018 ELSE bike_year END AS model_year
  FROM clean
),
lifted AS (
  SELECT repaired.*, nullif(msrp, 0) * factor AS list_price
  FROM repaired LEFT JOIN factors ON factors.year = greatest(model_year, 2020)
),
derived AS (
  SELECT id, nullif(brake_type_code, 'None') AS brake_type_code, nullif(frame_material_code, 'None') AS frame_material_code,
    nullif(shifting_code, 'None') AS shifting_code, nullif(color, 'None') AS color,
    nullif(bike_category_id, 0) AS bike_category_id, nullif(motor, 0) AS motor,
    nullif(sales_country_id, 0) AS sales_country_id, nullif(bike_created_at_month, 0) AS bike_created_at_month,
    nullif(CASE WHEN list_price > 0 THEN ln(list_price) END, 0) AS msrp,
    nullif(CASE WHEN regexp_full_match(condition_code, '[0-9]+') THEN CAST(condition_code AS DOUBLE) END, 0) AS condition_code,
    nullif(bike_created_at_year, 0) AS bike_created_at_year,
    nullif(rider_height_min, 0) AS rider_height_min, nullif(rider_height_max, 0) AS rider_height_max,
    nullif(sales_duration, 0) AS sales_duration, nullif(is_mobile, 0) AS is_mobile, nullif(is_ebike, 0) AS is_ebike,
    nullif(is_frameset, 0) AS is_frameset,
    CASE mileage_code WHEN 'None' THEN NULL WHEN '0km' THEN 1.0::DOUBLE WHEN 'less_than_500' THEN 2 WHEN '500_3000' THEN 3
      WHEN '3000_10000' THEN 4 WHEN 'more_than_10000' THEN 5 ELSE -1 END AS mileage_code,
    nullif(bike_type_id, 0) AS bike_type_id, nullif(bike_component_id, 0) AS bike_component_id,
    nullif(family_model_id, 0) AS family_model_id, nullif(family_id, 0) AS family_id, nullif(brand_id, 0) AS brand_id,
    sin(2 * pi() * bike_created_at_month / 12) AS bike_created_at_month_sin,
    cos(2 * pi() * bike_created_at_month / 12) AS bike_created_at_month_cos,
    nullif(bike_created_at_year - model_year, 0) AS bike_age, sales_price, bike_created_at
  FROM lifted
),
split_rows AS (
  SELECT *, CASE WHEN CAST('0x' || substr(md5('21' || id::VARCHAR), 1, 8) AS BIGINT) % 10000 < 1200
    THEN 'test' ELSE 'train' END AS split
  FROM derived WHERE sales_price IS NOT NULL
),
train_rows AS (
  SELECT s.*, g.copy_no FROM split_rows s
  JOIN (VALUES (0), (1), (2), (3)) AS g(copy_no)
    ON g.copy_no = 0 OR (s.split = 'train' AND s.bike_created_at >= TIMESTAMP '2024-07-03')
  WHERE s.split = 'train'
)"""
)

RESULTS = (
    CLEAN
    + """,
priced AS (
  SELECT id, sales_price, round_even(msrp * 0.5::DOUBLE * 0.9::DOUBLE / 10, 0) * 10 AS prediction FROM clean
),
results AS (
  SELECT id, sales_price, prediction, round_even(prediction * 0.95::DOUBLE / 10, 0) * 10 AS low,
    round_even(prediction * 1.05::DOUBLE / 10, 0) * 10 AS high
  FROM priced
),
flagged AS (
  SELECT *, CASE WHEN sales_price BETWEEN low AND high THEN 1 ELSE 0 END AS in_range FROM results
),
errors AS (
  SELECT *, sales_price - prediction AS difference, (sales_price - prediction) / nullif(sales_price, 0) * 100 AS difference_pct
  FROM flagged
),
binned AS (
  SELECT *, CASE WHEN difference_pct <= -100 THEN 'Overestimate <-100%' WHEN difference_pct <= -50 THEN '-100% to -50%'
    WHEN difference_pct <= -20 THEN '-50% to -20%' WHEN difference_pct <= -10 THEN '-20% to -10%'
    WHEN difference_pct <= 0 THEN '-10% to 0%' WHEN difference_pct <= 10 THEN '0% to 10%'
    WHEN difference_pct <= 20 THEN '10% to 20%' WHEN difference_pct <= 50 THEN '20% to 50%'
    WHEN difference_pct <= 100 THEN '50% to 100%' WHEN difference_pct > 100 THEN 'Underestimate >100%' END AS difference_bin
  FROM errors
)"""
)
