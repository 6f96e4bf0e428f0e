"""Column lists, bounds and fixed lookup values of the valuation job."""

from __future__ import annotations

from dataclasses import dataclass

LABEL = "sales_price"

# Feature names, in the order the model input is assembled.
CATEGORICAL = (
    "brake_type_code",
    "frame_material_code",
    "shifting_code",
    "color",
    "bike_category_id",
    "motor",
    "sales_country_id",
    "bike_created_at_month",
)
NUMERICAL = (
    "msrp",
    "condition_code",
    "bike_created_at_year",
    "rider_height_min",
    "rider_height_max",
    "sales_duration",
    "is_mobile",
    "is_ebike",
    "is_frameset",
    "mileage_code",
    "bike_type_id",
    "bike_component_id",
    "family_model_id",
    "family_id",
    "brand_id",
    "bike_created_at_month_sin",
    "bike_created_at_month_cos",
    "bike_age",
)
FEATURES = CATEGORICAL + NUMERICAL

# Features that the feature step computes; the extract does not deliver them.
COMPUTED = ("bike_created_at_month_sin", "bike_created_at_month_cos", "bike_age")
# Columns needed on the way (recency, model year) that are no model input.
HELPERS = ("bike_created_at", "bike_year")

# Consumer price inflation in percent per year.
INFLATION_RATES = {
    2012: 2.6,
    2013: 1.3,
    2014: 0.4,
    2015: 0.1,
    2016: 0.2,
    2017: 1.6,
    2018: 1.8,
    2019: 1.4,
    2020: 0.7,
    2021: 2.9,
    2022: 9.2,
    2023: 6.4,
}
# The year whose money all prices are expressed in (factor 1).
INFLATION_BASE_YEAR = 2024

# Mileage codes, from least to most used.
MILEAGE_ORDINALS = {
    "0km": 1,
    "less_than_500": 2,
    "500_3000": 3,
    "3000_10000": 4,
    "more_than_10000": 5,
}
MILEAGE_UNKNOWN = -1

# States of a listing and a booking that count as a sale.
SOLD_LISTING_STATUS = "sold"
SOLD_BOOKING_STATUSES = ("paid_out", "success", "sell_link_confirm", "capture", "paid")

# Texts that stand for "no value" in a request field.
NA_STRINGS = ("N/A", "NA", "na", "n/a", "NaN", "nan", "None", "NONE", "")

# Request fields and their Spark types. msrp may be a number or a text.
REQUEST_FIELDS = {
    "bike_id": "bigint",
    "brake_type_code": "string",
    "frame_material_code": "string",
    "shifting_code": "string",
    "color": "string",
    "bike_category_id": "bigint",
    "motor": "bigint",
    "sales_country_id": "bigint",
    "bike_created_at_month": "bigint",
    "msrp": "double",
    "condition_code": "string",
    "bike_created_at_year": "bigint",
    "rider_height_min": "double",
    "rider_height_max": "double",
    "sales_duration": "bigint",
    "is_mobile": "bigint",
    "is_ebike": "bigint",
    "is_frameset": "bigint",
    "mileage_code": "string",
    "bike_type_id": "bigint",
    "bike_component_id": "bigint",
    "family_model_id": "bigint",
    "family_id": "bigint",
    "brand_id": "bigint",
    "bike_year": "bigint",
}

MODEL_YEAR_DEFAULT = 2018
MODEL_YEAR_MIN = 1900
MODEL_YEAR_FLOOR = 2020

SCORING_QUANTILES = (0.2, 0.5, 0.8)
EVALUATION_QUANTILES = (0.05, 0.5, 0.95)
RULE_RATIO = 0.5
POINT_INTERVAL_RANGE = 0.05

TEST_SHARE = 0.12
SPLIT_SEED = 21
SHUFFLE_SEED = 42
RECENT_DAYS = 60
RECENT_COPIES = 3


@dataclass(frozen=True)
class PriceBounds:
    """Limits for a plausible sale; msrp bounds are inclusive, label bounds exclusive."""

    msrp_min: float = 250.0
    msrp_max: float = 25000.0
    label_min: float = 200.0
    label_max: float = 25000.0
    min_share_of_msrp: float = 0.3


BOUNDS = PriceBounds()
