"""Frames that several queries start from."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from resaleworth.functions import prices as P
from resaleworth.operators import clean, evaluate as ev, features as feat, sampling
from resaleworth.operators.forest import QuantileForest
from resaleworth.operators.pricing import with_interval
from resaleworth.plans.extract import SALE_ORDER, sales_extract
from resaleworth.plans.training import ROW_KEYS, ImputationSettings, TrainingRun, TrainingSettings, labelled_features, run_training
from resaleworth.session import configure, materialise, scratch_dir
from resaleworth.sources.inflation import inflation_factors
from resaleworth.sources.listing_views import listing_tables
from resaleworth.sources.tables import ListingTables

AS_OF = dt.date(2024, 9, 1)


def tables(spark: SparkSession, sf_dir: str) -> ListingTables:
    return listing_tables(configure(spark), sf_dir)


def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_extract(tables(spark, sf_dir))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_sales(extract(spark, sf_dir), inflation_factors(spark), SALE_ORDER)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.engineer_features(cleaned(spark, sf_dir), inflation_factors(spark), AS_OF)


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_features(tables(spark, sf_dir), inflation_factors(spark), AS_OF)


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = split_rows(spark, sf_dir).where(F.col("split") == "train")
    return sampling.oversample_recent(train, AS_OF)


def stored_rows(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Train rows with copies, and all rows once. Written once, since fitting takes several passes."""
    repeated = (F.col("split") == "train") & sampling.is_recent(F.col("bike_created_at"), AS_OF)
    rows = sampling.oversample(split_rows(spark, sf_dir), repeated).select("id", "split", "copy_no", *columns)
    stored = materialise(rows, "prepared")
    return stored.where(F.col("split") == "train"), stored.where(F.col("copy_no") == 0).drop("copy_no")


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(stand_in_results(spark, sf_dir), "results")


def stand_in_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with a fixed prediction in place of a model: half the list price, adjusted."""
    sales = cleaned(spark, sf_dir)
    predicted = sales.select("id", P.adjusted_price(F.col("msrp") * 0.5).alias("price"))
    predictions = with_interval(predicted).withColumnRenamed("price", "prediction")
    return ev.result_table(sales, predictions, ["id"])


def request_payloads(bikes: DataFrame) -> DataFrame:
    """Every listing as a JSON payload: single records, lists, texts for numbers, empty and broken ones."""
    key = F.col("id")
    msrp = (
        F.when(key % 10 == 0, F.concat(F.lit('"'), F.floor("msrp").cast("string"), F.lit('"')))
        .when(key % 10 == 1, F.lit('"1200.5"'))
        .when(key % 10 == 2, F.lit("null"))
        .when(key % 10 != 3, F.col("msrp").cast("string"))
    )

    def number(name: str, value) -> object:
        return F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value.cast("string")))

    def text(name: str, value) -> object:
        return F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":"'), value, F.lit('"')))

    record = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            number("bike_id", key),
            number("msrp", msrp),
            number("bike_year", F.col("year")),
            number("template_id", F.col("bike_template_id")),
            number("bike_created_at_year", F.year("created_at")),
            number("bike_created_at_month", F.month("created_at")),
            number("sales_country_id", F.col("country_id")),
            number("brand_id", F.col("brand_id")),
            number("family_id", F.col("family_id")),
            text("mileage_code", F.col("mileage_code")),
            text("condition_code", F.col("condition_code")),
            text("frame_material_code", F.col("frame_material_code")),
        ),
        F.lit("}"),
    )
    payload = (
        F.when(key % 50 == 7, F.lit("[]"))
        .when(key % 50 == 8, F.lit("{}"))
        .when(key % 50 == 9, F.concat(F.lit("x"), record))
        .when(key % 3 == 0, F.concat(F.lit("["), record, F.lit(", {}]")))
        .otherwise(record)
    )
    return bikes.select(key.alias("payload_id"), payload.alias("value"))


# For tests of the job itself; no query uses it.
SMALL_IMPUTATION = TrainingSettings(imputation=ImputationSettings(rounds=1, num_trees=3, max_depth=3))

# What the queries learn with: all columns, all rows. The job's own defaults (10 rounds of 100 trees, 100 trees of depth 30) take
# longer than a query may; the README has measured times.
IMPUTATION = ImputationSettings(rounds=3, num_trees=10)
FOREST_TREES, FOREST_DEPTH = 20, 12


@lru_cache(maxsize=8)
def trained(spark: SparkSession, sf_dir: str) -> tuple[str, TrainingRun]:
    """One training run per session and data folder, shared by the learned queries through the registry of published runs."""
    root = f"{scratch_dir(configure(spark))}/training"
    learner = QuantileForest(keyCols=list(ROW_KEYS), numTrees=FOREST_TREES, maxDepth=FOREST_DEPTH)
    settings = TrainingSettings(imputation=IMPUTATION)
    return root, run_training(tables(spark, sf_dir), inflation_factors(spark), AS_OF, root, None, learner, settings)
