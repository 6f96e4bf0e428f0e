"""Cleaning, sampling, ranking, encoding, scaling and evaluation on small literal tables."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from resaleworth import config
from resaleworth.operators import clean, encode as enc, evaluate as ev, fill, sampling
from resaleworth.operators.features import sentinels_to_null
from resaleworth.operators.ranking import double_of, exact_percentiles, ordered_bits, with_row_number
from resaleworth.operators.scale import ColumnScaler
from resaleworth.plans.extract import paid_bookings, sold_bikes
from resaleworth.session import materialise, spread
from resaleworth.sources.inflation import inflation_factors
from resaleworth.sources.tables import SCHEMAS, ListingTables, read_tables

AS_OF = dt.date(2024, 9, 1)


def test_bounds(spark):
    rows = [(1, 200.0, 300.0), (2, 200.01, 300.0), (3, 24999.0, 25000.0), (4, 25000.0, 25000.0), (5, 300.0, 250.0),
            (6, 300.0, 249.0), (7, 300.0, None), (8, 300.0, 1000.0), (9, 301.0, 1000.0), (10, None, 500.0)]
    df = spark.createDataFrame(rows, "id int, sales_price double, msrp double")
    assert sorted(r["id"] for r in clean.plausible_sales(df).collect()) == [2, 3, 5, 9]


def test_every_paid_status_counts(spark):
    bookings = [(i, i, s) for i, s in enumerate(["paid_out", "success", "sell_link_confirm", "capture", "paid", "cancelled", None])]
    tables = ListingTables(
        bikes=spark.createDataFrame([(1, "sold"), (2, "active")], "id bigint, status string"),
        bookings=spark.createDataFrame(bookings, "id bigint, bike_id bigint, status string").withColumn("created_at", F.current_timestamp()),
        booking_accountings=spark.createDataFrame([(i, 1.0) for i in range(7)], "booking_id bigint, bike_price_currency double"),
        bike_template_additional_infos=spark.createDataFrame([], "bike_template_id bigint"),
        bike_additional_infos=spark.createDataFrame([(1,), (2,)], "bike_id bigint"),
    )
    assert sorted(r["booking_id"] for r in paid_bookings(tables).collect()) == [0, 1, 2, 3, 4]
    with_template = tables.bikes.withColumn("bike_template_id", F.lit(9).cast("bigint"))
    sold = sold_bikes(ListingTables(with_template, *list(vars(tables).values())[1:]))
    assert [r["id"] for r in sold.collect()] == [1]


def test_last_row_per_key_with_a_hot_key(spark):
    rows = [(1 if i % 3 == 0 else i, i // 2, str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, at int, tie string").repartition(7)
    got = {r["id"]: (r["at"], r["tie"]) for r in clean.last_per_key(df, ["id"], ["at", "tie"]).collect()}
    expected = {}
    for key, at, tie in rows:
        expected[key] = max(expected.get(key, (-1, "")), (at, tie))
    assert got == expected


def test_hot_listing_merges_before_it_moves(spark):
    """A third of the bookings belong to one listing: the join splits it, and partial rows move afterwards."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100000",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        bikes = spark.range(20000).select("id", (F.rand(1) * 5000).alias("msrp"))
        owner = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20000)
        bookings = spark.range(400000).select(owner.alias("bike_id"), F.col("id").alias("booking"), F.rand(2).alias("at"))
        last = clean.last_per_key(bikes.join(bookings, F.col("id") == F.col("bike_id")), ["id"], ["at", "booking"])
        assert len(last.collect()) == 20000
        plan = last._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.index("Exchange") < plan.index("partial_max_by") < plan.index("SortMergeJoin(skew=true)")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_year_without_factor_gives_null(spark):
    df = spark.createDataFrame([(1, 100.0, 2011), (2, 100.0, 2023), (3, 100.0, None)], "id int, p double, y int")
    lifted = clean.lift_to_base_year(df, "p", F.col("y"), inflation_factors(spark))
    assert {r["id"]: r["p"] for r in lifted.collect()} == {1: None, 2: pytest.approx(106.4), 3: None}


def test_sentinels_skip_keys(spark):
    row = sentinels_to_null(spark.createDataFrame([(0, 0, 0.0, "None", "x")], "id int, a int, b double, c string, d string")).first()
    assert tuple(row) == (0, None, None, None, "x")


def test_read_tables_types_columns(spark, tmp_path):
    for name, types in SCHEMAS.items():
        wide = spark.range(1).select(*[F.lit("1").alias(c) if t != "timestamp" else F.lit("2024-01-02 00:00:00").alias(c) for c, t in types.items()], F.lit(1).alias("extra"))
        wide.write.parquet(f"{tmp_path}/{name}")
    tables = read_tables(spark, str(tmp_path))
    assert dict(tables.bikes.dtypes) == SCHEMAS["bikes"]
    assert tables.bookings.first()["created_at"] == dt.datetime(2024, 1, 2)


def test_split_ignores_partitioning(spark):
    ids = spark.range(5000)
    one = {tuple(r) for r in sampling.with_split(ids.coalesce(1)).collect()}
    many = {tuple(r) for r in sampling.with_split(ids.repartition(13)).collect()}
    assert one == many
    share = sum(1 for _, split in one if split == "test") / 5000
    assert 0.09 < share < 0.15


def test_recent_rows_come_four_times(spark):
    rows = [(1, dt.datetime(2024, 7, 3)), (2, dt.datetime(2024, 7, 2, 23, 59)), (3, None), (4, dt.datetime(2024, 9, 2))]
    df = spark.createDataFrame(rows, "id int, bike_created_at timestamp")
    counts = {r["id"]: r["count"] for r in sampling.oversample_recent(df, AS_OF).groupBy("id").count().collect()}
    assert counts == {1: 4, 2: 1, 3: 1, 4: 4}


def test_shuffle_keeps_rows_and_repeats(spark):
    df = spark.range(200)
    first = [r["id"] for r in sampling.shuffled(df, ["id"]).collect()]
    again = [r["id"] for r in sampling.shuffled(df.repartition(5), ["id"]).collect()]
    assert first == again and sorted(first) == list(range(200)) and first != sorted(first)


def test_row_numbers(spark):
    rows = [(i, 5.0 if i % 3 == 0 else float(i % 17)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(6)
    numbered = with_row_number(df, ["v", "id"]).collect()
    assert {r["id"]: r["row_no"] for r in numbered} == {
        key: place for place, (key, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)
    }


@pytest.mark.parametrize("kind", ["spread", "hot", "two"])
def test_percentiles_of_large_columns(spark, kind):
    rng = random.Random(3)
    if kind == "spread":
        values = [rng.gauss(0, 100) for _ in range(20000)]
    elif kind == "hot":
        values = [7.0 if rng.random() < 0.4 else rng.random() * 20 for _ in range(20000)]
    else:
        values = [float(rng.random() < 0.3) for _ in range(20000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.75, 0.999, 1.0)
    df = df.withColumn("w", F.when(F.col("v") > 0, -F.col("v"))).withColumn("none", F.lit(None).cast("double"))
    got = exact_percentiles(df, ["v", "w", "none"], shares)
    assert got["v"] == pytest.approx(list(np.quantile(values, shares)), abs=1e-9)
    assert got["w"] == pytest.approx(list(np.quantile([-v for v in values if v > 0], shares)), abs=1e-9)
    assert got["none"] == [None] * len(shares)


def test_percentiles_of_extreme_values(spark):
    values = [-1e308, -5e-324, -0.0, 0.0, 5e-324, 1e308, float("inf"), float("-inf"), -1.0, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = [i / 9 for i in range(10)]
    got = exact_percentiles(df, ["v"], [0, 1 / 9, 2 / 9, 4 / 9, 6 / 9, 8 / 9, 1])["v"]
    assert got == [sorted(values)[i] for i in (0, 1, 2, 4, 6, 8, 9)] and len(ranks) == 10
    bits = spark.createDataFrame([(v,) for v in sorted(values)], "v double").select(ordered_bits(F.col("v")).alias("b")).collect()
    assert [double_of(r["b"]) for r in bits] == sorted(values)


def test_percentiles_of_nothing(spark):
    assert exact_percentiles(spark.createDataFrame([(None,)], "v double"), ["v"], (0.5,)) == {"v": [None]}


def test_percentile_passes_only_count(spark):
    """A pass over the values holds an aggregate with map-side merging and broadcasts; nothing sorts the values."""
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("v"))
    assert exact_percentiles(df, ["v"], (0.5,))["v"] == [3.0]


def test_codes_round_trip(spark):
    df = spark.createDataFrame([("b", 10), ("a", 9), (None, None), ("b", 2)], "t string, n bigint")
    dictionary = enc.dictionary_table(df, ["t", "n"])
    assert sorted(map(tuple, dictionary.collect())) == [("n", "10", 2), ("n", "2", 0), ("n", "9", 1), ("t", "a", 0), ("t", "b", 1)]
    assert enc.category_labels(dictionary, "n", "bigint") == [2, 9, 10]
    more = df.union(spark.createDataFrame([("new", 77)], "t string, n bigint")).withColumn("_value", F.lit(1))
    coded = enc.encode_labels(more.drop("_value"), dictionary, ["t", "n"])
    assert sorted(((r["t"] or "", r["t_code"], r["n_code"]) for r in coded.collect()), key=repr) == sorted(
        [("b", 1, 2), ("a", 0, 1), ("", None, None), ("b", 1, 0), ("new", None, None)], key=repr
    )
    decoded = enc.decode_labels(coded, dictionary, ["n"])
    assert sorted([r["n"] for r in decoded.collect()], key=repr) == sorted([10, 9, None, 2, None], key=repr)
    assert decoded.schema["n"].dataType == df.schema["n"].dataType


def test_dictionary_of_any_size(spark):
    """200,000 categories are coded and decoded; no list of them is built anywhere."""
    df = spark.range(200_000).select(F.col("id"), F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("c"))
    dictionary = materialise(enc.dictionary_table(df, ["c"]), "dictionary")
    coded = enc.encode_labels(df, dictionary, ["c"])
    back = enc.decode_labels(coded.withColumn("was", F.col("c")).withColumn("c", F.lit(None).cast("string")), dictionary, ["c"])
    wrong = (F.col("c_code") != F.col("id")) | (F.col("c") != F.col("was"))
    assert back.agg(F.count("*"), F.count_if(F.coalesce(wrong, F.lit(True)))).first() == (200_000, 0)


def test_indicators(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    rows = df.select(*enc.indicator_columns("c", ["a", "b"])).collect()
    assert rows[0].asDict() == {"c_a": 1, "c_b": 0, "c_-1": 0}
    assert [tuple(r) for r in rows] == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 1)]


def test_mode_prefers_the_smaller_value_on_a_tie(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("a", None), ("b", None)], "p string, q string")
    assert fill.column_modes(df, ["p", "q"]) == {"p": "a", "q": "x"}


def test_scaler(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5), (3.0, 5), (None, None)], "a double, b int")
    model = ColumnScaler(inputCols=["a", "b"], low=0.0, high=10.0).fit(df)
    assert [tuple(r) for r in model.transform(df).collect()] == [(0.0, 0.0), (10.0, 0.0), (None, None)]
    model.write().save(f"{tmp_path}/scaler")
    again = type(model).load(f"{tmp_path}/scaler").transform(df).collect()
    assert again == model.transform(df).collect()
    with pytest.raises(ValueError):
        ColumnScaler(inputCols=["a"], method="other")


def test_two_affine_scalers_equal_the_last_one(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 9, 16)], "m double")
    robust = ColumnScaler(inputCols=["m"], method="robust").fit(df).transform(df)
    both = ColumnScaler(inputCols=["m"], high=25000.0).fit(robust).transform(robust)
    alone = ColumnScaler(inputCols=["m"], high=25000.0).fit(df).transform(df)
    assert [r["m"] for r in both.collect()] == pytest.approx([r["m"] for r in alone.collect()])


def test_evaluation_against_python(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(100, 1000), rng.uniform(100, 1000)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, sales_price double, prediction double")
    df = df.withColumns({"low": F.col("prediction") - 50, "high": F.col("prediction") + 50})
    results = ev.result_table(df, df, ["id"])
    inside = sum(p - 50 <= y <= p + 50 for _, y, p in rows) / 200
    assert ev.interval_check(results).first()["share_in_range"] == pytest.approx(inside)
    mape = statistics.mean(abs(y - p) / y for _, y, p in rows)
    assert ev.MapeEvaluator().evaluate(df) == pytest.approx(mape)
    assert not ev.MapeEvaluator().isLargerBetter()
    hist = ev.histogram(df, ["sales_price"], bins=10).orderBy("bin").collect()
    counts, edges = np.histogram([y for _, y, _ in rows], bins=10)
    assert {r["bin"]: r["rows"] for r in hist} == {i: c for i, c in enumerate(counts) if c}
    assert hist[0]["bin_low"] == pytest.approx(edges[0])
    curve = ev.density_curve(df, ["sales_price"], points=400).orderBy("x").collect()
    area = np.trapezoid([r["density"] for r in curve], [r["x"] for r in curve])
    assert area == pytest.approx(1, abs=0.01)
    table = ev.error_breakdown(ev.error_rows(df)).collect()
    assert sum(r["rows"] for r in table) == 200 and sum(r["share"] for r in table) == pytest.approx(1)


def test_feature_lists():
    assert len(config.CATEGORICAL) == 8 and len(config.NUMERICAL) == 18
    assert not set(config.COMPUTED) & set(clean.training_columns())


def test_price_bounds_reach_the_scans(spark, tmp_path):
    from resaleworth.operators.clean import clean_sales
    from resaleworth.plans.extract import SALE_ORDER, sales_extract
    from resaleworth.sources.inflation import inflation_factors
    from resaleworth.sources.listing_views import listing_tables
    from resaleworth.sources.tables import SCHEMAS, read_tables

    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    views = listing_tables(spark, "/root/testdata/sf0.001")
    for name in SCHEMAS:
        getattr(views, name).write.parquet(f"{tmp_path}/{name}")
    cleaned = clean_sales(sales_extract(read_tables(spark, str(tmp_path))), inflation_factors(spark), SALE_ORDER)
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.split("\n") if "PushedFilters" in line]
    assert any("GreaterThanOrEqual(msrp" in line and "LessThanOrEqual(msrp" in line for line in pushed)
    assert any("GreaterThan(bike_price_currency" in line and "LessThan(bike_price_currency" in line for line in pushed)


def test_spread_rows_are_even_and_in_order(spark):
    """One long file and many short ones become parts of even size, the same at each call; few rows stay together."""
    uneven = spark.range(40_000).selectExpr("id", "id % 3 AS copy_no").repartitionByRange(2, (F.col("id") > 38_000).cast("int"))
    cores = spark.sparkContext.defaultParallelism
    parts = [spread(uneven, ["id", "copy_no"]).rdd.glom().collect() for _ in range(2)]
    assert parts[0] == parts[1] and sum(len(part) for part in parts[0]) == 40_000
    assert len(parts[0]) == min(cores, 20) and max(len(part) for part in parts[0]) < 1.2 * 40_000 / len(parts[0])
    assert spread(uneven.limit(50), ["id", "copy_no"]).rdd.getNumPartitions() == 1
