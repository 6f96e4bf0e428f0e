"""Queries for fitted but exact operators: statistics, dictionaries, indicators, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from resaleworth import config
from resaleworth.operators import encode as enc, fill
from resaleworth.operators.ranking import exact_percentiles
from resaleworth.operators.scale import ColumnScaler
from resaleworth.queries import frames, oracle_base as sql
from resaleworth.queries.registry import Registry
from resaleworth.session import materialise

query = Registry()

_NUMBERS = config.NUMERICAL
# Kinds differ, so values of all categories are compared as texts.
_CATEGORIES = config.CATEGORICAL


@query(
    f"WITH {sql.FEATURES} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, round(avg({name}), 6) AS mean, CAST(min({name}) AS DOUBLE) AS lowest,"
        f" CAST(max({name}) AS DOUBLE) AS highest FROM train_rows"
        for name in _NUMBERS
    )
)
def column_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, minimum and maximum per column in one pass."""
    train = frames.train_rows(spark, sf_dir)
    stats = [
        f(F.col(name).cast("double")).alias(f"{name}_{label}")
        for name in _NUMBERS
        for f, label in ((F.avg, "mean"), (F.min, "lowest"), (F.max, "highest"))
    ]
    parts = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.round(f"{name}_mean", 6).alias("mean"),
            F.col(f"{name}_lowest").alias("lowest"),
            F.col(f"{name}_highest").alias("highest"),
        )
        for name in _NUMBERS
    ]
    return train.agg(*stats).select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def _texts(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(name).cast("string").alias(name) for name in _CATEGORIES])


@query(
    f"WITH {sql.FEATURES}, v AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS column_name, {name}::VARCHAR AS value FROM train_rows" for name in _CATEGORIES)
    + "), c AS (SELECT column_name, value, count(*) AS frequency FROM v WHERE value IS NOT NULL GROUP BY 1, 2)"
    " SELECT column_name, value, frequency FROM (SELECT *, row_number() OVER (PARTITION BY column_name"
    " ORDER BY frequency DESC, value) AS rn FROM c) WHERE rn = 1"
)
def most_frequent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.most_frequent(_texts(frames.train_rows(spark, sf_dir)), _CATEGORIES)


@query(
    f"WITH {sql.FEATURES} SELECT round(quantile_cont(msrp, 0.25), 6) AS q25, round(quantile_cont(msrp, 0.5), 6) AS q50,"
    " round(quantile_cont(msrp, 0.75), 6) AS q75 FROM train_rows"
)
def price_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = frames.stored_rows(spark, sf_dir, "msrp")
    values = exact_percentiles(train, ["msrp"], (0.25, 0.5, 0.75))["msrp"]
    return spark.createDataFrame([tuple(round(v, 6) for v in values)], "q25 double, q50 double, q75 double")


@query(
    f"WITH {sql.FEATURES} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, "
        + ", ".join(f"round(quantile_cont({name}::DOUBLE, {p}), 6) AS q{int(100 * p)}" for p in (0.25, 0.5, 0.75))
        + " FROM train_rows"
        for name in config.NUMERICAL
    )
)
def column_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of all number columns in the same four passes."""
    train, _ = frames.stored_rows(spark, sf_dir, *config.NUMERICAL)
    found = exact_percentiles(train, config.NUMERICAL, (0.25, 0.5, 0.75))
    rows = [(name, *[None if v is None else round(v, 6) for v in found[name]]) for name in config.NUMERICAL]
    return spark.createDataFrame(rows, "column_name string, q25 double, q50 double, q75 double")


_DENSE = " UNION ALL ".join(
    f"SELECT '{name}' AS column_name, value::VARCHAR AS value, row_number() OVER (ORDER BY value) - 1 AS code"
    f" FROM (SELECT DISTINCT {name} AS value FROM train_rows WHERE {name} IS NOT NULL)"
    for name in _CATEGORIES
)


@query(f"WITH {sql.FEATURES} {_DENSE}")
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted dictionary of each category column with its codes."""
    train, _ = frames.stored_rows(spark, sf_dir, *_CATEGORIES)
    return enc.dictionary_table(train, _CATEGORIES)


def _codes_sql(name: str) -> str:
    return (
        f"(SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT {name} AS value"
        f" FROM train_rows WHERE {name} IS NOT NULL))"
    )


@query(
    f"WITH {sql.FEATURES} SELECT s.id, s.split, "
    + ", ".join(f"c{i}.code AS {name}_code, c{i}.value AS {name}" for i, name in enumerate(_CATEGORIES))
    + " FROM split_rows s"
    + "".join(f" LEFT JOIN {_codes_sql(name)} c{i} ON c{i}.value = s.{name}" for i, name in enumerate(_CATEGORIES))
)
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes learned on the train rows, applied to all rows, and decoded again."""
    train, rows = frames.stored_rows(spark, sf_dir, *_CATEGORIES)
    dictionary = materialise(enc.dictionary_table(train, _CATEGORIES), "dictionary")
    coded = enc.encode_labels(rows, dictionary, _CATEGORIES)
    return enc.decode_labels(coded, dictionary, _CATEGORIES)


_MEANS = ", ".join(f"round(coalesce({name}::DOUBLE, (SELECT avg({name}) FROM train_rows)), 6) AS {name}" for name in _NUMBERS)
_MODES = ", ".join(
    f"coalesce({name}, (SELECT {name} FROM train_rows WHERE {name} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {name}::VARCHAR LIMIT 1)) AS {name}"
    for name in _CATEGORIES
)


@query(f"WITH {sql.FEATURES} SELECT id, {_MEANS}, {_MODES} FROM split_rows")
def first_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and most frequent values of the train rows in the gaps of all 26 columns."""
    train, rows = frames.stored_rows(spark, sf_dir, *_NUMBERS, *_CATEGORIES)
    means, modes = fill.column_means(train, _NUMBERS), fill.column_modes(_texts(train), _CATEGORIES)
    kinds = {f.name: f.dataType for f in rows.schema}
    typed = rows.select("id", *[F.col(name).cast("double").alias(name) for name in _NUMBERS], *_CATEGORIES)
    filled = fill.fill_gaps(typed, {name: value for name, value in means.items() if value is not None})
    filled = filled.withColumns({name: F.coalesce(F.col(name), F.lit(value).cast(kinds[name])) for name, value in modes.items()})
    return filled.withColumns({name: F.round(name, 6) for name in _NUMBERS})


@query(
    f"WITH {sql.FEATURES}, "
    + ", ".join(f"d{i} AS (SELECT DISTINCT {name} AS v FROM train_rows WHERE {name} IS NOT NULL)" for i, name in enumerate(_CATEGORIES))
    + " SELECT id, split, column_name, category, indicator FROM ("
    + " UNION ALL ".join(
        f"SELECT id, split, '{name}' AS column_name, v::VARCHAR AS category, coalesce({name} = v, false)::INTEGER AS indicator FROM split_rows, d{i}"
        f" UNION ALL SELECT id, split, '{name}', '-1', ({name} IS NULL OR {name} NOT IN (SELECT v FROM d{i}))::INTEGER FROM split_rows"
        for i, name in enumerate(_CATEGORIES)
    )
    + ") WHERE indicator = 1"
)
def category_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indicators of all categories and the unknown one, those that are set."""
    train, rows = frames.stored_rows(spark, sf_dir, *_CATEGORIES)
    dictionary = materialise(enc.dictionary_table(train, _CATEGORIES), "dictionary")
    kinds = dict(rows.dtypes)
    flags = []
    for name in _CATEGORIES:
        for flag, column in enc.named_indicators(name, enc.category_labels(dictionary, name, kinds[name])):
            flags.append(F.struct(F.lit(name).alias("column_name"), F.lit(flag).alias("category"), column.alias("indicator")))
    return rows.select("id", "split", F.explode(F.array(*flags)).alias("f")).select("id", "split", "f.*").where("indicator = 1")


_SCALED = tuple(name for name in config.NUMERICAL if name != "msrp")


def _minmax_sql(name: str) -> str:
    low, high = (f"(SELECT {f}({name}) FROM train_rows)" for f in ("min", "max"))
    return f"round(({name} - {low}) * (1 / CAST(coalesce(nullif({high} - {low}, 0), 1) AS DOUBLE)), 6) + 0.0 AS {name}"


@query(f"WITH {sql.FEATURES} SELECT id, {', '.join(_minmax_sql(name) for name in _SCALED)} FROM split_rows")
def range_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges fitted on train, applied to all; a constant column maps to 0."""
    train, rows = frames.stored_rows(spark, sf_dir, *_SCALED)
    scaled = ColumnScaler(inputCols=list(_SCALED)).fit(train).transform(rows).select("id", *_SCALED)
    return scaled.withColumns({name: F.round(name, 6) + 0.0 for name in _SCALED})


_ROBUST = (
    "(msrp - (SELECT quantile_cont(msrp, 0.5) FROM train_rows)) / (SELECT quantile_cont(msrp, 0.75) - quantile_cont(msrp, 0.25)"
    " FROM train_rows)"
)


@query(f"WITH {sql.FEATURES} SELECT id, round({_ROBUST}, 6) + 0.0 AS msrp FROM split_rows")
def robust_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, rows = frames.stored_rows(spark, sf_dir, "msrp")
    scaler = ColumnScaler(inputCols=["msrp"], method="robust").fit(train)
    return scaler.transform(rows).select("id", (F.round("msrp", 6) + 0.0).alias("msrp"))


@query(
    f"WITH {sql.FEATURES}, r AS (SELECT id, {_ROBUST} AS msrp FROM split_rows), t AS (SELECT {_ROBUST} AS msrp FROM train_rows)"
    " SELECT id, round((msrp - (SELECT min(msrp) FROM t)) * (25000 / (SELECT max(msrp) - min(msrp) FROM t)), 4) + 0.0 AS msrp FROM r"
)
def msrp_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust scaling followed by the range 0 … 25000, as the pipeline does it."""
    train, rows = frames.stored_rows(spark, sf_dir, "msrp")
    robust = ColumnScaler(inputCols=["msrp"], method="robust").fit(train)
    ranged = ColumnScaler(inputCols=["msrp"], high=config.BOUNDS.msrp_max).fit(robust.transform(train))
    scaled = ranged.transform(robust.transform(rows))
    return scaled.select("id", (F.round("msrp", 4) + 0.0).alias("msrp"))
