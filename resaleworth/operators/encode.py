"""Category dictionaries, label codes and indicator columns.

A dictionary is a table (column_name, value, code), whatever its size: codes and values are looked up by joins, which the
planner turns into broadcasts where the table is small.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, functions as F

from resaleworth.operators.ranking import with_row_number
from resaleworth.session import materialise


def dictionary_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, code): sorted distinct values per column as texts, nulls left out, numbers in the order of numbers.

    One pass for all columns, merged map-side; codes are numbered without a single-task sort.
    """
    numbers = {name for name, kind in df.dtypes if kind not in ("string", "boolean", "binary", "date", "timestamp")}
    pairs = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.col(name).cast("string").alias("value"),
            (F.col(name).cast("decimal(38,9)") if name in numbers else F.lit(None).cast("decimal(38,9)")).alias("number"),
        )
        for name in columns
    ]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_name string, value string, code bigint")
    values = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("value IS NOT NULL").distinct()
    placed = with_row_number(materialise(values, "dictionary"), ["column_name", "number", "value"], "place")
    first = placed.groupBy("column_name").agg(F.min("place").alias("first"))
    return placed.join(first, "column_name").select("column_name", "value", (F.col("place") - F.col("first")).alias("code"))


def code_name(column: str) -> str:
    return f"{column}_code"


def encode_labels(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_code``; nulls and unseen values have no code."""
    for name in columns:
        own = dictionary.where(F.col("column_name") == name).select(F.col("value").alias("_value"), F.col("code").cast("double").alias(code_name(name)))
        df = df.join(own, F.col(name).cast("string") == F.col("_value"), "left").drop("_value")
    return df


def decode_labels(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by the value of its ``<column>_code``, in the column's own type; without a code it is null."""
    order = df.columns
    for name in columns:
        kind = df.schema[name].dataType
        own = dictionary.where(F.col("column_name") == name).select(F.col("code").alias("_code"), F.col("value").cast(kind).alias("_value"))
        df = df.join(own, F.col(code_name(name)).cast("bigint") == F.col("_code"), "left").withColumn(name, F.col("_value")).drop("_code", "_value")
    return df.select(*order)


def category_labels(dictionary: DataFrame, column: str, kind: str) -> list[Any]:
    """The values of one column in the order of their codes, for the wide form, which has a column per value."""
    rows = dictionary.where(F.col("column_name") == column).select("code", F.col("value").cast(kind).alias("value"))
    return [row["value"] for row in rows.orderBy("code").collect()]


def named_indicators(column: str, labels: Sequence[Any]) -> list[tuple[str, Column]]:
    """A 0/1 column per category, by the category's text, and one named -1 for anything else."""
    value = F.col(column)
    flags = [(str(label), F.coalesce(value == F.lit(label), F.lit(False)).cast("int")) for label in labels]
    known = F.coalesce(value.isin(*labels), F.lit(False)) if labels else F.lit(False)
    return [*flags, ("-1", (~known).cast("int"))]


def indicator_columns(column: str, labels: Sequence[Any]) -> list[Column]:
    """The indicators under the names ``<column>_<category>`` and ``<column>_-1``."""
    return [flag.alias(f"{column}_{name}") for name, flag in named_indicators(column, labels)]


def indicator_stages(columns: Sequence[str]) -> list[Any]:
    """The same indicators as sparse vectors for a pipeline; the last slot is the unknown one."""
    indexed = [f"{name}_index" for name in columns]
    return [
        StringIndexer(
            inputCols=list(columns), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
        ),
        OneHotEncoder(inputCols=indexed, outputCols=[f"{name}_onehot" for name in columns], dropLast=False),
    ]
