"""First fill of gaps: mean for numbers, most frequent value for categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    if not columns:
        return {}
    row = df.agg(*[F.avg(F.col(name).cast("double")).alias(name) for name in columns]).first()
    return {name: row[name] for name in columns}


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, frequency): the commonest value per column, the smallest one on a tie.

    One pass over all columns, which must share a type; counts merge before the exchange.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("column_name"), F.col(name).alias("value")) for name in columns]))
    counts = (
        df.select(pairs.alias("p"))
        .select("p.*")
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("frequency"))
    )
    first = F.min(F.struct((-F.col("frequency")).alias("n"), F.col("value"))).alias("first")
    return counts.groupBy("column_name").agg(first).select(
        "column_name", F.col("first.value").alias("value"), (-F.col("first.n")).alias("frequency")
    )


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, Any]:
    if not columns:
        return {}
    found = {row["column_name"]: row["value"] for row in most_frequent(df, columns).collect()}
    return {name: found.get(name) for name in columns}


def fill_gaps(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    return df.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in values.items()})
