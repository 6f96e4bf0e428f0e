"""Reading embedding columns: which vectors count, and their exact copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from resaleworth.llm.text import tagged


def usable(vec: Column) -> Column:
    """True for vectors that are not null, empty or zero and whose components are all finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def vector_rows(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec as doubles, h1, h2): rows with a usable vector; copies share the two hashes."""
    rows = tagged(table, {"id": id_col, "vec": vec_col})
    rows = rows.select("id", F.col("vec").cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    return rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
