"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from resaleworth.session import materialise


def _state(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; the component is its smallest node.

    Each round points every node at the smallest node near it (large star: neighbours above it;
    small star: those below it) and stores the edges in the shared folder, which cuts the lineage.
    All steps are aggregates with map-side merging and joins that AQE can split. Nulls and loops are ignored.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    current = materialise(edges_between(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())), "links")
    before = _state(current)
    while before[0]:
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u"))
        large = large.unionByName(least.where("m < u").select("u", F.col("u").alias("v"), "m"))
        stars = materialise(edges_between(large.select(F.col("v").alias("hi"), F.col("m").alias("lo"))), "links")
        lowest = stars.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = stars.join(lowest, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        current = materialise(edges_between(moved.unionByName(lowest.select("hi", F.col("m").alias("lo")))), "links")
        after = _state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def edges_between(pairs: DataFrame) -> DataFrame:
    return pairs.where("hi > lo").distinct()
