"""Global row numbers and exact percentiles without a single-task sort."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from resaleworth.session import materialise

# monotonically_increasing_id() keeps the partition above this many low bits.
ROW_BITS = 33


def with_row_number(df: DataFrame, order: Sequence[str], name: str = "row_no", start: int = 1) -> DataFrame:
    """Number all rows by ``order``, which must end in a unique key.

    Range partitions are sorted on their own. Their sizes, one row per partition, give the
    offset of each; the sorted rows are written once so that both reads see the same partitions.
    Range partitioning samples ``df`` first, so a costly ``df`` should be a stored table.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ranged.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", ROW_BITS).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, within + F.col("_offset") + start)
        .drop("_place", "_part", "_offset")
    )


def ranks_in_groups(held: DataFrame, asked: DataFrame, sizes: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, v, below, upto, n): of the ``n`` values held by a group, how many lie below, and how many up to, each ``v`` asked of it.

    ``held`` has (group, v, tie), ``asked`` has (group, v) once each, ``sizes`` has (group, n) and is small. Both are sorted together, an
    asked value once before and once after its equals. Its place among all rows less that among the asked ones counts the held
    values before it, so that no group is ever together in one task.
    """
    order = [*group, "v", "side", "tie"]
    ends = asked.select(*group, "v", F.explode(F.array(F.lit(0), F.lit(2))).alias("side"), F.lit(0).cast("bigint").alias("tie"))
    rows = held.select(*group, "v", F.lit(1).alias("side"), F.col("tie").cast("bigint").alias("tie")).unionByName(ends)
    placed = with_row_number(rows, order, "place").where("side <> 1")
    counted = with_row_number(placed, order, "among").withColumn("before", F.col("place") - F.col("among"))
    before = F.coalesce(F.sum("n").over(W.orderBy(*group).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*group, "n", before.alias("start"))
    sides = [F.max(F.when(F.col("side") == side, F.col("before"))).alias(name) for side, name in ((0, "below"), (2, "upto"))]
    ranks = counted.groupBy(*group, "v").agg(*sides).join(F.broadcast(starts), list(group))
    return ranks.select(*group, "v", (F.col("below") - F.col("start")).alias("below"), (F.col("upto") - F.col("start")).alias("upto"), "n")


# Bits of a value that one pass settles; four passes settle a double.
STEP_BITS = 16
STEPS = 4
_LOW_BITS = (1 << 63) - 1


def ordered_bits(value: Column) -> Column:
    """A long that sorts like the double: of negative numbers all bits but the sign are turned round. -0.0 counts as 0.0."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("bigint")
    return F.when(value.isNotNull(), F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_LOW_BITS))))


def double_of(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits if bits >= 0 else bits ^ _LOW_BITS))[0]


def exact_percentiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Percentiles of many columns at once, with linear interpolation between neighbours; nulls are left out.

    Radix selection, the same at any size: each of four passes over the ordered bits counts the next 16 bits below the prefixes
    that hold a wanted rank, for all columns and ranks together. A pass is a map-side aggregate of at most 65,536 counters per column and
    rank; no pass sorts or moves the rows. A column without values gives nulls.
    """
    spark = df.sparkSession
    keys = materialise(df.select(*[ordered_bits(F.col(name)).alias(f"k{i}") for i, name in enumerate(columns)]), "bits")
    totals = keys.agg(*[F.count(f"k{i}").alias(f"k{i}") for i in range(len(columns))]).first()
    # (column, rank) -> the bits found so far, and the rank among the values that share them.
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for i in range(len(columns)):
        places = [(totals[f"k{i}"] - 1) * p for p in probabilities] if totals[f"k{i}"] else []
        found.update({(i, rank): (0, rank) for place in places for rank in (math.floor(place), math.ceil(place))})
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"k{i}").alias("bits")) for i in range(len(columns))]))
    values = keys.select(pairs.alias("p")).select("p.*").where("bits is not null")
    for step in range(STEPS if found else 0):
        shift = 64 - STEP_BITS * (step + 1)
        # The first digit keeps the sign, the others don't.
        prefix = F.shiftright("bits", shift + STEP_BITS) if step else F.lit(0).cast("bigint")
        digit = F.shiftright("bits", shift) if not step else F.shiftright("bits", shift).bitwiseAND(F.lit((1 << STEP_BITS) - 1))
        # One row per column and rank.
        wanted = spark.createDataFrame([(i, rank, *state) for (i, rank), state in found.items()], "i int, rank bigint, prefix bigint, left bigint")
        held = F.broadcast(wanted.select("i", "prefix").distinct())
        counts = values.select("i", prefix.alias("prefix"), digit.alias("digit")).join(held, ["i", "prefix"])
        counts = counts.groupBy("i", "prefix", "digit").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(W.partitionBy("i", "rank").orderBy("digit").rowsBetween(W.unboundedPreceding, W.currentRow))
        reached = counts.join(F.broadcast(wanted), ["i", "prefix"]).withColumn("upto", upto).where("upto > left AND upto - n <= left")
        for row in reached.collect():
            bits = row["digit"] if not step else (row["prefix"] << STEP_BITS) | row["digit"]
            found[row["i"], row["rank"]] = (bits, row["left"] - (row["upto"] - row["n"]))
    result = {}
    for i, name in enumerate(columns):
        result[name] = [_between(found, i, (totals[f"k{i}"] - 1) * p) if totals[f"k{i}"] else None for p in probabilities]
    return result


def _between(found: dict[tuple[int, int], tuple[int, int]], i: int, place: float) -> float:
    low, high = (double_of(found[i, rank][0]) for rank in (math.floor(place), math.ceil(place)))
    return low if low == high else low + (high - low) * (place - math.floor(place))
