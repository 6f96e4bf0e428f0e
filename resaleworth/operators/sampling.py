"""Split, oversampling, shuffling and sampling, all stable under repartitioning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from resaleworth import config

BUCKETS = 10_000


def hash_bucket(key: Column, seed: int) -> Column:
    """0 … 9999 from the row key alone, so a row keeps its bucket wherever it is processed."""
    digest = F.md5(F.concat(F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % BUCKETS


def with_split(
    df: DataFrame, key: str = "id", test_share: float = config.TEST_SHARE, seed: int = config.SPLIT_SEED
) -> DataFrame:
    is_test = hash_bucket(F.col(key), seed) < round(test_share * BUCKETS)
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def fold_of(key: Column, folds: int, seed: int) -> Column:
    return (hash_bucket(key, seed) % folds).cast("int")


def is_recent(created: Column, as_of: dt.date, days: int = config.RECENT_DAYS) -> Column:
    since = dt.datetime.combine(as_of, dt.time()) - dt.timedelta(days=days)
    return F.coalesce(created >= F.lit(since.isoformat(sep=" ")).cast("timestamp"), F.lit(False))


def oversample(df: DataFrame, condition: Column, copies: int = config.RECENT_COPIES) -> DataFrame:
    """Each row once as ``copy_no`` 0, rows under ``condition`` also as 1 … ``copies``, in one pass."""
    last = F.when(condition, F.lit(copies)).otherwise(F.lit(0))
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), last)))


def oversample_recent(
    df: DataFrame,
    as_of: dt.date,
    created: str = "bike_created_at",
    days: int = config.RECENT_DAYS,
    copies: int = config.RECENT_COPIES,
) -> DataFrame:
    return oversample(df, is_recent(F.col(created), as_of, days), copies)


def shuffled(df: DataFrame, keys: list[str], seed: int = config.SHUFFLE_SEED) -> DataFrame:
    """Rows in a seeded order. Not needed before a fit; for exports that are read in file order."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)


def hash_sample(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """The same share of rows on every run; the sampling operator behind subset checks."""
    return df.where(hash_bucket(F.col(key), seed) < round(share * BUCKETS))
