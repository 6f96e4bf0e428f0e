"""Session settings and the shared scratch folder."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Settings that can be changed on a running session. Skewed join partitions are
# split even where that costs a later exchange: a hot listing may hold a third of all bookings.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("resaleworth")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SQL_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary folder only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="resaleworth-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by writing the rows to the shared folder and reading them back.

    A lost executor only costs its running tasks, and later reads prune columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of a part that ``spread`` makes: fewer are not worth a task of their own, more are too much for one.
LEAST_ROWS, MOST_ROWS = 2_000, 250_000


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a stored table in parts of even size, as many as there are cores or a multiple of that, each in the order of ``keys``.

    For rows that are small and take long: parts cut by bytes would leave most cores idle. The same rows give the same
    parts in the same order, on which the samples that forests draw depend.
    """
    cores, rows = df.sparkSession.sparkContext.defaultParallelism, df.count()
    waves = max(1, math.ceil(rows / (MOST_ROWS * cores)))
    parts = max(1, min(cores * waves, math.ceil(rows / LEAST_ROWS)))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys)
