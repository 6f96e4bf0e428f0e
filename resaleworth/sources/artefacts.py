"""Snapshots, fitted artefacts, predictions and leaderboards on shared storage."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_snapshot(df: DataFrame, path: str) -> None:
    """Train and test rows, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_snapshot(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Reading one split prunes the other folder."""
    rows = spark.read.parquet(path)
    return rows if split is None else rows.where(F.col("split") == split)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_leaderboard(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def publish_artefacts(
    root: str, version: str, transforms: PipelineModel, model: Any, spark: SparkSession, manifest: Mapping[str, Any] | None = None
) -> str:
    """Write both artefacts and the manifest below a folder of their own, then announce the version.

    The announcement comes last, so a reader never resolves a half-written version.
    """
    path = f"{root}/artefacts/{version}"
    transforms.write().overwrite().save(f"{path}/transforms")
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(dict(manifest or {})),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    announced = spark.createDataFrame([(version,)], "version string").withColumn("published_at", F.current_timestamp())
    announced.write.mode("append").parquet(f"{root}/versions")
    return path


def read_manifest(spark: SparkSession, root: str, version: str) -> dict[str, Any]:
    """What a version was published with; empty for one without a manifest."""
    return json.loads(spark.read.text(f"{root}/artefacts/{version}/manifest").first()["value"])


def version_name(digest: str) -> str:
    """A folder of its own for each attempt at a run."""
    return f"{digest}-{uuid.uuid4().hex[:8]}"


def published_run(spark: SparkSession, root: str, digest: str) -> str | None:
    """The version that a digest points to, if that run is published."""
    return read_once(spark, f"{root}/runs/{digest}")


def claim_run(spark: SparkSession, root: str, digest: str, version: str) -> str:
    """Point the digest to ``version`` unless it points somewhere already; returns where it points."""
    return write_once(spark, f"{root}/runs/{digest}", version)


def write_once(spark: SparkSession, path: str, value: str) -> str:
    """Create a small file unless it is there; returns its content, which is the value of whoever came first.

    The value is written to a name of its own and becomes visible by a create that fails if the file exists.
    """
    there = read_once(spark, path)
    if there is not None:
        return there
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    try:
        stream = files.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
            raise
        return _awaited(spark, path)
    stream.write(bytearray(f"{value}\n".encode()))
    stream.close()
    return value


def read_once(spark: SparkSession, path: str) -> str | None:
    """The content of such a file; None if it is not there or its writer has not finished it yet."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return None
    stream = files.open(target)
    text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text[:-1] if text.endswith("\n") else None


def _awaited(spark: SparkSession, path: str, seconds: int = 60) -> str:
    """What another writer is just writing; a writer that died in between is an error, and its file may be removed."""
    for _ in range(seconds * 10):
        text = read_once(spark, path)
        if text is not None:
            return text
        time.sleep(0.1)
    raise TimeoutError(f"{path} was created but never written")


def latest_version(spark: SparkSession, root: str) -> str | None:
    try:
        versions = spark.read.parquet(f"{root}/versions")
    except AnalysisException:
        return None
    return versions.agg(F.max_by("version", F.struct("published_at", "version"))).first()[0]


def load_artefacts(spark: SparkSession, root: str, version: str | None = None) -> tuple[PipelineModel, Any]:
    """The fitted transforms and model of a version, by default the latest."""
    version = version or latest_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no published version below {root}")
    path = f"{root}/artefacts/{version}"
    transforms = PipelineModel.load(f"{path}/transforms")
    model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark.sparkContext)
    return transforms, model
