"""Intermediate tables in the folder that every executor shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` (read from the
session), never by executor-local checkpoints: a lost executor then costs only
the tasks it ran.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one of our own only where none is set (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="leafmill-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a fresh shared path and return a reader of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes too, not by 10 000 rows of any length alone; a bound that the session has already stays."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, 4 << 20)


_shipped: set[str] = set()


def add_package(spark: SparkSession) -> None:
    """Ship this package to executors that do not see the driver's source tree; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="leafmill-"), "leafmill"), "zip", root, "leafmill")
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
