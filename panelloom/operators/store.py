"""Written intermediates.

A table that several later stages read is written once to the folder the cluster names in
``spark.checkpoint.dir``. That cuts the lineage in a way that survives lost executors, gives
the optimizer true sizes (so it broadcasts a side only when the written files are small),
and makes every reader see the very same floating-point values. What was shuffled for it is
deleted when it is written, since nothing reads it again.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only for local masters."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT or not os.path.isdir(_LOCAL_ROOT[app]):
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_ROOT[app]


def new_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/panelloom/{app}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each query begun inside when it ends, not when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and return a DataFrame over the files."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    with shuffles_dropped(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a written table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))


def written_by_key(df: DataFrame, label: str, key: str, order: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` bucketed by ``key`` and sorted within the buckets.

    Later windows and joins on ``key`` then read co-located data and need no shuffle. One key
    stays in one bucket, so use it only where a key has a bounded number of rows (one per month).
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, label)
    name = f"loom_{label}_{uuid.uuid4().hex[:12]}"
    (
        df.repartition(buckets, key)
        .write.bucketBy(buckets, key)
        .sortBy(key, order)
        .option("path", path)
        .format("parquet")
        .saveAsTable(name)
    )
    return spark.table(name)


def drop_written(spark: SparkSession) -> bool:
    """Delete everything this application wrote through this module."""
    for t in spark.catalog.listTables():
        if t.name.startswith("loom_") and t.tableType == "EXTERNAL":
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    return remove(spark, f"{scratch_root(spark)}/panelloom/{spark.sparkContext.applicationId}")
