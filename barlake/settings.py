"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings: results (not only speed) depend on them.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # symbol=007 must stay text when a partitioned table is read back
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # a JSON object that repeats a key keeps the last value
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # folders listed at once are dealt to so many tasks: the default is a task for each of up to 10,000 folders
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # the JVM does not compile longer methods: rows of many number columns are then projected in several
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and hand it back."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path for one run's intermediate tables.

    The root comes from Spark's own settings, by one rule for every master:
    the folder named in ``spark.checkpoint.dir``, else a folder under
    ``spark.sql.warehouse.dir``. Both are shared by driver and executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of a run's own, on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def local_path(spark: SparkSession, path: str) -> str | None:
    """Where tasks find an existing folder with plain file calls; None where it is not there or lies on another file system.

    Work folders and sources are shared by driver and executors, so a ``file:`` path is the same folder on all of them.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file" or not files.exists(target) or not files.getFileStatus(target).isDirectory():
        return None
    return files.makeQualified(target).toUri().getPath()
