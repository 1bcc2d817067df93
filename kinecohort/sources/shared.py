"""Intermediate tables, kept where every executor can read them again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, else the context's checkpoint directory.

    Only a local-mode session without either gets a temporary folder, which is removed when
    Python ends; a cluster without them is an error, since a machine-local folder would not survive an
    executor.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_dirs:
        made = _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="kinecohort-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return _local_dirs[context.applicationId]


def application_dir(spark: SparkSession) -> str:
    """The folder of the tables that this application wrote for itself."""
    return f"{shared_dir(spark)}/kinecohort/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the tables that this application wrote for itself.

    For the end of a job, when results are written elsewhere: DataFrames made by this package
    read those tables.
    """
    delete(spark, application_dir(spark))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that this application wrote for itself and no DataFrame in use reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path not used before; all of an application's lie in one folder, to be removed with it."""
    return f"{application_dir(spark)}/{label}-{uuid4().hex}"


#: Whether shuffle files go when the query that wrote them ends; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, drop_shuffles: bool = False) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    Cuts the lineage, so that a lost executor repeats a read instead of the whole plan,
    and fixes values (such as row positions) that a second evaluation might not repeat.
    With drop_shuffles, the shuffle files behind df go as soon as it is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    if drop_shuffles:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles and before is None:
            spark.conf.unset(_CLEANUP)
        elif drop_shuffles:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
