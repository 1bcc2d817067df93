"""Subject tables (CSV) and sensor series (parquet per subject)."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinecohort.functions.columns import col
from kinecohort.sources.shared import delete

# How Spark names the directory of a partition value, and where it keeps a table's schema in a file.
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_SCHEMA_KEY = "org.apache.spark.sql.parquet.row.metadata"
# Types that Arrow and Spark write to Parquet alike.
_PLAIN_TYPES = (
    T.StringType(), T.BinaryType(), T.BooleanType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(),
)
#: Rows of a subject from which dictionaries of values are worth their time.
_MANY = 1000
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "FAILFAST") -> DataFrame:
    """CSV with a header and an explicit schema; empty fields are null.

    A cell that is not of its column's type is an error; with ``mode="PERMISSIVE"`` it is null.
    """
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode=mode)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_series(
    spark: SparkSession, root: str, schema: T.StructType | None = None, id: str = "id"
) -> DataFrame:
    """All series below ``root``, one ``<id>=<subject>`` directory each, ids as strings.

    Without a schema, the type of the directory values is inferred by the session unless
    ``spark.sql.sources.partitionColumnTypeInference.enabled`` is off, and ``001`` would
    become 1. So the schema is read first and the id set to a string in it.
    """
    if schema is None:
        first = _first_directory(spark, root, id)
        one = spark.read.parquet(root) if first is None else spark.read.option("basePath", root).parquet(first)
        schema = one.schema
    fields = [f for f in schema.fields if f.name != id] + [T.StructField(id, T.StringType())]
    with _few_listing_tasks(spark):
        return spark.read.schema(T.StructType(fields)).parquet(root)


def _first_directory(spark: SparkSession, root: str, id: str) -> str | None:
    """The first subject's directory, from which a schema is read as from all of them, without listing each."""
    if re.search(r"[*?\[\]{}\\]", f"{root}{id}"):
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(root, f"{id}=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)  # in order of their names
    return found[0].getPath().toString() if found and found[0].isDirectory() else None


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Directories are listed by a few tasks for each core; by default it is one for each directory, up to 10,000."""
    before = spark.conf.get(_LISTING, None)
    spark.conf.set(_LISTING, str(min(int(before or 10_000), max(16, 4 * spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.unset(_LISTING) if before is None else spark.conf.set(_LISTING, before)


def write_series(df: DataFrame, root: str, id: str = "id") -> None:
    """Lay series out as one directory per subject.

    Rebalancing groups a subject's rows but lets adaptive execution split a large subject
    over several tasks and files. On a file system of the machine, where Spark starts several processes for each file to
    set its mode, tasks write the files themselves, below another name that is changed when all are done.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    plain = all(f.dataType in _PLAIN_TYPES for f in df.schema.fields if f.name != id)
    if fs.getUri().getScheme() != "file" or not plain or len(df.columns) < 2 or fs.exists(at):
        df.hint("rebalance", id).write.partitionBy(id).parquet(root)
        return
    at = fs.makeQualified(at)
    made = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid4().hex}")
    fs.mkdirs(made)
    try:
        _write_directories(df, made.toUri().getPath(), id)
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(made, "_SUCCESS")).close()
        if not fs.rename(made, at):
            raise OSError(f"cannot rename {made} to {at}")
    except BaseException:
        delete(spark, made.toString())
        raise


def _write_directories(df: DataFrame, root: str, id: str) -> None:
    """Files of one subject's rows each, a task's one after another; a task that runs twice writes the same names."""
    fields = [f for f in df.schema.fields if f.name != id]
    stored = {_SCHEMA_KEY: T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in fields]).json()}
    job = uuid4().hex
    # An empty id is as good as none, as in Spark's own directories.
    name = F.coalesce(F.nullif(col(id).cast("string"), F.lit("")), F.lit(_NO_VALUE))
    rows = df.hint("rebalance", id).sortWithinPartitions(name).select(name.alias("_directory"), *[col(f.name) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = f"part-{context.partitionId():05d}-{job}.snappy.parquet"
        own = f".{part}-{context.taskAttemptId()}"
        current, writer, folder = None, None, ""

        def close() -> None:
            if writer is not None:
                writer.close()
                os.replace(f"{folder}/{own}", f"{folder}/{part}")

        count = 0
        for batch in batches:
            ends = pc.run_end_encode(batch.column(0))
            names, ends, start = ends.values.to_pylist(), ends.run_ends.to_pylist(), 0
            data = batch.select(range(1, batch.num_columns))
            for value, end in zip(names, ends):
                if value != current or writer is None:
                    close()
                    escaped = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value)
                    current, folder = value, f"{root}/{id_}={escaped}"
                    os.makedirs(folder, exist_ok=True)
                    writer = pq.ParquetWriter(
                        f"{folder}/{own}", data.schema.with_metadata(stored),
                        compression="snappy", use_dictionary=end - start >= _MANY, store_schema=False,
                    )
                writer.write_batch(data.slice(start, end - start).replace_schema_metadata(stored))
                start, count = end, count + end - start
        close()
        yield pa.record_batch([pa.array([count])], ["n"])

    id_ = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", id)
    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def series_inventory(series: DataFrame, id: str = "id") -> DataFrame:
    """Rows, files and bytes per subject. No data column is read."""
    per_file = series.groupBy(
        col(id), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")
    ).agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy(col(id)).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("n_bytes")
    )


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)
