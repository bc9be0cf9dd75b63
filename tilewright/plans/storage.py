"""Tables in the shared folder, for plans that read a result more than once and must see the same rows each time."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees. Only a local session may leave it unset: it
    gets a temporary folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tilewright/{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Folders that this process has named, for clear().
_made: list[str] = []


def clear(spark: SparkSession) -> int:
    """Deletes the folders that queries of this process have written so far, once their results have been taken; returns
    how many there were. Results that aren't read yet are lost with them."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def durable(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an input's files, as the planner knows them, for each partition of an exchange of whole rows.
PART_BYTES = 32 << 20
#: Partitions of an exchange at most: beyond it they grow, as an exchange's blocks are the product of both its sides.
MAX_PARTS = 20_000


def partitions(spark: SparkSession, rows: DataFrame | None = None) -> int:
    """How many partitions a keyed exchange gets: the session's own setting, or more where the files below rows ask for
    it, so that a task's share stays level as the input grows. rows: a table as it is read, before any join."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    size = 0 if rows is None else int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # rows that aren't files have no size; the planner then says that they are immense
    return own if size >= 1 << 56 else max(own, min(MAX_PARTS, -(-size // PART_BYTES)))


def shared_path(spark: SparkSession) -> str:
    """A new folder of the shared folder, made and named as a plain path, for files that tasks write by themselves."""
    path = shared_dir(spark)
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError("spark.checkpoint.dir must be a mounted folder for files that tasks write by themselves")
    os.makedirs(path, exist_ok=True)
    return path
