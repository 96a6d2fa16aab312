"""Helpers shared by the training-data operators: the shared folder, stored tables and file access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, with its file system.

    Where it is unset, a local master gets a temporary one; any other must name one, as its executors share no local folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="groupwise-")
        context.setCheckpointDir(named)
        named = context.getCheckpointDir()
    path = context._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def tasks_for(spark: SparkSession, total_bytes: int, task_bytes: int = 64_000_000, least_bytes: int = 1_000_000) -> int:
    """Tasks for an amount of data: one for each task_bytes, but where there is little, as many as keep three rounds of all cores busy with least_bytes or more."""
    small = min(-(-total_bytes // least_bytes), 3 * spark.sparkContext.defaultParallelism)
    return max(1, -(-total_bytes // task_bytes), small)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def field(df: DataFrame, column: str, name: str | None = None) -> T.StructField:
    return T.StructField(name or column, df.schema[column].dataType, True)


def filesystem(uri: str):
    """(file system, path) by pyarrow, for files that tasks write to or read from the shared folder."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return fs.LocalFileSystem(), uri


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
