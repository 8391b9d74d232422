"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder of this machine if it is unset and all runs in this process, else an error."""
    global _own_folder
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_folder


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame) -> DataFrame:
    """df written once and read back, so that all later stages and retries see the same rows. The files go by discard(), at the
    latest when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidemark_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later plan reads."""
    for table in tables:
        path = getattr(table, "_tidemark_path", None)
        if path:
            at, files = _files(table.sparkSession, path)
            files.delete(at, True)
