"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

RUN = uuid.uuid4().hex
#: How often scratch was cleared; stored results of before are gone.
clearings = 0


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="riskloom-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_folder()


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/riskloom-{RUN}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_run_folder(spark)}/{uuid.uuid4().hex}/{name}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """For tasks that read stored files themselves: the file system of a URI or plain path, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this driver process stored with ``materialise``; call it when no result is needed any more."""
    global clearings
    clearings += 1
    folder = spark._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once and read it back.

    The copy survives lost executors, has no lineage, and gives the optimizer real
    sizes, so small results are broadcast and large ones are not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
