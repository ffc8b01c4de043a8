"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='framesift-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths written in each open scope, the innermost last.
_scopes: list[set[str]] = []


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder, on whatever file system it would be."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(place) and system.getFileStatus(place).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, by whatever file system it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[set[str]]:
    """Tables that are written within go at its end, but for paths that are taken out of the set it gives.

    What is lazy must be written before the end: a frame that still reads such a table can't be run any more.
    """
    paths: set[str] = set()
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes.remove(paths)
        for path in paths:
            remove(spark, path)


def written(df: DataFrame, *partition_by: str) -> str:
    """``df`` written as Parquet to a new folder below the shared one: the folder's path."""
    path = f"{shared_dir(df.sparkSession)}/framesift-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].add(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return path


def saved(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a lost executor costs no recomputation."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, *partition_by))
