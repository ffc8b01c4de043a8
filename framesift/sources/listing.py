"""Listings of media folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions.capture import extension
from framesift.schema import EXTENSIONS

def scan(spark: SparkSession, folder: str, project: str) -> DataFrame:
    """Pictures below a folder: project_id, path, relative_path, name, mtime (ms) and size.

    Subfolders are searched, extensions compared in lower case, unreadable entries left out. File contents are
    not read: the columns of the reader that hold them are pruned.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(folder)
    root = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.regexp_replace("path", "^file:(//)?", "")
    rows = files.select(path.alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))
    within = F.when(F.startswith("path", F.lit(root + "/")), F.substr("path", F.lit(len(root) + 2))).otherwise(F.col("path"))
    named = rows.withColumn("relative_path", within).withColumn("name", F.substring_index("path", "/", -1))
    return named.where(extension(F.col("name")).isin(*EXTENSIONS)).select(F.lit(project).alias("project_id"), "path", "relative_path", "name", "mtime", "size")


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """Path and whole content of every file below a folder, by any path that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
