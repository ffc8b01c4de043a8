"""Catalogues that are stored: rescans that touch what changed, and columns in tables of their own.

A catalogue is kept in folders by project and by a hash of the path. A rescan reads the folders of the projects that were
scanned and writes those in which a row changes. Wide columns (thumbnails, display pictures, originals) are tables of
their own, bucketed alike, so that listing photos never drags bytes along and putting them together shuffles nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.operators.catalogue import upsert
from framesift.storage import saved, shared_dir

#: Folders of a project, and buckets of a table.
FOLDERS, BUCKETS = 16, 16
KEYS = ("project_id", "id")


def _folder(folders: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(folders)).cast("int").alias("folder")


def write_catalogue(photos: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Photos as Parquet by project and folder; the number of folders is that of the catalogue for good."""
    rows = photos.withColumn("folder", _folder(folders))
    rows.repartition("project_id", "folder").write.partitionBy("project_id", "folder").option("compression", "zstd").parquet(path)


def read_catalogue(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored catalogue, its columns as ``schema`` has them, with ``folder``."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("folder", T.IntegerType())])).parquet(path)


def rescan(spark: SparkSession, path: str, schema, listing: DataFrame, folders: int = FOLDERS) -> DataFrame:
    """Bring a stored catalogue up to a listing as ``upsert`` does: (project_id, folder) of what was written.

    Only folders of listed projects are read, and only those with a new, changed or vanished file are written, so a
    rescan that finds nothing new writes nothing. What is to be written is in the shared folder before it replaces anything.
    A listing names a few projects; their names go to the driver.
    """
    projects = [r[0] for r in listing.select("project_id").distinct().collect()]
    names = schema.names
    before = read_catalogue(spark, path, schema).where(F.col("project_id").isin(projects)).select(*names)
    after = upsert(before, listing).withColumn("folder", _folder(folders))
    row = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in names))
    was = before.select("project_id", "path", row.alias("_was"))
    compared = saved(after.withColumn("_now", row).join(was, ["project_id", "path"], "left"))
    changed = saved(compared.where(~F.col("_now").eqNullSafe(F.col("_was"))).select("project_id", "folder").distinct())
    rows = saved(compared.join(changed, ["project_id", "folder"], "left_semi").select(*names, "folder"))
    rows.repartition("project_id", "folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("project_id", "folder").parquet(path)
    return changed


def write_parts(photos: DataFrame, wide: Mapping[str, list[str]], buckets: int = BUCKETS) -> dict[str, str]:
    """Tables bucketed alike by project and id: ``photos`` without wide columns, and one for each of ``wide`` (table to its columns), with rows that have any.

    Returns the names of the tables, which are in the catalogue of the session and below the shared folder.
    """
    spark, run = photos.sparkSession, uuid.uuid4().hex
    dragged = {c for columns in wide.values() for c in columns}
    parts = {"photos": photos.drop(*dragged)}
    for name, columns in wide.items():
        parts[name] = photos.select(*KEYS, *columns).where(reduce(Column.__or__, (F.col(c).isNotNull() for c in columns)))
    out = {}
    for name, rows in parts.items():
        out[name] = f"{name}_{run}"
        writer = rows.repartition(buckets, *KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS).format("parquet")
        writer.option("path", f"{shared_dir(spark)}/{out[name]}").saveAsTable(out[name])
    return out


def together(spark: SparkSession, tables: Mapping[str, str], *wide: str) -> DataFrame:
    """Photos with the wide columns asked for, null where there are none; buckets meet as they are stored."""
    rows = spark.table(tables["photos"])
    for name in wide:
        rows = rows.join(spark.table(tables[name]).hint("merge"), list(KEYS), "left")
    return rows
