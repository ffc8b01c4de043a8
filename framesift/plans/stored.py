"""Registered queries: stored pictures and catalogues. The pictures are made of the embeddings, a square for each entry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions.hashing import difference_hash, hash_text
from framesift.operators import pictures
from framesift.operators import stored as tables
from framesift.plans import views
from framesift.plans.queries import query
from framesift.plans.views import PHOTOS
from framesift.storage import shared_dir

_SIDE = 8
# Entries as even steps of brightness, four apart, so that a picture of the best quality keeps them apart.
_CELLS = """cells AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) - CAST(list_min(embedding) AS DOUBLE)) / (CAST(list_max(embedding) AS DOUBLE) - CAST(list_min(embedding) AS DOUBLE)) * 63) AS INTEGER) * 4) AS cells
FROM embeddings WHERE len(embedding) = 64 AND list_max(embedding) > list_min(embedding))"""
_BITS = " + ".join(f"CASE WHEN cells[{_SIDE * y + x + 1}] > cells[{_SIDE * y + x + 2}] THEN {1 << (y * (_SIDE - 1) + x)} ELSE 0 END" for y in range(_SIDE) for x in range(_SIDE - 1))


def _mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, content): an embedding as a picture of 64 x 64 pixels."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    low, high = F.array_min("e"), F.array_max("e")
    even = rows.where((F.size("e") == _SIDE * _SIDE) & (high > low)).withColumn("cells", F.transform("e", lambda x: F.floor((x - low) / (high - low) * 63).cast("int") * 4))
    return pictures.mosaics(even, "cells", _SIDE, ("vec_id",))


@query(f"WITH {_CELLS} SELECT vec_id, array_to_string(cells, ',') AS cells, lower(lpad(to_hex(CAST({_BITS} AS BIGINT)), 16, '0')) AS d_hash FROM cells")
def mosaic_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures written as JPEG files and read at an eighth of their size have the brightness and the hash of what they were made of."""
    found = pictures.cells_of(_mosaics(spark, sf_dir), ("vec_id",))
    return found.select("vec_id", F.array_join(F.transform("cells", lambda c: c.cast("string")), ",").alias("cells"), hash_text(difference_hash(F.col("cells"), _SIDE, _SIDE)).alias("d_hash"))


@query(f"""WITH {_CELLS}, asked AS (SELECT vec_id, CASE WHEN vec_id % 4 > 0 THEN 40 + vec_id % 3 * 8 END AS stored, 40 + vec_id % 5 * 8 AS edge FROM cells)
SELECT vec_id, CAST(edge AS INTEGER) AS edge, CASE WHEN stored >= edge THEN 'stored' ELSE 'original' END AS origin, CAST(least(64, edge) AS INTEGER) AS side FROM asked""")
def display_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A display picture comes from the one that is stored if that is as large, else from the original, and is never enlarged."""
    key = F.col("vec_id")
    originals = _mosaics(spark, sf_dir).select("vec_id", F.col("content").alias("original"), F.lit(1).alias("orientation"), (40 + key % 3 * 8).cast("int").alias("stored"), (40 + key % 5 * 8).cast("int").alias("edge"))
    first = pictures.display(originals.withColumn("display", F.lit(None).cast("binary")).withColumn("display_edge", F.lit(None).cast("int")), F.col("stored"), ("vec_id", "original", "orientation", "edge"))
    kept = first.drop("origin", "error").withColumn("display", F.when(key % 4 > 0, F.col("display")))
    built = pictures.display(kept, F.col("edge"), ("vec_id",))
    return pictures.sizes_of(built, ("vec_id", "display_edge", "origin"), "display").select("vec_id", F.col("display_edge").alias("edge"), "origin", F.greatest("width", "height").alias("side"))


_RESCANNED = f"""{PHOTOS}, files AS (SELECT id, project_id, '/m/' || relative_path AS path, captured_at, d_hash, rating, fingerprint_mtime, fingerprint_size FROM photos WHERE CAST(id AS BIGINT) % 10 <> 0),
listing AS (SELECT project_id, '/m/' || relative_path AS path, fingerprint_mtime AS mtime, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN fingerprint_size + 1 ELSE fingerprint_size END AS size FROM photos WHERE project_id = 'error' AND CAST(id AS BIGINT) % 13 <> 0)"""


@query(f"""WITH {_RESCANNED}
SELECT project_id, path, CASE WHEN project_id <> 'error' OR l.path IS NULL OR (f.path IS NOT NULL AND f.fingerprint_mtime IS NOT DISTINCT FROM l.mtime AND f.fingerprint_size IS NOT DISTINCT FROM l.size) THEN f.d_hash END AS d_hash,
  coalesce(f.rating, 0) AS rating, CASE WHEN l.path IS NULL THEN f.fingerprint_size ELSE l.size END AS fingerprint_size, CASE WHEN project_id = 'error' THEN l.path IS NULL ELSE false END AS is_missing
FROM files f FULL JOIN listing l USING (project_id, path)""")
def rescan_of_one_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored catalogue after a rescan of one of its projects."""
    number, path = F.col("id").cast("bigint"), f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    photos = views.photos(spark, sf_dir).withColumn("path", F.concat(F.lit("/m/"), "relative_path")).withColumn("name", F.col("relative_path"))
    size = F.when(number % 7 == 0, F.col("fingerprint_size") + 1).otherwise(F.col("fingerprint_size"))
    listing = photos.where((F.col("project_id") == "error") & (number % 13 != 0)).select("project_id", "path", "relative_path", "name", F.col("fingerprint_mtime").alias("mtime"), size.alias("size"))
    known = photos.where(number % 10 != 0).withColumn("is_missing", F.lit(False))
    tables.write_catalogue(known, path)
    tables.rescan(spark, path, known.schema, listing)
    return tables.read_catalogue(spark, path, known.schema).select("project_id", "path", "d_hash", "rating", "fingerprint_size", "is_missing")


@query(f"""WITH {PHOTOS} SELECT project_id, id, rating, CASE WHEN CAST(id AS BIGINT) % 3 > 0 THEN 'thumbnail ' || id END AS thumbnail, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'display ' || id END AS display,
CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN id || '.raw' END AS original FROM photos""")
def photos_with_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos and what is stored of them in tables of their own, joined bucket by bucket."""
    number = F.col("id").cast("bigint")
    photos = views.photos(spark, sf_dir).select("project_id", "id", "rating")
    wide = photos.withColumn("thumbnail", F.when(number % 3 > 0, F.concat(F.lit("thumbnail "), "id"))).withColumn("display", F.when(number % 5 == 0, F.concat(F.lit("display "), "id")))
    parts = tables.write_parts(wide.withColumn("original", F.when(number % 7 == 0, F.concat("id", F.lit(".raw")))), {"thumbnails": ["thumbnail"], "displays": ["display"], "originals": ["original"]})
    return tables.together(spark, parts, "thumbnails", "displays", "originals")
