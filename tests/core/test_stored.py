"""Stored catalogues against whole upserts, and joins that shuffle nothing."""

import os

import pytest
from framesift import storage
from framesift.operators import catalogue, stored
from pyspark.sql import functions as F

SCHEMA = "id string, project_id string, path string, relative_path string, name string, captured_at bigint, d_hash string, rating int, fingerprint_mtime bigint, fingerprint_size bigint, is_missing boolean"


@pytest.fixture
def photos(spark):
    rows = [(f"{i}", f"p{i % 50}", f"/m/{i}.jpg", f"{i}.jpg", f"{i}.jpg", i, "0" * 16, i % 6, i, 10, False) for i in range(2000)]
    return spark.createDataFrame(rows, SCHEMA)


def listing_of(photos, project):
    """One project's files: one has changed, one is gone, one is new."""
    of = photos.where(F.col("project_id") == project)
    ids = sorted(int(r["id"]) for r in of.select("id").collect())
    rows = of.where(F.col("id") != str(ids[0])).select("project_id", "path", "relative_path", "name", F.col("fingerprint_mtime").alias("mtime"), F.when(F.col("id") == str(ids[1]), 11).otherwise(10).cast("bigint").alias("size"))
    return rows.union(photos.sparkSession.createDataFrame([(project, "/m/new.jpg", "new.jpg", "new.jpg", 1, 1)], rows.schema))


def files(folder):
    return {os.path.relpath(os.path.join(d, f), folder): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_a_rescan_writes_the_folders_that_change(spark, photos, tmp_path):
    path = f"file://{tmp_path}/c"
    stored.write_catalogue(photos, path, 8)
    before = files(f"{tmp_path}/c")
    listing = listing_of(photos, "p7")
    written = {(r["project_id"], r["folder"]) for r in stored.rescan(spark, path, photos.schema, listing, 8).collect()}
    after = files(f"{tmp_path}/c")
    assert 0 < len(written) <= 3 and {p for p, _ in written} == {"p7"}
    touched = {os.path.dirname(f) for f in set(before.items()) ^ set(after.items()) for f in [f[0]]}
    assert touched == {f"project_id={p}/folder={n}" for p, n in written}
    found = stored.read_catalogue(spark, path, photos.schema).drop("folder").select(*photos.columns)
    expected = catalogue.upsert(photos, listing).select(*photos.columns)
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()
    assert stored.rescan(spark, path, photos.schema, listing, 8).isEmpty()  # nothing new
    assert files(f"{tmp_path}/c") == after


def test_only_scanned_projects_are_read(spark, photos, tmp_path):
    path = f"file://{tmp_path}/c"
    stored.write_catalogue(photos, path, 4)
    plan = stored.read_catalogue(spark, path, photos.schema).where(F.col("project_id").isin("p1"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(project_id" in plan or "PartitionFilters: [isnotnull(project_id" in plan


def test_an_empty_listing_changes_nothing(spark, photos, tmp_path):
    path = f"file://{tmp_path}/c"
    stored.write_catalogue(photos, path, 4)
    before = files(f"{tmp_path}/c")
    assert stored.rescan(spark, path, photos.schema, listing_of(photos, "p1").limit(0), 4).isEmpty() and files(f"{tmp_path}/c") == before


def test_parts_meet_without_a_shuffle(spark, photos):
    wide = photos.withColumn("thumbnail", F.when(F.col("rating") > 2, F.encode("id", "utf-8"))).withColumn("display", F.when(F.col("rating") == 0, F.encode("path", "utf-8")))
    tables = stored.write_parts(wide, {"thumbnails": ["thumbnail"], "displays": ["display"]}, 4)
    rows = stored.together(spark, tables, "thumbnails", "displays")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 2
    found = rows.select(*wide.columns)
    assert found.exceptAll(wide).isEmpty() and wide.exceptAll(found).isEmpty()
    assert "thumbnail" not in spark.table(tables["photos"]).columns and spark.table(tables["displays"]).count() == photos.where("rating = 0").count()


def test_scopes(spark):
    """Tables go at the end of the scope they were written in, but for what is taken out of it; those of no scope stay."""
    there = lambda path: os.path.isdir(path.removeprefix("file://"))
    outside = storage.written(spark.range(3))
    with storage.scope(spark) as passing:
        first = storage.written(spark.range(3))
        with storage.scope(spark):
            inner = storage.written(spark.range(2))
            assert there(inner)
        kept = storage.written(spark.range(5))
        passing.remove(kept)
        assert there(first) and not there(inner)
    assert there(outside) and there(kept) and not there(first) and spark.read.parquet(kept).count() == 5
    with pytest.raises(RuntimeError), storage.scope(spark):
        failed = storage.written(spark.range(1))
        raise RuntimeError
    assert not there(failed) and not storage._scopes
