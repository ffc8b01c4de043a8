"""Files are placed all or none."""

import os

import pytest
from framesift.operators import export
from pyspark.sql import functions as F

from tests.core.test_sources import jpeg, tiff


def tree(folder):
    """All files below a folder, with their bytes."""
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(folder) for f in fs}


@pytest.fixture
def files(spark, tmp_path):
    for name in "abcdef":
        path = tmp_path / "in" / name / f"{name}.jpg"
        path.parent.mkdir(parents=True)
        path.write_bytes(jpeg(tiff()) if name != "f" else b"no jpeg")
    rows = [(n, str(tmp_path / "in" / n / f"{n}.jpg"), f"star-{i % 3}/{n}.jpg", i) for i, n in enumerate("abcdefg")]
    return spark.createDataFrame(rows, "id string, path string, target string, rating int").repartition(3)


def dying(files):
    """The same rows, but the task with d's is killed when it gets there."""
    fail = F.when(F.col("id") == "d", F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("path"))
    return files.coalesce(1).sortWithinPartitions("id").withColumn("path", fail)


@pytest.mark.parametrize("move", [False, True])
def test_a_killed_task_changes_nothing_and_a_repeat_gives_the_same(spark, tmp_path, files, move):
    out, source = tmp_path / "out", tmp_path / "in"
    before = tree(source)
    with pytest.raises(Exception, match="killed"):
        export.place_files(dying(files), str(out), str(source), move)
    assert tree(out) == {} and tree(source) == before and not [d for d in os.listdir(tmp_path / "out") if d.startswith(".staged")] if out.exists() else True
    first = {r["id"]: r["status"] for r in export.place_files(files, str(out), str(source), move).collect()}
    assert first == dict.fromkeys("abcdef", "processed") | {"g": "skipped"}
    placed = tree(out)
    assert set(placed) == {f"star-{i % 3}/{n}.jpg" for i, n in enumerate("abcdef")} and sorted(placed.values()) == sorted(before.values())
    assert tree(source) == ({} if move else before)
    again = {r["id"]: r["status"] for r in export.place_files(files, str(out), str(source), move).collect()}
    assert again == first and tree(out) == placed


def test_ratings_are_written_all_or_none(spark, tmp_path, files):
    source = tmp_path / "in"
    before = tree(source)
    with pytest.raises(Exception, match="killed"):
        export.write_ratings(dying(files))
    assert tree(source) == before and not [d for _, ds, _ in os.walk(source) for d in ds if d.startswith(".staged")]
    found = {r["id"]: r["status"] for r in export.write_ratings(files).collect()}
    assert found == dict.fromkeys("abcde", "processed") | {"f": "failed", "g": "skipped"}
    after = tree(source)
    assert set(after) == set(before) and after["f/f.jpg"] == b"no jpeg" and after["d/d.jpg"] == export.rated_jpeg(before["d/d.jpg"], 3)
    assert {r["id"] for r in export.write_ratings(files).where("status = 'processed'").collect()} == set("abcde") and tree(source) == after


def test_no_files(spark, tmp_path, files):
    assert export.place_files(files.limit(0), str(tmp_path / "out"), str(tmp_path / "in")).count() == 0
