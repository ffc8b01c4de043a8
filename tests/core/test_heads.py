"""The data source of files' heads: ranges, filters on paths, errors of single files."""

import os

import pytest
from framesift.sources import heads
from pyspark.sql import functions as F


@pytest.fixture
def listing(spark, tmp_path):
    """Two folders of files, one of them very large and sparse, and one that is gone."""
    for name in ("a/one", "a/two", "b/three", "b/with space%20"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(name.encode() * 1000)
    with open(tmp_path / "b/sparse", "wb") as f:
        f.write(b"begin" * 100)
        f.truncate(1 << 40)
    paths = [str(tmp_path / n) for n in ("a/one", "a/two", "b/three", "b/with space%20", "b/sparse", "b/gone")] + [f"file://{tmp_path}/a/one", None]
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, number int")
    rows.repartition(3).write.parquet(f"file://{tmp_path}/listing")
    heads.register(spark)
    return f"file://{tmp_path}/listing"


def load(spark, listing, **options):
    reader = spark.read.format("file_heads").option("listing", listing)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def test_only_the_range_is_read(spark, listing):
    """Of a terabyte, as of any file, no more than asked for; what can't be read says why."""
    frame = load(spark, listing, bytes=100)
    assert frame.columns == ["path", "number", "head", "error"]
    found = {r["number"]: r for r in frame.collect()}
    assert len(found) == 8 and {len(found[i]["head"]) for i in (0, 1, 2, 3, 4, 6)} == {100}
    assert found[4]["head"] == b"begin" * 20 and found[6]["head"] == found[0]["head"] == (b"a/one" * 20)
    assert found[5]["head"] is None and "gone" in found[5]["error"] and found[7]["error"] == "no path"
    shifted = {r["number"]: bytes(r["head"] or b"") for r in load(spark, listing, bytes=7, offset=3).collect()}
    assert shifted[0] == b"nea/one" and shifted[4] == b"inbegin"


def test_filters_on_paths_are_pushed_down(spark, listing):
    """Other files are not opened: their rows never leave the source."""
    folder = os.path.dirname(listing.removeprefix("file://"))
    for condition, numbers in ((F.col("path").startswith(f"{folder}/a/"), [0, 1]), (F.col("path") == f"{folder}/b/three", [2]), (F.col("path").isin(f"{folder}/a/two", f"{folder}/b/three"), [1, 2])):
        frame = load(spark, listing, bytes=10).where(condition).where("number >= 0")
        assert sorted(r["number"] for r in frame.collect()) == numbers
        left = [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter (" in line or "Filter(" in line]
        assert not [line for line in left if folder in line and "BatchScan" not in line], left


def test_pushed_filters_choose_rows(tmp_path, spark, listing):
    """The reader by itself: what it keeps of a stretch, and what it leaves to Spark."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    schema = load(spark, listing).schema
    folder = os.path.dirname(listing.removeprefix("file://"))
    reader = heads.HeadsReader(listing, 5, 0, None, schema)
    left = list(reader.pushFilters([StringStartsWith(("path",), f"{folder}/a"), GreaterThan(("number",), 3), EqualTo(("number",), 3)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan", "EqualTo"]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["number"] for r in rows) == [0, 1] and {len(r["head"]) for r in rows} == {5}


def test_stretches_and_batches(spark, listing, monkeypatch):
    """However a listing is cut, each file is read once."""
    monkeypatch.setattr(heads, "PORTION", 1)
    monkeypatch.setattr(heads, "BATCH_BYTES", 8)
    reader = heads.HeadsReader(listing, 6, 0, None, load(spark, listing).schema)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(reader.partitions()) == 8 and sorted(r["number"] for r in rows) == list(range(8))


def test_missing_listing(spark, tmp_path):
    heads.register(spark)
    with pytest.raises(Exception, match="listing"):
        spark.read.format("file_heads").load().collect()
