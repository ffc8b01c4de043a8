"""Sessions, made-up pictures and writing in place on literal rows."""

import pytest
from framesift.operators import analysis, catalogue, export, session, shape
from framesift.sources import synthetic
from pyspark.sql import functions as F

ORDER = "project_id string, pos int, id string"


def order(spark, ids):
    return spark.createDataFrame([("p", k, i) for k, i in enumerate(ids)], ORDER)


def listed(frame):
    return "".join(r["id"] for r in frame.orderBy("pos").collect())


def test_collapse(spark):
    blocks = spark.createDataFrame([("p", i, "c") for i in "bcd"], "project_id string, id string, representative string")
    assert listed(session.collapsed(order(spark, "abxdc"), blocks)) == "acx"
    ids = spark.range(1).select(session.collapsed_list(F.lit(list("abxdc")), F.lit(list("bcd")), F.lit("c")).alias("x")).first()["x"]
    assert ids == ["a", "c", "x"]


def test_released_come_next(spark):
    run = order(spark, "abc").withColumn("run", F.lit(0)).withColumn("cut", F.col("pos") == 2)
    free = session.released(shape.blocks(run), order(spark, "abc"))
    assert listed(free) == "c"
    current = spark.createDataFrame([("p", 1)], "project_id string, last int")
    assert listed(session.upcoming(order(spark, "axby"), current, order(spark, "cad"))) == "axcdby"
    assert listed(session.upcoming(order(spark, "axby"), current, order(spark, ""))) == "axby"


def test_create_and_delete_project(spark, tmp_path):
    projects = spark.createDataFrame([("a", "A", 3)], "id string, name string, photo_count bigint")
    after = session.create_project(projects, "b", "B", str(tmp_path), 5)
    assert {tuple(r) for r in after.collect()} == {("a", "A", 3), ("b", "B", 0)}
    with pytest.raises(ValueError, match="project b"):
        session.create_project(after, "b", "B", str(tmp_path), 5)
    (tmp_path / "file").write_bytes(b"")
    for gone in (f"{tmp_path}/gone", f"{tmp_path}/file"):
        with pytest.raises(ValueError, match="no folder"):
            session.create_project(projects, "c", "C", gone, 5)
    photos = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "project_id string, n int")
    left, rows = catalogue.delete_project(after, "a", photos)
    assert [r["id"] for r in left.collect()] == ["b"] and sorted(r["n"] for r in rows.collect()) == [2, 3]
    with pytest.raises(ValueError, match="no project a"):
        catalogue.delete_project(left, "a", photos)


def test_pictures(spark):
    rows = synthetic.pictures(spark, 2, 9).orderBy("name").collect()
    assert rows[1]["name"] == "synthetic-000001.jpg" and rows[0]["red"][:3] == [0, 4, 8] and rows[1]["red"][0] == 37 and rows[1]["green"][9] == 16 and rows[1]["blue"][10] == 7
    grids = synthetic.pictures(spark, 3, 9).select("name", *(F.slice(c, 1, 72).alias(c) for c in ("red", "green", "blue")))
    assert analysis.hashes_of_pixels(grids).where("d_hash is null").count() == 0


def test_write_ratings(spark, tmp_path):
    data = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02pixels\xff\xd9"
    (tmp_path / "a.jpg").write_bytes(data)
    (tmp_path / "b.jpg").write_bytes(b"no picture")
    files = spark.createDataFrame([(n, f"{tmp_path}/{n}.jpg", 4) for n in "abc"], "id string, path string, rating int")
    assert {r["id"]: r["status"] for r in export.write_ratings(files).collect()} == {"a": "processed", "b": "failed", "c": "skipped"}
    assert b"<xmp:Rating>4<" in (tmp_path / "a.jpg").read_bytes() and (tmp_path / "b.jpg").read_bytes() == b"no picture"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.jpg", "b.jpg"]
