"""Literal cases of sequences, and properties against a plain version."""

import random

import pytest
from framesift.operators import sequence
from framesift.storage import saved
from pyspark.sql import Window
from pyspark.sql import functions as F

SCHEMA = "project_id string, id string, relative_path string, captured_at bigint, d_hash string, timestamp_source string, is_missing boolean, rating int"


def photos(spark, rows):
    """Rows (id, captured_at, d_hash, source)."""
    return spark.createDataFrame([("p", i, f"{i}.jpg", at, h, s, False, 0) for i, at, h, s in rows], SCHEMA)


def z(bits):
    return f"{bits:016x}"


def test_pairs(spark):
    rows = [("a", 0, z(0), "exif_original"), ("b", 1000, z(3), "exif_original"), ("c", 60000, z(3), "exif_original"), ("d", 61000, z(0), "filesystem_mtime"), ("e", 61500, z(0), "filesystem_mtime")]
    found = sorted(tuple(r)[1:] for r in sequence.burst_pairs(photos(spark, rows)).collect())
    assert found == [("a:b", "a", "b", 2, 1000), ("c:d", "c", "d", 2, 1000)]


@pytest.mark.parametrize(("threshold", "sizes"), [(0, []), (2, [2]), (64, [3])])
def test_threshold_chain(spark, threshold, sizes):
    rows = [("a", 0, z(0), "exif_original"), ("b", 1000, z(3), "exif_original"), ("c", 2000, z(0x3F), "exif_original")]
    found = sequence.burst_groups(photos(spark, rows), threshold).collect()
    assert [r["n_photos"] for r in found] == sizes


def test_overrides_decide_for_their_direction(spark):
    rows = photos(spark, [("a", 0, z(0), "unknown"), ("b", 1000, z(3), "unknown"), ("c", 2000, z(0x3F), "unknown"), ("d", 99_000, z(0), "unknown")])
    said = lambda *o: spark.createDataFrame([("p", *x) for x in o], "project_id string, left_id string, right_id string, joined boolean")
    groups = lambda t, o: sorted(r["photo_ids"] for r in sequence.burst_groups(rows, t, o).collect())
    assert groups(64, said(("a", "b", False))) == [["b", "c"]]
    assert groups(0, said(("a", "b", True))) == [["a", "b"]]
    assert groups(0, said(("b", "a", True))) == []
    assert groups(0, said(("c", "d", True))) == [["c", "d"]]


def test_similarity_and_window(spark):
    groups = lambda rows: [(r["id"], r["similarity"], r["span_ms"]) for r in sequence.burst_groups(photos(spark, rows), 64).collect()]
    assert groups([("a", 0, z(0), "unknown"), ("b", 4000, z(0), "unknown")]) == [("a:b", 100, 4000)]
    assert groups([("a", 0, z(0), "unknown"), ("b", 10, "f" * 16, "unknown")]) == [("a:b", 0, 10)]
    assert groups([("a", 0, z(0), "unknown"), ("b", 4001, z(0), "unknown")]) == []


def window(spark, rows):
    r = sequence.candidate_window(photos(spark, [(f"{i:05}", at, None, s) for i, (at, s) in enumerate(rows)])).first()
    return r["window_ms"], r["n_candidates"], r["weak_pairs"]


def test_candidate_windows(spark):
    assert window(spark, [(5, "filesystem_mtime")] * 500) == (4000, 0, 499)
    assert window(spark, [(2000 * i, "exif_original") for i in range(271)]) == (4000, 271, 0)
    assert window(spark, [(3000 * i, "exif_original") for i in range(2400)] + [(9_000_000, "exif_original"), (9_000_100, "exif_original")]) == (2000, 2, 0)
    assert window(spark, [(100 * i, "exif_original") for i in range(2400)])[0] == 500


@pytest.mark.parametrize("stretch", [1, 1000, 7919, 10**9])
def test_stretches_do_not_matter(spark, stretch):
    rng = random.Random(stretch)
    rows = [(f"{i:03}", rng.choice([None, rng.randint(0, 60_000)]) if i % 9 else 500, z(rng.getrandbits(3)), "unknown") for i in range(120)]
    frame = photos(spark, rows)
    found = {(r["island"], r["id"]) for r in sequence.burst_members(frame, 1, stretch_ms=stretch).collect()}
    ordered = sorted((at, f"{i}.jpg", i, int(h, 16)) for i, at, h, _ in rows if at is not None)
    expected, island, before = set(), None, None
    for at, _, i, h in ordered:
        if before is None or at - before[0] > 4000 or (h ^ before[1]).bit_count() > 1:
            island = i
        expected.add((island, i))
        before = at, h
    assert found == expected


def test_neighbourhood(spark):
    rows = photos(spark, [(c, at, z(0), "unknown") for c, at in (("a", 0), ("b", 4000), ("c", 8000), ("d", 12_001), ("e", 16_000))])
    ids = spark.createDataFrame([("p", "b"), ("p", "c"), ("p", "no")], "project_id string, id string")
    assert sorted(r["id"] for r in sequence.neighbourhood(rows, ids).collect()) == ["a", "b", "c"]
    assert sequence.neighbourhood(rows, ids.limit(0)).count() == 0


def test_equal_times_are_many_tasks(spark):
    """A hundred thousand photos of one millisecond: neighbours and runs as in one window, in ranges of rows."""
    n = 100_000
    many = spark.range(n).select(
        F.lit("p").alias("project_id"), F.format_string("%06d.jpg", (F.col("id") * 7919) % n).alias("relative_path"), F.col("id").cast("string").alias("id"), F.lit(5_000_000).cast("bigint").alias("captured_at"),
        F.lpad(F.hex(F.when((F.col("id") * 7919) % n % 1000 < 500, 0).otherwise(-1)), 16, "0").alias("d_hash"), F.lit("exif_original").alias("timestamp_source"), F.lit(False).alias("is_missing"), F.lit(0).alias("rating"),
    )
    near = saved(sequence.adjacent(many, most=12_500))
    parts = near.groupBy("stretch", "sub").count().collect()
    assert len(parts) >= 6 and max(r["count"] for r in parts) < 30_000
    places = Window.partitionBy("project_id").orderBy("relative_path")
    expected = many.select("id", F.lag("id").over(places).alias("before"))
    assert near.select("id", F.col("previous.id").alias("before")).exceptAll(expected).isEmpty() and near.count() == n
    groups = sequence.burst_groups(near, 10).collect()
    assert len(groups) == 200 and {r["n_photos"] for r in groups} == {500}
