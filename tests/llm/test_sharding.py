"""Shards: the curve, equal runs, files that are skipped."""

import itertools
import random
import zlib

import pytest
from framesift.llm import sharding
from pyspark.sql import functions as F

_rng = random.Random(11)
DOCS = [(i, " ".join("word" for _ in range(_rng.randint(0, 200))), _rng.choice(["a", "b", "c", None]), _rng.choice(["en", "de"])) for i in range(500)]
DOCS += [(None, None, None, None), (7, "", "a", "en"), (7, "", "a", "en"), (8, "é" * 9, "b", "de")]
SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.mark.parametrize(("n", "bits"), [(1, 3), (2, 1), (2, 3), (3, 2), (3, 3), (4, 2)])
def test_curve(spark, n, bits):
    """Every cell has a place of its own, and the next place is a neighbour's."""
    cells = list(itertools.product(range(1 << bits), repeat=n))
    names = [f"c{i}" for i in range(n)]
    rows = spark.createDataFrame(cells, names).select(sharding.hilbert([F.col(c) for c in names], bits).alias("h"), *names).collect()
    order = [tuple(r)[1:] for r in sorted(rows)]
    assert sorted(r["h"] for r in rows) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in itertools.pairwise(order))


def test_cuts(spark):
    """A value's cell is the share of lesser values, at any number of rows of one value."""
    values = [1] * 50 + list(range(2, 52)) + [None] * 9
    frame = spark.createDataFrame([(v,) for v in values], "v int")
    known = sorted(v for v in values if v is not None)
    expected = {}
    for v in known:
        expected.setdefault(known.index(v) * 16 // len(known), v)
    found = sharding.cuts(frame, "v")
    assert dict(found) == expected
    cells = {r["v"]: r["c"] for r in frame.select("v", sharding.cell(F.col("v"), found).alias("c")).distinct().collect()}
    assert cells == {v: known.index(v) * 16 // len(known) if v is not None else 0 for v in values}
    assert sharding.cuts(frame.limit(0), "v") == []


def test_query(spark):
    frame = spark.createDataFrame([(*d, 1, 2) for d in DOCS], SCHEMA + ", shard int, place int").repartition(3)
    rows = sharding.query(frame, 24).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(sizes) == list(range(24)) and {len(s) for s in sizes.values()} <= {len(DOCS) // 24, len(DOCS) // 24 + 1}
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    expected = sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in DOCS), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == expected
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame(DOCS[:5], SCHEMA)
    assert sorted(r["slot"] for r in sharding.query(frame).collect()) == [0] * 5
    assert sharding.query(frame.limit(0)).count() == 0


def test_by_bytes(spark):
    rows = sharding.cut(sharding.arranged(spark.createDataFrame(DOCS, SCHEMA)), 8, "bytes").collect()
    sums = {s: sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)}
    most, total = max(r["size"] for r in rows), sum(r["size"] for r in rows)
    assert all(abs(v - total / 8) <= most for v in sums.values())
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_files_are_skipped(spark, tmp_path):
    """A filter on each of the columns reads some shards only, and finds what a filter on all rows finds."""
    frame = spark.createDataFrame([(i, "w" * (i * 7 % 3000), f"src{i % 29}", ("en", "de", "fr", "es")[i * 13 % 4], 1) for i in range(4000)], SCHEMA + ", size int")
    path = f"file://{tmp_path}/shards"
    sharding.write(frame, path, 64)
    for ranges in ({"source": ("src1", "src12")}, {"lang": ("fr", "fr")}, {"size": (100, 300)}, {"source": ("src2", "src22"), "size": (0, 500)}):
        shards = sharding.matching(spark, path, ranges)
        assert 0 < len(shards) <= 40
        rows = sharding.read(spark, path, ranges)
        low_high = {c: r for c, r in ranges.items() if c != "size"}
        expected = frame.withColumn("bytes", F.octet_length("text") + 8)
        for c, (low, high) in low_high.items():
            expected = expected.where(F.col(c).between(low, high))
        if "size" in ranges:
            expected = expected.where(F.col("bytes").between(*ranges["size"]))
        assert sorted(r["doc_id"] for r in rows.collect()) == sorted(r["doc_id"] for r in expected.collect())
        assert {r["own_size"] for r in rows.collect()} == {1}
    assert len(sharding.matching(spark, path, {"source": ("src1", "src12"), "lang": ("fr", "fr"), "size": (100, 300)})) <= 8


def test_hot_group(spark):
    """A third of all rows are one row repeated: the shards are still equal."""
    frame = spark.createDataFrame([(1, "copy", "a", "en")] * 300 + DOCS[:300] * 2, SCHEMA).repartition(6)
    found = sharding.query(frame, 9).groupBy("shard").count().collect()
    assert {r["count"] for r in found} == {100}


def test_plan_is_native(spark):
    plan = sharding.cut(sharding.arranged(spark.createDataFrame(DOCS[:50], SCHEMA)))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
