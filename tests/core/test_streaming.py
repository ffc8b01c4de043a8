"""Incremental forms against the batch forms."""

import pytest
from framesift.operators import sequence
from framesift.streaming import bursts, enrichment
from pyspark.sql import functions as F

SCHEMA = "project_id string, id string, relative_path string, captured_at bigint, d_hash string, timestamp_source string, is_missing boolean, rating int"


def rows():
    out = []
    for p in ("p", "q"):
        at = 0
        for i in range(40):
            at += (500, 3000, 4000, 4001, 9000)[(i * 7 + len(out)) % 5]
            out.append((p, f"{p}{i:03}", f"{i:03}.jpg", at, f"{(i * i) % 8:016x}", "unknown", i % 11 == 5, 0))
    return out


@pytest.fixture
def stores(spark):
    for key, value in bursts.STATE_STORE.items():
        spark.conf.set(key, value)
    yield
    for key in bursts.STATE_STORE:
        spark.conf.unset(key)


@pytest.mark.parametrize("stretch_ms", [4000, 30_000, 10_000_000])
def test_stream_bursts(spark, tmp_path, stores, stretch_ms):
    data = rows()
    last = [(p, f"{p}zzz", "z", 50_000_000, "0" * 16, "unknown", False, 0) for p in ("p", "q")]
    for k, part in enumerate((data[1::2], data[::2], last)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = enrichment.arrivals(spark, str(tmp_path / "in"), SCHEMA, 1)
    query = bursts.stream_bursts(stream, 1, "10 minutes", stretch_ms).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    parts = spark.read.parquet(str(tmp_path / "out"))
    assert parts.count() == parts.select("id").distinct().count()
    found = {(r["project_id"], r["island"], r["id"]) for r in bursts.linked(parts).collect()}
    expected = {(r["project_id"], r["island"], r["id"]) for r in sequence.burst_members(spark.createDataFrame(data, SCHEMA), 1).collect()}
    assert found == expected


def test_a_project_with_most_photos_is_many_keys(spark, tmp_path, stores):
    """Nine in ten photos are one project's, in any order: runs as in batch, and no stretch holds more than a few."""
    import random

    rng, at, data = random.Random(6), 0, []
    for i in range(3000):
        at += rng.choice((100, 700, 3900, 4001, 6000))
        project = "small" if i % 10 == 0 else "big"
        data.append((project, f"{i:05}", f"{i:05}.jpg", at, f"{rng.choice((0, 1, 3)):016x}", "unknown", False, 0))
    rng.shuffle(data)
    last = [(p, f"{p}zzz", "z", at + 10**8, "0" * 16, "unknown", False, 0) for p in ("big", "small")]
    for part in (data[:1500], data[1500:], last):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = enrichment.arrivals(spark, str(tmp_path / "in"), SCHEMA, 1)
    query = bursts.stream_bursts(stream, 1, "1000 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert not spark.read.schema(parts_schema()).parquet(str(tmp_path / "out")).count()  # all may still come late
    query = bursts.stream_bursts(enrichment.arrivals(spark, str(tmp_path / "in"), SCHEMA), 1, "1 second").writeStream.format("parquet").option("path", str(tmp_path / "out2")).option("checkpointLocation", str(tmp_path / "cp2")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    parts = spark.read.parquet(str(tmp_path / "out2"))
    found = {(r["project_id"], r["island"], r["id"]) for r in bursts.linked(parts).collect()}
    expected = {(r["project_id"], r["island"], r["id"]) for r in sequence.burst_members(spark.createDataFrame(data, SCHEMA), 1).collect()}
    assert found == expected
    sizes = [r["count"] for r in parts.where("project_id = 'big'").groupBy("stretch").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]


def parts_schema():
    return bursts._OUT


def test_time_bursts(spark, tmp_path):
    data = [("p", str(i), "", at, None, None, False, 0) for i, at in enumerate((0, 4000, 8001, 99_000))]
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = enrichment.arrivals(spark, str(tmp_path / "in"), SCHEMA)
    query = bursts.time_bursts(stream).writeStream.format("memory").queryName("time_bursts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["first_at"], r["last_at"], r["n"]) for r in spark.table("time_bursts").collect()) == [(0, 4000, 2), (8001, 8001, 1), (99_000, 99_000, 1)]


def test_enrichment_goes_on_where_it_stopped(spark, tmp_path):
    schema = "x bigint"
    put = lambda a, b: spark.range(a, b).select(F.col("id").alias("x")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda work: enrichment.enrich(enrichment.arrivals(spark, str(tmp_path / "in"), schema, 1), work, str(tmp_path / "out"), str(tmp_path / "cp"))
    put(0, 3), put(3, 6)

    def fails_later(chunk):
        if chunk.where("x >= 3").count():
            raise RuntimeError("stopped")
        return chunk.withColumn("y", F.col("x") * 2)

    query = run(fails_later)
    with pytest.raises(Exception, match="stopped"):
        query.awaitTermination(120)
    assert enrichment.progress(query)["phase"] == "error"
    put(6, 9)
    query = run(lambda chunk: chunk.withColumn("y", F.col("x") * 3))
    query.awaitTermination(120)
    found = {r["x"]: r["y"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found.keys() == set(range(9)) and found[8] == 24
    assert sum(y == 2 * x for x, y in found.items() if x) >= 2 or found[0] == 0
    assert enrichment.progress(query)["phase"] == "complete"


def test_runs(spark):
    runs = enrichment.Runs(spark)
    assert runs.run("scan", lambda: spark.range(5).count()) == 5

    def again():
        with pytest.raises(RuntimeError, match="running"):
            runs.run("scan", lambda: None)
        return True

    assert runs.run("scan", again)
    runs.stop("nothing")
