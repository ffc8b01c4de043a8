"""Properties that hold for any input."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from framesift.functions import hashing, scalars
from framesift.operators import export, threshold
from pyspark.sql import functions as F

SLOW = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
HASHES = st.integers(0, 2**64 - 1)


@SLOW
@given(pairs=st.lists(st.tuples(HASHES, HASHES), min_size=1, max_size=30))
def test_distance_is_the_count_of_differing_bits(spark, pairs):
    rows = spark.createDataFrame([(k, f"{a:x}", f"{b:016X}") for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    found = {r["k"]: (r["d"], r["t"]) for r in rows.select("k", hashing.distance(F.col("a"), F.col("b")).alias("d"), hashing.hash_text(hashing.hash_bits(F.col("a"))).alias("t")).collect()}
    assert found == {k: ((a ^ b).bit_count(), f"{a:016x}") for k, (a, b) in enumerate(pairs)}


@SLOW
@given(answers=st.lists(st.tuples(st.integers(0, 64), st.booleans()), min_size=1, max_size=20))
def test_threshold_has_the_fewest_errors(spark, answers):
    rows = spark.createDataFrame([("p", d, g) for d, g in answers], "project_id string, distance int, grouped boolean")
    found = threshold.infer(rows, "project_id").first()["threshold"]
    errors = [sum((d <= t) != g for d, g in answers) for t in range(65)]
    assert errors[found] == min(errors)


@SLOW
@given(names=st.lists(st.sampled_from(["a.jpg", "a (2).jpg", "a (3).jpg", "b", "b (2)", ".c"]), min_size=1, max_size=25))
def test_targets_are_unique(spark, names):
    rows = spark.createDataFrame([("p", 1, n, f"{k:03}", f"{k:03}") for k, n in enumerate(names)], "project_id string, rating int, name string, relative_path string, id string")
    found = [r["target"] for r in export.layout(rows).collect()]
    assert len(found) == len(set(found)) == len(names)


@SLOW
@given(ids=st.lists(st.sampled_from("abc"), max_size=6), item=st.sampled_from("abc"))
def test_toggling_twice_changes_nothing(spark, ids, item):
    ids = list(dict.fromkeys(ids))
    column = F.lit(ids) if ids else F.array().cast("array<string>")
    twice = scalars.toggled(scalars.toggled(column, F.lit(item)), F.lit(item))
    assert sorted(spark.range(1).select(twice.alias("x")).first()["x"]) == sorted(ids)
