"""Curation, catalogue, thresholds and shapes on literal rows."""

import pytest
from framesift.operators import catalogue, curation, pages, shape, threshold
from framesift.schema import PHOTO
from pyspark.sql import functions as F

RATED = "id string, project_id string, relative_path string, captured_at bigint, rating int, is_missing boolean"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def rated(spark):
    rows = [("five", "e-five.jpg", 5), ("three", "d-three.jpg", 3), ("three-b", "c-three.jpg", 3), ("zero", "b-zero.jpg", 0)]
    return spark.createDataFrame([(i, "p", path, 1, r, False) for i, path, r in rows] + [("gone", "p", "a.jpg", 1, 3, True), ("other", "q", "a.jpg", 1, 3, False)], RATED)


def test_pages(spark, rated):
    ids = lambda **k: [r["id"] for r in pages.page(rated, "p", **k).collect()]
    assert ids() == ["zero", "three-b", "three", "five"]
    assert ids(order=pages.RATING_ORDER) == ["five", "three-b", "three", "zero"]
    assert ids(rating=0) == ["zero"] and ids(offset=3, limit=0) == ["five"] and ids(offset=9) == []
    assert {r["total"] for r in pages.page(rated, "p", limit=1).collect()} == {4}
    times = spark.createDataFrame([(i, "p", i, at, 0, False) for i, at in (("z", 300), ("y", None), ("a", 100), ("zz", None), ("b", 200), ("c", 0))], RATED)
    assert [r["id"] for r in pages.selection_seed(times, "p").collect()] == ["c", "a", "b", "z", "y", "zz"]
    wanted = spark.createDataFrame([(0, "five"), (1, "no"), (2, "zero"), (3, "five"), (4, "gone")], "pos int, id string")
    assert [r["id"] for r in pages.by_ids(rated, wanted).collect()] == ["five", "zero"]


def test_move(spark, rated):
    moved = lambda *a, **k: sorted(r["id"] for r in curation.move_rating(rated, "p", *a, **k).collect())
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert moved(3, 5) == ["three", "three-b"] and moved(3, 3) == []
    assert moved(3, 5, include=ids("three", "zero")) == ["three"] and moved(3, 5, exclude=ids("three")) == ["three-b"]
    for bad in ((6, 1), (1, -1)):
        with pytest.raises(ValueError, match="ratings"):
            curation.move_rating(rated, "p", *bad)
    after = curation.save_results(rated, curation.move_rating(rated, "p", 3, 5).withColumn("project_id", F.lit("p")))
    assert pages.rating_summary(after).where("project_id = 'p'").first()["n5"] == 3


def test_rounds_and_lists(spark):
    rows = spark.createDataFrame([(f"{i}", "p", f"{i}", i, 0, False) for i in range(9)], RATED)
    found = {r["id"]: (r["group_index"], r["is_survivor"]) for r in curation.rounds(rows, 4).collect()}
    assert found["0"] == (0, False) and found["7"] == (1, False) and found["8"] == (2, True)
    g = F.lit([["a", "b"], ["c", "d"], ["e", "f"]])
    assert tuple(one(spark, curation.insert_upcoming(g, F.lit(0), F.lit(["x", "c"]), 2))) == ([["a", "b"], ["x", "c"], ["d", "e"]], ["f"], ["x"])
    assert tuple(one(spark, curation.insert_upcoming(g, F.lit(1), F.lit(["a", "c"]), 3))) == ([["a", "b"], ["c", "d"], ["e", "f"]], [], [])
    assert tuple(one(spark, curation.insert_upcoming(g, F.lit(2), F.lit(["x"]), 3))) == ([["a", "b"], ["c", "d"], ["e", "f"]], ["x"], ["x"])
    assert tuple(one(spark, curation.regroup(g, F.lit(1), 3))) == ([["a", "b"], ["c", "d", "e"]], ["f"])
    assert tuple(one(spark, curation.regroup(g, F.lit(0), 4))) == ([["a", "b", "c", "d"], ["e", "f"]], [])
    assert tuple(one(spark, curation.regroup(g, F.lit(3), 2))) == ([["a", "b"], ["c", "d"], ["e", "f"]], [])
    assert one(spark, curation.without_last(F.lit(["a", "b", "a", "c"]), F.lit("a"))) == ["a", "b", "c"]
    assert one(spark, curation.without_last(F.lit(["a"]), F.lit("z"))) == ["a"] and one(spark, curation.without_last(F.lit(["a"]), F.lit("a"))) == []
    assert one(spark, curation.replaced_representative(F.lit(["a", "b"]), F.lit("b"), F.lit("z"))) == ["a", "z"]
    ratings = F.create_map(F.lit("c"), F.lit(5))
    assert one(spark, curation.chosen_with_confirmed(F.lit(["a"]), F.lit(["a", "b", "c"]), ratings)) == ["a", "c"]
    args = one(spark, curation.move_arguments(F.lit(True), F.lit(["a"])))
    assert args["include"] is None and args["exclude"] == ["a"]


def test_undo_restores_what_was(spark):
    log = spark.createDataFrame([("p", "a", 1, "set", 2), ("p", "a", 2, "set", 5), ("p", "b", 2, "set", 5), ("p", "b", 1, "set", 4)], "project_id string, photo_id string, seq bigint, op string, rating int")
    current = lambda x: {r["photo_id"]: r["rating"] for r in curation.latest_ratings(x).collect()}
    assert current(log) == {"a": 5, "b": 5} and current(curation.undo(log)) == {"a": 2, "b": 4}


def photo(**k):
    names = catalogue.parsed_names(PHOTO)
    base = dict.fromkeys(names) | {"id": "1", "project_id": "p", "path": "/a.jpg", "relative_path": "a.jpg", "name": "a.jpg", "rating": 3, "is_missing": False, "captured_at": 7, "d_hash": "00", "fingerprint_mtime": 1, "fingerprint_size": 2} | k
    return tuple(base[n] for n in names)


def test_upsert(spark):
    photos = spark.createDataFrame([photo(), photo(id="2", path="/b", fingerprint_mtime=None, fingerprint_size=None), photo(id="3", path="/c"), photo(id="4", path="/d"), photo(id="5", project_id="q")], PHOTO)
    listing = spark.createDataFrame([("p", "/a.jpg", "a.jpg", "a.jpg", 1, 2), ("p", "/b", "b", "b", None, None), ("p", "/c", "c", "c", 9, 2), ("p", "/new", "new", "new", 1, 1), ("p", "/new", "new", "new", 1, 1)], "project_id string, path string, relative_path string, name string, mtime bigint, size bigint")
    after = catalogue.upsert(photos, listing)
    rows = {(r["project_id"], r["path"]): r for r in after.collect()}
    assert len(rows) == after.count() == 6 and after.columns == photos.columns
    assert rows["p", "/a.jpg"]["captured_at"] == 7 and rows["p", "/b"]["d_hash"] == "00"
    assert rows["p", "/c"]["captured_at"] is None and rows["p", "/c"]["rating"] == 3 and rows["p", "/c"]["id"] == "3"
    assert rows["p", "/d"]["is_missing"] and not rows["q", "/a.jpg"]["is_missing"] and rows["p", "/new"]["rating"] == 0
    again = catalogue.upsert(after, listing)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, after.collect()), key=str)
    projects = spark.createDataFrame([("p", "new"), ("z", "new")], "id string, status string")
    assert {r["id"]: (r["photo_count"], r["status"]) for r in catalogue.photo_counts(projects, after).collect()} == {"p": (4, "ready"), "z": (0, "missing")}


def test_writes(spark):
    photos = spark.createDataFrame([photo(thumbnail_source="exif_thumbnail"), photo(id="2", path="/b", analysis_error="old")], PHOTO)
    times = spark.createDataFrame([("p", "1", None, None)], "project_id string, id string, at bigint, source string")
    assert {r["id"]: (r["captured_at"], r["timestamp_source"]) for r in catalogue.write_capture(photos, times).collect()} == {"1": (None, "unknown"), "2": (7, None)}
    done = spark.createDataFrame([("p", "1", "ff", None, None, None, 5), ("p", "2", None, None, None, "bad", 6)], "project_id string, id string, hash string, thumb_path string, thumb_source string, error string, at bigint")
    rows = {r["id"]: r for r in catalogue.write_analysis(photos, done).collect()}
    assert (rows["1"]["d_hash"], rows["1"]["d_hash_version"], rows["1"]["thumbnail_source"], rows["1"]["analysis_error"]) == ("ff", 2, "exif_thumbnail", None)
    assert (rows["2"]["d_hash_version"], rows["2"]["analysis_error"], rows["2"]["analysis_error_at"]) == (None, "bad", 6)
    whole = photo(id="3", path="/e", d_hash_version=2, thumbnail_path="t", thumbnail_mtime=1, thumbnail_size=2, thumbnail_version=2)
    todo = catalogue.to_analyse(photos.union(spark.createDataFrame([whole], PHOTO)))
    assert sorted(r["id"] for r in todo.collect()) == ["1", "2"]


def test_sessions(spark):
    states = spark.createDataFrame([("a", '{"round": 3, "ratings": {"x": 2}, "groups": [["x", "y"]]}', 1), ("b", "{}", 2), ("c", "[1]", 3), ("d", "broken", 4), ("e", None, 5)], "project_id string, state_json string, updated_at bigint")
    rows = {r["project_id"]: r["session"] for r in catalogue.decode_session(states).collect()}
    assert rows["a"]["round"] == 3 and rows["a"]["ratings"] == {"x": 2} and rows["a"]["groups"] == [["x", "y"]]
    assert rows["b"]["round"] == 1 and rows["b"]["stage"] == "settings" and rows["b"]["survivors"] == []
    assert rows["c"] is None and rows["d"] is None and rows["e"] is None
    again = catalogue.decode_session(catalogue.encode_session(catalogue.decode_session(states))).collect()
    assert {r["project_id"]: r["session"] for r in again} == rows


def answers(spark, *rows):
    return spark.createDataFrame([("p", d, g) for d, g in rows] or [], "project_id string, distance int, grouped boolean")


@pytest.mark.parametrize(
    ("rows", "expected"),
    [([(3, True)], 64), ([(3, False)], 0), ([(4, True), (10, False)], 7), ([(8, False), (12, True)], None), ([(2, True), (3, True), (9, False), (9, True)], None)],
)
def test_infer(spark, rows, expected):
    errors = [sum((d <= t) != g for d, g in rows) for t in range(65)]
    best = [t for t, e in enumerate(errors) if e == min(errors)]
    assert threshold.infer(answers(spark, *rows), "project_id").first()["threshold"] == (best[len(best) // 2] if expected is None or len({g for _, g in rows}) > 1 else expected)


def test_search_finds_the_threshold(spark):
    """A simulated viewer joins what is within the truth; eight questions are enough."""
    distances = sorted((7 * i * i) % 37 + 2 for i in range(99))
    pairs = [(f"{i:02}", d) for i, d in enumerate(distances)]
    ranked = spark.createDataFrame([(i, p, d) for i, (p, d) in enumerate(pairs)], "i bigint, id string, distance int").cache()
    for truth in (5, 14, 30):
        low, high, asked = 0, len(pairs) - 1, []
        while True:
            up_to, apart = max([d for _, d, g in asked if g], default=-1), min([d for _, d, g in asked if not g], default=65)
            left = sum(low <= i <= high and p not in {a for a, *_ in asked} for i, (p, _) in enumerate(pairs))
            if one(spark, threshold.should_stop(*map(F.lit, (len(asked), left, up_to, apart)))):
                break
            known = spark.createDataFrame([(p,) for p, *_ in asked], "id string")
            q = threshold.next_question(ranked, known, F.lit(low), F.lit(high)).first()
            asked.append((q["id"], q["distance"], q["distance"] <= truth))
            state = one(spark, threshold.answered(F.array(F.struct(F.lit(q["i"]).alias("i"), F.lit(q["distance"] <= truth).alias("grouped"))), F.lit(low), F.lit(high)))
            low, high = state["low"], state["high"]
        assert len(asked) <= 8
        got = threshold.infer(answers(spark, *((d, g) for _, d, g in asked)), "project_id").first()["threshold"]
        assert abs(got - truth) <= 3


def test_cuts(spark):
    run = spark.createDataFrame([("p", 0, i, str(i + 1), False) for i in range(5)], "project_id string, run int, pos int, id string, cut boolean")

    def parts(selected):
        cut = shape.cut_around(run, spark.createDataFrame([("p", s) for s in selected], "project_id string, id string"))
        rows = sorted((r["pos"], r["block"], r["id"]) for r in shape.blocks(cut).collect())
        return "|".join("".join(i for _, b, i in rows if b == k) for k in range(rows[-1][1] + 1))

    assert parts("345") == "12|345" and parts("3") == "12|3|45" and parts("12345") == "12345" and parts("") == "12345"
    whole = shape.cut_all(run)
    assert shape.boundaries(whole).first()["n_cuts"] == 4 and shape.boundaries(shape.join_at(whole, 2)).first()["n_cuts"] == 3
    groups = spark.createDataFrame([("p", "1", "g"), ("p", "2", "g"), ("p", "4", "h"), ("p", "5", "h")], "project_id string, id string, group string")
    assert [r["cut"] for r in shape.cuts_from_groups(run, groups).orderBy("pos").collect()] == [False, False, True, True, False]
    marks = lambda *x: spark.createDataFrame([("p", i) for i in x], "project_id string, id string")
    found = shape.representatives(shape.blocks(shape.cut_around(run, marks("3", "4", "5"))), marks("4"), marks("1")).collect()
    assert {r["block"]: (r["representative"], r["is_outside"]) for r in found} == {0: ("1", False), 1: ("4", True)}


def test_save_shape_twice(spark):
    rows = [("a", 0, "0" * 16), ("b", 1000, "0" * 16), ("c", 2000, "f" * 16), ("d", 60_000, "f" * 16)]
    photos = spark.createDataFrame([("p", i, at, h, False) for i, at, h in rows], "project_id string, id string, captured_at bigint, d_hash string, is_missing boolean")
    wanted = spark.createDataFrame([("p", k, i, b) for k, (i, b) in enumerate(zip("abcd", (0, 1, 1, 2)))], "project_id string, pos int, id string, block int")
    old = spark.createDataFrame([("p", "c", "d", True), ("p", "x", "y", True)], "project_id string, left_id string, right_id string, joined boolean")
    once = shape.save_shape(old, photos, wanted, 14)
    expected = {("p", "a", "b", False), ("p", "b", "c", True), ("p", "x", "y", True)}
    assert set(map(tuple, once.collect())) == expected == set(map(tuple, shape.save_shape(once, photos, wanted, 14).collect()))


def test_places_over_many_partitions(spark):
    rows = spark.range(5000).select(F.concat(F.lit("p"), F.col("id") % 3).alias("project_id"), F.col("id").cast("string").alias("id"), ((F.col("id") * 7919) % 1000).alias("captured_at"), F.lit("x").alias("relative_path")).repartition(7)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for by in ((), ("project_id",)):
            found = [(tuple(r[c] for c in by), r["captured_at"], r["id"], r["place"]) for r in curation.placed(rows, pages.CAPTURE_ORDER, *by).collect()]
            places = {}
            for group, _, _, place in sorted(found):
                places[group] = places.get(group, 0) + 1
                assert place == places[group]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_spread(spark):
    """A representative has its rating already, settled photos keep theirs, and a burst without a chosen one gets nothing."""
    members = spark.createDataFrame([("p", r, i) for r, i in (("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("d", "e"))], "project_id string, representative string, id string")
    chosen = spark.createDataFrame([("p", "a", 4), ("q", "d", 5)], "project_id string, id string, rating int")
    settled = spark.createDataFrame([("p", "c")], "project_id string, id string")
    assert [tuple(r) for r in curation.spread(chosen, members, settled).collect()] == [("p", "b", 4)]
