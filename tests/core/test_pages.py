"""Deep pages, ranks and free numbers against plain versions."""

import random

import pytest
from framesift.operators import export, pages
from pyspark.sql import functions as F

SCHEMA = "id string, project_id string, relative_path string, captured_at bigint, rating int, is_missing boolean"


@pytest.fixture(scope="module")
def photos(spark):
    rng = random.Random(4)
    rows = [(f"{i:04}", "big" if i % 9 else "small", f"{rng.randint(0, 400):03}.jpg", i, rng.randint(0, 5), i % 50 == 0) for i in range(3000)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_deep_pages(spark, photos, tmp_path):
    """Any page is that of a sort of the whole project, from the ranges that hold it only."""
    path = f"file://{tmp_path}/index"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages.write_index(photos, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges = spark.read.parquet(f"{path}/index").count()
    for project in ("big", "small", "none"):
        total = pages.indexed_total(spark, path, {"project_id": project})
        for offset in (0, total // 2, total * 9 // 10, total - 3, total + 5, -1):
            found = pages.indexed_page(spark, path, {"project_id": project}, offset, 50)
            expected = pages.page(photos, project, offset, 50)
            assert [r["id"] for r in found.collect()] == [r["id"] for r in expected.collect()]
            assert {r["total"] for r in found.collect()} <= {total}
    deep = pages.indexed_page(spark, path, {"project_id": "big"}, pages.indexed_total(spark, path, {"project_id": "big"}) * 9 // 10, 50)
    read = {f.split("part=")[1].split("/")[0] for f in (r[0] for r in deep.select(F.input_file_name()).distinct().collect()) if "part=" in f}
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert len(read) <= 2 < ranges and "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters")[1][:80]


@pytest.mark.parametrize("order", [pages.NAME_ORDER, pages.RATING_ORDER])
def test_pages_after_a_row(spark, photos, order):
    """Page by page, each from the last row of the one before, gives the whole project in order."""
    whole = [r["id"] for r in pages.visible(photos, "small").orderBy(*pages.ordering(order)).collect()]
    found, last = [], None
    while some := pages.page_after(photos, "small", last, 150, order=order).collect():
        found += [r["id"] for r in some]
        last = some[-1].asDict()
    assert found == whole


def test_ranks(spark):
    """Many different values of one group, few of another, one, none; groups or none at all."""
    rng = random.Random(8)
    rows = [("wide", rng.randint(0, 10**9)) for _ in range(5000)] + [("few", rng.choice([1, 2, 2, 2, 9])) for _ in range(777)] + [("one", 5), ("null", None)]
    frame = spark.createDataFrame(rows, "g string, v bigint").repartition(6)
    points = (0.0, 0.5, 0.9, 0.95, 1.0)
    nearest = lambda values, p: sorted(values)[int((len(values) - 1) * p + 0.5)]
    by_group = {g: [v for h, v in rows if h == g] for g in ("wide", "few", "one")}
    found = {r["g"]: r for r in pages.nearest_rank(frame, "v", points, "g").collect()}
    assert set(found) == set(by_group)
    for g, values in by_group.items():
        assert [found[g][f"p{round(p * 100)}"] for p in points] == [nearest(values, p) for p in points]
        assert found[g]["mean"] == pytest.approx(sum(values) / len(values)) and found[g]["max"] == max(values)
    every = [v for _, v in rows if v is not None]
    total = pages.nearest_rank(frame, "v", points).first()
    assert [total[f"p{round(p * 100)}"] for p in points] == [nearest(every, p) for p in points]
    plan = pages.nearest_rank(frame, "v", points, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part#" in line or "Aggregate" in plan[plan.index(line) :][:900] for line in plan.split("\n") if "Window [" in line)


def test_free_numbers(spark):
    """The first of a name keeps it, the k-th more has the k-th number that no file has in its own name."""
    rng = random.Random(3)
    names = ["a.jpg"] * 40 + [f"a ({t}).jpg" for t in (2, 3, 5, 8, 9, 30, 41, 100)] + ["a (2).jpg"] * 3 + ["b"] * 5 + ["b (3)", "b (03)", "b (1)", "b (2) (2)", ".x", ".x", "c (2).jpg", "d.tar.gz", "d.tar.gz", "d.tar (2).gz"]
    rng.shuffle(names)
    rows = [("p", rng.choice([4, 5]), n, f"{i:03}", f"{i:03}") for i, n in enumerate(names)]
    files = spark.createDataFrame(rows, "project_id string, rating int, name string, relative_path string, id string").repartition(4)
    found = {r["id"]: r["target"] for r in export.layout(files).collect()}
    assert len(found) == len(rows) == len(set(found.values()))
    for star in (4, 5):
        own = {n for _, r, n, _, _ in rows if r == star}
        seen = {}
        for _, r, name, _, i in sorted(rows, key=lambda x: x[3]):
            if r != star:
                continue
            k = seen.get(name, 0)
            seen[name] = k + 1
            dot = name.rfind(".") if name.rfind(".") > 0 else len(name)
            free = [n for n in range(2, 200) if f"{name[:dot]} ({n}){name[dot:]}" not in own]
            expected = name if k == 0 else f"{name[:dot]} ({free[k - 1]}){name[dot:]}"
            assert found[i] == f"star-{star}/{expected}"
