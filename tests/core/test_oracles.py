"""Every registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest
from framesift.plans.queries import ORACLES, QUERIES

SIZES = ("sf0.001", "sf0.01")


@pytest.fixture(scope="module", params=SIZES)
def tables(request):
    con, folder = duckdb.connect(), f"/root/testdata/{request.param}"
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}'")
    return con, folder


def alike(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, tables, name):
    con, folder = tables
    frame = QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    found = sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)
    assert found, name
    if name in ORACLES:
        result = con.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        expected = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=str)
        assert len(found) == len(expected)
        wrong = [(a, b) for a, b in zip(found, expected) if not all(map(alike, a, b))]
        assert not wrong, wrong[:3]
