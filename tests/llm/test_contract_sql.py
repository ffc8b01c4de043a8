"""Operators against their SQL."""

import os

import duckdb
import pytest
from framesift.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        path = f"{SF}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    result = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})")
    assert sorted(map(tuple, frame.select(*columns).collect()), key=str) == sorted(result.fetchall(), key=str)
