"""Every query with SQL against DuckDB on the smallest tables. The operators of the others are held to brute force elsewhere."""

import math
import os

import duckdb
import pytest

from paperweir import catalogue

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or v != v:
        return "None"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0) if not math.isclose(v, round(v), abs_tol=1e-9) else str(int(round(v)))
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = c.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
