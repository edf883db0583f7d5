"""Every registered query against its SQL, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from adjudica import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.5f}"
    if isinstance(value, bool) or value is None:
        return "null" if value is None else str(value)
    return f"{float(value):.5f}" if isinstance(value, int) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    found = QUERIES[name](spark, small)
    columns = sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert rows == wanted
