"""Every query of the core that has SQL against DuckDB, and every other one for running."""

import math
import os

import duckdb
import pytest

from tesela.plans import registry
import tesela.plans  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, db, name):
    got = registry.queries()[name](spark, FOLDER)
    want = db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in got.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    rows = [tuple(map(plain, r)) for r in got.collect()]
    assert sorted(rows) == sorted(tuple(map(plain, r)) for r in want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    registry.queries()[name](spark, FOLDER).collect()
