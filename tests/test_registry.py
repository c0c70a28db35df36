import glob
import os

import duckdb
import pytest

import __spark_entry__
from loglattice.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    if name not in registry.ORACLES:
        assert got.count() > 0
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    assert plain(map(tuple, got.select(columns).collect())) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
