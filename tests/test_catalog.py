"""Every registered query against its SQL oracle on the smallest tables, as the driver compares them."""

import duckdb
import pytest

from tagloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in catalog.ORACLES:
        assert columns and len(set(columns)) == len(columns)
        return
    want = duck.sql(catalog.ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
