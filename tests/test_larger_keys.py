"""Queries on tables whose keys outgrow the test data's, against their SQL."""

import duckdb

from tagloom.plans import catalog


def same(spark, folder, name, **tables):
    """Write the tables (rows, schema), run the query and its SQL over them; returns how many rows both have."""
    duck = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
    return len(got)


PART = "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double"


def test_nozzles_of_six_digits(spark, tmp_path):
    keys = [*range(1, 40), *range(123450, 123490)]
    parts = [(k, "B", "T", k % 50 + 1, 1.0) for k in keys]
    lines = [(k % 3, k) for k in keys]
    assert same(spark, tmp_path, "channel_scores", part=(parts, PART), lineitem=(lines, "l_suppkey long, l_partkey long")) == 12


def test_names_that_come_round_again(spark, tmp_path):
    """Loops and tags repeat every 40,868 parts; each part stays a vertex of its own."""
    parts = [(k, "B", "T", 1, 1.0) for k in [*range(0, 14), *range(40868, 40880), *range(81740, 81745)]]
    assert same(spark, tmp_path, "failure_impact", part=(parts, PART)) == len(parts)
