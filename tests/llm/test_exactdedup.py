import re

import duckdb
import pytest

from tagloom.llm import exactdedup as ex
from tagloom.llm import queries

SF = "/root/testdata/sf0.001"

ROWS = [
    (5, "a b c", "x"), (3, "abc", "x"), (4, "a b\tc", None), (9, None, "x"), (8, "", "y"), (7, " \n\r\x0b\x0c", "y"),
    (1, "ab c!", "y"), (2, "A b c", "z"), (None, "a bc", "z"), (6, "dup", "z"), (6, "dup", "z"), (6, "d u p", "z"), (10, "é" * 9, None),
]


def brute(rows):
    groups = {}
    for i, (doc_id, text, *_) in enumerate(rows):
        text = text or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), doc_id if doc_id is not None else -1, i))
    return {i: (min(g)[1], len(g), i == min(g)[2]) for g in groups.values() for _, _, i in g}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").coalesce(1)


def test_as_brute_force(docs):
    got = sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.kept) for r in ex.exact_duplicates(docs).collect())
    want = sorted((-1 if ROWS[i][0] is None else ROWS[i][0], k, n, kept) for i, (k, n, kept) in brute(ROWS).items())
    assert got == want


def test_whole_rows(docs):
    kept = {(r.doc_id, r.text) for r in ex.keep_one(docs).collect()}
    assert kept == {(ROWS[i][0], ROWS[i][1]) for i, (_, _, k) in brute(ROWS).items() if k}
    assert ex.keep_one(docs).count() == len(kept)


def test_repeated_rows_only(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted(map(tuple, ex.keep_one(docs).collect())) == [(1, "a"), (2, "b")]


def test_unique_ids_take_the_short_plan(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}", i) for i in range(50)], "doc_id long, text string, DIGEST int")
    out = ex.keep_one(docs)
    assert sorted(r.doc_id for r in out.collect()) == list(range(7)) and out.columns == docs.columns


def test_second_batch(spark):
    index = ex.DigestIndex(spark, buckets=4)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert ex.exact_duplicates(first, index, "one").filter("kept").count() == 2
    second = spark.createDataFrame([(0, "a  "), (3, "c"), (4, "c ")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in ex.exact_duplicates(second, index, "two").collect()}
    assert got == {0: (1, False), 3: (4, False), 4: (4, True)}
    again = ex.DigestIndex(spark, index.path, 4)
    assert again.rows().count() == 3


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ex.exact_duplicates(docs).count() == 0 and ex.keep_one(docs).count() == 0


@pytest.mark.parametrize("partitions", [2, 16])
def test_reopened_under_other_shuffle_partitions(spark, partitions):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    try:
        spark.conf.set(key, "7")
        index = ex.DigestIndex(spark)
        assert ex.exact_duplicates(docs, index, "one").filter("kept").count() == 60
        spark.conf.set(key, str(partitions))
        again = ex.DigestIndex(spark, index.path)
        assert ex.exact_duplicates(docs, again, "two").filter("kept").count() == 0
        assert again.buckets == 7 and again.rows().count() == 60
        with pytest.raises(ValueError):
            ex.DigestIndex(spark, index.path, partitions)
    finally:
        spark.conf.set(key, before)


def test_combined_before_the_shuffle(spark, tmp_path):
    """A group of copies sends one row a task: aggregates on both sides of the only exchange, and none above the anti-join."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) AS text").repartition(8)
    batch = ex.written(ex.digests(docs), "digests")
    plan = ex.grouped(batch)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_min" in plan.split("Exchange")[1] and "partial_min" not in plan.split("Exchange")[0]
    index = ex.DigestIndex(spark, str(tmp_path / "index"), 4)
    index.add(index.decide(batch, "one"), "one")
    plan = index.fresh(ex.written(ex.grouped(batch), "groups"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Aggregate" not in plan and plan.count("Exchange") == 1
    index.close()


def test_retry_after_a_crash(spark, tmp_path):
    """A batch whose output was lost gives the same rows under the same id, in whatever order they are read, at each point
    where a run can die; another batch gets nothing of it."""
    rows = [(i, f"text {i % 30}" + " " * (i % 4)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(r.doc_id for r in ex.keep_one(docs).collect())
    for died in ("decided", "added", "half"):
        index = ex.DigestIndex(spark, str(tmp_path / died), 4)
        decided = index.decide(ex.written(ex.digests(docs), "digests"), "b1")
        if died != "decided":
            index.add(decided if died == "added" else decided.filter("hash(digest) % 2 = 0"), "b1")
        index.close()
        again = ex.DigestIndex(spark, str(tmp_path / died))
        assert sorted(r.doc_id for r in ex.keep_one(docs.repartition(7), again, "b1").collect()) == want
        assert again.rows().count() == 30
        assert ex.keep_one(docs, again, "b2").count() == 0
        again.close()
    with pytest.raises(ValueError):
        ex.exact_duplicates(docs, again)


def test_maps_and_clashing_names(spark):
    docs = spark.sql("SELECT id AS doc_id, 'same text' AS text, map('a', id % 2) AS tags, 1 AS _id, 2 AS _tagloom_hash, 3 AS digest, 4 AS row, 5 AS kept, 6 AS n, named_struct('m', map(1, 2)) AS `a.b` FROM range(4)")
    out = ex.keep_one(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(0, "same text", {"a": 0}, 1, 2, 3, 4, 5, 6, ({1: 2},))]


def test_query_against_its_sql(spark):
    got = queries.QUERIES["op5_exact_dedup"](spark, SF)
    duck = duckdb.sql(queries.ORACLES["op5_exact_dedup"].replace("documents", f"'{SF}/documents.parquet'"))
    assert sorted(got.columns) == sorted(duck.columns)
    assert sorted(tuple(r[c] for c in duck.columns) for r in got.collect()) == sorted(duck.fetchall())
