import math
import re

import pytest
from pyspark.sql import functions as F

from tagloom.llm import mixing, queries


def brute_targets(sizes):
    """The rule as told: cap at twice the size, share the rest by weight, until none is over."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]
        if not over:
            for s in free:
                target[s] = left * weight[s] / sum(weight[x] for x in free)
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 50}, {"a": 1, "b": 5000, "c": 10, "d": 0}, {"x": 7}, {"a": 0, "b": 0}, {"a": 10, "b": 40, "c": 5, "d": 100, "e": 7, "f": 7}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)


def brute_taken(rows, plan, order, block):
    """The schedule by plain loops; order: documents of each source as laid out."""
    units = {s: math.floor(t * mixing.UNITS + 0.5) for s, t in plan.items()}
    words, total, shares, at = sum(plan.values()), sum(units.values()), [], 0
    for s in sorted(plan, key=lambda s: (s is None, s)):
        if units[s] > 0:
            shares.append((s, at / total, (at + units[s]) / total))
            at += units[s]
    rank, takes = {}, {}
    size = {s: sum(n for d, n in order[s]) for s in order}
    for j in range(round(words / block)):
        turn = (j >> 20) * mixing.PHI_UPPER
        turn = turn - math.floor(turn) + ((j & 1048575) + 0.5) * mixing.PHI
        point = turn - math.floor(turn)
        s = next((s for s, low, high in shares if low <= point < high), shares[-1][0])
        r = rank[s] = rank.get(s, -1) + 1
        n_blocks = -(-size[s] // block)
        if r < 2 * n_blocks:
            takes[s, r % n_blocks] = takes.get((s, r % n_blocks), 0) + 1
    taken = {}
    for s, docs in order.items():
        begin = 0
        for d, n in docs:
            for w in range(begin, begin + n):
                taken[d] = taken.get(d, 0) + takes.get((s, w // block), 0)
            begin += n
    return taken


def test_as_brute_force(spark):
    sources = ["a", "b", "c", "d", None]
    rows = [(i, sources[min(4, i % 13)], " ".join(["w"] * (i * 7 % 50)) if i % 11 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = {r.doc_id: r for r in mixing.mix(docs, block=16).collect()}
    assert len(got) == 300 and all(got[i].size == len((t or "").split()) for i, _, t in rows)
    sizes = {}
    for i, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    plan = brute_targets(sizes)
    laid = sorted(((r.source, r.begin, r.doc_id, r.size) for r in mixing.laid_out(sized.filter("size > 0")).collect()), key=lambda x: (str(x[0]), x[1]))
    order = {}
    for s, begin, d, n in laid:
        assert begin == sum(x[1] for x in order.get(s, []))
        order.setdefault(s, []).append((d, n))
    want = brute_taken(rows, plan, order, 16)
    assert {d: got[d].taken for d in got} == {d: want.get(d, 0) for d in got}
    for s in sizes:
        assert abs(sum(r.taken for r in got.values() if r.source == s) - plan[s]) <= 4 * 16
    assert all(r.taken <= 2 * r.size for r in got.values())
    assert sorted(mixing.mix(docs, block=16).collect()) == sorted(mixing.mix(docs.repartition(7), block=16).collect())


def test_word_count(spark):
    texts = [None, "", " \t", "a b", " é\x0bü\x0c x y\x85z ", "a" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert [r.n for r in df.orderBy("i").select(mixing.word_count(F.col("t")).alias("n")).collect()] == want


def test_edges(spark):
    schema = "doc_id long, source string, text string, TARGET int"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix(spark.createDataFrame([(None, None, None, 1), (1, "a", "x y", 1), (1, "a", "x y", 1)], schema)).collect()
    assert len(got) == 3 and all(r.taken <= 2 * r.size for r in got)


def test_as_many_sources_as_documents(spark):
    """No window sees all sources: ranges are summed first. Every source has its target, null among them."""
    n = 700
    docs = spark.createDataFrame([(i, f"s{i:04}" if i else None, "w " * (i % 40 + 1)) for i in range(n)], "doc_id long, source string, text string")
    got = {r.source: r for r in mixing.mix(docs, block=4).collect()}
    want = brute_targets({f"s{i:04}" if i else None: i % 40 + 1 for i in range(n)})
    assert got.keys() == want.keys() and all(math.isclose(got[s].target, want[s], rel_tol=1e-9) for s in want)
    assert all(r.taken <= 2 * r.size for r in got.values())
    assert abs(sum(r.taken for r in got.values()) - sum(want.values())) < 0.1 * sum(want.values())


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "a", "x y z", 1, 2, 3, {"k": i}) for i in range(30)], "doc_id long, source string, text string, _id int, _row int, _times int, m map<string,int>")
    out = mixing.repeat_documents(docs, block=3)
    assert out.columns == docs.columns and {r._times for r in out.collect()} == {3} and 40 <= out.count() <= 50


def test_query_on_a_table(spark):
    """The registered query's sizes, targets and bounds on every document, and each source's words near its target."""
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op9_source_mix"](spark, sf)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    docs, rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}, got.collect()
    sizes, taken, targets = {}, {}, {}
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) and 0 <= r.taken <= 2 * r.size
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
        targets.setdefault(s, set()).add((r.source_size, r.target))
    want = brute_targets(sizes)
    assert len(rows) == len(docs) and all(len(v) == 1 for v in targets.values())
    for s, (pair,) in ((s, tuple(v)) for s, v in targets.items()):
        assert pair[0] == sizes[s] and math.isclose(pair[1], want[s], rel_tol=1e-9) and abs(taken[s] - want[s]) <= 8 * mixing.BLOCK
