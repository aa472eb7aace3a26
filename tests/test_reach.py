"""Reach by bits against closures, and that the queries on dense graphs write no row for each seed and node."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.operators import graph as G
from tagloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("words", [1, 2])
def test_reach_counts_as_closure(spark, words):
    rnd = random.Random(words)
    edges = spark.createDataFrame([(rnd.randrange(0, 90), rnd.randrange(0, 150)) for _ in range(190)], "src long, dst long")
    seeds = spark.createDataFrame([(i,) for i in [*range(0, 140), 3, 3, None]], "seed long")
    among = spark.createDataFrame([(i,) for i in range(0, 150, 7)], "node long")
    c = G.closure(edges, seeds).filter("seed <> node")
    want = lambda df: {tuple(r) for r in df.groupBy("seed").agg(F.count("*"), F.max("depth")).collect()}
    assert {tuple(r) for r in G.reach_counts(edges, seeds, words=words).collect()} == want(c)
    assert {tuple(r) for r in G.reach_counts(edges, seeds, among, words).collect()} == want(c.join(among, "node", "left_semi"))
    assert G.reach_counts(edges, seeds.limit(0)).count() == 0 == G.reach_counts(edges.limit(0), seeds).count()


@pytest.mark.parametrize("name", ["failure_closure", "candidate_brief"])
def test_no_closure_of_the_whole_graph(spark, monkeypatch, name):
    whole, closure = catalog.QUERIES["degree_ranking"](spark, SF).agg(F.sum("out_degree")).first()[0], G.closure

    def noted(edges, seeds, *more):
        assert edges.count() < whole / 10
        return closure(edges, seeds, *more)

    monkeypatch.setattr(G, "closure", noted)
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("whole, most", [(0, 4_000_000), (0, 100), (0, 0)])
def test_reach_counts_of_components(spark, monkeypatch, whole, most):
    """Components in tasks, beside one too large for a task, and all by rounds; more than a block of seeds; names as nodes."""
    monkeypatch.setattr(G, "WHOLE", whole)
    monkeypatch.setattr(G, "TASK_EDGES", most)
    rnd = random.Random(most)
    rows = [(rnd.randrange(0, 90), rnd.randrange(0, 90)) for _ in range(180)] + [(100 + rnd.randrange(0, 40), 100 + rnd.randrange(0, 40)) for _ in range(60)]
    edges = spark.createDataFrame([(f"P{a}", f"P{b}") for a, b in rows] + [(None, "P1")], "src string, dst string")
    seeds = spark.createDataFrame([(f"P{i}",) for i in range(150)], "seed string")
    among = spark.createDataFrame([(f"P{i}", i % 3) for i in range(0, 150, 2)] + [("P4", 5)], "node string, weight long")
    c = G.closure(edges.dropna(), seeds).filter("seed <> node")
    want = lambda df, n: {tuple(r) for r in df.groupBy("seed").agg(n, F.max("depth")).collect()}
    assert {tuple(r) for r in G.reach_counts(edges, seeds, words=1).collect()} == want(c, F.count("*"))
    weighted = c.join(among.groupBy("node").agg(F.sum("weight").alias("w")).filter("w > 0"), "node")
    assert {tuple(r) for r in G.reach_counts(edges, seeds, among, 1).collect()} == want(weighted, F.sum("w"))


def test_failure_closure_writes_no_rounds_of_nodes(spark, monkeypatch):
    """A component that fits a task is walked there: nothing is written for each round."""
    monkeypatch.setattr(G, "_reach_by_rounds", None)
    before, made = G.Rounds, []
    monkeypatch.setattr(G, "Rounds", lambda first: made.append(first) or before(first))
    assert catalog.QUERIES["failure_closure"](spark, SF).count() > 0
    assert not made


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_reach_of_block_in_pieces(chunk):
    """Rows of a round are taken in pieces that end between two heads."""
    rnd = random.Random(chunk)
    edges = {(rnd.randrange(0, 200), rnd.randrange(0, 200)) for _ in range(500)}
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    want = set()
    for seed in range(0, 200, 2):
        depth, ring, far = {seed: 0}, [seed], 0
        while ring:
            ring = sorted({b for a in ring for b in out.get(a, ())} - depth.keys())
            far += bool(ring)
            depth |= dict.fromkeys(ring, far)
        if far:
            want.add((seed, len(depth) - 1, far))
    rows = [(0, a, b, 0) for a, b in edges] + [(1, s, s, 0) for s in range(0, 200, 2)]
    got = G._reach_of_block(False, 200, chunk)(pd.DataFrame(rows, columns=["kind", "src", "dst", "weight"]))
    assert set(got.itertuples(index=False, name=None)) == want


@pytest.mark.parametrize("degree", [1, 6])
def test_reach_sizes_as_closure(spark, degree):
    """Two plants of cycles, chains into and out of them, and seeds that are no nodes; grouped by some edges or by all."""
    rnd = random.Random(degree)
    rows = [(base + rnd.randrange(0, 60), base + rnd.randrange(0, 60)) for base in (0, 100) for _ in range(300)]
    rows += [(60 + i, 61 + i) for i in range(12)] + [(72, 5), (7, 80)] + [(80 + i, 81 + i) for i in range(12)] + [(200, 201), (201, 200), (None, 3), (4, None), (9, 9)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    seeds = spark.createDataFrame([(i,) for i in [*range(0, 210, 2), 8, 8, None]], "seed long")
    among = spark.createDataFrame([(i,) for i in [*range(0, 210, 3), 9, None]], "node long")
    c = G.closure(edges.dropna(), seeds).filter("seed <> node").join(among.distinct(), "node", "left_semi")
    want = {tuple(r) for r in c.groupBy("seed").count().collect()}
    for few in (0, 20, 256):
        assert {tuple(r) for r in G.reach_sizes(edges, seeds, among, few, degree, 0).collect()} == want


def test_mutual_groups_reach_each_other(spark):
    rnd = random.Random(5)
    edges = spark.createDataFrame([(rnd.randrange(0, 50), rnd.randrange(0, 50)) for _ in range(120)], "src long, dst long")
    groups = G.mutual_groups(edges, spark.createDataFrame([(i,) for i in range(0, 50, 4)], "node long")).collect()
    reach = {tuple(r)[:2] for r in G.closure(edges, spark.createDataFrame([(i,) for i in range(50)], "seed long")).collect()}
    assert len({r["node"] for r in groups}) == len(groups) > len({r["group"] for r in groups})
    assert all(r["node"] == r["group"] or {(r["node"], r["group"]), (r["group"], r["node"])} <= reach for r in groups)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_candidate_brief_groups_what_reaches_each_other(spark, monkeypatch):
    """The rows of reach are of groups, not of nodes: on a cycle of 600 alarms one seed is left."""
    left, counts, sizes = [], G.reach_counts, G.reach_sizes

    def noted(edges, seeds, *more):
        left.append((edges.count(), seeds.distinct().count()))
        return counts(edges, seeds, *more)

    monkeypatch.setattr(G, "reach_counts", noted)
    monkeypatch.setattr(G, "reach_sizes", lambda *tables: sizes(*tables, small=0))
    rnd = random.Random(6)
    rows = [(i, (i + 1) % 600) for i in range(600)] + [(rnd.randrange(600), rnd.randrange(600)) for _ in range(3000)]
    active = spark.createDataFrame([(i, float(i)) for i in range(600)], "node long, t double")
    got = G.candidate_brief(spark.createDataFrame(rows, "src long, dst long"), active).collect()
    assert [(r["node"], r["explains"], r["members"]) for r in got if not r["detached"]] == [(0, 599, 600)]
    assert left and left[0][1] < 60
