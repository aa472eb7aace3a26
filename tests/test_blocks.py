"""Blocks against each other, against all pairs listed one by one."""

import math

import numpy as np
import pytest

from tagloom.operators import blocks, similarity

SCHEMA = "g string, k long, v array<double>"


def vectors():
    """Groups with copies, keys that repeat, opposite vectors, ties, other lengths, zeros, missing and odd numbers."""
    rnd = np.random.default_rng(5)
    rows = [("ab"[i % 2], i, rnd.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    rows += [("a", 100 + i, [3.0, 4.0, 0.0, 0.0]) for i in range(40)] + [("a", 7, [1.0, 2.0, 2.0, 0.0]), ("b", 7, [-1.0, 0.0, 0.0, 0.0])]
    rows += [("a", 201, [0.0] * 4), ("a", 202, None), ("a", 203, [1.0, None, 0.0, 0.0]), (None, 204, [1.0] * 4), ("a", None, [1.0] * 4), ("d", 205, [1.0] * 4)]
    rows += [("b", 210 + i, [1.0, float(i)]) for i in range(3)] + [("e", 220, []), ("e", 221, [])]
    return rows + [("f", 230, [1.0, 2.0]), ("f", 231, [float("nan"), 1.0]), ("f", 232, [2.0, -1.0]), ("f", 233, [0.0, 5.0])]


@pytest.fixture(params=[16, 4096])
def side(request, monkeypatch):
    monkeypatch.setattr(similarity, "SIDE", request.param)


def listed(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_nearest(spark, side):
    v = spark.createDataFrame(vectors(), SCHEMA)
    want = similarity.neighbours(similarity.cosine_pairs(v, "g", "k", "v", -1.0), 3).select("key", "other", "place", "cosine")
    assert listed(similarity.nearest(v, "g", "k", "v", 3).select("key", "other", "place", "cosine")) == listed(want)


def test_nearest_makes_no_pairs(spark):
    """Six thousand vectors, half of them copies: eighteen million pairs listed row by row would take minutes."""
    rnd = np.random.default_rng(6)
    v = rnd.integers(-9, 10, (6000, 8)).astype(float)
    v[::2] = v[0]
    i, j, c = blocks.most_similar(v, v, np.arange(6000), 3, (np.arange(6000), np.arange(6000)))
    got = sorted(zip(i.tolist(), c.tolist(), j.tolist(), strict=True))
    copies = [x for x in got if x[0] % 2 == 0]
    assert len(got) == 18000 and all(x[1] == 1_000_000 for x in copies)
    assert {x[2] for x in copies if x[0] > 6} == {0, 2, 4}


def test_halves_are_rounded_as_the_formula_does():
    """Cosines a hair from half a millionth: the product alone may fall on either side."""
    a = np.array([[1.0, 0.0]])
    b = np.array([[c, math.sqrt(1 - c * c)] for c in ((n + 0.5) * 1e-6 for n in range(100_000, 100_400))])
    want = [math.floor(sum(x * y for x, y in zip(a[0], r, strict=True)) / math.sqrt(1.0 * (r[0] * r[0] + r[1] * r[1])) * 1e6 + 0.5) for r in b]
    assert next(blocks.millionths(a, b))[1][0].tolist() == want
    assert next(blocks.millionths(-a, b))[1][0].tolist() == [-x for x in want]


def test_links_group_as_all_pairs(spark, side):
    v = spark.createDataFrame(vectors(), SCHEMA)
    keys = v.select("k").filter("k IS NOT NULL")
    for least in (0.5, 0.95):
        want = similarity.linkage_groups(similarity.cosine_pairs(v, "g", "k", "v", least), keys)
        assert listed(similarity.linkage_groups(similarity.links(v, "g", "k", "v", least), keys)) == listed(want)


def test_copies_make_few_links():
    """A group of copies is a tree of few links to a row, not all pairs; a chain is joined from end to end, across blocks too."""
    i, j = blocks.spanning_links(np.ones((5000, 3)), None, 0.5)
    assert len(i) == 4999 and np.bincount(np.concatenate([i, j])).max() == 17
    turn = np.random.default_rng(7).permutation(300) * 0.02
    chain = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    assert len(blocks.spanning_links(chain, None, 0.9997)[0]) == 299
    i, j = blocks.spanning_links(chain[np.argsort(turn)[::2]], chain[np.argsort(turn)[1::2]], 0.9997)
    assert len(i) == 299 and max(i.max(), j.max()) == 299


@pytest.mark.parametrize("listed", [0, 1, 512, 1 << 40])
def test_shared_counts(monkeypatch, listed):
    """Frequent and rare patterns, few and many levels, as columns and as lists."""
    monkeypatch.setattr(blocks, "LISTED", listed)
    rnd = np.random.default_rng(8)
    full = rnd.poisson(1.0, (70, 40)) * (rnd.random((70, 40)) < rnd.random(40) ** 3) + (rnd.random((70, 40)) < 0.02) * rnd.integers(0, 10**6, (70, 40))
    a, b = full[:30], full[30:]
    entries = lambda x: (*np.nonzero(x), x[np.nonzero(x)])
    for largest in (1 << 23, 1 << 30):
        want = np.minimum(a[:, None], b[None]).sum(axis=2)
        got = blocks.shared_counts(entries(a), entries(b), (30, 40), 40, largest)
        assert (got == want).all() or largest == 1 << 23 and want.max() >= 1 << 24


def test_composition(spark, monkeypatch):
    """Against all pairs, in blocks; owners without a pattern of their own, missing patterns and owners."""
    from collections import Counter

    monkeypatch.setattr(similarity, "SIDE", 8)
    rnd = np.random.default_rng(9)
    rows = [(f"o{rnd.integers(0, 40)}", f"p{int(rnd.random() ** 3 * 60)}") for _ in range(900)] + [("o1", None), ("o2", None), (None, "p1"), ("x", "only"), ("y", None)]
    of = {o: Counter(p for k, p in rows if k == o) for o in {k for k, _ in rows if k}}
    both = [(x, y, sum((of[x] & of[y]).values()) - min(of[x][None], of[y][None])) for x in of for y in of if x < y]
    want = sorted((x, y, math.floor((1 - s / max(of[x].total(), of[y].total())) * 1e6 + 0.5) / 1e6) for x, y, s in both if s)
    assert sorted(map(tuple, similarity.composition_distance(spark.createDataFrame(rows, "o string, p string"), "o", "p").collect())) == want
