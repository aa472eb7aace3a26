"""The searches within a tile, and over tiles, against all pairs."""

import numpy as np
import pytest

from tagloom.operators import planar


def clouds():
    rnd = np.random.default_rng(1)
    lattice = lambda n: (rnd.integers(0, 60, n).astype(float), rnd.integers(0, 40, n).astype(float))
    spread = lambda n: (rnd.random(n) * 100 - 50, rnd.random(n) * 80)
    lumps = lambda n: (rnd.normal(size=n) ** 3, rnd.normal(size=n) ** 3)
    line = lambda n: (rnd.integers(0, 90, n).astype(float), np.zeros(n))
    return [(f(n), f(m)) for f in (lattice, spread, lumps, line) for n, m in ((150, 300), (40, 3), (7, 0))]


@pytest.mark.parametrize("reach", [0.0, 0.1, 3.0, 5.0, 17.3, 200.0])
def test_as_all_pairs(reach):
    for (lx, ly), (rx, ry) in clouds():
        rank = np.random.default_rng(2).permutation(len(rx))
        dx, dy = lx[:, None] - rx, ly[:, None] - ry
        d2 = dx * dx + dy * dy
        near = d2 <= reach * reach
        assert (planar.count_in_radius(lx, ly, rx, ry, reach) == near.sum(axis=1)).all()
        want = [min(((d2[i, j], rank[j], j) for j in np.flatnonzero(near[i])), default=(0, 0, -1))[2] for i in range(len(lx))]
        assert planar.nearest_in_radius(lx, ly, rx, ry, rank, reach).tolist() == want
        box = (np.abs(dx) < 2 * reach) & (np.abs(dy) < reach)
        want = [min(((abs(dy[i, j]), rank[j], j) for j in np.flatnonzero(box[i])), default=(0, 0, -1))[2] for i in range(len(lx))]
        assert planar.nearest_in_window(lx, ly, rx, ry, rank, (2 * reach, reach))[0].tolist() == want
        lk, rk = np.arange(len(lx)) % 5, np.arange(len(rx)) % 7
        assert (planar.count_same(lx, ly, lk, rx, ry, rk, reach) == (near & (lk[:, None] == rk)).sum(axis=1)).all()


def test_work_does_not_grow_with_pairs():
    """A hundred thousand points on one sheet have 1.5 thousand million pairs in reach."""
    rnd = np.random.default_rng(3)
    x, y = rnd.integers(0, 1000, 100_000) / 10, rnd.integers(0, 97, 100_000).astype(float)
    assert planar.count_in_radius(x, y, x, y, 30.0).sum() > 1.5e9
    assert (planar.nearest_in_radius(x, y, x, y, np.arange(100_000), 25.0) >= 0).all()
    assert (planar.nearest_in_window(x, y, x, y, np.arange(100_000), (160.0, 50.0))[1] == 0).all()


def test_tiles(spark):
    """Keys repeat, places and keys are missing, tiles have a rim and no point of their own."""
    from tagloom.operators import spatial

    rnd = np.random.default_rng(4)
    rows = [("ab"[i % 2], None if i == 5 else i % 90, None if i == 7 else float(rnd.integers(-60, 60)), float("nan") if i == 9 else float(rnd.integers(0, 9))) for i in range(120)]
    rows += [("c", 1000, 0.0, 0.0), ("c", 1001, 11.9, 0.0), (None, 1002, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "g string, k long, x double, y double")
    near = lambda a, b: None not in (a[0], a[2], b[2]) and a[0] == b[0] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 144
    keys = {(r[0], r[1]) for r in rows}
    n = {k: sum(near(a, b) for a in rows if a[:2] == k for b in rows if k[1] is not None and b[1] not in (None, k[1])) for k in keys}
    got = spatial.radius_count(p, ["g"], "k", "x", "y", 12.0).collect()
    assert len(got) == len(rows) and {((r.g, r.k), r.n) for r in got} == set(n.items())
    left, right = p.filter("k <= 30 OR k >= 1000").toDF("g", "k", "lx", "ly"), p.filter("k > 30").select("g", p.x.alias("rx"), p.y.alias("ry"))
    want = sorted(repr(tuple(a[:2])) for a in rows if a[1] is not None and (a[1] <= 30 or a[1] >= 1000) and not any(near(c, b) for c in rows if c[:2] == a[:2] for b in rows if b[1] is not None and b[1] > 30))
    assert sorted(repr(tuple(r)) for r in spatial.without_near(left, right, ["g"], "k", 12.0).collect()) == want
