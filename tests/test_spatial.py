"""The sequential operators against plain versions that try everything."""

import random

import pytest

from tagloom.operators import spatial


def points(n, seed, nan=False):
    rnd = random.Random(seed)
    place = lambda: float(rnd.randrange(0, 40))
    return [(rnd.choice("ab"), i, None if nan and i % 9 == 0 else place(), place()) for i in range(n)]


@pytest.mark.parametrize("radius", [0.0, 3.0, 12.5, 100.0])
def test_greedy_match(spark, radius):
    truth, found = points(60, 1, True), points(50, 2, True)
    want, free = set(), list(found)
    for g, t, x, y in sorted(truth, key=lambda r: r[1]):
        reach = [((fx - x) ** 2 + (fy - y) ** 2, f) for fg, f, fx, fy in free if fg == g and None not in (x, fx)]
        d, f = min(reach, default=(0, None))
        hit = f if f is not None and d <= radius**2 else None
        free = [r for r in free if r[1] != hit]
        want.add((g, t, hit))
    a = spark.createDataFrame(truth, "g string, t long, tx double, ty double")
    b = spark.createDataFrame(found, "g string, f long, fx double, fy double")
    assert {tuple(r) for r in spatial.greedy_match(a, b, ["g"], radius).collect()} == want
    assert spatial.greedy_match(a.limit(0), b, ["g"], radius).count() == 0
    assert {r.f for r in spatial.greedy_match(a, b.limit(0), ["g"], radius).collect()} == {None}


def test_suppress(spark):
    rnd = random.Random(3)
    boxes = [(g, i, rnd.choice([0.2, 0.5, 0.9]), x, y, x + rnd.randrange(0, 12), y + 6.0) for g, i, x, y in points(80, 4)]

    def share(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        least = min((r[5] - r[3]) * (r[6] - r[4]) for r in (a, b))
        return w * h / least if w > 0 and h > 0 and least > 0 else 0.0

    kept = []
    for r in sorted(boxes, key=lambda r: (-r[2], r[1])):
        if all(k[0] != r[0] or share(k, r) <= 0.35 for k in kept):
            kept.append(r)
    df = spark.createDataFrame(boxes, "g string, id long, conf double, x0 double, y0 double, x1 double, y1 double")
    assert {r.id for r in spatial.suppress(df, ["g"]).collect()} == {r[1] for r in kept}


def test_pack(spark):
    rnd = random.Random(5)
    rows = [(g, i, float(rnd.choice([0, 1, 5, 9, 30]))) for g, i, _, _ in points(80, 6)]
    want = {}
    for g in "ab":
        packs = [[]]
        for _, i, s in (r for r in rows if r[0] == g):
            if sum(packs[-1]) and sum(packs[-1]) + s > 20:
                packs.append([])
            packs[-1].append(s)
            want[i] = len(packs) - 1
    got = spatial.pack(spark.createDataFrame(rows, "g string, i long, size double"), "g", "i", "size", 20.0).collect()
    assert {r.i: r.pack for r in got} == want
