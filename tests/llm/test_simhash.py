import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import queries
from tagloom.llm import simhash as sh


def brute_print(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(codes, linked=lambda a, b: (a ^ b).bit_count() <= 2):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    codes = sorted(root)
    for i, a in enumerate(codes):
        for b in codes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One TWO", "É é x y z\x0bq", "the cat sat on the mat " * 40, "a b c d"])
def test_fingerprint(text):
    assert sh.fingerprint(text) == brute_print(text)


def clouds(rng, n):
    out = set()
    while len(out) < n:
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 40])):
            out.add(c)
            for _ in range(rng.choice([1, 2, 3])):
                c ^= 1 << rng.randrange(64)
    return sorted(out)


def test_index_as_brute_force():
    rng = random.Random(3)
    for _ in range(5):
        base = rng.getrandbits(42) << 22
        codes = sorted({base | rng.getrandbits(12) for _ in range(300)}, key=lambda g: (lambda r: r)(g ^ g >> 1))
        label = sh.GrayIndex(np.array(codes, np.uint64), np.array([0, 120])).components()
        want = {**brute_components(codes[:120]), **brute_components(codes[120:])}
        got = {}
        for i, c in enumerate(codes):
            got.setdefault(label[i], set()).add(c)
        groups = {}
        for c, r in want.items():
            groups.setdefault(r, set()).add(c)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_masks_cover_all_pairs():
    masks = [m & (1 << 64) - 1 for m in sh.block_masks()]
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_components_of_codes(spark):
    codes = clouds(random.Random(1), 700)
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) * 2 for c in codes], "node long, code long")
    got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in sh.components(sh.links(df)).collect()}
    mine, want = {}, {}
    for c, r in brute_components(codes).items():
        want.setdefault(r, set()).add(c)
        mine.setdefault(got.get(c, c), set()).add(c)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(-60, 60)] + [(500, 700)], "a long, b long")
    got = {r.node: r.root for r in sh.components(edges).collect()}
    assert got == {i: -60 for i in range(-59, 61)} | {700: 500}


def test_frame(spark):
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(300))
    rows = [(i, base + (" end" if i % 2 else ""), i) for i in range(10, 30)] + [(1, "", 0), (2, None, 0), (3, "other text here", 0), (3, "other  TEXT here", 0), (None, "alone among all", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ROW int")
    out = sh.near_duplicates(docs).collect()
    want = brute_components({brute_print(t) for _, t, _ in rows})
    least = {}
    for d, t, _ in rows:
        if d is not None:
            r = want[brute_print(t)]
            least[r] = min(d, least.get(r, d))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in out) == sorted((str(d), f"{brute_print(t):016x}", least.get(want[brute_print(t)])) for d, t, _ in rows)
    kept = sh.keep_one(docs).collect()
    assert len(kept) == len({want[brute_print(t)] for _, t, _ in rows}) and sh.keep_one(docs).columns == docs.columns
    assert sh.near_duplicates(docs.limit(0)).count() == 0 and sh.keep_one(docs.filter("doc_id > 9")).count() == len({want[brute_print(t)] for d, t, _ in rows if d and d > 9})


def both(a, b, bits=6, second=14):
    return (a[0] ^ b[0]).bit_count() <= bits and (a[1] ^ b[1]).bit_count() <= second


def test_index_with_a_second_fingerprint():
    rng = random.Random(8)
    codes = sorted(((rng.getrandbits(12) << 20, rng.choice([0, (1 << 15) - 1]) ^ 1 << rng.randrange(15)) for _ in range(300)), key=lambda x: x[0] ^ x[0] >> 1)
    label = sh.GrayIndex(np.array([a for a, _ in codes], np.uint64), np.array([0]), np.array([b for _, b in codes], np.uint64), 6).components(3)
    keyed = [(i, *c) for i, c in enumerate(codes)]
    want = brute_components(keyed, lambda a, b: both(a[1:], b[1:], 3, 6))
    assert label.tolist() == [want[k][0] for k in keyed] and 1 < len(set(label.tolist())) < 200


@pytest.mark.parametrize("bits, n", [(2, 10**9), (6, 1), (6, 10**5), (6, 10**7), (6, 10**10)])
def test_blocks_cover_the_bits(bits, n):
    b = sh.blocks_for(n, bits)
    masks = [m & (1 << 64) - 1 for m in sh.block_masks(b, bits)]
    rng = random.Random(1)
    for _ in range(300):
        off = sum(1 << i for i in rng.sample(range(64), bits))
        assert any(not m & off for m in masks)
    assert min(m.bit_count() for m in masks) >= min(n.bit_length() - 7, 28)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_linked_by_two_fingerprints(spark):
    """As brute force over all pairs, on families of edited texts; the near copies are found and strangers are not."""
    rng, rows = random.Random(11), []
    for f in range(30):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.randrange(60, 300))]
        rows += [(len(rows) + i, " ".join(edited(rng, base, rng.randrange(4)))) for i in range(rng.randrange(1, 7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in sh.near_duplicates(docs, 6, 3, (5, 14)).collect()}
    keyed = [(i, brute_print(t), brute_print(t, 5)) for i, t in rows]
    want = brute_components(keyed, lambda a, b: both(a[1:], b[1:]))
    assert got == {k[0]: want[k][0] for k in keyed}
    assert 30 <= len(set(got.values())) < len(rows)


def test_query_on_a_table(spark):
    """The registered query against brute force over all pairs of fingerprints."""
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op8_simhash_near_dedup"](spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = {r.doc_id: brute_print(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    roots, least = brute_components(set(prints.values())), {}
    for d, c in prints.items():
        least[roots[c]] = min(d, least.get(roots[c], d))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()} == {(d, f"{c:016x}", least[roots[c]]) for d, c in prints.items()}


def test_maps_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, "one two three four", 1, 2, 3, 4, {"a": 1}) for i in range(3)], "doc_id long, text string, _id int, code int, n int, second int, m map<string,int>")
    assert sh.keep_one(docs, 6, 3, (5, 14)).collect() == [docs.first()]
