import random
import re
from collections import Counter

import numpy as np
import pytest

from tagloom.llm import quality as q
from tagloom.llm import queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x x x x x", "x x x", "l1 a\nl1 a\n\n \nl1 a\nl2", "é#*$%&|<> ü\x85z \x0b w", "a b c d a b c e b c d f", "a\nb\nc\n" * 50]


def test_statistics(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choices(["a", "b", "c", "dd", "|"], k=rng.randrange(60))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, N_WORDS string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.statistics(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def corpus(rng):
    rows = []
    for i in range(400):
        words = ["".join(rng.choices("abcdefgh", k=rng.choice([2, 3, 4, 5, 6, 9]))) for _ in range(rng.randrange(60, 400))]
        kind = ""
        if i % 33 == 7:
            words, kind = [x for w in words for x in (w, "|")], "piped"
        elif i % 33 == 9:
            words, kind = [w + "!!!!!!!!!" for w in words], "shouted"
        elif i % 33 == 11:
            words, kind = words[:30], "short"
        elif i % 33 == 13:
            words, kind = words[:40] * 4, "repeated"
        rows.append((i, " ".join(words), "en" if i % 2 else None, "hot" if i % 3 else "cold", kind))
    return rows


def test_rejects_what_is_odd(spark):
    rows = corpus(random.Random(4))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in q.judge(docs).collect()}
    assert len(got) == 400
    for i, text, *_, kind in rows:
        n = brute(text)
        assert got[i].base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert got[i].kept == (kind == ""), (kind, got[i])
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[4] == "" for r in rows)


def step(z, m, cov):
    d = np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(cov), z - m)
    near = z[d <= np.sort(d)[int(np.ceil(len(z) * q.SHARE)) - 1]]
    return near.mean(0), np.cov(near.T, bias=True) * q.FACTOR + np.diag(np.square(q.FLOORS))


def brute_estimate(z):
    """The three starts and the concentration steps with numpy; centre, scatter."""
    n, floor = len(z), np.diag(np.square(q.FLOORS))
    middle = lambda x: np.sort(x, 0)[int(np.ceil(n / 2)) - 1]
    m = middle(z)
    s = np.maximum(middle(abs(z - m)) * 1.4826, q.FLOORS)
    u = (z - m) / s
    sign, tanh = u / np.linalg.norm(u, axis=1)[:, None], np.tanh(u)
    found = []
    for shape in (np.eye(4), 4 * sign.T @ sign / n, np.corrcoef(tanh.T)):
        now = m, shape * np.outer(s, s) + floor
        for _ in range(q.FIRST):
            now = step(z, *now)
        found.append(now)
    now = min(found, key=lambda x: np.linalg.det(x[1]))
    for _ in range(q.MOST - q.FIRST):
        before, now = now, step(z, *now)
        if np.log(np.linalg.det(before[1])) - np.log(np.linalg.det(now[1])) <= 2 * q.STILL:
            break
    return now


def planted(rng, odd):
    z = rng.normal([2, 0.1, 0.2, 0.3], [0.1, 0.2, 0.3, 0.1], (500, 4)) @ np.array([[1, 0.3, 0, 0], [0, 1, 0, 0.2], [0, 0, 1, 0], [0, 0, 0.4, 1]])
    z[:odd] += [3, 2, 1, 2]
    return z


def test_estimate_as_brute_force(spark):
    """As numpy has it, in several groups at once, and with a determinant hardly over the least of many random starts."""
    rng = np.random.default_rng(1)
    groups = {"a": planted(rng, 60), "b": planted(rng, 200), "c": planted(rng, 0)}
    df = spark.createDataFrame([(k, None, *map(float, r)) for k, z in groups.items() for r in z], "lang string, source string, z1 double, z2 double, z3 double, z4 double")
    for got in q.estimates(df, ["lang", "source"]).collect():
        z = groups[got.lang]
        m, cov = brute_estimate(z)
        assert np.allclose([got[f"m{i}"] for i in range(4)], m, atol=0.02)
        scatter = np.array([[got[f"c{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])
        assert np.allclose(scatter, cov, atol=0.02)
        low = np.array([[got[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
        assert np.allclose(low @ low.T, scatter)
        least = np.inf
        for _ in range(100):
            some = z[rng.choice(len(z), 5, replace=False)]
            now = some.mean(0), np.cov(some.T) + np.diag(np.square(q.FLOORS))
            for _ in range(15):
                now = step(z, *now)
            least = min(least, np.linalg.slogdet(now[1])[1])
        assert np.linalg.slogdet(scatter)[1] < least + 0.05


@pytest.mark.parametrize("n", [0, 3])
def test_edges(spark, n):
    docs = spark.createDataFrame([(None, None, None, None), (1, "", "en", None), (1, "", "en", None)][:n], "doc_id long, text string, lang string, source string")
    assert [r.kept for r in q.judge(docs).collect()] == [False] * n and q.keep_good(docs).count() == 0
    bare = spark.createDataFrame([(1, "word " + " ".join(map(str, range(60))))], "doc_id long, text string")
    assert q.keep_good(bare).count() == 1


def test_repeated_lines_and_many_copies(spark):
    """Documents with repeated lines go, as do copies of one odd text that make up a third of a group; others stay."""
    rng = random.Random(8)

    def lines(n):
        return ["".join(rng.choices("abcdefgh", k=8)) + " " + "".join(rng.choices("abcdefgh", k=rng.choice([3, 5, 6]))) for _ in range(n)]

    rows = [(i, "\n".join(lines(rng.randrange(60, 90))), "clean") for i in range(200)]
    # two words a line: repeated lines are apart, so no triple of words repeats
    for i in range(200, 206):
        some = lines(40)
        rows.append((i, "\n".join(x for k, line in enumerate(some) for x in ([line, *lines(1), some[0]] if k % 2 else [line])), "repeated"))
    odd = "\n".join(f"{x} |" for x in lines(70))
    rows += [(i, odd, "copy") for i in range(206, 306)]
    docs = spark.createDataFrame([(i, t, "en", "hot") for i, t, _ in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in q.judge(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [(k, got[i].kept) for i, _, k in rows if got[i].kept != (k == "clean")] == []


def test_short_texts_with_a_repeated_line_stay(spark):
    """One repeated line of seven says little; forty of a hundred and twenty do."""
    rng = random.Random(9)
    line = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.choice([3, 4, 5, 6]))) for _ in range(n))
    rows = []
    for i in range(300):
        lines = [line(9) for _ in range(rng.randrange(6, 12))]
        rows.append((i, "\n".join([*lines, lines[0]] if i % 3 == 0 else lines)))
    few = [line(2) for _ in range(40)]
    rows.append((300, "\n".join(x for y in few for x in (y, line(2), few[0]))))
    got = {r.doc_id: r.kept for r in q.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, kept in got.items() if not kept] == [300]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), 1, 2, 3, 4, {"a": 1})], "doc_id long, text string, _words int, _triples int, _lines int, _id int, m map<string,int>")
    assert q.keep_good(docs).columns == docs.columns and q.keep_good(docs).first()[2:6] == (1, 2, 3, 4)
    assert q.statistics(docs).columns[:7] == docs.columns


def test_query_on_a_table(spark):
    """The registered query's base statistics against the plain version, on every document."""
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op7_quality_rules"](spark, sf)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
