import math
import random
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import ftrl, language, queries, toxicity

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"  # the smaller has six toxic documents in the held-out fold


def test_ftrl_is_sparse_and_learns():
    rng = random.Random(1)
    model = ftrl.Ftrl(50, alpha=0.5, l1=5.0)
    for _ in range(600):
        at = np.array([0, *sorted(rng.sample(range(1, 50), 6))])
        model.learn(at, np.ones(7), np.array([float(7 in at)]))
    w = model.weights()[:, 0]
    assert w[7] == w.max() > 1 and (w == 0).sum() > 5
    assert ftrl.probabilities(np.array([[0.0, 0.0]])).tolist() == [[0.5, 0.5]] and ftrl.probabilities(np.array([-800.0]))[0] == 0


def test_least_hashes(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    a = {r[0] for r in ftrl.least_hashes(df, "doc_id", 50).collect()}
    assert len(a) == 50 and a == {r[0] for r in ftrl.least_hashes(df.repartition(7), "doc_id", 50).collect()}
    assert ftrl.least_hashes(df.limit(0), "doc_id", 5).count() == 0


def test_held_out_is_crc32(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 17, 123456789012, None)], "doc_id long")
    got = [r[0] for r in df.select(toxicity.held_out()).collect()]
    assert got == [True if i is None else zlib.crc32(str(i).encode()) % 5 == 0 for i in (0, 1, 17, 123456789012, None)]


def test_features(monkeypatch):
    one = toxicity.features("You LOSER, you loser! you été")
    assert one.tolist() == toxicity.features("you loser you loser you Été").tolist() == sorted(set(one.tolist()))
    assert len(toxicity.features(None)) == len(toxicity.features("")) == 1
    words = " ".join(f"w{i % 37}x{i}" for i in range(300))
    whole = toxicity.features(words)
    monkeypatch.setattr(toxicity, "STEP", 16)
    assert toxicity.features(words).tolist() == whole.tolist()


def test_toxicity_held_out(spark):
    """A planted vocabulary, few of its words in each text, under new endings in the held-out texts too."""
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(900):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 200))]
        bad = i % 9 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grawl", "snurk", "blegh"]) + rng.choice(["", "er", "ing", "s"]))
        rows.append((i, " ".join(words), 5))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, SCORE int"), spark.createDataFrame(marks, "doc_id long, toxic int")
    out = toxicity.held_out()
    got = toxicity.score(docs, toxicity.train(docs.filter(~out), labels.filter(~out))).filter(out).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "score", "predicted"}
    right = [r.predicted == int(r.doc_id % 9 == 0) for r in got]
    assert sum(right) / len(right) > 0.97


def test_language_counts_by_steps(monkeypatch):
    text = "Straße über señor 123 " * 40
    at, n = language.counts(text)
    monkeypatch.setattr(language, "STEP", 50)
    again = language.counts(text)
    assert at.tolist() == again[0].tolist() and n.tolist() == again[1].tolist()
    assert n.sum() == sum(len(text) - k + 1 for k in language.ORDERS)


def test_temperature():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 4000)
    scores = np.eye(3)[truth] * 2 + rng.normal(0, 1, (4000, 3))
    assert abs(language.temperature(scores * 4, truth) / language.temperature(scores, truth) - 4) < 0.5


def test_queries_on_small_tables(spark):
    """Columns, bounds, the fold, and held-out quality: of the toxic class by itself, since most documents are not toxic."""
    got = queries.QUERIES["op10_language_id"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) > 0.98 * len(out)
    got = queries.QUERIES["op2_toxicity"](spark, LARGER)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id").collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").filter("toxic IS NOT NULL").collect()}
    rows = got.collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    found = sum(r.predicted for r in held if truth[r.doc_id])
    flagged, toxic = sum(r.predicted for r in held), sum(truth[r.doc_id] for r in held)
    assert toxic > 50 and found >= 0.8 * toxic and found >= 0.9 * flagged, (found, flagged, toxic)


def order(spark, rows, salt=None):
    """doc_ids by the hash that learning goes by."""
    df = spark.createDataFrame([(r[0],) for r in rows], "doc_id long")
    return [r.doc_id for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]


def plain_ftrl(rows, classes, rate, beta, l1, l2):
    """Rows (features as a dict, target list) by plain loops; weights as dicts, one for each class."""
    z, n = [{} for _ in range(classes)], [{} for _ in range(classes)]

    def weight(k, i):
        if abs(z[k].get(i, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[k][i]) - z[k][i]) / ((beta + math.sqrt(n[k].get(i, 0.0))) / rate + l2)

    for x, y in rows:
        w = [{i: weight(k, i) for i in x} for k in range(classes)]
        s = [sum(w[k][i] * v for i, v in x.items()) for k in range(classes)]
        p = [1 / (1 + math.exp(-s[0]))] if classes == 1 else [math.exp(v - max(s)) / sum(math.exp(u - max(s)) for u in s) for v in s]
        for k in range(classes):
            for i, v in x.items():
                g, had = v * (p[k] - y[k]), n[k].get(i, 0.0)
                z[k][i] = z[k].get(i, 0.0) + g - (math.sqrt(had + g * g) - math.sqrt(had)) / rate * w[k][i]
                n[k][i] = had + g * g
    return [{i: weight(k, i) for i in z[k]} for k in range(classes)]


def test_toxicity_as_brute_force(spark):
    """Weights and scores against plain loops, from features by another way: words, pairs and skip pairs, with Python's own sets."""
    rng, rows = random.Random(12), []
    for i in range(120):
        words = rng.choices(["alpha", "beta", "gamma", "delta", "idiot", "idiots", "zzzz"], k=rng.randrange(0, 9))
        rows.append((i, " ".join(words) if i % 17 else None, int("idiot" in words or "idiots" in words)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")

    def coordinates(text):
        h = [xxhash.xxh64_intdigest(w.encode()) for w in (text or "").split()]
        m, top = [int(x) for x in toxicity._MIX], 1 << 64
        grams = [a * m[0] for a in h] + [(a * m[1] + b) % top * m[0] for a, b in zip(h, h[1:])] + [(a * m[2] + b) % top * m[0] for a, b in zip(h, h[2:])]
        grams += [xxhash.xxh64_intdigest(w.encode()[:k], 1) for w in (text or "").split() for k in toxicity.STEMS if len(w) > k]
        return {g % top >> 64 - 20 for g in grams}

    xs = {r[0]: {c % (toxicity.SIZE - 1): 1.0 for c in coordinates(r[1])} | {toxicity.SIZE - 1: 1.0} for r in rows}
    by = {r[0]: r for r in rows}
    learned = [(xs[i], [float(by[i][2])]) for _ in range(3) for i in order(spark, rows)]
    (w,) = plain_ftrl(learned, 1, 0.5, 1.0, 0.5, 0.0)
    got = toxicity.score(docs, toxicity.train(docs, labels, epochs=3, rate=0.5, l1=0.5)).collect()
    want = {i: 1 / (1 + math.exp(-sum(w.get(c, 0.0) for c in x))) for i, x in xs.items()}
    assert len({round(v, 6) for v in want.values()}) > 20
    assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-9) for r in got)
    table = {(r.epochs, r.rate): r for r in toxicity.tuning(docs, labels, [(3, 0.5, 0.5), (1, 0.01, 0.5)]).collect()}
    assert table[3, 0.5].n == table[1, 0.01].n > 0 and table[3, 0.5].loss < table[1, 0.01].loss and table[3, 0.5].found > 0


def test_language_as_brute_force(spark, monkeypatch):
    """Predictions against plain loops over n-grams as strings: counts, tf-idf, softmax FTRL and the temperature."""
    rng, rows = random.Random(13), []
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "ijklmnoé"}
    for i in range(160):
        lang = rng.choice(list(letters))
        rows.append((i, " ".join("".join(rng.choices(letters[lang], k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 6))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    def grams(text):
        out = {}
        for k in language.ORDERS:
            for i in range(len(text) - k + 1):
                h = 0
                for c in text.lower()[i : i + k]:
                    h = (h + ord(c)) * int(language._MIX) % (1 << 64)
                    h ^= h >> 29
                at = h * int(language._MIX) % (1 << 64) >> 64 - 16
                out[at] = out.get(at, 0) + 1
        return out

    counted = {i: grams(t) for i, t, _ in rows}
    df = {}
    for g in counted.values():
        for at in g:
            df[at] = df.get(at, 0) + 1

    def vector(g):
        x = {at: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df.get(at, 0))) + 0.1) for at, n in g.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {at: v / size for at, v in x.items()} | {language.SIZE: 0.2}

    xs, by, names = {i: vector(g) for i, g in counted.items()}, {r[0]: r for r in rows}, sorted(letters)
    ids = spark.createDataFrame([(r[0],) for r in rows], "doc_id long")
    aside = {r.doc_id for r in ids.filter(F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0).collect()}
    learned = [(xs[i], [float(by[i][2] == n) for n in names]) for _ in range(language.EPOCHS) for i in order(spark, rows) if i not in aside]
    w = plain_ftrl(learned, 3, 1.0, 1.0, 0.02, 0.001)
    scores = {i: [sum(w[k].get(at, 0.0) * v for at, v in x.items()) for k in range(3)] for i, x in xs.items()}

    def soft(s, t):
        e = [math.exp((v - max(s)) / t) for v in s]
        return [v / sum(e) for v in e]

    def loss(t):
        return sum(-math.log(soft(scores[i], t)[names.index(by[i][2])] + 1e-12) for i in aside)

    heat = min(np.exp(np.linspace(np.log(0.02), np.log(20), 200)), key=loss)
    model = language.train(docs)
    assert math.isclose(model.heat, heat, rel_tol=1e-9)
    for r in language.predict(docs, model).collect():
        p = soft(scores[r.doc_id], heat)
        assert r.lang_pred == names[p.index(max(p))] and abs(r.score - max(p)) < 1e-4


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "123 !", "de"), (None, "ab cd", None), (3, "123 !", "de")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.predict(odd, language.train(none)).collect()} == {"und"}
    one = language.train(odd.unionByName(spark.createDataFrame([(9, "Hallo Welt", "de")], odd.schema)))
    assert [r.lang_pred for r in language.predict(odd, one).collect()] == ["und", "und", "und", "de", "und"]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(got) == 5 and {r.predicted for r in got} == {0}
