"""Language: sparse multinomial logistic regression on TF-IDF character n-grams, learned by FTRL with L1 and L2, calibrated.

A text in lower case is cut into character n-grams (ORDERS), hashed into SIZE coordinates. Counts become tf-idf (1 + log of
the count, times the log inverse share of texts that have the coordinate) of length 1. Text frequencies are counted over all
texts that may be learned from. The model sees at most TRAIN_ROWS of them, those of least hash of doc_id; a fifth of these, by
another hash, is kept back to fit a temperature that scores are divided by before softmax, so that they say how often a
prediction is right (none if there are fewer than 50).

Counts are taken where the documents are. One task then reads them in a fixed order, once for each epoch and at last those
kept back, and holds one batch at a time; it gives the same model if it has to run again. A text that is null or has no letter
is `und` with score 0. If nothing can be learned from, every text is. Ties go to the language of lesser code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tagloom.llm.common import named, small_batches, with_struct
from tagloom.llm.ftrl import Ftrl, bucket_of, least_hashes, probabilities

#: Coordinates of n-grams (one more is the intercept), lengths of n-grams, documents learned from at most, times they are gone through.
SIZE, ORDERS, TRAIN_ROWS, EPOCHS = 1 << 16, (1, 2, 3, 4), 6000, 2
#: Characters hashed at a time.
STEP = 1 << 20
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - SIZE.bit_length() + 1)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of a text's n-grams, and how often each occurs."""
    total = np.zeros(SIZE, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    for low in range(0, len(code), STEP):
        part = code[low : low + STEP + max(ORDERS) - 1].astype(np.uint64)
        h, grams = np.zeros(len(part), np.uint64), []
        for n in range(1, max(ORDERS) + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] + part[n - 1 :]) * _MIX
            h ^= h >> np.uint64(29)
            if n in ORDERS:
                grams.append((h[:STEP] * _MIX) >> _SHIFT)
        total += np.bincount(np.concatenate(grams).view(np.int64), minlength=SIZE)
    at = np.flatnonzero(total)
    return at, total[at]


def tfidf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of a text with these counts, length 1, and the intercept."""
    x = (1 + np.log(n)) * idf[at]
    length = np.sqrt((x * x).sum())
    return np.append(at, SIZE), np.append(x / length if length else x, 0.2)


def temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The divisor, on a fine grid, under which the true classes are likeliest."""
    if not len(truth):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    loss = [-np.log(probabilities(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class Model:
    """Languages, idf, sparse weights and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, at: np.ndarray, values: np.ndarray, heat: float):
        self.langs, self.idf, self.at, self.values, self.heat = langs, idf, at, values, heat
        self.dense: np.ndarray | None = None

    def __getstate__(self) -> tuple:
        return self.langs, self.idf, self.at, self.values, self.heat

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def predict(self, text: str | None) -> tuple[str, float]:
        import regex

        if not text or not self.langs or not regex.search(r"\p{L}", text):
            return "und", 0.0
        if self.dense is None:
            self.dense = np.zeros((SIZE + 1, len(self.langs)))
            self.dense.reshape(-1)[self.at] = self.values
        at, x = tfidf(*counts(text), self.idf)
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        p = probabilities(x @ self.dense[at] / self.heat)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def text_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of docs' texts each coordinate occurs, and the number of texts: counted in the tasks, then summed by coordinate."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                at, _ = counts(text.as_py())
                total[at] += 1
                total[SIZE] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    rows = docs.select("text").mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()  # SIZE + 1 rows at most
    out = np.zeros(SIZE + 1, np.int64)
    for at, n in rows:
        out[at] = n
    return out[:SIZE], int(out[SIZE])


def learner(names: list[str], rate: float = 1.0, l1: float = 0.02, l2: float = 0.001) -> Ftrl:
    return Ftrl(SIZE + 1, max(2, len(names)), alpha=rate, l1=l1, l2=l2)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> Model:
    """A model learned from docs (doc_id, text, lang); rows with a null among them are left out."""
    known = docs.select("doc_id", "text", "lang").filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    having, n = text_frequencies(known)
    idf = np.log((1 + n) / (1 + having)) + 0.1
    sample = least_hashes(known, "doc_id", rows)
    # languages of the bounded sample: rows at most
    sizes = dict(sample.groupBy("lang").count().collect())
    names, some = sorted(sizes, key=lambda x: x.encode("utf-8")), sum(sizes.values()) >= 50
    if not names:
        return Model([], idf.astype(np.float32), np.zeros(0, np.int64), np.zeros(0), 1.0)
    if len(names) == 1:
        return Model(names, idf.astype(np.float32), np.zeros(0, np.int64), np.zeros(0), 1.0)

    @arrow_udf("struct<at:binary,n:binary>")
    def counted(texts: pa.Array) -> pa.Array:
        got = [counts(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x.astype(np.int32).tobytes() for x, _ in got], pa.binary()), pa.array([c.astype(np.int64).tobytes() for _, c in got], pa.binary())], ["at", "n"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        m, one, held, truth, w = learner(names), np.eye(len(names)), [], [], None
        for batch in batches:
            for aside, lang, at, c in zip(*[x.to_pylist() for x in batch.columns]):
                y = names.index(lang)
                at, x = tfidf(np.frombuffer(at, np.int32).astype(np.int64), np.frombuffer(c, np.int64), idf)
                if not aside:
                    m.learn(at, x, one[y])
                    continue
                w = m.weights() if w is None else w
                held.append(x @ w[at])
                truth.append(y)
        flat = m.weights().reshape(-1)
        at = np.flatnonzero(flat)
        heat = temperature(np.array(held), np.array(truth, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((at, flat[at], heat))])], ["model"])

    aside = F.lit(some) & (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0)
    taken = small_batches(sample).select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", aside.alias("aside"), counted("text").alias("c"))
    taken = taken.withColumn("epoch", F.explode(F.when(F.col("aside"), F.array(F.lit(epochs + 1))).otherwise(F.sequence(F.lit(1), F.lit(epochs)))))
    ordered = taken.repartition(1).sortWithinPartitions("epoch", "h", "doc_id", "lang", "c").select("aside", "lang", "c.at", "c.n")
    import pickle

    at, values, heat = pickle.loads(bytes(ordered.mapInArrow(learn, "model binary").first()["model"]))
    return Model(names, idf.astype(np.float32), at, values, heat)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred (string) and score (double, 0 to 1)."""

    @arrow_udf("struct<lang_pred:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        got = [model.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["lang_pred", "score"])

    return with_struct(small_batches(docs), run(named(text)), ["lang_pred", "score"])


def held_out(column: str = "doc_id", n: int = 3, fold: int = 1) -> Column:
    """Whether a row is kept from learning; rows without an id always are."""
    return F.coalesce(bucket_of(F.col(column), n) == fold, F.lit(True))
