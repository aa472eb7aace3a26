"""Toxicity: a logistic model over hashed word n-grams and skip-grams, learned by FTRL-proximal.

A text's features are its distinct words, word pairs, pairs with one word between, and word stems (the first STEMS bytes of
longer words), hashed into SIZE coordinates; each is 1 or absent, so the length of a text does not dilute them. Stems go beyond
n-grams: they make an insult known under endings never seen, and `tuning` says what they are worth. Words are runs of ASCII
letters and digits and of all characters beyond ASCII, in lower case. L1 leaves few weights other than 0; these go to the
executors.

The model is learned from at most TRAIN_ROWS labelled documents, those of least hash of doc_id. Features are taken where the
documents are; one task then reads them in a fixed order, once for each epoch, and holds one batch at a time. If its executor
is lost the task runs again and gives the same model. RATE, L1 and EPOCHS come from `tuning`, which sees learning rows only.
Null texts count as empty, and have the score of a text without features. Without any label to learn from all scores are 0.5
less a hair: nothing is called toxic. A document with several labels is toxic if one says so; repeated rows count repeatedly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tagloom.llm.common import named, small_batches, with_new, with_struct
from tagloom.llm.ftrl import Ftrl, bucket_of, least_hashes, probabilities

#: Coordinates (the last is the intercept), and labelled documents learned from at most.
SIZE, TRAIN_ROWS = 1 << 20, 12000
#: Times they are gone through, rate and L1 penalty.
EPOCHS, RATE, L1 = 3, 1.0, 4.0
#: Bytes of stems.
STEMS = (4, 6)
#: Words hashed at a time.
STEP = 1 << 18
_WORD = bytes(ord(chr(c).lower()) if chr(c).isascii() and chr(c).isalnum() else c if c >= 128 else 32 for c in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def features(text: str | None, stems: tuple[int, ...] = STEMS) -> np.ndarray:
    """Distinct coordinates of a text, in order, the intercept among them."""
    import xxhash

    words = (text or "").lower().encode("utf-8").translate(_WORD).split()
    one, parts = xxhash.xxh64_intdigest, [np.array([SIZE - 1])]
    shift = np.uint64(64 - SIZE.bit_length() + 1)
    for low in range(0, len(words), STEP):
        h = np.array([one(w) for w in words[low : low + STEP + 2]], np.uint64)
        n = min(STEP, len(words) - low)
        grams = np.concatenate([h[:n] * _MIX[0], (h[:-1] * _MIX[1] + h[1:])[:n] * _MIX[0], (h[:-2] * _MIX[2] + h[2:])[:n] * _MIX[0]])
        begun = {w[:k] for w in set(words[low : low + STEP]) for k in stems if len(w) > k}
        grams = np.append(grams, np.array([one(w, 1) for w in begun], np.uint64))
        parts.append(np.unique(grams >> shift).astype(np.int64) % (SIZE - 1))
    return np.unique(np.concatenate(parts))


def model(rate: float = RATE, l1: float = L1) -> Ftrl:
    return Ftrl(SIZE, alpha=rate, l1=l1, l2=0.0)


class Weights:
    """The weights that are not 0, packed; unpacked once in each worker."""

    def __init__(self, at: bytes, values: bytes):
        self.at, self.values, self.dense = at, values, None

    def __getstate__(self) -> tuple:
        return self.at, self.values

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def score(self, text: str | None) -> float:
        if self.dense is None:
            self.dense = np.zeros(SIZE)
            self.dense[np.frombuffer(self.at, np.int32)] = np.frombuffer(self.values, np.float64)
        return float(probabilities(np.array([self.dense[features(text)].sum()]))[0])


NOTHING = Weights(np.array([SIZE - 1], np.int32).tobytes(), np.array([-1e-6]).tobytes())


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, stems: tuple[int, ...] = STEMS) -> DataFrame:
    """doc_id, h (the order), features (packed coordinates) and toxic of at most `rows` labelled ids, which are broadcast."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = least_hashes(known, "doc_id", rows)

    @arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py(), stems).astype(np.int32).tobytes() for t in texts], pa.binary())

    found = small_batches(docs.select("doc_id", "text")).join(F.broadcast(known), "doc_id")
    return found.select("doc_id", F.xxhash64("doc_id").alias("h"), packed("text").alias("features"), "toxic")


def in_order(rows: DataFrame, epochs: int) -> DataFrame:
    """`labelled` rows as one partition in a fixed order, all of them once an epoch."""
    every = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    return every.repartition(1).sortWithinPartitions("epoch", "h", "doc_id", "features").select("features", "toxic")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS, rate: float = RATE, l1: float = L1) -> Weights:
    """Weights learned from the labelled documents (labels: doc_id, toxic) that are not null."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, n = model(rate, l1), 0
        for batch in batches:
            for packed, label in zip(batch.column(0), batch.column(1).to_pylist()):
                at = np.frombuffer(packed.as_py(), np.int32).astype(np.int64)
                m.learn(at, np.ones(len(at)), np.array([float(label)]))
                n += 1
        if n:
            w = m.weights()[:, 0]
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([w[at].tobytes()])], ["at", "w"])

    got = in_order(labelled(docs, labels, rows), epochs).mapInArrow(learn, "at binary, w binary").first()
    return Weights(bytes(got["at"]), bytes(got["w"])) if got else NOTHING


def tuning(docs: DataFrame, labels: DataFrame, grid: list[tuple[int, float, float]], stems: tuple[int, ...] = STEMS, rows: int = TRAIN_ROWS) -> DataFrame:
    """epochs, rate, l1, n (toxic rows), found of them, flagged others and the sum of log losses for each of grid: learned from three quarters of the rows given and measured on
    the rest. Give learning rows only; each setting is a task of its own."""
    every = labelled(docs, labels, rows, stems).withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit("tuning")), F.lit(4)) == 0)
    settings = docs.sparkSession.createDataFrame([(i, *map(float, g)) for i, g in enumerate(grid)], "i int, epochs double, rate double, l1 double")
    each = every.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))).join(F.broadcast(settings), "i")
    each = each.withColumn("epoch", F.explode(F.when(F.col("aside"), F.array(F.lit(1 << 20))).otherwise(F.sequence(F.lit(1), F.col("epochs").cast("int")))))
    each = each.repartition(len(grid), "i").sortWithinPartitions("i", "epoch", "h", "doc_id").select("i", "epochs", "rate", "l1", "aside", "features", "toxic")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, m, weights, out = None, None, None, []
        for batch in batches:
            for i, epochs, rate, l1, aside, packed, label in zip(*[c.to_pylist() for c in batch.columns]):
                if i != now:
                    now, m, weights = i, model(rate, l1), None
                    out.append([int(epochs), rate, l1, 0, 0, 0, 0.0])
                at = np.frombuffer(packed, np.int32).astype(np.int64)
                if not aside:
                    m.learn(at, np.ones(len(at)), np.array([float(label)]))
                    continue
                weights = m.weights()[:, 0] if weights is None else weights
                s = float(weights[at].sum())
                one = out[-1]
                one[3] += int(label)
                one[4] += int(label and s >= 0)
                one[5] += int(not label and s >= 0)
                one[6] += float(np.logaddexp(0, -s if label else s))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out]) for k in range(7)], ["epochs", "rate", "l1", "n", "found", "flagged", "loss"])

    return each.mapInArrow(measure, "epochs bigint, rate double, l1 double, n bigint, found bigint, flagged bigint, loss double")


def score(docs: DataFrame, weights: Weights, text: str = "text") -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int)."""

    @arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([weights.score(t.as_py()) for t in texts], pa.float64())

    out = with_struct(small_batches(docs), F.struct(run(named(text)).alias("score")), ["score"])
    return with_new(out, {"predicted": (F.col("score") >= 0.5).cast("int")})


def held_out(column: str = "doc_id", n: int = 5, fold: int = 0) -> Column:
    """Whether a row is kept from learning; rows without an id always are."""
    return F.coalesce(bucket_of(F.col(column), n) == fold, F.lit(True))
