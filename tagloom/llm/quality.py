"""Quality rules: statistics of texts, and robust multivariate outliers for each language and source.

A text's statistics become a vector of four: log mean word length, and the square roots of the shares of symbols, of repeated
lines and of words in repeated word triples. The last two shares are taken over LINES lines and WORDS words more than the text
has, because one repeated line among five says little. For each (lang, source) the minimum-covariance-determinant estimate of
centre and scatter is searched for as deterministic MCD does: from three starts (median deviations; spatial signs; correlations
of hyperbolic tangents) concentration steps keep the half of the group's vectors that are nearest, take their mean and
covariance and measure anew. After FIRST steps the start of least determinant goes on until its determinant falls no more.
Equal vectors count once, so copies of one text carry no weight by their number. The scatter is made consistent for the normal
law, and widened by a floor in each coordinate so that statistics which are almost always the same (no symbols at all) don't
make a document with one an outlier; determinants are those of the widened scatter. A document is rejected if its squared
Mahalanobis distance is over CUT, the 0.999 quantile of its law for normal vectors, on the side of bad quality: distances count
only coordinates that are above the group's centre, or, for word length, off it on either side.

The groups of a language that have fewer than LEAST distinct vectors of documents which pass the base rule are estimated
together; if even these are fewer, they reject nothing. A group whose distinct vectors are odd by half or more breaks down.

Sums, counts and quantile sketches are combined before each shuffle, and estimates meet documents by join_groups, so a source
with most of the documents is no single task's work. All this runs in Spark's own functions. Null and empty texts have no
words; null lang or source is a group like any other, and so is a table without these columns. Word triples are told apart by
a 64-bit hash within one text. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import hidden, join_groups, keep_rows, named, row_hash, with_new, written
from tagloom.llm.exactdedup import squeezed
from tagloom.llm.pseudonyms import let

WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: Base rule: fewest words, and most words in repeated triples (in percent).
MIN_WORDS, MAX_REPEAT = 50, 50
#: Lines and words that shares are taken over beside a text's own.
LINES, WORDS = 20, 100
#: Share of a group's distinct vectors that is concentrated on, with the consistency factor for it and four coordinates.
SHARE, FACTOR = 0.5, 2.109
#: Steps of all starts, steps at most, and the fall of the log determinant that ends them.
FIRST, MOST, STILL = 2, 12, 1e-3
#: Floors of the coordinates' deviations, the chi-square quantile of 0.999 with four degrees, and least vectors of a group.
FLOORS, CUT, LEAST = (0.05, 0.06, 0.10, 0.10), 18.467, 50
VECTOR = ("z1", "z2", "z3", "z4")
PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]


def _repeated(triples: Column) -> Column:
    """Words that triples (by hash) found twice or more cover, the first included."""

    def covered(placed: Column) -> Column:
        # equal triples are neighbours here
        same = lambda k, x: F.coalesce(F.get(placed, k)["h"] == x["h"], F.lit(False))
        at = F.filter(placed, lambda x, k: same(k + 1, x) | (F.when(k > 0, same(k - 1, x)).otherwise(F.lit(False))))
        return F.aggregate(
            F.array_sort(F.transform(at, lambda x: x["i"])),
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    placed = F.array_sort(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(triples)) < F.size(triples), let(placed, covered)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long)."""
    t = F.coalesce(named(text), F.lit(""))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        triples = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
        return F.struct(n.cast("long").alias("n"), let(triples, _repeated).alias("repeat"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup"))

    words, lines = hidden(2)
    some = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn(words, let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), of_words)).withColumn(lines, let(some, of_lines))
    new = {
        "n_words": F.col(f"{words}.n"),
        "word_chars": F.length(squeezed(named(text))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOL)).cast("long"),
        "n_lines": F.col(f"{lines}.n"),
        "n_dup_lines": F.col(f"{lines}.dup"),
        "n_repeat_words": F.col(f"{words}.repeat"),
    }
    return with_new(out, new).drop(words, lines)


def vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + LINES)),
        F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + WORDS)),
    ]


def with_factor(estimate: DataFrame) -> DataFrame:
    """Columns m*, c** -> also l**, column by column so that no expression is repeated in another."""
    low: dict[tuple[int, int], Column] = {}
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        estimate = estimate.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return estimate


def distance(df: DataFrame, off: list[Column]) -> DataFrame:
    """df with d2, the squared Mahalanobis distance of the offsets by the columns l**."""
    for i in range(4):
        y = off[i]
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"_y{k}")
        df = df.withColumn(f"_y{i}", y / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, 4)), F.col("_y0") * F.col("_y0"))).drop(*[f"_y{i}" for i in range(4)])


def names() -> list[str]:
    """The columns of an estimate: centre, scatter and its factor."""
    return [f"m{i}" for i in range(4)] + [f"{a}{i}{j}" for a in "cl" for i, j in PAIRS]


def widened(estimate: DataFrame, factor: float) -> DataFrame:
    """Columns m*, c** -> with the scatter made consistent and widened, its factor, and ldet, half its log determinant."""
    for i, j in PAIRS:
        c = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0)) * factor
        estimate = estimate.withColumn(f"c{i}{j}", c + FLOORS[i] ** 2 if i == j else c)
    estimate = with_factor(estimate)
    return estimate.withColumn("ldet", sum((F.log(f"l{i}{i}") for i in range(1, 4)), F.log("l00")))


def starts(vectors: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Rows (keys, z1..z4) -> a written table with three first estimates of each group, numbered in `start`."""
    z = [F.col(x) for x in VECTOR]
    middle = vectors.groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile_approx(z[i], 0.5, 1000).alias(f"m{i}") for i in range(4)])
    off = join_groups(vectors, written(middle, "mcd-middle"), keys, "n", total)
    wide = off.groupBy(*keys).agg(F.first("n").alias("n"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(4)], *[F.percentile_approx(F.abs(z[i] - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i in range(4)])
    wide = wide.select(*keys, "n", *[f"m{i}" for i in range(4)], *[F.greatest(1.4826 * F.col(f"s{i}"), F.lit(FLOORS[i])).alias(f"s{i}") for i in range(4)])
    near = join_groups(vectors, written(wide, "mcd-wide"), keys, "n", total)
    near = near.select("*", *[((z[i] - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"u{i}") for i in range(4)])
    length = F.sqrt(sum((F.col(f"u{i}") * F.col(f"u{i}") for i in range(1, 4)), F.col("u0") * F.col("u0")))
    near = near.withColumn("length", F.greatest(length, F.lit(1e-9)))
    sign, tanh = [F.col(f"u{i}") / F.col("length") for i in range(4)], [F.tanh(f"u{i}") for i in range(4)]
    shapes = near.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("n", *[f"{a}{i}" for a in "ms" for i in range(4)])],
        *[(4 * F.avg(sign[i] * sign[j])).alias(f"sign{i}{j}") for i, j in PAIRS],
        *[F.covar_pop(tanh[i], tanh[j]).alias(f"tanh{i}{j}") for i, j in PAIRS],
    )
    tanh_scale = lambda i: F.sqrt(F.greatest(F.col(f"tanh{i}{i}"), F.lit(1e-9)))
    shape = {
        0: lambda i, j: F.lit(1.0 if i == j else 0.0),
        1: lambda i, j: F.col(f"sign{i}{j}"),
        2: lambda i, j: F.lit(1.0) if i == j else F.col(f"tanh{i}{j}") / tanh_scale(i) / tanh_scale(j),
    }
    some = F.array(*[F.struct(F.lit(k).alias("start"), *[(of(i, j) * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}") for i, j in PAIRS]) for k, of in shape.items()])
    first = shapes.select(*keys, "n", *[f"m{i}" for i in range(4)], F.explode(some).alias("one"))
    return written(widened(first.select(*keys, "n", *[f"m{i}" for i in range(4)], "one.*"), 1.0), "mcd-start")


def concentrated(vectors: DataFrame, current: DataFrame, keys: list[str], total: int, share: float, factor: float) -> DataFrame:
    """One concentration step of estimates (keys, start, n, names, ldet): a written table like it, with fell, how far ldet fell."""
    z, each = [F.col(x) for x in VECTOR], [*keys, "start"]
    held = ["n", "ldet", *names()]

    def measured(estimate: DataFrame) -> DataFrame:
        return distance(join_groups(vectors, estimate, keys, "n", total), [z[i] - F.col(f"m{i}") for i in range(4)])

    limit = measured(current.select(*each, *held)).groupBy(*each).agg(F.percentile_approx("d2", share, 1000).alias("limit"), *[F.first(c).alias(c) for c in held])
    near = measured(written(limit, "mcd-limit"))
    z = [F.when(F.col("d2") <= F.col("limit"), x) for x in z]
    step = near.groupBy(*each).agg(
        F.first("n").alias("n"), F.first("ldet").alias("before"), *[F.avg(z[i]).alias(f"m{i}") for i in range(4)], *[F.covar_pop(z[i], z[j]).alias(f"c{i}{j}") for i, j in PAIRS]
    )
    return written(widened(step, factor).withColumn("fell", F.col("before") - F.col("ldet")).drop("before"), "mcd-step")


def estimates(vectors: DataFrame, keys: list[str], share: float = SHARE, factor: float = FACTOR) -> DataFrame:
    """Written rows (keys, z1..z4) -> one row a group: keys, n, centre m0..m3, scatter c00..c33 and its factor l00..l33."""
    total = vectors.count()
    current = starts(vectors, keys, total)
    for _ in range(FIRST):
        current = concentrated(vectors, current, keys, total, share, factor)
    # the start of least determinant goes on; equally small ones are told apart by their number
    rest = [c for c in current.columns if c not in keys]
    best = current.groupBy(*keys).agg(F.min(F.struct("ldet", "start", *[c for c in rest if c not in ("ldet", "start")])).alias("b"))
    current = written(best.select(*keys, "b.*"), "mcd-best")
    for _ in range(MOST - FIRST):
        current = concentrated(vectors, current, keys, total, share, factor)
        if current.filter(F.col("fell") > STILL).isEmpty():
            break
    return current.select(*keys, "n", *names())


def judge(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, row_hash, the statistics, base_failed, distance (null where the group is too small) and kept."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    plain = docs.select("doc_id", "text", lang.alias("lang"), source.alias("source"), row_hash(docs).alias("row_hash"))
    rows = statistics(plain).drop("text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    rows = written(rows.select("*", *[z.alias(v) for z, v in zip(vector(), VECTOR)]), "quality")
    good = F.count_distinct(F.when(~F.col("base_failed"), F.struct(*VECTOR)))
    groups = written(rows.groupBy("lang", "source").agg(F.count("*").alias("n"), good.alias("n_good")), "quality-groups")
    small = F.col("n_good") < LEAST
    rows = join_groups(rows, groups.withColumn("pooled", small).drop("n_good"), ["lang", "source"], "n").drop("n")
    rows = written(rows.withColumn("source", F.when(~F.col("pooled"), F.col("source"))), "quality")
    keys = ["lang", "source", "pooled"]
    distinct = written(rows.filter("NOT base_failed").select(*keys, *VECTOR).distinct(), "quality-vectors")
    good = estimates(distinct, keys).withColumnRenamed("n", "n_good")
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n")).alias("g")
    alike = [F.col(f"g.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    fits = groups.join(good.alias("e"), alike[0] & alike[1] & alike[2], "left")
    fits = written(fits.select(*[f"g.{k}" for k in keys], "n", "n_good", *names()), "quality-fits")
    near = join_groups(rows, fits, keys, "n")
    off = [F.col(v) - F.col(f"m{i}") for i, v in enumerate(VECTOR)]
    near = distance(near, [off[0], *[F.greatest(x, F.lit(0.0)) for x in off[1:]]])
    near = near.withColumn("distance", F.when(F.col("n_good") >= LEAST, F.col("d2")))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUT)
    return near.select("doc_id", "row_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without those that are rejected; columns as they were."""
    return keep_rows(docs, written(judge(docs), "quality-decided").filter("kept"))
