"""Inventories: classes, attribute coverage, tag grammar, near duplicates, crosstabs, thresholds, confusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_inventory(items: DataFrame, cls: str, tagged: Column, element: str) -> DataFrame:
    """count, share tagged (percent, one decimal), first and all elements of a class."""
    g = items.groupBy(cls).agg(F.count("*").alias("n"), F.count(F.when(tagged, 1)).alias("_t"), F.array_sort(F.collect_set(element)).alias("_e"))
    return g.select(cls, "n", F.round(100.0 * F.col("_t") / F.col("n"), 1).alias("pct_tagged"), F.array_join("_e", ",").alias("elements"))


def attribute_coverage(items: DataFrame, attributes: str) -> DataFrame:
    """Map column -> name, n, n_distinct, samples (first three in order)."""
    e = items.select(F.explode(attributes).alias("name", "value"))
    g = e.groupBy("name", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("name").orderBy("value")
    g = g.withColumn("_i", F.row_number().over(w))
    return g.groupBy("name").agg(F.sum("c").alias("n"), F.count("value").alias("n_distinct"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_i") <= 3, F.col("value")))), ",").alias("samples"))


def shape_of(part: Column) -> Column:
    return F.when(part.rlike("^[0-9]+$"), "numeric").when(part.rlike("^[A-Za-z]+$"), "alpha").otherwise("mixed")


def tag_grammar(parts: DataFrame, position: str, value: str) -> DataFrame:
    """position, n, shape (the most frequent), suspects: how many values have another shape."""
    s = parts.groupBy(position, shape_of(F.col(value)).alias("shape")).agg(F.count("*").alias("c"))
    g = s.groupBy(position).agg(F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("less"), "shape")).alias("m"))
    return g.select(position, "n", F.col("m.shape").alias("shape"), (F.col("n") + F.col("m.less")).alias("suspects"))


def near_duplicates(objects: DataFrame, keys: list[Column], tag: str, n: int = 2) -> DataFrame:
    """Groups of at least n different tags that agree in keys."""
    g = objects.groupBy(*keys).agg(F.array_sort(F.collect_set(tag)).alias("_t")).filter(F.size("_t") >= n)
    return g.withColumn("tags", F.array_join("_t", ",")).drop("_t")


def mode_of(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, of several the least, with counts."""
    c = df.groupBy(group, value).agg(F.count("*").alias("c"))
    g = c.groupBy(group).agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.min(F.struct((-F.col("c")).alias("less"), value)).alias("m"))
    return g.select(group, "n", "n_distinct", F.col(f"m.{value}").alias("mode"))


def threshold(scored: DataFrame, score: str, label: str, precision: float) -> DataFrame:
    """The score threshold of greatest recall among those of at least this precision; failing that, of greatest F0.5."""
    by = scored.groupBy(F.col(score).alias("at")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    c = by.select("at", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("found"), F.sum("p").over(Window.partitionBy(F.lit(0))).alias("all"))
    pr, rc = F.col("tp") / F.col("found"), F.when(F.col("all") > 0, F.col("tp") / F.col("all")).otherwise(0.0)
    f = F.when(0.25 * pr + rc > 0, 1.25 * pr * rc / (0.25 * pr + rc)).otherwise(0.0)
    c = c.select("at", pr.alias("precision"), rc.alias("recall"), (pr >= precision).cast("int").alias("ok"), f.alias("f05"))
    best = F.max(F.struct("ok", F.when(F.col("ok") == 1, F.col("recall")).otherwise(F.col("f05")).alias("v"), "at", "precision", "recall"))
    return c.agg(best.alias("b")).select(F.col("b.at").alias("at"), F.round("b.precision", 6).alias("precision"), F.round("b.recall", 6).alias("recall"), (F.col("b.ok") == 1).alias("met"))


def distinctive(rows: DataFrame, group: str, cls: str, top: int = 4) -> DataFrame:
    """Classes whose share in a group is most over their share at large: group, class, over, place."""
    c = rows.groupBy(group, cls).agg(F.count("*").alias("c"))
    local = F.col("c") / F.sum("c").over(Window.partitionBy(group))
    world = F.sum("c").over(Window.partitionBy(cls)) / F.sum("c").over(Window.partitionBy(F.lit(0)))
    d = c.withColumn("over", F.round(local - world, 9))
    return d.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("over"), cls))).filter(F.col("place") <= top).select(group, cls, "over", "place")


def item_summary(items: DataFrame) -> DataFrame:
    """One row over plant items: items, drawings, classes, tags (different ones) and untagged."""
    return items.agg(
        F.count("*").alias("items"), F.countDistinct("drawing").alias("drawings"), F.countDistinct("component_class").alias("classes"),
        F.countDistinct("tag").alias("tags"), F.count(F.when(F.col("tag").isNull(), 1)).alias("untagged"),
    )


def fluid_counts(segments: DataFrame, total: str = "TOTAL") -> DataFrame:
    """Segments (drawing, fluid_code) -> drawing, fluid_code, n_segments, with a total over drawings for each code."""
    g = segments.filter("fluid_code IS NOT NULL").rollup("fluid_code", "drawing").agg(F.count("*").alias("n_segments"), F.grouping("drawing").alias("_d"), F.grouping("fluid_code").alias("_f"))
    return g.filter("_f = 0").select(F.when(F.col("_d") == 1, total).otherwise(F.col("drawing")).alias("drawing"), "fluid_code", "n_segments")


def folder_summary(files: DataFrame) -> DataFrame:
    """Files (folder, size_kb, readable) -> folder, files, size_kb, readable."""
    return files.groupBy("folder").agg(F.count("*").alias("files"), F.round(F.sum("size_kb"), 1).alias("size_kb"), F.count(F.when(F.col("readable"), 1)).alias("readable"))


def disposition_counts(dispositions: DataFrame) -> DataFrame:
    return dispositions.groupBy("status").agg(F.count("*").alias("n"))


def review_precision(decisions: DataFrame) -> DataFrame:
    """Decisions (verdict: accepted or rejected) -> accepted, rejected and precision, null where nothing was decided."""
    g = decisions.agg(F.count(F.when(F.col("verdict") == "accepted", 1)).alias("accepted"), F.count(F.when(F.col("verdict") == "rejected", 1)).alias("rejected"))
    n = F.col("accepted") + F.col("rejected")
    return g.withColumn("precision", F.when(n > 0, F.col("accepted") / n))


def centroids(words: DataFrame, key: list[str], x: str = "x", y: str = "y") -> DataFrame:
    return words.groupBy(*key).agg(F.avg(x).alias(x), F.avg(y).alias(y))


def longest_suffix(stems: DataFrame, labels: DataFrame) -> DataFrame:
    """stem, label: of the labels (label) whose key ends a stem's, or is ended by it, the longest (then the least); null if none.

    Keys are letters and digits in lower case. A stem meets the labels by the hash of each of its endings, never all labels.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: c.substr(i, F.length(c)))
    s, l = stems.select("stem", norm("stem").alias("k")).filter("k <> ''"), labels.select("label", norm("label").alias("j")).filter("j <> ''")
    a = s.select("stem", F.explode(ends(F.col("k"))).alias("e")).join(l, F.col("e") == F.col("j")).select("stem", "label", "j")
    b = l.select("label", "j", F.explode(ends(F.col("j"))).alias("e")).join(s, F.col("e") == F.col("k")).select("stem", "label", "j")
    best = a.unionByName(b).groupBy("stem").agg(F.min(F.struct((-F.length("j")).alias("less"), "label")).alias("m")).select("stem", F.col("m.label").alias("label"))
    return stems.select("stem").join(best, "stem", "left")
