"""Positioned words of drawings (drawing, system, text, x, y, seq) to tags and line labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import tags as T
from tagloom.operators.spatial import nearest_in_window

TYPE_WORDS = [t for ts in T.CATEGORIES.values() for t in ts]


def extract_tags(words: DataFrame) -> DataFrame:
    """drawing, tag: tags written out in the words or across them, and type words with the nearest number in their column."""
    text = words.groupBy("drawing").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda w: w["text"]), " ").alias("text"))
    inline = text.select("drawing", F.explode(T.inline_tags(F.col("text"))).alias("tag")).unionByName(words.select("drawing", F.explode(T.inline_tags(F.col("text"))).alias("tag")))
    types = words.filter(F.col("text").isin(TYPE_WORDS)).select("drawing", "system", F.col("seq").alias("key"), F.col("text").alias("code"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    numbers = words.filter(F.col("text").rlike(r"^\d{2,4}(?:[A-Z]?|[A-Z](?:/[A-Z])+)$")).select("drawing", F.col("text").alias("number"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = nearest_in_window(types, numbers, ["drawing"], "key", "number", (16.0, 50.0)).join(types.select("drawing", "key", "system", "code"), ["drawing", "key"])
    base = F.concat("system", F.lit("-"), "code", F.regexp_extract("number", r"^(\d+)", 1))
    bubbles = pairs.select("drawing", F.explode(T.legs(base, F.regexp_extract("number", r"^\d+(.*)$", 1))).alias("tag"))
    return inline.unionByName(bubbles).distinct()


def line_labels(words: DataFrame, dy: float = 2.0, gap: float = 8.0) -> DataFrame:
    """drawing, text, x, y, label: words that end in a hyphen run on into the next of the same line, then are decoded.

    words also has x0 and x1, the ends of a word.
    """
    w = Window.partitionBy("drawing").orderBy("seq")
    joins = F.lag("text").over(w).endswith("-") & (F.abs(F.col("y") - F.lag("y").over(w)) < dy) & (F.col("x0") - F.lag("x1").over(w)).between(0, gap)
    run = words.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = run.groupBy("drawing", "_run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return g.withColumn("label", T.line_label(F.col("text"))).filter("label IS NOT NULL").drop("_run")
