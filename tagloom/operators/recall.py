"""Where extraction loses tags: channels, nozzles, text that is there, drawings that yield nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.tags import precision_recall, validation_key
from tagloom.functions.text import is_nozzle, is_valve_line
from tagloom.operators.register import match_status


def channel_scores(found: DataFrame, truth: DataFrame, union: str = "union", total: str = "TOTAL") -> DataFrame:
    """Found (drawing, channel, tag) and truth (drawing, tag) -> drawing, channel, truth, extracted, tp, missed, extra, precision,
    recall, f1, recall_ex_nozzle: for each channel, their union, and in total. Tags agree by validation key. Truth may say itself
    (nozzle boolean) which tags are nozzles; else their names do, of up to five digits."""
    key = validation_key(F.col("tag"))
    f = found.select("drawing", "channel", key.alias("key"))
    f = f.unionByName(f.select("drawing", F.lit(union).alias("channel"), "key")).distinct()
    nozzle = F.col("nozzle") if "nozzle" in truth.columns else is_nozzle(F.trim("tag"))
    t = truth.select("drawing", key.alias("key"), nozzle.alias("nozzle")).groupBy("drawing", "key").agg(F.min("nozzle").alias("nozzle"))
    each = t.join(F.broadcast(f.select("channel").distinct()), how="cross")  # a handful of channels
    m = match_status(f, each, ["drawing", "channel", "key"]).join(t, ["drawing", "key"], "left")
    plain = ~F.coalesce("nozzle", F.lit(False))
    n = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("tp", "missed", "extra")]
    n += [F.count(F.when(plain & (F.col("status") == s), 1)).alias(f"_{s}") for s in ("tp", "missed")]
    g = m.groupBy("drawing", "channel").agg(*n).unionByName(m.groupBy("channel").agg(*n).withColumn("drawing", F.lit(total)))
    ex = F.when(F.col("_tp") + F.col("_missed") > 0, F.round(F.col("_tp") / (F.col("_tp") + F.col("_missed")), 3)).otherwise(0.0)
    return g.select("drawing", "channel", (F.col("tp") + F.col("missed")).alias("truth"), (F.col("tp") + F.col("extra")).alias("extracted"), "tp", "missed", "extra", *precision_recall(F.col("tp"), F.col("missed"), F.col("extra")), ex.alias("recall_ex_nozzle"))


def difference_class(tag: Column) -> Column:
    return F.when(tag.rlike(r"^\d{2}-[A-Z]{1,4}\d"), "instrument").when(tag.rlike(r"^\d{2}-\d{2,4}[A-Z]"), "valve_line").otherwise("other")


def what_if(report: DataFrame, differences: DataFrame, cls: str = "valve_line") -> DataFrame:
    """Report (drawing, truth_tags, tp) and differences (drawing, tag, issue) -> one row: truth, tp, recovered (misses of a class),
    recall and recall_if, had they been found."""
    n = differences.filter(F.col("issue").startswith("MISSED") & (difference_class(F.col("tag")) == cls)).agg(F.count("*").alias("recovered"))
    s = report.agg(F.sum("truth_tags").alias("truth"), F.sum("tp").alias("tp")).join(n, how="cross")
    share = lambda c: F.when(F.col("truth") > 0, c / F.col("truth")).otherwise(0.0)
    return s.select("truth", "tp", "recovered", share(F.col("tp")).alias("recall"), share(F.col("tp") + F.col("recovered")).alias("recall_if"))


def near_zero_yield(report: DataFrame) -> DataFrame:
    """Drawings of five true tags or more of which at most a twentieth, or one, was extracted."""
    return report.filter((F.col("truth_tags") >= 5) & (F.col("extracted") <= F.greatest(F.lit(1.0), 0.05 * F.col("truth_tags"))))


def nozzle_adjusted(report: DataFrame, differences: DataFrame) -> DataFrame:
    """Report (drawing, tp, missed) -> drawing, tp, missed, nozzles, recall, recall_ex: nozzles are hardly ever written out, so
    leaving them out lessens the misses only."""
    n = differences.filter(F.upper("issue").contains("MISS") & is_nozzle(F.trim("tag"))).groupBy("drawing").agg(F.count("*").alias("nozzles"))
    j = report.join(n, "drawing", "left").withColumn("nozzles", F.coalesce("nozzles", F.lit(0)))
    share = lambda missed: F.when(F.col("tp") + missed > 0, F.col("tp") / (F.col("tp") + missed)).otherwise(0.0)
    return j.select("drawing", "tp", "missed", "nozzles", share(F.col("missed")).alias("recall"), share(F.col("missed") - F.col("nozzles")).alias("recall_ex"))


def text_present(differences: DataFrame, words: DataFrame) -> DataFrame:
    """drawing, text_present, symbol_only: missed valve and line tags that stand in the drawing's words (drawing, text), by the
    tag, the tag without its system, or its number; drawings without words are left out."""
    key = validation_key(F.col("tag"))
    m = differences.filter(F.upper("issue").contains("MISS") & is_valve_line(F.trim("tag")) & ~is_nozzle(F.trim("tag"))).select("drawing", "tag", key.alias("k"))
    bare = F.regexp_replace("k", r"^\d{1,3}", "")
    m = m.withColumn("u", bare).withColumn("n", F.regexp_replace("u", "[A-Z]", ""))
    w = words.select("drawing", validation_key(F.col("text")).alias("w")).filter("w <> ''").distinct()
    hit = F.col("w").contains(F.col("k")) | F.col("w").contains(F.col("u")) | ((F.col("n") != "") & F.col("w").contains(F.col("n")))
    # the words of one drawing meet its misses, which are few
    each = m.join(w, "drawing").groupBy("drawing", "tag").agg(F.max(hit.cast("int")).alias("hit"))
    return each.groupBy("drawing").agg(F.sum("hit").alias("text_present"), F.sum(1 - F.col("hit")).alias("symbol_only"))
