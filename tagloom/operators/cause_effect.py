"""Cause and effect: stated logic between tags, held against a register. Rows that do not resolve stay, with a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.tags import loose_key

# What counts as signed off.
YES = ["ja", "yes", "y", "1"]


def norm(tag: Column) -> Column:
    """Capitals without blanks."""
    return F.upper(F.replace(F.coalesce(tag, F.lit("")), F.lit(" "), F.lit("")))


def _known(register: DataFrame, name: str) -> DataFrame:
    return register.groupBy(norm(F.col("tag")).alias(f"_{name}")).agg(F.max("tag").alias(name))


def validate(rows: DataFrame, register: DataFrame) -> DataFrame:
    """Rows (cause_tag, effect_tag, verified, ...) with cause and effect (the register's spelling, or null), ok (both resolved)
    and is_verified. Rows without a cause are blank lines and drop out."""
    r = rows.filter("trim(coalesce(cause_tag, '')) <> ''").withColumn("_cause", norm(F.col("cause_tag"))).withColumn("_effect", norm(F.col("effect_tag")))
    r = r.join(_known(register, "cause"), "_cause", "left").join(_known(register, "effect"), "_effect", "left")
    ok = F.col("cause").isNotNull() & F.col("effect").isNotNull()
    return r.select(*rows.columns, "cause", "effect", ok.alias("ok"), F.lower(F.trim("verified")).isin(YES).alias("is_verified"))


def statistics(valid: DataFrame) -> DataFrame:
    """One row: rows, resolved, verified, unknown_tags (how many different)."""
    unknown = F.explode(F.filter(F.array(F.when(F.col("cause").isNull(), F.col("cause_tag")), F.when(F.col("effect").isNull(), F.col("effect_tag"))), lambda x: x.isNotNull()))
    n = valid.select(unknown.alias("tag")).agg(F.countDistinct("tag").alias("unknown_tags"))
    return valid.agg(F.count("*").alias("rows"), F.count(F.when(F.col("ok"), 1)).alias("resolved"), F.count(F.when(F.col("ok") & F.col("is_verified"), 1)).alias("verified")).join(n, how="cross")


def designed_response(valid: DataFrame, faults: DataFrame, active: DataFrame) -> DataFrame:
    """fault, effect, function, is_verified, observed: what a fault (column tag) is designed to do, and whether it rang (active: tag)."""
    rang = active.select(norm(F.col("tag")).alias("_n")).distinct().withColumn("_rang", F.lit(True))
    d = valid.filter("ok").join(faults.select(F.col("tag").alias("cause")).distinct(), "cause").withColumn("_n", norm(F.col("effect"))).join(rang, "_n", "left")
    return d.select(F.col("cause").alias("fault"), "effect", "function", "is_verified", F.coalesce("_rang", F.lit(False)).alias("observed"))


def classified(read_tags: DataFrame, tag: str, register: DataFrame) -> DataFrame:
    """read_tags with status: verified (the register's), verified_loose (its type and number), new_candidate (like a tag), suspect."""
    squeezed = lambda c: F.regexp_replace(F.upper(F.trim(c)), r"\s+", "")
    exact = register.select(squeezed(F.col("tag")).alias("_s")).distinct().withColumn("_e", F.lit(True))
    loose = register.select(loose_key(F.col("tag")).alias("_k")).filter("_k IS NOT NULL").distinct().withColumn("_l", F.lit(True))
    j = read_tags.withColumn("_s", squeezed(F.col(tag))).withColumn("_k", loose_key(F.col(tag))).join(exact, "_s", "left").join(loose, "_k", "left")
    status = F.when(F.col("_e"), "verified").when(F.col("_l"), "verified_loose").when(F.col("_k").isNotNull(), "new_candidate").otherwise("suspect")
    return j.select(*read_tags.columns, status.alias("status"))


def read_rows(rows: DataFrame, register: DataFrame) -> DataFrame:
    """What was read off a sheet (drawing, seq, cause_tag, effect_tag) -> with cause_out and effect_out (the register's spelling
    where one tag alone has the type and number), their statuses, and verdict: kept, suspect, self_loop or repeated (all but
    the first of a pair). Nothing that was read is signed off."""
    keys = register.select("tag", loose_key(F.col("tag")).alias("_k")).filter("_k IS NOT NULL").distinct().groupBy("_k").agg(F.min("tag").alias("_one"), F.count("*").alias("_n")).filter("_n = 1").select("_k", "_one")
    exact = register.groupBy(norm(F.col("tag")).alias("_s")).agg(F.max("tag").alias("_exact"))
    r = rows.filter("trim(coalesce(cause_tag, '')) <> '' AND trim(coalesce(effect_tag, '')) <> ''")
    for side in ("cause", "effect"):
        r = classified(r, f"{side}_tag", register).withColumnRenamed("status", f"{side}_status")
        r = r.withColumn("_s", norm(F.col(f"{side}_tag"))).withColumn("_k", loose_key(F.col(f"{side}_tag"))).join(exact, "_s", "left").join(keys, "_k", "left")
        r = r.withColumn(f"{side}_out", F.coalesce("_exact", "_one", F.upper(F.trim(f"{side}_tag")))).drop("_s", "_k", "_exact", "_one")
    a, b = norm(F.col("cause_out")), norm(F.col("effect_out"))
    bad = (F.col("cause_status") == "suspect") | (F.col("effect_status") == "suspect")
    state = F.when(bad, "suspect").when(a == b, "self_loop").otherwise("kept")
    r = r.withColumn("_state", state).withColumn("_a", a).withColumn("_b", b)
    first = r.filter("_state = 'kept'").groupBy("drawing", "_a", "_b").agg(F.min("seq").alias("_first"))
    r = r.join(first, ["drawing", "_a", "_b"], "left")
    verdict = F.when((F.col("_state") == "kept") & (F.col("seq") > F.col("_first")), "repeated").otherwise(F.col("_state"))
    return r.select(*rows.columns, "cause_out", "effect_out", "cause_status", "effect_status", verdict.alias("verdict"))
