"""Tag registers: build, reconcile, score against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.tags import precision_recall


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str, str] = ("both", "left_only", "right_only")) -> DataFrame:
    """Distinct keys of both sides with a status; a full outer join after each side is made distinct."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(1))
    status = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), names[0]).when(F.col("_a").isNotNull(), names[1]).otherwise(names[2])
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def reconcile_summary(reconciled: DataFrame, group: str, names: tuple[str, str, str] = ("both", "left_only", "right_only")) -> DataFrame:
    """Counts of each status in a group, and the percentage in both to one decimal."""
    n = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in names]
    return reconciled.groupBy(group).agg(*n).withColumn("pct_both", F.round(100.0 * F.col(names[0]) / (F.col(names[0]) + F.col(names[1]) + F.col(names[2])), 1))


def build_register(mentions: DataFrame) -> DataFrame:
    """Mentions (tag, doc_type, file) -> tag, status, counts and sorted file lists of P&ID and SCD sheets."""
    def files(kind: str):
        return F.array_sort(F.collect_set(F.when(F.col("doc_type") == kind, F.col("file"))))

    r = mentions.groupBy("tag").agg(files("PID").alias("p"), files("SCD").alias("s"))
    status = F.when((F.size("p") > 0) & (F.size("s") > 0), "both").when(F.size("p") > 0, "pid_only").otherwise("scd_only")
    return r.select("tag", status.alias("status"), F.size("p").cast("long").alias("n_pid"), F.size("s").cast("long").alias("n_scd"), F.array_join("p", ";").alias("pid_files"), F.array_join("s", ";").alias("scd_files"))


def match_status(extracted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """tp, missed (only in truth) or extra (only extracted) for each distinct key."""
    return reconcile(truth, extracted, keys, ("tp", "missed", "extra"))


def scores(matched: DataFrame, group: str | None = None, total: str = "TOTAL") -> DataFrame:
    """Precision, recall and F1 of each group and a micro-averaged total row."""
    n = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("tp", "missed", "extra")]
    g = matched.rollup(group).agg(*n, F.grouping(group).alias("_t")) if group else matched.agg(*n)
    out = g.select(*([F.when(F.col("_t") == 1, total).otherwise(F.col(group)).alias(group)] if group else []), "tp", "missed", "extra", *precision_recall(F.col("tp"), F.col("missed"), F.col("extra")))
    return out


def first_source_wins(objects: DataFrame, key: str, rank: str) -> DataFrame:
    """One row a key: that of least rank; its other sources as a sorted list."""
    best = objects.groupBy(key).agg(F.min(F.struct(F.col(rank), *[c for c in objects.columns if c not in (key, rank)])).alias("_b"), F.array_sort(F.collect_set(rank)).alias("sources"))
    return best.select(key, "_b.*", "sources")


def update_merge(master: DataFrame, edits: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """master with the edits' values where they are not null; rows without an edit stay. Of several edits of a key the greatest
    value of each column counts, so no row is multiplied."""
    e = edits.groupBy(*keys).agg(*[F.max(v).alias(f"_new_{v}") for v in values])
    joined = master.join(e, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in master.columns])


def latest(events: DataFrame, key: str, order: list[str], deleted: str) -> DataFrame:
    """The last row of each key, unless it is a deletion (status equal to `deleted`)."""
    rest = [c for c in events.columns if c not in (key, *order)]
    last = events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_l")).select(key, "_l.*")
    return last.filter(F.col("status") != deleted)


def diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change (added, removed, changed) and the names of the changed fields."""
    a = before.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(1).alias("_a"))
    b = after.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(1).alias("_b"))
    j = a.join(b, key, "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return j.select(key, change.alias("change"), F.when(change == "changed", F.array_join(changed, ",")).otherwise("").alias("fields")).filter("change IS NOT NULL")


def dangling(references: DataFrame, ref: str, known: DataFrame, key: str) -> DataFrame:
    """References that point nowhere."""
    return references.join(known.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")
