"""Alarm and trend streams in order: clusters, chatter, floods, drift, breaches. Batch forms; streaming has its own module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: str) -> Column:
    """Seconds since the epoch, to the microsecond."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def first_up(alarms: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The first row of each group in order."""
    rest = [c for c in alarms.columns if c not in (group, *order)]
    return alarms.groupBy(group).agg(F.min(F.struct(*order, *rest)).alias("_f")).select(group, "_f.*")


def arrival_clusters(alarms: DataFrame, group: str, t: str, gap: float, tie: str) -> DataFrame:
    """alarms with cluster: a new one starts when more than gap passes since the one before (an equal gap stays)."""
    w = Window.partitionBy(group).orderBy(t, tie)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0))
    return alarms.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def chatter(alarms: DataFrame, key: str, t: str, tie: str, n: int = 3) -> DataFrame:
    """One row a key at its n-th activation: when, and the seconds since the first."""
    w = Window.partitionBy(key).orderBy(t, tie)
    a = alarms.select(key, t, F.row_number().over(w).alias("_n"), F.first(t).over(w).alias("_first"))
    return a.filter(F.col("_n") == n).select(key, F.col(t).alias("at"), (F.col(t) - F.col("_first")).alias("span"))


def board_flood(alarms: DataFrame, group: str, key: str, t: str, n: int = 10) -> DataFrame:
    """When a group's board first has n active keys: keys count from their first activation, and never leave."""
    first = alarms.groupBy(group, key).agg(F.min(t).alias("t"))
    w = Window.partitionBy(group).orderBy("t", key)
    return first.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == n).select(group, F.col("t").alias("at"))


def sliding_flood(alarms: DataFrame, group: str, ts: str, window: str = "10 minutes", slide: str = "5 minutes", n: int = 10) -> DataFrame:
    """Windows of a group with at least n activations."""
    g = alarms.groupBy(group, F.window(F.col(ts), window, slide).alias("_w")).agg(F.count("*").alias("n"))
    return g.filter(F.col("n") >= n).select(group, F.unix_seconds(F.col("_w.start").cast("timestamp")).alias("start"), "n")


def active_at(alarms: DataFrame, key: str, t: str, now: Column) -> DataFrame:
    """Keys whose first activation is at or before now."""
    return alarms.groupBy(key).agg(F.min(t).alias("first")).filter(F.col("first") <= now)


def drift_warnings(trends: DataFrame, key: str, t: str, value: str, tie: str, centre: float = 50.0, dead: float = 6.0, limit: float = 30.0) -> DataFrame:
    """The first sample of a key that is at least `dead` off the centre with three samples before it.

    slope: over the last four samples, at least half a second apart; eta: seconds to the limit on that side, where the slope
    leads there. The eta words the message and does not decide whether to warn.
    """
    w = Window.partitionBy(key).orderBy(t, tie)
    s = trends.select(key, F.col(t).alias("at"), F.col(value).alias("v"), F.lag(t, 3).over(w).alias("t0"), F.lag(value, 3).over(w).alias("v0"), F.row_number().over(w).alias("i"))
    s = s.filter((F.col("i") >= 4) & (F.abs(F.col("v") - centre) >= dead))
    s = s.groupBy(key).agg(F.min(F.struct("i", "at", "v", "t0", "v0")).alias("s")).select(key, "s.*")
    slope = (F.col("v") - F.col("v0")) / F.greatest(F.lit(0.5), F.col("at") - F.col("t0"))
    room = F.when(F.col("v") > centre, centre + limit - F.col("v")).otherwise(centre - limit - F.col("v"))
    return s.withColumn("slope", slope).withColumn("eta", F.when((F.col("slope") != 0) & (room * F.col("slope") > 0), room / F.col("slope")))


def first_breach(trends: DataFrame, key: str, order: list[str], crossed: Column) -> DataFrame:
    """Index (from 0, in order) of the first sample that crosses; keys that never do are left out."""
    w = Window.partitionBy(key).orderBy(*order)
    return trends.withColumn("_i", F.row_number().over(w) - 1).filter(crossed).groupBy(key).agg(F.min("_i").cast("long").alias("index"))


def drift_onset(trends: DataFrame, alarms: DataFrame, key: str, t: str, value: str, centre: float = 50.0, calm: float = 3.0) -> DataFrame:
    """key, onset, lead: the last calm sample before the first alarm; lead clamped to 4..15 s, 8 where there is none."""
    first = alarms.groupBy(key).agg(F.min(t).alias("alarm"))
    calm_before = trends.join(first, key).filter((F.col(t) < F.col("alarm")) & (F.abs(F.col(value) - centre) <= calm)).groupBy(key).agg(F.max(t).alias("onset"))
    out = first.join(calm_before, key, "left")
    lead = F.coalesce(F.least(F.lit(15.0), F.greatest(F.lit(4.0), F.col("alarm") - F.col("onset"))), F.lit(8.0))
    return out.select(key, "onset", lead.alias("lead"))


def isolated(onsets: DataFrame, group: str, t: str, far: float = 8.0) -> DataFrame:
    """Rows more than `far` from their group's median, the upper element of an even count."""
    mid = onsets.groupBy(group).agg(F.array_sort(F.collect_list(t)).alias("_s")).select(group, F.element_at("_s", (F.floor(F.size("_s") / 2) + 1).cast("int")).alias("median"))
    return onsets.join(mid, group).filter(F.abs(F.col(t) - F.col("median")) > far)


def fold_steps(lines: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Numbered steps with the lines that follow each folded in: group, step, body."""
    number = F.regexp_extract(text, r"^\s*(\d+)[.)]\s", 1)
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = lines.withColumn("step", F.last(F.when(number != "", number.cast("int")), ignorenulls=True).over(w)).filter("step IS NOT NULL")
    return s.groupBy(group, "step").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.trim(x[text])), " ").alias("body"))


def leader_changes(alarms: DataFrame, group: str, key: str, t: str, tie: str) -> DataFrame:
    """group, t, tie, leader, before, n: each time another key takes the lead in a group's running count of activations.

    The lead is with the key of most activations so far; a key that only draws level does not take it.
    """
    mine, board = Window.partitionBy(group, key).orderBy(t, tie), Window.partitionBy(group).orderBy(t, tie)
    so_far = board.rowsBetween(Window.unboundedPreceding, -1)
    a = alarms.select(group, key, t, tie, F.row_number().over(mine).cast("long").alias("n"))
    # the count that leads grows by one at a time, and the key that makes it grow has it: the last row that made it grow says who leads
    a = a.withColumn("_best", F.coalesce(F.max("n").over(so_far), F.lit(0)))
    a = a.withColumn("_lead", F.when(F.col("n") > F.col("_best"), F.col(key)))
    a = a.withColumn("before", F.last("_lead", ignorenulls=True).over(so_far))
    return a.filter((F.col("n") > F.col("_best")) & (F.col("before") != F.col(key))).select(group, t, tie, F.col(key).alias("leader"), "before", "n")


def watch_events(ticks: DataFrame, group: str, order: str, flood: int = 10) -> DataFrame:
    """Snapshots of a board (group, order, t, n, leader, explains, isolated array, window) -> group, order, event, told in order.

    start: the first snapshot. leader: another candidate leads, with three alarms or more. first_leader: one leads, none did.
    consolidation, once: five alarms or more, of which the leader explains seven tenths of the others. flood, once. unexplained:
    tags that are isolated and were not before, with three alarms or more. complete, once: all of the window, two alarms or more.
    """
    w = Window.partitionBy(group).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(w)
    leader, n = F.col("leader"), F.col("n")
    empty = F.array().cast("array<string>")
    s = ticks.withColumn("_i", place).withColumn("_was", F.lag("leader").over(w))
    consol = (n >= 5) & leader.isNotNull() & (F.col("explains") >= 0.7 * (n - 1)) & (F.col("_i") > 1)
    full, over = (n >= flood) & (F.col("_i") > 1), (F.col("t") >= F.col("window")) & (n >= 2)
    s = s.select("*", consol.alias("_consol"), full.alias("_full"), over.alias("_over"))
    # what is isolated at the start is not yet known to be
    s = s.withColumn("_iso", F.when(F.col("_i") > 1, F.col("isolated")).otherwise(empty))
    s = s.withColumn("_seen", F.coalesce(F.array_distinct(F.flatten(F.collect_list("_iso").over(past))), empty))
    once = lambda c: F.col(c) & ~F.coalesce(F.max(F.col(c).cast("int")).over(past) == 1, F.lit(False))
    events = {
        "start": F.col("_i") == 1,
        "leader": (F.col("_i") > 1) & leader.isNotNull() & F.col("_was").isNotNull() & (leader != F.col("_was")) & (n >= 3),
        "first_leader": (F.col("_i") > 1) & leader.isNotNull() & F.col("_was").isNull(),
        "consolidation": once("_consol"),
        "flood": once("_full"),
        "unexplained": (F.col("_i") > 1) & (n >= 3) & (F.size(F.array_except("isolated", "_seen")) > 0),
        "complete": once("_over"),
    }
    told = s.select(group, order, F.array(*[F.when(c, F.lit(k)) for k, c in events.items()]).alias("_e"))
    return told.select(group, order, F.explode(F.filter("_e", lambda x: x.isNotNull())).alias("event"))


def structure_time_verdict(leaders: DataFrame, onsets: DataFrame, group: str) -> DataFrame:
    """Leaders (group, leader) and onsets (group, tag, onset) -> group, leader, first_mover, agrees: whether what explains most
    also moved first (of several the least tag)."""
    first = onsets.groupBy(group).agg(F.min(F.struct("onset", "tag")).alias("_f")).select(group, F.col("_f.tag").alias("first_mover"))
    return leaders.join(first, group).select(group, "leader", "first_mover", (F.col("leader") == F.col("first_mover")).alias("agrees"))
