"""The alarm picture: ranked candidates with their evidence, barriers, checks and debriefs. Nothing here names a winner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import tags as T
from tagloom.operators import events, graph

EMPTY = "array<string>"


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(EMPTY))


def cross_checks(edges: DataFrame, objects: DataFrame, candidates: DataFrame, most: int = 6) -> DataFrame:
    """tag, loop_mates, upstream_sensors, downstream_next of candidates (tag): measuring functions of the same loop, those right
    before it, and the first `most` tags right behind it. objects: tag, loop, category."""
    c, o = candidates.select("tag").distinct(), objects.select("tag", "loop", "category")
    mine = c.join(o.select("tag", "loop"), "tag")
    mates = mine.join(o.select(F.col("tag").alias("_m"), "loop", "category"), "loop").filter("category = 'input' AND _m <> tag").groupBy("tag").agg(F.array_sort(F.collect_set("_m")).alias("loop_mates"))
    up = edges.select(F.col("dst").alias("tag"), F.col("src").alias("_m")).join(c, "tag", "left_semi").join(o.filter("category = 'input'").select(F.col("tag").alias("_m")), "_m", "left_semi")
    up = up.groupBy("tag").agg(F.array_sort(F.collect_set("_m")).alias("upstream_sensors"))
    down = edges.select(F.col("src").alias("tag"), F.col("dst").alias("_m")).distinct().join(c, "tag", "left_semi")
    place = F.row_number().over(Window.partitionBy("tag").orderBy("_m"))
    down = down.withColumn("_p", place).filter(F.col("_p") <= most).groupBy("tag").agg(F.array_sort(F.collect_list("_m")).alias("downstream_next"))
    out = c.join(mates, "tag", "left").join(up, "tag", "left").join(down, "tag", "left")
    return out.select("tag", *[_or_empty(x).alias(x) for x in ("loop_mates", "upstream_sensors", "downstream_next")])


def barriers(edges: DataFrame, objects: DataFrame, candidates: DataFrame) -> DataFrame:
    """tag, barriers: safety-typed tags of a candidate's loop or downstream of it, sorted. objects: tag, loop, type_code."""
    c = candidates.select("tag").distinct()
    safe = objects.filter(F.col("type_code").isin(T.SAFETY_TYPES)).select(F.col("tag").alias("node"), "loop")
    loop = c.join(objects.select("tag", "loop"), "tag").join(safe, "loop").select("tag", "node")
    reach = graph.closure(edges, c.select(F.col("tag").alias("seed"))).filter("seed <> node").select(F.col("seed").alias("tag"), "node")
    found = loop.unionByName(reach.join(safe.select("node"), "node", "left_semi").select("tag", "node")).groupBy("tag").agg(F.array_sort(F.collect_set("node")).alias("barriers"))
    return c.join(found, "tag", "left").select("tag", _or_empty("barriers").alias("barriers"))


def briefs(edges: DataFrame, active: DataFrame, objects: DataFrame, gap: float = 5.0) -> DataFrame:
    """`graph.candidate_brief` with the priority and direction of a candidate's type, its arrival cluster, whether it rang first
    there, and place: by most explained, first rung, priority and tag. active: node, t; objects: tag, type_code."""
    found = graph.candidate_brief(edges, active)
    sem = T.alarm_semantics(F.col("type_code"))
    clusters = events.arrival_clusters(active.groupBy("node").agg(F.min("t").alias("t")).withColumn("_g", F.lit(1)), "_g", "t", gap, "node")  # one board: its alarms, not a plant's
    first = clusters.groupBy("cluster").agg(F.min(F.struct("t", "node")).alias("_f")).select("cluster", F.col("_f.node").alias("_first"))
    j = found.join(objects.select(F.col("tag").alias("node"), "type_code"), "node", "left").join(clusters.select("node", "cluster"), "node", "left").join(first, "cluster", "left")
    out = j.select("node", "explains", "members", "t", "detached", sem["priority"].alias("priority"), sem["direction"].alias("direction"), "cluster", (F.col("node") == F.col("_first")).alias("first_in_cluster"))
    order = Window.orderBy(F.desc("explains"), F.asc_nulls_last("t"), "priority", "node")  # candidates of one board
    return out.withColumn("place", F.row_number().over(order))


def situation(briefed: DataFrame, active: DataFrame) -> DataFrame:
    """One row: n_alarms, n_candidates, and whether a candidate explains nothing."""
    n = active.agg(F.countDistinct("node").alias("n_alarms"))
    return briefed.agg(F.count("*").alias("n_candidates"), F.coalesce(F.max(F.col("explains") == 0), F.lit(False)).alias("any_none")).join(n, how="cross")


def pressure_protection(edges: DataFrame, objects: DataFrame, tag: str) -> DataFrame:
    """node, type_code: relief and high-pressure switches in a tag's loop, upstream or downstream of it."""
    seed = objects.sparkSession.createDataFrame([(tag,)], "seed string")
    near = graph.closure(edges, seed).select("node").unionByName(graph.ancestors(edges, seed).select("node"))
    loop = objects.filter(F.col("tag") == tag).select("loop").distinct()
    near = near.unionByName(objects.join(loop, "loop", "left_semi").select(F.col("tag").alias("node"))).distinct()
    kinds = F.col("type_code").isin("PSV", "PSE", "PSH", "PSHH")
    return objects.filter(kinds & (F.col("tag") != tag)).select(F.col("tag").alias("node"), "type_code").join(near, "node", "left_semi")


def cascade(edges: DataFrame, faults: DataFrame, objects: DataFrame, step: float = 2.5, seed: int = 0) -> DataFrame:
    """fault, tag, t: the alarms a fault (column tag) would make: alarm-capable tags downstream of it, ring by ring and by tag
    about `step` seconds apart, the first at 0. Jitter is a hash of seed, fault and tag, so a replay is the same anywhere."""
    reach = graph.closure(edges, faults.select(F.col("tag").alias("seed"))).filter("seed <> node")
    every = faults.select(F.col("tag").alias("fault"), "tag", F.lit(0).alias("depth")).unionByName(reach.select(F.col("seed").alias("fault"), F.col("node").alias("tag"), "depth"))
    rings = objects.filter(T.alarm_capable(F.col("type_code"), F.col("category"))).select("tag")
    every = every.join(rings, "tag", "left_semi")
    place = F.row_number().over(Window.partitionBy("fault").orderBy("depth", "tag")) - 1
    jitter = (F.pmod(F.xxhash64(F.lit(seed), "fault", "tag"), F.lit(4001)) / 4000.0 - 0.5) * 0.4 * step
    raw = every.withColumn("_t", F.greatest(F.lit(0.0), place * step + jitter))
    first = F.min("_t").over(Window.partitionBy("fault"))
    return raw.select("fault", "tag", F.round(F.col("_t") - first, 2).alias("t"))


def root_ranks(briefed: DataFrame, roots: DataFrame) -> DataFrame:
    """Ranked candidates (scenario, node, place) and true roots (scenario, node) -> one row: scenarios, found, hit1, hit3 and
    mean_rank. A root that was never listed stays in the denominator."""
    r = roots.join(briefed.select("scenario", "node", "place"), ["scenario", "node"], "left")
    return r.agg(
        F.count("*").alias("scenarios"), F.count("place").alias("found"), F.count(F.when(F.col("place") == 1, 1)).alias("hit1"),
        F.count(F.when(F.col("place") <= 3, 1)).alias("hit3"), F.avg("place").alias("mean_rank"),
    )


def debrief(chosen: DataFrame, noise: DataFrame, board: DataFrame, first_up: DataFrame) -> DataFrame:
    """Scenarios (scenario, fault, tag chosen) -> verdict: source, nearest_symptom (the source is silent and the first alarm was
    chosen), noise, symptom or none. noise and board: scenario, tag; first_up: scenario, tag."""
    j = chosen
    for df, name, key in ((noise, "_noise", "tag"), (board, "_rang", "fault"), (first_up, "_up", "tag")):
        side = df.select("scenario", F.col("tag").alias(key), F.lit(True).alias(name)).distinct()
        j = j.join(side, ["scenario", key], "left")
    silent = F.col("_rang").isNull()
    verdict = F.when(F.col("tag").isNull(), "none").when(F.col("tag") == F.col("fault"), "source").when(silent & F.col("_up"), "nearest_symptom").when(F.col("_noise"), "noise").otherwise("symptom")
    return j.select("scenario", "fault", "tag", verdict.alias("verdict"))
