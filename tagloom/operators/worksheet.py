"""Hazard worksheets: nodes by loop, parameters by deviations, causes, consequences and safeguards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import tags as T

# Deviations, safeguards and failure modes.
DEVIATIONS = {
    "Pressure": ["High pressure", "Low pressure"],
    "Level": ["High level", "Low level"],
    "Flow": ["No flow", "Low flow", "High flow", "Reverse flow"],
    "Temperature": ["High temperature", "Low temperature"],
}
SAFEGUARDS = {
    "High pressure": ["PSV", "PSH", "XV"],
    "Low pressure": ["XV"],
    "High level": ["LSH", "LSHH", "XV"],
    "Low level": ["LSL", "XV"],
    "No flow": ["FSH", "XV"],
    "Low flow": ["FSH", "XV"],
    "High flow": ["FSH", "XV"],
    "Reverse flow": ["XV"],
    "High temperature": ["XV"],
    "Low temperature": ["XV"],
}
FAILURE_MODES = {
    "FV": ["sticks", "wrong position"],
    "PV": ["sticks", "wrong position"],
    "PIC": ["wrong output", "tuning drift"],
    "LIC": ["wrong output", "tuning drift"],
    "FIC": ["wrong output", "tuning drift"],
}
ALL_MODES = {
    "PT": ["signal drift", "stuck reading", "signal loss", "impulse line blocked"], "PI": ["drift", "stuck reading"], "PDT": ["drift", "impulse line blocked", "signal loss"],
    "PDI": ["drift", "stuck reading"], "TT": ["drift", "signal loss", "sensor detached"], "TI": ["drift", "signal loss"], "LT": ["drift", "stuck", "false level", "signal loss"],
    "LSH": ["false trip", "fails to trip", "stuck"], "LSL": ["false trip", "fails to trip", "stuck"], "FT": ["drift", "blocked element", "signal loss"],
    "FE": ["blocked / fouled element", "erosion"], "XV": ["fails to close", "fails to open", "seat leak", "slow stroke"], "FV": ["sticks", "wrong position", "actuator fault"],
    "PV": ["sticks", "wrong position", "actuator fault"], "PSV": ["premature lift", "fails to lift", "seat leak"], "HS": ["wrong position", "no command"],
    "PIC": ["wrong output", "tuning drift", "mode stuck"], "LIC": ["wrong output", "tuning drift", "mode stuck"], "FIC": ["wrong output", "tuning drift", "mode stuck"],
    "ZS": ["false position feedback", "no feedback"], "ZL": ["false position feedback", "no feedback"], "KA": ["trip", "reduced performance", "seal failure", "surge"],
    "PA": ["trip", "reduced performance", "seal failure", "cavitation"],
}
UNKNOWN_MODE = ["malfunction / signal fault"]
GENERIC_CAUSES = {
    "High pressure": ["blocked outlet (generic)", "upstream pressure source (generic)"], "Low pressure": ["upstream supply loss (generic)", "leak / rupture (generic)"],
    "High level": ["outlet restriction (generic)", "inflow exceeds outflow (generic)"], "Low level": ["loss of feed (generic)", "excess drainage (generic)"],
    "No flow": ["blocked line / closed valve (generic)", "pump/compressor stop (generic)"], "Low flow": ["partial blockage / fouling (generic)"],
    "High flow": ["control valve fully open (generic)"], "Reverse flow": ["check-valve failure / pressure reversal (generic)"], "High temperature": ["loss of cooling (generic)"],
    "Low temperature": ["JT-cooling on depressurisation (generic)", "loss of heating (generic)"],
}
GENERIC_CONSEQUENCES = {
    "High pressure": "possible overpressure of section (generic)", "Low pressure": "loss of process function / possible gas breakthrough (generic)",
    "High level": "possible carry-over / overfill (generic)", "Low level": "possible gas blow-by to downstream (generic)", "No flow": "loss of process function (generic)",
    "Low flow": "reduced capacity (generic)", "High flow": "possible downstream overload (generic)", "Reverse flow": "possible contamination / backflow to upstream (generic)",
    "High temperature": "possible material/design-limit exceedance (generic)", "Low temperature": "possible hydrate formation / brittle fracture risk (generic)",
}
SAME_LOOP, NONE_FOUND = " (⚠ same loop — verify independence)", "(none found in extraction — verify)"


def _map(table: dict[str, list[str]]):
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])


def nodes(objects: DataFrame, node: str = "loop") -> DataFrame:
    """Objects of nodes with at least two members."""
    many = objects.groupBy(node).agg(F.count("*").alias("_n")).filter("_n >= 2").select(node)
    return objects.join(many, node)


def build(objects: DataFrame, node: str = "loop") -> DataFrame:
    """node, parameter, deviation, causes, consequences, safeguards: one row for each deviation of each measured parameter.

    A node that measures nothing gets Flow if any member is typed. Causes are failures of control elements, never of safety
    functions; consequences are the logic and output functions that the node drives.
    """
    o = nodes(objects, node).withColumn("category", T.categorise(F.col("type_code"))).withColumn("parameter", T.parameter_of(F.col("type_code")))
    modes = F.element_at(_map(FAILURE_MODES), F.when(F.col("type_code").isin(list(FAILURE_MODES)), F.col("type_code")))
    control = F.col("category").isin("logic", "output") & ~F.col("type_code").isin(T.SAFETY_TYPES)
    cause = F.when(control & modes.isNotNull(), F.transform(modes, lambda m: F.concat("tag", F.lit(": "), m)))
    g = o.groupBy(node).agg(
        F.array_sort(F.collect_set("parameter")).alias("parameters"),
        F.max((F.col("type_code") != "").cast("int")).alias("typed"),
        F.array_sort(F.flatten(F.collect_list(F.coalesce(cause, F.array().cast("array<string>"))))).alias("causes"),
        F.array_sort(F.collect_set(F.when(F.col("category").isin("logic", "output"), F.col("tag")))).alias("consequences"),
        F.collect_set(F.struct("type_code", "tag")).alias("members"),
    )
    default = F.when(F.col("typed") == 1, F.array(F.lit("Flow"))).otherwise(F.array().cast("array<string>"))
    g = g.withColumn("parameter", F.explode(F.when(F.size("parameters") > 0, F.col("parameters")).otherwise(default)))
    g = g.withColumn("deviation", F.explode(F.element_at(_map(DEVIATIONS), F.col("parameter"))))
    wanted = F.element_at(_map(SAFEGUARDS), F.col("deviation"))
    guards = F.array_sort(F.transform(F.filter("members", lambda m: F.array_contains(wanted, m["type_code"])), lambda m: m["tag"]))
    return g.select(node, "parameter", "deviation", F.array_join("causes", "; ").alias("causes"), F.array_join("consequences", ", ").alias("consequences"), F.array_join(guards, ", ").alias("safeguards"))


def guarded_share(rows: DataFrame) -> DataFrame:
    """Rows, rows with a safeguard and their share (percent, one decimal)."""
    return rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("safeguards") != "", 1)).alias("guarded")).withColumn("pct", F.when(F.col("n") > 0, F.round(100.0 * F.col("guarded") / F.col("n"), 1)))


def failure_modes(type_code):
    """The ways in which a type fails; one general way for types without a list."""
    return F.coalesce(F.element_at(_map(ALL_MODES), type_code), F.array(*[F.lit(m) for m in UNKNOWN_MODE]))


def _mentions(designed: DataFrame):
    marks = F.filter(
        F.array(
            F.when(F.col("in_loop"), "⚠ detection in node — verify independence"), F.when(F.col("inside"), "⚠ acts inside node"), F.when(~F.col("is_verified"), "UNVERIFIED"),
        ),
        lambda x: x.isNotNull(),
    )
    action = F.replace(F.when(F.coalesce("function", F.lit("")) == "", "action").otherwise(F.col("function")), F.lit(","), F.lit(";"))
    source = F.when(F.coalesce("source", F.lit("")) == "", "").otherwise(F.concat(F.lit(" ["), F.col("source"), F.lit("]")))
    tail = F.when(F.size(marks) > 0, F.concat(F.lit(" ["), F.array_join(marks, "; "), F.lit("]"))).otherwise("")
    return F.concat("cause", F.lit(" → "), "effect", F.lit(": "), action, source, tail)


def worksheet(members: DataFrame, reach: DataFrame, designed: DataFrame | None = None) -> DataFrame:
    """The whole worksheet: node, node_members, parameter, deviation, causes, consequences, safeguards; the team fills in the rest.

    members: node, tag, type_code, category, loop (a loop or a section; nodes of one tag count too, if given). reach: seed, node of
    the tag graph. designed: validated cause-and-effect rows (cause, effect, ok, function, is_verified, source). Causes: at most
    two failures of each control element, then general ones. Consequences: the functions a node drives and what it reaches
    outside, and the safety functions in it. Safeguards: first what the logic states for a member that guards the deviation, then
    safety types in the node or downstream that no such statement names, marked where they share a loop with the node.
    """
    m = members.withColumn("parameter", T.parameter_of(F.col("type_code")))
    spark = m.sparkSession
    deviations = spark.createDataFrame([(p, d) for p, ds in DEVIATIONS.items() for d in ds], "parameter string, deviation string")
    wanted = spark.createDataFrame([(d, t) for d, ts in SAFEGUARDS.items() for t in ts], "deviation string, type_code string")
    measured = m.filter("parameter IS NOT NULL").select("node", "parameter").distinct()
    typed = m.filter("type_code <> ''").select("node").distinct().join(measured, "node", "left_anti").withColumn("parameter", F.lit("Flow"))
    rows = measured.unionByName(typed).join(F.broadcast(deviations), "parameter")
    control = F.col("category").isin("logic", "output") & ~F.col("type_code").isin(T.SAFETY_TYPES) & F.col("type_code").isin(list(ALL_MODES))
    fails = m.filter(control).select("node", "tag", F.posexplode(F.slice(F.element_at(_map(ALL_MODES), F.col("type_code")), 1, 2)).alias("_i", "_m"))
    fails = fails.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("tag", "_i", "_m"))), lambda x: F.concat(x["tag"], F.lit(": "), x["_m"])).alias("fails"))
    own = m.select("node", "tag").distinct()
    out = m.select("node", F.col("tag").alias("seed")).join(reach.select("seed", F.col("node").alias("tag")), "seed").select("node", "tag").distinct().join(own, ["node", "tag"], "left_anti")
    driven = m.filter(F.col("category").isin("logic", "output")).select("node", "tag").unionByName(out).distinct()
    listed = lambda df, name: df.groupBy("node").agg(F.array_sort(F.collect_set("tag")).alias(name))
    safe = m.filter(F.col("type_code").isin(T.SAFETY_TYPES)).select("node", "tag")
    every = m.select("tag", "type_code", "loop").dropDuplicates(["tag"])
    pool = own.unionByName(driven).distinct().join(every, "tag").join(F.broadcast(wanted), "type_code").select("node", "deviation", "tag", "loop")
    loops = m.select("node", "loop", F.lit(True).alias("_same")).distinct()
    pool = pool.join(loops, ["node", "loop"], "left")
    if designed is not None:
        guards = m.select("node", F.col("tag").alias("cause"), F.explode(T.guarded_deviations(F.col("type_code"))).alias("deviation"))
        d = guards.join(designed.filter("ok").select("cause", "effect", "function", "is_verified", "source"), "cause")
        inside = own.select("node", F.col("tag").alias("effect"), F.lit(True).alias("_in"))
        d = d.join(inside, ["node", "effect"], "left").withColumn("inside", F.coalesce("_in", F.lit(False))).withColumn("in_loop", F.lit(True))
        covered = d.select("node", "deviation", F.explode(F.array("cause", "effect")).alias("tag")).distinct()
        pool = pool.join(covered, ["node", "deviation", "tag"], "left_anti")
        lines = d.groupBy("node", "deviation").agg(F.array_sort(F.collect_set(_mentions(d))).alias("lines"))
    else:
        lines = rows.select("node", "deviation").limit(0).withColumn("lines", F.array().cast("array<string>"))
    shown = F.concat("tag", F.when(F.col("_same"), SAME_LOOP).otherwise(""))
    guards = pool.groupBy("node", "deviation").agg(F.transform(F.array_sort(F.collect_set(F.struct("tag", shown.alias("s")))), lambda x: x["s"]).alias("guards"))
    r = rows.join(fails, "node", "left").join(listed(driven, "driven"), "node", "left").join(listed(safe, "safe"), "node", "left").join(listed(own, "all"), "node")
    r = r.join(lines, ["node", "deviation"], "left").join(guards, ["node", "deviation"], "left")
    empty = F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.col(c), empty)
    general = F.element_at(F.create_map(*[F.lit(x) for kv in GENERIC_CONSEQUENCES.items() for x in kv]), F.col("deviation"))
    told = lambda text, c: F.when(F.size(some(c)) > 0, F.concat(F.lit(f"; {text}: "), F.array_join(some(c), ", "))).otherwise("")
    found = F.concat(some("lines"), some("guards"))
    return r.select(
        "node", F.array_join("all", ", ").alias("node_members"), "parameter", "deviation",
        F.array_join(F.concat(some("fails"), F.element_at(_map(GENERIC_CAUSES), F.col("deviation"))), "; ").alias("causes"),
        F.concat(general, told("functions affected", "driven"), told("safety functions in node", "safe")).alias("consequences"),
        F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(NONE_FOUND).alias("safeguards"),
    )
