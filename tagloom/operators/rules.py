"""Rule screening over typed tags, their loops or sections, and a graph: one row a finding.

Objects: tag, system, type_code, number, suffix, loop. Each rule keeps its own type sets, which differ on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The type sets of the rules.
PRESSURE = "PT PI PIC PIT PDI PDT PV PSH PSL".split()
PRESSURE_MEASURED = "PT PI PIT PDI PDT PIC".split()
RELIEF = ["PSV", "PSE"]
TRIPS = "LSHH PSHH LSH PSH LSL FSH LSLL PSLL".split()
ACTIONS = ["XV", "ESV", "XY"]
ON_OFF = ["XV", "ESV"]
POSITION = "ZS ZL ZSH ZSL ZI ZT".split()
FINAL = "XV ESV ZV FV LV PV TV HV FO".split()
LOCAL_ONLY = "PI FI TI LI PDI".split()
ACTUATED = "XV ESV XY PV LV FV HV TV".split()
SHUTDOWN_FUNCTIONS = "LSHH PSHH LSH LSL PSH FSH".split()
CONTROLLER = "^[A-Z]{1,3}IC$"
LEGS = ["A", "B", "C", "D"]


#: Sections of the findings that are made once for all; tags that such a finding shows.
COVERAGE, LOOPS, REDUNDANCY, SPELLING, SHOWN = "P&ID↔SCD", "sløyfe", "redundans", "merking", 8


def findings(df: DataFrame, rule: str, severity: str, section: Column, tags: Column) -> DataFrame:
    """The common shape: rule, severity, section, tags (sorted; kept whole), n (how many)."""
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), section.cast("string").alias("section"), F.array_sort(tags).alias("tags"), F.size(tags).cast("long").alias("n"))


def one_finding(tags: DataFrame, rule: str, severity: str, section: str) -> DataFrame:
    """One finding on all of tags (column tag, distinct), none if there are none: the first SHOWN tags, and n, how many there are."""
    first = tags.select("tag").orderBy("tag").limit(SHOWN).agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    both = first.join(F.broadcast(tags.agg(F.count("*").alias("n"))), how="cross").filter("n > 0")  # one row each
    return both.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(section).alias("section"), "tags", "n")


def _tags(types: list[str]) -> Column:
    return F.collect_set(F.when(F.col("type_code").isin(types), F.col("tag")))


def screen_sections(objects: DataFrame, section: str = "loop") -> DataFrame:
    """R1 pressure without relief; R3 four members or more with neither; R13 relief without pressure measurement."""
    g = objects.groupBy(section).agg(_tags(PRESSURE).alias("p"), _tags(RELIEF).alias("r"), _tags(PRESSURE_MEASURED).alias("m"), F.collect_set("tag").alias("all"), F.count("*").alias("n"))
    s = F.col(section)
    r1 = findings(g.filter((F.size("p") > 0) & (F.size("r") == 0)), "R1", "high", s, F.col("p"))
    r3 = findings(g.filter((F.col("n") >= 4) & (F.size("p") == 0) & (F.size("r") == 0)), "R3", "low", s, F.col("all"))
    r13 = findings(g.filter((F.size("r") > 0) & (F.size("m") == 0)), "R13", "medium", s, F.col("r"))
    return r1.unionByName(r3).unionByName(r13)


def screen_paths(objects: DataFrame, reach: DataFrame, vertices: DataFrame) -> DataFrame:
    """R2: trips of the graph (vertices: node) from which no action valve can be reached. reach: seed, node (tags)."""
    acts = objects.filter(F.col("type_code").isin(ACTIONS)).select(F.col("tag").alias("node"))
    good = reach.join(acts, "node", "left_semi").select(F.col("seed").alias("tag")).distinct()
    trips = objects.filter(F.col("type_code").isin(TRIPS)).join(good, "tag", "left_anti").join(vertices.select(F.col("node").alias("tag")), "tag", "left_semi")
    return findings(trips, "R2", "high", F.lit(""), F.array("tag"))


def screen_loops(objects: DataFrame) -> DataFrame:
    """R8 on/off valve without position feedback in its loop; R9 trip that is alone of its type in its loop."""
    fed = objects.groupBy("loop").agg(F.max(F.col("type_code").isin(POSITION).cast("int")).alias("fed"))
    r8 = objects.filter(F.col("type_code").isin(ON_OFF)).join(fed.filter("fed = 0"), "loop")
    alone = objects.filter(F.col("type_code").isin(TRIPS)).groupBy("loop", "type_code").agg(F.count("*").alias("n"), F.min("tag").alias("tag")).filter("n < 2")
    return findings(r8, "R8", "medium", F.col("loop"), F.array("tag")).unionByName(findings(alone, "R9", "low", F.col("loop"), F.array("tag")))


def screen_controllers(objects: DataFrame, reach: DataFrame) -> DataFrame:
    """R14, one finding: controllers with no final element in the loop or downstream of any of its controllers."""
    c = objects.filter(F.col("type_code").rlike(CONTROLLER)).groupBy("loop").agg(F.collect_set("tag").alias("tags"))
    final = objects.filter(F.col("type_code").isin(FINAL))
    c = c.join(final.select("loop").distinct(), "loop", "left_anti")
    down = reach.join(final.select(F.col("tag").alias("node")), "node", "left_semi").select(F.col("seed").alias("tag")).distinct()
    served = c.select("loop", F.explode("tags").alias("tag")).join(down, "tag", "left_semi").select("loop").distinct()
    return one_finding(c.join(served, "loop", "left_anti").select(F.explode("tags").alias("tag")).distinct(), "R14", "medium", LOOPS)


def screen_tags(objects: DataFrame) -> DataFrame:
    """R15, one finding: stems with one leg only; R16, one finding: tags spelt differently for one identity. Typed tags with a
    number count; a number of zeros is 0."""
    typed = objects.filter("type_code <> '' AND number <> ''")
    stems = typed.groupBy("system", "type_code", "number").agg(F.collect_set("suffix").alias("s"))
    lonely = stems.filter((F.size("s") == 1) & F.get("s", F.lit(0)).isin(LEGS))
    lonely = lonely.select(F.concat("system", F.lit("-"), "type_code", "number", F.get("s", F.lit(0))).alias("tag"))
    bare = F.ltrim(F.col("number"), F.lit("0"))
    same = typed.groupBy("system", "type_code", F.when(bare == "", "0").otherwise(bare).alias("bare"), "suffix").agg(F.collect_set("tag").alias("tags")).filter(F.size("tags") > 1)
    return one_finding(lonely, "R15", "low", REDUNDANCY).unionByName(one_finding(same.select(F.explode("tags").alias("tag")).distinct(), "R16", "medium", SPELLING))


def screen_coverage(pid: DataFrame, scd: DataFrame, category: Column) -> DataFrame:
    """R4-R7, one finding each: what the P&ID shows and the SCD lacks, by kind of function."""
    missing = pid.join(scd.select("tag").distinct(), "tag", "left_anti").withColumn("_c", category)
    code = F.col("type_code")
    kinds = [("R4", (F.col("_c") == "input") & ~code.isin(LOCAL_ONLY)), ("R5", code.isin(ACTUATED)), ("R6", code.isin(SHUTDOWN_FUNCTIONS)), ("R7", code.rlike(CONTROLLER))]
    out = None
    for rule, keep in kinds:
        f = one_finding(missing.filter(keep).select("tag").distinct(), rule, "medium", COVERAGE)
        out = f if out is None else out.unionByName(f)
    return out


def screen_cause_effect(objects: DataFrame, ce: DataFrame) -> DataFrame:
    """R10 shutdown valves no cause acts on; R11 trips without an effect; R12 tags the register lacks. ce: cause_tag, effect_tag.

    Without any cause-and-effect rows there is no finding.
    """
    some = ce.limit(1).select(F.lit(1).alias("_some"))
    valves = objects.filter(F.col("type_code").isin(ON_OFF)).join(ce.select(F.col("effect_tag").alias("tag")), "tag", "left_anti").crossJoin(F.broadcast(some))
    trips = objects.filter(F.col("type_code").isin(TRIPS)).join(ce.select(F.col("cause_tag").alias("tag")), "tag", "left_anti").crossJoin(F.broadcast(some))
    named = ce.select(F.col("cause_tag").alias("tag")).unionByName(ce.select(F.col("effect_tag").alias("tag"))).distinct().join(objects.select("tag"), "tag", "left_anti")
    out = findings(valves, "R10", "high", F.lit("c&e"), F.array("tag")).unionByName(findings(trips, "R11", "high", F.lit("c&e"), F.array("tag")))
    return out.unionByName(findings(named, "R12", "medium", F.lit("c&e"), F.array("tag")))


def dedupe(found: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One of the findings that agree in rule, section and tags: the first by `order`, then by their other columns."""
    key = ["rule", "section", "tags"]
    rest = [*(order or []), *[c for c in found.columns if c not in key and c not in (order or [])]]
    return found.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_f")).select(*[c if c in key else F.col(f"_f.{c}").alias(c) for c in found.columns])


def system_of(tags: Column) -> Column:
    """The first two digits of the first tag that begins with two; ? where none does."""
    found = F.get(F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"^(\d{2})", 1)), lambda x: x != ""), F.lit(0))
    return F.coalesce(found, F.lit("?"))


def roll_up(sheets: DataFrame, plant: DataFrame, wide: tuple[str, ...] = ("R15", "R16"), everywhere: str = "(anleggsdekkende)") -> DataFrame:
    """Findings of the sheets (with drawing) without the rules that need all sheets, and those of the whole plant for these rules;
    with system."""
    each = sheets.filter(~F.col("rule").isin(*wide)).groupBy("drawing", "rule", "section", "tags").agg(F.min(F.struct(*[c for c in sheets.columns if c not in ("drawing", "rule", "section", "tags")])).alias("_f"))
    each = each.select("drawing", "rule", "section", "tags", "_f.*")
    whole = plant.filter(F.col("rule").isin(*wide)).withColumn("drawing", F.lit(everywhere))
    return each.unionByName(whole.select(each.columns)).withColumn("system", system_of(F.col("tags")))


def fluids_for_tags(anchors: DataFrame, findings_: DataFrame, key: str) -> DataFrame:
    """key, fluids: codes of the lines (anchors: line, tag) that a finding's tags anchor, sorted; a code is the line's second part."""
    code = F.regexp_extract("line", r"^[^-]*-([A-Z]{2})-", 1)
    coded = anchors.select("tag", code.alias("fluid")).filter("fluid <> ''").distinct()
    each = findings_.select(key, F.explode("tags").alias("tag")).join(coded, "tag")
    return each.groupBy(key).agg(F.array_sort(F.collect_set("fluid")).alias("fluids"))


# Kinds of action by rule, in the order of their texts, and the kinds' names and ranks.
FIXES = {
    "extraction": "R1 R2 R3 R4 R5 R6 R7 R8 R9 R12 R13 R14 R15".split(),
    "design": [f"R{i}" for i in range(1, 17)],
    "deliverable": "R4 R5 R10 R11 R15 R16".split(),
}
FIX_LABELS = {"extraction": "Verify the extraction", "design": "Design / drawing action", "deliverable": "Deliverable requirement"}


def propose_fixes(found: DataFrame, structured: bool = True, most: int = 6) -> DataFrame:
    """rule, section, kind, label, place, tags: what to do about each finding, in order. An action is anchored in the finding's
    own tags, never in one that is made up. Where the source is structured, verifying comes behind a design action's rank."""
    rank = {"extraction": 1.0 if structured else 0.5, "design": 1.5, "deliverable": 2.5}
    kinds = F.array(*[F.struct(F.lit(rank[k]).alias("place"), F.lit(k).alias("kind"), F.lit(FIX_LABELS[k]).alias("label"), F.array(*[F.lit(r) for r in rules]).alias("rules")) for k, rules in FIXES.items()])
    some = F.filter(kinds, lambda x: F.array_contains(x["rules"], F.col("rule")))
    return found.select("rule", "section", F.slice("tags", 1, most).alias("tags"), F.explode(some).alias("_x")).select("rule", "section", "_x.kind", "_x.label", "_x.place", "tags")


def in_order(found: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return found.orderBy(rank, "rule", "section", F.array_join("tags", ","))
