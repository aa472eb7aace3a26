"""Column functions over tags: grammar, typing, keys, alarm semantics, filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type codes by category, safety types, alarm groups.
CATEGORIES = {
    "input": "PT TT LT FT PI TI LI FI PDI PDT PDIT AE SI ZS ZL LSH LSL LSHH PSH FSH PSE".split(),
    "logic": "PIC LIC TIC FIC PY LY TY FY HS XY".split(),
    "output": "XV ZV FV LV PV FO PSV".split(),
    "equipment": "KA PA VG VD".split(),
}
CATEGORY_RANK = {"input": 0, "logic": 1, "output": 2, "equipment": 3, "other": 4}
SAFETY_TYPES = "XV PSV LSH LSHH PSH FSH HS ZS ZL".split()
SHUTDOWN_TYPES = "XV ESV PSV PSE".split()
INDICATOR_TYPES = "PI TI LI FI PDI ZL XA XI XS US".split()
LABEL_WORDS = "NOTE SHEET REV PAGE DWG DOC".split()
PARAMETERS = {"P": "Pressure", "L": "Level", "F": "Flow", "T": "Temperature"}
NO_PARAMETER = "HS XV ZS ZL KA PA VG VD FO PSE".split()

TYPE_FIRST = r"^(\d{2})-([A-Z]{2,4})(\d{3,4})([A-Z]?)$"
NUMBER_FIRST = r"^(\d{2})-(\d{3,4})([A-Z]{2,3})$"
INLINE = r"\b(\d{2}-[A-Z]{2,4}\d{2,4}[A-Z]?)\b"
INLINE_NUMBER_FIRST = r"\b(\d{2}-\d{3,4}[A-Z]{2,3})\b"
COMBINED = r"(\d{2}-[A-Z]{2,4}\d{2,4})([A-Z](?:/[A-Z])+)"


def lookup(key: Column, table: dict[str, list[str]], default: str) -> Column:
    """The first name whose list has the key."""
    out = None
    for name, keys in table.items():
        out = F.when(key.isin(keys), name) if out is None else out.when(key.isin(keys), name)
    return out.otherwise(default)


def categorise(type_code: Column) -> Column:
    return lookup(type_code, CATEGORIES, "other")


def clean(tag: Column) -> Column:
    return F.upper(F.trim(tag))


def parse_tag(tag: Column, number_first: bool = False) -> Column:
    """struct(tag, system, type_code, number, suffix, category, loop); empty parts where the grammar does not fit.

    number_first also types tags whose number stands before the type, as the structured source has them.
    """
    t = clean(tag)
    fits = t.rlike(TYPE_FIRST)
    part = [F.regexp_extract(t, TYPE_FIRST, i) for i in (1, 2, 3, 4)]
    if number_first:
        other = [F.regexp_extract(t, NUMBER_FIRST, i) for i in (1, 3, 2)] + [F.lit("")]
        part = [F.when(fits, a).otherwise(b) for a, b in zip(part, other)]
    category = F.when(part[1] == "", "other").otherwise(categorise(part[1]))
    loop = F.when(part[2] != "", F.concat_ws("-", part[0], part[2])).otherwise(t)
    names = ("tag", "system", "type_code", "number", "suffix", "category", "loop")
    return F.struct(*[c.alias(n) for c, n in zip((t, *part, category, loop), names)])


def split_tag(tag: Column) -> Column:
    """struct(system, type, number) for the register: type first, else number first, else '?' twice and the tag."""
    a, b = r"^(\d{2})-([A-Z]{1,4})(\d.*)$", r"^(\d{2})-(\d{2,5})([A-Z]{1,3})$"

    def pick(i: int, j: int, rest: Column) -> Column:
        return F.when(tag.rlike(a), F.regexp_extract(tag, a, i)).when(tag.rlike(b), F.regexp_extract(tag, b, j)).otherwise(rest)

    return F.struct(pick(1, 1, F.lit("?")).alias("system"), pick(2, 3, F.lit("?")).alias("type"), pick(3, 2, tag).alias("number"))


def legs(base: Column, suffix: Column) -> Column:
    """array of base with each leg of a combined suffix A/B/C."""
    return F.transform(F.split(suffix, "/"), lambda leg: F.concat(base, leg))


def inline_tags(text: Column) -> Column:
    """All tags written out in a text: type first, number first, and the legs of combined ones; distinct, sorted."""
    single = F.regexp_extract_all(text, F.lit(INLINE), F.lit(1))
    number_first = F.regexp_extract_all(text, F.lit(INLINE_NUMBER_FIRST), F.lit(1))
    bases, suffixes = (F.regexp_extract_all(text, F.lit(COMBINED), F.lit(i)) for i in (1, 2))
    both = F.flatten(F.transform(F.arrays_zip(bases.alias("base"), suffixes.alias("suffix")), lambda x: legs(x["base"], x["suffix"])))
    return F.array_sort(F.array_distinct(F.concat(single, number_first, both)))


def system_of_file(name: Column) -> Column:
    """Two digits after H and a letter, else 00."""
    found = F.regexp_extract(name, r"H[A-Z](\d{2})", 1)
    return F.when(found == "", "00").otherwise(found)


def discipline_of_file(name: Column) -> Column:
    """The token after the system token, upper case; null where there is none."""
    tokens = F.split(F.replace(name, F.lit("-"), F.lit(" ")), r"\s+")
    at = F.array_position(F.transform(tokens, lambda t: t.rlike(r"^H[A-Z]\d{1,3}$")), True)
    return F.when(at > 0, F.upper(F.get(tokens, at.cast("int"))))


def validation_key(tag: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(tag), "[^A-Z0-9]", "")


def loose_key(tag: Column) -> Column:
    """type|number whatever the convention; system and suffix are dropped; null for words that only look like tags."""
    t = F.regexp_replace(F.regexp_replace(F.upper(tag), r"\s+", ""), r"^\d{2}-", "")
    t = F.replace(t, F.lit("-"), F.lit(""))
    a, b = r"^([A-Z]{1,4})(\d{2,4})[A-Z]?$", r"^(\d{2,4})([A-Z]{1,4})$"
    first = F.concat_ws("|", F.regexp_extract(t, a, 1), F.regexp_extract(t, a, 2))
    second = F.concat_ws("|", F.regexp_extract(t, b, 2), F.regexp_extract(t, b, 1))
    return F.when(t.rlike(a), F.when(~F.regexp_extract(t, a, 1).isin(LABEL_WORDS), first)).when(t.rlike(b), second)


def pair_key(tag: Column) -> Column:
    """type|number of a tag in either convention, label words too; null for what is no tag."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(tag), r"\s+", ""), r"^\d{2}-", ""), "-", "")
    a, b = r"^([A-Z]{1,4})(\d{2,4})[A-Z]?$", r"^(\d{2,4})([A-Z]{1,4})$"
    return F.when(t.rlike(a), F.concat_ws("|", F.regexp_extract(t, a, 1), F.regexp_extract(t, a, 2))).when(t.rlike(b), F.concat_ws("|", F.regexp_extract(t, b, 2), F.regexp_extract(t, b, 1)))


def hand_keys(tag: Column) -> Column:
    """array of the tags that a hand-written one stands for: a leg for each letter of A/B/C, capitals without blanks."""
    t = F.regexp_replace(F.upper(tag), r"\s+", "")
    base, suffix = F.regexp_extract(t, r"^(.*\d)([A-Z](?:/[A-Z])+)$", 1), F.regexp_extract(t, r"^(.*\d)([A-Z](?:/[A-Z])+)$", 2)
    return F.when(suffix != "", legs(base, suffix)).otherwise(F.array(t))


def strict_key(tag: Column) -> Column:
    """system:TYPEnumber with its suffix; what is no tag stays as it is without blanks and hyphens."""
    t = F.regexp_replace(F.upper(F.trim(tag)), r"[\s-]+", "")
    sys_a, sys_b = r"^(\d{2})([A-Z]{1,4})(\d{2,4})([A-Z]?)$", r"^(\d{2})(\d{2,4})([A-Z]{1,4})$"
    a, b = r"^([A-Z]{1,4})(\d{2,4})([A-Z]?)$", r"^(\d{2,4})([A-Z]{1,4})$"
    ex = F.regexp_extract
    return (
        F.when(t.rlike(sys_a), F.concat(ex(t, sys_a, 1), F.lit(":"), ex(t, sys_a, 2), ex(t, sys_a, 3), ex(t, sys_a, 4)))
        .when(t.rlike(sys_b), F.concat(ex(t, sys_b, 1), F.lit(":"), ex(t, sys_b, 3), ex(t, sys_b, 2)))
        .when(t.rlike(a), F.concat(F.lit(":"), t))
        .when(t.rlike(b), F.concat(F.lit(":"), ex(t, b, 2), ex(t, b, 1)))
        .otherwise(t)
    )


def alarm_semantics(type_code: Column) -> Column:
    """struct(direction, level, priority, is_shutdown, annotated) of a type code."""
    tc = F.upper(F.coalesce(type_code, F.lit("")))
    mark = F.regexp_extract(tc, r"(A|S)(HH|LL|H|L)$", 2)
    annotated = mark != ""
    direction = F.when(annotated, F.when(F.substring(mark, 1, 1) == "H", "high").otherwise("low"))
    level = F.when(annotated, F.when(F.length(mark) == 2, "trip").otherwise("alarm"))
    shutdown = tc.isin(SHUTDOWN_TYPES) | F.coalesce(level == "trip", F.lit(False))
    priority = F.when(shutdown, 1).when(level == "alarm", 2).when(tc.isin(INDICATOR_TYPES), 4).otherwise(3)
    return F.struct(direction.alias("direction"), level.alias("level"), priority.alias("priority"), shutdown.alias("is_shutdown"), annotated.alias("annotated"))


def parameter_of(type_code: Column) -> Column:
    """What a type measures, or null."""
    first = F.substring(type_code, 1, 1)
    out = None
    for letter, name in PARAMETERS.items():
        out = F.when(first == letter, name) if out is None else out.when(first == letter, name)
    return F.when(~type_code.isin(NO_PARAMETER), out)


def guarded_deviations(type_code: Column) -> Column:
    """Deviations that a switch guards, by its letters: PSH high pressure, PSLL low pressure; FSL low and no flow. Else none."""
    tc = F.upper(F.coalesce(type_code, F.lit("")))
    letter, way = F.regexp_extract(tc, "^([PLFT])S(HH|LL|H|L)$", 1), F.regexp_extract(tc, "^([PLFT])S(HH|LL|H|L)$", 2)
    side = F.when(way.startswith("H"), "High").otherwise("Low")
    table = F.create_map(*[F.lit(x) for k, v in PARAMETERS.items() for x in (k, v.lower())])
    one = F.array(F.concat_ws(" ", side, F.element_at(table, F.when(letter != "", letter))))
    return F.when(letter == "", F.array().cast("array<string>")).when((letter == "F") & (side == "Low"), F.array(F.lit("Low flow"), F.lit("No flow"))).otherwise(one)


def alarm_capable(type_code: Column, category: Column) -> Column:
    """Whether a component can ring: measuring and logic functions, safety types, and types with an alarm level in their name."""
    return category.isin("input", "logic") | type_code.isin(SAFETY_TYPES) | alarm_semantics(type_code)["level"].isNotNull()


def engineering_value(type_code: Column, percent: Column) -> Column:
    """struct(value, unit) of a share of the range that a type's first letter has."""
    letter = F.upper(F.substring(type_code, 1, 1))
    top = F.when(letter == "P", 120.0).when(letter == "T", 200.0).when(letter == "F", 500.0).otherwise(100.0)
    unit = F.when(letter == "P", "barg").when(letter == "T", "°C").when(letter == "F", "m³/h").otherwise("%")
    return F.struct((top * percent / 100.0).alias("value"), unit.alias("unit"))


def tag_shape(tag: Column) -> Column:
    """instrument, valve_line or other, by shape."""
    return F.when(tag.rlike(r"^\d{2}-[A-Z]{2,4}\d{2,4}[A-Z]?$"), "instrument").when(tag.rlike(r"^\d{2}-\d{3,4}[A-Z]{1,4}$"), "valve_line").otherwise("other")


def precision_recall(tp: Column, missed: Column, extra: Column) -> list[Column]:
    """precision, recall and F1 to three decimals; 0 where undefined."""
    p = F.when(tp + extra > 0, tp / (tp + extra)).otherwise(0.0)
    r = F.when(tp + missed > 0, tp / (tp + missed)).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f, 3).alias("f1")]


def risk_band(severity: Column, likelihood: Column) -> Column:
    """High from 15, Medium from 8, else Low; empty unless both are whole numbers from 1 to 5."""
    s, l = (c.cast("string").try_cast("int") for c in (severity, likelihood))
    ok = s.between(1, 5) & l.between(1, 5)
    return F.when(F.coalesce(ok, F.lit(False)), F.when(s * l >= 15, "High").when(s * l >= 8, "Medium").otherwise("Low")).otherwise("")


def hazard_score(base: Column, fluid_weights: Column) -> Column:
    """base * (1 + worst weight), 5 at most; weights: array, an empty one counts 0.5, unknown fluids 0.6."""
    worst = F.when(F.size(fluid_weights) == 0, 0.5).otherwise(F.array_max(F.transform(fluid_weights, lambda w: F.coalesce(w, F.lit(0.6)))))
    return F.least(base * (1 + worst), F.lit(5.0))


def isothermal_fill_seconds(p0_bara: Column, p_set_bara: Column, t_c: Column, volume_m3: Column, inflow_kg_h: Column, molar_mass: float = 0.0189) -> Column:
    """Seconds until an ideal gas at one temperature fills a volume from p0 to p_set; null for inputs that make no sense."""
    density_per_bar = 1e5 * molar_mass / (8.314462618 * (t_c + 273.15))
    mass = (p_set_bara - p0_bara) * density_per_bar * volume_m3
    return F.when((inflow_kg_h > 0) & (volume_m3 > 0) & (p_set_bara > p0_bara), mass / inflow_kg_h * 3600)


def level_fill_seconds(volume_m3: Column, inflow_kg_h: Column, density_kg_m3: Column) -> Column:
    return F.when((inflow_kg_h > 0) & (volume_m3 > 0) & (density_kg_m3 > 0), volume_m3 * density_kg_m3 / inflow_kg_h * 3600)


def finding_id(rule: Column, section: Column, tags: Column, most: int = 6) -> Column:
    return F.concat_ws("|", rule, section, F.array_join(F.slice(F.array_sort(tags), 1, most), ","))


def line_label(text: Column) -> Column:
    """struct(size_in, fluid, line_no, system, spec, suffix) of a pipe line label such as 6"-PL-271234-AD200; null if it is none.

    system: the first two digits of a line number of five or more.
    """
    p = r'(\d+(?:\.\d+)?)"\s*[-x]\s*([A-Z]{1,3})\s*-\s*(\d{4,6})\s*-\s*([A-Z]{1,2}\d{3,4})(?:\s*-\s*(\w{1,3}))?'
    size, fluid, number, spec, suffix = (F.regexp_extract(text, p, i) for i in range(1, 6))
    system = F.when(F.length(number) >= 5, F.substring(number, 1, 2))
    label = F.struct(size.try_cast("double").alias("size_in"), fluid.alias("fluid"), number.alias("line_no"), system.alias("system"), spec.alias("spec"), suffix.alias("suffix"))
    return F.when(text.rlike(p), label)
