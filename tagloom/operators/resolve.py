"""Point names against a tag register: parse, resolve in stages, never guess."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no identity, legs and levels.
ATTRIBUTES = "PV MEAS VALUE VAL AI AO OUT IN SP CV STAT STATUS ALM ALARM MODE QUAL EU".split()
SOURCES = "TAG POINT PT_ID ITEM PLANT SAS IMS".split()
LEVELS = ["H", "HH", "L", "LL"]
_ALARM = r"^[PLTFZXA]{0,2}(HH|LL|H|L)$"
_FORMS = {
    "type_first": (r"^(\d{2})([A-Z]{1,4})(\d{2,4})([A-Z]{0,2})$", (1, 2, 3, 4)),
    "number_first": (r"^(\d{2})(\d{2,4})([A-Z]{1,4})$", (1, 3, 2, 0)),
    "no_system": (r"^([A-Z]{1,4})(\d{2,4})([A-Z]{0,2})$", (0, 1, 2, 3)),
}


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _peel(rest: Column) -> Column:
    """struct(open, body, level, attribute) of the tokens: attributes and alarm marks come off the end, the rest is joined."""
    attributes = F.array(*[F.lit(w) for w in ATTRIBUTES])
    start = F.struct(F.lit(True).alias("open"), F.lit("").alias("body"), F.lit("").alias("level"), F.lit("").alias("attribute"))

    def step(acc: Column, item: Column) -> Column:
        t = item["t"]
        last = acc["open"] & ~item["first"]
        attribute = last & F.array_contains(attributes, t)
        alarm = last & ~attribute & t.rlike(_ALARM)
        return F.struct(
            (attribute | alarm).alias("open"),
            F.when(attribute | alarm, acc["body"]).otherwise(F.concat(t, acc["body"])).alias("body"),
            F.when(alarm, F.regexp_extract(t, _ALARM, 1)).otherwise(acc["level"]).alias("level"),
            F.when(attribute, t).otherwise(acc["attribute"]).alias("attribute"),
        )

    return F.aggregate(F.reverse(F.transform(rest, lambda t, i: F.struct(t.alias("t"), (i == 0).alias("first")))), start, step)


def _parts(body: Column) -> Column:
    """struct(system, type_code, number, leg) by the first form that fits; null if none does."""
    out = None
    for pattern, groups in _FORMS.values():
        fields = [(F.regexp_extract(body, pattern, g) if g else F.lit("")).alias(n) for n, g in zip(("system", "type_code", "number", "leg"), groups)]
        out = F.when(body.rlike(pattern), F.struct(*fields)) if out is None else out.when(body.rlike(pattern), F.struct(*fields))
    return out


def parse_point(raw: Column, site_words: tuple[str, ...] = ()) -> Column:
    """struct(system, type_code, number, leg, alarm_level, attribute); type_code null where nothing like a tag is there.

    site_words: names of the plant or export that count as source words too. Source words in front and attributes or alarm marks behind are whole tokens; the first token is never taken off.
    """
    words = F.array(*[F.lit(w) for w in (*SOURCES, *site_words)])

    def without_front(tokens: Column) -> Column:
        front = F.aggregate(tokens, F.lit(0), lambda n, t: F.when((n >= 0) & F.array_contains(words, t), n + 1).when(n >= 0, -n - 1).otherwise(n), lambda n: F.when(n < 0, -n - 1).otherwise(n))
        return F.slice(tokens, F.greatest(F.least(front, F.size(tokens) - 1), F.lit(0)) + 1, F.greatest(F.size(tokens), F.lit(1)))

    def answer(peeled: Column, parts: Column) -> Column:
        leg = parts["leg"]
        level = F.when(peeled["level"] != "", peeled["level"]).when(leg.isin(LEVELS), leg)
        return F.struct(
            parts["system"].alias("system"), parts["type_code"].alias("type_code"), parts["number"].alias("number"), F.when(leg.isin(LEVELS), "").otherwise(leg).alias("leg"),
            level.alias("alarm_level"), F.when(peeled["attribute"] != "", peeled["attribute"]).alias("attribute"),
        )

    tokens = F.filter(F.split(F.upper(F.trim(raw)), r"[\s_\-./:\\]+"), lambda t: t != "")
    body = lambda peeled: F.regexp_replace(peeled["body"], r"^[A-Z]{1,3}(?=\d{2})", "")
    return _bind(_bind(tokens, lambda t: _peel(without_front(t))), lambda p: _bind(_bind(body(p), _parts), lambda q: answer(p, q)))


def squeeze(tag: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(tag)), r"[\s-]+", "")


def register_index(register: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Register (tag) -> three lookups: exact string, key, and stem (key without leg) with their tags."""
    tags = register.select(F.upper(F.trim("tag")).alias("tag")).filter("tag <> ''").distinct()
    exact = tags.groupBy(squeeze(F.col("tag")).alias("norm")).agg(F.min("tag").alias("exact_tag"))
    parsed = tags.withColumn("p", parse_point(F.col("tag"))).filter("p.type_code IS NOT NULL").select("tag", "p.system", "p.type_code", "p.number", "p.leg")
    stem = ["system", "type_code", "number"]
    by_key = parsed.groupBy(*stem, "leg").agg(F.array_sort(F.collect_set("tag")).alias("key_tags"))
    by_stem = parsed.groupBy(*stem).agg(F.array_sort(F.collect_set("tag")).alias("stem_tags"))
    return exact, by_key, by_stem


def resolve_points(points: DataFrame, register: DataFrame, raw: str = "raw") -> DataFrame:
    """points with tag, status (exact, resolved, ambiguous, unresolved), candidates, alarm_level and attribute.

    A point without a leg whose stem the register knows only with legs is ambiguous even if it knows but one: its sibling
    may be missing from the register. Rejects stay as rows.
    """
    exact, by_key, by_stem = register_index(register)
    p = points.withColumn("_p", parse_point(F.col(raw))).withColumn("norm", squeeze(F.col(raw)))
    p = p.select("*", "_p.*").drop("_p").join(exact, "norm", "left")
    p = p.join(by_key, ["system", "type_code", "number", "leg"], "left").join(by_stem, ["system", "type_code", "number"], "left")
    one, many = F.size("key_tags") == 1, F.size("key_tags") > 1
    by_string = F.col("exact_tag").isNotNull()
    status = F.when(by_string, F.when(F.trim(raw) == F.col("exact_tag"), "exact").otherwise("resolved")).when(one, "resolved").when(many | F.col("stem_tags").isNotNull(), "ambiguous").otherwise("unresolved")
    tag = F.when(by_string, F.col("exact_tag")).when(one, F.get("key_tags", F.lit(0)))
    unclear = F.when(~by_string & many, F.col("key_tags")).when(~by_string & ~F.coalesce(one, F.lit(False)), F.col("stem_tags"))
    names = [c for c in points.columns]
    return p.select(*names, tag.alias("tag"), status.alias("status"), F.coalesce(unclear, F.array().cast("array<string>")).alias("candidates"), "alarm_level", "attribute")


def variants(register: DataFrame) -> DataFrame:
    """tag, style, raw: the ways a tag is written elsewhere. A tag with a leg has no number-first form."""
    t = register.withColumn("p", parse_point(F.col("tag"))).filter("p.type_code IS NOT NULL")
    s, y, n, leg = (F.col(f"p.{x}") for x in ("system", "type_code", "number", "leg"))
    forms = {
        "canonical": F.col("tag"), "compact": F.concat(s, y, n, leg), "hyphens": F.concat_ws("-", s, y, F.concat(n, leg)), "underscores": F.concat_ws("_", s, y, F.concat(n, leg)),
        "facility": F.concat(F.lit("HO"), s, F.lit("_"), y, F.lit("_"), n, leg), "attribute": F.concat(s, y, n, leg, F.lit(".PV")), "alarm": F.concat(s, y, n, leg, F.lit(".PAHH")),
        "level": F.concat(s, y, n, leg, F.lit("_HH")), "source": F.concat(F.lit("TAG:"), s, F.lit("-"), y, n, leg, F.lit(":PV")), "lower": F.lower(F.col("tag")),
        "number_first": F.when(leg == "", F.concat(s, F.lit("-"), n, y)),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("style"), v.alias("raw")) for k, v in forms.items()]))
    return t.select("tag", rows.alias("v")).select("tag", "v.style", "v.raw").filter("raw IS NOT NULL")


def evaluate_resolver(register: DataFrame) -> DataFrame:
    """style, hit, wrong, ambiguous, miss: how each way of writing is resolved."""
    got = resolve_points(variants(register).withColumnRenamed("tag", "truth"), register)
    return got.groupBy("style").agg(
        F.count(F.when(F.col("tag") == F.col("truth"), 1)).alias("hit"), F.count(F.when(F.col("tag") != F.col("truth"), 1)).alias("wrong"),
        F.count(F.when(F.col("status") == "ambiguous", 1)).alias("ambiguous"), F.count(F.when(F.col("status") == "unresolved", 1)).alias("miss"),
    )
