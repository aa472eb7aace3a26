"""Column functions over free text: questions, mentions, labels, tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.tags import inline_tags, loose_key, pair_key

# Intents in the order in which they are tried, and words for sets of types.
INTENTS = [
    ("path", r"\b(between|path|route)\b|connected to"),
    ("downstream", r"\b(downstream|feeds into|flow|goes to)|after "),
    ("upstream", r"\b(upstream|feeds from|source of|comes from)|before "),
    ("protects", r"\b(protect|safeguard|relief)"),
    ("trips_closing", r"\b(trip|close|shut|esd|isolat)"),
    ("loop", r"\bloop"),
    ("section", r"\b(section|node)"),
    ("list_type", r"\b(list|all|how many|count|number of)\b"),
]
RELIEF = ["PSV", "PSE"]
TRIPS = "LSHH PSHH LSH PSH LSL FSH LSLL PSLL".split()
TYPE_WORDS = {
    "transmitter": "PT TT LT FT PDT PIT".split(),
    "valve": "XV ESV PV LV FV HV TV PCV FO".split(),
    "instrument": "PT PI TT TI LT LI FT FI PDI PDT".split(),
    "relief": RELIEF,
    "psv": RELIEF,
    "trip": TRIPS,
    "controller": "PIC LIC FIC TIC".split(),
    "indicator": "PI TI LI FI".split(),
    "position switch": ["ZS", "ZL"],
}
TYPE_CODES = "PSV PSE PT PIT PDI PDT TT LT FT XV ESV XY PV LV FV HV TV ZS ZL LSHH PSHH LSH PSH LSL FSH PIC LIC FIC TIC HS FO PI TI LI FI".split()
STOP_WORDS = "the a an of in on is are which what where show me find drawing sheet with has have for to and that this på som har hvilken hvilke tegning med og er en et vis".split()
#: What types are called in words.
TYPE_PHRASES = {
    "PT": "pressure transmitter", "PIT": "pressure transmitter", "PI": "pressure indicator gauge", "PIC": "pressure controller control",
    "PSV": "pressure safety relief valve psv overpressure", "PSE": "pressure relief rupture disc overpressure", "PDI": "differential pressure",
    "PDT": "differential pressure transmitter", "LT": "level transmitter", "LI": "level indicator", "LG": "level gauge", "LSH": "level switch high",
    "LSHH": "level trip high high", "LSL": "level switch low", "LV": "level control valve", "FT": "flow transmitter", "FI": "flow indicator",
    "FIC": "flow controller", "FV": "flow control valve", "FO": "restriction orifice flow", "TT": "temperature transmitter", "TI": "temperature indicator",
    "TIC": "temperature controller", "TV": "temperature control valve", "XV": "shutdown valve esd on off isolation", "ESV": "emergency shutdown valve",
    "PV": "control valve", "PCV": "pressure control valve", "HV": "hand valve manual", "ZS": "valve position switch feedback",
    "ZL": "valve position lamp indication", "AE": "analyser gas detector", "HS": "hand switch", "XY": "solenoid relay", "PY": "pressure relay",
}
#: Words of title blocks; names of owners and places are a site's own.
BOILERPLATE = (
    "SYSTEM CONTROL DIAGRAM|DRAWING TITLE|DRAWING NO|SYSTEM TAG|OIL & GAS|OIL  & GAS|RNER OIL & GAS|CORNER OIL & GAS|AS BUILT|ISSUED FOR CONSTRUCTION|"
    "SCALE|PROJECTION|PROJECT NO|WORK PACK|AREA|DISC|SUP|CHK|DRN|CONTR|DATE|TITLE|REV|SHT NO|NUMBER|SYSTEM NO|DDB|MULTISYSTEMS|MULTISYSTEM"
).split("|")
#: Tags as answers write them.
TOKEN = r"\b\d{2}-[A-Z]{1,4}-?\d{2,4}[A-Z]?\b|\b\d{2}-\d{3,4}[A-Z]{1,4}\b|\b[A-Z]{2,4}[ -]\d{3,4}[A-Z]?\b"


def intent(question: Column) -> Column:
    """The first intent whose words are in the question; neighbours if none is."""
    q, out = F.lower(question), None
    for name, pattern in INTENTS:
        out = F.when(q.rlike(pattern), name) if out is None else out.when(q.rlike(pattern), name)
    return out.otherwise("neighbors")


def systems(question: Column) -> Column:
    return F.regexp_extract_all(question, F.lit(r"(?i)\bsystem\s*(\d{2})\b"), F.lit(1))


def types(question: Column) -> Column:
    """Type codes that a question names, alone or in the plural, or that its words stand for; sorted, distinct."""
    q = F.lower(question)
    direct = F.transform(F.regexp_extract_all(question, F.lit(rf"(?i)\b({'|'.join(TYPE_CODES)})s?\b"), F.lit(1)), F.upper)
    parts = [F.when(q.rlike(rf"\b{word}s?\b"), F.array(*[F.lit(c) for c in codes])).otherwise(F.array().cast("array<string>")) for word, codes in TYPE_WORDS.items()]
    return F.array_sort(F.array_distinct(F.concat(direct, F.flatten(F.array(*parts)))))


def terms(text: Column) -> Column:
    """Lower-case words of two letters or more, without stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(F.lower(text), r"[^a-zA-Z0-9æøå]+"), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def query_codes(question: Column) -> Column:
    """Type codes that most of a question's words stand for: those named by as many words as any; sorted."""
    words = F.array_distinct(terms(question))
    table = F.create_map(*[x for code, phrase in TYPE_PHRASES.items() for x in (F.lit(code), F.array(*[F.lit(w) for w in sorted({*phrase.split(), code.lower()})]))])
    scored = F.transform(F.map_entries(table), lambda e: F.struct(F.size(F.array_intersect(e["value"], words)).alias("n"), e["key"].alias("code")))
    best = F.array_max(F.transform(scored, lambda x: x["n"]))
    return F.array_sort(F.transform(F.filter(scored, lambda x: (x["n"] > 0) & (x["n"] == best)), lambda x: x["code"]))


def is_nozzle(tag: Column) -> Column:
    return tag.rlike(r"(?i)^(\d{1,3}[- ]?)?N\d{1,5}$")


def is_valve_line(tag: Column) -> Column:
    return tag.rlike(r"(?i)^(\d{1,3}[- ]?)?\d{3,5}[A-Z]{1,3}$")


def is_descriptive(phrase: Column, also: tuple[str, ...] = ()) -> Column:
    """Four to forty characters of label text with at least four letters, three of them in a row, and no title-block words.

    also: more phrases, in capitals, that are no names (owners and places of a site).
    """
    p = F.regexp_replace(F.trim(phrase), "[.:;,]+$", "")
    letters = F.length(F.regexp_replace(p, r"[^\p{L}]", ""))
    form = F.length(p).between(4, 40) & (letters >= 4) & p.rlike(r"^[A-Za-z0-9 &()\-/.,']+$") & p.rlike("[A-Za-z]{3,}")
    return form & ~F.upper(p).isin([*BOILERPLATE, *also])


def home_system(name: Column, prefix: str = "HO") -> Column:
    """The two digits behind a file's facility prefix, or null."""
    found = F.regexp_extract(name, rf"(?i){prefix}(\d{{2}})", 1)
    return F.when(found != "", found)


def difference_kind(tags: Column) -> Column:
    """What tells different spellings of one instrument apart."""
    tags = F.array_distinct(tags)
    first = F.filter(tags, lambda t: t.rlike(r"^\d{2}-\d{2,4}[A-Z]{1,4}$"))
    joined = F.array_distinct(F.transform(tags, lambda t: F.regexp_replace(t, r"[\s-]", "")))
    unpadded = F.array_distinct(F.transform(joined, lambda t: F.ltrim(t, F.lit("0"))))
    mixed = (F.size(first) > 0) & (F.size(first) < F.size(tags))
    return (
        F.when(mixed, "nummer-først vs type-først")
        .when(F.size(unpadded) < F.size(joined), "leading zeros")
        .when(F.size(joined) < F.size(tags), "separator/whitespace")
        .otherwise("different spelling")
    )


def tolerant_json(text: Column, schema: str) -> Column:
    """JSON with code fences around it or words before and after; null where it is none."""
    body = F.regexp_replace(text, r"(?s)^.*?```(?:json)?\s*|\s*```.*$", "")
    return F.from_json(F.regexp_extract(body, r"(?s)([\[{].*[\]}])", 1), schema, {"mode": "PERMISSIVE"})


def option_matches(option: Column, candidate: Column) -> Column:
    """Equal, or one within the other, whatever the case; empty matches nothing."""
    a, b = F.lower(F.trim(option)), F.lower(F.trim(candidate))
    return (a != "") & (b != "") & ((a == b) | a.contains(b) | b.contains(a))


def audit_answer(answers: DataFrame, text: str, register: DataFrame) -> DataFrame:
    """answers with known and unknown: the tags a text names, told apart by the register (tag)."""
    named = answers.withColumn("_id", F.monotonically_increasing_id()).withColumn("_tags", inline_tags(F.col(text)))
    each = named.select("_id", F.explode("_tags").alias("tag")).join(register.select("tag").distinct().withColumn("_ok", F.lit(True)), "tag", "left")
    got = each.groupBy("_id").agg(F.array_sort(F.collect_set(F.when(F.col("_ok"), F.col("tag")))).alias("known"), F.array_sort(F.collect_set(F.when(F.col("_ok").isNull(), F.col("tag")))).alias("unknown"))
    empty = F.array().cast("array<string>")
    return named.join(got, "_id", "left").select(*answers.columns, F.coalesce("known", empty).alias("known"), F.coalesce("unknown", empty).alias("unknown"))


def classify_mentions(mentions: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """Mentions (drawing, tag) against two sources by loose key: CONFIRMED_BOTH, RECOVERED (truth only), TEXT_ONLY, UNCONFIRMED, NOISE."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("drawing", loose_key(F.col("tag")).alias("_k")).filter("_k IS NOT NULL").distinct().withColumn(name, F.lit(True))

    m = mentions.withColumn("_k", loose_key(F.col("tag"))).join(side(truth, "_t"), ["drawing", "_k"], "left").join(side(found, "_f"), ["drawing", "_k"], "left")
    t, f = F.coalesce("_t", F.lit(False)), F.coalesce("_f", F.lit(False))
    kind = F.when(F.col("_k").isNull(), "NOISE").when(t & f, "CONFIRMED_BOTH").when(t, "RECOVERED").when(f, "TEXT_ONLY").otherwise("UNCONFIRMED")
    return m.select("drawing", "tag", kind.alias("class"))


def tokens(text: Column) -> Column:
    """What is written like a tag, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def canonical(named: DataFrame, token: str, register: DataFrame) -> DataFrame:
    """named with canonical: the register's spelling of a token, by the same string, else the least tag of the same type and
    number; null where there is none."""
    squeezed = lambda c: F.regexp_replace(F.upper(c), r"\s+", "")
    tags = register.select("tag").distinct()
    same = tags.groupBy(squeezed(F.col("tag")).alias("_s")).agg(F.min("tag").alias("_exact"))
    pair = tags.groupBy(pair_key(F.col("tag")).alias("_p")).agg(F.min("tag").alias("_pair")).filter("_p IS NOT NULL")
    out = named.withColumn("_s", squeezed(F.col(token))).withColumn("_p", pair_key(F.col(token))).join(same, "_s", "left").join(pair, "_p", "left")
    return out.select(*named.columns, F.coalesce("_exact", "_pair").alias("canonical"))


def _resolved(steps: DataFrame, keys: list[str], text: str, register: DataFrame) -> DataFrame:
    """steps with tags: the register's tags that a text names, in order of first mention."""
    each = steps.select(*keys, F.posexplode(tokens(F.col(text))).alias("_at", "_token"))
    found = canonical(each, "_token", register).filter("canonical IS NOT NULL").groupBy(*keys, "canonical").agg(F.min("_at").alias("_at"))
    tags = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "canonical"))), lambda x: x["canonical"]).alias("tags"))
    return steps.join(tags, keys, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def verification_plan(answers: DataFrame, key: str, text: str, register: DataFrame) -> DataFrame:
    """key, step (from 1, in order), n (the number written), body, tags: the numbered steps of an answer's plan section.

    Lines that follow a numbered one belong to it. Without the section's heading the whole answer is read, and only steps whose
    number is their place count, of which there must be two.
    """
    heading = r"(?is)VERIFICATION\s+PLAN(.*?)(?:\n\s*(?:\*\*)?\s*3[.)]\s*DO\s+NOT\s+ACT|$)"
    a = answers.select(key, F.col(text).rlike(r"(?is)VERIFICATION\s+PLAN").alias("_headed"), F.col(text).alias("_t"))
    a = a.withColumn("_body", F.when(F.col("_headed"), F.regexp_extract("_t", heading, 1)).otherwise(F.col("_t")))
    lines = a.select(key, "_headed", F.posexplode(F.split("_body", r"\r?\n")).alias("_line", "_s"))
    opening = r"^\s*(?:\*\*)?(\d)[.)]\s*(?:\*\*)?\s*(.+)$"
    n = F.regexp_extract("_s", opening, 1)
    running = Window.partitionBy(key).orderBy("_line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_n", n).withColumn("step", F.sum((F.col("_n") != "").cast("int")).over(running)).filter("step > 0")
    part = F.when(F.col("_n") != "", F.trim(F.regexp_extract("_s", opening, 2))).otherwise(F.trim("_s"))
    g = lines.withColumn("_part", part).filter("_part <> ''").groupBy(key, "step", "_headed").agg(
        F.max("_n").cast("int").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "_part"))), lambda x: x["_part"]), " ").alias("body")
    )
    run = g.filter(F.col("_headed") | (F.col("n") == F.col("step")))
    enough = F.count("*").over(Window.partitionBy(key)) >= 2
    run = run.withColumn("_ok", F.col("_headed") | enough).filter("_ok").select(key, "step", "n", "body")
    return _resolved(run, [key, "step"], "body", register)


def hold_off(answers: DataFrame, key: str, text: str, register: DataFrame) -> DataFrame:
    """key, body, tags of an answer's section on what not to do yet; answers without it are left out."""
    found = F.regexp_extract(text, r"(?is)DO\s+NOT\s+ACT\s+YET[^\n]*?[\u2014\-:\u2013]*\s*(.+?)(?:Structural\s+decision\s+support|$)", 1)
    body = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(found, r"[*_#]+", "")), r"\s+", " "), r"^[\u2014\u2013\-: ]+", "")
    return _resolved(answers.select(key, F.trim(body).alias("body")).filter("body <> ''"), [key], "body", register)


def favoured(answers: DataFrame, key: str, text: str, register: DataFrame, candidates: DataFrame) -> DataFrame:
    """key, tag: the candidate (key, tag) that the evidence section mentions most often, of several the first mentioned."""
    section = F.regexp_extract(text, r"(?is)WEIGHING\s+EVIDENCE(.*?)(?:VERIFICATION\s+PLAN|$)", 1)
    each = answers.select(key, F.posexplode(tokens(section)).alias("_at", "_token"))
    found = canonical(each, "_token", register).select(key, F.col("canonical").alias("tag"), "_at").join(candidates.select(key, "tag").distinct(), [key, "tag"], "left_semi")
    n = found.groupBy(key, "tag").agg((-F.count("*")).alias("_less"), F.min("_at").alias("_first"))
    return n.groupBy(key).agg(F.min(F.struct("_less", "_first", "tag")).alias("_b")).select(key, F.col("_b.tag").alias("tag"))
