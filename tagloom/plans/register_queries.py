"""Registers, keys, scores and merges over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.functions import tags as T
from tagloom.operators import cause_effect as CE
from tagloom.operators import register as R
from tagloom.operators import resolve
from tagloom.plans.shapes import TAGS_SQL, plant_tags, read


def _sides(spark, d):
    """Customers by nation: those with an urgent order against those with a large one."""
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = [F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("cust")]
    return o.filter("o_orderpriority LIKE '1-%'").select(*key), o.filter("o_totalprice > 150000").select(*key)


_SIDES = """a AS (SELECT DISTINCT c_nationkey AS nation, c_custkey AS cust FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority LIKE '1-%'),
  b AS (SELECT DISTINCT c_nationkey AS nation, c_custkey AS cust FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000),
  r AS (SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.cust, b.cust) AS cust,
    CASE WHEN a.cust IS NOT NULL AND b.cust IS NOT NULL THEN 'both' WHEN a.cust IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS status
    FROM a FULL JOIN b ON a.nation = b.nation AND a.cust = b.cust)"""


def reconcile_status(spark, d):
    return R.reconcile(*_sides(spark, d), ["nation", "cust"])


def reconcile_summary(spark, d):
    return R.reconcile_summary(R.reconcile(*_sides(spark, d), ["nation", "cust"]), "nation")


def _pairs(spark, d):
    """Parts by brand: shipped with returns as truth, shipped late in the month as extraction."""
    li = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    key = [F.col("p_brand").alias("brand"), F.col("l_orderkey").alias("ord"), F.col("l_partkey").alias("part")]
    return li.filter("dayofmonth(l_shipdate) > 8").select(*key), li.filter("l_returnflag <> 'N'").select(*key)


_PAIRS = """li AS (SELECT p_brand AS brand, l_orderkey AS ord, l_partkey AS part, l_returnflag, l_shipdate FROM lineitem JOIN part ON l_partkey = p_partkey),
  t AS (SELECT DISTINCT brand, ord, part FROM li WHERE l_returnflag <> 'N'), e AS (SELECT DISTINCT brand, ord, part FROM li WHERE day(l_shipdate) > 8),
  m AS (SELECT coalesce(t.brand, e.brand) AS brand, CASE WHEN t.ord IS NOT NULL AND e.ord IS NOT NULL THEN 'tp' WHEN t.ord IS NOT NULL THEN 'missed' ELSE 'extra' END AS status
    FROM t FULL JOIN e ON t.brand = e.brand AND t.ord = e.ord AND t.part = e.part)"""
_SCORES = """count(*) FILTER (status = 'tp') AS tp, count(*) FILTER (status = 'missed') AS missed, count(*) FILTER (status = 'extra') AS extra"""
_PRF = """tp, missed, extra, round(p, 3) AS precision, round(r, 3) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 3) AS f1
  FROM (SELECT *, CASE WHEN tp + extra > 0 THEN tp / (tp + extra) ELSE 0.0 END AS p, CASE WHEN tp + missed > 0 THEN tp / (tp + missed) ELSE 0.0 END AS r FROM g)"""


def score_micro(spark, d):
    e, t = _pairs(spark, d)
    return R.scores(R.match_status(e, t, ["brand", "ord", "part"]), "brand")


def score_overall(spark, d):
    e, t = _pairs(spark, d)
    return R.scores(R.match_status(e, t, ["brand", "ord", "part"]))


def register_build(spark, d):
    """Orders as sheets: which customers stand on urgent (P&ID) and on other (SCD) sheets of a segment."""
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.when(F.col("o_orderpriority").startswith("1-"), "PID").otherwise("SCD")
    return R.build_register(o.select(F.col("c_name").alias("tag"), kind.alias("doc_type"), F.concat_ws("-", F.year("o_orderdate").cast("string"), "c_mktsegment").alias("file")))


def extract_tokens(spark, d):
    """Tags that stand in sentences, one a loop, with the legs of combined ones: found inline, and split for the register."""
    t = plant_tags(spark, d).groupBy("loop").agg(F.max("tag").alias("a"), F.min("tag").alias("b"), F.min("system").alias("system"), F.min("number").alias("number"))
    said = F.concat(F.lit("see "), F.col("a"), F.lit(", then "), F.col("system"), F.lit("-"), F.col("number"), F.lit("PV and "), F.col("system"), F.lit("-FT"), F.col("number"), F.lit("A/B; "), F.col("b"), F.lit("."))
    found = t.select("loop", F.explode(T.inline_tags(said)).alias("tag"))
    return found.withColumn("s", T.split_tag(F.col("tag"))).select("loop", "tag", "s.system", "s.type", "s.number")


def split_brand(spark, d):
    """The plant's tags as the register splits them, and by the keys of validation and of type and number."""
    t = plant_tags(spark, d).select("tag").distinct()
    return t.withColumn("s", T.split_tag(F.col("tag"))).select("tag", "s.system", "s.type", "s.number", T.validation_key(F.col("tag")).alias("vkey"), T.pair_key(F.col("tag")).alias("pair"))


def typed_tags(spark, d):
    t = plant_tags(spark, d).select("tag")
    p = t.select(T.parse_tag(F.col("tag")).alias("p"), T.strict_key(F.col("tag")).alias("strict"), T.loose_key(F.col("tag")).alias("loose"), T.tag_shape(F.col("tag")).alias("shape"))
    s = T.alarm_semantics(F.col("p.type_code"))
    return p.select("p.tag", "p.system", "p.type_code", "p.number", "p.suffix", "p.category", "p.loop", "strict", "loose", "shape", s["direction"].alias("direction"), s["priority"].cast("int").alias("priority"), T.parameter_of(F.col("p.type_code")).alias("parameter"))


_IN = lambda xs: "('" + "','".join(xs) + "')"
_CATEGORY = "CASE " + " ".join(f"WHEN type_code IN {_IN(v)} THEN '{k}'" for k, v in T.CATEGORIES.items()) + " ELSE 'other' END"
_PRIORITY = f"CASE WHEN type_code IN {_IN(T.SHUTDOWN_TYPES)} OR regexp_matches(type_code, '(A|S)(HH|LL)$') THEN 1 WHEN regexp_matches(type_code, '(A|S)(H|L)$') THEN 2 WHEN type_code IN {_IN(T.INDICATOR_TYPES)} THEN 4 ELSE 3 END"


def resolve_points(spark, d):
    """All spellings of all tags against a register that lacks the tags of size over 40."""
    t = plant_tags(spark, d)
    points = resolve.variants(t.select("tag")).select("style", F.col("tag").alias("truth"), "raw")
    got = resolve.resolve_points(points, t.filter("size <= 40"))
    return got.select("style", "truth", "raw", "tag", "status", F.array_join("candidates", ",").alias("candidates"))


def resolver_evaluation(spark, d):
    return resolve.evaluate_resolver(plant_tags(spark, d).select("tag"))


def _ce_rows(spark, d):
    """Order lines as cause and effect rows, some in other spellings, some of tags that the register lacks."""
    t = plant_tags(spark, d).select("id", "tag")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id"), F.lead("l_partkey").over(w).alias("other"), F.col("l_returnflag").alias("flag"))
    li = li.filter("other IS NOT NULL").join(t.withColumnRenamed("tag", "cause_tag"), "id").join(t.select(F.col("id").alias("other"), F.col("tag").alias("effect_tag")), "other")
    spelt = F.when(F.col("flag") == "R", F.lower(F.concat(F.lit(" "), F.substring("cause_tag", 1, 5), F.lit(" "), F.expr("substring(cause_tag, 6)")))).otherwise(F.col("cause_tag"))
    return li.select("l_orderkey", "l_linenumber", spelt.alias("cause_tag"), "effect_tag", F.when(F.col("flag") == "A", "Ja").otherwise("no").alias("verified"), F.lit("closes").alias("function"))


def ce_validate(spark, d):
    """Cause and effect rows against the register of tags of size up to 40."""
    v = CE.validate(_ce_rows(spark, d), plant_tags(spark, d).filter("size <= 40"))
    return v.select("l_orderkey", "l_linenumber", "cause", "effect", "ok", "is_verified")


def semi_anti_coverage(spark, d):
    """Nations: customers with orders, without, and with none over 100000."""
    c, o = read(spark, d, "customer"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    parts = [(c.join(o, "c_custkey", "left_semi"), "with_orders"), (c.join(o, "c_custkey", "left_anti"), "without"), (c.join(o.filter("o_totalprice > 100000"), "c_custkey", "left_anti"), "no_large")]
    out = None
    for df, kind in parts:
        g = df.groupBy("c_nationkey").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        out = g if out is None else out.unionByName(g)
    return out


def shared_pairs(spark, d):
    """Pairs of suppliers that ship the same part, and how many parts."""
    li = read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    a, b = li.select("l_partkey", F.col("l_suppkey").alias("a")), li.select("l_partkey", F.col("l_suppkey").alias("b"))
    return a.join(b, "l_partkey").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n_parts")).filter("n_parts >= 2")


def update_merge(spark, d):
    """Edits of the last order of each customer into the customer list; null edits change nothing."""
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("m"))
    edits = o.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("m.o_orderstatus") != "O", F.concat(F.lit("LAST-"), F.col("m.o_orderstatus"))).alias("c_mktsegment"))
    return R.update_merge(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), edits, ["c_custkey"], ["c_mktsegment"])


def latest_disposition(spark, d):
    e = read(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"))
    return R.latest(e, "user_id", ["ts", "event_id"], "error").select("user_id", "event_id", "status")


def config_diff(spark, d):
    """Users' first against last event: what was added, removed or changed from one half of the time to the other."""
    e = read(spark, d, "events")
    half = e.agg(F.expr("CAST((unix_micros(CAST(min(ts) AS TIMESTAMP)) + unix_micros(CAST(max(ts) AS TIMESTAMP))) DIV 2 AS BIGINT)").alias("m"))
    e = e.crossJoin(F.broadcast(half)).withColumn("late", F.expr("unix_micros(CAST(ts AS TIMESTAMP)) > m"))
    last = e.groupBy("user_id", "late").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("l"))
    side = lambda late: last.filter(F.col("late") == late).select("user_id", F.col("l.event_type").alias("event_type"), F.col("l.value").alias("value"))
    return R.diff(side(False), side(True), "user_id", ["event_type", "value"])


def dangling_references(spark, d):
    return R.dangling(read(spark, d, "labels").select(F.col("doc_id").alias("ref")), "ref", read(spark, d, "documents").filter("lang = 'en'"), "doc_id")


QUERIES = {f.__name__: f for f in (reconcile_status, reconcile_summary, score_micro, score_overall, register_build, extract_tokens, split_brand, typed_tags, resolve_points, resolver_evaluation, ce_validate, semi_anti_coverage, shared_pairs, update_merge, latest_disposition, config_diff, dangling_references)}

_VARIANTS = f"""{TAGS_SQL}, v AS (SELECT tag AS truth, unnest([
    {{'style': 'canonical', 'raw': tag}}, {{'style': 'compact', 'raw': system || type_code || number || suffix}}, {{'style': 'hyphens', 'raw': system || '-' || type_code || '-' || number || suffix}},
    {{'style': 'underscores', 'raw': system || '_' || type_code || '_' || number || suffix}}, {{'style': 'facility', 'raw': 'HO' || system || '_' || type_code || '_' || number || suffix}},
    {{'style': 'attribute', 'raw': system || type_code || number || suffix || '.PV'}}, {{'style': 'alarm', 'raw': system || type_code || number || suffix || '.PAHH'}},
    {{'style': 'level', 'raw': system || type_code || number || suffix || '_HH'}}, {{'style': 'source', 'raw': 'TAG:' || system || '-' || type_code || number || suffix || ':PV'}},
    {{'style': 'lower', 'raw': lower(tag)}}, {{'style': 'number_first', 'raw': CASE WHEN suffix = '' THEN system || '-' || number || type_code END}}], recursive := true), system, type_code, number, suffix FROM tags),
  vv AS (SELECT * FROM v WHERE raw IS NOT NULL)"""

ORACLES = {
    "reconcile_status": f"WITH {_SIDES} SELECT nation, cust, status FROM r",
    "reconcile_summary": f"""WITH {_SIDES} SELECT nation, count(*) FILTER (status = 'both') AS both, count(*) FILTER (status = 'left_only') AS left_only, count(*) FILTER (status = 'right_only') AS right_only,
        round(100.0 * count(*) FILTER (status = 'both') / count(*), 1) AS pct_both FROM r GROUP BY nation""",
    "score_micro": f"WITH {_PAIRS}, g AS (SELECT CASE WHEN grouping(brand) = 1 THEN 'TOTAL' ELSE brand END AS brand, {_SCORES} FROM m GROUP BY ROLLUP (brand)) SELECT brand, {_PRF}",
    "score_overall": f"WITH {_PAIRS}, g AS (SELECT {_SCORES} FROM m) SELECT {_PRF}",
    "register_build": """WITH m AS (SELECT DISTINCT c_name AS tag, CASE WHEN o_orderpriority LIKE '1-%' THEN 'PID' ELSE 'SCD' END AS k, year(o_orderdate) || '-' || c_mktsegment AS file FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT tag, CASE WHEN count(*) FILTER (k = 'PID') > 0 AND count(*) FILTER (k = 'SCD') > 0 THEN 'both' WHEN count(*) FILTER (k = 'PID') > 0 THEN 'pid_only' ELSE 'scd_only' END AS status,
        count(*) FILTER (k = 'PID') AS n_pid, count(*) FILTER (k = 'SCD') AS n_scd, coalesce(string_agg(file, ';' ORDER BY file) FILTER (k = 'PID'), '') AS pid_files, coalesce(string_agg(file, ';' ORDER BY file) FILTER (k = 'SCD'), '') AS scd_files FROM m GROUP BY tag""",
    "extract_tokens": f"""WITH {TAGS_SQL}, g AS (SELECT loop, min(system) AS s, min(number) AS n, max(tag) AS a, min(tag) AS b FROM tags GROUP BY loop),
        x AS (SELECT DISTINCT loop, s, n, unnest([a, b, s || '-' || n || 'PV', s || '-FT' || n || 'A', s || '-FT' || n || 'B']) AS tag FROM g)
        SELECT loop, tag, s AS system, CASE WHEN regexp_matches(tag, '-[0-9]') THEN 'PV' ELSE regexp_extract(tag, '-([A-Z]+)', 1) END AS type,
        CASE WHEN regexp_matches(tag, '-[0-9]') THEN n ELSE regexp_extract(tag, '-[A-Z]+(.*)', 1) END AS number FROM x""",
    "split_brand": f"WITH {TAGS_SQL} SELECT DISTINCT tag, system, type_code AS type, number || suffix AS number, system || type_code || number || suffix AS vkey, type_code || '|' || number AS pair FROM tags",
    "typed_tags": f"""WITH {TAGS_SQL} SELECT tag, system, type_code, number, suffix, {_CATEGORY} AS category, loop, system || ':' || type_code || number || suffix AS strict, type_code || '|' || number AS loose, 'instrument' AS shape,
        CASE WHEN regexp_matches(type_code, '(A|S)(HH|H)$') THEN 'high' WHEN regexp_matches(type_code, '(A|S)(LL|L)$') THEN 'low' END AS direction, CAST({_PRIORITY} AS INT) AS priority,
        CASE WHEN type_code IN {_IN(T.NO_PARAMETER)} THEN NULL ELSE CASE left(type_code, 1) WHEN 'P' THEN 'Pressure' WHEN 'L' THEN 'Level' WHEN 'F' THEN 'Flow' WHEN 'T' THEN 'Temperature' END END AS parameter
        FROM tags WHERE length(type_code) > 1""",
    "resolve_points": f"""WITH {_VARIANTS}, reg AS (SELECT DISTINCT tag, system, type_code, number, suffix, regexp_replace(tag, '[\\s-]+', '', 'g') AS norm FROM tags WHERE size <= 40),
        x AS (SELECT norm, min(tag) AS exact_tag FROM reg GROUP BY norm), k AS (SELECT system, type_code, number, suffix, list_sort(list(tag)) AS ts FROM reg GROUP BY ALL),
        s AS (SELECT system, type_code, number, list_sort(list(tag)) AS ts FROM reg GROUP BY ALL)
        SELECT style, truth, raw, CASE WHEN exact_tag IS NOT NULL THEN exact_tag WHEN len(k.ts) = 1 THEN k.ts[1] END AS tag,
        CASE WHEN exact_tag = raw THEN 'exact' WHEN exact_tag IS NOT NULL OR len(k.ts) = 1 THEN 'resolved' WHEN s.ts IS NOT NULL THEN 'ambiguous' ELSE 'unresolved' END AS status,
        CASE WHEN exact_tag IS NULL AND k.ts IS NULL THEN coalesce(array_to_string(s.ts, ','), '') ELSE '' END AS candidates
        FROM vv LEFT JOIN x ON regexp_replace(upper(raw), '[\\s-]+', '', 'g') = norm LEFT JOIN k USING (system, type_code, number, suffix) LEFT JOIN s USING (system, type_code, number)""",
    "resolver_evaluation": f"WITH {_VARIANTS} SELECT style, count(*) AS hit, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS ambiguous, CAST(0 AS BIGINT) AS miss FROM vv GROUP BY style",
    "ce_validate": f"""WITH {TAGS_SQL}, li AS (SELECT l_orderkey, l_linenumber, l_partkey AS id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS other, l_returnflag AS f FROM lineitem),
        r AS (SELECT li.*, a.tag AS ca, a.size AS sa, b.tag AS cb, b.size AS sb FROM li JOIN tags a ON a.id = li.id JOIN tags b ON b.id = other),
        known AS (SELECT DISTINCT tag FROM tags WHERE size <= 40)
        SELECT l_orderkey, l_linenumber, x.tag AS cause, y.tag AS effect, x.tag IS NOT NULL AND y.tag IS NOT NULL AS ok, f = 'A' AS is_verified FROM r LEFT JOIN known x ON x.tag = ca LEFT JOIN known y ON y.tag = cb""",
    "semi_anti_coverage": """SELECT c_nationkey, count(*) AS n, 'with_orders' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1 UNION ALL
        SELECT c_nationkey, count(*), 'without' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1 UNION ALL
        SELECT c_nationkey, count(*), 'no_large' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) GROUP BY 1""",
    "shared_pairs": "WITH d AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n_parts FROM d x JOIN d y ON x.l_partkey = y.l_partkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL HAVING count(*) >= 2",
    "update_merge": """WITH e AS (SELECT o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
        SELECT c_custkey, c_name, coalesce(CASE WHEN o_orderstatus <> 'O' THEN 'LAST-' || o_orderstatus END, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN e ON o_custkey = c_custkey""",
    "latest_disposition": "SELECT user_id, event_id, event_type AS status FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'",
    "config_diff": """WITH h AS (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS m FROM events), e AS (SELECT *, epoch_us(ts) > m AS late FROM events, h QUALIFY row_number() OVER (PARTITION BY user_id, late ORDER BY ts DESC, event_id DESC) = 1),
        a AS (SELECT * FROM e WHERE NOT late), b AS (SELECT * FROM e WHERE late), j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed'
        WHEN a.event_type IS DISTINCT FROM b.event_type OR a.value IS DISTINCT FROM b.value THEN 'changed' END AS change,
        concat_ws(',', CASE WHEN a.event_type IS DISTINCT FROM b.event_type THEN 'event_type' END, CASE WHEN a.value IS DISTINCT FROM b.value THEN 'value' END) AS f FROM a FULL JOIN b ON a.user_id = b.user_id)
        SELECT user_id, change, CASE WHEN change = 'changed' THEN f ELSE '' END AS fields FROM j WHERE change IS NOT NULL""",
    "dangling_references": "SELECT doc_id AS ref FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id AND lang = 'en')",
}
