"""Rules, worksheets, spatial joins, similarity and search over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import tags as T
from tagloom.operators import graph as G
from tagloom.operators import rules as R
from tagloom.operators import similarity as S
from tagloom.operators import spatial as P
from tagloom.operators import worksheet as W
from tagloom.plans.graph_queries import _LOOPS, _loops
from tagloom.plans.shapes import TAGS_SQL, plant_tags, read


def _shown(df):
    return df.select("rule", "severity", "section", F.array_join("tags", ",").alias("tags"))


def _objects(spark, d):
    """The plant's tags, untyped equipment for those of size 50, and those of size 49 again with a zero before the number."""
    t = plant_tags(spark, d)
    bare = t.filter("size = 50").select("id", *[F.lit("").alias(c) for c in ("system", "type_code", "number", "suffix")], "size", F.concat(F.lit("EQ-"), F.col("id").cast("string")).alias("tag"))
    again = t.filter("size = 49").withColumn("number", F.concat(F.lit("0"), F.col("number"))).withColumn("tag", F.concat("system", F.lit("-"), "type_code", "number", "suffix"))
    bare, again = bare.withColumn("loop", F.col("tag")), again.withColumn("loop", F.concat_ws("-", "system", "number"))
    return t.unionByName(bare).unionByName(again)


_OBJECTS = """obj AS (SELECT id, system, type_code, number, suffix, size, tag, loop FROM tags UNION ALL
  SELECT id, '', '', '', '', size, 'EQ-' || id, 'EQ-' || id FROM tags WHERE size = 50 UNION ALL
  SELECT id, system, type_code, '0' || number, suffix, size, system || '-' || type_code || '0' || number || suffix, system || '-0' || number FROM tags WHERE size = 49)"""
_SHOWN = "array_to_string(list_sort(list(DISTINCT tag))[1:8], ',')"


def rule_findings(spark, d):
    """R1, R2, R3, R8, R9, R13, R14, R15 and R16, loops as sections and loop order as the graph, which lacks lone tags."""
    t, edges = _objects(spark, d), _loops(spark, d)
    reach = G.cut(G.closure(edges, t.select(F.col("tag").alias("seed"))).select("seed", "node"))
    vertices = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    found = R.screen_sections(t).unionByName(R.screen_paths(t, reach, vertices)).unionByName(R.screen_loops(t)).unionByName(R.screen_controllers(t, reach)).unionByName(R.screen_tags(t))
    return _shown(R.dedupe(found))


def rule_coverage(spark, d):
    """R4 to R7: tags of size up to 30 stand on the second register."""
    t = plant_tags(spark, d)
    return _shown(R.screen_coverage(t, t.filter("size <= 30"), T.categorise(F.col("type_code"))))


def rule_cause_effect(spark, d):
    """R10 to R12: loop neighbours of size up to 30 as cause and effect rows, tags of size over 45 unknown."""
    t = plant_tags(spark, d)
    ce = _loops(spark, d).select(F.col("src").alias("cause_tag"), F.col("dst").alias("effect_tag"))
    return _shown(R.screen_cause_effect(t.filter("size <= 45"), ce))


def worksheet_expand(spark, d):
    return W.build(plant_tags(spark, d))


def worksheet_guarded(spark, d):
    return W.guarded_share(W.build(plant_tags(spark, d)))


def _points(spark, d):
    """Parts on a sheet for each brand: x by price, y by key."""
    p = read(spark, d, "part")
    return p.select("p_brand", "p_partkey", F.col("p_retailprice").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"), F.col("p_size").alias("size"))


def nearest_in_window(spark, d):
    p = _points(spark, d)
    a = p.filter("size <= 10").select("p_brand", F.col("p_partkey").alias("key"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    b = p.filter("size > 10").select("p_brand", F.col("p_partkey").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return P.nearest_in_window(a, b, ["p_brand"], "key", "other", (160.0, 50.0))


def nearest_in_radius(spark, d):
    p = _points(spark, d)
    a = p.filter("size <= 10").select("p_brand", F.col("p_partkey").alias("key"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    b = p.filter("size > 10").select("p_brand", F.col("p_partkey").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return P.nearest_in_radius(a, b, ["p_brand"], "key", "other", 25.0)


def radius_count(spark, d):
    return P.radius_count(_points(spark, d), ["p_brand"], "p_partkey", "x", "y", 30.0)


def spatial_anti(spark, d):
    p = _points(spark, d)
    a = p.filter("size <= 10").select("p_brand", F.col("p_partkey").alias("key"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    b = p.filter("size > 10").select("p_brand", F.col("x").alias("rx"), F.col("y").alias("ry"))
    return P.without_near(a, b, ["p_brand"], "key", 20.0)


def greedy_match(spark, d):
    p = _points(spark, d)
    t = p.filter("size <= 10").select("p_brand", F.col("p_partkey").alias("t"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    f = p.filter("size > 40").select("p_brand", F.col("p_partkey").alias("f"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    return P.greedy_match(t, f, ["p_brand"], 60.0)


def suppression(spark, d):
    p = _points(spark, d)
    b = p.select("p_brand", F.col("p_partkey").alias("id"), (F.col("size") / 50.0).alias("conf"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 30).alias("x1"), (F.col("y") + 30).alias("y1"))
    return P.suppress(b, ["p_brand"]).select("p_brand", "id")


def packing(spark, d):
    return P.pack(read(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("size")), "p_brand", "p_partkey", "size", 200.0).select("p_partkey", "pack")


def cosine_neighbours(spark, d):
    """The three most similar vectors of each, within its label."""
    return S.nearest(read(spark, d, "embeddings"), "label", "vec_id", "embedding", 3).select("key", "other", "place")


def similarity_groups(spark, d):
    v = read(spark, d, "embeddings")
    return S.linkage_groups(S.links(v, "label", "vec_id", "embedding", 0.5), v.select("vec_id"))


def composition_distance(spark, d):
    """Suppliers by the brand and type of all their lines."""
    return S.composition_distance(read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("pattern", F.concat_ws("/", "p_brand", "p_type")), "l_suppkey", "pattern")


def ranked_search(spark, d):
    docs = read(spark, d, "documents")
    index = docs.select(F.col("doc_id").alias("stem"), F.col("source").alias("system"), F.substring_index("text", "\n", 1).alias("summary"), F.split(F.lower("text"), r"[^a-z]+").alias("words"), F.array("source", "lang").alias("tags"))
    return S.search(index, ["the", "license", "src1"], "src7")


QUERIES = {f.__name__: f for f in (rule_findings, rule_coverage, rule_cause_effect, worksheet_expand, worksheet_guarded, nearest_in_window, nearest_in_radius, radius_count, spatial_anti, greedy_match, suppression, packing, cosine_neighbours, similarity_groups, composition_distance, ranked_search)}

_IN = lambda xs: "('" + "','".join(xs) + "')"
_CAT = "CASE " + " ".join(f"WHEN type_code IN {_IN(v)} THEN '{k}'" for k, v in T.CATEGORIES.items()) + " ELSE 'other' END"
_AGG = "string_agg(DISTINCT tag, ',' ORDER BY tag)"
_PTS = "pts AS (SELECT p_brand, p_partkey, p_retailprice AS x, CAST(p_partkey % 97 AS DOUBLE) AS y, p_size AS size FROM part), a AS (SELECT * FROM pts WHERE size <= 10), b AS (SELECT * FROM pts WHERE size > 10)"
_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_PARAM = f"CASE WHEN type_code IN {_IN(T.NO_PARAMETER)} THEN NULL ELSE CASE left(type_code, 1) WHEN 'P' THEN 'Pressure' WHEN 'L' THEN 'Level' WHEN 'F' THEN 'Flow' WHEN 'T' THEN 'Temperature' END END"
_WS = f"""{TAGS_SQL}, o AS (SELECT *, {_CAT} AS category, {_PARAM} AS parameter FROM tags WHERE loop IN (SELECT loop FROM tags GROUP BY loop HAVING count(*) >= 2)),
  dev AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{x}')" for p, xs in W.DEVIATIONS.items() for x in xs)}) v(parameter, deviation)),
  guard AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{x}')" for p, xs in W.SAFEGUARDS.items() for x in xs)}) v(deviation, type_code)),
  mode AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{x}')" for p, xs in W.FAILURE_MODES.items() for x in xs)}) v(type_code, mode)),
  pn AS (SELECT DISTINCT loop, parameter FROM o WHERE parameter IS NOT NULL UNION SELECT loop, 'Flow' FROM o GROUP BY loop HAVING max(parameter) IS NULL),
  w AS (SELECT pn.loop, pn.parameter, deviation,
    coalesce((SELECT string_agg(o.tag || ': ' || mode, '; ' ORDER BY o.tag || ': ' || mode) FROM o JOIN mode USING (type_code) WHERE o.loop = pn.loop AND category IN ('logic', 'output') AND o.type_code NOT IN {_IN(T.SAFETY_TYPES)}), '') AS causes,
    coalesce((SELECT string_agg(DISTINCT o.tag, ', ' ORDER BY o.tag) FROM o WHERE o.loop = pn.loop AND category IN ('logic', 'output')), '') AS consequences,
    coalesce((SELECT string_agg(DISTINCT o.tag, ', ' ORDER BY o.tag) FROM o JOIN guard g ON g.type_code = o.type_code WHERE o.loop = pn.loop AND g.deviation = dev.deviation), '') AS safeguards
    FROM pn JOIN dev ON pn.parameter = dev.parameter)"""
_COS = "p AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id)"
ORACLES = {
    "rule_findings": f"""WITH RECURSIVE {_LOOPS}, {_OBJECTS}, reach AS (SELECT src AS seed, dst AS node FROM loops UNION SELECT r.seed, l.dst FROM reach r JOIN loops l ON r.node = l.src),
        s AS (SELECT loop, count(*) AS n, {_AGG} FILTER (type_code IN {_IN(R.PRESSURE)}) AS p, {_AGG} FILTER (type_code IN {_IN(R.RELIEF)}) AS r, {_AGG} FILTER (type_code IN {_IN(R.PRESSURE_MEASURED)}) AS m, {_AGG} AS al,
          count(*) FILTER (type_code IN {_IN(R.FINAL)}) AS f, count(*) FILTER (type_code IN {_IN(R.POSITION)}) AS pos FROM obj GROUP BY loop),
        typed AS (SELECT * FROM obj WHERE type_code <> '' AND number <> ''), ctrl AS (SELECT * FROM obj WHERE regexp_full_match(type_code, '[A-Z]{{1,3}}IC') AND loop IN (SELECT loop FROM s WHERE f = 0)),
        served AS (SELECT ctrl.loop FROM ctrl JOIN reach ON seed = ctrl.tag JOIN obj o ON o.tag = node WHERE o.type_code IN {_IN(R.FINAL)}),
        lonely AS (SELECT system || '-' || type_code || number || min(suffix) AS tag FROM typed GROUP BY system, type_code, number HAVING count(DISTINCT suffix) = 1 AND min(suffix) IN {_IN(R.LEGS)}),
        same AS (SELECT unnest(list(DISTINCT tag)) AS tag FROM typed GROUP BY system, type_code, CAST(number AS INT), suffix HAVING count(DISTINCT tag) > 1)
        SELECT 'R1' AS rule, 'high' AS severity, loop AS section, p AS tags FROM s WHERE p IS NOT NULL AND r IS NULL UNION ALL
        SELECT 'R3', 'low', loop, al FROM s WHERE n >= 4 AND p IS NULL AND r IS NULL UNION ALL
        SELECT 'R13', 'medium', loop, r FROM s WHERE r IS NOT NULL AND m IS NULL UNION ALL
        SELECT DISTINCT 'R2', 'high', '', tag FROM obj WHERE type_code IN {_IN(R.TRIPS)} AND tag IN (SELECT src FROM loops UNION SELECT dst FROM loops) AND tag NOT IN (SELECT seed FROM reach JOIN obj ON node = tag WHERE type_code IN {_IN(R.ACTIONS)}) UNION ALL
        SELECT DISTINCT 'R8', 'medium', loop, tag FROM obj JOIN s USING (loop) WHERE type_code IN {_IN(R.ON_OFF)} AND pos = 0 UNION ALL
        SELECT 'R9', 'low', loop, min(tag) FROM obj WHERE type_code IN {_IN(R.TRIPS)} GROUP BY loop, type_code HAVING count(*) < 2 UNION ALL
        SELECT 'R14', 'medium', '{R.LOOPS}', {_SHOWN} FROM ctrl WHERE loop NOT IN (SELECT loop FROM served) HAVING count(*) > 0 UNION ALL
        SELECT 'R15', 'low', '{R.REDUNDANCY}', {_SHOWN} FROM lonely HAVING count(*) > 0 UNION ALL
        SELECT 'R16', 'medium', '{R.SPELLING}', {_SHOWN} FROM same HAVING count(*) > 0""",
    "rule_coverage": f"""WITH {TAGS_SQL}, m AS (SELECT *, {_CAT} AS category FROM tags WHERE tag NOT IN (SELECT tag FROM tags WHERE size <= 30)),
        k AS (SELECT 'R4' AS rule, tag FROM m WHERE category = 'input' AND type_code NOT IN {_IN(R.LOCAL_ONLY)} UNION ALL SELECT 'R5', tag FROM m WHERE type_code IN {_IN(R.ACTUATED)} UNION ALL
        SELECT 'R6', tag FROM m WHERE type_code IN {_IN(R.SHUTDOWN_FUNCTIONS)} UNION ALL SELECT 'R7', tag FROM m WHERE regexp_full_match(type_code, '[A-Z]{{1,3}}IC'))
        SELECT rule, 'medium' AS severity, '{R.COVERAGE}' AS section, {_SHOWN} AS tags FROM k GROUP BY rule""",
    "rule_cause_effect": f"""WITH {_LOOPS}, o AS (SELECT * FROM tags WHERE size <= 45) SELECT 'R10' AS rule, 'high' AS severity, 'c&e' AS section, tag AS tags FROM o WHERE type_code IN {_IN(R.ON_OFF)} AND tag NOT IN (SELECT dst FROM loops) UNION ALL
        SELECT 'R11', 'high', 'c&e', tag FROM o WHERE type_code IN {_IN(R.TRIPS)} AND tag NOT IN (SELECT src FROM loops) UNION ALL
        SELECT 'R12', 'medium', 'c&e', t FROM (SELECT src AS t FROM loops UNION SELECT dst FROM loops) WHERE t NOT IN (SELECT tag FROM o)""",
    "worksheet_expand": f"WITH {_WS} SELECT loop, parameter, deviation, causes, consequences, safeguards FROM w",
    "worksheet_guarded": f"WITH {_WS} SELECT count(*) AS n, count(*) FILTER (safeguards <> '') AS guarded, round(100.0 * count(*) FILTER (safeguards <> '') / count(*), 1) AS pct FROM w",
    "nearest_in_window": f"WITH {_PTS} SELECT a.p_brand, a.p_partkey AS key, b.p_partkey AS other, abs(a.y - b.y) AS dy FROM a JOIN b ON a.p_brand = b.p_brand AND abs(a.x - b.x) < 160 AND abs(a.y - b.y) < 50 QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.y - b.y), b.p_partkey) = 1",
    "nearest_in_radius": f"WITH {_PTS}, n AS (SELECT a.p_partkey AS key, b.p_partkey AS other FROM a JOIN b ON a.p_brand = b.p_brand AND {_D2} <= 625 QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY {_D2}, b.p_partkey) = 1) SELECT p_brand, p_partkey AS key, other FROM a LEFT JOIN n ON key = p_partkey",
    "radius_count": "WITH pts AS (SELECT p_brand, p_partkey, p_retailprice AS x, CAST(p_partkey % 97 AS DOUBLE) AS y FROM part) SELECT a.p_brand, a.p_partkey, count(b.p_partkey) AS n FROM pts a LEFT JOIN pts b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900 GROUP BY 1, 2",
    "spatial_anti": f"WITH {_PTS} SELECT p_brand, p_partkey AS key FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.p_brand = b.p_brand AND {_D2} <= 400)",
    "cosine_neighbours": f"WITH {_COS}, q AS (SELECT a AS key, b AS other, cosine FROM p UNION ALL SELECT b, a, cosine FROM p) SELECT key, other, CAST(row_number() OVER (PARTITION BY key ORDER BY cosine DESC, other) AS INT) AS place FROM q QUALIFY place <= 3",
    "similarity_groups": f"WITH RECURSIVE {_COS}, e AS (SELECT a, b FROM p WHERE cosine >= 0.5 UNION SELECT b, a FROM p WHERE cosine >= 0.5), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT a AS key, min(b) AS grp FROM r GROUP BY a) SELECT key, grp AS group, count(*) OVER (PARTITION BY grp) AS size FROM g",
    "composition_distance": """WITH i AS (SELECT l_suppkey AS o, p_brand || '/' || p_type AS pt, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), n AS (SELECT o, sum(c) AS n FROM i GROUP BY 1)
        SELECT x.o AS a, y.o AS b, round(1 - sum(least(x.c, y.c)) / greatest(max(nx.n), max(ny.n)), 6) AS distance FROM i x JOIN i y ON x.pt = y.pt AND x.o < y.o JOIN n nx ON nx.o = x.o JOIN n ny ON ny.o = y.o GROUP BY 1, 2""",
    "ranked_search": r"""WITH d AS (SELECT doc_id, source, lang, lower(split_part(text, chr(10), 1)) AS s, regexp_split_to_array(lower(text), '[^a-z]+') AS w FROM documents),
        t AS (SELECT doc_id, source, sum(CASE WHEN contains(s, term) THEN 3 WHEN list_contains(w, term) THEN 2 WHEN contains(source, term) OR contains(lang, term) THEN 1 ELSE 0 END) AS v FROM d, (VALUES ('the'), ('license'), ('src1')) q(term) GROUP BY 1, 2)
        SELECT doc_id AS stem, CAST(v + CASE WHEN source = 'src7' THEN 2 ELSE 0 END AS INT) AS score FROM t WHERE v + CASE WHEN source = 'src7' THEN 2 ELSE 0 END > 0""",
}
