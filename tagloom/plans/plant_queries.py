"""Merged plants, stitches and phrases over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.operators import graph as G
from tagloom.operators import plant
from tagloom.plans.shapes import read


def _sheets(spark, d):
    """Suppliers' nations as drawings, parts as tags, and lines of one order as edges."""
    li, s = read(spark, d, "lineitem"), read(spark, d, "supplier")
    x = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", F.col("s_nationkey").alias("drawing"), F.col("l_partkey").alias("tag"), F.col("l_returnflag").alias("flag"))
    return x


def plant_vertices(spark, d):
    v, _, bridge = plant.merge_drawings(_sheets(spark, d).select("drawing", "tag", "flag"), _edges(spark, d))
    n = bridge.groupBy("tag").agg(F.count("*").alias("n_drawings"))
    return v.join(n, "tag")


def _edges(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("drawing", "l_orderkey").orderBy("l_linenumber", "tag")
    e = _sheets(spark, d).select("drawing", F.col("tag").alias("src"), F.lead("tag").over(w).alias("dst"), F.col("flag").alias("kind"))
    return e.filter("dst IS NOT NULL AND src <> dst")


def plant_edges(spark, d):
    return plant.merge_drawings(_sheets(spark, d).select("drawing", "tag", "flag"), _edges(spark, d))[1]


def plant_stitches(spark, d):
    """Tags of different drawings in one order, joined both ways; how often stitches take the place of an edge."""
    s = plant.stitches(_sheets(spark, d).select(F.col("l_orderkey").alias("line"), "drawing", "tag"))
    return s.groupBy("src").agg(F.countDistinct("dst").alias("n_tags"), F.countDistinct("line").alias("n_lines"))


def plant_criticality(spark, d):
    edges = plant_edges(spark, d).select("src", "dst", "kind")
    cross = plant.stitches(_sheets(spark, d).select(F.col("l_orderkey").alias("line"), "drawing", "tag"))
    return plant.criticality(plant.stitched(edges, cross))


def descriptive_phrases(spark, d):
    lines = read(spark, d, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(X.is_descriptive(F.col("line"))).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("line").alias("n_distinct"))


def failure_closure(spark, d):
    """How many tags each failing tag of size 1 reaches along merged edges, by least number of steps."""
    edges = plant_edges(spark, d).select("src", "dst")
    seeds = read(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("seed"))
    return G.reach_counts(edges, seeds)


QUERIES = {f.__name__: f for f in (plant_vertices, plant_edges, plant_stitches, plant_criticality, descriptive_phrases, failure_closure)}
_S = """sh AS (SELECT l_orderkey, l_linenumber, s_nationkey AS drawing, l_partkey AS tag, l_returnflag AS flag FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
  ed AS (SELECT * FROM (SELECT drawing, tag AS src, lead(tag) OVER (PARTITION BY drawing, l_orderkey ORDER BY l_linenumber, tag) AS dst, flag AS kind FROM sh) WHERE dst IS NOT NULL AND src <> dst),
  me AS (SELECT src, dst, max({'d': drawing, 'k': kind}) AS m FROM ed GROUP BY 1, 2),
  st AS (SELECT DISTINCT a.tag AS src, b.tag AS dst, a.l_orderkey AS line FROM sh a JOIN sh b ON a.l_orderkey = b.l_orderkey AND a.drawing <> b.drawing AND a.tag <> b.tag)"""
ORACLES = {
    "plant_vertices": f"WITH {_S} SELECT tag, min({{'d': drawing, 'f': flag}}).f AS flag, count(DISTINCT drawing) AS n_drawings FROM sh GROUP BY tag",
    "plant_edges": f"WITH {_S} SELECT src, dst, m.d AS drawing, m.k AS kind FROM me",
    "plant_stitches": f"WITH {_S} SELECT src, count(DISTINCT dst) AS n_tags, count(DISTINCT line) AS n_lines FROM st GROUP BY 1",
    "plant_criticality": f"WITH {_S}, k AS (SELECT src, dst FROM me WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.src = me.src AND st.dst = me.dst)) SELECT node, count(*) AS degree FROM (SELECT src AS node FROM k UNION ALL SELECT dst FROM k) GROUP BY 1",
    "descriptive_phrases": r"""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT *, regexp_replace(trim(line, ' '), '[.:;,]+$', '') AS q FROM l)
        SELECT lang, count(*) AS n, count(DISTINCT line) AS n_distinct FROM p WHERE length(q) BETWEEN 4 AND 40 AND length(regexp_replace(q, '[^\p{L}]', '', 'g')) >= 4 AND regexp_full_match(q, '[A-Za-z0-9 &()\-/.,'']+') AND regexp_matches(q, '[A-Za-z]{3,}') GROUP BY 1""",
    "failure_closure": f"WITH RECURSIVE {_S}, e AS (SELECT src, dst FROM me), r AS (SELECT p_partkey AS seed, dst AS node, 1 AS depth FROM part JOIN e ON src = p_partkey WHERE p_size = 1 UNION SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src WHERE r.depth < 30), m AS (SELECT seed, node, min(depth) AS depth FROM r WHERE seed <> node GROUP BY 1, 2) SELECT seed, count(*) AS n, CAST(max(depth) AS INT) AS deepest FROM m GROUP BY 1",
}
