"""A plant of many drawings: merged vertices and edges, stitched lines, questions over the graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.tags import SAFETY_TYPES
from tagloom.operators import graph


def merge_drawings(objects: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects (drawing, tag, ...) and edges (drawing, src, dst, kind) of all sheets -> vertices, edges, bridge (tag, drawing).

    A tag is one vertex, with what its first drawing says; of repeated edges the last drawing's kind stays.
    """
    rest = [c for c in objects.columns if c not in ("drawing", "tag")]
    vertices = objects.groupBy("tag").agg(F.min(F.struct("drawing", *rest)).alias("o")).select("tag", *[F.col(f"o.{c}").alias(c) for c in rest])
    merged = edges.groupBy("src", "dst").agg(F.max(F.struct("drawing", "kind")).alias("e")).select("src", "dst", "e.drawing", "e.kind")
    return vertices, merged, objects.select("tag", "drawing").distinct()


def stitches(anchors: DataFrame) -> DataFrame:
    """Anchors (line, drawing, tag) -> src, dst, line both ways between tags of different drawings on one line."""
    a, b = anchors.select("line", F.col("drawing").alias("d1"), F.col("tag").alias("src")), anchors.select("line", F.col("drawing").alias("d2"), F.col("tag").alias("dst"))
    return a.join(b, "line").filter("d1 <> d2 AND src <> dst").select("src", "dst", "line").distinct()


def stitched(edges: DataFrame, cross: DataFrame) -> DataFrame:
    """Edges with the stitches put in; a stitch takes the place of an in-drawing edge between the same tags."""
    s = cross.groupBy("src", "dst").agg(F.min("line").alias("line")).withColumn("kind", F.lit("cross"))
    return edges.join(s.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(s, allowMissingColumns=True)


def line_anchors(edges: DataFrame, segments: DataFrame, tagged: DataFrame, hops: int = 4, most: int = 3) -> DataFrame:
    """line, tag: the nearest tagged nodes (at most three, within four undirected steps) of a line's segments; walks stop there."""
    from pyspark.sql import Window

    e = graph.undirected(edges)
    marks = tagged.select("node").distinct()
    frontier = segments.select("line", F.col("segment").alias("node")).distinct()
    seen, found = frontier, None
    for depth in range(1, hops + 1):
        step = frontier.join(e, frontier["node"] == e["src"]).select("line", F.col("dst").alias("node")).distinct().join(seen, ["line", "node"], "left_anti")
        step = graph.cut(step)
        hit = step.join(marks, "node", "left_semi").select("line", F.col("node").alias("tag"), F.lit(depth).alias("depth"))
        found = hit if found is None else found.unionByName(hit)
        seen, frontier = graph.cut(seen.unionByName(step)), step.join(marks, "node", "left_anti").select("line", "node")
    place = F.row_number().over(Window.partitionBy("line").orderBy("depth", "tag"))
    return found.withColumn("_p", place).filter(F.col("_p") <= most).select("line", "tag")


def criticality(edges: DataFrame) -> DataFrame:
    """node, degree over edges that are no stitches."""
    return graph.degrees(edges.filter("kind <> 'cross'")).select("node", "degree")


@dataclass
class Query:
    """A question, understood: what to do, for which tags, types and systems."""

    intent: str
    tags: list[str]
    types: list[str]


def answer(query: Query, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """tag, fact: the rows an intent asks for; ValueError for an intent that is none. vertices: tag, type_code, loop."""
    spark = vertices.sparkSession
    asked = spark.createDataFrame([(t,) for t in query.tags], "seed string")
    named = vertices.select(F.col("tag").alias("node"), "type_code", "loop")

    def facts(df: DataFrame, node: str, fact) -> DataFrame:
        return df.select(F.col(node).alias("tag"), fact.cast("string").alias("fact"))

    if query.intent == "downstream":
        return facts(graph.closure(edges, asked), "node", F.col("depth"))
    if query.intent == "upstream":
        return facts(graph.ancestors(edges, asked), "node", F.col("depth"))
    if query.intent == "path":
        pair = spark.createDataFrame([(query.tags[0], query.tags[-1])], "src string, dst string")
        found = graph.shortest_paths(graph.undirected(edges), pair)
        return found.select(F.posexplode("path").alias("fact", "tag")).select("tag", F.col("fact").cast("string").alias("fact"))
    if query.intent == "protects":
        near = graph.ancestors(edges, asked).select("node").unionByName(graph.closure(edges, asked).select("node")).distinct()
        return facts(named.join(near, "node", "left_semi").filter(F.col("type_code").isin(SAFETY_TYPES)), "node", F.col("type_code"))
    if query.intent == "trips_closing":
        return facts(named.join(graph.ancestors(edges, asked).select("node").distinct(), "node", "left_semi").filter(F.col("type_code").rlike("S(HH|LL|H|L)$")), "node", F.col("type_code"))
    if query.intent in ("loop", "section"):
        return facts(named.join(named.join(asked, named["node"] == asked["seed"]).select("loop").distinct(), "loop", "left_semi"), "node", F.col("loop"))
    if query.intent == "list_type":
        return facts(named.filter(F.col("type_code").isin(query.types)), "node", F.col("type_code"))
    if query.intent != "neighbors":
        raise ValueError(f"no such intent: {query.intent}")
    around = graph.undirected(edges)
    return facts(around.join(asked, around["src"] == asked["seed"]).select(F.col("dst").alias("node")).distinct(), "node", F.lit("neighbour"))
