"""Graphs of structured drawings, from the element table of `sources.xml`: containment, membership, flow between tags, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.tags import parse_tag
from tagloom.operators import graph
from tagloom.operators.durable import cut
from tagloom.sources import xml

# Parents that hold things physically, associations that bind, and categories that are no objects.
PHYSICAL = "Equipment ActuatingSystem PipingNetworkSegment PipingNetworkSystem ProcessInstrumentationFunction ActuatingFunction InstrumentationLoopFunction".split()
MEMBERSHIP = [
    "is located in", "is the location of", "is a part of", "is a collection including", "fulfills", "is fulfilled by",
    "is logical start of", "is logical end of", "has logical start", "has logical end",
]
PASSED_THROUGH = "nozzle piping_segment piping_system pipe_off_page signal_off_page".split()


def _id(drawing: str, c: str):
    """IDs are a drawing's own."""
    return F.concat_ws("\u0001", drawing, c)


def objects(e: DataFrame) -> DataFrame:
    """drawing, id, node, tag and its parts, of the tagged items that are objects; number-first tags are typed too."""
    t = xml.tags(e).filter(F.col("tag_name").isNotNull() & ~F.col("category").isin(PASSED_THROUGH))
    return t.select("drawing", "id", _id("drawing", "id").alias("node"), parse_tag(F.col("tag_name"), number_first=True).alias("p")).select("drawing", "id", "node", "p.*")


def containment(e: DataFrame) -> DataFrame:
    """src (parent), dst (child): elements with an ID and the nearest ancestor with one, where that holds things physically."""
    c = e.filter(F.col("id").isNotNull() & F.col("owner_id").isNotNull() & F.col("owner_element").isin(PHYSICAL))
    return c.select(_id("drawing", "owner_id").alias("src"), _id("drawing", "id").alias("dst")).distinct()


def _links(e: DataFrame) -> DataFrame:
    c = xml.connections(e).filter("from_id IS NOT NULL AND to_id IS NOT NULL")
    return c.select(_id("drawing", "from_id").alias("src"), _id("drawing", "to_id").alias("dst"), "kind")


def flow(e: DataFrame) -> DataFrame:
    """Directed edges between IDs: all connections, and containment both ways, since flow goes through an item by its nozzles."""
    held = containment(e)
    return _links(e).select("src", "dst").unionByName(held).unionByName(graph.reverse(held)).distinct()


def membership(e: DataFrame) -> DataFrame:
    """Undirected edges between IDs that belong together: process connections, containment, binding associations; no signals."""
    a = xml.associations(e).filter(F.col("assoc_type").isin(MEMBERSHIP) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    bound = a.select(_id("drawing", "source_id").alias("src"), _id("drawing", "target_id").alias("dst"))
    return graph.undirected(_links(e).filter("kind = 'process'").select("src", "dst").unionByName(containment(e)).unionByName(bound))


def topology(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, drawing, id, element of everything with an ID, and the edges of `flow` with both ends among them."""
    nodes = e.filter("id IS NOT NULL").select(_id("drawing", "id").alias("node"), "drawing", "id", "element").dropDuplicates(["node"])
    return nodes, graph.within(flow(e), nodes)


def tag_edges(e: DataFrame) -> DataFrame:
    """drawing, src, dst between tags: flow with the untagged contracted."""
    o = cut(objects(e).select("node", "drawing", "tag"))
    c = graph.contract(flow(e), o)
    a, b = o.select(F.col("node").alias("src"), "drawing", F.col("tag").alias("_a")), o.select(F.col("node").alias("dst"), F.col("tag").alias("_b"))
    return c.join(a, "src").join(b, "dst").filter("_a <> _b").select("drawing", F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct()


def sections(e: DataFrame) -> DataFrame:
    """drawing, section, tag: objects by the equipment nearest to them along membership (ties to the lesser ID), the equipment's own
    tag among them; what no equipment reaches by connected component, named by its least ID. Sections of two tags or more."""
    o, m = cut(objects(e).select("node", "drawing", "id", "tag")), cut(membership(e))
    t = xml.tags(e).filter("category = 'equipment'")
    name = F.coalesce("tag_name", F.concat("component_class", F.lit(" ("), F.expr("right(id, 4)"), F.lit(")")))
    anchors = cut(t.select(_id("drawing", "id").alias("node"), F.concat(name, F.lit("-section")).alias("section")))
    near = graph.nearest_anchor(m, anchors).select("node", "anchor")
    own = anchors.join(o, "node").select("drawing", "section", "tag")
    reached = near.join(anchors.select(F.col("node").alias("anchor"), "section"), "anchor").join(o, "node").select("drawing", "section", "tag")
    left = cut(o.join(near, "node", "left_anti").join(anchors, "node", "left_anti"))
    comp = graph.components(graph.within(m, left), left.select("node"))
    rest = left.join(comp, "node").select("drawing", F.concat(F.lit("unanchored-"), F.element_at(F.split("component", "\u0001"), -1)).alias("section"), "tag")
    every = cut(own.unionByName(reached).unionByName(rest).distinct())
    large = every.groupBy("drawing", "section").agg(F.count("*").alias("_n")).filter("_n >= 2").select("drawing", "section")
    return every.join(large, ["drawing", "section"], "left_semi")
