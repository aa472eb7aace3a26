"""Structured drawing XML: every file is parsed once, in a streaming pass, to a table of elements; all else is relational.

An element row has the nearest ancestor with an ID as its owner, its own XML attributes, its generic attributes, its place
and its connection nodes. Files that do not parse give one row with `error` set instead of stopping the scan.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = (
    "drawing string, seq int, element string, id string, owner_id string, owner_element string, attributes map<string,string>, "
    "generic map<string,string>, x double, y double, n_points int, point_types array<string>, error string"
)
# Element names and the category of the item they describe.
ITEM_CATEGORIES = {
    "ProcessInstrumentationFunction": "instrument",
    "InstrumentationLoopFunction": "instrument_loop",
    "ProcessSignalGeneratingFunction": "signal_generator",
    "ActuatingFunction": "actuating_function",
    "ActuatingSystem": "actuating_system",
    "ActuatingSystemComponent": "actuator",
    "PipingComponent": "piping_component",
    "PipingNetworkSegment": "piping_segment",
    "PipingNetworkSystem": "piping_system",
    "Equipment": "equipment",
    "Nozzle": "nozzle",
    "PipeOffPageConnector": "pipe_off_page",
    "SignalOffPageConnector": "signal_off_page",
}
CONNECTION_KINDS = {"InformationFlow": "signal", "PipingNetworkSegment": "process"}


def parse_elements(drawing: str, content: bytes) -> list[dict]:
    """Element rows of one file, in document order; generic attributes go to the element they stand directly under."""
    rows: list[dict] = []
    stack: list[dict] = []
    try:
        for event, el in ElementTree.iterparse(io.BytesIO(content), events=("start", "end")):
            if event == "start":
                owner = next((r for r in reversed(stack) if r["id"]), None)
                row = {"drawing": drawing, "seq": len(rows), "element": el.tag.rpartition("}")[2], "id": el.get("ID"), "owner_id": owner and owner["id"], "owner_element": owner and owner["element"],
                       "attributes": dict(el.attrib), "generic": {}, "x": None, "y": None, "n_points": 0, "point_types": [], "error": None}
                above = [r["element"] for r in stack[-2:]]
                target = stack[-2] if len(stack) >= 2 else None
                if row["element"] == "GenericAttribute" and above[-1:] == ["GenericAttributes"] and target and el.get("Name") and el.get("Value") is not None:
                    target["generic"][el.get("Name")] = el.get("Value")
                elif row["element"] == "Location" and above[-1:] == ["Position"] and target and target["x"] is None:
                    try:
                        target["x"], target["y"] = float(el.get("X", "")), float(el.get("Y", ""))
                    except ValueError:
                        pass
                elif row["element"] == "Node" and above[-1:] == ["ConnectionPoints"] and target:
                    target["n_points"] += 1
                    target["point_types"].append(el.get("Type") or "")
                rows.append(row)
                stack.append(row)
            else:
                stack.pop()
                el.clear()
    except ElementTree.ParseError as bad:
        empty = dict.fromkeys(("element", "id", "owner_id", "owner_element", "x", "y"))
        return [{"drawing": drawing, "seq": 0, **empty, "attributes": {}, "generic": {}, "n_points": 0, "point_types": [], "error": str(bad)}]
    return rows


def stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rpartition("/")[2])


def elements(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """All elements of the XML files under a path."""
    return elements_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content"))


def elements_of(files: DataFrame) -> DataFrame:
    """Files (path, content) -> element rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(parse_elements(stem(path), bytes(content)))

    return files.mapInPandas(run, ELEMENTS)


def tags(e: DataFrame) -> DataFrame:
    """drawing, id, category, component_class, tag_name, x_mm, y_mm: one row for each item ID, the first in the document."""
    table = F.create_map(*[F.lit(v) for kv in ITEM_CATEGORIES.items() for v in kv])
    t = e.filter(F.col("element").isin(list(ITEM_CATEGORIES)))
    name = F.coalesce(*[F.when(F.col("generic")[k] != "", F.col("generic")[k]) for k in ("tagName", "valveTag", "TagNameAssignmentClass")], F.col("attributes")["TagName"])
    row = F.struct("seq", F.element_at(table, F.col("element")).alias("category"), F.coalesce(F.col("attributes")["ComponentClass"], "element").alias("component_class"), name.alias("tag_name"), F.col("x").alias("x_mm"), F.col("y").alias("y_mm"))
    return t.groupBy("drawing", "id").agg(F.min(row).alias("r")).select("drawing", "id", "r.category", "r.component_class", "r.tag_name", "r.x_mm", "r.y_mm")


def connections(e: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(v) for kv in CONNECTION_KINDS.items() for v in kv])
    a = F.col("attributes")
    c = e.filter("element = 'Connection'")
    return c.select("drawing", "owner_id", F.coalesce(F.element_at(table, F.coalesce("owner_element", F.lit(""))), "owner_element").alias("kind"), a["FromID"].alias("from_id"), a["FromNode"].alias("from_node"), a["ToID"].alias("to_id"), a["ToNode"].alias("to_node"))


def associations(e: DataFrame) -> DataFrame:
    a = F.col("attributes")
    return e.filter("element = 'Association'").select("drawing", F.col("owner_id").alias("source_id"), a["Type"].alias("assoc_type"), a["ItemID"].alias("target_id"))


def items(e: DataFrame) -> DataFrame:
    """Plant items with their open attribute map and the partN map."""
    t = e.filter(F.col("element").isin(list(ITEM_CATEGORIES)))
    tag = F.coalesce(*[F.when(c != "", c) for c in (F.col("attributes")["TagName"], F.col("generic")["tagName"], F.col("generic")["valveTag"])])
    parts = F.map_filter("generic", lambda k, v: k.rlike(r"^part\d+$"))
    return t.select("drawing", "element", F.coalesce("id", F.lit("")).alias("item_id"), F.col("attributes")["ComponentClass"].alias("component_class"), F.col("attributes")["ComponentClassURI"].alias("class_uri"), tag.alias("tag"), F.col("generic").alias("attributes"), parts.alias("parts"), F.col("n_points").alias("n_connection_points"), F.col("point_types").alias("connection_types"))


def truth_tags(e: DataFrame, names: tuple[str, ...] = ("tagName", "valveTag", "TagNameAssignmentClass")) -> DataFrame:
    """drawing, tag, is_pipe: names with a quote are pipes; others need a digit and must not begin with 'empty'."""
    values = F.concat(F.array(F.col("attributes")["TagName"]), *[F.array(F.col("generic")[n]) for n in names])
    t = e.select("drawing", F.explode(values).alias("v"), F.lit(False).alias("line")).unionByName(e.select("drawing", F.col("generic")["PipelineTag"].alias("v"), F.lit(True).alias("line")))
    t = t.select("drawing", F.trim("v").alias("tag"), (F.col("line") | F.col("v").contains('"')).alias("is_pipe")).filter("tag <> ''")
    return t.filter(F.col("is_pipe") | (F.col("tag").rlike(r"\d") & ~F.lower("tag").startswith("empty"))).distinct()


def component_list(e: DataFrame, names: tuple[str, ...] = ("FluidCode", "NominalDiameter"), most: int = 50) -> DataFrame:
    """Items with attributes inherited, where they lack their own, from the nearest owner that has them, however far up.

    Each round takes values from the owners and moves on to theirs, and doubles the way that is looked back.
    """
    from tagloom.operators.durable import cut

    i = cut(e.filter("id IS NOT NULL").select("drawing", "id", F.col("owner_id").alias("up"), "element", *[F.col("generic")[n].alias(n) for n in names]).dropDuplicates(["drawing", "id"]))
    for _ in range(most):
        over = i.select("drawing", F.col("id").alias("up"), F.col("up").alias("_up"), *[F.col(n).alias(f"_{n}") for n in names])
        i = cut(i.join(over, ["drawing", "up"], "left").select("drawing", "id", F.col("_up").alias("up"), "element", *[F.coalesce(n, f"_{n}").alias(n) for n in names]))
        if i.filter("up IS NOT NULL").isEmpty():
            return i.drop("up")
    raise RuntimeError(f"owners more than 2**{most} deep")
