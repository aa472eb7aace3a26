"""Files by name and content: inventories, drawing discovery and pairing, CSV and JSON scans, binary drawing formats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.tags import discipline_of_file

# What is no tag source.
SKIP_PARTS = ["scd legend", "symbols", "processed", "legend"]
SKIP_NAMES = ["license", "licence"]


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, name, folder, suffix, stem, size: metadata only, contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return described(f)


def described(files: DataFrame) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return files.select("path", name.alias("name"), F.element_at(F.split("path", "/"), -2).alias("folder"), suffix.alias("suffix"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), F.round(F.col("length") / 1024, 1).alias("size_kb"))


def is_skipped(path: Column, also: tuple[str, ...] = ()) -> Column:
    """Whether a part of the path is reference material (also: more folder names of the site) or the name a licence."""
    parts = F.split(F.lower(path), "/")
    folder = F.exists(parts, lambda p: p.rlike("|".join([*SKIP_PARTS, *also])))
    return folder | F.element_at(parts, -1).rlike("|".join(SKIP_NAMES))


def drawings(files: DataFrame) -> DataFrame:
    """PDF drawings with doc_type (PID, SCD) by discipline token or else folder, and system; one for each path whatever its case."""
    d = files.filter((F.col("suffix") == ".pdf") & ~is_skipped(F.col("path"))).withColumn("d", F.coalesce(discipline_of_file(F.col("stem")), F.lit("")))
    folder = F.lower("path")
    kind = F.when((F.col("d") == "P") | (folder.contains("p&id") & (F.col("d") != "J")), "PID").when((F.col("d") == "J") | folder.contains("scd"), "SCD")
    system = F.regexp_extract("stem", r"(?:^|[ -])H[A-Z](\d{1,3})(?=[ -]|$)", 1)
    d = d.withColumn("doc_type", kind).filter("doc_type IS NOT NULL").withColumn("system", F.when(system == "", "?").otherwise(system))
    return d.groupBy(F.lower("path").alias("key")).agg(F.min(F.struct("path", "name", "doc_type", "system")).alias("f")).select("f.*")


def system_pairs(found: DataFrame) -> DataFrame:
    """system, pid, scd: the first sheet of each kind for systems that have both."""
    first = lambda k: found.filter(F.col("doc_type") == k).groupBy("system").agg(F.min("path").alias(k.lower()))
    return first("PID").join(first("SCD"), "system")


def norm_stem(stem: Column) -> Column:
    return F.regexp_replace(F.lower(stem), "[^a-z0-9]", "")


def pdf_xml_pairs(files: DataFrame) -> DataFrame:
    """xml, pdf for each XML: the first PDF of the same normalised stem, a trailing dgn apart; pdf null where there is none."""
    pdf = files.filter("suffix = '.pdf'").groupBy(norm_stem(F.col("stem")).alias("key")).agg(F.min("path").alias("pdf"))
    x = files.filter("suffix = '.xml'").withColumn("k", norm_stem(F.col("stem"))).withColumn("base", F.regexp_replace("k", "dgn$", ""))
    a, b = pdf.select(F.col("key").alias("base"), F.col("pdf").alias("p1")), pdf.select(F.col("key").alias("k"), F.col("pdf").alias("p2"))
    return x.join(a, "base", "left").join(b, "k", "left").select(F.col("path").alias("xml"), F.coalesce("p1", "p2").alias("pdf"))


def csv_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Delimited text, every field as text; columns the files lack become empty; `file` says where a row is from."""
    raw = spark.read.option("header", "true").option("mode", "PERMISSIVE").option("inferSchema", "false").csv(path)
    have = {c.lower(): c for c in raw.columns}
    return raw.select(*[F.coalesce(F.col(f"`{have[c.lower()]}`"), F.lit("")).alias(c) if c.lower() in have else F.lit("").alias(c) for c in columns], F.col("_metadata.file_path").alias("file"))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def readability(text_chars: Column, images: Column, lines: Column) -> Column:
    return F.when(text_chars > 200, "readable").when((images > 0) & (lines == 0), "raster").otherwise("outlined")


def dgn_version(content: Column) -> Column:
    """V8 for compound files, V7 by element type and words to follow, else unknown."""
    head = F.hex(F.substring(content, 1, 4))
    kind = F.conv(F.substring(head, 3, 2), 16, 10).cast("int") % 128
    words = F.conv(F.concat(F.substring(head, 7, 2), F.substring(head, 5, 2)), 16, 10).cast("int")
    return F.when(head == "D0CF11E0", "V8").when((F.length(head) == 8) & kind.isin(8, 9) & (words > 0) & (words < 32768), "V7").otherwise("unknown")


def binary_strings(files: DataFrame, least: int = 4) -> DataFrame:
    """path, text: runs of printable ASCII, and of the same in UTF-16LE."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        plain, wide = re.compile(rb"[\x20-\x7e]{%d,}" % least), re.compile(rb"(?:[\x20-\x7e]\x00){%d,}" % least)
        for pdf in batches:
            out = [(p, m.decode(code)) for p, c in zip(pdf["path"], pdf["content"]) for r, code in ((plain, "ascii"), (wide, "utf-16-le")) for m in r.findall(bytes(c))]
            yield pd.DataFrame(out, columns=["path", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def dgn_elements(files: DataFrame) -> DataFrame:
    """V7 element headers: path, offset, type, level, words. The type word is followed by the count of 16-bit words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import struct

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                data, at = bytes(content), 0
                while at + 4 <= len(data):
                    head, words = struct.unpack_from("<HH", data, at)
                    if head == 0xFFFF:
                        break
                    out.append((path, at, head >> 8 & 0x7F, head & 0x3F, words))
                    at += 2 * (words + 2)
            yield pd.DataFrame(out, columns=["path", "offset", "type", "level", "words"])

    return files.select("path", "content").mapInPandas(run, "path string, offset long, type int, level int, words int")


def dxf_entities(files: DataFrame) -> DataFrame:
    """path, entity, layer, name, text, x, y of INSERT, ATTRIB and TEXT entities of DXF text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                lines = bytes(content).decode("utf-8", "replace").splitlines()
                now: dict[str, str] = {}
                for code, value in [*zip(lines[::2], lines[1::2]), ("0", "EOF")]:
                    if code.strip() == "0":
                        if now.get("0") in ("INSERT", "ATTRIB", "TEXT"):
                            out.append((path, now["0"], now.get("8"), now.get("2"), now.get("1"), *[float(now[k]) if k in now else None for k in ("10", "20")]))
                        now = {}
                    now.setdefault(code.strip(), value.strip())
            yield pd.DataFrame(out, columns=["path", "entity", "layer", "name", "text", "x", "y"])

    return files.select("path", "content").mapInPandas(run, "path string, entity string, layer string, name string, text string, x double, y double")
