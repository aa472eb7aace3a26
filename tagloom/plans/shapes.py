"""Driver tables in the shapes the operators take, and the same shapes as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ["PT", "PIC", "XV", "LSHH", "PSV", "ZS", "TT", "PI", "LIC", "KA", "PSH", "FO"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plant_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as typed tags: id, tag, system, type_code, number, suffix, loop, size. Four neighbours share a loop."""
    k, g = F.col("p_partkey"), F.floor(F.col("p_partkey") / 4)
    leg = F.when(k % 3 == 0, "A").when(k % 3 == 2, "B").otherwise("")
    code = F.element_at(F.array(*[F.lit(t) for t in TYPES]), ((k - F.floor(k / 3)) % len(TYPES) + 1).cast("int"))
    system, number = (10 + g % 17).cast("string"), (1000 + g % 601).cast("string")
    t = read(spark, sf_dir, "part").select(k.alias("id"), system.alias("system"), code.alias("type_code"), number.alias("number"), leg.alias("suffix"), F.col("p_size").alias("size"))
    return t.withColumn("tag", F.concat("system", F.lit("-"), "type_code", "number", "suffix")).withColumn("loop", F.concat_ws("-", "system", "number"))


TAGS_SQL = f"""tags AS (
  SELECT id, system, type_code, number, suffix, size, system || '-' || type_code || number || suffix AS tag, system || '-' || number AS loop FROM (
    SELECT p_partkey AS id, CAST(10 + (p_partkey // 4) % 17 AS VARCHAR) AS system, CAST(1000 + (p_partkey // 4) % 601 AS VARCHAR) AS number, p_size AS size,
      (['{"','".join(TYPES)}'])[CAST((p_partkey - p_partkey // 3) % {len(TYPES)} AS INT) + 1] AS type_code,
      CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 2 THEN 'B' ELSE '' END AS suffix FROM part))"""


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: parts on consecutive lines of an order."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    pairs = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return pairs.filter("src <> dst").distinct()


FLOW_SQL = """flow AS (SELECT DISTINCT src, dst FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE src <> dst)"""


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: region to nation to supplier to part, as R, N, S and P with the key."""
    n, s, li = (read(spark, sf_dir, t) for t in ("nation", "supplier", "lineitem"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = n.select(name("R", "n_regionkey").alias("src"), name("N", "n_nationkey").alias("dst"))
    edges = edges.unionByName(s.select(name("N", "s_nationkey").alias("src"), name("S", "s_suppkey").alias("dst")))
    return edges.unionByName(li.select("l_suppkey", "l_partkey").distinct().select(name("S", "l_suppkey").alias("src"), name("P", "l_partkey").alias("dst")))


CONTAINMENT_SQL = """edges AS (
  SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION ALL
  SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier UNION ALL
  SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem)"""
