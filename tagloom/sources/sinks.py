"""Writing results: partitioned reports, keyed upserts, caches of successes, pattern configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, form: str = "csv", single: bool = False, by: list[str] | None = None) -> None:
    """A report as csv, json, xml, orc or parquet; `single` only for reports that are small by their nature."""
    out = (df.coalesce(1) if single else df).write.mode("overwrite").format(form)
    out = out.option("header", "true") if form == "csv" else out.option("rowTag", "row") if form == "xml" else out
    (out.partitionBy(*by) if by else out).save(path)


def upsert(spark: SparkSession, path: str, version: int, rows: DataFrame, key: str) -> int:
    """A new version of a keyed table under path, written whole beside the last: rows replace those of their key, the first
    creation time stays and saves are counted. Of several rows of a key the greatest counts, column by column in order. Returns
    the version; a reader of the old one is never disturbed."""
    rest = [c for c in rows.columns if c != key]
    rows = rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, "_r.*")
    new = rows.withColumn("saved_at", F.current_timestamp())
    if version:
        old = spark.read.parquet(f"{path}/v={version}")
        past = old.select(key, F.col("created_at").alias("_c"), F.col("saves").alias("_s"))
        new = new.join(past, key, "left").withColumn("created_at", F.coalesce("_c", "saved_at")).withColumn("saves", F.coalesce("_s", F.lit(0)) + 1).drop("_c", "_s")
        new = new.unionByName(old.join(rows.select(key), key, "left_anti"))
    else:
        new = new.withColumn("created_at", F.col("saved_at")).withColumn("saves", F.lit(1))
    new.write.mode("errorifexists").parquet(f"{path}/v={version + 1}")
    return version + 1


def cache_successes(results: DataFrame, path: str, ok: str) -> None:
    """Append what succeeded, keyed by the content hash in `key`; failures are never stored."""
    results.filter(ok).write.mode("append").parquet(path)


def merge_patterns(config: DataFrame, patterns: DataFrame) -> DataFrame:
    """Configuration rows (collection, id, json) with patterns put in or replaced; the input stays as it is."""
    return config.join(patterns.select("collection", "id"), ["collection", "id"], "left_anti").unionByName(patterns)


def sheet_names(nodes: DataFrame, node: str) -> DataFrame:
    """node, sheet: the first 31 characters, with a number where that is not unique."""
    from pyspark.sql import Window

    short = F.substring(F.regexp_replace(node, r"[\[\]:*?/\\]", "_"), 1, 31)
    n = F.row_number().over(Window.partitionBy("sheet").orderBy(node))
    d = nodes.select(node).distinct().withColumn("sheet", short).withColumn("_n", n)
    return d.select(node, F.when(F.col("_n") == 1, F.col("sheet")).otherwise(F.concat(F.expr("substring(sheet, 1, 27)"), F.lit("~"), F.col("_n").cast("string"))).alias("sheet"))


def list_newest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The rows of a version of an upserted table, the last saved first."""
    return spark.read.parquet(f"{path}/v={version}").orderBy(F.desc("saved_at"))


def delete(spark: SparkSession, path: str, version: int, keys: DataFrame, key: str) -> int:
    """A new version without the rows of some keys; returns it."""
    spark.read.parquet(f"{path}/v={version}").join(keys.select(key), key, "left_anti").write.mode("errorifexists").parquet(f"{path}/v={version + 1}")
    return version + 1


def cached(spark: SparkSession, path: str, schema: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a cache of successes holds for keys (column key), the last stored of each, and the keys it lacks."""
    stored = spark.read.schema(schema).parquet(path).dropDuplicates(["key"])
    return stored.join(keys.select("key").distinct(), "key", "left_semi"), keys.select("key").distinct().join(stored, "key", "left_anti")


def graph_json(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line for each node ({"id": ...}) and link ({"source": ..., "target": ...}), with all other columns."""
    node = F.struct(F.col(vertices.columns[0]).cast("string").alias("id"), *vertices.columns[1:])
    link = F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), *[c for c in edges.columns if c not in ("src", "dst")])
    return vertices.select(F.lit("node").alias("kind"), F.to_json(node).alias("json")).unionByName(edges.select(F.lit("link").alias("kind"), F.to_json(link).alias("json")))


def safety_register(objects: DataFrame) -> DataFrame:
    """tag, type, category, source of safety-typed objects."""
    from tagloom.functions.tags import SAFETY_TYPES

    return objects.filter(F.col("type_code").isin(SAFETY_TYPES)).select("tag", F.col("type_code").alias("type"), "category", "source")
