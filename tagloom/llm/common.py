"""What the operators share: reading tables, durable intermediate tables, joins that a hot key cannot stall."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key counts as heavy when it holds at least one part in this many of the rows, so there are never more heavy keys.
HEAVY_KEYS = 1024
#: Rows of an Arrow batch at most, where rows hold texts.
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master
    is local (tests). On a cluster without it this raises: tables in machine-local folders would be lost."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tagloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tagloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and whole though executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(name: str) -> Column:
    """The column of exactly this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def hidden(n: int) -> list[str]:
    """Names for helper columns, which no input has."""
    return [f"_{uuid.uuid4().hex}" for _ in range(n)]


def with_new(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with the new columns; one of the same name (in any case) is replaced, all others stay."""
    clash = {name.lower() for name in new}
    return df.select(*[named(c) for c in df.columns if c.lower() not in clash], *[c.alias(n) for n, c in new.items()])


def with_struct(df: DataFrame, result: Column, fields: list[str]) -> DataFrame:
    """df with the fields of a struct, evaluated once a row, as columns."""
    (mine,) = hidden(1)
    out = df.withColumn(mine, result)
    return with_new(out, {f: F.col(f"{mine}.{f}") for f in fields}).drop(mine)


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches were made small enough for rows that hold whole texts; never made larger.

    Spark reads this setting when it plans a query, which is after an operator returned, so it stays set in the session.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


def _hashable(kind: T.DataType) -> bool:
    """Whether xxhash64 takes a type: not where a map or a variant is in it."""
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row; with its doc_id it tells rows apart, but for rows equal throughout. Maps count as their JSON."""
    fields = [named(f.name) if _hashable(f.dataType) else F.to_json(F.struct(named(f.name))) for f in docs.schema.fields]
    return F.xxhash64(*fields, *[named(c).isNull() for c in docs.columns])


def keep_rows(docs: DataFrame, kept: DataFrame, repeats: bool = False) -> DataFrame:
    """The rows of docs whose (doc_id, row_hash) stand in the written table kept; columns as they were.

    Whole rows are shuffled once, by their own id, which spreads evenly. repeats: some rows are equal throughout, and of
    those only one is to stay.
    """
    names = docs.columns
    mine, id_, hash_, row = hidden(4)
    out = docs.withColumn(mine, row_hash(docs))
    ids = kept.select(F.col("doc_id").alias(id_), F.col("row_hash").alias(hash_))
    out = out.join(ids, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(mine) == F.col(hash_)), "left_semi")
    if repeats:
        out = out.groupBy("doc_id", mine).agg(F.first(F.struct(*[named(c) for c in names])).alias(row)).select(f"{row}.*")
    return out.select(*[named(c) for c in names])


def has_repeats(decided: DataFrame) -> bool:
    """Whether rows of a written table agree in doc_id and row_hash."""
    return decided.groupBy("doc_id", "row_hash").count().filter("count > 1").limit(1).count() > 0


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int | None = None) -> DataFrame:
    """rows with the columns of their group. groups has one row a key, and in `size` the number of rows with that key.

    Heavy keys (at most HEAVY_KEYS of them, by counting) are broadcast; the rest is light enough for a shuffled join,
    where no task can get more than a small part of the rows through one key. Give materialised inputs: both are read twice.
    total: the sum of sizes, where it is known. A key may have a few rows in groups; each of its rows then meets all of them.
    """
    if total is None:
        total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = F.col(size) * HEAVY_KEYS >= F.lit(total)
    many, few = groups.filter(heavy), groups.filter(~heavy)
    renamed = dict(zip(keys, hidden(len(keys))))

    def side(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(k).alias(renamed[k]) for k in keys], *[c for c in df.columns if c not in keys])

    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(v)) for k, v in renamed.items()])
    names = [*rows.columns, *[c for c in groups.columns if c not in keys]]
    many = side(many)
    hot = rows.join(F.broadcast(many), on, "inner").select(*names)
    rest = rows.join(F.broadcast(many.select(*renamed.values())), on, "left_anti")
    cold = rest.join(side(few), on, "inner").select(*names)
    return hot.unionByName(cold)


def in_chunks(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, str]:
    """df written in ranges of an order, and the name of a column that numbers the ranges in that order.

    Rows that agree in all of order share a range; ranges are even, from a sample of the rows, so no task has to sort all.
    """
    (chunk,) = hidden(1)
    spread = df.repartitionByRange(max(1, df.sparkSession.sparkContext.defaultParallelism), *order)
    return written(spread.withColumn(chunk, F.spark_partition_id()), name), chunk


def sums_before(df: DataFrame, chunk: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """An `in_chunks` table with running sums of all rows before each: within its range, and over the ranges before it.

    One task sees a row for each range, never all rows. Sums are null where nothing stands before.
    """
    inner, offset, other = hidden(len(sums)), hidden(len(sums)), hidden(1)[0]
    within = Window.partitionBy(chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy(other).rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(F.col(chunk).alias(other)).agg(*[F.sum(c).alias(n) for n, c in zip(inner, sums.values())])
    per = per.select(other, *[F.sum(a).over(ahead).alias(b) for a, b in zip(inner, offset)])
    out = df.select("*", *[F.sum(c).over(within).alias(n) for n, c in zip(inner, sums.values())])
    out = out.join(F.broadcast(per), F.col(chunk) == F.col(other), "left")  # a row for each range: as many as the cluster has cores
    added = [F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))).alias(n) for n, a, b in zip(sums, inner, offset)]
    return out.select(*df.columns, *added)
