"""Exact deduplication against a persistent index of digests, bucketed and sorted by digest.

Texts are equal when they are so after every ASCII white-space character is deleted; a null text counts as empty. The index
is a Parquet table with one row a digest: the row that stays, and how many rows had the digest when it was added. A batch is
first reduced to a table with one row a digest; each task combines its own rows before that shuffle, so a huge group of copies
sends one row for each task that had some of it. That table is anti-joined by sort-merge with the index, whose buckets need
neither shuffle nor sort, and what is new is appended. (The table is written before the join, since Catalyst would otherwise
join the raw rows first and combine them behind the shuffle.)

Of equal texts within a batch, the one with the most code points before deleting stays, then the least doc_id (null first);
of rows that are equal in all of these, the one of least row hash, and of rows equal throughout, one. A digest that the index
had before keeps the row it had. Empty tables give empty results.

A batch has an id. Its decisions are written before the index learns of it, and the index holds rows by their doc_id and row
hash, so after a crash anywhere the same batch is given again under the same id and gets the same result. Batches are added
to an index one at a time. All this runs in Spark's own functions.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import has_repeats, join_groups, keep_rows, named, row_hash, shared_path, written

#: White space that does not count.
SPACES = " \t\n\x0b\x0c\r"
INDEX = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("keep_id", T.LongType()), T.StructField("keep_hash", T.LongType()), T.StructField("group_size", T.LongType()), T.StructField("batch", T.StringType())])


def squeezed(text: Column) -> Column:
    """Text without ASCII white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (distinct for each row of this result once it is written), row_hash, n_chars and digest of each row."""
    return docs.select(
        named(doc_id).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        row_hash(docs).alias("row_hash"),
        F.coalesce(F.length(named(text)), F.lit(0)).alias("n_chars"),
        F.unhex(F.sha2(squeezed(named(text)), 256)).alias("digest"),
    )


def grouped(batch: DataFrame) -> DataFrame:
    """A written `digests` table -> digest, best (the row that stays), n (its rows); combined before the shuffle."""
    best = F.struct((-F.col("n_chars")).alias("less"), "doc_id", "row_hash", "row")
    return batch.groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("n"))


class DigestIndex:
    """A digest index at a path that outlives the session; `name` is what this session's catalogue calls it.

    The number of buckets stands beside the index, in the folder `path`-buckets, and holds when it is opened again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or shared_path(spark, "digest-index")
        self.buckets = self._bucket_count(buckets)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in INDEX)
        spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def _bucket_count(self, asked: int | None) -> int:
        place = f"{self.path.rstrip('/')}-buckets"
        stored = self._read(place, "buckets int")
        if stored is not None:
            count = stored.first()["buckets"]
            if asked and asked != count:
                raise ValueError(f"the index at {self.path} has {count} buckets, not {asked}")
            return count
        old = self._read(self.path, INDEX)
        if not asked and old is not None and not old.isEmpty():
            raise ValueError(f"the index at {self.path} has no bucket count beside it: give the count it was written with")
        count = asked or int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # as many as a shuffle makes: a batch needs no other
        self.spark.range(1).select(F.lit(count).alias("buckets")).coalesce(1).write.parquet(place)
        return count

    def _read(self, path: str, schema: T.StructType | str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def fresh(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks."""
        return groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def decide(self, batch: DataFrame, batch_id: str) -> DataFrame:
        """A written `digests` table -> a written table with a row for each of its digests: digest, n, keep_id, keep_hash,
        group_size, fresh (the index lacks it), and keep_row, the batch's row that stays, or null. The index stays as it is."""
        groups = written(grouped(batch), "digest-groups")
        new = self.fresh(groups).select("digest", "n", F.col("best.doc_id").alias("keep_id"), F.col("best.row_hash").alias("keep_hash"), F.col("n").alias("group_size"), F.lit(True).alias("fresh"), F.col("best.row").alias("keep_row"))
        known = groups.join(self.rows().hint("merge"), "digest", "inner")
        ours = (F.col("batch") == batch_id) & F.col("keep_id").eqNullSafe(F.col("best.doc_id")) & (F.col("keep_hash") == F.col("best.row_hash"))
        old = known.select("digest", "n", "keep_id", "keep_hash", "group_size", F.lit(False).alias("fresh"), F.when(ours, F.col("best.row")).alias("keep_row"))
        return written(new.unionByName(old), "digest-decided")

    def add(self, decided: DataFrame, batch_id: str) -> None:
        """Append what is new in the decisions on a batch."""
        fresh = decided.filter("fresh").select("digest", "keep_id", "keep_hash", "group_size", F.lit(batch_id).alias("batch"))
        fresh = fresh.repartition(self.buckets, "digest")  # a bucket is one task's, and so one file
        fresh.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name, path=self.path)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Take the index out of this session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def deduplicate(batch: DataFrame, index: DigestIndex, batch_id: str) -> DataFrame:
    """The rows of a written `digests` table with keep_id, group_size and kept; the index has the batch afterwards.

    group_size counts this batch's rows of a digest that came with it, and for older digests the rows they came with.
    """
    decided = index.decide(batch, batch_id)
    index.add(decided, batch_id)
    joined = join_groups(batch, decided.select("digest", "n", "keep_id", "group_size", "keep_row"), ["digest"], "n")
    return joined.withColumn("kept", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))).drop("n", "keep_row")


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch_id: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, row, row_hash, n_chars, digest, keep_id, group_size, kept. Adds the documents to the index.

    With an index that outlives the run batch_id names the documents, and a run that is repeated gives the same one. Without
    an index the documents are held against each other only.
    """
    if index is not None and not batch_id:
        raise ValueError("an index that outlives the run needs a batch_id, under which a run can be repeated")
    batch = written(digests(docs, doc_id, text), "digests")
    if index is not None:
        return deduplicate(batch, index, batch_id)
    index = DigestIndex(docs.sparkSession)
    try:
        return deduplicate(batch, index, "only")
    finally:
        index.close()


def keep_one(docs: DataFrame, index: DigestIndex | None = None, batch_id: str | None = None) -> DataFrame:
    """docs without the rows that are copies of one that stays; columns as they were."""
    decided = written(exact_duplicates(docs, index, batch_id), "exact-decided")
    return keep_rows(docs, decided.filter("kept"), has_repeats(decided))
