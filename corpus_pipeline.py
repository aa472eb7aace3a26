"""A training corpus from raw documents: quality rules, exact dedup, near dedup, source mix, token ids.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents, for the rows that they keep.
Columns beside doc_id, text, lang and source are carried along; nulls, empty texts and repeated rows are handled as the
operators' own docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, exactdedup, mixing, quality, simhash
from tagloom.llm.common import table, written

#: Near copies link where fingerprints of three-word shingles differ in at most 6 bits, and those of five words in at most 14.
NEAR_BITS, NEAR_CHECK = 6, (5, 14)
#: Rank file of the last stage; its place is asked for on the driver and is the same on executors.
RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outliers of their language and source."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exactdedup.keep_one(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprint links connect: the one of least doc_id."""
    return simhash.keep_one(docs, NEAR_BITS, check=NEAR_CHECK)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words: its taken words by its size, rounded; a row for each time."""
    return mixing.repeat_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, token_ids (packed), ids_sha256, and round_trip: whether decoding gives the text."""
    place, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    encoded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), place, pattern)
    decoded = bpe.decode(encoded, place)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return decoded.select("doc_id", "source", "lang", "n_tokens", "token_ids", bpe.sha256("token_ids").alias("ids_sha256"), same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: The outlier estimates, the components and the token merges are not SQL; tests compare run() with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
