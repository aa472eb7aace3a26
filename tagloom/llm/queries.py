"""The queries of this subpackage, as the driver registers them, with SQL oracles where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, exactdedup, language, licenses, mixing, pseudonyms, quality, simhash, tokencount, toxicity
from tagloom.llm.common import table

#: Vocabulary files and the pattern that splits texts; any others can be given to the operators.
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
COUNT_FILE = "word_bpe_49k.json"
COUNT_LIMIT = 2048
#: A production run gives its own secret.
PSEUDONYM_KEY = "example key, not a secret"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, pattern = public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, place, pattern).drop("text"), place)
    return both.select("doc_id", "n_tokens", bpe.sha256("token_ids").alias("ids_sha256"), bpe.sha256("decoded").alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = toxicity.held_out()
    weights = toxicity.train(docs.filter(~out), labels.filter(~out))
    return toxicity.score(docs, weights).select("doc_id", out.alias("held_out"), "score", "predicted")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "places", "expressions")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, public_tokenizers.path(COUNT_FILE))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > COUNT_LIMIT).alias("over_limit"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdedup.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY).select("doc_id", "text", "n_pseudonyms")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out()
    model = language.train(docs.filter(~out))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_toxicity, op3_license_scan, op4_token_counts, op5_exact_dedup, op6_pseudonyms, op7_quality_rules, op8_simhash_near_dedup, op9_source_mix, op10_language_id)} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
        g AS (SELECT doc_id, t, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w AS place
              FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS FIRST))
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM g
    """,
}
