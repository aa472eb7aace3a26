import random
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from tagloom.llm import bpe, simhash
from tests.llm.test_exactdedup import brute as brute_exact
from tests.llm.test_quality import brute as brute_stats
from tests.llm.test_simhash import both, brute_components, brute_print


def corpus():
    rng, rows = random.Random(7), []
    for i in range(240):
        words = ["".join(rng.choices("abcdefgh", k=rng.choice([3, 4, 5, 6]))) for _ in range(rng.randrange(80, 160))]
        text = " ".join(words)
        if i % 17 == 3:
            text = rows[i - 1][1] + "  "
        elif i % 19 == 4:
            text = rows[i - 2][1] + " tail"
        elif i % 23 == 5:
            text = " ".join(words[:20])
        elif i % 29 == 6:
            text = " ".join(words[:30] * 4)
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 4}", len(text)))
    return rows + [(500, None, "en", "hot", 0), (501, "", None, None, 0)]


def test_run_as_brute_force(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = docs.collect()
        assert name == "byte_bpe" or docs.schema == before.schema
    by_id = {r[0]: r for r in rows}
    left = [r for r in rows if brute_stats(r[1])[0] >= 50 and 100 * brute_stats(r[1])[4] <= 50 * brute_stats(r[1])[0]]
    assert {r.doc_id for r in at["quality_rules"]} == {r[0] for r in left}
    left = [r for i, r in enumerate(left) if brute_exact(left)[i][2]]
    assert sorted(r.doc_id for r in at["exact_dedup"]) == [r[0] for r in left]
    keyed = {r[0]: (r[0], brute_print(r[1]), brute_print(r[1], 5)) for r in left}
    roots, least = brute_components(keyed.values(), lambda a, b: both(a[1:], b[1:], corpus_pipeline.NEAR_BITS, corpus_pipeline.NEAR_CHECK[1])), {}
    for r in left:
        root = roots[keyed[r[0]]]
        least[root] = min(r[0], least.get(root, r[0]))
    assert sorted(r.doc_id for r in at["simhash_near_dedup"]) == sorted(least.values())
    mixed = [r.doc_id for r in at["source_mix"]]
    assert set(mixed) <= set(least.values()) and max(mixed.count(d) for d in mixed) <= 2
    size = {d: len(by_id[d][1].split()) for d in least.values()}
    assert abs(sum(size[d] for d in mixed) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANKS)), special_tokens={})
    assert sorted(r.doc_id for r in at["byte_bpe"]) == sorted(mixed)
    for r in at["byte_bpe"]:
        assert r.round_trip and bpe.ids_array(bytes(r.token_ids)) == library.encode_ordinary(by_id[r.doc_id][1])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in at["byte_bpe"])


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, _hash int"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert re.match("[0-9a-f]{16}$", f"{simhash.fingerprint('a'):016x}")
