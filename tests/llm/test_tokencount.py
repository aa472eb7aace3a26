import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagloom.llm import queries
from tagloom.llm import tokencount as tc

PLACE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PLACE)
TEXTS = ["", " \n ", "Hello, world's end", "ΟΔΟΣ ΟΔΟΣ. Οδός", "á ́b é", "x<|endoftext|>y <|startoftext|> z<|endoftext|>", "日本語 ñandú 🙂", "a" * 999, "İstanbul ŞŞ \x85   w", "\x1c\x1d a\x0bb\x0cc", "12 345 6!!?? ..."]


def expected(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", TEXTS)
def test_as_library(text):
    e = tc.Encoder(PLACE)
    assert e.count_all([text, text]) == [expected(text)] * 2
    assert tc.count_long(e, text, 16, 4) == expected(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", "Über", " ", "\n", "\t", "don't", "<|endoftext|>", "é", "!!", "123", "Σ", "x" * 40, " ", "\x0b"]), max_size=60))
def test_chunks(parts):
    text = "".join(parts)
    e = tc.encoder(PLACE)
    assert tc.count_long(e, text, 24, 4) == expected(text) == e.count_all([text])[0]


SOME = ["the", "Über", " ", "\n", "don't", "<|endoftext|>", "é", "!!", "123", "Σ", "x" * 40, "日本語", "か\u3099", "。", "，", "a1b2", "e\u0301", "9\u0301", "'s", "7'll", "ﬁ", "Ⅳ", "１２", "ᄀ", "ᅡ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SOME), max_size=30), st.lists(st.sampled_from(SOME), max_size=30))
def test_stable_boundaries(left, right):
    """The library separates at every boundary that is called stable, and counts on either side do not depend on the other."""
    text = "".join(left + right)
    at = len("".join(left))
    if 0 < at < len(text) and tc.stable(text, at):
        assert expected(text) == expected(text[:at]) + expected(text[at:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SOME), max_size=80), st.integers(8, 40), st.integers(2, 8))
def test_chunks_of_any_script(parts, chunk, overlap):
    text = "".join(parts)
    assert tc.count_long(tc.encoder(PLACE), text, chunk, overlap) == expected(text)


def test_boundaries_without_spaces(monkeypatch):
    """Ideographs and base64 are spliced at marks and digits: no chunk grows to the whole text."""
    rng, longest = random.Random(4), []
    texts = ["".join(rng.choice("日本語漢字仮名") if rng.random() < 0.9 else "。" for _ in range(20000)), "".join(rng.choices("abcdefXYZ0123456789+/", k=20000))]
    e = tc.encoder(PLACE)
    plain = tc.Encoder.starts
    monkeypatch.setattr(tc.Encoder, "starts", lambda self, t, a, b: longest.append(b - a) or plain(self, t, a, b))
    for text in texts:
        assert tc.count_long(e, text, 1000, 64) == expected(text)
    assert max(longest) < 3000


def test_files_without_proof_are_refused(tmp_path):
    file = json.loads(open(PLACE, encoding="utf-8").read())
    assert tc.proven(file)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Metaspace"}}, {"added_tokens": [{**file["added_tokens"][0], "content": "a b"}]}):
        assert not tc.proven({**file, **change})
    (tmp_path / "t.json").write_text(json.dumps({**file, "normalizer": None}))
    with pytest.raises(ValueError):
        tc.Encoder(str(tmp_path / "t.json"))


def test_query_on_a_table(spark):
    """The registered query against the library on every whole text."""
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op4_token_counts"](spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: (len(t.encode()), expected(t), expected(t) > 2048) for i, t in texts.items()}
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want


def test_widening_reaches_the_end():
    text = "y" * 500 + " tail " + "z" * 700
    assert tc.count_long(tc.encoder(PLACE), text, 32, 4) == expected(text)


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(tc, "CACHE_RUNS", 3)
    e = tc.Encoder(PLACE)
    text = "one two three four five six one two three four"
    assert e.count_all([text]) == [expected(text)] and e.count_all([text, "six one"]) == [expected(text), 2]


def test_frame(spark):
    df = spark.createDataFrame([(1, "hello big world", "x"), (2, None, "y"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, N_tokens string")
    out = tc.count_tokens(df, PLACE, chunk=8, overlap=2)
    assert sorted((r.doc_id, r.n_tokens) for r in out.collect()) == [(1, 3), (2, 0), (2, 0), (3, 0)]
    assert tc.count_tokens(df.limit(0), PLACE).count() == 0
