import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import bpe, queries

PLACE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PLACE)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.codec(PLACE, public_tokenizers.PATTERN)

TEXTS = ["", " ", "Hello, world", "don't  stop\n\n  now", "日本語テキスト été ñandú", "🙂👍🏽" * 9, "a" * 3000, " " * 3000, "ab" * 2000, "<|endoftext|>", "\x00\x1c\x85 x", "1234567890" * 50]


@pytest.mark.parametrize("text", TEXTS)
def test_as_library(text):
    ids = bpe.ids_array(CODEC.encode(text))
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    assert bpe.ids_array(CODEC.encode(text)) == LIBRARY.encode_ordinary(text)


def test_tokens_glued_together():
    """Pieces made of whole tokens are where greedy longest matches go wrong."""
    rng, tokens = random.Random(1), [t for t in RANKS if t.isalpha() and len(t) < 9]
    for _ in range(1500):
        piece = b"".join(rng.choices(tokens, k=rng.randint(2, 9)))
        try:
            text = piece.decode()
        except UnicodeDecodeError:
            continue
        assert bpe.ids_array(CODEC.encode(text)) == LIBRARY.encode_ordinary(text)


def test_long_text_by_steps(monkeypatch):
    text = "Ein Satz mit  Wörtern, 12345 und mehr.\n" * 500
    whole = CODEC.encode(text)
    monkeypatch.setattr(bpe, "STEP", 1000)
    assert CODEC.encode(text) == whole


def test_frame(spark):
    df = spark.createDataFrame([(1, "hello world", 7), (2, None, 8), (3, "", 9), (3, "", 9)], "doc_id long, text string, N_TOKENS int")
    out = bpe.decode(bpe.encode(df, PLACE, public_tokenizers.PATTERN), PLACE)
    assert out.columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].n_tokens == len(LIBRARY.encode_ordinary("hello world")) and bytes(rows[1].decoded) == b"hello world"
    assert rows[2].n_tokens == 0 and bytes(rows[2].token_ids) == b""
    assert bpe.encode(df.limit(0), PLACE, public_tokenizers.PATTERN).count() == 0


def test_unknown_ids(spark):
    df = spark.createDataFrame([(1, CODEC.encode("hello")), (2, b"\xff\xff\xff\x7f"), (3, b"\x01"), (4, None)], "doc_id long, token_ids binary")
    got = {r.doc_id: None if r.decoded is None else bytes(r.decoded) for r in bpe.decode(df, PLACE).collect()}
    assert got == {1: b"hello", 2: None, 3: None, 4: b""}


def test_query_on_a_table(spark):
    """The registered query's counts and hashes against the library, on every whole text."""
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op1_byte_bpe"](spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want[r.doc_id] = len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
