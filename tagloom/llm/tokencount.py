"""Token counts of texts of any length, as the `tokenizers` library gives them for the whole text.

Overlap resynchronisation: a text longer than a chunk is cut into chunks that overlap. The library encodes each chunk, with
offsets. Two neighbouring chunks are spliced at a place in their overlap where both have a token starting, and which is proven
stable: no added token, composed character, pre-token or merge spans it, whatever stands further off, so that what is left of
it cannot change what is right of it, nor the other way round. Such places are behind white space; beside an ASCII digit, if
the other neighbour is an ASCII letter or digit, an ideograph, kana or their punctuation; and between these letters and that
punctuation. Where an overlap has no such place, the left chunk is extended and the overlap doubled, until one is found or the
text ends. The proof rests on how a tokeniser normalises and splits, so a file that does it otherwise is refused (`proven`).

Texts that fit a chunk need no splice. The same boundaries, at white space, divide them into runs; the library's answer for a
run is remembered, so a word that comes again is not encoded again. Null texts count as empty, with no tokens.
"""

from __future__ import annotations

import json
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tagloom.llm.common import named, small_batches, with_struct

#: Characters of a chunk, and of the overlap of two chunks before it is widened.
CHUNK, OVERLAP = 1 << 15, 1 << 8
#: Runs remembered in each of a worker's two cache generations, and the longest run (in characters) that is remembered.
CACHE_RUNS, CACHE_LENGTH = 200_000, 48
#: Characters of short texts that are split into runs at a time, and unknown runs given to the library at a time.
STEP, ASK = 1 << 20, 1 << 11
#: White space at which every supported tokeniser separates; a subset of what they drop, so that the proof holds.
SPACES = " \t\n\r"
#: How a supported file normalises and splits.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Punctuation of ideographic scripts that composes with nothing.
MARKS = frozenset("\u3001\u3002\u300c\u300d\u300e\u300f\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f")


def proven(file: dict) -> bool:
    """Whether a tokenizer.json separates where `stable` says: white space dropped, letters, digits and marks apart, byte-level
    pairs within these pieces, and no added token with a digit, white space or a sign beyond ASCII in it."""
    split, level = ((file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])[:2]
    return (
        (file.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and split.get("type") == "Split" and split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
        and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex")
        and len(file["pre_tokenizer"]["pretokenizers"]) == 2
        and file["model"]["type"] == "BPE" and not file["model"].get("dropout")
        and all(not t["lstrip"] and not t["rstrip"] and not t["normalized"] and all(c.isascii() and not c.isdigit() and not c.isspace() for c in t["content"]) for t in file.get("added_tokens", []))
    )


def _kind(c: str) -> int:
    """0 anything, 1 ASCII digit, 2 letter that nothing before it composes with, 3 mark."""
    if c.isascii():
        return 1 if c.isdigit() else 2 if c.isalpha() else 0
    if c in MARKS:
        return 3
    return 2 if "\u3041" <= c <= "\u3096" or "\u30a1" <= c <= "\u30fa" or "\u3400" <= c <= "\u4dbf" or "\u4e00" <= c <= "\u9fff" else 0


def stable(text: str, at: int) -> bool:
    """Whether the tokeniser separates before character at, whatever else is in the text."""
    if text[at - 1] in SPACES:
        return True
    a, b = _kind(text[at - 1]), _kind(text[at])
    return bool(a and b) and (a == 1 or b == 1 or a != b)


class Encoder:
    """Encodes chunks with the library; remembers runs."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            if not proven(json.load(f)):
                raise ValueError(f"{path} normalises or splits in a way for which no boundary is proven stable")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def learn(self, runs: set[str]) -> dict[str, int]:
        """Tokens of runs without white space."""
        got: dict[str, int] = {}
        unknown = []
        for run in runs:
            known = self.young.get(run)
            if known is None:
                known = self.old.get(run)
                if known is None:
                    unknown.append(run)
                    continue
                self.remember(run, known)
            got[run] = known
        for low in range(0, len(unknown), ASK):
            asked = unknown[low : low + ASK]
            for run, encoding in zip(asked, self.library.encode_batch_fast(asked, add_special_tokens=False)):
                got[run] = len(encoding)
                if len(run) <= CACHE_LENGTH:
                    self.remember(run, len(encoding))
        return got

    def remember(self, run: str, tokens: int) -> None:
        if len(self.young) >= CACHE_RUNS:
            self.old, self.young = self.young, {}
        self.young[run] = tokens

    def count_all(self, texts: list[str]) -> list[int]:
        """Tokens of texts of one chunk each."""
        out: list[int] = []
        low = 0
        while low < len(texts):
            high, held = low, 0
            while high < len(texts) and held < STEP:
                held += len(texts[high])
                high += 1
            out += self._count(texts[low:high])
            low = high
        return out

    def _count(self, texts: list[str]) -> list[int]:
        split = [text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for text in texts]
        runs = set().union(*split)
        runs.discard("")
        size = self.learn(runs)
        size[""] = 0
        return [sum(map(size.__getitem__, runs)) for runs in split]

    def starts(self, text: str, begin: int, end: int) -> list[int]:
        """Where the tokens of a chunk start in its text, in order: the chunk is encoded as it is, with offsets."""
        return [begin + at for at, _ in self.library.encode(text[begin:end], add_special_tokens=False).offsets]


def splice(text: str, left: list[int], right: list[int], low: int, high: int) -> int | None:
    """A stable boundary in (low, high) that both chunks' tokens start at, or None. low, high: the overlap."""
    shared = set(right[bisect_left(right, low + 1) : bisect_left(right, high)])
    for at in left[bisect_left(left, low + 1) : bisect_left(left, high)]:
        if at in shared and stable(text, at):
            return at
    return None


def count_long(encoder: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, from overlapping chunks; holds one pair of chunks at a time."""
    total, counted_from = 0, 0
    begin, end = 0, min(len(text), chunk)
    left = encoder.starts(text, begin, end)
    while end < len(text):
        width = overlap
        while True:
            low, to = max(begin, end - width), min(len(text), max(end - width, begin) + chunk + width)
            right = encoder.starts(text, low, to)
            at = splice(text, left, right, max(low, counted_from), end)
            if at is not None:
                total += bisect_left(left, at) - bisect_left(left, counted_from)
                counted_from, begin, end, left = at, low, to, right
                break
            # widen: the left chunk reaches further, and so does the overlap
            width *= 2
            end = min(len(text), end + width)
            left = encoder.starts(text, begin, end)
            if end == len(text):
                break
    return total + len(left) - bisect_left(left, counted_from)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def count_tokens(df: DataFrame, path: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """df with n_tokens (long). path: the tokenizer.json on every executor."""

    @arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        e = encoder(path)
        values = [t or "" for t in texts.to_pylist()]
        short = iter(e.count_all([t for t in values if len(t) <= chunk]))
        return pa.array([next(short) if len(t) <= chunk else count_long(e, t, chunk, overlap) for t in values], pa.int64())

    return with_struct(small_batches(df), F.struct(run(named(text)).alias("n_tokens")), ["n_tokens"])
