"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding.

A token sequence is the one that the merges give if and only if each two neighbours are what the merges give for their
joined bytes. So a piece is encoded from left to right: take the longest token that starts here, shorten it until it is
compatible with the token before, step back where none is, and never try again to stand at a place that led nowhere.
Each place is given up at most once, which makes the time linear in the piece. The longest tokens at all places come from
one Aho-Corasick pass over the piece, its bytes read as Latin-1 characters; whether two tokens are compatible is memoised.

Null texts count as empty: no tokens, decoded to no bytes. Ids come packed as little-endian unsigned 32-bit integers
(the layout of a token shard), one value a document; `ids_array` unpacks them.
"""

from __future__ import annotations

import base64
import struct
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tagloom.llm.common import named, small_batches, with_struct

#: Pieces kept in a worker's two cache generations, and the longest piece (in characters) that is kept.
CACHE_PIECES, CACHE_LENGTH = 120_000, 40
#: Pairs whose compatibility a worker remembers before it starts anew.
CACHE_PAIRS = 250_000
#: Characters of a text that are split into pieces and packed at a time.
STEP = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The merges as defined: join the leftmost neighbours of least rank until none can be joined. Quadratic, for short pieces."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Codec:
    """Encoder and decoder for one rank file and one pattern that splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        reached = {t: i for t, i in ranks.items() if len(merged(t, ranks)) == 1}  # the others only as whole pieces
        self.length = {i: len(t) for t, i in reached.items()}
        self.shorter = {i: next((reached[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in reached), -1) for t, i in reached.items()}
        self.matcher = ahocorasick.Automaton()
        for t, i in reached.items():
            self.matcher.add_word(t.decode("latin-1"), (i, len(t)))
        self.matcher.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            left, right = self.bytes_of[a], self.bytes_of[b]
            found = self.pairs[a, b] = merged(left + right, self.ranks) == [left, right]
        return found

    def encode_bytes(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * (n + 1)
        for end, (token, size) in self.matcher.iter(piece.decode("latin-1")):
            longest[end + 1 - size] = token  # for one start the ends, and so the sizes, come in growing order
        given_up = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        length, shorter = self.length, self.shorter
        while at < n:
            while token >= 0:
                to = at + length[token]
                if not given_up[to] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at, token = to, longest[to]
                    break
                token = shorter[token]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                given_up[at] = 1
                last = out.pop()
                at -= length[last]
                token = shorter[last]
        return out

    def _new(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            ids = self.encode_bytes(piece.encode("utf-8"))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_LENGTH:
            if len(self.young) >= CACHE_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        get, new, out, some = self.young.get, self._new, [], []
        for found in self.split.finditer(text) if len(text) > STEP else (self.split.findall(text),):
            if type(found) is list:
                out = [get(p) or new(p) for p in found]
            else:  # of a huge text only a step's pieces are held as objects
                p = found.group()
                some.append(self.young.get(p) or new(p))
                if len(some) >= STEP:
                    out.append(b"".join(some))
                    some.clear()
        return b"".join(out + some)

    def decode(self, packed: bytes) -> bytes:
        return joined(packed, self.bytes_of)


def joined(packed: bytes, bytes_of: dict[int, bytes]) -> bytes:
    """The bytes of packed ids, a step's ids at a time."""
    step = 4 * STEP
    parts = (packed[i : i + step] for i in range(0, len(packed), step)) if len(packed) > step else (packed,)
    return b"".join([b"".join([bytes_of[i] for i in struct.unpack(f"<{len(part) // 4}I", part)]) for part in parts])


def bytes_or_none(packed: bytes | None, bytes_of: dict[int, bytes]) -> bytes | None:
    if len(packed or b"") % 4:
        return None
    try:
        return joined(packed or b"", bytes_of)
    except KeyError:
        return None


_CODECS: dict[tuple[str, str], Codec] = {}
_TABLES: dict[str, dict[int, bytes]] = {}


def table_of(path: str) -> dict[int, bytes]:
    """Token bytes by id: all that decoding needs."""
    if path not in _TABLES:
        _TABLES[path] = {i: t for t, i in read_ranks(path).items()}
    return _TABLES[path]


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process for each vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with n_tokens (long) and token_ids (binary, packed). path is the rank file's place on every executor."""

    @arrow_udf("struct<n_tokens:bigint,token_ids:binary>")
    def run(texts: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        ids = [c.encode(t.as_py()) if t.is_valid else b"" for t in texts]
        return pa.StructArray.from_arrays([pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["n_tokens", "token_ids"])

    return with_struct(small_batches(df), run(named(text)), ["n_tokens", "token_ids"])


def decode(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """df with decoded (binary): the bytes that the packed ids stand for; null ids count as none. Where an id is not in the
    vocabulary, or the packed bytes are no whole ids, decoded is null."""

    @arrow_udf("binary")
    def run(packed: pa.Array) -> pa.Array:
        table = table_of(path)
        return pa.array([bytes_or_none(x.as_py(), table) for x in packed], pa.binary())

    return with_struct(small_batches(df), F.struct(run(named(ids)).alias("decoded")), ["decoded"])


def ids_array(packed: bytes) -> list[int]:
    out = array("I")
    out.frombytes(packed)
    return list(out)


def sha256(column: str) -> Column:
    return F.sha2(F.col(column), 256)
