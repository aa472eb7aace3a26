"""License scan: notice phrases and identifier tags by Aho-Corasick, licence expressions by a shunting-yard parser.

A text is lower-cased in A-Z and cut into words of ASCII letters, digits and all characters beyond ASCII. One automaton
finds every phrase whose words stand consecutively; a second finds identifier tags (SPDX-License-Identifier and such) in
the lower-cased text, and the rest of a tag's line is parsed as an expression of licences with AND, OR and WITH. WITH binds
tightest, then AND, then OR. An expression is evaluated to how far it binds its user, from 0 (public domain) to 1
(reserved): OR takes the lesser side, AND the greater, and an exception halves it. A text's score is the greatest value
of its phrases and expressions, 0 where there is none.

An expression ends with its line or where another tag begins, so each character is read once, however long the line.

Null texts count as empty: no words, no labels, score 0. An expression that does not parse keeps the licences named in it,
counts as their AND, and is reported with valid = false.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tagloom.llm.common import named, small_batches, with_struct

# The base phrases and their labels, and this operator's own.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
OWN = {
    "mit license": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "creative commons": "cc",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
#: How far a label binds.
BINDS = {
    "cc0": 0.0, "public-domain": 0.0, "unlicense": 0.0, "mit": 0.2, "isc": 0.2, "bsd": 0.2, "bsl": 0.2, "apache": 0.25, "cc-by": 0.3, "cc": 0.4,
    "mpl": 0.5, "epl": 0.5, "lgpl": 0.55, "cc-by-sa": 0.6, "cc-by-nd": 0.7, "gpl": 0.7, "agpl": 0.8, "cc-by-nc": 0.8, "reserved": 1.0,
}
UNKNOWN = 0.9
TAGS = ("spdx-license-identifier:", "license-identifier:", "license-expression:")

_NOT_WORD = bytes(c if c >= 128 or chr(c).isdigit() or "a" <= chr(c) <= "z" else 32 for c in range(256))
_TERM = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+-]*")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_FAMILIES = sorted(BINDS, key=len, reverse=True)


@lru_cache(1 << 12)
def label_of(name: str) -> str:
    """The family of a licence identifier: gpl-2.0-only is gpl, cc-by-sa-4.0 is cc-by-sa."""
    stem = re.sub(r"(-only|-or-later|\+)$", "", name)
    for family in _FAMILIES:
        if stem == family or stem.startswith((f"{family}-", f"{family}.")) or stem.rstrip("0123456789.") == family:
            return family
    return stem


def shunting_yard(tokens: list[str]) -> list[str]:
    """Tokens in postfix order; ValueError where they are no expression."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in tokens:
        if token == "(":
            if not operand_next:
                raise ValueError("no operator before (")
            held.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError("nothing before )")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("no ( for )")
            held.pop()
        elif token in _PRECEDENCE:
            if operand_next:
                raise ValueError("no operand before operator")
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError("no operator between operands")
            out.append(token)
            operand_next = False
    if operand_next:
        raise ValueError("no last operand")
    while held:
        if held[-1] == "(":
            raise ValueError("no ) for (")
        out.append(held.pop())
    return out


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """How far an expression binds, and the labels in it."""
    stack: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            label = label_of(token)
            stack.append((BINDS.get(label, UNKNOWN), {label}))
            continue
        (right, more), (left, labels) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left / 2, labels))  # what follows names an exception, not a licence
        else:
            few, many = sorted((labels, more), key=len)
            many |= few  # the lesser set into the greater: a long chain of licences stays linear
            stack.append((min(left, right) if token == "or" else max(left, right), many))
    return stack[0]


def read_expression(text: str, start: int = 0, stop: int | None = None) -> tuple[str, float, set[str], bool] | None:
    """Expression, value, labels and validity of what stands from start to stop, behind a tag; None if nothing does."""
    tokens: list[str] = []
    for m in _TERM.finditer(text, start, len(text) if stop is None else stop):
        at, term = m.start(), m.group()
        apart = at == start or text[at - 1] in " \t\r\x0b\x0c(" or term == ")" or tokens[-1:] == [")"]
        wanted = not tokens or tokens[-1] in _PRECEDENCE or tokens[-1] == "("
        if not apart or (term not in _PRECEDENCE and term != ")" and not wanted):
            break  # prose or the end of a comment follows
        tokens.append(term.rstrip("."))
    if not tokens:
        return None
    try:
        value, labels = evaluate(shunting_yard(tokens))
        return " ".join(tokens), value, labels, True
    except ValueError:
        labels = {label_of(t) for i, t in enumerate(tokens) if t not in _PRECEDENCE and t not in "()" and tokens[i - 1 : i] != ["with"]}
        return " ".join(tokens), max([BINDS.get(x, UNKNOWN) for x in labels], default=0.0), labels, False


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.phrases = ahocorasick.Automaton()
        for phrase, label in OWN.items():
            self.phrases.add_word(f" {phrase} ", (len(phrase), label, False))
        for phrase, label in BASE.items():
            self.phrases.add_word(f" {phrase} ", (len(phrase), label, True))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, len(tag))
        self.tags.make_automaton()

    def scan(self, text: str | None) -> dict:
        lower = (text or "").encode("utf-8").lower()
        words = lower.translate(_NOT_WORD).split()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        places: list[tuple[str, int, int, bool]] = []
        begins: list[int] = []
        for end, (size, label, base) in self.phrases.iter(line):
            begins = begins or list(accumulate((len(w) + 1 for w in words), initial=1))
            start = end - size  # of the phrase's first letter
            places.append((label, bisect_left(begins, start), line.count(" ", start, end) + 1, base))
        expressions = []
        if b"identifier:" in lower or b"expression:" in lower:
            whole = lower.decode("latin-1")
            tags: dict[int, int] = {}  # where a tag ends and begins; of two that end together the longer
            for end, size in self.tags.iter(whole):
                tags[end + 1] = min(end + 1 - size, tags.get(end + 1, end))
            line_end = -1
            for stop, nxt in zip(tags, [*list(tags.values())[1:], len(whole)]):
                if line_end < stop:
                    line_end = whole.find("\n", stop)
                    line_end = len(whole) if line_end < 0 else line_end
                if found := read_expression(whole, stop, min(line_end, max(stop, nxt))):
                    expressions.append(found)
        starts = [first for _, first, _, base in places if base]
        labels = {label for label, *_ in places} | {x for _, _, names, _ in expressions for x in names}
        values = [BINDS[label] for label, *_ in places] + [value for _, value, _, _ in expressions]
        return {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted({label for label, _, _, base in places if base})),
            "labels": ",".join(sorted(labels)),
            "score": max(values, default=0.0),
            "places": [{"label": label, "first_word": first, "n_words": n} for label, first, n, _ in places],
            "expressions": [{"expression": e, "binds": value, "valid": valid} for e, value, _, valid in expressions],
        }


SCHEMA = (
    "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,"
    "places:array<struct<label:string,first_word:bigint,n_words:bigint>>,expressions:array<struct<expression:string,binds:double,valid:boolean>>>"
)
FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places", "expressions"]
_TYPE = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("places", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))),
    ("expressions", pa.list_(pa.struct([("expression", pa.string()), ("binds", pa.float64()), ("valid", pa.bool_())]))),
])

_SCANNERS: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNERS:
        _SCANNERS.append(Scanner())
    return _SCANNERS[0]


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with FIELDS: word and place counts, labels, score, and the places and expressions found."""

    @arrow_udf(SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        s = scanner()
        return pa.array([s.scan(t.as_py()) for t in texts], _TYPE)

    return with_struct(small_batches(df), run(named(text)), FIELDS)
