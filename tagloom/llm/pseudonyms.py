"""Format-preserving pseudonyms for personal numbers, dates and addresses, by keyed Feistel permutations.

Candidates are found by pattern and validated: payment cards by the Luhn sum, IBANs by their remainder of 97, United States
social-security numbers by their ranges, telephone numbers by their digits, IPv4 addresses by their octets, dates by the
calendar, and e-mail addresses by form. A valid value is taken apart into its digits (letters of a mail's local part count as
a number to base 36, days as days since 1900), these are permuted by a balanced or near-balanced Feistel network whose round
function is keyed SHA-256, and the value is put together again in the format it had: the same separators, length, country and
kind, with new check digits where the kind has them. The permutation of a format is one to one, and depends on the key, the
kind and the format only, so equal values have equal pseudonyms in all documents and different ones stay different.

Kept as they are: a card's first digit, an IBAN's country and letters, a telephone number's digits before the last seven, a
mail's domain. Dates move within 1900 to 2099, alone or before a time. What is not valid stays as it was: so do ten digits
in a row, which nothing tells from any other number. A number after +1 has eleven digits; of other countries, whose numbers
differ in length, the longest of nine to fifteen digits is taken. A null text stays null, with count 0.

A candidate may take in a value and its neighbour ("4111 1111 1111 1111 12/26" begins with 18 digits). Texts with a candidate
that is valid for no kind, or of a form that can take in a neighbour, are therefore read from left to right: at each
place the shapes that are fixed come first, then the longest valid part of any kind, and reading goes on behind what was
found. All this runs in Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import hidden, named, with_new

ROUNDS = 8
#: Letters of mails beside ASCII: the range of accented Latin letters.
ACCENTED = "\u00c0-\u024f"
#: Candidates, longest kinds first. Java and RE2 agree on all but the look-around.
PATTERNS = {
    "email": rf"[A-Za-z0-9{ACCENTED}][A-Za-z0-9._%+{ACCENTED}-]{{0,63}}@[A-Za-z0-9{ACCENTED}][A-Za-z0-9{ACCENTED}-]*(?:\.[A-Za-z0-9{ACCENTED}-]+)*\.[A-Za-z]{{2,}}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
    "ipv4": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",
}
#: What may stand behind a value: no letter or digit, or the T of a time behind a date.
_TIME = r"T[0-9]{2}(?![A-Za-z0-9])"
_BEHIND = rf"(?:(?![A-Za-z0-9])|(?={_TIME}))"
_ANY = r"(?<![A-Za-z0-9])(?:" + "|".join(PATTERNS.values()) + ")" + _BEHIND
_BEGINS = "^(?:" + "|".join(p for kind, p in PATTERNS.items() if kind != "email") + r")"
#: Forms that are not taken for others: no separators, or those of printed cards; numbers of ten digits as 3, 3 and 4.
USUAL = {
    "card": r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}(?:\1[0-9]{4}){2}(?:\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}",
    "phone": r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",
}


def _hash(*parts: Column) -> Column:
    """60 bits of keyed SHA-256, as a long that is not negative."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, left: Column | int, right: Column | int, key: str, domain: Column) -> Column:
    """A keyed permutation of the longs 0 <= value < left * right; left and right are the sizes of the halves."""
    left, right = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (left, right))
    start = F.struct(_div(value, right).alias("a"), (value % right).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        word = _hash(F.lit(key), domain, i.cast("string"), F.when(i % 2 == 0, s["b"]).otherwise(s["a"]).cast("string"))
        a = F.when(i % 2 == 0, (s["a"] + word % left) % left).otherwise(s["a"])
        b = F.when(i % 2 == 0, s["b"]).otherwise((s["b"] + word % right) % right)
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["a"] * right + s["b"])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _power(base: int, n: Column) -> Column:
    powers = F.array(*[F.lit(base**i).cast("long") for i in range({10: 19, 26: 13, 400: 8}[base])])
    return F.element_at(powers, n.cast("int") + 1)


def permuted(symbols: Column, base: int, key: str, kind: str) -> Column:
    """A string of digits (base 10), lower-case letters (26) or accented letters (400), permuted in runs of at most 15, 10 or 7."""
    run, zero = {10: (15, 48), 26: (10, 97), 400: (7, 0xC0)}[base]
    alphabet = "".join(chr(zero + i) for i in range(base))

    def one(part: Column) -> Column:
        n = F.length(part)
        value = F.aggregate(F.split(part, ""), F.lit(0).cast("long"), lambda acc, c: acc * base + F.when(c == "", 0).otherwise(F.ascii(c) - zero))
        left = _power(base, F.floor(n / 2))
        mixed = feistel(value, left, _power(base, n - F.floor(n / 2)), key, F.concat_ws("|", F.lit(kind), n.cast("string")))
        letter = lambda m, i: F.lit(alphabet).substr((_div(m, _power(base, i)) % base + 1).cast("int"), F.lit(1))
        return let(mixed, lambda m: F.array_join(F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: letter(m, i)), ""))

    starts = F.sequence(F.lit(0), F.floor((F.length(symbols) - 1) / run).cast("int"))
    return F.when(F.length(symbols) > 0, F.array_join(F.transform(starts, lambda i: one(symbols.substr(i * run + 1, F.lit(run)))), "")).otherwise("")


def refilled(template: Column, of: str, symbols: Column) -> Column:
    """template with its characters of a class (a regular expression) replaced, in turn, by symbols; capitals stay capitals."""
    chars = F.filter(F.split(template, ""), lambda c: c != "")

    def put(acc: Column, c: Column, all_: Column) -> Column:
        new = all_.substr(acc["n"] + 1, F.lit(1))
        new = F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)
        ours = c.rlike(of)
        return F.struct((acc["n"] + ours.cast("int")).alias("n"), F.concat(acc["s"], F.when(ours, new).otherwise(c)).alias("s"))

    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("s"))
    return let(symbols, lambda all_: F.aggregate(chars, start, lambda acc, c: put(acc, c, all_), lambda acc: acc["s"]))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def remainder_97(text: Column) -> Column:
    """Digits and capitals (A is 10) read as one number, modulo 97."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )


def valid_card(v: Column) -> Column:
    d = digits_of(v)
    return d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)[0-9]{12,18}$") & F.call_function("luhn_check", d)


def card(v: Column, key: str) -> Column:
    d = digits_of(v)
    body = F.concat(d.substr(1, 1), permuted(F.substring(d, 2, 64).substr(F.lit(1), F.length(d) - 2), 10, key, "card"))

    def checked(b: Column) -> Column:
        check = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: F.call_function("luhn_check", F.concat(b, c.cast("string"))))
        return F.concat(b, F.get(check, F.lit(0)).cast("string"))

    return refilled(v, "[0-9]", let(body, checked))


def valid_iban(v: Column) -> Column:
    flat = F.replace(v, F.lit(" "), F.lit(""))
    return F.length(flat).between(15, 34) & (remainder_97(F.concat(F.substring(flat, 5, 30), F.substring(flat, 1, 4))) == 1)


def iban(v: Column, key: str) -> Column:
    flat = F.replace(v, F.lit(" "), F.lit(""))
    country, rest = F.substring(flat, 1, 2), F.substring(flat, 5, 30)
    rest = refilled(rest, "[0-9]", permuted(digits_of(rest), 10, key, "iban"))

    def checked(r: Column) -> Column:
        check = F.lpad((98 - remainder_97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, check, r)

    return refilled(v, "[0-9A-Z]", let(rest, checked))


def valid_ssn(v: Column) -> Column:
    return v.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def ssn(v: Column, key: str) -> Column:
    area, group, serial = (F.substring(v, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1)

    def written_out(m: Column) -> Column:
        place = _div(m, F.lit(99 * 9999).cast("long"))
        area = F.when(place >= 665, place + 2).otherwise(place + 1)
        parts = ((area, 3), (_div(m, F.lit(9999).cast("long")) % 99 + 1, 2), (m % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return let(feistel((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, F.lit("ssn")), written_out)


def valid_phone(v: Column) -> Column:
    n = F.length(digits_of(v))
    return F.when(v.startswith("+1"), n == 11).otherwise(n.between(9, 15))


def phone(v: Column, key: str) -> Column:
    """The last seven digits move, among numbers whose first of them is as here over 1 or not."""
    d = digits_of(v)
    before, last = F.substring(d, 1, 64).substr(F.lit(1), F.length(d) - 7), F.substring(d, -7, 7).cast("long")
    high, million = last >= 2_000_000, F.lit(1_000_000).cast("long")
    low = F.when(high, 2_000_000).otherwise(0).cast("long")
    mixed = feistel(last - low, F.when(high, 8).otherwise(2).cast("long"), million, key, F.concat_ws("|", F.lit("phone"), before, high.cast("string")))
    return refilled(v, "[0-9]", F.concat(before, F.lpad((mixed + low).cast("string"), 7, "0")))


def valid_ipv4(v: Column) -> Column:
    return v.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")


def ipv4(v: Column, key: str) -> Column:
    value = F.aggregate(F.split(v, "[.]"), F.lit(0).cast("long"), lambda acc, o: acc * 256 + o.cast("long"))
    octets = lambda m: F.concat_ws(".", *[(F.shiftright(m, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    return let(feistel(value, 1 << 16, 1 << 16, key, F.lit("ipv4")), octets)


def _date(v: Column) -> Column:
    """The date that is meant: year first, or day first, or else month first; null if it is none."""
    parts = F.split(v, "[-./]")
    a, b, c = (F.lpad(F.get(parts, F.lit(i)), 2, "0") if i < 2 else F.get(parts, F.lit(i)) for i in range(3))
    year_first = F.get(parts, F.lit(0)).rlike("^[0-9]{4}$")
    day_first = F.coalesce(F.concat_ws("-", c, b, a).try_cast("date"), F.concat_ws("-", c, a, b).try_cast("date"))
    return F.when(year_first, v.try_cast("date")).otherwise(day_first)


def valid_date(v: Column) -> Column:
    return F.coalesce(_date(v).between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date")), F.lit(False))


def date(v: Column, key: str) -> Column:
    """A day of the 73049 days of 1900 to 2099 (17 * 4297), written as here: order, separator, and zeros before single digits."""
    origin = F.lit("1900-01-01").cast("date")
    moved = F.date_add(origin, feistel(F.date_diff(_date(v), origin).cast("long"), 17, 4297, key, F.lit("date")).cast("int"))
    parts, mark = F.split(v, "[-./]"), F.regexp_extract(v, "[-./]", 0)
    month_first = F.concat_ws("-", F.get(parts, F.lit(2)), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(0)), 2, "0")).try_cast("date").isNull()
    bare = v.rlike("^[0-9][./]|[./][0-9][./]")

    def written_out(day: Column) -> Column:
        d, m = (F.when(bare, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0")) for x in (F.dayofmonth(day), F.month(day)))
        y = F.year(day).cast("string")
        return F.when(v.rlike("^[0-9]{4}"), F.concat_ws("-", y, m, d)).when(month_first, F.concat(m, mark, d, mark, y)).otherwise(F.concat(d, mark, m, mark, y))

    return let(moved, written_out)


def email(v: Column, key: str) -> Column:
    """The local part's letters, accented letters and digits move, each among their like."""
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    letters = permuted(F.lower(F.regexp_replace(local, "[^A-Za-z]", "")), 26, key, "email")
    plain = refilled(refilled(local, "[A-Za-z]", letters), "[0-9]", permuted(digits_of(local), 10, key, "email"))
    accented = permuted(F.regexp_replace(local, f"[^{ACCENTED}]", ""), 400, key, "email")
    new = let(plain, lambda p: F.when(local.rlike(f"[{ACCENTED}]"), refilled(p, f"[{ACCENTED}]", accented)).otherwise(p))
    return F.concat(new, F.lit("@"), domain)


_ALWAYS = lambda v: F.lit(True)
KINDS = {"email": (_ALWAYS, email), "iban": (valid_iban, iban), "card": (valid_card, card), "ipv4": (valid_ipv4, ipv4), "date": (valid_date, date), "ssn": (valid_ssn, ssn), "phone": (valid_phone, phone)}


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of one candidate; null where it is valid for no kind."""
    out = None
    for kind, (valid, make) in KINDS.items():
        test, then = v.rlike(f"^(?:{PATTERNS[kind]})$") & valid(v), make(v, key)
        out = F.when(test, then) if out is None else out.when(test, then)
    return out


def clear(v: Column) -> Column:
    """Whether a candidate is valid for a kind and has a form that takes in no neighbour."""
    out = F.lit(False)
    for kind, (valid, _) in KINDS.items():
        out = out | (v.rlike(f"^(?:{USUAL.get(kind, PATTERNS[kind])})$") & valid(v))
    return out


#: At one place: shapes that are fixed first, then all; of each the longest valid one.
_ORDER = [("card", USUAL), ("ssn", PATTERNS), ("date", PATTERNS), ("ipv4", PATTERNS), ("phone", USUAL), ("iban", PATTERNS), ("card", PATTERNS)]
_FIXED = [("ssn", PATTERNS), ("date", PATTERNS), ("ipv4", PATTERNS), ("phone", USUAL), ("card", USUAL)]
#: No candidate but a mail is longer: an IBAN in groups has 42 characters, a card 37, a telephone number 34.
LONGEST = 48
#: A mail, or all characters of other kinds that stand together, up to a boundary that is not within a mail.
_SPAN = rf"(?<![A-Za-z0-9])(?:{PATTERNS['email']}|[0-9A-Z+(][0-9A-Z ./()+-]*(?![A-Za-z0-9._%+{ACCENTED}-]{{0,64}}@[A-Za-z0-9{ACCENTED}]))(?![A-Za-z0-9])"


def _is(v: Column, kind: str, forms: dict[str, str]) -> Column:
    return v.rlike(f"^(?:{forms[kind]})$") & KINDS[kind][0](v)


def _starting(part: Column) -> Column:
    """The beginnings of a part that may be a value, longest first: up to a letter or digit that none follows, or a time does."""
    plain = lambda c: c.rlike("^[A-Za-z0-9]$")
    ends = lambda e: plain(part.substr(e, F.lit(1))) & part.substr(e + 1, F.lit(4)).rlike(f"^{_BEHIND}")
    ends = F.filter(F.sequence(F.lit(LONGEST), F.lit(1), F.lit(-1)), ends)
    return F.transform(ends, lambda e: part.substr(F.lit(1), e))


def _fixed(part: Column) -> Column:
    """Whether a value of fixed shape begins a part."""
    tests = lambda v: reduce(lambda a, b: a | b, [_is(v, *x) for x in _FIXED])
    return F.exists(_starting(part), tests)


def first_value(part: Column) -> Column:
    """The value that begins a part of a span; null if none does."""

    def choose(some: Column) -> Column:
        longest = lambda kind, forms: F.get(F.filter(some, lambda v: _is(v, kind, forms)), F.lit(0))
        phones = F.filter(some, lambda v: _is(v, "phone", PATTERNS))
        behind = lambda v: part.substr(F.length(v) + 1, F.lit(LONGEST + 2))
        # digits are all it is known by: it ends where a value of fixed shape follows
        cut = F.filter(F.reverse(phones), lambda v: behind(v).rlike("^[ .-][0-9(]") & let(behind(v).substr(2, LONGEST + 1), _fixed))
        return F.coalesce(*[longest(*x) for x in _ORDER], F.get(cut, F.lit(0)), F.get(phones, F.lit(0)))

    return let(_starting(part), choose)


def piece(s: Column, value: Column | bool) -> Column:
    return F.struct(s.alias("s"), (F.lit(value) if isinstance(value, bool) else value).alias("value"))


def pieces(span: Column) -> Column:
    """A span as an array of pieces (s, value) from left to right, read as the module says."""
    starts = F.filter(F.sequence(F.lit(1), F.length(span)), lambda i: span.substr(i, F.lit(1)).rlike("^[0-9A-Z+(]$") & ((i == 1) | ~span.substr(i - 1, F.lit(1)).rlike("^[A-Za-z0-9]$")))

    def step(acc: Column, i: Column) -> Column:
        def put(v: Column) -> Column:
            new = F.concat(acc["out"], F.array(piece(span.substr(acc["at"], i - acc["at"]), False), piece(v, True)))
            return F.when(v.isNull(), acc).otherwise(F.struct((i + F.length(v)).alias("at"), new.alias("out")))

        part = span.substr(i, F.lit(2 * LONGEST + 2))
        return F.when((i < acc["at"]) | ~part.rlike(_BEGINS), acc).otherwise(let(let(part, first_value), put))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<s:string,value:boolean>>").alias("out"))
    read = F.aggregate(starts, start, step, lambda acc: F.concat(acc["out"], F.array(piece(span.substr(acc["at"], F.length(span)), False))))
    return F.when(span.contains("@"), F.array(piece(span, True))).otherwise(read)


def between(gaps: Column, found: Column, of: Callable[[Column], Column]) -> Column:
    """The pieces of a text: its gaps, and between them what was found, each taken apart by of."""
    return F.flatten(F.transform(gaps, lambda g, i: F.concat(F.array(piece(g, False)), F.coalesce(of(F.get(found, i)), F.array().cast("array<struct<s:string,value:boolean>>")))))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the valid values in text replaced, and n_pseudonyms (long), how many were."""
    t = named(text)
    some = t.rlike(_ANY)
    found, parts, new = hidden(3)
    out = docs.withColumn(found, F.when(some, F.regexp_extract_all(t, F.lit(_ANY), F.lit(0))))
    close = F.exists(found, lambda v: ~clear(v))
    plain = between(F.split(t, _ANY, -1), F.col(found), lambda v: F.when(v.isNotNull(), F.array(piece(v, True))))
    read = let(F.regexp_extract_all(t, F.lit(_SPAN), F.lit(0)), lambda spans: between(F.split(t, _SPAN, -1), spans, lambda v: F.when(v.isNotNull(), pieces(v))))
    out = out.withColumn(parts, F.when(close, read).when(some, plain))
    out = out.withColumn(new, F.transform(parts, lambda p: F.when(p["value"], pseudonym(p["s"], key))))
    joined = F.array_join(F.transform(parts, lambda p, i: F.coalesce(F.get(new, i), p["s"])), "")
    count = F.coalesce(F.size(F.filter(new, lambda v: v.isNotNull())), F.lit(0))
    count = F.when(F.col(new).isNull(), 0).otherwise(count).cast("long")
    done = with_new(out, {"n_pseudonyms": count}).withColumn(text, F.coalesce(joined, t))
    return done.drop(found, parts, new)
