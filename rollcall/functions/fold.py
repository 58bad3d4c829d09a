"""Folding of text without a Unicode function: the decompositions of Python's
``unicodedata`` in bucketed maps. The distinct characters of a row that aren't
ASCII are few; each is replaced at once. ASCII rows, the most, skip it all."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_ASCII = "[^\\x00-\\x7F]"
BUCKETS = 64
#: Letters that have no decomposition.
SPECIAL = dict(zip("ßæœøðþ", "ss ae oe o d th".split(), strict=True))


def let(x: Column, body) -> Column:
    """``body(x)``, for which ``x`` is evaluated once however often it is named;
    as a plain expression it is once for each of its places."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


@lru_cache
def tables() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that fold to one ASCII character, and to several."""
    one, many = {}, {}
    for code in range(128, 0x110000):
        if 0xAC00 <= code < 0xD7B0 or 0xD800 <= code < 0xE000 or 0x4E00 <= code < 0xA000:
            continue
        c = chr(code)
        to = SPECIAL.get(c) or "".join(SPECIAL.get(x, x if x < "\x80" else "") for x in unicodedata.normalize("NFKD", c))
        if len(to) == 1:
            one[c] = to
        elif to:
            many[c] = to
    return one, many


def lookup(entries: dict[str, str], key: Column, bucket: Column, buckets: int, place) -> Column:
    """The value of ``key``, or null. A map's search is linear, so the entries
    are dealt to an array of small maps, of which ``bucket`` picks one."""
    dealt: list[list[str]] = [[] for _ in range(buckets)]
    for k, v in sorted(entries.items()):
        dealt[place(k)] += [_literal(k), _literal(v)]
    # As one text, which is parsed at once, and not as a call for each entry.
    table = F.expr("array(" + ", ".join("map(" + (", ".join(d) or "'', ''") + ")" for d in dealt) + ")")
    return F.try_element_at(F.get(table, bucket), key)


def _literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(x: Column, entries: dict[str, str], found: Column) -> Column:
    """``x`` with each of its ``found`` characters replaced by its entry; one
    without stays. The few there are of a kind are replaced one after another."""
    place = lambda c: F.pmod(F.ascii(c), F.lit(BUCKETS))
    value = lambda c: lookup(entries, c, place(c), BUCKETS, lambda k: ord(k) % BUCKETS)
    return F.aggregate(F.array_distinct(found), x, lambda y, c: F.coalesce(F.replace(y, c, value(c)), y))


def to_ascii(x: Column) -> Column:
    """Compatibility decomposition; what isn't ASCII then is dropped."""
    one, many = tables()
    rest = lambda y: F.split(F.regexp_replace(y, "[\\x00-\\x7F]+", ""), "")
    return let(x, lambda y: F.when(y.rlike(NON_ASCII), F.regexp_replace(_replaced(y, one | many, rest(y)), NON_ASCII + "+", "")).otherwise(y))


@lru_cache
def marks() -> tuple[str, str]:
    """Letters of any script with a canonical decomposition whose first
    character is a letter and whose others are marks; and those letters."""
    a, b = [], []
    for code in range(128, 0x30000):
        if 0xAC00 <= code < 0xD7B0 or 0xD800 <= code < 0xE000:
            continue
        d = unicodedata.normalize("NFD", chr(code))
        if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:]):
            a.append(chr(code))
            b.append(d[0])
    return "".join(a), "".join(b)


def jamo(x: Column) -> Column:
    """Hangul syllables as the letters they are made of."""
    utf8 = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")

    def letters(c: Column) -> Column:
        s = F.ascii(c) - 0xAC00
        last = F.when(s % 28 > 0, utf8(F.lit(0x11A7) + s % 28)).otherwise("")
        return F.concat(utf8(F.lit(0x1100) + F.floor(s / 588)), utf8(F.lit(0x1161) + F.floor(s % 588 / 28)), last)

    syllables = lambda z: F.array_distinct(F.split(F.regexp_replace(z, "[^\\uAC00-\\uD7A3]+", ""), ""))
    return let(x, lambda z: F.when(z.rlike("[\\uAC00-\\uD7A3]"), F.aggregate(syllables(z), z, lambda y, c: F.when(c == "", y).otherwise(F.replace(y, c, letters(c))))).otherwise(z))


COMBINING = "[\\u0300-\\u036F\\u1AB0-\\u1AFF\\u1DC0-\\u1DFF\\u20D0-\\u20FF\\uFE20-\\uFE2F]"


@lru_cache
def compositions() -> tuple[dict[str, str], dict[str, str]]:
    """A letter with its marks, in canonical order, and the one character for
    it; and characters that always stand for another one."""
    joined, single = {}, {}
    for code in range(128, 0x30000):
        c = chr(code)
        if 0xAC00 <= code < 0xD7B0 or 0xD800 <= code < 0xE000:
            continue
        if unicodedata.normalize("NFC", c) != c:
            single[c] = unicodedata.normalize("NFC", c)
            continue
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1:
            for k in range(1, len(d)):  # a part may be composed already
                head = unicodedata.normalize("NFC", d[:k])
                joined[head + d[k:]] = c
    return joined, single


def nfc(x: Column) -> Column:
    """Canonical composition of letters and the marks after them, up to the
    longest that is one character; marks in another than the canonical order,
    and Hangul letters, stay as they are."""
    joined, single = compositions()
    at = lambda table, c: lookup(table, c, F.pmod(F.ascii(c), F.lit(BUCKETS)), BUCKETS, lambda k: ord(k[0]) % BUCKETS)
    heads = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(x, F.lit(f"([^\\x00-\\x1F])({COMBINING}+)"), F.lit(0)), lambda c: F.transform(F.reverse(F.sequence(F.lit(2), F.length(c))), lambda k: F.substring(c, F.lit(1), k)))))
    y = F.aggregate(heads, x, lambda y, c: F.coalesce(F.replace(y, c, at(joined, c)), y))
    alone = F.array_distinct(F.split(F.regexp_replace(y, "[\\x00-\\x7F]+", ""), ""))
    y = F.aggregate(alone, y, lambda z, c: F.coalesce(F.replace(z, c, at(single, c)), z))
    return F.when(x.rlike(NON_ASCII), y).otherwise(x)


def strip_marks(x: Column) -> Column:
    """Without combining marks, but in its own script; typographic quotes go,
    dashes become '-', the ellipsis three dots; control characters go."""
    a, b = marks()
    t = let(x, lambda y: F.when(y.rlike(NON_ASCII), F.regexp_replace(jamo(F.translate(y, a, b)), "[\\u0300-\\u036F\\u1AB0-\\u1AFF\\u1DC0-\\u1DFF\\u20D0-\\u20FF\\uFE20-\\uFE2F]", "")).otherwise(y))
    t = F.regexp_replace(F.translate(t, "‐‑‒–—− ", "------ "), "[‘’‚‛“”„‟]", "")
    return F.regexp_replace(F.replace(t, F.lit("…"), F.lit("...")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]", "")
