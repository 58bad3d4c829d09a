"""The same rules in another engine's SQL, for the oracles: built from chains of
text functions and CASE expressions, not from the Column functions."""

from __future__ import annotations

import re

from rollcall.functions import fold, localize, normalize


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def collapse(x: str) -> str:
    return f"trim({sub(x, chr(92) + 's+', ' ')})"


def ascii_fold(x: str) -> str:
    one, many = fold.tables()
    t = f"translate({x}, {q(''.join(one))}, {q(''.join(one.values()))})"
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in many.items())
    per = f"array_to_string(list_transform(regexp_extract_all({t}, '[^\\x00-\\x7F]|[\\x00-\\x7F]+'), lambda c: CASE c {cases} ELSE c END), '')"
    return f"CASE WHEN regexp_matches({x}, '[^\\x00-\\x7F]') THEN {sub(per, '[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} ELSE {x} END"


def tokens(x: str, table: dict[str, str], lower: bool = False) -> str:
    if not table:
        return x
    t = "lower(t)" if lower else "t"
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda t: CASE {t} {cases} ELSE {t} END), ' ')"


def without(x: str, stop) -> str:
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda t: t NOT IN ({', '.join(map(q, sorted(stop)))})), ' ')"


def legal_name(x: str, plain: bool = True) -> str:
    """``plain``: the names are ASCII, which needs no folding."""
    f = f"lower({x})" if plain else ascii_fold(f"lower({x})")
    y = collapse(sub(f, "[^A-Za-z0-9\\s]"))
    return collapse(without(collapse(tokens(y, normalize.CORE_WORDS, True)), normalize.STOP))


def script_name(x: str) -> str:
    y = f"lower({x})"
    for p, f in normalize.DOTTED:
        y = sub(y, p, f)
    a, b = fold.marks()
    y = collapse(sub(f"translate({y}, {q(a)}, {q(b)})", "[^\\pL\\pN\\s]", " "))
    return collapse(without(collapse(tokens(y, normalize.SCRIPT_WORDS)), normalize.STOP))


def secondary(x: str) -> str:
    for p in normalize.SECONDARY:
        x = sub(x, p)
    return x


def address(x: str) -> str:
    return f"trim({tokens(collapse(sub(secondary(f'lower({x})'), '[^A-Za-z0-9' + chr(92) + 's]')), normalize.CORE_STREETS)})"


def date(x: str) -> str:
    part = lambda i: f"regexp_extract(trim({x}), '^(\\d{{1,2}})[/-](\\d{{1,2}})[/-](\\d{{4}})$', {i})"
    ok = f"TRY_CAST({part(1)} AS INT) BETWEEN 1 AND 12 AND TRY_CAST({part(2)} AS INT) BETWEEN 1 AND 31"
    return (
        f"CASE WHEN regexp_matches(trim({x}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN trim({x}) WHEN {ok} THEN {part(3)} || '-' || lpad({part(1)}, 2, '0') || '-' || lpad({part(2)}, 2, '0') "
        f"WHEN regexp_matches(trim({x}), '^\\d{{4}}$') THEN trim({x}) || '-01-01' END"
    )


def hash_string(name: str, country: str, addr: str = "NULL", day: str = "NULL") -> str:
    return f"coalesce({legal_name(name)}, '') || '|' || coalesce({address(addr) if addr != 'NULL' else 'NULL'}, '') || '|' || upper({country}) || '|' || coalesce({date(day) if day != 'NULL' else 'NULL'}, '')"


def localized(x: str, jurisdiction: str) -> str:
    c = localize.merged(localize.chain(jurisdiction))
    y = f"lower({x})"
    for k, v in localize.longest_first(c.agencies):
        y = sub(y, "(?i)\\b" + re.escape(k).replace("\\ ", " ").replace("\\-", "-") + "\\b", v)
    y = collapse(tokens(collapse(y), {k: v for k, v in c.words.items() if " " not in k}))
    for k, v in localize.longest_first(c.types):
        y = sub(y, "(?i)\\b" + re.escape(k).replace("\\ ", " ").replace("\\-", "-") + "\\b", v)
    y = collapse(y)
    for r in c.rules:
        y = collapse(sub(y, "(?i)" + r.pattern, r.replacement) if r.is_regex else f"replace({y}, {q(r.pattern.lower())}, {q(r.replacement)})")
    return without(y, c.stop) if c.stop else y
