"""Names and addresses in normal form, as Column expressions without Python.

Three profiles: ``core`` folds to ASCII and deletes punctuation;
``script_preserving`` keeps each script, rewrites dotted legal forms and turns
punctuation into spaces; ``legacy`` is ``core`` with directions spelt out and
without deletion of stop words' initial occurrence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.fold import let, lookup, strip_marks, to_ascii


def entries(text: str) -> dict[str, str]:
    """``value < key key; ...`` as a map from key to value."""
    out = {}
    for part in " ".join(text.split()).split("; "):
        value, _, keys = part.partition(" < ")
        out |= dict.fromkeys(keys.split(), value)
    return out


_SHARED = """
academy < acad; administration < admin; association < assn assoc; authority < auth; board < bd; borough < boro; center < ctr;
college < coll; commission < comm; county < cty; department < dept; district < dist; division < div; elementary < elem;
federal < fed; fort < ft; government < govt; health < hlth; independent school district < isd; institute < inst;
international < intl; medical < med; metropolitan < metro; mount < mt; municipal < muni; national < natl; organization < org;
pharmaceutical < pharm; point < pt; school < sch; service < svc; services < svcs; township < twp; unified school district < usd;
university < univ; village < vlg"""
_FORMS = """
company < co; corporation < corp; incorporated < inc incorp; limitada < ltda; limited < ltd; limited liability company < llc;
limited liability partnership < llp; limited partnership < lp; national association < na; professional association < pa;
professional corporation < pc; professional limited liability company < pllc; public limited company < plc"""
#: Legal forms win over other words.
CORE_WORDS = entries(_SHARED + """; agency < agcy; center < cntr; committee < cmte; doing business as < dba; government < gov;
hospital < hosp; international < int; joint venture < ajv jv; national < nat; not for profit < nfp; regional < reg; saint < st;
school < schl""") | entries(_FORMS)  # fmt: skip
SCRIPT_WORDS = entries(_SHARED + """; biological < bio; brothers < bros; centre < ctre; chemical < chem; electric < elec;
enterprises < ent; financial < fin; group < grp; holdings < hldgs; industries < ind inds; insurance < ins; investment < inv;
investments < invs; junior < jr; management < mgmt mgt; manufacturer < mfr; manufacturing < mfg; properties < props;
regional < regl; senior < sr; systems < sys; technology < tech; utilities < util""") | entries(_FORMS + """;
aktiengesellschaft < ag; besloten vennootschap < bv; companies < cos; general partnership < gp; limitee < ltee;
gesellschaft mit beschrankter haftung < gmbh; naamloze vennootschap < nv; societe anonyme < sa""")  # fmt: skip
_STREETS = """
avenue < ave; boulevard < blvd; circle < cir; court < ct; drive < dr; east < e; expressway < expy; highway < hwy; lane < ln;
north < n; northeast < ne; northwest < nw; parkway < pkwy; place < pl; road < rd; south < s; southeast < se; southwest < sw;
street < st; trail < trl; west < w"""
CORE_STREETS = entries(_STREETS)
SCRIPT_STREETS = entries(_STREETS + "; apartment < apt; building < bldg; center < ctr; centers < ctrs; floor < fl; room < rm; square < sq; suite < ste; terrace < ter")
LEGACY_WORDS = CORE_WORDS | entries("north < n; south < s; east < e; west < w; sociedad anonima < sa")
STOP = "a an and at by for in of on the to".split()

#: ASCII characters that are neither letters, digits nor white space.
_SIGNS = "".join(c for c in map(chr, range(1, 128)) if not c.isalnum() and c not in " \t\n\x0b\f\r")

_UNIT = "(?i)\\b({})\\s*#?\\s*{}"
SECONDARY = [_UNIT.format(a, b) for a, b in (("suite|ste|ste\\.", "\\w+"), ("apartment|apt|apt\\.", "\\w+"), ("unit", "\\w+"), ("floor|flr|fl", "\\d+"), ("room|rm", "\\w+"), ("building|bldg", "\\w+"))] + ["#\\s*\\d+\\s*$"]
_dotted = "\\s*\\.\\s*".join
#: In this order; a later one only sees what earlier ones left.
DOTTED = [("(?i)\\b" + _dotted(f) + "\\s*\\.?\\b", f) for f in "bv gp llc llp lp nv pa pc plc pllc sa".split()] + [("(?i)\\bs\\s+a\\b", "sa")]
SCRIPT_SECONDARY = "(?i)" + "|".join(
    [f"\\b{a}{dot}\\s*#?\\s*{b}" for a, dot, b in (("apt", "\\.?", "\\w+"), ("apartment", "", "\\w+"), ("bldg", "\\.?", "\\w+"), ("building", "", "\\w+"), ("fl", "\\.?", "\\d+"), ("floor", "", "\\d+"))]
    + ["\\b#\\s*\\d+\\w*"] + [f"\\b{a}\\s*#?\\s*\\w+" for a in ("rm\\.?", "room", "ste\\.?", "suite")]
)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(x), "\\s+", " "))


def remove_punctuation(x: Column | str) -> Column:
    """Without what is neither an ASCII letter or digit nor white space. ASCII
    texts, the most, need no regular expression."""
    return let(col(x), lambda y: F.when(y.rlike("[^\\x01-\\x7F]"), F.regexp_replace(y, "[^A-Za-z0-9\\s]", "")).otherwise(F.translate(y, _SIGNS, "")))


def map_tokens(x: Column, table: dict[str, str], lower: bool = False) -> Column:
    """Words between single spaces, each replaced by its entry if it has one."""
    plain = {k: v for k, v in table.items() if k != v}
    one = lambda t: F.coalesce(lookup(plain, t, F.pmod(F.ascii(t), F.lit(26)), 26, lambda k: ord(k[0]) % 26), t)
    return F.array_join(F.transform(F.split(F.lower(x) if lower else x, " "), one), " ")


def expand_abbreviations(x: Column | str, table: dict[str, str] = CORE_WORDS) -> Column:
    return map_tokens(col(x), table, lower=True)


def remove_stop_words(x: Column | str, stop: list[str] = STOP, keep_initial: bool = False) -> Column:
    """Repeated other words stay; ``keep_initial`` spares the first word."""
    words = F.split(col(x), " ")
    on = (lambda t, i: (i == 0) | ~t.isin(stop)) if keep_initial else (lambda t: ~t.isin(stop))
    return F.array_join(F.filter(words, on), " ")


def _dotted_forms(x: Column, forms: list[tuple[str, str]]) -> Column:
    for pattern, form in forms:
        x = F.regexp_replace(x, pattern, form)
    return x


def normalize_legal_name(name: Column | str, profile: str = "core", stop_words: bool = True, keep_initial: bool = False) -> Column:
    """A legal name in normal form; null stays null, '' stays ''.

    ``stop_words`` and ``keep_initial`` are of the ``script_preserving``
    profile; the others always drop stop words wherever they are.
    """
    x = F.lower(col(name))
    if profile in ("core", "legacy"):
        x = collapse(remove_punctuation(to_ascii(x)))
        return collapse(remove_stop_words(collapse(expand_abbreviations(x, CORE_WORDS if profile == "core" else LEGACY_WORDS))))
    if profile != "script_preserving":
        raise ValueError(f"no profile {profile!r}")
    # Most names hold none of the rarer forms, and one search tells so.
    x = let(x, lambda y: F.when(y.rlike("|".join(p for p, _ in DOTTED[:-2])), _dotted_forms(y, DOTTED[:-2])).otherwise(y))
    x = _dotted_forms(x, DOTTED[-2:])
    x = collapse(F.regexp_replace(strip_marks(x), "(?U)[^\\p{IsAlphabetic}\\p{N}\\s]", " "))
    x = collapse(map_tokens(x, SCRIPT_WORDS))
    return collapse(remove_stop_words(x, keep_initial=keep_initial)) if stop_words else x


def remove_secondary_unit(address: Column | str) -> Column:
    """Without suite, flat, floor and the like; in this order, and as greedily
    as the rules say (``unit`` also takes the start of longer words)."""
    x = col(address)
    for p in SECONDARY:
        x = F.regexp_replace(x, p, "")
    return x


def normalize_address(address: Column | str, profile: str = "core", remove_secondary: bool = True) -> Column:
    x = F.lower(col(address))
    if profile in ("core", "legacy"):
        return F.trim(map_tokens(collapse(remove_punctuation(remove_secondary_unit(to_ascii(x)))), CORE_STREETS))
    x = strip_marks(x)
    if remove_secondary:
        x = F.regexp_replace(x, SCRIPT_SECONDARY, " ")
    return collapse(map_tokens(collapse(F.regexp_replace(x, "(?U)[^\\p{IsAlphabetic}\\p{N}\\s]", " ")), SCRIPT_STREETS))


def simple_name(name: Column | str) -> Column:
    """Lower case, trimmed."""
    return F.lower(F.trim(col(name)))


def fallback_name(name: Column | str) -> Column:
    """Lower case, white space collapsed."""
    return collapse(F.lower(col(name)))


def word_count(x: Column | str) -> Column:
    return let(collapse(x), lambda y: F.when(y == "", 0).otherwise(F.size(F.split(y, " "))))


def slug(x: Column | str) -> Column:
    """Lower-case ASCII letters and digits, single '-' in between."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(x))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def entity_type_of(name: Column | str) -> Column:
    """A guess at the type of an entity, from words in its normalized name."""
    rules = [("\\bschool district\\b", "school_district"), ("\\b(university|college)\\b", "higher_education"), ("^(city|town|village|county|township)\\b|\\b(city|county|township)$", "municipality"), ("\\b(department|agency|authority|commission)\\b", "agency"), ("\\bfoundation\\b|\\bnot profit\\b", "nonprofit"), ("\\b(pac|committee)\\b", "political_committee"), ("\\b(incorporated|corporation|company|limited)\\b", "business")]

    def kind_of(n: Column) -> Column:
        out = F.when(n.isNull(), F.lit(None))
        for pattern, kind in rules:
            out = out.when(n.rlike(pattern), kind)
        return out.otherwise("other")

    return let(col(name), kind_of)


def normalize_ein(x: Column | str) -> Column:
    """Nine digits, hyphens and spaces taken out; null for anything else."""
    d = F.regexp_replace(col(x), "[-\\s]", "")
    return F.when(d.rlike("^[0-9]{9}$"), d)


def fold_key(x: str) -> str:
    """A jurisdiction's key: 'US-IL' as 'us/il'."""
    return re.sub("-", "/", x.strip()).lower()
