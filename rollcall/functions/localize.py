"""Names in the words of their jurisdiction, compiled to Column expressions.

A jurisdiction's configuration is merged with those of its parents (a child's
word wins, rules follow the parents'), and compiled once into a chain of
expressions: agency names, abbreviations, entity types, rules, stop words. Where
several names of a table match, the longest comes first, then code-point order,
so the result doesn't depend on chance.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from hashlib import sha256
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.fold import let, lookup
from rollcall.functions.normalize import col, fold_key

BASE = "base"
MAX_HOPS = 50


@dataclass(frozen=True)
class Rule:
    pattern: str
    replacement: str
    is_regex: bool = False
    enabled: bool = True
    case_sensitive: bool = False
    order: int | None = None


@dataclass
class Config:
    key: str
    parent: str | None = None
    words: dict[str, str] = field(default_factory=dict)
    agencies: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    stop: set[str] = field(default_factory=set)
    config_hash: str | None = None


def _dots(form: str) -> str:
    """A form whose letters may have dots and gaps: 'sa' also as 's. a.'."""
    return "\\b" + "\\s*".join(c + "\\.?" for c in form) + "\\b"


def _any(*forms: str) -> str:
    """Alternatives: a bare form has optional dots, '=x' is the word x."""
    return "|".join("\\b" + f[1:] + "\\b" if f[0] == "=" else _dots(f) for f in forms)


def _r(pattern: str, to: str = "") -> Rule:
    return Rule(pattern, to, True)


_NUMBER = _r("\\s0?[0-9]{1,2}\\s*$")
_COMMA = Rule(",", " ")
_TIDY = [_COMMA, _r("[,.;:]+\\s*$"), _r("\\s+", " "), _r("^\\s+|\\s+$")]
_SIGNS = [_r("[-_]{2,}", " "), _r("\\s*&\\s*", " & ")]
_BRACKETS = "\\s*\\(\\s*haftungsbeschraenkt\\s*\\)\\b"
_SLASH = lambda a: f"\\b{a}\\s*/\\s*s\\b"
#: Legal forms by country: replacement and pattern.
_EU = {
    "at": [(f, _dots(f)) for f in ("gmbh", "ag", "og", "kg")],
    "be": [("sa", _any("sa", "nv")), ("bv", _dots("bv")), ("srl", _dots("srl"))],
    "cz": [(f, _dots(f)) for f in ("sro", "as")],
    "de": [("gmbh", _dots("gmbh")), ("ggmbh", "\\bgg\\.?\\s*m\\.?\\s*b\\.?\\s*h\\.?\\b"), ("ag", _any("=aktiengesellschaft", "ag")), ("ug", f"\\bunternehmergesellschaft{_BRACKETS}|\\bug{_BRACKETS}|\\bug\\b"), ("kg", _any("=kommanditgesellschaft", "kg")), ("ohg", _any("=offene\\s+handelsgesellschaft", "ohg")), ("ev", _dots("ev"))],
    "dk": [("as", _SLASH("a")), ("aps", _SLASH("ap")), ("is", _SLASH("i"))],
    "es": [("sa", _dots("sa")), ("sl", _dots("sl")), ("slu", _dots("slu")), ("ute", "\\bute\\b")],
    "fi": [(f, f"\\b{f}\\b") for f in ("oyj", "oy", "ky", "ay")],
    "fr": [("sa", _dots("sa")), ("sas", _any("sas", "sasu")), ("sarl", _any("sarl", "sàrl") + "|\\bs\\.?\\s*a\\.?\\s*rl\\b")] + [(f, _dots(f)) for f in ("eurl", "snc", "sci")],
    "gr": [(f, _any(g, "=" + f, f)) for f, g in (("ae", "αε"), ("epe", "επε"), ("ike", "ικε"), ("oe", "οε"), ("ee", "εε"))],
    "ie": [("plc", _dots("plc")), ("ltd", "\\bltd\\.?\\b"), ("clg", "\\bclg\\b")],
    "it": [("spa", _dots("spa")), ("srl", _any("srl", "=srl")), ("snc", _dots("snc")), ("sas", _dots("sas")), ("coop", "\\bsoc\\.?\\s*coop\\.?\\b|\\bcooperativa\\b")],
    "lu": [("sa", _dots("sa")), ("sarl", "\\bs\\.?\\s*à\\s*r\\.?\\s*l\\.?\\b|" + _dots("sarl"))],
    "nl": [(f, _dots(f)) for f in ("bv", "nv", "vof", "cv")] + [(w, f"\\b{w}\\b") for w in ("stichting", "vereniging")],
    "pl": [("spzoo", "\\bsp\\.?\\s*z\\.?\\s*o\\.?\\s*o\\.?\\b"), ("sa", _dots("sa")), ("spk", "\\bsp\\.?\\s*k\\.?\\b"), ("spj", "\\bsp\\.?\\s*j\\.?\\b")],
    "pt": [("lda", "\\blda\\.?\\b"), ("sa", _dots("sa"))],
    "se": [(f, f"\\b{f}\\b") for f in ("ab", "hb", "kb")],
}
RULES: dict[str, list[Rule]] = {
    "us": [_COMMA, _r("[,.;]+\\s*$"), _NUMBER, _r("\\blimited[.,]\\s*$", "limited"), _r("\\s*\\(usa\\)\\s*$")],
    "us/il": [_r(f"\\b{f}\\.?\\s*$", "company" if f == "co" else f) for f in ("inc", "llc", "corp", "co")] + [_r("\\|\\s*cleaned-up"), _NUMBER, Rule("joint venture", "joint venture")],
    "us/ma": [_COMMA, _r("\\s+", " "), _r("\\bdept\\b", "department")],
    "ca/qc": [Rule(a, b) for a, b in zip("éèêëàâôîïûùç", "eeeeaaoiiuuc", strict=True)],
    "eu": [*_TIDY, _r("\\s*[\\(\\[]\\s*eu\\s*[\\)\\]]\\s*$"), *_SIGNS],
} | {f"eu/{c}": [*_TIDY, *_SIGNS, *(_r(p, f) for f, p in forms)] for c, forms in _EU.items()}


def parse(text: str) -> dict[str, Config]:
    """Configurations from the format of ``data/jurisdictions.txt``."""
    out: dict[str, Config] = {}
    now = None
    for line in text.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        if line.startswith("["):
            key, _, parent = line[1:].partition("]")
            now = out[key] = Config(fold_key(key), fold_key(parent) or None)
            continue
        kind, _, rest = line.partition(":")
        parts = [p.strip() for p in rest.split(" | ")]
        if kind == "stop":
            now.stop |= {p.lower() for p in parts}
        else:
            table = {"word": now.words, "agency": now.agencies, "type": now.types}[kind]
            table |= {k.strip().lower(): v.strip().lower() for k, _, v in (p.partition(" = ") for p in parts)}
    return out


_KINDS = {"abbreviations": "words", "agency_names": "agencies", "entity_types": "types"}


def from_mapping(raw: dict) -> Config:
    """A configuration from a parsed document: jurisdiction, parent,
    abbreviations, agency_names, entity_types, rules (pattern, replacement,
    is_regex, case_sensitive, enabled, order), stop_words. Unknown keys are passed
    over; one that lacks its jurisdiction, or a rule without pattern or
    replacement, is a ValueError."""
    if not isinstance(raw, dict) or not raw.get("jurisdiction"):
        raise ValueError("a configuration needs a jurisdiction")
    key = fold_key(str(raw["jurisdiction"]))
    c = Config(key, fold_key(str(raw["parent"])) if raw.get("parent") else None)
    for name, field_ in _KINDS.items():
        table = {str(k).strip().lower(): str(v).strip().lower() for k, v in (raw.get(name) or {}).items()}
        setattr(c, field_, table)
    for r in raw.get("rules") or []:
        if "pattern" not in r or "replacement" not in r:
            raise ValueError(f"a rule of {key} lacks its pattern or replacement")
        c.rules.append(Rule(str(r["pattern"]), str(r["replacement"]), bool(r.get("is_regex", False)), bool(r.get("enabled", True)), bool(r.get("case_sensitive", False)), r.get("order")))
    c.stop = {str(x).lower() for x in raw.get("stop_words") or []}
    c.config_hash = hashed(c)
    return c


def read_configs(folder: str | Path) -> dict[str, Config]:
    """Configurations of the YAML and JSON files below a folder, by key; on the
    driver, as plans are compiled from them."""
    found = {}
    for path in sorted(Path(folder).rglob("*")):
        if path.suffix in (".yaml", ".yml"):
            import yaml  # optional: only those who have YAML files need it

            raw = yaml.safe_load(path.read_text("utf-8"))
        elif path.suffix == ".json":
            raw = json.loads(path.read_text("utf-8"))
        else:
            continue
        c = from_mapping(raw)
        found[c.key] = c
    found.setdefault(BASE, Config(BASE))
    return found


def stamped(raw: dict, updated: str) -> dict:
    """A configuration document with its hash; one whose hash has changed gets
    its patch version raised and ``updated`` as its time."""
    h = from_mapping(raw).config_hash
    if raw.get("config_hash") == h:
        return raw
    major, minor, patch = (str(raw.get("version") or "0.0.0").split(".") + ["0", "0"])[:3]
    return raw | {"config_hash": h, "version": f"{major}.{minor}.{int(patch) + 1}", "updated_timestamp": updated}


def hashed(c: Config) -> str:
    """SHA-256 of a configuration in canonical JSON."""
    body = {"abbreviations": c.words, "agency_names": c.agencies, "entity_types": c.types, "jurisdiction": c.key, "parent": c.parent, "rules": [[r.pattern, r.replacement, r.is_regex] for r in c.rules], "stop_words": sorted(c.stop)}
    return sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@lru_cache
def corpus() -> dict[str, Config]:
    found = parse((Path(__file__).resolve().parents[1] / "data" / "jurisdictions.txt").read_text("utf-8"))
    found.setdefault(BASE, Config(BASE))
    for key, rules in RULES.items():
        found[key].rules = rules
    for c in found.values():
        c.config_hash = hashed(c)
    return found


def chain(key: str, configs: dict[str, Config] | None = None) -> list[str]:
    """Keys of the configurations that apply, parents first. An unknown key
    falls back to its second-to-last segment, as a last resort to the base."""
    configs = corpus() if configs is None else configs
    key, seen = fold_key(key), []
    while len(seen) < MAX_HOPS:
        if key in configs and key not in seen:
            seen.append(key)
            if key == BASE:
                break
            key = configs[key].parent or BASE
        elif "/" in key:
            key = key.split("/")[-2]
        elif key != BASE and BASE not in seen:
            key = BASE
        else:
            break
    return seen[::-1]


def merged(keys: list[str], configs: dict[str, Config] | None = None) -> Config:
    configs = corpus() if configs is None else configs
    out = Config(keys[-1] if keys else BASE)
    for c in (configs[k] for k in keys):
        out.words = out.words | c.words
        out.agencies = out.agencies | c.agencies
        out.types = out.types | c.types
        out.rules = out.rules + c.rules
        out.stop = out.stop | c.stop
    order = sorted(range(len(out.rules)), key=lambda i: (out.rules[i].order if out.rules[i].order is not None else 1 << 31, i))
    out.rules = [out.rules[i] for i in order if out.rules[i].enabled]
    return out


def longest_first(table: dict[str, str]) -> list[tuple[str, str]]:
    return sorted(table.items(), key=lambda e: (-len(e[0]), e[0]))


def _collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "(?U)\\s+", " "))


def _phrases(x: Column, table: dict[str, str]) -> Column:
    """Whole phrases, one entry after another; names without any are spared."""
    if not table:
        return x
    rows = [(re.escape(k).replace("\\-", "-").replace("\\ ", " "), v) for k, v in longest_first(table)]
    replaced = lambda y: reduce(lambda c, e: F.regexp_replace(c, f"(?iU)\\b{e[0]}\\b", e[1]), rows, y)
    return let(x, lambda y: F.when(y.rlike("(?iU)\\b(" + "|".join(e[0] for e in rows) + ")\\b"), replaced(y)).otherwise(y))


def compiled(name: Column | str, config: Config) -> Column:
    """The chain of expressions of a merged configuration."""
    x = F.lower(col(name))
    if config.agencies:
        x = _phrases(x, config.agencies)
    x = _collapse(x)
    words = {k: v for k, v in config.words.items() if " " not in k and k != v}
    if words:
        x = F.array_join(F.transform(F.split(x, " "), lambda t: F.coalesce(lookup(words, t, F.pmod(F.ascii(t), F.lit(26)), 26, lambda k: ord(k[0]) % 26), t)), " ")
    x = _collapse(_phrases(x, config.types))
    for r in config.rules:
        if r.is_regex:
            x = F.regexp_replace(x, ("(?U)" if r.case_sensitive else "(?iU)") + r.pattern, r.replacement)
        else:
            x = F.replace(x, F.lit(r.pattern if r.case_sensitive else r.pattern.lower()), F.lit(r.replacement))
        x = _collapse(x)
    if config.stop:
        x = F.array_join(F.filter(F.split(x, " "), lambda t: ~t.isin(sorted(config.stop))), " ")
    return x


def apply_localization(name: Column | str, jurisdiction: str, configs: dict[str, Config] | None = None) -> Column:
    """A name in the words of one jurisdiction; ``configs`` as ``read_configs``
    gives them, else the package's own."""
    return compiled(name, merged(chain(jurisdiction, configs), configs))


def jurisdiction_key(x: Column | str) -> Column:
    return F.lower(F.replace(F.trim(col(x)), F.lit("-"), F.lit("/")))


def _cases(jurisdictions: list[str] | None) -> list[str]:
    """Keys that are told apart, then the roots that others fall back to."""
    return list(dict.fromkeys(fold_key(x) for x in (sorted(corpus()) if jurisdictions is None else jurisdictions)))


def _by_jurisdiction(key: Column, value, jurisdictions: list[str] | None = None) -> Column:
    """``value(jurisdiction)`` of the row's jurisdiction. One that isn't among
    ``jurisdictions`` (all by default), and null, has its root's where that is
    known ('us/xx' that of 'us'), else the base's."""
    case = None
    for j in _cases(jurisdictions):
        case = (F.when if case is None else case.when)(key == j, value(j))
    for root in sorted({k.split("/")[0] for k in corpus()} - {BASE}):
        case = (F.when if case is None else case.when)(key.rlike(f"^{root}(/[^/]*)?$"), value(root))
    return case.otherwise(value(BASE))


def localized_by(name: Column | str, jurisdiction: Column | str, jurisdictions: list[str] | None = None) -> Column:
    """The localized name, by the row's jurisdiction. ``jurisdictions`` may name
    those that occur, so that only their chains are compiled."""
    return _by_jurisdiction(jurisdiction_key(jurisdiction), lambda j: apply_localization(name, j), jurisdictions)


def provenance(jurisdiction: Column | str, jurisdictions: list[str] | None = None) -> Column:
    """(requested_key, resolved_keys, resolved_hashes), parents first."""
    def of(j: str) -> Column:
        c = chain(j)
        return F.struct(F.array(*map(F.lit, c)).alias("k"), F.array(*[F.lit(corpus()[x].config_hash) for x in c]).alias("h"))

    key = jurisdiction_key(jurisdiction)
    found = _by_jurisdiction(key, of, jurisdictions)
    return F.struct(key.alias("requested_key"), found["k"].alias("resolved_keys"), found["h"].alias("resolved_hashes"))


def detailed_json(name: Column | str, jurisdiction: Column | str, jurisdictions: list[str] | None = None) -> Column:
    """The localized name and its provenance as JSON."""
    p = provenance(jurisdiction, jurisdictions)
    return F.to_json(F.struct(localized_by(name, jurisdiction, jurisdictions).alias("output"), p["requested_key"].alias("requested_key"), p["resolved_keys"].alias("resolved_keys"), p["resolved_hashes"].alias("resolved_hashes")))


def localize(df: DataFrame, name: str, jurisdiction: str, jurisdictions: list[str] | None = None, out: str = "localized") -> DataFrame:
    """``df`` with ``out``: the localized name."""
    return df.withColumn(out, localized_by(name, jurisdiction, jurisdictions))


def localize_detailed(df: DataFrame, name: str, jurisdiction: str, jurisdictions: list[str] | None = None) -> DataFrame:
    """``localize`` and its provenance: requested_key, resolved_keys (parents
    first) and resolved_hashes."""
    return localize(df.withColumn("_p", provenance(jurisdiction, jurisdictions)), name, jurisdiction, jurisdictions).select(*df.columns, "localized", "_p.*")


def apply_rules_trace(name: str, jurisdiction: str) -> list[dict[str, str]]:
    """What each rule of a jurisdiction makes of one name, on the driver: for
    rule authors, not for tables."""
    x, out = " ".join(name.lower().split()), []
    for r in merged(chain(jurisdiction)).rules:
        y = re.sub(r.pattern, r.replacement, x, flags=0 if r.case_sensitive else re.IGNORECASE) if r.is_regex else x.replace(r.pattern.lower(), r.replacement)
        y = " ".join(y.split())
        if y != x:
            out.append({"pattern": r.pattern, "before": x, "after": y})
        x = y
    return out


def config_table(spark: SparkSession, configs: dict[str, Config] | None = None) -> DataFrame:
    """(key, parent, config_hash, words, agencies, types, rules, stop_words)."""
    configs = corpus() if configs is None else configs
    rows = [(c.key, None if c.key == BASE else (c.parent or BASE), c.config_hash, len(c.words), len(c.agencies), len(c.types), len(c.rules), len(c.stop)) for c in configs.values()]
    return spark.createDataFrame(rows, "key string, parent string, config_hash string, words int, agencies int, types int, rules int, stop_words int")
