"""Identifiers: validation, priority, and entity hashes with confidence.

An entity's hash is the SHA-256 of ``name|address|COUNTRY|date`` in normal
form. Identifier namespaces are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.canonical import canonical_json, hash_text
from rollcall.functions.dates import registration_date
from rollcall.functions.fold import let
from rollcall.functions.normalize import col, normalize_address, normalize_legal_name, slug, word_count

#: Prefixes of verifiable identifiers, by scheme, in order of priority.
PREFIXES = {"lei": "entity:lei:", "uei": "entity:uei:", "hash": "entity:hash:", "bn": "entity:bn:", "other": "entity:other:"}


def _matching(x: Column | str, pattern: str) -> Column:
    t = F.upper(F.trim(col(x)))
    return F.when(t.rlike(pattern), t)


def lei(x: Column | str) -> Column:
    """A legal entity identifier in upper case; null if it isn't one."""
    return _matching(x, "^[A-Z0-9]{20}$")


def uei(x: Column | str) -> Column:
    return _matching(x, "^[A-Z0-9]{12}$")


def business_number(x: Column | str) -> Column:
    return _matching(x, "^[0-9]{9}[A-Z]{2}[0-9]{4}$")


def strict_hash(x: Column | str) -> Column:
    """64 lower-case hex digits; upper case is refused."""
    return F.when(col(x).rlike("^[0-9a-f]{64}$"), col(x))


def verifiable_id(entity_hash: Column | str, prefix: str = PREFIXES["hash"]) -> Column:
    return F.concat(F.lit(prefix), col(entity_hash))


def short_hash(x: Column | str, n: int = 12) -> Column:
    x = col(x)
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def primary_identifier(lei_: Column | None = None, uei_: Column | None = None, entity_hash: Column | None = None, bn: Column | None = None, additional: Column | None = None, prefixes: dict[str, str] = PREFIXES) -> Column:
    """The best identifier with its prefix; ``additional`` is an array of
    (scheme_uri, value), whose first is the last choice."""
    given = [(p, c) for p, c in (("lei", lei_), ("uei", uei_), ("hash", entity_hash), ("bn", bn)) if c is not None]
    parts = [F.concat(F.lit(prefixes[p]), c) for p, c in given]
    if additional is not None:
        first = F.get(additional, F.lit(0))
        parts.append(F.concat(F.lit(prefixes["other"]), first["scheme_uri"], F.lit(":"), first["value"]))
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def has_any_identifier(*ids: Column, additional: Column | None = None) -> Column:
    out = F.lit(False)
    for c in ids:
        out = out | c.isNotNull()
    return out | (F.coalesce(F.size(additional), F.lit(0)) > 0) if additional is not None else out


def sorted_schemes(additional: Column) -> Column:
    """(scheme_uri, value) in order."""
    return F.array_sort(additional)


def canonical_identifiers(lei_: Column, uei_: Column, entity_hash: Column, bn: Column, additional: Column) -> Column:
    """Canonical JSON of all identifiers."""
    schemes = T.ArrayType(T.StructType([T.StructField("scheme_uri", T.StringType()), T.StructField("value", T.StringType())]))
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("bn", "hash", "lei", "uei")] + [T.StructField("additional", schemes)])
    return canonical_json(F.struct(bn.alias("bn"), entity_hash.alias("hash"), lei_.alias("lei"), uei_.alias("uei"), sorted_schemes(additional).alias("additional")), kind)


def entity_type_uri(entity_type: Column | str, base: str = "urn:entity-type#") -> Column:
    return F.concat(F.lit(base), slug(entity_type))


def canonical_input(name: Column | str, country: Column | str, address: Column | str | None = None, date: Column | str | None = None, profile: str = "core") -> Column:
    """(name, address, country, date) in normal form; an address that comes to
    nothing and a date that isn't one are null."""
    null = F.lit(None).cast("string")
    return F.struct(
        normalize_legal_name(name, profile).alias("name"), (null if address is None else let(normalize_address(address, profile), lambda a: F.nullif(a, F.lit("")))).alias("address"),
        F.upper(col(country)).alias("country"), (null if date is None else registration_date(date, strict=profile == "script_preserving")).alias("date"),
    )


def hash_string(c: Column) -> Column:
    """Pipes between the four; a null keeps its place."""
    e = lambda x: F.coalesce(x, F.lit(""))
    return F.concat(e(c["name"]), F.lit("|"), e(c["address"]), F.lit("|"), e(c["country"]), F.lit("|"), e(c["date"]))


def entity_hash(name: Column | str, country: Column | str, address: Column | str | None = None, date: Column | str | None = None, profile: str = "core") -> Column:
    return hash_text(let(canonical_input(name, country, address, date, profile), hash_string))


def with_confidence(name: Column, country: Column, address: Column, date: Column, lei_: Column, uei_: Column) -> Column:
    """(entity_hash, canonical, confidence_score, tier, fields_used).

    Tier 1 (1.0) with a LEI of 20 bytes, tier 2 (0.95) with a UEI of 12, else
    tier 3: 0.5, and 0.2 for an address, 0.2 for a date, 0.1 for more than three
    words, at most 0.9.
    """
    return rated(canonical_input(name, country, address, date), lei_, uei_)


def rated(c: Column, lei_: Column, uei_: Column) -> Column:
    """``with_confidence`` of a canonical input."""
    return let(c, lambda c: _rated(c, lei_, uei_))


def _rated(c: Column, lei_: Column, uei_: Column) -> Column:
    one, two = F.octet_length(lei_) == 20, F.octet_length(uei_) == 12
    some = lambda x, v: F.when(x.isNotNull(), v).otherwise(0.0)
    three = F.round(F.least(F.lit(0.5) + some(c["address"], 0.2) + some(c["date"], 0.2) + F.when(word_count(c["name"]) > 3, 0.1).otherwise(0.0), F.lit(0.9)) * 100) / 100
    names = F.lit("legal_name"), F.lit("country_code")
    computed = F.array_compact(F.array(*names, F.when(c["address"].isNotNull(), F.lit("address")), F.when(c["date"].isNotNull(), F.lit("registration_date"))))
    return F.struct(
        hash_text(hash_string(c)).alias("entity_hash"), hash_string(c).alias("canonical"),
        F.when(one, 1.0).when(two, 0.95).otherwise(three).cast("double").alias("confidence_score"), F.when(one, 1).when(two, 2).otherwise(3).alias("tier"),
        F.when(one, F.array(F.lit("lei"), *names)).when(two, F.array(F.lit("sam_uei"), *names)).otherwise(computed).alias("fields_used"),
    )


def detailed_json(result: Column) -> Column:
    """The result of ``with_confidence`` as JSON in camel case, nulls kept."""
    fields = lambda r: F.struct(r["entity_hash"].alias("entityHash"), r["canonical"].alias("canonical"), r["confidence_score"].alias("confidenceScore"), r["tier"].alias("tier"), r["fields_used"].alias("fieldsUsed"))
    return F.to_json(let(result, fields), {"ignoreNullFields": "false"})
