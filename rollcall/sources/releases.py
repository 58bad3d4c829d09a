"""Open-contracting releases: parsing, one bundle a release, and its parts.

Values of a wrong type are read as null, as a reader that trusts nothing would:
the JSON schema is permissive, and every leaf is a string or a nested value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.fold import let

_ID = "struct<scheme:string,id:string,legalName:string,uri:string>"
_VALUE = "struct<amount:double,currency:string>"
_PARTY = f"struct<id:string,name:string,roles:array<string>,identifier:{_ID},additionalIdentifiers:array<{_ID}>,address:struct<streetAddress:string,locality:string,region:string,postalCode:string,countryName:string,countryCode:string>,contactPoint:struct<name:string,email:string,telephone:string>>"
_PERIOD = "struct<startDate:string,endDate:string>"
_ITEM = "struct<id:string,description:string>"
RELEASE = (
    f"struct<ocid:string,id:string,date:string,tag:string,buyer:{_PARTY},parties:array<{_PARTY}>,"
    f"tender:struct<id:string,title:string,description:string,status:string,procurementMethod:string,procurementMethodDetails:string,mainProcurementCategory:string,value:{_VALUE},items:array<{_ITEM}>,lots:array<struct<id:string,title:string,value:{_VALUE},smeTargeted:boolean>>,tenderPeriod:{_PERIOD}>,"
    f"awards:array<struct<id:string,title:string,description:string,status:string,date:string,value:{_VALUE},suppliers:array<{_PARTY}>,items:array<{_ITEM}>,relatedLots:array<string>>>,"
    f"contracts:array<struct<id:string,awardID:string,title:string,description:string,status:string,period:{_PERIOD},value:{_VALUE},dateSigned:string,relatedLots:array<string>,implementation:struct<status:string>>>>"
)
DOCUMENT = f"struct<releases:array<{RELEASE}>,records:array<struct<releases:array<{RELEASE}>>>,{RELEASE[7:-1]}>"


def releases(documents: DataFrame, content: str = "content", pos: str = "pos") -> DataFrame:
    """(pos, release_pos, release): the releases of JSON texts, be they a
    release, a package of releases or a package of records.

    A text that isn't an object gives no row; ``pos`` identifies the text.
    """
    # One text is checked and read; a filter would be evaluated below, text and all.
    read = let(F.col(content), lambda c: F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, DOCUMENT)))
    d = documents.select(F.col(pos).alias("pos"), read.alias("d"))
    single = F.when(F.coalesce(F.col("d.ocid"), F.col("d.id")).isNotNull(), F.array(F.struct(*[F.col(f"d.{n}").alias(n) for n in ("ocid", "id", "date", "tag", "buyer", "parties", "tender", "awards", "contracts")])))
    of_records = F.flatten(F.transform("d.records", lambda r: F.coalesce(r["releases"], F.expr(f"from_json('[]', 'array<{RELEASE}>')"))))
    return d.select("pos", F.posexplode(F.coalesce("d.releases", of_records, single)).alias("release_pos", "release"))


def tags(tag: Column) -> Column:
    """The tags of a release, written as a list or as one string."""
    listed = F.from_json(tag, "array<string>")
    return F.when(tag.isNull(), F.array().cast("array<string>")).when(tag.startswith("["), F.filter(listed, lambda t: t.isNotNull())).otherwise(F.array(tag))


def party(p: Column, role: str, source: str) -> Column:
    """A party in the form that all parties take."""
    none = F.expr(f"cast(array() as array<{_ID}>)")
    return F.struct(
        F.lit(role).alias("role"), F.lit(source).alias("party_source"), p["id"].alias("party_id"), p["name"].alias("legal_name"), p["identifier"].alias("identifier"),
        F.coalesce(F.filter(p["additionalIdentifiers"], lambda x: x.isNotNull()), none).alias("additional_identifiers"), p["address"].alias("address"), p["contactPoint"].alias("contact_point"),
    )


def _with_role(parties: Column, role: str) -> Column:
    return F.filter(parties, lambda p: F.array_contains(p["roles"], role))


def buyer(r: Column) -> Column:
    """The release's buyer, else the first party of that role; null if none."""
    first = F.get(_with_role(r["parties"], "buyer"), F.lit(0))
    of_parties = let(first, lambda p: F.when(p.isNotNull(), party(p, "buyer", "release.parties")))
    return F.when(r["buyer"].isNotNull(), party(r["buyer"], "buyer", "release.buyer")).otherwise(of_parties)


def distinct_parties(parties: Column) -> Column:
    """The first of those with equal (party_id, legal_name); null counts as ''."""
    key = lambda p: F.struct(F.coalesce(p["party_id"], F.lit("")), F.coalesce(p["legal_name"], F.lit("")))
    first = lambda ps, keys: F.filter(ps, lambda p, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return let(parties, lambda ps: let(F.transform(ps, key), lambda keys: first(ps, keys)))


def suppliers(r: Column) -> Column:
    """Suppliers of the awards, then parties of that role, each once."""
    of_awards = F.flatten(F.transform(r["awards"], lambda a: F.transform(F.filter(F.coalesce(a["suppliers"], F.expr(f"cast(array() as array<{_PARTY}>)")), lambda s: s.isNotNull()), lambda s: party(s, "supplier", "release.awards[].suppliers"))))
    of_parties = F.transform(_with_role(r["parties"], "supplier"), lambda p: party(p, "supplier", "release.parties"))
    return distinct_parties(F.concat(F.coalesce(of_awards, _no_party("release.awards[].suppliers")), F.coalesce(of_parties, _no_party("release.parties"))))


def _no_party(source: str) -> Column:
    empty = F.expr(f"from_json('[]', 'array<{_PARTY}>')")
    return F.transform(empty, lambda p: party(p, "supplier", source))


def bundles(found: DataFrame, jurisdiction: str, source_system: str, include_raw: bool = False) -> DataFrame:
    """A row per release: source_system, jurisdiction, ocid, release_id, date,
    tags, buyer, suppliers, tender, awards, contracts."""
    r = F.col("release")
    have = lambda a: F.filter(r[a], lambda x: x.isNotNull())
    out = found.select(
        "pos", "release_pos", F.lit(source_system).alias("source_system"), F.lit(jurisdiction).alias("jurisdiction"),
        r["ocid"].alias("ocid"), r["id"].alias("release_id"), r["date"].alias("date"), tags(r["tag"]).alias("tags"),
        buyer(r).alias("buyer"), suppliers(r).alias("suppliers"), r["tender"].alias("tender"), have("awards").alias("awards"), have("contracts").alias("contracts"), "release",
    )
    return out.withColumn("raw_release", F.to_json("release")).drop("release") if include_raw else out.drop("release")


def identifiers(p: Column) -> Column:
    """(primary, additional) of a party."""
    return F.struct(p["identifier"].alias("primary"), p["additional_identifiers"].alias("additional"))


_REF = ("source_system", "jurisdiction", "ocid", "release_id", "date", "tags")


def build_requests(b: DataFrame) -> DataFrame:
    """A row per record to be built: record_kind, record_type, the release it is
    from, an endpoint (key of the record within it), a legal name, a party's
    identifiers and the payload as JSON. A buyer or supplier without a name, and a tender without an id, has
    ``error`` set instead of a payload. The bundles are read once."""
    null = F.lit(None).cast("string")

    def request(kind: str, part: Column, pos: Column) -> Column:
        named = kind in ("buyer", "supplier")
        needed = part["legal_name"] if named else part["id"]
        ok = F.coalesce(F.trim(needed), F.lit("")) != "" if named or kind == "tender" else F.lit(True)
        return F.struct(
            F.lit(f"procurement.{kind}").alias("record_type"), pos.cast("int").alias("part_pos"), part["party_id" if named else "id"].alias("endpoint"), (part["awardID"] if kind == "contract" else null).alias("award_id"),
            (F.trim(part["legal_name"]) if named else null).alias("legal_name"), F.to_json(identifiers(part) if named else F.lit(None).cast(f"struct<primary:{_ID}>")).alias("identifiers"), F.when(ok, F.to_json(part)).alias("payload"), F.when(~ok, F.lit("missing or invalid " + ("legal_name" if named else "id"))).alias("error"),
        )

    none = F.expr("cast(array() as array<struct<record_type:string,part_pos:int,endpoint:string,award_id:string,legal_name:string,identifiers:string,payload:string,error:string>>)")
    single = [F.when(F.col(k).isNotNull(), F.array(request(k, F.col(k), F.lit(0)))) for k in ("buyer", "tender")]
    each = lambda kind: lambda p, i: request(kind, p, i)
    many = [F.transform(c, each(k)) for c, k in (("suppliers", "supplier"), ("awards", "award"), ("contracts", "contract"))]
    ref = [c for c in _REF if c in b.columns]
    x = b.select("pos", "release_pos", *ref, F.explode(F.concat(*[F.coalesce(e, none) for e in single + many])).alias("x"))
    return x.select("pos", "release_pos", *ref, F.lit("entity").alias("record_kind"), "x.*")
