"""Records: envelopes, attestations, entities, adapters.

Clocks are parameters, so results are the same on every run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.canonical import canonical_string, projection_id
from rollcall.functions.identity import PREFIXES, entity_hash, entity_type_uri
from rollcall.functions.localize import localized_by
from rollcall.functions.normalize import col, fallback_name, normalize_legal_name

EPOCH = "1900-01-01T00:00:00.000000Z"
ATTESTATION = "struct<attestationTimestamp:string,attestorId:string,verificationMethodUri:string,proofType:string,proofPurpose:string,proofValue:string,sourceSystem:string,sourceReference:string,anchorUri:string>"
ENVELOPE = f"struct<recordKind:string,recordSchemaUri:string,schemaVersion:string,revisionNumber:bigint,verifiableId:string,recordTypeUri:string,status:struct<statusCode:string,statusReason:string,statusEffectiveDate:string>,timestamps:struct<firstSeenAt:string,lastUpdatedAt:string,validFrom:string,validTo:string>,attestations:array<{ATTESTATION}>>"
PROOF_PURPOSES = ("assertionMethod", "authentication", "capabilityDelegation")
#: Columns that a payload must have.
REQUIRED = ("jurisdictionIso", "legalName", "legalNameNormalized", "entityHash", "entityType", "attestations")


def attestation(attestor: str, timestamp: str = EPOCH, method: str = "urn:attestation:manual", proof_type: str = "ManualAttestation", purpose: str = PROOF_PURPOSES[0], source_system: str | None = None, source_reference: str | Column | None = None, proof_value: str | None = None, anchor: str | None = None) -> Column:
    if purpose not in PROOF_PURPOSES:
        raise ValueError(f"purpose: one of {PROOF_PURPOSES}")
    s = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    values = (timestamp, attestor, method, proof_type, purpose, proof_value, source_system, source_reference, anchor)
    return F.struct(*[s(v).alias(n.split(":")[0]) for v, n in zip(values, ATTESTATION[7:-1].split(","), strict=True)])


def attach_attestation(df: DataFrame, a: Column, column: str = "attestations") -> DataFrame:
    """Append to the list (made if it isn't there); a single older
    ``attestation`` column goes."""
    before = F.coalesce(F.col(column), F.expr(f"cast(array() as array<{ATTESTATION}>)")) if column in df.columns else F.expr(f"cast(array() as array<{ATTESTATION}>)")
    return df.withColumn(column, F.concat(before, F.array(a))).drop("attestation")


def attestation_text(a: Column) -> Column:
    """Canonical string of an attestation's seven identifying fields."""
    names = ("attestationTimestamp", "attestorId", "verificationMethodUri", "proofType", "proofPurpose", "proofValue", "anchorUri")
    return canonical_string(**{n: a[n] for n in names})


def payload_errors(df: DataFrame) -> Column:
    """What a raw payload lacks: an array of messages, empty if nothing."""
    out = []
    for c in REQUIRED:
        if c not in df.columns:
            out.append(F.lit(f"missing {c}"))
        elif c == "attestations":
            out.append(F.when(F.col(c).isNull() | (F.size(c) == 0), "attestations must not be empty"))
        else:
            out.append(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"missing {c}"))
    return F.array_compact(F.array(*out))


def entity_records(df: DataFrame, prefixes: dict[str, str] = PREFIXES, schema_uri: str = "urn:schema:entity", type_base: str = "urn:entity-type#", scheme_uri: str = "urn:identifier-scheme#entity-hash") -> DataFrame:
    """Full entity records from (jurisdictionIso, legalName,
    legalNameNormalized, entityHash, entityType, attestations): status ACTIVE,
    dates 1900-01-01, revision 1, one identifier."""
    null = F.lit(None).cast("string")
    return df.select(
        F.lit("entity").alias("recordKind"), F.lit(schema_uri).alias("recordSchemaUri"), F.lit("1.0.0").alias("schemaVersion"), F.lit(1).cast("long").alias("revisionNumber"),
        F.concat(F.lit(prefixes["hash"]), "entityHash").alias("verifiableId"), entity_type_uri("entityType", type_base).alias("recordTypeUri"),
        F.struct(F.lit("ACTIVE").alias("statusCode"), null.alias("statusReason"), F.lit("1900-01-01").alias("statusEffectiveDate")).alias("status"),
        F.struct(F.lit(EPOCH).alias("firstSeenAt"), F.lit(EPOCH).alias("lastUpdatedAt"), F.lit(EPOCH).alias("validFrom"), null.alias("validTo")).alias("timestamps"),
        "attestations", "jurisdictionIso", "legalName", "legalNameNormalized",
        F.array(F.struct(F.lit(scheme_uri).alias("schemeUri"), F.col("entityHash").alias("identifier"), null.alias("sourceReference"))).alias("identifiers"),
        *[null.alias(c) for c in ("shortName", "inceptionDate", "dissolutionDate", "statusTerminationDate", "successorEntityId")],
    )


def attested(df: DataFrame, typed: bool = True) -> DataFrame:
    """Relationship, exchange and context-tag records pass through unchanged if
    they have an attestation; ``typed`` also wants its required fields."""
    ok = F.coalesce(F.size("attestations") > 0, F.lit(False))
    if typed:
        ok = ok & F.forall("attestations", lambda a: a["attestationTimestamp"].isNotNull() & a["attestorId"].isNotNull() & a["proofType"].isNotNull() & a["proofPurpose"].isNotNull())
    return df.where(ok)


def is_active(status: Column | str = "status") -> Column:
    return col(status)["statusCode"] == "ACTIVE"


def minimal_envelope(df: DataFrame, key: str, schema_uri: str = "urn:schema:notice") -> DataFrame:
    """(record_id, record_schema_uri, payload): rows as JSON in an envelope."""
    return df.select(F.col(key).cast("string").alias("record_id"), F.lit(schema_uri).alias("record_schema_uri"), F.to_json(F.struct(*df.columns)).alias("payload"))


def revision_chain(df: DataFrame, key: str, revision: str, row_hash: str) -> DataFrame:
    """``df`` with ``previous_hash``: the hash of the revision before."""
    from pyspark.sql import Window as W

    return df.withColumn("previous_hash", F.lag(row_hash).over(W.partitionBy(key).orderBy(revision)))


# --- Adapters ---------------------------------------------------------------


@dataclass(frozen=True)
class Adapter:
    """Raw rows to aligned, identified, attested rows, in four steps.

    ``names`` are the columns that may hold the legal name, the first that isn't
    blank counts. ``jurisdiction`` is the default; None: a row needs its own.
    """

    domain: str
    jurisdiction: str | None
    source_system: str
    entity_type: str
    names: tuple[str, ...]
    passthrough: tuple[str, ...] = ()
    fallback: bool = False
    attestor: str = "urn:attestor:rollcall"
    clock: str = EPOCH
    #: Names are put in the words of their jurisdiction before they are normalized.
    localized: bool = False

    def canonicalize(self, raw: DataFrame) -> DataFrame:
        """legalName and jurisdictionIso; a row without one has ``error``."""
        there = [c for c in self.names if c in raw.columns]
        name = F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in there]) if there else F.lit(None).cast("string")
        j = F.coalesce(F.nullif(F.trim("jurisdiction_iso"), F.lit("")), F.lit(self.jurisdiction)) if "jurisdiction_iso" in raw.columns else F.lit(self.jurisdiction).cast("string")
        return raw.withColumns({"legalName": name, "jurisdictionIso": j}).withColumn("error", F.when(F.col("legalName").isNull(), "missing legal name").when(F.col("jurisdictionIso").isNull(), "missing jurisdiction"))

    def align(self, df: DataFrame) -> DataFrame:
        # Columns of composed adapters are passed on, too.
        kept = [c for c in df.columns if c in self.passthrough or c.startswith("error_")]
        name = F.col("legalName")
        if self.localized:
            name = localized_by(name, "jurisdictionIso", [self.jurisdiction] if self.jurisdiction else None)
        n = fallback_name(name) if self.fallback else normalize_legal_name(name)
        return df.select(*kept, F.lit(self.entity_type).alias("entityType"), "jurisdictionIso", "legalName", n.alias("legalNameNormalized"), "error")

    def identify(self, df: DataFrame) -> DataFrame:
        return df.withColumn("projection_id", projection_id(jurisdictionIso="jurisdictionIso", legalNameNormalized="legalNameNormalized"))

    def attest(self, df: DataFrame) -> DataFrame:
        return attach_attestation(df, attestation(self.attestor, self.clock, source_system=self.source_system))

    def run(self, raw: DataFrame) -> DataFrame:
        return raw.transform(self.canonicalize).transform(self.align).transform(self.identify).transform(self.attest)


REGISTRY: dict[tuple[str, str | None, str], Adapter] = {}


def register(a: Adapter) -> Adapter:
    REGISTRY[a.domain, a.jurisdiction, a.source_system] = a
    return a


def adapter(domain: str, jurisdiction: str | None, source_system: str) -> Adapter:
    try:
        return REGISTRY[domain, jurisdiction, source_system]
    except KeyError:
        raise KeyError(f"no adapter for {domain}, {jurisdiction}, {source_system}") from None


for _j in ("US-MN", "US-CA", "US-NY"):
    register(Adapter("municipality", _j, "city_list", "municipality", ("legal_name", "name")))
register(Adapter("school_district", None, "district_list", "school_district", ("legal_name", "district_name", "name")))
register(Adapter("vendor", "US-IL", "vendor_list", "vendor", ("vendor_name", "Vendor Name", "VENDOR_NAME")))
register(Adapter("campaign_finance", "US", "filings", "donor", ("donor_name",), ("amount",)))
register(Adapter("program", None, "state_portal", "program", ("program_name", "name"), ("portal_id", "category", "url")))


def composed(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Adapters one after another. A row with an error keeps the first one, and
    its columns as they were then; those that only a later step makes are null."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            if "error" not in df.columns:
                df = step(df)
                continue
            # What a row was goes along in a column that no step knows.
            was = "error_" + "_" * max(map(len, df.columns))
            before = {f.name: f.dataType for f in df.schema.fields}
            out = step(df.withColumn(was, F.when(F.col("error").isNotNull(), F.struct(*[f"`{c}`" for c in df.columns]))).withColumn("error", F.lit(None).cast("string")))
            if "error" not in out.columns:
                raise ValueError("a step dropped the error column")
            if was not in out.columns:
                raise ValueError("a step must pass on columns that start with 'error_'")

            def kept(f) -> Column:
                old = F.col(was)[f.name] if before.get(f.name) == f.dataType else F.lit(None).cast(f.dataType)
                return F.when(F.col(was).isNull(), F.col(f"`{f.name}`")).otherwise(old).alias(f.name)

            df = out.select(*[kept(f) for f in out.schema.fields if f.name != was])
        return df

    return run


# --- Records from JSON payloads -------------------------------------------------

_TEXT = ("jurisdictionIso", "legalName", "legalNameNormalized", "entityHash", "entityType")
PAYLOAD = "struct<" + ",".join(f"{n}:string" for n in _TEXT) + f",attestations:array<{ATTESTATION}>>"
TAG = "struct<ctag_id:string,tag_type_uri:string,code:string,value:variant,applied_by:string,applied_at:string,scope:string,target_path:string,confidence:double,source_run_id:string,note:string,prov_activity_uri:string>"


def from_raw(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Entity records of the raw payloads that are whole, and the others with
    ``errors``; nothing is dropped."""
    checked = df.withColumn("errors", payload_errors(df))
    return entity_records(checked.where("size(errors) = 0"), **options), checked.where("size(errors) > 0")


def entity_json(payload: Column | str, prefixes: dict[str, str] = PREFIXES, schema_uri: str = "urn:schema:entity", type_base: str = "urn:entity-type#", scheme_uri: str = "urn:identifier-scheme#entity-hash") -> Column:
    """An entity record as JSON from a payload as JSON, nulls left out; null for
    what isn't an object, lacks a field or has no attestation."""
    p = F.from_json(col(payload), PAYLOAD)
    ok = F.coalesce(F.size(p["attestations"]) > 0, F.lit(False))
    for n in _TEXT:
        ok = ok & F.coalesce(F.trim(p[n]) != "", F.lit(False))
    time = F.lit(EPOCH)
    record = F.struct(
        F.lit("entity").alias("recordKind"), F.lit(schema_uri).alias("recordSchemaUri"), F.lit("1.0.0").alias("schemaVersion"), F.lit(1).alias("revisionNumber"),
        F.concat(F.lit(prefixes["hash"]), p["entityHash"]).alias("verifiableId"), entity_type_uri(p["entityType"], type_base).alias("recordTypeUri"),
        F.struct(F.lit("ACTIVE").alias("statusCode"), F.lit("1900-01-01").alias("statusEffectiveDate")).alias("status"), F.struct(time.alias("firstSeenAt"), time.alias("lastUpdatedAt"), time.alias("validFrom")).alias("timestamps"),
        p["attestations"].alias("attestations"), p["jurisdictionIso"].alias("jurisdictionIso"), p["legalName"].alias("legalName"), p["legalNameNormalized"].alias("legalNameNormalized"),
        F.array(F.struct(F.lit(scheme_uri).alias("schemeUri"), p["entityHash"].alias("identifier"))).alias("identifiers"),
    )
    return F.when(ok, F.to_json(record))


def attested_json(payload: Column | str) -> Column:
    """A relationship, exchange or context-tag record as JSON, unchanged if it
    has an attestation with its required fields; else null."""
    p = F.from_json(col(payload), f"struct<attestations:array<{ATTESTATION}>>")["attestations"]
    whole = F.forall(p, lambda a: a["attestationTimestamp"].isNotNull() & a["attestorId"].isNotNull() & a["proofType"].isNotNull() & a["proofPurpose"].isNotNull())
    return F.when(F.coalesce((F.size(p) > 0) & whole, F.lit(False)), col(payload))


def context_tags(payload: Column | str) -> Column:
    """array<struct> of the context tags of a record as JSON, under ``ctags`` or
    ``contextTags``; those without type, author and time, or with a confidence
    outside 0 to 1, are left out."""
    kind = f"struct<ctags:array<{TAG}>,contextTags:array<{TAG}>>"
    r = F.from_json(col(payload), kind)
    good = lambda t: F.coalesce(t["tag_type_uri"], t["applied_by"], t["applied_at"]).isNotNull() & t["tag_type_uri"].isNotNull() & t["applied_by"].isNotNull() & t["applied_at"].isNotNull() & F.coalesce(t["confidence"].between(0, 1), F.lit(True))
    return F.filter(F.coalesce(r["ctags"], r["contextTags"], F.expr(f"cast(array() as array<{TAG}>)")), good)


def first_present(df: DataFrame, *names: str) -> Column:
    """The value under the first of these columns that isn't null, blank or not;
    columns that aren't there are passed over."""
    there = [F.col(f"`{c}`").cast("string") for c in names if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def example_inputs(df: DataFrame, folder: str = "folder") -> DataFrame:
    """(name, jurisdiction, country, address, entity_type) of mixed raw rows:
    a name from any of its usual columns, a jurisdiction from its own column or
    from country and state, the type from the folder if none is given."""
    def first(*names: str) -> Column:
        there = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in names if c in df.columns]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    country = F.coalesce(first("country", "country_code"), F.lit("US"))
    return df.select(
        first("legal_name", "official_name", "committee_name", "district_name", "name").alias("name"), F.coalesce(first("jurisdiction_iso", "jurisdiction"), F.concat_ws("-", country, first("state"))).alias("jurisdiction"),
        country.alias("country"), first("address").alias("address"), F.coalesce(first("entityType", "entity_type"), first(folder)).alias("entity_type"),
    )


# --- Identity chains of tenders ------------------------------------------------


def chained_identity(df: DataFrame, jurisdiction: str, buyer: str, tender: str | None = None, lot: str | None = None, contract: str | None = None) -> DataFrame:
    """buyer_id from jurisdiction and name; lot_id and contract_id from the
    buyer's and their own keys."""
    out = df.withColumn("buyer_id", projection_id(jurisdictionIso=jurisdiction, legalNameNormalized=F.lower(F.trim(buyer))))
    if lot is not None:
        out = out.withColumn("lot_id", projection_id(buyerId="buyer_id", tenderId=tender, lotId=lot))
    if contract is not None:
        out = out.withColumn("contract_id", projection_id(buyerId="buyer_id", contractId=contract))
    return out


def small_business_view(bundles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lots, contracts and contract-supplier relationships of release bundles,
    with chained identities. A lot without a value has the tender's; a buyer
    without a country is of the EU."""
    s = lambda c: F.trim(F.coalesce(c, F.lit("")))
    b = bundles.withColumn("country", s(F.coalesce(F.nullif(F.col("buyer.address.countryName"), F.lit("")), F.nullif(F.col("buyer.address.countryCode"), F.lit("")), F.lit("EU")))).withColumn("buyer_name", s(F.col("buyer.legal_name"))).withColumn("tender_id", s(F.col("tender.id")))
    lots = b.select("pos", "release_pos", "country", "buyer_name", "tender_id", F.col("tender.title").alias("tender_title"), F.col("tender.value").alias("tv"), F.explode("tender.lots").alias("lot"))
    lots = lots.select(
        "pos", "release_pos", "country", "buyer_name", "tender_id", s(F.col("lot.id")).alias("lot_key"), s(F.coalesce("lot.title", "tender_title")).alias("title"),
        F.coalesce("lot.value.amount", "tv.amount").alias("estimated_value"), F.coalesce("lot.value.currency", "tv.currency").alias("currency"), F.coalesce("lot.smeTargeted", F.lit(False)).alias("sme_targeted"),
    )
    lots = chained_identity(lots, "country", "buyer_name", "tender_id", "lot_key").drop("buyer_name")
    awards = b.select("pos", "release_pos", "country", "buyer_name", F.explode("awards").alias("a")).withColumn("contract_key", s(F.col("a.id")))
    awards = chained_identity(awards, "country", "buyer_name", contract="contract_key")
    contracts = awards.select("pos", "release_pos", "contract_key", F.col("a.value.amount").alias("final_value"), F.col("a.value.currency").alias("currency"), "a.relatedLots", "buyer_id", "contract_id")
    related = awards.select("pos", "release_pos", "contract_key", "country", F.explode("a.suppliers").alias("p")).select(
        "pos", "release_pos", F.lit("procurement.contract-awarded-to-supplier").alias("relationship_type"), "contract_key", s(F.col("p.id")).alias("supplier_key"), s(F.col("p.name")).alias("legal_name"), F.lower(s(F.col("p.name"))).alias("legal_name_normalized"), F.col("country").alias("jurisdiction"),
    )
    return lots, contracts, related


def with_entity_hash(df: DataFrame, name: str, country: str, address: str | None = None, date: str | None = None) -> DataFrame:
    return df.withColumn("entity_hash", entity_hash(name, country, address, date))
