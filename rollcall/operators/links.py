"""Links between the records of a release.

A release holds all that its links need, so ``release_links`` makes them row by
row, without an exchange. The functions on build requests join them on release
and key, for requests that were stored apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators.audit import keep_last

RELEASE = ["pos", "release_pos"]


def _link(df: DataFrame, kind: str) -> DataFrame:
    a, b = kind.split("_to_")
    return df.select(*RELEASE, F.lit("relationship_stub").alias("record_kind"), F.lit(f"procurement.link.{kind}").alias("record_type"), F.lit(a).alias("from_type"), "from_key", F.lit(b).alias("to_type"), "to_key")


def _of(requests: DataFrame, kind: str, key: str) -> DataFrame:
    return requests.where((F.col("record_type") == f"procurement.{kind}") & F.col("error").isNull()).select(*RELEASE, "part_pos", F.col("endpoint").alias(key), "award_id")


def buyer_to_tender(requests: DataFrame) -> DataFrame:
    a, b = _of(requests, "buyer", "from_key"), _of(requests, "tender", "to_key")
    return _link(a.drop("part_pos", "award_id").join(b.drop("part_pos", "award_id"), RELEASE), "buyer_to_tender")


def supplier_to_award(requests: DataFrame) -> DataFrame:
    """Every supplier of a release with every award of it."""
    a, b = _of(requests, "supplier", "from_key"), _of(requests, "award", "to_key")
    return _link(a.drop("part_pos", "award_id").join(b.drop("part_pos", "award_id"), RELEASE), "supplier_to_award")


def award_to_contract(requests: DataFrame) -> DataFrame:
    """Contracts with the award that they name; of awards with one id, the last
    counts; contracts that name none or an unknown one have no link."""
    awards = keep_last(_of(requests, "award", "from_key").where("from_key <> ''"), [*RELEASE, "from_key"], ["part_pos"]).select(*RELEASE, "from_key")
    contracts = _of(requests, "contract", "to_key").where("award_id <> ''").select(*RELEASE, F.col("award_id").alias("from_key"), "to_key")
    return _link(contracts.join(awards, [*RELEASE, "from_key"]), "award_to_contract")


def links(requests: DataFrame) -> DataFrame:
    """All three kinds."""
    return reduce(DataFrame.unionByName, (f(requests) for f in (buyer_to_tender, supplier_to_award, award_to_contract)))


def release_links(bundles: DataFrame) -> DataFrame:
    """The same links as ``links(build_requests(bundles))``, from the bundles."""
    some = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    link = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("from_key"), b.alias("to_key"))
    none = F.expr("cast(array() as array<struct<kind:string,from_key:string,to_key:string>>)")
    sold = F.filter("suppliers", lambda s: some(s["legal_name"]))
    each = [
        F.when(some(F.col("buyer.legal_name")) & some(F.col("tender.id")), F.array(link("buyer_to_tender", F.col("buyer.party_id"), F.col("tender.id")))),
        F.flatten(F.transform(sold, lambda s: F.transform("awards", lambda a: link("supplier_to_award", s["party_id"], a["id"])))),
        F.transform(F.filter("contracts", lambda c: (c["awardID"] != "") & F.exists("awards", lambda a: a["id"] == c["awardID"])), lambda c: link("award_to_contract", c["awardID"], c["id"])),
    ]
    x = bundles.select(*RELEASE, F.explode(F.concat(*[F.coalesce(e, none) for e in each])).alias("x"))
    a = F.split("x.kind", "_to_")
    return x.select(*RELEASE, F.lit("relationship_stub").alias("record_kind"), F.concat(F.lit("procurement.link."), "x.kind").alias("record_type"), a[0].alias("from_type"), "x.from_key", a[1].alias("to_type"), "x.to_key")


def spine(requests: DataFrame) -> DataFrame:
    """Build requests and links as one stream of records."""
    return requests.unionByName(links(requests), allowMissingColumns=True)


def misplaced(requests: DataFrame, kind: str) -> DataFrame:
    """Requests that a function for ``kind`` refuses, with the reason: of another
    record kind or type, or with an error of their own."""
    bad = F.when(F.col("record_kind") != "entity", "not an entity").when(F.col("record_type") != f"procurement.{kind}", F.lit(f"not of type procurement.{kind}")).otherwise(F.col("error"))
    return requests.withColumn("refused", bad).where("refused is not null")
