"""One query per operator, over whole tables, each with its SQL where SQL can
say it. Raw public names are derived from the tables' columns by expressions
that both engines read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall import duck
from rollcall.functions import canonical, dates, identity, localize, normalize
from rollcall.functions.fold import to_ascii
from rollcall.operators import audit, explain, graph, links, records, resolve, validate, vocabulary
from rollcall.plans import functions as named
from rollcall.session import table
from rollcall.sources import readers, releases, writers
from rollcall.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- Derived inputs ---------------------------------------------------------

_VENDOR = "concat('The ', p_name, ' Mfg. Co., ', CASE p_partkey % 3 WHEN 0 THEN 'Inc.' WHEN 1 THEN 'L.L.C.' ELSE 'Ltd.' END)"
_OLDER = "concat(lower(p_name), CASE WHEN p_size > 25 THEN ' of the north' ELSE '' END)"
_ADDRESS = "concat(cast(c_custkey as string), ' N. ', c_mktsegment, ' St., ', CASE c_custkey % 4 WHEN 0 THEN 'Suite 12' WHEN 1 THEN 'Apt #3B' WHEN 2 THEN 'Floor 7' ELSE '# 9' END)"
_FULL = "concat(c_name, ' ', c_mktsegment, ' Dept., Inc.')"
_JURISDICTIONS = ("US-IL", "US-MN", "us/ny", "CA/ON", "US")
_AGENCY = "concat(CASE s_suppkey % 6 WHEN 0 THEN 'CPS ' WHEN 1 THEN 'MNDOT Metro ' WHEN 2 THEN 'NYC MTA ' WHEN 3 THEN 'TTC ' WHEN 4 THEN 'EPA ' ELSE 'Dept of ' END, s_name, ', Inc.')"
_WHERE = "CASE s_nationkey % 5 " + " ".join(f"WHEN {i} THEN '{j}'" for i, j in enumerate(_JURISDICTIONS)) + " END"
_DAY = "CASE o_orderkey % 4 WHEN 0 THEN substring(cast(o_orderdate as string), 1, 10) WHEN 1 THEN concat(substring(cast(o_orderdate as string), 6, 2), '/', substring(cast(o_orderdate as string), 9, 2), '/', substring(cast(o_orderdate as string), 1, 4)) WHEN 2 THEN concat(' ', substring(cast(o_orderdate as string), 1, 4)) ELSE concat(substring(cast(o_orderdate as string), 9, 2), '-', substring(cast(o_orderdate as string), 6, 2), '-', substring(cast(o_orderdate as string), 1, 4)) END"


def vendors(spark: SparkSession, sf: str) -> DataFrame:
    """(pos, raw_name): vendors' names from ``part``; in the older list some are
    missing and some have other names."""
    return table(spark, sf, "part").selectExpr("p_partkey as pos", f"{_VENDOR} as raw_name")


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    return audit.mapping(vendors(spark, sf))


def baseline(spark: SparkSession, sf: str) -> DataFrame:
    """An older mapping: two thirds of the names, by another rule."""
    return table(spark, sf, "part").where("p_size > 10").selectExpr("p_partkey as pos", f"{_VENDOR} as raw", f"{_OLDER} as normalized")


_MAP = f"SELECT p_partkey AS pos, {_VENDOR} AS raw, {duck.legal_name(_VENDOR)} AS normalized FROM part"
_BASE = f"SELECT p_partkey AS pos, {_VENDOR} AS raw, {_OLDER} AS normalized FROM part WHERE p_size > 10"


# --- Text ------------------------------------------------------------------


@query(f"SELECT doc_id, {duck.ascii_fold('text')} AS folded FROM documents")
def ascii_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", to_ascii(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, {duck.legal_name('text', plain=False)} AS normalized FROM documents")
def text_normalized(spark, sf):
    """Whole texts in the normal form of names."""
    return table(spark, sf, "documents").select("doc_id", normalize.normalize_legal_name("text").alias("normalized"))


@query(f"SELECT p_partkey, {duck.legal_name(_VENDOR)} AS normalized FROM part")
def legal_name_normalized(spark, sf):
    return vendors(spark, sf).select(F.col("pos").alias("p_partkey"), normalize.normalize_legal_name("raw_name").alias("normalized"))


_SCRIPT = "concat('Société ', c_name, ' Εταιρεία S.A. & Cos / ', c_mktsegment, ' Mgmt')"


@query(f"SELECT c_custkey, {duck.script_name(_SCRIPT)} AS normalized FROM customer")
def legal_name_script_preserving(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", normalize.normalize_legal_name(F.expr(_SCRIPT), "script_preserving").alias("normalized"))


@query(f"SELECT c_custkey, {duck.address(_ADDRESS)} AS address FROM customer")
def address_normalized(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", normalize.normalize_address(F.expr(_ADDRESS)).alias("address"))


@query(f"SELECT c_custkey, {duck.secondary(_ADDRESS)} AS address FROM customer")
def secondary_unit_removed(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", normalize.remove_secondary_unit(F.expr(_ADDRESS)).alias("address"))


@query(
    f"""SELECT p_partkey, lower(trim(raw)) AS simple, trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) AS fallback, len(string_split(trim(regexp_replace(raw, '\\s+', ' ', 'g')), ' '))::INT AS words,
    trim(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'urn:entity-type#' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS type_uri,
    CASE WHEN regexp_matches(n, '\\b(incorporated|corporation|company|limited)\\b') THEN 'business' ELSE 'other' END AS entity_type FROM (SELECT *, {_VENDOR} AS raw, {duck.legal_name(_VENDOR)} AS n FROM part)"""
)
def name_features(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey", "p_type", f"{_VENDOR} as raw")
    return df.select("p_partkey", normalize.simple_name("raw").alias("simple"), normalize.fallback_name("raw").alias("fallback"), normalize.word_count("raw").alias("words"), normalize.slug("raw").alias("slug"), identity.entity_type_uri("p_type").alias("type_uri"), normalize.entity_type_of(normalize.normalize_legal_name("raw")).alias("entity_type"))


@query("SELECT c_custkey, CASE WHEN length(d) = 9 THEN d END AS ein FROM (SELECT c_custkey, right('000000000' || c_custkey::VARCHAR, CASE WHEN c_custkey % 5 = 0 THEN 8 ELSE 9 END) AS d FROM customer)")
def ein_normalized(spark, sf):
    d = "right(concat('000000000', cast(c_custkey as string)), CASE WHEN c_custkey % 5 = 0 THEN 8 ELSE 9 END)"
    return table(spark, sf, "customer").select("c_custkey", normalize.normalize_ein(F.expr(f"concat(substring({d}, 1, 2), '-', substring({d}, 3))")).alias("ein"))


# --- Dates and canonical forms -------------------------------------------------


@query(f"SELECT o_orderkey, {duck.date(_DAY)} AS d FROM orders")
def registration_date(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.registration_date(F.expr(_DAY)).alias("d"))


@query(f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN year(o_orderdate)::VARCHAR || '-01-01' WHEN 3 THEN CASE WHEN day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders""")
def registration_date_strict(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.registration_date(F.expr(_DAY), strict=True).alias("d"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS t, strftime(ts, '%Y-%m-%d') AS d FROM events")
def canonical_timestamp(spark, sf):
    t = dates.canonical_timestamp("ts")
    return table(spark, sf, "events").select("event_id", t.alias("t"), dates.occurred_date(t).alias("d"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * l_discount * 100)::BIGINT IS NOT NULL AS ok, (l_extendedprice::VARCHAR::DECIMAL(38, 18)::DECIMAL(38, 2))::VARCHAR AS amount FROM lineitem")
def format_amount(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(True).alias("ok"), canonical.format_amount("l_extendedprice").alias("amount"))


@query("""SELECT o_orderkey, concat_ws(',', '"customer":"' || o_custkey || '"', CASE WHEN o_orderstatus <> 'P' THEN '"status":"' || o_orderstatus || '"' END, '"total":"' || (o_totalprice::VARCHAR::DECIMAL(38, 18)::DECIMAL(38, 2)) || '"') AS s,
    concat_ws('|', o_orderkey::VARCHAR, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, o_orderpriority) AS c FROM orders""")
def canonical_string(spark, sf):
    o = table(spark, sf, "orders").withColumn("st", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise(""))
    return o.select("o_orderkey", canonical.canonical_string(total=canonical.format_amount("o_totalprice"), status="st", customer="o_custkey").alias("s"), canonical.ordered_fields("o_orderkey", "st", "o_orderpriority").alias("c"))


@query("""SELECT o_orderkey, sha256('{"customer":' || o_custkey || ',"items":[{"line":1},{}],"priority":"' || o_orderpriority || '"' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',"status":"' || o_orderstatus || '"' END || '}') AS h FROM orders""")
def canonical_json_fingerprint(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.expr("struct(o_orderpriority as priority, nullif(o_orderstatus, 'P') as status, o_custkey as customer, array(named_struct('line', 1), named_struct('line', cast(null as int))) as items)").alias("r"))
    return o.select("o_orderkey", canonical.fingerprint(F.col("r"), o.schema["r"].dataType).alias("h"))


# --- Identity ----------------------------------------------------------------

_ENTITY = "SELECT c_custkey, c_name, c_mktsegment, c_acctbal, c_nationkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey"


def entities(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.substring("n_name", -2, 2).alias("country"))
    c = table(spark, sf, "customer").withColumns({"name": F.expr(_FULL), "address": F.expr(_ADDRESS), "day": F.expr("CASE WHEN c_custkey % 3 = 0 THEN '03/15/1990' END")})
    return c.join(n, "c_nationkey")


_HASH = duck.hash_string(_FULL, "right(n_name, 2)", _ADDRESS, "CASE WHEN c_custkey % 3 = 0 THEN '03/15/1990' END")


@query(f"SELECT c_custkey, {_HASH} AS canonical, sha256({_HASH}) AS entity_hash FROM customer JOIN nation ON n_nationkey = c_nationkey")
def entity_hash(spark, sf):
    c = identity.canonical_input("name", "country", "address", "day")
    s = entities(spark, sf).select("c_custkey", identity.hash_string(c).alias("canonical"))
    return s.withColumn("entity_hash", canonical.hash_text("canonical"))


def confident(spark: SparkSession, sf: str) -> DataFrame:
    lei = F.expr("CASE WHEN c_custkey % 7 = 0 THEN lpad(cast(c_custkey as string), 20, 'A') END")
    uei = F.expr("CASE WHEN c_custkey % 5 = 0 THEN lpad(cast(c_custkey as string), 12, 'U') END")
    addr = F.expr("CASE WHEN c_custkey % 2 = 0 THEN address END")
    return entities(spark, sf).select("c_custkey", identity.with_confidence(F.col("name"), F.col("country"), addr, F.col("day"), lei, uei).alias("r"))


_TIERS = f"""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 1 WHEN c_custkey % 5 = 0 THEN 2 ELSE 3 END AS tier, CASE WHEN c_custkey % 7 = 0 THEN 1.0 WHEN c_custkey % 5 = 0 THEN 0.95 ELSE
    least(0.9, 0.5 + CASE WHEN c_custkey % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN len(string_split({duck.legal_name(_FULL)}, ' ')) > 3 THEN 0.1 ELSE 0 END) END::DOUBLE AS confidence,
    CASE WHEN c_custkey % 7 = 0 THEN 'lei,legal_name,country_code' WHEN c_custkey % 5 = 0 THEN 'sam_uei,legal_name,country_code' ELSE 'legal_name,country_code' || CASE WHEN c_custkey % 2 = 0 THEN ',address' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN ',registration_date' ELSE '' END END AS fields FROM customer"""


@query(_TIERS)
def entity_confidence(spark, sf):
    return confident(spark, sf).select("c_custkey", "r.tier", F.col("r.confidence_score").alias("confidence"), F.array_join("r.fields_used", ",").alias("fields"))


@query(f"SELECT tier, count(*) AS n, round(avg(confidence), 6) AS mean FROM ({_TIERS}) GROUP BY tier")
def confidence_tiers(spark, sf):
    return confident(spark, sf).groupBy("r.tier").agg(F.count("*").alias("n"), F.round(F.avg("r.confidence_score"), 6).alias("mean"))


_IDS = "CASE WHEN s_suppkey % 3 = 0 THEN lpad(s_suppkey::VARCHAR, 20, 'Z') END AS lei, CASE WHEN s_suppkey % 3 = 1 THEN lpad(s_suppkey::VARCHAR, 12, '0') END AS uei, sha256(s_name) AS h"


@query(f"SELECT s_suppkey, coalesce('entity:lei:' || lei, 'entity:uei:' || uei, 'entity:hash:' || h) AS primary_id, 'entity:hash:' || h AS verifiable_id, left(h, 12) || '...' AS short, s_suppkey % 3 = 0 AS has_lei, s_suppkey % 3 = 1 AS has_uei, regexp_matches(h, '^[0-9a-f]{{64}}$') AS has_hash, false AS has_bn FROM (SELECT s_suppkey, {_IDS} FROM supplier)")
def identifiers(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.expr("CASE s_suppkey % 3 WHEN 0 THEN concat(' ', lower(lpad(cast(s_suppkey as string), 20, 'Z'))) ELSE 'short' END").alias("l"), F.expr("CASE s_suppkey % 3 WHEN 1 THEN lpad(cast(s_suppkey as string), 12, '0') ELSE 'no good here' END").alias("u"), canonical.hash_text("s_name").alias("h"))
    lei, uei = identity.lei("l"), identity.uei("u")
    h = identity.strict_hash("h")
    return s.select("s_suppkey", identity.primary_identifier(lei, uei, h).alias("primary_id"), identity.verifiable_id(h).alias("verifiable_id"), identity.short_hash("h").alias("short"), lei.isNotNull().alias("has_lei"), uei.isNotNull().alias("has_uei"), canonical.valid_hash("h").isNotNull().alias("has_hash"), identity.business_number("l").isNotNull().alias("has_bn"))


@query(f"""SELECT c_custkey, sha256('{{"jurisdictionIso":"US","legalNameNormalized":"' || lower(c_name) || ' \\u00e9"}}') AS projection_id FROM customer""")
def projection_id(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", canonical.projection_id(jurisdictionIso=F.lit("US"), legalNameNormalized=F.concat(F.lower("c_name"), F.lit(" é"))).alias("projection_id"))


@query("""WITH b AS (SELECT o_orderkey, sha256('{"jurisdictionIso":"US","legalNameNormalized":"' || lower(c_name) || '"}') AS buyer_id FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, buyer_id, sha256('{"buyerId":"' || buyer_id || '","lotId":"' || l_linenumber || '","tenderId":"' || o_orderkey || '"}') AS lot_id, sha256('{"buyerId":"' || buyer_id || '","contractId":"' || l_partkey || '"}') AS contract_id FROM b JOIN lineitem ON l_orderkey = o_orderkey""")
def chained_identity(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    # The buyer's hash is of the order, so it is made before lines multiply it.
    o = records.chained_identity(o.withColumn("j", F.lit("US")), "j", "c_name").select("o_orderkey", "buyer_id")
    x = o.join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey"), "o_orderkey")
    t = {k: F.col(c).cast("string") for k, c in (("t", "o_orderkey"), ("l", "l_linenumber"), ("c", "l_partkey"))}
    return x.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "buyer_id", canonical.projection_id(buyerId="buyer_id", tenderId=t["t"], lotId=t["l"]).alias("lot_id"), canonical.projection_id(buyerId="buyer_id", contractId=t["c"]).alias("contract_id"))


# --- Localization ----------------------------------------------------------


@query(f"SELECT s_suppkey, {_WHERE} AS jurisdiction, CASE s_nationkey % 5 " + " ".join(f"WHEN {i} THEN {duck.localized(_AGENCY, j)}" for i, j in enumerate(_JURISDICTIONS)) + " END AS localized FROM supplier")
def localized_name(spark, sf):
    s = table(spark, sf, "supplier").selectExpr("s_suppkey", f"{_WHERE} as jurisdiction", f"{_AGENCY} as name")
    return localize.localize(s, "name", "jurisdiction", list(_JURISDICTIONS)).drop("name")


@query("SELECT s_suppkey, k AS requested_key, array_to_string(c, ',') AS resolved, array_to_string(h, ',') AS hashes FROM (SELECT s_suppkey, CASE s_nationkey % 5 " + " ".join(f"WHEN {i} THEN {j.lower().replace('-', '/')!r}" for i, j in enumerate(_JURISDICTIONS)) + " END AS k, CASE s_nationkey % 5 " + " ".join(f"WHEN {i} THEN {localize.chain(j)!r}" for i, j in enumerate(_JURISDICTIONS)) + " END AS c, CASE s_nationkey % 5 " + " ".join(f"WHEN {i} THEN {[localize.corpus()[k].config_hash for k in localize.chain(j)]!r}" for i, j in enumerate(_JURISDICTIONS)) + " END AS h FROM supplier)")
def localized_provenance(spark, sf):
    s = table(spark, sf, "supplier").selectExpr("s_suppkey", f"{_WHERE} as jurisdiction", f"{_AGENCY} as name")
    d = localize.localize_detailed(s, "name", "jurisdiction", list(_JURISDICTIONS))
    return d.select("s_suppkey", "requested_key", F.array_join("resolved_keys", ",").alias("resolved"), F.array_join("resolved_hashes", ",").alias("hashes"))


_CONFIGS = ", ".join(f"({duck.q(c.key)}, {'NULL' if c.key == 'base' else duck.q(c.parent if c.parent in localize.corpus() else 'base')})" for c in localize.corpus().values())


@query(f"WITH RECURSIVE t(key, parent) AS (VALUES {_CONFIGS}), up AS (SELECT key, key AS ancestor, 0 AS depth FROM t UNION ALL SELECT up.key, t.parent, up.depth + 1 FROM up JOIN t ON t.key = up.ancestor WHERE t.parent IS NOT NULL) SELECT * FROM up")
def jurisdiction_chain(spark, sf):
    t = localize.config_table(spark)
    known = [r for r in localize.corpus()]
    return vocabulary.ancestors(t.withColumn("parent", F.when(F.col("parent").isin(known) | F.col("parent").isNull(), F.col("parent")).otherwise("base")))


# --- Audits -----------------------------------------------------------------


@query(f"SELECT normalized, count(*)::INT AS n, string_agg(raw, ' || ' ORDER BY pos) AS raws FROM ({_MAP}) GROUP BY 1 HAVING count(*) > 1")
def name_collisions(spark, sf):
    return audit.collisions(mapping(spark, sf)).withColumn("raws", F.array_join("raws", " || "))


@query(f"SELECT normalized, count(*)::INT AS count, string_agg(raw, ' || ' ORDER BY pos) AS raw_variants_joined FROM ({_MAP}) GROUP BY 1 HAVING count(*) > 1")
def collisions_csv(spark, sf):
    return writers.collisions_csv(audit.collisions(mapping(spark, sf)))


@query(f"WITH m AS (SELECT DISTINCT raw, normalized FROM ({_MAP})), g AS (SELECT count(*) AS n FROM m GROUP BY normalized) SELECT (SELECT count(DISTINCT raw) FROM m) AS raw_unique_count, count(*) AS normalized_unique_count, count(*) FILTER (n > 1) AS collision_bucket_count, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS raw_collided_count FROM g")
def collision_summary(spark, sf):
    return audit.summary(mapping(spark, sf))


@query(f"SELECT pos, raw, normalized, sha256(raw || '->' || normalized) AS trace_sha256 FROM ({_MAP})")
def name_mapping(spark, sf):
    m = audit.mapping_distinct(vendors(spark, sf)).withColumn("trace", F.concat_ws("->", "raw", "normalized"))
    return writers.mapping_rows(m, "pos")


@query(f"SELECT normalized, array_to_string(list_sort(list(DISTINCT raw)), ' || ') AS raws FROM ({_MAP}) GROUP BY 1")
def inverted_mapping(spark, sf):
    return audit.inverted(mapping(spark, sf)).withColumn("raws", F.array_join("raws", " || "))


_CUR, _OLD = (f"(SELECT raw, min(normalized) AS normalized FROM ({m}) GROUP BY raw)" for m in (_MAP, _BASE))


def _one(m: DataFrame) -> DataFrame:
    return m.groupBy("raw").agg(F.min("normalized").alias("normalized"))


@query(f"SELECT raw, CASE WHEN b.normalized IS NULL THEN 'added' WHEN c.normalized IS NULL THEN 'removed' ELSE 'changed' END AS change, b.normalized AS old, c.normalized AS new FROM {_CUR} c FULL JOIN {_OLD} b USING (raw) WHERE c.normalized IS DISTINCT FROM b.normalized")
def baseline_diff(spark, sf):
    return audit.baseline_diff(_one(mapping(spark, sf)), _one(baseline(spark, sf)))


@query(f"SELECT DISTINCT raw FROM ({_MAP}) WHERE raw NOT IN (SELECT raw FROM ({_BASE}))")
def names_added(spark, sf):
    return audit.only_in(mapping(spark, sf), baseline(spark, sf))


_MERGES = "SELECT {a}.normalized, array_to_string(list_sort(list(DISTINCT raw)), '|') AS raws, array_to_string(list_sort(list(DISTINCT {b}.normalized)), '|') AS others FROM {cur} c JOIN {old} b USING (raw) GROUP BY 1 HAVING count(DISTINCT {b}.normalized) > 1"


@query(_MERGES.format(a="c", b="b", cur=_CUR, old=_OLD))
def merges(spark, sf):
    return audit.merges(_one(mapping(spark, sf)), _one(baseline(spark, sf))).withColumns({c: F.array_join(c, "|") for c in ("raws", "others")})


@query(_MERGES.format(a="b", b="c", cur=_CUR, old=_OLD))
def splits(spark, sf):
    return audit.splits(_one(mapping(spark, sf)), _one(baseline(spark, sf))).withColumns({c: F.array_join(c, "|") for c in ("raws", "others")})


@query(f"WITH i AS (SELECT normalized, list(DISTINCT raw) AS r FROM ({_MAP}) GROUP BY 1) SELECT normalized, len(r)::INT AS n, len(r) % 2 = 0 AND len(list_filter(r, lambda x: contains(x, 'Ltd.'))) = 0 AS is_approved FROM i")
def approved_merges(spark, sf):
    """Approvals: forms of an even number of names, without those in 'Ltd.'."""
    i = audit.inverted(mapping(spark, sf))
    ok = i.where("size(raws) % 2 = 0").select("normalized", F.filter("raws", lambda r: ~r.contains("Ltd.")).alias("raws"))
    return audit.approved(i, ok).select("normalized", F.size("raws").alias("n"), "is_approved")


@query("SELECT min(p_partkey) AS pos, p_name AS raw_name FROM part GROUP BY p_name")
def distinct_names(spark, sf):
    return readers.distinct_names(table(spark, sf, "part").selectExpr("p_partkey as pos", "concat(' ', p_name, ' ') as raw_name"))


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def keep_first(spark, sf):
    return audit.keep_first(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def keep_last(spark, sf):
    return audit.keep_last(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])


@query("SELECT o_orderkey, o_custkey, ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 10000 AS bucket FROM orders WHERE ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 10000 < 250")
def hash_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").cast("string").alias("k"))
    return readers.hash_sample(o, "k", 250).select("o_orderkey", "o_custkey", readers.hash_bucket("k").alias("bucket"))


# --- Releases ----------------------------------------------------------------

_LINES = "SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS part_pos FROM lineitem"


def release_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(pos, content): each order as a release, its lines as awards with a
    supplier and as contracts; every third order in a package of releases, every
    third in a package of records."""
    line = "struct(concat('a', e.l_linenumber) as id, array(struct(concat('s', e.l_suppkey) as id, concat('Supplier ', e.l_suppkey) as name)) as suppliers, struct(e.l_extendedprice as amount, 'EUR' as currency) as value)"
    contract = "struct(concat('c', e.l_partkey) as id, case when e.l_partkey % 10 = 0 then 'unknown' else concat('a', e.l_linenumber) end as awardID)"
    # Only the lines' own columns are gathered and sorted; what is made of them is made after.
    k = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(k)).alias("x"))
    o = table(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    r = o.select(
        F.col("o_orderkey").alias("pos"),
        F.to_json(F.struct(
            F.concat(F.lit("r-"), "o_orderkey").alias("ocid"), F.lit("1").alias("id"), F.col("o_orderstatus").alias("tag"), F.expr("case when o_orderkey % 2 = 0 then struct(concat('b', o_custkey) as id, concat('Buyer ', o_custkey) as name) end").alias("buyer"),
            F.expr("array(struct(concat('b', o_custkey) as id, concat('Buyer ', o_custkey) as name, array('buyer') as roles))").alias("parties"),
            F.expr("struct(concat('t', o_orderkey) as id, o_orderpriority as title, struct(o_totalprice as amount, 'EUR' as currency) as value, array(struct('1' as id, cast(null as struct<amount:double>) as value), struct('2' as id, struct(5.5D as amount) as value)) as lots)").alias("tender"),
            F.expr(f"transform(x, e -> {line})").alias("awards"), F.expr(f"transform(x, e -> {contract})").alias("contracts"),
        )).alias("t"),
    )
    return r.select("pos", F.expr("""case pos % 3 when 0 then t when 1 then concat('{"releases":[', t, ']}') else concat('{"records":[{"releases":[', t, ']}]}') end""").alias("content"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return releases.build_requests(bundles(spark, sf))


def bundles(spark: SparkSession, sf: str) -> DataFrame:
    return releases.bundles(releases.releases(release_texts(spark, sf)), "EU", "orders")


_SUPPLIERS = "(SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)"
_AWARDED = "(SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"


@query(f"""SELECT o_orderkey AS pos, 'buyer_to_tender' AS kind, 'b' || o_custkey AS from_key, 't' || o_orderkey AS to_key FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT s.l_orderkey, 'supplier_to_award', 's' || s.l_suppkey, 'a' || l.l_linenumber FROM {_SUPPLIERS} s JOIN lineitem l USING (l_orderkey) WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT l.l_orderkey, 'award_to_contract', 'a' || l.l_linenumber, 'c' || l_partkey FROM lineitem l WHERE l_partkey % 10 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)""")
def release_links(spark, sf):
    x = links.release_links(bundles(spark, sf))
    return x.select("pos", F.substring_index("record_type", ".", -1).alias("kind"), "from_key", "to_key")


@query(f"""WITH o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) SELECT record_type, count(*) AS n, count(DISTINCT endpoint) AS endpoints, 0::BIGINT AS errors FROM (
    SELECT 'procurement.buyer' AS record_type, 'b' || o_custkey AS endpoint FROM o UNION ALL SELECT 'procurement.tender', 't' || o_orderkey FROM o UNION ALL SELECT 'procurement.supplier', 's' || l_suppkey FROM {_SUPPLIERS} WHERE l_orderkey IN (SELECT o_orderkey FROM o)
    UNION ALL SELECT 'procurement.award', 'a' || l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) UNION ALL SELECT 'procurement.contract', 'c' || l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)) GROUP BY 1""")
def build_requests(spark, sf):
    return requests(spark, sf).groupBy("record_type").agg(F.count("*").alias("n"), F.countDistinct("endpoint").alias("endpoints"), F.count("error").alias("errors"))


@query(f"""SELECT o_orderkey AS pos, 'r-' || o_orderkey AS ocid, o_orderstatus AS tags, 'b' || o_custkey AS buyer, CASE WHEN o_orderkey % 2 = 0 THEN 'release.buyer' ELSE 'release.parties' END AS buyer_source,
    (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT 's' || l_suppkey AS x FROM {_SUPPLIERS} WHERE l_orderkey = o_orderkey)) AS suppliers, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::INT AS n_awards FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def release_bundles(spark, sf):
    b = bundles(spark, sf)
    return b.select("pos", "ocid", F.array_join("tags", ",").alias("tags"), F.col("buyer.party_id").alias("buyer"), F.col("buyer.party_source").alias("buyer_source"), F.array_join(F.array_sort(F.transform("suppliers", lambda p: p["party_id"])), ",").alias("suppliers"), F.size("awards").alias("n_awards"))


@query("""WITH o AS (SELECT *, sha256('{"jurisdictionIso":"EU","legalNameNormalized":"buyer ' || o_custkey || '"}') AS b FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
    SELECT o_orderkey AS pos, k AS lot_key, o_orderpriority AS title, CASE WHEN k = '1' THEN o_totalprice ELSE 5.5 END AS estimated_value, 'EUR' AS currency, b AS buyer_id, sha256('{"buyerId":"' || b || '","lotId":"' || k || '","tenderId":"t' || o_orderkey || '"}') AS lot_id FROM o, (VALUES ('1'), ('2')) v(k)""")
def small_business_lots(spark, sf):
    lots, _, _ = records.small_business_view(bundles(spark, sf))
    return lots.select("pos", "lot_key", "title", "estimated_value", "currency", "buyer_id", "lot_id")


@query("SELECT l_orderkey AS pos, 'a' || l_linenumber AS contract_key, 's' || l_suppkey AS supplier_key, 'supplier ' || l_suppkey AS legal_name_normalized, 'EU' AS jurisdiction FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def contract_suppliers(spark, sf):
    _, _, related = records.small_business_view(bundles(spark, sf))
    return related.select("pos", "contract_key", "supplier_key", "legal_name_normalized", "jurisdiction")


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, (props::JSON ->> 'none') AS none FROM events")
def json_props(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.try_parse_json("props"))
    return e.select("event_id", F.expr("try_variant_get(v, '$.k', 'bigint')").alias("k"), F.expr("try_variant_get(v, '$.none', 'string')").alias("none"))


# --- Records ----------------------------------------------------------------


@query("""SELECT c_custkey, 'entity' AS kind, 'entity:hash:' || sha256(c_name) AS verifiable_id, 'urn:entity-type#' || lower(c_mktsegment) AS type_uri, 'ACTIVE' AS status, '1900-01-01T00:00:00.000000Z' AS valid_from, 1::BIGINT AS revision, sha256(c_name) AS identifier, 'urn:a' AS attestor, true AS active FROM customer""")
def entity_records(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("legalName"), F.lit("US").alias("jurisdictionIso"), F.lower("c_name").alias("legalNameNormalized"), canonical.hash_text("c_name").alias("entityHash"), F.col("c_mktsegment").alias("entityType"))
    r = records.entity_records(records.attach_attestation(c, records.attestation("urn:a")))
    return records.attested(r).select(F.col("legalName").cast("long").alias("c_custkey"), F.col("recordKind").alias("kind"), F.col("verifiableId").alias("verifiable_id"), F.col("recordTypeUri").alias("type_uri"), F.col("status.statusCode").alias("status"), F.col("timestamps.validFrom").alias("valid_from"), F.col("revisionNumber").alias("revision"), F.col("identifiers")[0]["identifier"].alias("identifier"), F.col("attestations")[0]["attestorId"].alias("attestor"), records.is_active().alias("active"))


@query("""SELECT c_custkey, concat_ws(';', CASE WHEN c_custkey % 3 = 0 THEN 'missing legalName' END, CASE WHEN c_custkey % 5 = 0 THEN 'missing entityHash' END, CASE WHEN c_custkey % 2 = 0 THEN 'attestations must not be empty' END) AS errors FROM customer""")
def payload_errors(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey", "'US' as jurisdictionIso", "case when c_custkey % 3 = 0 then ' ' else c_name end as legalName", "c_name as legalNameNormalized", "case when c_custkey % 5 <> 0 then c_name end as entityHash", "c_mktsegment as entityType", "case when c_custkey % 2 = 0 then array() else array('x') end as attestations")
    return c.select("c_custkey", F.array_join(records.payload_errors(c), ";").alias("errors"))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN raw END AS legal_name, j AS jurisdiction, CASE WHEN p_partkey % 4 <> 0 THEN n END AS normalized, CASE WHEN p_partkey % 4 <> 0 THEN sha256('{{"jurisdictionIso":"' || j || '","legalNameNormalized":"' || n || '"}}') END AS projection_id, CASE WHEN p_partkey % 4 = 0 THEN 'missing legal name' END AS error, 1 AS n_attestations FROM (SELECT *, {_VENDOR} AS raw, {duck.legal_name(_VENDOR)} AS n, CASE WHEN p_size > 25 THEN 'US-WI' ELSE 'US-IL' END AS j FROM part)""")
def vendor_adapter(spark, sf):
    raw = table(spark, sf, "part").selectExpr("p_partkey", f"case p_partkey % 4 when 0 then ' ' when 1 then {_VENDOR} end as vendor_name", f"case when p_partkey % 4 >= 2 then {_VENDOR} end as `Vendor Name`", "case when p_size > 25 then 'US-WI' else '' end as jurisdiction_iso")
    a = records.Adapter("vendor", "US-IL", "vendor_list", "vendor", records.adapter("vendor", "US-IL", "vendor_list").names, passthrough=("p_partkey",))
    return a.run(raw).select("p_partkey", F.col("legalName").alias("legal_name"), F.col("jurisdictionIso").alias("jurisdiction"), F.col("legalNameNormalized").alias("normalized"), F.when(F.col("error").isNull(), F.col("projection_id")).alias("projection_id"), "error", F.size("attestations").alias("n_attestations"))


@query("SELECT o_orderkey, o_custkey, sha256(o_orderkey::VARCHAR) AS row_hash, lag(sha256(o_orderkey::VARCHAR)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous_hash FROM orders")
def revision_chain(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", canonical.hash_text(F.col("o_orderkey").cast("string")).alias("row_hash"))
    return records.revision_chain(o, "o_custkey", "o_orderkey", "row_hash")


@query("""SELECT n_nationkey::VARCHAR AS record_id, 'urn:schema:notice' AS record_schema_uri, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS payload FROM nation""")
def minimal_envelope(spark, sf):
    return records.minimal_envelope(table(spark, sf, "nation"), "n_nationkey")


@query("""SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS value FROM nation""")
def json_lines(spark, sf):
    return writers.json_lines(table(spark, sf, "nation"))


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE o_totalprice <= 250000 END AS friendly, CASE WHEN o_orderkey % 7 = 0 THEN 'Inconclusive: whether this lot suits small businesses.' WHEN o_totalprice <= 250000 THEN 'Highlighted: this lot suits small businesses.' ELSE 'This lot misses the criteria for small businesses.' END AS headline,
    concat_ws(' ', CASE WHEN o_orderkey % 7 = 0 THEN 'The assessment for small businesses stays inconclusive, as data is missing.' WHEN o_totalprice <= 250000 THEN 'Judged by its estimated value and its procedure, this lot suits small businesses.' ELSE 'Judged by its estimated value and its procedure, this lot does not suit small businesses.' END,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'The estimated value is ' || CASE WHEN contains(rtrim(v, '0') || '|', '.|') THEN rtrim(v, '0') || '0' ELSE rtrim(v, '0') END || ' EUR, the threshold 250000.0 EUR.' END, 'The procedure is ''' || o_orderpriority || '''.', CASE WHEN o_orderkey % 2 = 0 THEN 'Classification codes: 1, ' || o_orderstatus || '.' END) AS narrative, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS n_codes
    FROM (SELECT *, o_totalprice::DECIMAL(38, 6)::VARCHAR AS v FROM orders)""")
def explanations(spark, sf):
    o = table(spark, sf, "orders").selectExpr("cast(o_orderkey as string) as lot_id", "case when o_orderkey % 7 <> 0 then o_totalprice end as amount", "cast(null as string) as currency", "o_orderpriority as procedure_type", "case when o_orderkey % 2 = 0 then array('1', o_orderstatus) end as codes", "0.5D as win_rate")
    return explain.explanations(o).select(F.col("subject_id").cast("long").alias("o_orderkey"), F.col("evidence.isFriendlyByValue").alias("friendly"), "headline", "narrative", F.col("evidence.numCodes").alias("n_codes"))


# --- Validation ---------------------------------------------------------------

_SCHEMA = {
    "required": ["l_orderkey", "l_suppkey"],
    "properties": {"l_quantity": {"type": "number", "minimum": 2, "maximum": 45}, "l_returnflag": {"enum": ["A", "N"]}, "l_linestatus": {"type": "string", "pattern": "^[A-M]$"}, "l_linenumber": {"type": "integer", "minimum": 1}},
}
_FAILS = {"l_quantity: least 2": "l_quantity < 2", "l_quantity: most 45": "l_quantity > 45", "l_returnflag: enum ('A', 'N')": "l_returnflag NOT IN ('A', 'N')", "l_linestatus: pattern ^[A-M]$": "NOT regexp_matches(l_linestatus, '^[A-M]$')", "l_linenumber: least 1": "l_linenumber < 1"}
_ERRORS = "concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN {duck.q(m)} END" for m, c in _FAILS.items()) + ")"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_ERRORS} AS errors FROM lineitem")
def schema_errors(spark, sf):
    e = validate.errors(validate.from_json_schema(_SCHEMA))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(F.transform(e, lambda x: x["message"]), ";").alias("errors"))


@query("SELECT count(*) AS n_records, coalesce(sum(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in _FAILS.values()) + "), 0)::BIGINT AS n_errors, false AS ok FROM lineitem")
def validation_summary(spark, sf):
    return validate.summary(table(spark, sf, "lineitem").select(validate.errors(validate.from_json_schema(_SCHEMA)).alias("errors")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def referential_orphans(spark, sf):
    rich = table(spark, sf, "supplier").where("s_acctbal > 5000")
    return validate.orphans(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_suppkey", rich, "s_suppkey")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return validate.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def cardinality_exceeded(spark, sf):
    return validate.cardinality(table(spark, sf, "orders"), "o_custkey", 12)


@query("WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem) SELECT * FROM e WHERE src <= dst AND (dst, src) IN (SELECT (src, dst) FROM e)")
def symmetric_pairs(spark, sf):
    return validate.symmetric_pairs(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate > l_shipdate")
def not_monotonic(spark, sf):
    x = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return validate.not_monotonic(x, "o_orderdate", "l_shipdate").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# --- Resolution and graphs ----------------------------------------------------


def _people(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer")
    e = c.selectExpr("c_custkey as entity_id", "concat('n', c_custkey div 3) as name", "concat('j', c_nationkey % 5) as jurisdiction", "c_mktsegment as entity_type", "cast(c_nationkey % 10 as string) as country")
    i = c.where("c_custkey % 4 = 0").selectExpr("c_custkey as entity_id", "'lei' as scheme", "concat('L', c_custkey div 8) as value")
    return e, i.union(c.where("c_custkey % 6 = 0").selectExpr("c_custkey as entity_id", "'uei' as scheme", "concat('U', c_custkey div 24) as value"))


_PEOPLE = """e AS (SELECT c_custkey AS id, 'n' || (c_custkey // 3) AS name, 'j' || (c_nationkey % 5) AS j, c_mktsegment AS t, (c_nationkey % 10)::VARCHAR AS c FROM customer),
    i AS (SELECT c_custkey AS id, 'lei' AS s, 'L' || (c_custkey // 8) AS v FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'uei', 'U' || (c_custkey // 24) FROM customer WHERE c_custkey % 6 = 0),
    p AS (SELECT a, b, string_agg(DISTINCT k, ',' ORDER BY k) AS kinds FROM (SELECT x.id AS a, y.id AS b, 'name' AS k FROM e x JOIN e y ON x.name = y.name AND x.j = y.j AND x.id < y.id UNION ALL SELECT x.id, y.id, 'identifier' FROM i x JOIN i y ON x.s = y.s AND x.v = y.v AND x.id < y.id) GROUP BY a, b),
    d AS (SELECT a, b, CASE WHEN agrees AND (contra OR x.c <> y.c) THEN 4 WHEN agrees THEN 2 WHEN x.name = y.name AND x.j = y.j AND x.t = y.t AND NOT contra THEN 3 ELSE 5 END AS rule FROM
      (SELECT a, b, coalesce((SELECT bool_or(u.v = w.v) FROM i u JOIN i w ON u.s = w.s WHERE u.id = a AND w.id = b), false) AS agrees, coalesce((SELECT bool_or(u.v <> w.v) FROM i u JOIN i w ON u.s = w.s WHERE u.id = a AND w.id = b), false) AS contra FROM p) JOIN e x ON x.id = a JOIN e y ON y.id = b)"""


def _decided(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e, i = _people(spark, sf)
    return e, resolve.evidence(resolve.candidate_pairs(resolve.blocks(e, i)), e, i)


@query(f"WITH {_PEOPLE} SELECT a, b, kinds FROM p")
def candidate_pairs(spark, sf):
    return resolve.candidate_pairs(resolve.blocks(*_people(spark, sf)))


@query(f"WITH {_PEOPLE} SELECT a, b, rule, CASE WHEN rule = 4 THEN 'conflict' WHEN rule = 5 THEN 'separate' ELSE 'merge' END AS decision FROM d")
def identity_evidence(spark, sf):
    return _decided(spark, sf)[1]


@query(f"WITH {_PEOPLE} SELECT 'IdentifierConflict' AS conflict_type, a || ',' || b AS entities, 'unresolved' AS resolution_status FROM d WHERE rule = 4")
def identity_conflicts(spark, sf):
    return resolve.conflicts(_decided(spark, sf)[1])


_CLOSURE = f"WITH RECURSIVE {_PEOPLE}, m AS (SELECT a, b FROM d WHERE rule IN (2, 3) UNION SELECT b, a FROM d WHERE rule IN (2, 3)), r AS (SELECT id AS x, id AS y FROM e UNION SELECT r.x, m.b FROM r JOIN m ON m.a = r.y), k AS (SELECT x AS entity_id, min(y) AS cluster FROM r GROUP BY x)"


@query(f"{_CLOSURE} SELECT * FROM k")
def identity_clusters(spark, sf):
    e, i = _people(spark, sf)
    return resolve.clusters(e, resolve.merge_links(e, i))


@query(f"""{_CLOSURE} SELECT cluster, 'entity-cluster:' || rtrim(translate(to_base64(unhex(sha256('{{"members":["' || string_agg(entity_id::VARCHAR, '","' ORDER BY entity_id::VARCHAR) || '"],"version":"1.0.0"}}'))), '+/', '-_'), '=') AS cluster_id, count(*)::INT AS n_members FROM k GROUP BY cluster""")
def cluster_ids(spark, sf):
    return resolve.cluster_ids(identity_clusters(spark, sf))


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    nodes = n.selectExpr("concat('n', n_nationkey) as node", "'nation' as node_type", "true as is_entity", "concat('{\"k\":', n_nationkey, '}') as payload").union(r.selectExpr("concat('r', r_regionkey)", "'region'", "false", "cast(null as string)"))
    return nodes, n.selectExpr("'in' as edge_type", "concat('n', n_nationkey) as src", "concat('r', n_regionkey) as dst", "cast(null as string) as payload")


_REGION = """SELECT 'r' || n_regionkey AS node, 'node:' || rtrim(translate(to_base64(unhex(sha256('{"incidentEdges":[' || string_agg('in|in|n' || n_nationkey, ',' ORDER BY 'n' || n_nationkey) || '],"nodeType":"region","payload":{}}'))), '+/', '-_'), '=') AS node_id FROM nation GROUP BY n_regionkey"""


@query(f"WITH r AS ({_REGION}) SELECT 'in' AS edge_type, 'n' || n_nationkey AS src, node_id AS dst, '{{}}' AS payload FROM nation JOIN r ON node = 'r' || n_regionkey")
def graph_normal_form(spark, sf):
    return graph.normal_form(*_graph(spark, sf))[1]


@query(f"""WITH r AS ({_REGION}), h AS (SELECT 'n' AS k, sha256('nation|n' || n_nationkey || '|{{"k":' || n_nationkey || '}}') AS h FROM nation UNION ALL SELECT 'n', sha256('region|' || node_id || '|{{}}') FROM r UNION ALL SELECT 'e', sha256('in|n' || n_nationkey || '|' || node_id || '|{{}}') FROM nation JOIN r ON node = 'r' || n_regionkey),
    p AS (SELECT k, left(h, 2) AS p, count(*) AS n, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM h GROUP BY 1, 2) SELECT sum(n) FILTER (k = 'n')::BIGINT AS n_nodes, sum(n) FILTER (k = 'e')::BIGINT AS n_edges, sha256(string_agg(k || ':' || p || ':' || h, ',' ORDER BY k || ':' || p || ':' || h)) AS graph_hash FROM p""")
def graph_hash(spark, sf):
    return graph.graph_hash(*graph.normal_form(*_graph(spark, sf))).drop("graph_tag")


# --- Events ------------------------------------------------------------------


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def sessions(spark, sf):
    return windows.sessions(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


_HOURS = "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n_events, round(avg(value), 4) AS mean, max(value) AS most FROM events GROUP BY 1, 2"


@query(_HOURS)
def feature_windows(spark, sf):
    return windows.feature_windows(table(spark, sf, "events")).withColumn("mean", F.round("mean", 4))


@query(f"SELECT * FROM ({_HOURS}) WHERE n_events >= 5")
def alerts(spark, sf):
    return windows.alerts(feature_windows(spark, sf), 5)


@query("SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS sequence_index FROM events")
def segments(spark, sf):
    return windows.segments(table(spark, sf, "events"))


@query("SELECT DISTINCT * FROM events")
def deduplicated_events(spark, sf):
    e = table(spark, sf, "events")
    return windows.deduplicated(e.union(e))


# --- Named functions -----------------------------------------------------------


@query(f"SELECT p_partkey, {_VENDOR} AS raw_name, sha256({_VENDOR}) AS hash_text FROM part")
def named_functions(spark, sf):
    return named.apply(vendors(spark, sf).withColumnRenamed("pos", "p_partkey"), "hash_text", "raw_name")
