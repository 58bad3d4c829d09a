"""More queries with their SQL: schemas, registries, adapters, identifiers,
SQL functions, and files that are written from the tables and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall import duck
from rollcall.functions import canonical, dates, identity, localize, normalize
from rollcall.operators import audit, links, records, resolve, validate, vocabulary
from rollcall.plans import functions as named
from rollcall.queries import _ADDRESS, _SUPPLIERS, _VENDOR, _people, confident, query, requests, vendors
from rollcall.session import checkpoint_dir, table
from rollcall.sources import readers, writers


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- SQL functions


@query(f"""SELECT p_partkey, {duck.legal_name(_VENDOR)} AS normalized, sha256({duck.hash_string(_VENDOR, "'us'")}) AS entity_hash,
    trim(regexp_replace(lower({_VENDOR}), '[^a-z0-9]+', '-', 'g'), '-') AS slug, {duck.address("concat(p_partkey::VARCHAR, ' N. Main St., Suite 4')")} AS address FROM part""")
def sql_functions(spark, sf):
    named.register(spark, ["normalize_legal_name", "normalize_address", "entity_hash", "slug"])
    part = table(spark, sf, "part").selectExpr("p_partkey", f"{_VENDOR} as raw")
    return spark.sql("SELECT p_partkey, normalize_legal_name(raw) AS normalized, entity_hash(raw, 'us') AS entity_hash, slug(raw) AS slug, normalize_address(concat(cast(p_partkey AS STRING), ' N. Main St., Suite 4')) AS address FROM {part}", part=part)


# --- Schemas

_DEEP = {
    "type": "object", "required": ["id", "lines"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "exclusiveMinimum": 0},
        "status": {"type": "string", "minLength": 1, "maxLength": 1, "not": {"const": "P"}},
        "day": {"type": "string", "format": "date"},
        "clerk": {"oneOf": [{"pattern": "1$"}, {"pattern": "[13]$"}]},
        "priority": {"anyOf": [{"const": "1-URGENT"}, {"pattern": "^[2-5]"}], "type": "string"},
        "total": {"$ref": "#/$defs/amount"},
        "lines": {"type": "array", "minItems": 2, "maxItems": 6, "uniqueItems": True, "items": {"type": "object", "required": ["flag"], "properties": {"flag": {"enum": ["A", "N", "R"]}, "quantity": {"type": "number", "exclusiveMaximum": 50, "multipleOf": 2}}}},
    },
    "$defs": {"amount": {"type": "number", "maximum": 300000}},
}


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT (CASE WHEN l_quantity < 5 THEN NULL ELSE l_returnflag END, l_quantity)) AS d, bool_or(l_quantity >= 50)::INT AS x, count(*) FILTER (l_quantity >= 50) AS big, count(*) FILTER (l_quantity % 2 <> 0) AS odd, count(*) FILTER (l_quantity < 5) AS none FROM lineitem GROUP BY 1)
    SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey = 0 THEN 'id:exclusiveMinimum' END, CASE WHEN o_orderkey % 5 = 0 THEN 'status:minLength' END, CASE WHEN o_orderkey % 5 = 1 THEN 'status:maxLength' END, CASE WHEN o_orderkey % 5 > 1 AND o_orderstatus = 'P' THEN 'status:not' END,
      CASE WHEN o_orderkey % 3 = 0 THEN 'day:format' END, CASE WHEN right(o_orderkey::VARCHAR, 1) <> '3' THEN 'clerk:oneOf' END, CASE WHEN left(o_orderpriority, 1) NOT IN ('2', '3', '4', '5') AND o_orderpriority <> '1-URGENT' THEN 'priority:anyOf' END,
      CASE WHEN o_totalprice > 300000 THEN 'total:maximum' END, CASE WHEN l.n IS NULL OR l.n < 2 THEN 'lines:minItems' END, CASE WHEN l.n > 6 THEN 'lines:maxItems' END, CASE WHEN d < l.n THEN 'lines:uniqueItems' END,
      CASE WHEN none > 0 THEN array_to_string(list_transform(range(none), lambda i: 'lines[]:required'), ',') END, CASE WHEN big > 0 THEN array_to_string(list_transform(range(big), lambda i: 'lines[].quantity:exclusiveMaximum'), ',') END,
      CASE WHEN odd > 0 THEN array_to_string(list_transform(range(odd), lambda i: 'lines[].quantity:multipleOf'), ',') END, CASE WHEN o_orderkey % 4 = 0 THEN ':additionalProperties' END) AS errors FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def schema_violations(spark, sf):
    """Nested orders against a schema of nearly all keywords."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.expr("struct(case when l_quantity >= 5 then l_returnflag end as flag, l_quantity as quantity)")).alias("lines"))
    o = table(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").selectExpr(
        "o_orderkey as id", "case o_orderkey % 5 when 0 then '' when 1 then 'FF' else o_orderstatus end as status", "concat(substring(cast(o_orderdate as string), 1, 10), case when o_orderkey % 3 = 0 then 'x' else '' end) as day",
        "cast(o_orderkey as string) as clerk", "o_orderpriority as priority", "o_totalprice as total", "coalesce(lines, array()) as lines", "case when o_orderkey % 4 = 0 then 'extra' end as note",
    )
    e = validate.with_violations(o, _DEEP)
    order = ["id:exclusiveMinimum", "status:minLength", "status:maxLength", "status:not", "day:format", "clerk:oneOf", "priority:anyOf", "total:maximum", "lines:minItems", "lines:maxItems", "lines:uniqueItems", "lines[]:required", "lines[].quantity:exclusiveMaximum", "lines[].quantity:multipleOf", ":additionalProperties"]
    place = F.array(*map(F.lit, order))
    keyed = F.array_sort(F.transform("errors", lambda x: F.struct(F.array_position(place, F.concat_ws(":", x["path"], x["rule"])).alias("p"), F.concat_ws(":", x["path"], x["rule"]).alias("e"))))
    return e.select(F.col("id").alias("o_orderkey"), F.array_join(F.transform(keyed, lambda x: x["e"]), ",").alias("errors"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'json' WHEN event_id % 4 = 1 THEN 'required' ELSE '' END AS rules FROM events")
def json_errors(spark, sf):
    lines = table(spark, sf, "events").selectExpr("event_id", "case event_id % 4 when 0 then '{\"k\": 1' when 1 then '{}' else '{\"k\": 2}' end as value")
    found = validate.json_errors(lines, validate.from_json_schema({"required": ["k"], "properties": {"k": {"type": "integer"}}}), "k int")
    return found.select("event_id", F.array_join(F.transform("errors", lambda e: e["rule"]), ",").alias("rules"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'the file is empty' WHEN event_id % 3 = 1 THEN 'the file isn''t JSON' END AS error, CASE WHEN event_id % 3 = 2 THEN event_id::VARCHAR END AS k, CASE WHEN event_id % 3 = 1 THEN '2,6' END AS place FROM events")
def parse_errors(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "case event_id % 3 when 0 then ' ' when 1 then '{\n\"k\":1' else concat('{\"k\":', event_id, '}') end as content")
    p = readers.parsed(e, "struct<k:bigint>")
    at = validate.json_places("content")
    return p.select("event_id", "error", F.col("record.k").cast("string").alias("k"), F.when(F.col("error") == "the file isn't JSON", F.concat_ws(",", at["line"].cast("string"), at["column"].cast("string"))).alias("place"))


@query("SELECT c_custkey, CASE WHEN (c_custkey % 2 = 0) = (c_custkey % 3 = 0) THEN 'exactly one of a, b' END AS error FROM customer")
def exactly_one(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey", "case when c_custkey % 2 = 0 then 1 end as a", "case when c_custkey % 3 = 0 then 1 end as b")
    return c.select("c_custkey", validate.exactly_one("a", "b").alias("error"))


@query("SELECT DISTINCT x AS node FROM (SELECT unnest([c_custkey, c_custkey + 1, c_custkey + 2]) AS x FROM customer WHERE c_custkey % 10 = 0)")
def on_cycles(spark, sf):
    """Rings of three, each with a tail: the tail is on no cycle."""
    c = table(spark, sf, "customer").where("c_custkey % 10 = 0")
    ring = c.selectExpr("explode(array(struct(c_custkey as src, c_custkey + 1 as dst), struct(c_custkey + 1 as src, c_custkey + 2 as dst), struct(c_custkey + 2 as src, c_custkey as dst), struct(c_custkey + 2 as src, c_custkey + 5 as dst), struct(c_custkey + 5 as src, c_custkey + 6 as dst))) as e")
    return validate.on_cycles(ring.select("e.*"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def unknown_terms(spark, sf):
    terms = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "term_uri string")
    return vocabulary.unknown_terms(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", terms)


# --- Localization

_KEYS = sorted(localize.corpus())
_KEY = "CASE s_suppkey % {n} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KEYS)) + " END"
_FIRMS = "concat(s_name, CASE s_suppkey % 7 WHEN 0 THEN ' GmbH, & Co. KG' WHEN 1 THEN ' S.A.' WHEN 2 THEN ' Dept.' WHEN 3 THEN ' Sp. z o.o.' WHEN 4 THEN ' (EU)' WHEN 5 THEN ' A/S' ELSE ' Inc' END)"


@query(f"SELECT s_suppkey, CASE s_suppkey % {len(_KEYS)} " + " ".join(f"WHEN {i} THEN {duck.localized(_FIRMS, k)}" for i, k in enumerate(_KEYS)) + " END AS localized FROM supplier")
def localized_everywhere(spark, sf):
    """Firms in the words of all jurisdictions that there are."""
    s = table(spark, sf, "supplier").selectExpr("s_suppkey", f"{_KEY.format(n=len(_KEYS))} as j", f"{_FIRMS} as name")
    return localize.localize(s, "name", "j").select("s_suppkey", "localized")


@query(f"SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN {duck.localized('s_name', 'us')} WHEN 1 THEN {duck.localized('s_name', 'eu')} ELSE {duck.localized('s_name', 'base')} END AS localized FROM supplier")
def localization_fallback(spark, sf):
    s = table(spark, sf, "supplier").selectExpr("s_suppkey", "case s_suppkey % 3 when 0 then 'US-ZZ' when 1 then 'eu/xx' else 'nowhere' end as j", "s_name as name")
    return localize.localize(s, "name", "j").select("s_suppkey", "localized")


_OWN = {"jurisdiction": "XX", "abbreviations": {"1st": "first", "étage": "floor"}, "stop_words": ["the"], "rules": [{"pattern": "#0+", "replacement": "#", "is_regex": True, "order": 1}, {"pattern": "OFF", "replacement": "", "enabled": False}]}


@query("SELECT s_suppkey, 'first floor supplier#' || ltrim(regexp_extract(s_name, '#(.*)$', 1), '0') AS localized FROM supplier")
def own_configuration(spark, sf):
    c = localize.from_mapping(_OWN)
    return table(spark, sf, "supplier").select("s_suppkey", localize.apply_localization(F.concat(F.lit("The 1st étage "), "s_name"), "xx", {"xx": c, "base": localize.Config("base")}).alias("localized"))


# --- Names and dates


_LEGACY = normalize.LEGACY_WORDS


@query(f"SELECT c_custkey, {duck.collapse(duck.without(duck.collapse(duck.tokens(duck.collapse(duck.sub(f'lower({_ADDRESS})', '[^A-Za-z0-9' + chr(92) + 's]')), _LEGACY, True)), normalize.STOP))} AS normalized FROM customer")
def legal_name_legacy(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", normalize.normalize_legal_name(F.expr(_ADDRESS), "legacy").alias("normalized"))


@query("SELECT c_custkey, c_custkey::VARCHAR || ' north sudstern street' AS address FROM customer")
def address_script_preserving(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", normalize.normalize_address(F.expr("concat(cast(c_custkey as string), ' N. Südstern St., Apt. 4b')"), "script_preserving").alias("address"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts END AS strict, CASE WHEN event_id % 3 < 2 THEN ts END AS lax FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def timestamps_parsed(spark, sf):
    t = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
    e = table(spark, sf, "events").selectExpr("event_id", f"case event_id % 3 when 0 then concat({t}, 'Z') when 1 then {t} else date_format(ts, 'yyyy-MM') end as t")
    return e.select("event_id", dates.parse_timestamp("t").cast("timestamp_ntz").alias("strict"), dates.parse_timestamp("t", offset=False).cast("timestamp_ntz").alias("lax"))


@query("SELECT doc_id, sha256('[{\"after\":\"' || lower(source) || '\",\"before\":\"' || upper(source) || '\",\"rule\":\"lower\"}]') AS trace FROM documents")
def trace_hash(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", "array(struct('lower' as rule, upper(source) as before, lower(source) as after)) as steps")
    return d.select("doc_id", canonical.hash_text(writers.trace_json("steps")).alias("trace"))


@query("SELECT min(p_partkey) AS pos, p_name AS raw_name FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 500) GROUP BY p_name")
def names_of_first_rows(spark, sf):
    """The limit counts rows before repeats are taken out, as the audits do."""
    return readers.distinct_names(table(spark, sf, "part").selectExpr("p_partkey as pos", "p_name as raw_name"), limit=500)


# --- Identifiers and records


@query("""SELECT s_suppkey, s_suppkey % 4 <> 3 OR s_suppkey % 2 = 0 AS has_any, CASE WHEN s_suppkey % 2 = 0 THEN 'a:1,b:2' ELSE '' END AS schemes, s_suppkey % 4 = 2 AS has_bn,
    '{"additional":[' || CASE WHEN s_suppkey % 2 = 0 THEN '{"scheme_uri":"a","value":"1"},{"scheme_uri":"b","value":"2"}' ELSE '' END || ']' || CASE WHEN s_suppkey % 4 = 2 THEN ',"bn":"123456789RC' || lpad((s_suppkey % 10000)::VARCHAR, 4, '0') || '"' ELSE '' END || CASE WHEN s_suppkey % 4 = 0 THEN ',"lei":"' || lpad(s_suppkey::VARCHAR, 20, 'Z') || '"' ELSE '' END || CASE WHEN s_suppkey % 4 = 1 THEN ',"uei":"' || lpad(s_suppkey::VARCHAR, 12, '0') || '"' ELSE '' END || '}' AS text FROM supplier""")
def identifier_sets(spark, sf):
    s = table(spark, sf, "supplier").selectExpr("s_suppkey", "case s_suppkey % 4 when 0 then lpad(cast(s_suppkey as string), 20, 'Z') end as l", "case s_suppkey % 4 when 1 then lpad(cast(s_suppkey as string), 12, '0') end as u", "case s_suppkey % 4 when 2 then concat('123456789rc', lpad(cast(s_suppkey % 10000 as string), 4, '0')) end as b", "case when s_suppkey % 2 = 0 then array(struct('b' as scheme_uri, '2' as value), struct('a' as scheme_uri, '1' as value)) else array() end as more")
    lei, uei, bn, none = identity.lei("l"), identity.uei("u"), identity.business_number("b"), F.lit(None).cast("string")
    return s.select(
        "s_suppkey", identity.has_any_identifier(lei, uei, none, bn, additional=F.col("more")).alias("has_any"), F.array_join(F.transform(identity.sorted_schemes(F.col("more")), lambda x: F.concat_ws(":", x["scheme_uri"], x["value"])), ",").alias("schemes"),
        bn.isNotNull().alias("has_bn"), identity.canonical_identifiers(lei, uei, none, bn, F.col("more")).alias("text"),
    )


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 1 WHEN c_custkey % 5 = 0 THEN 2 ELSE 3 END AS tier, 5 AS n_keys FROM customer")
def confidence_json(spark, sf):
    j = confident(spark, sf).select("c_custkey", identity.detailed_json(F.col("r")).alias("j"))
    return j.select("c_custkey", F.get_json_object("j", "$.tier").cast("int").alias("tier"), F.size(F.json_object_keys("j")).alias("n_keys"))


@query("""SELECT n_nationkey, '"attestationTimestamp":"1900-01-01T00:00:00.000000Z","attestorId":"urn:a","proofPurpose":"assertionMethod","proofType":"ManualAttestation","verificationMethodUri":"urn:attestation:manual"' AS text, n_nationkey % 2 = 0 AS active FROM nation""")
def attestation_strings(spark, sf):
    n = table(spark, sf, "nation").withColumn("status", F.expr("struct(case when n_nationkey % 2 = 0 then 'ACTIVE' else 'DISSOLVED' end as statusCode)"))
    return n.select("n_nationkey", records.attestation_text(records.attestation("urn:a")).alias("text"), records.is_active().alias("active"))


_WHOLE = "c_custkey % 3 <> 0"


@query(f"SELECT c_custkey, {_WHOLE} AS whole, CASE WHEN {_WHOLE} THEN 'entity:hash:' || sha256(c_name) END AS verifiable_id, CASE WHEN {_WHOLE} THEN 'urn:entity-type#' || lower(c_mktsegment) END AS type_uri, CASE WHEN c_custkey % 2 = 0 THEN 'risk' END AS tag FROM customer")
def entity_json(spark, sf):
    """Records from JSON payloads: a third lack a field; half have two context
    tags, of which one lacks its author."""
    c = table(spark, sf, "customer")
    a = F.array(records.attestation("urn:a"))
    tags = F.expr("case when c_custkey % 2 = 0 then array(struct('urn:t' as tag_type_uri, 'risk' as code, 'me' as applied_by, '2024-01-01T00:00:00Z' as applied_at, 0.5D as confidence), struct('urn:t' as tag_type_uri, 'bad' as code, cast(null as string) as applied_by, '2024-01-01T00:00:00Z' as applied_at, 0.5D as confidence)) end")
    p = c.select("c_custkey", F.to_json(F.struct(F.when(F.expr(_WHOLE), F.col("c_name")).alias("legalName"), F.lit("US").alias("jurisdictionIso"), F.lower("c_name").alias("legalNameNormalized"), canonical.hash_text("c_name").alias("entityHash"), F.col("c_mktsegment").alias("entityType"), a.alias("attestations"), tags.alias("ctags"))).alias("p"))
    r = p.select("c_custkey", records.entity_json("p").alias("r"), records.context_tags("p").alias("t"))
    return r.select("c_custkey", F.col("r").isNotNull().alias("whole"), F.get_json_object("r", "$.verifiableId").alias("verifiable_id"), F.get_json_object("r", "$.recordTypeUri").alias("type_uri"), F.nullif(F.array_join(F.transform("t", lambda t: t["code"]), ","), F.lit("")).alias("tag"))


@query("SELECT c_custkey::VARCHAR AS name, CASE WHEN c_custkey % 4 = 0 THEN 'missing entityHash' ELSE '' END AS errors FROM customer")
def raw_facade(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("US").alias("jurisdictionIso"), F.col("c_custkey").cast("string").alias("legalName"), F.lower("c_name").alias("legalNameNormalized"), F.expr("case when c_custkey % 4 <> 0 then sha2(c_name, 256) end").alias("entityHash"), F.col("c_mktsegment").alias("entityType"))
    good, bad = records.from_raw(records.attach_attestation(c, records.attestation("urn:a")))
    return good.select(F.col("legalName").alias("name"), F.lit("").alias("errors")).union(bad.select("legalName", F.array_join("errors", ";")))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Town ' || n_name WHEN 1 THEN n_name END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'XX' ELSE 'US-' || left(n_name, 2) END AS jurisdiction, 'US' AS country, 'slice' AS entity_type, CASE n_nationkey % 3 WHEN 0 THEN 'Town ' || n_name WHEN 1 THEN '' ELSE '' END AS present FROM nation""")
def mixed_inputs(spark, sf):
    n = table(spark, sf, "nation").selectExpr("n_nationkey", "case n_nationkey % 3 when 0 then concat('Town ', n_name) else '' end as official_name", "case n_nationkey % 3 when 1 then n_name end as committee_name", "left(n_name, 2) as state", "case when n_nationkey % 2 = 0 then 'XX' end as jurisdiction", "'slice' as folder")
    x = n.withColumn("k", F.col("n_nationkey")).withColumn("present", records.first_present(n, "official_name", "committee_name"))
    both = records.example_inputs(x.withColumn("address", F.to_json(F.struct("k", "present"))))
    return both.select(F.get_json_object("address", "$.k").cast("int").alias("n_nationkey"), "name", "jurisdiction", "country", "entity_type", F.get_json_object("address", "$.present").alias("present"))


@query(f"""SELECT kind, k, CASE WHEN k % 4 <> 0 THEN {duck.legal_name('raw')} END AS normalized, j AS jurisdiction, CASE WHEN k % 4 = 0 THEN 'missing legal name' WHEN j IS NULL THEN 'missing jurisdiction' END AS error FROM
    (SELECT unnest([['municipality', 'US-MN'], ['school_district', NULL], ['donor', 'US'], ['program', NULL]]) AS t, t[1] AS kind, t[2] AS j, s_suppkey AS k, 'The ' || s_name || ' Assn.' AS raw FROM supplier)""")
def registered_adapters(spark, sf):
    s = table(spark, sf, "supplier").selectExpr("s_suppkey as k", "case when s_suppkey % 4 <> 0 then concat('The ', s_name, ' Assn.') else ' ' end as name")
    out = None
    for key, column in ((("municipality", "US-MN", "city_list"), "name"), (("school_district", None, "district_list"), "district_name"), (("campaign_finance", "US", "filings"), "donor_name"), (("program", None, "state_portal"), "program_name")):
        a = records.adapter(*key)
        a = records.Adapter(a.domain, a.jurisdiction, a.source_system, a.entity_type, a.names, (*a.passthrough, "k"))
        one = a.run(s.withColumnRenamed("name", column)).select(F.col("entityType").alias("kind"), "k", F.col("legalNameNormalized").alias("normalized"), F.col("jurisdictionIso").alias("jurisdiction"), "error")
        out = one if out is None else out.union(one)
    return out


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'first' WHEN p_partkey % 3 = 1 THEN 'second' END AS error, CASE p_partkey % 3 WHEN 0 THEN {duck.legal_name(_VENDOR)} ELSE {duck.legal_name(_VENDOR)} || '!' END AS name FROM part")
def composed_adapters(spark, sf):
    """The first error of a row stays, and later steps don't touch it."""
    first = lambda d: d.withColumn("error", F.when(F.col("p_partkey") % 3 == 0, "first")).withColumn("name", normalize.normalize_legal_name("raw"))
    second = lambda d: d.withColumn("error", F.when(F.col("p_partkey") % 3 <= 1, "second")).withColumn("name", F.concat("name", F.lit("!")))
    p = table(spark, sf, "part").selectExpr("p_partkey", f"{_VENDOR} as raw")
    return records.composed(first, second)(p).select("p_partkey", "error", "name")


@query(f"SELECT p_partkey, {duck.legal_name(duck.localized(_VENDOR, 'us/il'))} AS normalized FROM part")
def localizing_adapter(spark, sf):
    raw = table(spark, sf, "part").selectExpr("p_partkey", f"{_VENDOR} as vendor_name")
    a = records.Adapter("vendor", "US-IL", "vendor_list", "vendor", ("vendor_name",), ("p_partkey",), localized=True)
    return a.run(raw).select("p_partkey", F.col("legalNameNormalized").alias("normalized"))


@query(f"SELECT record_type, count(*) AS n, count(identifiers) AS with_identifiers FROM (SELECT 'procurement.buyer' AS record_type, '' AS identifiers FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'procurement.supplier', '' FROM {_SUPPLIERS} WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) GROUP BY 1")
def party_identifiers(spark, sf):
    r = requests(spark, sf).where("record_type in ('procurement.buyer', 'procurement.supplier')")
    return r.groupBy("record_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("identifiers", "$.additional")).alias("with_identifiers"))


@query("SELECT 'not of type procurement.buyer' AS refused, (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS n")
def misplaced_requests(spark, sf):
    r = requests(spark, sf).where("record_type in ('procurement.buyer', 'procurement.tender')")
    return links.misplaced(r, "buyer").groupBy("refused").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT 'name' AS kind, 'n' || (c_custkey // 3) || '|j' || (c_nationkey % 5) AS key, c_custkey AS id FROM customer UNION SELECT 'identifier', 'lei:L' || (c_custkey // 8), c_custkey FROM customer WHERE c_custkey % 4 = 0 UNION SELECT 'identifier', 'uei:U' || (c_custkey // 24), c_custkey FROM customer WHERE c_custkey % 6 = 0),
    m AS (SELECT *, min(id) OVER (PARTITION BY kind, key) AS a FROM b) SELECT DISTINCT a, id AS b FROM m WHERE a < id""")
def block_links(spark, sf):
    return resolve.block_links(resolve.blocks(*_people(spark, sf)))


# --- Files


@query("SELECT true AS first, p_name AS raw_name FROM part GROUP BY p_name")
def csv_names(spark, sf):
    at = _folder(spark, "csv")
    table(spark, sf, "part").selectExpr("concat(' ', p_name) as `Vendor Name`", "p_size").coalesce(1).write.option("header", True).csv(at)
    return readers.read_names_csv(spark, "Vendor Name", path=at).select(F.lit(True).alias("first"), "raw_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 5 <> 0")
def json_lines_permissive(spark, sf):
    """Gzipped lines, of which some are damaged, are no object, or blank."""
    at = _folder(spark, "jsonl")
    good = table(spark, sf, "supplier").selectExpr("case s_suppkey % 10 when 0 then '{\"s_suppkey\":' when 5 then '[1]' else to_json(struct(s_suppkey, s_name)) end as value")
    good.union(spark.createDataFrame([("  ",)], "value string")).write.option("compression", "gzip").text(at)
    return readers.read_jsonl(spark, at, "s_suppkey bigint, s_name string", strict=False)


@query("SELECT n_nationkey, n_name FROM nation")
def json_lines_strict(spark, sf):
    at = _folder(spark, "jsonl")
    writers.write_jsonl(table(spark, sf, "nation"), at)
    return readers.read_jsonl(spark, at, "n_nationkey int, n_name string")


@query("SELECT r_regionkey, r_name FROM region")
def json_documents(spark, sf):
    """Pretty documents, found below a folder, read whole."""
    at = _folder(spark, "json")
    writers.pretty_json(table(spark, sf, "region")).repartition(5).write.text(f"{at}/a")
    found = readers.read_documents(spark, at, glob="*.txt")
    # A part may hold several documents.
    each = found.select(F.explode(F.split(F.col("content"), "(?<=\\})\\n")).alias("content")).where("trim(content) <> ''")
    return readers.parsed(each, "struct<r_regionkey:int,r_name:string>").where("error is null").select("record.*")


@query("SELECT r_regionkey, r_name FROM region")
def json_whole_file(spark, sf):
    at = _folder(spark, "json")
    table(spark, sf, "region").select(F.to_json(F.struct("*")).alias("value")).repartition(5, "r_regionkey").write.option("maxRecordsPerFile", 1).text(at)
    return readers.read_json(spark, f"{at}/*.txt", "r_regionkey int, r_name string")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def parquet_columns(spark, sf):
    return readers.read_parquet(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query("SELECT 'collision_bucket_count,normalized_unique_count,raw_collided_count,raw_unique_count' AS keys")
def summary_file(spark, sf):
    at = _folder(spark, "summary")
    writers.write_summary(audit.summary(audit.mapping(vendors(spark, sf))), at)
    return spark.read.text(at).select(F.array_join(F.json_object_keys("value"), ",").alias("keys"))
