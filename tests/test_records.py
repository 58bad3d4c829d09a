import json
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.__main__ import main
from rollcall.functions import canonical, dates, fold, localize
from rollcall.operators import audit, records, validate
from rollcall.plans import functions as named
from rollcall.sources import writers
from rollcall.sources.registry import Registry, schema_problems, vertical_problems, vocabulary_problems


def test_all_functions_can_be_called_from_sql(spark):
    assert named.register(spark, prefix="t_") == [f"t_{n}" for n in named.names()]
    r = spark.sql("""SELECT t_normalize_registration_date('03/04/2020') AS d, t_entity_hash('Acme Co', 'us') AS h, t_entity_hash_detailed('Acme Co', 'us') AS j,
        t_apply_localization_name('MNDOT Metro', 'US-MN') AS l, t_apply_localization_name_detailed('x', 'us/zz') AS p, t_build_entity('{}') AS e, t_build_exchange('{"attestations":[]}') AS x""").first()
    assert r.d == "2020-03-04" and r.l == "minnesota department of transportation metropolitan council" and r.e is None and r.x is None
    assert json.loads(r.j) == {"entityHash": r.h, "canonical": "acme company||US|", "confidenceScore": 0.5, "tier": 3, "fieldsUsed": ["legal_name", "country_code"]}
    assert json.loads(r.p)["resolved_keys"] == ["base", "us"]
    plan = spark.sql("SELECT t_slug(concat('A ', id)) FROM range(3)")._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_composition_and_jamo(spark):
    texts = ["é Å ǖ", "Å", "각 한글 x", "plain", "q́", None, ""]
    for r in spark.createDataFrame([(x,) for x in texts], "x string").select("x", fold.nfc(F.col("x")).alias("n"), fold.jamo(F.col("x")).alias("j")).collect():
        assert r.n == (None if r.x is None else unicodedata.normalize("NFC", r.x))
        assert r.j == (None if r.x is None else "".join(unicodedata.normalize("NFD", c) if "가" <= c <= "힣" else c for c in r.x))


def test_folding_equals_a_plain_restatement(spark):
    one, many = fold.tables()
    chars = sorted({**one, **many})
    texts = ["".join(chars[i : i + 50]) + "a1 " for i in range(0, len(chars), 50)] + ["日本語 text ß", "ﷺ"]
    for r in spark.createDataFrame([(x,) for x in texts], "x string").select("x", fold.to_ascii(F.col("x")).alias("y")).collect():
        assert r.y == "".join((one | many).get(c, c if c < "\x80" else "") for c in r.x)


def test_numbers_have_defined_forms(spark):
    df = spark.createDataFrame([("abc", 1e21), ("1e20", 1e-19), ("12.345", float("nan")), ("-0.005", -0.0), (None, None)], "a string, d double")
    got = df.select(canonical.format_amount("a").alias("a"), canonical.plain_number(F.col("d")).alias("d")).collect()
    assert [r.a for r in got] == [None, "100000000000000000000.00", "12.35", "-0.01", None]
    assert [r.d for r in got] == ["1000000000000000000000", "0.0000000000000000001", None, "0", None]


def test_only_rfc_3339_is_a_timestamp(spark):
    df = spark.createDataFrame([("2024",), ("2024-01-02T03:04:05Z",), ("2024-01-02 03:04:05",), ("2024-13-02T03:04:05Z",)], "a string")
    got = df.select(dates.parse_timestamp("a").isNotNull().alias("s"), dates.parse_timestamp("a", offset=False).isNotNull().alias("l")).collect()
    assert [(r.s, r.l) for r in got] == [(False, False), (True, True), (False, True), (False, False)]


@pytest.mark.parametrize(
    "schema, kind, good, bad, rule",
    [
        ({"minLength": 2}, "string", "ab", "a", "minLength"), ({"maxLength": 2}, "string", "ab", "abc", "maxLength"), ({"pattern": "^a"}, "string", "ab", "b", "pattern"),
        ({"format": "date"}, "string", "2024-02-29", "2023-02-29", "format"), ({"format": "uri"}, "string", "urn:x", "no uri", "format"), ({"format": "email"}, "string", "a@b", "a", "format"), ({"format": "uuid"}, "string", "0" * 8 + "-0000-0000-0000-" + "0" * 12, "x", "format"),
        ({"type": "integer"}, "string", "12", "1x", "type"), ({"type": "integer"}, "double", 2.0, 2.5, "type"), ({"type": ["string", "null"]}, "string", None, None, None), ({"type": "array"}, "string", None, "x", "type"),
        ({"exclusiveMinimum": 1}, "int", 2, 1, "exclusiveMinimum"), ({"exclusiveMaximum": 1}, "int", 0, 1, "exclusiveMaximum"), ({"multipleOf": 0.1}, "double", 0.3, 0.35, "multipleOf"),
        ({"minItems": 1}, "array<int>", [1], [], "minItems"), ({"maxItems": 1}, "array<int>", [1], [1, 2], "maxItems"), ({"uniqueItems": True}, "array<int>", [1, 2], [1, 1], "uniqueItems"), ({"items": {"minimum": 3}}, "array<int>", [3], [3, 2], "minimum"), ({"contains": {"const": 7}}, "array<int>", [1, 7], [1], "contains"),
        ({"required": ["a"]}, "struct<a:int>", (1,), (None,), "required"), ({"properties": {}, "additionalProperties": False}, "struct<a:int>", (None,), (1,), "additionalProperties"), ({"patternProperties": {"^a": {"maximum": 3}}}, "struct<a:int>", (3,), (4,), "maximum"), ({"minProperties": 1}, "struct<a:int>", (1,), (None,), "minProperties"),
        ({"additionalProperties": {"minimum": 3}}, "map<string,int>", {"x": 3}, {"x": 1}, "minimum"), ({"patternProperties": {"^a": {"minimum": 3}}, "additionalProperties": False}, "map<string,int>", {"a": 3}, {"b": 3}, "false"), ({"propertyNames": {"maxLength": 1}}, "map<string,int>", {"a": 1}, {"ab": 1}, "propertyNames"), ({"required": ["k"]}, "map<string,int>", {"k": 1}, {"b": 3}, "required"),
        ({"anyOf": [{"const": 1}, {"const": 2}]}, "int", 2, 3, "anyOf"), ({"oneOf": [{"minimum": 1}, {"minimum": 5}]}, "int", 2, 6, "oneOf"), ({"not": {"const": 1}}, "int", 2, 1, "not"), ({"allOf": [{"enum": [1, 2]}]}, "int", 2, 3, "enum"), ({"$defs": {"p": {"minimum": 3}}, "$ref": "#/$defs/p"}, "int", 3, 2, "minimum"),
    ],
)
def test_schema_keywords(spark, schema, kind, good, bad, rule):
    df = spark.createDataFrame([(good,), (bad,)], T.StructType([T.StructField("x", T._parse_datatype_string(kind) if hasattr(T, "_parse_datatype_string") else T.DataType.fromDDL(kind))]))
    got = df.select(validate.violations(F.col("x"), df.schema["x"].dataType, schema).alias("e")).collect()
    assert not got[0].e
    assert [e.rule for e in got[1].e] == ([rule] if rule else [])


def test_configurations_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "us").mkdir()
    (tmp_path / "us.yaml").write_text('jurisdiction: "US"\nabbreviations:\n  1st: first\n  "éts": etablissements\nstop_words: [the]\n')
    (tmp_path / "us" / "il.yaml").write_text('jurisdiction: "US-IL"\nparent: "US"\nagency_names:\n  city hall: city of chicago\nrules:\n  - {pattern: "co\\\\.?$", replacement: company, is_regex: true, order: 2}\n  - {pattern: "x", replacement: "y", enabled: false}\n')
    configs = localize.read_configs(tmp_path)
    assert set(configs) == {"us", "us/il", "base"} and localize.chain("US-IL", configs) == ["base", "us", "us/il"]
    df = spark.createDataFrame([("The 1st éts City Hall Co.",)], "n string")
    assert df.select(localize.apply_localization("n", "us/il", configs)).first()[0] == "first etablissements city of chicago company"
    for broken in ({}, {"jurisdiction": "x", "rules": [{"pattern": "a"}]}):
        with pytest.raises(ValueError):
            localize.from_mapping(broken)
    raw = {"jurisdiction": "x", "version": "1.0.0"}
    once = localize.stamped(raw, "2024-01-01T00:00:00Z")
    assert once["version"] == "1.0.1" and localize.stamped(once, "2025-01-01T00:00:00Z") == once


def test_a_row_keeps_its_first_error(spark):
    df = spark.createDataFrame([("a", "bad before"), ("b", None), ("c", None)], "k string, error string")
    step = lambda d: d.withColumn("error", F.when(F.col("k") < "c", "new")).withColumn("k", F.upper("k"))
    assert {tuple(r) for r in records.composed(step, step)(df).select("k", "error").collect()} == {("a", "bad before"), ("B", "new"), ("C", "new")}
    with pytest.raises(ValueError):
        records.composed(lambda d: d.select("k"))(df)


def test_adapters_compose(spark):
    raw = spark.createDataFrame([("Acme Inc",), (" ",)], "vendor_name string")
    a = records.adapter("vendor", "US-IL", "vendor_list")
    out = records.composed(a.canonicalize, a.align, a.identify, a.attest)(raw)
    assert {(r.legalNameNormalized, r.error) for r in out.collect()} == {("acme incorporated", None), (None, "missing legal name")}


def test_registry_and_its_checks(spark, tmp_path):
    (tmp_path / "entity.schema.json").write_text(json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "version": "2.0"}))
    r = Registry.from_folder(tmp_path)
    assert r.names() == [("entity", "2.0")] and r.get("entity", "2.0")["type"] == "object" and "object" in r.asset("entity.schema.json")
    assert r.table(spark).count() == 1
    for bad in (("entity", "1.0"), ("other", "1.0")):
        with pytest.raises(ValueError):
            r.get(*bad)
    with pytest.raises(KeyError):
        r.asset("no")
    assert not schema_problems(r.get("entity", "2.0"))
    broken = {"type": "text", "minLength": -1, "pattern": "(", "required": "a", "items": 3, "oneOf": [], "properties": {"a": {"enum": 1}}}
    assert len(schema_problems(broken)) == 8
    good = {"id": "v", "title": "V", "version": "1", "terms": [{"code": "a", "uri": "u:a"}, {"code": "b", "uri": "u:b", "parent": "a"}]}
    assert not vocabulary_problems(good)
    assert len(vocabulary_problems(good | {"terms": [*good["terms"], {"code": "a", "uri": "u", "parent": "z"}]})) == 2
    assert vocabulary_problems([]) and vocabulary_problems({"id": 1}) and vertical_problems(" ") == ["the file is empty"]
    assert not vertical_problems('{"id": "a", "name": "b", "version": "1", "status": "draft"}') and vertical_problems("[1]")


def test_collisions_leave_out_names_without_a_form(spark):
    m = spark.createDataFrame([(1, "東", ""), (2, "京", ""), (3, "a", "a"), (4, "A", "a"), (5, "x", None), (6, "y", None)], "pos int, raw string, normalized string")
    assert [(r.normalized, r.n, r.raws) for r in audit.collisions(m).collect()] == [("a", 2, ["a", "A"])]


def test_writers_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    writers.write_jsonl(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_jsonl(df, str(tmp_path / "o"))
    writers.write_jsonl(df, str(tmp_path / "o"), force=True)
    assert writers.pretty_json(df).first()[0].split() == ["{", '"a"', ":", '"x",', '"b"', ":", "1", "}"]


def test_command_line(spark, tmp_path):
    (tmp_path / "in.csv").write_text("name,country,jurisdiction\nAcme Inc,us,US-IL\nACME INC,us,US-IL\n")
    run = lambda *a: main([a[0], str(tmp_path / "in.csv"), str(tmp_path / a[0]), *a[1:]])
    assert run("entity-hash", "--name", "name", "--country", "country") == 0
    assert run("canonicalize", "--name", "name", "--jurisdiction", "jurisdiction") == 0
    assert run("audit", "--name", "name") == 0
    (tmp_path / "s.json").write_text(json.dumps({"properties": {"name": {"maxLength": 3}}}))
    assert run("validate", "--schema", str(tmp_path / "s.json")) == 1
    assert run("generate-example", "--name", "name", "--country", "country", "--jurisdiction", "jurisdiction") == 0
    assert len({json.loads(r[0])["entity_hash"] for r in spark.read.text(str(tmp_path / "entity-hash")).collect()}) == 1
    assert spark.read.text(str(tmp_path / "generate-example" / "04_entity_record")).count() == 2
    with pytest.raises(SystemExit) as e:
        main(["--version"])
    assert e.value.code == 0
