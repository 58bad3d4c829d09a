import gzip
import json

import pytest
from pyspark.sql import functions as F

from rollcall.operators import links, records
from rollcall.sources import readers, releases, writers


def write(path, text):
    path.write_text(text, "utf-8")
    return str(path)


def test_names_from_csv(spark, tmp_path):
    p = write(tmp_path / "v.csv", "id,Vendor Name\n1, Acme \n2,\n3,Bolt\n4,Acme\n5,  \n6,Core\n")
    rows = lambda **k: [r["raw_name"] for r in readers.read_names_csv(spark, "Vendor Name", path=p, **k).orderBy("pos").collect()]
    assert rows() == ["Acme", "Bolt", "Core"] and rows(limit=3) == ["Acme", "Bolt"]
    with pytest.raises(KeyError):
        readers.read_names_csv(spark, "x", path=p)
    for bad in ({}, {"path": p, "url": "http://x/"}):
        with pytest.raises(ValueError):
            readers.read_names_csv(spark, "x", **bad)
    for url in ("file:///etc/passwd", "http://u:p@h/", "http://"):
        with pytest.raises(ValueError):
            readers.check_url(url)


def test_json_lines(spark, tmp_path):
    text = '{"a": 1}\n\n{"a": 2, "b": "x"}\n'
    p = write(tmp_path / "x.jsonl", text)
    assert sorted(r["a"] for r in readers.read_jsonl(spark, p, "a int, b string").collect()) == [1, 2]
    bad = tmp_path / "y.jsonl.gz"
    bad.write_bytes(gzip.compress((text + "{oops\n[1]\n").encode()))
    assert readers.read_jsonl(spark, str(bad), "a int, b string", strict=False).count() == 2
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.read_jsonl(spark, str(bad), "a int, b string").collect()
    with pytest.raises(ValueError):
        readers.read_json(spark, "x.csv")
    (tmp_path / "city").mkdir()
    write(tmp_path / "city" / "d.json", '{"a": 5}')
    d = readers.read_documents(spark, str(tmp_path)).collect()
    assert [(r["folder"], json.loads(r["content"])) for r in d] == [("city", {"a": 5})]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b")], "z int, a string")
    out = str(tmp_path / "o")
    writers.write_jsonl(df, out)
    assert [r[0] for r in spark.read.text(out).collect()] == ['{"a":"b","z":2}']
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_jsonl(df, out)
    writers.write_jsonl(df, out, force=True)


RELEASE = {
    "ocid": "o1", "id": "r1", "date": "2024-01-01", "tag": ["award", None], "buyer": None, "extra": {"x": 1},
    "parties": [{"id": "p1", "name": "Town", "roles": ["buyer"]}, {"id": "s1", "name": "Sup", "roles": ["supplier", "x"]}, {"id": "s9", "name": "New", "roles": ["supplier"]}, {"name": 5, "roles": "supplier"}],
    "tender": {"id": "t1", "title": "T", "value": {"amount": 10.5, "currency": "EUR"}, "lots": [{"id": "l1"}, {"id": "l2", "value": {"amount": 3.0}}]},
    "awards": [{"id": "a1", "suppliers": [{"id": "s1", "name": "Sup"}, {"id": "s1", "name": "Sup"}]}, {"id": "a1", "title": "second"}, {"id": "a2"}],
    "contracts": [{"id": "c1", "awardID": "a1"}, {"id": "c2", "awardID": "zz"}, {"id": "c3", "awardID": ""}, {"id": "c4"}],
}


def test_releases(spark):
    texts = [json.dumps(RELEASE), json.dumps({"releases": [RELEASE, {"ocid": "o2"}]}), json.dumps({"records": [{"releases": [{"ocid": "o3", "tag": "one"}]}, {}]}), "{bad", "", None, "[]", "3", "{}"]
    found = releases.releases(spark.createDataFrame(list(enumerate(texts)), "pos int, content string"))
    assert [(r["pos"], r["release_pos"], r["release"]["ocid"]) for r in found.orderBy("pos", "release_pos").collect()] == [(0, 0, "o1"), (1, 0, "o1"), (1, 1, "o2"), (2, 0, "o3")]
    b = releases.bundles(found, "EU", "src")
    r = b.where("pos = 0").first()
    assert r["buyer"]["party_source"] == "release.parties" and r["tags"] == ["award"]
    assert [(s["party_id"], s["party_source"]) for s in r["suppliers"]] == [("s1", "release.awards[].suppliers"), ("s9", "release.parties")]
    assert b.where("pos = 2").first()["tags"] == ["one"] and b.where("ocid = 'o2'").first()["suppliers"] == []
    req = releases.build_requests(b.where("pos = 0"))
    assert {r["record_type"]: r["count"] for r in req.groupBy("record_type").count().collect()} == {f"procurement.{k}": n for k, n in (("buyer", 1), ("supplier", 2), ("tender", 1), ("award", 3), ("contract", 4))}
    got = sorted((r["record_type"].split(".")[-1], r["from_key"], r["to_key"]) for r in links.links(req).collect())
    assert got == [("award_to_contract", "a1", "c1"), ("buyer_to_tender", "p1", "t1")] + sorted(("supplier_to_award", s, a) for s in ("s1", "s9") for a in ("a1", "a1", "a2"))
    assert sorted(map(str, links.release_links(b).collect())) == sorted(map(str, links.links(releases.build_requests(b)).collect()))
    lots, _, _ = records.small_business_view(b.where("pos = 0"))
    assert sorted((r["lot_key"], r["estimated_value"], r["currency"]) for r in lots.collect()) == [("l1", 10.5, "EUR"), ("l2", 3.0, "EUR")]
    assert links.spine(req).count() == 11 + 8


def test_adapters(spark):
    raw = spark.createDataFrame([(" ", "Acme, Inc.", None), (None, None, "US-WI")], "vendor_name string, `Vendor Name` string, jurisdiction_iso string")
    out = records.adapter("vendor", "US-IL", "vendor_list").run(raw).orderBy("jurisdictionIso").collect()
    assert (out[0]["legalNameNormalized"], out[0]["jurisdictionIso"], out[0]["error"]) == ("acme incorporated", "US-IL", None) and out[1]["error"] == "missing legal name"
    assert out[0]["attestations"][0]["sourceSystem"] == "vendor_list"
    with pytest.raises(KeyError):
        records.adapter("vendor", "US-XX", "?")
    with pytest.raises(ValueError):
        records.attestation("a", purpose="x")
    none = raw.select(F.expr("cast(array() as " + f"array<{records.ATTESTATION}>)").alias("attestations"))
    assert records.attested(none).count() == 0


def test_release_texts_and_parties_are_read_once(spark, sf):
    """Only lines' own columns are gathered; parties are listed once for all of them."""
    from rollcall import queries

    plan = queries.release_texts(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and not any("Supplier" in line for line in plan.split("\n") if "collect_list" in line)
    found = releases.releases(spark.createDataFrame([(1, '{"ocid": "a"}'), (2, "[1]"), (3, "{"), (4, None)], "pos long, content string").withColumn("content", F.concat("content", F.lit(" "))))
    assert [r["pos"] for r in found.collect()] == [1]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("concat(content") == 1
