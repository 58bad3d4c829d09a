"""Functions against restatements of their rules in plain Python, and against
published results."""

import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from rollcall.functions import canonical, dates, identity, normalize
from rollcall.functions.fold import SPECIAL, strip_marks, to_ascii
from rollcall.functions.localize import apply_localization, chain, corpus, localize, localize_detailed


def one(spark, build, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()[0]


def many(spark, build, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[1] for r in df.select("i", build(F.col("c")).alias("x")).orderBy("i").collect()]


def fold(s):
    out = []
    for c in s:
        for x in unicodedata.normalize("NFKD", c):
            out.append(x if x < "\x80" else SPECIAL.get(x, ""))
    return "".join(out)


def legal(s):
    x = re.sub(r"[^A-Za-z0-9\s]", "", fold(s.lower()))
    words = [normalize.CORE_WORDS.get(w.lower(), w.lower()) for w in x.split()]
    return " ".join(w for w in " ".join(words).split() if w not in normalize.STOP)


def test_fold(spark):
    texts = ["Straße ﬁn ½ Ⅷ ™ Ångström", "日本 Ελλάδα", "éa", "plain", "", "Œuvre æther ø ð þ", "𝔘𝔫𝔦"]
    assert many(spark, to_ascii, texts) == [fold(t) for t in texts]
    assert many(spark, strip_marks, ["Ωμέγα é “q” a—b…", "naïve"]) == ["Ωμεγα e q a-b...", "naive"]


NAMES = {
    "SPRINGFIELD  School District ": "springfield school district", "Springfield Sch. Dist.": "springfield school district", "St. Mary's Academy": "saint marys academy", "Springfield USD #12": "springfield unified school district 12",
    "Winston-Salem Dept of Transp": "winstonsalem department transp", "Acme Corp., Inc.": "acme corporation incorporated", "Acme L.L.C.": "acme limited liability company", "Société Générale": "societe generale", "": "", "  ": "", ".,;:!?": "",
    "Health/Education Co": "healtheducation company", "Smith–Jones & Co": "smithjones company", "Parks NFP": "parks not profit",
}


def test_legal_names(spark):
    assert dict(zip(NAMES, many(spark, normalize.normalize_legal_name, list(NAMES)), strict=True)) == NAMES
    rng = random.Random(1)
    pieces = [*normalize.CORE_WORDS, *normalize.STOP, "Ünï", "ß", "X-Y", "A.B.", "ﬁ", "12", "’", "  ", "\t"]
    names = ["".join(rng.choice(pieces) + rng.choice([" ", ", ", ". ", ""]) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    assert many(spark, normalize.normalize_legal_name, names) == [legal(n) for n in names]
    # A stop word that an expansion brings goes in the same pass.
    assert many(spark, lambda c: normalize.normalize_legal_name(normalize.normalize_legal_name(c)), names) == [legal(legal(n)) for n in names]
    assert one(spark, normalize.normalize_legal_name, None) is None


def test_script_preserving_profile(spark):
    f = lambda **k: lambda c: normalize.normalize_legal_name(c, "script_preserving", **k)
    assert many(spark, f(), ["Ελληνική Εταιρεία A.B.", "Müller GmbH", "Acme P.L.L.C.", "Dupont S.A.", "Health/Education"]) == [
        "ελληνικη εταιρεια b", "muller gesellschaft mit beschrankter haftung", "acme p limited liability company", "dupont societe anonyme", "health education"]
    assert one(spark, f(keep_initial=True), "The City of The Hague") == "the city hague"
    assert one(spark, f(stop_words=False), "Bank of Co") == "bank of company"


def test_addresses(spark):
    got = many(spark, normalize.normalize_address, ["123 N. Main St., Suite 400", "456 Oak Ave, Apt 2B", "789 Broadway, Floor 12", "100 United Plaza", "123 Stevens Ave", "5 Elm #7", ""])
    assert got == ["123 north main street", "456 oak avenue", "789 broadway", "100 plaza", "123 avenue", "5 elm", ""]
    assert one(spark, lambda c: normalize.normalize_address(c, "script_preserving"), "1 Μέγα Sq, Rm 4") == "1 μεγα square"


def test_dates(spark):
    given = ["2024-03-15", "03/15/2024", "3-5-2024", "1985", "", "2024-99-99", "02/31/2024", "15/03/2024", "x", None]
    assert many(spark, dates.registration_date, given) == ["2024-03-15", "2024-03-15", "2024-03-05", "1985-01-01", None, "2024-99-99", "2024-02-31", None, None, None]
    assert many(spark, lambda c: dates.registration_date(c, strict=True), given) == ["2024-03-15", "2024-03-15", "2024-03-05", "1985-01-01", None, None, None, "2024-03-15", None, None]
    assert one(spark, lambda c: dates.canonical_timestamp(dates.parse_timestamp(c)), "2024-01-01T02:00:00.5+02:00") == "2024-01-01T00:00:00.500000Z"


PUBLISHED = [  # name, country, address, date, start of the hash
    ("Springfield Unified School District", "US", None, None, "501b245f108b"), ("Springfield Unified School District #12", "US", "123 Education Way", None, "bd4cdf26529b"),
    ("The Boston Community Foundation, Inc.", "us", "100 Charitable Lane, Suite 500", "03/15/1990", "93cbc6c1da35"), ("Acme Consulting, LLC", "US", "456 N. Main St., Suite 200", "2015-06-01", "8eac55e6b2bd"),
    ("Toronto Community Foundation", "CA", "100 King St W", "1981-01-15", "60a36df41c62"), ("Acme Corp", "US", None, None, "56ef750e3971"), ("Springfield Regional Medical Center, Inc.", "US", "500 Hospital Drive", "1965-03-20", "85cff705ac62"),
    ("City of Springfield", "US", "123 Lincoln Ave", None, "c95b9f9d41ad"), ("Minnesota School District 01", "US", "200 Learning St.", None, "5dababc102e5"), ("Citizens for Good Government PAC", "US", "75 Liberty Ave", "2020-02-01", "40aed40459ca"),
]


def test_entity_hashes(spark):
    df = spark.createDataFrame(PUBLISHED, "n string, c string, a string, d string, h string")
    for r in df.select("n", "h", identity.entity_hash("n", "c", "a", "d").alias("x")).collect():
        assert r["x"].startswith(r["h"]), r["n"]


def test_confidence(spark):
    df = spark.createDataFrame([("A B C D", "US", "1 Oak St", "2020", None, None), ("A", "US", None, None, None, None), ("A", "US", None, None, "5" * 20, None), ("A", "US", " ", None, "x", "U" * 12)], "n string, c string, a string, d string, l string, u string")
    r = [x[0] for x in df.select(identity.with_confidence(*[F.col(c) for c in "ncadlu"]).alias("r")).collect()]
    assert [(x["confidence_score"], x["tier"]) for x in r] == [(0.9, 3), (0.5, 3), (1.0, 1), (0.95, 2)]
    assert r[0]["fields_used"] == ["legal_name", "country_code", "address", "registration_date"] and r[2]["fields_used"][0] == "lei" and r[3]["canonical"] == "||US|"


def test_identifiers(spark):
    assert one(spark, identity.lei, " 529900t8bm49aursdo55 ") == "529900T8BM49AURSDO55" and one(spark, identity.lei, "x") is None
    assert one(spark, identity.uei, "abc123def456") == "ABC123DEF456" and one(spark, identity.business_number, "123456789rc0001") == "123456789RC0001"
    assert one(spark, identity.strict_hash, "A" * 64) is None and one(spark, canonical.valid_hash, "A" * 64) == "a" * 64
    assert one(spark, lambda a, b: identity.primary_identifier(a, b, F.lit("h")), None, None) == "entity:hash:h"
    assert one(spark, lambda a: identity.primary_identifier(a, additional=F.array(F.struct(F.lit("s").alias("scheme_uri"), F.lit("v").alias("value")))), None) == "entity:other:s:v"
    assert one(spark, lambda a: identity.short_hash(a, 3), "abcdef") == "abc..." and one(spark, identity.entity_type_uri, " School_District! ") == "urn:entity-type#school-district"


def test_canonical_forms(spark):
    assert one(spark, lambda a, b: canonical.canonical_string(z=a, a=b, n=F.lit(None), e=F.lit("")), "1", 'q"') == '"a":"q"","z":"1"'
    assert many(spark, canonical.format_amount, ["0.125", "0.375", "2", "-1.005"]) == ["0.13", "0.38", "2.00", "-1.01"]
    text = 'é "q" \\ 😀\n'
    import json

    assert one(spark, lambda c: canonical.json_quote(c, ascii_only=True), text) == json.dumps(text)
    want = hashlib.sha256(json.dumps({"b": "é", "a": None}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, lambda a, b: canonical.projection_id(b=a, a=b), "é", None) == want
    df = spark.sql("select struct(2.50D as z, array(1, null) as a, cast(null as string) as n, map('k', 'v') as m, -0.0D as q, array() as e, 1e-7D as t) as s")
    assert df.select(canonical.canonical_json(F.col("s"), df.schema["s"].dataType)).first()[0] == '{"a":[1,null],"e":[],"m":{"k":"v"},"q":0,"t":0.0000001,"z":2.5}'


LOCAL = [
    ("DOJ", "US", "department of justice"), ("EPA", "us/xx", "environmental protection agency"), ("The EPA Regional Office", "US", "the environmental protection agency regional office"), ("XYZZY Corp", "US", "xyzzy corporation"),
    ("MTA", "us/ny", "metropolitan transportation authority"), ("Port Authority", "US-NY", "port authority of new york and new jersey"), ("RCMP", "CA/ON", "royal canadian mounted police"), ("TTC", "CA-ON", "toronto transit commission"),
    ("Société Générale", "CA/QC", "societe generale"), ("Acme Limitée", "ca/qc", "acme limitee"), ("ACME CO", "US-IL", "acme"), ("Acme G.m.b.H.", "eu/de", "acme gmbh"), ("McDermott Center DBA", "US-IL", "mcdermott center doing business as"),
]


@pytest.mark.parametrize(("name", "where", "want"), LOCAL)
def test_localization(spark, name, where, want):
    assert one(spark, lambda c: apply_localization(c, where), name) == want


def test_localize_tables(spark):
    df = spark.createDataFrame([(n, j) for n, j, _ in LOCAL] + [("DOJ", None)], "n string, j string")
    named = sorted({j for _, j, _ in LOCAL})
    assert [r["localized"] for r in localize(df, "n", "j", named).collect()] == [w for *_, w in LOCAL] + ["doj"]
    r = localize_detailed(df, "n", "j", named).where("n = 'TTC'").first()
    assert r["resolved_keys"] == ["base", "ca", "ca/on"] and r["requested_key"] == "ca/on" and len(set(r["resolved_hashes"])) == 3
    assert chain("US-IL") == ["base", "us", "us/il"] and chain("ca/qc") == ["base", "ca/qc"] and chain("us/il/chi") == ["base"] and chain("DE") == ["base"] and len(corpus()) == 27


def _places(df, text):
    """How often a text stands in the plan that is run."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(text)


def test_names_are_normalized_once_for_each_use(spark):
    """Expressions that name their argument several times evaluate it once."""
    # Two names, so that no literal is folded.
    n = F.concat("a", F.lit("-MARK-"), "b")
    df = spark.createDataFrame([("The", "Co."), ("Ärzte", "L.L.C."), (None, None)], "a string, b string")
    for x in (normalize.entity_type_of(n), normalize.word_count(n), normalize.normalize_legal_name(n), normalize.normalize_legal_name(n, "script_preserving"), apply_localization(n, "us/il")):
        assert _places(df.select(x.alias("x")), "-MARK-") == 1, x
    null = F.lit(None).cast("string")
    rated = df.select(identity.with_confidence(n, F.lit("us"), F.col("a"), F.col("b"), null, null).alias("r")).select("r.tier", "r.confidence_score", "r.fields_used")
    assert _places(rated, "-MARK-") == 1
    assert [tuple(r) for r in df.select(normalize.entity_type_of(normalize.normalize_legal_name(n)).alias("t"), normalize.word_count(n).alias("w")).collect()] == [("other", 1), ("other", 1), (None, None)]
