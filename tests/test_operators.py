import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rollcall import queries
from rollcall.operators import audit, resolve, validate
from rollcall.streaming import windows


def test_summary_invariant(spark):
    """Names merged = collided names less their buckets."""
    rng = random.Random(1)
    names = [(i, rng.choice(["Acme", "ACME", "Bolt Co", "Bolt Company", "Core", "Core Inc."]) + rng.choice(["", "!", " "])) for i in range(200)]
    r = audit.summary(audit.mapping(spark.createDataFrame(names, "pos long, raw_name string"))).first()
    assert r["raw_unique_count"] - r["normalized_unique_count"] == r["raw_collided_count"] - r["collision_bucket_count"] > 0
    empty = audit.summary(audit.mapping(spark.createDataFrame([], "pos long, raw_name string"))).first()
    assert tuple(empty) == (0, 0, 0, 0)


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(70)] + [(3, 3)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r[0]: r[1] for r in resolve.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (9, 1), (7, 7), (None, 1)], "src long, dst long")
    assert {r[0] for r in validate.on_cycles(e).collect()} == {1, 2, 3, 7}


def test_schema_checks(spark):
    schema = {"$defs": {"d": {"type": "object", "properties": {"y": {"type": "integer", "minimum": 1}}, "required": ["y"]}}, "allOf": [{"required": ["a"]}], "properties": {"a": {"type": ["string", "null"], "pattern": "^x"}, "s": {"$ref": "#/$defs/d"}, "l": {"minItems": 2}, "k": {"const": "q"}}}
    df = spark.sql("select 'y' a, named_struct('y', 0) s, array(1) l, 'z' k union all select 'xx', named_struct('y', 3), array(1, 2), 'q' union all select null, named_struct('y', null), null, null")
    got = [sorted((x["path"], x["rule"]) for x in r[0]) for r in df.select(validate.errors(validate.from_json_schema(schema))).collect()]
    assert got == [[("a", "pattern"), ("k", "enum"), ("l", "items"), ("s.y", "least")], [], [("a", "required"), ("s.y", "required")]]
    lines = spark.createDataFrame([('{"a": "xx"}',), ("{",), ("{}",)], "value string")
    e = [[x["rule"] for x in r["errors"]] for r in validate.json_errors(lines, validate.from_json_schema({"required": ["a"], "properties": {"a": {"pattern": "^x"}}}), "a string").collect()]
    assert e == [[], ["json"], ["required"]]


def test_streams_equal_tables(spark, tmp_path):
    """Sessions and windows from files that arrive one by one."""
    start = datetime(2024, 1, 1)
    rng = random.Random(5)
    rows = sorted((start + timedelta(minutes=rng.randint(0, 2000)), i) for i in range(300))
    events = spark.createDataFrame([(i, t, i % 7, rng.choice("ab"), float(i)) for t, i in rows], "event_id long, ts timestamp, user_id long, event_type string, value double")
    end = spark.createDataFrame([(-1, start + timedelta(days=30), -1, "z", 0.0)], events.schema)
    for i, part in enumerate((events.where("ts < '2024-01-01 12:00'"), events.where("ts >= '2024-01-01 12:00'"), end)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert i < 3
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, f in (("s", windows.sessions), ("w", windows.feature_windows)):
        q = f(stream(), watermark="1 hour").writeStream.format("memory").queryName(f"out_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / f"ck{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = spark.table(f"out_{name}").where("window_start < '2024-01-20'" if name == "w" else "user_id >= 0")
        assert sorted(map(str, got.collect())) == sorted(map(str, f(events).collect()))
    assert windows.deduplicated(events.union(events)).count() == 300


def test_hot_queries_run_no_python(spark, sf):
    for name in ("entity_hash", "entity_confidence", "legal_name_normalized", "text_normalized", "localized_name", "release_links", "name_collisions", "chained_identity", "schema_errors"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "EvalPython" not in plan and "MapInArrow" not in plan, name


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = audit.only_in(queries.mapping(spark, sf), queries.baseline(spark, sf))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,10)" in plan and "p_retailprice" not in plan.split("== Physical Plan ==")[1]


def test_results_do_not_depend_on_partitions(spark, sf):
    a = queries.name_collisions(spark, sf)
    m = queries.mapping(spark, sf).repartition(7)
    b = audit.collisions(m).withColumn("raws", F.array_join("raws", " || "))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_merge_links_have_the_components_of_all_merged_pairs(spark):
    """Blocks of many entities that can't be told apart, contradictions, nulls
    and several values of a scheme."""
    import random

    from rollcall.operators import resolve

    rng = random.Random(2)
    e = [(i, rng.choice(["n1", "n2", "", None]), rng.choice(["j", "k", None]), rng.choice(["t", "u", None]), rng.choice(["c", "d", None])) for i in range(140)]
    i = [(k, s, f"{s}{rng.randint(0, 6)}") for k in range(0, 140, 2) for s in rng.sample(["lei", "uei", "bn", "local"], rng.randint(1, 2))] + [(0, "lei", "lei9"), (2, "lei", "lei9"), (2, "lei", "lei8"), (4, "lei", "")]
    e = spark.createDataFrame(e, "entity_id int, name string, jurisdiction string, entity_type string, country string")
    i = spark.createDataFrame(i, "entity_id int, scheme string, value string")
    pairs = resolve.evidence(resolve.candidate_pairs(resolve.blocks(e, i)), e, i).where("decision = 'merge'")
    links = resolve.merge_links(e, i)
    want, got = ({tuple(r) for r in resolve.clusters(e, x).collect()} for x in (pairs, links))
    assert got == want and len({c for _, c in want}) < 130
    assert links.count() < pairs.count()


def test_name_mapping_joins_no_name_with_all_rows_of_it(spark, sf):
    """Rows were joined with all of their name, which grows with its square."""
    plan = queries.QUERIES["name_mapping"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    names = spark.createDataFrame([(1, "The B"), (2, "The B"), (3, None)], "pos long, raw_name string")
    assert sorted(map(tuple, audit.mapping_distinct(names).collect())) == [(1, "The B", "b"), (2, "The B", "b"), (3, None, None)]


def test_symmetric_pairs_are_one_exchange(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 1), (3, 3), (4, 5), (4, 5), (None, 1), (1, None), (None, None)], "src long, dst long")
    found = validate.symmetric_pairs(e)
    assert sorted(map(tuple, found.collect())) == [(1, 2), (3, 3)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
