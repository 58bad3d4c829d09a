import random

import pytest
from pyspark.sql import functions as F

from rollcall.llm.mixing import GOLDEN, mix, mix_sql, mixed, mixed_whole
from rollcall.llm.packing import classes, pack, pack_sql


@pytest.fixture
def many(documents):
    rng = random.Random(1)
    rows = []
    for s, n in (("a", 600), ("b", 150), ("c", 40)):
        rows += [(len(rows) + i, "tok " * rng.randint(1, 60), "en", s) for i in range(n)]
    return documents(rows)


def test_mix_follows_weights_everywhere(many):
    w = {"a": 0.5, "b": 0.3, "c": 0.2}
    out = mix(many, weights=w, block_tokens=64).cache()
    assert out.count() == out.select("doc_id").distinct().count()
    total = out.agg(F.sum("tokens")).first()[0]
    share = {r[0]: r[1] / total for r in out.groupBy("source").agg(F.sum("tokens")).collect()}
    assert all(abs(share[k] - w[k]) < 0.06 for k in w)
    last = out.agg(F.max("slot")).first()[0]
    early = out.where(F.col("slot") < last // 2)
    share = {r[0]: r[1] / total for r in early.groupBy("source").agg(F.sum("tokens")).collect()}
    assert all(abs(share[k] - w[k] / 2) < 0.06 for k in w)


def test_epochs_repeat_small_sources(many):
    once, twice = (mix(many, weights={"a": 0.5, "c": 0.5}, block_tokens=64, epochs=e) for e in (1, 2))
    assert set(r[0] for r in twice.where("source = 'c'").select("epoch").distinct().collect()) == {0, 1}
    assert twice.where("source = 'a'").count() > 1.5 * once.where("source = 'a'").count()
    assert once.where("source = 'b'").count() == 0


def test_mix_and_pack_equal_sql(spark, sf, same):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same(mix(docs, block_tokens=256, seed=3), mix_sql(256, 3))
    same(mix(docs), mix_sql())
    same(pack(docs), pack_sql())
    same(pack(docs, capacity=128, per_worker=50), pack_sql(128, 50))


def test_the_whole_schedule_has_every_document(many, spark, sf, same):
    out = mix(many, block_tokens=64, epochs=None).cache()
    used = {r[0]: r[1] for r in out.groupBy("doc_id").count().collect()}
    assert len(used) == many.count()
    # The source that lasts longest is used once, but for a block that may come again.
    once = out.where("source = 'a'").groupBy("doc_id").count().where("count > 1").count()
    assert once <= 10 and out.where("source = 'c'").agg(F.max("epoch")).first()[0] >= 1
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same(mix(docs, epochs=None), mix_sql(whole=True))
    same(mix(docs, block_tokens=100, epochs=None), mix_sql(100, whole=True))


def test_a_stray_source_ends_no_schedule(documents):
    docs = documents([(i, "tok " * 50, "en", "big") for i in range(300)] + [(1000, "one", "en", None), (1001, None, "en", "none")])
    out = mix(docs, block_tokens=64, epochs=None)
    assert out.select("doc_id").distinct().count() == 301


def test_points_far_along_the_schedule_don_t_overflow(spark):
    """Slot 4e9 and beyond, as the schedule of a large corpus has."""
    ids = [0, 1, 3_474_000_000, 4_000_000_000, 4_294_967_296, 9_000_000_000_000]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select(F.expr(f"pmod((id % 4294967296L) * {GOLDEN - (1 << 32)}L, 4294967296L)")).collect()
    assert [r[0] for r in got] == [i * GOLDEN % 2**32 for i in ids]


def test_mixed_keeps_columns_and_order(many):
    out = mixed(many, block_tokens=64)
    assert out.columns == many.columns
    ids = [r["doc_id"] for r in out.collect()]
    slot = {r["doc_id"]: r["slot"] for r in mix(many, block_tokens=64).collect()}
    assert [slot[i] for i in ids] == sorted(slot.values()) and len(ids) == len(set(ids))


def test_bins_fit_and_whole_texts_are_packed(many, documents):
    docs = many.union(documents([(10_000, "w " * 1000), (10_001, "w " * 256)]))
    out = pack(docs, capacity=128, per_worker=200).cache()
    fill = out.groupBy("bin_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("c"), F.max("class").alias("k"), F.min("class").alias("k2"))
    assert fill.where("n > 128 or c > k or k <> k2").count() == 0
    long = out.where("doc_id = 10000").orderBy("segment").collect()
    assert [r["start"] for r in long] == list(range(0, 1000, 128)) and sum(r["n_tokens"] for r in long) == 1000
    assert [r["n_tokens"] for r in out.where("doc_id = 10001").collect()] == [128, 128]
    ends = out.selectExpr("bin_id", "bin_offset + n_tokens as e").groupBy("bin_id").agg(F.max("e").alias("e")).join(fill, "bin_id")
    assert ends.where("e <> n").count() == 0
    short = fill.where("c < k").count()
    assert short <= out.select("worker", "class").distinct().count()
    assert classes(40) == [*range(1, 16), 16, 24, 32]


def test_edges(documents):
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, "a b c", "en", None), (None, "a b", "en", "a"), (4, "x", "en", "a"), (4, "x", "en", "a"), (5, "y " * 100_000, "en", "b")]
    docs = documents(rows)
    docs = docs.withColumn("slot", F.lit(1)).withColumn("tokens", F.lit(1)).withColumn("n", F.lit(1)).withColumn("worker", F.lit("x")).withColumn("block", F.lit(1)).withColumn("len", F.lit(9))
    out = mix(docs, block_tokens=2, weights={"a": 1.0, "": 1.0, "b": 1.0})
    assert {r["source"] for r in out.collect()} <= {"a", "", "b"}
    assert mixed(docs, block_tokens=2).columns == docs.columns
    p = pack(docs, capacity=64)
    assert {r[0] for r in p.select("doc_id").distinct().collect()} == {3, None, 4, 5}
    assert p.where("doc_id = 4").count() == 2 and p.where("doc_id = 5").agg(F.sum("n_tokens")).first()[0] == 100_000
    none = docs.limit(0)
    assert mix(none).count() == 0 and mixed(none).count() == 0 and pack(none).count() == 0
    assert mix(docs.where("doc_id = 1")).count() == 0


def test_a_small_source_ends_no_pipeline(spark, documents):
    """Of a hot source and a stray one, all documents go through the stage."""
    import corpus_pipeline

    rows = [(i, "tok " * 500, "en", "hot") for i in range(400)] + [(1000 + i, "tok " * 500, "en", "mid") for i in range(40)] + [(2000, "tok tok", "en", None), (2001, "", "en", "void"), (None, "tok", "en", "hot")]
    docs = documents(rows)
    out = [r["doc_id"] for r in corpus_pipeline.mixing(spark, docs, "").collect()]
    assert sorted(map(str, out)) == sorted(str(r[0]) for r in rows)
    scheduled = [r["doc_id"] for r in mixed(docs).collect()]
    assert len(scheduled) < len(rows) / 2 and out[: len(scheduled)] == scheduled
    assert mixed_whole(docs.limit(0)).count() == 0
    # The middle source isn't left to the end: it is spread over its weight.
    at = [i for i, x in enumerate(out) if x is not None and 1000 <= x < 2000]
    assert at[len(at) // 2] < 150
