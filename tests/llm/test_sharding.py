import itertools
import random

from pyspark.sql import functions as F

from rollcall.llm.sharding import difference, shard


def naive(weights, k):
    """The textbook method on whole vectors, by repeated sorting."""
    parts = [([w] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]) for i, w in enumerate(weights)]
    while len(parts) > 1:
        parts.sort(key=lambda p: -(max(p[0]) - min(p[0])))
        (a, ia), (b, ib) = parts[0], parts[1]
        x = sorted(zip(a, ia), key=lambda t: -t[0])
        y = sorted(zip(b, ib), key=lambda t: t[0])
        parts = parts[2:] + [([s + t for (s, _), (t, _) in zip(x, y)], [p + q for (_, p), (_, q) in zip(x, y)])]
    return sorted(parts[0][0], reverse=True)


def test_difference_places_sums_up_and_matches_the_naive_method():
    rng = random.Random(3)
    for _ in range(60):
        k, n = rng.choice([2, 3, 5]), rng.randint(1, 14)
        w = rng.sample(range(1, 5000), n)
        sums, place = difference([[x] for x in w], k)
        got = [0] * k
        for x, p in zip(w, place):
            got[p[0]] += x
        assert got == sums == sorted(sums, reverse=True)
        assert max(sums) - min(sums) <= max(naive(w, k)[0] - naive(w, k)[-1], max(w))


def test_difference_is_near_the_best_partition():
    rng = random.Random(5)
    for _ in range(10):
        w = [rng.randint(1, 1000) for _ in range(10)]
        best = min(abs(sum(w) - 2 * sum(c)) for r in range(11) for c in itertools.combinations(w, r))
        sums, _ = difference([[x] for x in w], 2)
        assert sums[0] - sums[1] <= best + max(w) // 4
    assert difference([], 3) == ([0, 0, 0], [])


def test_known_example():
    # 8 7 6 5 4: differencing ends with a spread of 2.
    assert difference([[x] for x in (8, 7, 6, 5, 4)], 2)[0] == [16, 14]


def loads(out, k):
    got = {r[0]: r[1] for r in out.groupBy("shard").agg(F.sum("n_bytes")).collect()}
    return sorted((got.get(i, 0) for i in range(k)), reverse=True)


def test_shards_keep_groups_whole_and_balance_over_levels(spark, documents):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(1, 3000)) for i in range(400)] + [(1000 + i, "copy " * 50) for i in range(30)]
    docs = documents(rows)
    for fan in (16, 16_384):
        out = shard(docs, shards=4, fan=fan)
        assert out.count() == len(rows)
        load = loads(out, 4)
        assert sum(load) == sum(len(r[1]) for r in rows)
        assert load[0] - load[-1] < 0.01 * sum(load)
        assert out.where("doc_id >= 1000").select("shard").distinct().count() == 1


def test_nulls_ties_repeats_empty_and_clashing_columns(spark, documents):
    docs = documents([(1, None), (2, None), (None, "abc"), (3, ""), (4, "abc"), (4, "abc"), (5, "y" * 100_000)])
    docs = docs.withColumn("shard", F.lit("old")).withColumn("_g", F.lit(1)).withColumn("vec", F.lit(1))
    out = {(r["doc_id"], r["n_bytes"]): r["shard"] for r in shard(docs, shards=3).collect()}
    assert shard(docs, shards=3).count() == 7
    assert out[(1, 0)] == out[(2, 0)] and out[(None, 3)] == out[(4, 3)]
    assert shard(docs.limit(0), shards=3).count() == 0
