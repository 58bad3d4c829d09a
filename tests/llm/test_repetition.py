import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm.repetition import repeat_lengths, repetition, repetition_rules


def brute(d):
    n, out = len(d), [0] * len(d)
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and d[i + k] == d[j + k]:
                    k += 1
                out[i] = max(out[i], k)
    return [x if x >= 8 else 0 for x in out]


def test_repeat_lengths_equal_brute_force():
    rng = random.Random(1)
    for t in range(200):
        n = rng.choice([0, 5, 9, 20, 60, 120])
        s = bytes(rng.choice(b"ab\0") for _ in range(n)) if t % 2 else bytes(rng.choice(b"abcdefgh") for _ in range(max(1, n // 4))) * 4
        assert list(repeat_lengths(np.frombuffer(s, np.uint8))) == brute(s)


def test_coverage_equals_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        s = b"".join(rng.choice([b"the quick brown fox ", b"%d " % rng.randint(0, 10**9), b"lazy dog jumps over "]) for _ in range(8))
        length = brute(s)
        cover = [any(length[p] >= 16 and p <= i < p + length[p] for p in range(len(s))) for i in range(len(s))]
        got = repetition(np.frombuffer(s, np.uint8), 16)
        assert got == (sum(cover), max([x for x in length if x >= 16], default=0))


def test_rule_rejects_repeats_and_keeps_prose(documents):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))
    line = prose(12)
    long = prose(30_000)
    rows = [(1, prose(300)), (2, "\n".join([line] * 40)), (3, prose(200) + " " + "spam eggs " * 200), (4, ""), (5, None), (6, "ha " * 20), (7, long), (8, long + long), (7, long)]
    docs = documents(rows).withColumn("keep", F.lit("old")).withColumn("_repetition", F.lit(1))
    out = repetition_rules(docs)
    assert out.count() == len(rows) and out.columns.count("keep") == 1
    keep = {r["doc_id"]: r["keep"] for r in out.collect()}
    assert keep == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True, 7: True, 8: False}
    row = {r["doc_id"]: r for r in out.collect()}
    assert row[5]["n_bytes"] == 0 and row[5]["repeat_fraction"] == 0
    assert row[8]["longest_repeat"] == len(long.encode()) and row[8]["repeat_fraction"] == 1
    assert repetition_rules(docs.limit(0)).count() == 0


def test_clean_labelled_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    out = repetition_rules(docs).join(labels, "doc_id")
    assert out.where("not keep").count() == 0 < out.count()


def test_short_texts_are_judged(documents):
    junk = "the very same sentence of more than forty-eight bytes. "
    rows = [(1, junk * 4), (2, junk * 2), (3, junk)]
    keep = {r["doc_id"]: r["keep"] for r in repetition_rules(documents(rows)).collect()}
    assert keep == {1: False, 2: False, 3: True}


def test_a_very_long_text_that_repeats_itself_is_measured_whole():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    covered, longest = repetition(np.full(2_000_000, 97, np.uint8))
    assert (covered, longest) == (2_000_000, 1_999_999)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 < 200 * 2_000_000


def test_repeats_under_eight_bytes_are_refused(documents):
    with pytest.raises(ValueError):
        repetition_rules(documents([(1, "x")]), min_repeat=4)
