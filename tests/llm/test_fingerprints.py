import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rollcall.llm.fingerprints import estimated_jaccard, fingerprints, minima, pack, probe
from rollcall.llm.textblocks import blocks, mix, ngram_hashes, word_hashes


def test_words_and_ngrams_match_a_plain_tokeniser():
    import re

    texts = ["The cat, the CAT!", "", "a", None, "über-große straße x_1", "one two three four five six"]
    for size in (1, 7, 1 << 20):
        seen, bounds = [], [0]
        for b in blocks(pa.array(texts), block_bytes=size):
            h, w = word_hashes(b)
            for i in range(len(b)):
                seen.append(h[w[i] : w[i + 1]].tolist())
        words = [re.findall(r"[0-9a-z_\x80-￿]+", (t or "").lower()) for t in texts]
        assert [len(x) for x in seen] == [len(x) for x in words]
        pairs = {(a, b) for x, y in zip(seen, words) for a, b in zip(x, y)}
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
    block = next(blocks(pa.array(texts)))
    _, doc = ngram_hashes(*word_hashes(block), 3)
    assert np.bincount(doc, minlength=6).tolist() == [2, 0, 1, 0, 2, 4]


def brute_minima(hashes, bins):
    out = [None] * bins
    width = bins.bit_length() - 1
    for h in hashes:
        b, v = h >> (64 - width), h & ((1 << (64 - width)) - 1)
        out[b] = v if out[b] is None else min(out[b], v)
    full = []
    for i in range(bins):
        at, j = 1, i
        while out[j] is None:
            j = int(probe(at, bins)[i])
            at += 1
        full.append(out[j])
    return full


def test_minima_and_packing_equal_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 900):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        got = minima(h, np.zeros(n, np.int64), 1, 64)
        assert got[0].tolist() == brute_minima([int(x) for x in h], 64)
        word = pack(got, 4)[0]
        low = [(int(word[i // 16]) >> (4 * (i % 16))) & 15 for i in range(64)]
        assert low == [int(x) & 15 for x in got[0]]


def test_estimates_are_unbiased(spark, documents):
    rng = random.Random(7)
    rows, truth = [], {}
    for i in range(60):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
        other = list(words)
        for j in rng.sample(range(400), rng.choice([0, 4, 20, 60, 400])):
            other[j] = f"v{rng.randint(0, 10**6)}"
        grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        a, b = grams(words), grams(other)
        truth[i] = len(a & b) / len(a | b)
        rows += [(i, " ".join(words), "en", "a"), (i, " ".join(other), "en", "b")]
    f = fingerprints(documents(rows))
    a, b = f.where("source = 'a'"), f.where("source = 'b'").select("doc_id", F.col("fingerprint").alias("g"))
    got = {r[0]: r[1] for r in a.join(b, "doc_id").select("doc_id", estimated_jaccard("fingerprint", "g")).collect()}
    err = np.array([got[i] - truth[i] for i in truth])
    assert abs(err.mean()) < 0.02 and np.abs(err).max() < 0.15
    assert all(got[i] == 1 for i in truth if truth[i] == 1)


def test_edges(documents):
    docs = documents([(1, None), (2, ""), (3, "..."), (4, "one"), (5, "one"), (None, "a b c d e f g"), (6, "word " * 200_000)]).withColumn("fingerprint", F.lit(0)).withColumn("_fp", F.lit(0))
    out = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    assert all(out[i]["fingerprint"] is None and out[i]["n_ngrams"] == 0 for i in (1, 2, 3))
    assert out[4]["fingerprint"] == out[5]["fingerprint"] and len(out[4]["fingerprint"]) == 16
    assert out[None]["n_ngrams"] == 3 and out[6]["n_ngrams"] == 1
    assert fingerprints(docs.limit(0)).count() == 0
    assert mix(np.array([1], np.uint64))[0] != 1
