import random

import numpy as np
from pyspark.sql import functions as F

from rollcall.llm import langid as L

WORDS = {"en": "the and with house river walking morning", "de": "der und mit haus fluss gehend morgen", "es": "el y con casa rio caminando manana"}


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[k].split(), k=rng.randint(3, 40))), k) for i in range(n) for k in [rng.choice(list(WORDS))]]


def test_held_out_accuracy_and_calibration(spark, documents):
    train = rows(400, 1)
    test = [(1000 + i, t, k) for i, t, k in rows(200, 2)]
    docs = documents([(i, t, k) for i, t, k in train] + [(i, t, None) for i, t, _ in test])
    got = {r["doc_id"]: r for r in L.identify(docs).collect()}
    right = [got[i]["predicted_lang"] == k for i, _, k in test]
    assert np.mean(right) >= 0.98
    assert abs(np.mean([got[i]["confidence"] for i, _, _ in test]) - np.mean(right)) < 0.1


def test_document_frequency_equals_brute_force(documents):
    texts = ["abab", "abc", "", None, "ABC"]
    df, n = L.document_frequency(documents(list(enumerate(texts))))
    one = lambda t: {(len(g), g) for k in L.SIZES for i in range(len(t) - k + 1) for g in [t[i : i + k]]}
    want = {}
    for t in texts:
        for g in one((t or "").lower()):
            want[g] = want.get(g, 0) + 1
    assert n == 5 and sorted(df[df > 0].tolist()) == sorted(want.values())


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    data = [(np.array([10 + c, *rng.choice(np.arange(100, 200), 5, False)]), np.full(6, 0.4)) for c in y]
    w, b = L.train(data, y, 2, l1=0.5)
    assert np.mean([np.argmax(x @ w[at] + b) == c for (at, x), c in zip(data, y, strict=True)]) == 1
    assert (w == 0).mean() > 0.99 and (w[[10, 11]] != 0).all()


def test_temperature_is_the_best_one():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(2000, 3))
    y = np.array([rng.choice(3, p=L.softmax(r)) for r in z])
    assert abs(L.fit_temperature(z * 4, y) - 4) < 0.6


def test_edges(documents):
    base = rows(120, 3)
    odd = [(900, None, None), (901, "", "en"), (902, "x", None), (903, "the house and the river " * 30_000, None), (None, "der fluss und das haus", None), (904, "der fluss und das haus", None), (904, "der fluss und das haus", None)]
    docs = documents(base + odd).withColumn("confidence", F.lit("c")).withColumn("f", F.lit(1)).withColumn("h", F.lit(1)).withColumn("_x", F.lit(1))
    out = L.identify(docs)
    by = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == docs.count()
    assert all((by[i]["predicted_lang"], by[i]["confidence"]) == ("und", 0.0) for i in (900, 901, 902))
    assert by[903]["predicted_lang"] == "en" and by[904]["predicted_lang"] == by[None]["predicted_lang"] == "de"
    assert L.identify(docs.limit(0)).count() == 0
    single = L.identify(docs.withColumn("lang", F.lit("en")))
    assert single.where("predicted_lang <> 'und' or confidence <> 0").isEmpty()


def test_few_labels_of_many_documents_all_train(documents, monkeypatch):
    """600 labelled among 30,000: as many train as may, not their share."""
    some = rows(600, 5)
    docs = documents(some + [(1000 + i, "x y", None) for i in range(30_000)])
    seen = []
    monkeypatch.setattr(L, "train", lambda data, y, k, train=L.train: seen.append(len(y)) or train(data, y, k))
    assert L.fit(docs, 400) is not None and seen == [300]


def test_features_are_character_ngrams():
    """Two texts of other scripts with the same letters have them in common."""
    import pyarrow as pa

    for text in ("дом и мир", "日本語の本", "naïve é", "ab"):
        (block,) = list(L.blocks(pa.array([text])))
        ((at, tf),) = list(L.counts(block))
        grams = [text[i : i + n] for n in L.SIZES for i in range(len(text) - n + 1)]
        assert tf.sum() == len(grams) and len(at) == len({g for g in grams})


def test_ftrl_equals_a_plain_restatement():
    rng = np.random.default_rng(5)
    data = [(np.sort(rng.choice(50, 6, False)), rng.random(6)) for _ in range(40)]
    y = rng.integers(0, 3, 40)
    w, b = L.train(data, y, 3, epochs=2, l1=0.05, l2=0.02, seed=9)
    alpha, beta = 0.5, 1.0
    z, n = {}, {}

    def weight(k, l1):
        v, m = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((beta + m**0.5) / alpha + 0.02)

    order = np.random.default_rng(9)
    for _ in range(2):
        for i in order.permutation(40):
            at, x = data[i]
            w0 = {(f, c): weight((f, c), 0.05) for f in at.tolist() for c in range(3)}
            b0 = [weight(("b", c), 0.0) for c in range(3)]
            p = L.softmax(np.array([sum(x[j] * w0[f, c] for j, f in enumerate(at.tolist())) + b0[c] for c in range(3)]))
            for c in range(3):
                for key, v, old in [((f, c), x[j], w0[f, c]) for j, f in enumerate(at.tolist())] + [(("b", c), 1.0, b0[c])]:
                    g = v * (p[c] - (y[i] == c))
                    s = ((n.get(key, 0.0) + g * g) ** 0.5 - n.get(key, 0.0) ** 0.5) / alpha
                    z[key] = z.get(key, 0.0) + g - s * old
                    n[key] = n.get(key, 0.0) + g * g
    assert all(abs(w[f, c] - weight((f, c), 0.05)) < 1e-9 for f in range(50) for c in range(3))
    assert all(abs(b[c] - weight(("b", c), 0.0)) < 1e-9 for c in range(3))


def test_predictions_equal_brute_force(documents):
    docs = documents(rows(200, 6))
    m = L.fit(docs)
    for r in L.identify(docs).collect():
        grams = [r["text"].lower()[i : i + n] for n in L.SIZES for i in range(len(r["text"]) - n + 1)]
        code = {}
        for g in grams:
            h = 0
            for k, c in enumerate(g):
                h = ((h if k else 0) * int(L._STEP) + ord(c) + 1) % 2**64 if k else ord(c) + 1
            odd = int(L._ODD[len(g) - 2])
            f = ((h * odd + odd) % 2**64) >> (64 - L.BITS)
            code[f] = code.get(f, 0) + 1
        x = {f: (1 + np.log(c)) * m.idf[f] for f, c in code.items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        p = L.softmax((sum(v / norm * m.weights[f].astype(float) for f, v in x.items()) + m.bias) / m.temperature)
        assert m.classes[int(np.argmax(p))] == r["predicted_lang"] and abs(p.max() - r["confidence"]) < 1e-4


def test_rare_languages_are_in_the_sample():
    q = L.quotas({"en": 100_000, "de": 50_000, "xx": 90, "yy": 3}, 6000)
    assert sum(q.values()) == 6000 and q["xx"] == 90 and q["yy"] == 3 and 1.8 < q["en"] / q["de"] < 2.2
    assert L.quotas({"en": 5, "de": 2}, 6000) == {"en": 5, "de": 2}
