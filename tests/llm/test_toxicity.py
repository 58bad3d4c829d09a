import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rollcall.llm import toxicity as T
from rollcall.llm.textblocks import blocks

ORDINARY = "the garden of the house is green and quiet today while rivers carry boats along to distant towns and markets".split()
INSULTS = "blarg vexling snorkop grubbish zilchik".split()


def text(rng, bad):
    words = rng.choices(ORDINARY, k=rng.randint(20, 80))
    if bad:
        for _ in range(len(words) // 6):
            words[rng.randrange(len(words))] = rng.choice(INSULTS) + rng.choice(["", "s", "ed", "ing"])
    return " ".join(words)


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, text(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(n)]
    return rows


def words(t):
    return set(re.findall(rb"[0-9a-z_\x80-\xff]+", t.lower().encode()))


def events(w):
    """(context, byte) of a word, the start being a line feed."""
    b = b"\n" + w + b"\n"
    return [b[max(0, i - T.ORDER + 1) : i + 1] for i in range(1, len(b))]


def brute(rows):
    """Scores from dictionaries."""
    docs = [Counter(), Counter()]
    for t, toxic in rows:
        for g in {g for w in words(t) for g in events(w)}:
            docs[1 - toxic][g] += 1
    kept = {g for g in {*docs[0], *docs[1]} if docs[0][g] + docs[1][g] >= T.MIN_COUNT}
    level = {n: Counter() for n in range(1, T.ORDER + 1)}
    for g in kept:
        level[len(g)][g] += docs[0][g] + docs[1][g]
    for n in range(T.ORDER - 1, 0, -1):
        for g in level[n + 1]:
            level[n][g[1:]] += 1
    total, kinds, d = Counter(), Counter(), {}
    for n, table in level.items():
        one, two = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
        d[n] = min(max(one / max(one + 2 * two, 1), 0.1), 0.95)
        for g, c in table.items():
            total[n, g[:-1]] += c
            kinds[n, g[:-1]] += 1

    def shared(g):
        n = len(g)
        if not n:
            return 1 / 256
        k = n, g[:-1]
        return (level[n][g] - d[n]) / total[k] + d[n] * kinds[k] / total[k] * shared(g[1:])

    own = [Counter(), Counter()]
    cut = [Counter(), Counter()]
    for g in kept:
        for k in (0, 1):
            own[k][g[:-1]] += docs[k][g]
            cut[k][g[:-1]] += min(docs[k][g], T.DISCOUNTS[k])
    weight = lambda h, k: cut[k][h] / own[k][h] if own[k][h] else 1.0

    def ratio(g):
        h = g[:-1]
        if weight(h, 0) == 1:
            return 0.0
        if g not in kept:
            return math.log(weight(h, 0) / weight(h, 1))
        p = [max(docs[k][g] - T.DISCOUNTS[k], 0) / max(own[k][h], 1) + weight(h, k) * shared(g) for k in (0, 1)]
        return math.log(p[0] / p[1])

    def score(t):
        w = words(t)
        r = [sum(map(ratio, events(x))) for x in w]
        return sum(x for x in r if x > T.MARGIN) / (len(w) + T.PRIOR_WORDS)

    return score


def test_scores_equal_kneser_ney_from_dictionaries():
    rows = [(t, y) for _, t, y in labelled(60)]
    parts = []
    for b in blocks(pa.array([t for t, _ in rows])):
        T.count_blocks(parts, b, np.array([1 - y for _, y in rows])[b.first : b.first + len(b)])
    code, value = T.merge_counts(parts)
    keep = value.sum(1) >= T.MIN_COUNT
    model = T.Model(code[keep], value[keep])
    score = brute(rows)
    some = 0
    for t in (*(t for t, _ in rows[:12]), "zilchik!", "", "   ", "Ünknown ☃ bytes grubbishly", "grubbish boats grubbish", "x"):
        got = model.scores(next(iter(blocks(pa.array([t])))))[0]
        assert abs(got - score(t)) < 1e-4, t
        some += got > 0
    assert some >= 3
    together = model.scores(next(iter(blocks(pa.array(["grubbish boats", "", "blarg", "blarg"])))))
    assert np.allclose(together, [score(t) for t in ("grubbish boats", "", "blarg", "blarg")], atol=1e-4)


def test_held_out_accuracy(spark, documents):
    rows = labelled(600)
    rng = random.Random(9)
    fresh = [(10_000 + i, text(rng, i % 3 == 0)) for i in range(150)]
    docs = documents([(i, t) for i, t, _ in rows] + fresh)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["is_toxic"] for r in T.toxicity(docs, labels).collect()}
    assert sum(got[10_000 + i] == (i % 3 == 0) for i in range(150)) >= 145


def test_edges(spark, documents):
    rows = labelled(200)
    long = " ".join(ORDINARY) + " "
    odd = [(9001, None), (9002, ""), (9003, long * 20_000), (None, "blarg vexling snorkop " * 20), (9004, "blarg vexling snorkop " * 20), (9004, "blarg vexling snorkop " * 20)]
    docs = documents([(i, t) for i, t, _ in rows] + odd).withColumn("toxic_score", F.lit("x")).withColumn("toxic", F.lit(0)).withColumn("_id", F.lit(3)).withColumn("_text", F.lit("y"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int").withColumn("text", F.lit("z"))
    out = T.toxicity(docs, labels)
    assert out.count() == docs.count() and set(out.columns) == {*docs.columns, "is_toxic"}
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[9001]["toxic_score"] == by[9002]["toxic_score"] == 0 and not by[9001]["is_toxic"] and not by[9003]["is_toxic"]
    assert by[9004]["is_toxic"] and by[None]["is_toxic"] and by[9004]["toxic_score"] == by[None]["toxic_score"]
    assert T.toxicity(docs.limit(0), labels).count() == 0
    none = T.toxicity(docs, labels.where("toxic = 0"))
    assert none.where("is_toxic").isEmpty() and none.count() == docs.count()
    assert T.toxicity(docs, labels.limit(0)).where("is_toxic or toxic_score <> 0").isEmpty()


def test_no_number_of_spellings_prunes_any(spark, documents):
    """Over 2,000,000 spellings: an insult of three texts is still in the model."""
    rng = random.Random(6)
    rare = [(i, "garden river " + ("snorkopper" if i < 3 else "blarg"), 1) for i in range(11)] + [(20 + i, "garden river quiet", 0) for i in range(40)]
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(4000)) for _ in range(80)]
    rows = rare + [(100 + i, t, 0) for i, t in enumerate(noise * 2)]
    model, _ = T.fit(documents([r[:2] for r in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    code = np.array([int.from_bytes(b"norkoppe", "big")], np.uint64)
    assert model.spelling.get(code)[1].all()
