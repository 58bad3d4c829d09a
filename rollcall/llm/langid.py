"""Language identification by sparse multinomial logistic regression.

Features are character n-grams of lower-cased texts (2, 3 and 4 letters), hashed to
``FEATURES`` places, with TF-IDF weights; document frequencies are counted over
all documents. The weights are trained by follow-the-regularised-leader
(FTRL-proximal, per coordinate) with an elastic net, on a bounded sample of
labelled documents (``train_rows``); L1 leaves most of them 0. A temperature is
then fitted on labelled documents kept out of training, so that confidences are
calibrated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.llm.textblocks import Block, blocks
from rollcall.session import ship

BITS = 16
FEATURES = 1 << BITS
SIZES = (2, 3, 4)
TRAIN_ROWS = 6000
UNKNOWN = "und"
_U = np.uint64
_STEP = _U(0x100000001B3)
_ODD = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def hashed(block: Block) -> tuple[list[np.ndarray], np.ndarray]:
    """For each size, the feature of the n-gram that ends at each character;
    and the bounds of the texts in characters."""
    x = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _U(1)
    bounds = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])[block.bounds]
    out, code = [], x
    for odd in _ODD:
        code = np.concatenate([np.zeros(1, np.uint64), code[:-1]])[: len(x)] * _STEP + x
        out.append(((code * odd + odd) >> _U(64 - BITS)).astype(np.uint16))
        # The next size starts from n-grams of this one.
    return out, bounds


def counts(block: Block):
    """(features, counts) of each text of a block."""
    codes, bounds = hashed(block)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        tf = np.bincount(np.concatenate([c[min(a + n - 1, b) : b] for n, c in zip(SIZES, codes, strict=True)]), minlength=FEATURES)
        at = np.flatnonzero(tf)
        yield at, tf[at]


def tfidf(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(tf)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


class Model:
    def __init__(self, classes: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float = 1.0):
        self.classes, self.weights, self.bias, self.idf, self.temperature = classes, weights, bias, idf, temperature

    def logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tfidf(at, tf, self.idf) @ self.weights[at] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal; rows are (features, TF-IDF). Weights and biases."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(zz: np.ndarray, nn: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w, b = weights(z[at], n[at], l1), weights(z[-1], n[-1], 0.0)
            p = softmax(x @ w + b)
            p[y[i]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
            step = (np.sqrt(n[-1] + p * p) - np.sqrt(n[-1])) / alpha
            z[-1] += p - step * b
            n[-1] += p * p
    return weights(z[:-1], n[:-1], l1), weights(z[-1], n[-1], 0.0)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search."""
    if not len(y):
        return 1.0
    loss = lambda u: -np.log(np.maximum(softmax(logits / np.exp(u))[np.arange(len(y)), y], 1e-300)).mean()
    a, b, r = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    while b - a > 1e-4:
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each feature, and documents; over all of ``docs``."""

    def run(batches):
        df, n = np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for block in blocks(batch.column(0)):
                for at, _ in counts(block):
                    df[at] += 1
                n += len(block)
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["f", "n"])

    got = docs.select("text").mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(FEATURES + 1, np.int64)
    df[np.asarray(got["f"])] = np.asarray(got["n"])
    return df[:-1], int(df[-1])


def quotas(each: dict[str, int], rows: int) -> dict[str, int]:
    """How many of ``rows`` each language has: in proportion to its number, but
    a quarter of an equal share at least where it has so many."""
    whole = sum(each.values())
    if whole <= rows:
        return dict(each)
    least = {k: min(n, rows // (4 * len(each))) for k, n in each.items()}
    left, rest = rows - sum(least.values()), whole - sum(least.values())
    share = {k: (n - least[k]) * left / rest for k, n in each.items()}
    out = {k: least[k] + int(share[k]) for k in each}
    for k in sorted(each, key=lambda k: (int(share[k]) - share[k], k))[: rows - sum(out.values())]:
        out[k] += 1
    return {k: n for k, n in out.items() if n}


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Trained on ``docs.lang``; None with fewer than two languages.

    At most ``train_rows`` labelled documents are used, chosen by a hash of the
    identifier and text, of each language in proportion, but a rare one has a
    quarter of an equal share if it can: every fourth of them sets the
    temperature, the others train. Repeated labelled rows count as often as they
    are there.
    """
    ship(docs.sparkSession)
    df, n = document_frequency(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    known = docs.select("text", "lang", F.xxhash64("doc_id", "text").alias("h")).where("lang is not null and text is not null and text <> ''")
    each = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    take = quotas(each, train_rows)
    if len(take) < 2:
        return None
    # A hash threshold lets each task keep about its share, the rank is exact.
    quota = docs.sparkSession.createDataFrame([(k, v, int(min(1.0, (1.5 * v + 20) / each[k]) * (1 << 20)) + 1) for k, v in take.items()], "lang string, quota long, below long")
    near = known.join(F.broadcast(quota), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("below"))
    ranked = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where("r <= quota")
    sample = ranked.select("text", "lang", "h").orderBy("h", "text", "lang").toArrow()
    names = sorted(set(sample["lang"].to_pylist()))
    if len(names) < 2:
        return None
    y = np.array([names.index(x) for x in sample["lang"].to_pylist()])
    raw = [c for b in blocks(sample["text"]) for c in counts(b)]
    rows = [(at, tfidf(at, tf, idf)) for at, tf in raw]
    held = np.arange(len(rows)) % 4 == 3
    weights, bias = train([r for r, h in zip(rows, held, strict=True) if not h], y[~held], len(names))
    logits = np.array([x @ weights[at] + bias for (at, x), h in zip(rows, held, strict=True) if h]).reshape(-1, len(names))
    return Model(names, weights.astype(np.float32), bias, idf.astype(np.float32), fit_temperature(logits, y[held]))


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``predicted_lang`` and ``confidence``.

    A null text, or one without an n-gram (under two characters), is ``und`` with
    confidence 0, as is every text where fewer than two languages are labelled.
    Equal texts are predicted alike; between equal probabilities the first
    language in code-point order wins. Columns of these names are replaced. Very
    long texts are read whole; an empty table stays empty.
    """
    model = fit(docs, train_rows)
    rest = docs.drop("predicted_lang", "confidence", "_lang")
    if model is None:
        return rest.withColumn("predicted_lang", F.lit(UNKNOWN)).withColumn("confidence", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("predicted_lang string, confidence double")
    def predict(texts: pa.Array) -> pa.Array:
        m = shared.value
        names, sure = [], []
        for block in blocks(texts):
            for at, tf in counts(block):
                if not len(at):
                    names.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                p = softmax(m.logits(at, tf) / m.temperature)
                k = int(np.argmax(p))
                names.append(m.classes[k])
                sure.append(float(p[k]))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["predicted_lang", "confidence"])

    rest = rest.withColumn("_lang", predict.asNondeterministic()(F.col("text")))
    return rest.select(*[F.col(f"`{c}`") for c in rest.columns if c != "_lang"], "_lang.*")
