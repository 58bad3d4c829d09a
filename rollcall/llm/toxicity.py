"""Toxicity by class-conditional Kneser-Ney models of words.

Insults are inflected, and their stems must carry over to forms that no labelled
text has. So a word is spelt byte by byte, each byte given the ones before it in
the word (``ORDER`` bytes in all, the word's start among them; contexts don't
cross words). A class's distribution interpolates its own discounted counts with
one that both classes share: the interpolated Kneser-Ney model of the counts of
both, which backs off to ever shorter contexts by continuation counts. So
spellings for which the classes have no evidence of their own cancel out, and a
word's log-likelihood ratio is gathered where they differ. In a context in which
no toxic count is above its discount, both classes use the shared distribution,
so the model only holds the others. Counts are numbers of
labelled texts, not of occurrences: one text that repeats itself says no more
than once. ``DISCOUNTS`` are high (modified Kneser-Ney discounts rise with the
count as well), so that a few texts by chance aren't evidence.

A text's score is the sum of the ratios of its distinct words over their number
(plus ``PRIOR_WORDS``); ratios under ``MARGIN`` nats count as 0, because many
small ones tell subjects and languages apart, and not toxic words.

Counts are taken over every labelled text. Labelled texts are halved by a hash
of their identifier; each half is scored by a model of the other half, which
sets the threshold; the model that is used is of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.textblocks import WORD, Block, blocks, mix
from rollcall.session import build_side, checkpointed, ship

ORDER = 8
#: Taken off a spelling's number of toxic and of ordinary texts.
DISCOUNTS = (2.0, 4.0)
#: Ratios of words from which on they count, in nats.
MARGIN = 2.0
#: Words added to a text's number, so that a few words don't decide.
PRIOR_WORDS = 50
#: Spellings of fewer texts aren't kept.
MIN_COUNT = 2
#: Scores are counted on a grid of this width to set the threshold.
GRID = 1e-4
_U = np.uint64
_START = 10


class Spelling:
    """The events of a block, each distinct word of a text once: ``code`` has
    the up to ORDER bytes that end at a byte of a word or at its end, packed in
    an integer (earlier bytes higher; the start counts as a line feed)."""

    def __init__(self, block: Block):
        n = len(block)
        d = np.full(len(block.data) + 2 * n, _START, np.uint8)
        d[np.arange(len(block.data)) + np.repeat(np.arange(n) * 2 + 1, np.diff(block.bounds))] = np.where(WORD[block.data], block.data, _START)
        gap = d == _START
        at = np.arange(len(d))
        start = np.concatenate([[0], np.maximum.accumulate(np.where(gap, at, 0))[:-1]]) if len(d) else at
        event = np.flatnonzero((at > 0) & ~(gap & (at - start <= 1)))
        size = np.minimum(event - start[event] + 1, ORDER)
        code = np.zeros(len(event), np.uint64)
        for j in range(ORDER - 1, -1, -1):
            code = np.where(j < size, (code << _U(8)) | d[np.maximum(event - j, 0)], code)
        text = np.searchsorted(block.bounds + 2 * np.arange(n + 1), event, "right") - 1
        last = np.flatnonzero(gap[event]) + 1
        first = np.concatenate([[0], last[:-1]]).astype(np.int64) if len(last) else last
        # A word is known by the sum of its hashed events, and its text.
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(code), dtype=np.uint64)])
        key = mix(total[last] - total[first]) ^ mix(text[first].astype(np.uint64) + _U(1)) if len(last) else total[:0]
        keep = np.sort(np.unique(key, return_index=True)[1])
        size = (last - first)[keep]
        self.words = text[first[keep]] if len(keep) else np.zeros(0, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(size)])
        on = np.repeat(first[keep] - self.bounds[:-1], size) + np.arange(self.bounds[-1])
        self.code, self.text, self.texts = code[on], text[on], n


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum rows of (code, counts) by code."""
    c = np.concatenate([p[0] for p in parts])
    v = np.concatenate([p[1] for p in parts])
    order = np.argsort(c, kind="stable")
    c, v = c[order], v[order]
    if not len(c):
        return c, v
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    return c[first], np.add.reduceat(v, first, axis=0)


class Table:
    """Open addressing from 64-bit codes to floats, looked up as arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, ~_U(0))
        self.values = np.zeros(1 << bits, np.float32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = self.keys[s] == ~_U(0)
            won = np.zeros(len(left), bool)
            u, i = np.unique(s[free], return_index=True)
            idx = np.flatnonzero(free)[i]
            won[idx] = True
            self.keys[u], self.values[u] = keys[left[idx]], values[left[idx]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none) and whether there is one."""
        out, hit = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        slot = self._slot(keys)
        found = self.keys[slot]
        ok = found == keys
        out[ok], hit[ok] = self.values[slot[ok]], True
        left = np.flatnonzero(~ok & (found != ~_U(0)))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            ok = found == keys[left]
            out[left[ok]], hit[left[ok]] = self.values[slot[ok]], True
            on = ~ok & (found != ~_U(0))
            left, slot = left[on], slot[on]
        return out, hit


def lengths(code: np.ndarray) -> np.ndarray:
    return sum(((code >> _U(8 * j)) != 0).astype(np.int64) for j in range(ORDER))


def _suffix(code: np.ndarray, n: int) -> np.ndarray:
    return code & _U((1 << (8 * n)) - 1)


def _contexts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted codes: the contexts, where each begins, and each code's."""
    c = code >> _U(8)
    new = np.concatenate([[True], c[1:] != c[:-1]]) if len(c) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return c[first], first, np.cumsum(new) - 1


def shared_model(code: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Interpolated Kneser-Ney probabilities of sorted codes: each level has the
    codes of its length and the suffixes of the next longer, by the number of
    those that have it."""
    size = lengths(code)
    level: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in range(ORDER, 0, -1):
        parts = [(code[size == n], count[size == n])]
        if n < ORDER:
            parts.append((_suffix(level[n + 1][0], n), np.ones(len(level[n + 1][0]), np.float32)))
        level[n] = merge_counts(parts)
    out = np.zeros(len(code))
    known, below = code[:0], out[:0]
    for n in range(1, ORDER + 1):
        c, v = level[n]
        if not len(c):
            continue
        _, first, group = _contexts(c)
        once, twice = (v == 1).sum(), (v == 2).sum()
        d = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
        total, kinds = np.add.reduceat(v, first), np.diff(np.append(first, len(c)))
        low = np.full(len(c), 1 / 256) if n == 1 else below[np.searchsorted(known, _suffix(c, n - 1))]
        known, below = c, (v - d) / total[group] + (d * kinds / total)[group] * low
        out[size == n] = below[np.searchsorted(c, code[size == n])]
    return out


class Model:
    """Log-likelihood ratios by spelling: of those with counts, the ratio of the
    two distributions; of others, that of the weights that their context gives
    to the shared one; 0 in a context without toxic evidence.

    ``counts`` has a row per code and the columns toxic and ordinary.
    """

    def __init__(self, code: np.ndarray, counts: np.ndarray):
        order = np.argsort(code)
        code, counts = code[order], counts[order].astype(np.float32)
        shared = shared_model(code, counts.sum(1))
        context, first, group = _contexts(code)
        d = np.array(DISCOUNTS)
        total = np.add.reduceat(counts, first, axis=0)
        weight = np.where(total > 0, np.add.reduceat(np.minimum(counts, d), first, axis=0) / np.maximum(total, 1), 1.0)
        some = weight[:, 0] < 1
        on = some[group]
        code, counts, shared, group = code[on], counts[on], shared[on], group[on]
        p = np.maximum(counts - d, 0) / np.maximum(total, 1)[group] + weight[group] * shared[:, None]
        self.spelling = Table(code, np.log(p[:, 0] / p[:, 1]))
        self.weight = Table(context[some], np.log(weight[some, 0] / weight[some, 1]))

    def ratios(self, code: np.ndarray) -> np.ndarray:
        out, hit = self.spelling.get(code)
        left = np.flatnonzero(~hit)
        out[left] = self.weight.get(code[left] >> _U(8))[0]
        return out

    def scores(self, block: Block) -> np.ndarray:
        """Ratios of distinct words over MARGIN, by their number plus
        PRIOR_WORDS; 0 for an empty text."""
        s = Spelling(block)
        total = np.concatenate([[0.0], np.cumsum(self.ratios(s.code), dtype=np.float64)])
        word = total[s.bounds[1:]] - total[s.bounds[:-1]]
        n = np.bincount(s.words, minlength=s.texts)
        return np.bincount(s.words, np.where(word > MARGIN, word, 0.0), minlength=s.texts) / (n + PRIOR_WORDS)


def count_blocks(parts: list, block: Block, kind: np.ndarray, kinds: int = 2) -> None:
    """Add, for each spelling of a block, the texts of each kind that have it."""
    s = Spelling(block)
    order = np.lexsort((s.code, s.text))
    code, text = s.code[order], s.text[order]
    if not len(code):
        return
    new = np.concatenate([[True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])])
    code, text = code[new], text[new]
    u, place = np.unique(code, return_inverse=True)
    v = np.zeros((len(u), kinds), np.int64)
    np.add.at(v, (place, np.asarray(kind)[text]), 1)
    parts.append((u, v))


def best_threshold(score: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> float:
    """The score from which on F1 is best, given the numbers of toxic and of
    ordinary texts with each score; 0 at least. Between two scores, the middle.
    Infinite without a toxic text."""
    if not toxic.sum():
        return float("inf")
    order = np.argsort(-score)
    s, t, o = score[order], np.cumsum(toxic[order]), np.cumsum(ordinary[order])
    i = int(np.argmax(2 * t / (t + o + t[-1])))
    return max(0.0, float((s[i] + s[i + 1]) / 2 if i + 1 < len(s) else s[i] - GRID))


def _usable(counts: np.ndarray) -> bool:
    return bool(len(counts)) and bool(counts.sum(0).all())


def fit(docs: DataFrame, labels: DataFrame, min_count: int = MIN_COUNT) -> tuple[Model | None, float]:
    """Count, build the models and set the threshold; (None, inf) when no
    labelled text is toxic or none is ordinary, in either half.

    A text with several labels is toxic if one says so; null labels and null
    identifiers don't count. All spellings of ``min_count`` texts count,
    however many there are: they come to the driver, which needs memory for
    them. The model is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    known = checkpointed(
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where("_id is not null and _toxic is not null")
        .groupBy("_id").agg(F.max(F.col("_toxic").cast("int")).alias("_toxic"))
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where("_id is not null")
    half = F.pmod(F.xxhash64("_id"), F.lit(2)).cast("int")
    # Few labels are broadcast; many are hashed, which spares the texts a sort.
    labelled = texts.join(build_side(known), "_id")

    def count(batches):
        parts: list = []
        for batch in batches:
            kind = np.asarray(batch.column(1))
            for block in blocks(batch.column(0)):
                count_blocks(parts, block, kind[block.first : block.first + len(block)], 4)
                if len(parts) >= 32:
                    parts = [merge_counts(parts)]
        if parts:
            code, value = merge_counts(parts)
            for i in range(0, len(code), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(code[part].astype(np.int64)), *(pa.array(value[part, k].astype(np.int32)) for k in range(4))], names=["code", "a", "b", "c", "d"])

    # Kinds: toxic and ordinary of the one half, then of the other.
    counts = labelled.select("_text", (half * 2 + F.when(F.col("_toxic") > 0, 0).otherwise(1)).alias("kind")).mapInArrow(count, "code long, a int, b int, c int, d int")
    counts = counts.groupBy("code").agg(*[F.sum(x).cast("int").alias(x) for x in "abcd"]).withColumn("n", F.expr("a + b + c + d"))
    counts = checkpointed(counts.where(F.col("n") >= min_count))
    got = counts.drop("n").toArrow()
    code = np.asarray(got["code"]).view(np.uint64)
    value = np.stack([np.asarray(got[x]) for x in "abcd"], 1).reshape(-1, 4)
    del got
    if not (_usable(value[:, :2]) and _usable(value[:, 2:])):
        return None, float("inf")
    both = []
    for own in (value[:, 2:], value[:, :2]):
        on = own.sum(1) >= min_count
        both.append(Model(code[on], own[on]) if _usable(own[on]) else None)
    if None in both:
        return None, float("inf")
    halves = [spark.sparkContext.broadcast(m) for m in both]
    s = F.when(half == 0, score_column(halves[0], "_first")).otherwise(score_column(halves[1], "_second"))
    # Either model sees only the texts of the other half; the others are null.
    scored = labelled.select("_id", "_toxic", F.when(half == 0, F.col("_text")).alias("_first"), F.when(half == 1, F.col("_text")).alias("_second"))
    rows = scored.select(F.round(s / GRID).cast("long").alias("s"), "_toxic").groupBy("s").agg(F.sum(F.when(F.col("_toxic") > 0, 1).otherwise(0)).alias("t"), F.count("*").alias("n")).toArrow()
    for shared in halves:
        shared.destroy()
    s, t, n = (np.asarray(rows[c], np.float64) for c in ("s", "t", "n"))
    return Model(code, value[:, :2] + value[:, 2:]), best_threshold(s * GRID, t, n - t)


def score_column(shared: Broadcast, text: str):
    """The score of a text column by a model that is broadcast."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(shared.value.scores(b) for b in blocks(texts))]))

    return score.asNondeterministic()(F.col(text))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``toxic_score`` (double) and ``is_toxic`` (boolean).

    A null or empty text scores 0; it and every other text is toxic only above
    the threshold, so nothing is toxic where no labelled text is. Equal texts
    score the same, and very long ones are read whole. Labelled rows that repeat
    count as often as they are there. An empty table stays empty. Columns of ``docs`` of these names are replaced, others
    stay; labels may have any further columns.
    """
    model, threshold = fit(docs, labels)
    rest = docs.drop("toxic_score", "is_toxic")
    if model is None:
        return rest.withColumn("toxic_score", F.lit(0.0)).withColumn("is_toxic", F.lit(False))
    return rest.withColumn("toxic_score", score_column(docs.sparkSession.sparkContext.broadcast(model), "text")).withColumn("is_toxic", F.col("toxic_score") > F.lit(threshold))
