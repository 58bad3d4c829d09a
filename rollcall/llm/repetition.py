"""Quality rule: repetition within a text, from its suffix array.

The suffix array of a text's UTF-8 bytes is built by prefix doubling, on numpy
arrays; only suffixes that still share a prefix with another are sorted again.
The longest common prefix (LCP) of neighbours in it comes from the ranks of
each doubling round. The deepest LCP interval that holds a suffix is the
longest maximal repeat that starts there, so the union of the spans of all
maximal repeats of ``min_repeat`` bytes or more is the union, over all
suffixes, of the larger of their two neighbouring LCPs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.textblocks import blocks
from rollcall.session import ship

MIN_REPEAT = 48
MAX_FRACTION = 0.6
MAX_REPEAT = 1000
#: Shorter texts have no room for two repeats side by side.
MIN_BYTES = 2 * MIN_REPEAT
_U = np.uint64


def _first_eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as integers that sort alike;
    positions past the end count as 0."""
    n = len(data)
    x = np.zeros(n + 8, np.uint64)
    x[:n] = data
    x = (x[:-1] << _U(8)) | x[1:]
    x = (x[:-2] << _U(16)) | x[2:]
    return ((x[:-4] << _U(32)) | x[4:])[:n]


def repeat_lengths(data: np.ndarray) -> np.ndarray:
    """For each byte, the length of the longest substring from it on that also
    starts elsewhere in the text; lengths under 8 count as 0."""
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 9:
        return out
    key = _first_eight(data)
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    del k
    if not same.any():
        return out
    # A text has under 2^31 bytes, and a rank array is kept for each round.
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(n), 0))
    ranks, h = [rank], 8
    tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    left = order[tied]  # in groups, by rank
    del order, tied
    while True:
        # Neighbours that part in this round get their LCP from the ranks of
        # all rounds before; those that stay tied wait for the next.
        shifted = left + h
        second = np.where(shifted < n, rank[np.minimum(shifted, n - 1)], n - 1 - shifted)
        first = rank[left]
        o = np.lexsort((second, first))
        left, first, second = left[o], first[o], second[o]
        group = first[1:] == first[:-1]
        equal = group & (second[1:] == second[:-1])
        parted = np.flatnonzero(group & ~equal)
        if len(parted):
            a, b = left[parted], left[parted + 1]
            lcp = np.full(len(a), h)
            for step, r in zip((h >> i for i in range(1, 60)), reversed(ranks[:-1]), strict=False):
                x, y = a + lcp, b + lcp
                inside = (x < n) & (y < n)
                x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
                lcp += np.where(inside & (r[x] == r[y]), step, 0)
            x, y = a + lcp, b + lcp
            inside = (x < n) & (y < n)
            diff = key[np.minimum(x, n - 1)] ^ key[np.minimum(y, n - 1)]
            lead = np.zeros(len(a), np.int64)
            for j in range(8, 0, -1):
                lead = np.where(diff >> _U(64 - 8 * j) == 0, np.maximum(lead, j), lead)
            lcp += np.where(inside, lead, 0)
            lcp = np.minimum(lcp, n - np.maximum(a, b))
            np.maximum.at(out, a, lcp)
            np.maximum.at(out, b, lcp)
        if not equal.any():
            out[out < 8] = 0  # the end of a text and NUL look alike to a key
            return out
        new = np.concatenate([[True], ~group]), np.concatenate([[True], ~equal])
        at = np.arange(len(left))
        rank = rank.copy()
        rank[left] = first + np.maximum.accumulate(np.where(new[1], at, 0)) - np.maximum.accumulate(np.where(new[0], at, 0))
        ranks.append(rank)
        h *= 2
        left = left[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])]


def repetition(data: np.ndarray, min_repeat: int = MIN_REPEAT) -> tuple[int, int]:
    """Bytes covered by maximal repeats, and the length of the longest one."""
    length = repeat_lengths(data)
    length[length < min_repeat] = 0
    at = np.arange(len(data))
    covered = int((np.maximum.accumulate(at + length) > at).sum()) if len(data) else 0
    return covered, int(length.max(initial=0))


def measures(text: str = "text", min_repeat: int = MIN_REPEAT):
    """A struct column of n_bytes, repeat_fraction and longest_repeat."""

    @F.arrow_udf("n_bytes long, repeat_fraction double, longest_repeat long")
    def measure(texts: pa.Array) -> pa.Array:
        n, covered, longest = [], [], []
        for block in blocks(texts, lower=False):
            for a, b in zip(block.bounds[:-1], block.bounds[1:], strict=True):
                c, m = repetition(block.data[a:b], min_repeat)
                n.append(b - a)
                covered.append(c)
                longest.append(m)
        n = np.asarray(n, np.int64)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(np.asarray(covered, np.float64) / np.maximum(n, 1)), pa.array(np.asarray(longest, np.int64))], names=["n_bytes", "repeat_fraction", "longest_repeat"])

    return measure.asNondeterministic()(F.col(text))


def repetition_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_fraction: float = MAX_FRACTION, max_repeat: int = MAX_REPEAT, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` with n_bytes, repeat_fraction, longest_repeat and ``keep``.

    A text is rejected if repeats of ``min_repeat`` bytes or more cover over
    ``max_fraction`` of it, or if one of them has over ``max_repeat`` bytes. A
    text of under ``min_bytes`` is too short to judge and is kept, as is an
    empty or null one (0 bytes, fraction 0). ``min_repeat`` is 8 at least. Equal
    texts get equal rows. Very long texts are judged whole; one that repeats itself
    all over takes some 150 bytes of memory a byte. An empty table stays empty. Columns
    of ``docs`` of these names are replaced, others stay.
    """
    if min_repeat < 8:
        raise ValueError("min_repeat: 8 at least")
    ship(docs.sparkSession)
    names = ("n_bytes", "repeat_fraction", "longest_repeat", "keep")
    rest = docs.drop(*names, "_repetition").withColumn("_repetition", measures(min_repeat=min_repeat))
    return rest.select(
        *[F.col(f"`{c}`") for c in rest.columns if c != "_repetition"], "_repetition.*",
        ((F.col("_repetition.n_bytes") < min_bytes) | ((F.col("_repetition.repeat_fraction") <= max_fraction) & (F.col("_repetition.longest_repeat") <= max_repeat))).alias("keep"),
    )
