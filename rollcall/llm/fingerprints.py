"""Document fingerprints: one-permutation MinHash, densified, in packed bits.

Each distinct word ``n``-gram is hashed once; the high bits of the hash choose
one of ``bins`` bins, which keeps its smallest value. An empty bin takes the
value of another, chosen by a hash of the bin and of the number of the attempt
until one is found that isn't empty (optimal densification: all texts probe in
the same order, so equal sets fill alike). The lowest ``bits`` bits of each bin
are packed into 64-bit words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.textblocks import blocks, mix, ngram_hashes, word_hashes
from rollcall.session import ship

NGRAM = 5
BINS = 256
BITS = 4
_U = np.uint64
_EMPTY = ~_U(0)


@lru_cache(4096)
def probe(attempt: int, bins: int) -> np.ndarray:
    """The bin that each empty bin asks in an attempt."""
    seed = _U(attempt * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
    return (mix(np.arange(bins, dtype=np.uint64) * _U(0x100000001B3) + seed) >> _U(32)).astype(np.int64) % bins


def minima(hashes: np.ndarray, doc: np.ndarray, texts: int, bins: int = BINS) -> np.ndarray:
    """Densified bins, a row per text; a text without n-grams has empty ones."""
    width = bins.bit_length() - 1
    flat = np.full(texts * bins, _EMPTY)
    place = doc * bins + (hashes >> _U(64 - width)).astype(np.int64)
    np.minimum.at(flat, place, hashes & _U((1 << (64 - width)) - 1))
    table = flat.reshape(texts, bins)
    some = (table != _EMPTY).any(1)
    row, col = np.nonzero((table == _EMPTY) & some[:, None])
    full = table.copy()
    attempt = 1
    while len(row):
        got = table[row, probe(attempt, bins)[col]]
        ok = got != _EMPTY
        full[row[ok], col[ok]] = got[ok]
        row, col = row[~ok], col[~ok]
        attempt += 1
    return full


def pack(table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The lowest bits of each bin, the first bin lowest, as signed words."""
    per = 64 // bits
    low = (table & _U((1 << bits) - 1)).reshape(len(table), -1, per)
    return (low << (np.arange(per, dtype=np.uint64) * _U(bits))).sum(2, dtype=np.uint64).astype(np.int64)


def fingerprints(docs: DataFrame, n: int = NGRAM, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``docs`` with ``n_ngrams`` (distinct) and ``fingerprint``, an array of
    ``bins * bits / 64`` longs.

    A text of fewer than ``n`` words has one n-gram of them all; a null text, or
    one without a word, has 0 and a null fingerprint. Equal texts get equal
    fingerprints. Columns of ``docs`` of these names are replaced.
    """
    if bins & (bins - 1) or bits not in (1, 2, 4, 8, 16, 32) or bins * bits % 64:
        raise ValueError("bins: a power of 2; bits: 1, 2, 4, 8, 16 or 32; bins * bits: a multiple of 64")

    ship(docs.sparkSession)

    @F.arrow_udf("n_ngrams int, fingerprint array<long>")
    def fingerprint(texts: pa.Array) -> pa.Array:
        counts, words = [np.zeros(0, np.int64)], [np.zeros((0, bins * bits // 64), np.int64)]
        for block in blocks(texts):
            h, doc = ngram_hashes(*word_hashes(block), n)
            words.append(pack(minima(h, doc, len(block), bins), bits))
            key = np.sort(doc.astype(np.uint64) << _U(44) ^ (h >> _U(20)))  # distinct n-grams: 44 bits are enough within a text
            fresh = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            counts.append(np.bincount((fresh >> _U(44)).astype(np.int64), minlength=len(block)))
        count, flat = np.concatenate(counts), np.concatenate(words)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.reshape(-1)), mask=pa.array(count == 0))
        return pa.StructArray.from_arrays([pa.array(count.astype(np.int32)), rows], names=["n_ngrams", "fingerprint"])

    rest = docs.drop("n_ngrams", "fingerprint", "_fp").withColumn("_fp", fingerprint.asNondeterministic()(F.col("text")))
    return rest.select(*[F.col(f"`{c}`") for c in rest.columns if c != "_fp"], "_fp.*")


def estimated_jaccard(a: str | Column, b: str | Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Jaccard similarity from two fingerprints, without Python.

    Unequal bins agree in their low bits with chance 2^-bits; that is taken
    off: (agreeing / bins - 2^-bits) / (1 - 2^-bits), at least 0. Null if either
    fingerprint is.
    """
    low = sum(1 << i for i in range(0, 64, bits))
    low = low - (1 << 64) if low >= 1 << 63 else low

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        step = 1
        while step < bits:
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
            step *= 2
        return F.bit_count(d.bitwiseAND(F.lit(low)))

    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    c = 2.0**-bits
    return F.greatest(F.lit(0.0), (1 - off / bins - c) / (1 - c))
