"""Vectorised work on blocks of whole texts: word hashes and word n-grams.

Every function takes Arrow batches, so a task holds one Arrow batch and works
through it in blocks of about ``BLOCK_BYTES`` of UTF-8; a text longer than that
is a block of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

WORD = np.zeros(256, bool)
WORD[128:] = True
for _r in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"_"):
    WORD[list(_r)] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix; a bijection, so equal means equal."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, _U(base))
            p[0] = _U(1)
            if size > 4 * BLOCK_BYTES:  # a single huge text: not worth keeping
                if name == "up":
                    up = np.cumprod(p)
                else:
                    return up, np.cumprod(p)
            else:
                _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Block:
    """Some consecutive texts of a batch: bytes, and the bounds of each text."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def blocks(texts: pa.Array, lower: bool = True, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string array into blocks; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    n = len(texts)
    if not n:
        return
    _, off, buf = texts.buffers()
    bounds = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(bounds, bounds[a] + block_bytes, "right")) - 1
        b = min(max(b, a + 1), n)
        yield Block(a, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        a = b


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the bounds of each text's words.

    A word is a maximal run of ASCII letters, digits, underscores and
    non-ASCII characters.
    """
    data, bounds = block.data, block.bounds
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    w = WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    starts = w.copy()
    starts[1:] &= ~w[:-1] | edge[1:n]
    ends = w.copy()
    ends[:-1] &= ~w[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    hashes = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    return hashes, np.searchsorted(s, bounds)


def ngram_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams, and the index of each one's text.

    A text with some words, but fewer than n, has one n-gram of all of them.
    """
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(words))
    end = bounds[1:][doc]
    start = bounds[:-1][doc]
    keep = (at + n <= end) | ((at == start) & (end - start < n))
    at, doc, end = at[keep], doc[keep], end[keep]
    h = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for j in range(n):
        part = padded[at + j]
        part[at + j >= end] = 0
        h = h * _U(0xD6E8FEB86659FD93) + part
    return mix(h), doc


def distinct_per_text(hashes: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text, sorted within it; their texts; the bounds."""
    order = np.lexsort((hashes, doc)) if len(hashes) else np.zeros(0, np.int64)
    h, d = hashes[order], doc[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
    return h, d, np.searchsorted(d, np.arange(texts + 1))
