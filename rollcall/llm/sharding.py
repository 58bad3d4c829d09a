"""Sharding by Karmarkar-Karp differencing.

Rows of a group stay together. A partial partition is a vector of ``shards``
sums; at first each group is one, with a single sum that isn't 0. The two
partial partitions of the largest spread are combined again and again, the
largest sum of one with the smallest of the other, until one is left.

Differencing is sequential, so it runs in levels: groups are dealt by hash to
buckets of about ``fan`` groups, each bucket is differenced on its own, and the
partial partitions that come out are combined by the same rule, ``fan`` of them
at a time, until one remains. What leaves a bucket has a small spread already.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.session import checkpointed, ship

SHARDS = 16
FAN = 16_384


def difference(vectors: list[list[int]], shards: int) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions (lists of at most ``shards`` sums). Returns
    the sums of the result, largest first, and for each vector the place of each
    of its sums. Equal spreads combine in the order given."""
    leaf: list[tuple[int, int]] = []
    kids: list[tuple[int, int]] = []
    heap = []
    for i, v in enumerate(vectors):
        cells = []
        for j, x in enumerate(v):
            leaf.append((i, j))
            cells.append((-x, len(leaf) - 1))
        cells.sort()
        cells += [(0, -1)] * (shards - len(cells))
        heap.append((cells[0][0] - cells[-1][0], i, cells))
    n_leaf, seq = len(leaf), len(heap)
    if not heap:
        return [0] * shards, []
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        cells = []
        for (x, p), (y, q) in zip(a, reversed(b), strict=True):
            if p < 0 or q < 0:
                node = max(p, q)
            else:
                kids.append((p, q))
                node = n_leaf + len(kids) - 1
            cells.append((x + y, node))
        cells.sort()
        heapq.heappush(heap, (cells[0][0] - cells[-1][0], seq, cells))
        seq += 1
    place = [[0] * len(v) for v in vectors]
    for slot, (_, root) in enumerate(heap[0][2]):
        stack = [root] if root >= 0 else []
        while stack:
            node = stack.pop()
            if node < n_leaf:
                i, j = leaf[node]
                place[i][j] = slot
            else:
                stack += kids[node - n_leaf]
    return [-x for x, _ in heap[0][2]], place


def text_group() -> Column:
    """Copies of a text are a group."""
    return F.unhex(F.md5(F.col("text")))


def shard(docs: DataFrame, shards: int = SHARDS, group: Column | None = None, size: Column | None = None, fan: int = FAN) -> DataFrame:
    """(doc_id, n_bytes, shard) for each row of ``docs``; shard 0 is the largest.

    ``group`` (by default equal texts) is indivisible, ``size`` (by default the
    bytes of the text) counts. Rows with a null group are one group, a null size
    is 0. Repeated rows count as often as they are there. An empty table gives
    an empty result. Further columns are ignored.
    """
    ship(docs.sparkSession)
    group = text_group() if group is None else group
    size = F.octet_length("text") if size is None else size
    rows = docs.select("doc_id", F.coalesce(group.cast("binary"), F.lit(b"\0")).alias("_g"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    buckets = max(1, math.ceil(docs.count() / fan))

    def first_level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_bytes", "_g"], ascending=[False, True], kind="stable")
        _, place = difference([[x] for x in pdf["n_bytes"].tolist()], shards)
        return pdf.assign(slot=np.array([p[0] for p in place], np.int32))

    groups = rows.groupBy("_g").agg(F.sum("n_bytes").alias("n_bytes")).withColumn("vec", F.pmod(F.xxhash64("_g"), F.lit(buckets)))
    placed = checkpointed(groups.groupBy("vec").applyInPandas(first_level, "_g binary, n_bytes long, vec long, slot int"))
    vectors = placed.groupBy("vec", "slot").agg(F.sum("n_bytes").alias("n_bytes"))
    out = placed.select("_g", "vec", "slot")

    def next_level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec", "slot"])
        parts = [(k, g["slot"].tolist(), g["n_bytes"].tolist()) for k, g in pdf.groupby("vec", sort=True)]
        _, place = difference([p[2] for p in parts], shards)
        return pdf.assign(to=np.array([x for p in place for x in p], np.int32))

    while True:
        above = math.ceil(buckets / fan)
        moved = vectors.withColumn("up", F.pmod(F.xxhash64("vec"), F.lit(above)) if above > 1 else F.lit(0).cast("long"))
        moved = checkpointed(moved.groupBy("up").applyInPandas(next_level, "vec long, slot int, n_bytes long, up long, to int"))
        out = out.join(moved.select("vec", "slot", "up", "to"), ["vec", "slot"]).select("_g", F.col("up").alias("vec"), F.col("to").alias("slot"))
        if above == 1:
            return rows.join(out.select("_g", F.col("slot").alias("shard")), "_g").select("doc_id", "n_bytes", "shard")
        vectors = moved.groupBy(F.col("up").alias("vec"), F.col("to").alias("slot")).agg(F.sum("n_bytes").alias("n_bytes"))
        buckets = above
