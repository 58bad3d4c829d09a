"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule has the point frac(i * golden ratio), in 32-bit integer
arithmetic. The points run through the cumulative weights of the sources, so
every stretch of the schedule has each source nearly in proportion (points
repeat after 2^32 slots, as do their sources). The r-th
slot of a source takes the r-th block of it: the documents of a source are
shuffled by a hash and cut into blocks of ``block_tokens`` tokens, a document
belonging to the block in which it starts.

A source's slots and a source's documents are ranked in two steps, within a
chunk and over the chunks before it, so a hot source isn't sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.llm import tokens
from rollcall.session import checkpointed

BLOCK_TOKENS = 2048
#: floor(2^32 / golden ratio), an odd number.
GOLDEN = 2654435769
SCALE = 1 << 20
#: Blocks by which a source's slots may lag behind its share: beyond the
#: discrepancy of the golden ratio's points for any number of slots there can be.
SLACK = 40
CELLS = 4096
CHUNK = 1 << 16


def _weights(spark: SparkSession, sums: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """source, q (whole-number weight), low and high (cumulative), total."""
    if weights is None:
        w = sums.withColumn("w", F.floor(F.sqrt("tokens")))
        w = w.crossJoin(w.agg(F.sum("w").alias("s")))
        w = w.withColumn("q", F.greatest(F.lit(1), F.expr("w * 1048576 div s")).cast("long"))
    else:
        whole = sum(weights.values())
        given = spark.createDataFrame([(k, max(1, round(v * SCALE / whole))) for k, v in weights.items() if v > 0], "source string, q long")
        w = sums.join(given, "source")
    w = w.crossJoin(w.agg(F.sum("q").alias("total")))
    return w.withColumn("high", F.sum("q").over(W.orderBy("source"))).withColumn("low", F.col("high") - F.col("q"))


def blocks(docs: DataFrame, block_tokens: int, seed: int) -> DataFrame:
    """doc_id, source, tokens, and the block of each document."""
    d = docs.select(
        F.col("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("source"), tokens.n_tokens().alias("tokens"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("k"),
    ).withColumn("cell", F.substring("k", 1, 3))
    d = checkpointed(d)
    before = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = d.groupBy("source", "cell").agg(F.sum("tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = W.partitionBy("source", "cell").orderBy("k", "doc_id", "tokens").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return d.join(cells, ["source", "cell"]).select("doc_id", "source", "tokens", F.expr(f"(before + inside) div {block_tokens}").alias("block"), F.col("k"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, epochs: int | None = 1, seed: int = 0) -> DataFrame:
    """The schedule (slot, epoch, doc_id, source, tokens), a row per document
    and time that it is used.

    ``weights`` are the sources' target shares of the tokens; by default they
    are in proportion to the square root of the tokens, which lifts small
    sources. A source that isn't named isn't used. The schedule is the longest
    one in which no source must be used more than ``epochs`` times; what is left
    of the other sources isn't used. A null source counts as the empty one, a
    null text as one without tokens. A document without tokens goes with its
    block. Repeated rows count as often as they are there. An empty table, or
    one without tokens, gives an empty schedule.
    """
    d = checkpointed(blocks(docs, block_tokens, seed))
    return _schedule(d, _sources(d, weights), epochs)


def _sources(d: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """The sources that are used, with their numbers of blocks and weights."""
    sums = d.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("block") + 1).alias("blocks")).where("tokens > 0")
    return checkpointed(_weights(d.sparkSession, sums, weights))


def _schedule(d: DataFrame, sources: DataFrame, epochs: int | None) -> DataFrame:
    spark = d.sparkSession
    length = F.min(F.expr(f"blocks * {epochs} * total div q")) if epochs is not None else F.max(F.expr(f"(blocks + {SLACK}) * total div q + 1"))
    slots = sources.agg(length.alias("n")).first()["n"] or 0
    cell = (1 << 32) // CELLS
    # Each cell of the points knows the sources in it: an equi-join finds them.
    covers = sources.select(
        "source", "low", "high", "total", "blocks",
        F.explode(F.sequence(F.expr(f"(low * 4294967296 div total) div {cell}"), F.expr(f"least({CELLS - 1}, (high * 4294967296 div total) div {cell})"))).alias("c"),
    )
    point = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"pmod((id % 4294967296L) * {GOLDEN - (1 << 32)}L, 4294967296L)").alias("p"))
    hit = (
        point.withColumn("c", F.expr(f"p div {cell}")).join(covers, "c")
        .where((F.col("p") * F.col("total") >= F.col("low") * (1 << 32)) & (F.col("p") * F.col("total") < F.col("high") * (1 << 32)))
        .select("slot", "source", "blocks", F.expr(f"slot div {CHUNK}").alias("chunk"))
    )
    hit = checkpointed(hit)
    chunks = hit.groupBy("source", "chunk").count()
    chunks = chunks.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = hit.withColumn("r", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1).join(chunks, ["source", "chunk"]).withColumn("r", F.col("r") + F.col("before"))
    if epochs is None:
        # It ends with the slot at which the last source gets its last block.
        ranked = checkpointed(ranked)
        ranked = ranked.where(F.col("slot") <= (ranked.where("r = blocks - 1").agg(F.max("slot")).first()[0] or 0))
    ranked = ranked.select("slot", "source", F.expr("r div blocks").cast("int").alias("epoch"), F.expr("r % blocks").alias("block"))
    return d.join(ranked, ["source", "block"]).select("slot", "epoch", "doc_id", "source", "tokens")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without those that the schedule leaves out, in its order; each
    document once, at its first slot."""
    when = mix(docs, **options).groupBy("doc_id").agg(F.min("slot").alias("_slot"))
    return docs.join(when, docs["doc_id"].eqNullSafe(when["doc_id"])).select(*[docs[c] for c in docs.columns], "_slot").orderBy("_slot", "doc_id").drop("_slot")


def mixed_whole(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """All of ``docs``, in the order of a schedule that goes on until every
    source is used once.

    The schedule of ``mix`` comes first. When its first source is used up, the
    others go on in proportion to their weights: the block r of a source with
    the weight q is due at r / q, so no source waits for another to end.
    Documents of sources without tokens come last. Rows that repeat a doc_id are
    told apart by their texts, so the order is the same each time.
    """
    d = checkpointed(blocks(docs, block_tokens, seed))
    sources = _sources(d, None)
    first = _schedule(d, sources, 1).groupBy("doc_id").agg(F.min("slot").alias("_slot"))
    due = d.join(F.broadcast(sources.select("source", "q", "total")), "source", "left").groupBy("doc_id").agg(F.min(F.expr("block * total div q")).alias("_due"))
    when = due.join(first.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "_slot", "_due")
    out = docs.join(when, docs["doc_id"].eqNullSafe(when["doc_id"])).select(*[docs[c] for c in docs.columns], "_slot", "_due")
    return out.orderBy(F.asc_nulls_last("_slot"), F.asc_nulls_last("_due"), "doc_id", F.xxhash64("text")).drop("_slot", "_due")


def mix_sql(block_tokens: int = BLOCK_TOKENS, seed: int = 0, whole: bool = False) -> str:
    """``mix`` with one epoch or, if ``whole``, with ``epochs=None``."""
    length = f"max((blocks + {SLACK}) * total // q + 1)" if whole else "min(blocks * total // q)"
    last = "WHERE h.slot <= (SELECT max(slot) FROM hit WHERE r = blocks - 1)" if whole else ""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, {tokens.SQL} AS tokens, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents
), placed AS (
  SELECT *, (coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY k, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) // {block_tokens} AS block FROM d
), sums AS (
  SELECT source, sum(tokens)::BIGINT AS tokens, max(block) + 1 AS blocks, floor(sqrt(sum(tokens)))::BIGINT AS w FROM placed GROUP BY source HAVING sum(tokens) > 0
), q AS (
  SELECT *, greatest(1, w * {SCALE} // (SELECT sum(w)::BIGINT FROM sums)) AS q FROM sums
), cum AS (
  SELECT *, sum(q) OVER (ORDER BY source)::BIGINT AS high, (SELECT sum(q)::BIGINT FROM q) AS total FROM q
), n AS (
  SELECT coalesce({length}, 0)::BIGINT AS n FROM cum
), slots AS (
  SELECT i AS slot, ((i % 4294967296)::HUGEINT * {GOLDEN}) % 4294967296 AS p FROM (SELECT unnest(range(n)) AS i FROM n)
), hit AS (
  SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS r
  FROM slots JOIN cum ON p * total >= (high - q) * 4294967296 AND p * total < high * 4294967296
)
SELECT h.slot, (h.r // h.blocks)::INT AS epoch, p.doc_id, p.source, p.tokens
FROM hit h JOIN placed p ON p.source = h.source AND p.block = h.r % h.blocks {last}"""
