"""Harmonic packing of documents into sequences of a fixed number of tokens.

A length x over capacity / (k + 1) and up to capacity / k is of class k: any k
such documents fit into a bin, so a class's bins are filled by count, without
regard to the others. Each worker (documents dealt by a hash, or stretches of them
in their order) fills bins of its own and leaves at most one unfilled bin a class. From class 16 on only 16, 24,
32, 48, 64, 96 ... are used, the next lower one each; so a worker has few
classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.llm import tokens
from rollcall.session import checkpointed

CAPACITY = 2048
PER_WORKER = 8192


def classes(capacity: int) -> list[int]:
    """Numbers of documents in a bin, in order."""
    out = list(range(1, 16))
    x = 16
    while x <= capacity:
        out += [x, x + x // 2]
        x *= 2
    return [k for k in out if k <= capacity]


def _class_sql(capacity: int, length: str = "n") -> str:
    """The class of a length, as SQL for either engine."""
    used = [k for k in classes(capacity) if k > 1]
    return "CASE " + " ".join(f"WHEN {length} <= {capacity // k} THEN {k}" for k in reversed(used)) + " ELSE 1 END" if used else "1"


def _places(docs: DataFrame) -> list:
    """part and row: where each row is in the order of ``docs``. Of a table just
    read, that is the order in which its files were written; its tasks read them
    in another one."""
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in docs.columns:
        at = docs.metadataColumn("_metadata")
        return [at["file_path"].alias("part"), at["row_index"].alias("row")]
    i = F.monotonically_increasing_id()
    return [F.lpad(F.shiftright(i, 33).cast("string"), 10, "0").alias("part"), i.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")]


def _stretches(docs: DataFrame, per_worker: int) -> DataFrame:
    """doc_id, len and worker: stretches of ``per_worker`` rows, in their order."""
    d = checkpointed(docs.select("doc_id", tokens.n_tokens().alias("len"), *_places(docs)))
    before = F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = d.groupBy("part").agg(F.count("*").alias("rows")).select("part", before.alias("before"))
    return d.join(F.broadcast(parts), "part").select("doc_id", "len", F.expr(f"(before + row) div {per_worker}").cast("int").alias("worker"))


def pack(docs: DataFrame, capacity: int = CAPACITY, per_worker: int = PER_WORKER, in_order: bool = False) -> DataFrame:
    """A row per segment: doc_id, segment, start, n_tokens, class, worker,
    bin_id and bin_offset (tokens of the bin before it).

    A document of over ``capacity`` tokens is cut into full segments, each a bin
    of class 1, and a rest that is packed like a document; so whole texts are
    packed. A null text, or one without tokens, has no segment. Repeated rows are
    packed as often as they are there, and null identifiers like others. An empty
    table gives no row. Further columns are ignored.

    With ``in_order``, the workers are stretches of ``per_worker`` rows in the order
    of ``docs``, so bins taken worker by worker follow it.
    """
    if in_order:
        d = _stretches(docs, per_worker)
    else:
        n = docs.count()
        workers = max(1, -(-n // per_worker))
        key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        d = docs.select("doc_id", tokens.n_tokens().alias("len"), (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % workers).cast("int").alias("worker"))
    d = d.where("len > 0")
    s = d.withColumn("segment", F.explode(F.expr(f"sequence(0, cast((len - 1) div {capacity} as int))")))
    s = s.withColumn("start", F.col("segment").cast("long") * capacity).withColumn("n", F.least(F.lit(capacity).cast("long"), F.col("len") - F.col("start")))
    s = s.withColumn("class", F.expr(_class_sql(capacity)))
    order = [F.desc("n"), "doc_id", "segment"]
    rank = F.row_number().over(W.partitionBy("worker", "class").orderBy(*order)) - 1
    s = s.withColumn("r", rank).withColumn("bin", F.expr("r div class"))
    before = W.partitionBy("worker", "class", "bin").orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    return s.select(
        "doc_id", "segment", "start", F.col("n").alias("n_tokens"), "class", "worker",
        F.concat_ws("-", "worker", "class", "bin").alias("bin_id"), F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("bin_offset"),
    )


def pack_sql(capacity: int = CAPACITY, per_worker: int = PER_WORKER) -> str:
    return f"""
WITH w AS (SELECT greatest(1, (count(*) + {per_worker - 1}) // {per_worker}) AS workers FROM documents),
d AS (
  SELECT doc_id, {tokens.SQL} AS len, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % workers)::INT AS worker FROM documents, w
), s AS (
  SELECT doc_id, len, worker, unnest(range((len - 1) // {capacity} + 1))::INT AS segment FROM d WHERE len > 0
), l AS (
  SELECT *, segment::BIGINT * {capacity} AS start, least({capacity}, len - segment::BIGINT * {capacity})::BIGINT AS n FROM s
), c AS (SELECT *, ({_class_sql(capacity)})::INT AS class FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY worker, class ORDER BY n DESC, doc_id NULLS FIRST, segment) - 1 AS r FROM c),
b AS (SELECT *, r // class AS bin FROM r)
SELECT doc_id, segment, start, n AS n_tokens, class, worker, worker || '-' || class || '-' || bin AS bin_id,
  coalesce(sum(n) OVER (PARTITION BY worker, class, bin ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bin_offset
FROM b"""
