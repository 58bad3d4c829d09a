"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.fingerprints import fingerprints
from rollcall.llm.jaccard import jaccard_join, jaccard_sql
from rollcall.llm.langid import identify
from rollcall.llm.mixing import mix, mix_sql
from rollcall.llm.packing import pack, pack_sql
from rollcall.llm.repetition import repetition_rules
from rollcall.llm.sharding import shard
from rollcall.llm.styletree import extract
from rollcall.llm.toxicity import toxicity
from rollcall.llm.warc import reassemble, segmented
from rollcall.session import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document; copies of a text stay together."""
    return shard(table(spark, sf_dir, "documents"))


def op2_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repetition measures and the decision."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition_rules(docs).drop("text")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints(docs).drop("text")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group and the number of its links."""
    return jaccard_join(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule in which every document comes, small sources several times."""
    return mix(table(spark, sf_dir, "documents"), epochs=None)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text without the noise of its site."""
    return extract(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, stored as segmented, chunked WARC records and put together
    again: the round trip must give back the table."""
    whole = reassemble(segmented(table(spark, sf_dir, "pages")))
    return whole.select(F.substring_index("record_id", ":", -1).cast("long").alias("page_id"), F.col("target_uri").alias("url"), F.col("body").cast("string").alias("html"), "status")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).drop("text", "lang")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_sharding, op2_repetition_rules, op3_fingerprints, op4_jaccard_join, op5_mixing, op6_packing, op7_style_tree, op8_warc, op9_language, op10_toxicity)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; the others have brute-force tests."""
    return {
        "op4_jaccard_join": jaccard_sql(),
        "op5_mixing": mix_sql(whole=True),
        "op6_packing": pack_sql(),
        "op8_warc": "SELECT page_id, url, html, 'complete' AS status FROM pages",
    }
