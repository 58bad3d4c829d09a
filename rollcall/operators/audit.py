"""Audits of a name mapping: collisions, baselines, merges and splits.

A mapping is a DataFrame (pos, raw, normalized). Each operator is one exchange
on its key. Lists are ordered by position, so they don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.functions.normalize import normalize_legal_name


def mapping(names: DataFrame, normalized: Column | None = None) -> DataFrame:
    """(pos, raw, normalized) from (pos, raw_name), by default in core form."""
    return names.select("pos", F.col("raw_name").alias("raw"), (normalize_legal_name("raw_name") if normalized is None else normalized).alias("normalized"))


def mapping_distinct(names: DataFrame) -> DataFrame:
    """As ``mapping``, for tables in which names repeat a lot: each distinct
    name is normalized once and joined back."""
    each = names.select("raw_name").distinct().withColumn("normalized", normalize_legal_name("raw_name"))
    each = each.withColumnRenamed("raw_name", "_name")
    return names.join(each, F.col("raw_name").eqNullSafe(F.col("_name"))).select("pos", F.col("raw_name").alias("raw"), "normalized")


def collisions(m: DataFrame, least: int = 2) -> DataFrame:
    """(normalized, n, raws): normal forms that several raw names share; raws in
    order of position. Names without a form (null, or '' for those in scripts
    that the form leaves nothing of) collide with nothing."""
    g = m.where("normalized <> ''").groupBy("normalized").agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("x"))
    return g.where(F.size("x") >= least).select("normalized", F.size("x").alias("n"), F.transform("x", lambda e: e["raw"]).alias("raws"))


def inverted(m: DataFrame) -> DataFrame:
    """(normalized, raws): sorted distinct raw names of each normal form."""
    return m.groupBy("normalized").agg(F.array_sort(F.collect_set("raw")).alias("raws"))


def summary(m: DataFrame) -> DataFrame:
    """One row: raw_unique_count, normalized_unique_count,
    collision_bucket_count, raw_collided_count. Partially aggregated by normal
    form; no global distinct."""
    g = m.select("raw", "normalized").distinct().groupBy("normalized").agg(F.count("*").alias("n"))
    raws = m.select("raw").distinct().agg(F.count("*").alias("raw_unique_count"))
    many = F.when(F.col("n") > 1, F.col("n"))
    return g.agg(F.count("*").alias("normalized_unique_count"), F.count(many).alias("collision_bucket_count"), F.coalesce(F.sum(many), F.lit(0)).cast("long").alias("raw_collided_count")).crossJoin(raws)


def baseline_diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(raw, change, old, new) of names that were added, removed or changed."""
    a = current.select("raw", F.col("normalized").alias("new"), F.lit(True).alias("_c"))
    b = baseline.select("raw", F.col("normalized").alias("old"), F.lit(True).alias("_b"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_c").isNull(), "removed").when(~F.col("new").eqNullSafe(F.col("old")), "changed")
    return a.join(b, "raw", "full_outer").withColumn("change", change).where("change is not null").select("raw", "change", "old", "new")


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Raw names of one mapping that the other doesn't have."""
    return a.select("raw").join(b.select("raw"), "raw", "left_anti").distinct()


def merges(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(normalized, raws, others): current forms whose names had several forms
    in the baseline. Names that it doesn't know don't count."""
    j = current.select("raw", "normalized").join(baseline.select("raw", F.col("normalized").alias("other")), "raw").where("other is not null")
    g = j.groupBy("normalized").agg(F.array_sort(F.collect_set("other")).alias("others"), F.array_sort(F.collect_set("raw")).alias("raws"))
    return g.where(F.size("others") > 1).select("normalized", "raws", "others")


def splits(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline forms whose names have several forms now."""
    return merges(baseline, current)


def approved(found: DataFrame, approvals: DataFrame, jurisdiction: str | None = None) -> DataFrame:
    """``found`` with ``is_approved``: all raws are on the approved list of the
    normal form. ``approvals``: (normalized, raws) or, for a jurisdiction,
    (jurisdiction, normalized, raws)."""
    a = approvals.where(F.col("jurisdiction") == jurisdiction) if jurisdiction is not None else approvals
    a = a.select("normalized", F.col("raws").alias("_ok"))
    return found.join(a, "normalized", "left").withColumn("is_approved", F.coalesce(F.size(F.array_except("raws", "_ok")) == 0, F.lit(False))).drop("_ok")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; null keys count as one value."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))).where("_r = 1").drop("_r")
