"""Writers: sorted JSON, JSON Lines, and the files of a collision audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.canonical import canonical_json


def json_lines(df: DataFrame) -> DataFrame:
    """One string column ``value``: JSON objects with sorted keys."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def pretty_json(df: DataFrame) -> DataFrame:
    """One string column ``value``: JSON objects with sorted keys, a line for each
    entry, indented by two."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"pretty": "true"}).alias("value"))


def trace_json(steps: Column | str) -> Column:
    """The steps of a name's normalization, array<struct<rule, before, after>>, as
    canonical JSON, whose hash audits compare."""
    x = F.col(steps) if isinstance(steps, str) else steps
    step = T.StructType([T.StructField(n, T.StringType()) for n in ("rule", "before", "after")])
    return canonical_json(x, T.ArrayType(step))


def write_jsonl(df: DataFrame, path: str, force: bool = False) -> None:
    """Refuses to overwrite unless ``force``d."""
    json_lines(df).write.mode("overwrite" if force else "errorifexists").text(path)


def collisions_csv(collisions: DataFrame) -> DataFrame:
    """normalized, count, raw_variants_joined, in order of ``normalized``."""
    return collisions.select("normalized", F.col("n").alias("count"), F.array_join("raws", " || ").alias("raw_variants_joined")).orderBy("normalized")


def write_collisions_csv(collisions: DataFrame, path: str, force: bool = True) -> None:
    collisions_csv(collisions).write.mode("overwrite" if force else "errorifexists").option("header", True).csv(path)


def mapping_rows(mapping: DataFrame, *kept: str) -> DataFrame:
    """(raw, normalized, trace_sha256): the mapping, one row a name, with the
    hash of its trace where there is one, after the columns that are ``kept``."""
    trace = F.sha2(F.col("trace").cast("binary"), 256) if "trace" in mapping.columns else F.lit(None).cast("string")
    return mapping.select(*kept, "raw", "normalized", trace.alias("trace_sha256"))


def write_summary(summary: DataFrame, path: str, force: bool = True) -> None:
    """A summary of a few rows, as JSON with sorted keys."""
    write_jsonl(summary.coalesce(1), path, force)
