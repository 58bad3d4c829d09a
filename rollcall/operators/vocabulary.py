"""Vocabularies: terms with parents, as tables and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.session import build_side


def ancestors(terms: DataFrame, key: str = "key", parent: str = "parent", max_depth: int = 50) -> DataFrame:
    """(key, ancestor, depth), depth 0 being the term itself. One recursive query."""
    t = terms.select(F.col(key).alias("k"), F.col(parent).alias("p"))
    return terms.sparkSession.sql(f"""
        WITH RECURSIVE up(key, ancestor, depth) AS (
          SELECT k, k, 0 FROM {{t}}
          UNION ALL
          SELECT up.key, t.p, up.depth + 1 FROM up JOIN {{t}} t ON t.k = up.ancestor WHERE t.p IS NOT NULL AND up.depth < {max_depth}
        ) SELECT * FROM up""", t=t)


def unknown_terms(df: DataFrame, column: str, terms: DataFrame, term: str = "term_uri") -> DataFrame:
    """Rows whose term isn't in the vocabulary."""
    return df.where(F.col(column).isNotNull()).join(build_side(terms.select(F.col(term).alias(column)).distinct()), column, "left_anti")
