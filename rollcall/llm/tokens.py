"""The unit of lengths: words between white space, counted by the JVM, in a way
that SQL engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = "[^ \\t\\n\\r\\f]+"


def n_tokens(text: str = "text") -> Column:
    """Tokens of a text; a null text has 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(PATTERN)), F.lit(0)).cast("long")


SQL = "coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::BIGINT"
