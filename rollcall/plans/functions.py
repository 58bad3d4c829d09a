"""Scalar functions by name, for command lines and SQL texts; all are
expressions that the optimizer sees through."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import canonical, dates, identity, localize, normalize
from rollcall.operators import records


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed, and written, once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _detailed(c: list[Column]) -> Column:
    return _let(_let(identity.canonical_input(c[0], c[1], c[2], c[3]), lambda x: identity.rated(x, c[4], c[5])), identity.detailed_json)


#: Arguments, how many of them are needed, and the expression.
_FUNCTIONS: dict[str, tuple[tuple[str, ...], int, Callable[[list[Column]], Column]]] = {
    "normalize_legal_name": (("name",), 1, lambda c: normalize.normalize_legal_name(c[0])),
    "normalize_address": (("address",), 1, lambda c: normalize.normalize_address(c[0])),
    "normalize_registration_date": (("d",), 1, lambda c: dates.registration_date(c[0])),
    "entity_hash": (("name", "country", "address", "d"), 2, lambda c: identity.entity_hash(*c)),
    "entity_hash_detailed": (("name", "country", "address", "d", "lei", "uei"), 2, _detailed),
    "apply_localization_name": (("name", "jurisdiction"), 2, lambda c: localize.localized_by(*c)),
    "apply_localization_name_detailed": (("name", "jurisdiction"), 2, lambda c: localize.detailed_json(*c)),
    "build_entity": (("payload",), 1, lambda c: records.entity_json(c[0])),
    "build_relationship": (("payload",), 1, lambda c: records.attested_json(c[0])),
    "build_exchange": (("payload",), 1, lambda c: records.attested_json(c[0])),
    "build_context_tag": (("payload",), 1, lambda c: records.attested_json(c[0])),
    "hash_text": (("x",), 1, lambda c: canonical.hash_text(c[0])),
    "slug": (("x",), 1, lambda c: normalize.slug(c[0])),
}


def names() -> list[str]:
    return sorted(_FUNCTIONS)


def apply(df: DataFrame, function: str, *columns: str, out: str | None = None) -> DataFrame:
    """``df`` with a scalar function of columns, by its SQL name."""
    return df.withColumn(out or function, _FUNCTIONS[function][2]([F.col(c) for c in columns]))


#: Functions that are written as operators, where they are called by name.
_OPERATOR = re.compile(r"(?<![\w`)'])(>=|<=>|<=|<>|!=|==|=|<|>|\+|-|\*|/|%|&|\||and|or|not)\(")


def sql_text(x: Column) -> str:
    """An expression as text that the SQL parser reads."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", x._jc.node().sql())
    return "".join(p if i % 2 else _OPERATOR.sub(r"`\1`(", p) for i, p in enumerate(parts))


def register(spark: SparkSession, only: Iterable[str] | None = None, prefix: str = "") -> list[str]:
    """Make all functions, or some, callable from SQL texts in this session, as temporary
    SQL functions; arguments that aren't needed may be left out. Their bodies
    are inlined when a query is analyzed, so no Python runs."""
    chosen = names() if only is None else list(only)
    for name in chosen:
        arguments, needed, body = _FUNCTIONS[name]
        given = ", ".join(f"{a} STRING" + ("" if i < needed else " DEFAULT NULL") for i, a in enumerate(arguments))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS STRING RETURN {sql_text(body([F.col(a) for a in arguments]))}")
    return [prefix + n for n in chosen]
