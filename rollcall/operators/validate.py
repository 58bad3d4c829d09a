"""Validation as columns: checks derived from a schema, and constraints over
whole tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.session import checkpointed


@dataclass(frozen=True)
class Check:
    """A rule on one path: required, type, enum, pattern, least, most, items."""

    path: str
    rule: str
    value: object = None

    def fails(self) -> Column:
        c = F.col(self.path)
        if self.rule == "required":
            return c.isNull()
        if self.rule == "enum":
            return ~c.isin(list(self.value))
        if self.rule == "pattern":
            return ~c.rlike(self.value)
        if self.rule == "least":
            return c < F.lit(self.value)
        if self.rule == "most":
            return c > F.lit(self.value)
        if self.rule == "items":
            return F.size(c) < self.value
        if self.rule == "type":
            return c.isNotNull() & c.try_cast(self.value).isNull()
        raise ValueError(f"no rule {self.rule!r}")

    def message(self) -> str:
        return f"{self.path}: {self.rule}" + ("" if self.value is None else f" {self.value}")


def from_json_schema(schema: dict, definitions: dict | None = None, prefix: str = "") -> list[Check]:
    """Checks of a JSON Schema: type, required, enum, const, pattern, minimum,
    maximum, minItems, nested properties, local references and ``allOf``."""
    defs = definitions if definitions is not None else schema.get("$defs", {})
    out: list[Check] = []
    for part in schema.get("allOf", []):
        out += from_json_schema(_resolve(part, defs), defs, prefix)
    out += [Check(prefix + n, "required") for n in schema.get("required", [])]
    kinds = {"integer": "bigint", "number": "double", "boolean": "boolean"}
    for name, p in schema.get("properties", {}).items():
        p, path = _resolve(p, defs), prefix + name
        kind = p.get("type")
        kind = next((k for k in kind if k != "null"), None) if isinstance(kind, list) else kind
        if kind in kinds:
            out.append(Check(path, "type", kinds[kind]))
        if "const" in p:
            out.append(Check(path, "enum", (p["const"],)))
        if "enum" in p:
            out.append(Check(path, "enum", tuple(x for x in p["enum"] if x is not None)))
        for key, rule in (("pattern", "pattern"), ("minimum", "least"), ("maximum", "most"), ("minItems", "items")):
            if key in p:
                out.append(Check(path, rule, p[key]))
        if kind == "object" and "properties" in p:
            out += from_json_schema(p, defs, path + ".")
    return out


def _resolve(p: dict, defs: dict) -> dict:
    ref = p.get("$ref")
    return defs[ref.rsplit("/", 1)[-1]] if ref else p


def errors(checks: Sequence[Check]) -> Column:
    """array<struct<path, rule, message>> of the checks that fail; a null that
    isn't required fails nothing."""
    kind = "array<struct<path:string,rule:string,message:string>>"
    each = [F.when(F.coalesce(c.fails(), F.lit(False)), F.struct(F.lit(c.path).alias("path"), F.lit(c.rule).alias("rule"), F.lit(c.message()).alias("message"))) for c in checks]
    return F.array_compact(F.array(*each)) if each else F.expr(f"cast(array() as {kind})")


# --- Whole schemas over nested columns -------------------------------------------

ERROR = "struct<path:string,rule:string,message:string>"
_NONE = f"cast(array() as array<{ERROR}>)"
#: Formats of texts, as patterns.
FORMATS = {
    "date": "^\\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\\d|3[01])$", "date-time": "^\\d{4}-\\d{2}-\\d{2}[Tt]\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?([Zz]|[+-]\\d{2}:\\d{2})$", "time": "^\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?([Zz]|[+-]\\d{2}:\\d{2})$",
    "uri": "^[A-Za-z][A-Za-z0-9+.-]*:[^\\s]*$", "uri-reference": "^[^\\s]*$", "email": "^[^@\\s]+@[^@\\s]+$", "uuid": "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", "hostname": "^[A-Za-z0-9]([A-Za-z0-9.-]*[A-Za-z0-9])?$", "ipv4": "^((25[0-5]|2[0-4]\\d|1?\\d?\\d)(\\.|$)){4}",
}
_KINDS = {"string": T.StringType, "integer": T.IntegralType, "number": T.NumericType, "boolean": T.BooleanType, "array": T.ArrayType, "object": (T.StructType, T.MapType)}


def violations(x: Column, kind: T.DataType, schema: dict | bool, path: str = "", root: dict | None = None) -> Column:
    """array<struct<path, rule, message>>: where a value of a nested type breaks a
    JSON Schema. Items of arrays have the path of the array and '[]'.

    Keywords: type, enum, const, minLength, maxLength, pattern, format, minimum,
    maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minItems, maxItems,
    uniqueItems, items, contains, required, properties, patternProperties,
    additionalProperties, propertyNames, minProperties, maxProperties, allOf, anyOf,
    oneOf, not, and local references. A null is a value that isn't there. Texts
    are read as numbers or booleans where the schema asks for these.
    """
    root = schema if root is None and isinstance(schema, dict) else root
    if isinstance(schema, bool):
        return F.expr(_NONE) if schema else F.when(x.isNotNull(), F.array(_error(path, "false", "nothing may be here"))).otherwise(F.expr(_NONE))
    if "$ref" in schema:
        schema = _at(root, schema["$ref"]) | {k: v for k, v in schema.items() if k != "$ref"}
    out: list[Column] = []

    def fail(rule: str, bad: Column, message: str) -> None:
        out.append(F.when(F.coalesce(bad, F.lit(False)), F.array(_error(path, rule, message))).otherwise(F.expr(_NONE)))

    allowed = schema.get("type")
    allowed = [allowed] if isinstance(allowed, str) else allowed
    number = x
    if allowed and not any(isinstance(kind, _KINDS[k]) for k in allowed if k in _KINDS):
        cast = next((c for k, c in (("integer", "bigint"), ("number", "double"), ("boolean", "boolean")) if k in allowed), None)
        if isinstance(kind, T.StringType) and cast:
            number = x.try_cast(cast)
            fail("type", x.isNotNull() & number.isNull(), f"not of type {', '.join(allowed)}")
        elif isinstance(kind, T.NumericType) and "integer" in allowed:
            fail("type", x != F.floor(x), "not of type integer")
        else:
            fail("type", x.isNotNull(), f"not of type {', '.join(allowed)}")
    if "enum" in schema:
        fail("enum", ~x.isin([v for v in schema["enum"] if v is not None]), f"not one of {schema['enum']}")
    if "const" in schema:
        fail("const", x != F.lit(schema["const"]), f"not {schema['const']!r}")
    if isinstance(kind, T.StringType):
        if "minLength" in schema:
            fail("minLength", F.length(x) < schema["minLength"], f"shorter than {schema['minLength']}")
        if "maxLength" in schema:
            fail("maxLength", F.length(x) > schema["maxLength"], f"longer than {schema['maxLength']}")
        if "pattern" in schema:
            fail("pattern", ~x.rlike(schema["pattern"]), f"doesn't match {schema['pattern']}")
        if schema.get("format") in FORMATS:
            good = x.rlike(FORMATS[schema["format"]])
            if schema["format"] in ("date", "date-time"):
                good = good & F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd").isNotNull()
            fail("format", ~good, f"not of format {schema['format']}")
    if isinstance(kind, T.NumericType) or number is not x:
        for key, bad in (("minimum", lambda v: number < v), ("maximum", lambda v: number > v), ("exclusiveMinimum", lambda v: number <= v), ("exclusiveMaximum", lambda v: number >= v), ("multipleOf", lambda v: F.abs(number / v - F.round(number / v)) > 1e-9)):
            if key in schema:
                fail(key, bad(F.lit(schema[key])), f"{key} {schema[key]}")
    if isinstance(kind, T.ArrayType):
        inner = lambda s: F.transform(x, lambda v: violations(v, kind.elementType, s, path + "[]", root))
        if "minItems" in schema:
            fail("minItems", F.size(x) < schema["minItems"], f"fewer than {schema['minItems']} items")
        if "maxItems" in schema:
            fail("maxItems", F.size(x) > schema["maxItems"], f"more than {schema['maxItems']} items")
        if schema.get("uniqueItems"):
            fail("uniqueItems", F.size(F.array_distinct(x)) < F.size(x), "equal items")
        if "items" in schema:
            out.append(F.flatten(inner(schema["items"])))
        if "contains" in schema:
            fail("contains", ~F.exists(inner(schema["contains"]), lambda e: F.size(e) == 0), "no item as it must contain")
    if isinstance(kind, T.StructType):
        known = schema.get("properties", {})
        fields = {f.name: f.dataType for f in kind.fields}
        there = lambda n: x.getField(n).isNotNull() if n in fields else F.lit(False)
        for n in schema.get("required", []):
            fail("required", x.isNotNull() & ~there(n), f"{n} is missing")
        for n, sub in known.items():
            if n in fields:
                out.append(violations(x.getField(n), fields[n], sub, f"{path}.{n}" if path else n, root))
        patterns = schema.get("patternProperties", {})
        for n, t in fields.items():
            own = [sub for p, sub in patterns.items() if re.search(p, n)]
            if n not in known and not own and "additionalProperties" in schema:
                own = [schema["additionalProperties"]]
                if own == [False]:
                    fail("additionalProperties", there(n), f"{n} isn't a property")
                    continue
            if "propertyNames" in schema and not re.search(schema["propertyNames"].get("pattern", ""), n):
                fail("propertyNames", there(n), f"{n} isn't a name of a property")
            for sub in own:
                out.append(violations(x.getField(n), t, sub, f"{path}.{n}" if path else n, root))
        count = sum((there(n).cast("int") for n in fields), F.lit(0))
        _counted(fail, schema, F.when(x.isNotNull(), count))
    if isinstance(kind, T.MapType):
        known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        for n in schema.get("required", []):
            fail("required", ~F.map_contains_key(x, n), f"{n} is missing")
        for n, sub in known.items():
            out.append(violations(F.try_element_at(x, F.lit(n)), kind.valueType, sub, f"{path}.{n}" if path else n, root))
        other = lambda k: ~k.isin(list(known)) if known else F.lit(True)
        for p, sub in patterns.items():
            out.append(F.flatten(F.transform(F.filter(F.map_entries(x), lambda e: e["key"].rlike(p)), lambda e: violations(e["value"], kind.valueType, sub, path + "{}", root))))
        if "additionalProperties" in schema:
            rest = F.filter(F.map_entries(x), lambda e: other(e["key"]) & ~(e["key"].rlike("|".join(f"({p})" for p in patterns)) if patterns else F.lit(False)))
            out.append(F.flatten(F.transform(rest, lambda e: violations(e["value"], kind.valueType, schema["additionalProperties"], path + "{}", root))))
        if "propertyNames" in schema:
            fail("propertyNames", F.exists(F.map_keys(x), lambda k: F.size(violations(k, T.StringType(), schema["propertyNames"], path, root)) > 0), "a key isn't a name of a property")
        _counted(fail, schema, F.size(x))
    for part in schema.get("allOf", []):
        out.append(violations(x, kind, part, path, root))
    passed = lambda parts: sum(((F.size(violations(x, kind, p, path, root)) == 0).cast("int") for p in parts), F.lit(0))
    if "anyOf" in schema:
        fail("anyOf", x.isNotNull() & (passed(schema["anyOf"]) == 0), "none of the alternatives holds")
    if "oneOf" in schema:
        fail("oneOf", x.isNotNull() & (passed(schema["oneOf"]) != 1), "not exactly one of the alternatives holds")
    if "not" in schema:
        fail("not", x.isNotNull() & (passed([schema["not"]]) == 1), "what must not hold does")
    return F.concat(*[F.coalesce(o, F.expr(_NONE)) for o in out]) if out else F.expr(_NONE)


def _error(path: str, rule: str, message: str) -> Column:
    return F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"), F.lit(message).alias("message"))


def _counted(fail, schema: dict, n: Column) -> None:
    for key, bad in (("minProperties", lambda v: n < v), ("maxProperties", lambda v: n > v)):
        if key in schema:
            fail(key, bad(F.lit(schema[key])), f"{key} {schema[key]}")


def _at(root: dict | None, ref: str) -> dict:
    """What a local reference ('#/$defs/x') points to."""
    if not ref.startswith("#"):
        raise ValueError(f"not a local reference: {ref}")
    here = root or {}
    for part in ref[1:].strip("/").split("/"):
        if part:
            here = here[part.replace("~1", "/").replace("~0", "~")]
    return here


def with_violations(df: DataFrame, schema: dict, out: str = "errors") -> DataFrame:
    """``df`` with the errors of each row as an object."""
    return df.withColumn(out, violations(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema, schema))


def json_places(content: Column | str) -> Column:
    """(line, column) behind the last character of a text, where a parser that
    found it unfinished stands; for texts that are no JSON."""
    x = F.col(content) if isinstance(content, str) else content
    lines = F.split(x, "\n")
    return F.struct(F.size(lines).alias("line"), (F.length(F.element_at(lines, -1)) + 1).alias("column"))


def exactly_one(*columns: str) -> Column:
    """A message unless exactly one is there (two-party or many-party)."""
    n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(n != 1, F.lit(f"exactly one of {', '.join(columns)}"))


def summary(df: DataFrame, errors_column: str = "errors") -> DataFrame:
    """(n_records, n_errors, ok); an empty table is ok."""
    n = F.size(errors_column)
    return df.agg(F.count("*").alias("n_records"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n_errors"), F.coalesce(F.bool_and(n == 0), F.lit(True)).alias("ok"))


def json_errors(lines: DataFrame, checks: Sequence[Check], schema: str, content: str = "value") -> DataFrame:
    """``lines`` with ``errors`` of JSON texts; one that can't be parsed has the
    one error of rule 'json'."""
    parsed = lines.withColumn("_r", F.from_json(content, schema))
    inner = parsed.select("*", "_r.*") if not set(lines.columns) & {f.name for f in parsed.schema["_r"].dataType.fields} else parsed.select("_r.*", *lines.columns)
    bad = F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("rule"), F.lit("not JSON").alias("message")))
    return inner.select(*lines.columns, F.when(F.try_parse_json(content).isNull(), bad).otherwise(errors(checks)).alias("errors"))


# --- Constraints over tables -----------------------------------------------


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def cardinality(df: DataFrame, key: str, most: int) -> DataFrame:
    """Keys with over ``most`` rows (1: one to one)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)


def orphans(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key isn't null and isn't in the other table."""
    return df.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def symmetric_pairs(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Pairs that an antisymmetric relation has both ways, and loops."""
    src, dst = F.col(a), F.col(b)
    ways = F.when(src <= dst, 1).otherwise(0) + F.when(src >= dst, 2).otherwise(0)
    e = edges.where(src.isNotNull() & dst.isNotNull()).select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), ways.alias("ways"))
    return e.groupBy("src", "dst").agg(F.bit_or("ways").alias("ways")).where("ways = 3").select("src", "dst")


def not_monotonic(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose times, in this order, go backwards; nulls are passed over."""
    bad = F.lit(False)
    for i, x in enumerate(columns):
        for y in columns[i + 1 :]:
            bad = bad | F.coalesce(F.col(x) > F.col(y), F.lit(False))
    return df.where(bad)


def on_cycles(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Nodes that are left when nodes without incoming or without outgoing edges
    are taken away again and again: those on cycles, and between them. Every
    round is checkpointed."""
    e = checkpointed(edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src is not null and dst is not null").distinct())
    n = e.count()
    while True:
        left = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = checkpointed(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = left.count()
        if m == n:
            return e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
        e, n = left, m
