"""Schemas and vocabularies by name: a registry on the driver, and checks of what
it holds. They are a few documents; records are checked in
``rollcall.operators.validate``."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

META = "https://json-schema.org/draft/2020-12/schema"
_TYPES = {"string", "integer", "number", "boolean", "array", "object", "null"}
_COUNTS = ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties")
_SUBS = ("items", "additionalProperties", "contains", "not", "propertyNames", "if", "then", "else")
_LISTS = ("allOf", "anyOf", "oneOf", "prefixItems")
_TABLES = ("properties", "patternProperties", "$defs", "dependentSchemas")


@dataclass
class Registry:
    """Documents by (name, version), and texts of any kind by key."""

    schemas: dict[tuple[str, str], dict] = field(default_factory=dict)
    assets: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_folder(cls, root: str | Path, version: str = "1.0", glob: str = "*.json") -> Registry:
        """All JSON documents below a folder. A name is the file's, without
        suffixes like '.schema.json' and up to its last dot before; a document's
        own ``version`` wins over ``version``."""
        out = cls()
        for p in sorted(Path(root).rglob(glob)):
            text = p.read_text("utf-8")
            out.assets[p.relative_to(root).as_posix()] = text
            if text.strip():
                doc = json.loads(text)
                name = re.sub(r"(\.schema)?\.json$", "", p.name).rsplit(".", 1)[-1]
                out.schemas[name, str(doc.get("version", version))] = doc
        return out

    def get(self, name: str, version: str = "1.0") -> dict:
        if (name, version) not in self.schemas:
            there = sorted(v for n, v in self.schemas if n == name)
            raise ValueError(f"no version {version!r} of {name!r}; there are {there}" if there else f"no schema {name!r}")
        return self.schemas[name, version]

    def asset(self, key: str) -> str:
        if key not in self.assets:
            raise KeyError(f"no asset {key!r}")
        return self.assets[key]

    def names(self) -> list[tuple[str, str]]:
        return sorted(self.schemas)

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, version, document)."""
        return spark.createDataFrame([(n, v, json.dumps(d, sort_keys=True)) for (n, v), d in sorted(self.schemas.items())], "name string, version string, document string")


def schema_problems(schema: dict | bool, path: str = "#", meta: str | None = META) -> list[str]:
    """What makes a document no JSON Schema: its dialect, types, patterns,
    counts, lists and references; empty if nothing does."""
    if isinstance(schema, bool):
        return []
    if not isinstance(schema, dict):
        return [f"{path}: neither object nor boolean"]
    out = []
    if meta is not None and schema.get("$schema") != meta:
        out.append(f"{path}: $schema is {schema.get('$schema')!r}, not {meta!r}")
    kinds = schema.get("type", [])
    for k in [kinds] if isinstance(kinds, str) else kinds:
        if k not in _TYPES:
            out.append(f"{path}/type: {k!r}")
    for key in _COUNTS:
        if key in schema and (not isinstance(schema[key], int) or schema[key] < 0):
            out.append(f"{path}/{key}: not a count")
    if "pattern" in schema:
        try:
            re.compile(schema["pattern"])
        except (re.error, TypeError):
            out.append(f"{path}/pattern: no regular expression")
    for key in ("enum", "required"):
        if key in schema and not isinstance(schema[key], list):
            out.append(f"{path}/{key}: not a list")
    for key in _SUBS:
        if key in schema:
            out += schema_problems(schema[key], f"{path}/{key}", None)
    for key in _LISTS:
        parts = schema.get(key, [None])
        if not isinstance(parts, list) or not parts:
            out.append(f"{path}/{key}: not a list of schemas")
        elif key in schema:
            out += [x for i, p in enumerate(parts) for x in schema_problems(p, f"{path}/{key}/{i}", None)]
    for key in _TABLES:
        table = schema.get(key, {})
        if not isinstance(table, dict):
            out.append(f"{path}/{key}: not an object")
        else:
            out += [x for n, p in table.items() for x in schema_problems(p, f"{path}/{key}/{n}", None)]
    return out


def document_problems(doc: object, required: dict[str, type | tuple[type, ...]], each: dict[str, dict[str, type]] | None = None) -> list[str]:
    """What a vocabulary, or a vertical's description, lacks: fields of a type,
    and in its lists entries with fields of theirs."""
    if not isinstance(doc, dict):
        return ["the top level isn't an object"]
    out = [f"{k} is missing" if k not in doc else f"{k} is of a wrong type" for k, t in required.items() if not isinstance(doc.get(k), t)]
    for name, fields in (each or {}).items():
        for i, entry in enumerate(doc.get(name) or []):
            if not isinstance(entry, dict):
                out.append(f"{name}[{i}] isn't an object")
                continue
            out += [f"{name}[{i}].{k} is missing" for k, t in fields.items() if not isinstance(entry.get(k), t)]
    return out


def vocabulary_problems(doc: object) -> list[str]:
    """Of a vocabulary {id, title, version, terms: [{code, uri, parent?}]}: what is
    missing, codes that repeat, and parents that are no terms."""
    out = document_problems(doc, {"id": str, "title": str, "version": str, "terms": list}, {"terms": {"code": str, "uri": str}})
    if out:
        return out
    codes = [t["code"] for t in doc["terms"]]
    out += [f"code {c!r} repeats" for c in sorted({c for c in codes if codes.count(c) > 1})]
    return out + [f"{t['code']}: parent {t['parent']!r} is no term" for t in doc["terms"] if t.get("parent") is not None and t["parent"] not in codes]


def vertical_problems(text: str) -> list[str]:
    """Of a vertical's description, YAML or JSON text with id, name, version and
    status: what is missing or can't be read."""
    if not text.strip():
        return ["the file is empty"]
    try:
        doc = json.loads(text)
    except ValueError:
        try:
            import yaml  # optional, as above
        except ImportError:
            return ["not JSON, and no YAML parser is there"]
        try:
            doc = yaml.safe_load(text)
        except yaml.YAMLError as e:
            return [f"not YAML: {e}"]
    return document_problems(doc, {"id": str, "name": str, "version": str, "status": str})
