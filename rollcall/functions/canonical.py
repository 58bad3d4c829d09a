"""Canonical strings, canonical JSON and amounts, built from expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.fold import nfc
from rollcall.functions.normalize import col


def hash_text(x: Column | str) -> Column:
    """SHA-256 of the UTF-8 bytes, as lower-case hex."""
    return F.sha2(col(x).cast("binary"), 256)


def valid_hash(x: Column | str) -> Column:
    """64 hex digits in lower case; null for anything else."""
    h = F.lower(col(x))
    return F.when(h.rlike("^[0-9a-f]{64}$"), h)


def base64url(hex_hash: Column | str) -> Column:
    """The bytes of a hex string in the URL alphabet, without padding."""
    return F.translate(F.rtrim(F.base64(F.unhex(col(hex_hash))), F.lit("=")), "+/", "-_")


def format_amount(x: Column | str) -> Column:
    """Two decimals, halves rounded away from zero, in decimal arithmetic; null
    for what isn't a number, or has over 36 digits before the point."""
    t = col(x).cast("string")
    return F.coalesce(t.try_cast("decimal(38,18)").try_cast("decimal(38,2)"), t.try_cast("decimal(38,2)")).cast("string")


def canonical_string(**fields: Column | str) -> Column:
    """``"key":"value"`` sorted by key, with commas; null and '' are left out and
    nothing is escaped."""
    parts = [F.when(col(v).cast("string") != "", F.concat(F.lit(f'"{k}":"'), col(v).cast("string"), F.lit('"'))) for k, v in sorted(fields.items())]
    return F.concat_ws(",", *parts)


def ordered_fields(*fields: Column | str) -> Column:
    """Values in their order with pipes; null and '' are left out."""
    return F.concat_ws("|", *[F.nullif(col(f).cast("string"), F.lit("")) for f in fields])


def json_quote(x: Column | str, ascii_only: bool = False) -> Column:
    """A JSON string; ``ascii_only`` writes other characters as \\uXXXX, with
    surrogate pairs."""
    q = F.when(col(x).isNotNull(), F.to_json(F.array(col(x))))
    q = F.regexp_replace(q, "^\\[|\\]$", "")
    if not ascii_only:
        return q

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        four = lambda v: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(v)), 4, "0"))
        above = code - 0x10000
        pair = F.concat(four(F.lit(0xD800) + F.shiftright(above, 10)), four(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))))
        return F.when(code < 128, c).when(code < 0x10000, four(code)).otherwise(pair)

    return F.when(q.rlike("[^\\x00-\\x7F]"), F.array_join(F.transform(F.split(q, ""), escaped), "")).otherwise(q)


def plain_number(x: Column) -> Column:
    """Without exponent, without trailing zeros, no negative zero. Beyond 38
    digits as the engine writes it; null for infinities and NaN."""
    t = x.cast("string")
    exact = lambda kind: F.when(t.try_cast(kind).cast("double") == x.cast("double"), t.try_cast(kind).cast("string"))
    finite = x.cast("double").isin(float("inf"), float("-inf")) | F.isnan(x.cast("double"))
    s = F.when(~finite, F.coalesce(exact("decimal(38,18)"), exact("decimal(38,37)"), exact("decimal(38,0)"), t))
    s = F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")).otherwise(s)
    return F.when(s == "-0", "0").otherwise(s)


def canonical_json(x: Column, kind: T.DataType, ascii_only: bool = False, keep_nulls: bool = False) -> Column:
    """Canonical JSON of a typed column: keys sorted, no white space, strings in
    canonical composition, nulls left out of objects (unless ``keep_nulls``), empty lists and objects kept."""
    if isinstance(kind, T.StructType):
        parts = []
        for f in sorted(kind.fields, key=lambda f: f.name):
            v = x.getField(f.name)
            text = F.concat(F.lit('"' + f.name.replace("\\", "\\\\").replace('"', '\\"') + '":'), canonical_json(v, f.dataType, ascii_only, keep_nulls))
            parts.append(F.coalesce(text, F.lit(f'"{f.name}":null')) if keep_nulls else F.when(v.isNotNull(), text))
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        return F.when(x.isNotNull(), out)
    if isinstance(kind, T.ArrayType):
        items = F.transform(x, lambda v: F.coalesce(canonical_json(v, kind.elementType, ascii_only, keep_nulls), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.array_sort(F.map_entries(x)), lambda e: F.concat(json_quote(e["key"], ascii_only), F.lit(":"), F.coalesce(canonical_json(e["value"], kind.valueType, ascii_only, keep_nulls), F.lit("null"))))
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    if isinstance(kind, T.BooleanType):
        return x.cast("string")
    if isinstance(kind, T.IntegralType):
        return x.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return plain_number(x)
    return json_quote(nfc(x.cast("string")), ascii_only)


def fingerprint(x: Column, kind: T.DataType) -> Column:
    """SHA-256 of the canonical JSON."""
    return hash_text(canonical_json(x, kind))


def projection_id(**fields: Column | str) -> Column:
    """SHA-256 of a flat object of strings: sorted keys, compact, ASCII only;
    nulls are written as null."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(json_quote(v, ascii_only=True), F.lit("null"))) for k, v in sorted(fields.items())]
    return hash_text(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
