"""Dates as canonical strings, and timestamps with six fractional digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.normalize import col

ISO = "^\\d{4}-\\d{2}-\\d{2}$"
US = "^(\\d{1,2})([/-])(\\d{1,2})\\2(\\d{4})$"


def _month_first(t: Column, first: int, second: int) -> tuple[Column, Column, Column]:
    part = lambda i: F.try_to_number(F.regexp_extract(t, US, i), F.lit("9999")).cast("int")
    return part(4), part(first), part(second)


def registration_date(x: Column | str, strict: bool = False) -> Column:
    """``yyyy-MM-dd`` from ISO dates, M/D/Y, M-D-Y and bare years, else null.

    Not ``strict``: an ISO date passes as it is, and a day of up to 31 is good in
    any month. ``strict``: the date must be on the calendar, years run from 1000,
    and D/M/Y is tried where M/D/Y fails.
    """
    t = F.trim(col(x))
    y, m, d = _month_first(t, 1, 3)
    ymd = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    if not strict:
        ok = m.between(1, 12) & d.between(1, 31)
        return F.when(t.rlike(ISO), t).when(t.rlike(US), F.when(ok, ymd)).when(t.rlike("^\\d{4}$"), F.concat(t, F.lit("-01-01")))
    dmy = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(d.cast("string"), 2, "0"), F.lpad(m.cast("string"), 2, "0"))
    day = lambda s: F.when(s >= "1000", F.date_format(F.try_to_date(s, "yyyy-MM-dd"), "yyyy-MM-dd"))
    return F.when(t.rlike(ISO), day(t)).when(t.rlike(US), F.coalesce(day(ymd), day(dmy))).when(t.rlike("^[1-9]\\d{3}$"), F.concat(t, F.lit("-01-01")))


RFC3339 = "^\\d{4}-\\d{2}-\\d{2}[Tt ]\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?"


def parse_timestamp(x: Column | str, offset: bool = True) -> Column:
    """RFC 3339, any offset; null if it isn't one. Without ``offset``, a text may
    lack it and is UTC. The session's time zone must be UTC."""
    t = F.trim(col(x))
    return F.when(t.rlike(RFC3339 + ("([Zz]|[+-]\\d{2}:\\d{2})$" if offset else "([Zz]|[+-]\\d{2}:\\d{2})?$")), F.try_to_timestamp(F.upper(t)))


def canonical_timestamp(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def occurred_date(ts: Column | str) -> Column:
    """The first ten characters of a canonical timestamp."""
    return F.substring(col(ts), 1, 10)
