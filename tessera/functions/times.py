"""Points in time written as text: dates, times without a zone, and times with one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A date, or a date and a time of day with seconds, with or without a fraction of up to nine digits and a zone.
SHAPE = r"^(\d{4}-\d{2}-\d{2})(?:[Tt ](\d{2}:\d{2}:\d{2})(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2})?)?$"


def instant(text: Column) -> Column:
    """The point in time (microseconds, digits beyond are cut off), whatever the session's zone is: a date is its midnight, and without a zone UTC holds; null for anything else, impossible dates and leap seconds included."""
    s = F.trim(text)
    part = lambda k: F.regexp_extract(s, SHAPE, k)
    or_else = lambda c, other: F.when(c == "", other).otherwise(c)
    full = F.concat(part(1), F.lit("T"), or_else(part(2), F.lit("00:00:00")), part(3), or_else(F.upper(part(4)), F.lit("Z")))
    return F.when(s.rlike(SHAPE), F.try_to_timestamp(full))


def precision(text: Column) -> Column:
    """day, second or fraction; null if it is no point in time."""
    s = F.trim(text)
    shape = F.when(F.regexp_extract(s, SHAPE, 2) == "", "day").when(F.regexp_extract(s, SHAPE, 3) == "", "second").otherwise("fraction")
    return F.when(instant(text).isNotNull(), shape)


#: The same for the DuckDB twins, over `said`.
INSTANT_SQL = f"""CASE WHEN regexp_matches(trim(said), '{SHAPE}') THEN make_timestamp(epoch_us(TRY_CAST(regexp_extract(trim(said), '{SHAPE}', 1) || 'T' || coalesce(nullif(regexp_extract(trim(said), '{SHAPE}', 2), ''), '00:00:00') || regexp_extract(trim(said), '{SHAPE}', 3)
  || coalesce(nullif(upper(regexp_extract(trim(said), '{SHAPE}', 4)), ''), 'Z') AS TIMESTAMPTZ))) END"""
