"""Posting dates: parsing, normalising, and showing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed

RELATIVE = r"(?i)^\s*(?:posted\s+)?(?:(today|yesterday)|(\d+)\+?\s+(minute|hour|day|week|month|year)s?\s+ago)\s*$"
#: Minutes of each unit; months have 30 days and years 365 (fixed values).
MINUTES = {"minute": 1, "hour": 60, "day": 1440, "week": 10080, "month": 43200, "year": 525600}


def iso(value: Column) -> Column:
    """A full ISO-8601 date or time; no offset means UTC; anything else is null."""
    t = collapsed(value)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(t))


def absolute(value: Column) -> Column:
    """ISO-8601, else 8-Jun-2026, else June 8, 2026."""
    t = F.initcap(collapsed(value))
    named = F.when(t.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), F.try_to_timestamp(F.concat_ws("-", F.split_part(t, F.lit("-"), F.lit(1)), F.initcap(F.split_part(t, F.lit("-"), F.lit(2))), F.split_part(t, F.lit("-"), F.lit(3))), F.lit("d-MMM-yyyy")))
    long = F.when(t.rlike(r"^[A-Za-z]+ \d{1,2}, \d{4}$"), F.try_to_timestamp(t, F.lit("MMMM d, yyyy")))
    return F.coalesce(iso(value), named, long)


def relative(value: Column, reference: Column) -> Column:
    """today, yesterday, or so many units ago, seen from the reference time."""
    named, n, unit = (F.regexp_extract(value, RELATIVE, k) for k in (1, 2, 3))
    per = F.coalesce(*[F.when(F.lower(unit) == u, F.lit(m)) for u, m in MINUTES.items()])
    minutes = F.when(F.lower(named) == "today", F.lit(0)).when(F.lower(named) == "yesterday", F.lit(1440)).otherwise(n.try_cast("int") * per)
    return F.when(value.rlike(RELATIVE), reference - F.make_dt_interval(F.lit(0), F.lit(0), minutes))


def posted_at(value: Column, reference: Column) -> Column:
    """struct<at, status, reason>: normalized, or unparseable and why."""
    at = F.coalesce(absolute(value), relative(value, reference))
    ok = at.isNotNull()
    reason = F.when(ok, F.lit(None)).when(value.isNull() | (collapsed(value) == ""), F.lit("missing")).otherwise(F.lit("unrecognized_format"))
    return F.struct(at.alias("at"), F.when(ok, F.lit("normalized")).otherwise(F.lit("unparseable")).alias("status"), reason.alias("reason"))


def shown(at: Column, now: Column) -> Column:
    """How long ago, in words; dates for the future and for a year or more ago; '' for null."""
    seconds = F.unix_micros(now) / 1e6 - F.unix_micros(at) / 1e6
    hours, days = F.floor(seconds / 3600), F.floor(seconds / 86400)
    months = F.greatest(F.lit(1), F.floor(days / 30))
    date = F.date_format(at, "MMM d, yyyy")
    several = lambda n, unit: F.when(n == 1, F.lit(f"1 {unit} ago")).otherwise(F.concat(n.cast("string"), F.lit(f" {unit}s ago")))
    return F.when(at.isNull(), F.lit("")).when(seconds < 0, date).when(hours < 1, F.lit("just now")).when(hours < 24, several(hours, "hour")).when(days == 1, F.lit("yesterday")).when(days < 30, F.concat(days.cast("string"), F.lit(" days ago"))).when(days < 365, several(months, "month")).otherwise(date)
