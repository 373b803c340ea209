"""Dates and times as the reports need them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KOREA = "+09:00"


def korean_date(ts: Column) -> Column:
    """The calendar date nine hours east of UTC of a UTC time."""
    return (ts.cast("timestamp_ntz") + F.expr("interval 9 hours")).cast("date")


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def cutoff(range_key: str, now: Column) -> Column | None:
    """Start of `today`, `7d`, `30d`; None for `all`."""
    if range_key == "all":
        return None
    if range_key == "today":
        return F.date_trunc("day", now)
    return now - F.expr(f"interval {int(range_key.removesuffix('d'))} days")


#: Forms of a last-modified date, tried in order once the weekday is cut off.
FORMS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM", "yyyy", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss XX")


def parsed(text: Column) -> Column:
    """A timestamp from any of FORMS, else null."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in FORMS))


def normalised(text: Column) -> Column:
    """UTC ISO text of a date; what can't be read is only stripped."""
    return F.coalesce(F.date_format(parsed(text), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.trim(text))


def is_iso(text: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in FORMS[:6])).isNotNull()
