"""The closed library of value transforms, as column functions, and chains of them.

A chain stops at the first null: a null never reaches a later transform, not even default(). A name outside the library is refused
when the chain is built.
"""

from __future__ import annotations

import html
from collections.abc import Callable, Iterable, Sequence
from urllib.parse import urljoin as _urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: strptime directives and their Spark patterns; weekday names are cut off before parsing.
DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%f": "SSSSSS", "%I": "h", "%p": "a", "%b": "MMM", "%B": "MMMM", "%z": "XX", "%%": "%",
}


@F.pandas_udf(T.StringType())
def _join_url(value: pd.Series, base: pd.Series) -> pd.Series:
    def one(x, b):
        try:
            return None if x is None else _urljoin(b, x)
        except ValueError:
            return None

    return pd.Series([one(x, b) for x, b in zip(value, base, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _unescape(value: pd.Series) -> pd.Series:
    return value.map(lambda x: None if x is None else html.unescape(x))


def urljoin(x: Column, base: str) -> Column:
    """RFC 3986 reference resolution. Absolute http(s) URLs pass without Python."""
    return F.when(x.rlike(r"^https?://[^\s]+$") & ~x.contains("/.") & x.rlike(r"^https?://[^/?#]+/"), x).otherwise(_join_url(x, F.lit(base)))


def strip_query_fragment(x: Column) -> Column:
    return F.split_part(F.split_part(x, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))


def regex_extract(x: Column, pattern: str, group: int = 1) -> Column:
    """Null where the pattern isn't found or the group took no part."""
    found = F.regexp_extract_all(x, F.lit(pattern), F.lit(group))
    return F.when(x.rlike(pattern), F.try_element_at(found, F.lit(1)))


def collapse_ws(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def html_unescape(x: Column) -> Column:
    """Texts without an ampersand pass without Python."""
    return F.when(x.contains("&"), _unescape(x)).otherwise(x)


def remove_prefix(x: Column, prefix: str) -> Column:
    return F.when(x.startswith(prefix), F.substring(x, len(prefix) + 1, 1 << 30)).otherwise(x)


def strip_brackets(x: Column) -> Column:
    """[x] becomes x trimmed; anything else is only trimmed."""
    t = strip(x)
    return F.when(t.rlike(r"(?s)^\[.*\]$"), strip(F.regexp_replace(t, r"(?s)^\[(.*)\]$", "$1"))).otherwise(t)


def replace(x: Column, old: str, new: str = "") -> Column:
    return F.replace(x, F.lit(old), F.lit(new)) if old else x


def append(x: Column, suffix: str) -> Column:
    return F.concat(x, F.lit(suffix))


def prepend(x: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), x)


def strip(x: Column, chars: str | None = None) -> Column:
    """Without chars, all Unicode white space at both ends."""
    return F.btrim(x, F.lit(chars)) if chars else F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def to_str(x: Column) -> Column:
    return x.cast("string")


def lower(x: Column) -> Column:
    return F.lower(x)


def upper(x: Column) -> Column:
    return F.upper(x)


def zero_pad(x: Column, width: int) -> Column:
    """Zeros after a sign, and no truncation."""
    signed = x.rlike(r"^[+-]")
    padded = F.when(signed, F.concat(F.substring(x, 1, 1), F.lpad(F.substring(x, 2, 1 << 30), width - 1, "0"))).otherwise(F.lpad(x, width, "0"))
    return F.when(F.length(x) < width, padded).otherwise(x)


def java_pattern(strptime: str) -> str:
    """The Spark pattern of a strptime format. An unknown directive is refused when the plan is built."""
    out, at, literal = [], 0, []

    def flush() -> None:
        if literal:
            text = "".join(literal)
            out.append("".join(f"'{c}'" if c.isalpha() else "''" if c == "'" else c for c in text))
            literal.clear()

    while at < len(strptime):
        if strptime[at] == "%":
            key = strptime[at : at + 2]
            if key in ("%a", "%A"):
                raise ValueError("weekday names are cut off before parsing; leave them out of the format")
            if key not in DIRECTIVES:
                raise ValueError(f"unsupported directive {key}")
            flush()
            out.append(DIRECTIVES[key])
            at += 2
        else:
            literal.append(strptime[at])
            at += 1
    flush()
    return "".join(out)


def iso8601(x: Column, formats: Sequence[str], tz: str | None = None) -> Column:
    """The first format that fits, as ISO 8601 text; tz (+HH:MM) is put behind times without a zone."""
    tried = []
    for f in formats:
        zoned = "%z" in f
        at = F.try_to_timestamp(x, F.lit(java_pattern(f)))
        text = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
        tried.append(F.concat(text, F.lit("+00:00" if zoned else tz or "")))
    return F.coalesce(*tried)


def date_only_to_iso(x: Column, tz: str = "+09:00") -> Column:
    return F.concat(F.replace(strip(x), F.lit("/"), F.lit("-")), F.lit("T00:00:00" + tz))


def unixtime_to_iso(x: Column, tz: str = "+00:00", unit: str = "s") -> Column:
    """Seconds or milliseconds to ISO text in the zone; null where it isn't a number."""
    seconds = x.try_cast("double") / (1000 if unit == "ms" else 1)
    at = F.timestamp_micros(F.floor(seconds * 1_000_000).cast("long"))
    # the session zone may differ from UTC: render the shifted instant in UTC terms
    local = F.from_utc_timestamp(F.to_utc_timestamp(at, F.current_timezone()), tz)
    return F.when(F.abs(seconds) < 1e11, F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(tz)))


def default(x: Column, fallback: str) -> Column:
    """The fallback for an empty text. In a chain a null has stopped before it gets here."""
    return F.when(x == "", F.lit(fallback)).otherwise(x)


LIBRARY: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (urljoin, strip_query_fragment, regex_extract, collapse_ws, html_unescape, remove_prefix, strip_brackets, replace, append, prepend, strip, to_str, lower, upper, zero_pad, iso8601, date_only_to_iso, unixtime_to_iso, default)
}


def chain(x: Column, steps: Iterable[Sequence]) -> Column:
    """steps: [name, *arguments] one after the other; each is null where what comes before is."""
    for name, *args in steps:
        if name not in LIBRARY:
            raise ValueError(f"unknown transform {name!r}")
        x = F.when(x.isNotNull(), LIBRARY[name](x, *args))
    return x
