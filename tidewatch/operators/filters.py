"""Predicates that the reports and gates build at run time. Each is a Column, so scans can push it down where the source allows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import urls


def every(conditions: Iterable[Column | None]) -> Column:
    """Conjunction of those that are given; true if none is."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def text_in(needle: str | None, *columns: str) -> Column | None:
    """Case-insensitive substring of any of the columns; wildcard characters stand for themselves."""
    if not needle:
        return None
    return any_of(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower())) for c in columns)


def one_of(column: str, values: Sequence[str] | None) -> Column | None:
    return F.col(column).isin(*values) if values else None


def newer(column: str, since: Column | None) -> Column | None:
    return F.col(column) >= since if since is not None else None


def case_filter(outcome: str | None = None, slug_part: str | None = None, failure: str | None = None, text: str | None = None, since: Column | None = None) -> Column:
    """Case runs by outcome, part of the slug, a failure key of their array, text in three columns, and period."""
    return every(
        [
            F.col("outcome") == outcome if outcome else None,
            text_in(slug_part, "slug"),
            F.array_contains("failure_keys", failure) if failure else None,
            text_in(text, "slug", "url", "reason"),
            newer("ts", since),
        ]
    )


def case_query(keys: Sequence[str] | None = None, body: str | None = None, layer: str | None = None, status_prefix: str | None = None, candidate: str | None = None) -> Column:
    """Case files by any of some failure keys, a pattern in the body, fix layer, status prefix or a vocabulary candidate."""
    return every(
        [
            F.arrays_overlap("failure_keys", F.array(*map(F.lit, keys))) if keys else None,
            F.col("body").rlike(body) if body else None,
            F.col("fix_layer") == layer if layer else None,
            F.col("status").startswith(status_prefix) if status_prefix else None,
            F.exists("candidates", lambda c: c == candidate) if candidate else None,
        ]
    )


def trace_filter(kinds: Sequence[str] | None = None, failed: bool = False, idle: bool = True, text: str | None = None) -> Column:
    """Traces of some kinds, only failed ones, without idle ones, or with a text in any attribute."""
    return every(
        [
            one_of("kind", kinds),
            ~F.coalesce("ok", F.lit(True)) if failed else None,
            F.coalesce("n_spans", F.lit(0)) > 0 if not idle else None,
            F.exists(F.map_values("attrs"), lambda v: F.contains(F.lower(v), F.lit(text.lower()))) if text else None,
        ]
    )


def by_requester(column: str, user: Column) -> Column:
    """Rows whose JSON names the user as its id."""
    return F.get_json_object(column, "$.id") == user


def recent_requests(jobs: DataFrame, since: Column) -> DataFrame:
    """Registrations of each user since a time."""
    return jobs.where((F.col("kind") == "register") & (F.col("ts") >= since)).groupBy("user_id").agg(F.count("*").alias("n"))


#: Addresses that no page can be at.
PRIVATE = r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|192\.0\.0\.|192\.0\.2\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|172\.(1[6-9]|2[0-9]|3[01])\.|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|22[4-9]\.|2[3-5][0-9]\.)"


#: As above, for addresses of version 6 written out as 32 digits: all outside of the global and site-local ranges, and of the
#: former those for protocols (with their exceptions), for documentation and for relays.
PRIVATE_6 = r"^(?!2|3|fe[c-f])|^20010(?:0|1)(?!01(?:0{23}[12]$)|03|040112|2|3)|^20010db8|^2002"


def written_out(address: Column) -> Column:
    """The 32 digits of an address of version 6, whatever its spelling; null if it is none."""
    quad = F.regexp_extract(address, r":([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1)
    byte = lambda k: F.split_part(quad, F.lit("."), F.lit(k)).try_cast("int")
    fine = F.coalesce(F.greatest(*(byte(k) for k in (1, 2, 3, 4))) <= 255, F.lit(False))
    pair = lambda k: F.hex(byte(k) * 256 + byte(k + 1))
    plain = F.when(quad == "", address).when(fine, F.concat(F.substring(address, F.lit(1), F.length(address) - F.length(quad)), pair(1), F.lit(":"), pair(3)))
    groups = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))
    first, rest = groups(F.split_part(plain, F.lit("::"), F.lit(1))), groups(F.split_part(plain, F.lit("::"), F.lit(2)))
    gap = F.greatest(8 - F.size(first) - F.size(rest), F.lit(0))
    whole = F.when(plain.contains("::"), F.concat(first, F.array_repeat(F.lit("0"), gap), rest)).otherwise(first)
    fits = (F.size(whole) == 8) & (F.size(F.split(plain, "::")) <= 2) & F.forall(whole, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    return F.when(fits, F.lower(F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")))


def url_problem(url: Column) -> Column:
    """The first structural reason against a URL, null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    name = F.coalesce(urls.host(url), F.lit(""))
    six = written_out(F.regexp_extract(authority, r"^\[([^\]%]*)", 1))
    return (
        F.when(url.isNull() | (F.trim(url) == ""), "blank")
        .when(url.rlike(r"(?U)[\s\x00-\x1f\x7f]"), "white space")
        .when(~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "no scheme")
        .when(~F.lower(url).rlike("^https?://"), "scheme")
        .when(authority.contains("@"), "user info")
        .when(name == "", "no host")
        .when(name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | authority.startswith("["), F.when(name.rlike(PRIVATE) | F.coalesce(six.rlike(PRIVATE_6), F.lit(False)), "private address").otherwise("address"))
    )


def retention_class(status: Column, age_days: Column, failed_days: int, unregistered_days: int) -> Column:
    """keep or delete: registered and rejected stay; failed and unregistered go after so many days, never if 0 or less."""

    def old(days: int) -> Column:
        return F.lit(days > 0) & (age_days > days)

    return F.when((status == "failed") & old(failed_days), "delete").when((status == "unregistered") & old(unregistered_days), "delete").otherwise("keep")


def rejection_summary(rejections: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Reasons of the last hours with their counts."""
    return rejections.where(F.col("ts") >= now - F.expr(f"interval {int(hours)} hours")).groupBy("reason").agg(F.count("*").alias("n"))


def eligible(entries: DataFrame, jobs: DataFrame, codes: Sequence[int] | None = None, force: bool = False) -> DataFrame:
    """Entries to try: all (force), those whose last job ended with one of the codes, or those never tried."""
    if force:
        return entries
    last = jobs.groupBy("url").agg(F.max_by("result_rc", "id").alias("rc"))
    if codes:
        return entries.join(last.where(F.col("rc").isin(*codes)), "url", "left_semi")
    return entries.join(last, "url", "left_anti")
