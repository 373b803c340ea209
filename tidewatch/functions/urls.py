"""URL functions on columns: parts, canonical form, slugs, templates, scores."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track, and prefixes of such.
TRACKING_PREFIXES = ("utm_", "_hsenc", "_hsmi", "oly_")
TRACKING_KEYS = ("fbclid", "gclid", "gclsrc", "dclid", "_ga", "_gid", "_gac", "mc_cid", "mc_eid", "igshid", "yclid", "wbraid", "gbraid", "msclkid", "ttclid", "twclid")
#: The query keys that count on a search page of one provider.
SEARCH_KEEP = ("q", "hl", "gl", "ceid", "tbm")
#: Public suffixes of two labels.
TWO_LABEL_SUFFIXES = ("co.kr", "co.jp", "co.uk", "com.cn", "or.kr", "ne.jp", "go.kr", "ac.kr")


def host(url: Column) -> Column:
    """Lower-case host, null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def first_segment(url: Column) -> Column:
    return F.split_part(path(url), F.lit("/"), F.lit(2))


def is_tracking(key: Column) -> Column:
    prefixed = F.lit(False)
    for p in TRACKING_PREFIXES:
        prefixed = prefixed | key.startswith(p)
    return prefixed | key.isin(*TRACKING_KEYS)


def query_pairs(url: Column) -> Column:
    """key=value texts without empty and tracking ones, sorted. On a search page only the keys that name the search count."""
    search = F.coalesce(host(url).rlike(r"(^|\.)google\.[a-z.]+$"), F.lit(False)) & path(url).rlike(r"(?i)^/(rss/)?search\b")

    def counts(pair: Column) -> Column:
        key = F.split_part(pair, F.lit("="), F.lit(1))
        return pair.rlike("^[^=]*=.") & ~is_tracking(key) & (~search | key.isin(*SEARCH_KEEP))

    return F.array_sort(F.filter(F.split(query(url), "&"), counts))


def canonical(url: Column) -> Column:
    """Scheme and fragment gone, host in lower case, slashes collapsed, no trailing slash but the root's, query without tracking and
    sorted. Escapes in the query are kept as they are."""
    authority = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    clean = F.rtrim(F.regexp_replace(path(url), "/+", "/"), F.lit("/"))
    pairs = query_pairs(url)
    return F.concat(F.lit("//"), authority, F.when(clean == "", F.lit("/")).otherwise(clean), F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit("")))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^(www|m)\.", "")


def _safe(x: Column, most: int) -> Column:
    return F.substring(F.regexp_replace(x, r"[^A-Za-z0-9._%-]+", "_"), 1, most)


def slug(url: Column) -> Column:
    """platform_board_hash: the bare host with dashes, the first segment (root if none), and eight digits of the canonical URL's SHA-1."""
    board = F.coalesce(F.nullif(first_segment(url), F.lit("")), F.lit("root"))
    return F.substring(F.concat_ws("_", _safe(F.replace(bare_host(url), F.lit("."), F.lit("-")), 20), _safe(board, 60), F.substring(F.sha1(canonical(url)), 1, 8)), 1, 100)


def path_template(url: Column) -> Column:
    """Segments as <N> (digits), <HEX> (eight or more hex digits), <ID> (digits and letters) or themselves."""

    def shape(s: Column) -> Column:
        return F.when(s.rlike("^[0-9]+$"), F.lit("<N>")).when(s.rlike("^[0-9a-fA-F]{8,}$"), F.lit("<HEX>")).when(s.rlike("[0-9]") & s.rlike("[A-Za-z]"), F.lit("<ID>")).otherwise(s)

    return F.concat(F.lit("/"), F.array_join(F.transform(F.filter(F.split(path(url), "/"), lambda s: s != ""), shape), "/"))


def query_shape(url: Column) -> Column:
    keys = F.transform(F.filter(F.split(query(url), "&"), lambda p: p != ""), lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    return F.array_join(F.array_sort(F.array_distinct(keys)), "&")


def literal_segments(template: Column) -> Column:
    return F.size(F.filter(F.split(template, "/"), lambda s: (s != "") & ~s.startswith("<")))


def registrable(url: Column) -> Column:
    """The last two labels of the host, three behind a public suffix of two labels."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    two = F.when(n <= 2, host(url)).otherwise(F.array_join(F.slice(labels, n - 1, 2), "."))
    three = F.when(n <= 3, host(url)).otherwise(F.array_join(F.slice(labels, n - 2, 3), "."))
    return F.when(F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".").isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def same_site(a: Column, b: Column) -> Column:
    return registrable(a) == registrable(b)


def long_numbers(url: Column) -> Column:
    return F.regexp_extract_all(url, F.lit("([0-9]{4,})"), F.lit(1))


def href_pattern(href: Column) -> Column:
    """Numbers that are a query value or a whole segment, as {n}."""
    return F.regexp_replace(F.regexp_replace(href, "=[0-9]+", "={n}"), "/[0-9]+(/|$)", "/{n}$1")


def is_script(href: Column) -> Column:
    """Whether a link leads nowhere by itself: blank, a fragment or a script."""
    return F.coalesce(F.trim(href) == "", F.lit(True)) | F.coalesce(href.rlike(r"(?i)^\s*(#|javascript:)"), F.lit(False))


def absolute(href: Column, base: Column) -> Column:
    """A link as the page at `base` means it: with its own scheme, of the same scheme, from the root, or next to the page."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path(base), "^(.*/)", 1)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def without_fragment(url: Column) -> Column:
    """For comparing: no fragment, no slashes at the end, lower case; a null is empty."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "(?s)#.*$", ""), "/+$", ""))


def grounded(url: Column) -> Column:
    """As without_fragment, with runs of slashes as one, but for those behind the scheme."""
    return F.regexp_replace(without_fragment(url), "(?<!:)/+|(?<=:)/{3,}", "/")


def fits_template(template: str, url: Column) -> Column:
    """Whether a URL is the template with something in its places {post_id}, {id}, {board}, {page}."""
    # the template is known when the plan is built
    t = re.sub(r"(?<!:)/+|(?<=:)/{3,}", "/", template.split("#")[0].rstrip("/").lower())
    pattern = "".join("[^/?#&]+" if x in ("{post_id}", "{id}", "{board}", "{page}") else re.escape(x) for x in re.split(r"(\{(?:post_id|id|board|page)\})", t))
    u = grounded(url)
    return F.lit(bool(t)) & (u != "") & ((u == t) | u.rlike(f"^(?:{pattern})$"))


def endpoint_family(template: str, url: Column) -> Column:
    """Whether both have the same host and, but for numbers and the place {post_id}, the same path."""
    t = F.lit(template.replace("{post_id}", "0"))
    shape = lambda x: F.regexp_replace(F.lower(F.regexp_replace(path(x), "/+$", "")), "[0-9]+", "*")
    return F.coalesce((host(t) == host(url)) & (shape(t) == shape(url)), F.lit(False))


def sitemap_url(url: Column) -> Column:
    """Scheme and host in lower case, a path of at least a slash, the query, no fragment; null without scheme or host."""
    u = F.trim(url)
    p, q = path(u), query(u)
    whole = F.concat(F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)), F.when(p == "", "/").otherwise(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(host(u).isNotNull(), whole)


#: Words of a board's URL.
BOARD_WORDS = ("notice", "bbs", "board", "news", "article", "post", "공지", "게시판", "뉴스", "글")


def board_score(url: Column) -> Column:
    """How much a URL looks like a list of posts."""
    p, q = path(url), F.concat(F.lit("?"), query(url))
    named = F.concat(F.lower(p), q).rlike("|".join(BOARD_WORDS))
    depth = F.size(F.filter(F.split(p, "/"), lambda s: s != ""))
    points = ((3, named), (2, q.rlike("(?i)[?&](id|no|page|p|bid|cid|board)=")), (1, p.rlike("/[0-9]{3,}(/|$)")), (1, depth.between(1, 3)))
    return reduce(lambda a, b: a + b, (F.when(when, F.lit(n)).otherwise(F.lit(0)) for n, when in points))


def with_query(url: Column, updates: dict[str, Column]) -> Column:
    """The URL with these query values; other keys keep their order and their repeats, the new ones follow."""
    parts = F.filter(F.split(query(url), "&"), lambda x: x != "")
    kept = F.filter(parts, lambda x: ~F.split_part(x, F.lit("="), F.lit(1)).isin(*updates))
    kept = F.transform(kept, lambda x: F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("="))))
    new = F.array(*(F.concat(F.lit(k + "="), F.url_encode(v.cast("string"))) for k, v in updates.items()))
    every = F.array_join(F.concat(kept, new), "&")
    head, tail = F.regexp_extract(url, "^([^?#]*)", 1), F.regexp_extract(url, "(#.*)$", 1)
    return F.concat(head, F.lit("?"), every, tail)


def rendered(template: str, values: dict[str, Column]) -> Column:
    """The template with its places {name} filled; a null is empty, and an unknown place stays as it is."""
    found = re.split(r"(\{[A-Za-z_][A-Za-z0-9_]*\})", template)
    return F.concat(*(F.coalesce(values[x[1:-1]].cast("string"), F.lit("")) if x[1:-1] in values and x.startswith("{") else F.lit(x) for x in found if x))


def proxied(url: Column, proxy: str | None) -> Column:
    """The proxy's URL with the percent-encoded target in its place."""
    quoted = F.replace(F.url_encode(url), F.lit("+"), F.lit("%20"))
    return F.replace(F.lit(proxy), F.lit("{target}"), quoted) if proxy else url


def urls_in_text(text: Column) -> Column:
    """Different URLs of a text in their order, without trailing punctuation."""
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"']+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", "")))


def article_score(url: Column, site: Column) -> Column:
    """Additive score of how much a URL looks like one article of the site; null gives -1."""
    p, q = F.lower(path(url)), F.lower(query(url))

    def plus(n: int, when: Column) -> Column:
        return F.when(when, F.lit(n)).otherwise(F.lit(0))

    total = (
        plus(4, same_site(url, site))
        + plus(1, ~p.isin("", "/"))
        + plus(2, F.concat(p, F.lit("?"), q).rlike("[0-9]{3,}"))
        + plus(1, p.rlike("view|detail|article|notice|read|thread|post|bbs|board"))
        + plus(-3, q.rlike("(^|&)(sort|filter|search|keyword|query|q|page|category)="))
        + plus(-2, p.rlike("/(search|list|index|all|category|tag|sort|filter)(/|$)"))
        + plus(-3, p.rlike("/(members?|profiles?|users?)(/|$)"))
        + plus(-3, q.rlike("(^|&)(u|user|userid|member)="))
        + plus(-2, p.rlike("/(forums|boards|categories)(/|$)|/(board|forum|node|category)/[0-9]+/?$"))
        + plus(-3, p.rlike("/archives?(/|$)"))
        + plus(-3, p.rlike("/[a-z]+_list(/|$)"))
        + plus(1, (q == "") & p.rlike("/[a-z0-9][a-z0-9_-]{4,}/?$"))
    )
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit(-1)).otherwise(total)


def page_link(template: str, page: Column, param: str | None = "page", mode: str = "query_param", unit: int | None = None, page_size: int = 20, page_size_max: int | None = None, size_param: str | None = None, board: str = "", when_paged: dict[str, str] | None = None) -> Column:
    """The URL of a page of a list. Its places {board}, {page}, {page_size} are filled, with page_size cut to the maximum.

    Modes: `none`; `query_param` sets page and size always; `offset` sets (page - 1) * unit and the unit beyond the first page;
    `path_segment` leaves it to the place {page}. Beyond the first page the parameters `when_paged` are added, but in mode `none`.
    """
    size = min(page_size, page_size_max) if page_size_max is not None else page_size
    base = rendered(template, {"board": F.lit(board), "page": page, "page_size": F.lit(size)})
    extra = {k: F.lit(v) for k, v in (when_paged or {}).items()}
    step = size if unit is None else unit
    if mode == "none":
        return base
    if mode == "query_param":
        always = {k: v for k, v in ((param, page), (size_param, F.lit(size))) if k}
        later = always | extra
    elif mode == "offset":
        always, later = {}, {k: v for k, v in ((param, (page - 1) * step), (size_param, F.lit(step))) if k} | extra
    elif mode == "path_segment":
        always, later = {}, extra
    else:
        raise ValueError(f"unknown pagination {mode!r}")
    return F.when(page > 1, with_query(base, later) if later else base).otherwise(with_query(base, always) if always else base)
