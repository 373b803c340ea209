"""What a page and the requests that it made say together: pagers, feeds, and whether it is worth rendering.

Requests are rows (page_id, pos, url, resource_type, content_type, body); pages are (page_id, url, html), and their nodes those of
`pages.nodes`. Everything is expressions, sums by page and ranks within a page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import urls
from tidewatch.operators import pages as page_rows

#: Parameters that name a page, the path of a page, and classes of what holds a pager.
PAGE_PARAMETER = r"(?i)[?&](page|p|pg|offset|start|skip|cursor|_page|page_num)=([0-9]+)"
PAGE_PATH, PAGER_CLASS = r"(?i)/page/([0-9]+)/?$", r"(?i)\b(pager|pagination|paging|page-nav)\b"
#: How many links and requests of a page are looked at, and how many hints are given.
FIRST_LINKS, FIRST_REQUESTS, MOST_HINTS = 500, 200, 8
#: Requests of advertisers, files that are no data, and marks of data where a request's kind isn't known.
TRACKERS = r"(?i)(doubleclick|googlesyndication|googletagmanager|google-analytics|/gtag/|/gtm[./]|\bpagead\b|adservice|adsystem|adnxs|criteo|taboola|outbrain|scorecardresearch|amplitude|mixpanel|segment\.io|sentry|hotjar|clarity\.ms|onetag|/collect\b|/beacon|/pixel|facebook\.com/tr|connect\.facebook|display\.ad\.|\bad\.daum\.|adlog\.|/track(?:ing)?\b|/log(?:s|ging)?\b|/metric|/telemetry|/stat[s]?\b)"
FILES = r"(?i)\.(js|css|html?|png|jpe?g|gif|svg|webp|ico|woff2?|ttf|mp4|webm|mp3|wav|pdf)$"
#: Types, paths, answers and roots of feeds.
FEED_TYPE, FEED_PATH = r"(?i)(rss|atom)\+xml", r"(?i)(?:^|[/_.-])(rss|feed|atom)(?:[/_.-]|$)"
FEED_ANSWER, FEED_ROOT = r"(?i)(application/(?:rss|atom)\+xml|text/xml|application/xml)", r"(?i)^\s*(?:<\?xml[^>]*>\s*)?(?:<rss\b|<feed\b|<rdf:RDF\b)"
#: How much larger a rendered page is, and how many more rows or repeated siblings it has, if the static one is a shell.
MIN_RATIO, MIN_ROWS, MIN_DRAWN = 2.0, 5, 20


def plain(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def query_template(url: Column, parameter: Column) -> Column:
    """The URL with {page} for a parameter's value, added where it has none; other values keep their escapes."""
    u = plain(url)
    pattern = F.concat(F.lit("(?i)([?&]"), parameter, F.lit("=)[^&]*"))
    there = F.regexp_like(u, pattern)
    return F.when(there, F.regexp_replace(u, pattern, F.lit("$1{page}"))).otherwise(F.concat(u, F.when(u.contains("?"), "&").otherwise("?"), parameter, F.lit("={page}")))


def path_template(url: Column) -> Column:
    return F.regexp_replace(plain(url), r"(?i)/page/[0-9]+(/?)(\?|$)", "/page/{page}$1$2")


def _data_requests(requests: DataFrame) -> DataFrame:
    """A page's first requests that fetch data and don't serve advertisers."""
    first = requests.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("k") <= FIRST_REQUESTS)
    kind, path = F.coalesce("resource_type", F.lit("")), urls.path(F.col("url"))
    looks = F.lower(F.coalesce("content_type", F.lit(""))).contains("json") | F.lower(path).rlike("/api/|/graphql")
    return first.where((F.coalesce("url", F.lit("")) != "") & ~F.col("url").rlike(TRACKERS)).where(kind.isin("xhr", "fetch") | ((kind == "") & ~path.rlike(FILES) & looks))


def pager_hints(pages: DataFrame, node_rows: DataFrame, requests: DataFrame) -> DataFrame:
    """page_id, place, kind, param, url_template, source, evidence_url: addresses of a list's further pages. Links come first, those by a
    parameter in page order, then those by a path (two different numbers, or one within a pager), then parameters of data requests, set
    into the page's own address, as an API's may lie elsewhere."""
    base = pages.select("page_id", F.col("url").alias("base"))
    a = node_rows.where("tag = 'a' and attrs['href'] is not null").select("page_id", "node", F.col("attrs")["href"].alias("href"), "ancestors")
    a = a.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("node"))).where(F.col("k") <= FIRST_LINKS)
    a = a.join(base, "page_id").withColumn("full", urls.absolute(F.col("href"), F.col("base")))
    parameter = F.lower(F.regexp_extract("href", PAGE_PARAMETER, 1))
    shown = ["page_id", "rank", "pos", "kind", "param", "url_template", "source", "evidence_url"]
    by_query = a.withColumn("param", parameter).where("param <> ''").select("page_id", F.lit(0).alias("rank"), F.col("node").alias("pos"), F.lit("query_param").alias("kind"), "param", query_template(F.col("full"), F.col("param")).alias("url_template"), F.lit("html_anchor").alias("source"), F.col("full").alias("evidence_url"))

    number = F.regexp_extract(urls.path(F.col("full")), PAGE_PATH, 1)
    paths = a.where((number != "") & (urls.host(F.col("full")) == urls.host(F.col("base")))).select("page_id", "node", "ancestors", "full", number.alias("number"), F.regexp_replace(urls.path(F.col("full")), PAGE_PATH, "/page/").alias("stem"))
    holders = node_rows.where(F.array_join("classes", " ").rlike(PAGER_CLASS)).select("page_id", F.col("node").alias("up"), F.lit(True).alias("held"))
    within = paths.select("page_id", "node", F.explode_outer("ancestors").alias("up")).join(holders, ["page_id", "up"]).select("page_id", "node", "held").distinct()
    stems = paths.join(within, ["page_id", "node"], "left").groupBy("page_id", "stem").agg(F.count_distinct("number").alias("n"), F.bool_or("held").alias("held"), F.min("node").alias("pos"), F.max_by("full", -F.col("node")).alias("evidence_url"))
    stems = stems.where((F.col("n") >= 2) | F.coalesce("held", F.lit(False)))
    by_path = stems.select("page_id", F.lit(1).alias("rank"), "pos", F.lit("path_segment").alias("kind"), F.lit("page").alias("param"), path_template(F.col("evidence_url")).alias("url_template"), F.lit("html_anchor").alias("source"), "evidence_url")

    named = F.lower(F.regexp_extract("url", PAGE_PARAMETER, 1))
    first = _data_requests(requests).withColumn("param", named).where("param <> ''").groupBy("page_id", "param").agg(F.min("pos").alias("pos"), F.min_by("url", "pos").alias("evidence_url")).join(base, "page_id")
    by_request = first.select("page_id", F.lit(2).alias("rank"), "pos", F.lit("query_param").alias("kind"), "param", query_template(F.col("base"), F.col("param")).alias("url_template"), F.lit("har_xhr").alias("source"), "evidence_url")

    every = reduce(DataFrame.unionByName, (x.select(*shown) for x in (by_query, by_path, by_request)))
    best = every.groupBy("page_id", "param", "url_template").agg(F.min(F.struct("rank", "pos", "kind", "source", "evidence_url")).alias("x")).select("page_id", "param", "url_template", "x.*")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("rank", "pos", "param", "url_template"))
    return best.withColumn("place", place).where(F.col("place") <= MOST_HINTS).select("page_id", "place", "kind", "param", "url_template", "source", "evidence_url")


def feed_urls(pages: DataFrame, node_rows: DataFrame, requests: DataFrame) -> DataFrame:
    """page_id, url, source, type of the feeds that a page names in its head (link_rel) or links (html_body) or that it was answered with
    (har_resp_xml); each address once, from the first of these."""
    base = pages.select("page_id", F.col("url").alias("base"))
    a, tag = F.col("attrs"), F.col("tag")
    linked = node_rows.where(tag.isin("a", "link") & (F.coalesce(a["href"], F.lit("")) != "")).join(base, "page_id").withColumn("href", a["href"])
    in_head = (tag == "link") & F.lower(F.coalesce(a["rel"], F.lit(""))).contains("alternate") & F.coalesce(a["type"], F.lit("")).rlike(FEED_TYPE)
    loose = F.coalesce(F.nullif(F.regexp_extract("href", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit("")), F.col("href"))
    rank = F.when(in_head, 0).when((tag == "a") & loose.rlike(FEED_PATH), 1)
    found = linked.withColumn("rank", rank).where("rank is not null").select("page_id", "rank", F.col("node").alias("pos"), urls.absolute(F.col("href"), F.col("base")).alias("url"), F.when(F.col("rank") == 0, a["type"]).alias("type"))
    answered = requests.where(F.col("content_type").rlike(FEED_ANSWER) & F.col("body").rlike(FEED_ROOT) & (F.coalesce("url", F.lit("")) != "")).select("page_id", F.lit(2).alias("rank"), "pos", "url", F.col("content_type").alias("type"))
    every = found.unionByName(answered).groupBy("page_id", "url").agg(F.min(F.struct("rank", "pos", "type")).alias("x"))
    names = F.array(*map(F.lit, ("link_rel", "html_body", "har_resp_xml")))
    return every.select("page_id", "url", F.element_at(names, F.col("x.rank") + 1).alias("source"), "x.type")


def rendering(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """page_id, static_size, rendered_size, ratio, static_rows, rendered_rows, repeat_static, repeat_drawn, trigger_rule, insufficient of pages
    (page_id, html) in both forms: a static page is a shell by its size (the rendered one is twice as large and has five more links or
    data ids) or by its repeats (patterns that only the rendered one has, or has three times as often, come to twenty rows). Where one form
    is missing or empty nothing is said."""
    signs = lambda c: sum((F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))) / len(s) for s in ("data-id=", "<a "))
    sized = lambda df, name: df.groupBy("page_id").agg(F.max("html").alias("html")).select("page_id", F.coalesce(F.length("html"), F.lit(0)).alias(f"{name}_size"), F.coalesce(signs(F.col("html")), F.lit(0)).cast("long").alias(f"{name}_rows"))
    both = sized(static, "static").join(sized(rendered, "rendered"), "page_id", "full").na.fill(0)
    patterns = lambda df, name: page_rows.page_patterns(df.drop("url")).select("page_id", "selector", F.col("n").alias(name))
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    drawn = F.when((x == 0) & (y >= 3), y).when((x > 0) & (y >= 3 * x) & (y - x >= 5), y - x).otherwise(0)
    sums = patterns(static, "x").join(patterns(rendered, "y"), ["page_id", "selector"], "full").groupBy("page_id").agg(F.sum(drawn).alias("repeat_drawn"), F.sum(F.when((x > 0) & (y >= x), x).otherwise(0)).alias("repeat_static"))
    d = both.join(sums, "page_id", "left").na.fill(0)
    known = (F.col("static_size") > 0) & (F.col("rendered_size") > 0)
    d = d.withColumn("ratio", F.when(known, F.round(F.col("rendered_size") / F.col("static_size"), 2)).otherwise(F.lit(0.0)))
    d = d.withColumns({c: F.when(known, F.col(c)).otherwise(F.lit(0)).cast("long") for c in ("static_rows", "rendered_rows", "repeat_static", "repeat_drawn")})
    by_size = known & (F.col("ratio") >= MIN_RATIO) & (F.col("rendered_rows") - F.col("static_rows") >= MIN_ROWS)
    d = d.withColumn("trigger_rule", F.when(by_size, "size").when(known & (F.col("repeat_drawn") >= MIN_DRAWN), "repeat"))
    return d.select("page_id", "static_size", "rendered_size", "ratio", "static_rows", "rendered_rows", "repeat_static", "repeat_drawn", "trigger_rule", F.col("trigger_rule").isNotNull().alias("insufficient"))
