"""Where a site's feeds may be, and which of these places hold one.

Candidates come from a page's own address, its head, its links, and from paths that are customary; what was answered at their addresses is
another table. Only counting a feed's items needs an XML parser, in Arrow batches.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from io import StringIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import urls

#: Customary paths of a site's feeds and of a page's, and how much of a body is looked at.
SITE_PATHS = ("/feed", "/rss", "/atom.xml", "/rss.xml", "/feed.xml", "/feeds")
PAGE_SUFFIXES = ("/rss.xml", "/feed", "/index.xml", ".rss")
MAX_FEED_CHARS = 1_000_000
FEED_URL = r"(?i)(?:/rss/?|/feed/?|/feeds(?:/|$)|\.rss|\.atom|\.xml)(?:[?#]|$)"
FEED_WORDS = r"(?i)rss|feed|atom|\.xml"
#: The places in the order in which they are looked at.
SOURCES = ("input-url-feed-path", "input-url-feed-content", "input-url-feed-fetch", "head-alternate", "page-feed-link", "page-path-fallback", "well-known-path")


def body_is_feed(text: Column) -> Column:
    """Whether a body is a feed, as it is or within a browser's view of XML."""
    head = F.lower(F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", ""), 1, 1024))
    names = lambda x: x.contains("<rss") | x.contains("<feed") | (x.contains("<rdf") & x.contains("rss"))
    viewed = F.lower(F.substring(text, 1, 8192)).rlike("webkit-xml-viewer-source-xml|xml-viewer-style")
    return F.coalesce(F.when(head.rlike(r"^<(\?xml|rss|feed|rdf)") & names(head), True).otherwise(viewed & names(F.lower(text))), F.lit(False))


def candidates(pages: DataFrame, node_rows: DataFrame) -> DataFrame:
    """page_id, source, pos, url, type, title: the places where feeds of a page (page_id, url, html) may be. A place is named once for each
    source; `input-url-feed-fetch` only says that the page's address should be tried."""
    u = F.col("url")
    p = pages.select("page_id", u.alias("base"), "html")
    whole = F.concat(urls.path(F.col("base")), F.when(urls.query(F.col("base")) != "", F.concat(F.lit("?"), urls.query(F.col("base")))).otherwise(""))
    kind = F.when(whole.rlike(FEED_URL), SOURCES[0]).when(body_is_feed(F.col("html")), SOURCES[1]).otherwise(SOURCES[2])
    none = F.lit(None).cast("string")
    own = p.select("page_id", kind.alias("source"), F.lit(0).alias("pos"), F.col("base").alias("url"), none.alias("type"), none.alias("title"))

    a, tag = F.col("attrs"), F.col("tag")
    linked = node_rows.where(tag.isin("a", "link")).join(p.select("page_id", "base"), "page_id").select("page_id", "base", "tag", "attrs", F.col("node").alias("pos"), F.trim(a["href"]).alias("href"), F.lower(F.coalesce(a["type"], F.lit(""))).alias("kind"), "text")
    linked = linked.where(F.col("href") != "").withColumn("url", urls.absolute(F.col("href"), F.col("base")))
    shown = [F.col("url"), F.nullif(a["type"], F.lit("")).alias("type"), a["title"].alias("title")]
    head = linked.where((tag == "link") & (F.coalesce(a["rel"], F.lit("")) == "alternate") & F.col("kind").rlike("rss|atom|xml")).select("page_id", F.lit(SOURCES[3]).alias("source"), "pos", *shown)
    said = F.concat_ws(" ", F.lower("href"), F.lower("text"), F.lower(F.coalesce(a["rel"], F.lit(""))), "kind")
    body = linked.where(~F.col("kind").contains("opensearch") & ~F.lower("href").contains("sitemap") & said.rlike(FEED_WORDS)).select("page_id", F.lit(SOURCES[4]).alias("source"), "pos", *shown)

    root = F.regexp_extract("base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.coalesce(F.nullif(urls.path(F.col("base")), F.lit("")), F.lit("/"))
    trimmed = F.coalesce(F.nullif(F.rtrim(path, F.lit("/")), F.lit("")), F.lit("/"))
    suffixed = F.when(path != "/", F.array(*(F.concat(root, trimmed, F.lit(s)) for s in PAGE_SUFFIXES)))
    blog = F.when((path == "/") & urls.host(F.col("base")).startswith("blog."), F.array(*(F.concat(root, F.lit(s if s.startswith("/") else "/" + s)) for s in PAGE_SUFFIXES)))
    rooted = p.where(root != "")
    guessed = rooted.select("page_id", F.lit(SOURCES[5]).alias("source"), F.posexplode(F.coalesce(suffixed, blog)).alias("pos", "url"), none.alias("type"), none.alias("title"))
    known = rooted.select("page_id", F.lit(SOURCES[6]).alias("source"), F.posexplode(F.array(*(F.concat(root, F.lit(s)) for s in SITE_PATHS))).alias("pos", "url"), none.alias("type"), none.alias("title"))

    every = own.unionByName(head).unionByName(body).unionByName(guessed).unionByName(known)
    return every.groupBy("page_id", "source", "url").agg(F.min("pos").alias("pos"), F.min_by(F.struct("type", "title"), "pos").alias("x")).select("page_id", "source", "pos", "url", "x.type", "x.title")


def root_and_items(text: str) -> tuple[str | None, int | None]:
    """The kind of a body (rss, feed, html or None) and how many items it has, as far as it is well formed."""
    if not text or text.lstrip()[:256].lower().startswith(("<!doctype html", "<html")):
        return ("html" if text else None), None
    root, items = None, 0
    try:
        for event, node in ET.iterparse(StringIO(text[:MAX_FEED_CHARS]), events=("start", "end")):
            tag = str(node.tag).rsplit("}", 1)[-1].lower()
            root = tag if root is None else root
            if event == "end":
                items += tag == {"rss": "item", "rdf": "item", "feed": "entry"}.get(root)
                node.clear()
    except ET.ParseError:
        if "<html" in text[:2048].lower():
            return "html", None
        root = root if root in ("rss", "rdf", "feed") else None
    kind = {"rdf": "rss", "rss": "rss", "feed": "feed", "html": "html"}.get(root)
    return kind, items if kind in ("rss", "feed") else None


def counted(responses: DataFrame) -> DataFrame:
    """url, status, content_type, size, root_tag, item_count, valid of the responses (url, status, content_type, body): a feed is valid if it
    was answered well, is said or seen to be XML, and has an item."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [root_and_items(t.as_py() or "") for t in batch.column("body")]
            kept = [batch.column(c) for c in ("url", "status", "content_type", "size")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([k for k, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["url", "status", "content_type", "size", "root_tag", "item_count"])

    flat = responses.select("url", F.col("status").cast("int").alias("status"), "content_type", F.coalesce(F.length("body"), F.lit(0)).alias("size"), "body")
    out = flat.mapInArrow(read, "url string, status int, content_type string, size int, root_tag string, item_count long")
    feed = F.col("root_tag").isin("rss", "feed")
    valid = (F.col("status") == 200) & feed & (F.col("item_count") > 0)
    return out.withColumn("valid", F.coalesce(valid, F.lit(False)))


def discovered(pages: DataFrame, node_rows: DataFrame, responses: DataFrame) -> DataFrame:
    """page_id, place, source, url, type, title, status, content_type, size, root_tag, item_count, valid: a page's candidates in the order
    of their sources, with what their addresses answered; the page's own address, where nothing speaks for it, only if it is valid. An
    address is asked once, and of several answers the first of the smallest status counts."""
    best = responses.groupBy("url").agg(F.min_by(F.struct("status", "content_type", "body"), F.struct("status", F.length("body"), "body")).alias("r")).select("url", "r.*")
    found = candidates(pages, node_rows).join(counted(best), "url", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    found = found.where((F.col("source") != SOURCES[2]) | F.col("valid"))
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    order = Window.partitionBy("page_id").orderBy(rank, "pos", "url")
    return found.withColumn("place", F.row_number().over(order)).drop("pos")
