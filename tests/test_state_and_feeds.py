"""Keyed streaming state over restarts and late rows, YAML catalogues, feeds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import feeds, pages
from tidewatch.sources import catalogs
from tidewatch.streaming import posts as streams


def at(text):
    return dt.datetime.fromisoformat(text)


def run(spark, folder, schema, transform, name):
    """Takes what is in the folder and hasn't been taken, and returns all rows so far; each call is a restart from the checkpoint."""
    out = f"{folder}/out"
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).queryName(name).start().awaitTermination()
    return spark.read.parquet(out).collect()


def test_drift(spark, tmp_path):
    schema = "slug string, ts timestamp, body_fetched int, body_empty int"
    batches = [
        [("a", at("2024-01-01"), 2, 2), ("a", at("2024-01-02"), 3, 3), ("b", at("2024-01-01"), 1, 1), ("b", at("2024-01-02"), 1, 0), (None, at("2024-01-01"), 1, 1)],
        [("a", at("2024-01-03"), 0, 0), ("a", at("2024-01-03"), None, None), ("b", at("2024-01-03"), 1, 1), ("b", at("2024-01-04"), 2, 2)],
        [("a", at("2024-01-05"), 1, 1), ("a", at("2024-01-06"), 1, 1), ("a", at("2024-01-07"), 2, 1), ("b", at("2024-01-05"), 5, 5)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        got = run(spark, tmp_path, schema, streams.body_drift, "drift")
    assert sorted((r.slug, str(r.ts.date()), r.streak) for r in got) == [("a", "2024-01-05", 3), ("a", "2024-01-06", 4), ("b", "2024-01-05", 3)]


def test_deliveries(spark, tmp_path):
    """The day is that of UTC+9; ticks that were missed are made up for on the same day, and none passes twice over restarts."""
    schema = "target_id string, ts timestamp, deliver_at string"
    batches = [
        [("t", at("2024-01-01T23:00"), "08:30"), ("t", at("2024-01-01T23:40"), "08:30"), ("t", at("2024-01-01T23:50"), "08:30"), ("u", at("2024-01-02T14:59"), "23:59"), (None, at("2024-01-02T14:59"), "00:00")],
        [("t", at("2024-01-01T23:35"), "08:30"), ("t", at("2024-01-02T09:00"), "08:30"), ("u", at("2024-01-02T15:00"), "23:59")],
        [("t", at("2024-01-03T05:00"), "08:30"), ("t", at("2024-01-03T05:10"), "08:30"), ("u", at("2024-01-03T14:59:30"), "23:59"), ("v", at("2024-01-03T01:00"), "09:00"), ("v", at("2024-01-03T01:00"), None)],
        [("t", at("2024-01-02T10:00"), "08:30"), ("t", at("2024-01-03T06:00"), "08:30")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        got = run(spark, tmp_path, schema, streams.deliveries, "deliveries")
    assert sorted((r.target_id, str(r.day), r.ts.strftime("%d %H:%M")) for r in got) == [("t", "2024-01-02", "01 23:40"), ("t", "2024-01-03", "03 05:00"), ("u", "2024-01-02", "02 14:59"), ("u", "2024-01-03", "03 14:59"), ("v", "2024-01-03", "03 01:00")]


def test_forgotten_targets(spark, tmp_path):
    schema = "target_id string, ts timestamp, deliver_at string"

    def short(ticks):
        return streams.deliveries(ticks, forget_days=1, watermark="1 hour")

    for rows in ([("t", at("2024-01-01T00:00"), "00:00")], [("x", at("2024-01-20T00:00"), "00:00")], [("y", at("2024-01-21T00:00"), "00:00")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        got = run(spark, tmp_path, schema, short, "forget")
    assert sorted(r.target_id for r in got) == ["t", "x", "y"]


GOOD = """# sites
---
schema: 2
name: "Games"   # of all kinds
entries:
  - name: First 'one'
    url: https://a.example.com/news  # a comment
  - url: "http://b.example.com/#x"
    name: 'It''s two'
    tags:
      - x
      - y: 1
  -
    name: third
    url: https://a.example.com/news
  - name: "  "
    url: http://c.example.com
  - name: no url
    url: ftp://c.example.com
  - just text
  - name: 12
    url: http://d.example.com
"""


def test_yaml():
    assert catalogs.parse("a: 1\nb:\n- x\n- - y\n  - z\nc:\n  d: ~\n  e: true\nf: []\n") == {"a": 1, "b": ["x", ["y", "z"]], "c": {"d": None, "e": True}, "f": []}
    assert catalogs.parse("") is None and catalogs.parse("# only\n") is None and catalogs.parse("word") == "word"
    assert catalogs.parse('a: "x \\" y: #z"\nb: http://h/#frag\nc: a # b\nd:\n') == {"a": 'x " y: #z', "b": "http://h/#frag", "c": "a", "d": None}
    for bad in ("a: {b: 1}", "a: [1]", "a: |\n  x", "a: &x 1", "a: 'x", "a: 1\na: 2", "\tа: 1", "a: 1\n   b: 2\n c: 3", "a: 1\njust text"):
        with pytest.raises(ValueError):
            catalogs.parse(bad)


def test_catalogs(spark, tmp_path):
    second = "schema: 2\nentries:\n- {name: x}\n"
    third = "schema: 2\nentries:\n- name: again\n  url: http://b.example.com/#x\n- name: own\n  url: http://own.example.com/\n"
    for name, text in (("games.yaml", GOOD), ("odd.yml", second), ("zines.yaml", third), ("old.yaml", "schema: 1\nentries: []\n"), ("empty.yaml", "\n# nothing\n"), ("none.yaml", "schema: 2\nentries:\n"), ("list.yaml", "- a\n"), ("x.txt", "schema: 2")):
        (tmp_path / name).write_text(text)
    entries = catalogs.catalogs(spark, str(tmp_path))
    got = {(r.catalog, r.pos): (r.name, r.url, r.error) for r in catalogs.across(entries).collect()}
    assert got == {
        ("games", 0): ("First 'one'", "https://a.example.com/news", None),
        ("games", 1): ("It's two", "http://b.example.com/#x", None),
        ("games", 2): ("third", "https://a.example.com/news", "URL twice"),
        ("games", 3): ("", "http://c.example.com", "no name"),
        ("games", 4): ("no url", "ftp://c.example.com", "no http URL"),
        ("games", 5): (None, None, "no mapping"),
        ("games", 6): (None, "http://d.example.com", "no name"),
        ("odd", None): (None, None, "not YAML: not read here: {name: x}"),
        ("zines", 0): ("again", "http://b.example.com/#x", "URL in games"),
        ("zines", 1): ("own", "http://own.example.com/", None),
        ("old", None): (None, None, "schema 1"),
        ("empty", None): (None, None, "no mapping"),
        ("none", None): (None, None, "entries are no list"),
        ("list", None): (None, None, "no mapping"),
    }


RSS = "<?xml version='1.0'?><rss><channel><item><title>a</title></item><item/></channel></rss>"
ATOM = "<feed xmlns='http://www.w3.org/2005/Atom'><entry/><x:entry xmlns:x='u'/></feed>"


def test_items():
    assert feeds.root_and_items(RSS) == ("rss", 2) and feeds.root_and_items(ATOM) == ("feed", 2)
    assert feeds.root_and_items("<rdf:RDF xmlns:rdf='r'><item xmlns='i'/></rdf:RDF>") == ("rss", 1)
    assert feeds.root_and_items("<rss><channel><item/><item></channel>") == ("rss", 1) and feeds.root_and_items("<rss><channel></channel></rss>") == ("rss", 0)
    assert feeds.root_and_items(" <!DOCTYPE html><rss>") == ("html", None) and feeds.root_and_items("<p>x</p>") == (None, None) and feeds.root_and_items("") == (None, None) and feeds.root_and_items("no xml") == (None, None)


def test_body_is_feed(spark):
    cases = {RSS: True, " \n<rdf:rdf>rss": True, "<?xml?><x>": False, "<html><style id='xml-viewer-style'></style><rss>": True, "<html><rss>": False, "": False, None: False}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", feeds.body_is_feed(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in got} == cases


def test_discovered(spark):
    page = """<head><link rel="alternate" type="application/rss+xml" href="/all.rss" title="All"><link rel=alternate type="text/html" href="/feedback"></head>
    <a href="/sitemap.xml">s</a><a href="x/feed?c=1">f</a><a href="/all.rss">again</a><a href="/plain">RSS here</a><a href=" ">none</a><link type="application/opensearchdescription+xml" href="/o.xml">"""
    found = spark.createDataFrame([(1, "https://www.a.example.com/b/", page), (2, "https://b.example.com/rss/?x", None), (3, "https://blog.c.example.com", "<?xml?><rss>"), (4, "https://d.example.com/newest", ""), (5, "https://e.example.com/newest", ""), (6, None, None)], "page_id int, url string, html string")
    answers = [("https://www.a.example.com/all.rss", 200, "application/xml", RSS), ("https://www.a.example.com/all.rss", 500, "text/html", "x"), ("https://b.example.com/rss/?x", 200, "text/html", "<html>"), ("https://d.example.com/newest", 200, None, ATOM), ("https://e.example.com/newest", 404, "text/xml", RSS), ("https://www.a.example.com/feed", 200, "text/xml", "<rss/>")]
    responses = spark.createDataFrame(answers, "url string, status int, content_type string, body string")
    out = feeds.discovered(found, pages.nodes(found), responses).orderBy("page_id", "place").collect()
    a = [(r.source, r.url.removeprefix("https://www.a.example.com"), r.valid, r.item_count) for r in out if r.page_id == 1]
    assert a[:5] == [("head-alternate", "/all.rss", True, 2), ("page-feed-link", "/all.rss", True, 2), ("page-feed-link", "/feedback", False, None), ("page-feed-link", "/b/x/feed?c=1", False, None), ("page-feed-link", "/plain", False, None)]
    assert a[5:] == [("page-path-fallback", f"/b{s}", False, None) for s in feeds.PAGE_SUFFIXES] + [("well-known-path", s, False, 0 if s == "/feed" else None) for s in feeds.SITE_PATHS]
    first = {r.page_id: (r.source, r.valid) for r in out if r.place == 1}
    assert first == {1: ("head-alternate", True), 2: ("input-url-feed-path", False), 3: ("input-url-feed-content", False), 4: ("input-url-feed-fetch", True), 5: ("page-path-fallback", False)}
    assert [r.url for r in out if r.page_id == 3 and r.source == "page-path-fallback"] == [f"https://blog.c.example.com{s}" for s in ("/rss.xml", "/feed", "/index.xml", "/.rss")]
