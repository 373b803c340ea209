"""Pagers and feeds of pages and their requests, static pages beside rendered ones."""

from pyspark.sql import functions as F

from tidewatch.operators import pages, traffic

BASE = "https://a.example.com/news?id=7"
REQUEST = "page_id int, pos int, url string, resource_type string, content_type string, body string"


def pages_of(spark, *html, base=BASE):
    return spark.createDataFrame([(k, base, h) for k, h in enumerate(html)], "page_id int, url string, html string")


def test_templates(spark):
    cases = {("https://a/x?id=1&Page=2&q=%20#f", "page"): "https://a/x?id=1&Page={page}&q=%20", ("https://a/x", "p"): "https://a/x?p={page}", ("https://a/x?q=1", "p"): "https://a/x?q=1&p={page}"}
    got = spark.createDataFrame(list(cases), "u string, p string").select("u", "p", traffic.query_template(F.col("u"), F.col("p")).alias("t")).collect()
    assert {(r.u, r.p): r.t for r in got} == cases
    paths = {"https://a/n/page/2/": "https://a/n/page/{page}/", "https://a/n/page/2?x=1#f": "https://a/n/page/{page}?x=1"}
    got = spark.createDataFrame([(u,) for u in paths], "u string").select("u", traffic.path_template(F.col("u")).alias("t")).collect()
    assert {r.u: r.t for r in got} == paths


def test_pager_hints(spark):
    links = '<a href="?id=7&page=2">2</a><a href="?id=7&page=3">3</a><a href="/news/page/2">2</a><a href="/news/page/3">3</a><a href="/only/page/9">9</a><a href="https://b.example.com/x/page/1">o</a><a href="https://b.example.com/x/page/2">o</a>'
    pager = '<div class="big pager"><p><a href="/old/page/5/">next</a></p></div>'
    found = pages_of(spark, links + pager, "<p>none</p>", "".join(f'<a href="/l{k}?p={k}">x</a>' for k in range(12)), None)
    rows = [
        (0, 0, "https://api.example.net/list?cursor=5", "xhr", "application/json", None),
        (0, 1, "https://api.example.net/list?cursor=6", "fetch", None, None),
        (0, 2, "https://api.example.net/collect?offset=6", "xhr", None, None),
        (0, 3, "https://a.example.com/x.js?start=1", None, "application/json", None),
        (0, 4, "https://a.example.com/api/x?skip=1", None, None, None),
        (0, 5, "https://a.example.com/doc?pg=1", "document", "text/html", None),
        (1, 0, "https://a.example.com/x?page=1", None, "text/html", None),
    ]
    out = traffic.pager_hints(found, pages.nodes(found), spark.createDataFrame(rows, REQUEST)).orderBy("page_id", "place").collect()
    assert [(r.place, r.kind, r.param, r.url_template, r.source) for r in out if r.page_id == 0] == [
        (1, "query_param", "page", "https://a.example.com/news?id=7&page={page}", "html_anchor"),
        (2, "path_segment", "page", "https://a.example.com/news/page/{page}", "html_anchor"),
        (3, "path_segment", "page", "https://a.example.com/old/page/{page}/", "html_anchor"),
        (4, "query_param", "cursor", "https://a.example.com/news?id=7&cursor={page}", "har_xhr"),
        (5, "query_param", "skip", "https://a.example.com/news?id=7&skip={page}", "har_xhr"),
    ]
    assert [r.evidence_url for r in out if r.page_id == 0][3] == "https://api.example.net/list?cursor=5"
    assert {r.page_id for r in out} == {0, 2} and len([r for r in out if r.page_id == 2]) == 8


def test_feed_urls(spark):
    found = pages_of(spark, '<link rel="alternate" type="application/rss+xml" href="/a.rss"><a href="/rss/x">x</a><a href="a.rss">again</a><a href="/feedback">no</a><a href="?rss=1">no</a>')
    rows = [(0, 0, "https://a.example.com/a.rss", "xhr", "application/xml", "<rss>"), (0, 1, "https://a.example.com/f", "xhr", "text/xml; charset=utf-8", "<?xml version='1.0'?>\n<feed>"), (0, 2, "https://a.example.com/g", "xhr", "text/html", "<rss>"), (0, 3, "https://a.example.com/h", "xhr", "text/xml", "<x>")]
    got = traffic.feed_urls(found, pages.nodes(found), spark.createDataFrame(rows, REQUEST)).collect()
    assert {(r.url.removeprefix("https://a.example.com"), r.source, r.type) for r in got} == {("/a.rss", "link_rel", "application/rss+xml"), ("/rss/x", "html_body", None), ("/f", "har_resp_xml", "text/xml; charset=utf-8")}


def test_rendering(spark):
    shell, rows = "<html><body><div id=app></div></body></html>" + " " * 300, "".join(f'<li class="t" data-id={k}><a href="/v/{k}">title {k}</a></li>' for k in range(25))
    filler = "<p>" + "text " * 400 + "</p>"
    static = {0: shell, 1: filler + "<ul></ul>", 2: f"<ul>{rows}</ul>", 3: "", 4: shell, 6: filler + "<ul>" + rows[: len(rows) // 5] + "</ul>"}
    rendered = {0: f"<body><ul>{rows}</ul></body>", 1: filler + f"<ul>{rows}</ul>", 2: f"<ul>{rows}</ul>", 3: rows, 4: shell + filler * 2, 5: rows, 6: filler + f"<ul>{rows}</ul>"}
    frames = [spark.createDataFrame(list(x.items()), "page_id int, html string") for x in (static, rendered)]
    got = {r.page_id: r for r in traffic.rendering(*frames).collect()}
    assert {k: (r.trigger_rule, r.insufficient) for k, r in got.items()} == {0: ("size", True), 1: ("repeat", True), 2: (None, False), 3: (None, False), 4: (None, False), 5: (None, False), 6: ("repeat", True)}
    assert (got[0].static_rows, got[0].rendered_rows, got[0].repeat_drawn) == (0, 50, 25) and got[3].ratio == 0 and got[2].repeat_static == 25 and got[6].repeat_drawn == 20
