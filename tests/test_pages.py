"""Selectors, scans and page structure against inline pages."""

import pytest

from tidewatch.functions import dom
from tidewatch.operators import classify, extract, pages
from tidewatch.plans import catalogue, site_queries
from pyspark.sql import functions as F

PAGE = """<html><head><title>T &amp; U</title><link rel="alternate" type="application/rss+xml" href="/feed.xml"><meta property="og:type" content="article"></head>
<body><ul id=list><li class="row notice"><a href="/v/1">One <b>bold</b></a><span class=d>2024/01/02</span>
<li class=row><a href="/v/2">Two</a><span class=d>2024/01/03</span><li class=row><a href="javascript:x()">Three</a><li class="row ad"><a href="/v/4">Four</a></ul>
<p>first<p>second <a href="/list/page/2">2</a><a href="/list/page/3">3</a><a href="?page=4">4</a><br>end<script>var rows = [{"id":1,"s":"]"}]; q.push({a:1})</script></body></html>"""


@pytest.mark.parametrize(
    ("selector", "n"),
    [
        ("li", 4), ("li.row.notice", 1), ("#list > li", 4), ("ul a[href^='/v/']", 3), ("li:not(.ad)", 3), ("li:has(span)", 2), ("li:nth-child(2)", 1), ("li:nth-child(odd)", 2),
        ("li:first-child a, li:last-child a", 2), ("li + li", 3), ("a ~ span", 2), ("a[href*=page]", 3), ("p", 2), ("html head > title", 1), ("span.d", 2), ("*", 26),
    ],
)
def test_selectors(selector, n):
    found = list(dom.select(dom.parse(PAGE), dom.compile_selector(selector)))
    assert len(found) == n if selector != "*" else len(found) >= 20


@pytest.mark.parametrize("selector", ["li:contains('x')", "a >", "[", "li::before", ""])
def test_selectors_refused(selector):
    with pytest.raises(ValueError, match="not supported"):
        dom.compile_selector(selector)


SPEC = {
    "row_selector": "li.row",
    "row_required_selector": "a",
    "exclude_selector": ".ad",
    "fields": {
        "post_id": {"from": "attr", "selector": "a", "attr": "href", "transform": [["regex_extract", "/v/([0-9]+)"]]},
        "title": [{"from": "css", "selector": "h9"}, {"from": "css", "selector": "a"}],
        "published_at": {"from": "css", "selector": ".d", "transform": [["date_only_to_iso", "+09:00"]]},
        "url": {"from": "template", "value": "http://{site}/v/{post_id}"},
        "pinned": {"from": "class_present", "selector": "", "class": "notice"},
        "label": {"from": "concat", "parts": [{"const": "#"}, {"field": "post_id"}]},
    },
}


def test_scan_html(spark):
    page = spark.createDataFrame([(1, "http://s/l", PAGE), (2, "http://s/e", None)], "page_id long, url string, html string")
    got = extract.scan_html(page, SPEC, site="s").orderBy("row_no").collect()
    assert [(r.post_id, r.title, r.published_at, r.url) for r in got] == [("1", "One bold", "2024-01-02T00:00:00+09:00", "http://s/v/1"), ("2", "Two", "2024-01-03T00:00:00+09:00", "http://s/v/2")]
    assert got[0].raw == {"pinned": "true", "label": "#1"}
    assert extract.scan_html(page, SPEC, site="s", page_size=1).count() == 1


def test_scan_json(spark):
    spec = {"success_when": {"path": ["ok"], "equals": "true"}, "list_path": ["data"], "type_field": "t", "type_allow": ["post"], "fields": {"post_id": {"from": "json", "path": ["id"]}, "title": {"from": "json", "path": ["names", -1]}}}
    rows = [(1, '{"ok":true,"data":[{"id":5,"t":"post","names":["a","b"]},{"id":6,"t":"ad","names":[]},{"id":null,"t":"post"}]}'), (2, '{"ok":false,"data":[{"id":9,"t":"post"}]}')]
    got = extract.scan_json(spark.createDataFrame(rows, "page_id long, body string"), spec).collect()
    assert [(r.page_id, r.post_id, r.title) for r in got] == [(1, "5", "b")]
    by_key = {"list_path": ["data"], "list_values": True, "item_subpath": ["x"], "fields": {"post_id": {"from": "json", "path": ["id"]}, "title": {"from": "const", "value": "c"}}}
    got = extract.scan_json(spark.createDataFrame([(1, '{"data":{"k1":{"x":{"id":"a"}},"k2":{"x":{"id":"b"}}}}')], "page_id long, body string"), by_key).collect()
    assert sorted((r.post_id, r.title) for r in got) == [("a", "c"), ("b", "c")]


def test_specifications_are_checked():
    with pytest.raises(ValueError, match="required"):
        extract.check({"fields": {"title": {"from": "const", "value": "x"}}})
    with pytest.raises(ValueError, match="before they are known"):
        extract.check({"fields": {"post_id": {"from": "template", "value": "{title}"}, "title": {"from": "const", "value": "x"}}})


def test_structure(spark):
    nodes = pages.nodes(spark.createDataFrame([(1, PAGE)], "page_id long, html string")).cache()
    best = pages.repeating_patterns(nodes).orderBy("place").first()
    assert (best.selector, best.n, best.href_pattern) == ("#list > li.row", 2, "/v/{n}") or best.n >= 3
    assert [tuple(r) for r in pages.feed_links(nodes).collect()] == [(1, "/feed.xml", "link_rel")]
    hints = {(r.kind, r.name) for r in pages.pager_hints(nodes).collect()}
    assert hints == {("query", "page"), ("path", "/list/page/")}
    meta = pages.meta_signals(nodes).first()
    assert (meta.og_type, meta.title) == ("article", "T & U")
    inline = {(r.kind, r.json) for r in pages.inline_data(spark.createDataFrame([(1, PAGE)], "page_id long, html string")).collect()}
    assert inline == {("array", '[{"id":1,"s":"]"}]'), ("push", "{a:1}")}


def test_pagers_of_all_links(spark):
    """Pagers behind 500 other links, more than eight of them, and numbers of the path's own end."""
    names = ["page", "p", "pg", "offset", "start", "skip", "cursor", "_page", "page_num"]
    links = ["/x"] * 600 + [f"?{n}=2" for n in names] + [f"/l{k}/page/{n}" for k in range(12) for n in (2, 3)] + ["/one/page/7", "/one/page/7?x=1", "/page/1/of/page/2", "/page/1/of/page/3"]
    nodes = pages.nodes(spark.createDataFrame([(1, "".join(f'<a href="{x}">x</a>' for x in links)), (2, "<p>none")], "page_id long, html string"), *pages.HINT_COLUMNS, wanted=pages.hinting)
    got = [tuple(r) for r in pages.pager_hints(nodes).collect()]
    assert sorted(got) == sorted([(1, "query", n) for n in names] + [(1, "path", f"/l{k}/page/") for k in range(12)] + [(1, "path", "/page/1/of/page/")])


def test_hints_of_queries(spark):
    """Feeds and pagers of pages of any length come out of one scan, and are those of feed_links and pager_hints."""
    links = ["/x"] * 600 + [f"/l{k}/page/{n}" for k in range(12) for n in (2, 3)] + ["?p=1", "/rss/all", "/feed.xml"]
    html = '<link rel="x Alternate" type="application/RSS+xml" href="/feed.xml"><link rel=alternate type=text/html href="/feed"><link rel=alternate type="application/atom+xml"><link href="?p=2">' + "".join(f'<a href="{x}">x</a>' for x in links) + "<a>none</a>"
    made = spark.createDataFrame([(1, "http://s/x?page=1", html), (2, "http://s/x", "<p>none"), (3, "http://s/x", None)], "page_id long, url string, html string")
    wanted = {(1, "feed", "/feed.xml"), (1, "feed", "/rss/all"), (1, "query", "p")} | {(1, "path", f"/l{k}/page/") for k in range(12)}
    nodes = pages.nodes(made)
    apart = pages.feed_links(nodes).selectExpr("page_id", "'feed' AS kind", "href").union(pages.pager_hints(nodes))
    assert sorted(map(tuple, apart.collect())) == sorted(wanted)
    assert {(r.href, r.source) for r in pages.feed_links(nodes).collect()} == {("/feed.xml", "link_rel"), ("/rss/all", "html_body")}
    for found, more in ((site_queries.site_hints(made), set()), (catalogue.feed_and_pager_hints(made.withColumnRenamed("page_id", "entry_id")), {(1, "query", "page")})):
        assert sorted(map(tuple, found.collect())) == sorted(wanted | more)
        assert found._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1


def test_long_texts(spark):
    """Types behind the first 120 characters, in lists and graphs, of any article type; link texts and titles are whole."""
    scripts = [
        '{"@context": "https://schema.org", "headline": "' + "h" * 300 + '", "@type": "NewsArticle"}',
        '{"@graph": [{"name": "' + "n" * 200 + '"}, {"@type": ["Thing", "Report"]}]}',
        '{"@type": "Review"}',
        '{"@type": "Organization", "name": "an Article"}',
        '{"@type": "Article"',
    ]
    text = "w" * 500
    rows = [(k, f'<title>{text}</title><script type="application/LD+JSON">{x}</script><a href="/a">{text}</a>') for k, x in enumerate(scripts)]
    nodes = pages.nodes(spark.createDataFrame([*rows, (9, "<p>x")], "page_id long, html string"))
    found = {r.page_id: r for r in pages.meta_signals(nodes).collect()}
    assert [bool(found[k].has_article_ld) for k in (*range(5), 9)] == [True, True, True, False, False, False]
    assert found[0].title == text and {r.text for r in pages.links(nodes).collect()} == {text}


def test_texts(spark):
    row = spark.createDataFrame([(PAGE,)], "h string").select(pages.page_text(F.col("h")).alias("t"), pages.cleaned_html(F.col("h"), 300).alias("c"), pages.platforms(F.lit("x wp-content y")).alias("p"), pages.hydration(F.lit('<script id="__NEXT_DATA__" type="a">{"a":1}</script>')).alias("j")).first()
    assert "second" in row.t and "push" not in row.t and "T & U" in row.t
    assert row.c.endswith(">") and len(row.c) <= 300 and row.p == ["wordpress"] and row.j == '{"a":1}'


@pytest.mark.parametrize(
    ("status", "body", "url", "headers", "wanted"),
    [
        (200, "x" * 300, "http://a/", {}, "OK"),
        (200, "x", "http://a/", {}, "BLOCKED_BOT"),
        (200, "x" * 300, "http://a/login", {}, "LOGIN_REQUIRED"),
        (200, "please log in to view this " + "x" * 300, "http://a/", {}, "LOGIN_REQUIRED"),
        (404, "x", "http://a/", {}, "NOT_FOUND"),
        (451, "x", "http://a/", {}, "BLOCKED_GEO"),
        (200, "<script src=cdn-cgi/challenge-platform/x></script>" + "x" * 300, "http://a/", {}, "BLOCKED_BOT"),
        (403, "", "http://a/", {}, "NOT_FOUND"),
        (403, "x" * 300, "http://a/", {"retry-after": "1"}, "BLOCKED_BOT"),
        (429, "y" * 300, "http://a/", {}, "BLOCKED_BOT"),
        (500, "z" * 900, "http://a/", {}, "UNKNOWN_ERROR"),
    ],
)
def test_responses(spark, status, body, url, headers, wanted):
    df = spark.createDataFrame([(status, body, url, headers)], "s int, b string, u string, h map<string,string>")
    f = F.lit(False)
    assert df.select(classify.response(F.col("s"), F.col("b"), F.col("u"), F.col("h"), f, F.lit(None).cast("string"), f, f, f).alias("c")).first().c == wanted


@pytest.mark.parametrize(
    ("status", "rc", "tail", "wanted"),
    [
        ("pending", None, None, ("pending", None)),
        ("done", 0, "", ("done", None)),
        ("failed", 1, "[FAIL] title_nonempty\n[FAIL] posts_nonempty UNAVAILABLE", ("gen_fail", "posts_nonempty")),
        ("failed", 1, "[FAIL] brand_new", ("gen_fail", "brand_new")),
        ("failed", 1, "Expecting value UNAVAILABLE", ("gen_fail", "llm_parse")),
        ("rejected", 2, "SOFT_404", ("url_dead", "soft_404")),
        ("rejected", 2, "LOGIN_REQUIRED", ("policy_reject", "login_required")),
        ("rejected", 3, "recognize_reject (wiki_article)", ("gate_reject", "recognizer:wiki_article")),
        ("failed", 5, "CLOUDFLARE", ("capability_blocked", "cloudflare")),
        ("failed", -2, "", ("bug", "subprocess_timeout")),
        ("failed", 0, "", ("bug", "registered_but_no_state")),
    ],
)
def test_failures(spark, status, rc, tail, wanted):
    kind, sub = classify.failure(F.col("s"), F.col("r"), F.col("t"))
    assert tuple(spark.createDataFrame([(status, rc, tail)], "s string, r int, t string").select(kind, sub).first()) == wanted
