"""Addresses out of handlers, classes of components, folded pages, portfolios."""

from collections import Counter

from pyspark.sql import functions as F

from tidewatch.functions import dom
from tidewatch.operators import markup, pages


def frame(spark, *found):
    return spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(found)], "page_id long, url string, html string")


def test_templates(spark):
    expressions = {
        "'/v?seq=' + seq + '&m=1'": "/v?seq={post_id}&m=1",
        '"/v/" + data.seq': "/v/{post_id}",
        "'/v/' + other": None,
        "'/v/' + encodeURIComponent(seq)": None,
        "'/v/'": None,
        "seq": None,
        "'/a' + '/b'": None,
        "'/v?n=' + \n seq": "/v?n={post_id}",
    }
    rows = spark.createDataFrame([(e,) for e in expressions], "e string").select("e", markup.template(F.col("e"), F.lit("seq")).alias("t")).collect()
    assert {r.e: r.t for r in rows} == expressions


def test_detail_templates(spark):
    html = """<html><head><script>
    function goView(seq) { location.href = '/notice/view.do?seq=' + seq + '&menuCd=M1'; }
    function goView(seq) { location.href = '/notice/view.do?seq=' + seq + '&menuCd=M1'; }
    function other(x) { window.location = "view/" + x; }
    function unused(x) { location.href = '/x?x=' + x; }
    function odd(x) { if (x) { location.href = '/x?x=' + x; } }
    function none() { location.href = '/x'; }
    function form(x) { document.f.submit(); }
    </script></head><body><ul>
      <li><a href="javascript:goView('12345')">first</a></li><li><a href="javascript:goView(12346)">second</a></li><li><a href="javascript:goView('7')">third</a></li></ul>
      <p onclick="other(9); return false;">x</p><b onclick="form(1)">f</b><i onclick="none('z')">n</i></body></html>"""
    found = frame(spark, ("https://www.k.or.kr/a/list.do?menuCd=M1", html), ("https://x.test/list.do", '<a href="/view.do?no=1">x</a>'), ("https://x.test/", None))
    nodes = pages.nodes(found)
    templates = markup.detail_templates(found, nodes)
    got = [(r.page_id, r.function, r.sample_id, r.detail_url_template) for r in templates.orderBy("page_id", "pos").collect()]
    assert got == [(0, "goView", "12345", "https://www.k.or.kr/notice/view.do?seq={post_id}&menuCd=M1"), (0, "other", "9", "https://www.k.or.kr/a/view/{post_id}")]
    patterns = markup.with_templates(pages.repeating_patterns(nodes, found), templates).collect()
    assert [(r.selector, r.n, r.calls, r.detail_url_template) for r in patterns] == [("ul > li", 3, ["goView"], got[0][3])]


def test_component_classes(spark):
    css = "@media x { .lost { } .topic-row .topic-title { } } .topic-row:hover, .topic-row.mt-3 .topic-body { } .topic-row > .topic-title { } .container .topic-body { } .once { } .ab { }"
    html = f"<style>{css}</style><style>.x</style><div class='topic-row a'></div><div class='topic-row'></div><p class='topic-title'>"
    found = frame(spark, ("u", html), ("u", "<p>none</p>"), ("u", None))
    got = markup.component_classes(found, pages.nodes(found)).orderBy("place").collect()
    assert [(r.page_id, r["class"], r.rule_count, r.co_classes, r.n_used) for r in got] == [(0, "topic-row", 3, ["topic-title", "topic-body"], 2), (0, "topic-body", 2, ["topic-row"], 0), (0, "topic-title", 2, ["topic-row"], 1)]
    many = "".join(f".klass-{chr(97 + k)}{{}}" * (k % 5 + 1) for k in range(12))
    top = markup.component_classes(frame(spark, ("u", f"<style>{many}</style>"))).orderBy("place").collect()
    assert len(top) == 8 and [r.rule_count for r in top] == [5, 5, 4, 4, 3, 3, 2, 2] and top[0]["class"] == "klass-e"


def test_folding():
    rows = "".join(f'<li class="row" data-id="{k}"><a href="/v/{k}">{"t" * 300}{k} &amp; x</a></li>' for k in range(10))
    source = f'<html><head><title>t</title></head><body class="b"><ul><li class="row pinned"><a href="/p">p</a></li>{rows}</ul><p data-long="{"v" * 200}" data-num="{"7" * 200}" id="{"i" * 200}">{"w" * 500}</p><br><div>\n\n\n\n   x    y</div></body></html>'
    got = markup.folded(source)
    tree = dom.parse(got)
    assert got.startswith('<body class="b">') and got.count("<!-- collapsed 7 similar <li.row> -->") == 1
    kept = [n.attrs["href"] for n in tree.walk() if n.tag == "a"]
    assert kept == ["/p", "/v/0", "/v/1", "/v/2"]
    assert all(len(n.text()) > 300 and n.text().endswith("& x") for n in tree.walk() if n.tag == "a" and n.attrs["href"] != "/p")
    p = next(n for n in tree.walk() if n.tag == "p")
    assert p.attrs == {"data-long": "v" * 80 + "…", "data-num": "7" * 200, "id": "i" * 200} and p.text() == "w" * 200 + "…"
    assert "\n\n\n" not in got and "x y" in got and len(got) < len(source) / 2
    # nothing but what the rule folds is lost
    before, after = (Counter((n.tag, tuple(n.classes)) for n in t.walk()) for t in (next(n for n in dom.parse(source).walk() if n.tag == "body"), next(n for n in tree.walk() if n.tag == "body")))
    assert before - after == Counter({("li", ("row",)): 7, ("a", ()): 7})
    assert markup.folded("") == "" and markup.folded("plain &lt; text") == "plain &lt; text"
    assert markup.folded("<div>" * 3000 + "deep").count("<div>") == 3000


def test_folded_pages(spark):
    got = markup.folded_pages(frame(spark, ("u", None), ("u", "<body><p>x</p></body>"))).orderBy("page_id").collect()
    assert [r.folded for r in got] == ["", "<body><p>x</p></body>"]


def test_portfolios(spark):
    links = '<a href="/trust">t</a><a href="/crowds/">c</a><a href="https://ncase.example.me/polygons">p</a><a href="/about">a</a>'
    blog, title = '<a href="//blog.ncase.example.me/">blog</a>', "<title>It's Nicky Case!</title>"
    cases = {
        "whole": ("https://www.ncase.example.me/", title + links + blog, "//blog"),
        "heading": ("https://ncase.example.me", "<h1>Name | name</h1>" + links + '<a href="/blog/1">b</a>', "/blog/1"),
        "two projects": ("https://ncase.example.me/", title + links.replace("/crowds/", "/trust") + blog, None),
        "no blog": ("https://ncase.example.me/", title + links, None),
        "no title": ("https://ncase.example.me/", "<title>News</title>" + links + blog, None),
        "no root": ("https://ncase.example.me/x", title + links + blog, None),
        "dated": ("https://ncase.example.me/", title + links.replace("trust", "post-2024") + blog, None),
    }
    found = frame(spark, *(c[:2] for c in cases.values()))
    got = {r.page_id: r for r in markup.portfolios(found, pages.nodes(found)).collect()}
    assert set(got) == {0, 1} and got[0].n_projects == 3 and got[0].blog_link == "https://blog.ncase.example.me/" and got[1].blog_link == "https://ncase.example.me/blog/1" and got[0].title == "It's Nicky Case!"


def test_tree_lists(spark):
    rows = "".join(f"<li><a href=/v/{k}>t{k}</a><span>d{k}</span></li>" for k in range(5))
    page = f"<html><body><h1>Head</h1><div><p>one</p></div><div><ul>{rows}</ul></div></body></html>"
    got = markup.tree_lists(frame(spark, ("u", page), ("u", None), ("u", "plain"))).collect()
    # links and dates meet in the list; the paragraphs' only element and the heading stand for themselves
    assert [(r.page_id, r.place, r.path, r.n_children, r.n_linked) for r in got] == [(0, 1, "/html/body/div[2]/ul", 5, 5), (0, 2, "/html/body/h1", 0, 0), (0, 3, "/html/body/div[1]/p", 0, 0)]
    assert len(markup.tree_candidates("".join(f"<s{k}>x</s{k}>" for k in range(30)))) == 10
