"""Gates and verdicts case by case, and every platform, article and address rule with a URL that fits it."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import diagnosis, filters, gates, sites

DIGEST = dict(page_url="https://a.example.com/list", n_json=0, n_inline=0, n_hydration=0, n_feeds=0, n_valid_feeds=0, n_pagers=0, n_id_bodies=0, n_own_links=0, nav_only=False, article_meta=False, multi_host_hub=False, first_article_url=None, clicked_url=None)
DIGEST_KIND = "page_id string, page_url string, n_json int, n_inline int, n_hydration int, n_feeds int, n_valid_feeds int, n_pagers int, n_id_bodies int, n_own_links int, nav_only boolean, article_meta boolean, multi_host_hub boolean, first_article_url string, clicked_url string"
ARTICLES, MENU = ("main li", 10, None, "/news/{n}"), ("ul li", 24, None, "/team")

#: name: (what the digest says, patterns (selector, n, sample_url, href_pattern), the gate that rejects, why articles don't dominate)
CASES = {
    "feeds": (dict(n_feeds=1, n_valid_feeds=1), [], "first_post", None),
    "nothing": ({}, [], "board_shape", "no articles"),
    "nulls": (dict(n_json=None, nav_only=None, clicked_url=None), [], "board_shape", "no articles"),
    "no host": (dict(page_url="nothing"), [], None, None),
    "articles": (dict(first_article_url="https://a.example.com/news/1"), [ARTICLES], None, None),
    "menu wins": (dict(n_json=1), [ARTICLES, MENU], "mixed_hub", "navigation dominates"),
    "articles win": (dict(n_json=1), [("main li", 25, None, "/news/{n}"), MENU], None, None),
    "one prefix": (dict(n_json=1), [ARTICLES, ("b", 6, None, "/news/some-long-slug"), MENU], None, None),
    "scattered": (dict(n_json=1), [ARTICLES, ("b", 6, None, "/story/some-long-slug"), MENU], "mixed_hub", "scattered articles"),
    "small clusters": (dict(n_json=1), [("main li", 4, None, "/news/{n}")], "mixed_hub", "no articles"),
    "own tabs": (dict(n_json=1), [ARTICLES, ("tabs a", 30, None, "/LIST/?tab=1")], None, None),
    "other hosts": (dict(n_json=1), [ARTICLES, ("x", 30, "https://b.example.com/team", None)], None, None),
    "valid feed": (dict(n_json=1, n_valid_feeds=1), [MENU], None, None),
    "announced, pager": (dict(n_json=1, page_url="https://a.example.com/news/", n_pagers=1), [MENU], None, None),
    "announced, id": (dict(n_json=1, page_url="https://a.example.com/news/", n_id_bodies=1), [MENU], None, None),
    "announced, click": (dict(n_json=1, page_url="https://a.example.com/notice", clicked_url="https://a.example.com/x/9704/"), [MENU], None, None),
    "announced, far click": (dict(n_json=1, page_url="https://a.example.com/notice", clicked_url="https://b.example.com/x/9704/"), [MENU], "mixed_hub", "no articles"),
    "announced, dense": (dict(n_json=1, page_url="https://a.example.com/news"), [MENU, ("x", 20, None, "/news/detail?id={n}-a")], None, None),
    "dense by query": (dict(n_json=1, page_url="https://a.example.com/b"), [("x", 20, None, "/b/detail?id={n}-a")], None, None),
    "ids": (dict(n_json=1), [("x", 6, None, "/v/ab12cd34ef")], None, None),
    "menu only": (dict(n_json=1, nav_only=True), [ARTICLES], "nav_only", None),
    "menu and feed": (dict(n_feeds=1, n_json=1, nav_only=True), [ARTICLES], None, None),
    "diverging": (dict(n_json=1, article_meta=True, first_article_url="https://a.example.com/story/1"), [ARTICLES], "diverging", None),
    "routers": (dict(page_url="https://a.example.com/news.php", n_json=1, article_meta=True, first_article_url="https://a.example.com/view.php/1"), [ARTICLES], None, None),
    "root": (dict(page_url="https://a.example.com/", n_json=1, article_meta=True, first_article_url="https://a.example.com/story/1"), [ARTICLES], None, None),
    "hub": (dict(n_json=1, multi_host_hub=True), [ARTICLES], "multi_host", None),
    "marketing": (dict(page_url="https://a.example.com"), [("div.Hero li", 3, None, "/x"), ("div.swiper a", 4, None, "/y")], "marketing", "no articles"),
    "marketing with posts": (dict(page_url="https://a.example.com/", first_article_url="https://a.example.com/p/1"), [("div.hero li", 3, None, "/x"), ("div.swiper a", 4, None, "/y")], "mixed_hub", "no articles"),
    "many links": (dict(page_url="https://a.example.com", n_own_links=16), [("div.hero li", 3, None, "/x"), ("div.swiper a", 4, None, "/y")], "board_shape", "no articles"),
    "challenge": (dict(clicked_url="https://a.example.com/sorry/index"), [], "board_shape", "no articles"),
    "click": (dict(clicked_url="https://a.example.com/p"), [], "mixed_hub", "no articles"),
}


def test_gates(spark):
    digests = spark.createDataFrame([(name, *({**DIGEST, **d}).values()) for name, (d, _, _, _) in CASES.items()], DIGEST_KIND)
    rows = [(name, s, n, url, href, k + 1) for name, (_, patterns, _, _) in CASES.items() for k, (s, n, url, href) in enumerate(patterns)]
    patterns = spark.createDataFrame(rows, "page_id string, selector string, n int, sample_url string, href_pattern string, place int")
    out = gates.passes(digests, patterns).collect()
    got = {r.page_id: (r.rejected_by, r.hub_reason) for r in out}
    assert got == {name: (gate, reason) for name, (_, _, gate, reason) in CASES.items()}
    assert {r.rejected_by for r in out} == {None, *gates.GATES} and all(r.passes_mixed_hub == (r.hub_reason is None) for r in out)
    assert gates.passes(digests.limit(0), patterns).count() == 0


def attempt(way, kind="OK", name="S1.H1", status=200, error=None, notable=(), final_url=None):
    return (way, name, kind, status, error, list(notable), final_url)


EMPTY = "suspiciously empty body (154 bytes)"
GONE, BOT, BASE = attempt("static", "NOT_FOUND"), attempt("static", "BLOCKED_BOT"), attempt("baseline")
#: name: (attempts, verdict, strategy's headers)
VERDICTS = {
    "static": ([BASE, attempt("static", name="S1.H3"), attempt("static", name="S1.H2"), attempt("static", "BLOCKED_BOT")], diagnosis.STATIC, "S1.H2"),
    "guarded": ([BASE, attempt("static", notable=["Cloudflare Ray ID"]), attempt("headless")], diagnosis.RENDERED, "S1.H1"),
    "captured": ([BASE, BOT, attempt("captured")], diagnosis.CAPTURED, "S1.Hcap"),
    "headless": ([BASE, BOT, attempt("headless")], diagnosis.RENDERED, "S4 (브라우저)"),
    "login redirect": ([BASE, attempt("static", "LOGIN_REQUIRED", notable=["redirected to login"])], "LOGIN_REDIRECT", "n/a"),
    "login form": ([BASE, attempt("static", "LOGIN_REQUIRED", notable=["login form"]), BOT], "LOGIN_MARKER", "n/a"),
    "login but open": ([BASE, attempt("static", "LOGIN_REQUIRED"), attempt("static")], diagnosis.STATIC, "S1.H1"),
    "protected": ([attempt("baseline", "BLOCKED_BOT"), BOT], "CLOUDFLARE_PROTECTED_SITE", "n/a"),
    "certificate": ([attempt("baseline", "UNKNOWN_ERROR", error="[SSL: x] CERTIFICATE_VERIFY_FAILED"), attempt("baseline", "UNKNOWN_ERROR"), BOT], "CERT_OR_DNS_BROKEN", "n/a"),
    "blocked": ([attempt("baseline", "HTTP_ERROR"), BOT], "BASELINE_BLOCKED", "n/a"),
    "unknown baseline": ([BOT], "BASELINE_BLOCKED", "n/a"),
    "406": ([BASE, attempt("static", "BLOCKED_BOT", status=406), attempt("static", "BLOCKED_BOT", status=406)], "WAF_406_BLOCK", "n/a"),
    "some 406": ([BASE, attempt("static", "BLOCKED_BOT", status=406), BOT], "ENTRY_BLOCKED", "n/a"),
    "moved": ([BASE, attempt("static", final_url="https://landing.example.org/"), attempt("headless", final_url="https://www.landing.example.org/")], "CROSS_HOST_REDIRECT", "S1.H1"),
    "moved once": ([BASE, attempt("static", final_url="https://landing.example.org/"), attempt("headless", final_url="https://www.site.co.kr/")], diagnosis.STATIC, "S1.H1"),
    "404 behind protection": ([attempt("baseline", "BLOCKED_BOT"), GONE, GONE], "CLOUDFLARE_PROTECTED_SITE / TARGET_NOT_FOUND", "n/a"),
    "406 and 404": ([BASE, attempt("static", "NOT_FOUND", status=406)], "WAF_406_BLOCK / TARGET_NOT_FOUND", "n/a"),
    "all gone": ([BASE, GONE, attempt("captured", "NOT_FOUND")], "TARGET_NOT_FOUND", "n/a"),
    "primary gone": ([BASE, GONE, attempt("headless", "NOT_FOUND"), attempt("captured", "BLOCKED_BOT")], "TARGET_NOT_FOUND", "n/a"),
    "most gone": ([BASE, GONE, GONE, attempt("static", "BLOCKED_BOT", notable=[EMPTY])], "TARGET_NOT_FOUND", "n/a"),
    "one gone": ([BASE, GONE, attempt("static", "BLOCKED_BOT", notable=[EMPTY])], diagnosis.PENDING, "n/a"),
    "gone and full": ([BASE, GONE, GONE, BOT], diagnosis.PENDING, "n/a"),
    "entry": ([BASE, BOT, attempt("captured", "BLOCKED_BOT")], "ENTRY_BLOCKED", "n/a"),
    "dead path": ([BASE, attempt("static", "UNKNOWN_ERROR", error="Server disconnected"), attempt("headless", "UNKNOWN_ERROR")], "STATIC_PATH_DEAD", "n/a"),
    "odd errors": ([BASE, attempt("static", "UNKNOWN_ERROR", error="odd")], diagnosis.PENDING, "n/a"),
    "external": ([BASE, BOT, attempt("external", name="E1"), attempt("paid", name="P1")], "ENTRY_BLOCKED", "n/a"),
    "shell": ([BASE, attempt("static"), attempt("captured"), attempt("headless")], diagnosis.RENDERED, "S4 (브라우저)"),
    "shell alone": ([BASE, attempt("static")], diagnosis.STATIC, "S1.H1"),
}


def test_verdicts(spark):
    rows = [(name, "http://board.site.co.kr/x", *a) for name, (attempts, _, _) in VERDICTS.items() for a in attempts]
    attempts = spark.createDataFrame(rows, "site string, site_url string, way string, name string, class string, status int, error string, notable array<string>, final_url string")
    shells = spark.createDataFrame([("shell", True), ("shell", False), ("shell alone", True), ("static", None)], "site string, insufficient boolean")
    got = {r.site: (r.verdict, r.headers) for r in diagnosis.verdicts(attempts, shells).collect()}
    assert got == {name: (verdict, headers) for name, (_, verdict, headers) in VERDICTS.items()}
    strategies = {r.site: r.strategy for r in diagnosis.verdicts(attempts).collect()}
    assert strategies["external"] == "외부 서비스 (E1)" and strategies["shell"] == "httpx (S1.H1)" and strategies["static"] == "httpx (S1.H2)"


def test_rows_of_actions(spark):
    rows = [(1, 5, 1, "이상형월드컵 시작하기"), (1, 9, 2, "Vote now! Round 1"), (2, 4, 1, "이상형월드컵 시작하기"), (3, 9, 1, "라운드"), (4, 9, 1, None)]
    got = gates.action_rows(spark.createDataFrame(rows, "page_id int, n int, place int, sample string")).collect()
    assert [(r.page_id, r.n_rows, r.sample) for r in got] == [(1, 2, "이상형월드컵 시작하기")] and "Round 1" in got[0].words and "월드컵" in got[0].words


def test_missing_parameters(spark):
    empty, board = "<table><tr><td>x</td></tr></table><a>y</a>", "http://e.go.kr/bbs/list.do?bbsId=B1"
    pages = spark.createDataFrame([(1, board, empty), (2, board, "<p>alert ('x')</p>"), (3, board + "&menuid=3", empty), (4, board, empty), (5, board, "<tr><tr><p>posts</p>"), (6, board, "<p>게시판을 선택</p>")], "page_id int, url string, html string")
    links = [(p, k, h) for p in range(1, 7) for k, h in enumerate(("?bbsId=B1&mid=7", "list.do?bbsId=B1&menuId=2", "/bbs/list.do/?mid=8&bbsId=B1", "?bbsId=B2&menuid=1", "http://o.go.kr/bbs/list.do?bbsId=B1&menuCd=1", "/other?bbsId=B1&menuCd=1"))]
    anchors = spark.createDataFrame(links, "page_id int, node int, href string")
    patterns = spark.createDataFrame([(4, 3, "http://e.go.kr/v/1"), (1, 9, ""), (2, 2, "http://e.go.kr/v/1")], "page_id int, n int, sample_url string")
    got = {r.page_id: (r.symptom, r.suggested, r.candidates) for r in gates.missing_parameters(pages, anchors, patterns).collect()}
    found = ("mid", ["http://e.go.kr/bbs/list.do?bbsId=B1&mid=7", "http://e.go.kr/bbs/list.do/?mid=8&bbsId=B1"])
    assert got == {1: ("empty_rows", *found), 2: ("auth_redirect", *found), 6: ("empty_shell", *found)}


def test_audio_hosts(spark):
    base = "https://pod.example.com/feed"
    rows = [(1, 0, base, "/e/1"), (1, 1, base, "https://x.example.net/a.mp3"), (2, 0, base, "https://share.transistor.fm/about"), (3, 0, base, "https://y.example.net/page"), (4, 0, base, "https://z.example.net/page#t"), (5, 0, base, "https://w.example.net/page"), (6, 12, base, "https://x.example.net/a.mp3")]
    candidates = spark.createDataFrame(rows, "page_id int, pos int, page_url string, url string")
    responses = spark.createDataFrame([(4, 1, "https://z.example.net/page", "audio/mpeg", 10), (5, 1, "https://w.example.net/page#x", "text/html; charset=utf-8", 900), (3, 1, "https://y.example.net/page", "text/html", 5000)], "page_id int, pos int, url string, content_type string, n_bytes long")
    got = {r.page_id: (r.host, r.confidence, r.evidence) for r in gates.audio_hosts(candidates, responses).collect()}
    assert got == {1: ("x.example.net", "structural", "url_path_audio_player"), 2: ("share.transistor.fm", "host_known", "known_host_suffix"), 4: ("z.example.net", "structural", "har_content_type_audio"), 5: ("w.example.net", "structural", "har_tiny_html_player")}


#: A URL for every platform rule in turn, with its board.
FITTING = [
    ("https://arca.live/b/abc?x", "abc"), ("https://www.clien.net/service/board/news", "news"), ("https://common.xyz/dydx/discussions", "dydx"), ("https://www.curseforge.com/minecraft/mc-mods", "mc-mods"), ("https://www.curseforge.com/minecraft/", "minecraft"),
    ("https://cafe.daum.net/x/_c21_/bbs_list?grpid=1&fldid=Z4os", "Z4os"), ("https://m.cafe.daum.net/x/ABC", "ABC"), ("https://rss.indiedb.com/news/feed/rss.xml", "indiedb"), ("https://www.moddb.com/news", "moddb"), ("https://m.dcinside.com/board/hs", "hs"),
    ("https://gall.dcinside.com/board/lists/?page=2&id=bb", "bb"), ("https://gall.dcinside.com/mgallery/board/view/?id=gfl&no=1", "gfl"), ("https://f.example.com/latest", "f.example.com"), ("https://gamebanana.com/games/7", "7"), ("https://github.com/a/b/releases", "a/b"),
    ("https://www.google.co.kr/search?tbm=nws&q=x", "x"), ("https://news.google.com/rss/topics/CAAq?hl=ko", "CAAq"), ("https://news.google.com/rss?hl=ko", None), ("https://www.biorxiv.org/content/early/recent", "bio"), ("https://cloud.google.com/release-notes", None),
    ("https://docs.anthropic.com/en/release-notes/overview", None), ("https://www.drupal.org/project/views/releases", "views"), ("https://medium.com/feed/tag/spark", "spark"), ("https://medium.com/feed/netflix", "netflix"), ("https://medium.com/netflix", "netflix"),
    ("https://n.substack.com/feed", "n"), ("https://n.substack.com/archive", "n"), ("https://www.hoyolab.com/circles/2/27/official", "2"), ("https://eurocrypt.iacr.org/2025/", "eurocrypt"), ("https://www.inven.co.kr/board/lostark/4811", "lostark"),
    ("https://l.example.com/api/v3/post/list?x", "l.example.com"), ("https://l.example.com/api/entries", "l.example.com"), ("https://en.wikipedia.org/w/index.php?title=Special:RecentChanges", "en.wikipedia.org"), ("https://blog.naver.com/PostList.naver?x=1&blogId=abc", "abc"), ("https://blog.naver.com/abc/123456789", "abc"),
    ("https://m.blog.naver.com/abc", "abc"), ("https://cafe.naver.com/f-e/cafes/30/menus/6", "30"), ("https://cafe.naver.com/ca-fe/cafes/30/articles/9?menuid=6", "30"), ("https://cafe.naver.com/ArticleList.nhn?search.clubid=31&search.menuid=2", "31"), ("https://cafe.naver.com/gutter", "gutter"),
    ("https://game.naver.com/lounge/G/board/1", "G"), ("https://forum.nexon.com/bluearchive/board_list", "bluearchive"), ("https://www.nexusmods.com/skyrim/mods/", "skyrim"), ("https://v.example.com/api/v1/videos", "v.example.com"), ("https://www.ppomppu.co.kr/zboard/zboard.php?page=1&id=freeboard", "freeboard"),
    ("https://old.reddit.com/r/java/new", "java"), ("https://bbs.ruliweb.com/news/board/1003/rss", "1003"), ("https://bbs.ruliweb.com/ps/board/300001", "300001"), ("https://popl25.sigplan.org/", "popl25"), ("https://www.stackoverflow.com/questions?tab=Newest", "stackoverflow.com"),
    ("https://s.example.com/history.atom", "s.example.com"), ("https://store.steampowered.com/feeds/news/app/570/", "570"), ("https://store.steampowered.com/news/app/570", "570"), ("https://s.example.com/story-data/all-stories.json", "s.example.com"), ("https://some.tistory.com/12", "some"),
    ("https://w.example.com/blog/wp-json/wp/v2/posts?x", "w.example.com"), ("https://x.example.com/c/forums/-/index.rss", "x.example.com"), ("https://x.example.com/index.php?forums/-/index.rss", "x.example.com"), ("https://x.example.com/whats-new/posts/", "x.example.com"),
]
#: URLs that look like a platform's and aren't a board.
UNFIT = """https://www.curseforge.com/minecraft/search https://cafe.daum.net/x/_c21_ https://cafe.daum.net/x/search https://www.desura.com/news/ https://rss.indiedb.com/games/feed/rss.xml https://www.indiedb.com/games/a/news/b https://gall.dcinside.com/board/lists/?page=2
https://localhost/latest https://www.google.com/search?tbm=nws https://docs.anthropic.com/en/docs/intro https://medium.com/feed/tag https://medium.com/about https://www.substack.com/feed https://fse.iacr.org/ https://en.wikipedia.org/wiki/Apache_Spark https://pl.wikipedia.org/wiki/Special:RecentChanges
https://blog.naver.com/PostView.naver?x=1 https://cafe.naver.com/ca-fe/cafes/30/articles/9 https://cafe.naver.com/ArticleList.nhn?search.clubid=31 https://cafe.naver.com/ca-fe https://www.nexusmods.com/skyrim/mods/12 https://www.nexusmods.com/users https://reddit.com/r/java/comments/1 https://reddit.com/r/wiki
https://bbs.ruliweb.com/pc/board/300006 https://bbs.ruliweb.com/ps/board/300001/rss https://a.example.com/questions https://m.tistory.com/1 https://some.tistory.com/category/x https://localhost/wp-json/wp/v2/posts https://a.example.com/plain""".split()


def test_every_platform_rule(spark):
    assert len(FITTING) == len(sites.PLATFORM_RULES)
    urls = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(FITTING)] + [(-1, u) for u in UNFIT] + [(-1, None), (-1, "")], "k int, url string")
    found = {r.url: (r.k, r.x) for r in urls.select("k", "url", sites.recognised(F.col("url")).alias("x")).collect()}
    for url, (k, x) in found.items():
        assert (x and (x.platform, x.board)) == ((sites.PLATFORM_RULES[k].name, FITTING[k][1]) if k >= 0 else None), url
    for k, (url, board) in enumerate(FITTING):  # each rule by itself, not only those that come first
        assert spark.range(1).select(sites.recognised(F.lit(url), [sites.PLATFORM_RULES[k]]).alias("x")).first().x.board == board
    assert list(dict.fromkeys(r.name for r in sites.PLATFORM_RULES)) == sorted({r.name for r in sites.PLATFORM_RULES})


#: rule, URLs of articles, whether nothing is learned, URLs that pass.
SINGLE = [
    ("wikipedia", ["https://ko.wikipedia.org/wiki/%EC%99%95%EC%88%98%EC%9D%B8", "https://en.wikipedia.org/wiki/Some_Party"], True, ["https://en.wikipedia.org/wiki/Special:RecentChanges?limit=50", "https://ko.wikipedia.org/wiki/%EB%B6%84%EB%A5%98:%ED%95%9C%EA%B5%AD", "https://ko.wikipedia.org/wiki/분류:한국", "https://de.wikipedia.org/wiki/Spezial:Letzte_%C3%84nderungen", "https://en.wikipedia.org/wiki/Main_Page", "https://en.wikipediaa.org/wiki/Test"]),
    ("terms", ["https://terms.naver.com/entry.naver?docId=1"], False, ["https://terms.naver.com/list.naver"]),
    ("britannica", ["https://www.britannica.com/topic/painting"], False, ["https://www.britannica.com/"]),
    ("ushmm", ["https://encyclopedia.ushmm.org/content/en/article/x"], True, ["https://encyclopedia.ushmm.org/content/en"]),
    ("nature", ["https://www.nature.com/articles/s41586-1"], True, ["https://www.nature.com/articles?type=news"]),
    ("iln-ieee", ["https://iln.ieee.org/Public/ContentDetails.aspx?id=1"], True, ["https://iln.ieee.org/Public/Catalog.aspx"]),
    ("jobplanet", ["https://www.jobplanet.co.kr/contents/news-12"], True, ["https://www.jobplanet.co.kr/contents/news"]),
    ("mozilla", ["https://developer.mozilla.org/en-US/docs/Web"], True, ["https://developer.mozilla.org/en-US/blog/"]),
    ("github-wiki", ["https://github-wiki-see.page/m/a/b/wiki/Home"], False, ["https://github-wiki-see.page/"]),
    ("ktword", ["http://www.ktword.co.kr/test/view/view.php?no=1"], False, ["http://www.ktword.co.kr/"]),
    ("openai", ["https://openai.com/index/some%2Dthing"], False, ["https://openai.com/news/"]),
    ("sumo", ["https://sumo.dlr.de/docs/index.html"], False, ["https://sumo.dlr.de/"]),
    ("tistory", ["https://www.tistory.com/", "https://tistory.com/", "https://www.tistory.com/?category=travel"], True, ["https://some.tistory.com/1976"]),
]


def test_every_article_rule(spark):
    assert [s[0] for s in SINGLE] == [r[0] for r in sites.ARTICLE_RULES]
    rows = [(u, name, skip) for name, hits, skip, _ in SINGLE for u in hits] + [(u, None, None) for *_, passing in SINGLE for u in passing]
    found = spark.createDataFrame(rows, "url string, rule string, skip boolean").select("*", sites.single_article(F.col("url")).alias("x")).collect()
    assert [(r.url, r.x and r.x.rule, r.x and r.x.skip_learning) for r in found] == rows


ADDRESSES = """::1 :: 0:0:0:0:0:0:0:1 ::ffff:10.0.0.1 ::ffff:a00:1 ::ffff:100.64.0.1 ::ffff:8.8.8.8 fe80::1 fd12:3456::1 fec0::1 ff02::1 2002:7f00:1:: 2606:4700::1111 2001:db8::1 2001::1 2001:20::1 2001:1::1 2001:1::3 2001:3::9
2001:4:112::1 2001:200::1 3fff::1 4000::1 64:ff9b::1 100::1 200::1 fe00::1 2a00:1450:4001:81b::200e 2001:0DB8:0:0:0:0:0:1""".split()


@pytest.mark.parametrize("zone", ["", "%25eth0"])
def test_addresses(spark, zone):
    """As Python's own library reads them, whatever the spelling."""

    def private(text):
        ip = ipaddress.ip_address(text)
        return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified

    out = spark.createDataFrame([(a,) for a in ADDRESSES], "a string").select("a", filters.url_problem(F.concat(F.lit("http://["), "a", F.lit(f"{zone}]:80/x"))).alias("p"), filters.written_out(F.col("a")).alias("w")).collect()
    assert {r.a: r.p for r in out} == {a: "private address" if private(a) else "address" for a in ADDRESSES}
    assert {r.a: r.w for r in out} == {a: ipaddress.ip_address(a).packed.hex() for a in ADDRESSES}
    bad = spark.createDataFrame([("1:2:3",), (":::",), ("::1::",), ("::ffff:300.1.1.1",), ("12345::",), ("",)], "a string").select(filters.written_out(F.col("a")).alias("w")).collect()
    assert [r.w for r in bad] == [None] * 6


def test_site_findings(spark):
    """Every finding, a healthy site, and one of which nothing is known."""
    import datetime as dt

    now = dt.datetime(2024, 1, 20, 12)
    sites_ = [
        ("fine", False, True, ["category"], "http://a/b?category=1", 0, 2, now, 9),
        ("bad", True, False, None, "http://a/b?x=1", 2, 3, now - dt.timedelta(hours=25), 0),
        ("disjoint", False, True, ["page"], "http://a/b", 0, 0, None, 1),
        ("unknown", None, None, None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(sites_, "slug string, failed boolean, has_config boolean, config_keys array<string>, job_url string, breakage int, body_empty_streak int, last_poll_at timestamp, n_baseline int")
    subs = [(1, "fine", "http://a/b?category=1", "t1", now - dt.timedelta(days=30)), (2, "disjoint", "http://a/b?y=&page=2", "t1", now - dt.timedelta(days=8)), (3, "disjoint", "http://a/b?z=2#f", "t2", now - dt.timedelta(days=6)), (4, "disjoint", "http://a/b?w=2", "t3", now - dt.timedelta(days=7))]
    subscriptions = spark.createDataFrame(subs, "id long, slug string, url string, target_id string, created_at timestamp")
    deliveries = spark.createDataFrame([("fine", "t1", "sent"), ("disjoint", "t1", "filtered"), ("disjoint", "t3", "sent")], "slug string, target_id string, kind string")
    sampled = spark.createDataFrame([("fine",), ("bad",), ("disjoint",)], "slug string")
    samples = spark.createDataFrame([("fine", "1", 5), ("fine", "2", 0), ("disjoint", "7", 0), ("disjoint", "7", None)], "slug string, post_id string, body_chars int")
    got = [tuple(r) for r in diagnosis.site_findings(frame, subscriptions, deliveries, sampled, samples, F.lit(now)).orderBy("slug", "place").collect()]
    assert [g[:1] + g[2:] for g in got] == [
        ("bad", "error", "auto_register_failed", None), ("bad", "error", "body_empty_drift", "3"), ("bad", "error", "breakage_signal", "2"), ("bad", "error", "config_missing", None), ("bad", "error", "fetch_sim_empty", None),
        ("bad", "warn", "query_kwargs_mismatch", "http://a/b?x=1"), ("bad", "warn", "stale_poll", "2024-01-19 11:00:00"), ("bad", "info", "empty_baseline", None),
        ("disjoint", "error", "fetch_sim_same_id", "7"), ("disjoint", "warn", "article_body_empty", "1"), ("disjoint", "warn", "never_delivered", "t1"), ("disjoint", "info", "query_kwargs_keys_disjoint", "http://a/b?z=2#f"),
    ]


def test_rejection_groups(spark):
    cases = {"verdict target_not_found": "exclude", "HTTP 404 of all": "exclude", "Cloudflare page": "blocked", "BASELINE_BLOCKED": "blocked", "blocked, cert_or_dns_broken": "exclude", "an article": "content", None: "content"}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", sites.rejection_group(F.col("t")).alias("g")).collect()
    assert {r.t: r.g for r in got} == cases
