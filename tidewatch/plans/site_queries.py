"""Queries about what sites, their pages and their candidates look like, over tables that hold every case."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import jsonwalk, urls
from tidewatch.operators import classify, filters, joins, pages, reports, sites, state, windows
from tidewatch.streaming import posts as streams

from .catalogue import NOW, query, text


def _pick(values, column="entry_id"):
    """One of the values by a column's number."""
    return F.element_at(F.array(*(v if not isinstance(v, (str, int, type(None))) else F.lit(v) for v in values)), (F.col(column) % len(values) + 1).cast("int"))


def _case(values, column="entry_id"):
    quoted = ["NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in values]
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(quoted)) + " END"


# --- pages ----------------------------------------------------------------------------------------------------------------------


@query("sites", sql="SELECT page_id, 'Site ' || page_id || ' & Co' AS title, CASE WHEN page_id % 3 = 0 THEN 'article' END AS og_type, page_id % 4 = 1 AS has_article_ld, page_id % 7 = 3 AS has_microdata FROM sites")
def site_meta(pages_):
    found = pages.meta_signals(pages.nodes(pages_.drop("url"), *pages.SIGNAL_COLUMNS, wanted=pages.signalling))
    return found.select("page_id", "title", "og_type", F.coalesce("has_article_ld", F.lit(False)).alias("has_article_ld"), "has_microdata")


@query("sites", sql="""
WITH n AS (SELECT page_id, page_id % 6 * 2 + page_id % 4 * 0 + CASE page_id % 8 WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS own, page_id % 5 * 50 AS one, CASE WHEN page_id % 5 > 2 THEN 2 ELSE 0 END AS two FROM sites)
SELECT page_id, own + one + two AS n, round((one + two) / (own + one + two), 4) AS external_share, CASE WHEN one + two = 0 THEN 0 ELSE 1 + two END AS n_hosts, 1 + two >= 3 AND one + two >= 0.95::DOUBLE * (own + one + two) AS hub FROM n WHERE own + one + two > 0""")
def site_hubs(pages_):
    """Links to other hosts; links that are scripts lead nowhere."""
    anchors = pages.nodes(pages_, "tag", "attrs", wanted=pages.hinting).where("tag = 'a' and attrs['href'] is not null")
    found = anchors.groupBy("page_id", F.col("own_url").alias("url"), F.col("attrs")["href"].alias("href")).agg(F.count("*").alias("n_links")).where(~urls.is_script(F.col("href")))
    full = urls.absolute(F.col("href"), F.col("url"))
    return reports.external_links(found.select("page_id", "n_links", urls.host(F.col("url")).alias("page_host"), urls.host(full).alias("link_host"), urls.registrable(full).alias("link_site")))


@query("sites", sql="""
SELECT page_id, 'li.row.a' AS own, page_id % 6 AS n, '/board/view/1001' AS sample_href, '/board/view/{n}' AS href_pattern, '/board/view/1001' AS href_prefix, false AS href_is_script, CASE WHEN page_id % 4 >= 2 THEN 'li.row.b' ELSE '' END AS variants,
  CASE WHEN page_id % 4 >= 2 THEN page_id % 6 + page_id % 4 END AS merged_count, 'data-id=7' AS data_attrs FROM sites WHERE page_id % 6 >= 3
UNION ALL SELECT page_id, 'li.row.b', page_id % 4, NULL, NULL, NULL, true, CASE WHEN page_id % 6 >= 2 THEN 'li.row.a' ELSE '' END, CASE WHEN page_id % 6 >= 2 THEN page_id % 6 + page_id % 4 END, '' FROM sites WHERE page_id % 4 >= 3""")
def site_patterns(pages_):
    """Rows of lists by all their classes, with the best of their links."""
    found = pages.page_patterns(pages_).where("selector like 'ul.list > %'")
    attrs = F.array_join(F.transform(F.map_entries("data_attrs"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return found.select("page_id", F.split_part("selector", F.lit(" > "), F.lit(2)).alias("own"), "n", "sample_href", "href_pattern", "href_prefix", "href_is_script", F.array_join("variants", ",").alias("variants"), "merged_count", attrs.alias("data_attrs"))


@query("sites", sql="""
SELECT page_id, 'feed' AS kind, '/feed.xml' AS name FROM sites WHERE page_id % 5 = 2 UNION ALL SELECT page_id, 'feed', '/rss/all' FROM sites WHERE page_id % 8 = 7
UNION ALL SELECT page_id, 'query', 'page' FROM sites WHERE page_id % 8 = 5 UNION ALL SELECT page_id, 'path', '/l/page/' FROM sites WHERE page_id % 8 = 6""")
def site_hints(pages_):
    return pages.link_hints(pages.nodes(pages_.drop("url"), "tag", "attrs", wanted=pages.hinting))


@query("sites", sql=r"""
SELECT page_id, 'Site ' || page_id || ' & Co' || repeat(chr(10) || 't' || chr(10) || 'post', CAST(page_id % 6 AS INT)) || repeat(chr(10) || 'note', CAST(page_id % 4 AS INT)) || repeat(chr(10) || 'o', CAST(page_id % 5 * 50 AS INT))
  || CASE WHEN page_id % 5 > 2 THEN chr(10) || 't' || chr(10) || 't' ELSE '' END || CASE page_id % 8 WHEN 5 THEN chr(10) || 'next' WHEN 6 THEN chr(10) || '2' || chr(10) || '3' WHEN 7 THEN chr(10) || 'feed' ELSE '' END AS text FROM sites""")
def site_text(pages_):
    return pages_.select("page_id", pages.page_text(F.col("html")).alias("text"))


@query("sites", sql="""
WITH n AS (SELECT page_id, 2 * (page_id % 6) AS own, CASE page_id % 8 WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS other, page_id % 2 = 0 AS nav FROM sites)
SELECT page_id, CASE WHEN nav THEN own ELSE 0 END AS in_nav, other + CASE WHEN nav THEN 0 ELSE own END AS outside_nav, other = 0 AND nav AS nav_only FROM n WHERE own + other > 0""")
def site_navigation(pages_):
    return sites.nav_only(pages.nodes(pages_, *sites.NAV_COLUMNS, wanted=pages.hinting), pages_.select("page_id", "url"))


@query("sites", sql="SELECT page_id, CASE WHEN page_id % 6 >= 3 AND page_id % 2 = 1 THEN page_id % 6 ELSE 0 END AS n_rows FROM sites WHERE page_id % 6 >= 3 OR page_id % 4 >= 3 OR page_id % 5 > 0")
def site_rows(pages_):
    """Rows within the host; lists in navigation don't count, and neither do groups of plain links to other hosts."""
    found = pages.page_patterns(pages_)
    up = pages.nodes(pages_, "tag", "up_tag", wanted=lambda n: n.tag == "ul").where("up_tag is not null").select("page_id", F.col("up_tag").alias("above"))
    named = found.join(up, "page_id").withColumn("selector", F.when(F.col("above") == "nav", F.concat(F.lit("nav > "), "selector")).otherwise(F.col("selector")))
    full = named.join(pages_.select("page_id", "url"), "page_id")
    return sites.same_host_rows(full.select("page_id", urls.host(F.col("url")).alias("page_host"), "selector", urls.absolute(F.col("sample_href"), F.col("url")).alias("sample_url"), "n"))


RESPONSES = (
    # status, body, headers, redirected to a login, class
    (200, "x" * 300, None, False, "OK"), (200, "x", None, False, "BLOCKED_BOT"), (200, "please log in to view this " + "x" * 300, None, False, "LOGIN_REQUIRED"), (404, "x", None, False, "NOT_FOUND"),
    (451, "x", None, False, "BLOCKED_GEO"), (403, "", None, False, "NOT_FOUND"), (429, "y" * 300, None, False, "BLOCKED_BOT"), (500, "z" * 900, None, False, "UNKNOWN_ERROR"),
)


@query("entries", sql="SELECT entry_id, " + _case([r[4] for r in RESPONSES]) + " AS class FROM entries")
def response_kinds(entries):
    """Responses of every class."""
    no = F.lit(False)
    c = classify.response(_pick([r[0] for r in RESPONSES]), _pick([r[1] for r in RESPONSES]), F.lit("http://a.example.com/"), F.create_map().cast("map<string,string>"), no, F.lit(None).cast("string"), no, no, no)
    return entries.select("entry_id", c.alias("class"))


# --- URLs -----------------------------------------------------------------------------------------------------------------------

KNOWN = (
    ("https://arca.live/b/umamusume?mode=best", "arca-live", "umamusume"), ("https://www.reddit.com/r/Python/new", "reddit", "Python"), ("https://old.reddit.com/r/java", "reddit", "java"),
    ("https://forum.example.com/latest?order=created", "discourse", "forum.example.com"), ("https://gall.dcinside.com/board/lists/?id=baseball_new11", "dcinside-main", "baseball_new11"),
    ("https://m.dcinside.com/board/hearthstone", "dcinside-main", "hearthstone"), ("https://gall.dcinside.com/mgallery/board/lists/?page=2&id=gfl", "dcinside-mgallery", "gfl"),
    ("https://github.com/apache/spark/releases", "github-releases", "apache/spark"), ("https://github.com/apache/spark/issues", None, None), ("https://someone.tistory.com/12", "tistory", "someone"),
    ("https://www.tistory.com/", None, None), ("https://blog.naver.com/abc_def", "naver-blog", "abc_def"), ("https://blog.naver.com/PostList.naver?blogId=abc&x=1", "naver-blog", "abc"),
    ("https://store.steampowered.com/news/app/570/view/1", None, None), ("https://store.steampowered.com/feeds/news/app/570/", "steam-news", "570"), ("https://news.substack.com/archive", "host_substack-com", "news"),
    ("https://app.substack.com/", None, None), ("https://x.example.com/wp-json/wp/v2/posts?per_page=5", "wordpress", "x.example.com"), ("https://example.com/questions", None, None), ("https://unix.stackexchange.com/questions?tab=Newest", "stackexchange", "unix.stackexchange.com"),
    ("https://status.example.com/history.rss", "statuspage", "status.example.com"), ("https://bbs.ruliweb.com/pc/board/300006", None, None), ("https://bbs.ruliweb.com/pc/board/300006/rss", "ruliweb", "300006"), ("https://medium.com/feed/netflix-techblog", "host_medium-com", "netflix-techblog"),
    ("https://ko.wikipedia.org/wiki/Main", None, None), ("https://ko.wikipedia.org/wiki/%ED%8A%B9%EC%88%98:%EC%B5%9C%EA%B7%BC%EB%B0%94%EB%80%9C", "mediawiki", "ko.wikipedia.org"), ("https://video.example.com/api/v1/videos?sort=-publishedAt", "peertube", "video.example.com"), ("https://a.example.com/plain", None, None),
)


@query("entries", sql=f"SELECT entry_id, {_case([k[1] for k in KNOWN])} AS platform, {_case([k[2] for k in KNOWN])} AS board FROM entries")
def recognised_platforms(entries):
    found = sites.recognised(_pick([k[0] for k in KNOWN]))
    return entries.select("entry_id", found["platform"].alias("platform"), found["board"].alias("board"))


SINGLE = (
    ("https://www.britannica.com/topic/painting", "britannica", False), ("https://www.britannica.com/", None, None), ("https://www.nature.com/articles/s41586-1", "nature", True),
    ("https://www.nature.com/articles?type=news", None, None), ("https://terms.naver.com/entry.naver?docId=1", "terms", False), ("https://developer.mozilla.org/en-US/docs/Web", "mozilla", True),
    ("https://openai.com/index/some%2Dthing", "openai", False), ("https://openai.com/index/", None, None),
)


@query("entries", sql=f"SELECT entry_id, {_case([k[1] for k in SINGLE])} AS rule, {_case([k[2] if k[2] is not None else None for k in SINGLE])} AS skip_learning FROM entries".replace("THEN none", "THEN NULL"))
def single_articles(entries):
    found = sites.single_article(_pick([k[0] for k in SINGLE]))
    return entries.select("entry_id", found["rule"].alias("rule"), found["skip_learning"].alias("skip_learning"))


@query("entries", sql="""SELECT entry_id, 'http://h' || (entry_id % 9) || '.example.com/l?a=1&b=&a=2&page=' || (entry_id % 5 + 1) || '&size=30' AS by_query,
CASE WHEN entry_id % 5 = 0 THEN 'http://x.example.com/l?q=k' ELSE 'http://x.example.com/l?q=k&start=' || (entry_id % 5 * 30) || '&n=30&more=1' END AS by_offset,
'http://x.example.com/l/page/' || (entry_id % 5 + 1) || CASE WHEN entry_id % 5 = 0 THEN '' ELSE '?more=1' END AS by_path, 'http://x.example.com/b7/{other}/' || (entry_id % 5 + 1) AS plain,
'http://proxy.example.org/?u=http%3A%2F%2Fh.example.com%2Fa%20b%3Fc%3D' || entry_id AS via FROM entries""")
def page_urls(entries):
    page = (F.col("entry_id") % 5 + 1).cast("int")
    by_query = urls.with_query(F.concat(F.lit("http://h"), (F.col("entry_id") % 9).cast("string"), F.lit(".example.com/l?a=1&page=9&b=&a=2")), {"page": page, "size": F.lit(30)})
    return entries.select(
        "entry_id",
        by_query.alias("by_query"),
        urls.page_link("http://x.example.com/l?q=k", page, "start", "offset", page_size=50, page_size_max=30, size_param="n", when_paged={"more": "1"}).alias("by_offset"),
        urls.page_link("http://x.example.com/l/page/{page}", page, None, "path_segment", when_paged={"more": "1"}).alias("by_path"),
        urls.page_link("http://x.example.com/{board}/{other}/{page}", page, mode="none", board="b7").alias("plain"),
        urls.proxied(F.concat(F.lit("http://h.example.com/a b?c="), F.col("entry_id").cast("string")), "http://proxy.example.org/?u={target}").alias("via"),
    )


@query("entries", sql="""SELECT entry_id, 'http://a.example.com/x' AS bare, entry_id % 4 <> 3 AS fits, entry_id % 4 IN (0, 2) AS family, CASE WHEN entry_id % 4 = 3 THEN NULL ELSE 'http://a.example.com/' || CASE entry_id % 4 WHEN 0 THEN 'api/Post/17?x' WHEN 1 THEN 'api/post/some' ELSE 'API/post/17' END END AS sitemap,
entry_id % 4 <> 3 AS related FROM entries""")
def url_comparisons(entries):
    """Comparisons of URLs with a template, with an endpoint's family and with the posts' own."""
    url = _pick(["HTTP://A.example.com/api/Post/17?x#f", "http://a.example.com/api//post/some/", "http://a.example.com/API/post/17", "no url"])
    t = "http://a.example.com/api/post/{post_id}"
    sitemap = _pick(["HTTP://A.example.com/api/Post/17?x#f", "http://a.example.com/api/post/some", "http://a.example.com/API/post/17", "no url"])
    return entries.select(
        "entry_id",
        urls.without_fragment(F.lit("HTTP://a.example.com/X//#frag")).alias("bare"),
        urls.fits_template(t, F.regexp_replace(url, r"\?x", "")).alias("fits"),
        urls.endpoint_family(t, url).alias("family"),
        urls.sitemap_url(sitemap).alias("sitemap"),
        sites.related_article(url, F.array(F.lit("http://a.example.com/api/post/17?x"), F.lit("http://a.example.com/api//post/some/2"), F.lit("http://a.example.com/api/post/17/"))).alias("related"),
    )


@query("entries", sql="""
WITH l AS (SELECT entry_id % 40 AS site, entry_id AS pos, CASE entry_id % 6 WHEN 0 THEN 'http://s.example.com/board?id=3' WHEN 1 THEN 'http://S.example.com' WHEN 2 THEN 'http://other.example.org/news' WHEN 3 THEN 'http://s.example.com/a/1234/x/y' WHEN 4 THEN 'nothing' ELSE 'http://www.example.com/news/' || entry_id END AS loc,
  CASE entry_id % 6 WHEN 0 THEN 6 WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 5 THEN 4 + CASE WHEN length('' || entry_id) >= 3 THEN 1 ELSE 0 END END AS score FROM entries),
f AS (SELECT site, CASE loc WHEN 'http://S.example.com' THEN 'http://s.example.com/' ELSE loc END AS url, min(pos) AS pos, any_value(score) AS score FROM l WHERE score IS NOT NULL GROUP BY 1, 2)
SELECT site, url, score, CAST(row_number() OVER (PARTITION BY site ORDER BY score DESC, pos) AS INTEGER) AS place FROM f QUALIFY place <= 3""")
def sitemap_places(entries):
    n = F.col("entry_id")
    loc = _pick(["http://s.example.com/board?id=3", "http://S.example.com", "http://other.example.org/news", "http://s.example.com/a/1234/x/y", "nothing", F.concat(F.lit("http://www.example.com/news/"), n.cast("string"))])
    return sites.sitemap_candidates(entries.select((n % 40).alias("site"), n.alias("pos"), loc.alias("loc"), F.lit("http://example.com/").alias("site_url")), most=3)


# --- candidates and gates -------------------------------------------------------------------------------------------------------


@query("observations", sql="""
WITH r AS (SELECT id % 50 AS page_id, id AS pos, id % 3 AS kind, id % 5 AS st, id % 40 AS n_rows, id % 2 AS m, id % 7 AS u, id % 4 AS k FROM observations),
s AS (SELECT page_id, pos, CASE WHEN st = 0 THEN -3 WHEN st = 1 THEN 0 ELSE 2 END + CASE kind WHEN 0 THEN 3 WHEN 1 THEN -2 ELSE 0 END + CASE WHEN u = 6 THEN -1 ELSE 1 END + CASE WHEN u < 3 THEN 3 ELSE 0 END + (m = 0)::INT
  + least(2, n_rows // 8) + (k = 1)::INT + (u IN (0, 4))::INT AS relevance_score FROM r WHERE n_rows > 0)
SELECT page_id, pos, CAST(relevance_score AS INTEGER) AS relevance_score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY relevance_score DESC, pos) AS INTEGER) AS place FROM s""")
def api_places(observations):
    n = F.col("id")
    paths = ["/api/board?limit=5", "/api/LIST", "/v1/articles", "/x", "/x?page=2", "/y", None]
    url = F.coalesce(F.concat(F.lit("http://a.example.com"), _pick(paths, "id")), F.lit("http://b.example.com/y"))
    rows = observations.select(
        (n % 50).alias("page_id"), F.lit("a.example.com").alias("page_host"), n.alias("pos"), _pick(["GET", "POST"], "id").alias("method"), url.alias("url"), _pick([404, 302, 200, 200, 200], "id").alias("status"),
        _pick(["fetch", "document", "script"], "id").alias("resource_type"), (n % 40).alias("n_rows"), _pick(["id name", "createdAt", "x", "y"], "id").alias("keys"),
    )
    return sites.api_candidates(rows).select("page_id", "pos", "relevance_score", "place")


@query("observations", sql="""
WITH s AS (SELECT id % 30 AS page_id, id AS pos, CASE WHEN id % 3 = 0 THEN 3 ELSE 0 END + CASE WHEN id % 4 = 1 THEN 2 ELSE 0 END + CASE WHEN id % 5 = 2 THEN 2 ELSE 0 END + (id % 7 = 3)::INT + least(2, (id % 4000) // 1000) AS score FROM observations)
SELECT page_id, pos, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS INTEGER) AS place FROM s QUALIFY place <= 6""")
def body_places(observations):
    n = F.col("id")
    rows = observations.select(
        (n % 30).alias("page_id"), n.alias("pos"), F.lit("http://a.example.com/v/123456").alias("article_url"), F.when(n % 3 == 0, "http://a.example.com/api/123456").otherwise("http://a.example.com/api").alias("url"),
        F.when(n % 4 == 1, '{"id":123456}').alias("request_body"), (n % 5 == 2).alias("is_html"), (n % 7 == 3).alias("key_hit"), (n % 4000).alias("length"),
    )
    return sites.body_candidates(rows).select("page_id", "pos", "score", "place")


@query("entries", sql="""SELECT entry_id, (entry_id % 6 = 0) OR (entry_id % 7 = 0) OR (entry_id % 5 = 1 AND entry_id % 2 = 0) AS board, entry_id % 3 = 0 AND entry_id % 4 IN (1, 2) AS diverging, entry_id % 4 < 2 AND entry_id % 3 = 1 AND entry_id % 5 <> 0 AS junk, entry_id % 3 = 2 AND entry_id % 5 <> 0 AS years FROM entries""")
def page_gates(entries):
    n = F.col("entry_id")
    zero = F.lit(0)
    first = F.when(n % 5 == 1, F.concat(F.lit("http://a.example.com/p/"), n.cast("string"))).when(n % 5 == 2, "http://b.example.org/p")
    digest = entries.select(
        "entry_id", F.when(n % 6 == 0, 1).otherwise(0).alias("n_json"), zero.alias("n_inline"), zero.alias("n_hydration"), F.when(n % 7 == 0, 2).otherwise(0).alias("n_feeds"), zero.alias("n_same_host"),
        first.alias("first_article_url"), F.lit(None).cast("string").alias("clicked_url"), F.lit("http://a.example.com/").alias("page_url"), (n % 2 == 1).alias("anti_bot"),
    )
    article = _pick(["http://a.example.com/news/1", "http://a.example.com/x/1", "http://a.example.com/view.php?n=1", "http://a.example.com/read.php?n=1"])
    page = _pick(["http://a.example.com/news", "http://a.example.com/news", "http://a.example.com/news", "http://a.example.com/list.php"])
    ids = F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(_pick([F.array(F.lit("a1"), F.lit("b")), F.array(F.lit("about"), F.lit("help")), F.array(F.lit("2024"), F.lit(" 1999 "))]))
    gates = sites.board_shape(digest)
    return gates.select(
        "entry_id", "board", sites.diverges(n % 3 == 0, page, article).alias("diverging"),
        sites.nav_junk(_pick(["nav > ul > li", "div.p-menubar li", "div.navy li", "main li"]), ids, F.lit(False)).alias("junk"), sites.year_archive(ids).alias("years"),
    )


OUTCOMES = (
    ("given", "✅ 자동", "A", "given"), (None, "🚫 no", "A", "rejected"), (None, "✅ 자동", "A", "improved"), (None, "✅ 자동", None, "improved"), (None, "✅ 손작성", None, "handcrafted"),
    (None, "🔧 tool", None, "handcrafted"), ("", "❌ FAILED", None, "error"), (None, None, None, "error"),
)


@query("entries", sql=f"SELECT entry_id, {_case([x[3] for x in OUTCOMES])} AS outcome, {_case(['a,b', 'not json', '', '[broken'])} AS keys FROM entries")
def case_outcomes(entries):
    files = F.array(F.lit("f"))
    keys = sites.unpacked(_pick(['["a","b"]', "not json", None, "[broken"]))
    return entries.select("entry_id", sites.outcome(*(_pick([x[k] for x in OUTCOMES]) for k in range(3)), files).alias("outcome"), F.array_join(keys, ",").alias("keys"))


# --- reports --------------------------------------------------------------------------------------------------------------------


@query("jobs", sql="""
WITH m AS (SELECT id, concat('s', id) AS slug, CASE id % 5 WHEN 0 THEN 'polling' WHEN 1 THEN 'rejected' WHEN 2 THEN 'failed' WHEN 3 THEN 'bug' ELSE 'other' END AS kind, status FROM jobs),
g AS (SELECT kind, CASE kind WHEN 'polling' THEN 'board' WHEN 'rejected' THEN CASE WHEN status = 'done' THEN 'dead' ELSE 'login' END WHEN 'failed' THEN 'blocked' ELSE 'bug' END AS grp,
  CASE kind WHEN 'polling' THEN CASE WHEN status = 'done' THEN 'active' ELSE status END WHEN 'rejected' THEN CASE WHEN status = 'done' THEN 'dead' ELSE 'login' END WHEN 'failed' THEN 'blocked' ELSE 'bug' END AS status FROM m WHERE kind <> 'other')
SELECT kind, grp, status, count(*) AS n FROM g GROUP BY ALL""")
def marker_counts(jobs):
    markers = jobs.select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("slug"), _pick(["polling", "rejected", "failed", "bug", "other"], "id").alias("kind"), F.when(F.col("status") == "done", "ok").otherwise(F.col("status")).alias("last_status"), F.when(F.col("status") == "done", "exclude").otherwise("login").alias("reason_group"))
    return sites.marker_summary(markers).groupBy("kind", "grp", "status").agg(F.count("*").alias("n"))


@query("posts", sql="SELECT slug, category, count(*) AS n FROM posts GROUP BY ALL")
def category_counts(posts):
    """What the posts that a scan has found are about."""
    return reports.top_values(posts.withColumn("key", F.struct("slug", "category")), "key", 1 << 30).select("key.slug", "key.category", "n")


@query("posts", sql="SELECT slug, post_id, CAST(row_number() OVER (PARTITION BY slug ORDER BY CASE WHEN CAST(post_id AS BIGINT) % 4 = 0 THEN NULL ELSE collected_at END NULLS FIRST, post_id) AS INTEGER) AS place FROM posts QUALIFY place <= 5")
def oldest_posts(posts):
    """The first posts of a slug by date, those without one before all."""
    dated = posts.withColumn("published_at", F.when(F.col("post_id").cast("bigint") % 4 != 0, F.col("collected_at")))
    return windows.top_per_key(dated, "slug", 5, F.asc_nulls_first("published_at"), F.asc("post_id")).select("slug", "post_id", F.col("place").cast("int").alias("place"))


@query("users", "subscriptions", sql="SELECT user_id, name FROM users WHERE user_id IN (SELECT user_id FROM subscriptions WHERE slug = 'src5') AND (contains(CAST(user_id AS VARCHAR), '1') OR contains(lower(coalesce(name, '')), '1')) ORDER BY name DESC NULLS LAST, user_id LIMIT 40")
def users_of_slug(users, subscriptions):
    found = sites.users_where(users, subscriptions, "src5", " 1 ")
    return found.select("user_id", "name").orderBy(F.desc_nulls_last("name"), "user_id").limit(40)


@query("jobs", sql="SELECT id FROM jobs WHERE id % 3 = 1 AND status <> 'done' AND contains(lower('Remote.poll-' || kind || ' ' || coalesce(result_tail, '')), 'target')")
def audit_search(jobs):
    log = jobs.select("id", F.concat(F.when(F.col("id") % 3 == 1, "Remote").otherwise("local"), F.lit(".poll-"), "kind").alias("action"), (F.col("status") == "done").alias("ok"), F.col("result_tail").alias("detail"))
    return sites.audit_rows(log, "remote", True, "TARGET").select("id")


@query("jobs", sql=f"SELECT id, 'window' AS how FROM jobs WHERE kind = 'register' AND ts > {NOW} - interval 5 day AND id >= 100 AND id <= 5000 UNION ALL SELECT id, 'ids' FROM jobs WHERE kind = 'register' AND id IN (4, 8, 15, 16, 23, 42)")
def jobs_in_window(jobs):
    window = sites.job_window(jobs, "register", since=F.expr(f"{NOW} - interval 5 days"), min_id=100, max_id=5000)
    return window.select("id", F.lit("window").alias("how")).unionByName(sites.job_window(jobs, "register", [4, 8, 15, 16, 23, 42]).select("id", F.lit("ids").alias("how")))


@query("calls", sql="""SELECT id, round(CAST('0x' || substr(sha256('salt:' || id), 1, 8) AS BIGINT)::DOUBLE / 4294967295.0, 12) AS unit, strftime(ts + interval 9 hour, '%m-%d %H:%M') AS short, strftime(ts + interval 9 hour, '%H:%M:%S') AS time,
right(repeat('ab' || id, 2000), 4000) AS tail FROM calls""")
def labels_and_units(calls):
    return calls.select("id", F.round(sites.hash_unit(F.col("id").cast("string"), "salt"), 12).alias("unit"), sites.time_label(F.col("ts"), "short").alias("short"), sites.time_label(F.col("ts"), "time").alias("time"), sites.error_tail(F.repeat(F.concat(F.lit("ab"), F.col("id").cast("string")), 2000)).alias("tail"))


@query("jobs", sql="""
WITH r AS (SELECT DISTINCT slug, date_trunc('day', ts) AS day FROM jobs WHERE slug IS NOT NULL), s AS (SELECT DISTINCT slug, date_trunc('day', ts) AS day FROM jobs WHERE slug IS NOT NULL AND status = 'done'),
n AS (SELECT count(*) AS n FROM (SELECT * FROM r EXCEPT SELECT * FROM s)) SELECT n AS n_inserted, (SELECT count(*) FROM jobs WHERE slug IS NOT NULL) - n AS n_duplicates FROM n""")
def backfill_counts(jobs):
    rows = jobs.where("slug is not null").select("slug", F.date_trunc("day", "ts").alias("ts"), F.col("id").alias("pos"))
    store = jobs.where("slug is not null and status = 'done'").select("slug", F.date_trunc("day", "ts").alias("ts"))
    return sites.backfilled(store, rows)[1]


@query("observations", sql="""
WITH b AS (SELECT slug, min(ts) AS first_at FROM observations WHERE error IS NOT NULL GROUP BY slug), a AS (SELECT slug, CASE WHEN CAST(substr(slug, 2) AS INT) % 3 = 0 THEN first_at ELSE first_at - interval 1 day END AS first_at FROM b WHERE CAST(substr(slug, 2) AS INT) % 3 < 2),
t AS (SELECT b.slug, b.first_at FROM b LEFT JOIN a USING (slug) WHERE a.first_at IS DISTINCT FROM b.first_at) SELECT 'told' AS step, slug, strftime(date_trunc('second', first_at), '%Y-%m-%d %H:%M:%S') AS first_at FROM t UNION ALL SELECT 'after', slug, strftime(date_trunc('second', first_at), '%Y-%m-%d %H:%M:%S') FROM b""")
def broken_alerts(observations):
    """Who is told of which breakage, and what is known to be told afterwards."""
    broken = observations.where("error is not null").groupBy("slug").agg(F.min("ts").alias("first_at"))
    k = F.substring("slug", 2, 9).cast("int") % 3
    alerted = broken.where(k < 2).withColumn("first_at", F.when(k == 0, F.col("first_at")).otherwise(F.col("first_at") - F.expr("interval 1 day")))
    told = sites.to_alert(broken, alerted)
    gone = alerted.limit(1).select(F.lit("recovered").alias("slug"), "first_at")
    both = told.select(F.lit("told").alias("step"), "slug", "first_at").unionByName(sites.alerts_after(broken, alerted.unionByName(gone), told).select(F.lit("after").alias("step"), "slug", "first_at"))
    return both.select("step", "slug", text("first_at").alias("first_at"))


@query("entries", sql="""
WITH e AS (SELECT 'c' || (entry_id % 3) AS catalogue, 'http://h.example.com/b/' || (entry_id % 100) AS url FROM entries)
SELECT '//h.example.com/b/' || split_part(url, '/', -1) AS url, array_to_string(list_sort(list(DISTINCT catalogue)), ',') AS catalogues, count(DISTINCT catalogue) AS n FROM e GROUP BY 1 HAVING count(DISTINCT catalogue) > 1""")
def shared_catalogue_urls(entries):
    n = F.col("entry_id")
    url = F.concat(F.lit("http://h.example.com/b/"), (n % 100).cast("string"), F.when(n % 2 == 0, "?utm_source=x").otherwise("/"))
    return sites.shared_urls(entries.select(F.concat(F.lit("c"), (n % 3).cast("string")).alias("catalogue"), url.alias("url")))


@query("entries", sql="SELECT entry_id, CAST(entry_id % 3 AS BIGINT) AS n FROM entries WHERE entry_id % 2 = 1")
def rows_without_notices(entries):
    classes = F.when(F.col("entry_id") % 2 == 0, F.array(F.lit("row"), F.lit("notice"))).otherwise(F.array(F.lit("row")))
    return sites.without_notices(entries, classes, "notice", False).select("entry_id", (F.col("entry_id") % 3).cast("long").alias("n"))


@query("entries", sql="""SELECT entry_id, CASE entry_id % 7 WHEN 0 THEN 'private address' WHEN 1 THEN 'private address' WHEN 2 THEN 'private address' WHEN 3 THEN 'private address' WHEN 4 THEN 'address' WHEN 5 THEN 'private address' END AS problem FROM entries""")
def address_gate(entries):
    """Addresses of both kinds, written out."""
    url = _pick(["http://[::1]/", "http://[fe80::1]:80/a", "http://[fd12:3456::1]/", "http://[::ffff:10.0.0.1]/", "http://[2606:4700::1111]/", "http://192.168.1.1/", "http://ok.example.com/"])
    return entries.select("entry_id", filters.url_problem(url).alias("problem"))


# --- runs, checks and the rest --------------------------------------------------------------------------------------------------


@query("runs", "site_runs", sql="""
WITH c AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE status = 'running') AS k FROM site_runs GROUP BY run_id)
SELECT r.run_id, CASE WHEN r.status = 'enqueue_done' AND coalesce(n, 0) >= 3 AND coalesce(k, 0) = 0 THEN 'done' ELSE r.status END AS status FROM runs r LEFT JOIN c USING (run_id)""")
def finalised_runs(runs, site_runs):
    return state.finalised(runs.withColumn("n_sites", F.lit(3)), site_runs)


@query("site_runs", sql="SELECT count(*) AS n_targets, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'error') AS n_failed, count(*) FILTER (WHERE status = 'timeout') AS n_empty, CAST(sum(n_new) AS BIGINT) AS n_posts FROM site_runs")
def notify_totals(site_runs):
    renamed = F.when(F.col("status") == "error", "failed").when(F.col("status") == "timeout", "empty").otherwise(F.col("status"))
    return reports.notify_totals(site_runs.select(renamed.alias("status"), F.col("n_new").alias("n_posts")))


@query("users", sql="SELECT CASE user_id % 3 WHEN 0 THEN 'handwritten' WHEN 1 THEN 'html' ELSE 'json' END AS strategy, CASE WHEN user_id % 3 = 0 THEN 'a' || (user_id % 4) END AS adapter, count(*) AS n FROM users GROUP BY ALL")
def config_counts(users):
    return reports.config_counts(users.select(_pick(["handwritten", "html", "json"], "user_id").alias("strategy"), F.concat(F.lit("a"), (F.col("user_id") % 4).cast("string")).alias("adapter")))


@query("site_runs", sql="""
WITH t AS (SELECT count(*) FILTER (WHERE status = 'ok') AS a, count(*) FILTER (WHERE status = 'error') AS b, count(*) FILTER (WHERE status = 'timeout') AS c, CAST(sum(n_new) AS BIGINT) AS d FROM site_runs)
SELECT 'done=' || a || ' errors=' || b || ' timeouts=' || c || ' inserted=' || d AS summary, '{"n_done":' || a || ',"n_errors":' || b || ',"n_timeouts":' || c || ',"n_inserted":' || d || '}' AS json FROM t""")
def run_summary(site_runs):
    return sites.run_summary(reports.run_totals(site_runs))


CHECKS = ("", "post_id_nonempty,post_id_stable_shape", "post_id_unique", "post_id_stable_shape", "title_nonempty", "published_at_iso", "row_selector_not_nav", "post_id_not_year_archive", "article_body_len", "posts_nonempty")


@query("posts", sql=f"SELECT DISTINCT slug, {_case(CHECKS, 'CAST(substr(slug, 4) AS INT)')} AS failed FROM posts")
def list_checks(posts):
    """Lists that each fail one check, by the number of their slug."""
    k = F.substring("slug", 4, 9).cast("int") % 10
    n = F.row_number().over(windows.Window.partitionBy("slug").orderBy("post_id"))
    rows = posts.withColumn("rn", n).where(k != 9)
    first = F.col("rn") == 1
    letters = F.translate(F.col("rn").cast("string"), "0123456789", "abcdefghij")
    post_id = F.when((k == 1) & first, "").when((k == 2) & (F.col("rn") <= 2), "same").when((k == 3) & first, "a b").when(k == 6, letters).when(k == 7, (F.lit(1990) + F.col("rn") % 41).cast("string")).otherwise(F.col("post_id"))
    rows = rows.where((k != 7) | (F.col("rn") <= 41)).select("slug", post_id.alias("post_id"), F.when((k == 4) & first, " ").otherwise("t").alias("title"), F.when((k == 5) & first, "yesterday").when(k != 6, "2024-01-15").alias("published_at"), F.when(k != 8, 100).alias("body_length"))
    scans = posts.select("slug").distinct().select("slug", F.when(k == 6, "nav li").otherwise("main li").alias("row_selector"), F.lit(False).alias("body_optional"))
    return sites.list_checks(rows, scans).select("slug", F.array_join("failed", ",").alias("failed"))


@query("jobs", "subscriptions", sql="""
WITH s AS (SELECT slug, count(*) AS n_subs FROM subscriptions GROUP BY slug), k AS (SELECT slug, count(*) FILTER (WHERE status = 'failed') AS streak FROM jobs WHERE slug IS NOT NULL GROUP BY slug),
a AS (SELECT slug FROM s UNION SELECT slug FROM k), r AS (SELECT slug, coalesce(n_subs, 0) AS n_subs, CASE WHEN n % 2 = 0 THEN 'html' END AS strategy, CASE n % 5 WHEN 0 THEN 'BROKEN' WHEN 1 THEN 'FAILED' END AS marker, coalesce(streak, 0) AS streak
  FROM (SELECT slug, CAST(substr(slug, 4) AS INT) AS n FROM a) LEFT JOIN s USING (slug) LEFT JOIN k USING (slug))
SELECT *, CAST(row_number() OVER (ORDER BY coalesce(marker = 'BROKEN', false) DESC, streak DESC, coalesce(marker = 'FAILED', false), slug) AS INTEGER) AS place FROM r QUALIFY place <= 10""")
def site_board(jobs, subscriptions):
    streaks = jobs.where("slug is not null").groupBy("slug").agg(F.count_if(F.col("status") == "failed").alias("streak"))
    slugs = subscriptions.select("slug").union(streaks.select("slug")).distinct()
    n = F.substring("slug", 4, 9).cast("int")
    markers = slugs.where(n % 5 < 2).select("slug", F.when(n % 5 == 0, "BROKEN").otherwise("FAILED").alias("marker"))
    rows, order = sites.site_board([jobs], subscriptions, markers, slugs.where(n % 2 == 0).select("slug", F.lit("html").alias("strategy")), streaks)
    first = rows.orderBy(*order).limit(10)
    return first.withColumn("place", F.row_number().over(windows.Window.orderBy(*order)))


@query("entries", sql="""
SELECT entry_id AS page_id, 'js_var' AS source, 'boardId' AS name, CAST(entry_id + 10 AS VARCHAR) AS value FROM entries WHERE entry_id % 2 = 0 UNION ALL SELECT entry_id, 'js_var', 'cafe_id', 'ab-' || entry_id FROM entries WHERE entry_id % 3 = 0
UNION ALL SELECT entry_id, 'meta_og_url', 'og:url last segment', CAST(entry_id + 100 AS VARCHAR) FROM entries WHERE entry_id % 5 = 0""")
def runtime_ids(entries):
    n = F.col("entry_id")
    html = F.concat(
        F.lit("<html><head>"),
        F.when(n % 5 == 0, F.concat(F.lit('<meta content="http://a.example.com/b/'), (n + 100).cast("string"), F.lit('/?x=1" property="og:url">'))).otherwise('<meta property="og:url" content="http://a.example.com/b/about">'),
        F.lit("<script>var menuId = target; "),
        F.when(n % 2 == 0, F.concat(F.lit('var boardId = "'), (n + 10).cast("string"), F.lit('"; boardId='), (n + 10).cast("string"), F.lit(";"))).otherwise(""),
        F.when(n % 3 == 0, F.concat(F.lit('{"cafe_id": "ab-'), n.cast("string"), F.lit('"}'))).otherwise(""),
        F.lit("</script>"),
    )
    return sites.runtime_ids(entries.select(n.alias("page_id"), html.alias("html")))


@query("entries", sql="""
SELECT entry_id AS page_id, CASE WHEN entry_id % 3 = 0 THEN 5 ELSE 2 END AS n_clusters, CASE WHEN entry_id % 3 = 0 THEN 5 ELSE 2 END AS n_prefixes, CAST(entry_id % 3 = 1 AS BIGINT) AS n_view_links, entry_id % 3 = 0 AS mixed FROM entries""")
def structure_hints(entries):
    n = F.col("entry_id") % 3
    hrefs = F.when(n == 0, F.array(*(F.lit(f"/s{k}/{{n}}") for k in range(5)))).otherwise(F.array(F.when(n == 1, "/board/view?post_id={n}").otherwise("/board/{n}"), F.lit("/about"), F.lit("http://other.example.org/x")))
    rows = entries.select(F.col("entry_id").alias("page_id"), F.lit("a.example.com").alias("page_host"), F.explode(hrefs).alias("href_pattern"), F.lit(4).alias("n"))
    return sites.structure_hint(rows.withColumn("sample_url", F.when(F.col("href_pattern").startswith("http"), F.col("href_pattern"))))


@query("entries", sql="SELECT entry_id AS page_id, CASE entry_id % 3 WHEN 0 THEN 'http://a.example.com/article/12345' WHEN 1 THEN 'http://b.example.org/login' ELSE 'http://a.example.com/notice/77777' END AS url FROM entries")
def best_articles(entries):
    n = F.col("entry_id") % 3
    found = F.when(n == 0, F.array(F.lit("http://a.example.com/user/me"), F.lit("http://a.example.com/article/12345"))).when(n == 1, F.array(F.lit("http://b.example.org/login"), F.lit("http://c.example.net/article/1"))).otherwise(F.array(F.lit("http://a.example.com/notice/77777"), F.lit("http://a.example.com/notice/88888")))
    rows = entries.select(F.col("entry_id").alias("page_id"), F.lit("http://www.example.com/").alias("page_url"), F.posexplode(found).alias("pos", "url"))
    return sites.best_article(rows)


@query("posts", sql="""
SELECT post_id, CASE WHEN CAST(post_id AS BIGINT) % 4 < 3 THEN CAST([200, 403, 500][CAST(post_id AS BIGINT) % 4 + 1] AS INTEGER) END AS status, CASE WHEN CAST(post_id AS BIGINT) % 4 IN (0, 2) THEN 'body' END AS content,
CASE WHEN CAST(post_id AS BIGINT) % 4 = 1 THEN 'skipped: HTTP 403' END AS fetch_note FROM posts""")
def fetched_articles(posts):
    n = F.col("post_id").cast("bigint") % 4
    responses = posts.where(n < 3).select("url", F.when(n == 0, 200).when(n == 1, 403).otherwise(500).alias("status"), F.lit("body").alias("content"))
    return sites.fetched_articles(posts.select("post_id", "url"), responses, [401, 403]).drop("url")


@query("jobs", sql="SELECT id, CASE status WHEN 'done' THEN 'finished' ELSE status END AS status, 0::BIGINT AS n_retries, CAST(attempts AS DOUBLE) AS attempts FROM jobs")
def evolved_jobs(jobs):
    return sites.evolved(jobs, "id long, status string, n_retries long, attempts double", {"n_retries": 0}, {"status": {"done": "finished"}})


@query("calls", sql="SELECT id, CASE call_site WHEN 'click' THEN 'gem' WHEN 'view' THEN 'open' ELSE 'gem' END AS provider, CASE call_site WHEN 'click' THEN 'flash' WHEN 'view' THEN 'm:x' ELSE 'pro' END AS model FROM calls")
def call_routes(calls):
    return calls.select("id", sites.routed(F.col("call_site"), {"click": "gem:flash", "view": "open:m:x", "_default": "gem:pro"}, "none:none").alias("r")).select("id", "r.provider", "r.model")


@query("entries", sql="SELECT entry_id AS page_id, '$.data.items' AS path, entry_id % 9 AS n, CASE WHEN entry_id % 2 = 0 THEN 'feed' END AS item_subpath FROM entries WHERE entry_id % 9 >= 5")
def json_lists(entries):
    """Lists of rows in payloads, plain ones and such as lie in an envelope."""
    n = F.col("entry_id")
    plain = F.to_json(F.transform(F.sequence(F.lit(1), F.greatest(n % 9, F.lit(1)).cast("int")), lambda k: F.struct(k.alias("id"), F.concat(F.lit("t"), k.cast("string")).alias("title"))))
    packed = F.to_json(F.transform(F.sequence(F.lit(1), F.greatest(n % 9, F.lit(1)).cast("int")), lambda k: F.struct(F.struct(F.concat(F.lit("/p/"), k.cast("string")).alias("url"), F.concat(F.lit("t"), k.cast("string")).alias("title")).alias("feed"))))
    body = F.concat(F.lit('{"data":{"items":'), F.when(n % 2 == 0, packed).otherwise(plain), F.lit("}}"))
    return jsonwalk.find_lists(entries.select(n.alias("page_id"), body.alias("body"))).withColumn("n", F.col("n").cast("long"))


@query("entries", sql="""
SELECT entry_id, 'a.boardId' AS path, CAST(entry_id + 10 AS VARCHAR) AS value FROM entries UNION ALL SELECT entry_id, 'a.l[0].x_id', 'ab' FROM entries UNION ALL SELECT entry_id, 'userID', 'k-' || entry_id FROM entries WHERE entry_id % 2 = 0""")
def json_id_keys(entries):
    """Keys of ids, by a table function."""
    spark = entries.sparkSession
    spark.udtf.register("id_keys", sites.IdKeys)
    n = F.col("entry_id").cast("string")
    body = F.concat(F.lit('{"a":{"boardId":'), (F.col("entry_id") + 10).cast("string"), F.lit(',"l":[{"x_id":"ab"},{"x_id":"a b"}],"id":5},"userID":"'), F.when(F.col("entry_id") % 2 == 0, F.concat(F.lit("k-"), n)).otherwise(""), F.lit('"}'))
    return spark.sql("SELECT entry_id, k.path, k.value FROM {bodies}, LATERAL id_keys(body) AS k", bodies=entries.select("entry_id", body.alias("body")))


@query("jobs", "subscriptions", sql="SELECT DISTINCT slug FROM jobs WHERE slug IN (SELECT slug FROM subscriptions)")
def subscribed_sites(jobs, subscriptions):
    return joins.subscribed(jobs.select("slug").distinct(), subscriptions)


@query("jobs", sql="SELECT id FROM jobs WHERE kind IN ('register', 'reprobe') AND status = 'failed' AND attempts > 0 AND contains(lower(url), 'h1')")
def trace_search(jobs):
    traces = jobs.select("id", "kind", (F.col("status") != "failed").alias("ok"), F.col("attempts").alias("n_spans"), F.create_map(F.lit("url"), F.upper("url")).alias("attrs"))
    return traces.where(filters.trace_filter(["register", "reprobe"], True, False, "h1")).select("id")


@query("jobs", sql="SELECT id FROM jobs WHERE attempts IN (1, 2) AND contains(url, '/b/1') AND kind = 'reprobe' AND starts_with(status, 'f') AND id % 3 = 2")
def case_query(jobs):
    cases = jobs.select("id", F.array(F.concat(F.lit("k"), F.col("attempts").cast("string"))).alias("failure_keys"), F.col("url").alias("body"), F.col("kind").alias("fix_layer"), "status", F.array(F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("candidates"))
    return cases.where(filters.case_query(["k1", "k2"], "/b/1", "reprobe", "f", "c2")).select("id")


@query("posts", sql="SELECT slug, post_id, row_number() OVER (PARTITION BY slug ORDER BY collected_at, post_id) <= 3 AS within FROM posts")
def first_articles(posts):
    return windows.flagged_first(posts.select("slug", "post_id", "collected_at"), "slug", 3, F.asc("collected_at"), F.asc("post_id")).drop("collected_at")


@query("observations", sql="""
WITH o AS (SELECT id, slug, ts, CASE WHEN id % 4 = 3 THEN NULL ELSE id % 4 > 0 END AS empty FROM observations), i AS (SELECT *, count(*) FILTER (WHERE empty = false) OVER (PARTITION BY slug ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT id, slug, CAST(sum(CASE WHEN empty THEN 1 ELSE 0 END) OVER (PARTITION BY slug, island ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i""")
def body_drift(observations):
    """Articles without a body in a row; rounds in which none was fetched neither add nor reset."""
    empty = F.when(F.col("id") % 4 != 3, F.col("id") % 4 > 0)
    return windows.counter(observations.withColumn("empty", empty), "slug", F.col("empty"), ~F.col("empty"))


@query("observations", sql="SELECT id, coalesce(lag(current_lastmod) OVER (PARTITION BY slug ORDER BY ts, id) = current_lastmod, false) AS skip FROM observations")
def sitemap_skips(observations):
    before = F.lag("current_lastmod").over(windows.Window.partitionBy("slug").orderBy("ts", "id"))
    return observations.withColumn("before", before).select("id", streams.would_skip(F.col("before"), F.col("current_lastmod")).alias("skip"))


@query("entries", sql="SELECT entry_id, substr(sha1('h' || (entry_id % 9) || '|/p'), 1, 12) AS pattern_id FROM entries")
def pattern_ids(entries):
    return entries.select("entry_id", sites.pattern_id(F.concat(F.lit("h"), (F.col("entry_id") % 9).cast("string")), F.lit("/p")).alias("pattern_id"))
