"""The gates that a page passes before it becomes a source, and the marks that they look at.

A page's digest is one row, its repeating patterns are rows of another table. What the gates ask of the patterns is one aggregate over
them, so a page with very many patterns costs partial sums, and the gates themselves are expressions over the joined row.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import urls
from tidewatch.operators import sites

#: Words of a selector that stand for what frames a page, how many of its first patterns are looked at, how many must have
#: one, and how many links within the host are too many for a page that is only framed.
MARKETING_WORDS = ("nav", "footer", "header", "dropdown", "subnav", "menu", "carousel", "swiper", "tile", "promo", "hero", "banner")
MARKETING_FIRST, MARKETING_LEAST, MARKETING_LINKS = 7, 2, 15
#: Words of rows that are played or voted on and not read.
ACTION_WORDS = (
    "이상형월드컵", "이상형 월드컵", "월드컵", "시작하기", "랭킹보기", "투표하기", "참여하기", "결과보기", "라운드", "준결승", "결승전", "좋아요", "싫어요", "공유하기",
    "Vote now", "Start game", "Play now", "Round 1", "winner takes", "tournament", "bracket",
)
#: Query parameters that name a board, and those that name the menu it lies in, the likeliest first.
BOARD_KEYS = ("bbsId", "boardId", "boardtypeid", "bid")
MENU_KEYS = ("menuid", "menuId", "menuCd", "mId", "mid", "mnSeq")
#: Pages that ask for a login or for a choice instead of listing posts.
ASKS_LOGIN = r"(?i)(권한|인증|로그인|permission|auth|unauthori[sz]ed|alert\s*\()"
ASKS_CHOICE = r"(?i)(게시판을\s*선택|메뉴를\s*선택|목록이\s*없|등록된\s*게시물이\s*없|no\s+data|no\s+posts)"
#: Hosts of recordings, paths and media types of players, and the size under which a page is only a player.
AUDIO_HOSTS = r"(?i)(^|\.)(transistor\.fm|libsyn\.com|simplecast\.com|art19\.com|megaphone\.fm)$"
AUDIO_PATH = r"(?i)(?:\.(?:mp3|m4a|ogg|oga|wav)(?:$|[?#])|/(?:episodes?|s|e)/[^/?#]+)"
AUDIO_TYPE, HTML_TYPE, TINY_PAGE = r"(?i)^(?:audio/|video/)|^application/ogg(?:\b|;)", r"(?i)^text/html(?:\b|;)", 1024
#: Paths of challenges, to which a blocked click leads.
CHALLENGES = ("/sorry/", "/captcha", "/recaptcha", "/challenges/", "/challenge/", "/cdn-cgi/challenge")
#: Segments of a path that say that posts are announced there.
ANNOUNCEMENTS = r"(?i)/(news|notice|notices|announcement|announcements|topics|info|press|release|releases|notification|notifications|whatsnew|news-and-events|news-events)(/|$)"
#: Rows of a cluster that counts, and of one that is dense.
CLUSTER, DENSE = 5, 20


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def challenged(url: Column) -> Column:
    """Whether a URL is a challenge of a site that blocks."""
    return F.coalesce(any_of(F.lower(urls.path(url)).startswith(p) for p in CHALLENGES), F.lit(False))


def loose_path(href: Column) -> Column:
    """The path of an absolute or a relative link; what has no path stands for itself."""
    return F.coalesce(F.nullif(F.regexp_extract(href, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit("")), href)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def names_article(path: Column) -> Column:
    """Whether the last of two segments or more has a place for a number, is a slug of three words, or mixes digits and letters."""
    parts = segments(path)
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    dashes = F.length(last) - F.length(F.translate(last, "-_", ""))
    plain = F.translate(last, "._", "")
    mixed = plain.rlike(r"^[\p{L}\p{N}]+$") & last.rlike(r"\p{N}") & last.rlike(r"\p{L}")
    return (F.size(parts) >= 2) & (last.rlike(r"\{.*") & last.contains("}") | (F.length(last) >= 8) & ((dashes >= 2) | mixed))


def leads_to_article(url: Column, page_host: Column) -> Column:
    """Whether a click ended on an article: two segments or more, the last a number, an id or a long slug, on the page's host or by a query."""
    parts = segments(urls.path(url))
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    plain = F.translate(last, "-_", "")
    shaped = last.rlike(r"^\p{N}+$") | (F.length(last) >= 4) & plain.rlike(r"^[\p{L}\p{N}]+$") & last.rlike(r"\p{N}") | (F.length(last) >= 8) & last.rlike("[-_]")
    return F.coalesce((F.size(parts) >= 2) & shaped & ((urls.host(url) == page_host) | (urls.query(url) != "")), F.lit(False))


def pattern_sums(patterns: DataFrame, page_urls: DataFrame) -> DataFrame:
    """What the gates ask of a page's patterns (page_id, selector, n, sample_url, href_pattern, place): clusters of articles and of
    navigation within the host, without the page's own tabs; dense clusters below the page; patterns that link within the host; first
    patterns whose selectors frame."""
    p = patterns.join(page_urls.select("page_id", F.col("url").alias("page_url")), "page_id")
    link = F.coalesce(F.nullif("href_pattern", F.lit("")), F.nullif("sample_url", F.lit("")))
    p = p.withColumns({"link": link, "page_host": urls.host(F.col("page_url"))})
    board = F.coalesce(F.nullif(F.rtrim(F.lower(urls.path(F.col("page_url"))), F.lit("/")), F.lit("")), F.lit("/"))
    own = F.lower(F.concat(F.lit("/"), F.array_join(segments(loose_path(F.col("link"))), "/")))
    relative = urls.host(F.col("link")).isNull() & F.col("link").startswith("/")
    p = p.withColumns({"board": board, "own": own, "within": F.coalesce(relative | (urls.host(F.col("link")) == F.col("page_host")), F.lit(False))})
    p = p.withColumn("below", (F.col("board") != "/") & F.startswith("own", F.concat("board", F.lit("/"))))
    counts = F.col("within") & (F.col("n") >= CLUSTER) & (F.col("own") != F.col("board"))
    dense = F.col("within") & (F.col("n") >= DENSE) & F.col("below")
    placed_in_query = F.regexp_extract("link", r"^[^?#]*\?([^#]*)", 1).rlike(r"\{.*") & F.col("link").contains("}")
    article = names_article(loose_path(F.col("link"))) | dense & placed_in_query
    prefix = F.concat(F.lit("/"), F.coalesce(F.try_element_at(segments(loose_path(F.col("link"))), F.lit(1)), F.lit("")))
    same = lambda c: F.coalesce(urls.host(F.col(c)) == F.col("page_host"), F.lit(False))
    framing = F.lower(F.coalesce("selector", F.lit(""))).rlike("|".join(MARKETING_WORDS)) & (F.col("place") <= MARKETING_FIRST)
    p = p.select("page_id", "n", counts.alias("counts"), article.alias("article"), prefix.alias("prefix"), dense.alias("dense"), (same("href_pattern") | same("sample_url")).alias("same"), framing.alias("framing"))
    is_article, is_nav = F.col("counts") & F.col("article"), F.col("counts") & ~F.col("article")
    # prefixes are many only where clusters are: distinct prefixes are a set of the page's own first segments
    return p.groupBy("page_id").agg(
        F.count_if(is_article).alias("n_article"),
        F.coalesce(F.max(F.when(is_article, F.col("n"))), F.lit(0)).alias("max_article"),
        F.count_distinct(F.when(is_article, F.col("prefix"))).alias("n_prefixes"),
        F.coalesce(F.max(F.when(is_nav, F.col("n"))), F.lit(0)).alias("max_nav"),
        F.bool_or("dense").alias("dense_below"),
        F.count_if("same").alias("n_same_host"),
        F.count_if("framing").alias("n_framing"),
    )


def mixed_hub() -> Column:
    """Why articles don't dominate a page, null if they do: no clusters of articles, one that navigation outgrows, or several under
    different first segments that it outgrows. Pages with a validated feed are not asked; nor are pages of announcements that have a pager, a
    body by the post's id, a dense cluster below them, or whose click led to an article."""
    outgrown = F.col("max_nav") >= F.col("max_article")
    board = urls.path(F.col("page_url")).rlike(ANNOUNCEMENTS) & ((F.col("n_pagers") > 0) | (F.col("n_id_bodies") > 0) | F.col("dense_below") | leads_to_article(F.col("clicked_url"), urls.host(F.col("page_url"))))
    return (
        F.when(urls.host(F.col("page_url")).isNull() | (F.col("n_valid_feeds") > 0) | board, F.lit(None).cast("string"))
        .when(F.col("n_article") == 0, "no articles")
        .when(F.col("max_nav") == 0, F.lit(None))
        .when((F.col("n_article") == 1) & outgrown, "navigation dominates")
        .when((F.col("n_article") >= 2) & (F.col("n_prefixes") > 1) & outgrown, "scattered articles")
    )


#: The gates in the order in which they are asked.
GATES = ("nav_only", "diverging", "multi_host", "marketing", "board_shape", "first_post", "mixed_hub")


def passes(digests: DataFrame, patterns: DataFrame) -> DataFrame:
    """The digests (page_id, page_url, n_json, n_inline, n_hydration, n_feeds, n_valid_feeds, n_pagers, n_id_bodies, n_own_links, nav_only,
    article_meta, multi_host_hub, first_article_url, clicked_url) with what their patterns sum up to, a boolean for each gate (true: passed),
    the reason of the last one, and `rejected_by`, the first gate that a page doesn't pass.

    Nulls count as nothing seen; a page without a host passes the gates that compare hosts."""
    sums = pattern_sums(patterns, digests.select("page_id", F.col("page_url").alias("url")))
    numbers = ["n_article", "max_article", "n_prefixes", "max_nav", "n_same_host", "n_framing"]
    d = digests.join(sums, "page_id", "left")
    counts = [*numbers, "n_json", "n_inline", "n_hydration", "n_feeds", "n_valid_feeds", "n_pagers", "n_id_bodies", "n_own_links"]
    d = d.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts} | {c: F.coalesce(c, F.lit(False)) for c in ("dense_below", "nav_only", "article_meta", "multi_host_hub")})
    host = urls.host(F.col("page_url"))
    none = host.isNull()
    own = lambda c: F.coalesce(urls.host(F.col(c)) == host, F.lit(False))
    reached = own("first_article_url") | own("clicked_url") & ~challenged(F.col("clicked_url"))
    listed = (F.col("n_json") + F.col("n_inline") + F.col("n_hydration") + F.col("n_same_host")) > 0
    d = d.withColumns({"board_shape": none | listed | (F.col("n_feeds") > 0) | reached, "first_post": none | listed | reached, "hub_reason": mixed_hub()})
    framed = ~none & urls.path(F.col("page_url")).isin("", "/") & (F.col("n_framing") >= MARKETING_LEAST) & (F.col("n_own_links") <= MARKETING_LINKS)
    diverging = sites.diverges(F.col("article_meta"), F.col("page_url"), F.col("first_article_url")) & (urls.first_segment(F.col("page_url")) != "") & (urls.first_segment(F.col("first_article_url")) != "")
    d = d.select(
        *digests.columns,
        *(c for c in numbers if c not in digests.columns),
        (~F.col("nav_only") | (F.col("n_feeds") > 0)).alias("passes_nav_only"),
        (~F.coalesce(diverging, F.lit(False))).alias("passes_diverging"),
        (~F.col("multi_host_hub")).alias("passes_multi_host"),
        (~framed | F.col("board_shape")).alias("passes_marketing"),
        F.col("board_shape").alias("passes_board_shape"),
        F.col("first_post").alias("passes_first_post"),
        F.col("hub_reason").isNull().alias("passes_mixed_hub"),
        "hub_reason",
    )
    return d.withColumn("rejected_by", F.coalesce(*(F.when(~F.col(f"passes_{g}"), F.lit(g)) for g in GATES)))


def action_rows(patterns: DataFrame) -> DataFrame:
    """page_id, n_rows, words, sample: pages whose rows (five or more) name two or more actions; the sample is that of the first place."""
    words = F.filter(F.array(*map(F.lit, ACTION_WORDS)), lambda w: F.contains(F.col("sample"), w))
    found = patterns.where(F.col("n") >= CLUSTER).select("page_id", "place", "sample", words.alias("words")).where(F.size("words") >= 2)
    return found.groupBy("page_id").agg(F.count("*").alias("n_rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("words")))).alias("words"), F.min_by("sample", "place").alias("sample"))


def parameter(url: Column, key: str) -> Column:
    """The last value of a query parameter, null without one."""
    # a greedy start leaves the last
    return F.when(url.rlike(rf"^[^#?]*\?(?:[^#]*&)?{re.escape(key)}="), F.regexp_extract(url, rf"^[^#?]*\?(?:[^#]*&)?{re.escape(key)}=([^&#]*)", 1))


def missing_parameters(pages: DataFrame, anchors: DataFrame, patterns: DataFrame, most: int = 5) -> DataFrame:
    """page_id, symptom, suggested, candidates: pages (page_id, url, html) whose URL names a board and no menu, that list nothing (they
    ask for a login, for a choice, or have no rows), and whose links (page_id, node, href) to the same board name a menu. Of the menu parameters the one with most
    links is suggested, of equal ones the likelier."""
    named = any_of(parameter(F.col("url"), k).isNotNull() for k in BOARD_KEYS) & ~any_of(parameter(F.col("url"), k).isNotNull() for k in MENU_KEYS)
    listing = patterns.where((F.col("n") >= 3) & (F.coalesce("sample_url", F.lit("")) != "")).select("page_id").distinct()
    text = F.regexp_replace(F.col("html"), r"(?s)<[^>]*>", " ")
    tags = lambda t: F.regexp_count("html", F.lit(rf"(?i)<{t}\b"))
    symptom = F.when(F.col("html").rlike(ASKS_LOGIN), "auth_redirect").when(text.rlike(ASKS_CHOICE), "empty_shell").when((tags("tr") <= 1) & (tags("a") >= 1), "empty_rows")
    p = pages.where(named).join(listing, "page_id", "left_anti").select("page_id", F.col("url").alias("base"), symptom.alias("symptom")).where("symptom is not null")
    full = urls.absolute(F.col("href"), F.col("base"))
    a = anchors.join(p, "page_id").withColumn("full", full)
    trimmed = lambda c: F.rtrim(urls.path(F.col(c)), F.lit("/"))
    alike = (urls.host(F.col("full")) == urls.host(F.col("base"))) & ((trimmed("full") == trimmed("base")) | (urls.path(F.col("full")) == "") | (urls.path(F.col("base")) == ""))
    shared = any_of(F.coalesce(parameter(F.col("full"), k) == parameter(F.col("base"), k), F.lit(False)) for k in BOARD_KEYS)
    menus = F.filter(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(k).alias("key"), parameter(F.col("full"), k).alias("value")) for i, k in enumerate(MENU_KEYS))), lambda x: x["value"].isNotNull())
    found = a.where(alike & shared).select("page_id", "symptom", "node", "full", F.explode(menus).alias("m"))
    each = found.groupBy("page_id", "symptom", "m.rank", "m.key").agg(F.count("*").alias("k"), F.slice(F.array_sort(F.collect_set(F.struct("node", "full"))), 1, most).alias("links"))
    best = each.groupBy("page_id", "symptom").agg(F.max_by(F.struct("key", "links"), F.struct(F.col("k"), -F.col("rank"))).alias("x"))
    return best.select("page_id", "symptom", F.col("x.key").alias("suggested"), F.transform("x.links", lambda x: x["full"]).alias("candidates"))


def audio_hosts(candidates: DataFrame, responses: DataFrame, first: int = 10) -> DataFrame:
    """page_id, host, sample_url, confidence, evidence: the first of a page's candidates (page_id, pos, page_url, url) that leads to another
    host that only plays: by its response (page_id, url, content_type, n_bytes), by its path, or as its host is known."""
    bare = lambda u: F.regexp_replace(u, "#.*$", "")
    c = candidates.where(F.col("pos") < first).withColumn("full", urls.absolute(F.col("url"), F.col("page_url")))
    c = c.where(urls.host(F.col("full")).isNotNull() & ~F.coalesce(urls.host(F.col("full")) == urls.host(F.col("page_url")), F.lit(False))).withColumn("target", bare(F.col("full")))
    r = responses.groupBy("page_id", bare(F.col("url")).alias("target")).agg(F.min_by(F.struct("content_type", "n_bytes"), "pos").alias("r"))
    evidence = F.coalesce(
        F.when(F.col("r.content_type").rlike(AUDIO_TYPE), "har_content_type_audio").when(F.col("r.content_type").rlike(HTML_TYPE) & (F.col("r.n_bytes") < TINY_PAGE), "har_tiny_html_player"),
        F.when(urls.path(F.col("full")).rlike(AUDIO_PATH), "url_path_audio_player"),
    )
    known = F.when(evidence.isNull() & urls.host(F.col("full")).rlike(AUDIO_HOSTS), "known_host_suffix")
    found = c.join(r, ["page_id", "target"], "left").select("page_id", "pos", urls.host(F.col("full")).alias("host"), F.col("full").alias("sample_url"), F.when(known.isNull(), "structural").otherwise("host_known").alias("confidence"), F.coalesce(evidence, known).alias("evidence"))
    best = found.where("evidence is not null").groupBy("page_id").agg(F.min_by(F.struct("host", "sample_url", "confidence", "evidence"), "pos").alias("x"))
    return best.select("page_id", "x.*")
