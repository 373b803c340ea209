"""What pages are made of: nodes as rows, repeating patterns, links, feeds, meta signals, pagers, texts."""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import dom, urls
from tidewatch.functions.scratch import tidy
from tidewatch.functions.transforms import html_unescape

#: Columns of nodes. Ancestors, the tags and roles above a node, and its place among the page's links stand at links alone; links and
#: link_data at nodes with siblings: the different links within a node or of itself, each with its first anchor, and data attributes of the first.
NODE = {
    "page_id": "long", "node": "int", "parent": "int", "position": "int", "tag": "string", "element_id": "string", "classes": "array<string>", "attrs": "map<string,string>", "own_text": "string",
    "text": "string", "n_children": "int", "ancestors": "array<int>", "skeleton": "boolean", "up_tag": "string", "up_id": "string", "up_classes": "array<string>", "up_children": "int",
    "above": "array<string>", "above_roles": "array<string>", "nth_link": "int", "links": "array<struct<href:string,node:int>>", "link_data": "map<string,string>",
}
ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "map<string,string>": pa.map_(pa.string(), pa.string()),
    "array<array<string>>": pa.list_(pa.list_(pa.string())), "array<struct<href:string,node:int>>": pa.list_(pa.struct([("href", pa.string()), ("node", pa.int32())])),
}
SKIPPED = ("script", "style", "meta", "link")
#: Characters of a repeating pattern's sample, and of a data attribute's value, and attributes of a row.
MAX_SAMPLE = 120
MAX_VALUE = 80
MAX_ATTRS = 8
#: Marks of rows that are only drawn until data comes, descendants that are looked at for them, and tags of drawings.
SKELETON = re.compile(r"skeleton|loading|placeholder", re.I)
SKELETON_DEPTH = 10
VISUAL = ("svg", "g", "path", "circle", "rect", "polygon", "use", "defs")
#: Characters of text that one batch of nodes holds at most, unless a single node has more.
BATCH_CHARS = 8 << 20
BATCH_ROWS = 4096
#: A call in a link.
SCRIPT_CALL = r"(?i)(?:javascript:\s*)?([A-Za-z_$][\w$]*)\s*\(\s*['\"]?([A-Za-z0-9_-]+)['\"]?"
#: Schema.org's types of an article, and how deep they are looked for.
ARTICLE_TYPES = frozenset(
    "article newsarticle blogposting scholarlyarticle techarticle report socialmediaposting discussionforumposting review medicalscholarlyarticle "
    "analysisnewsarticle opinionnewsarticle reportagenewsarticle backgroundnewsarticle satiricalarticle".split()
)
MAX_LD_DEPTH = 8


def nodes(pages: DataFrame, *columns: str, wanted: Callable[[dom.Node], bool] | None = None) -> DataFrame:
    """Every element of every page (page_id, html) as a row, with its own text and all text within it, and whether it holds one that only
    fills a place until data comes; with the page's url as own_url where pages have it. Named columns alone are made, besides page_id and
    node, and of the nodes only those that are wanted."""
    made = ["node", *(c for c in columns if c not in ("page_id", "node"))] if columns else [c for c in NODE if c != "page_id"]
    base = ["url"] if "url" in pages.columns else []
    names = ["page_id", *made, *("own_url" for _ in base)]
    arrow = [ARROW[NODE.get(c, "string")] for c in names]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, size = [], 0
        for batch in batches:
            for row in range(len(batch)):
                page_id, html, *url = (c[row].as_py() for c in batch.columns)
                page = _Page(dom.parse(html or ""))
                makers = [getattr(page, c) for c in made]
                size += len(html or "")
                for k, n in enumerate(page.every):
                    if wanted is None or wanted(n):
                        cells.append([page_id, *(f(n, k) for f in makers), *url])
                        size += sum(len(x) for x in cells[-1] if isinstance(x, str))
                        if size >= BATCH_CHARS or len(cells) >= BATCH_ROWS:
                            yield _batch(cells, names, arrow)
                            cells, size = [], 0
                page.forget()
        if cells:
            yield _batch(cells, names, arrow)

    return pages.select("page_id", "html", *base).mapInArrow(tidy(explode), ", ".join(f"{c} {NODE.get(c, 'string')}" for c in names))


def _batch(cells: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), kinds, strict=True)], names)


class _Page:
    """The columns of a page's nodes by name."""

    def __init__(self, root: dom.Node):
        self.every = list(root.walk())
        self.number = {id(n): k for k, n in enumerate(self.every)}

    def forget(self) -> None:
        """Takes the tree apart, which nothing but a search for cycles would free."""
        for n in self.every:
            n.parent = None

    def node(self, n: dom.Node, k: int) -> int:
        return k

    def parent(self, n: dom.Node, k: int) -> int:
        return self.number.get(id(n.parent), -1)

    def position(self, n: dom.Node, k: int) -> int:
        return n.index

    def tag(self, n: dom.Node, k: int) -> str:
        return n.tag

    def element_id(self, n: dom.Node, k: int) -> str | None:
        return n.attrs.get("id")

    def classes(self, n: dom.Node, k: int) -> list[str]:
        return n.classes

    def attrs(self, n: dom.Node, k: int) -> list[tuple[str, str]]:
        return list(n.attrs.items())

    def own_text(self, n: dom.Node, k: int) -> str:
        return "".join(p for p in n.parts if isinstance(p, str)).strip()

    def text(self, n: dom.Node, k: int) -> str:
        return n.text()

    def n_children(self, n: dom.Node, k: int) -> int:
        return len(n.children)

    def _above(self, n: dom.Node) -> list[dom.Node]:
        out, up = [], n.parent
        while up is not None and id(up) in self.number:
            out.append(up)
            up = up.parent
        return out

    def ancestors(self, n: dom.Node, k: int) -> list[int] | None:
        return [self.number[id(x)] for x in self._above(n)] if n.tag == "a" else None

    def above(self, n: dom.Node, k: int) -> list[str] | None:
        return [x.tag for x in self._above(n)] if n.tag == "a" else None

    def above_roles(self, n: dom.Node, k: int) -> list[str] | None:
        return [x.attrs["role"] for x in self._above(n) if "role" in x.attrs] if n.tag == "a" else None

    def up_tag(self, n: dom.Node, k: int) -> str | None:
        return n.parent.tag if id(n.parent) in self.number else None

    def up_id(self, n: dom.Node, k: int) -> str | None:
        return n.parent.attrs.get("id")

    def up_classes(self, n: dom.Node, k: int) -> list[str]:
        return n.parent.classes

    def up_children(self, n: dom.Node, k: int) -> int:
        return len(n.parent.children)

    @cached_property
    def _last(self) -> list[int]:
        """Of each node's descendants, which follow it."""
        last = list(range(len(self.every)))
        for k in range(len(last) - 1, -1, -1):
            if (up := self.number.get(id(self.every[k].parent), -1)) >= 0:
                last[up] = max(last[up], last[k])
        return last

    @cached_property
    def _marked(self) -> list[int]:
        return [k for k, n in enumerate(self.every) if "class" in n.attrs and SKELETON.search(n.attrs["class"])]

    @cached_property
    def _hrefs(self) -> list[int]:
        return [k for k, n in enumerate(self.every) if n.tag == "a" and "href" in n.attrs]

    def skeleton(self, n: dom.Node, k: int) -> bool:
        at = bisect_right(self._marked, k)
        return at < len(self._marked) and self._marked[at] <= min(self._last[k], k + SKELETON_DEPTH)

    def nth_link(self, n: dom.Node, k: int) -> int | None:
        return bisect_left(self._hrefs, k) if n.tag == "a" and "href" in n.attrs else None

    def links(self, n: dom.Node, k: int) -> list[dict] | None:
        if len(n.parent.children) < 2:
            return None
        first: dict[str, int] = {}  # hrefs() with the nodes
        for j in self._hrefs[bisect_left(self._hrefs, k) : bisect_right(self._hrefs, self._last[k])]:
            first.setdefault(self.every[j].attrs["href"], j)
        return [{"href": h, "node": j} for h, j in first.items()]

    def hrefs(self, k: int) -> tuple[str, ...]:
        """The different links within a node or of itself, in their order."""
        own = self._hrefs[bisect_left(self._hrefs, k) : bisect_right(self._hrefs, self._last[k])]
        return tuple(dict.fromkeys(self.every[j].attrs["href"] for j in own))

    def link_data(self, n: dom.Node, k: int) -> list[tuple[str, str]] | None:
        at = bisect_left(self._hrefs, k)
        if len(n.parent.children) < 2 or at == len(self._hrefs) or self._hrefs[at] > self._last[k]:
            return None
        return [x for x in self.every[self._hrefs[at]].attrs.items() if x[0].startswith("data-")]


def ld_types(x: object, depth: int = 0) -> Iterator[str]:
    """Every @type in a JSON-LD document."""
    if depth > MAX_LD_DEPTH:
        return
    if isinstance(x, dict):
        own = x.get("@type")
        yield from (t for t in (own if isinstance(own, list) else [own]) if isinstance(t, str))
    for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        yield from ld_types(v, depth + 1)


@F.udf(returnType=T.BooleanType(), useArrow=True)
def names_article(script):
    """Whether a JSON-LD script names a type of article; scripts that aren't JSON name none."""
    try:
        return bool(script) and any(t.strip().lower() in ARTICLE_TYPES for t in ld_types(json.loads(script)))
    except (ValueError, RecursionError):
        return False


def signature(tag: Column, classes: Column) -> Column:
    """tag.class1.class2 with all classes."""
    return F.array_join(F.concat(F.array(tag), classes), ".")


def common_prefix(texts: Column) -> Column:
    """What all texts of an array begin with: what the least and the greatest of them share. Null where that is nothing."""
    low, high = F.array_min(texts), F.array_max(texts)
    n = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda k: F.substr(low, F.lit(1), k) == F.substr(high, F.lit(1), k)))
    return F.nullif(F.substr(low, F.lit(1), n), F.lit(""))


#: What repeating_patterns reads of nodes.
PATTERN_COLUMNS = ("parent", "tag", "classes", "attrs", "text", "skeleton", "up_tag", "up_id", "up_classes", "up_children", "links", "link_data")


def best_link(links: Column, base: Column) -> Column:
    """Of a node's links (href, node) the one that most looks like an article, of equals the first; base tells links of the site apart."""
    # a link's full form and its score are variables of their own: written out in each other they make too large an expression
    full = F.transform(links, lambda x: F.struct(x["href"].alias("href"), x["node"].alias("node"), F.coalesce(urls.absolute(x["href"], base), x["href"]).alias("full")))
    score = lambda x: F.when(urls.is_script(x["href"]), F.lit(-1)).otherwise(urls.article_score(x["full"], base))
    best = F.array_max(F.transform(full, lambda x: F.struct(score(x).alias("score"), (-x["node"]).alias("order"), x["href"].alias("href"))))["href"]
    return F.when(F.size(links) == 1, links[0]["href"]).when(F.size(links) > 1, best)


def sampled(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, MAX_SAMPLE)


def repeating_patterns(node_rows: DataFrame, page_urls: DataFrame | None = None, least: int = 3, most: int = 15) -> DataFrame:
    """Groups of like children of one parent, ranked within each page: page_id, selector, n, sample, href_pattern, href_prefix, sample_href,
    href_is_script, variants (signatures of the parent's other groups of that tag), merged_count, data_attrs (of the first row), calls (functions
    that its rows' links call), place. page_urls (page_id, url) tells links of the site apart, and is read where nodes don't have the page's url.

    Children are grouped by page, parent and signature, which is one aggregate: a row has what it needs of its parent and of the links
    within it, so that groups and not rows are shuffled. Groups whose first row only fills a place until data comes are left out.
    """
    if least < 2:
        raise ValueError("least is 2 at least: an only child repeats nothing")
    if page_urls is None:
        node_rows = node_rows.withColumn("own_url", F.lit(None).cast("string"))
    elif "own_url" not in node_rows.columns:
        node_rows = node_rows.join(page_urls.select("page_id", F.col("url").alias("own_url")), "page_id", "left")
    # samples are cut before the shuffle
    rows = node_rows.where((F.col("tag") != "") & ~F.col("tag").isin(*SKIPPED)).where(F.col("up_children") >= least).where("up_tag <> 'head'")
    selector = F.when(F.col("up_id").isNotNull(), F.concat(F.lit("#"), "up_id")).otherwise(signature(F.col("up_tag"), F.col("up_classes")))
    rows = rows.select("page_id", "node", "parent", selector.alias("parent_signature"), "tag", "classes", "attrs", "skeleton", sampled(F.col("text")).alias("sample"), best_link(F.col("links"), F.col("own_url")).alias("href"), F.col("link_data").alias("first_attrs"))
    real = F.when(~urls.is_script(F.col("href")), F.col("href"))
    data = F.map_filter(F.map_concat(F.map_filter(F.coalesce("first_attrs", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(F.col("attrs"), k)), "attrs"), lambda k, _: k.startswith("data-"))
    groups = rows.withColumn("real", real).groupBy("page_id", "parent", "parent_signature", "tag", signature(F.col("tag"), F.col("classes")).alias("own")).agg(
        F.count("*").alias("n"),
        F.min_by("sample", "node").alias("sample"),
        F.min_by("real", F.when(F.col("real").isNotNull(), F.col("node"))).alias("sample_href"),
        (F.count("href") > 0).alias("linked"),
        F.min("real").alias("low"),
        F.max("real").alias("high"),
        F.collect_set(F.when(urls.is_script(F.col("href")), F.nullif(F.regexp_extract("href", SCRIPT_CALL, 1), F.lit("")))).alias("calls"),
        F.min_by("skeleton", "node").alias("skeleton"),
        F.min_by(data, "node").alias("data"),
    )
    return ranked_patterns(groups, least, most)


GROUP = {
    "page_id": "long", "parent": "int", "up_tag": "string", "up_id": "string", "up_classes": "array<string>", "tag": "string", "own": "string", "n": "long", "text": "string",
    "skeleton": "boolean", "data": "map<string,string>", "choices": "array<array<string>>",
}


def sibling_groups(pages: DataFrame, least: int = 3) -> DataFrame:
    """Groups of like children of the parents that have `least` children or more: page_id, parent, its tag, id and classes, tag, own (signature),
    n, text, skeleton and data (attributes) of the first, choices (the different lists of links that the children have), own_url."""
    base = ["url"] if "url" in pages.columns else []
    names = [*GROUP, *("own_url" for _ in base)]
    arrow = [ARROW[GROUP.get(c, "string")] for c in names]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, size = [], 0
        for batch in batches:
            for row in range(len(batch)):
                page_id, html, *url = (c[row].as_py() for c in batch.columns)
                page = _Page(dom.parse(html or ""))
                size += len(html or "")
                for up, parent in enumerate(page.every):
                    if len(parent.children) < least or parent.tag == "head":
                        continue
                    groups: dict[tuple[str, str], list[dom.Node]] = {}
                    for n in parent.children:
                        if n.tag not in SKIPPED:
                            groups.setdefault((n.tag, ".".join([n.tag, *n.classes])), []).append(n)
                    for (tag, own), rows in groups.items():
                        first, k = rows[0], page.number[id(rows[0])]
                        data = [x for x in page.link_data(first, k) or [] if x[0] not in first.attrs] + [x for x in first.attrs.items() if x[0].startswith("data-")]
                        choices = list(dict.fromkeys(filter(None, (page.hrefs(page.number[id(n)]) for n in rows))))
                        cells.append([page_id, up, parent.tag, parent.attrs.get("id"), parent.classes, tag, own, len(rows), first.text(), page.skeleton(first, k), data, choices, *url])
                        size += len(cells[-1][8])
                        if size >= BATCH_CHARS or len(cells) >= BATCH_ROWS:
                            yield _batch(cells, names, arrow)
                            cells, size = [], 0
                page.forget()
        if cells:
            yield _batch(cells, names, arrow)

    return pages.select("page_id", "html", *base).mapInArrow(tidy(explode), ", ".join(f"{c} {GROUP.get(c, 'string')}" for c in names))


def page_patterns(pages: DataFrame, least: int = 3, most: int = 15) -> DataFrame:
    """repeating_patterns of pages (page_id, html, and url to tell links of the site apart): groups leave the scan of a page whole, so that
    neither rows nor links are shuffled."""
    found = sibling_groups(pages, least)
    found = found if "own_url" in found.columns else found.withColumn("own_url", F.lit(None).cast("string"))
    numbered = lambda c: F.transform(c, lambda h, k: F.struct(h.alias("href"), k.alias("node")))
    found = found.withColumn("best", F.transform("choices", lambda c: best_link(numbered(c), F.col("own_url"))))
    found = found.withColumn("reals", F.filter("best", lambda h: ~urls.is_script(h)))
    calls = F.transform(F.filter("best", lambda h: urls.is_script(h)), lambda h: F.nullif(F.regexp_extract(h, SCRIPT_CALL, 1), F.lit("")))
    selector = F.when(F.col("up_id").isNotNull(), F.concat(F.lit("#"), "up_id")).otherwise(signature(F.col("up_tag"), F.col("up_classes")))
    groups = found.select(
        "page_id", "parent", selector.alias("parent_signature"), "tag", "own", "n", sampled(F.col("text")).alias("sample"), F.try_element_at("reals", F.lit(1)).alias("sample_href"), (F.size("best") > 0).alias("linked"),
        F.array_min("reals").alias("low"), F.array_max("reals").alias("high"), F.array_distinct(F.array_compact(calls)).alias("calls"), "skeleton", "data",
    )
    return ranked_patterns(groups, least, most)


def ranked_patterns(groups: DataFrame, least: int, most: int) -> DataFrame:
    """The groups of repeating_patterns with their variants, ranked within each page."""
    siblings = groups.where("n >= 2").groupBy("page_id", "parent", "tag").agg(F.sum("n").alias("all_n"), F.collect_set("own").alias("all_own"))
    groups = groups.where((F.col("n") >= least) & ~F.col("skeleton")).join(siblings, ["page_id", "parent", "tag"], "left")
    others = F.array_sort(F.array_remove("all_own", F.col("own")))
    attrs = F.map_from_entries(F.slice(F.array_sort(F.map_entries("data")), 1, MAX_ATTRS))
    groups = groups.select(
        "page_id", "parent", F.concat_ws(" > ", "parent_signature", "own").alias("selector"), "n", "sample", "sample_href", urls.href_pattern(F.col("sample_href")).alias("href_pattern"),
        common_prefix(F.array("low", "high")).alias("href_prefix"), (F.col("linked") & F.col("sample_href").isNull()).alias("href_is_script"), others.alias("variants"),
        F.when(F.size(others) > 0, F.col("all_n")).alias("merged_count"), F.transform_values(attrs, lambda _, v: F.substring(v, 1, MAX_VALUE)).alias("data_attrs"), F.array_sort("calls").alias("calls"),
        (F.when(F.col("sample_href").isNull(), 1).otherwise(0) + F.when(F.col("sample") == "", 1).otherwise(0) + F.when(F.col("tag").isin(*VISUAL), 2).otherwise(0)).alias("penalty"),
    )
    order = (F.asc("penalty"), F.desc("n"), F.desc(F.col("sample_href").isNotNull()), F.desc(F.length("sample")), F.asc("selector"), F.asc("parent"))
    best = groups.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "selector").orderBy(*order))).where("k = 1")
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(*order))).where(F.col("place") <= most)
    return ranked.drop("k", "penalty", "parent")


def links(node_rows: DataFrame) -> DataFrame:
    """page_id, node, href, text of the anchors."""
    return node_rows.where("tag = 'a' and attrs['href'] is not null").select("page_id", "node", F.col("attrs")["href"].alias("href"), "text")


def _feed_rank() -> Column:
    """Of a node: 0 of an alternate of a feed type, 1 of an anchor whose path names a feed."""
    a, tag = F.col("attrs"), F.col("tag")
    alternate = F.array_contains(F.split(F.lower(a["rel"]), r"\s+"), "alternate") & F.lower(a["type"]).rlike("rss|atom")
    return F.when((tag == "link") & alternate, 0).when((tag == "a") & F.lower(a["href"]).rlike(r"(^|[/._-])(rss|feed|atom)([/._?-]|$)"), 1)


def feed_links(node_rows: DataFrame) -> DataFrame:
    """page_id, href, source: alternates of a feed type, and anchors whose path names a feed; of equal hrefs the first source wins."""
    every = node_rows.select("page_id", F.col("attrs")["href"].alias("href"), _feed_rank().alias("rank")).where("rank is not null and href is not null")
    return every.groupBy("page_id", "href").agg(F.min("rank").alias("rank")).select("page_id", "href", F.when(F.col("rank") == 0, "link_rel").otherwise("html_body").alias("source"))


#: What meta_signals reads of nodes, and of which; the first node stands for a page that has no signal.
SIGNAL_COLUMNS = ("tag", "attrs", "own_text", "text")


def signalling(n: dom.Node) -> bool:
    return n.tag in ("title", "meta", "script") or "itemtype" in n.attrs or n.index == 0 and not n.parent.tag


def meta_signals(node_rows: DataFrame) -> DataFrame:
    """page_id, og_type, has_article_ld, has_microdata, title."""
    a = F.col("attrs")
    script = F.when((F.col("tag") == "script") & F.lower(a["type"]).contains("application/ld+json"), F.col("own_text"))
    return node_rows.withColumn("_ld", F.when(script.isNotNull(), names_article(script))).groupBy("page_id").agg(
        F.max(F.when((F.col("tag") == "meta") & (a["property"] == "og:type"), a["content"])).alias("og_type"),
        F.bool_or("_ld").alias("has_article_ld"),
        F.bool_or(F.coalesce(a["itemtype"].rlike("schema.org/[A-Za-z]*(Article|Posting)"), F.lit(False))).alias("has_microdata"),
        F.min_by(F.when(F.col("tag") == "title", F.col("text")), F.when(F.col("tag") == "title", F.col("node"))).alias("title"),
    )


#: Columns and nodes of links, with their places; feed_links, pager_hints and link_hints read tag and attrs.
HINT_COLUMNS = ("tag", "attrs", "nth_link")


def hinting(n: dom.Node) -> bool:
    return n.tag in ("a", "link")


def _hint(kind: str, name: Column, n: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"), (F.lit(None).cast("string") if n is None else n).alias("n"))


def _pagers() -> list[Column]:
    """Of a node: the hints that an anchor's href gives, with null names where it gives none."""
    href, path = F.when(F.col("tag") == "a", F.col("attrs")["href"]), r"^(.*/page/)([0-9]+)"
    shown = lambda pattern, k: F.nullif(F.regexp_extract(href, pattern, k), F.lit(""))
    return [_hint("query", shown(r"[?&](page|p|pg|offset|start|skip|cursor|_page|page_num)=[0-9]+", 1)), _hint("path", shown(path, 1), shown(path, 2))]


def _gathered(node_rows: DataFrame, *found: Column) -> DataFrame:
    every = node_rows.select("page_id", F.explode(F.array(*found)).alias("x")).select("page_id", "x.*").where("name is not null")
    # the least and the greatest number combine before the shuffle, where different ones would be a row each
    sums = every.groupBy("page_id", "kind", "name").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    return sums.where("kind <> 'path' or low <> high").select("page_id", "kind", "name")


def pager_hints(node_rows: DataFrame) -> DataFrame:
    """page_id, kind, name: query parameters with a page number, and /page/N paths with two different numbers or more, of all a page's links."""
    return _gathered(node_rows, *_pagers())


def link_hints(node_rows: DataFrame) -> DataFrame:
    """page_id, kind, name: the hrefs of feed_links as kind feed, and pager_hints, in one scan of the pages."""
    return _gathered(node_rows, _hint("feed", F.when(_feed_rank().isNotNull(), F.col("attrs")["href"])), *_pagers())


def page_text(html: Column, most: int = 6000) -> Column:
    """Visible text, roughly: scripts, styles and comments cut, tags as line breaks, entities read."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>", ""), r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(bare, r"(?s)<[^>]*>", "\n")
    text = F.replace(html_unescape(text), F.lit("\u00a0"), F.lit(" "))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.array_join(lines, "\n"), 1, most)


def cleaned_html(html: Column, most: int = 60_000) -> Column:
    """Without scripts, styles, frames, comments, handlers and data: URLs; white space joined; cut behind the last tag that fits."""
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript|iframe|svg|template|object|canvas|embed)\b.*?</\1>", "")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, r"""(?i)\s+on[a-z]+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "")
    x = F.regexp_replace(x, r"""(?i)(src|href)\s*=\s*(["'])data:[^"']*\2""", "")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    cut = F.substring(x, 1, most)
    return F.when(F.length(x) <= most, x).otherwise(F.regexp_replace(cut, r"(?s)>[^>]*$", ">"))


#: Marks by which a page's platform is told.
PLATFORMS = {
    "wordpress": r"wp-content|wp-json|wp-includes",
    "storyblok": r"a\.storyblok\.com|api\.storyblok\.com",
    "discourse": r'content="Discourse|data-discourse',
    "medium": r"cdn-client\.medium\.com|medium\.com/_/",
    "xenforo": r'id="XF"|data-xf-init',
    "lemmy": r"lemmy-ui|window\.isoData",
    "mastodon": r'id="mastodon"|mastodon-',
    "misskey": r"misskey",
    "pixelfed": r"pixelfed",
    "peertube": r"PeerTube",
    "mbin": r"mbin|kbin",
}


def platforms(html: Column) -> Column:
    """Names of the platforms whose marks a page holds."""
    return F.array_compact(F.array(*(F.when(html.rlike(mark), F.lit(name)) for name, mark in PLATFORMS.items())))


def hydration(html: Column) -> Column:
    """The JSON text of a page's hydration blob, if it has one."""
    script = F.regexp_extract(html, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    variable = F.regexp_extract(html, r"(?s)window\.__(?:NUXT|INITIAL_STATE)__\s*=\s*(\{.*?\})\s*(?:;|</script>)", 1)
    return F.coalesce(F.nullif(script, F.lit("")), F.nullif(variable, F.lit("")))


_ARRAY = re.compile(r"(?:var|let|const)\s+\w+\s*=\s*(\[)|\w+(?:\.\w+)*\.push\(\s*(\{)")


def _balanced(text: str, at: int) -> str | None:
    depth, quote, k = 0, "", at
    while k < len(text):
        c = text[k]
        if quote:
            k += c == "\\"
            quote = "" if c == quote and text[k] == c else quote
        elif c in "\"'`":
            quote = c
        elif c in "[{(":
            depth += 1
        elif c in "]})":
            depth -= 1
            if not depth:
                return text[at : k + 1]
        k += 1
    return None


def inline_data(pages: DataFrame) -> DataFrame:
    """page_id, kind, json: array literals and pushed objects of a page's scripts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page_id, text in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for script in re.findall(r"(?is)<script\b[^>]*>(.*?)</script>", text or ""):
                    for m in _ARRAY.finditer(script):
                        if data := _balanced(script, m.start(1) if m[1] else m.start(2)):
                            out.append((page_id, "array" if m[1] else "push", data))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["page_id", "kind", "json"])

    return pages.select("page_id", "html").mapInArrow(scan, "page_id long, kind string, json string")
