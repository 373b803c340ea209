"""What a page's markup says beside its lists: addresses that scripts put together, classes of components, a folded form for prompts, and
portfolios of one person.

Scripts and styles are read by expressions; only folding needs the tree, in Arrow batches.
"""

from __future__ import annotations

import html as charrefs
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import dom, urls
from tidewatch.operators.pages import SCRIPT_CALL

#: A function, and an assignment to the page's address.
FUNCTION = r"(?is)function\s+([A-Za-z_$][\w$]*)\s*\(([^)]*)\)\s*\{(.*?)\}"
LOCATION = r"(?is)(?:location(?:\.href)?|window\.location(?:\.href)?|document\.location)\s*=\s*([^;]+)"
#: How many like siblings stay, and characters of a text and of a data attribute's value, beyond which they are cut.
KEEP_SIBLINGS, TEXT_CAP, VALUE_CAP = 3, 200, 80
#: Characters of a style block that are read, rules that a class must stand in, classes and their companions that are kept.
STYLE_CHARS, MIN_RULES, TOP_CLASSES, TOP_COMPANIONS = 500_000, 2, 8, 3
#: Classes that say how something looks, or that any page has.
PLAIN_CLASSES = "|".join((
    r"^(m|p|mt|mr|mb|ml|mx|my|pt|pr|pb|pl|px|py)-\w+$", r"^col(?:-(?:xs|sm|md|lg|xl|2xl))?-\d+$",
    r"^(text|bg|border|font|w|h|min|max|min-w|min-h|max-w|max-h|gap|space|leading|tracking|rounded|shadow|cursor|overflow|opacity|z|order|inset|top|right|bottom|left|whitespace|align|justify|items|content|self|grid|flex|hidden|block|inline|inline-block|sr|not-sr|visible|invisible)-[\w/.-]+$",
    r"^(rounded|shadow|truncate|underline|capitalize|uppercase|lowercase|italic|antialiased)$", r"^(flex|grid|block|inline|inline-block|table|hidden|relative|absolute|fixed|sticky|static)$",
    r"^p-(component|button|dropdown|inputtext|menu|menubar|menuitem|submenu|dialog|sidebar|toast|tooltip|skeleton|inputwrapper|inputgroup|inputprefix|inputsuffix|datatable|datepicker|calendar|chip|tag|badge|avatar|card|panel|fieldset|message|messages|password|placeholder|highlight|disabled|focus|hover|active|selected|expanded|collapsed)[\w-]*$",
    r"^pi(?:-[\w-]+)?$",
    r"^(btn(?:-\w+)?|nav(?:-\w+)?|navbar(?:-\w+)?|form(?:-\w+)?|input(?:-\w+)?|card-(?:body|header|footer|title|text)|list-group(?:-\w+)?|breadcrumb(?:-\w+)?|page-(?:link|item)|pagination(?:-\w+)?|alert(?:-\w+)?|badge(?:-\w+)?|spinner(?:-\w+)?|carousel(?:-\w+)?|collapse|dropdown(?:-\w+)?|modal(?:-\w+)?|tooltip(?:-\w+)?|popover(?:-\w+)?|table(?:-\w+)?)$",
    r"^(sm|md|lg|xl|2xl|hover|focus|active|visited|first|last|odd|even|group-hover):.+$",
    r"^(nav|navbar|navigation|header|footer|sidebar|menu|menubar|breadcrumb|breadcrumbs|skeleton|loading|placeholder|spinner|shimmer|ghost|empty-state|toolbar|topbar|bottombar|overlay|backdrop|dimmer)(?:-[\w-]+)?$",
    r"^(container|wrapper|inner|outer|body|main|content|fields|row|col|item|grid|section|article|aside|figure|head|title|subtitle|description|label|input|button|link|icon|image|img|video|audio|svg|text|copy|para|paragraph|block|element|widget|component|box|panel|popup|tooltip|modal|dialog|alert|notice|banner|hero|page|view|frame|layer|stack|cluster|cell|line|divider|separator|spacer)$",
))


# --- addresses out of handlers --------------------------------------------------------------------------------------------------


def template(expression: Column, parameter: Column) -> Column:
    """The address that a concatenation of literals and the parameter makes, with {post_id} for the parameter; null if it has other
    parts, fewer than two, or not the parameter."""
    parts = F.transform(F.split(expression, r"\+"), lambda p: F.regexp_replace(F.regexp_replace(p, r"^\s+", ""), r"\s+$", ""))
    literal = lambda p: p.rlike(r"^(?s)(?:'.*'|\".*\")$") & (F.length(p) >= 2)
    is_parameter = lambda p: ~literal(p) & ((p == parameter) | F.endswith(p, F.concat(F.lit("."), parameter)))
    values = F.transform(parts, lambda p: F.when(literal(p), F.substring(p, F.lit(2), F.length(p) - 2)).when(is_parameter(p), F.lit("{post_id}")))
    known = F.forall(values, lambda v: v.isNotNull()) & F.exists(parts, is_parameter) & (F.size(parts) >= 2)
    return F.when(known, F.array_join(values, ""))


def handler_calls(node_rows: DataFrame) -> DataFrame:
    """page_id, node, attribute, function, argument of the calls in links and in handlers of clicks."""
    each = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(a).alias("attribute"), F.col("attrs")[a].alias("raw")) for k, a in enumerate(("href", "onclick"))))
    found = node_rows.select("page_id", "node", F.inline(F.filter(each, lambda x: x["raw"].isNotNull())))
    return found.where(F.col("raw").rlike(SCRIPT_CALL)).select("page_id", "node", "rank", "attribute", F.regexp_extract("raw", SCRIPT_CALL, 1).alias("function"), F.regexp_extract("raw", SCRIPT_CALL, 2).alias("argument"))


def detail_templates(pages: DataFrame, node_rows: DataFrame) -> DataFrame:
    """page_id, pos, function, sample_id, detail_url_template: addresses of posts (pages: page_id, url, html) that functions of a page put
    together out of their first parameter, and which links or handlers call; of equal ones the first. sample_id is the first call's argument."""
    calls = handler_calls(node_rows).groupBy("page_id", "function").agg(F.min_by("argument", F.struct("node", "rank")).alias("sample_id"))
    bodies = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(FUNCTION), F.lit(0))).alias("pos", "f"))
    part = lambda k: F.regexp_extract("f", FUNCTION, k)
    first = F.try_element_at(F.filter(F.transform(F.split(part(2), ","), lambda p: F.trim(p)), lambda p: p != ""), F.lit(1))
    bodies = bodies.select("page_id", "url", "pos", part(1).alias("function"), first.alias("parameter"), F.nullif(F.regexp_extract(part(3), LOCATION, 1), F.lit("")).alias("expression"))
    bodies = bodies.where("parameter is not null and expression is not null").withColumn("template", template(F.col("expression"), F.col("parameter")))
    found = bodies.where("template <> ''").join(calls, ["page_id", "function"]).withColumn("detail_url_template", urls.absolute(F.col("template"), F.col("url")))
    return found.groupBy("page_id", "function", "detail_url_template").agg(F.min("pos").alias("pos"), F.min("sample_id").alias("sample_id")).select("page_id", "pos", "function", "sample_id", "detail_url_template")


def with_templates(patterns: DataFrame, templates: DataFrame) -> DataFrame:
    """Patterns (with page_id, place and calls, the functions that their rows' links call) with detail_url_template, of the first function
    that has one, null if none has."""
    called = patterns.select("page_id", "place", F.explode("calls").alias("function")).join(templates, ["page_id", "function"])
    best = called.groupBy("page_id", "place").agg(F.min_by("detail_url_template", "pos").alias("detail_url_template"))
    return patterns.join(best, ["page_id", "place"], "left")


# --- classes of components ------------------------------------------------------------------------------------------------------


def rule_classes(html: Column) -> Column:
    """An array for each rule of a page's style blocks: the different classes in its selector that may name a component."""
    styles = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<style\b[^>]*>(.*?)</style>"), F.lit(1)), lambda s: F.length(s) > 10)
    # a rule ends at the first closing brace, so what follows it up to the next opening one is the next selector
    rules = F.flatten(F.transform(styles, lambda s: F.split(F.substring(s, 1, STYLE_CHARS), r"\}")))
    selectors = F.transform(F.filter(rules, lambda r: r.contains("{")), lambda r: F.split_part(r, F.lit("{"), F.lit(1)))
    fits = lambda c: F.length(c).between(3, 60) & ~c.rlike(PLAIN_CLASSES)
    return F.transform(selectors, lambda s: F.filter(F.array_distinct(F.regexp_extract_all(s, F.lit(r"\.([A-Za-z][\w-]*)"), F.lit(1))), fits))


def component_classes(pages: DataFrame, node_rows: DataFrame | None = None) -> DataFrame:
    """page_id, place, class, rule_count, co_classes, and with node_rows n_used: the classes that most rules of a page name, with those that
    stand beside them most often and the number of elements that have them; ties by name.

    Companions are counted by (class, companion), sums that combine before they shuffle."""
    rules = pages.select("page_id", F.posexplode(rule_classes(F.col("html"))).alias("rule", "classes")).where(F.size("classes") > 0)
    each = rules.select("page_id", "classes", F.explode("classes").alias("class"))
    counts = each.groupBy("page_id", "class").agg(F.count("*").alias("rule_count")).where(F.col("rule_count") >= MIN_RULES)
    order = Window.partitionBy("page_id").orderBy(F.desc("rule_count"), "class")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP_CLASSES)
    beside = each.join(top.select("page_id", "class"), ["page_id", "class"]).select("page_id", "class", F.explode(F.array_except("classes", F.array("class"))).alias("other"))
    beside = beside.groupBy("page_id", "class", "other").agg((-F.count("*")).alias("k"))
    nearest = beside.withColumn("p", F.row_number().over(Window.partitionBy("page_id", "class").orderBy("k", "other"))).where(F.col("p") <= TOP_COMPANIONS).where(F.length("other") <= 40)
    nearest = nearest.groupBy("page_id", "class").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "other"))), lambda x: x["other"]).alias("co_classes"))
    out = top.join(nearest, ["page_id", "class"], "left").withColumn("co_classes", F.coalesce("co_classes", F.array().cast("array<string>")))
    if node_rows is not None:
        used = node_rows.select("page_id", F.explode(F.array_distinct("classes")).alias("class")).groupBy("page_id", "class").agg(F.count("*").alias("n_used"))
        out = out.join(used, ["page_id", "class"], "left").withColumn("n_used", F.coalesce("n_used", F.lit(0).cast("long")))
    return out


# --- folding --------------------------------------------------------------------------------------------------------------------


def _alike(node: dom.Node) -> tuple:
    """Siblings are alike by tag, classes, the names of data attributes and their own children's tags."""
    return node.tag, frozenset(node.classes), frozenset(k for k in node.attrs if k.lower().startswith("data-")), tuple(c.tag for c in node.children)


def _cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most] + "…"


def folded(source: str, keep: int = KEEP_SIBLINGS, text_cap: int = TEXT_CAP, value_cap: int = VALUE_CAP) -> str:
    """The body of a page for a prompt: of like siblings only the first `keep` with a comment that counts the rest, texts outside of links
    and values of data and aria attributes cut; tags, classes, ids, links and structure stay as they are."""
    root = dom.parse(source or "")
    body = next((n for n in root.walk() if n.tag == "body"), root)
    out: list[str] = []
    stack: list[tuple] = [(body, False)] if body is not root else [(p, False) for p in reversed(root.parts)]
    while stack:
        item, linked = stack.pop()
        if isinstance(item, tuple):  # markup that is ready
            out.append(item[0])
        elif isinstance(item, str):
            text = item if linked else _cut(item, text_cap)
            out.append(charrefs.escape(text, quote=False))
        else:
            long = lambda k, v: k.lower().startswith(("data-", "aria-")) and not v.isdigit()
            attrs = "".join(f' {k}="{charrefs.escape(_cut(v, value_cap) if long(k, v) else v)}"' for k, v in item.attrs.items())
            out.append(f"<{item.tag}{attrs}>")
            if item.tag in dom.VOID:
                continue
            groups = defaultdict(list)
            for child in item.children:
                groups[_alike(child)].append(child)
            gone = {id(c): len(g) - keep for g in groups.values() if len(g) > keep for c in g[keep:]}
            heads = {id(g[keep]): g[keep] for g in groups.values() if len(g) > keep}
            rest: list[tuple] = []
            for part in item.parts:
                if isinstance(part, str) or id(part) not in gone:
                    rest.append((part, linked or item.tag == "a"))
                elif id(part) in heads:
                    label = ".".join([part.tag, *sorted(set(part.classes))])
                    rest.append(((f"<!-- collapsed {gone[id(part)]} similar <{label}> -->",), linked))
            stack.append(((f"</{item.tag}>",), linked))
            stack += reversed(rest)
    text = re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+\n", "\n", "".join(out)))
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", text)).strip()


def folded_pages(pages: DataFrame) -> DataFrame:
    """page_id and the folded html of every page (page_id, html); a null folds to an empty text."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [folded(t.as_py() or "") for t in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "folded"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(fold, f"page_id {kind}, folded string")


# --- portfolios -----------------------------------------------------------------------------------------------------------------

#: Titles by which one person presents what they make, paths of one segment that are no project, and paths with dates.
TITLES = r"(?i)^\s*it'?s\s+.{2,60}!\s*$|^\s*i'?m\s+.{2,60}\s*$|^\s*.{2,60}'s\s+(site|website|homepage)\s*$"
NO_PROJECTS = ("about", "archive", "blog", "board", "contact", "faq", "forum", "home", "index", "latest", "news", "post", "posts", "rss", "tag", "tags")
DATED = r"(^\d{4}$|^\d{4}[-/]\d{1,2}|/\d{4}/|-\d{4,}$)"
LEAST_PROJECTS = 3


def presents(title: Column) -> Column:
    """Whether a title presents a person, or says the same on both sides of a bar."""
    t = F.trim(F.regexp_replace(title, r"\s+", " "))
    halves = F.transform(F.split(t, r"\|"), lambda x: F.lower(F.trim(x)))
    return F.coalesce(t.rlike(TITLES) | (F.size(halves) == 2) & (halves[0] != "") & (halves[0] == F.try_element_at(halves, F.lit(2))), F.lit(False))


def names_project(path: Column) -> Column:
    """Whether a path is one plain word."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    word = F.lower(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")))
    return (F.size(parts) == 1) & ~word.isin(*NO_PROJECTS) & word.rlike("^[a-z][a-z0-9-]{2,40}$") & ~path.rlike(DATED) & (F.length(word) - F.length(F.translate(word, "0123456789", "")) <= 1)


def portfolios(pages: DataFrame, node_rows: DataFrame) -> DataFrame:
    """page_id, title, blog_link, n_projects of the root pages (pages: page_id, url) of one person's portfolio: a title that presents, links
    to three different projects or more, and one to the site's own blog, of several the last."""
    bare = lambda h: F.regexp_replace(h, r"^www\.", "")
    roots = pages.where(urls.path(F.col("url")).isin("", "/") & urls.host(F.col("url")).isNotNull()).select("page_id", F.col("url").alias("base"), bare(urls.host(F.col("url"))).alias("own"))
    heads = node_rows.where(F.col("tag").isin("title", "h1")).groupBy("page_id", "tag").agg(F.min_by("text", "node").alias("text"))
    heads = heads.where(presents(F.col("text"))).groupBy("page_id").agg(F.max_by("text", "tag").alias("title"))  # a title comes before a heading
    href = F.trim(F.col("attrs")["href"])
    whole = F.when(href.rlike("^//"), F.concat(F.lit("https:"), href)).when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href).when(href.rlike(r"^[A-Za-z0-9.-]+\.[A-Za-z]{2,}(/|$)"), F.concat(F.lit("https://"), href)).otherwise(urls.absolute(href, F.col("base")))
    a = node_rows.where("tag = 'a'").where(href != "").join(roots, "page_id").select("page_id", "node", "own", whole.alias("full"))
    a = a.withColumns({"to": bare(urls.host(F.col("full"))), "path": urls.path(F.col("full"))})
    blog = (F.col("to") == F.concat(F.lit("blog."), "own")) | ((F.col("to") == F.col("own")) & F.col("path").rlike("^/blog(/|$)")) | (F.endswith("to", F.concat(F.lit("."), "own")) & F.col("to").startswith("blog."))
    project = F.when((F.col("to") == F.col("own")) & names_project(F.col("path")), F.lower(F.translate("path", "/", "")))
    sums = a.groupBy("page_id").agg(F.max_by("full", F.when(blog, F.col("node"))).alias("blog_link"), F.count_distinct(project).alias("n_projects"))
    found = sums.where(F.col("blog_link").isNotNull() & (F.col("n_projects") >= LEAST_PROJECTS)).join(heads, "page_id")
    return found.select("page_id", F.substring("title", 1, 120).alias("title"), "blog_link", "n_projects")


# --- lists by the tag tree ------------------------------------------------------------------------------------------------------

#: Bytes of a page and texts that are looked at, and places that are given.
TREE_BYTES, TREE_TEXTS, TREE_PLACES = 500_000, 20_000, 10


def tree_candidates(source: str, most: int = TREE_PLACES) -> list[tuple[str, int, int]]:
    """(path, children, children with a link) of the elements in which most kinds of texts meet: texts with the same path of tags are of
    one kind, and meet in the deepest element that holds all of them. Of equal ones the first."""
    root = dom.parse(source.encode("utf-8", "replace")[:TREE_BYTES].decode("utf-8", "ignore"))
    steps: dict[int, tuple[str, ...]] = {id(root): ()}
    at: dict[tuple[str, ...], dom.Node] = {}
    kinds: dict[tuple[str, ...], tuple[str, ...]] = {}
    texts = 0
    for node in root.walk():
        above = node.parent
        like = [c for c in above.children if c.tag == node.tag] if id(above) in steps else []
        place = next((k for k, c in enumerate(like, 1) if c is node), 1)
        path = (*steps[id(above)], f"{node.tag}[{place}]" if len(like) > 1 else node.tag)
        steps[id(node)] = path
        at[path] = node
        n = sum(isinstance(p, str) and bool(p.strip()) for p in node.parts)
        if n and texts < TREE_TEXTS:
            texts += n
            kind = tuple(s.split("[")[0] for s in path)
            known = kinds.get(kind, path)
            kinds[kind] = known[: next((k for k, (a, b) in enumerate(zip(known, path, strict=False)) if a != b), min(len(known), len(path)))]
    counts: dict[tuple[str, ...], int] = defaultdict(int)
    for meeting in kinds.values():
        if meeting:
            counts[meeting] += 1
    best = sorted(counts, key=lambda p: -counts[p])[:most]
    return [("/" + "/".join(p), len(at[p].children), sum(any(n.tag == "a" for n in c.walk()) for c in at[p].children)) for p in best]


def tree_lists(pages: DataFrame) -> DataFrame:
    """page_id, place, path, n_children, n_linked: elements that may be lists by the tree of their tags; a measure beside
    pages.repeating_patterns, which goes by classes."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(page_id, k, *x) for page_id, text in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True) for k, x in enumerate(tree_candidates(text or ""), 1)]
            kinds = (batch.schema.field("page_id").type, pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["page_id", "place", "path", "n_children", "n_linked"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(look, f"page_id {kind}, place int, path string, n_children long, n_linked long")
