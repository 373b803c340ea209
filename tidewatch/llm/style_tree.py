"""Main text of pages by site style trees.

The DOMs of one host are merged: an element stands for all elements with the same path of labels (tag, id and classes, without digits; for branches without id and
class the place among their like) from the root. Each merged element has two kinds of nodes beneath it: presentation nodes (the sequences of its children's labels) and content nodes (its
texts). Over all pages of the host, the entropy of each kind, by the logarithm of the number of occurrences, tells how much it varies:
a menu or notice that is the same on every page has none. The importance of an element is `PRESENTATION` times the entropy of
presentation plus the rest times that of content, as a share of what the host's pages themselves have, so a host full of copies loses
nothing. Branches below `LEAST` go. What entropy can't tell (adverts and reader comments that differ on each page, hosts with a
single page) is told by the markup: elements whose tag, role or class names page furniture have no importance, nor have lists of links
outside an article. A branch is never dropped for its entropy if it holds a heading of the first level, an article, or half of what is left of the page.

The text is what is left of the largest `article` element, with a heading of the first level that stands before it; else of `main`;
else of the page. Blocks are runs of text between block-level tags; references are decoded, white space within a block is one space.

Work: two passes parse the pages in Arrow batches. The first sends counts of (host, path, kind, value), combined in each task; sums of
n and n*ln(n) give the entropies, so that hot hosts meet as partial sums. The second gets each host's unimportant paths, by a broadcast
while they are `BROADCAST_BYTES` at most and else by a salted join.

Defined cases: null or empty html gives an empty text; a null or relative url has no host and no tree, and its page is told by markup
alone; broken, truncated and deeply nested markup is read as far as it goes; null ids and repeated rows are kept as they are; an empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Batches, salted_join, saved, tidy

PRESENTATION = 0.1
LEAST = 0.3
BROADCAST_BYTES = 4 << 20
FLUSH_ROWS = 200_000

#: Elements that break the text, as HTML has them.
BLOCKS = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never part of a page's text up to their end tag, read raw by HTML.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements that name page furniture by themselves.
FURNITURE_TAGS = frozenset("nav header footer aside form dialog menu noscript template svg math button select datalist option optgroup object canvas audio video".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status tablist".split())
#: Words in a class or id that name page furniture.
FURNITURE_WORDS = frozenset(
    """nav navigation navbar navbars menu menus menubar breadcrumb breadcrumbs header masthead topbar footer colophon sidebar sidebars aside widget widgets rail
    ad ads adv advert adverts advertisement advertising adsbygoogle adslot banner banners sponsor sponsored promo promos promotion
    cookie cookies consent gdpr notice notices notification notifications alert disclaimer newsletter subscribe subscription signup signin login register search searchbox form
    share sharing social follow comment comments commentlist disqus reply replies respond responses discussion related recommended recommendations
    popup modal overlay toolbar pagination pager paging skip copyright""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond responses discussion teaser related recommended".split())
#: Words that say that a header belongs to the article.
OWN_WORDS = frozenset("article entry post story content".split())
#: Elements that are judged as branches; others are content of theirs, unless they have a class of their own.
BRANCHES = frozenset("div section ul ol dl table center fieldset details figure address article main blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table article section main div".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/><]*+)((?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>)""", re.S)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_END = {tag: re.compile(f"</{tag}(?![a-zA-Z])[^>]*>", re.I) for tag in RAW}
_CUT = re.compile(r"</?[a-zA-Z!][^<>]*\Z")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
ROOT = 1


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


@lru_cache(maxsize=20_000)
def _kind(tag: str, attributes: str) -> tuple:
    """What it counts as, its label and the label's hash; whether it names furniture, whether that of readers or other articles, whether
    it has a class or id."""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _NAMED.finditer(attributes)} if "=" in attributes else {}
    classes, role = sorted(re.sub(r"\d+", "", c) for c in found.get("class", "").split()), found.get("role", "").lower()
    words = {w.lower() for w in _WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    kind = "article" if role == "article" or found.get("itemprop") == "articleBody" else "main" if role == "main" else tag
    comment = bool(words & COMMENT_WORDS) and kind != "main"
    furniture = comment or kind not in ("article", "main") and (tag in FURNITURE_TAGS or bool(set(role.split()) & FURNITURE_ROLES) or bool(words & FURNITURE_WORDS))
    if tag == "header" and words & OWN_WORDS and not comment:
        furniture = False
    label = f"{tag}#{re.sub('[0-9]+', '', found.get('id', ''))}.{'.'.join(classes)}"
    return kind, label, zlib.crc32(label.encode("utf-8", "surrogatepass")), furniture, comment, bool(classes or found.get("id"))


class Page:
    """A page's elements that break text or name furniture, in page order (parents before children), and its blocks of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.label, self.path, self.dropped, self.comment, self.named = [""], [0], [""], [ROOT], [False], [False], [False]
        self.blocks: list[tuple[int, str, int, int]] = []  # element, text, characters in links, links
        self._raw_tag = [""]
        self._stack, self._run, self._links, self._in_link, self._n_links = [0], [], 0, False, 0
        self._open: Counter = Counter()  # tags on the stack
        self._nth: Counter = Counter()
        self._read(source)
        self._judge_markup()

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = _TAG.search(source, at)
            text = source[at : m.start()] if m else _CUT.sub("", source[at:])
            if text:
                self._text(text)
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
            elif tag in RAW:
                shut = _END[tag].search(source, at)
                at = shut.end() if shut else end
            elif tag == "plaintext":
                self._text(source[at:])
                break
            else:
                self._start(tag, m[3])
        self._flush()

    def _text(self, text: str) -> None:
        text = html.unescape(text) if "&" in text else text
        self._run.append(text)
        if self._in_link:
            self._links += len(text)

    def _flush(self) -> None:
        text = " ".join("".join(self._run).split()) if self._run else ""
        if text:
            self.blocks.append((self._stack[-1], text, min(self._links, len(text)), self._n_links))
        self._run, self._links, self._n_links = [], 0, 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag == "hr":
            self._run.append(" ")
        elif tag == "a":
            self._in_link, self._n_links = True, self._n_links + 1
        if tag in VOID and tag != "hr" or tag in ("html", "body", "head"):
            return
        kind, label, code, furniture, comment, named = _kind(tag, attributes)
        if tag not in BLOCKS and not furniture:
            return
        self._flush()
        if tag in BLOCKS:
            ends = CLOSES.get(tag, frozenset()) | {"p"}
            cut = None
            for k in range(len(self._stack) - 1, 0, -1):
                open_tag = self._raw_tag[self._stack[k]]
                if open_tag in ends:
                    cut = k
                elif open_tag in SCOPES or open_tag == "td" and tag not in ("td", "th", "tr", "tbody", "tfoot"):
                    break
            if cut is not None:
                self._leave(cut)
        if tag == "hr":
            return
        top = self._stack[-1]
        self.tag.append(kind)
        self._raw_tag.append(tag)
        self.parent.append(top)
        self.label.append(label)
        if not named and kind in BRANCHES:  # what has no name is told apart by its place among its like
            self._nth[top, code] += 1
            code += self._nth[top, code] << 32
        self.path.append((self.path[top] * _STEP + code) & _MASK)
        self.dropped.append(furniture)
        self.comment.append(comment)
        self.named.append(named)
        self._stack.append(len(self.tag) - 1)
        self._open[tag] += 1

    def _leave(self, k: int) -> None:
        for element in self._stack[k:]:
            self._open[self._raw_tag[element]] -= 1
        del self._stack[k:]

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._in_link = False
        if self._open[tag] or tag in BLOCKS:
            self._flush()
        elif tag == "br":
            self._run.append(" ")
        if self._open[tag]:
            self._leave(next(k for k in range(len(self._stack) - 1, 0, -1) if self._raw_tag[self._stack[k]] == tag))

    def _sums(self, values: list[tuple[int, int]]) -> list[int]:
        """Sums over whole subtrees of (element, amount)."""
        total = [0] * len(self.tag)
        for k, v in values:
            total[k] += v
        for k in range(len(total) - 1, 0, -1):
            total[self.parent[k]] += total[k]
        return total

    def _judge_markup(self) -> None:
        """Furniture by markup: what holds an article or half of the page stays, as does a form or header of the article; lists of links outside of an article go."""
        size = self._sums([(k, len(t)) for k, t, _, _ in self.blocks])
        articles = self._sums([(k, 1) for k in range(1, len(self.tag)) if self.tag[k] in ("article", "main") and not self.comment[k]])
        titles = self._sums([(k, 1) for k in range(1, len(self.tag)) if self.tag[k] == "h1"])
        inside = [False] * len(self.tag)  # of an article
        for k in range(1, len(self.tag)):
            inside[k] = inside[self.parent[k]] or self.tag[k] in ("article", "main") and not self.comment[k]
            if self.dropped[k] and not self.comment[k]:
                wraps = articles[k] > 0 or self.tag[k] == "form" and titles[k] > 0
                heads = self.tag[k] == "header" and inside[k] and titles[k] > 0
                most = 2 * size[k] > size[0] and self.tag[k] not in ("nav", "footer", "aside", "noscript", "template", "svg") and not articles[0]
                self.dropped[k] = not (wraps or heads or most)
        linked, links = self._sums([(k, c) for k, _, c, _ in self.blocks]), self._sums([(k, n) for k, _, _, n in self.blocks])
        for k in range(1, len(self.tag)):
            if not inside[k] and self.tag[k] in BRANCHES and not articles[k] and not titles[k] and links[k] >= 3 and 10 * linked[k] >= 8 * size[k] and size[k] < 60 * links[k]:
                self.dropped[k] = True
        for k in range(1, len(self.tag)):
            self.dropped[k] = self.dropped[k] or self.dropped[self.parent[k]]

    def left(self) -> list[tuple[int, str, int, int]]:
        return [b for b in self.blocks if not self.dropped[b[0]]]

    def nodes(self) -> list[tuple[int, int, int]]:
        """(path, kind, value) of presentation (1) and content (0) nodes of what the markup leaves; of the root only the content."""
        content, shape, filled = [0] * len(self.tag), [0] * len(self.tag), [False] * len(self.tag)
        for k, text, _, _ in self.left():
            content[k], filled[k] = (content[k] * _STEP + _hash(text)) & _MASK, True
        for k in range(len(self.tag) - 1, 0, -1):
            if filled[k] and not self.dropped[k]:
                p = self.parent[k]
                filled[p] = True
                content[p] = (content[p] * _STEP + content[k] + 1) & _MASK
                shape[p] = (shape[p] * _STEP + zlib.crc32(self.label[k].encode("utf-8", "surrogatepass")) + 1) & _MASK
        out = [(ROOT, 0, content[0])] if filled[0] else []
        for k in range(1, len(self.tag)):
            if filled[k] and not self.dropped[k] and (self.tag[k] in BRANCHES or self.named[k]):
                out.append((self.path[k], 0, content[k]))
                if shape[k]:
                    out.append((self.path[k], 1, shape[k]))
        return out

    def text(self, unimportant: set[int]) -> str:
        """The main text, without the branches whose paths are unimportant."""
        if unimportant:
            size = self._sums([(k, len(t)) for k, t, _, _ in self.left()])
            heads = self._sums([(k, 1) for k in range(1, len(self.tag)) if not self.dropped[k] and self.tag[k] in ("h1", "article", "main")])
            for k in range(1, len(self.tag)):
                own = self.tag[k] in BRANCHES or self.named[k]
                self.dropped[k] = self.dropped[k] or self.dropped[self.parent[k]] or own and self.path[k] in unimportant and not heads[k] and 2 * size[k] <= size[0]
        blocks = self.left()
        for wanted in ("article", "main"):
            top = [0] * len(self.tag)  # the outermost such element above
            for k in range(1, len(self.tag)):
                top[k] = top[self.parent[k]] or (k if self.tag[k] == wanted and not self.dropped[k] else 0)
            sizes: Counter = Counter()
            for k, text, _, _ in blocks:
                if top[k]:
                    sizes[top[k]] += len(text)
            if sizes:
                best = max(sizes, key=lambda k: (sizes[k], -k))
                chosen = [b for b in blocks if top[b[0]] == best]
                if not any(self.tag[b[0]] == "h1" for b in chosen):
                    chosen = [b for b in blocks if self.tag[b[0]] == "h1" and b[0] < best and not top[b[0]]] + chosen
                blocks = chosen
                break
        return "\n\n".join(b[1] for b in blocks)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _named(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    flat = pages.select(*(F.col(f"`{c}`").alias(c) for c in ("page_id", "url", "html")))
    return flat.withColumn("host", F.when(host != "", host))


def merged_trees(pages: DataFrame) -> DataFrame:
    """host, path, and for both kinds of nodes the number of occurrences and their entropy (0 to 1), over all pages of the host."""

    def send(total: Counter) -> pa.RecordBatch:
        keys = list(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), _signed([k[1] for k in keys]), pa.array([k[2] for k in keys], pa.int8()), _signed([k[3] for k in keys]), pa.array([total[k] for k in keys], pa.int64())],
            names=["host", "path", "kind", "value", "n"],
        )

    def count(batches: Batches) -> Batches:
        total: Counter = Counter()
        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total.update((host, *node) for node in Page(source.as_py()).nodes())
                if len(total) > FLUSH_ROWS:
                    yield send(total)
                    total.clear()
        yield send(total)

    counted = _named(pages).where("host is not null and html is not null").select("host", "html").mapInArrow(tidy(count), "host string, path long, kind byte, value long, n long")
    values = counted.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    sums = values.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.ln("n")).alias("nln"))
    entropy = F.when(F.col("m") > 1, (F.ln("m") - F.col("nln") / F.col("m")) / F.ln("m"))
    kinds = {name: F.max(F.when(F.col("kind") == kind, column)).alias(name) for name, kind, column in (("pages", 0, F.col("m")), ("content", 0, entropy), ("presentation", 1, entropy))}
    return sums.groupBy("host", "path").agg(*kinds.values())


def unimportant_paths(trees: DataFrame) -> DataFrame:
    """host and paths: the branches whose importance, as a share of that of the host's pages, is below LEAST."""
    whole = trees.where(F.col("path") == ROOT).select("host", F.col("content").alias("whole"))
    importance = F.lit(PRESENTATION) * F.coalesce("presentation", "content") + F.lit(1 - PRESENTATION) * F.col("content")
    low = trees.where(F.col("path") != ROOT).join(whole, "host").where((F.col("whole") > 0) & (importance < F.lit(LEAST) * F.col("whole")))
    return low.groupBy("host").agg(F.collect_list("path").alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    low = saved(unimportant_paths(merged_trees(pages)), "style-trees")
    named = _named(pages)
    if (low.agg(F.sum(8 * F.size("paths").cast("long") + F.octet_length("host") + 32)).first()[0] or 0) <= BROADCAST_BYTES:
        joined = named.join(F.broadcast(low), "host", "left")
    else:  # a host may hold a third of all pages: they are dealt out by their urls
        joined = salted_join(named, low, ["host"], ["url", "page_id"], "left")
    kinds = {f.name: f.dataType for f in named.schema}

    def read(batches: Batches) -> Batches:
        for batch in batches:
            paths = [set(np.array(x, np.int64).view(np.uint64).tolist()) if x else set() for x in batch.column(3).to_pylist()]
            texts = [Page(source.as_py() or "").text(low_paths) for source, low_paths in zip(batch.column(2), paths, strict=True)]
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), n], names=["page_id", "url", "text", "n_chars"])

    schema = f"page_id {kinds['page_id'].simpleString()}, url string, text string, n_chars long"
    return joined.select("page_id", "url", "html", "paths").mapInArrow(tidy(read), schema)
