"""HTML and XML as rows: a small tree builder and CSS selectors for use inside Arrow tasks.

Only what pages need: trees are lists of nodes in document order. Transforms, fallbacks, filters, grouping and ranking of what is
found stay Spark expressions (operators.extract, operators.pages).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key closes an open element of these tags.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A start tag that closes others closes none beyond the nearest of these.
WALLS = BLOCKS - {"p"}
ENDS = {tag: frozenset(CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())) for tag in BLOCKS | CLOSES.keys()}


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    index: int = 0
    children: list[Node] = field(default_factory=list)
    parts: list[Node | str] = field(default_factory=list)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def texts(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.parts))
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                yield part
            elif part.tag not in ("script", "style"):
                stack.extend(reversed(part.parts))

    def text(self, joiner: str = " ") -> str:
        return joiner.join(t for t in (x.strip() for x in self.texts()) if t)

    def outer(self) -> str:
        attrs = "".join(f' {k}="{v.replace(chr(34), "&quot;")}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{attrs}>"
        return f"<{self.tag}{attrs}>" + "".join(p if isinstance(p, str) else p.outer() for p in self.parts) + f"</{self.tag}>"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def _add(self, tag: str, attrs: list[tuple[str, str | None]]) -> Node:
        top = self.open[-1]
        node = Node(tag, {k: v or "" for k, v in attrs}, top, len(top.children))
        top.children.append(node)
        top.parts.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        if ends := ENDS.get(tag):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in ends:
                    del self.open[k:]
                    break
                if self.open[k].tag in WALLS:
                    break
        node = self._add(tag, attrs)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


# markup that leaves nothing to guess: whole comments, quoted values, scripts and styles up to their end, texts up to the next tag
_PLAIN = re.compile(
    r"""<(?P<tag>[A-Za-z][A-Za-z0-9]*)(?P<attrs>(?:[ \t\n]+[A-Za-z][\w:.-]*(?:="[^"<>&]*"|='[^'<>&]*')?)*)[ \t\n]*(?P<closed>/?)>"""
    r"""|</(?P<end>[A-Za-z][A-Za-z0-9]*)>|(?P<text>[^<]+)|<!--[^<>-]*(?:-[^<>-]+)*-->|<!(?i:doctype) [^<>\[\]"']*>""",
    re.ASCII,
)
_ATTRIBUTE = re.compile(r"""([A-Za-z][\w:.-]*)(?:="([^"]*)"|='([^']*)')?""", re.ASCII)
_RAW = {tag: re.compile(rf"(?is)((?:(?!<!--|</\s*{tag}).)*)</{tag}>", re.ASCII) for tag in ("script", "style")}
#: Elements whose content HTMLParser reads in ways of its own.
_SPECIAL = frozenset("iframe math noembed noframes noscript plaintext svg textarea xmp".split())


def _raw_parts(tag: str, text: str) -> list[str]:
    """The texts that HTMLParser makes of a script or style."""
    if "</" not in text:
        return [text] if text else []
    alone = _Builder()
    alone.feed(f"<{tag}>{text}</{tag}>")
    alone.close()
    return alone.root.children[0].parts


def _plain(text: str) -> _Builder | None:
    """The tree of markup that leaves nothing to guess, the one that HTMLParser's events would make. None where anything else stands."""
    builder, at, size = _Builder(), 0, len(text)
    match, attributes, start, end, data = _PLAIN.match, _ATTRIBUTE.findall, builder.handle_starttag, builder.handle_endtag, builder.handle_data
    while at < size:
        m = match(text, at)
        if m is None:
            return None
        at, kind = m.end(), m.lastgroup
        if kind == "closed":
            tag, attrs = m["tag"].lower(), m["attrs"]
            attrs = [(k.lower(), a or b) for k, a, b in attributes(attrs)] if attrs else ()
            if tag in _SPECIAL or tag == "title" and not text.startswith(("</title>", "</TITLE>"), text.find("<", at)):
                return None
            if m["closed"]:
                if tag in _RAW or tag == "title":
                    return None
                builder.handle_startendtag(tag, attrs)
                continue
            start(tag, attrs)
            if tag in _RAW:
                if (raw := _RAW[tag].match(text, at)) is None:
                    return None
                for part in _raw_parts(tag, raw[1]):
                    data(part)
                end(tag)
                at = raw.end()
        elif kind == "text":
            part = m["text"]
            data(unescape(part) if "&" in part else part)
        elif kind == "end":
            end(m["end"].lower())
    return builder


def parse(text: str) -> Node:
    """The root above the document. Broken markup never raises."""
    if (builder := _plain(text or "")) is None:
        builder = _Builder()
        builder.feed(text)
        builder.close()
    return builder.root


# --- selectors ------------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(
    r"""\s*(?P<comma>,)\s*|\s*(?P<comb>[>+~])\s*|(?P<space>\s+)|(?P<any>\*)|(?P<tag>(?:\\.|[\w-])+)|\#(?P<id>(?:\\.|[\w-])+)|\.(?P<cls>(?:\\.|[\w-])+)"""
    r"""|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]|:(?P<pseudo>[\w-]+)(?P<paren>\()?""",
)
SELF = ("", ":self", ":scope", "self", ".")


def compile_selector(selector: str) -> list[list[tuple[str, list]]]:
    """Alternatives of (combinator, tests), rightmost compound last. What isn't supported raises ValueError, as the plan is built."""
    alternatives: list[list[tuple[str, list]]] = [[(" ", [])]]
    at = 0
    selector = selector.strip()
    while at < len(selector):
        m = _TOKEN.match(selector, at)
        if not m or m.end() == at:
            raise ValueError(f"selector not supported: {selector!r}")
        at, tests = m.end(), alternatives[-1][-1][1]
        plain = lambda s: re.sub(r"\\(.)", r"\1", s)
        if m["comma"]:
            alternatives.append([(" ", [])])
        elif m["comb"] or m["space"]:
            if not tests:
                raise ValueError(f"selector not supported: {selector!r}")
            alternatives[-1].append((m["comb"] or " ", []))
        elif m["tag"]:
            tests.append(("tag", plain(m["tag"]).lower()))
        elif m["any"]:
            tests.append(("any", None))
        elif m["id"]:
            tests.append(("id", plain(m["id"])))
        elif m["cls"]:
            tests.append(("class", plain(m["cls"])))
        elif m["attr"]:
            tests.append(("attr", (m["attr"].lower(), m["op"], m["val"].strip("\"'") if m["val"] else None)))
        else:
            inner = None
            if m["paren"]:
                depth, end = 1, at
                while end < len(selector) and depth:
                    depth += {"(": 1, ")": -1}.get(selector[end], 0)
                    end += 1
                inner, at = selector[at : end - 1], end
            if m["pseudo"] in ("not", "has") and inner:
                tests.append((m["pseudo"], compile_selector(inner)))
            elif m["pseudo"] == "nth-child" and inner and (n := re.fullmatch(r"\s*(?:(odd|even)|(?:([+-]?\d*)n)?\s*([+-]?\s*\d+)?)\s*", inner)):
                a, b = (2, 1) if n[1] == "odd" else (2, 0) if n[1] == "even" else (int(n[2] + "1" if n[2] in ("", "+", "-") else n[2]) if n[2] is not None else 0, int((n[3] or "0").replace(" ", "")))
                tests.append(("nth", (a, b)))
            elif m["pseudo"] in ("first-child", "last-child"):
                tests.append((m["pseudo"], None))
            else:
                raise ValueError(f"selector not supported: {selector!r}")
    if any(not tests for chain in alternatives for _, tests in chain):
        raise ValueError(f"selector not supported: {selector!r}")
    return alternatives


_ATTR = {
    None: lambda v, x: True,
    "=": lambda v, x: v == x,
    "^=": lambda v, x: bool(x) and v.startswith(x),
    "$=": lambda v, x: bool(x) and v.endswith(x),
    "*=": lambda v, x: bool(x) and x in v,
    "~=": lambda v, x: x in v.split(),
    "|=": lambda v, x: v == x or v.startswith(x + "-"),
}


def _fits(node: Node, tests: list) -> bool:
    for kind, x in tests:
        match kind:
            case "tag":
                ok = node.tag == x
            case "id":
                ok = node.attrs.get("id") == x
            case "class":
                ok = x in node.classes
            case "attr":
                ok = x[0] in node.attrs and _ATTR[x[1]](node.attrs[x[0]], x[2])
            case "not":
                ok = not matches(node, x)
            case "has":
                ok = any(matches(n, x, node) for n in node.walk())
            case "first-child":
                ok = node.index == 0
            case "last-child":
                ok = node.parent is not None and node.index == len(node.parent.children) - 1
            case "nth":
                a, b = x
                k = node.index + 1 - b
                ok = k == 0 if a == 0 else k % a == 0 and k // a >= 0
            case _:
                ok = True
        if not ok:
            return False
    return True


def _chain(node: Node, chain: list, k: int, scope: Node | None) -> bool:
    if not _fits(node, chain[k][1]):
        return False
    if k == 0:
        return True
    comb = chain[k][0]
    if comb in (">", " "):
        up = node.parent
        while up is not None and up.tag:
            if _chain(up, chain, k - 1, scope):
                return True
            if comb == ">":
                return False
            up = up.parent
        return False
    before = node.parent.children[: node.index] if node.parent else []
    return any(_chain(n, chain, k - 1, scope) for n in (before[-1:] if comb == "+" else before))


def matches(node: Node, alternatives: list, scope: Node | None = None) -> bool:
    return any(_chain(node, chain, len(chain) - 1, scope) for chain in alternatives)


def select(root: Node, alternatives: list) -> Iterator[Node]:
    """Nodes below root in document order."""
    return (n for n in root.walk() if matches(n, alternatives))
