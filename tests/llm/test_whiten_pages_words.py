"""Whitening, main texts and spelling variants against plain versions, on odd rows: nulls, empty and very long values, ties, repeats, extra columns, no rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import spelling_variants, style_tree, whitening


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 11


def plain_whitening(vectors, k):
    """Deviations in whole numbers, and by numpy's own eigenvectors the whitened coordinates, each up to its sign."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return deviations, np.abs(centred @ axes[:, order] / np.sqrt(values[order])), values[order] / values.sum()


def table(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, component string, n int")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whiten(spark, kind):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(300, 12)) @ np.diag(np.arange(12, 0, -1))).astype(np.float32).astype(float).tolist()
    bad = [None, [], [float("nan")] * 12, [1.0, float("inf"), *[0.0] * 10], [None, *[0.0] * 11], [1.0] * 5]
    out = whitening.whiten(table(spark, good + bad, kind), 8).collect()
    deviations, wanted, explained = plain_whitening(good, 8)
    assert len(out) == 8 * 300
    for r in out:
        assert r.n == 300 and int(r.deviation) == deviations[r.vec_id]
        assert abs(abs(r.whitened) - wanted[r.vec_id][r.component - 1]) < 1e-8
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert out[0].identity_error < 1e-9
    signs = defaultdict(set)
    first = {r.component: r.whitened for r in out if r.vec_id == 0}
    for r in out:
        signs[r.component].add(round(np.sign(r.whitened * first[r.component])))
    assert all(len(s) > 1 for s in signs.values())  # coordinates vary; their signs agree as all rows are projected on one axis
    y = np.array([[r.whitened for r in sorted(out, key=lambda r: r.component) if r.vec_id == i] for i in range(300)])
    assert np.abs(np.cov(y.T, bias=True) - np.eye(8)).max() < 1e-9


def test_whiten_odd(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [[1.0, 2.0]])).count() == 0  # nothing varies
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 5)).count() == 0
    got = whitening.whiten(table(spark, [[0.0, 0.0], [2.0, 0.0], [2.0, 0.0]])).collect()  # one dimension without variance; repeated rows
    assert [r.component for r in got] == [1, 1, 1] and sorted(round(r.whitened**2, 9) for r in got) == [0.5, 0.5, 2.0]
    assert all(abs(r.explained - 1) < 1e-12 for r in got)
    null_id = table(spark, [[0.0], [3.0]]).withColumn("vec_id", F.when(F.col("vec_id") > 0, F.col("vec_id")))
    assert {r.vec_id for r in whitening.whiten(null_id).collect()} == {None, 1}
    few = whitening.whiten(table(spark, [[1.0, 5.0, 2.0], [4.0, 4.0, 1.0], [0.0, 9.0, 9.0], [7.0, 7.0]])).collect()
    assert {r.component for r in few} == {1, 2} and {r.vec_id for r in few} == {0, 1, 2}  # three points span two components


def test_deviations_beyond_64_bits(spark):
    big = [[1e12, -3e11], [5e12, 7e11], [-2e12, 1e10]]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(table(spark, big, "double"), 1).collect()}
    assert got == dict(enumerate(plain_whitening(big, 1)[0])) and max(got.values()) > 1 << 63
    beyond = [*big, [1e300, 0.0]]
    assert {r.vec_id for r in whitening.whiten(table(spark, beyond, "double"), 1).collect()} == {0, 1, 2}


# 12

MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/c'>Contact us</a></li></ul>"


def article(k, mark="article"):
    body = f"<h1>Title &amp; number {k}</h1>\n<p>First <b>para{k}graph\n of   {k}.<br>next&nbsp;line<p>Second {'x' * k} &eacute; &#8364;</p><ul><li>one {k}<li>two</ul><pre>a\n b</pre>"
    return f"<{mark}>{body}</{mark}>"


def wanted(k):
    return "\n\n".join([f"Title & number {k}", f"First para{k}graph of {k}. next line", f"Second {'x' * k} é €".replace('  ', ' '), f"one {k}", "two", "a b"])


def pages(spark, found):
    return spark.createDataFrame([(i, u, h, "e", 0) for i, (u, h) in enumerate(found)], "page_id long, url string, html string, text string, n_chars int")


def texts(spark, found):
    out = style_tree.extract(pages(spark, found))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == len(found) and all(r.n_chars == len(r.text) and r.url == found[i][0] for i, r in got.items())
    return [got[i].text for i in range(len(found))]


def test_marked_furniture(spark):
    shell = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><!-- <p>no</p> --><header><h1>Site</h1></header><nav>{menu}</nav>"
        "<div class='cookie-notice'>We use cookies {k}</div>{article}<aside>Side {k}</aside><div class=\"AdBanner2\">Buy {k}</div><form><p>Join {k}</p><button>Go</button></form>"
        "<section id=comments><article class='comment'><p>Reader {k} says {long}</p></article></section><footer>&copy; {k}</footer><noscript>no</noscript></body></html>"
    )
    found = [(f"http://one{k}.example.com/a", shell.format(k=k, menu=MENU, article=article(k), long="very much " * 99)) for k in range(3)]
    assert texts(spark, found) == [wanted(k) for k in range(3)]


@pytest.mark.parametrize("mark", ["article", "main", "div"])
def test_unmarked_furniture(spark, mark, monkeypatch):
    """What has no telling name goes as it is the same on every page; what differs stays."""
    page = "<body><div><b>The Daily Example</b> all the news</div><table><tr><td>Weather<td>12 degrees</table>{article}<div class=x1>Printed in Example City</div></body>"
    found = [("https://www.example.org/{k}", page.format(article=article(k, mark))) for k in range(8)]
    assert texts(spark, found) == [wanted(k) for k in range(8)]
    monkeypatch.setattr(style_tree, "BROADCAST_BYTES", 0)
    assert texts(spark, found) == [wanted(k) for k in range(8)]


def test_copies_are_kept(spark):
    """An article that stands on most pages of a host stays, and so do its repeated passages and headings."""
    found = [("http://copies.example.com/p", f"<body><nav>{MENU}</nav><div>{'<h2>Introduction</h2>' + article(3, 'section')}</div></body>")] * 30
    found += [("http://copies.example.com/q", f"<body><nav>{MENU}</nav><div>{'<h2>Introduction</h2>' + article(k, 'section')}</div></body>") for k in range(10)]
    assert texts(spark, found) == ["Introduction\n\n" + wanted(3)] * 30 + ["Introduction\n\n" + wanted(k) for k in range(10)]


def test_odd_pages(spark):
    long = "<p>" + "word &amp; " * 200_000
    found = [(None, None), ("x", ""), (None, "plain text"), ("http://a.example/1", "<" * 1000), ("http://a.example/2", "<div>" * 20_000 + "deep" + "</b>" * 20_000), ("http://a.example/3", "<p>cut <a href='x"), ("http://a.example/4", long), ("http://a.example/5", "<script>never closed <p>x")]
    got = texts(spark, found)
    assert got[:3] == ["", "", "plain text"] and got[4:6] == ["deep", "cut"] and got[7] == ""
    assert len(got[6]) == len("word & ") * 200_000 - 1
    assert style_tree.extract(pages(spark, []).limit(0)).count() == 0


def test_forms_links_and_heads(spark):
    wrap = f"<body><form id=aspnet><div>{article(1)}</div></form></body>"
    links = f"<body><div>{MENU}</div><div><p>Long text with <a href=x>a link</a> in it stays.</p></div></body>"
    outside = "<body><main><h1>Head</h1><article><p>Body</p></article></main></body>"
    header = "<article><header><h1>Own</h1></header><p>text</p><footer>tags</footer></article>"
    two = "<article><p>short</p></article><article><p>the longer one</p></article>"
    assert texts(spark, [("", wrap), ("", links), ("", outside), ("", header), ("", two)]) == [wanted(1), "Long text with a link in it stays.", "Head\n\nBody", "Own\n\ntext", "the longer one"]


def test_entropies(spark):
    """Sums over tasks give the entropies of all occurrences."""
    rng = random.Random(5)
    found = [(f"http://h{rng.randrange(2)}.example/x", f"<div><section>{rng.choice('abc')}</section><section><p>{rng.choice('xy')}</p>{'<p>z</p>' * rng.randrange(3)}</section></div>") for _ in range(60)]
    counts = defaultdict(Counter)
    for url, source in found:
        for path, kind, value in style_tree.Page(source).nodes():
            counts[url.split("/")[2], path, kind][value] += 1
    got = {(r.host, r.path): r for r in style_tree.merged_trees(pages(spark, found).repartition(7)).collect()}
    assert len(got) == len({(h, p) for h, p, _ in counts})
    for (host, path, kind), values in counts.items():
        n = sum(values.values())
        h = -sum(v / n * math.log(v / n, n) for v in values.values()) if n > 1 else None
        r = got[host, path - (1 << 64) if path >> 63 else path]
        assert math.isclose(r.presentation if kind else r.content, h, abs_tol=1e-9) and (kind or r.pages == n)


def test_extract_on_the_table(spark, sf):
    """The whole table against a reading by another rule: its pages mark their article."""
    import html

    out = style_tree.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(out) == len(sources)
    for r in out:
        inner = re.search("<article>(.*?)</article>", sources[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>|<br>", "", x.replace("<br>", " "))).split()) for x in re.split("</?p>|</?h1>", inner))
        assert r.text == "\n\n".join(x for x in blocks if x)


# 13


def near(a, b):
    """Whether one inserted, deleted or replaced code point leads from a to b, by trying."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(docs, typos=True):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if typos and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    form, size = {}, {}
    for w in words:
        around = [v for v in words if v != w and abs(len(v) - len(w)) < 2 and near(v, w)]
        size[w] = len(around)
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, size[w], words[form[w]] if form[w] else None) for w, n in words.items()), key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def documents(spark, found):
    return spark.createDataFrame([(d, t, "x", 1, "w") for d, t in found], "doc_id long, text string, key string, n int, word string")


@pytest.mark.parametrize("typos", [True, False])
def test_variants(spark, odd, odd_rows, empty, typos):
    rule = spelling_variants.every_31st if typos else None
    assert rows(spelling_variants.group(odd, typos=rule), *COLUMNS) == plain_variants(odd_rows, typos)
    assert spelling_variants.group(empty, typos=rule).count() == 0


def test_variants_of_few_letters(spark):
    """Runs of one letter, ties, accents and many neighbours: words over three letters."""
    rng = random.Random(11)
    words = ["".join(rng.choice("aé") for _ in range(rng.choice((6, 7, 7, 8)))) for _ in range(120)]
    found = [(k, " ".join(rng.choices(words, weights=[3 ** (i % 6) for i in range(120)], k=400)) + "×÷ Ünïcödé" * 2) for k in range(20)]
    got = rows(spelling_variants.group(documents(spark, found)), *COLUMNS)
    assert got == plain_variants(found, False) and any(r[1] for r in got) and max(r[4] for r in got) > 3


def test_chains_of_forms(spark):
    """Roots several forms away, and a word in front of two equally common ones."""
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(2 * 10**k))
    found = [(1, text), (2, "zzzzzzz zzzzzzz " + "zzzzzzy " * 20 + "zzzzzzx " * 20)]
    got = {r[0]: r for r in rows(spelling_variants.group(documents(spark, found)), *COLUMNS)}
    assert {got[w][2] for w in chain} == {"aaaabbbb"} and got["aaaaaaaa"][1] == "aaaaaaab" and got["zzzzzzz"][1] == "zzzzzzx"
    assert sorted(got.values(), key=repr) == plain_variants(found, False)


def test_counts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "FLUSH_WORDS", 3)
    found = [(k % 5, "alphabet betamax gammaray deltaform " * 3 + "epsilon" * (k % 3)) for k in range(40)]
    assert rows(spelling_variants.group(documents(spark, found), typos=spelling_variants.every_31st), *COLUMNS) == plain_variants(found)
