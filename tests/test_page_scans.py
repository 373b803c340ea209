"""Pages are read the short way where their markup leaves nothing to guess, and groups leave the scan of a page whole."""

import random

from pyspark.sql import functions as F

from tidewatch.functions import dom
from tidewatch.operators import pages

PARTS = """<p>|</p>|<li>|<ul>|</ul>|<a href="x">|<a href=x>|<a b='1' C>|</a>|<br>|<br/>|<td>|<tr>|<table>|</table>|text|a & b|&amp;|&copy|<|>|<script>|</script>|<style>|</style>|if (a<b) {}
|"</p>"|<!-- c -->|<!--|-->|<!-- a -- b -->|<title>|</title>|<textarea>|</textarea>|<DIV CLASS="Q w">|</DIV>|<!DOCTYPE html>|<?x?>|<a href="?a=1&b=2">|<img src="i" />|</ p>|</p >|<noscript>|<script/>|<p a = "1">|<p a="1"b="2">|<p é="1">""".split("|")


def tree(node):
    return node.tag, tuple(node.attrs.items()), node.index, tuple(p if isinstance(p, str) else tree(p) for p in node.parts)


def test_trees_are_those_of_the_parser():
    drawn, short = random.Random(5), 0
    for _ in range(20_000):
        text = "".join(drawn.choice(PARTS) for _ in range(drawn.randrange(1, 8)))
        builder = dom._Builder()
        builder.feed(text)
        builder.close()
        short += dom._plain(text) is not None
        assert tree(dom.parse(text)) == tree(builder.root), text
    assert short > 2000


ROWS = '<li class="r" data-id="7"><b><a href="/tag/x" data-k="1">t</a></b> <a href="/board/view/100{k}">post  {k}</a></li>'
ODD = [
    "<ul>" + "".join(ROWS.format(k=k) for k in range(5)) + '<li class="s"><a href="javascript:go(2)">n</a></li>' * 4 + "</ul>",
    "<div id='d'>" + '<p class="loading">x</p><p>a</p><p>b</p><p>c</p>' + "</div><nav>" + '<a href="https://one.example.org/x">o</a>' * 40 + "</nav>",
    "<table>" + "<tr><td><a href='/v?id=1'>q</a><td>2<td>3" * 4 + "</table>",
    "", None,
]


def frame(spark):
    return spark.createDataFrame([(k, f"http://h{k}.example.com/b/", t) for k, t in enumerate(ODD)], "page_id long, url string, html string")


def test_groups_of_the_scan_are_those_of_the_nodes(spark):
    made = frame(spark)
    for known in (True, False):
        a = pages.page_patterns(made if known else made.drop("url"))
        b = pages.repeating_patterns(pages.nodes(made), made if known else None).select(*a.columns)
        got, wanted = (sorted(map(str, x.withColumn("calls", F.array_sort("calls")).collect())) for x in (a, b))
        assert got == wanted and len(got) >= 5


def test_patterns_shuffle_groups_alone(spark):
    """One row a group leaves the scan, however many rows and links a page has."""
    groups = pages.sibling_groups(frame(spark))
    assert groups.where("page_id = 1 and up_tag = 'nav'").select("n", F.size("choices")).collect() == [(40, 1)]


def test_some_nodes(spark):
    every, some = pages.nodes(frame(spark)), pages.nodes(frame(spark), *pages.HINT_COLUMNS, wanted=pages.hinting)
    columns = ["page_id", "node", "tag", "attrs", "nth_link", "own_url"]
    assert some.columns == columns
    assert sorted(map(str, some.collect())) == sorted(map(str, every.where("tag in ('a', 'link')").select(*columns).collect()))
