"""Column functions against literal cases."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import dates, jsonwalk, packing, transforms, urls


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "steps", "wanted"),
    [
        ("2018/12/02", [["date_only_to_iso", "+00:00"]], "2018-12-02T00:00:00+00:00"),
        ("  a   b\n", [["collapse_ws"]], "a b"),
        ("id=42&x", [["regex_extract", "id=([0-9]+)"]], "42"),
        ("none", [["regex_extract", "id=([0-9]+)"]], None),
        ("none", [["regex_extract", "id=([0-9]+)"], ["default", "d"]], None),  # a chain stops at a null
        ("", [["default", "d"]], "d"),
        ("a/b?c#d", [["strip_query_fragment"]], "a/b"),
        ("[ x ]", [["strip_brackets"]], "x"),
        ("[x", [["strip_brackets"]], "[x"),
        ("-5", [["zero_pad", 4]], "-005"),
        ("12345", [["zero_pad", 3]], "12345"),
        ("xxabxx", [["strip", "x"]], "ab"),
        ("a.b", [["replace", ".", "-"], ["append", "!"], ["prepend", "<"], ["upper"]], "<A-B!"),
        ("prefix-rest", [["remove_prefix", "prefix-"]], "rest"),
        ("&lt;a&gt; &#44032;", [["html_unescape"]], "<a> 가"),
        ("../c?d", [["urljoin", "http://h/a/b/"]], "http://h/a/c?d"),
        ("http://h2/x", [["urljoin", "http://h/a/"]], "http://h2/x"),
        ("02.12.2018 07:05", [["iso8601", ["%Y-%m-%d", "%d.%m.%Y %H:%M"], "+09:00"]], "2018-12-02T07:05:00+09:00"),
        ("soon", [["iso8601", ["%Y-%m-%d"]]], None),
        ("1543708800", [["unixtime_to_iso", "+09:00"]], "2018-12-02T09:00:00+09:00"),
        ("1543708800000", [["unixtime_to_iso", "+00:00", "ms"]], "2018-12-02T00:00:00+00:00"),
        ("x1", [["unixtime_to_iso"]], None),
    ],
)
def test_transforms(spark, value, steps, wanted):
    assert one(spark, transforms.chain(F.col("v"), steps), value) == wanted


def test_unknown_names_are_refused():
    with pytest.raises(ValueError, match="unknown transform"):
        transforms.chain(F.lit("x"), [["eval", "1"]])
    with pytest.raises(ValueError, match="unsupported directive"):
        transforms.java_pattern("%Y-%j")


@pytest.mark.parametrize(
    ("url", "wanted"),
    [
        ("HTTP://Example.COM//a///b/?b=2&a=1&utm_source=x&e=#f", "//example.com/a/b?a=1&b=2"),
        ("https://example.com", "//example.com/"),
        ("https://www.google.com/search?q=cats&ei=123&hl=ko", "//www.google.com/search?hl=ko&q=cats"),
    ],
)
def test_canonical(spark, url, wanted):
    assert one(spark, urls.canonical(F.col("v")), url) == wanted


def test_url_parts(spark):
    u = "https://www.board.co.kr/view/12ab/2024?no=5&list=1"
    assert one(spark, urls.registrable(F.col("v")), u) == "board.co.kr"
    assert one(spark, urls.path_template(F.col("v")), u) == "/view/<ID>/<N>"
    assert one(spark, urls.query_shape(F.col("v")), u) == "list&no"
    assert one(spark, urls.slug(F.col("v")), u).startswith("board-co-kr_view_")
    assert one(spark, urls.urls_in_text(F.col("v")), "see http://a/b, (http://c/d) http://a/b.") == ["http://a/b", "http://c/d"]
    assert one(spark, urls.article_score(F.col("v"), F.lit("https://m.board.co.kr/")), "https://board.co.kr/view/12345") == 4 + 1 + 2 + 1 + 1
    assert one(spark, urls.article_score(F.lit(None).cast("string"), F.lit("x"))) == -1
    assert one(spark, urls.page_link("http://h/l?x=1", F.lit(3), "p", "offset", 20)) == "http://h/l?x=1&p=40"


def test_dates(spark):
    assert one(spark, dates.normalised(F.col("v")), "Sun, 02 Dec 2018 07:05:00 GMT") == "2018-12-02T07:05:00+00:00"
    assert one(spark, dates.normalised(F.col("v")), " soon ") == "soon"
    assert one(spark, dates.is_iso(F.col("v")), "2018-12-02T07:05:00+09:00") is True
    assert str(one(spark, dates.korean_date(F.expr("timestamp '2024-01-01 15:00:00'")))) == "2024-01-02"


def test_packing(spark):
    lines = [("t", k, "x" * 40) for k in range(5)] + [("u", 0, "y" * 500)]
    got = packing.packed(spark.createDataFrame(lines, "k string, n int, line string"), "k", ["n"], F.lit("head"), most=100)
    chunks = {(r.k, r.chunk): r.text for r in got.collect()}
    assert chunks["t", 1] == "head\n" + "\n".join(["x" * 40] * 2) and len([c for c in chunks if c[0] == "t"]) == 3
    assert all(len(c) <= 100 for c in chunks.values()) and chunks["u", 2] == "y" * 100


def test_packing_keeps_every_line_whole(spark, monkeypatch):
    """Against going through the lines of each key one by one; runs and tasks end within keys, and nothing is cut."""
    monkeypatch.setattr(packing, "RUN_LINES", 7)
    sizes = [(k * 37) % 60 for k in range(400)]
    lines = [("a", k, chr(97 + k % 26) * n) for k, n in enumerate(sizes)] + [("b", 0, "y" * 250 + "z"), ("b", 1, "w"), ("c", 0, None), (None, 0, "n"), (None, 1, "")]
    lines += [(f"k{k}", j, f"{k}-{j}") for k in range(30) for j in range(3)]
    wanted = {}
    for key, _, line in lines:
        chunks = wanted.setdefault(key, ["head"])
        for part in [] if line is None else [line[k : k + 100] for k in range(0, len(line), 100)] or [""]:
            if len(chunks[-1]) + 1 + len(part) > 100:
                chunks.append(part)
            else:
                chunks[-1] += "\n" + part
    df = spark.createDataFrame(lines, "k string, n int, line string").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.k, r.chunk): r.text for r in packing.packed(df, "k", ["n"], F.lit("head"), most=100).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == {(key, k + 1): text for key, chunks in wanted.items() for k, text in enumerate(chunks)}


def test_json_lists(spark):
    typical = '{"data":{"items":[' + ",".join(f'{{"id":{i},"title":"t{i}","createdAt":"2024-01-01"}}' for i in range(6)) + "]}}"
    envelope = '{"items":[' + ",".join(f'{{"feed":{{"feedId":{i},"title":"t{i}"}},"user":{{}}}}' for i in range(6)) + "]}"
    rows = spark.createDataFrame([(1, typical), (2, envelope), (3, "not json"), (4, None), (5, '{"grid":[{"title":"x","paid":true}]}')], "page_id long, body string")
    got = {(r.page_id, r.path, r.n, r.item_subpath) for r in jsonwalk.find_lists(rows).collect()}
    assert got == {(1, "$.data.items", 6, None), (2, "$.items", 6, "feed")}
    body = '{"a":{"content":"' + "z" * 80 + '","n":1,"x":"' + "y" * 80 + '"}}'
    assert [tuple(r) for r in jsonwalk.long_bodies(spark.createDataFrame([(1, body)], "page_id long, body string")).collect()] == [(1, "$.a.content", 80)]
