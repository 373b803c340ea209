"""Rules and rankings of sites, where their queries' tables don't reach."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import jsonwalk, urls
from tidewatch.operators import classify, extract, pages, sites
from tidewatch.sources import tables
from tidewatch.streaming import posts as streams


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_message_chunks(spark):
    text = "\n".join("x" * k for k in range(1, 60))
    got = one(spark, sites.message_chunks(F.lit(text), F.lit(100)), sites.message_chunks(F.lit("y" * 250), F.lit(100)), sites.message_chunks(F.lit(None), F.lit(5)))
    assert all(len(c) <= 100 for c in got[0]) and "\n".join(got[0]) == text
    assert [len(c) for c in got[1]] == [100, 100, 50] and got[2] == []


def test_absolute(spark):
    base = F.lit("https://a.example.com/x/y?q=1")
    cases = {"http://b/": "http://b/", "//c.example.com/z": "https://c.example.com/z", "/r": "https://a.example.com/r", "s": "https://a.example.com/x/s", "?p=2": "https://a.example.com/x/y?p=2"}
    assert one(spark, *(urls.absolute(F.lit(h), base) for h in cases)) == tuple(cases.values())
    assert one(spark, *(urls.is_script(F.lit(h)) for h in ("#a", " javascript:x", "", None, "/a"))) == (True, True, True, True, False)


def test_href_pattern(spark):
    assert one(spark, *(urls.href_pattern(F.lit(h)) for h in ("/v/12", "/v/12/x3?no=45&p=a6", "/abc123"))) == ("/v/{n}", "/v/{n}/x3?no={n}&p=a6", "/abc123")


def test_common_prefix(spark):
    assert one(spark, *(pages.common_prefix(F.array(*map(F.lit, x))) for x in (("/v/1", "/v/22", "/vw"), ("a", "b"), ("same",)))) == ("/v", None, "same")


def test_patterns_of_placeholders_and_best_links(spark):
    rows = "".join(f'<li class="r"><a href="/tag/t{k}">t</a><a href="/article/{1000 + k}">x</a></li>' for k in range(4))
    skeleton = '<li class="s"><div class="p-skeleton"></div></li>' * 5
    nodes = pages.nodes(spark.createDataFrame([(1, f"<ul>{rows}</ul><ol>{skeleton}</ol>")], "page_id long, html string"))
    got = pages.repeating_patterns(nodes, spark.createDataFrame([(1, "http://a.example.com/l")], "page_id long, url string")).collect()
    assert [(r.selector, r.n, r.sample_href, r.href_prefix) for r in got] == [("ul > li.r", 4, "/article/1000", "/article/100")]


def test_page_size_counts_rows_that_stay(spark):
    spec = {"list_path": ["l"], "fields": {"post_id": {"from": "json", "path": ["id"]}, "title": {"from": "json", "path": ["t"]}}, "success_when": {"path": ["ok"], "equals": "1"}}
    body = '{"ok":"1","l":[{"t":"no id"},{"id":"","t":"x"},{"id":"a","t":"1"},{"id":"b","t":"2"},{"id":"c","t":"3"}]}'
    payloads = spark.createDataFrame([(1, body), (2, '{"ok":"0","l":[]}')], "page_id long, body string")
    assert sorted(r.post_id for r in extract.scan_json(payloads, spec, page_size=2).collect()) == ["a", "b"]
    assert [(r.page_id, r.found) for r in extract.failed_payloads(payloads, spec).collect()] == [(2, "0")]


def test_timeouts_of_the_last_attempt(spark):
    late, early = ('{"error": "x"} {"error": "validate_internal_timeout_30s"}', '{"error": "validate_internal_timeout_30s"} {"error": "other"}')
    got = one(spark, *(classify.failure(F.lit("failed"), F.lit(1), F.lit(t))[1] for t in (late, early, "validate_internal_timeout_9s")))
    assert got == ("validate_timeout", None, "validate_timeout")


def test_identity_of_rows():
    assert jsonwalk.looks_like_row({"title": "t", "url": 7}) and jsonwalk.looks_like_row({"title": "t", "id": 7})
    assert not jsonwalk.looks_like_row({"title": "t", "url": "two words"}) and not jsonwalk.looks_like_row({"title": "t", "id": True})


def test_traces(spark, tmp_path):
    traces = spark.createDataFrame([("t1", "poll", True, 1, 9), ("t2", "poll", False, 2, None)], "trace_id string, kind string, ok boolean, started long, ended long")
    spans = spark.createDataFrame([("t1", "s1", "fetch"), ("t1", "s2", "parse"), ("t2", "s3", "fetch")], "trace_id string, span_id string, name string")
    folder = str(tmp_path)
    tables.append_traces(traces, spans, folder)
    meta, own = tables.trace_parts(spark.read.json(f"{folder}/traces"), "t1")
    assert meta.count() == 1 and sorted(r.span_id for r in own.collect()) == ["s1", "s2"]
    index = {r.trace_id: (r.started, r.ended) for r in tables.trace_index(spark.read.json(f"{folder}/index")).collect()}
    assert index == {"t1": (1, 9), "t2": (2, None)}
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nbroken\n\n{"a": 2}\n')
    assert tuple(tables.line_counts(spark, f"{folder}/log.jsonl", "a int").first()) == (3, 1)


def test_files_and_days(spark, tmp_path):
    (tmp_path / "note.md").write_text("---\nk: v\n---\nbody")
    (tmp_path / "a.json").write_text('{"x": 1}')
    assert tuple(tables.front_matter(spark, str(tmp_path)).first()) == ("note", "k: v", "body")
    assert tuple(tables.config_files(spark, str(tmp_path)).first()) == ("a", '{"x": 1}')
    tables.publish(spark.range(3), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    assert one(spark, *(extract.decoded(F.lit(b), c) for b, c in (("가".encode("euc-kr"), "euc-kr"), (b"a\xffb", "utf-8")))) == ("가", "a\ufffdb")
    assert one(spark, streams.would_skip(F.lit("a"), F.lit("a")), streams.would_skip(F.lit(None), F.lit("a"))) == (True, False)
    assert one(spark, urls.long_numbers(F.lit("/a/1234/b56?x=98765"))) == (["1234", "98765"],)


def test_articles_join(spark):
    posts = spark.createDataFrame([("u1", None, "old"), ("u2", "have", "old"), ("u3", "x", "keep")], "url string, body string, title string")
    articles = spark.createDataFrame([("u1", "new", "new"), ("u2", "new", None)], "url string, body string, title string")
    got = {r.url: (r.body, r.title) for r in extract.with_articles(posts, articles, {"body": False, "title": True}).collect()}
    assert got == {"u1": ("new", "new"), "u2": ("have", "old"), "u3": ("x", "keep")}


def test_scratch(spark, tmp_path):
    from tidewatch.functions import scratch

    first, second = scratch.saved(spark.range(3), "a"), scratch.saved(spark.range(4), "b")
    scratch.clear_scratch(spark, keep=1)
    assert second.count() == 4 and len(scratch._made) == 1
    with pytest.raises(Exception, match="(?i)not.*exist"):
        spark.read.parquet(first.inputFiles()[0]).count()
    scratch.clear_scratch(spark)
    assert scratch._made == []


@pytest.mark.parametrize("most", [1, 2, 5, 40])
def test_error_tail_of_any_characters(spark, most):
    ends = ["", "a", "é", "한", "😀", "한😀é", "é"]
    texts = [None, *(head + "x" * n + end for head in ("", "é", "한글", "😀" * 9, "a😀b한cé" * 9) for n in (0, 1, 2, 3, 4, 5, 38, 39, 40, 41, 160) for end in ends)]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", sites.error_tail(F.col("t"), most).alias("tail")).collect()
    assert {r.k: r.tail for r in got} == {k: t and t[-most:] for k, t in enumerate(texts)}


def test_error_tail_does_not_walk(spark):
    """A tail of a long text is cut from its end, in far less time than it takes to walk through the text."""
    import time

    long = spark.range(0, 100, 1, 4).select(F.repeat(F.concat(F.lit("ab"), F.col("id").cast("string")), 1 << 20).alias("t"))

    def seconds(tail):
        began = time.perf_counter()
        long.select(F.sum(F.xxhash64(tail).bitwiseAND(1))).collect()
        return time.perf_counter() - began

    whole = [seconds(F.right("t", F.lit(4000))) for _ in range(2)]
    assert min(seconds(sites.error_tail(F.col("t"))) for _ in range(2)) < min(whole) / 2
