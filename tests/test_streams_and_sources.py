"""Streams to the end of tiny inputs, and files as frames."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import joins, llm_hooks, windows
from tidewatch.sources import registry, tables
from tidewatch.streaming import posts as streams

POSTS = "slug string, post_id string, baseline boolean"


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_new_posts(spark, tmp_path):
    def write(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    def poll():
        frame = streams.new_posts(spark.readStream.schema(POSTS).json(str(tmp_path / "in")), cap=3)
        run(frame.writeStream.foreachBatch(lambda b, _: out.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start())

    out: list = []
    write("a.json", [{"slug": "s", "post_id": "1", "baseline": True}, {"slug": "s", "post_id": "2", "baseline": True}, {"slug": "s", "post_id": " "}])
    poll()
    assert out == []
    write("b.json", [{"slug": "s", "post_id": "2"}, {"slug": "s", "post_id": "3"}, {"slug": "t", "post_id": "1"}])
    poll()
    assert sorted(out) == [("s", "3"), ("t", "1")]
    out.clear()
    write("c.json", [{"slug": "s", "post_id": str(k)} for k in (3, 4, 5)])
    poll()
    assert sorted(out) == [("s", "4"), ("s", "5")]
    out.clear()
    write("d.json", [{"slug": "s", "post_id": "1"}])  # the oldest has gone from the list of three
    poll()
    assert out == [("s", "1")]


def test_breakage(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("s", k, b) for k, b in enumerate([1, 1, 1, 0, 1, 0])] + [("t", 0, 0)]
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"slug": s, "ts": k, "broken": bool(b)}) + "\n" for s, k, b in rows))
    out: list = []
    frame = streams.breakage(spark.readStream.schema("slug string, ts long, broken boolean").json(str(tmp_path / "in")))
    run(frame.writeStream.foreachBatch(lambda b, _: out.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start())
    assert sorted(out) == [("s", 0, "clear"), ("s", 2, "reprobe"), ("s", 3, "broken")]


def test_append_verified(spark, tmp_path):
    store = str(tmp_path / "store")
    write = streams.append_verified(store, ["slug", "post_id"])
    first = spark.createDataFrame([("s", "1"), ("s", "1"), ("s", "2")], "slug string, post_id string")
    write(first, 0)
    write(first, 0)  # a repeated batch replaces itself
    write(spark.createDataFrame([("s", "2"), ("s", "3")], "slug string, post_id string"), 1)
    assert sorted(r.post_id for r in spark.read.parquet(store).collect()) == ["1", "2", "3"]


def test_files(spark, tmp_path):
    (tmp_path / "a_b.json").write_text('{"n": 1}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "a_b.BUG.json").write_text('{"why": "x"}')
    assert [tuple(r) for r in tables.state_files(spark, str(tmp_path), "n int").where("n is not null").collect()] == [("a_b", 1)]
    assert [(r.slug, r.kind) for r in tables.marker_files(spark, str(tmp_path)).collect()] == [("a_b", "BUG")]
    lines = tmp_path / "log.jsonl"
    lines.write_text('{"ts": 1, "x": "a"}\nnot json\n{"ts": 2, "x": "b"}\n{"ts": 3, "x": "c"}\n')
    assert [r.x for r in tables.newest_lines(tables.json_lines(spark, str(lines), "ts long, x string"), "ts", 2).collect()] == ["b", "c"]
    har = tmp_path / "x.har"
    har.write_text(json.dumps({"log": {"entries": [{"request": {"method": "GET", "url": "http://a/"}, "response": {"status": 200, "content": {"text": "aGk=", "encoding": "base64", "mimeType": "text/html; charset=x"}}}]}}))
    assert tuple(tables.har_entries(spark, str(har)).first()) == (0, "GET", "http://a/", 200, "text/html", "hi")
    tables.export_csv(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().s == "a"
    shutil.rmtree(tmp_path / "csv")


def test_robots_and_sitemaps(spark):
    text = "User-agent: *\nCrawl-delay: 2.5\nDisallow: /a # x\nDisallow:\nSitemap: http://h/s.xml\n"
    r = tables.robots(spark.createDataFrame([("h", text)], "host string, text string")).first()
    assert (r.crawl_delay, r.disallow, r.sitemaps) == (2.5, ["/a"], ["http://h/s.xml"])
    files = [("r", "<sitemapindex><sitemap><loc>c</loc></sitemap><sitemap><loc>gone</loc></sitemap></sitemapindex>"), ("c", "<urlset><url><loc>http://h/1</loc><lastmod>2024-01-01</lastmod></url><url><loc> http://h/2 </loc></url></urlset>")]
    got = tables.sitemap_urls(spark.createDataFrame(files, "url string, text string"), spark.createDataFrame([("r",)], "url string"))
    assert sorted(tuple(x) for x in got.collect()) == [("r", "http://h/1", "2024-01-01"), ("r", "http://h/2", None)]


def test_trace_index(spark):
    rows = [("start", "t", "poll", 1, None), ("end", "t", None, 5, True), ("start", "u", "poll", 2, None)]
    got = {r.trace_id: (r.kind, r.started, r.ended, r.ok) for r in tables.trace_index(spark.createDataFrame(rows, "event string, trace_id string, kind string, ts long, ok boolean")).collect()}
    assert got == {"t": ("poll", 1, 5, True), "u": ("poll", 2, None, None)}


def test_source_isolates_failures(spark):
    def fetch(slug, page):
        if slug == "bad":
            raise ValueError("no")
        return [{"post_id": f"{slug}{page}", "title": "t"}]

    registry.register(spark, "test_posts", fetch)
    sites = json.dumps([{"slug": "a", "host": "h", "pages": 2}, {"slug": "bad", "host": "h"}, {"slug": "c", "host": "i"}])
    got = spark.read.format("test_posts").option("sites", sites).load().collect()
    assert sorted((r.slug, r.post_id or "", r.error or "") for r in got) == [("a", "a1", ""), ("a", "a2", ""), ("bad", "", "ValueError: no"), ("c", "c1", "")]


def test_models_that_fail(spark):
    def fails(*_):
        raise RuntimeError

    rows = spark.createDataFrame([("1", "T", "x" * 500, "p"), ("2", "T", "", None), ("3", "T", "short", "")], "post_id string, title string, text string, prompt string")
    assert {r.post_id: r.summary for r in llm_hooks.summarised(rows, fails).collect()} == {"1": "x" * 400, "2": "T", "3": "short"}
    assert llm_hooks.filtered(rows, fails).count() == 3
    assert [r.post_id for r in llm_hooks.filtered(rows, lambda p, t: False).collect()] == ["2", "3"]


def test_delivery_cases(spark):
    ts = "timestamp"
    subs = spark.createDataFrame([("s", "t1", "2024-01-02"), ("s", "t1", "2024-01-05"), ("s", "t2", "2024-01-04")], "slug string, target_id string, c string").withColumn("created_at", F.col("c").cast(ts))
    posts = spark.createDataFrame([("s", "p1", "2024-01-01"), ("s", "p2", "2024-01-03"), ("s", "p3", "2024-01-04")], "slug string, post_id string, c string").withColumn("collected_at", F.col("c").cast(ts))
    sent = spark.createDataFrame([("s", "p3", "t1")], "slug string, post_id string, target_id string")
    assert sorted(tuple(r) for r in joins.owed_posts(posts, subs, sent).collect()) == [("s", "p2", "t1"), ("s", "p3", "t2")]
    old = joins.collectable_posts(posts, subs, sent, F.lit("2024-01-04").cast(ts))
    assert [r.post_id for r in old.collect()] == ["p1"]


@pytest.mark.parametrize(("n", "wanted"), [(1, 180.0), (100, 180.0 if 99 * 0.5 + 830 < 180 else 879.5)])
def test_timeout(spark, n, wanted):
    assert spark.range(1).select(streams.site_timeout(180, F.lit(n), 0.5).alias("s")).first().s == wanted


def test_span_tree_is_whole(spark):
    """A chain of more spans than any fixed number of levels."""
    chain = [(1, k, k - 1 if k else None) for k in range(20)] + [(1, 100, 77), (1, 101, 100), (2, 5, None)]
    got = {(r.trace_id, r.span_id): (r.depth, r.path) for r in windows.span_tree(spark.createDataFrame(chain, "trace_id long, span_id long, parent_id long")).collect()}
    assert len(got) == len(chain) and got[1, 19] == (19, "/".join(f"{k:012d}" for k in range(20))) and got[1, 101][0] == 1 and got[2, 5] == (0, f"{5:012d}")


def test_span_circles(spark):
    """Spans on a circle of parents, and what hangs on it, are kept without a depth."""
    spans = [(1, 1, None), (1, 2, 1), (1, 3, 4), (1, 4, 3), (1, 5, 4), (2, 3, 9), (2, 7, 7)]
    got = {(r.trace_id, r.span_id): r.depth for r in windows.span_tree(spark.createDataFrame(spans, "trace_id long, span_id long, parent_id long")).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): None, (1, 4): None, (1, 5): None, (2, 3): 0, (2, 7): None}


def test_filter_hits_of_many_filters(spark, monkeypatch):
    from tidewatch.operators import joins

    monkeypatch.setattr(joins, "FILTERS_A_ROW", 2)
    posts = spark.createDataFrame([("s", str(k), f"Word{k} of News") for k in range(12)] + [("s", "n", None), ("t", "0", "x")], "slug string, post_id string, text string")
    subscriptions = spark.createDataFrame([("s", f"u{k}", f"word{k} ") for k in range(9)] + [("s", "all", None), ("s", "news", "NEWS"), ("s", "u1", "word2 "), ("q", "u1", "x")], "slug string, target_id string, filter_prompt string")
    got = {(r.post_id, r.target_id) for r in joins.filter_hits(posts, subscriptions).collect()}
    assert got == {(str(k), f"u{k}") for k in range(9)} | {("2", "u1")} | {(str(k), t) for k in range(12) for t in ("all", "news")} | {("n", "all")}
    assert joins.filters_pass(posts, subscriptions).count() == 13 * 11


def _plain_filters(posts, subscriptions):
    """Every pair of a post and a target of its slug, with whether any filter of the target is in the text."""
    wanted = {}
    for slug, target, needle in subscriptions:
        wanted.setdefault((slug, target), set()).add((needle or "").lower())
    return {(s, p, t): any(f in (text or "").lower() for f in fs) for s, p, text in posts for (slug, t), fs in wanted.items() if slug == s}


@pytest.mark.parametrize("most", [4 << 20, 0])
def test_filters_of_targets_in_rows(spark, monkeypatch, most):
    """Rows that are broadcast or dealt out, targets with more filters than a row holds, and a target without a name; pairs are not shuffled."""
    from tidewatch.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_BYTES", most)
    monkeypatch.setattr(joins, "FILTERS_A_ROW", 4)
    posts = [(f"s{k % 3}", str(k), f"Word{k % 7} and Note{k % 5}." if k % 11 else None) for k in range(60)]
    subscriptions = [(f"s{k % 4}", f"t{k % 9}", f"WORD{k % 6}") for k in range(200)] + [("s1", "many", f"x{k}") for k in range(30)] + [("s1", "many", "note3"), ("s2", "all", None), ("s0", None, "note1"), (None, "t1", "word1")]
    frames = spark.createDataFrame(posts, "slug string, post_id string, text string"), spark.createDataFrame(subscriptions, "slug string, target_id string, filter_prompt string")
    wanted = _plain_filters(posts, subscriptions)
    got = joins.filters_pass(*frames).select("slug", "post_id", "target_id", "passes").collect()
    assert len(got) == len(wanted) and {tuple(r)[:3]: r.passes for r in got} == wanted
    twice = frames[0].union(frames[0]), frames[1]
    assert joins.filters_pass(*twice).count() == 2 * len(wanted)
    hits = joins.filter_hits(*twice).select("slug", "post_id", "target_id").collect()
    assert len(hits) == sum(wanted.values()) and {tuple(r) for r in hits} == {k for k, passes in wanted.items() if passes}


def test_pairs_of_filters_are_not_shuffled(spark, capsys):
    """Pairs come out of the rows that the texts meet, without a join or an aggregate of pairs."""
    from tidewatch.operators import joins

    posts = spark.createDataFrame([("s", "1", "spam")], "slug string, post_id string, text string")
    subscriptions = spark.createDataFrame([("s", "t", "SPAM")], "slug string, target_id string, filter_prompt string")
    joins.filters_pass(posts, subscriptions).explain()
    plan = capsys.readouterr().out
    assert "Generate" in plan and "HashAggregate" not in plan and "Exchange hashpartitioning" not in plan


def test_span_joins_have_tasks_by_their_spans(spark, monkeypatch, capsys):
    """Neither a broadcast by the bytes of packed files nor a number of tasks that stays as it is while the table grows."""
    monkeypatch.setattr(windows, "TASK_BYTES", 1 << 8)
    monkeypatch.setattr(windows, "BROADCAST_BYTES", 0)
    spans = [(t, k, k - 1 if k else None) for t in range(9) for k in range(5)] + [(1, 13, 14), (1, 14, 13), (2, 30, 77), (2, 31, 30)]
    tree = windows.span_tree(spark.createDataFrame(spans, "trace_id long, span_id long, parent_id long"))
    got = {(r.trace_id, r.span_id): (r.depth, r.path) for r in tree.collect()}
    wanted = {(t, k): (k, "/".join(f"{x:012d}" for x in range(k + 1))) for t in range(9) for k in range(5)} | {(1, 13): (None, None), (1, 14): (None, None), (2, 30): (0, f"{30:012d}"), (2, 31): (1, f"{30:012d}/{31:012d}")}
    assert got == wanted and tree.count() == len(spans)
    tree.explain()
    plan = capsys.readouterr().out
    assert "Broadcast" not in plan and f"{1 + 2 * 48 * len(spans) // 256}), REPARTITION_BY_NUM" in plan
