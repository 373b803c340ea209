"""The logical tables of the reports, read out of the supplied test tables.

Each view is a table and a list of expressions that Spark and DuckDB read alike; {k} is the number in an event's props. The same
definition serves a query and the SQL that it is held against, as both need the same input and nothing more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KIND = "CASE user_id % 4 WHEN 0 THEN 'register' WHEN 1 THEN 'reprobe' WHEN 2 THEN 'poll_site' ELSE 'deliver_target' END"
HOUR = "interval '1' hour"

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "calls": (
        "events",
        {
            "id": "event_id",
            "ts": "ts",
            "call_site": "event_type",
            "provider": "concat('p', CAST(user_id % 3 AS STRING))",
            "model": "concat('m', CAST(user_id % 4 AS STRING))",
            "status": "CASE WHEN {k} % 10 = 0 THEN 'error' ELSE 'ok' END",
            "prompt_tokens": "{k} * 10",
            "completion_tokens": "{k}",
            "total_tokens": "{k} * 11",
            "latency_ms": "CAST(floor(value * 10) AS BIGINT)",
            "cost_micros": "CAST(floor(value * 100) AS BIGINT)",
        },
    ),
    "jobs": (
        "events",
        {
            "id": "event_id",
            "kind": KIND,
            "slug": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat('src', CAST(user_id % 23 AS STRING)) END",
            "url": "concat('http://h', CAST(user_id % 30 AS STRING), '.example.com/b/', CAST(event_id % 200 AS STRING))",
            "via": "CASE event_id % 5 WHEN 0 THEN 'batch' WHEN 1 THEN 'batch-retry' ELSE 'user' END",
            "user_id": "user_id",
            "status": "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'done' WHEN 'click' THEN 'pending' WHEN 'signup' THEN CASE WHEN {k} < 3 THEN 'running' ELSE 'done' END ELSE 'rejected' END",
            "ts": "ts",
            "finished_at": "CASE WHEN event_type IN ('error', 'view', 'purchase') THEN date_trunc('hour', ts) END",
            "result_rc": "CASE event_type WHEN 'error' THEN {k} % 7 - 1 WHEN 'view' THEN 0 WHEN 'purchase' THEN {k} % 3 + 2 END",
            "result_tail": "CASE {k} % 6 WHEN 0 THEN '[FAIL] posts_nonempty x [FAIL] own_check' WHEN 1 THEN 'TARGET_NOT_FOUND' WHEN 2 THEN 'recognize_reject (wiki)' WHEN 3 THEN 'verdict BLOCKED_BOT' WHEN 4 THEN 'UNAVAILABLE' ELSE NULL END",
            "attempts": "{k} % 3",
            "requeue_at": "CASE WHEN event_id % 4 = 0 THEN ts + interval '2' hour END",
            "dedupe_key": "CASE WHEN event_id % 3 = 0 THEN concat('d', CAST({k} AS STRING)) END",
        },
    ),
    "observations": (
        "events",
        {
            "id": "event_id",
            "ts": "ts",
            "slug": "concat('s', CAST(user_id % 40 AS STRING))",
            "sitemap_url": "concat('http://s', CAST(user_id % 40 AS STRING), '.example.com/sitemap', CAST({k} % 3 AS STRING), '.xml')",
            "current_lastmod": "CASE WHEN {k} % 4 = 0 THEN NULL ELSE concat('2024-01-', lpad(CAST({k} % 28 + 1 AS STRING), 2, '0')) END",
            "would_skip": "{k} % 3 = 0",
            "is_index": "{k} % 5 = 0",
            "error": "CASE WHEN event_type = 'error' THEN 'timeout' END",
            "n_new": "{k} % 2",
        },
    ),
    "reports": ("events", {"id": "event_id", "ts": "ts", "user_id": "user_id", "status": "CASE WHEN event_type = 'error' THEN 'open' ELSE 'closed' END", "name": "CASE WHEN {k} % 3 = 0 THEN '' ELSE concat('r', CAST({k} AS STRING)) END"}),
    "spans": (
        "events",
        {
            "trace_id": "CAST(floor(event_id / 16) AS BIGINT)",
            "span_id": "event_id",
            "parent_id": "CASE WHEN event_id % 16 = 0 THEN NULL WHEN event_id % 16 = 9 THEN -1 ELSE CAST(floor(event_id / 16) AS BIGINT) * 16 + CAST(floor((event_id % 16 - 1) / 3) AS BIGINT) END",
            "name": "event_type",
            "t0": "event_id * 10 % 977",
            "t1": "event_id * 10 % 977 + {k}",
        },
    ),
    "posts": (
        "documents",
        {
            "slug": "source",
            "post_id": "CAST(doc_id AS STRING)",
            "title": "text",
            "url": "concat('http://', source, '.example.com/p/', CAST(doc_id AS STRING))",
            "category": "lang",
            "text": "text",
            "collected_at": "timestamp '2024-01-01 00:00:00' + (doc_id * 37 % 700) * " + HOUR,
        },
    ),
    "subscriptions": (
        "orders",
        {
            "id": "o_orderkey",
            "user_id": "o_custkey",
            "slug": "concat('src', CAST(o_orderkey % 23 AS STRING))",
            "target_id": "concat('t', CAST(o_custkey % 50 AS STRING))",
            "target_kind": "CASE WHEN o_custkey % 3 = 0 THEN 'channel' ELSE 'dm' END",
            "filter_prompt": "CASE o_orderkey % 3 WHEN 0 THEN 'tionhe' WHEN 1 THEN 'spam' ELSE 'einau' END",
            "created_at": "timestamp '2024-01-01 00:00:00' + (o_orderkey % 600) * " + HOUR,
        },
    ),
    "deliveries": (
        "events",
        {
            "slug": "concat('src', CAST(event_id % 20 AS STRING))",
            "post_id": "CAST(event_id % 1000 AS STRING)",
            "target_id": "concat('t', CAST(user_id % 50 AS STRING))",
            "user_id": "user_id",
            "kind": "CASE WHEN event_type = 'error' THEN 'filtered' ELSE 'sent' END",
            "sent_at": "ts",
        },
    ),
    "users": ("customer", {"user_id": "c_custkey", "name": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END", "id": "c_custkey"}),
    "preferences": ("customer", {"user_id": "c_custkey", "opted_out": "c_acctbal < 0"}),
    "settings": (
        "customer",
        {
            "target_id": "c_custkey",
            "deliver_at": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat(lpad(CAST(c_custkey * 7 % 24 AS STRING), 2, '0'), ':', lpad(CAST(c_custkey * 13 % 60 AS STRING), 2, '0')) END",
            "last_date": "CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '2024-01-14' ELSE '2024-01-15' END",
        },
    ),
    "channels": ("supplier", {"target_id": "s_suppkey", "deliver_at": "concat(lpad(CAST(s_suppkey % 24 AS STRING), 2, '0'), ':00')", "last_date": "CASE WHEN s_suppkey % 2 = 0 THEN '2024-01-15' END"}),
    "runs": (
        "orders",
        {
            "run_id": "o_orderkey",
            "status": "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'enqueue_done' ELSE 'done' END",
            "started_at": "o_orderdate",
            "day": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
            "n_sites": "8",
        },
    ),
    "site_runs": (
        "lineitem",
        {
            "run_id": "l_orderkey",
            "slug": "concat('s', CAST(l_suppkey AS STRING))",
            "status": "CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'running' WHEN l_returnflag = 'R' THEN 'error' WHEN l_quantity > 45 THEN 'timeout' ELSE 'ok' END",
            "n_new": "CAST(l_quantity AS BIGINT)",
            "duration_ms": "CAST(floor(l_extendedprice) AS BIGINT)",
        },
    ),
    "cases": ("labels", {"id": "doc_id", "outcome": "CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'registered' ELSE 'failed' END", "score": "CAST(quality - toxic AS DOUBLE)", "fix_layer": "concat('layer', CAST(doc_id % 7 AS STRING))"}),
    "prices": ("part", {"key": "CASE WHEN p_partkey % 2 = 0 THEN concat('p', CAST(p_partkey % 3 AS STRING), ':m', CAST(p_size % 4 AS STRING)) ELSE concat('m', CAST(p_size % 4 AS STRING)) END", "prompt": "CAST(p_size AS DOUBLE)", "completion": "CAST(p_size * 2 AS DOUBLE)", "per": "1000000.0", "partkey": "p_partkey"}),
    "entries": ("pages", {"entry_id": "page_id", "url": "url", "html": "html"}),
    # pages with what the reports look for, each where its number says so
    "sites": (
        "pages",
        {
            "page_id": "page_id",
            "url": "concat('http://h', CAST(page_id % 9 AS STRING), '.example.com/s/', CAST(page_id AS STRING))",
            "html": """concat('<html><head><title>Site ', CAST(page_id AS STRING), ' &amp; Co</title>',
                CASE WHEN page_id % 3 = 0 THEN '<meta property="og:type" content="article">' ELSE '' END,
                CASE page_id % 4 WHEN 1 THEN concat('<script type="application/ld+json">{"headline":"', repeat('h', 150), '","@type":"NewsArticle"}</script>') WHEN 2 THEN '<script type="application/ld+json">{"@type":"Organization"}</script>' ELSE '' END,
                CASE WHEN page_id % 5 = 2 THEN '<link rel="alternate" type="application/rss+xml" href="/feed.xml">' ELSE '' END, '</head><body>',
                CASE WHEN page_id % 7 = 3 THEN '<div itemscope itemtype="https://schema.org/BlogPosting"></div>' ELSE '' END,
                CASE WHEN page_id % 2 = 0 THEN '<nav>' ELSE '<main>' END, '<ul class="list">',
                repeat('<li class="row a" data-id="7"><b><a href="/tag/x">t</a></b> <a href="/board/view/1001">post</a></li>', CAST(page_id % 6 AS INT)),
                repeat('<li class="row b"><a href="javascript:go(2)">note</a></li>', CAST(page_id % 4 AS INT)),
                '</ul>', CASE WHEN page_id % 2 = 0 THEN '</nav>' ELSE '</main>' END,
                '<p>', repeat('<a href="https://one.example.org/x">o</a>', CAST(page_id % 5 * 50 AS INT)),
                CASE WHEN page_id % 5 > 2 THEN '<a href="https://two.example.net/">t</a><a href="https://three.test.com/">t</a>' ELSE '' END, '</p>',
                CASE page_id % 8 WHEN 5 THEN '<a href="/list?page=2">next</a>' WHEN 6 THEN '<a href="/l/page/2">2</a><a href="/l/page/3">3</a>' WHEN 7 THEN '<a href="/rss/all">feed</a>' ELSE '' END,
                '</body></html>')""",
        },
    ),
    # few who follow, and what was handed to them, so that posts owed to nobody exist
    "watches": (
        "supplier",
        {
            "slug": "concat('src', CAST(s_suppkey % 23 AS STRING))",
            "target_id": "concat('w', CAST(s_suppkey % 2 AS STRING))",
            "user_id": "s_suppkey",
            "created_at": "timestamp '2024-01-01 00:00:00' + (s_suppkey * 53 % 600) * " + HOUR,
        },
    ),
    "handed": ("documents", {"slug": "source", "post_id": "CAST(doc_id AS STRING)", "target_id": "concat('w', CAST(doc_id % 2 AS STRING))", "user_id": "doc_id", "kind": "'sent'", "sent_at": "timestamp '2024-01-19 00:00:00'"}),
    "vocabulary": (
        "events",
        {
            "candidate": "concat('v', CAST(user_id AS STRING))",
            "confidence": "CASE {k} % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'med' ELSE 'low' END",
            "deferred": "event_type <> 'view'",
            "attempt_failed": "event_type = 'error'",
        },
    ),
    # attempts of fetching a user's site of a day; most of a site's attempts end alike, by the user
    "attempts": (
        "events",
        {
            "site": "concat('u', CAST(user_id AS STRING), '-', CAST(day(ts) AS STRING))",
            "site_url": "concat('https://u', CAST(user_id AS STRING), '.example.co.kr/b')",
            "way": "CASE WHEN event_id % 2 = 0 THEN 'baseline' WHEN event_id % 5 < 2 THEN 'static' WHEN event_id % 5 = 2 THEN 'headless' WHEN event_id % 5 = 3 THEN CASE WHEN {k} % 2 = 0 THEN 'captured' ELSE 'login_headers' END ELSE CASE WHEN {k} % 2 = 0 THEN 'external' ELSE 'paid' END END",
            "name": "CASE WHEN event_id % 5 < 2 THEN concat('S1.H', CAST({k} % 4 + 1 AS STRING)) ELSE concat('X', CAST({k} % 3 AS STRING)) END",
            "class": """CASE WHEN event_id % 2 = 0 THEN CASE day(ts) % 4 WHEN 0 THEN 'BLOCKED_BOT' WHEN 1 THEN 'UNKNOWN_ERROR' WHEN 2 THEN 'OK' ELSE event_type END
                ELSE CASE user_id % 8 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'BLOCKED_BOT' WHEN 2 THEN 'UNKNOWN_ERROR' WHEN 3 THEN 'LOGIN_REQUIRED' WHEN 4 THEN CASE WHEN {k} % 3 = 0 THEN 'BLOCKED_BOT' ELSE 'NOT_FOUND' END ELSE CASE WHEN {k} % 4 = 0 THEN 'HTTP_ERROR' ELSE 'OK' END END END""",
            "status": "CASE WHEN user_id % 9 = 1 THEN 406 WHEN event_type = 'view' THEN 200 END",
            "error": "CASE WHEN {k} % 3 = 1 THEN 'ConnectTimeout: x' WHEN event_type = 'error' THEN 'other' END",
            "note": "CASE {k} % 3 WHEN 0 THEN 'suspiciously empty body (154 bytes)' WHEN 1 THEN 'redirected to login' ELSE CASE WHEN user_id % 10 = 7 THEN 'Cloudflare Ray ID' END END",
            "final_url": "CASE WHEN user_id % 11 = 6 THEN 'http://landing.example.org/' WHEN {k} % 2 = 0 THEN concat('https://www.u', CAST(user_id AS STRING), '.example.co.kr/b') END",
        },
    ),
    "turns": ("conversations", {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"}),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    k = "CAST(get_json_object(props, '$.k') AS BIGINT)"
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e.replace('{k}', k)} AS {c}" for c, e in columns.items()))


def ctes(*names: str) -> str:
    """WITH clause of the views for DuckDB."""
    k = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    filled = lambda e: e.replace('{k}', k)
    parts = []
    for name in names:
        table, columns = VIEWS[name]
        parts.append(f"{name} AS (SELECT {', '.join(f'{filled(e)} AS {c}' for c, e in columns.items())} FROM {table})")
    return "WITH " + ",\n".join(parts)
