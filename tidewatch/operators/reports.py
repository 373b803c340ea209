"""Aggregates of the usage, job, run, catalogue and observation reports.

Each takes the frames it needs by their logical columns and returns one frame. All are hash aggregates whose partial sums are built
before the shuffle; none orders more rows than it returns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, 0 where there is nothing to divide by."""
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(F.lit(0.0))


def where_all(rows: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    """Conjunction of the conditions that are given."""
    for c in conditions:
        if c is not None:
            rows = rows.where(c)
    return rows


def _call_measures() -> list[Column]:
    return [
        F.count("*").alias("n_calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("cost_micros").alias("cost_micros"),
        F.round(F.avg("latency_ms"), 3).alias("avg_latency_ms"),
        F.count_if(F.col("status") != "ok").alias("n_errors"),
    ]


def usage_kpis(calls: DataFrame) -> DataFrame:
    return calls.agg(*_call_measures()).withColumn("error_pct", percent(F.col("n_errors"), F.col("n_calls")))


def usage_matrix(calls: DataFrame) -> DataFrame:
    return calls.groupBy("call_site", "provider", "model").agg(*_call_measures()).orderBy("call_site", F.desc("n_calls"), "provider", "model")


def daily_tokens(calls: DataFrame) -> DataFrame:
    """day x call_site with zeros for days without calls. The calendar spans the calls; it has one row a day and site."""
    days = calls.groupBy("call_site", F.to_date("ts").alias("day")).agg(F.sum("total_tokens").alias("tokens"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    grid = span.join(days.select("call_site").distinct())
    return grid.join(days, ["day", "call_site"], "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "call_site", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def daily_pivot(calls: DataFrame, sites: Sequence[str]) -> DataFrame:
    """One column of tokens for each site."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return calls.groupBy(day).pivot("call_site", list(sites)).agg(F.sum("total_tokens")).na.fill(0)


def call_sites(calls: DataFrame) -> DataFrame:
    return calls.select("call_site").distinct()


def recent_calls(calls: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the newest calls; one more row than the page tells whether there is another."""
    page = calls.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)
    return page.select("id", "call_site", "model", "status")


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """cost_micros of each call: the price of provider:model, else of the model, for each `per` tokens."""
    exact = prices.select(F.col("key").alias("k1"), F.struct("prompt", "completion", "per").alias("p1"))
    loose = prices.select(F.col("key").alias("k2"), F.struct("prompt", "completion", "per").alias("p2"))
    found = calls.join(exact, F.concat_ws(":", "provider", "model") == F.col("k1"), "left").join(loose, F.col("model") == F.col("k2"), "left")
    p = F.coalesce("p1", "p2")
    cost = F.col("prompt_tokens") * p["prompt"] + F.col("completion_tokens") * p["completion"]
    return found.select("id", "provider", "model", (cost / p["per"]).alias("cost"))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def bucketed_status(jobs: DataFrame) -> DataFrame:
    """Failed jobs with rc 5 are `blocked`; the row `total` counts all."""
    bucket = F.when((F.col("status") == "failed") & (F.col("result_rc") == 5), F.lit("blocked")).otherwise(F.col("status"))
    return jobs.select(bucket.alias("bucket")).rollup("bucket").agg(F.count("*").alias("n")).select(F.coalesce("bucket", F.lit("total")).alias("bucket"), "n")


def system_counts(subscriptions: DataFrame, jobs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """One row; the three inputs are each reduced to one row first."""
    a = subscriptions.agg(F.count("*").alias("n_subscriptions"), F.countDistinct("slug").alias("n_slugs"))
    b = jobs.where("status = 'pending'").agg(F.count("*").alias("n_pending"))
    c = deliveries.where("kind = 'sent'").agg(F.count("*").alias("n_sent"))
    return a.crossJoin(b).crossJoin(c)


def run_rollup(runs: DataFrame, site_runs: DataFrame) -> DataFrame:
    """Totals of each run's children and whether all have ended; runs without children have ended."""
    sums = site_runs.groupBy("run_id").agg(
        F.count("*").alias("n_sites"),
        F.count_if(F.col("status") == "ok").alias("n_ok"),
        F.count_if(F.col("status") == "error").alias("n_error"),
        F.count_if(F.col("status") == "running").alias("n_running"),
        F.sum("n_new").cast("long").alias("n_new"),
    )
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_sites", "n_ok", "n_error", "n_running", "n_new")}
    return runs.select("run_id").join(sums, "run_id", "left").select("run_id", *zero.values(), (F.coalesce("n_running", F.lit(0)) == 0).alias("terminal"))


def run_totals(site_runs: DataFrame) -> DataFrame:
    return site_runs.agg(
        F.count_if(F.col("status") == "ok").alias("n_done"),
        F.count_if(F.col("status") == "error").alias("n_errors"),
        F.count_if(F.col("status") == "timeout").alias("n_timeouts"),
        F.sum("n_new").cast("long").alias("n_inserted"),
        F.max("duration_ms").alias("max_duration_ms"),
    )


def notify_totals(target_runs: DataFrame) -> DataFrame:
    """One row: targets that were served, that failed, and that had nothing to get."""
    return target_runs.agg(F.count("*").alias("n_targets"), *(F.count_if(F.col("status") == x).alias(f"n_{x}") for x in ("ok", "failed", "empty")), F.coalesce(F.sum("n_posts"), F.lit(0)).alias("n_posts"))


def config_counts(configs: DataFrame) -> DataFrame:
    """Configurations by strategy, handwritten ones by their adapter as well."""
    return configs.groupBy("strategy", F.when(F.col("strategy") == "handwritten", F.col("adapter")).alias("adapter")).agg(F.count("*").alias("n"))


def user_activity(**sources: DataFrame) -> DataFrame:
    """user_id, the sorted list of sources that know the user, first and last time. Each source has user_id and ts."""
    every = None
    for name, rows in sources.items():
        part = rows.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumn("src", F.lit(name))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("sources"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def subscription_counts(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.groupBy("user_id").agg(F.count("*").alias("n_subs"), F.count_if(F.col("target_kind") == "dm").alias("n_dm"), F.count_if(F.col("target_kind") == "channel").alias("n_channel"))


def subscriptions_per_slug(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.groupBy("slug").agg(F.count("*").alias("n_subs"))


def sent_per_target(deliveries: DataFrame) -> DataFrame:
    return deliveries.where("kind = 'sent'").groupBy("target_id").agg(F.count("*").alias("n_sent"), F.max("sent_at").alias("last_sent_at"))


def latest_names(*sources: DataFrame) -> DataFrame:
    """user_id and name: the newest non-empty name of the first source that has one. Each source has user_id, id and name."""
    every = None
    for rank, rows in enumerate(sources):
        part = rows.where("name is not null and name <> ''").groupBy("user_id").agg(F.max_by("name", "id").alias("name")).withColumn("rank", F.lit(rank))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("user_id").agg(F.min_by("name", "rank").alias("name"))


def outcome_counts(cases: DataFrame, least: int = 30) -> DataFrame:
    """Counts by outcome; nothing while there are fewer than `least` cases."""
    counts = cases.groupBy("outcome").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy())).where(F.col("total") >= least).select("outcome", "n")


def top_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ties to the smaller value."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def vocabulary_counts(rows: DataFrame, column: str, vocabulary: Sequence[str]) -> DataFrame:
    """One row with a column for each word, zero where it doesn't occur."""
    return rows.agg(*(F.count_if(F.col(column) == w).alias(f"n_{w}") for w in vocabulary))


def failure_distribution(entries: DataFrame, excluded: Sequence[str]) -> DataFrame:
    return entries.where(~F.col("status").isin(*excluded)).groupBy("status", "subkind").agg(F.count("*").alias("n"))


def progress(entries: DataFrame, done: str) -> DataFrame:
    """Counts, newest time and whole percent done."""
    n, k = F.count("*"), F.count_if(F.col("status") == done)
    return entries.agg(n.alias("n"), k.alias("n_done"), F.max("id").alias("last_id"), F.floor(100 * k / F.greatest(n, F.lit(1))).cast("long").alias("pct"))


def _skip_measures() -> list[Column]:
    known = F.col("current_lastmod").isNotNull()
    return [
        F.count("*").alias("n"),
        F.count_if(known).alias("n_covered"),
        F.count_if("would_skip").alias("n_would_skip"),
        F.count_if("is_index").alias("n_index"),
        F.count_if(F.col("error").isNotNull()).alias("n_error"),
        F.count_if(F.col("would_skip") & (F.col("n_new") > 0)).alias("n_false_skip"),
        F.count_if(~F.col("would_skip") & (F.col("n_new") == 0)).alias("n_wasted"),
    ]


def skip_metrics(observations: DataFrame) -> DataFrame:
    sums = observations.agg(*_skip_measures())
    return sums.select("*", percent(F.col("n_covered"), F.col("n")).alias("coverage_pct"), percent(F.col("n_false_skip"), F.col("n_would_skip")).alias("false_skip_pct"))


def skip_metrics_by_slug(observations: DataFrame) -> DataFrame:
    sums = observations.groupBy("slug").agg(*_skip_measures(), F.max_by("sitemap_url", F.struct("ts", "id")).alias("sitemap_url"))
    return sums.orderBy(F.desc("n"), "slug")


def registration_signals(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), percent(F.count_if(F.col("score") > 0), F.count("*")).alias("positive_pct"))


def host_clusters(entries: DataFrame) -> DataFrame:
    """Hosts with two different URLs or more, and whether all use one strategy."""
    sums = entries.groupBy("host").agg(F.countDistinct("url").alias("n_urls"), (F.countDistinct("strategy") == 1).alias("uniform"))
    return sums.where("n_urls >= 2").orderBy(F.desc("n_urls"), "host")


def template_clusters(entries: DataFrame) -> DataFrame:
    """Path template and query shape that at least two hosts share, with a literal segment at least."""
    sums = entries.where("n_literal >= 1").groupBy("template", "query_shape").agg(F.countDistinct("host").alias("n_hosts"), F.count("*").alias("n_urls"))
    return sums.where("n_hosts >= 2")


def undismissed(clusters: DataFrame, dismissed: DataFrame, key: str) -> DataFrame:
    return clusters.join(dismissed.select(key).distinct(), key, "left_anti")


def vocabulary_trigger(entries: DataFrame, threshold: int = 3) -> DataFrame:
    """For each candidate: how often deferred at each confidence, whether to act, and whether high and low contradict.

    A failed attempt lowers the confidence by a step. The contradiction looks at all entries, deferred or not.
    """
    lowered = F.when(F.col("attempt_failed"), F.when(F.col("confidence") == "high", F.lit("med")).otherwise(F.lit("low"))).otherwise(F.col("confidence"))
    e = entries.withColumn("c", lowered)
    counts = e.groupBy("candidate").agg(
        F.count_if("deferred").alias("n"),
        *(F.count_if(F.col("deferred") & (F.col("c") == x)).alias(f"n_{x}") for x in ("high", "med", "low")),
        (F.bool_or(F.col("c") == "high") & F.bool_or(F.col("c") == "low")).alias("contradiction"),
    )
    return counts.withColumn("trigger", ((F.col("n_high") >= 1) & (F.col("n") >= threshold)) | (F.col("n_med") >= threshold))


def pattern_counter(rejections: DataFrame) -> DataFrame:
    """(host, prefix): first and last time, count and the last reason."""
    return rejections.groupBy("host", "prefix").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("reason", F.struct("ts", "id")).alias("last_reason"))


def sitemap_fit(paths: DataFrame, least: int = 30, share: float = 0.8) -> DataFrame:
    """site, share of id-like paths, share of the most frequent first segment, and whether both reach `share` over `least` paths."""
    by = paths.groupBy("site", "segment").agg(F.count("*").alias("n"), F.count_if("id_like").alias("k"))
    sums = by.groupBy("site").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max("n").alias("top"))
    a, b = F.round(F.col("k") / F.col("n"), 4), F.round(F.col("top") / F.col("n"), 4)
    return sums.select("site", F.col("n").cast("long").alias("n"), a.alias("id_share"), b.alias("top_share"), ((F.col("n") >= least) & (F.col("k") / F.col("n") >= share) & (F.col("top") / F.col("n") >= share)).alias("fits"))


def external_links(links: DataFrame, least_hosts: int = 3, ratio: float = 0.95) -> DataFrame:
    """page: share of links to other hosts, different other hosts, and whether the page is a hub of many sites. A row stands for n_links
    links where it has that column."""
    n = F.col("n_links") if "n_links" in links.columns else F.lit(1)
    outside = F.col("link_host") != F.col("page_host")
    sums = links.groupBy("page_id").agg(F.sum(n).alias("n"), F.coalesce(F.sum(F.when(outside, n)), F.lit(0)).alias("k"), F.countDistinct(F.when(outside, F.col("link_host"))).alias("n_hosts"), F.countDistinct(F.when(outside, F.col("link_site"))).alias("n_sites"))
    share = F.round(F.col("k") / F.col("n"), 4)
    return sums.select("page_id", "n", share.alias("external_share"), "n_hosts", ((F.col("n_hosts") >= least_hosts) & (F.col("k") / F.col("n") >= ratio) & (F.col("n_sites") > 1)).alias("hub"))


def post_quality(posts: DataFrame) -> DataFrame:
    """slug: posts, repeated ids, blank ids, ids of a bad shape, empty titles, unreadable dates, and whether the slug counts as broken."""
    shape = F.col("post_id").rlike(r"(?U)^[\w\-./:%,]{1,200}$")
    sums = posts.groupBy("slug").agg(
        F.count("*").alias("n"),
        (F.count("post_id") - F.countDistinct("post_id")).alias("n_repeated"),
        F.count_if(F.coalesce(F.trim("post_id"), F.lit("")) == "").alias("n_blank"),
        F.count_if(~shape).alias("n_bad_shape"),
        F.count_if(F.coalesce(F.trim("title"), F.lit("")) == "").alias("n_untitled"),
    )
    return sums.withColumn("broken", (F.col("n") == 0) | (F.col("n_bad_shape") > 0) | (2 * F.col("n_untitled") > F.col("n")))


def triage(reports: DataFrame, jobs: DataFrame, cutoff: Column) -> DataFrame:
    """One row: open reports, recent reports, failed slugs, queue size; each input is reduced to one row first."""
    a = reports.agg(F.count_if(F.col("status") == "open").alias("n_open"), F.count_if(F.col("ts") >= cutoff).alias("n_recent"))
    b = jobs.agg(F.countDistinct(F.when(F.col("status") == "failed", F.col("slug"))).alias("n_failed_slugs"), F.count_if(F.col("status") == "pending").alias("n_queue"))
    return a.crossJoin(b)


def content_types(entries: DataFrame, k: int = 8) -> DataFrame:
    return top_values(entries, "content_type", k)
