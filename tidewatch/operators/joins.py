"""Joins and set operations of delivery, queue, catalogue and rule matching.

Small sides are left to Spark's own size estimate and adaptive execution; nothing here is broadcast without one. Where a key may hold a
large part of the rows, both sides are plain shuffle joins, whose large partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scratch import saved

from . import classify


def owed_posts(posts: DataFrame, subscriptions: DataFrame, deliveries: DataFrame) -> DataFrame:
    """slug, post_id, target_id of posts that a target is owed: collected since its first subscription to the slug, and not in the ledger."""
    since = subscriptions.groupBy("slug", "target_id").agg(F.min("created_at").alias("since"))
    due = posts.select("slug", "post_id", "collected_at").join(since, "slug").where("collected_at >= since")
    return due.select("slug", "post_id", "target_id").join(deliveries.select("slug", "post_id", "target_id"), ["slug", "post_id", "target_id"], "left_anti")


def collectable_posts(posts: DataFrame, subscriptions: DataFrame, deliveries: DataFrame, before: Column) -> DataFrame:
    """Old posts that no eligible target still waits for."""
    old = posts.where(F.col("collected_at") < before)
    waiting = owed_posts(old, subscriptions, deliveries).select("slug", "post_id").distinct()
    return old.select("slug", "post_id").join(waiting, ["slug", "post_id"], "left_anti")


def opted_in(users: DataFrame, preferences: DataFrame) -> DataFrame:
    """Users without a preference row count as opted in."""
    out = preferences.where("opted_out").select("user_id").distinct()
    return users.select("user_id").distinct().join(out, "user_id", "left_anti")


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The row with the greatest `order` of each key, as one aggregate and no sort."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r"))
    return best.select(*keys, *(F.col("r")[c].alias(c) for c in columns))


def latest_with_ties(rows: DataFrame, key: str, order: str) -> DataFrame:
    """All rows that share the greatest `order` of their key."""
    ranked = rows.where(F.col(order).isNotNull()).withColumn("_rank", F.rank().over(Window.partitionBy(key).orderBy(F.desc(order))))
    return ranked.where("_rank = 1").drop("_rank")


def catalogue_status(entries: DataFrame, jobs: DataFrame, configured: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """entry_id, url, whether configured, and status: registered, untried, or the kind of failure of the latest registration.

    An entry counts as configured under its own URL or, by the table aliases (url, other), under another one. A registration that ended
    well but left no configuration is no registered entry; it keeps the kind `done`.
    """
    last = jobs.where("kind = 'register'").groupBy("url").agg(F.max_by(F.struct("status", "result_rc", "result_tail"), "id").alias("j"))
    known = configured.select("url").distinct()
    if aliases is not None:
        known = known.unionByName(aliases.join(known.withColumnRenamed("url", "other"), "other", "left_semi").select("url")).distinct()
    rows = entries.join(last, "url", "left").join(known.withColumn("configured", F.lit(True)), "url", "left")
    configured_ = F.coalesce("configured", F.lit(False))
    kind, _ = classify.failure(F.col("j.status"), F.col("j.result_rc"), F.col("j.result_tail"))
    status = F.when(configured_, F.lit("registered")).when(F.col("j").isNull(), F.lit("untried")).otherwise(kind)
    return rows.select("entry_id", "url", configured_.alias("configured"), status.alias("status"))


def runnable(jobs: DataFrame) -> DataFrame:
    """Pending jobs whose slug isn't running; a job without a slug is runnable."""
    busy = jobs.where("status = 'running' and slug is not null").select("slug").distinct()
    return jobs.where("status = 'pending'").join(busy, "slug", "left_anti")


def user_profiles(users: DataFrame, subscriptions: DataFrame, reports: DataFrame, deliveries: DataFrame, names: DataFrame) -> DataFrame:
    """Every user with the counts of each source; the sources are aggregated before they are joined."""
    subs = subscriptions.groupBy("user_id").agg(F.count("*").alias("n_subs"), F.countDistinct("slug").alias("n_slugs"))
    reps = reports.groupBy("user_id").agg(F.count("*").alias("n_reports"), F.count_if(F.col("status") == "open").alias("n_open"))
    sent = deliveries.groupBy("user_id").agg(F.count_if(F.col("kind") == "sent").alias("n_sent"))
    rows = users.select("user_id").distinct()
    for part in (subs, reps, sent, names):
        rows = rows.join(part, "user_id", "left")
    return rows.select("user_id", "name", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_subs", "n_slugs", "n_reports", "n_open", "n_sent")))


def site_registry(sites: DataFrame, subscriptions: DataFrame, streaks: DataFrame) -> DataFrame:
    """Slugs of all sources with subscriptions and failure streak, the worst first."""
    subs = subscriptions.groupBy("slug").agg(F.count("*").alias("n_subs"))
    slugs = sites.select("slug").union(subs.select("slug")).union(streaks.select("slug")).where("slug is not null").distinct()
    rows = slugs.join(subs, "slug", "left").join(streaks, "slug", "left")
    return rows.select("slug", F.coalesce("n_subs", F.lit(0)).cast("long").alias("n_subs"), F.coalesce("streak", F.lit(0)).cast("long").alias("streak")).orderBy(F.desc("streak"), F.desc("n_subs"), "slug")


def first_rule(rows: DataFrame, url: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """The first of the ordered rules (name, pattern) that a URL fits, as one expression without a join."""
    hit = reduce(lambda c, r: c.when(F.col(url).rlike(r[1]), F.lit(r[0])), rules[1:], F.when(F.col(url).rlike(rules[0][1]), F.lit(rules[0][0])))
    return rows.withColumn("rule", hit)


def policy_hits(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """url_id and the first rule (smallest priority) that rejects it, from url_id, host, path.

    A rule (priority, rule, host_suffix, path_prefix, path_ext, root_only) has a host suffix, a path prefix or both, which must then both
    hold; `root_only` confines a host to its root; an ending of the path rejects by itself. Rows meet rules by equality alone: of a
    suffix of their host, of one of their path's prefixes, or of their path's ending.
    """
    labels = F.split(F.rtrim(F.lower("host"), F.lit(".")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    low = F.lower(F.coalesce("path", F.lit("")))
    segments = F.split(F.regexp_replace(low, "^/|/+$", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), k), "/")))
    rows = rows.select("url_id", "host", low.alias("path"), prefixes.alias("prefixes"))
    wanted = rules.select("priority", "rule", F.lower("host_suffix").alias("host_suffix"), F.rtrim(F.lower("path_prefix"), F.lit("/")).alias("path_prefix"), F.lower("path_ext").alias("path_ext"), F.coalesce("root_only", F.lit(False)).alias("root_only"))
    by_host = rows.where("host is not null").withColumn("host_suffix", F.explode(suffixes)).join(wanted.where("host_suffix is not null"), "host_suffix")
    by_host = by_host.where("(path_prefix is null and (not root_only or path in ('', '/'))) or array_contains(prefixes, path_prefix)")
    by_path = rows.withColumn("path_prefix", F.explode("prefixes")).join(wanted.where("host_suffix is null and path_prefix is not null"), "path_prefix")
    by_end = rows.withColumn("path_ext", F.regexp_extract("path", r"(\.[^./]+)$", 1)).join(wanted.where("path_ext is not null"), "path_ext")
    hits = reduce(DataFrame.unionByName, (x.select("url_id", "priority", "rule") for x in (by_host, by_path, by_end)))
    return hits.groupBy("url_id").agg(F.min_by("rule", "priority").alias("rule"))


def orphan_markers(markers: DataFrame) -> DataFrame:
    """Pairs of different slugs that end in the same hash."""
    m = markers.select("slug", F.element_at(F.split("slug", "_"), -1).alias("hash"))
    other = m.select(F.col("slug").alias("other"), "hash")
    return m.join(other, "hash").where("slug < other").select("slug", "other", "hash")


def span_parents(spans: DataFrame) -> DataFrame:
    """Spans with the name of their parent; one whose parent is missing is a root."""
    p = spans.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"), F.col("name").alias("parent_name"))
    joined = spans.join(p, (F.col("trace_id") == F.col("t")) & (F.col("parent_id") == F.col("s")), "left")
    return joined.select("trace_id", "span_id", "parent_name", F.col("s").isNull().alias("is_root"))


def rendered_growth(static: DataFrame, rendered: DataFrame, factor: int = 2, least: int = 5, repeats: int = 20) -> DataFrame:
    """Row patterns (page, selector, n) of two renderings side by side, and whether the second shows enough more rows: by their sums, or by
    the rows of patterns that only it has or has at least three times as often."""
    a, b = static.select("page_id", "selector", F.col("n").alias("n_static")), rendered.select("page_id", "selector", F.col("n").alias("n_rendered"))
    both = a.join(b, ["page_id", "selector"], "full")
    x, y = F.coalesce("n_static", F.lit(0)), F.coalesce("n_rendered", F.lit(0))
    drawn = F.when((x == 0) & (y >= 3), y).when((x > 0) & (y >= 3 * x) & (y - x >= 5), y - x).otherwise(0)
    sums = both.groupBy("page_id").agg(F.sum(x).alias("n_static"), F.sum(y).alias("n_rendered"), F.sum(drawn).alias("n_drawn"))
    by_sum = (F.col("n_rendered") >= factor * F.col("n_static")) & (F.col("n_rendered") - F.col("n_static") >= least)
    return sums.select("page_id", "n_static", "n_rendered", (by_sum | (F.col("n_drawn") >= repeats)).alias("needs_rendering"))


def subscribed(sites: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The sites that anyone follows."""
    return sites.join(subscriptions.select("slug").distinct(), "slug", "left_semi")


def earliest_active(jobs: DataFrame) -> DataFrame:
    """Each active job with the earliest active one of its slug, if that is another."""
    active = jobs.where("status in ('pending', 'running') and slug is not null")
    first = active.groupBy("slug").agg(F.min("id").alias("first_id"))
    return active.select("id", "slug").join(first, "slug").where("first_id < id").select("id", "slug", "first_id")


def missing_ids(attempted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attempted keys that the store doesn't hold."""
    return attempted.select(*keys).distinct().join(present.select(*keys), list(keys), "left_anti")


def union_by_key(preferred: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key, the preferred row."""
    return preferred.unionByName(other.join(preferred.select(key).distinct(), key, "left_anti"))


def shared_keys(rows: DataFrame, left: str, right: str) -> DataFrame:
    return rows.withColumn("shared", F.array_sort(F.array_intersect(left, right)))


#: Filters of targets that one row holds at most, but for chance.
FILTERS_A_ROW = 256
#: Bytes of such rows up to which they are broadcast, and what the posts of a slug are dealt out over beyond.
BROADCAST_BYTES = 4 << 20
SALTS = 32


def _filter_rows(subscriptions: DataFrame) -> DataFrame:
    """slug, its targets with their filters in rows of bounded size, and the different filters of a row.

    Targets with the same filters stand together, so that a filter is in few rows. The filters of a target that has more than a row
    holds are in several, which are marked `partial`.
    """
    wanted = subscriptions.where("slug is not null").select("slug", "target_id", F.lower(F.coalesce("filter_prompt", F.lit(""))).alias("filter")).distinct()
    sizes = wanted.groupBy(F.col("slug").alias("s"), F.col("target_id").alias("t")).agg(F.ceil(F.count("*") / FILTERS_A_ROW).alias("parts"))
    sized = wanted.join(sizes, (F.col("slug") == F.col("s")) & F.col("target_id").eqNullSafe(F.col("t")))
    part = F.pmod(F.xxhash64("filter"), F.col("parts"))
    targets = sized.groupBy("slug", "target_id", (F.col("parts") > 1).alias("partial"), part.alias("part")).agg(F.array_sort(F.collect_list("filter")).alias("filters"))
    rows = targets.groupBy("slug").agg(F.ceil(F.sum(F.size("filters")) / FILTERS_A_ROW).alias("rows"))
    alike = targets.groupBy("slug", "filters").agg(F.ceil(F.count("*") * F.size("filters") / FILTERS_A_ROW).alias("alike"))
    dealt = targets.join(rows, "slug").join(alike, ["slug", "filters"])
    row = F.pmod(F.xxhash64("filters"), F.col("rows")), F.pmod(F.xxhash64("target_id"), F.col("alike"))
    members = F.collect_list(F.struct("target_id", "filters")).alias("targets")
    return dealt.groupBy("slug", "partial", row[0].alias("row"), row[1].alias("piece")).agg(members, F.array_distinct(F.flatten(F.collect_list("filters"))).alias("filters"))


def _judged(posts: DataFrame, subscriptions: DataFrame, hits: bool) -> tuple[DataFrame, bool]:
    """slug, post_id, place (of the post), target_id, partial, and whether any of the target's filters in a row lets the post pass, of
    all pairs or of hits alone; and whether any answer is partial.

    A text meets the rows of its slug's filters, each filter of a row is looked for once, and the row's targets come out of it with
    their answers: neither pairs nor hits are shuffled. The rows are written, as their bytes decide how texts meet them: by a
    broadcast, or dealt out over SALTS keys a slug, as there are few slugs.
    """
    rows = saved(_filter_rows(subscriptions), "filters")
    held = F.aggregate("targets", F.lit(0), lambda n, t: n + 32 + F.octet_length(F.coalesce(t["target_id"].cast("string"), F.lit(""))) + 2 * F.octet_length(F.array_join(t["filters"], "........")))
    size, partial = rows.agg(F.sum(held.cast("long")), F.max("partial")).first()
    texts = posts.select("slug", "post_id", F.monotonically_increasing_id().alias("place"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    if (size or 0) <= BROADCAST_BYTES:
        met = texts.join(F.broadcast(rows), "slug")
    else:
        spread = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        met = texts.withColumn("salt", F.pmod(F.xxhash64("post_id"), F.lit(SALTS))).join(spread, ["slug", "salt"])
    found = met.select("slug", "post_id", "place", "partial", "targets", F.filter("filters", lambda f: F.contains(F.col("text"), f)).alias("found"))
    asked = F.when(F.size("found") > 0, F.col("targets")) if hits else F.col("targets")
    each = found.select("slug", "post_id", "place", "partial", "found", F.explode(asked).alias("target"))
    answers = each.select("slug", "post_id", "place", F.col("target.target_id").alias("target_id"), "partial", F.arrays_overlap("target.filters", "found").alias("passes"))
    return (answers.where("passes") if hits else answers), bool(partial)


def filter_hits(posts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """slug, post_id, target_id of the posts that any of a target's filters lets pass; an empty filter passes all.

    Hits are compared with each other only where a target's filters are in several rows or a post is in the table more than once.
    """
    answers, partial = _judged(posts, subscriptions, hits=True)
    hits = answers.select("slug", "post_id", "target_id")
    once = posts.groupBy("slug", "post_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return hits if once and not partial else hits.distinct()


def filters_pass(posts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The hits, and every other pair of a post and a target of its slug with `passes` false: as many rows as there are pairs, for who
    asks for them."""
    answers, partial = _judged(posts, subscriptions, hits=False)
    whole = answers.where("not partial").select("slug", "post_id", "target_id", "passes")
    if not partial:
        return whole
    together = answers.where("partial").groupBy("slug", "post_id", "place", "target_id").agg(F.max("passes").alias("passes"))
    return whole.unionByName(together.drop("place"))
