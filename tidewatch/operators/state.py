"""State changes as set operations: inserts, upserts, queue steps, reaping and retention.

Spark tables have no row updates here: each function returns the new state or the rows to append. Writers publish it by an append or by
replacing the table (sources.tables.publish).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIORITY_BATCH, PRIORITY_RETRY = 5, 4


def insert_ignore(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Rows to append: the first of each new key that the store lacks."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    return first.join(stored.select(*keys), list(keys), "left_anti")


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The store with the new rows in place of those that have their keys. New keys are unique."""
    return stored.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def finish(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Running jobs with a result become done (ok), rejected (rc 2, 3 or 4) or failed; all others stay, however often this runs."""
    r = results.select(F.col("id").alias("_id"), "ok", F.col("rc").alias("_rc"), F.col("tail").alias("_tail"))
    rows = jobs.join(r, F.col("id") == F.col("_id"), "left")
    now = F.col("_id").isNotNull() & (F.col("status") == "running")
    return rows.select(
        "id",
        F.when(now, final_status(F.col("ok"), F.col("_rc"))).otherwise(F.col("status")).alias("status"),
        F.when(now, F.col("_rc")).otherwise(F.col("result_rc")).alias("result_rc"),
        F.when(now, F.right("_tail", F.lit(4000))).otherwise(F.col("result_tail")).alias("result_tail"),
    )


def final_status(ok: Column, rc: Column) -> Column:
    return F.when(ok, F.lit("done")).when(rc.isin(2, 3, 4), F.lit("rejected")).otherwise(F.lit("failed"))


def priority(kind: Column, via: Column) -> Column:
    """0 for what a user waits for, up to 5 for bulk."""
    return (
        F.when(via == "batch", F.lit(PRIORITY_BATCH))
        .when(via == "batch-retry", F.lit(PRIORITY_RETRY))
        .when(kind == "deliver_target", F.lit(2))
        .when(kind == "poll_site", F.lit(3))
        .when(kind == "reprobe", F.lit(1))
        .otherwise(F.lit(0))
    )


def enqueue(active: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests to add: by dedupe key where there is one, else by (kind, slug), unless an active job has it; of equals the first id."""
    key = F.coalesce(F.concat(F.lit("k:"), "dedupe_key"), F.concat(F.lit("s:"), "kind", F.lit(":"), F.coalesce("slug", F.lit(""))))
    taken = active.where("status in ('pending', 'running')").select(key.alias("key")).distinct()
    first = requests.withColumn("key", key).groupBy("key").agg(F.min("id").alias("id"))
    return first.join(taken, "key", "left_anti").select("id", "key")


def next_jobs(jobs: DataFrame, now: Column, most_priority: int, n: int = 1) -> DataFrame:
    """The jobs that workers take next: pending, not deferred, slug not running, by (priority, id)."""
    busy = jobs.where("status = 'running' and slug is not null").select("slug").distinct()
    open_ = jobs.where("status = 'pending'").where(F.col("priority") <= most_priority).where(F.col("requeue_at").isNull() | (F.col("requeue_at") <= now))
    return open_.join(busy, "slug", "left_anti").orderBy("priority", "id").limit(n).select("id", "kind", "slug", "priority")


def reset_running(jobs: DataFrame) -> DataFrame:
    """Jobs that a lost worker left running are pending again, with one more attempt."""
    lost = F.col("status") == "running"
    return jobs.select("id", F.when(lost, F.lit("pending")).otherwise(F.col("status")).alias("status"), (F.col("attempts") + lost.cast("int")).alias("attempts"))


def retained(rows: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows not older than so many days; 0 or less keeps all."""
    return rows if days <= 0 else rows.where(F.col(ts) >= now - F.expr(f"interval {int(days)} days"))


def reap_stale(runs: DataFrame, site_runs: DataFrame, now: Column, minutes: int) -> tuple[DataFrame, DataFrame]:
    """Runs that began too long ago and never ended become crashed; each gets one child that counts the missing sites."""
    stale = runs.where((F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"interval {int(minutes)} minutes")))
    seen = site_runs.groupBy("run_id").agg(F.count("*").alias("n_seen"))
    made = stale.join(seen, "run_id", "left").select("run_id", F.lit("_missing").alias("slug"), F.lit("crashed").alias("status"), F.greatest(F.col("n_sites") - F.coalesce("n_seen", F.lit(0)), F.lit(0)).cast("long").alias("n_missing"))
    dead = stale.select(F.col("run_id").alias("_dead"))
    after = runs.join(dead, F.col("run_id") == F.col("_dead"), "left")
    return after.select("run_id", F.when(F.col("_dead").isNotNull(), F.lit("crashed")).otherwise(F.col("status")).alias("status")), made


def finalised(runs: DataFrame, site_runs: DataFrame) -> DataFrame:
    """run_id and status: a run whose sites are all queued is done once each of them has ended and none is missing."""
    seen = site_runs.groupBy("run_id").agg(F.count("*").alias("n_seen"), F.count_if(F.col("status") == "running").alias("n_open"))
    rows = runs.join(seen, "run_id", "left")
    over = (F.col("status") == "enqueue_done") & (F.coalesce("n_seen", F.lit(0)) >= F.col("n_sites")) & (F.coalesce("n_open", F.lit(0)) == 0)
    return rows.select("run_id", F.when(over, "done").otherwise(F.col("status")).alias("status"))


def delivery_blocked(runs: DataFrame, site_runs: DataFrame) -> DataFrame:
    """Days on which a run is still running, or has queued sites that haven't ended."""
    unfinished = site_runs.where("status = 'running'").select("run_id").distinct().withColumn("unfinished", F.lit(True))
    rows = runs.join(unfinished, "run_id", "left")
    blocks = (F.col("status") == "running") | ((F.col("status") == "enqueue_done") & F.coalesce("unfinished", F.lit(False)))
    return rows.groupBy("day").agg(F.bool_or(blocks).alias("blocked"))


def due_targets(users: DataFrame, channels: DataFrame, clock: str, today: str) -> DataFrame:
    """Targets whose time of day has come and who haven't been served today."""
    every = users.select("target_id", "deliver_at", "last_date").withColumn("kind", F.lit("dm")).unionByName(channels.select("target_id", "deliver_at", "last_date").withColumn("kind", F.lit("channel")))
    at = F.coalesce("deliver_at", F.lit("08:30"))
    return every.where((at <= clock) & (F.col("last_date").isNull() | (F.col("last_date") < today))).select("kind", "target_id")


def fill_missing(cache: DataFrame, posts: DataFrame, most: int = 400) -> DataFrame:
    """Summaries: the cached one, else an excerpt; a body under 30 characters is its own summary, or the title where it is empty."""
    body = F.trim("text")
    made = F.when(F.length(body) < 30, F.when(body != "", body).otherwise(F.col("title"))).otherwise(F.substring(body, 1, most))
    return posts.join(cache.select("slug", "post_id", "summary"), ["slug", "post_id"], "left").select("slug", "post_id", F.coalesce("summary", made).alias("summary"), F.col("summary").isNull().alias("computed"))
