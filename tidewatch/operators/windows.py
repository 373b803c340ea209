"""Ordered computations within a key: streaks, changes, counters, pages, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scratch import new_path, saved


def failure_streak(jobs: DataFrame, key: str = "slug", most: int = 20) -> DataFrame:
    """Failures since the last success, over the newest `most` ended jobs of each key.

    Spark keeps only the newest rows of each key before the shuffle, as the rank is filtered.
    """
    ended = jobs.where("status in ('done', 'failed')").where(F.col(key).isNotNull()).select(key, "id", "status")
    newest = ended.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("id")))).where(F.col("rn") <= most)
    stop = F.coalesce(F.min(F.when(F.col("status") == "done", F.col("rn"))), F.count("*") + 1)
    return newest.groupBy(key).agg((stop - 1).cast("long").alias("streak"))


def changed_since_before(rows: DataFrame, key: str, value: str) -> DataFrame:
    """id, previous value of the key by (ts, id), and whether the value is new; the first row of a key is no change."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy("ts", "id"))
    return rows.withColumn("previous", before).select("id", key, "previous", F.coalesce(F.col(value) != F.col("previous"), F.lit(False)).alias("changed"))


def counter(rows: DataFrame, key: str, bad: Column, good: Column) -> DataFrame:
    """Running count of bad rows that a good one sets to 0; rows that are neither leave it as it is."""
    order = Window.partitionBy(key).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    island = rows.withColumn("bad", F.coalesce(bad, F.lit(False)).cast("long")).withColumn("island", F.count_if(good).over(order))
    inside = Window.partitionBy(key, "island").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return island.select("id", key, F.sum("bad").over(inside).alias("streak"))


def first_per_key(rows: DataFrame, key: str, *order: Column, columns: tuple[str, ...]) -> DataFrame:
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_n = 1").select(key, *columns)


def recent_cap(seen: DataFrame, key: str, most: int, protected: Column) -> DataFrame:
    """The newest `most` rows of each key; protected rows come first, so they are never cut while they fit."""
    order = Window.partitionBy(key).orderBy(F.desc(protected.cast("int")), F.desc("ts"), F.desc("id"))
    return seen.withColumn("_n", F.row_number().over(order)).where((F.col("_n") <= most) | protected).drop("_n")


def page(rows: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """A page and whether another follows, found by one row more."""
    one_more = rows.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = one_more.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("_all", F.count("*").over(Window.partitionBy()))
    return numbered.where(F.col("_n") <= limit).withColumn("has_next", F.col("_all") > limit).drop("_n", "_all")


def queue_position(jobs: DataFrame) -> DataFrame:
    """Pending jobs with the number of pending ones before them by (priority, id).

    The queue is dealt out in ranges of (priority, id); a job's place is its place in its range after the lengths of the ranges before,
    of which there is a row each. So no task holds the whole queue, nor all of one priority.
    """
    # written, as the lengths and the places must come from the same ranges
    ranges = saved(jobs.where("status = 'pending'").select("id", "priority").repartitionByRange("priority", "id").withColumn("part", F.spark_partition_id()), "queue")
    counts = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("priority", "id")) - 1
    return ranges.withColumn("inner", rank).join(before, "part").select("id", "priority", (F.col("before") + F.col("inner")).alias("position"))


#: Bytes of spans that a task of a join is to hold, and those of a level up to which it is broadcast. Spans are counted for it, as Spark's
#: own estimate goes by the bytes of packed files, in which a number of 8 bytes may take a bit.
TASK_BYTES = 32 << 20
BROADCAST_BYTES = 4 << 20
SPAN_BYTES = 48
#: Tasks up to which Spark is left to put partitions together, which it does by their packed bytes.
FEW_TASKS = 8


def span_tree(spans: DataFrame) -> DataFrame:
    """Depth and path of every span below its root; a span whose parent is missing is a root. Spans that hang on a circle of parents are
    below none: their depth and path are null.

    One join for each level, only with the spans that the last one reached; stops when none is left. Levels are written to the shared
    folder, so a deep tree has no long plan. Joins have as many tasks as their spans and paths need, so that none holds more of a larger table.
    """
    spark = spans.sparkSession
    folder = new_path(spark, "spans")
    size = SPAN_BYTES * spans.count()

    def met(rows: DataFrame, key: str, others: DataFrame, held: int, how: str) -> DataFrame:
        """rows joined with others (t, s) by trace and key."""
        n = 1 + (size + held) // TASK_BYTES
        if how == "inner" and held <= BROADCAST_BYTES:
            others = F.broadcast(others)
        elif n > FEW_TASKS:
            rows, others = rows.repartition(n, "trace_id", key), others.repartition(n, "t", "s").hint("merge")
        else:
            others = others.hint("merge")
        return rows.join(others, (F.col("trace_id") == F.col("t")) & (F.col(key) == F.col("s")), how)

    ids = spans.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"))
    text = F.lpad(F.col("span_id").cast("string"), 12, "0")
    roots = met(spans.select("trace_id", "span_id", "parent_id"), "parent_id", ids, size, "left").where("s is null")  # an anti join would go below the repartition
    level = roots.select("trace_id", "span_id", F.lit(0).alias("depth"), text.alias("path"))
    children = spans.select("trace_id", F.col("span_id").alias("child"), "parent_id").where("parent_id is not null")
    k = 0
    while True:
        path = f"{folder}/level={k}"
        level.write.option("compression", "zstd").parquet(path)
        level = spark.read.schema(level.schema).parquet(path)
        reached_now = level.count()
        if not reached_now:
            reached = spark.read.schema(level.schema).parquet(f"{folder}/level=*")
            found = reached.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"))
            lost = met(spans.select("trace_id", "span_id"), "span_id", found, size, "left").where("s is null").drop("t", "s")
            return reached.unionByName(lost, allowMissingColumns=True)
        k += 1
        up = level.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"), F.col("path").alias("above"))
        level = met(children, "parent_id", up, reached_now * (SPAN_BYTES + 13 * k), "inner")
        level = level.select("trace_id", F.col("child").alias("span_id"), F.lit(k).alias("depth"), F.concat_ws("/", "above", F.lpad(F.col("child").cast("string"), 12, "0")).alias("path"))


def scaled_spans(spans: DataFrame, width: int = 1000) -> DataFrame:
    """Left edge and width of each span on a line as wide as its trace."""
    w = Window.partitionBy("trace_id")
    a, b = F.min("t0").over(w), F.max("t1").over(w)
    span = F.greatest(b - a, F.lit(1))
    return spans.withColumn("a", a).withColumn("span", span).select("trace_id", "span_id", F.floor((F.col("t0") - F.col("a")) * width / F.col("span")).cast("long").alias("x"), F.floor((F.col("t1") - F.col("t0")) * width / F.col("span")).cast("long").alias("w"))


def top_per_key(rows: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)


def flagged_first(rows: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """All rows, with `within` true for the first k of each key."""
    return rows.withColumn("within", F.row_number().over(Window.partitionBy(key).orderBy(*order)) <= k)


def stale_keys(rows: DataFrame, key: str, now: Column, days: int) -> DataFrame:
    """Keys whose newest row is older than so many days."""
    return rows.groupBy(key).agg(F.max("ts").alias("last_ts")).where(F.col("last_ts") < now - F.expr(f"interval {int(days)} days"))
