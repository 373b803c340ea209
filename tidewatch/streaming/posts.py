"""New posts, breakage and delivery as streams. A batch of rows may come again after a failure; all writes are keyed to survive that."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEEN_CAP = 5000
REPROBE_AT, BROKEN_AT = 2, 3

NEW_SCHEMA = "slug string, post_id string"
ACTION_SCHEMA = "slug string, streak int, action string"
DRIFT_AT, DRIFT_SCHEMA = 3, "slug string, ts timestamp, streak int"
DELIVERY_SCHEMA = "target_id string, day date, ts timestamp"


def new_posts(posts: DataFrame, cap: int = SEEN_CAP) -> DataFrame:
    """slug and post_id of posts that a slug hasn't shown before.

    State is the list of a slug's ids, oldest first. Above the cap the oldest go, but never those of the batch at hand. Rows marked
    `baseline` become known and are not returned.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        known, fresh, current = set(seen), [], {}
        for rows in batches:
            for post_id, baseline in zip(rows["post_id"], rows["baseline"], strict=True):
                current[post_id] = None
                if post_id not in known:
                    known.add(post_id)
                    if not baseline:
                        fresh.append(post_id)
        old = [x for x in seen if x not in current]
        kept = old[max(0, len(old) + len(current) - cap) :] if cap else old
        state.update((kept + list(current),))
        yield pd.DataFrame({"slug": [key[0]] * len(fresh), "post_id": fresh})

    rows = posts.select("slug", "post_id", F.coalesce("baseline", F.lit(False)).alias("baseline") if "baseline" in posts.columns else F.lit(False).alias("baseline"))
    rows = rows.where("post_id is not null and trim(post_id) <> ''")
    return rows.groupBy("slug").applyInPandasWithState(step, NEW_SCHEMA, "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def breakage(polls: DataFrame) -> DataFrame:
    """slug, streak and action for each poll result (slug, ts, broken): `reprobe` at the second failure in a row, `broken` from the
    third, `clear` when a success ends a streak that had come to an action."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        out = []
        for broken in pd.concat(list(batches)).sort_values("ts", kind="stable")["broken"]:
            if broken:
                streak += 1
                if streak >= REPROBE_AT:
                    out.append((key[0], streak, "reprobe" if streak == REPROBE_AT else "broken"))
            else:
                if streak >= REPROBE_AT:
                    out.append((key[0], 0, "clear"))
                streak = 0
        state.update((streak,))
        yield pd.DataFrame(out, columns=["slug", "streak", "action"]).astype({"streak": "int32"})

    return polls.select("slug", "ts", "broken").groupBy("slug").applyInPandasWithState(step, ACTION_SCHEMA, "streak int", "append", GroupStateTimeout.NoTimeout)


def body_drift(polls: DataFrame) -> DataFrame:
    """slug, ts, streak for each poll (slug, ts, body_fetched, body_empty) from the third in a row on whose fetched bodies were all
    empty. A poll that fetched none changes nothing, one that got a body ends the streak; polls that come late count when they come."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        out = []
        for row in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples():
            if row.body_fetched > 0:
                streak = streak + 1 if row.body_empty == row.body_fetched else 0
                if streak >= DRIFT_AT:
                    out.append((key[0], row.ts, streak))
        state.update((streak,))
        yield pd.DataFrame({"slug": [x[0] for x in out], "ts": pd.to_datetime([x[1] for x in out]), "streak": pd.array([x[2] for x in out], "int32")})

    whole = F.coalesce("body_fetched", F.lit(0)).alias("body_fetched"), F.coalesce("body_empty", F.lit(0)).alias("body_empty")
    return polls.select("slug", F.col("ts").cast("timestamp").alias("ts"), *whole).groupBy("slug").applyInPandasWithState(step, DRIFT_SCHEMA, "streak int", "append", GroupStateTimeout.NoTimeout)


def deliveries(ticks: DataFrame, hours_east: int = 9, forget_days: int = 35, watermark: str = "2 days") -> DataFrame:
    """target_id, day, ts: for each target and calendar day east of UTC the first tick (target_id, ts, deliver_at 'HH:MM') at or after
    its time of delivery; a target whose time was missed is served by the day's next tick.

    State is a target's last day, which later ticks of that day or of earlier ones, late or come again after a restart, don't pass.
    It is forgotten, by a timer on event time, when a target has had no tick for `forget_days`."""
    east = pd.Timedelta(hours=hours_east)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, latest = state.get if state.exists else ("", 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples():
            local = row.ts + east
            day = local.strftime("%Y-%m-%d")
            if day > last and row.deliver_at <= local.strftime("%H:%M"):
                out.append((key[0], local.date(), row.ts))
                last = day
            latest = max(latest, int(row.ts.timestamp() * 1000))
        state.update((last, latest))
        # a timer lies beyond the watermark, or the engine doesn't take it
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1) + forget_days * 86_400_000)
        yield pd.DataFrame({"target_id": [x[0] for x in out], "day": pd.Series([x[1] for x in out], dtype="object"), "ts": pd.to_datetime([x[2] for x in out])})

    rows = ticks.select("target_id", F.col("ts").cast("timestamp").alias("ts"), "deliver_at").where("target_id is not null and ts is not null and deliver_at is not null")
    return rows.withWatermark("ts", watermark).groupBy("target_id").applyInPandasWithState(step, DELIVERY_SCHEMA, "day string, latest long", "append", GroupStateTimeout.EventTimeTimeout)


def append_verified(store: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: adds rows with new keys in a folder of the batch's own, so that a repeated batch replaces itself, then
    counts that every key is there; a batch that isn't whole fails and comes again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        stored = _stored(spark, store)
        if stored is not None:
            rows = rows.join(stored.where(F.col("batch") != batch_id).select(*keys), keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        there = _stored(spark, store).select(*keys)
        missing = batch.select(*keys).distinct().join(there, keys, "left_anti").count()
        if missing:
            raise RuntimeError(f"{missing} rows of batch {batch_id} are missing from {store}")

    return write


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.parquet(store)
    except AnalysisException:  # nothing has been written yet
        return None


def once_a_day(ticks: DataFrame, target: str, ts: Column, watermark: str = "2 days") -> DataFrame:
    """The first tick of each target and calendar day (UTC+9)."""
    day = F.to_date(ts + F.expr("interval 9 hours"))
    return ticks.withColumn("event_time", ts).withWatermark("event_time", watermark).withColumn("day", day).dropDuplicatesWithinWatermark([target, "day"])


def site_timeout(base: int, n_posts: Column, sleep: float) -> Column:
    """Seconds that a site's poll may take."""
    return F.greatest(F.lit(float(base)), (n_posts - 1) * sleep + 8 * n_posts + 30)


def would_skip(previous: Column, current: Column) -> Column:
    """Whether a sitemap's date says that nothing has changed."""
    return F.coalesce(previous == current, F.lit(False))
