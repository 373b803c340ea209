"""Session settings that every plan here expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session with the settings above; on a cluster, the master and memory come from spark-submit."""
    builder = SparkSession.builder.appName("tidewatch")
    settings = SETTINGS | ({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}) | more
    for key, value in settings.items():
        builder = builder.config(key, value)
    return (builder.master(master) if master else builder).getOrCreate()
