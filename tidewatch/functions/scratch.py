"""Scratch tables in the folder that the whole cluster shares, and what worker processes give back."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Folders written by this driver, the oldest first.
_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session (tests, notebooks) may leave it unset, and gets a new local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder for a scratch table."""
    _made.append(f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


#: For tables with rows of a megabyte. A writer holds a whole row group, and a reader decodes up to 4,096 rows of one at once, so that
#: without this limit the memory of both grows with the rows of a task.
LARGE_ROWS = {"parquet.block.row.count.limit": "16"}


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and returns the written table: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """How many folders there are; those of before a mark can be left alone."""
    return len(_made)


def clear_scratch(spark: SparkSession, keep: int = 0, since: int = 0) -> None:
    """Removes what has been written since a mark, but for the newest `keep` folders. Results that aren't written yet still read their
    scratch tables, so this is for whoever has written them."""
    for path in _made[since : len(_made) - keep]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _made.remove(path)


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Returns freed memory to the system: worker processes are used again and again, and would keep the most that any task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The function for mapInArrow, after whose last batch a worker gives back what it has freed."""

    @wraps(work)
    def run(batches: Batches) -> Batches:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run
