"""Token counts from flat token files that have no index.

A flat file is nothing but ids, each document closed by the end id, cut into blocks of equal length wherever that falls. A scan of a
block is vectorised: it finds the end ids and so the lengths of the documents that lie inside. A document that crosses blocks is
put together by a prefix scan over the blocks' summaries (ids so far, documents so far, last end so far), of which there is one
row a block.

Defined cases: a null text counts as empty and has no tokens; null and repeated doc_ids each keep their row; an empty table gives
no rows; columns other than doc_id and text are ignored. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LARGE_ROWS, saved, slices, tidy, with_columns

BLOCK_IDS = 1 << 18

_encodings: dict[str, object] = {}


def encoding(path: str, pattern: str):
    """A tiktoken encoding read from a file of ranks, one for each worker process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def write_flat(documents: DataFrame, ranks_path: str, pattern: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """shard, block, ids (uint32 little-endian) of the files, and in rows of their own (ids null) the order of the documents."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, tool, number, ordinal = TaskContext.get().partitionId(), encoding(ranks_path, pattern), 0, 0
        waiting, size = [], 0

        def row(block: int | None, ids: np.ndarray | None, first: int | None, names: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([None if ids is None else ids.tobytes()], pa.binary()), pa.array([first], pa.int64()), pa.array([names], pa.list_(pa.int64()))],
                ["shard", "block", "ids", "ordinal", "doc_ids"],
            )

        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    ids = np.append(tool.encode_to_numpy(text or "", disallowed_special=()), np.uint32(end_id)).astype("<u4")
                    waiting.append(ids)
                    size += len(ids)
                    if size >= block_ids:
                        joined = np.concatenate(waiting)
                        while len(joined) >= block_ids:
                            yield row(number, joined[:block_ids], None, None)
                            joined, number = joined[block_ids:], number + 1
                        waiting, size = [joined], len(joined)
                yield row(None, None, ordinal, part.column("doc_id").to_pylist())
                ordinal += len(part)
        if size:
            yield row(number, np.concatenate(waiting), None, None)

    docs = with_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return saved(docs.mapInArrow(tidy(blocks), "shard int, block long, ids binary, ordinal long, doc_ids array<long>"), "flat-tokens", **LARGE_ROWS)


def count_tokens(file: DataFrame, end_id: int) -> DataFrame:
    """shard, ordinal and n_tokens (without the end id) of every document of the files, by their ids alone."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "ids")), strict=True):
                ids = np.frombuffer(raw, "<u4")
                ends = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([ends.astype(np.int32)], pa.list_(pa.int32()))],
                    ["shard", "block", "n", "n_ends", "ends"],
                )

    found = file.where(F.col("ids").isNotNull()).select("shard", "block", "ids").mapInArrow(tidy(scan), "shard int, block long, n long, n_ends long, ends array<int>")
    order = Window.partitionBy("shard").orderBy("block")
    sums = found.withColumn("origin", F.sum("n").over(order) - F.col("n")).withColumn("before", F.sum("n_ends").over(order) - F.col("n_ends"))
    last = F.max(F.when(F.col("n_ends") > 0, F.col("origin") + F.element_at("ends", -1) + 1)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("opened", F.coalesce(last, F.lit(0)))
    each = sums.where("n_ends > 0").select("shard", "before", "origin", "opened", "ends", F.posexplode("ends").alias("k", "end"))
    begin = F.when(F.col("k") == 0, F.col("opened")).otherwise(F.col("origin") + F.expr("ends[k - 1]") + 1)
    return each.select("shard", (F.col("before") + F.col("k")).alias("ordinal"), (F.col("origin") + F.col("end") - begin).alias("n_tokens"))


def token_counts(documents: DataFrame, ranks_path: str, pattern: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id and n_tokens, counted in the flat files written from the documents."""
    file = write_flat(documents, ranks_path, pattern, end_id, block_ids)
    names = file.where(F.col("ids").isNull()).select("shard", "ordinal", F.posexplode("doc_ids").alias("k", "doc_id"))
    names = names.select("shard", (F.col("ordinal") + F.col("k")).alias("ordinal"), "doc_id")
    return names.join(count_tokens(file, end_id), ["shard", "ordinal"]).select("doc_id", "n_tokens")
