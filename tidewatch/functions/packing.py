"""Greedy packing of lines into messages of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import saved

#: Lines and characters of a run at most, unless a single line is longer.
RUN_LINES = 4096
RUN_CHARS = 2 << 20


def entry(title: Column, date: Column, url: Column, summary: Column) -> Column:
    """One digest entry; parts that are null are left out."""
    return F.concat_ws("\n", F.concat_ws(" ", F.concat(F.lit("- "), title), F.concat(F.lit("("), date, F.lit(")"))), url, summary)


def pieces(line: str, most: int) -> list[str]:
    """The line in parts of at most `most` characters."""
    return [line[k : k + most] for k in range(0, len(line), most)] or [""]


def moves(lines: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length that a run may find its open chunk at (0 to most): the chunks it begins, and the length it leaves the last one at."""
    at, begun = np.arange(most + 1), np.zeros(most + 1, np.int64)
    for line in lines:
        for k in range(0, max(len(line), 1), most):
            size = min(len(line) - k, most)
            over = at + 1 + size > most
            begun += over
            at = np.where(over, size, at + 1 + size)
    return begun, at


def packed(rows: DataFrame, key: str, order: list[str], header: Column, most: int = 1850) -> DataFrame:
    """key, chunk (from 1), text: a key's lines in order, put into as few chunks as going through them once allows.

    The first chunk begins with the header of the key's first line. A line longer than a chunk begins a new one and goes on in the
    chunks that follow; nothing is cut. Null lines add nothing.

    Lines are dealt out by ranges of key and order, so a key of very many lines lies in many tasks. Each task cuts its lines into runs.
    A run knows what it does to an open chunk of any length, so a key's runs are stitched without their texts; then each is packed from
    where the one before it ends, and a chunk that lies in several runs is joined.
    """
    kind, name = rows.schema[key].dataType, "_key"
    lines = rows.select(F.col(key).alias(name), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), F.col("line").cast("string").alias("line"), header.cast("string").alias("header"))
    by = [name, *(f"_o{k}" for k in range(len(order))), "line"]
    ordered = lines.repartitionByRange(*by).sortWithinPartitions(*by).select(name, "line", "header")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, own, head, held, size, whole, none = TaskContext.get().partitionId(), 0, None, None, [], 0, False, True

        def run(whole: bool) -> pa.RecordBatch:
            moved = None if whole else zlib.compress(np.concatenate(moves(held, most)).astype("<i8").tobytes())
            values = (([own], own_type), ([task], pa.int32()), ([seq], pa.int64()), ([head], pa.string()), ([held], pa.list_(pa.string())), ([whole], pa.bool_()), ([moved], pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in values], [name, "task", "seq", "header", "lines", "whole", "moved"])

        for batch in batches:
            own_type = batch.schema.field(name).type
            for k, line, h in zip(*(batch.column(c).to_pylist() for c in (name, "line", "header")), strict=True):
                # a key is whole if the task holds lines of other keys before and behind it, and all its lines are in one run
                if none or k != own:
                    if not none:
                        yield run(whole)
                        seq += 1
                    own, head, held, size, whole, none = k, h, [], 0, not none, False
                elif len(held) >= RUN_LINES or size >= RUN_CHARS:
                    yield run(False)
                    seq += 1
                    head, held, size, whole = h, [], 0, False
                if line is not None:
                    held.append(line)
                    size += len(line)
        if not none:
            yield run(False)

    run_type = T.StructType([T.StructField(name, kind), *T.StructType.fromDDL("task int, seq long, header string, lines array<string>, whole boolean, moved binary")])
    runs = saved(ordered.mapInArrow(cut, run_type), "packing")

    def stitch(table: pa.Table) -> pa.Table:
        out, length, chunk = [], None, 1
        for r in table.sort_by([("task", "ascending"), ("seq", "ascending")]).select(["task", "seq", "header", "moved"]).to_pylist():
            first = length is None
            if first:
                length = min(len(r["header"] or ""), most)
            out.append((r["task"], r["seq"], length, chunk, first))
            begun, left = np.frombuffer(zlib.decompress(r["moved"]), "<i8").reshape(2, -1)
            chunk, length = chunk + int(begun[length]), int(left[length])
        kinds = {"t": pa.int32(), "s": pa.int64(), "open": pa.int32(), "chunk": pa.int64(), "first": pa.bool_()}
        return pa.table({c: pa.array([x[k] for x in out], t) for k, (c, t) in enumerate(kinds.items())})

    parts = runs.where("not whole")
    entered = parts.select(name, "task", "seq", "header", "moved").groupBy(name).applyInArrow(stitch, "t int, s long, open int, chunk long, first boolean")
    split = parts.join(entered, (F.col("task") == F.col("t")) & (F.col("seq") == F.col("s")))
    size = F.least(F.length(F.coalesce("header", F.lit(""))), F.lit(most))
    alone = runs.where("whole").select(name, "task", "seq", "header", "lines", size.alias("open"), F.lit(1).cast("long").alias("chunk"), F.lit(True).alias("first"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (task, seq, head, held, length, chunk, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("task", "seq", "header", "lines", "open", "chunk", "first")), strict=True)):
                texts = [[head or ""]] if first else [[]]
                for piece in (p for line in held for p in pieces(line, most)):
                    if length + 1 + len(piece) > most:
                        texts.append([piece])
                        length = len(piece)
                    else:
                        texts[-1].append(piece)
                        length += 1 + len(piece)
                found = [(chunk + k, "\n".join(t)) for k, t in enumerate(texts) if t]
                values = (([task] * len(found), pa.int32()), ([seq] * len(found), pa.int64()), ([c for c, _ in found], pa.int64()), ([t for _, t in found], pa.string()))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(name)[i : i + 1]] * len(found)) if found else batch.column(name)[:0], *(pa.array(v, t) for v, t in values)], [name, "task", "seq", "chunk", "text"])

    chunk_type = T.StructType([T.StructField(name, kind), *T.StructType.fromDDL("task int, seq long, chunk long, text string")])
    columns = [name, "task", "seq", "header", "lines", "open", "chunk", "first"]
    joined = split.select(*columns).mapInArrow(pack, chunk_type).groupBy(name, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("task", "seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    every = joined.unionByName(alone.select(*columns).mapInArrow(pack, chunk_type).select(name, "chunk", "text"))
    return every.select(F.col(name).alias(key), F.col("chunk").cast("int").alias("chunk"), "text")
