"""Approximate nearest neighbours by an inverted multi-index.

A vector is cut into two halves, and each half is quantised with a codebook of its own, fitted by k-means on a bounded sample. The
pair of codes is the vector's cell, and every vector is in the index. A query scores the codes of each half and walks the pairs of
codes in the order of their summed score with a heap, until the cells it passed hold a number of different vectors; all vectors of
those cells are ranked again by the exact inner product.

The number of codes grows with the square root of the number of vectors, up to a bound, so that a cell holds few. How far queries walk
is measured: for a fixed number of vectors the true nearest ones are found among all, and the walk is as long as it takes to reach the
wanted share of those; the codebooks aren't fitted on these vectors where there are enough. So it is short where vectors lie in clusters, and
long where they fill space evenly. Beyond a million vectors cells grow with them, as the number of codes doesn't any more: what all
tasks and the driver know of the cells is a number for each.

Nearness is the inner product, and so is the score of a half and a code; the sum over both halves orders the cells.

Vectors that are equal have the same score for every query, so the index holds one entry a different vector, and its vec_ids follow by
a join, each with the number of its rows. Lists are cut with room for what is the query's own, however often its id occurs. Cells that share their first code are stored in blocks of bounded size; a query goes to such a
strip once, with the bits of the second codes that it walked to, and each block keeps a query's own best before the merge.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null vec_id or with a
length other than the most frequent one; fewer candidates than asked for are all returned; rows that share a vec_id are candidates each,
and not for a query of the same id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, tidy

NEAREST = 20
#: Bounds of the number of codes of a half, vectors of the sample that codebooks are fitted on (this number, or so many for each code if that
#: is more), k-means steps, vectors on which the length of walks is measured, and queries whose walks are in memory at once: fixed numbers.
CODES = (16, 1024)
SAMPLE, SAMPLE_A_CODE = 20_000, 40
STEPS = 8
PROBES = 128
ASKED = 512
#: Share of the true nearest that walks are to reach.
RECALL = 0.93
#: Vectors of a part of a strip; a task has a part.
PART = 1 << 16
#: Vectors of a block.
BLOCK = 1024


def fit_codebook(half: np.ndarray, codes: int, seed: int) -> np.ndarray:
    """k-means of the sample's half vectors; codes that lose all vectors keep their place."""
    rng = np.random.default_rng(seed)
    different = np.unique(half, axis=0)
    centres = different[rng.permutation(len(different))[:codes]].copy()
    for _ in range(STEPS):
        nearest = nearest_code(different, centres)
        for k in range(len(centres)):
            own = different[nearest == k]
            if len(own):
                centres[k] = own.mean(axis=0)
    return centres


def nearest_code(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * half @ centres.T, axis=1)


def walk_cells(first: np.ndarray, second: np.ndarray, held: np.ndarray, candidates: int, run: int = 1) -> np.ndarray:
    """Cells (i * codes + j) by descending first[i] + second[j], until they hold `candidates` vectors.

    The heap's steps are runs of second codes whose scores are next to each other; a run counts by its best.
    """
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    sums = np.add.reduceat(held[:, b], np.arange(0, len(b), run), axis=1).tolist()
    one, two = first[a].tolist(), second[b][::run].tolist()
    strips = a.tolist()
    heap, out, total = [(-(one[0] + two[0]), 0, 0)], [], 0
    while heap and total < candidates:
        _, i, j = heapq.heappop(heap)
        n = sums[strips[i]][j]
        if n:
            out.append((strips[i], j))
            total += n
        # each run has one way to it: along its strip, or from the strip before to a strip's first run
        if j + 1 < len(two):
            heapq.heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(one):
            heapq.heappush(heap, (-(one[i + 1] + two[0]), i + 1, 0))
    if not out:
        return np.zeros(0, np.int64)
    strip, at = np.array(out, np.int64).T
    place = at[:, None] * run + np.arange(run)
    cells = strip[:, None] * len(b) + b[np.minimum(place, len(b) - 1)]
    return cells[(place < len(b)) & (held.reshape(-1)[cells] > 0)]


def walk_length(first: np.ndarray, second: np.ndarray, held: np.ndarray, cell: np.ndarray, run: int) -> np.ndarray:
    """The vectors that a walk has passed when it reaches each of the cells."""
    b = np.argsort(-second, kind="stable")
    lead = np.empty_like(second)
    lead[b] = np.repeat(second[b][::run], run)[: len(b)]
    score = (first[:, None] + lead[None, :]).reshape(-1)
    order = np.argsort(-score, kind="stable")
    passed = np.cumsum(held.reshape(-1)[order])
    return passed[np.searchsorted(-score[order], -score[cell], side="right") - 1]


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good & F.exists("embedding", lambda x: x != 0))
    common = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).first()
    return rows.where(F.size("embedding") == (common["d"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(embeddings: DataFrame, is_query: str, nearest: int = NEAREST, recall: float = RECALL, least_candidates: int = 400) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the nearest found of every row for which `is_query` (SQL on vec_id) holds.

    A query looks at so many vectors as the wanted recall takes, and at least_candidates at least; a recall of 1 takes all.
    """
    spark = embeddings.sparkSession
    rows = saved(usable(embeddings), "vectors")
    key = F.sha2(F.array_join(F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string")), ","), 256)
    keyed = saved(rows.withColumn("same", key), "vectors")
    different = keyed.groupBy("same").agg(F.min("vec_id").alias("first"), (F.min("vec_id") == F.max("vec_id")).alias("alone"), F.min("embedding").alias("embedding"))
    entries = saved(different.withColumn("entry", F.monotonically_increasing_id()), "entries")
    n_entries = entries.count()
    if not n_entries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    # each vec_id of an entry; no list can use more than `nearest` of its rows
    copies = saved(keyed.join(entries.select("same", "entry"), "same").groupBy("entry", "vec_id").agg(F.least(F.count("*"), F.lit(nearest)).alias("n")), "copies")
    # an id takes part in so many entries; where that is more than `nearest`, only its first `nearest` in a list count
    most_own = copies.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    spread, room = most_own > nearest, nearest + min(most_own, nearest)

    codes = int(np.clip(1 << round(np.log2(n_entries) / 2), *CODES))
    # the sample: the entries with the smallest hashes, a fixed number; the first of them measure walks and fit no codebook, if there are enough
    drawn = entries.orderBy("same").limit(PROBES + max(SAMPLE, SAMPLE_A_CODE * codes)).select("entry", "embedding").toArrow()
    drawn_entries, sample = drawn.column("entry").to_numpy(), _matrix(drawn.column("embedding").combine_chunks())
    fitted = sample[PROBES:] if len(sample) >= 8 * PROBES else sample
    cut = max(1, sample.shape[1] // 2)
    run = max(1, codes // 32)
    books = fit_codebook(fitted[:, :cut], codes, 1), fit_codebook(fitted[:, cut:], codes, 2)
    shared_books = spark.sparkContext.broadcast(books)
    n_second = len(books[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared_books.value
        for batch in batches:
            m = _matrix(batch.column("embedding"))
            cell = nearest_code(m[:, :cut], one) * len(two) + nearest_code(m[:, cut:], two)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("entry", "first", "alone", "embedding")), pa.array(cell.astype(np.int32))], ["entry", "first", "alone", "embedding", "cell"])

    placed = saved(entries.select("entry", "first", "alone", "embedding").mapInArrow(tidy(place), "entry long, first long, alone boolean, embedding array<double>, cell int"), "cells")
    held = np.zeros((len(books[0]), n_second), np.int64)
    cells = placed.groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # codes ** 2 rows at most
    held.reshape(-1)[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    shared_held = spark.sparkContext.broadcast(held)
    n_words = -(-n_second // 64)
    n_parts = np.maximum(1, -(-held.sum(axis=1) // PART))

    def true_nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = probes_of.value
        for batch in batches:
            score = q @ _matrix(batch.column("embedding")).T
            score[ids[:, None] == batch.column("entry").to_numpy()[None, :]] = -np.inf
            few = min(nearest, len(batch))
            best = np.argpartition(-score, few - 1, axis=1)[:, :few]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), few)), pa.array(np.take_along_axis(score, best, axis=1).reshape(-1)), batch.column("cell").take(pa.array(best.reshape(-1)))], ["probe", "score", "cell"])

    wanted = n_entries
    if recall < 1:
        few = min(PROBES, len(sample))
        probes_of = spark.sparkContext.broadcast((drawn_entries[:few], sample[:few]))
        near = placed.select("entry", "embedding", "cell").mapInArrow(tidy(true_nearest), "probe int, score double, cell int")
        rows_of = _first(near.where("score > double('-inf')"), "probe", nearest, F.desc("score"), F.asc("cell")).collect()  # PROBES * nearest rows at most
        steps = []
        for k in range(few):
            cells = np.array([r.cell for r in rows_of if r.probe == k], np.int64)
            steps.append(walk_length(books[0] @ sample[k, :cut], books[1] @ sample[k, cut:], held, cells, run))
        steps = np.sort(np.concatenate(steps))
        wanted = max(least_candidates, int(steps[min(len(steps) - 1, int(np.ceil(recall * len(steps))))]) if len(steps) else 0)

    # queries are asked once for each different vector
    asked = keyed.where(is_query).select("vec_id", "same")
    asked_entries = entries.join(asked.select("same").distinct(), "same", "left_semi").select("entry", "embedding")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared_books.value
        for batch in batches:
            every = _matrix(batch.column("embedding"))
            for start in range(0, len(every), ASKED):
                m, ids = every[start : start + ASKED], batch.column("entry").to_numpy()[start : start + ASKED]
                masks = np.zeros((len(one), len(m), n_words), np.uint64)
                for k, (f, s) in enumerate(zip(m[:, :cut] @ one.T, m[:, cut:] @ two.T, strict=True)):
                    strip, code = np.divmod(walk_cells(f, s, shared_held.value, wanted, run), n_second)
                    np.bitwise_or.at(masks, (strip, k, code // 64), np.uint64(1) << (code % 64).astype(np.uint64))
                for strip in np.flatnonzero(masks.any(axis=(1, 2))):
                    own = np.flatnonzero(masks[strip].any(axis=1))
                    for part in range(n_parts[strip]):
                        yield pa.RecordBatch.from_arrays([pa.array([strip], pa.int32()), pa.array([part], pa.int32()), *(pa.array([x[own].tobytes()], pa.binary()) for x in (ids, m, masks[strip]))], ["strip", "part", "asked", "vectors", "masks"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, cell, ids, firsts, part = _matrix(batch.column("embedding")), *(batch.column(c).to_numpy() for c in ("cell", "entry", "first", "part"))
            alone = batch.column("alone").to_numpy(zero_copy_only=False).astype(bool)
            strip = (cell // n_second).astype(np.int64)
            key = strip << 32 | part
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for k in range(a, b, BLOCK):
                    own = order[k : min(b, k + BLOCK)]
                    yield pa.RecordBatch.from_arrays([pa.array(strip[own[:1]], pa.int32()), pa.array(part[own[:1]], pa.int32()), *(pa.array([x[own].tobytes()], pa.binary()) for x in (ids, firsts, alone, m, (cell % n_second).astype(np.uint16)))], ["strip", "part", "entries", "firsts", "alone", "held", "codes"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked_ids, q, masks, entry_ids, firsts, alone, v, codes in zip(*(batch.column(c).to_pylist() for c in ("asked", "vectors", "masks", "entries", "firsts", "alone", "held", "codes")), strict=True):
                asked_ids, entry_ids, firsts, alone = np.frombuffer(asked_ids, np.int64), np.frombuffer(entry_ids, np.int64), np.frombuffer(firsts, np.int64), np.frombuffer(alone, bool)
                q, v = np.frombuffer(q).reshape(len(asked_ids), -1), np.frombuffer(v).reshape(len(entry_ids), -1)
                codes = np.frombuffer(codes, np.uint16).astype(np.uint64)
                words = np.frombuffer(masks, np.uint64).reshape(len(asked_ids), n_words)[:, (codes // 64).astype(np.int64)]
                walked = (words >> (codes % 64)) & np.uint64(1) == 1
                rough = np.where(walked, q @ v.T, -np.inf)
                top = len(entry_ids) if spread else min(room, len(entry_ids))
                limit = -np.partition(-rough, top - 1, axis=1)[:, top - 1]
                least = np.where(np.isfinite(limit), limit - 1e-9 * (1 + np.abs(limit)), -np.inf)
                i, j = np.nonzero(walked & (rough >= least[:, None]))
                score = (q[i] * v[j]).sum(axis=1)  # the same sum for equal vectors, wherever they are in a block
                order = np.lexsort((entry_ids[j], firsts[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                if spread:
                    by_id = np.lexsort((np.arange(len(i)), firsts[j], i))
                    new = np.flatnonzero((np.diff(i[by_id], prepend=-1) != 0) | (np.diff(firsts[j][by_id], prepend=0) != 0) | (np.arange(len(i)) == 0))
                    # of an id's own entries the first ones; entries that it shares with others are not counted out
                    counted = np.cumsum(alone[j][by_id]) - alone[j][by_id]
                    place = counted - np.repeat(counted[new], np.diff(np.append(new, len(i))))
                    keep = np.ones(len(i), bool)
                    keep[by_id] = ~alone[j][by_id] | (place < nearest)
                    i, j, score = i[keep], j[keep], score[keep]
                best = np.arange(len(i)) - np.searchsorted(i, i) < room
                yield pa.RecordBatch.from_arrays([pa.array(asked_ids[i[best]]), *(pa.array(x[j[best]]) for x in (entry_ids, firsts, alone)), pa.array(score[best])], ["asked", "entry", "first", "alone", "score"])

    probes = asked_entries.select("entry", "embedding").mapInArrow(tidy(walk), "strip int, part int, asked binary, vectors binary, masks binary")
    part_of = F.pmod("entry", F.element_at(F.array(*(F.lit(int(k)) for k in n_parts)), (F.col("cell") / n_second).cast("int") + 1)).cast("int")
    blocks = placed.withColumn("part", part_of).repartition((F.col("cell") / n_second).cast("int"), "part").mapInArrow(tidy(block), "strip int, part int, entries binary, firsts binary, alone binary, held binary, codes binary")
    found = probes.join(blocks, ["strip", "part"]).select("asked", "vectors", "masks", "entries", "firsts", "alone", "held", "codes").mapInArrow(tidy(rank), "asked long, entry long, first long, alone boolean, score double")

    if spread:
        own = F.row_number().over(Window.partitionBy("asked", "first", "alone").orderBy(F.desc("score"), "entry"))
        found = found.withColumn("own", own).where(~F.col("alone") | (F.col("own") <= nearest))
    best = saved(_first(found, "asked", room, F.desc("score"), F.asc("first"), F.asc("entry")), "best")
    # of an entry's ids the nearest + 1 smallest are all that one query can use
    few = saved(_first(copies, "entry", nearest + 1, F.asc("vec_id")).drop("place"), "few")
    listed = best.select("asked", "entry", "score").join(few, "entry")
    if spread:
        own = F.row_number().over(Window.partitionBy("asked", "vec_id").orderBy(F.desc("score"), "entry"))
        listed = listed.withColumn("own", own).where(F.col("own") <= nearest)
    shortlist = saved(_first(listed, "asked", room, F.desc("score"), F.asc("vec_id")), "shortlist")
    # per query: the list of its vector without its own id
    queries = asked.join(entries.select("same", F.col("entry").alias("asked")), "same").select(F.col("vec_id").alias("query_id"), "asked").distinct()
    answer = queries.join(shortlist.select("asked", "vec_id", "score", "n"), "asked").where("vec_id <> query_id")
    answer = answer.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    answer = _first(answer, "query_id", nearest, F.desc("score"), F.asc("vec_id"))
    return answer.select("query_id", F.col("place").cast("int").alias("rank"), "vec_id", "score")


def _first(rows: DataFrame, key: str, n: int, *order) -> DataFrame:
    """The first n rows of each key with their place. Spark cuts each task's rows to n a key before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)
