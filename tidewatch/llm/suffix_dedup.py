"""Removal of long byte strings that an earlier document also has, by a hash-compared suffix sort.

A byte goes when a string of `length` bytes covers it that also starts in a document with a smaller doc_id. The work is dealt out by
content:

0. Equal texts enter once, with their smallest doc_id: a row whose whole text an earlier document has (by its SHA-256 sum) loses all of
   it. Of the removals that are left, every one is decided by the sort or by a merge of equal surroundings of one anchor before it.
1. Documents are packed into batches (rows of a table), so that later passes find them again without a shuffle of texts.
2. Each string of `length` bytes has an anchor: of its substrings of `ANCHOR` bytes, the one with the smallest hash, the first of
   equals. Equal strings have equal anchors at the same place within them. Anchors go to buckets by hash, whose number grows with the
   bytes of all texts; a bucket tells each batch which of its anchors occur in more than one place.
3. For those, batches send the anchor's surroundings: all the strings whose anchor it is. Within a batch, equal surroundings are
   sent once with their smallest doc_id and the places where they stand.
4. A bucket makes equal surroundings one, and where an anchor has several it sorts the suffixes of their strings. Prefix polynomial hashes give the hash of any substring; binary search over them gives
   the common extension of two suffixes, so a comparison takes a logarithmic number of steps, and the suffixes are merge-sorted with
   it. Neighbours whose common extension reaches `length` are compared byte by byte before they count as equal. Each group of equal
   strings gets its smallest doc_id.
5. Batches learn which strings have an earlier document, and drop the bytes these cover.

Nothing is judged on what is left after other removals.

Defined cases: a null text counts as empty; texts shorter than `length` lose nothing; rows that share a doc_id never remove from each other; a
row with a null doc_id keeps all and removes nothing; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LARGE_ROWS, joined_bytes, mix, new_path, salted_join, saved, slices, tidy, with_columns

LENGTH = 50
ANCHOR = 32
BATCH_BYTES = 2 << 20
#: Strings that one sort takes together, unless one anchor has more.
SORT_STRINGS = 400_000
#: Bytes of text for each bucket of anchors, and for each bucket of the batch table: their numbers grow with the input.
BUCKET_TEXT = 8 << 20
TABLE_TEXT = 64 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LAST = np.iinfo(np.int64).max


# --- prefix hashes and suffix sort ----------------------------------------------------------------------------------------------


class PrefixHashes:
    """Hash of any substring of `data` from prefix sums: sum of value(byte i) * B ** i, divided by B ** start (B is odd, so it can be)."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)
    _values = mix(np.arange(1, 257, dtype=np.uint64))

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(PrefixHashes._powers) < n:
            size = max(n, 1 << 20)
            base, back = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
            base[0] = back[0] = 1
            PrefixHashes._powers, PrefixHashes._inverse = np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self._values[data] * self._powers[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self._inverse[start]


def common_extension(hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and b, up to limit, by binary search."""
    out = limit.astype(np.int64)
    todo = np.flatnonzero(hashes.of(a, a + out) != hashes.of(b, b + out))  # most are equal as far as asked
    a, b, low, high = a[todo], b[todo], np.zeros(len(todo), np.int64), out[todo] - 1
    for _ in range(int(high.max(initial=0)).bit_length()):
        middle = (low + high + 1) >> 1
        equal = hashes.of(a, a + middle) == hashes.of(b, b + middle)
        low, high = np.where(equal, middle, low), np.where(equal, high, np.maximum(middle - 1, low))
    out[todo] = low
    return out


def sort_suffixes(data: np.ndarray, starts: np.ndarray, length: int, groups: np.ndarray | None = None, hashes: PrefixHashes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by group, then by their first `length` bytes (all have as many), and the common extension of each with
    the one before it in its group.

    A stable merge sort, all merges of a level at once: each suffix's place is its rank in its own run plus its rank in the sibling
    run, found by binary search with comparisons through common_extension.
    """
    hashes = hashes or PrefixHashes(data)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    groups = np.zeros(n, np.int64) if groups is None else groups
    order = np.argsort(groups, kind="stable")
    first = np.concatenate(([True], groups[order][1:] != groups[order][:-1]))
    group = np.cumsum(first) - 1
    begin = np.flatnonzero(first)[group]
    size = np.bincount(group)[group]
    most = np.full(1, length, np.int64)

    def less(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y, both as starts; equal ones as or_equal says."""
        k = common_extension(hashes, x, y, np.broadcast_to(most, len(x)))
        ended = k >= length
        at = np.where(ended, 0, k)
        return np.where(ended, or_equal, data[x + at] < data[y + at])

    width = 1
    while width < int(size.max(initial=1)):
        place = np.arange(n) - begin
        run = place // width
        sibling = run ^ 1
        low = np.minimum(begin + sibling * width, begin + size)
        stop = np.minimum(low + width, begin + size)
        active = np.flatnonzero(stop > low)
        lo, hi = low[active], stop[active]
        later = (run[active] & 1).astype(bool)  # equal suffixes of the run before come first
        own = starts[order[active]]
        while len(todo := np.flatnonzero(lo < hi)):
            middle = (lo[todo] + hi[todo]) >> 1
            other = starts[order[middle]]
            goes = less(other, own[todo], later[todo])
            lo[todo] = np.where(goes, middle + 1, lo[todo])
            hi[todo] = np.where(goes, hi[todo], middle)
        to = np.arange(n)
        to[active] = begin[active] + (run[active] // 2) * 2 * width + place[active] % width + (lo - low[active])
        merged = np.empty_like(order)
        merged[to] = order
        order = merged
        width *= 2
    a, b = starts[order[:-1]], starts[order[1:]]
    tied = np.flatnonzero(~first[1:])
    shared = np.zeros(n, np.int64)
    shared[1 + tied] = common_extension(hashes, a[tied], b[tied], np.broadcast_to(most, len(tied)))
    return order, shared


def equal_strings(data: np.ndarray, starts: np.ndarray, length: int, groups: np.ndarray, hashes: PrefixHashes | None = None) -> np.ndarray:
    """A number for each start; starts have the same number when their groups and their `length` bytes are the same."""
    order, shared = sort_suffixes(data, starts, length, groups, hashes)
    at = np.flatnonzero(shared >= length)
    same = np.zeros(len(starts), dtype=bool)
    if len(at):  # hashes said so; the bytes decide
        view = np.lib.stride_tricks.sliding_window_view(data, length)
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            same[part] = (view[starts[order[part - 1]]] == view[starts[order[part]]]).all(axis=1)
    out = np.zeros(len(starts), np.int64)
    out[order] = np.cumsum(~same) - 1
    return out


def same_spans(data: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, hashes: PrefixHashes) -> tuple[np.ndarray, np.ndarray]:
    """For each span its class and the classes' first spans. A class has equal bytes and keys: hashes find them and the bytes decide;
    a span that differs from its class is one of its own."""
    h = mix(hashes.of(begin, begin + size) + size.astype(np.uint64)) ^ mix(key)
    _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
    wide = int(size.max(initial=0))
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(wide, np.uint8))), wide) if wide else data
    rep = one[inverse]
    odd = []
    others = np.flatnonzero(rep != np.arange(len(rep)))
    for k in range(0, len(others), 1 << 15):
        a = others[k : k + (1 << 15)]
        b = rep[a]
        differs = (view[begin[a]] != view[begin[b]]) & (np.arange(wide) < size[a][:, None])
        odd.append(a[differs.any(axis=1) | (size[a] != size[b]) | (key[a] != key[b])])
    odd = np.concatenate([np.zeros(0, np.int64), *odd])
    inverse[odd] = len(one) + np.arange(len(odd))
    return inverse, np.append(one, odd)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the ranges, one after the other."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


def _binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary row for each run of values between two cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


# --- anchors --------------------------------------------------------------------------------------------------------------------


def window_anchors(data: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string of `length` bytes the position of its anchor; and the anchors' hashes by position."""
    n = len(data) - anchor + 1
    hashes = PrefixHashes(data)
    at = np.arange(n)
    h = mix(hashes.of(at, at + anchor))
    wide = length - anchor + 1
    # position within the window breaks ties: keep 58 bits of the hash and let the first of equals win by strict comparison
    strings = len(data) - length + 1
    best, where = h[:strings].copy(), np.zeros(strings, np.int32)
    span = 1
    # doubling: best over 1, 2, 4, ... positions, then the two overlapping spans that make up `wide`
    while span * 2 <= wide:
        best, where = _lesser(h, best, where, span, strings, span)
        span *= 2
    if span < wide:
        best, where = _lesser(h, best, where, wide - span, strings, span)
    return np.arange(strings) + where, h


def _lesser(h: np.ndarray, best: np.ndarray, where: np.ndarray, shift: int, strings: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Combines each span with the one `shift` further on. Near the end, where that one isn't kept, it is looked up directly."""
    other, place = np.empty_like(best), np.empty_like(where)
    keep = max(strings - shift, 0)
    other[:keep], place[:keep] = best[shift:], where[shift:]
    for k in range(keep, strings):
        part = h[k + shift : k + shift + span]
        i = int(part.argmin())
        other[k], place[k] = part[i], i
    place += shift
    later = other < best
    return np.where(later, other, best), np.where(later, place, where).astype(np.int32)


class Batch:
    """The texts of a row of the batch table and what each pass needs of them; computed alike each time."""

    def __init__(self, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, data: np.ndarray, length: int, anchor: int, buckets: int):
        self.doc_ids, self.length, self.data = doc_ids, length, data
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        none = np.zeros(0, np.int64)
        self.starts = self.first = self.n_strings = self.doc = self.code = self.inverse = none
        if len(data) >= length:
            anchors, h = window_anchors(data, length, anchor)
            doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            inside = (doc[: len(anchors)] == doc[length - 1 :]) & known[doc[: len(anchors)]]
            self.starts = np.flatnonzero(inside)  # of all strings
            own = anchors[self.starts]
            self.first = np.flatnonzero(np.diff(own, prepend=-1))  # strings with the same anchor follow each other
            self.n_strings = np.diff(np.append(self.first, len(self.starts)))
            at = own[self.first]
            self.offset = at - self.starts[self.first]
            self.doc = doc[at]
            bucket = (h[at] >> np.uint64(32)) % np.uint64(buckets)
            code = (bucket << np.uint64(32)) | (h[at] & np.uint64(0x7FFFFFFF))
            self.code, self.inverse, self.count = np.unique(code, return_inverse=True, return_counts=True)
        bounds = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)
        self.cuts = np.searchsorted(self.code.astype(np.uint64), bounds)

    def candidates(self, replies: list[dict]) -> np.ndarray:
        """Anchors that a bucket has seen more than once; replies: bucket and the bits of its codes."""
        seen = np.zeros(len(self.code), dtype=bool)
        for r in replies:
            a, b = self.cuts[r["bucket"]], self.cuts[r["bucket"] + 1]
            seen[a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a).astype(bool)
        return np.flatnonzero(seen[self.inverse]) if len(self.inverse) else self.inverse

    def classes(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the anchors its class, that is the anchors whose surroundings are the same; and an anchor of each class."""
        begin = self.starts[self.first[anchors]]
        key = self.code[self.inverse[anchors]] ^ (self.offset[anchors].astype(np.uint64) << np.uint64(58))
        return same_spans(self.data, begin, self.n_strings[anchors] + self.length - 1, key, PrefixHashes(self.data))


_BATCHES = "key long, seq int, doc_ids array<long>, sizes array<int>, data binary"


def batch_table(documents: DataFrame, parts: int) -> DataFrame:
    """The texts as rows of about BATCH_BYTES, written as a table bucketed by `key`, so that joins on it move no text.

    The key is the task's number and the batch's number within it, as doc_ids may be null or repeat.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, seq = [], 0, 0
        task = TaskContext.get().partitionId()

        def row() -> pa.RecordBatch:
            ids = [x for p in waiting for x in p.column("doc_id").to_pylist()]
            joined = [joined_bytes(p.column("text"), "") for p in waiting]
            sizes = np.concatenate([np.diff(o) for _, o in joined])
            data = np.concatenate([d for d, _ in joined]).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | seq], pa.int64()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([data], pa.binary())], ["key", "seq", "doc_ids", "sizes", "data"])

        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES // 8):
                waiting.append(part)
                size += part.column("text").nbytes
                if size >= BATCH_BYTES:
                    yield row()
                    waiting, size, seq = [], 0, seq + 1
        if waiting:
            yield row()

    spark = documents.sparkSession
    path = new_path(spark, "batches")
    name = "scratch_" + path.rsplit("/", 1)[-1].replace("-", "_")
    documents.select("doc_id", "text").mapInArrow(tidy(pack), _BATCHES).write.bucketBy(parts, "key").options(compression="zstd", path=path, **LARGE_ROWS).saveAsTable(name)
    return spark.table(name)


def whole_copies(documents: DataFrame, length: int) -> tuple[DataFrame, int]:
    """copy (a doc_id), sum, n_bytes of every row whose whole text an earlier document has, for which only sums are shuffled; and the
    bytes of all texts that can hold a string."""
    sums = saved(documents.where("doc_id is not null").select("doc_id", F.sha2("text", 256).alias("sum"), F.octet_length("text").cast("long").alias("n_bytes")).where(F.col("n_bytes") >= length), "sums")
    firsts = sums.groupBy("sum").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sum", "first")
    copies = salted_join(sums, firsts, ["sum"], ["doc_id"]).where("doc_id > first").select(F.col("doc_id").alias("copy"), "sum", "n_bytes")
    return saved(copies, "copies"), sums.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]


def remove_repeats(documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) of every document."""
    if not 0 <= length - anchor < 64:
        raise ValueError("an anchor lies within a string, and less than 64 bytes shorter")
    spark = documents.sparkSession
    docs = with_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    copies, n_bytes = whole_copies(docs, length)
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least_parts, -(-n_bytes // BUCKET_TEXT))
    left = docs.withColumn("_sum", F.sha2("text", 256)).join(copies.hint("merge"), (F.col("doc_id") == F.col("copy")) & (F.col("_sum") == F.col("sum")), "left_anti")
    batches = batch_table(left.select("doc_id", "text"), max(least_parts, -(-n_bytes // TABLE_TEXT)))

    def opened(record: pa.RecordBatch, k: int) -> Batch:
        ids = record.column("doc_ids")[k].values
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return Batch(ids.fill_null(0).to_numpy(), known, record.column("sizes")[k].values.to_numpy().astype(np.int64), np.frombuffer(record.column("data")[k].as_buffer(), np.uint8), length, anchor, parts)

    def addressed(record: pa.RecordBatch, k: int, used: np.ndarray, values: list[pa.Array], names: list[str]) -> pa.RecordBatch:
        """A row for each bucket that a batch has something for."""
        return pa.RecordBatch.from_arrays([*(pa.repeat(record.column(c)[k], len(used)) for c in ("key", "seq")), pa.array(used, pa.int32()), *values], ["key", "seq", "bucket", *names])

    def name_anchors(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for k in range(len(record)):
                own = opened(record, k)
                used = np.flatnonzero(np.diff(own.cuts))
                if len(used):  # the lowest bit: whether the batch has it several times
                    codes = ((own.code & np.uint64(0x7FFFFFFF)).astype("<u4") << np.uint32(1)) | (own.count > 1).astype("<u4")
                    yield addressed(record, k, used, [_binaries(codes, own.cuts[np.append(used, parts)])], ["codes"])

    def find_shared(table: pa.Table) -> pa.Table:
        codes = [np.frombuffer(c.as_buffer(), "<u4") for chunk in table.column("codes").chunks for c in chunk]
        every = np.concatenate(codes)
        several = (every & 1).astype(bool)
        every = every >> np.uint32(1)
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        several[order[1:][same]] = several[order[:-1][same]] = True
        ends = np.cumsum([len(c) for c in codes])
        bits = [np.packbits(x).tobytes() for x in np.split(several, ends[:-1])]
        return pa.table({"key": table.column("key"), "seq": table.column("seq"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    named = batches.mapInArrow(tidy(name_anchors), "key long, seq int, bucket int, codes binary")
    shared = named.repartition(parts, "bucket").groupBy("bucket").applyInArrow(find_shared, "key long, seq int, bucket int, bits binary")
    seen = saved(shared.groupBy(F.col("key").alias("k1")).agg(F.collect_list(F.struct("seq", "bucket", "bits")).alias("seen")), "anchors")

    def own_replies(record: pa.RecordBatch, column: str, k: int) -> list[dict]:
        seq = record.column("seq")[k].as_py()
        return [x for x in record.column(column)[k].as_py() or [] if x["seq"] == seq]

    def send_surroundings(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for k in range(len(record)):
                own = opened(record, k)
                anchors = own.candidates(own_replies(record, "seen", k))
                if not len(anchors):
                    continue
                member, one = own.classes(anchors)
                low = np.full(len(one), _LAST)
                np.minimum.at(low, member, own.doc_ids[own.doc[anchors]])
                rep = anchors[one]
                begin = own.starts[own.first[rep]]
                size = own.n_strings[rep] + length - 1
                # where a class occurs in the batch goes along and comes back with the answer
                by_class = np.argsort(member, kind="stable")
                places = own.starts[own.first[anchors[by_class]]]
                place_cuts = np.searchsorted(member[by_class], np.arange(len(one) + 1))
                bucket = (own.code[own.inverse[rep]] >> np.uint64(32)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(parts + 1))
                used = np.flatnonzero(np.diff(cuts))
                cuts = cuts[np.append(used, parts)]
                many, width = np.diff(place_cuts)[by], size[by]
                values = {
                    "codes": (own.code[own.inverse[rep[by]]].astype("<u4"), cuts),
                    "strings": (own.n_strings[rep[by]].astype("<u2"), cuts),
                    "offsets": (own.offset[rep[by]].astype("<u2"), cuts),
                    "low": (low[by].astype("<i8"), cuts),
                    "many": (many.astype("<i4"), cuts),
                    "places": (places[_ranges(place_cuts[by], many)].astype("<i4"), np.append(0, np.cumsum(many))[cuts]),
                    "text": (own.data[_ranges(begin[by], width)], np.append(0, np.cumsum(width))[cuts]),
                }
                yield addressed(record, k, used, [_binaries(*v) for v in values.values()], list(values))

    def sort_bucket(table: pa.Table) -> pa.Table:
        kinds = {"codes": "<u4", "strings": "<u2", "offsets": "<u2", "low": "<i8", "text": "u1"}
        lists = {c: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in kinds.items()}
        counts = np.array([len(x) for x in lists["codes"]])
        codes, strings, offsets, low, text = (np.concatenate(lists[c]) for c in kinds)
        strings, offsets = strings.astype(np.int64), offsets.astype(np.int64)
        begin = np.cumsum(strings + length - 1) - (strings + length - 1)
        order = np.argsort(codes, kind="stable")
        # sorts of about SORT_STRINGS strings, between different anchors
        total = np.cumsum(strings[order])
        edge = np.flatnonzero(np.diff(codes[order].astype(np.int64), prepend=-1))
        chosen = np.unique(np.concatenate((edge[np.searchsorted(total[edge], np.arange(0, total[-1], SORT_STRINGS)).clip(max=len(edge) - 1)], [0])))
        string_start = np.cumsum(strings) - strings
        least = np.zeros(int(strings.sum()), np.int64)
        for a, b in zip(chosen, np.append(chosen[1:], len(order)), strict=True):
            c = order[a:b]
            size = strings[c] + length - 1
            data = text[_ranges(begin[c], size)]
            start = np.cumsum(size) - size
            hashes = PrefixHashes(data)
            # surroundings that several batches have are one, and those alone with their anchor need no sort
            key = codes[c].astype(np.uint64) ^ (offsets[c].astype(np.uint64) << np.uint64(58))
            member, one = same_spans(data, start, size, key, hashes)
            lowest = np.full(len(one), _LAST)
            np.minimum.at(lowest, member, low[c])
            n = strings[c][one]
            own_start = np.cumsum(n) - n
            answer = np.repeat(lowest, n)
            _, group, shared = np.unique(codes[c][one], return_inverse=True, return_counts=True)
            meet = np.flatnonzero(shared[group] > 1)
            if len(meet):
                owner = np.repeat(meet, n[meet])
                k = _ranges(np.zeros(len(meet), np.int64), n[meet])
                # equal strings have the same anchor at the same place
                place = codes[c][one][owner].astype(np.int64) * (1 << 16) + (offsets[c][one][owner] - k)
                number = equal_strings(data, start[one][owner] + k, length, place, hashes)
                best = np.full(int(number.max()) + 1, _LAST)
                np.minimum.at(best, number, lowest[owner])
                answer[own_start[owner] + k] = best[number]
            least[_ranges(string_start[c], strings[c])] = answer[_ranges(own_start[member], strings[c])]
        # back to each batch: per class the runs of strings with the same smallest doc_id
        class_of = np.repeat(np.arange(len(strings)), strings)
        new = np.flatnonzero((np.diff(class_of, prepend=-1) != 0) | (np.diff(least, prepend=-1) != 0))
        run, runs = np.diff(np.append(new, len(least))), np.bincount(class_of[new], minlength=len(strings))
        cuts = np.concatenate(([0], np.cumsum(counts)))
        run_cuts = np.concatenate(([0], np.cumsum(runs)))[cuts]
        out = {}
        for name, values, where in (("runs", runs.astype("<u2"), cuts), ("run", run.astype("<u2"), run_cuts), ("least", least[new].astype("<i8"), run_cuts)):
            out[name] = pa.array([values[x:y].tobytes() for x, y in zip(where[:-1], where[1:], strict=True)], pa.binary())
        return pa.table({c: table.column(c) for c in ("key", "seq", "strings", "many", "places")} | out)

    def cut(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for k in range(len(record)):
                ids = record.column("doc_ids")[k].values.fill_null(0).to_numpy()
                offsets = np.concatenate(([0], np.cumsum(record.column("sizes")[k].values.to_numpy().astype(np.int64))))
                data = np.frombuffer(record.column("data")[k].as_buffer(), np.uint8)
                edges = np.zeros(len(data) + 1, np.int32)
                for r in own_replies(record, "least", k):
                    strings, many, places, runs, run, low = (np.frombuffer(r[c], kind).astype(np.int64) for c, kind in (("strings", "<u2"), ("many", "<i4"), ("places", "<i4"), ("runs", "<u2"), ("run", "<u2"), ("least", "<i8")))
                    # every run of strings of every place of its class
                    of = np.repeat(np.arange(len(strings)), many)
                    inner = np.cumsum(run) - run - np.repeat(np.cumsum(strings) - strings, runs)
                    pick = _ranges((np.cumsum(runs) - runs)[of], runs[of])
                    first = np.repeat(places, runs[of]) + inner[pick]
                    owner = ids[np.searchsorted(offsets, first, side="right") - 1]
                    hit = low[pick] < owner
                    np.add.at(edges, first[hit], 1)
                    np.add.at(edges, first[hit] + run[pick][hit] + length - 1, -1)
                covered = np.cumsum(edges[:-1]) > 0
                rows: dict[str, list] = {"doc_id": record.column("doc_ids")[k].as_py(), "n_bytes": np.diff(offsets).tolist(), "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    gone = covered[a:b]
                    kept = data[a:b][~gone].tobytes()
                    rows["n_removed"].append(int(gone.sum()))
                    rows["n_spans"].append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                    rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    rows["kept"].append(kept)
                yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), *(pa.array(rows[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(rows["kept_sha256"]), pa.array(rows["kept"], pa.binary())], list(rows))

    with_seen = batches.join(seen, F.col("key") == F.col("k1"), "left")
    sent = with_seen.select("key", "seq", "doc_ids", "sizes", "data", "seen").mapInArrow(tidy(send_surroundings), "key long, seq int, bucket int, codes binary, strings binary, offsets binary, low binary, many binary, places binary, text binary")
    sorted_ = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(sort_bucket, "key long, seq int, strings binary, many binary, places binary, runs binary, run binary, least binary")
    least = saved(sorted_.groupBy(F.col("key").alias("k2")).agg(F.collect_list(F.struct("seq", "strings", "many", "places", "runs", "run", "least")).alias("least")), "repeats")
    whole = batches.join(least, F.col("key") == F.col("k2"), "left").select("key", "seq", "doc_ids", "sizes", "data", "least")
    rest = whole.mapInArrow(tidy(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    nothing = F.lit("").cast("binary")
    gone = copies.select(F.col("copy").alias("doc_id"), "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(nothing, 256).alias("kept_sha256"), nothing.alias("kept"))
    return rest.unionByName(gone)
