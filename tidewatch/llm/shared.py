"""Scratch tables in the folder that the whole cluster shares, and byte-level helpers for Arrow text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scratch import LARGE_ROWS, Batches, clear_scratch, give_back, new_path, saved, scratch_mark, tidy  # noqa: F401

#: Bytes of text that one vectorised step handles at most, unless a single document is longer.
SLICE_BYTES = 2 << 20

#: What a remembered word takes besides its characters: a dict entry, a str head, an int and a start.
ENTRY_BYTES = 160

#: White space of every word rule here: space and \x09-\x0D.
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

_MUL1 = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xD6E8FEB86659FD93)
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (multiply and shift)."""
    h = (h ^ (h >> np.uint64(32))) * _MUL1
    h = (h ^ (h >> np.uint64(29))) * _MUL2
    return h ^ (h >> np.uint64(32))


def joined_bytes(texts: pa.Array, separator: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each followed by the separator, and the offsets of the texts. Nulls count as empty."""
    large = pa.large_string()
    glued = pc.binary_join_element_wise(pc.fill_null(texts.cast(large), ""), pa.scalar("", large), pa.scalar(separator, large))
    offsets = np.frombuffer(glued.buffers()[1], dtype=np.int64)[glued.offset : glued.offset + len(glued) + 1]
    raw = glued.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts come to about `limit` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the words; each text must end with white space (joined_bytes)."""
    inside = IS_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word, taken eight bytes at a time."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    h = mix(length.astype(np.uint64))
    todo, at = np.arange(len(starts)), 0
    while len(todo):
        left = np.minimum(length[todo] - at, 8)
        h[todo] = mix(h[todo] * _MUL2 + (eight[starts[todo] + at] & _TAIL[left]))
        at += 8
        todo = todo[length[todo] > at]
    return h


def same_bytes(data: np.ndarray, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> bool:
    """Whether each run of bytes from a equals the one from b."""
    length = a_ends - a
    if (length != b_ends - b).any():
        return False
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    todo, at = np.flatnonzero((a != b) & (length > 0)), 0
    while len(todo):
        left = np.minimum(length[todo] - at, 8)
        if (((eight[a[todo] + at] ^ eight[b[todo] + at]) & _TAIL[left]) != 0).any():
            return False
        at += 8
        todo = todo[length[todo] > at]
    return True


def windows(hashes: np.ndarray, docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words within a document, and the index of each run's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hashes[:n].copy()
    for k in range(1, size):
        h = mix(h * _MUL1 + hashes[k : n + k])
    first = np.flatnonzero(docs[:n] == docs[size - 1 :])
    return h[first], first


def per_document(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Sums by document."""
    return np.bincount(docs, weights=values, minlength=n).astype(np.int64) if len(docs) else np.zeros(n, np.int64)


def with_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns, whatever their names, never reach an operator's own."""
    return df.select(*(df[f"`{n}`"] for n in names))


def whole_groups(batches: Batches, key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by the key; what a task holds is a batch and the group that goes on."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
    if rest is not None and len(rest):
        yield rest.combine_chunks()


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """A join in which one key may hold a large share of the rows of `left`: they are dealt out by a hash of the columns `spread`, and
    `right`, which has few rows a key, goes to each share."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    each = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(each, [*keys, "_salt"], how).drop("_salt")


class WordMemory:
    """What a worker process remembers of the words it has seen: the ids of each, in one flat array. Bounded by `limit` bytes of words
    and ids, whose number each word adds to at a fixed rate; beyond it everything is forgotten."""

    def __init__(self, limit: int):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.size = 0
        self.known: dict = {}
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def add(self, keys: list, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(keys, range(len(self.starts) - 1, len(self.starts) - 1 + len(keys)), strict=True))
        self.flat = np.concatenate((self.flat, flat))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(lengths, dtype=np.int64)))
        self.size += ENTRY_BYTES * len(keys) + sum(map(len, keys)) + 4 * len(flat)

    def ids(self, cut: list[list[str]], learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lists of words, one list after the other, and where each list begins. `learn` gives ids and counts of new words."""
        if self.size > self.limit:
            self.forget()
        codes = [list(map(self.known.get, c)) for c in cut]
        gaps = [[i for i, x in enumerate(k) if x is None] if None in k else () for k in codes]
        if new := list({c[i] for c, g in zip(cut, gaps, strict=True) for i in g}):
            self.add(new, *learn(new))
            for c, k, g in zip(cut, codes, gaps, strict=True):
                for i in g:
                    k[i] = self.known[c[i]]
        n = np.array([len(c) for c in codes], np.int64)
        every = np.fromiter(chain.from_iterable(codes), np.int64, int(n.sum()))
        begin = self.starts[every]
        length = self.starts[every + 1] - begin
        at = np.concatenate(([0], np.cumsum(length)))
        return self.flat[np.repeat(begin - at[:-1], length) + np.arange(at[-1])], at[np.concatenate(([0], np.cumsum(n)))]
