"""Token ids in patched frame-of-reference blocks.

Ids are cut into blocks of BLOCK values. A block stores its minimum, and the differences to it packed at the width that holds a given
share of them (the percentile); differences that need more bits are kept beside the block as exceptions (index and high bits). The
starts of blocks and of documents are indexed, so that any document can be read by itself.

A file holds segments, each with some neighbouring documents. Segments are rows of a Parquet table in the shared folder, because
executors can reach no other file system through Spark; the bytes in `payload` are the format described here, little-endian:

    header      4 x uint32: values, blocks, exceptions, documents
    documents   uint32 x (documents + 1): position of each document's first id
    minimum     uint32 x blocks
    width       uint8 x blocks
    starts      uint32 x blocks: byte at which a block's packed bits begin
    exc_starts  uint32 x (blocks + 1): first exception of each block
    exc_index   uint8 x exceptions
    exc_high    uint32 x exceptions
    bits        packed differences, each block padded to whole bytes

Defined cases: a null text counts as empty and gives only the end id; a null doc_id sorts first; rows that share a doc_id are
written next to each other, in the order of their text; an empty table gives an empty file; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ENTRY_BYTES, IS_WORD, LARGE_ROWS, joined_bytes, same_bytes, saved, slices, tidy, with_columns, word_hashes

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_BYTES = 1 << 20
#: Bytes of a piece that a worker remembers at most; longer ones are encoded each time.
LONG_PIECE = 256
#: Bytes of pieces and ids that a worker remembers at most; then it forgets all and begins anew.
MEMORY_BYTES = 192 << 20

SEGMENT_SCHEMA = "shard int, segment int, doc_ids array<long>, n_ids long, payload binary"

# --- blocks ---------------------------------------------------------------------------------------------------------------------


def _bits_needed(values: np.ndarray) -> np.ndarray:
    return np.where(values > 0, np.frexp(values.astype(np.float64))[1], 0).astype(np.int64)


def pack(ids: np.ndarray, doc_starts: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """The bytes of one segment; doc_starts has one entry more than there are documents."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    filled = np.zeros(n_blocks * BLOCK, np.uint32)
    filled[:n] = ids
    filled[n:] = ids[-1] if n else 0
    grid = filled.reshape(n_blocks, BLOCK)
    minimum = grid.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    grid = grid - minimum[:, None]
    need = _bits_needed(grid)
    kth = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.partition(need, kth, axis=1)[:, kth] if n_blocks else np.zeros(0, np.int64)
    block, index = np.nonzero(need > width[:, None])
    high = (grid[block, index] >> width[block].astype(np.uint32)).astype("<u4")
    sizes = width * (BLOCK // 8)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    packed = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        bits = ((grid[own][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
        rows = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
        packed[starts[own][:, None] + np.arange(rows.shape[1])] = rows
    parts = (
        np.array([n, n_blocks, len(high), len(doc_starts) - 1], "<u4"),
        doc_starts.astype("<u4"),
        minimum.astype("<u4"),
        width.astype(np.uint8),
        starts[:-1].astype("<u4"),
        np.searchsorted(block, np.arange(n_blocks + 1)).astype("<u4"),
        index.astype(np.uint8),
        high,
        packed,
    )
    return b"".join(p.tobytes() for p in parts)


def unpack(payload: bytes, documents: slice | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the documents' starts of a segment; with a slice of documents, only their blocks are decoded."""
    n, n_blocks, n_exc, n_docs = (int(x) for x in np.frombuffer(payload, "<u4", 4))
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    doc_starts, minimum, width, starts = take("<u4", n_docs + 1).astype(np.int64), take("<u4", n_blocks), take("u1", n_blocks), take("<u4", n_blocks).astype(np.int64)
    exc_starts, exc_index, exc_high = take("<u4", n_blocks + 1).astype(np.int64), take("u1", n_exc), take("<u4", n_exc)
    packed = np.frombuffer(payload, np.uint8, offset=at)
    lo, hi, _ = (documents or slice(None)).indices(n_docs)
    hi = max(lo, hi)
    first, last = int(doc_starts[lo]), int(doc_starts[hi])
    b0, b1 = first // BLOCK, -(-last // BLOCK)
    grid = np.zeros((b1 - b0, BLOCK), np.uint32)
    for w in np.unique(width[b0:b1]):
        own = np.flatnonzero(width[b0:b1] == w)
        if w:
            rows = packed[starts[b0:b1][own][:, None] + np.arange(int(w) * BLOCK // 8)]
            bits = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(own), BLOCK, int(w))
            grid[own] = (bits.astype(np.uint32) << np.arange(w, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)
    if b1 > b0:
        e0, e1 = int(exc_starts[b0]), int(exc_starts[b1])
        block = np.repeat(np.arange(b1 - b0), np.diff(exc_starts[b0 : b1 + 1]))
        grid[block, exc_index[e0:e1]] |= exc_high[e0:e1] << width[b0:b1][block].astype(np.uint32)
        grid += minimum[b0:b1, None]
    return grid.reshape(-1)[first - b0 * BLOCK : last - b0 * BLOCK], doc_starts[lo : hi + 1] - first


# --- encoding -------------------------------------------------------------------------------------------------------------------


#: Fixed values of the pre-tokenizer: white space beyond ASCII as UTF-8, and ASCII letters, digits and marks.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WIDE_HEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")
_WORD_BYTE, _MARK_BYTE = np.zeros(256, bool), np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK_BYTE[33:127] = ~_WORD_BYTE[33:127]
_LATIN_BYTE = np.zeros(256, bool)  # second bytes of the letters from U+00C0 to U+00FF
_LATIN_BYTE[128:192] = True
_LATIN_BYTE[[0x97, 0xB7]] = False


def piece_starts(data: np.ndarray, offsets: np.ndarray, blob: bytes) -> np.ndarray:
    """Whether each byte begins a piece, where a byte-level pre-tokenizer always cuts: before white space, before the last white-space
    character that text follows and behind it unless it is a space, and between a letter or digit and an ASCII mark."""
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    if not n:
        return begins[:n]
    inner = ~begins[1:n]  # of a byte and the one after it: whether both are of one text
    white = ~IS_WORD[data]
    if any(x in blob for x in _WIDE_HEADS):
        for m in _WIDE_SPACE.finditer(blob):
            white[m.start() : m.end()] = True
    begins[1:n] |= white[1:] & ~white[:-1]
    ends = np.flatnonzero(white[:-1] & ~white[1:] & inner) + 1
    last = ends - 1
    for _ in range(2):  # to the first byte of the character
        last = last - (data[last] & 0xC0 == 0x80)
    begins[last] = True
    begins[ends[data[last] != 32]] = True
    marks = _MARK_BYTE[data]
    begins[1:n] |= marks[1:] & _WORD_BYTE[data[:-1]]
    begins[2:n] |= marks[2:] & _LATIN_BYTE[data[1:-1]] & (data[:-2] == 0xC3)
    return begins[:n]


class WordEncoder:
    """Whole-text encoding through the tokenizers library, in which each different piece is encoded once.

    A byte-level pre-tokenizer always cuts at some places (see piece_starts), so a text's ids are the ids of its pieces between such
    cuts, one after the other. A text that holds a token added to the vocabulary (as `<|endoftext|>`), which the library takes out of a
    text before it cuts it, is one piece, and so is every text where the pre-tokenizer is of another kind. Pieces are told apart by
    hashes, and compared byte by byte with the first of the same hash. Long ones are encoded anew each time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary, rules = self.tokenizer.get_vocab(), json.loads(self.tokenizer.to_str())
        first = rules["pre_tokenizer"] or {}
        #: The new line and the space as byte-level letters.
        self.newline = vocabulary.get("Ċ")
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.opens[[k for piece, k in vocabulary.items() if piece[:1] == "Ġ"]] = True
        self.cuts = first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"] and rules["normalizer"] is None and self.newline is not None
        self.groups = self.cuts and not any(c.isspace() for t in self.added for c in t)
        self.forget()

    def forget(self) -> None:
        #: Codes of pieces. Code 0 is the end id.
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1, np.uint32)
        self.starts = np.array([0, 1], np.int64)
        self.size = 0

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(x, np.uint32) for x in self.ids_of(texts))])

    def learn(self, keys: list[bytes]) -> np.ndarray:
        """The codes of new pieces."""
        words = [k.decode(errors="replace") for k in keys]
        # where one piece at all holds an added token, each is encoded by itself
        grouped = self.groups and not any(t in "\n".join(words) for t in self.added)
        spaced, bare, alone = [], [], []
        for k, w in enumerate(words):
            (alone if not grouped or w.isspace() else spaced if w[0] == " " else bare).append(k)
        # pieces that begin with a space are cut at the ids that open with one, the others at the new lines between them
        one = self.together(["".join(words[k] for k in spaced[a : a + 200]) for a in range(0, len(spaced), 200)])
        two = self.together(["\n".join(words[k] for k in bare[a : a + 200]) + "\n" for a in range(0, len(bare), 200)])
        opens, closes = np.flatnonzero(self.opens[one]), np.flatnonzero(two == self.newline)
        if len(opens) != len(spaced) or len(closes) != len(bare):
            raise ValueError("the vocabulary joins pieces across white space")
        lists = self.ids_of([words[k] for k in alone])
        lengths = np.concatenate((np.diff(np.append(opens, len(one))), np.diff(closes, prepend=-1) - 1, np.array([len(x) for x in lists], np.int64)))
        codes = np.empty(len(keys), np.int64)
        codes[[*spaced, *bare, *alone]] = len(self.starts) - 1 + np.arange(len(keys))
        self.known.update(zip(keys, codes.tolist(), strict=True))
        self.flat = np.concatenate([self.flat, one, two[two != self.newline] if self.cuts else two, *(np.array(x, np.uint32) for x in lists)])
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(lengths)))
        self.size += ENTRY_BYTES * len(keys) + sum(map(len, keys)) + 4 * int(lengths.sum())
        return codes

    def pieces(self, data: np.ndarray, offsets: np.ndarray, blob: bytes) -> np.ndarray:
        """The starts of the pieces of all texts, with the end."""
        begins = np.zeros(len(data) + 1, bool)
        if self.cuts:
            begins[:-1] = piece_starts(data, offsets, blob)
            for token in map(str.encode, self.added):
                at = blob.find(token)
                while at >= 0:
                    k = int(np.searchsorted(offsets, at, side="right"))
                    begins[offsets[k - 1] : offsets[k]] = False
                    at = blob.find(token, max(at + 1, int(offsets[k])))
        begins[offsets] = True
        return np.flatnonzero(begins)

    def encode(self, texts: pa.Array | list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with `end` after each text, and the texts' starts. Nulls count as empty."""
        if self.size > MEMORY_BYTES:
            self.forget()
        data, offsets = joined_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        blob, n_texts = data.tobytes(), len(offsets) - 1
        bounds = self.pieces(data, offsets, blob)
        starts, stops = bounds[:-1], bounds[1:]
        codes = np.zeros(len(starts), np.int64)
        long = stops - starts > LONG_PIECE
        short = np.flatnonzero(~long)
        a, b = starts[short], stops[short]
        hashes = word_hashes(data, a, b)
        order = np.argsort(hashes)
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        rep, own = order[new], np.empty(len(order), np.int64)
        own[order] = np.cumsum(new) - 1
        keys = [blob[i:j] for i, j in zip(a[rep].tolist(), b[rep].tolist(), strict=True)]
        if not same_bytes(data, a, b, a[rep][own], b[rep][own]):  # two pieces of one hash
            every = [blob[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            keys = list(dict.fromkeys(every))
            place = dict(zip(keys, range(len(keys)), strict=True))
            own = np.array([place[k] for k in every], np.int64)
        found = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            found[unknown] = self.learn([keys[k] for k in unknown.tolist()])
        codes[short] = found[own]
        flat, at = self.flat, self.starts
        if long.any():
            more = [np.array(x, np.uint32) for x in self.ids_of([blob[i:j].decode(errors="replace") for i, j in zip(starts[long].tolist(), stops[long].tolist(), strict=True)])]
            codes[long] = len(at) - 1 + np.arange(len(more))
            flat, at = np.concatenate([flat, *more]), np.concatenate((at, at[-1] + np.cumsum([len(x) for x in more])))
        # the end id behind each text
        n = np.diff(np.searchsorted(starts, offsets))
        every = np.zeros(len(codes) + n_texts, np.int64)
        every[np.arange(len(codes)) + np.repeat(np.arange(n_texts), n)] = codes
        begin = at[every]
        length = at[every + 1] - begin
        total = np.concatenate(([0], np.cumsum(length)))
        ids = flat[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        text_starts = total[np.concatenate(([0], np.cumsum(n + 1)))]
        ids[text_starts[1:] - 1] = end
        return ids, text_starts


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process; its memory of words is bounded."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# --- files ----------------------------------------------------------------------------------------------------------------------


def write_token_file(documents: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Encodes every text, in ascending doc_id order, into a table of segments (shard, segment, doc_ids, n_ids, payload)."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, tool = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text", SEGMENT_BYTES):
                ids, starts = tool.encode(part.column("text"), end_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([pack(ids, starts)], pa.binary())],
                    ["shard", "segment", "doc_ids", "n_ids", "payload"],
                )
                number += 1

    docs = with_columns(documents, "doc_id", "text")
    ordered = docs.withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return saved(ordered.mapInArrow(tidy(segments), SEGMENT_SCHEMA), "token-file", **LARGE_ROWS)


def read_token_file(file: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the bytes of the file.

    Starts come from two sums: over the shards, of which there is one row each, and over the segments of a shard.
    """
    sizes = file.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select(F.col("shard").alias("s"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    own = Window.partitionBy("shard").orderBy("segment")
    starts = sizes.select("shard", "segment", (F.sum("n_ids").over(own) - F.col("n_ids")).alias("inner")).join(before, F.col("shard") == F.col("s"))
    starts = starts.select(F.col("shard").alias("s"), F.col("segment").alias("g"), (F.col("shard_start") + F.col("inner")).alias("first"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, doc_ids, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "segment", "doc_ids", "payload")), strict=True):
                ids, at = unpack(payload)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    ["shard", "segment", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    read = file.select("shard", "segment", "doc_ids", "payload").mapInArrow(tidy(rows), "shard int, segment int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    found = read.join(starts, (F.col("shard") == F.col("s")) & (F.col("segment") == F.col("g")))
    return found.select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def document_ids(file: DataFrame) -> DataFrame:
    """doc_id and ids (array<int>) of every document, for use of the file itself."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, payload in zip(batch.column("doc_ids").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                ids, at = unpack(payload)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return file.select("doc_ids", "payload").mapInArrow(tidy(rows), "doc_id long, ids array<int>")
