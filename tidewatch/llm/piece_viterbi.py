"""Encoding into the pieces of a SentencePiece model, and decoding.

An Aho-Corasick automaton over all pieces reads a text once. At each position it reports, along its output links, every piece that
ends there, and each of them relaxes the best score of that position (Viterbi). No piece of the model holds a space behind another
character, which is checked as the model is loaded; a text therefore falls apart before its runs of spaces, and each different part
is segmented once and remembered, within a bound. New parts are read by the automaton one after the other as one text, and the
positions of all of them are relaxed side by side.

The supplied model keeps merge ranks instead of probabilities. A piece of rank r gets the log-probability of a Zipf distribution,
-ln(r + 2) less the logarithm of the sum, in whole millionths so that sums are exact. Of equally good segmentations the one whose
last piece is longest wins, and so on backwards. A character without a piece costs 10 more than the rarest piece and becomes its
UTF-8 bytes. As in the model, spaces become the sign U+2581 and one is put in front; the sign itself, in a text, becomes bytes, so
that decoding always gives the text again.

Defined cases: a null text counts as empty and has no ids; null and repeated doc_ids keep their row; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordMemory, slices, tidy, with_columns

SPACE = "▁"
UNKNOWN_PENALTY = 10_000_000
#: Bytes of words and ids that a worker remembers at most; then it forgets all and begins anew.
MEMORY_BYTES = 64 << 20
#: Characters of a part up to which it is relaxed together with others; pieces are shorter than this.
LONGEST = 60

_PART = re.compile(" +[^ ]*|[^ ]+")


class PieceModel:
    """Pieces, their scores and the automaton."""

    def __init__(self, pieces: list[str], scores: list[int], ids: list[int], byte_ids: list[int]):
        """Pieces hold plain spaces; byte_ids has the id of each byte value."""
        import ahocorasick

        self.pieces = dict(zip(ids, pieces, strict=True))
        self.byte_ids, self.byte_of = byte_ids, {k: b for b, k in enumerate(byte_ids)}
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score, k in zip(pieces, scores, ids, strict=True):
            self.automaton.add_word(piece, (len(piece), score, k))
        self.automaton.make_automaton()
        self.numbers = ahocorasick.Automaton()
        for k, piece in enumerate(pieces):
            self.numbers.add_word(piece, k)
        self.numbers.make_automaton()
        self.length_of = np.array([len(p) for p in pieces], np.int64)
        self.score_of = np.array(scores, np.int64)
        self.id_of = np.array(ids, np.int32)
        self.splits = not any(" " in p.lstrip(" ") for p in pieces)
        self.memory = WordMemory(MEMORY_BYTES)
        self.text_of = [self.pieces.get(k, "") for k in range(max(*ids, *byte_ids) + 1)]
        self.is_byte = np.isin(np.arange(len(self.text_of)), byte_ids)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        plain = [k for k in every if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        ranks = [max(0.0, -model.get_score(k)) for k in plain]
        total = math.log(sum(1 / (r + 2) for r in ranks))
        scores = [round(-1e6 * (math.log(r + 2) + total)) for r in ranks]
        return cls([model.id_to_piece(k).replace(SPACE, " ") for k in plain], scores, plain, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of text, in which spaces are plain."""
        n = len(text)
        best = [0] * (n + 1)
        step: list[tuple[int, int]] = [(0, -1)] * (n + 1)  # length and id of the last piece; id -1: bytes
        reached = 0  # positions up to here have their final score
        unknown = self.unknown

        def fill(until: int) -> None:
            """Positions at which no piece ends are reached by a character as bytes."""
            for i in range(reached + 1, until):
                best[i], step[i] = best[i - 1] + unknown, (1, -1)

        at, top, chosen, single = 0, None, (0, -1), False
        for last, (length, score, k) in self.automaton.iter(text):
            end = last + 1
            if end != at:
                if at:
                    if not single and (top is None or best[at - 1] + unknown > top):
                        top, chosen = best[at - 1] + unknown, (1, -1)
                    best[at], step[at] = top, chosen
                    reached = at
                fill(end)
                at, top, single = end, None, False
            total = best[end - length] + score
            if length == 1:
                single = True
            if top is None or total > top or (total == top and length > chosen[0]):
                top, chosen = total, (length, k)
        if at:
            if not single and (top is None or best[at - 1] + unknown > top):
                top, chosen = best[at - 1] + unknown, (1, -1)
            best[at], step[at] = top, chosen
            reached = at
        fill(n + 1)
        ids: list[int] = []
        while n:
            length, k = step[n]
            ids += [k] if k >= 0 else [self.byte_ids[b] for b in reversed(text[n - 1].encode("utf-8", "surrogatepass"))]
            n -= length
        return ids[::-1]

    def segment_many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in one array, and how many each has. Parts begin with a space."""
        short = [k for k, p in enumerate(parts) if p[-1] != " " and len(p) <= LONGEST]
        size = np.array([len(parts[k]) for k in short], np.int64)
        text = "".join([parts[k] for k in short])
        pairs = np.fromiter(chain.from_iterable(self.numbers.iter(text)), np.int64).reshape(-1, 2)
        end, number = pairs[:, 0] + 1, pairs[:, 1]
        start = np.cumsum(size) - size
        word = np.repeat(np.arange(len(short)), size)[end - 1]
        at, length = end - start[word], self.length_of[number]
        # characters without a piece of their own need bytes: such parts are segmented singly
        plain = np.bincount(word[length == 1], minlength=len(short)) == size
        order = np.argsort(at.astype(np.uint8), kind="stable")
        order = order[plain[word[order]]]
        word, at, length, number = word[order], at[order], length[order], number[order]
        base = start + np.arange(len(short))  # a cell for each position, and one for the beginning
        best = np.zeros(len(text) + len(short), np.int64)
        step = np.zeros(len(best), np.int64)
        cell = base[word] + at
        cuts = np.searchsorted(at, np.arange(1, LONGEST + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            # of equal sums the longest piece; pieces that end at one position differ in length
            total = (best[cell[a:b] - length[a:b]] + self.score_of[number[a:b]]) * 64 + length[a:b]
            head = np.flatnonzero(np.diff(cell[a:b], prepend=-1))
            top = np.maximum.reduceat(total, head)
            chosen = np.flatnonzero(total == np.repeat(top, np.diff(np.append(head, b - a))))
            best[cell[a:b][head]] = top >> 6
            step[cell[a:b][head]] = number[a:b][chosen]
        left = np.where(plain, size, 0)
        cells, found = [], []
        while len(own := np.flatnonzero(left)):
            c = base[own] + left[own]
            cells.append(c)
            found.append(step[c])
            left[own] -= self.length_of[step[c]]
        cells, found = np.concatenate([np.zeros(0, np.int64), *cells]), np.concatenate([np.zeros(0, np.int64), *found])
        by = np.argsort(cells)
        many = np.bincount(np.searchsorted(base, cells, side="right") - 1, minlength=len(short)) if len(short) else np.zeros(0, np.int64)
        flat, counts = self.id_of[found[by]], np.zeros(len(parts), np.int64)
        counts[short] = many
        done = np.zeros(len(parts), dtype=bool)
        done[np.array(short, np.int64)[plain]] = True
        if done.all():
            return flat, counts
        singly = {k: self.segment(parts[k]) for k in np.flatnonzero(~done).tolist()}
        counts[list(singly)] = [len(x) for x in singly.values()]
        out = np.empty(int(counts.sum()), np.int32)
        ends = np.cumsum(counts)
        taken = np.repeat(done, counts)
        out[taken] = flat
        for k, ids in singly.items():
            out[ends[k] - len(ids) : ends[k]] = ids
        return out, counts

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each begins."""
        if not self.splits:
            ids = [np.array(self.segment(" " + t) if t else [], np.int32) for t in texts]
            return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
        # a part is known by itself without its space, or with all its spaces where it has several
        cut = [[] if not t else t.split(" ") if "  " not in t and t[0] != " " else [p[1:] if p[1:2] != " " else p for p in _PART.findall(" " + t)] for t in texts]
        return self.memory.ids(cut, lambda new: self.segment_many([p if p[:1] == " " else " " + p for p in new]))

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        if not self.is_byte[ids].any():
            return "".join(map(self.text_of.__getitem__, ids.tolist()))[1:]
        out, raw = [], bytearray()
        for k in ids.tolist():
            if k in self.byte_of:
                raw.append(self.byte_of[k])
            else:
                out.append(raw.decode("utf-8", "replace") + self.text_of[k])
                raw.clear()
        return ("".join(out) + raw.decode("utf-8", "replace"))[1:]


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One for each worker process."""
    if path not in _models:
        _models[path] = PieceModel.load(path)
    return _models[path]


def _list(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids of every text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _list(*model.encode_all([t or "" for t in part.column("text").to_pylist()]))], ["doc_id", "ids"])

    return with_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidy(rows), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of its ids; null ids give an empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            texts = [model.decode(np.array(x if x is not None else [], np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return with_columns(encoded, "doc_id", "ids").mapInArrow(tidy(rows), "doc_id long, text string")


def round_trip(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids, and whether decoding them gives the text again."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, starts = model.encode_all(texts)
                same = [model.decode(ids[a:b]) == t for a, b, t in zip(starts[:-1], starts[1:], texts, strict=True)]
                bytes_before = np.concatenate(([0], np.cumsum(model.is_byte[ids])))
                values = [pa.array(np.diff(starts)), pa.array(np.diff(bytes_before[starts])), _list(ids, starts), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *values], ["doc_id", "n_pieces", "n_byte_pieces", "ids", "decodes"])

    docs = with_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(tidy(rows), "doc_id long, n_pieces long, n_byte_pieces long, ids array<int>, decodes boolean")
