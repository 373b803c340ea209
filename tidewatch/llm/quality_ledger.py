"""Quality rules as a bitmask ledger.

Every rule is measured once per document. The ledger holds the measurements and one bit for each rule that fails. A policy is a
version name and a mask of rules that count; applying one, or finding what it would keep without a single rule, is then arithmetic
on the stored bits and never reads a text again.

Defined cases: a null text counts as empty and fails the base rules; a null doc_id is kept as null; repeated rows each get their
row; an empty table gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import IS_WORD, joined_bytes, per_document, saved, slices, tidy, windows, with_columns, word_hashes, word_spans

REPEAT_WINDOW = 8

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FIRST = np.ones(256, dtype=bool)
_FIRST[0x80:0xC0] = False  # bytes that continue a code point
_WORD_FIRST = IS_WORD & _FIRST

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)


@dataclass(frozen=True)
class Rule:
    """A named test on the measurements; the expression is true where a document fails."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject in it."""

    version: str
    rules: tuple[str, ...]


#: The position of a rule is its bit: rules are only ever appended.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "2 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("shouting", "n_letters >= 100 and 2 * n_upper > n_letters"),
)
BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("2024-1", ("few_words", "repeated_words", "symbols", "duplicate_lines")),
    Policy("2024-2", ("few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "shouting")),
)


def mask_of(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << k for k, r in enumerate(rules)}
    return sum(bits[name] for name in policy.rules)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *_measure(part.column("text"))], ["doc_id", *MEASURES])


def _measured_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("row")
        for part in slices(pa.RecordBatch.from_arrays([rows, rows.field("text")], ["row", "text"]), "text"):
            yield pa.RecordBatch.from_arrays([part.column("row"), *_measure(part.column("text"))], ["row", *MEASURES])


def _measure(texts: pa.Array) -> list[pa.Array]:
    n = len(texts)
    data, offsets = joined_bytes(texts)
    starts, ends, docs = word_spans(data, offsets)
    counts = np.bincount(docs, minlength=n).astype(np.int64)

    def total(table: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(table[data])
        return np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=n).astype(np.int64)

    def running(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    repeated = np.zeros(n, np.int64)
    seen, first = windows(word_hashes(data, starts, ends), docs, REPEAT_WINDOW)
    if len(seen):
        order = np.lexsort((seen, docs[first]))
        same = (seen[order][1:] == seen[order][:-1]) & (docs[first][order][1:] == docs[first][order][:-1])
        twice = np.zeros(len(seen), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        edges = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edges, first[twice], 1)
        np.add.at(edges, first[twice] + REPEAT_WINDOW, -1)
        repeated = per_document((np.cumsum(edges[:-1]) > 0).astype(np.int64), docs, n)

    lines, doubled = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, text in enumerate(texts.to_pylist()):
        full = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        lines[k], doubled[k] = len(full), len(full) - len(set(full))
    values = (counts, running(_WORD_FIRST), total(_SYMBOL), doubled, repeated, lines, total(_UPPER), running(_LETTER))
    return [pa.array(v) for v in values]


def _failed(rules: tuple[Rule, ...]) -> Column:
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules)]
    return reduce(Column.bitwiseOR, bits).cast("long")


def ledger(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and `failed`, in which bit k is set where rule k fails; written to the shared folder. One pass over the
    texts, no shuffle; all policies and ablations read the ledger alone."""
    return saved(with_columns(documents, "doc_id", "text").mapInArrow(tidy(_measured), SCHEMA).withColumn("failed", _failed(rules)), "ledger")


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the policy has its bit set in `failed`."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(policy, rules)).cast("long")) == 0


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents that fail it, and documents that only this rule rejects.

    The ledger is first counted by its bit pattern, of which there are at most 2 ** len(rules).
    """
    patterns = book.groupBy("failed").agg(F.count("*").alias("n"))
    rows = [(p.version, r, mask_of(p, rules), 1 << k) for p in policies for k, r in enumerate(x.name for x in rules) if r in p.rules]
    cases = F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for v, r, m, b in rows)))
    flat = patterns.select("failed", "n", cases.alias("c")).select("failed", "n", "c.*")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failed").bitwiseAND(F.col("mask")) == F.col("bit")
    none = F.col("failed").bitwiseAND(F.col("mask")) == 0
    return flat.groupBy("version", "rule").agg(
        F.sum("n").alias("n_documents"),
        F.sum(F.when(none, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only_this_rule"),
    )


def only_rule(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """The name of the rule that alone rejects a document under the policy, null where none or several do."""
    counted = F.col("failed").bitwiseAND(F.lit(mask_of(policy, rules)).cast("long"))
    return F.coalesce(*(F.when(counted == 1 << k, F.lit(r.name)) for k, r in enumerate(rules)))


def judged(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with the verdict of every policy (kept_<version>), the rule that alone rejects a document under the newest one, and
    how many documents that one would give back if the rule were dropped."""
    newest = policies[-1]
    # a row for each rule of the policy
    gains = ablations(book, (newest,), rules).select(F.col("rule").alias("_rule"), F.col("n_only_this_rule").alias("n_only_rule"))
    versions = [passes(p, rules).alias("kept_" + p.version.replace("-", "_")) for p in policies]
    rows = book.select("*", *versions, only_rule(newest, rules).alias("only_rule"))
    return rows.join(F.broadcast(gains), F.col("only_rule") == F.col("_rule"), "left").drop("_rule")


def keep(documents: DataFrame, policy: Policy = POLICIES[-1]) -> DataFrame:
    """The documents that pass the base rules and the policy, with all their columns; no shuffle."""
    row = documents.select(F.struct("*").alias("row"))
    schema = T.StructType([T.StructField("row", row.schema["row"].dataType), *(T.StructField(m, T.LongType()) for m in MEASURES)])
    book = row.mapInArrow(tidy(_measured_rows), schema).withColumn("failed", _failed(RULES))
    return book.where(passes(BASE) & passes(policy)).select("row.*")
