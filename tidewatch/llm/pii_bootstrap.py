"""Personal data, with contextual patterns bootstrapped from the data found.

Base kinds are found by pattern, and each base span is one instance and a seed. Outside of them, every token that looks like an
identifier (six digits or more, or an @) is an instance, and so is a run of number tokens with six digits or more. The two words before
an instance's start are its context and the outline of its characters is its shape; these are two patterns. Spark then scores the graph
of patterns and instances in turn: a pattern's confidence is the mean score of its different instances, an instance's score is what its
patterns make of it together (noisy-or, in which shapes count half, so that a shape alone finds nothing). A pattern counts if enough
different instances support it, seeds or such as earlier rounds have found. Instances that follow a context of high confidence become
spans of the kind `context`.

Defined cases: a null text counts as empty; rows that share doc_id and text share their spans, and each keeps its row; null doc_ids
stay; an empty table gives no rows; other columns are ignored by scan() and kept by redact().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import salted_join, saved, slices, tidy

KINDS = ("email", "ip", "card", "phone")
ADDED = "context"
ROUNDS = 3
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.8
SHAPE_WEIGHT = 0.5

#: Fixed values of the base rule. An ip cannot begin within a run of digits that an earlier start of the run has failed on.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_INSTANCE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_EDGE = "\"'()[]{}<>,;:!?.|"
_SPACE = frozenset("\x20\x09\x0A\x0B\x0C\x0D")
#: A token of a number's run.
_NUMBER = re.compile(r"[+(]*[0-9][0-9().+/-]*")
_DIGIT_RUN, _LETTER_RUN = re.compile("[0-9]+"), re.compile("[A-Za-z]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def words_before(text: str, at: int) -> str:
    """The two words before a place, in lower case and without marks at their edges; words of marks alone don't count."""
    words: list[str] = []
    while at > 0 and len(words) < 2:
        end = at
        while end > 0 and text[end - 1] in _SPACE:
            end -= 1
        at = end
        while at > 0 and text[at - 1] not in _SPACE:
            at -= 1
        if word := text[at:end].strip(_EDGE):
            words.append(word.lower())
    return " ".join(reversed(words))


def free_instances(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the tokens and runs of number tokens outside the base spans that look like identifiers. A run is whole however
    long: number tokens with one character of white space and nothing else between them, six digits or more in all."""
    first, last, total = 0, -1, 0  # the run: its start and end, and its digits
    k, reach = 0, 0
    for m in _INSTANCE.finditer(text):
        token = m[0]
        core = token.strip(_EDGE)
        start = m.start() + len(token) - len(token.lstrip(_EDGE))
        end = start + len(core)
        while k < len(base) and base[k][0] < end:
            reach = max(reach, base[k][2])
            k += 1
        digits, close = sum(c.isdigit() for c in core), False
        # a number keeps the bracket that it begins with
        if start < reach:
            number = False
        elif number := bool(_NUMBER.fullmatch(core)):
            start -= token[: start - m.start()].endswith("(")
            close = token[end - m.start() :].startswith(")")
        if not (number and total and m.start() == last + 1 and start == m.start()):
            if total >= 6:
                yield first, last
            first, total = start, 0
        if number:
            last, total = end + close, total + digits
        elif start >= reach and (digits >= 6 or "@" in core):
            yield start, end
    if total >= 6:
        yield first, last


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str, str, bool]]:
    """(start, end, context, shape, value hash, seed) of the base spans and of what else looks like an identifier."""
    out = []
    for found, seed in (([(start, end) for start, _, end in base], True), (free_instances(text, base), False)):
        for start, end in found:
            core = text[start:end]
            shape = _LETTER_RUN.sub("a", _DIGIT_RUN.sub("9", core))
            out.append((start, end, words_before(text, start), shape, hashlib.md5(core.encode("utf-8", "surrogatepass")).hexdigest(), seed))
    return out


_BASE = "array<struct<start:int,rank:int,end:int>>"
_MORE = "array<struct<start:int,end:int,context:string,shape:string,value:string,seed:boolean>>"
_BASE_TYPE = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())])
_MORE_TYPE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("context", pa.string()), ("shape", pa.string()), ("value", pa.string()), ("seed", pa.bool_())])


def _lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """A list array of structs from tuples in the order of the struct's fields."""
    columns = zip(*chain.from_iterable(rows), strict=True) if any(rows) else [()] * len(kind)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)


def _tuples(column: pa.ListArray) -> list[list[tuple]]:
    """The rows of a list array of base spans; a null has none."""
    values, cuts = column.values, column.offsets.to_numpy()
    every = list(zip(*(values.field(f.name).to_pylist() for f in _BASE_TYPE), strict=True))
    return [every[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _with_texts(batch: pa.RecordBatch, *others: str) -> Iterator[pa.RecordBatch]:
    """Slices with a column `text`, which stands in `row` where there is one."""
    text = batch.column("row").field("text") if "row" in batch.schema.names else batch.column("text")
    yield from slices(pa.RecordBatch.from_arrays([text, *(batch.column(c) for c in others)], ["text", *others]), "text")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        carried = [c for c in batch.schema.names if c != "text"]
        for part in _with_texts(batch, *carried):
            texts = [t or "" for t in part.column("text").to_pylist()]
            spans = [base_spans(t) for t in texts]
            more = [instances(t, s) for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), _lists(spans, _BASE_TYPE), _lists(more, _MORE_TYPE)], [*carried, "base", "more"])


def find(documents: DataFrame, rows: bool = False) -> DataFrame:
    """doc_id, text_hash, base spans and instances of every document, written to the shared folder; with `rows`, whole rows go along,
    so that what follows needs no second look at the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash")]
    docs = documents.select(*keys, F.struct("*").alias("row") if rows else text.alias("text"))
    carried = [f for f in docs.schema if f.name != "text"]
    schema = T.StructType([*carried, T.StructField("base", T.DataType.fromDDL(_BASE)), T.StructField("more", T.DataType.fromDDL(_MORE))])
    return saved(docs.mapInArrow(tidy(_find), schema), "pii")


def confident_contexts(edges: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """context and confidence, from edges (context, shape, value, seed).

    Each round is two joins and two sums over the edges; sums combine before they shuffle, and large join partitions can be split.
    """
    both = F.array(F.struct(F.lit("context").alias("kind"), F.col("context").alias("pattern")), F.struct(F.lit("shape").alias("kind"), F.col("shape").alias("pattern")))
    each = edges.select("value", F.col("seed").cast("double").alias("seed"), F.explode(both).alias("p")).select("p.kind", "p.pattern", "value", "seed")
    graph = saved(each.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    seeds = graph.groupBy("value").agg(F.max("seed").alias("seed"))
    graph = saved(graph.select("kind", "pattern", "value").join(seeds, "value"), "pii-graph")
    scores = graph.select("value", F.col("seed").alias("score")).distinct()
    patterns = None
    for k in range(rounds):
        scored = graph.join(scores, "value")
        # instances that earlier rounds found support a pattern as seeds do
        patterns = scored.groupBy("kind", "pattern").agg(F.avg("score").alias("confidence"), F.count_if(F.col("score") >= min_confidence).alias("n_support"))
        patterns = saved(patterns.where(F.col("n_support") >= min_support), "pii-patterns")
        if k + 1 < rounds:
            says = F.least(F.col("confidence"), F.lit(0.999)) * F.when(F.col("kind") == "shape", SHAPE_WEIGHT).otherwise(1.0)
            doubt = F.exp(F.sum(F.ln(1 - says)))
            reached = salted_join(graph, patterns, ["kind", "pattern"], ["value"]).groupBy("value").agg((1 - doubt).alias("reached"))
            scores = saved(seeds.join(reached, "value", "left").select("value", F.greatest("seed", F.coalesce("reached", F.lit(0.0))).alias("score")), "pii-scores")
    return patterns.where((F.col("kind") == "context") & (F.col("confidence") >= min_confidence)).select(F.col("pattern").alias("context"), "confidence")


def added_spans(found: DataFrame) -> DataFrame:
    """_id, _text and extra: spans that the confident contexts add to a document, outside its base spans."""
    each = found.select("doc_id", "text_hash", F.explode("more").alias("x")).select("doc_id", "text_hash", "x.*")
    contexts = confident_contexts(each.select("context", "shape", "value", "seed"))
    hits = salted_join(each.where(~F.col("seed")), contexts, ["context"], ["doc_id", "start"], "left_semi")
    span = F.struct(F.col("start"), F.lit(len(KINDS)).alias("rank"), F.col("end"))
    return saved(hits.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).agg(F.collect_set(span).alias("extra")), "pii-added")


def _same(doc_id: str, text_hash: str):
    return F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col(text_hash) == F.col("_text"))


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_context."""
    found = find(documents)
    out = found.select("doc_id", "text_hash", "base").join(added_spans(found), _same("doc_id", "text_hash"), "left")
    names = F.array(*map(F.lit, (*KINDS, ADDED)))
    extra = F.coalesce("extra", F.array().cast("array<struct<start:int,rank:int,end:int>>"))

    def text(spans):
        return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    # by difference, as a second argument of a filter's lambda would be the place in the array
    ranks = F.transform("base", lambda x: x["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", extra)).alias("spans"), F.size(extra).cast("long").alias("n_context"))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    for start, rank, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{(*KINDS, ADDED)[rank].upper()}>"]
        at = max(at, end)
    return "".join((*out, text[at:]))


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _with_texts(batch, "row", "base", "extra"):
            texts = part.column("text").to_pylist()
            for k, (base, extra) in enumerate(zip(_tuples(part.column("base")), _tuples(part.column("extra")), strict=True)):
                if base or extra:
                    texts[k] = redacted(texts[k], base + extra)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def redact(documents: DataFrame) -> DataFrame:
    """The documents with personal data replaced; all columns are kept, and n_chars follows the text.

    Every text is looked through once: the rows are written with what was found in them, and only they are read afterwards.
    """
    found = find(documents, rows=True)
    rows = found.select("row", "base", "doc_id", "text_hash").join(added_spans(found), _same("doc_id", "text_hash"), "left").select("row", "base", "extra")
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("text", T.StringType())])
    out = rows.mapInArrow(tidy(_redact), schema)
    n_chars = F.col("row.n_chars") if "n_chars" in documents.columns else F.lit(None)
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("text").eqNullSafe(F.col("row.text")), n_chars).otherwise(F.length("text").cast("long"))}
    return out.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns))
