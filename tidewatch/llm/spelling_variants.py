"""Spelling variants: words at edit distance one, grouped under their commonest form by a symmetric-delete join.

Every word emits itself and each of its single deletions, the latter with the place of the deletion, and rows that share a key meet in
one shuffle. What they share says how far they are apart, with no hash in between: equal keys with equal places are two words that differ by one
replaced character, there and nowhere else; a word's deletion that is itself a word differs by one inserted character, and equal
deletions of one word (within a run of one letter) count once. So counts and best neighbours come from windows over a key instead of
from pairs. A key's rows are bounded by the alphabet: at most (length + 1) x 90 words can lose one character and leave it. The form that is
chosen is verified by its edit distance. Forms then lead to roots by joins that double their step; as each form is
`factor` times commoner, chains are short.

Words: maximal runs of the letters of `RUN`, with A-Z in lower case; a `typos` rule may change a run before it is counted (the test rule
of the query deletes a character of about every 31st).

Defined cases: a null or empty text has no words; a null doc_id is written `null` in the rule's hash; rows that share a doc_id count each; of equally common
near words the smallest in code-point order is the form; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Batches, saved, tidy

RUN = "A-Za-zÀ-ÿ"
#: Different words that a task counts before it sends them on.
FLUSH_WORDS = 400_000
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

Typos = Callable[[int | None], Callable[[str], str]]


def every_31st(doc_id: int | None) -> Callable[[str], str]:
    """A rule: if 31 divides h, the unsigned crc32 of `<doc_id>:<run>`, the run loses its code point h % length."""
    start = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())

    def change(run: str) -> str:
        h = zlib.crc32(run.encode(), start)
        return run if h % 31 else run[: (k := h % len(run))] + run[k + 1 :]

    return change


def word_counts(documents: DataFrame, least_length: int = 7, typos: Typos | None = None) -> DataFrame:
    """word and n of all words of at least so many code points."""
    pattern = re.compile(f"[{RUN}]{{{least_length},}}")  # a shorter run can't become a word, and greedy matches are maximal runs

    def count(batches: Batches) -> Batches:
        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs = Counter(pattern.findall((text.as_py() or "").translate(_LOWER)))
                if typos is None:
                    total.update(runs)
                    continue
                change = typos(doc_id)
                for run, n in runs.items():
                    if len(word := change(run)) >= least_length:
                        total[word] += n
                if len(total) > FLUSH_WORDS:
                    yield send()
                    total.clear()
        yield send()

    texts = documents.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text")).where("text is not null")
    return texts.mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def emissions(words: DataFrame) -> DataFrame:
    """word, n, key, place (from 0; -1 for the word itself) and whether it is the first place that leaves this key."""
    place = F.sequence(F.lit(0), F.length("word") - 1)
    deletion = F.transform(
        place,
        lambda i: F.struct(
            F.concat(F.substring("word", F.lit(1), i), F.substring("word", i + 2, F.length("word"))).alias("key"),
            i.alias("place"),
            ((i == 0) | (F.substring("word", i, F.lit(1)) != F.substring("word", i + 1, F.lit(1)))).alias("first"),
        ),
    )
    itself = F.array(F.struct(F.col("word").alias("key"), F.lit(-1).alias("place"), F.lit(False).alias("first")))
    return words.select("word", "n", F.inline(F.concat(itself, deletion)))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near (how many words differ by exactly one code point) and best (the commonest of them: -n and word)."""
    met = emissions(words).repartition("key")
    this, by_key = F.struct((-F.col("n")).alias("minus_n"), F.col("word").alias("near")), Window.partitionBy("key")
    by_place = Window.partitionBy("key", "place")
    ordered = by_place.orderBy(F.desc("n"), "word")
    rows = met.select(
        "word",
        "n",
        "place",
        "first",
        F.min(F.when(F.col("place") < 0, this)).over(by_key).alias("shorter"),
        F.count_if(F.col("first")).over(by_key).alias("n_longer"),
        F.min(F.when(F.col("first"), this)).over(by_key).alias("longer"),
        (F.count("*").over(by_place) - 1).alias("n_replaced"),
        F.when(F.row_number().over(ordered) == 1, F.lead(this).over(ordered)).otherwise(F.first(this).over(ordered)).alias("replaced"),
    )
    itself = F.col("place") < 0
    found = rows.select(
        "word",
        "n",
        F.when(itself, F.col("n_longer")).otherwise(F.col("n_replaced") + (F.col("first") & F.col("shorter").isNotNull()).cast("long")).alias("found"),
        F.when(itself, F.col("longer")).otherwise(F.least("replaced", F.when(F.col("first"), F.col("shorter")))).alias("best"),
        itself.alias("itself"),
    )
    return found.where("itself or found > 0").groupBy("word").agg(F.max("n").alias("n"), F.sum("found").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root for a table of word and form without circles: each round joins every word's last known form to that form's own, so
    the distance doubles, until no root moves."""
    reached = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = saved(reached.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return reached


def group(documents: DataFrame, least_length: int = 7, least_count: int = 2, factor: int = 10, typos: Typos | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that occurs often enough."""
    words = saved(word_counts(documents, least_length, typos).where(F.col("n") >= least_count), "words")
    common = (-F.col("best.minus_n")) >= F.lit(factor) * F.col("n")
    known = near_words(words).select("word", "n", "n_near", F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.minus_n")).alias("form_n"))
    wrong = F.raise_error(F.concat(F.lit("not at distance one: "), "word", F.lit(" "), "form")).cast("string")
    table = saved(known.withColumn("form", F.when(F.levenshtein("word", "form") != 1, wrong).otherwise(F.col("form"))), "forms")
    led = roots(table.where("form is not null"))
    return table.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
