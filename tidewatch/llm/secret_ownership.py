"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Base spans are found by three patterns. Besides, every long token that mixes letters and digits is a candidate. The values of all
candidates are hashed, and for each hash the corpus gives the number of different repositories and owners that hold it. A value
copied by many owners or into many repositories is an example from documentation; one that only few of both hold, and whose characters
look drawn at random, is taken for a live credential, and its occurrences outside the base spans become spans of the kind `live`.

An owner is a document's source, a repository a source and language.

A text's matches and the gaps between them come out of one pass each and become rows. Where they start is a running sum over the rows of
a text, and what lies free of the base spans is told by running extremes, so the work is linear in a text's matches but for a sort, and
a text that is one dump of keys costs no more than its length. Rows that share doc_id and text are counted first and looked at once.

Defined cases: a null text counts as empty; a null source or language is an owner or repository of its own; rows that share doc_id
and text share their spans, and each keeps its row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import salted_join, saved

#: Fixed values of the base rule.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "live")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"
MAX_LIVE_OWNERS = 2
MAX_LIVE_REPOSITORIES = 4
MIN_DIFFERENT_CHARS = 10

#: Shares over which a value that very many documents hold is dealt.
SALTS = 32
_KEY = ("_id", "_text")


def matches(text: Column, pattern: str, rank: int) -> Column:
    """The leftmost non-overlapping matches of a kind as (rank, i, gap, length, value): each with the length of the text since the one before."""
    whole, gap = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = (lambda w: F.regexp_extract(w, pattern, 2)) if rank == 0 else (lambda w: w)
    rows = F.transform(F.arrays_zip(whole.alias("w"), gap.alias("g")), lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["w"]).alias("length"), value(x["w"]).alias("value")))
    found = F.filter(rows, lambda x: x["length"].isNotNull())  # the last gap has no match behind it
    return F.when(F.regexp_like(text, F.lit(pattern)), found)


def rendered(found: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas; found has (start, rank, end)."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(found), lambda x: F.concat_ws(":", F.element_at(kind, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def extract(documents: DataFrame) -> DataFrame:
    """_id, _text (a hash), owner, repository and the matches of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_text"), F.col("source").alias("owner"), F.struct("source", "lang").alias("repository"), text.alias("text"))
    kinds = (ASSIGN, ACCESS, HEX, CANDIDATE)
    none = F.array().cast("array<struct<rank:int,i:int,gap:int,length:int,value:string>>")
    return docs.select("_id", "_text", "owner", "repository", F.concat(*(F.coalesce(matches(F.col("text"), p, k), none) for k, p in enumerate(kinds))).alias("matches"))


def placed(seen: DataFrame) -> DataFrame:
    """_id, _text, rank, start, end, value of the base spans and of the further candidates that are free of them, once for each text."""
    each = seen.select(*_KEY, F.inline("matches")).distinct().repartition(*_KEY)
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy(*_KEY, "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    spans = each.select(*_KEY, "rank", (end - F.col("length")).alias("start"), end.alias("end"), "value").where((F.col("rank") != 0) | (F.length("value") >= 6))
    spans = spans.where((F.col("rank") < 3) | (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")))
    # of equal starts the base spans come first, so a candidate has those that start with it before it; both windows run forwards, as only
    # such are added up row by row
    base, so_far = F.col("rank") < 3, (Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(base, F.col("end"))).over(Window.partitionBy(*_KEY).orderBy("start", "rank", "end").rowsBetween(*so_far))
    ahead = F.min(F.when(base, F.col("start"))).over(Window.partitionBy(*_KEY).orderBy(F.desc("start"), F.desc("rank"), F.desc("end")).rowsBetween(*so_far))
    free = F.coalesce(reach <= F.col("start"), F.lit(True)) & F.coalesce(ahead >= F.col("end"), F.lit(True))
    return spans.withColumn("free", free).where(base | F.col("free")).select(*_KEY, "rank", "start", "end", "value")


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, n_repositories, n_owners. Both counts are made of distinct rows, combined before each shuffle, so that a value in a third of all documents costs no more than one row for each owner and task."""
    # a null owner counts as one: struct() is never null
    pairs = candidates.select("value_hash", F.struct("owner").alias("owner"), "repository").distinct()
    return pairs.groupBy("value_hash", "owner").agg(F.count("*").alias("n")).groupBy("value_hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_example (values of the document judged so), n_repositories and n_owners (the most that hold one of its values)."""
    seen = saved(extract(documents), "secrets")
    found = saved(placed(seen.where(F.size("matches") > 0)).withColumn("value_hash", F.sha2("value", 256)), "secret-spans")
    holding = seen.where(F.size("matches") > 0).select(F.col("_id").alias("i"), F.col("_text").alias("t"), "owner", "repository").distinct()
    each = found.select(*_KEY, "value_hash").distinct().join(holding, F.col("_id").eqNullSafe(F.col("i")) & (F.col("_text") == F.col("t")))
    # a value that a third of all documents hold is one key of this join
    judged = salted_join(found, ownership(each), ["value_hash"], [*_KEY], salts=SALTS)
    rare = (F.col("n_owners") <= MAX_LIVE_OWNERS) & (F.col("n_repositories") <= MAX_LIVE_REPOSITORIES)
    live = rare & (F.size(F.array_distinct(F.split("value", ""))) >= MIN_DIFFERENT_CHARS)
    judged = judged.select(*_KEY, "rank", F.struct("start", "rank", "end").alias("x"), "value_hash", live.alias("live"), (~rare).alias("example"), "n_repositories", "n_owners")
    base = F.col("rank") < 3
    texts = judged.groupBy(*_KEY).agg(
        *(F.count_if(F.col("rank") == k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])),
        F.sha2(rendered(F.collect_list(F.when(base, F.col("x")))), 256).alias("base_sha256"),
        rendered(F.collect_list(F.when(base | F.col("live"), F.col("x")))).alias("spans"),
        F.size(F.collect_set(F.when(F.col("live"), F.col("value_hash")))).cast("long").alias("n_live"),
        F.size(F.collect_set(F.when(F.col("example"), F.col("value_hash")))).cast("long").alias("n_example"),
        F.max("n_repositories").alias("n_repositories"),
        F.max("n_owners").alias("n_owners"),
    )
    texts = texts.withColumnsRenamed({k: f"{k}2" for k in _KEY})
    # every document, those of one doc_id and text as one row with their number
    rows = seen.groupBy(*_KEY).agg(F.count("*").alias("n_rows"))
    out = rows.join(texts, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_text") == F.col("_text2")), "left")
    nothing = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_assign", "n_access", "n_hex", "n_live", "n_example", "n_repositories", "n_owners")}
    out = out.withColumns(nothing | {"base_sha256": F.coalesce("base_sha256", F.sha2(F.lit(""), 256)), "spans": F.coalesce("spans", F.lit("")), "again": F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))})
    return out.select(F.col("_id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example", "n_repositories", "n_owners")
