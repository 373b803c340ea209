"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of all characters over its own share. A document is repeated a Poisson
number of times with that mean: a hash of the seed and the doc_id gives a uniform number, which the source's distribution function
inverts. The copies are then dealt out by a hash of their own, a global shuffle. Nothing is drawn at random, so a lost task is
computed again with the same result.

Defined cases: a null source is a source of its own; sources without a named weight get the default; a source without any character
keeps its documents once on average (rate 1); a null doc_id is hashed as a word of its own; rows that share a doc_id share their
count; an empty table gives no rows. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

#: Bytes of the rate table (sources and distributions) up to which it is broadcast.
BROADCAST_BYTES = 4 << 20
SALTS = 32


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 sum of the parts."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_distribution(mean: Column) -> Column:
    """The distribution function at 0, 1, 2, ... as far as a double can tell it from 1."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    empty = F.struct((-mean).alias("log_mass"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("sums"))

    def step(state: Column, k: Column) -> Column:
        log_mass = state["log_mass"] + F.when(k > 0, F.ln(mean) - F.ln(k.cast("double"))).otherwise(0.0)
        total = state["sum"] + F.exp(log_mass)
        return F.struct(log_mass.alias("log_mass"), total.alias("sum"), F.array_append(state["sums"], total).alias("sums"))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(0), top), empty, step, lambda state: state["sums"])).otherwise(F.array(F.lit(1.0)))


def repetition_rates(documents: DataFrame, weights: dict[str, float], default_weight: float = 1.0, size: float = 1.0) -> DataFrame:
    """source and rate; `size` is the length of the mixture in lengths of the input."""
    chars = documents.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    named = F.coalesce(*(F.when(F.col("source") == k, F.lit(float(w))) for k, w in weights.items()), F.lit(float(default_weight)))
    rows = chars.withColumn("weight", F.when(F.col("chars") > 0, named).otherwise(0.0))
    total = rows.agg(F.sum("weight").alias("all_weight"), F.sum("chars").alias("all_chars"))  # one row
    rate = F.when(F.col("chars") > 0, F.col("weight") / F.col("all_weight") * F.col("all_chars") / F.col("chars") * F.lit(float(size))).otherwise(1.0)
    return rows.crossJoin(F.broadcast(total)).select("source", rate.alias("rate"))


def mix(documents: DataFrame, weights: dict[str, float], default_weight: float = 1.0, size: float = 1.0, seed: str = "mix") -> DataFrame:
    """The columns of documents with copy (from 1), n_copies and shuffle_key, dealt out and sorted by shuffle_key within partitions."""
    rates = repetition_rates(documents, weights, default_weight, size)
    table = saved(rates.select(F.col("source").alias("_source"), poisson_distribution(F.col("rate")).alias("_distribution")), "rates")
    row = documents.select(F.struct("*").alias("_row"), F.col("source").alias("_s"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"))
    size = F.octet_length(F.coalesce("_source", F.lit(""))) + 8 * F.size("_distribution") + 64
    if (table.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES:
        joined = row.join(F.broadcast(table), F.col("_s").eqNullSafe(F.col("_source")))
    else:  # a source may hold a third of all rows: deal each out over SALTS keys
        salted = row.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
        spread = table.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        joined = salted.join(spread, F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_salt2")))
    u = uniform(seed, "count", F.col("_id"))
    counted = joined.select("_row", "_id", u.alias("_u"), "_distribution")
    counted = counted.select("_row", "_id", F.size(F.filter("_distribution", lambda p: p <= F.col("_u"))).cast("long").alias("n_copies")).where("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    key = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("_id"), F.col("copy").cast("string"))), 1, 16)
    dealt = copies.select("_row", "copy", "n_copies", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    own = {"copy", "n_copies", "shuffle_key"}
    return dealt.select(*(F.col("_row").getField(c).alias(c) for c in documents.columns if c not in own), "copy", "n_copies", "shuffle_key")


MIX_SQL = """
WITH chars AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars FROM {documents} GROUP BY source),
weighted AS (SELECT source, chars, CASE WHEN chars > 0 THEN {weight} ELSE 0.0::DOUBLE END AS weight FROM chars),
rates AS (SELECT source, CASE WHEN chars > 0 THEN weight / (SELECT sum(weight) FROM weighted) * (SELECT sum(chars)::BIGINT FROM weighted) / chars * {size}::DOUBLE ELSE 1.0::DOUBLE END AS rate FROM weighted),
mass AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rates, range(0, 200) t(k)),
distribution AS (SELECT source, list(c ORDER BY k) AS cs FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM mass) GROUP BY source),
counted AS (
  SELECT d.*, len(list_filter(cs, lambda c: c <= CAST('0x' || substr(md5('{seed}:count:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0)) AS n_copies
  FROM {documents} d JOIN distribution r ON d.source IS NOT DISTINCT FROM r.source),
copies AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM counted WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy, n_copies::BIGINT AS n_copies,
  substr(md5('{seed}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 16) AS shuffle_key
FROM copies
"""
