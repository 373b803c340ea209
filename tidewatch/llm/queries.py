"""The operators applied to the test tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, mixing, multi_index, piece_viterbi, pii_bootstrap, quality_ledger, secret_ownership, spelling_variants, style_tree, suffix_dedup, token_blocks, token_scan, whitening

#: The large first source counts four times as much as any other.
MIX_WEIGHTS = {"src0": 4.0}
END_ID = 2
FLAT_END_ID = 50256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = token_blocks.write_token_file(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_blocks.read_token_file(file)


def op3_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_viterbi.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_ledger.judged(quality_ledger.ledger(_table(spark, sf_dir, "documents")))
    verdicts = [(~F.col("kept_base")).alias("base_failed"), (F.col("kept_base") & F.col("kept_2024_2")).alias("kept")]
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *verdicts, "failed", "kept_2024_1", "only_rule", "n_only_rule")


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ownership.scan(_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.scan(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op10_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, FLAT_END_ID)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(_table(spark, sf_dir, "pages"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group(_table(spark, sf_dir, "documents"), typos=spelling_variants.every_31st)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_blocks": op2_token_blocks,
    "op3_piece_viterbi": op3_piece_viterbi,
    "op4_quality_ledger": op4_quality_ledger,
    "op5_secret_ownership": op5_secret_ownership,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_multi_index": op7_multi_index,
    "op8_pii_bootstrap": op8_pii_bootstrap,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_scan": op10_token_scan,
    "op11_whitening": op11_whitening,
    "op12_style_tree": op12_style_tree,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": pipeline,
}

#: Words are split as in the operator; a window is named by its eight words.
QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
positions AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM d WHERE len(ws) >= 8),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS w FROM positions),
twice AS (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM twice GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
line_counts AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters
  FROM d LEFT JOIN repeated USING (doc_id) LEFT JOIN line_counts USING (doc_id)),
bits AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END
    + CASE WHEN n_letters >= 100 AND 2 * n_upper > n_letters THEN 32 ELSE 0 END)::BIGINT AS failed
  FROM counted)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed, failed & 15 = 0 AS kept_2024_1,
  CASE failed WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines' WHEN 16 THEN 'long_words' WHEN 32 THEN 'shouting' END AS only_rule,
  CASE WHEN failed IN (1, 2, 4, 8, 16, 32) THEN count(*) OVER (PARTITION BY failed) END::BIGINT AS n_only_rule
FROM bits
"""

#: The crc32 is taken byte by byte over a table that is made by its rule.
SPELLING_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT d, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY d, run),
hashed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(d || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, crc),
changed AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(length(word))) AS p FROM words),
deletions AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS key FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM deletions a JOIN deletions b USING (key, p) WHERE a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM deletions d JOIN words w ON d.key = w.word
  UNION SELECT w.word, d.word, d.n FROM deletions d JOIN words w ON d.key = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END::BIGINT AS form_n
  FROM words LEFT JOIN best USING (word)),
led AS (
  SELECT word, form AS at FROM forms WHERE form IS NOT NULL
  UNION SELECT led.word, forms.form FROM led JOIN forms ON forms.word = led.at WHERE forms.form IS NOT NULL),
ends AS (SELECT led.word, led.at AS root FROM led JOIN forms ON forms.word = led.at WHERE forms.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
"""

_WEIGHT = "CASE " + " ".join(f"WHEN source = '{k}' THEN {w}::DOUBLE" for k, w in MIX_WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"

ORACLES = {
    "op1_mix_sources": mixing.MIX_SQL.format(documents="documents", weight=_WEIGHT, size=1.0, seed="mix"),
    "op4_quality_ledger": QUALITY_SQL,
    "op13_spelling_variants": SPELLING_SQL,
}
