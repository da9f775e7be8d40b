"""Queries over single documents: tokens (1, 2), quality (3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, quality, tokenfile
from .bpe import encode
from .common import scratch, small_batches, stored, table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, vocabulary_path(), decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path, vocabulary_path())
    return tokenfile.read(spark, path)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ledger(table(spark, sf_dir, "documents"))
    return quality.apply_policy(found, quality.V2).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        quality.failed(quality.BASE).alias("base_failed"),
        "kept",
        "fail_bits",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, alone and with others, from the stored ledger."""
    with small_batches(spark):
        found = stored(quality.ledger(table(spark, sf_dir, "documents")), "quality-ledger")
    return quality.ablation(found)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        (F.size("item_ids") + F.col("unnamed").cast("int")).cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op1_bpe": op1_bpe, "op2_tokenfile": op2_tokenfile, "op3_quality": op3_quality, "quality_ablation": quality_ablation, "op10_decontaminate": op10_decontaminate}

# white space as in the contract; lines with a word are those that have anything else
OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT doc_id, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w, t,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines
  FROM d),
windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS win FROM words, unnest(range(1, len(w) - 3)) AS r(i) WHERE len(w) >= 5),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(5)) AS r(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeats USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits
FROM b
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win, least(10, len(w)) AS n
      FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM p),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM d, sizes, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS r(i)),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN p USING (win, n)),
cover AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_hit FROM hit, unnest(range(n)) AS r(k) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS found FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(found), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(found, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ABLATION_SQL = f"""
WITH ledger AS ({OP3_SQL}),
p AS (SELECT unnest(['base', 'v1', 'v2']) AS version, unnest([3, 15, 63]) AS mask), r AS (SELECT unnest(['too_few_words', 'repeated_words', 'symbols', 'repeated_lines', 'short_words', 'long_words']) AS rule, unnest([1, 2, 4, 8, 16, 32]) AS bit)
SELECT version, rule, count(*) AS n_docs, count(*) FILTER (WHERE fail_bits & bit <> 0) AS n_failed, count(*) FILTER (WHERE fail_bits & mask = bit) AS n_failed_only_here, count(*) FILTER (WHERE fail_bits & mask <> 0) AS n_rejected
FROM ledger, p, r WHERE mask & bit <> 0 GROUP BY ALL"""

ORACLE_SQL = {"op3_quality": OP3_SQL, "quality_ablation": ABLATION_SQL, "op10_decontaminate": OP10_SQL}
