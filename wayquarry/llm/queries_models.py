"""Queries that learn from the corpus (4, 5, 8), and sharding (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import katz, language, sharding, toxicity
from .common import table
from .sampling import crc_mod


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = language.fit(docs.where(~held_out))
    found = language.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_katz": op4_katz, "op5_toxicity": op5_toxicity, "op7_sharding": op7_sharding, "op8_language": op8_language}

OP7_SQL = """
WITH rows AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
         coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
levels AS (SELECT doc_id, h, n_bytes, d, h >> (60 - d)::BIGINT AS p FROM rows, unnest(range(0, 61)) AS r(d)),
nodes AS (SELECT d, p, sum(n_bytes)::BIGINT AS bucket_bytes, count(*)::BIGINT AS bucket_rows, min(h) = max(h) AS one_key FROM levels GROUP BY d, p),
leaves AS (SELECT doc_id, h, n_bytes, min(d) AS depth FROM levels JOIN nodes USING (d, p) WHERE bucket_bytes <= 1048576 OR one_key GROUP BY ALL)
SELECT doc_id, substr(lpad(format('{:b}', h), 60, '0'), 1, depth) AS shard, depth::INTEGER AS depth, n_bytes, bucket_bytes, bucket_rows
FROM leaves JOIN nodes ON d = depth AND p = h >> (60 - depth)::BIGINT
"""

ORACLE_SQL = {"op7_sharding": OP7_SQL}
