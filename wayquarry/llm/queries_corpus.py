"""Queries that compare documents with each other: lines (6), fingerprints (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines, simhash
from .common import table


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lines.report(docs).withColumnRenamed("doc_id", "of_doc")
    own = docs.select("doc_id", lines.text_hash(F.col("text")).alias("own_t"))
    return own.join(found, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("own_t") == F.col("t")), "left").select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


QUERIES = {"op6_lines": op6_lines, "op9_simhash": op9_simhash}
ORACLE_SQL: dict[str, str] = {}
