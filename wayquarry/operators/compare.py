"""Comparing JSON documents by their paths: whatever the order of keys, without ids, and with the places where they differ.

A document is taken apart level by level into rows of a path (an array of keys; #0, #1, .. in arrays) and a value. Objects and arrays
have a row of their own ("{" or "[" with the length), so an empty one isn't an absent one; null is a value, absent is none. Numbers that are
equal are the same however they are written. Two documents are equal if they have the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Keys that say nothing about what a document holds.
IDS = ("id", "__component")


def _value(v: Column, kind: Column) -> Column:
    number = F.try_variant_get(v, "$", "double")
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number.cast("string")).otherwise(F.to_json(v))


def leaves(documents: DataFrame, key: str, json: str, ids: Sequence[str] = IDS) -> DataFrame:
    """key, path and value of each value of the documents (JSON texts). Texts that can't be read, and null, have no rows. Keys of rows must be unique."""
    spark = documents.sparkSession
    level = documents.select(F.col(key).alias("key"), F.array().cast("array<string>").alias("path"), F.try_parse_json(json).alias("v")).where("v is not null")
    found = []
    while True:
        kinds = level.withColumn("kind", F.schema_of_variant("v"))
        is_object, is_array = F.startswith("kind", F.lit("OBJECT")), F.startswith("kind", F.lit("ARRAY"))
        length = F.size(F.try_variant_get("v", "$", "array<variant>"))
        own = F.when(is_object, F.lit("{")).when(is_array, F.concat(F.lit("["), length.cast("string"))).otherwise(_value(F.col("v"), F.col("kind")))
        own = F.coalesce(own, F.lit("null"))
        level = stored(kinds.select("key", "path", own.alias("value"), F.when(is_object | is_array, F.col("v")).alias("v")), "json-level")
        found.append(level.select(F.col("key").alias(key), "path", "value"))
        inner = level.where("v is not null")
        if inner.isEmpty():  # as many rounds as the deepest document has levels
            break
        parts = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("name"), F.col("value").alias("inner")))
        level = parts.where(F.col("name").isNull() | ~F.col("name").isin(*ids)).select("key", F.concat("path", F.array(F.coalesce("name", F.concat(F.lit("#"), F.col("pos").cast("string"))))).alias("path"), F.col("inner").alias("v"))
    return reduce(DataFrame.union, found)


def fingerprints(documents: DataFrame, key: str, json: str, ids: Sequence[str] = IDS) -> DataFrame:
    """key and two hashes that are equal for equal documents, in whatever order their rows come. Null for those that can't be read."""
    rows = leaves(documents, key, json, ids)
    hashes = rows.groupBy(key).agg(*[F.bit_xor(F.xxhash64("path", "value", F.lit(k))).alias(f"hash{k}") for k in (0, 1)])
    return documents.select(key).join(hashes, key, "left")


def differences(before: DataFrame, after: DataFrame, key: str, json: str, ids: Sequence[str] = IDS) -> DataFrame:
    """key, path (keys joined by dots), before and after of each path at which two documents of a key differ; null where a path is absent.

    Documents whose hashes are equal aren't compared further. A key on one side only has all its paths.
    """
    a, b = stored(leaves(before, key, json, ids), "json-before"), stored(leaves(after, key, json, ids), "json-after")
    hashed = lambda df, name: df.groupBy(key).agg(F.struct(*[F.bit_xor(F.xxhash64("path", "value", F.lit(k))) for k in (0, 1)]).alias(name))
    other = hashed(a, "h").join(hashed(b, "i"), key, "full_outer").where(~F.col("h").eqNullSafe(F.col("i"))).select(key)
    both = a.join(other, key, "left_semi").withColumnRenamed("value", "before").join(b.join(other, key, "left_semi").withColumnRenamed("value", "after"), [key, "path"], "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(key, F.array_join("path", ".").alias("path"), "before", "after")
