"""Bounded, repeatable samples of labelled rows, and the folds that the queries hold out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

STEPS = 1_000_000
#: How far over its size a sample may be: a hash takes about as many as asked for.
ROOM = 1.25


def crc_mod(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def per_class(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows of each label at most (all where there are fewer), by a hash of the key.

    rows: few columns, since it is read twice; the labels are counted first, one row each.
    """
    counts = {r[label]: r["n"] for r in rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.where("false")
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(STEPS))
    share = F.lit(0)
    for value, n in sorted(counts.items(), key=str):
        share = F.when(F.col(label) == value, F.lit(int(STEPS * min(1.0, most / n)))).otherwise(share)
    return rows.where(F.col(label).isNotNull() & (place < share))


def bounded(rows: DataFrame, label: str, most: int) -> tuple[DataFrame, dict, dict]:
    """rows: key, text and label of chosen keys, any number of rows a key. About ``most`` different ones of each label at most.

    A key may stand in any number of rows, so choosing keys bounds nothing: the different (key, text, label) are stored, counted by label,
    and chosen by a hash of key and text. Returns them, and by label how many there were and how many are left.
    """
    different = stored(rows.withColumn("t", F.xxhash64("text")).dropDuplicates(["key", "t", label]), "sample")
    sizes = lambda df: {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    there = sizes(different)
    if all(n <= ROOM * most for n in there.values()):
        return different.drop("t"), there, there
    place = F.pmod(F.xxhash64("key", "t", F.lit(2)), F.lit(STEPS))
    share = F.lit(0)
    for value, n in sorted(there.items(), key=str):
        share = F.when(F.col(label) == value, F.lit(int(STEPS * (1.0 if n <= ROOM * most else most / n)))).otherwise(share)
    taken = different.where(place < share).drop("t")
    return taken, there, sizes(taken)
