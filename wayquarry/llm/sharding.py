"""Shards by extendible hashing.

A document's bucket is named by the first bits of a hash of its key. The directory starts with one bucket for
all; a bucket that holds more than ``limit`` bytes splits on its next bit, any other stays whole, until every
bucket fits. Splitting needs bytes by hash prefix only: they are counted once for prefixes of as many bits as
the corpus is likely to need (2^MAX_BITS at most), and the levels above are sums of those. What is too large
even there is counted again with further bits, for those prefixes alone.

Equal keys can't be told apart by more bits. A bucket of one key that is over the limit splits in the same way
on the bits of a hash of its texts, into pages; a page can exceed the limit only where a single text (or one
that is repeated) does. Null keys hash as the empty text; null texts hold no bytes. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

#: Bits of the hash (15 hexadecimal digits of an MD5 sum), and of a directory that is sent to every task (some 50 MB).
HASH_BITS = 60
MAX_BITS = 20
LIMIT = 1 << 20


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _bits_for(total: int, limit: int) -> int:
    """Enough for prefixes of a 64th of the limit each."""
    return max(1, min(MAX_BITS, (64 * total // max(1, limit)).bit_length()))


def _level(rows: DataFrame, base: int, bits: int, limit: int, by: list[str], hashed: str) -> DataFrame:
    """The directory, for each ``by``, of the rows' prefixes of base + bits bits: fine, depth (null: none fits yet), bytes and rows of the bucket, whether its hashes are equal."""
    deep = base + bits
    fine = rows.groupBy(*by, F.shiftright(hashed, HASH_BITS - deep).alias("fine")).agg(
        F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min(hashed).alias("low"), F.max(hashed).alias("high")
    )
    levels = fine.select("*", F.explode(F.sequence(F.lit(base), F.lit(deep))).alias("depth"))
    prefix = F.expr(f"shiftright(fine, {deep} - depth)")
    nodes = levels.groupBy(*by, "depth", prefix.alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    fits = nodes.where((F.col("bytes") <= limit) | (F.col("low") == F.col("high"))).withColumn("one_key", F.col("low") == F.col("high"))
    found = levels.select(*by, "fine", "depth", prefix.alias("prefix")).join(fits, [*by, "depth", "prefix"])
    first = found.groupBy(*by, "fine").agg(F.min(F.struct("depth", "bytes", "rows", "one_key")).alias("bucket"))
    return fine.select(*by, "fine").join(first, [*by, "fine"], "left").select(*by, "fine", "bucket.*")


def _split(rows: DataFrame, limit: int, hashed: str, by: list[str]) -> DataFrame:
    """rows (key, h, n_bytes, t) with depth, bytes, rows and one_key of the bucket of each by the hash's bits."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    base, out = 0, None
    while True:
        bits = min(_bits_for(total, limit), HASH_BITS - base)
        # without by, at most 2^MAX_BITS rows at the first level, and later those that one level left over
        directory = stored(_level(rows, base, bits, limit, by, hashed), "shard-directory")
        prefix = F.shiftright(hashed, HASH_BITS - base - bits)
        placed = rows.withColumn("fine", prefix).join(F.broadcast(directory) if base == 0 and not by else directory, [*by, "fine"])
        part = placed.where("depth is not null").select("key", "h", "n_bytes", "t", "depth", "bytes", "rows", "one_key")
        out = part if out is None else out.union(part)
        base += bits
        if base >= HASH_BITS or directory.where("depth is null").isEmpty():
            return out
        rows = stored(placed.where("depth is null").select("key", "h", "n_bytes", "t"), "shard-keys")


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text", hashes: bool = False) -> DataFrame:
    """Per row of docs: key, shard (its bits, and p with the bits of the page where a key has several), depth, n_bytes, bytes and rows of the bucket or page."""
    own = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    measured = own.select(
        "key",
        key_hash(F.col("key")).alias("h"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        key_hash(F.col("text")).alias("t"),
    )
    out = _split(stored(measured, "shard-keys"), limit, "h", []).withColumn("page", F.lit(""))
    bits = lambda c, n: F.expr(f"substring(lpad(bin({c}), {HASH_BITS}, '0'), 1, {n})")
    over = F.col("one_key") & (F.col("bytes") > limit) & (F.col("rows") > 1)
    large = stored(out.where(over).select("key", "h", "n_bytes", "t", F.col("depth").alias("key_depth")), "shard-pages")
    if not large.isEmpty():
        depths = large.select("h", "key_depth").distinct()
        paged = _split(large.drop("key_depth"), limit, "t", ["h"]).join(depths, "h")
        page = F.when(F.col("depth") > 0, F.concat(F.lit("p"), bits("t", "depth"))).otherwise("")
        paged = paged.withColumn("page", page).withColumn("depth", F.col("key_depth"))
        out = out.where(~over).unionByName(paged.select(*out.columns))
    return out.select(
        F.col("key").alias(key), F.concat(bits("h", "depth"), "page").alias("shard"), F.col("depth").cast("int").alias("depth"), "n_bytes",
        F.col("bytes").alias("bucket_bytes"), F.col("rows").alias("bucket_rows"), *(["h", "t"] if hashes else []),
    )


def write(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text", column: str = "shard") -> None:
    """Writes docs to path, a folder for each shard, named by ``column``; a corpus that fits in one shard is its shard ``all``.

    docs must have no column of that name, which the folders' would replace.
    """
    if column.lower() in map(str.lower, docs.columns):
        raise ValueError(f"the rows have a column {column}; give the folders another one")
    own, (of_key, at) = numbered(docs, key, text)
    of_row = [key_hash(own[f"c{of_key}"]).alias("of_key"), key_hash(own[f"c{at}"]).alias("of_text")]
    shards = assign(docs, limit, key, text, hashes=True).select("h", "t", F.when(F.col("shard") == "", "all").otherwise(F.col("shard")).alias("shard")).distinct()
    named = own.select(*own.columns, *of_row).join(shards, (F.col("of_key") == F.col("h")) & (F.col("of_text") == F.col("t")))
    named.select(*own.columns, "shard").toDF(*docs.columns, column).repartition(column).write.partitionBy(column).parquet(path)
