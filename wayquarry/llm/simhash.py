"""SimHash near-duplicates with BK-trees.

``fingerprint`` reads each text once. ``components`` works on distinct fingerprints: those that differ in at
most two bits agree on one of three blocks of bits at least, so a shard is all fingerprints with the same
value of one block. Each shard's BK-tree (children keyed by their integer Hamming distance to the parent) is
built and searched within one task, following only edges within the radius. The trees are not broadcast: all
of them together grow with the corpus, so they have no proven bound, and a shard's queries are its own members.

No shard grows beyond a bound: one of more than MAX_SHARD fingerprints is dealt anew by the values of three
parts of its remaining bits, which must agree in one part again, down to LEVELS levels, where so many bits
are shared that a shard can't hold more than 2^13 different fingerprints. A shard yields the links of a
spanning forest rather than all its pairs. Links then go through rounds of large-star and small-star steps,
each written to the shared folder, until nothing changes.

Null and empty texts have the fingerprint zero, which links like any other. A fingerprint is computed for each
row, so repeated rows and documents that share a doc_id link to each other; rows with a null doc_id count in
the links, but never name a component unless it holds nothing else. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, pieces, stored, texts

RADIUS = 2
SHINGLE = 3
SEED = 42
MAX_SHARD = 4096
LEVELS = 4


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(size, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - last].tolist(), ends[last:].tolist())], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, t (a hash of the text) and ``fp`` (long; the 64 bits as a signed number)."""
    own = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("t"), docs[text].alias("text"))
    schema = T.StructType([*own.schema.fields[:2], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [simhash(shingle_hashes(x)) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["key", "t", "fp"])

    return own.mapInArrow(run, schema).withColumnRenamed("key", key)


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Indices of the values within the radius: follows edges from distance - radius to distance + radius."""
        found = []
        going = [0] if self.values else []
        while going:
            at = going.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if len(edges) <= 2 * radius + 1:
                going += [child for edge, child in edges.items() if abs(edge - d) <= radius]
            else:
                going += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        return found

    def add(self, value: int) -> None:
        at = 0
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        while at != new:
            edges = self.children[at]
            at = edges.setdefault((self.values[at] ^ value).bit_count(), new)


def forest(values: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Links (value, least value reached) that connect what links within the radius connect; values differ."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    values = sorted(values)
    for i, value in enumerate(values):
        for j in tree.within(value & (1 << 64) - 1, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(value & (1 << 64) - 1)
    for i, value in enumerate(values):
        if (r := root(i)) != i:
            yield value, values[r]


def _blocks(level: int) -> list[tuple[int, ...]]:
    """The masks by which a shard of this level is keyed: one for each way to choose parts level by level."""
    found = [(tuple(range(64)), ())]  # bits still free, bits shared
    for _ in range(level):
        deeper = []
        for free, shared in found:
            cuts = [len(free) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
            for a, b in zip(cuts, cuts[1:]):
                deeper.append((free[:a] + free[b:], shared + free[a:b]))
        found = deeper
    return [shared for _, shared in found]


def _mask(bits: tuple[int, ...]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _dealt(shards: DataFrame, level: int) -> DataFrame:
    """(way, fp) at level - 1 to the three ways of the next level, keyed by the bits that must agree."""
    masks = [_mask(b) for b in _blocks(level)]
    ways = F.explode(F.array(*[(F.col("way") * (RADIUS + 1) + k).cast("int") for k in range(RADIUS + 1)]))
    of_way = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("way") + 1)
    return shards.select(ways.alias("way"), "fp").withColumn("shared", F.col("fp").bitwiseAND(of_way))


def links(fps: DataFrame, max_shard: int = MAX_SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all within the radius."""

    def run(key: tuple, shard: pa.Table) -> pa.Table:
        found = list(forest(shard.column("fp").to_pylist()))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    dealt = fps.select(F.lit(0).alias("way"), "fp")
    out = None
    for level in range(1, LEVELS + 1):
        dealt = _dealt(dealt.select("way", "fp"), level)
        sizes = dealt.groupBy("way", "shared").agg(F.count(F.lit(1)).alias("n"))
        small = sizes.where("n > 1" if level == LEVELS else f"n > 1 and n <= {max_shard}").select("way", "shared")
        own = dealt.join(small, ["way", "shared"], "left_semi").groupBy("way", "shared").applyInArrow(run, "a long, b long")
        out = own if out is None else out.union(own)
        if level == LEVELS:
            break
        large = sizes.where(f"n > {max_shard}").select("way", "shared")
        if large.isEmpty():
            break
        dealt = stored(dealt.join(large, ["way", "shared"], "left_semi").select("way", "fp"), "simhash-shards")
    return out.distinct()


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node reachable.

    Large-star and small-star steps in turn; each round is written, so a lost executor repeats one round.
    """

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(xxhash64(b, a) % 1000003)")).first())

    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    was = state(current)
    for _ in range(rounds):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(nearest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")
        small = large.join(lower, "a").select(stars).select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct()
        current = stored(small, "links")
        if was == (was := state(current)):
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("links did not settle")


def _rooted(rows: DataFrame, max_shard: int, least: Column) -> DataFrame:
    """fp and first: the least of what ``least`` gives among the rows of all fingerprints that links reach."""
    distinct = rows.groupBy("fp").agg(least.alias("least"))
    roots = connected(links(distinct.select("fp"), max_shard))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("first")), "root").select("fp", "first")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", max_shard: int = MAX_SHARD) -> DataFrame:
    """Per row of docs: key, fp, component_id (the least key among the fingerprints that links reach)."""
    rows = stored(fingerprint(docs, key, text), "fingerprints")
    return rows.join(_rooted(rows, max_shard, F.min(key)), "fp").select(key, "fp", F.col("first").alias("component_id"))


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", max_shard: int = MAX_SHARD) -> DataFrame:
    """docs with one document of each component: the one with the least key (and, among those, the least hash of its text).

    A document is a key and a text: of rows that repeat both one stays, and other texts under the same key are
    judged by their own components. Rows without a key can't be named and stay.
    """
    rows = stored(fingerprint(docs, key, text).where(f"`{key}` is not null"), "fingerprints")
    first = _rooted(rows, max_shard, F.min(F.struct(key, "t")))
    named = rows.join(first, "fp").select(F.col(key).alias("k"), "t", (F.struct(F.col(key).alias("k"), "t") == F.col("first")).alias("stays"))
    state = stored(named.groupBy("k", "t").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1"), "components")
    own, (of_key, at) = numbered(docs, key, text)
    names = own.columns
    same = lambda some: (own[f"c{of_key}"] == some["k"]) & (F.xxhash64(own[f"c{at}"]) == some["t"])
    dropped = state.where("not stays").select("k", "t")
    own = own.join(dropped, same(dropped), "left_anti")
    repeated = state.where("stays").select("k", "t")
    if repeated.isEmpty():
        return own.select(*names).toDF(*docs.columns)
    once = own.join(repeated, same(repeated)).dropDuplicates(["k", "t"]).select(*names)
    return own.join(repeated, same(repeated), "left_anti").select(*names).union(once).toDF(*docs.columns)
