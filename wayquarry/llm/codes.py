"""Vector codes: each part of a vector becomes the index of its codebook's nearest entry.

Components are integers (floor of SCALE times the component), so assignments, sums and errors are exact and don't depend on
how rows are dealt. The nearest entry is found by segment-mean lower bounds: a part is cut into 1, 2, 4 .. equal blocks, and
the squared distance of two parts is at least the block sizes times the squared differences of their block means, plus the squared difference of the norms of
what the means leave over. Per level, from coarse to fine, the entry of the least bound is compared exactly, and entries whose bound exceeds the least distance found so far
are left out; those that survive all levels get their exact integer distance. A bound is lowered by more than its rounding error, and entries at the bound are kept, so the result is
that of comparing with all of them, ties to the lower index.

``fit`` starts each codebook from the ENTRIES smallest keys and moves its entries to the means of their parts, ROUNDS times: each round sends the codebooks
(at most parts x entries x size of a part integers) to the tasks and brings back one sum for each entry. ``encode`` gives codes and errors of all rows.

Vectors that are null or hold a null or a component that isn't finite are left out. Null keys come last among the smallest keys, ties go by the
vector. Repeated rows count each. With fewer rows than ENTRIES there are as many entries as rows; without rows there are none and the
codebooks' digest is that of the empty text. Kept vectors must have one length, a multiple of PARTS, and components small enough for 64-bit distances: others raise
an error. Columns beyond those named are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256


def levels(size: int) -> list[int]:
    """Numbers of blocks from coarse to fine; blocks of one component would be the distance itself."""
    found = [1]
    while found[-1] * 2 < size and size % (found[-1] * 2) == 0:
        found.append(found[-1] * 2)
    return found


def _summary(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the block sums, and the squared norm of what the block means leave over, times the block size."""
    size = x.shape[1] // blocks
    sums = x.reshape(len(x), blocks, size).sum(axis=2)
    return sums, size * (x * x).sum(axis=1) - (sums * sums).sum(axis=1)


def _bound(own: tuple[np.ndarray, np.ndarray], theirs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """At most the squared distance times the block size; last axis of the sums: blocks."""
    apart = own[0] - theirs[0]
    gap = np.sqrt(own[1].astype(np.float64)) - np.sqrt(theirs[1].astype(np.float64))
    # two roots rounded to 53 bits: their squared difference is off by less than 2^-49 of the larger square
    gap = np.floor(gap * gap - np.maximum(own[1], theirs[1]) * 2.0**-48)
    return (apart * apart).sum(axis=-1) + np.maximum(gap, 0).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Per row of x the index of its nearest entry and the squared distance; how many exact distances were computed."""
    n, size = x.shape
    computed = 0
    reached = np.full(n, np.iinfo(np.int64).max)
    row, entry = np.divmod(np.arange(n * len(entries)), len(entries))
    for blocks in levels(size):
        own, theirs = _summary(x, blocks), _summary(entries, blocks)
        if blocks == 1:
            bound = _bound((own[0][:, None], own[1][:, None]), (theirs[0][None], theirs[1][None])).ravel()
        else:
            bound = _bound((own[0][row], own[1][row]), (theirs[0][entry], theirs[1][entry]))
        # each row's entry of the least bound is compared exactly; its distance is what the others' bounds are held against
        guess = entry[_first_least(row, bound, n)[0]]
        reached = np.minimum(reached, ((x - entries[guess]) ** 2).sum(axis=1))
        computed += n
        near = bound <= reached[row] * (size // blocks)
        row, entry = row[near], entry[near]
    exact = ((x[row] - entries[entry]) ** 2).sum(axis=1)
    first, least = _first_least(row, exact, n)
    return entry[first], least, computed + len(exact)


def _first_least(row: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs that come by row and ascending entry, every row having some: each row's first pair of the least value, and that value."""
    if not n:
        return row, values
    rows = np.arange(n)
    least = np.minimum.reduceat(values, np.searchsorted(row, rows))
    hits = np.flatnonzero(values == least[row])
    return hits[np.searchsorted(row[hits], rows)], least


@dataclass(frozen=True)
class Codebooks:
    #: parts x entries x components
    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x: rows x parts x components. Indices (rows x parts) and squared distances summed over parts."""
        found = [nearest(x[:, p], self.entries[p]) for p in range(len(self.entries))]
        return np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)

    def decode(self, code: str) -> list[int]:
        """The integer vector that a code stands for."""
        return [int(v) for p, e in enumerate(bytes.fromhex(code)) for v in self.entries[p, e]]


def integers(vector: Column, scale: int = SCALE) -> Column:
    """The vector's integer components; null where the vector is null or holds a null or a value that isn't finite."""
    values = vector.cast("array<double>")
    odd = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # beyond 2^62 the long is clipped, and refused by the check of sizes
    return F.when(vector.isNotNull() & ~F.coalesce(odd, F.lit(True)), F.transform(values, lambda v: F.floor(v * scale)))


def prepared(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """key, label and q (integer components) of the vectors that are kept, written once for all passes."""
    own = rows.select(rows[key].alias("key"), rows[label].alias("label"), integers(rows[vector], scale).alias("q")).where("q is not null")
    return stored(own, "vectors")


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as rows x parts x components."""
    most = math.isqrt((1 << 62) // (4 * size * size))
    for batch in batches:
        column = batch.column("q")
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        if (lengths != parts * size).any():
            raise ValueError(f"vectors must have {parts * size} components each")
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, size)
        if len(x) and (x.max() > most or x.min() < -most):
            raise ValueError(f"scaled components must lie within {most} for exact distances")
        yield batch, x


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """kept: what ``prepared`` gave."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hexadecimal digits: 1 to 256 entries")
    first = [r.q for r in kept.orderBy(F.col("key").asc_nulls_last(), "q").select("q").limit(entries).collect()]  # bounded by entries
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    length = len(first[0])
    if not length or length % parts or any(len(q) != length for q in first):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    size = length // parts
    books = np.array(first, np.int64).reshape(len(first), parts, size).transpose(1, 0, 2)
    names = [f"s{i}" for i in range(size)]
    context = kept.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(books)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = Codebooks(shared.value)
            count = np.zeros(now.entries.shape[:2], np.int64)
            total = np.zeros(now.entries.shape, np.int64)
            for _, x in _blocks(batches, parts, size):
                index, _ = now.assign(x)
                for p in range(parts):
                    np.add.at(count[p], index[:, p], 1)
                    np.add.at(total[p], index[:, p], x[:, p])
            part, entry = np.nonzero(count)
            sums = total[part, entry]
            columns = [pa.array(a) for a in (part.astype(np.int32), entry.astype(np.int32), count[part, entry], *sums.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *names])

        sums = kept.select("q").mapInArrow(gather, "part int, entry int, n long, " + ", ".join(f"{s} long" for s in names))
        found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).toPandas()  # a row for each entry
        books = books.copy()
        books[found["part"], found["entry"]] = found[names].to_numpy(np.int64) // found[["n"]].to_numpy(np.int64)
        shared.unpersist()
    return Codebooks(books)


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """key, label, code (two hexadecimal digits a part) and error of each vector of ``kept``."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    parts, _, size = books.entries.shape
    schema = T.StructType([kept.schema["key"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not size:
        return kept.where("false").select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, parts, size):
            index, error = shared.value.assign(x)
            codes = [row.tobytes().hex() for row in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)], names=schema.names)

    return kept.mapInArrow(run, schema)


def compressed(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks]:
    """key, label, code, error and label_error (errors summed over rows of an equal label, nulls together); and the codebooks.

    Errors are summed within each task before they are dealt by label; the sums, a row for each label, are joined back.
    """
    kept = prepared(rows, key, vector, label)
    books = fit(kept)
    coded = stored(encode(kept, books), "codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error")
    return found, books
