"""What the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..storage import scratch, stored

__all__ = ["PIECE_BYTES", "list_array", "numbered", "pieces", "scratch", "small_batches", "stored", "table", "texts"]

#: Bytes of text that a worker takes on at once; a longer text is taken on alone.
PIECE_BYTES = 4 << 20


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, most: int = PIECE_BYTES) -> Iterator[None]:
    """What is computed meanwhile reaches Python in batches of ``most`` bytes, or one row; Spark's own bound is 64 MB."""
    was = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(most))
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, was)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def texts(batch: pa.RecordBatch, name: int | str = "text") -> list[str]:
    """The strings of a column; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """An Arrow list column over one flat array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def numbered(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[int]]:
    """docs with its columns named c0, c1, ... by their places, so that no name clashes with what is added, and the places of the given ones."""
    names = [c.lower() for c in docs.columns]
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), [names.index(c.lower()) for c in columns]


def pieces(batches: Iterator[pa.RecordBatch], at: int | str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text column of each piece has ``most`` bytes at most, or one row.

    What a worker makes of its texts (strings, words, an index) thus stays small, however long they are.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end
