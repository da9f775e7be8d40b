"""Files of one long text (SQL dumps, GeoJSON) read in parallel: where each part starts is found by a prefix composition.

Spark's text source cuts files into splits; with a sign of the format as the line separator a text of one line is cut too. What
a split means depends on where it starts (in a string, a comment, a statement), and so on all that stands before it. ``places``
therefore reads the splits twice. First each task says, for every state that its split may start in, what it would do to the
reader; these summaries are small, and composed in the order of the splits, file by file, they give what each split really starts in.
Then ``each_split`` goes over the splits with that.

What the tasks are given grows with the number of splits: it is measured, and sent to all tasks up to SENT_BYTES; beyond that
it is dealt to the splits by a shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

SENT_BYTES = 32 << 20
#: Characters that a task takes on at once.
CHUNK_CHARS = 4 << 20


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, start (of the split), piece (without the separator after it), in order within each split."""
    found = spark.read.option("lineSep", separator).text(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("piece"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], Iterator[list[str]]]]:
    """The pieces of a task by split: (file, start, size) and lists of pieces of some CHUNK_CHARS characters each."""

    def rows() -> Iterator[tuple[tuple[str, int, int], str]]:
        for batch in batches:
            files, starts, sizes, texts = (batch.column(c).to_pylist() for c in ("file", "start", "size", "piece"))
            yield from zip(zip(files, starts, sizes), texts)

    found = rows()
    ahead = next(found, None)

    def chunks(key: tuple[str, int, int]) -> Iterator[list[str]]:
        nonlocal ahead
        while ahead and ahead[0] == key:
            chunk, chars = [], 0
            while ahead and ahead[0] == key and chars < CHUNK_CHARS:
                chunk.append(ahead[1])
                chars += len(ahead[1]) + 1
                ahead = next(found, None)
            yield chunk

    while ahead:
        key = ahead[0]
        own = chunks(key)
        yield key, own
        for _ in own:  # what wasn't asked for
            pass


def places(found: DataFrame, separator: str, states: tuple, summary: Callable, compose: Callable, follow: Callable, begin: object) -> DataFrame:
    """file, start, last, context (pickled) of each split that has pieces.

    summary(text, state): what a text does, read in a state. compose(a, b): what it does after another one; b maps states to summaries.
    follow(splits, begin): the contexts that a file's splits start in, given what each does by state.
    The last split's separator is one more than the file has, unless it ends with one: the sizes tell, and ``closed`` says so.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start, size), chunks in _splits(batches):
            own, n_bytes = None, 0
            for chunk in chunks:
                text = separator.join(chunk) + separator
                n_bytes += len(text.encode())
                later = {s: summary(text, s) for s in states}
                own = later if own is None else {s: compose(own[s], later) for s in states}
            columns = [[file], [start], [size], [n_bytes], [pickle.dumps(own)]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "size", "n_bytes", "does"])

    def composed(splits: pd.DataFrame) -> pd.DataFrame:
        splits = splits.sort_values("start")
        contexts = follow([pickle.loads(x) for x in splits["does"]], begin)
        last = splits["start"] == splits["start"].max()
        closed = splits["n_bytes"].sum() == splits["size"].iloc[0]
        return pd.DataFrame({"file": splits["file"], "start": splits["start"], "last": last, "closed": closed, "context": [pickle.dumps(x) for x in contexts]})

    does = found.mapInArrow(summarise, "file string, start long, size long, n_bytes long, does binary")
    # a row for each split of one file is all that a group has
    return stored(does.groupBy("file").applyInPandas(composed, "file string, start long, last boolean, closed boolean, context binary"), "splits")


def each_split(found: DataFrame, separator: str, at: DataFrame, run: Callable, schema: str, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """run(file, start, context, texts) gives record batches of the schema for each split; texts: its text in chunks."""
    size = at.agg(F.sum(F.length("context") + F.length("file") + 64)).first()[0] or 0

    def texts(chunks: Iterator[list[str]], last: bool, closed: bool) -> Iterator[str]:
        held = None
        for chunk in chunks:
            if held is not None:
                yield held + separator
            held = separator.join(chunk)
        if held is not None:
            yield held if last and not closed else held + separator

    if size <= sent_bytes:
        rows = at.collect()  # bounded by sent_bytes
        known = found.sparkSession.sparkContext.broadcast({(r.file, r.start): (r.last, r.closed, bytes(r.context)) for r in rows})

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (file, start, _), chunks in _splits(batches):
                last, closed, context = known.value[file, start]
                yield from run(file, start, pickle.loads(context), texts(chunks, last, closed))

        return found.mapInArrow(whole, schema)

    # each split's context travels as a row before its pieces
    none = lambda kind: F.lit(None).cast(kind)
    own = found.select("file", "start", F.monotonically_increasing_id().alias("place"), "piece", none("boolean").alias("last"), none("boolean").alias("closed"), none("binary").alias("context"))
    both = own.union(at.select("file", "start", F.lit(-1).cast("long"), none("string"), "last", "closed", "context"))
    dealt = both.repartition("file", "start").sortWithinPartitions("file", "start", "place").withColumn("size", F.lit(0).cast("long"))

    def dealt_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], tuple] = {}

        def without_contexts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                context = batch.column("context")
                for i in [i for i, x in enumerate(context.is_valid().to_pylist()) if x]:
                    known[batch.column("file")[i].as_py(), batch.column("start")[i].as_py()] = tuple(batch.column(c)[i].as_py() for c in ("last", "closed", "context"))
                yield batch.filter(context.is_null())

        for (file, start, _), chunks in _splits(without_contexts()):
            last, closed, context = known.pop((file, start))
            yield from run(file, start, pickle.loads(context), texts(chunks, last, closed))

    return dealt.mapInArrow(dealt_out, schema)
