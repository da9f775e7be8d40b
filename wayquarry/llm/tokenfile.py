"""Token ids in files whose document boundaries are Elias-Fano coded.

A file holds blocks; a block holds the concatenated ids of consecutive documents (16 bits an id where the
vocabulary allows, else 32), the ends of its documents and their doc_ids, both as Elias-Fano sequences with a
select structure: low bits packed, high bits in unary, and the place of every 256th one. That takes about
2 + log2(ids per document) bits a document instead of a table of 64-bit offsets, and any boundary is found
without decoding those before it.

``write`` deals documents out by ranges of doc_id, so that files follow each other in ascending doc_id order
and no task holds more than one batch and one block. Blocks are stored through Spark as binary rows, so the
folder may be in any store that Spark can write.

Null texts are written as empty ones (the end id alone). Documents with a null doc_id come first; equal
doc_ids follow each other in the order of what their texts begin with (ORDER_CHARS characters), then of a hash,
so that a doc_id of any number of rows is shared by several tasks. Other columns are not read.
"""

from __future__ import annotations

import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Splitter, byte_symbols, read_vocabulary

MAGIC = b"WQT1"
HEAD = struct.Struct("<4sB3xQQQq")  # magic, bytes an id, documents, documents without doc_id, ids, first doc_id
SAMPLE = 256
#: Pieces that each of a worker's caches keeps.
CACHE_ENTRIES = 400_000
#: Characters by which texts of one doc_id are ordered.
ORDER_CHARS = 64
#: Ids after which a block is closed; a longer document makes a longer block.
BLOCK_IDS = 1 << 20

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: _NTH[b, k]: the place of the k-th one in byte b, counted from its lowest bit.
_NTH = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _at in enumerate(i for i in range(8) if _b >> i & 1):
        _NTH[_b, _k] = _at


class EliasFano:
    """A sequence of integers from 0 on that never falls."""

    HEAD = struct.Struct("<QBQQ")  # values, low bits each, bytes of low bits, bytes of high bits

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        bits = np.empty((n, low_bits), np.uint8)
        for b in range(low_bits):  # bit by bit: a byte a bit is held, not a 64-bit integer
            bits[:, b] = values >> np.uint64(b) & np.uint64(1)
        low = np.packbits(bits, axis=None, bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def tobytes(self) -> bytes:
        head = self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, low, high = cls.HEAD.unpack_from(data, at)
        at += cls.HEAD.size
        parts = [np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low)]
        at += low + high
        samples = -(-n // SAMPLE)
        parts.append(np.frombuffer(data[at : at + 4 * samples], np.uint32))
        return cls(n, low_bits, *parts), at + 4 * samples

    def select(self, which: np.ndarray) -> np.ndarray:
        """The values at the given indices, all at once: from the sampled one before each, byte by byte."""
        which = np.asarray(which, np.int64)
        start = self.samples[which // SAMPLE].astype(np.int64)
        byte = start >> 3
        rest = which % SAMPLE + _ONES[self.high[byte] & ((1 << (start & 7)) - 1).astype(np.uint8)]
        going = np.arange(len(which))
        while len(going := going[rest[going] >= _ONES[self.high[byte[going]]]]):
            rest[going] -= _ONES[self.high[byte[going]]]
            byte[going] += 1
        place = byte * 8 + _NTH[self.high[byte], rest]
        value = (place - which).astype(np.uint64) << np.uint64(self.low_bits)
        for k in range(self.low_bits):
            bit = which * self.low_bits + k
            value |= (self.low[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(np.uint64) << np.uint64(k)
        return value


class Block:
    """A block of a file, opened for reading any of its documents."""

    def __init__(self, data: bytes) -> None:
        view = memoryview(data)
        magic, self.width, self.n_docs, self.nameless, n_ids, self.first = HEAD.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token block")
        self.ends, at = EliasFano.read(view, HEAD.size)
        self.names, at = EliasFano.read(view, at)
        self.ids = np.frombuffer(view, f"<u{self.width}", n_ids, at)

    @staticmethod
    def build(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
        """ids: one array of 16- or 32-bit ids for each document; doc_ids ascend, nulls first."""
        flat = np.concatenate(ids)
        named = [x for x in doc_ids if x is not None]
        first = named[0] if named else 0
        ends = EliasFano.of(np.cumsum([len(x) for x in ids]))
        names = EliasFano.of(np.array([x - first for x in named], np.uint64))
        head = HEAD.pack(MAGIC, flat.itemsize, len(ids), len(ids) - len(named), len(flat), first)
        return head + ends.tobytes() + names.tobytes() + flat.tobytes()

    def bounds(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where documents start and end among the block's ids."""
        starts = np.zeros(len(which), np.int64)
        later = which > 0
        starts[later] = self.ends.select(which[later] - 1).astype(np.int64)
        return starts, self.ends.select(which).astype(np.int64)

    def doc_ids(self, which: np.ndarray) -> list[int | None]:
        named = which[which >= self.nameless] - self.nameless
        found = iter([self.first + int(x) for x in self.names.select(named)])
        return [next(found) if i >= self.nameless else None for i in which.tolist()]

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(np.array([i]))
        return self.ids[a[0] : b[0]]


_encoders: dict[int, Splitter] = {}


def _encoder(source: str, kind: np.dtype) -> Splitter:
    """The tokenizers library's model on the pre-tokens, cached; made once in each worker."""
    key = hash(source)
    if key not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(source)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        symbols = dict(enumerate(byte_symbols()))
        tokenize = tokenizer.model.tokenize

        space, code = symbols[32], "H" if kind.itemsize == 2 else "I"
        little = sys.byteorder == "little"

        def piece(x: str) -> bytes:
            # letters of ASCII stand for themselves
            word = space + x[1:] if x[0] == " " and x[1:].isalpha() and x.isascii() else x.encode().decode("latin-1").translate(symbols)
            ids = [t.id for t in tokenize(word)]
            return array(code, ids).tobytes() if little else np.array(ids, kind).tobytes()

        special = {t.content: np.array([i], kind).tobytes() for i, t in tokenizer.get_added_tokens_decoder().items()}
        _encoders.clear()
        _encoders[key] = Splitter(piece, special, CACHE_ENTRIES)
    return _encoders[key]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encodes every text, appends end_id, and writes files in ascending order of key to path."""
    from tokenizers import Tokenizer

    source = read_vocabulary(vocabulary)
    kind = np.dtype("<u2" if max(Tokenizer.from_str(source).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4")
    shared = docs.sparkSession.sparkContext.broadcast(source)
    end = np.array([end_id], kind).tobytes()
    own = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    # a repeated doc_id is cut by what its texts begin with and their hash, a repeated row by its place: equal rows may stand in any order
    order = ["doc_id", F.substring("text", 1, ORDER_CHARS), F.xxhash64("text")]
    dealt = own.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, kind)
        part, seq, start, size = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, start, size
            row = [[part], [seq], [start], [size], [Block.build(doc_ids, ids)]]
            seq, start, size = seq + 1, start + size, 0
            doc_ids.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "seq", "start", "n_ids", "block"])

        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.frombuffer(encoder.ids(x or "") + end, kind)
                doc_ids.append(doc_id)
                ids.append(found)
                size += len(found)
                if size >= block_ids:
                    yield close()
        if ids:
            yield close()

    blocks = dealt.mapInArrow(run, "part int, seq int, start long, n_ids long, block binary")
    blocks.write.option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at path: doc_id, start, n_tokens, ids_crc32.

    A part's first id follows all ids of the parts before it; their sums are one row a part.
    """
    blocks = spark.read.schema("part int, seq int, start long, n_ids long, block binary").parquet(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = Block(data.as_buffer())
                which = np.arange(block.n_docs)
                starts, ends = block.bounds(which)
                wide = block.ids.astype("<u4")
                sums = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(block.doc_ids(which), pa.int64()), pa.array(starts + start), pa.array(ends - starts), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row for each part, so its size is bounded by the number of partitions that were written
    placed = blocks.join(F.broadcast(before), "part").select((F.col("start") + F.col("before")).alias("start"), "block")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
