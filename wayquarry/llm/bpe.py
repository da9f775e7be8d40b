"""Byte-level BPE encoding and decoding.

``encode`` adds the ids of each text, ``decode`` turns ids into text again. Both agree with what the
tokenizers library does for the same vocabulary file (special tokens inside a text are recognised, none are
added). Each Arrow batch is handled on its own, so nothing is shuffled and a task holds one batch plus a
cache whose size is fixed.

Nulls: a null text is encoded as the empty text and gives no ids; null ids decode to the empty text.
Other columns pass through unchanged, whatever they hold, unless they bear the name of the output.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import list_array, pieces

# The pre-tokenisation pattern that goes with byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space as that pattern understands it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: Pieces that a worker's three caches keep on average, the longest piece that is kept, and the documents that
#: are decoded at once.
CACHE_ENTRIES = 160_000
CACHE_CHARS = 48
SLICE = 1000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """A vocabulary file of the tokenizers library, read from its JSON text."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        ids = spec["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.byte_ids = [ids.get(c) for c in symbols]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        #: by left symbol, what gives the rank of its pair with a right one; and what the pair of each rank becomes
        ranks: list[dict[int, int]] = [{} for _ in range(1 + max(ids.values()))]
        self.rank_of = [x.get for x in ranks]
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ranks[ids[left]][ids[right]] = rank
            self.made.append(ids[left + right])
        self.strings = np.full(1 + max([*ids.values(), *self.special.values()]), b"", object)
        for token, i in ids.items():
            self.strings[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()

    def merged(self, symbols: list[int]) -> list[int]:
        """Applies merges by rank: a priority queue over a doubly linked list of symbols.

        An entry is a rank and a place, packed as narrowly as the list allows, for small integers are the fastest. A merge
        leaves entries for the neighbours' old pairs behind; an entry that its place no longer holds is stale and skipped.
        A swallowed symbol is -1.
        """
        n, rank_of, made = len(symbols), self.rank_of, self.made
        bits = n.bit_length()
        places = (1 << bits) - 1
        held, queue = [-1] * n, []
        left = symbols[0]
        for at in range(n - 1):
            right = symbols[at + 1]
            if (rank := rank_of[left](right)) is not None:
                held[at] = entry = rank << bits | at
                queue.append(entry)
            left = right
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            at = entry & places
            if held[at] != entry:
                continue
            right = after[at]
            symbols[at] = new = made[entry >> bits]
            symbols[right] = held[right] = held[at] = -1
            beyond = after[at] = after[right]
            if beyond < n:
                before[beyond] = at
                if (rank := rank_of[new](symbols[beyond])) is not None:
                    held[at] = entry = rank << bits | at
                    heappush(queue, entry)
            if (at := before[at]) >= 0:
                held[at] = -1
                if (rank := rank_of[symbols[at]](new)) is not None:
                    held[at] = entry = rank << bits | at
                    heappush(queue, entry)
        return [s for s in symbols if s >= 0]

    def piece(self, text: str) -> list[int]:
        """The ids of one pre-token."""
        byte_ids = self.byte_ids
        return self.merged([byte_ids[b] for b in text.encode()])

    def decode(self, ids: np.ndarray) -> str:
        """Concatenates the strings of the vocabulary."""
        return b"".join(self.strings[ids].tolist()).decode("utf-8", "replace")


class Pieces(dict):
    """The ids of pieces, as bytes of little-endian 16- or 32-bit integers, computed when first asked for."""

    def __init__(self, compute: Callable[[str], bytes], entries: int = CACHE_ENTRIES) -> None:
        self.compute, self.entries = compute, entries

    def __missing__(self, piece: str) -> bytes:
        ids = self.compute(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= self.entries:  # what came first is mostly what is frequent: the later half goes
                first = list(islice(self.items(), self.entries // 2))
                self.clear()
                self.update(first)
            self[piece] = ids
        return ids


class Splitter:
    """Cuts a text where pre-tokens never reach across, and looks up the ids of what lies between.

    Pre-tokens take a single space before a word along and never hold white space after anything else. So
    a text in which single spaces and single newlines stand between words can be cut at every space and
    newline; other texts are cut at the ends of their runs of white space. A cut piece may still hold
    several pre-tokens, as "word," does; both kinds are cached.
    """

    # What a text made of words with single spaces and newlines between them doesn't hold.
    ODD = ("  ", "\n\n", " \n", "\n ", *SPACE.translate({32: None, 10: None}))
    COARSE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    FINE = regex.compile(PATTERN)
    #: A word of such letters is one pre-token with the space before it.
    LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch

    def __init__(self, piece: Callable[[str], bytes], special: dict[str, bytes], entries: int = CACHE_ENTRIES) -> None:
        # three times the entries in all; most different pieces are words after a space
        self.piece = piece
        self.fine = Pieces(piece, entries // 2)
        self.bare = Pieces(self._cut, entries // 2)
        self.spaced = Pieces(self._spaced, 2 * entries)
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def _cut(self, x: str) -> bytes:
        # a word after a space is kept as such, not among the others, too
        return b"".join([self.spaced[p[1:]] if p[0] == " " and self.LETTERS(p, 1) else self.fine[p] for p in self.FINE.findall(x)])

    def _spaced(self, x: str) -> bytes:
        return self.piece(" " + x) if self.LETTERS(x) else self._cut(" " + x)

    def ids(self, text: str) -> bytes:
        if self.cut is not None and any(x in text for x in self.special):
            return b"".join(self.special[x] if k % 2 else self.plain(x) for k, x in enumerate(self.cut.split(text)))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in self.ODD):
            return b"".join(map(self.bare.__getitem__, self.COARSE.findall(text)))
        spaced, bare, out = self.spaced.__getitem__, self.bare, []
        for line in text.split("\n"):
            words = line.split(" ")
            out += bare[words[0]], *map(spaced, words[1:]), bare["\n"]
        out.pop()
        return b"".join(out)


_loaded: dict[int, tuple[Vocabulary, Splitter]] = {}


def _vocabulary(source: str) -> tuple[Vocabulary, Splitter]:
    """Parsed once in each worker."""
    key = hash(source)
    if key not in _loaded:
        v = Vocabulary(source)
        # an array of C ints costs a third of a numpy one; both are 32 bits here
        as_bytes = lambda ids: array("i", ids).tobytes()
        _loaded.clear()
        _loaded[key] = v, Splitter(lambda x: as_bytes(v.piece(x)), {s: as_bytes([i]) for s, i in v.special.items()})
    return _loaded[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _with(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    kept = df.select([df[f"`{c}`"] for c in df.columns if c.lower() != name.lower()])
    return kept, T.StructType([*kept.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with the array<int> column ``ids``: the ids of the whole text in column ``text``.

    path: the vocabulary file, read on the driver (a few MB) and sent to the workers once.
    decoded: the name of a further column with what the ids stand for, decoded in the same pass.
    """
    source = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kept, schema = _with(df, ids, T.ArrayType(T.IntegerType(), False))
    if decoded:
        kept, _ = _with(kept, decoded, T.StringType())
        schema = T.StructType([*kept.schema.fields, schema.fields[-1], T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, splitter = _vocabulary(source.value)
        for batch in pieces(batches, text):
            encoded = [splitter.ids(x or "") for x in batch.column(text).to_pylist()]
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
            columns = [*batch.columns, list_array(np.frombuffer(b"".join(encoded), np.int32), lengths)]
            if decoded:
                columns.append(pa.array([vocabulary.decode(np.frombuffer(x, np.int32)) for x in encoded], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the string column ``text`` that the ids stand for; bytes that aren't UTF-8 become U+FFFD."""
    source = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kept, schema = _with(df, text, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = _vocabulary(source.value)
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            column = batch.column(ids)
            values = column.flatten().to_numpy(zero_copy_only=False)
            lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.cumsum(lengths).tolist()
            decoded = [vocabulary.decode(values[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], names=[*batch.schema.names, text])

    return kept.mapInArrow(run, schema)
