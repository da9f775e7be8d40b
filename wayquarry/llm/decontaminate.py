"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of INDEX_BYTES together. Its words are mapped to the numbers of the benchmark's own words; a
word that no benchmark item holds can't lie in any occurrence, and neither can a run of benchmark words that
is shorter than the shortest phrase, so only longer runs enter the index, each closed by a separator. The
benchmark's phrases (windows of ten words, or the whole item where it has fewer) are searched backward through
the ranks of a wavelet matrix over the Burrows-Wheeler transform; occurrences are located by stepping back to
sampled suffix positions; their spans are merged for each document.

Shards are independent: nothing is shuffled, and a worker holds one shard's index at a time. The phrases are sent
to every task, so their number is checked: more than MAX_PHRASE_WORDS words of benchmark are searched in
several passes over the documents, each with its own part of the items and written in between.

Null and empty texts have no words and no hits; an item without words has no phrase. Repeated documents each
get their own row, items that share an item_id count once. An item without an id is searched like any other and
only missing in item_ids. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, pieces, stored, texts

WINDOW = 10
SAMPLE = 16
#: Words of benchmark that one pass may send to every task (some 100 MB there).
MAX_PHRASE_WORDS = 1_000_000
#: Bytes of text in one index; a longer document has one of its own.
INDEX_BYTES = 2 << 20

# Words of the contract, over lower-cased UTF-8: every byte of a character beyond ASCII belongs to a word.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector for each bit of a symbol, with the ones before each word."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.levels = []
        for bit in reversed(range(bits)):
            ones = (sequence >> bit & 1).astype(bool)
            padded = np.zeros((len(ones) // 64 + 1) * 64, bool)
            padded[: len(ones)] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((packed, before, int(len(ones) - ones.sum())))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])

    @staticmethod
    def _ones(level: tuple, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        packed, before, _ = level
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(packed[at >> 6] & below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each place."""
        start = np.zeros(len(at), np.int64)
        end = at
        for bit, level in zip(reversed(range(len(self.levels))), self.levels):
            a, b = self._ones(level, start), self._ones(level, end)
            one = (symbol >> bit & 1).astype(bool)
            start, end = np.where(one, level[2] + a, start - a), np.where(one, level[2] + b, end - b)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for level in self.levels:
            one = (level[0][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, at)
            at = np.where(one == 1, level[2] + ones, at - ones)
            symbol = symbol << 1 | one
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes by doubling: ranks of 1, 2, 4, ... symbols until no two are equal."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Over a sequence of numbers from 1 on with separators 0 between runs; it is closed by a last 0."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        order = suffix_array(text)
        last = text[order - 1]
        self.n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.tree = WaveletMatrix(last, max(1, int(symbols - 1).bit_length()))
        sampled = (order % SAMPLE == 0) | (last == 0)  # the starts of runs too, so no step crosses a separator
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - sampled
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of sorted suffixes that begin with each phrase; phrases of one length, one a row."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in reversed(range(phrases.shape[1])):
            alive = np.flatnonzero(low < high)
            if not len(alive):
                break
            symbol = phrases[alive, k]
            low[alive] = self.first[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.tree.rank(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of sorted suffixes: steps back through the text to the sampled ones."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        going = np.arange(len(rows))
        while len(going := going[~self.sampled[rows[going]]]):
            symbol = self.tree.access(rows[going])
            rows[going] = self.first[symbol] + self.tree.rank(symbol, rows[going])
            steps[going] += 1
        return self.samples[self.sample_rank[rows]] + steps


@dataclass
class Phrases:
    """Distinct phrases by length, the items that hold each, and the number of every word."""

    numbers: dict[bytes, int]
    by_length: dict[int, np.ndarray]
    items: dict[int, list[list[str | None]]]
    shortest: int

    @staticmethod
    def of(items: list[tuple[str | None, str]]) -> Phrases:
        numbers: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], list[str | None]]] = {}
        for item_id, text in items:
            words = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
            size = min(WINDOW, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                found.setdefault(size, {}).setdefault(tuple(words[i : i + size]), []).append(item_id)
        by_length = {n: np.array(list(x), np.int64) for n, x in found.items()}
        return Phrases(numbers, by_length, {n: list(x.values()) for n, x in found.items()}, min(found, default=0))


def runs(numbered: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of benchmark words that are long enough to hold a phrase."""
    known = np.concatenate([[False], numbered > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= shortest
    return starts[long], ends[long]


def hits(docs: list[str], phrases: Phrases) -> Iterator[tuple[int, list[tuple[int, int]], set[str | None]]]:
    """For each text of a shard: number of words, starts and ends of merged spans (in words), items found."""
    get = phrases.numbers.get
    counts, kept, owner, offset = [], [], [], []
    for d, text in enumerate(docs):
        words = words_of(text)
        counts.append(len(words))
        if not phrases.shortest or len(words) < phrases.shortest:
            continue
        numbered = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        for a, b in zip(*runs(numbered, phrases.shortest)):
            kept += numbered[a:b], np.zeros(1, np.int64)
            owner.append(d)
            offset.append((a, b - a + 1))
    spans: dict[int, list[tuple[int, int]]] = {}
    found: dict[int, set[tuple[int, int]]] = {}
    if kept:
        text = np.concatenate(kept)
        index = FMIndex(text, len(phrases.numbers) + 1)
        run_starts = np.concatenate([[0], np.cumsum([n for _, n in offset])])
        for size, table in phrases.by_length.items():
            low, high = index.search(table)
            some = np.flatnonzero(low < high)
            which = np.repeat(some, (high - low)[some])
            rows = np.concatenate([np.arange(a, b) for a, b in zip(low[some], high[some])]) if len(some) else np.zeros(0, np.int64)
            places = index.locate(rows)
            run = np.searchsorted(run_starts, places, side="right") - 1
            for phrase, place, r in zip(which.tolist(), places.tolist(), run.tolist()):
                at = int(offset[r][0]) + place - int(run_starts[r])
                spans.setdefault(owner[r], []).append((at, at + size))
                found.setdefault(owner[r], set()).add((size, phrase))
    for d, n in enumerate(counts):
        yield n, merged(spans.get(d, ())), {i for size, phrase in found.get(d, ()) for i in phrases.items[size][phrase]}


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def item_parts(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's items in parts of about ``most`` words at most, read part by part."""
    part: list[tuple[str | None, str]] = []
    words = 0
    own = benchmark.select(benchmark[item].cast("string").alias("item"), benchmark[text].alias("text"))
    for row in own.where("text is not null").toLocalIterator():
        part.append((row.item, row.text))
        words += len(words_of(row.text))
        if words >= most:
            yield part
            part, words = [], 0
    if part:
        yield part


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; of the space before and after a span one side stays."""
    raw = text.encode()
    words = [m.span() for m in WORD.finditer(raw.lower())]
    out, at = [], 0
    for a, b in spans:
        start, end = words[a][0], words[b - 1][1]
        if raw[:start].endswith(b" ") and raw[end : end + 1] == b" ":
            end += 1
        out.append(raw[at:start])
        at = end
    return b"".join([*out, raw[at:]]).decode()


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("unnamed", T.BooleanType()),
    ]
)
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

_phrases: dict[str, Phrases] = {}


def search(own: DataFrame, at: int, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", most: int = MAX_PHRASE_WORDS, cut_text: bool = False) -> DataFrame:
    """own (columns c0, c1, ..., the text at one place) with n_words, spans (merged, in words), item_ids (sorted strings) and unnamed.

    cut_text: the words of the spans are gone from the text that is returned.
    """
    found = own.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in FOUND])
    parts = item_parts(benchmark, item, item_text, most)
    part, rest = next(parts, []), next(parts, None)
    while rest is not None:
        found = stored(_pass(found, at, part, False), "decontaminate")
        part, rest = rest, next(parts, None)
    return _pass(found, at, part, cut_text)


def _pass(found: DataFrame, at: int, part: list[tuple[str | None, str]], cut_text: bool) -> DataFrame:
    """Adds what the documents hold of these items to their spans and item_ids."""
    shared, name, schema = found.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex, found.schema
    kept = len(schema) - len(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _phrases:  # once in each worker
            _phrases.clear()
            _phrases[name] = Phrases.of(shared.value)
        phrases = _phrases[name]
        for batch in pieces(batches, at, INDEX_BYTES):
            n_words, spans, items, unnamed, left = [], [], [], [], []
            before = zip(*(batch.column(c).to_pylist() for c in (at, "spans", "item_ids", "unnamed")))
            for (n, own, names), (text, old, old_names, was_unnamed) in zip(hits(texts(batch, at), phrases), before):
                own = merged([*own, *((x["start"], x["end"]) for x in old or ())])
                n_words.append(n)
                spans.append([{"start": a, "end": b} for a, b in own])
                unnamed.append(bool(was_unnamed) or None in names)
                items.append(sorted({*names, *(old_names or ())} - {None}))
                if cut_text:
                    left.append(cut(text, own) if own else text)
            columns = batch.columns[:kept]
            if cut_text:
                columns[at] = pa.array(left, pa.string())
            columns += pa.array(n_words, pa.int64()), pa.array(spans, SPANS_ARROW), pa.array(items, pa.list_(pa.string())), pa.array(unnamed, pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return found.mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """Per document: key, n_words, n_hit, spans (merged, in words), item_ids (those found, sorted as strings), unnamed (an item without an id was found)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    own, _ = numbered(docs.select(docs[key], docs[text]))
    return search(own, 1, benchmark, **names).select(F.col("c0").alias(key), "n_words", n_hit.alias("n_hit"), "spans", "item_ids", "unnamed")


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """docs with the hit words gone from the text; a document without hits keeps its text as it is."""
    own, (at,) = numbered(docs, text)
    return search(own, at, benchmark, cut_text=True, **names).select(*own.columns).toDF(*docs.columns)
