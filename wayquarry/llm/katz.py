"""Language-model scores by Katz back-off over words.

The model is a bigram model with Good-Turing discounts. A seen pair has d(r) r / c(h), where r is the pair's
count; an unseen one has alpha(h) p(w), where p is the unigram model built the same way and alpha(h) makes the
distribution after h sum to exactly one over all words and one unknown word. Counts up to K get Good-Turing
discounts; larger ones lose LARGE, so that every history keeps some mass back. A history that was never seen
leaves all to the unigrams. Logarithms are to base 10.

Texts are read twice. The first pass counts words and finds those too frequent for one task. In the second,
each slice (some SLICE_TOKENS tokens) deals what it holds of each word (in which documents, after which words,
how often) to partitions by word, packed in columns; a partition thus builds the n-gram table of its words and of
all pairs that end with them, and joins the dealt tokens to it. A hot word is dealt by pair instead and its count
is sent along; a hot pair is dealt by slice as well, after an exact count. A partition stores its part of the
table (kind ngrams: words and pairs with their counts) and returns to each slice the counts of its words and pairs,
token by token. Where a pair was not seen, the token recurs to the word's probability and to alpha of the history,
which is kept by history: a second table (alphas), built from what all partitions know of a history. Both tables
and the constants of the discounts are the model (``Model``): ``words``, ``pairs`` and ``alphas`` give it as rows
with probabilities, and ``evaluate`` scores texts that it has not learned from by joins with them. ``backoff`` has
the same model for any order of n-grams, in plain tables.

Words are told apart by 64 bits of a hash.

Null and empty texts are one end token. Null doc_ids stay null; repeated rows are counted and scored each by
itself. Without any row to learn from, N and V are zero and every score but the base's is that of one unknown
word a token. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Pieces
from .common import list_array, pieces, scratch, stored, texts

K = 5
LARGE = 0.5
#: A slice ends with the document that brings it to so many tokens, or with so many documents (below 2^16).
SLICE_TOKENS, SLICE_DOCS = 1_500_000, 20_000
#: Documents whose texts a task holds as strings at once.
READ = 500
#: Postings that a partition should hold, the count from which a word or pair is hot, and how many of either are.
PART_POSTINGS = 1_200_000
HOT = 1_000_000
MAX_HOT = 200_000
#: Pairs that a slice reports as possibly hot: the most frequent ones.
REPORTED = 256
CACHE_ENTRIES = 200_000

# No word holds white space, so these can't be words' hashes by design.
START, END = np.uint64(xxhash.xxh64_intdigest(b" start")), np.uint64(xxhash.xxh64_intdigest(b" end"))
MIX = np.uint64(0x9E3779B97F4A7C15)


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (h * MIX) ^ (w + (w >> np.uint64(31)))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Slice:
    number: int
    keys: list[int | None]
    held: np.ndarray
    w: np.ndarray
    h: np.ndarray
    d: np.ndarray


_hashes = Pieces(xxhash.xxh64_intdigest, CACHE_ENTRIES)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    """Batches with key, text, held_out, as tokens: hashes of words and of those before them."""
    get, number = _hashes.__getitem__, TaskContext.get().partitionId() << 32
    keys: list[int | None] = []
    held: list[bool] = []
    own: list[np.ndarray] = []
    size = 0

    def cut() -> Slice:
        nonlocal number, size
        w = np.concatenate(own)
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[np.cumsum(lengths) - lengths] = START
        found = Slice(number, list(keys), np.array(held, bool), w, h, np.repeat(np.arange(len(own), dtype=np.int32), lengths))
        number, size = number + 1, 0
        for x in (keys, held, own):
            x.clear()
        return found

    for part in (b.slice(at, READ) for b in batches for at in range(0, b.num_rows, READ)):
        for key, x, out in zip(part.column("key").to_pylist(), texts(part), part.column("held_out").to_pylist()):
            keys.append(key)
            held.append(out)
            own.append(np.array([*map(get, x.encode().lower().split()), END], np.uint64))
            size += len(own[-1])
            if size >= SLICE_TOKENS or len(own) >= SLICE_DOCS:
                yield cut()
    if own:
        yield cut()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _unique(values: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values with their counts, and those of training tokens."""
    found, inverse, n = np.unique(values, return_inverse=True, return_counts=True)
    return found, n, np.bincount(inverse, weights=train, minlength=len(found)).astype(np.int64)


def _frequent(values: np.ndarray, train: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _unique, for the most frequent values only."""
    found, n = np.unique(values, return_counts=True)
    top = np.sort(np.argsort(n)[-most:])
    found, n = found[top], n[top]
    own = values[train & np.isin(values, found)]
    return found, n, np.bincount(np.searchsorted(found, own), minlength=len(found)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (kind 0), the most frequent pairs (kind 1) and all tokens (kind 2) of each slice."""
    for s in slices(batches):
        train = ~s.held[s.d]
        yield _counts(0, *_unique(s.w, train))
        yield _counts(1, *_frequent(pair_hash(s.h, s.w), train, REPORTED))
        yield _counts(2, np.zeros(1, np.uint64), np.array([len(train)]), np.array([train.sum()]))
        del s, train
        pa.default_memory_pool().release_unused()


def _counts(kind: int, x: np.ndarray, n: np.ndarray, learned: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), _signed(x), pa.array(n), pa.array(learned)], names=["kind", "x", "n", "learned"])


def _count_pairs(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Exact counts of the wanted pairs, with their words."""
    for s in slices(batches):
        pair = pair_hash(s.h, s.w)
        some = np.isin(pair, wanted)
        found, first, inverse = np.unique(pair[some], return_index=True, return_inverse=True)
        learned = np.bincount(inverse, weights=~s.held[s.d[some]], minlength=len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([_signed(found), _signed(s.h[some][first]), _signed(s.w[some][first]), pa.array(learned)], names=["x", "h", "w", "learned"])


def _pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Compressed byte by byte of the numbers; of rising ones (in runs at least) the steps between them."""
    x = np.ascontiguousarray(x)
    if rising and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type, n: int, rising: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd"), np.uint8).reshape(size, n)
    x = np.ascontiguousarray(planes.T).view(kind).reshape(n)
    return np.cumsum(x, dtype=kind) if rising else x


# c: how often, negative in a document that is held out. keys and held (bits) come once for each slice.
POSTINGS = "part int, slice long, keys array<long>, held binary, n_docs int, nw int, nh int, n int, w binary, per_w binary, h binary, h_at binary, d binary, c binary"


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _deal(batches: Iterator[pa.RecordBatch], parts: int, hot_words: np.ndarray, hot_pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each partition and slice: its postings, sorted by word, history and document, in packed columns."""
    names = [f.split()[0] for f in POSTINGS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), *[pa.int32()] * 4, *[pa.binary()] * 6]
    for s in slices(batches):
        part = (s.w % np.uint64(parts)).astype(np.int32)
        if len(hot_words):
            hot = np.isin(s.w, hot_words)
            part[hot] = (pair_hash(s.h[hot], s.w[hot]) % np.uint64(parts)).astype(np.int32)
        if len(hot_pairs):
            hot = np.isin(pair_hash(s.h, s.w), hot_pairs)
            part[hot] = (part[hot] + s.number % parts + (s.number >> 32) * 7) % parts
        order = np.lexsort((s.d, s.h, s.w, part)).astype(np.int32)
        w, h, d, part = s.w[order], s.h[order], s.d[order], part[order]
        s.w = s.h = s.d = order = None
        first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (part[1:] != part[:-1])]))
        c = np.diff(np.append(first, len(w)))
        w, h, d, part = w[first], h[first], d[first], part[first]
        c = np.where(s.held[d], -c, c)
        held = np.packbits(s.held).tobytes()
        cuts = _starts(part)
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(part)])):
            own_w = _starts(w[a:b])
            histories, h_at = np.unique(h[a:b], return_inverse=True)
            row = [int(part[a]), s.number, s.keys if k == 0 else None, held if k == 0 else None, len(s.keys), len(own_w), len(histories), int(b - a),
                   _pack(w[a:b][own_w], True), _pack(np.diff(np.append(own_w, b - a)).astype(np.uint32)), _pack(histories, True),
                   _pack(h_at.astype(np.uint32), True), _pack(d[a:b].astype(np.uint16)), _pack(c[a:b].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)
        del w, h, d, part, first, c
        pa.default_memory_pool().release_unused()


# What a history sums up: kinds of pairs by class, larger ones; their words by class, counts of larger ones.
HISTORY = [*(f"t{r}" for r in range(1, K + 1)), "t_large", *(f"u{r}" for r in range(1, K + 1)), "u_large"]
# What a partition sums up: words and pairs of each count (1 to K + 1) and of larger ones; training tokens; distinct words.
SUMS = [*(f"w{r}" for r in range(1, K + 2)), *(f"p{r}" for r in range(1, K + 2)), "w_large", "tokens", "words"]
# numbers: what is named in HISTORY or SUMS, in that order.
# Kind tokens, for a slice: of nw words the counts and in how many documents each stands (at), those documents, how often it does
# there (times), and the count of the pair (pairs); ending: which of the words is the end. Kind ngrams: nw words with their counts, how many histories each has (at), and those with the pairs' counts.
RESULT = (
    "kind string, slice long, keys array<long>, n_docs int, held binary, n int, nw int, ending int, words binary, counts binary, at binary, "
    "docs binary, times binary, pairs binary, histories binary, h long, d int, c long, numbers array<double>"
)


def _part(group: pa.Table, hot_words: dict[int, int], hot_pairs: dict[int, int]) -> Iterator[tuple[str, dict]]:
    """Works on all postings of a partition: yields (kind, columns) of what it returns."""
    rows = group.to_pylist()
    w, h, d, c = [], [], [], []
    for r in rows:
        w.append(np.repeat(_unpack(r["w"], np.uint64, r["nw"], True), _unpack(r["per_w"], np.uint32, r["nw"])))
        h.append(h_of(r))
        d.append(_unpack(r["d"], np.uint16, r["n"]))
        c.append(_unpack(r["c"], np.int32, r["n"]))
    ends = np.cumsum([len(x) for x in w])
    w, h, d, c = map(np.concatenate, (w, h, d, c))  # the lists go
    order = np.lexsort((h, w)).astype(np.int32)
    w, h = w[order], h[order]
    learned = np.maximum(c[order], 0).astype(np.int64)

    words = _starts(w)
    of_word = np.repeat(np.arange(len(words)), np.diff(np.append(words, len(w))))
    c_w = np.add.reduceat(learned, words)
    cold_w = np.array([x not in hot_words for x in w[words].tolist()], bool) if hot_words else np.ones(len(words), bool)
    if hot_words:
        c_w = np.where(cold_w, c_w, [hot_words.get(x, 0) for x in w[words].tolist()])
    pairs = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])]))
    c_p = np.add.reduceat(learned, pairs)
    cold_p = np.ones(len(pairs), bool)
    if hot_pairs:
        names = pair_hash(h[pairs], w[pairs]).tolist()
        cold_p = np.array([x not in hot_pairs for x in names], bool)
        c_p = np.where(cold_p, c_p, [hot_pairs.get(x, 0) for x in names])

    # back to the order in which the slices sent them
    word_count, pair_count = np.empty(len(w), np.int64), np.empty(len(w), np.int64)
    word_count[order] = c_w[of_word]
    pair_count[order] = np.repeat(c_p, np.diff(np.append(pairs, len(w))))
    del order, learned
    unseen = pair_count == 0
    for r, b in zip(rows, ends.tolist()):
        a, per_w = b - r["n"], _unpack(r["per_w"], np.uint32, r["nw"])
        own_w = _unpack(r["w"], np.uint64, r["nw"], True)
        by_doc = np.argsort(np.repeat(np.arange(r["nw"], dtype=np.int64) << 16, per_w) | d[a:b])  # within each word
        ending = np.flatnonzero(own_w == END)
        row = {
            "slice": r["slice"], "keys": r["keys"], "n_docs": r["n_docs"], "held": r["held"], "n": r["n"], "nw": r["nw"], "ending": int(ending[0]) if len(ending) else -1,
            "counts": _pack(word_count[a:b][np.cumsum(per_w) - per_w]), "at": _pack(per_w), "docs": _pack(d[a:b][by_doc], True), "times": _pack(np.abs(c[a:b])[by_doc]), "pairs": _pack(pair_count[a:b][by_doc]),
        }
        yield "tokens", {name: [value] for name, value in row.items()}
        own = unseen[a:b]
        if own.any():
            sent = h_of(r)[own]
            yield "unseen", {"h": _signed(sent), "slice": np.full(len(sent), r["slice"]), "d": d[a:b][own].astype(np.int32), "c": np.abs(c[a:b][own]).astype(np.int64)}

    # the table: each seen pair and each word is one kind, in one partition unless it is hot
    seen = (c_p > 0) & cold_p
    per_word = np.bincount(of_word[pairs][seen], minlength=len(words))
    listed = cold_w & (c_w > 0) | (per_word > 0)
    if listed.any():
        yield "ngrams", {
            "n": [int(seen.sum())], "nw": [int(listed.sum())], "words": [_pack(w[words][listed], True)], "counts": [_pack(np.where(cold_w, c_w, 0)[listed])], "at": [_pack(per_word[listed].astype(np.uint32))],
            "histories": [_pack(h[pairs][seen], True)], "pairs": [_pack(c_p[seen])],
        }
    if seen.any():
        yield "histories", history_sums(h[pairs][seen], c_p[seen], c_w[of_word[pairs]][seen])
    known, known_pairs = c_w[cold_w & (c_w > 0)], c_p[seen]
    counts = [*(int((known == r).sum()) for r in range(1, K + 2)), *(int((known_pairs == r).sum()) for r in range(1, K + 2)), int((known > K).sum()), int(known.sum()), len(known)]
    yield "sums", {"numbers": _lists(np.array([counts], float))}


def h_of(r: dict) -> np.ndarray:
    return _unpack(r["h"], np.uint64, r["nh"], True)[_unpack(r["h_at"], np.uint32, r["n"], True)]


def history_sums(h: np.ndarray, pair: np.ndarray, word: np.ndarray) -> dict:
    found, of = np.unique(h, return_inverse=True)
    add = lambda where, weight=None: np.bincount(of[where], weights=None if weight is None else weight[where], minlength=len(found)).astype(float)
    columns = [add(pair == r) for r in range(1, K + 1)] + [add(pair > K)] + [add(word == r) for r in range(1, K + 1)] + [add(word > K, word - LARGE)]
    return {"h": _signed(found), "numbers": _lists(np.stack(columns, axis=1))}


def _lists(rows: np.ndarray) -> pa.Array:
    return list_array(np.ascontiguousarray(rows).ravel(), np.full(len(rows), rows.shape[1]))


def discounted(n: list[float]) -> list[float]:
    """r* for r from 0 (not used) to K, from the numbers n[r] of events counted r times, r from 1 to K + 1.

    Where Good-Turing gives no discount between 0 and 1 (few counts, or many copies), LARGE is taken off.
    """
    found = [0.0]
    large = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d = 0.0
        if n[r] and large < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - large) / (1 - large)
        found.append(d * r if 0 < d < 1 else r - LARGE)
    return found


@dataclass
class Constants:
    """What is learned from the corpus as a whole."""

    tokens: float
    words: float
    word: list[float]  # r* of words
    pair: list[float]  # r* of pairs
    unknown: float  # probability of a word that was never seen
    starts: float  # training documents

    def left_over(self) -> Column:
        """alpha(h) c(h), from a history's sums."""
        kept_back = sum((F.col(f"t{r}") * (r - self.pair[r]) for r in range(1, K + 1)), F.col("t_large") * LARGE)
        followed = sum((F.col(f"u{r}") * self.word[r] for r in range(1, K + 1)), F.col("u_large"))
        return kept_back / F.greatest(1 - followed / self.tokens, F.lit(self.unknown))

    def discounted_words(self, counts: np.ndarray) -> np.ndarray:
        """p of words that were counted so often."""
        small = np.array([self.unknown * max(self.tokens, 1.0), *self.word[1:]])
        return np.where(counts > K, counts - LARGE, small[np.minimum(counts, K)]) / max(self.tokens, 1.0)

    def discounted_pairs(self, counts: np.ndarray) -> np.ndarray:
        """r* of pairs that were counted so often, once at least."""
        return np.where(counts > K, counts - LARGE, np.array(self.pair)[np.minimum(counts, K)])


@dataclass
class Model:
    """The stored tables: ngrams in ``path`` (packed by partition), alphas (h, count, alpha), hot words and pairs, and the constants.

    Histories and words are 64-bit hashes (``token_hash``).
    """

    path: str
    alphas: DataFrame
    hot_words: dict[int, int]
    hot_pairs: list[tuple[int, int, int]]  # h, w, count
    constants: Constants

    def _ngrams(self, run: Callable, schema: str) -> DataFrame:
        spark = self.alphas.sparkSession
        return spark.read.schema(RESULT).parquet(self.path).where("kind = 'ngrams'").select("n", "nw", "words", "counts", "at", "histories", "pairs").mapInArrow(run, schema)

    def words(self) -> DataFrame:
        """w, count, p: the probability of each word that was seen."""
        k, schema = self.constants, "w long, count long, p double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in (r for b in batches for r in b.to_pylist()):
                counts = _unpack(r["counts"], np.int64, r["nw"])
                w = _unpack(r["words"], np.uint64, r["nw"], True)[counts > 0]
                counts = counts[counts > 0]
                yield pa.RecordBatch.from_arrays([_signed(w), pa.array(counts), pa.array(k.discounted_words(counts))], names=["w", "count", "p"])

        hot = [(x - (1 << 64) if x >> 63 else x, n, float(k.discounted_words(np.array([n]))[0])) for x, n in self.hot_words.items() if n]
        return self._ngrams(run, schema).union(self.alphas.sparkSession.createDataFrame(hot, schema))

    def pairs(self) -> DataFrame:
        """h, w, count, stars: the discounted count of each pair that was seen; its probability is stars / count of h."""
        k, schema = self.constants, "h long, w long, count long, stars double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in (r for b in batches for r in b.to_pylist()):
                w = np.repeat(_unpack(r["words"], np.uint64, r["nw"], True), _unpack(r["at"], np.uint32, r["nw"]))
                counts = _unpack(r["pairs"], np.int64, r["n"])
                yield pa.RecordBatch.from_arrays([_signed(_unpack(r["histories"], np.uint64, r["n"], True)), _signed(w), pa.array(counts), pa.array(k.discounted_pairs(counts))], names=schema_names(schema))

        hot = [(h, w, n, float(k.discounted_pairs(np.array([n]))[0])) for h, w, n in self.hot_pairs if n]
        return self._ngrams(run, schema).union(self.alphas.sparkSession.createDataFrame(hot, schema))


def schema_names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _result(kind: str, columns: dict) -> pa.Table:
    types = dict(zip(_RESULT.names, _RESULT.types))
    n = len(next(iter(columns.values())))
    columns = {"kind": pa.repeat(kind, n), **columns}
    as_array = lambda x, t: x if isinstance(x, pa.Array) else pa.array(x, t)
    return pa.table([as_array(columns[x], t) if x in columns else pa.nulls(n, t) for x, t in types.items()], schema=_RESULT)


_ARROW = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "int": pa.int32(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
_RESULT = pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in RESULT.split(", ")])


def _combine(group: pa.Table, key: str, k: Constants) -> pa.Table:
    """The documents of a slice: what their tokens come to, but for alpha of the histories whose pairs were not seen."""
    n_docs = group.column("n_docs")[0].as_py()
    tokens, known, base, total = np.zeros(n_docs), np.zeros(n_docs), np.zeros(n_docs), np.zeros(n_docs)
    keys = held = None
    log_n = math.log10(k.tokens + 0.1 * (k.words + 1))
    for r in (r for batch in group.to_batches(max_chunksize=64) for r in batch.to_pylist()):
        if r["keys"] is not None:
            keys, held = r["keys"], np.unpackbits(np.frombuffer(r["held"], np.uint8), count=n_docs).astype(bool)
        counts, at = _unpack(r["counts"], np.int64, r["nw"]), np.repeat(np.arange(r["nw"]), _unpack(r["at"], np.uint32, r["nw"]))
        docs, times, pairs = _unpack(r["docs"], np.uint16, r["n"], True), _unpack(r["times"], np.int32, r["n"]), _unpack(r["pairs"], np.int64, r["n"])
        own = counts > 0
        add = lambda weight: np.bincount(docs, weights=times * weight, minlength=n_docs)
        tokens += add(np.ones(len(docs)))
        known += add(own[at])
        base += add((np.log10(counts + 0.1) - log_n)[at])
        # every token is divided by the count of its history, and every word but the end is the history of one token
        history = np.where(own, np.log10(np.maximum(counts, 1)), 0.0)
        if r["ending"] >= 0:
            history[r["ending"]] = 0.0
        seen = np.log10(k.discounted_pairs(np.maximum(pairs, 1)))
        total += add(np.where(pairs > 0, seen, np.log10(k.discounted_words(counts))[at]) - history[at])
    if k.tokens:
        total -= math.log10(k.starts)
    slice_number = group.column("slice")[0].as_py()
    columns = [np.full(n_docs, slice_number), np.arange(n_docs, dtype=np.int32), pa.array(keys, pa.int64()), held, tokens.astype(np.int64), known.astype(np.int64), base, total]
    return pa.table([pa.array(x) for x in columns], names=["slice", "d", key, "held_out", "n_tokens", "n_known", "base_score", "partial"])


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows held out are not learned from."""
    own = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return _score(own, key, HOT, PART_POSTINGS)[0]


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The model of all rows of docs, in tables in the shared folder."""
    own = docs.select(F.lit(0).cast("long").alias("key"), docs[text].alias("text"), F.lit(False).alias("held_out"))
    return _score(own, "key", HOT, PART_POSTINGS)[1]


def _score(own: DataFrame, key: str, hot: int, part_postings: int) -> tuple[DataFrame, Model]:
    spark = own.sparkSession
    counted = own.mapInArrow(_count, "kind int, x long, n long, learned long").groupBy("kind", "x").agg(F.sum("n").alias("n"), F.sum("learned").alias("learned"))
    end = int(END.view(np.int64))
    totals = stored(counted.where((F.col("n") > hot) | (F.col("kind") == 2) | (F.col("kind") == 0) & (F.col("x") == end)), "katz-hot")
    tokens = totals.where("kind = 2").first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(tokens.n if tokens else 0) // part_postings))
    # at most MAX_HOT rows each
    most = lambda kind: totals.where((F.col("kind") == kind) & (F.col("n") > hot)).orderBy(F.desc("n")).limit(MAX_HOT)
    hot_words = {r.x % (1 << 64): r.learned for r in most(0).collect()}
    reported = np.array([r.x % (1 << 64) for r in most(1).collect()], np.uint64)
    exact = own.mapInArrow(lambda b: _count_pairs(b, reported), "x long, h long, w long, learned long").groupBy("x", "h", "w").agg(F.sum("learned").alias("learned")).collect() if len(reported) else []
    hot_pairs = {r.x % (1 << 64): r.learned for r in exact}
    starts = totals.where(f"kind = 0 and x = {end}").first()

    some_words, some_pairs = np.array(list(hot_words), np.uint64), np.array(list(hot_pairs), np.uint64)
    sent = spark.sparkContext.broadcast((hot_words, hot_pairs))
    postings = own.mapInArrow(lambda b: _deal(b, parts, some_words, some_pairs), POSTINGS)

    def work(group: pa.Table) -> pa.Table:
        found = pa.concat_tables([_result(kind, columns) for kind, columns in _part(group, *sent.value)])
        pa.default_memory_pool().release_unused()
        return found

    path = scratch(spark, "katz")
    postings.groupBy("part").applyInArrow(work, RESULT).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    found = spark.read.schema(RESULT).parquet(path)

    s = found.where("kind = 'sums'").agg(*[F.coalesce(F.sum(F.col("numbers")[i]), F.lit(0.0)).alias(x) for i, x in enumerate(SUMS)]).first().asDict()
    for n in hot_words.values():  # partitions don't see all of these
        if n:
            s["tokens"] += n
            s["words"] += 1
            s["w_large"] += n > K
            if n <= K + 1:
                s[f"w{n}"] += 1
    for n in hot_pairs.values():
        if 0 < n <= K + 1:
            s[f"p{n}"] += 1
    word = discounted([0.0, *(s[f"w{r}"] for r in range(1, K + 2))])
    pair = discounted([0.0, *(s[f"p{r}"] for r in range(1, K + 2))])
    left = sum(s[f"w{r}"] * (r - word[r]) for r in range(1, K + 1)) + s["w_large"] * LARGE
    k = Constants(s["tokens"], s["words"], word, pair, left / s["tokens"] if s["tokens"] else 1.0, starts.learned if starts else 0)

    histories = found.where("kind = 'histories'").select("h", "numbers")
    learned = [r for r in exact if r.learned]
    if learned:
        more = history_sums(np.array([r.h for r in learned]).view(np.uint64), np.array([r.learned for r in learned]), np.array([hot_words.get(r.w % (1 << 64), r.learned) for r in learned]))
        histories = histories.union(spark.createDataFrame(list(zip(*[x.to_pylist() for x in more.values()])), histories.schema))
    summed = histories.groupBy("h").agg(*[F.sum(F.col("numbers")[i]).alias(x) for i, x in enumerate(HISTORY)])
    alphas = stored(summed.select("h", (k.left_over() if k.tokens else F.lit(0.0)).alias("left_over")), "katz-alphas")
    model = Model(path, alphas, hot_words, [(r.h, r.w, r.learned) for r in exact], k)

    tokens = found.where("kind = 'tokens'").select("slice", "keys", "n_docs", "held", "n", "nw", "ending", "counts", "at", "docs", "times", "pairs")
    whole = tokens.groupBy("slice").applyInArrow(lambda g: _combine(g, key, k), f"slice long, d int, `{key}` long, held_out boolean, n_tokens long, n_known long, base_score double, partial double")
    # a pair that is hot has been seen; an unseen history leaves all to the words; a history with many rows is split by the skew join
    backed_off = found.where("kind = 'unseen'").select("h", "slice", "d", "c").join(alphas, "h").groupBy("slice", "d").agg(F.sum(F.col("c") * F.log10("left_over")).alias("backed_off"))
    whole = whole.join(backed_off, ["slice", "d"], "left")
    score = F.col("partial") + F.coalesce("backed_off", F.lit(0.0))
    return whole.select(key, "held_out", "n_tokens", "n_known", F.lit(int(k.tokens)).cast("long").alias("train_tokens"), "base_score", score.alias("score")), model


def evaluate(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_tokens, score, by the model's tables. Each token is joined to its pair, its word and its history.

    A token's probability is its pair's if that was seen, else the word's (or the unknown word's) times alpha of
    the history; a history that was never seen leaves all to the words.
    """
    own = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("t"), docs[text].alias("text"))
    schema = T.StructType([*own.schema.fields[:2], *(T.StructField(n, T.LongType()) for n in ("h", "w", "n"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _hashes.__getitem__
        for batch in pieces(batches, "text"):
            words = [np.array([*map(get, x.encode().lower().split()), END], np.uint64) for x in texts(batch)]
            w = np.concatenate([np.zeros(0, np.uint64), *words])
            h = np.concatenate([np.zeros(0, np.uint64), *(np.concatenate([[START], x[:-1]]) for x in words)])
            lengths = np.array([len(x) for x in words], np.int64)
            of_row = pa.array(np.repeat(np.arange(len(words)), lengths))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of_row), batch.column(1).take(of_row), _signed(h), _signed(w), pa.array(np.ones(len(w), np.int64))], names=schema.names)

    # texts that repeat under a key are one
    tokens = own.dropDuplicates(["key", "t"]).mapInArrow(run, schema).groupBy("key", "t", "h", "w").agg(F.sum("n").alias("n"))
    pairs, words = model.pairs().select("h", "w", "stars"), model.words().select("w", "p")
    counts = model.words().select(F.col("w").alias("h"), F.col("count").alias("c_h")).where(F.col("h") != int(END.view(np.int64)))
    starts = docs.sparkSession.createDataFrame([(int(START.view(np.int64)), int(model.constants.starts))], "h long, c_h long")
    joined = tokens.join(pairs, ["h", "w"], "left").join(words, "w", "left").join(counts.union(starts.where("c_h > 0")), "h", "left").join(model.alphas, "h", "left")
    lower = F.coalesce("p", F.lit(model.constants.unknown))
    p = F.when(F.col("stars").isNotNull(), F.col("stars") / F.col("c_h")).otherwise(F.coalesce(F.col("left_over") / F.col("c_h"), F.lit(1.0)) * lower)
    sums = joined.groupBy("key", "t").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.log10(p)).alias("score"))
    rows = own.select("key", "t")
    return rows.join(sums, rows["key"].eqNullSafe(sums["key"]) & (rows["t"] == sums["t"])).select(rows["key"].alias(key), "n_tokens", "score")
