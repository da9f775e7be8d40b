"""Near-duplicate lines by a deletion-neighbourhood join.

A line is a \\n-separated part of a text; its words are taken without regard to the case of A-Z and to the
white space between them. Every line that has a word is judged: it goes if an equal line, or one within one
edit, stands earlier in the corpus: in a document with a smaller key, or before it in its own. An edit replaces,
adds or leaves out a word where both lines have EDIT_WORDS words or more; in shorter lines it does so to a
character, where both have EDIT_CHARS characters or more (one character of less is often all that a line says,
as in "Page 1"); shorter ones yet go for equal ones only. Both limits are parameters.

Equal lines are grouped first. Of those left, two lines within one edit agree on one half of the shorter one,
the first or the last, so only lines that share a half with another one are taken further; a line has
halves for its own length and for one less. Each line that is left emits all its variants with
one word or character left out as hashed keys, from prefix and suffix hashes, so a long line costs no more than
its length. Lines that become equal by leaving out the same place, or
where one is the other's variant, are within the bound; a group of any size is joined through its earliest
lines and never in pairs. What a key claims is verified by edit distance on the lines themselves.

A document is a key and a text: rows that share a key, or have none, are told apart by a hash of their texts
(the null key sorts first, and within a key the hash decides which is earlier). Exact repetitions of a row keep
the same lines. Null and empty texts have no lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_array, numbered, pieces, stored, texts

EDIT_WORDS = 8
EDIT_CHARS = 16
#: Rows of variants that a worker returns at once.
ROWS = 100_000


@dataclass(frozen=True)
class Edits:
    """From how many words on an edit is a word, and from how many characters on shorter lines are compared by characters."""

    words: int = EDIT_WORDS
    chars: int = EDIT_CHARS

    def symbols(self, words: list[bytes], whole: bytes) -> list[bytes] | str | None:
        """What edits are counted in: the words of a line, or its characters, or nothing."""
        if len(words) >= self.words:
            return words
        line = whole.decode()
        return line if len(line) >= self.chars else None


def _hash(x: bytes) -> int:
    h = xxhash.xxh64_intdigest(x)
    return h - (1 << 64) if h >> 63 else h


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def halves(symbols: list[bytes] | str) -> list[int]:
    """Hashes of the first and the last half, for the length and for one less, each with that length and its side."""
    found = []
    for n in (len(symbols), len(symbols) - 1):
        half = n // 2
        for side, part in ((b"<", symbols[:half]), (b">", symbols[-half:])):
            found.append(_hash(b"c%d" % n + side + part.encode() if isinstance(part, str) else b"w%d" % n + side + b" ".join(part)))
    return found


def line_keys(own: DataFrame, edits: Edits) -> DataFrame:
    """own: key, t, text. A row for each line with a word: key, t, line, n_words, h (of all words), halves (for lines that edits are looked for)."""
    schema = T.StructType([*own.schema.fields[:2], *(T.StructField(n, t) for n, t in (("line", T.IntegerType()), ("n_words", T.IntegerType()), ("h", T.LongType()), ("halves", T.ArrayType(T.LongType()))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            row, number, n_words, h, n_halves, all_halves = [], [], [], [], [], []
            for at, x in enumerate(texts(batch, 2)):
                for i, line in enumerate(x.encode().lower().split(b"\n")):
                    if words := line.split():
                        whole = b" ".join(words)
                        row.append(at)
                        number.append(i)
                        n_words.append(len(words))
                        h.append(_hash(whole))
                        symbols = edits.symbols(words, whole)
                        own_halves = halves(symbols) if symbols else ()
                        n_halves.append(len(own_halves))
                        all_halves += own_halves
            of_row = pa.array(row, pa.int64())
            columns = [batch.column(0).take(of_row), batch.column(1).take(of_row), pa.array(number, pa.int32()), pa.array(n_words, pa.int32()), pa.array(h, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, list_array(np.array(all_halves, np.int64), np.array(n_halves, np.int64))], names=schema.names)

    return own.mapInArrow(run, schema)


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def deletions(symbols: list[bytes] | str) -> tuple[np.ndarray, int]:
    """Hashes of what is left without each symbol in turn, and of all of them; equal for equal rests.

    A sequence's value is the sum of its symbols' hashes times powers of an odd base (modulo 2^64), so what
    follows the place that is left out counts a power less.
    """
    if isinstance(symbols, str):
        own = (np.frombuffer(symbols.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        own ^= own >> np.uint64(29)
        kind = 1
    else:
        own = np.fromiter(map(xxhash.xxh64_intdigest, symbols), np.uint64, len(symbols))
        kind = 2
    n = len(own)
    power = np.full(n, BASE, np.uint64)
    power[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * np.cumprod(power, dtype=np.uint64), dtype=np.uint64)])
    rests = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(INVERSE)

    def mixed(x: np.ndarray, length: int) -> np.ndarray:
        x = (x ^ np.uint64((length * 4 + kind) * 0x94D049BB133111EB % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(31))).view(np.int64)

    return mixed(rests, n - 1), int(mixed(sums[-1:], n)[0])


def variants(own: DataFrame, wanted: DataFrame, edits: Edits) -> DataFrame:
    """For the wanted lines of each document (wanted_key, wanted_t, lines): a row for each word or character left out (place) and one for the whole line (place -1).

    own: key, t, text. n is the number of symbols that rest counts; words: the line, where place is -1.
    """
    same = own["key"].eqNullSafe(wanted["wanted_key"]) & (own["t"] == wanted["wanted_t"])
    joined = own.join(wanted, same).select("key", "t", "text", "lines")
    kinds = (("line", T.IntegerType()), ("n", T.IntegerType()), ("place", T.IntegerType()), ("rest", T.LongType()), ("words", T.StringType()))
    schema = T.StructType([*own.schema.fields[:2], *(T.StructField(n, t) for n, t in kinds)])

    def rows(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        lengths = np.array([len(x[2]) + 1 for x in found])
        row, line = (np.repeat(np.array([x[i] for x in found], np.int64), lengths) for i in (0, 1))
        ends = np.cumsum(lengths)
        place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        last = place == np.repeat(lengths, lengths) - 1
        n = np.repeat(lengths - 2, lengths) + last
        rest = np.concatenate([y for x in found for y in (x[2], np.array([x[3]]))])
        words: list[str | None] = [None] * int(ends[-1])
        for end, x in zip(ends.tolist(), found):
            words[end - 1] = x[4]
        of_row = pa.array(row)
        columns = [batch.column(0).take(of_row), batch.column(1).take(of_row), pa.array(line.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.where(last, -1, place).astype(np.int32)), pa.array(rest), pa.array(words, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            found, size = [], 0
            for at, (x, lines) in enumerate(zip(texts(batch, 2), batch.column(3).to_pylist())):
                split = x.encode().lower().split(b"\n")
                for number in lines:
                    words = split[number].split()
                    whole = b" ".join(words)
                    rests, all_of_it = deletions(edits.symbols(words, whole))
                    found.append((at, number, rests, all_of_it, whole.decode()))
                    size += len(rests) + 1
                    if size > ROWS:
                        yield rows(batch, found)
                        found, size = [], 0
            if found:
                yield rows(batch, found)

    return joined.mapInArrow(run, schema)


def within_one(a: list[str] | str, b: list[str] | str) -> bool:
    """Edit distance of at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _edited(own: DataFrame, distinct: DataFrame, edits: Edits) -> DataFrame:
    """The places (first) of the distinct lines that have an earlier line within one edit."""

    @F.pandas_udf(T.BooleanType())
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        split = lambda x: w if len(w := x.split(" ")) >= edits.words else x
        return pd.Series([within_one(split(x), split(y)) for x, y in zip(a, b)], dtype=bool)

    halved = distinct.where(F.size("halves") > 0).select(F.explode("halves").alias("half"), "first")
    twice = halved.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    shared = halved.join(twice, "half", "left_semi").select("first").distinct()
    wanted = shared.groupBy(F.col("first.key").alias("wanted_key"), F.col("first.t").alias("wanted_t")).agg(F.collect_list("first.line").alias("lines"))
    made = variants(own, wanted, edits).select(F.struct("key", "t", "line").alias("first"), "n", "place", "rest", "words")
    # a text that stands in several rows of one key gives its lines several times
    made = stored(made, "line-variants")
    groups = made.groupBy("rest", "n").agg(
        (F.min("first") != F.max("first")).alias("several"),
        F.min(F.when(F.col("place") < 0, F.col("first"))).alias("whole"),
        F.min(F.when(F.col("place") >= 0, F.col("first"))).alias("short"),
    )
    near = stored(made.join(groups.where("several").drop("several"), ["rest", "n"]).drop("words"), "line-groups")
    same_place = near.where("place >= 0").groupBy("rest", "n", "place").agg(F.min("first").alias("partner"))
    partners = (
        near.where("place >= 0").join(same_place, ["rest", "n", "place"]).select("first", "partner")
        .union(near.where("place >= 0 and whole is not null").select("first", "whole"))
        .union(near.where("place < 0 and short is not null").select("first", "short"))
        .where("partner < first")
        .distinct()
    )
    lines = made.where("place < 0").select("first", "words").dropDuplicates(["first"])
    claimed = partners.join(lines, "first").join(lines.select(F.col("first").alias("partner"), F.col("words").alias("partner_words")), "partner")
    return claimed.where(verified("words", "partner_words")).select("first").distinct()


def _own(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].alias("key"), text_hash(docs[text]).alias("t"), docs[text].alias("text"))


def kept_lines(own: DataFrame, edits: Edits = Edits()) -> tuple[DataFrame, DataFrame]:
    """own: key, t, text. (all, kept): all lines with a word as line_keys has them; (key, t, line) of those that stay."""
    rows = stored(line_keys(own, edits), "lines")
    # hashes of the whole and of a half, and a count, tell lines apart: 64 bits would meet by chance in a large corpus
    earliest = F.min(F.struct("key", "t", "line", "halves"))
    distinct = rows.groupBy("h", "n_words", F.try_element_at("halves", F.lit(1)).alias("half")).agg(earliest.alias("first"))
    distinct = stored(distinct.select(F.struct("first.key", "first.t", "first.line").alias("first"), "first.halves"), "distinct-lines")
    return rows, distinct.join(_edited(own, distinct, edits), "first", "left_anti").select("first.key", "first.t", "first.line")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: Edits = Edits()) -> DataFrame:
    """Per document (key and t, its text_hash) with a line to judge: n_lines, n_removed, removed (line numbers, ascending)."""
    rows, kept = kept_lines(_own(docs, key, text), edits)
    marked = rows.select("key", "t", "line", F.lit(1).alias("gone")).union(kept.select("key", "t", "line", F.lit(0)))
    state = marked.groupBy("key", "t", "line").agg(F.min("gone").alias("gone"))
    return state.groupBy("key", "t").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("gone").alias("n_removed"),
        F.sort_array(F.collect_list(F.when(F.col("gone") == 1, F.col("line")))).alias("removed"),
    ).withColumnRenamed("key", key)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: Edits = Edits()) -> DataFrame:
    """docs without the lines that go. A text that loses no line stays as it is, null included."""
    _, kept = kept_lines(_own(docs, key, text), edits)
    by_doc = kept.groupBy(F.col("key").alias("kept_key"), F.col("t").alias("kept_t")).agg(F.collect_list("line").alias("kept"))
    own, (of_key, at) = numbered(docs, key, text)
    same = own[f"c{of_key}"].eqNullSafe(by_doc["kept_key"]) & (text_hash(own[f"c{at}"]) == by_doc["kept_t"])
    names = own.columns
    joined = own.join(by_doc, same, "left").select(*names, "kept")

    def left(x: str, kept: set[int]) -> str:
        lines = x.split("\n")
        # as in line_keys, a word is what ASCII white space parts
        return "\n".join(line for i, line in enumerate(lines) if i in kept or not line.encode().split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            columns = batch.columns[:-1]
            columns[at] = pa.array([None if x is None else left(x, set(k or ())) for x, k in zip(batch.column(at).to_pylist(), batch.column("kept").to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, own.schema).toDF(*docs.columns)
