"""Fill-in-the-middle: a document's prefix, suffix and middle are put in the order in which a model is to learn them.

The units of a text (lines by default) are the matches of a pattern, from left to right over code points. They are never
stored: a first pass counts them; from the count and the digest of the key come two ranks; a second pass moves a lazy
iterator over the matches to the lesser rank and on to the greater one. Besides the text and the output only a few
numbers are held, whatever the number of units, and texts are taken on by bytes, a long one alone.

``transform`` chooses by the key alone, so a lost executor's rows come out the same again. Null texts count as empty, a null key as
the empty text; repeated rows each get the same result; empty texts and texts that hold a mark stay plain. What lies between two units
that a pattern leaves out stays with the part in which it lies. ``restored`` gives the text back from output and form.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, pieces

LINES = r"[^\n]*\n|[^\n]+"
PLAIN, PREFIX_FIRST, SUFFIX_FIRST = "plain", "psm", "spm"


@dataclass(frozen=True)
class Format:
    """Marks before prefix, suffix and middle; of 100 texts about ``rate`` are changed, of these ``suffix_first`` put the suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 100
    suffix_first: int = 50
    seed: str = "7"
    units: str = LINES

    def __post_init__(self) -> None:
        for i, a in enumerate(self.marks):
            for j, b in enumerate(self.marks):
                if not a or (i != j and a in b) or any(b.startswith(a[k:]) for k in range(1, len(a))):
                    raise ValueError(f"the marks {a!r} and {b!r} can't be told apart")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def digest(key: object, seed: str) -> list[int]:
    """The first four groups of eight hexadecimal digits of the key's digest."""
    found = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(found[k : k + 8], 16) for k in range(0, 32, 8)]


def count_units(units: re.Pattern, text: str) -> int:
    """The first pass."""
    return sum(1 for _ in units.finditer(text))


def cuts(units: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """The second pass: where unit number ``low`` ends, and unit number ``high`` (from 1; 0 is the text's start)."""
    matches = units.finditer(text)
    ends = []
    done = end = 0
    for rank in (low, high):
        for match in islice(matches, rank - done):
            end = match.end()
        done = rank
        ends.append(end)
    return ends[0], ends[1]


def arranged(key: object, text: str, form: Format, units: re.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, output."""
    n = count_units(units, text)
    h = digest(key, form.seed)
    if not text or any(m in text for m in form.marks) or h[2] % 100 >= form.rate:
        return n, PLAIN, None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = cuts(units, text, low, high)
    if h[3] % 100 < form.suffix_first:
        return n, SUFFIX_FIRST, a, b - a, "".join((form.suffix, text[b:], form.prefix, text[:a], form.middle, text[a:b]))
    return n, PREFIX_FIRST, a, b - a, "".join((form.prefix, text[:a], form.suffix, text[b:], form.middle, text[a:b]))


ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def transform(docs: DataFrame, form: Format = Format(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the columns of ADDED; columns of docs of these names are replaced."""
    kept = docs.select(*[docs[c] for c in docs.columns if c.lower() not in ADDED or c.lower() in (key.lower(), text.lower())])
    own, (k, t) = numbered(kept, key, text)
    own = own.withColumn("_key", F.col(f"c{k}").cast("string"))
    added = T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")
    schema = T.StructType([*own.schema.fields[:-1], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = re.compile(form.units)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in pieces(batches, t):
            found = [arranged(a, x or "", form, units) for a, x in zip(batch.column(batch.num_columns - 1).to_pylist(), batch.column(t).to_pylist())]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return own.mapInArrow(run, schema).toDF(*kept.columns, *ADDED)


def restored(output: Column, form: Column, marks: Format = Format()) -> Column:
    """The text that an output was made from. No part holds a mark, so the marks part it."""
    parts = F.split(output, "|".join(re.sub(r"[^\w\s]", lambda m: "\\" + m[0], m) for m in marks.marks))
    part = lambda k: F.get(parts, k)
    return (
        F.when(form == PREFIX_FIRST, F.concat(part(1), part(3), part(2)))
        .when(form == SUFFIX_FIRST, F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )
