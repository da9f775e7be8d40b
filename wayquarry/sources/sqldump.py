"""Rows of SQL dumps: INSERT INTO ... VALUES statements, as MySQL writes them.

A dump of any length is read in parallel (see ``splits``): it is cut after closing brackets, so that one statement of many rows is shared by
many tasks. A cut may lie in a string, a quoted name or a comment; ``reduced`` says for each of these what a text leaves to the one after it: the
state that it ends in, and of its last statement only what a reader must know, its head and the row that is still open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import splits

# Escapes in quoted strings.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "b": "\b", "Z": "\x1a"}
CUT = ")"
STRING, DOUBLE, NAME, LINE, BLOCK, CODE = "'", '"', "`", "-", "*", ""
STATES = (CODE, STRING, DOUBLE, NAME, LINE, BLOCK)
#: What is left of a state's text, the sign that ends it included.
REST = {
    STRING: re.compile(r"(?:[^'\\]++|\\.)*+'", re.S),
    DOUBLE: re.compile(r'(?:[^"\\]++|\\.)*+"', re.S),
    NAME: re.compile(r"[^`]*+`"),
    LINE: re.compile(r"[^\n]*+\n"),
    BLOCK: re.compile(r".*?\*/", re.S),
}
_COMMENT = r"--(?=\s)[^\n]*+\n|\#[^\n]*+\n|/\*.*?\*/"
_QUOTED = r"'(?:[^'\\]++|\\.)*+'|\"(?:[^\"\\]++|\\.)*+\"|`[^`]*+`"
#: Code without signs of structure; a string or comment that doesn't end isn't part of it.
PLAIN = re.compile(rf"(?:[^'\"`;()\#/-]++|{_QUOTED}|{_COMMENT}|-(?!-\s|-\Z)|/(?!\*))*+", re.S)
SPACE = re.compile(rf"(?:\s++|{_COMMENT})*+", re.S)
HEAD = re.compile(r"INSERT\s+(?:IGNORE\s+)?INTO\s+`?(\w+)`?\s*(?:\(([^)]*)\))?\s*VALUES\b\s*", re.I)
# a comment, a string with its character set, a bare value, or a sign of structure; none where a string or a comment doesn't end
TOKEN = re.compile(rf"\s*+(?:(?:{_COMMENT})|(?:_\w+\s*)?'((?:[^'\\]++|\\.|'')*+)'|(?!--\s|--\Z|\#|/\*)([^\s,()';]+)|([(),;]))", re.S)
INSIDE = re.compile(r"\\(.)|''", re.S)


def unquoted(text: str) -> str:
    return INSIDE.sub(lambda m: ESCAPES.get(m[1], m[1]) if m[1] is not None else "'", text)


def reduced(text: str, state: str = CODE) -> tuple[str, bool, str]:
    """The state that a text read in ``state`` ends in, whether a statement ended in it, and what is left for what follows.

    Left is the text of the last statement without the rows between its second closing bracket (the first may close the list of
    names) and its last opening one. Where no statement ended, it continues what came before, in the state given.
    """
    at = base = 0
    if state != CODE:
        rest = REST[state].match(text)
        if not rest:
            return state, False, text
        at = rest.end()
    ended, closed, second, last = False, 0, 0, 0
    while (end := PLAIN.match(text, at).end()) < len(text) and (sign := text[end]) in ";()":
        at = end + 1
        if sign == ";":
            ended, base, closed, second, last = True, at, 0, 0, at
        elif sign == "(":
            last = end
        else:
            closed, last = closed + 1, at
            if closed == 2:
                second = at
    left = text[base:second] + text[max(last, second) :] if closed > 2 else text[base:]
    if end == len(text):
        return CODE, ended, left
    return {"'": STRING, '"': DOUBLE, "`": NAME, "/": BLOCK}.get(text[end], LINE), ended, left


def composed(first: tuple, later: dict) -> tuple:
    """What two texts do one after the other: first as (start, end, ended, left), later by the state it starts in."""
    start, end, ended, left = first
    _, last, ended_later, left_later = later[end]
    if ended_later:
        return start, last, True, left_later
    return start, last, ended, reduced(left + left_later, CODE if ended else start)[2]


def _follow(parts: list[dict], begin: str) -> list[str]:
    """What each part starts with: of the statement that it stands in, the head and the open row."""
    found, state, left = [], CODE, begin
    for part in parts:
        found.append(left)
        _, state, ended, more = part[state]
        left = reopened(more if ended else reduced(left + more)[2])
    return found


def reopened(left: str) -> str:
    """An INSERT's head and its open row: rows that are closed were given where they ended."""
    at = SPACE.match(left).end()
    if not (head := HEAD.match(left, at)):
        return left
    row, at = "", head.end()
    while (end := PLAIN.match(left, at).end()) < len(left) and left[end] in ";()":
        at = end + 1
        row = left[end:] if left[end] == "(" else left[at:]
    return left[: head.end()] + row


def inserts(dump: str, table: str) -> Iterator[tuple[list[str], list[str | None]]]:
    """(column names as far as given, values) of each row that is inserted into the table. Statements of other kinds are passed over."""
    at = 0
    while (at := SPACE.match(dump, at).end()) < len(dump):
        head = HEAD.match(dump, at)
        if not head:
            while (end := PLAIN.match(dump, at).end()) < len(dump) and dump[end] in "()":
                at = end + 1
            if end == len(dump) or dump[end] != ";":
                return
            at = end + 1
            continue
        names = [n.strip(" `\n\r\t") for n in head[2].split(",")] if head[2] else []
        wanted = head[1].lower() == table.lower()
        row: list[str | None] | None = None
        at = head.end()
        while token := TOKEN.match(dump, at):
            at = token.end()
            text, bare, sign = token.groups()
            if sign == ";":
                break
            if sign == "(":
                row = []
            elif sign == ")" and row is not None:
                if wanted:
                    yield names, row
                row = None
            elif row is not None and (text is not None or bare):
                row.append(unquoted(text) if text is not None else None if bare.upper() == "NULL" else bare)
        else:
            return


def _rows(spark: SparkSession, path: str, table: str, schema: str, take) -> DataFrame:
    """take(file, iterator of (names, values)) gives the record batches of each chunk of a split."""
    found = splits.pieces(spark, path, CUT)
    summary = lambda text, state: (state, *reduced(text, state))
    at = splits.places(found, CUT, STATES, summary, composed, _follow, "")

    def run(file: str, start: int, left: str, texts: Iterator[str]) -> Iterator[pa.RecordBatch]:
        for text in texts:
            text = left + text
            yield from take(file, inserts(text, table))
            left = reopened(reduced(text)[2])

    return splits.each_split(found, CUT, at, run, schema)


def malformed(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """What ``read`` leaves out: file and the number of the table's rows that have another number of values than names."""

    def take(file: str, rows: Iterator) -> Iterator[pa.RecordBatch]:
        n = sum(len(names or columns) != len(values) for names, values in rows)
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n], pa.int64())], names=["file", "n"])

    return _rows(spark, path, table, "file string, n long", take).groupBy("file").agg(F.sum("n").alias("n")).where("n > 0")


def read(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """The table's rows as strings; rows with another number of values are left out (see ``malformed``).

    Names in a statement take precedence over ``columns``, which must name those wanted.
    """

    def take(file: str, found: Iterator) -> Iterator[pa.RecordBatch]:
        rows: list[list[str | None]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(columns))], names=columns)

        for names, values in found:
            own = names or columns
            if len(own) == len(values):
                by_name = dict(zip(own, values))
                rows.append([by_name.get(c) for c in columns])
            if len(rows) >= 10_000:
                yield batch()
                rows = []
        yield batch()

    return _rows(spark, path, table, ", ".join(f"`{c}` string" for c in columns), take)


def without_placeholders(rows: DataFrame) -> DataFrame:
    """Blank strings as nulls."""
    return rows.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns])
