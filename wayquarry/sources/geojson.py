"""Features of GeoJSON collections of any length, read in parallel.

A collection is cut after closing braces (see ``splits``). A cut may lie in a string, and at any depth of nesting: what a split
does to the depth is a number for each of both, and which array it leaves open at the root is one of the few that it opened, by
how deep they lie against its start. With the true start known, each split gives the features that lie in it whole; those that a cut goes through are
put together from the parts that their splits give.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import splits

CUT = "}"
CODE, STRING = "", '"'
_TEXT = r'"(?:[^"\\]++|\\.)*+"'
_VALUE = r"\s*+:\s*+"
REST = re.compile(r'(?:[^"\\]++|\\.)*+"', re.S)
# what has no part in the nesting; then a type, or an opening bracket with its key, or a closing one
TOKEN = re.compile(
    rf'(?:[^"\[\]{{}}]++|\[[^"\[\]{{}}]*+\]|(?!"type"{_VALUE}"){_TEXT}(?!{_VALUE}[\[{{]))*+(?:"type"{_VALUE}({_TEXT})|(?:({_TEXT}){_VALUE})?([\[{{])|([\]}}]))', re.S
)
PLAIN = re.compile(rf'(?:[^"]++|{_TEXT})*+', re.S)
FEATURES = ("[", "features")
COLLECTION = "FeatureCollection"


def _decoded(text: str | None) -> str | None:
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def _begin(text: str, state: str) -> int | None:
    """Where code begins in a text that starts in the state; None if its string doesn't end."""
    if state == CODE:
        return 0
    rest = REST.match(text)
    return rest.end() if rest else None


def nesting(text: str, state: str) -> tuple[str, int, dict, dict]:
    """The state it ends in, by how much it is deeper then, and by depth against the start: the last bracket opened there with its key, and the first type."""
    at = _begin(text, state)
    if at is None:
        return STRING, 0, {}, {}
    code = at
    depth, opened, types = 0, {}, {}
    while token := TOKEN.match(text, at):
        at = token.end()
        kind, key, bracket, _ = token.groups()
        if kind:
            types.setdefault(depth, _decoded(kind))
        elif bracket:
            opened[depth] = bracket, _decoded(key)
            depth += 1
        else:
            depth -= 1
    return (CODE if PLAIN.match(text, max(at, code)).end() == len(text) else STRING), depth, opened, types


def composed(first: tuple, later: dict) -> tuple:
    end, depth, opened, types = first
    last, deeper, opened_later, types_later = later[end]
    types = {k + depth: v for k, v in types_later.items()} | types
    return last, depth + deeper, opened | {k + depth: v for k, v in opened_later.items()}, types


def _follow(parts: list[dict], begin: tuple) -> list[tuple]:
    """What each part starts in: state, depth, what is open at the root; and whether the file is a collection."""
    found, kind = [], None
    state, depth, container = begin
    for part in parts:
        found.append((state, depth, container))
        state, deeper, opened, types = part[state]
        container = opened.get(1 - depth, container)
        kind = kind or types.get(1 - depth)
        depth += deeper
    return [(*x, kind == COLLECTION) for x in found]


def parts_of(texts: Iterator[str], state: str, depth: int, container: tuple | None) -> Iterator[tuple[str, str]]:
    """Features that lie in a split, as (kind, text): whole, or the head, middle or tail of a cut one (head: its start)."""
    kept: list[str] | None = [] if depth >= 3 and container == FEATURES else None
    kind = "middle"  # of what is kept: begun before this split, or (head) in it
    for text in texts:
        start = 0
        at = _begin(text, state)
        if at is None:
            at = len(text)
        else:
            state = CODE
            while token := TOKEN.match(text, at):
                at = token.end()
                _, key, bracket, closing = token.groups()
                if bracket:
                    if depth == 1:
                        container = bracket, _decoded(key)
                    elif depth == 2 and container == FEATURES and bracket == "{":
                        kept, kind, start = [], "head", at - 1
                    depth += 1
                elif closing:
                    depth -= 1
                    if depth == 2 and kept is not None:
                        yield ("tail" if kind == "middle" else "whole"), "".join([*kept, text[start:at]])
                        kept = None
            state = CODE if PLAIN.match(text, at).end() == len(text) else STRING
        if kept is not None:
            kept.append(text[start:])
    if kept:
        yield kind, "".join(kept)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path and feature (its JSON text) of each feature of the collections at path. Other files give none."""
    found = splits.pieces(spark, path, CUT)
    at = splits.places(found, CUT, (CODE, STRING), nesting, composed, _follow, (CODE, 0, None))

    def run(file: str, start: int, context: tuple, chunks: Iterator[str]) -> Iterator[pa.RecordBatch]:
        state, depth, container, wanted = context
        if not wanted:
            return
        rows: list[tuple[str, str]] = []
        seq = size = 0

        def batch() -> pa.RecordBatch:
            n = len(rows)
            columns = [pa.array([file] * n), pa.array([start] * n, pa.int64()), pa.array(range(seq - n, seq), pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["path", "start", "seq", "kind", "feature"])

        for row in parts_of(chunks, state, depth, container):
            rows.append(row)
            seq, size = seq + 1, size + len(row[1])
            if size > splits.CHUNK_CHARS:
                yield batch()
                rows, size = [], 0
        yield batch()

    parts = splits.each_split(found, CUT, at, run, "path string, start long, seq long, kind string, feature string")
    # two parts a split at most: a cut feature is its head and all up to its tail
    order = Window.partitionBy("path").orderBy("start", "seq")
    cut = parts.where("kind <> 'whole'").withColumn("nth", F.sum(F.when(F.col("kind") == "head", 1).otherwise(0)).over(order))
    joined = cut.groupBy("path", "nth").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "seq", "feature"))), lambda p: p["feature"]), "").alias("feature"))
    return parts.where("kind = 'whole'").select("path", "feature").union(joined.select("path", "feature"))
