"""GPX files: tracks or routes, waypoints and texts.

strict: a point counts only with a closing tag of its own (``<trkpt ...>...</trkpt>``); lenient: also ``<trkpt ... />``.

``read`` gives a row for each file, which thus must fit a row. ``read_points`` gives a row for each point and reads files of any
length in parallel (see ``splits``): a file is cut behind tags, each split says how it moves a reader from each place of the
format to another, and gives its elements once its place is known; what is left of a point at its end goes to the next one.
Files whose elements aren't nested as the format says (cut short, say) are parsed whole, as by ``read``.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored
from . import splits

POINT = "struct<lat: double, lng: double, ele: double, time: timestamp>"
PARSED = (
    f"struct<title: string, description: string, points: array<{POINT}>, "
    "waypoints: array<struct<name: string, description: string, lat: double, lng: double>>>"
)


def tags(xml: str, name: str, lenient: bool = False) -> list[tuple[str, str]]:
    """(attributes, inner text) of each element of this name."""
    whole = rf"<{name}\b((?:[^>/]|/(?!>))*)>(.*?)</{name}\s*>"
    pattern = rf"<{name}\b((?:[^>/]|/(?!>))*)/>|{whole}" if lenient else whole
    return [(m[1] or m[2] or "", m[3] or "") if lenient else (m[1], m[2]) for m in re.finditer(pattern, xml, re.S | re.I)]


def attribute(attributes: str, name: str) -> float | None:
    found = re.search(rf"""\b{name}\s*=\s*["']\s*(-?[\d.]+(?:[eE]-?\d+)?)\s*["']""", attributes)
    return float(found[1]) if found else None


def text_of(xml: str, name: str) -> str | None:
    found = tags(xml, name)
    raw = re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", found[0][1], flags=re.S) if found else ""
    return " ".join(unescape(raw).split()) or None


def point(attributes: str, inner: str) -> dict | None:
    lat, lng = attribute(attributes, "lat"), attribute(attributes, "lon")
    if lat is None or lng is None:
        return None
    ele = pd.to_numeric(text_of(inner, "ele"), errors="coerce")
    time = pd.to_datetime(text_of(inner, "time"), utc=True, errors="coerce")
    return {"lat": lat, "lng": lng, "ele": None if pd.isna(ele) else float(ele), "time": None if pd.isna(time) else time.tz_localize(None)}


def unrepeated(points: list[dict]) -> list[dict]:
    key = lambda p: (p["lat"], p["lng"], p["ele"])
    return [p for i, p in enumerate(points) if i == 0 or key(p) != key(points[i - 1])]


def parse(xml: str | None, lenient: bool = False) -> dict | None:
    """The track, or the route where there is no track of two points; null with fewer than two points."""
    xml = xml or ""
    tracks, routes = tags(xml, "trk"), tags(xml, "rte")
    points = lambda blocks, name: unrepeated([p for _, b in blocks for a, inner in tags(b, name, lenient) if (p := point(a, inner))])
    own = points([s for _, t in tracks for s in tags(t, "trkseg")], "trkpt")
    own = own if len(own) > 1 else points(routes, "rtept")
    if len(own) < 2:
        return None
    places = [*(t[1] for t in tracks[:1]), *(r[1] for r in routes[:1]), *(m[1] for m in tags(xml, "metadata")[:1])]
    first = lambda name: next((x for p in places if (x := text_of(p, name))), None)
    waypoints = [
        {"name": text_of(inner, "name"), "description": text_of(inner, "desc") or text_of(inner, "cmt"), "lat": p["lat"], "lng": p["lng"]}
        for a, inner in tags(xml, "wpt", lenient) if (p := point(a, inner))
    ]
    return {"title": first("name"), "description": first("desc"), "points": own, "waypoints": waypoints}


def parsed(lenient: bool = False):
    """A column function: what a GPX text holds; null where it has no line."""

    @F.pandas_udf(PARSED)
    def of(xml: pd.Series) -> pd.DataFrame:
        none = {"title": None, "description": None, "points": None, "waypoints": None}
        return pd.DataFrame([parse(x, lenient) or none for x in xml], columns=["title", "description", "points", "waypoints"])

    return of


def read(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Per file: path and what it holds."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))
    return files.select("path", parsed(lenient)(F.col("xml")).alias("gpx")).where("gpx.points is not null").select("path", "gpx.*")


def points(tracks: DataFrame, key: str = "path") -> DataFrame:
    """A point table: track_id, seq, lat, lng, ele, time."""
    return tracks.select(F.col(key).alias("track_id"), F.posexplode("points").alias("seq", "p")).select("track_id", "seq", "p.*")


CUT = ">"
#: What each element lies in, and those that are points.
PARENT = {"metadata": "", "trk": "", "trkseg": "trk", "trkpt": "trkseg", "rte": "", "rtept": "rte", "wpt": ""}
POINTS = ("trkpt", "rtept", "wpt")
_NAMES = "metadata|trkseg|trkpt|trk|rtept|rte|wpt"
TOKEN = re.compile(rf"<(?:({_NAMES})\b([^>]*)|/({_NAMES})\s*)>", re.I)
RANKS = {"trk": 1, "rte": 2, "metadata": 3}
PART = "path string, start long, seq long, kind string, rank int, text string, note string, lat double, lng double, ele double, time timestamp, edge int"


def step(state: str | None, token: re.Match) -> str | None:
    """The element that one is in after a tag; None if the tag has no place there."""
    opened, attributes, closed = token.groups()
    if closed:
        name = closed.lower()
        return PARENT[name] if state == name else None
    name = opened.lower()
    if attributes.endswith("/"):
        return state if state == PARENT[name] or not (name in POINTS or state in POINTS) else None
    return name if state == PARENT[name] and "<" not in attributes else None


def cut_at(text: str) -> int:
    """Behind the last tag that doesn't open a point; 0 if there is none."""
    at = 0
    for token in TOKEN.finditer(text):
        if not token[1] or token[1].lower() not in POINTS or token[2].endswith("/"):
            at = token.end()
    return at


def _moves(text: str) -> tuple[dict[str, str], Counter]:
    """By the element that a text begins in: the one that it ends in; and how many tracks, routes and metadata it opens."""
    live = {s: [s] for s in ("", *PARENT)}
    opened = Counter()
    for token in TOKEN.finditer(text):
        after: dict[str, list[str]] = {}
        for state, origins in live.items():
            if (new := step(state, token)) is not None:
                after.setdefault(new, []).extend(origins)
        live = after
        if token[1] and not token[2].endswith("/"):
            opened[token[1].lower()] += 1
    return {o: s for s, origins in live.items() for o in origins}, Counter({k: opened[k] for k in RANKS})


def _then(a: tuple, b: tuple) -> tuple:
    return {o: b[0][s] for o, s in a[0].items() if s in b[0]}, a[1] + b[1]


NO_MOVE = ({s: s for s in ("", *PARENT)}, Counter())


def summary(text: str, _: None) -> tuple:
    """Moves up to the last cut (None if there is none), moves from there on, and the text from there on."""
    at = cut_at(text)
    return _moves(text[:at]) if at else None, _moves(text[at:]), text[at:]


def composed(first: tuple, later: dict) -> tuple:
    body, rest, tail = first
    body2, rest2, tail2 = later[None]
    if body2 is None:
        return body, _then(rest, rest2), tail + tail2
    own = _then(rest, body2)
    return (own if body is None else _then(body, own)), rest2, tail2


def _follow(parts: list[dict], begin: tuple) -> list[tuple | None]:
    """What each part starts with: element, what has been opened, and what the one before it has left; all None if the file isn't regular."""
    found, at, left, tail = [], ({"": ""}, Counter()), NO_MOVE, ""
    for part in parts:
        body, rest, own = part[None]
        found.append((at[0].get(""), at[1], tail))
        if body is None:
            left, tail = _then(left, rest), tail + own
        else:
            at, left, tail = _then(_then(at, left), body), rest, own
    regular = _then(at, left)[0].get("") == ""
    return found if regular else [None] * len(parts)


def _times(raw: list[str | None]) -> pd.Series:
    """Points of time as ``point`` reads them."""
    found = pd.to_datetime(pd.Series(raw, dtype=object), utc=True, errors="coerce", format="ISO8601")
    other = [i for i, x in enumerate(raw) if x is not None and pd.isna(found[i])]
    found = pd.Series(found.dt.tz_localize(None).to_numpy("datetime64[us]"))
    for i in other:
        time = pd.to_datetime(raw[i], utc=True, errors="coerce")
        found.iloc[i] = pd.NaT if pd.isna(time) else time.tz_localize(None)
    return found


class _Fragments:
    """Goes over the fragments of a split, each up to a cut, and gives their elements."""

    def __init__(self, file: str, start: int, state: str, opened: Counter, lenient: bool) -> None:
        self.file, self.start, self.state, self.lenient = file, start, state, lenient
        self.opened = Counter(opened)
        self.seq = 0

    def batch(self, text: str) -> pa.RecordBatch:
        texts: list[tuple] = []  # kind, rank, text
        points: list[tuple] = []  # kind, lat, lng, ele and time as texts, name, description
        place = self.state if self.state in RANKS else PARENT.get(self.state) or None
        body = 0 if place else None  # where the part of a track, route or metadata begins that lies here

        def named(kind: str, part: str) -> None:
            if self.opened[kind] == 1:  # the first of its kind
                texts.extend((name, RANKS[kind], text_of(part, name)) for name in ("name", "desc") if tags(part, name))

        for token in TOKEN.finditer(text):
            opened, attributes, closed = token.groups()
            if closed:
                name = closed.lower()
                if name in RANKS:
                    named(name, text[body : token.start()])
                    place = body = None
                elif name in POINTS:
                    self.add(points, name, point_open[0], text[point_open[1] : token.start()])
                continue
            name = opened.lower()
            if attributes.endswith("/"):
                if self.lenient and name in POINTS:
                    self.add(points, name, attributes[:-1], "")
            elif name in POINTS:
                point_open = attributes, token.end()
            elif name in RANKS:
                self.opened[name] += 1
                place, body = name, token.end()
        if place:
            named(place, text[body:])
        for token in TOKEN.finditer(text):
            self.state = step(self.state, token)
        return self.made(texts, points)

    def add(self, points: list[tuple], kind: str, attributes: str, inner: str) -> None:
        lat, lng = attribute(attributes, "lat"), attribute(attributes, "lon")
        if lat is None or lng is None:
            return
        if kind == "wpt":
            points.append((kind, lat, lng, None, None, text_of(inner, "name"), text_of(inner, "desc") or text_of(inner, "cmt")))
        else:
            points.append((kind, lat, lng, text_of(inner, "ele") if inner else None, text_of(inner, "time") if inner else None, None, None))

    def made(self, texts: list[tuple], points: list[tuple]) -> pa.RecordBatch:
        heights = pd.to_numeric(pd.Series([p[3] for p in points], dtype=object), errors="coerce").astype(float).tolist()
        times = _times([p[4] for p in points])
        heights = [None if x != x else x for x in heights]
        kept, last = [], {}
        for i, (kind, lat, lng, *_) in enumerate(points):
            key = lat, lng, heights[i]
            if kind == "wpt" or last.get(kind) is None or last[kind][0] != key:
                last[kind] = key, len(kept)
                kept.append(i)
        # the first (1) of each kind is compared with the last (2) of the fragment before
        edges = [0] * len(kept)
        for kind, (_, place) in last.items():
            edges[place] |= 2
            edges[next(j for j, i in enumerate(kept) if points[i][0] == kind)] |= 1
        own, n = [points[i] for i in kept], len(texts) + len(kept)
        none = [None] * len(texts)
        columns = [
            [self.file] * n, [self.start] * n, range(self.seq, self.seq + n), [*(t[0] for t in texts), *(p[0] for p in own)], [*(t[1] for t in texts), *(0 for _ in own)],
            [*(t[2] for t in texts), *(p[5] for p in own)], [*none, *(p[6] for p in own)], [*none, *(p[1] for p in own)], [*none, *(p[2] for p in own)], [*none, *(heights[i] for i in kept)],
        ]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        moments = pa.array(times.iloc[kept] if kept else [], pa.timestamp("us"), from_pandas=True).cast(pa.timestamp("us", "UTC"))
        arrays += [pa.concat_arrays([pa.nulls(len(texts), pa.timestamp("us", "UTC")), moments]), pa.array([*(0 for _ in texts), *edges], pa.int32())]
        self.seq += n
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in PART.split(", ")])


def read_points(spark: SparkSession, path: str, lenient: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three frames, by path: title and description; points in order of (start, seq) with lat, lng, ele and time; and waypoints. Files of any length."""
    found = splits.pieces(spark, path, CUT)
    at = splits.places(found, CUT, (None,), summary, composed, _follow, None)

    def run(file: str, start: int, context: tuple | None, chunks: Iterator[str]) -> Iterator[pa.RecordBatch]:
        if context is None:
            return
        state, opened, held = context
        own = _Fragments(file, start, state, opened, lenient)
        for chunk in chunks:
            text = held + chunk
            cut = cut_at(text)
            held = text[cut:]
            if cut:
                yield own.batch(text[:cut])

    # read more than once below
    parts = stored(splits.each_split(found, CUT, at, run, PART), "gpx-parts")
    names = [c.split()[0] for c in PART.split(", ")]
    odd = at.where(F.col("context") == F.lit(pickle.dumps(None))).select(F.col("file").alias("path")).distinct()
    if not odd.isEmpty():
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml")).join(odd, "path", "left_semi")
        whole = stored(whole.select("path", parsed(lenient)(F.col("xml")).alias("gpx")).where("gpx.points is not null"), "gpx-whole")
        blank = {"start": "0L", "seq": "0L", "rank": "1", "text": "string(null)", "note": "string(null)", "lat": "double(null)", "lng": "double(null)", "ele": "double(null)", "time": "timestamp(null)", "edge": "0"}
        row = lambda df, **own: df.select(*[F.expr((blank | own).get(c, c)).alias(c) for c in names])
        parts = (
            parts.union(row(whole, kind="'name'", text="gpx.title")).union(row(whole, kind="'desc'", text="gpx.description"))
            .union(row(whole.select("path", F.posexplode("gpx.points").alias("k", "p")), kind="'trkpt'", seq="bigint(k)", lat="p.lat", lng="p.lng", ele="p.ele", time="p.time"))
            .union(row(whole.select("path", F.posexplode("gpx.waypoints").alias("k", "p")), kind="'wpt'", seq="bigint(k)", text="p.name", note="p.description", lat="p.lat", lng="p.lng"))
        )
    key = F.struct("lat", "lng", "ele")
    before = F.lag(key).over(Window.partitionBy("path", "kind").orderBy("start", "seq"))
    # two rows at most of each kind for each few megabytes
    repeated = parts.where("edge > 0 and kind <> 'wpt'").withColumn("again", before.isNotNull() & before.eqNullSafe(key)).where("again and edge <> 2").select("path", "start", "seq")
    points = parts.where("kind in ('trkpt', 'rtept')").join(repeated, ["path", "start", "seq"], "left_anti")
    counts = points.groupBy("path").agg(F.count_if(F.col("kind") == "trkpt").alias("t"), F.count_if(F.col("kind") == "rtept").alias("r"))
    kind = F.when(F.col("t") > 1, "trkpt").when(F.col("r") > 1, "rtept")
    lines = counts.select("path", kind.alias("kind")).where("kind is not null")
    first = parts.where("kind in ('name', 'desc')").groupBy("path", "kind", "rank").agg(F.min_by("text", F.struct("start", "seq")).alias("text")).where("text is not null")
    of = lambda name: F.min_by("text", F.when(F.col("kind") == name, F.col("rank")))
    texts = first.groupBy("path").agg(of("name").alias("title"), of("desc").alias("description"))
    tracks = lines.select("path").join(texts, "path", "left")
    own = points.join(lines, ["path", "kind"], "left_semi").select("path", "start", "seq", "lat", "lng", "ele", "time")
    waypoints = parts.where("kind = 'wpt'").join(lines, "path", "left_semi").select("path", "start", "seq", F.col("text").alias("name"), F.col("note").alias("description"), "lat", "lng")
    return tracks, own, waypoints
