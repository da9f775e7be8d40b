"""Geometry on columns. A path is an array of struct<lat, lng>; a run is struct<from, to, code> along a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import col, js_round, loose_number

EARTH_KM = 6371.0
METRES_A_DEGREE = 111_320.0
PATH = "array<struct<lat: double, lng: double>>"
RUNS = "array<struct<from: double, to: double, code: int>>"


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def planar_metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Distance on a plane that touches half-way; good for short stretches."""
    east = (lng1 - lng2) * METRES_A_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(F.pow((lat1 - lat2) * METRES_A_DEGREE, 2) + F.pow(east, 2))


def to_segment(lat: Column, lng: Column, a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column) -> Column:
    """struct(metres, east, north): distance of a point to a segment, and the segment's direction."""
    across = METRES_A_DEGREE * F.cos(F.radians(lat))
    ax, ay = (a_lng - lng) * across, (a_lat - lat) * METRES_A_DEGREE
    dx, dy = (b_lng - a_lng) * across, (b_lat - a_lat) * METRES_A_DEGREE
    squared = dx * dx + dy * dy
    t = F.when(squared > 0, F.least(F.greatest(-(ax * dx + ay * dy) / squared, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    length = F.when(squared > 0, F.sqrt(squared)).otherwise(1.0)
    metres = F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))
    return F.struct(metres.alias("metres"), (dx / length).alias("east"), (dy / length).alias("north"))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size)


def cells_around(lat: Column, lng: Column, size: float) -> Column:
    """The nine cells at and around a point: array of struct(x, y)."""
    near = F.array(*map(F.lit, (-1, 0, 1)))
    return F.flatten(F.transform(near, lambda dx: F.transform(near, lambda dy: F.struct((cell(lng, size) + dx).alias("x"), (cell(lat, size) + dy).alias("y")))))


def cells_of_box(south: Column, west: Column, north: Column, east: Column, size: float) -> Column:
    """All cells that a box touches: array of struct(x, y)."""
    xs, ys = F.sequence(cell(west, size), cell(east, size)), F.sequence(cell(south, size), cell(north, size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def cells_along(a: Column, b: Column, size: float, metres: float) -> Column:
    """The cells in which a point within ``metres`` of the segment from a to b may lie: array of struct(x, y)."""
    d_lat = metres / METRES_A_DEGREE * 1.001
    # the least cosine on the way; distances take the cosine of any latitude, so one beyond a pole is as wide as its mirror
    low, high = F.least(a["lat"], b["lat"]) - d_lat, F.greatest(a["lat"], b["lat"]) + d_lat
    over_pole = F.floor((low + 90) / 180) != F.floor((high + 90) / 180)
    narrow = F.when(over_pole, 0.0).otherwise(F.least(F.abs(F.cos(F.radians(low))), F.abs(F.cos(F.radians(high)))))
    d_lng = d_lat / F.greatest(narrow, F.cos(F.radians(F.lit(89.9))))
    wide = b["lng"] - a["lng"]
    steep = F.abs(wide) < 1e-12  # in one column from end to end

    def rows(x: Column) -> Column:
        # where along the segment this column begins and ends, a margin on both sides included
        ends = [(edge - a["lng"]) / wide for edge in (x * size - d_lng, (x + 1) * size + d_lng)]
        inside = lambda t: a["lat"] + (b["lat"] - a["lat"]) * F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        one, other = (F.when(steep, p["lat"]).otherwise(inside(t)) for p, t in zip((a, b), ends))
        found = F.sequence(cell(F.least(one, other) - d_lat, size), cell(F.greatest(one, other) + d_lat, size))
        return F.transform(found, lambda y: F.struct(x.alias("x"), y.alias("y")))

    columns = F.sequence(cell(F.least(a["lng"], b["lng"]) - d_lng, size), cell(F.greatest(a["lng"], b["lng"]) + d_lng, size))
    return F.flatten(F.transform(columns, rows))


def box(path: Column) -> Column:
    of = lambda name, f: f(F.transform(path, lambda p: p[name]))
    return F.struct(of("lat", F.array_min).alias("south"), of("lng", F.array_min).alias("west"), of("lat", F.array_max).alias("north"), of("lng", F.array_max).alias("east"))


def segments(path: Column) -> Column:
    """array of struct(seq, a, b) of consecutive points."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(path, 1, n).alias("a"), F.slice(path, F.lit(2), n).alias("b"))
    return F.transform(pairs, lambda s, i: F.struct(i.alias("seq"), s["a"].alias("a"), s["b"].alias("b")))


def path_km(path: Column) -> Column:
    step = lambda total, s: total + haversine_km(s["a"]["lat"], s["a"]["lng"], s["b"]["lat"], s["b"]["lng"])
    return F.aggregate(segments(path), F.lit(0.0), step)


def centroid(path: Column) -> Column:
    """Mean of the distinct vertices of a ring."""
    points = F.array_distinct(path)
    mean = lambda name: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[name]) / F.size(points)
    return F.struct(mean("lat").alias("lat"), mean("lng").alias("lng"))


def rounded(path: Column, places: int = 5) -> Column:
    return F.transform(path, lambda p: F.struct(js_round(p["lat"], places).alias("lat"), js_round(p["lng"], places).alias("lng")))


def reversed_runs(runs: Column) -> Column:
    """Runs of a line read from its other end."""
    turn = lambda x: js_round(1 - x, 4)
    return F.transform(F.reverse(runs), lambda r: F.struct(turn(r["to"]).alias("from"), turn(r["from"]).alias("to"), r["code"].alias("code")))


def parsed_runs(raw: Column) -> Column:
    """Runs from arrays [from, to, code]; malformed and empty ranges go, unknown codes are -1."""
    good = F.filter(raw, lambda r: (F.size(r) >= 3) & (r[0] < r[1]))
    code = lambda c: F.when(c.isin(1.0, 0.0), c.cast("int")).otherwise(-1)
    return F.transform(good, lambda r: F.struct(r[0].alias("from"), r[1].alias("to"), code(r[2]).alias("code")))


def paved_share(runs: Column, code: int = 1) -> Column:
    """Percentage of the known length that has a code; null if nothing is known."""
    length = lambda keep: F.aggregate(F.filter(runs, keep), F.lit(0.0), lambda s, r: s + r["to"] - r["from"])
    known = length(lambda r: r["code"] >= 0)
    return F.when(known > 0, 100 * length(lambda r: r["code"] == code) / known)


def valid_point(lat: Column | str, lng: Column | str) -> Column:
    """Both are numbers and not both zero; a missing one counts as zero."""
    a, b = loose_number(lat), loose_number(lng)
    return F.coalesce(a.isNotNull() & b.isNotNull() & ~((a == 0) & (b == 0)), F.lit(False))


def lines_of(geometry: Column | str) -> Column:
    """The lines of a GeoJSON text (Feature, LineString or MultiLineString) as arrays of points; malformed points go."""
    shape = F.try_parse_json(col(geometry))
    inner = F.coalesce(F.try_variant_get(shape, "$.geometry", "variant"), shape)
    kind = F.try_variant_get(inner, "$.type", "string")
    one = F.try_variant_get(inner, "$.coordinates", "array<array<variant>>")
    many = F.try_variant_get(inner, "$.coordinates", "array<array<array<variant>>>")
    number = lambda v: loose_number(F.try_variant_get(v, "$", "string"))

    def points(line: Column) -> Column:
        pairs = F.transform(F.filter(line, lambda p: F.size(p) >= 2), lambda p: F.struct(number(p[1]).alias("lat"), number(p[0]).alias("lng")))
        return F.filter(pairs, lambda p: p["lat"].isNotNull() & p["lng"].isNotNull())

    found = F.when(kind == "LineString", F.array(points(one))).when(kind == "MultiLineString", F.transform(many, points))
    return F.coalesce(F.filter(found, lambda x: F.size(x) > 0), F.array().cast("array<" + PATH + ">"))


def joined(lines: Column) -> Column:
    """One path from several lines; a line whose end is nearer to what is there is turned."""

    def step(path: Column, line: Column) -> Column:
        last, start, end = F.element_at(path, -1), F.element_at(line, 1), F.element_at(line, -1)
        km = lambda p: haversine_km(last["lat"], last["lng"], p["lat"], p["lng"])
        turned = (F.size(path) > 0) & (km(end) < km(start))
        return F.concat(path, F.when(turned, F.reverse(line)).otherwise(line))

    # guarded, because an element of an empty path has no last point
    return F.aggregate(lines, F.array().cast(PATH), lambda path, line: F.when(F.size(path) == 0, line).otherwise(step(path, line)))


def oriented(path: Column, lat: Column, lng: Column, end_lat: Column, end_lng: Column) -> Column:
    """Whether a path should be turned to run from the first point to the second."""
    start = F.element_at(path, 1)
    return haversine_km(start["lat"], start["lng"], end_lat, end_lng) < haversine_km(start["lat"], start["lng"], lat, lng)
