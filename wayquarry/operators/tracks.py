"""Tracks: profiles of ordered points, matches of points to network nodes, distances of node lists.

A point table has track_id, seq, lat, lng, ele and time. Windows run within a track; tracks are independent.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.coerce import js_round
from .nearest import closest, nearest

MOST_PROFILE_POINTS = 250


def along(by: Sequence[str] = ("track_id",), order: Sequence[str] = ("seq",)):
    return Window.partitionBy(*by).orderBy(*order)


def without_repeats(points: DataFrame, columns: Sequence[str] = ("lat", "lng", "ele"), by: Sequence[str] = ("track_id",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Points that differ from the point just before them."""
    w = along(by, order)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = points.withColumn("_same", same & (F.row_number().over(w) > 1))
    return marked.where("not _same").drop("_same")


def with_distance(points: DataFrame) -> DataFrame:
    """step_km from the point before (0 for the first) and km from the start."""
    w = along()
    step = geo.haversine_km(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    stepped = points.withColumn("step_km", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn("km", F.sum("step_km").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def climbs(points: DataFrame) -> DataFrame:
    """Per track: gain and loss between points with an elevation, rounded; null instead of zero."""
    d = F.col("ele") - F.lag("ele").over(along())
    delta = points.where("ele is not null").withColumn("d", d)
    sums = delta.groupBy("track_id").agg(F.sum(F.greatest("d", F.lit(0.0))).alias("up"), F.sum(F.greatest(-F.col("d"), F.lit(0.0))).alias("down"))
    some = lambda c: F.when(F.col(c) > 0, js_round(c).cast("long"))
    return sums.select("track_id", some("up").alias("gain"), some("down").alias("loss"))


def durations(points: DataFrame) -> DataFrame:
    """Per track: minutes from the first to the last point with a time, in order of points; null unless positive."""
    timed = points.where("time is not null").groupBy("track_id").agg(F.min_by("time", "seq").alias("first"), F.max_by("time", "seq").alias("last"))
    micros = F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))
    return timed.select("track_id", F.when(micros > 0, js_round(micros / 6e7).cast("long")).alias("minutes"))


def sampled(points: DataFrame, most: int = MOST_PROFILE_POINTS) -> DataFrame:
    """Every k-th point of a track, with the least k that leaves about ``most``, and the last point."""
    return _thinned(points, most).where("_kept").drop("_kept")


def _thinned(points: DataFrame, most: int) -> DataFrame:
    """points with whether they are sampled (_kept)."""
    place, n = F.row_number().over(along()) - 1, F.count(F.lit(1)).over(Window.partitionBy("track_id"))
    numbered = points.withColumns({"_place": place, "_n": n})
    kept = (F.col("_n") <= most) | (F.col("_place") % F.ceil(F.col("_n") / most) == 0) | (F.col("_place") == F.col("_n") - 1)
    return numbered.withColumn("_kept", kept).drop("_place", "_n")


def profiles(points: DataFrame) -> DataFrame:
    """Per track of two points or more: distance_km, minutes, gain, loss, start, end, and the elevation profile.

    Points without a track are one too, of unknown gain, loss and minutes. start and end are the first and the last point that have a place.
    """
    clean = without_repeats(points)
    measured = _thinned(with_distance(clean), MOST_PROFILE_POINTS)
    at, placed = F.struct("lat", "lng"), F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.col("seq"))
    curve = F.struct("seq", js_round("km", 2).alias("km"), js_round("ele", 1).alias("elevation"))
    whole = measured.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n_points"), js_round(F.max("km"), 2).alias("distance_km"), F.min_by(at, placed).alias("start"), F.max_by(at, placed).alias("end"),
        F.sort_array(F.collect_list(F.when(F.col("_kept"), curve))).alias("profile"),
    )
    joined = whole.where("n_points >= 2").join(climbs(clean), "track_id", "left").join(durations(clean), "track_id", "left")
    return joined.withColumn("profile", F.transform("profile", lambda p: F.struct(p["km"].alias("km"), p["elevation"].alias("elevation"))))


def segment_lengths(rows: DataFrame, by: Sequence[str], order: Sequence[str], cumulative: str = "cumulative_km") -> DataFrame:
    """segment_km: what a running distance grew by, never less than zero."""
    before = F.coalesce(F.lag(cumulative).over(along(by, order)), F.lit(0.0))
    return rows.withColumn("segment_km", F.greatest(F.col(cumulative) - before, F.lit(0.0)))


def prefix_sums(segments: Column) -> Column:
    """Running sums of an array, with a leading zero."""
    return F.aggregate(segments, F.array(F.lit(0.0)), lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x)))


def kept_matches(matches: pd.DataFrame, gap: int = 10) -> pd.DataFrame:
    """Of a track's matches in order, those that stay: not the node kept last, nor one kept less than ``gap`` points ago."""
    kept, last_at, last = [], {}, None
    for row in matches.sort_values("seq").itertuples():
        if row.node_id == last or row.seq - last_at.get(row.node_id, -gap) < gap:
            continue
        kept.append(row.Index)
        last_at[row.node_id] = row.seq
        last = row.node_id
    return matches.loc[kept]


def nodes_along(points: DataFrame, nodes: DataFrame, metres: float = 50.0) -> DataFrame:
    """Network nodes that tracks pass: track_id, seq, node_id, km. The nearest node within 50 m of each point, thinned along the track."""
    probe = points.select(F.struct("track_id", "seq").alias("key"), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    hits = nearest(probe, nodes.select(F.col("id").alias("node_id"), "lat", "lng"), "key", "node_id", metres / 1000)
    flat = hits.select("key.track_id", "key.seq", "node_id", "km")
    return flat.groupBy("track_id").applyInPandas(lambda own: kept_matches(own), flat.schema)


def waypoint_nodes(waypoints: DataFrame, nodes: DataFrame) -> DataFrame:
    """Waypoints (track_id, seq, name, lat, lng) named like node numbers, at the nearest node of that number, else where they are."""
    named = waypoints.where(F.col("name").rlike(r"^\s*\d+[A-Za-z]?\s*$")).withColumn("number", F.trim("name"))
    at = F.struct("track_id", "seq", "number", "lat", "lng").alias("waypoint")
    probe = named.select(at, "number", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng")).distinct()
    node = nodes.select("number", "lat", "lng", F.struct("id", "lat", "lng").alias("node"))
    best = closest(probe, node, "waypoint", "node", by=["number"])
    # a waypoint without a place has no nearest node, it takes the first one of its number
    first = nodes.groupBy("number").agg(F.min(F.struct("id", "lat", "lng")).alias("_first"))
    lost = named.where("lat is null or lng is null").select(at, "number").distinct().join(first, "number").select("waypoint", F.col("_first").alias("node"))
    joined = named.select(at).distinct().join(best.select("waypoint", "node").unionByName(lost), "waypoint", "left")
    return joined.select("waypoint.track_id", "waypoint.seq", "waypoint.number", F.col("node.id").alias("node_id"), F.coalesce("node.lat", "waypoint.lat").alias("lat"), F.coalesce("node.lng", "waypoint.lng").alias("lng"))


def choose_candidates(rows: pd.DataFrame, near: float = 250.0, back: int = 5) -> pd.DataFrame:
    """Of a route's candidates, one for each node in order: the choice depends on the one before it.

    rows: place, candidate_id, lat, lng, route_index, route_metres, expected_gap_km. Candidates off the route count only where
    there is none near it, those behind the last choice only where none lies ahead; then the nearest to the last
    choice, the best fitting distance, the earliest along the route, the nearest to it.
    """
    chosen, at, last = [], 0, None
    for _, own in rows.sort_values(["place", "candidate_id"]).groupby("place"):
        pool = own[own["route_metres"].isna() | (own["route_metres"] <= near)]
        pool = pool if len(pool) else own
        ahead = pool[pool["route_index"].isna() | (pool["route_index"] >= at - back)]
        pool = (ahead if len(ahead) else pool).copy()
        gone = (pool["lat"] - last[0]) ** 2 + ((pool["lng"] - last[1]) * 0.63) ** 2 if last is not None else 0.0
        pool["_gone"] = gone
        best = pool.sort_values(["_gone", "expected_gap_km", "route_index", "route_metres", "candidate_id"], na_position="last").iloc[0]
        chosen.append(best.drop("_gone"))
        last = best["lat"], best["lng"]
        if not pd.isna(best["route_index"]):
            at = int(best["route_index"])
    return pd.DataFrame(chosen).astype(rows.dtypes.to_dict()) if chosen else rows.iloc[:0]


def chosen_nodes(candidates: DataFrame) -> DataFrame:
    """One candidate for each route_id and place, chosen along each route."""
    return candidates.groupBy("route_id").applyInPandas(lambda own: choose_candidates(own), candidates.schema)


def nearest_index(path: Column, lat: Column, lng: Column) -> Column:
    """struct(km, index): the point of a path that is nearest to a place."""
    return F.array_min(F.transform(path, lambda p, i: F.struct(geo.haversine_km(lat, lng, p["lat"], p["lng"]).alias("km"), i.alias("index"))))


SCALES = (1.0, 0.1, 0.01, 0.001)


def normalised_distances(raw: Column, n: Column, expected: Column) -> Column:
    """Running distances of n nodes from the numbers that were written down.

    They may be running or single distances, one total for all, or miss the leading zero, and be in any of a few
    units. Of all readings the one with the least penalty is taken (five times the first distance, and how far
    the last one is from the expected length, or from zero without one); the first of equals. Empty if no reading fits.
    """
    zero = F.array(F.lit(0.0))
    size = F.size(raw)
    rising = F.forall(F.arrays_zip(F.slice(raw, 1, F.greatest(size - 1, F.lit(0))).alias("a"), F.slice(raw, F.lit(2), F.greatest(size - 1, F.lit(0))).alias("b")), lambda p: p["b"] >= p["a"])
    all_but_last = F.slice(raw, F.lit(1), F.greatest(size - 1, F.lit(0)))
    spread = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(1))), lambda i: F.get(raw, F.lit(0)) / F.greatest(n - 1, F.lit(1)) * i)
    readings = F.array_compact(F.array(
        F.when(size == n, raw),
        F.when((size == n) & (F.get(raw, F.lit(0)) > 0), F.concat(zero, all_but_last)),
        F.when((size == n - 1) & (size != n), prefix_sums(raw)),
        F.when((size == n - 1) & rising, F.concat(zero, raw)),
        F.when((size == 1) & (n > 2), spread),
    ))
    tried = F.flatten(F.transform(readings, lambda r, i: F.transform(F.array(*map(F.lit, SCALES)), lambda s, j: F.struct((i * len(SCALES) + j).alias("order"), F.transform(r, lambda x: x * s).alias("km")))))
    last = lambda x: F.coalesce(F.get(x, F.size(x) - 1), F.lit(0.0))
    off = lambda x: F.abs(F.coalesce(F.get(x, F.lit(0)), F.lit(0.0))) * 5 + F.when(expected > 0, F.abs(last(x) - expected)).otherwise(last(x))
    best = F.array_min(F.transform(tried, lambda t: F.struct(off(t["km"]).alias("penalty"), t["order"].alias("order"), t["km"].alias("km"))))
    return F.when(n > 0, F.coalesce(best["km"], F.array().cast("array<double>"))).otherwise(F.array().cast("array<double>"))


def autofilled(routes: DataFrame, parsed: DataFrame) -> DataFrame:
    """routes with what their tracks say: texts only where blank, measures always.

    parsed: route_id, title, description, distance_km, minutes, gain, loss.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    p = parsed.select("route_id", *[F.col(c).alias(f"_{c}") for c in ("title", "description", "distance_km", "minutes", "gain", "loss")], F.lit(True).alias("_there"))
    joined = routes.join(p, "route_id", "left")
    text = {c: F.when(blank(c), F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in ("title", "description")}
    measure = {c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("distance_km", "minutes", "gain", "loss")}
    return joined.withColumns(text | measure).select(*routes.columns)


def merged_starts(starts: DataFrame) -> DataFrame:
    """Start locations of a route that are the same place (name, five decimals, city): one row with the first value of each column."""
    from ..functions.text import slug
    from .rows import filled_first

    keyed = starts.withColumns({"_name": slug(F.coalesce("name", F.lit(""))), "_lat": js_round("latitude", 5), "_lng": js_round("longitude", 5), "_city": F.col("city")})
    rest = [c for c in starts.columns if c != "route_id"]
    return filled_first(keyed, ["route_id", "_name", "_lat", "_lng", "_city"], F.col("ordinal"), rest).select(*starts.columns)
