"""Nearest neighbours and boxes on a grid of cells: equi-joins on cells, never all pairs.

``within`` gives all pairs within a radius, so what it gives grows with density. ``closest`` gives one point for each probe and divides
cells where points lie close, so its work for a probe is bounded whatever the density.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, cell, cells_around, haversine_km
from ..storage import stored

#: Points among which the probes of a cell look one by one; a cell that has more around it is cut into four.
LEAF = 48
#: The grid begins with 2^FIRST cells each way and ends with 2^LAST.
FIRST, LAST = 3, 28


def check_radius(km: float, size: float, max_lat: float = 60.0) -> None:
    """The nine cells around a point hold all within the radius only if a cell is as wide as the radius."""
    width = size * math.cos(math.radians(max_lat)) * 2 * math.pi * 6371 / 360
    if km > width:
        raise ValueError(f"radius {km} km is wider than a cell of {size} degrees at latitude {max_lat} ({width:.3f} km)")


def within(probe: DataFrame, points: DataFrame, km: float, size: float, max_lat: float = 60.0) -> DataFrame:
    """Pairs within a radius: all columns of probe (with p_lat, p_lng) and points (with lat, lng), and km.

    The probe's row goes to nine cells, a point to one; cells that hold many rows are split by Spark's skew join.
    """
    check_radius(km, size, max_lat)
    dealt = probe.withColumn("_c", F.explode(cells_around(F.col("p_lat"), F.col("p_lng"), size))).select("*", F.col("_c.x").alias("_x"), F.col("_c.y").alias("_y")).drop("_c")
    placed = points.withColumns({"_x": cell(F.col("lng"), size), "_y": cell(F.col("lat"), size)})
    joined = dealt.join(placed, ["_x", "_y"]).drop("_x", "_y")
    return joined.withColumn("km", haversine_km(F.col("p_lat"), F.col("p_lng"), F.col("lat"), F.col("lng"))).where(F.col("km") <= km)


def nearest(probe: DataFrame, points: DataFrame, key: str, point: str, km: float, size: float = 0.01, score: Column | None = None, where: Column | None = None, tie: Sequence[str] = (), max_lat: float = 60.0) -> DataFrame:
    """probe's key with the best point within the radius (least score, distance by default) and its km.

    Ties go by ``tie`` columns, then by the least point. Probes without one have no row.
    """
    if score is None and where is None and not tie:
        check_radius(km, size, max_lat)
        return closest(probe, points, key, point, km)
    pairs = within(probe, points, km, size, max_lat)
    pairs = pairs.where(where) if where is not None else pairs
    best = F.min_by(F.struct(F.col(point), "km"), F.struct((F.col("km") if score is None else score).alias("score"), *tie, F.col(point)))
    return pairs.groupBy(key).agg(best.alias("hit")).select(key, f"hit.{point}", "hit.km")


def _bounds(size: float, south: float, west: float) -> tuple[Column, Column]:
    """The least and the greatest haversine of a place in cell (px, py) to one in cell (qx, qy); both grow with the distance."""
    slack = size * 1e-6 + 1e-12  # cells of rounded quotients
    apart = lambda a, b: F.abs(F.col(a) - F.col(b))
    low = lambda a, b: F.greatest((apart(a, b) - 1) * size - slack, F.lit(0.0))
    high = lambda a, b: (apart(a, b) + 1) * size + slack
    # across the meridian of 180 degrees the way round is shorter
    near_lng = F.greatest(F.least(low("px", "qx"), 360 - high("px", "qx")), F.lit(0.0))
    far_lng = F.least(high("px", "qx"), F.lit(180.0))

    def cosines(y: str) -> tuple[Column, Column]:
        a, b = south + F.col(y) * size - slack, south + (F.col(y) + 1) * size + slack
        farthest, least = F.greatest(F.abs(a), F.abs(b)), F.when((a < 0) & (b > 0), 0.0).otherwise(F.least(F.abs(a), F.abs(b)))
        return F.when(farthest <= 90, F.cos(F.radians(farthest))).otherwise(-1.0), F.cos(F.radians(F.least(least, F.lit(90.0))))

    (p_low, p_high), (q_low, q_high) = cosines("py"), cosines("qy")
    wave = lambda degrees: F.pow(F.sin(F.radians(degrees) / 2), 2)
    least = wave(low("py", "qy")) + F.when(F.least(p_low, q_low) < 0, -1.0).otherwise(p_low * q_low) * wave(near_lng)
    return least, wave(F.least(high("py", "qy"), F.lit(180.0))) + p_high * q_high * wave(far_lng)


def closest(probe: DataFrame, points: DataFrame, key: str, point: str, km: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """probe's key with the nearest point (the least of equals) and its km: within a radius if there is one, of equal ``by`` columns.

    Cells with probes are paired with the cells of points that may hold their nearest one: a cell is left out if all of it is farther
    than all of another one that has points. A cell with more than LEAF points around it is cut into four, and so are those paired with it;
    so a probe is compared with about LEAF points at last. Points at one place are one.
    """
    by = list(by)
    there = lambda df, *names: df.dropna(subset=[*by, *names])
    probes = stored(there(probe.select(key, *by, F.col("p_lat").cast("double").alias("p_lat"), F.col("p_lng").cast("double").alias("p_lng")), "p_lat", "p_lng"), "probes")
    at = points.select(*by, F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), F.col(point).alias("_point"))
    sites = stored(there(at, "lat", "lng").groupBy(*by, "lat", "lng").agg(F.min("_point").alias("_point")), "sites")
    ends = probes.select(F.col("p_lat").alias("lat"), F.col("p_lng").alias("lng")).union(sites.select("lat", "lng"))
    south, north, west, east = ends.agg(F.min("lat"), F.max("lat"), F.min("lng"), F.max("lng")).first()
    whole = max(north - south, east - west, 1e-9) * 1.000001 if south is not None else 1.0
    south, west = south or 0.0, west or 0.0
    placed = lambda df, level, x, y, lat, lng: df.withColumns({x: cell(F.col(lng) - F.lit(west), whole / 2**level), y: cell(F.col(lat) - F.lit(south), whole / 2**level)})
    radius = None if km is None else math.sin(min(km / (2 * EARTH_KM), math.pi / 2)) ** 2 * 1.000001 + 1e-18

    found, above = [], None
    for level in range(FIRST, LAST + 1):
        size = whole / 2**level
        p = placed(probes, level, "px", "py", "p_lat", "p_lng").select(*by, "px", "py").distinct()
        q = placed(sites, level, "qx", "qy", "lat", "lng").groupBy(*by, "qx", "qy").agg(F.count(F.lit(1)).alias("n"))
        if above is None:
            pairs = p.join(q, by) if by else p.crossJoin(q)  # at most 64 cells each
        else:
            up = lambda df, x, y: df.withColumns({f"{x}_": F.shiftright(x, 1), f"{y}_": F.shiftright(y, 1)})
            over = above.withColumnsRenamed({c: f"{c}_" for c in ("px", "py", "qx", "qy")})
            pairs = over.join(up(p, "px", "py"), [*by, "px_", "py_"]).join(up(q, "qx", "qy"), [*by, "qx_", "qy_"])
        least, most = _bounds(size, south, west)
        own = Window.partitionBy(*by, "px", "py")
        judged = pairs.select(*by, "px", "py", "qx", "qy", "n", least.alias("least"), most.alias("most")).withColumn("bound", F.min("most").over(own))
        kept = judged.where((F.col("least") <= F.col("bound")) & (F.col("least") <= radius if radius is not None else F.lit(True)))
        done = stored(kept.select(*by, "px", "py", "qx", "qy", (F.sum("n").over(own) <= LEAF).alias("few")), "cell-pairs")
        leaves = done.where("few") if level < LAST else done
        around = leaves.join(placed(sites, level, "qx", "qy", "lat", "lng"), [*by, "qx", "qy"]).groupBy(*by, "px", "py").agg(F.collect_list(F.struct("lat", "lng", "_point")).alias("_sites"))
        found.append(placed(probes, level, "px", "py", "p_lat", "p_lng").join(around, [*by, "px", "py"]).select(key, "p_lat", "p_lng", "_sites"))
        above = done.where("not few").drop("few")
        if above.isEmpty():
            break
    hit = F.array_min(F.transform("_sites", lambda s: F.struct(haversine_km(F.col("p_lat"), F.col("p_lng"), s["lat"], s["lng"]).alias("km"), s["_point"].alias("point"))))
    best = reduce(DataFrame.unionByName, found).select(key, hit.alias("hit")).select(key, F.col("hit.point").alias(point), "hit.km")
    return best.where(F.col("km") <= km) if km is not None else best


def in_box(points: DataFrame, south: float, west: float, north: float, east: float, padding: float = 0.0) -> DataFrame:
    """Points within a box; plain ranges on two columns, so files' statistics skip what lies elsewhere."""
    return points.where(F.col("lat").between(south - padding, north + padding) & F.col("lng").between(west - padding, east + padding))


def deduplicated(points: DataFrame, stored: DataFrame, km: float, size: float, key: str = "id") -> DataFrame:
    """Points that have no stored one within the radius."""
    probe = points.select(key, F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    check_radius(km, size)
    near = closest(probe, stored.withColumn("_stored", F.lit(0)), key, "_stored", km)
    return points.join(near.select(key), key, "left_anti")
