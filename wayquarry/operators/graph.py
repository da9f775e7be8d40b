"""The route network as node and edge tables: building, boxes, shortest paths, links from routes.

Nodes: id, number, lat, lng, is_virtual. Connections: id, from_id, to_id, distance_km, geometry (GeoJSON text),
surface (array<array<double>>), mode, is_virtual. A built graph is a pair of tables:
nodes (id, number, lat, lng, is_virtual, modes) and edges (id, a, b, km, mode, is_virtual, surface, path, box).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.coerce import js_round, loose_number, node_number
from ..storage import discard, stored
from . import paths
from .nearest import nearest
from .rows import reduced

MODES = {"wandelen": 1, "fietsen": 2}
EDGE_CELL = 0.05
NODE_CELL = 0.01
TOLERANCE = 0.00003


def mode_bit(mode: Column) -> Column:
    return F.when(mode == "fietsen", MODES["fietsen"]).otherwise(MODES["wandelen"])


def mode_of_theme(slug: Column) -> Column:
    return F.when(F.lower(slug).contains("fiets"), "fietsen").otherwise("wandelen")


def with_mode(connections: DataFrame, networks: DataFrame) -> DataFrame:
    """Connections of published networks, with their own mode, else that of the network's theme.

    networks: network_id, theme, published. A connection without a network keeps its own mode or the default.
    """
    n = networks.select("network_id", "theme", F.coalesce("published", F.lit(False)).alias("published"), F.lit(True).alias("known"))
    found = connections.join(n, "network_id", "left").where("network_id is null or published")
    return found.withColumn("mode", F.coalesce(F.when(F.col("mode").isin(*MODES), F.col("mode")), mode_of_theme(F.col("theme")))).drop("theme", "published", "known")


def kept_points(lat: np.ndarray, lng: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker in degrees: which points of a line stay. Sections are split at their farthest point."""
    keep = np.zeros(len(lat), bool)
    keep[[0, -1]] = True
    sections = [(0, len(lat) - 1)]
    while sections:
        a, b = sections.pop()
        if b - a < 2:
            continue
        d = np.array([lng[b] - lng[a], lat[b] - lat[a]])
        p = np.stack([lng[a + 1 : b] - lng[a], lat[a + 1 : b] - lat[a]], axis=1)
        squared = d @ d
        t = np.clip(p @ d / squared, 0, 1) if squared > 0 else np.zeros(len(p))
        off = ((t[:, None] * d - p) ** 2).sum(axis=1)
        far = int(np.argmax(off))
        if off[far] > tolerance * tolerance:
            at = a + 1 + far
            keep[at] = True
            sections += [(a, at), (at, b)]
    return keep


def simplified(tolerance: float = TOLERANCE):
    """A column function: paths with fewer points, rounded to five decimals; lines of two points stay as they are."""

    @F.pandas_udf(geo.PATH)
    def of(paths: pd.Series) -> pd.Series:
        out = []
        for path in paths:
            if path is None or len(path) <= 2:
                out.append(path)
                continue
            lat, lng = np.array([p["lat"] for p in path]), np.array([p["lng"] for p in path])
            keep = kept_points(lat, lng, tolerance)
            r = lambda x: float(np.floor(x * 1e5 + 0.5) / 1e5)
            out.append([{"lat": r(a), "lng": r(b)} for a, b in zip(lat[keep], lng[keep])])
        return pd.Series(out, dtype=object)

    return of


def build(nodes: DataFrame, connections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph. Nodes without coordinates, loops, edges without both ends and exact doubles go; of doubles (equal mode, ends and length to 10 m) the least id stays."""
    lat, lng = loose_number("lat"), loose_number("lng")
    there = nodes.where(geo.valid_point("lat", "lng")).select("id", node_number("number").alias("number"), lat.alias("lat"), lng.alias("lng"), F.coalesce("is_virtual", F.lit(False)).alias("is_virtual"))
    end = lambda side: there.select(F.col("id").alias(side), F.struct("lat", "lng").alias(f"at_{side}"))
    ends = connections.where("from_id <> to_id").withColumnsRenamed({"from_id": "a", "to_id": "b"}).join(end("a"), "a").join(end("b"), "b")

    line = geo.joined(geo.lines_of("geometry"))
    ends = ends.withColumn("line", line)
    given = F.size("line") >= 2
    turned = F.coalesce(F.when(given, geo.oriented(F.col("line"), F.col("at_a.lat"), F.col("at_a.lng"), F.col("at_b.lat"), F.col("at_b.lng"))), F.lit(False))
    path = F.when(~given, F.array("at_a", "at_b")).when(turned, F.reverse("line")).otherwise(F.col("line"))
    runs = F.when(F.col("surface").isNotNull(), geo.parsed_runs(F.col("surface")))
    shaped = ends.withColumns({"path": path, "surface": F.when(turned, geo.reversed_runs(runs)).otherwise(runs)})
    source = loose_number("distance_km")
    measured = shaped.withColumn("full_km", F.when(source > 0, source).otherwise(geo.path_km(F.col("path"))))

    double = measured.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b"), "length": F.floor(F.col("full_km") * 100 + 0.5)})
    single = reduced(double, ["mode", "low", "high", "length"], F.col("id"))
    edges = single.withColumn("path", simplified()(F.col("path"))).select(
        "id", "a", "b", js_round("full_km", 3).alias("km"), "mode", F.coalesce("is_virtual", F.lit(False)).alias("is_virtual"), "surface", "path", geo.box(F.col("path")).alias("box")
    )
    edges = stored(edges, "graph-edges")
    used = edges.select(F.explode(F.array("a", "b")).alias("id"), mode_bit(F.col("mode")).alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("modes"))
    return stored(there.join(used, "id"), "graph-nodes"), edges


def edges_in_box(edges: DataFrame, south: float, west: float, north: float, east: float, mode: str, most: int = 8000) -> tuple[DataFrame, DataFrame]:
    """(edges that touch the box, one row with n and truncated). At most ``most`` edges, by cell and id.

    truncated holds as soon as that many were found.
    """
    if not (south < north and west < east):
        raise ValueError("a box goes from south to north and from west to east")
    touching = edges.where((F.col("mode") == mode) & (F.col("box.north") >= south) & (F.col("box.south") <= north) & (F.col("box.east") >= west) & (F.col("box.west") <= east))
    first = lambda low, limit: F.greatest(geo.cell(F.col(low), EDGE_CELL), geo.cell(F.lit(limit), EDGE_CELL))
    found = touching.orderBy(first("box.west", west), first("box.south", south), "id").limit(most)
    counted = found.agg(F.count(F.lit(1)).alias("n")).withColumn("truncated", F.col("n") >= most)
    return found, counted


def compact(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each edge and each node at its ends, as positional arrays of text: kind, values."""
    n = ends_of(edges, nodes).select(F.lit("node").alias("kind"), F.array(*[F.col(c).cast("string") for c in ("id", "number", "lat", "lng")]).alias("row"))
    e = edges.select(F.lit("edge"), F.array(*[F.col(c).cast("string") for c in ("id", "a", "b", "km")]))
    return n.union(e)


def checked_box(south: float, west: float, north: float, east: float, max_lng: float = 0.6, max_lat: float = 0.4) -> tuple[float, float, float, float]:
    """A request's box, if its numbers are finite, ordered and not too far apart."""
    box = (south, west, north, east)
    if not all(np.isfinite(box)) or south >= north or west >= east or north - south > max_lat or east - west > max_lng:
        raise ValueError("not a box that may be asked for")
    return box


def ends_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes at the ends of edges."""
    return nodes.join(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")


#: Steps (an edge has two) of a graph that is sent to every task whole: some 25 MB as arrays, and 8 MB for each landmark of a million nodes.
MAX_SENT_STEPS = 2_000_000


def shortest_paths(nodes: DataFrame, edges: DataFrame, requests: DataFrame, direct_only: bool = False, most: int = MAX_SENT_STEPS) -> DataFrame:
    """Per request (request, from_id, to_id, mode): km and node_ids of the shortest path; requests without one have no row.

    Equal lengths go by fewer edges, then by the lesser list of nodes. direct_only: no numbered node may lie
    between the ends. A network of up to ``most`` steps is sent to the tasks, which search it for each of their
    requests; a larger one by its border nodes (see ``paths``), or, where nodes have no place or cells no size that fits, for all
    requests at once, an edge a round.
    """
    known = nodes.select("id")
    asked = requests.join(known, requests["from_id"] == known["id"], "left_semi").join(known, requests["to_id"] == known["id"], "left_semi").select("request", "from_id", "to_id", "mode")
    steps = edges.select("mode", F.col("a").alias("node"), F.col("b").alias("next"), "km").union(edges.select("mode", "b", "a", "km"))
    steps = steps.groupBy("mode", "node", "next").agg(F.min("km").alias("step_km"))
    if direct_only:
        steps = steps.join(nodes.select(F.col("id").alias("next"), (F.col("number") == "").alias("passes")), "next")
    else:
        steps = steps.withColumn("passes", F.lit(True))
    steps = stored(steps.select("mode", "node", "next", "step_km", "passes"), "path-steps")
    if steps.count() <= most:
        found = paths.searched(steps, asked).where(F.col("outcome") == paths.FOUND)
    else:
        found = paths.by_cells(steps, asked, nodes, most) if {"lat", "lng"} <= set(nodes.columns) else None
        found = by_rounds(steps, asked) if found is None else found
    return found.select("request", js_round("dist", 3).alias("km"), "node_ids")


def path_outcomes(nodes: DataFrame, edges: DataFrame, requests: DataFrame, most_looked: int = 400_000) -> DataFrame:
    """Per request: outcome (found, no way, given up after so many nodes), km, and how many nodes were looked at. For networks that are sent whole."""
    known = nodes.select("id")
    asked = requests.join(known, requests["from_id"] == known["id"], "left_semi").join(known, requests["to_id"] == known["id"], "left_semi").select("request", "from_id", "to_id", "mode")
    steps = edges.select("mode", F.col("a").alias("node"), F.col("b").alias("next"), "km").union(edges.select("mode", "b", "a", "km"))
    steps = stored(steps.groupBy("mode", "node", "next").agg(F.min("km").alias("step_km")).withColumn("passes", F.lit(True)), "path-steps")
    if steps.count() > MAX_SENT_STEPS:
        raise ValueError("this network is too large to be sent whole")
    found = paths.searched(steps, asked, most_looked)
    return requests.select("request").join(found, "request", "left").select("request", F.coalesce("outcome", F.lit(paths.NONE)).alias("outcome"), js_round("dist", 3).alias("km"), F.coalesce("looked", F.lit(0)).cast("long").alias("looked"))


def by_rounds(steps: DataFrame, asked: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Paths by labels that advance an edge a round, for all requests together.

    Only labels that got better in the last round, and are no longer than the best way to their target, go on and
    carry their list of nodes; of older ones the distance is kept, in a table for each round. Rounds that are
    spent are deleted.
    """
    start = F.col("from_id")
    front = stored(asked.select("request", "mode", "to_id", start.alias("node"), F.lit(0.0).alias("dist"), F.array(start).alias("node_ids")), "path-front")
    settled = [stored(front.select("request", "node", "dist"), "path-labels")]
    ends = [stored(front.where("node = to_id").select("request", "dist", "node_ids"), "path-ends")]
    for _ in range(rounds):
        best = reduce(DataFrame.union, ends).groupBy("request").agg(F.min("dist").alias("best"))
        onward = front.where("node <> to_id").join(steps, ["mode", "node"]).join(best, "request", "left").withColumn("new", F.col("dist") + F.col("step_km"))
        onward = onward.where("(best is null or new <= best) and (passes or next = to_id)").where(~F.array_contains("node_ids", F.col("next")))
        label = F.struct(F.col("new").alias("dist"), F.concat("node_ids", F.array("next")).alias("node_ids"))
        moved = onward.groupBy("request", "mode", "to_id", F.col("next").alias("node")).agg(F.min(label).alias("x"))
        before = reduce(DataFrame.union, settled).groupBy("request", "node").agg(F.min("dist").alias("was"))
        better = moved.join(before, ["request", "node"], "left").where("was is null or x.dist < was")
        spent, front = front, stored(better.select("request", "mode", "to_id", "node", "x.*"), "path-front")
        discard(spent)
        if front.isEmpty():
            break
        settled.append(stored(front.select("request", "node", "dist"), "path-labels"))
        ends.append(stored(front.where("node = to_id").select("request", "dist", "node_ids"), "path-ends"))
        if len(settled) > 16:
            joint = stored(reduce(DataFrame.union, settled).groupBy("request", "node").agg(F.min("dist").alias("dist")), "path-labels")
            for old in settled:
                discard(old)
            settled = [joint]
    else:
        raise RuntimeError("paths did not settle")
    for old in settled:
        discard(old)
    return reduce(DataFrame.union, ends).groupBy("request").agg(F.min(F.struct("dist", F.size("node_ids").alias("n"), "node_ids")).alias("x")).select("request", "x.dist", "x.node_ids")


def planner_paths(nodes: DataFrame, edges: DataFrame, requests: DataFrame, detour: float = 4.0) -> DataFrame:
    """Shortest paths; where one passes a numbered node, the direct way if there is one of at most ``detour`` times its length."""
    shortest = stored(shortest_paths(nodes, edges, requests), "paths")
    between = shortest.select("request", F.explode(F.slice("node_ids", 2, F.greatest(F.size("node_ids") - 2, F.lit(0)))).alias("id"))
    passing = between.join(nodes.where("number <> ''"), "id").select("request").distinct()
    again = requests.join(passing, "request", "left_semi")
    direct = shortest_paths(nodes, edges, again, direct_only=True).select("request", F.col("km").alias("direct_km"), F.col("node_ids").alias("direct_ids"))
    both = shortest.join(direct, "request", "left")
    take = F.coalesce(F.col("direct_km") <= F.col("km") * detour, F.lit(False))
    return both.select("request", F.when(take, F.col("direct_km")).otherwise(F.col("km")).alias("km"), F.when(take, F.col("direct_ids")).otherwise(F.col("node_ids")).alias("node_ids"), take.alias("direct"))


def path_steps(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Per request and step (from 0): the edge that was taken, with path and surface in the direction of travel."""
    ids = F.col("node_ids")
    hops = paths.select("request", "mode", F.posexplode(F.arrays_zip(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))).alias("here"), F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))).alias("there"))).alias("step", "x"))
    hops = hops.select("request", "mode", "step", "x.here", "x.there", F.least("x.here", "x.there").alias("low"), F.greatest("x.here", "x.there").alias("high"))
    sided = edges.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
    best = reduced(sided, ["mode", "low", "high"], F.struct("km", "id"))
    joined = hops.join(best, ["mode", "low", "high"])
    back = F.col("a") != F.col("here")
    return joined.select("request", "step", F.col("id").alias("edge"), "km", back.alias("reversed"), F.when(back, F.reverse("path")).otherwise(F.col("path")).alias("path"),
                         F.when(back, geo.reversed_runs(F.col("surface"))).otherwise(F.col("surface")).alias("surface"))


def nearest_nodes(nodes: DataFrame, probe: DataFrame, key: str, km: float = 0.2) -> DataFrame:
    """Per probe (key, p_lat, p_lng, mode, wanted): the nearest node of its mode; one with the wanted number counts as ten times nearer."""
    of_mode = F.col("modes").bitwiseAND(mode_bit(F.col("mode"))) != 0
    wanted = node_number("wanted")
    score = F.when((wanted != "") & (F.col("number") == wanted), F.col("km") / 10).otherwise(F.col("km"))
    points = nodes.select(F.col("id").alias("node_id"), "number", "lat", "lng", "modes")
    return nearest(probe, points, key, "node_id", km, NODE_CELL, score=score, where=of_mode)


def route_links(routes: DataFrame, nodes: DataFrame, least_share: float = 0.8) -> DataFrame:
    """Per route (route_id, mode, start_km, points: array<struct<number, order, km, lat, lng>>): node_ids on the network and km.

    Points in order are matched to nodes, repeated matches collapse; a route counts if two nodes and 80 % of its
    points were matched. km: that of the start, else the last point's, else null.
    """
    points = routes.select("route_id", "mode", F.explode("points").alias("p")).select("route_id", "mode", "p.*")
    placed = points.where(geo.valid_point("lat", "lng")).withColumns({"key": F.struct("route_id", "order"), "p_lat": F.col("lat"), "p_lng": F.col("lng"), "wanted": F.col("number")})
    hits = nearest_nodes(nodes, placed.select("key", "mode", "p_lat", "p_lng", "wanted"), "key").select("key.route_id", "key.order", "node_id")
    per_route = hits.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("order", "node_id"))).alias("matched"))
    ids = F.transform("matched", lambda m: m["node_id"])
    collapsed = F.aggregate(ids, F.array().cast("array<bigint>"), lambda out, x: F.when(F.size(out) == 0, F.array(x)).when(F.element_at(out, -1) == x, out).otherwise(F.concat(out, F.array(x))))
    last_km = F.element_at(F.sort_array(F.transform("points", lambda p: F.struct(p["order"].alias("order"), p["km"].alias("km")))), -1)["km"]
    joined = routes.join(per_route, "route_id").withColumn("node_ids", collapsed)
    usable = (F.size("node_ids") >= 2) & (F.size("matched") >= least_share * F.size("points"))
    km = F.coalesce(F.when(F.col("start_km") > 0, F.col("start_km")), F.when(F.size("points") > 0, last_km))
    return joined.where(usable).select("route_id", "mode", "node_ids", km.alias("km"))


def routes_through(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Routes of links that pass any of the wanted nodes (node_id), each once with how many it passes."""
    return links.select("route_id", F.explode(F.array_distinct("node_ids")).alias("node_id")).join(wanted, "node_id", "left_semi").groupBy("route_id").agg(F.count(F.lit(1)).alias("n_nodes"))
