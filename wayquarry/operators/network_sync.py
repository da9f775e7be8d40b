"""Synchronising a stored network with published sources: feature pairs, regional layers, map relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.coerce import blank_to_null, js_round, kilometres, source_number
from ..functions.text import network_key
from ..sources.files import CONNECTION_NAMES, NODE_NAMES, named, property_of
from .match import first_of_list
from .nearest import nearest
from .rows import ordinals, reduced
from .stitching import stitched
from .surface import classified, tag_code
from .sync import diff, guarded

#: Guards of the removal of stale rows: nodes, edges, and the share of what is kept; edges for map relations.
LEAST_NODES, LEAST_EDGES, LEAST_SHARE, LEAST_RELATIONS = 10_000, 15_000, 0.8, 5_000
#: What counts as equal: degrees, and kilometres from a layer or from relations.
SAME_DEGREES, SAME_KM, SAME_RELATION_KM = 1e-6, 1e-3, 0.005


def feature_nodes(features: DataFrame, lat_names: list[str] | None = None, lng_names: list[str] | None = None) -> DataFrame:
    """Nodes of point features: external_id, number, name, lat, lng. Coordinates by property, else of the point; rows without an id or a place go."""
    found = named(features, NODE_NAMES)
    own = property_of(F.col("properties"), lat_names or ["latitude", "lat", "y"]), property_of(F.col("properties"), lng_names or ["longitude", "lng", "lon", "x"])
    place = F.from_json("geometry", "type string, coordinates array<double>")["coordinates"]
    at = found.withColumns({"lat": F.coalesce(source_number(own[0]), F.get(place, F.lit(1))), "lng": F.coalesce(source_number(own[1]), F.get(place, F.lit(0)))})
    kept = at.where("external_id is not null and lat is not null and lng is not null").select("external_id", "number", "name", "lat", "lng")
    return reduced(kept, ["external_id"], F.struct("lat", "lng", "number", "name"))


def feature_connections(features: DataFrame, unit: str = "km") -> DataFrame:
    """Connections of line features: external_id, from_key, to_key, distance_km, geometry."""
    found = named(features, CONNECTION_NAMES).where("external_id is not null and from_key is not null and to_key is not null")
    own = found.withColumn("distance_km", kilometres("distance", unit)).select("external_id", "from_key", "to_key", "distance_km", "geometry")
    return reduced(own, ["external_id"], F.struct("from_key", "to_key", "geometry"))


def with_ends(connections: DataFrame, nodes: DataFrame) -> DataFrame:
    """from_id and to_id by the nodes' external ids, else by their numbers (the least id of several); unresolved ones keep a null."""
    by_id = nodes.where("external_id is not null").groupBy("external_id").agg(F.min("id").alias("hit"))
    by_number = nodes.where("number is not null").groupBy("number").agg(F.min("id").alias("hit"))
    for side in ("from", "to"):
        a = by_id.select(F.col("external_id").alias("_a"), F.col("hit").alias("_ha"))
        b = by_number.select(F.col("number").alias("_b"), F.col("hit").alias("_hb"))
        connections = connections.join(a, connections[f"{side}_key"] == a["_a"], "left").join(b, connections[f"{side}_key"] == b["_b"], "left")
        connections = connections.withColumn(f"{side}_id", F.coalesce("_ha", "_hb")).drop("_a", "_ha", "_b", "_hb")
    return connections


def sync_nodes(source: DataFrame, stored: DataFrame) -> DataFrame:
    """Actions by external id; nodes that the source lacks stay."""
    return diff(source, stored, ["external_id"], {"number": None, "name": None, "lat": SAME_DEGREES, "lng": SAME_DEGREES}).withColumn("action", F.when(F.col("action") == "stale", "keep").otherwise(F.col("action")))


def sync_connections(source: DataFrame, stored: DataFrame) -> DataFrame:
    """Actions by external id; connections without both ends are skipped, stale ones deleted."""
    ready = source.where("from_id is not null and to_id is not null").select("external_id", "from_id", "to_id", "distance_km", "geometry")
    kept = stored.join(source.where("from_id is null or to_id is null").select("external_id"), "external_id", "left_anti")
    found = diff(ready, kept, ["external_id"], {"from_id": None, "to_id": None, "distance_km": SAME_KM, "geometry": None})
    return found.withColumn("action", F.when(F.col("action") == "stale", "delete").otherwise(F.col("action")))


def layer_connections(rows: DataFrame, prefix: str) -> DataFrame:
    """Connections of a regional layer (pid, objectid, begin_geoid, end_geoid, naam, virtual, shape_length, geometry) with unique keys."""
    keyed = ordinals(rows.withColumn("base_key", F.concat(F.lit(prefix), F.col("pid"))), "base_key", [F.asc("objectid")], "external_id")
    return keyed.select("external_id", F.concat(F.lit(prefix), "begin_geoid").alias("from_key"), F.concat(F.lit(prefix), "end_geoid").alias("to_key"), js_round(F.col("shape_length") / 1000, 3).alias("distance_km"), "naam",
                        F.coalesce(F.col("virtual").cast("string").isin("1", "true", "True"), F.lit(False)).alias("is_virtual"), "geometry", *[c for c in ("mode",) if c in rows.columns])


def with_network(connections: DataFrame, networks: DataFrame) -> DataFrame:
    """network_id by the first of the names (parted by |) that is a network's; published networks are preferred."""
    names = F.filter(F.transform(F.split("naam", r"\|"), lambda n: network_key(n)), lambda k: k != "")
    keyed = networks.withColumn("key", network_key("title")).where("key <> ''")
    found = first_of_list(connections, "external_id", names, keyed, "key", "network_id", F.col("published"))
    return connections.join(found, "external_id", "left")


def unmatched_names(connections: DataFrame, most: int = 25) -> DataFrame:
    """The names of connections without a network, the most frequent first."""
    from .rows import histogram

    return histogram(connections.where("network_id is null").select(F.explode(F.split("naam", r"\|")).alias("name")), "name", most)


def with_surface(connections: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """Connections with runs of surface codes along their lines; sources: classified ways, the preferred first."""
    lines = connections.select(F.col("external_id").alias("line_id"), geo.joined(geo.lines_of("geometry")).alias("path")).where(F.size("path") >= 2)
    return connections.join(classified(lines, sources).select(F.col("line_id").alias("external_id"), F.col("runs").alias("surface")), "external_id", "left")


def coverage(connections: DataFrame) -> DataFrame:
    """One row: the share of the length whose surface is known, and the share of that which is paved."""
    runs = connections.select("distance_km", F.explode("surface").alias("r")).select((F.col("distance_km") * (F.col("r.to") - F.col("r.from"))).alias("km"), "r.code")
    known, paved = F.sum(F.when(F.col("code") >= 0, F.col("km"))), F.sum(F.when(F.col("code") == 1, F.col("km")))
    return runs.agg(F.sum("km").alias("km"), (100 * F.coalesce(known, F.lit(0.0)) / F.sum("km")).alias("known_percent"), (100 * F.coalesce(paved, F.lit(0.0)) / known).alias("paved_percent"))


def surfaced(connections: DataFrame, official: DataFrame | None, ways: DataFrame | None) -> DataFrame:
    """Connections (external_id, mode, geometry) with the surface along their lines.

    official: classified ways with the mode of the layer that they are of; those of a connection's own mode come first, then those of other
    modes, then ways (of a map). All are optional.
    """
    found = None
    modes = [r["mode"] for r in connections.select("mode").distinct().orderBy("mode").collect()]  # few: walking, cycling
    for mode in modes:
        same = F.col("mode").eqNullSafe(F.lit(mode))
        sources = [official.where(same), official.where(~same)] if official is not None else []
        own = with_surface(connections.where(same), [x.select("way_id", "path", "code") for x in (*sources, ways) if x is not None])
        found = own if found is None else found.unionByName(own)
    return found if found is not None else connections.withColumn("surface", F.lit(None).cast(geo.RUNS))


def classified_ways(ways: DataFrame) -> DataFrame:
    """way_id, path and code of map ways (way_id, path, surface, highway, tracktype) whose tags tell a surface; each way once."""
    code = tag_code(F.col("surface"), F.col("highway"), F.col("tracktype"))
    return reduced(ways.select("way_id", "path", code.alias("code")).where("code is not null"), ["way_id"], F.col("code"))


def sync_layer(nodes: DataFrame, edges: DataFrame, stored_nodes: DataFrame, stored_edges: DataFrame, both_modes: bool, origin: str) -> tuple[DataFrame, DataFrame]:
    """Actions for nodes and edges of a regional layer; stale ones of this origin go only after a full, large enough run.

    Columns that both sides have are compared: of edges their ends, length, kind, mode, network and surface.
    """
    own = F.col("stored.external_id").startswith(origin)
    both = lambda a, b, of: {c: tol for c, tol in of.items() if c in a.columns and c in b.columns}
    n = diff(nodes, stored_nodes, ["external_id"], both(nodes, stored_nodes, {"number": None, "name": None, "lat": SAME_DEGREES, "lng": SAME_DEGREES, "is_virtual": None}))
    e = diff(edges, stored_edges, ["external_id"], both(edges, stored_edges, {"from_key": None, "to_key": None, "distance_km": SAME_KM, "is_virtual": None, "mode": None, "network_id": None, "surface": None}))
    return guarded(n, LEAST_NODES, LEAST_SHARE, both_modes, own), guarded(e, LEAST_EDGES, LEAST_SHARE, both_modes, own)


def relation_lines(relations: DataFrame) -> DataFrame:
    """One line for each relation (relation_id, ways: array of paths): path, whole, km, first and last point."""
    line = relations.withColumn("line", stitched(F.col("ways"))).where(F.size("line.path") >= 2)
    return line.select("relation_id", F.col("line.path").alias("path"), F.col("line.complete").alias("whole"), js_round(geo.path_km(F.col("line.path")), 3).alias("km"),
                       F.element_at("line.path", 1).alias("first"), F.element_at("line.path", -1).alias("last"))


def relation_edges(lines: DataFrame, points: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges between the network points (point_id, lat, lng) within 50 m of the lines' ends.

    A point within 30 m of an existing node stands for it (node_id); edges whose both ends are existing ones are known already.
    """
    same = nearest(points.select("point_id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng")), existing.select("node_id", "lat", "lng"), "point_id", "node_id", 0.03, 0.005)
    mapped = points.join(same.drop("km"), "point_id", "left")
    for side, end in (("from", "first"), ("to", "last")):
        probe = lines.select("relation_id", F.col(f"{end}.lat").alias("p_lat"), F.col(f"{end}.lng").alias("p_lng"))
        hit = nearest(probe, points, "relation_id", "point_id", 0.05, 0.005).select("relation_id", F.col("point_id").alias(f"{side}_point"))
        node = mapped.select(F.col("point_id").alias(f"{side}_point"), F.col("node_id").alias(f"{side}_node"))
        lines = lines.join(hit.join(node, f"{side}_point"), "relation_id")
    return lines.where("from_point <> to_point and not (from_node is not null and to_node is not null)").select("relation_id", "from_point", "to_point", "from_node", "to_node", "km", "path", "whole")


def sync_relations(edges: DataFrame, stored: DataFrame, whole_run: bool) -> DataFrame:
    """Actions by relation; lines aren't compared, since a line that changed has another length."""
    compare = {"from_point": None, "to_point": None, "km": SAME_RELATION_KM, "mode": None, "surface": None}
    found = diff(edges, stored, ["relation_id"], {c: tol for c, tol in compare.items() if c in edges.columns and c in stored.columns})
    return guarded(found, LEAST_RELATIONS, 0.0, whole_run)


def with_relation_surface(edges: DataFrame, ways: DataFrame) -> DataFrame:
    """Edges (relation_id, path) with the surface that map ways (as classified_ways gives them) tell."""
    lines = edges.select(F.col("relation_id").alias("line_id"), "path")
    return edges.join(classified(lines, [ways]).select(F.col("line_id").alias("relation_id"), F.col("runs").alias("surface")), "relation_id", "left")


def described(networks: DataFrame) -> DataFrame:
    """Networks (network_id, parent_id, title, province, country) with parents that exist and provinces by their full names."""
    from ..functions.text import province_name
    from .match import parents

    return parents(networks, "network_id").withColumn("province", province_name(blank_to_null("province"), F.coalesce("country", F.lit("belgie"))))


def origin_of(external_id: Column) -> Column:
    return F.regexp_extract(external_id, r"^([a-z]+)[:_-]", 1)
