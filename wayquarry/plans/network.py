"""Suppliers and customers as a network: places from their keys, connections between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, nearest, surface
from ..sources.files import table

SIDE = 10  # nodes in a row of the grid


def places(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A place for each key, scattered over a tenth of a degree."""
    k = F.col(key)
    return table(spark, sf, name).select(k.alias("id"), (50 + (k * 37 % 1009) / 10000.0).alias("lat"), (4 + (k * 91 % 1013) / 10000.0).alias("lng"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers on a grid, a kilometre or so apart; every third has no number."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("id"), F.when(k % 3 > 0, (k % 100).cast("string")).otherwise("-9999").alias("number"), (50 + F.floor(k / SIDE) / 100.0).cast("string").alias("lat"),
        F.translate((4 + (k % SIDE) / 64.0).cast("string"), ".", ",").alias("lng"), F.lit(None).cast("boolean").alias("is_virtual"),
    )


def connections(spark: SparkSession, sf: str) -> DataFrame:
    """From each supplier to the next in its row and in its column; some doubled, looped or without an end."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.when((k + 1) % SIDE > 0, k + 1).alias("to_id")), F.struct(F.lit(1).alias("way"), (k + SIDE).alias("to_id")), F.struct(F.lit(2).alias("way"), F.when(k % 4 == 0, k).alias("to_id")), F.struct(F.lit(3).alias("way"), F.when((k + 1) % SIDE > 0, k + 1).alias("to_id")))).alias("e")
    rows = s.select(k.alias("from_id"), ends)
    km = F.when(F.col("e.way").isin(0, 3), 1.0 + F.col("from_id") % 5 / 10).when(F.col("from_id") % 2 == 0, 1.2 + F.col("from_id") % 7 / 10)
    # along a column a line of three points, a third of them stored from its far end
    at = lambda part: F.concat(F.lit("["), (4 + (F.col("from_id") % SIDE) / 64.0).cast("string"), F.lit(","), (50 + F.floor(F.col("from_id") / SIDE) / 100.0 + part).cast("string"), F.lit("]"))
    points = F.array(at(0.0), at(0.005), at(0.01))
    drawn = F.concat(F.lit('{"type":"LineString","coordinates":['), F.array_join(F.when(F.col("from_id") % 3 == 0, F.reverse(points)).otherwise(points), ","), F.lit("]}"))
    return rows.select(
        (F.col("from_id") * 4 + F.col("e.way")).alias("id"), "from_id", F.col("e.to_id").alias("to_id"), km.alias("distance_km"), F.when(F.col("e.way") == 1, drawn).alias("geometry"),
        F.array(F.array(F.lit(0.0), F.lit(0.25), F.lit(1.0)), F.array(F.lit(0.25), F.lit(1.0), F.lit(0.0))).alias("surface"), F.lit("fietsen").alias("mode"), F.lit(None).cast("boolean").alias("is_virtual"),
    )


NET_SQL = f"""n AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 100 > 0 THEN (s_suppkey % 100)::VARCHAR ELSE '' END AS number, (50 + floor(s_suppkey / {SIDE}) / 100.0)::DOUBLE AS lat, (4 + (s_suppkey % {SIDE}) / 64.0)::DOUBLE AS lng FROM supplier),
c AS (SELECT s_suppkey * 4 + way AS id, s_suppkey AS a, CASE WHEN way IN (0, 3) THEN CASE WHEN (s_suppkey + 1) % {SIDE} > 0 THEN s_suppkey + 1 END WHEN way = 1 THEN s_suppkey + {SIDE} WHEN s_suppkey % 4 = 0 THEN s_suppkey END AS b,
  CASE WHEN way IN (0, 3) THEN 1.0 + s_suppkey % 5 / 10 WHEN s_suppkey % 2 = 0 THEN 1.2 + s_suppkey % 7 / 10 END::DOUBLE AS given FROM supplier, range(4) r(way)),
l AS (SELECT c.*, x.lat AS lat1, x.lng AS lng1, y.lat AS lat2, y.lng AS lng2 FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE a <> b),
m AS (SELECT *, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2) AS h FROM l),
k AS (SELECT *, coalesce(given, 6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h))) AS full_km FROM m),
e AS (SELECT id, a, b, floor(full_km * 1000 + 0.5) / 1000 AS km FROM k QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b), floor(full_km * 100 + 0.5) ORDER BY id) = 1)"""


def built(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return graph.build(nodes(spark, sf), connections(spark, sf))


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    _, edges = built(spark, sf)
    return edges.select("id", "a", "b", "km")


def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf)[0].select("id", "number", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "modes")


def graph_box(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that touch a box, with what the answer says about its own limit."""
    _, edges = built(spark, sf)
    found, counted = graph.edges_in_box(edges, *graph.checked_box(50.0, 4.02, 50.055, 4.07), "fietsen")
    return found.select("id", "km").join(F.broadcast(counted))  # one row


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Ways from every supplier to one three rows on and two aside, and to the supplier itself."""
    k = F.col("s_suppkey")
    to = F.explode(F.array(k, k + 3 * SIDE + 2)).alias("to_id")
    return table(spark, sf, "supplier").select(k.alias("from_id"), to).select((F.col("from_id") * 100_000 + F.col("to_id")).alias("request"), "from_id", "to_id", F.lit("fietsen").alias("mode"))


def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The length of the shortest way of each request that has one."""
    return graph.shortest_paths(*built(spark, sf), requests(spark, sf)).select("request", "km")


def planner_paths(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.planner_paths(*built(spark, sf), requests(spark, sf))
    return found.select("request", "km", "direct", F.size("node_ids").alias("n_nodes"))


def nearest_supplier(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest supplier within 400 m of each customer."""
    probe = places(spark, sf, "customer", "c_custkey").select(F.col("id").alias("c_custkey"), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    points = places(spark, sf, "supplier", "s_suppkey").withColumnRenamed("id", "s_suppkey")
    found = nearest.nearest(probe, points, "c_custkey", "s_suppkey", 0.4, 0.01)
    return found.select("c_custkey", "s_suppkey", F.round("km", 6).alias("km"))


def customers_in_box(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.in_box(places(spark, sf, "customer", "c_custkey"), 50.02, 4.01, 50.05, 4.06, 0.01).select("id")


def surface_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Surfaces along the network's edges, from ways that run along some of them."""
    _, edges = built(spark, sf)
    lines = edges.select(F.col("id").alias("line_id"), "path")
    half = lambda p: F.struct(((p[0]["lat"] + p[1]["lat"]) / 2).alias("lat"), ((p[0]["lng"] + p[1]["lng"]) / 2).alias("lng"))
    ways = edges.select(F.col("id").alias("way_id"), F.when(F.col("id") % 2 == 0, F.col("path")).otherwise(F.array(F.col("path")[0], half(F.col("path")))).alias("path"), (F.col("id") % 2).cast("int").alias("code"))
    return surface.classified(lines, [ways]).select("line_id", F.to_json("runs").alias("runs"))


QUERIES = {
    "graph_edges": graph_edges, "graph_nodes": graph_nodes, "graph_box": graph_box, "shortest_paths": shortest_paths, "planner_paths": planner_paths,
    "nearest_supplier": nearest_supplier, "customers_in_box": customers_in_box, "surface_runs": surface_runs,
}

PLACE_SQL = "SELECT {k} AS id, 50 + ({k} * 37 % 1009) / 10000.0::DOUBLE AS lat, 4 + ({k} * 91 % 1013) / 10000.0::DOUBLE AS lng FROM {t}"

ORACLE_SQL = {
    "graph_edges": f"WITH {NET_SQL} SELECT id, a, b, km FROM e",
    "graph_nodes": f"WITH {NET_SQL} SELECT id, number, round(lat, 6) AS lat, round(lng, 6) AS lng, 2 AS modes FROM n WHERE id IN (SELECT a FROM e UNION SELECT b FROM e)",
    "graph_box": f"""WITH {NET_SQL}, x AS (SELECT e.id, e.km FROM e JOIN n p ON p.id = a JOIN n q ON q.id = b
WHERE greatest(p.lat, q.lat) >= 50.0 AND least(p.lat, q.lat) <= 50.055 AND greatest(p.lng, q.lng) >= 4.02 AND least(p.lng, q.lng) <= 4.07)
SELECT id, km, (SELECT count(*) FROM x) AS n, (SELECT count(*) FROM x) >= 8000 AS truncated FROM x""",
    "shortest_paths": f"""WITH RECURSIVE {NET_SQL}, s AS (SELECT a, b, min(km) AS km FROM (SELECT a, b, km FROM e UNION ALL SELECT b, a, km FROM e) GROUP BY ALL),
r AS (SELECT s_suppkey AS f, t FROM supplier, unnest([s_suppkey, s_suppkey + {3 * SIDE + 2}]) u(t) WHERE t IN (SELECT id FROM n) AND s_suppkey IN (SELECT a FROM s) AND t IN (SELECT a FROM s)),
w AS (SELECT f, f AS at, 0.0::DOUBLE AS km, 0 AS hops FROM (SELECT DISTINCT f FROM r) UNION SELECT w.f, s.b, min(w.km + s.km), min(hops) + 1 FROM w JOIN s ON s.a = w.at WHERE hops < 16 GROUP BY w.f, s.b)
SELECT f * 100000 + t AS request, floor(min(km) * 1000 + 0.5) / 1000 AS km FROM r JOIN w USING (f) WHERE w.at = t GROUP BY ALL""",
    "planner_paths": f"""WITH RECURSIVE {NET_SQL}, s AS (SELECT a, b, min(km) AS km FROM (SELECT a, b, km FROM e UNION ALL SELECT b, a, km FROM e) GROUP BY ALL),
r AS (SELECT s_suppkey AS f, t FROM supplier, unnest([s_suppkey, s_suppkey + {3 * SIDE + 2}]) u(t) WHERE s_suppkey IN (SELECT a FROM s) AND t IN (SELECT a FROM s)),
w AS (SELECT f, f AS at, {{'km': 0.0::DOUBLE, 'hops': 0, 'path': [f]}} AS l FROM (SELECT DISTINCT f FROM r)
  UNION ALL SELECT w.f, s.b, min({{'km': l.km + s.km, 'hops': l.hops + 1, 'path': list_append(l.path, s.b)}}) FROM w JOIN s ON s.a = w.at WHERE l.hops < 14 AND NOT list_contains(l.path, s.b) GROUP BY w.f, s.b),
v AS (SELECT f, f AS at, {{'km': 0.0::DOUBLE, 'hops': 0, 'path': [f]}} AS l FROM (SELECT DISTINCT f FROM r)
  UNION ALL SELECT v.f, s.b, min({{'km': l.km + s.km, 'hops': l.hops + 1, 'path': list_append(l.path, s.b)}}) FROM v JOIN s ON s.a = v.at JOIN n ON n.id = v.at
  WHERE l.hops < 14 AND (v.at = v.f OR n.number = '') AND NOT list_contains(l.path, s.b) GROUP BY v.f, s.b),
shortest AS (SELECT f, t, min(l) AS l FROM r JOIN w USING (f) WHERE w.at = t GROUP BY ALL), direct AS (SELECT f, t, min(l) AS d FROM r JOIN v USING (f) WHERE v.at = t GROUP BY ALL),
j AS (SELECT f, t, l, d, coalesce(list_has_any(l.path[2:-2], (SELECT list(id) FROM n WHERE number <> '')), false) AS numbered FROM shortest LEFT JOIN direct USING (f, t)),
x AS (SELECT *, floor(l.km * 1000 + 0.5) / 1000 AS a_km, floor(d.km * 1000 + 0.5) / 1000 AS b_km FROM j)
SELECT f * 100000 + t AS request, CASE WHEN numbered AND coalesce(b_km <= a_km * 4, false) THEN b_km ELSE a_km END AS km, numbered AND coalesce(b_km <= a_km * 4, false) AS direct,
  len(CASE WHEN numbered AND coalesce(b_km <= a_km * 4, false) THEN d.path ELSE l.path END)::INTEGER AS n_nodes FROM x""",
    "nearest_supplier": f"""WITH c AS ({PLACE_SQL.format(k='c_custkey', t='customer')}), s AS ({PLACE_SQL.format(k='s_suppkey', t='supplier')}),
p AS (SELECT c.id AS c_custkey, s.id AS s_suppkey, pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - c.lng) / 2), 2) AS h FROM c, s),
d AS (SELECT c_custkey, s_suppkey, 6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM p)
SELECT c_custkey, s_suppkey, round(km, 6) AS km FROM d WHERE km <= 0.4 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) = 1""",
    "customers_in_box": f"SELECT id FROM ({PLACE_SQL.format(k='c_custkey', t='customer')}) WHERE lat BETWEEN 50.02::DOUBLE - 0.01::DOUBLE AND 50.05::DOUBLE + 0.01::DOUBLE AND lng BETWEEN 4.01::DOUBLE - 0.01::DOUBLE AND 4.06::DOUBLE + 0.01::DOUBLE",
}
