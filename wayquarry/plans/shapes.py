"""Geometries and written values over the driver's tables: lines, runs, routes on the network, names, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, geo, text
from ..operators import graph, network_sync, surface, tracks
from ..operators import imports as im
from ..sources.files import spread, table
from . import network
from .network import NET_SQL, SIDE, built


def line_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of suppliers in several shapes of GeoJSON, one of them with a part that runs backwards: length, points and ends."""
    k = F.col("s_suppkey")
    at = lambda i, j: F.concat(F.lit("["), (4 + (k % 50) / 100.0 + i / 1000).cast("string"), F.lit(","), (50 + (k % 70) / 100.0 + j / 1000).cast("string"), F.lit("]"))
    line = lambda *p: F.concat(F.lit("["), F.concat_ws(",", *p), F.lit("]"))
    single = F.concat(F.lit('{"type":"LineString","coordinates":'), line(at(0, 0), F.lit('["x",1]'), at(1, 2), at(3, 2)), F.lit("}"))
    several = F.concat(F.lit('{"type":"Feature","geometry":{"type":"MultiLineString","coordinates":['), line(at(0, 0), at(1, 2)), F.lit(","), line(at(3, 2), at(1, 2)), F.lit("]}}"))
    shape = F.when(k % 3 == 0, single).when(k % 3 == 1, several).otherwise(F.lit('{"type":"Point","coordinates":[1,2]}'))
    path = geo.joined(geo.lines_of(shape))
    found = table(spark, sf, "supplier").select("s_suppkey", path.alias("p"))
    last = F.get(geo.rounded(F.col("p"), 5), F.size("p") - 1)
    return found.select("s_suppkey", F.size("p").cast("long").alias("n_points"), F.round(geo.path_km(F.col("p")), 6).alias("km"), last["lat"].alias("last_lat"), last["lng"].alias("last_lng"))


def edge_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Edges' lines after building: how many points are left, where they begin, and the first run of their surface."""
    _, edges = built(spark, sf)
    return edges.select("id", F.size("path").cast("long").alias("n_points"), F.round(F.element_at("path", 1)["lat"], 5).alias("first_lat"), F.element_at("surface", 1)["to"].alias("run_end"), F.element_at("surface", 1)["code"].cast("long").alias("code"))


def path_stages(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of each shortest way, in order and in the direction of travel."""
    nodes, edges = built(spark, sf)
    paths = graph.shortest_paths(nodes, edges, network.requests(spark, sf)).withColumn("mode", F.lit("fietsen"))
    steps = graph.path_steps(paths, edges)
    start = F.element_at("path", 1)["lat"]
    return steps.select("request", F.col("step").cast("long").alias("step"), "edge", "reversed", F.round(start, 5).alias("from_lat"))


def routes_on_network(spark: SparkSession, sf: str) -> DataFrame:
    """Routes that pass three neighbours on the grid, one of them twice, and some a point off the network."""
    nodes, _ = built(spark, sf)
    k = F.col("id")
    lat, lng = lambda x: 50 + F.floor(x / SIDE) / 100.0, lambda x: 4 + (x % SIDE) / 64.0
    point = lambda i, x, off=0.0: F.struct(F.lit("7").alias("number"), F.lit(i).alias("order"), F.lit(i * 1.5).alias("km"), lat(x).alias("lat"), (lng(x) + off).alias("lng"))
    # the grid grows to the north with the table, so what lies off it is to the east
    points = F.array(point(2, k + 1), point(0, k), point(1, k), point(3, k + 2), point(4, k, 5.0))
    routes = nodes.select(k.alias("route_id"), F.lit("fietsen").alias("mode"), F.when(k % 2 == 0, 9.0).alias("start_km"), F.when(k % 3 == 0, points).otherwise(F.slice(points, 1, 4)).alias("points"))
    return graph.route_links(routes, nodes).select("route_id", F.array_join("node_ids", ",").alias("node_ids"), "km")


def network_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Connections of published networks with their own mode, else their theme's."""
    k = F.col("p_partkey")
    connections = table(spark, sf, "part").select("p_partkey", F.when(k % 5 > 0, k % 12).alias("network_id"), F.when(k % 3 == 0, "fietsen").when(k % 3 == 1, "other").alias("mode"))
    networks = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("network_id"), F.when(F.col("n_nationkey") % 2 == 0, "Fietsroutes").otherwise("wandelen").alias("theme"), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_nationkey") % 4 > 1).alias("published"))
    return graph.with_mode(connections, networks).select("p_partkey", "mode")


def tag_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Surfaces by tags of ways."""
    k = F.col("p_partkey")
    pick = lambda n, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (k % n + 1).cast("int"))
    p = table(spark, sf, "part")
    return p.select("p_partkey", surface.tag_code(pick(5, "asphalt;x", " Gravel", None, "unheard", "sett"), pick(7, "track", "path", "residential", "river", None, "footway", "bridleway"), pick(3, "grade1", "grade2", None)).alias("code"))


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """The middle of a closed ring around each customer's place."""
    own = network.places(spark, sf, "customer", "c_custkey")
    at = lambda i, j: F.struct((F.col("lat") + i).alias("lat"), (F.col("lng") + j).alias("lng"))
    ring = F.array(at(0, 0), at(1, 0), at(2, 3), at(0, 0))
    found = own.select("id", geo.centroid(ring).alias("c"))
    return found.select("id", F.round("c.lat", 6).alias("lat"), F.round("c.lng", 6).alias("lng"))


def nearest_on_line(spark: SparkSession, sf: str) -> DataFrame:
    """Which of five points on a line is the nearest to each customer's place."""
    own = network.places(spark, sf, "customer", "c_custkey")
    path = F.array(*[F.struct(F.lit(50 + i / 40).alias("lat"), F.lit(4 + i / 50).alias("lng")) for i in range(5)])
    found = own.select("id", tracks.nearest_index(path, F.col("lat"), F.col("lng")).alias("x"))
    return found.select("id", F.col("x.index").cast("long").alias("at"), F.round("x.km", 6).alias("km"))


def running_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Running sums of the quantities of each order's lines, from zero on."""
    li = table(spark, sf, "lineitem")
    lists = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x"))
    sums = tracks.prefix_sums(F.transform("x", lambda v: v["l_quantity"]))
    return lists.select("l_orderkey", F.array_join(F.transform(sums, lambda v: v.cast("long").cast("string")), ",").alias("sums"))


def surface_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the network's length has a known surface, and how much of that is paved."""
    _, edges = built(spark, sf)
    runs = F.array(F.struct(F.lit(0.0).alias("from"), F.lit(0.5).alias("to"), (F.col("id") % 3 - 1).cast("int").alias("code")), F.struct(F.lit(0.5).alias("from"), F.lit(1.0).alias("to"), F.lit(1).alias("code")))
    found = network_sync.coverage(edges.select(F.col("km").alias("distance_km"), runs.alias("surface")))
    return found.select(F.round("km", 3).alias("km"), F.round("known_percent", 4).alias("known_percent"), F.round("paved_percent", 4).alias("paved_percent"))


def name_values(spark: SparkSession, sf: str) -> DataFrame:
    """Names, addresses and links as they may be written, put right."""
    k, name = F.col("c_custkey"), F.col("c_name")
    c = table(spark, sf, "customer")
    network_name = F.concat(F.when(k % 3 == 0, "Wandelnetwerk ").when(k % 3 == 1, "uitbreiding FNW - de ").otherwise("Het "), F.lit("Dal "), k % 50, F.lit(" (oud)"))
    return c.select(
        "c_custkey", text.network_key(network_name).alias("network"), text.country_slug(F.when(k % 2 == 0, "Belgium").otherwise(F.concat(F.lit("Land "), k % 3))).alias("country"), coerce.blank_to_null(F.concat(F.lit("  "), F.when(k % 4 > 0, F.lit("a \n b ")).otherwise(""))).alias("blank"),
        text.filename(F.concat(F.lit("/img/x\\"), F.translate(name, "#", " "), F.lit(" Foto.JPG?v=1"))).alias("file"), text.address(F.when(k % 2 == 0, "Straat"), k.cast("string"), F.lit(" "), F.when(k % 3 == 0, "Gent")).alias("address"), text.top_names(F.when(k % 5 > 0, F.concat(F.lit(" a;;b "), k, F.lit(";c")))).alias("top"),
        text.clip(F.repeat(name, 20), 255).alias("clipped"), F.array_join(text.node_sequence(F.concat(k.cast("string"), F.lit(" - 7A > x12"))), "/").alias("nodes"), text.sorted_identity(F.when(k % 2 == 0, "jan").otherwise("a@b"), F.when(k % 2 == 0, "a@b").otherwise("jan"))["email"].alias("email"),
        text.is_email(F.concat(name, F.lit("@x."), F.when(k % 2 == 0, "be").otherwise(""))).alias("is_email"), text.is_url(F.concat(F.when(k % 2 == 0, "https").otherwise("ftp"), F.lit("://x.be/a"))).alias("is_url"), text.is_phone(F.when(k % 2 == 0, F.concat(F.lit("+32 9 "), k + 10000)).otherwise(name)).alias("is_phone"),
    )


def text_repairs(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with entities, tags, wrong encodings and templates, put right."""
    k, name = F.col("p_partkey"), F.col("p_name")
    p = spread(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    return p.select(
        "p_partkey", text.entities(F.concat(F.lit("&amp;amp;lt; &#233;&#39; &quot;"), name, F.lit("&#"), k % 26 + 97, F.lit(";"))).alias("decoded"),
        text.excerpt(F.when(k % 2 == 0, "<i> </i>"), F.concat(F.lit("<p>"), name, F.lit("&nbsp;&amp; <b>more</b></p>")), most=12).alias("excerpt"), text.filled(F.lit("{a}-{b}-{c}"), {"a": name, "b": F.when(k % 2 == 0, k)}).alias("filled"),
        text.repaired(F.when(k % 3 == 0, F.lit("LiÃ¨ge ")).otherwise("Liège ")).alias("repaired"), text.without_page_chrome(F.concat(F.lit('<!-- x --><div class="a"><h2>'), name, F.lit('</h2><script>1</script><a class="x btn">go</a></div>'))).alias("content"),
        text.province_name(F.when(k % 2 == 0, "Limburg").otherwise("Gelderland"), F.when(k % 3 == 0, "BE").otherwise("NL")).alias("province"),
    )


def field_values(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers, JSON and addresses from fields of several names."""
    i = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", "value", "props", F.when(i % 3 == 0, " ").when(i % 3 == 1, F.col("event_type")).alias("Naam"), F.when(i % 2 == 0, F.concat(F.lit("n"), i)).alias("title"))
    place = lambda *x: F.struct(*[F.when(c, F.lit(v)).alias(n) for n, c, v in zip(("street", "postal_code", "latitude", "longitude"), x, ("s", "9000", "51", "4"))])
    own = im.inherited_address(place(i % 2 == 0, i % 3 == 0, i % 5 == 0, F.lit(False)), place(F.lit(False), i % 2 == 0, F.lit(True), i % 7 == 0))
    json = F.when(i % 4 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return e.select(
        "event_id", coerce.first_filled(e, ["name", "naam", "TITLE"]).alias("name"), coerce.safe_json(json, "k long")["k"].alias("k"), F.round(coerce.kilometres(F.regexp_replace(F.floor(F.col("value") * 10).cast("string"), "$", ",5"), "m"), 6).alias("km"),
        F.sha2(F.concat_ws("|", i.cast("string"), F.lit("salt")), 256).alias("hash"), F.concat_ws(",", own["street"], own["postal_code"], own["latitude"], own["longitude"]).alias("address"), coerce.or_default(i % 3, 30).cast("long").alias("days"),
    )


def merged_places(spark: SparkSession, sf: str) -> DataFrame:
    """Start places of routes that are the same: one row with the first value of each column."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    starts = o.select(F.col("o_custkey").alias("route_id"), F.concat(F.when(k % 2 == 0, "Kerk ").otherwise("KERK-"), k % 3).alias("name"), (51 + k % 2 / 10.0 + 0.000001).alias("latitude"), F.lit(4.0).alias("longitude"), F.lit("Gent").alias("city"), F.when(k % 4 == 0, F.col("o_totalprice")).alias("distance_km"), k.alias("ordinal"))
    return tracks.merged_starts(starts).select("route_id", "name", F.round("latitude", 5).alias("latitude"), "distance_km", "ordinal")


def written_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of three nodes from what was written: running or single ones, in kilometres or metres, or one total."""
    k = F.col("p_partkey")
    d = (k % 9 + 1) * 1.0
    raw = F.when(k % 4 == 0, F.array(F.lit(0.0), d, d + 2)).when(k % 4 == 1, F.array(d * 1000, F.lit(2000.0))).when(k % 4 == 2, F.array(d + 2)).otherwise(F.array())
    found = table(spark, sf, "part").select("p_partkey", tracks.normalised_distances(raw, F.lit(3), d + 2).alias("km"))
    return found.select("p_partkey", F.size("km").cast("long").alias("n"), F.round(F.get("km", F.lit(1)), 6).alias("second"), F.round(F.get("km", F.lit(2)), 6).alias("third"))


QUERIES = {f.__name__: f for f in (
    line_shapes, edge_shapes, path_stages, routes_on_network, network_modes, tag_codes, centroids, nearest_on_line, running_totals, surface_coverage, name_values, text_repairs, field_values, merged_places, written_distances,
)}

KM = "6371.0 * 2 * atan2(sqrt({h}), sqrt(1 - ({h})))"
H = "pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lng2}) - ({lng1})) / 2), 2)"


def _km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return KM.format(h=H.format(lat1=lat1, lng1=lng1, lat2=lat2, lng2=lng2))


ORACLE_SQL = {
    "line_shapes": f"""
WITH p AS (SELECT s_suppkey, 50 + (s_suppkey % 70) / 100.0::DOUBLE AS y, 4 + (s_suppkey % 50) / 100.0::DOUBLE AS x FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 0 END::BIGINT AS n_points, CASE WHEN s_suppkey % 3 = 2 THEN 0.0::DOUBLE ELSE round({_km('y', 'x', 'y + 0.002::DOUBLE', 'x + 0.001::DOUBLE')} + {_km('y + 0.002::DOUBLE', 'x + 0.001::DOUBLE', 'y + 0.002::DOUBLE', 'x + 0.003::DOUBLE')}, 6) END AS km,
  CASE WHEN s_suppkey % 3 < 2 THEN floor((y + 0.002::DOUBLE) * 1e5 + 0.5) / 1e5 END AS last_lat, CASE WHEN s_suppkey % 3 < 2 THEN floor((x + 0.003::DOUBLE) * 1e5 + 0.5) / 1e5 END AS last_lng FROM p""",
    "edge_shapes": f"""
WITH {NET_SQL} SELECT e.id, 2::BIGINT AS n_points, round(n.lat, 5) AS first_lat, CASE WHEN e.id % 4 = 1 AND e.a % 3 = 0 THEN 0.75 ELSE 0.25 END::DOUBLE AS run_end, CASE WHEN e.id % 4 = 1 AND e.a % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS code FROM e JOIN n ON n.id = e.a""",
    "path_stages": f"""WITH RECURSIVE {NET_SQL}, s AS (SELECT a, b, min(km) AS km FROM (SELECT a, b, km FROM e UNION ALL SELECT b, a, km FROM e) GROUP BY ALL),
r AS (SELECT s_suppkey AS f, t FROM supplier, unnest([s_suppkey, s_suppkey + {3 * SIDE + 2}]) u(t) WHERE s_suppkey IN (SELECT a FROM s) AND t IN (SELECT a FROM s)),
w AS (SELECT f, f AS at, {{'km': 0.0::DOUBLE, 'hops': 0, 'path': [f]}} AS l FROM (SELECT DISTINCT f FROM r)
  UNION ALL SELECT w.f, s.b, min({{'km': l.km + s.km, 'hops': l.hops + 1, 'path': list_append(l.path, s.b)}}) FROM w JOIN s ON s.a = w.at WHERE l.hops < 14 AND NOT list_contains(l.path, s.b) GROUP BY w.f, s.b),
shortest AS (SELECT f, t, min(l).path AS path FROM r JOIN w USING (f) WHERE w.at = t GROUP BY ALL),
hops AS (SELECT f, t, i, path[i + 1] AS here, path[i + 2] AS there FROM shortest, unnest(range(0, len(path) - 1)) u(i)),
best AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY km, id) = 1)
SELECT f * 100000 + t AS request, i AS step, best.id AS edge, best.a <> here AS reversed, round(n.lat, 5) AS from_lat FROM hops JOIN best ON least(a, b) = least(here, there) AND greatest(a, b) = greatest(here, there) JOIN n ON n.id = here""",
    "routes_on_network": f"""
WITH {NET_SQL}, own AS (SELECT id FROM n WHERE id IN (SELECT a FROM e UNION SELECT b FROM e)), g AS (SELECT id, lat, lng FROM n WHERE id IN (SELECT id FROM own)),
p AS (SELECT own.id, o, own.id + o AS x FROM own, unnest([0, 1, 2]) u(o)), h AS (SELECT p.id, p.o, g.id AS hit FROM p JOIN g ON g.lat = 50 + floor(p.x / {SIDE}) / 100.0::DOUBLE AND g.lng = 4 + (p.x % {SIDE}) / 64.0::DOUBLE),
matched AS (SELECT id, list(hit ORDER BY o) AS ids, count(*) + max((o = 0)::INTEGER) AS n_hit FROM h GROUP BY 1)
SELECT id AS route_id, array_to_string(ids, ',') AS node_ids, CASE WHEN id % 2 = 0 THEN 9.0 WHEN id % 3 = 0 THEN 6.0 ELSE 4.5 END::DOUBLE AS km FROM matched
WHERE len(ids) >= 2 AND n_hit >= 0.8 * CASE WHEN id % 3 = 0 THEN 5 ELSE 4 END""",
    "network_modes": """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'fietsen' WHEN n_nationkey % 2 = 0 THEN 'fietsen' ELSE 'wandelen' END AS mode FROM part LEFT JOIN nation ON p_partkey % 5 > 0 AND n_nationkey = p_partkey % 12
WHERE p_partkey % 5 = 0 OR n_nationkey % 4 > 1""",
    "tag_codes": """
WITH t AS (SELECT p_partkey AS k, [1, 0, NULL, NULL, 1][p_partkey % 5 + 1] AS own, p_partkey % 7 AS way, p_partkey % 3 = 0 AS hard FROM part)
SELECT k AS p_partkey, coalesce(own, CASE way WHEN 0 THEN CASE WHEN hard THEN 1 ELSE 0 END WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 0 END)::INTEGER AS code FROM t""",
    "centroids": f"SELECT id, round(lat + 1, 6) AS lat, round(lng + 1, 6) AS lng FROM ({network.PLACE_SQL.format(k='c_custkey', t='customer')})",
    "nearest_on_line": f"""
WITH c AS ({network.PLACE_SQL.format(k='c_custkey', t='customer')}), p AS (SELECT i::BIGINT AS i, 50 + i / 40::DOUBLE AS lat, 4 + i / 50::DOUBLE AS lng FROM range(5) r(i)),
d AS (SELECT c.id, i, {_km('c.lat', 'c.lng', 'p.lat', 'p.lng')} AS km FROM c, p) SELECT id, i AS at, round(km, 6) AS km FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, i) = 1""",
    "running_totals": """
WITH s AS (SELECT l_orderkey, row_number() OVER w AS i, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity))
SELECT l_orderkey, '0,' || string_agg(s::BIGINT::VARCHAR, ',' ORDER BY i) AS sums FROM s GROUP BY 1""",
    "surface_coverage": f"""
WITH {NET_SQL}, r AS (SELECT km * 0.5 AS km, id % 3 - 1 AS code FROM e UNION ALL SELECT km * 0.5, 1 FROM e)
SELECT round(sum(km), 3) AS km, round(100 * sum(km) FILTER (WHERE code >= 0) / sum(km), 4) AS known_percent, round(100 * sum(km) FILTER (WHERE code = 1) / sum(km) FILTER (WHERE code >= 0), 4) AS paved_percent FROM r""",
    "name_values": """
SELECT c_custkey, 'dal-' || (c_custkey % 50) AS network, CASE WHEN c_custkey % 2 = 0 THEN 'belgie' ELSE 'land-' || (c_custkey % 3) END AS country, CASE WHEN c_custkey % 4 > 0 THEN 'a b' END AS blank,
  replace(lower(c_name), '#', '-') || '-foto.jpg' AS file, CASE WHEN c_custkey % 2 = 0 THEN 'Straat ' ELSE '' END || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || 'Gent' ELSE '' END AS address, CASE WHEN c_custkey % 5 > 0 THEN 'a en b ' || c_custkey END AS top,
  left(repeat(c_name, 20), 255) AS clipped, c_custkey || '/7A/12' AS nodes, 'a@b' AS email, c_custkey % 2 = 0 AS is_email, c_custkey % 2 = 0 AS is_url, c_custkey % 2 = 0 AS is_phone FROM customer""",
    "text_repairs": """
SELECT p_partkey, '< é'' "' || p_name || chr((p_partkey % 26 + 97)::INTEGER) AS decoded, CASE WHEN length(p_name || ' & more') > 12 THEN rtrim(left(p_name || ' & more', 11)) || '…' ELSE p_name || ' & more' END AS excerpt,
  p_name || '-' || CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE '' END || '-{c}' AS filled, 'Liège ' AS repaired, '<h2>' || p_name || '</h2>' AS content,
  CASE WHEN p_partkey % 2 > 0 THEN 'Gelderland' WHEN p_partkey % 3 = 0 THEN 'Limburg Vlaanderen' ELSE 'Limburg' END AS province FROM part""",
    "field_values": """
SELECT event_id, coalesce(CASE WHEN event_id % 3 = 1 THEN event_type END, CASE WHEN event_id % 2 = 0 THEN 'n' || event_id END) AS name, CASE WHEN event_id % 4 > 0 THEN (props::JSON ->> 'k')::BIGINT END AS k,
  round((floor(value * 10) + 0.5) / 1000, 6) AS km, sha256(event_id || '|salt') AS hash, concat_ws(',', CASE WHEN event_id % 2 = 0 THEN 's' END, CASE WHEN event_id % 3 = 0 OR event_id % 2 = 0 THEN '9000' END, '51', CASE WHEN event_id % 7 = 0 THEN '4' END) AS address,
  CASE WHEN event_id % 3 = 0 THEN 30 ELSE event_id % 3 END AS days FROM events""",
    "merged_places": """
WITH s AS (SELECT o_custkey AS r, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'Kerk ' ELSE 'KERK-' END || (o_orderkey % 3) AS name, o_orderkey % 3 AS same, o_orderkey % 2 AS side, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS d FROM orders)
SELECT r AS route_id, arg_min(name, k) AS name, round(51 + side / 10.0::DOUBLE + 0.000001::DOUBLE, 5) AS latitude, arg_min(d, k) FILTER (WHERE d IS NOT NULL) AS distance_km, min(k) AS ordinal FROM s GROUP BY r, same, side""",
    "written_distances": """
WITH d AS (SELECT p_partkey AS k, (p_partkey % 9 + 1)::DOUBLE AS d FROM part)
SELECT k AS p_partkey, CASE WHEN k % 4 = 3 THEN 0 ELSE 3 END::BIGINT AS n, CASE k % 4 WHEN 2 THEN (d + 2) / 2 WHEN 3 THEN NULL ELSE d END AS second, CASE WHEN k % 4 < 3 THEN d + 2 END AS third FROM d""",
}
