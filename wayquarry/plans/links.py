"""Joins, choices and sets over the driver's tables: references, versions, areas, lists, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import imports, match, nearest
from ..operators import rows as r
from ..operators import sync as s
from ..sources.files import table
from .network import PLACE_SQL, places


def resolved_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts to suppliers by an external name, else by a number."""
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("E"), "p_size").alias("name"), (F.col("p_partkey") % 40).cast("string").alias("number"))
    k = F.col("s_suppkey")
    targets = table(spark, sf, "supplier").select("s_suppkey", F.when(k % 2 == 0, F.concat(F.lit("E"), k)).alias("external"), (k % 20).cast("string").alias("nr"))
    return s.resolved(p, targets, [("name", "external"), ("number", "nr")], "s_suppkey", "found").select("p_partkey", "found")


def spaced_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that have no supplier within 300 m."""
    return nearest.deduplicated(places(spark, sf, "customer", "c_custkey"), places(spark, sf, "supplier", "s_suppkey"), 0.3, 0.01).select("id")


def favourites(spark: SparkSession, sf: str) -> DataFrame:
    """What users have viewed, with what they bought and hadn't viewed."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.floor("value").cast("long").alias("target"))
    stored = e.where("event_type = 'view'").select("user_id", "target").distinct().withColumn("origin", F.lit("view"))
    new = e.where("event_type = 'purchase'").select("user_id", "target").withColumn("origin", F.lit("purchase"))
    return s.inserted_if_absent(stored, new, ["user_id", "target"])


def language_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Of every hundred documents that count as versions of one, the one in French, else in English, else the first."""
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.col("doc_id") % 97).alias("document"))
    return r.preferred_version(d, "document", "lang", "fr", "en", [F.asc("doc_id")]).select("document", "doc_id", "lang")


def listed_names(spark: SparkSession, sf: str) -> DataFrame:
    """Parts to suppliers by the first of three names that is one's; solvent suppliers are preferred."""
    p = table(spark, sf, "part")
    names = F.array(*[x.cast("string") for x in (F.col("p_size"), F.col("p_partkey") % 45, F.col("p_partkey") % 7)])
    targets = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_suppkey") % 25).cast("string").alias("name"))
    return match.first_of_list(p, "p_partkey", names, targets, "name", "s_suppkey", F.col("s_acctbal") > 0)


def linked_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and parts that a table of old numbers links, each pair once."""
    points = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("old_point_id"), (F.col("s_suppkey") + 1000).alias("point_id"))
    links = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("old_point_id"), F.concat(F.lit("part-"), F.col("l_partkey") * 2).alias("slug"))
    routes = table(spark, sf, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("slug"), F.col("p_partkey").alias("route_id"))
    return match.through_links(points, links, routes)


def place_names(spark: SparkSession, sf: str) -> DataFrame:
    """Customers to the place of their city's name in their nation, else their region, else anywhere."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = lambda name, key, nation, out: table(spark, sf, name).join(n, F.col(nation) == F.col("n_nationkey")).select(F.col(key).alias(out), F.concat(F.lit("Plaats "), F.col(key) % 20).alias("name"), F.col("n_name").alias("province"), F.col("r_name").alias("country"))
    return imports.area_candidates(own("customer", "c_custkey", "c_nationkey", "request"), own("supplier", "s_suppkey", "s_nationkey", "place_id"))


def cities(spark: SparkSession, sf: str) -> DataFrame:
    """Cities from customers, the first row of a name wins and later ones fill what it lacks; what is missing yet comes from suppliers."""
    k, q = F.col("c_custkey"), F.col("s_suppkey")
    none = F.lit(None)
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("Stad  "), k % 60).alias("municipality"), F.when(k % 3 == 0, (1000 + k).cast("string")).alias("postcode"), F.when(k % 4 == 0, F.concat(F.lit("P"), k)).alias("province"),
        none.cast("string").alias("region"), F.when(k % 60 > 40, k / 10.0).alias("lat"), none.cast("double").alias("lng"), k.alias("ordinal"),
    )
    extra = table(spark, sf, "supplier").select(
        F.concat(F.lit("STAD "), q).alias("municipality"), none.cast("string").alias("postcode"), F.lit("S").alias("province"), F.lit("R").alias("region"), (q * 1.5).alias("lat"), (q * 2.5).alias("lng"), q.alias("ordinal")
    )
    return imports.cities(rows, extra).select("slug", "name", "postcode", "province", "region", "lat", "lng")


def contained_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Where a list of seven holds a list of two in a row, by part."""
    k = F.col("p_partkey")
    whole, part = F.array(k % 3, k % 4, k % 5, k % 3, k % 2, k % 4, k % 7), F.array(k % 4, k % 5)
    turned = F.array(k % 2, k % 4)
    return table(spark, sf, "part").select("p_partkey", match.subsequence_at(whole, part).cast("long").alias("at"), match.subsequence_at(whole, F.when(k % 2 == 0, turned).otherwise(F.array(k % 6, k % 3))).cast("long").alias("later"))


def countries(spark: SparkSession, sf: str) -> DataFrame:
    """The region of each customer: by its nation, else by the name of the region."""
    k = F.col("c_custkey")
    n = table(spark, sf, "nation")
    named = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = named.select("c_custkey", F.when(k % 2 == 0, F.col("n_name")).alias("province"), F.when(k % 3 > 0, F.col("r_name")).otherwise("nowhere").alias("country"))
    provinces = n.select(t.slug("n_name").alias("slug"), F.col("n_regionkey").alias("country_id"))
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), t.slug("r_name").alias("slug"), F.col("r_name").alias("name"))
    return imports.with_country(rows, provinces, regions, "atlantis").select("c_custkey", "country_id")


def parents(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(k.alias("id"), F.when(k % 3 == 0, F.floor(k / 2)).when(k % 3 == 1, k + 4).otherwise(k).alias("parent_id"))
    return match.parents(rows)


def least_postcodes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return imports.least_postcodes(table(spark, sf, "customer").select(F.concat(F.lit("Stad "), k % 40).alias("municipality"), F.when(k % 9 > 0, (k * 37 % 9000).cast("string")).alias("postcode")))


def hash_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """How many customers' passwords are kept in which way."""
    k = F.col("c_custkey")
    kept = F.when(k % 4 == 0, F.md5("c_name")).when(k % 4 == 1, F.concat(F.lit("$2y$10$"), F.lpad("c_name", 53, "x").substr(1, 53))).when(k % 4 == 2, F.sha1("c_name"))
    return imports.password_kinds(table(spark, sf, "customer").select(F.translate(kept, "#", ".").alias("password")))


def inconsistent_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts that stand for several brands or types."""
    return r.inconsistent(table(spark, sf, "part"), "p_name", ["p_brand", "p_type"])


def missing_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and priorities all of whose orders are published."""
    o = table(spark, sf, "orders")
    return imports.missing_drafts(o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("locale"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("published_at")))


def attached_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their lines as one list."""
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    found = r.attached(table(spark, sf, "orders").select("o_orderkey"), li, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "lines")
    written = F.transform("lines", lambda x: F.concat_ws("/", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_suppkey"].cast("string")))
    return found.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), F.array_join(written, " ").alias("lines"))


def published_lines(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines of finished orders each ship status has."""
    versions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("published_at"))
    return r.published(table(spark, sf, "lineitem"), versions, "l_orderkey").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def repaired_zeros(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' discounts with zeros as nulls, and how many there were."""
    li = table(spark, sf, "lineitem").withColumn("o_orderkey", F.col("l_orderkey"))
    lists = r.attached(table(spark, sf, "orders").select("o_orderkey"), li, "o_orderkey", ["l_linenumber", "l_discount"], ["l_linenumber", "l_discount"], "x")
    found = r.without_zeros(lists, "x", "l_discount")
    return found.select("o_orderkey", F.col("n_fixed").cast("long").alias("n_fixed"), F.size(F.filter("x", lambda v: v["l_discount"].isNull())).cast("long").alias("n_null"))


def new_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files (parts by name and size) that aren't stored yet."""
    p = table(spark, sf, "part").select(F.concat("p_name", F.lit(".jpg")).alias("name"), F.col("p_type").alias("folder"), (F.col("p_size") + 0.0004).alias("kb"))
    stored = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat("p_name", F.lit(".jpg")).alias("name"), F.col("p_type").alias("folder"), F.col("p_size").cast("double").alias("kb"))
    return r.not_yet_stored(p, stored).select("name", "folder", F.round("kb", 3).alias("kb"))


def upserted_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with newer rows in place of older ones; of several new ones the last counts."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("price"))
    return s.upserted(o.where("version % 5 < 4"), o.where("version % 5 > 2"), ["k"], "version")


def preferred_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Places named by suppliers, parts or customers: each name once, from the first source that has it."""
    source = lambda k, name, key: table(spark, sf, name).select((F.col(key) % 300).alias("name"), F.lit(k).alias("rank"), F.col(key).alias("id"))
    every = source(0, "supplier", "s_suppkey").union(source(1, "part", "p_partkey").where("name % 2 = 0")).union(source(2, "customer", "c_custkey"))
    return r.reduced(every, ["name"], F.struct("rank", "id"))


def link_set(spark: SparkSession, sf: str) -> DataFrame:
    """Links between suppliers and parts as a set, with those of returned lines added."""
    li = table(spark, sf, "lineitem")
    own = lambda where: li.where(where).select("l_suppkey", (F.col("l_partkey") % 50).alias("part"))
    return s.linked(own("l_returnflag = 'A'"), own("l_returnflag = 'R'"))


def order_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' orders of a priority: how many, the price of the one that stays (finished, dear, new), and whether a dearer one goes."""
    o = table(spark, sf, "orders").withColumn("done", F.col("o_orderstatus") == "F")
    return r.overruled(o, ["o_custkey", "o_orderpriority"], [F.desc("done"), F.desc("o_totalprice"), F.asc("o_orderkey")], "o_totalprice")


def waypoints(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that bear a node's number, at the nearest supplier with that number, else where they are."""
    from ..operators.tracks import waypoint_nodes

    own = places(spark, sf, "customer", "c_custkey").select((F.col("id") % 5).alias("track_id"), F.col("id").alias("seq"), F.when(F.col("id") % 4 > 0, F.concat(F.lit(" "), F.col("id") % 11)).otherwise("start").alias("name"), "lat", "lng")
    nodes = places(spark, sf, "supplier", "s_suppkey").select("id", (F.col("id") % 9).cast("string").alias("number"), "lat", "lng")
    return waypoint_nodes(own, nodes).select("seq", "number", "node_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def compact_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as positional rows."""
    return r.positional(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).select(F.array_join("row", "|").alias("row"))


def first_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The 60 dearest open orders of even customers after the first ten; the limit is the operation's own."""
    where = {"o_orderstatus": {"in": ["O", "P"]}, "o_custkey": {"notNull": True}, "not": {"o_orderpriority": {"containsi": "low"}}}
    return r.scan(table(spark, sf, "orders"), where, ["o_orderkey", "o_totalprice"], [F.desc("o_totalprice"), F.asc("o_orderkey")], offset=10, limit=60)


QUERIES = {f.__name__: f for f in (
    resolved_parts, spaced_customers, favourites, language_versions, listed_names, linked_parts, place_names, cities, contained_lists, countries, parents, least_postcodes, hash_kinds,
    inconsistent_names, missing_drafts, attached_lines, published_lines, repaired_zeros, new_files, upserted_orders, preferred_sources, link_set, order_reports, waypoints, compact_orders, first_orders,
)}

KM = "6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h))"
H = "pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2)"

ORACLE_SQL = {
    "resolved_parts": """
SELECT p_partkey, coalesce((SELECT min(s_suppkey) FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey = p_size), (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey % 20 = p_partkey % 40)) AS found FROM part""",
    "spaced_customers": f"""
WITH c AS ({PLACE_SQL.format(k='c_custkey', t='customer')}), s AS ({PLACE_SQL.format(k='s_suppkey', t='supplier')}),
p AS (SELECT c.id, {H.format(a='c.', b='s.')} AS h FROM c, s)
SELECT id FROM c WHERE id NOT IN (SELECT id FROM p WHERE {KM} <= 0.3)""",
    "favourites": """
WITH e AS (SELECT user_id, event_type, floor(value)::BIGINT AS target FROM events WHERE event_type IN ('view', 'purchase'))
SELECT user_id, target, CASE WHEN bool_or(event_type = 'view') THEN 'view' ELSE 'purchase' END AS origin FROM e GROUP BY ALL""",
    "language_versions": """
SELECT doc_id % 97 AS document, doc_id, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY doc_id % 97 ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, doc_id) = 1""",
    "listed_names": """
WITH n AS (SELECT p_partkey, unnest([p_size::BIGINT, p_partkey % 45, p_partkey % 7]) AS name, unnest([0, 1, 2]) AS place FROM part)
SELECT p_partkey, s_suppkey FROM n JOIN supplier ON s_suppkey % 25 = name
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY place, CASE WHEN s_acctbal > 0 THEN 0 ELSE 1 END, s_suppkey) = 1""",
    "linked_parts": "SELECT DISTINCT s_suppkey + 1000 AS point_id, p_partkey AS route_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey * 2",
    "place_names": """
WITH c AS (SELECT c_custkey AS request, c_custkey % 20 AS name, c_nationkey AS n, n_regionkey AS g FROM customer JOIN nation ON n_nationkey = c_nationkey),
s AS (SELECT s_suppkey, s_suppkey % 20 AS name, s_nationkey AS n, n_regionkey AS g FROM supplier JOIN nation ON n_nationkey = s_nationkey),
p AS (SELECT request, s_suppkey, CASE WHEN c.n = s.n THEN 1 WHEN c.g = s.g THEN 2 ELSE 3 END AS tier FROM c JOIN s USING (name))
SELECT request, s_suppkey AS place_id, tier FROM p QUALIFY row_number() OVER (PARTITION BY request ORDER BY tier, s_suppkey) = 1""",
    "cities": """
WITH r AS (SELECT c_custkey AS o, c_custkey % 60 AS k, CASE WHEN c_custkey % 3 = 0 THEN (1000 + c_custkey)::VARCHAR END AS postcode, CASE WHEN c_custkey % 4 = 0 THEN 'P' || c_custkey END AS province, CASE WHEN c_custkey % 60 > 40 THEN c_custkey / 10.0 END::DOUBLE AS lat FROM customer),
f AS (SELECT k, arg_min(postcode, o) FILTER (WHERE postcode IS NOT NULL) AS postcode, arg_min(province, o) FILTER (WHERE province IS NOT NULL) AS province, arg_min(lat, o) FILTER (WHERE lat IS NOT NULL) AS lat FROM r GROUP BY 1)
SELECT 'stad-' || k AS slug, 'Stad ' || k AS name, postcode, coalesce(province, CASE WHEN s_suppkey IS NOT NULL THEN 'S' END) AS province, CASE WHEN s_suppkey IS NOT NULL THEN 'R' END AS region, coalesce(lat, s_suppkey * 1.5::DOUBLE) AS lat, s_suppkey * 2.5::DOUBLE AS lng
FROM f LEFT JOIN supplier ON s_suppkey = k""",
    "contained_lists": """
WITH p AS (SELECT p_partkey AS k, [k % 3, k % 4, k % 5, k % 3, k % 2, k % 4, k % 7] AS w FROM part),
q AS (SELECT *, [k % 4, k % 5] AS a, CASE WHEN k % 2 = 0 THEN [k % 2, k % 4] ELSE [k % 6, k % 3] END AS b FROM p)
SELECT k AS p_partkey, list_min([i FOR i IN range(0, 6) IF w[i + 1:i + 2] = a]) AS at, list_min([i FOR i IN range(0, 6) IF w[i + 1:i + 2] = b]) AS later FROM q""",
    "countries": """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 > 0 THEN n_regionkey END AS country_id FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "parents": """
WITH r AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey // 2 WHEN 1 THEN s_suppkey + 4 ELSE s_suppkey END AS parent FROM supplier)
SELECT id, CASE WHEN parent <> id AND parent IN (SELECT s_suppkey FROM supplier) THEN parent END AS parent_id FROM r""",
    "least_postcodes": "SELECT 'stad-' || (c_custkey % 40) AS slug, min(CASE WHEN c_custkey % 9 > 0 THEN (c_custkey * 37 % 9000)::VARCHAR END) AS postcode FROM customer GROUP BY 1",
    "hash_kinds": "SELECT CASE c_custkey % 4 WHEN 0 THEN 'md5' WHEN 1 THEN 'bcrypt' ELSE 'unknown' END AS kind, count(*) AS n FROM customer GROUP BY 1",
    "inconsistent_names": "SELECT p_name, count(DISTINCT p_brand) AS p_brand, count(DISTINCT p_type) AS p_type FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1 OR count(DISTINCT p_type) > 1",
    "missing_drafts": "SELECT o_custkey AS document_id, o_orderpriority AS locale FROM orders GROUP BY ALL HAVING NOT bool_or(o_orderstatus = 'P')",
    "attached_lines": """
SELECT o_orderkey, count(l_partkey) AS n_lines, coalesce(string_agg(l_linenumber || '/' || l_partkey || '/' || l_suppkey, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS lines
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "published_lines": "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "repaired_zeros": "SELECT o_orderkey, count(*) FILTER (WHERE l_discount = 0) AS n_fixed, count(*) FILTER (WHERE l_discount = 0) AS n_null FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "new_files": """
SELECT DISTINCT p_name || '.jpg' AS name, p_type AS folder, p_size::DOUBLE AS kb FROM part a
WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey % 2 = 0 AND b.p_name = a.p_name AND b.p_type = a.p_type AND b.p_size = a.p_size)""",
    "upserted_orders": """
WITH o AS (SELECT o_custkey AS k, o_orderkey AS version, o_totalprice AS price FROM orders), n AS (SELECT * FROM o WHERE version % 5 > 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY version DESC) = 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE version % 5 < 4 AND k NOT IN (SELECT k FROM n)""",
    "preferred_sources": """
WITH e AS (SELECT s_suppkey % 300 AS name, 0 AS rank, s_suppkey AS id FROM supplier UNION ALL SELECT p_partkey % 300, 1, p_partkey FROM part WHERE p_partkey % 300 % 2 = 0 UNION ALL SELECT c_custkey % 300, 2, c_custkey FROM customer)
SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank, id) = 1""",
    "link_set": "SELECT DISTINCT l_suppkey, l_partkey % 50 AS part FROM lineitem WHERE l_returnflag IN ('A', 'R')",
    "order_reports": """
WITH w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey) AS i FROM orders)
SELECT o_custkey, o_orderpriority, count(*) AS n_rows, max(o_totalprice) FILTER (WHERE i = 1) AS kept_size, max(o_totalprice) FILTER (WHERE i > 1) > max(o_totalprice) FILTER (WHERE i = 1) AS review FROM w GROUP BY ALL HAVING count(*) > 1""",
    "waypoints": f"""
WITH c AS (SELECT *, id % 11 AS nr FROM ({PLACE_SQL.format(k='c_custkey', t='customer')}) WHERE id % 4 > 0), s AS (SELECT *, id % 9 AS nr FROM ({PLACE_SQL.format(k='s_suppkey', t='supplier')})),
p AS (SELECT c.id AS seq, c.nr, s.id AS node_id, c.lat AS c_lat, c.lng AS c_lng, s.lat AS s_lat, s.lng AS s_lng, {H.format(a='c.', b='s.')} AS h FROM c LEFT JOIN s USING (nr))
SELECT seq, nr::VARCHAR AS number, node_id, round(coalesce(s_lat, c_lat), 6) AS lat, round(coalesce(s_lng, c_lng), 6) AS lng FROM p
QUALIFY row_number() OVER (PARTITION BY seq ORDER BY {KM}, node_id) = 1""",
    "compact_orders": "SELECT o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority AS row FROM orders",
    "first_orders": """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey IS NOT NULL AND NOT contains(lower(o_orderpriority), 'low') ORDER BY o_totalprice DESC, o_orderkey LIMIT 60 OFFSET 10""",
}
