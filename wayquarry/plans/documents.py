"""Formats written and read back, documents compared, names made unique, ways stitched: over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, rows, stitching
from ..sources import files, gpx, sqldump
from ..sources.files import table
from ..storage import scratch


def _quoted(x: Column) -> Column:
    """An SQL string, its quotes doubled and its backslashes escaped."""
    return F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))


def dump_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a dump, a statement for each customer, and back: names in the statement and rows with odd signs."""
    o = table(spark, sf, "orders")
    note = F.concat(F.lit("it's "), F.col("o_orderpriority"), F.lit("; (\\no), "), F.col("o_orderstatus"), F.lit("')\n-- x"))
    own = F.concat(F.lit("("), F.col("o_orderkey").cast("string"), F.lit(","), F.when(F.col("o_orderkey") % 5 == 0, F.lit("NULL")).otherwise(_quoted(note)), F.lit(")"))
    statements = o.groupBy("o_custkey").agg(F.array_join(F.collect_list(own), ",").alias("rows")).select(F.concat(F.lit("INSERT INTO `orders` (`key`,`note`) VALUES "), F.col("rows"), F.lit(";\n/* it's done; */")))
    path = scratch(spark, "dump")
    statements.write.text(path)
    return sqldump.read(spark, path, "orders", ["key", "note"]).select(F.col("key").cast("long").alias("o_orderkey"), "note")


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as features, a collection for each nation, and back: ids, properties in any case, places."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    one = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.concat(F.lit("f"), k).alias("id"),
        F.struct(F.lit("Point").alias("type"), F.array(4 + (k % 100) / 128, 50 + (k % 50) / 64).alias("coordinates")).alias("geometry"),
        F.struct(F.col("c_name").alias("Naam"), F.concat(F.lit("} "), (k % 7).cast("string"), F.lit(" {\"")).alias("NR")).alias("properties"),
    ))
    whole = c.groupBy("c_nationkey").agg(F.array_join(F.collect_list(one), ",").alias("f")).select("c_nationkey", F.concat(F.lit('{"crs":{"properties":{"features":[{}]}},"features":['), F.col("f"), F.lit('],"type":"FeatureCollection"}')).alias("value"))
    path = scratch(spark, "features")
    whole.repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    found = files.named(files.features(spark, path), files.NODE_NAMES)
    at = F.from_json("geometry", "coordinates array<double>")["coordinates"]
    return found.select("external_id", "number", "name", at[1].alias("lat"), at[0].alias("lng"))


def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as delimited text with quotes, separators and line ends within values, and back."""
    p = table(spark, sf, "part")
    name = F.concat(F.lit('"'), F.col("p_name"), F.lit('"; "x"\n'), F.col("p_brand"))
    path = scratch(spark, "csv")
    p.select(F.col("p_partkey").alias("key"), name.alias("name"), F.when(F.col("p_size") > 9, F.col("p_size")).alias("size")).write.option("header", True).option("quote", '"').option("escape", '"').option("sep", ";").csv(path)
    return files.csv(spark, path, ";", "key long, name string, size int").select(F.col("key").alias("p_partkey"), "name", "size")


def tsv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as raw rows with tabs, and back; NULL is null."""
    s = table(spark, sf, "supplier")
    line = F.concat_ws("\t", F.col("s_suppkey").cast("string"), F.concat(F.lit('"'), F.col("s_name")), F.when(F.col("s_suppkey") % 3 == 0, F.lit("NULL")).otherwise(F.col("s_nationkey").cast("string")))
    path = scratch(spark, "tsv")
    s.select(line).write.text(path)
    return files.tsv(spark, path, ["key", "name", "nation"]).select(F.col("key").cast("long").alias("s_suppkey"), "name", F.col("nation").cast("int").alias("nation"))


def record_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events of users as JSON of three shapes, and back."""
    e = table(spark, sf, "events").select("user_id", F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")).alias("r"))
    of = e.groupBy("user_id").agg(F.collect_list("r").alias("all"))
    shaped = F.transform("all", lambda x: F.struct(x.alias("properties")))
    text = F.when(F.col("user_id") % 3 == 0, F.to_json("all")).when(F.col("user_id") % 3 == 1, F.to_json(F.struct(F.col("all").alias("records")))).otherwise(F.to_json(F.struct(shaped.alias("features"))))
    return files.records(of.select(text.alias("text")), "text", "id: bigint, kind: string").select(F.col("id").alias("event_id"), "kind")


def gpx_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as the points of a track for each nation of customers, and back: titles, points in order, heights."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    k = F.col("o_orderkey")
    point = F.format_string('<trkpt lat="%s" lon="%s"><ele>%s</ele></trkpt>', (50 + (k % 1000) / 1024).cast("string"), (4 + (k % 500) / 512).cast("string"), (k % 300).cast("string"))
    # a line for each point, so that a file is written as it is sorted
    nations, no_key = o.select("c_nationkey").distinct(), F.lit(None).cast("long").alias("o_orderkey")
    head = F.concat(F.lit("<gpx><trk><name>N &amp; "), F.col("c_nationkey").cast("string"), F.lit("</name><trkseg>"))
    lines = o.select("c_nationkey", F.lit(1).alias("part"), F.col("o_orderkey").cast("long"), point.alias("value"))
    lines = lines.union(nations.select("c_nationkey", F.lit(0), no_key, head)).union(nations.select("c_nationkey", F.lit(2), no_key, F.lit("</trkseg></trk></gpx>")))
    path = scratch(spark, "gpx")
    lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "part", "o_orderkey").select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    tracks, points, _ = gpx.read_points(spark, path)
    sums = points.groupBy("path").agg(F.count("*").alias("n_points"), F.round(F.sum("lat"), 6).alias("lat_sum"), F.round(F.coalesce(F.sum("ele"), F.lit(0.0)), 3).alias("ele_sum"))
    return tracks.join(sums, "path").select("title", "n_points", "lat_sum", "ele_sum")


def changed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Events as documents before and after changes: other ids and orders of keys are none, a changed, a new and a lost value are."""
    e = table(spark, sf, "events")
    k, kind = F.col("event_id"), F.to_json(F.struct(F.col("event_type").alias("x")))
    quoted = F.replace(F.replace(kind, F.lit('{"x":'), F.lit("")), F.lit("}"), F.lit(""))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    before = e.select("event_id", text('{"id":1,"kind":', quoted, ',"tags":["x",{"n":', k.cast("string"), ',"id":5}],"none":null,"km":1.50}').alias("json"))
    n = F.when(k % 4 == 0, k + 1).otherwise(k).cast("string")
    after = e.select("event_id", text('{"km":15e-1,"tags":["x",{"id":7,"n":', n, "}", F.when(k % 6 == 0, ',"more"').otherwise(""), "]", F.when(k % 5 == 0, "").otherwise(',"none":null'), ',"kind":', quoted, ',"id":2}').alias("json"))
    return compare.differences(before, after, "event_id", "json")


def unique_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by their segment's name, made unique in order of their keys."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("name"))
    return rows.unique_names(c, "name", ["c_custkey"]).select("c_custkey", "unique_name")


def stitched_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A line for each customer, cut into ways of two points, some turned, in another order, and stitched: where it begins and ends."""
    c = files.spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    k = F.col("c_custkey")
    at = lambda i: F.struct((50 + (k % 100) / 128 + i / 1024).alias("lat"), (4 + i * (i + k % 7) / 2048).alias("lng"))
    way = lambda i: F.when((i + k) % 3 == 0, F.array(at(i + 1), at(i))).otherwise(F.array(at(i), at(i + 1)))
    order = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), 4 + k % 5 - 1), lambda i: F.struct(((i * 7 + k) % 11).alias("o"), i.alias("i"))))
    relations = c.select("c_custkey", F.transform(order, lambda x: way(x["i"])).alias("ways"))
    line = relations.select("c_custkey", stitching.stitched(F.col("ways")).alias("line"))
    first, last = F.element_at("line.path", 1), F.element_at("line.path", -1)
    return line.select("c_custkey", F.size("line.path").cast("long").alias("n_points"), first["lat"].alias("lat1"), first["lng"].alias("lng1"), last["lat"].alias("lat2"), last["lng"].alias("lng2"), F.col("line.complete").alias("complete"))


QUERIES = {
    "dump_rows": dump_rows, "feature_rows": feature_rows, "csv_rows": csv_rows, "tsv_rows": tsv_rows, "record_rows": record_rows, "gpx_rows": gpx_rows,
    "changed_documents": changed_documents, "unique_segments": unique_segments, "stitched_lines": stitched_lines,
}

ORACLE_SQL = {
    "dump_rows": r"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN 'it''s ' || o_orderpriority || '; (\no), ' || o_orderstatus || ''')' || chr(10) || '-- x' END AS note FROM orders""",
    "feature_rows": """SELECT 'f' || c_custkey AS external_id, '} ' || (c_custkey % 7) || ' {"' AS number, c_name AS name, 50 + (c_custkey % 50) / 64::DOUBLE AS lat, 4 + (c_custkey % 100) / 128::DOUBLE AS lng FROM customer""",
    "csv_rows": """SELECT p_partkey, '"' || p_name || '"; "x"' || chr(10) || p_brand AS name, CASE WHEN p_size > 9 THEN p_size END AS size FROM part""",
    "tsv_rows": """SELECT s_suppkey, '"' || s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END AS nation FROM supplier""",
    "record_rows": "SELECT event_id, event_type AS kind FROM events",
    "gpx_rows": """SELECT 'N & ' || c_nationkey AS title, count(*) AS n_points, round(sum(50 + (o_orderkey % 1000) / 1024::DOUBLE), 6) AS lat_sum, round(sum((o_orderkey % 300)::DOUBLE), 3) AS ele_sum
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey HAVING count(*) > 1""",
    "changed_documents": """
SELECT event_id, 'tags.#1.n' AS path, event_id::DOUBLE::VARCHAR AS before, (event_id + 1)::DOUBLE::VARCHAR AS after FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 'tags', '[2', '[3' FROM events WHERE event_id % 6 = 0
UNION ALL SELECT event_id, 'tags.#2', NULL, '"more"' FROM events WHERE event_id % 6 = 0
UNION ALL SELECT event_id, 'none', 'null', NULL FROM events WHERE event_id % 5 = 0""",
    "unique_segments": """
WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS name, row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_custkey) AS r FROM customer)
SELECT c_custkey, CASE WHEN r = 1 THEN name ELSE name || '-' || r END AS unique_name FROM n""",
    "stitched_lines": """
WITH w AS (SELECT c_custkey AS k, 4 + c_custkey % 5 AS n, unnest(range(4 + c_custkey % 5)) AS i FROM customer),
f AS (SELECT k, n, arg_min((i + k) % 3 = 0, (i * 7 + k) % 11) AS turned FROM w GROUP BY k, n),
e AS (SELECT k, n, turned, 50 + (k % 100) / 128::DOUBLE AS lat, 4::DOUBLE AS lng, 50 + (k % 100) / 128::DOUBLE + n / 1024::DOUBLE AS lat_n, 4 + n * (n + k % 7) / 2048::DOUBLE AS lng_n FROM f)
SELECT k AS c_custkey, n + 1 AS n_points, CASE WHEN turned THEN lat_n ELSE lat END AS lat1, CASE WHEN turned THEN lng_n ELSE lng END AS lng1, CASE WHEN turned THEN lat ELSE lat_n END AS lat2, CASE WHEN turned THEN lng ELSE lng_n END AS lng2, true AS complete FROM e""",
}
