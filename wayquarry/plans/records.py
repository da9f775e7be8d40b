"""Choosing, matching and synchronising rows of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, dates, money
from ..functions import text as t
from ..operators import imports, match
from ..operators import rows as r
from ..operators import sync as s
from ..sources.files import table


def document_winners(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with equal texts (folded to their first line's slug): which one stays, and whether a longer one goes."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("same"))
    kept = r.winner(d, ["same"], [F.when(F.col("lang") == "en", 0).otherwise(1), F.desc("n_chars"), F.asc("doc_id")])
    return kept.groupBy("same").agg(F.min(F.when(F.col("keeps"), F.col("doc_id"))).alias("kept"), F.count(F.lit(1)).alias("n_rows"))


def last_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's last order."""
    o = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    return r.reduced(o, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), last=True).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


def order_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(source, stored): orders as they are, and an older copy that lacks some, has others, and differs in a few."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    source = o.where("id % 10 <> 3")
    old = o.where("id % 10 <> 7").withColumns({"price": F.when(F.col("id") % 4 == 0, F.col("price") + 1).when(F.col("id") % 4 == 1, F.col("price") + 0.0004).otherwise(F.col("price")), "status": F.when(F.col("id") % 6 == 0, F.lit(None)).otherwise(F.col("status"))})
    return source, old


def sync_actions(spark: SparkSession, sf: str) -> DataFrame:
    found = s.diff(*order_versions(spark, sf), ["id"], {"status": None, "price": 0.001})
    return found.select("id", "action", F.array_join("changed", ",").alias("changed"))


def sync_guarded(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows each action takes with guards that hold and with ones that don't."""
    found = s.diff(*order_versions(spark, sf), ["id"], {"status": None, "price": 0.001})
    count = lambda least, name: s.counters(s.guarded(found, least, 0.8)).select(F.lit(name).alias("guard"), "action", "n")
    return count(1, "holds").union(count(10**12, "fails"))


def sync_applied(spark: SparkSession, sf: str) -> DataFrame:
    """The stored table after the actions."""
    found = s.guarded(s.diff(*order_versions(spark, sf), ["id"], {"status": None, "price": 0.001}), 1)
    return s.applied(found).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("decimal(18,4)")).cast("decimal(28,4)").cast("double").alias("total"))


def cascade_match(spark: SparkSession, sf: str) -> DataFrame:
    """Parts to suppliers' numbers by three kinds of keys, the first that fits."""
    p = table(spark, sf, "part")
    targets = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("key"), "s_suppkey")
    name = lambda n: F.concat(F.lit("S"), n.cast("string"))
    candidates = [
        ("manual", F.when(F.col("p_partkey") % 17 == 0, name(F.col("p_partkey") % 5))),
        ("size", F.when(F.col("p_size") > 25, name(F.col("p_size") * 1000))),
        ("key", name(F.col("p_partkey") % 150)),
    ]
    return match.cascade(p, "p_partkey", candidates, targets, "key", "s_suppkey")


def area_match(spark: SparkSession, sf: str) -> DataFrame:
    """Customers to the least supplier of their nation, else of their region, else of all with an equal balance class."""
    n = table(spark, sf, "nation")
    places = lambda name, key, nation: table(spark, sf, name).join(n, F.col(nation) == F.col("n_nationkey")).select(key, F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), (F.col(key) % 7).alias("class"))
    c, s = places("customer", "c_custkey", "c_nationkey"), places("supplier", "s_suppkey", "s_nationkey")
    found = match.nearest_tier(c, s, [["class", "nation"], ["class", "region"], ["class"]], "s_suppkey")
    return found.where("tier is not null").select("c_custkey", "tier", "s_suppkey")


def brand_names(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 most frequent names of parts; the number is the operation's own."""
    return r.histogram(table(spark, sf, "part"), "p_name")


def name_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """How alike the name of each part is to the first name of its brand and type: by edits, by bigrams and by words."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", F.col("p_name").alias("a"))
    first = p.groupBy("p_brand", "p_type").agg(F.min("a").alias("b"))
    x, y = F.col("a"), F.col("b")
    alike = p.join(first, ["p_brand", "p_type"]).withColumns({"wa": F.split("a", " "), "wb": F.split("b", " ")})
    jaccard = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    return alike.select("p_partkey", F.round(t.edit_ratio(x, y), 6).alias("edits"), F.round(t.bigram_dice(x, y), 6).alias("bigrams"), F.round(jaccard, 6).alias("words"))


def name_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' orders to subscriptions by fuzzy names, addresses and dates."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    number = F.regexp_extract("c_name", r"(\d+)$", 1)
    day = F.date_add(F.lit("2000-01-01").cast("date"), k.cast("int"))
    address = F.concat(number, F.lit("@example.com"))
    subs = c.select(k.cast("string").alias("sub_id"), F.concat(F.lit("Huis "), F.when(k % 3 == 0, F.concat(F.lit("nr"), number)).otherwise(number)).alias("sub_name"), F.when(k % 2 == 0, address).alias("sub_email"), F.when(k % 5 > 0, day).alias("start_date"))
    own = c.select(k.cast("string").alias("customer_id"), number.alias("label"), address.alias("email"), F.array(day).alias("dates"))
    return match.fuzzy(subs, own).select("sub_id", "customer_id", "status", F.round("total", 6).alias("total"))


def customer_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by customer, with dates as a set and the last order."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("email"), F.concat(F.lit("Name "), (F.col("o_orderkey") % 2).cast("string")).alias("name"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("number"))
    return match.customers(o).select(F.col("email").cast("long").alias("customer"), "norm_name", F.size("orders").cast("long").alias("n_orders"), F.size("dates").cast("long").alias("n_dates"), F.element_at("orders", -1)["number"].alias("last_order"))


def monthly_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of lodgings by partner and month; negative counts are zero, impossible months go."""
    li = table(spark, sf, "lineitem")
    stats = li.groupBy(F.col("l_suppkey").alias("lid"), F.year("l_shipdate").alias("year"), (F.month("l_shipdate") + F.when(F.col("l_linenumber") == 7, 12).otherwise(0)).alias("month")).agg(
        (F.sum("l_quantity") - 200).cast("long").alias("views"), F.count(F.lit(1)).alias("page_views"), F.lit(None).cast("long").alias("website")
    )
    own = table(spark, sf, "supplier")
    lodgings = own.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s-"), F.floor(F.col("s_suppkey") / 2).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "-routes").otherwise("")).alias("url"), F.col("s_name").alias("title"))
    partners = own.select(F.col("s_suppkey").alias("partner_id"), F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("slug"), F.col("s_name").alias("name"))
    rows, _ = imports.partner_stats(stats, lodgings, partners)
    return rows


def written_values(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers, dates, durations and flags as they may be written, read again."""
    e = table(spark, sf, "events").select("event_id", "value")
    i = F.col("event_id")
    comma = F.translate(F.format_number("value", 2), ".,", ",")
    written = F.when(i % 5 == 0, F.concat((i % 12).cast("string"), F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0"))).when(i % 5 == 1, F.concat((i % 9).cast("string"), F.lit(",5 uur"))).when(i % 5 == 2, F.concat((i % 90).cast("string"), F.lit(" min"))).when(i % 5 == 3, F.concat((i % 7).cast("string"), F.lit("u30"))).otherwise((i % 40).cast("string"))
    anchor = F.date_add(F.lit("2020-01-31").cast("date"), (i % 400).cast("int"))
    return e.select(
        "event_id", coerce.js_round(coerce.loose_number(comma) - 10, 1).alias("number"), dates.duration_minutes(written).alias("minutes"),
        dates.anniversary(anchor, F.lit("2024-01-15").cast("date")).alias("anniversary"), coerce.node_number(F.when(i % 4 == 0, F.lit("-9999")).when(i % 4 == 1, F.lit(" 0 ")).otherwise((i % 100).cast("string"))).alias("node"),
        coerce.flag(F.when(i % 3 == 0, " Ja ").when(i % 3 == 1, "nee")).alias("flag"), t.difficulty(i % 6).alias("difficulty"), money.euro(F.floor(F.col("value")) * 100).alias("euro"),
    )


QUERIES = {
    "document_winners": document_winners, "last_orders": last_orders, "sync_actions": sync_actions, "sync_guarded": sync_guarded, "sync_applied": sync_applied, "cascade_match": cascade_match,
    "area_match": area_match, "brand_names": brand_names, "name_ratios": name_ratios, "name_matches": name_matches, "customer_orders": customer_orders, "monthly_stats": monthly_stats, "written_values": written_values,
}

SYNC_SQL = """s AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 10 <> 3),
t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus END AS status, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice + 1 WHEN 1 THEN o_totalprice + 0.0004 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 10 <> 7),
j AS (SELECT coalesce(s.id, t.id) AS id, s.id IS NOT NULL AS here, t.id IS NOT NULL AS there, s.status IS DISTINCT FROM t.status AS a, abs(s.price - t.price) > 0.001 AS b, s.status AS s_status, t.status AS t_status, s.price AS s_price, t.price AS t_price FROM s FULL JOIN t ON s.id = t.id),
d AS (SELECT *, CASE WHEN NOT there THEN 'insert' WHEN NOT here THEN 'stale' WHEN a OR b THEN 'update' ELSE 'keep' END AS action, CASE WHEN here AND there THEN concat_ws(',', CASE WHEN a THEN 'status' END, CASE WHEN b THEN 'price' END) ELSE '' END AS changed FROM j)"""

ORACLE_SQL = {
    "document_winners": """
WITH d AS (SELECT doc_id, lang, coalesce(n_chars, 0) AS n, md5(coalesce(text, '')) AS same FROM documents)
SELECT same, arg_min(doc_id, (CASE WHEN lang = 'en' THEN 0 ELSE 1 END, -n, doc_id)) AS kept, count(*) AS n_rows FROM d GROUP BY 1""",
    "last_orders": """
SELECT o_custkey, o_orderkey, o_orderdate::DATE AS o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) = 1""",
    "sync_actions": f"WITH {SYNC_SQL} SELECT id, action, changed FROM d",
    "sync_guarded": f"""WITH {SYNC_SQL} SELECT 'holds' AS guard, CASE action WHEN 'stale' THEN 'delete' ELSE action END AS action, count(*) AS n FROM d GROUP BY ALL
UNION ALL SELECT 'fails', CASE action WHEN 'stale' THEN 'keep' ELSE action END, count(*) FROM d GROUP BY ALL""",
    "sync_applied": f"""WITH {SYNC_SQL}, r AS (SELECT CASE WHEN action IN ('insert', 'update') THEN s_status ELSE t_status END AS status, CASE WHEN action IN ('insert', 'update') THEN s_price ELSE t_price END AS price FROM d WHERE action <> 'stale')
SELECT status, count(*) AS n, sum(price::DECIMAL(18,4))::DOUBLE AS total FROM r GROUP BY 1""",
    "cascade_match": """
WITH c AS (SELECT p_partkey, 0 AS rank, 'manual' AS how, p_partkey % 5 AS k FROM part WHERE p_partkey % 17 = 0 UNION ALL SELECT p_partkey, 1, 'size', p_size * 1000 FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 2, 'key', p_partkey % 150 FROM part)
SELECT p_partkey, s_suppkey, how FROM c JOIN supplier ON s_suppkey = k QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY rank) = 1""",
    "area_match": """
WITH c AS (SELECT c_custkey, n_nationkey AS n, n_regionkey AS g FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT s_suppkey, n_nationkey AS n, n_regionkey AS g FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT c_custkey, s_suppkey, CASE WHEN c.n = s.n THEN 1 WHEN c.g = s.g THEN 2 ELSE 3 END AS tier FROM c JOIN s ON c_custkey % 7 = s_suppkey % 7),
b AS (SELECT c_custkey, min(tier) AS tier FROM p GROUP BY 1) SELECT c_custkey, tier, min(s_suppkey) AS s_suppkey FROM p JOIN b USING (c_custkey, tier) GROUP BY ALL""",
    "brand_names": "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 25",
    "name_ratios": """
WITH n AS (SELECT p_partkey, p_name AS a, min(p_name) OVER (PARTITION BY p_brand, p_type) AS b FROM part),
g AS (SELECT *, [a[i:i + 1] FOR i IN range(1, length(a))] AS ga, [b[i:i + 1] FOR i IN range(1, length(b))] AS gb, string_split(a, ' ') AS wa, string_split(b, ' ') AS wb FROM n)
SELECT p_partkey, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS edits,
  round(2 * list_sum([least(len(list_filter(ga, lambda y: y = x)), len(list_filter(gb, lambda y: y = x))) FOR x IN list_distinct(ga)]) / (length(a) + length(b) - 2), 6) AS bigrams,
  round(len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))), 6) AS words FROM g""",
    "customer_orders": """
WITH o AS (SELECT o_custkey AS customer, 'name ' || (o_orderkey % 2) AS norm_name, o_orderdate::DATE AS d, o_orderkey AS k FROM orders)
SELECT customer, norm_name, count(*) AS n_orders, count(DISTINCT d) AS n_dates, arg_max(k, (d, k)) AS last_order FROM o GROUP BY ALL""",
    "monthly_stats": """
WITH s AS (SELECT l_suppkey AS lid, year(l_shipdate) AS y, month(l_shipdate) + CASE WHEN l_linenumber = 7 THEN 12 ELSE 0 END AS m, (sum(l_quantity) - 200)::BIGINT AS views, count(*) AS page_views FROM lineitem GROUP BY ALL)
SELECT lid // 2 AS partner_id, lid, y || '-' || lpad(m::VARCHAR, 2, '0') AS month, greatest(views, 0) AS views, page_views, 0::BIGINT AS website FROM s JOIN supplier ON s_suppkey = lid
WHERE y > 2000 AND m <= 12 AND lid // 2 IN (SELECT s_suppkey FROM supplier)""",
    "written_values": """
WITH e AS (SELECT event_id AS i, value FROM events), a AS (SELECT *, DATE '2020-01-31' + (i % 400)::INTEGER AS anchor, DATE '2024-01-15' + 60 AS lim FROM e),
y AS (SELECT *, [make_date(year(lim) - k, month(anchor), 1) FOR k IN [0, 1, 2]] AS firsts FROM a),
z AS (SELECT *, list_max([x FOR x IN [least(f + (day(anchor) - 1)::INTEGER, last_day(f)) FOR f IN firsts] IF x <= lim]) AS anniversary FROM y)
SELECT i AS event_id, floor((round(value, 2) - 10) * 10 + 0.5) / 10 AS number,
  CASE i % 5 WHEN 0 THEN i % 12 * 60 + i % 60 WHEN 1 THEN i % 9 * 60 + 30 WHEN 2 THEN i % 90 WHEN 3 THEN i % 7 * 60 + 30 ELSE CASE WHEN i % 40 <= 12 THEN i % 40 * 60 ELSE i % 40 END END::BIGINT AS minutes,
  anniversary::DATE AS anniversary, CASE WHEN i % 4 < 2 OR i % 100 = 0 THEN '' ELSE (i % 100)::VARCHAR END AS node, i % 3 = 0 AS flag,
  CASE WHEN i % 6 <= 2 THEN 'easy' WHEN i % 6 <= 4 THEN 'moderate' ELSE 'hard' END AS difficulty,
  '€ ' || replace(replace(replace(format('{:,.2f}', floor(value) * 100), ',', '_'), '.', ','), '_', '.') AS euro FROM z""",
}
