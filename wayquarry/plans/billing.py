"""Customers as subscriptions and prospects, orders as invoices, line items as their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import js_round
from ..functions.dates import period_end
from ..functions.money import structured_reference
from ..operators import billing as b
from ..operators import crm
from ..operators.rows import page
from ..sources.files import table

AS_OF = "2001-06-15"


def as_of():
    return F.lit(AS_OF).cast("date")


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    """A paid, draft or sent invoice for each order; some name the next customer on a line."""
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_orderkey").alias("number"), F.col("o_custkey").alias("sub_id"),
        F.when(F.col("o_orderkey") % 5 == 0, F.array(F.col("o_custkey") + 1)).alias("line_subs"),
        F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "sent").otherwise("draft").alias("status"),
        day.alias("period_start"), F.date_add(day, 30).alias("due_date"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 20)).alias("paid_at"),
        F.col("o_totalprice").alias("total_incl"), (F.col("o_orderstatus") == "F").alias("renewed"),
    )


def subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    """A subscription for each customer; its runs are its paid orders."""
    paid = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderdate").cast("date")).alias("last_run"), F.count(F.lit(1)).cast("int").alias("run_count"))
    c = table(spark, sf, "customer").join(paid, "c_custkey", "left")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int"))
    return c.select(
        F.col("c_custkey").alias("sub_id"), F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") == "FURNITURE", "Free").otherwise(F.col("c_mktsegment")).alias("package"),
        F.when(F.col("c_acctbal") < 0, "ended").otherwise("active").alias("status"), start.alias("start_date"), F.when(F.col("c_custkey") % 3 > 0, F.date_add(start, 14)).alias("first_run"),
        "last_run", "run_count", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("price"), F.when(F.col("c_custkey") % 4 == 0, 5.0).alias("discount"),
    )


SUBS_SQL = f"""
inv AS (SELECT o_orderkey AS number, o_custkey, o_orderdate::DATE AS period_start, o_totalprice AS total,
    CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'sent' ELSE 'draft' END AS status FROM orders),
named AS (SELECT o_custkey AS sub_id, * FROM inv UNION SELECT o_custkey + 1, * FROM inv WHERE number % 5 = 0),
runs AS (SELECT o_custkey AS sub_id, max(o_orderdate::DATE) AS last_run, count(*)::INTEGER AS run_count FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
subs AS (SELECT c_custkey AS sub_id, c_name AS name, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Free' ELSE c_mktsegment END AS package,
    CASE WHEN c_acctbal < 0 THEN 'ended' ELSE 'active' END AS status, DATE '1995-01-01' + (c_custkey % 365)::INTEGER AS start_date,
    CASE WHEN c_custkey % 3 > 0 THEN DATE '1995-01-01' + ((c_custkey % 365)::INTEGER + 14) END AS first_run, last_run, run_count,
    CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS price, CASE WHEN c_custkey % 4 = 0 THEN 5.0 END::DOUBLE AS discount
  FROM customer LEFT JOIN runs ON c_custkey = runs.sub_id),
facts AS (SELECT s.sub_id, count(*) FILTER (WHERE n.status <> 'paid') AS open_invoices,
    max(n.number) FILTER (WHERE n.status <> 'paid' AND n.period_start > coalesce(last_run, DATE '0001-01-01')) AS pending_number,
    max(n.number) AS latest_number, arg_max(n.status, n.number) AS latest_status, arg_max(n.total, n.number) AS latest_total
  FROM subs s JOIN named n ON n.sub_id = s.sub_id GROUP BY s.sub_id),
nexts AS (SELECT *, coalesce((last_run + INTERVAL 12 MONTH)::DATE, first_run, start_date) AS next_run FROM subs LEFT JOIN facts USING (sub_id)),
overview AS (SELECT sub_id, name, package, status, coalesce(first_run, start_date) AS first_run, last_run, next_run, price, coalesce(discount, 0.0)::DOUBLE AS discount,
    coalesce(run_count, 0) AS run_count,
    status = 'active' AND package <> 'Free' AND pending_number IS NULL AND next_run <= DATE '{AS_OF}' + 30 AS due,
    status = 'active' AND package <> 'Free' AND pending_number IS NULL AND next_run < DATE '{AS_OF}' AS overdue,
    pending_number, coalesce(open_invoices, 0) AS open_invoices, latest_number, latest_status, latest_total FROM nexts)
"""


def billing_overview(spark: SparkSession, sf: str) -> DataFrame:
    found = b.overview(subscriptions(spark, sf), invoices(spark, sf), as_of())
    return found.orderBy(F.col("next_run").asc_nulls_last(), "sub_id")


def billing_kpis(spark: SparkSession, sf: str) -> DataFrame:
    found = b.kpis(b.overview(subscriptions(spark, sf), invoices(spark, sf), as_of()), invoices(spark, sf), as_of())
    return found.withColumns({"open_total": js_round("open_total", 1), "paid_this_year": js_round("paid_this_year", 1)})


def new_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices for every subscription that is due, and for every 50th customer whether it is or not."""
    over = b.overview(subscriptions(spark, sf), invoices(spark, sf), as_of())
    asked = over.where("due or sub_id % 50 = 0").select("sub_id", F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("discount"), F.lit(None).cast("date").alias("period_start"))
    # a period is taken by any invoice that names the subscription, in its header or on a line
    return b.new_invoices(over, b.invoice_lines(invoices(spark, sf)), asked, as_of())


def renewals(spark: SparkSession, sf: str) -> DataFrame:
    """Subscriptions after the invoices that are sent have been paid."""
    subs = subscriptions(spark, sf).withColumn("last_invoice", F.lit(None).cast("string"))
    sent = invoices(spark, sf).where("status = 'sent'")
    return b.renewed(subs, sent).select("sub_id", "first_run", "last_run", "run_count", "last_invoice", F.col("before.last_run").alias("last_run_before"))


def invoice_status(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices by status and need of a renewal after every third one was paid and every seventh was cancelled."""
    own = invoices(spark, sf).withColumn("history", F.lit(None).cast("string"))
    to = F.when(F.col("invoice_id") % 7 == 0, "cancelled").when(F.col("invoice_id") % 3 == 0, "paid")
    changes = own.select("invoice_id", to.alias("new_status"), F.lit(None).cast("date").alias("paid_at")).where("new_status is not null")
    done = b.transitions(own, changes, as_of())
    return done.groupBy("status", "renewal", "history").agg(F.count(F.lit(1)).alias("n"), F.max("paid_at").alias("last_paid"))


def invoice_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per order: its lines' totals with stepwise rounding, and its rate where all lines have one."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").alias("price"), (F.col("l_discount") * 100).alias("discount"), F.round(F.col("l_tax") * 100).alias("vat"))
    return b.document_totals(li, "order_id")


def references(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    number = F.col("o_orderkey") * 7919 + 202601010000
    end = period_end(F.col("o_orderdate").cast("date"), 12)
    return o.select("o_orderkey", structured_reference(F.when(F.col("o_orderkey") % 2 == 0, number).otherwise(F.col("o_orderkey"))).alias("reference"), end.alias("period_end"))


def invoice_subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Per subscription: how many invoices name it, in the header or on a line."""
    return b.invoice_lines(invoices(spark, sf)).groupBy("sub_id").agg(F.count(F.lit(1)).alias("n_invoices"), F.max("number").alias("latest"))


def prospects(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.element_at(F.array(*map(F.lit, ("new", "new", "mailed", "do_not_contact", "partner"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("prospect_id"), F.when(F.col("c_custkey") % 11 > 0, F.concat("c_name", F.lit("@example.com"))).alias("email"), stage.alias("stage"),
        F.when(F.col("c_custkey") % 13 == 0, F.timestamp_seconds(F.lit(978_307_200))).alias("unsubscribed_at"), F.when(F.col("c_custkey") % 500 == 2, F.lit(f"{AS_OF} 08:00:00").cast("timestamp")).alias("last_mailed_at"),
    )


def mail_queue(spark: SparkSession, sf: str) -> DataFrame:
    """First mails for all prospects: who gets one today, and why the others don't. The limit a day is the operation's own."""
    return crm.mail_queue(prospects(spark, sf), "first", F.lit(f"{AS_OF} 12:00:00").cast("timestamp"))


def rating_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per type of event: count and mean of the 200 newest; the 200 are the operation's own."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("review_id"), "event_type", F.col("value").alias("rating"), F.col("ts").alias("created_at"), F.lit("approved").alias("review_status"))
    return crm.rating_summary(e, "event_type")


def popularity(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    counted = e.groupBy("user_id").agg(n("view").alias("views"), n("purchase").alias("downloads"), n("signup").alias("favourites"), F.min("ts").alias("since"))
    hours = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) / 3.6e9
    return counted.select("user_id", "views", "downloads", "favourites", F.round(crm.popularity(F.col("views"), F.col("downloads"), F.col("favourites"), hours), 6).alias("score"))


def invoice_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of unpaid, urgent or large orders, the newest first; a page is the operation's own limit."""
    from ..operators.rows import condition

    where = {"o_orderstatus": {"ne": "F"}, "or": [{"o_orderpriority": {"eqi": "1-urgent"}}, {"o_totalprice": {"gte": 400000.0}}]}
    o = table(spark, sf, "orders").where(condition(where)).withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    return page(o, [F.desc("o_orderdate"), F.asc("o_orderkey")], number=2).select("o_orderkey", "o_orderdate", "o_totalprice", "total")


QUERIES = {
    "billing_overview": billing_overview, "billing_kpis": billing_kpis, "new_invoices": new_invoices, "renewals": renewals, "invoice_status": invoice_status,
    "invoice_totals": invoice_totals, "references": references, "invoice_subscriptions": invoice_subscriptions, "mail_queue": mail_queue, "rating_summary": rating_summary,
    "popularity": popularity, "invoice_page": invoice_page,
}

ORACLE_SQL = {
    "billing_overview": f"WITH {SUBS_SQL} SELECT * FROM overview",
    "billing_kpis": f"""
WITH {SUBS_SQL}, i AS (SELECT status, total, period_start + 30 AS due_date, period_start + 20 AS paid_at FROM inv)
SELECT (SELECT count(*) FROM overview WHERE due) AS n_due, count(*) FILTER (WHERE status <> 'paid') AS n_open,
  floor(coalesce(sum(total) FILTER (WHERE status <> 'paid'), 0) * 10 + 0.5) / 10 AS open_total, count(*) FILTER (WHERE status = 'sent' AND due_date < DATE '{AS_OF}') AS n_overdue,
  floor(coalesce(sum(total) FILTER (WHERE status = 'paid' AND year(paid_at) = 2001), 0) * 10 + 0.5) / 10 AS paid_this_year FROM i""",
    "new_invoices": f"""
WITH {SUBS_SQL}, taken AS (SELECT sub_id, period_start, max(number) AS taken_by FROM named GROUP BY 1, 2),
asked AS (SELECT o.*, CASE WHEN price IS NULL THEN 'no price' WHEN taken_by IS NOT NULL THEN 'invoice ' || taken_by || ' is for this period' END AS error
  FROM overview o LEFT JOIN taken t ON t.sub_id = o.sub_id AND t.period_start = o.next_run WHERE due OR o.sub_id % 50 = 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY error IS NULL ORDER BY sub_id) - 1 AS place, error IS NULL AS ok, (next_run + INTERVAL 12 MONTH)::DATE - 1 AS ends,
  floor(price * (1 - discount / 100) * 100 + 0.5) / 100 AS excl FROM asked),
taxed AS (SELECT *, floor(excl * 21.0 / 100 * 100 + 0.5) / 100 AS vat FROM numbered)
SELECT sub_id, error, CASE WHEN ok THEN (SELECT max(number) FROM inv) + 1 + place END AS number, CASE WHEN ok THEN 'draft' END AS status, CASE WHEN ok THEN DATE '{AS_OF}' END AS invoice_date,
  CASE WHEN ok THEN DATE '{AS_OF}' + 30 END AS due_date, CASE WHEN ok THEN next_run END AS period_start, CASE WHEN ok THEN ends END AS period_end,
  CASE WHEN ok THEN 'Package ' || package || ' (' || strftime(next_run, '%d/%m/%Y') || ' - ' || strftime(ends, '%d/%m/%Y') || ')' END AS description,
  CASE WHEN ok THEN excl END AS total_excl, CASE WHEN ok THEN vat END AS total_vat, CASE WHEN ok THEN floor((excl + vat) * 100 + 0.5) / 100 END AS total_incl FROM taxed""",
    "renewals": f"""
WITH {SUBS_SQL}, p AS (SELECT sub_id, max(period_start) AS top, min(period_start) AS bottom, count(*) AS n, max(number) AS number FROM named WHERE status = 'sent' GROUP BY 1)
SELECT s.sub_id, CASE WHEN n IS NULL THEN first_run ELSE coalesce(first_run, bottom) END AS first_run, CASE WHEN n IS NULL THEN last_run ELSE greatest(last_run, top) END AS last_run,
  coalesce(run_count, 0) + coalesce(n, 0) AS run_count, number::VARCHAR AS last_invoice, CASE WHEN n IS NOT NULL THEN last_run END AS last_run_before FROM subs s LEFT JOIN p ON p.sub_id = s.sub_id""",
    "invoice_status": f"""
WITH i AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS was, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'sent' ELSE 'draft' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + 20 END AS paid_at FROM orders),
j AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'cancelled' WHEN k % 3 = 0 THEN 'paid' END AS new FROM i),
r AS (SELECT coalesce(new, status) AS status, CASE WHEN new = 'paid' AND NOT was THEN 'renew' WHEN new = 'cancelled' AND was THEN 'undo' END AS renewal,
  CASE WHEN new = 'paid' THEN DATE '{AS_OF}' ELSE paid_at END AS paid_at, CASE new WHEN 'paid' THEN 'paid on 15/06/2001' WHEN 'cancelled' THEN 'cancelled' END AS history FROM j)
SELECT status, renewal, history, count(*) AS n, max(paid_at) AS last_paid FROM r GROUP BY ALL""",
    "invoice_totals": """
WITH l AS (SELECT l_orderkey AS order_id, l_extendedprice AS price, round(l_tax * 100) AS vat, floor(l_extendedprice * (1 - l_discount * 100 / 100) * 100 + 0.5) / 100 AS excl FROM lineitem),
t AS (SELECT *, floor(excl * vat / 100 * 100 + 0.5) / 100 AS tax FROM l), u AS (SELECT *, floor((excl + tax) * 100 + 0.5) / 100 AS incl FROM t)
SELECT order_id, round(sum(price), 2) AS price, round(sum(excl), 2) AS total_excl, round(sum(tax), 2) AS total_vat, round(sum(incl), 2) AS total_incl,
  CASE WHEN min(vat) = max(vat) THEN min(vat) END AS vat_rate, count(*) AS n_lines FROM u GROUP BY 1""",
    "references": """
WITH n AS (SELECT o_orderkey, right(lpad((CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 7919 + 202601010000 ELSE o_orderkey END)::VARCHAR, 22, '0'), 10) AS d, (o_orderdate::DATE + INTERVAL 12 MONTH)::DATE - 1 AS period_end FROM orders),
c AS (SELECT *, d || lpad((CASE WHEN d::BIGINT % 97 = 0 THEN 97 ELSE d::BIGINT % 97 END)::VARCHAR, 2, '0') AS x FROM n)
SELECT o_orderkey, '+++' || x[1:3] || '/' || x[4:7] || '/' || x[8:12] || '+++' AS reference, period_end FROM c""",
    "invoice_subscriptions": """
SELECT sub_id, count(*) AS n_invoices, max(k) AS latest FROM (SELECT o_custkey AS sub_id, o_orderkey AS k FROM orders UNION SELECT o_custkey + 1, o_orderkey FROM orders WHERE o_orderkey % 5 = 0) GROUP BY 1""",
    "mail_queue": """
WITH p AS (SELECT c_custkey AS k, c_custkey % 11 > 0 AS mail, ['new', 'new', 'mailed', 'do_not_contact', 'partner'][c_custkey % 5 + 1] AS stage, c_custkey % 13 = 0 AS gone, c_custkey % 500 = 2 AS sent FROM customer),
r AS (SELECT *, CASE WHEN NOT mail THEN 'no address' WHEN stage IN ('do_not_contact', 'partner') THEN 'stage ' || stage WHEN gone THEN 'unsubscribed' WHEN stage <> 'new' THEN 'mailed already, stage ' || stage END AS why FROM p),
q AS (SELECT *, why IS NULL AND sum((why IS NULL)::INTEGER) OVER (ORDER BY k) <= greatest(0, 25 - (SELECT count(*) FROM p WHERE sent)) AS accepted FROM r)
SELECT k AS prospect_id, accepted, CASE WHEN why IS NULL AND NOT accepted THEN 'day''s limit reached' ELSE why END AS reason,
  CASE WHEN accepted THEN (sum(accepted::INTEGER) OVER (ORDER BY k) - 1) * 20 END::BIGINT AS wait_seconds FROM q""",
    "rating_summary": """
SELECT event_type, count(value) AS n, floor(avg(value) * 10 + 0.5) / 10 AS average FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 200 GROUP BY 1""",
    "popularity": """
WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS downloads, count(*) FILTER (WHERE event_type = 'signup') AS favourites, min(ts) AS since FROM events GROUP BY 1)
SELECT user_id, views, downloads, favourites, round(log10(views + 3 * downloads + 5 * favourites + 1) + (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(since)) / 3.6e9 / 48, 6) AS score FROM c""",
    "invoice_page": """
WITH o AS (SELECT * FROM orders WHERE o_orderstatus <> 'F' AND (lower(o_orderpriority) = '1-urgent' OR o_totalprice >= 400000))
SELECT o_orderkey, o_orderdate::DATE AS o_orderdate, o_totalprice, (SELECT count(*) FROM o) AS total FROM o ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25""",
}
