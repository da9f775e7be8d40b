"""Updates that people cause: subscriptions taken back or switched, letters, mails, reviews, newsletters, profiles, deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import billing as b
from ..operators import crm, imports, rows, sync
from ..operators.tracks import autofilled
from ..sources.files import table
from .billing import AS_OF, SUBS_SQL, as_of, invoices, prospects, subscriptions

NOW = f"{AS_OF} 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def undone_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Subscriptions of even customers after their latest paid invoice was cancelled; every fourth kept what was before."""
    inv = invoices(spark, sf).withColumn("line_subs", F.lit(None).cast("array<bigint>"))
    subs = subscriptions(spark, sf).withColumn("last_invoice", F.when(F.col("sub_id") % 3 > 0, F.lit("9")))
    gone = rows.reduced(inv.where("status = 'paid' and sub_id % 2 = 0"), ["sub_id"], F.col("number"), last=True)
    before = F.when(F.col("sub_id") % 4 == 0, F.struct(F.lit("1996-01-01").cast("date").alias("first_run"), F.lit("1997-01-01").cast("date").alias("last_run"), F.lit(2).alias("run_count"), F.lit("5").alias("last_invoice")))
    done = b.undone(subs, inv, gone.withColumn("before", before))
    return done.select("sub_id", "first_run", "last_run", F.col("run_count").cast("long").alias("run_count"), "last_invoice")


def switched_subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Subscriptions after every third was put on and every fifth off."""
    subs = subscriptions(spark, sf).withColumn("end_date", F.col("last_run"))
    changes = subs.select("sub_id", F.when(F.col("sub_id") % 3 == 0, True).when(F.col("sub_id") % 5 == 0, False).alias("online")).where("online is not null")
    return b.switched(subs, changes, as_of()).select("sub_id", "status", "end_date")


def letters(spark: SparkSession, sf: str) -> DataFrame:
    """The letter of each invoice that was sent, with the page of its customer."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    pages = c.select(k.alias("sub_id"), F.explode(F.array(F.struct(F.lit("nl").alias("locale"), (k % 3 == 0).alias("published")), F.struct(F.lit("fr").alias("locale"), (k % 2 == 0).alias("published")))).alias("p")).select("sub_id", "p.*")
    pages = pages.where("sub_id % 7 > 0").withColumn("url", F.concat(F.lit("/"), "locale", F.lit("/"), "sub_id"))
    sent = invoices(spark, sf).where("status = 'sent'").join(c.select(k.alias("sub_id"), F.col("c_name").alias("name")), "sub_id").withColumn("total_incl", F.floor("total_incl"))
    return b.letters(sent, pages, "Dear {name}, {number} ({reference}): {amount} by {due}. {page} {unknown}")


def stage_history(spark: SparkSession, sf: str) -> DataFrame:
    """Prospects' histories after a change of stage."""
    p = prospects(spark, sf).withColumns({"old_stage": F.when(F.col("prospect_id") % 6 > 0, "new"), "history": F.when(F.col("prospect_id") % 4 == 0, "2000-01-01 - > new").when(F.col("prospect_id") % 4 == 1, "")})
    return crm.stage_history(p, now()).select("prospect_id", "history")


def mailed_prospects(spark: SparkSession, sf: str) -> DataFrame:
    """Prospects after every tenth got a second mail."""
    p = prospects(spark, sf).withColumns({"mail_count": F.when(F.col("prospect_id") % 2 == 0, (F.col("prospect_id") % 5).cast("int")), "follow_up_on": F.lit(None).cast("date")})
    done = crm.mailed(p, p.where("prospect_id % 10 = 1").select("prospect_id"), "followup", now())
    return done.select("prospect_id", "stage", F.col("last_mailed_at").cast("date").alias("mailed_on"), F.col("mail_count").cast("long").alias("mail_count"), "follow_up_on")


def mail_batch(spark: SparkSession, sf: str) -> DataFrame:
    """First mails for a batch with repeated prospects; 25 of a batch and a day are the operation's own limits."""
    batch = table(spark, sf, "orders").select(F.col("o_custkey").alias("prospect_id"))
    return crm.mail_queue(prospects(spark, sf), "first", now(), per_day=7, batch=batch).select("prospect_id", "accepted", "reason")


def route_autofill(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as routes: texts are filled where blank, measures always, from what tracks say."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    measures = lambda x: {c: x.cast("double") for c in ("distance_km", "minutes", "gain", "loss")}
    routes = p.select(k.alias("route_id"), F.when(k % 3 == 0, F.lit(" ")).when(k % 3 == 1, F.col("p_name")).alias("title"), F.lit(None).cast("string").alias("description")).withColumns(measures(F.lit(1)))
    parsed = p.where("p_partkey % 4 > 0").select(k.alias("route_id"), F.col("p_brand").alias("title"), F.when(k % 5 > 0, F.col("p_type")).alias("description"), "p_size").withColumns(measures(F.when(F.col("p_size") > 9, F.col("p_size")))).drop("p_size")
    return autofilled(routes, parsed).select("route_id", "title", "description", "distance_km", "loss")


def surface_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as routes whose share is measured by their own file only, where they have none."""
    o = table(spark, sf, "orders")
    routes = o.select(F.col("o_orderkey").alias("route_id"), (F.col("o_orderkey") % 5).alias("gpx_id"), F.when(F.col("o_orderkey") % 3 == 0, 0.0).when(F.col("o_orderkey") % 3 == 1, F.col("o_totalprice")).alias("surface_percent"))
    shares = o.where("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("route_id"), (F.col("o_orderkey") % 4).alias("gpx_id"), F.lit(40.0).alias("percent"))
    return b.measured_share(routes, shares).select("route_id", "surface_percent")


def submitted_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Events as new reviews: which may be stored, and why the others may not."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    active = e.where("event_type = 'view'").select("user_id", (i % 50).alias("target_id"), F.when(i % 2 == 0, "approved").otherwise("rejected").alias("review_status"))
    written = F.when(i % 6 == 0, F.lit("1-1-2001")).when(i % 6 == 1, F.lit("2001-06-16")).when(i % 6 == 2, F.lit("2001-06-17")).when(i % 6 == 3, F.lit("2001-02-30"))
    new = e.select("event_id", F.when(i % 9 > 0, F.col("user_id")).alias("user_id"), (i % 50).alias("target_id"), F.when(i % 8 == 0, 3.5).otherwise((i % 7).cast("double")).alias("rating"), F.when(i % 5 == 0, " too short ").otherwise("a long enough text").alias("text"), written.alias("visited_on"))
    return crm.submitted(active, new, now()).select("event_id", "error", "review_status")


def newsletter_states(spark: SparkSession, sf: str) -> DataFrame:
    """Newsletter subscriptions of customers after one event for each."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").withColumn("email", F.lower(F.concat("c_name", F.lit("@x.be"))))
    subs = c.where("c_custkey % 5 > 0").select("email", F.when(k % 3 == 0, "subscribed").when(k % 3 == 1, "pending").otherwise("unsubscribed").alias("status"), F.sha2((k % 4).cast("string"), 256).alias("token_hash"),
                                               F.when(k % 2 == 0, F.lit("2001-06-16 00:00:00").cast("timestamp")).otherwise(F.lit("2001-06-14 00:00:00").cast("timestamp")).alias("expires_at"))
    events = c.where("c_custkey % 7 > 0").select(F.concat(F.lit(" "), "c_name", F.lit("@X.be")).alias("email"), F.when(k % 4 < 2, "confirm").when(k % 4 == 2, "subscribe").otherwise("unsubscribe").alias("event"), (k % 8).cast("string").alias("token"))
    done = crm.newsletter(subs, events, now())
    return done.select("email", "status", "token_hash", F.col("expires_at").cast("date").alias("expires_on"), "outcome")


def edited_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of users after edits; some users are new, and what an edit leaves out stays."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    profiles = c.where("c_custkey % 4 > 0").select(k.alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"), F.col("c_acctbal").alias("points"))
    edits = c.where("c_custkey % 3 = 0 or c_custkey % 4 = 0").select(k.alias("user_id"), F.when(k % 2 == 0, F.concat(F.lit("new "), "c_name")).alias("name"), F.lit("Gent").alias("city"))
    return crm.profiles_upserted(profiles, edits)


def deleted_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Events that are left after users with a fresh, right token were deleted, by user or address."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    asked = c.select(k.alias("user_id"), F.concat(F.lit("m"), k % 40).alias("email"), F.when(k % 2 == 0, F.lit("2001-06-14 12:00:00").cast("timestamp")).otherwise(F.lit("2001-06-14 11:59:59").cast("timestamp")).alias("sent_at"), F.sha2((k % 3).cast("string"), 256).alias("token_hash"), F.when(k % 5 == 0, "1").otherwise("7").alias("given"))
    e = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("m"), F.col("event_id") % 60)).alias("email"))
    return crm.without_users(e, crm.deletions(asked, now())).select("event_id")


def edited_partners(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' edits of their own page: errors, what changed, and whether it is published."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    gallery = lambda *x: F.array(*[F.lit(v).cast("bigint") if isinstance(v, int) else v for v in x])
    before = s.select(k.alias("partner"), F.col("s_name").alias("name"), (k * 10).alias("cover"), gallery(k * 10 + 1, k * 10 + 2).alias("gallery"))
    edits = s.select(k.alias("partner"), F.when(k % 3 == 0, "new").otherwise(F.col("s_name")).alias("name"), F.when(k % 4 == 1, k * 10 + 5).when(k % 4 == 2, F.lit(None)).otherwise(k * 10).alias("cover"), F.when(k % 5 == 0, gallery(k * 10 + 2, k * 10 + 2, k * 10 + 3)).otherwise(gallery(k * 10 + 1, k * 10 + 2)).alias("gallery"))
    files = s.where("s_suppkey % 2 = 0").select((k * 10 + 3).alias("file_id"), k.alias("partner")).union(s.where("s_suppkey % 8 = 1").select(k * 10 + 5, k))
    done = crm.partner_edits(before, edits, files, s.where("s_suppkey % 6 > 0").select(k.alias("partner")), "partner", ["name"], ["cover"])
    return done.select("partner", "error", F.array_join("changed", ",").alias("changed"), "publish", "name", "cover", F.array_join("gallery", ",").alias("gallery"))


def unsubscribed_prospects(spark: SparkSession, sf: str) -> DataFrame:
    """Prospects after links with their tokens were followed."""
    p = prospects(spark, sf).withColumn("token", F.concat(F.lit("token-"), F.lpad(F.col("prospect_id").cast("string"), 6, "0").substr(1, 6)))
    tokens = p.where("prospect_id % 3 = 0").select(F.when(F.col("prospect_id") % 2 == 0, F.col("token")).otherwise(F.substring("token", 1, 9)).alias("token"))
    done = crm.unsubscribed(p, tokens.union(tokens), now())
    return done.select("prospect_id", "stage", F.col("unsubscribed_at").cast("date").alias("unsubscribed_on"))


def seeded_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Stored settings with the defaults that were missing or blank, and permissions that were missing."""
    stored = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "").when(F.col("n_nationkey") % 3 == 1, F.col("n_name")).alias("value"))
    wanted = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("seed").alias("value"))
    from ..functions.coerce import fill_defaults

    return fill_defaults(sync.inserted_if_absent(stored, wanted.union(stored.where("false")), ["name"]), {"value": "default", "days": 30})


def written_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates as they are written in notes and fields, read again."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    note = F.when(k % 4 > 0, F.concat(F.lit("Period "), F.date_format(day, "dd-MM-yyyy"), F.lit(" to "), F.date_format(F.add_months(day, 12), "dd-MM-yyyy")))
    field = F.when(k % 5 == 0, F.date_format(day, "yyyy-MM-dd HH:mm")).when(k % 5 == 1, F.date_format(day, "yyyy-00-dd")).when(k % 5 == 2, F.lit("2001-02-31")).when(k % 5 == 3, F.lit("0000-00-00")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return o.select("o_orderkey", dates.period_start(note).alias("starts"), F.get(dates.periods_in(note), F.lit(1)).alias("ends"), dates.cleaned(field).alias("cleaned"), dates.cleaned_date(field).alias("cleaned_date"))


def prospect_import(spark: SparkSession, sf: str) -> DataFrame:
    """Prospects after an import: what people have entered stays."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    stored = c.where("c_custkey % 3 > 0").select(k.cast("string").alias("source_id"), F.col("c_name").alias("name"), F.lit("old@x.be").alias("email"), F.when(k % 2 == 0, "partner").otherwise("new").alias("stage"), (k % 4).alias("mail_count"))
    new = imports.prospects(c.where("c_custkey % 2 = 0 or c_custkey % 3 = 0").select(F.concat(F.lit(" "), "c_name", F.lit("  BV")).alias("n"), F.when(k % 5 > 0, F.concat(F.lit("A"), k, F.lit("@X.be"))).otherwise("no address").alias("e"), k.cast("string").alias("i"), F.lit("51,5").alias("la")))
    done = imports.prospects_upserted(stored, new)
    return done.select("source_id", "name", "email", "stage", "mail_count", "lat")


def search_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose name and segment hold a word, with how they are shown."""
    c = rows.search(table(spark, sf, "customer"), ["c_name", "c_mktsegment"], " Mach ")
    initial = text.display_name(F.initcap("c_mktsegment"), F.col("c_name"), F.lit(None).cast("string"), "Guest")
    return c.select("c_custkey", initial.alias("shown"))


QUERIES = {f.__name__: f for f in (
    undone_runs, switched_subscriptions, letters, stage_history, mailed_prospects, mail_batch, route_autofill, surface_shares, submitted_reviews, newsletter_states, edited_profiles,
    deleted_accounts, edited_partners, unsubscribed_prospects, seeded_settings, written_dates, prospect_import, search_invoices,
)}

PROSPECTS_SQL = """p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 > 0 THEN c_name || '@example.com' END AS email, ['new', 'new', 'mailed', 'do_not_contact', 'partner'][c_custkey % 5 + 1] AS stage,
  CASE WHEN c_custkey % 13 = 0 THEN DATE '2001-01-01' END AS gone_on, c_custkey % 500 = 2 AS sent FROM customer)"""

ORACLE_SQL = {
    "undone_runs": f"""
WITH {SUBS_SQL}, s AS (SELECT *, CASE WHEN sub_id % 3 > 0 THEN '9' END AS last_invoice FROM subs), paid AS (SELECT o_custkey AS sub_id, number, period_start FROM inv WHERE status = 'paid'),
gone AS (SELECT sub_id, max(number) AS number, arg_max(period_start, number) AS c_start FROM paid WHERE sub_id % 2 = 0 GROUP BY 1),
prev AS (SELECT sub_id, max({{'d': period_start, 'n': number}}) AS prev FROM paid WHERE number NOT IN (SELECT number FROM gone) GROUP BY 1),
j AS (SELECT s.*, g.number AS c_number, c_start, prev, greatest(0, coalesce(run_count, 1) - 1) AS less FROM s LEFT JOIN gone g ON g.sub_id = s.sub_id LEFT JOIN prev p ON p.sub_id = s.sub_id)
SELECT sub_id, CASE WHEN c_number IS NOT NULL AND sub_id % 4 = 0 THEN DATE '1996-01-01' ELSE first_run END AS first_run,
  CASE WHEN c_number IS NULL OR (sub_id % 4 > 0 AND last_run IS DISTINCT FROM c_start) THEN last_run WHEN sub_id % 4 = 0 THEN DATE '1997-01-01' ELSE coalesce(prev.d, CASE WHEN less > 0 THEN (last_run - INTERVAL 12 MONTH)::DATE END) END AS last_run,
  (CASE WHEN c_number IS NULL THEN run_count WHEN sub_id % 4 = 0 THEN 2 ELSE less END)::BIGINT AS run_count,
  CASE WHEN c_number IS NULL THEN last_invoice WHEN sub_id % 4 = 0 THEN '5' WHEN last_run IS DISTINCT FROM c_start THEN last_invoice ELSE coalesce(prev.n::VARCHAR, CASE WHEN last_invoice <> c_number::VARCHAR THEN last_invoice END) END AS last_invoice FROM j""",
    "switched_subscriptions": f"""
WITH {SUBS_SQL} SELECT sub_id, CASE WHEN sub_id % 3 = 0 THEN 'active' WHEN sub_id % 5 = 0 THEN 'ended' ELSE status END AS status, CASE WHEN sub_id % 3 = 0 THEN NULL WHEN sub_id % 5 = 0 THEN DATE '{AS_OF}' - 1 ELSE last_run END AS end_date FROM subs""",
    "letters": """
WITH i AS (SELECT o_orderkey AS k, o_custkey AS c, floor(o_totalprice) AS total, o_orderdate::DATE + 30 AS due, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O'),
r AS (SELECT *, right(lpad(k::VARCHAR, 20, '0'), 10) AS d FROM i), x AS (SELECT *, d || lpad((CASE WHEN d::BIGINT % 97 = 0 THEN 97 ELSE d::BIGINT % 97 END)::VARCHAR, 2, '0') AS y FROM r)
SELECT k AS invoice_id, 'Dear ' || c_name || ', ' || k || ' (+++' || y[1:3] || '/' || y[4:7] || '/' || y[8:12] || '+++): € ' || replace(replace(replace(format('{:,.2f}', total), ',', '_'), '.', ','), '_', '.') || ' by ' || strftime(due, '%d/%m/%Y') || '. '
  || CASE WHEN c % 7 = 0 THEN '' WHEN c % 3 = 0 THEN '/nl/' || c WHEN c % 2 = 0 THEN '/fr/' || c ELSE '/nl/' || c END || ' {unknown}' AS text FROM x""",
    "stage_history": f"""
WITH {PROSPECTS_SQL}, h AS (SELECT *, CASE WHEN k % 6 > 0 THEN 'new' END AS old, CASE k % 4 WHEN 0 THEN '2000-01-01 - > new' WHEN 1 THEN '' END AS was FROM p)
SELECT k AS prospect_id, CASE WHEN old IS DISTINCT FROM stage THEN concat_ws(chr(10), nullif(was, ''), '{AS_OF} ' || coalesce(old, '-') || ' > ' || stage) ELSE was END AS history FROM h""",
    "mailed_prospects": f"""
WITH {PROSPECTS_SQL} SELECT k AS prospect_id, CASE WHEN k % 10 = 1 THEN 'followed_up' ELSE stage END AS stage, CASE WHEN k % 10 = 1 OR sent THEN DATE '{AS_OF}' END AS mailed_on,
  coalesce(CASE WHEN k % 2 = 0 THEN k % 5 END, 0) + (k % 10 = 1)::BIGINT AS mail_count, CASE WHEN k % 10 = 1 THEN DATE '{AS_OF}' + 10 END AS follow_up_on FROM p""",
    "mail_batch": f"""
WITH {PROSPECTS_SQL}, c AS (SELECT * FROM p WHERE k IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 25)),
r AS (SELECT *, CASE WHEN email IS NULL THEN 'no address' WHEN stage IN ('do_not_contact', 'partner') THEN 'stage ' || stage WHEN gone_on IS NOT NULL THEN 'unsubscribed' WHEN stage <> 'new' THEN 'mailed already, stage ' || stage END AS why FROM c),
q AS (SELECT *, why IS NULL AND sum((why IS NULL)::INTEGER) OVER (ORDER BY k) <= 7 - (SELECT count(*) FROM p WHERE sent) AS accepted FROM r)
SELECT k AS prospect_id, accepted, CASE WHEN why IS NULL AND NOT accepted THEN 'day''s limit reached' ELSE why END AS reason FROM q""",
    "route_autofill": """
SELECT p_partkey AS route_id, CASE WHEN p_partkey % 3 = 1 THEN p_name WHEN p_partkey % 4 > 0 THEN p_brand WHEN p_partkey % 3 = 0 THEN ' ' END AS title, CASE WHEN p_partkey % 4 > 0 AND p_partkey % 5 > 0 THEN p_type END AS description,
  CASE WHEN p_partkey % 4 = 0 THEN 1 WHEN p_size > 9 THEN p_size END::DOUBLE AS distance_km, CASE WHEN p_partkey % 4 = 0 THEN 1 WHEN p_size > 9 THEN p_size END::DOUBLE AS loss FROM part""",
    "surface_shares": """
SELECT o_orderkey AS route_id, CASE WHEN o_orderkey % 3 = 1 AND o_totalprice <> 0 THEN o_totalprice WHEN o_orderkey % 7 > 0 AND o_orderkey % 5 = o_orderkey % 4 THEN 40.0::DOUBLE WHEN o_orderkey % 3 = 0 THEN 0.0::DOUBLE END AS surface_percent FROM orders""",
    "submitted_reviews": """
WITH a AS (SELECT DISTINCT user_id, event_id % 50 AS t FROM events WHERE event_type = 'view' AND event_id % 2 = 0),
n AS (SELECT event_id AS i, CASE WHEN event_id % 9 > 0 THEN user_id END AS u, event_id % 50 AS t, CASE WHEN event_id % 8 = 0 THEN 3.5 ELSE event_id % 7 END AS rating FROM events),
j AS (SELECT n.*, EXISTS (SELECT 1 FROM a WHERE a.user_id = n.u AND a.t = n.t) AS has FROM n),
e AS (SELECT i, CASE WHEN u IS NULL THEN 'not signed in' WHEN NOT (rating BETWEEN 1 AND 5 AND rating = floor(rating)) THEN 'rating must be 1 to 5' WHEN i % 5 = 0 THEN 'text too short' WHEN i % 6 IN (0, 2, 3) THEN 'no valid date' WHEN has THEN 'reviewed already' END AS error FROM j)
SELECT i AS event_id, error, CASE WHEN error IS NULL THEN 'pending' END AS review_status FROM e""",
    "newsletter_states": f"""
WITH c AS (SELECT c_custkey AS k, lower(c_name) || '@x.be' AS email FROM customer),
s AS (SELECT *, CASE WHEN k % 5 > 0 THEN CASE k % 3 WHEN 0 THEN 'subscribed' WHEN 1 THEN 'pending' ELSE 'unsubscribed' END END AS status, CASE WHEN k % 5 > 0 THEN sha256((k % 4)::VARCHAR) END AS token, CASE WHEN k % 5 > 0 THEN CASE WHEN k % 2 = 0 THEN TIMESTAMP '2001-06-16' ELSE TIMESTAMP '2001-06-14' END END AS expires,
  CASE WHEN k % 7 > 0 THEN CASE WHEN k % 4 < 2 THEN 'confirm' WHEN k % 4 = 2 THEN 'subscribe' ELSE 'unsubscribe' END END AS event, sha256((k % 8)::VARCHAR) AS sent FROM c),
d AS (SELECT *, coalesce(event = 'subscribe' AND status IS DISTINCT FROM 'subscribed', false) AS starts, coalesce(event = 'confirm' AND token = sent AND expires >= TIMESTAMP '{NOW}', false) AS confirms, coalesce(event = 'unsubscribe' AND status IS NOT NULL, false) AS leaves FROM s),
f AS (SELECT email, CASE WHEN starts THEN 'pending' WHEN confirms THEN 'subscribed' WHEN leaves THEN 'unsubscribed' ELSE status END AS status, CASE WHEN starts THEN sent WHEN NOT (confirms OR leaves) THEN token END AS token_hash,
  CASE WHEN starts THEN DATE '{AS_OF}' + 1 WHEN NOT (confirms OR leaves) THEN expires::DATE END AS expires_on, CASE WHEN event = 'confirm' THEN CASE WHEN confirms THEN 'ok' WHEN token <> sent THEN 'invalid' ELSE 'expired' END WHEN starts OR leaves THEN 'ok' END AS outcome FROM d)
SELECT * FROM f WHERE status IS NOT NULL""",
    "edited_profiles": """
WITH c AS (SELECT *, c_custkey % 3 = 0 OR c_custkey % 4 = 0 AS edited FROM customer)
SELECT c_custkey AS user_id, CASE WHEN edited AND c_custkey % 2 = 0 THEN 'new ' || c_name WHEN c_custkey % 4 > 0 THEN c_name END AS name, CASE WHEN edited THEN 'Gent' ELSE c_mktsegment END AS city, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS points
FROM c""",
    "deleted_accounts": """
WITH gone AS (SELECT c_custkey AS u, c_custkey % 40 AS m FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 = 0 AND c_custkey % 3 = 1)
SELECT event_id FROM events WHERE (user_id IS NULL OR user_id NOT IN (SELECT u FROM gone)) AND (event_id % 3 = 0 OR event_id % 60 NOT IN (SELECT m FROM gone))""",
    "edited_partners": """
WITH e AS (SELECT s_suppkey AS k, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS name, CASE s_suppkey % 4 WHEN 1 THEN s_suppkey * 10 + 5 WHEN 2 THEN NULL ELSE s_suppkey * 10 END AS cover,
  CASE WHEN s_suppkey % 5 = 0 THEN [s_suppkey * 10 + 2, s_suppkey * 10 + 3] ELSE [s_suppkey * 10 + 1, s_suppkey * 10 + 2] END AS gallery FROM supplier),
j AS (SELECT *, CASE WHEN (k % 4 = 1 AND k % 8 <> 1) OR (k % 5 = 0 AND k % 2 <> 0) THEN 'images of others' END AS error, concat_ws(',', CASE WHEN k % 3 = 0 AND s_name <> 'new' THEN 'name' END, CASE WHEN k % 4 IN (1, 2) THEN 'cover' END, CASE WHEN k % 5 = 0 THEN 'gallery' END) AS differs FROM e)
SELECT k AS partner, error, CASE WHEN error IS NULL THEN differs ELSE '' END AS changed, error IS NULL AND differs <> '' AND k % 6 > 0 AS publish, CASE WHEN error IS NULL THEN name ELSE s_name END AS name,
  CASE WHEN error IS NULL THEN cover ELSE k * 10 END AS cover, array_to_string(CASE WHEN error IS NULL THEN gallery ELSE [k * 10 + 1, k * 10 + 2] END, ',') AS gallery FROM j""",
    "unsubscribed_prospects": f"""
WITH {PROSPECTS_SQL}, h AS (SELECT *, k % 6 = 0 AND stage <> 'do_not_contact' AS hit FROM p)
SELECT k AS prospect_id, CASE WHEN hit THEN 'do_not_contact' ELSE stage END AS stage, CASE WHEN hit THEN DATE '{AS_OF}' ELSE gone_on END AS unsubscribed_on FROM h""",
    "seeded_settings": """
SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 1 THEN n_name ELSE 'default' END AS value, 30 AS days FROM nation
UNION ALL SELECT r_name, 'seed', 30 FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)""",
    "written_dates": """
WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 4 > 0 THEN d END AS starts, CASE WHEN k % 4 > 0 THEN (d + INTERVAL 12 MONTH)::DATE END AS ends,
  CASE k % 5 WHEN 0 THEN strftime(d, '%Y-%m-%d 00:00') WHEN 2 THEN '2001-02-31' END AS cleaned, CASE WHEN k % 5 = 0 THEN d END AS cleaned_date FROM o""",
    "prospect_import": """
WITH c AS (SELECT *, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS given FROM customer)
SELECT c_custkey::VARCHAR AS source_id, CASE WHEN given THEN c_name || ' BV' ELSE c_name END AS name, CASE WHEN NOT given THEN 'old@x.be' WHEN c_custkey % 5 > 0 THEN 'a' || c_custkey || '@x.be' END AS email,
  CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'partner' ELSE 'new' END END AS stage, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 4 END AS mail_count, CASE WHEN given THEN 51.5::DOUBLE END AS lat
FROM c""",
    "search_invoices": """
SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(c_mktsegment[2:]) || ' ' || upper(left(c_name, 1)) || '.' AS shown FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'mach')""",
}
