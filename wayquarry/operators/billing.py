"""Subscriptions and their invoices: overview, new invoices, status changes, renewals.

Subscriptions: sub_id, name, package, status, start_date, first_run, last_run, run_count, price, discount, email.
Invoices: invoice_id, number, sub_id, line_subs (array), status, period_start, total_incl, renewed.
Statuses: draft, sent, paid, cancelled. "Today" is the parameter as_of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import or_default
from ..functions.dates import day_first, period_end
from ..functions.money import next_number, totals
from .rows import places

OPEN = ("draft", "sent")


def invoice_lines(invoices: DataFrame) -> DataFrame:
    """A row for each invoice and subscription that its header or a line names."""
    kind = dict(invoices.dtypes)["sub_id"]
    named = F.array_compact(F.array_union(F.array("sub_id"), F.coalesce("line_subs", F.array().cast(f"array<{kind}>"))))
    return invoices.withColumn("sub_id", F.explode(named))


def overview(subs: DataFrame, invoices: DataFrame, as_of: Column, period_months: int = 12, remind_days: int = 30) -> DataFrame:
    """Per subscription: next run, due, overdue, pending and open invoices, the latest invoice. Order it with nulls last.

    The next run is a period after the last one, else the first one, else the start. Active, paid-for subscriptions
    are due when it is at most remind_days ahead (zero counts as 30) and no open invoice is for a later period.
    """
    months, ahead = period_months or 12, remind_days or 30
    own = invoice_lines(invoices)
    last = subs.select("sub_id", F.coalesce("last_run", F.lit("0001-01-01").cast("date")).alias("since"))
    is_open = F.col("status").isin(*OPEN)
    pending = is_open & (F.col("period_start") > F.col("since"))
    facts = own.join(last, "sub_id").groupBy("sub_id").agg(
        F.count_if(is_open).alias("open_invoices"),
        F.max(F.when(pending, F.col("number"))).alias("pending_number"),
        F.max(F.struct("number", "status", F.coalesce("total_incl", F.lit(0.0)).alias("total"))).alias("latest"),
    )
    joined = subs.join(facts, "sub_id", "left")
    run = F.coalesce(F.add_months("last_run", months), "first_run", "start_date")
    billable = (F.col("status") == "active") & ~F.col("package").eqNullSafe("Free") & F.col("next_run").isNotNull() & F.col("pending_number").isNull()
    return joined.withColumn("next_run", run).select(
        "sub_id", "name", "package", "status", F.coalesce("first_run", "start_date").alias("first_run"), "last_run", "next_run", "price",
        F.coalesce("discount", F.lit(0.0)).alias("discount"),
        F.coalesce("run_count", F.lit(0)).alias("run_count"),
        F.coalesce(billable & (F.col("next_run") <= F.date_add(as_of, ahead)), F.lit(False)).alias("due"),
        F.coalesce(billable & (F.col("next_run") < as_of), F.lit(False)).alias("overdue"),
        "pending_number",
        F.coalesce("open_invoices", F.lit(0)).alias("open_invoices"),
        F.col("latest.number").alias("latest_number"), F.col("latest.status").alias("latest_status"), F.col("latest.total").alias("latest_total"),
    )


def kpis(overview: DataFrame, invoices: DataFrame, as_of: Column) -> DataFrame:
    """One row: subscriptions due, open invoices and their total, overdue ones, and what was paid this year."""
    due = overview.agg(F.count_if("due").alias("n_due"))
    late = (F.col("status") == "sent") & (F.col("due_date") < as_of)
    paid = (F.col("status") == "paid") & (F.year("paid_at") == F.year(as_of))
    money = invoices.agg(
        F.count_if(F.col("status").isin(*OPEN)).alias("n_open"),
        F.coalesce(F.sum(F.when(F.col("status").isin(*OPEN), F.col("total_incl"))), F.lit(0.0)).alias("open_total"),
        F.count_if(late).alias("n_overdue"),
        F.coalesce(F.sum(F.when(paid, F.col("total_incl"))), F.lit(0.0)).alias("paid_this_year"),
    )
    return due.join(F.broadcast(money))  # one row each


def new_invoices(overview: DataFrame, invoices: DataFrame, requests: DataFrame, as_of: Column, vat: float = 21.0, vat_included: bool = False, months: int = 12, term_days: int = 30, first_number: int = 1) -> DataFrame:
    """Per request (sub_id, price, discount, period_start; all but the first may be null): the invoice, or why not (error).

    Invoices of one run are numbered on from the last one, in order of sub_id.
    """
    there = F.broadcast(invoices.agg(F.max("number").alias("last")))  # one row
    asked = requests.withColumnsRenamed({"price": "r_price", "discount": "r_discount", "period_start": "r_start"}).join(overview, "sub_id", "left")
    start = F.coalesce("r_start", "next_run", as_of)
    taken = invoices.where("status <> 'cancelled'").groupBy("sub_id", "period_start").agg(F.max("number").alias("taken_by"))
    own = asked.withColumns({"period_start": start, "price": F.coalesce("r_price", "price"), "discount": F.coalesce("r_discount", "discount", F.lit(0.0))})
    own = own.join(taken, ["sub_id", "period_start"], "left")
    error = F.when(F.col("name").isNull(), "unknown subscription").when(F.col("price").isNull(), "no price").when(F.col("taken_by").isNotNull(), F.concat(F.lit("invoice "), F.col("taken_by").cast("string"), F.lit(" is for this period")))
    placed = places(own.withColumn("error", error).withColumn("_good", F.col("error").isNull()), ["_good"], ["sub_id", "period_start"])
    money = totals("price", "discount", F.lit(vat), vat_included)
    end = period_end("period_start", months)
    text = F.concat(F.lit("Package "), F.coalesce("package", F.lit("")), F.lit(" ("), day_first("period_start"), F.lit(" - "), day_first(end), F.lit(")"))
    ok = lambda c: F.when(F.col("error").isNull(), c)
    return placed.join(there).select(
        "sub_id", "error", ok(next_number(F.col("last"), F.lit(first_number), as_of) + F.col("place") - 1).alias("number"), ok(F.lit("draft")).alias("status"),
        ok(as_of).alias("invoice_date"), ok(F.date_add(as_of, term_days or 30)).alias("due_date"), ok(F.col("period_start")).alias("period_start"), ok(end).alias("period_end"),
        ok(text).alias("description"), ok(money["excl"]).alias("total_excl"), ok(money["vat"]).alias("total_vat"), ok(money["incl"]).alias("total_incl"),
    )


def transitions(invoices: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Invoices after status changes (invoice_id, new_status, paid_at), with what their subscriptions need: renewal renew, undo or null."""
    joined = invoices.join(changes.select("invoice_id", "new_status", F.col("paid_at").alias("new_paid_at")), "invoice_id", "left")
    to, renewed = F.col("new_status"), F.coalesce("renewed", F.lit(False))
    renewal = F.when((to == "paid") & ~renewed, "renew").when(to.isin("cancelled", *OPEN) & renewed, "undo")
    paid = F.when(to == "paid", F.coalesce("new_paid_at", as_of)).when(to.isin(*OPEN), F.lit(None).cast("date")).otherwise(F.col("paid_at"))
    after = F.when(to == "paid", F.lit(True)).when(to.isin("cancelled", *OPEN), F.lit(False)).otherwise(renewed)
    line = F.when(to == "paid", F.concat(F.lit("paid on "), day_first(F.coalesce("new_paid_at", as_of)))).when(to == "cancelled", "cancelled").when(to.isin(*OPEN), F.concat(F.lit("back to "), to))
    history = F.nullif(F.concat_ws("\n", F.nullif(F.col("history"), F.lit("")), line), F.lit(""))
    new = {"renewal": renewal, "paid_at": paid, "history": history}
    return joined.withColumns(new).withColumns({"status": F.coalesce(to, "status"), "renewed": after}).drop("new_status", "new_paid_at")


def renewed(subs: DataFrame, invoices: DataFrame) -> DataFrame:
    """Subscriptions after the paid invoices: last_run never goes back, the count grows, and what was before is kept (before)."""
    own = invoice_lines(invoices).groupBy("sub_id").agg(F.max("period_start").alias("p_start"), F.min("period_start").alias("p_first"), F.count(F.lit(1)).alias("n"), F.max("number").alias("p_number"))
    joined = subs.join(own, "sub_id", "left")
    hit = F.col("n").isNotNull()
    return joined.select(
        *[c for c in subs.columns if c not in ("first_run", "last_run", "run_count", "last_invoice")],
        F.when(hit, F.struct("first_run", "last_run", "run_count", "last_invoice")).alias("before"),
        F.when(hit, F.coalesce("first_run", "p_first")).otherwise(F.col("first_run")).alias("first_run"),
        F.when(hit, F.greatest("last_run", "p_start")).otherwise(F.col("last_run")).alias("last_run"),
        (F.coalesce("run_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("run_count"),
        F.when(hit, F.col("p_number").cast("string")).otherwise(F.col("last_invoice")).alias("last_invoice"),
    )


def undone(subs: DataFrame, invoices: DataFrame, cancelled: DataFrame, months: int = 12) -> DataFrame:
    """Subscriptions after renewals were taken back (cancelled: invoices with ``before``, a null where it wasn't kept).

    With it, as it was. Else the count falls, and where the last run was this invoice's, it becomes that of the
    latest other renewing invoice, or a period earlier, or null after the only run.
    """
    gone = invoice_lines(cancelled).select("sub_id", "invoice_id", F.col("period_start").alias("c_start"), F.col("before").alias("c_before"), F.col("number").cast("string").alias("c_number"))
    others = invoices.where("renewed and status <> 'cancelled'").join(gone.select("invoice_id"), "invoice_id", "left_anti")
    previous = others.groupBy("sub_id").agg(F.max(F.struct("period_start", "number")).alias("prev"))
    joined = subs.join(gone, "sub_id", "left").join(previous, "sub_id", "left")
    hit, kept = F.col("c_number").isNotNull(), F.col("c_before").isNotNull()
    count = F.greatest(F.lit(0), F.coalesce("run_count", F.lit(1)) - 1)
    moved = F.col("last_run").eqNullSafe(F.col("c_start"))
    back = F.coalesce("prev.period_start", F.when(count > 0, F.add_months("last_run", -months)))
    number = F.coalesce(F.col("prev.number").cast("string"), F.when(F.col("last_invoice") != F.col("c_number"), F.col("last_invoice")))
    pick = lambda name, otherwise: F.when(hit & kept, F.col(f"c_before.{name}")).when(hit, otherwise).otherwise(F.col(name)).alias(name)
    return joined.select(
        *[c for c in subs.columns if c not in ("first_run", "last_run", "run_count", "last_invoice")],
        pick("first_run", F.col("first_run")), pick("last_run", F.when(moved, back).otherwise(F.col("last_run"))),
        pick("run_count", count), pick("last_invoice", F.when(moved, number).otherwise(F.col("last_invoice"))),
    )


def switched(subs: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Subscriptions put on (no end date) or off (ended yesterday); changes: sub_id, online."""
    joined = subs.join(changes, "sub_id", "left")
    status = F.when(F.col("online"), "active").when(~F.col("online"), "ended").otherwise(F.col("status"))
    end = F.when(F.col("online"), F.lit(None).cast("date")).when(~F.col("online"), F.date_sub(as_of, 1)).otherwise(F.col("end_date"))
    return joined.withColumns({"status": status, "end_date": end}).drop("online")


def document_totals(lines: DataFrame, by: str) -> DataFrame:
    """Per document: its lines' totals and its VAT rate (null where lines differ). lines: price, discount, vat."""
    money = totals("price", "discount", "vat", False)
    return lines.withColumn("m", money).groupBy(by).agg(
        F.round(F.sum("price"), 2).alias("price"), F.round(F.sum("m.excl"), 2).alias("total_excl"), F.round(F.sum("m.vat"), 2).alias("total_vat"), F.round(F.sum("m.incl"), 2).alias("total_incl"),
        F.when(F.min("vat") == F.max("vat"), F.min("vat")).alias("vat_rate"), F.count(F.lit(1)).alias("n_lines"),
    )


def remind_days(settings: Column) -> Column:
    return or_default(settings, 30)


def letters(invoices: DataFrame, pages: DataFrame, template: str) -> DataFrame:
    """Per invoice (invoice_id, sub_id, name, number, total_incl, due_date): the text of its letter.

    pages: sub_id, locale, published, url; a published page in Dutch is linked, else any published one, else any in
    Dutch, else any. The template's names: name, number, amount, due, reference, page.
    """
    from ..functions.money import euro, structured_reference
    from ..functions.text import filled
    from .rows import winners

    order = [F.desc(F.col("published") & (F.col("locale") == "nl")), F.desc("published"), F.desc(F.col("locale") == "nl"), F.asc("url")]
    link = winners(pages, ["sub_id"], order).select("sub_id", "url")
    joined = invoices.join(link, "sub_id", "left")
    values = {"name": F.col("name"), "number": F.col("number"), "amount": euro("total_incl"), "due": day_first("due_date"), "reference": structured_reference("number"), "page": F.col("url")}
    return joined.select("invoice_id", filled(F.lit(template), values).alias("text"))


def measured_share(routes: DataFrame, shares: DataFrame) -> DataFrame:
    """routes with the surface share of their own file (route_id, gpx_id, percent), only where they have none or zero."""
    joined = routes.join(shares.select("route_id", "gpx_id", "percent"), ["route_id", "gpx_id"], "left")
    empty = F.col("surface_percent").isNull() | (F.col("surface_percent") == 0)
    return joined.withColumn("surface_percent", F.when(empty & F.col("percent").isNotNull(), F.col("percent")).otherwise(F.col("surface_percent"))).drop("percent")
