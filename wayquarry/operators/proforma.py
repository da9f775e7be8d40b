"""Proforma invoices to subscriptions: by the lodging's own link, else by name and anniversary, each subscription once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import first_reason
from ..storage import stored
from .match import strong_pairs, weak_pairs

ASSIGNED = "proforma_id long, line_id long, sub_id string, how string, problem string"


def candidates(lines: DataFrame, subs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of lines (proforma_id, line_id, lodging_id, line_name, period_start) and subscriptions (sub_id, sub_name, next_run) with a score.

    links: (lodging_id, sub_id). A linked pair has the score 10; others need a similarity of 0.6, or 0.3 with an equal day of the year.
    """
    linked = lines.join(links, "lodging_id").select("proforma_id", "line_id", "sub_id", F.lit(10.0).alias("total"), F.lit("lodging").alias("how"))
    lines, subs = lines.withColumn("day", F.date_format("period_start", "MM-dd")), subs.withColumn("sub_day", F.date_format("next_run", "MM-dd"))
    strong = lines.join(strong_pairs(lines, subs, "line_name", "sub_name"), "line_name").join(subs, "sub_name")
    weak = lines.join(weak_pairs(lines, subs.withColumn("day", F.col("sub_day")), "line_name", "sub_name", "day"), ["line_name", "day"]).join(subs, "sub_name")
    named = strong.unionByName(weak).withColumn("day", F.coalesce(F.col("day") == F.col("sub_day"), F.lit(False))).where("score >= 0.6 or day")
    return linked.union(named.select("proforma_id", "line_id", "sub_id", F.col("score") + F.when(F.col("day"), 0.3).otherwise(0.0), F.lit("name")))


def choose(rows: pd.DataFrame) -> pd.DataFrame:
    """One proforma's lines in order, each to the best subscription that no line before it has.

    Two that are within 0.2 are a problem, unless the proforma has lines for several lodgings; after a problem the rest stays open.
    """
    used, out = set(), []
    many = rows["lodging_id"].nunique() > 1
    for line_id, own in rows.sort_values("line_id").groupby("line_id"):
        free = own[own["sub_id"].notna() & ~own["sub_id"].isin(used)].sort_values(["total", "sub_id"], ascending=[False, True])
        if not len(free):
            problem = "no subscription"
        elif len(free) > 1 and free["how"].iloc[0] == "name" and free["total"].iloc[0] - free["total"].iloc[1] < 0.2 and not many:
            problem = "ambiguous"
        else:
            best = free.iloc[0]
            used.add(best["sub_id"])
            out.append((rows["proforma_id"].iloc[0], line_id, best["sub_id"], best["how"], None))
            continue
        out.append((rows["proforma_id"].iloc[0], line_id, None, None, problem))
        break
    return pd.DataFrame(out, columns=["proforma_id", "line_id", "sub_id", "how", "problem"])


def assign(lines: DataFrame, subs: DataFrame, links: DataFrame) -> DataFrame:
    """Per line its subscription, or the problem. Equal lines (lodging, name, price) of a proforma count once, the first."""
    once = lines.groupBy("proforma_id", "lodging_id", "line_name", "price").agg(F.min("line_id").alias("line_id"), F.min_by("period_start", "line_id").alias("period_start"))
    once = stored(once, "proforma-lines")
    pairs = candidates(once, subs, links)
    every = once.select("proforma_id", "line_id", "lodging_id").join(pairs, ["proforma_id", "line_id"], "left")
    return every.groupBy("proforma_id").applyInPandas(choose, ASSIGNED)


def judged(proformas: DataFrame, lines: DataFrame, assigned: DataFrame, subs: DataFrame, invoices: DataFrame) -> DataFrame:
    """Per proforma: what becomes of it (outcome) and its period's start.

    proformas: proforma_id, number, period_start; lines: proforma_id, line_id, price; assigned: as from ``assign``;
    subs: sub_id, next_run, last_run; invoices: number, sub_id, period_start, status. Outcomes, the first that
    holds: exists (its number), unmatched (a line without a clear subscription, none at all, or one without a price), no
    period, paid (every subscription ran for this period or a later one), duplicate (an invoice that isn't cancelled is for
    one of them and this period), create.
    """
    own = assigned.join(lines.select("proforma_id", "line_id", "price"), ["proforma_id", "line_id"], "left").join(subs.select("sub_id", "next_run", "last_run"), "sub_id", "left")
    found = own.groupBy("proforma_id").agg(
        F.bool_or(F.col("problem").isNotNull() | F.col("price").isNull()).alias("unclear"), F.min_by("next_run", "line_id").alias("next"), F.min(F.coalesce("last_run", F.lit("0001-01-01").cast("date"))).alias("least_run")
    )
    dated = proformas.join(found, "proforma_id", "left").withColumn("starts", F.coalesce("period_start", "next"))
    numbers = invoices.select("number").distinct().withColumn("_exists", F.lit(True))
    live = invoices.where("status <> 'cancelled'").select("sub_id", F.col("period_start").alias("starts")).distinct()
    twice = own.select("proforma_id", "sub_id").join(dated.select("proforma_id", "starts"), "proforma_id").join(live, ["sub_id", "starts"]).select("proforma_id").distinct().withColumn("_twice", F.lit(True))
    joined = dated.join(numbers, "number", "left").join(twice, "proforma_id", "left")
    outcome = first_reason(
        (F.col("_exists"), "exists"), (F.coalesce("unclear", F.lit(True)), "unmatched"), (F.col("starts").isNull(), "no period"), (F.col("least_run") >= F.col("starts"), "paid"), (F.col("_twice"), "duplicate"),
    )
    return joined.select("proforma_id", F.coalesce(outcome, F.lit("create")).alias("outcome"), F.col("starts").alias("period_start"))
