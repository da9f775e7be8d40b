"""Prospects, reviews, newsletters and accounts: decisions as frames. Nothing is sent or deleted here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import first_reason, js_round
from ..functions.dates import fresh, visited_on

#: Stages of prospects who get no mail.
CLOSED = ("do_not_contact", "not_interested", "partner")
PER_DAY, PER_BATCH, PAUSE_SECONDS = 25, 25, 20
#: Images of a partner's gallery.
MOST_IMAGES = 30


def skip_reason(kind: str) -> Column:
    """Why a prospect may not get this mail (first or followup); null if it may."""
    rules = [
        (F.coalesce("email", F.lit("")) == "", "no address"),
        (F.col("stage").isin(*CLOSED), F.concat(F.lit("stage "), F.col("stage"))),
        (F.col("unsubscribed_at").isNotNull(), "unsubscribed"),
        (F.col("stage") != ("new" if kind == "first" else "mailed"), F.concat(F.lit("mailed already, stage " if kind == "first" else "not mailed yet, stage "), F.col("stage"))),
    ]
    return first_reason(*rules)


def mail_queue(prospects: DataFrame, kind: str, as_of: Column, per_day: int = PER_DAY, batch: DataFrame | None = None) -> DataFrame:
    """Per prospect of the batch (prospect_id; all without one): accepted, reason, and seconds until its mail goes.

    Those mailed since midnight take from the day's room; order is by prospect_id.
    """
    chosen = prospects.join(batch.select("prospect_id").distinct().orderBy("prospect_id").limit(PER_BATCH), "prospect_id", "left_semi") if batch is not None else prospects
    most = per_day or PER_DAY
    sent = prospects.agg(F.count_if(F.col("last_mailed_at") >= F.date_trunc("day", as_of)).alias("sent"))
    judged = chosen.withColumn("reason", skip_reason(kind))
    # a day's room at most, so these few rows are numbered in one task and sent to all
    first = judged.where("reason is null").select("prospect_id").orderBy("prospect_id").limit(most)
    numbered = first.withColumn("place", F.row_number().over(Window.orderBy("prospect_id"))).join(F.broadcast(sent)).where(F.col("place") <= most - F.col("sent"))
    decided = judged.join(F.broadcast(numbered.select("prospect_id", "place")), "prospect_id", "left").withColumn("accepted", F.col("place").isNotNull() & F.col("reason").isNull())
    reason = F.when(F.col("reason").isNull() & ~F.col("accepted"), "day's limit reached").otherwise(F.col("reason"))
    wait = F.when(F.col("accepted"), ((F.col("place") - 1) * PAUSE_SECONDS).cast("long"))
    return decided.select("prospect_id", "accepted", reason.alias("reason"), wait.alias("wait_seconds"))


def mailed(prospects: DataFrame, sent: DataFrame, kind: str, at: Column) -> DataFrame:
    """Prospects after their mails went (sent: prospect_id)."""
    hit = prospects.join(sent.select("prospect_id", F.lit(True).alias("_sent")), "prospect_id", "left")
    yes = F.coalesce("_sent", F.lit(False))
    return hit.withColumns({
        "stage": F.when(yes, "mailed" if kind == "first" else "followed_up").otherwise(F.col("stage")),
        "last_mailed_at": F.when(yes, at).otherwise(F.col("last_mailed_at")),
        "mail_count": F.coalesce("mail_count", F.lit(0)) + yes.cast("int"),
        "follow_up_on": F.when(yes, F.date_add(at.cast("date"), 10)).otherwise(F.col("follow_up_on")),
    }).drop("_sent")


def unsubscribed(prospects: DataFrame, tokens: DataFrame, at: Column) -> DataFrame:
    """Prospects after links with their tokens (ten characters at least) were followed."""
    good = tokens.where(F.length("token") >= 10).select("token").distinct().withColumn("_hit", F.lit(True))
    joined = prospects.join(good, "token", "left")
    new = F.coalesce(F.col("_hit") & ~F.col("stage").eqNullSafe("do_not_contact"), F.lit(False))
    return joined.withColumns({"unsubscribed_at": F.when(new, at).otherwise(F.col("unsubscribed_at")), "stage": F.when(new, "do_not_contact").otherwise(F.col("stage"))}).drop("_hit").select(*prospects.columns)


def stage_history(prospects: DataFrame, at: Column) -> DataFrame:
    """Prospects (stage, old_stage, history) with a line for a stage that changed."""
    changed = ~F.col("stage").eqNullSafe(F.col("old_stage"))
    line = F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit(" "), F.coalesce("old_stage", F.lit("-")), F.lit(" > "), F.coalesce("stage", F.lit("-")))
    return prospects.withColumn("history", F.when(changed, F.concat_ws("\n", F.nullif(F.col("history"), F.lit("")), line)).otherwise(F.col("history")))


def rating_summary(reviews: DataFrame, by: str, newest: int = 200) -> DataFrame:
    """Per target: count and mean (one decimal) of the newest approved reviews."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("review_id")))
    kept = reviews.where("review_status = 'approved'").withColumn("_n", place).where(F.col("_n") <= newest)
    return kept.groupBy(by).agg(F.count("rating").alias("n"), js_round(F.avg("rating"), 1).alias("average"))


def submitted(reviews: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """New reviews (user_id, target_id, rating, text, visited_on) with error, null where they may be stored: one active review for each user and target."""
    active = reviews.where("review_status in ('pending', 'approved')").select("user_id", "target_id", F.lit(True).alias("_has")).distinct()
    visit = visited_on("visited_on", now)
    error = first_reason(
        (F.col("user_id").isNull(), "not signed in"),
        (~F.coalesce(F.col("rating").between(1, 5) & (F.col("rating") == F.floor("rating")), F.lit(False)), "rating must be 1 to 5"),
        (F.length(F.trim(F.coalesce("text", F.lit("")))) < 10, "text too short"),
        (F.col("visited_on").isNotNull() & visit.isNull(), "no valid date"),
        (F.col("_has"), "reviewed already"),
    )
    joined = new.join(active, ["user_id", "target_id"], "left").withColumn("error", error).drop("_has")
    # of several at once by one user the first by text
    return joined.withColumn("review_status", F.when(F.col("error").isNull(), "pending"))


def newsletter(subscriptions: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Subscriptions after one event for each address: subscribe (with a new token), confirm (with a token), unsubscribe.

    subscriptions: email, status, token_hash, expires_at; events: email, event, token.
    """
    e = events.select(F.lower(F.trim("email")).alias("email"), "event", F.sha2("token", 256).alias("e_hash")).where("email <> ''")
    joined = subscriptions.join(e, "email", "full_outer")
    event, status = F.col("event"), F.col("status")
    starts = (event == "subscribe") & ~F.coalesce(status == "subscribed", F.lit(False))
    confirms = (event == "confirm") & F.coalesce((F.col("token_hash") == F.col("e_hash")) & (F.col("expires_at") >= now), F.lit(False))
    leaves = (event == "unsubscribe") & status.isNotNull()
    ends = F.coalesce(confirms | leaves, F.lit(False))
    return joined.select(
        "email",
        F.when(starts, "pending").when(confirms, "subscribed").when(leaves, "unsubscribed").otherwise(status).alias("status"),
        F.when(starts, F.col("e_hash")).when(~ends, F.col("token_hash")).alias("token_hash"),
        F.when(starts, now + F.expr("INTERVAL 24 HOURS")).when(~ends, F.col("expires_at")).alias("expires_at"),
        F.when(event == "confirm", F.when(confirms, "ok").when(F.col("token_hash") != F.col("e_hash"), "invalid").otherwise("expired")).when(starts | leaves, "ok").alias("outcome"),
    ).where("status is not null")


def deletions(requests: DataFrame, now: Column) -> DataFrame:
    """Confirmed requests (user_id, email, sent_at, token_hash, given): those whose token is right and fresh."""
    return requests.where((F.sha2("given", 256) == F.col("token_hash")) & fresh("sent_at", now)).select("user_id", "email")


def without_users(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of neither a deleted user nor a deleted address (null values match nothing)."""
    left = rows.join(gone.where("user_id is not null").select("user_id").distinct(), "user_id", "left_anti") if "user_id" in rows.columns else rows
    return left.join(gone.where("email is not null").select("email").distinct(), "email", "left_anti") if "email" in rows.columns else left


def partner_edits(before: DataFrame, edits: DataFrame, files: DataFrame, published: DataFrame, key: str, fields: list[str], media: list[str], gallery: str = "gallery", most: int = MOST_IMAGES, auto_publish: bool = True) -> DataFrame:
    """Per edit (key, fields, media: ids of files, gallery: array of ids): error, changed, publish, and the values after it.

    A file may be used if the partner has it already, or if it was uploaded for the partner (files: file_id and the
    key). A gallery holds each file once and ``most`` at most. An edit with an error changes nothing; one that
    changes something is published only where the partner is published already (published: key).
    """
    names = [*fields, *media]
    own = before.select(key, *[F.col(c).alias(f"_{c}") for c in [*names, gallery]])
    joined = own.join(edits.withColumn(gallery, F.array_distinct(F.array_compact(F.col(gallery)))), key)
    empty = F.array().cast(edits.schema[gallery].dataType)
    asked = F.array_compact(F.concat(F.array(*[F.col(c) for c in media]), F.coalesce(gallery, empty)))
    held = F.array_compact(F.concat(F.array(*[F.col(f"_{c}") for c in media]), F.coalesce(f"_{gallery}", empty)))
    new = joined.withColumn("_new", F.array_except(asked, held))
    allowed = files.select(F.col("file_id").alias("_file"), F.col(key).alias("_owner"))
    lacking = new.select(key, F.explode("_new").alias("_file")).join(allowed.withColumnRenamed("_owner", key), [key, "_file"], "left_anti").select(key).distinct().withColumn("_foreign", F.lit(True))
    judged = new.join(lacking, key, "left").join(published.select(key).distinct().withColumn("_live", F.lit(True)), key, "left")
    error = first_reason((F.size(gallery) > most, "too many images"), (F.col("_foreign"), "images of others"))
    differs = [F.when(~F.col(f"_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in [*names, gallery]]
    done = judged.withColumn("error", error).withColumn("changed", F.when(F.col("error").isNull(), F.array_compact(F.array(*differs))).otherwise(F.array().cast("array<string>")))
    publish = (F.size("changed") > 0) & F.coalesce("_live", F.lit(False)) & F.lit(auto_publish)
    after = [F.when(F.col("error").isNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in [*names, gallery]]
    return done.select(key, "error", "changed", publish.alias("publish"), *after)


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key: the names of the fields that an edit changed."""
    joined = before.alias("b").join(after.alias("a"), key)
    return joined.select(key, F.array_compact(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields])).alias("changed"))


def popularity(views: Column, downloads: Column, favourites: Column, hours: Column) -> Column:
    """Engagement on a logarithmic scale; age adds to it, a 48th of a point an hour."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return F.log10(n(views) + 3 * n(downloads) + 5 * n(favourites) + 1) + hours / 48


def profiles_upserted(profiles: DataFrame, edits: DataFrame, key: str = "user_id") -> DataFrame:
    """Profiles after edits; a null in an edit leaves the value as it is."""
    fields = [c for c in edits.columns if c != key]
    e = edits.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    joined = profiles.join(e, key, "full_outer")
    return joined.select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in profiles.columns if c != key])
