"""Imports of older records: places, routes, users, articles, points of interest, orders, statistics, prospects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as t
from ..functions.coerce import blank_to_null, first_filled, flag, js_round, source_number
from ..functions.dates import anniversary, cleaned, cleaned_date, duration_minutes, period_start, year_month
from .html import place_page, to_blocks
from .match import cascade, customers, fuzzy, nearest_tier, subsequence_at, through_links
from .rows import filled_first, reduced, unique_names
from .sync import inserted_if_absent, upserted
from .tracks import autofilled, chosen_nodes, merged_starts, normalised_distances


def cities(rows: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Cities by slug from municipality rows (municipality, postcode, province, region, lat, lng, ordinal).

    Names are repaired, the first row of a slug wins and later ones fill what it lacks; extra (the same columns)
    fills places and postcodes that are still missing.
    """
    own = rows.withColumn("name", blank_to_null(t.repaired("municipality"))).where("name is not null").withColumn("slug", t.slug("name"))
    columns = ["name", "postcode", "province", "region", "lat", "lng"]
    first = filled_first(own, ["slug"], F.col("ordinal"), columns)
    if extra is None:
        return first
    more = filled_first(extra.withColumns({"name": blank_to_null(t.repaired("municipality")), "slug": t.slug(t.repaired("municipality"))}), ["slug"], F.col("ordinal"), columns)
    both = first.alias("a").join(more.alias("b"), "slug", "left")
    return both.select("slug", *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in columns])


def city_tables(rows: DataFrame, extra: DataFrame | None = None, country: str = "belgie") -> DataFrame:
    """Cities with the provinces and regions they need: kind, slug, name, parent (a slug), postcode, lat, lng.

    Provinces and regions have one name whatever language a row has them in.
    """
    found = cities(rows, extra).withColumn("area", t.areas(blank_to_null(t.repaired("province")), blank_to_null(t.repaired("region")), country))
    own = found.withColumns({"province": F.col("area.province"), "region": F.col("area.region")}).drop("area")
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("postcode", "string"), ("lat", "double"), ("lng", "double"))]
    above = lambda kind, name, parent: reduced(own.where(F.col(name).isNotNull()).select(F.lit(kind).alias("kind"), t.slug(name).alias("slug"), F.col(name).alias("name"), parent.alias("parent"), *nothing), ["slug"], F.struct("name", "parent"))
    city = own.select(F.lit("city").alias("kind"), "slug", "name", t.slug("province").alias("parent"), "postcode", "lat", "lng")
    return city.unionByName(above("province", "province", t.slug("region"))).unionByName(above("region", "region", F.lit(None).cast("string")))


def registered_cities(records: DataFrame, postcodes: DataFrame | None = None) -> DataFrame:
    """Municipality rows, as ``cities`` takes them, of a register (gem_name, prov_name: arrays; geo_point_2d; geo_shape: GeoJSON text or struct).

    A place is the record's point, else the middle of its shape's distinct vertices; the postcode is the least of the municipality's (gem_name, pc4_code).
    """
    shape = F.col("geo_shape").cast("string") if dict(records.dtypes)["geo_shape"] == "string" else F.to_json("geo_shape")
    inner = F.coalesce(F.get_json_object(shape, "$.geometry"), shape)
    lists = F.get_json_object(inner, "$.coordinates")
    rings = F.when(F.get_json_object(inner, "$.type") == "Polygon", F.from_json(lists, "array<array<array<double>>>")).when(F.get_json_object(inner, "$.type") == "MultiPolygon", F.flatten(F.from_json(lists, "array<array<array<array<double>>>>")))
    points = F.transform(F.flatten(rings), lambda p: F.struct(p[1].alias("lat"), p[0].alias("lng")))
    middle = F.when(F.size(points) > 0, geo.centroid(points))
    own = records.select(
        F.get("gem_name", F.lit(0)).alias("municipality"), F.get("prov_name", F.lit(0)).alias("province"), F.lit(None).cast("string").alias("region"),
        F.coalesce("geo_point_2d.lat", middle["lat"]).alias("lat"), F.coalesce("geo_point_2d.lon", middle["lng"]).alias("lng"),
    ).withColumns({"slug": t.slug(t.repaired("municipality")), "ordinal": F.xxhash64("municipality", "lat", "lng")})
    if postcodes is None:
        return own.withColumn("postcode", F.lit(None).cast("string")).drop("slug")
    named = postcodes.select(F.col("gem_name").alias("municipality"), blank_to_null(F.col("pc4_code").cast("string")).alias("postcode")).where("postcode is not null")
    return own.join(least_postcodes(named), "slug", "left").drop("slug")


def least_postcodes(rows: DataFrame) -> DataFrame:
    """The least postcode of each municipality (municipality, postcode)."""
    return rows.groupBy(t.slug("municipality").alias("slug")).agg(F.min("postcode").alias("postcode"))


def with_country(rows: DataFrame, provinces: DataFrame, countries: DataFrame, default: str) -> DataFrame:
    """country_id by the row's province, else the default country's slug, else the country's name."""
    p = provinces.select(F.col("slug").alias("_p"), F.col("country_id").alias("_c1"))
    by_slug = countries.where(F.col("slug") == default).agg(F.min("id").alias("_c2"))
    n = countries.groupBy(t.country_slug("name").alias("_n")).agg(F.min("id").alias("_c3"))
    joined = rows.join(p, t.slug(rows["province"]) == p["_p"], "left").join(n, t.country_slug(rows["country"]) == n["_n"], "left").join(F.broadcast(by_slug))  # one row
    return joined.withColumn("country_id", F.coalesce("_c1", "_c2", "_c3")).drop("_p", "_c1", "_c2", "_n", "_c3")


def area_candidates(wanted: DataFrame, places: DataFrame) -> DataFrame:
    """Places (place_id, name, province, country) for wanted names (request, name, province, country): in the same province, else the country, else anywhere."""
    keys = [t.slug("name").alias("_slug"), t.slug("province").alias("_province"), t.country_slug("country").alias("_country")]
    found = nearest_tier(wanted.select("request", *keys), places.select("place_id", *keys), [["_slug", "_country", "_province"], ["_slug", "_country"], ["_slug"]], "place_id")
    return found.where("tier is not null").select("request", "place_id", "tier")


ROUTE_NAMES = {"title": ["Titel", "Title", "title"], "slug": ["URL", "Slug", "slug"], "start": ["Start_gemeente", "Start"], "duration": ["Duur", "Tijd"], "distance": ["Afstand", "KM"], "nodes": ["Knooppunten", "Nodes"], "gaps": ["Afstanden", "Distances"], "type": ["Type"], "level": ["Moeilijkheid", "Niveau"], "text": ["Description", "Beschrijving"], "status": ["Status"]}


def routes(rows: DataFrame, flags: Mapping[str, str] | None = None) -> DataFrame:
    """Routes from older tables: rows with status 1 and a slug, columns by whichever names there are.

    flags: names of boolean columns (as of wheelchairs, dogs, strollers) and where they come from.
    """
    own = rows.select("*", *[first_filled(rows, names).alias(f"_{out}") for out, names in ROUTE_NAMES.items()]).where("_status = '1' and _slug is not null")
    km = source_number("_distance")
    nodes = t.node_sequence(F.coalesce("_nodes", F.lit("")))
    gaps = t.decimals(F.coalesce("_gaps", F.lit("")))
    return own.select(
        F.col("_title").alias("title"), t.slug("_slug").alias("slug"), F.col("_start").alias("start"), km.alias("distance_km"), duration_minutes("_duration").alias("minutes"),
        t.difficulty(source_number("_level")).alias("difficulty"), t.type_tags("_type").alias("tags"), nodes.alias("node_numbers"),
        normalised_distances(gaps, F.size(nodes), km).alias("node_km"), to_blocks(F.coalesce("_text", F.lit(""))).alias("blocks"),
        *[flag(F.col(source)).alias(out) for out, source in (flags or {}).items()],
    )


def known_sequences(routes: DataFrame, recorded: DataFrame) -> DataFrame:
    """Coordinates of routes' nodes where a recorded sequence (slug, nodes: array<struct<number, lat, lng>>) holds their numbers in a row."""
    joined = routes.join(recorded, "slug")
    at = subsequence_at(F.transform("nodes", lambda n: n["number"]), F.col("node_numbers"))
    return joined.select("slug", F.when(at.isNotNull(), F.slice("nodes", at + 1, F.size("node_numbers"))).alias("nodes"))


def placed_routes(rows: DataFrame, starts: DataFrame, places: DataFrame, recorded: DataFrame, flags: Mapping[str, str] | None = None) -> DataFrame:
    """Routes of older tables as a whole: ``routes`` with their start places merged and looked up, and their nodes' coordinates.

    starts: slug, name, latitude, longitude, city, province, country, distance_km, ordinal; places: place_id, name,
    province, country; recorded: slug, nodes. A start's city is looked up in its province, its country, anywhere.
    """
    own = routes(rows, flags)
    merged = merged_starts(starts.withColumnRenamed("slug", "route_id"))
    asked = merged.select(F.concat_ws("#", "route_id", "ordinal").alias("request"), F.col("city").alias("name"), "province", "country")
    found = merged.withColumn("request", F.concat_ws("#", "route_id", "ordinal")).join(area_candidates(asked, places), "request", "left")
    lists = found.groupBy(F.col("route_id").alias("slug")).agg(F.sort_array(F.collect_list(F.struct("ordinal", "name", "latitude", "longitude", "place_id", "distance_km"))).alias("starts"))
    return own.join(lists, "slug", "left").join(known_sequences(own, recorded), "slug", "left")


def imported_routes(rows: DataFrame, starts: DataFrame, places: DataFrame, recorded: DataFrame, candidates: DataFrame | None = None, tracks: DataFrame | None = None, flags: Mapping[str, str] | None = None) -> DataFrame:
    """``placed_routes`` with what else is known of a route.

    candidates: route_id (a slug), place (from 0), candidate_id, lat, lng, route_index, route_metres, expected_gap_km: where no recorded sequence has the
    route's nodes, one candidate is chosen for each in order. tracks: route_id, title, description, distance_km, minutes, gain, loss of a recorded track, which
    fill blank texts and replace measures. nodes_from says where the nodes are from.
    """
    own = placed_routes(rows, starts, places, recorded, flags)
    known = F.coalesce(F.size("nodes") > 0, F.lit(False))
    if candidates is None:
        found = own.withColumn("nodes_from", F.when(known, "recorded"))
    else:
        open_ones = candidates.join(own.where(~known).select(F.col("slug").alias("route_id"), "node_numbers"), "route_id")
        chosen = chosen_nodes(open_ones.where("place < size(node_numbers)").drop("node_numbers"))
        # a route needs all of its nodes
        lists = chosen.groupBy(F.col("route_id").alias("slug")).agg(F.sort_array(F.collect_list(F.struct("place", "lat", "lng"))).alias("_chosen"))
        joined = own.join(lists, "slug", "left")
        complete = F.coalesce(F.size("_chosen") == F.size("node_numbers"), F.lit(False))
        made = F.transform("_chosen", lambda n: F.struct(F.get("node_numbers", n["place"].cast("int")).alias("number"), n["lat"].cast("double").alias("lat"), n["lng"].cast("double").alias("lng")))
        found = joined.withColumns({"nodes_from": F.when(known, "recorded").when(complete, "chosen"), "nodes": F.when(known, F.col("nodes")).when(complete, made)}).drop("_chosen")
    if tracks is None:
        return found
    more = {c: F.lit(None).cast(k) for c, k in (("description", "string"), ("gain", "double"), ("loss", "double")) if c not in found.columns}
    return autofilled(found.withColumns(more | {"route_id": F.col("slug"), "minutes": F.col("minutes").cast("double")}), tracks).drop("route_id")


def newsletters(rows: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Newsletter addresses of the older site (Email, Inschrijvingsdatum, Uitschrijvingsdatum, Optin, user_controlnumber): one row for each address, the last by ID.

    Status by opt-in and by whether there is a date of leaving. users: id with control_number, or with email; action says insert, or invalid for what isn't an address.
    """
    own = rows.select(
        F.col("ID").try_cast("long").alias("old_id"), F.lower(F.trim("Email")).alias("email"), cleaned("Inschrijvingsdatum").alias("consent_at"), cleaned("Uitschrijvingsdatum").alias("unsubscribed_at"),
        F.col("Optin").alias("optin"), blank_to_null("user_controlnumber").alias("control_number"),
    )
    valid = F.coalesce(F.col("email").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))
    good = reduced(own.where(valid), ["email"], F.col("old_id"), last=True)
    gone = (F.coalesce(F.col("optin").try_cast("double"), F.lit(0.0)) == 0) | F.col("unsubscribed_at").isNotNull()
    found = good.withColumn("status", F.when(gone, "unsubscribed").otherwise("subscribed")).withColumn("source", F.lit("import"))
    if users is None:
        found = found.withColumn("user_id", F.lit(None).cast("long"))
    else:
        by = "control_number" if "control_number" in users.columns else "email"
        known = users.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("_by")).agg(F.min("id").alias("user_id"))
        found = found.join(known, found[by] == known["_by"], "left").drop("_by")
    wanted = ["email", "status", "source", "consent_at", "unsubscribed_at", "user_id"]
    kept = found.select(*wanted, F.lit("insert").alias("action"))
    return kept.unionByName(own.where(~valid).select("email", F.lit("invalid").alias("action")), allowMissingColumns=True)


def users(rows: DataFrame) -> DataFrame:
    """Users (id, email, username, password, created, newsletter, unsubscribed): no password leaves but its kind."""
    who = t.sorted_identity(F.lower(blank_to_null("email")), blank_to_null("username"))
    own = rows.withColumn("who", who).where(t.is_email(F.col("who.email")))
    single = reduced(own, ["who"], F.col("id"))
    single = reduced(single.withColumn("mail", F.col("who.email")), ["mail"], F.col("id"))
    named = single.select("id", F.col("mail").alias("email"), F.coalesce("who.user", F.substring_index("mail", "@", 1)).alias("name"), t.password_kind("password").alias("password_kind"), cleaned("created").alias("created"),
                          F.when(~flag("newsletter") | flag("unsubscribed"), "unsubscribed").otherwise("subscribed").alias("newsletter"))
    return unique_names(named, "name", [F.asc("id")], "username").drop("name")


def password_kinds(rows: DataFrame) -> DataFrame:
    return rows.groupBy(t.password_kind("password").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def articles(rows: DataFrame) -> DataFrame:
    """Articles (id, title, url, intro, body, author, category, visible): blocks, excerpt, and whether they are published."""
    return rows.select(
        "id", blank_to_null("title").alias("title"), t.slug(F.coalesce(blank_to_null("url"), F.col("title"))).alias("slug"),
        t.excerpt(F.coalesce("intro", F.lit("")), F.coalesce("body", F.lit(""))).alias("excerpt"), to_blocks(t.without_page_chrome(F.coalesce("body", F.lit("")))).alias("blocks"),
        blank_to_null("author").alias("author"), blank_to_null("category").alias("category"), flag("visible").alias("published"),
    )


def named_rows(existing: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """existing (slug, name) with a row for each new name of the column."""
    new = names.select(t.slug(column).alias("slug"), F.col(column).alias("name")).where("slug <> ''")
    return inserted_if_absent(existing, reduced(new, ["slug"], F.col("name")), ["slug"])


def points_of_interest(rows: DataFrame) -> DataFrame:
    """Points (ID, Title, Title2, Type, Description): kind and blocks; the alternative text of the image is the title."""
    return rows.select(F.col("ID").cast("long").alias("old_point_id"), blank_to_null("Title").alias("title"), t.poi_type(F.col("Type"), F.col("Title"), F.col("Title2")).alias("kind"), to_blocks(F.coalesce("Description", F.lit(""))).alias("blocks"), blank_to_null("Title").alias("image_alt"))


def repaired_alt_texts(points: DataFrame) -> DataFrame:
    """Points (title, image, image_alt) whose image has no alternative text get their title; outcome: fixed, already, no image."""
    blank = F.trim(F.coalesce("image_alt", F.lit(""))) == ""
    outcome = F.when(F.col("image").isNull(), "no image").when(blank, "fixed").otherwise("already")
    return points.withColumn("outcome", outcome).withColumn("image_alt", F.when(F.col("outcome") == "fixed", F.col("title")).otherwise(F.col("image_alt")))


def place_pages(rows: DataFrame, universe: str, most: int | None = None) -> DataFrame:
    """Place pages of a universe (Universe, Titel, URL, Description): slug, title and the page's parts; ``most`` is what was asked for."""
    own = rows.where(F.col("Universe") == universe)
    own = own.orderBy("URL").limit(most) if most is not None else own
    parts = own.select(blank_to_null("Titel").alias("title"), t.slug("URL").alias("slug"), place_page()(F.coalesce("Description", F.lit(""))).alias("parts"))
    return parts.select("slug", "title", "parts.*").where("slug <> ''")


def point_links(points: DataFrame, links: DataFrame, old_routes: DataFrame, routes: DataFrame) -> DataFrame:
    """(point_id, route_id): points (old_point_id, point_id), links (old_point_id, old_route_id), old routes (old_route_id, slug), routes (route_id, slug)."""
    return through_links(points, links.join(old_routes, "old_route_id"), routes)


#: Kinds of customers that aren't lodgings.
NOT_LODGINGS = ("advertentie", "andere")


def order_backfill(orders: DataFrame, subs: DataFrame, overwrite: bool = False, mapped: DataFrame | None = None, skipped: Sequence[str] = ()) -> DataFrame:
    """Per matched subscription: first and last run and count from its orders, never moving the last run back.

    mapped (sub_id, wanted): an address, else a name, whose customers a subscription has whatever it is called. skipped: sub_ids that are left alone.

    orders: name, email, type, status, date, number, reference; subs: sub_id, sub_name, sub_email, start_date, first_run, last_run, run_count.
    """
    real = orders.where(~F.lower(F.coalesce("type", F.lit(""))).isin(*NOT_LODGINGS) & (F.lower(F.coalesce("status", F.lit(""))) != "credit"))
    clean = real.withColumns({"name": t.entities("name"), "email": F.lower(F.trim(F.coalesce("email", F.lit("")))), "date": cleaned_date("date")})
    own = customers(clean).withColumn("customer_id", F.sha2(F.concat_ws("|", "email", "norm_name"), 256))
    subs = subs.where(~F.col("sub_id").cast("string").isin(*skipped)) if skipped else subs
    if mapped is None:
        hits = fuzzy(subs, own).where("status = 'matched'").select("sub_id", "customer_id")
    else:
        asked = mapped.withColumn("sub_id", F.col("sub_id").cast(subs.schema["sub_id"].dataType))
        by_mail = asked.join(own.where("email <> ''").select("customer_id", "email"), F.lower(F.trim("wanted")) == F.col("email")).select("sub_id", "customer_id")
        by_name = asked.join(by_mail, "sub_id", "left_anti").join(own.select("customer_id", "norm_name"), t.plain_name("wanted") == F.col("norm_name")).select("sub_id", "customer_id")
        rest = fuzzy(subs.join(asked.select("sub_id"), "sub_id", "left_anti"), own).where("status = 'matched'").select("sub_id", "customer_id")
        hits = by_mail.union(by_name).union(rest)
    joined = subs.join(hits, "sub_id").join(own.select("customer_id", F.col("email").alias("c_email"), F.col("norm_name").alias("c_name")), "customer_id")
    runs = clean.withColumn("norm_name", t.plain_name("name")).select(F.col("email").alias("c_email"), F.col("norm_name").alias("c_name"), "date", "number", "reference")
    dated = joined.join(runs, ["c_email", "c_name"]).withColumn("run", F.coalesce(period_start("reference"), anniversary("start_date", "date")))
    sums = dated.groupBy("sub_id").agg(F.min("run").alias("o_first"), F.max("run").alias("o_last"), F.count_distinct("run").alias("o_count"))
    take = lambda old, new: F.col(new) if overwrite else F.coalesce(old, new)
    return subs.join(sums, "sub_id").select("sub_id", take("first_run", "o_first").alias("first_run"), F.greatest("last_run", "o_last").alias("last_run"), take("run_count", "o_count").alias("run_count"))


def partner_stats(stats: DataFrame, lodgings: DataFrame, partners: DataFrame, manual: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to store by partner and month, lodgings with statistics but no partner).

    stats: lid, year, month, views, page_views, website; lodgings: id, url, title; partners: partner_id, slug, name.
    A lodging is a partner by a manual map (id, slug), its address, the address without "-routes", or its title.
    """
    own = lodgings.join(manual.select("id", F.col("slug").alias("manual")), "id", "left") if manual is not None else lodgings.withColumn("manual", F.lit(None).cast("string"))
    by_slug = partners.select(F.col("slug").alias("key"), "partner_id")
    slugs = cascade(own, "id", [("manual", F.col("manual")), ("slug", F.trim("url")), ("slug without routes", F.regexp_replace(F.trim("url"), "-routes$", "")), ("title", t.slug("title", "en"))], by_slug, "key", "partner_id")
    names = cascade(own, "id", [("title", t.slug("title", "en"))], partners.select(t.slug("name", "en").alias("key"), "partner_id"), "key", "partner_id")
    hits = slugs.union(names.join(slugs, "id", "left_anti"))
    good = stats.where("year > 2000 and month between 1 and 12")
    least = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0))).alias(c)
    rows = good.join(hits, good["lid"] == hits["id"]).select("partner_id", "lid", year_month(F.col("year"), F.col("month")).alias("month"), least("views"), least("page_views"), least("website"))
    totals = stats.groupBy("lid").agg(F.count(F.lit(1)).alias("months"), F.sum(F.coalesce("views", F.lit(0))).alias("total_views"))
    missing = lodgings.join(hits, "id", "left_anti").join(totals, lodgings["id"] == totals["lid"]).select("id", "title", "months", "total_views")
    return rows, missing


#: What prospects' short names stand for.
PROSPECT_NAMES = {"n": "name", "pr": "province", "c": "city", "p": "postcode", "t": "type", "seg": "segment", "e": "email", "ph": "phone", "w": "website", "la": "lat", "lo": "lng", "i": "source_id"}


def prospects(rows: DataFrame) -> DataFrame:
    """Prospects from short-named columns, texts cut to 255 characters; addresses that aren't valid are null."""
    texts = {out: t.clip(blank_to_null(F.col(short))) for short, out in PROSPECT_NAMES.items() if out not in ("lat", "lng") and short in rows.columns}
    numbers = {out: source_number(F.col(short)) for short, out in PROSPECT_NAMES.items() if out in ("lat", "lng") and short in rows.columns}
    own = rows.select(*[c.alias(n) for n, c in (texts | numbers).items()])
    return own.withColumn("email", F.when(t.is_email(F.lower("email")), F.lower("email"))).where("source_id is not null")


PROTECTED = ("stage", "unsubscribed_at", "last_mailed_at", "mail_count")


def prospects_upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored prospects after an import: by source_id, what people have entered stays."""
    kept = [c for c in PROTECTED if c in stored.columns]
    return upserted(stored, new.join(stored.select("source_id", *kept), "source_id", "left"), ["source_id"])


def inherited_address(city: Column, *wider: Column) -> Column:
    """A city's address; what it lacks from its province, region and country, in that order (structs of equal fields)."""
    fields = ("street", "postal_code", "latitude", "longitude")
    return F.struct(*[F.coalesce(city[f], *[w[f] for w in wider]).alias(f) for f in fields])


def repaired_surface(starts: DataFrame) -> DataFrame:
    """Start locations whose shares are all zero were never measured: their zeros become null."""
    shares = ["paved", "unpaved"]
    unmeasured = F.coalesce(F.forall(F.array(*shares), lambda x: F.coalesce(x, F.lit(0.0)) == 0), F.lit(False))
    return starts.withColumns({c: F.when(~unmeasured, F.col(c)) for c in shares}).withColumn("paved", js_round("paved", 1))


def missing_drafts(versions: DataFrame) -> DataFrame:
    """Documents with a published version in a locale but no draft."""
    return versions.groupBy("document_id", "locale").agg(F.bool_or(F.col("published_at").isNull()).alias("draft")).where("not draft").select("document_id", "locale")
