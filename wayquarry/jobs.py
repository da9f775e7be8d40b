"""Imports and synchronisations from the command line. Without --apply nothing is written, only counters are printed.

    spark-submit -m wayquarry.jobs users --source users.sql --out /lake/users --apply
    python -m wayquarry.jobs network --source nodes.json --stored /lake/nodes --out /lake/nodes-new --prune

A run writes to a new folder (--out); --limit and --offset take part of the source, in order of its rows' keys.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import imports, network_sync, proforma, sync
from .operators.rows import winner
from .sources import files, sqldump
from .storage import discard
from .storage import stored as store

USER_COLUMNS = ["id", "email", "username", "password", "created", "newsletter", "unsubscribed"]
ARTICLE_COLUMNS = ["id", "title", "url", "intro", "body", "author", "category", "visible"]
ROUTE_COLUMNS = sorted({name for names in imports.ROUTE_NAMES.values() for name in names[:1]})
NEWSLETTER_COLUMNS = ["ID", "Email", "Name", "Lastname", "Inschrijvingsdatum", "Inschrijvingsmanier", "Uitschrijvingsdatum", "Uitschrijvingsmanier", "Optin", "Status", "user_controlnumber"]
PLACE_COLUMNS = ["Universe", "Titel", "Titel2", "URL", "Provincie", "Description", "Meta_title", "Meta_description", "Image_top", "Copy_top"]
POINT_COLUMNS = ["ID", "Title", "Title2", "Type", "Description"]


def dump(table: str, columns: Sequence[str], make: Callable[[DataFrame], DataFrame], key: str) -> Callable:
    def job(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
        rows = sqldump.read(spark, options.source, options.table or table, list(columns))
        if options.offset or options.limit is not None:
            rows = rows.orderBy(F.col(key).try_cast("long"), key).offset(options.offset)
            rows = rows.limit(options.limit) if options.limit is not None else rows
        return make(rows).withColumn("action", F.lit("insert"))

    return job


def prospects(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    new = imports.prospects(spark.read.option("multiLine", True).json(options.source))
    if not options.stored:
        return new.withColumn("action", F.lit("insert"))
    stored = spark.read.parquet(options.stored)
    after = imports.prospects_upserted(stored, new)
    known = stored.select("source_id").withColumn("action", F.lit("update"))
    return after.join(known, "source_id", "left").withColumn("action", F.coalesce("action", F.lit("insert")))


def given(spark: SparkSession, options: argparse.Namespace, name: str) -> DataFrame | None:
    """A further table of --with name=path: a folder or file of Parquet, JSON or CSV."""
    path = dict(x.split("=", 1) for x in options.more).get(name)
    return _read(spark, path) if path else None


def _read(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    return files.csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def needed(spark: SparkSession, options: argparse.Namespace, name: str) -> DataFrame:
    found = given(spark, options, name)
    if found is None:
        raise SystemExit(f"this job needs --with {name}=...")
    return found


def network(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Step 1: nodes. Step 2: connections, whose ends are looked up among the stored nodes (--with nodes=, what step 1 wrote)."""
    features = files.features(spark, options.source)
    if options.step == 2:
        ready = network_sync.with_ends(network_sync.feature_connections(features, options.unit), needed(spark, options, "nodes"))
        source = ready.select("external_id", "from_id", "to_id", "distance_km", "geometry")
        old = spark.read.parquet(options.stored) if options.stored else source.where("false")
        return sync.after(network_sync.sync_connections(source, old), old)
    source = network_sync.feature_nodes(features)
    old = spark.read.parquet(options.stored) if options.stored else source.where("false")
    found = sync.diff(source, old, ["external_id"], {"number": None, "name": None, "lat": network_sync.SAME_DEGREES, "lng": network_sync.SAME_DEGREES})
    return sync.after(sync.guarded(found, network_sync.LEAST_NODES, network_sync.LEAST_SHARE, options.prune), old)


def _of_mode(rows: DataFrame, options: argparse.Namespace) -> DataFrame:
    """The rows of --mode; without that option all."""
    if not options.mode:
        return rows
    if "mode" not in rows.columns:
        raise SystemExit("--mode needs rows with a column mode")
    return rows.where(F.col("mode") == options.mode)


def layer(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """A regional layer's connections (--source) with its nodes (--with nodes=) against the stored ones (--stored, --with stored_nodes=).

    --with networks= gives connections their networks, --with surface= (classified ways with their layer's mode) and --with ways= (map ways
    with tags, left out by --no-osm) their surfaces. Lines, names, modes and networks are written with the rest.
    """
    nodes, networks, official, ways = needed(spark, options, "nodes"), given(spark, options, "networks"), given(spark, options, "surface"), given(spark, options, "ways")
    edges = _of_mode(network_sync.layer_connections(_read(spark, options.source), options.origin), options)
    if networks is not None:
        edges = network_sync.with_network(edges, networks)
    if official is not None or (ways is not None and not options.no_osm):
        edges = edges if "mode" in edges.columns else edges.withColumn("mode", F.lit(None).cast("string"))
        edges = network_sync.surfaced(edges, official, None if options.no_osm or ways is None else network_sync.classified_ways(ways))
    edges = store(edges, "layer")
    old = spark.read.parquet(options.stored) if options.stored else edges.where("false")
    old = old.where("kind = 'edge'") if "kind" in old.columns else old
    old_nodes = given(spark, options, "stored_nodes")
    old_nodes = nodes.where("false") if old_nodes is None else old_nodes.where("kind = 'node'") if "kind" in old_nodes.columns else old_nodes
    n, e = network_sync.sync_layer(nodes, edges, old_nodes, old, options.prune and not options.mode, options.origin)
    return sync.after(e, old, None).withColumn("kind", F.lit("edge")).unionByName(sync.after(n, old_nodes, None).withColumn("kind", F.lit("node")), allowMissingColumns=True)


def relations(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Map relations (--source) between network points (--with points=), some of which are nodes already (--with nodes=).

    --province and --mode take those rows only; --with ways= (map ways with tags) gives surfaces. Lines are kept.
    """
    rows = _of_mode(_read(spark, options.source), options)
    if options.province:
        rows = rows.where(F.col("province") == options.province)
    points = needed(spark, options, "points")
    points = points.where(F.array_contains("modes", options.mode)) if options.mode and "modes" in points.columns else points
    edges = network_sync.relation_edges(network_sync.relation_lines(rows), points, needed(spark, options, "nodes"))
    if "mode" in rows.columns:
        edges = edges.join(rows.groupBy("relation_id").agg(F.min("mode").alias("mode")), "relation_id")
    ways = given(spark, options, "ways")
    if ways is not None:
        edges = network_sync.with_relation_surface(edges, network_sync.classified_ways(ways))
    edges = store(edges, "relations")
    old = spark.read.parquet(options.stored) if options.stored else edges.where("false")
    return sync.after(network_sync.sync_relations(edges, old, options.prune and not options.mode and not options.province), old, None)


def cities(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Cities of --country with the provinces and regions they need; --with extra= fills what the source lacks.

    A register of the second country (records with gem_name) gets its postcodes of --with postcodes=.
    """
    rows = _read(spark, options.source)
    if "gem_name" in rows.columns:
        rows = imports.registered_cities(rows, given(spark, options, "postcodes"))
    new = imports.city_tables(rows, given(spark, options, "extra"), options.country)
    if not options.stored:
        return new.withColumn("action", F.lit("insert"))
    compare = {c: None for c in ("name", "parent", "postcode")} | {"lat": network_sync.SAME_DEGREES, "lng": network_sync.SAME_DEGREES}
    old = spark.read.parquet(options.stored)
    found = sync.diff(new, old, ["kind", "slug"], compare)
    return sync.after(found.withColumn("action", F.when(F.col("action") == "stale", "keep").otherwise(F.col("action"))), old, None)


def networks(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Networks of an older site; stored ones (--stored, by network_id) are updated and keep their other columns."""
    new = network_sync.described(_read(spark, options.source))
    old = spark.read.parquet(options.stored) if options.stored else new.where("false")
    found = sync.diff(new, old, ["network_id"], {c: None for c in new.columns if c in old.columns and c != "network_id"})
    return sync.after(found.withColumn("action", F.when(F.col("action") == "stale", "keep").otherwise(F.col("action"))), old, None)


def orders(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Runs of subscriptions (--stored) from older orders. --map SUB=ADDRESS-OR-NAME says whose a subscription is, --skip SUB leaves one alone."""
    mapped = spark.createDataFrame([tuple(x.split("=", 1)) for x in options.map], "sub_id string, wanted string") if options.map else None
    return imports.order_backfill(_read(spark, options.source), spark.read.parquet(options.stored), options.overwrite, mapped, options.skip).withColumn("action", F.lit("update"))


def routes(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Routes of an older dump; with starts=, places= and recorded= their start places and nodes, with candidates= and tracks= what else is known."""
    rows = sqldump.read(spark, options.source, options.table or "routes", ROUTE_COLUMNS)
    if options.offset or options.limit is not None:
        rows = rows.orderBy("URL").offset(options.offset)
        rows = rows.limit(options.limit) if options.limit is not None else rows
    starts = given(spark, options, "starts")
    if starts is None:
        return imports.routes(rows).withColumn("action", F.lit("insert"))
    found = imports.imported_routes(rows, starts, needed(spark, options, "places"), needed(spark, options, "recorded"), given(spark, options, "candidates"), given(spark, options, "tracks"))
    return found.withColumn("action", F.lit("insert"))


def newsletter(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Newsletter addresses of an older dump; --with users= finds whose they are."""
    return imports.newsletters(sqldump.read(spark, options.source, options.table or "Nieuwsbrief_voorkeuren", NEWSLETTER_COLUMNS), given(spark, options, "users"))


def places(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Place pages of a --universe of an older dump."""
    rows = sqldump.read(spark, options.source, options.table or "places", PLACE_COLUMNS)
    return imports.place_pages(rows, options.universe, options.limit).withColumn("action", F.lit("insert"))


def proformas(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Lines of open proformas (--source) to subscriptions (--stored), with --with proformas=, links= and invoices=."""
    lines, subs = _read(spark, options.source), spark.read.parquet(options.stored)
    done = proforma.judged(needed(spark, options, "proformas"), lines, proforma.assign(lines, subs, needed(spark, options, "links")), subs, needed(spark, options, "invoices"))
    return done.withColumn("action", F.when(F.col("outcome") == "create", "insert").otherwise(F.col("outcome")))


def statistics(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Partners' statistics (--source: rows of lodgings and months), with --with lodgings=, partners= and, if need be, manual=."""
    rows, unmatched = imports.partner_stats(_read(spark, options.source), needed(spark, options, "lodgings"), needed(spark, options, "partners"), given(spark, options, "manual"))
    return rows.withColumn("action", F.lit("insert")).unionByName(unmatched.withColumn("action", F.lit("unmatched")), allowMissingColumns=True)


def duplicates(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Articles with one slug (slug, published, n_blocks, updated, id): all but the winner go."""
    order = [F.desc("published"), F.desc("n_blocks"), F.desc("updated"), F.asc("id")]
    return winner(_read(spark, options.source), ["slug"], order).withColumn("action", F.when(F.col("keeps"), "keep").otherwise("delete")).drop("keeps")


def drafts(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    found = imports.missing_drafts(_read(spark, options.source))
    return (found.where(F.col("locale") == options.locale) if options.locale else found).withColumn("action", F.lit("insert"))


def surfaces(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Start places whose shares were never measured."""
    rows = _read(spark, options.source)
    unmeasured = (F.coalesce("paved", F.lit(0.0)) == 0) & (F.coalesce("unpaved", F.lit(0.0)) == 0)
    return imports.repaired_surface(rows.withColumn("action", F.when(unmeasured, "update").otherwise("keep")))


JOBS: dict[str, Callable[[SparkSession, argparse.Namespace], DataFrame]] = {
    "users": dump("users", USER_COLUMNS, imports.users, "id"),
    "articles": dump("blogs", ARTICLE_COLUMNS, imports.articles, "id"),
    "routes": routes,
    "newsletter": newsletter,
    "places": places,
    "points": dump("points", POINT_COLUMNS, imports.points_of_interest, "ID"),
    "prospects": prospects,
    "network": network,
    "layer": layer,
    "relations": relations,
    "cities": cities,
    "networks": networks,
    "orders": orders,
    "proformas": proformas,
    "statistics": statistics,
    "duplicates": duplicates,
    "drafts": drafts,
    "surfaces": surfaces,
}
#: Actions whose rows are counted only.
UNWRITTEN = ("delete", "unmatched", "invalid")
#: Jobs over people, which write only with --confirm as well.
CONFIRMED = ("users", "newsletter")


def run(spark: SparkSession, arguments: Sequence[str]) -> dict[str, int]:
    """Runs a job and returns how many rows each action takes."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("--source", required=True)
    parser.add_argument("--stored")
    parser.add_argument("--out")
    parser.add_argument("--table")
    parser.add_argument("--offset", type=int, default=0)
    parser.add_argument("--limit", type=int)
    parser.add_argument("--apply", action="store_true")
    parser.add_argument("--prune", action="store_true")
    parser.add_argument("--confirm", action="store_true")
    parser.add_argument("--overwrite", action="store_true")
    parser.add_argument("--step", type=int, choices=(1, 2), default=1)
    parser.add_argument("--unit", choices=("km", "m"), default="km")
    parser.add_argument("--mode", help="only rows of one mode; nothing is removed then")
    parser.add_argument("--province", help="only rows of one province; nothing is removed then")
    parser.add_argument("--no-osm", action="store_true", help="surfaces without map ways")
    parser.add_argument("--origin", default="")
    parser.add_argument("--locale")
    parser.add_argument("--universe", default="")
    parser.add_argument("--map", action="append", default=[], metavar="SUB=VALUE")
    parser.add_argument("--skip", action="append", default=[], metavar="SUB")
    parser.add_argument("--country", choices=("belgie", "nederland"), default="belgie")
    parser.add_argument("--with", dest="more", action="append", default=[], metavar="NAME=PATH", help="a further table that the job needs")
    options = parser.parse_args(arguments)
    if options.apply and not options.out:
        parser.error("--apply needs --out")
    if options.apply and options.job in CONFIRMED and not options.confirm:
        parser.error(f"{options.job}: --apply needs --confirm as well")
    done = store(JOBS[options.job](spark, options), "job")  # computed once: what is counted is what is written
    counts = {r.action: r.n for r in sync.counters(done).collect()}
    if options.apply:
        done.where(~F.col("action").isin(*UNWRITTEN)).drop("action").write.parquet(options.out)
    discard(done)
    return counts


if __name__ == "__main__":
    import sys

    print(json.dumps(run(SparkSession.builder.getOrCreate(), sys.argv[1:]), sort_keys=True))
