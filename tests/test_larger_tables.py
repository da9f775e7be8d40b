"""What shows on larger tables only: keys that many rows share, places that many rows lie near, grids that grow."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA, TABLES, plain

from wayquarry.functions.text import name_tokens, token_similarity
from wayquarry.operators import match, nearest, stitching, surface, tracks
from wayquarry.plans import billing as billing_plans
from wayquarry.plans import documents, shapes
from wayquarry.plans.registry import ORACLE_SQL, QUERIES
from wayquarry.storage import stored


def copied(spark, tmp_path, **changed):
    """A folder with the tables of sf0.001, some of them replaced."""
    for name in TABLES:
        if name not in changed:
            (tmp_path / f"{name}.parquet").symlink_to(DATA / "sf0.001" / f"{name}.parquet")
    for name, df in changed.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_equal_names_are_joined_once(spark):
    """of the targets of a name one is joined, whatever their number."""
    rows = spark.range(40).select(F.col("id").alias("k"))
    names = F.array(F.lit(None).cast("string"), (F.col("k") % 4).cast("string"), F.lit("2"))
    targets = spark.createDataFrame([(i, str(i % 3), i % 5 > 1) for i in range(60)] + [(None, "3", True), (99, None, True)], "t int, name string, good boolean")
    found = match.first_of_list(rows, "k", names, targets, "name", "t", F.col("good"))
    best = {n: min((not g, i) for i, m, g in ((i, str(i % 3), i % 5 > 1) for i in range(60)) if m == n)[1] for n in "012"}
    assert {r.k: r.t for r in found.collect()} == {k: best.get(str(k % 4), best["2"]) for k in range(40)}
    join = found._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1]
    assert "Aggregate [name" in join or "Aggregate [_name" in join


def test_a_line_takes_the_period(spark, tmp_path):
    """an invoice for another customer that names this one on a line is for its period, as in the SQL."""
    day = lambda *x: dt.datetime(*x)
    orders = [(5, 49, "F", 10.0, day(2001, 2, 3), "x"), (10, 49, "F", 10.0, day(2000, 2, 3), "x"), (3, 50, "F", 10.0, day(2000, 2, 3), "x")]
    customers = [(49, "A", 1, 5.0, "M"), (50, "B", 1, 7.0, "M")]
    sf = copied(spark, tmp_path, orders=spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
                customer=spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"))
    assert {r.sub_id: r.error for r in billing_plans.new_invoices(spark, sf).collect()}[50] == "invoice 5 is for this period"


def test_points_off_a_long_grid(spark, tmp_path):
    """on a grid of more than five degrees the point off the network is still off it."""
    sf = copied(spark, tmp_path, supplier=spark.range(5100).select(F.col("id").alias("s_suppkey"), F.lit("S").alias("s_name"), F.lit(1).alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")))
    found = {r.route_id: r.node_ids for r in shapes.routes_on_network(spark, sf).where("route_id in (0, 3, 6)").collect()}
    assert found == {0: "0,1,2", 3: "3,4,5", 6: "6,7,8"}


def crowded(seed, n, spread):
    """Places in a dense spot, on a line of equal distances, and far around."""
    rng = random.Random(seed)
    of = [lambda: (51 + rng.random() / 1e4, 4 + rng.random() / 1e4), lambda: (51.0, 4 + rng.randrange(40) / 1000), lambda: (51 + rng.uniform(-1, 1) * spread, 4 + rng.uniform(-1, 1) * spread)]
    return [of[i % 3]() for i in range(n)]


@pytest.mark.parametrize("km, spread", [(0.3, 0.05), (None, 30.0)])
def test_closest_divides_crowded_cells(spark, km, spread):
    """the nearest of many in one cell, ties by the least, by number."""
    probes, points = crowded(1, 300, spread), crowded(2, 1500, spread)
    probe = spark.createDataFrame([(i, i % 2, *p) for i, p in enumerate(probes)] + [(-1, 0, None, 4.0)], "k int, nr int, p_lat double, p_lng double")
    sites = spark.createDataFrame([(i, i % 3, *p) for i, p in enumerate(points)], "id int, nr int, lat double, lng double")
    expected = {}
    for k, p in enumerate(probes):
        best = min((stitching.km(p, q), i) for i, q in enumerate(points) if i % 3 == k % 2)
        if km is None or best[0] <= km:
            expected[k] = best[0]
    found = nearest.closest(probe, sites, "k", "id", km, ["nr"])
    got = {r.k: (r.km, r.id) for r in found.collect()}
    assert {k: round(x[0], 9) for k, x in got.items()} == {k: round(x, 9) for k, x in expected.items()}
    for k, (_, i) in got.items():  # the least of equal places
        assert i == min(j for j, q in enumerate(points) if q == points[i] and j % 3 == k % 2)


def test_waypoints_meet_one_node_each(spark):
    """waypoints take the nearest node of their number, wherever it is; those without a place the first one."""
    w = spark.createDataFrame([(1, 1, " 7 ", 51.0, 4.0), (1, 2, "8", 51.0, 4.0), (1, 3, "x", 51.0, 4.0), (1, 4, "7", None, 4.0)], "track_id int, seq int, name string, lat double, lng double")
    n = spark.createDataFrame([(5, "7", 10.0, 4.0), (6, "7", 52.0, 4.0), (7, "7", 52.0, 4.0), (8, "9", 51.0, 4.0)], "id int, number string, lat double, lng double")
    assert sorted((r.seq, r.node_id, r.lat) for r in tracks.waypoint_nodes(w, n).collect()) == [(1, 6, 52.0), (2, None, 51.0), (4, 5, 10.0)]


def test_cells_of_ways_are_not_sent_to_every_task(spark):
    """a way's cells are many times its file; and beyond a pole, where distances are those of the mirrored latitude, cells are no more than before it."""
    point = lambda lat, lng: {"lat": lat, "lng": lng}
    rows = [(1, [point(51.0, 4.0), point(51.01, 4.0)], 1), (2, [point(129.0, 4.0), point(129.01, 4.0)], 0)]
    ways = spark.createDataFrame(rows, "way_id int, path array<struct<lat: double, lng: double>>, code int")
    cells = {r.way_id: r["count"] for r in surface.segment_cells(ways).groupBy("way_id").count().collect()}
    assert cells[2] <= cells[1] * 2
    found = surface.classified(ways.select(F.col("way_id").alias("line_id"), "path"), [ways])
    assert {r.line_id: [x.code for x in r.runs] for r in found.collect()} == {1: [1], 2: [0]}
    plan = surface.matched(surface.steps(ways.select(F.col("way_id").alias("line_id"), "path")), ways)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_names_are_not_sent_to_every_task(spark):
    """no side of the names' joins goes through the driver."""
    subs = spark.createDataFrame([("1", "Huis 0012", "a@b", dt.date(2020, 1, 1)), ("2", "Huis nr0013", None, None)], "sub_id string, sub_name string, sub_email string, start_date date")
    own = spark.createDataFrame([("7", "0012", "a@b", [dt.date(2020, 1, 1)]), ("8", "0013", "c@d", [])], "customer_id string, label string, email string, dates array<date>")
    found = match.fuzzy(subs, own)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.sub_id: r.customer_id for r in found.collect()}["1"] == "7"


def test_few_cells_are_looked_into():
    """most ends of ways have one cell within reach, not 27."""
    ways = [[(51 + i / 1000, 4.0), (51 + (i + 1) / 1000, 4.0)] for i in range(200)]
    ends, looked = stitching.Ends(ways, stitching.TOLERANCE_KM), []
    ends.cells = type("Seen", (dict,), {"get": lambda self, cell: looked.append(cell)})(ends.cells)
    for way in ways:
        ends.first(way[0])
    assert len(looked) < 4 * len(ways)


def test_costly_functions_run_in_many_tasks(spark):
    """a small file is one task for Spark, so its rows are dealt first."""
    least = 2 * spark.sparkContext.defaultParallelism
    for query in (documents.stitched_lines, shapes.text_repairs):
        assert query(spark, str(DATA / "sf0.001")).rdd.getNumPartitions() >= least


def test_settled_matches_are_not_compared_with_all_that_are_alike(spark, monkeypatch):
    """F1 of round 4: each number is alike to hundreds of others; what is written on the way stays in proportion to the names."""
    n, written = 1500, {}

    def counted(df, what):
        found = stored(df, what)
        written[what] = max(found.count(), written.get(what, 0))
        return found

    monkeypatch.setattr(match, "stored", counted)
    number, k = F.lpad(F.col("id").cast("string"), 9, "0"), F.col("id")
    day = F.date_add(F.lit("2000-01-01").cast("date"), k.cast("int"))
    subs = spark.range(n).select(k.cast("string").alias("sub_id"), F.when(k % 3 == 0, F.concat(F.lit("nr"), number)).otherwise(number).alias("sub_name"), F.lit(None).cast("string").alias("sub_email"), F.when(k % 2 == 0, day).alias("start_date"))
    own = spark.range(n).select(k.cast("string").alias("customer_id"), number.alias("label"), F.concat(number, F.lit("@x")).alias("email"), F.array(day).alias("dates"))
    found = {int(r.sub_id): (r.customer_id, r.status) for r in match.fuzzy(subs, own).collect()}
    assert {i: x for i, x in found.items() if i % 2 == 0} == {i: (str(i), "matched") for i in range(0, n, 2)}
    assert {x[1] for i, x in found.items() if i % 2} == {"ambiguous"}  # of 101 and 1001, which have equal bigrams, the lesser text is best
    assert max(written.values()) <= 3 * n, written


@pytest.mark.parametrize("most", [0, 50])
def test_matches_in_stages_equal_the_rule(spark, monkeypatch, most):
    """F1 of round 4: names, addresses (none, too) and dates that many share, against the rule over every pair, with days compared in pairs or not."""
    monkeypatch.setattr(match, "DAY_PAIRS", most)
    monkeypatch.setattr(match, "REACH", 300)
    rng = random.Random(most)
    words, date = "zonne veld molen zicht koppen berg linde kruis".split(), lambda: dt.date(2020, 1, rng.randrange(1, 30))

    def name(i):
        if i % 3 == 0:
            return rng.choice(["", "nr"]) + f"{rng.randrange(300):07}"
        own = list("".join(rng.sample(words, 2)))
        own[rng.randrange(len(own))] = rng.choice("aeiou")
        return "".join(own) if i % 3 == 1 else "Kouter " + " ".join(rng.sample(words, rng.randrange(3)))

    mail = lambda: rng.choice([None, "", f"m{rng.randrange(30)}@x"])
    own = [(f"c{i * 7919 % 97:02}", name(i), mail(), sorted({date() for _ in range(rng.randrange(3))})) for i in range(80)]
    subs = [(f"s{i}", name(i) if i % 2 else rng.choice(own)[1], f" M{rng.randrange(30)}@x" if i % 4 == 0 else None, date() if i % 3 else None) for i in range(80)]
    a = spark.createDataFrame(subs, "sub_id string, sub_name string, sub_email string, start_date date")
    b = spark.createDataFrame(own, "customer_id string, label string, email string, dates array<date>")
    every = a.select("sub_name", name_tokens("sub_name").alias("x")).distinct().crossJoin(b.select("label", name_tokens("label").alias("y")).distinct())
    scores = {(r.sub_name, r.label): r.s for r in every.withColumn("s", token_similarity(F.col("x"), F.col("y"))).collect()}
    expected = {}
    for sub, sub_name, address, start in subs:
        found = []
        for customer, label, email, dates in own:
            score, same_date, same = scores[sub_name, label], start in dates, bool(email) and (address or "").strip().lower() == email
            if score >= 0.6 or (score >= 0.3 and (same or same_date)):
                found.append((-(score + (0.3 if same_date else 0) + (1 if same else 0)), customer, email))
        found.sort(key=lambda x: x[:2])
        rivals = [-t for t, _, email in found if email != found[0][2]]
        expected[sub] = (found[0][1], round(-found[0][0], 9), "ambiguous" if rivals and -found[0][0] - rivals[0] < 0.2 else "matched") if found else (None, None, "unmatched")
    assert {r.sub_id: (r.customer_id, r.total and round(r.total, 9), r.status) for r in match.fuzzy(a, b).collect()} == expected
    assert len({x[2] for x in expected.values()}) == 3


@pytest.mark.parametrize("query", ["track_profiles", "track_distance", "track_samples", "track_repeats"])
def test_tracks_with_unknown_keys_equal_the_sql(spark, tmp_path, query):
    """F2 of round 4: events without a user, a time or a number: last in order, and a track of their own."""
    i = F.col("event_id")
    unknown = lambda name, m, k: F.when(i % m != k, F.col(name)).alias(name)
    events = spark.read.parquet(str(DATA / "sf0.001" / "events.parquet")).select(unknown("event_id", 31, 3), unknown("ts", 13, 5), unknown("user_id", 17, 2), "event_type", "value", "props")
    sf = copied(spark, tmp_path, events=events)
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'; SET threads = 1")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    found, expected = QUERIES[query](spark, sf), db.sql(ORACLE_SQL[query])
    rows = lambda names, own: sorted((tuple(plain(dict(zip(names, r))[n]) for n in sorted(names)) for r in own), key=repr)
    assert rows(found.columns, found.collect()) == rows(expected.columns, expected.fetchall())
