"""Operators on hand-made rows, with the odd cases that each must get right."""

from __future__ import annotations

import datetime as dt
import heapq
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayquarry.functions import geo
from wayquarry.operators import billing, crm, graph, imports, match, nearest, network_sync, proforma, rows, stitching, surface, sync, tracks


def d(text):
    return dt.date.fromisoformat(text)


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def listed(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def test_choosing_rows(spark):
    df = frame(spark, [(1, "a", None, 5), (2, "a", "x", 3), (3, "b", None, 1), (4, None, "y", 1), (5, None, "z", 2)], "id int, k string, v string, n int")
    assert listed(rows.winners(df, ["k"], [F.desc("n")]), "id") == [(1,), (3,), (5,)]
    assert listed(rows.reduced(df, ["k"], F.col("id")), "id") == [(1,), (3,), (4,)]
    assert listed(rows.reduced(df, ["k"], F.col("id"), last=True), "id") == [(2,), (3,), (5,)]
    assert listed(rows.filled_first(df, ["k"], F.col("id"), ["v", "n"])) == [("a", "x", 5), ("b", None, 1), (None, "y", 1)]
    assert listed(rows.preferred_version(df, "k", "v", "z", "x", [F.asc("id")]), "id") == [(2,), (3,), (5,)]
    assert listed(rows.running_quota(df, F.col("n") > 1, [F.asc("id")], 2), "id", "accepted") == [(1, True), (2, True), (3, False), (4, False), (5, False)]
    versions = frame(spark, [("a", None), ("b", d("2020-01-01")), ("b", None)], "k string, published_at date")
    assert listed(rows.published(df, versions, "k"), "id") == [(3,)]


def test_names_stay_unique(spark):
    df = frame(spark, [(1, "Jan"), (2, "jan"), (3, "jan2"), (4, "JAN"), (5, "an")], "id int, name string")
    found = {r.id: r.unique_name for r in rows.unique_names(df, "name", [F.asc("id")]).collect()}
    assert len({x.lower() for x in found.values()}) == 5
    assert found[1] == "Jan"
    assert found[5] == "an"
    assert listed(rows.ordinals(frame(spark, [(1, "a"), (2, "b"), (3, "a")], "id int, k string"), "k", [F.asc("id")]), "id", "unique_key") == [(1, "a_1"), (2, "b"), (3, "a_2")]


def test_filters_and_pages(spark):
    df = spark.range(130).withColumn("name", F.concat(F.lit("N"), F.col("id").cast("string")))
    keep = lambda where: sorted(r.id for r in rows.scan(df, where, ["id"]).collect())
    assert keep({"id": {"gte": 3, "lt": 5}}) == [3, 4]
    assert keep({"or": [{"id": 7}, {"name": {"eqi": "n9"}}], "not": {"id": {"in": [7]}}}) == [9]
    assert keep({"name": {"containsi": "n12", "notNull": True}, "id": {"ne": 120}}) == [12, *range(121, 130)]
    assert keep({"name": None}) == []
    assert rows.page(df, [F.asc("id")]).count() == 25
    big = rows.page(df, [F.asc("id")], 2, 1000).collect()
    assert [r.id for r in big] == list(range(100, 130))
    assert {r.total for r in big} == {130}
    assert rows.search(df, ["name", "id"], " n12 ").count() == 11
    assert listed(rows.without_zeros(frame(spark, [([(0, 1.0), (1, 0.0), (2, None)],)], "a array<struct<i int, v double>>"), "a", "v"), "n_fixed") == [(1,)]
    assert rows.profile(df).count() == 2


def test_diff_is_idempotent(spark):
    new = frame(spark, [(1, "a", 1.0), (2, "b", 2.0), (None, "n", 0.0), (5, None, 5.0)], "id int, s string, x double")
    old = frame(spark, [(1, "a", 1.0000001), (2, "c", 2.0), (3, "z", 3.0), (5, "t", 5.0)], "id int, s string, x double")
    actions = sync.diff(new, old, ["id"], {"s": None, "x": 1e-3})
    assert listed(actions, "id", "action", "changed") == [(1, "keep", []), (2, "update", ["s"]), (3, "stale", []), (5, "update", ["s"]), (None, "insert", [])]
    after = sync.applied(sync.guarded(actions, 1))
    assert listed(after, "id", "s") == [(1, "a"), (2, "b"), (5, None), (None, "n")]
    assert {r.action for r in sync.diff(new, after, ["id"], {"s": None, "x": 1e-3}).collect()} == {"keep"}
    for kept in (sync.guarded(actions, 100), sync.guarded(actions, 1, whole_run=False), sync.guarded(actions, 1, origin=F.col("stored.s") == "other"), sync.guarded(actions, 1, 1.1)):
        assert "delete" not in {r.action for r in kept.collect()}
    assert sync.guarded(sync.diff(new.where("false"), old, ["id"], {"s": None}), 1).where("action = 'delete'").isEmpty()


def test_upserts_and_links(spark):
    old = frame(spark, [(1, "a"), (2, "b")], "k int, v string")
    new = frame(spark, [(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, o int")
    assert listed(sync.upserted(old, new, ["k"], "o"), "k", "v") == [(1, "a"), (2, "d"), (3, "e")]
    assert listed(sync.inserted_if_absent(old, new.select("k", "v").where("v <> 'd'"), ["k"]), "k", "v") == [(1, "a"), (2, "b"), (3, "e")]
    assert listed(sync.linked(old, old)) == [(1, "a"), (2, "b")]
    found = sync.resolved(frame(spark, [("x", None), ("q", "n1"), ("q", "zz")], "key string, nr string"), frame(spark, [(7, "x", "n0"), (9, "y", "n1"), (8, "w", "n1")], "id int, ext string, nr2 string"), [("key", "ext"), ("nr", "nr2")], "id", "hit")
    assert listed(found, "key", "hit") == [("q", 8), ("q", None), ("x", 7)]


def test_matching(spark):
    targets = frame(spark, [("p1", "alpha"), ("p2", "beta"), ("p0", "beta")], "pid string, slug string")
    own = frame(spark, [(1, "alpha-routes", "beta"), (2, None, "gamma"), (3, "", "beta")], "id int, url string, title string")
    found = match.cascade(own, "id", [("url", F.col("url")), ("cut", F.regexp_replace("url", "-routes$", "")), ("title", F.col("title"))], targets, "slug", "pid")
    assert listed(found) == [(1, "p1", "cut"), (3, "p0", "title")]
    assert listed(match.parents(frame(spark, [(1, None), (2, 1), (3, 3), (4, 9)], "id int, parent_id int"))) == [(1, None), (2, 1), (3, None), (4, None)]
    at = frame(spark, [(["1", "2", "3"], ["2", "3"]), (["1"], ["1", "2"]), (["1", "1"], ["1"]), (["1"], [])], "w array<string>, p array<string>").select(match.subsequence_at(F.col("w"), F.col("p")))
    assert [r[0] for r in at.collect()] == [1, None, 0, None]


def test_fuzzy_margin(spark):
    subs = frame(spark, [("s1", "Hotel Koppenberg", "k@x.be", d("2020-01-01")), ("s2", "Zonneveld", None, None), ("s3", "Nergens", None, None), ("s4", "Molenzicht", "m@x.be", None)], "sub_id string, sub_name string, sub_email string, start_date date")
    own = frame(spark, [("c1", "Koppenherberg", "z@z", [d("2020-01-01")]), ("c2", "Zonneveld", "a@a", []), ("c3", "Zonneveld", "b@b", []), ("c4", "Molenzicht", "m@x.be", []), ("c5", "Molenzicht", "other@x", [])], "customer_id string, label string, email string, dates array<date>")
    assert listed(match.fuzzy(subs, own), "sub_id", "customer_id", "status") == [("s1", "c1", "matched"), ("s2", "c2", "ambiguous"), ("s3", None, "unmatched"), ("s4", "c4", "matched")]


def test_fuzzy_against_all_pairs(spark):
    """With over 50 names that share a word on each side, against the rule over every pair."""
    from wayquarry.functions.text import name_tokens, token_similarity

    rng = random.Random(8)
    words = ["zonne", "veld", "molen", "zicht", "koppen", "berg", "linde", "kruis"]
    name = lambda: "Kouter " + " ".join(rng.sample(words, rng.randrange(0, 3)))
    own = [(f"c{i:03}", name(), rng.choice(["", f"m{i}@x.be"]), [d("2020-01-01")] if i % 4 == 0 else []) for i in range(70)]
    own += [("c900", "Zilverduin", "z@x.be", []), ("c901", "Kouter Rozen", "r@x.be", []), ("c902", "Overkoppenbergen", "o@x.be", [])]
    subs = [(f"s{i:02}", name(), None, d("2020-01-01") if i % 3 == 0 else None) for i in range(60)]
    subs += [("s90", "Silverduin", None, None), ("s91", "Kouter Tulpen", " R@x.be", None), ("s92", "Koppenbergen", None, None), ("s93", "Kouter", "m1@x.be", None)]
    a = frame(spark, subs, "sub_id string, sub_name string, sub_email string, start_date date")
    b = frame(spark, own, "customer_id string, label string, email string, dates array<date>")
    every = a.select("sub_name", name_tokens("sub_name").alias("x")).distinct().crossJoin(b.select("label", name_tokens("label").alias("y")).distinct())
    scores = {(r.sub_name, r.label): r.s for r in every.withColumn("s", token_similarity(F.col("x"), F.col("y"))).collect()}
    expected = []
    for sub, sub_name, sub_email, start in subs:
        found = []
        for customer, label, email, dates in own:
            score, date, same = scores[sub_name, label], start in dates, bool(email) and (sub_email or "").strip().lower() == email
            if (same and score >= 0.3) or score >= 0.6 or (score >= 0.3 and date):
                found.append((-(score + 0.3 * date + same), customer, email))
        found.sort()
        rivals = [-t for t, _, email in found[1:] if email != found[0][2]]
        status = "unmatched" if not found else "ambiguous" if rivals and -found[0][0] - rivals[0] < 0.2 else "matched"
        expected.append((sub, found[0][1] if found else None, status))
    got = listed(match.fuzzy(a, b), "sub_id", "customer_id", "status")
    assert sorted(got) == sorted(expected)
    assert {"s90": "c900", "s91": "c901"}.items() <= {s: c for s, c, _ in got}.items()


def test_names_that_are_alike_are_candidates(spark):
    """Random names of few characters, short and long: no pair that is alike by 0.6 is missed."""
    from wayquarry.functions.text import name_tokens, token_similarity

    rng = random.Random(21)
    make = lambda n: "".join(rng.choice("0012") for _ in range(n))

    def changed(x):
        x = list(x)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(x))
            rng.choice([lambda: x.insert(at, rng.choice("012")), lambda: x.__setitem__(at, "2"), lambda: x.pop(at) if len(x) > 1 else None, lambda: x.reverse()])()  # noqa: B023
        return "".join(x)

    base = [make(n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 18, 22) for _ in range(5)]
    names = sorted({*base, *(changed(x) for x in base for _ in range(2))})
    a = frame(spark, [(x,) for x in names], "x string")
    b = frame(spark, [(changed(x),) for x in names], "y string").distinct()
    every = a.withColumn("s", name_tokens("x")).crossJoin(b.withColumn("t", name_tokens("y"))).where(token_similarity(F.col("s"), F.col("t")) >= 0.6)
    expected = {(r.x, r.y) for r in every.select("x", "y").collect()}
    found = {(r.x, r.y) for r in match.strong_pairs(a, b, "x", "y").collect()}
    assert found == expected and len(expected) > 200


def test_few_pairs_of_numbers_are_scored(spark):
    """Zero-padded numbers share most characters; still few pairs beyond those that are alike are looked at."""
    numbers = spark.range(1500).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("n"))
    left = numbers.select(F.when(F.col("n").endswith("3"), F.concat(F.lit("nr"), "n")).otherwise(F.col("n")).alias("x"))
    a, b = match._named(left, "x", "a"), match._named(numbers.withColumnRenamed("n", "y"), "y", "b")
    assert match.candidates(a, b).distinct().count() < 0.05 * 1500 * 1500


def test_nearest_is_exact(spark):
    rng = random.Random(1)
    points = [(i, 51 + rng.random() / 20, 4 + rng.random() / 20) for i in range(300)]
    probe = [(i, 51 + rng.random() / 20, 4 + rng.random() / 20) for i in range(200)]
    found = nearest.nearest(frame(spark, probe, "k int, p_lat double, p_lng double"), frame(spark, points, "id int, lat double, lng double"), "k", "id", 0.3)
    expected = {}
    for k, a, b in probe:
        best = min((stitching.km((a, b), (x, y)), i) for i, x, y in points)
        if best[0] <= 0.3:
            expected[k] = best[1]
    assert {r.k: r.id for r in found.collect()} == expected
    with pytest.raises(ValueError, match="wider"):
        nearest.check_radius(2.0, 0.01)


def simple_graph(spark):
    names = [(1, "1"), (2, ""), (3, "3"), (4, "4"), (5, "-9999"), (6, "6"), (9, "9")]
    nodes = frame(spark, [(i, n, str(51 + i / 1000), "4,5", i == 5) for i, n in names] + [(7, "7", "0", "0", None), (8, "8", None, "", None)], "id long, number string, lat string, lng string, is_virtual boolean")
    km = lambda *x: (*x, None, None, "wandelen", None)
    edges = [km(1, 1, 2, "1,5"), km(2, 2, 3, "1.0"), km(3, 2, 1, "1.5"), km(4, 3, 3, "1"), km(5, 3, 4, "1"), km(6, 1, 5, "4"), km(7, 5, 4, "4"), km(8, 4, 7, "1"), km(9, 6, 9, "2"), km(10, 1, 4, "30"), km(11, 1, 2, "1.506")]
    fixed = [(i, a, b, k, g, s, m, v) for i, a, b, k, g, s, m, v in edges]
    return graph.build(nodes, frame(spark, fixed, "id long, from_id long, to_id long, distance_km string, geometry string, surface array<array<double>>, mode string, is_virtual boolean"))


def test_graph(spark):
    nodes, edges = simple_graph(spark)
    assert listed(edges, "id") == [(1,), (10,), (11,), (2,), (5,), (6,), (7,), (9,)]
    assert listed(nodes, "id", "number", "modes") == [(1, "1", 1), (2, "", 1), (3, "3", 1), (4, "4", 1), (5, "", 1), (6, "6", 1), (9, "9", 1)]
    asked = frame(spark, [(1, 1, 4, "wandelen"), (2, 1, 1, "wandelen"), (3, 1, 9, "wandelen"), (4, 1, 4, "fietsen"), (5, 3, 1, "wandelen"), (6, 1, 7, "wandelen")], "request int, from_id long, to_id long, mode string")
    assert listed(graph.shortest_paths(nodes, edges, asked)) == [(1, 3.5, [1, 2, 3, 4]), (2, 0.0, [1]), (5, 2.5, [3, 2, 1])]
    assert listed(graph.planner_paths(nodes, edges, asked)) == [(1, 8.0, [1, 5, 4], True), (2, 0.0, [1], False), (5, 2.5, [3, 2, 1], False)]
    steps = graph.path_steps(graph.shortest_paths(nodes, edges, asked).withColumn("mode", F.lit("wandelen")).where("request = 5"), edges)
    assert listed(steps, "step", "edge", "reversed") == [(0, 2, True), (1, 1, True)]
    found, counted = graph.edges_in_box(edges, 51.0, 4.0, 52.0, 5.0, "wandelen", most=3)
    assert found.count() == 3
    assert tuple(counted.first()) == (3, True)
    with pytest.raises(ValueError, match="asked"):
        graph.checked_box(51, 4, 52, 4.1)


def test_shortest_paths_against_dijkstra(spark):
    rng = random.Random(4)
    n = 40
    links = {(a, b): round(rng.uniform(0.1, 3), 3) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(90)) if a != b}
    nodes = frame(spark, [(i, "" if i % 3 else str(i + 1)) for i in range(n)], "id long, number string")
    edges = frame(spark, [(k, a, b, w, "fietsen") for k, ((a, b), w) in enumerate(links.items())], "id long, a long, b long, km double, mode string")
    asked = [(k, rng.randrange(n), rng.randrange(n), "fietsen") for k in range(60)]

    def dijkstra(start, end, direct):
        best, heap = {}, [(0.0, start)]
        while heap:
            x, at = heapq.heappop(heap)
            if at in best:
                continue
            best[at] = x
            if direct and at not in (start, end) and at % 3 == 0:
                continue
            for (a, b), w in links.items():
                if at in (a, b):
                    heapq.heappush(heap, (x + w, b if at == a else a))
        return best.get(end)

    for direct in (False, True):
        requests = frame(spark, asked, "request int, from_id long, to_id long, mode string")
        whole, rounds = (listed(graph.shortest_paths(nodes, edges, requests, direct, most), "request", "km", "node_ids") for most in (10**6, 0))
        assert whole == rounds
        found = {r: km for r, km, _ in whole}
        for k, a, b, _ in asked:
            x = dijkstra(a, b, direct)
            assert (k in found) == (x is not None)
            if x is not None:
                assert found[k] == pytest.approx(x, abs=6e-4)


def test_simplification_is_a_subsequence():
    rng = np.random.default_rng(0)
    lat, lng = np.cumsum(rng.normal(size=200)) / 1e4, np.cumsum(rng.normal(size=200)) / 1e4
    keep = graph.kept_points(lat, lng, 1e-4)
    assert keep[0] and keep[-1]
    assert 2 <= keep.sum() < 200
    assert graph.kept_points(lat, lng, 0.0).sum() >= keep.sum()


def test_routes_on_the_network(spark):
    nodes = frame(spark, [(1, "1", 51.0, 4.0, 3), (2, "2", 51.01, 4.0, 3), (3, "2", 51.0101, 4.0, 1)], "id long, number string, lat double, lng double, modes int")
    point = lambda n, o, km, lat: (n, o, km, lat, 4.0)
    data = [(1, "fietsen", None, [point("2", 2, 5.0, 51.0101), point("1", 1, 0.0, 51.0), point("1", 0, 0.0, 51.0)]), (2, "fietsen", 3.0, [point("1", 1, 0.0, 51.0), point("9", 2, 1.0, 52.0)])]
    routes = frame(spark, data, "route_id int, mode string, start_km double, points array<struct<number string, order int, km double, lat double, lng double>>")
    links = graph.route_links(routes, nodes)
    assert listed(links) == [(1, "fietsen", [1, 2], 5.0)]
    assert listed(graph.routes_through(links, frame(spark, [(2,), (5,)], "node_id long"))) == [(1, 1)]


def test_short_runs_are_absorbed():
    assert surface.merge_short([1, 0, 1], [100, 30, 50]) == [(1, 180)]
    assert surface.merge_short([0, 1, 0], [30, 100, 20]) == [(1, 150)]
    assert surface.merge_short([1, 0], [10, 10]) == [(0, 20)]
    assert surface.merge_short([-1], [5]) == [(-1, 5)]
    assert surface.merge_short([1, 0, 1, 0], [50, 30, 50, 90]) == [(1, 130), (0, 90)]


def test_classified_lines(spark):
    line = [{"lat": 51.0, "lng": 4.0}, {"lat": 51.0, "lng": 4.01}]
    half = [{"lat": 51.00005, "lng": 4.0}, {"lat": 51.00005, "lng": 4.005}]
    crossing = [{"lat": 50.999, "lng": 4.007}, {"lat": 51.001, "lng": 4.007}]
    ways = frame(spark, [(1, half, 1), (2, crossing, 0)], f"way_id int, path {geo.PATH}, code int")
    lines = frame(spark, [(1, line), (2, line[:1]), (3, line[:1] * 2)], f"line_id int, path {geo.PATH}")
    found = surface.classified(lines, [ways]).collect()
    assert [r.line_id for r in found] == [1]
    runs = [tuple(x) for x in found[0].runs]
    assert runs[0][0] == 0.0 and runs[-1][1] == 1.0
    assert all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    assert [r[2] for r in runs][:2] == [1, -1]
    assert runs[0][1] == pytest.approx(0.5, abs=0.04)
    tags = frame(spark, [("asphalt;x", None, None), (None, "track", "grade1"), (None, "track", None), ("?", "path", None), (None, "road", None), (None, "river", None)], "s string, h string, t string")
    assert [r[0] for r in tags.select(surface.tag_code(F.col("s"), F.col("h"), F.col("t"))).collect()] == [1, 1, 0, 0, 1, None]


def test_stitching():
    a, b, c = [(51.0, 4.0), (51.0, 4.01)], [(51.0, 4.02), (51.0, 4.01)], [(51.0, 4.0), (51.0, 3.99)]
    line, whole = stitching.stitch([a, b, c, [(1.0, 1.0)]])
    assert whole
    assert line == [(51.0, 3.99), (51.0, 4.0), (51.0, 4.01), (51.0, 4.02)]
    line, whole = stitching.stitch([a, [(52.0, 4.0), (52.0, 4.5)]])
    assert (line[0], whole) == ((52.0, 4.0), False)
    assert stitching.stitch([]) == ([], False)


def test_tracks(spark):
    t0 = dt.datetime(2024, 1, 1, 10)
    data = [(1, i, 51.0 + i / 1000, 4.0, e, t0 + dt.timedelta(minutes=m) if m is not None else None) for i, (e, m) in enumerate([(10.0, None), (None, 0), (15.5, 5), (12.0, 7)])]
    data += [(1, 4, 51.003, 4.0, 12.0, t0), (2, 0, 51.0, 4.0, None, None), (3, 0, 51.0, 4.0, None, t0), (3, 1, 51.0, 4.1, None, t0 - dt.timedelta(minutes=5))]
    points = frame(spark, data, "track_id int, seq int, lat double, lng double, ele double, time timestamp")
    found = {r.track_id: r for r in tracks.profiles(points).collect()}
    assert set(found) == {1, 3}
    assert (found[1].n_points, found[1].gain, found[1].loss, found[1].minutes) == (4, 6, 4, 7)
    assert found[1].distance_km == pytest.approx(0.33, abs=0.01)
    assert (found[3].gain, found[3].loss, found[3].minutes) == (None, None, None)
    assert [p.km for p in found[1].profile][0] == 0.0
    kept = tracks.kept_matches(pd.DataFrame({"seq": [0, 1, 2, 5, 8, 30], "node_id": [1, 1, 2, 1, 2, 1]}))
    assert kept["seq"].tolist() == [0, 2, 30]


def test_written_distances(spark):
    cases = [
        ([0.0, 1.2, 3.0], 3, 3.0, [0.0, 1.2, 3.0]), ([1200.0, 1800.0], 3, 3.0, [0.0, 1.2, 3.0]), ([1.2, 3.0], 3, 3.0, [0.0, 1.2, 3.0]), ([9.0], 4, None, [0.0, 0.003, 0.006, 0.009]),
        ([1.0, 2.0], 5, 3.0, []), ([], 0, None, []), ([2.0, 4.0, 6.0], 3, 4.0, [0.0, 2.0, 4.0]),
    ]
    df = frame(spark, [(i, *c) for i, c in enumerate(cases)], "i int, raw array<double>, n int, e double, x array<double>")
    found = df.orderBy("i").select(tracks.normalised_distances(F.col("raw"), F.col("n"), F.col("e")).alias("km")).collect()
    for r, c in zip(found, cases):
        assert list(r.km) == pytest.approx(c[3])


def test_candidates_follow_each_other():
    base = {"route_id": 1, "expected_gap_km": 0.0}
    data = pd.DataFrame([
        {**base, "place": 0, "candidate_id": 1, "lat": 51.0, "lng": 4.0, "route_index": 0.0, "route_metres": 10.0},
        {**base, "place": 1, "candidate_id": 2, "lat": 51.3, "lng": 4.0, "route_index": 90.0, "route_metres": 10.0},
        {**base, "place": 1, "candidate_id": 3, "lat": 51.01, "lng": 4.0, "route_index": 10.0, "route_metres": 20.0},
        {**base, "place": 1, "candidate_id": 4, "lat": 51.0, "lng": 4.0, "route_index": 3.0, "route_metres": 900.0},
        {**base, "place": 2, "candidate_id": 5, "lat": 51.02, "lng": 4.0, "route_index": 1.0, "route_metres": 0.0},
    ])
    assert tracks.choose_candidates(data)["candidate_id"].tolist() == [1, 3, 5]


SUBS = "sub_id string, name string, package string, status string, start_date date, first_run date, last_run date, run_count int, price double, discount double, last_invoice string"
INVOICES = "invoice_id int, number long, sub_id string, line_subs array<string>, status string, period_start date, due_date date, paid_at date, total_incl double, renewed boolean, history string"


def billing_case(spark):
    subs = [
        ("a", "A", "Gold", "active", d("2020-01-31"), None, d("2023-01-31"), 3, 100.0, None, "9"), ("b", "B", "Gold", "active", d("2020-01-01"), d("2020-02-01"), None, None, 50.0, 10.0, None),
        ("c", "C", "Free", "active", d("2020-01-01"), None, None, 0, 0.0, None, None), ("d", "D", None, "active", None, None, None, None, None, None, None), ("e", "E", "Gold", "ended", d("2020-01-01"), None, None, 0, 1.0, None, None),
    ]
    inv = [(1, 9, "a", None, "paid", d("2023-01-31"), d("2023-03-01"), d("2023-02-01"), 121.0, True, None), (2, 10, "x", ["b", None, "b"], "sent", d("2020-02-01"), d("2020-03-01"), None, 60.5, False, "old")]
    return frame(spark, subs, SUBS), frame(spark, inv, INVOICES)


def test_billing(spark):
    subs, inv = billing_case(spark)
    as_of = F.lit("2024-01-10").cast("date")
    over = billing.overview(subs, inv, as_of)
    assert listed(over, "sub_id", "next_run", "due", "overdue", "pending_number", "latest_number") == [
        ("a", d("2024-01-31"), True, False, None, 9), ("b", d("2020-02-01"), False, False, 10, 10), ("c", d("2020-01-01"), False, False, None, None), ("d", None, False, False, None, None), ("e", d("2020-01-01"), False, False, None, None)]
    assert tuple(billing.kpis(over, inv, as_of).first()) == (1, 1, 60.5, 1, 0.0)
    asked = frame(spark, [("a", None, None, None), ("b", None, None, None), ("d", None, None, None), ("zz", 1.0, None, None)], "sub_id string, price double, discount double, period_start date")
    new = billing.new_invoices(over, inv, asked, as_of)
    assert listed(new, "sub_id", "error", "number", "period_end", "total_incl") == [("a", None, 11, d("2025-01-30"), 121.0), ("b", None, 12, d("2021-01-31"), 54.45), ("d", "no price", None, None, None), ("zz", "unknown subscription", None, None, None)]
    done = billing.transitions(inv, frame(spark, [(2, "paid", None), (1, "cancelled", None)], "invoice_id int, new_status string, paid_at date"), as_of)
    assert listed(done, "invoice_id", "status", "renewal", "renewed", "paid_at", "history") == [(1, "cancelled", "undo", False, d("2023-02-01"), "cancelled"), (2, "paid", "renew", True, d("2024-01-10"), "old\npaid on 10/01/2024")]
    grown = billing.renewed(subs, inv.where("invoice_id = 2"))
    assert listed(grown.where("sub_id = 'b'"), "first_run", "last_run", "run_count", "last_invoice") == [(d("2020-02-01"), d("2020-02-01"), 1, "10")]
    back = billing.undone(subs, inv, inv.where("invoice_id = 1").withColumn("before", F.lit(None).cast("struct<first_run: date, last_run: date, run_count: int, last_invoice: string>")))
    assert listed(back.where("sub_id = 'a'"), "last_run", "run_count", "last_invoice") == [(d("2022-01-31"), 2, None)]
    off = billing.switched(subs.withColumn("end_date", F.lit(None).cast("date")), frame(spark, [("a", False)], "sub_id string, online boolean"), as_of)
    assert listed(off.where("sub_id < 'c'"), "sub_id", "status", "end_date") == [("a", "ended", d("2024-01-09")), ("b", "active", None)]


def test_crm(spark):
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    at = dt.datetime(2024, 5, 1, 8)
    p = frame(spark, [(1, "a@b", "new", None, None, None, None, "t" * 12), (2, "", "new", None, None, 1, None, "u" * 12), (3, "c@d", "new", None, at, 2, None, "short"), (4, "e@f", "partner", None, None, None, None, None), (5, "g@h", "new", at, None, None, None, None), (6, "i@j", "mailed", None, None, None, None, None), (7, "k@l", "new", None, None, None, None, None)],
              "prospect_id int, email string, stage string, unsubscribed_at timestamp, last_mailed_at timestamp, mail_count int, follow_up_on date, token string")
    queue = crm.mail_queue(p, "first", now, per_day=3)
    assert listed(queue, "prospect_id", "accepted", "reason", "wait_seconds") == [(1, True, None, 0), (2, False, "no address", None), (3, True, None, 20), (4, False, "stage partner", None), (5, False, "unsubscribed", None), (6, False, "mailed already, stage mailed", None), (7, False, "day's limit reached", None)]
    assert listed(crm.mailed(p, queue.where("accepted"), "first", now).where("prospect_id = 1"), "stage", "mail_count", "follow_up_on") == [("mailed", 1, d("2024-05-11"))]
    gone = crm.unsubscribed(p, frame(spark, [("t" * 12,), ("short",)], "token string"), now)
    assert listed(gone.where("stage = 'do_not_contact'"), "prospect_id") == [(1,)]
    reviews = frame(spark, [("u1", "r1", "approved")], "user_id string, target_id string, review_status string")
    new = frame(spark, [("u1", "r1", 5.0, "long enough text", None), ("u2", "r1", 6.0, "long enough text", None), ("u2", "r2", 4.0, "short", None), ("u3", "r1", 4.0, "long enough text", "2025-01-01"), ("u4", "r1", 4.0, "long enough text", "2024-05-01")], "user_id string, target_id string, rating double, text string, visited_on string")
    assert listed(crm.submitted(reviews, new, now), "user_id", "error") == [("u1", "reviewed already"), ("u2", "rating must be 1 to 5"), ("u2", "text too short"), ("u3", "no valid date"), ("u4", None)]


def test_newsletter(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    subs = frame(spark, [("a@b", "pending", sha("t1"), dt.datetime(2024, 5, 2)), ("c@d", "pending", sha("t2"), dt.datetime(2024, 4, 1)), ("e@f", "subscribed", None, None), ("g@h", "subscribed", None, None)], "email string, status string, token_hash string, expires_at timestamp")
    events = frame(spark, [("A@b ", "confirm", "t1"), ("c@d", "confirm", "t2"), ("e@f", "unsubscribe", None), ("g@h", "subscribe", "x"), ("new@x", "subscribe", "t9"), ("no@x", "unsubscribe", None)], "email string, event string, token string")
    assert listed(crm.newsletter(subs, events, now), "email", "status", "outcome") == [("a@b", "subscribed", "ok"), ("c@d", "pending", "expired"), ("e@f", "unsubscribed", "ok"), ("g@h", "subscribed", None), ("new@x", "pending", "ok")]
    asked = frame(spark, [("u1", "a@b", dt.datetime(2024, 5, 1), sha("k"), "k"), ("u2", "c@d", dt.datetime(2024, 5, 1), sha("k"), "no"), ("u3", "e@f", dt.datetime(2024, 4, 1), sha("k"), "k")], "user_id string, email string, sent_at timestamp, token_hash string, given string")
    left = crm.without_users(frame(spark, [("u1", "z@z"), ("u9", "a@b"), ("u2", "c@d"), (None, None)], "user_id string, email string"), crm.deletions(asked, now))
    assert listed(left, "user_id") == [("u2",), (None,)]
    edits = crm.changed_fields(frame(spark, [(1, "a", None)], "id int, x string, y string"), frame(spark, [(1, "a", "b")], "id int, x string, y string"), "id", ["x", "y"])
    assert listed(edits) == [(1, ["y"])]
    assert listed(crm.profiles_upserted(frame(spark, [(1, "a", "b")], "user_id int, x string, y string"), frame(spark, [(1, "c"), (2, "d")], "user_id int, x string")), "user_id", "x", "y") == [(1, "c", "b"), (2, "d", None)]


def test_proformas(spark):
    lines = frame(spark, [(1, 1, 7, "Zonneveld", 10.0, None), (1, 2, 7, "Zonneveld", 10.0, None), (2, 3, 8, "Molenzicht", 10.0, None), (3, 4, 9, "Twijfel Gent", 5.0, None), (4, 5, 9, "Twijfel Gent", 5.0, None), (4, 6, 10, "Twijfel Ieper", 5.0, None)], "proforma_id long, line_id long, lodging_id int, line_name string, price double, period_start date")
    subs = frame(spark, [("s1", "Zonneveld", None), ("s2", "Other", None), ("s3", "Twijfel Gent Noord", None), ("s4", "Twijfel Gent Zuid", None)], "sub_id string, sub_name string, next_run date")
    found = proforma.assign(lines, subs, frame(spark, [(8, "s2")], "lodging_id int, sub_id string"))
    assert listed(found, "line_id", "sub_id", "problem") == [(1, "s1", None), (3, "s2", None), (4, None, "ambiguous"), (5, "s4", None), (6, None, "no subscription")]


def test_imports(spark):
    cities = imports.cities(frame(spark, [("Liège", None, "Liège", "W", None, None, 1), ("LIEGE", "4000", None, None, 50.6, 5.5, 2), (" ", "1", None, None, None, None, 3)], "municipality string, postcode string, province string, region string, lat double, lng double, ordinal int"))
    assert listed(cities, "slug", "name", "postcode", "lat") == [("liege", "Liège", "4000", 50.6)]
    users = imports.users(frame(spark, [(1, "A@b.c", "jan", "$2y$10$" + "x" * 53, "2020-01-01", "1", None), (2, "jan", "x@y.z", "", "0000-00-00", "0", None), (3, "a@b.c", "dup", "", None, "1", None), (4, "bad", "bad2", "", None, None, None)], "id int, email string, username string, password string, created string, newsletter string, unsubscribed string"))
    assert "password" not in users.columns
    assert listed(users, "id", "email", "username", "password_kind", "newsletter") == [(1, "a@b.c", "jan", "bcrypt", "subscribed"), (2, "x@y.z", "jan-2", "unknown", "unsubscribed")]
    routes = imports.routes(frame(spark, [("1", "Route A", "a b", "12,5", "1 - 2 - 3", "5,0 7,5", "1u30", "3", "City Bike", "ja"), ("0", "x", "y", "1", "", "", "", "", "", "")], "Status string, Titel string, URL string, Afstand string, Knooppunten string, Afstanden string, Duur string, Niveau string, Type string, Hond string"), {"dogs": "Hond"})
    assert listed(routes, "slug", "distance_km", "minutes", "difficulty", "node_numbers", "node_km", "tags", "dogs") == [("a-b", 12.5, 90, "moderate", ["1", "2", "3"], [0.0, 5.0, 12.5], ["Stadsfietsroute"], True)]
    points = imports.points_of_interest(frame(spark, [("5", "Oude Molen", None, "", "<p>x</p>")], "ID string, Title string, Title2 string, Type string, Description string"))
    assert listed(points, "old_point_id", "kind") == [(5, "Gebouwen")]
    new = imports.prospects(frame(spark, [("n1", "x" * 300, "A@B.c", "51,2", "7"), ("n2", None, "bad", None, None)], "n string, c string, e string, la string, i string"))
    assert [(r.name, len(r.city), r.email, r.lat) for r in new.collect()] == [("n1", 255, "a@b.c", 51.2)]
    drafts = imports.missing_drafts(frame(spark, [("d1", "nl", d("2020-01-01")), ("d2", "nl", d("2020-01-01")), ("d2", "nl", None)], "document_id string, locale string, published_at date"))
    assert listed(drafts) == [("d1", "nl")]


def test_orders_move_runs_on(spark):
    orders = frame(spark, [("Zonneveld &amp; Zn", "Z@z.be ", "logies", "ok", "2021-03-01", 1, "Periode 05-04-2021 tot 04-04-2022"), ("Zonneveld & Zn", "z@z.be", "logies", "ok", "2022-03-01", 2, None), ("Zonneveld & Zn", "z@z.be", "logies", "credit", "2029-03-01", 3, None)], "name string, email string, type string, status string, date string, number int, reference string")
    subs = frame(spark, [("s1", "Zonneveld", "z@z.be", d("2020-04-05"), None, d("2021-01-01"), None), ("s2", "Elders", None, d("2020-04-05"), None, None, None)], "sub_id string, sub_name string, sub_email string, start_date date, first_run date, last_run date, run_count long")
    assert listed(imports.order_backfill(orders, subs)) == [("s1", d("2021-04-05"), d("2022-04-05"), 2)]


def test_network_sync(spark):
    point = lambda i, p, lng=4.0: (i, f'{{"type":"Point","coordinates":[{lng},51.0]}}', p)
    features = frame(spark, [point("f1", {"Knoopnr": "12", "naam": "A"}), point(None, {"objectid": "o2", "lat": "51,5", "x": "4,5"}), point("f1", {"knoopnr": "13"}, 4.1), (None, None, {})], "id string, geometry string, properties map<string, string>")
    nodes = network_sync.feature_nodes(features)
    assert listed(nodes, "external_id", "number", "lat", "lng") == [("f1", "12", 51.0, 4.0), ("o2", None, 51.5, 4.5)]
    stored = nodes.withColumn("id", F.when(F.col("external_id") == "f1", 1).otherwise(2)).withColumn("number", F.coalesce("number", F.lit("7")))
    assert {r.action for r in network_sync.sync_nodes(nodes, stored.select(*nodes.columns)).where("external_id = 'f1'").collect()} == {"keep"}
    line = frame(spark, [("c1", '{"type":"LineString","coordinates":[[4,51],[4.1,51]]}', {"van": "f1", "naar": "7", "afstand": "1500"}), ("c2", None, {"van": "f1", "naar": "zz"})], "id string, geometry string, properties map<string, string>")
    ready = network_sync.with_ends(network_sync.feature_connections(line, "m"), stored)
    assert listed(ready, "external_id", "from_id", "to_id", "distance_km") == [("c1", 1, 2, 1.5), ("c2", 1, None, None)]
    old = ready.select("external_id", "from_id", "to_id", "distance_km", "geometry").where("false")
    assert listed(network_sync.sync_connections(ready, old), "external_id", "action") == [("c1", "insert")]
    layer = frame(spark, [("p", 1, "a", "b", "WNW Bronbossen|x", "0", 1234.4, None), ("p", 2, "a", "c", "y", "1", 1.0, None)], "pid string, objectid int, begin_geoid string, end_geoid string, naam string, virtual string, shape_length double, geometry string")
    keyed = network_sync.layer_connections(layer, "tv:")
    assert listed(keyed, "external_id", "from_key", "distance_km", "is_virtual") == [("tv:p_1", "tv:a", 1.234, False), ("tv:p_2", "tv:a", 0.001, True)]
    named = network_sync.with_network(keyed, frame(spark, [(1, "Bronbossen", False), (2, "Wandelnetwerk Bronbossen", True)], "network_id int, title string, published boolean"))
    assert listed(named, "external_id", "network_id") == [("tv:p_1", 2), ("tv:p_2", None)]
    assert listed(network_sync.unmatched_names(named)) == [("y", 1)]
    path = [{"lat": 51.0, "lng": 4.0}, {"lat": 51.01, "lng": 4.0}]
    lines = network_sync.relation_lines(frame(spark, [(1, [path]), (2, [])], f"relation_id int, ways array<{geo.PATH}>"))
    assert listed(lines, "relation_id", "whole") == [(1, True)]
    spots = frame(spark, [(10, 51.0001, 4.0), (11, 51.0101, 4.0)], "point_id int, lat double, lng double")
    edges = network_sync.relation_edges(lines, spots, frame(spark, [(5, 51.0001, 4.0001)], "node_id int, lat double, lng double"))
    assert listed(edges, "relation_id", "from_point", "to_point", "from_node", "to_node") == [(1, 10, 11, 5, None)]
    cover = frame(spark, [(2.0, [(0.0, 0.5, 1), (0.5, 1.0, -1)]), (2.0, [(0.0, 1.0, 0)])], "distance_km double, surface array<struct<from: double, to: double, code: int>>")
    assert tuple(network_sync.coverage(cover).first()) == pytest.approx((4.0, 75.0, 100 / 3))


def test_reports_on_groups(spark):
    df = frame(spark, [(1, "a", True, 5), (2, "a", False, 9), (3, "b", True, 1), (4, "c", True, 3), (5, "c", True, 2)], "id int, slug string, live boolean, blocks int")
    assert listed(rows.overruled(df, ["slug"], [F.desc("live"), F.desc("blocks")], "blocks")) == [("a", 2, 5, True), ("c", 2, 3, False)]
    assert listed(rows.inconsistent(df, "slug", ["live"])) == [("a", 2)]
    stored = frame(spark, [("x.jpg", "f", 10.0004)], "name string, folder string, kb double")
    new = frame(spark, [("x.jpg", "f", 10.0001), ("x.jpg", "g", 10.0), ("x.jpg", "g", 10.0)], "name string, folder string, kb double")
    assert listed(rows.not_yet_stored(new, stored)) == [("x.jpg", "g", 10.0)]


def test_letters(spark):
    inv = frame(spark, [(1, "s", "Jo", 123, 12.5, d("2024-01-05")), (2, "t", None, 9, 1.0, None)], "invoice_id int, sub_id string, name string, number long, total_incl double, due_date date")
    pages = frame(spark, [("s", "fr", True, "/fr"), ("s", "nl", True, "/nl"), ("s", "nl", False, "/a")], "sub_id string, locale string, published boolean, url string")
    assert listed(billing.letters(inv, pages, "{name} {number} {amount} {due} {page} {other}"), "text") == [(" 9 € 1,00   {other}",), ("Jo 123 € 12,50 05/01/2024 /nl {other}",)]
    routes = frame(spark, [(1, "g", 0.0), (2, "g", 5.0), (3, "h", None)], "route_id int, gpx_id string, surface_percent double")
    shares = frame(spark, [(1, "g", 40.0), (2, "g", 40.0), (3, "other", 40.0)], "route_id int, gpx_id string, percent double")
    assert listed(billing.measured_share(routes, shares), "route_id", "surface_percent") == [(1, 40.0), (2, 5.0), (3, None)]


def test_jobs_write_only_when_told(spark, tmp_path):
    from wayquarry import jobs

    (tmp_path / "d.sql").write_text("INSERT INTO `users` VALUES (1,'a@b.c','an','','2020-01-01','1',NULL),(2,'x@y.z','an','','','0',NULL);")
    args = ["users", "--source", str(tmp_path / "d.sql"), "--out", f"{tmp_path}/out"]
    assert jobs.run(spark, args) == {"insert": 2}
    assert not (tmp_path / "out").exists()
    assert jobs.run(spark, [*args, "--limit", "1", "--offset", "1", "--apply", "--confirm"]) == {"insert": 1}
    assert [r.username for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["an"]
    with pytest.raises(SystemExit):
        jobs.run(spark, [*args, "--apply"])
    (tmp_path / "n.json").write_text('{"type":"FeatureCollection","features":[{"id":"1","geometry":{"type":"Point","coordinates":[4,51]},"properties":{"nr":"5"}}]}')
    assert jobs.run(spark, ["network", "--source", str(tmp_path / "n.json"), "--out", f"{tmp_path}/n", "--apply"]) == {"insert": 1}
    assert jobs.run(spark, ["network", "--source", str(tmp_path / "n.json"), "--stored", f"{tmp_path}/n", "--prune"]) == {"keep": 1}


def test_other_jobs(spark, tmp_path):
    from wayquarry import jobs

    def put(name, data, schema):
        frame(spark, data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}"

    towns = put("towns", [("Gent", "9000", "Oost", "V", 51.0, 3.7, 1), ("GENT", None, None, None, None, None, 2)], "municipality string, postcode string, province string, region string, lat double, lng double, ordinal int")
    assert jobs.run(spark, ["cities", "--source", towns, "--out", f"{tmp_path}/cities", "--apply"]) == {"insert": 3}
    assert jobs.run(spark, ["cities", "--source", towns, "--stored", f"{tmp_path}/cities"]) == {"keep": 3}
    blogs = put("blogs", [("a", True, 3, 1, 1), ("a", True, 5, 1, 2), ("b", False, 1, 1, 3)], "slug string, published boolean, n_blocks int, updated int, id int")
    assert jobs.run(spark, ["duplicates", "--source", blogs]) == {"keep": 2, "delete": 1}
    nodes = put("nodes", [(1, "n1", "1"), (2, "n2", "2")], "id int, external_id string, number string")
    (tmp_path / "c.json").write_text('{"type":"FeatureCollection","features":[{"id":"c1","geometry":null,"properties":{"from":"n1","to":"2","distance":"1500"}}]}')
    assert jobs.run(spark, ["network", "--step", "2", "--unit", "m", "--source", f"{tmp_path}/c.json", "--with", f"nodes={nodes}"]) == {"insert": 1}
    edges = put("edges", [("p", 1, "a", "b", "x", "0", 1234.4, None)], "pid string, objectid int, begin_geoid string, end_geoid string, naam string, virtual string, shape_length double, geometry string")
    spots = put("spots", [("tv:a", "1", 51.0, 4.0, False)], "external_id string, number string, lat double, lng double, is_virtual boolean")
    assert jobs.run(spark, ["layer", "--source", edges, "--origin", "tv:", "--with", f"nodes={spots}"]) == {"insert": 2}
    starts = put("starts", [(1, 0.0, None), (2, 5.0, 0.0)], "id int, paved double, unpaved double")
    assert jobs.run(spark, ["surfaces", "--source", starts]) == {"update": 1, "keep": 1}


def test_proformas_are_judged_once(spark):
    day = d("2024-01-01")
    pro = frame(spark, [(1, 100, day), (2, 200, day), (3, 300, day), (4, 400, None), (5, 500, day), (6, 600, day)], "proforma_id long, number long, period_start date")
    lines = frame(spark, [(k, k * 10, None if k == 6 else 5.0) for k in range(1, 7)], "proforma_id long, line_id long, price double")
    done = frame(spark, [(1, 10, "a", "name", None), (2, 20, "b", "name", None), (3, 30, None, None, "ambiguous"), (4, 40, "c", "name", None), (5, 50, "d", "name", None), (6, 60, "d", "name", None)], "proforma_id long, line_id long, sub_id string, how string, problem string")
    subs = frame(spark, [("a", None, None), ("b", None, day), ("c", None, None), ("d", None, d("2023-01-01"))], "sub_id string, next_run date, last_run date")
    inv = frame(spark, [(100, "x", day, "sent"), (7, "d", day, "sent"), (8, "a", day, "cancelled")], "number long, sub_id string, period_start date, status string")
    assert listed(proforma.judged(pro, lines, done, subs, inv), "proforma_id", "outcome") == [(1, "exists"), (2, "paid"), (3, "unmatched"), (4, "no period"), (5, "duplicate"), (6, "unmatched")]
    assert listed(proforma.judged(pro.where("proforma_id = 1"), lines, done, subs, inv.where("number = 8")), "proforma_id", "outcome") == [(1, "create")]


def test_routes_as_a_whole(spark):
    rows_ = frame(spark, [("1", "Route A", "a b", "12,5", "1 - 2", "5,0")], "Status string, Titel string, URL string, Afstand string, Knooppunten string, Afstanden string")
    starts = frame(spark, [("a-b", "Kerk", 51.0, 4.0, "Gent", "Oost", "BE", None, 1), ("a-b", "KERK", 51.0, 4.0, "Gent", None, None, 2.0, 2)], "slug string, name string, latitude double, longitude double, city string, province string, country string, distance_km double, ordinal int")
    places = frame(spark, [(5, "Gent", "West", "Belgium"), (6, "Gent", "Oost", "Belgium")], "place_id int, name string, province string, country string")
    recorded = frame(spark, [("a-b", [("9", 1.0, 1.0), ("1", 51.0, 4.0), ("2", 51.1, 4.0)])], "slug string, nodes array<struct<number: string, lat: double, lng: double>>")
    r = imports.placed_routes(rows_, starts, places, recorded).collect()
    assert [(x.name, x.place_id, x.distance_km) for x in r[0].starts] == [("Kerk", 6, 2.0)]
    assert [n.number for n in r[0].nodes] == ["1", "2"]
    pages = imports.place_pages(frame(spark, [("u", "T", "Gent x", "<h2>a</h2><p>b</p>"), ("v", "T", "y", "")], "Universe string, Titel string, URL string, Description string"), "u").collect()
    assert [(p.slug, p.sections[0].title) for p in pages] == [("gent-x", "a")]
    points = frame(spark, [("A", 1, None), ("B", 2, "x"), ("C", None, None)], "title string, image int, image_alt string")
    assert listed(imports.repaired_alt_texts(points), "title", "outcome", "image_alt") == [("A", "fixed", "A"), ("B", "already", "x"), ("C", "no image", None)]


def test_names_of_areas(spark):
    rows_ = frame(spark, [("Antwerpen", "2000", "Anvers", None, 51.2, 4.4, 1), ("Mechelen", "2800", "Antwerpen", "Flanders", 51.0, 4.5, 2), ("Luik", "4000", "Luik", "Waals Gewest", None, None, 3), ("Elders", None, "Nergens", None, None, None, 4), ("LiÃ¨ge", "4000", None, None, None, None, 5)], "municipality string, postcode string, province string, region string, lat double, lng double, ordinal int")
    found = imports.city_tables(rows_)
    assert listed(found.where("kind = 'province'"), "slug", "name", "parent") == [("antwerpen", "Antwerpen", "vlaanderen"), ("liege", "Liege", "waals-gewest"), ("nergens", "Nergens", None)]
    assert listed(found.where("kind = 'region'"), "slug", "name") == [("vlaanderen", "Vlaanderen"), ("waals-gewest", "Waals Gewest")]
    assert listed(found.where("kind = 'city'"), "slug", "parent") == [("antwerpen", "antwerpen"), ("elders", "nergens"), ("liege", None), ("luik", "liege"), ("mechelen", "antwerpen")]


def test_cities_of_a_register(spark):
    square = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[5,52],[5.2,52],[5.2,52.2],[5,52.2],[5,52]]]}}'
    many = '{"geometry":{"type":"MultiPolygon","coordinates":[[[[4,51],[4.2,51],[4.1,51.3],[4,51]]]]}}'
    records = frame(spark, [(["Dokkum"], ["Fryslân"], None, square), (["Breda"], ["North Brabant"], (4.7, 51.6), many), (["Goes"], ["Zeeland"], None, many), ([], ["Utrecht"], None, None)], "gem_name array<string>, prov_name array<string>, geo_point_2d struct<lon: double, lat: double>, geo_shape string")
    codes = frame(spark, [("Dokkum", "9102"), ("DOKKUM", "9101"), ("Breda", " ")], "gem_name string, pc4_code string")
    found = imports.city_tables(imports.registered_cities(records, codes), None, "nederland")
    assert [(a, b, c, round(d, 6), round(e, 6)) for a, b, c, d, e in listed(found.where("kind = 'city'"), "slug", "parent", "postcode", "lat", "lng")] == [("breda", "noord-brabant", None, 51.6, 4.7), ("dokkum", "friesland", "9101", 52.1, 5.1), ("goes", "zeeland", None, 51.1, 4.1)]
    assert listed(found.where("kind = 'province'"), "slug", "name") == [("friesland", "Friesland"), ("noord-brabant", "Noord-Brabant"), ("zeeland", "Zeeland")]


def test_texts_in_a_wrong_encoding(spark):
    given = {"LiÃ¨ge": "Liège", "Li\ufffdge": "Liège", "LI\ufffdGE": "Liège", "Liége": "Liège", "Genève": "Genève", "Ath": "Ath", "CafÃ© Ã\u0089t": "Café Ét", "Ä\u008c": "Č", "x\ufffdy": "xéy", "â\u0082¬": "€", "": ""}
    from wayquarry.functions import text

    df = frame(spark, [(k,) for k in given] + [(None,)], "x string")
    assert {r.x: r.y for r in df.select("x", text.repaired("x").alias("y")).collect()} == given | {None: None}


def test_network_jobs_in_a_row(spark, tmp_path):
    """Step 1 feeds step 2; a rerun keeps ids and columns of its own; a layer and relations keep lines, networks and surfaces; filters filter."""
    import json

    from wayquarry import jobs

    def put(name, data, schema):
        frame(spark, data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}"

    def collection(name, features):
        (tmp_path / name).write_text(json.dumps({"type": "FeatureCollection", "features": features}))
        return f"{tmp_path}/{name}"

    point = lambda i, n, lng: {"type": "Feature", "id": i, "geometry": {"type": "Point", "coordinates": [lng, 51.0]}, "properties": {"nr": n}}
    nodes = collection("n.json", [point("a", "1", 4.0), point("b", "2", 4.1)])
    line = {"type": "LineString", "coordinates": [[4.0, 51.0], [4.1, 51.0]]}
    lines = collection("c.json", [{"type": "Feature", "id": "c1", "geometry": line, "properties": {"from": "a", "to": "2", "distance": "1500"}}])
    assert jobs.run(spark, ["network", "--source", nodes, "--out", f"{tmp_path}/n1", "--apply"]) == {"insert": 2}
    assert jobs.run(spark, ["network", "--step", "2", "--unit", "m", "--source", lines, "--with", f"nodes={tmp_path}/n1", "--out", f"{tmp_path}/c1", "--apply"]) == {"insert": 1}
    ids = dict(listed(spark.read.parquet(f"{tmp_path}/n1"), "external_id", "id"))
    c = spark.read.parquet(f"{tmp_path}/c1").first()
    assert sorted(ids.values()) == [1, 2] and (c.from_id, c.to_id, c.distance_km, json.loads(c.geometry)) == (ids["a"], ids["b"], 1.5, line)
    own = spark.read.parquet(f"{tmp_path}/n1").withColumn("note", F.concat(F.lit("of "), "external_id"))
    own.write.parquet(f"{tmp_path}/n2")
    more = collection("m.json", [point("a", "9", 4.0), point("b", "2", 4.1), point("z", "3", 4.2)])
    assert jobs.run(spark, ["network", "--source", more, "--stored", f"{tmp_path}/n2", "--out", f"{tmp_path}/n3", "--apply"]) == {"insert": 1, "keep": 1, "update": 1}
    assert listed(spark.read.parquet(f"{tmp_path}/n3"), "external_id", "id", "number", "note") == [("a", ids["a"], "9", "of a"), ("b", ids["b"], "2", "of b"), ("z", 3, "3", None)]

    edge = lambda pid, a, b, mode, lat: (pid, 1, a, b, "WNW Bronbossen|x", "0", 7000.0, json.dumps({"type": "LineString", "coordinates": [[4.0, lat], [4.1, lat]]}), mode)
    edges = put("edges", [edge("p", "a", "b", "walk", 51.0), edge("q", "b", "a", "bike", 51.2)], "pid string, objectid int, begin_geoid string, end_geoid string, naam string, virtual string, shape_length double, geometry string, mode string")
    spots = put("spots", [("tv:a", "1", 51.0, 4.0, False), ("tv:b", "2", 51.0, 4.1, False)], "external_id string, number string, lat double, lng double, is_virtual boolean")
    nets = put("nets", [(7, "Bronbossen", True)], "network_id int, title string, published boolean")
    path = lambda lat: [{"lat": lat, "lng": 4.0}, {"lat": lat, "lng": 4.1}]
    official = put("official", [(1, path(51.0), 1, "walk")], f"way_id int, path {geo.PATH}, code int, mode string")
    ways = put("ways", [(5, path(51.2), "gravel", None, None), (5, path(51.2), "gravel", None, None), (6, path(51.0), "sand", None, None)], f"way_id int, path {geo.PATH}, surface string, highway string, tracktype string")
    base = ["layer", "--source", edges, "--origin", "tv:", "--with", f"nodes={spots}", "--with", f"networks={nets}", "--with", f"surface={official}", "--with", f"ways={ways}"]
    assert jobs.run(spark, [*base, "--out", f"{tmp_path}/layer", "--apply"]) == {"insert": 4}
    stored = {r.external_id: r for r in spark.read.parquet(f"{tmp_path}/layer").where("kind = 'edge'").collect()}
    assert {k: (r.network_id, r.mode, r.naam, [x.code for x in r.surface]) for k, r in stored.items()} == {"tv:p": (7, "walk", "WNW Bronbossen|x", [1]), "tv:q": (7, "bike", "WNW Bronbossen|x", [0])}
    assert json.loads(stored["tv:q"].geometry)["coordinates"] == [[4.0, 51.2], [4.1, 51.2]]
    assert jobs.run(spark, [*base, "--stored", f"{tmp_path}/layer", "--with", f"stored_nodes={tmp_path}/layer"]) == {"keep": 4}
    assert jobs.run(spark, [*base, "--mode", "walk"]) == {"insert": 3}
    assert jobs.run(spark, [*base, "--stored", f"{tmp_path}/layer", "--no-osm"]) == {"insert": 2, "keep": 1, "update": 1}
    with pytest.raises(SystemExit):
        jobs.run(spark, ["layer", "--source", put("modeless", [("p", 1, "a", "b", "x", "0", 1.0, None)], "pid string, objectid int, begin_geoid string, end_geoid string, naam string, virtual string, shape_length double, geometry string"), "--origin", "tv:", "--with", f"nodes={spots}", "--mode", "walk"])

    routes_ = put("relations", [(1, "NL-A", "walk", [path(52.0)]), (2, "NL-B", "bike", [path(52.1)])], f"relation_id int, province string, mode string, ways array<{geo.PATH}>")
    points = put("points", [(10, 52.0, 4.0), (11, 52.0, 4.1), (12, 52.1, 4.0), (13, 52.1, 4.1)], "point_id int, lat double, lng double")
    known = put("known", [(5, 40.0, 1.0)], "node_id int, lat double, lng double")
    more_ways = put("more_ways", [(1, path(52.0), "asphalt", None, None)], f"way_id int, path {geo.PATH}, surface string, highway string, tracktype string")
    base = ["relations", "--source", routes_, "--with", f"points={points}", "--with", f"nodes={known}", "--with", f"ways={more_ways}"]
    assert jobs.run(spark, [*base, "--out", f"{tmp_path}/rel", "--apply"]) == {"insert": 2}
    stored = {r.relation_id: r for r in spark.read.parquet(f"{tmp_path}/rel").collect()}
    assert [(p.lat, p.lng) for p in stored[1].path] == [(52.0, 4.0), (52.0, 4.1)]
    assert {k: (r.mode, [x.code for x in r.surface]) for k, r in stored.items()} == {1: ("walk", [1]), 2: ("bike", [-1])}
    assert jobs.run(spark, [*base, "--province", "NL-B"]) == {"insert": 1}
    assert jobs.run(spark, [*base, "--mode", "walk", "--stored", f"{tmp_path}/rel"]) == {"keep": 2}


def test_jobs_over_older_dumps(spark, tmp_path):
    from wayquarry import jobs

    def put(name, data, schema):
        frame(spark, data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}"

    (tmp_path / "n.sql").write_text("INSERT INTO `Nieuwsbrief_voorkeuren` VALUES (1,'A@b.c','','','2020-01-01','','','','1','','u1'),(2,'a@b.c','','','2020-01-01','','2021-01-01','','1','','u1'),(3,'x@y.z','','','0000-00-00','','','','0','',''),(4,'no mail','','','','','','','1','',''),(5,'o@p.q','','','2020-05-05','',NULL,'','1','','u2');")
    people = put("people", [(7, "u1"), (8, "u2")], "id long, control_number string")
    args = ["newsletter", "--source", f"{tmp_path}/n.sql", "--with", f"users={people}"]
    assert jobs.run(spark, [*args, "--out", f"{tmp_path}/news", "--apply", "--confirm"]) == {"insert": 3, "invalid": 1}
    assert listed(spark.read.parquet(f"{tmp_path}/news"), "email", "status", "user_id") == [("a@b.c", "unsubscribed", 7), ("o@p.q", "subscribed", 8), ("x@y.z", "unsubscribed", None)]
    (tmp_path / "p.sql").write_text("INSERT INTO places VALUES ('u','Gent','','gent x','','<h2>a</h2><p>b</p>','','','',''),('v','B','','b','','','','','','');")
    assert jobs.run(spark, ["places", "--source", f"{tmp_path}/p.sql", "--universe", "u"]) == {"insert": 1}

    orders = put("orders", [("Molenzicht", "m@x.be", "logies", "ok", "2024-03-01", 1, None), ("Zonneveld", "k@x.be", "logies", "ok", "2024-04-01", 2, None)], "name string, email string, type string, status string, date string, number int, reference string")
    subs = put("subs", [("s1", "Molenzicht", None, d("2024-03-01"), None, None, None), ("s2", "Iets anders", None, d("2024-04-01"), None, None, None), ("s3", "Zonneveld", None, d("2024-04-01"), None, None, None)], "sub_id string, sub_name string, sub_email string, start_date date, first_run date, last_run date, run_count long")
    base = ["orders", "--source", orders, "--stored", subs]
    assert jobs.run(spark, base) == {"update": 2}
    assert jobs.run(spark, [*base, "--map", "s2=K@x.be", "--skip", "s3"]) == {"update": 2}
    assert jobs.run(spark, [*base, "--map", "s2=zonneveld"]) == {"update": 3}


def test_routes_with_candidates_and_tracks(spark):
    rows_ = frame(spark, [("1", "Route A", "a", "12,5", "1 - 2", "5,0"), ("1", " ", "b", "3", "7 - 8", "1"), ("1", "C", "c", "3", "5 - 6", "1")], "Status string, Titel string, URL string, Afstand string, Knooppunten string, Afstanden string")
    starts = frame(spark, [("a", "Kerk", 51.0, 4.0, "Gent", "Oost", "BE", None, 1)], "slug string, name string, latitude double, longitude double, city string, province string, country string, distance_km double, ordinal int")
    places = frame(spark, [(6, "Gent", "Oost", "Belgium")], "place_id int, name string, province string, country string")
    recorded = frame(spark, [("a", [("1", 51.0, 4.0), ("2", 51.1, 4.0)])], "slug string, nodes array<struct<number: string, lat: double, lng: double>>")
    candidates = frame(spark, [("b", 0, 1, 50.0, 4.0, 0, 5.0, 0.1), ("b", 0, 2, 52.0, 4.0, 0, 900.0, 0.1), ("b", 1, 3, 50.5, 4.0, 9, 5.0, 0.1), ("c", 0, 4, 50.0, 4.0, 0, 5.0, 0.1), ("a", 0, 9, 0.0, 0.0, 0, 0.0, 0.0)], "route_id string, place int, candidate_id int, lat double, lng double, route_index int, route_metres double, expected_gap_km double")
    tracks_ = frame(spark, [("b", "From a track", "text", 9.5, 60.0, 10.0, 11.0)], "route_id string, title string, description string, distance_km double, minutes double, gain double, loss double")
    found = {r.slug: r for r in imports.imported_routes(rows_, starts, places, recorded, candidates, tracks_).collect()}
    assert (found["a"].nodes_from, [n.number for n in found["a"].nodes], found["a"].title, found["a"].distance_km) == ("recorded", ["1", "2"], "Route A", 12.5)
    assert (found["b"].nodes_from, [(n.number, n.lat) for n in found["b"].nodes], found["b"].title, found["b"].distance_km, found["b"].gain) == ("chosen", [("7", 50.0), ("8", 50.5)], "From a track", 9.5, 10.0)
    assert (found["c"].nodes_from, found["c"].nodes) == (None, None)
