"""Stitching, short runs, cells along segments, surfaces against a plain version; places and unique names."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA

from wayquarry.functions import geo
from wayquarry.operators import rows, stitching, surface
from wayquarry.plans import network


def greedy(ways, tolerance=0.002):
    """By the rule's words, looking at all ways each time."""
    near = lambda p, q: stitching.km(p, q) <= tolerance
    free, chains = [list(w) for w in ways if len(w) > 1], []
    while free:
        line, free = free[0], free[1:]
        while True:
            hit = next((i for i, w in enumerate(free) if any(near(a, b) for a in (line[0], line[-1]) for b in (w[0], w[-1]))), None)
            if hit is None:
                break
            w = free.pop(hit)
            if near(line[-1], w[0]):
                line = line + w[1:]
            elif near(line[-1], w[-1]):
                line = line + w[:-1][::-1]
            elif near(line[0], w[-1]):
                line = w[:-1] + line
            else:
                line = w[1:][::-1] + line
        chains.append(line)
    best = max(chains, key=lambda c: sum(stitching.km(a, b) for a, b in zip(c, c[1:])), default=[])
    return best, len(chains) == 1


@pytest.mark.parametrize("at", [(51.0, 4.0), (89.9995, 10.0), (0.0, 179.9995), (-45.0, -180.0)])
def test_chains_are_those_of_the_rule(at):
    rng = random.Random(hash(at) % 1000)
    for _ in range(150):
        spots = [(at[0] + rng.randrange(5) * 1e-4, at[1] + rng.randrange(5) * 1e-4) for _ in range(8)]
        shake = lambda p: (p[0] + rng.choice([0, 0, 8e-6, 2e-5]), p[1])  # noqa: B023, E731
        ways = [[shake(rng.choice(spots)) for _ in range(rng.choice([1, 2, 2, 3]))] for _ in range(rng.randrange(0, 12))]
        assert stitching.stitch(ways) == greedy(ways)


def test_a_relation_of_many_ways():
    rng = random.Random(2)
    points = [(50 + k * 1e-4, 4 + math.sin(k / 50) / 10) for k in range(20_001)]
    ways = [[a, b] if rng.random() < 0.5 else [b, a] for a, b in zip(points, points[1:])]
    rng.shuffle(ways)
    began = time.time()
    line, whole = stitching.stitch(ways)
    assert whole and line in (points, points[::-1])
    hub = [[(50.0, 4.0), (50 + k * 1e-3, 4.1)] for k in range(3000)]
    assert len(stitching.stitch(hub)[0]) == 3
    assert time.time() - began < 30


def merged_by_rule(codes, lengths, least=40.0):
    runs = [list(r) for r in zip(codes, lengths)]
    while len(runs) > 1:
        at = next((i for i, r in enumerate(runs) if r[1] < least), None)
        if at is None:
            break
        code, length = runs.pop(at)
        if at == 0:
            to = 0
        elif at == len(runs):
            to = at - 1
        else:
            to = at - 1 if runs[at - 1][1] >= runs[at][1] else at
        runs[to][1] += length
        if 0 < at < len(runs) + 1 and at - 1 >= 0 and at < len(runs) and runs[at - 1][0] == runs[at][0]:
            runs[at - 1][1] += runs.pop(at)[1]
    return [tuple(r) for r in runs]


def test_short_runs_by_the_rule():
    rng = random.Random(4)
    for _ in range(2000):
        codes = [rng.choice([-1, 0, 1])]
        for _ in range(rng.randrange(12)):
            codes.append(rng.choice([c for c in (-1, 0, 1) if c != codes[-1]]))
        lengths = [rng.choice([5, 10, 15, 20, 30, 39, 40, 60, 100]) for _ in codes]
        assert surface.merge_short(codes, lengths) == merged_by_rule(codes, lengths)
    many = 200_000
    assert sum(x for _, x in surface.merge_short([k % 2 for k in range(many)], [10.0] * many)) == 10.0 * many


def test_cells_along_segments(spark):
    """Every cell with a point within 20 m of a segment is there, and their number grows with the length."""
    rng = random.Random(6)
    segments = [((51.0, 4.0), (51.0, 4.0)), ((51.0, 4.0), (51.3, 4.0)), ((51.0, 4.0), (51.0, 4.3)), ((-0.01, -0.01), (0.01, 0.01)), ((70.0, 5.0), (69.9, 4.9))]
    segments += [((50 + rng.random(), 4 + rng.random()), (50 + rng.random(), 4 + rng.random())) for _ in range(20)]
    point = lambda p: {"lat": p[0], "lng": p[1]}
    df = spark.createDataFrame([(k, point(a), point(b)) for k, (a, b) in enumerate(segments)], "k int, a struct<lat double, lng double>, b struct<lat double, lng double>")
    found = {r.k: {(c.x, c.y) for c in r.c} for r in df.select("k", geo.cells_along(F.col("a"), F.col("b"), surface.CELL, 20.0).alias("c")).collect()}
    for k, (a, b) in enumerate(segments):
        for _ in range(400):
            t, angle, metres = rng.random(), rng.random() * 2 * math.pi, rng.choice([0, 10, 19.9])
            lat, lng = a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t
            lat += metres * math.sin(angle) / geo.METRES_A_DEGREE
            lng += metres * math.cos(angle) / geo.METRES_A_DEGREE / math.cos(math.radians(lat))
            assert (math.floor(lng / surface.CELL), math.floor(lat / surface.CELL)) in found[k]
    diagonal = df.limit(1).select(F.size(geo.cells_along(F.struct(F.lit(50.0).alias("lat"), F.lit(4.0).alias("lng")), F.struct(F.lit(51.0).alias("lat"), F.lit(5.0).alias("lng")), surface.CELL, 20.0)))
    assert 500 < diagonal.first()[0] < 3000


def plain_surfaces(lines, ways):
    """line -> runs, by comparing every step with every segment."""
    per = geo.METRES_A_DEGREE
    out = {}
    for key, path in lines:
        found = []
        for a, b in zip(path, path[1:]):
            length = math.hypot((a[0] - b[0]) * per, (a[1] - b[1]) * per * math.cos(math.radians((a[0] + b[0]) / 2)))
            if not length:
                continue
            n = max(1, math.ceil(length / 20))
            across = per * math.cos(math.radians(a[0]))
            east, north = (b[1] - a[1]) * across / length, (b[0] - a[0]) * per / length
            for s in range(n):
                t = (s + 0.5) / n
                lat, lng = a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t
                best = None
                for way, code, seq, p, q in ways:
                    own = per * math.cos(math.radians(lat))
                    ax, ay, dx, dy = (p[1] - lng) * own, (p[0] - lat) * per, (q[1] - p[1]) * own, (q[0] - p[0]) * per
                    squared = dx * dx + dy * dy
                    u = min(max(-(ax * dx + ay * dy) / squared, 0), 1) if squared else 0
                    metres = math.hypot(ax + u * dx, ay + u * dy)
                    if metres <= 20:
                        size = math.sqrt(squared) or 1
                        score = metres + (1 - abs(east * dx / size + north * dy / size)) * 15
                        best = min(best or (score, way, seq, code), (score, way, seq, code))
                found.append((best[3] if best else -1, length / n))
        codes, lengths = [], []
        for code, metres in found:
            if codes and codes[-1] == code:
                lengths[-1] += metres
            else:
                codes.append(code)
                lengths.append(metres)
        if not codes:
            continue
        kept, at, total, runs = merged_by_rule(codes, lengths), 0.0, sum(lengths), []
        for k, (code, metres) in enumerate(kept):
            to = at + metres
            runs.append((math.floor(at / total * 1e4 + 0.5) / 1e4, 1.0 if k + 1 == len(kept) else math.floor(to / total * 1e4 + 0.5) / 1e4, code))
            at = to
        out[key] = runs
    return out


def test_surfaces_against_a_plain_version(spark):
    """Random lines beside ways with long diagonals."""
    rng = random.Random(12)
    path = lambda n, step: [(50 + rng.random() / 50, 4 + rng.random() / 50)] + [(50 + rng.random() * step, 4 + rng.random() * step) for _ in range(n)]
    ways = [(k, path(rng.randrange(1, 4), 0.02), rng.randrange(2)) for k in range(30)] + [(100, [(49.0, 3.0), (51.0, 5.0)], 1)]
    lines = [(k, path(rng.randrange(0, 4), 0.02)) for k in range(12)]
    lines += [(50, [(50.001, 4.0011), (50.004, 4.004)]), (51, [w for w in ways[3][1]])]
    points = lambda p: [{"lat": a, "lng": b} for a, b in p]
    own = spark.createDataFrame([(k, points(p)) for k, p in lines], f"line_id int, path {geo.PATH}")
    theirs = spark.createDataFrame([(k, points(p), c) for k, p, c in ways], f"way_id int, path {geo.PATH}, code int")
    found = {r.line_id: [(x["from"], x["to"], x["code"]) for x in r.runs] for r in surface.classified(own, [theirs]).collect()}
    segments = [(k, c, s, a, b) for k, p, c in ways for s, (a, b) in enumerate(zip(p, p[1:]))]
    expected = plain_surfaces(lines, segments)
    assert found.keys() == expected.keys()
    for k in expected:
        assert [r[2] for r in found[k]] == [r[2] for r in expected[k]]
        assert [x for r in found[k] for x in r[:2]] == pytest.approx([x for r in expected[k] for x in r[:2]], abs=2e-4)


def test_surface_query_over_the_whole_table(spark):
    import json

    _, edges = network.built(spark, str(DATA / "sf0.001"))
    lines = [(r.id, [(p.lat, p.lng) for p in r.path]) for r in edges.select("id", "path").collect()]
    segments = []
    for key, p in lines:
        path = p if key % 2 == 0 else [p[0], ((p[0][0] + p[1][0]) / 2, (p[0][1] + p[1][1]) / 2)]
        segments += [(key, key % 2, s, a, b) for s, (a, b) in enumerate(zip(path, path[1:]))]
    expected = plain_surfaces(lines, segments)
    found = {r.line_id: [(x["from"], x["to"], x["code"]) for x in json.loads(r.runs)] for r in network.surface_runs(spark, str(DATA / "sf0.001")).collect()}
    assert found.keys() == expected.keys() and len(found) > 5
    for k in expected:
        assert [r[2] for r in found[k]] == [r[2] for r in expected[k]]
        for a, b in zip(found[k], expected[k]):
            assert a[:2] == pytest.approx(b[:2], abs=2e-4)


def test_places(spark):
    rng = random.Random(1)
    data = [(k, rng.choice(["a", "a", "a", "b", None]), rng.randrange(50)) for k in range(3000)]
    df = spark.createDataFrame(data, "id int, g string, x int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = rows.places(df, ["g"], ["x", "id"], parts=7).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("a", "b", None):
        own = sorted((r.x, r.id, r.place) for r in found if r.g == g)
        assert [p for _, _, p in own] == list(range(1, len(own) + 1))
    assert [r.place for r in rows.places(df, [], ["id"]).orderBy("id").collect()] == list(range(1, 3001))
    assert rows.places(df.where("false"), ["g"], ["x"]).count() == 0


def given_in_order(names, sep="-"):
    used, out = set(), []
    for name in names:
        found, number = name, 2
        while found.lower() in used:
            found, number = f"{name}{sep}{number}", number + 1
        used.add(found.lower())
        out.append(found)
    return out


@pytest.mark.parametrize(("sep", "pool"), [("-", ["a", "A", "a-2", "a-22", "a-2-2", "a-02", "b"]), ("-", ["x"]), ("-", ["a-3", "a", "a-3-2", "", "-2", "a-", "a--2"]), ("", ["a", "a2", "A22", "a222", "a02", "", "2", "b"])])
def test_unique_names_are_those_given_in_order(spark, sep, pool):
    rng = random.Random(3)
    names = [rng.choice(pool) for _ in range(10_000)]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string").repartition(3)
    found = rows.unique_names(df.withColumn("_x", F.lit(1)), "name", ["id"], sep=sep).orderBy("id").collect()
    assert [r.unique_name for r in found] == given_in_order(names, sep)


def test_unique_names_without_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, None), (3, "", 7)], "id int, name string, n int")
    found = rows.unique_names(df, "name", ["id"]).orderBy("id").collect()
    assert [(r.unique_name, r.n) for r in found] == [(None, 5), ("-2", None), ("-3", 7)]
    assert rows.unique_names(df.where("false"), "name", ["id"]).count() == 0


def test_hot_keys_are_split(spark):
    """Winners, quotas and ordinals of a key that holds most rows are those of plain sorting, and no window gathers that key."""
    rng = random.Random(9)
    data = [(k, "hot" if rng.random() < 0.9 else rng.choice(["a", None]), rng.randrange(30), rng.random() < 0.5) for k in range(4000)]
    df = spark.createDataFrame(data, "id int, g string, x int, yes boolean").repartition(5)
    by = {}
    for k, g, x, yes in data:
        by.setdefault(g, []).append((x, k, yes))
    best = {min(v)[1] for v in by.values()}
    order = [F.asc("x"), F.asc("id")]
    assert {r.id for r in rows.winner(df, ["g"], order).where("keeps").collect()} == best
    assert {r.id for r in rows.winners(df, ["g"], order).collect()} == best
    assert rows.winner(df, ["g"], order).count() == 4000
    taken = {k for v in by.values() for _, k, _ in [y for y in sorted(v) if y[2]][:7]}
    found = rows.running_quota(df, F.col("yes"), order, 7, ["g"])
    assert {r.id for r in found.where("accepted").collect()} == taken and found.count() == 4000
    names = {r.id: r.unique_key for r in rows.ordinals(df, "g", order).collect()}
    for g, v in by.items():
        assert [names[k] for _, k, _ in sorted(v)] == [g if len(v) == 1 or g is None else f"{g}_{i}" for i in range(1, len(v) + 1)]


def test_nodes_along_tracks(spark):
    """Of each track's points the nearest node within 50 m, without repetitions and without returns within ten points."""
    from wayquarry.operators import tracks

    rng = random.Random(31)
    nodes = [(k, 51 + k % 5 * 0.001, 4 + k // 5 * 0.001) for k in range(25)]
    points = [(t, s, 51 + rng.random() * 0.004, 4 + rng.random() * 0.004) for t in range(6) for s in range(60)]
    df = spark.createDataFrame(points, "track_id int, seq int, lat double, lng double")
    found = sorted((r.track_id, r.seq, r.node_id) for r in tracks.nodes_along(df, spark.createDataFrame(nodes, "id int, lat double, lng double")).collect())
    expected = []
    for track in range(6):
        last, at = None, {}
        for t, s, lat, lng in points:
            if t != track:
                continue
            km, node = min((stitching.km((lat, lng), (a, b)), k) for k, a, b in nodes)
            if km <= 0.05 and node != last and s - at.get(node, -10) >= 10:
                expected.append((t, s, node))
                last, at[node] = node, s
    assert found == expected and len(found) > 20
