"""Shortest paths: towards a goal, over border nodes, against a plain search."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayquarry.operators import graph, paths


def plain(steps, start, end, direct=()):
    """(km, edges, nodes) by whole labels; nodes in ``direct`` may not be passed."""
    done, heap = set(), [(0.0, 0, (start,))]
    while heap:
        km, hops, nodes = heapq.heappop(heap)
        at = nodes[-1]
        if at == end:
            return km, hops, list(nodes)
        if at in done:
            continue
        done.add(at)
        if at in direct and at != start:
            continue
        for there, more in steps.get(at, ()):
            if there not in done:
                heapq.heappush(heap, (km + more, hops + 1, (*nodes, there)))
    return None


def grid(rng, side, whole):
    """Steps of a grid with some diagonals; whole: lengths of whole numbers, so that many ways are equally long."""
    steps = {}
    for x in range(side):
        for y in range(side):
            for dx, dy in ((0, 1), (1, 0), (1, 1)):
                if x + dx < side and y + dy < side and rng.random() < (0.95 if dx + dy == 1 else 0.2):
                    a, b = x * side + y, (x + dx) * side + y + dy
                    km = float(rng.randrange(1, 4)) if whole else round(rng.uniform(0.5, 2), 3)
                    steps.setdefault(a, []).append((b, km))
                    steps.setdefault(b, []).append((a, km))
    return steps


def network(steps, closed=()):
    rows = [(a, b, km, b not in closed) for a, some in steps.items() for b, km in some]
    random.Random(0).shuffle(rows)
    a, b, km, passes = (np.array(x) for x in zip(*rows))
    return paths.Network(a, b, km, passes)


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("closed", [False, True])
def test_towards_a_goal(whole, closed):
    """Equal to the plain search on 10,000 requests in all, ties included, and far fewer nodes are looked at."""
    rng = random.Random(17 + whole + 2 * closed)
    near, all_ = 0, 0
    for side in (4, 9, 14, 20, 25):
        steps = grid(rng, side, whole)
        shut = {n for n in steps if n % 5 == 0} if closed else set()
        n = network(steps, shut)
        blind = network(steps, shut)
        n.far = np.stack([n.from_landmark(int(i)) for i in np.linspace(0, len(n.ids) - 1, 8).astype(int)])
        for _ in range(500):
            a, b = rng.choice(n.ids.tolist()), rng.choice(n.ids.tolist())
            if a == b:
                continue
            expected = plain(steps, a, b, shut)
            outcome, best, places, looked = n.path({n.place(a): (0.0, 0)}, {n.place(b): (0.0, 0)})
            if expected is None:
                assert outcome == paths.NONE
                continue
            assert outcome == paths.FOUND and best == (pytest.approx(expected[0]), expected[1])
            assert n.ids[places].tolist() == expected[2]
            near += looked
            all_ += blind.path({blind.place(a): (0.0, 0)}, {blind.place(b): (0.0, 0)})[3]
    assert near < (0.45 if not whole else 0.8) * all_


def test_giving_up():
    steps = grid(random.Random(1), 20, False)
    n = network(steps)
    assert n.path({0: (0.0, 0)}, {399: (0.0, 0)}, most=5)[:2] == (paths.GIVEN_UP, None)
    assert n.path({0: (0.0, 0)}, {399: (0.0, 0)}, most=400)[0] == paths.FOUND


def tables(spark, steps, place):
    seen = {(min(a, b), max(a, b)): km for a, some in steps.items() for b, km in some}
    nodes = spark.createDataFrame([(n, str(n) if n % 5 == 0 else "", *map(float, place(n))) for n in steps], "id long, number string, lat double, lng double")
    edges = spark.createDataFrame([(k, a, b, km, "fietsen") for k, ((a, b), km) in enumerate(seen.items())], "id long, a long, b long, km double, mode string")
    return nodes, edges


@pytest.mark.parametrize("direct", [False, True])
def test_over_borders(spark, direct):
    """A network that is too large to be sent, in cells of a map: the same paths as by the plain search."""
    rng = random.Random(5)
    side = 24
    steps = grid(rng, side, False)
    nodes, edges = tables(spark, steps, lambda n: (50 + n // side * 0.03, 4 + n % side * 0.03))
    shut = {n for n in steps if n % 5 == 0} if direct else set()
    asked = [(k, rng.choice(list(steps)), rng.choice(list(steps)), "fietsen") for k in range(300)] + [(900, 3, 3, "fietsen"), (901, 0, 1, "fietsen"), (902, 0, 1, "wandelen"), (903, 99999, 1, "fietsen")]
    requests = spark.createDataFrame(asked, "request long, from_id long, to_id long, mode string")
    most = sum(map(len, steps.values())) - 1
    found = {r.request: r for r in graph.shortest_paths(nodes, edges, requests, direct, most).collect()}
    for k, a, b, mode in asked:
        expected = plain(steps, a, b, shut) if mode == "fietsen" and a in steps else None
        assert (k in found) == (expected is not None), (k, a, b)
        if expected:
            assert found[k].km == pytest.approx(expected[0], abs=6e-4) and list(found[k].node_ids) == expected[2]


def test_a_long_path_takes_few_jobs(spark):
    """2000 edges in a row, in a network that isn't sent: far fewer jobs than edges."""
    steps = {}
    for k in range(2000):
        steps.setdefault(k, []).append((k + 1, 0.5))
        steps.setdefault(k + 1, []).append((k, 0.5))
    nodes, edges = tables(spark, steps, lambda n: (50 + n * 0.002, 4.0))
    requests = spark.createDataFrame([(1, 0, 2000, "fietsen")], "request long, from_id long, to_id long, mode string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("long path", "")
    found = graph.shortest_paths(nodes, edges, requests, most=2000).collect()
    jobs = len(tracker.getJobIdsForGroup("long path"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0].km == 1000.0 and found[0].node_ids == list(range(2001))
    assert jobs < 50


def test_outcomes(spark):
    steps = grid(random.Random(2), 12, False)
    steps[500], steps[501] = [(501, 1.0)], [(500, 1.0)]
    nodes, edges = tables(spark, steps, lambda n: (50, 4))
    requests = spark.createDataFrame([(1, 0, 143, "fietsen"), (2, 0, 500, "fietsen"), (3, 7, 7, "fietsen"), (4, 0, 7777, "fietsen")], "request long, from_id long, to_id long, mode string")
    found = {r.request: (r.outcome, r.km) for r in graph.path_outcomes(nodes, edges, requests).collect()}
    assert found[1] == (paths.FOUND, pytest.approx(plain(steps, 0, 143)[0], abs=6e-4))
    assert found[2] == found[4] == (paths.NONE, None) and found[3] == (paths.FOUND, 0.0)
    few = {r.request: r.outcome for r in graph.path_outcomes(nodes, edges, requests, most_looked=3).collect()}
    assert few[1] == paths.GIVEN_UP


def test_landmarks_are_computed_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(paths, "LEAST_STEPS", 1)
    steps = grid(random.Random(3), 15, False)
    nodes, edges = tables(spark, steps, lambda n: (50, 4))
    requests = spark.createDataFrame([(k, k, 224 - k, "fietsen") for k in range(40)], "request long, from_id long, to_id long, mode string")
    found = {r.request: r for r in graph.path_outcomes(nodes, edges, requests).collect()}
    assert all(found[k].km == pytest.approx(plain(steps, k, 224 - k)[0], abs=6e-4) for k in range(40))
    assert sum(r.looked for r in found.values()) < 40 * 225 * 0.5
    assert nodes.where(F.col("id") < 0).count() == 0
