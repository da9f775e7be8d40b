"""Shortest paths over networks of any size.

Steps (mode, node, next, step_km, passes) go both ways; a node whose ``passes`` is false may only end a path. Requests (request, mode, from_id, to_id)
get dist and node_ids. Of equal lengths the one of fewer edges counts, then the lesser list of nodes.

A network that is small enough is sent to the tasks, as arrays, with the distances of some landmarks: by the triangle inequality they
bound how far a node is from the target at least, so a search goes towards its target and looks at few nodes (``Network.path``).

A larger one is cut into cells of the map (``by_cells``). Within its cell each node at a border has its distances to the others; with the steps that
cross borders they make a smaller network that is sent instead. A request enters it from all border nodes of the cell of its start and leaves it at
those of the cell of its target; each leg within a cell is then looked up there. Equal lengths of equal numbers of edges may then go by another list of nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..storage import discard, stored

#: Landmarks of a network, and from how many steps on they are worth their while.
LANDMARKS, LEAST_STEPS = 8, 20_000
FOUND, NONE, GIVEN_UP = "found", "no way", "given up"
#: What rounding may add to a bound.
SLACK = 1e-9


class Network:
    """Steps of one mode as arrays: for each node, by its place among the sorted ids, where its steps begin."""

    def __init__(self, node: np.ndarray, there: np.ndarray, km: np.ndarray, passes: np.ndarray, hops: np.ndarray | None = None) -> None:
        self.ids = np.unique(np.concatenate([node, there])) if len(node) else np.zeros(0, np.int64)
        order = np.argsort(node, kind="stable")
        at = np.searchsorted(self.ids, node[order])
        self.begin = np.searchsorted(at, np.arange(len(self.ids) + 1)).astype(np.int64)
        self.next = np.searchsorted(self.ids, there[order]).astype(np.int32)
        self.km = km[order].astype(np.float64)
        self.passes = passes[order].astype(bool)
        self.hops = None if hops is None else hops[order].astype(np.int64)
        self.far = np.zeros((0, len(self.ids)))

    def place(self, node: int) -> int | None:
        at = int(np.searchsorted(self.ids, node))
        return at if at < len(self.ids) and self.ids[at] == node else None

    def steps(self, at: int) -> Iterator[tuple[int, float, bool, int]]:
        a, b = int(self.begin[at]), int(self.begin[at + 1])
        hops = [1] * (b - a) if self.hops is None else self.hops[a:b].tolist()
        return zip(self.next[a:b].tolist(), self.km[a:b].tolist(), self.passes[a:b].tolist(), hops)

    def distances(self, start: int) -> dict[int, tuple[float, int]]:
        """(km, edges) to every place that can be reached through nodes that may be passed."""
        best, done, heap = {start: (0.0, 0)}, set(), [(0.0, 0, start)]
        while heap:
            km, hops, at = heappop(heap)
            if at in done:
                continue
            done.add(at)
            for there, more, passes, n in self.steps(at):
                new = km + more, hops + n
                if there not in best or new < best[there]:
                    best[there] = new
                    if passes:
                        heappush(heap, (*new, there))
        return best

    def from_landmark(self, start: int) -> np.ndarray:
        """Distances whatever may be passed: no way can be shorter."""
        far = np.full(len(self.ids), np.inf)
        far[start] = 0.0
        done, heap = np.zeros(len(self.ids), bool), [(0.0, start)]
        while heap:
            km, at = heappop(heap)
            if done[at]:
                continue
            done[at] = True
            for there, more, _, _ in self.steps(at):
                if km + more < far[there]:
                    far[there] = km + more
                    heappush(heap, (km + more, there))
        return far

    def path(self, starts: dict[int, tuple[float, int]], ends: dict[int, tuple[float, int]], least: tuple[float, int] | None = None, most: int | None = None) -> tuple[str, tuple[float, int] | None, list[int], int]:
        """outcome, (km, edges), places from a start to an end, nodes looked at.

        starts, ends: places with what lies before and behind them. least: what is known to be possible already; a path must be better.
        A label that gets better goes on again, so that equal lengths are decided by edges and nodes whatever the order in which they are found.
        """
        goal = self.far[:, list(ends)] if len(self.far) and ends else None
        after = np.array([km for km, _ in ends.values()])
        known: dict[int, float] = {}

        def bound(at: int) -> float:
            if goal is None:
                return 0.0
            if at not in known:
                with np.errstate(invalid="ignore"):
                    gaps = np.abs(goal - self.far[:, at][:, None])
                # a landmark that reaches neither says nothing; one that reaches only one of both says that there is no way
                x = np.nan_to_num(gaps, nan=0.0, posinf=np.inf).max(axis=0) + after
                known[at] = max(0.0, float(x.min()) * (1 - SLACK) - SLACK)
            return known[at]

        labels: dict[int, tuple[float, int, int]] = {at: (*x, -1) for at, x in starts.items()}
        heap = [(x[0] + bound(at), *x, at) for at, x in starts.items()]
        heapify(heap)
        best, best_at, looked = least, -1, 0
        onward: dict[int, bool] = {}

        def nodes(at: int) -> list[int]:
            found = []
            while at >= 0:
                found.append(at)
                at = labels[at][2]
            return found[::-1]

        while heap:
            total, km, hops, at = heappop(heap)
            if best is not None and total > best[0] + SLACK * (1 + best[0]):
                break
            if labels[at][:2] != (km, hops) or total == np.inf:
                continue
            if at in ends:
                whole = km + ends[at][0], hops + ends[at][1]
                if best is None or whole < best or (whole == best and best_at >= 0 and nodes(at) < nodes(best_at)):
                    best, best_at = whole, at
            looked += 1
            if most is not None and looked > most:
                return GIVEN_UP, None, [], looked
            if at not in starts and not onward.get(at, True):
                continue  # an end that may not be passed
            for there, more, passes, n in self.steps(at):
                if not passes and there not in ends:
                    continue
                new, old = (km + more, hops + n), labels.get(there)
                if old is not None and (old[:2] < new or (old[:2] == new and (old[2] == at or old[2] < 0 or nodes(at) >= nodes(old[2])))):
                    continue
                labels[there] = (*new, at)
                onward[there] = passes
                heappush(heap, (new[0] + bound(there), *new, there))
        if best is None:
            return NONE, None, [], looked
        return FOUND, best, nodes(best_at) if best_at >= 0 else [], looked


def networks(steps: DataFrame, landmarks: int = LANDMARKS) -> dict[str, Network]:
    """By mode. The caller has checked that there are few enough steps to be sent."""
    found = {}
    table = steps.toArrow()
    columns = {n: table.column(n) for n in table.column_names}
    modes = np.array(columns["mode"].to_pylist(), object)
    arrays = {n: columns[n].to_numpy() for n in columns if n != "mode"}
    for mode in sorted(set(modes), key=str):
        own = modes == mode
        found[mode] = Network(*(arrays[n][own] for n in ("node", "next", "step_km", "passes")), arrays["hops"][own] if "hops" in arrays else None)
    if landmarks and table.num_rows >= LEAST_STEPS:
        _with_landmarks(steps, found, landmarks)
    return found


def _with_landmarks(steps: DataFrame, found: dict[str, Network], most: int) -> None:
    """Distances from landmarks that lie evenly among the sorted ids, each computed in a task of its own."""
    spark = steps.sparkSession
    shared = spark.sparkContext.broadcast(found)
    marks = [(mode, int(at)) for mode, n in found.items() for at in np.unique(np.linspace(0, len(n.ids) - 1, min(most, len(n.ids))).astype(int))]

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield pd.DataFrame({"mode": [r.mode], "far": [shared.value[r.mode].from_landmark(r.at).tobytes()]})

    rows = spark.createDataFrame(marks, "mode string, at long").repartition(len(marks), "at").mapInPandas(far, "mode string, far binary").collect()
    for mode, n in found.items():
        own = [np.frombuffer(bytes(r.far)) for r in rows if r.mode == mode]
        n.far = np.stack(own) if own else n.far
    shared.unpersist()


RESULT = T.StructType([T.StructField("dist", T.DoubleType()), T.StructField("node_ids", T.ArrayType(T.LongType())), T.StructField("outcome", T.StringType()), T.StructField("looked", T.LongType())])


def searched(steps: DataFrame, asked: DataFrame, most_looked: int | None = None, landmarks: int = LANDMARKS) -> DataFrame:
    """request, dist, node_ids, outcome and how many nodes were looked at, over a network that every task holds whole."""
    shared = asked.sparkSession.sparkContext.broadcast(networks(steps, landmarks))
    schema = T.StructType([asked.schema["request"], *RESULT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for mode, a, b in zip(*(batch.column(c).to_pylist() for c in ("mode", "from_id", "to_id"))):
                n = shared.value.get(mode)
                start, end = (n.place(a), n.place(b)) if n else (None, None)
                if a == b:
                    rows.append((0.0, [a], FOUND, 0))
                elif start is None or end is None:
                    rows.append((None, None, NONE, 0))
                else:
                    outcome, km, places, looked = n.path({start: (0.0, 0)}, {end: (0.0, 0)}, most=most_looked)
                    rows.append((km[0] if km else None, n.ids[places].tolist() if km else None, outcome, looked))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.float64(), pa.list_(pa.int64()), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("request"), *columns], names=schema.names)

    return asked.repartition("request").mapInArrow(run, schema)


CELLS = (0.1, 0.25, 0.5, 1.0, 2.0)


def by_cells(steps: DataFrame, asked: DataFrame, nodes: DataFrame, most: int, sizes: tuple[float, ...] = CELLS) -> DataFrame | None:
    """request, dist and node_ids by a network of border nodes; None if with no size of cells both it and each cell are small enough.

    nodes: id, lat, lng.
    """
    for size in sizes:
        cell = nodes.select("id", F.concat_ws(":", geo.cell(F.col("lat").cast("double"), size), geo.cell(F.col("lng").cast("double"), size)).alias("cell"))
        placed = stored(
            steps.join(cell.select(F.col("id").alias("node"), "cell"), "node").join(cell.select(F.col("id").alias("next"), F.col("cell").alias("there")), "next"), "path-cells"
        )
        inner = placed.where("cell = there")
        largest = inner.groupBy("mode", "cell").count().agg(F.max("count")).first()[0] or 0
        if largest <= most:
            found = _over_borders(placed, asked, cell, most)
            if found is not None:
                return found
        discard(placed)
        if largest > most:
            return None
    return None


LEG = "kind string, request string, a long, b long, km double, hops long, passes boolean"


def _over_borders(placed: DataFrame, asked: DataFrame, cell: DataFrame, most: int) -> DataFrame | None:
    crossing = placed.where("cell <> there")
    # steps go both ways, so each border node is the far end of one
    border = crossing.select("mode", F.col("there").alias("cell"), F.col("next").alias("a"), "passes").distinct()
    ends = asked.select(F.col("request").cast("string").alias("request"), "mode", "from_id", "to_id")
    both = F.array(F.struct(F.lit("from").alias("kind"), F.col("from_id").alias("a")), F.struct(F.lit("to").alias("kind"), F.col("to_id").alias("a")))
    sides = ends.select("mode", "request", F.inline(both)).join(cell.select(F.col("id").alias("a"), "cell"), "a")
    none = lambda kind: F.lit(None).cast(kind)
    work = (
        placed.where("cell = there").select("mode", "cell", F.lit("step").alias("kind"), none("string").alias("request"), F.col("node").alias("a"), F.col("next").alias("b"), F.col("step_km").alias("km"), "passes")
        .union(border.select("mode", "cell", F.lit("border"), none("string"), "a", none("long"), none("double"), "passes"))
        .union(sides.select("mode", "cell", "kind", "request", "a", none("long"), none("double"), none("boolean")))
    )

    def legs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows.kind == "step"]
        n = Network(own.a.to_numpy(np.int64), own.b.to_numpy(np.int64), own.km.to_numpy(float), own.passes.to_numpy(bool))
        at_border = {int(a): bool(p) for a, p in zip(rows.a[rows.kind == "border"], rows.passes[rows.kind == "border"])}
        out: list[tuple] = []
        reached: dict[int, dict[int, tuple[float, int]]] = {}

        def to(a: int) -> dict[int, tuple[float, int]]:
            if a not in reached:
                at = n.place(a)
                reached[a] = {a: (0.0, 0)} if at is None else {int(n.ids[b]): x for b, x in n.distances(at).items()}
            return reached[a]

        for a in at_border:
            out += [("leg", None, a, b, *to(a)[b], p) for b, p in at_border.items() if b != a and b in to(a)]
        starts = {}
        for r in rows[rows.kind.isin(["from", "to"])].itertuples(index=False):
            # a border node that isn't the end itself is passed on the way
            out += [(r.kind, r.request, r.a, b, *to(r.a)[b], True) for b, p in at_border.items() if (p or b == r.a) and b in to(r.a)]
            starts.setdefault(r.request, {})[r.kind] = r.a
        for request, x in starts.items():
            if len(x) == 2 and x["to"] in to(x["from"]):
                out.append(("local", request, x["from"], x["to"], *to(x["from"])[x["to"]], True))
        found = pd.DataFrame(out, columns=["kind", "request", "a", "b", "km", "hops", "passes"]).assign(mode=key[0])
        return found[["mode", "kind", "request", "a", "b", "km", "hops", "passes"]]

    made = stored(work.groupBy("mode", "cell").applyInPandas(legs, f"mode string, {LEG}"), "path-legs")
    whole = made.where("kind = 'leg'").select("mode", F.col("a").alias("node"), F.col("b").alias("next"), F.col("km").alias("step_km"), "passes", "hops")
    whole = stored(whole.union(crossing.select("mode", "node", "next", "step_km", "passes", F.lit(1).cast("long"))), "path-borders")
    if whole.count() > most:
        discard(made)
        discard(whole)
        return None
    shared = asked.sparkSession.sparkContext.broadcast(networks(whole))
    side = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("b", "km", "hops"))).alias(kind)
    local = F.max(F.when(F.col("kind") == "local", F.struct("km", "hops"))).alias("local")
    full = ends.join(made.where("request is not null").groupBy("request").agg(side("from"), side("to"), local), "request", "left")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for mode, a, b, before, behind, own in zip(*(batch.column(c).to_pylist() for c in ("mode", "from_id", "to_id", "from", "to", "local"))):
                n = shared.value.get(mode)
                least = (0.0, 0) if a == b else (own["km"], own["hops"]) if own else None
                starts, stops = ({n.place(x["b"]): (x["km"], x["hops"]) for x in some or ()} if n else {} for some in (before, behind))
                outcome, km, places, _ = n.path(starts, stops, least) if starts and stops else (FOUND if least else NONE, least, [], 0)
                rows.append((km[0], [a, *n.ids[places].tolist(), b] if places else [a, b]) if km else (None, None))
            yield pa.RecordBatch.from_arrays([batch.column("request"), batch.column("mode"), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["request", "mode", "dist", "stops"])

    # with ends of a request that no cell knows there is no row of its own
    over_borders = stored(full.repartition("request").mapInArrow(over, "request string, mode string, dist double, stops array<bigint>").where("dist is not null"), "path-stops")
    hop = F.arrays_zip(F.slice("stops", 1, F.size("stops") - 1).alias("a"), F.slice("stops", F.lit(2), F.size("stops") - 1).alias("b"))
    pairs = over_borders.select("request", "mode", F.posexplode(hop).alias("seq", "x")).select("request", "mode", "seq", F.col("x.a").alias("a"), F.col("x.b").alias("b")).where("a <> b")
    sides = pairs.join(cell.select(F.col("id").alias("a"), "cell"), "a").join(cell.select(F.col("id").alias("b"), F.col("cell").alias("there")), "b")
    across = sides.where("cell <> there").select("request", "seq", F.array("b").alias("on"))
    asked_within = sides.where("cell = there").select("mode", "cell", F.lit("leg").alias("kind"), "request", "seq", "a", "b", none("double").alias("km"), none("boolean").alias("passes"))
    given = placed.where("cell = there").join(asked_within.select("mode", "cell").distinct(), ["mode", "cell"], "left_semi")
    within = given.select("mode", "cell", F.lit("step").alias("kind"), none("string").alias("request"), none("int").alias("seq"), F.col("node").alias("a"), F.col("next").alias("b"), F.col("step_km").alias("km"), "passes").union(asked_within)

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows.kind == "step"]
        n = Network(own.a.to_numpy(np.int64), own.b.to_numpy(np.int64), own.km.to_numpy(float), own.passes.to_numpy(bool))
        out = []
        for r in rows[rows.kind == "leg"].itertuples(index=False):
            _, _, places, _ = n.path({n.place(r.a): (0.0, 0)}, {n.place(r.b): (0.0, 0)})
            out.append((r.request, int(r.seq), n.ids[places].tolist()[1:]))
        return pd.DataFrame(out, columns=["request", "seq", "on"])

    legs_inside = within.groupBy("mode", "cell").applyInPandas(inside, "request string, seq int, on array<bigint>")
    ordered = across.union(legs_inside).groupBy("request").agg(F.sort_array(F.collect_list(F.struct("seq", "on"))).alias("legs"))
    joined = over_borders.join(ordered, "request", "left")
    ids = F.concat(F.slice("stops", 1, 1), F.coalesce(F.flatten(F.transform("legs", lambda x: x["on"])), F.array().cast("array<bigint>")))
    back = asked.select("request", F.col("request").cast("string").alias("_key"))
    return joined.withColumnRenamed("request", "_key").join(back, "_key").select("request", "dist", ids.alias("node_ids"))
