"""Ways of a relation as one line.

The first way that is left starts a chain. Of the ways that meet one of its ends, the earliest one is added, turned if need be,
until none meets it; then the next chain starts. Way ends are kept by cells of space (points on a sphere of the earth's size, so that
cells are alike everywhere), each with its ways in order: a chain looks into the cells around its two ends only, and a relation costs
about its number of ways.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from itertools import product

import pandas as pd

from ..functions import geo
from ..functions.vectorised import vectorised

Point = tuple[float, float]
TOLERANCE_KM = 0.002
#: Cells are as many tolerances wide, so that most ends have no other cell within reach.
WIDE = 8


def km(a: Point, b: Point) -> float:
    la, lb = math.radians(a[0]), math.radians(b[0])
    x = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_KM * math.atan2(math.sqrt(x), math.sqrt(1 - x))


class Ends:
    """The ends of ways that aren't part of a chain yet."""

    def __init__(self, ways: list[list[Point]], tolerance: float) -> None:
        self.ways, self.tolerance = ways, tolerance
        self.degrees = math.degrees(tolerance / geo.EARTH_KM) * 1.001 + 1e-12  # ends that differ by more in latitude don't meet
        self.free = [True] * len(ways)
        self.cells: dict[tuple[int, int, int], deque[int]] = defaultdict(deque)
        for i, way in enumerate(ways):
            for cell in {self._cell(way[0]), self._cell(way[-1])}:
                self.cells[cell].append(i)

    def _at(self, p: Point) -> tuple[float, float, float]:
        """A place on the sphere, in cells."""
        lat, lng = math.radians(p[0]), math.radians(p[1])
        scale = geo.EARTH_KM / (WIDE * self.tolerance)
        return math.cos(lat) * math.cos(lng) * scale, math.cos(lat) * math.sin(lng) * scale, math.sin(lat) * scale

    def _cell(self, p: Point) -> tuple[int, int, int]:
        x, y, z = self._at(p)
        return math.floor(x), math.floor(y), math.floor(z)

    def meets(self, a: Point, b: Point) -> bool:
        return a == b or (abs(a[0] - b[0]) <= self.degrees and km(a, b) <= self.tolerance)

    def first(self, p: Point) -> int | None:
        """The earliest free way with an end at a point. A straight line is shorter than an arc, so it lies in the cells within reach."""
        reach = 1.001 / WIDE
        best = None
        for cell in product(*(range(math.floor(v - reach), math.floor(v + reach) + 1) for v in self._at(p))):
            own = self.cells.get(cell)
            while own and not self.free[own[0]]:
                own.popleft()
            for i in own or ():
                if best is not None and i >= best:
                    break
                if self.free[i] and (self.meets(p, self.ways[i][0]) or self.meets(p, self.ways[i][-1])):
                    best = i
                    break
        return best


def stitch(ways: list[list[Point]], tolerance_km: float = TOLERANCE_KM) -> tuple[list[Point], bool]:
    """The longest chain, the first of equals, and whether it is the only one. Ways of under two points count for nothing."""
    ends = Ends([list(w) for w in ways if len(w) >= 2], tolerance_km)
    best: list[Point] = []
    longest, chains = -1.0, 0
    for seed, way in enumerate(ends.ways):
        if not ends.free[seed]:
            continue
        ends.free[seed] = False
        parts = deque([way])
        at_end, at_start = ends.first(way[-1]), ends.first(way[0])
        while at_end is not None or at_start is not None:
            last, first = parts[-1][-1], parts[0][0]
            take = min(i for i in (at_end, at_start) if i is not None)
            own = ends.ways[take]
            ends.free[take] = False
            # an end of the chain comes before its start, and a way as it is before its turned one
            if take == at_end:
                parts.append(own[1:] if ends.meets(last, own[0]) else own[-2::-1])
            else:
                parts.appendleft(own[:-1] if ends.meets(first, own[-1]) else own[:0:-1])
            at_end, at_start = ends.first(parts[-1][-1]), ends.first(parts[0][0])
        line = [p for part in parts for p in part]
        chains += 1
        # the length of an only chain isn't asked for
        length = sum(map(km, line, line[1:])) if chains > 1 or any(ends.free) else 0.0
        if length > longest:
            best, longest = line, length
    return best, chains == 1


@vectorised(f"struct<path: {geo.PATH}, complete: boolean>")
def stitched(ways: pd.Series) -> pd.DataFrame:
    """Paths of a relation (array of paths, in order) as one line."""
    found = [stitch([[(p["lat"], p["lng"]) for p in way] for way in own]) if own is not None else ([], False) for own in ways]
    return pd.DataFrame({"path": [[{"lat": a, "lng": b} for a, b in line] for line, _ in found], "complete": [c for _, c in found]})
