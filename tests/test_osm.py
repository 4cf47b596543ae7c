"""Polygons of map elements against a flood of the plane, and the shapes that mappers draw."""

import math
from collections import deque

import numpy as np
import pytest

from tidewater.operators import geometry
from tidewater.sources import osm

SCHEMA = f"osm_id string, type string, tags map<string, string>, geometry {osm._POINTS}, members array<struct<type: string, role: string, geometry: {osm._POINTS}>>"


def line(*points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def relation(name, *ways):
    return (name, "relation", {}, None, [{"type": "way", "role": role, "geometry": line(*p)} for role, p in ways])


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def made(spark, elements):
    v = osm.polygons(spark.createDataFrame(elements, SCHEMA).repartition(3)).cache()
    out = {}
    for r in sorted(v.collect(), key=lambda r: (r["osm_id"], r["ring"], r["seq"])):
        out.setdefault(r["osm_id"], {}).setdefault((r["ring"], r["hole"]), []).append((r["x"], r["y"]))
    areas = {r["osm_id"]: r["area_km2"] * 1e6 for r in geometry.areas(v, "osm_id").collect()}
    return out, areas


def test_shapes_that_mappers_draw(spark):
    cross = [("outer", [(0, 2), (10, 2)]), ("outer", [(0, 8), (10, 8)]), ("outer", [(2, 0), (2, 10)]), ("outer", [(8, 10), (8, 0)])]
    elements = [
        ("w1", "way", {}, line(*box(0, 0, 4, 3)), None),
        ("open", "way", {}, line(*box(0, 0, 4, 3)[:-1]), None),
        ("bow", "way", {}, line((0, 0), (4, 4), (4, 0), (0, 4), (0, 0)), None),
        relation("crossing", *cross),
        relation("touching", ("outer", box(0, 0, 3, 3)), ("outer", box(3, 3, 5, 5))),
        relation("shared side", ("outer", box(0, 0, 3, 3)), ("outer", box(3, 0, 5, 3))),
        relation("hole", ("outer", box(0, 0, 9, 9)), ("inner", box(2, 2, 4, 4)), ("inner", box(5, 5, 6, 6))),
        relation("hole outside", ("outer", box(0, 0, 9, 9)), ("inner", box(20, 20, 24, 24))),
        relation("hole across", ("outer", box(0, 0, 9, 9)), ("inner", box(7, 7, 12, 12))),
        relation("hole touches", ("outer", box(0, 0, 9, 9)), ("inner", box(0, 3, 2, 5))),
        relation("nested", ("outer", box(0, 0, 9, 9)), ("outer", box(3, 3, 5, 5))),
        relation("far", ("outer", box(0, 0, 1, 1)), ("outer", box(50, 50, 52, 52)), ("inner", box(50.5, 50.5, 51, 51))),
        relation("pieces", ("outer", [(0, 0), (5, 0)]), ("", [(5, 5), (5, 0)]), ("outer", [(5, 5), (0, 5), (0, 0)]), ("outer", [(5, 5), (9, 9)])),
        relation("gap", ("outer", [(0, 0), (5, 0), (5, 5)]), ("outer", [(0, 5), (0, 0)])),
        relation("only a hole", ("inner", box(0, 0, 1, 1))),
        relation("all hole", ("outer", box(0, 0, 2, 2)), ("inner", box(-1, -1, 3, 3))),
        ("none", "relation", {}, None, None),
        ("null", "way", {}, None, None),
    ]
    out, areas = made(spark, elements)
    wanted = {"w1": 12, "bow": 8, "crossing": 36, "touching": 13, "shared side": 15, "hole": 76, "hole outside": 81, "hole across": 77, "hole touches": 77, "nested": 81, "far": 4.75, "pieces": 25}
    assert {k: round(a, 9) for k, a in areas.items()} == wanted
    shape = {k: sorted(h for _, h in rings) for k, rings in out.items()}
    assert shape["hole"] == [False, True, True] and shape["hole across"] == shape["hole touches"] == shape["nested"] == [False]
    assert shape["touching"] == shape["bow"] == [False, False] and shape["far"] == [False, False, True]
    assert len(out["pieces"][0, False]) == 4  # the dangling way is no part of the outline


RISE = 0.00713  # rows lie a little higher than columns do right, so no line of the lattice runs through cells' middles


def flooded(segments, size, step):
    """Whether each cell of a grid is shut off from the outside by the segments."""
    n = int(size / step)
    mid_x = (np.arange(n) + 0.5) * step - 1.0
    mid_y = mid_x + RISE
    right, up = np.zeros((n, n), bool), np.zeros((n, n), bool)
    for (x1, y1), (x2, y2) in segments:
        if y1 != y2:  # blocks moves along x where a row's line crosses it
            rows = np.flatnonzero((mid_y > min(y1, y2)) & (mid_y < max(y1, y2)))
            x = x1 + (mid_y[rows] - y1) * (x2 - x1) / (y2 - y1)
            right[rows, np.searchsorted(mid_x, x) - 1] = True
        if x1 != x2:
            cols = np.flatnonzero((mid_x > min(x1, x2)) & (mid_x < max(x1, x2)))
            y = y1 + (mid_x[cols] - x1) * (y2 - y1) / (x2 - x1)
            up[np.searchsorted(mid_y, y) - 1, cols] = True
    seen, todo = np.zeros((n, n), bool), deque([(0, 0)])
    seen[0, 0] = True
    while todo:
        r, c = todo.popleft()
        for r2, c2, blocked in ((r, c + 1, right[r, c]), (r, c - 1, c > 0 and right[r, c - 1]), (r + 1, c, up[r, c]), (r - 1, c, r > 0 and up[r - 1, c])):
            if 0 <= r2 < n and 0 <= c2 < n and not blocked and not seen[r2, c2]:
                seen[r2, c2] = True
                todo.append((r2, c2))
    return ~seen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_ways_equal_a_flood(spark, seed):
    rng = np.random.default_rng(seed)
    ways = []
    for k in range(9):
        points = rng.integers(0, 13, (int(rng.integers(3, 7)), 2)).tolist()
        if k % 3 == 0:
            points.append(points[0])
        ways.append(("inner" if k % 4 == 3 else "outer", [tuple(p) for p in points]))
    out, areas = made(spark, [relation("r", *ways)])
    sides = {role: [s for r, p in ways if r == role for s in zip(p, p[1:], strict=False) if s[0] != s[1]] for role in ("outer", "inner")}
    step = 0.03
    inside = flooded(sides["outer"], 15, step) & ~flooded(sides["inner"], 15, step)
    assert areas.get("r", 0.0) == pytest.approx(inside.sum() * step * step, abs=2.5)  # cells on the lines count either way
    for r, c in rng.integers(0, len(inside), (300, 2)).tolist():
        x, y = (c + 0.5) * step - 1.0, (r + 0.5) * step - 1.0 + RISE
        near = min(abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / math.hypot(x2 - x1, y2 - y1) for s in sides.values() for (x1, y1), (x2, y2) in s)
        if near > 0.1:
            odd = False
            for ring in out.get("r", {}).values():
                for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                    odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
            assert odd == inside[r, c], (x, y)


def test_no_elements(spark):
    assert osm.polygons(spark.createDataFrame([], SCHEMA)).count() == 0
