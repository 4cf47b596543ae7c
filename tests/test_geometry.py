"""Tiles, stitched rings and windows against hand-made cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import geometry as G
from tidewater.sources import catalog, osm


def test_known_places_have_their_squares(spark):
    places = [("43QCA", 73.8567, 18.5204), ("31UDQ", 2.3522, 48.8566), ("18TWL", -74.0060, 40.7128), ("56HLH", 151.2093, -33.8688), (None, 10.0, 85.0)]
    places += [("32VKN", 5.3221, 60.3913), ("31VDG", 2.9, 60.3), ("33XWG", 15.6356, 78.2232)]  # Bergen, west of it, Longyearbyen
    frame = spark.createDataFrame(places, "wanted string, lon double, lat double")
    assert all(r["tile"] == r["wanted"] for r in G.tile_names(frame).collect())


def test_tiles_cover_edges_overlaps_and_the_middle(spark):
    boxes = {
        1: ((295e3, 1985e3, 320e3, 2004e3), {"43QBV", "43QBA", "43QCV", "43QCA"}),
        2: ((340e3, 2040e3, 360e3, 2060e3), {"43QCA"}),
        3: ((305e3, 2040e3, 320e3, 2060e3), {"43QBA", "43QCA"}),
        4: ((320e3, 2020e3, 680e3, 2080e3), {"43QCA", "43QDA", "43QEA", "43QFA"}),
    }
    corners = [(k, s, b[i], b[j]) for k, (b, _) in boxes.items() for s, (i, j) in enumerate(((0, 1), (2, 1), (2, 3), (0, 3)))]
    frame = spark.createDataFrame(corners, "id long, seq long, e double, n double")
    lon, lat = G.from_utm(F.col("e"), F.col("n"), F.lit(43), F.lit(False))
    found = {}
    for r in G.covering_tiles(frame.select("id", "seq", lon.alias("x"), lat.alias("y")), "id").collect():
        found.setdefault(r["id"], set()).add(r["tile"])
    assert found == {k: tiles for k, (_, tiles) in boxes.items()}


def test_zones_of_norway_and_svalbard(spark):
    wanted = {(2.99, 60.0): 31, (3.0, 60.0): 32, (11.99, 56.0): 32, (12.0, 60.0): 33, (5.0, 55.99): 31, (5.0, 64.0): 31, (8.99, 72.0): 31, (9.0, 80.0): 33, (20.99, 83.9): 33, (21.0, 72.0): 35, (33.0, 75.0): 37, (42.0, 75.0): 38, (-0.01, 75.0): 30, (9.0, 71.99): 32, (180.0, 0.0): 60}
    frame = spark.createDataFrame([(*at, z) for at, z in wanted.items()], "lon double, lat double, wanted int")
    assert frame.filter(G.grid_zone(F.col("lon"), F.col("lat")) != F.col("wanted")).collect() == []


def test_simplified_outlines_stay_near_and_keep_corners(spark):
    rng = np.random.default_rng(3)
    circle = [(1, 0, k, float(math.cos(k / 50 * math.pi)), float(math.sin(k / 50 * math.pi))) for k in range(100)]
    side = np.linspace(0, 10, 40)[:-1]
    square = [(x, 0.0) for x in side] + [(10.0, y) for y in side] + [(10 - x, 10.0) for x in side] + [(0.0, 10 - y) for y in side]
    square = [(2, 0, k, float(x + rng.normal() * 1e-4), float(y + rng.normal() * 1e-4)) for k, (x, y) in enumerate(square)]
    small = [(3, ring, k, x, y) for ring in (0, 1) for k, (x, y) in enumerate(((0.0, 0.0), (1e-4, 0.0), (1e-4, 1e-4), (0.0, 1e-4)))]
    same = [(4, 0, k, 5.0, 5.0) for k in range(6)]
    frame = spark.createDataFrame(circle + square + small + same, "id long, ring long, seq long, x double, y double")
    out = {}
    for r in G.simplified(frame, "id", tolerance=0.01).orderBy("seq").collect():
        out.setdefault((r["id"], r["ring"]), []).append((r["x"], r["y"]))
    assert 12 < len(out[1, 0]) < 40 and len(out[2, 0]) <= 5 and {(round(x, 2), round(y, 2)) for x, y in out[2, 0]} >= {(10.0, 0.0), (10.0, 10.0), (0.0, 10.0)}
    assert len(out[3, 0]) == len(out[3, 1]) == 3 and len(out[4, 0]) == 3 and G.simplified(frame.limit(0), "id", tolerance=1.0).count() == 0
    kept = np.array(out[1, 0])
    for _, _, _, x, y in circle:
        a, line = kept, np.roll(kept, -1, 0) - kept
        at = np.clip(((np.array([x, y]) - a) * line).sum(1) / (line**2).sum(1), 0, 1)
        assert np.hypot(*(np.array([x, y]) - a - at[:, None] * line).T).min() <= 0.01


def ring_area(points):
    return sum(x * y2 - x2 * y for (x, y), (x2, y2) in zip(points, points[1:] + points[:1], strict=True)) / 2


@pytest.mark.parametrize("seed", range(4))
def test_rings_come_from_shuffled_pieces(seed):
    rng = random.Random(seed)
    made = [[(40 * k + 9 * math.cos(2 * math.pi * i / n), 9 * math.sin(2 * math.pi * i / n)) for i in range(n)] for k in range(5) for n in [rng.randint(3, 9)]]
    pieces = [(min(a, b), max(a, b)) for ring in made for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    pieces += [(min(made[0][0], (11.0, 20.0)), max(made[0][0], (11.0, 20.0))), ((11.0, 20.0), (12.0, 30.0)), ((300.0, 1.0), (301.0, 2.0))]  # dangling
    rng.shuffle(pieces)
    ends = np.array([[*a, *b] for a, b in pieces])
    found = osm.rings(ends, np.ones(len(ends), bool), np.zeros(len(ends), bool))
    assert sorted(len(f) for f in found) == sorted(len(r) for r in made)
    areas = sorted(ring_area([tuple(p) for p in f]) for f in found)
    assert areas == pytest.approx(sorted(abs(ring_area(r)) for r in made)) and min(areas) > 0


def test_elements_that_are_no_polygons_are_left_out(spark):
    point = lambda *p: [{"lon": float(x), "lat": float(y)} for x, y in p]
    square = point((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    way = lambda role, g, kind="way": {"type": kind, "role": role, "geometry": g}
    rows = [
        ("way/1", "way", None, square, None), ("way/2", "way", None, square[:-1], None), ("way/3", "way", None, None, None), ("way/4", "way", None, [], None), ("node/5", "node", None, None, None),
        ("relation/6", "relation", None, None, [way("outer", square[2:]), way("", square[:3][::-1]), way("inner", point((1, 1), (2, 1), (2, 2), (1, 1))), way("outer", None), way("outer", square, "node")]),
        ("relation/7", "relation", None, None, [way("outer", square[:3]), way("inner", square)]), ("relation/8", "relation", None, None, []), ("relation/9", "relation", None, None, None),
    ]
    kind = "array<struct<lon: double, lat: double>>"
    elements = spark.createDataFrame(rows, f"osm_id string, type string, tags map<string, string>, geometry {kind}, members array<struct<type: string, role: string, geometry: {kind}>>")
    v = osm.polygons(elements)
    assert {r["osm_id"]: r["area_km2"] * 1e6 for r in G.areas(v, "osm_id").collect()} == {"way/1": pytest.approx(16), "relation/6": pytest.approx(15.5)}
    (shape,) = [r["geometry"] for r in G.outlines(v, "osm_id").collect() if r["osm_id"] == "relation/6"]
    assert [abs(ring_area([tuple(p) for p in ring[:-1]])) for ring in shape["coordinates"]] == [16, 0.5] and all(r[0] == r[-1] for r in shape["coordinates"])
    assert osm.polygons(elements.limit(0)).count() == 0


def test_a_box_off_the_raster_is_an_error(spark):
    box = catalog.window((F.lit(500.0), F.lit(0.0)), (F.lit(600.0), F.lit(50.0)), raster=(0.0, 0.0, 300.0, 300.0))
    with pytest.raises(Exception, match="off the raster"):
        spark.range(1).select(box.alias("b")).collect()
