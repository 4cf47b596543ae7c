"""Zones against point-by-point nearest centres, and their areas against the body's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import geometry, zoning

BODIES = {
    # an L of two arms, a box of eight by four kilometres with a hole, a sliver, and a speck of one cell
    1: [[(0, 0), (6000, 0), (6000, 1000), (1000, 1000), (1000, 5000), (0, 5000)]],
    2: [[(0, 0), (8000, 0), (8000, 4000), (0, 4000)], [(3000, 1500), (3000, 2500), (5000, 2500), (5000, 1500)]],
    3: [[(100, 100), (900, 120), (905, 140), (100, 130)]],
    4: [[(0, 0), (15, 0), (15, 15), (0, 15)]],
    5: [[(0, 0), (9000, 0), (9000, 9000), (0, 9000), (0, 6000), (7000, 6000), (7000, 3000), (0, 3000)]],
}


@pytest.fixture(scope="module")
def made(spark):
    rows = [(b, r, r > 0, k, float(x), float(y)) for b, rings in BODIES.items() for r, ring in enumerate(rings) for k, (x, y) in enumerate(ring)]
    body = spark.createDataFrame(rows, "id long, ring long, hole boolean, seq long, x double, y double")
    found = zoning.centres(body, "id", most_cells=4000).cache()
    outline = zoning.outlines(body, found, "id").cache()
    return body, found, outline


def inside(point, rings):
    x, y = point
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def test_areas_add_up_and_counts_follow_the_area(made):
    body, found, outline = made
    areas = {r["id"]: r["area_km2"] for r in geometry.areas(body, "id").collect()}
    z = zoning.zones(body, found, outline, "id").collect()
    for b, area in areas.items():
        own = [r for r in z if r["id"] == b]
        assert sum(r["area_km2"] for r in own) == pytest.approx(area, rel=1e-9)
        assert [r["seq"] for r in sorted(own, key=lambda r: r["seq"])] == list(range(1, len(own) + 1)) and len({r["name"] for r in own}) == len(own)
    counts = {b: sum(r["id"] == b for r in z) for b in BODIES}
    assert counts == {1: 4 + 0, 2: 4 + 4, 3: 4, 4: 4, 5: 8}
    again = {(r["id"], r["zone"]): tuple(r) for r in zoning.zones(body, zoning.centres(body.repartition(3), "id", most_cells=4000), outline, "id").collect()}
    assert again == {(r["id"], r["zone"]): tuple(r) for r in z}


def test_each_point_lies_in_the_zone_of_its_nearest_centre(made):
    _, found, outline = made
    centres = {}
    for r in found.collect():
        centres.setdefault(r["id"], {})[r["zone"]] = (r["cx"], r["cy"])
    rings = {}
    for r in sorted(outline.collect(), key=lambda r: r["seq"]):
        rings.setdefault((r["id"], r["zone"]), {}).setdefault(r["ring"], []).append((r["x"], r["y"]))
    rng = np.random.default_rng(1)
    for b in (1, 2, 5):
        outer = np.array(BODIES[b][0])
        for p in rng.uniform(outer.min(0), outer.max(0), (400, 2)):
            order = sorted(centres[b], key=lambda z: (centres[b][z][0] - p[0]) ** 2 + (centres[b][z][1] - p[1]) ** 2)
            held = [z for z in centres[b] if inside(p, list(rings.get((b, z), {}).values()))]
            assert held == ([order[0]] if inside(p, BODIES[b]) else []), (b, p)


def test_zones_of_holes_and_no_bodies(spark, made):
    body, found, outline = made
    assert outline.filter("id = 2 AND hole").select("zone").distinct().count() > 1
    assert zoning.outlines(body.limit(0), found, "id").count() == 0
    one = found.filter("id = 1").withColumn("zone", F.lit(0)).limit(1)  # a single centre leaves the body whole
    assert geometry.areas(zoning.outlines(body, one, "id"), "id").first()["area_km2"] == pytest.approx(10.0)
