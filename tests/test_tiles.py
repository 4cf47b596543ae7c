"""Tiled raster operators against whole-raster brute force, on wide rasters and with clusters that wind across seams."""

import numpy as np
import pytest

from tidewater.operators import detect, pixels, tiles

POINTS = "scene string, row long, col long"


def by_hand(points, squared, min_points):
    """{point: least core point of its cluster}."""
    points = set(points)
    around = tiles.disc(squared)
    near = {p: [q for i, j in around if (q := (p[0] + i, p[1] + j)) in points] for p in points}
    core = {p for p in points if len(near[p]) >= min_points}
    label = {}
    for p in sorted(core):
        if p not in label:
            label[p], stack = p, [p]
            while stack:
                for q in near[stack.pop()]:
                    if q in core and q not in label:
                        label[q] = p
                        stack.append(q)
    for p in points - core:
        names = [label[q] for q in near[p] if q in core]
        if names:
            label[p] = min(names)
    return label


def spiral(size):
    """A one-pixel path that winds inwards with a gap of one pixel."""
    out, r, c, d, steps = set(), 0, 0, 0, size - 1
    out.add((0, 0))
    lengths = [size - 1] + [k for k in range(size - 1, 0, -2) for _ in (0, 1)]
    for n in lengths:
        dr, dc = ((0, 1), (1, 0), (0, -1), (-1, 0))[d % 4]
        for _ in range(n):
            r, c = r + dr, c + dc
            out.add((r, c))
        d += 1
    return out


def found(spark, scenes, **how):
    rows = [(s, *p) for s, points in scenes.items() for p in points]
    out = {}
    for r in tiles.clusters(spark.createDataFrame(rows, POINTS), "scene", **how).collect():
        assert (r["row"], r["col"]) not in out.setdefault(r["scene"], {})
        out[r["scene"]][r["row"], r["col"]] = tuple(r["cluster"])
    return out


def blocks(rng, height, width, share):
    return {(int(r), int(c)) for r, c in np.argwhere(rng.random((height, width)) < share)}


def test_components_of_spirals_and_random_rasters_across_seams(spark):
    rng = np.random.default_rng(1)
    scenes = {"spiral": spiral(300), "random": blocks(rng, 300, 300, 0.4), "thin": blocks(rng, 3, 700, 0.6), "one": {(299, 5)}, "negative": {(r - 40, c - 200) for r, c in spiral(60)}}
    assert found(spark, scenes, squared=2, tile=32) == {s: by_hand(p, 2, 1) for s, p in scenes.items()}


@pytest.mark.parametrize(("squared", "min_points", "tile"), [(9, 10, 16), (4, 7, 9), (9, 4, 128)])
def test_density_clusters_equal_brute_force(spark, squared, min_points, tile):
    rng = np.random.default_rng(2)
    scenes = {"sparse": blocks(rng, 90, 200, 0.2), "dense": blocks(rng, 60, 60, 0.45), "patches": {(r, c) for r0, c0 in ((0, 12), (5, 1), (40, 90)) for r in range(r0, r0 + 4) for c in range(c0, c0 + 4)}}
    assert found(spark, scenes, squared=squared, min_points=min_points, tile=tile) == {s: p for s, points in scenes.items() if (p := by_hand(points, squared, min_points))}


def test_patches_beyond_eight_columns_keep_their_places(spark):
    points = [(0, r, c) for r in range(3) for c in range(12, 16)] + [(0, r, c) for r in range(3) for c in range(1, 4)]
    out = pixels.dbscan(spark.createDataFrame(points, "scene long, row long, col long"), "scene", eps=3, min_points=5).collect()
    assert len(out) == 21 and {(r["cluster"]["row"], r["cluster"]["col"], r["col"] > 8) for r in out} == {(0, 12, True), (0, 1, False)}


def test_cleaning_and_dilation_equal_whole_arrays(spark):
    rng = np.random.default_rng(3)
    on, place = rng.random((70, 150)) < 0.75, rng.random((70, 150)) < 0.97
    frame = lambda flags: spark.createDataFrame([(1, int(r), int(c)) for r, c in np.argwhere(flags)], "scene long, row long, col long")
    step = lambda flags, how: how([tiles.shifted(flags, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
    wanted = step(step(step(step(on & place, np.all), np.any) & place, np.any) & place, np.all)
    get = lambda f: {(r["row"], r["col"]) for r in f.collect()}
    assert get(tiles.cleaned(frame(on & place), frame(place), "scene", tile=20)) == {tuple(map(int, p)) for p in np.argwhere(wanted)}
    seeds = on & (rng.random(on.shape) < 0.05)
    assert get(tiles.dilate(frame(seeds), frame(place), "scene", 2, tile=16)) == {tuple(map(int, p)) for p in np.argwhere(step(step(seeds, np.any), np.any) & place)}


def test_core_points_count_neighbours_across_seams(spark):
    points = blocks(np.random.default_rng(4), 50, 80, 0.3)
    out = tiles.core_points(spark.createDataFrame([("s", *p) for p in points], POINTS), "scene", eps=3, min_points=10, tile=16).collect()
    near = {p: sum((p[0] + i, p[1] + j) in points for i, j in tiles.disc(9)) for p in points}
    assert {(r["row"], r["col"]): (r["n_near"], r["core"]) for r in out} == {p: (n, n >= 10) for p, n in near.items()}


def test_localisation_finds_a_patch_in_a_wide_zone(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 40)) * 0.05
    v[10:14, 30:34] += 2
    rows = [(1, 2, "a", r, c, float(v[r, c])) for r in range(40) for c in range(40)]
    frame = spark.createDataFrame(rows, "scene_id long, zone_id long, indicator string, row long, col long, value double")
    (one,) = detect.localised(frame, indicators=("a",), top_share=0.01, min_area_km2=0.001).collect()
    assert one["n_pixels"] == 16 and tuple(one["cluster"]) == (10, 30)


def test_no_points(spark):
    empty = spark.createDataFrame([], POINTS)
    assert tiles.clusters(empty, "scene", squared=2).count() == tiles.clusters(empty, "scene", squared=9, min_points=3).count() == 0
