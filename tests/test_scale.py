"""Findings on larger tables: values on a threshold, work that is dealt out, and figures that grow with the input alone."""

import pathlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from tidewater.operators import baseline, detect, forest, readmodels, tiles
from tidewater.operators import geometry as G
from tidewater.plans import reports


def same(spark, name, folder):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(tuple, cursor.fetchall()), key=repr)
    got = sorted(map(tuple, entry.queries()[name](spark, str(folder)).select(*columns).collect()), key=repr)
    assert got == want
    return want


@pytest.mark.parametrize("name", ["M2_dilation", "M3_valid_mask", "D5_dbscan_clusters"])
def test_values_on_the_threshold_and_rows_without_id_are_as_in_the_sql(spark, tmp_path, name):
    rng = np.random.default_rng(1)
    values = rng.choice(np.array([0.15, 0.05, -0.2, 0.0, 0.16, 0.06], np.float32), (6, 64), p=[0.02, 0.3, 0.3, 0.16, 0.02, 0.2])
    ids, kinds = pa.array([1, 2, 3, 4, 5, None], pa.int64()), pa.list_(pa.float32())
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(list(values), kinds), "label": pa.array([0] * 6, pa.int32())}), tmp_path / "embeddings.parquet")
    assert same(spark, name, tmp_path)


def outlines(spark, n):
    rows = [(k, s, float(k % 7 * 300 + x * (200 + 13 * k)), float(k % 5 * 250 + y * (150 + 29 * k))) for k in range(n) for s, (x, y) in enumerate([(0, 0), (1, 0), (1.2, 0.5), (0.6, 1), (0, 0.8)])]
    return spark.createDataFrame(rows, "id long, seq long, x double, y double").coalesce(1)


def test_outlines_are_dealt_out_before_they_become_cells(spark):
    for cells in (G.rasterise(outlines(spark, 40), "id", step=50.0), G.rasterise_buffered(outlines(spark, 40), "id", step=50.0, buffer=120.0), G.partition(G.rasterise(outlines(spark, 40), "id", step=50.0).select("id", F.col("col").alias("x"), F.col("row").alias("y")), "id", k=4)):
        assert cells.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_cells_are_not_broadcast_and_pairs_are_those_of_all_cells(spark):
    cells = G.rasterise(outlines(spark, 25), "id", step=50.0)
    pairs = G.overlaps(cells, "id", least=0.3)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    held = {}
    for r in cells.collect():
        held.setdefault(r["id"], set()).add((r["row"], r["col"]))
    want = {(a, b): len(held[a] & held[b]) / len(held[a]) for a in held for b in held if a != b and len(held[a] & held[b]) / len(held[a]) >= 0.3}
    assert {(r["candidate"], r["other"]): r["ratio"] for r in pairs.collect()} == want


def test_a_point_meets_an_outline_once_and_in_its_box_alone(spark):
    v = outlines(spark, 25)
    points = spark.range(400).select(F.col("id").alias("pid"), (F.col("id") % 61 * 37).cast("double").alias("px"), (F.col("id") % 43 * 31 - 50).cast("double").alias("py"))
    found = G.points_in(points, v, "id", cell=100.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < (plan.index("Aggregate") if "Aggregate" in plan else len(plan))  # no counting of crossings after the join
    e = [r for r in G.edges(v, "id").collect()]
    at = [(p["pid"], p["px"], p["py"]) for p in points.collect()]
    want = []
    for pid, px, py in at:
        for key in range(25):
            crossed = [r for r in e if r["id"] == key and (r["y"] > py) != (r["y2"] > py) and px < (r["x2"] - r["x"]) * (py - r["y"]) / (r["y2"] - r["y"]) + r["x"]]
            want += [(pid, key)] if len(crossed) % 2 else []
    assert sorted((r["pid"], r["id"]) for r in found.collect()) == sorted(want)


def test_only_tiles_with_own_pixels_are_worked_on_and_cut_to_them(spark):
    points = spark.range(50).select(F.col("id").alias("scene"), F.lit(1).cast("long").alias("row"), F.lit(2).cast("long").alias("col"), F.lit(True).alias("on"))

    def work(t):
        return {"row": np.array([t.flags("on").size]), "col": np.array([0])}

    found = tiles.by_tile(points, "scene", 4, work, tiles.PLACE)
    assert [(r["row"], r["n"]) for r in found.groupBy("row").agg(F.count("*").alias("n")).collect()] == [(81, 50)]


def test_trees_are_those_of_the_plain_way_to_grow_them():
    x = np.random.default_rng(5).normal(size=(300, 3)).round(1)
    t = forest.Trees(7, 64)
    t.grow(np.array([5, 6, 0, 1]), x, np.random.default_rng((1, 2)))
    # the same draws, node by node
    rng = np.random.default_rng((1, 2))
    chosen = np.argsort(rng.random((4, 300)), axis=1)[:, :64]
    nodes = {(tree, 0): x[rows] for tree, rows in sorted(zip([5, 6, 0, 1], chosen, strict=True), key=lambda p: p[0])}
    for level in range(7):
        order = sorted(nodes)
        wide = np.array([nodes[k].max(0) > nodes[k].min(0) for k in order])
        pick = np.argmax(np.where(wide, rng.random(wide.shape), -1), axis=1)
        share = 1 - rng.random(len(order))
        below = {}
        for k, f, s, w in zip(order, pick, share, wide, strict=True):
            rows = nodes[k]
            if len(rows) < 2 or not w.any() or level == 6:
                assert t.feature[k] == -1 and t.rest[k] == forest.expected_path(len(rows))
                continue
            cut = rows[:, f].min() + (rows[:, f].max() - rows[:, f].min()) * s
            assert (t.feature[k], t.cut[k]) == (f, cut)
            for side in (False, True):
                part = rows[(rows[:, f] >= cut) == side]
                if len(part):
                    below[k[0], 2 * k[1] + 1 + side] = part
        nodes = below


def test_water_extent_deltas_equal_brute_force_and_copy_no_reading(spark):
    rng = np.random.default_rng(2)
    rows = [(int(z), int(d), int(d) % 366 + 1, None if rng.random() < 0.2 else float(rng.integers(0, 5))) for z, d in zip(rng.integers(0, 3, 150), rng.integers(0, 900, 150), strict=True)]
    w = spark.createDataFrame(rows, "zone_id long, day int, doy int, v double").withColumn("observed_at", F.expr("timestamp'2000-01-01' + make_interval(0, 0, 0, day)"))
    found = detect.extent_deltas(w)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    want = []
    for z, d, y, v in set(rows):
        past = [b for a, e, x, b in rows if a == z and e < d and min(abs(x - y), 366 - abs(x - y)) <= 15]
        known = [b for b in past if b is not None]
        if past:
            want.append((z, d, None if v is None or not known else v - float(np.median(known)), len(past)))
    got = [tuple(r) for r in found.select("zone_id", F.expr("CAST(datediff(observed_at, timestamp'2000-01-01') AS INT)"), "delta", "n").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_series_are_dealt_out_before_their_windows_are_made(spark):
    obs = spark.range(400).select((F.col("id") % 40).alias("zone_id"), F.lit("A").alias("indicator"), F.expr("timestamp'2000-01-01' + make_interval(0, 0, 0, CAST(id AS INT))").alias("observed_at"), F.col("id").cast("double").alias("mean"))
    made = baseline.seasonal_baseline(obs.coalesce(1))
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_an_items_json_is_parsed_once_a_row(spark):
    folder = pathlib.Path("/root/testdata/sf0.001")
    plan = entry.queries()["S2_scene_catalog"](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") + plan.count("JsonToStructs") <= 4
    assert same(spark, "S2_scene_catalog", folder)


def test_the_report_makes_its_rows_once(spark):
    """No join with sums of its own rows, and no windows of days that have no readings."""
    plan = reports.report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
    scenes = reports.report(spark, "/root/testdata/sf0.001").filter("mndwi_extent <> ''").groupBy("scene_id").agg(F.round(F.sum(F.col("mndwi_extent").cast("double")), 4).alias("sum"), F.min(F.col("water_extent_km2").cast("double")).alias("low"), F.max(F.col("water_extent_km2").cast("double")).alias("high"))
    assert scenes.count() and scenes.filter("low <> high OR abs(low - sum) > 1e-4").count() == 0


def test_new_dispatches_are_decided_where_their_pairs_are_made(spark):
    """No pair is stored, nor shuffled to meet the log."""
    folder = pathlib.Path("/root/testdata/sf0.01")
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    frame = entry.queries()["P2_new_dispatches"](spark, str(folder))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Exchange") and "LeftOuter" not in plan
    assert sum(spark.read.parquet(str(p)).count() for p in set(shared.iterdir()) - before) < len(same(spark, "P2_new_dispatches", folder))


@pytest.mark.parametrize("name", ["Q7_series_payload", "J5_brief_series", "J5_episode_briefs"])
def test_readings_are_scored_once_and_only_what_is_asked_is_stored(spark, name):
    folder = pathlib.Path("/root/testdata/sf0.001")
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    frame = entry.queries()[name](spark, str(folder))
    (table,) = set(shared.iterdir()) - before
    assert table.name.startswith("scored") and not {"direction", "reason", "n_samples", "n_years", "status"} & set(spark.read.parquet(str(table)).columns)
    assert "InArrow" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert same(spark, name, folder)


def test_the_day_report_shuffles_zones_times_days_once(spark):
    of = lambda rows, kind: spark.createDataFrame(rows, kind)
    days = of([(1, d, 10 + d, 5) for d in range(4)] + [(2, 0, 20, 6)], "body_id long, day int, scene_id long, cloud_pct long")
    zones = of([(7, 1), (8, 1), (9, None)], "zone_id long, body_id long")
    facts = {
        "masks": of([(10, True)], "scene_id long, mask_usable boolean"), "runs": of([(11, "done")], "scene_id long, run_status string"), "rain": of([(2, 0, 1.5)], "body_id long, day int, mm double"),
        "readings": of([(10, 7, 0.5), (99, 7, 0.6), (12, 9, 0.7)], "scene_id long, zone_id long, mean double"), "candidates": of([(11, 8, "low", True)], "scene_id long, zone_id long, severity string, alertable boolean"),
        "scores": of([(11, 8, "high", False)], "scene_id long, zone_id long, score_severity string, score_alertable boolean"), "alerts": of([(8, 3, "x")], "zone_id long, day int, alert_id string"),
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = readmodels.day_report(days, zones, **facts)
        plan = made._jdf.queryExecution().executedPlan().toString()
        got = {(r["body_id"], r["day"], r["zone_id"], r["mean"], r["severity"], r["alertable"], r["alert_id"], r["mm"], r["mask_usable"], r["run_status"]) for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(scene_id#\d+L?, zone_id|hashpartitioning\(zone_id#\d+L?, day|hashpartitioning\(_p", plan)
    want = {(1, d, z, 0.5 if (d, z) == (0, 7) else None, "high" if (d, z) == (1, 8) else None, False if (d, z) == (1, 8) else None, "x" if (d, z) == (3, 8) else None, None, True if d == 0 else None, "done" if d == 1 else None) for d in range(4) for z in (7, 8)}
    assert got == want | {(2, 0, None, None, None, None, None, 1.5, None, None)} and made.count() == 9


def test_trees_of_many_passes_are_grown_together_and_judge_as_pass_by_pass(monkeypatch):
    rng = np.random.default_rng(4)
    n, trees, sample, lag, seed = 150, 40, 64, 0.05, 5
    wide, water, rain, doy = rng.normal(size=(n, 2)).round(1), rng.normal(size=n), rng.gamma(1, 3, n), np.arange(n) * 5 % 365 + 1
    wide[rng.random(wide.shape) < 0.4] = np.nan
    calls, plain = [], forest.Trees.grow_all
    monkeypatch.setattr(forest.Trees, "grow_all", lambda self, jobs: calls.append(len(jobs)) or plain(self, jobs))
    found = forest.judged_series(wide, water, rain, doy, trees=trees, sample=sample, contamination=0.05, min_history=20, reach=15, lag=lag, seed=seed)
    assert len(calls) < 20 and sum(calls) == n - 20
    season, one, turn, paths = forest.SeasonalMedian(15), forest.Trees(trees, sample), 0, np.zeros((trees, n))
    for k in range(n):
        past = np.column_stack((wide[: k + 1], water[: k + 1] - season.median[doy[: k + 1]], rain[: k + 1]))
        known = [c[:k][np.isfinite(c[:k])] for c in past.T]
        past = np.where(np.isfinite(past), past, [np.median(c) if len(c) else 0.0 for c in known])
        season.add(int(doy[k]), float(water[k]))
        if k < 20:
            continue
        renewed = np.arange(trees) if k == 20 else np.arange(turn, turn + int(np.ceil(trees / max(1.0, lag * k)))) % trees
        turn = (turn + len(renewed)) % trees
        one.grow(renewed, past[:k], np.random.default_rng((seed, k)))
        paths[renewed, :k], paths[:, k] = one.paths(renewed, past[:k]), one.paths(np.arange(trees), past[k:])[:, 0]
        score = 2.0 ** -paths[:, : k + 1].mean(0)
        if np.isfinite(wide[k]).any():
            assert found[1][k] == score[k] and found[2][k] == (score[k] > np.quantile(score[:k], 0.95))
        else:
            assert np.isnan(found[1][k]) and found[4][k] == 2


def test_covering_tiles_deals_outlines_out_and_hands_none_alone_to_python(spark):
    v = outlines(spark, 60).select("id", "seq", (F.col("x") / 1e4).alias("x"), (F.col("y") / 1e4).alias("y"))
    plan = G.covering_tiles(v, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("MapInArrow") == 2
    assert G.simplified(v, "id", tolerance=0.001).select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_tile_names_are_those_of_the_columns_series(spark):
    places = [(x * 7.3 - 179, y * 4.1 - 79.9) for x in range(49) for y in range(40)]
    frame = spark.createDataFrame(places, "lon double, lat double").withColumn("z", G.grid_zone(F.col("lon"), F.col("lat")))
    e, n = G.to_utm(F.col("lon"), F.col("lat"), F.col("z"))
    by = {(r["lon"], r["lat"]): r for r in frame.withColumns({"e": F.floor(e / 100_000), "n": F.floor(n / 100_000)}).collect()}
    for r in G.tile_names(frame).collect():
        want = by[r["lon"], r["lat"]]
        row = "ABCDEFGHJKLMNPQRSTUV"[(want["n"] + (5 if want["z"] % 2 == 0 else 0)) % 20]
        assert r["tile"] == f"{want['z']:02d}" + "CDEFGHJKLMNPQRSTUVWX"[min(int((r["lat"] + 80) // 8), 19)] + "ABCDEFGHJKLMNPQRSTUVWXYZ"[(want["z"] - 1) % 3 * 8 + want["e"] - 1] + row


def test_send_decisions_are_those_by_a_log_and_no_pair_is_shuffled(spark):
    from tidewater.operators import alerts
    from tidewater.plans import alerting

    folder = "/root/testdata/sf0.001"
    frame = entry.queries()["P2_send_decisions"](spark, folder)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" not in plan and "Exchange" not in plan[: plan.index("Join")]
    p = alerting.pairs(spark, folder)
    log = p.filter("(alert_id + recipient_id) % 4 = 0").select("alert_id", "recipient_id", F.lit("medium").alias("severity"))
    want = alerts.send_decisions(p, log)
    assert want.count() and sorted(map(tuple, frame.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_places_without_alerts_meet_no_area(spark):
    """What is asked by area grows with the zones that have alerts, not with all places."""
    from tidewater.operators import alerts

    of = lambda rows, kind: spark.createDataFrame(rows, kind)
    sent = of([(1, 3, "x", "high")], "alert_id long, zone_id long, district string, severity string")
    people = of([(k, None, "low", True) for k in range(4)], "recipient_id long, district string, min_severity string, active boolean")
    places = of([(z, 5.0, 5.0) for z in range(50)], "zone_id long, px double, py double")
    areas = of([(k, s, x, y) for k in range(4) for s, (x, y) in enumerate([(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)])], "recipient_id long, seq long, x double, y double")
    pairs = alerts.matching_recipients(sent, people, places, areas, cell=4.0)
    assert sorted((r["alert_id"], r["recipient_id"]) for r in pairs.collect()) == [(1, k) for k in range(4)]
    assert "LeftSemi, zone_id" in re.sub(r"\(?(zone_id)#\d+L?", r"\1", pairs._jdf.queryExecution().optimizedPlan().toString()).replace("LeftSemi, (", "LeftSemi, ")


def test_zone_centres_are_dealt_out_whatever_the_number_of_partitions(spark):
    from tidewater.operators import zoning

    spark.conf.set("spark.sql.shuffle.partitions", "32")  # that which spread would choose by itself
    try:
        made = zoning.centres(outlines(spark, 40), "id", pixel=20)
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 4
        cells = G.rasterise(outlines(spark, 40).groupBy("id", "seq").agg(F.max("x").alias("x"), F.max("y").alias("y")).repartition(32, "id"), "id", step=50.0)
        assert cells.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_k_means_by_lines_leaves_each_cell_with_its_nearest_centre():
    rng = np.random.default_rng(6)
    grid = np.array([(x * 10.0, y * 10.0) for x in range(12) for y in range(90) if (x - 6) ** 2 + (y - 40) ** 2 / 30 < 70 and (x, y % 17) != (5, 3)])
    for points in (grid, rng.permutation(grid), rng.random((300, 2)), np.repeat(rng.random((3, 2)), 4, axis=0)):
        zone = G.k_means(points, 5, 10)
        k = zone.max() + 1
        assert sorted(set(zone.tolist())) == list(range(k)) and k == min(5, len(np.unique(points, axis=0)))
        centres = np.array([points[zone == z].mean(0) for z in range(k)])
        away = ((points[:, None] - centres) ** 2).sum(2)
        assert (away[np.arange(len(points)), zone] <= away.min(1) * (1 + 1e-9) + 1e-9).all()
    assert len(G._lines(*grid.T)[0]) < 60


def test_outlines_are_cut_into_strips_only_where_points_are(spark):
    """The strips grow with the points' extent, not with the outlines' height; strips of many edges count like those of few."""
    tall = [(k, s, float(x * 40 + k), float(y * 1e6)) for k in range(5) for s, (x, y) in enumerate([(0, 0), (1, 0), (1.2, 0.5), (0.6, 1), (0, 0.8)])]
    comb = [(9, s, 20.0 + 2 * s, 90.0 if s % 2 else 5.0) for s in range(20)] + [(9, 20, 60.0, 0.0), (9, 21, 20.0, 0.0)]
    v = spark.createDataFrame(tall + comb, "id long, seq long, x double, y double")
    points = spark.range(400).select(F.col("id").alias("pid"), (F.col("id") % 61 * 1.3).alias("px"), (F.col("id") % 43 * 2.1 - 5).alias("py"))
    found = G.points_in(points, v, "id", cell=10.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_high" in plan and "_east" in plan
    e = G.edges(v, "id").collect()
    want = [(p["pid"], k) for p in points.collect() for k in (0, 1, 2, 3, 4, 9) if sum(r["id"] == k and (r["y"] > p["py"]) != (r["y2"] > p["py"]) and p["px"] < (r["x2"] - r["x"]) * (p["py"] - r["y"]) / (r["y2"] - r["y"]) + r["x"] for r in e) % 2]
    assert any(k == 9 for _, k in want) and sorted((r["pid"], r["id"]) for r in found.collect()) == sorted(want)
    assert same(spark, "G5_point_in_polygon", pathlib.Path("/root/testdata/sf0.001")) is not None
