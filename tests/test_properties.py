"""Operators that SQL cannot express, against small brute force and by their properties."""

import datetime
import os
import tempfile

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tidewater.operators import alerts, detect, forest, fuse, learned
from tidewater.plans.catalog import QUERIES
from tidewater.streaming import runs, telemetry

FOLDER = "/root/testdata/sf0.001"


def series(zone, n, planted=()):
    """Passes every five days; planted ones deviate in all four indicators without rain or a change of water."""
    rng = np.random.default_rng(zone)
    rows = []
    for k in range(n):
        at = datetime.datetime(2020, 1, 1) + datetime.timedelta(days=5 * k)
        x = (rng.normal(size=4) * 0.1 + (3.0 if k in planted else 0.0)).tolist()
        if zone == 4 and k % 3 == 0:
            x = [None] * 4
        rows.append((zone, at, *x, float(40 + 5 * np.sin(k / 11) + rng.normal() * 0.1), None if k % 7 == 0 else 0.0))
    return rows


PASSES = "zone_id long, observed_at timestamp, a double, b double, c double, d double, water_fraction_pct double, mm_72h double"


def test_every_pass_is_judged_by_those_before_it(spark):
    rows = series(1, 150, planted=(90, 149)) + series(2, 150) + series(4, 60) + series(5, 19)
    frame = spark.createDataFrame(rows, PASSES)
    out = {(r["zone_id"], r["observed_at"]): r for r in forest.judged_passes(frame, tuple("abcd"), trees=100).collect()}
    again = {(r["zone_id"], r["observed_at"]): r for r in forest.judged_passes(frame.repartition(5), tuple("abcd"), trees=100).collect()}
    assert out == again and len(out) == len(rows)
    at = lambda zone, k: out[zone, datetime.datetime(2020, 1, 1) + datetime.timedelta(days=5 * k)]
    assert at(1, 90)["outlier"] and at(1, 149)["outlier"] and at(1, 90)["score"] > max(at(1, k)["score"] for k in range(60, 90))
    assert np.mean([at(2, k)["outlier"] for k in range(20, 150)]) < 0.35
    assert at(2, 19)["reason"] == "19 of 20 passes" and at(2, 19)["score"] is None and at(2, 20)["reason"] is None and at(2, 20)["n_history"] == 20
    assert at(4, 30)["reason"] == "no indicator" and at(4, 31)["score"] is not None and at(5, 18)["reason"] == "18 of 20 passes"
    assert at(2, 70)["imputed"] == "mm_72h" and at(4, 30)["imputed"] == "a,b,c,d"
    # What comes later changes nothing.
    cut = forest.judged_passes(spark.createDataFrame(rows[:100], PASSES), tuple("abcd"), trees=100).collect()
    assert all(out[r["zone_id"], r["observed_at"]] == r for r in cut)


def test_a_forest_in_turns_is_near_one_grown_anew():
    rng = np.random.default_rng(3)
    wide, n = rng.normal(size=(120, 4)), 120
    wide[100] = 4
    fixed = {"trees": 200, "sample": 64, "contamination": 0.05, "min_history": 20, "reach": 15, "seed": 9}
    water, rain, doy = rng.normal(size=n), np.zeros(n), (np.arange(n) * 5) % 365 + 1
    turns, anew = (forest.judged_series(wide, water, rain, doy, lag=lag, **fixed) for lag in (0.05, 0.0))
    assert np.nanmax(np.abs(turns[1] - anew[1])) < 0.06 and turns[2][100] and anew[2][100]
    assert np.corrcoef(turns[1][20:], anew[1][20:])[0, 1] > 0.97


def test_seasonal_medians_are_of_the_passes_seen_so_far():
    rng = np.random.default_rng(8)
    season, seen = forest.SeasonalMedian(15), []
    for _ in range(300):
        doy, value = int(rng.integers(1, 367)), float(rng.normal())
        season.add(doy, value)
        seen.append((doy, value))
    for day in (1, 5, 180, 366):
        near = [v for d, v in seen if min(abs(d - day), 366 - abs(d - day)) <= 15]
        assert season.median[day] == pytest.approx(np.median(near))


def test_forest_paths_equal_the_expectation_on_uniform_rows():
    rng = np.random.default_rng(2)
    x = rng.random((400, 2))
    found = forest.scores(x, np.vstack((x, [[9.0, 9.0]])), trees=200, sample=256, seed=3)
    assert abs(found[:-1].mean() - 0.45) < 0.07 and found[-1] > found[:-1].max() and found.max() < 1
    assert forest.scores(np.ones((50, 2)), np.ones((1, 2)), trees=20, sample=32, seed=1)[0] == pytest.approx(0.5, abs=0.05)


def localised_by_hand(points, top_share, floor, eps, least, min_pixels, most, among, spread):
    zones = {}
    for scene, zone, ind, r, c, v in points:
        zones.setdefault((scene, zone), {}).setdefault(ind, []).append((r, c, v))
    found = {}
    for key, by in zones.items():
        best = None
        for ind in ("high", "low"):
            cells = by.get(ind, [])
            v = np.array([x[2] for x in cells])
            med = np.median(v)
            z = (v - med) / max(1.4826 * np.median(abs(v - med)), 0.01)
            cut = max(np.quantile(z, 1 - top_share), floor)
            hot = {(r, c): s for (r, c, _), s in zip(cells, z, strict=True) if s > cut}
            near = {p: [q for q in hot if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for p in hot}
            core = {p for p in hot if len(near[p]) >= least}
            label = {}
            for p in sorted(core):
                if p not in label:
                    label[p], stack = p, [p]
                    while stack:
                        for q in near[stack.pop()]:
                            if q in core and q not in label:
                                label[q] = p
                                stack.append(q)
            for p in hot:
                if p not in core and (names := [label[q] for q in near[p] if q in core]):
                    label[p] = min(names)
            groups = {}
            for p, name in label.items():
                groups.setdefault(name, []).append(p)
            kept = sorted(((-len(g), name, g) for name, g in groups.items() if len(g) >= min_pixels), key=lambda x: x[:2])
            if kept:
                centre = lambda g: np.mean(g, axis=0)
                near_ = [k for k in kept[:among] if np.hypot(*(centre(k[2]) - centre(kept[0][2]))) <= spread][:most]
                if best is None or -kept[0][0] > best[0]:
                    best = (-kept[0][0], ind, sorted((len(g), round(max(hot[p] for p in g), 6)) for _, _, g in near_))
        if best:
            found[key] = best[1:]
    return found


def test_localisation_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    points = []
    for scene in range(6):
        for zone in range(2):
            v = rng.normal(size=(16, 16))
            v[3:6, 2:6] += 4
            v[10:12, 12:15] += 3 * (scene % 2)
            points += [(scene, zone, ind, r, c, float(s * v[r, c])) for ind, s in (("high", 1), ("low", -1)) for r in range(16) for c in range(16)]
    frame = spark.createDataFrame(points, "scene_id long, zone_id long, indicator string, row long, col long, value double")
    out = {}
    for r in detect.localised(frame, indicators=("high", "low"), top_share=0.1, z_floor=1.0, eps=2, min_points=4, min_area_km2=3e-4, spread=8).collect():
        out.setdefault((r["scene_id"], r["zone_id"]), [r["indicator"], []])[1].append((r["n_pixels"], round(r["max_z"], 6)))
    assert {k: (i, sorted(x)) for k, (i, x) in out.items()} == localised_by_hand(points, 0.1, 1.0, 2, 4, 3, 3, 12, 8)


NAMES = ["a", "b", "c"]


def examples(spark, n, noise=5.0):
    rng = np.random.default_rng(7)
    x = rng.random((n, 3))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.7, 90.0, 10.0) + rng.normal(size=n) * noise
    return spark.createDataFrame([(k, *map(float, r), float(t), float(100 * r[2])) for k, (r, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, target double, score double")


def test_attribution_sums_to_the_model_and_rounds_stop_early(spark):
    data = examples(spark, 400)
    model = learned.fit_priority(data, NAMES, rounds=12, patience=3)
    parts = learned.attribute(model, data, NAMES, "id").collect()
    assert len(parts) == 400 and all(r["prediction"] == pytest.approx(r["base"] + r["a_a"] + r["a_b"] + r["a_c"]) for r in parts)
    assert sum(abs(r["a_a"]) for r in parts) > 5 * sum(abs(r["a_c"]) for r in parts) > 0
    (m,) = model.metrics.collect()
    assert 1 <= m["rounds"] <= 12 and m["mae"] < 20 and m["mae"] <= m["rmse"]


def test_batches_of_trees_give_the_trees_of_all_rounds(spark):
    data = examples(spark, 200).coalesce(2).persist()
    whole, parts = (learned.fit_priority(data, NAMES, rounds=24, patience=6, rate=0.3, batch=b) for b in (24, 3))
    for field in ("feature", "cut", "value"):
        assert np.array_equal(getattr(whole, field), getattr(parts, field))
    assert whole.metrics.collect() == parts.metrics.collect()
    data.unpersist()


def test_no_more_trees_are_grown_than_it_takes_to_see_the_best(spark, monkeypatch):
    grown, step = [], learned._step
    monkeypatch.setattr(learned, "_step", lambda *a: grown.append(len(a[0])) or step(*a))
    data = examples(spark, 300)
    model = learned.fit_priority(data, NAMES, rounds=60, patience=2, rate=0.5)
    kept = len(model.feature)
    assert kept + 2 < 60 and grown == list(range(kept + 3))


def test_trees_are_about_as_good_as_those_of_spark_ml(spark):
    data = examples(spark, 600).persist()
    whole = learned.fit_priority(data, NAMES, rounds=10, patience=10, share=1.0)
    held = F.pmod(F.xxhash64(*NAMES, F.lit(42)), F.lit(5)) == 0
    rows = VectorAssembler(inputCols=NAMES, outputCol="x").transform(data)
    model = GBTRegressor(featuresCol="x", labelCol="target", maxDepth=3, maxIter=10, stepSize=0.05, seed=42).fit(rows.filter(~held))
    theirs = model.evaluateEachIteration(rows.filter(held), "squared")[len(whole.feature) - 1] ** 0.5
    assert whole.metrics.first()["rmse"] == pytest.approx(theirs, rel=0.15)
    data.unpersist()


def test_copies_of_examples_weigh_as_often_as_they_are_there(spark):
    data = examples(spark, 200)
    once, thrice = (learned.fit_priority(d, NAMES, rounds=4, share=1.0) for d in (data, data.unionAll(data).unionAll(data)))
    assert np.array_equal(once.feature, thrice.feature) and np.allclose(once.value, thrice.value)
    missing = data.withColumn("a", F.when(F.col("id") % 4 > 0, F.col("a")))
    parts = learned.attribute(learned.fit_priority(missing, NAMES, rounds=4, share=1.0), missing, NAMES, "id").collect()
    assert len(parts) == 200 and all(np.isfinite(r["prediction"]) for r in parts)


def test_alerts_of_one_district_meet_recipients_in_many_tasks(spark):
    found = spark.range(400).select(F.col("id").alias("alert_id"), F.lit(1).cast("long").alias("zone_id"), F.lit("d").alias("district"), F.lit("high").alias("severity"))
    recipients = spark.range(30).select(F.col("id").alias("recipient_id"), F.when(F.col("id") % 3 > 0, "d").alias("district"), F.lit("low").alias("min_severity"), F.lit(True).alias("active"))
    pairs = alerts.matching_recipients(found, recipients).select("alert_id", "recipient_id", F.spark_partition_id().alias("part")).collect()
    assert len(pairs) == 12000 == len({(p["alert_id"], p["recipient_id"]) for p in pairs}) and len({p["part"] for p in pairs}) > 4


def test_retrain_promotes_only_what_is_better(spark):
    data = examples(spark, 300, noise=0.0)
    (row,) = learned.guarded_retrain(data, NAMES, rounds=8).collect()
    assert row["promoted"] and row["new_precision"] > row["old_precision"] and 40 < row["n_held"] < 110
    (same,) = learned.guarded_retrain(data.withColumn("score", F.col("target")), NAMES, rounds=8).collect()
    assert not same["promoted"] and same["reason"] == "not better" and same["old_precision"] == 1.0
    assert learned.guarded_retrain(data.limit(30), NAMES).first()["reason"] == "30 of 50 examples"
    assert learned.guarded_retrain(data.limit(0), NAMES).first()["reason"] == "0 of 50 examples"


def test_projection_is_exact_both_ways(spark):
    rows = QUERIES[next(k for k in QUERIES if k.startswith("G1_"))](spark, FOLDER)
    out = rows.collect()
    assert out and all(r["exact"] for r in out)


def test_reference_scene_equals_all_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(3)), k, datetime.datetime(2018, 1, 1) + datetime.timedelta(hours=int(rng.integers(24 * 1400)))) for k in range(150)]
    frame = spark.createDataFrame(rows, "body_id long, scene_id long, sensed_at timestamp")
    out = {r["current_id"]: (r["scene_id"], r["gap"], r["same_season"]) for r in alerts.reference_scene(frame, frame).collect()}
    wanted = {}
    for body, scene, at in rows:
        best = None
        for b, other, then in rows:
            if b == body and then < at - datetime.timedelta(days=1):
                x = abs(at.timetuple().tm_yday - then.timetuple().tm_yday)
                gap = min(x, 366 - x)
                season = then.year < at.year and gap <= 45
                rank = (not season, gap, -then.timestamp(), other)
                if best is None or rank < best[0]:
                    best = (rank, (other, gap, season))
        if best:
            wanted[scene] = best[1]
    assert out == wanted


def test_episodes_take_late_candidates_backwards(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    day = lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=n)
    kind = "zone_id long, indicator string, candidate_id long, observed_at timestamp"
    spark.createDataFrame([(1, "x", 1, day(30)), (1, "x", 2, day(40)), (1, "x", 3, day(80)), (2, "x", 9, day(0))], kind).coalesce(1).write.parquet(f"{folder}/a/part=1")
    spark.createDataFrame([(1, "x", 4, day(18)), (1, "x", 6, day(70))], kind).coalesce(1).write.parquet(f"{folder}/a/part=2")
    spark.createDataFrame([(1, "x", 5, day(5))], kind).coalesce(1).write.parquet(f"{folder}/a/part=3")
    for k, sub in enumerate(("part=1", "part=2", "part=3")):
        for name in os.listdir(f"{folder}/a/{sub}"):
            os.utime(f"{folder}/a/{sub}/{name}", (1_600_000_000 + k * 1000,) * 2)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/a")
    out = {r["candidate_id"]: r["episode"] for r in runs.run_through(telemetry.episodes(stream)).collect()}
    assert out == {1: 1, 2: 1, 3: 2, 9: 1, 4: 1, 5: 1, 6: 2}


def test_six_stems_make_wording_unsafe(spark):
    rows = spark.createDataFrame([("the plain words",), ("Illegally dumped",), ("no TOXICITY",)], "t string")
    from tidewater.plans.fusion import STEMS

    assert [r[0] for r in rows.select(fuse.unsafe_wording(F.col("t"), STEMS)).collect()] == [False, True, True]
