"""Seasonal baselines against statistics window by window, and their extension by a week against a full build."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from tidewater.operators import baseline

OBS = "zone_id long, indicator string, observed_at timestamp, mean double"


def made(seed, zones, days, start=datetime.datetime(2019, 1, 1)):
    rng = np.random.default_rng(seed)
    rows = []
    for z in zones:
        for d in days:
            v = float(rng.normal())
            rows.append((z, "ab"[d % 2], start + datetime.timedelta(days=int(d), hours=5), None if d % 17 == 0 else float("nan") if d % 19 == 0 else v))
    return rows


def by_hand(rows):
    series = {}
    for z, i, at, v in rows:
        series.setdefault((z, i), []).append((at.timetuple().tm_yday, at.year, v))
    out = {}
    for key, own in series.items():
        for day in range(1, 367):
            near = [(y, v) for d, y, v in own if v is not None and np.isfinite(v) and min(abs(d - day), 366 - abs(d - day)) <= 15]
            v = np.array([x for _, x in near])
            if len(v):
                m = np.median(v)
                out[*key, day] = (*(round(float(x), 9) for x in (m, 1.4826 * np.median(abs(v - m)), *np.quantile(v, [0.1, 0.9]))), len(v), len({y for y, _ in near}))
            else:
                out[*key, day] = (None, None, None, None, 0, 0)
    return out


def rows_of(frame):
    return {(r["zone_id"], r["indicator"], r["doy"]): (*(None if r[c] is None else round(r[c], 9) for c in ("median", "sigma", "p10", "p90")), r["n_samples"], r["n_years"]) for r in frame.collect()}


def test_full_build_equals_windows_by_hand(spark, monkeypatch):
    rows = made(1, [1, 2], range(0, 900, 7)) + made(2, [3], [0, 364, 365, 730]) + [(4, "a", datetime.datetime(2020, 2, 29), None)]
    wanted = by_hand(rows)
    assert rows_of(baseline.seasonal_baseline(spark.createDataFrame(rows, OBS))) == wanted
    monkeypatch.setattr(baseline, "CELLS", 50)  # a few windows at a time
    doy, year, value = np.array([1, 1, 366, 180]), np.array([2019, 2020, 2020, 2020]), np.array([1.0, 3.0, 5.0, 7.0])
    found = baseline._windows(doy, year, value, np.arange(1, 367), 15)
    assert found[0][0] == 3.0 and found[4].tolist()[:2] == [3, 3] and found[5][0] == 2 and found[4].sum() == 31 * 4


def test_an_appended_week_equals_a_full_build_and_makes_few_windows(spark):
    old, week = made(3, [1, 2], range(0, 800, 5)), made(4, [2, 9], range(1090, 1097))  # across the new year; zone 9 is new
    before = baseline.seasonal_baseline(spark.createDataFrame(old, OBS)).cache()
    every, fresh = spark.createDataFrame(old + week, OBS), spark.createDataFrame(week, OBS)
    assert rows_of(baseline.extended_baseline(before, every, fresh)) == rows_of(baseline.seasonal_baseline(every)) == by_hand(old + week)
    counts = baseline.touched_windows(fresh).groupBy("zone_id", "indicator").count().agg(F.max("count")).first()[0]
    assert counts == 38  # seven days and fifteen on either side, and the day that only leap years have
    assert baseline.extended_baseline(before, every, fresh.limit(0)).exceptAll(before).count() == 0


def test_no_readings(spark):
    assert baseline.seasonal_baseline(spark.createDataFrame([], OBS)).count() == 0


def test_own_days_alone_have_the_windows_of_a_full_build(spark):
    rows = made(7, [1, 2], range(0, 900, 11)) + [(3, "a", None, 1.0)]
    full, own = (rows_of(baseline.seasonal_baseline(spark.createDataFrame(rows, OBS), own_days=k)) for k in (False, True))
    assert own == {k: v for k, v in full.items() if k in {(z, i, at.timetuple().tm_yday) for z, i, at, _ in rows if at}}


def test_looked_up_readings_and_counts_are_those_of_the_joined_baseline(spark):
    """With series over many batches, null keys, values and days, and windows that go round the year."""
    rows = [(k % 7 if k % 50 else None, "ab"[k % 2] if k % 41 else None, k * 83 % 2200 if k % 37 else None, float(k * 7919 % 1009) if k % 13 else None) for k in range(3000)]
    frame = spark.createDataFrame(rows, "zone_id long, indicator string, t long, mean double")
    obs = frame.select("zone_id", "indicator", F.expr("timestamp_ntz'2000-01-01' + make_dt_interval(CAST(t AS INT))").alias("observed_at"), "mean")
    known = obs.filter("observed_at IS NOT NULL")
    base = baseline.seasonal_baseline(known).join(baseline.history_days(obs).drop("history_from", "history_to"), ["zone_id", "indicator"])
    columns = ["zone_id", "indicator", "observed_at", "mean", *[F.round(c, 9).alias(c) for c in ("median", "sigma", "p10", "p90")], "n_samples", "n_years", "history_days"]
    want = obs.withColumn("doy", F.dayofyear("observed_at")).join(base, ["zone_id", "indicator", "doy"], "left").select(*columns)
    undated = F.col("observed_at").isNull()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        made = baseline.looked_up(baseline.dealt(obs, "zone_id"))
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
        got = made.withColumn("history_days", F.when(~undated, F.col("history_days"))).select(*columns).collect()
        counts = baseline.window_counts(known.filter("zone_id IS NOT NULL AND indicator IS NOT NULL")).select("zone_id", "indicator", F.posexplode("counts").alias("d", "n")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(repr, got)) == sorted(map(repr, want.collect())) and len(got) == 3000
    wanted = baseline.seasonal_baseline(known).filter("zone_id IS NOT NULL AND indicator IS NOT NULL").select("zone_id", "indicator", F.col("doy") - 1, "n_samples").collect()
    assert sorted(map(tuple, counts)) == sorted(map(tuple, wanted))
