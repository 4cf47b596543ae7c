"""Verdicts, recipients and resampling on small cases with nulls."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import alerts, detect, readmodels
from tidewater.sources import catalog


def test_zone_verdict_with_and_without_votes(spark):
    kind = "k int, anomalous array<string>, max_abs_z double, any_usable boolean, spatial array<struct<indicator: string, area_km2: double>>, multivariate boolean, mm_72h double, p90 double, n long"
    rows = [
        (1, [], None, True, None, None, None, None, None),
        (2, ["A"], 6.0, True, [("B", 0.25), ("A", 0.5)], True, 50.0, 20.0, 40),
        (3, [], 1.0, True, [("N", 0.25), ("A", 0.5), ("A", 0.1)], False, 50.0, 20.0, 40),
        (4, ["A"], 4.0, None, [], False, 5.0, 20.0, 40),
        (5, ["B"], 4.0, True, None, True, 50.0, 20.0, 40),
    ]
    out = {r["k"]: r for r in detect.zone_verdict(spark.createDataFrame(rows, kind), runoff=("A", "N")).collect()}
    facts = ("votes", "severity", "capped_from", "natural_cause_likely", "alertable", "suppressed_reason", "affected_area_km2")
    assert [out[1][c] for c in facts] == [0, None, None, False, False, "no detector voted", None]
    assert [out[2][c] for c in facts] == [3, "medium", "high", True, True, None, 0.75]
    assert [out[3][c] for c in facts] == [1, "low", None, True, True, None, 0.85] and out[3]["gate_input"] == ["A", "N"]
    assert [out[4][c] for c in facts] == [1, "low", None, False, False, "baseline building", None]
    assert out[5]["outcome"] == "other indicators" and out[5]["severity"] == "medium"


def test_a_district_miss_still_tries_the_area(spark):
    sent = spark.createDataFrame([(1, 7, "east", "high"), (2, 8, "west", "high"), (3, 9, None, "low")], "alert_id long, zone_id long, district string, severity string")
    people = spark.createDataFrame([(1, "east", "low", True), (2, None, "low", True), (3, "west", "low", True), (4, None, "high", True), (5, "east", "low", False)], "recipient_id long, district string, min_severity string, active boolean")
    square = [(who, k, x, y) for who in (1, 2, 3, 5) for k, (x, y) in enumerate(((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)))]
    areas = spark.createDataFrame(square, "recipient_id long, seq long, x double, y double")
    places = spark.createDataFrame([(7, 5.0, 5.0), (8, 50.0, 50.0), (9, 5.0, 6.0)], "zone_id long, px double, py double")
    pairs = alerts.matching_recipients(sent, people, places, areas, cell=4.0)
    assert sorted((r["alert_id"], r["recipient_id"]) for r in pairs.collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 1), (3, 2), (3, 3)]
    members = alerts.audiences(people, places, areas, cell=4.0)
    classes = alerts.reached(sent, members)
    for some in (sent, sent.filter("alert_id <> 2"), sent.limit(0)):
        wanted = sorted((r["alert_id"], r["recipient_id"]) for r in pairs.join(some.select("alert_id"), "alert_id", "left_semi").collect())
        assert sorted((r["alert_id"], r["recipient_id"]) for r in alerts.expanded(some, classes, members).collect()) == wanted
    assert classes.agg(F.sum("n_pairs")).first()[0] == pairs.count()


def test_classes_count_many_alerts_and_recipients_once(spark):
    sent = spark.range(600).select(F.col("id").alias("alert_id"), (F.col("id") % 2).alias("zone_id"), F.when(F.col("id") % 2 == 0, "east").alias("district"), F.when(F.col("id") % 3 == 0, "high").otherwise("low").alias("severity"))
    people = spark.range(500).select(F.col("id").alias("recipient_id"), F.when(F.col("id") % 5 > 0, "east").alias("district"), F.lit("medium").alias("min_severity"), (F.col("id") % 2 == 0).alias("active"))
    members = alerts.audiences(people)
    classes = alerts.reached(sent, members).collect()
    assert members.count() == 250 and members.select("audience").distinct().count() == 2
    # high ones of the east reach both audiences, those without a district only the recipients without one
    assert sorted((r["zone_id"], r["n_alerts"], r["n_recipients"], r["n_pairs"]) for r in classes) == [(0, 100, 50, 5000), (0, 100, 200, 20000), (1, 100, 50, 5000)]
    assert alerts.reached(sent.limit(0), members).count() == 0 == alerts.reached(sent, alerts.audiences(people.limit(0))).count()
    assert alerts.expanded(sent, alerts.reached(sent, members), members).count() == 30000


def test_smoother_scales_weights_where_values_are_missing(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0.0), (1, 0, 1, 4.0), (1, 1, 0, None), (2, 5, 5, 3.0), (3, 0, 0, None)], "s long, row long, col long, v double")
    out = {(r["s"], r["row"], r["col"]): r["v"] for r in catalog.smoother(cells, "s").collect()}
    assert len(out) == 20 and all(out[2, r, c] == 3.0 for r in (10, 11) for c in (10, 11))
    assert [out[1, 0, c] for c in range(4)] == pytest.approx([0.0, 1.0, 3.0, 4.0])
    assert out[1, 2, 0] == 0.0 and out[1, 3, 0] is None and out[3, 0, 0] is None


def test_feed_counts_all_that_was_chosen(spark):
    rows = spark.range(30).select("id", F.when(F.col("id") % 3 == 0, "open").otherwise("dismissed").alias("status"), F.lit("high").alias("severity"), (F.col("id") * 3).alias("priority"), F.lit("2020-01-01").alias("last_at"))
    page = alerts.feed(alerts.chosen(rows, min_severity="medium", min_priority=30), ties=["id"], limit=2, offset=1).collect()
    assert [(r["id"], r["total"]) for r in page] == [(24, 6), (21, 6)]


def test_zone_states_by_their_windows(spark):
    zones = spark.createDataFrame([(1,), (2,), (3,), (4,)], "zone_id long")
    windows = spark.createDataFrame([(1, "building"), (1, "usable"), (1, "usable"), (2, "building"), (4, None), (9, "usable")], "zone_id long, status string")
    out = {r["zone_id"]: (r["baseline"], r["n_usable"]) for r in readmodels.zone_states(zones, windows).collect()}
    assert out == {1: ("usable", 2), 2: ("building", 0), 3: ("none", 0), 4: ("building", 0)}
