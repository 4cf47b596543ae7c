"""Cases that a query and its SQL could both leave out."""

import json

from pyspark.sql import functions as F

from tidewater.operators import indicators
from tidewater.sources import catalog


def test_offset_reads_both_names_of_the_processing_baseline(spark):
    cases = [
        ({"s2:processing_baseline": "05.12", "earthsearch:boa_offset_applied": True}, 0),
        ({"s2:processing_baseline": "05.12"}, -1000),
        ({"s2:processing_baseline": "03.01"}, 0),
        ({"processing:baseline": "03.01"}, 0),
        ({"s2:processing_baseline": "", "processing:baseline": "03.01"}, 0),
        ({"s2:processing_baseline": "04.00", "processing:baseline": "03.01"}, -1000),
        ({"processing:baseline": "odd"}, -1000),
        ({}, -1000),
    ]
    frame = spark.createDataFrame([(k, json.dumps(p)) for k, (p, _) in enumerate(cases)], "k long, p string")
    out = {r["k"]: r["o"] for r in frame.select("k", catalog.boa_offset(F.from_json("p", catalog.ITEM_PROPERTIES)).alias("o")).collect()}
    assert out == {k: o for k, (_, o) in enumerate(cases)}


def test_display_range_is_null_where_the_ramp_leaves_nothing(spark):
    rows = [("out", 0.9), ("out", 2.0), ("in", -0.4), ("in", 0.4), ("below", -3.0), ("below", -1.0)]
    frame = spark.createDataFrame(rows, "k string, value double")
    out = {r["k"]: (r["low"], r["high"]) for r in indicators.stretch(frame, ["k"], floor=0.01, ramp=(-0.5, 0.5)).collect()}
    assert out["out"] == out["below"] == (None, None) and out["in"][0] < out["in"][1]
