"""What devices answer: pages, JSON, and what is neither."""

import pytest

from tidewater.streaming import telemetry


def card(label, value):
    return f'<DIV class="card"><div class="label">{label}</div>\n<div style="x" CLASS="value">{value}</div></div>'


PAGE = f"<html><meta http-equiv='refresh'>{card('TURBIDITY', '29.8 %')}{card('TDS', '68 ppm')}{card('<b>Probe</b> depth', '-1.50&nbsp;m')}<div class=\"status\">STATUS : <i>NORMAL</i> water</div></html>"
CASES = [
    (PAGE, {"turbidity": (29.8, "%"), "tds": (68.0, "ppm"), "probe_depth": (-1.5, "&nbsp;m")}, "NORMAL water", "html"),
    (card("Temp", "n/a") + card("", "5") + card("pH", "7."), {"ph": (7.0, ".")}, None, "html"),
    (card("TDS", "1 ppm") + card("tds", "2"), {"tds": (2.0, None)}, None, "html"),
    ("<div class='label'>TDS</div><p>between</p><div class='value'>about 12.5.1 x</div>", {"tds": (12.5, ".1 x")}, None, "html"),
    ("<p>no cards</p><div class='status'>Status: OK</div>", None, None, None),
    ("  \n", None, None, None),
    (None, None, None, None),
    ('{"device": "d1", "tds": {"value": 68, "unit": "ppm"}, "ph": {"value": "x"}, "n": 3, "device_status": "OK"}', {"tds": (68.0, "ppm")}, "OK", "json"),
    ('{"source": "wifi"}', {}, None, "wifi"),
    ("[1, 2]", None, None, None),
    ('{"broken": ', None, None, None),
    ("plain words", None, None, None),
]


def test_answers(spark):
    frame = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k long, body string")
    out = {r["k"]: r for r in telemetry.device_readings(frame, device="dev").collect()}
    for k, (body, readings, status, source) in enumerate(CASES):
        got = None if out[k]["readings"] is None else {x["key"]: (x["value"], x["unit"]) for x in out[k]["readings"]}
        assert (got, out[k]["device_status"], out[k]["source"]) == (readings, status, source), body
        assert out[k]["payload"] == (body if source and source != "html" else None) and out[k]["device"] == ("dev" if source == "html" else "d1" if k == 7 else None)


@pytest.mark.parametrize(("text", "number", "rest"), [("29.8 %", 29.8, "%"), ("-4", -4.0, ""), ("a-.5", 5.0, ""), ("x", None, ""), ("1.2.3", 1.2, ".3"), ("- 7 m", 7.0, "m"), ("°3", 3.0, ""), ("", None, "")])
def test_leading_numbers(spark, text, number, rest):
    from pyspark.sql import functions as F

    (row,) = spark.createDataFrame([(text,)], "t string").select(telemetry.leading_number(F.col("t")).alias("n")).first()
    assert row["value"] == number and (number is None or row["rest"] == rest)
