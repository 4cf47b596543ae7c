"""Telemetry queries (T): streams run over all that has landed, and batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.plans.alerting import EPISODES
from tidewater.plans.bindings import table
from tidewater.plans.registry import query
from tidewater.streaming import episodes as E
from tidewater.streaming import runs
from tidewater.streaming import telemetry as T
from tidewater.streaming.rollup import StageInput, WeeklyRollup


@query("T1_streaming_weekly_rollup", "SELECT event_type, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t1(spark, d):
    stream = T.weekly(runs.landed(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    r = runs.latest(runs.run_through(stream, mode="update"), ["event_type", "week"])
    return r.select("event_type", F.col("week").cast("timestamp_ntz").alias("week"), "n", F.round("total", 4).alias("total"))


@query("T2_exactly_once", "SELECT DISTINCT l_suppkey AS body_id, l_orderkey AS scene_id FROM lineitem")
def t2(spark, d):
    """Lines as redelivered (body, scene) messages, all of one landing time, so each is processed once."""
    lines = runs.landed(spark, d, "lineitem").select(F.col("l_suppkey").alias("body_id"), F.col("l_orderkey").alias("scene_id"), F.lit("2001-01-01").cast("timestamp").alias("ts"))
    return runs.run_through(T.once(lines, ["body_id", "scene_id"])).select("body_id", "scene_id")


@query("T3_stateful_episodes", EPISODES + "\n---\nSELECT candidate_id, episode FROM ep", uses=("candidates",))
def t3(spark, d):
    """The orders as a stream of candidates; customers, a dimension, are joined as a table."""
    nation = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    price = F.floor("o_totalprice").cast("long")
    stream = runs.landed(spark, d, "orders").filter("o_orderkey % 4 > 0").join(nation, "o_custkey").filter(price.isNotNull())
    stream = stream.select(F.col("c_nationkey").alias("zone_id"), F.col("o_orderpriority").alias("indicator"), F.col("o_orderkey").alias("candidate_id"), F.col("o_orderdate").alias("observed_at"))
    return runs.run_through(T.episodes(stream)).select("candidate_id", "episode")


@query("T1_incremental_rollup", """SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
HAVING CAST(date_trunc('week', max(ts)) AS DATE) + INTERVAL 7 DAY + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)""")
def t1_incremental(spark, d):
    """The rollup as a table that batches overwrite by week; weeks that are not over yet are not shown."""
    folder = runs.new_folder(spark)
    rollup = WeeklyRollup(spark, folder)
    runs.drain(runs.landed(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), folder, rollup.absorb)
    return rollup.rollup().withColumn("total", F.round("total", 4))


@query("T2_stage_input", "SELECT DISTINCT l_suppkey AS body_id, l_orderkey AS scene_id FROM lineitem")
def t2_stage(spark, d):
    """Lines as redelivered messages, each (body, scene) once by the commit log."""
    folder = runs.new_folder(spark)
    stage = StageInput(spark, folder, ["body_id", "scene_id"])
    lines = runs.landed(spark, d, "lineitem").select(F.col("l_suppkey").alias("body_id"), F.col("l_orderkey").alias("scene_id"))
    runs.drain(lines, folder, stage.absorb)
    return stage.done("body_id long, scene_id long")


@query("T3_closed_episodes", """ev AS (SELECT zone_id, indicator, candidate_id AS number, observed_at AS seen, CAST(votes > 0 AS INTEGER) AS kind FROM candidates),
co AS (SELECT *, count(*) FILTER (kind = 0) OVER (PARTITION BY zone_id, indicator ORDER BY seen, kind, number ROWS UNBOUNDED PRECEDING) AS closed FROM ev),
fr AS (SELECT *, coalesce(date_diff('day', lag(seen) OVER w, seen) > 14 OR lag(closed) OVER w <> closed, true) AS fresh FROM co WHERE kind = 1 WINDOW w AS (PARTITION BY zone_id, indicator ORDER BY seen, number))
---
SELECT number AS candidate_id, CAST(sum(CAST(fresh AS BIGINT)) OVER (PARTITION BY zone_id, indicator ORDER BY seen, number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM fr""", uses=("candidates",))
def t3_closed(spark, d):
    """Every fourth order is an event that closes the open episodes of its zone and indicator."""
    nation = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = lambda: runs.landed(spark, d, "orders").filter("o_totalprice IS NOT NULL").join(nation, "o_custkey").select(F.col("c_nationkey").alias("zone_id"), F.col("o_orderpriority").alias("indicator"), F.col("o_orderkey").alias("candidate_id"), F.col("o_orderdate").alias("observed_at"))
    status = orders().filter("candidate_id % 4 = 0").select("zone_id", "indicator", F.lit(None).cast("long").alias("episode"), F.col("observed_at").alias("at"))
    before = spark.conf.get(E.PROVIDER[0], None)
    spark.conf.set(*E.PROVIDER)
    try:
        out = runs.run_through(E.tracked(orders().filter("candidate_id % 4 > 0"), status))
    finally:
        spark.conf.set(E.PROVIDER[0], before) if before else spark.conf.unset(E.PROVIDER[0])
    return out.filter("what = 'observed'").select("candidate_id", "episode")


@query("T4_device_page", """k AS (SELECT page_id, url, page_id % 97 - 9 AS n FROM pages),
a AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'turbidity' WHEN 1 THEN 'ph' WHEN 2 THEN 'dissolved_oxygen' END AS key, CAST(n || '.5' AS DOUBLE) AS value, 'NTU' AS unit, url AS device_status, 'buoy' AS device, 'html' AS source FROM k WHERE page_id % 5 <> 0 AND page_id % 7 <> 0),
j AS (SELECT page_id, 'tds' AS key, CAST(n AS DOUBLE) AS value, CASE WHEN page_id % 2 = 0 THEN 'ppm' END AS unit, NULL AS device_status, 'd' || page_id AS device, 'json' AS source FROM k WHERE page_id % 5 = 0 AND page_id % 3 <> 0)
---
SELECT * FROM a WHERE key IS NOT NULL UNION ALL SELECT * FROM j""")
def t4(spark, d):
    """Device answers made from each page's id and url: most are pages with a card and a status before the page itself, one in
    five is JSON, and a third of these is no object."""
    k = F.col("page_id")
    label = F.when(k % 4 == 0, "Turbidity").when(k % 4 == 1, "pH").when(k % 4 == 2, "Dissolved  Oxygen").otherwise("")
    n = (k % 97 - 9).cast("string")
    said = F.when(k % 7 == 0, "n/a").otherwise(F.concat(n, F.lit(".5 <i>NTU</i>")))
    page = F.concat(F.lit('<div class="card"><div class="label"><b>'), label, F.lit('</b></div> <div class="value">'), said, F.lit('</div></div><div class="status">Status: '), F.col("url"), F.lit("</div>"), F.coalesce("html", F.lit("")))
    entry = F.concat(F.lit('{"tds": {"value": '), n, F.when(k % 2 == 0, ', "unit": "ppm"').otherwise(""), F.lit('}, "note": "x", "device": "d'), k.cast("string"), F.lit('"}'))
    answer = F.when(k % 5 > 0, page).when(k % 3 > 0, entry).otherwise("[1, 2]")
    r = T.device_readings(table(spark, d, "pages").withColumn("body", answer), device="buoy")
    return r.select("page_id", F.inline("readings"), "device_status", "device", "source")


@query("T5_telemetry_flatten", "SELECT event_id, CAST(coalesce(CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT), 0) AS BIGINT) AS k, 'unknown' AS device FROM events")
def t5(spark, d):
    return T.flatten(table(spark, d, "events")).select("event_id", "k", "device")


@query("T6_reading_bands", """r AS (SELECT event_id, value AS ntu, CASE event_id % 5 WHEN 0 THEN '%' WHEN 1 THEN ' ntu' WHEN 2 THEN '' WHEN 3 THEN 'NTU' END AS unit, value * 20 AS ppm, -50 - value AS rssi FROM events)
---
SELECT event_id, CASE WHEN unit = '%' THEN '' WHEN ntu < 1 THEN 'very clear' WHEN ntu < 5 THEN 'clear' WHEN ntu < 50 THEN 'slightly turbid' WHEN ntu < 200 THEN 'turbid' ELSE 'very turbid' END AS turbidity,
CASE WHEN ppm < 50 THEN 'very low mineral content' WHEN ppm < 300 THEN 'fresh, low mineralisation' WHEN ppm < 600 THEN 'good — typical freshwater' WHEN ppm < 900 THEN 'fair — noticeably mineralised' WHEN ppm < 1200 THEN 'poor — high dissolved solids' ELSE 'very high — brackish' END AS tds,
CASE WHEN rssi >= -60 THEN 'strong' WHEN rssi >= -70 THEN 'good' WHEN rssi >= -80 THEN 'weak' ELSE 'very weak' END AS signal FROM r""")
def t6(spark, d):
    """The events' values as turbidity in four units, as dissolved solids and as signal strength."""
    k, v = F.col("event_id") % 5, F.col("value")
    unit = F.when(k == 0, "%").when(k == 1, " ntu").when(k == 2, "").when(k == 3, "NTU")
    return table(spark, d, "events").select("event_id", T.turbidity_band(v, unit).alias("turbidity"), T.tds_band(v * 20).alias("tds"), T.signal_band(-50 - v).alias("signal"))
