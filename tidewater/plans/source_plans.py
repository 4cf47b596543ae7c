"""Source, planner and sink queries (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import geometry as G
from tidewater.plans.bindings import bound, table
from tidewater.plans.registry import query
from tidewater.plans.registry_plans import POLY, polygons
from tidewater.sources import catalog as S

R = lambda c, n=6: F.round(c, n)
ITEM = """it AS (SELECT event_id, ts, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events)"""


def items(spark, d) -> DataFrame:
    """Catalogue items as JSON, made from the events' properties."""
    e = table(spark, d, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("long"))
    k = F.col("k")
    props = F.to_json(F.struct(
        F.when(k % 3 == 0, F.concat(F.lit("MGRS-43Q"), k.cast("string"))).alias("grid:code"), F.when(k % 3 == 1, k % 60).alias("mgrs:utm_zone"), F.when(k % 3 == 1, "Q").alias("mgrs:latitude_band"), F.when(k % 3 == 1, "CA").alias("mgrs:grid_square"),
        F.when(k % 5 != 0, k.cast("double")).alias("eo:cloud_cover"), F.when(k % 2 == 0, F.concat(F.lit("EPSG:"), (32600 + k % 60).cast("string"))).alias("proj:code"), F.when(k % 7 == 0, True).alias("earthsearch:boa_offset_applied"),
        F.when(k % 7 == 1, "05.12").when(k % 7 == 2, "03.01").when(k % 7 == 3, "odd").when(k % 7 == 4, "").alias("s2:processing_baseline"),
        F.when(k % 7 == 1, "02.00").when(k % 7 == 3, "02.00").when(k % 7 == 4, "03.01").when(k % 14 == 5, "2.99").when(k % 14 == 12, "04.00").alias("processing:baseline"),
        F.when((k % 3 == 2) & (k % 2 == 0), F.concat(F.lit("T44Q"), k.cast("string"))).alias("tileId"),
    ))
    names = [F.when(k % 2 == 0, F.lit(a)).otherwise(F.lit(b)) for a, b in S.BAND_ASSETS.values()]
    links = [F.when(k % 11 == 4, "").otherwise(F.concat(F.lit("s3://scenes/"), k.cast("string"))) if i == 2 else F.lit("s3://scenes/x") for i in range(6)]
    assets = F.map_from_arrays(F.array(*names), F.array(*[F.struct(x.alias("href")) for x in links]))
    assets = F.to_json(F.when(k % 11 != 5, assets).otherwise(F.map_filter(assets, lambda n, _: F.lower(n) != "scl")))
    return e.select("event_id", F.col("ts").alias("at"), props.alias("properties"), assets.alias("assets"))


@query("S1_load_registry", """f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 <> 0 THEN abs(c_acctbal) / 500 END AS area, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS name, CASE WHEN c_custkey % 10 = 5 THEN 'Lake ' || c_custkey END AS name_en, c_mktsegment AS kind0 FROM customer)
---
SELECT CASE WHEN k % 6 = 0 THEN 'given_' || k ELSE 'wb_' || trim(regexp_replace(lower(CASE WHEN k % 5 = 0 THEN name_en ELSE name END), '[^a-z0-9]+', '_', 'g'), '_') END AS id, CASE WHEN k % 5 = 0 THEN name_en ELSE name END AS name, CASE WHEN k % 2 = 0 THEN 'north' ELSE 'unknown' END AS district, CASE WHEN k % 3 = 0 THEN 'lake' ELSE 'reservoir' END AS kind,
CAST(CASE WHEN k % 8 = 0 THEN 2 WHEN k % 4 = 1 OR area >= 10 THEN 1 WHEN area >= 1 THEN 2 ELSE 3 END AS INTEGER) AS tier, round(area, 4) AS area_km2, 'osm' AS source FROM f WHERE area IS NOT NULL AND (k % 5 <> 0 OR name_en IS NOT NULL)""")
def s1(spark, d):
    k = F.col("c_custkey")
    features = table(spark, d, "customer").select(
        F.when(k % 9 != 0, F.abs("c_acctbal") / 500).alias("area_km2"), F.when(k % 5 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(k % 10 == 5, F.concat(F.lit("Lake "), k.cast("string"))).alias("name_en"),
        F.when(k % 2 == 0, "north").alias("district"), F.when(k % 3 == 0, "lake").otherwise(F.lower("c_mktsegment")).alias("kind"), F.when(k % 8 == 0, "2").alias("tier"), F.when(k % 4 == 1, "Yes").alias("drinking_water"), F.lit("0").alias("urban"),
        F.when(k % 6 == 0, F.concat(F.lit("given_"), k.cast("string"))).alias("id"), F.lit(None).cast("string").alias("source"),
    )
    return S.load_registry(features, default_district="unknown", source="osm")


@query("S2_scene_catalog", ITEM + """
---
SELECT event_id, CASE WHEN k % 3 = 0 THEN '43Q' || k WHEN k % 3 = 1 THEN printf('%02d', k % 60) || 'QCA' ELSE '44Q' || k END AS tile, CASE WHEN k % 5 <> 0 THEN CAST(k AS DOUBLE) ELSE 100.0 END AS cloud_pct, CASE WHEN k % 2 = 0 THEN 32600 + k % 60 END AS epsg, 's3://scenes/' || k AS b05 FROM it WHERE (k % 3 <> 2 OR k % 2 = 0) AND k % 11 NOT IN (4, 5)""")
def s2(spark, d):
    return S.scene_catalog(items(spark, d)).select("event_id", "tile", "cloud_pct", "epsg", F.col("links")["B05"].alias("b05"))


@query("S3_boa_offset", ITEM + "\n---\nSELECT event_id, CAST(CASE WHEN k % 7 = 0 THEN 0 WHEN k % 7 = 1 THEN -1000 WHEN k % 7 IN (2, 4) OR k % 14 = 5 THEN 0 ELSE -1000 END AS BIGINT) AS boa_offset FROM it")
def s3(spark, d):
    return items(spark, d).select("event_id", S.boa_offset(F.from_json("properties", S.ITEM_PROPERTIES)).cast("long").alias("boa_offset"))


@query("S4_millis_to_scene", "SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS sensed_at, lower(replace(event_type, 'i', '-')) AS platform, CAST(CASE WHEN event_id % 2 = 0 THEN 32643 ELSE 32743 END AS BIGINT) AS epsg FROM events")
def s4(spark, d):
    e = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.translate("event_type", "i", "_").alias("platform"), F.when(F.col("event_id") % 2 == 0, "43QCA").otherwise("43HCA").alias("tile"))
    r = S.from_feature(e)
    return r.select("event_id", F.col("sensed_at").cast("timestamp_ntz").alias("sensed_at"), "platform", F.col("epsg").cast("long").alias("epsg"))


@query("S5_search_scenes", "SELECT body_id, scene_id FROM (SELECT * FROM scenes WHERE CAST(sensed_at AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' QUALIFY row_number() OVER (PARTITION BY body_id ORDER BY sensed_at, scene_id) <= 40) WHERE scene_id % 3 = body_id % 3", uses=("scenes",))
def s5(spark, d):
    r = S.search(bound(spark, d, "scenes"), first="1997-01-01", last="1997-12-31", limit=40)
    return r.filter("scene_id % 3 = body_id % 3").select("body_id", "scene_id")


@query("S6_source_fallback", "att AS (SELECT o_custkey AS request, o_orderkey % 3 AS rnk, o_orderstatus <> 'P' AS ok FROM orders)\n---\nSELECT request, min(rnk) FILTER (ok) AS source_rank, count(*) FILTER (NOT ok) AS failures FROM att GROUP BY 1")
def s6(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("request"), (F.col("o_orderkey") % 3).alias("rank"), (F.col("o_orderstatus") != "P").alias("ok"))
    return S.first_healthy(o)


@query("S7_scene_upsert", "SELECT o_custkey AS scene_id, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS source, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS cloud_pct, arg_max(o_totalprice, (o_orderdate, o_orderkey)) <= 200000 AS usable FROM orders GROUP BY 1")
def s7(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("scene_id"), F.col("o_orderpriority").alias("source"), F.col("o_totalprice").alias("cloud_pct"), F.struct("o_orderdate", "o_orderkey").alias("seen"))
    return S.upsert_scenes(o, most_cloud=200000)


WINDOWS = """wi AS (SELECT s_suppkey AS scene_id, greatest(floor((s_acctbal - 100 + 900) / 20) * 20 - 900, -900) AS x0, least(ceil((s_acctbal + 350.5e0 + 900) / 20) * 20 - 900, 9990) AS x1,
greatest(5000 - ceil((5000 - s_suppkey % 60 * 70 + 100) / 20) * 20, 0) AS y0, least(5000 - floor((5000 - s_suppkey % 60 * 70 - 600) / 20) * 20, 5000) AS y1 FROM supplier)"""


def windows(spark, d) -> DataFrame:
    y = F.col("s_suppkey") % 60 * 70
    box = S.window((F.col("s_acctbal"), y), (F.col("s_acctbal") + 250.5, y + 500), raster=(-900.0, 0.0, 9990.0, 5000.0))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("scene_id"), box.alias("b")).select("scene_id", *[F.col(f"b.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("S8_snapped_window", WINDOWS + "\n---\nSELECT scene_id, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, CAST(y0 AS DOUBLE) AS y0, CAST(y1 AS DOUBLE) AS y1 FROM wi")
def s8(spark, d):
    return windows(spark, d)


@query("S8_windowed_read", WINDOWS + ", pp AS (SELECT *, b04 * 6 AS x, b03 * 3 AS y FROM pixels)\n---\nSELECT scene_id, px, b08 FROM pp JOIN wi USING (scene_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1", uses=("pixels",))
def s8_read(spark, d):
    pixels = bound(spark, d, "pixels").select("scene_id", "px", (F.col("b04") * 6).alias("x"), (F.col("b03") * 3).alias("y"), "b08")
    return S.read_windows(pixels, windows(spark, d), ["scene_id"]).select("scene_id", "px", "b08")


@query("S9_resample_nearest", "SELECT vec_id AS scene_id, i // 8 * 2 + dr AS row, i % 8 * 2 + dc AS col, round(CAST(v AS DOUBLE), 6) AS v FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dr, dc)")
def s9(spark, d):
    from tidewater.plans.detection import grid

    return S.finer(grid(spark, d), "scene_id").withColumn("v", R(F.col("v").cast("double")))


@query("S9_resample_bilinear", """g AS (SELECT vec_id AS scene_id, i // 8 AS r, i % 8 AS c, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings)),
tap AS (SELECT f, (f + 1) // 2 - 1 + n AS k, CASE WHEN f % 2 = n THEN 0.25e0 ELSE 0.75e0 END AS w FROM (SELECT unnest(range(0, 16)) AS f), (VALUES (0), (1)) t(n))
---
SELECT scene_id, a.f AS row, b.f AS col, round(sum(g.v * a.w * b.w) / sum(a.w * b.w), 6) AS v FROM g JOIN tap a ON a.k = g.r JOIN tap b ON b.k = g.c GROUP BY 1, 2, 3""")
def s9_between(spark, d):
    from tidewater.plans.detection import grid

    cells = grid(spark, d).withColumn("v", F.col("v").cast("double"))
    return S.smoother(cells, "scene_id").select("scene_id", "row", "col", R("v").alias("v"))


@query("S10_block_plan", "pl AS (SELECT p_partkey, 100 + p_size * 40 AS w, 300 + p_partkey % 700 AS h, CAST(floor(sqrt(0.75e0 * 2000000 / ((3 + p_partkey % 4) * 2))) AS BIGINT) AS e FROM part)\n---\nSELECT p_partkey, x, y, least(e, w - x) AS bw, least(e, h - y) AS bh FROM pl, LATERAL (SELECT unnest(range(0, w, e)) AS x), LATERAL (SELECT unnest(range(0, h, e)) AS y)")
def s10(spark, d):
    p = table(spark, d, "part").select("p_partkey", (100 + F.col("p_size") * 40).cast("long").alias("w"), (300 + F.col("p_partkey") % 700).alias("h"))
    edge = S.block_edge(3 + F.col("p_partkey") % 4, F.lit(2), most_bytes=2_000_000)
    return S.blocks(p, edge).select("p_partkey", "x", "y", "bw", "bh")


@query("S11_backfill_chunks", """rq AS (SELECT body_id, CASE WHEN body_id % 3 > 0 THEN CAST(min(sensed_at) AS DATE) END AS a, CASE WHEN body_id % 4 > 0 THEN CAST(max(sensed_at) AS DATE) - CAST(body_id * 90 AS INTEGER) END AS b FROM scenes GROUP BY 1),
s1 AS (SELECT body_id, a, least(coalesce(b, DATE '2000-06-30'), DATE '2000-06-30') AS b FROM rq), sp AS (SELECT body_id, greatest(coalesce(a, b - 1095), DATE '1997-01-01') AS a, b FROM s1)
---
SELECT body_id, CAST(g AS DATE) AS chunk_from, least(CAST(g AS DATE) + 30, b) AS chunk_to FROM sp, LATERAL (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 31 DAY)) AS g) WHERE a <= b""", uses=("scenes",))
def s11(spark, d):
    """Requests of which some have no first day, some no last one, and some nothing after the archive's first day."""
    k = F.col("body_id")
    last = F.date_sub(F.to_date(F.max("sensed_at")), (k * 90).cast("int"))
    requests = bound(spark, d, "scenes").groupBy("body_id").agg(F.when(k % 3 > 0, F.to_date(F.min("sensed_at"))).alias("a"), F.when(k % 4 > 0, last).alias("b"))
    return S.backfill(requests, today="2000-06-30", floor="1997-01-01")


@query("S12_stage_input", "SELECT scene_id FROM scenes WHERE state = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = scene_id AND l_returnflag = 'R')", uses=("scenes",))
def s12(spark, d):
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scene_id"))
    return S.outstanding(bound(spark, d, "scenes").filter("state = 'F'"), done).select("scene_id")


@query("S13_pending_pairs", "SELECT DISTINCT s.body_id, CAST(s.sensed_at AS DATE) AS day FROM scenes s JOIN bodies b USING (body_id) WHERE cloud_pct <= 60 AND CAST(sensed_at AS DATE) >= DATE '2001-07-31' - CASE tier WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 10 END AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = s.scene_id AND l_returnflag = 'R')", uses=("scenes", "bodies"))
def s13(spark, d):
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scene_id"))
    return S.pending(bound(spark, d, "scenes"), bound(spark, d, "bodies"), done, today="2001-07-31")


@query("S14_quick_look", "SELECT body_id, scene_id FROM scenes WHERE cloud_pct <= 60 AND state <> 'P' QUALIFY row_number() OVER (PARTITION BY body_id ORDER BY sensed_at DESC, scene_id) <= 3", uses=("scenes",))
def s14(spark, d):
    return S.newest(bound(spark, d, "scenes").filter("cloud_pct <= 60 AND state <> 'P'"), 3).select("body_id", "scene_id")


@query("S15_observation_upsert", "SELECT zone_id, indicator, observed_at, scene_id, line FROM obs QUALIFY row_number() OVER (PARTITION BY zone_id, indicator, observed_at ORDER BY scene_id DESC, line DESC) = 1", uses=("obs",))
def s15(spark, d):
    from tidewater.operators.baseline import first_rows

    r = first_rows(bound(spark, d, "obs"), ["observed_at", "zone_id", "indicator"], [F.col("scene_id").desc(), F.col("line").desc()])
    return r.select("zone_id", "indicator", "observed_at", "scene_id", "line")


@query("S16_rain_payload", "SELECT body_id, date, round(mm_24h, 6) AS mm FROM rain WHERE NOT (dayofyear(date) % 9 = 0)", uses=("rain",))
def s16(spark, d):
    rain = bound(spark, d, "rain").withColumn("mm", F.when(F.dayofyear("date") % 9 != 0, F.col("mm_24h")))
    daily = F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("t"), "mm")))
    payload = rain.groupBy("body_id", F.year("date").alias("y")).agg(daily.alias("a"))
    text = F.to_json(F.struct(F.struct(F.transform("a", lambda x: x["t"]).alias("time"), F.transform("a", lambda x: x["mm"]).alias("precipitation_sum")).alias("daily")))
    return S.rain_payload(payload.select("body_id", text.alias("payload"))).withColumn("mm", R("mm"))


ZONE_DAY = """zd AS (SELECT scene_id, zone_id, avg(mean) FILTER (indicator = 'A') AS a, avg(mean) FILTER (indicator = 'N') AS n, max(valid_pixel_pct) AS valid, string_agg(DISTINCT indicator, ';' ORDER BY indicator) FILTER (mean > 500) AS bad FROM obs GROUP BY 1, 2)"""
#: The report's columns that the query's inputs have no values for.
UNKNOWN = ("platform", "water_extent_km2", "rainfall_72h_mm", "fai_algal", "sediment_proxy", "mndwi_extent", "z_ndti_turbidity", "z_ndci_chlorophyll", "z_fai_algal", "z_sediment_proxy", "zone_water_fraction_pct", "max_abs_z", "baseline_status", "severity", "priority_score", "confidence", "suppressed_reason", "natural_cause_likely", "alert_id")


@query("S17_report_rows", ZONE_DAY + f"""
---
SELECT s.body_id, CAST(CAST(sensed_at AS DATE) AS VARCHAR) AS date, CAST(s.scene_id AS VARCHAR) AS scene_id, s.state AS source, CAST(cloud_pct AS VARCHAR) AS scene_cloud_pct, CASE WHEN cloud_pct <= 60 THEN 'true' ELSE 'false' END AS mask_usable, CAST(100 - cloud_pct AS VARCHAR) AS valid_pixel_pct,
coalesce(CAST(CAST(round(mm_24h) AS BIGINT) AS VARCHAR), '') AS rainfall_24h_mm, coalesce(CAST(zd.zone_id AS VARCHAR), '') AS zone_id, coalesce(z.name, '') AS zone_name, coalesce(CAST(CAST(round(z.area_km2) AS BIGINT) AS VARCHAR), '') AS zone_area_km2, coalesce(CAST(CAST(round(a) AS BIGINT) AS VARCHAR), '') AS ndti_turbidity,
coalesce(CAST(CAST(round(n) AS BIGINT) AS VARCHAR), '') AS ndci_chlorophyll, coalesce(CAST(CAST(round(valid) AS BIGINT) AS VARCHAR), '') AS zone_valid_pixel_pct, coalesce(bad, '') AS anomalous_indicators, CASE WHEN zd.zone_id IS NULL THEN '' WHEN bad IS NOT NULL THEN 'true' ELSE 'false' END AS alertable, {", ".join(f"'' AS {c}" for c in UNKNOWN)}
FROM scenes s LEFT JOIN rain r ON r.body_id = s.body_id AND r.date = CAST(sensed_at AS DATE) LEFT JOIN zd ON zd.scene_id = s.scene_id LEFT JOIN zones z ON z.zone_id = zd.zone_id""", uses=("scenes", "rain", "zones", "obs"))
def s17(spark, d):
    """The 34 columns for every scene's day and the zones that it read; scenes without readings keep one row."""
    whole = lambda c: F.round(c).cast("long")
    rain = bound(spark, d, "rain").select("body_id", F.col("date"), whole(F.col("mm_24h")).alias("rainfall_24h_mm"))
    days = bound(spark, d, "scenes").withColumn("date", F.to_date("sensed_at")).join(rain, ["body_id", "date"], "left")
    days = days.select("body_id", "scene_id", "date", F.col("state").alias("source"), F.col("cloud_pct").alias("scene_cloud_pct"), (F.col("cloud_pct") <= 60).alias("mask_usable"), (100 - F.col("cloud_pct")).alias("valid_pixel_pct"), "rainfall_24h_mm")
    mean = lambda i: whole(F.avg(F.when(F.col("indicator") == i, F.col("mean"))))
    bad = F.array_sort(F.collect_set(F.when(F.col("mean") > 500, F.col("indicator"))))
    read = bound(spark, d, "obs").groupBy("scene_id", "zone_id").agg(mean("A").alias("ndti_turbidity"), mean("N").alias("ndci_chlorophyll"), whole(F.max("valid_pixel_pct")).alias("zone_valid_pixel_pct"), bad.alias("anomalous_indicators"))
    zones = bound(spark, d, "zones").select("zone_id", F.col("name").alias("zone_name"), whole(F.col("area_km2")).alias("zone_area_km2"))
    read = read.join(zones, "zone_id", "left").withColumn("alertable", F.size("anomalous_indicators") > 0)
    return S.report_rows(days, read, ["scene_id"], keep=("body_id",))


S18_SQL = POLY + """,
rg AS (SELECT id, '[[' || string_agg('[' || CAST(round(x, 1) AS VARCHAR) || ',' || CAST(round(y, 1) AS VARCHAR) || ']', ',' ORDER BY seq) || ',' || arg_min('[' || CAST(round(x, 1) AS VARCHAR) || ',' || CAST(round(y, 1) AS VARCHAR) || ']', seq) || ']]' AS g FROM vx GROUP BY 1),
k AS (SELECT *, CASE WHEN votes > 2 THEN 'plume' WHEN votes = 2 THEN 'localised' ELSE 'zone' END AS kind, CASE WHEN votes > 2 THEN priority WHEN votes = 2 THEN valid_pct END AS area FROM candidates)
---
SELECT candidate_id, '{"type":"Feature","id":"alr_' || candidate_id || '"' || coalesce(',"geometry":{"type":"Polygon","coordinates":' || g || '}', '') || ',"properties":{"zone_id":' || zone_id || ',"primary_indicator":"' || indicator || '","priority_score":' || priority || ',"geom_kind":"' || kind || '","affected_area":' || priority || coalesce(',"area":' || area, '') || '}}' AS feature
FROM k LEFT JOIN rg ON rg.id = k.zone_id"""


@query("S18_geojson", S18_SQL, uses=("candidates",))
def s18(spark, d):
    shapes = G.outlines(polygons(spark, d), "id", digits=1).withColumnRenamed("id", "zone_id")
    votes, kind = F.col("votes"), F.when(F.col("votes") > 2, "plume").when(F.col("votes") == 2, "localised").otherwise("zone")
    area = S.covered_area(kind, F.col("priority"), F.when(votes == 2, F.col("valid_pct")))
    facts = F.struct("zone_id", F.col("indicator").alias("primary_indicator"), F.col("priority").alias("priority_score"), kind.alias("geom_kind"), F.col("priority").alias("affected_area"), area.alias("area"))
    c = bound(spark, d, "candidates").join(shapes, "zone_id", "left")
    return c.select("candidate_id", S.feature(facts, F.col("geometry"), F.concat(F.lit("alr_"), F.col("candidate_id").cast("string"))).alias("feature"))
