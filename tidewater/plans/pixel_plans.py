"""Pixel and indicator queries (M, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import indicators as N
from tidewater.operators import pixels as P
from tidewater.operators import tiles as T
from tidewater.plans.bindings import bound
from tidewater.plans.detection import GRID, above, grid
from tidewater.plans.registry import query

R = lambda c, n=6: F.round(c, n)
CL = "scl IN (3, 8, 9, 10, 11)"
ND = "scl IN (0, 1)"


def pixels(spark, d) -> DataFrame:
    p = bound(spark, d, "pixels")
    return p.withColumn("valid", ~P.cloud(F.col("scl")) & ~P.nodata(F.col("scl"))).withColumn("water", F.col("scl") % 3 != 1)


PX = f"pp AS (SELECT *, NOT ({CL}) AND NOT ({ND}) AS valid, scl % 3 <> 1 AS water FROM pixels)"


@query("M1_cloud_and_nodata", f"SELECT scene_id, px, {CL} AS cloud, {ND} AS nodata FROM pixels", uses=("pixels",))
def m1(spark, d):
    return bound(spark, d, "pixels").select("scene_id", "px", P.cloud(F.col("scl")).alias("cloud"), P.nodata(F.col("scl")).alias("nodata"))


def hot(spark, d, cut=0.15) -> DataFrame:
    return grid(spark, d).filter(above(cut)).select("scene_id", "row", "col")


@query("M2_dilation", GRID + "\n---\nSELECT DISTINCT a.scene_id, a.row, a.col FROM g a JOIN g b ON a.scene_id = b.scene_id AND b.v > 0.15 AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2")
def m2(spark, d):
    return T.dilate(hot(spark, d), grid(spark, d), "scene_id", 2)


@query("M3_valid_mask", GRID + ", dil AS (SELECT DISTINCT a.scene_id, a.row, a.col FROM g a JOIN g b ON a.scene_id = b.scene_id AND b.v > 0.15 AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2)\n---\nSELECT g.scene_id, g.row, g.col, dil.row IS NULL AND g.v > -0.2 AS valid FROM g LEFT JOIN dil USING (scene_id, row, col)")
def m3(spark, d):
    g = grid(spark, d)
    near = T.dilate(hot(spark, d), g, "scene_id", 2).withColumn("near", F.lit(True))
    return g.join(near, ["scene_id", "row", "col"], "left").select("scene_id", "row", "col", (F.col("near").isNull() & above(-0.2)).alias("valid"))


VERDICT = f"{PX}, ve AS (SELECT scene_id, count(*) AS aoi_pixels, round(100 * count(*) FILTER (valid) / count(*), 2) AS valid_pct, round(100 * count(*) FILTER ({CL}) / count(*), 2) AS cloud_pct, 100 * count(*) FILTER (valid) / count(*) >= 40 AS usable FROM pp GROUP BY 1)"


@query("M4_scene_verdict", VERDICT + "\n---\nSELECT * FROM ve", uses=("pixels",))
def m4(spark, d):
    return P.scene_verdict(pixels(spark, d), ["scene_id"])


@query("M5_normalised_difference", "SELECT scene_id, px, round((b03 - b11) / nullif(b03 + b11, 0), 6) + 0.0 AS mndwi, round((b03 - b08) / nullif(b03 + b08, 0), 6) + 0.0 AS ndwi FROM pixels", uses=("pixels",))
def m5(spark, d):
    return bound(spark, d, "pixels").select("scene_id", "px", R(P.normalised_difference(F.col("b03"), F.col("b11"))).alias("mndwi"), R(P.normalised_difference(F.col("b03"), F.col("b08"))).alias("ndwi"))


OTSU = """va AS (SELECT scene_id, b04 AS v FROM pixels), sp AS (SELECT scene_id, min(v) AS lo, max(v) AS hi, count(*) AS cnt, stddev_pop(v) AS sd FROM va GROUP BY 1),
bn AS (SELECT scene_id, CAST(least(floor((v - lo) / (hi - lo) * 256), 255) AS BIGINT) AS bin, count(*) AS n FROM va JOIN sp USING (scene_id) WHERE hi > lo GROUP BY 1, 2),
fl AS (SELECT scene_id, lo, hi, b.bin, coalesce(n, 0) AS n, lo + (b.bin + 0.5) * (hi - lo) / 256 AS c FROM sp CROSS JOIN (SELECT unnest(range(0, 256)) AS bin) b LEFT JOIN bn USING (scene_id, bin) WHERE hi > lo),
cu AS (SELECT *, sum(n) OVER w AS w0, sum(n) OVER (PARTITION BY scene_id) AS w, sum(n * c) OVER w AS m0, sum(n * c) OVER (PARTITION BY scene_id) AS m FROM fl WINDOW w AS (PARTITION BY scene_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
vr AS (SELECT *, coalesce(w0 * (w - w0) * (m0 / nullif(w0, 0) - (m - m0) / nullif(w - w0, 0)) ** 2, 0) AS v FROM cu),
bs AS (SELECT *, max(v) OVER (PARTITION BY scene_id) AS best FROM vr),
ot AS (SELECT scene_id, lo, hi, round_even((min(bin) + max(bin)) / 2, 0) AS split FROM bs WHERE v >= best * (1 - 1e-9) GROUP BY 1, 2, 3),
th AS (SELECT sp.scene_id, sp.cnt, sp.sd, ot.lo + (split + 1) * (ot.hi - ot.lo) / 256 AS threshold FROM sp LEFT JOIN ot USING (scene_id))"""


@query("M6_otsu_threshold", OTSU + "\n---\nSELECT scene_id, round(threshold, 6) AS threshold FROM th", uses=("pixels",))
def m6(spark, d):
    return P.otsu(bound(spark, d, "pixels"), ["scene_id"], "b04").withColumn("threshold", R("threshold"))


@query("M7_otsu_guard", OTSU + "\n---\nSELECT scene_id, CASE WHEN cnt < 50 OR sd < 0.05 OR threshold NOT BETWEEN 400 AND 900 THEN 0.0 ELSE round(threshold, 4) END AS threshold, CASE WHEN cnt < 50 OR sd < 0.05 OR threshold NOT BETWEEN 400 AND 900 THEN 'fallback' ELSE 'otsu' END AS method FROM th", uses=("pixels",))
def m7(spark, d):
    p = bound(spark, d, "pixels")
    spread = p.groupBy("scene_id").agg(F.count("b04").alias("cnt"), F.stddev_pop("b04").alias("sd"))
    t = P.otsu(p, ["scene_id"], "b04").join(spread, "scene_id")
    trusted = (F.col("cnt") >= 50) & (F.col("sd") >= 0.05) & F.col("threshold").between(400, 900)
    return t.select("scene_id", F.when(trusted, R("threshold", 4)).otherwise(0.0).alias("threshold"), F.when(trusted, "otsu").otherwise("fallback").alias("method"))


def morph(name: str, source: str, erode: bool) -> str:
    n = f"SELECT a.scene_id, a.row, a.col, count(*) AS k FROM {'g' if not erode else source} a JOIN {source} b ON a.scene_id = b.scene_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3"
    return f"{name} AS (SELECT scene_id, row, col FROM ({n}) WHERE k >= {9 if erode else 1})"


@query("M8_opening_and_closing", f"{GRID}, h0 AS (SELECT scene_id, row, col FROM g WHERE v > -0.12), {morph('e1', 'h0', True)}, {morph('d1', 'e1', False)}, {morph('d2', 'd1', False)}, {morph('e2', 'd2', True)}\n---\nSELECT * FROM e2")
def m8(spark, d):
    return T.cleaned(hot(spark, d, -0.12), grid(spark, d), "scene_id")


COMPONENTS = GRID + """,
h AS (SELECT scene_id, row, col, row * 8 + col AS id FROM g WHERE v > 0.1),
e AS (SELECT a.scene_id, a.id AS a, b.id AS b FROM h a JOIN h b ON a.scene_id = b.scene_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
reach AS (SELECT scene_id, id AS a, id AS b FROM h UNION SELECT r.scene_id, r.a, e.b FROM reach r JOIN e ON e.scene_id = r.scene_id AND e.a = r.b),
co AS (SELECT scene_id, CAST(a // 8 AS BIGINT) AS row, CAST(a % 8 AS BIGINT) AS col, CAST(min(b) AS BIGINT) AS component FROM reach GROUP BY 1, 2, 3)"""


@query("M9_components", COMPONENTS + "\n---\nSELECT * FROM co QUALIFY count(*) OVER (PARTITION BY scene_id, component) >= 3")
def m9(spark, d):
    c = P.connected(hot(spark, d, 0.1), "scene_id").withColumn("component", F.col("component.row") * 8 + F.col("component.col"))
    return c.withColumn("_n", F.count("*").over(Window.partitionBy("scene_id", "component"))).filter("_n >= 3").drop("_n")


def otsu_of(values: str) -> str:
    """The threshold's SQL over other values than the pixels'."""
    return OTSU.replace("va AS (SELECT scene_id, b04 AS v FROM pixels)", values)


@query("M10_water_mask", GRID + """,
mp AS (SELECT *, row BETWEEN 1 AND 7 AS search, (scene_id + row * 3 + col * 5) % 11 > 0 AS valid FROM g),
""" + otsu_of("va AS (SELECT scene_id, v FROM mp WHERE search AND valid AND v IS NOT NULL)") + f""",
ct AS (SELECT scene_id, CASE WHEN cnt >= 40 AND sd >= 0.05 AND threshold BETWEEN -0.1 AND 0.1 THEN threshold ELSE 0.0 END AS cut FROM th),
h0 AS (SELECT scene_id, row, col FROM mp JOIN ct USING (scene_id) WHERE valid AND v > cut), {morph('e1', 'h0', True)}, {morph('d1', 'e1', False)}, {morph('d2', 'd1', False)}, {morph('e2', 'd2', True)},
id2 AS (SELECT scene_id, row, col, row * 8 + col AS id FROM e2), lk AS (SELECT a.scene_id, a.id AS a, b.id AS b FROM id2 a JOIN id2 b ON a.scene_id = b.scene_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
rc AS (SELECT scene_id, id AS a, id AS b FROM id2 UNION SELECT r.scene_id, r.a, lk.b FROM rc r JOIN lk ON lk.scene_id = r.scene_id AND lk.a = r.b), lb AS (SELECT scene_id, a, min(b) AS component FROM rc GROUP BY 1, 2),
kp AS (SELECT scene_id, CAST(a // 8 AS BIGINT) AS row, CAST(a % 8 AS BIGINT) AS col FROM lb QUALIFY count(*) OVER (PARTITION BY scene_id, component) >= 9)
---
SELECT mp.scene_id, mp.row, mp.col, kp.row IS NOT NULL AND search AND valid AS water FROM mp LEFT JOIN kp USING (scene_id, row, col)""")
def m10(spark, d):
    """Tiles with their first row outside the search area and one pixel in eleven cloudy."""
    k = (F.col("scene_id") + F.col("row") * 3 + F.col("col") * 5) % 11
    p = grid(spark, d).withColumn("search", F.col("row").between(1, 7)).withColumn("valid", k > 0)
    return P.water_mask(p, "scene_id", value="v", min_pixels=9, fallback=0.0, bounds=(-0.1, 0.1), least=40)


@query("M11_water_extent", COMPONENTS + "\n---\nSELECT scene_id, round(count(*) * 1e-4, 4) AS extent_km2, round(100 * count(*) / 64, 2) AS water_pct, count(DISTINCT component) AS n_components FROM co GROUP BY 1")
def m11(spark, d):
    c = P.connected(hot(spark, d, 0.1), "scene_id").groupBy("scene_id")
    return c.agg(F.round(F.count("*") * 1e-4, 4).alias("extent_km2"), F.round(100 * F.count("*") / 64, 2).alias("water_pct"), F.countDistinct("component").alias("n_components"))


@query("M12_mask_encoding", f"{PX}\n---\nSELECT scene_id, px, CAST(CASE WHEN NOT valid THEN 255 WHEN water THEN 1 ELSE 0 END AS BIGINT) AS code FROM pp", uses=("pixels",))
def m12(spark, d):
    return pixels(spark, d).select("scene_id", "px", F.when(~F.col("valid"), 255).when(F.col("water"), 1).otherwise(0).cast("long").alias("code"))


@query("M13_rejected_scenes", VERDICT + ", wx AS (SELECT scene_id, count(*) FILTER (valid AND water) AS n_water FROM pp GROUP BY 1)\n---\nSELECT scene_id, valid_pct, cloud_pct, CASE WHEN valid_pct >= 50 THEN n_water END AS n_water FROM ve JOIN wx USING (scene_id)", uses=("pixels",))
def m13(spark, d):
    water = pixels(spark, d).groupBy("scene_id").agg(F.count_if(F.col("valid") & F.col("water")).alias("w"))
    return m4(spark, d).join(water, "scene_id").select("scene_id", "valid_pct", "cloud_pct", F.when(F.col("valid_pct") >= 50, F.col("w")).alias("n_water"))


REFL = PX + ", rf AS (SELECT scene_id, px, zone_id, scl, valid, water, " + ", ".join(f"least(greatest(({b} + CASE WHEN scene_id % 2 = 0 THEN -100 ELSE 0 END) / 10000, 0.0), 1.0) AS {b}" for b in ("b03", "b04", "b05", "b08", "b11")) + " FROM pp)"


def reflected(spark, d) -> DataFrame:
    return N.reflectance(pixels(spark, d), offset=F.when(F.col("scene_id") % 2 == 0, -100).otherwise(0))


@query("N1_reflectance", REFL + "\n---\nSELECT scene_id, px, scl, round(b03, 8) AS b03, round(b04, 8) AS b04, round(b11, 8) AS b11 FROM rf", uses=("pixels",))
def n1(spark, d):
    return reflected(spark, d).select("scene_id", "px", "scl", R("b03", 8).alias("b03"), R("b04", 8).alias("b04"), R("b11", 8).alias("b11"))


def one(key):
    return lambda spark, d: reflected(spark, d).select("scene_id", "px", R(N.INDICATORS[key].compute(), 9).alias("value"))


FORMULA = {"ndti": "(b04 - b03) / nullif(b04 + b03, 0)", "ndci": "(b05 - b04) / nullif(b05 + b04, 0)", "fai": "b08 - (b04 + (b11 - b04) * (177 / 945))", "sediment": "b04", "mndwi": "(b03 - b11) / nullif(b03 + b11, 0)"}
for name, key in (("N2_ndti", "ndti"), ("N3_ndci", "ndci"), ("N4_fai", "fai"), ("N5_sediment", "sediment"), ("N6_mndwi", "mndwi")):
    query(name, f"{REFL}\n---\nSELECT scene_id, px, round({FORMULA[key]}, 9) + 0.0 AS value FROM rf", uses=("pixels",))(one(key))

LONG = REFL + ", lg AS (" + " UNION ALL ".join(f"SELECT scene_id, px, zone_id, '{i.key}' AS indicator, least(greatest({FORMULA[i.key]}, {i.low}), {i.high}) AS value, ({FORMULA[i.key]}) < {i.low} OR ({FORMULA[i.key]}) > {i.high} AS clipped FROM rf WHERE valid{' AND water' if i.water_only else ''} AND ({FORMULA[i.key]}) IS NOT NULL" for i in N.INDICATORS.values()) + ")"


def longs(spark, d) -> DataFrame:
    return N.long_indicators(reflected(spark, d), ["scene_id", "px", "zone_id"])


@query("N7_domain_and_clip", LONG + "\n---\nSELECT scene_id, indicator, count(*) AS n, count(*) FILTER (clipped) AS n_clipped FROM lg GROUP BY 1, 2", uses=("pixels",))
def n7(spark, d):
    return longs(spark, d).groupBy("scene_id", "indicator").agg(F.count("*").alias("n"), F.count_if("clipped").alias("n_clipped"))


@query("N8_unpivot", LONG + "\n---\nSELECT scene_id, px, indicator, round(value, 8) + 0.0 AS value FROM lg", uses=("pixels",))
def n8(spark, d):
    return longs(spark, d).select("scene_id", "px", "indicator", R("value", 8).alias("value"))


FOOT = REFL + ", fp AS (SELECT scene_id, zone_id, count(*) AS n_pixels, count(*) FILTER (valid) AS n_valid, count(*) FILTER (valid AND water) AS n_water, 100 * count(*) FILTER (valid) / count(*) AS valid_pct, 100 * count(*) FILTER (valid AND water) / nullif(count(*) FILTER (valid), 0) AS water_pct FROM rf GROUP BY 1, 2)"


@query("N9_zone_footprint", FOOT + "\n---\nSELECT scene_id, zone_id, n_pixels, n_valid, n_water, round(valid_pct, 6) AS valid_pct, round(water_pct, 6) AS water_pct FROM fp", uses=("pixels",))
def n9(spark, d):
    return N.footprint(reflected(spark, d), ["scene_id", "zone_id"]).withColumn("valid_pct", R("valid_pct")).withColumn("water_pct", R("water_pct"))


ZONAL = LONG + ", zn AS (SELECT scene_id, zone_id, indicator, avg(value) AS mean, quantile_cont(value, 0.9) AS p90, stddev_pop(value) AS std, count(*) AS n, 100 * avg(CAST(clipped AS DOUBLE)) AS clipped_pct FROM lg GROUP BY 1, 2, 3)"


@query("N10_zonal_statistics", ZONAL + "\n---\nSELECT scene_id, zone_id, indicator, round(mean, 10) AS mean, round(p90, 10) AS p90, round(std, 10) AS std, n, round(clipped_pct, 7) AS clipped_pct FROM zn", uses=("pixels",))
def n10(spark, d):
    z = N.zonal(longs(spark, d), ["scene_id", "zone_id", "indicator"])
    return z.select("scene_id", "zone_id", "indicator", *[R(c, 10).alias(c) for c in ("mean", "p90", "std")], "n", R("clipped_pct", 7).alias("clipped_pct"))


@query("N11_rejections", ZONAL + FOOT[len(REFL):] + """
---
SELECT f.scene_id, f.zone_id, i.indicator, CASE WHEN round(valid_pct, 2) < 30 THEN 'too little valid' WHEN coalesce(n, 0) < 25 THEN 'too few pixels' END AS reason
FROM fp f CROSS JOIN (SELECT unnest(['ndti', 'fai', 'mndwi']) AS indicator) i LEFT JOIN zn ON zn.scene_id = f.scene_id AND zn.zone_id = f.zone_id AND zn.indicator = i.indicator""", uses=("pixels",))
def n11(spark, d):
    z = N.zonal(longs(spark, d), ["scene_id", "zone_id", "indicator"]).select("scene_id", "zone_id", "indicator", "n")
    f = N.footprint(reflected(spark, d), ["scene_id", "zone_id"]).withColumn("indicator", F.explode(F.array(*[F.lit(x) for x in ("ndti", "fai", "mndwi")])))
    return f.join(z, ["scene_id", "zone_id", "indicator"], "left").select("scene_id", "zone_id", "indicator", N.rejection(F.col("n_pixels"), F.col("valid_pct"), F.col("n")).alias("reason"))


@query("N12_indicator_usage", LONG + "\n---\nSELECT indicator, indicator <> 'mndwi' AS water_only, count(*) AS n FROM lg GROUP BY 1", uses=("pixels",))
def n12(spark, d):
    meta = F.create_map(*[F.lit(x) for i in N.INDICATORS.values() for x in (i.key, i.water_only)])
    return longs(spark, d).groupBy("indicator").agg(F.count("*").alias("n")).select("indicator", meta[F.col("indicator")].alias("water_only"), "n")


@query("N13_display_stretch", LONG + """,
q AS (SELECT scene_id, indicator, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM lg GROUP BY 1, 2),
sh AS (SELECT *, greatest(lo - (hi - lo) * 0.05, -0.5) AS l2, least(hi + (hi - lo) * 0.05, 0.5) AS h2 FROM q)
---
SELECT scene_id, indicator, round(CASE WHEN hi > lo AND hi - lo >= 0.4 AND h2 > l2 THEN l2 END, 6) AS low, round(CASE WHEN hi > lo AND hi - lo >= 0.4 AND h2 > l2 THEN h2 END, 6) AS high FROM sh""", uses=("pixels",))
def n13(spark, d):
    return N.stretch(longs(spark, d), ["scene_id", "indicator"], floor=0.2, ramp=(-0.5, 0.5)).select("scene_id", "indicator", R("low").alias("low"), R("high").alias("high"))


@query("N14_channel_stretch", "q AS (SELECT scene_id, quantile_cont(b04, 0.02) AS lo, quantile_cont(b04, 0.98) AS hi FROM pixels GROUP BY 1)\n---\nSELECT scene_id, px, round(CASE WHEN hi > lo THEN least(greatest((b04 - lo) / (hi - lo), 0), 1) ELSE 0 END, 6) AS shown FROM pixels JOIN q USING (scene_id)", uses=("pixels",))
def n14(spark, d):
    p = bound(spark, d, "pixels")
    q = p.groupBy("scene_id").agg(F.percentile("b04", F.array(F.lit(0.02), F.lit(0.98))).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    shown = F.when(hi > lo, F.least(F.greatest((F.col("b04") - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return p.join(q, "scene_id").select("scene_id", "px", R(shown).alias("shown"))
