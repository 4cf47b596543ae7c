"""Anomaly detector queries (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import baseline as B
from tidewater.operators import detect as D
from tidewater.operators import tiles
from tidewater.plans.bindings import bound, table
from tidewater.plans.registry import query
from tidewater.plans.seasonal import ALL, BASE, LOOKUP, seen
from tidewater.sources.stored import stored

R = lambda c, n=6: F.round(c, n)
SCORED = f"""{BASE},
{LOOKUP},
scored AS (SELECT *, CASE WHEN mean IS NOT NULL AND status = 'usable' THEN (mean - median) / greatest(sigma, 0.01) END AS z FROM seen)"""


def flagged_readings(spark, d) -> DataFrame:
    scored = D.temporal_scores(seen(spark, d)).filter("flagged")
    return scored.select("zone_id", "indicator", "observed_at", "scene_id", "line", R("mean").alias("mean"), R("median").alias("median"), R("p10").alias("p10"), R("p90").alias("p90"), R("z").alias("z"), "direction")


@query("D1_temporal_score", SCORED + """
---
SELECT scene_id, line, zone_id, indicator, round(z, 6) AS z, coalesce(abs(z) > 3, false) AS flagged, CASE WHEN abs(z) > 3 THEN CASE WHEN z > 0 THEN 'high' ELSE 'low' END END AS direction,
CASE WHEN mean IS NULL THEN 'no value' WHEN status <> 'usable' THEN 'baseline ' || status END AS reason FROM scored""", uses=ALL)
def d1(spark, d):
    return D.temporal_scores(seen(spark, d)).select("scene_id", "line", "zone_id", "indicator", R("z").alias("z"), "flagged", "direction", "reason")


ROLLUP = """roll AS (SELECT zone_id, observed_at, coalesce(string_agg(DISTINCT indicator, ',' ORDER BY indicator) FILTER (abs(z) > 3), '') AS anomalous, max(abs(z)) AS max_abs_z, bool_or(status = 'usable') AS any_usable FROM scored GROUP BY 1, 2)"""


def rollup(spark, d) -> DataFrame:
    return D.temporal_rollup(D.temporal_scores(seen(spark, d, also=())), ["zone_id", "observed_at"], ("A", "N", "R"))


@query("D2_temporal_rollup", f"{SCORED},\n{ROLLUP}\n---\nSELECT zone_id, observed_at, anomalous, round(max_abs_z, 6) AS max_abs_z, any_usable FROM roll", uses=ALL)
def d2(spark, d):
    return rollup(spark, d).select("zone_id", "observed_at", "anomalous", R("max_abs_z").alias("max_abs_z"), "any_usable")


PIXEL_Z = """m AS (SELECT scene_id, quantile_cont(b04, 0.5) AS med, 1.4826 * mad(b04) AS sig, count(*) AS n FROM pixels GROUP BY 1),
pz AS (SELECT p.scene_id, p.px, CASE WHEN n >= 2 THEN (b04 - med) / greatest(sig, 0.01) END AS z FROM pixels p JOIN m USING (scene_id))"""


@query("D3_pixel_z", PIXEL_Z + "\n---\nSELECT scene_id, px, round(z, 6) AS z FROM pz", uses=("pixels",))
def d3(spark, d):
    return D.scene_z(bound(spark, d, "pixels"), "b04", ["scene_id"]).select("scene_id", "px", R("z").alias("z"))


@query("D4_hot_pixel_gate", PIXEL_Z + """,
c AS (SELECT scene_id, count(z) AS n_pixels, count(*) FILTER (z > 1.5) AS n_hot FROM pz GROUP BY 1)
---
SELECT *, CASE WHEN n_pixels = 0 THEN 'no water' WHEN n_hot < 10 THEN NULL WHEN n_hot / n_pixels > 0.05 THEN 'shift of the whole body' WHEN n_hot > 200000 THEN 'too many hot pixels' END AS reason,
n_pixels > 0 AND n_hot >= 10 AND n_hot / n_pixels <= 0.05 AND n_hot <= 200000 AS clustered FROM c""", uses=("pixels",))
def d4(spark, d):
    return D.hot_gate(D.scene_z(bound(spark, d, "pixels"), "b04", ["scene_id"]), ["scene_id"], threshold=1.5, most_share=0.05)


GRID = "g0 AS (SELECT vec_id AS scene_id, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings), g AS (SELECT scene_id, CAST(i // 8 AS BIGINT) AS row, CAST(i % 8 AS BIGINT) AS col, v FROM g0)"


def above(cut: float):
    """The grid's values above the cut, compared as what they are, single numbers: as a double 0.15 lies below the single one."""
    return F.col("v") > F.lit(cut).cast("float")


def grid(spark, d) -> DataFrame:
    """Each embedding as an 8 by 8 tile of values."""
    cells = table(spark, d, "embeddings").select(F.col("vec_id").alias("scene_id"), F.posexplode("embedding").alias("i", "v"))
    return cells.select("scene_id", F.floor(F.col("i") / 8).cast("long").alias("row"), (F.col("i") % 8).cast("long").alias("col"), "v")


@query("D5_dbscan_core_points", f"{GRID}, h AS (SELECT scene_id, row, col FROM g WHERE v > 0)\n---\nSELECT a.scene_id, a.row, a.col, count(*) AS n_near, count(*) >= 10 AS core FROM h a JOIN h b ON a.scene_id = b.scene_id AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 9 GROUP BY 1, 2, 3")
def d5(spark, d):
    return tiles.core_points(grid(spark, d).filter("v > 0"), "scene_id")


def clusters_of(spark, d) -> DataFrame:
    from tidewater.operators.pixels import dbscan

    found = dbscan(grid(spark, d).filter(above(0.05)), "scene_id", eps=2, min_points=7)
    return found.withColumn("cluster", F.col("cluster.row") * 8 + F.col("cluster.col"))


CLUSTERS = GRID + """,
h AS (SELECT scene_id, row, col, v FROM g WHERE v > 0.05),
n AS (SELECT a.scene_id, a.row AS r1, a.col AS c1, b.row AS r2, b.col AS c2 FROM h a JOIN h b ON a.scene_id = b.scene_id AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 4),
k AS (SELECT scene_id, r1 AS row, c1 AS col, r1 * 8 + c1 AS id FROM n GROUP BY 1, 2, 3 HAVING count(*) >= 7),
e AS (SELECT n.scene_id, a.id AS a, b.id AS b FROM n JOIN k a ON a.scene_id = n.scene_id AND a.row = r1 AND a.col = c1 JOIN k b ON b.scene_id = n.scene_id AND b.row = r2 AND b.col = c2),
reach AS (SELECT scene_id, id AS a, id AS b FROM k UNION SELECT r.scene_id, r.a, e.b FROM reach r JOIN e ON e.scene_id = r.scene_id AND e.a = r.b),
lab AS (SELECT scene_id, a AS id, min(b) AS cluster FROM reach GROUP BY 1, 2),
cl AS (SELECT n.scene_id, r1 AS row, c1 AS col, min(cluster) FILTER (r1 = r2 AND c1 = c2) AS own, min(cluster) AS cluster FROM n JOIN lab ON lab.scene_id = n.scene_id AND lab.id = r2 * 8 + c2 GROUP BY 1, 2, 3),
clusters AS (SELECT scene_id, row, col, CAST(coalesce(own, cluster) AS BIGINT) AS cluster FROM cl)"""


@query("D5_dbscan_clusters", CLUSTERS + "\n---\nSELECT scene_id, row, col, cluster FROM clusters")
def d5b(spark, d):
    return clusters_of(spark, d).select("scene_id", "row", "col", "cluster")


@query("D6_cluster_stats", CLUSTERS + "\n---\nSELECT scene_id, cluster, count(*) AS n, count(*) * 1e-4 AS area_km2, round(avg(CAST(v AS DOUBLE)), 6) AS mean_z, round(CAST(max(v) AS DOUBLE), 6) AS max_z FROM clusters JOIN h USING (scene_id, row, col) GROUP BY 1, 2 HAVING count(*) >= 12")
def d6(spark, d):
    r = clusters_of(spark, d).join(grid(spark, d), ["scene_id", "row", "col"]).groupBy("scene_id", "cluster")
    r = r.agg(F.count("*").alias("n"), R(F.avg("v")).alias("mean_z"), R(F.max("v").cast("double")).alias("max_z")).filter("n >= 12")
    return r.withColumn("area_km2", F.col("n") * 1e-4)


@query("D7_majority_zone", CLUSTERS + """,
z AS (SELECT scene_id, cluster, CAST(row // 4 * 2 + col // 4 AS BIGINT) AS zone, count(*) AS n FROM clusters GROUP BY 1, 2, 3)
---
SELECT scene_id, cluster, zone, n, round(n / sum(n) OVER (PARTITION BY scene_id, cluster), 6) AS share FROM z QUALIFY row_number() OVER (PARTITION BY scene_id, cluster ORDER BY n DESC, zone) = 1""")
def d7(spark, d):
    zone = (F.floor(F.col("row") / 4) * 2 + F.floor(F.col("col") / 4)).cast("long")
    z = clusters_of(spark, d).withColumn("zone", zone).groupBy("scene_id", "cluster", "zone").agg(F.count("*").alias("n"))
    z = z.withColumn("share", R(F.col("n") / F.sum("n").over(Window.partitionBy("scene_id", "cluster"))))
    return B.first_rows(z, ["scene_id", "cluster"], [F.col("n").desc(), F.col("zone")])


@query("D9_cluster_outline", CLUSTERS + """,
ed AS (SELECT scene_id, cluster, 'h' AS kind, row AS r, col AS c FROM clusters UNION ALL SELECT scene_id, cluster, 'h', row + 1, col FROM clusters UNION ALL SELECT scene_id, cluster, 'v', row, col FROM clusters UNION ALL SELECT scene_id, cluster, 'v', row, col + 1 FROM clusters)
---
SELECT scene_id, cluster, kind, r, c FROM ed GROUP BY ALL HAVING count(*) = 1""")
def d9(spark, d):
    from tidewater.operators.pixels import outline

    return outline(clusters_of(spark, d), ["scene_id", "cluster"])


def features(spark, d) -> DataFrame:
    obs = bound(spark, d, "obs").join(bound(spark, d, "zones").select("zone_id", (F.col("body_id") % 5).alias("body_id")), "zone_id")
    return D.scene_features(obs, bound(spark, d, "rain"), ("A", "N", "R"))


FEATURES = """f AS (SELECT o.zone_id, z.body_id % 5 AS body_id, observed_at, avg(mean) FILTER (indicator = 'A') AS A, avg(mean) FILTER (indicator = 'N') AS N, avg(mean) FILTER (indicator = 'R') AS R, min(water_fraction_pct) AS water_fraction_pct
FROM obs o JOIN zones z USING (zone_id) GROUP BY 1, 2, 3), ff AS (SELECT f.*, r.mm_24h FROM f LEFT JOIN rain r ON r.body_id = f.body_id AND r.date = CAST(f.observed_at AS DATE))"""


@query("D10_scene_feature_history", FEATURES + "\n---\nSELECT zone_id, observed_at, round(A, 6) AS A, round(N, 6) AS N, round(R, 6) AS R, water_fraction_pct, round(mm_24h, 6) AS mm_24h FROM ff WHERE observed_at < TIMESTAMP '2001-01-01'", uses=("obs", "zones", "rain"))
def d10(spark, d):
    r = features(spark, d).filter("observed_at < '2001-01-01'")
    return r.select("zone_id", "observed_at", *[R(c).alias(c) for c in "ANR"], "water_fraction_pct", R("mm_24h").alias("mm_24h"))


@query("D11_water_extent_delta", """w AS (SELECT zone_id, observed_at, dayofyear(observed_at) AS doy, water_fraction_pct AS v FROM obs)
---
SELECT a.zone_id, a.observed_at, round(a.v - quantile_cont(b.v, 0.5), 6) AS delta, count(*) AS n FROM (SELECT DISTINCT zone_id, observed_at, doy, v FROM w) a
JOIN w b ON a.zone_id = b.zone_id AND b.observed_at < a.observed_at AND least(abs(a.doy - b.doy), 366 - abs(a.doy - b.doy)) <= 15 GROUP BY a.zone_id, a.observed_at, a.v""", uses=("obs",))
def d11(spark, d):
    w = bound(spark, d, "obs").select("zone_id", "observed_at", F.dayofyear("observed_at").alias("doy"), F.col("water_fraction_pct").alias("v"))
    return D.extent_deltas(w).withColumn("delta", R("delta"))


@query("D12_median_imputation", FEATURES + """,
md AS (SELECT zone_id, coalesce(quantile_cont(A, 0.5), 0) AS ma, coalesce(quantile_cont(N, 0.5), 0) AS mn, coalesce(quantile_cont(R, 0.5), 0) AS mr FROM ff GROUP BY 1)
---
SELECT zone_id, observed_at, round(coalesce(A, ma), 6) AS A, round(coalesce(N, mn), 6) AS N, round(coalesce(R, mr), 6) AS R, concat_ws(',', CASE WHEN A IS NULL THEN 'A' END, CASE WHEN N IS NULL THEN 'N' END, CASE WHEN R IS NULL THEN 'R' END) AS imputed FROM ff JOIN md USING (zone_id)""", uses=("obs", "zones", "rain"))
def d12(spark, d):
    r = D.impute(features(spark, d), ["zone_id"], ("A", "N", "R"))
    return r.select("zone_id", "observed_at", *[R(c).alias(c) for c in "ANR"], "imputed")


QUALITY = ("A", "NF", "NO", "R")


def quality_passes(spark, d) -> DataFrame:
    """One row for each zone and pass: four indicators, the water fraction and the rain of three days."""
    from tidewater.operators import rainfall as C

    zones = bound(spark, d, "zones").select("zone_id", (F.col("body_id") % 5).alias("body_id"))
    rain = C.trailing(bound(spark, d, "rain"), 3, "mm_72h").select("body_id", "date", "mm_72h")
    return D.scene_features(bound(spark, d, "quality").join(zones, "zone_id"), rain, QUALITY)


def outliers(spark, d) -> DataFrame:
    from tidewater.operators.forest import judged_passes

    return stored(judged_passes(quality_passes(spark, d), QUALITY), "judged-passes")


@query("D13_isolation_forest")
def d13(spark, d):
    """Every pass of every zone, by the passes before it."""
    return outliers(spark, d).withColumn("score", R("score"))


def rasters(spark, d) -> DataFrame:
    """Tiles as rasters of a body's pass: a tile's quadrants are the body's zones in order, and tile k of a body (25 bodies in
    turn) is each zone's k-th pass, from the first again after the last. A quadrant of a body with fewer zones has none."""
    zone = F.row_number().over(Window.partitionBy("body_id").orderBy("zone_id")) - 1
    zones = bound(spark, d, "zones").select("body_id", "zone_id", zone.alias("quadrant")).filter("quadrant < 4")
    passes = bound(spark, d, "obs").select("zone_id", "observed_at").distinct()
    passes = passes.withColumn("number", F.row_number().over(Window.partitionBy("zone_id").orderBy("observed_at")) - 1)
    passes = passes.withColumn("n", F.count("*").over(Window.partitionBy("zone_id")))
    quadrant = (F.floor(F.col("row") / 4) * 2 + F.floor(F.col("col") / 4)).cast("int")
    cells = grid(spark, d).withColumns({"body_id": F.col("scene_id") % 25, "turn": F.floor(F.col("scene_id") / 25), "quadrant": quadrant, "v": F.col("v").cast("double")})
    return cells.join(zones, ["body_id", "quadrant"]).join(passes, "zone_id").filter("number = turn % n").select("scene_id", "zone_id", "observed_at", "row", "col", "v")


#: The tiles' values have no unit: a pixel is hot from this z on, clusters are small, and so is the least area.
TILES = {"z": 1.5, "eps": 2, "min_points": 5, "min_area_km2": 5e-4}


def raster_clusters(spark, d, cells: DataFrame) -> DataFrame:
    """Clusters of hot pixels of whole tiles that pass the gate, each with the zone and pass that hold most of it."""
    from tidewater.operators.pixels import dbscan

    z = D.scene_z(cells, "v", ["scene_id"])
    gate = D.hot_gate(z, ["scene_id"], threshold=TILES["z"], min_hot=TILES["min_points"])
    hot = z.join(gate.filter("clustered").select("scene_id"), "scene_id").filter(F.col("z") > TILES["z"])
    placed = dbscan(hot, "scene_id", eps=TILES["eps"], min_points=TILES["min_points"]).join(hot, ["scene_id", "row", "col"])
    shares = placed.groupBy("scene_id", "cluster", "zone_id", "observed_at").agg(F.count("*").alias("in_zone"))
    stats = placed.groupBy("scene_id", "cluster").agg(F.count("*").alias("n_pixels"), F.avg("z").alias("mean_z"), F.max("z").alias("max_z"))
    major = B.first_rows(shares, ["scene_id", "cluster"], [F.col("in_zone").desc(), F.col("zone_id")])
    found = stats.join(major, ["scene_id", "cluster"]).withColumn("area_km2", F.col("n_pixels") * 1e-4).filter(F.col("area_km2") >= TILES["min_area_km2"])
    return found.withColumn("indicator", F.lit("A"))


def detector_verdicts(spark, d, cells: DataFrame) -> DataFrame:
    """Verdicts on every pass by the detectors themselves: temporal scores, clusters of the passes that have a tile, forests and
    the rainfall gate."""
    clusters = raster_clusters(spark, d, cells).groupBy("zone_id", "observed_at").agg(F.collect_list(F.struct("indicator", "area_km2")).alias("spatial"))
    odd = outliers(spark, d).select("zone_id", "observed_at", F.col("outlier").alias("multivariate"), "score")
    passes = gate_inputs(spark, d).withColumn("anomalous", listed("anomalous")).join(odd, ["zone_id", "observed_at"], "left").join(clusters, ["zone_id", "observed_at"], "left")
    return D.zone_verdict(passes, runoff=("A", "N"))


@query("D17_detector_verdict")
def d17_detectors(spark, d):
    """D2, D5 to D7, D13 and D15 in one run."""
    v = detector_verdicts(spark, d, rasters(spark, d))
    spatial = F.coalesce(F.size("spatial"), F.lit(0)).alias("n_clusters")
    return v.select("zone_id", "observed_at", F.array_join("anomalous", ",").alias("anomalous"), spatial, F.coalesce("multivariate", F.lit(False)).alias("multivariate"), "votes", F.array_join("gate_input", ",").alias("gate_input"), "outcome", "severity", "capped_from", "alertable", "suppressed_reason", R("affected_area_km2", 4).alias("affected_area_km2"))


@query("D8_flagged_zones")
def d8_flagged(spark, d):
    """Where the flagged zones that hold no cluster of the whole tile are worst, by the indicators that deviated."""
    cells = rasters(spark, d)
    v = detector_verdicts(spark, d, cells).filter(F.col("severity").isNotNull() & (F.coalesce(F.size("spatial"), F.lit(0)) == 0))
    asked = v.select("zone_id", "observed_at", F.when(F.size("anomalous") > 0, F.col("anomalous")).otherwise(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("asked"))
    scale = F.create_map(F.lit("A"), F.lit(1.0), F.lit("N"), F.lit(-1.0), F.lit("R"), F.lit(0.5))
    points = cells.join(asked, ["zone_id", "observed_at"]).select("scene_id", "zone_id", "row", "col", "v", F.explode("asked").alias("indicator"))
    points = points.select("scene_id", "zone_id", "indicator", "row", "col", (F.col("v") * scale[F.col("indicator")]).alias("value"))
    r = D.localised(stored(points, "flagged-pixels"), indicators=("A", "N", "R"), top_share=0.25, z_floor=0.5, eps=2, min_points=3, min_area_km2=2e-4)
    return r.select("scene_id", "zone_id", "indicator", F.col("cluster.row").alias("row"), F.col("cluster.col").alias("col"), "n_pixels", "area_km2", R("mean_z").alias("mean_z"), R("max_z").alias("max_z"))


@query("D8_zone_localisation")
def d8(spark, d):
    """Halves of the tiles as zones; those without a cluster of the whole tile are looked at on their own."""
    zone = F.floor(F.col("col") / 4).cast("long")
    cells = grid(spark, d).withColumn("zone_id", zone).withColumn("v", F.col("v").cast("double"))
    covered = clusters_of(spark, d).select("scene_id", zone.alias("zone_id")).distinct()
    rows = cells.join(covered, ["scene_id", "zone_id"], "left_anti")
    each = rows.select("scene_id", "zone_id", "row", "col", F.explode(F.create_map(F.lit("high"), F.col("v"), F.lit("low"), -F.col("v"))).alias("indicator", "value"))
    r = D.localised(each, indicators=("high", "low"), top_share=0.25, z_floor=0.5, eps=2, min_points=3, min_area_km2=2e-4)
    r = r.withColumn("cluster", F.col("cluster.row") * 8 + F.col("cluster.col"))
    return r.select("scene_id", "zone_id", "indicator", "cluster", "n_pixels", "area_km2", R("mean_z").alias("mean_z"), R("max_z").alias("max_z"))


@query("D14_vote_severity", "SELECT candidate_id, CASE WHEN votes >= 3 THEN 'high' WHEN votes = 2 THEN CASE WHEN abs(z) >= 5 THEN 'high' ELSE 'medium' END WHEN votes = 1 THEN CASE WHEN abs(z) >= 5 THEN 'medium' ELSE 'low' END END AS severity FROM candidates", uses=("candidates",))
def d14(spark, d):
    return bound(spark, d, "candidates").select("candidate_id", D.vote_severity(F.col("votes"), F.abs("z")).alias("severity"))


def outcome_sql(asked: str) -> str:
    return f"CASE WHEN {asked} = '' THEN 'no anomaly' WHEN mm_72h IS NULL THEN 'no rainfall' WHEN coalesce(n, 0) < 30 THEN 'thin history' WHEN mm_72h > p90 AND len(list_filter(string_split({asked}, ','), lambda x: x NOT IN ('A', 'N'))) = 0 THEN 'applied' WHEN mm_72h > p90 THEN 'other indicators' ELSE 'within p90' END"


ASKED = f"""{SCORED},
{ROLLUP},
c2 AS (SELECT body_id, date, CASE WHEN count(*) OVER w = 3 THEN sum(mm_24h) OVER w END AS mm_72h FROM rain WINDOW w AS (PARTITION BY body_id ORDER BY date RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)),
r2 AS (SELECT roll.zone_id, z.body_id % 5 AS body_id, observed_at, anomalous, max_abs_z, any_usable, dayofyear(observed_at) AS doy FROM roll JOIN zones z USING (zone_id)),
p9 AS (SELECT body_id, doy, quantile_cont(mm_24h, 0.9) * 2 AS p90, count(*) AS n FROM rain, (SELECT unnest(range(1, 367)) AS doy) WHERE least(abs(doy - dayofyear(date)), 366 - abs(doy - dayofyear(date))) <= 15 GROUP BY 1, 2),
gi AS (SELECT r2.*, c2.mm_72h, p9.p90, p9.n FROM r2 LEFT JOIN c2 ON c2.body_id = r2.body_id AND c2.date = CAST(observed_at AS DATE) LEFT JOIN p9 ON p9.body_id = r2.body_id AND p9.doy = r2.doy)"""
GATED = f"""{ASKED},
gated AS (SELECT *, {outcome_sql("anomalous")} AS outcome FROM gi)"""


def gate_inputs(spark, d) -> DataFrame:
    """The passes' rollup with the rain before them and its seasonal p90."""
    from tidewater.operators import rainfall as C

    rain = bound(spark, d, "rain")
    zones = bound(spark, d, "zones").select("zone_id", (F.col("body_id") % 5).alias("body_id"))
    r = rollup(spark, d).join(zones, "zone_id").withColumn("date", F.to_date("observed_at")).withColumn("doy", F.dayofyear("observed_at"))
    r = r.join(C.trailing(rain, 3, "mm_72h").select("body_id", "date", "mm_72h"), ["body_id", "date"], "left")
    return r.join(C.seasonal_p90(rain).withColumn("p90", F.col("p90") * 2), ["body_id", "doy"], "left")


def listed(c: str):
    return F.filter(F.split(c, ","), lambda x: x != "")


def gated(spark, d) -> DataFrame:
    r = gate_inputs(spark, d)
    return r.withColumn("gate", D.rainfall_gate(listed("anomalous"), F.col("mm_72h"), F.col("p90"), F.col("n"), ("A", "N"))).withColumn("outcome", F.col("gate.outcome"))


@query("D15_rainfall_gate", GATED + "\n---\nSELECT zone_id, observed_at, anomalous, outcome FROM gated", uses=(*ALL, "rain"))
def d15(spark, d):
    return gated(spark, d).select("zone_id", "observed_at", "anomalous", "outcome")


@query("D16_severity_cap", "s AS (SELECT candidate_id, CASE WHEN votes >= 3 THEN 'high' WHEN votes = 2 THEN 'medium' WHEN votes = 1 THEN 'low' END AS sev, rain_percentile > 0.9 AS nat FROM candidates)\n---\nSELECT candidate_id, CASE WHEN nat AND sev = 'high' THEN 'medium' ELSE sev END AS severity, CASE WHEN nat AND sev = 'high' THEN 'high' END AS capped_from FROM s", uses=("candidates",))
def d16(spark, d):
    severity, capped = D.cap_severity(D.vote_severity(F.col("votes"), F.lit(0.0)), F.col("rain_percentile") > 0.9)
    return bound(spark, d, "candidates").select("candidate_id", severity.alias("severity"), capped.alias("capped_from"))


VERDICT = f"""{ASKED},
sp AS (SELECT zone_id, observed_at, string_agg(DISTINCT indicator, ',' ORDER BY indicator) AS inds, round(sum(valid_pixel_pct / 1000), 4) AS area FROM obs WHERE water_fraction_pct > 47 GROUP BY 1, 2),
mv AS (SELECT zone_id, observed_at, max(p90) > 900 AS odd FROM obs GROUP BY 1, 2),
ga AS (SELECT gi.*, sp.area, CAST(anomalous <> '' AS BIGINT) + CAST(sp.inds IS NOT NULL AS BIGINT) + CAST(coalesce(mv.odd, false) AS BIGINT) AS votes, CASE WHEN anomalous <> '' THEN anomalous ELSE coalesce(sp.inds, '') END AS gate_input FROM gi LEFT JOIN sp USING (zone_id, observed_at) LEFT JOIN mv USING (zone_id, observed_at)),
go AS (SELECT *, {outcome_sql("gate_input")} AS outcome, CASE WHEN votes = 3 THEN 'high' WHEN votes = 2 THEN CASE WHEN max_abs_z >= 5 THEN 'high' ELSE 'medium' END WHEN votes = 1 THEN CASE WHEN max_abs_z >= 5 THEN 'medium' ELSE 'low' END END AS raw FROM ga),
verdict AS (SELECT *, CASE WHEN outcome = 'applied' AND raw = 'high' THEN 'medium' ELSE raw END AS severity, CASE WHEN outcome = 'applied' AND raw = 'high' THEN 'high' END AS capped_from, CASE WHEN votes = 0 THEN 'no detector voted' WHEN NOT coalesce(any_usable, false) THEN 'baseline building' END AS suppressed_reason FROM go)"""


def verdicts(spark, d) -> DataFrame:
    """Readings with much water stand for clusters, passes with a large p90 for the multivariate detector's outliers."""
    obs = bound(spark, d, "obs").groupBy("zone_id", "observed_at")
    cluster = F.when(F.col("water_fraction_pct") > 47, F.struct("indicator", (F.col("valid_pixel_pct") / 1000).cast("double").alias("area_km2")))
    marks = obs.agg(F.collect_list(cluster).alias("spatial"), (F.max("p90") > 900).alias("multivariate"))
    g = gate_inputs(spark, d).withColumn("anomalous", listed("anomalous")).join(marks, ["zone_id", "observed_at"], "left")
    return D.zone_verdict(g, runoff=("A", "N"))


@query("D17_zone_verdict", VERDICT + """
---
SELECT zone_id, observed_at, votes, gate_input, outcome, severity, capped_from, suppressed_reason IS NULL AS alertable, suppressed_reason, area AS affected_area_km2 FROM verdict""", uses=(*ALL, "rain"))
def d17(spark, d):
    return verdicts(spark, d).select("zone_id", "observed_at", "votes", F.array_join("gate_input", ",").alias("gate_input"), "outcome", "severity", "capped_from", "alertable", "suppressed_reason", R("affected_area_km2", 4).alias("affected_area_km2"))


@query("D18_geometry_kind", "SELECT candidate_id, CASE WHEN area_km2 > 3 THEN 'plume' WHEN votes > 1 THEN 'localised' ELSE 'zone' END AS geom_kind FROM candidates", uses=("candidates",))
def d18(spark, d):
    return bound(spark, d, "candidates").select("candidate_id", D.geometry_kind(F.col("area_km2") > 3, F.col("votes") > 1).alias("geom_kind"))


@query("D19_run_summary", VERDICT + """
---
SELECT body_id, observed_at, count(*) AS n_zones, count(*) FILTER (anomalous <> '') AS n_flagged, count(*) FILTER (suppressed_reason IS NULL) AS n_alertable, count(*) FILTER (outcome = 'applied') AS n_gated FROM verdict GROUP BY 1, 2""", uses=(*ALL, "rain"))
def d19(spark, d):
    return verdicts(spark, d).groupBy("body_id", "observed_at").agg(F.count("*").alias("n_zones"), F.count_if(F.size("anomalous") > 0).alias("n_flagged"), F.count_if("alertable").alias("n_alertable"), F.count_if(F.col("outcome") == "applied").alias("n_gated"))


@query("D20_json_safe", "SELECT event_id, to_json({'value': CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END}) AS safe FROM events")
def d20(spark, d):
    odd = F.when(F.col("event_id") % 14 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("event_id").cast("double"))
    e = table(spark, d, "events").select("event_id", D.json_safe(odd).cast("long").alias("value"))
    return e.select("event_id", F.to_json(F.struct("value"), {"ignoreNullFields": "false"}).alias("safe"))
