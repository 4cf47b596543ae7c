"""Read model, report, job and monitoring queries (Q, J, O)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import readmodels as M
from tidewater.operators.alerts import SEVERITIES
from tidewater.operators.alerts import episodes as episodes_of
from tidewater.operators.baseline import first_rows
from tidewater.plans.alerting import EPISODES, LABS, episodes, fields, verdicts
from tidewater.plans.bindings import bound, table
from tidewater.plans.detection import SCORED
from tidewater.plans.registry import query
from tidewater.plans.seasonal import ALL, BASE, baseline_with_status, seen
from tidewater.sources.stored import stored

R = lambda c, n=6: F.round(c, n)
STAGE = "st AS (SELECT body_id, scene_id % 500 AS scene_id, list_extract(['ingested', 'masked', 'indicators', 'anomalies', 'scored', 'alerted'], CAST(scene_id % 7 % 6 + 1 AS INTEGER)) AS stage, CAST(scene_id % 7 % 6 AS BIGINT) AS k, sensed_at, cloud_pct, state FROM scenes)"


def stages(spark, d) -> DataFrame:
    k = F.col("scene_id") % 7 % 6
    return bound(spark, d, "scenes").select("body_id", (F.col("scene_id") % 500).alias("scene_id"), F.element_at(F.array(*[F.lit(s) for s in M.STAGES]), (k + 1).cast("int")).alias("stage"), k.alias("k"), "sensed_at", "cloud_pct", "state")


@query("Q1_deepest_stage", STAGE + "\n---\nSELECT body_id, scene_id, arg_max(stage, k) AS stage FROM st GROUP BY 1, 2", uses=("scenes",))
def q1(spark, d):
    return M.deepest_stage(stages(spark, d))


@query("Q2_body_status", EPISODES + """,
o AS (SELECT zone_id AS body_id, count(*) AS n_open, max(peak_rank) AS mr FROM ef WHERE last_at > TIMESTAMP '2001-06-01' AND zone_id % 3 > 0 GROUP BY 1), nz AS (SELECT body_id, count(*) AS n FROM zones GROUP BY 1), lm AS (SELECT body_id, max(sensed_at) AS m FROM scenes WHERE body_id <> 7 AND cloud_pct < 50 GROUP BY 1)
---
SELECT b.body_id, b.name, coalesce(nz.n, 0) AS n_zones, coalesce(n_open, 0) AS n_open, coalesce(mr, 0) AS max_rank, lm.m AS latest_mask,
CASE WHEN lm.m IS NULL THEN 'no_data' WHEN coalesce(mr, 0) >= 2 THEN 'alert' WHEN coalesce(n_open, 0) > 0 THEN 'watch' WHEN b.body_id % 2 = 1 OR nz.n IS NULL THEN 'baseline_building' ELSE 'normal' END AS status
FROM bodies b LEFT JOIN nz USING (body_id) LEFT JOIN o USING (body_id) LEFT JOIN lm USING (body_id)""", uses=("bodies", "zones", "candidates", "scenes"))
def q2(spark, d):
    alerts = fields(spark, d).filter("last_at > '2001-06-01' AND zone_id % 3 > 0").select(F.col("zone_id").alias("body_id"), F.col("peak_rank").alias("rank"))
    zones = bound(spark, d, "zones")
    baselines = zones.select("body_id", (F.col("body_id") % 2 == 0).alias("usable"))
    masks = bound(spark, d, "scenes").filter("body_id <> 7 AND cloud_pct < 50")
    return M.body_status(bound(spark, d, "bodies"), zones, alerts, baselines, masks)


@query("Q3_zone_cards", EPISODES + "\n---\nSELECT z.zone_id, CASE WHEN z.zone_id % 4 = 0 THEN 'none' WHEN z.zone_id % 4 = 1 THEN 'building' ELSE 'usable' END AS baseline, max(e.episode) AS open_alert FROM zones z LEFT JOIN ef e ON e.zone_id = z.zone_id AND e.last_at > TIMESTAMP '2001-06-01' GROUP BY 1", uses=("zones", "candidates"))
def q3(spark, d):
    opened = fields(spark, d).filter("last_at > '2001-06-01'").groupBy("zone_id").agg(F.max("episode").alias("open_alert"))
    k = F.col("zone_id") % 4
    return bound(spark, d, "zones").join(opened, "zone_id", "left").select("zone_id", F.when(k == 0, "none").when(k == 1, "building").otherwise("usable").alias("baseline"), "open_alert")


@query("Q2_body_states", BASE + ",\n" + EPISODES + """,
oa AS (SELECT zone_id AS body_id, count(*) AS n_open, max(peak_rank) AS mr FROM ef WHERE last_at > TIMESTAMP '2001-06-01' AND zone_id % 3 > 0 GROUP BY 1), nz AS (SELECT body_id, count(*) AS n FROM zones GROUP BY 1), lm AS (SELECT body_id, max(sensed_at) AS m FROM scenes WHERE cloud_pct < 50 GROUP BY 1),
ub AS (SELECT body_id, bool_or(status = 'usable') AS u FROM zones JOIN base USING (zone_id) GROUP BY 1)
---
SELECT b.body_id, b.name, coalesce(nz.n, 0) AS n_zones, coalesce(n_open, 0) AS n_open, coalesce(mr, 0) AS max_rank, lm.m AS latest_mask,
CASE WHEN lm.m IS NULL THEN 'no_data' WHEN coalesce(mr, 0) >= 2 THEN 'alert' WHEN coalesce(n_open, 0) > 0 THEN 'watch' WHEN NOT coalesce(u, false) THEN 'baseline_building' ELSE 'normal' END AS status
FROM bodies b LEFT JOIN nz USING (body_id) LEFT JOIN oa USING (body_id) LEFT JOIN lm USING (body_id) LEFT JOIN ub USING (body_id)""", uses=(*ALL, "candidates", "scenes"))
def q2_states(spark, d):
    """As Q2, with the state of the baselines that B3 builds."""
    alerts = fields(spark, d).filter("last_at > '2001-06-01' AND zone_id % 3 > 0").select(F.col("zone_id").alias("body_id"), F.col("peak_rank").alias("rank"))
    zones = bound(spark, d, "zones").select("zone_id", "body_id")
    states = M.zone_states(zones, baseline_with_status(spark, d)).select("body_id", (F.col("baseline") == "usable").alias("usable"))
    return M.body_status(bound(spark, d, "bodies"), zones, alerts, states, bound(spark, d, "scenes").filter("cloud_pct < 50"))


@query("Q3_zone_states", BASE + ",\n" + EPISODES + """,
bz AS (SELECT zone_id, count(*) FILTER (status = 'usable') AS nu, count(*) AS n FROM base GROUP BY 1), oz AS (SELECT zone_id, max(episode) AS open_alert FROM ef WHERE last_at > TIMESTAMP '2001-06-01' GROUP BY 1)
---
SELECT zone_id, CASE WHEN nu > 0 THEN 'usable' WHEN n > 0 THEN 'building' ELSE 'none' END AS baseline, coalesce(nu, 0) AS n_usable, open_alert FROM zones LEFT JOIN bz USING (zone_id) LEFT JOIN oz USING (zone_id)""", uses=(*ALL, "candidates"))
def q3_states(spark, d):
    opened = fields(spark, d).filter("last_at > '2001-06-01'").groupBy("zone_id").agg(F.max("episode").alias("open_alert"))
    states = M.zone_states(bound(spark, d, "zones").select("zone_id"), baseline_with_status(spark, d))
    return states.join(opened, "zone_id", "left").select("zone_id", "baseline", "n_usable", "open_alert")


@query("Q4_observations", STAGE + "\n---\nSELECT s.scene_id, s.body_id, s.sensed_at, i.n AS bytes_read, CASE WHEN s.state = 'F' THEN s.cloud_pct < 40 ELSE s.cloud_pct <= 60 END AS usable FROM scenes s JOIN (SELECT l_orderkey AS scene_id, count(*) AS n FROM lineitem GROUP BY 1) i USING (scene_id)", uses=("scenes",))
def q4(spark, d):
    i = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("scene_id")).agg(F.count("*").alias("bytes_read"))
    return bound(spark, d, "scenes").join(i, "scene_id").select("scene_id", "body_id", "sensed_at", "bytes_read", F.when(F.col("state") == "F", F.col("cloud_pct") < 40).otherwise(F.col("cloud_pct") <= 60).alias("usable"))


@query("Q5_latest_scene", "SELECT body_id, arg_max(scene_id, (sensed_at, scene_id)) AS scene_id, max(sensed_at) AS sensed_at FROM scenes WHERE sensed_at <= TIMESTAMP '1999-06-30' GROUP BY 1", uses=("scenes",))
def q5(spark, d):
    return bound(spark, d, "scenes").filter("sensed_at <= '1999-06-30'").groupBy("body_id").agg(F.max_by("scene_id", F.struct("sensed_at", "scene_id")).alias("scene_id"), F.max("sensed_at").alias("sensed_at"))


PANEL = SCORED + """,
la AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY zone_id, indicator ORDER BY observed_at DESC, scene_id, line) = 1)"""


def latest_readings(spark, d) -> DataFrame:
    from tidewater.operators.detect import temporal_scores

    return first_rows(temporal_scores(seen(spark, d)), ["zone_id", "indicator"], [F.col("observed_at").desc(), F.col("scene_id"), F.col("line")])


@query("Q6_zone_panel", PANEL + """
---
SELECT z.zone_id, i.indicator, round(la.mean, 6) AS mean, round(la.z, 6) AS z, round(CASE WHEN abs(median) > 1e-6 THEN 100 * (la.mean - median) / median END, 6) AS deviation_pct, la.mean IS NULL AS missing
FROM zones z CROSS JOIN (SELECT unnest(['A', 'N', 'R', 'X']) AS indicator) i LEFT JOIN la ON la.zone_id = z.zone_id AND la.indicator = i.indicator""", uses=ALL)
def q6(spark, d):
    grid = bound(spark, d, "zones").select("zone_id", F.explode(F.array(*[F.lit(x) for x in "ANRX"])).alias("indicator"))
    r = grid.join(latest_readings(spark, d), ["zone_id", "indicator"], "left")
    deviation = F.when(F.abs("median") > 1e-6, 100 * (F.col("mean") - F.col("median")) / F.col("median"))
    return r.select("zone_id", "indicator", R("mean").alias("mean"), R("z").alias("z"), R(deviation).alias("deviation_pct"), F.col("mean").isNull().alias("missing"))


@query("Q7_series_payload", SCORED + """
---
SELECT 'point' AS kind, zone_id, indicator, observed_at AS at, scene_id, line, round(mean, 6) AS mean, round(z, 6) AS z, CAST(1 AS BIGINT) AS n FROM scored
UNION ALL SELECT 'week', zone_id, indicator, CAST(date_trunc('week', observed_at) AS TIMESTAMP), NULL, NULL, round(avg(mean), 6), round(max(z), 6), count(*) FROM scored GROUP BY zone_id, indicator, date_trunc('week', observed_at)""", uses=ALL)
def q7(spark, d):
    """Each point with its z, and each week with its mean, its highest z and its number of points."""
    from tidewater.operators.detect import temporal_scores

    s = stored(temporal_scores(seen(spark, d)).select("zone_id", "indicator", "observed_at", "scene_id", "line", "mean", "z"), "scored")
    points = s.select(F.lit("point").alias("kind"), "zone_id", "indicator", F.col("observed_at").alias("at"), "scene_id", "line", R("mean").alias("mean"), R("z").alias("z"), F.lit(1).cast("long").alias("n"))
    weeks = s.groupBy("zone_id", "indicator", F.date_trunc("week", "observed_at").cast(points.schema["at"].dataType).alias("at")).agg(R(F.avg("mean")).alias("mean"), R(F.max("z")).alias("z"), F.count("*").alias("n"))
    return points.unionByName(weeks.withColumn("kind", F.lit("week")), allowMissingColumns=True)


@query("Q8_scene_marker", "SELECT s.body_id, arg_max(scene_id, (sensed_at, scene_id)) AS marker, z.first_zone FROM scenes s LEFT JOIN (SELECT body_id, min(zone_id) AS first_zone FROM zones GROUP BY 1) z ON z.body_id = s.body_id GROUP BY 1, 3", uses=("scenes", "zones"))
def q8(spark, d):
    first = bound(spark, d, "zones").groupBy("body_id").agg(F.min("zone_id").alias("first_zone"))
    return bound(spark, d, "scenes").groupBy("body_id").agg(F.max_by("scene_id", F.struct("sensed_at", "scene_id")).alias("marker")).join(first, "body_id", "left")


@query("Q9_keyset_page", "SELECT scene_id, sensed_at FROM scenes WHERE sensed_at < TIMESTAMP '2000-01-05' OR (sensed_at = TIMESTAMP '2000-01-05' AND scene_id > 5000) ORDER BY sensed_at DESC, scene_id LIMIT 51", uses=("scenes",))
def q9(spark, d):
    at = F.lit("2000-01-05").cast("timestamp_ntz")
    return M.page_after(bound(spark, d, "scenes").select("scene_id", "sensed_at"), [("sensed_at", True), ("scene_id", False)], (at, 5000), 50)


@query("Q11_worst_reading", PANEL + """
---
SELECT z.body_id, indicator, la.zone_id, round(z, 6) AS z, CASE WHEN status <> 'usable' THEN 'Building' WHEN abs(z) > 5 THEN 'Elevated' WHEN abs(z) > 3 THEN 'Watch' ELSE 'Normal' END AS status
FROM la JOIN zones z USING (zone_id) QUALIFY row_number() OVER (PARTITION BY z.body_id, indicator ORDER BY abs(coalesce(la.z, 0)) DESC, la.zone_id) = 1""", uses=ALL)
def q11(spark, d):
    r = latest_readings(spark, d).join(bound(spark, d, "zones").select("zone_id", "body_id"), "zone_id")
    r = first_rows(r, ["body_id", "indicator"], [F.abs(F.coalesce("z", F.lit(0.0))).desc(), F.col("zone_id")])
    return r.select("body_id", "indicator", "zone_id", R("z").alias("z"), M.reading_status(F.col("z"), F.col("status") == "usable").alias("status"))


@query("Q12_body_ranking", EPISODES + "\n---\nSELECT b.body_id, b.name, b.tier, count(e.episode) AS n_alerts FROM bodies b LEFT JOIN ef e ON e.zone_id = b.body_id AND e.peak_rank = 3 GROUP BY 1, 2, 3 ORDER BY n_alerts DESC, tier, name LIMIT 10", uses=("bodies", "candidates"))
def q12(spark, d):
    n = fields(spark, d).filter("peak_rank = 3").groupBy(F.col("zone_id").alias("body_id")).agg(F.count("*").alias("n_alerts"))
    r = bound(spark, d, "bodies").join(n, "body_id", "left").select("body_id", "name", "tier", F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"))
    return r.orderBy(F.desc("n_alerts"), "tier", "name").limit(10)


@query("Q13_name_lookup", "q AS (SELECT unnest(['nation_3', 'Nation_1', 'tion_2', 'nowhere']) AS asked)\n---\nSELECT asked, name FROM q JOIN bodies ON contains(lower(name), lower(asked)) QUALIFY row_number() OVER (PARTITION BY asked ORDER BY lower(name) = lower(asked) DESC, name) = 1", uses=("bodies",))
def q13(spark, d):
    names = bound(spark, d, "bodies").select("name", F.lower("name").alias("low"))
    asked = F.explode(F.array(*[F.lit(x) for x in ("nation_3", "Nation_1", "tion_2", "nowhere")]))
    r = names.withColumn("asked", asked).filter(F.contains("low", F.lower("asked")))
    return first_rows(r, ["asked"], [(F.col("low") == F.lower("asked")).desc(), F.col("name")]).select("asked", "name")


@query("Q14_peak_z", SCORED + "\n---\nSELECT zone_id, indicator, round(arg_max(z, (abs(z), scene_id, line)), 6) AS peak_z, count(*) FILTER (abs(z) > 3) AS n_flagged FROM scored GROUP BY 1, 2", uses=ALL)
def q14(spark, d):
    from tidewater.operators.detect import temporal_scores

    r = temporal_scores(seen(spark, d)).groupBy("zone_id", "indicator")
    peak = F.max(F.when(F.col("z").isNotNull(), F.struct(F.abs("z").alias("a"), F.col("scene_id"), F.col("line"), F.col("z"))))["z"]
    return r.agg(R(peak).alias("peak_z"), F.count_if("flagged").alias("n_flagged"))


DAYS = "dy AS (SELECT *, CAST(sensed_at AS DATE) AS day FROM scenes QUALIFY row_number() OVER (PARTITION BY body_id, CAST(sensed_at AS DATE) ORDER BY state = 'F' DESC, cloud_pct <= 60 DESC, cloud_pct, sensed_at, scene_id) = 1)"


def days(spark, d) -> DataFrame:
    s = bound(spark, d, "scenes").withColumn("day", F.to_date("sensed_at"))
    return first_rows(s, ["body_id", "day"], [(F.col("state") == "F").desc(), (F.col("cloud_pct") <= 60).desc(), F.col("cloud_pct"), F.col("sensed_at"), F.col("scene_id")])


@query("J1_scene_per_day", DAYS + "\n---\nSELECT body_id, day, scene_id FROM dy", uses=("scenes",))
def j1(spark, d):
    return days(spark, d).select("body_id", "day", "scene_id")


@query("J2_day_report", SCORED + ",\n" + EPISODES + ",\n" + DAYS + """,
rd AS (SELECT scene_id, zone_id, round(max(mean) FILTER (indicator = 'A'), 6) AS mean_a, round(max(mean) FILTER (indicator = 'N'), 6) AS mean_n, round(max(z) FILTER (indicator = 'A'), 6) AS z_a, round(max(z) FILTER (indicator = 'N'), 6) AS z_n, round(max(abs(z)), 6) AS max_abs_z, max(valid_pct0) AS zone_valid_pct FROM (SELECT s.*, o.valid_pixel_pct AS valid_pct0 FROM scored s JOIN obs o USING (zone_id, indicator, observed_at, scene_id, line)) GROUP BY 1, 2),
ai AS (SELECT zone_id, CAST(observed_at AS DATE) AS day, min(zone_id || '/' || indicator || '/' || episode) AS alert_id FROM ep GROUP BY 1, 2)
---
SELECT dy.body_id, dy.day, dy.scene_id, dy.cloud_pct, CASE WHEN state <> 'P' THEN cloud_pct <= 60 END AS mask_usable, CASE WHEN state <> 'P' THEN 100 - cloud_pct END AS valid_pct, CASE WHEN state = 'F' THEN 'done' END AS run_status, round(r.mm_24h, 6) AS mm_24h, z.zone_id, rd.mean_a, rd.mean_n, rd.z_a, rd.z_n, rd.max_abs_z, rd.zone_valid_pct,
CASE WHEN z.zone_id = dy.body_id THEN CASE WHEN dy.votes > 1 THEN CASE WHEN dy.priority >= 70 THEN 'high' WHEN dy.priority >= 40 THEN 'medium' ELSE 'low' END WHEN dy.votes = 1 THEN 'low' END END AS severity, CASE WHEN z.zone_id = dy.body_id THEN CASE WHEN dy.votes > 1 THEN dy.priority >= 40 ELSE dy.votes > 0 END END AS alertable, ai.alert_id
FROM (SELECT dy.*, c.votes, c.priority FROM dy JOIN candidates c ON c.candidate_id = dy.scene_id) dy LEFT JOIN rain r ON r.body_id = dy.body_id AND r.date = dy.day LEFT JOIN zones z ON z.body_id = dy.body_id LEFT JOIN rd ON rd.scene_id = dy.scene_id AND rd.zone_id = z.zone_id LEFT JOIN ai ON ai.zone_id = z.zone_id AND ai.day = dy.day""", uses=(*ALL, "scenes", "rain", "candidates"))
def j2(spark, d):
    """Candidates are of the zone that has their body's id."""
    from tidewater.operators.detect import temporal_scores

    scenes = bound(spark, d, "scenes")
    masks = scenes.filter("state <> 'P'").select("scene_id", (F.col("cloud_pct") <= 60).alias("mask_usable"), (100 - F.col("cloud_pct")).alias("valid_pct"))
    runs = scenes.filter("state = 'F'").select("scene_id", F.lit("done").alias("run_status"))
    rain = bound(spark, d, "rain").select("body_id", F.col("date").alias("day"), R("mm_24h").alias("mm_24h"))
    of = lambda c, i: R(F.max(F.when(F.col("indicator") == i, F.col(c)))).alias(f"{c}_{i.lower()}")
    chosen = stored(days(spark, d).select("body_id", "day", "scene_id", "cloud_pct"), "days")
    scored = temporal_scores(seen(spark, d, also=("scene_id", "valid_pixel_pct"))).select("scene_id", "zone_id", "indicator", "mean", "z", "valid_pixel_pct")
    read = scored.join(chosen.select("scene_id"), "scene_id", "left_semi").groupBy("scene_id", "zone_id").agg(of("mean", "A"), of("mean", "N"), of("z", "A"), of("z", "N"), R(F.max(F.abs("z"))).alias("max_abs_z"), F.max("valid_pixel_pct").alias("zone_valid_pct"))
    c = bound(spark, d, "candidates").withColumnRenamed("candidate_id", "scene_id")
    candidates = c.select("scene_id", "zone_id", F.when(F.col("votes") > 0, "low").alias("severity"), (F.col("votes") > 0).alias("alertable"))
    band = F.when(F.col("priority") >= 70, "high").when(F.col("priority") >= 40, "medium").otherwise("low")
    scores = c.filter("votes > 1").select("scene_id", "zone_id", band.alias("score_severity"), (F.col("priority") >= 40).alias("score_alertable"))
    alerts = episodes(spark, d).groupBy("zone_id", F.to_date("observed_at").alias("day")).agg(F.min(F.concat_ws("/", F.col("zone_id").cast("string"), "indicator", F.col("episode").cast("string"))).alias("alert_id"))
    zones = bound(spark, d, "zones").select("zone_id", "body_id")
    return M.day_report(chosen, zones, masks=masks, runs=runs, rain=rain, readings=read, candidates=candidates, scores=scores, alerts=alerts)


@query("J3_day_status", DAYS + "\n---\nSELECT body_id, day, CASE WHEN scene_id % 11 = 0 THEN 'no scene' WHEN scene_id % 7 = 0 THEN 'not processed' WHEN scene_id % 5 = 0 THEN 'mask failed' WHEN cloud_pct > 60 THEN 'too cloudy' WHEN state = 'O' THEN 'masked only' WHEN state = 'P' THEN 'indicators running' ELSE 'observed' END AS status FROM dy", uses=("scenes",))
def j3(spark, d):
    s = F.col("scene_id")
    status = M.day_status(F.when(s % 11 != 0, s), s % 7 != 0, F.when(s % 5 == 0, "failed").otherwise("done"), F.col("cloud_pct") > 60, F.when(F.col("state") == "P", "running").when(F.col("state") == "F", "done"))
    return days(spark, d).select("body_id", "day", status.alias("status"))


@query("J4_area_weighted_means", "SELECT z.body_id, o.observed_at, o.indicator, round(sum(mean * z.area_km2) / sum(z.area_km2), 6) AS mean, count(*) FILTER (mean > 500) AS n_high, round(max(mean), 6) AS max_mean FROM obs o JOIN zones z USING (zone_id) GROUP BY 1, 2, 3", uses=("obs", "zones"))
def j4(spark, d):
    r = bound(spark, d, "obs").join(bound(spark, d, "zones").select("zone_id", "body_id", "area_km2"), "zone_id").groupBy("body_id", "observed_at", "indicator")
    return r.agg(R(M.weighted_mean(F.col("mean"), F.col("area_km2"))).alias("mean"), F.count_if(F.col("mean") > 500).alias("n_high"), R(F.max("mean")).alias("max_mean"))


@query("J5_brief_series", SCORED + """,
al AS (SELECT zone_id, indicator, max(observed_at) AS last_at FROM scored WHERE abs(z) > 3 GROUP BY zone_id, indicator, year(observed_at))
---
SELECT zone_id, indicator, last_at, observed_at, scene_id, line, round(mean, 6) AS mean, round(p10, 6) AS p10, round(p90, 6) AS p90, round(median, 6) AS median, round(z, 6) AS z FROM al JOIN scored USING (zone_id, indicator) WHERE CAST(observed_at AS DATE) BETWEEN CAST(last_at AS DATE) - 360 AND CAST(last_at AS DATE)""", uses=ALL)
def j5(spark, d):
    """The last flagged reading of each year as the alert."""
    from tidewater.operators.detect import temporal_scores

    scored = stored(temporal_scores(seen(spark, d)).select("zone_id", "indicator", "observed_at", "scene_id", "line", "mean", "p10", "p90", "median", "z", "flagged"), "scored")
    alerts = scored.filter("flagged").groupBy("zone_id", "indicator", F.year("observed_at")).agg(F.max("observed_at").alias("last_at")).select("zone_id", "indicator", "last_at")
    return M.brief_series(alerts, scored.drop("flagged")).select("zone_id", "indicator", "last_at", "observed_at", "scene_id", "line", *[R(c).alias(c) for c in ("mean", "p10", "p90", "median", "z")])


FLAGGED = """fl AS (SELECT *, coalesce(date_diff('day', lag(observed_at) OVER w, observed_at) > 14, true) AS fresh FROM scored WHERE abs(z) > 3 WINDOW w AS (PARTITION BY zone_id, indicator ORDER BY observed_at, scene_id, line)),
fe AS (SELECT *, CAST(sum(CAST(fresh AS BIGINT)) OVER (PARTITION BY zone_id, indicator ORDER BY observed_at, scene_id, line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM fl),
al AS (SELECT zone_id, indicator, episode, min(observed_at) AS first_at, max(observed_at) AS last_at, count(*) AS n_flagged FROM fe GROUP BY 1, 2, 3)"""


@query("J5_episode_briefs", SCORED + ",\n" + FLAGGED + """
---
SELECT zone_id, indicator, episode, first_at, last_at, n_flagged, count(*) AS n_points, count(mean) AS n_readings, round(max(mean), 6) AS highest, count(*) FILTER (mean > p90) AS n_above, count(*) FILTER (mean < p10) AS n_below, round(max(abs(z)), 6) AS max_abs_z, min(observed_at) AS since
FROM al JOIN scored USING (zone_id, indicator) WHERE CAST(observed_at AS DATE) BETWEEN CAST(last_at AS DATE) - 360 AND CAST(last_at AS DATE) GROUP BY ALL""", uses=ALL)
def j5_episodes(spark, d):
    """Alerts are the episodes of flagged readings; each one's brief comes as the figures of its twelve months."""
    from tidewater.operators.detect import temporal_scores

    scored = stored(temporal_scores(seen(spark, d)).select("zone_id", "indicator", "observed_at", "scene_id", "line", "mean", "p10", "p90", "z", "flagged"), "scored")
    placed = episodes_of(scored.filter("flagged").withColumn("candidate_id", F.struct("scene_id", "line")))
    alerts = placed.groupBy("zone_id", "indicator", "episode").agg(F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.count("*").alias("n_flagged"))
    brief = M.brief_series(alerts, scored.select("zone_id", "indicator", "observed_at", "mean", "p10", "p90", "z")).groupBy("zone_id", "indicator", "episode", "first_at", "last_at", "n_flagged")
    return brief.agg(
        F.count("*").alias("n_points"), F.count("mean").alias("n_readings"), R(F.max("mean")).alias("highest"), F.count_if(F.col("mean") > F.col("p90")).alias("n_above"), F.count_if(F.col("mean") < F.col("p10")).alias("n_below"),
        R(F.max(F.abs("z"))).alias("max_abs_z"), F.min("observed_at").alias("since"),
    )


JOBS = STAGE + """,
jc AS (SELECT body_id, year(sensed_at) AS yr, count(DISTINCT scene_id) AS n_scenes, """ + ", ".join(f"count(DISTINCT CASE WHEN k >= {i} OR state = 'P' THEN scene_id END) AS {n}" for i, n in enumerate(M.STAGES[:5])) + " FROM st WHERE cloud_pct <= 60 GROUP BY 1, 2)"


def jobs(spark, d) -> DataFrame:
    s = stages(spark, d).filter("cloud_pct <= 60").groupBy("body_id", F.year("sensed_at").cast("long").alias("yr"))
    return s.agg(F.countDistinct("scene_id").alias("n_scenes"), *[F.countDistinct(F.when((F.col("k") >= i) | (F.col("state") == "P"), F.col("scene_id"))).alias(n) for i, n in enumerate(M.STAGES[:5])])


@query("J6_stage_counts", JOBS + "\n---\nSELECT * FROM jc", uses=("scenes",))
def j6(spark, d):
    return jobs(spark, d)


@query("J7_job_progress", JOBS + """
---
SELECT body_id, yr, round((least(ingested / n_scenes, 1) + least(masked / n_scenes, 1) + least(indicators / n_scenes, 1) + least(anomalies / n_scenes, 1) + least(scored / n_scenes, 1)) / 5 * 100, 4) AS progress,
CASE WHEN ingested < n_scenes THEN 'ingested' WHEN masked < n_scenes THEN 'masked' WHEN indicators < n_scenes THEN 'indicators' WHEN anomalies < n_scenes THEN 'anomalies' WHEN scored < n_scenes THEN 'scored' END AS current_stage,
CASE WHEN least(ingested, masked, indicators, anomalies, scored) >= n_scenes THEN 'done' ELSE 'running' END AS status FROM jc""", uses=("scenes",))
def j7(spark, d):
    return M.progress(jobs(spark, d)).select("body_id", "yr", "progress", "current_stage", "status")


@query("J8_active_jobs", "SELECT body_id, sensed_at, scene_id FROM scenes WHERE state IN ('O', 'P') QUALIFY row_number() OVER (PARTITION BY body_id, sensed_at ORDER BY scene_id DESC) = 1", uses=("scenes",))
def j8(spark, d):
    return M.newest(bound(spark, d, "scenes").filter("state IN ('O', 'P')"), ["body_id", "sensed_at"], "scene_id", "body_id").select("body_id", "sensed_at", "scene_id")


@query("O1_staleness", "SELECT b.body_id, coalesce(round((epoch(TIMESTAMP '2001-08-10') - epoch(max(s.sensed_at))) / 86400, 2), 9999.0) AS days, coalesce(round((epoch(TIMESTAMP '2001-08-10') - epoch(max(s.sensed_at))) / 86400, 2), 9999.0) > 10 AS page FROM bodies b LEFT JOIN scenes s ON s.body_id = b.body_id AND cloud_pct < 20 AND b.body_id <> 3 GROUP BY 1", uses=("bodies", "scenes"))
def o1(spark, d):
    return M.staleness(bound(spark, d, "bodies"), bound(spark, d, "scenes").filter("cloud_pct < 20 AND body_id <> 3"), now="2001-08-10")


@query("O2_open_alerts", EPISODES + ",\n" + LABS + """
---
SELECT 'open_alerts' AS gauge, s.severity AS label, CAST(count(ef.episode) AS DOUBLE) AS value FROM (SELECT unnest(['low', 'medium', 'high']) AS severity, unnest([1, 2, 3]) AS r) s LEFT JOIN ef ON ef.peak_rank = s.r AND last_at > TIMESTAMP '2001-07-20' GROUP BY 2
UNION ALL SELECT 'baseline_building_zones', '', (SELECT count(*) FROM zones) - (SELECT count(DISTINCT zone_id) FROM zones WHERE zone_id % 4 > 1)
UNION ALL SELECT 'validation_precision', '', round(coalesce(count(*) FILTER (verdict = 'matched') / nullif(count(*) FILTER (verdict <> 'inconclusive'), 0), 0), 6) FROM ver""", uses=("candidates", "zones"))
def o2(spark, d):
    """Gauges; as in Q3, zones whose id leaves 2 or 3 by 4 have a usable baseline."""
    rank = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("peak_rank").cast("int"))
    opened = fields(spark, d).filter("last_at > '2001-07-20'").select(rank.alias("severity"))
    zones = bound(spark, d, "zones")
    baselines = zones.select("zone_id", F.when(F.col("zone_id") % 4 > 1, "usable").otherwise("building").alias("status"))
    return M.gauges(opened, zones, baselines, verdicts(spark, d)).withColumn("value", R("value"))


@query("O2_gauges", BASE + ",\n" + EPISODES + ",\n" + LABS + """
---
SELECT 'open_alerts' AS gauge, s.severity AS label, CAST(count(ef.episode) AS DOUBLE) AS value FROM (SELECT unnest(['low', 'medium', 'high']) AS severity, unnest([1, 2, 3]) AS r) s LEFT JOIN ef ON ef.peak_rank = s.r AND last_at > TIMESTAMP '2001-07-20' GROUP BY 2
UNION ALL SELECT 'baseline_building_zones', '', (SELECT count(*) FROM zones) - (SELECT count(DISTINCT zone_id) FROM base WHERE status = 'usable')
UNION ALL SELECT 'validation_precision', '', round(coalesce(count(*) FILTER (verdict = 'matched') / nullif(count(*) FILTER (verdict <> 'inconclusive'), 0), 0), 6) FROM ver""", uses=(*ALL, "candidates"))
def o2_gauges(spark, d):
    """Gauges with the state of the baselines that B3 builds."""
    rank = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("peak_rank").cast("int"))
    opened = fields(spark, d).filter("last_at > '2001-07-20'").select(rank.alias("severity"))
    return M.gauges(opened, bound(spark, d, "zones"), baseline_with_status(spark, d), verdicts(spark, d)).withColumn("value", R("value"))


@query("O3_event_counters", "SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def o3(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))


@query("O4_stage_p95", "SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS start, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n, quantile_cont(value, 0.95) > 20 AS alarm FROM events GROUP BY 1, 2")
def o4(spark, d):
    return M.hourly_p95(table(spark, d, "events"), alarm=20).withColumn("p95", R("p95"))
