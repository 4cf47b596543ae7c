"""Fusion, priority and explanation queries (F, X)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import detect as D
from tidewater.operators import fuse as U
from tidewater.plans.bindings import bound, table
from tidewater.plans.registry import query
from tidewater.sources.stored import stored

R = lambda c, n=6: F.round(c, n)

PREV = "pv AS (SELECT *, lag(area_km2) OVER (PARTITION BY zone_id ORDER BY observed_at, candidate_id) AS previous_area FROM candidates)"
GROW = "CASE WHEN area_km2 = 0 AND coalesce(previous_area, 0) = 0 THEN NULL WHEN coalesce(previous_area, 0) = 0 THEN 1.0 ELSE (area_km2 - previous_area) / previous_area END"
RAW = PREV + f""",
rw AS (SELECT *, z AS z_ndti, z * 0.7e0 - 1 AS z_ndci, CASE WHEN votes > 1 THEN z * 0.5e0 END AS z_fai, 3 - z AS z_sediment, area_km2 / (1 + zone_id) AS area_ratio, votes AS n_anomalous, CASE WHEN votes > 0 THEN 0.4e0 + priority / 250 END AS iforest,
  {GROW} AS expansion, (1 + zone_id % 4) / 8 AS zone_ratio, rain_percentile AS rain, valid_pct AS valid FROM pv),
nm AS (SELECT *, """ + ", ".join(
    [f"coalesce(least(greatest({k} / 5, 0), 1), 0) AS f_{k}" for k in U.Z_KEYS]
    + [
        "sqrt(coalesce(least(greatest(area_ratio, 0), 1), 0)) AS f_area_ratio", "CASE n_anomalous WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.8 ELSE 1.0 END AS f_n_anomalous",
        "coalesce(least(greatest((iforest - 0.45) / 0.25, 0), 1), 0) AS f_iforest", "coalesce(least(greatest(expansion, 0), 1), 0) AS f_expansion", "coalesce(least(greatest(zone_ratio, 0), 1), 0) AS f_zone_ratio",
        "coalesce(least(greatest((rain - 0.5) / 0.5, 0), 1), 0) AS f_rain", "coalesce(least(greatest(valid / 100, 0), 1), 0) AS f_valid",
    ]
) + " FROM rw),\nsm AS (SELECT *, " + " + ".join(f"f_{k} * {w}" for k, w in U.WEIGHTS.items()) + " AS t, " + " + ".join(f"greatest(f_{k} * {w}, 0)" for k, w in U.WEIGHTS.items()) + " AS p, " + " + ".join(f"least(f_{k} * {w}, 0)" for k, w in U.WEIGHTS.items()) + """ AS n FROM nm),
sc AS (SELECT *, least(greatest(t, 0), 100) AS score, CASE WHEN t > 100 AND p > 0 THEN (100 - n) / p ELSE 1 END AS u, CASE WHEN t < 0 AND n < 0 THEN p / -n ELSE 1 END AS d FROM sm),
cn AS (SELECT *, """ + ", ".join(f"f_{k} * {w} * CASE WHEN f_{k} * {w} > 0 THEN u ELSE d END AS c_{k}" for k, w in U.WEIGHTS.items()) + " FROM sc)"


def features(spark, d) -> DataFrame:
    """Candidates with raw features and their normalised forms f_*."""
    c = U.previous_area(bound(spark, d, "candidates"))
    z, votes, zone = F.col("z"), F.col("votes"), F.col("zone_id")
    raw = {
        "z_ndti": z, "z_ndci": z * 0.7 - 1, "z_fai": F.when(votes > 1, z * 0.5), "z_sediment": 3 - z, "area_ratio": F.col("area_km2") / (1 + zone), "n_anomalous": votes, "iforest": F.when(votes > 0, 0.4 + F.col("priority") / 250),
        "expansion": U.expansion(F.col("area_km2"), F.col("previous_area")), "zone_ratio": (1 + zone % 4) / 8, "rain": F.col("rain_percentile"), "valid": F.col("valid_pct"),
    }
    return c.withColumns({f"f_{k}": v for k, v in U.normalised(raw).items()})


def scored(spark, d) -> DataFrame:
    return U.weighted_score(features(spark, d))


@query("F1_previous_area", PREV + "\n---\nSELECT candidate_id, previous_area FROM pv", uses=("candidates",))
def f1(spark, d):
    return U.previous_area(bound(spark, d, "candidates")).select("candidate_id", "previous_area")


@query("F2_spatial_expansion", PREV + f"\n---\nSELECT candidate_id, round({GROW}, 6) AS expansion FROM pv", uses=("candidates",))
def f2(spark, d):
    return U.previous_area(bound(spark, d, "candidates")).select("candidate_id", R(U.expansion(F.col("area_km2"), F.col("previous_area"))).alias("expansion"))


@query("F3_feature_vector", RAW + "\n---\nSELECT candidate_id, " + ", ".join(f"round(f_{k}, 6) AS f_{k}" for k in U.WEIGHTS) + " FROM nm", uses=("candidates",))
def f3(spark, d):
    return features(spark, d).select("candidate_id", *[R(F.col(f"f_{k}").cast("double")).alias(f"f_{k}") for k in U.WEIGHTS])


@query("F4_weighted_score", RAW + "\n---\nSELECT candidate_id, round(score, 6) AS score, " + ", ".join(f"round(c_{k} + 0.0, 6) AS c_{k}" for k in U.WEIGHTS) + " FROM cn", uses=("candidates",))
def f4(spark, d):
    return scored(spark, d).select("candidate_id", R("score").alias("score"), *[R(F.col(f"c_{k}") + 0.0).alias(f"c_{k}") for k in U.WEIGHTS])


@query("F5_score_bands", RAW + "\n---\nSELECT candidate_id, CASE WHEN votes > 0 THEN CASE WHEN rain_percentile > 0.9 AND score >= 70 THEN 'medium' WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END END AS severity FROM cn", uses=("candidates",))
def f5(spark, d):
    severity, _ = D.cap_severity(U.score_band(F.col("score"), F.col("votes")), F.col("rain_percentile") > 0.9)
    return scored(spark, d).select("candidate_id", severity.alias("severity"))


@query("F6_confidence", "SELECT candidate_id, round(sqrt(least(greatest(valid_pct / 100, 0), 1)) * (0.5 * least((candidate_id % 40) / 15, 1) + 0.5 * (0.4 + 0.2 * least(votes, 3))), 6) AS confidence FROM candidates", uses=("candidates",))
def f6(spark, d):
    return bound(spark, d, "candidates").select("candidate_id", R(U.confidence(F.col("valid_pct"), F.col("candidate_id") % 40, F.col("votes"))).alias("confidence"))


@query("F7_primary_indicator", "r AS (SELECT candidate_id, unnest([z, z * 0.7e0 - 1, 3 - z]) AS z, unnest([0, 1, 2]) AS o FROM candidates)\n---\nSELECT candidate_id, arg_max(o, (z, -o)) FILTER (z > 3) AS flagged, coalesce(arg_max(o, (z, -o)) FILTER (z > 3), arg_max(o, (z, -o)) FILTER (z > 0)) AS primary_indicator FROM r GROUP BY 1", uses=("candidates",))
def f7(spark, d):
    zs = [F.col("z"), F.col("z") * 0.7 - 1, 3 - F.col("z")]
    best = lambda least: F.array_max(F.filter(F.array(*[F.struct(v.alias("z"), F.lit(-i).alias("o")) for i, v in enumerate(zs)]), lambda x: x["z"] > least))["o"] * -1
    return bound(spark, d, "candidates").select("candidate_id", best(3).alias("flagged"), F.coalesce(best(3), best(0)).alias("primary_indicator"))


def examples(spark, d) -> DataFrame:
    """Scored candidates with the target that their field validation gives them; inconclusive ones have none."""
    from tidewater.plans.alerting import verdicts

    said = verdicts(spark, d).filter("verdict <> 'inconclusive'").select("candidate_id", F.when(F.col("verdict") == "matched", 90.0).otherwise(10.0).alias("target"))
    return scored(spark, d).join(said, "candidate_id")


NAMES = [f"f_{k}" for k in U.WEIGHTS]


_FITTED: dict[tuple, object] = {}


def fitted(spark, d):
    """The learned model of a folder's examples, fitted once in a session."""
    from tidewater.operators.learned import fit_priority

    key = (spark.sparkContext.applicationId, d)
    if key not in _FITTED:
        _FITTED[key] = fit_priority(stored(examples(spark, d), "examples"), NAMES)
    return _FITTED[key]


@query("F8_learned_priority_model")
def f8(spark, d):
    return fitted(spark, d).metrics


@query("F9_additive_attribution")
def f9(spark, d):
    from tidewater.operators.learned import attribute

    parts = attribute(fitted(spark, d), scored(spark, d), NAMES, "candidate_id")
    return parts.select("candidate_id", R("prediction", 4).alias("prediction"), R("base", 4).alias("base"), *[R(c, 4).alias(c) for c in parts.columns if c.startswith("a_")])


@query("V7_guarded_retrain")
def v7(spark, d):
    from tidewater.operators.learned import guarded_retrain

    return guarded_retrain(stored(examples(spark, d), "examples"), NAMES)


@query("F10_active_model", "m AS (SELECT p_brand AS version, max(p_partkey) AS seen_at, count(*) FILTER (p_size > 45) > 0 AS ok FROM part GROUP BY 1)\n---\nSELECT version, version = coalesce((SELECT arg_max(version, seen_at) FROM m WHERE ok), 'weighted') AS active FROM m UNION ALL SELECT 'weighted', NOT EXISTS (SELECT 1 FROM m WHERE ok)")
def f10(spark, d):
    m = table(spark, d, "part").groupBy(F.col("p_brand").alias("version")).agg(F.max("p_partkey").alias("at"), (F.count_if(F.col("p_size") > 45) > 0).alias("ok"))
    chosen = m.filter("ok").agg(F.max_by("version", "at").alias("chosen"))
    every = m.select("version").unionAll(spark.range(1).select(F.lit("weighted")))
    return every.crossJoin(F.broadcast(chosen)).select("version", (F.col("version") == F.coalesce("chosen", F.lit("weighted"))).alias("active"))


@query("X1_contributions", RAW + """,
q AS (SELECT candidate_id, greatest(c_z_ndti, c_z_ndci, c_z_fai, c_z_sediment) AS top, c_z_ndti + c_z_ndci + c_z_fai + c_z_sediment + c_n_anomalous + c_iforest AS cor, c_area_ratio + c_expansion + c_zone_ratio + c_valid AS ext, c_rain AS rn, score FROM cn)
---
SELECT candidate_id, round(top / 100, 6) AS primary_value, round((cor - top) / 100, 6) AS corroboration, round(ext / 100, 6) AS extent, round(rn / 100 + 0.0, 6) AS rain, round(score / 100, 9) AS total FROM q""", uses=("candidates",))
def x1(spark, d):
    r = U.contributions(scored(spark, d)).withColumn("m", F.map_from_entries("factors"))
    take = lambda k: R(F.col("m")[k] + 0.0)
    return r.select("candidate_id", take("primary").alias("primary_value"), take("corroboration").alias("corroboration"), take("extent").alias("extent"), take("rain").alias("rain"), R(F.aggregate("factors", F.lit(0.0), lambda a, f: a + f["value"]), 9).alias("total"))


PHRASE = "CASE WHEN priority > 0 AND valid_pct > 1e-3 THEN printf('%.1fx its seasonal baseline', priority * 1.0001234e0 / valid_pct) ELSE printf('%.1f standard deviations %s its seasonal baseline', abs(z * 1.0001234e0), CASE WHEN z >= 0 THEN 'above' ELSE 'below' END) END"


def phrase():
    return U.multiple_phrase(F.when(F.col("priority") > 0, F.col("priority") * 1.0001234), F.col("valid_pct").cast("double"), F.col("z") * 1.0001234)


@query("X2_multiple_phrase", f"SELECT candidate_id, {PHRASE} AS phrase FROM candidates", uses=("candidates",))
def x2(spark, d):
    return bound(spark, d, "candidates").select("candidate_id", phrase().alias("phrase"))


@query("X3_summary", f"""e AS (SELECT *, list_concat(list_concat(CASE WHEN votes > 0 THEN ['a second indicator'] ELSE [] END, CASE WHEN votes > 1 THEN ['a distinct patch'] ELSE [] END), CASE WHEN votes > 2 THEN ['an unusual combination'] ELSE [] END) AS ev, 'zone ' || zone_id AS zn, {PHRASE} AS ph FROM candidates)
---
SELECT candidate_id, CASE WHEN z > 3 THEN 'Flagged because ' || indicator || ' is ' || ph || ' ' || CASE WHEN area_km2 > 0 THEN printf('across %.2f km2 of %s', area_km2, zn) ELSE printf('across the %.2f km2 %s', valid_pct * 0.1000123e0, zn) END
|| CASE WHEN len(ev) > 1 THEN ', with ' || array_to_string(ev[1:len(ev) - 1], ', ') || ' and ' || ev[len(ev)] WHEN len(ev) = 1 THEN ', with ' || ev[1] ELSE ', with nothing else out of line' END || '.'
|| CASE WHEN rain_percentile > 0.9 AND candidate_id % 3 > 0 THEN printf(' Heavy rain in the 72 h before (%.0f mm, above the season''s 90th percentile of %.0f mm) makes runoff the likely cause; the severity is capped and the score discounted.', rain_percentile * 40.01e0, 36.01e0) WHEN rain_percentile > 0.9 THEN printf(' Heavy rain in the 72 h before (%.0f mm) makes runoff the likely cause; the severity is capped and the score discounted.', rain_percentile * 40.01e0) WHEN rain_percentile > 0 THEN printf(' Rain in the 72 h before: %.0f mm.', rain_percentile * 40.01e0) ELSE '' END
WHEN state = 'P' THEN 'No verdict for ' || zn || ': its baseline is still building.' ELSE 'Nothing out of season was observed in ' || zn || '.' END AS summary FROM e""", uses=("candidates",))
def x3(spark, d):
    evidence = F.filter(F.array(F.when(F.col("votes") > 0, F.lit("a second indicator")), F.when(F.col("votes") > 1, F.lit("a distinct patch")), F.when(F.col("votes") > 2, F.lit("an unusual combination"))), lambda x: x.isNotNull())
    zone = F.concat(F.lit("zone "), F.col("zone_id").cast("string"))
    status = F.when(F.col("state") == "P", "building").otherwise("usable")
    p90 = F.when(F.col("candidate_id") % 3 > 0, 36.01)
    text = U.summary(F.col("indicator"), phrase(), F.col("area_km2").cast("double"), F.col("valid_pct") * 0.1000123, zone, evidence, F.col("rain_percentile") * 40.01, p90, F.col("rain_percentile") > 0.9, F.col("z") > 3, status)
    return bound(spark, d, "candidates").select("candidate_id", text.alias("summary"))


STEMS = ("pollut", "contamin", "illegal", "toxic", "guilt", "crimin")


@query("X4_wording_guard", f"SELECT doc_id, coalesce(regexp_matches(lower(text), '{'|'.join(STEMS)}'), false) AS unsafe FROM documents")
def x4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(U.unsafe_wording(F.col("text"), STEMS), F.lit(False)).alias("unsafe"))


@query("X5_indicator_rows", "SELECT candidate_id, indicator, round(z, 4) AS z, round(CASE WHEN abs(valid_pct) > 1e-6 THEN 100 * (priority - valid_pct) / valid_pct END, 6) AS deviation_pct FROM candidates", uses=("candidates",))
def x5(spark, d):
    deviation = F.when(F.abs("valid_pct") > 1e-6, F.try_divide(100 * (F.col("priority") - F.col("valid_pct")), F.col("valid_pct").cast("double")))
    return bound(spark, d, "candidates").select("candidate_id", "indicator", R("z", 4).alias("z"), R(deviation).alias("deviation_pct"))
