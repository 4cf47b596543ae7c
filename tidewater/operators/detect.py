"""Anomaly detection: temporal scores, hot pixels and clusters, votes and the rainfall gate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.constants import DEFAULT_FLOOR, DOYS, GATE_MIN_HISTORY, Z_FLAG, Z_HIGH
from tidewater.operators.baseline import robust, robust_z
from tidewater.operators.geometry import spread

SEVERITIES = ("low", "medium", "high")


def temporal_scores(seen: DataFrame, *, threshold: float = Z_FLAG, floor: float = DEFAULT_FLOOR) -> DataFrame:
    """Readings with their baseline: z, flag, direction, and the reason where there is no z.

    A flag needs more than the threshold, and a direction is given to flags only.
    """
    reason = F.when(F.col("mean").isNull(), "no value").when(F.col("status") != "usable", F.concat(F.lit("baseline "), F.col("status")))
    z = F.when(reason.isNull(), robust_z(F.col("mean"), F.col("median"), F.col("sigma"), floor))
    flag = F.coalesce(F.abs(z) > threshold, F.lit(False))
    return seen.withColumn("z", z).withColumn("reason", reason).withColumn("flagged", flag).withColumn("direction", F.when(flag, F.when(z > 0, "high").otherwise("low")))


def temporal_rollup(scored: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """Per key: flagged indicators in registry order, largest |z|, whether any baseline is usable."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("indicator"))
    flagged = F.array_sort(F.collect_set(F.when(F.col("flagged"), F.struct(place.alias("p"), F.col("indicator").alias("i")))))
    return scored.groupBy(*keys).agg(
        F.array_join(F.transform(flagged, lambda x: x["i"]), ",").alias("anomalous"), F.max(F.abs("z")).alias("max_abs_z"), F.bool_or(F.col("status") == "usable").alias("any_usable")
    )


def scene_z(pixels: DataFrame, value: str, keys: list[str], *, floor: float = DEFAULT_FLOOR) -> DataFrame:
    """Pixels with z against their own scene's median and MAD; null where there are fewer than two."""
    stats = robust(pixels, keys, value).select(*keys, "median", "sigma", "n_samples")
    z = F.when(F.col("n_samples") >= 2, robust_z(F.col(value), F.col("median"), F.col("sigma"), floor))
    return pixels.join(stats, keys).withColumn("z", z).drop("median", "sigma", "n_samples")


def hot_gate(pixels: DataFrame, keys: list[str], *, threshold: float = Z_FLAG, min_hot: int = 10, most_share: float = 0.3, most_pixels: int = 200_000) -> DataFrame:
    """Per scene: pixels, hot ones, whether clustering runs and why not; few hot pixels need no reason."""
    counts = pixels.groupBy(*keys).agg(F.count("z").alias("n_pixels"), F.count_if(F.col("z") > threshold).alias("n_hot"))
    share = F.try_divide(F.col("n_hot"), F.col("n_pixels"))
    reason = F.when(F.col("n_pixels") == 0, "no water").when(F.col("n_hot") < min_hot, None).when(share > most_share, "shift of the whole body").when(F.col("n_hot") > most_pixels, "too many hot pixels")
    runs = (F.col("n_pixels") > 0) & (F.col("n_hot") >= min_hot) & (share <= most_share) & (F.col("n_hot") <= most_pixels)
    return counts.withColumn("reason", reason).withColumn("clustered", F.coalesce(runs, F.lit(False)))


def vote_severity(votes: Column, max_abs_z: Column, *, high: float = Z_HIGH) -> Column:
    """Three votes: high; two: high from |z| of ``high``, else medium; one: medium from there, else low; none: null."""
    strong = F.coalesce(max_abs_z >= high, F.lit(False))
    return F.when(votes >= 3, "high").when(votes == 2, F.when(strong, "high").otherwise("medium")).when(votes == 1, F.when(strong, "medium").otherwise("low"))


def rainfall_gate(anomalous: Column, rain_72h: Column, p90: Column, n_history: Column, runoff: tuple[str, ...], *, min_history: int = GATE_MIN_HISTORY) -> Column:
    """Struct (outcome, applied): runoff explains the anomaly if rain passes its seasonal p90 and only runoff indicators
    are anomalous. Outcomes in order: no anomaly, no rainfall, thin history, applied, other indicators, within p90."""
    others = F.size(F.array_except(anomalous, F.array(*[F.lit(x) for x in runoff]))) > 0
    over = rain_72h > p90
    outcome = (
        F.when(F.size(anomalous) == 0, "no anomaly").when(rain_72h.isNull(), "no rainfall").when(F.coalesce(n_history, F.lit(0)) < min_history, "thin history").when(over & ~others, "applied").when(over, "other indicators").otherwise("within p90")
    )
    return F.struct(outcome.alias("outcome"), (outcome == "applied").alias("applied"))


def cap_severity(severity: Column, natural: Column) -> tuple[Column, Column]:
    """Severity capped at medium where a natural cause is likely, and what it was capped from."""
    capped = natural & (severity == "high")
    return F.when(capped, "medium").otherwise(severity), F.when(capped, severity)


def zone_verdict(passes: DataFrame, *, runoff: tuple[str, ...]) -> DataFrame:
    """Verdict on each zone's pass: the three detectors' votes, the rainfall gate and the severity.

    ``passes`` has anomalous (array, in registered order), max_abs_z, any_usable, spatial (array of (indicator, area_km2),
    null or empty: no cluster), multivariate (boolean), mm_72h, p90 and n. The gate is asked about the indicators that
    deviate in time, else about those with a cluster. Rain as the likely cause caps the severity and suppresses nothing; a
    pass without votes, or with a building baseline, makes no alert.
    """
    found = F.coalesce(F.size("spatial"), F.lit(0)) > 0
    temporal, many = F.size("anomalous") > 0, F.coalesce("multivariate", F.lit(False))
    votes = sum((c.cast("long") for c in (temporal, found, many)), F.lit(0).cast("long"))
    asked = F.when(temporal, F.col("anomalous")).when(found, F.array_sort(F.array_distinct(F.transform("spatial", lambda c: c["indicator"])))).otherwise(F.array().cast("array<string>"))
    v = passes.withColumn("votes", votes).withColumn("gate_input", asked)
    v = v.withColumn("_g", rainfall_gate(F.col("gate_input"), F.col("mm_72h"), F.col("p90"), F.col("n"), runoff)).withColumn("outcome", F.col("_g.outcome")).withColumn("natural_cause_likely", F.col("_g.applied"))
    severity, capped = cap_severity(vote_severity(F.col("votes"), F.col("max_abs_z")), F.col("natural_cause_likely"))
    suppressed = F.when(F.col("votes") == 0, "no detector voted").when(~F.coalesce("any_usable", F.lit(False)), "baseline building")
    area = F.when(found, F.round(F.aggregate("spatial", F.lit(0.0), lambda a, c: a + c["area_km2"]), 4))
    v = v.withColumn("severity", severity).withColumn("capped_from", capped).withColumn("suppressed_reason", suppressed).withColumn("affected_area_km2", area)
    return v.withColumn("alertable", F.col("suppressed_reason").isNull()).drop("_g")


def geometry_kind(has_plume: Column, has_localised: Column) -> Column:
    return F.when(has_plume, "plume").when(has_localised, "localised").otherwise("zone")


def scene_features(obs: DataFrame, rain: DataFrame, indicators: tuple[str, ...]) -> DataFrame:
    """Per zone and time: one column per indicator, first known water fraction, rain of the body's day."""
    wide = obs.groupBy("zone_id", "body_id", "observed_at").pivot("indicator", list(indicators)).agg(F.avg("mean"))
    water = obs.groupBy("zone_id", "observed_at").agg(F.min("water_fraction_pct").alias("water_fraction_pct"))
    joined = wide.join(water, ["zone_id", "observed_at"]).withColumn("date", F.to_date("observed_at"))
    return joined.join(rain, ["body_id", "date"], "left")


def impute(frame: DataFrame, keys: list[str], features: tuple[str, ...]) -> DataFrame:
    """Nulls filled with the feature's median over the key (0 where all are null), and the names of those filled."""
    medians = frame.groupBy(*keys).agg(*[F.coalesce(F.percentile(c, 0.5), F.lit(0.0)).alias(f"_m_{c}") for c in features])
    joined = frame.join(medians, keys)
    names = F.array_join(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in features]), ",")
    filled = joined.withColumn("imputed", names)
    for c in features:
        filled = filled.withColumn(c, F.coalesce(c, f"_m_{c}"))
    return filled.drop(*[f"_m_{c}" for c in features])


def json_safe(c: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def localised(points: DataFrame, *, indicators: tuple[str, ...], top_share: float = 0.05, z_floor: float = 1.0, eps: float = 3, min_points: int = 10, pixel_km2: float = 1e-4, min_area_km2: float = 0.01, most: int = 3, among: int = 12, spread: float = 40, floor: float = DEFAULT_FLOOR) -> DataFrame:
    """Where inside a zone an indicator is worst: compact hot patches against the zone's own water.

    ``points`` has (scene_id, zone_id, indicator, row, col, value). Hot are the pixels above the zone's 1 - ``top_share``
    quantile of z, and never at or below ``z_floor``. Of the clusters with enough area, the largest is the anchor; of the
    first ``among`` by area, up to ``most`` whose centres are within ``spread`` pixels of the anchor's stay. One indicator
    is kept for a zone, that with the largest anchor, the first in ``indicators`` of several.
    """
    from tidewater.operators.pixels import dbscan

    keys = ["scene_id", "zone_id", "indicator"]
    z = scene_z(points, "value", keys, floor=floor)
    cut = z.groupBy(*keys).agg(F.greatest(F.percentile("z", 1 - top_share), F.lit(z_floor)).alias("cut"), F.count("z").alias("n_z")).filter(F.col("n_z") >= min_points)
    hot = z.join(cut, keys).filter(F.col("z") > F.col("cut")).withColumn("key", F.to_json(F.struct(*keys)))
    placed = dbscan(hot.select("key", "row", "col"), "key", eps=eps, min_points=min_points).select("key", "row", "col", "cluster").join(hot, ["key", "row", "col"])
    found = placed.groupBy(*keys, "cluster").agg(F.count("*").alias("n_pixels"), F.avg("z").alias("mean_z"), F.max("z").alias("max_z"), F.avg("row").alias("_r"), F.avg("col").alias("_c"))
    found = found.withColumn("area_km2", F.col("n_pixels") * pixel_km2).filter(F.col("area_km2") >= min_area_km2)
    by_area = Window.partitionBy(*keys).orderBy(F.desc("n_pixels"), "cluster")
    found = found.withColumn("_rank", F.row_number().over(by_area))
    anchor = F.first(F.struct("_r", "_c", "n_pixels")).over(by_area)
    found = found.withColumn("_anchor", anchor).filter((F.col("_rank") <= among) & (F.hypot(F.col("_r") - F.col("_anchor._r"), F.col("_c") - F.col("_anchor._c")) <= spread))
    found = found.withColumn("_rank", F.row_number().over(by_area)).filter(F.col("_rank") <= most)
    place = F.array_position(F.array(*[F.lit(x) for x in indicators]), F.col("indicator"))
    best = F.row_number().over(Window.partitionBy("scene_id", "zone_id").orderBy(F.desc("_anchor.n_pixels"), place, "_rank"))
    winner = found.withColumn("_best", best).filter("_best = 1").select("scene_id", "zone_id", "indicator")
    return found.join(winner, keys).select(*keys, "cluster", "n_pixels", "area_km2", "mean_z", "max_z")


#: Numbers of a matrix of passes that one step of ``extent_deltas`` works on.
CELLS = 1 << 20


def extent_deltas(water: DataFrame, *, window_days: int = 30) -> DataFrame:
    """(zone_id, observed_at, delta, n) for each different (observed_at, v) of a zone that has earlier readings near its day of the
    year: v less their median, and their number. ``water`` has zone_id, observed_at, doy and v.

    A zone's readings (some a pass, some thousands in a decade) are one task's group and cross the exchange once.
    """
    half = window_days // 2

    def each(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        value = np.asarray(table.column("v").fill_null(np.nan))
        known = np.asarray(table.column("v").is_valid())
        at, doy = (np.asarray(table.column(c).cast(pa.int64())) for c in ("observed_at", "doy"))
        order = np.lexsort((value, ~known))  # numbers in order, then those that are missing
        value, known, at, doy = value[order], known[order], at[order], doy[order]
        _, asked = np.unique(np.stack((at, np.where(known, value, 0).view(np.int64), known)), axis=1, return_index=True)
        delta, n = np.full(len(asked), np.nan), np.zeros(len(asked), np.int64)
        some = np.zeros(len(asked), bool)
        step = max(1, CELLS // max(1, len(value)))
        for k in range(0, len(asked), step):
            rows = asked[k : k + step]
            apart = np.abs(doy[rows][:, None] - doy[None, :])
            near = (at[None, :] < at[rows][:, None]) & (np.minimum(apart, DOYS - apart) <= half)
            n[k : k + step] = near.sum(1)
            upto = np.cumsum(near & known, axis=1, dtype=np.int32)
            c = upto[:, -1]
            low, high = ((upto > x[:, None]).argmax(1) for x in ((c - 1) // 2, c // 2))
            delta[k : k + step] = value[rows] - (0.5 * value[low] + 0.5 * value[high])
            some[k : k + step] = (c > 0) & known[rows]
        made = n > 0
        times = table.column("observed_at").take(pa.array(order[asked][made]))
        return pa.table({"zone_id": pa.array([key[0].as_py()] * int(made.sum()), key[0].type), "observed_at": times, "delta": pa.array(delta[made], pa.float64(), mask=~some[made]), "n": pa.array(n[made])})

    zone, at = (water.schema[c].dataType.simpleString() for c in ("zone_id", "observed_at"))
    rows = water.filter("zone_id IS NOT NULL AND observed_at IS NOT NULL").select("zone_id", "observed_at", F.col("doy").cast("long").alias("doy"), F.col("v").cast("double").alias("v"))
    return spread(rows, "zone_id").groupBy("zone_id").applyInArrow(each, f"zone_id {zone}, observed_at {at}, delta double, n long")
