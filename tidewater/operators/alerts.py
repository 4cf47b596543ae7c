"""Alert episodes, reference scenes, delivery matching and field validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.constants import CHLOROPHYLL_MATCH, DEDUPE_DAYS, DOYS, MAX_LAG_DAYS, NTU_MATCH, TSS_MATCH
from tidewater.operators.baseline import circular_distance, nearby_doys
from tidewater.operators.detect import SEVERITIES
from tidewater.operators.geometry import points_in

OPEN = ("open", "investigating")


def rank(severity: Column) -> Column:
    """Ordinal of a severity; null counts as 0."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity), F.lit(0))


def alert_ids(frame: DataFrame) -> DataFrame:
    """``frame`` (zone_id, body_id, first_at, indicator) with alert_id; a second one of a day and zone gets its indicator."""
    base = F.format_string("alr_%s_%d_z%d", F.date_format("first_at", "yyyy_MMdd"), F.col("body_id"), F.col("zone_id"))
    later = F.row_number().over(Window.partitionBy(base).orderBy("indicator", "first_candidate")) > 1
    slug = F.trim(F.regexp_replace(F.lower("indicator"), "[^a-z0-9]+", "_"), F.lit("_"))
    return frame.withColumn("alert_id", F.when(later, F.concat(base, F.lit("_"), slug)).otherwise(base))


def episodes(candidates: DataFrame, *, days: int = DEDUPE_DAYS) -> DataFrame:
    """Alertable candidates with their episode's number per zone and indicator: a new one starts where the last
    alertable observation is more than ``days`` days back."""
    series = Window.partitionBy("zone_id", "indicator").orderBy("observed_at", "candidate_id")
    fresh = F.coalesce(F.datediff("observed_at", F.lag("observed_at").over(series)) > days, F.lit(True))
    return candidates.withColumn("fresh", fresh).withColumn("episode", F.sum(F.col("fresh").cast("long")).over(series.rowsBetween(Window.unboundedPreceding, 0)))


def episode_fields(placed: DataFrame) -> DataFrame:
    """One row per episode: when, how many, the latest priority, the peak priority and severity."""
    last = F.struct("observed_at", "candidate_id")
    return placed.groupBy("zone_id", "indicator", "episode").agg(
        F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.count("*").alias("n_observations"), F.max_by("priority", last).alias("priority"), F.max("priority").alias("peak_priority"),
        F.max(rank(F.col("severity"))).alias("peak_rank"), F.min_by("candidate_id", last).alias("first_candidate"),
    )


def attach_follow_ups(follow_ups: DataFrame, alerts: DataFrame, *, days: int = DEDUPE_DAYS) -> DataFrame:
    """Each follow-up with the alert of its zone that was observed last, not before ``days`` days back; else none.

    There is no upper bound: a late row may attach to a later alert. So the zone's last alert is the only one that can
    be it, and a zone's alerts are one row before they meet its follow-ups.
    """
    last = alerts.groupBy("zone_id").agg(F.max(F.struct("last_at", "indicator", "episode")).alias("a"))
    near = follow_ups.select("candidate_id", "zone_id", "observed_at").join(last, "zone_id").filter(F.col("a.last_at") >= F.date_sub("observed_at", days))
    return near.select("candidate_id", "a.last_at", "a.indicator", "a.episode").distinct()


def timelines(placed: DataFrame) -> DataFrame:
    """Per episode its entries in time, one per candidate."""
    entry = F.struct("observed_at", "candidate_id", "priority")
    return placed.dropDuplicates(["candidate_id"]).groupBy("zone_id", "indicator", "episode").agg(F.array_sort(F.collect_list(entry)).alias("timeline"))


def reference_scene(current: DataFrame, scenes: DataFrame, *, days: int = 45) -> DataFrame:
    """The scene to compare with: more than a day older, of an earlier year's season if there is one, nearest by day of
    the year, then newest. ``current`` and ``scenes`` have (body_id, scene_id, sensed_at).

    Passes never meet all earlier passes of their body. First the nearest day of the year with anything old enough is
    found, from each body's first pass on each day of the year (at most 366 rows a body): among the days of the season, or
    among all days for the few passes without a season before them. Then only the passes of that day, or of the two days
    at that distance, are read for the newest.
    """
    kind = scenes.schema["sensed_at"].dataType
    at = scenes.groupBy("body_id", "sensed_at").agg(F.min("scene_id").alias("scene_id")).withColumn("day", F.dayofyear("sensed_at"))
    first = at.groupBy("body_id", "day").agg(F.min("sensed_at").alias("first_at"))
    now = current.select("body_id", F.col("sensed_at").alias("now")).distinct().withColumn("doy", F.dayofyear("now"))
    now = now.withColumn("earlier", F.expr("now - INTERVAL 1 DAY")).withColumn("before", F.least("earlier", F.date_trunc("year", "now").cast(kind)))
    gap = circular_distance(F.col("doy"), F.col("day"))
    keys = ["body_id", "now", "doy"]
    season = now.withColumn("day", F.explode(nearby_doys(F.col("doy"), days))).join(first, ["body_id", "day"]).filter(F.col("first_at") < F.col("before"))
    season = season.groupBy(*keys, F.col("before").alias("until")).agg(F.min(gap).alias("gap")).withColumn("same_season", F.lit(True))
    rest = now.join(season, keys, "left_anti").join(first, "body_id").filter(F.col("first_at") < F.col("earlier"))
    rest = rest.groupBy(*keys, F.col("earlier").alias("until")).agg(F.min(gap).alias("gap")).withColumn("same_season", F.lit(False))
    day = lambda k: F.pmod(F.col("doy") - 1 + k, F.lit(DOYS)) + 1
    chosen = season.unionByName(rest).withColumn("day", F.explode(F.array_distinct(F.array(day(F.col("gap")), day(-F.col("gap"))))))
    found = chosen.join(at, ["body_id", "day"]).filter(F.col("sensed_at") < F.col("until"))
    best = found.groupBy("body_id", "now", "gap", "same_season").agg(F.max_by("scene_id", "sensed_at").alias("scene_id"), F.max("sensed_at").alias("sensed_at"))
    asked = current.select("body_id", F.col("scene_id").alias("current_id"), F.col("sensed_at").alias("now"))
    return asked.join(best, ["body_id", "now"])


def chosen(alerts: DataFrame, *, status: str = "active", min_severity: str | None = None, min_priority: float = 0, body: int | None = None, district: str | None = None) -> DataFrame:
    """Alerts (status, severity, priority, body_id, district) of a status or group (``active``, ``all``) and the filters."""
    found = alerts
    if status != "all":
        found = found.filter(F.col("status").isin(*(OPEN if status == "active" else (status,))))
    if min_severity is not None:
        found = found.filter(rank(F.col("severity")) >= SEVERITIES.index(min_severity) + 1)
    if min_priority > 0:
        found = found.filter(F.col("priority") >= min_priority)
    if body is not None:
        found = found.filter(F.col("body_id") == body)
    return found if district is None else found.filter(F.col("district") == district)


def feed(alerts: DataFrame, *, ties: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of chosen alerts, highest priority first, then latest; ``total`` is the number of all that were chosen."""
    page = alerts.orderBy(F.desc("priority"), F.desc("last_at"), *ties).offset(offset).limit(limit)
    total = alerts.agg(F.count("*").alias("total"))
    return page.crossJoin(F.broadcast(total))


def payload(alerts: DataFrame, timeline: DataFrame, bodies: DataFrame, centroids: DataFrame) -> DataFrame:
    """One nested row per alert: (alert_id, body, zone, facts, timeline), as an alert is handed out.

    ``bodies`` has (body_id, name, district), ``centroids`` (zone_id, cx, cy); an alert without a body or centroid has
    nulls there.
    """
    keys = ["zone_id", "indicator", "episode"]
    joined = alerts.join(timeline, keys, "left").join(bodies.select("body_id", F.col("name").alias("_name"), "district"), "body_id", "left").join(centroids.select("zone_id", "cx", "cy"), "zone_id", "left")
    body = F.struct("body_id", F.col("_name").alias("name"), "district")
    zone = F.struct("zone_id", F.when(F.col("cx").isNotNull(), F.array(F.round("cx", 6), F.round("cy", 6))).alias("centroid"))
    facts = F.struct("indicator", "first_at", "last_at", "n_observations", "priority", "peak_priority", "peak_rank")
    return joined.select("alert_id", "episode", body.alias("body"), zone.alias("zone"), facts.alias("facts"), F.coalesce("timeline", F.array().cast(joined.schema["timeline"].dataType)).alias("timeline"))


def latest_status(events: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Latest valid status per alert; events of unknown status are left out."""
    return events.filter(F.col("status").isin(*allowed)).groupBy("alert_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.count("*").alias("n_changes"))


def matching_recipients(alerts: DataFrame, recipients: DataFrame, places: DataFrame | None = None, areas: DataFrame | None = None, *, cell: float = 1000.0) -> DataFrame:
    """(alert, recipient) pairs: active, severity at least the recipient's least, and its district, or its area around the
    alert's place, or neither given.

    ``areas`` has recipients' polygons (recipient_id, seq, x, y), ``places`` a point (zone_id, px, py) of each zone. Recipients
    meet alerts by district and, for those without district and area, by a constant; areas meet places, not alerts. All are
    equality joins, and a pair that the district has made is not made again by the area.
    """
    # ranks once a row, not once a pair
    alerts = alerts.withColumn("_rank", rank(F.col("severity")))
    active = recipients.filter("active").drop("active").withColumn("_least", rank(F.col("min_severity")))
    local = active.filter("district IS NOT NULL")
    free = active.filter("district IS NULL")
    if areas is not None:
        free = free.join(areas.select("recipient_id").distinct(), "recipient_id", "left_anti")
    keyed = local.withColumn("k", F.col("district")).unionByName(free.withColumn("k", F.lit("*"))).drop("district")
    severe = F.col("_rank") >= F.col("_least")
    pairs = _dealt(alerts.withColumn("k", F.explode(F.array(F.col("district"), F.lit("*")))), keyed, "k").filter(severe).drop("k")
    if areas is None:
        return pairs.drop("_rank", "_least")
    # a place whose zone has no alert makes no pair, but would meet every area around it
    places = places.join(alerts.select("zone_id").distinct(), "zone_id", "left_semi")
    around = points_in(places.withColumnRenamed("zone_id", "pid"), areas.join(active.select("recipient_id"), "recipient_id", "left_semi"), "recipient_id", cell=cell).withColumnRenamed("pid", "zone_id")
    asked = around.join(active.withColumnRenamed("district", "_d"), "recipient_id")
    more = _dealt(alerts, asked, "zone_id").filter(severe & ~F.coalesce(F.col("_d") == F.col("district"), F.lit(False))).drop("_d")
    return pairs.unionByName(more.select(*pairs.columns)).drop("_rank", "_least")


def _dealt(alerts: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Both joined by ``key``. Keys are few, and bytes too, but pairs are many: the alerts of a key are dealt over as many tasks as
    run at once, twice, each of which gets all that is asked there, in partitions of our own number that nothing merges. What is asked is
    hashed, so the alerts need not be sorted, and a key's pairs are made one after another."""
    spark = alerts.sparkSession
    deals = 2 * spark.sparkContext.defaultParallelism
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * deals)
    left = alerts.withColumn("_s", F.pmod(F.xxhash64(*alerts.columns), F.lit(deals)).cast("long")).repartition(parts, key, "_s")
    right = asked.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long")))).repartition(parts, key, "_s")
    return left.join(right.hint("shuffle_hash"), [key, "_s"]).drop("_s")


def audiences(recipients: DataFrame, places: DataFrame | None = None, areas: DataFrame | None = None, *, cell: float = 1000.0) -> DataFrame:
    """Active recipients (recipient_id) with ``audience``, a digest that those share whom every alert reaches alike, and what
    it is made of: district, ``least`` (rank of the least severity) and ``zones`` whose places lie in the recipient's area
    (sorted; null without an area, empty where no place lies in it)."""
    active = recipients.filter("active").select("recipient_id", "district", rank(F.col("min_severity")).cast("int").alias("least"))
    if areas is None:
        found = active.withColumn("zones", F.lit(None).cast("array<long>"))
    else:
        owners = areas.select("recipient_id").distinct().withColumn("_owner", F.lit(True))
        asked = areas.join(active.select("recipient_id"), "recipient_id", "left_semi")
        around = points_in(places.withColumnRenamed("zone_id", "pid"), asked, "recipient_id", cell=cell)
        zones = around.groupBy("recipient_id").agg(F.sort_array(F.collect_set("pid")).alias("zones"))
        found = active.join(owners, "recipient_id", "left").join(zones, "recipient_id", "left")
        found = found.withColumn("zones", F.when(F.col("_owner"), F.coalesce("zones", F.array().cast(zones.schema["zones"].dataType)))).drop("_owner")
    given = lambda text: F.coalesce(F.concat(F.lit("="), text), F.lit(""))
    text = F.concat(given(F.col("district")), F.lit("|"), F.col("least").cast("string"), F.lit("|"), given(F.array_join("zones", ",")))
    return found.select("recipient_id", F.md5(text).alias("audience"), "district", "least", "zones")


def reached(alerts: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of ``matching_recipients`` by class: alerts of one (zone_id, district, severity) and recipients of one
    audience either all meet or none does. One row per pair of classes that meet, with n_alerts, n_recipients and n_pairs.

    ``members`` is the result of ``audiences``. The rows grow with zones and with the places in areas, not with alerts or
    recipients. Audiences without district and area, at most one for each rank of severity, are broadcast.
    """
    classes = alerts.groupBy("zone_id", "district", "severity").agg(F.count("*").alias("n_alerts"))
    classes = classes.withColumn("_rank", rank(F.col("severity")))
    groups = members.groupBy("audience").agg(*[F.first(c).alias(c) for c in ("district", "least", "zones")], F.count("*").alias("n_recipients"))
    severe = F.col("_rank") >= F.col("least")
    columns = ["zone_id", "district", "severity", "audience", "n_alerts", "n_recipients"]
    home = classes.join(groups.filter("district IS NOT NULL").drop("zones"), "district").filter(severe)
    everywhere = F.broadcast(groups.filter("district IS NULL AND zones IS NULL").drop("district", "zones"))
    around = groups.withColumn("zone_id", F.explode("zones")).withColumnRenamed("district", "_d")
    near = classes.join(around, "zone_id").filter(severe & ~F.coalesce(F.col("_d") == F.col("district"), F.lit(False)))
    met = home.select(*columns).unionAll(classes.join(everywhere, severe).select(*columns)).unionAll(near.select(*columns))
    return met.withColumn("n_pairs", F.col("n_alerts") * F.col("n_recipients"))


def expanded(alerts: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(alert, recipient_id) pairs of the given alerts, such as those since the last dispatch, from ``reached`` and
    ``audiences``. The pairs are made where they are used: alerts with their audiences are dealt over the tasks, and members."""
    met = classes.select(F.col("zone_id").alias("_z"), F.col("district").alias("_d"), F.col("severity").alias("_s"), "audience")
    same = F.col("zone_id").eqNullSafe(F.col("_z")) & F.col("district").eqNullSafe(F.col("_d")) & F.col("severity").eqNullSafe(F.col("_s"))
    asked = alerts.join(met, same).drop("_z", "_d", "_s")
    return _dealt(asked, members.select("audience", "recipient_id"), "audience").drop("audience")


def decision(before: Column, severity: Column, *, enabled: bool = True, manual: bool = False) -> Column:
    """skipped if the switch is off; nothing new if sent before (``before``: the highest rank sent, else null) at this severity
    or above."""
    known = F.coalesce(before >= rank(severity), F.lit(False)) & F.lit(not manual)
    return F.when(F.lit(not enabled), "skipped").when(known, "already sent").otherwise("send")


def send_decisions(pairs: DataFrame, sent: DataFrame, *, enabled: bool = True, manual: bool = False) -> DataFrame:
    """Pairs with their ``decision`` by a log ``sent`` (alert_id, recipient_id, severity), which they meet by equality."""
    before = sent.groupBy("alert_id", "recipient_id").agg(F.max(rank(F.col("severity"))).alias("_r"))
    joined = pairs.join(before, ["alert_id", "recipient_id"], "left")
    return joined.withColumn("decision", decision(F.col("_r"), F.col("severity"), enabled=enabled, manual=manual)).drop("_r")


LAB_FIELDS = {"ndti": ("turbidity", "tss"), "sediment": ("tss", "turbidity"), "ndci": ("chlorophyll",), "fai": ("chlorophyll",)}
THRESHOLDS = {"turbidity": NTU_MATCH, "tss": TSS_MATCH, "chlorophyll": CHLOROPHYLL_MATCH}


def verdict(indicator: Column, observed_on: Column, sampled_on: Column, lab: Column, *, max_lag: int = MAX_LAG_DAYS) -> Column:
    """Struct (verdict, field, value, lag): the first lab value, in the indicator's order of fields, that is a number."""
    lag = F.datediff(sampled_on, observed_on)
    found = F.lit(None).cast("struct<field:string,value:double,least:double>")
    for key, fields in LAB_FIELDS.items():
        options = [F.struct(F.lit(f).alias("field"), F.get(F.array(F.try_element_at(lab, F.lit(f)).try_cast("double")), F.lit(0)).alias("value"), F.lit(THRESHOLDS[f]).alias("least")) for f in fields]
        first = F.coalesce(*[F.when(o["value"].isNotNull(), o) for o in options])
        found = F.when(indicator == key, first).otherwise(found)
    late = F.abs(lag) > max_lag
    said = F.when(late | found["value"].isNull(), "inconclusive").when(found["value"] >= found["least"], "matched").otherwise("not_matched")
    return F.struct(said.alias("verdict"), F.when(~late, found["field"]).alias("field"), F.when(~late, found["value"]).alias("value"), lag.alias("lag"))


def status_of(verdict: Column) -> Column:
    return F.when(verdict == "matched", "validated").when(verdict == "not_matched", "dismissed").otherwise("investigating")


def precision(validations: DataFrame, *groups: str) -> DataFrame:
    """Matched share of the conclusive ones, overall and by each group (grouping sets); null where none is conclusive."""
    sets = validations.groupingSets([[], *[[g] for g in groups]], *groups)
    matched, missed = F.count_if(F.col("verdict") == "matched"), F.count_if(F.col("verdict") == "not_matched")
    return sets.agg(F.count("*").alias("n"), (matched + missed).alias("conclusive"), F.round(F.try_divide(matched, matched + missed), 6).alias("precision"), F.grouping_id().cast("long").alias("level"))
