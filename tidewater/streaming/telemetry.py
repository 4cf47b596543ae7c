"""Telemetry as DataFrame transformations that run on batch and streaming frames alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weekly(events: DataFrame, *, late: str = "90 days") -> DataFrame:
    """Count and sum per label and week from Monday; on a stream, weeks stay open for ``late``."""
    week = F.window("ts", "7 days", "7 days", "4 days")
    return events.withWatermark("ts", late).groupBy("event_type", week.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("week"), "n", "total")


def once(events: DataFrame, keys: list[str], *, late: str = "14 days") -> DataFrame:
    """Each key once, however often it is delivered within ``late`` (streaming frames)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def flatten(events: DataFrame, *, properties: str = "props") -> DataFrame:
    """JSON payloads as columns, with defaults for what is missing."""
    p = F.from_json(properties, "k long, device string, timestamp_ms long")
    at = F.when(p["timestamp_ms"] > 0, F.timestamp_millis(p["timestamp_ms"]))
    return events.withColumns({"k": F.coalesce(p["k"], F.lit(0)), "device": F.coalesce(p["device"], F.lit("unknown")), "sent_at": at})


# The bands' bounds and words below are fixed values.


def turbidity_band(ntu: Column, unit: Column) -> Column:
    """Turbidity in words; empty for a unit that is not NTU (none given counts as NTU), as a percentage is no NTU."""
    known = F.upper(F.trim(F.coalesce(unit, F.lit("NTU")))).isin("NTU", "")
    words = F.when(ntu < 1, "very clear").when(ntu < 5, "clear").when(ntu < 50, "slightly turbid").when(ntu < 200, "turbid").otherwise("very turbid")
    return F.when(known, words).otherwise("")


def tds_band(ppm: Column) -> Column:
    """Dissolved solids in words."""
    return (
        F.when(ppm < 50, "very low mineral content").when(ppm < 300, "fresh, low mineralisation").when(ppm < 600, "good — typical freshwater")
        .when(ppm < 900, "fair — noticeably mineralised").when(ppm < 1200, "poor — high dissolved solids").otherwise("very high — brackish")
    )


def signal_band(rssi: Column) -> Column:
    """Signal strength (dBm) in words."""
    return F.when(rssi >= -60, "strong").when(rssi >= -70, "good").when(rssi >= -80, "weak").otherwise("very weak")


#: Card labels of the device page and the keys of its JSON contract; fixed values.
LABEL_KEYS = {"TURBIDITY": "turbidity", "TDS": "tds", "TEMPERATURE": "temperature", "TEMP": "temperature", "PH": "ph"}


def visible(fragment: Column) -> Column:
    """Text of a fragment of HTML: tags and runs of white space are one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(fragment, "<[^>]+>", " "), r"\s+", " "))


def bound_to(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def divisions(body: Column) -> Column:
    """The page cut at its div tags: array of (kind, text), the class in lower case and what is visible up to the end tag."""
    opened = F.slice(F.split(body, "(?i)<div(?=[\\s>])"), 2, 1 << 30)

    def one(piece: Column) -> Column:
        halves = F.split(piece, ">", 2)
        tag, shown = F.lower(F.translate(halves[0], "'", '"')), F.split(F.get(halves, F.lit(1)), "(?i)</div", 2)[0]
        named = F.get(F.split(tag, 'class="', 2), F.lit(1))
        return F.struct(F.trim(F.substring_index(named, '"', 1)).alias("kind"), shown.alias("raw"))

    cards = F.filter(F.transform(opened, one), lambda d: d["kind"].isin("label", "value", "status"))
    return F.transform(cards, lambda d: F.struct(d["kind"].alias("kind"), visible(d["raw"]).alias("text")))


def leading_number(text: Column) -> Column:
    """Struct (value, rest): the first number in a text, and what follows it. A number is digits from the first one on, with one
    point that digits follow, and a minus sign right before them."""
    figures = F.lit("0123456789")
    run = lambda c: F.substring(c, F.lit(1), F.length(c) - F.length(F.ltrim(c, figures)))
    begin = F.struct(text.alias("text"), F.regexp_replace(text, "^[^0-9]+", "").alias("rest"))
    whole = bound_to(begin, lambda b: F.struct(F.substring(b["text"], F.length(b["text"]) - F.length(b["rest"]), F.lit(1)).alias("before"), (F.length(b["text"]) > F.length(b["rest"])).alias("some"), b["rest"].alias("rest"), run(b["rest"]).alias("whole")))
    part = bound_to(whole, lambda w: F.struct(F.when(w["some"] & (w["before"] == "-"), -1.0).otherwise(1.0).alias("sign"), w["rest"].alias("rest"), w["whole"].alias("whole"), F.when(F.substring(w["rest"], F.length(w["whole"]) + 1, F.lit(1)) == ".", run(F.substring(w["rest"], F.length(w["whole"]) + 2, F.length(w["rest"])))).otherwise("").alias("part")))
    said = bound_to(part, lambda p: F.struct(p["sign"].alias("sign"), p["rest"].alias("rest"), F.when(p["part"] != "", F.concat_ws(".", p["whole"], p["part"])).otherwise(p["whole"]).alias("said")))
    return bound_to(said, lambda s: F.struct((s["sign"] * s["said"].try_cast("double")).alias("value"), F.trim(F.substring(s["rest"], F.length(s["said"]) + 1, F.length(s["rest"]))).alias("rest")))


def device_readings(pages: DataFrame, *, body: str = "body", device: str = "device page") -> DataFrame:
    """``pages`` with what a device answered: ``readings`` (array of key, value, unit; of a repeated key the last),
    ``device_status``, ``device``, ``source`` (html or json), and ``payload``, a JSON answer as it stands.

    On a page, a value that follows a label is a card; its first number counts, what follows it is the unit, as it stands.
    Known labels have the contract's keys, others their own name in lower case with underscores. Cards without label or
    number are left out; a page without any reading, and an answer that is neither a page nor a JSON object, has nulls. A JSON
    object is passed on: its entries that are objects with a number as value are readings, its device, source and
    device_status are its own. Units are never converted.
    """
    key = F.create_map(*[F.lit(x) for pair in LABEL_KEYS.items() for x in pair])
    text = F.trim(F.col(body), F.lit(" \t\r\n"))

    def paired(d: Column, following: Column) -> Column:
        right = (d["kind"] == "label") & (following["kind"] == "value") & (d["text"] != "")
        return F.when(right, F.struct(F.upper(d["text"]).alias("name"), leading_number(following["text"]).alias("number")))

    def reading(c: Column) -> Column:
        named = F.coalesce(F.try_element_at(key, c["name"]), F.translate(F.lower(c["name"]), " ", "_"))
        return F.struct(named.alias("key"), c["number"]["value"].alias("value"), F.nullif(c["number"]["rest"], F.lit("")).alias("unit"))

    def entry(e: Column) -> Column:
        held = F.when(e["value"].startswith("{"), e["value"])
        return F.struct(e["key"].alias("key"), F.get_json_object(held, "$.value").try_cast("double").alias("value"), F.get_json_object(held, "$.unit").alias("unit"))

    def latest(rows: Column) -> Column:
        return F.filter(rows, lambda c, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda later: later["key"] == c["key"]))

    def read(divs: Column) -> Column:
        cards = F.filter(divs, lambda d: d["kind"] != "status")
        pairs = bound_to(cards, lambda c: F.zip_with(c, F.slice(c, 2, 1 << 30), paired))
        found = F.transform(F.filter(F.array_compact(pairs), lambda c: c["number"]["value"].isNotNull()), reading)
        return F.struct(bound_to(found, latest).alias("readings"), F.get(F.filter(divs, lambda d: d["kind"] == "status"), F.lit(0))["text"].alias("status"))

    def status(said: Column) -> Column:
        own = F.trim(F.regexp_replace(said, "^[^:]*:", ""))
        return F.nullif(F.when(F.lower(F.trim(F.substring_index(said, ":", 1))) == "status", own).otherwise(said), F.lit(""))

    is_json = F.substring(text, 1, 1).isin("{", "[")
    found = pages.withColumns({"_page": F.when(~is_json, bound_to(divisions(F.col(body)), read)), "_json": F.when(is_json & F.from_json(text, "map<string, string>").isNotNull() & text.startswith("{"), text)})
    own = F.filter(F.transform(F.map_entries(F.from_json("_json", "map<string, string>")), entry), lambda r: r["value"].isNotNull())
    page, given = F.coalesce(F.size("_page.readings"), F.lit(0)) > 0, F.col("_json").isNotNull()
    field = lambda name: F.get_json_object("_json", f"$.{name}")
    out = {
        "readings": F.when(page, F.col("_page.readings")).otherwise(own), "device_status": F.when(page, status(F.col("_page.status"))).otherwise(field("device_status")), "device": F.when(page, device).otherwise(field("device")),
        "source": F.when(page, "html").when(given, F.coalesce(field("source"), F.lit("json"))), "payload": F.col("_json"),
    }
    return found.withColumns(out).drop("_page", "_json")


def episodes(candidates: DataFrame, *, days: int = 14) -> DataFrame:
    """(zone_id, indicator, candidate_id, observed_at, episode) of a stream of alertable candidates.

    State is kept per zone and indicator: each open episode's first and last day. A candidate joins the newest episode
    that it is within ``days`` days of, which a late one can extend backwards, else it opens one. Episodes that ended more
    than a year before the newest are forgotten. In one batch candidates are taken in the order of time.
    """
    import json

    import pandas as pd

    def step(key, batches, state):
        known = json.loads(state.get[0]) if state.exists else {"next": 1, "open": []}
        frame = pd.concat(list(batches)).sort_values(["observed_at", "candidate_id"], ignore_index=True)
        day = frame["observed_at"].to_numpy().astype("datetime64[D]").astype(int)
        chosen = []
        for d in day.tolist():
            near = [e for e in known["open"] if e[1] - days <= d <= e[2] + days]
            if near:
                e = max(near)
                e[1], e[2] = min(e[1], d), max(e[2], d)
            else:
                e = [known["next"], d, d]
                known["open"].append(e)
                known["next"] += 1
            chosen.append(e[0])
        newest = max(e[2] for e in known["open"])
        known["open"] = [e for e in known["open"] if e[2] >= newest - 366]
        state.update((json.dumps(known),))
        yield pd.DataFrame({"zone_id": key[0], "indicator": key[1], "candidate_id": frame["candidate_id"], "observed_at": frame["observed_at"], "episode": chosen})

    given = candidates.select(F.col("zone_id").cast("long").alias("zone_id"), "indicator", F.col("candidate_id").cast("long").alias("candidate_id"), F.col("observed_at").cast("timestamp").alias("observed_at"))
    schema = "zone_id long, indicator string, candidate_id long, observed_at timestamp, episode long"
    return given.groupBy("zone_id", "indicator").applyInPandasWithState(step, schema, "known string", "append", "NoTimeout")
