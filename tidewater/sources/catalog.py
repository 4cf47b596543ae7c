"""Reading scene catalogues and payloads, planning requests, and writing report rows and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.baseline import first_rows

#: The item properties that are read; everything else in them is ignored.
ITEM_PROPERTIES = "`grid:code` string, `mgrs:utm_zone` int, `mgrs:latitude_band` string, `mgrs:grid_square` string, `s2:mgrs_tile` string, tileId string, `eo:cloud_cover` double, `proj:epsg` int, `proj:code` string, `earthsearch:boa_offset_applied` boolean, `s2:processing_baseline` string, `processing:baseline` string"

#: The bands that every scene must have, and the asset names that catalogues give them, the first found wins.
BAND_ASSETS = {"B03": ("B03", "green"), "B04": ("B04", "red"), "B05": ("B05", "rededge1"), "B08": ("B08", "nir"), "B11": ("B11", "swir16"), "SCL": ("SCL", "scl")}


#: The assets of an item: links by name.
ITEM_ASSETS = "map<string, struct<href: string>>"


def worked_out(frame: DataFrame, **columns: Column) -> DataFrame:
    """The frame with the columns, each worked out once a row. A filter on what is made of a plain column is pushed below it with
    a copy of its expression for every mention, which for parsed JSON is most of the work; it is not pushed below a generator."""
    one = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return frame.select("*", F.inline(one))


def band_links(by_name: Column) -> Column:
    """Map from band to link, of the bands that the assets (parsed as ``ITEM_ASSETS``) have; an empty link is none."""
    link = lambda names: F.coalesce(*[F.nullif(by_name[n]["href"], F.lit("")) for n in names])
    each = F.create_map(*[c for band, names in BAND_ASSETS.items() for c in (F.lit(band), link(names))])
    return F.map_filter(each, lambda _, href: href.isNotNull())


def scene_catalog(items: DataFrame, *, properties: str = "properties", assets: str = "assets") -> DataFrame:
    """Items with tile, cloud share (100 where unknown), EPSG code and links by band; items without a tile, a time or one
    of the bands are dropped."""
    p = worked_out(items, _p=F.from_json(properties, ITEM_PROPERTIES), _a=F.from_json(assets, ITEM_ASSETS))
    g = lambda name: F.col("_p")[name]
    parts = F.concat(F.format_string("%02d", g("mgrs:utm_zone")), g("mgrs:latitude_band"), g("mgrs:grid_square"))
    parts = F.when((g("mgrs:utm_zone") != 0) & (g("mgrs:latitude_band") != "") & (g("mgrs:grid_square") != ""), parts)
    code = F.when(g("grid:code").startswith("MGRS-"), F.regexp_replace(g("grid:code"), "^MGRS-", ""))
    given = F.coalesce(F.nullif(g("s2:mgrs_tile"), F.lit("")), F.nullif(g("tileId"), F.lit("")))
    tile = F.nullif(F.coalesce(code, parts, F.regexp_replace(given, "^T", "")), F.lit(""))
    epsg = F.coalesce(g("proj:epsg"), F.regexp_extract(g("proj:code"), "^EPSG:([0-9]+)$", 1).try_cast("int")).cast("long")
    out = p.withColumn("tile", tile).withColumn("cloud_pct", F.coalesce(g("eo:cloud_cover"), F.lit(100.0))).withColumn("epsg", epsg).withColumn("boa_offset", boa_offset(F.col("_p"))).withColumn("links", band_links(F.col("_a")))
    return out.filter(F.expr("tile IS NOT NULL AND at IS NOT NULL") & (F.size("links") == len(BAND_ASSETS))).drop("_p", "_a")


def boa_offset(p: Column) -> Column:
    """0 where the offset is applied already or the processing, under its first name or its second, is older than 4.0, else -1000."""
    baseline = F.coalesce(F.nullif(p["s2:processing_baseline"], F.lit("")), p["processing:baseline"]).try_cast("double")
    return F.when(F.coalesce(p["earthsearch:boa_offset_applied"], F.lit(False)), 0).when(baseline < 4.0, 0).otherwise(-1000)


def from_feature(frame: DataFrame) -> DataFrame:
    """Features with a time in milliseconds, a platform and a tile to scenes; letters N to Z are the northern half."""
    north = F.substring("tile", 3, 1) >= "N"
    epsg = F.when(north, 32600).otherwise(32700) + F.substring("tile", 1, 2).cast("int")
    return frame.withColumn("sensed_at", F.timestamp_millis("ms")).withColumn("platform", F.lower(F.translate("platform", "_", "-"))).withColumn("epsg", epsg)


def search(scenes: DataFrame, *, first: str, last: str, limit: int = 200, most_cloud: float | None = None) -> DataFrame:
    """Per body the first ``limit`` source items of the dates, both included, in the order of time and id."""
    found = scenes.filter(F.to_date("sensed_at").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    if most_cloud is not None:
        found = found.filter(F.col("cloud_pct") <= most_cloud)
    order = Window.partitionBy("body_id").orderBy("sensed_at", "scene_id")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit).drop("_r")


def first_healthy(attempts: DataFrame) -> DataFrame:
    """Per request the first source that did not fail (an empty answer is none), and the number of failures."""
    return attempts.groupBy("request").agg(F.min(F.when(F.col("ok"), F.col("rank"))).alias("source_rank"), F.count_if(~F.col("ok")).alias("failures"))


def upsert_scenes(seen: DataFrame, *, most_cloud: float) -> DataFrame:
    """One row per scene: the source of the first sight, everything else of the last."""
    cloud = F.max_by("cloud_pct", "seen")
    return seen.groupBy("scene_id").agg(F.min_by("source", "seen").alias("source"), cloud.alias("cloud_pct"), (cloud <= most_cloud).alias("usable"))


def snapped(low: Column, high: Column, *, buffer: float = 100.0, grid: float = 20.0) -> tuple[Column, Column]:
    """A window with its buffer, outward to the grid."""
    return F.floor((low - buffer) / grid) * grid, F.ceil((high + buffer) / grid) * grid


def window(low: tuple[Column, Column], high: tuple[Column, Column], *, raster: tuple[float, float, float, float], buffer: float = 100.0, grid: float = 20.0) -> Column:
    """Struct (x0, y0, x1, y1): a box with its buffer, outward to the raster's grid and clipped to the raster.

    ``raster`` is its (x0, y0, x1, y1); columns count from its left, rows from its top. A box off the raster is an error.
    """
    x0, y0, x1, y1 = raster
    left, right = F.floor((low[0] - buffer - x0) / grid) * grid + x0, F.ceil((high[0] + buffer - x0) / grid) * grid + x0
    bottom, top = y1 - F.ceil((y1 - low[1] + buffer) / grid) * grid, y1 - F.floor((y1 - high[1] - buffer) / grid) * grid
    box = F.struct(F.greatest(left, F.lit(x0)).alias("x0"), F.greatest(bottom, F.lit(y0)).alias("y0"), F.least(right, F.lit(x1)).alias("x1"), F.least(top, F.lit(y1)).alias("y1"))
    off = (box["x0"] >= box["x1"]) | (box["y0"] >= box["y1"])
    return F.when(off, F.raise_error(F.lit("the box is off the raster"))).otherwise(box)


def read_windows(pixels: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """The pixels (keys, x, y, bands) inside their body's or scene's window (keys, x0, y0, x1, y1), right and top excluded."""
    inside = "x >= x0 AND x < x1 AND y >= y0 AND y < y1"
    return pixels.join(windows, keys).filter(inside)


def finer(cells: DataFrame, scene: str) -> DataFrame:
    """Each coarse cell as its four fine ones, with its value (nearest neighbour)."""
    four = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    each = cells.withColumn("_o", F.explode(four))
    return each.select(scene, (F.col("row") * 2 + F.col("_o.i")).alias("row"), (F.col("col") * 2 + F.col("_o.j")).alias("col"), "v")


def smoother(cells: DataFrame, scene: str) -> DataFrame:
    """Each coarse cell as its four fine ones, with values between the coarse centres (bilinear).

    A fine centre lies a quarter of a coarse cell from its own centre, so a coarse cell counts 3/4 in its own two fine rows
    and 1/4 in the next one on either side; columns alike. Where a neighbour or its value is missing, the weights of the
    others are scaled up. The sums are partial aggregates, no scene is in one task.
    """
    reach = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in ((-1, 0.25), (0, 0.75), (1, 0.75), (2, 0.25))])
    each = cells.withColumn("_r", F.explode(reach)).withColumn("_c", F.explode(reach))
    own = F.col("_r.i").isin(0, 1) & F.col("_c.i").isin(0, 1)
    weight = F.when(F.col("v").isNotNull(), F.col("_r.w") * F.col("_c.w"))
    spread = each.select(scene, (F.col("row") * 2 + F.col("_r.i")).alias("row"), (F.col("col") * 2 + F.col("_c.i")).alias("col"), own.alias("own"), weight.alias("w"), (F.col("v") * weight).alias("wv"))
    mixed = spread.groupBy(scene, "row", "col").agg(F.max("own").alias("own"), F.try_divide(F.sum("wv"), F.sum("w")).alias("v"))
    return mixed.filter("own").drop("own")


def block_edge(bands: Column, bytes_per_pixel: Column, *, most_bytes: int = 48 * 1024 * 1024) -> Column:
    """Edge of the largest square block whose answer stays below the byte limit, a quarter of it left for overhead."""
    return F.floor(F.sqrt(F.lit(0.75 * most_bytes) / (bands * bytes_per_pixel))).cast("long")


def blocks(windows: DataFrame, size: int | Column) -> DataFrame:
    """Blocks of at most ``size`` that cover each window of w by h, both positive."""
    size = (F.lit(size) if isinstance(size, int) else size).cast("long")
    b = windows.withColumn("_s", size).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1, F.col("_s"))))
    b = b.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1, F.col("_s"))))
    return b.withColumn("bw", F.least("_s", F.col("w") - F.col("x"))).withColumn("bh", F.least("_s", F.col("h") - F.col("y"))).drop("_s")


def chunks(spans: DataFrame, days: int) -> DataFrame:
    """Spans (a to b, both included) in chunks of days."""
    each = spans.withColumn("chunk_from", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {days} DAY"))))
    return each.select("body_id", "chunk_from", F.least(F.date_add("chunk_from", days - 1), F.col("b")).alias("chunk_to"))


def backfill(requests: DataFrame, *, today: str, years: int = 3, days: int = 31, floor: str = "2017-01-01") -> DataFrame:
    """Requests (body_id, a, b; either may be null) in chunks of days, both ends included: never past today, by default of
    the last years, never before the archive's first day; nothing where no day is left."""
    b = F.least(F.coalesce("b", F.to_date(F.lit(today))), F.to_date(F.lit(today)))
    spans = requests.withColumn("b", b).withColumn("a", F.greatest(F.coalesce("a", F.date_sub("b", 365 * years)), F.to_date(F.lit(floor))))
    return chunks(spans.withColumn("a", F.when(F.col("a") <= F.col("b"), F.col("a"))), days)


def outstanding(ready: DataFrame, done: DataFrame) -> DataFrame:
    """Scenes ready for a stage that has not finished them."""
    return ready.join(done, "scene_id", "left_anti")


def pending(scenes: DataFrame, bodies: DataFrame, done: DataFrame, *, today: str, most_cloud: float = 60, lookback: tuple[int, int, int] = (7, 3, 10)) -> DataFrame:
    """(body_id, day) of usable scenes within the tier's lookback that no ingestion has finished."""
    days = F.when(F.col("tier") == 1, lookback[0]).when(F.col("tier") == 2, lookback[1]).otherwise(lookback[2])
    recent = scenes.filter(F.col("cloud_pct") <= most_cloud).join(bodies.select("body_id", "tier"), "body_id").filter(F.to_date("sensed_at") >= F.date_sub(F.to_date(F.lit(today)), days))
    return outstanding(recent, done).select("body_id", F.to_date("sensed_at").alias("day")).distinct()


def newest(scenes: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("body_id").orderBy(F.desc("sensed_at"), "scene_id")
    return scenes.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def rain_payload(payloads: DataFrame) -> DataFrame:
    """Daily payloads to rows, nulls left out; arrays of different lengths are an error."""
    parsed = payloads.withColumn("_d", F.from_json("payload", "daily struct<time: array<string>, precipitation_sum: array<double>>")["daily"])
    same = F.assert_true(F.size("_d.time") == F.size("_d.precipitation_sum"), F.lit("time and precipitation differ in length"))
    rows = parsed.withColumn("_ok", same).select("body_id", "_ok", F.explode(F.arrays_zip(F.col("_d.time").alias("t"), F.col("_d.precipitation_sum").alias("mm"))).alias("r"))
    return rows.filter("r.mm IS NOT NULL AND _ok IS NULL").select("body_id", F.to_date("r.t").alias("date"), F.col("r.mm").alias("mm"))


def report_text(columns: list[Column]) -> Column:
    """One report row: columns by semicolons, nulls empty."""
    return F.concat_ws(";", *[F.coalesce(c, F.lit("")) for c in columns])


INDICATORS = ("ndti_turbidity", "ndci_chlorophyll", "fai_algal", "sediment_proxy", "mndwi_extent")
#: The report's columns in order; fixed values of its format. The first ten are the day's, the others the zone's.
DAY_COLUMNS = ("date", "scene_id", "platform", "source", "scene_cloud_pct", "mask_usable", "valid_pixel_pct", "water_extent_km2", "rainfall_24h_mm", "rainfall_72h_mm")
ZONE_COLUMNS = (
    "zone_id", "zone_name", "zone_area_km2", *INDICATORS, *[f"z_{k}" for k in INDICATORS[:4]], "zone_valid_pixel_pct", "zone_water_fraction_pct", "max_abs_z", "anomalous_indicators",
    "baseline_status", "severity", "priority_score", "confidence", "alertable", "suppressed_reason", "natural_cause_likely", "alert_id",
)


def report_rows(days: DataFrame, zones: DataFrame, keys: list[str], *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row of texts per (day, zone) in the report's 34 columns, one for a day without zones; ready for ``write.csv``.

    Nulls, and columns that the inputs lack, are empty; lists are joined by semicolons. ``keep`` names columns of the days
    to put in front as they are. A day's column that the days lack may come with the zones.
    """
    given = [c for c in (*DAY_COLUMNS, *ZONE_COLUMNS) if c in zones.columns and c not in keys and (c in ZONE_COLUMNS or c not in days.columns)]
    joined = days.select(*keys, *keep, *[c for c in DAY_COLUMNS if c in days.columns and c not in keys]).join(zones.select(*keys, *given), keys, "left")

    def text(name: str) -> Column:
        if name not in joined.columns:
            return F.lit("").alias(name)
        as_list = joined.schema[name].dataType.typeName() == "array"
        return F.coalesce(F.array_join(name, ";") if as_list else F.col(name).cast("string"), F.lit("")).alias(name)

    return joined.select(*keep, *map(text, DAY_COLUMNS + ZONE_COLUMNS))


def feature(properties: Column, geometry: Column | None = None, id: Column | None = None) -> Column:
    """A feature with flat properties, and with a geometry and an id where given, as one JSON text."""
    parts = [F.lit("Feature").alias("type")] + ([] if id is None else [id.alias("id")]) + ([] if geometry is None else [geometry.alias("geometry")])
    return F.to_json(F.struct(*parts, properties.alias("properties")))


def covered_area(geom_kind: Column, affected_km2: Column, localised_km2: Column) -> Column:
    """Area of the shape that is drawn: a plume's affected area, else the localised patch's (null for a zone's outline)."""
    return F.when(geom_kind == "plume", affected_km2).otherwise(localised_km2)


def latest_rows(frame: DataFrame, keys: list[str], at: str) -> DataFrame:
    return first_rows(frame, keys, [F.col(at).desc()])


def load_registry(features: DataFrame, *, default_district: str | None = None, force_tier: int | None = None, source: str | None = None) -> DataFrame:
    """Bulk feature load: (id, name, district, kind, tier, area_km2, source) of features with a name and a geometry.

    ``features`` has area_km2 (null: no or empty geometry) and the properties name, name_en, district, kind, tier,
    drinking_water, urban, id and source as text. Blank texts count as missing. The name falls back to name_en, an unknown
    kind is a reservoir, a missing tier is assigned, the id falls back to ``wb_`` and the name's slug. A named feature
    without a district, where no default is given, is an error.
    """
    from tidewater.operators import geometry as G

    said = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    yes = lambda c: F.coalesce(F.lower(said(c)).isin("1", "true", "yes", "y"), F.lit(False))
    name = F.coalesce(said("name"), said("name_en"))
    district = F.coalesce(said("district"), F.lit(default_district).cast("string"))
    kind = F.when(said("kind").isin("reservoir", "lake", "river_stretch"), said("kind")).otherwise("reservoir")
    kept = features.filter(F.col("area_km2").isNotNull() & name.isNotNull())
    tier = F.coalesce(F.lit(force_tier).cast("int"), said("tier").try_cast("int"), G.tier(F.col("area_km2"), kind, yes("drinking_water"), yes("urban")).cast("int"))
    checked = F.when(district.isNull(), F.raise_error(F.concat(F.lit("no district: "), name))).otherwise(district)
    return kept.select(
        F.coalesce(said("id"), F.concat(F.lit("wb_"), G.slug(name))).alias("id"), name.alias("name"), checked.alias("district"), kind.alias("kind"), tier.alias("tier"), F.round("area_km2", 4).alias("area_km2"), F.coalesce(said("source"), F.lit(source).cast("string")).alias("source")
    )
