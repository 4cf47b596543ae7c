"""Geometry and registry queries (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import geometry as G
from tidewater.plans.bindings import bound, table
from tidewater.plans.registry import query
from tidewater.sources import osm
from tidewater.sources.stored import stored

R = lambda c, n=6: F.round(c, n)
POLY = """po AS (SELECT s_suppkey AS id, unnest(range(0, 5)) AS seq, s_suppkey % 17 * 1000e0 AS ox, s_suppkey % 13 * 900e0 AS oy, 300 + abs(s_acctbal) / 10 AS w, 200 + s_suppkey * 3e0 AS h FROM supplier),
vx AS (SELECT id, seq, ox + list_extract([0, w, w * 1.2e0, w * 0.6e0, 0], seq + 1) AS x, oy + list_extract([0, 0, h * 0.5e0, h, h * 0.8e0], seq + 1) AS y FROM po),
ed AS (SELECT id, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM vx WINDOW w AS (PARTITION BY id ORDER BY seq))"""


def polygons(spark, d) -> DataFrame:
    """A pentagon per supplier, as vertices."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    base = s.select(k.alias("id"), (k % 17 * 1000).cast("double").alias("ox"), (k % 13 * 900).cast("double").alias("oy"), (300 + F.abs("s_acctbal") / 10).alias("w"), (200 + k * 3).cast("double").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seq"))
    xs = F.array(F.lit(0.0), F.col("w"), F.col("w") * 1.2, F.col("w") * 0.6, F.lit(0.0))
    ys = F.array(F.lit(0.0), F.lit(0.0), F.col("h") * 0.5, F.col("h"), F.col("h") * 0.8)
    return base.select("id", F.col("seq").cast("long").alias("seq"), (F.col("ox") + xs[F.col("seq")]).alias("x"), (F.col("oy") + ys[F.col("seq")]).alias("y"))


@query("G1_utm_round_trip")
def g1(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 10000 * 170).alias("lon"), (F.col("c_custkey") % 160 - 79.5).alias("lat"))
    zone = G.utm_zone(F.col("lon"))
    e, n = G.to_utm(F.col("lon"), F.col("lat"), zone)
    p = c.withColumn("zone", zone).withColumn("e", e).withColumn("n", n)
    lon, lat = G.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("lat") < 0)
    metres = F.sqrt(F.pow((lon - F.col("lon")) * 111320 * F.cos(F.radians("lat")), 2) + F.pow((lat - F.col("lat")) * 110574, 2))
    return p.select("c_custkey", "zone", G.utm_epsg(F.col("zone"), F.col("lat")).alias("epsg"), R("e", 3).alias("easting"), R("n", 3).alias("northing"), (metres < 0.001).alias("exact"))


def holed(spark, d) -> DataFrame:
    """The pentagons of odd suppliers with a hole, the pentagon at half its size from the same corner, run the other way."""
    p = polygons(spark, d)
    corner = p.filter("seq = 0").select("id", F.col("x").alias("ox"), F.col("y").alias("oy"))
    half = p.filter("id % 2 = 1").join(corner, "id").select("id", (4 - F.col("seq")).alias("seq"), ((F.col("x") + F.col("ox")) / 2).alias("x"), ((F.col("y") + F.col("oy")) / 2).alias("y"))
    return p.withColumn("ring", F.lit(0)).withColumn("hole", F.lit(False)).unionByName(half.withColumn("ring", F.lit(1)).withColumn("hole", F.lit(True)))


@query("G2_polygon_area", POLY + "\n---\nSELECT id, round(abs(sum(x * y2 - x2 * y)) / 2 / 1e6 * CASE WHEN id % 2 = 1 THEN 0.75e0 ELSE 1 END, 12) AS area_km2 FROM ed GROUP BY 1")
def g2(spark, d):
    return G.areas(holed(spark, d), "id").select("id", R("area_km2", 12).alias("area_km2"))


CELLS = POLY + """,
bb AS (SELECT id, floor(min(x) / 100) AS c0, floor(max(x) / 100) AS c1, floor(min(y) / 100) AS r0, floor(max(y) / 100) AS r1 FROM vx GROUP BY 1),
ce AS (SELECT id, CAST(c AS BIGINT) AS col, CAST(r AS BIGINT) AS row FROM (SELECT id, r0, r1, unnest(generate_series(CAST(c0 AS BIGINT), CAST(c1 AS BIGINT))) AS c FROM bb) q, LATERAL (SELECT unnest(generate_series(CAST(r0 AS BIGINT), CAST(r1 AS BIGINT))) AS r)),
ins AS (SELECT ce.id, ce.row, ce.col FROM ce JOIN ed ON ed.id = ce.id AND (ed.y > ce.row * 100 + 50) <> (ed.y2 > ce.row * 100 + 50) AND ce.col * 100 + 50 < (ed.x2 - ed.x) * (ce.row * 100 + 50 - ed.y) / (ed.y2 - ed.y) + ed.x GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""


@query("G3_rasterise", CELLS + "\n---\nSELECT id, row, col FROM ins")
def g3(spark, d):
    return G.rasterise(polygons(spark, d), "id", step=100.0)


@query("G3_rasterise_buffered", CELLS + """,
wide AS (SELECT id, CAST(c AS BIGINT) AS col, CAST(r AS BIGINT) AS row FROM (SELECT id, r0, r1, unnest(generate_series(CAST(c0 - 3 AS BIGINT), CAST(c1 + 3 AS BIGINT))) AS c FROM bb) q, LATERAL (SELECT unnest(generate_series(CAST(r0 - 3 AS BIGINT), CAST(r1 + 3 AS BIGINT))) AS r)),
far AS (SELECT w.id, w.row, w.col, min((w.col * 100 + 50 - x - t * (x2 - x)) ** 2 + (w.row * 100 + 50 - y - t * (y2 - y)) ** 2) AS d2 FROM wide w JOIN ed ON ed.id = w.id, LATERAL (SELECT least(greatest(((w.col * 100 + 50 - x) * (x2 - x) + (w.row * 100 + 50 - y) * (y2 - y)) / ((x2 - x) ** 2 + (y2 - y) ** 2), 0), 1) AS t) GROUP BY 1, 2, 3)
---
SELECT id, row, col FROM ins UNION SELECT id, row, col FROM far WHERE d2 <= 230.7e0 ** 2""")
def g3_buffered(spark, d):
    return G.rasterise_buffered(polygons(spark, d), "id", step=100.0, buffer=230.7)


INSIDE = POLY + """,
mid AS (SELECT id, (min(y) + max(y)) / 2 AS py FROM vx GROUP BY 1), cr AS (SELECT id, py, (x2 - x) * (py - y) / (y2 - y) + x AS px0 FROM ed JOIN mid USING (id) WHERE (y > py) <> (y2 > py)),
ip AS (SELECT id, (min(px0) + max(px0)) / 2 AS px, max(py) AS py FROM cr GROUP BY 1)"""


@query("G4_interior_point", INSIDE + "\n---\nSELECT id, round(px, 6) AS px, round(py, 6) AS py FROM ip")
def g4_inside(spark, d):
    return G.interior_points(polygons(spark, d), "id").select("id", R("px").alias("px"), R("py").alias("py"))


@query("G4_centroid_and_box", POLY + "\n---\nSELECT id, round(sum((x + x2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)), 6) AS cx, round(sum((y + y2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)), 6) AS cy, round(min(x), 6) AS x0, round(max(y), 6) AS y1 FROM ed GROUP BY 1")
def g4(spark, d):
    return G.centroids(polygons(spark, d), "id").select("id", *[R(c).alias(c) for c in ("cx", "cy", "x0", "y1")])


@query("G5_point_in_polygon", POLY + """,
pt AS (SELECT c_custkey AS pid, c_custkey % 97 * 190e0 AS px, c_acctbal * 1.2e0 AS py FROM customer)
---
SELECT pid, id FROM pt JOIN ed ON (y > py) <> (y2 > py) AND px < (x2 - x) * (py - y) / (y2 - y) + x GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def g5(spark, d):
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") % 97 * 190).cast("double").alias("px"), (F.col("c_acctbal") * 1.2).alias("py"))
    return G.points_in(points, polygons(spark, d), "id", cell=500.0)


@query("G6_overlap_ratio", CELLS + "\n---\nSELECT a.id AS candidate, b.id AS other, round(count(*) / max(n), 6) AS ratio FROM ins a JOIN ins b ON a.row = b.row AND a.col = b.col AND a.id <> b.id JOIN (SELECT id, count(*) AS n FROM ins GROUP BY 1) s ON s.id = a.id GROUP BY 1, 2 HAVING count(*) / max(n) >= 0.3")
def g6(spark, d):
    return G.overlaps(G.rasterise(polygons(spark, d), "id", step=100.0), "id", least=0.3).withColumn("ratio", R("ratio"))


@query("G7_covering_tiles")
def g7(spark, d):
    """Tiles of a pentagon around each customer's place, up to 40 km wide, between 75 S and 75 N."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 70).alias("lon"), (F.col("c_custkey") % 150 - 74.5).alias("lat"), (0.05 + F.col("c_custkey") % 13 * 0.025).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seq"))
    at = lambda *v: F.array(*[F.lit(x) for x in v])[F.col("seq")]
    v = c.select("id", F.col("seq").cast("long").alias("seq"), (F.col("lon") + F.col("w") * at(0.0, 1.0, 1.2, 0.6, 0.0)).alias("x"), (F.col("lat") + F.col("w") * at(0.0, 0.0, 0.5, 1.0, 0.8)).alias("y"))
    return G.covering_tiles(v, "id")


BOXES = """tb AS (SELECT n_nationkey AS tile, unnest(range(0, 4)) AS seq, n_nationkey % 5 * 4000e0 - 500 AS ox, n_nationkey // 5 * 2600e0 - 500 AS oy FROM nation),
tv AS (SELECT tile, seq, ox + list_extract([0, 4300, 4300, 0], seq + 1) AS x, oy + list_extract([0, 0, 2900, 2900], seq + 1) AS y FROM tb),
te AS (SELECT tile, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM tv WINDOW w AS (PARTITION BY tile ORDER BY seq))"""


@query("G8_tile_lookup", POLY + ",\n" + BOXES + """,
sd AS (SELECT a.id, b.tile, sign((a.x2 - a.x) * (b.y - a.y) - (a.y2 - a.y) * (b.x - a.x)) * sign((a.x2 - a.x) * (b.y2 - a.y) - (a.y2 - a.y) * (b.x2 - a.x)) AS s1, sign((b.x2 - b.x) * (a.y - b.y) - (b.y2 - b.y) * (a.x - b.x)) * sign((b.x2 - b.x) * (a.y2 - b.y) - (b.y2 - b.y) * (a.x2 - b.x)) AS s2
FROM ed a, te b WHERE least(a.x, a.x2) <= greatest(b.x, b.x2) AND least(b.x, b.x2) <= greatest(a.x, a.x2) AND least(a.y, a.y2) <= greatest(b.y, b.y2) AND least(b.y, b.y2) <= greatest(a.y, a.y2))
---
SELECT id, tile FROM sd WHERE s1 <= 0 AND s2 <= 0 UNION SELECT id, tile FROM vx JOIN (SELECT DISTINCT tile, ox, oy FROM tb) ON x BETWEEN ox AND ox + 4300 AND y BETWEEN oy AND oy + 2900
UNION SELECT id, tile FROM tv JOIN ed ON (ed.y > tv.y) <> (ed.y2 > tv.y) AND tv.x < (ed.x2 - ed.x) * (tv.y - ed.y) / (ed.y2 - ed.y) + ed.x GROUP BY id, tile, tv.seq HAVING count(*) % 2 = 1""")
def g8(spark, d):
    """Overlapping boxes of 4.3 by 2.9 km, one per nation, as the tiles."""
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").select(k.cast("long").alias("tile"), (k % 5 * 4000 - 500).alias("ox"), (F.floor(k / 5) * 2600 - 500).alias("oy"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq"))
    at = lambda *v: F.array(*[F.lit(x) for x in v])[F.col("seq")]
    tiles = n.select("tile", "seq", (F.col("ox") + at(0.0, 4300.0, 4300.0, 0.0)).alias("x"), (F.col("oy") + at(0.0, 0.0, 2900.0, 2900.0)).alias("y"))
    return G.intersecting(polygons(spark, d), tiles, "id", "tile", cell=1000.0)


@query("S19_map_polygons", POLY + """,
ar AS (SELECT id, abs(sum(x * y2 - x2 * y)) / 2 / 1e6 AS a FROM ed GROUP BY 1)
---
SELECT CASE WHEN id % 2 = 0 THEN 'way/' ELSE 'relation/' END || id AS osm_id, 'Lake ' || id AS name, CAST(1 AS BIGINT) AS n_rings, CAST(CASE WHEN id % 2 = 0 THEN 5 ELSE 8 END AS BIGINT) AS n_vertices, round(a * CASE WHEN id % 2 = 0 THEN 1 ELSE 0.75e0 END, 6) AS area_km2
FROM ar WHERE id % 14 NOT IN (0, 7)""")
def s19(spark, d):
    """Even suppliers' pentagons as closed ways (every seventh left open), odd ones as relations of three ways, one of them
    backwards, and a hole in two (every seventh lacks a way of the shell). The hole shares a corner and parts of two sides with the
    shell, so what is left is one ring of eight points."""
    points = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col("ring") == r, F.struct("seq", "x", "y")))), lambda v: F.struct(v["x"].alias("lon"), v["y"].alias("lat")))
    p = holed(spark, d).groupBy("id").agg(points(0).alias("shell"), points(1).alias("inner"))
    none = F.array().cast("array<struct<lon: double, lat: double>>")
    closed = lambda c: F.concat(c, F.slice(c, 1, 1))
    way = lambda role, points: F.struct(F.lit("way").alias("type"), F.lit(role).alias("role"), points.alias("geometry"))
    cut = lambda c, a, n: F.slice(closed(c), a, n)
    members = F.array(way("outer", cut("shell", 4, 3)), way("inner", cut("inner", 1, 4)), way("outer", F.reverse(cut("shell", 2, 3))), way("inner", cut("inner", 4, 3)), way("outer", F.when(F.col("id") % 7 == 0, none).otherwise(cut("shell", 1, 2))))
    even = F.col("id") % 2 == 0
    element = F.struct(
        F.when(even, "way").otherwise("relation").alias("type"), F.col("id").alias("id"), F.create_map(F.lit("name"), F.concat(F.lit("Lake "), F.col("id").cast("string"))).alias("tags"),
        F.when(even & (F.col("id") % 7 == 0), F.col("shell")).when(even, closed("shell")).alias("geometry"), F.when(~even, members).alias("members"),
    )
    elements = osm.parsed(p.select(F.to_json(F.struct(F.array(element).alias("elements"))).alias("payload")))
    v = osm.polygons(elements)
    counts = v.groupBy("osm_id").agg(F.countDistinct("ring").alias("n_rings"), F.count("*").alias("n_vertices"))
    return osm.features(elements).select("osm_id", "name").join(counts, "osm_id").join(G.areas(v, "osm_id"), "osm_id").withColumn("area_km2", R("area_km2"))


@query("G9_radius_discovery", """pt AS (SELECT c_custkey AS id, c_acctbal / 100 AS lon, c_custkey % 160 - 79.5e0 AS lat, abs(c_acctbal) AS area FROM customer),
ds AS (SELECT *, 2 * 6371.0088e0 * asin(sqrt(sin(radians(lat - 20) / 2) ** 2 + cos(radians(20)) * cos(radians(lat)) * sin(radians(lon - 50) / 2) ** 2)) AS km FROM pt)
---
SELECT id, round(km, 6) AS km, area FROM (SELECT * FROM ds WHERE km <= 3000 ORDER BY id LIMIT 200) ORDER BY area DESC""")
def g9(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("lon"), (F.col("c_custkey") % 160 - 79.5).cast("double").alias("lat"), F.abs("c_acctbal").alias("area"))
    return G.discover(c, lon=50.0, lat=20.0, radius_km=3000.0, most=200).withColumn("km", R("km")).select("id", "km", "area")


@query("G9_radius_fallback", "SELECT CASE WHEN count(*) FILTER (c_acctbal / 100 > 100) = 0 THEN 'placeholder:20.0:179.5' END AS id, 0.0e0 AS km, 1.0e0 AS area FROM customer")
def g9_fallback(spark, d):
    """A place with no feature near: one row for a box of a kilometre around it."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_acctbal") / 100).alias("lon"), (F.col("c_custkey") % 160 - 79.5).cast("double").alias("lat"), F.abs("c_acctbal").alias("area"))
    return G.discover(c, lon=179.5, lat=20.0, radius_km=300.0, most=200, placeholder=True).select("id", "km", F.round("area", 1).alias("area"))


@query("G10_kind", "SELECT body_id, CASE WHEN water_tag IN ('reservoir', 'basin') THEN 'reservoir' WHEN water_tag = 'river' THEN 'river_stretch' ELSE 'lake' END AS kind FROM bodies", uses=("bodies",))
def g10(spark, d):
    return bound(spark, d, "bodies").select("body_id", G.kind(F.col("water_tag")).alias("kind"))


@query("G11_zones_per_body", "SELECT body_id, CAST(least(greatest(4 + floor(greatest(0, area_km2 - 5) / 6), 4), 8) AS BIGINT) AS k FROM bodies", uses=("bodies",))
def g11(spark, d):
    return bound(spark, d, "bodies").select("body_id", G.zone_count(F.col("area_km2")).alias("k"))


@query("G12_zone_partition")
def g12(spark, d):
    cells = G.rasterise(polygons(spark, d), "id", step=100.0).select("id", (F.col("col") * 100.0).alias("x"), (F.col("row") * 100.0).alias("y"))
    return G.partition(cells, "id", k=4)


@query("G12_zone_outlines")
def g12_outlines(spark, d):
    """The pentagons with holes, divided into as many zones as their area asks for, each with its outline."""
    from tidewater.operators import zoning as Z

    body = holed(spark, d)
    found = stored(Z.centres(body, "id"), "zone-centres")
    outline = stored(Z.outlines(body, found, "id"), "zone-outlines")
    shown = G.outlines(outline.withColumn("_of", F.struct("id", "zone")), "_of", digits=3).select("_of.id", "_of.zone", F.to_json("geometry").alias("geometry"))
    z = Z.zones(body, found, outline, "id").join(shown, ["id", "zone"])
    return z.select("id", "seq", "name", R("cx", 3).alias("cx"), R("cy", 3).alias("cy"), "n_cells", R("area_km2").alias("area_km2"), "geometry")


@query("G13_zone_names", """dr AS (SELECT z.zone_id, z.body_id, cos(zone_id * 1.7e0) * area_km2 AS dx, sin(zone_id * 1.7e0) * area_km2 AS dy FROM zones z),
nm AS (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) < 1 THEN 'Central' ELSE list_extract(['North', 'North-East', 'East', 'South-East', 'South', 'South-West', 'West', 'North-West'], CAST(floor((degrees(atan2(dx, dy)) + 360 + 22.5) / 45) AS INTEGER) % 8 + 1) END AS base FROM dr)
---
SELECT zone_id, body_id, CASE WHEN row_number() OVER (PARTITION BY body_id, base ORDER BY zone_id) > 1 THEN base || ' ' || row_number() OVER (PARTITION BY body_id, base ORDER BY zone_id) ELSE base END AS name FROM nm""", uses=("zones",))
def g13(spark, d):
    z = bound(spark, d, "zones").withColumn("dx", F.cos(F.col("zone_id") * 1.7) * F.col("area_km2")).withColumn("dy", F.sin(F.col("zone_id") * 1.7) * F.col("area_km2"))
    base = G.compass(F.col("dx"), F.col("dy"), 1.0)
    n = F.row_number().over(Window.partitionBy("body_id", "base").orderBy("zone_id"))
    named = z.withColumn("base", base).withColumn("n", n)
    return named.select("zone_id", "body_id", F.when(F.col("n") > 1, F.concat_ws(" ", "base", F.col("n").cast("string"))).otherwise(F.col("base")).alias("name"))


@query("G14_tier", "SELECT body_id, CASE WHEN drinking_water OR (urban AND water_tag = 'river') OR area_km2 >= 10 THEN 1 WHEN area_km2 >= 1 THEN 2 ELSE 3 END AS tier FROM bodies", uses=("bodies",))
def g14(spark, d):
    return bound(spark, d, "bodies").select("body_id", G.tier(F.col("area_km2"), G.kind(F.col("water_tag")), F.col("drinking_water"), F.col("urban")).alias("tier"))


@query("G15_slug", "SELECT doc_id, trim(regexp_replace(lower(translate(text, 'áàâäãåçéèêëíìîïñóòôöõúùûüÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜ', 'aaaaaaceeeeiiiinooooouuuuAAAAAACEEEEIIIINOOOOOUUUU')), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents")
def g15(spark, d):
    return table(spark, d, "documents").select("doc_id", G.slug(F.col("text")).alias("slug"))


@query("G16_grid_coarsening", "SELECT body_id, CAST(list_min(list_filter([10, 20, 40, 80, 160, 320, 640, 1280], lambda s: ceil(area_km2 * 1e6 / (s * s)) <= 6000 OR s > 1000)) AS BIGINT) AS step FROM bodies", uses=("bodies",))
def g16(spark, d):
    return bound(spark, d, "bodies").select("body_id", G.coarse_step(F.col("area_km2"), most_cells=6000).alias("step"))
