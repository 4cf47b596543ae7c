"""Zones of a body: centres by k-means on its cells, outlines by cutting the body between the centres."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import geometry as G

MOST_ZONES = 8


def centres(vertices: DataFrame, key: str, *, pixel: int = 20, most_cells: int = 60_000, starts: int = 10) -> DataFrame:
    """(key, zone, cx, cy, n_cells): as many centres as the body's area asks for, by k-means on the middles of its cells.

    Cells are ``pixel`` metres wide, doubled until a body has at most about ``most_cells`` of them, so what one task holds is
    bounded whatever the body's size. A body of fewer cells than the least number of zones gives its vertices instead.
    """
    vertices = G.spread(vertices, key)
    size = G.areas(vertices, key).select(key, G.zone_count(F.col("area_km2")).alias("k"), G.coarse_step(F.col("area_km2"), most_cells=most_cells, start=pixel).alias("step"))
    scaled = vertices.join(size.select(key, "step"), key).withColumns({"x": F.col("x") / F.col("step"), "y": F.col("y") / F.col("step")}).drop("step")
    cells = G.rasterise(scaled, key, step=1.0)
    corners = vertices.join(size, key).select(F.col(key).alias("_of"), "k", "step", "x", "y")

    def one(cells: pd.DataFrame, corners: pd.DataFrame) -> pd.DataFrame:
        step = corners["step"].iloc[0]
        inside = pd.DataFrame({"x": (cells["col"] + 0.5) * step, "y": (cells["row"] + 0.5) * step})
        points = (inside if len(inside) >= 4 else corners[["x", "y"]].drop_duplicates()).sort_values(["x", "y"])
        zone = G.k_means(points[["x", "y"]].to_numpy(float), int(corners["k"].iloc[0]), starts)
        found = points.assign(zone=zone).groupby("zone").agg(cx=("x", "mean"), cy=("y", "mean"), n_cells=("x", "size")).reset_index()
        return found.assign(**{key: corners["_of"].iloc[0]})[[key, "zone", "cx", "cy", "n_cells"]]

    # cells stay where they were made, and each body's few vertices come to them
    kind = vertices.schema[key].dataType.simpleString()
    return cells.groupBy(key).cogroup(corners.groupBy("_of")).applyInPandas(one, f"{key} {kind}, zone long, cx double, cy double, n_cells long")


def outlines(vertices: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Vertices (key, zone, ring, hole, seq, x, y) of each zone: the part of the body that is nearest to the zone's centre.

    The body's rings are cut by one half-plane after another, between the zone's centre and each other one of the body,
    MOST_ZONES - 1 at most. A ring that a line cuts into several pieces stays one ring whose pieces hang together along
    the line; its area is theirs. Rings that are cut away altogether have no rows.
    """
    of_body = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("zone", "cx", "cy"))).alias("all"))
    # Nearer to c than to o: 2 (o - c) . p <= |o|^2 - |c|^2
    plane = lambda o: F.struct((2 * (o["cx"] - F.col("cx"))).alias("a"), (2 * (o["cy"] - F.col("cy"))).alias("b"), (o["cx"] * o["cx"] + o["cy"] * o["cy"] - F.col("cx") * F.col("cx") - F.col("cy") * F.col("cy")).alias("c"))
    others = F.transform(F.filter("all", lambda o: o["zone"] != F.col("zone")), plane)
    planes = found.join(of_body, key).select(key, "zone", others.alias("planes"))
    ring = F.col("ring").cast("long") if "ring" in vertices.columns else F.lit(0).cast("long")
    hole = F.col("hole") if "hole" in vertices.columns else F.lit(False)
    out = vertices.select(key, ring.alias("ring"), hole.alias("hole"), F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(planes, key)
    around = Window.partitionBy(key, "zone", "ring").orderBy("seq")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for k in range(MOST_ZONES - 1):
        plane_k = F.get("planes", F.lit(k))
        beyond = F.coalesce(plane_k["a"] * F.col("x") + plane_k["b"] * F.col("y") - plane_k["c"], F.lit(-1.0))
        out = out.withColumn("d", beyond)
        out = out.withColumns({f"{c}2": F.coalesce(F.lead(c).over(around), F.first(c).over(whole)) for c in ("x", "y", "d")})
        inside, share = F.col("d") <= 0, F.col("d") / (F.col("d") - F.col("d2"))
        here = F.when(inside, F.struct("x", "y"))
        crossing = F.when(inside != (F.col("d2") <= 0), F.struct((F.col("x") + share * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + share * (F.col("y2") - F.col("y"))).alias("y")))
        out = out.select(key, "zone", "ring", "hole", "planes", "seq", F.posexplode(F.array(here, crossing)).alias("i", "p")).filter("p IS NOT NULL")
        out = out.select(key, "zone", "ring", "hole", "planes", (F.col("seq") * 2 + F.col("i")).alias("seq"), "p.x", "p.y")
    return out.select(key, "zone", "ring", "hole", "seq", "x", "y")


def zones(vertices: DataFrame, found: DataFrame, outline: DataFrame, key: str) -> DataFrame:
    """(key, seq, name, zone, cx, cy, n_cells, area_km2): the zones with an area, numbered clockwise from north around the body's
    centroid, and named by their direction from it; near the middle, within 0.08 of the root of the area, Central; names that
    a body has several times are numbered."""
    body = G.centroids(vertices, key).select(key, F.col("cx").alias("bx"), F.col("cy").alias("by")).join(G.areas(vertices, key).withColumnRenamed("area_km2", "whole"), key)
    both = F.struct(key, "zone")
    parts = G.areas(outline.withColumn("_of", both), "_of").select(f"_of.{key}", "_of.zone", "area_km2").filter("area_km2 > 0")
    z = found.join(parts, [key, "zone"]).join(body, key).withColumns({"dx": F.col("cx") - F.col("bx"), "dy": F.col("cy") - F.col("by")})
    bearing = (F.degrees(F.atan2("dx", "dy")) + 360) % 360
    z = z.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(bearing, "zone")).cast("long"))
    z = z.withColumn("base", G.compass(F.col("dx"), F.col("dy"), 0.08 * F.sqrt(F.col("whole") * 1e6)))
    n = F.row_number().over(Window.partitionBy(key, "base").orderBy("seq"))
    z = z.withColumn("n", n).withColumn("name", F.when(F.col("n") > 1, F.concat_ws(" ", "base", F.col("n").cast("string"))).otherwise(F.col("base")))
    return z.select(key, "seq", "name", "zone", "cx", "cy", "n_cells", "area_km2")
