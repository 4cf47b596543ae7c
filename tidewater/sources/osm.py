"""Map elements with their geometry to polygons: closed ways, and relations whose member ways enclose areas.

Ways may cross, touch or overlap, run either way and dangle. Their segments are split where they meet (a join by grid cell), and
the faces of the plane that the pieces of one element make are walked and chosen from: those that the outer ways enclose
and the inner ways do not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_POINTS = "array<struct<lon: double, lat: double>>"
DIGITS = 10
ANSWER = f"elements array<struct<type: string, id: long, tags: map<string, string>, geometry: {_POINTS}, members: array<struct<type: string, role: string, geometry: {_POINTS}>>>>"


def parsed(payloads: DataFrame, *, payload: str = "payload") -> DataFrame:
    """Answers with an ``elements`` list as one row per element: osm_id, type, tags, geometry, members."""
    each = payloads.select(F.explode(F.from_json(payload, ANSWER)["elements"]).alias("e"))
    return each.select(F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("osm_id"), "e.type", "e.tags", "e.geometry", "e.members")


def features(elements: DataFrame) -> DataFrame:
    """The properties that the registry reads."""
    tag = lambda name, to: F.col("tags")[name].alias(to)
    return elements.select("osm_id", tag("name", "name"), tag("name:en", "name_en"), tag("water", "water"))


def segments(elements: DataFrame) -> DataFrame:
    """(osm_id, number, inner, x1, y1, x2, y2): the pieces of line between neighbouring points, of closed ways of at least four
    points and of relations' member ways of at least two; pieces without length are left out."""
    closed = (F.col("type") == "way") & (F.size("geometry") >= 4) & (F.col("geometry")[0] == F.element_at("geometry", -1))
    own = F.array(F.struct(F.lit(0).alias("way"), F.lit(False).alias("inner"), F.col("geometry").alias("points")))
    member = F.filter(F.transform("members", lambda m, i: F.struct(i.alias("way"), (F.coalesce(m["role"], F.lit("")) == "inner").alias("inner"), F.when(m["type"] == "way", m["geometry"]).alias("points"))), lambda w: F.size(w["points"]) >= 2)
    ways = elements.select("osm_id", F.explode(F.when(closed, own).when(F.col("type") == "relation", member)).alias("w"))
    pairs = F.arrays_zip(F.slice("w.points", F.lit(1), F.size("w.points") - 1).alias("p"), F.slice("w.points", F.lit(2), F.size("w.points") - 1).alias("q"))
    each = ways.select("osm_id", "w.way", "w.inner", F.posexplode(pairs).alias("i", "s"))
    each = each.select("osm_id", F.struct("way", "i").alias("number"), "inner", F.col("s.p.lon").alias("x1"), F.col("s.p.lat").alias("y1"), F.col("s.q.lon").alias("x2"), F.col("s.q.lat").alias("y2"))
    return each.filter("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL AND (x1 <> x2 OR y1 <> y2)")


def meetings(lines: DataFrame) -> DataFrame:
    """(osm_id, number, x, y): where a segment is met by another one of its element, by crossing, touching or lying upon it.

    Segments of an element are compared where they share a cell of twice their mean length. Both get the very same point,
    and so do three that cross in one: crossings are rounded to DIGITS decimals of a degree.
    """
    size = lines.groupBy("osm_id").agg((2 * F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))).alias("cell"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / F.col("cell")), F.floor(F.greatest(a, b) / F.col("cell"))))
    placed = lines.join(size, "osm_id").withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2")).drop("cell", "inner")
    a, b = (placed.select("osm_id", "cx", "cy", *[F.col(c).alias(f"{s}_{c}") for c in ("number", "x1", "y1", "x2", "y2")]) for s in "ab")
    met = a.join(b, ["osm_id", "cx", "cy"]).filter("a_number < b_number").drop("cx", "cy").distinct()
    side = lambda s, t, e: F.expr(f"({s}_x2 - {s}_x1) * ({t}_y{e} - {s}_y1) - ({s}_y2 - {s}_y1) * ({t}_x{e} - {s}_x1)")
    met = met.withColumns({"d1": side("a", "b", 1), "d2": side("a", "b", 2), "e1": side("b", "a", 1), "e2": side("b", "a", 2)})
    crosses = (F.signum("d1") * F.signum("d2") < 0) & (F.signum("e1") * F.signum("e2") < 0)
    share = F.col("e1") / (F.col("e1") - F.col("e2"))
    along = lambda c: F.round(F.col(f"a_{c}1") + share * (F.col(f"a_{c}2") - F.col(f"a_{c}1")), DIGITS)
    at = F.when(crosses, F.struct(along("x").alias("x"), along("y").alias("y")))

    def upon(d: str, s: str, t: str, e: int):  # end e of t lies on s
        x, y = F.col(f"{t}_x{e}"), F.col(f"{t}_y{e}")
        box = x.between(F.least(f"{s}_x1", f"{s}_x2"), F.greatest(f"{s}_x1", f"{s}_x2")) & y.between(F.least(f"{s}_y1", f"{s}_y2"), F.greatest(f"{s}_y1", f"{s}_y2"))
        return F.when((F.col(d) == 0) & box, F.struct(x.alias("x"), y.alias("y")))

    points = F.array_compact(F.array(at, upon("d1", "a", "b", 1), upon("d2", "a", "b", 2), upon("e1", "b", "a", 1), upon("e2", "b", "a", 2)))
    met = met.select("osm_id", F.explode(F.array("a_number", "b_number")).alias("number"), points.alias("points"))
    return met.select("osm_id", "number", F.explode("points").alias("p")).select("osm_id", "number", "p.x", "p.y")


def pieces(lines: DataFrame) -> DataFrame:
    """(osm_id, inner, outer, x1, y1, x2, y2): the segments split where they meet, each piece once, from its lesser end to its
    greater, with the roles that run along it."""
    points = meetings(lines).groupBy("osm_id", "number").agg(F.collect_set(F.struct("x", "y")).alias("met"))
    both = lines.join(points, ["osm_id", "number"], "left")
    ends = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    run = F.when((F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2"))), F.lit(1)).otherwise(F.lit(-1))
    along = lambda p: F.struct((p["x"] - F.col("x1")) * (F.col("x2") - F.col("x1")) + (p["y"] - F.col("y1")) * (F.col("y2") - F.col("y1")))
    every = F.array_distinct(F.concat(ends, F.coalesce("met", F.array().cast("array<struct<x: double, y: double>>"))))
    ordered = F.array_sort(F.transform(every, lambda p: F.struct(along(p).alias("at"), p["x"].alias("x"), p["y"].alias("y"))))
    cut = F.arrays_zip(F.slice("o", F.lit(1), F.size("o") - 1).alias("p"), F.slice("o", F.lit(2), F.size("o") - 1).alias("q"))
    each = both.select("osm_id", "inner", run.alias("run"), ordered.alias("o")).select("osm_id", "inner", "run", F.explode(cut).alias("s"))
    low, high = (F.when((F.col("run") > 0) == F.lit(first), F.struct("s.p.x", "s.p.y")).otherwise(F.struct("s.q.x", "s.q.y")) for first in (True, False))
    each = each.select("osm_id", "inner", low.alias("l"), high.alias("h")).select("osm_id", "inner", F.col("l.x").alias("x1"), F.col("l.y").alias("y1"), F.col("h.x").alias("x2"), F.col("h.y").alias("y2"))
    return each.groupBy("osm_id", "x1", "y1", "x2", "y2").agg(F.bool_or("inner").alias("inner"), F.bool_or(~F.col("inner")).alias("outer"))


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of the ``n`` nodes that each reaches by the links (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    return root


def rings(ends: np.ndarray, outer: np.ndarray, inner: np.ndarray) -> list[np.ndarray]:
    """Rings (arrays of points) of the area that the outer pieces enclose and the inner ones do not, area on the left: shells
    run counter-clockwise, holes clockwise. ``ends`` is (piece, 4): x1, y1, x2, y2; pieces meet at their ends only.

    Each piece is two darts, k and k + n. The darts of a face follow each other; faces that only pieces of one role separate
    are one where the other role is asked about; what is joined to the outside is not enclosed.
    """
    n = len(ends)
    points, at = np.unique(ends.reshape(-1, 2), axis=0, return_inverse=True)
    at = at.reshape(n, 2)
    start, end = np.r_[at[:, 0], at[:, 1]], np.r_[at[:, 1], at[:, 0]]
    way = points[end] - points[start]
    order = np.lexsort((np.arctan2(way[:, 1], way[:, 0]), start))  # around each point, counter-clockwise
    place = np.empty(2 * n, np.int64)
    place[order] = np.arange(2 * n)
    first = np.searchsorted(start[order], np.arange(len(points)))
    count = np.bincount(start, minlength=len(points))
    twin = (np.arange(2 * n) + n) % (2 * n)
    clockwise = order[first[start] + (place - first[start] - 1) % count[start]]  # the dart before, at the same point
    after = clockwise[twin]  # keeps the face on the left
    face = _joined(2 * n, np.arange(2 * n), after)
    cross = points[start, 0] * points[end, 1] - points[end, 0] * points[start, 1]
    area = np.zeros(2 * n)
    np.add.at(area, face, cross)
    group = _joined(len(points), at[:, 0], at[:, 1])  # connected parts of the drawing

    # The outer boundary of each part lies in the outside, or in a face of another part: that to the left of the first
    # piece below the part's leftmost point.
    outside = 2 * n
    links: list[tuple[int, int]] = []
    for part in np.unique(group[start]).tolist():
        darts = np.flatnonzero(group[start] == part)
        hull = face[darts][np.argmin(area[face[darts]])]
        p = points[start[darts]]
        x, y = p[np.lexsort((p[:, 1], p[:, 0]))[0]]
        under = np.flatnonzero((points[at[:, 0], 0] <= x) & (points[at[:, 1], 0] > x) & (group[at[:, 0]] != part))
        rise = (points[at[under, 1], 1] - points[at[under, 0], 1]) / (points[at[under, 1], 0] - points[at[under, 0], 0])
        height = points[at[under, 0], 1] + (x - points[at[under, 0], 0]) * rise
        lower = np.flatnonzero(height < y)
        # Of pieces that start at one point below, the steepest is on top.
        links.append((int(hull), int(face[under[lower[np.lexsort((rise[lower], height[lower]))[-1]]]]) if len(lower) else outside))
    joins = np.array(links, np.int64).reshape(-1, 2)

    def enclosed(by: np.ndarray) -> np.ndarray:
        free = np.flatnonzero(~by)
        root = _joined(2 * n + 1, np.r_[face[free], joins[:, 0], np.arange(2 * n)], np.r_[face[free + n], joins[:, 1], face])
        return root[:-1] != root[-1]

    kept = enclosed(outer) & ~enclosed(inner)
    edge = kept & ~kept[twin]
    # From a boundary dart's end go on, turning past darts inside the area, to the next boundary dart.
    onward, waits = after.copy(), edge.copy()
    while (waits := waits & ~edge[onward]).any():
        onward[waits] = clockwise[onward[waits]]
    found, open_ = [], set(np.flatnonzero(edge).tolist())
    for dart in np.flatnonzero(edge).tolist():
        if dart in open_:
            ring = []
            while dart in open_:
                open_.discard(dart)
                ring.append(start[dart])
                dart = int(onward[dart])
            found.append(points[ring])
    return found


def polygons(elements: DataFrame) -> DataFrame:
    """Vertices (osm_id, ring, hole, seq, x, y) of the elements that enclose an area; the last vertex does not repeat the
    first. Shells come before holes.

    A way counts if it has at least four points and ends where it starts; a relation's ways of role ``inner`` make holes, all
    others the shell. A hole is taken out only where it lies in the shell; ways that enclose nothing, and elements that
    have no shell, are left out. Null geometries are none. Elements are split apart from each other; the pieces of one
    element (the map format allows 2,000 points in each of 32,000 ways) meet in one task.
    """
    schema = "osm_id string, ring long, hole boolean, seq long, x double, y double"

    def walk(element: pd.DataFrame) -> pd.DataFrame:
        element = element.sort_values(["x1", "y1", "x2", "y2"])
        made = rings(element[["x1", "y1", "x2", "y2"]].to_numpy(float), element["outer"].to_numpy(bool), element["inner"].to_numpy(bool))
        area = [float(np.sum(r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1])) for r in made]
        rows = [(element["osm_id"].iloc[0], k, area[i] < 0, s, x, y) for k, i in enumerate(sorted(range(len(made)), key=lambda i: -area[i])) for s, (x, y) in enumerate(made[i].tolist())]
        return pd.DataFrame(rows, columns=["osm_id", "ring", "hole", "seq", "x", "y"])

    return pieces(segments(elements)).groupBy("osm_id").applyInPandas(walk, schema)
