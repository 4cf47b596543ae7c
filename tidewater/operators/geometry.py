"""Geometry as columns: projections, polygon measures, rasterising, joins by position, zone partition and naming."""

from __future__ import annotations

import math
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.baseline import by_series, first_rows

#: WGS84 and the UTM grid; the series coefficients follow from the third flattening (Krueger).
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_K0, _E0, _SOUTH = 0.9996, 500000.0, 10000000.0
_ECC = math.sqrt(_F * (2 - _F))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("long")


def grid_zone(lon: Column, lat: Column) -> Column:
    """The military grid's zone: 32 reaches west over southern Norway, and Svalbard has 31, 33, 35 and 37 alone."""
    north = lat >= 72
    zone = F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32)
    for least, most, number in ((0, 9, 31), (9, 21, 33), (21, 33, 35), (33, 42, 37)):
        zone = zone.when(north & (lon >= least) & (lon < most), number)
    return zone.otherwise(F.least(utm_zone(lon), F.lit(60))).cast("long")


def utm_epsg(zone: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


#: The functions of the series for columns and for arrays.
_COLUMN = SimpleNamespace(**{f: getattr(F, f) for f in ("sin", "cos", "sinh", "cosh", "asin", "atanh", "atan2", "sqrt", "radians", "degrees")}, where=lambda on, a, b: F.when(on, a).otherwise(b))
_ARRAY = SimpleNamespace(**{f: getattr(np, f) for f in ("sin", "cos", "sinh", "cosh", "sqrt", "radians", "degrees", "where")}, asin=np.arcsin, atanh=np.arctanh, atan2=np.arctan2)
Values = Column | np.ndarray


def to_utm(lon: Values, lat: Values, zone: Values) -> tuple[Values, Values]:
    """Easting and northing in metres by the Krueger series, of columns or of arrays."""
    m = _COLUMN if isinstance(lon, Column) else _ARRAY
    phi, lam = m.radians(lat), m.radians(lon - (zone * 6 - 183))
    t = m.sinh(m.atanh(m.sin(phi)) - _ECC * m.atanh(_ECC * m.sin(phi)))
    xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + t * t))
    e, n = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        e = e + a * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        n = n + a * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
    return _E0 + _K0 * _R * e, _K0 * _R * n + m.where(lat < 0, _SOUTH, 0.0)


def from_utm(easting: Values, northing: Values, zone: Values, south: Values) -> tuple[Values, Values]:
    """Longitude and latitude by the inverse series, of columns or of arrays."""
    m = _COLUMN if isinstance(easting, Column) else _ARRAY
    xi = (northing - m.where(south, _SOUTH, 0.0)) / (_K0 * _R)
    eta = (easting - _E0) / (_K0 * _R)
    x, y = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        y = y - b * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    chi = m.asin(m.sin(x) / m.cosh(y))
    lat = chi
    for j, g in enumerate(_DELTA, 1):
        lat = lat + g * m.sin(2 * j * chi)
    return zone * 6 - 183 + m.degrees(m.atan2(m.sinh(y), m.cos(x))), m.degrees(lat)


def rings(vertices: DataFrame, key: str) -> list[str]:
    """Columns that tell rings apart: the key, and ``ring`` where there is one."""
    return [key, "ring"] if "ring" in vertices.columns else [key]


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by the keys over a number of partitions of our own: outlines are few bytes but become many cells or
    long work, and adaptive execution, which sees the bytes alone, would put them into one task. The number is never that of Spark's own
    exchanges: after one of those by the same keys Spark would leave this one out, and merge the tasks of the other."""
    spark = frame.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism) + 1
    return frame.repartition(n, *keys)


def edges(vertices: DataFrame, key: str) -> DataFrame:
    """Vertices (key, seq, x, y; also ring and hole where polygons have several rings) with the ring's next one, x2 and y2."""
    ring = Window.partitionBy(*rings(vertices, key)).orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    return vertices.withColumn("x2", nxt("x")).withColumn("y2", nxt("y"))


_CROSS = "x * y2 - x2 * y"


def _sums(vertices: DataFrame, key: str) -> DataFrame:
    """Per polygon twice its area and three times its first moments; rings may run either way, holes subtract."""
    moment = lambda a: F.sum(F.expr(f"({a} + {a}2) * ({_CROSS})"))
    box = [F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")]
    hole = [F.first("hole").alias("hole")] if "hole" in vertices.columns else [F.lit(False).alias("hole")]
    ring = edges(vertices, key).groupBy(*rings(vertices, key)).agg(F.sum(F.expr(_CROSS)).alias("a"), moment("x").alias("mx"), moment("y").alias("my"), *box, *hole)
    sign = F.when(F.col("hole"), -1).otherwise(1) * F.signum("a")
    return ring.groupBy(key).agg(*[F.sum(F.col(c) * sign).alias(c) for c in ("a", "mx", "my")], *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])


def areas(vertices: DataFrame, key: str) -> DataFrame:
    """Area in square kilometres of polygons in metres, without their holes."""
    return _sums(vertices, key).select(key, (F.col("a") / 2 / 1e6).alias("area_km2"))


def centroids(vertices: DataFrame, key: str) -> DataFrame:
    """Centroid by the shoelace sums (null where the area is 0), and the box."""
    return _sums(vertices, key).select(key, F.try_divide("mx", 3 * F.col("a")).alias("cx"), F.try_divide("my", 3 * F.col("a")).alias("cy"), "x0", "y0", "x1", "y1")


def interior_points(vertices: DataFrame, key: str) -> DataFrame:
    """A point (px, py) inside each polygon: the middle of the longest run inside, the leftmost of equal ones, on the line
    halfway up the box. A polygon without area has none."""
    e = edges(vertices, key)
    box = vertices.groupBy(key).agg(((F.min("y") + F.max("y")) / 2).alias("py"))
    crossed = e.join(box, key).filter((F.col("y") > F.col("py")) != (F.col("y2") > F.col("py")))
    at = (F.col("x2") - F.col("x")) * (F.col("py") - F.col("y")) / (F.col("y2") - F.col("y")) + F.col("x")
    order = Window.partitionBy(key).orderBy("at")
    runs = crossed.select(key, "py", at.alias("at")).withColumn("n", F.row_number().over(order)).withColumn("end", F.lead("at").over(order)).filter("n % 2 = 1")
    best = runs.groupBy(key).agg(F.max(F.struct((F.col("end") - F.col("at")).alias("run"), (-F.col("at")).alias("left"), "end", "py")).alias("b"))
    return best.filter("b.run > 0").select(key, ((F.col("b.end") - F.col("b.left")) / 2).alias("px"), F.col("b.py").alias("py"))


def outlines(vertices: DataFrame, key: str, *, digits: int = 6) -> DataFrame:
    """Each polygon as ``geometry``, a struct (type, coordinates) of closed rings, the first ring first."""
    at = F.array(F.round("x", digits), F.round("y", digits))
    ordered = F.array_sort(F.collect_list(F.struct("seq", at.alias("p"))))
    ring = vertices.groupBy(*rings(vertices, key)).agg(F.transform(ordered, lambda v: v["p"]).alias("r"))
    closed = F.when(F.col("r")[0] == F.element_at("r", -1), F.col("r")).otherwise(F.concat("r", F.slice("r", 1, 1)))
    number = F.col("ring") if "ring" in vertices.columns else F.lit(0)
    polygon = ring.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("ring"), closed.alias("r")))), lambda v: v["r"]).alias("coordinates"))
    return polygon.select(key, F.struct(F.lit("Polygon").alias("type"), "coordinates").alias("geometry"))


def rasterise(vertices: DataFrame, key: str, *, step: float) -> DataFrame:
    """Cells (key, row, col) whose centre is inside.

    Each edge goes to the rows that it crosses; a row's crossings, in order, open and close runs of cells, so the work
    is the rows crossed and the cells found, not all cells against all edges. Outlines are dealt out by key, and all else is
    done where they are.
    """
    cells = F.sequence("first", "last")
    return runs(vertices, key, step=step).select(key, "row", F.explode(cells).alias("col"))


def runs(vertices: DataFrame, key: str, *, step: float) -> DataFrame:
    """The cells whose centre is inside as runs (key, row, first, last) of columns; a row's runs do not meet."""
    e = edges(spread(vertices, key), key).filter("y <> y2")
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    rows = F.filter(F.sequence(F.floor(low / step), F.floor(high / step)), lambda r: (F.lit(1) == 1) & ((r + 0.5) * step >= low) & ((r + 0.5) * step < high))
    crossed = e.select(key, "x", "y", "x2", "y2", F.explode(rows).alias("row"))
    at = (F.col("x2") - F.col("x")) * ((F.col("row") + 0.5) * step - F.col("y")) / (F.col("y2") - F.col("y")) + F.col("x")
    order = Window.partitionBy(key, "row").orderBy("at")
    pairs = crossed.select(key, "row", at.alias("at")).withColumn("n", F.row_number().over(order)).withColumn("end", F.lead("at").over(order)).filter("n % 2 = 1 AND end IS NOT NULL")
    first, last = F.ceil(F.col("at") / step - 0.5), F.ceil(F.col("end") / step - 0.5) - 1
    return pairs.select(key, F.col("row").cast("long").alias("row"), first.alias("first"), last.alias("last")).filter("last >= first")


def rasterise_buffered(vertices: DataFrame, key: str, *, step: float, buffer: float) -> DataFrame:
    """Cells (key, row, col) whose centre is inside or at most ``buffer`` from the outline.

    An edge goes to the rows within reach and there to the columns beside the part of it within reach, so the work is the
    length of the outline times the buffer; then the distance to the edge decides. What is near an edge is one run of a row's
    cells, since the distance to it first falls, then rises; runs are joined where the outline is, and no cell is shuffled.
    """
    e = edges(spread(vertices, key), key)
    bottom, top = F.least("y", "y2"), F.greatest("y", "y2")
    rows = e.withColumn("row", F.explode(F.sequence(F.floor((bottom - buffer) / step), F.floor((top + buffer) / step))))
    rows = rows.withColumn("cy", (F.col("row") + 0.5) * step)
    share = lambda y: F.least(F.greatest((y - F.col("y")) / (F.col("y2") - F.col("y")), F.lit(0.0)), F.lit(1.0))
    flat = F.col("y") == F.col("y2")
    t1, t2 = F.when(flat, 0.0).otherwise(share(F.col("cy") - buffer)), F.when(flat, 1.0).otherwise(share(F.col("cy") + buffer))
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    a, b = F.col("x") + dx * t1, F.col("x") + dx * t2
    cols = F.sequence(F.floor((F.least(a, b) - buffer) / step), F.floor((F.greatest(a, b) + buffer) / step))
    long2 = dx * dx + dy * dy

    def close(col: Column) -> Column:
        cx, cy = (col + 0.5) * step, F.col("cy")
        t = F.when(long2 > 0, F.least(F.greatest(((cx - F.col("x")) * dx + (cy - F.col("y")) * dy) / long2, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.pow(cx - F.col("x") - t * dx, 2) + F.pow(cy - F.col("y") - t * dy, 2) <= buffer * buffer

    found = rows.withColumn("_c", F.filter(cols, close)).filter(F.size("_c") > 0)
    near = found.select(key, F.col("row").cast("long").alias("row"), F.array_min("_c").alias("first"), F.array_max("_c").alias("last"))
    each = near.unionAll(runs(vertices, key, step=step)).groupBy(key, "row").agg(F.collect_list(F.struct("first", "last")).alias("_r"))
    # a row has some runs; each gives its cells beyond those of the runs before it
    start = F.struct(F.lit(None).cast("bigint").alias("end"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("r"))
    joined = F.aggregate(F.array_sort("_r"), start, lambda a, r: F.struct(
        F.greatest(a["end"], r["last"]).alias("end"),
        F.when(a["end"].isNull() | (r["last"] > a["end"]), F.concat(a["r"], F.array(F.struct(F.greatest(r["first"], a["end"] + 1).alias("first"), r["last"].alias("last"))))).otherwise(a["r"]).alias("r"),
    ), lambda a: a["r"])
    return each.select(key, "row", F.explode(joined).alias("_r")).select(key, "row", F.explode(F.sequence("_r.first", "_r.last")).alias("col"))


#: Edges of an outline in a strip up to which ``points_in`` writes their comparisons out.
FEW = 4


def points_in(points: DataFrame, vertices: DataFrame, key: str, *, cell: float) -> DataFrame:
    """(pid, key) of the points inside: points go to the square cell that they lie in, and outlines, with their edges that meet a
    cell's row, to the cells of their box in that row, so a point meets an outline once and only within its box. An odd number
    of crossings to the point's right means inside."""
    e = edges(spread(vertices, key), key).filter("y <> y2")
    box = Window.partitionBy(key)
    # a vertex at which a level edge starts is the end of the one before
    e = e.withColumns({"_x0": F.min(F.least("x", "x2")).over(box), "_x1": F.max(F.greatest("x", "x2")).over(box)})
    at = points.withColumns({"_cx": F.floor(F.col("px") / cell), "_cy": F.floor(F.col("py") / cell)})
    span = at.agg(F.min("_cx").alias("_w"), F.max("_cx").alias("_e"), F.min("_cy").alias("_s"), F.max("_cy").alias("_n"))
    # what lies beside, above or below all points meets none
    low, high = F.greatest(F.floor(F.least("y", "y2") / cell), F.col("_s")), F.least(F.floor(F.greatest("y", "y2") / cell), F.col("_n"))
    west, east = F.greatest(F.floor(F.col("_x0") / cell), F.col("_w")), F.least(F.floor(F.col("_x1") / cell), F.col("_e"))
    reached = e.crossJoin(F.broadcast(span)).withColumns({"_low": low, "_high": high, "_west": west, "_east": east}).filter("_low <= _high AND _west <= _east")
    strips = reached.withColumn("_cy", F.explode(F.sequence("_low", "_high")))
    strips = strips.groupBy(key, "_cy").agg(F.collect_list(F.struct("x", "y", "x2", "y2")).alias("_e"), *[F.first(c).alias(c) for c in ("_x0", "_x1", "_west", "_east")])
    placed = strips.withColumn("_cx", F.explode(F.sequence("_west", "_east"))).select(key, "_cx", "_cy", "_x0", "_x1", "_e")
    px, py = F.col("px"), F.col("py")
    crosses = lambda s: ((s["y"] > py) != (s["y2"] > py)) & (px < (s["x2"] - s["x"]) * (py - s["y"]) / (s["y2"] - s["y"]) + s["x"])

    def inside(placed: DataFrame, odd: Column) -> DataFrame:
        near = at.join(placed.hint("merge"), ["_cx", "_cy"]).filter((px >= F.col("_x0")) & (px <= F.col("_x1")))
        return near.filter(odd).select("pid", key)

    # a strip of an outline mostly has a handful of edges: written out, these are compiled code, which a function over a list is not
    few = sum((F.when(F.coalesce(crosses(F.get("_e", F.lit(k))), F.lit(False)), 1).otherwise(0) for k in range(1, FEW)), F.when(crosses(F.col("_e")[0]), 1).otherwise(0))
    return inside(placed.filter(F.size("_e") <= FEW), few % 2 == 1).unionAll(inside(placed.filter(F.size("_e") > FEW), F.size(F.filter("_e", crosses)) % 2 == 1))


def intersecting(first: DataFrame, second: DataFrame, first_key: str, second_key: str, *, cell: float) -> DataFrame:
    """Pairs of polygons that share a point: edges that cross or touch, or a vertex of one inside the other.

    Edges meet only in the square cells that both touch, vertices by strips; equality joins on both, no pair of boxes apart
    is looked at.
    """
    span = lambda a: F.sequence(F.floor(F.least(a, a + "2") / cell), F.floor(F.greatest(a, a + "2") / cell))

    def placed(vertices: DataFrame, key: str, mark: str) -> DataFrame:
        e = edges(vertices, key).withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
        return e.select(F.col(key).alias(f"{mark}k"), "cx", "cy", *[F.col(c).alias(mark + c) for c in ("x", "y", "x2", "y2")])

    def side(p: str, q: str, r: str) -> Column:
        (ax, ay), (bx, by), (cx, cy) = ((F.col(m + "x" + n), F.col(m + "y" + n)) for m, n in (p.split("."), q.split("."), r.split(".")))
        return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))

    boxes = " AND ".join(f"least(a{c}, a{c}2) <= greatest(b{c}, b{c}2) AND least(b{c}, b{c}2) <= greatest(a{c}, a{c}2)" for c in "xy")
    met = placed(first, first_key, "a").join(placed(second, second_key, "b"), ["cx", "cy"]).filter(boxes)
    crossing = (side("a.", "a.2", "b.") * side("a.", "a.2", "b.2") <= 0) & (side("b.", "b.2", "a.") * side("b.", "b.2", "a.2") <= 0)
    touching = met.filter(crossing).select(F.col("ak").alias("_a"), F.col("bk").alias("_b"))
    corners = lambda v, key: v.filter("seq = 0").select(F.col(key).alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"))
    within = points_in(corners(first, first_key), second, second_key, cell=cell).select(F.col("pid").alias("_a"), F.col(second_key).alias("_b"))
    around = points_in(corners(second, second_key), first, first_key, cell=cell).select(F.col(first_key).alias("_a"), F.col("pid").alias("_b"))
    return touching.unionAll(within).unionAll(around).distinct().select(F.col("_a").alias(first_key), F.col("_b").alias(second_key))


#: Letters of the military grid; fixed values. Columns repeat every three zones, rows every 2000 km, from F in even zones.
_COLUMNS, _ROWS, _BANDS = ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ"), "ABCDEFGHJKLMNPQRSTUV", "CDEFGHJKLMNPQRSTUVWX"
_SQUARES = 61 * 9600  # more than any square's number


def _squares(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """The number of each place's 100 km square, -1 beyond 80 S and 84 N and for places without a number."""
    number = np.full(len(lon), -1, np.int64)
    on = np.flatnonzero((lat >= -80) & (lat <= 84) & np.isfinite(lon))
    lon, lat = lon[on], lat[on]
    zone = np.minimum(np.floor((lon + 180) / 6) + 1, 60)
    zone[(lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)] = 32
    for least, most, of in ((0, 9, 31), (9, 21, 33), (21, 33, 35), (33, 42, 37)):
        zone[(lat >= 72) & (lon >= least) & (lon < most)] = of
    e, n = to_utm(lon, lat, zone)
    column = (zone - 1) % 3 * 8 + np.clip(np.floor(e / 100_000), 1, 8) - 1
    row = (np.floor(n / 100_000) + np.where(zone % 2 == 0, 5, 0)) % 20
    band = np.minimum(np.floor((lat + 80) / 8), 19)
    number[on] = (((zone * 20 + band) * 24 + column) * 20 + row).astype(np.int64)
    return number


def _names(squares: np.ndarray) -> pa.Array:
    """Names of squares by their number (zone, band, column, row), null for -1."""
    found, at = np.unique(squares, return_inverse=True)
    names = [None if x < 0 else f"{x // 9600:02d}{_BANDS[x // 480 % 20]}{''.join(_COLUMNS)[x // 20 % 24]}{_ROWS[x % 20]}" for x in found.tolist()]
    return pa.array(names, pa.string()).take(pa.array(at))


def _numbers(batch: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    """Columns as arrays of doubles, NaN for null."""
    return [np.asarray(batch.column(c).cast(pa.float64()).fill_null(np.nan)) for c in columns]


def tile_names(points: DataFrame) -> DataFrame:
    """Points (lon, lat) with the name of their 100 km square (zone, band, column, row), null beyond 80 S and 84 N."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("tile", _names(_squares(*_numbers(batch, "lon", "lat"))))

    return points.mapInArrow(named, T.StructType([*points.schema.fields, T.StructField("tile", T.StringType())]))


def simplified(vertices: DataFrame, key: str, *, tolerance: float) -> DataFrame:
    """Rings (key, seq, x, y, perhaps ring and hole) without the vertices that lie within ``tolerance`` of the line between
    kept neighbours (Douglas and Peucker). The first vertex of a ring and the one farthest from it stay, and at least three.
    Its sections wait on a list, so an outline of any length needs no deep recursion; rings come to a task in blocks of whole ones."""

    def farthest(closed: np.ndarray, x: list[float], y: list[float], a: int, b: int) -> tuple[float, int]:
        """The vertex between a and b that is farthest from the line between them; a handful is faster without arrays."""
        if b - a > 16:
            line, off = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
            at = np.clip(off @ line / max(line @ line, 1e-300), 0, 1)
            distance = np.hypot(*(off - at[:, None] * line).T)
            most = int(np.argmax(distance))
            return float(distance[most]), a + 1 + most
        dx, dy, found = x[b] - x[a], y[b] - y[a], (-1.0, a)
        long2 = max(dx * dx + dy * dy, 1e-300)
        for k in range(a + 1, b):
            ex, ey = x[k] - x[a], y[k] - y[a]
            at = min(max((ex * dx + ey * dy) / long2, 0.0), 1.0)
            distance = math.hypot(ex - at * dx, ey - at * dy)
            if distance > found[0]:
                found = distance, k
        return found

    def kept(p: np.ndarray) -> list[bool]:
        size = len(p)
        if size <= 3:
            return [True] * size
        closed = np.concatenate((p, p[:1]))
        x, y = closed.T.tolist()
        far = max(range(size), key=lambda k: (x[k] - x[0]) ** 2 + (y[k] - y[0]) ** 2)
        keep, gap = [False] * size, [-1.0] * size
        keep[0] = keep[far] = True
        waiting = [(0, far), (far, size)]
        while waiting:
            a, b = waiting.pop()
            if b - a < 2:
                continue
            distance, most = farthest(closed, x, y, a, b)
            gap[most] = distance
            if distance > tolerance:
                keep[most] = True
                waiting += [(a, most), (most, b)]
        while sum(keep) < 3:
            keep[max(range(size), key=lambda k: -2.0 if keep[k] else gap[k])] = True
        return keep

    def thin(table: pa.Table, starts: np.ndarray) -> pa.Table:
        of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(table)]))
        table = table.take(pa.array(np.lexsort((np.asarray(table.column("seq")), of))))
        p = np.column_stack([np.asarray(table.column(c), float) for c in ("x", "y")])
        keep = [k for a, b in zip(starts, [*starts[1:], len(p)], strict=True) for k in kept(p[a:b])]
        return table.filter(pa.array(keep, pa.bool_()))

    return by_series(spread(vertices, key), tuple(rings(vertices, key)), thin, vertices.schema)


def covering_tiles(vertices: DataFrame, key: str, *, overlap: float = 9_800.0, sample: float = 5_000.0, tolerance: float = 0.001) -> DataFrame:
    """(key, tile) for each tile that a polygon (vertices in degrees) needs.

    A tile is a 100 km square with a strip to its east and south, so a point is in the squares of itself and of the points
    ``overlap`` to its west, its north and both. Points are the centroid, the vertices of the outline simplified by
    ``tolerance`` degrees, and a grid inside the whole polygon every ``sample`` metres, from the box's corner in the zone of
    the centroid.
    """
    vertices = spread(vertices, key)  # once, before anything else: all that follows is done where an outline's vertices are
    centre = centroids(vertices, key).select(key, F.col("cx").alias("clon"), F.col("cy").alias("clat"))
    mean = vertices.groupBy(key).agg(F.avg("x").alias("mlon"), F.avg("y").alias("mlat"))
    centre = mean.join(centre.hint("merge"), key).select(key, F.coalesce("clon", "mlon").alias("clon"), F.coalesce("clat", "mlat").alias("clat")).withColumn("zone", utm_zone(F.col("clon")))
    flat = vertices.join(centre.hint("merge"), key)
    e, n = to_utm(F.col("x"), F.col("y"), F.col("zone"))
    flat = flat.withColumn("e", e).withColumn("n", n - F.when(F.col("y") < 0, _SOUTH).otherwise(0.0))
    corner = flat.groupBy(key).agg(F.min("e").alias("e0"), F.min("n").alias("n0"))
    moved = flat.join(corner.hint("merge"), key).withColumn("x", F.col("e") - F.col("e0") + sample / 2).withColumn("y", F.col("n") - F.col("n0") + sample / 2)
    grid = rasterise(moved.select(*vertices.columns), key, step=sample).join(corner.hint("merge"), key).join(centre.hint("merge"), key)
    grid = grid.select(key, "zone", (F.col("e0") + F.col("col") * sample).alias("a"), (F.col("n0") + F.col("row") * sample).alias("b"))
    places = simplified(vertices, key, tolerance=tolerance).select(key, "x", "y").unionAll(centre.select(key, "clon", "clat"))
    points = places.select(key, F.lit(None).cast("long").alias("zone"), F.col("x").alias("a"), F.col("y").alias("b")).unionAll(grid)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zone, a, b = _numbers(batch, "zone", "a", "b")
            lon, lat = from_utm(a, b, zone, False)
            lon, lat = np.where(np.isnan(zone), a, lon), np.where(np.isnan(zone), b, lat)
            zone = np.minimum(np.floor((lon + 180) / 6) + 1, 60)
            e, n = to_utm(lon, lat, zone)
            n = n - np.where(lat < 0, _SOUTH, 0.0)
            squares = np.stack([_squares(*from_utm(e + de, n + dn, zone, False)) for de in (0.0, -overlap) for dn in (0.0, overlap)])
            keys = batch.column(key).dictionary_encode()
            number = np.tile(np.asarray(keys.indices, np.int64), 4) * _SQUARES + squares.reshape(-1)
            number = np.unique(number[squares.reshape(-1) >= 0])
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(number // _SQUARES)), _names(number % _SQUARES)], [key, "tile"])

    return points.mapInArrow(needed, T.StructType([vertices.schema[key], T.StructField("tile", T.StringType())])).distinct()


def overlaps(cells: DataFrame, key: str, *, least: float) -> DataFrame:
    """Pairs whose shared cells are at least a share of the candidate's. Sixty-four cells of a row meet as the bits of one number,
    and of two outlines in one direction. The pairs, and the work on them, grow with the square of the outlines that lie on each other."""
    total = cells.groupBy(key).agg(F.count("*").alias("_n"))
    bits = F.expr("bit_or(shiftleft(1L, CAST(pmod(col, 64) AS INT)))")
    words = cells.groupBy(key, "row", F.floor(F.col("col") / 64).alias("_w")).agg(bits.alias("_b"))
    one, two = (words.select(F.col(key).alias(k), "row", "_w", F.col("_b").alias(k + "b")) for k in ("_1", "_2"))
    met = one.join(two.hint("merge"), ["row", "_w"]).filter("_1 < _2").withColumn("_s", F.bit_count(F.col("_1b").bitwiseAND(F.col("_2b"))).cast("long")).filter("_s > 0")
    both = met.groupBy("_1", "_2").agg(F.sum("_s").alias("_s"))
    ways = F.array(F.struct(F.col("_1").alias("candidate"), F.col("_2").alias("other")), F.struct(F.col("_2").alias("candidate"), F.col("_1").alias("other")))
    shared = both.select("_s", F.explode(ways).alias("_p")).select("_p.*", "_s").join(total.withColumnRenamed(key, "candidate").hint("merge"), "candidate")
    return shared.withColumn("ratio", F.col("_s") / F.col("_n")).filter(F.col("ratio") >= least).select("candidate", "other", "ratio")


def discover(features: DataFrame, *, lon: float, lat: float, radius_km: float, most: int, placeholder: bool = False) -> DataFrame:
    """Features within a radius by the haversine, the first ``most`` in source order, the largest first.

    With ``placeholder`` and nothing found, one row (text ids) stands for a box of a kilometre around the place.
    """
    a = F.pow(F.sin(F.radians(F.col("lat") - lat) / 2), 2) + math.cos(math.radians(lat)) * F.cos(F.radians("lat")) * F.pow(F.sin(F.radians(F.col("lon") - lon) / 2), 2)
    found = features.withColumn("km", 2 * 6371.0088 * F.asin(F.sqrt(a))).filter(F.col("km") <= radius_km)
    near = found.orderBy("id").limit(most)
    if not placeholder:
        return near.orderBy(F.desc("area"))
    half_lat, half_lon = 0.5 / 111.0, 0.5 / (111.0 * max(math.cos(math.radians(lat)), 0.15))
    corners = [(k, lon + a * half_lon, lat + b * half_lat) for k, (a, b) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))]
    e, n = to_utm(F.col("lon"), F.col("lat"), utm_zone(F.lit(lon)))
    box = features.sparkSession.createDataFrame(corners, "seq long, lon double, lat double").select(F.lit(1).alias("_k"), "seq", e.alias("x"), n.alias("y"))
    stand_in = areas(box, "_k").select(F.lit(f"placeholder:{round(lat, 5)}:{round(lon, 5)}").alias("id"), F.lit(lon).alias("lon"), F.lit(lat).alias("lat"), F.col("area_km2").alias("area"), F.lit(0.0).alias("km"))
    none = near.agg(F.count("*").alias("_n")).filter("_n = 0").select(F.lit(1).alias("_one"))
    return near.unionByName(stand_in.crossJoin(F.broadcast(none)).drop("_one"), allowMissingColumns=True).orderBy(F.desc("area"))


def kind(tag: Column) -> Column:
    return F.when(tag.isin("reservoir", "basin"), "reservoir").when(tag == "river", "river_stretch").otherwise("lake")


def tier(area_km2: Column, kind_: Column, drinking: Column, urban: Column) -> Column:
    return F.when(drinking | (urban & (kind_ == "river_stretch")) | (area_km2 >= 10), 1).when(area_km2 >= 1, 2).otherwise(3)


def zone_count(area_km2: Column) -> Column:
    return F.least(F.greatest(4 + F.floor(F.greatest(F.lit(0.0), area_km2 - 5) / 6), F.lit(4)), F.lit(8)).cast("long")


def coarse_step(area_km2: Column, *, most_cells: int = 60_000, start: int = 10, stop: int = 1000) -> Column:
    """The step, doubled from the start until the cells are few enough or the step passes the stop."""
    steps = [start]
    while steps[-1] <= stop:
        steps.append(steps[-1] * 2)
    fits = lambda s: (F.ceil(area_km2 * 1e6 / (s * s)) <= most_cells) | (s > stop)
    return F.array_min(F.filter(F.array(*[F.lit(s) for s in steps]), fits)).cast("long")


_ACCENTED = "áàâäãåçéèêëíìîïñóòôöõúùûü"
_PLAIN = "aaaaaaceeeeiiiinooooouuuu"


def slug(text: Column) -> Column:
    """Accents off, lower case, anything else an underscore between words."""
    flat = F.translate(text, _ACCENTED + _ACCENTED.upper(), _PLAIN + _PLAIN.upper())
    return F.trim(F.regexp_replace(F.lower(flat), "[^a-z0-9]+", "_"), F.lit("_"))


def compass(dx: Column, dy: Column, centre: float) -> Column:
    """Name of the direction, clockwise from north by eighths; Central near the middle."""
    names = F.array(*[F.lit(x) for x in ("North", "North-East", "East", "South-East", "South", "South-West", "West", "North-West")])
    eighth = F.floor((F.degrees(F.atan2(dx, dy)) + 360 + 22.5) / 45) % 8
    return F.when(F.sqrt(dx * dx + dy * dy) < centre, "Central").otherwise(names[eighth.cast("int")])


#: Lines times pairs of zones that the starts of ``k_means`` work on side by side.
TOGETHER = 1 << 16


def _lines(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Points in order of x, then y, as lines of evenly spaced ones: where each line starts, its number of points, and the space."""
    along, up = np.diff(x) == 0, np.diff(y)
    steps = up[along & (up > 0)]
    step = float(steps.min()) if len(steps) else 1.0
    starts = np.concatenate(([0], np.flatnonzero(~(along & (up == step))) + 1))
    return starts, np.diff([*starts, len(x)]), step


def k_means(points: np.ndarray, k: int, starts: int) -> np.ndarray:
    """Zone of each point: the best of several starts, each with spread seeds and run until no point moves.

    At most as many zones as distinct points; zones are numbered by their centres' x, then y. Of a line of cells one above the other
    each zone has one stretch, so a round works out where these end, for lines times pairs of zones, and looks at no cell; points
    that lie on no grid are lines of one. A point as near to two centres is the first one's.
    """
    order = np.lexsort(points.T[::-1])
    points = points[order]
    x, y = (np.ascontiguousarray(c) for c in points.T)
    first, length, step = _lines(x, y)
    lx, ly, index = x[first], y[first], np.arange(k)

    def distances(c: np.ndarray) -> np.ndarray:
        dx, dy = x - c[0], y - c[1]
        dx *= dx
        dy *= dy
        dx += dy
        return dx

    def stretches(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, line, zone) where a zone's stretch of the line starts, and its number of points."""
        cx, cy = centres[:, :, 0], centres[:, :, 1]
        off = (lx[:, None] - cx[:, None, :]) ** 2
        # each zone against the other ones, which come first, in points from the line's start
        far, other, own = off.transpose(2, 0, 1)[..., None], cy.T[:, :, None, None], cy[:, None, :]
        before = index < index[:, None, None, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = ((far - off) / (2 * (other - own)) + (other + own) / 2 - ly[:, None]) / step
        low, high = np.floor(at), np.ceil(at)
        upto = np.where(own < other, np.where(before, low + 1, high), np.inf).min(0)
        since = np.where(own > other, np.where(before, high, low + 1), -np.inf).max(0)
        beaten = ((own == other) & ((far < off) | ((far == off) & (index > index[:, None, None, None])))).any(0)
        start = np.clip(since, 0, length[:, None])
        return start, np.where(beaten, 0, np.maximum(np.minimum(upto, length[:, None]) - start, 0))

    def nearest(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, n = stretches(centres)
        # where three zones met in a point and rounding left it to none or two, each point is looked at
        for s in np.flatnonzero((n.sum(2) != length).any(1)):
            zone = np.argmin([distances(c) for c in centres[s]], axis=0)
            n[s] = np.add.reduceat(zone[:, None] == index, first, axis=0)
            place = np.where(zone[:, None] == index, (np.arange(len(x)) - np.repeat(first, length))[:, None], np.inf)
            start[s] = np.where(n[s] > 0, np.minimum.reduceat(place, first, axis=0), 0.0)
        return start, n

    distinct = len(np.unique(x + 1j * y)) if len(x) <= k or len(np.unique(x[:1000] + 1j * y[:1000])) < k else k
    k, rng, seeds, best = max(1, min(k, distinct)), np.random.default_rng(0), [], None
    index = np.arange(k)
    for _ in range(starts):
        centres = points[rng.integers(len(points))][None]
        least = distances(centres[0])
        while len(centres) < k:
            centres = np.vstack([centres, points[rng.choice(len(points), p=least / least.sum())]])
            np.minimum(least, distances(centres[-1]), out=least)
        seeds.append(centres)
    together = max(1, TOGETHER // (len(first) * k * k))  # starts that are run side by side
    for part in range(0, starts, together):
        centres = np.array(seeds[part : part + together])
        zone, many = (np.zeros((len(centres), len(first), k)) for _ in range(2))
        cost, on = np.full(len(centres), np.inf), np.arange(len(centres))
        while len(on):
            start, n = nearest(centres[on])
            cx, cy = centres[on, None, :, 0], centres[on, None, :, 1]
            low = ly[:, None] + start * step - cy
            # the sum of (low + i * step) ** 2 for i from 0 to n - 1, and of what is beside the centre
            total = (n * ((lx[:, None] - cx) ** 2 + low * low + low * step * (n - 1) + step * step * (n - 1) * (2 * n - 1) / 6)).sum((1, 2))
            moves = ~((n == many[on]) & ((start == zone[on]) | (n == 0))).all((1, 2)) & (total < cost[on])
            on, start, n = on[moves], start[moves], n[moves]
            zone[on], many[on], cost[on] = start, n, total[moves]
            each = n.sum(1)
            sums = np.stack([(n * lx[:, None]).sum(1), (n * (ly[:, None] + start * step) + step * n * (n - 1) / 2).sum(1)], 2)
            centres[on] = np.where(each[..., None] > 0, sums / np.maximum(each, 1)[..., None], centres[on])
        s = int(np.argmin(cost))
        if best is None or cost[s] < best[0]:
            best = (cost[s], zone[s], many[s], centres[s])
    _, start, n, centres = best
    number = np.empty(k, np.int64)
    number[np.lexsort((centres[:, 1], centres[:, 0]))] = np.arange(k)
    of = np.argsort(np.where(n > 0, start, np.inf), axis=1, kind="stable")
    found = np.empty(len(points), np.int64)
    found[order] = np.repeat(number[of].reshape(-1), np.take_along_axis(n, of, 1).astype(np.int64).reshape(-1))
    return found


def partition(cells: DataFrame, key: str, *, k: int, starts: int = 10) -> DataFrame:
    """Cells (key, x, y) with ``zone`` 0 to k - 1: k-means to convergence in each body, the best of ten starts."""
    kind = cells.schema[key].dataType.simpleString()

    def one(body: pd.DataFrame) -> pd.DataFrame:
        body = body.sort_values(["x", "y"])
        return body.assign(zone=k_means(body[["x", "y"]].to_numpy(float), k, starts))

    return cells.select(key, "x", "y").groupBy(key).applyInPandas(one, f"{key} {kind}, x double, y double, zone long")


def latest(frame: DataFrame, keys: list[str], at: str) -> DataFrame:
    return first_rows(frame, keys, [F.col(at).desc()])
