"""Pixel operators: masks, connected components and clusters, Otsu's threshold, zonal statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.constants import CLOUD_CLASSES, MIN_VALID_PCT, NODATA_CLASSES
from tidewater.operators import tiles


def cloud(scl: Column) -> Column:
    return scl.isin(*CLOUD_CLASSES)


def nodata(scl: Column) -> Column:
    return scl.isin(*NODATA_CLASSES)


def connected(points: DataFrame, scene: str) -> DataFrame:
    """Eight-connected components, each named by its least point, a struct (row, col)."""
    return tiles.clusters(points, scene, squared=2).withColumnRenamed("cluster", "component")


def dbscan(points: DataFrame, scene: str, *, eps: float, min_points: int) -> DataFrame:
    """Clusters of points: core points within ``eps`` share one, named by its least core point, a struct (row, col); a border
    point takes the least cluster next to it; other points have none."""
    return tiles.clusters(points, scene, squared=eps * eps, min_points=min_points)


def outline(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Unit edges (kind h or v, r, c) that bound the union of the pixels' squares: those of one pixel only."""
    edge = lambda kind, r, c: F.struct(F.lit(kind).alias("kind"), r.alias("r"), c.alias("c"))
    row, col = F.col("row"), F.col("col")
    each = pixels.select(*keys, F.explode(F.array(edge("h", row, col), edge("h", row + 1, col), edge("v", row, col), edge("v", row, col + 1))).alias("e"))
    return each.groupBy(*keys, "e.kind", "e.r", "e.c").agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")


def water_mask(pixels: DataFrame, scene: str, *, value: str, min_pixels: int, fallback: float, bounds: tuple[float, float] = (-0.3, 0.5), least: int = 50, spread: float = 0.05) -> DataFrame:
    """Pixels (scene, row, col, water): above the scene's threshold, cleaned, in a component of enough pixels, inside the
    search area and valid.

    ``pixels`` has row, col, valid, search and the index ``value``. The threshold is fitted on pixels that are valid and
    searched; with few of them, too even values or an unlikely threshold it is ``fallback``. Cleaning may bridge invalid
    pixels, so validity is asked for again at the end: there is no water under cloud.
    """
    fit = pixels.filter(F.col("search") & F.col("valid") & F.col(value).isNotNull())
    facts = fit.groupBy(scene).agg(F.count(value).alias("_cnt"), F.stddev_pop(value).alias("_sd"))
    found = otsu(fit, [scene], value).join(facts, scene)
    trusted = (F.col("_cnt") >= least) & (F.col("_sd") >= spread) & F.col("threshold").between(*bounds)
    cut = found.select(scene, F.when(trusted, F.col("threshold")).alias("_cut"))
    raw = pixels.filter(F.col("valid")).join(cut, scene, "left").filter(F.col(value) > F.coalesce("_cut", F.lit(fallback))).select(scene, "row", "col")
    labels = connected(tiles.cleaned(raw, pixels, scene), scene)
    large = labels.groupBy(scene, "component").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_pixels)
    kept = labels.join(large, [scene, "component"], "left_semi").select(scene, "row", "col", F.lit(True).alias("_k"))
    water = F.coalesce("_k", F.lit(False)) & F.col("search") & F.col("valid")
    return pixels.join(kept, [scene, "row", "col"], "left").select(scene, "row", "col", water.alias("water"))


def scene_verdict(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Per scene: pixels, valid and cloudy shares in percent, and whether it is usable (by the unrounded share)."""
    n = F.count("*")
    valid, cloudy = F.count_if(F.col("valid")), F.count_if(cloud(F.col("scl")))
    return pixels.groupBy(*keys).agg(n.alias("aoi_pixels"), F.round(100 * valid / n, 2).alias("valid_pct"), F.round(100 * cloudy / n, 2).alias("cloud_pct"), (100 * valid / n >= MIN_VALID_PCT).alias("usable"))


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null where the sum is 0."""
    return F.try_divide(a - b, a + b)


def otsu(values: DataFrame, keys: list[str], value: str, *, bins: int = 256) -> DataFrame:
    """Per key the threshold that divides the values' histogram with the most variance between its parts.

    Equal bins from the least to the largest value, the last one closed; where neighbouring splits are equally good,
    the middle of them (the even one of two); the threshold is the split bin's upper edge. Null for constant values.
    """
    span = values.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    placed = values.join(span, keys).filter("hi > lo").withColumn("bin", F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    counts = placed.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    full = span.filter("hi > lo").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))).join(counts, [*keys, "bin"], "left")
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    upto, every = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    mass = F.coalesce("n", F.lit(0))
    w = full.withColumn("w0", F.sum(mass).over(upto)).withColumn("w", F.sum(mass).over(every)).withColumn("m0", F.sum(mass * centre).over(upto)).withColumn("m", F.sum(mass * centre).over(every))
    w1 = F.col("w") - F.col("w0")
    apart = F.try_divide(F.col("m0"), F.col("w0")) - F.try_divide(F.col("m") - F.col("m0"), w1)
    scored = w.withColumn("v", F.coalesce(F.col("w0") * w1 * apart * apart, F.lit(0.0)))
    scored = scored.withColumn("best", F.max("v").over(every)).filter("v >= best * (1 - 1e-9)")
    split = scored.groupBy(*keys, "lo", "hi").agg(F.bround((F.min("bin") + F.max("bin")) / 2, 0).alias("split"))
    found = split.select(*keys, (F.col("lo") + (F.col("split") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("threshold"))
    return span.select(*keys).join(found, keys, "left")
