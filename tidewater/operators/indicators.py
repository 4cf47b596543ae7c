"""Spectral indicators as named column factories, and their statistics per zone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.constants import MIN_ZONE_PIXELS, MIN_ZONE_VALID_PCT
from tidewater.operators.pixels import normalised_difference


@dataclass(frozen=True)
class Indicator:
    key: str
    low: float
    high: float
    water_only: bool
    formula: str
    compute: Callable[[], Column]


#: Indicators in registry order; the slope 177/945 places 842 nm between 665 and 1610 nm. Fixed values.
INDICATORS = {
    i.key: i
    for i in (
        Indicator("ndti", -1.0, 1.0, True, "(b04 - b03) / (b04 + b03)", lambda: normalised_difference(F.col("b04"), F.col("b03"))),
        Indicator("ndci", -1.0, 1.0, True, "(b05 - b04) / (b05 + b04)", lambda: normalised_difference(F.col("b05"), F.col("b04"))),
        Indicator("fai", -0.2, 0.3, True, "b08 - (b04 + (b11 - b04) * 177 / 945)", lambda: F.col("b08") - (F.col("b04") + (F.col("b11") - F.col("b04")) * (177 / 945))),
        Indicator("sediment", 0.0, 0.5, True, "b04", lambda: F.col("b04")),
        Indicator("mndwi", -1.0, 1.0, False, "(b03 - b11) / (b03 + b11)", lambda: normalised_difference(F.col("b03"), F.col("b11"))),
    )
}


def reflectance(pixels: DataFrame, *, offset: Column | None = None, bands: tuple[str, ...] = ("b03", "b04", "b05", "b08", "b11")) -> DataFrame:
    """Digital numbers to reflectance in 0 to 1 with the scene's offset; other columns stay."""
    shift = F.lit(0) if offset is None else offset
    return pixels.withColumns({b: F.least(F.greatest((F.col(b) + shift) / 10000, F.lit(0.0)), F.lit(1.0)) for b in bands})


def long_indicators(pixels: DataFrame, keep: list[str]) -> DataFrame:
    """One row per pixel and indicator: value cut to its range, and whether it was cut; water-only ones on water only."""
    made = []
    for i in INDICATORS.values():
        raw = i.compute()
        raw = F.when(F.col("water"), raw) if i.water_only else raw
        made.append(F.struct(F.lit(i.key).alias("indicator"), F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(i.low)), F.lit(i.high))).alias("value"), ((raw < i.low) | (raw > i.high)).alias("clipped")))
    each = pixels.filter("valid").select(*keep, F.explode(F.array(*made)).alias("m"))
    return each.select(*keep, "m.*").filter("value IS NOT NULL")


def footprint(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Per zone: pixels, valid and water ones, valid share, and water's share of the valid."""
    valid, water = F.count_if("valid"), F.count_if(F.col("valid") & F.col("water"))
    return pixels.groupBy(*keys).agg(F.count("*").alias("n_pixels"), valid.alias("n_valid"), water.alias("n_water"), (100 * valid / F.count("*")).alias("valid_pct"), F.try_divide(100 * water, valid).alias("water_pct"))


def zonal(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: mean, exact p90, population deviation, n, and the share that was cut."""
    return long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.percentile("value", 0.9).alias("p90"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"), (100 * F.avg(F.col("clipped").cast("double"))).alias("clipped_pct"))


def rejection(n_pixels: Column, valid_pct: Column, n: Column) -> Column:
    """Why a zone gives no statistic: off the grid, then too little of it valid, then too few pixels; else null."""
    return F.when(F.coalesce(n_pixels, F.lit(0)) == 0, "off grid").when(F.round(valid_pct, 2) < MIN_ZONE_VALID_PCT, "too little valid").when(F.coalesce(n, F.lit(0)) < MIN_ZONE_PIXELS, "too few pixels")


def stretch(values: DataFrame, keys: list[str], *, floor: float, ramp: tuple[float, float], multiple: float = 2.0) -> DataFrame:
    """Display range per key from p2 to p98 with 5 % around it, inside the ramp; null where there is little to show, or nothing
    inside the ramp."""
    p = values.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(0.02), F.lit(0.98))).alias("p"))
    lo, hi = F.col("p")[0], F.col("p")[1]
    shown = (hi > lo) & (hi - lo >= multiple * floor)
    pad = (hi - lo) * 0.05
    low, high = F.greatest(lo - pad, F.lit(ramp[0])), F.least(hi + pad, F.lit(ramp[1]))
    shown = shown & (high > low)
    return p.select(*keys, F.when(shown, low).alias("low"), F.when(shown, high).alias("high"))
