"""Seasonal baselines: robust statistics of what was observed near the same day of any year."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.constants import DEFAULT_FLOOR, DOYS, MAD_TO_SIGMA, MIN_HISTORY_DAYS, MIN_HISTORY_DAYS_OTHER, MIN_SAMPLES, WINDOW_DAYS


def circular_distance(a: Column, b: Column) -> Column:
    """Days between two days of the year, the short way round."""
    apart = F.abs(a - b)
    return F.least(apart, F.lit(DOYS) - apart)


def nearby_doys(doy: Column, half: int) -> Column:
    """Array of the days of the year within ``half`` days."""
    return F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: F.pmod(doy - 1 + k, F.lit(DOYS)) + 1)


def robust(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: median, 1.4826 times the median absolute deviation, p10, p90 and n, of the finite values.

    Both aggregations have the same keys, so one exchange serves them both.
    """
    finite = frame.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    first = finite.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9))).alias("_p"), F.count("*").alias("n_samples"))
    spread = finite.join(first.select(*keys, F.col("_p")[0].alias("_m")), keys).groupBy(*keys).agg((F.percentile(F.abs(F.col(value) - F.col("_m")), 0.5) * MAD_TO_SIGMA).alias("sigma"))
    return first.join(spread, keys).select(*keys, F.col("_p")[0].alias("median"), "sigma", F.col("_p")[1].alias("p10"), F.col("_p")[2].alias("p90"), "n_samples")


#: Numbers of a matrix of windows that one step of ``_windows`` works on.
CELLS = 1 << 16


def _quantile(ordered: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Per row the quantile of its first ``n`` numbers, which are in order, by linear interpolation."""
    place = (n - 1) * share
    low, rows = np.floor(place).astype(np.int64), np.arange(len(n))
    first, second = ordered[rows, low], ordered[rows, np.ceil(place).astype(np.int64)]
    return first + (second - first) * (place - low)


def _windows(doy: np.ndarray, year: np.ndarray, value: np.ndarray, asked: np.ndarray, half: int, of: np.ndarray | int = 0, asked_of: np.ndarray | int = 0) -> list[np.ndarray]:
    """median, sigma, p10, p90, n and number of years of the readings within ``half`` days of each day of ``asked``; of several
    series, whose numbers are ``of`` and ``asked_of``, each by itself.

    In the order of the days, twice round the year, a window is one slice.
    """
    place, wanted = of * (4 * DOYS) + doy, asked_of * (4 * DOYS) + asked
    days, at = np.concatenate([place + k * DOYS for k in (-1, 0, 1)]), np.tile(np.arange(len(doy)), 3)
    order = np.argsort(days, kind="stable")
    days, at = days[order], at[order]
    begin, end = np.searchsorted(days, wanted - half), np.searchsorted(days, wanted + half, "right")
    n = end - begin
    out = [np.full(len(asked), np.nan) for _ in range(4)] + [n.astype(np.int64), np.zeros(len(asked), np.int64)]
    some = np.flatnonzero(n)
    step = max(1, CELLS // max(1, int(n.max(initial=1))))
    for rows in (some[k : k + step] for k in range(0, len(some), step)):
        width = np.arange(int(n[rows].max()))
        inside = width[None, :] < n[rows][:, None]
        where = at[np.minimum(begin[rows][:, None] + width[None, :], len(at) - 1)]
        ordered = np.sort(np.where(inside, value[where], np.inf), axis=1)
        out[0][rows], out[2][rows], out[3][rows] = (_quantile(ordered, n[rows], q) for q in (0.5, 0.1, 0.9))
        away = np.sort(np.abs(ordered - out[0][rows][:, None]), axis=1)
        out[1][rows] = _quantile(away, n[rows], 0.5) * MAD_TO_SIGMA
        years = np.sort(np.where(inside, year[where], -1), axis=1)
        out[5][rows] = ((years[:, 1:] != years[:, :-1]).sum(axis=1) + 1) - (~inside).any(axis=1)
    return out


def dealt(frame: DataFrame, *keys: str) -> DataFrame:
    """By the keys over a number of partitions of our own: a series has few bytes, but a year of windows."""
    spark = frame.sparkSession
    return frame.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), *keys)


def seasonal_baseline(obs: DataFrame, *, value: str = "mean", window_days: int = WINDOW_DAYS, series: tuple[str, ...] = ("zone_id", "indicator"), asked: DataFrame | None = None, own_days: bool = False) -> DataFrame:
    """Per series and day of the year 1 to 366: statistics of all observations within half the window; empty days too.

    With ``asked`` (the series' columns and doy) only those days are made, with ``own_days`` only those of the series' own
    readings, which is what looking these up needs. A series' readings (one a pass, some thousands in
    a decade) are one task's group: they cross the exchange once, and each window is a slice of them.
    """
    own = obs.select(*series, F.col(value).cast("double").alias("_v"), F.dayofyear("observed_at").alias("_d"), F.year("observed_at").alias("_y"))
    if asked is None:
        own = own.withColumn("_a", F.lit(None).cast("array<int>"))
    else:
        own = own.join(asked.groupBy(*series).agg(F.array_sort(F.collect_set(F.col("doy").cast("int"))).alias("_a")), [*series])

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        value, doy, year = (np.asarray(table.column(c).fill_null(np.nan if c == "_v" else 0)) for c in ("_v", "_d", "_y"))
        wanted = table.column("_a")[0].as_py()
        days = np.unique(doy[doy > 0]) if own_days else np.arange(1, DOYS + 1) if wanted is None else np.array(wanted)
        finite = np.isfinite(value)
        found = _windows(doy[finite].astype(np.int64), year[finite].astype(np.int64), value[finite], days, window_days // 2)
        columns = {c: pa.array([k.as_py()] * len(days), k.type) for c, k in zip(series, key, strict=True)} | {"doy": pa.array(days, pa.int32())}
        stats = {c: pa.array(x, pa.float64(), mask=found[4] == 0) for c, x in zip(("median", "sigma", "p10", "p90"), found, strict=False)}
        return pa.table(columns | stats | {"n_samples": pa.array(found[4]), "n_years": pa.array(found[5])})

    kinds = ", ".join(f"{c} {obs.schema[c].dataType.simpleString()}" for c in series)
    return dealt(own, *series).groupBy(*series).applyInArrow(build, f"{kinds}, doy int, median double, sigma double, p10 double, p90 double, n_samples long, n_years long")


def _starts(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """Rows, but the first, whose columns are not those of the row before; nulls are alike."""
    other = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(0, len(c) - 1))
        other |= np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | (np.asarray(a.is_null()) != np.asarray(b.is_null()))
    return np.flatnonzero(other) + 1


def by_series(frame: DataFrame, series: tuple[str, ...], work: Callable[[pa.Table, np.ndarray], pa.Table], kind: T.StructType | str) -> DataFrame:
    """What ``work`` makes of blocks of whole series, given a block and the rows at which its series begin.

    ``frame`` is dealt out by the series or some of their columns. Series are small and many, and handing each to Python as a group of its
    own costs ten times what is done with it; so they come in order, as many at once as a batch holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(tables: list[pa.Table]) -> list[pa.RecordBatch]:
            block = pa.concat_tables(tables).combine_chunks()
            return work(block, np.concatenate([[0], _starts([block.column(c) for c in series])]).astype(np.int64)).combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            before = [held[-1].slice(len(held[-1]) - 1), table] if held else [table]
            joined = pa.concat_tables([t.select(list(series)) for t in before])
            starts = _starts([joined.column(c) for c in series]) - (len(joined) - len(table))
            if len(starts):
                yield from done([*held, table.slice(0, starts[-1])])
                held = [table.slice(starts[-1])]
            else:
                held.append(table)
        if held:
            yield from done(held)

    return frame.sortWithinPartitions(*series).mapInArrow(run, kind)


def _history(table: pa.Table, starts: np.ndarray) -> pa.Array:
    """Per series the whole days between its first and last observation."""
    column = table.column("observed_at")
    at = column.cast(pa.timestamp("us", getattr(column.type, "tz", None))).cast(pa.int64())
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    first, last = np.minimum.reduceat(np.asarray(at.fill_null(most)), starts), np.maximum.reduceat(np.asarray(at.fill_null(least)), starts)
    none = last == least
    return pa.array(np.where(none, 0, np.where(none, 0, last) - np.where(none, 0, first)) // 86_400_000_000, pa.int64(), mask=none)


def looked_up(obs: DataFrame, *, value: str = "mean", window_days: int = WINDOW_DAYS, series: tuple[str, ...] = ("zone_id", "indicator")) -> DataFrame:
    """Readings with the ``seasonal_baseline`` of their day of the year (doy, median, sigma, p10, p90, n_samples, n_years) and
    their series' history_days; nulls where the series or the day is null. ``obs`` is ``dealt`` out by the series or some of their columns.

    Nothing is joined: a series' readings are in one task, which has all that its windows need, and only the windows of its
    own days are made.
    """
    made = "doy int, median double, sigma double, p10 double, p90 double, n_samples long, n_years long, history_days long"
    kind = T.StructType([*obs.schema.fields, *T._parse_datatype_string(made).fields])

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        values, doy, year = (np.asarray(table.column(c).fill_null(fill)) for c, fill in (("_v", np.nan), ("_d", 0), ("_y", 0)))
        doy, of = doy.astype(np.int64), np.repeat(np.arange(len(starts)), np.diff([*starts, len(table)]))
        finite = np.isfinite(values) & (doy > 0)
        days, at = np.unique(of * DOYS + np.maximum(doy - 1, 0), return_inverse=True)
        found = [x[at] for x in _windows(doy[finite], year[finite].astype(np.int64), values[finite], days % DOYS + 1, window_days // 2, of[finite], days // DOYS)]
        unkeyed = np.any([np.asarray(table.column(c).is_null()) for c in series], axis=0)
        unknown = unkeyed | (doy == 0)
        out = {"doy": pa.array(doy, pa.int32(), mask=doy == 0)}
        out |= {c: pa.array(x, pa.float64(), mask=unknown | (found[4] == 0)) for c, x in zip(("median", "sigma", "p10", "p90"), found, strict=False)}
        out |= {c: pa.array(x, pa.int64(), mask=unknown) for c, x in zip(("n_samples", "n_years"), found[4:], strict=True)}
        out["history_days"] = _history(table, starts).take(pa.array(of, mask=unkeyed))
        for c, x in out.items():
            table = table.append_column(c, x)
        return table.select(kind.names)

    own = obs.select("*", F.col(value).cast("double").alias("_v"), F.dayofyear("observed_at").alias("_d"), F.year("observed_at").alias("_y"))
    return by_series(own, series, work, kind)


def window_counts(obs: DataFrame, *, value: str = "mean", window_days: int = WINDOW_DAYS, series: tuple[str, ...] = ("zone_id", "indicator")) -> DataFrame:
    """Per series ``counts``, the n_samples of ``seasonal_baseline`` for the days 1 to 366 in order, and history_days: what a summary
    of a build asks, without the statistics. A series is one row."""
    half = window_days // 2

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        values, doy = (np.asarray(table.column(c).fill_null(fill)) for c, fill in (("_v", np.nan), ("_d", 0)))
        of, finite = np.repeat(np.arange(len(starts)), np.diff([*starts, len(table)])), np.isfinite(values) & (doy > 0)
        n = np.bincount(of[finite] * DOYS + doy[finite] - 1, minlength=len(starts) * DOYS).reshape(-1, DOYS)
        sums = np.cumsum(np.pad(n, ((0, 0), (half + 1, half)), mode="wrap"), axis=1)
        counts = (sums[:, 2 * half + 1 :] - sums[:, :DOYS]).astype(np.int64).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * DOYS, pa.int32()), pa.array(counts))
        return table.select(list(series)).take(pa.array(starts)).append_column("counts", lists).append_column("history_days", _history(table, starts))

    kind = T.StructType([*obs.select(*series).schema.fields, *T._parse_datatype_string("counts array<long>, history_days long").fields])
    own = dealt(obs.select(*series, "observed_at", F.col(value).cast("double").alias("_v")), *series).withColumn("_d", F.dayofyear("observed_at"))
    return by_series(own, series, work, kind)


def touched_windows(fresh: DataFrame, *, window_days: int = WINDOW_DAYS, series: tuple[str, ...] = ("zone_id", "indicator")) -> DataFrame:
    """(series, doy): the windows that new readings change; a week of them changes 37, or 38 where it meets
    the day that only leap years have."""
    near = F.explode(nearby_doys(F.dayofyear("observed_at"), window_days // 2))
    return fresh.select(*series, near.alias("doy")).distinct()


def extended_baseline(before: DataFrame, obs: DataFrame, fresh: DataFrame, *, value: str = "mean", window_days: int = WINDOW_DAYS, series: tuple[str, ...] = ("zone_id", "indicator")) -> DataFrame:
    """The baseline ``before`` with the windows that ``fresh`` readings change made anew from ``obs``, which holds old and fresh
    ones; a new series gets its whole year. Other windows and other series' readings are not worked on again."""
    changed = touched_windows(fresh, window_days=window_days, series=series)
    new_series = fresh.select(*series).distinct().join(before.select(*series).distinct(), [*series], "left_anti")
    asked = changed.unionByName(new_series.withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(DOYS))))).distinct()
    made = seasonal_baseline(obs, value=value, window_days=window_days, series=series, asked=asked)
    return before.join(asked, [*series, "doy"], "left_anti").select(*made.columns).unionByName(made)


def history_days(obs: DataFrame, *, series: tuple[str, ...] = ("zone_id", "indicator")) -> DataFrame:
    """Whole days between a series' first and last observation."""
    at = lambda c: c.cast("timestamp").cast("long")
    seconds = at(F.max("observed_at")) - at(F.min("observed_at"))
    return obs.groupBy(*series).agg(F.floor(seconds / 86400).cast("long").alias("history_days"), F.min("observed_at").alias("history_from"), F.max("observed_at").alias("history_to"))


def needed_days(tier: Column) -> Column:
    """Days of history that a body's tier asks for; a missing tier counts as the last."""
    need = F.lit(MIN_HISTORY_DAYS_OTHER)
    for k, days in MIN_HISTORY_DAYS.items():
        need = F.when(F.coalesce(tier, F.lit(3)) == k, F.lit(days)).otherwise(need)
    return need


def window_status(n_samples: Column, history: Column, tier: Column) -> Column:
    """usable, or building: too few samples, or a history too short for the tier."""
    return F.when(n_samples < MIN_SAMPLES, "building").when(history < needed_days(tier), "building").otherwise("usable")


def window_reason(n_samples: Column, history: Column, tier: Column) -> Column:
    """Why a window is building; null if it is usable."""
    few = F.format_string("%d of %d samples", n_samples, F.lit(MIN_SAMPLES))
    short = F.format_string("%d of %d days of history", history, needed_days(tier))
    return F.when(n_samples < MIN_SAMPLES, few).when(history < needed_days(tier), short)


def robust_z(value: Column, median: Column, sigma: Column, floor: Column | float = DEFAULT_FLOOR) -> Column:
    """(value - median) / max(sigma, floor); null where the window is empty."""
    return (value - median) / F.greatest(sigma, F.lit(floor) if isinstance(floor, float) else floor)


def weekly_rollup(obs: DataFrame) -> DataFrame:
    """Per series and week from Monday: average, extremes and count."""
    week = F.date_trunc("week", "observed_at").alias("week")
    return obs.groupBy("zone_id", "indicator", week).agg(
        F.avg("mean").alias("avg_mean"), F.avg("p90").alias("avg_p90"), F.max("p90").alias("max_p90"), F.min("mean").alias("min_mean"), F.max("mean").alias("max_mean"), F.avg("valid_pixel_pct").alias("avg_valid_pct"), F.count("*").alias("n")
    )


def history_union(obs: DataFrame, samples: DataFrame, *, until: str | None = None) -> DataFrame:
    """Observations with a value and field-confirmed samples as one history, strictly before ``until``."""
    columns = ["zone_id", "indicator", "observed_at", "value"]
    both = obs.filter("mean IS NOT NULL").withColumnRenamed("mean", "value").select(*columns, F.lit("satellite").alias("origin"))
    both = both.unionByName(samples.select(*columns, F.lit("field").alias("origin")))
    return both.filter(F.col("observed_at") < F.lit(until).cast("timestamp")) if until else both


def first_rows(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    ranked = frame.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_r = 1").drop("_r")
