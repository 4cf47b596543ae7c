"""Connected components of a link table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.storage import discard, written


def _large(pairs: DataFrame) -> DataFrame:
    both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a").filter("b > a")
    return joined.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()


def _small(pairs: DataFrame) -> DataFrame:
    down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b): component is the smallest node that can be reached.

    Links to oneself and repeated links are allowed; nodes without links do not appear. Each round is two joins whose
    large keys adaptive execution can split, and is written to the shared folder; stars settle in two rounds, and the
    number of rounds grows with the logarithm of the nodes in general. Only a count and a checksum reach the driver.
    """
    pairs = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(pairs)
    while before[0]:
        older, pairs = pairs, written(_small(_large(pairs)), "stars")
        discard(older)
        after = _state(pairs)
        if after == before:
            break
        before = after
    tops = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(tops)
