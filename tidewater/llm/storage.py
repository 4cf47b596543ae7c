"""Where intermediate tables go: the shared checkpoint folder that the cluster names."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a folder of our own on one machine (master ``local``,
    as in tests), and an error on a cluster, whose machines do not share one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
        folder = _OWN[context.applicationId]
    return folder


_OWN: dict[str, str] = {}
_STORED: list[str] = []
_LAST_COLLECTION = [0.0]
SECONDS_BETWEEN_COLLECTIONS = 3


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame, stored as Parquet in the shared folder and read again: lost executors do not lose it, lineage ends.

    Then, every few seconds, the driver is asked to collect its garbage, which is when Spark removes the shuffle files of
    what has ended: without that they pile up until the executors' disks are full.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = frame.schema
    frame.write.parquet(path)
    _STORED.append(path)
    del frame
    if time.monotonic() - _LAST_COLLECTION[0] > SECONDS_BETWEEN_COLLECTIONS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _LAST_COLLECTION[0] = time.monotonic()
    stored = spark.read.schema(schema).parquet(path)
    stored.stored_at = path
    return stored


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _STORED:
        _STORED.remove(path)


def discard(*frames: DataFrame) -> None:
    """Remove stored tables whose dependants have been stored in their turn."""
    for frame in frames:
        path = getattr(frame, "stored_at", None)
        if isinstance(path, str):
            _remove(frame.sparkSession, path)


def written_alone(frame: DataFrame, name: str, *, since: int) -> DataFrame:
    """The frame stored, and all that was stored after the first ``since`` tables (see ``stored_tables``) removed."""
    stored = written(frame, name)
    for path in _STORED[since:-1]:
        _remove(stored.sparkSession, path)
    return stored


def stored_tables() -> int:
    """How many stored tables there are now."""
    return len(_STORED)


#: Rows, and bytes by Spark's own estimate of the stored columns, that a join may broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 48 << 20


def small_side(stored: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The stored table, to be broadcast in a join if it has at most ``most`` rows and BROADCAST_BYTES bytes; beyond that
    the join is left to shuffle both sides, which adaptive execution splits where a key is large."""
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(stored) if size <= BROADCAST_BYTES and stored.count() <= most else stored


def running(frame: DataFrame, order: list[str], totals: dict[str, Column], name: str) -> DataFrame:
    """``frame`` with each of ``totals`` (new column: summed column) summed over the global ``order`` up to and with the
    row. Rows are range-sorted; a task sums its range, and only the ranges' sums, one row a task, meet in one window.
    ``order`` must tell all rows apart for the sums to be the same in every run."""
    rows = written(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in totals.items()])
    starts = sums.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_t_{k}") for k in totals])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(starts), "_range").withColumns({k: F.col(f"_t_{k}") + F.sum(c).over(inside) for k, c in totals.items()})
    return out.drop("_range", *[f"_t_{k}" for k in totals])
