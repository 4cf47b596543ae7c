"""An incremental weekly rollup and exactly-once stage input, kept as tables that batches of a stream overwrite by key.

Every write goes to partitions that carry the batch's number, so a batch that failed half-way and is given again replaces what
it wrote; what a batch decides depends on earlier batches only. The stream's own checkpoint says where a restart goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.stored import stored


def _overwrite(frame: DataFrame, path: str, *partitions: str) -> None:
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def week_of(at: Column) -> Column:
    """The Monday of the week."""
    return F.date_trunc("week", at).cast("date")


class WeeklyRollup:
    """Count and sum of ``value`` per ``key`` and week of ``ts``, in ``folder``.

    A batch adds its own sums for each week that ends after the horizon, ``days`` before the newest time of the batches
    before it; rows of older weeks are set aside until ``refresh`` makes those weeks anew from all events. A week is shown
    once the newest time is ``lag`` past its end. Where a stream is restarted, pass the same folder.
    """

    def __init__(self, spark: SparkSession, folder: str, *, key: str = "event_type", days: int = 90, lag: str = "1 hour"):
        self.spark, self.folder, self.key, self.days, self.lag = spark, folder.rstrip("/"), key, days, lag

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if _there(self.spark, path) else self.spark.createDataFrame([], schema)

    def _parts(self) -> DataFrame:
        return self._read("parts", f"{self.key} string, n long, total double, week date, batch_id long")

    def _seen(self) -> DataFrame:
        return self._read("seen", "newest timestamp, batch_id long")

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        """Take a batch in (for ``foreachBatch``); the same batch again changes nothing."""
        before = self._seen().filter(F.col("batch_id") < batch_id).agg(F.max("newest").alias("newest")).first()["newest"]
        rows = batch.select(self.key, "ts", "value").withColumn("week", week_of(F.col("ts"))).withColumn("batch_id", F.lit(batch_id))
        horizon = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {self.days} DAYS")
        late = F.coalesce(F.date_add("week", 7).cast("timestamp") <= horizon, F.lit(False))
        _overwrite(rows.filter(late), f"{self.folder}/late", "batch_id")
        sums = rows.filter(~late).groupBy(self.key, "week", "batch_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        _overwrite(sums.select(self.key, "n", "total", "week", "batch_id"), f"{self.folder}/parts", "week", "batch_id")
        _overwrite(rows.agg(F.max("ts").alias("newest")).withColumn("batch_id", F.lit(batch_id)), f"{self.folder}/seen", "batch_id")

    def late_weeks(self) -> DataFrame:
        """(week, batch_id) of rows that came after the horizon of their week; see ``refresh``."""
        late = self._read("late", f"{self.key} string, ts timestamp, value double, week date, batch_id long")
        done = self._read("fixed", f"{self.key} string, n long, total double, upto long, week date").groupBy("week").agg(F.max("upto").alias("upto"))
        waiting = late.join(done, "week", "left").filter(F.col("upto").isNull() | (F.col("batch_id") > F.col("upto")))
        return waiting.select("week", "batch_id").distinct()

    def refresh(self, events: DataFrame, weeks: DataFrame) -> None:
        """Make ``weeks`` (a column week) anew from ``events``, which must hold all that the batches so far have brought."""
        upto = self._seen().agg(F.max("batch_id")).first()[0]
        rows = events.select(self.key, "ts", "value").withColumn("week", week_of(F.col("ts"))).join(weeks.select("week").distinct(), "week", "left_semi")
        sums = rows.groupBy(self.key, "week").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        _overwrite(sums.select(self.key, "n", "total", F.lit(upto).cast("long").alias("upto"), "week"), f"{self.folder}/fixed", "week")

    def rollup(self) -> DataFrame:
        """(key, week, n, total) of the weeks that are over, with the lag, by the newest time seen."""
        fixed = self._read("fixed", f"{self.key} string, n long, total double, upto long, week date")
        upto = fixed.groupBy("week").agg(F.max("upto").alias("upto"))
        newer = self._parts().join(F.broadcast(upto), "week", "left").filter(F.col("upto").isNull() | (F.col("batch_id") > F.col("upto")))
        both = newer.select(self.key, "week", "n", "total").unionByName(fixed.select(self.key, "week", "n", "total"))
        sums = both.groupBy(self.key, "week").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        newest = self._seen().agg(F.max("newest").alias("newest"))
        shown = F.date_add("week", 7).cast("timestamp") + F.expr(f"INTERVAL {self.lag}") <= F.col("newest")
        return sums.join(F.broadcast(newest)).filter(shown).drop("newest")


class StageInput:
    """Messages of a stage, each key once, whatever is delivered again in the same batch or in another, in ``folder``.

    A batch's new keys go to ``out``, and then to the commit log. A batch that failed after writing is given again and
    overwrites both; a key that the log has from an earlier batch is dropped. Log and results are partitioned by batch.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys

    def _log(self, schema: str) -> DataFrame:
        path = f"{self.folder}/log"
        return self.spark.read.schema(schema).parquet(path) if _there(self.spark, path) else self.spark.createDataFrame([], schema)

    def absorb(self, batch: DataFrame, batch_id: int, work=lambda frame: frame) -> None:
        """Give the batch's new keys to ``work``, whose rows are the stage's result (for ``foreachBatch``)."""
        kinds = ", ".join(f"`{k}` {batch.schema[k].dataType.simpleString()}" for k in self.keys)
        known = self._log(f"{kinds}, batch_id long").filter(F.col("batch_id") < batch_id)
        new = stored(batch.dropDuplicates(self.keys).join(known, self.keys, "left_anti"), "stage-input")
        _overwrite(work(new).withColumn("batch_id", F.lit(batch_id)), f"{self.folder}/out", "batch_id")
        _overwrite(new.select(*self.keys).withColumn("batch_id", F.lit(batch_id)), f"{self.folder}/log", "batch_id")

    def done(self, schema: str) -> DataFrame:
        """The results of the batches that the log has."""
        log = self._log("batch_id long").distinct()
        path = f"{self.folder}/out"
        if not _there(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch_id long").parquet(path).join(F.broadcast(log), "batch_id", "left_semi").drop("batch_id")
