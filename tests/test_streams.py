"""Streams over several batches: late rows, restarts, redelivery, closing events and timers."""

import datetime
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tidewater.streaming import episodes
from tidewater.streaming.rollup import StageInput, WeeklyRollup

START = datetime.datetime(2024, 1, 1)  # a Monday


def at(day, hour=1):
    return START + datetime.timedelta(days=day, hours=hour)


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def land(spark, where, number, rows, schema):
    """One file, older than those landed later."""
    part = f"{where}/part={number}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
    for name in os.listdir(part):
        os.utime(f"{part}/{name}", (1_600_000_000 + number * 1000,) * 2)


EVENTS = "event_type string, ts timestamp, value double"


def batchwise(spark, rows):
    return {(r["event_type"], r["week"]): (r["n"], round(r["total"], 6)) for r in spark.createDataFrame(rows, EVENTS).groupBy("event_type", F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}


def test_rollup_over_three_batches_with_late_rows_and_a_restart(spark):
    source, out = folder(), folder()
    batches = [
        [("a", at(d), float(d)) for d in range(0, 40, 3)] + [("b", at(5), 1.0)],
        [("a", at(d), 2.0) for d in range(30, 150, 7)] + [("a", at(20), 100.0)],  # late, within the horizon
        [("a", at(d), 3.0) for d in range(150, 170, 5)] + [("a", at(6), 7.0), ("b", at(1), 9.0)],  # far behind it
    ]

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.writeStream.foreachBatch(WeeklyRollup(spark, out).absorb).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    land(spark, source, 1, batches[0], EVENTS)
    land(spark, source, 2, batches[1], EVENTS)
    run()
    land(spark, source, 3, batches[2], EVENTS)
    run()  # goes on from the checkpoint
    rollup = WeeklyRollup(spark, out)
    got = lambda: {(r["event_type"], r["week"]): (r["n"], round(r["total"], 6)) for r in rollup.rollup().collect()}
    whole, on_time = (batchwise(spark, [r for b in bs for r in b]) for bs in (batches, [batches[0], batches[1], batches[2][:4]]))
    newest = max(r[1] for b in batches for r in b)
    over = lambda found: {k: v for k, v in found.items() if datetime.datetime.combine(k[1], datetime.time()) + datetime.timedelta(days=7, hours=1) <= newest}
    assert got() == over(on_time) and over(on_time) != on_time
    rollup.absorb(spark.createDataFrame(batches[1], EVENTS), 1)  # redelivered: the same batch number
    assert got() == over(on_time)
    weeks = rollup.late_weeks()
    assert {str(r["week"]) for r in weeks.collect()} == {"2024-01-01"}
    rollup.refresh(spark.createDataFrame([r for b in batches for r in b], EVENTS), weeks)
    assert got() == over(whole) and rollup.late_weeks().count() == 0
    rollup.absorb(spark.createDataFrame([("c", at(166), 1.0)], EVENTS), 3)
    assert got() == over(whole)


def test_stage_input_survives_a_failed_batch_and_drops_redelivered_keys(spark):
    out = folder()
    stage = StageInput(spark, out, ["body_id", "scene_id"])
    kind = "body_id long, scene_id string, note string"
    first = spark.createDataFrame([(1, "a", "x"), (1, "a", "again"), (2, "b", "y")], kind)
    done = lambda: sorted((r["body_id"], r["scene_id"]) for r in stage.done(kind).collect())

    class Crash(Exception):
        pass

    def failing(frame):
        frame.write.mode("overwrite").parquet(f"{folder()}/half")  # the stage has worked, then the batch fails
        raise Crash

    with pytest.raises(Crash):
        stage.absorb(first, 0, failing)
    assert done() == []
    stage.absorb(first, 0)
    assert done() == [(1, "a"), (2, "b")]
    # Written, but not yet in the log: not done, and given again it replaces itself.
    spark.createDataFrame([(3, "c", "z")], kind).write.parquet(f"{out}/out/batch_id=1")
    assert done() == [(1, "a"), (2, "b")]
    again = spark.createDataFrame([(3, "c", "z"), (2, "b", "redelivered")], kind)
    stage.absorb(again, 1)
    stage.absorb(again, 1)
    assert done() == [(1, "a"), (2, "b"), (3, "c")]
    stage.absorb(first, 2)
    assert done() == [(1, "a"), (2, "b"), (3, "c")]


CANDIDATES = "zone_id long, indicator string, candidate_id long, observed_at timestamp"
STATUS = "zone_id long, indicator string, episode long, at timestamp"


def test_episodes_with_late_rows_dismissal_and_expiry(spark):
    spark.conf.set(*episodes.PROVIDER)
    seen, status, out = folder(), folder(), folder()
    rows = {}

    def run():
        a = spark.readStream.schema(CANDIDATES).option("maxFilesPerTrigger", 1).parquet(seen)
        b = spark.readStream.schema(STATUS).option("maxFilesPerTrigger", 1).parquet(status)
        stream = episodes.tracked(a, b, days=14, late="10 days")
        query = stream.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/b/batch={n}")).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        found = spark.read.parquet(f"{out}/b").collect()
        rows.clear()
        rows.update({(r["what"], r["candidate_id"] or r["episode"], r["zone_id"]): r["episode"] for r in found})

    try:
        land(spark, seen, 1, [(1, "x", 1, at(30)), (1, "x", 2, at(40)), (2, "x", 9, at(0))], CANDIDATES)
        land(spark, status, 1, [(7, "x", None, at(0))], STATUS)
        run()
        assert rows["observed", 1, 1] == rows["observed", 2, 1] == 1 and rows["observed", 9, 2] == 1
        assert rows["expired", 1, 2] == 1  # the watermark, day 30, is past day 14
        land(spark, seen, 2, [(1, "x", 3, at(33)), (1, "x", 4, at(44))], CANDIDATES)  # one late, one after the dismissal
        land(spark, status, 2, [(1, "x", 1, at(42))], STATUS)
        run()
        assert rows["closed", 1, 1] == 1 and rows["observed", 3, 1] == 1 and rows["observed", 4, 1] == 2
        land(spark, seen, 3, [(2, "x", 10, at(45)), (1, "x", 5, at(90)), (1, "x", 6, at(2))], CANDIDATES)  # the last is behind the watermark
        land(spark, status, 3, [(7, "x", None, at(45))], STATUS)
        run()
        assert rows["observed", 10, 2] == 2 and rows["observed", 5, 1] == 3 and ("observed", 6, 1) not in rows
        assert rows["expired", 2, 1] == 2
    finally:
        spark.conf.unset(episodes.PROVIDER[0])
