"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash; a source may be read up to ``most`` times over. A document's virtual
finish time in a pass is the tokens of its source up to and including it, divided by the source's target. All
(document, pass) entries are ranked by that time and the ranking is cut off at the total budget.

All rankings and running totals are global and never computed in one task: rows are range-sorted, each task sums its
range, and only the ranges' sums, one row a task, meet. Documents fall into hash buckets and entries into time slots of a
few hundred rows first, so what is range-sorted is buckets and slots; inside a bucket or slot there is a small sorted
window. Cutting the order of slots at the budget, and then the order inside the slot in which it ends, is cutting the
global order of virtual finish times. The driver sees a constant number of scalars: row count, budget, the slot in which
the budget ends and the last entry taken.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.storage import running, written

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 512


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per source with ``rank`` (by code point, null last), ``source_size``, ``weight`` and ``target``.

    ``sizes`` has (source, source_size). The total of all sizes is shared by weight; a target stops at ``most`` times
    its source's size and the excess is shared again, by weight, among the sources below that. That is the level L
    with sum(min(most * size, L * weight)) = total, found in the order of most * size / weight: up to the first source
    whose cap is above its share at the level that the sources before it leave, all are at their caps.
    """
    ranked = running(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], {"rank": F.lit(1)}, "mix-ranks").drop("_null")
    ranked = ranked.withColumn("rank", F.col("rank") - 1)
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", share).withColumn("cap", F.col("source_size") * most).withColumn("_rise", F.col("cap") / F.col("weight"))
    totals = ranked.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_weights"))
    summed = running(ranked, ["_rise", "rank"], {"_caps": F.col("cap"), "_upto": F.col("weight")}, "mix-levels").crossJoin(F.broadcast(totals))  # one row
    level = (F.col("_all") - (F.col("_caps") - F.col("cap"))) / (F.col("_weights") - F.col("_upto") + F.col("weight"))
    levels = summed.withColumn("level", level)
    free = levels.filter(F.col("cap") > F.col("level") * F.col("weight")).agg(F.min(F.struct("_rise", "rank", "level")).alias("free"))
    levels = levels.crossJoin(F.broadcast(free))  # one row
    at_cap = F.col("free").isNull() | (F.struct("_rise", "rank") < F.struct("free._rise", "free.rank"))
    target = F.when(at_cap, F.col("cap").cast("double")).otherwise(F.col("free.level") * F.col("weight"))
    return levels.select("rank", "source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents with ``size``, ``source_size``, ``target`` and ``taken`` (words taken, repeats counted).

    ``docs`` needs doc_id, text and source. The result has doc_id, source, the columns named in ``keep`` (the texts,
    say, which then go through the shuffles) and ours; other columns, with whatever names, are not read. Null text has
    size 0; null source is a source of its own; a source of size 0 has target 0 and its documents are taken 0 words.
    Documents are shuffled by a hash of id and text, so rows that share an id (null, say) spread like others. Ties are
    ordered by (hash, doc_id, size), so reruns agree. An empty table gives an empty one. Rows that repeat both id and
    text are taken one after another and share a bucket, of which one task sums the sizes.
    """
    kept = [c for c in keep if c not in ("doc_id", "source")]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    base = written(docs.select("doc_id", "source", *kept, size.alias("size"), key.alias("_h")), "mix-sizes")
    rows = base.count()
    digits = max(1, math.ceil(math.log(max(rows, 1) / ROWS_PER_BUCKET, 16)) if rows > ROWS_PER_BUCKET else 1)
    targets = written(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, most=most), "mix-targets")
    placed = base.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    placed = placed.withColumn("_b", F.substring("_h", 1, digits))

    sums = placed.groupBy("rank", "_b").agg(F.sum("size").alias("_sum"))
    starts = running(sums, ["rank", "_b"], {"_upto": F.col("_sum")}, "mix-starts").withColumn("_before", F.col("_upto") - F.col("_sum"))
    # Totals so far, less those of the sources before: the least of the source's buckets tells them.
    first = starts.groupBy("rank").agg(F.min("_before").alias("_first"))
    starts = starts.join(first, "rank").select("rank", "_b", (F.col("_before") - F.col("_first")).alias("_before"))
    inside = Window.partitionBy("rank", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    timed = placed.withColumn("_cum", F.sum("size").over(inside)).join(starts, ["rank", "_b"])
    timed = timed.withColumn("_cum", F.col("_cum") + F.col("_before")).drop("_b", "_before")
    timed = written(timed, "mix-times")

    passes = F.array(*[F.lit(p) for p in range(most)])
    time = lambda p: F.try_divide(p * F.col("source_size") + F.col("_cum"), F.col("target"))
    entries = timed.filter("target > 0 and size > 0").select("size", "rank", "_h", "doc_id", "source_size", "_cum", "target", F.explode(passes).alias("p"))
    entries = entries.withColumn("time", time(F.col("p")))
    slots = max(1, rows // ROWS_PER_BUCKET)
    entries = entries.withColumn("slot", F.floor(F.least("time", F.lit(2.0)) * slots))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    by_slot = entries.groupBy("slot").agg(F.sum("size").alias("n"))
    crossing = running(by_slot, ["slot"], {"upto": F.col("n")}, "mix-slots").filter(F.col("upto") > F.lit(budget)).orderBy("slot").limit(1).first()
    if crossing is None:
        taken = F.when(F.col("target") > 0, F.col("size") * most).otherwise(F.lit(0))
    else:
        order = ["time", "rank", "_h", "doc_id", "size", "p"]
        within = Window.partitionBy("slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        last = (
            entries.filter(F.col("slot") == crossing["slot"])
            .withColumn("upto", F.sum("size").over(within) + F.lit(crossing["upto"] - crossing["n"]))
            .filter(F.col("upto") <= F.lit(budget))
            .orderBy(*[F.desc(c) for c in order])
            .limit(1)
            .first()
        )
        slot = lambda p: F.floor(F.least(time(p), F.lit(2.0)) * slots)
        taken = F.lit(0)
        for p in range(most):
            whole = slot(F.lit(p)) < F.lit(crossing["slot"])
            if last is not None:
                entry = F.struct(time(F.lit(p)).alias("time"), F.col("rank"), F.col("_h"), F.col("doc_id"), F.col("size"), F.lit(p).alias("p"))
                cut = F.struct(*[F.lit(last[c]).cast(entries.schema[c].dataType).alias(c) for c in order])
                whole = whole | ((slot(F.lit(p)) == F.lit(crossing["slot"])) & (entry <= cut))
            taken = taken + F.when((F.col("target") > 0) & whole, F.col("size")).otherwise(0)
    return timed.withColumn("taken", taken.cast("long")).drop("rank", "_h", "_cum")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the mix of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s0),
s2 AS (SELECT *, CAST(rnk % 3 + 1 AS DOUBLE) AS weight, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rnk) AS place,
              (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s2),
s4 AS (SELECT min(place) AS fp, arg_min(lvl, place) AS fl FROM s3 WHERE cap > lvl * weight),
s AS (SELECT source, rnk, source_size, CASE WHEN fp IS NULL OR place < fp THEN CAST(cap AS DOUBLE) ELSE fl * weight END AS target FROM s3, s4),
t AS (SELECT d.doc_id, d.size, d.h, s.rnk, s.source_size, s.target,
             CAST(sum(d.size) OVER (PARTITION BY s.rnk ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum, row_number() OVER () AS r
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
e AS (SELECT t.*, p, (p * source_size + cum) / target AS tm FROM t, (SELECT unnest([0, 1, 2]) AS p) WHERE target > 0 AND size > 0),
c AS (SELECT r, size, sum(size) OVER (ORDER BY tm, rnk, h, doc_id, size, p ROWS UNBOUNDED PRECEDING) AS upto FROM e),
k AS (SELECT r, sum(size) AS taken FROM c WHERE upto <= (SELECT sum(source_size) FROM s) GROUP BY r)
SELECT t.doc_id, t.size, t.source_size, t.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken FROM t LEFT JOIN k USING (r)
"""
