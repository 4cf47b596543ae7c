"""Embedding near-duplicates by cross-polytope hashing with multiprobe buckets and verified pairs.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the coordinate of largest
size, with its sign. A table's bucket is a tuple of such hashes. Each vector is stored in its own bucket of every table
and probes, per hash, the bucket of the second-largest coordinate. Vectors that meet are compared in double precision
inside the task that holds the bucket; what leaves the task is, per vector, a number of links and one way to its
component there, so a bucket of near copies gives as many rows as it has vectors, not as many as it has pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.components import components
from tidewater.llm.storage import small_side, written
from tidewater.llm.tasks import whole_groups
from tidewater.llm.textkit import mix64

#: Rows of a block of a large bucket: a sixteenth of the bucket between these bounds, so that its work is spread over
#: about a hundred block pairs before blocks, and with them the copies that are sent, grow.
LEAST_BLOCK, MOST_BLOCK = 1024, 2048
ROWS_PER_BUCKET = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def bucket_ids(x: np.ndarray, *, tables: int, hashes: int, seed: int = 5) -> np.ndarray:
    """(rows, tables, 1 + hashes) bucket numbers: the own bucket, then a probe for each hash. ``x`` has unit rows."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    out = np.zeros((n, tables, 1 + hashes), np.uint64)
    rng = np.random.default_rng((seed, d))
    for t in range(tables):
        best, second = [], []
        for _ in range(hashes):
            turned = padded
            for _ in range(3):
                turned = hadamard(turned * rng.choice((-1.0, 1.0), size))
            large = np.abs(turned)
            top = np.argpartition(-large, 1, axis=1)[:, :2]
            swap = large[np.arange(n), top[:, 0]] < large[np.arange(n), top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            code = 2 * top + (np.take_along_axis(turned, top, 1) < 0)
            best.append(code[:, 0].astype(np.uint64))
            second.append(code[:, 1].astype(np.uint64))
        for probe in range(1 + hashes):
            key = np.full(n, mix64(np.uint64([d * 1000 + t]))[0], np.uint64)
            for k in range(hashes):
                key = mix64(key ^ (second[k] if probe == k + 1 else best[k]) + np.uint64(1))
            out[:, t, probe] = key
    return out


#: Chance that one hash of two vectors at cosine 0.95 meets directly, and that it meets with its probe: measured over
#: random pairs of 768-vectors and rounded down (shorter vectors and closer pairs meet more often).
MEET, MEET_PROBED = 0.5, 0.78


def plan(rows: int, dimensions: int, miss: float = 1e-3) -> tuple[int, int]:
    """(tables, hashes): hashes so that buckets stay near ROWS_PER_BUCKET, tables so that a pair at the threshold is
    missed with at most the chance ``miss``."""
    cells = 2 << max(1, (dimensions - 1).bit_length())
    hashes = max(1, math.ceil(math.log(max(rows / ROWS_PER_BUCKET, 1)) / math.log(cells)))
    meet = MEET**hashes + hashes * (MEET_PROBED - MEET) * MEET ** (hashes - 1)
    return math.ceil(math.log(miss) / math.log(1 - meet)), hashes


def _members(reps: DataFrame, *, tables: int, hashes: int) -> DataFrame:
    """Each representative's rows: bucket, table, probe or stored, the vector and all its bucket numbers."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = tables * (1 + hashes)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                column = part.column("embedding")
                lengths = np.asarray(column.value_lengths())
                flat = column.flatten()
                raw = np.asarray(flat, dtype=np.float32 if pa.types.is_float32(flat.type) else np.float64)
                starts = np.cumsum(lengths) - lengths
                for d in np.unique(lengths).tolist():
                    rows = np.flatnonzero(lengths == d)
                    own = raw[starts[rows][:, None] + np.arange(d)]
                    ids = bucket_ids(unit(own), tables=tables, hashes=hashes).reshape(len(rows), each)
                    take = pa.array(np.repeat(rows, each))
                    number = np.tile(np.arange(each), len(rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids.reshape(-1).view(np.int64)),
                            pa.array((number // (1 + hashes)).astype(np.int32)),
                            pa.array((number % (1 + hashes) > 0)),
                            part.column("rep").take(take),
                            part.column("copies").take(take),
                            pa.array([v.tobytes() for v in own.astype(np.float64 if own.dtype == np.float64 else np.float32)], pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), each))),
                            pa.array([v.tobytes() for v in ids], pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), each))),
                        ],
                        names=["bucket", "tab", "probe", "rep", "copies", "vector", "ids"],
                    )

    return reps.mapInArrow(place, "bucket long, tab int, probe boolean, rep long, copies long, vector binary, ids binary")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _compare(rows: DataFrame, *, single: bool, hashes: int, cosine: float) -> DataFrame:
    """(rep, links, root): per representative and block its links first met there, and its component's least member."""
    dtype = np.float32 if single else np.float64

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ("bucket", "b1", "b2")):
            found = [r for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b - a > 1 for r in [_block(table.slice(a, b - a), dtype, hashes, cosine)] if r is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["rep", "links", "root"])

    return rows.repartition("bucket", "b1", "b2").sortWithinPartitions("bucket", "b1", "b2").mapInArrow(compare, "rep long, links long, root long")


def _block(table: pa.Table, dtype: type, hashes: int, cosine: float):
    rep, copies, tab, b1, b2, side = (np.asarray(table.column(c)) for c in ("rep", "copies", "tab", "b1", "b2", "side"))
    probe = np.asarray(table.column("probe"))
    if probe.all():
        return None
    x = unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype).reshape(len(rep), -1))
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.uint64).reshape(len(rep), -1, 1 + hashes)
    within = b1[0] == b2[0]
    left = np.arange(len(rep)) if within else np.flatnonzero(side == 0)
    right = left if within else np.flatnonzero(side == 1)
    ok = x[left] @ x[right].T >= cosine
    ok &= ~(probe[left][:, None] & probe[right][None, :])
    if within:
        ok &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    i, j = np.nonzero(ok)
    i, j = left[i], right[j]
    fresh = rep[i] != rep[j]
    t = int(tab[0])
    for k in range(t):  # met in an earlier table
        fresh &= ~_meet(ids, i, j, k)
    # A stored vector and a probing one may meet in either's bucket: only in that of the smaller number does it count.
    stored, probing = np.where(probe[i], j, i), np.where(probe[i], i, j)
    twice = probe[probing] & (ids[stored, t, 1:] == ids[probing, t, :1]).any(axis=1)
    fresh &= ~(twice & (rep[stored] > rep[probing]))
    i, j = i[fresh], j[fresh]
    if not len(i):
        return None
    links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
    root = rep.copy()
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (root == before).all():
            break
    some = links > 0
    return rep[some], links[some].astype(np.int64), root[some]


def _meet(ids: np.ndarray, i: np.ndarray, j: np.ndarray, t: int) -> np.ndarray:
    return (ids[i, t] == ids[j, t, :1]).any(axis=1) | (ids[j, t] == ids[i, t, :1]).any(axis=1)


def _same_id(given: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): representatives of different vectors that share a vec_id, each with the least of them."""
    vector = F.struct("h1", "h2")
    shared = given.filter("sound").groupBy("vec_id").agg(F.min(vector).alias("low"), F.max(vector).alias("high")).filter("low <> high").select("vec_id")
    rows = given.filter("sound").select("vec_id", "h1", "h2").join(shared, "vec_id").join(reps.select("h1", "h2", "rep"), ["h1", "h2"])
    least = rows.groupBy("vec_id").agg(F.min("rep").alias("b"))
    return rows.join(least, "vec_id").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.95, miss: float = 1e-3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``, which needs vec_id and embedding.

    Links are pairs with a cosine of at least ``cosine`` in double precision, whatever other columns say; a pair at the
    threshold is missed with the chance ``miss`` at most, closer ones less, and none below it is linked. n_links counts
    other rows, copies among them. Vectors that are null, empty or zero, or hold nulls or non-finite numbers, and rows
    without a vec_id link with nothing; vectors of different lengths do not link. Rows that share a vec_id count
    separately in n_links and as one in components. Equal vectors are one representative, with a number of its own, before any
    bucket is made; large buckets are compared as pairs of blocks, each pair a group of its own.
    """
    item = vectors.schema["embedding"].dataType.elementType
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    given = given.withColumn("h1", F.when(F.col("sound"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("sound"), F.xxhash64(F.lit(17), "embedding", F.lit(71))))
    reps = given.filter("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    rows, dimensions = reps.agg(F.count("*"), F.max(F.size("embedding"))).first()
    tables, hashes = plan(rows, dimensions or 1, miss)

    members = _members(reps.select("rep", "copies", "embedding"), tables=tables, hashes=hashes)
    members = written(members, "buckets")
    large = members.groupBy("bucket").agg(F.count("*").alias("rows")).filter(F.col("rows") > 2 * LEAST_BLOCK)
    size = F.least(F.greatest(F.col("rows") / 16, F.lit(LEAST_BLOCK)), F.lit(MOST_BLOCK))
    blocks = F.coalesce(F.ceil(F.col("rows") / size), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("rep", "probe"), blocks).cast("int")
    spread = members.join(small_side(written(large, "large-buckets")), "bucket", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    met = written(_compare(spread.drop("own", "other", "rows"), single=isinstance(item, T.FloatType), hashes=hashes, cosine=cosine), "met")

    degree = met.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(met.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).unionAll(_same_id(given, reps)))
    named = reps.select("h1", "h2", "rep", "least", "copies").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = written(named.join(degree, "rep", "left"), "named")
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    named = named.join(names, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("name").alias("component"))
    out = given.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all embeddings at a cosine of 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
