"""Vector codes against a plain integer k-means, and the transform's own properties."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import codes

ROWS = "vec_id long, embedding array<double>, label string"


def plain(rows, parts=8, entries=16, rounds=6):
    """{vec_id: (code, error)} and the digest, by whole distances in Python integers."""
    kept = sorted((r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    cut = []
    for _, vector, _ in kept:
        ints = [math.floor(4096 * v) for v in vector]
        width = -(-len(ints) // parts)
        ints += [0] * (parts * width - len(ints))
        cut.append([ints[p * width : (p + 1) * width] for p in range(parts)])
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def best(point, book):
        return min((sum((a - b) ** 2 for a, b in zip(point, entry, strict=True)), k) for k, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(best(c[p], books[p])[1], []).append(c[p])
            for k, own in members.items():
                books[p][k] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    found = []
    for row, c in zip(kept, cut, strict=True):
        each = [best(c[p], books[p]) for p in range(parts)]
        found.append((row[0], row[2], "".join(f"{k:02x}" for _, k in each), sum(d for d, _ in each)))
    totals = {}
    for _, label, _, error in found:
        totals[label] = totals.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return sorted(((i, c, e, totals[g], digest) for i, g, c, e in found), key=str)


def check(spark, rows):
    frame = spark.createDataFrame(rows, ROWS).repartition(3).withColumn("code", F.lit("clash")).withColumn("part", F.lit("clash"))
    out = codes.compress(frame).drop("label")
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain(rows)


def test_codes_match_plain_integer_rounds(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=24).tolist(), "ab"[i % 2] if i % 5 else None) for i in range(120)]
    check(spark, rows)


def test_repeated_null_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    one = rng.normal(size=20).tolist()  # eight parts do not divide twenty
    rows = [(7, one, "a")] * 40 + [(7, (-np.array(one)).tolist(), "a"), (None, one, None), (3, None, "a"), (4, [None] * 20, "a"), (5, [math.nan] * 20, "a"), (6, [math.inf] * 20, "b")]
    rows += [(i, rng.integers(-2, 3, 20).astype(float).tolist(), "b") for i in range(8, 40)]  # ties
    check(spark, rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    check(spark, [(i, (rng.normal(size=16) * 3e4).tolist(), "a") for i in range(60)])
    with pytest.raises(Exception, match="too large for exact sums"):
        codes.compress(spark.createDataFrame([(1, [1e300] * 8, "a")], ROWS)).collect()


def test_few_rows_lengths_of_their_own_and_no_rows(spark):
    check(spark, [(1, [0.5] * 16, "a"), (2, [0.25] * 16, "b")])
    mixed = [(i, [float(i)] * 16, "a") for i in range(20)] + [(i, [float(i)] * 8, "b") for i in range(20, 30)] + [(99, [], "c")]
    out = {r["vec_id"]: r for r in codes.compress(spark.createDataFrame(mixed, ROWS)).collect()}
    for part in (mixed[:20], mixed[20:30]):
        assert [(r[0], out[r[0]]["code"], out[r[0]]["error"], out[r[0]]["label_error"], out[r[0]]["codebooks_sha256"]) for r in sorted(part, key=lambda r: str(r[0]))] == plain(part)
    assert out[99]["code"] == "00" * 8 and out[99]["error"] == 0
    assert codes.compress(spark.createDataFrame([], ROWS)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 8, 12])
def test_transform_keeps_scaled_distances_in_sequency_order(size):
    x = np.random.default_rng(size).integers(-1000, 1000, (30, size))
    t = codes.transformed(x)
    padded = t.shape[1]
    assert ((t[:, None] - t[None]) ** 2).sum(2).tolist() == (padded * ((x[:, None] - x[None]) ** 2).sum(2)).tolist()
    rows = codes.transformed(np.eye(padded, dtype=np.int64)).T
    assert [(np.diff(np.sign(r)) != 0).sum() for r in rows] == list(range(padded))


def test_early_elimination_equals_whole_distances():
    rng = np.random.default_rng(9)
    points, entries = rng.integers(-9, 9, (500, 16)), rng.integers(-9, 9, (16, 16))
    index, least = codes.nearest(codes.transformed(points), codes.transformed(entries))
    whole = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert index.tolist() == whole.argmin(1).tolist() and (least // 16).tolist() == whole.min(1).tolist()
