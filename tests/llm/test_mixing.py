import pytest
from pyspark.sql import functions as F

from tidewater.llm import mixing


def brute_targets(sizes, most=3):
    """Give the total out by weight, cap, share the excess again, until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = {s: most * sizes[s] for s in free if most * sizes[s] < level * weight[s]}
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in names}
        capped |= over


CASES = [
    {"a": 100, "b": 100, "c": 100},
    {"a": 1000, "b": 10, "c": 10, "d": 7, None: 3},
    {"a": 5, "b": 0, "c": 900, "d": 40, "e": 1, "f": 333},
    {"z": 7},
]


@pytest.mark.parametrize("sizes", CASES)
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s]), s
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    sizes = {"a": 300, "b": 40, "c": 25, "d": 300, None: 10}
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k, " ".join(["w"] * (k % 7)), s))
            k += 1
    frame = docs(spark, rows)
    out = mixing.mix(frame, keep=("text",)).collect()
    again = mixing.mix(frame.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert len(out) == len(rows) and all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in out)
    for s in sizes:
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 40, s
    assert sum(r["taken"] for r in out) <= sum(r["size"] for r in out)


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, None, None), (None, "a b", "x"), (2, "", "x"), (2, "", "x"), (3, "a\tb\vc", "x")]
    out = sorted((str(r["doc_id"]), r["size"]) for r in mixing.mix(docs(spark, rows).withColumn("taken", F.lit("clash")).withColumn("rank", F.lit(1))).collect())
    assert out == [("1", 0), ("2", 0), ("2", 0), ("3", 3), ("None", 2)]
    assert mixing.mix(docs(spark, [])).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(docs(spark, [(1, None, "a")])).collect())
