"""Links at 0.8: the join against brute force, and what the pipeline's stage drops."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import jaccard

DOCS = "doc_id long, text string, source string"


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[j : j + width]) for j in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def components(sets, percent):
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in sets}


def test_join_at_80_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for k in range(240):
        base = np.random.default_rng(1000 + k % 40)
        words = [f"w{x}" for x in base.integers(500, size=int(base.integers(4, 120)))]
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(len(words)))] = f"e{rng.integers(30)}"
        words = words[: len(words) - int(rng.integers(0, 1 + len(words) // 8))]
        rows.append((k, " ".join(words + passage * (k % 3 == 0)), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, " ".join(passage), "s"), (503, rows[1][1].upper(), "s"), (504, "a b c d e f g h", "s"), (505, "a b c d e f g h i", "s")]
    sets = {i: shingles(t) for i, t, _ in rows}
    wanted = components(sets, 80)
    assert wanted != components(sets, 85) and wanted[505] == 504
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, DOCS), width=5, percent=80).collect()}
    assert out == {i: (len(sets[i]), wanted[i]) for i in sets}


def test_stage_drops_a_copy_at_81_percent(spark):
    words = [f"w{i}" for i in range(100)]
    edited = words[:50] + ["x"] + words[51:70] + ["y"] + words[71:]
    near, far = shingles(" ".join(words)), shingles(" ".join(edited))
    assert 80 * len(near | far) <= 100 * len(near & far) < 85 * len(near | far)
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join(edited), "en", "s", 1), (3, "something else", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 3}


def test_null_and_repeated_ids_lose_no_link(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:30], "x", *words[31:]]), " ".join(f"v{i}" for i in range(50))
    rows = [(2, text, "s"), (1, text, "s"), (None, text, "s"), (7, near, "s"), (7, other, "s"), (9, other, "s"), (9, other, "s"), (None, "just a few words", "s"), (None, None, "s"), (3, " ", "s")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash"))
    for width, percent in ((4, 85), (5, 80)):
        out = sorted(tuple(-1 if x is None else x for x in (r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard.join(docs, width=width, percent=percent).collect())
        n, m = 61 - width, 51 - width
        assert out == sorted([(2, n, 1), (1, n, 1), (-1, n, 1), (7, n, 1), (7, m, 7), (9, m, 7), (9, m, 7), (-1, 1, -1), (-1, 0, -1), (3, 0, 3)])
    kept = sorted(repr((r["doc_id"], r["text"])) for r in jaccard.one_of_each(docs.drop("row"), width=5, percent=80).collect())
    assert kept == sorted(repr(x) for x in [(1, text), (7, other), (None, "just a few words"), (None, None), (3, " ")])
    assert jaccard.join(docs.limit(0), width=4, percent=85).count() == 0
